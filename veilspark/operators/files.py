"""What a path, a size and an extension say about a file."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.globs import extension

# --- fixed values ---------------------------------------------------------
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".heic", ".bmp", ".tiff")
FORMATS = {".pdf": "pdf", ".docx": "docx", ".doc": "docx"}
FILE_TYPES = {
    ".txt": "text", ".log": "text", ".md": "markdown", ".markdown": "markdown",
    ".json": "json", ".jsonl": "text", ".xml": "xml", ".csv": "csv", ".tsv": "tsv",
    ".html": "html", ".htm": "html",
    ".js": "code", ".ts": "code", ".py": "code", ".java": "code", ".go": "code", ".rs": "code",
    ".rb": "code", ".php": "code", ".cpp": "code", ".c": "code", ".sh": "code", ".bash": "code",
    ".docx": "docx", ".doc": "docx", ".pdf": "pdf",
}
REASON_OVERSIZE = "File size {size} exceeds {limit}-byte limit; routing to request_permission for explicit human review."
REASON_IMAGE = "Image file ({ext}); OCR not supported in v1. Routing to request_permission for human review."
# ----------------------------------------------------------------------------


def _pick(key: Column, table: dict[str, str], default: str) -> Column:
    """Constant lookup as a folded map literal: no join, one hash probe per row."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), key), F.lit(default))


def file_format(path: Column) -> Column:
    """text, pdf, docx, or binary for images."""
    ext = extension(path)
    return F.when(ext.isin(*IMAGE_EXTENSIONS), "binary").otherwise(_pick(ext, FORMATS, "text"))


def file_type(path: Column) -> Column:
    """The finer type that picks a redaction template; unknown extensions are text."""
    return _pick(extension(path), FILE_TYPES, "text")


def format_inventory(files: DataFrame) -> DataFrame:
    """(format, file_type, n_files)."""
    return files.groupBy(
        file_format(F.col("path")).alias("format"), file_type(F.col("path")).alias("file_type")
    ).agg(F.count(F.lit(1)).alias("n_files"))


def oversize_reason(size: Column, max_bytes: int | None) -> Column:
    """Says that a file is above a limit the caller set; null otherwise."""
    if max_bytes is None:
        return F.lit(None).cast("string")
    told = F.replace(
        F.lit(REASON_OVERSIZE.replace("{limit}", str(max_bytes))), F.lit("{size}"), size.cast("string")
    )
    return F.when(size > max_bytes, told)


def image_reason(path: Column) -> Column:
    """Why an image must go to a person: it holds no text to read; null for other files."""
    ext = extension(path)
    return F.when(ext.isin(*IMAGE_EXTENSIONS), F.replace(F.lit(REASON_IMAGE), F.lit("{ext}"), ext))


def gate_reason(path: Column, size: Column, max_bytes: int | None = None) -> Column:
    """Why a file must go to a person; null if it need not.  There is no limit unless the caller sets one."""
    return F.coalesce(oversize_reason(size, max_bytes), image_reason(path))


def admission_gate(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Adds format, `escalate` and `escalate_reason`; size is looked at before the extension."""
    reason = gate_reason(F.col("path"), F.col("size_bytes"), max_bytes)
    return files.select(
        "*", file_format(F.col("path")).alias("format"),
        reason.isNotNull().alias("escalate"), reason.alias("escalate_reason"),
    )


def split_admitted(files: DataFrame, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(admitted, escalated)."""
    gated = admission_gate(files, max_bytes)
    return gated.where(~F.col("escalate")), gated.where("escalate")
