"""Rewriting documents: placeholders, known findings, edit logs, line patches."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.patterns import DEFAULT_RULES, Rule
from veilspark.functions.ranking import number_sorted
from veilspark.functions.spans import (
    built_once,
    find_spans,
    let,
    merge_spans,
    number_spans,
    replace_spans,
)
from veilspark.operators.files import file_type
from veilspark.operators.policy import path_policy
from veilspark.session import write_through

METHOD_REGEX = "regex-only"
METHOD_MODEL = "llm+regex"

# --- fixed values: redaction text by file type; {t} is the finding's type ----
TEMPLATES = {
    "text": "[REDACTED: {t}]",
    "markdown": "[REDACTED: {t}]",
    "xml": "[REDACTED: {t}]",
    "docx": "[REDACTED: {t}]",
    "json": "[REDACTED: {t}]",
    "csv": "[REDACTED]",
    "tsv": "[REDACTED]",
    "html": '<span class="redacted" data-type="{t}">[REDACTED]</span>',
    "code": '"[REDACTED_{t}]"',
}
DEFAULT_TEMPLATE = "[REDACTED: {t}]"
# ------------------------------------------------------------------------------


@built_once
def marks_of(text: Column, rules: Sequence[Rule] = DEFAULT_RULES, dedupe: bool = False) -> Column:
    """Disjoint, numbered spans of a text, as an array."""
    return number_spans(merge_spans(find_spans(text, rules)), text, dedupe)


def with_marks(
    docs: DataFrame,
    text: str = "text",
    rules: Sequence[Rule] = DEFAULT_RULES,
    dedupe: bool = False,
    spans: str | None = None,
) -> DataFrame:
    """Adds `marks`, the array of disjoint numbered spans of each text.

    `spans` names a column that holds the text's spans already.
    """
    if spans is None:
        return docs.withColumn("marks", marks_of(text, rules, dedupe=dedupe))
    return docs.withColumn("marks", number_spans(merge_spans(F.col(spans)), F.col(text), dedupe))


def redact_text(marked: DataFrame, text: str = "text") -> DataFrame:
    """Adds `sanitized_text`, each text rebuilt around its `marks`."""
    return marked.withColumn("sanitized_text", replace_spans(F.col(text), F.col("marks")))


def sanitize(
    docs: DataFrame,
    text: str = "text",
    rules: Sequence[Rule] = DEFAULT_RULES,
    dedupe: bool = False,
    spans: str | None = None,
) -> DataFrame:
    """Adds `marks`, `sanitized_text`, `redaction_count` and `method`.

    Works inside the row: one scan, no shuffle.
    """
    return redact_text(with_marks(docs, text, rules, dedupe, spans), text).select(
        "*", F.size("marks").alias("redaction_count"), F.lit(METHOD_REGEX).alias("method")
    )


def placeholder_rows(marked: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(keys, category, original, start, end, placeholder), one row per mark.

    The optimiser adds a size test below a generator over a bare column and pushes
    it down to where the column is computed, which would find the spans again for
    the test; over an expression it does not.
    """
    marks = F.filter("marks", lambda m: m.end > m.start)
    return marked.select(*keys, F.inline(marks)).select(
        *keys, "category", "original", "start", "end", "placeholder"
    )


def assign_placeholders(
    docs: DataFrame,
    text: str = "text",
    rules: Sequence[Rule] = DEFAULT_RULES,
    scope: str = "doc",
    dedupe: bool = False,
) -> DataFrame:
    """Number the disjoint spans per category, left to right, from 1.

    `scope="doc"` restarts in every document, inside the row.  `scope="corpus"`
    counts on over all documents in `doc_id` order; there a category may hold most
    of the rows, so ranks are built from chunks of documents, over spans that are
    stored once in the shared folder.  With `dedupe` equal values share the number
    of their first appearance.
    """
    if scope == "doc":
        return placeholder_rows(with_marks(docs, text, rules, dedupe))
    if scope != "corpus":
        raise ValueError(f"unknown scope: {scope}")
    spans = write_through(
        docs.sparkSession, placeholder_rows(with_marks(docs, text, rules)).drop("placeholder"), "spans"
    )
    name = F.concat(F.lit("__"), F.col("category"), F.lit("_"), F.col("_n").cast("string"), F.lit("__"))
    if not dedupe:
        numbered = number_sorted(spans, ["category"], ["doc_id", "start"], "_n")
        return numbered.withColumn("placeholder", name).drop("_n")
    firsts = write_through(
        docs.sparkSession,
        spans.groupBy("category", "original")
        .agg(F.min(F.struct("doc_id", "start")).alias("_first"))
        .select("category", "original", "_first.doc_id", "_first.start"),
        "firsts",
    )
    numbered = number_sorted(firsts, ["category"], ["doc_id", "start"], "_n")
    return spans.join(
        numbered.select("category", "original", name.alias("placeholder")), ["category", "original"]
    ).select("doc_id", "category", "original", "start", "end", "placeholder")


def sanitize_tables(docs: DataFrame, detections: DataFrame, text: str = "text") -> DataFrame:
    """Redaction from a table of disjoint spans with placeholders, one shuffle on the document.

    `detections` has (doc_id, start, end, placeholder); the result has the same
    text as `sanitize` when the spans are the same.
    """
    spans = detections.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "placeholder"))).alias("_spans")
    )

    one_byte = F.octet_length(text) == F.length(text)

    def rebuild(s: Column, raw: Column, chars: Column) -> Column:
        """Pieces are cut from bytes where a character is one byte, else from an array of characters:
        a substring by characters would walk from the start of the text for every piece."""

        def piece(start: Column, size: Column) -> Column:
            return F.when(one_byte, F.substr(raw, start + 1, size).cast("string")).otherwise(
                F.array_join(F.slice(chars, start + 1, size), "")
            )

        pieces = F.transform(
            s,
            lambda x, i: let(
                F.coalesce(F.get(s, i - 1).end, F.lit(0)),
                lambda at: F.concat(piece(at, x.start - at), x.placeholder),
            ),
        )
        last = F.get(s, F.size(s) - 1).end
        return F.concat(F.array_join(pieces, ""), piece(last, F.length(text) - last))

    chars = F.when(~one_byte, F.split(F.col(text), "", -1))
    rebuilt = let(
        F.col("_spans"),
        lambda s: let(
            F.col(text).cast("binary"), lambda raw: let(chars, lambda letters: rebuild(s, raw, letters))
        ),
    )
    return (
        docs.join(spans, "doc_id", "left")
        .withColumn(
            "sanitized_text",
            F.when(F.col("_spans").isNull(), F.col(text)).otherwise(rebuilt),
        )
        .withColumn("redaction_count", F.coalesce(F.size("_spans"), F.lit(0)))
        .drop("_spans")
    )


def _template(kind: Column, label: Column) -> Column:
    chosen = F.lit(DEFAULT_TEMPLATE)
    for name, template in TEMPLATES.items():
        if template != DEFAULT_TEMPLATE:
            chosen = F.when(kind == name, F.lit(template)).otherwise(chosen)
    return F.replace(chosen, F.lit("{t}"), label)


def redact_by_findings(docs: DataFrame, findings: DataFrame, text: str = "text") -> DataFrame:
    """Replace every literal occurrence of known values, longest value first.

    `docs` has (doc_id, path, text), `findings` (doc_id, type, value).  The
    replacement follows the file type of the path.  Equal findings are merged
    before the shuffle, so a document gets each value once.  The text is cut at a
    value's occurrences, and shorter values are looked for in what is left between
    them; so no value is ever found in a replacement.  `redaction_count` counts the
    replacements that were made.
    """
    per_doc = (
        findings.where(F.length("value") > 0)
        .groupBy("doc_id", "value")
        .agg(F.min("type").alias("type"))
        .groupBy("doc_id")
        .agg(
            F.sort_array(
                F.collect_list(F.struct((-F.length("value")).alias("rank"), "value", "type"))
            ).alias("_findings")
        )
    )
    kind = file_type(F.col("path"))
    piece = "struct<t:string,type:string>"
    pieces = f"array<{piece}>"

    def cut(state: Column, f: Column) -> Column:
        """Every open piece, cut at the value; a piece with a type stands for a replacement."""
        literal = F.concat(F.lit(r"\Q"), F.replace(f.value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
        open_piece = lambda t: F.struct(t.alias("t"), F.lit(None).cast("string").alias("type")).cast(piece)
        gap = F.struct(F.lit("").alias("t"), f.type.alias("type")).cast(piece)
        between = lambda t: F.flatten(
            F.transform(
                F.split(t, literal, -1),
                lambda x, i: F.when(i == 0, F.array(open_piece(x))).otherwise(F.array(gap, open_piece(x))),
            )
        )
        return F.flatten(F.transform(state, lambda p: F.when(p.type.isNull(), between(p.t)).otherwise(F.array(p))))

    whole = F.array(F.struct(F.col(text).alias("t"), F.lit(None).cast("string").alias("type"))).cast(pieces)
    written = F.transform("_pieces", lambda p: F.when(p.type.isNull(), p.t).otherwise(_template(F.col("_kind"), p.type)))
    made = F.size(F.filter("_pieces", lambda p: p.type.isNotNull()))
    return (
        docs.join(per_doc, "doc_id", "left")
        .withColumn("_kind", kind)
        .withColumn("_pieces", F.when(F.col("_findings").isNotNull(), F.aggregate("_findings", whole, cut)))
        .withColumn("redacted_text", F.when(F.col("_pieces").isNull(), F.col(text)).otherwise(F.array_join(written, "")))
        .withColumn("redaction_count", F.when(F.col("_pieces").isNull(), 0).otherwise(made))
        .withColumn("file_type", F.col("_kind"))
        .drop("_findings", "_kind", "_pieces")
    )


def replay_edits(docs: DataFrame, edits: DataFrame, text: str = "text", max_turns: int | None = None) -> DataFrame:
    """Apply an ordered edit log to each document.

    `edits` has (doc_id, turn, seq, old_string, new_string, replace_all, done);
    a turn may hold several edits.  Turns are counted from 1; those after a turn that
    signals `done` are not played, as in a conversation that has ended, nor those after
    `max_turns` where the caller sets it.  Each edit works on the result of the last one.
    """
    stops = edits.where("done").groupBy("doc_id").agg(F.min("turn").alias("_stop"))
    played = (
        edits.join(stops, "doc_id", "left")
        .where(F.col("_stop").isNull() | (F.col("turn") <= F.col("_stop")))
        .where(F.lit(True) if max_turns is None else F.col("turn") <= max_turns)
        .where(F.length("old_string") > 0)
    )
    log = played.groupBy("doc_id").agg(
        F.sort_array(
            F.collect_list(F.struct("turn", "seq", "old_string", "new_string", "replace_all"))
        ).alias("_edits")
    )

    def step(acc: Column, e: Column) -> Column:
        at = F.instr(acc, e.old_string)
        first = F.when(at == 0, acc).otherwise(
            F.overlay(acc, e.new_string, at, F.length(e.old_string))
        )
        return F.when(e.replace_all, F.replace(acc, e.old_string, e.new_string)).otherwise(first)

    return (
        docs.join(log, "doc_id", "left")
        .withColumn(
            "edited_text",
            F.when(F.col("_edits").isNull(), F.col(text)).otherwise(
                F.aggregate(F.col("_edits"), F.col(text), step)
            ),
        )
        .withColumn("edit_count", F.coalesce(F.size("_edits"), F.lit(0)))
        .drop("_edits")
    )


FINDINGS_SCHEMA = (
    "struct<sanitized_text:string,redactions:array<struct<type:string,placeholder:string,context:string>>,"
    "summary:string,_corrupt_record:string>"
)


def parse_model_output(raw: Column) -> Column:
    """Model answer, with or without a code fence, as a struct; null if it is no JSON object."""
    opened = F.regexp_replace(raw, r"(?dm)^```(?:json)?\s*([\s\S]*)\z", "$1")
    body = F.regexp_replace(opened, r"(?dm)```\s*$([\s\S]*)\z", "$1")
    answer = F.from_json(body, FINDINGS_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record"})
    whole = answer["_corrupt_record"].isNull() & F.rlike(body, F.lit(r"\}\s*\z"))
    return F.when(whole, answer)


def merge_model_findings(
    docs: DataFrame, answers: DataFrame, text: str = "text", rules: Sequence[Rule] = DEFAULT_RULES
) -> DataFrame:
    """Join pattern findings with those a model proposed for the same document.

    `answers` has (doc_id, raw).  An answer that cannot be parsed, or holds no
    sanitized text, leaves the pattern findings alone.  Model findings have no
    offsets: `start` and `end` are null.
    """
    parsed = answers.select("doc_id", parse_model_output(F.col("raw")).alias("answer")).where(
        F.length("answer.sanitized_text") > 0
    )
    own = placeholder_rows(with_marks(docs, text, rules)).withColumn("origin", F.lit("regex"))
    model = (
        parsed.select("doc_id", F.inline("answer.redactions"))
        .select(
            "doc_id",
            F.coalesce("type", F.lit("HIGH_ENTROPY")).alias("category"),
            F.when(F.length("context") > 0, F.col("context")).otherwise("(redacted)").alias("original"),
            F.lit(None).cast("int").alias("start"),
            F.lit(None).cast("int").alias("end"),
            "placeholder",
            F.lit("model").alias("origin"),
        )
    )
    usable = parsed.select("doc_id").distinct().withColumn("_usable", F.lit(True))
    return (
        own.unionByName(model)
        .join(usable, "doc_id", "left")
        .withColumn("method", F.when(F.col("_usable"), METHOD_MODEL).otherwise(METHOD_REGEX))
        .drop("_usable")
    )


def merge_ranges(ranges: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Disjoint line ranges per document; starts below 1 are moved to 1."""
    from veilspark.operators.detect import resolve_overlaps

    clamped = ranges.select(
        *keys,
        F.greatest(F.col("start_line"), F.lit(1)).cast("int").alias("start"),
        (F.col("end_line") + 1).cast("int").alias("end"),
        F.lit("LINE").alias("category"),
        F.lit(0).alias("priority"),
    ).where(F.col("end") > F.col("start"))
    return resolve_overlaps(clamped, keys).select(
        *keys, F.col("start").alias("start_line"), (F.col("end") - 1).alias("end_line")
    )


def patch_lines(
    docs: DataFrame, ranges: DataFrame, reason: str, text: str = "text", marker: str = "[REDACTED by policy: {}]",
    roots: Sequence[str] | None = None,
) -> DataFrame:
    """Replace 1-based inclusive line ranges with a marker, keeping the original as a backup.

    Overlapping ranges are merged, so a line counts once.  Documents for which no
    patch was asked come back unchanged, with no backup.  With `roots`, path policy
    is asked first: a denied document stays as it is, and `patch_reason` says why.
    """
    if roots is not None:
        judged = path_policy(docs, roots)
        asked = ranges.select("doc_id").distinct().withColumn("_wanted", F.lit(True))
        denied = judged.where("path_verdict = 'deny'").join(asked, "doc_id", "left")
        closed = denied.select(
            *docs.columns, F.col(text).alias("patched_text"), F.lit(0).alias("lines_redacted"), F.lit(None).cast("string").alias("backup_text"),
            F.when(F.col("_wanted"), F.col("path_reason")).alias("patch_reason"))
        opened = judged.where("path_verdict <> 'deny'").select(*docs.columns)
        done = patch_lines(opened, ranges, reason, text, marker).withColumn("patch_reason", F.lit(None).cast("string"))
        return done.unionByName(closed)
    merged = merge_ranges(ranges).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("start_line", "end_line"))).alias("_ranges")
    )
    per_doc = ranges.select("doc_id").distinct().withColumn("_asked", F.lit(True)).join(merged, "doc_id", "left")
    shown = F.lit(marker.format(reason))
    lines = F.split(F.col(text), "\n", -1)

    def patched(all_lines: Column) -> Column:
        """Kept pieces and runs of markers, alternately; each range is cut once."""

        def before(r: Column, i: Column) -> Column:
            at = F.coalesce(F.get(F.col("_ranges"), i - 1).end_line, F.lit(0))
            return F.slice(
                all_lines, at + 1, F.greatest(F.least(r.start_line - 1, F.size(all_lines)) - at, F.lit(0))
            )

        def markers(r: Column) -> Column:
            return F.array_repeat(
                shown, F.greatest(F.least(r.end_line, F.size(all_lines)) - r.start_line + 1, F.lit(0))
            )

        inside = F.flatten(F.transform(F.col("_ranges"), lambda r, i: F.concat(before(r, i), markers(r))))
        last = F.get(F.col("_ranges"), F.size("_ranges") - 1).end_line
        rest = F.slice(all_lines, last + 1, F.greatest(F.size(all_lines) - last, F.lit(0)))
        return F.struct(
            F.array_join(F.concat(inside, rest), "\n").alias("text"),
            F.aggregate(
                F.col("_ranges"), F.lit(0), lambda acc, r: acc + F.size(markers(r))
            ).alias("lines"),
        )

    return (
        docs.join(per_doc, "doc_id", "left")
        .withColumn("_patched", F.when(F.col("_ranges").isNotNull(), let(lines, patched)))
        .withColumn("patched_text", F.coalesce("_patched.text", F.col(text)))
        .withColumn("lines_redacted", F.coalesce("_patched.lines", F.lit(0)))
        .withColumn("backup_text", F.when(F.col("_asked"), F.col(text)))
        .drop("_ranges", "_asked", "_patched")
    )
