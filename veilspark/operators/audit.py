"""Audit rows of the tools besides the read flow, in the columns of the audit log."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.operators.policy import path_policy
from veilspark.sources.corpus import AUDIT_SCHEMA


def audit_rows(rows: DataFrame, event: str, **given: Column) -> DataFrame:
    """One audit row per row; fields that are not given are null, the time is now."""
    values = {"timestamp": F.current_timestamp(), "event": F.lit(event), **given}
    return rows.select(*[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in AUDIT_SCHEMA.fields])


def denied_rows(files: DataFrame, roots: Sequence[str], event: str) -> DataFrame:
    """Audit rows of the files that path policy keeps from a tool."""
    denied = path_policy(files.select("path"), roots).where("path_verdict = 'deny'")
    return audit_rows(denied, event, path=F.col("path"), action=F.lit("deny_path"), reason=F.col("path_reason"))


def search_audit(files: DataFrame, found: DataFrame, roots: Sequence[str]) -> DataFrame:
    """A row per file with matches, their number as the count, and a row per denied file."""
    per_file = found.groupBy("path").agg(F.max("file_matches").alias("n"))
    hits = audit_rows(per_file, "search", path=F.col("path"), action=F.lit("search"), redaction_count=F.col("n"))
    return hits.unionByName(denied_rows(files, roots, "search"))


def patch_audit(patched: DataFrame) -> DataFrame:
    """A row per document a patch was asked for: its redacted lines, or why policy kept it from being patched."""
    denied = F.col("patch_reason").isNotNull() if "patch_reason" in patched.columns else F.lit(False)
    reason = F.col("patch_reason") if "patch_reason" in patched.columns else F.lit(None)
    asked = patched.where(F.col("backup_text").isNotNull() | denied)
    return audit_rows(
        asked, "patch", path=F.col("path"), action=F.when(denied, "deny_path").otherwise("patch"), reason=reason,
        redaction_count=F.col("lines_redacted"))


def gate_audit(gated: DataFrame) -> DataFrame:
    """A row per tool call that the gate stopped."""
    return audit_rows(
        gated.where("action <> 'allow'"), "tool_call", tool_name=F.col("tool_name"), action=F.col("action"), reason=F.col("reason"))
