"""Path, payload and tool-call policies as column predicates."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import patterns as P
from veilspark.functions.globs import glob_regex, normal_path

# --- fixed values ---------------------------------------------------------
DENY_GLOBS = (
    "**/.env",
    "**/.env.*",
    "**/id_rsa*",
    "**/id_ed25519*",
    "**/*.pem",
    "**/*.p12",
    "**/*.pfx",
    "**/keychain/**",
    "**/Keychain/**",
    "**/Library/Application Support/Google/Chrome/**",
    "**/Library/Application Support/Firefox/**",
    "**/.ssh/**",
)
SANITIZE_GLOBS = (
    "**/*.pdf",
    "**/*.docx",
    "**/*.doc",
    "**/docs/**",
    "**/downloads/**",
    "**/Downloads/**",
)
REASON_DENY = "Path matches deny glob: {}"
REASON_ROOT = "Path not under any allowed root"
REASON_ALWAYS = "Matches sanitize-always glob: {}"
REASON_DEFAULT = "Default policy: sanitize all reads"
READ_TOOLS = (
    "fs.read", "fs.search", "fs.list", "fs.glob", "fs.stat", "fs.read_binary",
    "read", "glob", "grep", "ls", "find",
    "readfile", "file_read", "cat", "head", "tail",
)
EGRESS_TOOLS = (
    "http", "curl", "fetch", "exec", "shell", "bash", "web_search", "browser",
    "http_request", "message", "send", "post", "get",
)
# ----------------------------------------------------------------------------
READ_REASON = "Native file access is closed; use the sanitized tables instead"


def path_reason(
    path: Column,
    roots: Sequence[str],
    deny: Sequence[str] = DENY_GLOBS,
    always: Sequence[str] = SANITIZE_GLOBS,
) -> Column:
    """Reason of the first rule that applies to an already normalised path.

    The rules are few and known when the plan is made, so they become one chain
    of literal patterns, which stops at the first hit and is pushed to the scan
    side of the plan; no rule table has to be joined.
    """
    under_root = F.lit(False)
    for root in roots:
        clean = "/" + root.strip("/")
        below = "/" if clean == "/" else clean + "/"
        under_root = under_root | (path == clean) | F.startswith(path, F.lit(below))
    rules = [(F.rlike(path, F.lit(glob_regex(g))), REASON_DENY.format(g)) for g in deny]
    rules.append((~under_root, REASON_ROOT))
    rules += [(F.rlike(path, F.lit(glob_regex(g))), REASON_ALWAYS.format(g)) for g in always]
    chain = F.when(rules[0][0], F.lit(rules[0][1]))
    for test, reason in rules[1:]:
        chain = chain.when(test, F.lit(reason))
    return chain.otherwise(F.lit(REASON_DEFAULT))


def path_policy(
    files: DataFrame,
    roots: Sequence[str],
    deny: Sequence[str] = DENY_GLOBS,
    always: Sequence[str] = SANITIZE_GLOBS,
) -> DataFrame:
    """Adds `path_verdict` (deny or sanitize) and `path_reason`."""
    denied = F.startswith(F.col("path_reason"), F.lit(REASON_DENY.format(""))) | (
        F.col("path_reason") == REASON_ROOT
    )
    return (
        files.withColumn("_path", normal_path(F.col("path")))
        .withColumn("path_reason", path_reason(F.col("_path"), roots, deny, always))
        .withColumn("path_verdict", F.when(denied, "deny").otherwise("sanitize"))
        .drop("_path")
    )


def egress_reason(payload: Column) -> Column:
    """Why a payload must not leave; null if it may."""
    return F.when(
        F.rlike(payload, F.lit(P.spark_pattern(P.PLACEHOLDER))), F.lit(P.EGRESS_PLACEHOLDER_REASON)
    ).when(F.rlike(payload, F.lit(P.spark_pattern(P.EGRESS_SECRET))), F.lit(P.EGRESS_SECRET_REASON))


def egress_scan(messages: DataFrame, payload: str = "payload") -> DataFrame:
    """The messages that must not leave, with the reason.  Works on streams too."""
    return messages.withColumn("reason", egress_reason(F.col(payload))).where(F.col("reason").isNotNull())


def tool_gate(calls: DataFrame, tool: str = "tool_name", params: str = "params") -> DataFrame:
    """Adds `action` (block, egress_blocked, allow) and `reason` to a tool-call log.

    `params` is a JSON string or any struct, which is rendered as JSON.
    """
    kind = dict(calls.dtypes)[params]
    payload = F.col(params) if kind == "string" else F.to_json(F.col(params))
    name = F.lower(F.col(tool))
    reads = name.isin(*READ_TOOLS)
    leak = F.when(name.isin(*EGRESS_TOOLS), egress_reason(payload))
    return (
        calls.withColumn("_leak", F.when(~reads, leak))
        .withColumn(
            "action",
            F.when(reads, "block").when(F.col("_leak").isNotNull(), "egress_blocked").otherwise("allow"),
        )
        .withColumn("reason", F.when(reads, F.lit(READ_REASON)).otherwise(F.col("_leak")))
        .drop("_leak")
    )
