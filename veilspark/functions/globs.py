"""Path expressions: globs, roots, extensions, keys."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """Anchored regex for a path glob, valid in both JVM and RE2 engines.

    `**/` spans any number of folders, a final `**` anything below, `*` and `?`
    stay within one name.  Dot files match.  A glob without a slash is tested
    against the last name of the path.
    """
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".+")
            i += 2
        else:
            char = glob[i]
            out.append({"*": "[^/]*", "?": "[^/]"}.get(char) or re.escape(char))
            i += 1
    body = "".join(out)
    return f"^(?:.*/)?{body}$" if "/" not in glob else f"^{body}$"


def normal_path(path: Column) -> Column:
    """Absolute path with `.`, `..` and double slashes worked out."""
    stack = F.aggregate(
        F.split(path, "/", -1),
        F.array().cast("array<string>"),
        lambda acc, part: F.when(part.isin("", "."), acc)
        .when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(part))),
    )
    plain = F.rlike(path, F.lit(r"^(?:/[^/.][^/]*|/\.[^/.][^/]*|/\.\.[^/]+)+$"))
    return F.when(plain, path).otherwise(F.concat(F.lit("/"), F.array_join(stack, "/")))


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; "" for none, also for names such as `.env`."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^/.]*)$", 1))


def cache_key(path: Column, mtime: Column, size: Column, namespace: str = "") -> Column:
    """sha256 of "path|mtime|size", optionally in its own namespace."""
    raw = F.concat_ws("|", path, mtime.cast("string"), size.cast("string"))
    return F.sha2(F.concat(F.lit(namespace), raw), 256)
