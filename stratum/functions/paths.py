"""Paths as strings of segments divided by a slash."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize(path: Column | str) -> Column:
    """Backslashes become slashes, leading slashes go."""
    return F.regexp_replace(F.translate(col(path), "\\", "/"), "^/+", "")


def segments(path: Column | str) -> Column:
    """Parts between slashes of either kind, empty ones left out."""
    return F.filter(F.split(F.translate(col(path), "\\", "/"), "/"), lambda x: x != "")


def ancestors(path: Column | str) -> Column:
    """All parent folders from the outermost in; none for a file at the root."""
    parts = segments(path)
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.when(F.size(parts) > 1, up).otherwise(F.array().cast("array<string>"))


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def stem(path: Column | str) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def parent(path: Column | str) -> Column:
    return F.regexp_replace(col(path), r"/?[^/]*$", "")


def store_path(digest: Column | str, depth: int = 2) -> Column:
    """Folders of two digits each, ``depth`` of them, and the digest as file name."""
    if not 0 <= depth <= 16:
        raise ValueError("depth must be within 0 and 16")
    parts = [F.substring(col(digest), 2 * i + 1, 2) for i in range(depth)]
    return F.concat_ws("/", *parts, F.concat(col(digest), F.lit(".zst")))


@F.pandas_udf(StringType())
def nfc(path: pd.Series) -> pd.Series:
    return path.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def canonical(path: Column | str, snapshot_id: Column | str) -> Column:
    """A path as inventories write it, made comparable: slashes one way, trimmed, without one leading slash, the part up to the
    snapshot's own folder and a leading payload folder, in normal form C."""
    p = F.regexp_replace(F.trim(F.translate(col(path), "\\", "/")), r"^/", "")
    mark = F.concat(F.lit("/"), F.lower(col(snapshot_id)), F.lit("/"))
    at = F.position(mark, F.lower(F.concat(F.lit("/"), p)))  # the folder may come first
    p = F.when(at > 0, F.substr(F.concat(F.lit("/"), p), at + F.length(mark))).otherwise(p)
    return nfc(F.regexp_replace(p, r"(?i)^snapshots/", ""))


def safe(path: Column | str) -> Column:
    """Whether the path stays below the root it is joined to."""
    p = F.translate(col(path), "\\", "/")
    return ~p.startswith("/") & ~F.array_contains(F.split(p, "/"), "..") & ~p.rlike("^[A-Za-z]:") & (p != "")


def ancestor_rows(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, dir) of all folders above the files, each once."""
    return files.select(*keys, F.explode(ancestors("path")).alias("dir")).distinct()
