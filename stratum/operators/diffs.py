"""Differences between inventories, and between texts."""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions.texts import is_binary, normalize_lines

KINDS = ("Added", "Removed", "Modified", "Unchanged")


def preferred(items: DataFrame, keys: list[str]) -> DataFrame:
    """One row a path of an inventory (keys, path, length, fingerprint, ordinal): one with a fingerprint, then the longest, then the last."""
    order = Window.partitionBy(*keys, "path").orderBy(F.col("fingerprint").isNotNull().desc(), F.desc("length"), F.desc("ordinal"))
    return items.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def diff(a: DataFrame, b: DataFrame, by_content: bool = False) -> DataFrame:
    """(kind, path_a, path_b) for all paths of two inventories (path, length, fingerprint).

    By length, or by fingerprint too where both have one; path_a is null for what was added, path_b for what was removed.
    """
    x = a.select(F.col("path").alias("path_a"), F.col("length").alias("la"), F.col("fingerprint").alias("fa"))
    y = b.select(F.col("path").alias("path_b"), F.col("length").alias("lb"), F.col("fingerprint").alias("fb"))
    changed = F.col("la") != F.col("lb")
    if by_content:
        changed = changed | F.coalesce(F.col("fa") != F.col("fb"), F.lit(False))
    kind = F.when(F.col("path_a").isNull(), "Added").when(F.col("path_b").isNull(), "Removed").when(changed, "Modified").otherwise("Unchanged")
    return x.join(y, F.col("path_a") == F.col("path_b"), "full_outer").select(kind.alias("kind"), "path_a", "path_b")


def ordered(changes: DataFrame) -> DataFrame:
    """By kind in the order of ``KINDS``, then by path."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return changes.orderBy(rank, F.coalesce("path_b", "path_a"))


def counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("kind").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Options:
    max_bytes: int = 2 << 20
    context: int = 3
    ignore_trim: bool = False


def records(a: str, b: str) -> list[tuple[str, str, int, int]]:
    """(mark, line, line number in a, in b): a side-by-side comparison read from top to bottom, changed lines in pairs."""
    x, y = a.split("\n"), b.split("\n")
    n = min(len(x), len(y))
    head = next((k for k in range(n) if x[k] != y[k]), n)  # most edits are small: only what lies between is matched
    tail = next((k for k in range(n - head) if x[-1 - k] != y[-1 - k]), n - head)
    u, v = len(x) - tail, len(y) - tail
    inner = difflib.SequenceMatcher(None, x[head:u], y[head:v], autojunk=False).get_opcodes()
    steps = [("equal", 0, head, 0, head), *((t, *(head + k for k in at)) for t, *at in inner), ("equal", u, len(x), v, len(y))]
    out, i, j = [], 1, 1
    for tag, i1, i2, j1, j2 in steps:
        for k in range(max(i2 - i1, j2 - j1)):
            if tag == "equal":
                out.append((" ", x[i1 + k], i, j))
                i, j = i + 1, j + 1
                continue
            at = (i, j)
            if i1 + k < i2:
                out.append(("-", x[i1 + k], *at))
                i += 1
            if j1 + k < j2:
                out.append(("+", y[j1 + k], *at))
                j += 1
    return out


def hunks(recs: list[tuple[str, str, int, int]], context: int) -> list[dict]:
    """Changes with up to ``context`` lines before and after; one ends where more unchanged lines than that follow its last change."""
    changed = [k for k, r in enumerate(recs) if r[0] != " "]
    out, free = [], 0
    while changed:
        last = changed[0]
        start, rest = max(free, last - context), []
        for n, k in enumerate(changed):
            if k - last > context + 1:
                rest = changed[n:]
                break
            last = k
        free = min(len(recs), last + context + 1)
        own = recs[start:free]
        out.append({"a_start": own[0][2], "a_count": sum(r[0] != "+" for r in own), "b_start": own[0][3], "b_count": sum(r[0] != "-" for r in own), "lines": [r[0] + r[1] for r in own]})
        changed = rest
    return out


def render(found: list[dict], path_a: str, path_b: str) -> str:
    out = [f"--- {path_a}", f"+++ {path_b}"]
    for h in found:
        out += [f"@@ -{h['a_start']},{h['a_count']} +{h['b_start']},{h['b_count']} @@", *h["lines"]]
    return "\n".join(out).rstrip()


def unified(a: str | None, b: str | None, path_a: str, path_b: str, context: int = 3) -> str:
    return render(hunks(records(a or "", b or ""), context), path_a, path_b)


def changed_runs(hunk: dict) -> Iterator[tuple[list[tuple[int, str]], list[tuple[int, str]]]]:
    """The hunk's runs of changed lines: (number, line) of those that went and of those that came."""
    at = {"-": hunk["a_start"], "+": hunk["b_start"]}
    for same, run in groupby(hunk["lines"], key=lambda x: x[0] == " "):
        sides: dict[str, list[tuple[int, str]]] = {"-": [], "+": []}
        for line in run:
            for mark in "-+" if same else line[0]:
                sides[mark].append((at[mark], line[1:]))
                at[mark] += 1
        if not same:
            yield sides["-"], sides["+"]


def marks(old: str, new: str) -> str:
    """Carets below the part of a line that is not common to both at either end, at least one."""
    n = min(len(old), len(new))
    head = next((k for k in range(n) if old[k] != new[k]), n)
    tail = next((k for k in range(n - head) if old[-1 - k] != new[-1 - k]), n - head)
    return " " * head + "^" * max(1, len(new or old) - head - tail)


def carets(hunks: list[dict]) -> list[str]:
    """Hunks shown line by line: the old and the new line, each under its number, and marks below what differs."""
    out = []
    for went, came in (run for h in hunks for run in changed_runs(h)):
        for old, new in zip_longest(went, came):
            (na, a), (nb, b) = old or (new[0], ""), new or (old[0], "")
            out += [f"L{na}-", a, f"L{nb}+", b, marks(a, b)]
    return out


def text_diff(changes: DataFrame, contents_a: DataFrame, contents_b: DataFrame, options: Options = Options(), include: str | None = None, exclude: str | None = None) -> DataFrame:
    """(kind, path_a, path_b, unified, hunks, added, removed) for changed text files, in the order of path_b.

    contents: (path, content). Files above ``max_bytes``, binary ones and those without content are left out. include and
    exclude are expressions for either path. A side that is missing counts as empty and its path as the empty string.
    """
    wanted = changes.where(F.col("kind").isin("Modified", "Renamed", "Added", "Removed"))
    paths = [F.coalesce(c, F.lit("")) for c in ("path_a", "path_b")]
    if include:
        wanted = wanted.where(paths[0].rlike(include) | paths[1].rlike(include))
    if exclude:
        wanted = wanted.where(~(paths[0].rlike(exclude) | paths[1].rlike(exclude)))

    def loaded(df: DataFrame, side: str) -> DataFrame:
        ok = (F.octet_length("content") <= options.max_bytes) & ~is_binary("content")
        text = normalize_lines(F.decode(F.col("content"), "UTF-8"), options.ignore_trim)
        return df.where(ok).select(F.col("path").alias(f"path_{side}"), F.regexp_replace(text, "^﻿", "").alias(f"text_{side}"))

    both = wanted.join(loaded(contents_a, "a"), "path_a", "left").join(loaded(contents_b, "b"), "path_b", "left")
    both = both.where((F.col("path_a").isNull() | F.col("text_a").isNotNull()) & (F.col("path_b").isNull() | F.col("text_b").isNotNull()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                found = hunks(records(r.pop("text_a") or "", r.pop("text_b") or ""), options.context)
                r["hunks"], r["unified"] = found, render(found, r["path_a"] or "", r["path_b"] or "")
                r["added"] = sum(x[0] == "+" for h in found for x in h["lines"])
                r["removed"] = sum(x[0] == "-" for h in found for x in h["lines"])
            yield pa.RecordBatch.from_pylist(rows, OUT)

    one = pa.struct([("a_start", pa.int32()), ("a_count", pa.int32()), ("b_start", pa.int32()), ("b_count", pa.int32()), ("lines", pa.list_(pa.string()))])
    OUT = pa.schema([("kind", pa.string()), ("path_a", pa.string()), ("path_b", pa.string()), ("unified", pa.string()), ("hunks", pa.list_(one)), ("added", pa.int64()), ("removed", pa.int64())])
    schema = "kind string, path_a string, path_b string, unified string, hunks array<struct<a_start:int,a_count:int,b_start:int,b_count:int,lines:array<string>>>, added long, removed long"
    return both.select("kind", "path_a", "path_b", "text_a", "text_b").mapInArrow(compare, schema).orderBy(F.coalesce("path_b", F.lit("")), "path_a")
