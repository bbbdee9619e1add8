"""Snapshot ids: making them, reading their time, and the ways to point at one."""

from __future__ import annotations

import re
import secrets
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE_NAME = "^[a-z][a-z0-9_-]{0,63}$"


def uuid7(now: datetime, random: Callable[[int], bytes] = secrets.token_bytes) -> str:
    """48 bits of milliseconds, version 7, 12 random bits, variant 10, 62 random bits."""
    r = int.from_bytes(random(10), "big")
    n = (int(now.timestamp() * 1000) & (1 << 48) - 1) << 80 | 7 << 76 | (r >> 62 & 0xFFF) << 64 | 2 << 62 | r & (1 << 62) - 1
    h = f"{n:032x}"
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def new_id(clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc), random: Callable[[int], bytes] = secrets.token_bytes) -> str:
    now = clock().astimezone(timezone.utc)
    return f"{now:%Y%m%dT%H%M%SZ}_{uuid7(now, random)}"


def created_utc(snapshot_id: Column | str, folder_time: Column) -> Column:
    """The time in the id: its first 16 characters if there are at least 17, else the date after the first underscore, else ``folder_time``."""
    c = F.col(snapshot_id) if isinstance(snapshot_id, str) else snapshot_id
    stamped = F.when((F.length(c) >= 17) & F.substring(c, 1, 16).rlike(r"^\d{8}T\d{6}Z$"), F.try_to_timestamp(F.substring(c, 1, 15), F.lit("yyyyMMdd'T'HHmmss")))
    tail = F.regexp_extract(c, r"^[^_]*_(\d{8})$", 1)
    dated = F.when(tail != "", F.try_to_timestamp(tail, F.lit("yyyyMMdd")))
    return F.coalesce(stamped, dated, folder_time)


def parse_time(text: str) -> datetime:
    """A date or time, UTC unless it says otherwise."""
    t = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    return t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t.astimezone(timezone.utc)


def local_midnight(text: str, zone) -> datetime:
    """A local date's midnight as UTC."""
    return datetime.fromisoformat(text).replace(tzinfo=zone).astimezone(timezone.utc)


def ago(text: str, now: datetime) -> datetime:
    """``now`` less an age like 30d, 2w, 3mo or 1y; months and years by the calendar, to the month's last day at most."""
    m = re.fullmatch(r"(\d+)(d|w|mo|y)", text.strip().lower())
    if not m:
        raise ValueError(f"not an age: {text}")
    n, unit = int(m[1]), m[2]
    if unit in "dw":
        return now - timedelta(days=n * (7 if unit == "w" else 1))
    month = now.year * 12 + now.month - 1 - n * (12 if unit == "y" else 1)
    year, month = divmod(month, 12)
    last = (datetime(year + month // 11, (month + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return now.replace(year=year, month=month + 1, day=min(now.day, last))


@dataclass(frozen=True)
class Dialect:
    """How a command points at snapshots.

    base: the index of the newest. by_id: newest by id, not by time. ci: prefixes ignore case. exact_first: an id that is
    equal wins over prefixes. first_hit: the first of several prefixes' hits wins, else they are an error. skip: ids that
    are too short or hidden don't count.
    """

    base: int = 0
    by_id: bool = False
    ci: bool = True
    exact_first: bool = False
    first_hit: bool = False
    skip: bool = False
    prefix: bool = True


#: The documented dialect is ``default``; the others keep what single commands do.
DIALECTS = {
    "default": Dialect(exact_first=True),
    "restore": Dialect(),
    "recompose": Dialect(exact_first=True),
    "hydrate": Dialect(),
    "export": Dialect(by_id=True, ci=False),
    "diff": Dialect(by_id=True, prefix=False),
    "verify": Dialect(base=1, by_id=True, ci=False),
    "textdiff": Dialect(base=-1, by_id=True, ci=False, skip=True),
    "pick": Dialect(by_id=True),
    "note": Dialect(by_id=True, first_hit=True),
}


def ranked(snapshots: DataFrame, by_id: bool = False) -> DataFrame:
    """``snapshots`` with ``rank``, 0 for the newest of its space; equal times are ordered by id."""
    order = [F.desc("snapshot_id")] if by_id else [F.desc("created_utc"), F.desc("snapshot_id")]
    return snapshots.withColumn("rank", F.row_number().over(Window.partitionBy("space").orderBy(*order)) - 1)


def at_index(snapshots: DataFrame, index: int, dialect: str = "default") -> DataFrame:
    """The snapshot of each space that ``@index`` means; none if there are fewer."""
    d = DIALECTS[dialect]
    if d.skip:
        snapshots = snapshots.where((F.length("snapshot_id") >= 8) & ~F.col("snapshot_id").startswith("."))
    return ranked(snapshots, d.by_id).where(F.col("rank") == index - d.base).drop("rank")


def prefix_hits(snapshots: DataFrame, prefix: str, dialect: str = "default") -> DataFrame:
    """Per space: hits, the one that is meant if there is one, and up to five for an error's text."""
    d = DIALECTS[dialect]
    name, want = (F.lower("snapshot_id"), prefix.lower()) if d.ci else (F.col("snapshot_id"), prefix)
    hit = snapshots.where(name.startswith(want)).withColumn("exact", name == want)
    ids = F.array_sort(F.collect_list("snapshot_id"))
    out = hit.groupBy("space").agg(F.count("*").alias("hits"), F.max(F.when(F.col("exact"), F.col("snapshot_id"))).alias("exact"), F.max("snapshot_id").alias("newest"), F.slice(ids, 1, 5).alias("shown"))
    only = F.when(F.col("hits") == 1, F.col("newest"))
    if d.first_hit:
        only = F.col("newest")
    meant = F.coalesce("exact", only) if d.exact_first else only
    return out.select("space", "hits", meant.alias("snapshot_id"), "shown")


def resolve(snapshots: DataFrame, selector: str, dialect: str = "default") -> str:
    """The id that ``selector`` (``@N`` or a prefix) means in one space's ``snapshots``; an error if none or several."""
    if m := re.fullmatch(r"@(\d+)", selector.strip()):
        found = at_index(snapshots, int(m[1]), dialect).select("snapshot_id").collect()
        if not found:
            raise LookupError(f"no snapshot at {selector}")
        return found[0][0]
    if not DIALECTS[dialect].prefix:
        raise ValueError(f"only @N is understood here, not {selector}")
    row = prefix_hits(snapshots, selector.strip(), dialect).first()
    if row is None:
        raise LookupError(f"no snapshot begins with {selector}")
    if row["snapshot_id"] is None:
        raise LookupError(f"{row['hits']} snapshots begin with {selector}: {', '.join(row['shown'])}")
    return row["snapshot_id"]


#: What a word that may be a space or an id is an id by: its beginning, or an underscore anywhere.
LIKE_ID = "^[@0-9]|_"


def looks_like_id(text: Column | str) -> Column:
    return (F.col(text) if isinstance(text, str) else text).rlike(LIKE_ID)


def space_and_selector(words: list[str], space: str | None = None) -> tuple[str | None, str | None]:
    """(space, selector) of ``[space] [id]``, either of which may be missing."""
    own = list(words)
    if own and not re.search(LIKE_ID, own[0]):
        space = own.pop(0)
        if not re.match(SPACE_NAME, space):
            raise ValueError(f"not a name for a space: {space}")
    if len(own) > 1:
        raise ValueError("too many words")
    return space, own[0] if own else None


def source_spec(text: str, space: str) -> tuple[str, str]:
    """(space, selector) of ``[space:]selector``."""
    before, mark, after = text.partition(":")
    return (before.strip(), after.strip()) if mark else (space, text.strip())


def effective_space(given: str | None = None, environment: str | None = None, pointer: str | None = None, configured: str | None = None) -> str:
    """The first that is set, else ``main``."""
    return next((x.strip() for x in (given, environment, pointer, configured) if x and x.strip()), "main")
