"""Which snapshots are listed, which ones go."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.functions.globs import matches_all
from stratum.functions.ids import ranked


def between(snapshots: DataFrame, since: datetime | None = None, before: datetime | None = None) -> DataFrame:
    """created_utc from ``since`` on and before ``before``."""
    if since is not None:
        snapshots = snapshots.where(F.col("created_utc") >= F.lit(since))
    return snapshots if before is None else snapshots.where(F.col("created_utc") < F.lit(before))


def newest_first(snapshots: DataFrame) -> DataFrame:
    return snapshots.orderBy("space", F.desc("created_utc"), F.desc("snapshot_id"))


def history(snapshots: DataFrame, take: int | None = None, since: datetime | None = None, before: datetime | None = None, match: str | None = None, files: DataFrame | None = None) -> DataFrame:
    """Snapshots by filters, the newest ``take`` of each space after them; with ``files`` (space, snapshot_id, bytes), payload_bytes of those alone."""
    out = between(snapshots, since, before)
    if match:
        out = out.where(matches_all("snapshot_id", [match]))
    if take is not None and take >= 0:
        out = ranked(out).where(F.col("rank") < take).drop("rank")
    if files is not None:
        own = files.join(out.select("space", "snapshot_id"), ["space", "snapshot_id"], "left_semi")
        out = out.join(own.groupBy("space", "snapshot_id").agg(F.sum("bytes").alias("payload_bytes")), ["space", "snapshot_id"], "left")
    return out


def targets(snapshots: DataFrame, keep: int | None = None, latest: int | None = None, before: datetime | None = None, match: list[str] | None = None) -> DataFrame:
    """Snapshots that exactly one rule means: all but the newest ``keep``, the newest ``latest``, those before a time, or those whose id
    matches every glob. keep=0 means all, latest=0 none."""
    if sum(x is not None for x in (keep, latest, before, match)) != 1:
        raise ValueError("exactly one of keep, latest, before and match is needed")
    if keep is not None:
        return ranked(snapshots).where(F.col("rank") >= max(0, keep)).drop("rank")
    if latest is not None:
        return ranked(snapshots).where(F.col("rank") < latest).drop("rank")
    return between(snapshots, before=before) if before is not None else snapshots.where(matches_all("snapshot_id", match))


def incomplete(snapshots: DataFrame) -> DataFrame:
    """Snapshots without meta or note: a save that did not end."""
    return snapshots.where("snapshot_hash IS NULL OR note IS NULL")


def without_payload(snapshots: DataFrame) -> DataFrame:
    return snapshots.where(~F.col("has_payload"))


def remaining(manifests: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``manifests`` whose (space, snapshot_id) is not ``gone``."""
    return manifests.join(gone.select("space", "snapshot_id"), ["space", "snapshot_id"], "left_anti")
