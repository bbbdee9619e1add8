"""Stored against computed: the status of each snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("OK", "MISMATCH", "META-NOT-FOUND", "PAYLOAD-MISSING", "SKIP-MISSING", "HYDRATE-FAIL", "TEMP-HYDRATE-FAIL", "ERROR")
POLICIES = ("error", "skip", "hydrate", "temp")


def statuses(meta: DataFrame, computed: DataFrame, policy: str = "error") -> DataFrame:
    """(space, snapshot_id, status, hydrated) from meta (space, snapshot_id, has_payload, meta_v, hash_alg, snapshot_hash, file_count,
    total_bytes) and computed (space, snapshot_id, hash, files, bytes), which holds what could be read or rebuilt.

    Meta of another version or algorithm is an ERROR. Without a payload the policy decides: error says PAYLOAD-MISSING, skip
    SKIP-MISSING; hydrate and temp compare the rebuilt files, and a mismatch under temp is TEMP-HYDRATE-FAIL.
    """
    if policy not in POLICIES:
        raise ValueError(f"not a policy: {policy}")
    both = meta.join(computed, ["space", "snapshot_id"], "left")
    equal = (F.lower("snapshot_hash") == F.lower("hash")) & (F.col("file_count") == F.col("files")) & (F.col("total_bytes") == F.col("bytes"))
    rebuilt = ~F.col("has_payload") & F.lit(policy in ("hydrate", "temp"))
    fails = F.lit("TEMP-HYDRATE-FAIL" if policy == "temp" else "HYDRATE-FAIL")
    status = (
        F.when(F.col("snapshot_hash").isNull(), "META-NOT-FOUND")
        .when((F.col("meta_v") != 1) | (F.lower("hash_alg") != "sha256"), "ERROR")
        .when(~F.col("has_payload") & ~F.lit(policy in ("hydrate", "temp")), "SKIP-MISSING" if policy == "skip" else "PAYLOAD-MISSING")
        .when(F.col("hash").isNull(), F.when(rebuilt, fails).otherwise("ERROR"))
        .when(equal, "OK")
        .otherwise(F.when(rebuilt & F.lit(policy == "temp"), fails).otherwise("MISMATCH"))
    )
    return both.select("space", "snapshot_id", status.alias("status"), rebuilt.alias("hydrated"))


def counters(found: DataFrame) -> DataFrame:
    """One row: total, then how often each outcome; ok counts snapshots that had their payload, hydrated_ok those rebuilt first."""
    is_ = F.col("status")
    ok = is_ == "OK"
    cells = [F.count("*").alias("total"), F.count_if(ok & ~F.col("hydrated")).alias("ok"), F.count_if(ok & F.col("hydrated")).alias("hydrated_ok")]
    cells += [F.count_if(is_ == s).alias(s.lower().replace("-", "_")) for s in STATUSES[1:]]
    return found.agg(*cells)
