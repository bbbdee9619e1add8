"""Trees of files: merges in which the first source wins, overlays, and roll-ups over folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions.paths import ancestor_rows, ancestors, base_name, parent


def conflicts(files: DataFrame) -> DataFrame:
    """Files (priority, path) that some later source has as a folder: such a merge fails. (path, priority, folder_priority)"""
    folders = ancestor_rows(files, ["priority"]).select(F.col("dir").alias("path"), F.col("priority").alias("folder_priority"))
    return files.select("path", "priority").join(folders, "path").where("folder_priority > priority")


def without_blocked(files: DataFrame) -> DataFrame:
    """Files that an earlier source, or the same, doesn't have as a folder."""
    folders = ancestor_rows(files, ["priority"]).groupBy("dir").agg(F.min("priority").alias("since"))
    return files.join(folders, (F.col("path") == F.col("dir")) & (F.col("since") <= F.col("priority")), "left_anti")


def left_wins(files: DataFrame, keep_out: str = ".stratum") -> DataFrame:
    """The union of several trees, the row of the least ``priority`` for each path; the engine's own folder is left out."""
    own = F.lower(F.split("path", "/")[0]) == keep_out
    first = Window.partitionBy("path").orderBy("priority")
    return without_blocked(files.where(~own)).withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


def recompose(files: DataFrame) -> DataFrame:
    """``left_wins``; an error if a file of an earlier source is a folder of a later one."""
    bad = conflicts(files).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['path']} is a file in source {bad[0]['priority']} and a folder in {bad[0]['folder_priority']}")
    return left_wins(files)


def overlay(snapshot: DataFrame, destination: DataFrame) -> DataFrame:
    """The destination after a restore over it: the snapshot's files, the destination's others, and what must make way.

    Both (path, ...). state: restored, kept, or moved (a file where the snapshot has a folder, or in a folder where it has a file).
    """
    names = [c for c in snapshot.columns if c != "path"]
    folders = snapshot.select(F.explode(ancestors("path")).alias("path")).distinct()
    others = destination.join(snapshot.select("path"), "path", "left_anti")
    blocked = others.join(folders, "path", "left_semi").select("path")
    inside = others.select("path", F.explode(ancestors("path")).alias("dir")).join(snapshot.select(F.col("path").alias("dir")), "dir", "left_semi").select("path")
    moved = blocked.union(inside).distinct().withColumn("moves", F.lit(True))
    state = F.when(F.col("moves"), "moved").otherwise("kept")
    rest = others.join(moved, "path", "left").select("path", *names, state.alias("state"))
    return snapshot.select("path", *names, F.lit("restored").alias("state")).unionByName(rest)


def replaced(snapshot: DataFrame, destination: DataFrame, keep_out: str = ".stratum") -> DataFrame:
    """The destination after a restore in its place: the snapshot, and the engine's own folder."""
    own = destination.where(F.lower(F.split("path", "/")[0]) == keep_out).withColumn("state", F.lit("kept"))
    return snapshot.withColumn("state", F.lit("restored")).unionByName(own)


def tree(files: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """(path, parent, name, depth, is_dir, bytes, files): every file and folder with the bytes and files below it.

    Folders without files come from ``folders`` (path). The root is the empty path.
    """
    up = files.select(F.explode(F.concat(F.array(F.lit("")), ancestors("path"))).alias("path"), "bytes", F.lit(1).alias("one"))
    if folders is not None:
        more = F.concat(ancestors("path"), F.array("path"))
        up = up.union(folders.select(F.explode(more).alias("path"), F.lit(0), F.lit(0)))
    dirs = up.groupBy("path").agg(F.sum("bytes").cast("long").alias("bytes"), F.sum("one").cast("long").alias("files")).withColumn("is_dir", F.lit(True))
    rows = dirs.unionByName(files.select("path", F.col("bytes").cast("long").alias("bytes"), F.lit(1).cast("long").alias("files"), F.lit(False).alias("is_dir")))
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    return rows.select("path", parent("path").alias("parent"), base_name("path").alias("name"), depth.alias("depth"), "is_dir", "bytes", "files")


def tree_order(nodes: DataFrame) -> DataFrame:
    """Within a folder its folders first, then by name without regard to case."""
    return nodes.orderBy("parent", F.desc("is_dir"), F.lower("name"), "name")
