"""Sharding by balanced label propagation: equal texts come together, shards stay even.

Documents with equal texts are linked. Every document starts in the shard that its id hashes to; then,
round after round, linked documents move to the shard where most of their group already is, as far as
that shard's quota allows: with some slack until nothing gets better, then, what exceeds a quota moved on
group by group, without slack until nothing gets better. Members of a group in one shard are alike, so the
graph is held as (group, shard, members) and joined with the shards' room and quotas, round after round; one
group with a third of all documents is then at most as many rows as there are shards. Documents without a
link fill up whatever is left, which makes the law exact: ``rows``, counts at most one apart.
Only DataFrame operations are used.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.llm.common import cut, numbered

#: Documents ranked together in one task; larger groups are ranked in pieces with offsets.
PIECE = 500
#: A group with more than this part of all documents, or PIECE of them, is joined by a broadcast, so at most as many groups are.
HOT = 10_000
#: Rounds without a better cut after which it counts as no longer falling.
PATIENCE = 4


def by_shard(df: DataFrame, shard: str, shards: int) -> list[int]:
    """Members in all, by shard; one row reaches the driver."""
    row = df.agg(*(F.sum(F.when(F.col(shard) == s, F.col("n"))).alias(str(s)) for s in range(shards))).first()
    return [x or 0 for x in row]


def propagate(held: DataFrame, shards: int, quota: int, most: int, rounds: int) -> DataFrame:
    """(grp, shard, n) after the moves; ``held`` is the same before them. Shards take up to ``most`` members.

    A round deals the rows by group once. Members move to the shard that has most of their group among those with
    room (a group too large for one shard has as many such homes as it needs), in proportion to the room if more ask than there is; a small group's members in a shard move all or none.
    It ends when no group asks, or when neither the members away from their group's main shard nor the places that groups are in get fewer; ``rounds`` is a bound that warns.
    """
    spark, mine = held.sparkSession, Window.partitionBy("grp")
    best, least, lows, still = held, None, [], 0
    for k in range(rounds):
        loads = by_shard(held, "shard", shards)
        free = F.broadcast(spark.createDataFrame([(s, max(0, most - n)) for s, n in enumerate(loads)], "shard int, free long"))  # a row a shard
        own = held.repartition("grp").groupBy("grp", "shard").agg(F.sum("n").alias("n")).join(free, "shard")
        rank = F.struct("n", F.xxhash64("grp", "shard").alias("tie"), "shard")
        open_ = F.when(F.col("free") > 0, F.col("rank"))
        wants = own.withColumn("rank", rank).withColumn("homes", F.sort_array(F.collect_list(open_).over(mine), asc=False))  # a row a shard at most
        needed = F.ceil(F.sum(F.when(F.col("free") > 0, F.col("n"))).over(mine) / max(1, quota)).cast("int")
        wants = wants.withColumn("homes", F.slice("homes", 1, F.greatest(F.lit(1), F.coalesce(needed, F.lit(1)))))
        wants = wants.withColumn("away", F.when(F.col("rank") < F.max("rank").over(mine), F.col("n")).otherwise(0))
        goes = (F.size("homes") > 0) & (F.col("rank") < F.element_at("homes", -1))
        home = F.get("homes", F.pmod(F.xxhash64("grp", "shard", F.lit(k)), F.size("homes")).cast("int"))
        wants = cut(wants.select("grp", "shard", "n", "away", F.when(goes, home["shard"]).alias("to")))
        asked = by_shard(wants, "to", shards)
        held = wants.select("grp", "shard", "n")
        now = [x or 0 for x in wants.agg(F.sum("away"), F.count("*")).first()]
        if least is None or now < least:
            best = held
        still = 0 if least is None or any(x < y for x, y in zip(now, lows, strict=True)) else still + 1
        lows = now if least is None else [min(x, y) for x, y in zip(now, lows, strict=True)]
        least = now if least is None else min(now, least)
        if not any(asked) or still >= PATIENCE:
            break
        parts = [(s, min(1.0, max(0, most - n) / a)) for s, (n, a) in enumerate(zip(loads, asked, strict=True)) if a]
        luck = F.pmod(F.xxhash64("grp", F.lit(k)), F.lit(1 << 20)) / (1 << 20)
        moved = F.when(F.col("n") > max(1, quota // 50), F.floor(F.col("n") * F.col("part"))).when(luck < F.col("part"), F.col("n"))
        moves = wants.join(F.broadcast(spark.createDataFrame(parts, "to int, part double")), "to", "left").withColumn("moved", F.coalesce(moved, F.lit(0)).cast("long"))
        both = F.array(F.struct("shard", (F.col("n") - F.col("moved")).alias("n")), F.struct(F.coalesce("to", "shard").alias("shard"), F.col("moved").alias("n")))
        held = moves.select("grp", F.inline(both)).where("n > 0")
    else:
        warnings.warn(f"sharding: groups still ask to move after {rounds} rounds", stacklevel=2)
    return best


def settle(held: DataFrame, quotas: list[int]) -> DataFrame:
    """``held`` with no shard beyond its quota: the smallest groups' rows go on, whole but where a shard or the room in one ends."""
    loads = by_shard(held, "shard", len(quotas))
    if all(n <= q for n, q in zip(loads, quotas, strict=True)):
        return held
    before, over, rooms, room = 0, [], [], 0
    for n, q in zip(loads, quotas, strict=True):
        over.append(before)
        before += max(0, n - q)
        rooms.append((room, room := room + max(0, q - n)))
    pieces = max(1, -(-held.count() // (len(quotas) * PIECE)))
    rows = cut(held.withColumn("piece", (F.lit(64) - F.floor(F.log2("n")).cast("int")) * pieces + F.pmod(F.xxhash64("grp"), F.lit(pieces)).cast("int")))  # large groups first
    sums = rows.groupBy("shard", "piece").agg(F.sum("n").alias("total"))
    sums = sums.select("shard", "piece", F.coalesce(F.sum("total").over(Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    upto = F.sum("n").over(Window.partitionBy("shard", "piece").orderBy(F.desc("n"), "grp").rowsBetween(Window.unboundedPreceding, 0))
    pick = lambda values: F.element_at(F.array(*(F.lit(int(v)) for v in values)), F.col("shard") + 1)
    ends = rows.withColumn("upto", upto).join(sums, ["shard", "piece"]).withColumn("beyond", F.col("start") + F.col("upto") - pick(quotas))
    ends = ends.withColumn("out", F.greatest(F.lit(0), F.least("n", "beyond"))).withColumn("last", pick(over) + F.col("beyond")).withColumn("at", F.col("last") - F.col("out"))
    there = [F.struct(F.lit(s).alias("shard"), (F.least("last", F.lit(b)) - F.greatest("at", F.lit(a))).cast("long").alias("n")) for s, (a, b) in enumerate(rooms) if b > a]
    moved = F.when(F.col("out") > 0, F.filter(F.array(*there), lambda x: x["n"] > 0)).otherwise(F.array().cast("array<struct<shard:int,n:bigint>>"))
    stays = F.array(F.struct(F.col("shard"), (F.col("n") - F.col("out")).alias("n")))
    return cut(ends.select("grp", F.inline(F.concat(stays, moved))).where("n > 0").groupBy("grp", "shard").agg(F.sum("n").alias("n")))


def assign(docs: DataFrame, shards: int = 40, rounds: int = 100) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    Null texts count as empty ones (size 16) and are equal to them. Repeated rows are rows of their own,
    linked by their equal texts, and are ranked in pieces like others, however many there are. With fewer rows than shards some shards are empty; an empty table gives an
    empty result; other columns play no part. Reruns agree: ties are broken by hashes of the contents.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"))
    key = F.struct("h", "text_crc32", "size")
    base = base.withColumn("grp", key).withColumn("first", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).drop("h")
    base = cut(base)
    total = base.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]

    spread = base.groupBy("grp", F.col("first").alias("shard")).agg(F.count("*").alias("n"))
    sizes = cut(spread.groupBy("grp").agg(F.sum("n").alias("members")).where("members > 1"))
    held = cut(spread.join(sizes, "grp", "left_semi"))
    for most in (quotas[-1] * 6 // 5, quotas[-1]):  # some slack at first, or full shards could not trade members
        held = settle(propagate(held, shards, quotas[-1], most, rounds), quotas)

    # the places of each linked group: shards in turn, each with as many members as are held there
    upto = Window.partitionBy("grp").orderBy("shard")
    places = held.withColumn("upto", F.sum("n").over(upto)).groupBy("grp").agg(F.sum("n").alias("members"), F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("places"))
    pieces = F.ceil(F.col("members") / PIECE)
    parts = places.select("grp", "places", "members", F.explode(F.sequence(F.lit(0), (pieces - 1).cast("int"))).alias("piece"))
    large = sizes.where(F.col("members") > max(PIECE, total // HOT))  # fewer than HOT rows
    marked = numbered(base, ["doc_id", "grp"], PIECE).join(F.broadcast(large.withColumnRenamed("members", "many")), "grp", "left")
    joined = marked.where("many IS NULL").drop("many").join(sizes, "grp", "left").unionByName(marked.where("many IS NOT NULL").withColumnRenamed("many", "members"))
    joined = cut(joined)  # lone and linked rows, and the latter's counts, read it: else the joins run again for each
    lone = joined.where("members IS NULL").select("doc_id", "size", "text_crc32", "nth", F.col("first").alias("shard"), F.lit(1).alias("loose"))
    linked = joined.where("members IS NOT NULL").withColumn("piece", F.pmod(F.xxhash64("doc_id", "nth", F.lit(7)), F.ceil(F.col("members") / PIECE)).cast("int"))
    counts = linked.groupBy("grp", "piece").count()
    start = F.coalesce(F.sum("count").over(Window.partitionBy("grp").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("start", start).join(parts.drop("members"), ["grp", "piece"]).drop("count")
    within = F.row_number().over(Window.partitionBy("grp", "piece").orderBy("doc_id")) - 1
    put = linked.withColumn("within", within).join(starts, ["grp", "piece"]).withColumn("at", F.col("start") + F.col("within"))
    put = put.select("doc_id", "size", "text_crc32", "nth", F.filter("places", lambda p: p["upto"] > F.col("at"))[0]["shard"].alias("shard"), F.lit(0).alias("loose"))

    # linked documents take the first slots of their shard, so that what exceeds the law is not linked
    pieces = F.lit(max(1, -(-total // (shards * PIECE))))
    placed = put.unionByName(lone).withColumn("piece", F.col("loose") * pieces + F.pmod(F.xxhash64("doc_id", "text_crc32", "nth", F.lit(7)), pieces))
    placed = cut(placed)
    counts = placed.groupBy("shard", "piece").count()
    start = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("doc_id", "text_crc32", "size")) - 1
    slots = placed.withColumn("within", within).join(counts.withColumn("start", start).drop("count"), ["shard", "piece"]).withColumn("slot", (F.col("start") + F.col("within")).cast("long"))

    have = {r[0]: r[1] for r in counts.groupBy("shard").agg(F.sum("count")).collect()}  # one row a shard
    over, upto, room, extra = [], [], 0, 0
    for s in range(shards):
        n = have.get(s, 0)
        over.append(extra)
        extra += max(0, n - quotas[s])
        room += max(0, quotas[s] - n)
        upto.append(room)
    pick = lambda values, i: F.element_at(F.array(*(F.lit(int(v)) for v in values)), i + 1)
    quota = pick(quotas, F.col("shard"))
    place = F.col("slot") - quota + pick(over, F.col("shard"))
    slots = slots.withColumn("place", F.when(F.col("slot") >= quota, place))
    to = F.size(F.filter(F.array(*(F.lit(int(v)) for v in upto)), lambda v: v <= F.col("place")))
    slots = slots.withColumn("to", F.when(F.col("place").isNotNull(), to).cast("int"))
    moved = pick([have.get(s, 0) for s in range(shards)], F.col("to")) + F.col("place") - pick([0, *upto[:-1]], F.col("to"))
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.coalesce("to", "shard").cast("int").alias("shard"), F.coalesce(moved, F.col("slot")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
