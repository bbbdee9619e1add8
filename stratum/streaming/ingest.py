"""Chunks from a stream of files: each micro-batch adds what is not stored yet.

An extension: the commands know no streams. A batch that is run again finds its chunks stored and adds nothing, and the commit
log takes a batch whole or not at all, so contents are stored exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratum import schema
from stratum.functions import codec
from stratum.operators import cas, chunking
from stratum.sources.store import Store


def put_batch(store: Store, files: DataFrame, sizes: tuple[int, int, int] = schema.SAVE_SIZES) -> None:
    chunks = chunking.with_hashes(chunking.gear_chunks(files, *sizes)).select("hash", "raw_len", "data")
    new = cas.put_if_absent(chunks, store.read("chunks")).withColumn("data", codec.compress("data"))
    store.commit(append={"chunks": new.select("hash", "raw_len", F.octet_length("data").cast("long").alias("stored_len"), "data")})


def ingest(files: DataFrame, store: Store, checkpoint: str, sizes: tuple[int, int, int] = schema.SAVE_SIZES, **trigger) -> StreamingQuery:
    """Starts the query over a streaming DataFrame (path, content); ``trigger`` is Spark's, availableNow by default."""
    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: put_batch(store, df, sizes))
    return writer.trigger(**(trigger or {"availableNow": True})).start()
