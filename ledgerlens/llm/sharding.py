"""Sharding of documents by a two-pass external shuffle, with DataFrame functions only.

Pass one scatters records by seeded hashes: the shard has the highest of one hash for each shard
(rendezvous), so that one more shard takes rows only into itself; within a shard a second hash, of id,
size and checksum, picks one of as many buckets as keep a bucket small, and a third one orders the bucket.
Pass two cuts each bucket into runs of at most run_rows records and applies a seeded Fisher-Yates shuffle
to each run: a record follows its own place through the swaps of its run, so that no list of records is
ever gathered.  Buckets follow each other within their shard, so slots have no gaps.  Records are then
written in slot order.

A bucket grown beyond its size (rows that share one id lie in one shard) only has more runs; it may
spill, and every run is shuffled alike.

Defined cases: a null text has no bytes and CRC 0; a null id is a key like any other; repeated rows are
kept, each in a slot of its own; an empty table gives an empty result.  Columns of the input named as
those made here are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import table, without, written

MADE = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def rendezvous(key: Column, shards: int, seed: int) -> tuple[Column, Column]:
    """The shard with the highest hash, and the shard if there were one more."""
    scores = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.xxhash64(key, i, F.lit(seed)))
    best = F.array_max(scores)
    shard = (F.array_position(scores, best) - 1).cast("int")
    return shard, F.when(F.xxhash64(key, F.lit(shards), F.lit(seed)) > best, F.lit(shards)).otherwise(shard).cast("int")


def shuffled_place(at: Column, n: Column, *seeds: Column) -> Column:
    """Where the record at place ``at`` of n is after a Fisher-Yates shuffle: swaps of i = n - 1 .. 1 with a hashed j <= i."""
    steps = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))

    def swap(place, i):
        j = F.pmod(F.xxhash64(*seeds, i), i + 1).cast("int")
        return F.when(place == i, j).when(place == j, i).otherwise(place)

    return F.aggregate(steps, at, swap)


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, bucket_rows: int = 4096, run_rows: int = 128) -> DataFrame:
    """All columns of docs with size, text_crc32, law, shard, slot and grown_shard."""
    text, key = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`")
    shard, grown = rendezvous(key, shards, seed)
    buckets = max(1, -(-docs.count() // (shards * bucket_rows)))
    rows = docs.select(
        *without(docs, MADE),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard.alias("shard"),
        grown.alias("grown_shard"),
        F.xxhash64(F.lit(seed + 1), key).alias("__h"),
    )
    mixed = F.xxhash64(F.lit(seed + 2), "__h", "text_crc32", "size")
    rows = rows.withColumn("__h", mixed).withColumn("__bucket", F.pmod(F.col("__h"), F.lit(buckets)).cast("int"))
    rows = rows.withColumn("__cell", (F.col("shard") * buckets + F.col("__bucket")).cast("int"))

    # pass one: records meet in their buckets; a row a bucket tells where it begins in its shard
    counts = rows.groupBy("shard", "__bucket").agg(F.count("*").alias("__n"))
    counts = counts.select((F.col("shard") * buckets + F.col("__bucket")).cast("int").alias("__cell"), "__n", (F.sum("__n").over(Window.partitionBy("shard").orderBy("__bucket")) - F.col("__n")).alias("__before"))
    # a bucket is a task of its own: buckets that a hash put together would be sorted together, with their texts
    rows = rows.repartitionById(shards * buckets, "__cell")
    # equal records are told apart by their number, so that they spread over their bucket
    alike = Window.partitionBy("__cell").orderBy("__h", "text_crc32", "size")
    rows_met = rows.withColumn("__copy", F.row_number().over(alike) - F.rank().over(alike))
    place = F.row_number().over(Window.partitionBy("__cell").orderBy(F.xxhash64(F.lit(seed + 3), "__h", "__copy"), "__h", "__copy")) - 1
    met = rows_met.withColumn("__at", place).join(F.broadcast(counts), "__cell")

    # pass two: each run is shuffled
    run = F.floor(F.col("__at") / run_rows).cast("int")
    n = F.least(F.lit(run_rows).cast("long"), F.col("__n") - run * run_rows).cast("int")
    moved = shuffled_place((F.col("__at") % run_rows).cast("int"), n, F.lit(seed + 4), F.col("shard"), F.col("__bucket"), run)
    met = met.withColumn("slot", F.col("__before") + run.cast("long") * run_rows + moved)
    return met.select(*(f"`{c}`" for c in rows.columns if c not in ("__h", "__bucket", "__cell", "grown_shard")), "slot", "grown_shard")


def stored_shards(sharded: DataFrame) -> DataFrame:
    """The records written to the shared folder, each file in the order of shard and slot, and read back."""
    return written(sharded.sortWithinPartitions("shard", "slot"), "shards")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, rows in slot order within each file."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)


def op3_sharding(spark, sf_dir):
    stored = stored_shards(shard_documents(table(spark, sf_dir, "documents")))
    return stored.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
