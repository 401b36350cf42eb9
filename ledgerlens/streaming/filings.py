"""Incremental ingestion: a file stream of extraction records, gated and merged into the stored graph.

The stored edges lie in PARTS partitions by a hash of their key.  Each micro-batch reads and writes only the
partitions that its edges fall in, merged by the same last-wins upsert as in batch; a partition's newest
version counts, and a batch that is lost and run again writes the same versions.  Order is that of the
record and of the relation in it.  Company objects take the key of the companies given, if any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.operators.gate import Policy
from ledgerlens.operators.graph import EDGE_KEY, EDGE_VALUES, last_of, relation_edges
from ledgerlens.sources.filings import RECORD


def record_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_batch).json(path)


def relations_of(records: DataFrame) -> DataFrame:
    """A row for each relation of each record, in their order."""
    rows = records.select("record_ord", "ticker", F.posexplode("relationships").alias("rel_ord", "r"))
    return rows.select(
        F.struct("record_ord", "rel_ord").alias("ord"), "ticker", "r.predicate", "r.object", "r.object_type",
        F.col("r.confidence").alias("conf"), F.col("r.extraction_method").alias("method"), F.col("r.source_text").alias("evidence"), "r.rationale", F.col("r.subject").alias("subject"),
    )


#: Partitions of the stored edges.
PARTS = 64


def merge(stored: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """Edges with their order; of one key the last stays."""
    rows = fresh if stored is None else stored.unionByName(fresh)
    return last_of(rows, (*EDGE_KEY, "part"), [F.col("ord"), F.col("confidence"), F.col("extraction_method"), F.col("source_text")])


def current(spark: SparkSession, table_path: str, before: int | None = None) -> DataFrame | None:
    """The edges with their order, of each partition its newest version (before a batch, if one is given); None if there is no table yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(table_path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    rows = spark.read.option("basePath", table_path).parquet(table_path)
    if before is not None:
        rows = rows.filter(F.col("v") < before)
    newest = rows.select("part", "v").distinct().groupBy("part").agg(F.max("v").alias("v"))  # a row a partition
    return rows.join(F.broadcast(newest), ["part", "v"]).drop("v")


def ingest(stream: DataFrame, table_path: str, checkpoint: str, policy: Policy = Policy(), companies: DataFrame | None = None) -> StreamingQuery:
    """Runs over the files there are and stops; current() gives the table after it."""

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = relation_edges(relations_of(batch), policy, companies).select(*EDGE_KEY, *EDGE_VALUES, "ord")
        fresh = fresh.withColumn("part", F.pmod(F.xxhash64(*EDGE_KEY), F.lit(PARTS)).cast("int")).persist()
        touched = [r.part for r in fresh.select("part").distinct().collect()]  # at most PARTS numbers
        stored = current(spark, table_path, number)  # not this batch's own versions, where it is run again
        stored = None if stored is None else stored.filter(F.col("part").isin(touched))
        merged = merge(stored, fresh)
        merged.withColumn("v", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "v").parquet(table_path)
        fresh.unpersist()

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
