"""The corpus pipeline: operators of ledgerlens.llm applied to documents one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
docs, whatever their names: an operator sees the columns under names of this module's own.  run() writes
each stage's rows as Parquet to the shared folder and reads them back as the next one's docs, so that a
stage that is lost is made again from files; tables that nothing reads any more are deleted.

1. quality classifier: documents that aren't among the sample go;
2. n-gram Jaccard join: of each component of near copies one row stays, that with the least id, then text
   hash (rows without ids take part; rows without words are no copies and all stay);
3. substring dedup: repeated sentences go from the texts, which keep their rows;
4. mixing sources: a row for each time that a document is taken, a last one cut to the words it gives, in
   the order of the mix: ranges of output shards, each shuffled;
5. SentencePiece: a row for each sampled segmentation of each document, its ids as little-endian
   32-bit numbers in one binary value.

Empty tables pass through as empty tables.  n_chars, where there is one, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import drop, since, table, written
from ledgerlens.llm.jaccard import one_of_each
from ledgerlens.llm.mixture import mix_documents
from ledgerlens.llm.pieces import segment
from ledgerlens.llm.quality import resample
from ledgerlens.llm.spans import remove_repeats


def _aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns under other names, and these."""
    names = {c: f"in_{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), names


def _back(rows: DataFrame, names: dict[str, str], docs: DataFrame) -> DataFrame:
    """The columns of docs again, with n_chars counted anew."""
    out = rows.select(*(F.col(n).alias(c) for c, n in names.items()))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, names = _aside(docs)
    kept = resample(rows, table(spark, sf_dir, "labels"), names["doc_id"], names["text"]).filter("kept")
    return kept.select(*(F.col(n).alias(c) for c, n in names.items()))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, names = _aside(docs)
    return one_of_each(rows, names["doc_id"], names["text"]).select(*(F.col(n).alias(c) for c, n in names.items()))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, names = _aside(docs)
    return _back(remove_repeats(rows, names["doc_id"], names["text"]), names, docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, names = _aside(docs)
    mixed = mix_documents(rows, names["doc_id"], names["text"], names["source"])
    order = ["mix_shard", "mix_order"]
    return _back(mixed.repartitionByRange(*order).sortWithinPartitions(*order), names, docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return segment(docs, public_tokenizers.path("piece_bpe_32k.model"), packed=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", source_mixture),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: SQL can't express the hashed models and the sampled segmentations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), len(since(0))
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{k}")
        drop(spark, [path for path in since(before) if path != docs._written_path])
    return docs
