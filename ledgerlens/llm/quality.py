"""Quality selection by importance resampling.

Two generative models of hashed n-grams (single words and pairs, and the shapes of single words and
pairs: runs of letters, capitals, digits and of each other byte, a repeat of the word before being a
shape of its own) are counted: one over all documents (raw), one over the documents that labels call
good (target).  A document's log weight is the mean over its words of the log ratio of the two, times
``length``: the log importance weight of that many words of it, so that weights of short and long texts
compare.  Gumbel noise seeded by the row is added, and the k rows with the greatest sums are the sample:
k draws without replacement by the importance weights (Gumbel top-k).

k is the number of documents whose weight is at least that of all but the share ``missed`` of the
labelled good rows that the target model has not seen.  The k-th greatest sum is found exactly, by
histograms over a written table of sums; rows that tie with it are all kept.

The labelled rows are the only bounded sample: the ``most_labelled`` rows with the least hash of their
id, half for the target model and half for k.  Counts are fixed-size vectors summed in two steps; the
raw model covers every document.

Defined cases: null, empty and wordless texts have log weight 0; without labelled good rows all weights
are 0 and all documents are kept; a null id is an id like others (noise comes from id and text); equal
rows are kept or not together; columns named as those made are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import table, without, written
from ledgerlens.llm.shingles import _SPACE, _STEP, _UNSTEP, _powers, blocks, mix, word_hashes

BITS = 14
MOST_LABELLED, MISSED, LENGTH, SEED, FIXED = 20_000, 0.001, 64, 5, 2.0**20
_SHAPE = np.arange(256, dtype=np.uint64) + np.uint64(10)
_SHAPE[97:123] = _SHAPE[128:] = 1
_SHAPE[65:91] = 2
_SHAPE[48:58] = 3
_AGAIN = mix(np.array([77], np.uint64))[0]


def shapes(data: np.ndarray, start: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A hash of each word's runs of byte classes in their order."""
    if not len(start):
        return np.zeros(0, np.uint64)
    kind, space = _SHAPE[data], _SPACE[data]
    fresh = ~space
    fresh[1:] &= (kind[1:] != kind[:-1]) | space[:-1]
    run = np.cumsum(fresh)
    count = int(run[-1])
    sums = np.zeros(count + 1, np.uint64)
    np.cumsum(mix(kind[fresh] + np.uint64(77)) * _powers(_STEP, count), out=sums[1:])
    first = run[start] - 1
    hashed = mix((sums[np.append(first[1:], count)] - sums[first]) * _powers(_UNSTEP, count + 1)[first])
    hashed[1:][words[1:] == words[:-1]] = _AGAIN
    return hashed


def features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (four a word: word, pair, shape, pair of shapes; -1 for a pair over a row's end) and each row's first word."""
    start, words = word_hashes(data)
    rows = np.searchsorted(start, np.concatenate([[0], ends]))
    shape = shapes(data, start, words)
    out = np.full((4, len(words)), -1, np.int32)
    for k, single in ((0, words), (2, shape)):
        model = k // 2 << BITS  # words and their pairs share a model, and so do shapes
        out[k] = (single >> np.uint64(64 - BITS)).astype(np.int32) + model
        if len(words) > 1:
            out[k + 1, :-1] = (mix(single[:-1] * np.uint64(3) + single[1:]) >> np.uint64(64 - BITS)).astype(np.int32) + model
        last = rows[1:][rows[1:] > rows[:-1]] - 1
        out[k + 1, last] = -1
    return out, rows


def ngram_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts over all rows (text, target) and over those with target true: at most 8 rows of fixed size to the driver."""
    size = 2 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size), np.int64)
        for batch in batches:
            chosen, at = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False).astype(bool), 0
            for n, data, ends in blocks(batch.column(0)):
                found, first = features(data, ends)
                total[0] += np.bincount(found[found >= 0], minlength=size)
                mine = found[:, np.repeat(chosen[at : at + n], np.diff(first))]
                total[1] += np.bincount(mine[mine >= 0], minlength=size)
                at += n
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["c"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * size, np.int64)
        for batch in batches:
            for c in batch.column(0):
                total += np.frombuffer(c.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["c"])

    parts = rows.select("text", "target").mapInArrow(count, "c binary").repartition(8).mapInArrow(add, "c binary").collect()
    raw, target = np.sum([np.frombuffer(r.c, np.int64).reshape(2, size) for r in parts] or [np.zeros((2, size), np.int64)], axis=0)
    return raw, target


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of target over raw probability of every feature, words and shapes each a model of its own."""
    out = np.zeros(len(raw))
    if target.sum():
        for k in (0, 1):
            own = slice(k << BITS, (k + 1) << BITS)
            out[own] = np.log((target[own] + 1) / (target[own].sum() + (1 << BITS))) - np.log((raw[own] + 1) / (raw[own].sum() + (1 << BITS)))
    return out


def log_weights(docs: DataFrame, ratio: np.ndarray, text_col: str, length: int = LENGTH) -> DataFrame:
    """docs with log_weight; sums are of whole numbers, the same in any order."""
    kept = len(docs.columns)
    rows = docs.select("*", F.col(f"`{text_col}`").cast("string").alias("__scored"))
    schema = docs.withColumn("log_weight", F.lit(0.0)).schema
    table = docs.sparkSession.sparkContext.broadcast(np.append(np.round(ratio * FIXED), 0).astype(np.int64))  # -1 scores nothing

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = table.value
        for batch in batches:
            out = []
            for _, data, ends in blocks(batch.column(kept)):
                found, first = features(data, ends)
                sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(by[found].sum(0))])
                words = np.diff(first)
                out.append((sums[first[1:]] - sums[first[:-1]]) / FIXED * length / np.maximum(words, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(np.concatenate(out) if out else np.zeros(0))], schema.names)

    return rows.mapInArrow(score, schema)


def gumbel(*key: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise from a hash of the key."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11).cast("double") + 0.5) / F.lit(float(2**53))
    return -F.log(-F.log(unit))


def kth_greatest(rows: DataFrame, value: str, k: int, cells: int = 4096) -> float:
    """The k-th greatest value (minus infinity if there are fewer), by histograms of a range that gets smaller: at most ``cells`` rows to the driver each time."""
    found = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")).first()
    if k <= 0 or found.n == 0:
        return float("inf")
    if found.n < k:
        return float("-inf")
    lo, hi = found.lo, found.hi
    while lo < hi:
        cell = F.least(F.floor((F.col(value) - lo) / (hi - lo) * cells), F.lit(cells - 1))
        counts = rows.filter(F.col(value).between(lo, hi)).groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).collect()
        for r in sorted(counts, key=lambda r: -r.lo):
            if k <= r.n:
                lo, hi = r.lo, r.hi
                break
            k -= r.n
    return lo


def scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most_labelled: int, missed: float, length: int) -> tuple[np.ndarray, DataFrame, float]:
    """The log ratios, a written table (id_col, log_weight, gumbel_key) of all rows, and the least key of the sample."""
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    order = F.xxhash64(F.lit(SEED + 1), "__id")
    # at most most_labelled rows of a key and a flag, small enough to broadcast at any size of the table
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg((F.max("quality") > 0).alias("__good")).orderBy(order, "__id").limit(most_labelled)
    known = F.broadcast(known.withColumn("__fit", F.pmod(F.xxhash64(F.lit(SEED + 2), "__id"), F.lit(2)) == 0))
    marked = docs.select(key, text.alias("__text")).join(known, key == F.col("__id"), "left")
    raw, target = ngram_counts(marked.select(F.col("__text").alias("text"), (F.col("__good") & F.col("__fit")).alias("target")))
    ratio = log_ratio(raw, target)
    unseen = F.coalesce(F.col("__good") & ~F.col("__fit"), F.lit(False)).alias("__unseen")
    thin = log_weights(marked.select(key, unseen, gumbel(key, "__text").alias("__noise"), "__text"), ratio, "__text", length).drop("__text")
    thin = written(thin.withColumn("gumbel_key", F.col("log_weight") + F.col("__noise")), "weights")
    cut = thin.filter("__unseen").agg(F.percentile("log_weight", F.lit(missed)).alias("c")).first().c
    k = thin.filter(F.col("log_weight") >= F.lit(float("-inf") if cut is None else float(cut))).count()
    return ratio, thin.drop("__unseen", "__noise"), kth_greatest(thin, "gumbel_key", k)


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_labelled: int = MOST_LABELLED, missed: float = MISSED, length: int = LENGTH) -> DataFrame:
    """docs with log_weight, gumbel_key and kept."""
    docs = docs.select(*without(docs, ["log_weight", "gumbel_key", "kept"]))
    ratio, _, least = scored(docs, labels, id_col, text_col, most_labelled, missed, length)
    noise = gumbel(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))
    out = log_weights(docs, ratio, text_col, length).withColumn("gumbel_key", F.col("log_weight") + noise)
    return out.withColumn("kept", F.col("gumbel_key") >= F.lit(least))


def op10_quality_classifier(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    _, rows, least = scored(docs, labels, "doc_id", "text", MOST_LABELLED, MISSED, LENGTH)
    return rows.withColumn("kept", F.col("gumbel_key") >= F.lit(least))
