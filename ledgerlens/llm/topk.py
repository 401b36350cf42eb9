"""Exact top-k by inner product of whole-number vectors, with MaxScore.

Vectors are terms (dimensions) with weights.  Candidates lie in shards, each held as postings: a
column of weights for each dimension, in as few bytes as they need, written once.  For a query, a
dimension's contribution in a shard lies between two bounds; the width of that interval is the most that
the term can add.  Terms are put in order of it, and a threshold splits them: the narrowest terms that
cannot lift a candidate to the threshold by themselves are non-essential.  The essential terms' postings
are traversed for all candidates; the others, widest first, are probed a few at a time, only for the
candidates that the bounds of the terms left can still lift to the threshold.

The threshold is the k-th best score so far: a sample of the shards (a fixed part of them) is searched
first, its k-th best score starts the search of all others, and it rises in each task as its shards give
better scores.  The best of all shards are merged for each query.

Queries come in batches of bounded size, which are broadcast; every shard is searched where it is read,
so neither side is copied for the other.  A query whose own row is a candidate skips it.  Results are
whole: ties of score go to the smaller id.

Defined cases: vectors that are null, empty or hold null or non-finite components, and rows without
an id, take no part; vectors
of another length than the query are no candidates of it; fewer candidates than k: all of them; rows
that repeat an id are candidates of their own, but for the query's own id; query rows that repeat an id
are one query, with the best scores of all of them; other columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import shared_dir, table, written

SHARD_ROWS, QUERY_ROWS, BLOCK_BYTES, BATCH_BLOCKS, SAMPLED, PROBED = 4096, 1024, 2 << 20, 8, 64, 4


def whole(ids: pa.Array, vectors: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and floor(scale * x) of the finite vectors of an Arrow list column, for each length; a row a vector."""
    starts = vectors.offsets.to_numpy()
    sizes = np.where(vectors.is_null().to_numpy(zero_copy_only=False), 0, np.diff(starts))
    flat = vectors.values.cast(pa.float64())
    x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    keys = ids.to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        own = np.flatnonzero(sizes == dim)
        values = x[starts[own][:, None] + np.arange(dim)]
        fine = np.isfinite(values).all(1)
        values = np.clip(np.floor(values[fine] * scale), -(2.0**63), 2.0**63 - 1024)
        yield keys[own[fine]].astype(np.int64), values.astype(np.int64)


def pack(rows: DataFrame, id_col: str, vector_col: str, scale: int, most_rows: int) -> DataFrame:
    """(dim, n, kind, ids, data): vectors of one length in blocks, dimension by dimension, in the smallest kind of number."""
    names = ["dim", "n", "kind", "ids", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        sizes: Counter = Counter()

        def block(dim: int) -> pa.RecordBatch:
            ids, values = (np.concatenate(x) for x in zip(*held.pop(dim)))
            sizes.pop(dim)
            greatest = max(int(values.max()), -int(values.min()))
            kind = "<i2" if greatest < 2**15 else "<i4" if greatest < 2**31 else "<i8"
            row = (dim, len(ids), kind, ids.astype("<i8").tobytes(), values.T.astype(kind).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary()))], names)

        for batch in batches:
            for ids, values in whole(batch.column(0), batch.column(1), scale):
                dim = values.shape[1]
                room = max(1, min(most_rows, BLOCK_BYTES // (8 * dim)))
                for a in range(0, len(ids), room):
                    part = slice(a, a + room)
                    if sizes[dim] and sizes[dim] + len(ids[part]) > room:
                        yield block(dim)
                    if len(ids[part]):
                        held.setdefault(dim, []).append((ids[part], values[part]))
                        sizes[dim] += len(ids[part])
        for dim in list(held):
            yield block(dim)

    known = rows.filter(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{vector_col}`"))
    return known.mapInArrow(run, "dim int, n int, kind string, ids binary, data binary")


def essential(width: np.ndarray, need) -> tuple[np.ndarray, int]:
    """Terms by falling width, and how many of them are essential: the others' widths together are less than need."""
    order = np.argsort(-width, kind="stable")
    together = np.cumsum(width[order][::-1])
    return order, len(order) - int(np.searchsorted(together, need, "left")) if need > 0 else 0


def maxscore(query: np.ndarray, own: int, ids: np.ndarray, postings: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, threshold=None, probed: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k best candidates of a shard with threshold or more: postings[d] holds dimension d of all, between low[d] and high[d]."""
    most, least = np.where(query > 0, query * high, query * low), np.where(query > 0, query * low, query * high)
    n, alive, score = postings.shape[1], None, None
    if threshold is None:
        order, done = np.arange(len(query)), len(query)
    else:
        order, done = essential(most - least, threshold - least.sum())
        done = max(done, 1)
    rest = np.append(np.cumsum(most[order][::-1])[::-1], 0)
    score = query[order[:done]] @ postings[order[:done]]
    alive = np.arange(n)
    while True:
        if probed is not None:
            probed[done] += len(alive)
        if threshold is not None:
            fit = np.flatnonzero(score + rest[done] >= threshold)
            if len(fit) < 0.8 * len(alive) or done == len(order):
                alive, score = alive[fit], score[fit]
        if done == len(order) or not len(alive):
            break
        terms = order[done : done + PROBED]
        score = score + (query[terms] @ postings[terms] if len(alive) == n else query[terms] @ postings[terms[:, None], alive])
        done += len(terms)
    other = ids[alive] != own
    alive, score = alive[other], score[other]
    if len(score) > k:
        enough = np.partition(score, len(score) - k)[len(score) - k]
        alive, score = alive[score >= enough], score[score >= enough]
    best = np.lexsort((ids[alive], -score))[:k]
    return ids[alive[best]], score[best]


class Queries:
    """A batch of queries as it is broadcast: blocks of (dim, ids, vectors), numbered through, and the thresholds known so far."""

    def __init__(self, blocks: list) -> None:
        self.blocks, self.first = [], [0]
        for b in blocks:
            self.blocks.append((b.dim, np.frombuffer(b.ids, "<i8"), np.frombuffer(b.data, b.kind).reshape(b.dim, b.n).T.astype(np.int64)))
            self.first.append(self.first[-1] + b.n)
        self.thresholds: dict[int, int] = {}


def search(shards: DataFrame, queries: Queries, k: int) -> DataFrame:
    """(q, query_id, id, score): for each query (by its number) the k best of each task's shards that reach the threshold."""
    sent = shards.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        best: dict[int, list[tuple[int, int]]] = {}  # of each query: (-score, id), the best first
        owners: dict[int, int] = {}
        for batch in batches:
            for dim, n, kind, ids, data in zip(*(batch.column(c).to_pylist() for c in range(5))):
                keys, postings = np.frombuffer(ids, "<i8"), np.frombuffer(data, kind).reshape(dim, n)
                low, high = postings.min(1).astype(np.int64), postings.max(1).astype(np.int64)
                for (own_dim, own, vectors), first in zip(asked.blocks, asked.first):
                    if own_dim != dim:
                        continue
                    # doubles are exact as long as no sum can pass 2**53
                    bound = int(max(abs(int(vectors.min())), abs(int(vectors.max())))) * max(-int(low.min()), int(high.max()), 1) * dim
                    number = object if bound >= 2**62 else np.float64 if bound < 2**53 else np.int64
                    p, v, lo, hi = (np.ascontiguousarray(x.astype(number)) for x in (postings, vectors, low, high))
                    for q, (query, key) in enumerate(zip(v, own.tolist()), first):
                        found = best.get(q, [])
                        known = -found[-1][0] if len(found) == k else None
                        start = asked.thresholds.get(q)
                        threshold = known if start is None else start if known is None else max(known, start)
                        names, scores = maxscore(query, key, keys, p, lo, hi, k, threshold)
                        if len(names):
                            owners[q] = key
                            best[q] = sorted(found + list(zip((-int(s) for s in scores), names.tolist())))[:k]
        rows = [(q, owners[q], i, -s) for q, found in best.items() for s, i in found]
        columns = list(zip(*rows)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["q", "query_id", "id", "score"])

    return shards.select("dim", "n", "kind", "ids", "data").mapInArrow(run, "q long, query_id long, id long, score long")


def topk(candidates: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, sampled: int = SAMPLED) -> DataFrame:
    """(query_id, rank, id_col, score): each query's k best rows of candidates but itself."""
    spark = candidates.sparkSession
    shards = written(pack(candidates, id_col, vector_col, scale, SHARD_ROWS).withColumn("cell", F.monotonically_increasing_id()), "postings")
    asked = written(pack(queries, id_col, vector_col, scale, QUERY_ROWS).withColumn("cell", F.monotonically_increasing_id()), "queries")
    cells = [r.cell for r in asked.select("cell").orderBy("cell").collect()]  # a number for each block of up to QUERY_ROWS queries
    in_sample = F.pmod(F.xxhash64("cell"), F.lit(sampled)) == 0
    if shards.filter(in_sample).isEmpty():
        least = shards.agg(F.min("cell").alias("c")).first().c
        in_sample = F.col("cell") == F.lit(-1 if least is None else least)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    place = F.row_number().over(order)
    path = f"{shared_dir(spark)}/topk-{uuid.uuid4().hex}"
    result = None
    for at in range(0, len(cells), BATCH_BLOCKS):
        batch = Queries(asked.filter(F.col("cell").isin(cells[at : at + BATCH_BLOCKS])).collect())
        first = written(search(shards.filter(in_sample), batch, k), "sample")
        kth = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "id"))
        batch.thresholds = {r.q: r.score for r in first.withColumn("n", kth).filter(F.col("n") == k).select("q", "score").collect()}
        found = first.unionByName(search(shards.filter(~in_sample), batch, k))
        found.select("query_id", "id", "score").withColumn("rank", place).filter(F.col("rank") <= k).write.mode("append").parquet(path)
    if not cells:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score long")
    whole_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(whole_path)
    result = spark.read.schema("query_id long, id long, score long, rank int").parquet(path)
    if len(cells) > BATCH_BLOCKS:  # rows of one id may lie in several batches
        result = result.drop("rank").withColumn("rank", place).filter(F.col("rank") <= k)
    return result.select("query_id", "rank", F.col("id").alias(id_col), "score")


OP7_SQL = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM fine q JOIN fine c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""


def op7_exact_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk(rows, rows.filter("vec_id % 50 = 0"))
