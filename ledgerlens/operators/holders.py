"""The most alike companies by packed arrays, for features that many companies hold.

Companies and features are numbered in the order of their texts.  Companies that share most of their
features get places side by side, in blocks of SIDE; a pair of blocks is one task, which gets the holders of
the features that both blocks have, counts what each pair of companies shares in one matrix, and keeps the
best of each company.  So nothing is made for a pair of companies but a number in a task's matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import links

SIDE = 1536
#: Bits of a company's number in a rank; links.FEW companies are fewer.
BITS = 19
ROUTED = "x int, y int, side int, ids binary, many binary, at binary"


def packed(rows: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """links.PACKED of rows (a, b): the numbers of a company and of a feature; what comes twice counts once."""

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for f in frames:
            held.append(f["a"].to_numpy(np.int64) << 32 | f["b"].to_numpy(np.int64))
            size += len(f)
            if size >= links.HELD:
                yield chunk(held)
                held, size = [], 0
        if size:
            yield chunk(held)

    def chunk(held: list[np.ndarray]) -> pd.DataFrame:
        key = np.unique(np.concatenate(held))
        at = key >> 32
        cuts = links.starts(at // links.BLOCK)
        low, ends = (at % links.BLOCK).astype(np.uint16), key.astype(np.uint32)
        parts = [slice(x, y) for x, y in zip(cuts, [*cuts[1:], len(key)])]
        return pd.DataFrame({"at": at[cuts] // links.BLOCK, "low": [low[p].tobytes() for p in parts], "ends": [ends[p].tobytes() for p in parts]})

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        low, ends = (np.frombuffer(b"".join(frame[c]), kind).astype(np.int64) for c, kind in (("low", np.uint16), ("ends", np.uint32)))
        key = np.unique(low << 32 | ends)
        return links._row(int(frame["at"].iloc[0]), key >> 32, key & 0xFFFFFFFF, np.ones(len(key), dtype=np.int64))

    return keep(rows.mapInPandas(deal, "at int, low binary, ends binary").groupBy("at").applyInPandas(gather, links.PACKED))


def places(blocks: DataFrame, companies: int, features: int) -> np.ndarray:
    """A place for each company: those whose features have mostly the same least holder are side by side."""

    def least(a, b, w):
        order = np.lexsort((a, b))
        first = links.starts(b[order])
        return b[order][first], a[order][first]

    ids, holder = links.gathered(links.edges_of(blocks, least, "ids int, values int").groupBy("ids").agg(F.min("values").alias("values")))
    label = np.full(features, companies)
    label[ids] = holder.astype(np.int64)
    there = links.sent(blocks, label)

    def mode(a, b, w):
        key, n = np.unique(a * companies + there.value[0][b], return_counts=True)
        order = np.lexsort((-n, key // companies))
        first = links.starts(key[order] // companies)
        return key[order][first] // companies, key[order][first] % companies

    ids, home = links.passed(blocks, mode)
    homes = np.full(companies, companies)
    homes[ids] = home.astype(np.int64)
    place = np.empty(companies, dtype=np.int64)
    place[np.lexsort((np.arange(companies), homes))] = np.arange(companies)
    return place


def routed(blocks: DataFrame, place: np.ndarray, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """ROUTED: for each pair of blocks of places and each of its sides, the features of both, how many hold each and the places in the block."""
    there = links.sent(blocks, place)

    def move(a, b, w):
        at = there.value[0][a]
        order = np.lexsort((at, b, at // SIDE))
        at, b = at[order], b[order]
        first = links.starts(at // SIDE)
        parts = [slice(x, y) for x, y in zip(first, [*first[1:], len(at)])]
        return at[first] // SIDE, [b[p].astype("u4").tobytes() for p in parts], [(at[p] % SIDE).astype("u2").tobytes() for p in parts]

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        f, at = np.frombuffer(b"".join(frame["f"]), "u4").astype(np.int64), np.frombuffer(b"".join(frame["at"]), "u2").astype(np.int64)
        key = np.sort(f << 16 | at)
        f, first = key >> 16, links.starts(key >> 16)
        return pd.DataFrame([(int(frame["x"].iloc[0]), f[first].astype("u4").tobytes(), np.diff(first, append=len(f)).astype("u2").tobytes(), (key & 0xFFFF).astype("u2").tobytes())], columns=["x", "ids", "many", "at"])

    sides = keep(links.edges_of(blocks, move, "x int, f binary, at binary").groupBy("x").applyInPandas(gather, "x int, ids binary, many binary, at binary"))
    rows = sides.select("x", "ids").collect()
    xs = np.concatenate([np.full(len(r.ids) // 4, r.x) for r in rows]) if rows else np.zeros(0, dtype=int)
    fs = np.concatenate([np.frombuffer(r.ids, "u4") for r in rows]) if rows else np.zeros(0, dtype=int)
    order = np.argsort(fs, kind="stable")
    known = links.sent(blocks, xs[order].astype("i4"), fs[order])

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks_of, features = known.value
        for frame in frames:
            for x, ids, many, at in frame.itertuples(index=False):
                ids, many, at = np.frombuffer(ids, "u4"), np.frombuffer(many, "u2"), np.frombuffer(at, "u2")
                lo, n = np.searchsorted(features, ids), np.searchsorted(features, ids, "right") - np.searchsorted(features, ids)
                mine = np.repeat(np.arange(len(ids)), n)
                other = blocks_of[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
                begin = np.cumsum(many.astype(np.int64)) - many
                for y in np.unique(other):
                    k = mine[other == y]
                    m = many[k].astype(np.int64)
                    spots = at[np.repeat(begin[k] - np.cumsum(m) + m, m) + np.arange(m.sum())]
                    yield pd.DataFrame([(min(x, y), max(x, y), int(x > y), ids[k].tobytes(), many[k].tobytes(), spots.tobytes())], columns=["x", "y", "side", "ids", "many", "at"])

    return keep(sides.repartition(len(rows) or 1, "x").mapInPandas(send, ROUTED).repartition("x", "y"))


def _sides(frame: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each side the number of holders of each common feature, and their places; a block with itself has one side."""
    rows = frame.sort_values("side")
    return [(np.frombuffer(m, "u2").astype(np.int64), np.frombuffer(a, "u2").astype(np.int64)) for m, a in zip(rows["many"], rows["at"])] * (2 if len(rows) == 1 else 1)


def _matrix(many: np.ndarray, at: np.ndarray, part: slice, kind) -> np.ndarray:
    """Places by features of a part of them."""
    ends = np.concatenate([[0], np.cumsum(many)])
    m = many[part]
    out = np.zeros((SIDE, len(m)), dtype=kind)
    out[at[ends[part.start] : ends[part.start + len(m)]], np.repeat(np.arange(len(m)), m)] = 1
    return out


def best(pairs: DataFrame, place: np.ndarray, sizes: np.ndarray, top_k: int) -> DataFrame:
    """(t, rank): the top_k ranks of each company; a rank holds ten thousand times the similarity, the shared features, and the other's number reversed."""
    at = np.empty(len(place), dtype=np.int64)
    at[place] = np.arange(len(place))
    there = links.sent(pairs, at, sizes.astype(np.int64))

    def most(rank: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if rank.shape[1] > top_k:
            rank = np.partition(rank, rank.shape[1] - top_k, axis=1)[:, -top_k:]
        row, col = np.nonzero(rank >= 0)
        return ids[row], rank[row, col]

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        at, sizes = there.value
        x, y = int(frame["x"].iloc[0]), int(frame["y"].iloc[0])
        (mx, ax), (my, ay) = _sides(frame)
        shared = np.zeros((SIDE, SIDE), dtype=np.float32)
        for k in range(0, len(mx), 512):
            part = slice(k, k + 512)
            shared += _matrix(mx, ax, part, np.float32) @ _matrix(my, ay, part, np.float32).T
        one, two = at[x * SIDE : (x + 1) * SIDE], at[y * SIDE : (y + 1) * SIDE]
        found = []
        for k in range(0, len(one), 256):
            s = shared[k : min(k + 256, len(one)), : len(two)].astype(np.int64)
            whole = sizes[one[k : k + 256], None] + sizes[None, two] - s
            # four places, half to even, of a fraction: exact in whole numbers
            whole[whole == 0] = 1
            q, r = np.divmod(s * 10_000, whole)
            q += (2 * r > whole) | ((2 * r == whole) & (q % 2 == 1))
            none = (s == 0) | (one[k : k + 256, None] == two[None, :])
            base = q << 49 | s << BITS
            low = 2**BITS - 1
            found.append((np.where(none, -1, base | (low - two)[None, :]), np.where(none, -1, base | (low - one[k : k + 256])[:, None])))
        out = [most(np.concatenate([f[0] for f in found]), one)]
        if x != y:
            out.append(most(np.ascontiguousarray(np.concatenate([f[1] for f in found]).T), two))
        t, rank = (np.concatenate(z) for z in zip(*out))
        home = t % 64
        order = np.argsort(home, kind="stable")
        t, rank, home = t[order], rank[order], home[order]
        first = links.starts(home)
        cuts = [slice(p, q) for p, q in zip(first, [*first[1:], len(t)])]
        return pd.DataFrame({"home": home[first], "t": [t[c].astype("i4").tobytes() for c in cuts], "rank": [rank[c].astype("i8").tobytes() for c in cuts]})

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        t, rank = np.frombuffer(b"".join(frame["t"]), "i4"), np.frombuffer(b"".join(frame["rank"]), "i8")
        order = np.lexsort((-rank, t))
        t, rank = t[order], rank[order]
        first = links.starts(t)
        n = np.diff(first, append=len(t))
        kept = np.arange(len(t)) - np.repeat(first, n) < top_k
        return pd.DataFrame({"t": t[kept], "rank": rank[kept]})

    return pairs.groupBy("x", "y").applyInPandas(count, "home int, t binary, rank binary").groupBy("home").applyInPandas(merge, "t int, rank long")


def common(pairs: DataFrame, asked: DataFrame, place: np.ndarray, names: list[str], most: int) -> DataFrame:
    """(a, b, shared_features) of asked pairs (a, b): the first texts of the features that both hold."""
    there = links.sent(pairs, place, np.array(names, dtype=object))

    @F.pandas_udf("struct<x: int, y: int>")
    def blocks_of(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        x, y = (there.value[0][z.to_numpy()] // SIDE for z in (a, b))
        return pd.DataFrame({"x": np.minimum(x, y), "y": np.maximum(x, y)})

    def show(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        place, names = there.value
        if not len(asked):
            return pd.DataFrame()
        x = int(held["x"].iloc[0])
        ids = np.frombuffer(held["ids"].iloc[0], "u4")
        one, two = (_matrix(m, a, slice(0, len(m)), bool) for m, a in _sides(held))
        a, b = place[asked["a"].to_numpy()], place[asked["b"].to_numpy()]
        swap = a // SIDE != x
        a, b = np.where(swap, b, a) % SIDE, np.where(swap, a, b) % SIDE
        texts = ["; ".join(names[ids[np.flatnonzero(one[i] & two[j])[:most]]]) for i, j in zip(a, b)]
        return pd.DataFrame({"a": asked["a"], "b": asked["b"], "shared_features": pd.Series(texts, index=asked.index, dtype=object)})

    asked = asked.withColumn("p", blocks_of("a", "b")).select("a", "b", "p.x", "p.y")
    return pairs.groupBy("x", "y").cogroup(asked.groupBy("x", "y")).applyInPandas(show, "a int, b int, shared_features string")
