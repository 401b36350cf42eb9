"""Exact Jaccard join of documents on word shingles, in the metric space of the Jaccard distance.

1. One pass hashes every whole text's shingle set; equal sets form a class, represented by one
   document.  The same pass counts all shingles in a sketch of fixed size, which only orders them.
2. Pivots are found, not drawn: nearly all documents are at distance 1 from each other, so Voronoi
   regions of a few global pivots would send every document everywhere.  In any order of the
   shingles, two sets with similarity t share one of the first n - ceil(t n) + 1; with the rarest
   first, few classes share any.  Classes that share such a shingle, and whose sizes (the triangle
   inequality with the empty set) and places of the shingle allow a link, belong to the region of
   that list's pivot, the member with the least hash.
3. Every class has a home: of its regions the one it shares most of its rarest shingles with.  Homes
   split the classes, so each set is laid out once.  A home's members join recursively and exactly:
   members within the threshold of a pivot are linked to it, others lie in the Voronoi cell of their
   nearest pivot and in each cell whose pivot is at most twice the threshold farther; members that
   share next to nothing with any pivot form a cell of their own.  Cells join in the same way until
   they are small, are all linked or do not shrink; the latter compare by an index of their shingles,
   but for members that are linked already.
4. Boundary classes are laid out again in the other regions that they belong to, but only in those
   that hold two homes and two components: pairs of one home are decided, and so are linked ones.
5. In a region, members most of whose shingles nobody else there has are left out first.  Regions give a star of each component found, and components follow by star rounds.

In a region too large for a task, pivots go to all of its blocks first; only members outside of its
largest component are then compared with all others, by pairs of blocks.  A shingle that the sketch puts in very many documents has its list dealt to several tasks, and its
region is named by the shingle, so that no task holds a list of unbounded length.

Defined cases: null text, or one without words: size 0, a component of its own; fewer words than a
shingle: the whole sequence is the one shingle; rows with one id twice: the id's rows are linked if
their sets are; a null id takes part, with the smallest id of its component (null if there is none).
Columns other than the id and the text are not looked at.  Sets are compared by 64-bit hashes of
shingles, classes by 64-bit set hash and size.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import drop, since, table, trim, written
from ledgerlens.llm.components import components
from ledgerlens.llm.shingles import mix, shingle_sets

SKETCH_BITS, PIECES = 20, 16
LEAF, PIVOTS, SHIFTS = 6, 12, 16


def ceil_mul(n, num: int, den: int):
    return -(-n * num // den)


def class_hash(s: np.ndarray) -> int:
    """A signed 64-bit hash of a whole set and its size."""
    total = int(mix(s).sum(dtype=np.uint64)) + len(s) & (1 << 64) - 1
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


# ---- the join of one region ----


def linked(inter, a, b, num: int, den: int):
    """num / den or more of the union is shared; no empty set is."""
    return (den * inter >= num * (a + b - inter)) & (inter > 0)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from an index of the left sets' shingles."""
    if not left or not right:
        return np.zeros((len(left), len(right)), np.int32)
    values, of = np.concatenate(left), np.repeat(np.arange(len(left)), [len(s) for s in left])
    order = np.argsort(values, kind="stable")
    values, of = values[order], of[order]
    out = np.zeros((len(left), len(right)), np.int32)
    for k, s in enumerate(right):
        lo, hi = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
        size = hi - lo
        total = int(size.sum())
        if total:
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(total)
            out[:, k] = np.bincount(of[at], minlength=len(left))
    return out


class Region:
    """The members of a region: sets, trees of linked ones, and what is decided before (homes)."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int, trees: np.ndarray | None = None, homes: np.ndarray | None = None) -> None:
        n = len(sets)
        self.sets, self.num, self.den = sets, num, den
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.tree = np.arange(n) if trees is None else np.unique(trees, return_inverse=True)[1].reshape(n)
        self.homes, self.found, self.work = homes, Counter(), 0

    def unite(self, x: int, others: np.ndarray, how: str) -> None:
        """Links member x with all others."""
        trees = np.unique(np.append(self.tree[others], self.tree[x]))
        if len(trees) > 1:
            self.found[how] += len(trees) - 1
            self.tree[np.isin(self.tree, trees)] = trees[0]

    def compare(self, left: np.ndarray, right: np.ndarray, how: str = "compared", step: int = 256) -> None:
        """All links between two lists of members that aren't decided, step columns at a time."""
        chosen = [self.sets[i] for i in left]
        for at in range(0, len(right), step):
            part = right[at : at + step]
            found = linked(shared_counts(chosen, [self.sets[i] for i in part]), self.sizes[left][:, None], self.sizes[part][None, :], self.num, self.den)
            for j in np.flatnonzero(found.any(0)).tolist():
                self.unite(int(part[j]), left[found[:, j]], how)

    def open(self, members: np.ndarray) -> np.ndarray:
        """Members of which each undecided pair has one: all but those of the largest tree, or of the largest home."""
        best = members
        for labels in (self.tree, self.homes):
            if labels is not None:
                _, of, count = np.unique(labels[members], return_inverse=True, return_counts=True)
                rest = members[of.reshape(-1) != count.argmax()]
                best = rest if len(rest) < len(best) else best
        return best

    def sharing(self, members: np.ndarray) -> np.ndarray:
        """Those members that share enough shingles with others for a link: of the first n - ceil(t n) + 1 in any order one must be shared, so no more may be a member's own."""
        while len(members) > 1:
            values, of = np.concatenate([self.sets[i] for i in members]), np.repeat(np.arange(len(members)), self.sizes[members])
            order = np.argsort(values, kind="stable")
            values = values[order]
            alone = np.concatenate([[True], values[1:] != values[:-1]]) & np.concatenate([values[1:] != values[:-1], [True]])
            own = np.bincount(of[order][alone], minlength=len(members))
            fit = own < _prefix(self.sizes[members], self.num, self.den)
            if fit.all():
                break
            members = members[fit]
        return members

    def join(self, members: np.ndarray, depth: int = 0) -> None:
        """Finds every undecided link among the members, by pivots and Voronoi cells with windows."""
        members = self.sharing(members)
        if len(members) < 2:
            return
        probes = self.open(members)
        if not len(probes):
            return
        if len(members) <= LEAF or depth > 20:
            self.compare(members, probes, "leaf")
            return
        reach = 1 - self.num / self.den + 1e-9
        sizes = self.sizes[members]
        # pivots spread over the members, in the order of a hash, far from those already taken
        keys = mix(np.array([self.sets[i][0] for i in members], np.uint64) + np.uint64(depth))
        trial = np.argsort(keys, kind="stable")[: 4 * PIVOTS]
        inter = shared_counts([self.sets[i] for i in members], [self.sets[members[i]] for i in trial])
        far = 1 - inter / (sizes[:, None] + sizes[trial][None, :] - inter)
        pivots: list[int] = []
        for i in range(len(trial)):
            if len(pivots) < PIVOTS and all(far[trial[i], j] > 2 * reach for j in pivots):
                pivots.append(i)
        near = linked(inter, sizes[:, None], sizes[trial][None, :], self.num, self.den)
        for k in pivots:  # members within the threshold of a pivot are linked to it
            self.unite(int(members[trial[k]]), members[near[:, k]], "pivot")
        far = far[:, pivots]
        own = far.min(1)
        cells = [np.flatnonzero((far[:, k] <= own + 2 * reach) & (own < 1)) for k in range(len(pivots))]
        cells.append(np.flatnonzero(own >= 1 - reach))
        self.work += len(members)
        if max(map(len, cells)) > 0.8 * len(members) or self.work > 16 * len(self.sets):
            self.rings(members, far, reach)  # cells that hold nearly all, or each other's members again and again, are no smaller work
            return
        for cell in cells:
            self.join(members[cell], depth + 1)

    def rings(self, members: np.ndarray, far: np.ndarray, reach: float) -> None:
        """Undecided links of a cell that does not shrink: probes against the ring of members at about their own distance from a pivot."""
        probes = np.flatnonzero(np.isin(members, self.open(members)))
        if not len(probes):
            return
        pivot = int(far[probes].std(0).argmax())
        at = far[:, pivot]
        order = probes[np.argsort(at[probes], kind="stable")]
        start = 0
        while start < len(order):
            last = min(len(order), start + 256)
            low, high = at[order[start]] - reach, at[order[last - 1]] + reach
            ring = members[(at >= low) & (at <= high)]
            self.compare(ring, members[order[start:last]], "ring")
            start = last


# ---- passes over the documents ----


def _prefix(n, num: int, den: int):
    return n - ceil_mul(n, num, den) + 1


def set_rows(docs: DataFrame, width: int) -> DataFrame:
    """Class hash and size of each row's set (kind 0), and pieces of the shingle counts (kind 1)."""
    names = ["kind", "z", "k", "h", "n", "f", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            sizes, hashes = [], []
            held: list[np.ndarray] = []
            for s in shingle_sets(batch.column(3), width):
                sizes.append(len(s))
                hashes.append(class_hash(s) if len(s) else 0)
                held.append(s)
            if held:
                counts += np.bincount((np.concatenate(held) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(sizes), pa.int32()), *batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(hashes, pa.int64()), pa.nulls(len(sizes), pa.binary())], names)
        each = len(counts) // PIECES
        blobs = [zlib.compress(counts[i * each : (i + 1) * each].astype("<u4").tobytes(), 1) for i in range(PIECES)]
        none = [pa.nulls(PIECES, t) for t in (pa.bool_(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([1] * PIECES, pa.int32()), *none, pa.array(range(PIECES), pa.int64()), pa.nulls(PIECES, pa.int64()), pa.array(blobs, pa.binary())], names)
        trim()

    return docs.select("z", "k", "h", "t").mapInArrow(run, "kind int, z boolean, k long, h long, n long, f long, piece binary")


def shingle_sketch(rows: DataFrame) -> np.ndarray:
    """The summed counts: 2**SKETCH_BITS numbers for any input, 16 rows to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for n, piece in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(zlib.decompress(piece.as_py()), "<u4").astype(np.int64)
                sums[n] = sums[n] + own if n in sums else own
        for n, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([np.minimum(total, 2**32 - 1).astype("<u4").tobytes()], pa.binary())], ["n", "piece"])

    pieces = rows.filter("kind = 1").select("n", "piece").repartition(PIECES, "n").mapInArrow(add, "n long, piece binary").collect()
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    each = len(out) // PIECES
    for r in pieces:
        out[r.n * each : (r.n + 1) * each] = np.frombuffer(r.piece, "<u4")
    return out


#: A rare shingle (32 bits of it) of a class, its size, and the largest size of a class that it may be
#: linked with if this is the first shingle they share (-1: the shingle's list is dealt to several parts).
ENTRY = np.dtype([("s", "<u4"), ("f", "<i8"), ("n", "<i4"), ("up", "<i4")])


def prefix_entries(docs: DataFrame, sketch, width: int, num: int, den: int, parts: int, hot: int) -> DataFrame:
    """(part, blob): the rarest shingles of each class as ENTRY records, packed for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = sketch.value
        usual = int(order.mean())  # of a sketch's cell, without any shingle that is frequent
        seen: set[int] = set()
        held: list[np.ndarray] = []
        to: list[np.ndarray] = []
        count = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, to, count
            rows, part = np.concatenate(held), np.concatenate(to)
            at = np.argsort(part, kind="stable")
            rows, part = rows[at], part[at]
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            held, to, count = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]].astype(np.int32)), pa.array([rows[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], ["part", "blob"])

        for batch in batches:
            for s in shingle_sets(batch.column(0), width):
                n = len(s)
                if not n:
                    continue
                f = class_hash(s)
                if f in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(f)
                first = _prefix(n, num, den)
                often = order[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                chosen = np.lexsort((s, often))[:first]
                often, own = often[chosen].astype(np.int64), s[chosen]
                rows = np.empty(first, ENTRY)
                rows["s"], rows["f"], rows["n"] = own >> np.uint64(32), f, n
                up = (n - np.arange(first)) * (num + den) // num - n
                pieces = np.maximum(-(-(often - usual) // hot), 1)
                rows["up"] = np.where(pieces > 1, -1, up)
                held.append(rows)
                to.append(((mix(own) % np.uint64(parts)).astype(np.int64) + f % pieces) % parts)
                count += first
                if count > 1_000_000:
                    yield flush()
        if held:
            yield flush()
        trim()

    return docs.select("t").mapInArrow(run, "part int, blob binary")


def list_members(rows: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pivot, class, size and number of lists of all memberships that ENTRY records give."""
    dealt = rows[rows["up"] < 0]
    rows = rows[rows["up"] >= 0]
    rows = rows[np.lexsort((rows["f"], rows["n"], rows["s"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["s"][1:] != rows["s"][:-1]) | (rows["f"][1:] != rows["f"][:-1])
    rows = rows[new]
    size = rows["n"].astype(np.int64)
    # a new segment where the shingle changes or the next size is too large for a link
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows["s"][1:] != rows["s"][:-1]) | (size[:-1] * den < size[1:] * num)
    start = np.flatnonzero(fresh)
    many = np.diff(np.append(start, len(rows)))
    segment = np.repeat(np.arange(len(start)), many)
    # those that some other of the segment may be linked with: by the sizes, and by what may follow the shingle
    kept = many[segment] > SHIFTS + 1 if len(rows) else np.zeros(0, bool)
    for d in range(1, SHIFTS + 1):
        a = np.flatnonzero(segment[:-d] == segment[d:]) if len(rows) > d else np.zeros(0, np.int64)
        if not len(a):
            break
        a = a[(size[a + d] * num <= size[a] * den) & (rows["up"][a] >= size[a + d]) & (rows["up"][a + d] >= size[a])]
        kept[a] = kept[a + d] = True
    rows, segment = rows[kept], segment[kept]
    start = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if len(rows) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(rows["f"], start) if len(rows) else rows["f"]
    pivot = np.repeat(least, np.diff(np.append(start, len(rows))))
    pivot = np.concatenate([pivot, dealt["s"].astype(np.int64)])
    f, n = np.concatenate([rows["f"], dealt["f"]]), np.concatenate([rows["n"], dealt["n"]]).astype(np.int64)
    order = np.lexsort((f, pivot))
    pivot, f, n = pivot[order], f[order], n[order]
    one = np.flatnonzero(np.concatenate([[True], (pivot[1:] != pivot[:-1]) | (f[1:] != f[:-1])])) if len(f) else np.zeros(0, np.int64)
    return pivot[one], f[one], n[one], np.diff(np.append(one, len(f)))


def memberships(entries: DataFrame, parts: int, num: int, den: int) -> DataFrame:
    """(p, f, n, votes): class f of size n is in the region of pivot p, by so many lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [b.as_py() for batch in batches for b in batch.column(0)]
        if blobs:
            found = list_members(np.frombuffer(b"".join(blobs), ENTRY), num, den)
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["p", "f", "n", "votes"])

    found = entries.repartition(parts, "part").select("blob").mapInArrow(run, "p long, f long, n long, votes long")
    return found.groupBy("p", "f", "n").agg(F.sum("votes").alias("votes"))


def packed_texts(rows: DataFrame) -> DataFrame:
    """(h, text): each text's hash and zstd bytes, once a task but for a bounded memory of those seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            hashes, texts = [], []
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                if h not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(h)
                    raw = t.as_buffer()
                    hashes.append(h)
                    texts.append(struct.pack("<q", raw.size) + codec.compress(raw, asbytes=True))
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(texts, pa.binary())], ["h", "text"])
        trim()

    return rows.filter("t is not null").select("h", "t").mapInArrow(run, "h long, text binary")


def unpacked(texts: list[bytes]) -> pa.Array:
    codec = pa.Codec("zstd", 1)
    raw = [codec.decompress(memoryview(t)[8:], struct.unpack_from("<q", t)[0], asbytes=True) for t in texts]
    return pa.array(raw, pa.large_binary())


def region_links(members: DataFrame, num: int, den: int, width: int, flush_bytes: int = 4 << 20) -> DataFrame:
    """(az, ak, af, bz, bk, bf): each linked member (a) and the least one of its tree (b), from rows (region, side, f, home, lz, lk, lf, text).

    The members of a region are one group, or a pair of blocks: rows are then left, right or both.
    """
    names = ["az", "ak", "af", "bz", "bk", "bf"]

    def edges(rows: list[tuple], sets: list[np.ndarray]) -> list[tuple]:
        fine = [i for i, (r, s) in enumerate(zip(rows, sets)) if len(s) and class_hash(s) == r[2] and (i == 0 or rows[i - 1][2] != r[2] or rows[i - 1][1] != r[1])]
        if len(fine) < 2:
            return []
        rows, sets = [rows[i] for i in fine], [sets[i] for i in fine]
        sides = np.array([r[1] for r in rows])
        trees = {}
        region = Region(sets, num, den, np.array([trees.setdefault(r[4:7], len(trees)) for r in rows]), None if rows[0][3] is None else np.array([r[3] for r in rows]))
        if (sides == 0).all():
            region.join(np.arange(len(sets)))
        else:
            region.compare(np.flatnonzero(sides == 1), np.flatnonzero(sides == 2))
        # stars of the labels that members came with
        by: dict[int, set] = {}
        for r, tree in zip(rows, region.tree.tolist()):
            by.setdefault(tree, set()).add(r[4:7])
        return [(*a, *min(own)) for own in by.values() if len(own) > 1 for a in own if a != min(own)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, held, size = None, [], 0  # held: whole regions of about flush_bytes, the last one maybe not whole

        def finish(groups: list[list[tuple]]) -> pa.RecordBatch:
            sets = shingle_sets(unpacked([r[7] for g in groups for r in g]), width)
            out = [e for g in groups for e in edges(g, [next(sets) for _ in g])]
            columns = list(zip(*out)) or [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.bool_(), pa.int64(), pa.int64()) * 2)], names)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(7)]
            for r, *values, text in zip(*columns, batch.column(7)):
                if r != region:
                    if size > flush_bytes:
                        yield finish(held)
                        held, size = [], 0
                    held.append([])
                    region = r
                text = text.as_py()
                held[-1].append((r, *values, text))
                size += len(text)
        if held:
            yield finish(held)
        trim()

    return members.select("region", "side", "f", "home", "lz", "lk", "lf", "text").mapInArrow(run, "az boolean, ak long, af long, bz boolean, bk long, bf long")


LABEL = ("lz", "lk", "lf")


def tasked(texts: DataFrame, placed: DataFrame, region, num: int, den: int, width: int) -> DataFrame:
    """The links of rows (p, f, side, label, home) with their texts, a task for each region."""
    rows = texts.join(placed.withColumn("region", region).drop("p"), "f")
    return region_links(rows.repartition("region").sortWithinPartitions("region", "side", "f"), num, den, width)


def ends(links: DataFrame) -> DataFrame:
    """Links as edges of labels."""
    node = lambda x: F.struct(*(F.col(x + c).alias(c) for c in "zkf"))
    return links.select(node("a").alias("a"), node("b").alias("b"))


def large_links(texts: DataFrame, big: DataFrame, num: int, den: int, width: int, task_members: int) -> DataFrame:
    """The links of regions too large for a task, from rows (p, f, n, home, label, blocks).

    Pivots of a region go to all its blocks and link what lies within the threshold of them.  Then only
    members that are not in the region's largest component are compared with all others, in pairs of
    blocks: a group of near copies has few or none of them, whatever its size.
    """
    label = F.struct(*LABEL)
    block = lambda n: F.pmod(F.xxhash64("f"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # the first of each block, and then of these
    least = lambda rows, by: rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("f"), "f"))).filter(F.col("r") <= PIVOTS).drop("r")
    pivots = least(least(big.withColumn("own", block("blocks")), ["p", "own"]), ["p"]).drop("own")
    spread = pivots.select("*", every("blocks").alias("i"), F.lit(1).alias("side"))
    spread = spread.unionByName(big.select("*", block("blocks").alias("i"), F.lit(2).alias("side"))).drop("n", "blocks")
    first = written(tasked(texts, spread, F.concat_ws(":", "p", "i"), num, den, width), "pivots")

    named = components(ends(first)).select(F.col("node"), F.col("root"))
    now = big.withColumn("node", F.struct(F.col("lz").alias("z"), F.col("lk").alias("k"), F.col("lf").alias("f"))).join(named, "node", "left").withColumn("r", F.coalesce("root", "node"))
    now = written(now.select("p", "f", "n", "home", "blocks", F.col("r.z").alias("lz"), F.col("r.k").alias("lk"), F.col("r.f").alias("lf")), "large")
    most = now.groupBy("p", *LABEL).agg(F.count("*").alias("c")).groupBy("p").agg(F.max_by(label, F.struct("c", *LABEL)).alias("top"))
    now = now.join(written(most, "largest"), "p")
    open_ = now.filter(label != F.col("top")).drop("top")
    parts = written(open_.groupBy("p").agg(F.ceil(2 * F.count("*") / task_members).cast("int").alias("parts")), "open")
    probes = open_.join(parts, "p").select("*", every("blocks").alias("i"), block("parts").alias("j"), F.lit(1).alias("side"))
    others = now.drop("top").join(parts, "p").select("*", block("blocks").alias("i"), every("parts").alias("j"), F.lit(2).alias("side"))
    pairs = probes.unionByName(others).drop("n", "blocks", "parts")
    return first.unionByName(tasked(texts, pairs, F.concat_ws(":", "p", "i", "j"), num, den, width))


def links_of(texts: DataFrame, places: DataFrame, num: int, den: int, width: int, task_bytes: int, task_members: int) -> DataFrame:
    """The links of all regions of places (p, f, n, home, label); regions of one member have none."""
    size = places.groupBy("p").agg(F.sum(F.col("n") * 8 + 64).alias("bytes"), F.count("*").alias("m")).filter("m > 1")
    blocks = F.greatest(F.ceil(2 * F.col("bytes") / task_bytes), F.ceil(2 * F.col("m") / task_members)).cast("int")
    size = written(size.select("p", F.when((F.col("bytes") <= task_bytes) & (F.col("m") <= task_members), 1).otherwise(blocks).alias("blocks")), "sizes")
    placed = places.join(size, "p")
    found = tasked(texts, placed.filter("blocks = 1").drop("n", "blocks").withColumn("side", F.lit(0)), F.col("p").cast("string"), num, den, width)
    if size.filter("blocks > 1").isEmpty():
        return found
    return found.unionByName(large_links(texts, placed.filter("blocks > 1"), num, den, width, task_members))


def labelled(docs: DataFrame, num: int = 80, den: int = 100, width: int = 5, id_col: str = "doc_id", text_col: str = "text", part_entries: int = 1_000_000, task_bytes: int = 16 << 20, task_members: int = 1024) -> DataFrame:
    """(z, k, h, n, rz, rk, rf) for every row: its id (with z, a hash of its text instead), the text's hash, the set's size, and the least (z, k) that it reaches, with its set's hash."""
    spark, mark = docs.sparkSession, len(since(0))
    key, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    rows = docs.select(key.isNull().alias("z"), F.coalesce(key, F.xxhash64(text)).alias("k"), F.xxhash64(text).alias("h"), text.alias("t"))
    hashed = written(set_rows(rows, width), "sets")
    sketch = spark.sparkContext.broadcast(shingle_sketch(hashed))
    sized = hashed.filter("kind = 0").select("z", "k", "h", "n", "f")
    classes = written(sized.filter("n > 0").groupBy("f", "n").agg(F.min(F.struct("z", "k")).alias("id"), F.min("h").alias("h")).select("f", "n", "id.z", "id.k", "h"), "classes")
    total = classes.agg(F.coalesce(F.sum(F.expr(f"n - ceil(n * {num} / {den}) + 1")), F.lit(0)).alias("e")).first().e
    parts = max(1, int(total) // part_entries + 1)

    member = written(memberships(prefix_entries(rows, sketch, width, num, den, parts, 4 * part_entries), parts, num, den), "regions")
    homes = member.groupBy("f", "n").agg(F.max_by("p", F.struct("votes", -F.col("p"))).alias("home"))
    wanted = classes.join(homes, ["f", "n"]).select("f", "n", "z", "k", "home", "h")
    texts = written(packed_texts(rows).join(wanted.select("f", "h"), "h").drop("h"), "texts")

    def links(places: DataFrame) -> DataFrame:
        return written(links_of(texts, places, num, den, width, task_bytes, task_members), "links")

    # members of one home first
    at_home = homes.select(F.col("home").alias("p"), "f", "n", F.lit(None).cast("long").alias("home")).join(classes.select("f", F.col("z").alias("lz"), F.col("k").alias("lk"), F.col("f").alias("lf")), "f")
    inner = links(at_home)
    label = inner.groupBy(F.col("af").alias("f")).agg(F.min(F.struct("bz", "bk", "bf")).alias("l"))
    known = wanted.join(label, "f", "left").select("f", "home", F.coalesce("l.bz", "z").alias("lz"), F.coalesce("l.bk", "k").alias("lk"), F.coalesce("l.bf", "f").alias("lf"))
    crossing = member.drop("votes").join(known, "f")
    crossing = written(crossing, "crossing")
    several = crossing.groupBy("p").agg(F.min("home").alias("h0"), F.max("home").alias("h1"), F.min(F.struct("lz", "lk", "lf")).alias("l0"), F.max(F.struct("lz", "lk", "lf")).alias("l1"))
    # a table of its own: the join with it may be split where a region has many members
    crossing = crossing.join(written(several.filter("h0 <> h1 and l0 <> l1").select("p"), "several"), "p")
    outer = links(crossing)

    named = components(ends(inner.unionByName(outer)))
    roots = classes.withColumn("node", F.struct("z", "k", "f")).join(named, "node", "left").select("f", "n", F.coalesce("root", "node").alias("r"))
    roots = written(roots.select("f", "n", F.col("r.z").alias("rz"), F.col("r.k").alias("rk"), F.col("r.f").alias("rf")), "roots")
    drop(spark, [path for path in since(mark) if path not in (hashed._written_path, roots._written_path)])
    out = sized.join(roots, ["f", "n"], "left")
    return out.select("z", "k", "h", "n", F.coalesce("rz", "z").alias("rz"), F.coalesce("rk", "k").alias("rk"), F.coalesce("rf", F.lit(0)).alias("rf"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row: the components of all links."""
    out = labelled(docs, id_col=id_col, **options)
    return out.select(F.when(~F.col("z"), F.col("k")).alias(id_col), F.col("n").alias("n_shingles"), F.when(~F.col("rz"), F.col("rk")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without near copies: of each component the row with the least id (without ids: text hash), then text hash.

    Rows without words are components of their own and all stay; of equal rows (id and text) one stays.
    """
    found = labelled(docs, id_col=id_col, text_col=text_col, **options)
    first = found.filter("n > 0").groupBy("rz", "rk", "rf").agg(F.min(F.struct("z", "k", "h")).alias("v")).select("v.*")
    first = first.unionByName(found.filter("n = 0").select("z", "k", "h").distinct())
    key, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    names = [f"__{c}" for c in ("z", "k", "h")]
    rows = docs.withColumns(dict(zip(names, (key.isNull(), F.coalesce(key, F.xxhash64(text)), F.xxhash64(text)))))
    rows = rows.join(first.select(*(F.col(c).alias(f"__{c}") for c in ("z", "k", "h"))), names, "left_semi")
    bare = ~F.coalesce(text, F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    place = F.row_number().over(Window.partitionBy(*names).orderBy(F.xxhash64(*others)))
    return rows.withColumn("__n", F.when(bare, 1).otherwise(place)).filter("__n = 1").select(*(f"`{c}`" for c in docs.columns))


def op2_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), runs AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM runs
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM items x JOIN items y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, pairs.b FROM reach JOIN pairs ON pairs.a = reach.r
)
SELECT runs.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(r) AS component_id FROM runs JOIN reach USING (doc_id) GROUP BY runs.doc_id, len(s)
"""
