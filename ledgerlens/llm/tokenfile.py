"""Token ids as compact binary files.

Texts are encoded by a public tokenizer (its library encodes every distinct run of letters or others once
per worker, within a bounded cache; no piece of this vocabulary spans white space, so the runs' ids
follow each other as in the whole text).  Ids are counted over all documents, a canonical
length-limited Huffman code is built from the counts, and documents are written in ascending id
order as segments: self-contained byte strings with the code lengths, a table of documents and their
bits.  Every document is an independent block that starts at a byte, with a bit-offset checkpoint
every 64 ids; decoding looks up 16 bits at a time, for all checkpoints of a segment at once.

Segments are rows of a Parquet table in the shared folder, a few MB each, ordered by (part, seq).

Defined cases: a null or empty text holds the end id alone; rows with equal or null ids are kept,
nulls first, ties in order of their content; an empty table gives no segments.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import drop, table, trim, written
from ledgerlens.llm.hashtable import HashTable
from ledgerlens.llm.shingles import blocks, run_hashes

LIMIT, STRIDE, MAGIC = 16, 64, b"LLTOK001"
CACHE_WORDS, LEARN = 800_000, 2048


# ---- the code ----


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths (at most limit) of an optimal prefix code for the used symbols, by package-merge."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.int64)
    merges, weight = [], leaf
    for _ in range(limit - 1):
        pairs = len(weight) // 2
        packed = weight[: 2 * pairs].reshape(-1, 2).sum(1)
        both = np.concatenate([leaf, packed])
        at = np.argsort(both, kind="stable")
        merges.append(at < len(leaf))
        weight = both[at]
    take, depth = 2 * len(order) - 2, np.zeros(len(order), np.int64)
    for is_leaf in reversed(merges):
        leaves = int(is_leaf[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    depth[:take] += 1
    lengths[order] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol)."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        size = lengths[order].astype(np.int64)
        space = np.left_shift(1, LIMIT - size)
        codes[order] = (np.concatenate([[0], np.cumsum(space)[:-1]]) >> (LIMIT - size)).astype(np.uint64)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length for each prefix of LIMIT bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    space = np.left_shift(1, LIMIT - lengths[order].astype(np.int64))
    symbol, size = np.zeros(1 << LIMIT, np.uint32), np.ones(1 << LIMIT, np.uint8)
    symbol[: space.sum()] = np.repeat(order, space)
    size[: space.sum()] = np.repeat(lengths[order], space)
    return symbol, size


def encode(ids: np.ndarray, bounds: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Bits of the documents ids[bounds[k]:bounds[k+1]], the byte offset of each, and the bit lengths of all full strides."""
    size = lengths[ids].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    room = -(-(ends[bounds[1:]] - ends[bounds[:-1]]) // 8)
    starts = np.concatenate([[0], np.cumsum(room)])
    at = ends[:-1] + np.repeat(starts[:-1] * 8 - ends[bounds[:-1]], np.diff(bounds))
    word, off = at >> 5, (at & 31).astype(np.uint64)
    value = codes[ids] << (np.uint64(64) - off - size.astype(np.uint64))
    words = (int(starts[-1]) + 3) // 4 + 1
    # bits of different codes never overlap, so sums (exact below 2**53) stand for ORs
    packed = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), words + 1) + np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), words + 1)
    marks = stride_marks(bounds)
    return packed.astype(np.uint32).astype(">u4").tobytes()[: int(starts[-1])], starts, (ends[marks] - ends[marks - STRIDE]).astype(np.uint16)


def stride_marks(bounds: np.ndarray) -> np.ndarray:
    """Ends of the full strides before each document's last checkpoint."""
    inner = np.maximum(0, (np.diff(bounds) - 1) // STRIDE)
    first = np.repeat(np.concatenate([[0], np.cumsum(inner)[:-1]]), inner)
    return np.repeat(bounds[:-1], inner) + (np.arange(inner.sum()) - first + 1) * STRIDE


def decode(bits: bytes, counts: np.ndarray, starts: np.ndarray, strides: np.ndarray, symbol: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ids of all documents: every checkpoint is a lane, one table lookup a step for all lanes."""
    data = np.frombuffer(bits + b"\0\0\0\0", np.uint8).astype(np.uint32)
    window = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    lanes = -(-counts // STRIDE)
    doc = np.repeat(np.arange(len(counts)), lanes)
    nth = np.arange(lanes.sum()) - np.repeat(np.concatenate([[0], np.cumsum(lanes)[:-1]]), lanes)
    step = np.zeros(len(doc), np.int64)
    step[nth > 0] = strides
    run = np.cumsum(step)
    at = run - np.repeat(run[np.flatnonzero(nth == 0)], lanes[lanes > 0]) + starts[doc] * 8
    left = np.minimum(STRIDE, counts[doc] - nth * STRIDE)
    out = np.empty((STRIDE, len(doc)), symbol.dtype)
    for k in range(STRIDE):
        # lanes that have ended read padding, which is cut below
        found = window[np.minimum(at >> 3, len(window) - 1)] >> (8 - (at & 7)).astype(np.uint32) & 0xFFFF
        out[k] = symbol[found]
        at = at + size[found]
    return out.T[np.arange(STRIDE) < left[:, None]]


# ---- segments ----


def pack_segment(keys: list, counts: np.ndarray, first: int, ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    bounds = np.concatenate([[0], np.cumsum(counts)])
    bits, starts, strides = encode(ids, bounds, codes, lengths)
    known = np.array([k is not None for k in keys], np.uint8)
    parts = [zlib.compress(lengths.tobytes(), 1), known.tobytes(), np.array([k or 0 for k in keys], "<i8").tobytes(), counts.astype("<i8").tobytes(), starts.astype("<i8").tobytes(), strides.astype("<u2").tobytes(), bits]
    return MAGIC + struct.pack(f"<qq{len(parts)}q", len(keys), first, *map(len, parts)) + b"".join(parts)


_TABLES: dict[bytes, tuple] = {}


def unpack_segment(segment: bytes) -> tuple[list, np.ndarray, int, np.ndarray]:
    """Keys, id counts, the number of ids before the segment in its part, and all ids."""
    if segment[:8] != MAGIC:
        raise ValueError("not a token segment")
    _, first, *sizes = struct.unpack_from("<9q", segment, 8)
    parts, at = [], 8 + 72
    for s in sizes:
        parts.append(segment[at : at + s])
        at += s
    if parts[0] not in _TABLES:
        _TABLES.clear()
        _TABLES[parts[0]] = decoding_table(np.frombuffer(zlib.decompress(parts[0]), np.uint8))
    keys = [k if known else None for k, known in zip(np.frombuffer(parts[2], "<i8").tolist(), parts[1])]
    counts = np.frombuffer(parts[3], "<i8")
    ids = decode(parts[6], counts, np.frombuffer(parts[4], "<i8")[:-1], np.frombuffer(parts[5], "<u2").astype(np.int64), *_TABLES[parts[0]])
    return keys, counts, first, ids


# ---- texts to ids ----


# Fixed byte classes: 0 white space, 1 letters (and all bytes of other characters), 2 anything else.
_CLASS = np.full(256, 2, np.int8)
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_CLASS_OF_WORDS = np.minimum(_CLASS, 1)


def plain(data: np.ndarray) -> bool:
    """Only ASCII and Latin-1 letters beyond it, and nothing that joins letters with other characters."""
    high = data >= 0x80
    if high.any():
        lead = data >= 0xC0
        if (data[lead] != 0xC3).any() or np.isin(data[1:][data[:-1] == 0xC3], [0x97, 0xB7]).any():
            return False
    return not (data == 0x27).any()


class CachedEncoder:
    """Ids of texts; the ids of each run of letters or of other characters are kept in flat arrays.

    A run is found by a 64-bit hash in a table of open addresses.  In texts with other characters than
    ASCII and Latin-1, or with apostrophes, a run is all between white space; texts with the mark of a
    special token go to the library whole.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.forget()

    def forget(self) -> None:
        self.table = HashTable(self.limit)
        self.flat, self.used, self.offsets = np.zeros(1 << 16, self.kind), 0, np.zeros(1, np.int64)

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        sizes, parts = [], []
        for k in range(0, len(words), LEARN):  # the library's results are large objects
            found = [e.ids for e in self.tokenizer.encode_batch_fast(words[k : k + LEARN], add_special_tokens=False)]
            sizes += map(len, found)
            parts.append(np.fromiter(chain.from_iterable(found), self.kind, sum(map(len, found))))
        sizes, ids = np.array(sizes, np.int64), np.concatenate(parts)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        rows = np.arange(len(self.offsets) - 1, len(self.offsets) - 1 + len(keys), dtype=np.int32)
        self.offsets = np.concatenate([self.offsets, self.used + np.cumsum(sizes)])
        self.used += len(ids)
        self.table.add(keys, rows)

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows in data (a space after each row), and how many each row has."""
        if ((data[:-1] == 0x3C) & (data[1:] == 0x7C)).any():  # the mark of a special token
            raw = data.tobytes()
            found = [e.ids for e in self.tokenizer.encode_batch_fast([raw[a : b - 1].decode() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())], add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(chain.from_iterable(found), self.kind, int(sizes.sum())), sizes
        kind = (_CLASS if plain(data) else _CLASS_OF_WORDS)[data]
        change = np.flatnonzero(np.diff(kind, prepend=np.int8(0)))
        inside = kind[change] != 0
        start = change[inside]
        stop = np.append(change[1:], len(data))[inside]
        edge = np.empty(2 * len(start), np.int64)
        edge[0::2], edge[1::2] = start, stop
        keys = run_hashes(data, edge)
        keys[keys == 0] = 1
        rows = self.table.find(keys)
        if len(missing := np.flatnonzero(rows < 0)):
            new, first = np.unique(keys[missing], return_index=True)
            if len(self.offsets) + len(new) > self.limit:
                self.forget()
                new, missing = np.unique(keys, return_index=True)
                first = np.arange(len(missing))
            self.learn(new, [data[start[k] : stop[k]].tobytes().decode() for k in missing[first].tolist()])
            rows = self.table.find(keys)
        begin, size = self.offsets[rows], self.offsets[rows + 1] - self.offsets[rows]
        after = np.cumsum(size)
        ids = self.flat[np.repeat(begin - after + size, size) + np.arange(after[-1] if len(after) else 0)]
        last = np.searchsorted(start, ends)
        return ids, np.diff(np.concatenate([[0], after])[np.concatenate([[0], last])])


_ENCODERS: dict[str, CachedEncoder] = {}


def encoder(path: str) -> CachedEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = CachedEncoder(path)
    return _ENCODERS[path]


def write_token_file(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 16 << 20, segment_ids: int = 250_000) -> tuple[DataFrame, DataFrame]:
    """Encodes and writes all texts.

    Returns the written segments (part, seq, segment) and the parts' first ids (part, base).
    """
    key, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    rows = docs.select(key.alias("k"), text.alias("t"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first().b
    parts = max(1, -(-int(total) // part_bytes))

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        kind, counts = enc.kind, np.zeros(max(enc.size, end_id + 1), np.int64)
        for batch in batches:
            row = 0
            for n, data, rows_end in blocks(batch.column(1), 1 << 20):
                ids, sizes = enc.encode(data, rows_end)
                ids = np.insert(ids, np.cumsum(sizes), end_id)
                counts += np.bincount(ids, minlength=len(counts))
                ends = np.cumsum(sizes + 1)
                offsets = pa.py_buffer((np.concatenate([[0], ends]) * kind.itemsize).astype(np.int32))
                blobs = pa.BinaryArray.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, bool)), batch.column(0).slice(row, n), pa.array(sizes + 1, pa.int64()), blobs], ["sums", "k", "n", "ids"])
                row += n
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([True]), pa.nulls(1, pa.int64()), pa.array([len(counts)], pa.int64()), pa.array([counts.tobytes()], pa.binary())], ["sums", "k", "n", "ids"])

    tokens = written(rows.mapInArrow(tokenize, "sums boolean, k long, n long, ids binary").withColumn("c", F.crc32("ids")), "tokens")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for blob in batch.column(0):
                own = np.frombuffer(blob.as_py(), np.int64)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["ids"])

    # at most 8 rows of one count a vocabulary entry come to the driver
    sums = [np.frombuffer(r.ids, np.int64) for r in tokens.filter("sums").select("ids").repartition(8).mapInArrow(add, "ids binary").collect()]
    lengths = code_lengths(np.sum(sums, axis=0) if sums else np.ones(1, np.int64))
    codes, kind = canonical(lengths), np.dtype("<u2" if len(lengths) <= 1 << 16 else "<u4")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before, held, keys, counts, blobs = TaskContext.get().partitionId(), 0, 0, 0, [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal keys, counts, blobs, held, seq, before
            ids = np.frombuffer(b"".join(blobs), kind)
            row = (part, seq, len(ids), pack_segment(keys, np.array(counts, np.int64), before, ids, codes, lengths))
            seq, before, held, keys, counts, blobs = seq + 1, before + len(ids), 0, [], [], []
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["part", "seq", "n", "segment"])

        for batch in batches:
            for k, n, blob in zip(*(batch.column(c).to_pylist() for c in range(2)), batch.column(2)):
                if keys and held >= segment_ids:
                    yield flush()
                keys.append(k)
                counts.append(n)
                blobs.append(blob.as_py())
                held += n
        if keys:
            yield flush()
        trim()

    # ranges of ids in order, a task each; rows that share an id are told apart by their tokens, so that they may lie in several
    order = [F.col("k").asc_nulls_first(), F.col("n"), F.col("c")]
    ordered = tokens.filter("not sums").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    segments = written(ordered.select("k", "n", "ids").mapInArrow(pack, "part int, seq long, n long, segment binary"), "segments")
    drop(rows.sparkSession, [tokens._written_path])
    sizes = segments.groupBy("part").agg(F.sum("n").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return segments.drop("n"), sizes.select("part", base.cast("long").alias("base"))


def read_token_file(segments: DataFrame, bases: DataFrame, id_col: str = "doc_id", ids: bool = True) -> DataFrame:
    """id_col, start, n_tokens, ids_crc32 and, with ids, the decoded ids of every document."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, segment in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, counts, first, found = unpack_segment(segment.as_py())
                raw, ends = found.astype("<u4"), np.cumsum(counts)
                view = memoryview(raw).cast("B")
                crcs = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
                del segment
                columns = [pa.array([part] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(first + ends - counts), pa.array(counts), pa.array(crcs, pa.int64())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(raw.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["part", "k", "s", "n_tokens", "ids_crc32", "ids"][: len(columns)])
        trim()

    schema = "part int, k long, s long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    rows = segments.select("part", "segment").mapInArrow(unpack, schema).join(bases, "part")
    return rows.select(F.col("k").alias(id_col), (F.col("s") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def op4_token_file(spark, sf_dir):
    import public_tokenizers

    files = write_token_file(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read_token_file(*files, ids=False)
