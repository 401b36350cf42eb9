"""Substring dedup by sliding spans of sentences.

A sentence ends at a word that ends in . ! or ? (closing quotes and brackets may follow) or at a line
break; a sentence of more than LONG words is cut again after words whose hash says so, so that the same
passage is cut alike wherever it stands, and what has no such word for 2 * LONG words every LONG words.  From every sentence a span of at least RUN sentences and WORDS
words is hashed (words without regard to the case of A-Z, white space apart).  Spans meet by hash over
the whole table; the first occurrence is that with the least (id, place), and every sentence covered by
another occurrence is removed with the white space after it.

One shuffle carries packed (hash, id, place) records.  Each task forwards only its own first occurrence
of a hash and marks its others at once, so that a span in a third of all documents costs each task one
record.  Texts are joined with their marks afterwards.

Defined cases: null texts stay null, empty ones empty; texts with fewer than RUN sentences or WORDS words
stay; a text all of whose sentences are covered becomes empty; repeats inside one text count; rows with
the same id and text are one occurrence; rows without ids come after all ids, in the order of their
places in the input, each an occurrence of its own.  Columns of the
input named as those made here are replaced; n_chars, where there is one, follows the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import table, trim
from ledgerlens.llm.shingles import _SPACE, _STEP, _UNSTEP, _odd, _powers, blocks, mix, word_hashes

RUN, WORDS, LONG, CUT = 3, 20, 12, 6
RECORD = np.dtype([("h", "<u8"), ("k", "<i8"), ("p", "<i8")])
_END = np.zeros(256, bool)
_END[[0x2E, 0x21, 0x3F]] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[[0x22, 0x27, 0x29, 0x5D]] = True
_MARK = _odd(31, 1)[0]


def sentences(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows in data (a space after each): first word of each sentence, sentence number at which each row starts, word starts, word hashes."""
    start, words = word_hashes(data)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(len(ends) + 1, np.int64), start, words
    stop = np.searchsorted(np.flatnonzero(_SPACE[data]), start)
    stop = np.flatnonzero(_SPACE[data])[stop]
    last = stop - 1
    for _ in range(2):
        last = np.where(_CLOSE[data[last]] & (last > start), last - 1, last)
    row_first = np.searchsorted(start, np.concatenate([[0], ends]))
    breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])
    done = _END[data[last]]
    done[:-1] |= breaks[start[1:]] > breaks[stop[:-1]]
    done[row_first[1:][row_first[1:] > 0] - 1] = True
    head = np.flatnonzero(np.concatenate([[True], done[:-1]]))
    length = np.diff(np.append(head, len(words)))
    done |= (np.repeat(length, length) > LONG) & (words % np.uint64(CUT) == 0)
    head = np.flatnonzero(np.concatenate([[True], done[:-1]]))
    # what has no such word for long (few different words) is cut by places from its start
    length = np.diff(np.append(head, len(words)))
    place = np.arange(1, len(words) + 1) - np.repeat(head, length)
    done |= (np.repeat(length, length) > 2 * LONG) & (place % LONG == 0)
    head = np.flatnonzero(np.concatenate([[True], done[:-1]]))
    return head, np.searchsorted(head, row_first), start, words


def spans(head: np.ndarray, row_at: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first sentence in its row, number of sentences and hash of every span."""
    n = len(head)
    row = np.repeat(np.arange(len(row_at) - 1), np.diff(row_at))
    edge = np.append(head, len(words))
    after = np.maximum(np.arange(n) + RUN, np.searchsorted(edge, edge[:-1] + WORDS, "left"))
    fits = np.flatnonzero(after <= row_at[1:][row]) if n else np.zeros(0, np.int64)
    a, b = edge[fits], edge[after[fits]]
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers(_STEP, len(words)), out=sums[1:])
    hashed = mix((sums[b] - sums[a]) * _powers(_UNSTEP, len(words) + 1)[a] + (b - a).astype(np.uint64) * _MARK)
    return row[fits], fits - row_at[:-1][row[fits]], after[fits] - fits, hashed


def _firsts(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first record of each hash, and all others; equal records are one."""
    records = np.unique(records)
    first = np.concatenate([[True], records["h"][1:] != records["h"][:-1]]) if len(records) else np.zeros(0, bool)
    return records[first], records[~first]


def _marks(records: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(records["k"]), pa.array(records["p"])], ["k", "p"])


def repeated(rows: DataFrame, parts: int, held_records: int = 1_000_000) -> DataFrame:
    """(k, p): the places of all spans but the first of their hash; p = text hash << 40 | sentence << 8 | sentences."""

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, count
            first, others = _firsts(np.concatenate(held))
            held, count = [], 0
            part = (first["h"] % np.uint64(parts)).astype(np.int64)
            at = np.argsort(part, kind="stable")
            first, part = first[at], part[at]
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, np.int64)
            blobs = [first[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
            keys = part[cut[:-1]].tolist() if len(part) else []
            step = 100_000  # marks already known travel with them, in pieces
            done = [others[a : a + step].tobytes() for a in range(0, len(others), step)]
            return pa.RecordBatch.from_arrays(
                [pa.array(keys + [i % parts for i in range(len(done))], pa.int32()), pa.array([False] * len(keys) + [True] * len(done)), pa.array(blobs + done, pa.binary())], ["part", "known", "blob"]
            )

        for batch in batches:
            keys, marks, at = batch.column(0).to_numpy(), batch.column(1).to_numpy(), 0
            for n, data, ends in blocks(batch.column(2)):
                head, row_at, _, words = sentences(data, ends)
                row, first, size, hashed = spans(head, row_at, words)
                own = np.empty(len(row), RECORD)
                own["h"], own["k"] = hashed, keys[at : at + n][row]
                own["p"] = marks[at : at + n][row].astype(np.int64) << 40 | first << 8 | size
                held.append(own)
                count += len(own)
                at += n
                if count >= held_records:
                    yield flush()
        if count:
            yield flush()
        trim()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for known, blob in zip(batch.column(1).to_pylist(), batch.column(2)):
                records = np.frombuffer(blob.as_py(), RECORD)
                if known:
                    yield _marks(records)
                else:
                    held.append(records)
        if held:
            yield _marks(_firsts(np.concatenate(held))[1])
        trim()

    packed = rows.mapInArrow(scatter, "part int, known boolean, blob binary").repartition(parts, "part")
    return packed.mapInArrow(gather, "k long, p long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 12 << 20) -> DataFrame:
    """docs with the text less its repeated sentences, n_sentences, n_removed and removed (spans of code points of the given text)."""
    key, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    made = {"n_sentences", "n_removed", "removed"}
    names = [c for c in docs.columns if c.lower() not in made]
    rows = docs.select(*(f"`{c}`" for c in names), F.coalesce(key, F.monotonically_increasing_id() + (1 << 61)).alias("__k"), F.shiftrightunsigned(F.xxhash64(text), 41).cast("int").alias("__t"))
    thin = rows.filter(text.isNotNull()).select("__k", "__t", text.alias("__text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first().b
    parts = max(1, -(-int(total) // part_bytes))
    marks = repeated(thin, parts).groupBy(F.col("k").alias("__k"), F.shiftrightunsigned("p", 40).cast("int").alias("__t")).agg(F.collect_set("p").alias("__p"))
    joined = rows.join(marks, ["__k", "__t"], "left").select(*(f"`{c}`" for c in names), F.transform("__p", lambda p: p.bitwiseAND((1 << 40) - 1)).alias("__p"))
    schema = docs.select(*(F.col(f"`{c}`").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in names)).withColumns(
        {"n_sentences": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "removed": F.array().cast("array<struct<start:bigint,end:bigint>>")}
    ).schema
    at_text = names.index(text_col)
    at_chars = next((i for i, c in enumerate(names) if c.lower() == "n_chars" and c != text_col), None)
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removals = batch.column(at_text).cast(pa.string()), batch.column(len(names))
            new, counts, removed, out, row = [], [], [], [], 0
            for n, data, ends in blocks(texts):
                head, row_at, start, _ = sentences(data, ends)
                counts += np.diff(row_at).tolist()
                for i in range(n):
                    places = removals[row + i].as_py()
                    if not places:
                        new.append(texts[row + i].as_py())
                        removed.append(0)
                        out.append([])
                        continue
                    begin, size = int(ends[i - 1]) if i else 0, int(row_at[i + 1] - row_at[i])
                    gone = np.zeros(size, bool)
                    for p in places:
                        gone[p >> 8 : (p >> 8) + (p & 255)] = True
                    edge = np.append(start[head[row_at[i] : row_at[i + 1]]], ends[i] - 1) - begin
                    turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    raw = data[begin : int(ends[i]) - 1].tobytes()
                    at, chars, kept, own = 0, 0, [], []
                    for a, b in zip(edge[turn[0::2]].tolist(), edge[turn[1::2]].tolist()):
                        kept.append(raw[at:a].decode())
                        first = chars + len(kept[-1])
                        chars = first + len(raw[a:b].decode())
                        own.append({"start": first, "end": chars})
                        at = b
                    kept.append(raw[at:].decode())
                    new.append("".join(kept))
                    removed.append(int(gone.sum()))
                    out.append(own)
                row += n
            columns = list(batch.columns[: len(names)])
            columns[at_text] = pa.array(new, pa.string())
            if at_chars is not None:
                columns[at_chars] = pa.array([None if t is None else len(t) for t in new], pa.int64()).cast(columns[at_chars].type)
            columns += [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, span_type)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return joined.mapInArrow(cut, schema)


def op6_substring_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
