"""SentencePiece segmentations sampled without replacement, and their decoding.

The lattice of a text has a node at each byte and an edge for each piece of the vocabulary that matches
there; a character that is no piece has its bytes as edges.  A path's weight is the exponential of
alpha times the sum of its pieces' scores.  Where no piece of the vocabulary holds the two bytes side
by side, no edge can cross, so the lattice of a text is a chain of lattices of words, and equal words
share one; words are found, and their lattices built, with numpy for a block of texts at once.

Backward sums give each edge's exact probability at its node.  The best perturbed path is drawn from
them; at every node of it, all other paths that leave there form a branch whose greatest perturbed log
probability is a Gumbel variable cut at that of the path above.  A best-first (A-star) search takes the
branch with the greatest one as the next sample: sampling without replacement, in order, exactly.  The
greatest branch left after the last sample is the threshold, from which come the inclusion
probabilities.  All noise comes from hashes of the row's key, the sample and the place, so that it
depends on nothing but the row.

Defined cases: a null or empty text has no samples; a text with fewer segmentations than samples has
all of them (threshold minus infinity, inclusion 1); rows with equal ids and texts have equal samples;
a null id is a key of its own.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import table, trim
from ledgerlens.llm.hashtable import HashTable
from ledgerlens.llm.shingles import _STEP, _UNSTEP, _odd, _powers, blocks, mix

ALPHA, SAMPLES, SEED, FIXED = 0.0001, 2, 17, 2.0**20
_RAW = _odd(41, 257)
_SPACE_MARK = "▁"


class Vocabulary:
    """Pieces as byte strings (spaces for the space mark), by hash; and the hashes of all their beginnings."""

    def __init__(self, path: str, alpha: float) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        texts, self.byte_ids = [], np.zeros(256, np.int32)
        weights = np.zeros(count)
        for i in range(count):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                texts.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                texts.append(b"")
            else:
                texts.append(piece.replace(_SPACE_MARK, " ").encode())
                weights[i] = alpha * max(model.get_score(i), -count)
        self.texts = texts
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.sums = np.array([int(byte_sums(np.frombuffer(t, np.uint8))[-1]) for t in texts], np.uint64)
        normal = np.array([i for i in range(count) if len(texts[i]) and not model.is_byte(i)])
        self.weights, self.fallback = weights, float(weights.min()) - 1.0
        keys = np.array([self._hash(texts[i]) for i in normal], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], normal[order].astype(np.int32)
        # the first piece with each value of the upper 22 bits, or the one after the last
        self.slot = np.full(1 << 22, len(keys), np.int32)
        upper = (self.keys >> np.uint64(42)).astype(np.int64)
        self.slot[upper[::-1]] = np.arange(len(keys) - 1, -1, -1, dtype=np.int32)
        self.most_alike = int(np.bincount(upper).max())
        self.keys = np.append(self.keys, np.uint64(0))
        # bytes that stand side by side within some piece
        self.joined = np.zeros(1 << 16, bool)
        for i in normal:
            own = np.frombuffer(texts[i], np.uint8)
            self.joined[own[:-1].astype(np.uint16) << 8 | own[1:]] = True
        self.id_type = np.uint16 if count <= 1 << 16 else np.int32
        self.longest = max(len(texts[i]) for i in normal)
        beginnings = {self._hash(t[:k]) for t in (texts[i] for i in normal) for k in range(1, len(t))}
        # whether a hash may be that of a beginning, by its upper bits
        self.may_begin = np.zeros(1 << 22, bool)
        self.may_begin[np.array(list(beginnings), np.uint64) >> np.uint64(42)] = True

    @staticmethod
    def _hash(text: bytes) -> int:
        data = np.frombuffer(text, np.uint8)
        return int(piece_hash(byte_sums(data)[-1:], _powers(_UNSTEP, 1), len(data))[0])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of those keys that are pieces', and the pieces."""
        at = self.slot[keys >> np.uint64(42)]
        hit = np.flatnonzero(self.keys[at] == keys)
        found = [(hit, self.ids[at[hit]])]
        for k in range(1, self.most_alike):
            more = np.flatnonzero(at + k < len(self.ids))
            more = more[self.keys[at[more] + k] == keys[more]]
            found.append((more, self.ids[at[more] + k]))
        where, ids = (np.concatenate(x) for x in zip(*found))
        return where, ids


def run_hash(data: np.ndarray, start: np.ndarray, stop: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """Hashes of data[start:stop], by prefix sums."""
    sums = byte_sums(data) if sums is None else sums
    return mix((sums[stop] - sums[start]) * _powers(_UNSTEP, len(data) + 1)[start] + (stop - start).astype(np.uint64) * _RAW[256])


def piece_hash(sums: np.ndarray, unstep: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n bytes from differences of prefix sums."""
    return sums * unstep + np.uint64(n * int(_RAW[256]) & (1 << 64) - 1)


def byte_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_RAW[data] * _powers(_STEP, len(data)), out=sums[1:])
    return sums


class Lattice:
    """The lattices of some words of a text: a node for each word and number of bytes left to its end.

    Words are numbered by falling length, so that the nodes with the same number of bytes left follow
    each other by word, and edges sorted by their source are in the order of the backward sums.
    """

    def __init__(self, data: np.ndarray, sums: np.ndarray, start: np.ndarray, stop: np.ndarray, vocab: Vocabulary) -> None:
        lengths = stop - start
        falling = np.argsort(-lengths, kind="stable")
        number = np.empty(len(start), np.int64)
        number[falling] = np.arange(len(start))
        stop, lengths = stop[falling], lengths[falling]
        longest = int(lengths[0]) if len(lengths) else 0
        having = np.searchsorted(-lengths, -np.arange(1, longest + 1), "right")  # words with at least that many bytes
        base = np.concatenate([[0, len(start)], len(start) + np.cumsum(having)])
        nodes = int(base[-1])
        left = np.repeat(np.arange(1, longest + 1), having)
        word = np.arange(nodes - len(start)) - np.repeat(base[1:-1] - len(start), having)
        at = stop[word] - left
        self.first = (base[lengths] + np.arange(len(start)))[number]  # each word's first node, in the given order
        text = data[at]
        lead = (text & 0xC0) != 0x80
        size = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
        alive = np.flatnonzero(lead).astype(np.int32)
        single = np.zeros(len(at), bool)  # the character is a piece
        found: list[tuple] = []
        begin = sums[at]
        unstep = _powers(_UNSTEP, len(data) + 1)[at]
        for n in range(1, vocab.longest + 1):
            alive = alive[left[alive] >= n]
            if not len(alive):
                break
            keys = piece_hash(sums[at[alive] + n] - begin[alive], unstep[alive], n)
            where, ids = vocab.find(keys)
            if len(where):
                where = alive[where]
                single[where[size[where] == n]] = True
                found.append((where, n, ids, vocab.weights[ids]))
            alive = alive[vocab.may_begin[keys >> np.uint64(42)]]
        # bytes of characters that are no piece: edges of one byte, one after the other
        bare = np.flatnonzero(lead & ~single)
        follow = [bare[size[bare] > k] for k in range(4)]
        inner = np.concatenate([base[left[f] - k] - len(start) + word[f] for k, f in enumerate(follow)])
        inner.sort()
        found.append((inner, 1, vocab.byte_ids[text[inner]], np.full(len(inner), vocab.fallback)))
        # longer pieces first, as they are the likelier ones; merging sorted runs is cheap
        source = np.concatenate([f[0] for f in reversed(found)])
        order = np.argsort(source, kind="stable")
        source = source[order] + len(start)
        step = np.repeat([f[1] for f in reversed(found)], [len(f[0]) for f in reversed(found)])[order]
        self.piece = np.concatenate([f[2] for f in reversed(found)])[order]
        weight = np.concatenate([f[3] for f in reversed(found)])[order]
        inside = source - len(start)
        target = base[left[inside] - step] + word[inside]
        beta = np.full(nodes, -np.inf)
        beta[: len(start)] = 0.0
        head = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1]])) if len(source) else np.zeros(0, np.int64)
        owner = source[head]
        head_at = np.searchsorted(owner, base[1:])
        edge_at = np.append(head, len(source))[head_at]
        for k in range(longest):
            a, b = edge_at[k], edge_at[k + 1]
            if b > a:
                beta[owner[head_at[k] : head_at[k + 1]]] = np.logaddexp.reduceat(weight[a:b] + beta[target[a:b]], head[head_at[k] : head_at[k + 1]] - a)
        # whole multiples of 1 / FIXED: sums of these are exact in any order
        fixed = np.clip(np.round((weight + beta[target] - beta[source]) * FIXED), -(2.0**31) + 1, 0)
        self.log_share = fixed.astype(np.int32)
        share = np.exp(fixed / FIXED)
        self.target, self.step, self.piece = target.astype(np.int32), step.astype(np.uint8), self.piece.astype(vocab.id_type)
        self.begin = np.zeros(nodes + 1, np.int32)
        self.begin[1:] = np.cumsum(np.bincount(source, minlength=nodes))
        # sums of shares up to each edge within its node, and what its other edges have (0 where there are none)
        many = np.diff(np.append(head, len(source)))
        # (in whole numbers, which wrap: the same whatever stands before the node)
        before = np.concatenate([np.zeros(1, np.uint64), np.cumsum((share * 2.0**53).astype(np.uint64), dtype=np.uint64)])
        self.upto = np.minimum(before[1:] - np.repeat(before[head], many) >> np.uint64(21), np.uint64(2**32 - 1)).astype(np.uint32)
        top = np.maximum.reduceat(share, head) if len(head) else share
        is_top = np.flatnonzero(share == np.repeat(top, many))
        first_top = np.zeros(len(source), bool)
        of = np.repeat(np.arange(len(head)), many)[is_top]
        first_top[is_top[np.concatenate([[True], of[1:] != of[:-1]])] if len(of) else is_top] = True
        rest = np.add.reduceat(np.where(first_top, 0.0, share), head) if len(head) else share
        self.others = np.where(first_top, np.repeat(rest, many), np.repeat(rest + top, many) - share).astype(np.float32)


def source_of(lattice: Lattice | Store, edge: np.ndarray) -> np.ndarray:
    """The node that each edge leaves."""
    return np.searchsorted(lattice.begin, edge, "right") - 1


def logs_of(lattice: Lattice | Store, edge: np.ndarray) -> np.ndarray:
    """The edges' log shares."""
    return lattice.log_share[edge] / FIXED


class Store:
    """Lattices of the words seen lately, one after the other; emptied when they hold most_edges.

    An edge takes 16 bytes.  A block of rows that needs more room has it for that block alone.  New
    words are built about WORD_BYTES of them at a time, which bounds what is made on the way.
    """

    PARTS = ("target", "step", "piece", "log_share", "upto", "others")
    WORD_BYTES = 1 << 16

    def __init__(self, vocab: Vocabulary, most_edges: int = 2_000_000) -> None:
        self.vocab, self.most, self.room = vocab, most_edges, 0
        self.kinds = {"target": np.int32, "step": np.uint8, "piece": vocab.id_type, "log_share": np.int32, "upto": np.uint32, "others": np.float32}
        self.forget()

    def forget(self) -> None:
        """Drops all lattices, and room beyond the usual."""
        self.edges = self.nodes = 0
        self.table = HashTable(self.most // 8)
        if self.room != self.most:
            self.room = self.most
            self.starts = np.zeros(self.room + 1, np.int32)
            for name in self.PARTS:
                setattr(self, name, np.empty(self.room, self.kinds[name]))

    @property
    def begin(self) -> np.ndarray:
        return self.starts[: self.nodes + 1]

    def widen(self, edges: int) -> None:
        self.room = max(edges, self.room + self.room // 2)
        for name in ("starts", *self.PARTS):
            old = getattr(self, name)
            new = np.empty(self.room + (name == "starts"), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def learn(self, text: np.ndarray, sums: np.ndarray, hashed: np.ndarray, start: np.ndarray, stop: np.ndarray, must: bool) -> bool:
        """Adds distinct new words; False if they don't fit and need not."""
        if self.table.count + len(hashed) > self.table.most:
            if not must:
                return False
            self.table = self.table.wider(self.table.count + len(hashed))
        cuts = np.flatnonzero(np.diff(np.cumsum(stop - start) // self.WORD_BYTES, prepend=0, append=-1))
        for a, b in zip(np.concatenate([[0], cuts[:-1]]).tolist(), cuts.tolist()):
            if a == b:
                continue
            own = Lattice(text, sums, start[a:b], stop[a:b], self.vocab)
            e, n = self.edges, self.nodes
            need = max(e + len(own.target), n + len(own.begin))
            if need > self.room:
                if not must:
                    return False
                self.widen(need)
            for name in self.PARTS:
                getattr(self, name)[e : e + len(own.target)] = getattr(own, name) + n if name == "target" else getattr(own, name)
            self.starts[n : n + len(own.begin)] = own.begin + e
            self.edges, self.nodes = e + len(own.target), n + len(own.begin) - 1
            self.table.add(hashed[a:b], (own.first + n).astype(np.int32))
        return True

    def nodes_of(self, text: np.ndarray, sums: np.ndarray, hashed: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The first node of each word text[start:stop]."""
        if self.room > self.most:
            self.forget()
        for must in (False, True):
            out = self.table.find(hashed)
            missing = np.flatnonzero(out < 0)
            if not len(missing):
                return out
            new, at = np.unique(hashed[missing], return_index=True)
            at = missing[at]
            if self.learn(text, sums, new, start[at], stop[at], must):
                break
            self.forget()
        return self.table.find(hashed)


def uniform(key: np.ndarray, sample: int, purpose: int, place: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes."""
    x = mix(key + (place.astype(np.uint64) << np.uint64(8)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((sample * 8 + purpose + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def cut_gumbel(log_mass: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables of the given log masses, at most bound."""
    with np.errstate(divide="ignore", over="ignore"):
        return np.where(np.isneginf(log_mass), -np.inf, log_mass - np.log(np.exp(np.minimum(log_mass - bound, 700.0)) - np.log(u)))


def walk(lattice: Lattice | Store, node: np.ndarray, place: np.ndarray, key: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Draws a path from each node to its word's end: edges in order, their counts, and their places."""
    count = np.zeros(len(node), np.int64)
    steps = []
    active = np.flatnonzero(lattice.begin[node + 1] > lattice.begin[node])
    now, at = node[active], place[active]
    while len(active):
        edge = lattice.begin[now]
        last = lattice.begin[now + 1] - 1
        choice = np.flatnonzero(last > edge)
        u = uniform(key[active[choice]], sample, 0, at[choice])
        chosen, last = edge[choice], last[choice]
        more = np.flatnonzero(u * 2.0**32 > lattice.upto[chosen])
        while len(more):
            chosen[more] += 1
            more = more[chosen[more] < last[more]]
            more = more[u[more] * 2.0**32 > lattice.upto[chosen[more]]]
        edge[choice] = chosen
        steps.append((active, edge, at))
        count[active] += 1
        target = lattice.target[edge]
        going = lattice.begin[target + 1] > lattice.begin[target]
        active, at, now = active[going], (at + lattice.step[edge])[going], target[going]
    start = np.concatenate([[0], np.cumsum(count)[:-1]])
    edges, places = np.empty(int(count.sum()), np.int32), np.empty(int(count.sum()), np.int32)
    for k, (who, edge, at) in enumerate(steps):
        edges[start[who] + k], places[start[who] + k] = edge, at
    return edges, count, places


class Sample:
    """One sample of each text: path, places, sums before each node, and the branches that leave it."""

    def __init__(self, edges, places, bounds, prefix, gumbel) -> None:
        self.edges, self.places, self.bounds, self.prefix, self.gumbel = edges, places, bounds, prefix, gumbel
        self.branch = np.full(len(edges), -np.inf)


def log_prefix(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values before each within its text."""
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return sums[:-1] - np.repeat(sums[bounds[:-1]], np.diff(bounds))


def sample_block(lattice: Lattice | Store, first: np.ndarray, offset: np.ndarray, doc_words: np.ndarray, key: np.ndarray, samples: int) -> tuple[list[Sample], np.ndarray]:
    """The samples of all texts of a block (those that exist have a finite gumbel), and the threshold of each text.

    first: first node of each word of the texts; offset: its byte in its text; doc_words: bounds of the texts.
    """
    docs = len(doc_words) - 1
    doc = np.repeat(np.arange(docs), np.diff(doc_words))
    edges, count, places = walk(lattice, first, offset, key[doc], 0)
    ends = np.concatenate([[0], np.cumsum(count)])
    bounds = ends[doc_words]
    done = [Sample(edges, places, bounds, log_prefix(logs_of(lattice, edges), bounds), -np.log(-np.log(uniform(key, 0, 1, np.zeros(docs)))))]
    taken: list[np.ndarray] = []  # branches' edges that are drawn already: sample's place and edge
    word_ends = ends

    def branch_out(s: Sample, number: int, fresh: np.ndarray) -> None:
        of = np.repeat(np.arange(docs), np.diff(s.bounds))
        others = lattice.others[s.edges[fresh]].astype(np.float64)
        fresh, others = fresh[others > 0], others[others > 0]
        mass = s.prefix[fresh] + np.log(others)
        s.branch[fresh] = cut_gumbel(mass, s.gumbel[of[fresh]], uniform(key[of[fresh]], number, 2, s.places[fresh]))

    def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: the greatest branch, its sample and its place in that sample's arrays."""
        top, which, where = np.full(docs, -np.inf), np.zeros(docs, np.int64), np.zeros(docs, np.int64)
        for number, s in enumerate(done):
            size = np.diff(s.bounds)
            some = np.flatnonzero(size)
            if not len(some):
                continue
            high = np.full(docs, -np.inf)
            high[some] = np.maximum.reduceat(s.branch, s.bounds[:-1][some])
            at = np.flatnonzero(s.branch == np.repeat(high, size))
            of = np.repeat(np.arange(docs), size)[at]
            place = np.zeros(docs, np.int64)
            place[of[::-1]] = at[::-1]
            better = high > top
            top[better], which[better], where[better] = high[better], number, place[better]
        return top, which, where

    branch_out(done[0], 0, np.arange(len(edges)))
    starts = [word_ends]  # of each sample: where each word's edges begin
    for number in range(1, samples):
        top, which, where = best()
        lines, first_new = [], np.zeros(docs, np.int64)
        again = [np.zeros(0, np.int64)]
        live = np.flatnonzero(~np.isneginf(top))
        edge, place, before = np.zeros(docs, np.int64), np.zeros(docs, np.int64), np.zeros(docs)
        for k, s in enumerate(done):
            mine = live[which[live] == k]
            edge[mine], place[mine], before[mine] = s.edges[where[mine]], s.places[where[mine]], s.prefix[where[mine]]
        # the first edge of each new path, among those of its node that no path has taken there
        node = source_of(lattice, edge[live])
        low = lattice.begin[node].astype(np.int64)
        size = lattice.begin[node + 1] - low
        of = np.repeat(np.arange(len(live)), size)
        found = np.arange(len(of)) + np.repeat(low - np.cumsum(size) + size, size)
        mine = (which[live] << 58 | where[live] << 27)[of] + (found - low[of])
        gone = np.isin(mine, np.concatenate(taken)) if taken else np.zeros(len(of), bool)
        gone |= found == edge[live][of]
        mass = np.where(gone, 0.0, np.exp(logs_of(lattice, found)) * 2.0**53).astype(np.uint64)
        sums = np.cumsum(mass, dtype=np.uint64)
        ends_at = np.cumsum(size)
        before_it = np.concatenate([np.zeros(1, np.uint64), sums])[ends_at - size]
        total = sums[ends_at - 1] - before_it
        goal = np.minimum((uniform(key[live], number, 3, place[live]) * total.astype(np.float64)).astype(np.uint64), np.maximum(total, 1) - np.uint64(1))
        over = np.flatnonzero((sums - before_it[of] > goal[of]) & (mass > 0))
        picked = over[np.concatenate([[True], of[over][1:] != of[over][:-1]])] if len(over) else over
        chosen = np.full(docs, -1, np.int64)
        chosen[live[of[picked]]] = found[picked]
        taken.append(mine[picked])
        redraw = uniform(key, number, 4, place)
        left = np.full(docs, -np.inf)  # log mass of what is left of each branch
        with np.errstate(divide="ignore"):
            left[live[of[picked]]] = np.log((total[of[picked]] - mass[picked]).astype(np.float64) * 2.0**-53)
        place_list, chosen_list = place.tolist(), chosen.tolist()
        going = np.flatnonzero(chosen >= 0)
        targets, steps = lattice.target[chosen[going]].astype(np.int64), place[going] + lattice.step[chosen[going]]
        heads = list(zip(going.tolist(), targets.tolist(), steps.tolist()))
        for d in range(docs):
            pick = chosen_list[d]
            if pick < 0:
                lines.append((d, None, None, -1, 0))
                continue
            k, at = int(which[d]), int(where[d])
            s = done[k]
            w = int(np.searchsorted(starts[k], at, "right")) - 1  # the word of the branch
            own = int(s.bounds[d])
            lines.append((d, s.edges[own:at], s.places[own:at], pick, w))
            again.append(np.arange(w + 1, doc_words[d + 1]))
        fresh_gumbel = cut_gumbel(before[live] + left[live], top[live], redraw[live])
        for k, s in enumerate(done):
            mine = which[live] == k
            s.branch[where[live][mine]] = fresh_gumbel[mine]
        # the rest of the branch's word, and all words after it, are drawn anew in one go
        rest_words = np.concatenate(again)
        walkers = np.concatenate([np.array([h[1] for h in heads], np.int64), first[rest_words]])
        at_byte = np.concatenate([np.array([h[2] for h in heads], np.int64), offset[rest_words]])
        who = np.concatenate([np.array([h[0] for h in heads], np.int64), doc[rest_words]])
        new_edges, new_count, new_places = walk(lattice, walkers, at_byte, key[who], number)
        new_ends = np.concatenate([[0], np.cumsum(new_count)])
        parts_e, parts_p, sizes, word_counts = [], [], np.zeros(docs, np.int64), []
        position, head_at = len(heads), 0
        for d, before_e, before_p, pick, w in lines:
            if pick < 0:
                word_counts.append(np.zeros(doc_words[d + 1] - doc_words[d], np.int64))
                continue
            later = doc_words[d + 1] - w - 1
            a, b = new_ends[head_at], new_ends[head_at + 1]
            c, e = new_ends[position], new_ends[position + later]
            parts_e += [before_e, [pick], new_edges[a:b], new_edges[c:e]]
            parts_p += [before_p, place_list[d : d + 1], new_places[a:b], new_places[c:e]]
            first_new[d] = len(before_e) + 1
            sizes[d] = len(before_e) + 1 + b - a + e - c
            old = np.diff(starts[which[d]][doc_words[d] : w + 1])
            in_word = int(where[d]) - int(starts[which[d]][w])
            word_counts.append(np.concatenate([old, [in_word + 1 + b - a], new_count[position : position + later]]))
            head_at, position = head_at + 1, position + later
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        new = np.concatenate(parts_e).astype(np.int64) if parts_e else np.zeros(0, np.int64)
        s = Sample(new, np.concatenate(parts_p).astype(np.int64) if parts_p else np.zeros(0, np.int64), bounds, log_prefix(logs_of(lattice, new), bounds), top)
        inside = np.arange(len(new)) - np.repeat(bounds[:-1], sizes)
        branch_out(s, number, np.flatnonzero(inside >= np.repeat(first_new, sizes)))
        done.append(s)
        starts.append(np.concatenate([[0], np.cumsum(np.concatenate(word_counts))]) if word_counts else np.zeros(1, np.int64))
    return done, best()[0]


def words_of(data: np.ndarray, ends: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bounds in data and the rows' first words: a word begins at a row's start, and wherever no piece can cross."""
    head = np.ones(len(data) + 1, bool)
    head[1:-1] = ~vocab.joined.take(data[:-1].astype(np.uint16) << 8 | data[1:]) & ((data[1:] & 0xC0) != 0x80)
    head[np.concatenate([[0], ends])] = True
    at = np.flatnonzero(head)
    return at[:-1], at[1:], np.searchsorted(at[:-1], np.concatenate([[0], ends]))


_VOCABULARIES: dict[tuple, Vocabulary] = {}
_STORES: dict[tuple, Store] = {}


def vocabulary(path: str, alpha: float) -> Vocabulary:
    if (path, alpha) not in _VOCABULARIES:
        _VOCABULARIES[path, alpha] = Vocabulary(path, alpha)
    return _VOCABULARIES[path, alpha]


def prefixed(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows as the model sees them: a space before each text that isn't empty, none after."""
    sizes = np.diff(np.concatenate([[0], ends])) - 1
    # blocks() puts a space after each row: shifted by one, it stands before the row
    out = np.concatenate([[np.uint8(32)], data[:-1]]) if len(data) else data
    keep = np.repeat(sizes > 0, sizes + 1)
    return out[keep], np.cumsum(np.where(sizes > 0, sizes + 1, 0))


def segment(docs: DataFrame, model_path: str, samples: int = SAMPLES, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, packed: bool = False) -> DataFrame:
    """A row for each sample of each text: id_col, sample (from 1), n_pieces, ids, ids_crc32, log_prob, gumbel, inclusion, round_trip.

    round_trip says that the ids decode to the text.  With packed, ids are little-endian 32-bit numbers in
    one binary value instead of an array.
    """
    rows = docs.select(F.col(f"`{id_col}`"), F.xxhash64(F.lit(seed), F.col(f"`{id_col}`")).alias("__key"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    kinds = f"sample int, n_pieces long, ids {'binary' if packed else 'array<int>'}, ids_crc32 long, log_prob double, gumbel double, inclusion double, round_trip boolean"
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {kinds}"
    names = [id_col, "sample", "n_pieces", "ids", "ids_crc32", "log_prob", "gumbel", "inclusion", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_path, alpha)
        lattice = _STORES.setdefault((model_path, alpha), Store(vocab))
        for batch in batches:
            keys, row = batch.column(1).to_numpy().view(np.uint64), 0
            for n, data, ends in blocks(batch.column(2), 1 << 18):
                text, ends = prefixed(data, ends)
                start, stop, doc_words = words_of(text, ends, vocab) if len(text) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64))
                if len(start):
                    sums = byte_sums(text)
                    hashed = run_hash(text, start, stop, sums)
                    hashed[hashed == 0] = 1
                    first = lattice.nodes_of(text, sums, hashed, start, stop)
                    own = np.concatenate([[0], ends])[:-1]
                    offset = start - np.repeat(own, np.diff(doc_words))
                    found, threshold = sample_block(lattice, first, offset, doc_words, keys[row : row + n], samples)
                    for k, s in enumerate(found):
                        yield table_of(s, k, lattice, vocab, text, sums, ends, threshold, batch.column(0).slice(row, n))
                row += n
        trim()

    def table_of(s: Sample, k: int, lattice: Store, vocab: Vocabulary, text, sums, ends, threshold, ids_column) -> pa.RecordBatch:
        ids = lattice.piece[s.edges].astype(np.int32)
        some = np.flatnonzero(np.diff(s.bounds))
        logs = np.concatenate([[0.0], np.cumsum(logs_of(lattice, s.edges))])
        log_prob = logs[s.bounds[1:]] - logs[s.bounds[:-1]]
        with np.errstate(over="ignore"):
            inclusion = -np.expm1(-np.exp(np.minimum(log_prob - threshold, 700.0)))
        size = vocab.lengths[ids]
        after = np.cumsum(size)
        # the bytes of the pieces, each at its place, as one sum a text: the same as that of the text's own bytes
        begin = np.concatenate([[0], ends])
        bounds = np.concatenate([[0], after])[s.bounds]
        at = after - size - np.repeat(bounds[:-1] - begin[:-1], np.diff(s.bounds))
        whole = np.concatenate([np.zeros(1, np.uint64), np.cumsum(vocab.sums[ids] * _powers(_STEP, len(text) + 1)[np.minimum(at, len(text))], dtype=np.uint64)])
        same = (whole[s.bounds[1:]] - whole[s.bounds[:-1]] == sums[ends] - sums[begin[:-1]]) & (np.diff(bounds) == np.diff(begin))
        raw, little = memoryview(ids.astype("<u4")).cast("B"), s.bounds.tolist()
        crcs = [zlib.crc32(raw[4 * little[d] : 4 * little[d + 1]]) for d in some.tolist()]
        cuts = np.concatenate([[0], s.bounds[1:][some]]).astype(np.int32)
        lists = pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(cuts * np.int32(4)), pa.py_buffer(ids)]) if packed else pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids))
        columns = [ids_column.take(pa.array(some)), pa.array(np.full(len(some), k + 1, np.int32)), pa.array(np.diff(s.bounds)[some]), lists, pa.array(crcs, pa.int64()), pa.array(log_prob[some]), pa.array(s.gumbel[some]), pa.array(inclusion[some]), pa.array(same[some])]
        return pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Adds text_col: the text of each list of ids (control ids are nothing; null for null)."""

    @F.udf("string", useArrow=True)
    def text(ids):
        if ids is None:
            return None
        pieces = vocabulary(model_path, ALPHA).texts
        if isinstance(ids, (bytes, bytearray)):
            ids = np.frombuffer(ids, "<i4").tolist()
        return b"".join(pieces[i] for i in ids).decode("utf-8", "replace").removeprefix(" ")

    return encoded.withColumn(text_col, text(F.col(f"`{ids_col}`")))


def op5_sentencepiece_sampling(spark, sf_dir):
    import public_tokenizers

    return segment(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), packed=True)
