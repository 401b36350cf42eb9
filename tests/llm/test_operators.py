"""The operators against brute force, round trips and planted cases, on small tables with odd rows."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import html, jaccard, media, mixture, pieces, quality, sharding, spans, tokenfile, topk
from ledgerlens.llm.components import components
from ledgerlens.llm.shingles import shingle_sets

WORD = re.compile("[^\x20\x09-\x0d]+")
LOREM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string"


def texts():
    rng = random.Random(1)
    base = [" ".join(rng.choice(LOREM) + str(rng.randint(0, 60)) for _ in range(rng.randint(3, 120))) for _ in range(40)]
    near = [" ".join(w if rng.random() > 0.02 else "edit" for w in t.split(" ")) for t in base[:20]]
    odd = ["", None, "one", "Two words", "A b c\td\u000be", "café — naïve line ÷× ok", "<|endoftext|> it's 12,3.", "x " * 3000, "word " * 4, "it's İstanbul ΣΑΣ"]
    return base + near + base[:10] + odd


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"s{k % 5}" if k % 11 else None, len(t or ""), 7, "clash") for k, t in enumerate(texts())]
    # texts that share an id are apart: one is a copy of the first text, the other is not
    rows += [(3, texts()[0], "en", "s3", 1, 7, "clash")]
    rows += [(3, texts()[3], "en", "s3", 1, 7, "clash"), (3, "same id other text", "en", "s3", 1, 7, "clash"), (None, "no id here at all today", "en", "s1", 1, 7, "clash")]
    return spark.createDataFrame(rows, SCHEMA)


def shingles(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(sets, num=80, den=100):
    """Least member of each component of all pairs."""
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and den * n >= num * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


def test_shingle_sets_are_those_of_the_words():
    values = texts()
    for width in (1, 5):
        got = [len(s) for s in shingle_sets(pa.array(values), width)]
        assert got == [len({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())) for w in (WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for t in values)]
    assert [len(s) for s in shingle_sets(pa.array(values), 5, block=64)] == [len(shingles(t)) for t in values]


def test_jaccard_join(spark, docs):
    rows = docs.collect()
    want_root = classes([shingles(r.text) for r in rows])
    least = defaultdict(list)
    for k, r in zip(want_root, rows):
        if r.doc_id is not None:
            least[k].append(r.doc_id)
    want = Counter((r.doc_id, len(shingles(r.text)), (min(least[k]) if shingles(r.text) and least[k] else r.doc_id)) for k, r in zip(want_root, rows))
    for options in ({}, {"task_members": 4, "part_entries": 50}):
        assert Counter(map(tuple, jaccard.jaccard_join(docs, **options).collect())) == want


def test_region_join_is_exact_with_pivots_and_cells():
    rng = np.random.default_rng(0)
    sets = []
    for c in range(12):
        core = rng.integers(0, 2**60, 60, dtype=np.uint64)
        for _ in range(40):
            keep = core[rng.random(60) > rng.choice([0.02, 0.1, 0.3])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**60, rng.integers(0, 8), dtype=np.uint64)])))
    sets = [s for s in sets if len(s)]
    region = jaccard.Region(sets, 80, 100)
    region.join(np.arange(len(sets)))
    want = classes([set(x.tolist()) for x in sets])
    assert least_of(region.tree) == want
    # links come from pivots within the threshold and from windows around them; small leaves give few
    assert region.found["pivot"] > 100 and region.found["pivot"] + region.found["ring"] > 0.9 * sum(region.found.values())
    # linked pairs and pairs of one home are taken as decided, all others are found
    homes = rng.integers(0, 3, len(sets))
    inside = [jaccard.Region([sets[i] for i in np.flatnonzero(homes == h)], 80, 100) for h in range(3)]
    trees = np.zeros(len(sets), np.int64)
    for h, own in enumerate(inside):
        own.join(np.arange(len(own.sets)))
        trees[homes == h] = own.tree + 10_000 * h
    crossing = jaccard.Region(sets, 80, 100, trees, homes)
    crossing.join(np.arange(len(sets)))
    assert least_of(crossing.tree) == want


def least_of(tree):
    first = {}
    return [first.setdefault(t, k) for k, t in enumerate(tree.tolist())]


@pytest.mark.parametrize("noise", [0.0, 0.01, 0.03, 0.08])
def test_regions_of_near_copies(noise):
    rng = np.random.default_rng(5)
    core = [f"w{k}" for k in range(300)]
    copies = [" ".join(w if rng.random() > noise else f"x{rng.integers(10**9)}" for w in core) for _ in range(120)]
    sets = list(shingle_sets(pa.array(copies)))
    region = jaccard.Region(sets, 80, 100)
    region.join(np.arange(len(sets)))
    assert least_of(region.tree) == classes([set(x.tolist()) for x in sets])


def test_a_group_too_large_for_a_task(spark):
    """Near copies of one text, of which some are linked only through others; blocks of eight."""
    rng = random.Random(11)
    core = [f"w{k}" for k in range(120)]
    copies = [" ".join(w if rng.random() > noise else f"x{rng.randrange(10**9)}" for w in core) for noise in (0.0, 0.01, 0.02, 0.035) for _ in range(30)]
    frame = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string")
    want = classes([shingles(t) for t in copies])
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_join(frame, task_members=16).collect()}
    assert [got[k] for k in range(len(copies))] == want and 1 < len(set(want)) < 100


def test_list_members_lose_no_link():
    """Brute force: of every linked pair, some list holds both."""
    rng = random.Random(4)
    base = [[rng.randrange(400) for _ in range(rng.randint(1, 60))] for _ in range(60)]
    sets = [set(b) for b in base] + [set(b) ^ {rng.randrange(400) for _ in range(rng.randint(0, 4))} for b in base for _ in range(3)]
    sets = [sorted(x) for x in sets if x]
    for dealt in (False, True):
        rows = []
        for f, own in enumerate(sets):
            for i, x in enumerate(own[: jaccard._prefix(len(own), 80, 100)]):
                rows.append((x, f, len(own), -1 if dealt and x % 3 == 0 else (len(own) - i) * 180 // 80 - len(own)))
        found = jaccard.list_members(np.array(rows, jaccard.ENTRY), 80, 100)
        regions = defaultdict(set)
        for p, f in zip(found[0].tolist(), found[1].tolist()):
            regions[p].add(f)
        meet = {(a, b) for own in regions.values() for a in own for b in own}
        linked = {(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))}
        assert len(linked) > 50 and all((a, b) in meet or sets[a] == sets[b] for a, b in linked)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {k: 0 for k in range(61)} | {100: 100, 101: 100}


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert jaccard.jaccard_join(none).count() == 0
    assert sharding.shard_documents(none).count() == 0
    assert mixture.allot(none).count() == 0
    assert spans.remove_repeats(none).count() == 0
    assert media.text_audio(none).count() == 0
    path = public_tokenizers.path("word_bpe_49k.json")
    assert tokenfile.read_token_file(*tokenfile.write_token_file(none, path)).count() == 0
    assert pieces.segment(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.resample(none, labels).count() == 0 and quality.resample(docs, labels).filter("kept").count() == docs.count()
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.topk(vectors, vectors).count() == 0
    assert html.extract_text(spark.createDataFrame([], "page_id long, html string")).count() == 0


# ---- html ----

PAGE = """<html><head><title>T</title><style>p{}</style><script>"</p>"</script></head><body class="with-sidebar"><header>Site</header><nav><ul><li><a href=x>Menu</a></li></ul></nav>
<div id="cookie-notice"><p>We use cookies on this site, please agree to them now.</p></div><div class="ad">Buy now</div><aside><p>Aside text</p></aside>
<article><h1>Head &amp; shoulders</h1><p>First <b>bold</b>
 paragraph&nbsp;here.<p>Second.<form><label>Mail</label><input></form><p>x &lt; y</p><div class="comments"><p>Reader says hello to all of you out there in a long text.</p></div></article><footer>&copy; me</footer>"""


def test_main_text():
    assert html.main_text(PAGE) == "Head & shoulders\nFirst bold paragraph here.\nSecond.\nx < y"
    assert html.main_text(None) == html.main_text("") == html.main_text("<script>x</script>") == ""
    plain = "<body><div class=menu><a href=a>one</a> <a href=b>two</a></div><div class=post><h2>T</h2><p>Text of the page that is long enough to be content.</p><p>ok</p></div><div id=footer>f</div>"
    assert html.main_text(plain) == "T\nText of the page that is long enough to be content.\nok"


def test_names_around_and_within_an_article():
    wrapped = '<body><div class="layout-sidebar share-on"><article class="post comments-open"><header><h1>H</h1></header><p>a<script>x</script>b</p><div class="newsletter">n</div><p>text</p></article><div class=comments><article><p>a long remark by a reader of this page</p></article></div></div>'
    assert html.main_text(wrapped) == "H\nab\ntext"
    assert html.main_text("<main><p>one<br>two</p><aside>x</aside><table><tr><td>c</td><td>d</td></tr></table><div role=complementary>z</div></main>") == "one\ntwo\nc\nd"


LONG = "A long paragraph of the text, with as many words in it as paragraphs of articles are used to have."


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article><div class="social-science"><p>one</p></div></article>', "one"),
        ('<article><p class="related-work">one</p><p class=notice>two</p><p class="share-price">three</p><div class="ad">x</div><div id=comments>y</div></article>', "one\ntwo\nthree"),
        (f"<div><article><p>I liked it very much.</p></article></div><article><h1>H</h1><p>{LONG}</p></article>", f"H\n{LONG}"),
        (f"<article><h1>H</h1><p>{LONG}</p><article><p>{LONG} I said.</p></article></article>", f"H\n{LONG}"),
        (f"<article><h1>H</h1><p>{LONG}</p></article><article><h2>Also</h2><p>Read on</p></article>", f"H\n{LONG}"),
        ('<article><p>a</p><p hidden="hidden">b</p><p hidden>c</p><p style="color:red; display : none">d</p><p aria-hidden="true">e</p></article>', "a"),
        (f"<nav><ul><li><a href=a>Menu</a><li><a href=b>More</a></ul><article><h1>H</h1><p>{LONG}</article>", f"H\n{LONG}"),
        (f"<form action=x><div><article><p>{LONG}</p></article></div></form>", LONG),
        ("<article><p>a</p><!-- never closed <p>b</p></article>", "a"),
        ("<article><p>a</p><p>b <em>c</em></p><p class='x", "a\nb c"),
        ("<article><p>1 < 2 & 3 &lt; 4 &#8212; &eacute;&nbsp;x</p>", "1 < 2 & 3 < 4 \u2014 \u00e9 x"),
        (f"<head><title>T</title><body><p>{LONG}", LONG),
        (f"<div><p>{LONG}</p><div><ul><li>one</li><li>two</li></ul></div><p>{LONG}</p></div><div>&copy; 2020 by us</div>", f"{LONG}\none\ntwo\n{LONG}"),
        (f"<div class=top><a href=a>Home</a> <a href=b>News</a></div><h1>Title</h1><div><p>{LONG}</p><p>Short.</p></div><div><p>All rights reserved</p></div>", f"Title\n{LONG}\nShort."),
        ("<main><h1>H</h1><p>one<p>two</main><div class='comment'><p>no</p></div>", "H\none\ntwo"),
        (f"<aside><article><p>{LONG}</p></article></aside><main><p>main</p></main>", "main"),
        ("<div hidden><p>x</p></div><script>var a='<p>no</p>'</script>", ""),
        ("</p></div><p>stray", "stray"),
        ("<p>" * 3000 + "deep" + "<div>" * 3000 + "text", "deep\ntext"),
    ],
)
def test_odd_pages(page, text):
    assert html.main_text(page) == text


def test_the_ratio_chooses_the_region():
    """Without articles nothing but the ratio tells a list of short lines from the text."""
    items = "".join(f"<p><b>{w}</b> <i>{w}</i></p>" for w in LOREM)
    page = f"<div>{items}</div><div><p>{LONG}</p><p>{LONG}</p></div><div>{items}</div>"
    assert html.main_text(page) == f"{LONG}\n{LONG}"
    # of two articles, that with more text over the threshold
    assert html.main_text(f"<article>{items}</article><article><p>{LONG}</p><p>{LONG}</p></article>") == f"{LONG}\n{LONG}"
    ratios = [html.smooth(np.array(x)) for x in ([0.0, 0, 10, 0, 0], [3.0] * 7)]
    assert ratios[0].argmax() == 2 and ratios[0][1] == pytest.approx(ratios[0][3]) and ratios[1] == pytest.approx(np.full(7, 3.0))


def test_very_long_pages():
    page = "<article>" + "<p>word &amp; word</p>" * 100_000 + "</article>"
    assert html.main_text(page) == "\n".join(["word & word"] * 100_000)
    assert html.main_text("<article><p>" + "x" * 3_000_000) == "x" * 3_000_000


def test_extract_text_replaces_clashing_columns(spark):
    rows = spark.createDataFrame([(1, PAGE, "old", "keep"), (2, None, "old", "keep")], "page_id long, html string, TEXT string, more string")
    got = {r.page_id: r for r in html.extract_text(rows).collect()}
    assert got[1].more == "keep" and got[1].n_chars == len(got[1].text) > 10 and got[2].text == "" and got[2].n_chars == 0


# ---- shards ----


def spark_hash(seed, *values):
    h = 42
    for v in values + (seed,) if not isinstance(seed, tuple) else values + seed:
        if v is not None:
            raw = struct.pack("<q", v) if isinstance(v, int) and not isinstance(v, np.int32) else struct.pack("<i", int(v))
            h = xxhash.xxh64(raw, seed=h).intdigest()
    return h - 2**64 if h >= 2**63 else h


def fisher_yates(n, *seeds):
    """Slots of records 0 .. n - 1, swapped one after the other in a list."""
    records = list(range(n))
    for i in range(n - 1, 0, -1):
        j = spark_hash((), *seeds, np.int32(i)) % (i + 1)
        records[i], records[j] = records[j], records[i]
    return [records.index(k) for k in range(n)]


def test_sharding(spark, docs):
    options = {"shards": 6, "bucket_rows": 8, "run_rows": 5}
    rows = sharding.shard_documents(docs, **options).collect()
    assert len(rows) == docs.count() and set(rows[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", *sharding.MADE}
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
        assert r.size == len((r.text or "").encode()) + 16 and r.text_crc32 == zlib.crc32((r.text or "").encode()) and r.grown_shard in (r.shard, 6)
        if r.doc_id is not None:
            scores = [spark_hash((np.int32(i), np.int32(7)), r.doc_id) for i in range(7)]
            assert r.shard == scores[:6].index(max(scores[:6])) and (r.grown_shard == 6) == (scores[6] > max(scores[:6]))
    assert sorted(map(str, rows)) == sorted(map(str, sharding.shard_documents(docs.repartition(3), **options).collect()))
    # the slots by brute force: buckets by hash, their order, runs, swaps in a list
    buckets = -(-len(rows) // (6 * 8))
    for shard, own in by.items():
        cells = defaultdict(list)
        for r in own:
            h = spark_hash((), np.int32(8), r.doc_id)
            h = spark_hash((), np.int32(9), h, r.text_crc32, r.size)
            copy = sum(x[0] == h for x in cells[h % buckets])
            cells[h % buckets].append((h, copy, r.slot))
        at = 0
        for bucket in sorted(cells):
            found = sorted(cells[bucket], key=lambda x: spark_hash((), np.int32(10), x[0], np.int32(x[1])))
            want = []
            for run in range(0, len(found), 5):
                moved = fisher_yates(min(5, len(found) - run), np.int32(11), np.int32(shard), np.int32(bucket), np.int32(run // 5))
                want += [at + run + m for m in moved]
            pairs = [sorted((h, slot) for (h, _, _), slot in zip(found, slots)) for slots in (want, [x[2] for x in found])]
            assert pairs[0] == pairs[1]  # equal rows may change places
            at += len(found)


def test_many_rows_of_one_id_and_stored_shards(spark):
    frame = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 700).alias("text"), F.lit(9).alias("SLOT"))
    stored = sharding.stored_shards(sharding.shard_documents(frame, bucket_rows=64))
    rows = stored.collect()
    assert len(rows) == 5000 and sorted(r.slot for r in rows) == list(range(5000)) and len({r.shard for r in rows}) == 1 and "SLOT" not in stored.columns
    texts = [r.text for r in sorted(rows, key=lambda r: r.slot)]
    assert len(set(texts[:700])) > 300


def test_a_task_sorts_one_bucket(spark):
    """Buckets that a hash puts into one task would be sorted together, with their texts."""
    frame = spark.createDataFrame([(k, f"t{k}") for k in range(4000)], "doc_id long, text string")
    tasks = defaultdict(list)
    for r in sharding.shard_documents(frame, shards=8, bucket_rows=64).withColumn("task", F.spark_partition_id()).collect():
        tasks[r.task].append(r.shard)
    assert sum(map(len, tasks.values())) == 4000 and all(len(set(t)) == 1 and len(t) < 2 * 64 for t in tasks.values())


def test_fisher_yates_is_uniform(spark):
    rows = spark.range(1, 40).select(F.col("id").cast("int").alias("n"), F.transform(F.sequence(F.lit(0), F.col("id").cast("int") - 1), lambda k: sharding.shuffled_place(k, F.col("id").cast("int"), F.lit(5))).alias("p")).collect()
    assert all(sorted(r.p) == list(range(r.n)) for r in rows) and any(r.p != sorted(r.p) for r in rows)
    many = spark.range(6000).select(F.array(*[sharding.shuffled_place(F.lit(k), F.lit(3), F.lit(1), F.col("id")) for k in range(3)]).alias("p")).groupBy("p").count().collect()
    assert len(many) == 6 and all(850 < r["count"] < 1150 for r in many)


# ---- token files ----


@pytest.mark.parametrize("seed", range(4))
def test_huffman_round_trip(seed):
    rng = np.random.default_rng(seed)
    counts = (rng.zipf(1.3, 500) * (rng.random(500) > 0.2)).astype(np.int64)
    lengths = tokenfile.code_lengths(counts)
    assert lengths.max() <= 16 and sum(2.0 ** -int(x) for x in lengths if x) <= 1
    used = np.flatnonzero(counts)
    ids = rng.choice(used, 5000).astype("<u2")
    sizes = rng.multinomial(5000, [1 / 9] * 9)
    sizes[4] += sizes[3]
    sizes[3] = 0
    keys, got, first, back = tokenfile.unpack_segment(tokenfile.pack_segment([*range(8), None], sizes, 12, ids, tokenfile.canonical(lengths), lengths))
    assert keys == [*range(8), None] and got.tolist() == sizes.tolist() and first == 12 and np.array_equal(back, ids)


def test_package_merge_is_optimal_where_the_limit_is_loose():
    import heapq

    counts = np.array([5, 9, 12, 13, 16, 45, 0, 1])
    heap = [(int(c), i, [i]) for i, c in enumerate(counts) if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], a[1] + 100, a[2] + b[2]))
    assert int((counts * tokenfile.code_lengths(counts)).sum()) == cost
    tight = tokenfile.code_lengths(np.array([2**k for k in range(30)]))
    assert tight.max() == 16 and sum(2.0 ** -int(x) for x in tight) == 1


def test_token_file(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = {(r.start, r.n_tokens): r for r in tokenfile.read_token_file(*tokenfile.write_token_file(docs, path, part_bytes=4096, segment_ids=300)).collect()}
    assert len(rows) == docs.count()
    at = 0
    want = Counter()
    for r in docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [2]
        want[r.doc_id, zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    order = sorted(rows.values(), key=lambda r: r.start)
    for r in order:
        assert r.start == at and len(r.ids) == r.n_tokens and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        at += r.n_tokens
    assert Counter((r.doc_id, r.ids_crc32) for r in order) == want
    known = [r.doc_id for r in order if r.doc_id is not None]
    assert known == sorted(known) and order[0].doc_id is None


def test_a_small_cache_gives_the_same_ids():
    path = public_tokenizers.path("word_bpe_49k.json")
    small, whole = tokenfile.CachedEncoder(path, limit=40), tokenfile.CachedEncoder(path)
    for t in texts():
        from ledgerlens.llm.shingles import blocks

        for _, data, ends in blocks(pa.array([t])):
            assert small.encode(data, ends)[0].tolist() == whole.encode(data, ends)[0].tolist() == whole.tokenizer.encode(t or "", add_special_tokens=False).ids


# ---- sampled segmentations ----


def test_samples_follow_the_lattice():
    v = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"), 0.0001)
    n = 6000
    from ledgerlens.llm.shingles import blocks, mix

    _, data, ends = next(blocks(pa.array(["ab c\nd"] * n)))
    data, ends = pieces.prefixed(data, ends)
    start, stop, words = pieces.words_of(data, ends, v)
    sums = pieces.byte_sums(data)
    _, first, word = np.unique(pieces.run_hash(data, start, stop, sums), return_index=True, return_inverse=True)
    lattice = pieces.Lattice(data, sums, start[first], stop[first], v)
    offset = start - np.repeat(np.concatenate([[0], ends])[:-1], np.diff(words))
    found, threshold = pieces.sample_block(lattice, lattice.first[word], offset, words, mix(np.arange(n, dtype=np.uint64)), 3)
    paths = [[tuple(lattice.piece[s.edges[s.bounds[d] : s.bounds[d + 1]]].tolist()) for s in found] for d in range(n)]
    by_text = {t: i for i, t in enumerate(v.texts) if t and i not in set(v.byte_ids.tolist())}

    def every(b):
        if not b:
            yield (), 0.0
        for k in range(1, len(b) + 1):
            if b[:k] in by_text:
                yield from (((by_text[b[:k]],) + r, w + v.weights[by_text[b[:k]]]) for r, w in every(b[k:]))
        if b[:1] == b"\n":
            yield from (((int(v.byte_ids[10]),) + r, w + v.fallback) for r, w in every(b[1:]))

    weight = dict(every(b" ab c\nd"))
    total = sum(np.exp(w) for w in weight.values())
    p = {s: np.exp(w) / total for s, w in weight.items()}
    assert all(len(set(x)) == 3 and set(x) <= set(p) for x in paths)
    for k, law in enumerate((p, {s: sum(p[o] * p[s] / (1 - p[o]) for o in p if o != s) for s in p})):
        seen = Counter(x[k] for x in paths)
        assert all(abs(seen[s] / n - law[s]) < 0.03 for s in p)
    mass = np.mean([sum(p[x] / -np.expm1(-np.exp(np.log(p[x]) - threshold[d])) for x in paths[d]) for d in range(n)])
    assert mass == pytest.approx(1, abs=0.02)


def test_segments_decode_to_the_text(spark, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = pieces.segment(docs, path, samples=3)
    got = pieces.decode(rows, path).collect()
    small = pieces.decode(pieces.segment(docs, path, samples=3, packed=True), path).collect()
    assert Counter((r.doc_id, r.sample, tuple(np.frombuffer(r.ids, "<i4").tolist()), r.text) for r in small) == Counter((r.doc_id, r.sample, tuple(r.ids), r.text) for r in got)
    sources = {r.doc_id: r.text for r in docs.collect() if r.doc_id != 3}
    assert all(r.round_trip for r in got) and all(r.text == sources[r.doc_id] for r in got if r.doc_id != 3)
    assert {r.doc_id for r in got if r.doc_id is not None} == {k for k, t in sources.items() if t and k is not None} | {3}
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert all(len({tuple(r.ids) for r in by[k]}) == len(by[k]) <= 3 and [r.gumbel for r in sorted(by[k], key=lambda r: r.sample)] == sorted((r.gumbel for r in by[k]), reverse=True) for k in by if k != 3)
    again = pieces.segment(docs.repartition(7), path, samples=3).collect()
    assert Counter((r.doc_id, r.sample, r.ids_crc32, r.log_prob, r.gumbel) for r in got) == Counter((r.doc_id, r.sample, r.ids_crc32, r.log_prob, r.gumbel) for r in again)


# ---- repeated spans ----


def test_repeated_passages_go_but_for_the_first(spark):
    rng = random.Random(5)
    sentence = lambda: " ".join(rng.choice(LOREM) + str(rng.randint(0, 999)) for _ in range(rng.randint(5, 11))).capitalize() + "."
    passage = " ".join(sentence() for _ in range(8))
    clean = [" ".join(sentence() for _ in range(9)) for _ in range(6)]
    rows = [(k, t) for k, t in enumerate(clean)] + [(10, clean[0][:0] + sentence() + "\n" + passage + "\n" + sentence()), (11, passage), (12, "Intro here. " + passage.upper() + " Outro."), (13, None), (14, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text")).withColumn("removed", F.lit("x"))
    got = {r.doc_id: r for r in spans.remove_repeats(docs).collect()}
    for k, t in rows:
        if k < 11:
            assert got[k].text == t and got[k].n_removed == 0
    assert got[11].text == "" and got[11].n_chars == 0
    assert got[12].text == "Intro here. Outro."
    assert [passage.upper() in rows[8][1][s.start : s.end] for s in got[12].removed] == [True]
    assert got[13].text is None and got[14].text == ""


def brute_spans(rows):
    """The same rule by dictionaries over sentences as sentences() cuts them."""
    from ledgerlens.llm.shingles import blocks

    cut = {}
    for k, t in rows:
        _, data, ends = next(blocks(pa.array([t])))
        head, at, start, words = spans.sentences(data, ends)
        edge = np.append(head, len(words))
        cut[k] = [tuple(words[a:b].tolist()) for a, b in zip(edge[:-1], edge[1:])]
    seen, gone = {}, defaultdict(set)
    for k in sorted(cut):
        for i in range(len(cut[k])):
            j = i + spans.RUN
            while j < len(cut[k]) and sum(map(len, cut[k][i:j])) < spans.WORDS:
                j += 1
            if j <= len(cut[k]) and sum(map(len, cut[k][i:j])) >= spans.WORDS:
                key = tuple(w for s in cut[k][i:j] for w in s)
                if key in seen:
                    gone[k].update(range(i, j))
                else:
                    seen[key] = (k, i)
    return {k: len(g) for k, g in gone.items()}


def test_long_runs_and_copies_without_ids(spark):
    """Runs of few different words are cut and found; copies of a text without ids go but for the first."""
    one, two = " ".join(["again"] * 90), " ".join(["to", "and", "fro"] * 40)
    rows = [(1, one), (2, "Before. " + one), (3, two), (4, two + " then"), (None, "Alone at first. " + " ".join(f"w{k}." for k in range(40)))]
    docs = spark.createDataFrame(rows + rows[-1:] * 3, "doc_id long, text string").coalesce(1)
    got = spans.remove_repeats(docs).collect()
    left = {r.doc_id: len(WORD.findall(r.text)) for r in got if r.doc_id}
    assert left[2] < 30 and left[4] < 30 and left[3] <= 120
    assert sorted(len(r.text) > 0 for r in got if r.doc_id is None) == [False, False, False, True]


def test_spans_against_dictionaries(spark):
    rng = random.Random(9)
    pool = [" ".join(rng.choice(LOREM) for _ in range(rng.randint(2, 9))) + rng.choice([".", "!", "?", "\n"]) for _ in range(60)]
    rows = []
    for k in range(80):
        at = rng.randint(0, 50)
        rows.append((k, " ".join(pool[at : at + rng.randint(1, 9)] + [rng.choice(pool) for _ in range(3)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.n_removed for r in spans.remove_repeats(docs, part_bytes=500).collect() if r.n_removed}
    assert got == brute_spans(rows)


# ---- top k ----


def test_topk_against_all_products(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=8).round(2).tolist()) for k in range(300)] + [(300, None), (301, [1.0, None] + [0.0] * 6), (302, [float("nan")] * 8), (303, [0.5] * 7), (100, [0.1] * 8), (304, [1.0] * 8), (305, [1.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fine = [(k, np.floor(256 * np.array(v)).astype(int)) for k, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, v in fine:
        if q % 50 == 0 and q != 100:
            best = sorted(((-int(v @ w), k) for k, w in fine if k != q and len(w) == len(v)))[:5]
            want |= {(q, i + 1, k, -s) for i, (s, k) in enumerate(best)}
    got = {tuple(r) for r in topk.topk(frame, frame.filter("vec_id % 50 = 0 and vec_id <> 100")).collect()}
    assert got == want


def test_topk_in_several_batches_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    monkeypatch.setattr(topk, "BATCH_BLOCKS", 2)
    rng = np.random.default_rng(6)
    vectors = rng.integers(-3, 4, (250, 6))
    frame = spark.createDataFrame([(k % 240, (v / 256).tolist(), 1, 2) for k, v in enumerate(vectors)] + [(None, [0.1] * 6, 1, 2)], "vec_id long, embedding array<float>, score int, rank int")
    want = set()
    for q in range(0, 240, 10):
        pairs = [(-int(vectors[a] @ vectors[b]), b % 240) for a in range(q, 250, 240) for b in range(250) if b % 240 != q]
        want |= {(q, i + 1, k, -s) for i, (s, k) in enumerate(sorted(pairs)[:5])}
    assert {tuple(r) for r in topk.topk(frame.repartition(3), frame.filter("vec_id % 10 = 0"), sampled=3).collect()} == want


def test_maxscore_probes_survivors_only():
    rng = np.random.default_rng(2)
    vectors = rng.integers(-100, 100, (3000, 64))
    postings, ids = np.ascontiguousarray(vectors.T.astype(float)), np.arange(3000)
    low, high = postings.min(1), postings.max(1)
    for query in vectors[:20].astype(float):
        scores = vectors @ query
        want = sorted((-s, k) for k, s in enumerate(scores.tolist()) if k != 7)[:5]
        for threshold in (None, -want[4][0], -want[4][0] / 2):
            probed = Counter()
            names, found = topk.maxscore(query, 7, ids, postings, low, high, 5, threshold, probed)
            assert list(zip((-found).tolist(), names.tolist())) == want
            if threshold is not None:
                steps = sorted(probed)
                width = np.abs(query) * (high - low)
                order, first = topk.essential(width, threshold - np.where(query > 0, query * low, query * high).sum())
                # the non-essential terms cannot reach the threshold, one term more could
                assert steps[0] == first and probed[first] == 3000
                need = threshold - np.where(query > 0, query * low, query * high).sum()
                assert width[order[first:]].sum() < need <= width[order[first - 1 :]].sum()
                assert all(probed[b] <= probed[a] for a, b in zip(steps, steps[1:])) and probed[steps[-1]] < 1000


def test_topk_beyond_doubles(spark):
    frame = spark.createDataFrame([(k, [2.0**22, k / 256]) for k in range(3)], "vec_id long, embedding array<double>")
    rows = topk.topk(frame, frame.filter("vec_id = 1")).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in rows) == [(1, 2, 2**60 + 2), (2, 0, 2**60)]


# ---- audio ----


def test_lookup_tables():
    assert media.MULAW_TABLE[0] == -32124 and media.MULAW_TABLE[128] == 32124 and media.MULAW_TABLE[255] == 0 and media.MULAW_TABLE[127] == 0
    assert media.ALAW_TABLE[0x55] == -8 and media.ALAW_TABLE[0xD5] == 8 and media.ALAW_TABLE[0x2A] == -32256 and media.ALAW_TABLE[0xAA] == 32256
    assert len(set(media.ALAW_TABLE.tolist())) == 256


def test_adpcm_against_one_step_at_a_time():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 36 * 5 + 7, dtype=np.uint8)
    want = []
    for b in range(5):
        block = data[36 * b : 36 * b + 36].tolist()
        value, index = struct.unpack("<h", bytes(block[:2]))[0], min(block[2], 88)
        want.append(value)
        for code in (n for x in block[4:] for n in (x & 15, x >> 4)):
            step = int(media.IMA_STEPS[index])
            diff = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
            index = max(0, min(88, index + int(media.IMA_INDEX[code])))
            want.append(value)
    assert media.decode_ima(data.tobytes(), 36).tolist() == want


def test_text_audio(spark, docs):
    long = spark.createDataFrame([(5000, "é" * 2_000_000, 1, 2)], "doc_id long, text string, media int, N_BYTES int")
    for frame, to_rate in ((docs, 16000), (docs.withColumn("media", F.lit(1)).withColumn("pcm", F.lit(2)), 4000), (long, 4000)):
        rows = media.text_audio(frame, to_rate=to_rate).collect()
        raw = [(r.doc_id, (r.text or "").encode()) for r in frame.collect()]
        payloads = [(k, len(t), t + b"\xff" * (max(1, -(-len(t) // 576)) * 576 - len(t))) for k, t in raw]
        assert Counter((r.doc_id, r.n_bytes, r.payload_sha256) for r in rows) == Counter((k, n, hashlib.sha256(p).hexdigest()) for k, n, p in payloads)
        seen = {}
        for r in rows:
            kind, rate, block, payload = media.read_wav(bytes(r.media))
            assert (kind, block) in ((6, 1), (7, 1), (17, 576)) and rate == 8000 and len(payload) == r.payload_bytes and r.payload_bytes % 576 == 0
            assert hashlib.sha256(payload).hexdigest() == r.payload_sha256 and hashlib.sha256(bytes(r.media)).hexdigest() == r.media_sha256
            assert zlib.crc32(payload[-32:]) == r.tail_crc32 and r.media_bytes == len(r.media)
            sound = media.decode_wav(bytes(r.pcm))
            assert r.feature == f"format={media.NAMES[kind]};{media.feature(*sound)}" and sound[1] == to_rate
            assert seen.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
            if len(payload) < 10_000:  # each file for itself
                assert media.resample(*media.decode_wav(bytes(r.media)), to_rate).tolist() == sound[0].tolist()
        assert frame is long or {media.read_wav(bytes(r.media))[0] for r in rows} == {6, 7, 17}


def test_op8_interpolates_every_sound(spark):
    for r in media.op8_media_columns(spark, "/root/testdata/sf0.001").select("payload_bytes", "feature", "pcm").limit(30).collect():
        sound, rate = media.decode_wav(bytes(r.pcm))
        stored = r.payload_bytes // 576 * 1145 if "format=ima" in r.feature else r.payload_bytes
        assert rate == 16000 and len(sound) == 2 * stored and f"rate=16000;samples={len(sound)};" in r.feature
        middle = (sound[:-2:2].astype(int) + sound[2::2]) // 2
        assert sound[1:-1:2].tolist() == middle.tolist()


def test_unreadable_media_are_null(spark):
    frame = spark.createDataFrame([(1, 3, bytearray(b"junk")), (2, None, None), (3, 9, bytearray(media.store_payload(b"a" * 576, kind=17)))], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in media.decoded(frame).collect()}
    assert got[1].pcm is None and got[1].media_bytes == 4 and got[2].media_bytes is None and got[2].feature is None and got[3].payload_bytes == 576
    made = spark.createDataFrame([(bytearray(media.wav(6, 8000, 8, 1, bytes(range(200)), 200)),), (bytearray(b"junk"),), (None,)], "media binary")
    got = [r.pcm for r in media.decode_media(made).collect()]
    assert got[0] is not None and got[1] is None and got[2] is None


# ---- mixture ----


def brute_targets(sizes):
    order = sorted((k for k in sizes if k is not None)) + [None] * (None in sizes)
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        share = {k: left * weight[k] / sum(weight[j] for j in free) for k in free}
        over = {k for k in free if share[k] > 3 * sizes[k]}
        if not over:
            return target | share
        for k in over:
            target[k] = 3.0 * sizes[k]
            left -= target[k]
        free -= over
    return target


def test_mixture(spark, docs):
    options = {"block_rows": 4, "shards": 5}
    for frame in (docs, docs.withColumn("source", F.when(F.col("doc_id") < 3, "s0").when(F.col("doc_id") < 50, "s1").otherwise("s2"))):
        rows = mixture.allot(frame, **options).collect()
        assert len(rows) == frame.count()
        sizes = Counter()
        for r in frame.collect():
            sizes[r.source] += len(WORD.findall(r.text or ""))
        goal = brute_targets(dict(sizes))
        taken = Counter()
        for r in rows:
            assert r.size == len(WORD.findall(r.text or "")) and r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source]) and r.taken <= 3 * r.size
            assert len(r.shards) == -(-r.taken // r.size) if r.size else r.shards == []
            taken[r.source] += r.taken
        assert all(abs(taken[k] - goal[k]) <= 1 for k in sizes)
        again = mixture.allot(frame.repartition(3), **options).collect()
        assert Counter((r.doc_id, r.text, r.taken, tuple(r.shards)) for r in rows) == Counter((r.doc_id, r.text, r.taken, tuple(r.shards)) for r in again)
        mixed = mixture.mix_documents(frame, **options).collect()
        assert sum(len(WORD.findall(r.text or "")) for r in mixed) == sum(taken.values())


def test_hypergeometric_draws_follow_their_law(spark):
    long = lambda x: F.lit(x).cast("long")
    n = 20_000
    for white, everything, draws in ((7, 20, 8), (3, 3, 2), (0, 5, 3), (5, 9, 0), (1, 40, 39)):
        rows = spark.range(n).select(mixture.hypergeometric(long(white), long(everything), long(draws), mixture.uniform(F.lit(9), F.col("id"))).alias("x")).groupBy("x").count().collect()
        seen = {r.x: r["count"] for r in rows}
        law = {k: math.comb(white, k) * math.comb(everything - white, draws - k) / math.comb(everything, draws) * n for k in range(white + 1) if 0 <= draws - k <= everything - white}
        assert set(seen) <= set(law) and all(abs(seen.get(k, 0) - e) < 5 * e**0.5 + 1 for k, e in law.items())
    wide = [r.x for r in spark.range(150).select(mixture.hypergeometric(long(300_000), long(1_000_000), long(500_000), mixture.uniform(F.lit(2), F.col("id"))).alias("x")).collect()]
    assert abs(np.mean(wide) - 150_000) < 5 * 230 / 150**0.5 and 150 < np.std(wide) < 310


def test_splitting_tree_keeps_quotas(spark):
    quotas = {"=a": 100, "=b": 37, "": 11, "=z": 0}
    for shards in (1, 5, 8):
        rows = mixture.split_quotas(spark.createDataFrame(list(quotas.items()), "src string, q long"), shards, 4).collect()
        by_source, by_shard = Counter(), Counter()
        for r in rows:
            by_source[r.src] += r.q
            by_shard[r.shard] += r.q
        assert dict(by_source) == quotas and sorted(by_shard) == list(range(shards)) and min(r.q for r in rows) >= 0
        assert max(by_shard.values()) - min(by_shard.values()) <= 2


def test_running_sums_are_those_of_one_order(spark):
    rows = spark.range(300).select((F.col("id") % 3).alias("g"), F.xxhash64("id").alias("h"), F.col("id").alias("t"), (F.col("id") % 7).alias("v"))
    got = {r.t: r.s for r in mixture.running(rows, "g", "h", ["t"], F.col("v"), "s").collect()}
    for g in range(3):
        total = 0
        # the ranges are those of the hash as an unsigned number, rows in a range go by the signed one
        for r in sorted((r for r in rows.collect() if r.g == g), key=lambda r: (r.h % 2**64 >> 56, r.h)):
            assert got[r.t] == total
            total += r.v


def test_mix_shards_hold_disjoint_blocks(spark):
    """Every draw of a document lies in one shard; a block's documents share their shards; clashing columns keep their values."""
    rows = [(k, "w " * (1 + k % 5), f"s{k % 3}", 7, "own") for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target string")
    mixed = mixture.mix_documents(frame, shards=5, block_rows=16).collect()
    assert {(r.size, r.target) for r in mixed} == {(7, "own")} and {r.mix_shard for r in mixed} == set(range(5))
    shards = {r.doc_id: r.shards for r in mixture.allot(frame.select("doc_id", "text", "source"), shards=5, block_rows=16).collect()}
    drawn = defaultdict(list)
    for r in mixed:
        drawn[r.doc_id].append(r.mix_shard)
    assert all(sorted(drawn[k]) == sorted(v) for k, v in shards.items())
    assert len({(r.mix_shard, r.mix_order) for r in mixed}) == len(mixed)


# ---- quality ----


def test_quality_keeps_good_and_drops_junk(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(LOREM) for _ in range(rng.randint(20, 80))) + "."
    junk = lambda: " ".join(rng.choice(LOREM).upper() + "!!" for _ in range(rng.randint(20, 80)))
    rows = [(k, good() if k % 4 else junk()) for k in range(800)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("KEPT", F.lit(1))
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(400)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality.resample(docs, labels).collect()}
    unseen = range(400, 800)
    assert np.mean([kept[k] == (k % 4 > 0) for k in unseen]) > 0.98 and len(kept) == 802


@pytest.mark.parametrize("length", [quality.LENGTH, 1])
def test_quality_weights_and_choice_by_brute_force(spark, docs, length):
    from ledgerlens.llm.shingles import blocks

    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    got = quality.resample(docs, labels, missed=0.3, length=length).collect()
    again = quality.resample(docs.repartition(5), labels, missed=0.3, length=length).collect()
    assert Counter((r.doc_id, r.text, r.log_weight, r.kept) for r in got) == Counter((r.doc_id, r.text, r.log_weight, r.kept) for r in again)
    fit = {k for k in range(60) if spark_hash((), np.int32(quality.SEED + 2), k) % 2 == 0}
    rows = docs.collect()
    grams = []  # of every row: lists of features, words' and shapes' apart
    for r in rows:
        found = quality.features(*next(blocks(pa.array([r.text])))[1:])[0]
        grams.append(([x for x in found[:2].ravel().tolist() if x >= 0], [x for x in found[2:].ravel().tolist() if x >= 0], found.shape[1]))
    ratio = {}
    for model in (0, 1):
        raw = Counter(x for g in grams for x in g[model])
        good = Counter(x for r, g in zip(rows, grams) if r.doc_id in fit and r.doc_id % 2 for x in g[model])
        for x in raw:
            ratio[x] = math.log((good[x] + 1) / (sum(good.values()) + 2**14)) - math.log((raw[x] + 1) / (sum(raw.values()) + 2**14))
    weights = [length * sum(ratio[x] for x in g[0] + g[1]) / max(1, g[2]) for g in grams]
    noise = []
    for r in rows:
        raw = [np.int32(quality.SEED), r.doc_id]
        h = spark_hash((), *raw)
        h = h if r.text is None else xxhash.xxh64(r.text.encode(), seed=h % 2**64).intdigest()
        noise.append(-math.log(-math.log(((h % 2**64 >> 11) + 0.5) / 2**53)))
    unseen = [w for r, w in zip(rows, weights) if r.doc_id is not None and r.doc_id < 60 and r.doc_id % 2 and r.doc_id not in fit]
    k = sum(w >= np.quantile(unseen, 0.3) - 1e-6 for w in weights)
    keys = sorted((w + n for w, n in zip(weights, noise)), reverse=True)
    want = Counter((r.doc_id, r.text, w + n >= keys[k - 1] - 1e-9) for r, w, n in zip(rows, weights, noise))
    assert 0 < k < len(rows) and Counter((r.doc_id, r.text, r.kept) for r in got) == want
    by = {(r.doc_id, r.text): r for r in got}
    assert all(by[r.doc_id, r.text].log_weight == pytest.approx(w, abs=1e-2) and by[r.doc_id, r.text].gumbel_key == pytest.approx(w + n, abs=1e-2) for r, w, n in zip(rows, weights, noise))
    # the noise matters: some rows over the cut go for others under it
    assert length > 1 or any((w >= np.quantile(unseen, 0.3)) != by[r.doc_id, r.text].kept for r, w in zip(rows, weights))


def test_kth_greatest(spark):
    rng = random.Random(3)
    values = [rng.choice([rng.random(), 0.5, -1e6, 7.0]) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 130, 131, 250, 499, 500):
        assert quality.kth_greatest(rows, "v", k, cells=4) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_greatest(rows, "v", 0) == float("inf") and quality.kth_greatest(rows, "v", 501) == float("-inf")


# ---- the pipeline ----


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        docs = cp.written(out, "t")
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] == seen[3]
    last = cp.STAGES[-1][1](spark, docs, d)
    assert last.filter("not round_trip").count() == 0 and last.count() > seen[4]


@pytest.fixture(scope="module")
def long_docs(spark):
    """A text of 80 000 words and one of a single word of 500 KB, each twice, among short ones; columns named like the operators' own."""
    rng = random.Random(12)
    words = " ".join(rng.choice(LOREM) + str(rng.randrange(5000)) for _ in range(80_000))
    rows = [(1, words, "a"), (2, words + " more", "a"), (3, "y" * 500_000, "b"), (4, "y" * 500_000, None), (5, "short text of some six words.", "b"), (6, None, "b"), (7, "", "c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    made = "k h f z n p part seq segment ids start n_tokens n_shingles component_id home label side region size shard slot law taken target kept log_weight removed media pcm feature".split()
    return frame.withColumns({c: F.lit(f"own {c}") for c in made}), rows


def test_very_long_texts_and_clashing_columns(spark, long_docs):
    frame, rows = long_docs
    texts_ = {k: t or "" for k, t, _ in rows}
    got = {r.doc_id: r for r in jaccard.jaccard_join(frame).collect()}
    assert {k: r.component_id for k, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7} and all(got[k].n_shingles == len(shingles(t)) for k, t in texts_.items())
    got = {r.doc_id: r for r in sharding.stored_shards(sharding.shard_documents(frame)).collect()}
    assert all(got[k].size == len(t) + 16 and got[k].text_crc32 == zlib.crc32(t.encode()) and got[k].law == "key" for k, t in texts_.items())
    path = public_tokenizers.path("word_bpe_49k.json")
    got = {r.doc_id: r for r in tokenfile.read_token_file(*tokenfile.write_token_file(frame, path), ids=False).collect()}
    assert set(got) == set(texts_) and got[6].n_tokens == got[7].n_tokens == 1 and got[3].ids_crc32 == got[4].ids_crc32 and got[2].start == got[1].n_tokens
    got = {r.doc_id: r for r in spans.remove_repeats(frame).collect()}
    assert got[1].text == texts_[1] and len(got[2].text) < 200 and got[3].text == texts_[3] and got[6].text is None
    got = {r.doc_id: r for r in mixture.allot(frame, block_rows=2, shards=3).collect()}
    assert all(got[k].size == len(WORD.findall(t)) and got[k].taken <= 3 * got[k].size for k, t in texts_.items())
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 6)], "doc_id long, quality int, toxic int")
    out = quality.resample(frame, labels)
    assert out.count() == 7 and out.filter("log_weight is null or isnan(log_weight)").count() == 0 and "own kept" not in {str(r.kept) for r in out.collect()}
    got = pieces.segment(frame, public_tokenizers.path("piece_bpe_32k.model"), samples=1, packed=True).select("doc_id", "round_trip", "n_pieces").collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 5} and all(r.round_trip for r in got)


def odd_docs(spark):
    """Null and repeated ids, null, empty and equal texts, a null source, columns named like the operators' own."""
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    rows += [(None, rows[0][1], "xx", None, 1), (None, "no id and no copy of any other text of this table", "xx", "s", 1), (None, None, "xx", "s", 0), (7_000_000, None, "xx", None, None), (7_000_001, "", "xx", "s", 0)]
    rows += [(rows[3][0], "another text under an id that is there already, unlike it", "xx", "s", 1), (rows[4][0], rows[4][1], "xx", "s", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    made = ["kept", "log_weight", "size", "target", "taken", "part", "passes", "shards", "removed", "n_removed", "mix_shard", "component_id", "z", "k", "h"]
    return frame.withColumns({c: F.lit(f"own {c}") for c in made}), rows


def test_pipeline_stages_with_odd_rows(spark, monkeypatch):
    import corpus_pipeline as cp

    docs, rows = odd_docs(spark)
    d = "/root/testdata/sf0.001"
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.schema.simpleString() == docs.schema.simpleString()
        got = out.collect()
        assert got and all(r[c] == f"own {c}" for r in got for c in docs.columns[5:])
        assert stage(spark, docs.limit(0), d).count() == 0
    assert cp.STAGES[-1][1](spark, docs, d).filter("not round_trip").count() == 0
    assert cp.STAGES[-1][1](spark, docs.limit(0), d).count() == 0
    without = docs.drop("n_chars")
    assert all(stage(spark, without, d).columns == without.columns for _, stage in cp.STAGES[:-1])


def test_near_copies_keep_one_row_of_each_component(spark):
    """Brute force: of each component the least (with an id, id or text hash, text hash), once; rows without words stay."""
    import corpus_pipeline as cp

    docs, rows = odd_docs(spark)
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    sets = [shingles(r[1]) for r in rows]
    groups = defaultdict(set)
    for root, r, s in zip(classes(sets), rows, sets):
        if s:
            groups[root].add((r[0] is None, hashes[r[1]] if r[0] is None else r[0], hashes[r[1]], r[1]))
    want = Counter((None if min(g)[0] else min(g)[1], min(g)[3]) for g in groups.values())
    want += Counter((r[0], r[1]) for r, s in zip(rows, sets) if not s)
    assert Counter((r.doc_id, r.text) for r in cp.near_copies(spark, docs, "").collect()) == want


def test_pipeline_run_leaves_only_its_result(spark, tmp_path):
    import corpus_pipeline as cp
    from ledgerlens.llm.common import since

    before = len(since(0))
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and since(before) == [out._written_path]


def test_registered_sql_is_text_for_registered_queries():
    from ledgerlens.llm import registry

    assert all(isinstance(v, str) for v in registry.oracle_sql().values()) and set(registry.oracle_sql()) <= set(registry.queries())
