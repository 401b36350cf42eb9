"""Rules of the graph engine on small inputs; expectations follow from the rules' definitions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import extract, filing, text
from ledgerlens.operators import analytics, graph, keys, resolve, similarity, triples
from ledgerlens.operators.gate import Policy, gate
from ledgerlens.plans import registry
from ledgerlens.sources import companies, filings


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("value,slug,other", [("--A&B Co.", "a_b_co", "a-b-co"), ("!!", "unknown", "unknown"), ("Plain", "plain", "plain")])
def test_slugs(spark, value, slug, other):
    assert one(spark, value, text.graph_slug) == slug
    assert one(spark, value, text.resource_slug) == other


def test_small_functions(spark):
    assert one(spark, "competes_with", text.camel) == "competesWith"
    assert one(spark, "320193", text.padded_cik) == "0000320193"
    assert one(spark, "12345678901", text.padded_cik) == "12345678901"
    assert one(spark, "brk.b", text.index_ticker) == "BRK-B"
    assert one(spark, " a  b\t", text.collapse) == "a b"


def test_sentence_bounds(spark):
    parts = ["x" * (n - 1) + "." for n in (79, 80, 800, 801)]
    got = one(spark, " ".join(parts), text.sentences)
    assert [len(s) for s in got] == [80, 800]


def test_matches_have_code_point_offsets(spark):
    value = "café $5 million, then $1,200.50 and €3"
    got = one(spark, value, lambda c: text.matches(c, extract.MONEY))
    assert [(m.text, m.start, m.end) for m in got] == [(m[0], m.start(), m.end()) for m in re.finditer(r"\$[0-9][0-9,]*(?:\.[0-9]+)?\s?(?:billion|million|thousand)?", value)]
    assert one(spark, "none", lambda c: text.matches(c, extract.MONEY)) == []


def test_entity_patterns(spark):
    rows = spark.createDataFrame([(1, "Apple Inc. and the European Union paid $3 billion to Apple Inc. today")], "id int, t string")
    found = [(r.label, r.text) for r in extract.entities(rows, "id", "t").orderBy("ord").collect()]
    assert found == [("MONEY", "$3 billion"), ("ORG", "Apple Inc"), ("ORG", "Apple Inc"), ("GPE", "European Union")]
    kept = extract.dedupe_entities(extract.entities(rows, "id", "t"), "id")
    assert kept.filter("label = 'ORG'").count() == 1


@pytest.mark.parametrize(
    "method,conf,strict,status,decision",
    [
        ("heuristic:x", 0.5, False, "rejected_heuristic_low_confidence", "exclude"), ("heuristic:x", 0.55, False, "review", "load"), ("claude:x", 0.7, False, "approved", "load"),
        ("claude:x", 0.69, False, "review", "load"), ("sec_x", 0.1, False, "approved", "load"), ("heuristic:x", 0.9, True, "review", "exclude"), ("sec_x", 0.01, False, "rejected_low_confidence", "exclude"),
    ],
)
def test_gate(spark, method, conf, strict, status, decision):
    rows = spark.createDataFrame([(method, conf)], "method string, conf double")
    r = gate(rows, Policy(min_confidence=0.05, include_reviewable=not strict)).first()
    assert (r.review_status, r.load_decision) == (status, decision)


def test_business_items(spark):
    assert one(spark, "the steel plates, copper wires and a variety of pipes or products (all)", extract.business_items) == ["Steel plates", "Copper wires", "Pipes"]
    assert one(spark, "goods for developed and emerging markets", extract.business_items) == ["Developed and emerging markets"]


def test_hit_cap_comes_before_the_usefulness_filter(spark):
    s = "We compete with Foo Inc and Foo Inc and Foo Inc and Foo Inc and also with Bar Group in every single place we know."
    docs = spark.createDataFrame([(1, s, "Foo Inc")], "id int, t string, focal string")
    found = spark.createDataFrame([(1, 0, "Foo Inc", "ORG"), (1, 1, "Bar Group", "ORG")], "id int, ord int, text string, label string")
    assert extract.heuristic_relations(docs, found, "id", "t", "focal").count() == 0


def test_excerpt_budget(spark):
    lines = [f"Our market number {k} grows and the revenue of it is good enough to be written down in this long line." for k in range(400)]
    docs = spark.createDataFrame([(1, " ".join(lines))], "id int, t string")
    got = extract.excerpt(docs, "id", "t").first().excerpt
    assert len(got) == 18_000 and got.startswith("Our market number 0")


def test_sections():
    body = "x" * 5200
    toc = "Item 1. Business Item 1A. Risk Factors Item 1B. None "
    t = toc + "y" * 1000 + " Item 1. Business we make things " + body + " Item 1A. Risk Factors there are some " + body + " Item 2. Properties " + "z" * 600 + " Item 1B. Unresolved " + body
    assert filing.section(t, "business").startswith("Item 1. Business we make") and filing.section(t, "business").endswith("x")
    risk = filing.section(t, "risk_factors")
    assert risk.startswith("Item 1A. Risk Factors there") and risk.endswith("z")  # the first pattern with a hit ends it
    assert filing.section(t, "mda") == ""


def test_html_text():
    assert filing.plain_text("<p>a&nbsp;&nbsp;b</p><script>var t='</p>'</script><style>x</style><ix:header>h</ix:header><b>c</b>") == "a b c"


def test_path_metadata(spark):
    r = one(spark, "/x/AAPL_0000320193_0001-22_more.html", filing.path_metadata)
    assert (r.ticker, r.cik, r.accession_number) == ("AAPL", "0000320193", "0001-22")
    with pytest.raises(Exception, match="not <ticker>"):
        one(spark, "/x/AAPL.html", filing.path_metadata)


@pytest.mark.parametrize("raw,ok", [('{"a":1}', True), ('say ```json\n{"a":1}\n``` done', True), ('well {"a":{"b":2}} ok', True), ('{"a":1', False), ("none", False)])
def test_tolerant_json(spark, raw, ok):
    assert (one(spark, raw, text.tolerant_json) is not None) == ok


def test_token_set_ratio():
    assert resolve.token_set_ratio("Apple Inc", "Inc Apple") == 100.0
    assert resolve.token_set_ratio("Apple", "Apple Inc") == 100.0
    assert resolve.indel_ratio("kitten", "sitting") == pytest.approx(100 * 8 / 13)
    assert resolve.token_set_ratio("abc", "xyz") == 0.0


def test_resolve(spark):
    index = spark.createDataFrame([(0, "AAPL", "Apple Inc.", 320193), (1, "X", "Steel Works", None)], "ord int, ticker string, name string, cik long")
    rows = {r.mention: r for r in resolve.resolve(spark.createDataFrame([("aapl",), ("Steel Works Group",), ("Zebra",), (" ",)], "mention string"), index).collect()}
    assert rows["aapl"].status == "linked" and rows["aapl"].score == 100.0 and rows["aapl"].cik == "320193"
    assert rows["Steel Works Group"].ticker == "X" and rows["Steel Works Group"].cik is None
    assert rows["Zebra"].status == "unlinked" and rows[" "].score == 0.0


def _sequential(records):
    entries, out = {}, []
    for rec, (ticker, name, mentions) in enumerate(records):
        entries[ticker] = name
        for rel, m in enumerate(mentions):
            key = next((t for t, n in entries.items() if m.lower() in (t.lower(), n.lower())), None)
            if key is None:
                key = re.sub("[^a-z0-9]+", "_", m.lower()).strip("_") or "unknown"
            entries.setdefault(key, m)
            out.append((rec, rel, m, key))
    return out


def test_company_keys_against_a_sequential_model(spark):
    rng = random.Random(3)
    words = ["A", "a b", "A_B", "a-b", "C", "c d", "c_d", "E!"]
    for _ in range(6):
        records = [(rng.choice(["A", "C", "E", "T"]), rng.choice(words), [rng.choice(words) for _ in range(rng.randint(0, 4))]) for _ in range(14)]
        focal = spark.createDataFrame([(k, t, n) for k, (t, n, _) in enumerate(records)], "rec int, ticker string, name string")
        want = _sequential(records)
        got = keys.company_keys(focal, spark.createDataFrame([w[:3] for w in want], "rec int, rel int, mention string"))
        assert sorted(map(tuple, got.collect())) == sorted(want)


def small_graph(spark):
    node = "label string, key string, ticker string, name string, cik string, industry string, accession_number string, path string, form_type string, filing_date string, confidence double, extraction_method string"
    companies_ = [("Company", k, k, k.lower(), None, None, None, None, None, None, None, None) for k in "ABCD"]
    nodes = spark.createDataFrame([*companies_, ("Filing", "F1", "A", None, None, None, "F1", "p", "10-K", "2020-01-01", None, None)], node)
    edge = "src_label string, src_key string, type string, dst_label string, dst_key string, predicate string, confidence double, source_text string, extraction_method string, review_status string, load_decision string"
    e = lambda a, t, b, lb="Company": ("Company", a, t, lb, b, t.lower(), 0.9, "x", "claude:m", "approved", "load")
    edges = spark.createDataFrame([e("A", "COMPETES_WITH", "B"), e("B", "SUPPLIES", "B"), e("A", "SUBSIDIARY_OF", "B"), e("B", "SUBSIDIARY_OF", "C"), e("A", "FILED", "F1", "Filing")], edge)
    return graph.Graph(nodes, edges)


def test_graph_patterns(spark):
    g = small_graph(spark)
    degree = {r.key: r.degree for r in graph.degrees(g).collect()}
    assert degree == {"A": 3, "B": 4, "C": 1, "D": 0, "F1": 1}  # a self-loop counts once
    assert [r.key for r in graph.orphans(g).collect()] == ["D"]
    assert {(r.relationship, r.key) for r in graph.neighbours(g, "a").collect()} == {("COMPETES_WITH", "B"), ("SUBSIDIARY_OF", "B"), ("FILED", "A")}  # a filing shows its filer's ticker
    assert {tuple(r) for r in analytics.subsidiary_closure(g).collect()} == {("A", "B"), ("B", "C"), ("A", "C")}
    assert {r.key: r.component for r in analytics.company_components(g).collect()} == {"A": "A", "B": "A", "C": "A", "D": "D"}


def test_louvain_partition(spark):
    g = small_graph(spark)
    rows = analytics.louvain(g).collect()
    assert len(rows) == 4 and {r.ticker for r in rows} == set("ABCD")
    assert next(r for r in rows if r.ticker == "D").communityId == "D"
    two = {(a, b): 1.0 for x in ("abc", "xyz") for a in x for b in x if a != b} | {("c", "x"): 1.0, ("x", "c"): 1.0}
    found = analytics._louvain(two, sum(two.values()))
    assert found["a"] == found["b"] == found["c"] != found["x"] == found["y"] == found["z"]


def _modularity(edges, label):
    """Of undirected (a, b, weight) with each pair once."""
    total = 2.0 * sum(w for _, _, w in edges)
    inside, mass = {}, {}
    for a, b, w in edges:
        for x in (a, b):
            mass[label[x]] = mass.get(label[x], 0.0) + w
        if label[a] == label[b]:
            inside[label[a]] = inside.get(label[a], 0.0) + 2.0 * w
    return sum(inside.get(c, 0.0) / total - (m / total) ** 2 for c, m in mass.items())


def test_louvain_in_tasks_and_distributed(spark):
    rng = random.Random(3)
    pairs = {(k, m): 1.0 for c in range(6) for k in range(c * 8, c * 8 + 8) for m in range(k + 1, c * 8 + 8) if rng.random() < 0.7}
    pairs |= {(c * 8, (c * 8 + 9) % 48): 1.0 for c in range(5)} | {(60, 61): 1.0}
    names = sorted({x for p in pairs for x in p})
    empty = [None] * (len(graph.NODE_VALUES) - 2)
    nodes = spark.createDataFrame([("Company", f"C{k:02}", f"C{k:02}", f"N{k}", *empty) for k in names], "label string, key string, " + ", ".join(f"{v} {'double' if v == 'confidence' else 'string'}" for v in graph.NODE_VALUES))
    edges = spark.createDataFrame([("Company", f"C{a:02}", "COMPETES_WITH", "Company", f"C{b:02}") for a, b in pairs], ", ".join(f"{c} string" for c in graph.EDGE_KEY))
    g = graph.Graph(nodes, edges)
    listed = [(f"C{a:02}", f"C{b:02}", w) for (a, b), w in pairs.items()]
    planted = _modularity(listed, {f"C{k:02}": k // 8 for k in names})
    for options in ({}, {"most_edges": 60, "rounds": 4, "levels": 1}):
        rows = analytics.louvain(g, **options).collect()
        label = {r.ticker: r.communityId for r in rows}
        assert len(rows) == len(names) and all(min(t for t in label if label[t] == c) == c for c in label.values())
        assert label["C60"] == label["C61"] == "C60" and _modularity(listed, label) > planted - 0.02


def test_similarity_blocks_of_a_hub_feature(spark):
    rows = [(f"T{k % 7}", f"F{k % 3}") for k in range(20)] + [(f"T{k}", "hub") for k in range(30)]
    pairs, _ = similarity.numbered(spark.createDataFrame(sorted(set(rows)), "ticker string, feature string"))
    whole, cut = ({(r.a, r.b): r.shared for r in similarity.shared_counts(pairs, n).collect()} for n in (4096, 4))
    assert whole == cut and len(whole) == 30 * 29 // 2


def test_triples_round_trip(spark):
    rows = triples.triples(small_graph(spark))
    back = triples.read_ntriples(triples.ntriples(rows))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, back.collect()))


def test_last_wins_and_repeated_statements(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "key string, ord int, v string")
    assert graph.last_of(rows, ("key",), [F.col("ord")]).first().v == "b"
    assert graph.first_of(rows, ("key",), [F.col("ord")]).first().v == "a"


def test_a_tie_of_mentions_is_broken_by_the_source(spark):
    schemas = ["ticker string, name string, cik long, industry string", "ticker string, cik long, filing_year int, filing_date string", "ord long, ticker string, predicate string, object string, object_type string, conf double, method string, evidence string, rationale string, accession string"]
    empty = [spark.createDataFrame([], s) for s in schemas]
    said = [(7, f"S{k:02}-1999", "ORG", "CUS 1", 0.5, "regex:org_suffix") for k in range(40)]
    for seed in range(3):
        random.Random(seed).shuffle(said)
        mentions = spark.createDataFrame(said, "ord long, accession_number string, entity_label string, text string, conf double, method string").repartition(5)
        assert [r.source for r in graph.build(*empty, mentions).nodes.collect()] == ["S39-1999"]


def test_pairs_of_suppliers_are_dealt_to_tasks(spark):
    rows = registry.Inputs(spark, "/root/testdata/sf0.01").relations.filter("predicate = 'competes_with'")
    held = rows.groupBy(F.spark_partition_id()).count().collect()
    assert len(held) >= 3


def test_known_keys_of_few_and_of_many_companies(spark):
    named = spark.createDataFrame([("A1", "Acme"), ("A0", "ACME"), ("B", None)], "ticker string, name string")
    rows = spark.createDataFrame([("acme",), ("A1",), ("b",), ("New Co.",), (None,), ("acme",)], "object string")
    few, many = (sorted(map(tuple, keys.with_known_keys(rows, named, "object", n).select("object", "company_key").collect()), key=str) for n in (10, 1))
    assert few == many == sorted([("acme", "A0"), ("A1", "A1"), ("b", "B"), ("New Co.", "new_co"), (None, None), ("acme", "A0")], key=str)


def test_symmetric_closure_with_a_loop(spark):
    rows = spark.createDataFrame([("a", "p", "b"), ("b", "p", "a"), ("c", "p", "c"), ("d", "p", "a"), ("a", "q", "z")], "s string, p string, o string")
    assert sorted(map(tuple, triples.symmetric_closure(rows, "p").collect())) == [("a", "b"), ("a", "d"), ("b", "a"), ("c", "c"), ("d", "a")]


def test_company_index(spark):
    html = "<table id='constituents'><tr><th>Symbol</th><th>Security</th><th>GICS Sector</th><th>GICS Sub-Industry</th></tr><tr><td>BRK.B</td><td>Berk</td><td>F</td><td>I</td></tr><tr><td>ZZ</td><td>Zed</td><td>F</td><td>I</td></tr></table>"
    ciks = companies.ticker_ciks(spark.createDataFrame([('{"0":{"ticker":"brk-b","cik_str":1},"1":{"ticker":"BRK-B","cik_str":2}}',)], "value string"))
    rows = companies.company_index(spark, html, ciks).collect()
    assert [(r.ticker, r.cik) for r in rows] == [("BRK-B", 2), ("ZZ", None)]


def test_latest_of_form_takes_the_first_index(spark):
    recent = spark.createDataFrame([(1, ["8-K", "10-K", "10-K"], ["a", "b", "c"], ["x"] * 3, ["d"] * 3)], "cik long, form array<string>, accession_number array<string>, primary_document array<string>, filing_date array<string>")
    assert filings.latest_of_form(recent, "10-K").first().accession_number == "b"
    assert filings.latest_of_form(recent, "S-1").first().accession_number is None


def test_records_round_trip(spark, tmp_path):
    path = str(tmp_path / "r")
    (tmp_path / "r.json").write_text('{"record_ord":1,"ticker":"A","filing":{"ticker":"A","cik":"1","accession_number":"x","path":"p"},"entities":[{"text":"t","label":"ORG","start_char":0,"end_char":1}]}\n')
    rows = filings.read_records(spark, str(tmp_path / "r.json"))
    filings.write_records(rows, path)
    assert filings.read_records(spark, path).first().entities[0].text == "t"
