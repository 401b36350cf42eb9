"""Extraction records from HTML to the review table."""

import json

from pyspark.sql import functions as F

from ledgerlens.functions import extract
from ledgerlens.operators import graph, triples
from ledgerlens.operators.keys import company_keys
from ledgerlens.plans import extraction, registry
from ledgerlens.sources import filings

BODY = "The Acme Corporation designs, manufactures and markets steel plates, copper wires and brass fittings for all who need them in the world. "
HTML = "<html><body><p>Item 1. Business</p><p>" + BODY + "We compete with Rival Holdings and with Zed Group in China and in every other market that there is for us. " * 60 + "</p><p>Item 1A. Risk Factors</p><p>none</p></body></html>"


def rows(spark):
    html = spark.createDataFrame([("raw/AC_0000000001_acc-1.html", "<p>old</p>"), ("raw/AC_0000000001_acc-2.html", HTML)], "path string, html string")
    index = spark.createDataFrame([(0, "AC", "Acme Corporation", 1), (1, "RV", "Rival Holdings", 2)], "ord int, ticker string, name string, cik long")
    return html, index


def test_records(spark):
    html, index = rows(spark)
    r = extraction.records(html, index).first()
    assert r.filing.accession_number == "acc-2" and r.sections_found["business"] and not r.sections_found["mda"]
    found = {(x.subject, x.predicate, x.object) for x in r.relationships}
    assert ("Acme Corporation", "competes_with", "Rival Holdings") in found and ("Acme Corporation", "supplies", "Steel plates") in found
    assert {x.mention: x.ticker for x in r.entity_resolution}["Rival Holdings"] == "RV"
    assert r.entity_summary["ORG"] >= 3
    stats = extraction.statistics(extraction.records(html, index)).first()
    assert stats.relationship_count == len(r.relationships) and stats.relationship_type_counts["supplies"] >= 3
    review = extraction.review_rows(extraction.records(html, index))
    assert review.columns == extraction.REVIEW and review.filter("load_decision = 'exclude'").count() == review.filter("confidence < 0.55").count()
    assert extraction.best_name(extraction.records(html, index)).first().name in ("AC", "Acme Corporation")


def test_a_model_comes_first_and_rules_fill_in(spark):
    html, index = rows(spark)
    item = {"subject": "AC", "predicate": "customer_of", "object": "Zed", "object_type": "Company", "confidence": 0.9, "source_text": "x", "rationale": ""}
    got = extraction.records(html, index, lambda text, focal: [item], "m").first().relationships
    assert got[0].extraction_method == "claude:m" and not [x for x in got if x.predicate == "competes_with"]
    none = extraction.records(html, index, lambda text, focal: []).first().relationships
    assert [x for x in none if x.predicate == "competes_with"]


def test_payload_and_validity(spark):
    inner = {"relationships": [{"subject": "a", "predicate": "supplies", "object": "b", "object_type": "Company", "confidence": 0.5, "source_text": "t", "rationale": ""}, {"subject": "a", "predicate": "eats", "object": "b", "object_type": "Company", "confidence": 0.5}]}
    kind = "content array<struct<type:string,name:string,input:string,text:string>>"
    made = spark.createDataFrame([([("text", None, None, "see "), ("tool_use", "record_relationships", json.dumps(inner), None)],), ([("text", None, None, "```json\n" + json.dumps(inner) + "\n```")],)], kind)
    for r in made.select(extraction.payload(F.col("content")).alias("p")).select("p", extraction.valid(F.col("p")).alias("v")).collect():
        assert len(r.p) == 2 and len(r.v) == 1


def test_ticker_list():
    assert extraction.ticker_list(" aapl, ,Msft ") == ["AAPL", "MSFT"]
    assert extraction.ticker_list("Pilot", {"pilot": ["X"]}) == ["X"]


def test_ontology_checks(spark):
    made = spark.createDataFrame([("c", "type", "Company", "iri"), ("c", "cik", "1", "literal"), ("c", "cik", "2", "literal"), ("f", "type", "Filing", "iri"), ("f", "ticker", "x", "literal"), ("f", "filed", "f", "iri")], "s string, p string, o string, kind string")
    assert triples.functional_violations(made).count() == 1
    assert {(r.s, r.p) for r in triples.domain_violations(made).collect()} == {("f", "filed")}


def test_csv_cells(spark, tmp_path):
    (tmp_path / "r.csv").write_text('ticker,score,ok,n\nAC,8.0,True,7\n"a ""b""",,False,x\n')
    got = filings.read_csv_rows(spark, str(tmp_path / "r.csv"), 5).collect()
    assert [[json.loads(v) for v in r] for r in got] == [["AC", 8.0, True, 7], ['a "b"', None, False, "x"]]


def test_a_model_of_names_comes_before_the_rules(spark):
    docs = spark.createDataFrame([("a", "Ann met Rival Holdings in China."), ("b", None)], "id string, text string")
    ner = lambda text: [("Ann ", "PERSON", 0, 4), ("met", "VERB", 4, 7), (" ", "ORG", 7, 8), ("China", "LOC", 26, 31)] if text else []
    got = extract.entities(docs, "id", "text", seeds=True, ner=ner, ner_name="m").orderBy("ord").collect()
    assert [(r.text, r.label, r.confidence, r.extraction_method) for r in got] == [
        ("Ann", "PERSON", 0.72, "ner:m"), ("China", "LOC", 0.62, "ner:m"), ("Rival Holdings", "ORG", 0.58, "regex:org_suffix"), ("China", "GPE", 0.65, "regex:region_seed"),
    ]


def test_graph_of_records_in_their_order(spark):
    """Names change with records, objects take the key known when they are read, entities the last one; null confidence is rejected."""
    relation = lambda p, o, kind, conf, method="claude:m": {"subject": "s", "predicate": p, "object": o, "object_type": kind, "confidence": conf, "source_text": "t", "rationale": f"of {o}", "extraction_method": method}
    entity = lambda t, label: {"text": t, "label": label, "start_char": 0, "end_char": 1, "source": "acc", "confidence": 0.6, "extraction_method": "x"}
    link = lambda name, ticker: [{"mention": name, "label": "ORG", "matched_name": name, "ticker": ticker, "cik": None, "score": 100.0, "resolution_method": "x", "status": "linked"}]
    head = lambda k, ticker: {"record_ord": k, "ticker": ticker, "filing": {"ticker": ticker, "cik": "7", "accession_number": f"acc-{k}", "path": "p"}}
    rows = [
        head(0, "AA") | {"entity_resolution": link("Alpha Inc", "AA"), "entities": [entity("Steel-Bars", "PRODUCT"), entity("$5", "MONEY"), entity("Gone Co", "ORG")], "relationships": [relation("competes_with", "Beta Co", "Company", 0.9), relation("supplies", "steel bars", "ProductLine", 0.9), relation("supplies", "x", "ProductLine", None)]},
        head(1, "BB") | {"entity_resolution": link("Beta Co", "BB"), "entities": [], "relationships": [relation("competes_with", "ALPHA INC", "Company", 0.9), relation("customer_of", "gone co", "Company", 0.8), relation("competes_with", "aa", "Company", 0.5, "heuristic:k")]},
        head(2, "AA") | {"entity_resolution": [], "entities": [], "relationships": [relation("competes_with", "Beta Co", "Company", 0.95)]},
    ]
    path = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").select(F.from_json("value", filings.RECORD).alias("r")).select("r.*")
    g = graph.from_records(path)
    company = {r.key: (r.name, r.cik, r.source) for r in g.nodes.filter("label = 'Company'").collect()}
    # the first mention of Beta Co was read before it was a company: its slug stays a company of its own, which later mentions find first
    assert company == {"AA": ("AA", "0000000007", None), "BB": ("Beta Co", "0000000007", None), "beta_co": ("Beta Co", None, None), "gone_co": ("Gone Co", None, "acc")}
    assert {(r.key, r.name, r.source) for r in g.nodes.filter("label = 'ProductLine'").collect()} == {("steel_bars", "steel bars", "acc-0")}
    edges = {(r.src_key, r.type, r.dst_key): (r.confidence, r.rationale) for r in g.edges.filter("src_label = 'Company' and type <> 'FILED'").collect()}
    assert edges == {("AA", "COMPETES_WITH", "beta_co"): (0.95, "of Beta Co"), ("AA", "SUPPLIES", "steel_bars"): (0.9, "of steel bars"), ("BB", "COMPETES_WITH", "AA"): (0.9, "of ALPHA INC"), ("BB", "CUSTOMER_OF", "gone_co"): (0.8, "of gone co")}
    assert g.edges.filter("type = 'FILED'").count() == 3 and g.edges.filter("type = 'MENTIONS'").count() == 2


def test_the_record_graph_reads_stored_tables(spark, monkeypatch):
    """What several tables of the graph read is stored first: edges need no join then, and nodes only those of companies."""
    seen, write = [], registry.graph.write
    monkeypatch.setattr(registry.graph, "write", lambda g, folder: (seen.append([x._jdf.queryExecution().optimizedPlan().toString().count("Join ") for x in (g.nodes, g.edges)]), write(g, folder)))
    monkeypatch.setattr(registry, "_STORED", {})
    assert registry.from_records(spark, "/root/testdata/sf0.001").edges.count() > 0
    assert seen[0][1] == 0 and seen[0][0] <= 4


def test_stored_tables_leave_the_record_nodes_as_they_are(spark):
    rows = registry.table_of(registry.records(registry.Inputs(spark, "/root/testdata/sf0.001")))
    stored = []
    keep = lambda df: stored.append(df.columns) or registry.table_of(df)
    plain, kept = (graph.from_records(rows, registry.POLICY, *more).nodes for more in ((), (keep,)))
    assert sorted(map(str, plain.collect())) == sorted(map(str, kept.collect())) and len(stored) == 5


def test_record_nodes_read_lines_once_and_write_no_edges(spark, monkeypatch):
    """The heads of records are stored, so that no plan repeats their scan of lineitem for each part of a record; nodes come without the edges' upsert."""
    data, plans, write = "/root/testdata/sf0.001", [], registry.graph.write
    plain = sorted(map(str, registry.from_records(spark, data).nodes.collect()))
    store = registry.table_of
    monkeypatch.setattr(registry, "table_of", lambda rows: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), store(rows))[1])
    monkeypatch.setattr(registry, "_STORED", {})
    written = []
    monkeypatch.setattr(registry.graph, "write", lambda g, folder: (written.append(folder), write(g, folder)))
    nodes = registry.queries()["record_nodes"](spark, data)
    assert sorted(map(str, nodes.collect())) == plain
    assert sum(p.count("Relation [l_orderkey") for p in plans) == 1 and not written


def test_the_cut_intervals_of_names_are_not_sent_whole(spark):
    """A node for each part of a version's interval: they grow out of few rows, which Spark would broadcast."""
    focal = spark.range(50).selectExpr("id * 1000 AS rec", "concat('T', id % 7) AS ticker", "concat('Firm ', id % 5) AS name")
    asked = spark.range(50).selectExpr("id * 1000 AS rec", "0 AS rel", "concat('firm ', id % 5) AS mention")
    plan = company_keys(focal, asked)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [word#" in line and "level#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
