"""Queries that once read a part of their tables, and the operators that let them read all of it."""

import random

import duckdb
from test_engine import _sequential

from ledgerlens.operators import keys, resolve
from ledgerlens.plans import oracle, registry


def test_company_keys_of_names_over_long_spans(spark):
    rng = random.Random(5)
    names = ["Firm 1", "Firm 2", "firm_1", "T1", "other"]
    records = [(f"T{rng.randint(0, 4)}", rng.choice(names), [rng.choice([*names, "t3", "FIRM 2"]) for _ in range(rng.randint(0, 2))]) for _ in range(700)]
    focal = spark.createDataFrame([(k, t, n) for k, (t, n, _) in enumerate(records)], "rec int, ticker string, name string")
    want = _sequential(records)
    got = keys.company_keys(focal, spark.createDataFrame([w[:3] for w in want], "rec int, rel int, mention string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_company_key_resolution_reads_whole_tables(spark):
    d = "/root/testdata/sf0.01"
    got = registry.queries()["company_key_resolution"](spark, d)
    assert got.count() == spark.read.parquet(f"{d}/lineitem.parquet").count()
    c = duckdb.connect()
    for t in ("orders", "lineitem"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = c.sql(f"SELECT rec, rel, mention, company_key FROM ({oracle.oracle()['company_key_resolution']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def _fuzzy(mention, names):
    """(matched_name, score) by brute force: the first of the best names."""
    best = max(names, key=lambda n: resolve.token_set_ratio(mention, n))
    score = resolve.token_set_ratio(mention, best)
    return best if score >= resolve.THRESHOLD else None, score


def test_org_resolution_asks_every_supplier(spark):
    d = "/root/testdata/sf0.01"
    suppliers = spark.read.parquet(f"{d}/supplier.parquet").collect()
    exact = {r.mention: r.matched_name for r in registry.queries()["org_resolution_exact"](spark, d).collect()}
    assert exact == {f"sup{r.s_suppkey}": r.s_name for r in suppliers}
    names = [r.s_name for r in sorted(suppliers, key=lambda r: r.s_suppkey)]
    fuzzy = {r.mention: (r.matched_name, r.score) for r in registry.queries()["org_resolution_fuzzy"](spark, d).collect()}
    assert fuzzy == {f"{n} Holdings": _fuzzy(f"{n} Holdings", names) for n in names}


def test_resolve_in_blocks_against_brute_force(spark):
    rng = random.Random(7)
    words = ["Steel", "Steal", "Works", "Work", "Inc", "Group", "Harbor", "Harbour", "Lights", "Light"]
    some = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
    names = list(dict.fromkeys(["", *(some() for _ in range(60)), "International Machinery"]))
    asked = {some() for _ in range(40)} | {"International Machinary", "Harbur Lihgts", "zzz", "Steel  Works Incorporated", "Wörks\u00a0Inc", ""}
    index = spark.createDataFrame([(k, f"T{k}", n, k) for k, n in enumerate(names)], "ord int, ticker string, name string, cik long")
    mentions = spark.createDataFrame([(m,) for m in sorted(asked)], "mention string")
    want = {m: _fuzzy(m, names) for m in asked}
    got = {r.mention: r for r in resolve.resolve(mentions, index, block=9).collect()}
    assert {m: (r.matched_name, r.score) for m, r in got.items()} == want
    assert all(r.ticker == (f"T{names.index(r.matched_name)}" if r.matched_name else None) for r in got.values())
    assert {s < resolve.THRESHOLD for _, s in want.values()} == {True, False} and max(s for _, s in want.values() if s < 100) > resolve.THRESHOLD


def test_resolve_has_no_most_names(spark):
    index = spark.range(50_001).selectExpr("id as ord", "concat('T', id) as ticker", "concat('Name', id, ' Co') as name", "id as cik")
    rows = resolve.resolve(spark.createDataFrame([("Co Name50000",), ("t7",), ("Name49999 Holdings Co",)], "mention string"), index).collect()
    assert {r.mention: (r.ticker, r.score) for r in rows} == {"Co Name50000": ("T50000", 100.0), "t7": ("T7", 100.0), "Name49999 Holdings Co": ("T49999", 100.0)}


def test_few_suppliers_are_sent_to_be_paired(spark):
    """A join by nation would deal all pairs of suppliers to 25 keys."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        rows = registry.Inputs(spark, "/root/testdata/sf0.001").relations.filter("predicate = 'competes_with'")
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert "BroadcastHashJoin [s_nationkey" in plan and "SortMergeJoin [s_nationkey" not in plan
    assert not spark.catalog.tableExists("supplier")


def test_edges_that_are_stored_first_are_the_same(spark):
    i = registry.Inputs(spark, "/root/testdata/sf0.001")
    tables, stored = (i.companies, i.filings, i.relations, i.mentions), []
    keep = lambda df: stored.append(df.columns) or registry.table_of(df)
    plain, kept = (registry.graph.build(*tables, registry.POLICY, *more) for more in ((), (keep,)))
    assert len(stored) == 2
    assert sorted(map(str, plain.edges.collect())) == sorted(map(str, kept.edges.collect()))
    assert sorted(map(str, plain.nodes.collect())) == sorted(map(str, kept.nodes.collect()))
