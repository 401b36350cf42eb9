"""Sources, streaming, service functions and commands."""

import json
import time

import pytest

from ledgerlens import cli, serve
from ledgerlens.plans import registry
from ledgerlens.sources import http
from ledgerlens.streaming.filings import current, ingest, record_stream

DIR = "/root/testdata/sf0.001"


def test_rate_limiter_waits():
    limiter = http.RateLimiter(2)
    limiter.wait()
    began = time.monotonic()
    limiter.wait()
    assert time.monotonic() - began >= 0.45


@pytest.mark.parametrize("given,want", [("", "http://127.0.0.1:8000"), (" http://localhost:9000/// ", "http://localhost:9000/")])
def test_normal_base(given, want):
    assert http.normal_base(given) == want


def test_agent_must_be_real():
    for agent in (None, " ", "me@example.com"):
        with pytest.raises(ValueError):
            http.checked_agent(agent)


def test_http_source_reads_every_url(spark, tmp_path):
    urls = []
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text(f"body {k}")
        urls.append((tmp_path / f"{k}.txt").as_uri())
    spark.dataSource.register(http.HttpText)
    rows = spark.read.format("http_text").option("urls", "\n".join(urls)).option("userAgent", "t t@t.org").option("requestsPerSecond", "100").option("partitions", "2").load()
    assert sorted(r.body for r in rows.collect()) == ["body 0", "body 1", "body 2"]


def record(k, conf, obj="Peer"):
    rel = {"subject": "S", "predicate": "competes_with", "object": obj, "object_type": "Company", "confidence": conf, "source_text": f"t{k}", "rationale": "", "extraction_method": "claude:m"}
    return json.dumps({"record_ord": k, "ticker": "S", "relationships": [rel]})


def test_streamed_edges_keep_the_last(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k, conf in enumerate((0.9, 0.8, 0.75)):
        (source / f"{k}.json").write_text(record(k, conf) + "\n" + record(k, 0.9, f"P{k}"))
        query = ingest(record_stream(spark, str(source)), str(tmp_path / "t"), str(tmp_path / "c"))
        query.awaitTermination()
        assert query.exception() is None
    rows = {r.dst_key: (r.confidence, r.rationale) for r in current(spark, str(tmp_path / "t")).collect()}
    assert rows == {"peer": (0.75, ""), "p0": (0.9, ""), "p1": (0.9, ""), "p2": (0.9, "")}


def test_streamed_objects_take_known_keys(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text(record(0, 0.9) + "\n" + record(0, None, "Unsure"))
    known = spark.createDataFrame([("PR", "PEER")], "ticker string, name string")
    ingest(record_stream(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c"), companies=known).awaitTermination()
    assert [r.dst_key for r in current(spark, str(tmp_path / "t")).collect()] == ["PR"]


def test_stored_results_of_algorithms(spark, tmp_path):
    g = registry.stored(spark, DIR)
    with pytest.raises(serve.NotFound):
        serve.algorithm(spark, "similarity", str(tmp_path))
    rows = serve.algorithm(spark, "similarity", str(tmp_path), 3, refresh=g).collect()
    assert len(rows) == 3 and serve.algorithm(spark, "similarity", str(tmp_path), 3).collect() == rows
    with pytest.raises(ValueError):
        serve.algorithm(spark, "pagerank", str(tmp_path), 101)


def test_pages_are_fetched_once(spark, tmp_path):
    import http.server
    import threading

    from ledgerlens.sources import http as http_source

    asked = []

    class Pages(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            self.send_response(200)
            self.end_headers()
            self.wfile.write(f"page {self.path}".encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    (tmp_path / "urls").write_text("\n".join(f"http://127.0.0.1:{server.server_port}/{k}.html" for k in range(3)))
    assert cli.main(["download", "-", f"{tmp_path}/pages", "--urls", f"{tmp_path}/urls", "--agent", "t t@t.org"], spark) == 0
    assert sorted(asked) == ["/0.html", "/1.html", "/2.html"]
    with pytest.raises(http_source.ServiceError):
        http_source.api_get(f"http://127.0.0.1:{server.server_port}", "x", {"limit": 5, "none": None})
    assert asked.pop() == "/x?limit=5"
    server.shutdown()
    assert {(r.path, r.value) for r in spark.read.text(f"{tmp_path}/pages").collect()} == {(f"{k}.html", f"page /{k}.html") for k in range(3)}


def test_index_and_sample_commands(spark, tmp_path, capsys):
    from test_records import HTML

    folder = tmp_path / "in"
    folder.mkdir()
    row = "<tr><td>{}</td><td>{}</td><td>Tech</td><td>Steel</td></tr>"
    table = row.format("AC", "Acme Corporation") + row.format("RV.B", "Rival Holdings")
    (folder / "constituents.html").write_text(f"<table id=constituents><tr><th>Symbol</th><th>Security</th><th>GICS Sector</th><th>GICS Sub-Industry</th></tr>{table}</table>")
    (folder / "tickers.json").write_text(json.dumps({"0": {"ticker": "AC", "cik_str": 7}}))
    assert cli.main(["index", str(folder), f"{tmp_path}/index"], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"companies": 2, "missing": 1}
    html = tmp_path / "raw"
    html.mkdir()
    (html / "AC_0000000007_acc-1.html").write_text(HTML)
    for command in ("ner", "relations", "sample"):
        assert cli.main([command, str(html), f"{tmp_path}/{command}", "--index", f"{tmp_path}/index", "--tickers", "ac"], spark) == 0
    assert json.loads(capsys.readouterr().out)["ORG"] >= 3
    stats = json.loads("\n".join(r.value for r in spark.read.text(f"{tmp_path}/sample/stats", wholetext=True).collect()))
    assert stats["filings"][0]["ticker"] == "AC" and stats["filings"][0]["relationship_count"] > 3
    assert spark.read.json(f"{tmp_path}/relations").filter("object = 'Rival Holdings'").count() == 1
    records = json.loads(spark.read.text(f"{tmp_path}/sample/records").first().value)
    records["record_ord"] = 0
    (tmp_path / "records.json").write_text(json.dumps(records))
    assert cli.main(["load-records", f"{tmp_path}/records.json", f"{tmp_path}/graph"], spark) == 0
    edges = spark.read.parquet(f"{tmp_path}/graph/edges")
    assert edges.filter("type = 'COMPETES_WITH' and dst_key = 'rival_holdings' and rationale is not null").count() == 1


def test_service_bounds_and_missing(spark):
    g = registry.stored(spark, DIR)
    assert serve.health(g)["status"] == "ok"
    assert serve.companies(g, focal_only=True, limit=3).count() == 3
    assert set(serve.summary(g)) == {"labels", "relationships", "review_statuses"}
    with pytest.raises(ValueError):
        serve.neighbors(g, "SUP1", 101)
    with pytest.raises(serve.NotFound):
        serve.company(g, "NOPE")
    assert serve.company(g, "sup7").count() == 1
    assert 0 < serve.neighbors(g, "SUP7", 5).count() <= 5


def test_commands(spark, tmp_path, capsys):
    assert cli.run(spark, "load", DIR, f"{tmp_path}/g") == 0
    assert spark.read.parquet(f"{tmp_path}/g/nodes").count() == registry.queries()["node_upsert"](spark, DIR).count()
    assert cli.run(spark, "triples", DIR, f"{tmp_path}/nt") == 0
    assert cli.run(spark, "analytics", DIR, f"{tmp_path}/a") == 0
    assert spark.read.csv(f"{tmp_path}/a/pagerank", header=True).columns == ["ticker", "name", "is_focal", "score", "degree"]
    assert cli.run(spark, "validate", DIR, "") == 1  # blank evidence is planted in the inputs
    assert json.loads(capsys.readouterr().out)["extracted_relationships_have_evidence"] is False


def test_import_without_the_training_data_package(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parents[1]
    shutil.copytree(repo / "ledgerlens", tmp_path / "ledgerlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 50 and not [k for k in q if k.startswith('op')] and 'pipeline' not in q"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}).returncode == 0
