"""The property graph: node and edge tables made by keyed upserts, and patterns over them.

Inputs are tables of companies, filings, relations and mentions (``build``) or extraction records, whose
order decides what a company is called (``from_records``); both end in ``assemble``.

Upserts keep the last row of a key by an explicit order, with max_by, so that Spark combines
rows before it shuffles and no key is sorted in one place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.text import graph_slug, padded_cik
from ledgerlens.operators.gate import Policy, gate
from ledgerlens.operators.keys import company_keys, with_known_keys

RELATION_TYPES = ("COMPETES_WITH", "SUPPLIES", "CUSTOMER_OF", "SUBSIDIARY_OF", "EXPOSED_TO")
#: Labels of extracted entities; a label that is not here (money) makes no node.
ENTITY_LABELS = {"ORG": "Company", "PERSON": "Person", "GPE": "GeographicRegion", "LOC": "GeographicRegion", "PRODUCT": "ProductLine"}
EDGE_KEY = ("src_label", "src_key", "type", "dst_label", "dst_key")
EDGE_VALUES = ("predicate", "confidence", "source_text", "rationale", "extraction_method", "review_status", "load_decision")
NODE_VALUES = ("ticker", "name", "cik", "industry", "accession_number", "path", "form_type", "filing_date", "source", "confidence", "extraction_method")
# What edges from metadata and mentions say of themselves.
FILED_METHOD, FILED_RATIONALE = "sec_submissions_metadata", "Filing downloaded from SEC EDGAR submissions metadata."
MENTION_RATIONALE = "Entity mention extracted from filing text."


def entity_label(label: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in ENTITY_LABELS.items() for x in pair])[label]


def last_of(rows: DataFrame, keys: tuple[str, ...], order: list[Column]) -> DataFrame:
    """One row a key: the last by the order."""
    values = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v")).select(*keys, "v.*")


def first_of(rows: DataFrame, keys: tuple[str, ...], order: list[Column]) -> DataFrame:
    values = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("v")).select(*keys, "v.*")


@dataclass
class Graph:
    nodes: DataFrame  # label, key and NODE_VALUES
    edges: DataFrame  # EDGE_KEY and EDGE_VALUES


def accession(ticker: Column, year: Column) -> Column:
    return F.concat(ticker, F.lit("-"), year.cast("string"))


def filing_rows(filings: DataFrame) -> DataFrame:
    key = accession(F.col("ticker"), F.col("filing_year"))
    return filings.select("ticker", padded_cik(F.col("cik")).alias("cik"), key.alias("accession_number"), F.concat(F.lit("raw/10-K/"), F.col("ticker"), F.lit("_"), padded_cik(F.col("cik")), F.lit("_"), key, F.lit(".html")).alias("path"), F.lit("10-K").alias("form_type"), "filing_date")


def relation_edges(relations: DataFrame, policy: Policy, companies: DataFrame | None = None) -> DataFrame:
    """Admitted relations as edges from the focal company, in their order; companies (ticker, name) are those that objects may name."""
    rows = gate(relations, policy).filter("load_decision = 'load'")
    slug = graph_slug(F.col("object"))
    if companies is not None:
        rows = with_known_keys(rows, companies, "object")
        slug = F.when(F.col("object_type") == "Company", F.col("company_key")).otherwise(slug)
    return related_edges(rows.withColumnsRenamed({"conf": "confidence", "method": "extraction_method", "evidence": "source_text"}), slug)


def related_edges(rows: DataFrame, key: Column) -> DataFrame:
    """Edges of admitted relations whose target's key is given."""
    either = lambda name: F.col(name) if name in rows.columns else F.lit(None).cast("string").alias(name)
    return rows.select(
        F.lit("Company").alias("src_label"), F.col("ticker").alias("src_key"), F.upper("predicate").alias("type"), F.col("object_type").alias("dst_label"), key.alias("dst_key"),
        "predicate", "confidence", "source_text", either("rationale"), "extraction_method", "review_status", "load_decision", "ord", F.col("object").alias("name"), either("accession").alias("source"),
    )


def mention_edges(mentions: DataFrame) -> DataFrame:
    """Edges from filings to what they mention: rows (ord, accession_number, entity_label, text, conf, method); labels without a node make none."""
    rows = mentions.withColumn("dst_label", entity_label(F.col("entity_label"))).filter("dst_label is not null")
    source = F.col("source") if "source" in rows.columns else F.col("accession_number")
    return rows.select(
        F.lit("Filing").alias("src_label"), F.col("accession_number").alias("src_key"), F.lit("MENTIONS").alias("type"), "dst_label", graph_slug(F.col("text")).alias("dst_key"),
        F.lit("mentions").alias("predicate"), F.col("conf").alias("confidence"), F.col("text").alias("source_text"), F.lit(MENTION_RATIONALE).alias("rationale"), F.col("method").alias("extraction_method"), F.lit("approved").alias("review_status"), F.lit("load").alias("load_decision"), "ord", F.col("text").alias("name"), source.alias("source"),
    )


def node(frame: DataFrame, label: Column, key: Column, **values: Column) -> DataFrame:
    kinds = {"confidence": "double"}
    return frame.select(label.alias("label"), key.alias("key"), *(values.get(v, F.lit(None)).cast(kinds.get(v, "string")).alias(v) for v in NODE_VALUES))


def assemble(companies: DataFrame, filing: DataFrame, related: DataFrame, mentioned: DataFrame) -> Graph:
    """Node and edge tables of companies (ticker, name, padded cik, industry), filings, and edges with their order.

    A company that is only an object enters under its key with its first name; a company that is
    mentioned takes the mention's name, source, confidence and method.
    """
    filed = filing.select(
        F.lit("Company").alias("src_label"), F.col("ticker").alias("src_key"), F.lit("FILED").alias("type"), F.lit("Filing").alias("dst_label"), F.col("accession_number").alias("dst_key"),
        F.lit("filed").alias("predicate"), F.lit(1.0).alias("confidence"), F.lit("").alias("source_text"), F.lit(FILED_RATIONALE).alias("rationale"), F.lit(FILED_METHOD).alias("extraction_method"), F.lit("approved").alias("review_status"), F.lit("load").alias("load_decision"),
    )
    others = related.filter("dst_label = 'Company'").join(companies.select(F.col("ticker").alias("dst_key")), "dst_key", "left_anti")
    first = first_of(others.select("dst_key", "ord", "name"), ("dst_key",), [F.col("ord"), F.col("name")])
    known = companies.select("ticker", "name", "cik", "industry").unionByName(first.select(F.col("dst_key").alias("ticker"), "name", F.lit(None).cast("string").alias("cik"), F.lit(None).cast("string").alias("industry")))

    things = related.filter("dst_label <> 'Company'").unionByName(mentioned).select("dst_label", "dst_key", "name", "source", "confidence", "extraction_method", "ord")
    # two lines of an order may bear one number: the source decides last, so that every run keeps the same row
    entities = last_of(things, ("dst_label", "dst_key"), [F.col("ord"), F.col("confidence"), F.col("extraction_method"), F.col("name"), F.col("source")])
    said = entities.filter("dst_label = 'Company'").select(F.col("dst_key").alias("ticker"), F.col("name").alias("said"), "source", "confidence", "extraction_method")
    known = known.join(said, "ticker", "full").withColumn("name", F.coalesce("said", "name"))
    own = {c: F.col(c) for c in ("ticker", "name", "cik", "industry", "source", "confidence", "extraction_method")}
    nodes = node(known, F.lit("Company"), F.col("ticker"), **own)
    apart = entities.filter("dst_label <> 'Company'")
    nodes = nodes.unionByName(node(apart, F.col("dst_label"), F.col("dst_key"), **{c: F.col(c) for c in ("name", "source", "confidence", "extraction_method")}))
    papers = {c: F.col(c) for c in ("ticker", "cik", "accession_number", "path", "form_type", "filing_date")}
    nodes = nodes.unionByName(node(filing, F.lit("Filing"), F.col("accession_number"), **papers))

    rows = related.unionByName(mentioned).select(*EDGE_KEY, *EDGE_VALUES, "ord")
    edges = last_of(rows, EDGE_KEY, [F.col("ord"), F.col("confidence"), F.col("extraction_method"), F.col("source_text")])
    return Graph(nodes, edges.select(*EDGE_KEY, *EDGE_VALUES).unionByName(filed))


def build(companies: DataFrame, filings: DataFrame, relations: DataFrame, mentions: DataFrame, policy: Policy = Policy(min_confidence=0.1), keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Graph:
    """The graph of input tables: all companies are known from the beginning; keep may store edges that are read several times."""
    related = keep(relation_edges(relations, policy, companies))
    return assemble(companies.withColumn("cik", padded_cik(F.col("cik"))), filing_rows(filings), related, keep(mention_edges(mentions)))


def from_records(records: DataFrame, policy: Policy = Policy(), keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Graph:
    """The graph of extraction records, read in the order of record_ord; keep may store tables that are read several times."""
    return assemble(*(keep(part) for part in record_parts(records, policy, keep)))


def record_parts(records: DataFrame, policy: Policy = Policy(), keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What assemble() takes, from extraction records: companies, filings, edges of relations and of mentions.

    Of a company and of a filing the last record counts, of an entity the last entity or relation (in a
    record, relations come after entities).  An object that is a company takes the key that the companies
    read so far give it.
    """
    rows = records.select(F.col("record_ord").alias("rec"), "ticker", "filing", "entities", "relationships", best_name().alias("name"))
    cik = padded_cik(F.col("filing.cik"))
    companies = last_of(rows.select("ticker", "rec", "name", cik.alias("cik")), ("ticker",), [F.col("rec")]).withColumn("industry", F.lit(None).cast("string"))
    filing = rows.select(F.col("filing.accession_number").alias("accession_number"), "filing.path", F.lit("10-K").alias("form_type"), "ticker", cik.alias("cik"), F.lit(None).cast("string").alias("filing_date"), "rec")
    filing = last_of(filing, ("accession_number",), [F.col("rec")])
    place = lambda phase, at: F.struct("rec", F.lit(phase).alias("phase"), F.col(at).alias("at"))
    said = rows.select("rec", F.col("filing.accession_number").alias("accession_number"), F.posexplode("entities").alias("at", "e"))
    mentioned = said.select(place(0, "at").alias("ord"), "accession_number", F.col("e.label").alias("entity_label"), "e.text", F.col("e.confidence").alias("conf"), F.col("e.extraction_method").alias("method"), "e.source")
    found = rows.select("rec", "ticker", F.col("filing.accession_number").alias("accession"), F.posexplode("relationships").alias("rel", "r")).select("rec", "rel", "ticker", "accession", "r.*")
    found = gate(found, policy, "confidence", "extraction_method").filter("load_decision = 'load'")
    named = company_keys(rows.select("rec", "ticker", "name"), found.filter("object_type = 'Company'").select("rec", "rel", F.col("object").alias("mention")), keep).select("rec", "rel", "company_key")
    found = found.join(named.hint("merge"), ["rec", "rel"], "left").withColumn("ord", place(1, "rel"))
    related = related_edges(found, F.when(F.col("object_type") == "Company", F.col("company_key")).otherwise(graph_slug(F.col("object"))))
    return companies, filing, related, mention_edges(mentioned)


def best_name() -> Column:
    """A record's company name: the first linked resolution with its own ticker, else the ticker."""
    own = F.get(F.filter("entity_resolution", lambda r: (r["status"] == "linked") & (r["ticker"] == F.col("ticker"))), F.lit(0))["matched_name"]
    return F.coalesce(own, F.col("ticker"))


def write(g: Graph, folder: str) -> None:
    """The graph's tables in a folder: nodes by label and edges by type; triples (no edges) by predicate."""
    by = "label" if "label" in g.nodes.columns else "p"
    g.nodes.repartition(by, F.pmod(F.xxhash64(*g.nodes.columns), F.lit(8))).write.mode("overwrite").partitionBy(by).parquet(f"{folder}/nodes")
    g.nodes.limit(0).write.mode("overwrite").parquet(f"{folder}/nodes_kind")
    if g.edges is not None:
        g.edges.repartition("type", F.pmod(F.xxhash64("src_key", "dst_key"), F.lit(8))).write.mode("overwrite").partitionBy("type").parquet(f"{folder}/edges")
        g.edges.limit(0).write.mode("overwrite").parquet(f"{folder}/edges_kind")


def read(spark: SparkSession, folder: str) -> Graph:
    """Tables that write() made; filters on label, type or predicate leave folders unread."""

    def whole(name: str) -> DataFrame:
        kind = spark.read.parquet(f"{folder}/{name}_kind").schema
        return spark.read.schema(kind).parquet(f"{folder}/{name}").select(*kind.names)

    there = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/edges_kind")
    edges = whole("edges") if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there) else None
    return Graph(whole("nodes"), edges)


def attached(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are nodes."""
    src = nodes.select(F.col("label").alias("src_label"), F.col("key").alias("src_key"))
    dst = nodes.select(F.col("label").alias("dst_label"), F.col("key").alias("dst_key"))
    return edges.join(src, ["src_label", "src_key"], "left_semi").join(dst, ["dst_label", "dst_key"], "left_semi")


def duplicate_keys(nodes: DataFrame) -> DataFrame:
    """Keys that break a uniqueness constraint."""
    return nodes.groupBy("label", "key").agg(F.count("*").alias("n")).filter("n > 1")


# ---- patterns ----


def with_ends(g: Graph, type_: str | None = None, src_label: str | None = None, dst_label: str | None = None) -> DataFrame:
    """Edges joined with both nodes as structs c and n; filters go to the edges first."""
    edges = g.edges
    for column, value in (("type", type_), ("src_label", src_label), ("dst_label", dst_label)):
        if value is not None:
            edges = edges.filter(F.col(column) == value)
    whole = F.struct(*g.nodes.columns)
    src = g.nodes.select(F.col("label").alias("src_label"), F.col("key").alias("src_key"), whole.alias("c"))
    dst = g.nodes.select(F.col("label").alias("dst_label"), F.col("key").alias("dst_key"), whole.alias("n"))
    return edges.join(src, ["src_label", "src_key"]).join(dst, ["dst_label", "dst_key"])


def incidences(edges: DataFrame) -> DataFrame:
    """A row for each edge and each of its ends; a self-loop has one end."""
    ends = F.array_distinct(F.array(F.struct(F.col("src_label").alias("label"), F.col("src_key").alias("key")), F.struct(F.col("dst_label").alias("label"), F.col("dst_key").alias("key"))))
    return edges.select(F.explode(ends).alias("e")).select("e.label", "e.key")


def degrees(g: Graph, label: str | None = None) -> DataFrame:
    """label, key, degree over all edge types; nodes without edges have 0."""
    counts = incidences(g.edges).groupBy("label", "key").agg(F.count("*").alias("degree"))
    nodes = g.nodes if label is None else g.nodes.filter(F.col("label") == label)
    return nodes.select("label", "key").join(counts, ["label", "key"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def filers(g: Graph) -> DataFrame:
    return g.edges.filter("type = 'FILED' and src_label = 'Company'").select(F.col("src_key").alias("key")).distinct()


def orphans(g: Graph) -> DataFrame:
    return g.nodes.join(incidences(g.edges).distinct(), ["label", "key"], "left_anti")


def neighbours(g: Graph, ticker: str) -> DataFrame:
    """Both directions of a company's edges, with the node at the other end."""
    node = g.nodes.select(F.col("label").alias("o_label"), F.col("key").alias("o_key"), F.coalesce("ticker", "name", "key", "accession_number").alias("shown"), "name")
    mine = (F.upper("src_key") == ticker.upper()) & (F.col("src_label") == "Company")
    theirs = (F.upper("dst_key") == ticker.upper()) & (F.col("dst_label") == "Company")
    values = [F.col("type").alias("relationship"), "confidence", "review_status", "source_text"]
    out = g.edges.filter(mine).select(F.col("dst_label").alias("o_label"), F.col("dst_key").alias("o_key"), *values)
    back = g.edges.filter(theirs & ~(mine & (F.col("src_key") == F.col("dst_key")))).select(F.col("src_label").alias("o_label"), F.col("src_key").alias("o_key"), *values)
    return out.unionByName(back).join(node, ["o_label", "o_key"]).select("relationship", F.col("o_label").alias("label"), F.col("shown").alias("key"), "name", "confidence", "review_status", "source_text")


def two_hops(g: Graph, ticker: str) -> DataFrame:
    """Undirected paths of one or two edges from a company; an edge is used once in a path."""
    here = F.struct(F.col("src_label").alias("label"), F.col("src_key").alias("key"))
    there = F.struct(F.col("dst_label").alias("label"), F.col("dst_key").alias("key"))
    edge = F.concat_ws("|", *EDGE_KEY)
    both = g.edges.select(here.alias("a"), there.alias("b"), edge.alias("edge"), "type").unionByName(g.edges.filter((F.col("src_key") != F.col("dst_key")) | (F.col("src_label") != F.col("dst_label"))).select(there.alias("a"), here.alias("b"), edge.alias("edge"), "type"))
    first = both.filter((F.col("a.label") == "Company") & (F.col("a.key") == ticker))
    second = both.select(F.col("a").alias("m"), F.col("b").alias("z"), F.col("edge").alias("edge2"), F.col("type").alias("type2"))
    longer = first.join(second, (F.col("b") == F.col("m")) & (F.col("edge") != F.col("edge2")))
    none = F.lit(None).cast("string")
    one = first.select(F.lit(1).alias("hops"), F.col("type").alias("type1"), F.col("b.key").alias("middle"), none.alias("type2"), none.alias("last"))
    return one.unionByName(longer.select(F.lit(2).alias("hops"), F.col("type").alias("type1"), F.col("b.key").alias("middle"), "type2", F.col("z.key").alias("last")))
