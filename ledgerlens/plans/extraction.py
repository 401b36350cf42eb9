"""From filing HTML to extraction records, their statistics and the review table.

A language model is a plug: a function from an excerpt and a company name to relations, applied to
Arrow batches.  Without one, or where it finds nothing, the keyword rules are used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import extract, filing
from ledgerlens.functions.text import tolerant_json
from ledgerlens.operators.gate import Policy, gate
from ledgerlens.operators.graph import best_name as record_name
from ledgerlens.operators.resolve import resolve

MOST_ENTITIES, MOST_MENTIONS = 80, 30
RELATION = ("subject", "predicate", "object", "object_type", "confidence", "source_text", "rationale", "extraction_method")
PREDICATES = ("competes_with", "supplies", "customer_of", "subsidiary_of", "exposed_to")
OBJECT_TYPES = ("Company", "ProductLine", "GeographicRegion", "Industry", "Event")
PAYLOAD = "relationships array<struct<subject:string,predicate:string,object:string,object_type:string,confidence:double,source_text:string,rationale:string>>"
REVIEW = ["ticker", "accession_number", "subject", "predicate", "object", "object_type", "confidence", "extraction_method", "review_status", "load_decision", "source_text", "rationale"]
PROMPT = "List the relations of the focal company in the excerpt: competes_with, supplies, customer_of, subsidiary_of, exposed_to. Quote the sentence of each."

Model = Callable[[str, str], list[dict]]


def payload(content: Column) -> Column:
    """The relations of a reply of typed blocks: the tool call if there is one, else its text."""
    tool = F.get(F.filter(content, lambda b: (b["type"] == "tool_use") & (b["name"] == "record_relationships")), F.lit(0))["input"]
    words = F.array_join(F.transform(F.filter(content, lambda b: b["type"] == "text"), lambda b: b["text"]), "")
    return F.from_json(F.coalesce(tool, tolerant_json(words)), PAYLOAD)["relationships"]


def valid(relations: Column) -> Column:
    """Those relations that keep to the schema: known predicates and types, confidence 0 to 1, text of at most 300."""
    fine = lambda r: r["predicate"].isin(*PREDICATES) & r["object_type"].isin(*OBJECT_TYPES) & r["confidence"].between(0, 1) & (F.coalesce(F.length(r["source_text"]), F.lit(0)) <= 300)
    return F.filter(relations, fine)


def filings(html: DataFrame, index: DataFrame) -> DataFrame:
    """(id, ticker, filing, focal, text, s, chosen) of (path, html): the latest path of each ticker, its text and sections."""
    rows = html.select("path", "html", filing.path_metadata(F.col("path")).alias("filing")).withColumn("ticker", F.col("filing.ticker"))
    latest = rows.groupBy("ticker").agg(F.max_by(F.struct("filing", "html"), "path").alias("v")).select("ticker", "v.*")
    named = latest.join(index.groupBy("ticker").agg(F.max_by("name", "ord").alias("__name")), "ticker", "left")
    named = named.select(F.col("filing.accession_number").alias("id"), "ticker", "filing", F.coalesce("__name", "ticker").alias("focal"), filing.html_text("html").alias("text"))
    named = named.withColumn("s", filing.sections("text"))
    return named.withColumn("chosen", filing.extraction_text(F.col("text"), F.col("s"))).withColumn("business", F.coalesce("s.business", F.lit("")))


def model_relations(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """Relations that a model finds in the excerpt of each filing's chosen text."""
    asked = docs.select("id", "focal").join(extract.excerpt(docs, "id", "chosen"), "id")

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(r.id, k, *(x.get(c) if c != "extraction_method" else f"claude:{name}" for c in RELATION)) for r in frame.itertuples() for k, x in enumerate(model(r.excerpt, r.focal))]
            yield pd.DataFrame(rows, columns=["id", "ord", *RELATION])

    kinds = ", ".join(f"{c} {'double' if c == 'confidence' else 'string'}" for c in RELATION)
    return asked.mapInPandas(ask, f"id string, ord long, {kinds}")


def relations(docs: DataFrame, entities: DataFrame, model: Model | None = None, name: str = "model") -> DataFrame:
    """(id, ord, relation columns): the model's or else the keyword rules' over the full text, then the business profile's; first ones stay."""
    rules = extract.heuristic_relations(docs, entities, "id", "text", "focal").select("id", F.col("ord").cast("long").alias("ord"), *RELATION)
    if model is not None:
        asked = model_relations(docs, model, name)
        rules = asked.unionByName(rules.join(asked.select("id").distinct(), "id", "left_anti"))
    profile = extract.business_profile(docs, "id", "business", "focal").select("id", (F.col("ord") + 10_000_000).cast("long").alias("ord"), *RELATION)
    return extract.dedupe_relations(rules.unionByName(profile), "id", 1_000_000).select("id", "ord", *RELATION)


def records(html: DataFrame, index: DataFrame, model: Model | None = None, name: str = "model", ner: Callable[[str], list[tuple[str, str, int, int]]] | None = None) -> DataFrame:
    """One extraction record for each ticker's latest filing."""
    docs = filings(html, index)
    found = extract.dedupe_entities(extract.entities(docs, "id", "chosen", seeds=True, ner=ner), "id").withColumn("source", F.col("id"))
    related = relations(docs, found, model, name)
    mentions = found.filter("label = 'ORG'").groupBy("id", F.col("text").alias("mention")).agg(F.min("ord").alias("ord"))
    mentions = mentions.groupBy("id").agg(F.explode(F.slice(F.sort_array(F.collect_list(F.struct("ord", "mention"))), 1, MOST_MENTIONS)).alias("m")).select("id", "m.*")
    linked = mentions.join(resolve(mentions, index), "mention").withColumn("label", F.lit("ORG"))

    def gathered(rows: DataFrame, columns: list[str], name_: str, most: int | None = None) -> DataFrame:
        ordered = F.sort_array(F.collect_list(F.struct("ord", F.struct(*columns).alias("v"))))
        return rows.groupBy("id").agg((ordered if most is None else F.slice(ordered, 1, most)).alias("o")).select("id", F.transform("o", lambda x: x["v"]).alias(name_))

    summary = found.groupBy("id", "label").agg(F.count("*").alias("n")).groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("entity_summary"))
    out = docs.select("id", "ticker", "filing", F.create_map(*[x for n in filing.STARTS for x in (F.lit(n), F.col("s")[n] != "")]).alias("sections_found"))
    parts = [
        summary,
        gathered(found, ["text", "label", "start_char", "end_char", "source", "confidence", "extraction_method"], "entities", MOST_ENTITIES),
        gathered(related, list(RELATION), "relationships"),
        gathered(linked, ["mention", "label", "matched_name", "ticker", "cik", "score", "resolution_method", "status"], "entity_resolution"),
    ]
    for part in parts:
        out = out.join(part, "id", "left")
    for name in ("entities", "relationships", "entity_resolution"):
        out = out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
    return out.withColumn("relation_extraction_prompt", F.lit(PROMPT)).drop("id")


def statistics(rows: DataFrame) -> DataFrame:
    """Counts of each record: relations, confident ones, and by predicate."""
    kinds = F.transform(F.array_distinct(F.transform("relationships", lambda r: r["predicate"])), lambda p: F.struct(p, F.size(F.filter("relationships", lambda r: r["predicate"] == p))))
    relations_ = F.coalesce(F.size("relationships"), F.lit(0))
    confident = F.size(F.filter("relationships", lambda r: r["confidence"] >= 0.7))
    return rows.select("ticker", F.aggregate(F.map_values("entity_summary"), F.lit(0).cast("long"), lambda a, b: a + b).alias("entity_count"), relations_.alias("relationship_count"), confident.alias("high_confidence_relationship_count"), "entity_summary", F.map_from_entries(kinds).alias("relationship_type_counts"))


def review_rows(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The review table of records: each relation with its gate's decision."""
    flat = rows.select("ticker", F.col("filing.accession_number").alias("accession_number"), F.explode("relationships").alias("r")).select("ticker", "accession_number", "r.*")
    return gate(flat, policy, "confidence", "extraction_method").select(*REVIEW)


def best_name(rows: DataFrame) -> DataFrame:
    """(ticker, name): the first linked resolution with the record's own ticker, else the ticker."""
    return rows.select("ticker", record_name().alias("name"))


def ticker_list(text: str, macros: dict[str, list[str]] | None = None) -> list[str]:
    """A comma-separated list, or the name of a list in macros."""
    named = {k.casefold(): v for k, v in (macros or {}).items()}.get(text.strip().casefold())
    return named if named is not None else [t.strip().upper() for t in text.split(",") if t.strip()]
