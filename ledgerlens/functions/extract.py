"""Entities and relations from filing text, with built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import SPACES, collapse, contains_any, matches, sentences, strip

# Patterns, caps and confidences of the extraction rules.
MONEY = r"(?i)\$[0-9][0-9,]*(?:\.[0-9]+)?(?U)\s?(?:billion|million|thousand)?"
ORGANISATION = r"\b[A-Z][A-Za-z&.\-]+(?:\s+[A-Z][A-Za-z&.\-]+){0,5}\s+(?:Inc\.?|Corporation|Corp\.?|Company|Co\.?|Holdings|Group|PLC|LLC)\b"
REGIONS = ["United States", "China", "Europe", "European Union", "Asia", "Japan", "Canada", "Mexico", "India", "United Kingdom"]
REGION = r"\b(?:" + "|".join(REGIONS) + r")\b"
SEEDS = {
    "ORG": ["Apple", "Microsoft", "Amazon", "Google", "Alphabet", "Meta", "NVIDIA", "JPMorgan Chase", "Walmart", "Pfizer", "Caterpillar"],
    "GPE": ["United States", "China"],
    "LOC": ["Europe", "Asia"],
}
RULES = [("MONEY", MONEY, 200, 0.8, "regex:money"), ("ORG", ORGANISATION, 200, 0.58, "regex:org_suffix"), ("GPE", REGION, 100, 0.65, "regex:region_seed")]
NER_CHARS = 250_000
LABELS = ["ORG", "PERSON", "GPE", "LOC", "MONEY", "PRODUCT"]
ENTITY = ["ord", "text", "label", "start_char", "end_char", "confidence", "extraction_method"]
MODEL_FIRST = 1_000_000
GENERIC_ORGS = ["the company", "company", "the corporation", "corporation", "the group", "group", "the nasdaq stock market llc", "new york stock exchange"]
COMPETITION, SUPPLY, MARKET = ["compet", "rival", "peer"], ["supplier", "supply", "vendor"], ["market", "operations", "sales", "revenue"]
EXCERPT_WORDS = ["compet", "supplier", "supply", "customer", "subsidiar", "geographic", "international", "china", "europe", "japan", "canada", "market", "revenue", "product"]
PRODUCT_1 = (
    r"(?i)(?:designs,\s+manufactures\s+and\s+markets|manufactures?\s+and\s+sells?|markets,\s+sells?\s+and\s+distributes?|market,\s+sell\s+and\s+distribute|"
    r"manufacture,\s+marketing,\s+sale\s+and\s+distribution\s+of|revenues\s+come\s+from\s+the\s+manufacture\s+and\s+sale\s+of)\s+([^.;:]{8,260})"
)
PRODUCT_2 = r"(?i)(?:providing|provides|offers?)\s+([^.;:]{8,120}?(?:merchandise\s+and\s+services|products\s+and\s+services|software|platforms|solutions))"
MARKETS = r"(?i)(?:work\s+across)\s+([^.;:]{8,160})"
ITEM_PREFIXES = ["sells a variety of ", "a variety of ", "broad assortment of ", "the ", "our ", "a ", "an ", "sells ", "sale of "]
ITEM_STOPS = (
    r"(?i)\b(form 10-k|customers?|pickup|following|stores|ecommerce|convenient|strategic guidance|pfizer inc|similar|new products?|competitive environments?|"
    r"solely through the internet|non-financial companies|we develop|produce media content)\b"
)
ITEM_NAMES = ["products", "services", "business", "customers", "markets"]


def entity_array(text: Column, label: str, pattern: str, cap: int, confidence: float, method: str) -> Column:
    found = F.slice(matches(F.substring(text, 1, NER_CHARS), pattern), 1, cap)
    return F.transform(found, lambda m: F.struct(m["text"].alias("text"), F.lit(label).alias("label"), m["start"].alias("start_char"), m["end"].alias("end_char"), F.lit(confidence).alias("confidence"), F.lit(method).alias("extraction_method")))


def entities(docs: DataFrame, id_col: str, text_col: str, seeds: bool = False, ner: Callable[[str], list[tuple[str, str, int, int]]] | None = None, ner_name: str = "model") -> DataFrame:
    """All entities of each text with their order: (id_col, ord, text, label, start_char, end_char, confidence, extraction_method).

    ner, a model, gives (text, label, start, end) of a text's first NER_CHARS characters; its entities come
    first.  Without one, seeds are the known names in its place.
    """
    text = F.col(text_col)
    arrays = []
    if seeds and ner is None:
        for label, words in SEEDS.items():
            pattern = r"\b(?:" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + r")\b"
            arrays.append(entity_array(text, label, pattern, NER_CHARS, 0.72 if label != "LOC" else 0.62, "seed:ruler"))
    arrays += [entity_array(text, *rule) for rule in RULES]
    rules = docs.select(id_col, F.posexplode(F.concat(*arrays)).alias("ord", "e")).select(id_col, "ord", "e.*")
    return supported(rules if ner is None else model_entities(docs, id_col, text_col, ner, ner_name).unionByName(rules.withColumn("ord", F.col("ord") + MODEL_FIRST)))


def model_entities(docs: DataFrame, id_col: str, text_col: str, ner: Callable[[str], list[tuple[str, str, int, int]]], name: str) -> DataFrame:
    """What a model finds, in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, text in frame.itertuples(index=False):
                for k, (found, label, start, end) in enumerate(ner(text or "")):
                    rows.append((key, k, found.strip(), label, start, end, 0.72 if label in ("ORG", "PERSON", "GPE") else 0.62, f"ner:{name}"))
            yield pd.DataFrame(rows, columns=[id_col, *ENTITY])

    kinds = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ord int, text string, label string, start_char int, end_char int, confidence double, extraction_method string"
    return docs.select(id_col, F.substring(text_col, 1, NER_CHARS)).mapInPandas(run, kinds)


def supported(rows: DataFrame) -> DataFrame:
    """Entities of a known label that aren't blank."""
    return rows.filter(F.col("label").isin(*LABELS) & (F.trim("text") != ""))


def dedupe_entities(rows: DataFrame, id_col: str) -> DataFrame:
    """The first of each text (in any case) and label within a document."""
    values = [c for c in rows.columns if c != id_col]
    kept = rows.groupBy(id_col, F.lower("text").alias("__t"), F.col("label").alias("__l")).agg(F.min_by(F.struct(*values), "ord").alias("v"))
    return kept.select(id_col, "v.*")


def entity_summary(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.groupBy(id_col, "label").agg(F.count("*").alias("n"))


def useful_org(value: Column, focal: Column | None = None) -> Column:
    name = strip(value)
    fine = (F.length(name) > 2) & ~F.lower(name).isin(GENERIC_ORGS)
    return fine if focal is None else fine & (F.lower(name) != F.lower(focal))


def alternation(values: Column) -> Column:
    """A pattern for any of the useful names, the longest first; null without any."""
    names = F.array_distinct(F.filter(F.transform(values, strip), lambda v: useful_org(v)))
    ordered = F.transform(F.array_sort(F.transform(names, lambda v: F.named_struct(F.lit("n"), -F.length(v), F.lit("v"), v))), lambda x: F.concat(F.lit("\\Q"), x["v"], F.lit("\\E")))
    return F.when(F.size(names) > 0, F.concat(F.lit(r"(?i)\b("), F.array_join(ordered, "|"), F.lit(r")\b")))


def relation(subject: Column, predicate: str, object_: Column, kind: str, confidence: float, sentence: Column, rationale: str, method: str) -> Column:
    values = (subject, F.lit(predicate), object_, F.lit(kind), F.lit(confidence), F.substring(sentence, 1, 300), F.lit(rationale), F.lit(method))
    names = ("subject", "predicate", "object", "object_type", "confidence", "source_text", "rationale", "extraction_method")
    return F.named_struct(*[x for n, v in zip(names, values) for x in (F.lit(n), v)])


def dedupe_relations(rows: DataFrame, id_col: str, cap: int) -> DataFrame:
    """The first of each subject, predicate and object within a document, at most cap; places count from 0."""
    values = [c for c in rows.columns if c != id_col]
    kept = rows.groupBy(id_col, F.lower("subject").alias("__s"), F.col("predicate").alias("__p"), F.lower("object").alias("__o")).agg(F.min_by(F.struct(*values), "ord").alias("v")).select(id_col, "v.*")
    order = Window.partitionBy(id_col).orderBy("ord")
    return kept.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= cap).drop("__n")


def heuristic_relations(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, focal_col: str, most_sentences: int = 80) -> DataFrame:
    """Relations by keywords in sentences that name known organisations or regions; found: deduped entities."""
    names = found.groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.when(F.col("label") == "ORG", F.struct("ord", "text")))).alias("o"),
        F.sort_array(F.collect_list(F.when(F.col("label").isin("GPE", "LOC"), F.struct("ord", "text")))).alias("r"),
    )
    pick = lambda c, n: F.slice(F.transform(F.col(c), lambda x: x["text"]), 1, n)
    rows = docs.join(names, id_col).select(id_col, F.col(focal_col).alias("focal"), alternation(pick("o", 150)).alias("orgs"), alternation(pick("r", 100)).alias("regions"), F.posexplode(F.slice(sentences(F.col(text_col)), 1, most_sentences)).alias("s_ord", "sentence"))
    s, focal = F.col("sentence"), F.col("focal")

    def hits(pattern: Column, words: list[str], cap: int) -> Column:
        return F.when(pattern.isNotNull() & contains_any(s, words), F.slice(F.regexp_extract_all(s, pattern, F.lit(1)), 1, cap)).otherwise(F.array().cast("array<string>"))

    useful = lambda a: F.filter(a, lambda v: useful_org(v, focal))
    compete = F.transform(useful(hits(F.col("orgs"), COMPETITION, 4)), lambda o: relation(focal, "competes_with", o, "Company", 0.55, s, "Competition keyword with named organization.", "heuristic:competition_keyword"))
    supply = F.transform(useful(hits(F.col("orgs"), SUPPLY, 3)), lambda o: relation(o, "supplies", focal, "Company", 0.5, s, "Supply-chain keyword with named organization.", "heuristic:supply_keyword"))
    exposed = F.transform(hits(F.col("regions"), MARKET, 3), lambda o: relation(focal, "exposed_to", o, "GeographicRegion", 0.48, s, "Geographic mention in business-exposure context.", "heuristic:geographic_exposure"))
    rows = rows.select(id_col, "s_ord", F.posexplode(F.concat(compete, supply, exposed)).alias("r_ord", "r"))
    return dedupe_relations(rows.select(id_col, (F.col("s_ord") * 1000 + F.col("r_ord")).alias("ord"), "r.*"), id_col, 40)


def business_items(raw: Column) -> Column:
    """The items of a list in prose, cleaned, in order and distinct."""
    clean = F.regexp_replace(raw, r"\([^)]*\)", "")
    clean = F.regexp_replace(clean, r"\b[A-Z][A-Za-z .,&-]+Form(?U)\s+10-K\s+\d+\b", "")
    clean = F.regexp_replace(clean, r"(?i)\b(?:worldwide|globally|principally|primarily|including|includes)\b", "")
    clean = F.replace(F.replace(clean, F.lit(" and "), F.lit(", ")), F.lit(" or "), F.lit(", "))

    def tidy(piece: Column) -> Column:
        piece = collapse(F.regexp_replace(piece, r"^[ ,.\-]+|[ ,.\-]+$", ""))
        for prefix in ITEM_PREFIXES:
            piece = strip(F.regexp_replace(piece, "(?i)^" + prefix, ""))
        return piece

    pieces = F.filter(F.transform(F.split(clean, ","), tidy), lambda p: F.length(p).between(3, 80) & ~p.rlike(ITEM_STOPS) & ~F.lower(p).isin(ITEM_NAMES))
    items = F.array_distinct(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 80))))
    return F.when(raw.rlike(r"(?i)developed(?U)\s+and\s+emerging\s+markets"), F.array(F.lit("Developed and emerging markets"))).otherwise(items)


def business_profile(docs: DataFrame, id_col: str, text_col: str, focal_col: str, most_sentences: int = 80) -> DataFrame:
    """Products (from the first sentence that yields any) and markets of the focal company."""
    rows = docs.select(id_col, F.col(focal_col).alias("focal"), F.posexplode(F.slice(sentences(F.col(text_col)), 1, most_sentences)).alias("s_ord", "sentence"))
    s, focal = F.col("sentence"), F.col("focal")
    none = F.array().cast("array<string>")
    got = lambda pattern: F.when(s.rlike(pattern), business_items(F.regexp_extract(s, pattern, 1))).otherwise(none)
    rows = rows.select(id_col, "s_ord", "sentence", "focal", got(PRODUCT_1).alias("p1"), got(PRODUCT_2).alias("p2"), got(MARKETS).alias("m"))
    rows = rows.withColumn("products", F.when(F.size("p1") > 0, F.col("p1")).otherwise(F.col("p2")))
    first = F.min(F.when(F.size("products") > 0, F.col("s_ord"))).over(Window.partitionBy(id_col))
    rows = rows.withColumn("products", F.when(F.col("s_ord") == first, F.col("products")).otherwise(none))
    products = F.transform("products", lambda o: relation(focal, "supplies", o, "ProductLine", 0.68, s, "Business section directly describes products or services sold by the focal company.", "heuristic:business_product_profile"))
    markets = F.transform("m", lambda o: relation(focal, "exposed_to", o, "GeographicRegion", 0.62, s, "Business section directly describes operating markets or geographic scope.", "heuristic:business_market_profile"))
    rows = rows.select(id_col, "s_ord", F.posexplode(F.concat(products, markets)).alias("r_ord", "r"))
    return dedupe_relations(rows.select(id_col, (F.col("s_ord") * 1000 + F.col("r_ord")).alias("ord"), "r.*"), id_col, 20)


def excerpt(docs: DataFrame, id_col: str, text_col: str, budget: int = 18_000) -> DataFrame:
    """(id_col, excerpt): the first 5000 characters and then keyword sentences, each once, until the budget is met."""
    rows = docs.select(id_col, F.substring(text_col, 1, 5000).alias("head"), F.posexplode(sentences(F.col(text_col))).alias("ord", "sentence"))
    rows = rows.filter(contains_any(F.col("sentence"), EXCERPT_WORDS)).withColumn("part", collapse(F.substring("sentence", 1, 500)))
    first = rows.groupBy(id_col, F.lower("part").alias("__k")).agg(F.min_by(F.struct("part", "ord", "head"), "ord").alias("v")).select(id_col, "v.*")
    before = Window.partitionBy(id_col).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.length("head") + 2 + F.coalesce(F.sum(F.length("part") + 2).over(before), F.lit(0))
    # the first sentence is always taken: the budget is looked at after each
    kept = first.withColumn("spent", spent).filter((F.col("spent") < budget) | (F.col("spent") == F.length("head") + 2))
    parts = kept.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("ord", "part"))).alias("p"))
    out = docs.join(parts, id_col, "left")
    joined = F.array_join(F.concat(F.array(F.substring(text_col, 1, 5000)), F.coalesce(F.transform("p", lambda x: x["part"]), F.array().cast("array<string>"))), "\n\n")
    return out.select(id_col, F.substring(joined, 1, budget).alias("excerpt"))
