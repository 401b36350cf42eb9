"""Extraction records made from the warehouse tables: a record for each supplier and year of shipping.

RECORDS is SQL that Spark and DuckDB both run; it gives flat tables, which ``records`` nests into the schema
of extraction records, in the order of rec.  Names change from year to year, objects name companies by
ticker or name in any case, or companies that no record is of, and some confidences are missing or low.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.plans.adapter import Inputs

HEADS = """
heads AS (
  SELECT CAST(filing_year * 1000000 + cik AS BIGINT) AS rec, ticker, CAST(cik AS BIGINT) AS s, CAST(filing_year AS BIGINT) AS y, concat(ticker, '-', CAST(filing_year AS STRING)) AS accession,
    concat('raw/10-K/', ticker, '-', CAST(filing_year AS STRING), '.html') AS path FROM raw_filings
)"""

#: What the heads' records hold.
HELD = """resolutions AS (
  SELECT rec, ticker AS r_ticker, CASE WHEN y % 3 = 0 THEN lower(s_name) ELSE s_name END AS matched_name, CASE WHEN (s + y) % 4 = 0 THEN 'unlinked' ELSE 'linked' END AS status
  FROM heads JOIN supplier ON s = s_suppkey
), said AS (
  SELECT rec, CAST(0 AS INT) AS pos, concat('Firm ', CAST((s + y) % 13 AS STRING)) AS text, 'ORG' AS label, accession AS source, CAST(0.58 AS DOUBLE) AS confidence, 'regex:org_suffix' AS method FROM heads
  UNION ALL SELECT rec, CAST(1 AS INT), concat('Person ', CAST(s % 9 AS STRING)), 'PERSON', accession, CAST(0.7 AS DOUBLE), 'ner' FROM heads
  UNION ALL SELECT rec, CAST(2 AS INT), n_name, 'GPE', accession, CAST(0.65 AS DOUBLE), 'regex:region_seed' FROM heads JOIN supplier ON s = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT rec, CAST(3 AS INT), concat('$', CAST(s AS STRING)), 'MONEY', accession, CAST(0.8 AS DOUBLE), 'regex:money' FROM heads
  UNION ALL SELECT rec, CAST(4 AS INT), concat('Part-', CAST((s * 3 + y) % 50 AS STRING)), 'PRODUCT', accession, CAST(0.6 AS DOUBLE), 'ner' FROM heads
), told AS (
  SELECT rec, CAST(0 AS INT) AS rel, 'competes_with' AS predicate, CASE WHEN y % 2 = 0 THEN upper(s_name) ELSE s_name END AS object, 'Company' AS object_type,
    round(((s * 7 + y * 13) % 101) / CAST(100 AS DOUBLE), 2) AS confidence, 'claude:m' AS method FROM heads JOIN supplier ON s_suppkey = (s * 7 + y) % 97
  UNION ALL SELECT rec, CAST(1 AS INT), 'customer_of', concat('Firm ', CAST((s * 5 + y) % 13 AS STRING)), 'Company', round(((s * 11 + y) % 101) / CAST(100 AS DOUBLE), 2), 'heuristic:k' FROM heads
  UNION ALL SELECT rec, CAST(2 AS INT), 'supplies', concat('Part ', CAST((s * 3 + y) % 50 AS STRING)), 'ProductLine', CASE WHEN s % 17 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(0.68 AS DOUBLE) END, 'heuristic:p' FROM heads
  UNION ALL SELECT rec, CAST(3 AS INT), 'exposed_to', 'Asia', 'GeographicRegion', CAST(0.62 AS DOUBLE), 'sec_form' FROM heads WHERE s % 2 = 0
  UNION ALL SELECT rec, CAST(4 AS INT), 'subsidiary_of', concat('sup', CAST((s + y) % 40 AS STRING)), 'Company', CAST(0.9 AS DOUBLE), 'claude:m' FROM heads
  UNION ALL SELECT rec, CAST(5 AS INT), 'subsidiary_of', concat('Firm_', CAST((s * 5 + y) % 13 AS STRING)), 'Company', CAST(0.75 AS DOUBLE), 'claude:m' FROM heads
)
"""

RECORDS = f"{HEADS}, {HELD}"


def records(inputs: Inputs, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """The records, one row each, in the schema that extraction writes; keep may store their heads, which each part of a record reads."""
    heads = keep(inputs.sql("SELECT * FROM heads", HEADS))
    said, told, linked = (inputs.sql(f"SELECT * FROM {t}", HELD, heads=heads) for t in ("said", "told", "resolutions"))
    entity = F.struct(F.col("text"), F.col("label"), F.lit(0).alias("start_char"), F.length("text").alias("end_char"), F.col("source"), F.col("confidence"), F.col("method").alias("extraction_method"))
    told = told.join(heads.select("rec", "ticker"), "rec")
    relation = F.struct(
        F.col("ticker").alias("subject"), "predicate", "object", "object_type", "confidence", F.concat(F.col("ticker"), F.lit(" "), F.col("predicate")).alias("source_text"), F.lit("Said so.").alias("rationale"), F.col("method").alias("extraction_method")
    )
    link = F.struct(F.col("matched_name").alias("mention"), F.lit("ORG").alias("label"), "matched_name", F.col("r_ticker").alias("ticker"), F.lit(None).cast("string").alias("cik"), F.lit(100.0).alias("score"), F.lit("ticker_exact").alias("resolution_method"), "status")

    def gathered(rows: DataFrame, at: str, value, name: str) -> DataFrame:
        return rows.groupBy("rec").agg(F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), value.alias("v")))).alias("o")).select("rec", F.transform("o", lambda x: x["v"]).alias(name))

    summary = said.groupBy("rec", "label").agg(F.count("*").alias("n")).groupBy("rec").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("entity_summary"))
    filing = F.struct("ticker", F.col("s").cast("string").alias("cik"), F.col("accession").alias("accession_number"), "path")
    out = heads.select("rec", "ticker", filing.alias("filing")).join(summary, "rec", "left")
    for part in (gathered(said, "pos", entity, "entities"), gathered(told, "rel", relation, "relationships"), gathered(linked, "rec", link, "entity_resolution")):
        out = out.join(part, "rec", "left")
    return out.withColumnRenamed("rec", "record_ord")
