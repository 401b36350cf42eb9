"""Filing metadata, manifests and extraction records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.text import padded_cik

ENTITY = "text string, label string, start_char int, end_char int, source string, confidence double, extraction_method string"
RELATION = "subject string, predicate string, object string, object_type string, confidence double, source_text string, rationale string, extraction_method string"
RESOLUTION = "mention string, label string, matched_name string, ticker string, cik string, score double, resolution_method string, status string"
RECORD = (
    "record_ord bigint, ticker string, filing struct<ticker:string,cik:string,accession_number:string,path:string>, sections_found map<string,boolean>, entity_summary map<string,bigint>, "
    f"entities array<struct<{ENTITY.replace(' ', ':').replace(',:', ',')}>>, relationships array<struct<{RELATION.replace(' ', ':').replace(',:', ',')}>>, "
    f"entity_resolution array<struct<{RESOLUTION.replace(' ', ':').replace(',:', ',')}>>, relation_extraction_prompt string"
)


def latest_of_form(recent: DataFrame, form: str) -> DataFrame:
    """The first entry with the form in parallel arrays; nulls if there is none."""
    rows = F.arrays_zip("form", "accession_number", "primary_document", "filing_date")
    first = F.get(F.filter(rows, lambda r: r["form"] == form), F.lit(0))
    return recent.select("cik", first.alias("f")).select("cik", "f.accession_number", "f.primary_document", "f.filing_date")


def manifest(index: DataFrame, latest: DataFrame) -> DataFrame:
    """index with each company's latest filing and a status: missing_cik, not_found or downloaded."""
    rows = index.join(latest.withColumnRenamed("cik", "__cik"), index.cik == F.col("__cik"), "left").drop("__cik")
    status = F.when(F.col("cik").isNull(), "missing_cik").when(F.col("accession_number").isNull(), "not_found").otherwise("downloaded")
    return rows.withColumn("status", status)


def raw_path(ticker: Column, cik: Column, accession: Column, form: str = "10-K") -> Column:
    return F.concat(F.lit(f"raw/{form.replace('/', '-')}/"), ticker, F.lit("_"), padded_cik(cik), F.lit("_"), accession, F.lit(".html"))


def archive_url(base: str, cik: Column, accession: Column, document: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), cik.cast("bigint").cast("string"), F.lit("/"), F.replace(accession, F.lit("-")), F.lit("/"), document)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Extraction records, one JSON object a line, with an explicit order."""
    return spark.read.schema(RECORD).json(path)


def write_records(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """(path, html): whole files, bytes that aren't UTF-8 replaced."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("html"))


def latest_file(files: DataFrame) -> DataFrame:
    """(ticker, path): the greatest path of each ticker's files."""
    stem = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select("path", F.split(stem, "_")[0].alias("ticker")).groupBy("ticker").agg(F.max("path").alias("path"))


def write_csv(frame: DataFrame, path: str, columns: list[str]) -> None:
    frame.select(*columns).write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, escape='"', multiLine=True)


def coerced(value: Column) -> Column:
    """A CSV cell as JSON text: null and empty as they are, True and False, whole numbers, other numbers, else a string."""
    whole, real = value.try_cast("bigint"), value.try_cast("double")
    return (
        F.when(value.isin("True", "False"), F.lower(value))
        .when(value.isNull(), F.lit("null"))
        .when(value == "", F.lit('""'))
        .when(whole.isNotNull() & ~value.contains("."), whole.cast("string"))
        .when(real.isNotNull(), real.cast("string"))
        .otherwise(F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    )


def read_csv_rows(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """The first rows of a CSV, every cell coerced, in the file's column order."""
    rows = spark.read.csv(path, header=True, inferSchema=False, escape='"', multiLine=True)
    return rows.select(*(coerced(F.col(f"`{c}`")).alias(c) for c in rows.columns)).limit(limit)
