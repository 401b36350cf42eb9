"""The company index: an HTML table of constituents, a ticker-to-CIK document, and their join."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.text import index_ticker

COLUMNS = {"Symbol": "ticker", "Security": "name", "GICS Sector": "sector", "GICS Sub-Industry": "industry"}


class _Table(HTMLParser):
    """Cells of the table with an id."""

    def __init__(self, table_id: str) -> None:
        super().__init__(convert_charrefs=True)
        self.wanted, self.depth, self.cell = table_id, 0, None
        self.rows: list[list[str]] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table" and (self.depth or dict(attrs).get("id") == self.wanted):
            self.depth += 1
        elif self.depth == 1 and tag == "tr":
            self.rows.append([])
        elif self.depth == 1 and tag in ("td", "th") and self.rows:
            self.cell = []

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            self.depth -= 1
        elif tag in ("td", "th") and self.cell is not None and self.depth == 1:
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def constituents(spark: SparkSession, html: str, table_id: str = "constituents") -> DataFrame:
    """(ord, ticker, name, sector, industry) of one page's table: a bounded page, read on the driver."""
    parser = _Table(table_id)
    parser.feed(html)
    head, *rows = [r for r in parser.rows if r]
    at = [head.index(c) for c in COLUMNS]
    data = [(k, *(r[i] for i in at)) for k, r in enumerate(rows) if len(r) > max(at)]
    frame = spark.createDataFrame(data, "ord int, ticker string, name string, sector string, industry string")
    return frame.withColumn("ticker", index_ticker(F.col("ticker")))


def ticker_ciks(documents: DataFrame, json_col: str = "value") -> DataFrame:
    """(ticker, cik, ord) of a JSON object of {ticker, cik_str} entries; of equal tickers the last entry counts."""
    kind = "map<string,struct<ticker:string,cik_str:bigint>>"
    rows = documents.select(F.posexplode(F.map_values(F.from_json(json_col, kind))).alias("ord", "e"))
    rows = rows.select(F.upper("e.ticker").alias("ticker"), F.col("e.cik_str").alias("cik"), "ord")
    return rows.groupBy("ticker").agg(F.max_by("cik", "ord").alias("cik"), F.max("ord").alias("ord"))


def cik_join(index: DataFrame, ciks: DataFrame) -> DataFrame:
    """The index with its CIKs, null where there is none."""
    found = ciks.groupBy(F.upper("ticker").alias("__t")).agg(F.max_by("cik", "ord").alias("cik"))
    rows = index.withColumn("ticker", index_ticker(F.col("ticker")))
    return rows.join(found, rows.ticker == F.col("__t"), "left").drop("__t")


def missing_ciks(index: DataFrame) -> DataFrame:
    """(companies, missing): how many companies there are, and how many of them have no CIK."""
    return index.agg(F.count("*").alias("companies"), F.count_if(F.col("cik").isNull()).alias("missing"))


def company_index(spark: SparkSession, html: str, ciks: DataFrame, limit: int = 0) -> DataFrame:
    """Sorted by ticker; a limit of 0 is none."""
    rows = cik_join(constituents(spark, html), ciks).drop("ord").orderBy("ticker")
    return rows.limit(limit) if limit else rows
