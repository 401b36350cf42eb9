"""The engine's inputs made from the warehouse tables: companies, filings and extracted relations.

The text is SQL that Spark and DuckDB both run; everything after it (gate, upserts, graph, queries) is the
engine's own DataFrame code here and separate SQL in the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem")

ADAPTER = """
lines AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, round(l_discount, 2) AS disc, l_quantity AS qty,
    CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS ord,
    round(((l_orderkey * 7 + l_linenumber * 13) % 101) / CAST(100 AS DOUBLE), 2) AS conf,
    CASE (l_orderkey + l_linenumber) % 3 WHEN 0 THEN 'claude:m' WHEN 1 THEN 'heuristic:k' ELSE 'sec_form' END AS method,
    CASE WHEN l_linenumber = 7 THEN ' ' ELSE concat('Order ', CAST(l_orderkey AS STRING), ' names it.') END AS evidence,
    concat('Line ', CAST(l_linenumber AS STRING), ' of an order.') AS rationale, concat('SUP', CAST(l_suppkey AS STRING), '-', CAST(year(l_shipdate) AS STRING)) AS accession
  FROM lineitem WHERE l_discount > 0.085 AND l_quantity >= 45
), raw_companies AS (
  SELECT concat('SUP', CAST(s_suppkey AS STRING)) AS ticker, s_name AS name, CAST(s_suppkey AS BIGINT) AS cik, r_name AS industry
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), raw_filings AS (
  SELECT concat('SUP', CAST(l_suppkey AS STRING)) AS ticker, CAST(l_suppkey AS BIGINT) AS cik, CAST(year(l_shipdate) AS INT) AS filing_year,
    CAST(CAST(max(l_shipdate) AS DATE) AS STRING) AS filing_date FROM lineitem GROUP BY l_suppkey, year(l_shipdate)
), raw_relations AS (
  SELECT ord, concat('SUP', CAST(l_suppkey AS STRING)) AS ticker, 'supplies' AS predicate, concat(p_brand, '/', p_type) AS object, 'ProductLine' AS object_type, conf, method, evidence, rationale, accession
  FROM lines JOIN part ON l_partkey = p_partkey
  UNION ALL
  SELECT ord, concat('SUP', CAST(l_suppkey AS STRING)), 'exposed_to', n_name, 'GeographicRegion', conf, method, evidence, rationale, accession
  FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE qty >= 48
  UNION ALL
  SELECT ord, concat('SUP', CAST(l_suppkey AS STRING)), 'customer_of', concat('Cus ', CAST(o_custkey AS STRING)), 'Company', conf, method, evidence, rationale, accession
  FROM lines JOIN orders ON l_orderkey = o_orderkey WHERE disc >= 0.1 AND qty >= 48
  UNION ALL
  SELECT CAST(0 AS BIGINT), concat('SUP', CAST(a.s_suppkey AS STRING)), 'competes_with',
    CASE b.s_suppkey % 4 WHEN 0 THEN upper(b.s_name) WHEN 1 THEN concat('Sup', CAST(b.s_suppkey AS STRING)) WHEN 2 THEN b.s_name ELSE concat('SUP', CAST(b.s_suppkey AS STRING)) END, 'Company',
    round(((a.s_suppkey * 7 + b.s_suppkey * 13) % 101) / CAST(100 AS DOUBLE), 2),
    CASE (a.s_suppkey + b.s_suppkey) % 3 WHEN 0 THEN 'claude:m' WHEN 1 THEN 'heuristic:k' ELSE 'sec_form' END, concat(a.s_name, ' competes with ', b.s_name), 'Same nation.', CAST(NULL AS STRING)
  FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey
  UNION ALL
  SELECT CAST(0 AS BIGINT), concat('SUP', CAST(s_suppkey AS STRING)), 'subsidiary_of', concat('sup', CAST(CAST(floor(s_suppkey / 10.0) AS BIGINT) AS STRING)), 'Company',
    CAST(0.9 AS DOUBLE), 'claude:m', concat(s_name, ' is a subsidiary'), 'By number.', CAST(NULL AS STRING) FROM supplier WHERE s_suppkey >= 10
), raw_mentions AS (
  SELECT ord, concat('SUP', CAST(l_suppkey AS STRING), '-', CAST(year(l_shipdate) AS STRING)) AS accession_number, 'PRODUCT' AS entity_label,
    concat(p_brand, '/', p_type) AS text, conf, 'regex:product' AS method
  FROM lines JOIN part ON l_partkey = p_partkey
  UNION ALL
  SELECT ord, accession, 'ORG', concat('CUS ', CAST(o_custkey AS STRING)), conf, 'regex:org_suffix' FROM lines JOIN orders ON l_orderkey = o_orderkey WHERE disc >= 0.1 AND qty >= 49
  UNION ALL
  SELECT ord, accession, 'MONEY', '$1', conf, 'regex:money' FROM lines WHERE qty >= 50
)
"""


class Inputs:
    """companies, filings, relations and mentions of one set of tables, unread until used."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark, self._dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")

    def sql(self, query: str, more: str = "", **instead: DataFrame) -> DataFrame:
        """The query over the adapted tables; those given instead are views while it is analysed, since Spark drops the hints of tables named by WITH."""
        read = [t for t in TABLES if t not in instead]
        heads = ", ".join(f"{t} AS (SELECT * FROM {{{t}}})" for t in read)
        for name, rows in instead.items():
            rows.createOrReplaceTempView(name)
        try:
            return self._spark.sql(f"WITH {heads}, {ADAPTER}{', ' + more if more else ''} {query}", **{t: self.table(t) for t in read})
        finally:
            for name in instead:
                self._spark.catalog.dropTempView(name)

    def spread_suppliers(self, few: int = 100_000) -> DataFrame:
        """Suppliers dealt to all tasks: one small file is one task, which would make every pair of them by itself.  Few are sent whole to be paired with."""
        rows = self.table("supplier")
        small = rows.select("s_suppkey").limit(few + 1).count() <= few
        rows = rows.repartition(int(self._spark.conf.get("spark.sql.shuffle.partitions")), "s_suppkey")
        return F.broadcast(rows) if small else rows

    @property
    def companies(self) -> DataFrame:
        return self.sql("SELECT * FROM raw_companies")

    @property
    def filings(self) -> DataFrame:
        return self.sql("SELECT * FROM raw_filings")

    @property
    def relations(self) -> DataFrame:
        return self.sql("SELECT * FROM raw_relations", supplier=self.spread_suppliers())

    @property
    def mentions(self) -> DataFrame:
        return self.sql("SELECT * FROM raw_mentions")
