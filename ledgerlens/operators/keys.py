"""Company keys of relation objects, in the order in which records were read, without recursion.

A record's focal company enters (or renames its ticker) at its position; an admitted company relation
takes the first entry whose ticker or name it equals, whatever the case, else a slug, whose first
mention enters as a placeholder.  Closed form: focal versions are valid until the next version of
their ticker (lead); a mention takes the ticker that entered first among the versions of its
lower-cased text that are valid at its record; slugs without such a version have a first mention; a
placeholder wins over a focal company if it entered before and bears the text.

Validity is joined by equality alone: a version's interval is cut into the nodes of a tree over the
records, 16 to a node, each node keeps its first ticker, and a mention asks the node above it at each
level.  A node and text has one row, so rows grow with the input however often a text is a name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import graph_slug


FAN = 16


def _floor(x: Column, level: int) -> Column:
    return F.shiftright(x, 4 * level)


def _nodes(start: Column, end: Column, levels: int) -> Column:
    """Array of (level, node) that together cover start to end - 1 and nothing else."""
    up = lambda level: -_floor(-start, level)
    named = lambda level: lambda n: F.struct(F.lit(level).alias("level"), n.alias("node"))
    span = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    parts = []
    for level in range(levels):
        lo, hi = up(level), _floor(end, level)
        nodes = span(lo, hi)
        if level < levels - 1:
            a, b = up(level + 1), _floor(end, level + 1)
            nodes = F.when(a < b, F.concat(span(lo, a * FAN), span(b * FAN, hi))).otherwise(nodes)
        parts.append(F.transform(nodes, named(level)))
    return F.concat(*parts)


def company_keys(focal: DataFrame, mentions: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """focal: (rec, ticker, name); mentions: (rec, rel, mention), rel from 0.  Returns mentions with company_key.

    keep may store a table that is read twice, so that it is made once.
    """
    least, most = focal.agg(F.min("rec"), F.max("rec")).first()
    least, most = least or 0, most or 0
    levels = 1
    while most - least >= FAN**levels:
        levels += 1
    at = F.col("rec").cast("long") - least
    own = Window.partitionBy("ticker").orderBy("rec")
    entered = focal.groupBy("ticker").agg(F.min("rec").alias("entered"))
    end = F.lit(most + 1 - least).cast("long")
    # a ticker is valid from its entry on, a name until the ticker's next version
    names = focal.select("ticker", F.lower("name").alias("word"), at.alias("start"), F.coalesce(F.lead(at).over(own), end).alias("end")).filter("word <> lower(ticker)").join(entered, "ticker")
    tickers = entered.select("ticker", F.lower("ticker").alias("word"), (F.col("entered").cast("long") - least).alias("start"), end.alias("end"), "entered")
    cover = names.unionByName(tickers).select("word", F.struct("entered", "ticker").alias("hit"), F.explode(_nodes(F.col("start"), F.col("end"), levels)).alias("n"))
    cover = cover.groupBy("word", "n.level", "n.node").agg(F.min("hit").alias("hit"))
    asked = mentions.withColumn("word", F.lower("mention")).withColumn("slug", graph_slug(F.col("mention")))
    # a focal row stands before the relations of its own record; after the last one nothing changes
    seen = F.least(at, end - 1)
    above = F.array(*[F.struct(F.lit(k).alias("level"), _floor(seen, k).alias("node")) for k in range(levels)])
    points = asked.select("word", "rec").distinct().filter(F.col("rec") >= least).select("word", "rec", F.explode(above).alias("n")).select("word", "rec", "n.*")
    # sizes are estimated before the intervals are cut: what looks small enough to be sent whole would fill the driver
    best = points.join(cover.hint("merge"), ["word", "level", "node"]).groupBy("word", "rec").agg(F.min("hit").alias("hit"))
    found = keep(asked.join(best, ["word", "rec"], "left"))
    first = found.filter("hit is null").groupBy("slug").agg(F.min(F.struct("rec", "rel", "word")).alias("p"))
    rows = found.join(first, "slug", "left")
    before = F.struct(F.col("p.rec"), F.col("p.rel")) < F.struct(F.col("rec"), F.col("rel"))
    bears = (F.col("p.word") == F.col("word")) | (F.col("word") == F.col("slug"))
    earlier = F.col("p.rec") < F.col("hit.entered")
    key = F.when(F.col("hit").isNull(), F.col("slug")).when(F.coalesce(before & bears & earlier, F.lit(False)), F.col("slug")).otherwise(F.col("hit.ticker"))
    return rows.select("rec", "rel", "mention", key.alias("company_key"))


def company_words(companies: DataFrame) -> DataFrame:
    """(word, ticker): the least ticker of the companies (ticker, name) that bear a text, in lower case."""
    return companies.select(F.lower("ticker").alias("word"), "ticker").unionByName(companies.select(F.lower("name").alias("word"), "ticker")).groupBy("word").agg(F.min("ticker").alias("ticker"))


def known_keys(companies: DataFrame, mentions: DataFrame) -> DataFrame:
    """(mention, company_key) of distinct mentions where all companies (ticker, name) are there from the beginning: the least ticker of those that bear the text, else a slug."""
    asked = mentions.select("mention").distinct().withColumn("word", F.lower("mention"))
    return asked.join(company_words(companies), "word", "left").select("mention", F.coalesce("ticker", graph_slug(F.col("mention"))).alias("company_key"))


def with_known_keys(rows: DataFrame, companies: DataFrame, mention: str, few: int = 100_000) -> DataFrame:
    """rows with company_key, as known_keys gives it; a null mention has none.

    The words of few companies are sent to the rows, which then need no shuffle however many they are; more are joined by distinct mention.
    """
    if companies.limit(few + 1).count() > few:
        return rows.join(known_keys(companies, rows.select(F.col(mention).alias("mention"))).withColumnRenamed("mention", mention), mention, "left")
    words = company_words(companies).select("word", F.col("ticker").alias("known"))
    joined = rows.join(F.broadcast(words), F.lower(mention) == F.col("word"), "left")
    return joined.withColumn("company_key", F.when(F.col(mention).isNotNull(), F.coalesce("known", graph_slug(F.col(mention))))).drop("word", "known")
