"""Explainable Jaccard similarity of companies over graph features.

Companies and features are numbers while pairs are made: an inverted index gives pairs that share a
feature, left < right only, with nothing but their numbers; pairs are counted, partially before they
are shuffled.  A feature held by many companies is dealt to several tasks by blocks of its holders, each
pair of blocks once.  Each company keeps its best pairs, and only those are joined with names and
with the features that they share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators import holders, links
from ledgerlens.operators.analytics import checkpointed
from ledgerlens.operators.graph import Graph, RELATION_TYPES, filers


def features(g: Graph) -> DataFrame:
    """(ticker, feature): admitted outgoing relations of filers."""
    node = g.nodes.select(F.col("label").alias("dst_label"), F.col("key").alias("dst_key"), F.coalesce("ticker", "name", "key").alias("shown"))
    rows = g.edges.filter(F.col("type").isin(*RELATION_TYPES) & (F.col("src_label") == "Company") & F.col("review_status").isin("approved", "review"))
    rows = rows.join(filers(g).withColumnRenamed("key", "src_key"), "src_key", "left_semi").join(node, ["dst_label", "dst_key"])
    return rows.select(F.col("src_key").alias("ticker"), F.concat_ws(":", "type", "shown").alias("feature")).distinct()


def numbered(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(t, f) for each (ticker, feature), and (t, ticker, n): numbers by hash, the company's count of features."""
    pairs = own.select(F.xxhash64("ticker").alias("t"), F.xxhash64("feature").alias("f"))
    return pairs, own.groupBy("ticker").agg(F.count("*").alias("n")).select(F.xxhash64("ticker").alias("t"), "ticker", "n")


def shared_counts(pairs: DataFrame, block: int) -> DataFrame:
    """(a, b, shared) with a < b for companies that share a feature; a feature with more than ``block`` holders is cut in blocks."""
    held = pairs.groupBy("f").agg(F.count("*").alias("m")).filter("m > 1").select("f", F.ceil(F.col("m") / block).cast("int").alias("k"))
    rows = pairs.join(held, "f").withColumn("i", F.pmod(F.xxhash64("t"), F.col("k")).cast("int"))
    left = rows.select("f", F.col("t").alias("a"), F.col("i").alias("x"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("y"))
    right = rows.select("f", F.col("t").alias("b"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("x"), F.col("i").alias("y"))
    return left.join(right, ["f", "x", "y"]).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def similarity(g: Graph, top_k: int = 10, block: int = 4096, few: int = links.FEW) -> DataFrame:
    """Each filer's top_k most similar ones: ticker, similar_ticker, jaccard, shared_feature_count, shared_features (the first 12).

    Up to few companies and features are compared in packed arrays, more by joins.
    """
    best = packed_best(g, top_k, few)
    if best is None:
        best = joined_best(g, top_k, block)
    names = g.nodes.filter("label = 'Company'")
    best = best.join(names.select(F.col("key").alias("ticker"), "name"), "ticker").join(names.select(F.col("key").alias("similar_ticker"), F.col("name").alias("similar_name")), "similar_ticker")
    return best.select("ticker", "name", "similar_ticker", "similar_name", "jaccard", "shared_feature_count", "shared_features")


def packed_best(g: Graph, top_k: int, few: int) -> DataFrame | None:
    """ticker, similar_ticker, jaccard, shared_feature_count, shared_features; None where companies or features are too many."""
    edges = g.edges.filter(F.col("type").isin(*RELATION_TYPES) & (F.col("src_label") == "Company") & F.col("review_status").isin("approved", "review"))
    node = g.nodes.select(F.col("label").alias("dst_label"), F.col("key").alias("dst_key"), F.coalesce("ticker", "name", "key").alias("shown"))
    numbered_by = lambda rows, name: checkpointed(rows.select(name, (F.row_number().over(Window.orderBy(name)) - 1).alias("id")))
    ends = ["type", "dst_label", "dst_key"]
    tickers = checkpointed(filers(g))
    held = checkpointed(edges.select(*ends).distinct().join(node, ["dst_label", "dst_key"]).select(*ends, F.concat_ws(":", "type", "shown").alias("feature")))
    n = tickers.count()
    if n > few or held.count() > few:
        return None
    companies, features = numbered_by(tickers, "key"), numbered_by(held.select("feature").distinct(), "feature")
    names = [r.feature for r in features.orderBy("id").select("feature").collect()]
    to = checkpointed(held.join(features, "feature").select(*ends, F.col("id").alias("b")))
    rows = edges.select("src_key", *ends).join(F.broadcast(companies.select(F.col("key").alias("src_key"), F.col("id").alias("a"))), "src_key").join(F.broadcast(to), ends).select("a", "b")
    blocks = holders.packed(rows, checkpointed)
    place = holders.places(blocks, n, len(names))
    pairs = holders.routed(blocks, place, checkpointed)
    ranks = checkpointed(holders.best(pairs, place, links.sums(blocks, n), top_k))
    low = 2**holders.BITS - 1
    found = ranks.select(F.col("t").alias("a"), (low - F.col("rank").bitwiseAND(low)).cast("int").alias("b"), (F.shiftright("rank", 49) / 10_000.0).alias("jaccard"), F.shiftright("rank", holders.BITS).bitwiseAND(2**30 - 1).alias("shared_feature_count"))
    shown = holders.common(pairs, found.select("a", "b"), place, names, 12)
    one, two = companies.select(F.col("id").alias("a"), F.col("key").alias("ticker")), companies.select(F.col("id").alias("b"), F.col("key").alias("similar_ticker"))
    return found.join(shown, ["a", "b"]).join(one, "a").join(two, "b").drop("a", "b")


def joined_best(g: Graph, top_k: int, block: int) -> DataFrame:
    """packed_best() by joins only."""
    own = features(g)
    pairs, sizes = numbered(own)
    counted = shared_counts(pairs, block)
    one = sizes.select(F.col("t").alias("a"), F.col("n").alias("na"), F.col("ticker").alias("ta"))
    two = sizes.select(F.col("t").alias("b"), F.col("n").alias("nb"), F.col("ticker").alias("tb"))
    sized = counted.join(one, "a").join(two, "b").withColumn("jaccard", F.bround(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 4))
    ends = F.explode(F.array(F.struct(F.col("ta").alias("ticker"), F.col("tb").alias("similar_ticker")), F.struct(F.col("tb").alias("ticker"), F.col("ta").alias("similar_ticker"))))
    rows = sized.select(ends.alias("e"), "jaccard", F.col("shared").alias("shared_feature_count")).select("e.*", "jaccard", "shared_feature_count")
    order = Window.partitionBy("ticker").orderBy(F.col("jaccard").desc(), F.col("shared_feature_count").desc(), "similar_ticker")
    best = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top_k).drop("place")
    # the features of the pairs that are kept
    mine = best.select("ticker", "similar_ticker").join(own, "ticker")
    common = mine.join(own.withColumnRenamed("ticker", "similar_ticker"), ["similar_ticker", "feature"])
    shown = common.groupBy("ticker", "similar_ticker").agg(F.array_join(F.slice(F.sort_array(F.collect_list("feature")), 1, 12), "; ").alias("shared_features"))
    return best.join(shown, ["ticker", "similar_ticker"])
