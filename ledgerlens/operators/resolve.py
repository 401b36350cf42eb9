"""Linking of mentions to a company index: exact tickers, then the best token-set ratio.

A ratio is 100 exactly where one set of tokens holds the other; such names come from an inverted index
of tokens, joined by the rarest token of the smaller set.  Every other mention is compared with every
name, as its best score counts even below the threshold: blocks of mentions meet blocks of names, each
pair in a task's memory for itself, so an index of any size gives the same answers.  That part's work is
mentions times names.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.analytics import checkpointed

THRESHOLD, BLOCK = 92.0, 512


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len a + len b), with bit-parallel rows."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & masks.get(c, 0)
        row = (row + u | row - u) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the shared tokens and the shared tokens with either rest; 100 if one set holds the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    left = " ".join(sorted(x - y))
    right = " ".join(sorted(y - x))
    one, two = (f"{both} {left}".strip(), f"{both} {right}".strip())
    scores = [indel_ratio(one, two)]
    if both:
        scores += [indel_ratio(both, one), indel_ratio(both, two)]
    return max(scores)


def resolve_exact(mentions: DataFrame, index: DataFrame) -> DataFrame:
    """Mentions that are a ticker in any case: the first index row (by ord) of it."""
    order = Window.partitionBy("mention").orderBy("ord")
    hits = mentions.select("mention").distinct().join(index, F.lower("mention") == F.lower("ticker"))
    rows = hits.withColumn("n", F.row_number().over(order)).filter("n = 1")
    return rows.select("mention", F.col("name").alias("matched_name"), "ticker", F.col("cik").cast("string").alias("cik"), F.lit(100.0).alias("score"), F.lit("ticker_exact").alias("resolution_method"), F.lit("linked").alias("status"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def token_set(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: sorted(set(t.split())))


def holding(asked: DataFrame, names: DataFrame) -> DataFrame:
    """(mention, place, name): the first name whose tokens hold the mention's or are held by them."""
    tokens = names.select("name", "place", "words", F.explode("words").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    wanted = asked.select("mention", F.col("words").alias("mine"), F.explode("words").alias("token"))
    held = tokens.join(counts, "token").groupBy("name", "place", "words").agg(F.min(F.struct("n", "token")).alias("rare")).withColumn("token", F.col("rare.token"))
    inner = wanted.join(held, "token").filter(F.size(F.array_except("words", "mine")) == 0)
    rare = wanted.join(counts, "token", "left").groupBy("mention", "mine").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rare"))
    outer = rare.filter("rare.n > 0").withColumn("token", F.col("rare.token")).join(tokens, "token").filter(F.size(F.array_except("mine", "words")) == 0)
    both = inner.select("mention", "place", "name").unionByName(outer.select("mention", "place", "name"))
    return both.groupBy("mention").agg(F.min(F.struct("place", "name")).alias("v")).select("mention", "v.*")


def best_of_block(mentions: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
    """(mention, name, place, score): the first best name of a block for each mention of a block."""
    choices = [(name, place, set(name.split())) for name, place in names.sort_values(["place", "name"])[["name", "place"]].itertuples(index=False)]
    choices = [(name, place, words, " ".join(sorted(words))) for name, place, words in choices]
    rows = []
    for mention in mentions.mention:
        own = set(mention.split())
        text = " ".join(sorted(own))
        top, at, score = None, 0, 0.0
        for name, place, words, other in choices:
            if own.isdisjoint(words):
                if not words or 200.0 * min(len(text), len(other)) / (len(text) + len(other)) <= score:
                    continue
                s = indel_ratio(text, other)
            else:
                s = token_set_ratio(mention, name)
            if s > score:
                top, at, score = name, place, s
        if top is not None:
            rows.append((mention, top, at, score))
    return pd.DataFrame(rows, columns=["mention", "name", "place", "score"])


def nearest(rest: DataFrame, names: DataFrame, block: int) -> DataFrame:
    """(mention, place, name, score): the first of all names that is best; none if all score 0."""
    m, n = (math.ceil(rows.count() / block) for rows in (rest, names))
    cells = lambda k: F.explode(F.sequence(F.lit(0), F.lit(max(k, 1) - 1)))
    own = lambda c, k: F.pmod(F.xxhash64(c), F.lit(max(k, 1))).cast("int")
    left = rest.select("mention", own("mention", m).alias("i"), cells(n).alias("j"))
    right = names.select("name", "place", own("name", n).alias("j"), cells(m).alias("i"))
    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(best_of_block, "mention string, name string, place long, score double")
    best = found.groupBy("mention").agg(F.min(F.struct((-F.col("score")).alias("minus"), "place", "name")).alias("v"))
    return best.select("mention", "v.place", "v.name", (-F.col("v.minus")).alias("score"))


def resolve(mentions: DataFrame, index: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(mention, matched_name, ticker, cik, score, resolution_method, status) for each distinct mention.

    index: (ord, ticker, name, cik); of equal names the last row counts, at the place of the first.
    """
    asked = checkpointed(mentions.select("mention").filter("mention is not null").distinct())
    exact = resolve_exact(asked, index)
    names = index.filter("name is not null").groupBy("name").agg(F.max_by(F.struct("ticker", "cik"), "ord").alias("row"), F.min("ord").cast("long").alias("place"))
    names = names.withColumn("place", F.coalesce("place", F.lit(-(2**63))))
    choices = names.select("name", "place", token_set("name").alias("words"))
    rest = asked.join(exact.select("mention"), "mention", "left_anti")
    worded = rest.select("mention", token_set("mention").alias("words")).filter("size(words) > 0")
    whole = checkpointed(holding(worded, choices))
    near = nearest(worded.join(whole, "mention", "left_anti"), names.select("name", "place"), block)
    scored = whole.select("mention", "name", F.lit(100.0).alias("score")).unionByName(near.select("mention", "name", "score"))
    fuzzy = rest.join(scored, "mention", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    fuzzy = fuzzy.select("mention", F.when(F.col("score") >= threshold, F.col("name")).alias("matched_name"), "score")
    linked = fuzzy.join(names.select(F.col("name").alias("matched_name"), "row"), "matched_name", "left")
    fuzzy = linked.select(
        "mention", "matched_name", F.col("row.ticker").alias("ticker"), F.col("row.cik").cast("string").alias("cik"), "score",
        F.lit("token_set_ratio").alias("resolution_method"), F.when(F.col("matched_name").isNull(), "unlinked").otherwise("linked").alias("status"),
    )
    return exact.unionByName(fuzzy)
