"""Mixing sources to target weights, with DataFrame functions only.

Targets: sources in code point order (null last) weigh 5, 2, 1 and so on in turn; they share all words,
no source more than three times its own, the excess being shared again by weight (solved in closed
form: the capped sources are those with the least ratio of cap to weight).

Draw: a source's documents lie in hashed blocks.  Whole passes take every block; the rest of the
target takes blocks in the order of a seeded permutation, the last of them only in part, so that the
source's words come out exact to a word.  A source's quota is the number of its block draws.

Tree: the root holds all quotas and all output shards.  Each node halves its shards; the first half gets
its share of the node's draws (exact to one), and what of each source goes there is one multivariate
hypergeometric draw: source after source, a hypergeometric variate of the draws left, found by inversion
of its distribution with a seeded uniform number.  Leaves are shards with exact quotas of every source.
A source's block draws, in the order of another seeded permutation, are dealt to the shards by their
quotas, so shards hold disjoint permuted blocks.  Documents get a place in their shard by seeded hashes.

Orders within a source are made in parallel, from sums of hash ranges and running sums in each range.

Defined cases: a null text has no words; a null source is a source; a null id is an id; repeated rows
each have their own draw; empty tables give empty results; a source without words takes none; rows
that share an id lie in blocks by their texts.  Columns named as those made here are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import WORD, table, without, word_count, written

MADE = ("size", "source_size", "target", "taken", "passes", "part", "shards")
WEIGHTS, CAP, SHARDS, BLOCK_ROWS, SEED = (5, 2, 1), 3, 16, 512, 23


def targets(sizes: DataFrame) -> DataFrame:
    """(src, source_size, n, target) from (src, source_size, n): a row a source, in one window over all sources."""
    order = Window.orderBy(F.col("src").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    rows = sizes.withColumn("w", weight).withColumn("cap", (F.col("source_size") * CAP).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("src").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = rows.withColumn("free", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", F.col("free") / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # from the first source that its share does not fill, all shares follow one level
    rows = rows.withColumn("level", F.first(F.when(F.col("w") * F.col("level") <= F.col("cap"), F.col("level")), True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.select("src", "source_size", "n", F.least("cap", F.col("w") * F.col("level")).alias("target"))


def uniform(*seeds: Column) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*seeds), 11).cast("double") + 0.5) / F.lit(float(2**53))


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def hypergeometric(white: Column, everything: Column, draws: Column, u: Column) -> Column:
    """How many of the draws from everything are white, by inversion with u in (0, 1).

    Weights relative to the mode follow by their ratios, outwards from it: up first, then down.  More than
    twelve standard deviations (and 40) away they are left out, where all of them are under 1e-30.
    """

    def scan(x, steps, start: Column, ratio, goal: Column):
        """The sum of the weights of the steps, the first of which weighs start, and the first step at which it passes the goal."""
        first = F.struct(start.alias("w"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("at"))

        def step(state, k):
            total = state["sum"] + state["w"]
            at = F.when((state["at"] < 0) & (total > goal), k).otherwise(state["at"])
            return F.struct((state["w"] * ratio(x, k.cast("double"))).alias("w"), total.alias("sum"), at.alias("at"))

        return F.aggregate(steps, first, step)

    def up(x, k):
        return (x["w"] - k) * (x["d"] - k) / ((k + 1) * (x["a"] - x["w"] - x["d"] + k + 1))

    def down(x, k):
        return k * (x["a"] - x["w"] - x["d"] + k) / ((x["w"] - k + 1) * (x["d"] - k + 1))

    def pick(x):
        rising = F.sequence(x["mode"], F.least(x["most"], x["mode"] + x["reach"]))
        falling = F.when(x["mode"] > x["least"], F.sequence(x["mode"] - 1, F.greatest(x["least"], x["mode"] - x["reach"]), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
        one, below, never = F.lit(1.0), down(x, x["mode"].cast("double")), F.lit(float("inf"))
        over = scan(x, rising, one, up, never)["sum"]
        under = scan(x, falling, below, down, never)["sum"]
        goals = let(F.struct(over.alias("over"), under.alias("under")), lambda s: F.struct((u * (s["over"] + s["under"])).alias("g"), s["over"].alias("over")))
        found = let(goals, lambda g: F.coalesce(*[F.when(at >= 0, at) for at in (scan(x, rising, one, up, g["g"])["at"], scan(x, falling, below, down, g["g"] - g["over"])["at"])], x["mode"]))
        return found

    w, a, d = (c.cast("double") for c in (white, everything, draws))
    least, most = F.greatest(F.lit(0).cast("long"), draws - (everything - white)), F.least(draws, white)
    mode = F.least(most, F.greatest(least, F.floor((d + 1) * (w + 1) / (a + 2)).cast("long")))
    part = w / F.greatest(a, F.lit(1.0))
    reach = F.ceil(12 * F.sqrt(F.greatest(F.lit(0.0), d * part * (1 - part)))).cast("long") + 40
    values = {"w": w, "a": a, "d": d, "least": least, "most": most, "mode": mode, "reach": reach}
    return let(F.struct(*(c.alias(n) for n, c in values.items())), pick)


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, src, q): the leaves of the splitting tree over quotas (src, q), a row a source; all in one row a node."""
    root = quotas.agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("s"), F.col("q").alias("q")))).alias("qs"))
    nodes = root.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "qs")
    for _ in range(max(0, (shards - 1).bit_length())):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        everything = F.aggregate("qs", F.lit(0).cast("long"), lambda x, y: x + y["q"])
        share = F.floor(everything * (mid - F.col("lo")) / (F.col("hi") - F.col("lo")) + 0.5).cast("long")

        def draw(state, x):
            got = hypergeometric(x["q"], state["all"], state["left"], uniform(F.lit(seed), F.col("lo"), F.col("hi"), x["s"]))
            return let(got, lambda g: F.struct((state["all"] - x["q"]).alias("all"), (state["left"] - g).alias("left"), F.concat(state["out"], F.array(g)).alias("out")))

        start = F.struct(everything.alias("all"), share.alias("left"), F.array().cast("array<bigint>").alias("out"))
        nodes = nodes.withColumn("got", F.when(F.col("hi") - F.col("lo") > 1, F.aggregate("qs", start, draw)["out"]))
        half = lambda f: F.zip_with("qs", "got", lambda x, g: F.struct(x["s"].alias("s"), f(x["q"], g).alias("q")))
        first = F.struct(F.col("lo"), mid.alias("hi"), half(lambda q, g: g).alias("qs"))
        second = F.struct(mid.alias("lo"), F.col("hi"), half(lambda q, g: q - g).alias("qs"))
        both = F.when(F.col("got").isNull(), F.array(F.struct("lo", "hi", "qs"))).otherwise(F.array(first, second))
        nodes = nodes.select(F.explode(both).alias("n")).select("n.*")
    return nodes.select(F.col("lo").alias("shard"), F.explode("qs").alias("x")).select("shard", F.col("x.s").alias("src"), F.col("x.q").alias("q"))


def running(rows: DataFrame, of: str, order: str, ties: list[str], value: Column, name: str, ranges: int = 256) -> DataFrame:
    """rows with the sum of value over the rows before each, of the same ``of``, in the order of a hash column: by hash ranges, and within each."""
    rows = rows.withColumn("__r", F.shiftrightunsigned(F.col(order), 64 - ranges.bit_length() + 1).cast("int")).withColumn("__v", value.cast("long"))
    sums = rows.groupBy(of, "__r").agg(F.sum("__v").alias("__s"))
    sums = sums.select(of, "__r", (F.sum("__s").over(Window.partitionBy(of).orderBy("__r")) - F.col("__s")).alias("__before"))
    inside = F.coalesce(F.sum("__v").over(Window.partitionBy(of, "__r").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__in", inside).join(sums, [of, "__r"]).withColumn(name, F.col("__before") + F.col("__in")).drop("__r", "__v", "__before", "__in")


def prepared(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """docs with size, the source as a key that is never null, and a hash of id and text."""
    source, text = F.col(f"`{source_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")
    return docs.select(
        *without(docs, MADE),
        word_count(text).alias("size"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("__src"),
        F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), text).alias("__h"),
        F.col(f"`{id_col}`").alias("__id"),
    )


def allotted(rows: DataFrame, thin: DataFrame, shards: int = SHARDS, block_rows: int = BLOCK_ROWS, seed: int = SEED) -> DataFrame:
    """Prepared rows with source_size, target, taken, passes, part and shards; thin: their __src, size and __h, read several times."""
    plain = F.when(F.col("src") != "", F.substring("src", 2, 2**31 - 1))
    sizes = thin.groupBy(F.col("__src").alias("src")).agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = targets(sizes.withColumn("src", plain))
    words = F.floor(F.col("target") + 0.5).cast("long")
    goal = goal.withColumn("passes", F.when(F.col("source_size") > 0, F.least(F.floor(words / F.col("source_size")), F.lit(CAP))).otherwise(0).cast("int"))
    goal = goal.withColumn("rest", F.when(F.col("passes") < CAP, words - F.col("passes") * F.col("source_size")).otherwise(0)).withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int"))
    # a table of its own, with a size that is known when rows are joined with it
    goal = written(goal.withColumn("__src", F.coalesce(F.concat(F.lit("="), "src"), F.lit(""))).drop("src", "n"), "targets")

    block = F.pmod(F.xxhash64("__h"), F.col("blocks")).cast("int")
    cells = thin.join(goal.select("__src", "passes", "rest", "blocks"), "__src").groupBy("__src", block.alias("__block"), "passes", "rest").agg(F.sum("size").alias("words"))
    cells = written(cells, "cells")
    turned = running(cells.withColumn("__turned", F.xxhash64(F.lit(seed + 1), "__src", "__block")), "__src", "__turned", ["__block"], F.col("words"), "__gone")
    given = turned.withColumn("give", F.greatest(F.lit(0), F.least("words", F.col("rest") - F.col("__gone")))).select("__src", "__block", "give", (F.col("passes") + F.when(F.col("rest") - F.col("__gone") > 0, F.when(F.col("words") > 0, 1).otherwise(0)).otherwise(0)).alias("turns"))
    given = written(given.withColumn("turns", F.when((F.col("turns") > 0), F.col("turns")).otherwise(0)), "given")

    quotas = given.groupBy(F.col("__src").alias("src")).agg(F.sum("turns").alias("q")).filter("q > 0")
    leaves = split_quotas(quotas, shards, seed + 5)
    # a source's bounds: how many of its draws the shards up to each take
    bounds = leaves.withColumn("to", F.sum("q").over(Window.partitionBy("src").orderBy("shard"))).groupBy(F.col("src").alias("__src")).agg(F.array_sort(F.collect_list("to")).alias("bounds"))
    draws = given.filter("turns > 0").select("__src", "__block", F.explode(F.sequence(F.lit(1), F.col("turns"))).alias("turn")).withColumn("__mixed", F.xxhash64(F.lit(seed + 2), "__src", "__block", "turn"))
    dealt = running(draws, "__src", "__mixed", ["__block", "turn"], F.lit(1), "rank").join(bounds, "__src")
    dealt = dealt.withColumn("leaf", F.size(F.filter("bounds", lambda b: b <= F.col("rank"))))
    dealt = dealt.groupBy("__src", "__block").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "leaf"))), lambda x: x["leaf"]).alias("leaves"))
    cells = written(given.select("__src", "__block", "give").join(dealt, ["__src", "__block"], "left"), "leaves")

    placed = rows.join(goal, "__src").withColumn("__block", block).join(cells, ["__src", "__block"])
    before = F.sum("size").over(Window.partitionBy("__src", "__block").orderBy(F.xxhash64(F.lit(seed + 3), "__h"), "__h", "__id", "size").rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("give") - F.coalesce(before, F.lit(0)))))
    wanted = F.col("passes") + F.when(F.col("part") > 0, 1).otherwise(0)
    none = F.array().cast("array<int>")
    return placed.select(
        *(f"`{c}`" for c in rows.columns),
        "source_size",
        "target",
        (F.col("passes") * F.col("size") + F.col("part")).cast("long").alias("taken"),
        "passes",
        F.col("part").cast("long").alias("part"),
        F.when(F.col("size") > 0, F.slice(F.coalesce("leaves", none), F.lit(1), wanted)).otherwise(none).alias("shards"),
    )


def allot(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """docs with size, source_size, target, taken, passes (whole copies), part (words of one more) and shards (one for each draw)."""
    rows = prepared(docs, id_col, text_col, source_col, seed)
    out = allotted(rows, written(rows.select("__src", "size", "__h"), "sizes"), seed=seed, **options)
    return out.drop("__src", "__h", "__id")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """The mix itself: columns of docs, a row for each draw, with mix_shard and mix_order (its place by a local shuffle).

    A document that is taken in part keeps its first words, joined by single spaces.  Columns of docs keep
    their values, whatever their names; those called mix_shard and mix_order are replaced.
    """
    docs = docs.select(*without(docs, ["mix_shard", "mix_order"]))
    # the columns under other names while the operator's own are made
    under = {c: f"__c{k}" for k, c in enumerate(docs.columns)}
    own_id, own_text, own_source = (under[c] for c in (id_col, text_col, source_col))
    rows = prepared(docs.withColumnsRenamed(under), own_id, own_text, own_source, seed)
    rows = allotted(rows, written(rows.select("__src", "size", "__h"), "sizes"), seed=seed, **options)
    rows = rows.select("*", F.posexplode("shards").alias("__turn", "mix_shard"))
    cut = F.array_join(F.slice(F.regexp_extract_all(own_text, F.lit(WORD), F.lit(0)), F.lit(1), F.col("part").cast("int")), " ")
    rows = rows.withColumn(own_text, F.when((F.col("__turn") == F.col("passes")) & (F.col("part") < F.col("size")), cut).otherwise(F.col(own_text)))
    place = F.xxhash64(F.lit(seed + 4), "__h", "__turn")
    return rows.select(*(F.col(n).alias(c) for c, n in under.items()), "mix_shard", place.alias("mix_order"))


def op9_source_mixture(spark, sf_dir):
    rows = prepared(table(spark, sf_dir, "documents"), "doc_id", "text", "source", SEED).select("doc_id", "size", "__src", "__h", "__id")
    rows = written(rows, "sizes")  # words are counted once
    return allotted(rows, rows.select("__src", "size", "__h")).select("doc_id", "size", "source_size", "target", "taken", "shards")
