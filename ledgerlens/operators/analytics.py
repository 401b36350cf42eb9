"""PageRank, communities and closures over the company graph.

Iterations cut their lineage with checkpoint(), in the folder that spark.checkpoint.dir names.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.operators import links
from ledgerlens.operators.graph import EDGE_KEY, Graph, degrees, filers

PROJECTED = ("COMPETES_WITH", "SUPPLIES", "CUSTOMER_OF", "SUBSIDIARY_OF")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; one of this machine's only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="ledgerlens-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    folder = shared_folder(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def projection(g: Graph) -> DataFrame:
    """(a, b) for both directions of each company edge; parallel edges stay."""
    rows = g.edges.filter(F.col("type").isin(*PROJECTED) & (F.col("src_label") == "Company") & (F.col("dst_label") == "Company"))
    rows = rows.select(F.col("src_key").alias("a"), F.col("dst_key").alias("b"))
    return rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b")))


def pagerank(g: Graph, rounds: int = 20, damping: float = 0.85, every: int = 5) -> DataFrame:
    """ticker, name, is_focal, score (six places), degree of all companies."""
    edges = checkpointed(projection(g))
    out = edges.groupBy("a").agg(F.count("*").alias("w"))
    links = checkpointed(edges.join(out, "a").select("a", "b", (F.lit(1.0) / F.col("w")).alias("share")))
    companies = g.nodes.filter("label = 'Company'").select("key", "name")
    ranks = checkpointed(companies.select("key", F.lit(1 - damping).alias("r")))
    base = ranks.select("key")
    for k in range(rounds):
        gained = links.join(ranks, links.a == ranks.key).groupBy("b").agg(F.sum(F.col("r") * F.col("share")).alias("s"))
        ranks = base.join(gained, base.key == gained.b, "left").select("key", (F.lit(1 - damping) + damping * F.coalesce("s", F.lit(0.0))).alias("r"))
        if k % every == every - 1:
            ranks = checkpointed(ranks)
    focal = filers(g).withColumn("f", F.lit(True))
    rows = companies.join(ranks, "key").join(focal, "key", "left").join(degrees(g, "Company").select("key", "degree"), "key")
    rows = rows.select(F.col("key").alias("ticker"), "name", F.coalesce("f", F.lit(False)).alias("is_focal"), F.round("r", 6).alias("score"), "degree")
    return rows.filter("score > 0 or is_focal")


def linked(g: Graph) -> links.Links | None:
    """The graph between companies in numbers, or None where there are too many of them."""
    rows = g.edges.filter(F.col("type").isin(*PROJECTED) & (F.col("src_label") == "Company") & (F.col("dst_label") == "Company"))
    return links.links(g.nodes.filter("label = 'Company'"), rows, PROJECTED, checkpointed)


def company_components(g: Graph, rounds: int = 100) -> DataFrame:
    """(key, component): the least key that a company reaches, by hooking to the least neighbour and jumping."""
    edges = checkpointed(projection(g).distinct())
    now = checkpointed(g.nodes.filter("label = 'Company'").select("key", F.col("key").alias("component")))
    for _ in range(rounds):
        seen = edges.join(now, edges.b == now.key).groupBy("a").agg(F.min("component").alias("m"))
        hooked = now.join(seen, now.key == seen.a, "left").select("key", F.least("component", F.coalesce("m", "component")).alias("component"))
        roots = hooked.select(F.col("key").alias("k"), F.col("component").alias("root"))
        jumped = hooked.join(roots, hooked.component == roots.k, "left").select("key", F.least("component", F.coalesce("root", "component")).alias("component"))
        fresh = checkpointed(jumped)
        changed = fresh.join(now.withColumnRenamed("component", "old"), "key").filter("component <> old").limit(1).count()
        now = fresh
        if not changed:
            return now
    raise RuntimeError("components did not settle")


def _louvain(edges: dict[tuple[str, str], float], total: float) -> dict[str, str]:
    """Greedy modularity in rounds of local moves and merges, in key order; total is twice the weight of the whole graph."""
    label = {k: k for pair in edges for k in pair}
    weights = dict(edges)
    while True:
        near: dict[str, dict[str, float]] = {}
        for (a, b), w in weights.items():
            near.setdefault(a, {}).setdefault(b, 0.0)
            near[a][b] += w
        degree = {a: sum(x.values()) for a, x in near.items()}
        group = {a: a for a in near}
        mass = dict(degree)
        moved_any, moving = False, True
        while moving:
            moving = False
            for a in sorted(near):
                own = group[a]
                mass[own] -= degree[a]
                to: dict[str, float] = {own: 0.0}
                for b, w in near[a].items():
                    if b != a:
                        to[group[b]] = to.get(group[b], 0.0) + w
                best = max(sorted(to), key=lambda c: (round(to[c] - degree[a] * mass[c] / total, 12), c == own))
                mass[best] += degree[a]
                if best != own:
                    group[a], moving, moved_any = best, True, True
        if not moved_any:
            break
        label = {k: group[c] for k, c in label.items()}
        merged: dict[tuple[str, str], float] = {}
        for (a, b), w in weights.items():
            pair = (group[a], group[b])
            merged[pair] = merged.get(pair, 0.0) + w
        weights = merged
    least: dict[str, str] = {}
    for k, c in label.items():
        least[c] = min(k, least.get(c, k))
    return {k: least[c] for k, c in label.items()}


def moves(edges: DataFrame, total: float, rounds: int) -> DataFrame:
    """(node, c): communities after rounds of local moves of the nodes of (a, b, w), by joins.

    In each round a hashed half of the nodes may move, each to the neighbouring community that gains
    most, so that neighbours do not trade places for ever.
    """
    degree = checkpointed(edges.groupBy("a").agg(F.sum("w").alias("d")))
    now = checkpointed(degree.select(F.col("a").alias("node"), F.col("a").alias("c")))
    for k in range(rounds):
        mass = now.join(degree, now.node == degree.a).groupBy("c").agg(F.sum("d").alias("m"))
        there = now.select(F.col("node").alias("b"), "c")
        to = edges.filter("a <> b").join(there, "b").groupBy("a", "c").agg(F.sum("w").alias("w"))
        # to stay is a choice of weight 0 at least
        own = now.select(F.col("node").alias("a"), F.col("c").alias("own"))
        to = to.unionByName(own.select("a", F.col("own").alias("c"), F.lit(0.0).alias("w"))).groupBy("a", "c").agg(F.sum("w").alias("w"))
        gain = F.round(F.col("w") - F.col("d") * (F.col("m") - F.when(F.col("c") == F.col("own"), F.col("d")).otherwise(0.0)) / total, 12)
        rated = to.join(own, "a").join(degree, "a").join(mass, "c").select("a", "own", "c", gain.alias("gain"), (F.col("c") == F.col("own")).alias("stays"))
        best = rated.groupBy("a", "own").agg(F.max_by("c", F.struct("gain", "stays", F.xxhash64("c"))).alias("best"))
        turn = F.pmod(F.xxhash64("a", F.lit(k // 2)), F.lit(2)) == k % 2
        fresh = checkpointed(best.select(F.col("a").alias("node"), F.when(turn, F.col("best")).otherwise(F.col("own")).alias("c")))
        changed = fresh.join(now.withColumnRenamed("c", "old"), "node").filter("c <> old").limit(1).count()
        now = fresh
        if not changed and k % 2:
            break
    return now


def contracted(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges between communities."""
    a, b = groups.select(F.col("node").alias("a"), F.col("c").alias("ca")), groups.select(F.col("node").alias("b"), F.col("c").alias("cb"))
    return edges.join(a, "a").join(b, "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w"))


def louvain(g: Graph, most_edges: int = 200_000, rounds: int = 8, levels: int = 12, net: links.Links | None = None) -> DataFrame:
    """ticker, name, communityId (least member), community_size, is_focal.

    Modularity never gains from joining components, so each is solved by itself with the whole graph's
    weight: in one task where it has at most most_edges edges.  A larger one is contracted by distributed
    rounds of local moves until it is small enough, or until it shrinks no more.  net is linked(g), where
    it is at hand.
    """
    net = net or linked(g)
    found = links.labelled(net, communities(net, most_edges, rounds, levels), "communityId") if net else communities_joined(unrepeated(g), most_edges, rounds, levels)
    companies = g.nodes.filter("label = 'Company'").select("key", "name")
    rows = companies.join(found, "key", "left").withColumn("communityId", F.coalesce("communityId", "key"))
    counts = rows.groupBy("communityId").agg(F.count("*").alias("community_size"))
    focal = filers(g).withColumn("f", F.lit(True))
    return rows.join(counts, "communityId").join(focal, "key", "left").select(F.col("key").alias("ticker"), "name", "communityId", "community_size", F.coalesce("f", F.lit(False)).alias("is_focal"))


def unrepeated(g: Graph) -> Graph:
    """A graph whose edges bear no values, each once."""
    return Graph(g.nodes, g.edges.select(*EDGE_KEY).distinct())


def communities(net: links.Links, most_edges: int, rounds: int, levels: int) -> np.ndarray:
    """The community of each company of a graph in numbers: its least member."""
    homes, degree = links.components(net), links.sums(net.blocks, net.n)
    total = float(degree.sum()) or 1.0
    large = (np.bincount(homes, links.sums(net.blocks, net.n, count=True), net.n) > most_edges)[homes]
    up, placed = np.arange(net.n), links.contracted(net.blocks, np.arange(net.n), ~large)
    if large.any():
        blocks, before = net.blocks, None
        for _ in range(levels):
            groups = links.moves(blocks, np.bincount(up, degree, net.n), total, rounds, large)
            up = groups[up]
            rest = checkpointed(links.contracted(blocks, groups, large))
            count = rest.count()
            if count <= most_edges or before is not None and count >= before:
                break
            blocks, before = checkpointed(links.blocked(rest)), count
        placed = placed.unionByName(rest)
    there = links.sent(net.blocks, homes)

    @F.pandas_udf("long")
    def home(a: pd.Series) -> pd.Series:
        return pd.Series(there.value[0][a.to_numpy()])

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        found = _louvain({(a, b): w for a, b, w in zip(frame.a, frame.b, frame.w)}, total)
        return pd.DataFrame({"key": list(found), "c": list(found.values())})

    ends = np.arange(net.n)
    for r in placed.groupBy(home("a").alias("component")).applyInPandas(solve, "key int, c int").toLocalIterator():
        ends[r.key] = r.c
    there.destroy()
    found = ends[up]
    least = np.full(net.n, net.n)
    np.minimum.at(least, found, np.arange(net.n))
    return least[found]


def communities_joined(g: Graph, most_edges: int, rounds: int, levels: int) -> DataFrame:
    """(key, communityId) of companies with edges, by joins only."""
    parts = company_components(g)
    edges = checkpointed(projection(g).groupBy("a", "b").agg(F.count("*").cast("double").alias("w")))
    total = float(edges.agg(F.sum("w").alias("t")).first().t or 1.0)
    placed = checkpointed(edges.join(parts.select(F.col("key").alias("a"), "component"), "a"))
    sizes = checkpointed(placed.groupBy("component").agg(F.count("*").alias("n")))
    large = sizes.filter(F.col("n") > most_edges).select("component")
    above = None  # (key, c): what nodes of large components are contracted to
    if not large.isEmpty():
        rest, few = placed.join(large, "component").select("a", "b", "w"), placed.join(large, "component", "left_anti")
        above = checkpointed(rest.select(F.col("a").alias("key"), F.col("a").alias("c")).distinct())
        for _ in range(levels):
            before = rest.count()
            groups = moves(rest, total, rounds)
            above = checkpointed(above.join(groups.select(F.col("node").alias("c"), F.col("c").alias("up")), "c").select("key", F.col("up").alias("c")))
            rest = checkpointed(contracted(rest, groups))
            count = rest.count()
            if count <= most_edges or count >= before:
                break
        homes = parts.withColumnsRenamed({"key": "a"})
        placed = few.select("a", "b", "w", "component").unionByName(rest.join(homes, "a").select("a", "b", "w", "component"))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        found = _louvain({(a, b): w for a, b, w in zip(frame.a, frame.b, frame.w)}, total)
        return pd.DataFrame({"key": list(found), "communityId": list(found.values())})

    found = placed.groupBy("component").applyInPandas(solve, "key string, communityId string")
    if above is not None:
        found = checkpointed(found)
        through = above.join(found.withColumnRenamed("key", "c"), "c").select("key", "communityId")
        found = through.unionByName(found.join(above.select("key"), "key", "left_anti"))
        least = found.groupBy("communityId").agg(F.min("key").alias("least"))
        found = found.join(least, "communityId").select("key", F.col("least").alias("communityId"))
    return found


def louvain_validity(g: Graph) -> DataFrame:
    """One row: companies, communities not called after their least member, communities of several components, and whether modularity is above that of single companies."""
    net = linked(g)
    found = checkpointed(louvain(g, net=net).select(F.col("ticker").alias("key"), "communityId"))
    named = found.groupBy("communityId").agg(F.min("key").alias("least")).filter("least <> communityId")
    homes = links.labelled(net, links.components(net), "component") if net else company_components(unrepeated(g))
    parts = found.join(homes, "key").groupBy("communityId").agg(F.count_distinct("component").alias("c")).filter("c > 1")
    measures = {"companies": found.agg(F.count("*").alias("v")), "misnamed": named.agg(F.count("*").alias("v")), "across_components": parts.agg(F.count("*").alias("v"))}
    measures |= {k: found.sparkSession.range(1).select(F.lit(v).alias("v")) for k, v in shares(net, found).items()} if net else shares_joined(unrepeated(g), found)
    rows = None
    for name, measure in measures.items():
        one = measure.select(F.lit(name).alias("name"), F.col("v").cast("double").alias("v"))
        rows = one if rows is None else rows.unionByName(one)
    value = lambda name: F.max(F.when(F.col("name") == name, F.col("v")))
    gains = value("inside") - value("by_chance") > value("inside_alone") - value("by_chance_alone")
    return rows.agg(*(value(n).cast("long").alias(n) for n in ("companies", "misnamed", "across_components")), gains.alias("gains"))


def shares(net: links.Links, found: DataFrame) -> dict[str, float]:
    """The terms of the modularity of found (key, communityId), and of single companies."""
    numbers, label = net.numbers, np.arange(net.n)
    rows = found.join(numbers, "key").join(numbers.select(F.col("key").alias("communityId"), F.col("id").alias("c")), "communityId").select("id", "c")
    for r in rows.toLocalIterator():
        label[r.id] = r.c
    there, degree = links.sent(net.blocks, label), links.sums(net.blocks, net.n)
    within = lambda label: sum(links.passed(net.blocks, lambda a, b, w: (a[:1], np.array([w[label(a) == label(b)].sum()])[: len(a)]))[1])
    total = degree.sum() or 1.0
    inside, alone = within(lambda a: there.value[0][a]), within(lambda a: a)
    by_chance = lambda mass: float(((mass / total) ** 2).sum())
    return {"inside": float(inside / total), "by_chance": by_chance(np.bincount(label, degree, net.n)), "inside_alone": float(alone / total), "by_chance_alone": by_chance(degree)}


def shares_joined(g: Graph, found: DataFrame) -> dict[str, DataFrame]:
    """shares() as tables, by joins only."""
    edges = projection(g).groupBy("a", "b").agg(F.count("*").cast("double").alias("w"))
    label = lambda k: found.select(F.col("key").alias(k), F.col("communityId").alias("c" + k))
    placed = edges.join(label("a"), "a").join(label("b"), "b")
    total = F.sum("w").over(Window.partitionBy())
    within = lambda x, y: F.sum(F.when(F.col(x) == F.col(y), F.col("w")).otherwise(0.0)) / F.sum("w")
    expected = lambda by: placed.groupBy(by).agg(F.sum("w").alias("w")).withColumn("t", total).agg(F.sum((F.col("w") / F.col("t")) ** 2).alias("v"))
    return {"inside": placed.agg(within("ca", "cb").alias("v")), "by_chance": expected("ca"), "inside_alone": edges.agg(within("a", "b").alias("v")), "by_chance_alone": expected("a")}


def subsidiary_closure(g: Graph, depth: int = 20) -> DataFrame:
    """(child, ancestor) over SUBSIDIARY_OF, by doubling path lengths until nothing is new."""
    pairs = checkpointed(g.edges.filter("type = 'SUBSIDIARY_OF'").select(F.col("src_key").alias("child"), F.col("dst_key").alias("ancestor")).distinct())
    n = pairs.count()
    for _ in range(depth):
        longer = pairs.join(pairs.select(F.col("child").alias("m"), F.col("ancestor").alias("z")), F.col("ancestor") == F.col("m")).select("child", F.col("z").alias("ancestor"))
        pairs = checkpointed(pairs.unionByName(longer).distinct())
        now = pairs.count()
        if now == n:
            break
        n = now
    return pairs


def community_report(rows: DataFrame, top: int = 10, sample: int = 15) -> str:
    """Markdown of the communities with the most filers; of each the first tickers only are gathered."""
    sizes = rows.groupBy("communityId").agg(F.count("*").alias("size"), F.count_if("is_focal").alias("focal"))
    total, many = sizes.count(), sizes.filter("size > 1").count()
    best = sizes.orderBy(F.col("focal").desc(), F.col("size").desc(), "communityId").limit(top)
    place = F.row_number().over(Window.partitionBy("communityId").orderBy("ticker"))
    members = rows.join(best.select("communityId"), "communityId").withColumn("n", place).filter(F.col("n") <= sample)
    tickers = {r.communityId: sorted(r.t) for r in members.groupBy("communityId").agg(F.collect_list("ticker").alias("t")).collect()}
    lines = ["# Communities", "", f"- Communities: {total}", f"- With more than one company: {many}", "", "| community | size | filers | companies |", "|---|---|---|---|"]
    for r in best.orderBy(F.col("focal").desc(), F.col("size").desc(), "communityId").collect():
        lines.append(f"| {r.communityId} | {r['size']} | {r.focal} | {', '.join(tickers[r.communityId])} |")
    return "\n".join(lines) + "\n"
