"""Supplier and customer graph analytics over edges (corp_code, partner_id, partner_name, relation, period)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.dictionary import containing
from tessera.operators.lineage import cut
from tessera.operators.relational import top_per_key


def hhi_level(hhi: Column, high: int = 2500, middle: int = 1500) -> Column:
    return F.when(hhi >= high, "HIGH").when(hhi >= middle, "MED").otherwise("LOW")


def concentration(edges: DataFrame) -> DataFrame:
    """Herfindahl index of partner weights per company and relation."""
    weights = edges.groupBy("corp_code", "relation", "partner_name").agg(F.count("*").alias("w"))
    # Sum of squares over the square of the sum: one more aggregate, no window.
    per = weights.groupBy("corp_code", "relation").agg(
        (F.sum(F.col("w") * F.col("w")) * 10000.0 / (F.sum("w") * F.sum("w"))).alias("hhi"), F.count("*").alias("partners"), F.min_by("partner_name", F.struct(-F.col("w"), "partner_name")).alias("top_partner")
    )
    return per.withColumn("level", hhi_level(F.col("hhi")))


def equal_weight_hhi(n: Column) -> Column:
    """The index if all n partners weighed the same; no partner at all counts as full concentration."""
    return F.when(n > 0, (n * F.pow(F.lit(100.0) / n, 2)).cast("int")).otherwise(10000)


def exposure(edges: DataFrame) -> DataFrame:
    """How many companies name another one as their supplier."""
    named = edges.filter("relation = 'supplier'").select("corp_code", "partner_id").distinct()
    return named.groupBy(F.col("partner_id").alias("corp_code")).agg(F.count("*").alias("exposure"))


def risk_rank(edges: DataFrame, min_partners: int = 3) -> DataFrame:
    """Concentration risk per company: customers (40), suppliers (30), exposure (20), diversity (10)."""
    c = concentration(edges.filter(F.col("relation").isin("customer", "supplier")))
    side = lambda r, x: F.max(F.when(F.col("relation") == r, F.col(x)))
    zero = lambda x: F.coalesce(x, F.lit(0))
    both = c.groupBy("corp_code").agg(
        F.coalesce(side("customer", "hhi"), F.lit(0.0)).alias("cust_hhi"), F.coalesce(side("supplier", "hhi"), F.lit(0.0)).alias("supp_hhi"),
        zero(side("customer", "partners")).alias("cust_count"), zero(side("supplier", "partners")).alias("supp_count"),
        side("customer", "top_partner").alias("top_customer"), side("supplier", "top_partner").alias("top_supplier"),
    )
    rows = both.filter(F.col("cust_count") + F.col("supp_count") >= min_partners).join(exposure(edges), "corp_code", "left").withColumn("exposure", zero(F.col("exposure")))
    score = (
        F.least(F.lit(40.0), F.col("cust_hhi") / 10000 * 40)
        + F.least(F.lit(30.0), F.col("supp_hhi") / 10000 * 30)
        + F.least(F.lit(20.0), 1 / (1 + F.col("exposure") * 0.1) * 20)
        + F.least(F.lit(10.0), 1 / (1 + (F.col("cust_count") + F.col("supp_count")) * 0.05) * 10)
    )
    risk = F.round(score, 1)
    return rows.withColumns({"risk_score": risk, "risk_level": F.when(risk >= 60, "HIGH").when(risk >= 35, "MED").otherwise("LOW"), "systemic": F.least(F.lit(100), F.col("exposure") * 8)})


def period_diff(edges: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Per company and partner, what changed between its two periods.

    before and after: (corp_code, period), a row a company. A partner with several relations in a
    period counts with the greatest.
    """
    pick = lambda at, name: edges.join(at, ["corp_code", "period"]).groupBy("corp_code", "partner_name").agg(F.max("relation").alias(name))
    both = pick(before, "was").join(pick(after, "now"), ["corp_code", "partner_name"], "full")
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "lost").when(F.col("was") != F.col("now"), "changed").otherwise("kept")
    return both.withColumn("change", change)


def last_two(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(before, after): each company's last period but one and its last, for companies with two."""
    periods = top_per_key(edges.select("corp_code", "period").distinct(), ["corp_code"], 2, F.desc("period"), rank="k")
    two = periods.groupBy("corp_code").agg(F.max(F.when(F.col("k") == 2, F.col("period"))).alias("before"), F.max(F.when(F.col("k") == 1, F.col("period"))).alias("after")).filter("before IS NOT NULL")
    return two.select("corp_code", F.col("before").alias("period")), two.select("corp_code", F.col("after").alias("period"))


def significance(new: Column, lost: Column, changed: Column, supplier_involved: Column) -> Column:
    return F.least(F.lit(100), 2 * new + 3 * lost + 2 * changed + F.when(supplier_involved, 15).otherwise(0))


def change_alerts(edges: DataFrame) -> DataFrame:
    """Companies whose partners changed over their last two periods, with how much that matters."""
    diff = period_diff(edges, *last_two(edges))
    count = lambda c: F.count_if(F.col("change") == c).alias(c)
    supplier = F.bool_or(((F.col("change") == "new") & (F.col("now") == "supplier")) | ((F.col("change") == "lost") & (F.col("was") == "supplier")))
    per = diff.groupBy("corp_code").agg(count("new"), count("lost"), count("changed"), count("kept"), F.coalesce(supplier, F.lit(False)).alias("supplier_involved"))
    per = per.filter("new + lost + changed > 0")
    return per.withColumn("significance", significance(F.col("new"), F.col("lost"), F.col("changed"), F.col("supplier_involved")))


def links(edges: DataFrame) -> DataFrame:
    """Directed links between companies, both ways: (a, b)."""
    pairs = edges.select(F.col("corp_code").alias("a"), F.col("partner_id").alias("b")).filter("a <> b")
    return pairs.union(pairs.select(F.col("b"), F.col("a"))).distinct()


def neighbourhood(edges: DataFrame, start: DataFrame, per_node: int = 20) -> DataFrame:
    """Nodes within two hops of start (corp_code): weights of the hop; the second hop keeps per_node partners a node."""
    weights = edges.groupBy("corp_code", F.col("partner_id").alias("node")).agg(F.count("*").alias("w"))
    first = weights.join(start, "corp_code").select(F.col("corp_code").alias("origin"), "node", "w", F.lit(1).alias("hop"))
    second = first.select("origin", F.col("node").alias("corp_code")).join(weights, "corp_code")
    second = top_per_key(second, ["origin", "corp_code"], per_node, F.desc("w"), F.col("node"))
    second = second.groupBy("origin", "node").agg(F.max("w").alias("w")).withColumn("hop", F.lit(2))
    second = second.join(first.select("origin", "node"), ["origin", "node"], "left_anti").filter("node <> origin")
    return first.unionByName(second)


def impact(edges: DataFrame, company: int, classes: dict[tuple[str, str], str]) -> DataFrame:
    """(impact, other): companies that trouble at one reaches, by class of (side, relation); relations without a class reach none.

    Side own: edges that the company names; side other: edges of those that name it.
    """
    side = lambda key, other, name: edges.filter(F.col(key) == company).select(F.lit(name).alias("side"), "relation", F.col(other).alias("other"))
    rows = side("corp_code", "partner_id", "own").unionByName(side("partner_id", "corp_code", "other"))
    named = F.coalesce(*[F.when((F.col("side") == s) & (F.col("relation") == r), c) for (s, r), c in classes.items()])
    return rows.select(named.alias("impact"), "other").filter("impact IS NOT NULL")


def hops_from(edges: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """(node, hops, path): breadth-first search from start (node), at most max_depth hops.

    A frontier join a hop, each hop a checkpoint; of paths of one length the smallest stands.
    """
    steps = cut(links(edges))
    seen = start.select("node", F.lit(0).alias("hops"), F.array("node").alias("path"))
    frontier = seen
    for depth in range(1, max_depth + 1):
        reached = frontier.join(steps, F.col("node") == F.col("a")).select(F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"))
        fresh = reached.join(seen.select("node"), "node", "left_anti").groupBy("node").agg(F.min("path").alias("path"))
        frontier = cut(fresh.select("node", F.lit(depth).alias("hops"), "path"))
        seen = seen.unionByName(frontier)
    return seen


def two_waves(edges: DataFrame, start: int, per_node: int = 10) -> DataFrame:
    """Who a shock at start reaches: wave 1 direct partners and reporters, wave 2 through per_node partners of each."""
    steps = links(edges)
    one = steps.filter(F.col("a") == start).select(F.col("b").alias("node"), F.lit(1).alias("wave"))
    next_ = steps.join(one.select(F.col("node").alias("a")), "a").filter(F.col("b") != start)
    next_ = top_per_key(next_, ["a"], per_node, F.col("b"))
    two = next_.select(F.col("b").alias("node")).distinct().join(one, "node", "left_anti").withColumn("wave", F.lit(2))
    return one.unionByName(two)


def sector_flows(edges: DataFrame, companies: DataFrame, least: int = 3) -> DataFrame:
    """Goods flow between sectors: a supplier's edge runs from the partner's sector, others from the company's."""
    own = companies.select("corp_code", F.col("sector").alias("own"))
    other = companies.select(F.col("corp_code").alias("partner_id"), F.col("sector").alias("other"), F.col("corp_name").alias("other_name"))
    rows = edges.join(own, "corp_code").join(other, "partner_id")
    inward = F.col("relation") == "supplier"
    rows = rows.select(F.when(inward, F.col("other")).otherwise(F.col("own")).alias("source"), F.when(inward, F.col("own")).otherwise(F.col("other")).alias("target"), "other_name")
    per = rows.groupBy("source", "target").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("other_name")), 1, 3).alias("samples"))
    return per.filter(F.col("n") >= least)


def group_links(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges (corp_name, partner_name, ...) inside a group: both names contain one of its keywords. groups: (grp, keyword), any number.

    Adds grp; an edge stands once for each of its groups. Keywords are looked up once for each different name.
    """

    def members(column: str) -> DataFrame:
        hits = containing(edges, column, groups, "keyword")
        return hits.join(groups, F.col("name") == F.col("keyword")).select(F.col("text").alias(column), "grp").distinct()

    return edges.join(members("corp_name"), "corp_name").join(members("partner_name"), ["partner_name", "grp"])


def shares_of(weights: DataFrame, keys: list[str]) -> DataFrame:
    return weights.withColumn("share", F.col("w") * 100.0 / F.sum("w").over(Window.partitionBy(*keys)))
