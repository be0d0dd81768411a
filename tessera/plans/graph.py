"""Supplier and customer graph: concentration, changes, neighbourhoods, scenarios, and signals from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.operators.dictionary import containing, longest_prefix
from tessera.operators.postings import first_keywords, past_mentions, write_postings
from tessera.operators.relational import top_per_key
from tessera.plans import leads
from tessera.plans.joins import GROUP_SQL, PAIRS_SQL, closest_pairs, internal_links
from tessera.plans.registry import query
from tessera.sources.adapters import AS_OF


def n(name: str = "n"):
    return F.count("*").alias(name)


HHI = """hhi AS (SELECT corp_code, relation, sum(w * w)::BIGINT * 10000.0::DOUBLE / (sum(w) * sum(w))::BIGINT AS hhi, count(*) AS partners, arg_min(partner_name, (-w, partner_name)) AS top_partner
  FROM (SELECT corp_code, relation, partner_name, count(*) AS w FROM edges GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
LEVEL = "CASE WHEN hhi >= 2500 THEN 'HIGH' WHEN hhi >= 1500 THEN 'MED' ELSE 'LOW' END"
RISK = f"""{HHI}, sides AS (SELECT corp_code, coalesce(max(hhi) FILTER (WHERE relation = 'customer'), 0) AS cust_hhi, coalesce(max(hhi) FILTER (WHERE relation = 'supplier'), 0) AS supp_hhi,
  coalesce(max(partners) FILTER (WHERE relation = 'customer'), 0) AS cust_count, coalesce(max(partners) FILTER (WHERE relation = 'supplier'), 0) AS supp_count,
  max(top_partner) FILTER (WHERE relation = 'customer') AS top_customer, max(top_partner) FILTER (WHERE relation = 'supplier') AS top_supplier FROM hhi WHERE relation <> 'partner' GROUP BY 1),
exposure AS (SELECT partner_id AS corp_code, count(DISTINCT corp_code) AS exposure FROM edges WHERE relation = 'supplier' GROUP BY 1),
scored AS (SELECT s.*, coalesce(exposure, 0) AS exposure, round(least(40.0, cust_hhi / 10000 * 40) + least(30.0, supp_hhi / 10000 * 30) + least(20.0, 1 / (1 + coalesce(exposure, 0) * 0.1::DOUBLE) * 20)
  + least(10.0, 1 / (1 + (cust_count + supp_count) * 0.05::DOUBLE) * 10), 1) AS risk_score FROM sides s LEFT JOIN exposure USING (corp_code) WHERE cust_count + supp_count >= 3),
risk AS (SELECT *, CASE WHEN risk_score >= 60 THEN 'HIGH' WHEN risk_score >= 35 THEN 'MED' ELSE 'LOW' END AS risk_level, least(100, exposure * 8) AS systemic FROM scored)"""


@query("agg_hhi", f"WITH {HHI} SELECT *, {LEVEL} AS level FROM hhi")
def _(t):
    return graph.concentration(t.edges)


@query("agg_hhi_equal", "SELECT corp_code, relation, n, trunc(n * pow(100.0::DOUBLE / n, 2))::INT AS hhi, CASE WHEN trunc(n * pow(100.0::DOUBLE / n, 2)) >= 5000 THEN 'HIGH' WHEN trunc(n * pow(100.0::DOUBLE / n, 2)) >= 2500 THEN 'MED' ELSE 'LOW' END AS level FROM (SELECT corp_code, relation, count(DISTINCT partner_name) AS n FROM edges GROUP BY 1, 2)")
def _(t):
    per = t.edges.groupBy("corp_code", "relation").agg(F.count_distinct("partner_name").alias("n"))
    return per.withColumn("hhi", graph.equal_weight_hhi(F.col("n"))).withColumn("level", graph.hhi_level(F.col("hhi"), 5000, 2500))


@query("agg_risk_rank", f"WITH {RISK} SELECT * FROM risk ORDER BY risk_score DESC, exposure DESC, corp_code LIMIT 50")
def _(t):
    return graph.risk_rank(t.edges).orderBy(F.desc("risk_score"), F.desc("exposure"), "corp_code").limit(50)


@query("agg_risk_all", f"WITH {RISK} SELECT corp_code, risk_score, risk_level, systemic FROM risk")
def _(t):
    return graph.risk_rank(t.edges).select("corp_code", "risk_score", "risk_level", "systemic")


@query("agg_flow_matrix", """SELECT source, target, n, array_to_string(samples, '|') AS samples FROM (SELECT CASE WHEN relation = 'supplier' THEN p.sector ELSE c.sector END AS source, CASE WHEN relation = 'supplier' THEN c.sector ELSE p.sector END AS target, count(*) AS n,
    (list_sort(list(DISTINCT p.corp_name)))[1:3] AS samples FROM edges e JOIN companies c ON c.corp_code = e.corp_code JOIN companies p ON p.corp_code = e.partner_id GROUP BY 1, 2 HAVING count(*) >= 3)""")
def _(t):
    return graph.sector_flows(t.edges, t.companies).withColumn("samples", F.array_join("samples", "|"))


DIFF = """last_two AS (SELECT corp_code, max(period) FILTER (WHERE k = 2) AS p1, max(period) FILTER (WHERE k = 1) AS p2 FROM (SELECT DISTINCT corp_code, period, dense_rank() OVER (PARTITION BY corp_code ORDER BY period DESC) AS k FROM edges) GROUP BY 1 HAVING p1 IS NOT NULL),
was AS (SELECT e.corp_code, partner_name, max(relation) AS was FROM edges e JOIN last_two t ON t.corp_code = e.corp_code AND e.period = t.p1 GROUP BY 1, 2),
cur AS (SELECT e.corp_code, partner_name, max(relation) AS now FROM edges e JOIN last_two t ON t.corp_code = e.corp_code AND e.period = t.p2 GROUP BY 1, 2),
diff AS (SELECT corp_code, partner_name, was, now, CASE WHEN was IS NULL THEN 'new' WHEN now IS NULL THEN 'lost' WHEN was <> now THEN 'changed' ELSE 'kept' END AS change FROM was FULL JOIN cur USING (corp_code, partner_name)),
alerts AS (SELECT corp_code, count(*) FILTER (WHERE change = 'new') AS new, count(*) FILTER (WHERE change = 'lost') AS lost, count(*) FILTER (WHERE change = 'changed') AS changed, count(*) FILTER (WHERE change = 'kept') AS kept,
  coalesce(bool_or((change = 'new' AND now = 'supplier') OR (change = 'lost' AND was = 'supplier')), false) AS supplier_involved FROM diff GROUP BY 1 HAVING new + lost + changed > 0)"""
SIGNIFICANCE = "least(100, 2 * new + 3 * lost + 2 * changed + CASE WHEN supplier_involved THEN 15 ELSE 0 END)"


@query("set_period_diff", f"WITH {DIFF} SELECT * FROM diff")
def _(t):
    return graph.period_diff(t.edges, *graph.last_two(t.edges))


@query("set_change_alerts", f"WITH {DIFF} SELECT *, {SIGNIFICANCE} AS significance FROM alerts")
def _(t):
    return graph.change_alerts(t.edges)


@query("d_supply_change", f"WITH {DIFF} SELECT corp_code, CASE WHEN lost > 0 AND supplier_involved THEN 'supplier lost' WHEN new > lost THEN 'network grows' WHEN lost > new THEN 'network shrinks' ELSE 'partners change' END AS headline, {SIGNIFICANCE} >= 20 AS ready FROM alerts")
def _(t):
    a = graph.change_alerts(t.edges)
    headline = F.when((F.col("lost") > 0) & F.col("supplier_involved"), "supplier lost").when(F.col("new") > F.col("lost"), "network grows").when(F.col("lost") > F.col("new"), "network shrinks").otherwise("partners change")
    return a.select("corp_code", headline.alias("headline"), (F.col("significance") >= 20).alias("ready"))


@query("g_company_graph", """WITH w AS (SELECT corp_code, partner_id AS node, count(*) AS w FROM edges GROUP BY 1, 2), one AS (SELECT corp_code AS origin, node, w, 1 AS hop FROM w WHERE corp_code IN (5, 7, 11)),
two AS (SELECT origin, node, max(w) AS w, 2 AS hop FROM (SELECT o.origin, w.node, w.w, row_number() OVER (PARTITION BY o.origin, w.corp_code ORDER BY w.w DESC, w.node) AS rank FROM one o JOIN w ON w.corp_code = o.node) WHERE rank <= 20 GROUP BY 1, 2)
SELECT * FROM one UNION ALL SELECT * FROM two WHERE node <> origin AND NOT EXISTS (SELECT 1 FROM one o WHERE o.origin = two.origin AND o.node = two.node)""")
def _(t):
    return graph.neighbourhood(t.edges, t.companies.filter("corp_code IN (5, 7, 11)").select("corp_code"))


@query("g_hub_detail", "SELECT relation, corp_name, count(*) AS n, min(context) AS context FROM edges JOIN companies USING (corp_code) WHERE partner_id = 3 GROUP BY 1, 2")
def _(t):
    return t.edges.filter("partner_id = 3").join(t.companies, "corp_code").groupBy("relation", "corp_name").agg(n(), F.min("context").alias("context"))


#: What a company's trouble does to others, by the side of the edge and its relation.
IMPACTS = {("own", "customer"): "customer impact", ("own", "supplier"): "supplier impact", ("other", "supplier"): "dependent", ("other", "customer"): "revenue exposed"}


@query("g_impact", """SELECT impact, count(*) AS links, count(DISTINCT other) AS companies FROM (SELECT relation || ' impact' AS impact, partner_id AS other FROM edges WHERE corp_code = 5 AND relation <> 'partner'
    UNION ALL SELECT CASE relation WHEN 'supplier' THEN 'dependent' ELSE 'revenue exposed' END, corp_code FROM edges WHERE partner_id = 5 AND relation <> 'partner') GROUP BY 1""")
def _(t):
    return graph.impact(t.edges, 5, IMPACTS).groupBy("impact").agg(n("links"), F.count_distinct("other").alias("companies"))


@query("g_path_bfs", """WITH RECURSIVE thin AS (SELECT corp_code AS a, partner_id AS b FROM edges WHERE corp_code <> partner_id), steps AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM thin UNION ALL SELECT b, a FROM thin)),
walk(node, hops) AS (SELECT 1::BIGINT, 0 UNION SELECT s.b, w.hops + 1 FROM walk w JOIN steps s ON s.a = w.node WHERE w.hops < 3) SELECT node, min(hops) AS hops FROM walk GROUP BY 1""")
def _(t):
    start = t.spark.range(1, 2).select(F.col("id").alias("node"))
    return graph.hops_from(t.edges, start, 3).select("node", "hops")


@query("g_risk_scenario", """WITH pairs AS (SELECT corp_code AS a, partner_id AS b FROM edges WHERE corp_code <> partner_id), steps AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs)),
one AS (SELECT b AS node FROM steps WHERE a = 5), two AS (SELECT DISTINCT b AS node FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY b) AS rank FROM steps WHERE a IN (SELECT node FROM one) AND b <> 5) WHERE rank <= 10)
SELECT wave, count(*) AS n, count(*) FILTER (WHERE stock_code IS NOT NULL) AS listed FROM (SELECT node, 1 AS wave FROM one UNION ALL SELECT node, 2 FROM two WHERE node NOT IN (SELECT node FROM one)) JOIN companies ON node = corp_code GROUP BY 1""")
def _(t):
    waves = graph.two_waves(t.edges, 5).join(t.companies, F.col("node") == F.col("corp_code"))
    return waves.groupBy("wave").agg(n(), F.count_if(F.col("stock_code").isNotNull()).alias("listed"))


@query("g_concentration", f"WITH {HHI} SELECT corp_code, string_agg(relation || ':' || {LEVEL}, ',' ORDER BY relation) AS levels, count(*) FILTER (WHERE hhi >= 2500) AS alerts FROM hhi WHERE corp_code < 100 GROUP BY 1")
def _(t):
    c = graph.concentration(t.edges.filter("corp_code < 100"))
    levels = F.array_join(F.array_sort(F.collect_list(F.concat("relation", F.lit(":"), "level"))), ",")
    return c.groupBy("corp_code").agg(levels.alias("levels"), F.count_if(F.col("level") == "HIGH").alias("alerts"))


@query("g_theme_article", "SELECT partner_name, count(*) AS links, count(DISTINCT sector) AS sectors, max(pct) AS strongest FROM edges JOIN companies USING (corp_code) WHERE market = 'EUROPE' GROUP BY 1 ORDER BY links DESC, partner_name LIMIT 10")
def _(t):
    rows = t.edges.join(t.companies.filter("market = 'EUROPE'"), "corp_code")
    return rows.groupBy("partner_name").agg(n("links"), F.count_distinct("sector").alias("sectors"), F.max("pct").alias("strongest")).orderBy(F.desc("links"), "partner_name").limit(10)


@query("g_profile", f"WITH {RISK} SELECT corp_code, risk_level, exposure, CASE WHEN exposure >= 10 THEN 'hub' WHEN cust_count > supp_count THEN 'seller' WHEN supp_count > cust_count THEN 'buyer' ELSE 'balanced' END AS position, coalesce(l.n, 0) AS leads FROM risk LEFT JOIN (SELECT corp_code, count(*) AS n FROM leads GROUP BY 1) l USING (corp_code)")
def _(t):
    r, found = graph.risk_rank(t.edges), t.leads.groupBy("corp_code").agg(n("leads"))
    position = F.when(F.col("exposure") >= 10, "hub").when(F.col("cust_count") > F.col("supp_count"), "seller").when(F.col("supp_count") > F.col("cust_count"), "buyer").otherwise("balanced")
    return r.join(found, "corp_code", "left").select("corp_code", "risk_level", "exposure", position.alias("position"), F.coalesce("leads", F.lit(0)).alias("leads"))


@query("g_daily_briefing", f"""WITH {DIFF} SELECT corp_code, source, score FROM (SELECT corp_code, 'change' AS source, {SIGNIFICANCE} AS score FROM alerts WHERE {SIGNIFICANCE} >= 20
    UNION ALL SELECT corp_code, 'lead', least(100, 10 * count(DISTINCT id)) FROM leads WHERE severity = 5 AND status = 'new' GROUP BY 1 UNION ALL SELECT partner_id, 'hub', least(100, count(DISTINCT corp_code)) FROM edges GROUP BY 1) ORDER BY score DESC, corp_code, source LIMIT 100""")
def _(t):
    change = graph.change_alerts(t.edges).filter("significance >= 20").select("corp_code", F.lit("change").alias("source"), F.col("significance").cast("long").alias("score"))
    lead = t.leads.filter("severity = 5 AND status = 'new'").groupBy("corp_code").agg(F.least(F.lit(100), 10 * F.count_distinct("id")).alias("score")).select("corp_code", F.lit("lead").alias("source"), "score")
    hub = t.edges.groupBy(F.col("partner_id").alias("corp_code")).agg(F.least(F.lit(100), F.count_distinct("corp_code")).alias("score")).select("corp_code", F.lit("hub").alias("source"), "score")
    return change.unionByName(lead).unionByName(hub).orderBy(F.desc("score"), "corp_code", "source").limit(100)


@query("d_hub_risk", "SELECT sector, count(DISTINCT corp_code) AS companies, count(*) FILTER (WHERE relation = 'supplier') AS suppliers, CASE WHEN count(DISTINCT corp_code) >= 10 THEN 'HIGH' ELSE 'MED' END AS level FROM edges JOIN companies USING (corp_code) WHERE partner_id = 1 GROUP BY 1 ORDER BY companies DESC, sector LIMIT 5")
def _(t):
    rows = t.edges.filter("partner_id = 1").join(t.companies, "corp_code")
    per = rows.groupBy("sector").agg(F.count_distinct("corp_code").alias("companies"), F.count_if(F.col("relation") == "supplier").alias("suppliers"))
    return per.withColumn("level", F.when(F.col("companies") >= 10, "HIGH").otherwise("MED")).orderBy(F.desc("companies"), "sector").limit(5)


@query("d_partner_map", """WITH w AS (SELECT corp_code, relation, partner_name, count(*) AS w FROM edges WHERE relation <> 'partner' GROUP BY 1, 2, 3), top AS (SELECT *, row_number() OVER (PARTITION BY corp_code, relation ORDER BY w DESC, partner_name) AS rank FROM w)
    SELECT corp_code, relation, count(*) AS partners, sum(w * w)::BIGINT * 10000.0::DOUBLE / (sum(w) * sum(w))::BIGINT AS hhi FROM top WHERE rank <= 10 GROUP BY 1, 2""")
def _(t):
    w = t.edges.filter("relation <> 'partner'").groupBy("corp_code", "relation", "partner_name").agg(n("w"))
    top = top_per_key(w, ["corp_code", "relation"], 10, F.desc("w"), F.col("partner_name"))
    return top.groupBy("corp_code", "relation").agg(n("partners"), (F.sum(F.col("w") * F.col("w")) * 10000.0 / (F.sum("w") * F.sum("w"))).alias("hhi"))


@query("d_supply_context", "SELECT corp_code, relation, id, rank FROM (SELECT corp_code, relation, id, row_number() OVER (PARTITION BY corp_code, relation ORDER BY pct DESC, id) AS rank FROM edges) WHERE rank <= 8")
def _(t):
    return top_per_key(t.edges, ["corp_code", "relation"], 8, F.desc("pct"), F.col("id")).select("corp_code", "relation", "id", "rank")


#: A lead's keywords: the first five terms of its comparison's result.
KEYWORDS_SQL = "list_sort(list_distinct(list_concat(regexp_extract_all({0}, '[가-힣]{{2,}}'), list_transform(regexp_extract_all({0}, '[A-Za-z]{{3,}}'), lambda w: lower(w)))))[1:5]"


@query("d_past_mentions", f"""SELECT k.id, k.keyword, count(*) AS docs, sum(m.n)::BIGINT AS mentions, min(m.at) AS since FROM (SELECT l.id, l.corp_code, c.report_id_a AS a, c.report_id_b AS b, unnest({KEYWORDS_SQL.format("c.result")}) AS keyword FROM leads l JOIN comparisons c ON c.id = l.comparison_id WHERE l.status = 'new') k
    JOIN (SELECT corp_code, id AS report, rcept_dt AS at, w, count(*) AS n FROM (SELECT corp_code, id, rcept_dt, lower(unnest(regexp_extract_all(biz_content || ' ' || raw_text, '[A-Za-z]{{3,}}'))) AS w FROM reports) GROUP BY 1, 2, 3, 4) m
    ON m.corp_code = k.corp_code AND m.w = k.keyword WHERE m.report <> k.a AND m.report <> k.b GROUP BY 1, 2""")
def _(t):
    filed = t.reports.select("corp_code", F.col("id").alias("report"), F.to_date("rcept_dt", "yyyyMMdd").alias("at"), F.concat_ws(" ", "biz_content", "raw_text").alias("body")).filter("body IS NOT NULL")
    filed = filed.join(t.reports.filter("biz_content IS NOT NULL").select(F.col("id").alias("report")), "report", "left_semi")
    table = write_postings(filed, ["corp_code", "report"], "body", "at")
    compared = t.comparisons.select(F.col("id").alias("comparison_id"), F.array("report_id_a", "report_id_b").alias("compared"), first_keywords(F.col("result")).alias("keywords"))
    asked = t.leads.filter("status = 'new'").join(compared, "comparison_id").select("id", "corp_code", F.explode("keywords").alias("keyword"), "compared")
    found = past_mentions(asked, table, "id", "corp_code", "report", "at", "compared")
    return found.withColumn("since", F.date_format("since", "yyyyMMdd"))


# Signals from the graph


def severity(count: str, high: int, middle: int):
    """5, 4 or 3 by a count."""
    return F.when(F.col(count) >= high, 5).when(F.col(count) >= middle, 4).otherwise(3).alias("severity")


def severity_sql(count: str, high: int, middle: int) -> str:
    return f"CASE WHEN {count} >= {high} THEN 5 WHEN {count} >= {middle} THEN 4 ELSE 3 END AS severity"


@query("s_hub", f"SELECT partner_name, relation, count(DISTINCT corp_code) AS companies, {severity_sql('count(DISTINCT corp_code)', 20, 10)} FROM edges GROUP BY 1, 2 HAVING count(DISTINCT corp_code) >= 5")
def _(t):
    per = t.edges.groupBy("partner_name", "relation").agg(F.count_distinct("corp_code").alias("companies")).filter("companies >= 5")
    return per.select("*", severity("companies", 20, 10))


@query("s_cluster", f"SELECT *, {severity_sql('shared', 10, 5)} FROM ({PAIRS_SQL})")
def _(t):
    return closest_pairs(t).select("*", severity("shared", 10, 5))


GLOBAL_NAMES = ["Supplier#000000004", "supplier#000000008", "Supplier#00000001", "9"]


@query("s_global", f"""SELECT g.name, count(*) AS links, count(DISTINCT e.corp_code) AS companies, {severity_sql("count(*)", 10, 5)} FROM edges e
    JOIN (SELECT unnest({GLOBAL_NAMES}) AS name) g ON contains(lower(e.partner_name), lower(g.name)) GROUP BY 1 HAVING count(*) >= 2""")
def _(t):
    names = t.spark.createDataFrame([(x,) for x in GLOBAL_NAMES], "name string").withColumn("low", F.lower("name"))
    links = t.edges.select("corp_code", F.lower("partner_name").alias("text"))
    hits = containing(links, "text", names, "low").withColumnRenamed("name", "low").join(names, "low")  # looked up once a name, not once an edge
    per = links.join(hits, "text").groupBy("name").agg(n("links"), F.count_distinct("corp_code").alias("companies")).filter("links >= 2")
    return per.select("*", severity("links", 10, 5))


@query("s_vertical", f"SELECT grp, count(*) AS links, count(DISTINCT corp_code) AS companies, {severity_sql('count(*)', 15, 8)} FROM ({GROUP_SQL}) GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT corp_code) >= 2")
def _(t):
    per = internal_links(t).groupBy("grp").agg(n("links"), F.count_distinct("corp_code").alias("companies")).filter("links >= 3 AND companies >= 2")
    return per.select("*", severity("links", 15, 8))


#: The greatest share that an edge's context names, by company and partner, from 30 % on.
DEPENDENCE_SQL = "SELECT corp_code, partner_id, partner_name, max(v) AS pct FROM (SELECT corp_code, partner_id, partner_name, unnest(regexp_extract_all(context, '([0-9]+)%', 1))::INT AS v FROM edges) WHERE v > 5 AND v < 100 GROUP BY 1, 2, 3 HAVING max(v) >= 30"


def dependence(t):
    v = F.array_max(F.filter(F.transform(F.regexp_extract_all("context", F.lit("([0-9]+)%"), F.lit(1)), lambda x: x.cast("int")), lambda x: (x > 5) & (x < 100)))
    return t.edges.groupBy("corp_code", "partner_id", "partner_name").agg(F.max(v).alias("pct")).filter("pct >= 30")


@query("s_dependence", f"SELECT corp_code, partner_name, pct, {severity_sql('pct', 50, 40)} FROM ({DEPENDENCE_SQL})")
def _(t):
    return dependence(t).select("corp_code", "partner_name", "pct", severity("pct", 50, 40))


@query("s_industry", f"SELECT sector, count(DISTINCT corp_code) AS companies, count(*) AS links, {severity_sql('count(DISTINCT corp_code)', 30, 15)} FROM edges JOIN companies USING (corp_code) GROUP BY 1 HAVING count(DISTINCT corp_code) >= 5")
def _(t):
    per = t.edges.join(t.companies, "corp_code").groupBy("sector").agg(F.count_distinct("corp_code").alias("companies"), n("links")).filter("companies >= 5")
    return per.select("*", severity("companies", 30, 15))


@query("s_impact", "SELECT corp_code, count(DISTINCT partner_name) AS partners, count(*) AS links FROM edges WHERE corp_code IN (SELECT corp_code FROM leads WHERE severity = 5 AND lead_type = 'risk') AND length(partner_name) <= 60 GROUP BY 1 HAVING count(*) >= 3")
def _(t):
    risky = t.leads.filter("severity = 5 AND lead_type = 'risk'")
    rows = t.edges.filter(F.length("partner_name") <= 60).join(risky, "corp_code", "left_semi")
    return rows.groupBy("corp_code").agg(F.count_distinct("partner_name").alias("partners"), n("links")).filter("links >= 3")


@query("s_new_entrant", "SELECT corp_code, partner_name, min(period) AS since FROM edges GROUP BY 1, 2 HAVING count(*) = 1 ORDER BY since DESC, partner_name, corp_code LIMIT 50")
def _(t):
    once = t.edges.groupBy("corp_code", "partner_name").agg(n(), F.min("period").alias("since")).filter("n = 1")
    return once.orderBy(F.desc("since"), "partner_name", "corp_code").limit(50).drop("n")


# Cross signals


def recent(days: int):
    return F.col("ts") >= F.date_sub(F.lit(AS_OF).cast("date"), days)


def recent_sql(days: int) -> str:
    return f"ts >= DATE '{AS_OF}' - {days}"


#: Disclosures that say much of a partner.
WEIGHTY = ["merger plan", "rights issue"]


@query("x_concentration_shift", f"""SELECT p.corp_code, p.partner_name, p.pct, d.rcept_no, d.rank, CASE WHEN p.pct >= 50 THEN 5 ELSE 4 END AS severity FROM ({DEPENDENCE_SQL}) p
    JOIN (SELECT corp_code, rcept_no, row_number() OVER (PARTITION BY corp_code ORDER BY ts DESC, rcept_no) AS rank FROM disclosures WHERE report_nm IN ('merger plan', 'rights issue')) d ON d.corp_code = p.partner_id WHERE d.rank <= 5""")
def _(t):
    latest = top_per_key(t.disclosures.filter(F.col("report_nm").isin(*WEIGHTY)), ["corp_code"], 5, F.desc("ts"), F.col("rcept_no"))  # five a company, before they meet the leads
    found = dependence(t).join(latest.select(F.col("corp_code").alias("partner_id"), "rcept_no", "rank"), "partner_id")
    return found.select("corp_code", "partner_name", "pct", "rcept_no", "rank", F.when(F.col("pct") >= 50, 5).otherwise(4).alias("severity"))


@query("x_supply_ripple", "SELECT e.partner_id AS corp_code, count(DISTINCT e.corp_code) AS named_by FROM edges e WHERE e.partner_id IN (SELECT corp_code FROM leads WHERE severity >= 4) GROUP BY 1 HAVING count(DISTINCT e.corp_code) >= 5")
def _(t):
    hot = t.leads.filter("severity >= 4").select(F.col("corp_code").alias("partner_id"))
    return t.edges.join(hot, "partner_id", "left_semi").groupBy(F.col("partner_id").alias("corp_code")).agg(F.count_distinct("corp_code").alias("named_by")).filter("named_by >= 5")


@query("x_new_business_funding", "SELECT l.corp_code, count(DISTINCT l.id) AS leads, count(DISTINCT d.rcept_no) AS filings FROM leads l JOIN disclosures d USING (corp_code) WHERE l.status = 'new' AND l.lead_type = 'strategy' AND d.report_nm = 'rights issue' GROUP BY 1")
def _(t):
    found = t.leads.filter("status = 'new' AND lead_type = 'strategy'").groupBy("corp_code").agg(F.count_distinct("id").alias("leads"))
    filings = t.disclosures.filter("report_nm = 'rights issue'").groupBy("corp_code").agg(F.count_distinct("rcept_no").alias("filings"))
    return found.join(filings, "corp_code")  # both sides counted before they meet


@query("x_industry_wave", f"""SELECT l.lead_type, l.sector, l.n AS leads, d.n AS filings FROM (SELECT lead_type, sector, count(*) AS n FROM leads JOIN companies USING (corp_code) GROUP BY 1, 2 HAVING count(*) >= 4) l
    JOIN (SELECT sector, count(*) AS n FROM disclosures JOIN companies USING (corp_code) WHERE report_nm IN ('merger plan', 'rights issue') AND {recent_sql(90)} GROUP BY 1 HAVING count(*) >= 2) d USING (sector)""")
def _(t):
    sector = t.companies.select("corp_code", "sector")
    found = t.leads.join(sector, "corp_code").groupBy("lead_type", "sector").agg(n("leads")).filter("leads >= 4")
    filings = t.disclosures.filter(F.col("report_nm").isin("merger plan", "rights issue") & recent(90)).join(sector, "corp_code").groupBy("sector").agg(n("filings")).filter("filings >= 2")
    return found.join(filings, "sector")


#: The tables' companies all have drafts, so none has a gap of 90.
HIDDEN_GAP = 60


@query("x_hidden_change", f"WITH gap AS ({leads.GAP_SQL}) SELECT corp_code, score AS gap, filings FROM (SELECT corp_code, count(*) AS filings FROM disclosures WHERE {recent_sql(60)} GROUP BY 1 HAVING count(*) >= 3 AND bool_or(report_nm = 'merger plan')) JOIN gap USING (corp_code) WHERE score >= {HIDDEN_GAP}")
def _(t):
    per = t.disclosures.filter(recent(60)).groupBy("corp_code").agg(n("filings"), F.bool_or(F.col("report_nm") == "merger plan").alias("strong")).filter("filings >= 3 AND strong")
    return leads.info_gap(t).filter(F.col("score") >= HIDDEN_GAP).join(per, "corp_code").select("corp_code", F.col("score").alias("gap"), "filings")


@query("x_global_risk", "SELECT partner_name, count(DISTINCT corp_code) AS companies, count(DISTINCT corp_code) FILTER (WHERE risky) AS at_risk FROM (SELECT e.*, e.corp_code IN (SELECT corp_code FROM leads WHERE severity = 5 AND lead_type = 'risk') AS risky FROM edges e) GROUP BY 1 HAVING companies >= 5 AND at_risk >= 2")
def _(t):
    risky = t.leads.filter("severity = 5 AND lead_type = 'risk'").select("corp_code").distinct().withColumn("risky", F.lit(True))
    named = t.edges.select("partner_name", "corp_code").distinct().join(risky, "corp_code", "left")
    return named.groupBy("partner_name").agg(n("companies"), F.count_if("risky").alias("at_risk")).filter("companies >= 5 AND at_risk >= 2")


#: Groups by how their companies' names begin; of several beginnings the longest holds.
BEGINNINGS = {"all": ["Customer#00000"], "hundreds": ["Customer#0000001", "Customer#0000002"], "first": ["Customer#00000000", "Customer#00000001"]}
_BEGINNINGS = ", ".join(str((g, p)) for g, ps in BEGINNINGS.items() for p in ps)


@query("x_group_restructuring", f"""SELECT grp, count(*) AS filings, count(DISTINCT corp_code) AS companies, CASE WHEN count(DISTINCT corp_code) >= 3 THEN 5 ELSE 4 END AS severity FROM disclosures
    JOIN (SELECT corp_code, arg_max(grp, length(prefix)) AS grp FROM companies JOIN (VALUES {_BEGINNINGS}) g(grp, prefix) ON starts_with(corp_name, prefix) GROUP BY 1) USING (corp_code)
    WHERE report_nm = 'merger plan' AND {recent_sql(180)} GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT corp_code) >= 2""")
def _(t):
    groups = t.spark.createDataFrame([(g, p) for g, ps in BEGINNINGS.items() for p in ps], "grp string, prefix string")
    own = longest_prefix(t.companies, "corp_name", groups, "prefix").join(groups, "prefix").select(F.col("name").alias("corp_name"), "grp")
    rows = t.disclosures.filter((F.col("report_nm") == "merger plan") & recent(180)).join(t.companies.select("corp_code", "corp_name"), "corp_code").join(own, "corp_name")
    per = rows.groupBy("grp").agg(n("filings"), F.count_distinct("corp_code").alias("companies")).filter("filings >= 2 AND companies >= 2")
    return per.withColumn("severity", F.when(F.col("companies") >= 3, 5).otherwise(4))


@query("x_ownership_decision", "SELECT corp_code, count(*) AS filings FROM disclosures d WHERE report_nm = 'insider holding' AND corp_code IN (SELECT corp_code FROM leads WHERE lead_type = 'strategy') GROUP BY 1 HAVING count(*) >= 2")
def _(t):
    rows = t.disclosures.filter("report_nm = 'insider holding'").join(t.leads.filter("lead_type = 'strategy'"), "corp_code", "left_semi")
    return rows.groupBy("corp_code").agg(n("filings")).filter("filings >= 2")
