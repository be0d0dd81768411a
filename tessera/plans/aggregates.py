"""Grouped and global aggregates over the domain views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators.lineage import cut
from tessera.operators.relational import dealt, top_per_key
from tessera.plans.registry import query


def is_(column: str, value):
    return F.count_if(F.col(column) == value)


@query(
    "agg_global_counts",
    """SELECT (SELECT count(*) FROM companies) AS companies, (SELECT count(*) FROM reports) AS reports, (SELECT count(DISTINCT corp_code) FROM reports) AS reporting,
    (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT partner_name) FROM edges) AS partners, (SELECT count(*) FROM leads WHERE status = 'new') AS new_leads""",
)
def _(t):
    return (
        t.companies.agg(F.count("*").alias("companies"))
        .join(t.reports.agg(F.count("*").alias("reports"), F.count_distinct("corp_code").alias("reporting")))
        .join(t.edges.agg(F.count("*").alias("edges"), F.count_distinct("partner_name").alias("partners")))
        .join(t.leads.agg(is_("status", "new").alias("new_leads")))
    )


@query(
    "agg_kpi_dashboard",
    """SELECT lead_type, count(*) AS n, count(*) FILTER (WHERE severity >= 4) AS hot, count(*) FILTER (WHERE status = 'new') AS fresh,
    max(created_at) AS latest, count(DISTINCT corp_code) AS companies FROM leads GROUP BY 1""",
)
def _(t):
    return t.leads.groupBy("lead_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("severity") >= 4).alias("hot"),
        is_("status", "new").alias("fresh"), F.max("created_at").alias("latest"), F.count_distinct("corp_code").alias("companies"),
    )


@query(
    "agg_nav_counts",
    """SELECT 'leads' AS item, coalesce(nullif(count(*) FILTER (WHERE status = 'new'), 0), count(*)) AS n FROM leads
    UNION ALL SELECT 'drafts', coalesce(nullif(count(*) FILTER (WHERE status = 'new'), 0), count(*)) FROM drafts
    UNION ALL SELECT 'questionnaires', coalesce(nullif(count(*) FILTER (WHERE status = 'pending'), 0), count(*)) FROM questionnaires""",
)
def _(t):
    def shown(df, status, item):
        return df.agg(F.coalesce(F.nullif(is_("status", status), F.lit(0)), F.count("*")).alias("n")).select(F.lit(item).alias("item"), "n")

    return shown(t.leads, "new", "leads").unionByName(shown(t.drafts, "new", "drafts")).unionByName(shown(t.questionnaires, "pending", "questionnaires"))


@query(
    "agg_group_cond",
    """SELECT corp_code, count(*) AS n, count(*) FILTER (WHERE report_type LIKE '%annual') AS annual, count(*) FILTER (WHERE report_type LIKE '%q1') AS q1,
    max(rcept_dt) AS latest FROM reports GROUP BY 1""",
)
def _(t):
    return t.reports.groupBy("corp_code").agg(
        F.count("*").alias("n"), F.count_if(F.col("report_type").endswith("annual")).alias("annual"), F.count_if(F.col("report_type").endswith("q1")).alias("q1"), F.max("rcept_dt").alias("latest")
    )


@query("agg_multi_key", "SELECT severity, lead_type, status, count(*) AS n FROM leads GROUP BY 1, 2, 3")
def _(t):
    return t.leads.groupBy("severity", "lead_type", "status").agg(F.count("*").alias("n"))


@query(
    "agg_ok_err",
    "SELECT type_a, type_b, model, count(*) AS n, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'error') AS err FROM comparisons GROUP BY 1, 2, 3",
)
def _(t):
    return t.comparisons.groupBy("type_a", "type_b", "model").agg(F.count("*").alias("n"), is_("status", "ok").alias("ok"), is_("status", "error").alias("err"))


META = [("1999_annual", "Annual 1999"), ("2000_q1", "First quarter 2000"), ("2030_q1", "First quarter 2030")]


@query(
    "agg_left_zero",
    f"""SELECT coalesce(m.code, r.report_type) AS code, m.label, coalesce(r.n, 0) AS n
    FROM (VALUES {", ".join(map(str, META))}) m(code, label) FULL JOIN (SELECT report_type, count(*) AS n FROM reports GROUP BY 1) r ON m.code = r.report_type""",
)
def _(t):
    counts = t.reports.groupBy("report_type").agg(F.count("*").alias("n"))
    meta = t.spark.createDataFrame(META, "code string, label string")
    return meta.join(counts, F.col("code") == F.col("report_type"), "full").select(F.coalesce("code", "report_type").alias("code"), "label", F.coalesce("n", F.lit(0)).alias("n"))


@query("agg_latest_type", "SELECT report_type, max(rcept_dt) AS latest FROM reports GROUP BY 1 ORDER BY latest DESC, report_type LIMIT 1")
def _(t):
    return t.reports.groupBy("report_type").agg(F.max("rcept_dt").alias("latest")).orderBy(F.desc("latest"), "report_type").limit(1)


@query(
    "agg_hub_rank",
    """SELECT partner_name, count(*) AS mentions, count(DISTINCT corp_code) AS reporters, count(*) FILTER (WHERE relation = 'customer') AS as_customer,
    count(*) FILTER (WHERE relation = 'supplier') AS as_supplier, count(*) FILTER (WHERE relation = 'partner') AS as_partner FROM edges GROUP BY 1
    ORDER BY reporters DESC, mentions DESC, partner_name LIMIT 50""",
)
def _(t):
    per = t.edges.groupBy("partner_name").agg(
        F.count("*").alias("mentions"), F.count_distinct("corp_code").alias("reporters"), is_("relation", "customer").alias("as_customer"),
        is_("relation", "supplier").alias("as_supplier"), is_("relation", "partner").alias("as_partner"),
    )
    return per.orderBy(F.desc("reporters"), F.desc("mentions"), "partner_name").limit(50)


@query(
    "agg_histogram",
    """SELECT bucket, count(*) AS companies, min(n) AS least FROM (SELECT n, CASE WHEN n >= 50 THEN '50+' WHEN n >= 20 THEN '20-49' WHEN n >= 10 THEN '10-19' WHEN n >= 5 THEN '5-9' ELSE '1-4' END AS bucket
    FROM (SELECT corp_code, count(*) AS n FROM edges GROUP BY 1)) GROUP BY 1""",
)
def _(t):
    n = F.col("n")
    bucket = F.when(n >= 50, "50+").when(n >= 20, "20-49").when(n >= 10, "10-19").when(n >= 5, "5-9").otherwise("1-4")
    per = t.edges.groupBy("corp_code").agg(F.count("*").alias("n"))
    return per.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("companies"), F.min("n").alias("least"))


@query(
    "agg_stats_bundle",
    """SELECT 'total' AS part, NULL::VARCHAR AS relation, NULL::INT AS period, NULL::VARCHAR AS partner_name, NULL::VARCHAR AS band, count(*) AS n, count(DISTINCT corp_code) AS companies, count(DISTINCT partner_name) AS partners FROM edges
    UNION ALL SELECT 'relation', relation, NULL, NULL, NULL, count(*), count(DISTINCT corp_code), NULL FROM edges GROUP BY relation
    UNION ALL SELECT 'period', NULL, period, NULL, NULL, count(*), count(DISTINCT corp_code), NULL FROM edges GROUP BY period
    UNION ALL SELECT 'hub', NULL, NULL, partner_name, NULL, n, companies, NULL FROM (SELECT partner_name, count(*) AS n, count(DISTINCT corp_code) AS companies FROM edges GROUP BY 1 ORDER BY n DESC, partner_name NULLS LAST LIMIT 10)
    UNION ALL SELECT 'band', NULL, NULL, NULL, CASE WHEN n >= 20 THEN '20+' WHEN n >= 10 THEN '10-19' WHEN n >= 5 THEN '5-9' WHEN n >= 2 THEN '2-4' ELSE '1' END AS band, sum(n)::BIGINT, count(*), NULL
    FROM (SELECT corp_code, count(*) AS n FROM edges GROUP BY 1) GROUP BY band""",
)
def _(t):
    # A company's edges are gathered once, in tasks whose number grows with the edges; what is distinct is then counted without a list of companies.
    sets = ["total", "relation", "period", "partner_name"]
    rows = dealt(t.edges.select("corp_code", *sets[1:]), t.lineitem.count(), "corp_code")
    of_set = lambda own: F.struct(F.lit(own).alias("part"), *[F.when(F.lit(own == c), F.col(c)).alias(c) for c in sets[1:]])
    each = rows.select("corp_code", F.inline(F.array(*map(of_set, sets)))).groupBy("corp_code", "part", *sets[1:]).agg(F.count("*").alias("n"))
    n = F.col("n")
    band = F.when(n >= 20, "20+").when(n >= 10, "10-19").when(n >= 5, "5-9").when(n >= 2, "2-4").otherwise("1")
    itself = F.struct("part", *sets[1:], F.lit(None).cast("string").alias("band"), F.col("corp_code").isNotNull().cast("long").alias("companies"))
    banded = F.struct(F.lit("band").alias("part"), *sets[1:], band.alias("band"), F.lit(1).cast("long").alias("companies"))  # edges without a company are banded as one's
    per = each.select("n", F.inline(F.when(F.col("part") == "total", F.array(itself, banded)).otherwise(F.array(itself))))
    none = t.spark.sql("SELECT 'total' AS part, 0L AS n, 0L AS companies")  # the set of all has a row without edges, too
    keys = ["part", *sets[1:], "band"]
    per = cut(per.unionByName(none, allowMissingColumns=True).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("companies").alias("companies")))
    hubs = per.filter("part = 'partner_name'").withColumn("part", F.lit("hub"))
    partners = hubs.agg(F.count("partner_name").alias("partners"))
    rest = per.filter("part <> 'partner_name'").crossJoin(partners).withColumn("partners", F.when(F.col("part") == "total", F.col("partners")))
    return rest.unionByName(hubs.orderBy(F.desc("n"), F.asc_nulls_last("partner_name")).limit(10), allowMissingColumns=True)


@query("agg_exposure", "SELECT partner_name, count(DISTINCT corp_code) AS exposure FROM edges WHERE relation = 'supplier' GROUP BY 1")
def _(t):
    return t.edges.filter("relation = 'supplier'").groupBy("partner_name").agg(F.count_distinct("corp_code").alias("exposure"))


@query(
    "agg_sector_avg",
    """SELECT sector, fiscal_year, round(avg(margin) FILTER (WHERE margin BETWEEN -50 AND 50), 6) AS avg_margin, count(*) AS companies
    FROM (SELECT sector, fiscal_year, operating_income * 100.0::DOUBLE / revenue AS margin FROM financials JOIN companies USING (corp_code) WHERE revenue > 0) GROUP BY 1, 2 HAVING count(*) >= 3""",
)
def _(t):
    rows = t.financials.filter("revenue > 0").join(t.companies, "corp_code").withColumn("margin", F.col("operating_income") * 100.0 / F.col("revenue"))
    trimmed = F.avg(F.when(F.col("margin").between(-50, 50), F.col("margin")))
    return rows.groupBy("sector", "fiscal_year").agg(F.round(trimmed, 6).alias("avg_margin"), F.count("*").alias("companies")).filter("companies >= 3")


@query("agg_group_concat", "SELECT partner_name, string_agg(relation, ',' ORDER BY relation) AS relations FROM (SELECT DISTINCT partner_name, relation FROM edges) GROUP BY 1")
def _(t):
    return t.edges.groupBy("partner_name").agg(F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("relations"))


@query(
    "agg_avg_min_order",
    """SELECT grade, count(*) AS n, round(avg(score), 6) AS avg_score, min(score) AS least FROM (SELECT score, CASE WHEN score >= 80 THEN 'A' WHEN score >= 60 THEN 'B' WHEN score >= 40 THEN 'C' ELSE 'D' END AS grade
    FROM drafts WHERE score IS NOT NULL) GROUP BY 1""",
)
def _(t):
    s = F.col("score")
    grade = F.when(s >= 80, "A").when(s >= 60, "B").when(s >= 40, "C").otherwise("D")
    return t.drafts.filter(s.isNotNull()).groupBy(grade.alias("grade")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("avg_score"), F.min("score").alias("least"))


@query(
    "agg_majority_vote",
    """SELECT tier, host, corp_code, n FROM (SELECT tier, host, corp_code, count(*) AS n, row_number() OVER (PARTITION BY host ORDER BY count(*) DESC, corp_code, tier) AS rank FROM news GROUP BY 1, 2, 3) WHERE rank = 1""",
)
def _(t):
    votes = t.news.groupBy("host", "corp_code", "tier").agg(F.count("*").alias("n"))
    best = F.min_by(F.struct("corp_code", "tier", "n"), F.struct(-F.col("n"), "corp_code", "tier")).alias("b")
    return votes.groupBy("host").agg(best).select("host", "b.corp_code", "b.tier", "b.n")


@query(
    "agg_response_rate",
    """SELECT count(*) FILTER (WHERE status = 'replied') AS replied, count(*) FILTER (WHERE status IN ('sent', 'replied')) AS sent,
    round(count(*) FILTER (WHERE status = 'replied') * 100.0::DOUBLE / nullif(count(*) FILTER (WHERE status IN ('sent', 'replied')), 0), 1) AS rate FROM questionnaires""",
)
def _(t):
    sums = t.questionnaires.agg(is_("status", "replied").alias("replied"), F.count_if(F.col("status").isin("sent", "replied")).alias("sent"))
    return sums.withColumn("rate", F.round(F.try_divide(F.col("replied") * 100.0, F.col("sent")), 1))


@query("agg_sent_stats", "SELECT corp_code, count(*) AS sent, max(created_at) AS last_sent FROM questionnaires WHERE status IN ('sent', 'replied') GROUP BY 1")
def _(t):
    return t.questionnaires.filter(F.col("status").isin("sent", "replied")).groupBy("corp_code").agg(F.count("*").alias("sent"), F.max("created_at").alias("last_sent"))


@query(
    "agg_quality_stats",
    "SELECT quality, toxic, count(*) AS n, count(*) FILTER (WHERE quality IS NULL) AS unlabelled, sum(n_chars)::BIGINT AS chars FROM articles GROUP BY 1, 2",
)
def _(t):
    return t.articles.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.count_if(F.col("quality").isNull()).alias("unlabelled"), F.sum("n_chars").alias("chars"))


@query(
    "agg_status_bar",
    "SELECT news_status, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM leads GROUP BY 1",
)
def _(t):
    per = t.leads.groupBy("news_status").agg(F.count("*").alias("n"))
    return per.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


@query(
    "agg_score_bands",
    "SELECT count(*) FILTER (WHERE score >= 70) AS high, count(*) FILTER (WHERE score >= 50 AND score < 70) AS middle, count(*) FILTER (WHERE score < 50) AS low, count(*) FILTER (WHERE score IS NULL) AS unknown FROM drafts",
)
def _(t):
    s = F.col("score")
    return t.drafts.agg(F.count_if(s >= 70).alias("high"), F.count_if((s >= 50) & (s < 70)).alias("middle"), F.count_if(s < 50).alias("low"), F.count_if(s.isNull()).alias("unknown"))


@query(
    "agg_content_coverage",
    """SELECT report_type, count(*) AS n, count(*) FILTER (WHERE n_chars >= 1000) AS long, round(avg(n_chars) FILTER (WHERE length(coalesce(biz_content, '')) > 0), 6) AS avg_with_biz FROM reports GROUP BY 1""",
)
def _(t):
    has = F.length(F.coalesce("biz_content", F.lit(""))) > 0
    return t.reports.groupBy("report_type").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") >= 1000).alias("long"), F.round(F.avg(F.when(has, F.col("n_chars"))), 6).alias("avg_with_biz"))


@query("agg_multi_sector_hub", "SELECT partner_name, count(DISTINCT corp_code) AS reporters, count(DISTINCT sector) AS sectors FROM edges JOIN companies USING (corp_code) GROUP BY 1 HAVING count(DISTINCT corp_code) >= 10")
def _(t):
    rows = t.edges.join(t.companies, "corp_code")
    return rows.groupBy("partner_name").agg(F.count_distinct("corp_code").alias("reporters"), F.count_distinct("sector").alias("sectors")).filter("reporters >= 10")


SECTOR_WORDS = [("home", "HOUSE"), ("home", "FURN"), ("industry", "MACH"), ("industry", "AUTO"), ("build", "BUILD"), ("build", "MACH")]


@query(
    "agg_sector_profile",
    f"""SELECT grp, count(*) AS n, count(*) FILTER (WHERE relation = 'customer') AS customers, count(*) FILTER (WHERE relation = 'supplier') AS suppliers
    FROM (SELECT DISTINCT k.grp, e.id, e.relation FROM edges e JOIN companies c USING (corp_code) JOIN (VALUES {", ".join(map(str, SECTOR_WORDS))}) k(grp, word) ON contains(c.sector, k.word)) GROUP BY 1""",
)
def _(t):
    words = t.spark.createDataFrame(SECTOR_WORDS, "grp string, word string")
    sectors = t.companies.select("sector").distinct().join(words, F.contains("sector", "word")).select("grp", "sector").distinct()
    rows = t.edges.join(t.companies.select("corp_code", "sector"), "corp_code").join(sectors, "sector")
    return rows.groupBy("grp").agg(F.count("*").alias("n"), is_("relation", "customer").alias("customers"), is_("relation", "supplier").alias("suppliers"))


@query("agg_taxonomy_tree", "SELECT sector, market, relation, count(*) AS n, count(DISTINCT corp_code) AS companies FROM edges JOIN companies USING (corp_code) GROUP BY 1, 2, 3")
def _(t):
    return t.edges.join(t.companies, "corp_code").groupBy("sector", "market", "relation").agg(F.count("*").alias("n"), F.count_distinct("corp_code").alias("companies"))


@query(
    "agg_sector_top5",
    "SELECT sector, partner_name, n, rank FROM (SELECT sector, partner_name, count(*) AS n, row_number() OVER (PARTITION BY sector ORDER BY count(*) DESC, partner_name) AS rank FROM edges JOIN companies USING (corp_code) GROUP BY 1, 2) WHERE rank <= 5",
)
def _(t):
    per = t.edges.join(t.companies, "corp_code").groupBy("sector", "partner_name").agg(F.count("*").alias("n"))
    return top_per_key(per, ["sector"], 5, F.desc("n"), F.col("partner_name"))


@query("agg_inverted_map", "SELECT lower(partner_name) AS partner, count(DISTINCT corp_name) AS n, string_agg(DISTINCT corp_name, '|' ORDER BY corp_name) AS reporters FROM edges JOIN companies USING (corp_code) GROUP BY 1")
def _(t):
    rows = t.edges.join(t.companies, "corp_code").groupBy(F.lower("partner_name").alias("partner")).agg(F.array_sort(F.collect_set("corp_name")).alias("r"))
    return rows.select("partner", F.size("r").cast("long").alias("n"), F.array_join("r", "|").alias("reporters"))


@query("agg_partner_hub3", "SELECT partner_name, relation, count(DISTINCT corp_code) AS companies FROM edges GROUP BY 1, 2 HAVING count(DISTINCT corp_code) >= 3")
def _(t):
    return t.edges.groupBy("partner_name", "relation").agg(F.count_distinct("corp_code").alias("companies")).filter("companies >= 3")


@query("agg_top_contacts", "SELECT host, count(*) AS n FROM news GROUP BY 1 ORDER BY n DESC, host LIMIT 20")
def _(t):
    return t.news.groupBy("host").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(20)


@query("agg_citation_status", "SELECT tier, published_at IS NULL AS undated, count(*) AS n, round(avg(weight), 6) AS avg_weight FROM news GROUP BY 1, 2")
def _(t):
    return t.news.groupBy("tier", F.col("published_at").isNull().alias("undated")).agg(F.count("*").alias("n"), F.round(F.avg("weight"), 6).alias("avg_weight"))


@query(
    "agg_lead_stats",
    """SELECT lead_type, severity, count(*) AS n, count(DISTINCT comparison_id) AS comparisons, round(count(*) FILTER (WHERE status <> 'new') * 100.0::DOUBLE / count(*), 6) AS processed
    FROM leads GROUP BY GROUPING SETS ((lead_type), (severity), (lead_type, severity))""",
)
def _(t):
    t.leads.createOrReplaceTempView("tessera_leads")
    return t.spark.sql(
        """SELECT lead_type, severity, count(*) AS n, count(DISTINCT comparison_id) AS comparisons, round(count_if(status <> 'new') * 100.0D / count(*), 6) AS processed
        FROM tessera_leads GROUP BY GROUPING SETS ((lead_type), (severity), (lead_type, severity))"""
    )


@query(
    "agg_year_coverage",
    """SELECT fiscal_year, count(*) AS n, count(DISTINCT corp_code) AS companies, round(count(CASE WHEN total_equity > 0 THEN 1 END)::DOUBLE / count(*), 6) AS with_equity FROM financials GROUP BY 1""",
)
def _(t):
    share = F.round(F.count_if(F.col("total_equity") > 0) / F.count("*"), 6)
    return t.financials.groupBy("fiscal_year").agg(F.count("*").alias("n"), F.count_distinct("corp_code").alias("companies"), share.alias("with_equity"))


@query("agg_pattern_stats", "SELECT lead_type, status, count(*) AS n, round(avg(severity), 6) AS avg_severity FROM leads GROUP BY 1, 2")
def _(t):
    return t.leads.groupBy("lead_type", "status").agg(F.count("*").alias("n"), F.round(F.avg("severity"), 6).alias("avg_severity"))


@query(
    "agg_industry_chain",
    """SELECT sector, count(DISTINCT corp_code) AS companies, count(DISTINCT partner_name) AS partners, count(*) AS links, CASE WHEN count(DISTINCT corp_code) >= 100 THEN 30 ELSE 15 END AS severity
    FROM edges JOIN companies USING (corp_code) GROUP BY 1 HAVING count(DISTINCT corp_code) >= 5""",
)
def _(t):
    per = t.edges.join(t.companies, "corp_code").groupBy("sector").agg(F.count_distinct("corp_code").alias("companies"), F.count_distinct("partner_name").alias("partners"), F.count("*").alias("links"))
    return per.filter("companies >= 5").withColumn("severity", F.when(F.col("companies") >= 100, 30).otherwise(15))


@query(
    "agg_keyword_dict",
    """SELECT relation, partner_name AS name, count(DISTINCT corp_code) AS refs, bool_or(coalesce(is_listed, false)) AS is_listed FROM edges LEFT JOIN mapping USING (partner_name) GROUP BY 1, 2 HAVING count(DISTINCT corp_code) >= 2""",
)
def _(t):
    rows = t.edges.join(t.mapping, "partner_name", "left")
    per = rows.groupBy("relation", F.col("partner_name").alias("name")).agg(F.count_distinct("corp_code").alias("refs"), F.bool_or(F.coalesce("is_listed", F.lit(False))).alias("is_listed"))
    return per.filter("refs >= 2")
