"""Joins, set operations and per-key picks over the domain views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.operators.pairs import shared_pairs
from tessera.operators.relational import pick_first, top_per_key
from tessera.plans import parted
from tessera.plans.registry import query
from tessera.sources.adapters import AS_OF


def n(name: str = "n"):
    return F.count("*").alias(name)


@query("join_left_optional", "SELECT draft_id, d.status, d.score, l.severity FROM drafts d LEFT JOIN leads l ON d.lead_id = l.id AND l.severity >= 3 ORDER BY score DESC NULLS LAST, draft_id LIMIT 200")
def _(t):
    strong = t.leads.filter("severity >= 3").select(F.col("id").alias("lead_id"), "severity")
    return t.drafts.join(strong, "lead_id", "left").select("draft_id", "status", "score", "severity").orderBy(F.desc_nulls_last("score"), "draft_id").limit(200)


@query(
    "join_left_chain",
    """SELECT l.id, coalesce(d.score, 50) AS score, coalesce(q.n, 0) AS questions, coalesce(c.status, 'none') AS comparison FROM leads l
    LEFT JOIN (SELECT lead_id, max(score) AS score FROM drafts GROUP BY 1) d ON d.lead_id = l.id LEFT JOIN (SELECT lead_id, count(*) AS n FROM questionnaires GROUP BY 1) q ON q.lead_id = l.id
    LEFT JOIN comparisons c ON c.id = l.comparison_id""",
)
def _(t):
    drafts = t.drafts.groupBy(F.col("lead_id").alias("id")).agg(F.max("score").alias("score"))
    asked = t.questionnaires.groupBy(F.col("lead_id").alias("id")).agg(n("questions"))
    compared = t.comparisons.select(F.col("id").alias("comparison_id"), F.col("status").alias("comparison"))
    rows = t.leads.select("id", "comparison_id").join(drafts, "id", "left").join(asked, "id", "left").join(compared, "comparison_id", "left")
    return rows.select("id", F.coalesce("score", F.lit(50)).alias("score"), F.coalesce("questions", F.lit(0)).alias("questions"), F.coalesce("comparison", F.lit("none")).alias("comparison"))


@query(
    "join_draft_queue",
    """SELECT l.id, l.corp_code, l.severity, c.result FROM leads l LEFT JOIN comparisons c ON c.id = l.comparison_id WHERE l.status = 'new' AND coalesce(l.signal_count, 60) >= 45
    AND NOT EXISTS (SELECT 1 FROM drafts d WHERE d.lead_id = l.id) ORDER BY l.severity DESC, l.signal_count DESC, l.id LIMIT 100""",
)
def _(t):
    queue = t.leads.filter("status = 'new' AND coalesce(signal_count, 60) >= 45").join(t.drafts.select(F.col("lead_id").alias("id")), "id", "left_anti")
    queue = queue.orderBy(F.desc("severity"), F.desc("signal_count"), "id").limit(100)
    results = t.comparisons.select(F.col("id").alias("comparison_id"), "result")
    return queue.join(results, "comparison_id", "left").select("id", "corp_code", "severity", "result")


@query(
    "join_double_role",
    """SELECT c.id, a.report_type AS type_now, b.report_type AS type_then, a.rcept_dt AS date_now, b.rcept_dt AS date_then FROM comparisons c
    LEFT JOIN reports a ON a.id = c.report_id_a LEFT JOIN reports b ON b.id = c.report_id_b WHERE a.n_chars > 4000 OR b.n_chars > 4000""",
)
def _(t):
    side = lambda s, x: t.reports.select(F.col("id").alias(f"report_id_{s}"), F.col("report_type").alias(f"type_{x}"), F.col("rcept_dt").alias(f"date_{x}"), F.col("n_chars").alias(f"n_{x}"))
    both = t.comparisons.select("id", "report_id_a", "report_id_b").join(side("a", "now"), "report_id_a", "left").join(side("b", "then"), "report_id_b", "left")
    return both.filter("n_now > 4000 OR n_then > 4000").select("id", "type_now", "type_then", "date_now", "date_then")


CHAIN = """SELECT r.id AS report_id, c.id AS comparison_id, l.id AS lead_id, d.draft_id, q.q_id FROM reports r JOIN comparisons c ON c.report_id_a = r.id JOIN leads l ON l.comparison_id = c.id
    JOIN drafts d ON d.lead_id = l.id LEFT JOIN questionnaires q ON q.draft_id = d.draft_id"""


@query("join_fk_chain", CHAIN + " WHERE r.n_chars > 3000")
def _(t):
    rows = t.reports.filter("n_chars > 3000").select(F.col("id").alias("report_id")).join(t.comparisons.select(F.col("id").alias("comparison_id"), F.col("report_id_a").alias("report_id")), "report_id")
    rows = rows.join(t.leads.select(F.col("id").alias("lead_id"), "comparison_id"), "comparison_id").join(t.drafts.select("draft_id", "lead_id"), "lead_id")
    return rows.join(t.questionnaires.select("q_id", "draft_id"), "draft_id", "left").select("report_id", "comparison_id", "lead_id", "draft_id", "q_id")


@query(
    "join_lineage_counts",
    """SELECT r.id, count(DISTINCT c.cid) AS comparisons, count(DISTINCT l.id) AS leads, count(DISTINCT d.draft_id) AS drafts, count(DISTINCT q.q_id) AS questionnaires FROM reports r
    LEFT JOIN (SELECT report_id_a AS rid, id AS cid FROM comparisons UNION SELECT report_id_b, id FROM comparisons) c ON c.rid = r.id LEFT JOIN leads l ON l.comparison_id = c.cid
    LEFT JOIN drafts d ON d.lead_id = l.id LEFT JOIN questionnaires q ON q.draft_id = d.draft_id GROUP BY 1""",
)
def _(t):
    # Counts roll up hop by hop, so that no row is multiplied before it is counted.
    asked = t.questionnaires.groupBy("draft_id").agg(n("q"))
    drafts = t.drafts.join(asked, "draft_id", "left").groupBy(F.col("lead_id").alias("id")).agg(n("d"), F.sum("q").alias("q"))
    leads = t.leads.join(drafts, "id", "left").groupBy("comparison_id").agg(n("l"), F.sum("d").alias("d"), F.sum("q").alias("q"))
    sides = t.comparisons.select(F.explode(F.array_distinct(F.array("report_id_a", "report_id_b"))).alias("id"), F.col("id").alias("comparison_id"))
    per = sides.join(leads, "comparison_id", "left").groupBy("id").agg(n("c"), F.sum("l").alias("l"), F.sum("d").alias("d"), F.sum("q").alias("q"))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return t.reports.select("id").join(per, "id", "left").select("id", zero("c", "comparisons"), zero("l", "leads"), zero("d", "drafts"), zero("q", "questionnaires"))


@query(
    "join_pair_period",
    """SELECT p.* FROM (SELECT corp_code, max(id) FILTER (WHERE report_type = '1999_q1') AS id_now, max(id) FILTER (WHERE report_type = '1998_annual') AS id_then FROM reports GROUP BY 1) p
    JOIN companies USING (corp_code) WHERE id_now IS NOT NULL AND id_then IS NOT NULL AND market <> 'ASIA'""",
)
def _(t):
    both = t.reports.filter(F.col("report_type").isin("1999_q1", "1998_annual")).groupBy("corp_code").agg(
        F.max(F.when(F.col("report_type") == "1999_q1", F.col("id"))).alias("id_now"), F.max(F.when(F.col("report_type") == "1998_annual", F.col("id"))).alias("id_then")
    )
    return both.filter("id_now IS NOT NULL AND id_then IS NOT NULL").join(t.companies.filter("market <> 'ASIA'").select("corp_code"), "corp_code", "left_semi")


@query("join_missing_period", "SELECT DISTINCT corp_code FROM reports a WHERE report_type LIKE '%annual' AND NOT EXISTS (SELECT 1 FROM reports b WHERE b.corp_code = a.corp_code AND b.report_type LIKE '%q1')")
def _(t):
    return t.reports.filter("report_type LIKE '%annual'").select("corp_code").distinct().join(t.reports.filter("report_type LIKE '%q1'").select("corp_code"), "corp_code", "left_anti")


@query("join_name_backfill", "SELECT r.id, coalesce(nullif(r.corp_name, ''), m.name) AS corp_name FROM reports r LEFT JOIN (SELECT corp_code, max(nullif(corp_name, '')) AS name FROM reports GROUP BY 1) m USING (corp_code)")
def _(t):
    names = t.reports.groupBy("corp_code").agg(F.max(F.nullif("corp_name", F.lit(""))).alias("name"))
    return t.reports.join(names, "corp_code", "left").select("id", F.coalesce(F.nullif("corp_name", F.lit("")), "name").alias("corp_name"))


@query(
    "join_resolve_partner",
    """SELECT p.partner_name, CASE WHEN m.partner_name IS NOT NULL THEN m.mapped_code WHEN x.corp_code IS NOT NULL THEN x.corp_code ELSE f.corp_code END AS resolved, m.partner_name IS NOT NULL AS mapped
    FROM (SELECT DISTINCT partner_name FROM edges UNION SELECT 'Customer#00000000' || i FROM range(0, 3) r(i)) p LEFT JOIN mapping m USING (partner_name)
    LEFT JOIN (SELECT corp_name, min(corp_code) AS corp_code FROM companies GROUP BY 1) x ON x.corp_name = p.partner_name
    LEFT JOIN (SELECT substr(corp_name, 1, 17) AS stem, min(corp_code) AS corp_code FROM companies GROUP BY 1) f ON f.stem = p.partner_name""",
)
def _(t):
    extra = t.spark.range(3).select(F.concat(F.lit("Customer#00000000"), "id").alias("partner_name"))
    partners = t.edges.select("partner_name").union(extra).distinct()
    mapped = t.mapping.select("partner_name", "mapped_code", F.lit(True).alias("mapped"))
    exact = t.companies.groupBy(F.col("corp_name").alias("partner_name")).agg(F.min("corp_code").alias("exact"))
    stem = t.companies.groupBy(F.substring("corp_name", 1, 17).alias("partner_name")).agg(F.min("corp_code").alias("stem"))  # a prefix match as an equi-join
    rows = partners.join(mapped, "partner_name", "left").join(exact, "partner_name", "left").join(stem, "partner_name", "left")
    known = F.coalesce("mapped", F.lit(False))  # mapped to null: known to be unlisted, so no further step
    return rows.select("partner_name", F.when(known, F.col("mapped_code")).otherwise(F.coalesce("exact", "stem")).alias("resolved"), known.alias("mapped"))


@query(
    "join_build_mapping",
    """SELECT partner_name, n, CASE WHEN partner_name LIKE '%7' THEN 'noise' WHEN match_type = 'exact' THEN 'exact' WHEN match_type = 'normalised' THEN 'normalised' ELSE 'none' END AS match,
    CASE WHEN partner_name LIKE '%7' THEN NULL ELSE mapped_code END AS corp_code FROM (SELECT partner_name, count(*) AS n FROM edges GROUP BY 1 ORDER BY n DESC, partner_name LIMIT 60) LEFT JOIN mapping USING (partner_name)""",
)
def _(t):
    top = t.edges.groupBy("partner_name").agg(n()).orderBy(F.desc("n"), "partner_name").limit(60).join(t.mapping, "partner_name", "left")
    noise = F.col("partner_name").endswith("7")
    match = F.when(noise, "noise").when(F.col("match_type").isin("exact", "normalised"), F.col("match_type")).otherwise("none")
    return top.select("partner_name", "n", match.alias("match"), F.when(~noise, F.col("mapped_code")).alias("corp_code"))


@query(
    "join_contains_name",
    "SELECT w.word, count(*) AS companies FROM (SELECT DISTINCT substr(partner_name, 16, 3) AS word FROM edges) w JOIN companies c ON contains(c.corp_name, w.word) GROUP BY 1",
)
def _(t):
    words = t.edges.select(F.substring("partner_name", 16, 3).alias("word")).distinct()
    # Substrings of the word length turn the theta join into an equi-join that scales with the names' length.
    parts = t.companies.select("corp_code", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("corp_name") - 2), lambda i: F.substring(F.col("corp_name"), i, F.lit(3))))).alias("word"))
    return parts.join(words, "word", "left_semi").groupBy("word").agg(n("companies"))


#: Pairs of companies that name three or more partners alike, the first thirty.
PAIRS_SQL = """SELECT a, b, count(*) AS shared FROM (SELECT DISTINCT x.corp_code AS a, y.corp_code AS b, x.relation, x.partner_name FROM (SELECT DISTINCT corp_code, relation, partner_name FROM edges) x
    JOIN (SELECT DISTINCT corp_code, relation, partner_name FROM edges) y ON x.partner_name = y.partner_name AND x.relation = y.relation AND x.corp_code < y.corp_code)
    GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY shared DESC, a, b LIMIT 30"""


def closest_pairs(t):
    return shared_pairs(t.edges, "corp_code", ["partner_name", "relation"], 3, first=30)


@query("join_pairs_shared", PAIRS_SQL)
def _(t):
    return closest_pairs(t)


#: Groups by keywords that their companies' names contain.
GROUPS = {"teens": ["#00000001"], "low": ["#00000002", "#00000003"], "high": ["#00000008", "#00000009", "r#0000001"], "sevens": ["7"]}
_KEYWORDS = ", ".join(str((g, k)) for g, keys in GROUPS.items() for k in keys)
#: (grp, corp_code, corp_name) of edges inside a group.
GROUP_SQL = f"""SELECT g.grp, e.id, e.corp_code, c.corp_name FROM edges e JOIN companies c USING (corp_code) JOIN (SELECT DISTINCT grp FROM (VALUES {_KEYWORDS}) k(grp, word)) g
    ON EXISTS (SELECT 1 FROM (VALUES {_KEYWORDS}) k(grp, word) WHERE k.grp = g.grp AND contains(c.corp_name, word)) AND EXISTS (SELECT 1 FROM (VALUES {_KEYWORDS}) k(grp, word) WHERE k.grp = g.grp AND contains(e.partner_name, word))"""


def internal_links(t):
    groups = t.spark.createDataFrame([(g, k) for g, keys in GROUPS.items() for k in keys], "grp string, keyword string")
    named = t.edges.join(t.companies.select("corp_code", "corp_name"), "corp_code").select("id", "corp_code", "corp_name", "partner_name")
    return graph.group_links(named, groups)


@query("join_group_internal", f"SELECT grp, count(*) AS links, count(DISTINCT corp_code) AS companies FROM ({GROUP_SQL}) GROUP BY 1 HAVING count(*) >= 3")
def _(t):
    return internal_links(t).groupBy("grp").agg(n("links"), F.count_distinct("corp_code").alias("companies")).filter("links >= 3")


@query("join_semi_in_subquery", "SELECT id, corp_code FROM contacts WHERE corp_code IN (SELECT corp_code FROM leads WHERE severity = 5)")
def _(t):
    return t.contacts.join(t.leads.filter("severity = 5"), "corp_code", "left_semi").select("id", "corp_code")


@query(
    "join_semi_exists",
    """SELECT q_id, EXISTS (SELECT 1 FROM contacts c WHERE c.corp_code = q.corp_code AND c.email LIKE 'ir@%') AS has_ir, EXISTS (SELECT 1 FROM questionnaires o WHERE o.corp_code = q.corp_code AND o.status = 'sent') AS sent_before FROM questionnaires q""",
)
def _(t):
    ir = t.contacts.filter("email LIKE 'ir@%'").select("corp_code").distinct().withColumn("ir", F.lit(True))
    sent = t.questionnaires.filter("status = 'sent'").select("corp_code").distinct().withColumn("s", F.lit(True))
    return t.questionnaires.join(ir, "corp_code", "left").join(sent, "corp_code", "left").select("q_id", F.col("ir").isNotNull().alias("has_ir"), F.col("s").isNotNull().alias("sent_before"))


@query("join_anti_not_exists", "SELECT id FROM comparisons c WHERE status = 'ok' AND NOT EXISTS (SELECT 1 FROM leads l WHERE l.comparison_id = c.id)")
def _(t):
    return t.comparisons.filter("status = 'ok'").select("id").join(t.leads.select(F.col("comparison_id").alias("id")), "id", "left_anti")


@query(
    "join_anti_multi",
    """SELECT e.partner_name, count(DISTINCT e.corp_code) AS reporters FROM edges e JOIN mapping m USING (partner_name) WHERE m.is_listed AND m.mapped_code NOT IN (SELECT corp_code FROM edges WHERE period = 1996 AND relation = 'customer')
    AND e.partner_id IN (SELECT corp_code FROM reports WHERE n_chars > 2000) GROUP BY 1""",
)
def _(t):
    hubs = t.edges.filter("period = 1996 AND relation = 'customer'").select(F.col("corp_code").alias("mapped_code"))
    proven = t.reports.filter("n_chars > 2000").select(F.col("corp_code").alias("partner_id"))
    rows = t.edges.join(t.mapping.filter("is_listed"), "partner_name").join(hubs, "mapped_code", "left_anti").join(proven, "partner_id", "left_semi")
    return rows.groupBy("partner_name").agg(F.count_distinct("corp_code").alias("reporters"))


@query(
    "join_target_scrape",
    """SELECT corp_code, hm_url FROM companies c WHERE stock_code IS NOT NULL AND EXISTS (SELECT 1 FROM leads l WHERE l.corp_code = c.corp_code AND l.status = 'new')
    AND NOT EXISTS (SELECT 1 FROM contacts k WHERE k.corp_code = c.corp_code AND k.email LIKE 'ir@%') AND NOT EXISTS (SELECT 1 FROM news w WHERE w.corp_code = c.corp_code)""",
)
def _(t):
    rows = t.companies.filter("stock_code IS NOT NULL").join(t.leads.filter("status = 'new'"), "corp_code", "left_semi")
    rows = rows.join(t.contacts.filter("email LIKE 'ir@%'"), "corp_code", "left_anti").join(t.news, "corp_code", "left_anti")
    return rows.select("corp_code", "hm_url")


@query(
    "join_stage_todo",
    """SELECT 'detect' AS stage, count(*) AS n FROM comparisons c WHERE status = 'ok' AND NOT EXISTS (SELECT 1 FROM leads l WHERE l.comparison_id = c.id)
    UNION ALL SELECT 'draft', count(*) FROM leads l WHERE status = 'new' AND NOT EXISTS (SELECT 1 FROM drafts d WHERE d.lead_id = l.id)
    UNION ALL SELECT 'questionnaire', count(*) FROM drafts d WHERE NOT EXISTS (SELECT 1 FROM questionnaires q WHERE q.draft_id = d.draft_id)""",
)
def _(t):
    todo = lambda stage, df: df.agg(n()).select(F.lit(stage).alias("stage"), "n")
    detect = t.comparisons.filter("status = 'ok'").join(t.leads.select(F.col("comparison_id").alias("id")), "id", "left_anti")
    draft = t.leads.filter("status = 'new'").join(t.drafts.select(F.col("lead_id").alias("id")), "id", "left_anti")
    ask = t.drafts.join(t.questionnaires.select("draft_id"), "draft_id", "left_anti")
    return todo("detect", detect).unionByName(todo("draft", draft)).unionByName(todo("questionnaire", ask))


@query("join_latest_per_key", "SELECT corp_code, fiscal_year, revenue, total_equity FROM (SELECT *, row_number() OVER (PARTITION BY corp_code ORDER BY fiscal_year DESC) AS rank FROM financials) WHERE rank = 1")
def _(t):
    return pick_first(t.financials.select("corp_code", "fiscal_year", "revenue", "total_equity"), ["corp_code"], -F.col("fiscal_year"))


@query("join_latest_q_per_corp", "SELECT corp_code, status, max(q_id) AS q_id FROM questionnaires GROUP BY 1, 2")
def _(t):
    return t.questionnaires.groupBy("corp_code", "status").agg(F.max("q_id").alias("q_id"))


@query("join_news_corp", "SELECT l.id AS lead_id, w.id AS news_id, w.tier FROM leads l JOIN news w USING (corp_code) WHERE w.tier IN ('T1', 'T2', 'RESEARCH')")
def _(t):
    chosen = t.news.filter(F.col("tier").isin("T1", "T2", "RESEARCH")).select(F.col("id").alias("news_id"), "corp_code", "tier")
    return t.leads.select(F.col("id").alias("lead_id"), "corp_code").join(chosen, "corp_code").drop("corp_code")


@query(
    "join_two_table_any",
    """SELECT DISTINCT a.q_id, b.q_id AS blocked_by FROM questionnaires a JOIN questionnaires b ON a.q_id <> b.q_id AND (a.corp_code = b.corp_code OR a.lead_id // 100000000 = b.lead_id // 100000000)
    AND b.status = 'sent' AND b.created_at BETWEEN a.created_at - INTERVAL 24 HOUR AND a.created_at""",
)
def _(t):
    a = t.questionnaires.withColumn("line", F.expr("lead_id div 100000000"))
    b = a.filter("status = 'sent'").select(F.col("q_id").alias("blocked_by"), F.col("corp_code").alias("b_corp"), F.col("line").alias("b_line"), F.col("created_at").alias("b_at"))
    near = (F.col("q_id") != F.col("blocked_by")) & F.col("b_at").between(F.col("created_at") - F.expr("INTERVAL 24 HOURS"), F.col("created_at"))
    by = lambda own, other: a.join(b, (F.col(own) == F.col(other)) & near).select("q_id", "blocked_by")
    return by("corp_code", "b_corp").union(by("line", "b_line")).distinct()  # two equi-joins in place of an OR


SUFFIXES = [("example.com", "BLOG"), ("example.org", "T2"), ("blog.therat.example.net", "T1"), ("example.net", "RESEARCH")]


@query(
    "join_domain_suffix",
    f"""SELECT id, host, outlet FROM (SELECT w.id, w.host, m.outlet, row_number() OVER (PARTITION BY w.id ORDER BY length(m.domain) DESC NULLS LAST) AS rank FROM news w
    LEFT JOIN (VALUES {", ".join(map(str, SUFFIXES))}) m(domain, outlet) ON w.host = m.domain OR w.host LIKE '%.' || m.domain) WHERE rank = 1""",
)
def _(t):
    media = t.spark.createDataFrame(SUFFIXES, "domain string, outlet string")
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hits = t.news.select("id", "host", F.explode(tails).alias("domain")).join(media, "domain")
    best = hits.groupBy("id").agg(F.max_by("outlet", F.length("domain")).alias("outlet"))
    return t.news.select("id", "host").join(best, "id", "left")


@query(
    "join_email_domain",
    """SELECT c.id, coalesce(v.corp_code, h.corp_code) AS corp_code FROM contacts c LEFT JOIN (SELECT domain, corp_code FROM (SELECT split_part(email, '@', 2) AS domain, corp_code, row_number() OVER (PARTITION BY split_part(email, '@', 2) ORDER BY count(*) DESC, corp_code) AS rank
    FROM contacts WHERE email LIKE '%@%' GROUP BY 1, 2) WHERE rank = 1) v ON v.domain = split_part(c.email, '@', 2) LEFT JOIN companies h ON lower(replace(c.person, '#', '-')) = regexp_extract(h.hm_url, 'www\\.([^.]+)', 1)""",
)
def _(t):
    domain = F.split_part("email", F.lit("@"), F.lit(2))
    votes = t.contacts.filter("email LIKE '%@%'").groupBy(domain.alias("domain"), "corp_code").agg(n())
    voted = votes.groupBy("domain").agg(F.min_by("corp_code", F.struct(-F.col("n"), "corp_code")).alias("voted"))
    homes = t.companies.select(F.regexp_extract("hm_url", r"www\.([^.]+)", 1).alias("root"), F.col("corp_code").alias("home"))
    rows = t.contacts.select("id", domain.alias("domain"), F.lower(F.replace("person", F.lit("#"), F.lit("-"))).alias("root"))
    return rows.join(voted, "domain", "left").join(homes, "root", "left").select("id", F.coalesce("voted", "home").alias("corp_code"))


@query(
    "join_company_cascade",
    """SELECT id, least(CASE WHEN s.corp_code IS NOT NULL THEN 1 ELSE 9 END, CASE WHEN x.corp_code IS NOT NULL THEN 2 ELSE 9 END, 3) AS level, coalesce(s.corp_code, x.corp_code) AS corp_code FROM contacts c
    LEFT JOIN (SELECT stock_code, min(corp_code) AS corp_code FROM companies WHERE stock_code IS NOT NULL GROUP BY 1) s ON s.stock_code = lpad(c.id::VARCHAR, 6, '0') LEFT JOIN (SELECT corp_name, min(corp_code) AS corp_code FROM companies GROUP BY 1) x ON x.corp_name = c.person""",
)
def _(t):
    stock = t.companies.filter("stock_code IS NOT NULL").groupBy("stock_code").agg(F.min("corp_code").alias("by_stock"))
    name = t.companies.groupBy(F.col("corp_name").alias("person")).agg(F.min("corp_code").alias("by_name"))
    rows = t.contacts.withColumn("stock_code", F.lpad(F.col("id").cast("string"), 6, "0")).join(stock, "stock_code", "left").join(name, "person", "left")
    level = F.when(F.col("by_stock").isNotNull(), 1).when(F.col("by_name").isNotNull(), 2).otherwise(3)
    return rows.select("id", level.alias("level"), F.coalesce("by_stock", "by_name").alias("corp_code"))


@query(
    "join_hint_company",
    """SELECT h.hint, coalesce(e.corp_code, p.corp_code) AS corp_code FROM (SELECT DISTINCT substr(title, 6) AS hint FROM leads) h LEFT JOIN (SELECT ltrim(substr(corp_name, 10), '0') AS hint, min(corp_code) AS corp_code FROM companies GROUP BY 1) e USING (hint)
    LEFT JOIN (SELECT right(corp_name, 2) AS tail, min(corp_code) AS corp_code FROM companies GROUP BY 1) p ON p.tail = right(h.hint, 2)""",
)
def _(t):
    hints = t.leads.select(F.expr("substring(title, 6)").alias("hint")).distinct()
    exact = t.companies.groupBy(F.expr("ltrim('0', substring(corp_name, 10))").alias("hint")).agg(F.min("corp_code").alias("exact"))
    part = t.companies.groupBy(F.right("corp_name", F.lit(2)).alias("tail")).agg(F.min("corp_code").alias("part"))
    rows = hints.withColumn("tail", F.right("hint", F.lit(2))).join(exact, "hint", "left").join(part, "tail", "left")
    return rows.select("hint", F.coalesce("exact", "part").alias("corp_code"))


@query("join_verified_articles", "SELECT doc_id, source, quality FROM articles a WHERE quality = 1 AND coalesce(toxic, 0) = 0 AND EXISTS (SELECT 1 FROM news w WHERE w.id = a.doc_id)")
def _(t):
    return t.articles.filter("quality = 1 AND coalesce(toxic, 0) = 0").join(t.news.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "source", "quality")


@query(
    "join_industry_name",
    """WITH codes AS (SELECT DISTINCT substr(partner_name, 10, k) AS code, k FROM edges, range(6, 10) r(k) WHERE relation = 'customer') SELECT c.corp_code, coalesce(a.code, b.code, d.code, e.code) AS code FROM companies c
    LEFT JOIN codes a ON a.k = 9 AND a.code = substr(c.corp_name, 10, 9) LEFT JOIN codes b ON b.k = 8 AND b.code = substr(c.corp_name, 10, 8) LEFT JOIN codes d ON d.k = 7 AND d.code = substr(c.corp_name, 10, 7) LEFT JOIN codes e ON e.k = 6 AND e.code = substr(c.corp_name, 10, 6)""",
)
def _(t):
    codes = t.edges.filter("relation = 'customer'").select(F.explode(F.transform(F.sequence(F.lit(6), F.lit(9)), lambda k: F.substring(F.col("partner_name"), F.lit(10), k))).alias("code")).distinct()
    rows = t.companies.select("corp_code", "corp_name")
    for k in (9, 8, 7, 6):  # the longest prefix that has a name
        rows = rows.join(codes.filter(F.length("code") == k).withColumnRenamed("code", f"c{k}"), F.substring("corp_name", 10, k) == F.col(f"c{k}"), "left")
    return rows.select("corp_code", F.coalesce("c9", "c8", "c7", "c6").alias("code"))


@query("join_entity_lookup", "SELECT corp_code, corp_name, stock_code FROM companies WHERE stock_code = '000042' OR corp_name ILIKE '%customer#00000004%' ORDER BY length(corp_name), corp_code LIMIT 20")
def _(t):
    hits = t.companies.filter((F.col("stock_code") == "000042") | F.col("corp_name").ilike("%customer#00000004%"))
    return hits.orderBy(F.length("corp_name"), "corp_code").limit(20).select("corp_code", "corp_name", "stock_code")


# Sets


@query("set_orphans", "SELECT DISTINCT report_type FROM reports EXCEPT SELECT DISTINCT type_b FROM comparisons")
def _(t):
    return t.reports.select("report_type").subtract(t.comparisons.select(F.col("type_b").alias("report_type")))


@query("set_intersect_n", "SELECT corp_code, count(*) AS edges FROM edges WHERE partner_id IN (1, 2, 3) GROUP BY 1 HAVING count(DISTINCT partner_id) = 3")
def _(t):
    rows = t.edges.filter(F.col("partner_id").isin(1, 2, 3)).groupBy("corp_code").agg(n("edges"), F.count_distinct("partner_id").alias("p"))
    return rows.filter("p = 3").select("corp_code", "edges")


@query(
    "set_union_signals",
    """SELECT corp_code, source, latest FROM (SELECT *, row_number() OVER (PARTITION BY corp_code ORDER BY prio, latest DESC) AS rank FROM (SELECT corp_code, 'lead' AS source, 1 AS prio, max(created_at) AS latest FROM leads WHERE severity = 5 GROUP BY 1
    UNION ALL SELECT corp_code, 'event', 2, max(ts) FROM disclosures GROUP BY 1 UNION ALL SELECT corp_code, 'report', 3, max(analyzed_at) FROM comparisons GROUP BY 1)) WHERE rank = 1""",
)
def _(t):
    leads = t.leads.filter("severity = 5").groupBy("corp_code").agg(F.max("created_at").alias("latest")).select("corp_code", F.lit("lead").alias("source"), F.lit(1).alias("prio"), "latest")
    events = t.disclosures.groupBy("corp_code").agg(F.max("ts").alias("latest")).select("corp_code", F.lit("event").alias("source"), F.lit(2).alias("prio"), "latest")
    compared = t.comparisons.groupBy("corp_code").agg(F.max("analyzed_at").alias("latest")).select("corp_code", F.lit("report").alias("source"), F.lit(3).alias("prio"), "latest")
    return pick_first(leads.unionByName(events).unionByName(compared), ["corp_code"], F.col("prio")).drop("prio")


@query("set_token_overlap", f"SELECT doc_id, round(len(list_intersect(a, b)) / len(a)::DOUBLE, 6) AS overlap FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower({parted.EVIDENCE_SQL}), '[a-z]{{3,}}')) AS a, list_distinct(regexp_extract_all(lower({parted.REST_SQL}), '[a-z]{{3,}}')) AS b FROM documents) WHERE len(a) > 0")
def _(t):
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0)))
    lead, rest = parted.parted()
    rows = t.documents.select("doc_id", words(lead).alias("a"), words(rest).alias("b")).filter(F.size("a") > 0)
    return rows.select("doc_id", F.round(F.size(F.array_intersect("a", "b")) / F.size("a"), 6).alias("overlap"))


@query("set_missing_tokens", f"SELECT doc_id, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS missing FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower({parted.EVIDENCE_SQL}), '[a-z]{{3,}}')) AS a, list_distinct(regexp_extract_all(lower({parted.REST_SQL}), '[a-z]{{3,}}')) AS b FROM documents)")
def _(t):
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0)))
    return t.documents.select("doc_id", F.size(F.array_except(*map(words, parted.parted()))).cast("long").alias("missing"))


# Windows and per-key sequences


@query("win_last_two_periods", "SELECT DISTINCT corp_code, period, k FROM (SELECT corp_code, period, dense_rank() OVER (PARTITION BY corp_code ORDER BY period DESC) AS k FROM edges) WHERE k <= 2")
def _(t):
    periods = t.edges.select("corp_code", "period").distinct()
    return top_per_key(periods, ["corp_code"], 2, F.desc("period"), rank="k")


@query("win_first_last_period", "SELECT corp_code, min(period) AS first_period, max(period) AS last_period FROM edges GROUP BY 1")
def _(t):
    return t.edges.groupBy("corp_code").agg(F.min("period").alias("first_period"), F.max("period").alias("last_period"))


def by_year():
    return Window.partitionBy("corp_code").orderBy("fiscal_year")


@query("win_yoy", "SELECT corp_code, fiscal_year, round((revenue - p) * 100.0::DOUBLE / nullif(abs(p), 0), 6) AS yoy FROM (SELECT *, lag(revenue) OVER (PARTITION BY corp_code ORDER BY fiscal_year) AS p FROM financials)")
def _(t):
    p = F.lag("revenue").over(by_year())
    return t.financials.withColumn("p", p).select("corp_code", "fiscal_year", F.round(F.try_divide((F.col("revenue") - F.col("p")) * 100.0, F.abs("p")), 6).alias("yoy"))


@query("win_three_year_cycle", "SELECT corp_code, fiscal_year FROM (SELECT corp_code, fiscal_year, inventory AS c, lag(inventory) OVER w AS b, lag(inventory, 2) OVER w AS a FROM financials WINDOW w AS (PARTITION BY corp_code ORDER BY fiscal_year)) WHERE b > a AND c < b")
def _(t):
    rows = t.financials.select("corp_code", "fiscal_year", "inventory", F.lag("inventory").over(by_year()).alias("b"), F.lag("inventory", 2).over(by_year()).alias("a"))
    return rows.filter("b > a AND inventory < b").select("corp_code", "fiscal_year")


@query("win_latest_n", "SELECT corp_code, fiscal_year, rank FROM (SELECT corp_code, fiscal_year, row_number() OVER (PARTITION BY corp_code ORDER BY fiscal_year DESC) AS rank FROM financials) WHERE rank <= 3")
def _(t):
    return top_per_key(t.financials.select("corp_code", "fiscal_year"), ["corp_code"], 3, F.desc("fiscal_year"))


def direction(column: str):
    """1, 0 or -1: change on the year before, with a dead band of two per cent; null if unknown."""
    p = F.lag(column).over(by_year())
    change = F.try_divide((F.col(column) - p) * 100.0, F.abs(p))
    return F.when(change > 2, 1).when(change < -2, -1).when(change.isNotNull(), 0)


DIRECTION_SQL = "CASE WHEN ({0} - lag({0}) OVER w) * 100.0::DOUBLE / nullif(abs(lag({0}) OVER w), 0) > 2 THEN 1 WHEN ({0} - lag({0}) OVER w) * 100.0::DOUBLE / nullif(abs(lag({0}) OVER w), 0) < -2 THEN -1 WHEN lag({0}) OVER w <> 0 THEN 0 END"


@query(
    "win_direction",
    f"SELECT corp_code, fiscal_year, coalesce({', '.join(DIRECTION_SQL.format(c) for c in ('operating_income', 'net_income', 'revenue'))}) AS direction FROM financials WINDOW w AS (PARTITION BY corp_code ORDER BY fiscal_year)",
)
def _(t):
    return t.financials.select("corp_code", "fiscal_year", F.coalesce(direction("operating_income"), direction("net_income"), direction("revenue")).alias("direction"))


@query(
    "win_keyword_timeline",
    """SELECT corp_code, CASE WHEN last > 0 AND before = 0 THEN 'NEW' WHEN last > 0 AND last > best THEN 'EXPANDING' WHEN last > 0 THEN 'EXISTING' WHEN before > 0 THEN 'REMOVED' ELSE 'UNKNOWN' END AS pattern
    FROM (SELECT corp_code, arg_max(n, period) AS last, sum(n) - arg_max(n, period) AS before, coalesce(max(n) FILTER (WHERE k > 1), 0) AS best FROM (SELECT corp_code, period, count(*) FILTER (WHERE relation = 'customer') AS n,
    row_number() OVER (PARTITION BY corp_code ORDER BY period DESC) AS k FROM edges GROUP BY 1, 2) GROUP BY 1)""",
)
def _(t):
    per = t.edges.groupBy("corp_code", "period").agg(F.count_if(F.col("relation") == "customer").alias("n"))
    line = per.groupBy("corp_code").agg(F.array_sort(F.collect_list(F.struct("period", "n"))).alias("s"))
    counts = F.transform("s", lambda x: x["n"])
    last, past = F.element_at(counts, -1), F.slice(counts, 1, F.size(counts) - 1)
    before = F.coalesce(F.array_max(past), F.lit(0))
    pattern = F.when((last > 0) & (before == 0), "NEW").when((last > 0) & (last > before), "EXPANDING").when(last > 0, "EXISTING").when(before > 0, "REMOVED").otherwise("UNKNOWN")
    return line.select("corp_code", pattern.alias("pattern"))


@query("win_priority_pick", "SELECT corp_code, (['risk', 'strategy', 'supply', 'market', 'numeric'])[min(list_position(['risk', 'strategy', 'supply', 'market', 'numeric'], lead_type))] AS pick FROM leads GROUP BY 1")
def _(t):
    order = F.array(*map(F.lit, ("risk", "strategy", "supply", "market", "numeric")))
    return t.leads.groupBy("corp_code").agg(F.min(F.array_position(order, F.col("lead_type"))).alias("p")).select("corp_code", F.element_at(order, F.col("p").cast("int")).alias("pick"))


@query("win_topk_per_group", "SELECT tier, id, rank FROM (SELECT tier, id, row_number() OVER (PARTITION BY corp_code % 7, tier ORDER BY published_at DESC NULLS LAST, id) AS rank FROM news) WHERE rank <= 5")
def _(t):
    rows = t.news.withColumn("g", F.col("corp_code") % 7)
    return top_per_key(rows, ["g", "tier"], 5, F.desc_nulls_last("published_at"), F.col("id")).select("tier", "id", "rank")


@query("win_dedup_first", "SELECT host, min(id) AS id FROM news GROUP BY 1")
def _(t):
    return pick_first(t.news.select("host", "id"), ["host"], F.col("id"))


@query("win_rank_entities", "SELECT partner_name, n, row_number() OVER (ORDER BY n DESC, partner_name) AS rank, coalesce(is_listed, false) AS is_listed FROM (SELECT partner_name, count(*) AS n FROM edges GROUP BY 1 ORDER BY n DESC, partner_name LIMIT 10) LEFT JOIN mapping USING (partner_name)")
def _(t):
    top = t.edges.groupBy("partner_name").agg(n()).orderBy(F.desc("n"), "partner_name").limit(10)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "partner_name"))  # over ten rows
    return top.withColumn("rank", rank).join(t.mapping.select("partner_name", "is_listed"), "partner_name", "left").select("partner_name", "n", "rank", F.coalesce("is_listed", F.lit(False)).alias("is_listed"))


@query("win_preferred_report", "SELECT corp_code, id FROM (SELECT corp_code, id, row_number() OVER (PARTITION BY corp_code ORDER BY CASE WHEN report_type LIKE '%annual' THEN 0 WHEN report_type LIKE '%h1' THEN 1 ELSE 2 END, id) AS rank FROM reports) WHERE rank = 1")
def _(t):
    prio = F.when(F.col("report_type").endswith("annual"), 0).when(F.col("report_type").endswith("h1"), 1).otherwise(2)
    return t.reports.groupBy("corp_code").agg(F.min(F.struct(prio.alias("p"), "id")).alias("m")).select("corp_code", "m.id")


@query("win_longest_text", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank = 1")
def _(t):
    return t.documents.groupBy("source").agg(F.min(F.struct(-F.col("n_chars"), "doc_id")).alias("m")).select("source", "m.doc_id")


@query("win_chunk50", "SELECT sector, corp_code, ((row_number() OVER (PARTITION BY sector ORDER BY corp_name, corp_code) - 1) // 50)::INT AS chunk FROM companies")
def _(t):
    from tessera.operators.relational import chunk

    return chunk(t.companies, ["sector"], 50, F.col("corp_name"), F.col("corp_code")).select("sector", "corp_code", "chunk")


# Sorting and paging


@query("srt_page", "SELECT id, corp_code FROM leads ORDER BY severity DESC, created_at DESC, id LIMIT 20 OFFSET 40")
def _(t):
    from tessera.operators.relational import page

    return page(t.leads, 40, 20, F.desc("severity"), F.desc("created_at"), F.col("id")).select("id", "corp_code")


@query("srt_nulls_last", "SELECT draft_id, score FROM drafts ORDER BY score DESC NULLS LAST, draft_id LIMIT 30")
def _(t):
    return t.drafts.orderBy(F.desc_nulls_last("score"), "draft_id").limit(30).select("draft_id", "score")


RANK_SQL = "CASE confidence WHEN 'verified' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 9 END"


def confidence_rank():
    c = F.col("confidence")
    return F.when(c == "verified", 0).when(c == "high", 1).when(c == "medium", 2).when(c == "low", 3).otherwise(9)


@query("srt_case_rank", f"SELECT id, confidence, {RANK_SQL} AS rank FROM contacts ORDER BY rank, id LIMIT 50")
def _(t):
    return t.contacts.select("id", "confidence", confidence_rank().alias("rank")).orderBy("rank", "id").limit(50)


@query("prj_case_conf", f"SELECT id, {RANK_SQL} AS rank, CASE WHEN user_verified = 1 THEN 'user' ELSE confidence END AS shown FROM contacts")
def _(t):
    return t.contacts.select("id", confidence_rank().alias("rank"), F.when(F.col("user_verified") == 1, "user").otherwise(F.col("confidence")).alias("shown"))


@query("srt_nocase", "SELECT id, corp_name FROM reports ORDER BY corp_name = '', lower(corp_name), id LIMIT 40")
def _(t):
    return t.reports.orderBy(F.col("corp_name") == "", F.lower("corp_name"), "id").limit(40).select("id", "corp_name")


@query("srt_coalesce_ts", "SELECT id, coalesce(published_at, DATE '2023-07-01') AS day FROM news ORDER BY day DESC, id LIMIT 40")
def _(t):
    return t.news.select("id", F.coalesce("published_at", F.lit("2023-07-01").cast("date")).alias("day")).orderBy(F.desc("day"), "id").limit(40)


@query("srt_multi_desc", "SELECT id FROM leads ORDER BY severity DESC, signal_count DESC, id DESC LIMIT 60")
def _(t):
    return t.leads.orderBy(F.desc("severity"), F.desc("signal_count"), F.desc("id")).limit(60).select("id")


@query(
    "srt_merge_signals",
    """SELECT corp_code, source, score FROM (SELECT corp_code, 'lead' AS source, max(severity) * 20 AS score FROM leads GROUP BY 1 UNION ALL SELECT corp_code, 'event', least(100, count(*)) FROM disclosures GROUP BY 1
    UNION ALL SELECT corp_code, 'hub', least(100, 2 * count(DISTINCT partner_name)) FROM edges GROUP BY 1) ORDER BY score DESC, corp_code, source LIMIT 100""",
)
def _(t):
    lead = t.leads.groupBy("corp_code").agg((F.max("severity") * 20).cast("long").alias("score")).withColumn("source", F.lit("lead"))
    event = t.disclosures.groupBy("corp_code").agg(F.least(F.lit(100), F.count("*")).alias("score")).withColumn("source", F.lit("event"))
    hub = t.edges.groupBy("corp_code").agg(F.least(F.lit(100), 2 * F.count_distinct("partner_name")).alias("score")).withColumn("source", F.lit("hub"))
    return lead.unionByName(event).unionByName(hub).orderBy(F.desc("score"), "corp_code", "source").limit(100)


# Filters


@query("flt_dynamic_and", f"SELECT id FROM leads WHERE status = 'new' AND severity >= 3 AND lead_type = 'risk' AND title ILIKE '%1%'")
def _(t):
    wanted = {"status": F.col("status") == "new", "severity": F.col("severity") >= 3, "lead_type": F.col("lead_type") == "risk", "q": F.col("title").ilike("%1%")}
    df = t.leads
    for condition in wanted.values():
        df = df.filter(condition)
    return df.select("id")


@query("flt_like_multi", "SELECT corp_code FROM companies WHERE corp_name ILIKE '%99%' OR sector ILIKE '%build%' OR nation ILIKE '%_1'")
def _(t):
    return t.companies.filter(F.col("corp_name").ilike("%99%") | F.col("sector").ilike("%build%") | F.col("nation").ilike("%_1")).select("corp_code")


@query("flt_like_nocase", "SELECT corp_code FROM companies WHERE lower(sector) = 'machinery'")
def _(t):
    return t.companies.filter(F.collate("sector", "UTF8_LCASE") == "machinery").select("corp_code")


@query("flt_has_content", "SELECT id FROM reports WHERE length(coalesce(raw_text, '')) > 0 OR length(coalesce(biz_content, '')) > 0")
def _(t):
    has = lambda c: F.length(F.coalesce(c, F.lit(""))) > 0
    return t.reports.filter(has("raw_text") | has("biz_content")).select("id")


@query("flt_min_length", "SELECT doc_id FROM documents WHERE length(text) >= 500")
def _(t):
    return t.documents.filter(F.length("text") >= 500).select("doc_id")


@query("flt_glob", "SELECT id, rcept_dt FROM reports WHERE regexp_matches(rcept_dt, '^2[0-9]{7}')")
def _(t):
    return t.reports.filter(F.col("rcept_dt").rlike("^2[0-9]{7}")).select("id", "rcept_dt")


@query("flt_in_list", "SELECT id FROM leads WHERE corp_code IN (SELECT corp_code FROM companies WHERE market = 'ASIA')")
def _(t):
    return t.leads.join(t.companies.filter("market = 'ASIA'"), "corp_code", "left_semi").select("id")


@query("flt_placeholder_email", "SELECT id, email FROM contacts WHERE substr(email, 1, 1) <> '_'")
def _(t):
    return t.contacts.filter(F.substring("email", 1, 1) != "_").select("id", "email")


@query("flt_sendable_contact", "SELECT id FROM contacts WHERE email IS NOT NULL AND substr(email, 1, 1) <> '_' AND is_active AND coalesce(bounced_count, 0) < 3")
def _(t):
    from tessera.functions.contact import sendable

    return t.contacts.filter(sendable()).select("id")


@query("flt_recent_days", f"SELECT id FROM news WHERE published_at IS NULL OR published_at >= DATE '{AS_OF}' - 90")
def _(t):
    return t.news.filter(F.col("published_at").isNull() | (F.col("published_at") >= F.date_sub(F.lit(AS_OF).cast("date"), 90))).select("id")


@query("flt_today_yesterday", "SELECT report_type, count(*) FILTER (WHERE ts::DATE = DATE '2024-01-30') AS today, count(*) FILTER (WHERE ts::DATE = DATE '2024-01-29') AS yesterday FROM disclosures WHERE ts >= '2024-01-29' GROUP BY 1")
def _(t):
    day = lambda d: F.count_if(F.to_date("ts") == F.lit(d).cast("date"))
    return t.disclosures.filter("ts >= '2024-01-29'").groupBy("report_type").agg(day("2024-01-30").alias("today"), day("2024-01-29").alias("yesterday"))


@query("flt_status_gate", "SELECT draft_id FROM drafts WHERE status IN ('approved', 'sent', 'replied')")
def _(t):
    return t.drafts.filter(F.col("status").isin("approved", "sent", "replied")).select("draft_id")


@query("prj_preview", "SELECT id, substr(coalesce(raw_text, biz_content, ''), 1, 4) AS preview, length(coalesce(raw_text, '')) AS n_raw, biz_content IS NOT NULL AS has_biz FROM reports")
def _(t):
    return t.reports.select("id", F.substring(F.coalesce("raw_text", "biz_content", F.lit("")), 1, 4).alias("preview"), F.length(F.coalesce("raw_text", F.lit(""))).cast("long").alias("n_raw"), F.col("biz_content").isNotNull().alias("has_biz"))


@query("prj_mask", "SELECT id, CASE WHEN starts_with(email, '_phone:') THEN '' ELSE email END AS email FROM contacts")
def _(t):
    return t.contacts.select("id", F.when(F.col("email").startswith("_phone:"), "").otherwise(F.col("email")).alias("email"))
