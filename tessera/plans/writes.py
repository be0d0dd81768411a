"""Write-side semantics: upserts, syncs, merges and promotions, each as the table that it leaves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import relational as R
from tessera.plans.registry import query


def base(t):
    return t.contacts.filter("id % 3 <> 0").select("id", "email", "confidence", "bounced_count")


def incoming(t):
    """Half of it new, half of it known; some blanks."""
    return t.contacts.filter("id % 2 = 0").select(
        "id", F.when(F.col("id") % 4 == 0, "").otherwise(F.concat(F.lit("new-"), F.col("id").cast("string"))).alias("email"), F.lit("import").alias("confidence"), (F.col("id") % 5).cast("int").alias("bounced_count")
    )


BASE = "b AS (SELECT id, email, confidence, bounced_count FROM contacts WHERE id % 3 <> 0), i AS (SELECT id, CASE WHEN id % 4 = 0 THEN '' ELSE 'new-' || id END AS email, 'import' AS confidence, (id % 5)::INT AS bounced_count FROM contacts WHERE id % 2 = 0)"


@query("upsert_overwrite", f"WITH {BASE} SELECT * FROM i UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM i)")
def _(t):
    return R.upsert_overwrite(base(t), incoming(t), ["id"])


@query("insert_replace", f"WITH {BASE} SELECT * FROM i WHERE id % 4 = 0 UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM i WHERE id % 4 = 0)")
def _(t):
    return R.upsert_overwrite(base(t), incoming(t).filter("id % 4 = 0"), ["id"])


@query("upsert_error_keep", f"WITH {BASE} SELECT id, coalesce(b.email, i.email) AS email, CASE WHEN i.id IS NOT NULL THEN i.confidence ELSE b.confidence END AS confidence FROM b FULL JOIN i USING (id)".replace("coalesce(b.email, i.email)", "CASE WHEN b.confidence IS NOT NULL THEN b.email ELSE i.email END").replace("i.id IS NOT NULL", "i.confidence IS NOT NULL"))
def _(t):
    return R.upsert_merge(base(t), incoming(t), ["id"], {"email": "old", "confidence": "new"})


@query("upsert_coalesce", f"WITH {BASE} SELECT id, coalesce(nullif(i.email, ''), b.email) AS email, coalesce(nullif(i.confidence, ''), b.confidence) AS confidence FROM b FULL JOIN i USING (id)")
def _(t):
    return R.upsert_merge(base(t), incoming(t), ["id"], {"email": "fill_new", "confidence": "fill_new"})


@query("upsert_keep_old", f"WITH {BASE} SELECT id, coalesce(nullif(b.email, ''), i.email) AS email, coalesce(nullif(b.confidence, ''), i.confidence) AS confidence FROM b FULL JOIN i USING (id)")
def _(t):
    return R.upsert_merge(base(t), incoming(t), ["id"], {"email": "fill_old", "confidence": "fill_old"})


@query("upsert_max", f"WITH {BASE} SELECT id, greatest(b.confidence, i.confidence) AS confidence, greatest(b.bounced_count, i.bounced_count) AS bounced_count FROM b FULL JOIN i USING (id)")
def _(t):
    return R.upsert_merge(base(t), incoming(t), ["id"], {"confidence": "greatest", "bounced_count": "greatest"})


@query("insert_ignore", "SELECT corp_code, lead_type, id FROM (SELECT corp_code, lead_type, id, row_number() OVER (PARTITION BY corp_code, lead_type ORDER BY id) AS rank FROM leads WHERE status = 'new') WHERE rank = 1 AND (corp_code, lead_type) NOT IN (SELECT (corp_code, lead_type) FROM leads WHERE status = 'used') UNION ALL SELECT corp_code, lead_type, min(id) FROM leads WHERE status = 'used' GROUP BY 1, 2")
def _(t):
    keys = ["corp_code", "lead_type"]
    stored = R.pick_first(t.leads.filter("status = 'used'").select(*keys, "id"), keys, F.col("id"))
    return R.insert_ignore(stored, t.leads.filter("status = 'new'").select(*keys, "id"), keys, F.col("id"))


@query("running_avg_upsert", "SELECT corp_code, round(avg(signal_count), 6) AS avg_signal, count(*) AS n, round(list_reduce(list(severity::DOUBLE ORDER BY created_at, id), lambda a, b: (a + b) / 2), 6) AS quality FROM leads GROUP BY 1")
def _(t):
    history = F.array_sort(F.collect_list(F.struct("created_at", "id", F.col("severity").cast("double").alias("q"))))
    per = t.leads.groupBy("corp_code").agg(F.round(F.avg("signal_count"), 6).alias("avg_signal"), F.count("*").alias("n"), history.alias("h"))
    quality = F.aggregate(F.slice("h", F.lit(2), F.greatest(F.size("h") - 1, F.lit(0))), F.element_at("h", 1)["q"], lambda a, x: (a + x["q"]) / 2)
    return per.select("corp_code", "avg_signal", "n", F.round(quality, 6).alias("quality"))


@query("rule_sync_3way", "WITH r AS (SELECT partner_name AS code, match_type FROM mapping WHERE mapped_code IS NULL OR mapped_code % 4 <> 0), s AS (SELECT partner_name AS code, CASE WHEN coalesce(mapped_code, 1) % 3 = 0 THEN 'stale' ELSE match_type END AS match_type FROM mapping WHERE coalesce(mapped_code, 2) % 5 <> 0) SELECT code, CASE WHEN s.match_type IS NULL THEN 'add' WHEN r.match_type IS NULL THEN 'deactivate' WHEN r.match_type = s.match_type THEN 'keep' ELSE 'update' END AS action FROM r FULL JOIN s USING (code)")
def _(t):
    m = t.mapping.withColumnRenamed("partner_name", "code")
    rules = m.filter("mapped_code IS NULL OR mapped_code % 4 <> 0")
    stored = m.filter("coalesce(mapped_code, 2) % 5 <> 0").withColumn("match_type", F.when(F.coalesce("mapped_code", F.lit(1)) % 3 == 0, "stale").otherwise(F.col("match_type")))
    return R.sync(rules, stored, "code", ["match_type"])


@query("alias_sync", "SELECT lower(a) AS name, min(mapped_code) AS corp_code FROM (SELECT mapped_code, unnest([partner_name, replace(partner_name, 'Supplier#', 'S')]) AS a FROM mapping) WHERE mapped_code IS NOT NULL GROUP BY 1")
def _(t):
    names = F.concat(F.array("partner_name"), F.array(F.replace("partner_name", F.lit("Supplier#"), F.lit("S"))))
    rows = t.mapping.filter("mapped_code IS NOT NULL").select("mapped_code", F.explode(names).alias("a"))
    return rows.groupBy(F.lower("a").alias("name")).agg(F.min("mapped_code").alias("corp_code"))


@query("normalise_partner_merge", "SELECT corp_code, relation, canonical, count(*) AS merged, min(id) AS id FROM (SELECT *, CASE WHEN partner_id % 10 = 9 THEN 'Supplier group 9' ELSE partner_name END AS canonical FROM edges) GROUP BY 1, 2, 3")
def _(t):
    variants = t.mapping.select("partner_name").filter("partner_name LIKE '%9'").withColumn("to", F.lit("Supplier group 9"))
    rows = t.edges.join(variants, "partner_name", "left").withColumn("canonical", F.coalesce("to", "partner_name"))
    return rows.groupBy("corp_code", "relation", "canonical").agg(F.count("*").alias("merged"), F.min("id").alias("id"))


@query("soft_delete", "SELECT id, is_active AND id % 10 <> 0 AS is_active FROM contacts")
def _(t):
    return t.contacts.select("id", (F.col("is_active") & (F.col("id") % 10 != 0)).alias("is_active"))


@query("bulk_apply_reviews", "SELECT d.draft_id, array_to_string(list_distinct_ordered, '|') AS questions FROM (SELECT draft_id, list_concat(['why'], CASE WHEN score % 2 = 0 THEN ['how'] ELSE [] END, ['when']) AS list_distinct_ordered FROM drafts WHERE score >= 60) d")
def _(t):
    have = F.array(F.lit("why"))
    suggested = F.when(F.col("score") % 2 == 0, F.array(F.lit("why"), F.lit("how"), F.lit("when"))).otherwise(F.array(F.lit("when"), F.lit("why")))
    return t.drafts.filter("score >= 60").select("draft_id", F.array_join(F.array_distinct(F.concat(have, suggested)), "|").alias("questions"))


@query("promote_contact", f"WITH {BASE} SELECT id, email FROM i WHERE email <> '' AND bounced_count = 0 UNION ALL SELECT id, email FROM b WHERE id NOT IN (SELECT id FROM i WHERE email <> '' AND bounced_count = 0)")
def _(t):
    ready = incoming(t).filter("email <> '' AND bounced_count = 0").select("id", "email")
    return R.upsert_overwrite(base(t).select("id", "email"), ready, ["id"])


@query("rebuild_table", "SELECT partner_name, count(*) AS n, max(period) AS last_period FROM edges GROUP BY 1")
def _(t):
    return t.edges.groupBy("partner_name").agg(F.count("*").alias("n"), F.max("period").alias("last_period"))


@query("dedup_on_conflict_delete", "SELECT id, new_code FROM (SELECT id, id % 300 AS new_code, row_number() OVER (PARTITION BY id % 300, confidence ORDER BY id % 300 = corp_code DESC, id) AS rank FROM contacts) WHERE rank = 1")
def _(t):
    rows = t.contacts.select("id", "corp_code", "confidence", (F.col("id") % 300).alias("new_code"))
    # a row whose key the update would give twice goes; the one that already has it stays
    kept = R.pick_first(rows, ["new_code", "confidence"], F.when(F.col("new_code") == F.col("corp_code"), 0).otherwise(1), F.col("id"))
    return kept.select("id", "new_code")


# What sinks write


@query("sink_json_api", "SELECT lead_type, count(*) AS total, min(id) AS first_id FROM leads WHERE severity >= 3 GROUP BY 1")
def _(t):
    return t.leads.filter("severity >= 3").groupBy("lead_type").agg(F.count("*").alias("total"), F.min("id").alias("first_id"))


@query("sink_csv_export", "SELECT id, person, CASE WHEN email IS NULL THEN '' ELSE email END AS email FROM contacts WHERE email IS NULL OR substr(email, 1, 1) <> '_'")
def _(t):
    from tessera.sources.sinks import contact_export

    return contact_export(t.contacts).select("id", "person", "email")


@query("sink_index_json", "SELECT corp_code, count(*) AS reports, sum(n_chars)::BIGINT AS chars, min(id) AS first_id FROM reports GROUP BY 1")
def _(t):
    from tessera.sources.sinks import report_index

    return report_index(t.reports).select("corp_code", F.size("reports").cast("long").alias("reports"), "chars", F.element_at("reports", 1)["id"].alias("first_id"))


@query("sink_sector_files", "SELECT sector, chunk, count(*) AS companies, min(corp_name) AS first_name FROM (SELECT sector, corp_name, ((row_number() OVER (PARTITION BY sector ORDER BY corp_name, corp_code) - 1) // 50)::INT AS chunk FROM companies) GROUP BY 1, 2")
def _(t):
    rows = R.chunk(t.companies, ["sector"], 50, F.col("corp_name"), F.col("corp_code"))
    return rows.groupBy("sector", "chunk").agg(F.count("*").alias("companies"), F.min("corp_name").alias("first_name"))


@query("sink_keyword_md", "SELECT partner_name, '- ' || partner_name || ' (' || count(*) || ')' AS line FROM edges GROUP BY 1 HAVING count(*) >= 2")
def _(t):
    per = t.edges.groupBy("partner_name").agg(F.count("*").alias("n")).filter("n >= 2")
    return per.select("partner_name", F.format_string("- %s (%d)", "partner_name", "n").alias("line"))


@query("sink_sector_json", "SELECT sector, relation, count(*) AS n FROM edges JOIN companies USING (corp_code) GROUP BY 1, 2")
def _(t):
    return t.edges.join(t.companies, "corp_code").groupBy("sector", "relation").agg(F.count("*").alias("n"))


@query("sink_txt_tree", "SELECT lang, source, count(*) AS texts, sum(length(text))::BIGINT AS chars FROM documents WHERE length(text) < 2000 AND NOT contains(text, chr(10)) GROUP BY 1, 2")
def _(t):
    from tessera.sources.sinks import round_trip, write_text_tree

    rows = t.documents.filter(r"length(text) < 2000 AND NOT contains(text, '\n')")
    tree = round_trip(rows, lambda df, path: write_text_tree(df, path, ["lang", "source"]), lambda spark, path: spark.read.text(path))
    return tree.groupBy("lang", "source").agg(F.count("*").alias("texts"), F.sum(F.length("value")).alias("chars"))


@query("sink_jsonl", "SELECT report_type, id, n_chars FROM reports WHERE n_chars > 3000")
def _(t):
    from tessera.sources.sinks import round_trip, write_jsonl

    rows = t.reports.filter("n_chars > 3000").select("report_type", "id", "n_chars")
    return round_trip(rows, lambda df, path: write_jsonl(df, path, ["report_type"]), lambda spark, path: spark.read.schema("id LONG, n_chars LONG, report_type STRING").json(path))
