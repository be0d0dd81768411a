"""Lead detection and scoring, source matching, article verification and contacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import contact, numbers, text
from tessera.functions.contact import sendable
from tessera.operators import leads as L
from tessera.operators import verification as V
from tessera.operators.citations import uncited_phrases
from tessera.operators.lineage import cut
from tessera.operators.postings import first_keywords
from tessera.operators.relational import pick_first, top_per_key
from tessera.plans import drafted, parted
from tessera.plans.registry import query
from tessera.plans.text import BODY_SQL, CHANGE_SQL, CITED, HEADLINE_SQL, NEWS_STEPS, NUMBERED, SIGNATURE_SQL, SIGNED, SPECULATIVE, WITH_UNITS_SQL, changes_of_leads, uncited_sql, with_units
from tessera.sources.adapters import AS_OF
from tessera.streaming import jobs
from tessera.streaming.jobs import FIELDS


def n(name: str = "n"):
    return F.count("*").alias(name)


#: rule code, lead type, severity, keywords, exclusions, wanted context, least evidence
RULES = [
    ("R1", "strategy", 4, ["tion", "thtion"], ["heed"], [], 10),
    ("R2", "risk", 5, ["worthless", "pathetic"], [], ["and", "the"], 20),
    ("R3", "strategy", 3, ["licensed"], [], [], 5),
    ("R4", "market", 2, ["eau"], ["xyz"], ["que"], 10),
]

EVIDENCE_SQL = "substr(array_to_string(list_filter(list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]'), lambda s: trim(s, ' ')), lambda s: length(s) > 0), lambda s: contains(lower(s), kw[1])), '. '), 1, 300)"
LEADS_SQL = f"""rules AS (SELECT * FROM (VALUES {", ".join(map(str, RULES))}) r(rule_code, lead_type, severity, keywords, excluded, context, least)),
hit AS (SELECT doc_id, source, rule_code, lead_type, severity, excluded, context, least, text, list_filter(keywords, lambda k: contains(lower(text), k)) AS kw FROM documents, rules),
seen AS (SELECT *, {EVIDENCE_SQL} AS evidence FROM hit WHERE len(kw) > 0),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lead_type ORDER BY rule_code) AS rank FROM seen WHERE length(evidence) >= least AND len(list_filter(excluded, lambda x: contains(lower(evidence), x))) = 0
  AND (len(context) = 0 OR len(list_filter(context, lambda x: contains(lower(text), x))) > 0)),
detected AS (SELECT doc_id, source, lead_type, rule_code, severity, array_to_string(kw, '|') AS keywords, evidence FROM kept WHERE rank = 1)"""


def rules(t):
    return t.spark.createDataFrame(RULES, "rule_code string, lead_type string, severity int, keywords array<string>, excluded array<string>, context array<string>, least int")


@query("l_detect_leads", f"WITH {LEADS_SQL} SELECT * FROM detected")
def _(t):
    return L.detect(t.documents, rules(t)).withColumn("keywords", F.array_join("keywords", "|"))


@query("src_alert_rules", f"SELECT rule_code, lead_type, severity, len(keywords)::INT AS n_keywords FROM (VALUES {', '.join(map(str, RULES))}) r(rule_code, lead_type, severity, keywords, excluded, context, least)")
def _(t):
    return rules(t).select("rule_code", "lead_type", "severity", F.size("keywords").alias("n_keywords"))


UNIQUE_SQL = f"""SELECT doc_id, len(cand) AS n, CASE WHEN len(cand) = 0 THEN 60 ELSE len(list_filter(cand, lambda w: NOT contains(past, lower(w[2])))) * 100 // len(cand) END::INT AS score FROM
    (SELECT doc_id, (list_reverse_sort(list_transform(list_distinct(regexp_extract_all({parted.EVIDENCE_SQL}, '[A-Za-z]{{4,}}')), lambda w: (length(w), w))))[1:10] AS cand, lower({parted.REST_SQL}) AS past FROM documents)"""


def lead_and_past():
    """The tables hold no lead's evidence of its own: a text's sentences with the key word stand for it, the others for the texts before it."""
    lead, past = parted.parted()
    return lead, F.lower(past)


@query(
    "l_novelty",
    f"""WITH a AS (SELECT doc_id, source, (len(regexp_extract_all(text, 'tion')) + len(regexp_extract_all(text, 'new'))) AS fresh, len(regexp_extract_all(text, 'heed')) AS gone FROM documents),
    b AS (SELECT *, CASE WHEN fresh + gone >= 5 THEN 95 WHEN fresh + gone >= 3 THEN 80 WHEN fresh + gone >= 1 THEN 65 ELSE 30 END AS ai, sum(fresh) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM a),
    c AS (SELECT *, CASE WHEN fresh > 0 AND coalesce(past, 0) = 0 THEN 95 WHEN fresh > 0 AND fresh > 5 THEN 70 WHEN fresh > 0 THEN 30 WHEN past > 0 THEN 85 ELSE 50 END AS kw FROM b)
    SELECT doc_id, kw, ai, ev, trunc(kw * 0.4::DOUBLE + ai * 0.3::DOUBLE + ev * 0.3::DOUBLE)::INT AS score, CASE WHEN score >= 70 THEN 'A/B' WHEN score >= 50 THEN 'C' ELSE 'D' END AS grade FROM c JOIN (SELECT doc_id, score AS ev FROM ({UNIQUE_SQL})) USING (doc_id)""",
)
def _(t):
    rows = L.novelty(t.documents, ["tion", "new"], ["heed"], *lead_and_past())
    return rows.withColumn("grade", F.when(F.col("score") >= 70, "A/B").when(F.col("score") >= 50, "C").otherwise("D"))


@query("l_evidence_unique", UNIQUE_SQL)
def _(t):
    rows = t.documents.select("doc_id", text.sentences(F.col("text")).alias("parts"))  # a text is cut into sentences once
    lead, past = parted.parts_of(F.col("parts"))
    rows = rows.select("doc_id", L.longest_words(lead).alias("words"), F.lower(past).alias("past"))
    return rows.select("doc_id", F.size("words").cast("long").alias("n"), L.unique_share(F.col("words"), F.col("past")).alias("score"))


@query("l_change_class", f"""SELECT id, change, CASE WHEN sector IS NULL THEN 'UNKNOWN' WHEN others >= 5 THEN 'INDUSTRY' WHEN others >= 2 THEN 'MIXED' ELSE 'INDIVIDUAL' END AS scope
    FROM (SELECT id, change, sector, count(*) OVER (PARTITION BY sector, change) - 1 AS others FROM ({CHANGE_SQL}) LEFT JOIN companies USING (corp_code))""")
def _(t):
    rows = cut(changes_of_leads(t).join(t.companies.select("corp_code", "sector"), "corp_code", "left").select("id", "change", "sector"))  # read twice, classified once
    # Counted apart and joined back, so that a large class is a row a task and not a window.
    size = rows.groupBy("sector", "change").agg((F.count("*") - 1).alias("others"))
    scope = F.when(F.col("sector").isNull(), "UNKNOWN").when(F.col("others") >= 5, "INDUSTRY").when(F.col("others") >= 2, "MIXED").otherwise("INDIVIDUAL")
    return rows.join(size, ["sector", "change"], "left").select("id", "change", scope.alias("scope"))


ARTICLE_STEPS, HUB_STEPS = [(0, 100), (1, 80), (3, 60), (5, 40)], [(0, 100), (2, 80), (5, 60), (15, 40), (50, 20)]
SIZE_STEPS = [(1000, 100), (3000, 85), (5000, 65), (7000, 45), (9000, 25)]


GAP_SQL = f"""SELECT corp_code, trunc({numbers.ladder_sql("coalesce(w.n, 0)", NEWS_STEPS, 10)} * 0.4::DOUBLE + CASE WHEN equity <= 0 THEN 60 ELSE {numbers.ladder_sql("equity", SIZE_STEPS, 10)} END * 0.2::DOUBLE
    + {numbers.ladder_sql("coalesce(d.n, 0)", ARTICLE_STEPS, 20)} * 0.2::DOUBLE + {numbers.ladder_sql("coalesce(e.n, 0)", HUB_STEPS, 10)} * 0.2::DOUBLE)::INT AS score, coalesce(w.n, 0) AS news, coalesce(d.n, 0) AS drafts, coalesce(e.n, 0) AS named
    FROM companies c LEFT JOIN (SELECT corp_code, count(*) AS n FROM news GROUP BY 1) w USING (corp_code) LEFT JOIN (SELECT corp_code, count(*) AS n FROM drafts GROUP BY 1) d USING (corp_code)
    LEFT JOIN (SELECT partner_id AS corp_code, count(*) AS n FROM edges GROUP BY 1) e USING (corp_code)"""


def info_gap(t):
    """How little is known of each company: few news (40 %), a small size, few drafts and few that name it (20 % each)."""
    count = lambda df, key, name: df.groupBy(F.col(key).alias("corp_code")).agg(n(name))
    rows = t.companies.join(count(t.news, "corp_code", "news"), "corp_code", "left").join(count(t.drafts, "corp_code", "drafts"), "corp_code", "left").join(count(t.edges, "partner_id", "named"), "corp_code", "left")
    rows = rows.fillna(0, ["news", "drafts", "named"])
    size = F.when(F.col("equity") <= 0, 60).otherwise(numbers.ladder(F.col("equity"), SIZE_STEPS, 10))
    score = numbers.ladder(F.col("news"), NEWS_STEPS, 10) * 0.4 + size * 0.2 + numbers.ladder(F.col("drafts"), ARTICLE_STEPS, 20) * 0.2 + numbers.ladder(F.col("named"), HUB_STEPS, 10) * 0.2
    return rows.select("corp_code", score.cast("int").alias("score"), "news", "drafts", "named")


@query("l_info_gap", GAP_SQL)
def _(t):
    return info_gap(t)


RECENCY_SQL = f"CASE WHEN abs(DATE '{AS_OF}' - published_at) <= 30 THEN 1.0 WHEN abs(DATE '{AS_OF}' - published_at) <= 60 THEN 0.85 WHEN abs(DATE '{AS_OF}' - published_at) <= 90 THEN 0.7 WHEN abs(DATE '{AS_OF}' - published_at) <= 180 THEN 0.5 ELSE 0.3 END::DOUBLE"
_TOKENS = "list_distinct(list_concat(regexp_extract_all({0}, '[가-힣]{{2,}}'), list_transform(regexp_extract_all({0}, '[A-Za-z]{{3,}}'), lambda w: lower(w))))".format
#: A lead's keywords: the first five terms of its company's document, which stands for its evidence.
WORDS_SQL = f"list_sort({_TOKENS('text')})[1:5]"
MATCH_SQL = f"""SELECT l.id AS lead_id, w.id AS news_id, w.tier, coalesce(array_to_string(list_filter(keywords, lambda k: contains(lower(w.title), k)), '|'), '') AS matched,
    round((len(list_filter(coalesce(keywords, []), lambda k: contains(lower(w.title), k)))::DOUBLE / greatest(1, len(coalesce(keywords, [])))) * 0.5::DOUBLE + w.weight * 0.3::DOUBLE + {RECENCY_SQL} * 0.2::DOUBLE, 3) AS score
    FROM leads l JOIN news w USING (corp_code) LEFT JOIN (SELECT doc_id AS corp_code, {WORDS_SQL} AS keywords FROM documents) k USING (corp_code) WHERE w.tier IN ('T1', 'T2', 'RESEARCH')"""


def matched(t):
    sources = t.news.filter(F.col("tier").isin("T1", "T2", "RESEARCH")).select(F.col("id").alias("news_id"), "corp_code", "tier", "weight", "published_at", F.lower("title").alias("shown"))
    words = t.documents.select(F.col("doc_id").alias("corp_code"), first_keywords(F.col("text")).alias("keywords"))
    # a company's news are scored once, and not again for each of its leads
    scored = L.match_score(sources.join(words, "corp_code", "left"), F.lit(AS_OF).cast("date"))
    return t.leads.select(F.col("id").alias("lead_id"), "corp_code").join(scored, "corp_code")


@query("l_match_sources", MATCH_SQL)
def _(t):
    return matched(t).select("lead_id", "news_id", "tier", F.array_join("matched", "|").alias("matched"), "score")


@query("l_news_status", "SELECT corp_code, CASE WHEN coalesce(n, 0) = 0 THEN 'exclusive' WHEN n <= 2 THEN 'partial' ELSE 'covered' END AS status FROM companies LEFT JOIN (SELECT corp_code, count(*) AS n FROM news GROUP BY 1) USING (corp_code)")
def _(t):
    rows = t.companies.join(t.news.groupBy("corp_code").agg(n()), "corp_code", "left")
    return rows.select("corp_code", F.when(F.coalesce("n", F.lit(0)) == 0, "exclusive").when(F.col("n") <= 2, "partial").otherwise("covered").alias("status"))


#: Parts of the scores of an article (plans/drafted.py) in SQL.
_SOME = lambda pool, test: f"len(list_filter({pool}, lambda v: {test})) > 0"
_COMMON = "[" + ", ".join(f"'{w}'" for w in V.COMMON) + "]"
_UNCOMMON = lambda c: f"list_filter({_TOKENS(c)}, lambda w: NOT list_contains({_COMMON}, w))"
_SHARE = lambda part, whole, factor: f"trunc(least(({part})::DOUBLE / ({whole}) * {factor}, 100.0::DOUBLE))::INT"
_SAID = lambda words: " + ".join(f"(length(body) - length(replace(body, '{w}', ''))) // {len(w)}" for w in words)
_MOVED = lambda c: f"""CASE WHEN last[1].{c} IS NULL OR last[2].{c} IS NULL THEN NULL WHEN last[2].{c} = 0 THEN CASE WHEN last[1].{c} > 0 THEN 'up' WHEN last[1].{c} < 0 THEN 'down' ELSE 'flat' END
    WHEN (last[1].{c} - last[2].{c})::DOUBLE / abs(last[2].{c}) > 0.02::DOUBLE THEN 'up' WHEN (last[1].{c} - last[2].{c})::DOUBLE / abs(last[2].{c}) < -0.02::DOUBLE THEN 'down' ELSE 'flat' END"""  # noqa: E731
NUMERIC_SQL = f"CASE WHEN amounts IS NULL THEN 50 WHEN len(found) = 0 THEN 70 ELSE {_SHARE(f'len(list_filter(found, lambda x: {_SOME("list_concat(amounts, ratios)", numbers.agrees_sql("x.value", "x.per_cent", "v"))}))', 'len(found)', 100)} END"
SAYS_SQL = f"CASE WHEN {_SAID(V.UP)} > ({_SAID(V.DOWN)}) * 1.3::DOUBLE THEN 'up' WHEN {_SAID(V.DOWN)} > ({_SAID(V.UP)}) * 1.3::DOUBLE THEN 'down' ELSE 'mixed' END"
DIRECTION_SQL = f"CASE WHEN coalesce(len(last), 0) < 2 OR moved IS NULL THEN 70 WHEN says = 'mixed' THEN 75 WHEN says = moved THEN 100 ELSE 30 END"
EVIDENCE_SQL = f"CASE WHEN length(evidence) < 30 OR len(told) = 0 THEN 70 ELSE {_SHARE(f'len(list_filter(told, lambda w: list_contains({_TOKENS("body")}, w)))', 'len(told)', 200)} END"
GROUNDING_SQL = f"CASE WHEN len(named) = 0 THEN 80 ELSE {_SHARE(f'len(list_filter(named, lambda w: list_contains({_TOKENS("source")}, w)))', 'len(named)', 120)} END"
SCORES_SQL = f"""SELECT draft_id, body, source, amounts, ratios, found, {NUMERIC_SQL} AS numeric, {DIRECTION_SQL} AS direction, {EVIDENCE_SQL} AS evidence, {GROUNDING_SQL} AS grounding FROM (
    SELECT *, ai || ' ' || biz AS source, {numbers.lex_sql("body")} AS found, coalesce({", ".join(map(_MOVED, ("operating_income", "net_income", "revenue")))}) AS moved, {SAYS_SQL} AS says,
    {_UNCOMMON("evidence")} AS told, list_filter({_UNCOMMON("body")}, lambda w: length(w) >= 4) AS named FROM ({drafted.ARTICLES_SQL}))"""


def scores(t):
    """draft_id and the four scores of its article, with what they were made of."""
    rows = drafted.articles(t).withColumns({"found": numbers.lex(F.col("body")), "source": F.concat_ws(" ", "ai", "biz")})
    c = F.col
    return rows.select(
        "draft_id", "body", "source", "amounts", "ratios", V.numeric_score(c("found"), c("amounts"), c("ratios")).alias("numeric"), V.direction_score(c("body"), c("last")).alias("direction"),
        V.evidence_score(c("body"), c("evidence")).alias("evidence"), V.grounding_score(c("body"), c("source")).alias("grounding"),
    )


_NEAR_SQL = _SOME("coalesce(amounts, [])", "v > 1e6 AND abs(v - x.value) / greatest(v, x.value) <= 0.05::DOUBLE")
_POINTS_SQL = _SOME("coalesce(ratios, [])", "abs(v - x.value) <= 2.0::DOUBLE")


CHECK_SQL = f"""SELECT draft_id, trunc(CASE WHEN len(found) = 0 THEN 100 ELSE {_SHARE(f'len(list_filter(found, lambda x: CASE WHEN x.per_cent THEN {_POINTS_SQL} ELSE x.value > 0 AND {_NEAR_SQL} END))', 'len(found)', 100)} END * 0.6::DOUBLE
      + CASE WHEN len(nouns) = 0 THEN 100.0::DOUBLE ELSE len(list_filter(nouns, lambda w: contains(source, w)))::DOUBLE / len(nouns) * 100 END * 0.4::DOUBLE)::INT AS score FROM (SELECT draft_id, amounts, ratios, lower(source) AS source, found, list_distinct(list_concat(regexp_extract_all(body, '[가-힣]{{3,}}'), list_transform(regexp_extract_all(body, '[A-Za-z]{{4,}}'), lambda w: lower(w)))) AS nouns FROM ({SCORES_SQL}))"""


def checked(t):
    """draft_id, corp_code and how far the draft's article holds against figures and sources."""
    c = F.col
    return drafted.articles(t).select("draft_id", "corp_code", V.cross_check(c("body"), c("amounts"), c("ratios"), F.concat_ws(" ", "ai", "biz")).alias("score"))


@query("l_cross_check", CHECK_SQL)
def _(t):
    return checked(t).select("draft_id", "score")


@query("l_decide_tier", f"""SELECT draft_id, tier, score, CASE WHEN tier = 'T1' THEN CASE WHEN score >= 70 THEN 'PASS' WHEN score >= 50 THEN 'PARTIAL' ELSE 'FAIL' END WHEN tier = 'T2' THEN CASE WHEN score >= 80 THEN 'PASS' WHEN score >= 60 THEN 'PARTIAL' ELSE 'FAIL' END
    WHEN tier IN ('T3', 'UNKNOWN') AND score >= 80 THEN 'PARTIAL' ELSE 'FAIL' END AS decision FROM (SELECT x.draft_id, coalesce(w.tier, 'UNKNOWN') AS tier, x.score FROM ({CHECK_SQL}) x JOIN drafts d USING (draft_id) LEFT JOIN (SELECT corp_code, arg_min(tier, id) AS tier FROM news GROUP BY 1) w ON w.corp_code = d.corp_code)""")
def _(t):
    outlet = t.news.groupBy("corp_code").agg(F.min_by("tier", "id").alias("tier"))  # the outlet that cites the company
    rows = checked(t).join(outlet, "corp_code", "left").withColumn("tier", F.coalesce("tier", F.lit("UNKNOWN")))
    return rows.select("draft_id", "tier", "score", L.decide(F.col("tier"), F.col("score")).alias("decision"))


# Verification of articles


@query("v_numeric", f"SELECT draft_id, numeric AS score FROM ({SCORES_SQL})")
def _(t):
    return scores(t).select("draft_id", F.col("numeric").alias("score"))


@query("v_direction", f"SELECT draft_id, direction AS score FROM ({SCORES_SQL})")
def _(t):
    return scores(t).select("draft_id", F.col("direction").alias("score"))


COVER_SQL = "SELECT doc_id, CASE WHEN len(w) {few} THEN {otherwise} ELSE least(100, len(list_filter(w, lambda x: contains(body, lower(x)))) * {factor} // len(w)) END::INT AS score FROM (SELECT doc_id, list_distinct(regexp_extract_all({head}, '{pattern}')) AS w, lower({body}) AS body FROM documents)"


def cover(t, words, few, otherwise: int, factor: int):
    """The share of the lead's words, a function of its evidence, that the rest of the text contains."""
    lead, past = lead_and_past()
    rows = t.documents.select("doc_id", F.array_distinct(words(lead)).alias("w"), past.alias("body"))
    found = F.size(F.filter("w", lambda x: F.contains(F.col("body"), F.lower(x))))
    return rows.select("doc_id", F.when(few(F.size("w")), otherwise).otherwise(F.least(F.lit(100), F.floor(F.try_divide(found * factor, F.size("w"))))).cast("int").alias("score"))


@query("v_evidence", COVER_SQL.format(few="< 3", otherwise=70, factor=200, head=f"lower({parted.EVIDENCE_SQL})", body=parted.REST_SQL, pattern="[a-z]{3,}"))
def _(t):
    return cover(t, lambda lead: text.find_all(F.lower(lead), "[a-z]{3,}"), lambda k: k < 3, 70, 200)


@query("v_grounding", COVER_SQL.format(few="= 0", otherwise=80, factor=120, head=parted.EVIDENCE_SQL, body=parted.REST_SQL, pattern="[A-Z][a-z]{3,}"))
def _(t):
    return cover(t, lambda lead: text.find_all(lead, "[A-Z][a-z]{3,}"), lambda k: k == 0, 80, 120)


@query("v_total", f"""SELECT *, CASE WHEN total >= 80 THEN 'SAFE' WHEN total >= 65 THEN 'LOW' WHEN total >= 50 THEN 'MEDIUM' ELSE 'HIGH' END AS flag FROM (SELECT draft_id, numeric, direction, evidence, grounding,
    trunc(numeric * 0.30::DOUBLE + direction * 0.25::DOUBLE + evidence * 0.25::DOUBLE + grounding * 0.20::DOUBLE)::INT AS total FROM ({SCORES_SQL}))""")
def _(t):
    parts = ["numeric", "direction", "evidence", "grounding"]
    return L.flag(scores(t).select("draft_id", *parts, V.total(*map(F.col, parts)).alias("total")), "total")


_HEAD_WORDS = f"list_distinct(regexp_extract_all(lower({HEADLINE_SQL}), '[a-z]{{3,}}'))"
_NAMED = f"list_distinct(regexp_extract_all({parted.EVIDENCE_SQL}, '[A-Z][a-z]{{3,}}'))"


@query(
    "v_postprocess",
    f"""SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(0, least(100, 100 - (100 - head) // 2 - spec * 8 - CASE WHEN nums >= 5 THEN (nums - 4) * 3 ELSE 0 END - greatest(0, floor((60 - known) / 2)))) END::INT AS score FROM (
    SELECT doc_id, text, s.n AS spec, m.n AS nums, CASE WHEN len(w) = 0 THEN 100 ELSE len(list_filter(w, lambda x: contains(body, x))) * 100 // len(w) END AS head,
      CASE WHEN len(e) = 0 THEN 100.0::DOUBLE ELSE round(len(list_filter(e, lambda x: contains(rest, lower(x))))::DOUBLE / len(e) * 100, 1) END AS known
    FROM (SELECT doc_id, text, {_HEAD_WORDS} AS w, lower({BODY_SQL}) AS body, {_NAMED} AS e, lower({parted.REST_SQL}) AS rest FROM documents)
    JOIN ({uncited_sql("SELECT doc_id, text FROM documents", SPECULATIVE)}) s USING (doc_id) JOIN ({uncited_sql(f"SELECT doc_id, {WITH_UNITS_SQL} AS text FROM documents", NUMBERED)}) m USING (doc_id))""",
)
def _(t):
    parts = text.sentences(F.col("text"))
    evidence, rest = parted.parted()
    body = F.lower(F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), ". "))
    rows = t.documents.select(
        "doc_id", "text", F.array_distinct(text.find_all(F.lower(F.get(parts, F.lit(0))), "[a-z]{3,}")).alias("w"), body.alias("body"), F.array_distinct(text.find_all(evidence, "[A-Z][a-z]{3,}")).alias("e"), F.lower(rest).alias("rest"),
        F.size(uncited_phrases(SPECULATIVE, CITED)(F.col("text"))).alias("spec"), F.size(uncited_phrases(NUMBERED, CITED)(with_units(F.col("text")))).alias("nums"),
    )
    words = lambda w: F.coalesce(w, F.array().cast("array<string>"))
    head = F.when(F.size(words("w")) == 0, 100).otherwise(F.floor(F.try_divide(F.size(F.filter("w", lambda x: F.contains("body", x))) * 100, F.size("w"))))
    known = F.when(F.size(words("e")) == 0, 100.0).otherwise(F.round(F.try_divide(F.size(F.filter("e", lambda x: F.contains("rest", F.lower(x)))).cast("double"), F.size("e")) * 100, 1))
    return rows.select("doc_id", V.postprocess_score(F.col("text"), head, F.col("spec"), F.col("nums"), known).alias("score"))


# News


#: Words of titles that speak of a sector; sectors that news never relates.
SECTOR_WORDS = {"AUTOMOBILE": ["tion", "heed"], "BUILDING": ["ing"], "HOUSEHOLD": ["eau", "sch"], "MACHINERY": ["the"], "FURNITURE": ["ent"]}
NEVER_RELATED = ["MACHINERY", "FURNITURE"]
_PAIRS, _NEVER = ", ".join(str((s, w)) for s, words in SECTOR_WORDS.items() for w in words), ", ".join(f"'{s}'" for s in NEVER_RELATED)


@query(
    "n_related_stocks",
    f"""WITH w AS (SELECT id, corp_code AS named, list_distinct(regexp_extract_all(lower(title), '[a-z]{{3,}}')) AS words FROM news),
    known AS (SELECT id, named AS corp_code, 100 AS score, 'direct' AS reason FROM w UNION ALL SELECT DISTINCT w.id, e.corp_code, 60, 'supply chain' FROM w JOIN edges e ON e.partner_id = w.named WHERE e.corp_code <> w.named),
    said AS (SELECT id, sector, count(*) AS n FROM (SELECT id, unnest(words) AS x FROM w) JOIN (VALUES {_PAIRS}) k(sector, word) ON contains(x, word) OR contains(word, x) WHERE sector NOT IN ({_NEVER}) GROUP BY 1, 2),
    top AS (SELECT id, sector FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, sector) AS k FROM said) WHERE k <= 3),
    scores AS (SELECT * FROM known UNION ALL SELECT t.id, c.corp_code, 30, 'sector' FROM top t JOIN companies c USING (sector) WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.id = t.id AND k.corp_code = c.corp_code)),
    summed AS (SELECT id, corp_code, sum(score)::BIGINT AS score, string_agg(reason, '|' ORDER BY reason) AS reasons FROM scores GROUP BY 1, 2)
    SELECT id, corp_code, score, reasons, rank FROM (SELECT s.*, row_number() OVER (PARTITION BY id ORDER BY score DESC, corp_name, corp_code) AS rank FROM summed s JOIN companies USING (corp_code) WHERE sector NOT IN ({_NEVER})) WHERE rank <= 20""",
)
def _(t):
    news = t.news.select("id", F.col("corp_code").alias("named"), F.array_distinct(text.find_all(F.lower("title"), "[a-z]{3,}")).alias("words"))
    return L.related_companies(news, t.edges, t.companies, SECTOR_WORDS, NEVER_RELATED).withColumn("reasons", F.array_join("reasons", "|"))


@query("n_supply_related", "SELECT id, corp_code, relation FROM (SELECT w.id, e.corp_code, e.relation, row_number() OVER (PARTITION BY w.id, e.corp_code ORDER BY e.id) AS rank FROM news w JOIN edges e ON e.partner_id = w.corp_code WHERE w.tier = 'T2') WHERE rank = 1")
def _(t):
    rows = t.news.filter("tier = 'T2'").select(F.col("id").alias("news_id"), F.col("corp_code").alias("partner_id")).join(t.edges.select("partner_id", "corp_code", "relation", "id"), "partner_id")
    first = pick_first(rows.select("news_id", "corp_code", "relation", "id"), ["news_id", "corp_code"], F.col("id"))
    return first.select(F.col("news_id").alias("id"), "corp_code", "relation")


@query("p_briefing_pick", "SELECT id FROM leads ORDER BY CASE WHEN news_status IS NULL THEN 0 ELSE 1 END, severity DESC, created_at DESC, id LIMIT 8")
def _(t):
    return t.leads.orderBy(F.when(F.col("news_status").isNull(), 0).otherwise(1), F.desc("severity"), F.desc("created_at"), "id").limit(8).select("id")


@query(
    "p_quality_context",
    f"""SELECT d.draft_id, coalesce(q.n, 0) AS questions, coalesce(w.n, 0) AS news, coalesce(w.titles, '') AS titles, coalesce(f.years, '') AS years, coalesce(b.excerpt, '') AS excerpt FROM drafts d LEFT JOIN (SELECT draft_id, count(*) AS n FROM questionnaires GROUP BY 1) q USING (draft_id)
    LEFT JOIN (SELECT corp_code, count(*) AS n, string_agg(title, '|' ORDER BY k) AS titles FROM (SELECT corp_code, title, row_number() OVER (PARTITION BY corp_code ORDER BY published_at DESC, id) AS k FROM news WHERE published_at >= DATE '{AS_OF}' - 60) WHERE k <= 8 GROUP BY 1) w USING (corp_code)
    LEFT JOIN (SELECT corp_code, string_agg(fiscal_year, '|' ORDER BY k) AS years FROM (SELECT corp_code, fiscal_year, row_number() OVER (PARTITION BY corp_code ORDER BY fiscal_year DESC) AS k FROM financials) WHERE k <= 4 GROUP BY 1) f USING (corp_code)
    LEFT JOIN (SELECT corp_code, substr(arg_max(biz_content, (rcept_dt, id)), 1, 200) AS excerpt FROM reports WHERE biz_content IS NOT NULL GROUP BY 1) b USING (corp_code)""",
)
def _(t):
    asked = t.questionnaires.groupBy("draft_id").agg(n("questions"))
    fresh = t.news.filter(F.col("published_at") >= F.date_sub(F.lit(AS_OF).cast("date"), 60)).select("corp_code", "title", "published_at", "id")
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", c))), lambda x: x[c].cast("string")), "|")
    news = top_per_key(fresh, ["corp_code"], 8, F.desc("published_at"), F.col("id")).groupBy("corp_code").agg(n("news"), in_order("title").alias("titles"))
    years = top_per_key(t.financials.select("corp_code", "fiscal_year"), ["corp_code"], 4, F.desc("fiscal_year")).groupBy("corp_code").agg(in_order("fiscal_year").alias("years"))
    filed = t.reports.filter("biz_content IS NOT NULL").groupBy("corp_code").agg(F.substring(F.max_by("biz_content", F.struct("rcept_dt", "id")), 1, 200).alias("excerpt"))
    rows = t.drafts.select("draft_id", "corp_code").join(asked, "draft_id", "left").join(news, "corp_code", "left").join(years, "corp_code", "left").join(filed, "corp_code", "left")
    return rows.fillna(0, ["questions", "news"]).fillna("", ["titles", "years", "excerpt"]).select("draft_id", "questions", "news", "titles", "years", "excerpt")


# Contacts


@query("c_email_priority", "SELECT id, CASE WHEN email LIKE 'ir@%' THEN 1 WHEN email LIKE 'info@%' THEN 2 WHEN email LIKE 'sales@%' THEN 3 ELSE 9 END AS priority FROM contacts WHERE email LIKE '%@%'")
def _(t):
    e = F.col("email")
    return t.contacts.filter("email LIKE '%@%'").select("id", F.when(e.startswith("ir@"), 1).when(e.startswith("info@"), 2).when(e.startswith("sales@"), 3).otherwise(9).alias("priority"))


@query("c_best_contact", """SELECT corp_code, id FROM (SELECT corp_code, id, row_number() OVER (PARTITION BY corp_code ORDER BY user_verified DESC, CASE confidence WHEN 'verified' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 9 END, id) AS rank
    FROM (SELECT * FROM contacts UNION ALL SELECT * REPLACE (id + 1000000000 AS id, corp_code - corp_code % 4 AS corp_code) FROM contacts) WHERE email IS NOT NULL AND substr(email, 1, 1) <> '_' AND is_active AND coalesce(bounced_count, 0) < 3) WHERE rank = 1""")
def _(t):
    from tessera.plans.joins import confidence_rank

    shared = t.contacts.withColumns({"id": F.col("id") + 1000000000, "corp_code": F.col("corp_code") - F.col("corp_code") % 4})  # some companies have several
    rows = t.contacts.unionByName(shared).filter(sendable()).select("corp_code", "id", "user_verified", confidence_rank().alias("c"))
    return pick_first(rows, ["corp_code"], -F.col("user_verified"), F.col("c"), F.col("id")).select("corp_code", "id")


@query("c_domain_match", "SELECT c.id, h.corp_code AS matched, CASE WHEN h.corp_code = c.corp_code THEN c.confidence ELSE 'domain' END AS confidence FROM contacts c JOIN (SELECT regexp_extract(hm_url, 'www\\.([^/]+)', 1) AS domain, min(corp_code) AS corp_code FROM companies GROUP BY 1) h ON h.domain = split_part(c.email, '@', 2)")
def _(t):
    homes = t.companies.groupBy(F.regexp_extract("hm_url", r"www\.([^/]+)", 1).alias("domain")).agg(F.min("corp_code").alias("matched"))
    rows = t.contacts.withColumn("domain", F.split_part("email", F.lit("@"), F.lit(2))).join(homes, "domain")
    return rows.select("id", "matched", F.when(F.col("matched") == F.col("corp_code"), F.col("confidence")).otherwise("domain").alias("confidence"))


_FIRST = lambda f: f"arg_min({f}, (sent_at, msg_id)) FILTER (WHERE direction = 'inbound' AND {f} IS NOT NULL) AS {f}"


@query(
    "r_reply_learn",
    f"""SELECT thread_id, count(*) FILTER (WHERE direction = 'inbound') AS replies, round(avg((epoch_us(sent_at) - epoch_us(sent)) / 86400000000.0::DOUBLE) FILTER (WHERE direction = 'inbound' AND sent_at >= sent), 6) AS avg_days,
    (sum(CASE WHEN regexp_matches(said, '{"|".join(contact.EVASIONS)}') THEN greatest(0, least(100, length(said) // 10) - 30) ELSE least(100, length(said) // 10) END) FILTER (WHERE direction = 'inbound') // count(*) FILTER (WHERE direction = 'inbound'))::INT AS quality,
    epoch_us(max(sent_at) FILTER (WHERE direction = 'inbound')) AS last_reply, {", ".join(map(_FIRST, FIELDS))}
    FROM (SELECT *, min(CASE WHEN direction = 'outbound' THEN sent_at END) OVER (PARTITION BY thread_id) AS sent FROM ({SIGNATURE_SQL})) GROUP BY 1 HAVING count(*) FILTER (WHERE direction = 'inbound') > 0""",
)
def _(t):
    rows = jobs.read_table_stream(t.spark, t.sf_dir, "conversations").withColumnsRenamed({"conv_id": "thread_id", "text": "body"})
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("thread_id") * 3600 + F.col("turn") * 5400)
    direction = F.when(F.col("role") == "assistant", "outbound").otherwise("inbound")
    said = rows.select(F.concat_ws("-", "thread_id", "turn").alias("msg_id"), "thread_id", direction.alias("direction"), at.alias("sent_at"), F.expr(SIGNED).alias("said"))
    said = said.withColumn("block", contact.contact_block(F.col("said")))  # written once, looked at for each field
    said = said.withColumns({"s": contact.signature(F.col("block")), "quality": contact.reply_quality(F.col("said"))})
    twice = said.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))  # every message comes twice
    learned = jobs.learn_replies(twice.select("thread_id", "msg_id", "sent_at", "direction", "quality", "s.*"), "thread_id")
    found = jobs.run_backlog(learned, "update", ["thread_id"])
    return found.withColumns({"avg_days": F.round("avg_days", 6), "last_reply": F.unix_micros("last_reply")})


@query("c_top_sources", "SELECT corp_code, id, rank FROM (SELECT corp_code, id, row_number() OVER (PARTITION BY corp_code ORDER BY weight DESC, id) AS rank FROM news) WHERE rank <= 2")
def _(t):
    return top_per_key(t.news, ["corp_code"], 2, F.desc("weight"), F.col("id")).select("corp_code", "id", "rank")
