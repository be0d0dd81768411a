"""Text, number and date functions applied to documents, pages and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import changes, contact, numbers, questions, text
from tessera.functions.contact import domain_category
from tessera.operators import filings, financial, verification
from tessera.operators.citations import uncited_phrases
from tessera.operators.keywords import sector_of, tags, weighted_sector
from tessera.operators.relational import dealt, first_match, top_per_key
from tessera.plans import drafted, parted
from tessera.plans.registry import query
from tessera.sources.adapters import AS_OF


def n(name: str = "n"):
    return F.count("*").alias(name)


def joined(c, sep: str = "|"):
    return F.array_join(c, sep)


def TEXT():
    return F.col("text")


@query("txt_strip_html_simple", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS bare FROM pages")
def _(t):
    return t.pages.select("page_id", text.strip_tags(F.col("html")).alias("bare"))


ENTITIES = "replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


@query("txt_strip_html", "SELECT page_id, trim(regexp_replace(" + ENTITIES.format("regexp_replace(html, '<(script|style)[^>]*>[^<]*</(script|style)>|<[^>]+>', ' ', 'g')") + ", '[ \\t\\n\\r\\f]+', ' ', 'g')) AS bare FROM pages")
def _(t):
    return t.pages.select("page_id", text.strip_html(F.col("html")).alias("bare"))


TOKENS_SQL = "list_sort(list_distinct(list_concat(regexp_extract_all({0}, '[가-힣]{{2,}}'), list_transform(regexp_extract_all({0}, '[A-Za-z]{{3,}}'), lambda x: lower(x)))))"


@query("txt_tokens_ko_en", f"SELECT doc_id, array_to_string({TOKENS_SQL.format('text')}, '|') AS tokens FROM documents")
def _(t):
    return t.documents.select("doc_id", joined(F.array_sort(text.tokens(TEXT()))).alias("tokens"))


STOP = ["the", "and", "that", "les", "der", "los"]


@query("txt_tokens_stop", f"SELECT doc_id, len(list_filter({TOKENS_SQL.format('text')}, lambda x: NOT list_contains({STOP}, x))) AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", F.size(text.tokens(TEXT(), stop=STOP)).cast("long").alias("n"))


@query("txt_tokenize_2_6", f"SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z]{{2,6}}'), lambda x: NOT list_contains({STOP}, x))) AS n FROM documents")
def _(t):
    words = F.filter(text.find_all(F.lower("text"), "[a-z]{2,6}"), lambda x: ~x.isin(*STOP))
    return t.documents.select("doc_id", F.size(words).cast("long").alias("n"))


PARTICLES = ["tion", "ing", "es", "ent", "n"]


@query("txt_strip_particle", "SELECT word, regexp_replace(word, '(tion|ing|es|ent|n)$', '') AS stem FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{3,}')) AS word FROM documents)")
def _(t):
    words = t.documents.select(F.explode(text.find_all(TEXT(), "[a-z]{3,}")).alias("word")).distinct()
    return words.select("word", F.regexp_replace("word", "(tion|ing|es|ent|n)$", "").alias("stem"))


@query("txt_strip_particle2", "SELECT word, regexp_replace(word, '^(.{2,}?)(tion|ent|ing|es|n)$', '\\1') AS stem FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{3,}')) AS word FROM documents)")
def _(t):
    words = t.documents.select(F.explode(text.find_all(TEXT(), "[a-z]{3,}")).alias("word")).distinct()
    return words.select("word", text.strip_particle(F.col("word"), PARTICLES).alias("stem"))


@query("txt_news_keywords", """SELECT page_id, array_to_string((list_distinct_keep)[1:100], '|') AS keywords FROM (SELECT page_id, list_reduce(list_prepend([]::VARCHAR[], list_transform(list_filter(list_transform(regexp_extract_all(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[a-z]{3,}'),
    lambda w: regexp_replace(w, '^(.{2,}?)(tion|ent|ing|es|n)$', '\\1')), lambda w: length(w) >= 3), lambda w: [w])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END) AS list_distinct_keep FROM pages)""")
def _(t):
    title = F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    stems = F.transform(text.find_all(title, "[a-z]{3,}"), lambda w: text.strip_particle(w, PARTICLES))
    words = F.array_distinct(F.filter(stems, lambda w: F.length(w) >= 3))  # keeps the first of equals, in order
    return t.pages.select("page_id", joined(F.slice(words, 1, 100)).alias("keywords"))


@query("txt_headline_kw", """SELECT page_id, array_to_string(list_transform((list_sort(list_transform(list_distinct(w), lambda x: {'at': list_position(w, x), 'x': x})))[1:3], lambda x: x.x), '|') AS kw FROM (SELECT page_id, regexp_extract_all(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[a-z]{4,}') AS w FROM pages)""")
def _(t):
    words = F.array_distinct(text.find_all(F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), "[a-z]{4,}"))
    return t.pages.select("page_id", joined(F.slice(words, 1, 3)).alias("kw"))


# The tables' names have no legal forms: they are written around them here, and taken off again.


def dressed(name: str, key: str, forms) -> str:
    """SQL of both engines: name between the parts of one of the forms, by key."""
    return "CASE " + " ".join(f"WHEN {key} % {len(forms)} = {k} THEN '{a}' || {name} || '{b}'" for k, (a, b) in enumerate(forms)) + " END"


CORP_FORMS, PARTNER_FORMS = [("(주)", ""), ("", " 주식회사"), ("㈜ ", ""), ("（주） ", " ")], [("주식회사 ", ""), ("", " (주)"), ("㈜ ", " 연구소"), ("", "㈜ (Co-op 7)")]
WRITTEN_FORMS = [("(주)", ""), ("① ", ","), ("", " (a client)"), ("· ", ";")]


@query("txt_normalize_corp", "SELECT corp_code, corp_name AS name FROM companies")
def _(t):
    return t.companies.select("corp_code", text.normalise_corp(F.expr(dressed("corp_name", "corp_code", CORP_FORMS))).alias("name"))


@query("txt_normalize_partner", "SELECT DISTINCT partner_id, partner_name AS name FROM edges")
def _(t):
    return t.edges.select("partner_id", "partner_name").distinct().select("partner_id", text.normalise_partner(F.expr(dressed("partner_name", "partner_id", PARTNER_FORMS))).alias("name"))


@query("txt_clean_partner", "SELECT DISTINCT partner_id, partner_name AS name FROM edges")
def _(t):
    return t.edges.select("partner_id", "partner_name").distinct().select("partner_id", text.clean_partner(F.expr(dressed("partner_name", "partner_id", WRITTEN_FORMS))).alias("name"))


@query("txt_keyword_clean", "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(replace(p_name || ', ' || p_type || '; x', ';', ','), ','), lambda x: trim(x)), lambda x: length(x) >= 2), '|') AS names FROM part")
def _(t):
    both = F.concat("p_name", F.lit(", "), "p_type", F.lit("; x"))
    return t.part.select("p_partkey", joined(text.split_names(both)).alias("names"))


@query("txt_evidence", "SELECT doc_id, substr(array_to_string(list_filter(list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]'), lambda s: trim(s)), lambda s: length(s) > 0), lambda s: contains(lower(s), 'tion')), '. '), 1, 300) AS evidence FROM documents")
def _(t):
    return t.documents.select("doc_id", text.evidence(TEXT(), "tion").alias("evidence"))


@query("txt_window_summary", """SELECT doc_id, CASE WHEN at > 0 THEN CASE WHEN a > 1 THEN '...' ELSE '' END || substr(text, a, b - a + 1) || CASE WHEN b < length(text) THEN '...' ELSE '' END END AS summary
    FROM (SELECT doc_id, text, p AS at, greatest(p - 75, 1) AS a, least(p + 78, length(text)) AS b FROM (SELECT doc_id, text, instr(lower(text), 'tion') AS p FROM documents))""".replace("WHEN at >", "WHEN hit >").replace("p AS at", "p AS hit"))
def _(t):
    return t.documents.select("doc_id", text.window_around(TEXT(), "tion").alias("summary"))


@query("txt_count_kw", "SELECT doc_id, ((length(text) - length(replace(text, 'tion', ''))) // 4)::INT AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", text.count_of(TEXT(), "tion").alias("n"))


@query("txt_pattern_hits", "SELECT doc_id, (len(regexp_extract_all(text, 'tion ')) + len(regexp_extract_all(text, ' the ')))::INT AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", text.hits(TEXT(), ["tion ", " the "]).alias("n"))


#: What leads say of a change: two phrases by their id.
SAYINGS = ["신규 사업 진출", "폐지했다고 하며 사업 철수", "비중 증가", "감축됐고 점유율 하락", "변경했고 통합됐다", "그대로다", "새로운 분야와 증설했"]
_SAYING = lambda engine: " || ' 그리고 ' || ".join(f"({SAYINGS})[id % {k} + 1]" if engine == "sql" else f"element_at(array({', '.join(map(repr, SAYINGS))}), CAST(id % {k} AS INT) + 1)" for k in (7, 5))
CHANGE_TEXT, CHANGE_TEXT_SQL = "title || ': ' || " + _SAYING("spark"), "title || ': ' || " + _SAYING("sql")
_HITS = {f: " + ".join(f"len(regexp_extract_all(said, '{p}'))" for p in ps) for f, ps in changes.FAMILIES.items()}
_MOST = f"greatest({', '.join(f'f{k}' for k in range(len(_HITS)))})"
CHANGE_SQL = f"""SELECT id, corp_code, CASE WHEN {_MOST} = 0 THEN 'UNKNOWN' {" ".join(f"WHEN f{k} = {_MOST} THEN '{f}'" for k, f in enumerate(_HITS))} END AS change
    FROM (SELECT id, corp_code, {", ".join(f"{hits} AS f{k}" for k, hits in enumerate(_HITS.values()))} FROM (SELECT id, corp_code, {CHANGE_TEXT_SQL} AS said FROM leads))"""


def changes_of_leads(t):
    return t.leads.select("id", "corp_code", changes.change_of(F.expr(CHANGE_TEXT)).alias("change"))


@query("txt_classify_change", f"SELECT id, change FROM ({CHANGE_SQL})")
def _(t):
    return changes_of_leads(t).select("id", "change")


EVENT_RULES = [("MA", "merger"), ("CAPITAL", "rights|issue"), ("INSIDER", "insider")]
EVENT_SQL = "CASE WHEN report_nm LIKE '%merger%' THEN 'MA' WHEN regexp_matches(report_nm, 'rights|issue') THEN 'CAPITAL' WHEN report_nm LIKE '%insider%' THEN 'INSIDER' ELSE 'OTHER' END"


@query("txt_event_type", f"SELECT rcept_no, {EVENT_SQL} AS kind FROM disclosures")
def _(t):
    return t.disclosures.select("rcept_no", text.first_class(F.col("report_nm"), EVENT_RULES, "OTHER").alias("kind"))


@query("e_event_leads", f"SELECT rcept_no, corp_code, kind, CASE kind WHEN 'MA' THEN 5 WHEN 'CAPITAL' THEN 4 ELSE 3 END AS severity FROM (SELECT *, {EVENT_SQL} AS kind FROM disclosures) WHERE kind <> 'OTHER'")
def _(t):
    rows = t.disclosures.withColumn("kind", text.first_class(F.col("report_nm"), EVENT_RULES, "OTHER")).filter("kind <> 'OTHER'")
    return rows.select("rcept_no", "corp_code", "kind", F.when(F.col("kind") == "MA", 5).when(F.col("kind") == "CAPITAL", 4).otherwise(3).alias("severity"))


SECTOR_EXACT = {"blue ring": "rings", "small": "small things", "red anvil": "forge", "old": "never by prefix", "cold gizmo": "cold chain", "large g": "large goods"}
SECTOR_PATTERNS = [("BOLT|rod$", "fasteners"), ("^hot ", "heat"), ("widget", "parts"), ("^(new|old) (plate|gear)", "machines")]
_PATTERNS = " ".join(f"WHEN regexp_matches(p_name, '(?i){p}') THEN '{x}'" for p, x in SECTOR_PATTERNS)
_EXACT = " ".join(f"WHEN p_name = '{k}' THEN '{x}'" for k, x in SECTOR_EXACT.items())
_BEGINS = " ".join(f"WHEN starts_with(p_name, '{k}') THEN '{x}'" for k, x in SECTOR_EXACT.items() if len(k) >= 4)


@query("txt_sector_of", f"SELECT p_partkey, CASE {_EXACT} {_PATTERNS} {_BEGINS} WHEN p_type <> 'PROMO' THEN lower(p_type) ELSE 'other' END AS sector FROM part")
def _(t):
    fallback = F.when(F.col("p_type") != "PROMO", F.lower("p_type"))  # stands for a company's own sector
    return sector_of(t.part, "p_name", SECTOR_EXACT, SECTOR_PATTERNS, fallback, "other").select("p_partkey", "sector")


#: Sectors by words of names, the first that has one; and rules of words that must and must not occur.
SECTOR_NAMES = [("fasteners", ["bolt", "rod"]), ("round", ["ring", "gear"]), ("flat", ["plate"]), ("bright", ["red", "blue"])]
SECTOR_RULES = [("hot metal", ["hot"], ["gizmo"]), ("tools", ["anvil", "widget"], ["small", "old"]), ("small", ["small"], []), ("gizmos", ["gizmo"], ["red"]), ("new", ["new"], [])]


@query("txt_sector_keywords", "SELECT p_partkey, CASE " + " ".join(f"WHEN {' OR '.join(f"contains(p_name, '{w}')" for w in ws)} THEN '{x}'" for x, ws in SECTOR_NAMES) + " ELSE 'none' END AS sector FROM part")
def _(t):
    return t.part.select("p_partkey", text.first_class(F.col("p_name"), [(x, "|".join(ws)) for x, ws in SECTOR_NAMES], "none").alias("sector"))


@query("txt_sector_rules", "SELECT p_partkey, CASE " + " ".join(f"WHEN ({' OR '.join(f"contains(p_name, '{w}')" for w in yes)}) {' '.join(f"AND NOT contains(p_name, '{w}')" for w in no)} THEN '{x}'" for x, yes, no in SECTOR_RULES) + " ELSE 'rest' END AS sector FROM part")
def _(t):
    has = lambda words: F.exists(F.array(*map(F.lit, words)).cast("array<string>"), lambda w: F.contains("p_name", w))
    return t.part.select("p_partkey", F.coalesce(first_match([(x, has(yes) & ~has(no)) for x, yes, no in SECTOR_RULES]), F.lit("rest")).alias("sector"))


#: A text's first sentence, and the others.
HEADLINE_SQL, BODY_SQL = f"coalesce(({parted.SENTENCES_SQL})[1], '')", f"coalesce(array_to_string(({parted.SENTENCES_SQL})[2:], '. '), '')"
SECTOR_WORDS = [("energy", ["ration", "tion", "power"]), ("food", ["heed", "eat"]), ("trade", ["and the", "keit", "ción"]), ("land", ["eau", "sch", "ment"])]
_WEIGHED = [" + ".join(f"contains(head, '{w}')::INT * 3 + contains(body, '{w}')::INT * 2 + contains(text, '{w}')::INT" for w in ws) for _, ws in SECTOR_WORDS]
_TOP = f"greatest({', '.join(f's{k}' for k in range(len(_WEIGHED)))})"


@query(
    "txt_sector_weighted",
    f"""SELECT doc_id, CASE WHEN {_TOP} = 0 THEN 'none' {" ".join(f"WHEN s{k} = {_TOP} THEN '{x}'" for k, (x, _) in enumerate(SECTOR_WORDS))} END AS sector
    FROM (SELECT doc_id, {", ".join(f"{w} AS s{k}" for k, w in enumerate(_WEIGHED))} FROM (SELECT doc_id, text, {HEADLINE_SQL} AS head, {BODY_SQL} AS body FROM documents))""",
)
def _(t):
    parts = text.sentences(F.col("text"))
    body = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), ". ")
    rows = t.documents.select("doc_id", "text", F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("head"), F.coalesce(body, F.lit("")).alias("body"))
    return rows.select("doc_id", weighted_sector(F.col("head"), F.col("body"), F.col("text"), SECTOR_WORDS, "none").alias("sector"))


SECTOR_KEYS = [("energy", "ration"), ("energy", "ing"), ("energy", "tion"), ("food", "heat"), ("food", "eat"), ("land", "eau"), ("land", "schach"), ("trade", "keit"), ("trade", "mento"), ("law", "ment"), ("law", "laws")]


@query("txt_detect_sectors", f"SELECT doc_id, sector, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS w FROM documents) JOIN (VALUES {', '.join(map(str, SECTOR_KEYS))}) k(sector, word) ON contains(w, word) OR contains(word, w) GROUP BY 1, 2")
def _(t):
    keys = t.spark.createDataFrame(SECTOR_KEYS, "sector string, word string")
    words = t.documents.select("doc_id", F.explode(F.array_distinct(text.find_all(F.lower("text"), "[a-z]{3,}"))).alias("w"))
    # matched once a distinct word, not once a document
    match = words.select("w").distinct().join(keys, F.contains("w", "word") | F.contains("word", "w"))
    return words.join(match, "w").groupBy("doc_id", "sector").agg(n())


@query("txt_direct_mention", "SELECT doc_id, word FROM documents, (SELECT unnest(['thtion', 'eauou', 'sch']) AS word) WHERE contains(text, word) AND regexp_matches(text, '(^|[^A-Za-z0-9])' || word || '([ .,]|$)')")
def _(t):
    return t.documents.select("doc_id", F.explode(text.mentioned(F.col("text"), ["thtion", "eauou", "sch"])).alias("word"))


@query("txt_email_extract", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z0-9.-]*[A-Za-z]'), lambda x: lower(x)))), '|') AS emails FROM documents")
def _(t):
    return t.documents.select("doc_id", joined(text.emails(TEXT())).alias("emails"))


@query("txt_contact_signature", "SELECT doc_id, regexp_extract(right(text, 1500), '\\+?[0-9][0-9 ()-]{7,}[0-9]') AS phone, regexp_extract(right(text, 1500), '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+') AS email FROM documents")
def _(t):
    tail = F.right("text", F.lit(1500))
    return t.documents.select("doc_id", F.regexp_extract(tail, r"\+?[0-9][0-9 ()-]{7,}[0-9]", 0).alias("phone"), F.regexp_extract(tail, "[A-Za-z0-9._-]+@[A-Za-z0-9.-]+", 0).alias("email"))


@query("txt_domain_root", "SELECT id, split_part(host, '.', 1) AS root FROM (SELECT id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM news)")
def _(t):
    return t.news.select("id", F.split_part(text.url_host(F.col("url")), F.lit("."), F.lit(1)).alias("root"))


#: Numbers of the texts get a unit by the letter of the next word.
UNIT_STEPS = [("([0-9]) ([a-f])", "만"), ("([0-9]) ([g-m])", "백만"), ("([0-9]) ([n-s])", "%"), ("([0-9]) ([t-z])", "억")]
WITH_UNITS_SQL = "text"
for _pattern, _unit in UNIT_STEPS:
    WITH_UNITS_SQL = f"regexp_replace({WITH_UNITS_SQL}, '{_pattern}', '\\1{_unit} \\2', 'g')"


def with_units(c):
    for pattern, unit in UNIT_STEPS:
        c = F.regexp_replace(c, pattern, f"$1{unit} $2")
    return c


GENERIC_HOSTS = ["theran.example.net", "theand.example.com", "example.net"]
AGENCY_HOSTS = ["blog.theran.example.net", "blog.therea.example.net", "ththed.example.org"]


@query("txt_domain_category", f"SELECT id, CASE WHEN host IS NULL OR host = '' OR NOT contains(host, '.') THEN 'none' WHEN host IN ({str(GENERIC_HOSTS)[1:-1]}) THEN 'generic' WHEN host IN ({str(AGENCY_HOSTS)[1:-1]}) THEN 'agency' WHEN host LIKE '%.org' OR host LIKE '%.or.kr' OR host LIKE '%.go.kr' THEN 'org' ELSE 'company' END AS kind FROM news")
def _(t):
    return t.news.select("id", domain_category(F.col("host"), GENERIC_HOSTS, AGENCY_HOSTS, [".org", ".or.kr", ".go.kr"]).alias("kind"))


#: Speculative phrases of the texts, and what counts as a citation.
SPECULATIVE = ["might", "only", "from"]
CITED = [r"\([^()]{1,80}\)", "[A-Za-z]@[A-Za-z]", "https?://"]
#: Numbers with a unit.
NUMBERED = [r"[0-9][0-9,]*\.?[0-9]*\s*(?:조|억|천만|백만|만|%p|%)"]


def spots_sql(texts: str, pattern: str) -> str:
    """doc_id, hit, at (from 0): places of a pattern, from the lengths of what lies between them."""
    return f"""SELECT doc_id, hit, (sum(length(piece)) OVER w + sum(length(hit)) OVER w - length(hit))::BIGINT AS at FROM (SELECT doc_id, unnest(hits) AS hit, unnest(pieces[1:len(hits)]) AS piece, generate_subscripts(hits, 1) AS k
    FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS hits, regexp_split_to_array(text, '{pattern}') AS pieces FROM ({texts}))) WINDOW w AS (PARTITION BY doc_id ORDER BY k)"""


def uncited_sql(texts: str, phrases: list[str]) -> str:
    hits = " UNION ALL ".join(spots_sql(texts, p) for p in phrases)
    cited = " UNION ALL ".join(spots_sql(texts, p) for p in CITED)
    return f"""SELECT doc_id, count(h.at) AS n, min(h.at)::INT AS first FROM documents LEFT JOIN (SELECT * FROM ({hits}) h WHERE NOT EXISTS (SELECT 1 FROM ({cited}) c WHERE c.doc_id = h.doc_id AND c.at >= h.at - 100 AND c.at + length(c.hit) <= h.at + 100)) h USING (doc_id) GROUP BY 1"""


def counted(found):
    return F.size(found).cast("long").alias("n"), F.array_min(found["position"]).alias("first")


@query("txt_speculation", uncited_sql("SELECT doc_id, text FROM documents", SPECULATIVE))
def _(t):
    return t.documents.select("doc_id", uncited_phrases(SPECULATIVE, CITED)(TEXT()).alias("found")).select("doc_id", *counted(F.col("found")))


@query("txt_unsourced_numbers", uncited_sql(f"SELECT doc_id, {WITH_UNITS_SQL} AS text FROM documents", NUMBERED))
def _(t):
    return t.documents.select("doc_id", uncited_phrases(NUMBERED, CITED)(with_units(TEXT())).alias("found")).select("doc_id", *counted(F.col("found")))


@query("txt_external_knowledge", f"SELECT a.doc_id, len(w) AS candidates, len(list_filter(w, lambda x: contains(s, lower(x)))) AS known FROM (SELECT doc_id, list_distinct(regexp_extract_all({parted.EVIDENCE_SQL}, '[A-Z][a-z]{{3,}}')) AS w, lower({parted.REST_SQL}) AS s FROM documents) a")
def _(t):
    named, rest = parted.parted()
    words, source = F.array_distinct(text.find_all(named, "[A-Z][a-z]{3,}")), F.lower(rest)
    return t.documents.select("doc_id", F.size(words).cast("long").alias("candidates"), F.size(F.filter(words, lambda x: F.contains(source, F.lower(x)))).cast("long").alias("known"))


#: Messages as they are signed, by thread and turn; the tables' messages have no signatures.
SIGNED = """concat(body, CASE (thread_id + turn) % 6
    WHEN 0 THEN concat('\\n■ 문의처: 홍보팀 김철수 팀장 010-1234-', 1000 + thread_id % 9000, ', 02-555-', 1000 + turn, ' ir', thread_id, '@corp.example.com ir', thread_id, '@corp.example.com')
    WHEN 1 THEN concat('\\nIR본부 남궁민(부장) 031.345.', 1000 + thread_id % 9000, ' / noreply@corp.example.com, pr@corp', turn, '.example.com')
    WHEN 2 THEN '\\n담당자: 최고 책임 / 재무 비공개 admin@corp.example.com'
    WHEN 3 THEN concat('\\nContact: 박영희 Manager 010 987 ', 1000 + turn, ' 답변 어렵습니다') WHEN 4 THEN '\\n홍길동입니다 감사합니다' ELSE '' END)"""
SIGNED_SQL = """body || CASE (thread_id + turn) % 6
    WHEN 0 THEN chr(10) || '■ 문의처: 홍보팀 김철수 팀장 010-1234-' || (1000 + thread_id % 9000) || ', 02-555-' || (1000 + turn) || ' ir' || thread_id || '@corp.example.com ir' || thread_id || '@corp.example.com'
    WHEN 1 THEN chr(10) || 'IR본부 남궁민(부장) 031.345.' || (1000 + thread_id % 9000) || ' / noreply@corp.example.com, pr@corp' || turn || '.example.com'
    WHEN 2 THEN chr(10) || '담당자: 최고 책임 / 재무 비공개 admin@corp.example.com'
    WHEN 3 THEN chr(10) || 'Contact: 박영희 Manager 010 987 ' || (1000 + turn) || ' 답변 어렵습니다' WHEN 4 THEN chr(10) || '홍길동입니다 감사합니다' ELSE '' END"""
_PERSON = f"(contains('{contact.SURNAMES}', substr({{0}}, 1, 1)) OR substr({{0}}, 1, 2) IN ({str(contact.LONG_SURNAMES)[1:-1]})) AND {{0}} NOT IN ({str(contact.NO_PERSONS)[1:-1]})"
_NUMBERS = "list_transform(regexp_extract_all(block, '{0}'), lambda x: regexp_replace(x, '{0}', '\\1-\\2-\\3'))".format
SIGNATURE_SQL = f"""SELECT msg_id, thread_id, turn, direction, sent_at, said, person[1] AS name, person[2] AS title, dept, mobile, list_filter({_NUMBERS(contact.PHONE)}, lambda p: p IS DISTINCT FROM mobile)[1] AS phone, email FROM (
    SELECT *, list_filter(list_zip(regexp_extract_all(block, '{contact.TITLED}', 1), regexp_extract_all(block, '{contact.TITLED}', 2)), lambda x: {_PERSON.format("x[1]")})[1] AS person, {_NUMBERS(contact.MOBILE)}[1] AS mobile,
      nullif(regexp_extract(block, '{contact.DEPARTMENT}', 1) || regexp_extract(block, '{contact.DEPARTMENT}', 2), '') AS dept,
      list_filter(regexp_extract_all(block, '{contact.ADDRESS}'), lambda e: NOT regexp_matches(lower(e), '{"|".join(contact.NO_ADDRESSES)}'))[1] AS email FROM (
    SELECT *, CASE WHEN regexp_matches(said, '{contact.BLOCK_STARTS}') THEN substr(said, length(regexp_split_to_array(said, '{contact.BLOCK_STARTS}')[1]) + 1, 1500) ELSE right(said, 1500) END AS block FROM (SELECT *, {SIGNED_SQL} AS said FROM messages)))"""


@query("txt_contact_block", f"SELECT msg_id, name, title, dept, mobile, phone, email FROM ({SIGNATURE_SQL})")
def _(t):
    rows = t.messages.select("msg_id", contact.contact_block(F.expr(SIGNED)).alias("block"))
    return rows.select("msg_id", contact.signature(F.col("block")).alias("s")).select("msg_id", "s.*")


@query("txt_person_name", f"SELECT msg_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all({SIGNED_SQL}, '[가-힣]{{2,4}}'), lambda w: {_PERSON.format('w')}))), '|') AS names FROM messages")
def _(t):
    names = F.filter(F.array_distinct(text.find_all(F.expr(SIGNED), "[가-힣]{2,4}")), contact.is_person)
    return t.messages.select("msg_id", joined(F.array_sort(names)).alias("names"))


#: Hints of contact pages in links or their texts.
LINK_HINTS = ["contact", "invest", "/ir", "the", "heed", "ción"]
ANCHOR = '(?is)<a\\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'


@query("txt_ir_links", f"""SELECT page_id, len(x)::BIGINT AS n, x[1][1] AS first FROM (SELECT page_id, list_filter(list_zip(regexp_extract_all(html, '{ANCHOR}', 1), regexp_extract_all(html, '{ANCHOR}', 2)),
    lambda a: regexp_matches(lower(a[1]), '{"|".join(LINK_HINTS)}') OR regexp_matches(lower(regexp_replace(a[2], '<[^>]+>', '', 'g')), '{"|".join(LINK_HINTS)}')) AS x FROM pages)""")
def _(t):
    links = text.hinted_links(F.col("html"), ANCHOR, LINK_HINTS)
    return t.pages.select("page_id", links.alias("x")).select("page_id", F.size("x").cast("long").alias("n"), F.get("x.href", F.lit(0)).alias("first"))


PATHS = ["/ir", "/contact", "/about", "/ir"]


@query("txt_candidate_urls", "SELECT corp_code, array_to_string(list_transform(['/ir', '/contact', '/about'], lambda p: regexp_extract(hm_url, '^https?://[^/]+') || p), ' ') AS urls FROM companies")
def _(t):
    base = F.regexp_extract("hm_url", "^https?://[^/]+", 0)
    return t.companies.select("corp_code", joined(F.array_distinct(F.transform(F.array(*map(F.lit, PATHS)), lambda p: F.concat(base, p))), " ").alias("urls"))


@query("txt_guess_emails", "SELECT corp_code, unnest(['ir', 'info', 'contact']) || '@' || regexp_extract(hm_url, 'www\\.([^/]+)', 1) AS email FROM companies")
def _(t):
    host = F.regexp_extract("hm_url", r"www\.([^/]+)", 1)
    return t.companies.select("corp_code", F.explode(F.transform(F.array(*map(F.lit, ("ir", "info", "contact"))), lambda p: F.concat(p, F.lit("@"), host))).alias("email"))


@query("txt_headline_consistency", "SELECT page_id, len(w) AS n, CASE WHEN len(w) > 0 THEN (len(list_filter(w, lambda x: contains(body, x))) * 100 // len(w)) >= 60 ELSE true END AS pass FROM (SELECT page_id, list_distinct(regexp_extract_all(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[a-z]{3,}')) AS w, lower(regexp_extract(html, '<article>(.*)', 1)) AS body FROM pages)")
def _(t):
    words = F.array_distinct(text.find_all(F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), "[a-z]{3,}"))
    body = F.lower(F.regexp_extract("html", "<article>(.*)", 1))
    found = F.size(F.filter(words, lambda x: F.contains(body, x)))
    return t.pages.select("page_id", F.size(words).cast("long").alias("n"), F.when(F.size(words) > 0, F.floor(F.try_divide(found * 100, F.size(words))) >= 60).otherwise(True).alias("pass"))


@query("txt_period_label", "SELECT id, CASE WHEN m <= 3 THEN 'annual' WHEN m <= 5 THEN 'q1' WHEN m <= 8 THEN 'half' ELSE 'q3' END AS label FROM (SELECT id, substr(rcept_dt, 5, 2)::INT AS m FROM reports)")
def _(t):
    m = F.substring("rcept_dt", 5, 2).cast("int")
    return t.reports.select("id", F.when(m <= 3, "annual").when(m <= 5, "q1").when(m <= 8, "half").otherwise("q3").alias("label"))


# The tables hold no filing texts: they are written here from reports and edges, by SQL of both
# engines, and the checks take the parts as they were before they were written.

OVERVIEW = "'1. 사업의 개요' || chr(10) || corp_name || ' filed ' || report_type || ' on ' || rcept_dt"
PRODUCTS = "' 2. 주요 제품' || chr(10) || biz_content"
CONTRACTS = "'6. 주요계약 및 연구개발활동' || chr(10) || 'contract ' || id || ', III of ' || n_chars"
FILING = f"'II. 사업의 내용' || chr(10) || {OVERVIEW} || chr(10) || coalesce({PRODUCTS} || chr(10), '') || {CONTRACTS} || chr(10) || 'III. 재무에 관한 사항' || chr(10) || repeat('figures ', 12)"


@query(
    "txt_split_sections",
    f"""SELECT id, code, title, content, length(content) AS n FROM (SELECT id, 'overview' AS code, '사업의 개요' AS title, {OVERVIEW} AS content FROM reports UNION ALL SELECT id, 'products', '주요 제품 및 서비스', trim({PRODUCTS}) FROM reports WHERE biz_content IS NOT NULL
    UNION ALL SELECT id, 'contracts', '주요계약 및 연구개발', {CONTRACTS} FROM reports) WHERE length(content) >= 20""",
)
def _(t):
    return filings.sections(t.reports.select("id", F.expr(FILING).alias("body")), "id", "body")


CHAPTER = "'II. 사업의 내용' || chr(10) || repeat(corp_name || ' makes parts' || chr(10), CAST(5 + id % 40 AS INT))"


@query("txt_section_cut", f"SELECT id, CASE WHEN length(c) >= 300 THEN c END AS section FROM (SELECT id, rtrim({CHAPTER}, chr(10)) AS c FROM reports)")
def _(t):
    written = F.expr(f"'II. 사업의 내용 ... 4' || chr(10) || 'III. 재무 ... 9' || chr(10) || {CHAPTER} || 'III. 재무에 관한 사항' || chr(10) || rcept_dt")
    return t.reports.select("id", written.alias("body")).select("id", filings.chapter(F.col("body")).alias("section"))


LISTS = {"supplier": "주요 공급사: ", "customer": "핵심 고객: ", "partner": "전략적 파트너: "}


@query(
    "txt_relation_extract",
    "SELECT DISTINCT corp_code, relation, partner_name AS name FROM edges",
)
def _(t):
    said = lambda r: F.coalesce(F.concat(F.lit(LISTS[r]), F.nullif(joined(F.array_sort(F.collect_set(F.when(F.col("relation") == r, F.col("partner_name")))), ", "), F.lit("")), F.lit("\n\n")), F.lit(""))
    rows = dealt(t.edges.select("corp_code", "relation", "partner_name"), t.lineitem.count(), "corp_code")  # tasks that gather lists grow in number with the edges
    written = rows.groupBy("corp_code").agg(F.concat(*map(said, LISTS)).alias("body"))
    return filings.relations(written, "corp_code", "body", context=False)


#: Questions by kind of change, by type of lead, and for the rest.
QUESTION_SETS = {
    "NEW": ["why now?", "how much is invested?", "who is the customer?", "when does it pay?", "what is the risk?", "who else does it?"], "REMOVED": ["why is it given up?", "what becomes of the staff?"], "EXPANDED": ["by how much?"],
    "CHANGED": ["what was it before?", "who decided?"], "risk": ["how likely is it?", "what is done?"], "supply": ["which suppliers?"], "default": ["what changed?", "what comes next?"],
}
HEADLINE = "concat(title, CASE id % 4 WHEN 0 THEN concat(', up ', signal_count, ' %') WHEN 1 THEN concat(', worth ', signal_count, '억원') WHEN 2 THEN concat(', 2.5억 and ', signal_count, '%') ELSE '' END)"
_ABOUT = "title || CASE id % 4 WHEN 0 THEN ': as of when, and by which measure, is ' || signal_count || ' %?' WHEN 1 THEN ': what does ' || signal_count || '억원 rest on?' WHEN 2 THEN ': as of when, and by which measure, is ' || signal_count || '%?' END"
_KIND = " ".join(f"WHEN {' OR '.join([*(f"contains(lower(title || ' ' || said), '{m}')" for m in marks), *(f"contains(said, '{w}')" for w in words)])} THEN '{k}'" for k, marks, words in questions.KINDS)
_SETS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in QUESTION_SETS.items() if k != "default")
_OF_TYPE = " ".join(f"WHEN '{k}' THEN {v}" for k, v in QUESTION_SETS.items() if k.islower() and k != "default")
_NONE = [k for k, _, _ in questions.KINDS if k not in QUESTION_SETS]


@query("txt_change_hint", f"""SELECT id, kind, array_to_string(list_filter(list_concat([{_ABOUT}], own[1:5]), lambda q: q IS NOT NULL)[1:6], '|') AS questions FROM (SELECT *, CASE kind {_SETS} ELSE CASE lead_type {_OF_TYPE} ELSE {QUESTION_SETS["default"]} END END AS own
    FROM (SELECT *, CASE {_KIND} END AS kind FROM (SELECT *, {CHANGE_TEXT_SQL} AS said FROM leads)))""")
def _(t):
    rows = t.leads.select("id", "lead_type", F.expr(HEADLINE).alias("headline"), F.expr(CHANGE_TEXT).alias("said"))
    rows = rows.withColumn("every", questions.every(F.col("headline"), F.col("said")))  # looked at for each kind, written once
    rows = rows.select("id", "lead_type", "headline", questions.kind_in(F.col("every"), F.col("said")).alias("kind"))
    return rows.select("id", "kind", joined(questions.questions_on(F.col("headline"), F.col("kind"), F.col("lead_type"), QUESTION_SETS)).alias("questions"))


#: Answers in every form that a model gives them in.
ANSWER = """CASE event_id % 6 WHEN 0 THEN obj WHEN 1 THEN concat('Here it is:\\n```json\\n', obj, '\\n``` {done}') WHEN 2 THEN concat('So ', obj, ' it is') WHEN 3 THEN concat('{"headline": "event ', event_id, '", "body": "cut off')
    WHEN 4 THEN concat("{'headline': 'event ", event_id, "', 'body': 'of ", event_type, "'}") ELSE concat('no answer ', event_id) END"""


@query("txt_parse_json_loose", """SELECT event_id, (['whole', 'fenced', 'braces', 'keys', 'keys', 'none'])[event_id % 6 + 1] AS step, CASE WHEN event_id % 6 < 5 THEN 'event ' || event_id END AS headline,
    CASE WHEN event_id % 6 IN (0, 1, 2, 4) THEN 'of ' || event_type END AS body, CASE WHEN event_id % 6 < 3 THEN json_extract_string(props, '$.k') END AS k FROM events""")
def _(t):
    obj = F.to_json(F.struct(F.concat(F.lit("event "), "event_id").alias("headline"), F.concat(F.lit("of "), "event_type").alias("body"), F.get_json_object("props", "$.k").cast("long").alias("k")))
    rows = t.events.select("event_id", "event_type", obj.alias("obj")).select("event_id", F.expr(ANSWER).alias("said"))
    return rows.select("event_id", text.parse_loose(F.col("said"), ["headline", "body", "k"]).alias("p")).select("event_id", "p.*")


@query("txt_search", """WITH q AS (SELECT unnest(['thtion', 'heed', 'the']) AS term), tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents), len AS (SELECT doc_id, count(*) AS dl FROM tok GROUP BY 1),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM q) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, sum(dl)::DOUBLE / count(*) AS avgdl FROM len)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM tf JOIN df USING (term) JOIN len USING (doc_id), st GROUP BY 1""")
def _(t):
    from tessera.operators.search import bm25

    return bm25(t.documents, ["thtion", "heed", "the"]).withColumn("score", F.round("score", 6))


@query("txt_search_phrase", """SELECT doc_id, n, CASE WHEN lo > 1 THEN '...' ELSE '' END || substr(text, lo, hi - lo + 1) || CASE WHEN hi < length(text) THEN '...' ELSE '' END AS snippet FROM (SELECT doc_id, text, (length(text) - length(replace(lower(text), 'of the', ''))) // 6 AS n,
    greatest(instr(lower(text), 'of the') - 75, 1) AS lo, least(instr(lower(text), 'of the') + 80, length(text)) AS hi FROM documents WHERE contains(lower(text), 'of the'))""")
def _(t):
    from tessera.operators.search import phrase_search

    return phrase_search(t.documents, "of the")


@query("srt_relevance", "SELECT doc_id, n FROM (SELECT doc_id, len(regexp_extract_all(lower(text), 'heed')) AS n FROM documents) WHERE n > 0 ORDER BY n DESC, doc_id LIMIT 20")
def _(t):
    rows = t.documents.select("doc_id", F.regexp_count(F.lower("text"), F.lit("heed")).cast("long").alias("n")).filter("n > 0")
    return rows.orderBy(F.desc("n"), "doc_id").limit(20)


@query("txt_search_page", "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'of the') ORDER BY doc_id LIMIT 20")
def _(t):
    return t.documents.filter(F.contains(F.lower("text"), F.lit("of the"))).orderBy("doc_id").limit(20).select("doc_id", "source")


@query("agg_tfidf", """WITH tok AS (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM documents), f AS (SELECT source, w, count(*) AS f FROM tok GROUP BY 1, 2), df AS (SELECT w, count(*) AS df FROM f GROUP BY 1),
tot AS (SELECT source, sum(f) AS total FROM f GROUP BY 1), s AS (SELECT f.source, f.w, round(f.f::DOUBLE / tot.total * ln((SELECT count(*) FROM tot)::DOUBLE / (1 + df.df)), 9) AS score FROM f JOIN df USING (w) JOIN tot USING (source))
SELECT source, w, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, w) AS rank FROM s) WHERE rank <= 15""")
def _(t):
    from tessera.operators.search import tfidf

    return top_per_key(tfidf(t.documents, "source").withColumn("score", F.round("score", 9)), ["source"], 15, F.desc("score"), F.col("w"))


@query("agg_numeric_mentions", "SELECT source, count(*) AS mentions, round(avg(v), 6) AS mean FROM (SELECT source, unnest(regexp_extract_all(text, '\\b([0-9]{1,3})\\b', 1))::INT AS v FROM documents) WHERE v > 0 AND v < 110 GROUP BY 1")
def _(t):
    rows = t.documents.select("source", F.explode(text.find_all(TEXT(), r"\b([0-9]{1,3})\b", 1)).alias("v")).withColumn("v", F.col("v").cast("int"))
    return rows.filter("v > 0 AND v < 110").groupBy("source").agg(n("mentions"), F.round(F.avg("v"), 6).alias("mean"))


#: sector (here a language), axis, category, keyword.
TAXONOMY = [
    ("en", "tech", "chip", "Tion"), ("en", "tech", "chip", "ing"), ("en", "tech", "soft", "tions"), ("en", "land", "farm", "the th"), ("en", "land", "wood", "zzz"),
    ("de", "tech", "chip", "keit"), ("de", "land", "wood", "sch"), ("de", "land", "wood", "Schein"), ("fr", "land", "farm", "eau"), ("fr", "tech", "soft", "ai"), ("es", "land", "wood", "ción"),
]
_TAXONOMY = ", ".join(map(str, TAXONOMY))
_SAID = "(length(lower({0})) - length(replace(lower({0}), lower(keyword), ''))) // length(keyword)".format


@query("t_taxonomy", f"""SELECT doc_id, axis, category, n, CASE WHEN n >= 5 AND core > 0 THEN 'HIGH' WHEN n >= 5 OR (n >= 2 AND core > 0) THEN 'MEDIUM' ELSE 'LOW' END AS confidence, matched FROM (
    SELECT doc_id, axis, category, sum(n)::INT AS n, sum(c) AS core, string_agg(keyword, '|' ORDER BY keyword) FILTER (WHERE n > 0) AS matched FROM (
    SELECT doc_id, axis, category, keyword, {_SAID("text")} AS n, {_SAID("core")} AS c FROM (SELECT doc_id, lang, text, {parted.EVIDENCE_SQL} AS core FROM documents) JOIN (VALUES {_TAXONOMY}) x(sector, axis, category, keyword) ON sector = lang) GROUP BY 1, 2, 3) WHERE n > 0""")
def _(t):
    rows = t.documents.select("doc_id", "lang", "text", parted.parted()[0].alias("core"))  # the sentences with a key word stand for core sections
    return tags(rows, ["doc_id"], "lang", "text", "core", TAXONOMY).withColumn("matched", F.array_join("matched", "|"))


@query("c_email_score", """SELECT id, email, s, CASE WHEN s >= 80 THEN 'A' WHEN s >= 60 THEN 'B' WHEN s >= 40 THEN 'C' ELSE 'D' END AS grade FROM (SELECT c.id, c.email, CASE WHEN split_part(c.email, '@', 2) = regexp_extract(h.hm_url, 'www\\.([^/]+)', 1) THEN 50 WHEN c.id % 2 = 0 THEN -5 ELSE -25 END
    + CASE WHEN c.email LIKE 'ir@%' THEN 35 WHEN c.email LIKE 'hr@%' THEN -35 ELSE 0 END + CASE WHEN h.hm_url LIKE '%/ir%' THEN 15 ELSE 0 END AS s FROM contacts c JOIN companies h USING (corp_code) WHERE c.email LIKE '%@%')""")
def _(t):
    rows = t.contacts.filter("email LIKE '%@%'").join(t.companies.select("corp_code", "hm_url"), "corp_code")
    domain = F.when(F.split_part("email", F.lit("@"), F.lit(2)) == F.regexp_extract("hm_url", r"www\.([^/]+)", 1), 50).when(F.col("id") % 2 == 0, -5).otherwise(-25)
    prefix = F.when(F.col("email").startswith("ir@"), 35).when(F.col("email").startswith("hr@"), -35).otherwise(0)
    s = F.col("s")
    rows = rows.withColumn("s", domain + prefix + F.when(F.contains("hm_url", F.lit("/ir")), 15).otherwise(0))
    return rows.select("id", "email", "s", F.when(s >= 80, "A").when(s >= 60, "B").when(s >= 40, "C").otherwise("D").alias("grade"))


# Filters over text


@query("flt_noise_partner", "SELECT DISTINCT partner_name FROM edges WHERE length(partner_name) <= 60 AND NOT regexp_matches(partner_name, '[13579]$')")
def _(t):
    return t.edges.select("partner_name").distinct().filter((F.length("partner_name") <= 60) & ~F.col("partner_name").rlike("[13579]$"))


NOISE_SQL = "CASE WHEN w IS NULL OR length(trim(w)) < 2 THEN 'TOO_SHORT' WHEN length(w) > 60 THEN 'TOO_LONG' WHEN lower(w) IN ('other', 'total', 'various') THEN 'GENERIC' WHEN regexp_matches(w, '^[0-9]') THEN 'DIGIT_START' WHEN regexp_matches(w, '\\([^)]{15,}\\)') THEN 'LONG_PAREN' END"


@query("flt_noise_reason", f"SELECT doc_id, reason, count(*) AS n FROM (SELECT doc_id, {NOISE_SQL} AS reason FROM (SELECT doc_id, unnest({parted.SENTENCES_SQL}) AS w FROM documents)) GROUP BY ALL")
def _(t):
    parts = t.documents.select("doc_id", F.explode(text.sentences(F.col("text"))).alias("w"))
    return parts.groupBy("doc_id", text.is_noise(F.col("w")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("flt_noise_pattern", "SELECT doc_id FROM documents WHERE length(text) > 38 AND (regexp_matches(text, '^[0-9A-Z]\\)') OR regexp_matches(text, '(ing|ed)\\.$') OR regexp_matches(text, '^[0-9]'))")
def _(t):
    return t.documents.filter((F.length("text") > 38) & (TEXT().rlike(r"^[0-9A-Z]\)") | TEXT().rlike(r"(ing|ed)\.$") | TEXT().rlike("^[0-9]"))).select("doc_id")


CLEAN = {"SHORT": "length(text) < 60", "DIGITS": "text RLIKE '[0-9]{6,}'", "SHOUT": "text RLIKE '!!'", "TABLE": "text RLIKE '[|]'"}
CLEAN_SQL = {k: v.replace("text RLIKE ", "regexp_matches(text, ") + (")" if "RLIKE" in v else "") for k, v in CLEAN.items()}


@query("flt_clean_cascade", "SELECT coalesce(" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in CLEAN_SQL.items()) + ", 'KEPT') AS rule, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    rule = F.coalesce(first_match([(k, F.expr(c)) for k, c in CLEAN.items()]), F.lit("KEPT"))
    return t.documents.groupBy(rule.alias("rule")).agg(n())


@query("flt_clean_overlap", "SELECT " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {k.lower()}" for k, c in CLEAN_SQL.items()) + " FROM documents")
def _(t):
    return t.documents.agg(*[F.count_if(F.expr(c)).alias(k.lower()) for k, c in CLEAN.items()])


@query("flt_exclude_names", "SELECT corp_code FROM companies WHERE NOT regexp_matches(corp_name, '13|77|5$') AND NOT contains(sector, 'FURN')")
def _(t):
    return t.companies.filter(~F.col("corp_name").rlike("13|77|5$") & ~F.contains("sector", F.lit("FURN"))).select("corp_code")


@query("flt_english_dominant", "SELECT doc_id FROM documents WHERE length(text) >= 50 AND len(regexp_extract_all(text, '[A-Za-z]')) > 20 AND len(regexp_extract_all(text, '[à-ÿß]')) * 100 < 2 * length(text)")
def _(t):
    foreign = F.regexp_count("text", F.lit("[à-ÿß]"))
    return t.documents.filter((F.length("text") >= 50) & (F.regexp_count("text", F.lit("[A-Za-z]")) > 20) & (foreign * 100 < 2 * F.length("text"))).select("doc_id")


@query("flt_english_response", "SELECT msg_id FROM messages WHERE direction = 'outbound' AND ((len(regexp_extract_all(body, '[à-ÿß]')) < 20 AND len(regexp_extract_all(body, '[a-z]')) > 200) OR len(regexp_extract_all(body, '[a-z]')) > 40 * len(regexp_extract_all(body, '[à-ÿß]')))")
def _(t):
    foreign, latin = F.regexp_count("body", F.lit("[à-ÿß]")), F.regexp_count("body", F.lit("[a-z]"))
    return t.messages.filter((F.col("direction") == "outbound") & (((foreign < 20) & (latin > 200)) | (latin > 40 * foreign))).select("msg_id")


@query("flt_misnamed", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^[a-z]+ [a-z]+$') AND NOT regexp_matches(p_name, 'ring|bolt')")
def _(t):
    return t.part.filter(F.col("p_name").rlike("^[a-z]+ [a-z]+$") & ~F.col("p_name").rlike("ring|bolt")).select("p_partkey")


# Numbers


@query("num_parse_amount", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -round(o_totalprice, 2) WHEN o_orderkey % 3 = 1 THEN round(o_totalprice, 2) END AS amount FROM orders")
def _(t):
    plain = F.format_number("o_totalprice", 2)
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("("), plain, F.lit(")"))).when(F.col("o_orderkey") % 3 == 1, plain).otherwise("-")
    return t.orders.select("o_orderkey", numbers.parse_amount(shown).alias("amount"))


@query("num_parse_unit", "SELECT p_partkey, p_size * CASE p_partkey % 4 WHEN 0 THEN 1e12 WHEN 1 THEN 1e9 WHEN 2 THEN 1e6 ELSE 1 END AS amount FROM part")
def _(t):
    unit = F.element_at(F.array(*map(F.lit, ("trillion", "Billion", "million", "units"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.part.select("p_partkey", numbers.parse_unit(F.concat(F.col("p_size").cast("string"), F.lit(" "), unit)).alias("amount"))


@query("num_extract_units", f"SELECT doc_id, len(x) AS n, len(list_filter(x, lambda v: v.per_cent)) AS shares, list_max(list_transform(x, lambda v: v.value)) AS largest FROM (SELECT doc_id, {numbers.lex_sql('body')} AS x FROM (SELECT doc_id, {WITH_UNITS_SQL} AS body FROM documents))")
def _(t):
    rows = t.documents.select("doc_id", numbers.lex(with_units(TEXT())).alias("x"))
    return rows.select("doc_id", F.size("x").cast("long").alias("n"), F.size(F.filter("x", lambda v: v["per_cent"])).cast("long").alias("shares"), F.array_max("x.value").alias("largest"))


RATIOS = {"debt_ratio": ("total_liabilities", "total_equity"), "equity_ratio": ("total_equity", "total_assets"), "current_ratio": ("current_assets", "current_liabilities"), "cash_ratio": ("cash", "current_liabilities"), "operating_margin": ("operating_income", "revenue"), "net_margin": ("net_income", "revenue"), "roe": ("net_income", "total_equity"), "roa": ("net_income", "total_assets")}


@query("num_ratios", "SELECT corp_code, fiscal_year, " + ", ".join(f"round({a}::DOUBLE / nullif({b}, 0) * 100, 4) AS {k}" for k, (a, b) in RATIOS.items()) + ", round(revenue::DOUBLE / nullif(inventory, 0), 4) AS inventory_turnover FROM financials")
def _(t):
    turnover = F.round(F.try_divide(F.col("revenue").cast("double"), F.col("inventory").cast("double")), 4)
    return t.financials.select("corp_code", "fiscal_year", *[numbers.per_cent(F.col(a), F.col(b)).alias(k) for k, (a, b) in RATIOS.items()], turnover.alias("inventory_turnover"))


NEWS_STEPS = [(0, 100), (2, 85), (5, 65), (10, 45), (20, 25)]


@query("num_buckets", f"SELECT corp_code, n, {numbers.ladder_sql('n', NEWS_STEPS, 10)} AS score FROM (SELECT corp_code, count(*) AS n FROM disclosures GROUP BY 1)")
def _(t):
    return t.disclosures.groupBy("corp_code").agg(n()).withColumn("score", numbers.ladder(F.col("n"), NEWS_STEPS, 10))


@query("num_weighted_int", "SELECT id, trunc(severity * 20 * 0.4::DOUBLE + coalesce(signal_count, 0) * 0.3::DOUBLE + coalesce(score, 50) * 0.3::DOUBLE)::INT AS score FROM leads LEFT JOIN (SELECT lead_id AS id, score FROM drafts) USING (id)")
def _(t):
    rows = t.leads.select("id", "severity", "signal_count").join(t.drafts.select(F.col("lead_id").alias("id"), "score"), "id", "left")
    return rows.select("id", numbers.weighted_int((F.col("severity") * 20, 0.4), (F.coalesce("signal_count", F.lit(0)), 0.3), (F.coalesce("score", F.lit(50)), 0.3)).alias("score"))


#: What a lead says in numbers: a share, and two amounts.
SAID_SQL = "title || ': ' || signal_count || '% and ' || signal_count * 9 || '만, of ' || signal_count % 7 || '백만'"


@query("num_tolerance_match", f"""SELECT id, count(*) AS tested, count(*) FILTER (WHERE len(list_filter(coalesce(truth, []), lambda v: {numbers.agrees_sql('x.value', 'x.per_cent', 'v')})) > 0) AS matched
    FROM (SELECT id, corp_code, unnest({numbers.lex_sql(SAID_SQL)}) AS x FROM leads) LEFT JOIN (SELECT corp_code, list_concat(amounts, ratios) AS truth FROM ({drafted.TRUTH_SQL})) USING (corp_code) GROUP BY 1""")
def _(t):
    said = F.expr("concat(title, ': ', signal_count, '% and ', signal_count * 9, '만, of ', signal_count % 7, '백만')")
    held = verification.truth(t.financials).select("corp_code", F.array_distinct(F.concat("amounts", "ratios")).alias("truth"))
    held = held.withColumn("large", F.filter("truth", lambda v: v > numbers.LARGE))
    rows = t.leads.select("id", "corp_code", said.alias("said")).join(held, "corp_code", "left")  # a lead meets its company's values as one list
    agreed = lambda found: verification.agreeing(found, F.col("truth"), F.col("large"))
    counts = rows.select("id", text.once(numbers.lex(F.col("said")), lambda found: F.struct(F.size(found).alias("tested"), agreed(found).alias("matched"))).alias("c"))
    return counts.filter("c.tested > 0").groupBy("id").agg(F.sum("c.tested").alias("tested"), F.sum("c.matched").alias("matched"))


@query("num_grade", "SELECT draft_id, CASE WHEN score >= 85 THEN 'NEW_STRONG' WHEN score >= 70 THEN 'NEW' WHEN score >= 60 THEN 'MAYBE' WHEN score >= 50 THEN 'WEAK' ELSE 'EXISTING' END AS grade FROM drafts")
def _(t):
    s = F.col("score")
    return t.drafts.select("draft_id", F.when(s >= 85, "NEW_STRONG").when(s >= 70, "NEW").when(s >= 60, "MAYBE").when(s >= 50, "WEAK").otherwise("EXISTING").alias("grade"))


@query("num_reply_days", "SELECT thread_id, round(min(epoch_us(sent_at) - s) / 86400000000.0::DOUBLE, 6) AS days FROM messages JOIN (SELECT thread_id, min(epoch_us(sent_at)) AS s FROM messages WHERE direction = 'outbound' GROUP BY 1) USING (thread_id) WHERE direction = 'inbound' AND epoch_us(sent_at) >= s GROUP BY 1")
def _(t):
    us = F.unix_micros("sent_at")
    first = t.messages.filter("direction = 'outbound'").groupBy("thread_id").agg(F.min(us).alias("s"))
    rows = t.messages.filter("direction = 'inbound'").join(first, "thread_id").filter(us >= F.col("s"))
    return rows.groupBy("thread_id").agg(F.round(F.min(us - F.col("s")) / 86400000000.0, 6).alias("days"))


@query("num_signal_rules", financial.SIGNALS_SQL)
def _(t):
    return financial.signals(t.financials).select("corp_code", "fiscal_year", joined("signals").alias("signals"))


@query("f_financial_block", f"WITH s AS ({financial.SIGNALS_SQL}) SELECT s.*, rank FROM s JOIN (SELECT corp_code, fiscal_year, row_number() OVER (PARTITION BY corp_code ORDER BY fiscal_year DESC) AS rank FROM financials) USING (corp_code, fiscal_year) WHERE rank <= 3")
def _(t):
    rows = financial.signals(t.financials).select("corp_code", "fiscal_year", joined("signals").alias("signals"))
    return top_per_key(rows, ["corp_code"], 3, F.desc("fiscal_year"))


_FIXED = lambda x, d: f"printf('%,.{d}f', {x})"


@query("num_fmt", f"""SELECT corp_code, fiscal_year, CASE WHEN v IS NULL THEN 'N/A' WHEN abs(v / 1e8::DOUBLE) >= 10000 THEN {_FIXED("v / 1e8::DOUBLE / 10000", 1)} || '조' ELSE {_FIXED("v / 1e8::DOUBLE", 0)} || '억' END AS shown, CASE WHEN margin IS NULL THEN 'N/A' WHEN margin = 0 THEN '0.0%' ELSE printf('%+.1f%%', round(margin, 1)) END AS share
    FROM (SELECT corp_code, fiscal_year, revenue * 1000003.0::DOUBLE AS v, round(operating_income::DOUBLE / nullif(revenue, 0) * 100, 4) AS margin FROM financials)""")
def _(t):
    margin = numbers.per_cent(F.col("operating_income"), F.col("revenue"))
    return t.financials.select("corp_code", "fiscal_year", numbers.fmt_amount(F.col("revenue") * 1000003.0).alias("shown"), numbers.fmt_per_cent(margin).alias("share"))


@query("d_sector_compare", """SELECT f.corp_code, f.fiscal_year, CASE WHEN f.m > s.m + 1 THEN 'above' WHEN f.m < s.m - 1 THEN 'below' ELSE 'near' END AS level FROM (SELECT corp_code, fiscal_year, sector, operating_income * 100.0::DOUBLE / revenue AS m FROM financials JOIN companies USING (corp_code) WHERE revenue > 0) f
    JOIN (SELECT sector, fiscal_year, round(avg(operating_income * 100.0::DOUBLE / revenue), 6) AS m FROM financials JOIN companies USING (corp_code) WHERE revenue > 0 GROUP BY 1, 2) s USING (sector, fiscal_year)""")
def _(t):
    rows = t.financials.filter("revenue > 0").join(t.companies, "corp_code").withColumn("m", F.col("operating_income") * 100.0 / F.col("revenue")).select("corp_code", "fiscal_year", "sector", "m")
    mean = rows.groupBy("sector", "fiscal_year").agg(F.round(F.avg("m"), 6).alias("mean"))
    level = F.when(F.col("m") > F.col("mean") + 1, "above").when(F.col("m") < F.col("mean") - 1, "below").otherwise("near")
    return rows.join(mean, ["sector", "fiscal_year"]).select("corp_code", "fiscal_year", level.alias("level"))


# Dates


@query("dt_recency_score", f"SELECT id, CASE WHEN abs(d) <= 30 THEN 1.0 WHEN abs(d) <= 60 THEN 0.85 WHEN abs(d) <= 90 THEN 0.7 WHEN abs(d) <= 180 THEN 0.5 ELSE 0.3 END::DOUBLE AS recency FROM (SELECT id, DATE '{AS_OF}' - published_at AS d FROM news)")
def _(t):
    return t.news.select("id", numbers.recency(F.col("published_at"), F.lit(AS_OF).cast("date")).alias("recency"))


PAIRS = [((1, 3), "q3", "h1", 1, 1), ((4, 5), "annual", "q3", 1, 1), ((6, 8), "q1", "annual", 0, 1), ((9, 11), "h1", "q1", 0, 0), ((12, 12), "q3", "h1", 0, 0)]


@query("dt_pair_by_date", "SELECT id, CASE WHEN m <= 3 THEN (y - 1) || '_q3' WHEN m <= 5 THEN (y - 1) || '_annual' WHEN m <= 8 THEN y || '_q1' WHEN m <= 11 THEN y || '_h1' ELSE y || '_q3' END AS latest, CASE WHEN m <= 3 THEN (y - 1) || '_h1' WHEN m <= 5 THEN (y - 1) || '_q3' WHEN m <= 8 THEN (y - 1) || '_annual' WHEN m <= 11 THEN y || '_q1' ELSE y || '_h1' END AS previous FROM (SELECT id, substr(rcept_dt, 5, 2)::INT AS m, substr(rcept_dt, 1, 4)::INT AS y FROM reports)")
def _(t):
    m, y = F.substring("rcept_dt", 5, 2).cast("int"), F.substring("rcept_dt", 1, 4).cast("int")
    latest, previous = F.lit(None).cast("string"), F.lit(None).cast("string")
    for (lo, hi), now, then, back_now, back_then in PAIRS:
        inside = m.between(lo, hi)
        latest = F.when(inside, F.concat_ws("_", (y - back_now).cast("string"), F.lit(now))).otherwise(latest)
        previous = F.when(inside, F.concat_ws("_", (y - back_then).cast("string"), F.lit(then))).otherwise(previous)
    return t.reports.select("id", latest.alias("latest"), previous.alias("previous"))


CHAIN = [("2000_q1", "1999_annual"), ("1999_annual", "1999_q3"), ("1999_q3", "1999_h1"), ("1999_h1", "1999_q1")]


@query("dt_pair_fallback", f"WITH have AS (SELECT DISTINCT corp_code, report_type FROM reports) SELECT a.corp_code, min(i) AS step FROM (VALUES {', '.join(f'({i}, {a!r}, {b!r})' for i, (a, b) in enumerate(CHAIN))}) c(i, now, then_) JOIN have a ON a.report_type = now JOIN have b ON b.report_type = then_ AND a.corp_code = b.corp_code GROUP BY 1")
def _(t):
    have = t.reports.groupBy("corp_code").agg(F.collect_set("report_type").alias("have"))
    step = F.coalesce(*[F.when(F.array_contains("have", a) & F.array_contains("have", b), i) for i, (a, b) in enumerate(CHAIN)])
    return have.select("corp_code", step.alias("step")).filter("step IS NOT NULL")


@query("dt_filing_window", "SELECT id, CASE WHEN strptime(rcept_dt, '%Y%m%d') BETWEEN make_date(substr(rcept_dt, 1, 4)::INT, 3, 1) AND make_date(substr(rcept_dt, 1, 4)::INT, 4, 10) THEN 'annual' WHEN strptime(rcept_dt, '%Y%m%d') BETWEEN make_date(substr(rcept_dt, 1, 4)::INT, 5, 1) AND make_date(substr(rcept_dt, 1, 4)::INT, 5, 31) THEN 'q1' END AS open_window FROM reports")
def _(t):
    day, y = F.to_date("rcept_dt", "yyyyMMdd"), F.substring("rcept_dt", 1, 4).cast("int")
    on = lambda m, d: F.make_date(y, F.lit(m), F.lit(d))
    return t.reports.select("id", F.when(day.between(on(3, 1), on(4, 10)), "annual").when(day.between(on(5, 1), on(5, 31)), "q1").alias("open_window"))


@query("dt_parse_rfc2822", "SELECT o_orderkey, o_orderdate AS at_time FROM orders")
def _(t):
    shown = F.concat(F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    return t.orders.select("o_orderkey", F.try_to_timestamp(F.regexp_replace(shown, "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss Z")).alias("at_time"))


@query("dt_local_day", "SELECT rcept_no FROM disclosures WHERE ts::DATE = DATE '2024-01-15'")
def _(t):
    return t.disclosures.filter(F.to_date("ts") == F.lit("2024-01-15").cast("date")).select("rcept_no")


# Arrays and JSON


@query("js_parse_array", "SELECT event_id, [json_extract_string(props, '$.k')::BIGINT, event_id] AS pair, 0 AS n_bad FROM events")
def _(t):
    good = F.concat(F.lit("["), F.get_json_object("props", "$.k"), F.lit(","), "event_id", F.lit("]"))
    bad = F.coalesce(F.from_json(F.lit("[1,"), "array<bigint>"), F.array().cast("array<bigint>"))
    return t.events.select("event_id", F.from_json(good, "array<bigint>").alias("pair"), F.size(bad).alias("n_bad"))


@query("js_array_len", "SELECT event_id, (event_id % 4)::INT AS n FROM events")
def _(t):
    made = F.to_json(F.slice(F.array(*map(F.lit, (1, 2, 3))), F.lit(1), (F.col("event_id") % 4).cast("int")))
    return t.events.select("event_id", F.json_array_length(made).alias("n"))


@query("js_metadata", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, NULL AS missing FROM events")
def _(t):
    meta = F.from_json("props", "k BIGINT, dependence_pct DOUBLE")
    return t.events.select("event_id", meta["k"].alias("k"), meta["dependence_pct"].alias("missing"))


@query("js_tree", "SELECT sector, string_agg(market || ':' || n, ',' ORDER BY market) AS tree FROM (SELECT sector, market, count(*) AS n FROM companies GROUP BY 1, 2) GROUP BY 1")
def _(t):
    per = t.companies.groupBy("sector", "market").agg(n())
    leaves = F.array_sort(F.collect_list(F.struct("market", "n")))
    return per.groupBy("sector").agg(F.array_join(F.transform(leaves, lambda x: F.concat_ws(":", x["market"], x["n"].cast("string"))), ",").alias("tree"))


@query("arr_slice_caps", "SELECT partner_name, array_to_string((list_sort(list(DISTINCT corp_code)))[1:5], ',') AS first5 FROM edges GROUP BY 1")
def _(t):
    return t.edges.groupBy("partner_name").agg(joined(F.slice(F.array_sort(F.collect_set("corp_code")), 1, 5), ",").alias("first5"))
