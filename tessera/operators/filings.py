"""Chapters, sections and named partners of filing texts, all in column expressions.

A null text gives nothing. Texts are read whole; a chapter longer than ``most`` is cut with a
marker, as the filing store has a limit there.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text

# Headings, chapter marks and phrases of the filings' form.

#: code, heading after its number, title
HEADINGS = [
    ("overview", r"사업의\s*개요", "사업의 개요"),
    ("products", r"주요\s*제품(?:\s*및\s*서비스)?", "주요 제품 및 서비스"),
    ("materials", r"원재료(?:\s*및\s*생산설비)?", "원재료 및 생산설비"),
    ("revenue", r"매출\s*(?:및\s*)?수주(?:\s*현황)?", "매출 및 수주현황"),
    ("risk", r"위험관리(?:\s*및\s*파생거래)?", "위험관리 및 파생거래"),
    ("contracts", r"주요계약(?:\s*및\s*연구개발(?:활동)?)?", "주요계약 및 연구개발"),
    ("etc", r"기타\s*참고(?:사항)?", "기타 참고사항"),
]
NEXT_CHAPTER = r"(?:III|IV|Ⅲ|Ⅳ)\.\s"
CHAPTER_STARTS = [r"II\s*[.\s]\s*사\s*업\s*의\s*내\s*용", r"2\s*[.\s]\s*사\s*업\s*의\s*내\s*용", r"제\s*2\s*장\s*사\s*업\s*의\s*내\s*용", r"사\s*업\s*의\s*내\s*용\s*(?=\s)"]
CHAPTER_ENDS = [
    r"III\s*[.\s]\s*재\s*무", r"3\s*[.\s]\s*재\s*무", r"제\s*3\s*장\s*재\s*무", r"III\s*[.\s]\s*주\s*요", r"3\s*[.\s]\s*주\s*요", r"제\s*3\s*장\s*주\s*요", r"Ⅲ\s*[.\s]\s*재\s*무",
    r"Ⅲ\s*[.\s]\s*주\s*요", r"IV\s*[.\s]", r"Ⅳ\s*[.\s]", r"4\s*[.\s]\s*감\s*사", r"V\s*[.\s]", r"Ⅴ\s*[.\s]", r"5\s*[.\s]\s*회\s*계",
]
CUT_MARKER = "\n[이하 생략]"

#: Vocabulary of partner lists, by relation: what a list's heading calls the partners; which words stand before and behind that.
PARTNERS = {
    "customer": ["고객사", "고객기업", "고객", "거래처", "납품처", "판매처", "매출처"],
    "supplier": ["매입처", "구매처", "공급처", "공급업체", "공급사", "원재료", "부품"],
    "partner": ["협력업체", "협력사", "제휴사", "파트너"],
    "competitor": ["경쟁업체", "경쟁기업", "경쟁사"],
}
BEFORE = ["주요", "핵심", "전략적", "국내외", "국내", "해외", "기술"]
BEHIND = ["현황", "목록", "내역", "리스트", "구성", "명단", "구매", "매입"]
#: What begins a phrase and not a name, and what a table's head or figures say.
NOT_FIRST = ["상기", "이하", "아래", "해당", "기타", "그외", "또한", "따라서", "하지만", "위와", "등"]
MEASURES = ["단위", "억원", "백만원", "천원", "매출액", "점유율", "비중", "구성비", "%"]
#: Lines of a list at most, and characters of a line that heads one.
LIST_LINES, HEAD_CHARS = 30, 40

#: Stand before a heading and before the next chapter while a text is cut.
HEADING, CHAPTER = "\u0001", "\u0002"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, with c computed once however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def sections(filings: DataFrame, key: str, body: str, least: int = 20, whole: int = 100) -> DataFrame:
    """(key, code, title, content, n): each heading's section, up to the next heading; the last one up to the next chapter.

    Texts under ``whole`` characters have no sections; sections under ``least`` are left out. Every pattern runs once over a
    text, and a section's code and title come from one look at its heading's stem.
    """
    c = F.translate(body, HEADING + CHAPTER, "  ")
    c = F.regexp_replace(c, rf"(?m)^(?=\s*\d+\.\s*(?:{'|'.join(h for _, h, _ in HEADINGS)}))", HEADING)
    c = F.regexp_replace(c, rf"(?m)^(?=\s*{NEXT_CHAPTER})", CHAPTER)
    stems = [h.split("(")[0].removesuffix(r"\s*") for _, h, _ in HEADINGS]
    names = F.create_map(*[x for stem, (code, _, title) in zip(stems, HEADINGS) for x in (F.lit(stem.replace(r"\s*", "")), F.struct(F.lit(code).alias("code"), F.lit(title).alias("title")))])

    def named(content: Column) -> Column:
        stem = F.regexp_extract(content, rf"^\d+\.\s*({'|'.join(stems)})", 1)
        return F.struct(names[F.regexp_replace(stem, r"\s", "")].alias("name"), content.alias("content"), F.length(content).cast("long").alias("n"))

    def cut(parts: Column) -> Column:
        ends = lambda p, i: F.when(i == F.size(parts) - 1, F.substring_index(p, CHAPTER, 1)).otherwise(F.translate(p, CHAPTER, ""))
        contents = F.transform(parts, lambda p, i: F.when(i > 0, strip(ends(p, i))))
        return F.transform(F.filter(contents, lambda p: F.length(p) >= least), named)

    rows = filings.filter(F.length(body) >= whole).select(key, F.inline(_once(F.split(c, HEADING), cut)))
    return rows.select(key, "name.code", "name.title", "content", "n")


def chapter(c: Column, starts: Sequence[str] = CHAPTER_STARTS, ends: Sequence[str] = CHAPTER_ENDS, least: int = 300, most: int = 80_000, gap: int = 50) -> Column:
    """The business chapter: from the second match of the first start that occurs (the first match is the table of contents), or its only one, to the nearest end.

    Ends within ``gap`` characters don't count. Null if there is no start or under ``least`` characters.
    """
    found = []
    for p in starts:
        first = F.regexp_instr(c, F.lit(p))
        after = first + F.length(F.regexp_extract(c, p, 0))
        again = F.regexp_instr(F.substr(c, after), F.lit(p))
        found.append(F.when(first > 0, F.when(again > 0, after + again - 1).otherwise(first)))
    def to_end(rest: Column) -> Column:
        at = F.array(*[F.regexp_instr(rest, F.lit(p)) for p in ends])
        return F.coalesce(F.array_min(F.filter(at, lambda p: p > gap + 1)) - 1, F.length(rest))

    out = _once(F.substr(c, F.coalesce(*found)), lambda body: strip(F.substr(body, F.lit(1), _once(F.substr(body, F.lit(11)), to_end) + 10)))
    return _once(out, lambda o: F.when(F.length(o) < least, None).when(F.length(o) > most, F.concat(F.substring(o, 1, most), F.lit(CUT_MARKER))).otherwise(o))


def _any(words: Sequence[str]) -> str:
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


def list_head(line: Column, partners: Mapping[str, Sequence[str]], before: Sequence[str], behind: Sequence[str]) -> Column:
    """The relation that a line heads a list of, or null.

    A head names a kind of partner, with a word of ``before`` in front of it, one of ``behind`` after it, or a colon; marks may stand first, and few
    words behind. Spaces don't matter.
    """
    bare = F.translate(line, " \t", "")
    kinds = []
    for relation, words in partners.items():
        kind = _any(words)
        kinds.append(F.when(bare.rlike(rf"^(?:[가-하][.)])?[^\p{{L}}]*(?:{_any(before)}{kind}|{kind}{_any(behind)}|{kind}(?=[:：]))[^:：,]{{0,12}}(?:[:：]|$)"), relation))
    return F.when((F.length(line) <= HEAD_CHARS) | F.contains(line, F.lit(":")) | F.contains(line, F.lit("：")), F.coalesce(*kinds))


def is_name(name: Column) -> Column:
    """Whether a cell can be a partner's name: 2 to 60 characters with a letter in front of its figures, neither a phrase nor a table's head."""
    short_word = name.rlike(r"^[가-힣]{1,2}$")
    phrase = name.rlike(rf"^{_any(NOT_FIRST)}") | name.rlike(r"^[\d(]*\d{4}[)]?년|^표\s*\d")
    measure = F.exists(F.array(*map(F.lit, MEASURES)), lambda m: F.contains(name, m))
    return F.length(name).between(2, 60) & name.rlike(r"\p{L}") & ~short_word & ~phrase & ~measure


def names_of(line: Column) -> Column:
    """Partner names of a list's line: the items, if it lists some; else the first cell of its row."""
    cells = F.split(line, r"\t|\||\s{2,}")
    items = F.when((F.size(cells) == 1) & line.rlike("[,;、]"), F.split(line, r"[,;、](?![^(]*\))")).otherwise(F.slice(cells, 1, 1))
    return F.filter(F.transform(items, text.clean_partner), is_name)


def relations(filings: DataFrame, key: str, body: str, partners: Mapping[str, Sequence[str]] = PARTNERS, before: Sequence[str] = BEFORE, behind: Sequence[str] = BEHIND, context: bool = True) -> DataFrame:
    """(key, relation, name, and context if wanted): partners that a text lists under a heading or behind a colon.

    A list goes on to an empty line, the next heading of a list or section, or LIST_LINES lines. A name counts once a relation,
    whatever its case, as it is first written; the context is its list's heading and its line, 200 characters at most.
    """

    def marked(line: Column, i: Column) -> Column:
        relation = list_head(line, partners, before, behind)
        said = F.nullif(F.trim(F.regexp_extract(line, "[:：](.*)$", 1)), F.lit(""))
        ends = (line == "") | line.rlike(rf"^(?:\d+\.|{NEXT_CHAPTER})\s*[가-힣]")
        return F.struct(line.alias("line"), relation.alias("relation"), F.when(relation.isNotNull(), said).alias("said"), ends.alias("ends"), i.alias("i"))

    def listed(lines: Column) -> Column:
        def block(head: Column) -> Column:
            rest = F.slice(lines, head["i"] + 2, F.lit(LIST_LINES))
            end = F.array_position(F.transform(rest, lambda x: x["ends"] | x["relation"].isNotNull()), True).cast("int")
            own = F.transform(F.slice(rest, F.lit(1), F.when(end > 0, end - 1).otherwise(LIST_LINES)), lambda x: x["line"])
            return F.struct(head["relation"].alias("relation"), head["line"].alias("head"), F.when(head["said"].isNotNull(), F.array(head["said"])).otherwise(own).alias("lines"))

        return F.transform(F.filter(lines, lambda x: x["relation"].isNotNull()), block)

    lines = F.transform(F.split(body, "\n"), strip)
    rows = filings.filter(F.col(body).isNotNull()).select(key, F.posexplode(_once(F.transform(lines, marked), listed)).alias("at", "b"))
    rows = rows.select(key, "b.relation", "b.head", "at", F.posexplode("b.lines").alias("row", "line"))
    said = [F.substring(F.concat_ws(" ", "head", F.when(F.col("line") != F.col("head"), F.col("line"))), 1, 200).alias("context")] if context else []
    rows = rows.select(key, "relation", "at", "row", *said, F.posexplode(names_of(F.col("line"))).alias("nth", "name"))
    kept = ["name", "context"] if context else ["name"]
    first = F.min_by(F.struct(*kept), F.struct("at", "row", "nth")).alias("first")
    return rows.groupBy(key, "relation", F.lower("name").alias("low")).agg(first).select(key, "relation", *[f"first.{c}" for c in kept])
