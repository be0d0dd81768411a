"""Column expressions over contacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text

MOST_BOUNCES = 3


def is_placeholder(email: str = "email") -> Column:
    return F.substring(email, 1, 1) == "_"


def sendable() -> Column:
    """An address that mail may go to: present, no placeholder, active, and not bounced too often."""
    return F.col("email").isNotNull() & ~is_placeholder() & F.col("is_active") & (F.coalesce("bounced_count", F.lit(0)) < MOST_BOUNCES)


def domain_category(host: Column, generic: Sequence[str], agencies: Sequence[str], endings: Sequence[str]) -> Column:
    """none, generic, agency, org or company, by the host of an address."""
    low = F.lower(host)
    org = F.lit(False)
    for e in endings:
        org = org | low.endswith(e)
    return F.when(~F.contains(F.coalesce(low, F.lit("")), F.lit(".")), "none").when(low.isin(*generic), "generic").when(low.isin(*agencies), "agency").when(org, "org").otherwise("company")


# How mails of companies sign, and what is no name or no address of a person.
SURNAMES = "김이박최정강조윤장임한오서신권황안송류전홍고문양손배백허유남심노하곽성차주우구민나진지엄채원천방공현함변염여추도소석선설마길연위표명기반왕금옥육인맹제모탁국어은편복단봉경사부시대담두용예"
LONG_SURNAMES = ["황보", "남궁", "선우", "독고", "동방", "서문", "제갈", "사공", "어금"]
NO_PERSONS = ["대표", "책임", "담당", "문의", "여러", "각종", "각자", "아무런", "최고", "최상", "저는", "관련", "주요", "특별", "신규", "기존", "오늘", "내일", "이상", "이하", "이내", "관계", "주식", "회사"]
TITLES = ["부사장", "전무", "상무", "이사", "본부장", "실장", "팀장", "부장", "차장", "과장", "대리", "사원", "주임", "매니저", "선임", "책임", "수석", "Director", "Manager", "VP", "CFO", "CEO", "CTO", "CMO"]
TITLED = r"([가-힣]{2,4})\s*[(\[]?\s*(" + "|".join(TITLES) + ")"
DEPARTMENT = "(IR|PR|홍보|커뮤니케이션|투자홍보|재무|기획|경영지원|대외협력|마케팅)\\s*(팀|실|부|본부|그룹)?"
ADDRESS = r"[A-Za-z0-9._+-]+@[A-Za-z0-9._-]+\.[A-Za-z]{2,}"
MOBILE = r"(010|011|016|017|018|019)[- .)]?([0-9]{3,4})[- .]([0-9]{4})"
PHONE = r"(0[0-9]{1,2})[- .)]([0-9]{3,4})[- .]([0-9]{4})"
NO_ADDRESSES = ["noreply", "no-reply", "donotreply", "mailer", "postmaster", "webmaster", "admin@"]
#: Words of a contact block's head: behind a mark, in front of a colon, or by themselves; and lines that part it off.
MARKED, WITH_COLON, ALONE = ["문의", "담당", "Contact"], ["문의처?", "담당자?", "연락처", "Contact"], [r"취재\s*문의", r"보도\s*문의"]
BLOCK_STARTS = rf"[■※*]\s*(?:{'|'.join(MARKED)})|(?:{'|'.join(WITH_COLON)})\s*[:：]|{'|'.join(ALONE)}|#{{2,}}|={{3,}}|-{{5,}}"


def contact_block(c: Column, reach: int = 1500) -> Column:
    """The reach characters from the first sign of a contact block on; without one, the text's last."""
    at = F.regexp_instr(c, F.lit(BLOCK_STARTS))
    return F.when(at > 0, F.substr(c, at, F.lit(reach))).otherwise(F.right(c, F.lit(reach)))


def is_person(name: Column) -> Column:
    """Two to four Hangul characters that begin with a known surname and are no common word."""
    known = F.contains(F.lit(SURNAMES), F.substring(name, 1, 1)) | F.substring(name, 1, 2).isin(*LONG_SURNAMES)
    return name.rlike("^[가-힣]{2,4}$") & known & ~name.isin(*NO_PERSONS)


def people(c: Column) -> Column:
    """(name, title) of persons that stand before a title, in order."""
    found = F.arrays_zip(F.regexp_extract_all(c, F.lit(TITLED), F.lit(1)).alias("name"), F.regexp_extract_all(c, F.lit(TITLED), F.lit(2)).alias("title"))
    named = F.transform(found, lambda x: F.struct(x["name"].alias("name"), x["title"].alias("title")))
    return F.filter(named, lambda x: is_person(x["name"]))


def addresses(c: Column) -> Column:
    """Different mail addresses, in order, but for those of machines."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(ADDRESS), F.lit(0)))
    return F.filter(found, lambda e: ~F.exists(F.array(*map(F.lit, NO_ADDRESSES)), lambda w: F.contains(F.lower(e), w)))


def numbers_of(c: Column, pattern: str) -> Column:
    """Different telephone numbers of a pattern of three groups, written with hyphens, in order."""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.concat_ws("-", *[F.regexp_extract(x, pattern, k) for k in (1, 2, 3)])))


def signature(block: Column) -> Column:
    """name, title, dept, mobile, phone, email of a contact block, each the first found; null where there is none."""
    first = lambda a: F.get(a, F.lit(0))
    found = F.struct(first(people(block)).alias("person"), first(numbers_of(block, MOBILE)).alias("mobile"))
    return text.once(found, lambda x: _signed(block, x["person"], x["mobile"]))


def _signed(block: Column, person: Column, mobile: Column) -> Column:
    first = lambda a: F.get(a, F.lit(0))
    dept = F.concat(F.regexp_extract(block, DEPARTMENT, 1), F.regexp_extract(block, DEPARTMENT, 2))
    phone = first(F.filter(numbers_of(block, PHONE), lambda p: ~p.eqNullSafe(mobile)))
    return F.struct(person["name"].alias("name"), person["title"].alias("title"), F.nullif(dept, F.lit("")).alias("dept"), mobile.alias("mobile"), phone.alias("phone"), first(addresses(block)).alias("email"))


# Phrases by which a reply evades the question.
EVASIONS = ["비공개", "공개 자료 참조", "답변 어렵", "확인 어렵"]


def reply_quality(body: Column) -> Column:
    """A point for each ten characters, 100 at most; 30 less for a reply that evades."""
    points = F.least(F.lit(100), F.floor(F.length(body) / 10)).cast("int")
    evades = F.exists(F.array(*map(F.lit, EVASIONS)), lambda w: F.contains(body, w))
    return F.when(evades, F.greatest(F.lit(0), points - 30)).otherwise(points)
