"""Kinds of change that texts speak of."""

from __future__ import annotations

from pyspark.sql import Column

from tessera.functions import text


def _of(*words: str) -> str:
    return "(?:" + "|".join(words) + ")"


#: How a verb ends in the past: did, was done; and the same as a fact.
DID, FACT = "(?:했|됐)", r"(?:했|됐|한\s*것)"
# What families of changes say, in the order that settles ties. 
FAMILIES = {
    "NEW": [
        r"신규\s*" + _of("사업", "진출", "추가", "등장", "편입", "출시", "도입", "투자", "법인"), r"새롭게\s*" + _of("추가", "등장", "시작", "진출"), r"새로운\s*" + _of("사업", "영역", "분야", "법인"),
        r"처음(?:으로)?\s*" + _of("등장", "진출", "시작", "편입", "추가", "언급"), r"본격[적화]?\s*" + _of("진출", "착수"), "신설[했됐된]", r"기존엔?\s*없었" + _of("으나", "던"), r"이번에\s*처음",
    ],
    "REMOVED": [_of("폐지", "청산", "중단", "매각", "양도") + FACT, _of("제외", "삭제") + r"(?:됐|되었|한\s*것)", r"기존(?:에는?)?\s*있었" + _of("으나", "던"), r"사업\s*철수|법인\s*해산"],
    "EXPANDED": [_of("확대", "확장", "증설") + DID, r"비중\s*" + _of("증가", "상승", "확대"), r"점유율\s*" + _of("상승", "증가"), r"매출\s*비중.*" + _of("증가", "상승", "확대")],
    "SHRUNK": [_of("축소", "감축") + DID, r"비중\s*" + _of("감소", "하락", "축소"), r"점유율\s*" + _of("하락", "감소"), r"인력\s*" + _of("감축", "구조조정")],
    "CHANGED": [_of("변경", "전환", "개편", "통합", "분리", "조정") + DID],
}


def change_of(c: Column) -> Column:
    """The family with most hits, of equals the first; UNKNOWN for a text with none, empty or null."""
    return text.best_family(c, FAMILIES, "UNKNOWN")
