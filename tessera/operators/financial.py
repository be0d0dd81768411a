"""Signals from yearly figures: stocks, cash and debt, margins and returns.

Conditions are plain SQL over doubles, so the same text holds in Spark and in the SQL that checks it.
A figure that is null, or a division by zero, makes no signal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Figures with those of the year before (p_) and the one before that (pp_).
FIGURES = ["revenue", "operating_income", "net_income", "operating_cf", "total_liabilities", "total_equity", "total_assets", "current_liabilities", "cash", "inventory"]


def _per_cent(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / nullif({b}, 0) * 100"


def _change(x: str) -> str:
    return f"CAST({x} - p_{x} AS DOUBLE) / nullif(abs(p_{x}), 0) * 100"


def _days(p: str) -> str:
    return f"CASE WHEN {p}inventory > 0 AND {p}revenue > 0 THEN CAST(365 AS DOUBLE) / (CAST({p}revenue AS DOUBLE) / {p}inventory) END"


#: What conditions are made of.
MEASURES = {
    "stock_change": _change("inventory"), "sales_change": _change("revenue"), "cash_change": _change("cash"), "days": _days(""), "p_days": _days("p_"),
    "debt": f"nullif({_per_cent('total_liabilities', 'total_equity')}, 0)", "p_debt": f"nullif({_per_cent('p_total_liabilities', 'p_total_equity')}, 0)",
    "cash_ratio": _per_cent("cash", "current_liabilities"), "margin": _per_cent("operating_income", "revenue"), "p_margin": _per_cent("p_operating_income", "p_revenue"),
    "roe": _per_cent("net_income", "total_equity"), "p_roe": _per_cent("p_net_income", "p_total_equity"), "equity_share": _per_cent("total_equity", "total_assets"),
    "net_margin": _per_cent("net_income", "revenue"), "quality": "CAST(operating_cf AS DOUBLE) / nullif(net_income, 0)",
    "months": "CASE WHEN operating_cf < 0 AND cash > 0 THEN CAST(cash AS DOUBLE) / abs(operating_cf) * 12 END", "cover": "CAST(nullif(cash, 0) AS DOUBLE) / nullif(total_liabilities, 0)",
    "leverage": f"CASE WHEN total_equity > 0 THEN CAST(100 AS DOUBLE) / ({_per_cent('total_equity', 'total_assets')}) END",
}

#: The thresholds. Of each group at most one signal, the first that holds.
GROUPS = [
    [("DAYS_RISK", "stock_change IS NOT NULL AND days > 120 AND days - p_days > 30"), ("DAYS_CARE", "stock_change IS NOT NULL AND days > 90 AND days - p_days > 20"), ("DAYS_BETTER", "stock_change IS NOT NULL AND days - p_days < -20 AND days < 60")],
    [("STOCK_TURNS", "pp_inventory <> 0 AND inventory <> 0 AND p_inventory > pp_inventory AND inventory < p_inventory")],
    [("STOCK_PILES_UP", "stock_change >= 20 AND (sales_change IS NULL OR sales_change < 5)"), ("STOCK_FOR_GROWTH", "stock_change >= 10 AND sales_change >= 10"), ("STOCK_LEAN", "stock_change <= -15 AND sales_change >= 5"), ("DEMAND_SHRINKS", "stock_change <= -10 AND sales_change < 0")],
    [("QUALITY_WORST", "cash IS NOT NULL AND net_income > 0 AND operating_cf < 0"), ("QUALITY_LOW", "cash IS NOT NULL AND quality < 0.5 AND net_income > 0"), ("QUALITY_HIGH", "cash IS NOT NULL AND quality > 1.5")],
    [("RUNWAY_RISK", "months < 12"), ("RUNWAY_CARE", "months < 24")],
    [("CASH_STRONG", "cover >= 0.5"), ("LIQUIDITY_RISK", "cover IS NOT NULL AND current_liabilities <> 0 AND cash * 10 < current_liabilities")],
    [("FUNDS_RISK", "cash_change <= -20 AND debt - p_debt >= 10"), ("FUNDS_BETTER", "cash_change >= 15 AND debt - p_debt <= -5"), ("CASH_FALLS", "cash_change <= -15 AND debt - p_debt IS NOT NULL"), ("LEVERAGE_UP", "cash_change IS NOT NULL AND debt - p_debt >= 20")],
    [("LIQUIDITY_AND_LEVERAGE", "cash_ratio < 20 AND debt > 150")],
    [("OPERATING_LOSS", "margin - p_margin <= -5 AND margin < 0"), ("MARGIN_FALLS", "margin - p_margin <= -5"), ("MARGIN_RISES", "margin - p_margin >= 5")],
    [("ROE_BY_LEVERAGE", "has_before AND net_margin IS NOT NULL AND roe >= 15 AND leverage > 3"), ("ROE_SOUND", "has_before AND net_margin IS NOT NULL AND equity_share IS NOT NULL AND roe >= 15 AND (leverage IS NULL OR leverage <= 2)"), ("EQUITY_ERODES", "has_before AND net_margin IS NOT NULL AND equity_share IS NOT NULL AND roe < 0")],
    [("ROE_RISES", "roe - p_roe >= 5 AND roe > 0"), ("ROE_FALLS", "roe - p_roe <= -5")],
]


def _group(rules) -> str:
    return "CASE " + " ".join(f"WHEN {condition} THEN '{code}'" for code, condition in rules) + " END"


def signals(financials: DataFrame) -> DataFrame:
    """(corp_code, fiscal_year, signals): codes in alphabetical order, a row a company and year."""
    w = Window.partitionBy("corp_code").orderBy("fiscal_year")
    rows = financials.select("corp_code", "fiscal_year", *FIGURES, *[F.lag(x, k).over(w).alias("p" * k + "_" + x) for x in FIGURES for k in (1, 2)], (F.lag("fiscal_year").over(w)).isNotNull().alias("has_before"))
    rows = rows.select("*", *[F.expr(e).alias(name) for name, e in MEASURES.items()])
    codes = F.array_sort(F.array_compact(F.array(*[F.expr(_group(g)) for g in GROUPS])))
    return rows.select("corp_code", "fiscal_year", codes.alias("signals"))


SIGNALS_SQL = (
    "SELECT corp_code, fiscal_year, array_to_string(list_sort(list_filter([" + ", ".join(map(_group, GROUPS)) + "], lambda x: x IS NOT NULL)), '|') AS signals FROM (SELECT *, "
    + ", ".join(f"{e} AS {name}" for name, e in MEASURES.items()) + " FROM (SELECT *, lag(fiscal_year) OVER w IS NOT NULL AS has_before, "
    + ", ".join(f"lag({x}, {k}) OVER w AS {'p' * k}_{x}" for x in FIGURES for k in (1, 2)) + " FROM financials WINDOW w AS (PARTITION BY corp_code ORDER BY fiscal_year)))"
)
