"""The factor library: each factor is a name, the inputs it needs and an expression over a snapshot.

Expressions use standard SQL, so ratios are ``a / nullif(b, 0)`` and lags count snapshots of an
entity. Factors whose inputs a snapshot lacks are left out before any job runs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Snapshots of an entity in order.
OVER = "over (partition by stock_id order by ym)"


@dataclass(frozen=True)
class Factor:
    name: str
    inputs: tuple[str, ...]
    sql: str


def _ratio(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


def _lag(x: str, k: int) -> str:
    return f"lag({x}, {k}) {OVER}"


def _pct(x: str, k: int) -> str:
    return f"{_ratio(x, _lag(x, k))} - 1"


def _diff(x: str, k: int = 12) -> str:
    return f"({x}) - {_lag(x, k)}"


def _skip(x: str, near: int, far: int) -> str:
    return f"{_ratio(_lag(x, near), _lag(x, far))} - 1"


def _log(x: str) -> str:
    return f"ln(case when {x} > 0 then {x} end)"


def _sign(x: str, test: str = "> 0") -> str:
    return f"case when {x} is not null then (case when {x} {test} then 1.0 else 0.0 end) end"


#: Names under which net income may be reported, in order of preference.
NET_INCOME = ("f_NetIncome", "f_IncomeAfterTaxes", "f_IncomeAfterTax", "f_TotalConsolidatedProfitForThePeriodAfterTax")
_CFO, _CAPEX, _TA, _REV = "c_CashFlowsFromOperatingActivities", "c_PropertyAndPlantAndEquipment", "b_TotalAssets", "f_Revenue"
_NWC = _ratio("b_CurrentAssets - b_CurrentLiabilities", _TA)


def _library() -> list[Factor]:
    out: list[Factor] = []

    def add(name: str, inputs: str, sql: str) -> None:
        out.append(Factor(name, tuple(inputs.split()), sql))

    for k in (1, 3, 6, 12):
        add(f"mom_{k}m", "close", _pct("close", k))
    for near, far in ((1, 12), (1, 6), (1, 9)):
        add(f"mom_{far}_{near}", "close", _skip("close", near, far))
    add("dist_high", "close hi_252", f"{_ratio('close', 'hi_252')} - 1")
    add("liq_amt", "amt_21", _log("(amt_21 + 1)"))
    for n in (21, 63, 126):
        add(f"neg_vol_{n}", f"vol_{n}", f"-vol_{n}")
    add("neg_size", "mktcap", f"-{_log('mktcap')}")
    for name, item in (("gp", "f_GrossProfit"), ("op", "f_OperatingIncome"), ("ni", "ni"), ("pretax", "f_PreTaxIncome")):
        add(f"{name}_to_px", f"{item} px", _ratio(item, "px"))
        add(f"{name}_to_rev", f"{item} {_REV}", _ratio(item, _REV))
    add("eps_to_px", "f_EPS px", _ratio("f_EPS", "px"))
    add("roe", "ni b_Equity", _ratio("ni", "b_Equity"))
    add("roa", f"ni {_TA}", _ratio("ni", _TA))
    add("asset_turnover", f"{_REV} {_TA}", _ratio(_REV, _TA))
    add("bp", "b_EquityAttributableToOwnersOfParent mktcap", _ratio("b_EquityAttributableToOwnersOfParent", "mktcap"))
    add("neg_debt_ratio", f"b_Liabilities {_TA}", f"-{_ratio('b_Liabilities', _TA)}")
    add("current_ratio", "b_CurrentAssets b_CurrentLiabilities", _ratio("b_CurrentAssets", "b_CurrentLiabilities"))
    add("cfo_yield", f"{_CFO} mktcap", _ratio(_CFO, "mktcap"))
    add("fcf_yield", f"{_CFO} {_CAPEX} mktcap", _ratio(f"{_CFO} - abs({_CAPEX})", "mktcap"))
    add("neg_accruals", f"ni {_CFO} {_TA}", f"-{_ratio(f'ni - {_CFO}', _TA)}")
    add("neg_asset_growth", _TA, f"-({_pct(_TA, 12)})")
    for name, item in (("mrev", "month_revenue"), ("rev", _REV), ("ni", "ni"), ("op", "f_OperatingIncome"), ("gp", "f_GrossProfit"), ("eps", "f_EPS")):
        for k in (1, 3, 12):
            add(f"g_{name}_{k}", item, _pct(item, k))
    for name, item in (("gross", "f_GrossProfit"), ("op", "f_OperatingIncome"), ("net", "ni")):
        add(f"d_{name}_margin", f"{item} {_REV}", _diff(_ratio(item, _REV)))
    add("d_roe", "ni b_Equity", _diff(_ratio("ni", "b_Equity")))
    add("d_roa", f"ni {_TA}", _diff(_ratio("ni", _TA)))
    add("d_asset_turnover", f"{_REV} {_TA}", _diff(_ratio(_REV, _TA)))
    for name, item in (("inv", "b_Inventories"), ("recv", "b_AccountsReceivableNet")):
        add(f"{name}_turnover", f"{_REV} {item}", _ratio(_REV, item))
        add(f"d_{name}_turnover", f"{_REV} {item}", _diff(_ratio(_REV, item)))
    add("cfo_to_ni", f"{_CFO} ni", _ratio(_CFO, "ni"))
    add("capex_to_ta", f"{_CAPEX} {_TA}", _ratio(f"abs({_CAPEX})", _TA))
    add("capex_to_rev", f"{_CAPEX} {_REV}", _ratio(f"abs({_CAPEX})", _REV))
    add("g_cfo_12", _CFO, _pct(_CFO, 12))
    add("d_debt_ratio", f"b_Liabilities {_TA}", _diff(_ratio("b_Liabilities", _TA)))
    shares = (("cash", "CashAndCashEquivalents"), ("inv", "Inventories"), ("recv", "AccountsReceivableNet"), ("ppe", "PropertyPlantAndEquipment"), ("intang", "IntangibleAssets"), ("retain", "RetainedEarnings"), ("curr", "CurrentAssets"))
    for name, item in shares:
        add(f"{name}_to_ta", f"b_{item} {_TA}", _ratio(f"b_{item}", _TA))
        add(f"d_{name}_to_ta", f"b_{item} {_TA}", _diff(_ratio(f"b_{item}", _TA)))
    add("d_nwc_to_ta", f"b_CurrentAssets b_CurrentLiabilities {_TA}", _diff(_NWC))
    add("mom_vol_adj", "close vol_126", _ratio(_skip("close", 1, 12), "vol_126"))
    add("rev_accel", "_g_mrev_3", _diff("_g_mrev_3", 3))
    add("quality_score", f"ni {_CFO} {_TA} {_REV} f_GrossProfit b_Liabilities", "_quality")
    add("div_yield", "div_yield", "div_yield")
    add("neg_short_ratio", "short_balance margin_balance", f"-{_ratio('short_balance', 'margin_balance')}")
    add("ep", "per", "case when per > 0 then 1 / per end")
    return out


LIBRARY = _library()
#: Second-level inputs: made from snapshots with the windows of the first level.
LEVELS = {
    "_g_mrev_3": (("month_revenue",), _pct("month_revenue", 3)),
    "_s1": (("ni", _TA), _ratio("ni", _TA)),
    "_s2": ((_CFO,), _CFO),
    "_s3": ((_CFO, "ni"), f"{_CFO} - ni"),
    "_s4": (("ni", _TA), _diff(_ratio("ni", _TA))),
    "_s5": (("f_GrossProfit", _REV), _diff(_ratio("f_GrossProfit", _REV))),
    "_s6": (("b_Liabilities", _TA), _diff(_ratio("b_Liabilities", _TA))),
}
_SIGNALS = [_sign(f"_s{i}") for i in range(1, 6)] + [_sign("_s6", "< 0")]
QUALITY = f"case when coalesce({', '.join(f'_s{i}' for i in range(1, 7))}) is not null then {' + '.join(f'coalesce({s}, 0.0)' for s in _SIGNALS)} end"

#: The short list, all winsorised by month.
CLASSIC = [
    Factor("mom_1m", ("close",), _pct("close", 1)),
    Factor("mom_3m", ("close",), _pct("close", 3)),
    Factor("mom_6m", ("close",), _pct("close", 6)),
    Factor("mom_12m", ("close",), _pct("close", 12)),
    Factor("mom_12_1", ("close",), _skip("close", 1, 12)),
    Factor("vol_63", ("vol_63",), "vol_63"),
    Factor("liq_amt", ("amt_21",), _log("(amt_21 + 1)")),
    Factor("dist_high", ("close", "hi_252"), f"{_ratio('close', 'hi_252')} - 1"),
    Factor("rev_yoy", ("month_revenue",), _pct("month_revenue", 12)),
    Factor("rev_mom", ("month_revenue",), _pct("month_revenue", 1)),
    Factor("earn_yield", ("f_EPS", "close"), _ratio("f_EPS", "close")),
    Factor("gross_margin", ("f_GrossProfit", _REV), _ratio("f_GrossProfit", _REV)),
    Factor("roe_proxy", ("f_IncomeAfterTaxes", "f_EquityAttributableToOwnersOfParent"), _ratio("f_IncomeAfterTaxes", "f_EquityAttributableToOwnersOfParent")),
]


def basis(snapshot: DataFrame) -> DataFrame:
    """Add net income, price and market value where their inputs are there."""
    have = set(snapshot.columns)
    income = [c for c in NET_INCOME if c in have]
    new = {"ni": F.expr(f"coalesce({', '.join(income)})")} if income else {}
    if "close" in have:
        px = "coalesce(close_raw, close)" if "close_raw" in have else "close"
        new["px"] = F.expr(px)
        if "b_CapitalStock" in have:
            new["mktcap"] = F.expr(f"{px} * b_CapitalStock / 10")
    return snapshot.withColumns(new)


def available_factors(columns: Sequence[str], library: Sequence[Factor] = LIBRARY) -> list[Factor]:
    """The factors whose inputs are all among ``columns`` (after ``basis`` and the second-level inputs)."""
    have = set(columns)
    return [f for f in library if have.issuperset(f.inputs)]


def add_factors(snapshot: DataFrame, library: Sequence[Factor] = LIBRARY, keep: Sequence[str] = ("stock_id", "ym", "group", "date", "close")) -> DataFrame:
    """Keys, all available factors, the month's return and the label fwd_ret_1m.

    All windows share partitioning and order, so there is one shuffle and one sort.
    """
    df = basis(snapshot)
    level = {k: F.expr(sql) for k, (needs, sql) in LEVELS.items() if set(df.columns).issuperset(needs)}
    df = df.withColumns(level)
    if {f"_s{i}" for i in range(1, 7)}.issubset(level):
        df = df.withColumn("_quality", F.expr(QUALITY))
    chosen = available_factors(df.columns, library)
    cols = [F.expr(f.sql).cast("double").alias(f.name) for f in chosen]
    label = [F.expr(_pct("close", 1)).alias("ret_1m"), F.expr(f"lead(close) {OVER} / nullif(close, 0) - 1").alias("fwd_ret_1m")]
    return df.select(*[c for c in keep if c in df.columns], *cols, *label)
