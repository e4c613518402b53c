"""DuckDB SQL for the registered queries, written from their definitions rather than from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from tidemark.operators import factors
from tidemark.sources.market import BALANCE, CASH, INCOME

TRAIN_END = "DATE '1998-06-01'"
PARTS = ("mom_1m", "mom_3m", "liq_amt", "discount", "volume")
_W = "(PARTITION BY stock_id ORDER BY ym)"
_REGION = "supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _wide(table: str, p: str, items: Sequence[str]) -> str:
    cols = ", ".join(f"min(value) FILTER (type = '{i}') AS {p}_{i}" for i in items)
    m, y = f"month({p}_period_end)", f"year({p}_period_end)"
    due = f"CASE {m} WHEN 3 THEN make_date({y}, 5, 15) WHEN 6 THEN make_date({y}, 8, 14) WHEN 9 THEN make_date({y}, 11, 14) WHEN 12 THEN make_date({y} + 1, 3, 31) ELSE ({p}_period_end + 90)::date END"
    return f"SELECT *, {due} AS {p}_avail FROM (SELECT stock_id, date AS {p}_period_end, {cols} FROM {table} WHERE type IN ({', '.join(repr(i) for i in items)}) GROUP BY ALL)"


def _stack(table: str, items: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT stock_id, date, '{k}' AS type, ({v})::double AS value FROM {table}" for k, v in items.items())


def _total(x: str, where: str = "") -> str:
    return f"round(coalesce(sum({x}){f' FILTER ({where})' if where else ''}, 0), 4)"


_NET, _FEE = "l_extendedprice * (1 - l_discount)", "l_extendedprice * (1 - l_discount - l_tax)"
_FLAG = {k: _total("l_extendedprice", f"l_returnflag = '{k}'") for k in "RAN"}
_RUN = "(PARTITION BY stock_id ORDER BY date)"
_N20 = "count(ret) OVER w{0} >= {1}"

#: Shared parts of the statements, in an order in which each uses earlier ones only.
CTES = {
    "li": "SELECT *, lpad(l_suppkey::varchar, greatest(4, length(l_suppkey::varchar))::int, '0') AS stock_id, l_shipdate::date AS date FROM lineitem",
    "info": f"""SELECT lpad(s_suppkey::varchar, greatest(4, length(s_suppkey::varchar))::int, '0') AS stock_id, s_name AS stock_name, r_name || ' ' || n_name AS industry_category,
        CASE WHEN s_suppkey % 10 = 9 THEN 'emerging' WHEN s_suppkey % 2 = 0 THEN 'twse' ELSE 'tpex' END AS type, r_name AS "group" FROM {_REGION}""",
    "uni": """SELECT stock_id, stock_name, industry_category, lower("group") AS "group", type FROM info WHERE type <> 'emerging' AND "group" IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE')""",
    "px": """SELECT stock_id, date, arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey)) AS open, max(l_extendedprice / l_quantity) AS max, min(l_extendedprice / l_quantity) AS min,
        round(sum(l_extendedprice), 2) / sum(l_quantity) AS close, sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS amount FROM li GROUP BY stock_id, date""",
    "ev": """SELECT stock_id, date, round(sum(l_extendedprice), 2) AS b, round(sum(l_extendedprice * (1 - l_discount)), 4) AS a FROM li WHERE round(l_discount, 2) = 0.1 AND round(l_tax, 2) = 0 GROUP BY ALL""",
    "adj": """SELECT p.*, coalesce((SELECT product(a / b) FROM ev WHERE ev.stock_id = p.stock_id AND ev.date > p.date AND a > 0 AND b > 0), 1.0) AS adj_factor FROM px p WHERE close > 0""",
    "base": """SELECT a.stock_id, date, volume, amount, open * adj_factor AS open, max * adj_factor AS high, min * adj_factor AS low, close * adj_factor AS close, close AS close_raw,
        close * adj_factor / lag(close * adj_factor) OVER (PARTITION BY a.stock_id ORDER BY date) - 1 AS ret, "group", stock_name FROM adj a LEFT JOIN info i ON a.stock_id = i.stock_id""",
    "rv": f"""SELECT stock_id, y::int AS revenue_year, m::int AS revenue_month, month_revenue, (make_date(y, m, 1) + INTERVAL 1 MONTH + INTERVAL 9 DAY)::date AS rev_avail FROM
        (SELECT stock_id, year(date) AS y, month(date) AS m, round(sum({_NET}), 4) AS month_revenue FROM li GROUP BY ALL)""",
    "q": f"""SELECT stock_id, last_day(date_trunc('quarter', date) + INTERVAL 2 MONTH) AS date, {_total('l_extendedprice')} AS ext, {_total(_NET)} AS net, {_total(_FEE)} AS fee, {_total(_FEE, "l_returnflag <> 'R'")} AS pre,
        sum(l_quantity) AS qty, {_total(_NET, "l_linestatus = 'F'")} AS cash, {_total('l_extendedprice * l_tax')} AS tax, {_total('l_extendedprice', "l_linestatus = 'O'")} AS open, {_total('l_extendedprice', "l_linestatus = 'F'")} AS closed,
        {', '.join(f'{v} AS flag_{k}' for k, v in _FLAG.items())}, {_total('l_extendedprice', 'l_linenumber = 1')} AS first FROM li GROUP BY ALL""",
    "fin": _stack("q", {"Revenue": "ext", "GrossProfit": "net", "OperatingIncome": "fee", "PreTaxIncome": "pre", "NetIncome": "pre * 0.8::double", "IncomeAfterTaxes": "pre * 0.8::double", "EquityAttributableToOwnersOfParent": "net * 0.9::double", "EPS": "pre * 0.8::double / qty", "-": "ext", "Revenue_per": "100"}),
    "run": f"SELECT stock_id, date, {', '.join(f'round(sum({x}) OVER {_RUN}, 4) AS {x}' for x in ('ext', 'net', 'qty', 'open', 'closed', 'flag_R', 'flag_A', 'flag_N', 'tax', 'first'))} FROM q",
    "bal": _stack("run", {"TotalAssets": "ext", "Equity": "net", "Liabilities": "ext - net", "CapitalStock": "qty * 10", "CurrentAssets": "open", "CurrentLiabilities": "closed", "EquityAttributableToOwnersOfParent": "net * 0.9::double", "Inventories": "flag_R", "AccountsReceivableNet": "flag_A", "CashAndCashEquivalents": "flag_N", "PropertyPlantAndEquipment": "tax", "IntangibleAssets": "first", "RetainedEarnings": "net * 0.3::double"}),
    "cf": _stack("q", {"CashFlowsFromOperatingActivities": "cash", "PropertyAndPlantAndEquipment": "-tax"}),
    "f": _wide("fin", "f", INCOME),
    "b": _wide("bal", "b", BALANCE),
    "c": _wide("cf", "c", CASH),
    "inst": "SELECT stock_id, date, "
    + ", ".join(f"coalesce(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity WHEN l_linestatus = 'F' THEN -l_quantity ELSE 0 END) FILTER (l_returnflag = '{k}'), 0.0::double) AS inst_{n}_net" for k, n in (("A", "foreign"), ("N", "trust"), ("R", "dealer")))
    + ", date + 1 AS avail FROM li GROUP BY stock_id, date",
    "lend": "SELECT stock_id, date, sum(l_quantity) AS lending_vol, date + 1 AS avail FROM li WHERE round(l_tax, 2) = 0 GROUP BY stock_id, date",
    "marg": """SELECT stock_id, date, sum(o) OVER (PARTITION BY stock_id ORDER BY date) AS margin_balance, sum(f) OVER (PARTITION BY stock_id ORDER BY date) AS short_balance, date + 1 AS avail FROM
        (SELECT stock_id, date, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS o, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS f FROM li GROUP BY ALL)""",
    "val": """SELECT stock_id, date, d * 100 - 5 AS per, t * 10 AS pbr, CASE WHEN d > 0 THEN d END AS div_yield, date + 1 AS avail FROM
        (SELECT stock_id, date, round(sum(l_discount), 2) AS d, round(sum(l_tax), 2) AS t FROM li GROUP BY ALL)""",
    "hr": """SELECT stock_id, date, CASE WHEN r > 0 THEN round(100 * r / q, 4) END AS foreign_ratio, date + 1 AS avail FROM
        (SELECT stock_id, date, coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS r, sum(l_quantity) AS q FROM li GROUP BY ALL)""",
    "panel": """SELECT base.*, rev_avail, month_revenue, f.* EXCLUDE (stock_id), b.* EXCLUDE (stock_id), c.* EXCLUDE (stock_id), inst_foreign_net, inst_trust_net, inst_dealer_net, lending_vol, margin_balance, short_balance, per, pbr, div_yield, foreign_ratio
        FROM base ASOF LEFT JOIN rv ON base.stock_id = rv.stock_id AND base.date >= rv.rev_avail
        ASOF LEFT JOIN f ON base.stock_id = f.stock_id AND base.date >= f.f_avail ASOF LEFT JOIN b ON base.stock_id = b.stock_id AND base.date >= b.b_avail ASOF LEFT JOIN c ON base.stock_id = c.stock_id AND base.date >= c.c_avail
        ASOF LEFT JOIN inst ON base.stock_id = inst.stock_id AND base.date >= inst.avail ASOF LEFT JOIN lend ON base.stock_id = lend.stock_id AND base.date >= lend.avail
        ASOF LEFT JOIN marg ON base.stock_id = marg.stock_id AND base.date >= marg.avail ASOF LEFT JOIN val ON base.stock_id = val.stock_id AND base.date >= val.avail ASOF LEFT JOIN hr ON base.stock_id = hr.stock_id AND base.date >= hr.avail""",
    "roll": "SELECT *, "
    + ", ".join(f"CASE WHEN count(ret) OVER w{n} >= {k} THEN stddev_samp(ret) OVER w{n} END AS vol_{n}" for n, k in ((21, 12), (63, 40), (126, 80)))
    + ", CASE WHEN count(amount) OVER w21 >= 10 THEN avg(amount) OVER w21 END AS amt_21, CASE WHEN count(close) OVER w252 >= 120 THEN max(close) OVER w252 END AS hi_252 FROM {src} WINDOW "
    + ", ".join(f"w{n} AS (PARTITION BY stock_id ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (21, 63, 126, 252)),
    "snap": "SELECT *, date_trunc('month', date)::date AS ym FROM roll QUALIFY row_number() OVER (PARTITION BY stock_id, date_trunc('month', date) ORDER BY date DESC) = 1",
    "mb": "SELECT *, date_trunc('month', date)::date AS ym FROM base QUALIFY row_number() OVER (PARTITION BY stock_id, date_trunc('month', date) ORDER BY date DESC) = 1",
    "pm": f"""SELECT *, close / lag(close) OVER {_W} - 1 AS mom_1m, close / lag(close, 3) OVER {_W} - 1 AS mom_3m, ln(amt_21) AS liq_amt, lead(close) OVER {_W} / close - 1 AS fwd_ret_1m FROM
        (SELECT l_partkey::varchar AS stock_id, date_trunc('month', l_shipdate)::date AS ym, p_type AS "group", p_name AS stock_name, round(sum(l_extendedprice), 2) / sum(l_quantity) AS close, round(sum(l_extendedprice), 2) AS amt_21,
                sum(l_quantity) AS volume, round(sum(l_discount), 2) / count(*) AS discount FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)""",
    "bp": "SELECT o_orderpriority AS name, o_orderdate::date AS date, round(sum(o_totalprice), 2) / count(*) AS price FROM orders GROUP BY ALL",
    "bm": "SELECT name, ym, p / lag(p) OVER (PARTITION BY name ORDER BY ym) - 1 AS ret FROM (SELECT name, date_trunc('month', date)::date AS ym, arg_max(price, date) AS p FROM bp GROUP BY ALL)",
    "bmn": "SELECT name, ym, CASE WHEN abs(ret) <= 0.4 THEN ret END AS ret FROM bm",
}
_USES = {
    "info": "", "uni": "info", "px": "li", "ev": "li", "adj": "px ev", "base": "adj info", "rv": "li", "q": "li", "fin": "q", "run": "q", "bal": "run", "cf": "q", "f": "fin", "b": "bal", "c": "cf", "inst": "li", "lend": "li", "marg": "li", "val": "li", "hr": "li",
    "panel": "base rv f b c inst lend marg val hr", "roll": "panel", "snap": "roll", "mb": "base", "bm": "bp", "bmn": "bm",
}


def _with(needs: str, body: str, **more: str) -> str:
    """The statement with all shared parts it needs, and ``more`` parts of its own."""
    want: set[str] = set()

    def add(name: str) -> None:
        if name not in want:
            want.add(name)
            for n in _USES.get(name, "").split():
                add(n)

    for n in needs.split():
        add(n)
    parts = [f"{k} AS MATERIALIZED ({v.format(src='panel') if k == 'roll' else v})" for k, v in CTES.items() if k in want] + [f"{k} AS ({v})" for k, v in more.items()]
    return f"WITH {', '.join(parts)} {body}"


def _expand(sql: str) -> str:
    """``rnd(x, n)`` becomes a rounding of x moved by a trillionth part, which no tie survives."""
    while (at := sql.find("rnd(")) >= 0:
        depth, k, comma = 0, at + 3, 0
        while True:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            if sql[k] == "," and depth == 1:
                comma = k
            if not depth:
                break
            k += 1
        sql = f"{sql[:at]}round(({sql[at + 4 : comma]}) * 1.000000000001::double{sql[comma:]}"
    return sql


def _r(columns: str, digits: int = 6) -> str:
    return ", ".join(f"rnd({c}, {digits}) + 0.0::double AS {c}" for c in columns.split())


def _ranks(src: str, cols: dict[str, str], cell: str) -> str:
    new = ", ".join(f"rank() OVER (PARTITION BY {cell} ORDER BY {c}) + (count(*) OVER (PARTITION BY {cell}, {c}) - 1) / 2.0::double AS {n}" for n, c in cols.items())
    return f"SELECT *, {new} FROM {src}"


def _cells(src: str, names: Sequence[str]) -> dict[str, str]:
    """long, ranked, cells: rank correlations of the columns with the label per month and group."""
    long = " UNION ALL ".join(f"""SELECT '{n}' AS factor, ym, "group", {n}::double AS x, fwd_ret_1m AS y FROM {src} WHERE {n} IS NOT NULL AND fwd_ret_1m IS NOT NULL AND "group" IS NOT NULL""" for n in names)
    return {
        "long": long,
        "ranked": _ranks("long", {"rx": "x", "ry": "y"}, 'factor, ym, "group"'),
        "cells": 'SELECT factor, ym, "group", count(*) AS n, covar_samp(rx, ry) / (stddev_samp(rx) * stddev_samp(ry)) AS ic FROM ranked GROUP BY ALL HAVING count(*) >= 8 AND min(x) < max(x) AND min(y) < max(y)',
        "months": "SELECT factor, ym, avg(ic) AS ic FROM cells GROUP BY ALL",
    }


_SUM = "avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg(ic) / nullif(stddev_samp(ic), 0) AS icir, avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(ic)) AS t_stat, avg((ic > 0)::int) AS hit_rate, count(ic) AS months"


def _split(cells: dict[str, str]) -> dict[str, str]:
    """ev: train and test summaries per factor; eg: the same per group."""
    part = f"CASE WHEN ym <= {TRAIN_END} THEN 'train' ELSE 'test' END AS part"

    def pick(c: str, p: str, k: int) -> str:
        return f"max({c}) FILTER (part = '{p}' AND months >= {k})"

    return cells | {
        "s": f"SELECT factor, part, {_SUM} FROM (SELECT *, {part} FROM months) GROUP BY ALL",
        "es": f"SELECT factor, {pick('ic_mean', 'train', 12)} AS ic_mean_train, {pick('icir', 'train', 12)} AS icir_train, {pick('t_stat', 'train', 12)} AS t_train, {pick('icir', 'test', 6)} AS icir_test, {pick('t_stat', 'test', 6)} AS t_test FROM s GROUP BY factor HAVING max(months) FILTER (part = 'train') >= 12",
        "sg": f'SELECT factor, "group", part, {_SUM} FROM (SELECT *, {part} FROM cells) GROUP BY ALL HAVING count(ic) >= 6',
        "eg": "SELECT factor, \"group\", max(icir) FILTER (part = 'train') AS icir_train, max(icir) FILTER (part = 'test') AS icir_test FROM sg GROUP BY ALL",
    }


def _clip(src: str, names: Sequence[str], keep: str) -> str:
    lo = ", ".join(f"quantile_cont({n}, 0.01) AS lo_{n}, quantile_cont({n}, 0.99) AS hi_{n}" for n in names)
    new = ", ".join(f"CASE WHEN {n} IS NOT NULL THEN greatest(lo_{n}, least(hi_{n}, {n})) END AS {n}" for n in names)
    return f"SELECT {keep}, {new} FROM {src} JOIN (SELECT ym, {lo} FROM {src} GROUP BY ym) USING (ym)"


def _z(src: str, names: Sequence[str], share: float, keep: str = 'stock_id, ym, "group"') -> str:
    new = ", ".join(f"coalesce(CASE WHEN count({n}) OVER w >= {share}::double * count(*) OVER w THEN ({n} - avg({n}) OVER w) / nullif(stddev_samp({n}) OVER w, 0) END, 0.0::double) AS {n}" for n in names)
    return f'SELECT {keep}, {new} FROM {src} WINDOW w AS (PARTITION BY ym, "group")'


def _port(src: str, by: str = "", q: str = "0.1", weight: str = "") -> dict[str, str]:
    """picks, ret: selected rows and monthly returns before costs (gain, short, benchmark, turnover, nhold)."""
    keys = f"{by}, ym" if by else "ym"
    k = f"greatest(1, floor(ng * {q}::double)::int)"
    months = f"row_number() OVER ({f'PARTITION BY {by} ' if by else ''}ORDER BY ym)"
    prev = f"lag(h) OVER ({f'PARTITION BY {by} ' if by else ''}ORDER BY ym)"
    rank = f"CASE WHEN {weight} IS NOT NULL THEN rank() OVER (PARTITION BY {keys} ORDER BY {weight} NULLS LAST) + (count(*) OVER (PARTITION BY {keys}, {weight}) - 1) / 2.0::double END" if weight else "1.0::double"
    return {
        "ok": f"SELECT * FROM {src} WHERE score IS NOT NULL AND fwd_ret_1m IS NOT NULL",
        "mkt": f"SELECT {keys}, avg(fwd_ret_1m) AS benchmark, count(*) AS n FROM ok GROUP BY ALL",
        "placed": f'SELECT *, count(*) OVER (PARTITION BY {keys}, "group") AS ng, row_number() OVER (PARTITION BY {keys}, "group" ORDER BY score DESC, stock_id) AS place FROM ok WHERE "group" IS NOT NULL',
        "picks": f"SELECT placed.*, place <= {k} AS is_long, ng - place + 1 <= {k} AS is_short FROM placed JOIN mkt USING ({keys}) WHERE ng >= 8 AND n >= 20 AND (place <= {k} OR ng - place + 1 <= {k})",
        "lw": f"SELECT *, CASE WHEN count(r) OVER (PARTITION BY {keys}) = 0 THEN 1.0::double / count(*) OVER (PARTITION BY {keys}) ELSE coalesce(r / sum(r) OVER (PARTITION BY {keys}), 0) END AS w FROM (SELECT *, {rank} AS r FROM picks WHERE is_long)",
        "g": f"SELECT {keys}, sum(fwd_ret_1m * w) AS gain, count(*) AS nhold, list(stock_id) AS h FROM lw GROUP BY ALL",
        "t": f"SELECT *, CASE WHEN {months} = 1 THEN 1.0 ELSE (len(list_distinct(list_concat(h, {prev}))) - len(list_intersect(h, {prev})))::double / len(list_distinct(list_concat(h, {prev}))) END AS turnover FROM g",
        "sh": f"SELECT {keys}, avg(fwd_ret_1m) AS short FROM picks WHERE is_short GROUP BY ALL",
        "ret": f"SELECT {keys}, gain, short, benchmark, turnover, nhold FROM t JOIN sh USING ({keys}) JOIN mkt USING ({keys})",
    }


_LEGS = 'gain - {c} * turnover AS "long", gain - short - {c} * turnover AS long_short, benchmark, turnover, nhold'


def _legs(cost: str = "0.004") -> str:
    return _LEGS.format(c=f"{cost}::double")


def _perf(src: str, value: str, by: str) -> dict[str, str]:
    return {
        "cv": f"SELECT *, {value} AS v, product(1 + {value}) OVER (PARTITION BY {by} ORDER BY ym) AS curve FROM {src} WHERE {value} IS NOT NULL",
        "dd": f"SELECT *, curve / max(curve) OVER (PARTITION BY {by} ORDER BY ym) - 1 AS dd FROM cv",
        "pf": f"SELECT {by}, pow(product(1 + v), 12.0::double / count(v)) - 1 AS cagr, stddev_samp(v) * sqrt(12) AS vol, avg(v) * 12 / nullif(stddev_samp(v) * sqrt(12), 0) AS sharpe, min(dd) AS max_dd, avg((v > 0)::int) AS win_rate, count(v) AS months FROM dd GROUP BY ALL HAVING count(v) >= 6",
    }


def _excess(a: str) -> str:
    return f"avg({a}) * 12 AS ann_excess, avg({a}) / nullif(stddev_samp({a}), 0) * sqrt(12) AS ir, avg({a}) / nullif(stddev_samp({a}), 0) * sqrt(count({a})) AS t_stat, avg((({a}) > 0)::int) AS win_rate, count({a}) AS months"


_PERF_COLS = "cagr vol sharpe max_dd win_rate"
_EX_COLS = "ann_excess ir t_stat win_rate"
_SCORED = {"sc": "SELECT *, mom_1m AS score FROM pm"}
_R = _SCORED | _port("sc") | {"rr": f"SELECT ym, {_legs()} FROM ret"}
_STRAT = {"st": " UNION ALL ".join(f"""SELECT '{n}' AS strategy, stock_id, ym, "group", fwd_ret_1m, {n}::double AS score FROM pm""" for n in PARTS)} | _port("st", "strategy") | {"sr": f'SELECT strategy, ym, {_legs()}, gain - 0.004::double * turnover - benchmark AS active FROM ret'}
_CELLS = _cells("pm", PARTS)
_WINS = {"wp": _clip("pm", [*PARTS, "fwd_ret_1m"], 'stock_id, ym, "group"')}
_PART2 = f"SELECT *, unnest(['full', CASE WHEN ym <= {TRAIN_END} THEN 'train' ELSE 'test' END]) AS period"
_HOLD = _SCORED | {
    "hk": """SELECT *, CASE WHEN amt_21 IS NOT NULL THEN (rank() OVER (PARTITION BY ym ORDER BY amt_21) + (count(*) OVER (PARTITION BY ym, amt_21) - 1) / 2.0::double) / count(amt_21) OVER (PARTITION BY ym) END AS liq_pct,
        count(*) OVER (PARTITION BY ym, "group") AS ng, row_number() OVER (PARTITION BY ym, "group" ORDER BY score DESC, stock_id) AS place FROM sc WHERE score IS NOT NULL AND fwd_ret_1m IS NOT NULL AND "group" IS NOT NULL""",
    "hold": """SELECT stock_id, ym, "group", liq_pct, fwd_ret_1m AS ret, 1.0::double / count(*) OVER (PARTITION BY ym) AS w, fwd_ret_1m / count(*) OVER (PARTITION BY ym) AS contribution FROM hk WHERE place <= greatest(1, floor(ng * 0.1::double)::int)""",
}
_BENCH = {n: n for n in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")}
_PIVOT = ", ".join(f"max(ret) FILTER (name = '{n}') AS \"{n}\"" for n in _BENCH)
_LIQ = {"lp": "SELECT *, (rank() OVER (PARTITION BY ym ORDER BY amt_21) + (count(*) OVER (PARTITION BY ym, amt_21) - 1) / 2.0::double) / count(amt_21) OVER (PARTITION BY ym) AS liq_pct FROM sc"}


def _library(chosen: Sequence[factors.Factor], src: str) -> dict[str, str]:
    """The factors' own expressions over snapshots: both engines read the same definitions."""
    level = ", ".join(f"{sql} AS {k}" for k, (_, sql) in factors.LEVELS.items())
    return {
        "n1": f"SELECT *, coalesce(f_NetIncome, f_IncomeAfterTaxes) AS ni, coalesce(close_raw, close) AS px, coalesce(close_raw, close) * b_CapitalStock / 10 AS mktcap FROM {src}",
        "n2": f"SELECT *, {level} FROM n1",
        "n3": f"SELECT *, {factors.QUALITY} AS _quality FROM n2",
        "lib": f"""SELECT stock_id, ym, "group", {", ".join(f"({f.sql})::double AS lib_{f.name}" for f in chosen)}, close / lag(close) OVER {_W} - 1 AS ret_1m, lead(close) OVER {_W} / close - 1 AS fwd_ret_1m FROM n3""",
        "fl": f"""SELECT stock_id, ym, "group", {", ".join(f"lib_{f.name} AS {f.name}" for f in chosen)}, ret_1m, fwd_ret_1m FROM lib""",
    }


_LIB_NAMES, _CLASSIC_NAMES = [f.name for f in factors.LIBRARY], [f.name for f in factors.CLASSIC]
_LW = _z("(SELECT * FROM pm WHERE fwd_ret_1m IS NOT NULL)", ("mom_1m", "discount"), 0.6)
_REGIME = "SELECT *, \"long\" - benchmark AS active, unnest(list_filter(['all', CASE WHEN benchmark > 0 THEN 'up' ELSE 'down' END, CASE WHEN benchmark <= quantile_cont(benchmark, 0.25) OVER ({p}) THEN 'worst_quarter' END], lambda x: x IS NOT NULL)) AS regime FROM {src}"
_FORM = """mom_1m - discount AS f1, CASE WHEN abs(abs(liq_amt)) > 1e-9 THEN -mom_1m / abs(liq_amt) WHEN liq_amt IS NOT NULL AND mom_1m IS NOT NULL THEN 1.0 END AS f2, ln(abs(volume * 2.0) + 1e-9) AS f3, sqrt(abs(mom_3m)) + liq_amt AS f4"""
_FM = {"fm": f'SELECT stock_id, ym, "group", fwd_ret_1m, {_FORM} FROM pm'}
_FC = _FM | _cells("fm", ("f1", "f2", "f3", "f4"))
_SIZES = {"f1": 3, "f2": 5, "f3": 4, "f4": 4}

#: Two features' ridge per fold in closed form: centred sums with the penalty of 10 added, solved by Cramer's rule.
_LADDER = {
    "z": _z("(SELECT * FROM pm WHERE fwd_ret_1m IS NOT NULL)", ("mom_1m", "liq_amt"), 0.0, 'stock_id, ym, "group", fwd_ret_1m, fwd_ret_1m - avg(fwd_ret_1m) OVER w AS y').replace("WINDOW w", 'WHERE "group" IS NOT NULL WINDOW w'),
    "n": "SELECT ym, row_number() OVER (ORDER BY ym) - 1 AS i FROM (SELECT DISTINCT ym FROM z)",
    "fo": "SELECT (i - 48) // 12 AS fold, min(ym) AS first_test, max(ym) AS last_test, (SELECT ym FROM n k WHERE k.i = min(n.i) - 2) AS last_train FROM n WHERE i >= 48 GROUP BY ALL",
    "su": "SELECT fold, first_test, last_test, avg(mom_1m) AS m1, avg(liq_amt) AS m2, avg(y) AS my, regr_sxx(mom_1m, mom_1m) + 10 AS a, regr_sxy(mom_1m, liq_amt) AS b, regr_sxx(liq_amt, liq_amt) + 10 AS d, regr_sxy(mom_1m, y) AS p, regr_sxy(liq_amt, y) AS q FROM fo JOIN z ON ym <= last_train GROUP BY ALL HAVING count(*) >= 1000",
    "wt": "SELECT *, (d * p - b * q) / (a * d - b * b) AS w1, (a * q - b * p) / (a * d - b * b) AS w2, p / a AS v FROM su",
    "ml": 'SELECT stock_id, ym, "group", fwd_ret_1m, (mom_1m + liq_amt) / 2 AS s_equal, my + w1 * (mom_1m - m1) + w2 * (liq_amt - m2) AS s_ridge, my + v * (mom_1m - m1) AS s_neutral FROM z JOIN wt ON ym BETWEEN first_test AND last_test',
}
#: One split per fold: every bound of every feature, left of it first; bounds that part no row from another are one, the smallest.
_STUMP = {k: _LADDER[k] for k in ("z", "n", "fo")} | {
    "my": "SELECT fold, first_test, last_test, last_train, avg(y) AS my, count(*) AS rows FROM fo JOIN z ON ym <= last_train GROUP BY ALL HAVING count(*) >= 1000",
    "xs": "SELECT ym, y, 0 AS f, mom_1m AS x FROM z UNION ALL SELECT ym, y, 1, liq_amt FROM z",
    "cu": "SELECT k * 0.25::double AS cut FROM (SELECT unnest(range(-12, 13)) AS k)",
    "le": "SELECT fold, f, cut, my, rows, count(*) AS nl, sum(y - my) AS gl FROM my JOIN xs ON ym <= last_train JOIN cu ON x <= cut GROUP BY ALL",
    "sp": "SELECT fold, f, nl, min(cut) AS cut, arg_min(gl, cut) AS gl, any_value(rows) - nl AS nr FROM le WHERE nl >= 200 AND rows - nl >= 200 GROUP BY fold, f, nl",
    "ga": "SELECT *, gl * gl / (nl + 5.0::double) + gl * gl / (nr + 5.0::double) AS gain FROM sp",
    "b0": "SELECT * FROM ga QUALIFY row_number() OVER (PARTITION BY fold ORDER BY gain DESC, f, cut) = 1",
    "b1": "SELECT * FROM ga WHERE f = 0 QUALIFY row_number() OVER (PARTITION BY fold ORDER BY gain DESC, f, cut) = 1",
    "ss": "SELECT z.stock_id, z.ym, my.my + 0.03::double * CASE WHEN CASE b0.f WHEN 0 THEN z.mom_1m ELSE z.liq_amt END <= b0.cut THEN b0.gl / (b0.nl + 5.0::double) ELSE -b0.gl / (b0.nr + 5.0::double) END AS s_gbt, my.my + 0.03::double * CASE WHEN z.mom_1m <= b1.cut THEN b1.gl / (b1.nl + 5.0::double) ELSE -b1.gl / (b1.nr + 5.0::double) END AS s_neutral FROM z JOIN my ON z.ym BETWEEN first_test AND last_test JOIN b0 ON b0.fold = my.fold JOIN b1 ON b1.fold = my.fold",
}
_MODELS = ("s_equal", "s_ridge", "s_neutral")
_ORIENT = _CELLS | {"sg": "SELECT factor, CASE WHEN avg(ic) >= 0 THEN 1.0::double ELSE -1.0::double END AS sign FROM months GROUP BY factor"}
_TURNED = {"st": " UNION ALL ".join(f"""SELECT '{n}' AS strategy, stock_id, ym, "group", fwd_ret_1m, {n}::double * coalesce((SELECT sign FROM sg WHERE factor = '{n}'), -1) AS score FROM pm""" for n in PARTS)} | _port("st", "strategy") | {"sr": "SELECT strategy, gain - 0.004::double * turnover - benchmark AS active FROM ret"}


def _poly(x: str, numbers: Sequence[float]) -> str:
    """A polynomial in ``x``, numbers from the highest power down."""
    out = f"{numbers[0]!r}::double"
    for n in numbers[1:]:
        out = f"({out} * {x} + {n!r}::double)"
    return out


# The normal distribution function by Hart (1968) and its inverse by Wichura's AS 241 (1988), highest power first.
_HART_UP = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_HART_DOWN = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
_CENTRE_UP = (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608)
_CENTRE_DOWN = (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0)
_TAIL_UP = (0.000774545014278341407640, 0.0227238449892691845833, 0.241780725177450611770, 1.27045825245236838258, 3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734)
_TAIL_DOWN = (1.05075007164441684324e-9, 0.000547593808499534494600, 0.0151986665636164571966, 0.148103976427480074590, 0.689767334985100004550, 1.67638483018380384940, 2.05319162663775882187, 1.0)


def normal_cdf(x: str) -> str:
    a = f"least(abs({x}), 7.0)"
    upper = f"exp(-{a} * {a} / 2) * {_poly(a, _HART_UP)} / {_poly(a, _HART_DOWN)}"
    return f"CASE WHEN {x} > 0 THEN 1 - {upper} ELSE {upper} END"


def normal_quantile(p: str) -> str:
    """For p from 0.5 to 1 - 1e-11."""
    q, r = f"({p} - 0.5)", f"(sqrt(-ln(1 - {p})) - 1.6)"
    c = f"(0.180625::double - {q} * {q})"
    return f"CASE WHEN {q} <= 0.425 THEN {q} * {_poly(c, _CENTRE_UP)} / {_poly(c, _CENTRE_DOWN)} ELSE {_poly(r, _TAIL_UP)} / {_poly(r, _TAIL_DOWN)} END"


_DEFLATED = _ORIENT | _TURNED | {
    "mo": "SELECT strategy, count(active) AS months, avg(active) / stddev_samp(active) AS sharpe, skewness(active) AS skew, kurtosis(active) + 3 AS kurt FROM sr GROUP BY strategy",
    "tr": "SELECT count(sharpe) AS n_trials, var_samp(sharpe) AS v, 1 - 1.0::double / count(sharpe) AS p1, 1 - 1.0::double / (count(sharpe) * exp(1.0::double)) AS p2 FROM mo",
    "tg": f"SELECT n_trials, sqrt(v) * ((1 - 0.5772156649::double) * ({normal_quantile('p1')}) + 0.5772156649::double * ({normal_quantile('p2')})) AS target FROM tr",
    "zs": "SELECT mo.*, tg.*, (sharpe - target) * sqrt(months - 1) / sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) AS zz FROM mo, tg",
}
_CP = _z("(SELECT *, mom_1m AS z_mom_1m, discount AS z_discount FROM pm WHERE fwd_ret_1m IS NOT NULL)", ("mom_1m", "discount"), 0.6, 'stock_id, ym, "group", fwd_ret_1m')
_ROOT = {
    "gm": "SELECT ym, count(*) AS n, sum(mom_1m * mom_1m) + 1e-6 AS a, sum(mom_1m * discount) AS b, sum(discount * discount) + 1e-6 AS d FROM z GROUP BY ym",
    "m": "SELECT *, sqrt(a * d - b * b) AS s, sqrt(a + d + 2 * sqrt(a * d - b * b)) AS t FROM gm",
    "co": 'SELECT stock_id, z.ym, "group", fwd_ret_1m, CASE WHEN n >= 10 THEN (mom_1m * (d + s - b) + discount * (a + s - b)) * t / ((a + s) * (d + s) - b * b) / 2 END AS score FROM z JOIN m ON z.ym = m.ym',
}
_TOPG = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")

ORACLES = {
    "panel_holdings": _with("panel", f"SELECT stock_id, date, {_r('foreign_ratio', 4)} FROM panel"),
    "top_factors": _with("snap", f"SELECT es.factor, {_r('ic_mean_train icir_train t_train icir_test t_test', 5)}, " + ", ".join(f"rnd((SELECT icir_{p} FROM eg WHERE eg.factor = es.factor AND eg.\"group\" = '{g}'), 5) + 0.0::double AS \"icir_{p}_{g}\"" for g in _TOPG for p in ("train", "test")) + " FROM es ORDER BY abs(es.icir_train) DESC NULLS LAST, es.factor LIMIT 10",
        **_library(factors.CLASSIC, "snap"), w=_clip("fl", [*_CLASSIC_NAMES, "fwd_ret_1m"], 'stock_id, ym, "group"'), **_split(_cells("w", _CLASSIC_NAMES))),
    "candidates_report": _with("snap", f"SELECT es.factor, {_r('ic_mean_train icir_train t_train icir_test t_test', 5)}, " + ", ".join(f"rnd((SELECT icir_{p} FROM eg WHERE eg.factor = es.factor AND eg.\"group\" = '{g}'), 5) + 0.0::double AS \"icir_{p}_{g}\"" for g in _TOPG for p in ("train", "test")) + " FROM es ORDER BY abs(es.icir_train) DESC NULLS LAST, es.factor LIMIT 20",
        **_library(factors.LIBRARY, "snap"), w=_clip("fl", [*_LIB_NAMES, "fwd_ret_1m"], 'stock_id, ym, "group"'), **_split(_cells("w", _LIB_NAMES))),
    "composite_pair": _with("pm", f"SELECT stock_id, ym, {_r('score')} FROM co", z=_CP, **_ROOT),
    "composite_performance": _with("pm", f"SELECT leg, {_r(_PERF_COLS)}, months FROM pf", z=_CP, **_ROOT, **_port("co"), rr=f"SELECT ym, 'long' AS leg, {_legs()} FROM ret", **_perf("rr", '"long"', "leg")),
    "weight_sweep": _with("pm", f'SELECT cost, q, weighting, ym, rnd("long", 6) + 0.0::double AS "long", {_r("benchmark turnover")}, nhold FROM rr', sc="SELECT *, mom_1m AS score, CASE weighting WHEN 'equal' THEN 1.0::double WHEN 'mom_3m' THEN mom_3m ELSE mom_1m END AS wv FROM (SELECT *, unnest([0.05, 0.1]::double[]) AS q FROM pm), (SELECT unnest(['equal', 'mom_3m', 'score']) AS weighting)",
        **_port("sc", "q, weighting", "q", "wv"), rr="SELECT q, weighting, ym, 0.004::double AS cost, gain - 0.004::double * turnover AS \"long\", benchmark, turnover, nhold FROM ret"),
    "sweep_periods": _with("pm", f"SELECT q, weighting, period, {_r('vol sharpe max_dd win_rate')}, rnd(ln(1 + cagr), 6) + 0.0::double AS log_growth, months FROM pf", sc="SELECT *, mom_1m AS score, CASE weighting WHEN 'equal' THEN 1.0::double WHEN 'mom_3m' THEN mom_3m ELSE mom_1m END AS wv FROM (SELECT *, unnest([0.05, 0.1, 0.2]::double[]) AS q FROM pm), (SELECT unnest(['equal', 'mom_3m', 'score']) AS weighting)",
        **_port("sc", "q, weighting", "q", "wv"), rr='SELECT q, weighting, ym, gain - 0.004::double * turnover AS "long" FROM ret', pp=f"{_PART2} FROM rr", **_perf("pp", '"long"', "q, weighting, period")),
    "factor_weights": _with("pm", f"SELECT weighting, {_r(_PERF_COLS)}, months FROM pf", sc="SELECT *, mom_1m AS score, CASE weighting WHEN 'equal' THEN 1.0::double " + " ".join(f"WHEN '{n}' THEN {n}" for n in PARTS) + " END AS wv FROM pm, (SELECT unnest(['equal', " + ", ".join(f"'{n}'" for n in PARTS) + "]) AS weighting)",
        **_port("sc", "weighting", weight="wv"), rr='SELECT weighting, ym, gain - 0.004::double * turnover AS "long" FROM ret', **_perf("rr", '"long"', "weighting")),
    "stump_scores": _with("pm", f"SELECT stock_id, ym, {_r('s_gbt s_neutral', 7)} FROM ss", **_STUMP),
    "ridge_pair": _with("pm", f"SELECT stock_id, ym, {_r(' '.join(_MODELS), 8)} FROM ml", **_LADDER),
    "model_ladder": _with("pm", f"SELECT strategy, {_r('icir sharpe max_dd turnover')}, rnd(ln(1 + cagr), 6) + 0.0::double AS log_growth FROM (SELECT factor AS strategy, {_SUM} FROM months GROUP BY factor) JOIN pf USING (strategy) JOIN (SELECT strategy, avg(turnover) AS turnover FROM ret GROUP BY strategy) USING (strategy)", **_LADDER, **{k: v for k, v in _cells("ml", _MODELS).items()},
        st=" UNION ALL ".join(f"""SELECT '{k}' AS strategy, stock_id, ym, "group", fwd_ret_1m, {k} AS score FROM ml""" for k in _MODELS), **_port("st", "strategy"), rr='SELECT strategy, ym, gain - 0.004::double * turnover AS "long" FROM ret', **_perf("rr", '"long"', "strategy")),
    "model_costs": _with("pm", f"SELECT cost, {_r('vol sharpe max_dd win_rate')}, rnd(ln(1 + cagr), 6) + 0.0::double AS log_growth, months FROM pf", **_LADDER, sc="SELECT *, s_ridge AS score FROM ml", **_port("sc"), rr='SELECT cost, ym, gain - cost * turnover AS "long" FROM (SELECT *, unnest([0.002, 0.004, 0.008, 0.012, 0.016]::double[]) AS cost FROM ret)', **_perf("rr", '"long"', "cost")),
    "deflated_sharpe": _with("pm", f"SELECT strategy, months, n_trials, {_r('sharpe target')}, rnd({normal_cdf('zz')}, 6) + 0.0::double AS deflated FROM zs", **_DEFLATED),
    "annual_by_variant": _with("pm", 'SELECT variant, year(ym)::int AS year, rnd(product(1 + "long" - benchmark) - 1, 6) + 0.0::double AS excess FROM rr GROUP BY ALL', **_SCORED, **_LIQ,
        vr="SELECT * FROM (SELECT *, unnest(['all', CASE WHEN liq_pct >= 0.7::double THEN 'liquid' END]) AS variant FROM lp) WHERE variant IS NOT NULL", **_port("vr", "variant"), rr=f"SELECT variant, ym, {_legs()} FROM ret"),
    "ic_summary": _with("pm", f"SELECT factor, {_r('ic_mean ic_std icir t_stat hit_rate')}, months FROM (SELECT factor, {_SUM} FROM months GROUP BY factor)", **_WINS, **_cells("wp", PARTS)),
    "landing_merge": _with("uni", "SELECT * FROM uni"),
    "pending_keys": _with("li info", "SELECT stock_id FROM info WHERE stock_id NOT IN (SELECT stock_id FROM li WHERE date < DATE '1995-01-10')"),
    "incremental_ingest": "SELECT event_id, user_id, event_type, value FROM events",
    "universe_classify": _with("uni", "SELECT * FROM uni"),
    "category_counts": _with("uni", 'SELECT "group", count(*) AS n FROM uni GROUP BY ALL'),
    "back_adjust": _with("adj", "SELECT stock_id, date, rnd(close, 6) AS close, rnd(adj_factor, 6) AS adj_factor, rnd(close * adj_factor, 6) AS adj_close, rnd(open * adj_factor, 6) AS adj_open FROM adj"),
    "prefer_source": _with("px", "SELECT CASE WHEN stock_id[4]::int % 2 = 0 THEN 'vendor' ELSE 'self' END AS adj_source, count(*) AS n FROM px GROUP BY ALL"),
    "daily_return": _with("px", "SELECT stock_id, date, rnd(close, 6) AS close, rnd(close / lag(close) OVER (PARTITION BY stock_id ORDER BY date) - 1, 6) + 0.0::double AS ret FROM px"),
    "price_base": _with("base", f'SELECT stock_id, date, {_r("volume amount close close_raw ret")}, "group" FROM base'),
    "revenue_availability": _with("rv", f"SELECT stock_id, revenue_year, revenue_month, {_r('month_revenue')}, rev_avail FROM rv"),
    "statement_pivot": _with("f", f"SELECT stock_id, f_period_end, f_avail, {_r(' '.join(f'f_{i}' for i in INCOME), 4)} FROM f"),
    "statement_deadline": _with("li", """SELECT e AS period_end, CASE month(e) WHEN 3 THEN make_date(year(e), 5, 15) WHEN 6 THEN make_date(year(e), 8, 14) WHEN 9 THEN make_date(year(e), 11, 14) WHEN 12 THEN make_date(year(e) + 1, 3, 31) ELSE e + 90 END AS deadline FROM (SELECT DISTINCT last_day(date) AS e FROM li)"""),
    "net_flow": _with("inst", "SELECT * FROM inst"),
    "lending_volume": _with("lend", "SELECT * FROM lend"),
    "daily_measures": _with("marg val", f"SELECT stock_id, date, m.avail, {_r('margin_balance short_balance per pbr div_yield')} FROM marg m JOIN val USING (stock_id, date)"),
    "asof_revenue": _with("px rv", "SELECT px.stock_id, px.date, rnd(close, 6) AS close, rev_avail, rnd(month_revenue, 6) AS month_revenue FROM px ASOF LEFT JOIN rv ON px.stock_id = rv.stock_id AND px.date >= rv.rev_avail"),
    "asof_panel": _with("panel", f"SELECT stock_id, date, f_avail, {_r('close ret month_revenue f_Revenue f_EPS b_TotalAssets b_CapitalStock c_CashFlowsFromOperatingActivities inst_foreign_net lending_vol margin_balance per div_yield', 4)} FROM panel"),
    "panel_coverage": _with("panel", """SELECT count(*) AS n_rows, count(DISTINCT stock_id) AS n_entities, rnd(avg((month_revenue IS NOT NULL)::int), 6) AS revenue_share, rnd(avg((f_Revenue IS NOT NULL OR f_EPS IS NOT NULL)::int), 6) AS income_share,
        rnd(avg((b_TotalAssets IS NOT NULL)::int), 6) AS balance_share, rnd(avg((inst_foreign_net IS NOT NULL)::int), 6) AS flows_share, rnd(avg((per IS NOT NULL OR div_yield IS NOT NULL)::int), 6) AS valuation_share FROM panel"""),
    "rolling_windows": _with("base", f"SELECT stock_id, date, {_r('vol_21 vol_63 vol_126 amt_21 hi_252')} FROM r", r=CTES["roll"].format(src="base")),
    "month_end_snapshot": _with("mb", f"SELECT stock_id, ym, date, {_r('close volume')} FROM mb"),
    "momentum_set": _with(
        "mb", f"SELECT stock_id, ym, {_r('mom_1m mom_3m mom_6m mom_12m mom_12_1 mom_6_1 mom_9_1 trend fwd_ret_1m')}, rnd(mom_3m - lag(mom_3m, 3) OVER {_W}, 6) + 0.0::double AS accel_3 FROM m",
        m="SELECT stock_id, ym, " + ", ".join(f"close / lag(close, {k}) OVER {_W} - 1 AS mom_{k}m" for k in (1, 3, 6, 12)) + ", " + ", ".join(f"lag(close, 1) OVER {_W} / lag(close, {k}) OVER {_W} - 1 AS mom_{k}_1" for k in (12, 6, 9)) + f", close - lag(close, 12) OVER {_W} AS trend, lead(close) OVER {_W} / close - 1 AS fwd_ret_1m FROM mb",
    ),
    "classic_factors": _with("snap", f"SELECT stock_id, ym, {_r(' '.join([*_CLASSIC_NAMES, 'fwd_ret_1m']))} FROM w", **_library(factors.CLASSIC, "snap"), w=_clip("fl", [*_CLASSIC_NAMES, "fwd_ret_1m"], "stock_id, ym")),
    "factor_library": _with("snap", f"SELECT stock_id, ym, {_r(' '.join([*_LIB_NAMES, 'ret_1m', 'fwd_ret_1m']), 5)} FROM fl", **_library(factors.LIBRARY, "snap")),
    "factor_survivors": _with("snap", f"SELECT factor, {_r('ic_mean_train icir_train t_train icir_test t_test', 5)} FROM es", **_library(factors.LIBRARY, "snap"), w=_clip("fl", [*_LIB_NAMES, "fwd_ret_1m"], 'stock_id, ym, "group"'), **_split(_cells("w", _LIB_NAMES))),
    "winsorize": _with("pm", f"SELECT stock_id, ym, {_r('mom_1m liq_amt')} FROM w", w=_clip("pm", ["mom_1m", "liq_amt"], "stock_id, ym")),
    "zscore_coverage": _with("pm", f'SELECT stock_id, ym, "group", {_r("mom_1m mom_3m discount")} FROM z', z=_z("pm", ("mom_1m", "mom_3m", "discount"), 0.6)),
    "zscore_by_month": _with("pm", f"SELECT stock_id, ym, {_r('mom_1m mom_3m discount')} FROM z", z=_z("pm", ("mom_1m", "mom_3m", "discount"), 0.0).replace('PARTITION BY ym, "group"', "PARTITION BY ym")),
    "demean_label": _with("pm", 'SELECT stock_id, ym, rnd(fwd_ret_1m - avg(fwd_ret_1m) OVER (PARTITION BY ym, "group"), 6) + 0.0::double AS y FROM pm'),
    "pct_rank": _with("pm", "SELECT stock_id, ym, rnd((rank() OVER (PARTITION BY ym ORDER BY volume) + (count(*) OVER (PARTITION BY ym, volume) - 1) / 2.0::double) / count(volume) OVER (PARTITION BY ym), 6) AS volume_pct FROM pm"),
    "feature_coverage": _with("pm", " UNION ALL ".join(f"SELECT '{n}' AS feature, rnd(avg(({n} IS NOT NULL)::int), 6) AS coverage FROM pm" for n in PARTS)),
    "duplicate_columns": _with("pm", "SELECT 'copy,mom_3m' AS features"),
    "ic_cell": _with("pm", f'SELECT factor, ym, "group", n, {_r("ic")} FROM cells', **_CELLS),
    "ic_monthly": _with("pm", f"SELECT factor, ym, {_r('ic')} FROM months", **_CELLS),
    "ic_split": _with("pm", f"SELECT factor, {_r('ic_mean_train icir_train t_train icir_test t_test')} FROM es", **_split(_CELLS)),
    "ic_split_groups": _with("pm", f'SELECT factor, "group", {_r("icir_train icir_test")} FROM eg', **_split(_CELLS)),
    "survivors": _with("pm", """SELECT factor, 'all' AS "group" FROM es WHERE abs(t_train) > 2 AND sign(icir_train) = sign(icir_test) AND abs(icir_test) > 0.2 UNION ALL
        SELECT factor, "group" FROM eg WHERE abs(icir_train) > 0.3 AND sign(icir_train) = sign(icir_test) AND abs(icir_test) > 0.25""", **_split(_CELLS)),
    # for two columns the root of M is (M + s I) / t with s = sqrt(det M), t = sqrt(tr M + 2 s)
    "lowdin_pair": _with("pm", """SELECT stock_id, z.ym, rnd(CASE WHEN n >= 10 THEN (mom_1m * (d + s) - discount * b) * t / ((a + s) * (d + s) - b * b) END, 6) + 0.0::double AS mom_1m, rnd(CASE WHEN n >= 10 THEN (discount * (a + s) - mom_1m * b) * t / ((a + s) * (d + s) - b * b) END, 6) + 0.0::double AS discount
        FROM z JOIN m ON z.ym = m.ym""", z=_LW, g="SELECT ym, count(*) AS n, sum(mom_1m * mom_1m) + 1e-6 AS a, sum(mom_1m * discount) AS b, sum(discount * discount) + 1e-6 AS d FROM z GROUP BY ym", m="SELECT *, sqrt(a * d - b * b) AS s, sqrt(a + d + 2 * sqrt(a * d - b * b)) AS t FROM g"),
    "top_bottom": _with("pm", 'SELECT stock_id, ym, "group", place::int AS place, ng AS n_group, is_long, is_short FROM picks', **_SCORED, **_port("sc")),
    "rank_weights": _with("pm", f"SELECT stock_id, ym, {_r('w', 8)} FROM lw", **_SCORED, **_port("sc", weight="volume")),
    "turnover": _with("pm", f"SELECT ym, {_r('turnover')}, nhold FROM t", **_SCORED, **_port("sc", q="0.3")),
    "portfolio_returns": _with("pm", f'SELECT ym, rnd("long", 6) + 0.0::double AS "long", {_r("long_short benchmark turnover")}, nhold FROM rr', **_R),
    "momentum_weighted": _with("pm", f'SELECT ym, rnd("long", 6) + 0.0::double AS "long", {_r("long_short benchmark turnover")}, nhold FROM rr', **_SCORED, **_port("sc", q="0.2", weight="liq_amt"), rr=f"SELECT ym, {_legs()} FROM ret"),
    "sweep": _with("pm", f'SELECT cost, q, ym, rnd("long", 6) + 0.0::double AS "long", {_r("long_short benchmark turnover")}, nhold FROM rr', sc="SELECT *, mom_1m AS score, unnest([0.05, 0.1, 0.15, 0.2, 0.3]::double[]) AS q FROM pm", **_port("sc", "q", "q"), rr=f"SELECT q, ym, cost, {_LEGS.format(c='cost')} FROM (SELECT *, unnest([0.002, 0.004, 0.008, 0.016]::double[]) AS cost FROM ret)"),
    "strategy_returns": _with("pm", f'SELECT strategy, ym, rnd("long", 6) + 0.0::double AS "long", {_r("long_short benchmark turnover active")}, nhold FROM sr', **_STRAT),
    "performance": _with("pm", f"SELECT strategy, {_r(_PERF_COLS)}, months FROM pf", **_STRAT, **_perf("sr", '"long"', "strategy")),
    "active_stats": _with("pm", f"SELECT strategy, {_r(_EX_COLS)}, months FROM (SELECT strategy, {_excess('active')} FROM sr GROUP BY strategy HAVING count(active) >= 6)", **_STRAT),
    "leg_report": _with("pm", f"SELECT leg, period, rnd(round(cagr, 3), 6) + 0.0::double AS cagr, {_r('vol sharpe max_dd win_rate t_stat')}, months FROM pf JOIN (SELECT leg, period, avg(v) / nullif(stddev_samp(v), 0) * sqrt(count(v)) AS t_stat FROM lp GROUP BY ALL) USING (leg, period)", **_R,
        lg=" UNION ALL ".join(f"SELECT ym, '{n}' AS leg, \"{n}\" AS v FROM rr" for n in ("long", "benchmark")), lp=f"{_PART2} FROM lg", **_perf("(SELECT leg, period, ym, v AS val FROM lp)", "val", "leg, period")),
    "benchmark_table": _with("bmn", "SELECT ym, " + ", ".join(f'rnd("{n}", 6) + 0.0::double AS "{n}"' for n in _BENCH) + f" FROM (SELECT ym, {_PIVOT} FROM bmn GROUP BY ym)"),
    "large_returns": _with("bm", "SELECT name, count(*) FILTER (abs(ret) > 0.25) AS n_large, count(ret) AS n FROM bm GROUP BY name"),
    "benchmark_compare": _with("pm bmn", f"SELECT name, period, {_r('cagr sharpe max_dd ann_excess t_stat')}, x.months FROM pf JOIN (SELECT name, period, {_excess('l - bench')} FROM bb GROUP BY ALL HAVING count(*) >= 6) x USING (name, period)", **_R,
        bb=f"SELECT * FROM ({_PART2} FROM (SELECT name, ym, bmn.ret AS bench, \"long\" AS l FROM bmn JOIN rr USING (ym) WHERE bmn.ret IS NOT NULL)) WHERE period <> 'train'", **_perf("bb", "bench", "name, period")),
    "walk_forward_folds": _with("pm", """SELECT ((i - 48) // 12)::int AS fold, min(ym) AS first_test, max(ym) AS last_test, (SELECT ym FROM n m WHERE m.i = min(n.i) - 2) AS last_train FROM n WHERE i >= 48 GROUP BY (i - 48) // 12""", n="SELECT ym, row_number() OVER (ORDER BY ym) - 1 AS i FROM (SELECT DISTINCT ym FROM pm)"),
    "score_equal": _with("pm", f"SELECT stock_id, ym, rnd(({' + '.join(PARTS)}) / 5, 6) + 0.0::double AS s_equal FROM z", z=_z("(SELECT * FROM pm WHERE fwd_ret_1m IS NOT NULL)", PARTS, 0.0)),
    "sharpe_moments": _with("pm", f"SELECT strategy, {_r('sharpe skew kurt')}, months FROM (SELECT strategy, avg(active) / stddev_samp(active) AS sharpe, skewness(active) AS skew, kurtosis(active) + 3 AS kurt, count(active) AS months FROM sr GROUP BY strategy)", **_STRAT),
    "cscv_pbo": _with("pm", "SELECT count(*) AS n_splits, rnd(avg((ln(omega / (1 - omega)) <= 0)::int), 6) AS pbo FROM (SELECT *, rk / (trials + 1) AS omega FROM best)", **_STRAT,
        fm="SELECT ym FROM sr WHERE active IS NOT NULL GROUP BY ym HAVING count(*) = (SELECT count(DISTINCT strategy) FROM sr)", bl="SELECT ym, ntile(12) OVER (ORDER BY ym) AS block FROM fm",
        sp="SELECT m, b FROM (SELECT unnest(range(4096)) AS m) JOIN (SELECT unnest(range(12)) AS b) ON (m >> b) & 1 = 1 WHERE bit_count(m) = 6",
        sd="SELECT DISTINCT m FROM sp",
        io="SELECT m, strategy, avg(active) FILTER (sp2.b IS NOT NULL) / stddev_samp(active) FILTER (sp2.b IS NOT NULL) AS ins, avg(active) FILTER (sp2.b IS NULL) / stddev_samp(active) FILTER (sp2.b IS NULL) AS outs FROM (SELECT sr.*, block - 1 AS blk, m FROM sr JOIN bl USING (ym), sd) x LEFT JOIN (SELECT m AS mm, b FROM sp) sp2 ON x.m = sp2.mm AND x.blk = sp2.b GROUP BY m, strategy",
        best="SELECT * FROM (SELECT *, rank() OVER (PARTITION BY m ORDER BY outs) + (count(*) OVER (PARTITION BY m, outs) - 1) / 2.0::double AS rk, count(*) OVER (PARTITION BY m) AS trials, row_number() OVER (PARTITION BY m ORDER BY ins DESC, strategy) AS pl FROM io) WHERE pl = 1"),
    "holdings_attribution": _with("pm", f'SELECT stock_id, ym, "group", {_r("liq_pct ret w contribution")} FROM hold', **_HOLD),
    "tier_attribution": _with("pm", f"SELECT tier, count(*) AS n_holdings, rnd(avg(ret), 6) AS mean_ret, rnd(avg(liq_pct), 6) AS mean_pct, rnd(sum(contribution) / sum(sum(contribution)) OVER (), 6) AS share FROM (SELECT *, CASE WHEN liq_pct <= 1 / 3 THEN 'low' WHEN liq_pct <= 2 / 3 THEN 'mid' ELSE 'high' END AS tier FROM hold) GROUP BY tier", **_HOLD),
    "top_contributors": _with("pm", f"SELECT stock_id, {_r('contribution mean_pct')}, months, p_name AS stock_name FROM (SELECT stock_id, sum(contribution) AS contribution, avg(liq_pct) AS mean_pct, count(*) AS months FROM hold GROUP BY stock_id ORDER BY 2 DESC, 1 LIMIT 20) JOIN part ON stock_id = p_partkey::varchar", **_HOLD),
    "liquidity_filter": _with("pm", f"SELECT floor, cost, {_r('cagr sharpe ann_excess ir t_stat turnover')} FROM pf JOIN (SELECT floor, cost, {_excess('l - benchmark')}, avg(turnover) AS turnover FROM rr GROUP BY ALL) x USING (floor, cost)", **_SCORED, **_LIQ,
        lf="SELECT * FROM (SELECT *, unnest([0.0, 0.3, 0.5, 0.7]::double[]) AS floor FROM lp) WHERE liq_pct >= floor", **_port("lf", "floor"), rr="SELECT floor, ym, cost, benchmark, turnover, gain - cost * turnover AS l FROM (SELECT *, unnest([0.004, 0.008, 0.012]::double[]) AS cost FROM ret)", **_perf("rr", "l", "floor, cost")),
    "regime_stats": _with("pm", f"SELECT regime, {_r(_EX_COLS)}, months FROM (SELECT regime, {_excess('active')} FROM ({_REGIME.format(p='', src='rr')}) GROUP BY regime HAVING count(*) >= 4)", **_R),
    "regime_by_variant": _with("pm", f"SELECT variant, regime, {_r(_EX_COLS)}, months FROM (SELECT variant, regime, {_excess('active')} FROM ({_REGIME.format(p='PARTITION BY variant', src='rr')}) GROUP BY ALL HAVING count(*) >= 4)", **_SCORED, **_LIQ,
        vr="SELECT * FROM (SELECT *, unnest(['all', CASE WHEN liq_pct >= 0.7::double THEN 'liquid' END]) AS variant FROM lp) WHERE variant IS NOT NULL", **_port("vr", "variant"), rr=f"SELECT variant, ym, {_legs()} FROM ret"),
    "annual_excess": _with("pm", 'SELECT year(ym)::int AS year, rnd(product(1 + "long" - benchmark) - 1, 6) + 0.0::double AS excess FROM rr GROUP BY ALL', **_R),
    "table_overview": _with("li", """SELECT count(*) AS n_rows, 4 AS n_columns, count(DISTINCT stock_id) AS n_entities, min(date) AS first_day, max(date) AS last_day, 0::bigint AS null_stock_id, count(*) FILTER (date IS NULL) AS null_date, count(*) FILTER (l_quantity IS NULL) AS null_l_quantity, count(*) FILTER (l_discount IS NULL) AS null_l_discount,
        count(*) - count(DISTINCT (stock_id, date)) AS n_duplicates FROM li"""),
    "coverage_report": _with("px", "SELECT stock_id, min(date) AS first_day, max(date) AS last_day, count(*) AS n_days, max(date) < (SELECT max(date) FROM px) - 30 AS ends_early FROM px GROUP BY stock_id ORDER BY last_day, stock_id LIMIT 30"),
    "price_anomalies": _with("px", f"SELECT stock_id, date, {_r('close ret')}, CASE WHEN close <= 0 THEN 'non_positive' ELSE 'jump' END AS kind FROM (SELECT *, close / lag(close) OVER (PARTITION BY stock_id ORDER BY date) - 1 AS ret FROM px) WHERE close <= 0 OR abs(ret) > 0.4"),
    "calendar_gaps": _with("px", "SELECT stock_id, count(*) AS n_days, (SELECT count(DISTINCT date) FROM px) AS market_days FROM px GROUP BY stock_id ORDER BY n_days, stock_id LIMIT 5"),
    "item_catalog": _with("fin", "SELECT DISTINCT type FROM fin ORDER BY type LIMIT 10"),
    "samples": _with("px", f"SELECT stock_id, date, {_r('close')}, CASE WHEN a <= 3 THEN 'first' ELSE 'last' END AS \"where\" FROM (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY date) AS a, row_number() OVER (PARTITION BY stock_id ORDER BY date DESC) AS z FROM px WHERE stock_id IN ('0001', '0003')) WHERE a <= 3 OR z <= 3"),
    "reconcile": _with("bmn", f"SELECT ym, {_r('a b difference')} FROM (SELECT ym, x.ret AS a, y.ret AS b, x.ret - y.ret AS difference FROM (SELECT * FROM bmn WHERE name = '1-URGENT') x FULL JOIN (SELECT * FROM bmn WHERE name = '2-HIGH') y USING (ym) ORDER BY abs(difference) DESC NULLS LAST, ym LIMIT 10)"),
    "agreement": _with("bmn", "SELECT count(*) AS months, rnd(corr(x.ret, y.ret), 6) AS correlation FROM bmn x JOIN bmn y USING (ym) WHERE x.name = '1-URGENT' AND y.name = '2-HIGH' AND x.ret IS NOT NULL AND y.ret IS NOT NULL"),
    "price_on_or_before": _with("px li", "SELECT d.stock_id, d.day, px.date AS price_day, rnd(close, 6) AS close FROM (SELECT DISTINCT stock_id, date_trunc('month', date)::date + 14 AS day FROM li) d ASOF LEFT JOIN px ON d.stock_id = px.stock_id AND d.day >= px.date"),
    "key_coverage": _with("px info", "SELECT stock_id, count(date) AS n_rows, min(date) AS first_day, max(date) AS last_day, coalesce(max(date) < DATE '2001-06-01', true) AS truncated FROM (SELECT stock_id FROM info UNION SELECT 'none') LEFT JOIN px USING (stock_id) GROUP BY stock_id"),
    "formula_eval": _with("pm", f"SELECT stock_id, ym, {_r('f1 f2 f3 f4')} FROM fm", **_FM),
    "formula_fitness": _with("pm", "SELECT name, rnd(icir, 6) + 0.0::double AS icir, rnd(CASE WHEN n >= 200 AND nv >= 5 AND months >= 12 AND icir IS NOT NULL THEN abs(icir) - 0.0008 * size ELSE -9.0 END, 6) AS fitness FROM fu LEFT JOIN fs USING (name)", **_FC,
        fu="SELECT factor AS name, count(*) AS n, count(DISTINCT x) AS nv, CASE factor " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _SIZES.items()) + " END AS size FROM long GROUP BY factor",
        fp="SELECT factor, ym, covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0) AS ic FROM ranked GROUP BY ALL", fs="SELECT factor AS name, count(ic) AS months, avg(ic) / nullif(stddev_samp(ic), 0) AS icir FROM fp WHERE ic IS NOT NULL GROUP BY factor"),
    "formula_split": _with("pm", f"SELECT factor, {_r('icir_train icir_test')}, coalesce(sign(icir_train) = sign(icir_test) AND abs(icir_test) > 0.2, false) AS stable FROM es", **_split(_FC)),
    "best_operand": _with("pm", f"SELECT factor, {_r('icir_train icir_test')} FROM es ORDER BY abs(es.icir_train) DESC NULLS LAST, factor LIMIT 1", **_split(_CELLS)),
}
ORACLES["asof_ranges"] = ORACLES["asof_revenue"]
ORACLES = {k: _expand(v) for k, v in ORACLES.items()}
#: Other ways to the same rows.
ORACLES |= {"asof_panel_spans": ORACLES["asof_panel"], "incremental_panel": ORACLES["asof_panel"], "rolling_blocks": ORACLES["rolling_windows"], "panel_table": ORACLES["rolling_windows"], "landing_keyed": ORACLES["landing_merge"]}
ORACLES |= {"profile_overview": ORACLES["table_overview"], "profile_coverage": ORACLES["coverage_report"], "profile_gaps": ORACLES["calendar_gaps"]}
_TEXT = {"f1": "(mom_1m - discount)", "f2": "(neg(mom_1m) / abs(liq_amt))", "f3": "log((volume * 2))", "f4": "(sqrt(mom_3m) + liq_amt)"}
ORACLES["formula_report"] = "SELECT name, CASE name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TEXT.items()) + f" END AS formula, fitness FROM ({ORACLES['formula_fitness']})"
