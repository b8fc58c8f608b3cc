"""Independent DuckDB SQL for every registered query (the correctness oracle).

Written directly in SQL over the driver's tables (views ``events``, ``orders``, ``lineitem`` ...):
per-ticker windows with PARTITION BY, the EMA recurrence as a recursive CTE. Helpers here only
assemble CTE text; they hold no Spark logic.
"""

from __future__ import annotations

import math

from barspark import config

# ---------------------------------------------------------------------------------------------
# small text helpers
# ---------------------------------------------------------------------------------------------


def r(expr: str, digits: int = 6) -> str:
    """Rounded double; ``+ 0.0`` folds -0.0 into 0.0 (Spark's round never yields -0.0)."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def rsig(expr: str, digits: int = 10) -> str:
    """Significant-digit rounding matching ``round_sig`` in the Spark helpers."""
    sc = f"CAST('1e' || CAST(CAST(floor(log10(abs({expr}))) AS BIGINT) AS VARCHAR) AS DOUBLE)"
    return f"(CASE WHEN ({expr}) = 0 THEN 0.0 ELSE round(({expr}) / {sc}, {digits - 1}) * {sc} END + 0.0)"


def rcols(cols, digits: int = 6, src: str = "") -> str:
    p = f"{src}." if src else ""
    return ", ".join(f'{r(p + q(c), digits)} AS {q(c)}' for c in cols)


def q(c: str) -> str:
    return f'"{c}"'


def ntz(expr: str) -> str:
    return expr  # DuckDB TIMESTAMP is already naive wall clock in UTC


def india(t: str = "Ticker") -> str:
    conds = " OR ".join(f"upper({t}) LIKE '%{s}'" for s in config.INDIA_SUFFIXES)
    return f"({conds})"


def tz(t: str = "Ticker") -> str:
    return f"(CASE WHEN {india(t)} THEN '{config.INDIA_MARKET['timezone']}' ELSE '{config.US_MARKET['timezone']}' END)"


def open_min(t: str = "Ticker") -> str:
    return f"(CASE WHEN {india(t)} THEN {config.INDIA_MARKET['open_min']} ELSE {config.US_MARKET['open_min']} END)"


def close_min(t: str = "Ticker") -> str:
    return f"(CASE WHEN {india(t)} THEN {config.INDIA_MARKET['close_min']} ELSE {config.US_MARKET['close_min']} END)"


def local(ts: str = '"Timestamp"', t: str = "Ticker") -> str:
    return f"timezone({tz(t)}, timezone('UTC', {ts}))"


def weekday(expr: str) -> str:
    return f"(isodow({expr}) - 1)"


def roll(agg: str, x: str, n: int, w: str) -> str:
    """pandas rolling(n): NULL until n non-null values. Sums and means add the frame oldest to
    newest (``list_sum``), the same order as a sliding frame in Spark, so exact-decimal inputs
    round identically."""
    frame = f"(PARTITION BY {w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    if agg == "sum":
        value = f"list_sum(list({x}) OVER {frame})"
    elif agg == "avg":
        value = f"(list_sum(list({x}) OVER {frame}) / {n})"
    else:
        value = f"{agg}({x}) OVER {frame}"
    return f"(CASE WHEN count({x}) OVER {frame} = {n} THEN {value} END)"


def div(a: str, b: str) -> str:
    return f"(({a}) / NULLIF(({b}), 0))"


# ---------------------------------------------------------------------------------------------
# bar views (FIXTURES.md §2)
# ---------------------------------------------------------------------------------------------

BARS_HOURLY = """
SELECT date_trunc('hour', ts) AS "Timestamp",
       upper(event_type) || CASE WHEN event_type IN ('click','view') THEN '.NS' ELSE '' END AS Ticker,
       arg_min(value, (ts, event_id)) AS "Open", max(value) AS "High", min(value) AS "Low",
       arg_max(value, (ts, event_id)) AS "Close", CAST(count(*) AS DOUBLE) AS "Volume", 0 AS _seq
FROM events GROUP BY 1, 2
"""

BARS_DAILY = """
SELECT o_orderdate AS "Timestamp",
       upper(substr(o_orderpriority, 3, 3)) || CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN '.NS' ELSE '' END AS Ticker,
       arg_min(o_totalprice, o_orderkey) AS "Open", max(o_totalprice) AS "High", min(o_totalprice) AS "Low",
       arg_max(o_totalprice, o_orderkey) AS "Close", CAST(count(*) AS DOUBLE) AS "Volume", 0 AS _seq
FROM orders GROUP BY 1, 2
"""

BARS_SUPPLIER = """
SELECT date_trunc('day', l_shipdate) AS "Timestamp",
       CAST(l_suppkey AS VARCHAR) || CASE WHEN l_suppkey % 2 = 0 THEN '.NS' ELSE '' END AS Ticker,
       arg_min(l_extendedprice / NULLIF(l_quantity, 0), (l_orderkey, l_linenumber, l_extendedprice / NULLIF(l_quantity, 0))) AS "Open",
       max(l_extendedprice / NULLIF(l_quantity, 0)) AS "High", min(l_extendedprice / NULLIF(l_quantity, 0)) AS "Low",
       arg_max(l_extendedprice / NULLIF(l_quantity, 0), (l_orderkey, l_linenumber, l_extendedprice / NULLIF(l_quantity, 0))) AS "Close",
       sum(l_quantity) AS "Volume", 0 AS _seq
FROM lineitem GROUP BY 1, 2
"""

BARS_DIRTY = f"""
SELECT "Timestamp", Ticker, "Open", "High", "Low",
       CASE WHEN hour("Timestamp") % 7 <> 0 THEN "Close" END AS "Close",
       CASE WHEN Ticker <> 'VIEW.NS' THEN "Volume" END AS "Volume", _seq
FROM (SELECT * FROM ({BARS_HOURLY}) h
      UNION ALL
      SELECT "Timestamp", Ticker, "Open", "High", "Low", "Close" * 1.01, "Volume", 1 AS _seq
      FROM ({BARS_HOURLY}) h2 WHERE "Volume" % 3 = 0) u
"""

VIEWS = {"hourly": BARS_HOURLY, "daily": BARS_DAILY, "supplier": BARS_SUPPLIER, "dirty": BARS_DIRTY}


def cadence(src: str) -> str:
    """(Ticker, n_bars, median_gap_seconds, is_daily) over bar CTE ``src``."""
    return f"""
SELECT Ticker, count(*) AS n_bars, quantile_cont(gap, 0.5) AS median_gap_seconds,
       coalesce(count(*) >= 2 AND quantile_cont(gap, 0.5) >= {config.DAILY_MEDIAN_GAP_SECONDS}, false) AS is_daily
FROM (SELECT Ticker, epoch("Timestamp") - epoch(lag("Timestamp") OVER (PARTITION BY Ticker ORDER BY "Timestamp", _seq)) AS gap
      FROM {src} WHERE Ticker IS NOT NULL AND "Timestamp" IS NOT NULL) g
GROUP BY Ticker"""


def trading_hours(src: str) -> str:
    """B08 over bar CTE ``src`` (keeps _seq); dedup first copy."""
    loc = local()
    return f"""
SELECT "Timestamp", Ticker, "Open", "High", "Low", "Close", "Volume", _seq FROM (
  SELECT b.*, row_number() OVER (PARTITION BY b.Ticker, b."Timestamp" ORDER BY b._seq) AS _first
  FROM {src} b JOIN ({cadence(src)}) c USING (Ticker)
  WHERE {weekday(loc)} < 5
    AND (c.is_daily OR (hour({loc}) * 60 + minute({loc}) BETWEEN {open_min()} AND {close_min()}))
) f WHERE _first = 1"""


def clean(src: str, scope: str = "ticker") -> str:
    """Trading hours -> ffill -> bfill -> drop incomplete (as SQL over bar CTE ``src``)."""
    cols = config.PRICE_COLUMNS
    ff = ", ".join(
        f'last_value({q(c)} IGNORE NULLS) OVER (PARTITION BY Ticker ORDER BY "Timestamp" '
        f'ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {q(c)}' for c in cols)
    bf = ", ".join(
        f'first_value({q(c)} IGNORE NULLS) OVER (PARTITION BY Ticker ORDER BY "Timestamp" '
        f'ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {q(c)}' for c in cols)
    body = f"""
SELECT "Timestamp", Ticker, {bf} FROM (
  SELECT "Timestamp", Ticker, {ff} FROM ({trading_hours(src)}) th
) f"""
    if scope == "global":
        gx = ", ".join(
            f'coalesce({q(c)}, first_value({q(c)} IGNORE NULLS) OVER (ORDER BY Ticker, "Timestamp" '
            f'ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {q(c)}' for c in cols)
        body = f'SELECT "Timestamp", Ticker, {gx} FROM ({body}) g'
    nn = " AND ".join(f"{q(c)} IS NOT NULL" for c in cols)
    return f"SELECT * FROM ({body}) x WHERE {nn}"


def with_views(body: str, ctes) -> str:
    """``WITH RECURSIVE`` + (name, sql) pairs; a name may carry a column list."""
    parts = ",\n".join(f"{name} AS ({sql})" for name, sql in ctes)
    return f"WITH RECURSIVE {parts}\n{body}"


def ema_cte(src: str, steps, x_cols=("Close",)) -> str:
    """Recursive CTE computing chained EMAs per Ticker over ``src`` (must carry ``rn`` from 0).

    steps: list of (out, source, span) where source is a column of src or (a, b) = a - b of earlier outputs.
    """
    def expr_at(src_spec, row_alias, prev_alias, known):
        if isinstance(src_spec, str):
            return f"{row_alias}.{q(src_spec)}"
        a, b = src_spec
        return f"({known[a]} - {known[b]})"

    init_known, rec_known = {}, {}
    init_sel, rec_sel = [], []
    for out, s, span in steps:
        alpha = 2.0 / (span + 1.0)
        x0 = expr_at(s, "b", "e", init_known)
        init_known[out] = x0
        init_sel.append(f"{x0} AS {q(out)}")
        xt = expr_at(s, "b", "e", rec_known)
        y = f"({1.0 - alpha!r} * e.{q(out)} + {alpha!r} * {xt})"
        rec_known[out] = y
        rec_sel.append(f"{y} AS {q(out)}")
    outs = ", ".join(q(o) for o, _, _ in steps)
    return f"""
SELECT b.Ticker, b.rn, {', '.join(init_sel)} FROM {src} b WHERE b.rn = 0
UNION ALL
SELECT b.Ticker, b.rn, {', '.join(rec_sel)} FROM ema_rec e JOIN {src} b ON b.Ticker = e.Ticker AND b.rn = e.rn + 1
""", f"ema_rec(Ticker, rn, {outs})"


def ema_memory(span: float, tol: float = config.EMA_TOLERANCE) -> int:
    d = 1.0 - 2.0 / (span + 1.0)
    return int(math.ceil(math.log(tol) / math.log(d))) if d > 0 else 0
