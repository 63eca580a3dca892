"""SQL fragments (DuckDB dialect) from which the oracle of each query is put together."""

from __future__ import annotations


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def _shape(ticks: str) -> str:
    return f"""
  WITH t AS ({ticks}),
  d AS (
    SELECT ticker, dt, SUM(q) AS volume, COUNT(*) AS n, SUM(disc) AS sd,
           MIN(disc) AS nd, MAX(disc) AS xd, SUM(tax) AS st
    FROM t GROUP BY ticker, dt),
  r AS (
    SELECT *, CAST(ROUND((CAST(sd AS DOUBLE) / n - CAST(4.5 AS DOUBLE)) * 20) AS BIGINT) AS step
    FROM d),
  c AS (
    SELECT *, ROUND(100 * EXP(CAST(SUM(step) OVER (PARTITION BY ticker ORDER BY dt
                    ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 10000), 4) AS close,
           ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY dt) - 1 AS i
    FROM r),
  b AS (
    SELECT *, close * (1 - (CAST(st AS DOUBLE) / n - 4) / 500) AS open FROM c)
  SELECT ticker, dt, i, open,
         GREATEST(open, close) * (1 + CAST(xd AS DOUBLE) / 1000) AS high,
         LEAST(open, close) * (1 - CAST(10 - nd AS DOUBLE) / 1000) AS low,
         close, volume
  FROM b
"""


_NATION_TICKS = """
    SELECT n.n_name AS ticker, CAST(l.l_shipdate AS DATE) AS dt, l.l_quantity AS q,
           CAST(ROUND(l.l_discount * 100) AS BIGINT) AS disc,
           CAST(ROUND(l.l_tax * 100) AS BIGINT) AS tax
    FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
                    JOIN nation n ON s.s_nationkey = n.n_nationkey
"""
_MARKET_TICKS = """
    SELECT 'MKT', CAST(l_shipdate AS DATE), l_quantity,
           CAST(ROUND(l_discount * 100) AS BIGINT), CAST(ROUND(l_tax * 100) AS BIGINT)
    FROM lineitem
"""
_SUPPLIER_TICKS = """
    SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS dt, l_quantity AS q,
           CAST(ROUND(l_discount * 100) AS BIGINT) AS disc,
           CAST(ROUND(l_tax * 100) AS BIGINT) AS tax
    FROM lineitem
"""

BARS = f"bars AS MATERIALIZED ({_shape(_NATION_TICKS + ' UNION ALL ' + _MARKET_TICKS)})"
WIDE = f"bars AS MATERIALIZED ({_shape(_SUPPLIER_TICKS)})"

INTRADAY = """raw AS MATERIALIZED (
  SELECT event_type AS ticker, CAST(FLOOR(epoch(ts) / 900) * 900 AS BIGINT) AS t,
         ARG_MIN(value, (ts, event_id)) AS o, MAX(value) AS h, MIN(value) AS l,
         ARG_MAX(value, (ts, event_id)) AS c, CAST(COUNT(*) AS DOUBLE) AS v
  FROM events GROUP BY 1, 2)"""

SECTORS = """sectors AS (
  SELECT n_name AS ticker, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey)"""

W = "PARTITION BY ticker ORDER BY i"


def rows(n: int, skip: int = 0) -> str:
    return f"({W} ROWS BETWEEN {n - 1 + skip} PRECEDING AND {skip} PRECEDING)" if skip else (
        f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    )


def full(agg: str, x: str, n: int, skip: int = 0) -> str:
    """Aggregate over exactly n rows, else null."""
    over = rows(n, skip)
    return f"CASE WHEN COUNT({x}) OVER {over} >= {n} THEN {agg}({x}) OVER {over} END"


def median(x: str, n: int) -> str:
    over = rows(n)
    return f"CASE WHEN COUNT({x}) OVER {over} >= {n} THEN QUANTILE_CONT({x}, 0.5) OVER {over} END"


def lag(x: str, n: int = 1) -> str:
    return f"LAG({x}, {n}) OVER ({W})"


TRUE_RANGE = (
    f"GREATEST(high - low, ABS(high - {lag('close')}), ABS(low - {lag('close')}))"
)


def ema(src: str, out: str, cols: dict[str, tuple[str, float, int]]) -> str:
    """CTEs adding exponentially smoothed columns {name: (input, alpha, rows needed)} to ``src``."""
    size = 512
    xs = ", ".join(f"{x} AS x_{k}" for k, (x, _, _) in cols.items())
    ns = ", ".join(
        f"COUNT(x_{k}) OVER ({W} ROWS UNBOUNDED PRECEDING) AS n_{k}" for k in cols
    )
    ls = ", ".join(
        f"SUM(COALESCE((CASE WHEN n_{k} = 1 THEN 1.0::DOUBLE ELSE {a!r}::DOUBLE END) * x_{k}, 0::DOUBLE)"
        f" * POW({1.0 - a!r}::DOUBLE, -p_)) OVER (PARTITION BY ticker, b_ ORDER BY i ROWS UNBOUNDED PRECEDING)"
        f" * POW({1.0 - a!r}::DOUBLE, p_) AS l_{k}"
        for k, (_, a, _) in cols.items()
    )
    ends = ", ".join(f"l_{k}" for k in cols)
    carries = ", ".join(
        f"SUM(e.l_{k} * POW(POW({1.0 - a!r}::DOUBLE, {size}), g.b_ - 1 - e.b_)) AS c_{k}"
        for k, (_, a, _) in cols.items()
    )
    outs = ", ".join(
        f"CASE WHEN n_{k} >= {m} THEN l_{k} + COALESCE(c_{k}, 0) * POW({1.0 - a!r}::DOUBLE, p_ + 1) END AS {k}"
        for k, (_, a, m) in cols.items()
    )
    drop = ", ".join(["b_", "p_"] + [f"{h}_{k}" for h in "xnl" for k in cols])
    return f"""{out}_x AS (SELECT *, i // {size} AS b_, i % {size} AS p_, {xs} FROM {src}),
{out}_n AS (SELECT *, {ns} FROM {out}_x),
{out}_l AS MATERIALIZED (SELECT *, {ls} FROM {out}_n),
{out}_e AS (SELECT ticker, b_, {ends} FROM {out}_l WHERE p_ = {size - 1}),
{out}_c AS (SELECT g.ticker, g.b_, {carries} FROM (SELECT DISTINCT ticker, b_ FROM {out}_l) g
  JOIN {out}_e e ON e.ticker = g.ticker AND e.b_ < g.b_ GROUP BY g.ticker, g.b_),
{out} AS MATERIALIZED (SELECT s.* EXCLUDE ({drop}), {outs}
  FROM {out}_l s LEFT JOIN {out}_c c ON c.ticker = s.ticker AND c.b_ = s.b_)"""


def span(x: str, n: int, min_rows: int = 1) -> tuple[str, float, int]:
    return (x, 2.0 / (n + 1), min_rows)


def wilder(x: str, n: int = 14, min_rows: int = 1) -> tuple[str, float, int]:
    return (x, 1.0 / n, min_rows)


def rsi(g: str, lo: str, cap: bool = True) -> str:
    base = f"100 - 100 / (1 + {g} / NULLIF({lo}, 0))"
    return f"CASE WHEN {lo} = 0 AND {g} > 0 THEN 100.0::DOUBLE ELSE {base} END" if cap else base


GAIN = f"GREATEST(close - {lag('close')}, 0 * (close - {lag('close')}))"
LOSS = f"GREATEST({lag('close')} - close, 0 * (close - {lag('close')}))"

MOVES = f"""moves AS (SELECT *, {TRUE_RANGE} AS tr, CASE WHEN i > 0 THEN GREATEST(close - pc, 0) END AS g_,
  CASE WHEN i > 0 THEN GREATEST(pc - close, 0) END AS lo_ FROM (SELECT *, {lag('close')} AS pc FROM bars))"""

FEATURES = ",\n".join(
    [
        MOVES,
        ema(
            "moves",
            "smoothed",
            {f"ema{n}": span("close", n, n) for n in (10, 20, 50, 200)}
            | {
                "atr": wilder("tr", 14, 14),
                "atr50": wilder("tr", 50, 50),
                "g14": wilder("g_", 14, 14),
                "l14": wilder("lo_", 14, 14),
                "g2": wilder("g_", 2, 2),
                "l2": wilder("lo_", 2, 2),
            },
        ),
        f"""feats_0 AS (SELECT *, {rsi('g14', 'l14')} AS rsi, {rsi('g2', 'l2')} AS rsi2,
  {median('close * volume', 20)} AS ddv,
  {full('MAX', 'high', 20)} AS hh20, {full('MAX', 'high', 60)} AS hh60,
  {full('MIN', 'low', 10)} AS ll10, {full('MIN', 'low', 20)} AS ll20,
  close / {lag('close', 21)} - 1 AS ret21, close / {lag('close', 63)} - 1 AS ret63,
  close / {lag('close', 126)} - 1 AS ret126, close / {lag('close', 252)} - 1 AS ret252,
  {full('AVG', 'volume', 3)} / ({full('AVG', 'volume', 50)}) AS vol_ratio,
  atr / NULLIF(atr50, 0) AS atr_ratio, atr / close AS atr_pct,
  close / ema20 - 1 AS dist_ema20, close / ema50 - 1 AS dist_ema50
  FROM smoothed)""",
        "feats AS MATERIALIZED (SELECT *, close / hh60 - 1 AS dist_hh60 FROM feats_0)",
    ]
)
