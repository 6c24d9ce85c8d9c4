"""Shared common table expressions of the SQL equivalents; each names those that it needs."""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


def sql(select: str, *needs: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for x in CTES[name][0]:
                visit(x)
            order.append(name)

    for n in needs:
        visit(n)
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    return f"WITH {head}\n{select}" if head else select


def r6(x: str, name: str | None = None) -> str:
    return f"round({x}, 6) + 0.0::DOUBLE" + (f" AS {name}" if name else "")


def guard(agg: str, value: str, n: int, w: str = "PARTITION BY symbol ORDER BY dt") -> str:
    """A rolling aggregate, null until n values are there."""
    frame = f"({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({value}) OVER {frame} = {n} THEN {agg} OVER {frame} END)"


W = "(PARTITION BY symbol ORDER BY dt)"

SYMBOL = """CASE k % 5 WHEN 0 THEN 'B' || k || '-USD' WHEN 1 THEN 'B' || k || '.WA' WHEN 2 THEN 'B' || k || '.DE' WHEN 3 THEN '^B' || k ELSE 'B' || k END"""
cte("brands", f"SELECT p_partkey, p_type, {SYMBOL} AS symbol FROM (SELECT *, CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) AS k FROM part)")
cte(
    "ticks",
    """SELECT symbol, CAST(l_shipdate AS DATE) AS dt, round(power(l_extendedprice / l_quantity, 0.02), 6) AS px, l_quantity AS volume,
    l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem JOIN brands ON l_partkey = p_partkey
    WHERE symbol LIKE '%-USD' OR isodow(l_shipdate) < 6""",
    "brands",
)
ORD = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, volume"
DESC = ", ".join(f"{c} DESC" for c in ORD.split(", "))
cte("bars", f"SELECT symbol, dt, first(px ORDER BY {ORD}) AS open, max(px) AS high, min(px) AS low, first(px ORDER BY {DESC}) AS close, sum(volume) AS volume FROM ticks GROUP BY symbol, dt", "ticks")
cte("anns", "SELECT symbol, CASE WHEN avg(CASE WHEN isodow(dt) >= 6 THEN 1.0 ELSE 0.0 END) > 0.10 THEN 365.0::DOUBLE ELSE 252.0::DOUBLE END AS ann FROM bars GROUP BY symbol", "bars")
cte("base0", f"SELECT b.*, ann, lag(close) OVER {W} AS prev, row_number() OVER {W} AS pos FROM bars b JOIN anns USING (symbol)", "bars", "anns")
cte("base", "SELECT *, ln(close / prev) AS lr, CASE WHEN close IS NOT NULL AND prev IS NOT NULL THEN least(ln(close / prev), 0.0) END AS dlr FROM base0", "base0")


def ewm(value: str, alpha: float, start: int) -> str:
    """A recursive average in closed form over the row number; the first value is in row `start`."""
    d = 1 - alpha
    return (
        f"(CASE WHEN pos >= {start} THEN power({d!r}::DOUBLE, pos - {start}) * sum(CASE WHEN pos = {start} THEN {value} WHEN pos > {start} THEN {alpha!r}::DOUBLE * {value} * power({d!r}::DOUBLE, {start} - pos) END) "
        "OVER (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING) END)"
    )


cte(
    "osc0",
    f"""SELECT *, {ewm('greatest(close - prev, 0.0)', 1 / 14, 2)} AS g, {ewm('greatest(prev - close, 0.0)', 1 / 14, 2)} AS l,
    {ewm('CASE WHEN prev IS NULL THEN high - low ELSE greatest(high - low, abs(high - prev), abs(low - prev)) END', 1 / 14, 1)} AS a,
    {ewm('close', 2 / 13, 1)} AS e12, {ewm('close', 2 / 27, 1)} AS e26 FROM base""",
    "base",
)
cte("osc1", "SELECT *, 100 - 100 / (1 + g / nullif(l, 0)) AS rsi, (e12 - e26) / close AS macd, a / close AS atr_pct FROM osc0", "osc0")
cte("osc", f"SELECT *, (rsi - 50) / 50 AS rsi_14, macd - {ewm('macd', 2 / 10, 1)} AS macd_signal FROM osc1", "osc1")
