"""The same queries in DuckDB SQL, written apart from the Spark operators: one chain of common table expressions, of
which each query uses what it needs."""

from __future__ import annotations

from curves.functions import vocab as V
from curves.operators import diagnostics as D
from curves.sources.bars import YEARS

M = V.MONTHS
#: Added before rounding, on both sides.
NUDGE = 3e-10


def _values(rows) -> str:
    sql = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return "VALUES " + ", ".join("(" + ", ".join(map(sql, r)) + ")" for r in rows)


def _tok(ym: str) -> str:
    return f"(substr('{M}', ({ym}) % 12 + 1, 1) || (({ym}) // 12) % 10)"


def _year(month: str, token: str, last: str) -> str:
    base = f"(year({last}) - year({last}) % 10 + {token})"
    fits = ", ".join(f"CASE WHEN make_date({base} + ({k}), {month}, 1) >= {last} THEN {base} + ({k}) END" for k in (-10, 0, 10))
    return f"CASE WHEN {token} >= 10 THEN 2000 + {token} ELSE coalesce({fits}, {base} + 20) END"


def _far(month: str, token: str, year: str, near: str) -> str:
    base = f"({year} - {year} % 10 + {token})"
    fits = ", ".join(f"CASE WHEN ({base} + ({k}) > {year}) OR ({base} + ({k}) = {year} AND {month} > {near}) THEN {base} + ({k}) END" for k in (-10, 0, 10))
    return f"CASE WHEN {token} >= 10 THEN 2000 + {token} ELSE coalesce({fits}, {base} + 20) END"


def _family(name: str, pattern: str, cols: str, trim: bool = True) -> str:
    """Bars of a family: first of a day in the feed, well formed, in the last year of their contract."""
    cut = "QUALIFY date >= max(date) OVER (PARTITION BY instrument_id, symbol) - INTERVAL 12 MONTH" if trim else ""
    return f"""
{name}_p AS (SELECT *, {cols}, max(date) OVER (PARTITION BY instrument_id, symbol) AS last
        FROM (SELECT * FROM clean WHERE regexp_matches(symbol, '{pattern}') {cut}))"""


def _spread(name: str, gap: int) -> str:
    far = f"(n.expiry_year * 12 + n.month - 1 + {gap})"
    return f"""
{name} AS (SELECT n.date, n.contract AS near_contract, n.close AS near_close, n.month AS near_month, n.expiry_year AS near_year,
        f.contract AS far_contract, f.close AS far_close, n.close - f.close AS close, n.contract || '-' || f.contract AS contract,
        '{name}' AS structure, {gap} AS gap_months, 2 AS n_legs
    FROM legs n JOIN legs f ON f.date = n.date AND f.expiry_year = {far} // 12 AND f.month = {far} % 12 + 1
    QUALIFY n.date >= max(n.date) OVER (PARTITION BY n.contract || '-' || f.contract) - INTERVAL 12 MONTH)"""


_dim = []
for _key, _label, _level, _legs in V.STRUCTURES:
    _at = [12 * y + M.index(m) for m, y, _ in _legs]
    _text = " ".join(f"{'-' if c < 0 else '+'}{int(abs(c)) if abs(c) != 1 else ''}{m}{f'+{y}y' if y else ''}" for m, y, c in _legs)
    _dim.append((_key, _label, _level, len(_legs), max(_at) - min(_at), M.index(_legs[0][0]) + 1, _legs[0][1], _text))
_leg_rows = [(k, i, m, y, c) for k, _, _, ls in V.STRUCTURES for i, (m, y, c) in enumerate(ls)]
_SER = "PARTITION BY structure, vintage ORDER BY date"


def _last_n(n: int) -> str:
    return f"OVER ({_SER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(f: str, n: int, col: str = "close") -> str:
    return f"CASE WHEN count({col}) {_last_n(n)} = {n} THEN {f}({col}) {_last_n(n)} END"


def _ew(alpha: str, x: str, before: str) -> str:
    return f"CASE WHEN {before} IS NULL THEN {x} ELSE {alpha} * {x} + (1 - {alpha}) * {before} END"


_MACD = f"({_ew('(2.0/13)', 'p.close', 's.e12')} - ({_ew('(2.0/27)', 'p.close', 's.e26')}))"
_TR, _UP, _DN = "abs(p.close - p.prev)", "greatest(p.close - p.prev, 0)", "greatest(p.prev - p.close, 0)"
_A10, _A14 = (f"({_ew(f'(1.0/{n})', _TR, f's.a{n}')})" for n in (10, 14))
_U14, _D14 = (f"({_ew('(1.0/14)', x, f's.{n}')})" for x, n in ((_UP, "u14"), (_DN, "d14")))
_FU = f"(CASE WHEN s.fu IS NULL OR p.close + 3 * {_A10} < s.fu OR p.prev > s.fu THEN p.close + 3 * {_A10} ELSE s.fu END)"
_FL = f"(CASE WHEN s.fl IS NULL OR p.close - 3 * {_A10} > s.fl OR p.prev < s.fl THEN p.close - 3 * {_A10} ELSE s.fl END)"
_DX = f"(100 * abs(100 * {_U14} / nullif({_A14}, 0) - 100 * {_D14} / nullif({_A14}, 0)) / nullif(100 * {_U14} / nullif({_A14}, 0) + 100 * {_D14} / nullif({_A14}, 0), 0))"



def _matrix_sql(name: str, values: str) -> str:
    """Cross products of the values v at positions p of each row r, as a matrix m in order of p; yy is its last element."""
    return f"""
{name} AS (SELECT structure, vintage, list(row ORDER BY i) AS m, max_by(row, i)[-1] AS yy FROM (
    SELECT structure, vintage, i, list(g ORDER BY j) AS row FROM (
        SELECT a.structure, a.vintage, a.p AS i, b.p AS j, sum(a.v * b.v) AS g FROM {values} a JOIN {values} b USING (structure, vintage, r) GROUP BY ALL)
    GROUP BY ALL) GROUP BY ALL)"""


def _elimination_sql(name: str, matrix: str, last: str) -> str:
    """The matrix after p pivots, for every p up to last; sound unless a column depends on those before."""
    cell = "m[i][j] - m[i][p + 1] * m[p + 1][j] / nullif(m[p + 1][p + 1], 0)"
    return f"""
{name} AS (SELECT structure, vintage, 0 AS p, m, yy, list_transform(range(1, len(m) + 1), lambda i: m[i][i]) AS diagonal, true AS sound FROM {matrix}
    UNION ALL SELECT structure, vintage, p + 1, list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 1), lambda j: {cell})), yy, diagonal,
        sound AND m[p + 1][p + 1] > 1e-10 * diagonal[p + 1] FROM {name} WHERE p < {last})"""


def _polynomial_sql(x: str, coefs, when: str, other) -> str:
    sql = lambda cs: " + ".join(f"{c} * pow({x}, {i})" for i, c in enumerate(cs))
    return f"CASE WHEN {when} THEN {sql(coefs)} ELSE {sql(other)} END"


_CTES = [
    f"""
src AS (SELECT *, l_shipdate::DATE AS date, year(l_shipdate) * 12 + month(l_shipdate) + 1 + l_partkey % 11
            + CASE l_linenumber WHEN 7 THEN 12 WHEN 6 THEN 24 ELSE 0 END AS ym,
            l_extendedprice / 1000 AS o, l_extendedprice / 1000 * (1 + l_tax - l_discount) AS c, l_suppkey % 12 AS k, l_suppkey % 2 AS p FROM lineitem),
bars AS (SELECT *, ym AS instrument_id, 'CL' || {_tok("ym")} AS symbol, o AS open, c AS close FROM src
    UNION ALL SELECT *, 100000 + ym * 20 + k, 'CL' || {_tok("ym")} || '-CL' || {_tok("ym + 1 + k")}, o / 50 - 1, c / 50 - 1 FROM src WHERE l_linenumber = 4
    UNION ALL SELECT *, 200000 + ym * 2 + p, 'CL:C1 ' || CASE p WHEN 0 THEN 'HO' ELSE 'RB' END || '-CL ' || {_tok("ym")}, o / 5, c / 5 FROM src WHERE l_linenumber = 3
    UNION ALL SELECT *, 300000 + ym * 2 + p, 'CL' || {_tok("ym")} || '-BZ' || {_tok("ym + p")}, -o / 20, -c / 20 FROM src WHERE l_linenumber = 2
    UNION ALL SELECT *, 400000 + ym, 'MCL' || {_tok("ym")}, o, c FROM src WHERE l_linenumber = 1),
feed AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, instrument_id::BIGINT AS instrument_id, symbol, date, open, greatest(open, close) AS high,
        CASE WHEN l_quantity = 1 THEN greatest(open, close) + 0.01 ELSE least(open, close) END AS low, close, l_quantity::BIGINT AS volume FROM bars),
clean AS (SELECT instrument_id, symbol, date, open, high, low, close, volume FROM (SELECT * FROM feed
        QUALIFY row_number() OVER (PARTITION BY date, symbol ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) = 1) WHERE high >= low)""",
    _family("outright", V.OUTRIGHT, "symbol[3:3] AS month_code, symbol[4:]::INT AS year_digit, instr('" + M + "', symbol[3:3])::INT AS month"),
    _family("leg", V.OUTRIGHT, "symbol[3:3] AS month_code, symbol[4:]::INT AS year_digit, instr('" + M + "', symbol[3:3])::INT AS month", False),
    f"""
outrights AS (SELECT * EXCLUDE (last), 'CL' || month_code || expiry_year AS contract
    FROM (SELECT *, ({_year("month", "year_digit", "last")})::INT AS expiry_year FROM outright_p)),
legs AS (SELECT * EXCLUDE (last), 'CL' || month_code || expiry_year AS contract
    FROM (SELECT *, ({_year("month", "year_digit", "last")})::INT AS expiry_year FROM leg_p))""",
    _family("calendar", V.CALENDAR, f"regexp_extract(symbol, '{V.CALENDAR}', ['a', 'b', 'c', 'd']) AS g"),
    f"""
calendars AS (SELECT *, 'CL' || na || near_year || '-CL' || fa || far_year AS contract FROM (
    SELECT *, ({_far("far_month", "fb", "near_year", "near_month")})::INT AS far_year FROM (
    SELECT *, ({_year("near_month", "nb", "last")})::INT AS near_year FROM (
    SELECT *, g.a AS na, g.b::INT AS nb, g.c AS fa, g.d::INT AS fb, instr('{M}', g.a)::INT AS near_month, instr('{M}', g.c)::INT AS far_month FROM calendar_p))))""",
    _family("crack", V.CRACK, f"regexp_extract(symbol, '{V.CRACK}', ['a', 'b', 'c']) AS g"),
    f"""
cracks AS (SELECT *, 'CL:C1 ' || product || '-CL ' || month_code || expiry_year AS contract FROM (
    SELECT *, ({_year("month", "tok", "last")})::INT AS expiry_year FROM (
    SELECT *, g.a AS product, g.b AS month_code, g.c::INT AS tok, instr('{M}', g.b)::INT AS month FROM crack_p)))""",
    _family("brent", V.BRENT, f"regexp_extract(symbol, '{V.BRENT}', ['a', 'b', 'c', 'd']) AS g"),
    f"""
brent_wti AS (SELECT instrument_id, symbol, date, -open AS open, -low AS high, -high AS low, -close AS close, volume, wti_month, wti_year, brent_month, brent_year,
        'CL' || wa || wti_year || '-BZ' || ba || brent_year AS contract FROM (
    SELECT *, ({_year("wti_month", "wb", "last")})::INT AS wti_year, ({_year("brent_month", "bb", "last")})::INT AS brent_year FROM (
    SELECT *, g.a AS wa, g.b::INT AS wb, g.c AS ba, g.d::INT AS bb, instr('{M}', g.a)::INT AS wti_month, instr('{M}', g.c)::INT AS brent_month FROM brent_p)))""",
    *[_spread(n, g) for n, g in V.TENORS.items()],
    """
flies AS (SELECT a.date, a.contract AS front_contract, a.close AS front_close, a.month, a.expiry_year AS front_year, b.contract AS mid_contract, b.close AS mid_close,
        c.contract AS back_contract, c.close AS back_close, a.close - 2 * b.close + c.close AS close,
        a.contract || '-' || b.contract || '-' || c.contract AS contract, 'fly' AS structure, 3 AS n_legs
    FROM legs a JOIN legs b ON b.date = a.date AND b.month = a.month AND b.expiry_year = a.expiry_year + 1
        JOIN legs c ON c.date = a.date AND c.month = a.month AND c.expiry_year = a.expiry_year + 2 WHERE a.month_code IN ('M', 'Z')
    QUALIFY a.date >= max(a.date) OVER (PARTITION BY a.contract || '-' || b.contract || '-' || c.contract) - INTERVAL 12 MONTH)""",
    f"""
dim AS (SELECT * FROM ({_values(_dim)}) t(structure, label, level, n_legs, span_months, near_month, near_offset, legs)),
dim_legs AS (SELECT * FROM ({_values(_leg_rows)}) t(structure, leg_no, month_code, year_offset, coef)),
daily AS (SELECT date, contract, month_code, expiry_year, avg(close) AS close, avg(volume) AS volume FROM outrights GROUP BY ALL),
slegs AS (SELECT structure, (expiry_year - year_offset)::INT AS vintage, leg_no::INT AS leg_no, contract, date, coef::DOUBLE AS coef, close, volume
    FROM daily JOIN dim_legs USING (month_code)),
years AS (SELECT structure, vintage FROM slegs JOIN dim USING (structure) GROUP BY structure, vintage, n_legs HAVING count(DISTINCT leg_no) = n_legs),
sdays AS (SELECT structure, vintage, date, sum(coef * close) AS close, min(volume) AS volume FROM slegs JOIN dim USING (structure)
    GROUP BY structure, vintage, date, n_legs HAVING count(*) = n_legs),
series AS (SELECT * FROM sdays),
stack AS (SELECT structure, vintage, date, dayofyear(date)::INT AS day_of_year,
        (make_date((pm // 12)::INT, (pm % 12 + 1)::INT, 20) - date)::INT AS days_to_expiry, close
    FROM (SELECT s.*, (vintage + near_offset) * 12 + near_month - 2 AS pm FROM series s JOIN dim USING (structure))),
cap AS (SELECT * FROM stack WHERE days_to_expiry BETWEEN 0 AND {V.MAX_DTE}),
vlast AS (SELECT structure, vintage, max(date) AS last, arg_max(days_to_expiry, date) AS dte FROM stack GROUP BY ALL),
active AS (SELECT structure, vintage FROM vlast QUALIFY row_number() OVER (PARTITION BY structure ORDER BY last DESC, dte, vintage) = 1),
panel AS (SELECT structure, vintage, date::TIMESTAMP AS date, close FROM series UNION ALL
    SELECT event_type, 0, date_trunc('hour', ts)::TIMESTAMP, arg_max(value, (ts, event_id)) - 35 FROM events GROUP BY event_type, date_trunc('hour', ts)),
pts AS MATERIALIZED (SELECT *, row_number() OVER ({_SER}) AS i, lag(close) OVER ({_SER}) AS prev FROM panel),
scan AS (SELECT structure, vintage, i, date, close AS e12, close AS e20, close AS e26, close AS e50, close AS w14, 0.0::DOUBLE AS sig, NULL::DOUBLE AS a10, NULL::DOUBLE AS a14,
        NULL::DOUBLE AS u14, NULL::DOUBLE AS d14, NULL::DOUBLE AS adx, NULL::DOUBLE AS fu, NULL::DOUBLE AS fl, 1 AS way FROM pts WHERE i = 1
    UNION ALL
    SELECT p.structure, p.vintage, p.i, p.date, {_ew("(2.0/13)", "p.close", "s.e12")}, {_ew("(2.0/21)", "p.close", "s.e20")}, {_ew("(2.0/27)", "p.close", "s.e26")},
        {_ew("(2.0/51)", "p.close", "s.e50")}, {_ew("(1.0/14)", "p.close", "s.w14")}, 0.2 * {_MACD} + 0.8 * s.sig, {_A10}, {_A14}, {_U14}, {_D14},
        CASE WHEN s.adx IS NULL THEN {_DX} ELSE (1.0/14) * {_DX} + (1 - 1.0/14) * s.adx END, {_FU}, {_FL},
        CASE WHEN s.way = 1 THEN CASE WHEN p.close < {_FL} THEN -1 ELSE 1 END ELSE CASE WHEN p.close > {_FU} THEN 1 ELSE -1 END END
    FROM scan s JOIN pts p ON p.structure = s.structure AND p.vintage = s.vintage AND p.i = s.i + 1),
sm AS MATERIALIZED (SELECT s.*, p.close, 100 * u14 / nullif(a14, 0) AS plus_di, 100 * d14 / nullif(a14, 0) AS minus_di, e12 - e26 AS macd, e12 - e26 - sig AS hist,
        CASE WHEN d14 = 0 THEN 100 ELSE 100 - 100 / (1 + u14 / nullif(d14, 0)) END AS rsi, CASE WHEN i > 1 THEN CASE way WHEN 1 THEN fl ELSE fu END END AS st
    FROM scan s JOIN pts p USING (structure, vintage, i)),
roll AS (SELECT *, {_full("avg", 20)} AS mid, {_full("stddev_pop", 20)} AS sd, {_full("avg", 200)} AS sma200, {_full("avg", 60)} AS m60, {_full("stddev_pop", 60)} AS s60 FROM panel),
wide AS (SELECT s.*, r.mid, r.sd, r.sma200, m60, s60, {_full("avg", 20, "rsi")} + 2 * ({_full("stddev_pop", 20, "rsi")}) AS rsi_upper,
        {_full("avg", 20, "rsi")} - 2 * ({_full("stddev_pop", 20, "rsi")}) AS rsi_lower FROM sm s JOIN roll r USING (structure, vintage, date)),
piv AS (SELECT structure, vintage, date, close, n = 11 AND close = lo AS pivot_low, n = 11 AND close = hi AS pivot_high FROM (SELECT *,
        count(*) OVER w AS n, min(close) OVER w AS lo, max(close) OVER w AS hi FROM panel WINDOW w AS ({_SER} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))),
lows AS (SELECT structure, vintage, arg_max(p.close, p.date, 2) AS c, arg_max(s.macd, p.date, 2) AS m FROM piv p JOIN sm s USING (structure, vintage, date) WHERE pivot_low GROUP BY ALL),
highs AS (SELECT structure, vintage, arg_max(p.close, p.date, 2) AS c, arg_max(s.macd, p.date, 2) AS m FROM piv p JOIN sm s USING (structure, vintage, date) WHERE pivot_high GROUP BY ALL),
counts AS (SELECT structure, vintage, count(*)::INT AS n FROM panel GROUP BY ALL),
div AS (SELECT structure, vintage, CASE WHEN l.c[1] < l.c[2] AND l.m[1] > l.m[2] THEN 1 WHEN h.c[1] > h.c[2] AND h.m[1] < h.m[2] THEN -1 ELSE 0 END AS divergence
    FROM counts LEFT JOIN lows l USING (structure, vintage) LEFT JOIN highs h USING (structure, vintage)),
fin AS (SELECT w.*, n, divergence, (w.close - (mid - 2 * sd)) / nullif((mid + 2 * sd) - (mid - 2 * sd), 0) AS pctb, (w.close - m60) / nullif(s60, 0) AS z60
    FROM wide w JOIN counts USING (structure, vintage) JOIN div USING (structure, vintage) QUALIFY row_number() OVER (PARTITION BY structure, vintage ORDER BY w.date DESC) = 1),
votes AS (
    SELECT structure, vintage, n, 'MA ribbon' AS name, CASE WHEN sma200 IS NULL THEN sign(e20 - e50) WHEN e20 > e50 AND e50 > sma200 THEN 1
        WHEN e20 < e50 AND e50 < sma200 THEN -1 ELSE 0 END AS bias, NULL::DOUBLE AS value, CASE WHEN sma200 IS NULL THEN 'fast/mid only'
        WHEN e20 > e50 AND e50 > sma200 THEN 'stacked up' WHEN e20 < e50 AND e50 < sma200 THEN 'stacked down' ELSE 'mixed' END AS note FROM fin
    UNION ALL SELECT structure, vintage, n, 'ADX/DMI', CASE WHEN n < 15 OR adx IS NULL OR adx < 25 THEN 0 WHEN plus_di > minus_di THEN 1 ELSE -1 END,
        CASE WHEN n >= 15 THEN adx END, CASE WHEN n < 15 THEN 'insufficient history' WHEN adx IS NULL OR adx < 20 THEN 'range'
        WHEN adx >= 25 THEN printf('ADX %.0f trending', adx) ELSE printf('ADX %.0f', adx) END FROM fin
    UNION ALL SELECT structure, vintage, n, 'Supertrend', CASE WHEN n < 11 THEN 0 ELSE way END, CASE WHEN n >= 11 THEN way END,
        CASE WHEN n < 11 THEN 'insufficient history' WHEN way > 0 THEN 'up-trend' ELSE 'down-trend' END FROM fin
    UNION ALL SELECT structure, vintage, n, 'MACD', CASE WHEN n < 35 THEN 0 WHEN divergence <> 0 THEN divergence ELSE sign(hist) END, CASE WHEN n >= 35 THEN hist END,
        CASE WHEN n < 35 THEN 'insufficient history' WHEN divergence = 1 THEN 'bullish divergence' WHEN divergence = -1 THEN 'bearish divergence'
        ELSE printf('hist %+.3f', hist) END FROM fin
    UNION ALL SELECT structure, vintage, n, 'RSI (adaptive)', CASE WHEN n < 15 OR rsi IS NULL THEN 0 WHEN rsi >= coalesce(rsi_upper, 70) THEN -1
        WHEN rsi <= coalesce(rsi_lower, 30) THEN 1 ELSE 0 END, CASE WHEN n >= 15 THEN rsi END, CASE WHEN n < 15 OR rsi IS NULL THEN 'insufficient history'
        WHEN rsi >= coalesce(rsi_upper, 70) THEN printf('RSI %.0f overbought', rsi) WHEN rsi <= coalesce(rsi_lower, 30) THEN printf('RSI %.0f oversold', rsi)
        ELSE printf('RSI %.0f', rsi) END FROM fin
    UNION ALL SELECT structure, vintage, n, 'Bollinger %B', CASE WHEN n < 20 OR pctb IS NULL THEN 0 WHEN pctb >= 1 THEN -1 WHEN pctb <= 0 THEN 1 ELSE 0 END, pctb,
        CASE WHEN n < 20 OR pctb IS NULL THEN 'insufficient history' WHEN pctb >= 1 THEN 'above upper band' WHEN pctb <= 0 THEN 'below lower band'
        ELSE printf('%%B=%.2f', pctb) END FROM fin
    UNION ALL SELECT structure, vintage, n, 'Z-Score', CASE WHEN z60 >= 2 THEN -1 WHEN z60 <= -2 THEN 1 ELSE 0 END, z60, CASE WHEN z60 IS NULL THEN 'insufficient history'
        WHEN z60 >= 2 THEN printf('+%.1fσ rich', z60) WHEN z60 <= -2 THEN printf('%.1fσ cheap', z60) ELSE printf('%+.1fσ', z60) END FROM fin),
inds AS (SELECT * FROM ({_values(V.INDICATORS)}) t(name, family, category)),
wts AS (SELECT * FROM ({_values([(r, c, w) for r, ws in V.WEIGHTS.items() for c, w in ws.items()])}) t(regime, category, weight)),
reg AS (SELECT structure, vintage, avg(close) AS level_mean, CASE WHEN avg(close) > 0 THEN 'Backwardation' ELSE 'Contango' END AS regime
    FROM (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY structure, vintage ORDER BY date DESC) <= 20) GROUP BY ALL),
parts AS (SELECT structure, vintage, regime, name, category, bias::INT AS bias, weight::DOUBLE AS weight, (weight * bias)::DOUBLE AS contribution
    FROM votes JOIN inds USING (name) JOIN reg USING (structure, vintage) JOIN wts USING (regime, category) WHERE n >= 30),
modes AS (SELECT structure, vintage, regime, CASE WHEN coalesce(level, '') = 'Butterfly' OR regime = 'Contango' THEN 'Mean reversion' ELSE 'Breakout' END AS mode
    FROM reg LEFT JOIN dim USING (structure)),
anchor AS (SELECT structure, vintage, arg_max(days_to_expiry, date) AS anchor, arg_max(close, date) AS current FROM cap JOIN active USING (structure, vintage) GROUP BY ALL),
buckets AS (SELECT * FROM ({_values(V.BUCKETS)}) t(bucket, lo, hi)),
mv AS (SELECT *, lead(close, 10) OVER w - close AS m10, lead(close, 20) OVER w - close AS m20, lead(close, 30) OVER w - close AS m30,
        close - lag(close, 20) OVER w AS trend FROM cap WINDOW w AS ({_SER})),
bias_rows AS (SELECT a.structure, a.vintage, m.vintage AS v, m10, m20, m30 FROM anchor a JOIN mv m ON m.structure = a.structure AND m.vintage <> a.vintage
        AND abs(m.days_to_expiry - a.anchor) <= {V.BUFFER}
    QUALIFY row_number() OVER (PARTITION BY a.structure, m.vintage ORDER BY abs(m.days_to_expiry - a.anchor), m.date) = 1),
bias_h AS (SELECT structure, vintage, h.horizon, count(*) FILTER (mv > 0) AS up, count(*) FILTER (mv < 0) AS down
    FROM anchor CROSS JOIN (VALUES (10), (20), (30)) h(horizon) LEFT JOIN (SELECT structure, vintage, 10 AS horizon, m10 AS mv FROM bias_rows
        UNION ALL SELECT structure, vintage, 20, m20 FROM bias_rows UNION ALL SELECT structure, vintage, 30, m30 FROM bias_rows) USING (structure, vintage, horizon) GROUP BY ALL),
bias_d AS (SELECT *, up + down AS total, CASE WHEN up > down THEN 'Bullish' WHEN down > up THEN 'Bearish' ELSE 'Neutral' END AS direction,
        coalesce(greatest(up, down) / nullif(up + down, 0), 0.0)::DOUBLE AS hit_rate, greatest(up, down) || '/' || (up + down) AS count_label FROM bias_h),
bias AS (SELECT *, CASE WHEN total < 5 OR direction = 'Neutral' THEN 'Mixed' WHEN hit_rate >= 0.75 THEN 'Strong' WHEN hit_rate >= 0.6 THEN 'Medium'
        WHEN hit_rate >= 0.55 THEN 'Weak' ELSE 'Mixed' END AS consistency FROM bias_d),
bt_near AS (SELECT a.structure, a.vintage, a.date, m.m20 FROM mv a JOIN mv m ON m.structure = a.structure AND m.vintage <> a.vintage
        AND m.days_to_expiry BETWEEN a.days_to_expiry - {V.BUFFER} AND a.days_to_expiry + {V.BUFFER} WHERE a.trend <> 0 AND a.m20 IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY a.structure, a.vintage, a.date, m.vintage ORDER BY abs(m.days_to_expiry - a.days_to_expiry), m.date) = 1),
bt_net AS (SELECT structure, vintage, date, sum(sign(m20)) AS net FROM bt_near GROUP BY ALL),
bt AS (SELECT a.structure, CASE WHEN coalesce(net, 0) = 0 THEN 'Mixed' WHEN (net > 0) = (trend > 0) THEN 'Tailwind' ELSE 'Headwind' END AS alignment, m20 * sign(trend) AS cont
    FROM mv a LEFT JOIN bt_net USING (structure, vintage, date) WHERE trend <> 0 AND m20 IS NOT NULL
        AND structure IN (SELECT structure FROM cap GROUP BY structure HAVING count(DISTINCT vintage) > 1)),
backtest AS (SELECT s.structure, k.alignment, count(cont) AS n, avg(cont) AS avg_continuation, avg((cont > 0)::INT) AS hit_rate, median(cont) AS median_return
    FROM (SELECT DISTINCT structure FROM bt) s CROSS JOIN (VALUES ('Tailwind'), ('Headwind'), ('Mixed')) k(alignment) LEFT JOIN bt USING (structure, alignment) GROUP BY ALL),
hist AS (SELECT c.* FROM cap c ANTI JOIN active USING (structure, vintage)),
lags AS (SELECT structure, vintage, close - lag(close, k) OVER (PARTITION BY structure, vintage, k ORDER BY date) AS d, k FROM panel CROSS JOIN (SELECT unnest(range(2, 21)) AS k)),
tau AS (SELECT structure, vintage, k, stddev_pop(d) AS t FROM lags GROUP BY ALL),
hurst AS (SELECT structure, vintage, CASE WHEN max(n) >= 40 AND count(*) FILTER (t > 0) >= 3 THEN regr_slope(ln(t), ln(k)) FILTER (t > 0) END AS hurst
    FROM tau JOIN counts USING (structure, vintage) GROUP BY ALL),
ar AS (SELECT structure, vintage, count(*) AS n, regr_slope(close - prev, prev) AS b, regr_sxx(close - prev, prev) AS sxx, regr_syy(close - prev, prev) AS syy,
        regr_sxy(close - prev, prev) AS sxy, regr_count(close - prev, prev) AS m FROM pts GROUP BY ALL),
hl AS (SELECT structure, vintage, CASE WHEN n >= 20 AND b < 0 THEN -ln(2) / b END AS half_life,
        CASE WHEN n >= 20 AND m > 2 AND sxx > 0 AND syy - b * sxy > 0 THEN b / sqrt((syy - b * sxy) / (m - 2) / sxx) END AS df_tstat FROM ar),
vr AS (SELECT structure, vintage, CASE WHEN count(*) >= 15 THEN var_samp(dk) / nullif(5 * var_samp(d1), 0) END AS variance_ratio
    FROM (SELECT *, close - lag(close) OVER ({_SER}) AS d1, close - lag(close, 5) OVER ({_SER}) AS dk FROM panel) GROUP BY ALL)""",
    f"""
adf_x AS (SELECT structure, vintage, row_number() OVER ({_SER}) - 2 AS r, n, lag(x) OVER ({_SER}) AS l, x - lag(x) OVER ({_SER}) AS d
    FROM (SELECT structure, vintage, date, close - avg(close) OVER s AS x, count(*) OVER s AS n FROM panel SEMI JOIN
          (SELECT structure, vintage FROM panel GROUP BY ALL HAVING count(*) >= 20 AND count(DISTINCT close) >= 3) USING (structure, vintage)
          WINDOW s AS (PARTITION BY structure, vintage))),
adf_s AS MATERIALIZED (SELECT structure, vintage, r, n, l, d, least(n // 2 - 2, ceil(12 * pow(n / 100, 0.25))::BIGINT) AS most FROM adf_x WHERE r >= 0),
adf_v AS (SELECT structure, vintage, r, 1 AS p, 1.0::DOUBLE AS v FROM adf_s WHERE r >= most UNION ALL SELECT structure, vintage, r, 2, l FROM adf_s WHERE r >= most
    UNION ALL SELECT a.structure, a.vintage, a.r, CASE WHEN b.r = a.r THEN a.most + 3 ELSE a.r - b.r + 2 END, b.d
    FROM adf_s a JOIN adf_s b ON b.structure = a.structure AND b.vintage = a.vintage AND b.r BETWEEN a.r - a.most AND a.r WHERE a.r >= a.most),
{_matrix_sql("adf_g", "adf_v")},
{_elimination_sql("adf_e", "adf_g", "len(m) - 1")},
adf_k AS (SELECT e.structure, e.vintage, arg_min(p - 2, (k * (ln(2 * pi()) + ln(m[-1][-1] / k) + 1) + 2 * p, p)) AS lag
    FROM adf_e e JOIN (SELECT structure, vintage, any_value(n - 1 - most) AS k FROM adf_s GROUP BY ALL) USING (structure, vintage)
    WHERE p >= 2 GROUP BY ALL HAVING bool_and(sound) AND min(m[-1][-1] / yy) > 1e-10),
adf_s2 AS MATERIALIZED (SELECT s.*, lag FROM adf_s s JOIN adf_k USING (structure, vintage)),
adf_v2 AS (SELECT structure, vintage, r, 1 AS p, 1.0::DOUBLE AS v FROM adf_s2 WHERE r >= lag UNION ALL SELECT structure, vintage, r, lag + 2, l FROM adf_s2 WHERE r >= lag
    UNION ALL SELECT a.structure, a.vintage, a.r, CASE WHEN b.r = a.r THEN a.lag + 3 ELSE a.r - b.r + 1 END, b.d
    FROM adf_s2 a JOIN adf_s2 b ON b.structure = a.structure AND b.vintage = a.vintage AND b.r BETWEEN a.r - a.lag AND a.r WHERE a.r >= a.lag),
{_matrix_sql("adf_h", "adf_v2")},
{_elimination_sql("adf_f", "adf_h", "len(m) - 2")},
adf_t AS (SELECT structure, vintage, lag::INT AS adf_lag, m[-2][-1] / sqrt(m[-2][-2] * (m[-1][-1] - m[-2][-1] * m[-2][-1] / m[-2][-2]) / (n - 1 - lag - lag - 2)) AS adf_stat
    FROM adf_f JOIN (SELECT structure, vintage, any_value(n) AS n, any_value(lag) AS lag FROM adf_s2 GROUP BY ALL) USING (structure, vintage) WHERE p = len(m) - 2 AND sound),
adf_z AS (SELECT *, {_polynomial_sql("adf_stat", D.SMALL_P, f"adf_stat <= {D.TAU_STAR}", D.LARGE_P)} / sqrt(2) AS z FROM adf_t),
adf AS (SELECT structure, vintage, adf_lag, adf_stat, CASE WHEN adf_stat > {D.TAU_MAX} THEN 1 WHEN adf_stat < {D.TAU_MIN} THEN 0
        ELSE 0.5 * (1 + sign(z) * exp(-z * z) * list_sum(list_transform(range(150), lambda k: pow(abs(z), 2 * k + 1) / gamma(k + 1.5)))) END AS adf_pvalue
    FROM counts LEFT JOIN adf_z USING (structure, vintage))""",
]
PRELUDE = "WITH RECURSIVE " + ",".join(_CTES)


def r(*cols: str) -> str:
    """Columns rounded as the queries round them; "a AS b" renames."""
    out = []
    for c in cols:
        expr, _, name = c.partition(" AS ")
        places = 3 if (name or expr) == "bandwidth" else 6
        out.append(f"round(({expr}) + {NUDGE}, {places}) + 0.0 AS {name or expr}")
    return ", ".join(out)


_ID = "structure, vintage"
_OHLC = "instrument_id, symbol, date, volume, " + r("open", "high", "low", "close")
_FAMILY_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(symbol, '{p}') THEN '{n}'"
    for n, p in (("outright", V.OUTRIGHT), ("calendar", V.CALENDAR), ("crack", V.CRACK), ("brent_wti", V.BRENT), ("micro", "^MCL"), ("butterfly", "^CL:BF"),
                 ("brent", "^BZ|^CL:BZ"), ("strip", "^CL:FS|^CL:SA"), ("user_defined", "^UD:"))
) + " ELSE 'other' END"
_OUT = f"{_OHLC}, month_code, month, year_digit, expiry_year, contract"
_FRAMES = ("outrights", "calendars", "cracks", "brent_wti", "quarterly", "semestral", "yearly", "flies")
_Z20 = f"(close - ({_full('avg', 20)})) / nullif(({_full('stddev_pop', 20)}), 0)"
_Z60 = f"(close - ({_full('avg', 60)})) / nullif(({_full('stddev_pop', 60)}), 0)"
_CONE = "{k}d.structure, d, " + r("avg(close) AS mean", "stddev_pop(close) AS std", "avg(close) - stddev_pop(close) AS lower", "avg(close) + stddev_pop(close) AS upper", "median(close) AS median") + ", count(*) AS n"


def _plus(gap: int) -> str:
    at = f"(expiry_year * 12 + month - 1 + {gap})"
    return f"'CL' || substr('{M}', ({at} % 12 + 1)::INT, 1) || ({at} // 12)"


def _synthetic(name: str) -> str:
    return f"SELECT date, near_contract, near_month, near_year, far_contract, contract, structure, gap_months, n_legs, {r('near_close', 'far_close', 'close')} FROM {name}"


def _vote(name: str) -> str:
    return f"SELECT {_ID}, name, bias::INT AS bias, {r('value')}, note FROM votes WHERE name = '{name}'"


_VALUE = "coalesce(round(100 * sum(contribution) / nullif(sum(weight), 0), 9), 0.0)"


def _reading(v: str) -> str:
    return "CASE " + " ".join(f"WHEN {v} >= {lo} THEN '{t}'" for lo, t in V.READINGS[:-1]) + f" ELSE '{V.READINGS[-1][1]}' END"


def _plan(col: str, fade_up: str, fade_down: str, up: str, down: str, inside: str, breakout: str, none: str) -> str:
    return f"""CASE WHEN mid IS NULL OR n < 20 THEN {none} WHEN mode = 'Mean reversion' THEN CASE WHEN close >= mid + 2 * sd THEN {fade_up} WHEN close <= mid - 2 * sd THEN {fade_down}
        ELSE {inside} END WHEN close >= mid + 2 * sd THEN {up} WHEN close <= mid - 2 * sd THEN {down} ELSE {breakout} END AS {col}"""


_FINAL: dict[str, str] = {
    "raw_daily_date": "SELECT date, count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols FROM feed GROUP BY date",
    "loaded_feed": f"SELECT {_OHLC} FROM clean",
    "saved_frames": " UNION ALL ".join(f"SELECT '{n}' AS frame, {y}::INT AS year, count(*) AS n_rows, count(DISTINCT contract) AS n_contracts FROM {n} GROUP BY 2" for n, y in YEARS.items()),
    "parse_outright": "SELECT DISTINCT symbol, symbol[3:3] AS month_code, symbol[4:] AS year_token FROM feed WHERE regexp_matches(symbol, '^CL[FGHJKMNQUVXZ][0-9]{1,2}$')",
    "parse_calendar": f"SELECT DISTINCT symbol, regexp_extract(symbol, '{V.CALENDAR}', 1) AS near_code, regexp_extract(symbol, '{V.CALENDAR}', 2) AS near_token, regexp_extract(symbol, '{V.CALENDAR}', 3) AS far_code, regexp_extract(symbol, '{V.CALENDAR}', 4) AS far_token FROM feed WHERE regexp_matches(symbol, '{V.CALENDAR}')",
    "parse_crack": f"SELECT DISTINCT symbol, regexp_extract(symbol, '{V.CRACK}', 1) AS product, regexp_extract(symbol, '{V.CRACK}', 2) AS month_code, regexp_extract(symbol, '{V.CRACK}', 3) AS year_token FROM feed WHERE symbol LIKE 'CL:C1 %'",
    "parse_brent_wti": f"SELECT DISTINCT symbol, regexp_extract(symbol, '{V.BRENT}', 1) AS wti_code, regexp_extract(symbol, '{V.BRENT}', 2) AS wti_token, regexp_extract(symbol, '{V.BRENT}', 3) AS brent_code, regexp_extract(symbol, '{V.BRENT}', 4) AS brent_token FROM feed WHERE symbol LIKE '%-BZ%'",
    "month_code_map": f"SELECT DISTINCT month_code, month, substr('{M}', month, 1) AS code_again FROM legs",
    "contract_history": f"SELECT contract, date, volume, {r('open', 'high', 'low', 'close')} FROM cracks WHERE product = 'HO' AND month_code = 'Z'",
    "contract_search": "SELECT DISTINCT contract FROM calendars WHERE contains(upper(contract), 'CLZ')",
    "symbol_family_coverage": f"SELECT {_FAMILY_SQL} AS family, count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols FROM feed GROUP BY 1",
    "dedup_clean": f"SELECT {_OHLC} FROM clean",
    "last_12_months": f"SELECT instrument_id, symbol, date, {r('close')} FROM clean QUALIFY date >= max(date) OVER (PARTITION BY instrument_id, symbol) - INTERVAL 12 MONTH",
    "expiry_year": "SELECT DISTINCT instrument_id, symbol, month, year_digit, expiry_year FROM legs",
    "far_leg_year": "SELECT DISTINCT instrument_id, symbol, near_year, near_month, far_year, far_month FROM calendars",
    "outrights": f"SELECT {_OUT} FROM outrights",
    "outright_legs": f"SELECT {_OUT} FROM legs",
    "calendars": f"SELECT {_OHLC}, near_month, near_year, far_month, far_year, contract FROM calendars",
    "cracks": f"SELECT {_OHLC}, product, month, expiry_year, contract FROM cracks",
    "brent_wti": f"SELECT {_OHLC}, wti_month, wti_year, brent_month, brent_year, contract FROM brent_wti",
    "shift_contract": f"SELECT DISTINCT contract, {_plus(3)} AS plus_3, {_plus(6)} AS plus_6, {_plus(12)} AS plus_12, {_plus(-1)} AS \"plus_-1\" FROM legs",
    **{n: _synthetic(n) for n in V.TENORS},
    "flies": f"SELECT date, front_contract, month, front_year, mid_contract, back_contract, contract, structure, n_legs, {r('front_close', 'mid_close', 'back_close', 'close')} FROM flies",
    "structure_legs": f"SELECT {_ID}, leg_no, contract, date, {r('coef', 'close', 'volume')} FROM slegs",
    "nearest_vintage_point": f"SELECT {_ID}, d::INT AS d, abs(days_to_expiry - d)::INT AS dist, date, {r('m20 AS move_20')} FROM (SELECT *, unnest(range(days_to_expiry - {V.BUFFER}, days_to_expiry + {V.BUFFER} + 1)) AS d FROM mv) QUALIFY row_number() OVER (PARTITION BY {_ID}, d ORDER BY abs(days_to_expiry - d), date) = 1",
    "price_matrix": f"SELECT date, contract, {r('avg(close) AS close')} FROM outrights GROUP BY date, contract HAVING avg(close) IS NOT NULL",
    "available_years": f"SELECT {_ID} FROM years",
    "structure_series": f"SELECT {_ID}, date, {r('close', 'volume')} FROM series",
    "near_leg_expiry": f"SELECT {_ID}, make_date((((vintage + near_offset) * 12 + near_month - 2) // 12)::INT, (((vintage + near_offset) * 12 + near_month - 2) % 12 + 1)::INT, 20) AS expiry FROM years JOIN dim USING (structure)",
    "seasonal_stack": f"SELECT {_ID}, date, day_of_year, days_to_expiry, {r('close')} FROM stack",
    "current_vintage": f"SELECT {_ID} FROM active",
    "frame_summary": " UNION ALL ".join(f"SELECT '{n}' AS frame, count(*) AS n_rows, count(DISTINCT contract) AS n_contracts FROM {n}" for n in _FRAMES),
    "dataset_summary": "SELECT count(*) AS families, sum(n)::BIGINT AS contracts, min(a) AS first_date, max(b) AS last_date FROM (" + " UNION ALL ".join(f"SELECT count(DISTINCT contract) AS n, min(date) AS a, max(date) AS b FROM {n}" for n in _FRAMES) + ")",
    "contract_stats": f"SELECT contract, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, {r('arg_max(close, date) AS last_close', 'min(close) AS min_close', 'max(close) AS max_close', 'avg(close) AS mean_close')} FROM outrights GROUP BY contract",
    "structure_dim": "SELECT d.structure, label, level, n_legs, span_months, legs, coalesce(n, 0) AS n_leg_days FROM dim d LEFT JOIN (SELECT structure, count(*) AS n FROM slegs GROUP BY 1) USING (structure)",
    "sma": f"SELECT {_ID}, date, {r(_full('avg', 20) + ' AS sma20', _full('avg', 200) + ' AS sma200')} FROM panel",
    "ema": f"SELECT {_ID}, date, {r('e20 AS ema20', 'e50 AS ema50')} FROM sm",
    "wilder": f"SELECT {_ID}, date, {r('w14 AS wilder')} FROM sm",
    "ma_ribbon": f"SELECT {_ID}, date, {r('e20 AS ema20', 'e50 AS ema50', 'sma200')} FROM wide",
    "true_range": f"SELECT {_ID}, date, {r('abs(close - prev) AS tr')} FROM pts",
    "atr": f"SELECT {_ID}, date, {r('a14 AS atr')} FROM sm",
    "bollinger": f"SELECT {_ID}, date, {r('mid', 'mid + 2 * sd AS upper', 'mid - 2 * sd AS lower', '(close - (mid - 2 * sd)) / nullif((mid + 2 * sd) - (mid - 2 * sd), 0) AS pctb', '((mid + 2 * sd) - (mid - 2 * sd)) / nullif(mid, 0) AS bandwidth')} FROM roll",
    "bollinger_layers": f"SELECT {_ID}, date, {r('mid', *[f'mid {s} {k} * sd AS {p}{k}' for k in (1, 2, 3) for p, s in (('u', '+'), ('l', '-'))], '(close - (mid - 2 * sd)) / nullif((mid + 2 * sd) - (mid - 2 * sd), 0) AS pctb', 'nullif(2 * sd, 0) / nullif(mid, 0) AS bandwidth')} FROM roll",
    "zscore": f"SELECT {_ID}, date, {r(_Z60 + ' AS z60')} FROM panel",
    "zscore_dual": f"SELECT {_ID}, date, {r(_Z20 + ' AS z20', _Z60 + ' AS z60')} FROM panel",
    "dmi_adx": f"SELECT {_ID}, date, {r('plus_di', 'minus_di', 'adx')} FROM sm",
    "supertrend": f"SELECT {_ID}, date, way::INT AS direction, {r('st AS supertrend')} FROM sm",
    "rsi": f"SELECT {_ID}, date, {r('rsi')} FROM sm",
    "adaptive_rsi": f"SELECT {_ID}, date, {r('rsi', 'rsi_upper', 'rsi_lower')} FROM wide",
    "macd": f"SELECT {_ID}, date, {r('macd', 'sig AS macd_signal', 'hist')} FROM sm",
    "pivots": f"SELECT {_ID}, date, pivot_low, pivot_high FROM piv",
    "trend_sign": f"SELECT {_ID}, date, coalesce(sign(close - lag(close, 20) OVER ({_SER})), 0)::INT AS trend_sign FROM panel",
    "macd_divergence": f"SELECT {_ID}, divergence FROM div",
    **{f"vote_{k}": _vote(n) for k, (n, *_) in zip(("ma", "adx", "supertrend", "macd", "rsi", "bollinger", "zscore"), V.INDICATORS, strict=True)},
    "all_signals": f"SELECT {_ID}, name, bias::INT AS bias, {r('value')}, note FROM votes WHERE n >= 5",
    "signal_panel": f"SELECT {_ID}, family, sign(sum(bias))::INT AS bias, {r('CASE WHEN sum(bias) = 0 THEN 0 ELSE count(*) FILTER (sign(bias) = b) / count(*) FILTER (bias <> 0) END AS conviction')} FROM (SELECT *, sign(sum(bias) OVER (PARTITION BY {_ID}, family)) AS b FROM votes JOIN inds USING (name) WHERE n >= 5) GROUP BY ALL",
    "regime_weights": f"SELECT regime, name, category, count(*) AS n_series, {r('weight', 'sum(contribution) AS contribution')} FROM parts GROUP BY regime, name, category, weight",
    "composite_score": f"SELECT {_ID}, regime, round({_VALUE}, 1) + 0.0 AS score, {_reading(_VALUE)} AS reading FROM parts GROUP BY ALL",
    "score_reading": f"SELECT reading, count(*) AS n_series, {r('min(score) AS least', 'max(score) AS greatest')} FROM (SELECT {_ID}, regime, round({_VALUE}, 1) + 0.0 AS score, {_reading(_VALUE)} AS reading FROM parts GROUP BY ALL) GROUP BY reading",
    "vote_breakdown": f"SELECT {_ID}, regime, name, category, bias, {r('weight', 'contribution')} FROM parts",
    "regime": f"SELECT {_ID}, {r('level_mean')}, regime FROM reg",
    "maturity_slices": f"SELECT {_ID}, bucket, date, days_to_expiry, {r('close')} FROM stack JOIN buckets ON days_to_expiry BETWEEN lo AND hi",
    "strategy_mode": f"SELECT {_ID}, regime, mode FROM modes",
    "risk_metrics": f"SELECT {_ID}, {r('CASE WHEN n >= 20 THEN f.pctb END AS pctb', 'CASE WHEN n >= 20 THEN nullif(2 * sd, 0) / nullif(mid, 0) END AS bandwidth', 'CASE WHEN n >= 20 THEN f.a14 END AS atr', 'CASE WHEN n >= 20 THEN (SELECT avg((s.a14 <= f.a14)::INT) * 100 FROM sm s WHERE s.structure = f.structure AND s.vintage = f.vintage AND s.a14 IS NOT NULL) END AS atr_percentile')} FROM fin f",
    "trade_levels": f"SELECT {_ID}, mode, side, note, {r('entry', 'take_profit', 'stop_loss', 'abs(take_profit - entry) / nullif(abs(entry - stop_loss), 0) AS risk_reward')} FROM (SELECT f.structure, f.vintage, mode, "
    + ", ".join(
        _plan(*a)
        for a in (
            ("side", "'Short'", "'Long'", "'Long'", "'Short'", "'None'", "'None'", "'None'"),
            ("note", "'fade upper band to mean'", "'fade lower band to mean'", "'upside breakout, trail with ATR'", "'downside breakout, trail with ATR'", "'inside bands — no mean-reversion setup'", "'inside bands — no breakout'", "'insufficient history'"),
            ("entry", "close", "close", "close", "close", "NULL", "NULL", "NULL"),
            ("take_profit", "mid", "mid", "mid + 3 * sd", "mid - 3 * sd", "NULL", "NULL", "NULL"),
            ("stop_loss", "mid + 3 * sd", "mid - 3 * sd", "mid + 2 * sd", "mid - 2 * sd", "NULL", "NULL", "NULL"),
        )
    )
    + " FROM fin f JOIN modes USING (structure, vintage))",
    "cap_window": f"SELECT {_ID}, date, day_of_year, days_to_expiry, {r('close')} FROM cap",
    "seasonal_cone": f"SELECT {_CONE.format(k='')} FROM (SELECT structure, unnest(range(min(days_to_expiry), max(days_to_expiry) + 1))::INT AS d FROM hist GROUP BY structure) d JOIN hist h ON h.structure = d.structure AND h.days_to_expiry BETWEEN d - {V.BUFFER} AND d + {V.BUFFER} GROUP BY ALL",
    "current_percentile": f"SELECT a.structure, a.vintage, {r('avg((h.close <= a.current)::INT) * 100 AS percentile')} FROM anchor a LEFT JOIN cap h ON h.structure = a.structure AND h.vintage <> a.vintage AND abs(h.days_to_expiry - a.anchor) <= {V.BUFFER} GROUP BY ALL",
    "monthly_heatmap": f"SELECT structure, month(date)::INT AS month, vintage, {r('arg_max(close, date) - arg_min(close, date) AS move')} FROM cap GROUP BY ALL",
    "seasonal_bias": f"SELECT {_ID}, horizon, up, down, total, direction, {r('hit_rate')}, count_label, consistency FROM bias WHERE horizon = 20",
    "forward_tendency": f"SELECT {_ID}, horizon, up, down, total, direction, {r('hit_rate')}, count_label, consistency FROM bias",
    "alignment": f"SELECT {_ID}, direction, trend, CASE WHEN direction = 'Neutral' OR trend = 'Flat' THEN 'Mixed' WHEN (direction = 'Bullish') = (trend = 'Up') THEN 'Tailwind' ELSE 'Headwind' END AS alignment FROM (SELECT b.structure, b.vintage, direction, CASE WHEN arg_max(coalesce(trend, 0), date) > 0 THEN 'Up' WHEN arg_max(coalesce(trend, 0), date) < 0 THEN 'Down' ELSE 'Flat' END AS trend FROM bias b JOIN mv USING (structure, vintage) WHERE horizon = 20 GROUP BY ALL)",
    "lifecycle": f"SELECT {_ID}, phase, days_to_expiry, {r('elapsed')}, note FROM (SELECT structure, vintage, anchor AS days_to_expiry, elapsed, CASE WHEN anchor IS NULL THEN 'Quiet' WHEN anchor <= 15 THEN 'Expiry-risk' WHEN elapsed < 0.25 THEN 'Quiet' WHEN elapsed < 0.5 THEN 'Build-up' WHEN elapsed < 0.78 THEN 'Acceleration' ELSE 'Late' END AS phase FROM (SELECT a.structure, a.vintage, anchor, coalesce(greatest(least((hi - anchor) / greatest(hi - lo, 1), 1), 0), 0) AS elapsed FROM active a LEFT JOIN anchor USING (structure, vintage) LEFT JOIN (SELECT structure, min(days_to_expiry) AS lo, max(days_to_expiry) AS hi FROM cap GROUP BY 1) USING (structure))) JOIN ({_values(list(V.PHASES.items()))}) n(phase, note) USING (phase)",
    "alignment_backtest": f"SELECT structure, alignment, n, {r('avg_continuation', 'hit_rate', 'median_return')} FROM backtest",
    "alignment_edge": f"SELECT structure, {r('edge')}, CASE WHEN edge > 0 THEN 'adds information' ELSE 'visual context only' END AS verdict FROM (SELECT t.structure, t.avg_continuation - h.avg_continuation AS edge FROM backtest t JOIN backtest h ON h.structure = t.structure AND t.alignment = 'Tailwind' AND h.alignment = 'Headwind') WHERE edge IS NOT NULL",
    "cone_by_bucket": f"SELECT {_CONE.format(k='d.bucket, ')} FROM (SELECT bucket, structure, unnest(range(min(days_to_expiry), max(days_to_expiry) + 1))::INT AS d FROM hist JOIN buckets ON days_to_expiry BETWEEN lo AND hi GROUP BY bucket, structure) d JOIN buckets b USING (bucket) JOIN hist h ON h.structure = d.structure AND h.days_to_expiry BETWEEN b.lo AND b.hi AND h.days_to_expiry BETWEEN d - {V.BUFFER} AND d + {V.BUFFER} GROUP BY ALL",
    "seasonal_driver": f"SELECT structure, near_month, driver, n_vintages, n_days FROM dim JOIN ({_values(list(enumerate(V.DRIVERS, 1)))}) t(near_month, driver) USING (near_month) JOIN (SELECT structure, count(DISTINCT vintage) AS n_vintages, count(*) AS n_days FROM stack GROUP BY structure) USING (structure)",
    "hurst": f"SELECT {_ID}, {r('hurst')} FROM hurst",
    "half_life": f"SELECT {_ID}, {r('half_life')} FROM hl",
    "variance_ratio": f"SELECT {_ID}, {r('variance_ratio')} FROM vr",
    "df_tstat": f"SELECT {_ID}, {r('df_tstat')} FROM hl",
    "adf_pvalue": f"SELECT {_ID}, adf_lag, {r('adf_stat', 'adf_pvalue')} FROM adf",
    "regime_diagnostics": f"SELECT {_ID}, {r('hurst', 'half_life', 'variance_ratio', 'adf_pvalue')}, (coalesce((hurst < 0.5)::INT, 0) + coalesce((variance_ratio < 1)::INT, 0) + coalesce((adf_pvalue < 0.1)::INT, 0)) * 2 > (hurst IS NOT NULL)::INT + (variance_ratio IS NOT NULL)::INT + (adf_pvalue IS NOT NULL)::INT AS is_mean_reverting FROM hurst JOIN hl USING (structure, vintage) JOIN vr USING (structure, vintage) JOIN adf USING (structure, vintage)",
    "mean_reversion_verdict": f"SELECT {_ID}, {r('hurst', 'half_life', 'variance_ratio')}, (coalesce((hurst < 0.5)::INT, 0) + coalesce((variance_ratio < 1)::INT, 0)) * 2 > (hurst IS NOT NULL)::INT + (variance_ratio IS NOT NULL)::INT AS is_mean_reverting FROM hurst JOIN hl USING (structure, vintage) JOIN vr USING (structure, vintage)",
}
ORACLES = {name: f"{PRELUDE}\n{sql}" for name, sql in _FINAL.items()}
