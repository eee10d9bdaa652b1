"""DuckDB SQL of the catalogue's queries: common table expressions and what is selected from them."""

from __future__ import annotations

FLAG = "l_returnflag || l_linestatus"
SUPPLIER = "CAST(l_suppkey AS VARCHAR)"


def bars(key: str) -> str:
    by = "ORDER BY l_orderkey, l_linenumber, l_extendedprice"
    return f"""b AS (SELECT {key} AS ticker, l_shipdate AS time, first(l_extendedprice {by}) AS open, max(l_extendedprice) AS high,
  min(l_extendedprice) AS low, last(l_extendedprice {by}) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume FROM lineitem GROUP BY 1, 2)"""


def roll(agg: str, x: str, n: int, least: int | None = None) -> str:
    over = f"OVER (PARTITION BY ticker ORDER BY time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} >= {least or n} THEN {agg}({x}) {over} END"


LIQUID = f"""q AS (SELECT *, close * volume AS trading_value, {roll("avg", "close * volume", 20, 10)} AS avg_value_20d, {roll("avg", "volume", 20, 10)} AS avg_volume_20d FROM b)"""


def screened(close: float, value: float, n_bars: int, continuity: float) -> str:
    return f"""c AS (SELECT max(time) - INTERVAL 90 DAY AS cutoff FROM b),
x AS (SELECT count(DISTINCT time) AS expected FROM b, c WHERE time >= CAST(cutoff AS DATE)),
s AS (SELECT ticker, arg_max(close, time) FILTER (close IS NOT NULL) AS last_close, arg_max(avg_value_20d, time) FILTER (avg_value_20d IS NOT NULL) AS avg_value_20d,
  count(time) AS n_bars, count(*) FILTER (time >= CAST(cutoff AS DATE)) AS recent_active_days FROM q, c GROUP BY ticker),
u AS (SELECT s.*, CASE WHEN NOT coalesce(last_close >= {close}, false) THEN 'penny_stock' WHEN NOT coalesce(avg_value_20d >= {value}, false) THEN 'low_liquidity'
  WHEN recent_active_days < floor(expected * {continuity}) THEN 'low_trading_continuity' WHEN n_bars < {n_bars} THEN 'insufficient_history' ELSE 'passed' END AS rejection_reason FROM s, x)"""


MEANS = f"""m AS (SELECT *, {roll("avg", "close", 20)} AS MA_20, {roll("avg", "close", 50)} AS MA_50, {roll("avg", "close", 200)} AS MA_200,
  {roll("stddev_pop", "close", 20)} AS dev, {roll("avg", "volume", 20, 10)} AS vol20, {roll("avg", "close * volume", 20, 10)} AS avg_value_20d,
  ({roll("max", "high", 9)} + {roll("min", "low", 9)}) / 2 AS TENKAN_9, ({roll("max", "high", 26)} + {roll("min", "low", 26)}) / 2 AS KIJUN_26,
  ({roll("max", "high", 52)} + {roll("min", "low", 52)}) / 2 AS wide FROM b)"""

#: The exponential means bar by bar, as an independent recursion.
STEPS = """n AS (SELECT ticker, time, row_number() OVER w - 1 AS idx, close, high, low, close - lag(close) OVER w AS ch,
  greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, high - lag(high) OVER w AS hu, lag(low) OVER w - low AS ld
  FROM b WINDOW w AS (PARTITION BY ticker ORDER BY time)),
k AS (SELECT *, coalesce(CASE WHEN hu > ld AND hu > 0 THEN hu END, 0.0) AS pdm, coalesce(CASE WHEN ld > hu AND ld > 0 THEN ld END, 0.0) AS mdm, greatest(ch, 0) AS gain, greatest(-ch, 0) AS loss FROM n),
r AS (SELECT ticker, idx, close AS e12, close AS e26, CAST(NULL AS DOUBLE) AS sg, CAST(NULL AS DOUBLE) AS up, CAST(NULL AS DOUBLE) AS dn, CAST(tr AS DOUBLE) AS atr, CAST(pdm AS DOUBLE) AS sp, CAST(mdm AS DOUBLE) AS sm, CAST(0 AS DOUBLE) AS adx
  FROM k WHERE idx = 0
  UNION ALL
  SELECT ticker, idx, e12, e26, CASE WHEN idx = 25 THEN e12 - e26 WHEN idx > 25 THEN 0.8 * sg + 0.2 * (e12 - e26) END, up, dn, atr, sp, sm,
    adx * 13 / 14 + (CASE WHEN sp + sm != 0 AND atr != 0 THEN 100 * abs(sp - sm) / (sp + sm) ELSE 0 END) / 14
  FROM (SELECT k.ticker, k.idx, r.e12 * 11 / 13 + k.close * 2 / 13 AS e12, r.e26 * 25 / 27 + k.close * 2 / 27 AS e26, r.sg,
      CASE WHEN k.idx = 1 THEN k.gain ELSE r.up * 13 / 14 + k.gain / 14 END AS up, CASE WHEN k.idx = 1 THEN k.loss ELSE r.dn * 13 / 14 + k.loss / 14 END AS dn,
      r.atr * 13 / 14 + k.tr / 14 AS atr, r.sp * 13 / 14 + k.pdm / 14 AS sp, r.sm * 13 / 14 + k.mdm / 14 AS sm, r.adx
    FROM r JOIN k ON k.ticker = r.ticker AND k.idx = r.idx + 1)),
e AS (SELECT r.ticker, n.time, r.idx, CASE WHEN r.idx >= 11 THEN e12 END AS EMA_12, CASE WHEN r.idx >= 25 THEN e26 END AS EMA_26,
  CASE WHEN r.idx >= 25 THEN e12 - e26 END AS MACD_12_26_9, CASE WHEN r.idx >= 33 THEN sg END AS MACD_SIGNAL_9, CASE WHEN r.idx >= 33 THEN e12 - e26 - sg END AS MACD_HIST,
  CASE WHEN r.idx >= 14 THEN CASE WHEN up + dn != 0 THEN 100 * up / (up + dn) ELSE 50 END END AS RSI_14, atr AS ATR_14,
  CASE WHEN atr != 0 THEN 100 * sp / atr ELSE 0 END AS DI_PLUS_14, CASE WHEN atr != 0 THEN 100 * sm / atr ELSE 0 END AS DI_MINUS_14, adx AS ADX_14
  FROM r JOIN n ON n.ticker = r.ticker AND n.idx = r.idx)"""

SWINGS = """sw AS (SELECT *, coalesce(high > lag(high) OVER w AND high > lead(high) OVER w, false) AS SWING_HIGH, coalesce(low < lag(low) OVER w AND low < lead(low) OVER w, false) AS SWING_LOW
  FROM b WINDOW w AS (PARTITION BY ticker ORDER BY time))"""

STRUCTURE = """t1 AS (SELECT *, row_number() OVER w AS i, lag(CASE WHEN SWING_HIGH THEN high END) OVER w AS sh, lag(CASE WHEN SWING_LOW THEN low END) OVER w AS sl FROM sw WINDOW w AS (PARTITION BY ticker ORDER BY time)),
t2 AS (SELECT *, last_value(sh IGNORE NULLS) OVER a AS lh, last_value(sl IGNORE NULLS) OVER a AS ll, last_value(sh IGNORE NULLS) OVER p AS wh, last_value(sl IGNORE NULLS) OVER p AS wl,
  last_value(CASE WHEN sh IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ah, last_value(CASE WHEN sl IS NOT NULL THEN i END IGNORE NULLS) OVER a AS al
  FROM t1 WINDOW a AS (PARTITION BY ticker ORDER BY time ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY ticker ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t3 AS (SELECT *, last_value(CASE WHEN sh IS NOT NULL THEN wh END IGNORE NULLS) OVER a AS ph, last_value(CASE WHEN sl IS NOT NULL THEN wl END IGNORE NULLS) OVER a AS pl
  FROM t2 WINDOW a AS (PARTITION BY ticker ORDER BY time ROWS UNBOUNDED PRECEDING)),
t4 AS (SELECT *, lag(ll) OVER w AS ll0, lag(pl) OVER w AS pl0, coalesce(high > lh, false) AS hith, coalesce(low < ll, false) AS hitl FROM t3 WINDOW w AS (PARTITION BY ticker ORDER BY time)),
t5 AS (SELECT *, coalesce(CASE WHEN sl IS NOT NULL THEN CASE WHEN lh > ph AND ll > pl THEN 1 WHEN lh < ph AND ll < pl THEN -1 END END,
  CASE WHEN sh IS NOT NULL THEN CASE WHEN lh > ph AND ll0 > pl0 THEN 1 WHEN lh < ph AND ll0 < pl0 THEN -1 END END) AS turn FROM t4),
t6 AS (SELECT *, coalesce(last_value(turn IGNORE NULLS) OVER a, 0) AS trend,
  hith AND coalesce(last_value(CASE WHEN hith THEN i END IGNORE NULLS) OVER p < ah, true) AS bh, hitl AND coalesce(last_value(CASE WHEN hitl THEN i END IGNORE NULLS) OVER p < al, true) AS bl
  FROM t5 WINDOW a AS (PARTITION BY ticker ORDER BY time ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY ticker ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
st AS (SELECT ticker, time, bh AND trend >= 0 AS BOS_BULL, bh AND trend < 0 AS CHOCH_BULL, bl AND trend <= 0 AS BOS_BEAR, bl AND trend > 0 AS CHOCH_BEAR FROM t6)"""

BLOCKS = """ob AS (SELECT ticker, time, coalesce(close < open AND lead(close, 1) OVER w > lead(open, 1) OVER w AND lead(close, 2) OVER w > lead(open, 2) OVER w AND lead(close, 3) OVER w > lead(open, 3) OVER w, false) AS OB_BULL,
  coalesce(close > open AND lead(close, 1) OVER w < lead(open, 1) OVER w AND lead(close, 2) OVER w < lead(open, 2) OVER w AND lead(close, 3) OVER w < lead(open, 3) OVER w, false) AS OB_BEAR, high, low FROM b WINDOW w AS (PARTITION BY ticker ORDER BY time))"""

def signals(smc_rsi: float = 40, cloud_adx: float = 25, golden_adx: float = 20, block_rsi: float = 45) -> str:
    return f"""f AS (SELECT m.*, e.* EXCLUDE (ticker, time), st.* EXCLUDE (ticker, time), OB_BULL, OB_BEAR, CASE WHEN OB_BULL OR OB_BEAR THEN ob.low END AS OB_LOW,
    lag((TENKAN_9 + KIJUN_26) / 2, 26) OVER w AS SENKOU_A, lag(wide, 26) OVER w AS SENKOU_B
  FROM m JOIN e USING (ticker, time) JOIN st USING (ticker, time) JOIN ob USING (ticker, time) WINDOW w AS (PARTITION BY m.ticker ORDER BY m.time)),
g AS (SELECT *, lag(MACD_HIST) OVER w AS h0, lag(MA_50) OVER w AS m50, lag(MA_200) OVER w AS m200, lag(OB_LOW) OVER w AS low0 FROM f WINDOW w AS (PARTITION BY ticker ORDER BY time)),
sg AS (SELECT *, coalesce(CHOCH_BULL AND (OB_BULL OR coalesce(close <= MA_20 - 2 * dev, false)) AND RSI_14 < {smc_rsi} AND MACD_HIST > h0, false) AS SIG_SMC,
  coalesce(close > SENKOU_A AND close > SENKOU_B AND TENKAN_9 > KIJUN_26 AND BOS_BULL AND ADX_14 > {cloud_adx}, false) AS SIG_ICHIMOKU,
  coalesce(close > MA_20 AND MA_20 > MA_50 AND RSI_14 > 50 AND RSI_14 < 70 AND MACD_12_26_9 > MACD_SIGNAL_9 AND MACD_HIST > 0 AND MACD_HIST > h0 AND BOS_BULL, false) AS SIG_MOMENTUM,
  coalesce(MA_50 > MA_200 AND m50 <= m200 AND close > SENKOU_A AND close > SENKOU_B AND ADX_14 > {golden_adx} AND volume > vol20, false) AS SIG_GOLDEN,
  coalesce((OB_BULL OR coalesce(low <= low0 AND low0 < close, false)) AND RSI_14 < {block_rsi} AND DI_PLUS_14 > DI_MINUS_14 AND close > KIJUN_26, false) AS SIG_OB FROM g)"""

FEATURES = [bars(FLAG), MEANS, STEPS, SWINGS, STRUCTURE, BLOCKS]
ALL = ",\n".join([*FEATURES, signals()])


def loose(*levels: float) -> str:
    return ",\n".join([*FEATURES, signals(*levels)])



REGIME = ",\n".join([bars("'INDEX'"), STEPS]) + f""",
rg AS (SELECT CAST(b.time AS DATE) AS date, b.close AS index_close, {roll("avg", "b.close", 200, 50).replace("ticker", "b.ticker").replace("ORDER BY time", "ORDER BY b.time")} AS index_ma200, ADX_14 AS index_adx FROM b JOIN e ON e.ticker = b.ticker AND e.time = b.time),
rr AS (SELECT *, CASE WHEN index_ma200 IS NULL THEN 'UNKNOWN' WHEN index_close <= index_ma200 THEN 'BEAR' WHEN index_adx IS NULL OR index_adx <= 20 THEN 'SIDEWAY' ELSE 'BULL' END AS regime FROM rg)"""

TRADES = """p0 AS (SELECT ticker, time, row_number() OVER w - 1 AS i, lead(open, 1) OVER w AS entry, lead(open, 6) OVER w AS x5, lead(open, 11) OVER w AS x10, lead(open, 21) OVER w AS x20, SIG_SMC, SIG_ICHIMOKU, SIG_MOMENTUM, SIG_GOLDEN, SIG_OB
  FROM sg WINDOW w AS (PARTITION BY ticker ORDER BY time)),
p1 AS (SELECT * FROM (SELECT ticker, time, i, entry, x5, x10, x20, unnest(['SIG_SMC', 'SIG_ICHIMOKU', 'SIG_MOMENTUM', 'SIG_GOLDEN', 'SIG_OB']) AS strategy, unnest([SIG_SMC, SIG_ICHIMOKU, SIG_MOMENTUM, SIG_GOLDEN, SIG_OB]) AS on_ FROM p0) WHERE on_),
p2 AS (SELECT * FROM (SELECT ticker, time, i, entry, strategy, unnest([5, 10, 20]) AS holding_days, unnest([x5, x10, x20]) AS exit_ FROM p1) WHERE entry > 0 AND exit_ > 0),
p3 AS (SELECT a.*, (SELECT min(z.i) FROM p2 z WHERE z.ticker = a.ticker AND z.strategy = a.strategy AND z.holding_days = a.holding_days AND z.i >= a.i + a.holding_days) AS nxt FROM p2 a),
p4 AS (SELECT ticker, strategy, holding_days, min(i) AS i FROM p3 GROUP BY ALL
  UNION ALL SELECT p3.ticker, p3.strategy, p3.holding_days, p3.nxt FROM p4 JOIN p3 USING (ticker, strategy, holding_days, i) WHERE p3.nxt IS NOT NULL),
tr AS (SELECT strategy, holding_days, ticker, CAST(i AS INTEGER) AS idx, time, exit_ / entry - 1 - 0.005 AS ret FROM p4 JOIN p3 USING (ticker, strategy, holding_days, i)),
eq AS (SELECT *, exp(sum(ln(1 + ret)) OVER w) AS equity FROM tr WINDOW w AS (PARTITION BY strategy, holding_days ORDER BY ticker, time ROWS UNBOUNDED PRECEDING)),
dd AS (SELECT *, equity / max(equity) OVER w - 1 AS drawdown FROM eq WINDOW w AS (PARTITION BY strategy, holding_days ORDER BY ticker, time ROWS UNBOUNDED PRECEDING)),
mt AS (SELECT strategy, holding_days, count(*) AS n_trades, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) * 100 AS win_rate, avg(ret) * 100 AS avg_return,
  CASE WHEN abs(sum(least(ret, 0))) = 0 THEN 999.0 ELSE sum(greatest(ret, 0)) / nullif(abs(sum(least(ret, 0))), 0) END AS profit_factor, abs(min(drawdown)) * 100 AS max_drawdown,
  CASE WHEN stddev_samp(ret) = 0 THEN 0.0 ELSE (avg(ret) - 0.045 * holding_days / 252) / nullif(stddev_samp(ret), 0) * sqrt(252.0 / holding_days) END AS sharpe_ratio FROM dd GROUP BY 1, 2 HAVING count(*) >= 5)"""
