"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Written independently of the Spark plans: plain window functions over the
whole symbol, recursive CTEs for exponential averages, ``quantile_cont`` for
percentiles. Doubles are rounded with the same rules as the Spark side.
"""

from __future__ import annotations

from tickforge import schema as S
from tickforge.operators.ewm import smoothing
from tickforge.plans.rounding import sql_round

BAR = ["symbol", "date", "open", "high", "low", "close", "volume"]

FIX = {
    "bars_nation": """bars_nation AS (
  SELECT n.n_name AS symbol, o.o_orderdate AS date,
         arg_min(o.o_totalprice, o.o_orderkey) AS open, max(o.o_totalprice) AS high,
         min(o.o_totalprice) AS low, arg_max(o.o_totalprice, o.o_orderkey) AS close,
         CAST(count(*) AS DOUBLE) AS volume
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  GROUP BY n.n_name, o.o_orderdate)""",
    "bars_priority": """bars_priority AS (
  SELECT o_orderpriority AS symbol, o_orderdate AS date,
         arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close,
         CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY o_orderpriority, o_orderdate)""",
    "bars_event": """bars_event AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS date,
         arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY event_type, date_trunc('hour', ts))""",
    "quotes_dirty": """quotes_dirty AS (
  SELECT o_orderpriority AS symbol, o_orderdate AS date, 2 * o_orderkey AS ingest_seq,
         CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_totalprice END AS open,
         CASE WHEN o_orderkey % 37 = 0 THEN 0.5 * o_totalprice ELSE 1.02 * o_totalprice END AS high,
         CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE 0.98 * o_totalprice END AS low,
         CASE WHEN o_orderkey % 43 = 0 THEN -o_totalprice
              WHEN o_orderkey % 47 = 0 THEN NULL
              WHEN o_orderkey % 101 = 0 THEN 50 * o_totalprice
              ELSE 1.01 * o_totalprice END AS close,
         CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE CAST(o_orderkey % 1000 AS DOUBLE) END AS volume
  FROM orders
  UNION ALL
  SELECT o_orderpriority, o_orderdate, 2 * o_orderkey + 1, o_totalprice, 1.02 * o_totalprice,
         0.98 * o_totalprice, 1.005 * o_totalprice, CAST(o_orderkey % 1000 AS DOUBLE)
  FROM orders WHERE o_orderkey % 13 = 0)""",
    "sectors": """sectors AS (
  SELECT n_name AS symbol, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey)""",
    "symdim": """symdim AS (
  SELECT n_name || ' LTD' AS company_name, r_name AS industry, n_name AS symbol,
         'EQ' AS series, 'IN' || lpad(CAST(n_nationkey AS VARCHAR), 10, '0') AS isin_code
  FROM nation JOIN region ON n_regionkey = r_regionkey)""",
}


def with_(*ctes: str, recursive: bool = False) -> str:
    parts = [FIX.get(c, c) for c in ctes]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


def sel(src: str, dbl=(), other=(), where: str = "", overrides: dict | None = None) -> str:
    cols = list(other) + [sql_round(c if isinstance(c, str) else c[0],
                                    c if isinstance(c, str) else c[1], overrides)
                          for c in dbl]
    return f"SELECT {', '.join(cols)} FROM {src}" + (f" WHERE {where}" if where else "")


def ov(frame: str = "", part: str = "symbol", order: str = "date") -> str:
    return f"OVER (PARTITION BY {part} ORDER BY {order}{(' ' + frame) if frame else ''})"


def rows(n: int) -> str:
    return f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"


def favg(c: str, n: int) -> str:
    return f"CASE WHEN count({c}) {ov(rows(n))} = {n} THEN avg({c}) {ov(rows(n))} END"


def fstd(c: str, n: int) -> str:
    return f"CASE WHEN count({c}) {ov(rows(n))} = {n} THEN stddev_samp({c}) {ov(rows(n))} END"


def div(a: str, b: str) -> str:
    return f"(({a}) / NULLIF(({b}), 0))"


def lag(c: str, n: int = 1) -> str:
    return f"lag({c}, {n}) {ov()}"


def lit(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


ROLLING = (["daily_return", "log_return"]
           + [f"ma_{n}" for n in S.MA_WINDOWS] + [f"ma_{n}_ratio" for n in S.MA_WINDOWS]
           + ["bb_middle", "bb_upper", "bb_lower", "bb_width", "bb_position", "rsi",
              "volatility_20", "volatility_50", "volume_ma_20", "volume_ratio"]
           + [f"momentum_{n}" for n in S.MOMENTUM_PERIODS]
           + [f"roc_{n}" for n in S.MOMENTUM_PERIODS] + ["hl_ratio", "oc_ratio"])
MACD_COLS = ["ema_12", "ema_26", "macd", "macd_signal", "macd_histogram"]


def rolling_ctes(src: str, out: str = "tf") -> str:
    """CTEs r1, r2, <out> adding the rolling indicators to ``src``."""
    l1 = [f"{div('close', lag('close'))} - 1 AS daily_return",
          f"CASE WHEN {div('close', lag('close'))} > 0 THEN ln({div('close', lag('close'))}) END AS log_return"]
    l1 += [f"{favg('close', n)} AS ma_{n}" for n in S.MA_WINDOWS]
    l1 += [f"{fstd('close', 20)} AS _bb_std", f"close - {lag('close')} AS _delta",
           f"{favg('volume', 20)} AS volume_ma_20"]
    for n in S.MOMENTUM_PERIODS:
        l1.append(f"close - {lag('close', n)} AS momentum_{n}")
        l1.append(f"{div('close - ' + lag('close', n), lag('close', n))} * 100 AS roc_{n}")
    up, lo = "(ma_20 + _bb_std * 2)", "(ma_20 - _bb_std * 2)"
    w14 = ov(rows(14))
    l3 = [f"{div('close', f'ma_{n}')} AS ma_{n}_ratio" for n in S.MA_WINDOWS]
    l3 += ["ma_20 AS bb_middle", f"{up} AS bb_upper", f"{lo} AS bb_lower",
           f"{div(up + ' - ' + lo, 'ma_20')} AS bb_width",
           f"{div('close - ' + lo, up + ' - ' + lo)} AS bb_position",
           f"""CASE WHEN count(*) {w14} = 14 AND close IS NOT NULL THEN
                 CASE WHEN avg(_loss) {w14} = 0 THEN CASE WHEN avg(_gain) {w14} > 0 THEN 100.0 END
                      ELSE 100 - 100 / (1 + avg(_gain) {w14} / avg(_loss) {w14}) END END AS rsi""",
           f"{fstd('daily_return', 20)} AS volatility_20",
           f"{fstd('daily_return', 50)} AS volatility_50",
           f"{div('volume', 'volume_ma_20')} AS volume_ratio",
           f"{div('high - low', 'close')} AS hl_ratio",
           f"{div('close - open', 'open')} AS oc_ratio"]
    return f"""r1 AS (SELECT *, {', '.join(l1)} FROM {src}),
r2 AS (SELECT *, coalesce(CASE WHEN _delta > 0 THEN _delta END, 0) AS _gain,
              coalesce(CASE WHEN _delta < 0 THEN -_delta END, 0) AS _loss FROM r1),
{out} AS (SELECT *, {', '.join(l3)} FROM r2)"""


def macd_ctes(src: str, out: str = "mc") -> str:
    """Recursive CTE of ema_12, ema_26 and the signal EMA of their difference."""
    a12, r12 = smoothing(12)
    a26, r26 = smoothing(26)
    a9, r9 = smoothing(9)
    e12 = f"({lit(r12)} * e.ema_12 + {lit(a12)} * s.close)"
    e26 = f"({lit(r26)} * e.ema_26 + {lit(a26)} * s.close)"
    return f"""e_seq AS (SELECT symbol, date, close,
                    row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS rn FROM {src}),
e_rec AS (SELECT symbol, rn, close AS ema_12, close AS ema_26, CAST(0.0 AS DOUBLE) AS macd_signal
          FROM e_seq WHERE rn = 0
          UNION ALL
          SELECT s.symbol, s.rn, {e12}, {e26},
                 {lit(r9)} * e.macd_signal + {lit(a9)} * ({e12} - {e26})
          FROM e_rec e JOIN e_seq s ON s.symbol = e.symbol AND s.rn = e.rn + 1),
{out} AS (SELECT s.symbol, s.date, r.ema_12, r.ema_26, r.ema_12 - r.ema_26 AS macd,
                 r.macd_signal, (r.ema_12 - r.ema_26) - r.macd_signal AS macd_histogram
          FROM e_seq s JOIN e_rec r ON s.symbol = r.symbol AND s.rn = r.rn)"""


SQL: dict[str, str] = {}


def bars_sql(name: str) -> str:
    return with_(name) + sel(name, BAR[2:], BAR[:2])


# --- 2.1 -----------------------------------------------------------------------
SQL["resample_bars"] = bars_sql("bars_event")
SQL["resample_weekly"] = with_("bars_nation") + """SELECT symbol, date_trunc('week', date) AS date,
  arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close,
  sum(volume) AS volume FROM bars_nation GROUP BY symbol, date_trunc('week', date)"""
SQL["resample_monthly"] = with_("bars_nation", """m AS (SELECT *, (year(date) * 12 + month(date) - 1) AS mi FROM bars_nation)""") + \
    """SELECT symbol, make_timestamp(CAST((mi - mi % 3) // 12 AS BIGINT), CAST((mi - mi % 3) % 12 + 1 AS BIGINT), 1, 0, 0, 0) AS date,
  arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close,
  sum(volume) AS volume FROM m GROUP BY symbol, mi - mi % 3"""
SQL["scan_bars_csv"] = bars_sql("bars_nation")
SQL["scan_csv_validated"] = with_("bars_nation", """seen AS (
  SELECT * REPLACE (CASE WHEN day(date) = 13 THEN NULL ELSE volume END AS volume) FROM bars_nation)""") + sel(
    "seen", BAR[2:], BAR[:2])
SQL["validate_partition"] = with_("quotes_dirty", """landed AS (
  SELECT * FROM quotes_dirty
  UNION ALL SELECT * FROM quotes_dirty WHERE ingest_seq % 7 = 0
  UNION ALL SELECT * REPLACE (CASE WHEN ingest_seq % 2 = 0 THEN symbol END AS symbol,
                              CASE WHEN ingest_seq % 3 = 0 THEN date END AS date)
  FROM quotes_dirty WHERE ingest_seq % 11 = 0)""", """judged AS (
  SELECT *, CASE WHEN symbol IS NULL THEN 'null_symbol' WHEN date IS NULL THEN 'null_date'
                 WHEN coalesce(high < low OR high < open OR high < close OR low > open OR low > close, false)
                 THEN 'price_relation' WHEN volume < 0 THEN 'negative_volume' END AS reason
  FROM landed)""", """ranked AS (
  SELECT symbol, reason, row_number() OVER (PARTITION BY symbol, date, reason ORDER BY ingest_seq DESC) AS k
  FROM judged)""") + """SELECT symbol, coalesce(reason, CASE WHEN k = 1 THEN 'kept' ELSE 'duplicate' END) AS reject_reason,
       count(*) AS n FROM ranked GROUP BY ALL"""
SQL["scan_single_symbol"] = with_("bars_nation") + sel("bars_nation", BAR[2:], BAR[:2],
                                                       "symbol = 'NATION_7'")
SQL["union_symbols"] = with_("bars_nation", "bars_priority") + sel(
    "(SELECT *, NULL AS series FROM bars_nation UNION ALL SELECT *, 'EQ' AS series FROM bars_priority)",
    BAR[2:], BAR[:2] + ["series"])
SQL["list_symbols"] = with_("bars_nation", "bars_priority") + """SELECT symbol, count(*) AS records FROM
  (SELECT symbol FROM bars_nation UNION ALL SELECT symbol FROM bars_priority) GROUP BY symbol"""
SOURCES = with_("bars_nation", "bars_priority", """feed_open AS (
  SELECT o_orderpriority AS symbol, o_orderdate AS date, arg_min(o_totalprice, o_orderkey) AS open,
         max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close,
         CAST(count(*) AS DOUBLE) AS volume
  FROM orders WHERE o_orderstatus = 'O' GROUP BY o_orderpriority, o_orderdate)""", """tagged AS (
  SELECT *, 'feed_open' AS source, 0 AS source_rank FROM feed_open
  UNION ALL SELECT *, 'feed_all', 1 FROM bars_priority
  UNION ALL SELECT *, 'feed_nation', 2 FROM bars_nation)""")
SQL["source_failover"] = SOURCES + sel(
    "tagged t WHERE source_rank = (SELECT min(source_rank) FROM tagged u WHERE u.symbol = t.symbol)",
    BAR[2:], BAR[:2] + ["source"])
SQL["source_health"] = SOURCES + """, st AS (SELECT source, source_rank, count(*) AS records,
  max(close) FILTER (WHERE _last) AS last_price FROM
  (SELECT *, row_number() OVER (PARTITION BY source ORDER BY date DESC, symbol DESC) = 1 AS _last FROM tagged)
  GROUP BY source, source_rank),
w AS (SELECT source, source_rank, records, last_price,
  CASE WHEN records > 0 THEN 'working' ELSE 'failed' END AS status FROM st)
SELECT source, CAST(source_rank AS INTEGER) AS source_rank, records,
  (round(last_price, 6) + 0.0) AS last_price, status,
  CAST(sum(CASE WHEN status = 'working' THEN 1 ELSE 0 END) OVER () AS BIGINT) AS working_sources,
  count(*) OVER () AS total_sources,
  CASE WHEN sum(CASE WHEN status = 'working' THEN 1 ELSE 0 END) OVER () = count(*) OVER () THEN 'All sources working'
       WHEN sum(CASE WHEN status = 'working' THEN 1 ELSE 0 END) OVER () > 0 THEN 'Some sources working'
       ELSE 'No sources working' END AS recommendation FROM w"""
_norm = "CASE WHEN regexp_matches(upper(trim(symbol)), '(\\.NS|\\.BO)$') THEN upper(trim(symbol)) ELSE upper(trim(symbol)) || '.NS' END"
SQL["symbol_normalise"] = with_("bars_nation", "bars_priority") + f"""SELECT symbol, {_norm} AS normalised,
  regexp_replace({_norm}, '(\\.NS|\\.BO)$', '') AS base_symbol
  FROM (SELECT DISTINCT symbol FROM (SELECT symbol FROM bars_nation UNION ALL SELECT symbol FROM bars_priority))"""
_ub = "(SELECT * FROM bars_nation UNION ALL SELECT * FROM bars_priority)"
SQL["known_symbols"] = with_("bars_nation", "bars_priority", "symdim") + sel(
    f"{_ub} b", BAR[2:], BAR[:2], "symbol IN (SELECT symbol FROM symdim)")
SQL["unknown_symbols"] = with_("bars_nation", "bars_priority", "symdim") + sel(
    f"{_ub} b", BAR[2:], BAR[:2], "symbol NOT IN (SELECT symbol FROM symdim)")
SQL["period_slice"] = with_("bars_nation", """l AS (SELECT symbol AS s, max(date) AS last FROM bars_nation GROUP BY symbol)""") + sel(
    "bars_nation JOIN l ON symbol = s", BAR[2:], BAR[:2], "date > last - INTERVAL 12 MONTH")
SQL["period_range"] = with_("bars_nation") + sel(
    "bars_nation", BAR[2:], BAR[:2],
    "date >= TIMESTAMP '1995-01-01' AND date < TIMESTAMP '1996-07-01'")

# --- 2.2 -----------------------------------------------------------------------
SQL["standardise_columns"] = with_("quotes_dirty") + sel(
    "quotes_dirty", [("open", "opening"), ("high", "highest"), ("low", "low_price"), ("close", "last"),
                     ("volume", "vol")], ["symbol AS ticker", "date AS timestamp", "ingest_seq"])
_q7 = ["symbol", "date", "ingest_seq"]
SQL["map_synonyms"] = with_("quotes_dirty") + sel("quotes_dirty", BAR[2:], _q7)
SQL["cast_types"] = SQL["map_synonyms"]
SQL["default_symbol"] = with_("quotes_dirty") + sel("quotes_dirty", BAR[2:],
                                                    ["'UNKNOWN' AS symbol", "date", "ingest_seq"])
SQL["null_report"] = with_("quotes_dirty") + """SELECT symbol, """ + ", ".join(
    f"count(*) FILTER (WHERE {c} IS NULL) AS null_{c}" for c in S.OHLCV) + ", " + " + ".join(
    f"count(*) FILTER (WHERE {c} IS NULL)" for c in S.OHLCV) + " AS null_total FROM quotes_dirty GROUP BY symbol"
_broken = "(high < low OR high < open OR high < close OR low > open OR low > close)"
SQL["filter_price_relationships"] = with_("quotes_dirty") + sel(
    "quotes_dirty", BAR[2:], _q7, f"NOT coalesce({_broken}, false)")
SQL["check_negative_volume"] = with_("quotes_dirty") + sel(
    "(SELECT * REPLACE (volume - 500 AS volume) FROM quotes_dirty)", BAR[2:], _q7, "volume < 0")
_dedup = """dd AS (SELECT * FROM quotes_dirty
  QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY ingest_seq DESC) = 1)"""
SQL["dedup_keep_last"] = with_("quotes_dirty", _dedup) + sel("dd", BAR[2:], _q7)
SQL["dedup_full_row"] = with_("quotes_dirty") + sel(
    "(SELECT DISTINCT symbol, date, open, high, low, close, volume FROM quotes_dirty)", BAR[2:], BAR[:2])
SQL["drop_null_critical"] = with_("quotes_dirty") + sel(
    "quotes_dirty", BAR[2:], _q7, "date IS NOT NULL AND close IS NOT NULL")
SQL["filter_positive_close"] = with_("quotes_dirty") + sel("quotes_dirty", BAR[2:], _q7, "close > 0")
_badpos = "(close <= 0 OR open <= 0 OR high <= 0 OR low <= 0)"
SQL["filter_positive_ohlc"] = with_("quotes_dirty") + sel(
    "quotes_dirty", BAR[2:], _q7, f"NOT coalesce({_badpos}, false)")


def _fill(c: str) -> str:
    return (f"coalesce(last_value({c} IGNORE NULLS) {ov('ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')}, "
            f"first_value({c} IGNORE NULLS) {ov('ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING')}) AS {c}")


_filled = f"""fl AS (SELECT symbol, date, {', '.join(_fill(c) for c in S.PRICE_COLS)}, volume FROM dd)"""
SQL["fill_prices"] = with_("quotes_dirty", _dedup, _filled) + sel("fl", BAR[2:], BAR[:2])
SQL["fill_volume_median"] = with_("quotes_dirty", """md AS (SELECT symbol AS s, quantile_cont(volume, 0.5) AS med
  FROM quotes_dirty GROUP BY symbol)""") + sel(
    "(SELECT * REPLACE (coalesce(volume, med) AS volume) FROM quotes_dirty LEFT JOIN md ON symbol = s)",
    BAR[2:], _q7)
_repair_hi = "greatest(open, high, low, close)"
SQL["repair_ohlc"] = with_("quotes_dirty") + sel(
    "quotes_dirty", ["open", (_repair_hi, "high"),
                     (f"least(open, {_repair_hi}, low, close)", "low"), "close", "volume"], _q7)
_clean = [_dedup, _filled, """fv AS (SELECT fl.* REPLACE (coalesce(volume, med) AS volume) FROM fl
  LEFT JOIN (SELECT symbol AS s, quantile_cont(volume, 0.5) AS med FROM fl GROUP BY symbol) m ON fl.symbol = m.s)""",
          f"""cb AS (SELECT symbol, date, open, {_repair_hi} AS high,
  least(open, {_repair_hi}, low, close) AS low, close, volume FROM fv WHERE NOT coalesce({_badpos}, false))"""]
SQL["clean_bars"] = with_("quotes_dirty", *_clean) + sel("cb", BAR[2:], BAR[:2])
SQL["clean_spark_bars"] = with_("quotes_dirty") + sel(
    "(SELECT DISTINCT symbol, date, open, high, low, close, volume FROM quotes_dirty)",
    BAR[2:], BAR[:2], "date IS NOT NULL AND close IS NOT NULL AND close > 0")
_valid = f"""vr AS (SELECT *, CASE WHEN symbol IS NULL THEN 'null_symbol' WHEN date IS NULL THEN 'null_date'
  WHEN coalesce({_broken}, false) THEN 'price_relation' WHEN volume < 0 THEN 'negative_volume' END AS reject_reason
  FROM quotes_dirty),
vok AS (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY ingest_seq DESC) AS _r
  FROM vr WHERE reject_reason IS NULL)"""
SQL["validate_bars"] = with_("quotes_dirty", _valid) + sel("vok", BAR[2:], _q7, "_r = 1")
SQL["validate_rejects"] = with_("quotes_dirty", _valid) + sel(
    "(SELECT * FROM vr WHERE reject_reason IS NOT NULL UNION ALL "
    "SELECT * EXCLUDE (_r, reject_reason), 'duplicate' FROM vok WHERE _r > 1)",
    BAR[2:], _q7 + ["reject_reason"])


def _fences(src: str) -> str:
    cols = ", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}"
                     for c in S.PRICE_COLS)
    fen = ", ".join(f"q1_{c} - 3 * (q3_{c} - q1_{c}) AS lo_{c}, q3_{c} + 3 * (q3_{c} - q1_{c}) AS hi_{c}"
                    for c in S.PRICE_COLS)
    return f"""fq AS (SELECT symbol AS s, {cols} FROM {src} GROUP BY symbol),
fe AS (SELECT s, {fen} FROM fq)"""


def _clip(c: str) -> str:
    return f"CASE WHEN {c} < lo_{c} THEN lo_{c} WHEN {c} > hi_{c} THEN hi_{c} ELSE {c} END"


_iqr = f"""io AS (SELECT symbol, date, {', '.join(_clip(c) + ' AS ' + c for c in S.PRICE_COLS)}, volume
  FROM cb LEFT JOIN fe ON symbol = s)"""
SQL["outliers_iqr"] = with_("quotes_dirty", *_clean, _fences("cb"), _iqr) + sel("io", BAR[2:], BAR[:2])
_zs = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in S.PRICE_COLS)


def _z(c: str) -> str:
    return (f"CASE WHEN abs(({c} - m_{c}) / NULLIF(s_{c}, 0)) > 3 THEN m_{c} + 3 * s_{c} * sign({c} - m_{c}) "
            f"ELSE {c} END")


SQL["outliers_zscore"] = with_("quotes_dirty", *_clean, f"zs AS (SELECT symbol AS s, {_zs} FROM cb GROUP BY symbol)") + sel(
    "cb LEFT JOIN zs ON symbol = s", [(_z(c), c) for c in S.PRICE_COLS] + ["volume"], BAR[:2])
SQL["outlier_counts"] = with_("quotes_dirty", *_clean, _fences("cb")) + "SELECT symbol, " + ", ".join(
    f"count(*) FILTER (WHERE {c} < lo_{c} OR {c} > hi_{c}) AS outliers_{c}" for c in S.PRICE_COLS) + ", " + " + ".join(
    f"count(*) FILTER (WHERE {c} < lo_{c} OR {c} > hi_{c})" for c in S.PRICE_COLS) + \
    " AS outliers_total FROM cb LEFT JOIN fe ON symbol = s GROUP BY symbol"
_tech_from = lambda src: [rolling_ctes(src, "tf"), macd_ctes(src, "mc")]
_tech_join = "tf JOIN mc ON tf.symbol = mc.symbol AND tf.date = mc.date"
_tech_cols = [f"tf.{c}" if c in BAR else c for c in BAR]
# Same rounding as the Spark side (see registry.FINE_MEANS).
FINE_MEANS = {"ma_5": 1, "ma_10": 1, "ma_20": 2, "ma_50": 2, "ma_200": 2, "bb_middle": 2}
SQL["full_pipeline"] = with_("quotes_dirty", *_clean, _fences("cb"), _iqr, *_tech_from("io"), recursive=True) + sel(
    _tech_join, [(f"tf.{c}", c) for c in BAR[2:]] + ROLLING + MACD_COLS, ["tf.symbol", "tf.date"],
    overrides=FINE_MEANS)

# --- 2.3 -----------------------------------------------------------------------
_feature_groups = {
    "daily_return": ["daily_return"], "log_return": ["log_return"],
    "moving_average": [f"ma_{n}" for n in S.MA_WINDOWS],
    "ma_ratio": [f"ma_{n}_ratio" for n in S.MA_WINDOWS],
    "bollinger": ["bb_middle", "bb_upper", "bb_lower", "bb_width", "bb_position"],
    "rsi": ["rsi"], "volatility_return": ["volatility_20", "volatility_50"],
    "volume_ma_ratio": ["volume_ma_20", "volume_ratio"],
    "momentum": [f"momentum_{n}" for n in S.MOMENTUM_PERIODS],
    "roc": [f"roc_{n}" for n in S.MOMENTUM_PERIODS], "range_ratios": ["hl_ratio", "oc_ratio"]}
for _k, _cols in _feature_groups.items():
    SQL[_k] = with_("bars_nation", rolling_ctes("bars_nation")) + sel("tf", BAR[2:] + _cols, BAR[:2])
SQL["macd"] = with_("bars_nation", macd_ctes("bars_nation"), recursive=True) + sel(
    "bars_nation b JOIN mc ON b.symbol = mc.symbol AND b.date = mc.date",
    [(f"b.{c}", c) for c in BAR[2:]] + MACD_COLS, ["b.symbol", "b.date"])
SQL["ema"] = with_("bars_nation", macd_ctes("bars_nation"), recursive=True) + sel(
    "bars_nation b JOIN mc ON b.symbol = mc.symbol AND b.date = mc.date",
    [(f"b.{c}", c) for c in BAR[2:]] + ["ema_12"], ["b.symbol", "b.date"])
SQL["technical_features"] = with_("bars_nation", *_tech_from("bars_nation"), recursive=True) + sel(
    _tech_join, [(f"tf.{c}", c) for c in BAR[2:]] + ROLLING + MACD_COLS, ["tf.symbol", "tf.date"])

_w = ov()
_mf = [("close", "close"), ("open", "open"), ("high", "high"), ("low", "low"), ("volume", "volume"),
       (f"{div('close', lag('close', 1))} - 1", "return_1d"),
       (f"{div('close', lag('close', 5))} - 1", "return_5d"),
       (f"{div('close', lag('close', 20))} - 1", "return_20d")] + \
    [(favg("close", n), f"ma_{n}") for n in (5, 10, 20, 50)] + \
    [(fstd("close", 5), "volatility_5d"), (fstd("close", 20), "volatility_20d"),
     (favg("volume", 5), "volume_ma_5"), (div("high", "low"), "high_low_ratio"),
     (div("close", "open"), "close_open_ratio")] + \
    [(lag(c, k), f"{c}_lag_{k}") for k in S.MODEL_LAGS for c in ("close", "volume")] + \
    [(f"lead(close, 1) {_w}", "target")]
_mf_cte = f"""m1 AS (SELECT symbol, date, {', '.join(e + ' AS ' + n for e, n in _mf)}, close - {lag('close')} AS _delta
  FROM bars_nation),
m2 AS (SELECT *, coalesce(CASE WHEN _delta > 0 THEN _delta END, 0) AS _gain,
  coalesce(CASE WHEN _delta < 0 THEN -_delta END, 0) AS _loss FROM m1),
mf AS (SELECT *, {div('close', 'ma_5')} AS close_to_ma5, {div('close', 'ma_20')} AS close_to_ma20,
  {div('ma_5', 'ma_20')} AS ma5_to_ma20, {div('volume', 'volume_ma_5')} AS volume_ratio,
  CASE WHEN count(*) {ov(rows(14))} = 14 THEN CASE WHEN avg(_loss) {ov(rows(14))} = 0 THEN
     CASE WHEN avg(_gain) {ov(rows(14))} > 0 THEN 100.0 END
     ELSE 100 - 100 / (1 + avg(_gain) {ov(rows(14))} / avg(_loss) {ov(rows(14))}) END END AS rsi_14 FROM m2)"""
_model_groups = {
    "pct_change_n": ["return_1d", "return_5d", "return_20d"],
    "ma_cross_ratios": ["close_to_ma5", "close_to_ma20", "ma5_to_ma20"],
    "price_volatility": ["volatility_5d", "volatility_20d"],
    "lag_features": [f"{c}_lag_{k}" for k in S.MODEL_LAGS for c in ("close", "volume")],
    "next_close_target": ["close", "target"]}
for _k, _cols in _model_groups.items():
    SQL[_k] = with_("bars_nation", _mf_cte) + sel("mf", _cols, ["symbol", "date"])
from tickforge.operators.features import MODEL_FEATURES  # noqa: E402
SQL["model_features"] = with_("bars_nation", _mf_cte) + sel("mf", MODEL_FEATURES + ["target"],
                                                             ["symbol", "date"])
SQL["min_history_filter"] = with_("bars_nation") + sel(
    "bars_nation", BAR[2:], BAR[:2],
    f"symbol IN (SELECT symbol FROM bars_nation GROUP BY symbol HAVING count(*) >= {S.MIN_HISTORY})")

# --- 2.4 -----------------------------------------------------------------------
SQL["date_range"] = with_("bars_nation") + \
    "SELECT symbol, min(date) AS start_date, max(date) AS end_date FROM bars_nation GROUP BY symbol"
SQL["data_summary"] = with_("quotes_dirty") + sel(
    """(SELECT symbol, count(*) AS total_rows, min(date) AS start_date, max(date) AS end_date,
  '{"date":' || count(*) FILTER (WHERE date IS NULL) || ',"ingest_seq":' || count(*) FILTER (WHERE ingest_seq IS NULL)
  || ',"open":' || count(*) FILTER (WHERE open IS NULL) || ',"high":' || count(*) FILTER (WHERE high IS NULL)
  || ',"low":' || count(*) FILTER (WHERE low IS NULL) || ',"close":' || count(*) FILTER (WHERE close IS NULL)
  || ',"volume":' || count(*) FILTER (WHERE volume IS NULL) || '}' AS missing_values,
  avg(close) AS close_mean, stddev_samp(close) AS close_std, min(close) AS close_min, max(close) AS close_max
  FROM quotes_dirty GROUP BY symbol)""",
    ["close_mean", "close_std", "close_min", "close_max"],
    ["symbol", "total_rows", "start_date", "end_date", "missing_values", "8 AS n_columns"])
SQL["price_stats"] = with_("bars_nation") + sel(
    "(SELECT symbol, avg(close) AS close_mean, stddev_samp(close) AS close_std, min(close) AS close_min, "
    "max(close) AS close_max FROM bars_nation GROUP BY symbol)",
    ["close_mean", "close_std", "close_min", "close_max"], ["symbol"])
_tr = """(SELECT symbol, arg_min(close, date) AS first_close, arg_max(close, date) AS last_close
  FROM bars_nation GROUP BY symbol)"""
SQL["total_return"] = with_("bars_nation") + sel(
    _tr, ["first_close", "last_close",
          (f"{div('last_close - first_close', 'first_close')} * 100", "total_return_pct")], ["symbol"])
_tail = """tl AS (SELECT * FROM bars_nation QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= {n})"""
SQL["recent_return"] = with_("bars_nation", _tail.format(n=20)) + sel(
    "(SELECT symbol, arg_min(close, date) AS f, arg_max(close, date) AS l FROM tl GROUP BY symbol)",
    [(f"{div('l - f', 'f')} * 100", "recent_return_pct")], ["symbol"])
SQL["volatility"] = with_("bars_nation", f"dr AS (SELECT symbol, {div('close', lag('close'))} - 1 AS r FROM bars_nation)") + sel(
    "(SELECT symbol, stddev_samp(r) * 100 AS v FROM dr GROUP BY symbol)", [("v", "volatility_pct")], ["symbol"])
SQL["price_extremes"] = with_("bars_nation") + sel(
    "(SELECT symbol, max(high) AS highest_price, min(low) AS lowest_price, "
    "CAST(trunc(avg(volume)) AS BIGINT) AS average_volume FROM bars_nation GROUP BY symbol)",
    ["highest_price", "lowest_price"], ["symbol", "average_volume"])
SQL["price_range_pct"] = with_("bars_nation") + sel(
    "(SELECT symbol, max(high) AS hp, min(low) AS lp FROM bars_nation GROUP BY symbol)",
    [("hp", "highest_price"), ("lp", "lowest_price"), ("hp - lp", "price_range"),
     (f"{div('hp - lp', 'lp')} * 100", "price_range_pct")], ["symbol"])
SQL["latest_bar"] = with_("bars_nation") + sel(
    "(SELECT * FROM bars_nation QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)",
    BAR[2:], BAR[:2])
SQL["latest_quote"] = with_("bars_nation") + sel(
    f"(SELECT *, {lag('close')} AS prev FROM bars_nation QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)",
    [("close", "current_price"), ("prev", "previous_close"), "open", ("high", "day_high"),
     ("low", "day_low"), "volume"], ["symbol", "date"])
SQL["tail_n"] = with_("bars_nation", _tail.format(n=100)) + sel("tl", BAR[2:], BAR[:2])
_ind = with_("bars_nation", rolling_ctes("bars_nation"))
_trend = lambda lvl: f"CASE WHEN {lvl} IS NULL THEN 'N/A' WHEN close > {lvl} THEN 'Above' ELSE 'Below' END"
SQL["trend_signals"] = _ind + sel(
    "(SELECT * FROM tf QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)",
    ["ma_20", "ma_50"], ["symbol", f"{_trend('ma_20')} AS current_vs_ma20", f"{_trend('ma_50')} AS current_vs_ma50"])
_sig = lambda c, hi, lo, a, b, m: f"CASE WHEN {c} > {hi} THEN '{a}' WHEN {c} < {lo} THEN '{b}' WHEN {c} IS NOT NULL THEN '{m}' END"
SQL["rsi_signal"] = _ind + sel("tf", ["rsi"], ["symbol", "date",
                                               _sig("rsi", 70, 30, "Overbought", "Oversold", "Neutral") + " AS rsi_signal"])
SQL["bollinger_signal"] = _ind + sel("tf", ["bb_position"], ["symbol", "date", _sig(
    "bb_position", 0.8, 0.2, "Near Upper Band", "Near Lower Band", "Mid-Range") + " AS bollinger_signal"])


def _analyze(pre: bool) -> str:
    if pre:
        src_ctes = ["bars_nation", """quotes_dirty AS (SELECT symbol, date, open, high, low, close, volume FROM bars_nation)""",
                    """dd AS (SELECT * FROM quotes_dirty QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY open DESC) = 1)""",
                    *_clean[1:], _fences("cb"), _iqr, *_tech_from("io"),
                    f"fx AS (SELECT tf.*, {', '.join(MACD_COLS)} FROM {_tech_join})"]
    else:
        src_ctes = ["bars_nation", rolling_ctes("bars_nation", "fx")]
    last = """ls AS (SELECT * FROM fx QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)"""
    agg = """ag AS (SELECT symbol, arg_min(close, date) AS first_close, max(date) AS latest_date, min(date) AS start_date,
  count(*) AS total_records, stddev_samp(daily_return) * 100 AS vol, max(high) AS highest_price, min(low) AS lowest_price,
  CAST(trunc(avg(volume)) AS BIGINT) AS average_volume FROM fx GROUP BY symbol)"""
    rec = """rc AS (SELECT symbol AS rs, arg_min(close, date) AS f, arg_max(close, date) AS l FROM
  (SELECT * FROM fx QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 20) GROUP BY symbol)"""
    other = ["ag.symbol", "ag.latest_date", "ag.total_records", "ag.start_date", "ag.latest_date AS end_date",
             "ag.average_volume", f"{_trend('ls.ma_20').replace('close', 'ls.close')} AS current_vs_ma20",
             f"{_trend('ls.ma_50').replace('close', 'ls.close')} AS current_vs_ma50"]
    dbl = [("ls.close", "latest_price"),
           (f"round({div('ls.close - first_close', 'first_close')} * 100, 2)", "total_return_percent"),
           (f"round({div('l - f', 'f')} * 100, 2)", "recent_20d_return_percent"),
           ("round(vol, 2)", "volatility_percent"), ("highest_price", "highest_price"),
           ("lowest_price", "lowest_price"), ("ls.ma_20", "ma_20"), ("ls.ma_50", "ma_50")]
    if pre:
        other += [_sig("ls.rsi", 70, 30, "Overbought", "Oversold", "Neutral") + " AS rsi_signal",
                  _sig("ls.bb_position", 0.8, 0.2, "Near Upper Band", "Near Lower Band", "Mid-Range")
                  + " AS bollinger_signal"]
        dbl += [("ls.rsi", "rsi"), ("ls.macd", "macd"), ("ls.macd_signal", "macd_signal"),
                ("ls.macd_histogram", "macd_histogram"), ("ls.bb_position", "bollinger_position")]
    return with_(*src_ctes, last, agg, rec, recursive=pre) + sel(
        "ag JOIN ls ON ag.symbol = ls.symbol LEFT JOIN rc ON ag.symbol = rs", dbl, other)


SQL["analyze_symbols"] = _analyze(True)
SQL["analyze_symbols_raw"] = _analyze(False)
SQL["freshness"] = with_("bars_nation") + """SELECT symbol, max(date) AS last_date, count(*) AS record_count,
  CAST(floor(epoch(TIMESTAMP '1998-08-10 12:00:00' - max(date)) / 86400) AS BIGINT) AS days_old,
  floor(epoch(TIMESTAMP '1998-08-10 12:00:00' - max(date)) / 86400) <= 7 AS is_fresh
  FROM bars_nation GROUP BY symbol"""
SQL["duplicate_count"] = with_("quotes_dirty") + \
    "SELECT symbol, count(*) - count(DISTINCT date) AS duplicates FROM quotes_dirty GROUP BY symbol"

# --- 2.5 - 2.7 -----------------------------------------------------------------
SQL["sector_join"] = with_("bars_nation", "sectors") + sel(
    f"{_tr} t JOIN sectors USING (symbol)",
    ["first_close", "last_close", (f"{div('last_close - first_close', 'first_close')} * 100", "total_return_pct")],
    ["symbol", "sector"])
SQL["industry_join"] = with_("bars_nation", "symdim") + sel(
    "(SELECT * FROM bars_nation QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1) b "
    "LEFT JOIN symdim USING (symbol)", BAR[2:], BAR[:2] + ["company_name", "industry", "series", "isin_code"])
SQL["merge_bars"] = with_("bars_nation") + sel(
    """(SELECT * EXCLUDE (_b) FROM (SELECT *, 0 AS _b FROM bars_nation WHERE date < TIMESTAMP '1997-01-01'
        UNION ALL SELECT * REPLACE (close + 1 AS close), 1 FROM bars_nation WHERE date >= TIMESTAMP '1996-07-01')
      QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY _b DESC) = 1)""", BAR[2:], BAR[:2])
SQL["upsert_bars"] = SQL["merge_bars"]
SQL["sort_bars"] = bars_sql("bars_nation")
_drift = f"""dfit AS (SELECT symbol, arg_min(close, date) AS first_close, arg_max(close, date) AS last_close,
  max(date) AS last_date, count(*) AS n, stddev_samp(d) AS sigma FROM
  (SELECT *, close - {lag('close')} AS d FROM bars_nation) GROUP BY symbol),
dfc AS (SELECT symbol, CAST(h AS INTEGER) AS forecast_step, CAST(last_date + h * INTERVAL 1 DAY AS TIMESTAMP) AS date,
  last_close + h * ((last_close - first_close) / NULLIF(n - 1, 0)) AS predicted_value,
  {lit(1.959963984540054)} * sigma * sqrt(h) AS half
  FROM dfit, range(1, 31) t(h))"""
SQL["drift_forecast"] = with_("bars_nation", _drift) + sel(
    "dfc", ["predicted_value", ("predicted_value - half", "lower_ci"), ("predicted_value + half", "upper_ci")],
    ["symbol", "forecast_step", "date", "'drift' AS model_used"])
SQL["forecast_spine"] = with_("bars_nation") + """SELECT symbol, max(date) AS last_date, CAST(h AS INTEGER) AS forecast_step,
  CAST(max(date) + h * INTERVAL 1 DAY AS TIMESTAMP) AS date, strftime(max(date) + h * INTERVAL 1 DAY, '%Y-%m-%d') AS date_text
  FROM bars_nation, range(1, 31) t(h) GROUP BY symbol, h"""
_pc = """pc AS (SELECT d.symbol, arg_max(predicted_value, forecast_step) AS last_prediction,
  max(forecast_step) AS days, any_value(b.last_close) AS last_close FROM dfc d JOIN
  (SELECT symbol, arg_max(close, date) AS last_close FROM bars_nation GROUP BY symbol) b ON d.symbol = b.symbol
  GROUP BY d.symbol),
pcx AS (SELECT *, (last_prediction - last_close) / NULLIF(last_close, 0) * 100 AS predicted_change_pct FROM pc)"""
_pcsel = ["last_prediction", "last_close", "predicted_change_pct"]
SQL["predicted_change"] = with_("bars_nation", _drift, _pc) + sel("pcx", _pcsel, ["symbol", "days"])
_conf = "CASE WHEN days <= 7 THEN 'High' WHEN days <= 30 THEN 'Medium' ELSE 'Low' END"
SQL["confidence_label"] = with_("bars_nation", _drift, _pc) + f"SELECT symbol, days, {_conf} AS confidence FROM pcx"
SQL["top_gainers"] = with_("bars_nation", _drift, _pc) + sel(
    "(SELECT * FROM pcx ORDER BY predicted_change_pct DESC, symbol LIMIT 5)", _pcsel, ["symbol", "days"])
SQL["top_losers"] = with_("bars_nation", _drift, _pc) + sel(
    "(SELECT * FROM pcx ORDER BY predicted_change_pct ASC, symbol LIMIT 5)", _pcsel, ["symbol", "days"])
SQL["sector_performance"] = with_("bars_nation", "sectors", _drift, _pc) + sel(
    "(SELECT sector, coalesce(avg(predicted_change_pct), 0) AS avg_change, count(predicted_change_pct) AS stocks "
    "FROM sectors s LEFT JOIN pcx p ON s.symbol = p.symbol GROUP BY sector)", ["avg_change"], ["sector", "stocks"])
SQL["market_sentiment"] = with_("bars_nation", _drift, _pc) + """SELECT count(*) FILTER (WHERE predicted_change_pct > 0) AS bullish,
  count(*) FILTER (WHERE predicted_change_pct < 0) AS bearish, count(*) AS total,
  CASE WHEN count(*) FILTER (WHERE predicted_change_pct > 0) > count(*) / 2 THEN 'Bullish' ELSE 'Bearish' END AS sentiment FROM pcx"""
SQL["market_analysis"] = with_("bars_nation", "sectors", _drift, _pc) + sel(
    "pcx LEFT JOIN sectors USING (symbol)", _pcsel, ["symbol", "days", f"{_conf} AS confidence", "sector"])

# --- 2.8 - 2.9 -----------------------------------------------------------------
_split = """sp AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS rn,
  count(*) OVER (PARTITION BY symbol) AS n FROM bars_nation),
tr AS (SELECT * FROM sp WHERE rn < floor(n * 0.8)),
te AS (SELECT symbol, date, close AS actual, rn - floor(n * 0.8) + 1 AS step FROM sp WHERE rn >= floor(n * 0.8)),
tfit AS (SELECT symbol, arg_min(close, date) AS first_close, arg_max(close, date) AS last_close, count(*) AS tn
  FROM tr GROUP BY symbol),
pr AS (SELECT te.symbol, te.date, te.actual,
  last_close + step * ((last_close - first_close) / NULLIF(tn - 1, 0)) AS predicted
  FROM te JOIN tfit ON te.symbol = tfit.symbol)"""
SQL["align_actual_forecast"] = with_("bars_nation", _split) + sel("pr", ["actual", "predicted"], ["symbol", "date"])
SQL["regression_metrics"] = with_("bars_nation", _split) + sel(
    """(SELECT symbol, count(*) AS n, avg((actual - predicted) * (actual - predicted)) AS mse,
        avg(abs(actual - predicted)) AS mae, sum((actual - predicted) * (actual - predicted)) AS ss,
        var_pop(actual) AS v FROM pr WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY symbol)""",
    [("sqrt(mse)", "rmse"), "mae", "mse", (f"1 - {div('ss', 'v * n')}", "r2")], ["symbol", "n"])
SQL["mape"] = with_("bars_nation", _split) + sel(
    "(SELECT symbol, avg(abs((actual - predicted) / actual)) * 100 AS mape FROM pr "
    "WHERE actual IS NOT NULL AND predicted IS NOT NULL AND actual <> 0 GROUP BY symbol)", ["mape"], ["symbol"])
_dir = f"""dm AS (SELECT symbol, count(*) FILTER (WHERE NOT au AND NOT pu) AS tn, count(*) FILTER (WHERE NOT au AND pu) AS fp,
  count(*) FILTER (WHERE au AND NOT pu) AS fn, count(*) FILTER (WHERE au AND pu) AS tp FROM
  (SELECT symbol, actual - {lag('actual')} > 0 AS au, predicted - {lag('predicted')} > 0 AS pu,
          {lag('actual')} IS NOT NULL AS has FROM pr WHERE actual IS NOT NULL AND predicted IS NOT NULL)
  WHERE has GROUP BY symbol)"""
SQL["direction_metrics"] = with_("bars_nation", _split, _dir) + sel(
    "dm", [(div("tn + tp", "tn + fp + fn + tp"), "direction_accuracy")], ["symbol", "tn", "fp", "fn", "tp"])
_p = f"coalesce({div('tp', 'tp + fp')}, 0)"
_r = f"coalesce({div('tp', 'tp + fn')}, 0)"
SQL["classification_metrics"] = with_("bars_nation", _split, _dir) + sel(
    "dm", [(div("tn + tp", "tn + fp + fn + tp"), "direction_accuracy"), (_p, "precision"), (_r, "recall"),
           (f"coalesce({div(f'2 * {_p} * {_r}', f'{_p} + {_r}')}, 0)", "f1")], ["symbol", "tn", "fp", "fn", "tp"])
SQL["accuracy_vs_price"] = with_("bars_nation", _split) + sel(
    "(SELECT symbol, (1 - avg(abs(actual - predicted)) / NULLIF(avg(actual), 0)) * 100 AS a FROM pr "
    "WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY symbol)", [("a", "accuracy_pct")], ["symbol"])
SQL["temporal_split"] = with_("bars_nation") + sel(
    "(SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 < floor(count(*) OVER (PARTITION BY symbol) * 0.8) AS is_train FROM bars_nation)",
    BAR[2:], BAR[:2] + ["is_train"])
_d1 = f"""dd1 AS (SELECT symbol, date, close, close - {lag('close')} AS d, {lag('close')} - {lag('close', 2)} AS d1,
  {lag('close')} AS y1 FROM bars_nation)"""
SQL["stationarity"] = with_("bars_nation", _d1) + sel(
    """(SELECT symbol, regr_count(d, y1) AS n_obs, regr_slope(d, y1) AS gamma,
        regr_slope(d, y1) / sqrt(((regr_syy(d, y1) - regr_sxy(d, y1) * regr_sxy(d, y1) / NULLIF(regr_sxx(d, y1), 0))
        / NULLIF(regr_count(d, y1) - 2, 0)) / NULLIF(regr_sxx(d, y1), 0)) AS t FROM dd1 GROUP BY symbol)""",
    ["gamma", ("t", "adf_stat")], ["symbol", "n_obs", "t < -2.8621 AS is_stationary"],
    overrides={"gamma": 8, "adf_stat": 6})
SQL["ar_fit"] = with_("bars_nation", _d1) + sel(
    """(SELECT symbol, regr_slope(close, y1) AS phi, regr_intercept(close, y1) AS c, regr_count(close, y1) AS n_obs,
        arg_max(close, date) AS last_close, arg_max(close, date) AS last_z, max(date) AS last_date,
        regr_syy(close, y1) - regr_sxy(close, y1) * regr_sxy(close, y1) / NULLIF(regr_sxx(close, y1), 0) AS ssr
        FROM dd1 GROUP BY symbol)""",
    ["phi", "c", "last_close", "last_z", ("ssr / NULLIF(n_obs - 2, 0)", "sigma2"),
     ("n_obs * ln(ssr / n_obs) + 6", "aic"), ("n_obs * ln(ssr / n_obs) + 3 * ln(n_obs)", "bic")],
    ["symbol", "n_obs", "last_date", "0 AS d"],
    overrides={"phi": 6, "c": 2, "sigma2": -6, "aic": 4, "bic": 4})

# --- 2.10, 2.11 ------------------------------------------------------------------
SQL["write_bars"] = bars_sql("bars_nation")
SQL["write_csv"] = bars_sql("bars_nation")
SQL["write_metrics"] = SQL["regression_metrics"]
SQL["stream_ingest"] = SQL["validate_bars"]
SQL["stream_resample"] = bars_sql("bars_event")
SQL["stream_ingest_redelivery"] = SQL["stream_ingest"]
SQL["stream_resample_closed"] = with_("bars_event") + sel(
    "bars_event", BAR[2:], BAR[:2], "date + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
SQL["stream_late_rows"] = "SELECT event_id, ts, event_type, " + sql_round("value", "value") + \
    " FROM events WHERE ts < TIMESTAMP '2024-01-02'"
SQL["prepare_for_modeling"] = with_("bars_nation", _mf_cte) + sel(
    "mf", MODEL_FEATURES + ["target"], ["symbol", "date"],
    " AND ".join(f"{c} IS NOT NULL" for c in MODEL_FEATURES + ["target"]))

SQL["model_params_save_load"] = SQL["ar_fit"]

# ARI(1,1) forecast by closed forms (the Spark side recurses step by step):
# z_h = c(1 - phi^h)/(1 - phi) + phi^h z_T, y_h = y_T + sum z, var ~ sum cum_j^2.
SQL["ar_forecast"] = with_("bars_nation", _d1, f"""afit AS (SELECT symbol, regr_slope(d, d1) AS phi,
  regr_intercept(d, d1) AS c,
  (regr_syy(d, d1) - regr_sxy(d, d1) * regr_sxy(d, d1) / NULLIF(regr_sxx(d, d1), 0))
    / NULLIF(regr_count(d, d1) - 2, 0) AS sigma2,
  arg_max(close, date) AS last_close, arg_max(d, date) AS last_z, max(date) AS last_date
  FROM dd1 GROUP BY symbol)""", """ast AS (SELECT symbol, h, last_date, sigma2, last_close,
  c * (1 - pow(phi, h)) / (1 - phi) + pow(phi, h) * last_z AS z,
  (1 - pow(phi, h)) / (1 - phi) AS cum FROM afit, range(1, 31) t(h))""", """aacc AS (SELECT symbol, h, last_date,
  last_close + sum(z) OVER (PARTITION BY symbol ORDER BY h ROWS UNBOUNDED PRECEDING) AS y,
  sigma2 * sum(cum * cum) OVER (PARTITION BY symbol ORDER BY h ROWS UNBOUNDED PRECEDING) AS var FROM ast)""") + sel(
    "aacc", [("y", "predicted_value"), (f"y - {lit(1.959963984540054)} * sqrt(var)", "lower_ci"),
             (f"y + {lit(1.959963984540054)} * sqrt(var)", "upper_ci")],
    ["symbol", "CAST(h AS INTEGER) AS forecast_step",
     "CAST(last_date + h * INTERVAL 1 DAY AS TIMESTAMP) AS date", "'ar' AS model_used"])


def _ar_ctes(src: str, p: str, horizon: str) -> list[str]:
    """ARI(1,1) fit on ``src`` and closed-form forecast for h in 1..horizon(symbol)."""
    return [f"""{p}_dd AS (SELECT symbol, date, close, close - lag(close) OVER (PARTITION BY symbol ORDER BY date) AS d,
  lag(close) OVER (PARTITION BY symbol ORDER BY date) - lag(close, 2) OVER (PARTITION BY symbol ORDER BY date) AS d1
  FROM {src})""", f"""{p}_fit AS (SELECT symbol, regr_slope(d, d1) AS phi, regr_intercept(d, d1) AS c,
  arg_max(close, date) AS last_close, arg_max(d, date) AS last_z, max(date) AS last_date
  FROM {p}_dd GROUP BY symbol)""", f"""{p}_fc AS (SELECT f.symbol, h,
  last_close + sum(c * (1 - pow(phi, h)) / (1 - phi) + pow(phi, h) * last_z)
    OVER (PARTITION BY f.symbol ORDER BY h ROWS UNBOUNDED PRECEDING) AS pred
  FROM {p}_fit f JOIN {horizon} z ON f.symbol = z.symbol, range(1, z.days + 1) t(h))"""]


def _drift_ctes(src: str, p: str, horizon: str) -> list[str]:
    return [f"""{p}_dfit AS (SELECT symbol, arg_min(close, date) AS first_close, arg_max(close, date) AS last_close,
  count(*) AS n FROM {src} GROUP BY symbol)""", f"""{p}_dfc AS (SELECT f.symbol, h,
  last_close + h * ((last_close - first_close) / NULLIF(n - 1, 0)) AS pred
  FROM {p}_dfit f JOIN {horizon} z ON f.symbol = z.symbol, range(1, z.days + 1) t(h))"""]


_eval = [_split.replace("tfit AS", "tfit_unused AS"),
         "hz AS (SELECT symbol, CAST(max(step) AS BIGINT) AS days FROM te GROUP BY symbol)",
         *_ar_ctes("tr", "ev", "hz"), *_drift_ctes("tr", "ev", "hz"),
         """scores AS (
  SELECT te.symbol, 'ar' AS model_name, sqrt(avg((actual - pred) * (actual - pred))) AS rmse
  FROM te JOIN ev_fc f ON te.symbol = f.symbol AND te.step = f.h GROUP BY te.symbol
  UNION ALL
  SELECT te.symbol, 'drift', sqrt(avg((actual - pred) * (actual - pred)))
  FROM te JOIN ev_dfc f ON te.symbol = f.symbol AND te.step = f.h GROUP BY te.symbol)""",
         """best AS (SELECT symbol, arg_min(model_name, (rmse, model_name)) AS best_model, min(rmse) AS best_rmse
  FROM scores WHERE rmse IS NOT NULL GROUP BY symbol)"""]
SQL["best_model_drift_ar"] = with_("bars_nation", *_eval) + sel("best", ["best_rmse"], ["symbol", "best_model"])
_final = ["fz AS (SELECT symbol, 30 AS days FROM bars_nation GROUP BY symbol)",
          f"""fdd AS (SELECT symbol, date, close, close - {lag('close')} AS d, {lag('close')} - {lag('close', 2)} AS d1
  FROM bars_nation)""",
          """ffit AS (SELECT symbol, regr_slope(d, d1) AS phi, regr_intercept(d, d1) AS c,
  (regr_syy(d, d1) - regr_sxy(d, d1) * regr_sxy(d, d1) / NULLIF(regr_sxx(d, d1), 0))
    / NULLIF(regr_count(d, d1) - 2, 0) AS sigma2,
  arg_max(close, date) AS last_close, arg_max(d, date) AS last_z, max(date) AS last_date FROM fdd GROUP BY symbol)""",
          """far AS (SELECT symbol, h, last_date, 'ar' AS model_used,
  last_close + sum(c * (1 - pow(phi, h)) / (1 - phi) + pow(phi, h) * last_z)
    OVER (PARTITION BY symbol ORDER BY h ROWS UNBOUNDED PRECEDING) AS y,
  sqrt(sigma2 * sum(((1 - pow(phi, h)) / (1 - phi)) * ((1 - pow(phi, h)) / (1 - phi)))
    OVER (PARTITION BY symbol ORDER BY h ROWS UNBOUNDED PRECEDING)) AS sd
  FROM ffit, range(1, 31) t(h))""",
          f"""fdr AS (SELECT symbol, h, last_date, 'drift' AS model_used,
  last_close + h * ((last_close - first_close) / NULLIF(n - 1, 0)) AS y, sigma * sqrt(h) AS sd
  FROM dfit, range(1, 31) t(h))"""]
_drift_fit_only = _drift.split("dfc AS")[0].rstrip().rstrip(",")
SQL["select_and_forecast_drift_ar"] = with_("bars_nation", *_eval, _drift_fit_only, *_final) + sel(
    "(SELECT * FROM far UNION ALL SELECT * FROM fdr) x JOIN best b ON x.symbol = b.symbol AND x.model_used = b.best_model",
    [("y", "predicted_value"), (f"y - {lit(1.959963984540054)} * sd", "lower_ci"),
     (f"y + {lit(1.959963984540054)} * sd", "upper_ci")],
    ["x.symbol", "CAST(h AS INTEGER) AS forecast_step",
     "CAST(last_date + h * INTERVAL 1 DAY AS TIMESTAMP) AS date", "model_used"])


def _audit_sql() -> str:
    price = ["date", "open", "high", "low", "close", "volume"]
    nulls = lambda cols: " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in cols)
    dd = """dd AS (SELECT * FROM araw QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY
  open DESC NULLS LAST, high DESC NULLS LAST, low DESC NULLS LAST, close DESC NULLS LAST,
  volume DESC NULLS LAST) = 1)"""
    ctes = ["quotes_dirty", "araw AS (SELECT symbol, date, open, high, low, close, volume FROM quotes_dirty)",
            dd, *_clean[1:], _fences("cb"), _iqr, *_tech_from("io"),
            f"feats AS (SELECT tf.*, {', '.join(MACD_COLS)} FROM {_tech_join})",
            f"""s1 AS (SELECT symbol, count(*) AS rows, 7 AS columns, {nulls(price)} AS null_values,
  count(*) - count(DISTINCT date) AS duplicates FROM araw GROUP BY symbol)""",
            f"s2 AS (SELECT symbol, count(*) AS remaining_rows, {nulls(price)} AS remaining_nulls FROM cb GROUP BY symbol)",
            "s3 AS (SELECT symbol, " + ", ".join(
                f"count(*) FILTER (WHERE {c} < lo_{c} OR {c} > hi_{c}) AS outliers_{c}" for c in S.PRICE_COLS)
            + " FROM cb LEFT JOIN fe ON symbol = s GROUP BY symbol)",
            f"""s4 AS (SELECT symbol, count(*) AS feature_rows, {nulls(price + ROLLING + MACD_COLS)} AS final_nulls,
  avg(close) AS close_mean, stddev_samp(close) AS close_std, min(close) AS close_min, max(close) AS close_max,
  date_diff('day', TIMESTAMP '1970-01-01', min(date)) AS first_day,
  date_diff('day', TIMESTAMP '1970-01-01', max(date)) AS last_day
  FROM feats GROUP BY symbol)"""]
    parts = []

    def add(step, table, metric, expr=None):
        parts.append(f"SELECT symbol, '{step}' AS step, '{metric}' AS metric, "
                     f"CAST({expr or metric} AS DOUBLE) AS value FROM {table}")
    for m in ["rows", "columns", "null_values", "duplicates"]:
        add("1. Data Validation", "s1", m)
    add("2. Data Cleaning", "s1 JOIN s2 USING (symbol)", "removed_rows", "rows - remaining_rows")
    add("2. Data Cleaning", "s1 JOIN s2 USING (symbol)", "filled_nulls", "null_values - remaining_nulls")
    for m in ["remaining_rows", "remaining_nulls"]:
        add("2. Data Cleaning", "s2", m)
    for c in S.PRICE_COLS:
        add("3. Outlier Handling", "s3", f"outliers_{c}")
    add("3. Outlier Handling", "s3", "outliers_total", " + ".join(f"outliers_{c}" for c in S.PRICE_COLS))
    add("4. Feature Engineering", "s4", "features_added", "35")
    add("4. Feature Engineering", "s4", "feature_rows")
    for m in ["close_mean", "close_std", "close_min", "close_max"]:
        add("5. Normalization", "s4", m)
    add("6. Final Quality", "s4", "final_nulls")
    add("6. Final Quality", "s4", "quality_excellent", "CASE WHEN final_nulls = 0 THEN 1 ELSE 0 END")
    for m in ["first_day", "last_day"]:
        add("6. Final Quality", "s4", m)
    return with_(*ctes, recursive=True) + sel("(" + " UNION ALL ".join(parts) + ")",
                                               ["value"], ["symbol", "step", "metric"])


SQL["pipeline_audit"] = _audit_sql()
SQL["pipeline_counters"] = f"""SELECT metric AS counter, sum(value)::BIGINT AS value FROM ({SQL['pipeline_audit']})
WHERE metric IN ('remaining_rows', 'remaining_nulls', 'feature_rows', 'final_nulls') GROUP BY metric"""


_ok = " AND ".join(f"{c} IS NOT NULL" for c in MODEL_FEATURES + ["target"])
SQL["standard_scale"] = with_("bars_nation", _mf_cte, f"""pm AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS rn,
  count(*) OVER (PARTITION BY symbol) AS n FROM mf WHERE {_ok})""",
    "ptr AS (SELECT * FROM pm WHERE rn < floor(n * 0.8))",
    "pst AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in MODEL_FEATURES)
    + " FROM ptr)") + sel(
    "pm, pst WHERE rn >= floor(n * 0.8)",
    [(f"CASE WHEN s_{c} = 0 THEN 0.0 ELSE ({c} - m_{c}) / s_{c} END", f"z_{c}") for c in MODEL_FEATURES],
    ["symbol", "date"])

SQL["end_to_end_drift_ar"] = (
    "SELECT f.*, a.latest_price, a.total_return_percent, a.volatility_percent, a.rsi_signal "
    f"FROM ({SQL['select_and_forecast_drift_ar']}) f JOIN ({SQL['analyze_symbols']}) a ON f.symbol = a.symbol")

SQL["gbt_training_rows"] = with_("bars_nation", _mf_cte, f"""gp AS (
  SELECT symbol, date, target AS actual, ln(target / close) AS label,
         row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS rn,
         floor(count(*) OVER (PARTITION BY symbol) * 0.8) AS t
  FROM mf WHERE {_ok} AND close > 0 AND target > 0)""",
    """gq AS (SELECT *, CASE WHEN rn >= t THEN 'test' WHEN rn = t - 1 THEN NULL WHEN rn >= floor(t * 0.9) THEN 'validation'
  WHEN rn = floor(t * 0.9) - 1 THEN NULL ELSE 'train' END AS part FROM gp)""") + sel(
    "gq", ["actual", "label"], ["symbol", "date", "part"], "part IS NOT NULL", {"label": 8})

SQL["random_split"] = with_("bars_nation") + sel(
    "bars_nation", BAR[2:], BAR[:2] + [
        "CAST('0x' || substr(md5(symbol || '|' || CAST(date AS VARCHAR) || '|42'), 1, 8) AS BIGINT) % 100"
        " < 80 AS is_train"])


SQL["gbt_forecast_spine"] = with_("bars_nation") + """SELECT symbol, h::INT AS forecast_step,
  date_trunc('day', max(date)) + to_days(h::INT) AS date, true AS is_finite
FROM bars_nation, range(1, 31) r(h) GROUP BY symbol, h"""
SQL["sector_sets"] = with_("bars_nation", "dim(sector, symbol) AS (VALUES " + ", ".join(
    f"('{sec}', '{sym}')" for sec, syms in S.SECTOR_SETS.items() for sym in syms) + ")") + """
SELECT sector, count(*) AS symbols, 0::BIGINT AS renamed
FROM (SELECT * FROM dim UNION ALL SELECT DISTINCT '(none)', symbol FROM bars_nation) GROUP BY sector"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
