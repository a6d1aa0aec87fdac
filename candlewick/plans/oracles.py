"""DuckDB SQL of the registered queries, written from the operators' definitions."""

from __future__ import annotations

from candlewick.plans.planted import blocks, planted

ORACLES: dict[str, str] = {}


def _events(ms: int, tf: str, by_type: bool = True) -> str:
    symbol = "event_type" if by_type else "'ALL'"
    return f"""(SELECT {symbol} AS symbol, '{tf}' AS timeframe, epoch_us(ts) // 1000 // {ms} * {ms} AS timestamp, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
        last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY ALL)"""


H4, H1 = _events(14_400_000, "4h"), _events(3_600_000, "1h")
_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
DAILY = f"""(SELECT l_returnflag || '/' || l_linestatus AS symbol, '1d' AS timeframe, epoch_us(l_shipdate) // 1000 // 86400000 * 86400000 AS timestamp, first(l_extendedprice ORDER BY {_ORDER}) AS open,
    max(l_extendedprice) AS high, min(l_extendedprice) AS low, last(l_extendedprice ORDER BY {_ORDER}) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY ALL)"""
_W = "PARTITION BY symbol, timeframe ORDER BY timestamp"
_R = lambda digits, *cs: ", ".join(f"round({c}, {digits}) AS {c}" for c in cs)


def _tr(source: str) -> str:
    """Rows with idx, n and the true range."""
    return f"""(SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM (SELECT *, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY timestamp) - 1 AS idx, count(*) OVER (PARTITION BY symbol, timeframe) AS n,
        coalesce(lag(close) OVER (PARTITION BY symbol, timeframe ORDER BY timestamp), close) AS pc FROM {source}))"""


def _atr(source: str) -> str:
    return f"""(SELECT *, coalesce(CASE WHEN idx >= 14 THEN avg(tr) OVER ({_W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) END, first_atr, avg(tr) OVER (PARTITION BY symbol, timeframe)) AS atr
        FROM (SELECT *, max(CASE WHEN idx = 14 THEN r END) OVER (PARTITION BY symbol, timeframe) AS first_atr FROM (SELECT *, avg(tr) OVER ({_W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS r FROM {_tr(source)})))"""


def _slope(source: str) -> str:
    w = f"OVER ({_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"
    return f"(SELECT *, CASE WHEN count(*) {w} < 2 THEN 0 ELSE coalesce(regr_slope(close, idx) {w}, 0) END AS slope FROM {_tr(source)})"


def _is(name: str, way: str, conf: float, **numbers: str) -> str:
    way = f"'{way}'" if way in ("bullish", "bearish", "neutral") else way
    f = "MAP {" + ", ".join(f"'{k}': CAST({v} AS DOUBLE)" for k, v in numbers.items()) + "}" if numbers else "MAP([]::VARCHAR[], []::DOUBLE[])"
    return f"{{'name': '{name}', 'way': {way}, 'conf': {conf}::DOUBLE, 'f': {f}}}"


_WAY = "CASE WHEN k.c > k.o THEN 'bullish' WHEN k.c < k.o THEN 'bearish' ELSE 'neutral' END"
#: By hand, from the patterns' definitions: k is the candle, p the one before, q the one before that; b body, r range.
_ARMS = [
    f"""CASE WHEN k.b / k.r > 0.1 THEN NULL WHEN lower >= 0.5 AND upper <= 0.2 THEN {_is("DragonflyDoji", "if(k.c >= k.o, 'bullish', 'bearish')", 0.6, body_pct="k.b / k.r")}
        WHEN upper >= 0.5 AND lower <= 0.2 THEN {_is("GravestoneDoji", "if(k.c <= k.o, 'bearish', 'bullish')", 0.6, body_pct="k.b / k.r")}
        WHEN least(lower, upper) >= 0.35 THEN {_is("LongLeggedDoji", "neutral", 0.55, body_pct="k.b / k.r")} ELSE {_is("Doji", "neutral", 0.5, body_pct="k.b / k.r")} END""",
    f"""CASE WHEN lower < 0.6 OR k.b / k.r > 0.3 OR upper > 0.25 THEN NULL WHEN slope > 0 AND k.c - k.o <= 0.2 * k.r THEN {_is("HangingMan", "bearish", 0.55, lower_wick_pct="lower")} ELSE {_is("Hammer", "bullish", 0.55, lower_wick_pct="lower")} END""",
    f"""CASE WHEN upper < 0.6 OR k.b / k.r > 0.3 OR lower > 0.25 THEN NULL WHEN slope < 0 AND k.o - k.c <= 0.2 * k.r THEN {_is("ShootingStar", "bearish", 0.55, upper_wick_pct="upper")}
        ELSE {_is("InvertedHammer", "if(slope < 0, 'bearish', 'bullish')", 0.5, upper_wick_pct="upper")} END""",
    f"CASE WHEN k.b / k.r <= 0.25 AND least(lower, upper) >= 0.3 THEN {_is('SpinningTop', 'neutral', 0.45, body_pct='k.b / k.r')} END",
    f"CASE WHEN greatest(lower, upper) <= 0.03 THEN {_is('Marubozu', _WAY, 0.65, body_pct='k.b / k.r')} END",
    f"CASE WHEN k.c > k.o AND lower <= 0.05 AND k.h - k.c <= 0.05 * k.r THEN {_is('BeltHold', 'bullish', 0.55, lo_pct='lower')} WHEN k.c < k.o AND upper <= 0.05 AND k.c - k.l <= 0.05 * k.r THEN {_is('BeltHold', 'bearish', 0.55, up_pct='upper')} END",
]
_TWO_BARS = [
    f"CASE WHEN down1 AND rises AND k.o < p.c AND k.c > p.o THEN {_is('BullishEngulfing', 'bullish', 0.6, prev_body_pct='p.b / p.r', next_body_pct='k.b / k.r')} END",
    f"CASE WHEN up1 AND falls AND k.o > p.c AND k.c < p.o THEN {_is('BearishEngulfing', 'bearish', 0.6, prev_body_pct='p.b / p.r', next_body_pct='k.b / k.r')} END",
    f"CASE WHEN down1 AND rises AND k.b < p.b AND k.o > p.c AND k.c < p.o THEN {_is('Harami', 'bullish', 0.45, harami_body_ratio='k.b / (p.b + 1e-12)')} WHEN up1 AND falls AND k.b < p.b AND k.o < p.c AND k.c > p.o THEN {_is('Harami', 'bearish', 0.45, harami_body_ratio='k.b / (p.b + 1e-12)')} END",
    f"CASE WHEN k.b / k.r > 0.1 THEN NULL WHEN down1 AND rises AND k.b < p.b AND k.o > p.c AND k.c < p.o THEN {_is('HaramiCross', 'bullish', 0.5, body_pct='k.b / k.r')} WHEN up1 AND falls AND k.b < p.b AND k.o < p.c AND k.c > p.o THEN {_is('HaramiCross', 'bearish', 0.5, body_pct='k.b / k.r')} END",
    f"CASE WHEN up1 AND falls AND k.o >= p.c AND k.c <= (p.o + p.c) / 2 AND k.c > p.l THEN {_is('DarkCloudCover', 'bearish', 0.6, mid='(p.o + p.c) / 2')} END",
    f"CASE WHEN down1 AND rises AND k.o <= p.c AND k.c >= (p.o + p.c) / 2 AND k.c < p.o THEN {_is('PiercingLine', 'bullish', 0.6, mid='(p.o + p.c) / 2')} END",
    f"CASE WHEN k.h <= p.h AND k.l >= p.l THEN {_is('InsideBar', 'neutral', 0.4, range_pct='k.r / (p.r + 1e-12)')} END",
    f"CASE WHEN k.h >= p.h AND k.l <= p.l THEN {_is('OutsideBar', _WAY, 0.4, range_pct='k.r / (p.r + 1e-12)')} END",
    f"CASE WHEN up1 AND falls AND abs(k.h - p.h) / (p.h + 1e-12) <= 0.01 THEN {_is('TweezerTop', 'bearish', 0.55, height_tolerance='abs(k.h - p.h) / (p.h + 1e-12)')} END",
    f"CASE WHEN down1 AND rises AND abs(k.l - p.l) / (p.l + 1e-12) <= 0.01 THEN {_is('TweezerBottom', 'bullish', 0.55, depth_tolerance='abs(k.l - p.l) / (p.l + 1e-12)')} END",
    f"CASE WHEN p.b / p.r > 0.2 OR k.b < 1.2 * p.b THEN NULL WHEN down1 AND rises AND k.c > p.h THEN {_is('Kicker', 'bullish', 0.6, body1_pct='p.b / p.r', body2='k.b')} WHEN up1 AND falls AND k.c < p.l THEN {_is('Kicker', 'bearish', 0.6, body1_pct='p.b / p.r', body2='k.b')} END",
]
_THREE_BARS = [
    f"CASE WHEN q.c < q.o AND p.b / p.r <= 0.35 AND k.c > (q.o + q.c) / 2 AND rises THEN {_is('MorningStar', 'bullish', 0.55, mid='(q.o + q.c) / 2')} WHEN q.c > q.o AND p.b / p.r <= 0.35 AND k.c < (q.o + q.c) / 2 AND falls THEN {_is('EveningStar', 'bearish', 0.55, mid='(q.o + q.c) / 2')} END",
    f"CASE WHEN p.b / p.r > 0.1 THEN NULL WHEN q.c < q.o AND k.c > (q.o + q.c) / 2 AND rises THEN {_is('MorningDojiStar', 'bullish', 0.6, mid='(q.o + q.c) / 2', star_doji_body_pct='p.b / p.r')} WHEN q.c > q.o AND k.c < (q.o + q.c) / 2 AND falls THEN {_is('EveningDojiStar', 'bearish', 0.6, mid='(q.o + q.c) / 2', star_doji_body_pct='p.b / p.r')} END",
    # Three in a row are looked for once a fourth candle is there.
    f"""CASE WHEN idx = n - 1 OR least(q.b / (q.r + 1e-12), p.b / (p.r + 1e-12), k.b / (k.r + 1e-12)) <= 0.2 THEN NULL
        WHEN q.o < q.c AND up1 AND rises AND q.c < p.c AND p.c < k.c AND p.o BETWEEN q.o AND q.c AND k.o BETWEEN p.o AND p.c THEN {_is("ThreeWhiteSoldiers", "bullish", 0.6)}
        WHEN q.o > q.c AND down1 AND falls AND q.c > p.c AND p.c > k.c AND p.o BETWEEN q.c AND q.o AND k.o BETWEEN p.c AND p.o THEN {_is("ThreeBlackCrows", "bearish", 0.6)} END""",
]


def _patterns(source: str) -> str:
    arms = ", ".join([*(x.replace("CASE WHEN", "CASE WHEN idx < 2 THEN NULL WHEN", 1) for x in (*_ARMS, *_THREE_BARS)), *(x.replace("CASE WHEN", "CASE WHEN idx < 1 THEN NULL WHEN", 1) for x in _TWO_BARS)])
    return f"""(WITH f AS (SELECT symbol, timeframe, timestamp, idx, n, slope, {{'o': open, 'h': high, 'l': low, 'c': close, 'r': greatest(high - low, 1e-12), 'b': abs(close - open)}} AS k FROM {_slope(source)}),
        g AS (SELECT *, lag(k) OVER ({_W}) AS p, lag(k, 2) OVER ({_W}) AS q, (k.h - greatest(k.o, k.c)) / k.r AS upper, (least(k.o, k.c) - k.l) / k.r AS lower, k.c > k.o AS rises, k.c < k.o AS falls FROM f),
        m AS MATERIALIZED (SELECT *, p.c > p.o AS up1, p.c < p.o AS down1 FROM g WHERE n >= 5),
        u AS (SELECT symbol, timeframe, timestamp, unnest(list_filter([{arms}], lambda z: z IS NOT NULL)) AS z FROM m)
        SELECT symbol, timeframe, timestamp, z.name AS pattern_type, z.way AS direction, z.conf AS confidence, z.f AS features FROM u)"""


def _best(source: str) -> str:
    return f"(SELECT symbol, timeframe, timestamp, pattern_type, max(confidence) AS confidence, arg_min(direction, row(-confidence, direction)) AS direction, arg_min(features, row(-confidence, direction)) AS features FROM {_patterns(source)} GROUP BY symbol, timeframe, timestamp, pattern_type)"


_FORWARD = f"""(SELECT symbol, timestamp, CASE WHEN ok THEN c1 / close - 1 END AS fwd_1h, CASE WHEN ok THEN c4 / close - 1 END AS fwd_4h, CASE WHEN ok THEN c24 / close - 1 END AS fwd_24h
    FROM (SELECT *, c1 IS NOT NULL AND c4 IS NOT NULL AND c24 IS NOT NULL AND close <> 0 AS ok FROM (SELECT symbol, timestamp, close, lead(close, 1) OVER w AS c1, lead(close, 4) OVER w AS c4, lead(close, 24) OVER w AS c24
    FROM {H1} WINDOW w AS (PARTITION BY symbol ORDER BY timestamp))))"""
_Q = lambda h, ms: f"(SELECT CASE WHEN count(*) = 0 THEN 0.5 ELSE count(*) FILTER (WHERE p.fwd_{h} <= e.fwd_{h}) / count(*) END FROM has p WHERE p.pattern_type = e.pattern_type AND p.timeframe = e.timeframe AND p.timestamp <= e.timestamp - {ms})"
LABELLED = f"""(WITH got AS (SELECT e.symbol, e.timeframe, e.timestamp, e.pattern_type, e.confidence, f.fwd_1h, f.fwd_4h, f.fwd_24h FROM {_best(H4)} e ASOF LEFT JOIN {_FORWARD} f ON e.symbol = f.symbol AND e.timestamp <= f.timestamp),
    has AS MATERIALIZED (SELECT * FROM got WHERE fwd_1h IS NOT NULL),
    q AS (SELECT *, {_Q("1h", 3_600_000)} * 0.2 + {_Q("4h", 14_400_000)} * 0.3 + {_Q("24h", 86_400_000)} * 0.5 AS label_score FROM has e)
    SELECT *, CASE WHEN label_score >= 0.8 THEN 'Good' WHEN label_score <= 0.2 THEN 'Bad' ELSE 'Neutral' END AS label FROM q UNION ALL SELECT *, 0.5, 'Neutral' FROM got WHERE fwd_1h IS NULL)"""

ORACLES |= {
    "candles_events": f"SELECT symbol, timeframe, timestamp, {_R(6, 'open', 'high', 'low', 'close', 'volume')} FROM {H4}",
    "candles_daily": f"SELECT symbol, timestamp, {_R(6, 'open', 'high', 'low', 'close', 'volume')} FROM {DAILY}",
    "candle_upsert": f"SELECT symbol, timestamp, round(open, 6) AS open, round(CASE WHEN timestamp % 28800000 = 0 THEN close + 1 ELSE close END, 6) AS close, volume FROM {H4}",
    "candle_latest": f"SELECT symbol, max(timestamp) AS latest, count(*) AS n_candles FROM {H4} GROUP BY symbol",
    "candle_range_scan": f"SELECT symbol, timestamp, round(close, 6) AS close FROM {H1} WHERE symbol IN ('click', 'purchase') AND timestamp BETWEEN 1704412800000 AND 1705017600000",
    "pick_exchange": "SELECT DISTINCT event_type AS symbol, CASE WHEN event_type IN ('click', 'view') THEN 'second' ELSE 'first' END AS exchange FROM events",
    "closed_candles": f"SELECT symbol, CASE WHEN max(timestamp) + 14400000 <= 1706400000000 THEN max(timestamp) ELSE max(timestamp) - 14400000 END AS closed_ts FROM {H4} GROUP BY symbol",
    "atr_series": f"SELECT symbol, timestamp, {_R(6, 'tr', 'atr')} FROM {_atr(H4)}",
    "event_context": f"""WITH s AS (SELECT *, CASE WHEN idx >= 14 THEN avg(tr) OVER ({_W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) ELSE avg(tr) OVER ({_W} ROWS BETWEEN 50 PRECEDING AND CURRENT ROW) END AS atr_event,
        CASE WHEN idx = 0 THEN volume ELSE avg(volume) OVER ({_W} ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) END AS vol_mean,
        CASE WHEN idx = 0 THEN 0 WHEN idx = 1 THEN stddev_pop(volume) OVER ({_W} ROWS BETWEEN 50 PRECEDING AND CURRENT ROW) ELSE stddev_pop(volume) OVER ({_W} ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) END AS vol_std FROM {_tr(H4)}),
        p AS (SELECT *, CASE WHEN close <> 0 THEN atr_event / close ELSE 0 END AS atr_pct, (volume - vol_mean) / (vol_std + 1e-12) AS vol_z FROM s)
        SELECT symbol, timestamp, {_R(4, 'atr_event', 'atr_pct', 'vol_mean', 'vol_std', 'vol_z')}, CASE WHEN atr_pct < 0.01 THEN 'low' WHEN atr_pct < 0.03 THEN 'mid' ELSE 'high' END AS regime FROM p""",
    "trend_slope": f"SELECT symbol, timestamp, round(slope, 3) AS slope FROM {_slope(DAILY)}",
    "market_features": f"""SELECT symbol, timestamp, {", ".join(f"round(coalesce(close / lag(close, {k}) OVER ({_W}) - 1, 0), 6) AS ret_{k}" for k in (1, 3, 5))},
        round(close / avg(close) OVER ({_W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) - 1, 6) AS sma_rel, round(volume / (avg(volume) OVER ({_W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) + 1e-12), 6) AS vol_rel FROM {H4}""",
    "drawdown_curve": f"SELECT symbol, timestamp, round((max(close) OVER ({_W}) - close) / greatest(max(close) OVER ({_W}), 1e-12), 6) AS drawdown FROM {DAILY}",
    "candlestick_patterns": f"SELECT * EXCLUDE (features) FROM (SELECT * FROM {_patterns(DAILY)} UNION ALL SELECT * FROM {_patterns(H4)})",
    "pattern_dedup": f"SELECT symbol, timeframe, timestamp, pattern_type, confidence FROM {_best(H4)}",
    "two_bar_counts": f"""WITH b AS (SELECT *, lag(open) OVER w AS o1, lag(close) OVER w AS c1, lag(high) OVER w AS h1, lag(low) OVER w AS l1 FROM {H4} WINDOW w AS ({_W})),
        k AS (SELECT symbol, 'BullishEngulfing' AS pattern_type, 'bullish' AS direction FROM b WHERE c1 < o1 AND close > open AND open < c1 AND close > o1
        UNION ALL SELECT symbol, 'BearishEngulfing', 'bearish' FROM b WHERE c1 > o1 AND close < open AND open > c1 AND close < o1 UNION ALL SELECT symbol, 'InsideBar', 'neutral' FROM b WHERE high <= h1 AND low >= l1)
        SELECT symbol, pattern_type, direction, count(*) AS n FROM k GROUP BY ALL""",
    "forward_returns": f"SELECT e.symbol, e.timestamp + 1800000 AS timestamp, {_R(6, 'fwd_1h', 'fwd_4h', 'fwd_24h')} FROM {H4} e ASOF LEFT JOIN {_FORWARD} f ON e.symbol = f.symbol AND e.timestamp + 1800000 <= f.timestamp",
    "pattern_labels": f"SELECT symbol, timeframe, timestamp, pattern_type, {_R(6, 'fwd_1h', 'fwd_4h', 'fwd_24h', 'label_score')}, label FROM {LABELLED}",
    "timeframe_alignment": f"""SELECT p.symbol, p.timestamp, p.pattern_type, count(s.timestamp) AS matches, round(greatest(0, least(1, any_value(p.confidence) * (1 + 0.1 * count(s.timestamp)))), 6) AS boosted
        FROM {_best(H4)} p LEFT JOIN {_best(H1)} s ON s.symbol = p.symbol AND s.pattern_type = p.pattern_type AND abs(s.timestamp - p.timestamp) <= 7200000 GROUP BY p.symbol, p.timestamp, p.pattern_type""",
    "pattern_hash": f"WITH n AS (SELECT DISTINCT pattern_type FROM {_best(H4)}"
    + "), h AS (SELECT pattern_type, "
    + ", ".join(f"CAST(list_reduce(list_prepend(0, [strpos('0123456789abcdef', substr(md5(pattern_type || '|{i}'), k, 1)) - 1 for k in range(1, 33)]), lambda a, x: (16 * a + x) % 24) AS INTEGER) AS h{i}" for i in range(6))
    + " FROM n) SELECT *, CAST(len(list_distinct([h0, h1, h2, h3, h4, h5])) AS INTEGER) AS n_hot FROM h",
    "vector_topk": """WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
        j AS (SELECT q.vec_id AS query_id, s.vec_id AS record_id, list_dot_product(q.e, s.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(s.e, s.e)) + 1e-12) AS sim FROM s q, s WHERE q.vec_id % 100 = 0 AND s.label IN (1, 2, 3)),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, record_id) AS INTEGER) AS rank FROM j)
        SELECT query_id, record_id, rank, round(sim, 5) AS similarity FROM r WHERE rank <= 10""",
    "vector_late_filter": """WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
        j AS (SELECT q.vec_id AS query_id, s.vec_id AS record_id, s.label, list_dot_product(q.e, s.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(s.e, s.e)) + 1e-12) AS sim FROM s q, s WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, record_id) AS INTEGER) AS rank FROM j) SELECT query_id, record_id, rank FROM r WHERE rank <= 20 AND label = 1 AND record_id <> query_id""",
    "vector_upsert": "SELECT CASE WHEN vec_id % 3 = 0 THEN 99 ELSE label END AS label, count(*) AS n FROM embeddings GROUP BY 1",
}

_SIM = "list_dot_product(q.e, s.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(s.e, s.e)) + 1e-12)"
_ALL_TOP = f"""WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), j AS (SELECT q.vec_id AS query_id, s.vec_id AS record_id, {_SIM} AS sim FROM s q, s WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, record_id) AS INTEGER) AS rank FROM j) SELECT query_id, record_id, rank, round(sim, 5) AS similarity FROM r WHERE rank <= 10"""
_OWN_SERIES = f"""s AS (SELECT vec_id, embedding::DOUBLE[] AS e, 's' || vec_id % 3 AS symbol, CASE WHEN vec_id % 4 = 0 THEN '4h' ELSE '1h' END AS timeframe, CASE WHEN label < 4 THEN 'Good' WHEN label < 8 THEN 'Bad' ELSE 'Neutral' END AS label FROM embeddings),
    j AS (SELECT q.vec_id AS query_id, q.symbol, q.timeframe, s.vec_id AS record_id, s.label, {_SIM} AS sim FROM s q JOIN s USING (symbol, timeframe)),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, record_id) AS INTEGER) AS rank FROM j)"""
_TWO_EXCHANGES = f"""(WITH b AS (SELECT * FROM {H1} UNION ALL SELECT * FROM {H4}) SELECT 'first' AS exchange, * FROM b WHERE timeframe = '4h' OR symbol NOT IN ('click', 'view')
    UNION ALL SELECT 'second', * REPLACE (open * 3 + timestamp % 7 AS open, high * 3 + timestamp % 7 AS high, low * 3 + timestamp % 7 AS low, close * 3 + timestamp % 7 AS close) FROM b)"""
_LATER = lambda k: f"lead(close, {k}) OVER (PARTITION BY exchange, symbol ORDER BY timestamp)"

ORACLES |= {
    "vector_store_round_trip": """SELECT record_id, label, CAST(i - 1 AS INTEGER) AS place, e[i]::DOUBLE AS value FROM (SELECT vec_id AS record_id, CASE WHEN vec_id % 3 = 0 THEN 99 ELSE label END AS label,
        CASE WHEN vec_id % 3 = 0 THEN list_reverse(embedding) ELSE embedding END AS e, unnest(range(1, 65)) AS i FROM embeddings WHERE (vec_id % 2 = 0 OR vec_id % 3 = 0) AND vec_id % 10 <> 4)""",
    "vector_index_topk": _ALL_TOP,
    "neighbours_by_series": f"WITH {_OWN_SERIES} SELECT query_id, symbol, timeframe, record_id, rank, round(sim, 5) AS similarity FROM r WHERE rank <= 10",
    "similarity_policy": f"""WITH {_OWN_SERIES},
        w AS (SELECT query_id, sum(greatest(sim, 0)) AS a, sum(CASE WHEN label = 'Good' THEN greatest(sim, 0) ELSE 0 END) AS g, sum(CASE WHEN label = 'Bad' THEN greatest(sim, 0) ELSE 0 END) AS b FROM r WHERE rank <= 20 AND record_id < query_id GROUP BY query_id),
        p AS (SELECT vec_id AS event_id, coalesce(a, 0) > 0 AS has, CASE WHEN coalesce(a, 0) > 0 THEN g / (g + b + 1e-12) ELSE 0.5 END AS p_long FROM s LEFT JOIN w ON query_id = vec_id),
        z AS (SELECT *, CASE WHEN greatest(p_long, 1 - p_long) < 0.55 THEN 0 WHEN p_long >= 0.55 THEN 1 WHEN 1 - p_long >= 0.55 THEN -1 ELSE 0 END AS direction FROM p)
        SELECT event_id, round(p_long, 4) AS p_long, direction, round(CASE WHEN direction <> 0 THEN greatest(p_long, 1 - p_long) WHEN has THEN 2 * abs(p_long - 0.5) ELSE 0 END, 4) AS confidence FROM z""",
    "forward_returns_by_exchange": f"""WITH f AS (SELECT exchange, symbol, timestamp, {_LATER(1)} / close - 1 AS a, {_LATER(4)} / close - 1 AS b, {_LATER(24)} / close - 1 AS c FROM {_TWO_EXCHANGES} WHERE timeframe = '1h')
        SELECT e.exchange, e.symbol, e.timestamp + 1800000 AS timestamp, round(CASE WHEN c IS NOT NULL THEN a END, 6) AS fwd_1h, round(CASE WHEN c IS NOT NULL THEN b END, 6) AS fwd_4h, round(c, 6) AS fwd_24h
        FROM (SELECT * FROM {_TWO_EXCHANGES} WHERE timeframe = '4h') e ASOF LEFT JOIN f ON e.exchange = f.exchange AND e.symbol = f.symbol AND e.timestamp + 1800000 <= f.timestamp""",
    "candles_of_one_exchange": f"SELECT exchange, symbol, timeframe, timestamp, round(close, 6) AS close FROM {_TWO_EXCHANGES} WHERE exchange = CASE WHEN symbol IN ('click', 'view') THEN 'second' ELSE 'first' END",
}

_SIG = f"""(SELECT 'p-' || symbol AS policy, symbol, timestamp, pattern_type, p_long, CASE WHEN p_long > 1 OR p_long < 0 OR greatest(p_long, 1 - p_long) < 0.55 THEN 0 WHEN p_long >= 0.55 THEN 1 WHEN 1 - p_long >= 0.55 THEN -1 ELSE 0 END AS direction,
    greatest(p_long, 1 - p_long) AS confidence FROM (SELECT *, CASE WHEN direction = 'bullish' THEN 0.3 + confidence / 2 ELSE 0.7 - confidence / 2 END AS p_long FROM {_best(H4)} WHERE direction <> 'neutral'))"""
_TRADES = f"""(WITH bars AS MATERIALIZED (SELECT * FROM {_atr(H1)}),
    e AS (SELECT s.*, b.idx, b.n, b.open, b.close AS entry_close, b.atr FROM {_SIG} s ASOF JOIN bars b ON s.symbol = b.symbol AND s.timestamp <= b.timestamp WHERE s.direction <> 0 AND s.confidence >= 0.55),
    f AS (SELECT *, CASE WHEN atr / entry_close < 0.01 THEN 'low' WHEN atr / entry_close < 0.03 THEN 'mid' ELSE 'high' END AS regime FROM e WHERE idx < n - 2 AND atr > 0),
    g AS (SELECT *, CASE regime WHEN 'low' THEN 1.275 WHEN 'high' THEN 1.5 * 1.15 ELSE 1.5 END AS sm, CASE regime WHEN 'low' THEN 1.8 WHEN 'high' THEN 2.4 ELSE 2.0 END AS tm, open * (1 + direction * 0.0005) AS entry_eff FROM f),
    h AS (SELECT *, open - direction * sm * atr AS sl_raw, open + direction * tm * atr AS tp_raw FROM g),
    k AS (SELECT *, least(0.01 / (direction * (entry_eff - sl_raw)), 1 / entry_eff) AS qty, least(n - 1, idx + 3) AS exit_idx FROM h WHERE direction * (entry_eff - sl_raw) > 0),
    hit AS (SELECT k.symbol, k.timestamp, k.pattern_type, b.idx AS bar, b.timestamp AS bar_ts, b.close, CASE WHEN direction = 1 AND b.low <= sl_raw OR direction = -1 AND b.high >= sl_raw THEN 'stop_loss'
        WHEN direction = 1 AND b.high >= tp_raw OR direction = -1 AND b.low <= tp_raw THEN 'take_profit' END AS what FROM k JOIN bars b ON b.symbol = k.symbol AND b.idx BETWEEN k.idx AND k.exit_idx),
    x AS (SELECT symbol, timestamp, pattern_type, arg_min(what, bar) FILTER (WHERE what IS NOT NULL) AS what, max(bar_ts) AS exit_ts, arg_max(close, bar) AS last FROM hit GROUP BY ALL),
    y AS (SELECT k.*, x.exit_ts, coalesce(what, 'horizon') AS exit_reason, CASE what WHEN 'stop_loss' THEN sl_raw WHEN 'take_profit' THEN tp_raw ELSE last END AS exit_price FROM k JOIN x USING (symbol, timestamp, pattern_type)),
    z AS (SELECT *, exit_price * (1 - direction * 0.0005) AS exit_eff FROM y)
    SELECT *, open AS entry_price, qty * direction * (exit_eff - entry_eff) - qty * 0.001 * (abs(entry_eff) + abs(exit_eff)) AS share FROM z)"""
_STARTS = f"(SELECT policy, CAST(trunc(quantile_cont(timestamp, 0.5)) AS BIGINT) AS eval_start FROM {_SIG} GROUP BY policy)"
_TAKEN = f"""(WITH RECURSIVE t AS MATERIALIZED (SELECT policy, row_number() OVER (PARTITION BY policy ORDER BY timestamp, pattern_type, symbol, direction) AS k, timestamp, exit_ts, pattern_type, share, exit_reason
        FROM {_TRADES} JOIN {_STARTS} USING (policy) WHERE timestamp >= eval_start),
    fold(policy, k, last, equity, taken, took) AS (SELECT policy, 0::BIGINT, -1::BIGINT, 10000.0::DOUBLE, 0, false FROM (SELECT DISTINCT policy FROM t)
        UNION ALL SELECT f.policy, t.k, CASE WHEN go THEN t.exit_ts ELSE f.last END, CASE WHEN go THEN f.equity * (1 + t.share) ELSE f.equity END, f.taken + CASE WHEN go THEN 1 ELSE 0 END, go
        FROM fold f JOIN t ON t.policy = f.policy AND t.k = f.k + 1, LATERAL (SELECT t.timestamp >= f.last AND f.equity > 0 AS go))
    SELECT f.policy, CAST(f.taken - 1 AS INTEGER) AS number, t.timestamp, t.exit_ts, t.pattern_type, f.equity, f.equity * t.share / (1 + t.share) AS net_pnl, t.share FROM fold f JOIN t USING (policy, k) WHERE f.took)"""
_METRICS = f"""(WITH t AS MATERIALIZED (SELECT * FROM {_TAKEN}), st AS (SELECT DISTINCT policy FROM {_STARTS}),
    c AS (SELECT policy, 0 AS number, 10000.0 AS equity FROM st UNION ALL SELECT policy, number + 1, equity FROM t),
    dd AS (SELECT policy, (max(equity) OVER (PARTITION BY policy ORDER BY number) - equity) / greatest(max(equity) OVER (PARTITION BY policy ORDER BY number), 1e-12) AS d, number, equity FROM c),
    w AS (SELECT policy, max(d) AS mdd, arg_max(equity, number) / 10000.0 - 1 AS net FROM dd GROUP BY policy),
    m AS (SELECT policy, count(*) AS n, avg(share) / stddev_samp(share) AS sharpe, avg(share) / stddev_samp(share) FILTER (WHERE share < 0) AS sortino, avg(CASE WHEN net_pnl > 0 THEN 1.0 ELSE 0 END) AS win_rate,
        avg(net_pnl) FILTER (WHERE net_pnl > 0) AS avg_win, avg(net_pnl) FILTER (WHERE net_pnl < 0) AS avg_loss, avg(net_pnl) AS expectancy,
        sum(net_pnl) FILTER (WHERE net_pnl > 0) / -sum(net_pnl) FILTER (WHERE net_pnl < 0) AS profit_factor FROM t GROUP BY policy)
    SELECT policy, coalesce(CASE WHEN n > 0 THEN net END, 0) AS net_return, coalesce(CASE WHEN n > 0 THEN mdd END, 0) AS max_drawdown, coalesce(sharpe, 0) AS sharpe, coalesce(sortino, 0) AS sortino,
        coalesce(CASE WHEN n > 0 AND mdd > 0 THEN net / mdd END, 0) AS calmar, coalesce(win_rate, 0) AS win_rate, coalesce(avg_win, 0) AS avg_win, coalesce(avg_loss, 0) AS avg_loss, coalesce(expectancy, 0) AS expectancy,
        coalesce(profit_factor, 0) AS profit_factor, coalesce(n, 0) AS trade_count FROM w LEFT JOIN m USING (policy))"""
_NAMES = ("net_return", "max_drawdown", "sharpe", "sortino", "calmar", "win_rate", "avg_win", "avg_loss", "expectancy", "profit_factor")

ORACLES |= {
    "signal_thresholds": f"SELECT symbol, timestamp, pattern_type, round(p_long, 6) AS p_long, direction FROM {_SIG}",
    "backtest_trades": f"SELECT policy, timestamp, pattern_type, direction, exit_ts, exit_reason, regime, {_R(6, 'entry_price', 'exit_price', 'sl_raw', 'tp_raw', 'share')} FROM {_TRADES}",
    "evaluation_start": f"SELECT * FROM {_STARTS}",
    "backtest_portfolio": f"SELECT policy, number, timestamp, exit_ts, pattern_type, {_R(4, 'equity', 'net_pnl')} FROM {_TAKEN}",
    "backtest_metrics": f"SELECT policy, {_R(4, *_NAMES)}, trade_count FROM {_METRICS}",
    "rank_policies": f"SELECT policy, row_number() OVER (ORDER BY sharpe DESC, net_return DESC, policy) AS place, trade_count FROM {_METRICS}",
    "promotion_gate": f"SELECT policy, policy = 'p-view' OR (policy <> 'p-click' AND trade_count >= 5) AS promote FROM {_METRICS}",
    "neighbour_policy": """WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS e, CASE WHEN label < 4 THEN 'Good' WHEN label < 8 THEN 'Bad' ELSE 'Neutral' END AS label FROM embeddings),
        j AS (SELECT q.vec_id AS event_id, s.vec_id AS ts, s.label, list_dot_product(q.e, s.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(s.e, s.e)) + 1e-12) AS sim FROM s q, s WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY sim DESC, ts) AS rank FROM j),
        w AS (SELECT event_id, sum(greatest(sim, 0)) AS a, sum(CASE WHEN label = 'Good' THEN greatest(sim, 0) ELSE 0 END) AS g, sum(CASE WHEN label = 'Bad' THEN greatest(sim, 0) ELSE 0 END) AS b FROM r WHERE rank <= 20 AND ts < event_id GROUP BY event_id),
        p AS (SELECT i.vec_id AS event_id, coalesce(a, 0) > 0 AS has, CASE WHEN coalesce(a, 0) > 0 THEN g / (g + b + 1e-12) ELSE 0.5 END AS p_long FROM (SELECT vec_id FROM s WHERE vec_id % 100 = 0) i LEFT JOIN w ON w.event_id = i.vec_id),
        z AS (SELECT *, CASE WHEN greatest(p_long, 1 - p_long) < 0.55 THEN 0 WHEN p_long >= 0.55 THEN 1 WHEN 1 - p_long >= 0.55 THEN -1 ELSE 0 END AS direction FROM p)
        SELECT event_id, round(p_long, 4) AS p_long, direction, round(CASE WHEN direction <> 0 THEN greatest(p_long, 1 - p_long) WHEN has THEN 2 * abs(p_long - 0.5) ELSE 0 END, 4) AS confidence FROM z""",
    "balanced_cap": f"""WITH k AS (SELECT *, count(*) OVER () AS total, row_number() OVER (PARTITION BY label ORDER BY timestamp DESC, pattern_type DESC, symbol DESC) AS r FROM {LABELLED} WHERE label IN ('Good', 'Bad'))
        SELECT symbol, timestamp, pattern_type, label, CASE label WHEN 'Good' THEN 1 ELSE 0 END AS y_dir FROM k WHERE total <= 60 OR r <= 30""",
    "sequence_windows": f"""WITH k AS (SELECT *, row_number() OVER w AS r, sum(label_score) OVER (PARTITION BY symbol, timeframe ORDER BY timestamp, pattern_type ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS s FROM {LABELLED} WHERE label <> 'Neutral'
        WINDOW w AS (PARTITION BY symbol, timeframe ORDER BY timestamp, pattern_type)) SELECT symbol, timestamp AS ts_end, pattern_type, 6 AS length, round(s, 5) AS total FROM k WHERE r >= 6 AND (r - 6) % 2 = 0""",
    "time_split": f"""WITH k AS MATERIALIZED (SELECT * FROM {LABELLED}), v AS (SELECT list(timestamp ORDER BY timestamp)[CAST(least(greatest(floor(count(*) * 0.8), 1), count(*) - 1) AS BIGINT) + 1] AS v0 FROM k)
        SELECT CASE WHEN timestamp >= v0 THEN 'val' WHEN timestamp <= v0 - 86400000 THEN 'train' ELSE 'none' END AS split, count(*) AS n, min(timestamp) AS first, max(timestamp) AS last FROM k, v GROUP BY 1""",
    "classification_scores": f"""WITH k AS MATERIALIZED (SELECT CASE WHEN fwd_1h > 0 THEN 1 ELSE 0 END AS y, round(label_score, 6) AS p FROM {LABELLED} WHERE fwd_1h IS NOT NULL),
        u AS (SELECT sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) AS wins FROM k a, k b WHERE a.y = 1 AND b.y = 0)
        SELECT count(*) AS n, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0 END), 6) AS accuracy, round(any_value(wins) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM k, u""",
    "regression_scores": f"SELECT count(*) AS n, round(avg(abs(fwd_4h - fwd_1h)), 4) AS mae, round(1 - sum((fwd_4h - fwd_1h) ** 2) / (var_pop(fwd_4h) * count(*)), 4) AS r2 FROM {LABELLED} WHERE fwd_4h IS NOT NULL",
    "standardised": f"SELECT symbol, timestamp, round((close - avg(close) OVER ()) / stddev_pop(close) OVER (), 4) AS close, round((volume - avg(volume) OVER ()) / stddev_pop(volume) OVER (), 4) AS volume FROM {H4}",
    "training_table": f"SELECT symbol, timestamp, pattern_type, CASE label WHEN 'Good' THEN 1 ELSE 0 END AS y_dir, round(fwd_4h, 6) AS y_return FROM {LABELLED} WHERE label <> 'Neutral' AND fwd_4h IS NOT NULL",
    "scalar_functions": f"""SELECT symbol || '/USDT' AS symbol, timestamp, CAST(14400000 AS BIGINT) AS ms, strftime(make_timestamp(timestamp * 1000), '%Y-%m-%dT%H:%M:%SZ') AS iso, symbol || '_USDT' AS file, symbol || '/USDT|4h|' || timestamp AS record_id,
        CASE WHEN CAST(volume AS BIGINT) % 2 = 0 THEN volume / 2 ELSE 2 * floor((volume + 1) / 4) END AS half, symbol || '/USDT' AS from_json FROM {H4}""",
    "ohlcv_decode": f"SELECT timestamp, {_R(6, 'open', 'high', 'low', 'close', 'volume')} FROM {H4}",
}

_P = "(i * (len({v}) - 1) / 31.0)"
_RESAMPLE = f"CASE WHEN len({{v}}) = 32 THEN {{v}} ELSE [{{v}}[CAST(floor({_P}) AS INTEGER) + 1] + ({_P} - floor({_P})) * ({{v}}[least(CAST(floor({_P}) AS INTEGER) + 2, len({{v}}))] - {{v}}[CAST(floor({_P}) AS INTEGER) + 1]) for i in range(0, 32)] END"
_DTW = """list_reduce(list_prepend(list_prepend(0.0::DOUBLE, list_resize([]::DOUBLE[], 32, 'inf'::DOUBLE)), list_transform(w, lambda x: [x])),
    lambda prev, e: list_reduce(list_prepend(['inf'::DOUBLE], list_transform(range(1, 33), lambda j: [CAST(j AS DOUBLE)])),
    lambda r, j: list_append(r, abs(e[1] - {u}[CAST(j[1] AS INTEGER)]) + least(prev[CAST(j[1] AS INTEGER)], prev[CAST(j[1] AS INTEGER) + 1], r[len(r)]))))[33]"""
_VALLEY = "[pow(i / 31.0 - 0.5, 2) / (0.25 + 1e-12) for i in range(0, 32)]"
_CURVE = f"""(WITH s AS (SELECT symbol, timestamp, list(close) OVER ({_W} ROWS BETWEEN 24 PRECEDING AND 24 FOLLOWING) AS seg FROM {H4}),
    n AS (SELECT symbol, timestamp, [x / seg[1] for x in seg] AS a, [x / seg[greatest(len(seg) - 47, 1)] for x in seg[greatest(len(seg) - 47, 1) : len(seg)]] AS b FROM s),
    r AS (SELECT symbol, timestamp, {_RESAMPLE.format(v="a")} AS w, {_RESAMPLE.format(v="b")} AS g, {_VALLEY} AS u, [1 / (x + 1e-12) for x in {_VALLEY}] AS v FROM n)
    SELECT symbol, timestamp, list_sum([abs(g[i + 2] - 2 * g[i + 1] + g[i]) for i in range(1, 31)]) / 30 AS curvature_mean, (g[32] - g[1]) / 31 AS slope_mean,
        {_DTW.format(u="u")} AS shape_dtw_to_u, {_DTW.format(u="v")} AS shape_dtw_to_invu FROM r)"""
ORACLES["curve_geometry"] = f"SELECT symbol, timestamp, {_R(5, 'curvature_mean', 'slope_mean', 'shape_dtw_to_u', 'shape_dtw_to_invu')} FROM {_CURVE}"
_CONTEXT = ORACLES["event_context"].partition("SELECT symbol, timestamp, round")[0] + "SELECT symbol, timestamp, atr_pct, vol_z, CASE WHEN atr_pct < 0.01 THEN 0.0 WHEN atr_pct < 0.03 THEN 0.5 ELSE 1.0 END AS level FROM p"
#: The vector, place by place: hash places, the geometry numbers in their order, volatility, the detector's numbers by name, zeros.
ORACLES["pattern_embedding"] = f"""WITH hash AS ({ORACLES["pattern_hash"]}),
    j AS (SELECT b.symbol, b.timestamp, b.pattern_type, list_concat([if(list_contains([h0, h1, h2, h3, h4, h5], i), 1, 0)::DOUBLE for i in range(0, 24)], [b.confidence, 0, curvature_mean, slope_mean, shape_dtw_to_u, shape_dtw_to_invu, 0, 0, atr_pct, level],
            list_resize([z[2]::DOUBLE for z in list_sort([[x.key, x.value::VARCHAR] for x in map_entries(b.features)])], 10, 0::DOUBLE), list_resize([]::DOUBLE[], 20, 0::DOUBLE)) AS v
        FROM {_best(H4)} b JOIN {_CURVE} c USING (symbol, timestamp) JOIN ({_CONTEXT}) x USING (symbol, timestamp) JOIN hash USING (pattern_type)),
    e AS (SELECT symbol, timestamp, pattern_type, v, sqrt(list_dot_product(v, v)) AS size, unnest(range(1, 65)) AS i FROM j)
    SELECT symbol, timestamp, pattern_type, CAST(i - 1 AS INTEGER) AS place, round(v[i] / size, 5) AS value FROM e"""
ORACLES["candlestick_features"] = f"""SELECT symbol, timeframe, timestamp, pattern_type, direction, x.key AS feature, CASE WHEN x.value < 1e6 THEN round(x.value, 6) END AS value, round(log10(1 + x.value), 6) AS magnitude
    FROM (SELECT *, unnest(map_entries(features)) AS x FROM (SELECT * FROM {_patterns(DAILY)} UNION ALL SELECT * FROM {_patterns(H4)}))"""

ORACLES["environment_episode"] = f"""WITH RECURSIVE b AS MATERIALIZED (SELECT symbol, CAST(idx AS INTEGER) AS idx, high, low, close, atr, CASE idx % 7 WHEN 0 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS action FROM {_atr(H1)} WHERE idx >= 40),
    f(symbol, idx, cash, qty, sl, tp, equity, before) AS (SELECT DISTINCT symbol, 39, 10000.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 10000.0::DOUBLE, 10000.0::DOUBLE FROM b
    UNION ALL SELECT b.symbol, b.idx, t.cash, t.qty, t.sl, t.tp, t.cash + t.qty * b.close, f.equity FROM f JOIN b ON b.symbol = f.symbol AND b.idx = f.idx + 1,
        LATERAL (SELECT CASE WHEN f.qty > 0 THEN CASE WHEN b.low <= f.sl THEN f.sl WHEN b.high >= f.tp THEN f.tp END END AS hit) h,
        LATERAL (SELECT CASE WHEN hit IS NULL THEN f.cash ELSE f.cash + f.qty * hit * 0.9995 * 0.999 END AS c1, CASE WHEN hit IS NULL THEN f.qty ELSE 0 END AS q1, b.close * 1.0005 AS entry) k,
        LATERAL (SELECT least(c1 * 0.01 / (1.5 * b.atr), c1 / entry) AS size) z,
        LATERAL (SELECT q1 = 0 AND b.action = 1 AND b.atr > 0 AND size > 0 AND size * entry * 1.001 <= c1 AS enters, q1 > 0 AND hit IS NULL AND b.action = 2 AS leaves) d,
        LATERAL (SELECT CASE WHEN enters THEN c1 - size * entry * 1.001 WHEN leaves THEN c1 + q1 * b.close * 0.9995 * 0.999 ELSE c1 END AS cash, CASE WHEN enters THEN size WHEN leaves THEN 0 ELSE q1 END AS qty,
            CASE WHEN enters THEN entry - 1.5 * b.atr ELSE f.sl END AS sl, CASE WHEN enters THEN entry + 2.0 * b.atr ELSE f.tp END AS tp) t
    WHERE f.equity > 9000)
    SELECT symbol, idx, round(equity, 4) AS equity, round(cash, 4) AS cash, qty > 0 AS held, round((equity - before) / 10000.0, 4) AS reward FROM f WHERE idx >= 40"""


def _side(name: str, price: str) -> str:
    """Peaks of a price in the pivot rows: local maxima, thinned from the highest down, then by prominence."""
    return f"""{name}_top AS (SELECT symbol, idx, {price} AS p FROM s QUALIFY {price} > lag({price}) OVER (PARTITION BY symbol ORDER BY idx) AND {price} > lead({price}) OVER (PARTITION BY symbol ORDER BY idx)),
    {name}_kept AS (SELECT symbol, unnest(list_reduce(list_prepend([]::BIGINT[], list([idx] ORDER BY p DESC, idx DESC)), lambda acc, q: CASE WHEN len(list_filter(acc, lambda k: abs(k - q[1]) < 10)) = 0 THEN list_append(acc, q[1]) ELSE acc END)) AS idx
        FROM {name}_top GROUP BY symbol),
    {name}_edge AS (SELECT t.symbol, t.idx, t.p, coalesce((SELECT max(b.idx) FROM s b WHERE b.symbol = t.symbol AND b.idx < t.idx AND b.{price} > t.p), -1) AS l, coalesce((SELECT min(b.idx) FROM s b WHERE b.symbol = t.symbol AND b.idx > t.idx AND b.{price} > t.p), 1000000000) AS r
        FROM {name}_top t JOIN {name}_kept USING (symbol, idx)),
    {name}_all AS (SELECT e.symbol, e.idx, any_value(e.p) AS p FROM {name}_edge e JOIN s b ON b.symbol = e.symbol AND b.idx > e.l AND b.idx < e.r
        GROUP BY e.symbol, e.idx HAVING any_value(e.p) - greatest(min(b.{price}) FILTER (WHERE b.idx <= e.idx), min(b.{price}) FILTER (WHERE b.idx >= e.idx)) >= greatest(1e-12, 0.15 * any_value(b.atr)))"""


PIVOTS = f"""(WITH t AS (SELECT * FROM {_tr(DAILY)}), a AS (SELECT symbol, avg(tr) AS atr FROM t WHERE idx >= n - 14 GROUP BY symbol),
    s AS MATERIALIZED (SELECT t.symbol, t.idx, high, -low AS neg, atr FROM t JOIN a USING (symbol) WHERE n BETWEEN 200 AND 5000), {_side("hi", "high")}, {_side("lo", "neg")},
    c1 AS (SELECT symbol, CASE WHEN count(*) > 30 THEN list_sort(list(idx))[-30] ELSE -1 END AS k FROM hi_all GROUP BY symbol),
    h1 AS (SELECT h.* FROM hi_all h JOIN c1 USING (symbol) WHERE idx >= k), l1 AS (SELECT l.* FROM lo_all l LEFT JOIN c1 USING (symbol) WHERE idx >= coalesce(k, -1)),
    c2 AS (SELECT symbol, CASE WHEN count(*) > 30 THEN list_sort(list(idx))[-30] ELSE -1 END AS k FROM l1 GROUP BY symbol)
    SELECT h1.symbol, 'hi' AS side, idx, p AS price FROM h1 LEFT JOIN c2 USING (symbol) WHERE idx >= coalesce(k, -1) UNION ALL SELECT symbol, 'lo', idx, -p FROM l1 JOIN c2 USING (symbol) WHERE idx >= k)"""
ORACLES["chart_pivots"] = f"SELECT symbol, side, CAST(idx AS INTEGER) AS idx, round(price, 6) AS price FROM {PIVOTS}"


_D2 = "lead(close) OVER w2 - 2 * close + lag(close) OVER w2 AS d2"
_W2 = f"WINDOW w2 AS ({_W})"


def _curve_of(symbol: str, first: str, stop: str) -> str:
    """Mean step, and mean second difference, of the closes of a range over the first of them."""
    at = lambda i: f"(SELECT r.close FROM t r WHERE r.symbol = {symbol} AND r.idx = {i})"
    bent = f"(SELECT avg(abs(r.d2)) FROM t r WHERE r.symbol = {symbol} AND r.idx > {first} AND r.idx < {stop})"
    return f"CASE WHEN {stop} - {first} < 2 THEN 0 ELSE ({at(stop)} / {at(first)} - 1) / ({stop} - {first}) END AS slope_mean, CASE WHEN {stop} - {first} < 2 THEN 0 ELSE {bent} / {at(first)} END AS curvature_mean"


def _swings(side: str) -> str:
    top = side == "hi"
    other, best, raw, line, cmp, off = ("lo", "max", "min", "low", "<", "-") if top else ("hi", "min", "max", "high", ">", "+")
    most, names, way = ("greatest", ("DoubleTop", "TripleTop", "HeadAndShoulders"), "bearish") if top else ("least", ("DoubleBottom", "TripleBottom", "InverseHeadAndShoulders"), "bullish")
    neck = lambda a, b: f"coalesce((SELECT {best}(o.price) FROM pv o WHERE o.symbol = x.symbol AND o.side = '{other}' AND o.idx > {a} AND o.idx < {b}), (SELECT {raw}(r.{line}) FROM t r WHERE r.symbol = x.symbol AND r.idx BETWEEN {a} AND {b}))"
    clip = lambda v: f"least(greatest({v}, 0), 1)"
    head = "b.price >= greatest(a.price, d.price) + 0.05 * m.atr" if top else "b.price <= least(a.price, d.price) - 0.05 * m.atr"
    return f"""SELECT y.symbol, q.timestamp, y.pattern_type, '{way}' AS direction, y.conf * least(greatest(0.02 * y.atr / (y.atr + 1e-12), 0), 1) AS confidence, y.neck AS neckline, {_curve_of("y.symbol", "y.first", "least(y.last + 10, q.n - 1)")} FROM (
        SELECT x.symbol, '{names[0]}' AS pattern_type, x.ai AS first, x.bi AS last, {clip("1 - x.tol / 0.05")} AS conf, {neck("x.ai", "x.bi")} AS neck, x.atr
            FROM (SELECT a.symbol, a.idx AS ai, b.idx AS bi, abs(a.price - b.price) / (abs(a.price) + 1e-12) AS tol, m.atr FROM pv a JOIN pv b ON a.symbol = b.symbol AND a.side = '{side}' AND b.side = '{side}' AND b.idx - a.idx >= 10 JOIN m ON m.symbol = a.symbol) x WHERE x.tol <= 0.03
        UNION ALL SELECT x.symbol, '{names[1]}', x.ai, x.di, {clip("1 - x.tol / 0.06")} * 0.6 + (1 - least(abs((x.bi - x.ai) - (x.di - x.bi)) / (greatest(x.bi - x.ai, x.di - x.bi) + 1e-12), 1)) * 0.4, {most}({neck("x.ai", "x.bi")}, {neck("x.bi", "x.di")}), x.atr
            FROM (SELECT a.symbol, a.idx AS ai, b.idx AS bi, d.idx AS di, (a.price + b.price + d.price) / 3 AS mean, greatest(abs(a.price - mean), abs(b.price - mean), abs(d.price - mean)) / (abs(mean) + 1e-12) AS tol, m.atr
                FROM pv a JOIN pv b ON a.symbol = b.symbol AND a.side = '{side}' AND b.side = '{side}' AND b.idx - a.idx >= 10 JOIN pv d ON d.symbol = b.symbol AND d.side = '{side}' AND d.idx - b.idx >= 10 JOIN m ON m.symbol = a.symbol) x WHERE x.tol <= 0.04
        UNION ALL SELECT x.symbol, '{names[2]}', x.ai, x.di, {clip("1 - x.tol / 0.08")} * 0.6 + (1 - least(x.tol / 0.08, 1)) * 0.4, {most}({neck("x.ai", "x.bi")}, {neck("x.bi", "x.di")}), x.atr
            FROM (SELECT a.symbol, a.idx AS ai, b.idx AS bi, d.idx AS di, abs(a.price - d.price) / (abs((a.price + d.price) / 2) + 1e-12) AS tol, m.atr
                FROM nb a JOIN nb b ON a.symbol = b.symbol AND a.side = '{side}' AND b.side = '{side}' AND b.k = a.k + 1 JOIN nb d ON d.symbol = a.symbol AND d.side = '{side}' AND d.k = a.k + 2 JOIN m ON m.symbol = a.symbol WHERE {head}) x WHERE x.tol <= 0.04
        ) y JOIN t q ON q.symbol = y.symbol AND q.idx = y.last + 1 WHERE q.close {cmp} y.neck {off} 0.02 * y.atr"""


_CHART = f"""WITH pv AS MATERIALIZED (SELECT * FROM {PIVOTS}), t AS MATERIALIZED (SELECT *, {_D2} FROM {_tr(DAILY)} {_W2}), m AS (SELECT symbol, avg(tr) AS atr FROM t WHERE idx >= n - 14 GROUP BY symbol),
    nb AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY idx) AS k FROM pv)"""
ORACLES["chart_swings"] = f"{_CHART} SELECT symbol, timestamp, pattern_type, direction, {_R(6, 'confidence', 'neckline')}, {_R(8, 'slope_mean', 'curvature_mean')} FROM ({_swings('hi')} UNION ALL {_swings('lo')})"
_TWO = lambda side, j: f"(SELECT symbol, idx, price FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY idx DESC) AS j FROM pv WHERE side = '{side}') WHERE j = {j})"
ORACLES["chart_last_pivots"] = f"""{_CHART},
    z AS (SELECT m.symbol, m.atr * 0.01 AS g, (h1.price - h2.price) / (h1.idx - h2.idx) AS sh, (l1.price - l2.price) / (l1.idx - l2.idx) AS sl, greatest(h1.price, h2.price) AS ph, least(l1.price, l2.price) AS pl, greatest(h1.idx, l1.idx) + 1 AS k, least(h2.idx, l2.idx) AS i0
        FROM m JOIN {_TWO('hi', 1)} h1 USING (symbol) JOIN {_TWO('hi', 2)} h2 USING (symbol) JOIN {_TWO('lo', 1)} l1 USING (symbol) JOIN {_TWO('lo', 2)} l2 USING (symbol)),
    w AS (SELECT z.*, q.timestamp, q.close, e.timestamp AS end_ts, e.close AS end_close FROM z JOIN t q ON q.symbol = z.symbol AND q.idx = least(z.k, q.n - 1) JOIN t e ON e.symbol = z.symbol AND e.idx = e.n - 1),
    u AS (SELECT *, close > ph + g AS up, close < pl - g AS down FROM w),
    v AS (SELECT u.*, {_curve_of("u.symbol", "u.i0", "u.k1")} FROM (SELECT u.*, least(u.k, (SELECT max(r.n) - 1 FROM t r WHERE r.symbol = u.symbol)) AS k1 FROM u) u),
    e AS (SELECT u.*, {_curve_of("u.symbol", "u.i0", "u.k2")} FROM (SELECT u.*, (SELECT max(r.n) - 1 FROM t r WHERE r.symbol = u.symbol) AS k2 FROM u) u),
    every AS (SELECT symbol, timestamp, 'AscendingTriangle' AS pattern_type, 'bullish' AS direction, 0.7::DOUBLE AS confidence, slope_mean, curvature_mean FROM v WHERE abs(sh) < 0.0005 AND sl > 0 AND up
    UNION ALL SELECT symbol, timestamp, 'DescendingTriangle', 'bearish', 0.7, slope_mean, curvature_mean FROM v WHERE sh < 0 AND abs(sl) < 0.0005 AND down
    UNION ALL SELECT symbol, timestamp, 'SymmetricalTriangle', CASE WHEN up THEN 'bullish' ELSE 'bearish' END, 0.6, slope_mean, curvature_mean FROM v WHERE sh < 0 AND sl > 0 AND (up OR down)
    UNION ALL SELECT symbol, timestamp, 'BroadeningFormation', CASE WHEN up THEN 'bullish' ELSE 'bearish' END, 0.5, slope_mean, curvature_mean FROM v WHERE sh > 0 AND sl < 0 AND (up OR down)
    UNION ALL SELECT symbol, timestamp, 'RisingWedge', 'bearish', 0.6, slope_mean, curvature_mean FROM v WHERE sh > 0 AND sh < sl AND down
    UNION ALL SELECT symbol, timestamp, 'FallingWedge', 'bullish', 0.6, slope_mean, curvature_mean FROM v WHERE sh < 0 AND sl < sh AND up
    UNION ALL SELECT symbol, end_ts, 'Channels', 'bullish', 0.45, slope_mean, curvature_mean FROM e WHERE abs(sh - sl) <= 0.0008 AND end_close > ph + g
    UNION ALL SELECT symbol, end_ts, 'Channels', 'bearish', 0.45, slope_mean, curvature_mean FROM e WHERE abs(sh - sl) <= 0.0008 AND end_close < pl - g)
    SELECT symbol, timestamp, pattern_type, direction, confidence, {_R(8, 'slope_mean', 'curvature_mean')} FROM every"""


def _fit(n: int, low: int, high: int) -> str:
    """Quadratic coefficient over the rows with back in [low, high], by orthogonal polynomials on 0 .. n - 1, for x scaled to [0, 1]."""
    x = f"({high} - back)"
    q = f"(({x} - {(n - 1) / 2}) ** 2 - {(n * n - 1) / 12})"
    return f"sum(close * {q}) FILTER (WHERE back BETWEEN {low} AND {high}) / sum({q} ** 2) FILTER (WHERE back BETWEEN {low} AND {high}) * {(n - 1) ** 2}"


_BACK = f"(SELECT *, n - 1 - idx AS back, {_D2} FROM (SELECT * FROM {_tr(DAILY)} UNION ALL SELECT * FROM {_tr(H1)}) WHERE n BETWEEN 200 AND 5000 {_W2})"
_CURVES = ", ".join(f"any_value(close) FILTER (WHERE back = {k - 1}) AS f{k}, avg(abs(d2)) FILTER (WHERE back BETWEEN 1 AND {k - 2}) AS b{k}" for k in (25, 30, 60, 100, 120, 160))
_LAST = lambda k: f"(last / f{k} - 1) / {k - 1} AS slope_mean, b{k} / f{k} AS curvature_mean"
_EXT = ", ".join(f"max(high) FILTER (WHERE back < {k}) AS h{k}, min(low) FILTER (WHERE back < {k}) AS l{k}" for k in (25, 30, 60, 100))
ORACLES["chart_last_candles"] = f"""WITH z AS (SELECT symbol, max(timestamp) AS timestamp, avg(tr) FILTER (WHERE back < 14) * 0.01 AS m, arg_min(open, back) AS open, arg_min(high, back) AS high, arg_min(low, back) AS low, arg_min(close, back) AS last, {_EXT},
        arg_min(close, back) / any_value(close) FILTER (WHERE back = 79) - 1 AS impulse, regr_slope(close, idx) FILTER (WHERE back < 30) AS drift, stddev_samp(close) FILTER (WHERE back < 30) / (stddev_samp(close) FILTER (WHERE back BETWEEN 30 AND 59) + 1e-12) AS squeeze,
        {_fit(120, 0, 119)} AS q120, {_fit(104, 56, 159)} AS q104, 119 - arg_min(back, row(close, -back)) FILTER (WHERE back < 120) AS low_at, 119 - arg_max(back, row(close, back)) FILTER (WHERE back < 120) AS high_at,
        min(close) FILTER (WHERE back < 56) AS handle_low, min(close) FILTER (WHERE back BETWEEN 56 AND 159) AS cup_low, max(close) FILTER (WHERE back BETWEEN 56 AND 159) AS rim, {_CURVES} FROM {_BACK} GROUP BY symbol, timeframe)
    , s AS (SELECT *, (h30 - l30) / last < 0.02 AS tight, (h60 - l60) / last <= 0.04 AS flat FROM z),
    every AS (SELECT symbol, timestamp, 'BullFlag' AS pattern_type, 'bullish' AS direction, 0.55::DOUBLE AS confidence, drift AS slope_mean, 0::DOUBLE AS curvature_mean FROM s WHERE impulse > 0.03 AND tight AND drift < 0 AND last > h30 + m
    UNION ALL SELECT symbol, timestamp, 'BearFlag', 'bearish', 0.55, drift, 0 FROM s WHERE impulse < -0.03 AND tight AND drift > 0 AND last < l30 - m
    UNION ALL SELECT symbol, timestamp, 'BullPennant', 'bullish', 0.5, 0, 0 FROM s WHERE impulse > 0.03 AND tight AND squeeze < 0.8 AND last > h30 + m
    UNION ALL SELECT symbol, timestamp, 'BearPennant', 'bearish', 0.5, 0, 0 FROM s WHERE impulse < -0.03 AND tight AND squeeze < 0.8 AND last < l30 - m
    UNION ALL SELECT symbol, timestamp, 'RectangleRange', 'bullish', 0.5, {_LAST(60)} FROM s WHERE flat AND last > h60 + m
    UNION ALL SELECT symbol, timestamp, 'RectangleRange', 'bearish', 0.5, {_LAST(60)} FROM s WHERE flat AND last < l60 - m
    UNION ALL SELECT symbol, timestamp, 'SwingFailureBullish', 'bullish', 0.6, {_LAST(30)} FROM s WHERE low < l30 - m AND last > l30 + m AND last > open
    UNION ALL SELECT symbol, timestamp, 'SwingFailureBearish', 'bearish', 0.6, {_LAST(30)} FROM s WHERE high > h30 + m AND last < h30 - m AND last < open
    UNION ALL SELECT symbol, timestamp, 'LiquiditySweepLow', 'bullish', 0.55, {_LAST(25)} FROM s WHERE low < l25 - m AND last > l25
    UNION ALL SELECT symbol, timestamp, 'LiquiditySweepHigh', 'bearish', 0.55, {_LAST(25)} FROM s WHERE high > h25 + m AND last < h25
    UNION ALL SELECT symbol, timestamp, 'RoundedBottom', 'bullish', 0.35, {_LAST(120)} FROM s WHERE q120 > 0 AND low_at > 30 AND low_at < 90
    UNION ALL SELECT symbol, timestamp, 'RoundedTop', 'bearish', 0.35, {_LAST(120)} FROM s WHERE q120 < 0 AND high_at > 30 AND high_at < 90
    UNION ALL SELECT symbol, timestamp, 'CupAndHandle', 'bullish', 0.4, {_LAST(160)} FROM s WHERE q104 > 0 AND handle_low >= cup_low - 3 * m AND last > rim + m)
    SELECT symbol, timestamp, pattern_type, direction, confidence, {_R(8, 'slope_mean', 'curvature_mean')} FROM every"""
_CALM = f"(SELECT symbol, timeframe, timestamp, {', '.join(f'{c} / 2000 + 100 + timestamp % 2592000000 / 720000000 AS {c}' for c in ('open', 'high', 'low', 'close'))}, volume FROM {H1})"
ORACLES["chart_retests"] = f"""WITH b AS MATERIALIZED (SELECT *, n - 1 - idx AS back, {_D2} FROM {_tr(_CALM)} WHERE n >= 200 {_W2}),
    z AS (SELECT symbol, avg(tr) FILTER (WHERE back < 14) * 0.01 AS m, max(high) FILTER (WHERE back BETWEEN 30 AND 79) AS u, min(low) FILTER (WHERE back BETWEEN 30 AND 79) AS d, any_value(close) FILTER (WHERE back = 30) AS c0,
        any_value(close) FILTER (WHERE back = 0) / any_value(close) FILTER (WHERE back = 79) AS grown, avg(abs(d2)) FILTER (WHERE back BETWEEN 1 AND 78) / any_value(close) FILTER (WHERE back = 79) AS bent FROM b GROUP BY symbol)
    SELECT b.symbol, b.timestamp, 'BreakoutRetest' AS pattern_type, CASE WHEN b.close > u + m THEN 'bullish' ELSE 'bearish' END AS direction, 0.55::DOUBLE AS confidence, round((grown - 1) / 79, 8) AS slope_mean, round(bent, 8) AS curvature_mean FROM b JOIN z USING (symbol)
    WHERE back BETWEEN 1 AND 29 AND (u - d) / (c0 + 1e-12) <= 0.06 AND (b.close > u + m AND EXISTS (SELECT 1 FROM b r WHERE r.symbol = b.symbol AND r.idx BETWEEN b.idx + 1 AND b.idx + 10 AND r.low <= u + m AND r.close > u - m)
        OR b.close < d - m AND EXISTS (SELECT 1 FROM b r WHERE r.symbol = b.symbol AND r.idx BETWEEN b.idx + 1 AND b.idx + 10 AND r.high >= d - m AND r.close < d + m))"""

_PLANTED = lambda curves: f"({planted(blocks('lineitem'), curves)})"
ORACLES["chart_planted_pivots"] = ORACLES["chart_last_pivots"].replace(DAILY, _PLANTED(False))
ORACLES["chart_planted_candles"] = ORACLES["chart_last_candles"].replace(DAILY, _PLANTED(True)).replace(f"UNION ALL SELECT * FROM {_tr(H1)}", "")
