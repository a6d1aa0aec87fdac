"""Fee- and slippage-aware backtests of signals, their metrics, and the ranking of policies.

A trade's size is proportional to equity, so its profit as a share of equity doesn't depend on it: all trades are worked out set-wise, and
only the choice of trades that don't overlap and the compounding are folded in the order of time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candlewick.operators import slices
from candlewick.operators.indicators import regime, with_atr
from candlewick.operators.labeling import next_at_or_after, series_key
from candlewick.session import written

METRICS = ["net_return", "max_drawdown", "sharpe", "sortino", "calmar", "win_rate", "avg_win", "avg_loss", "expectancy", "profit_factor", "trade_count"]


@dataclass(frozen=True)
class BacktestConfig:
    initial_equity: float = 10_000.0
    risk: float = 0.01
    max_risk: float = 0.02
    fee: float = 0.001
    slippage: float = 0.0005
    sl: float = 1.5
    tp: float = 2.0
    min_confidence: float = 0.55
    p_long: float = 0.55
    p_short: float = 0.55
    eval_fraction: float = 0.95
    horizon_steps: int = 3
    max_trades: int | None = None


def direction(p: Column, cfg: BacktestConfig = BacktestConfig()) -> Column:
    """1, -1 or 0 of a probability of rising."""
    known = F.coalesce((p >= 0) & (p <= 1), F.lit(False)) & (F.greatest(p, 1 - p) >= cfg.min_confidence)
    return F.when(~known, 0).when(p >= cfg.p_long, 1).when(1 - p >= cfg.p_short, -1).otherwise(0)


def neighbour_signals(neighbours: DataFrame, events: DataFrame, cfg: BacktestConfig = BacktestConfig()) -> DataFrame:
    """p_long, direction and confidence of events from the labels of their earlier neighbours, weighted by similarity.

    neighbours: event_id, event_ts, timestamp, label, similarity; events: event_id.
    """
    weight = F.greatest("similarity", F.lit(0.0))
    sums = neighbours.where(F.col("timestamp") < F.col("event_ts")).groupBy("event_id").agg(
        F.sum(weight).alias("all"), F.sum(F.when(F.col("label") == "Good", weight).otherwise(0.0)).alias("good"), F.sum(F.when(F.col("label") == "Bad", weight).otherwise(0.0)).alias("bad")
    )
    df = events.join(sums, "event_id", "left")
    some = F.coalesce(F.col("all") > 0, F.lit(False))
    df = df.withColumn("p_long", F.when(some, F.col("good") / (F.col("good") + F.col("bad") + 1e-12)).otherwise(0.5)).withColumn("direction", direction(F.col("p_long"), cfg))
    weak = F.when(some, 2 * F.abs(F.col("p_long") - 0.5)).otherwise(0.0)
    return df.withColumn("confidence", F.when(F.col("direction") != 0, F.greatest("p_long", 1 - F.col("p_long"))).otherwise(weak)).drop("all", "good", "bad")


def evaluation_start(events: DataFrame, fraction: float) -> DataFrame:
    """Per policy the quantile of the events' times (linear, cut to an integer), by selection: no task holds a policy's times."""
    place = (F.col("n") - 1) * F.lit(float(fraction))
    sizes = written(events.where("timestamp IS NOT NULL").groupBy("policy").agg(F.count(F.lit(1)).alias("n")).withColumns({"lo": F.floor(place), "part": place - F.floor(place)}), "policy-sizes")
    wanted = sizes.select("policy", F.explode(F.array_distinct(F.array("lo", F.least(F.col("lo") + 1, F.col("n") - 1)))).alias("k"))
    found = slices.order_statistics(events.where("timestamp IS NOT NULL"), ["policy"], "timestamp", wanted)
    ends = found.groupBy("policy").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    return ends.join(sizes, "policy").select("policy", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).cast("long").alias("eval_start"))


def trades(signals: DataFrame, candles: DataFrame, cfg: BacktestConfig = BacktestConfig(), short: int | None = None) -> DataFrame:
    """Every signal's trade as if it were taken, per unit of equity: share (net result), prices, fees, reason and times.

    signals: policy, symbol, timestamp, direction, confidence; candles: the execution series, one per symbol, or per exchange and symbol where
    signals have the column exchange. short: as in with_atr.
    """
    series = series_key(signals, candles)
    bars = with_atr(candles, short=short).select(*series, "timestamp", "idx", "n", "open", "high", "low", "close", "atr")
    wanted = signals.where((F.col("direction") != 0) & (F.col("confidence") >= cfg.min_confidence))
    df = next_at_or_after(wanted, bars, series, ["idx", "n", "open", "close", "atr"], short).where("idx IS NOT NULL AND idx < n - 2 AND atr > 0 AND NOT isnan(atr)")
    up, side = F.col("direction") == 1, F.col("direction").cast("double")
    df = df.withColumn("atr_pct", F.when(F.col("close") != 0, F.col("atr") / F.col("close")).otherwise(0.0)).withColumn("regime", regime(F.col("atr_pct")))
    pick = lambda low, high: F.when(F.col("regime") == "low", low).when(F.col("regime") == "high", high).otherwise(1.0)
    df = df.select("*", (pick(0.85, 1.15) * cfg.sl).alias("sl_mult"), (pick(0.9, 1.2) * cfg.tp).alias("tp_mult"), (F.col("open") * (1 + side * cfg.slippage)).alias("entry_eff"))
    df = df.select("*", (F.col("open") - side * F.col("sl_mult") * F.col("atr")).alias("sl_raw"), (F.col("open") + side * F.col("tp_mult") * F.col("atr")).alias("tp_raw"))
    df = df.withColumn("sl_dist", side * (F.col("entry_eff") - F.col("sl_raw"))).where("sl_dist > 0")
    by_cash = F.when(F.col("entry_eff") != 0, 1 / F.col("entry_eff")).otherwise(0.0)
    df = df.withColumn("qty", F.least(F.lit(min(cfg.risk, cfg.max_risk)) / F.col("sl_dist"), by_cash)).where("qty > 0")
    df = df.withColumn("exit_idx", F.least(F.col("n") - 1, F.col("idx") + cfg.horizon_steps)).withColumn("entry_price", F.col("open"))
    # The bars of the holding time: few per trade, so trades are spread over them and meet the series by its place.
    key = ["policy", *series, "timestamp", "direction", "confidence"] + [c for c in ("pattern_type",) if c in signals.columns]
    held = df.select("*", F.explode(F.sequence("idx", "exit_idx")).alias("bar")).drop("open", "close", "n")
    held = held.join(bars.select(*series, F.col("idx").alias("bar"), F.col("timestamp").alias("bar_ts"), "high", "low", "close"), [*series, "bar"])
    stop = F.when(up, F.col("low") <= F.col("sl_raw")).otherwise(F.col("high") >= F.col("sl_raw"))
    take = F.when(up, F.col("high") >= F.col("tp_raw")).otherwise(F.col("low") <= F.col("tp_raw"))
    event = F.when(stop, F.struct(F.lit("stop_loss").alias("reason"), F.col("sl_raw").alias("price"))).when(take, F.struct(F.lit("take_profit").alias("reason"), F.col("tp_raw").alias("price")))
    kept = ["entry_price", "entry_eff", "qty", "atr", "atr_pct", "regime", "sl_mult", "tp_mult", "sl_raw", "tp_raw"]
    done = held.groupBy(*key, *kept).agg(F.min_by(event, F.when(event.isNotNull(), F.col("bar"))).alias("e"), F.max_by("close", "bar").alias("last"), F.max("bar_ts").alias("exit_ts"))
    done = done.select(*key, *kept, "exit_ts", F.coalesce("e.reason", F.lit("horizon")).alias("exit_reason"), F.coalesce("e.price", F.col("last")).alias("exit_price"))
    done = done.withColumn("exit_eff", F.col("exit_price") * (1 - side * cfg.slippage))
    fees = F.col("qty") * cfg.fee * (F.abs("entry_eff") + F.abs("exit_eff"))
    return done.withColumn("share", F.col("qty") * side * (F.col("exit_eff") - F.col("entry_eff")) - fees)


_ENTRY = "policy string, __slice long, entered long, number long, equity double"


def portfolio(possible: DataFrame, starts: DataFrame, cfg: BacktestConfig = BacktestConfig(), length: int = slices.SLICE) -> DataFrame:
    """The trades that are taken, with equity after each: in the order of time from the policy's start, none before the last exit.

    What is taken depends on what was taken before. A policy's candidates are cut into slices. What a slice does to a portfolio depends on the
    exit it is entered with alone, and only exits up to the latest one of the slices before can occur: for each of its trades that these can lead
    to, the slice tells the last exit, the number of trades and the factor of equity when the portfolio leaves it. A policy's slices are then gone
    through in order, from a few numbers each, and every slice gives the trades that its own entry leads to.
    """
    tie = [c for c in ("pattern_type", "symbol", "direction") if c in possible.columns]
    kept = ["timestamp", *tie, "exit_ts", "share", "confidence", "exit_reason", "qty", "entry_price", "exit_price"]
    candidates = possible.join(starts, "policy").where(F.col("timestamp") >= F.col("eval_start")).select(F.col("policy").cast("string").alias("policy"), "eval_start", *kept)
    types = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}
    rows = slices.sliced(candidates, ["policy"], kept, length)
    latest = rows.groupBy("policy", "__slice").agg(F.max("exit_ts").alias("e"), F.min("timestamp").alias("t"))
    reach = written(latest.select("policy", "__slice", F.coalesce(F.max("e").over(slices.before(["policy"])), F.lit(-1)).alias("reach")), "slice-reach")
    most = cfg.max_trades if cfg.max_trades is not None else 1 << 62

    def ordered(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        """The slice in order, its times and factors, and the place of the trade that may follow each."""
        t = t.sort_by([(c, "ascending") for c in kept])
        at, until = (t.column(c).to_numpy() for c in ("timestamp", "exit_ts"))
        return t, at, 1 + t.column("share").to_numpy(), np.maximum(np.searchsorted(at, until, "left"), np.arange(1, len(at) + 1))

    def outcomes(t: pa.Table) -> pa.Table:
        """A row for each trade that may be the slice's first: what the portfolio is afterwards. It is the first for exits after `over`, up to
        `upto`."""
        t, at, factor, follows = ordered(t)
        n, until = len(at), t.column("exit_ts").to_numpy()
        last, count, product, least = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n), np.empty(n)
        for i in range(n - 1, -1, -1):
            j = follows[i]
            if j < n and factor[i] > 0:
                last[i], count[i], product[i], least[i] = last[j], count[j] + 1, factor[i] * product[j], min(factor[i], factor[i] * least[j])
            else:
                last[i], count[i], product[i], least[i] = until[i], 1, factor[i], factor[i]
        reach = t.column("reach")[0].as_py()
        upto = np.arange(min(n, int(np.searchsorted(at, reach, "left")) + 1))
        over = np.where(upto > 0, at[upto - 1], -(1 << 62))
        return pa.table({"policy": t.column("policy").take(pa.array(np.zeros(len(upto), int))), "__slice": t.column("__slice").take(pa.array(np.zeros(len(upto), int))), "over": over, "upto": at[upto], "last": last[upto], "count": count[upto], "product": product[upto], "least": least[upto]})

    def entries(t: pa.Table) -> pa.Table:
        """How a policy's slices are entered, from the outcomes of all in order."""
        t = t.sort_by([(c, "ascending") for c in ("__slice", "over", "upto")])
        number, edges = t.column("__slice").to_numpy(), [0, *(np.flatnonzero(np.diff(t.column("__slice").to_numpy())) + 1).tolist(), t.num_rows]
        over, upto, last, count, product, least = (t.column(c).to_numpy() for c in ("over", "upto", "last", "count", "product", "least"))
        entered, taken, equity, out = -1, 0, cfg.initial_equity, []
        for i, j in zip(edges, edges[1:], strict=False):
            out.append((int(number[i]), entered, taken, equity))
            k = i + int(np.searchsorted(over[i:j], entered, "left")) - 1
            # The last row stands for exits beyond its own time too, which leave the slice as it is.
            if k >= i and entered <= upto[k] and equity > 0 and taken < most:
                entered, taken, equity = int(last[k]), taken + int(count[k]), equity * product[k] if least[k] > 0 else 0.0
        policy = t.column("policy")[0].as_py()
        return pa.table([pa.array([policy] * len(out), pa.string()), *[pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)]], names=["policy", "__slice", "entered", "number", "equity"])

    ddl = ", ".join(f"{c} {types[c]}" for c in ("policy", "eval_start")) + ", number int, " + ", ".join(f"{c} {types[c]}" for c in kept) + ", equity_before double, equity double"

    def taken(t: pa.Table, entry: pa.Table) -> pa.Table:
        t, at, factor, follows = ordered(t)
        entered, number, equity = (entry.column(c)[0].as_py() for c in ("entered", "number", "equity"))
        i, picked, before, after = int(np.searchsorted(at, entered, "left")), [], [], []
        while i < len(at) and equity > 0 and number + len(picked) < most:
            picked.append(i)
            before.append(equity)
            equity *= factor[i]
            after.append(equity)
            i = int(follows[i])
        out = t.take(pa.array(picked, pa.int64()))
        columns = [out.column("policy"), out.column("eval_start"), pa.array(range(number, number + len(picked)), pa.int32()), *[out.column(c) for c in kept], pa.array(before, pa.float64()), pa.array(after, pa.float64())]
        return pa.table(columns, names=["policy", "eval_start", "number", *kept, "equity_before", "equity"])

    by = ["policy", "__slice"]
    summed = rows.join(reach, by).groupBy(*by).applyInArrow(outcomes, "policy string, __slice long, over long, upto long, last long, count long, product double, least double")
    entry = written(summed.groupBy("policy").applyInArrow(entries, _ENTRY), "slice-entries")
    return rows.groupBy(*by).cogroup(entry.groupBy(*by)).applyInArrow(taken, ddl).withColumn("net_pnl", F.col("equity_before") * F.col("share"))


def equity_curve(taken: DataFrame, starts: DataFrame, cfg: BacktestConfig = BacktestConfig()) -> DataFrame:
    """(policy, number, timestamp, equity, drawdown), number 0 for the start."""
    first = starts.select("policy", F.lit(0).alias("number"), F.col("eval_start").alias("timestamp"), F.lit(cfg.initial_equity).alias("equity"))
    curve = first.unionByName(taken.select("policy", (F.col("number") + 1).alias("number"), F.col("exit_ts").alias("timestamp"), "equity"))
    peak = F.max("equity").over(W.partitionBy("policy").orderBy("number").rowsBetween(W.unboundedPreceding, 0))
    return curve.withColumn("drawdown", (peak - F.col("equity")) / F.greatest(peak, F.lit(1e-12)))


def metrics(taken: DataFrame, curve: DataFrame, cfg: BacktestConfig = BacktestConfig()) -> DataFrame:
    """The eleven metrics per policy; all 0 without trades."""
    r, p = F.col("share"), F.col("net_pnl")
    each = taken.groupBy("policy").agg(
        F.count(F.lit(1)).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), F.stddev_samp(F.when(r < 0, r)).alias("down"), F.count_if(r < 0).alias("n_down"),
        F.avg(F.when(p > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg(F.when(p > 0, p)).alias("avg_win"), F.avg(F.when(p < 0, p)).alias("avg_loss"), F.avg(p).alias("expectancy"),
        F.sum(F.when(p > 0, p).otherwise(0.0)).alias("won"), F.sum(F.when(p < 0, -p).otherwise(0.0)).alias("lost"),
    )
    whole = curve.groupBy("policy").agg(F.max_by("equity", "number").alias("final"), F.max("drawdown").alias("mdd"))
    df = whole.join(each, "policy", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    some = F.coalesce(F.col("n") > 0, F.lit(False))
    net = F.when(some, F.col("final") / cfg.initial_equity - 1).otherwise(0.0)
    made = {
        "net_return": net, "max_drawdown": F.when(some, F.col("mdd")).otherwise(0.0), "sharpe": zero(F.when(F.col("std") > 0, F.col("mean") / F.col("std"))),
        "sortino": zero(F.when((F.col("n_down") >= 2) & (F.col("down") > 0), F.col("mean") / F.col("down"))), "calmar": zero(F.when(some & (F.col("mdd") > 0), net / F.col("mdd"))),
        "win_rate": zero(F.col("win_rate")), "avg_win": zero(F.col("avg_win")), "avg_loss": zero(F.col("avg_loss")), "expectancy": zero(F.col("expectancy")),
        "profit_factor": zero(F.when(F.col("lost") > 0, F.col("won") / F.col("lost"))), "trade_count": F.coalesce("n", F.lit(0)).cast("long"),
    }
    return df.select("policy", *[v.alias(k) for k, v in made.items()])


def ranked(found: DataFrame) -> DataFrame:
    """Policies by sharpe, then net return (missing as 0), then name."""
    order = [F.desc(F.coalesce("sharpe", F.lit(0.0))), F.desc(F.coalesce("net_return", F.lit(0.0))), F.asc("policy")]
    return found.withColumn("place", F.row_number().over(W.orderBy(*order)))


def promoted(champion: DataFrame, challenger: DataFrame, least_trades: int = 5) -> DataFrame:
    """Per policy whether the challenger replaces the champion: there is none, or enough trades and nothing worse."""
    a, b = challenger.alias("a"), champion.alias("b")
    better = (F.col("a.trade_count") >= least_trades) & (F.col("a.sharpe") >= F.col("b.sharpe")) & (F.col("a.net_return") >= F.col("b.net_return")) & (F.col("a.max_drawdown") <= F.col("b.max_drawdown"))
    return a.join(b, F.col("a.policy") == F.col("b.policy"), "left").select(F.col("a.policy"), (F.col("b.policy").isNull() | better).alias("promote"))
