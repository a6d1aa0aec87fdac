"""The trading environment as a fold over bars, given a column of actions (0 hold, 1 enter, 2 close)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def episode(bars: DataFrame, equity: float = 10_000.0, fee: float = 0.001, slippage: float = 0.0005, sl: float = 1.5, tp: float = 2.0, risk: float = 0.01, max_drawdown: float = 0.1) -> DataFrame:
    """Per step: equity, cash, whether a position is held, and the reward. bars: symbol, idx, high, low, close, atr, action.

    Stop and target come before the action; an entry that cash doesn't cover with its fee doesn't happen; the episode ends with the step
    that loses a tenth of the first equity. An episode is one row's array: it is bounded by its length.
    """
    rows = bars.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("idx", "high", "low", "close", "atr", "action"))).alias("b"))
    floor = equity * (1 - max_drawdown)
    exit_price = "IF(x.low <= a.sl, a.sl, IF(x.high >= a.tp, a.tp, NULL))"
    after_risk = f"named_struct('cash', IF(hit IS NULL, a.cash, a.cash + a.qty * hit * {1 - slippage!r}D * {1 - fee!r}D), 'qty', IF(hit IS NULL, a.qty, 0D), 'sl', a.sl, 'tp', a.tp)"
    entry, dist = f"(x.close * {1 + slippage!r}D)", f"({sl!r}D * x.atr)"
    size = f"least(s.cash * {risk!r}D / {dist}, s.cash / {entry})"
    acted = f"""CASE WHEN s.qty = 0 AND x.action = 1 AND x.atr > 0 AND NOT isnan(x.atr) AND {size} > 0 AND {size} * {entry} * {1 + fee!r}D <= s.cash
            THEN named_struct('cash', s.cash - {size} * {entry} * {1 + fee!r}D, 'qty', {size}, 'sl', {entry} - {dist}, 'tp', {entry} + {tp!r}D * x.atr)
        WHEN s.qty > 0 AND hit IS NULL AND x.action = 2 THEN named_struct('cash', s.cash + s.qty * x.close * {1 - slippage!r}D * {1 - fee!r}D, 'qty', 0D, 'sl', s.sl, 'tp', s.tp) ELSE s END"""
    out = "array<struct<idx:int,equity:double,cash:double,held:boolean,reward:double>>"
    fold = F.expr(f"""aggregate(b, named_struct('cash', {equity!r}D, 'qty', 0D, 'sl', 0D, 'tp', 0D, 'equity', {equity!r}D, 'over', false, 'out', CAST(array() AS {out})),
        (a, x) -> IF(a.over, a,
            transform(array(IF(a.qty > 0, {exit_price}, NULL)), hit -> transform(array({after_risk}), s -> transform(array({acted}), t ->
                transform(array(t.cash + t.qty * x.close), e -> named_struct('cash', t.cash, 'qty', t.qty, 'sl', t.sl, 'tp', t.tp, 'equity', e, 'over', e <= {floor!r}D,
                    'out', array_append(a.out, named_struct('idx', CAST(x.idx AS int), 'equity', e, 'cash', t.cash, 'held', t.qty > 0, 'reward', (e - a.equity) / {equity!r}D))))[0])[0])[0])[0]),
        a -> a.out)""")
    return rows.select("symbol", F.inline(fold))
