"""Planted daily series, as SQL that Spark and DuckDB both run: each makes one family of chart patterns fire.

Zigzags between two lines end with a jump above or a fall below them; parabolas make cups and round turns. Flags, pennants and rectangles need a
close beyond the highest high, which only a candle whose high and low don't hold its close can have, so their last candle is such a one.
"""

from __future__ import annotations

#: symbol -> (upper line, lower line, 1 to jump after the last low, -1 to fall after the last high)
ZIGZAGS = {
    "ascending": ("120e0", "80e0 + 0.05e0 * i", 1),
    "descending": ("160e0 - 0.05e0 * i", "80e0", -1),
    "symmetrical up": ("150e0 - 0.05e0 * i", "80e0 + 0.05e0 * i", 1),
    "symmetrical down": ("150e0 - 0.05e0 * i", "80e0 + 0.05e0 * i", -1),
    "broadening up": ("120e0 + 0.05e0 * i", "80e0 - 0.05e0 * i", 1),
    "broadening down": ("120e0 + 0.05e0 * i", "80e0 - 0.05e0 * i", -1),
    "rising wedge": ("120e0 + 0.02e0 * i", "80e0 + 0.05e0 * i", -1),
    "falling wedge": ("150e0 - 0.02e0 * i", "100e0 - 0.05e0 * i", 1),
    "channel up": ("120e0 + 0.03e0 * i", "80e0 + 0.03e0 * i", 1),
    "channel down": ("120e0 + 0.03e0 * i", "80e0 + 0.03e0 * i", -1),
}
#: symbol -> (close, what the last close is moved by beyond its own high and low)
CURVES = {
    "rounded bottom": ("100e0 + 0.01e0 * (i - 200) * (i - 200)", "0e0"),
    "rounded top": ("1000e0 - 0.01e0 * (i - 200) * (i - 200)", "0e0"),
    "cup": ("CASE WHEN i < 204 THEN 100e0 + 0.01e0 * (i - 152) * (i - 152) ELSE 127e0 + 0.3e0 * (i - 204) END", "0e0"),
    "bull flag": ("CASE WHEN i < 200 THEN 100e0 WHEN i < 230 THEN 108e0 + 2e0 * (i % 2) ELSE 110e0 - 0.02e0 * (i - 230) END", "1.5e0"),
    "bear flag": ("CASE WHEN i < 200 THEN 100e0 WHEN i < 230 THEN 90e0 + 2e0 * (i % 2) ELSE 90e0 + 0.02e0 * (i - 230) END", "-1.5e0"),
    "rectangle up": ("CASE WHEN i < 200 THEN 110e0 + 0.1e0 * (i % 7) ELSE 110e0 + 0.2e0 * (i % 5) END", "2e0"),
    "rectangle down": ("CASE WHEN i < 200 THEN 110e0 + 0.1e0 * (i % 7) ELSE 110e0 + 0.2e0 * (i % 5) END", "-2e0"),
}


def blocks(lineitem: str) -> str:
    """Days of each symbol of the lineitem table in blocks of 260: part, and i from 0 to 259 (the last block may end earlier)."""
    return f"""(SELECT symbol || ' ' || CAST(floor(k / 260e0) AS INT) AS part, CAST(k % 260 AS BIGINT) AS i FROM (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS k
        FROM (SELECT DISTINCT l_returnflag || '/' || l_linestatus AS symbol, l_shipdate AS day FROM {lineitem}) d) k)"""


def planted(numbers: str, curves: bool = True) -> str:
    """Zigzags, and curves too if they are wanted, for each part of `numbers` (part, i): symbol, timeframe, timestamp, open, high, low, close, volume."""
    parts = []
    for name, (upper, lower, turn) in ZIGZAGS.items():
        wave = f"({lower}) + (({upper}) - ({lower})) * (1e0 - abs(i % 40 - 20) / 20e0)"
        close = f"CASE WHEN i > 240 THEN 200e0 ELSE {wave} END" if turn > 0 else f"CASE WHEN i > 220 THEN 20e0 ELSE {wave} END"
        parts.append(f"SELECT '{name} ' || part AS symbol, i, {close} AS c, 0e0 AS moved FROM {numbers} t")
    parts += [f"SELECT '{name} ' || part AS symbol, i, {close} AS c, CASE WHEN i = 259 THEN {moved} ELSE 0e0 END AS moved FROM {numbers} t" for name, (close, moved) in (CURVES.items() if curves else ())]
    return f"SELECT symbol, '1d' AS timeframe, i * 86400000 AS timestamp, c - 0.1e0 AS open, c + 0.25e0 AS high, c - 0.25e0 AS low, c + moved AS close, 1e0 AS volume FROM ({' UNION ALL '.join(parts)}) p"
