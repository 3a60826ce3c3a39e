"""Sums, maxima and minima of the last n sessions in time that grows with log n instead of n."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.functions.windows import KEYS, sessions

_JOIN = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0.0)), "max": F.greatest, "min": F.least}


def rolling(rows: DataFrame, wanted: dict[str, tuple[str, str, int]], keys=KEYS) -> DataFrame:
    """rows with a column for each name of ``wanted``: (column, op, n) with op sum, max or min over the last n sessions.

    A frame of 2k sessions is one of k and the one k sessions before it, so a few lags along one order give every
    power of two, and a frame of n is put together from those in n's binary form. All share one exchange and one sort.
    Nulls are skipped; a sum of nothing is 0. Nothing is subtracted, so no digits are lost.
    """
    w, columns = sessions(keys), rows.columns
    reach: dict[tuple[str, str], int] = {}
    for column, op, n in wanted.values():
        reach[column, op] = max(n, reach.get((column, op), 1))

    def at(series, k):
        return f"_{series[0]}_{series[1]}_{k}"

    out = rows.withColumns({at(s, 1): F.coalesce(F.col(s[0]).cast("double"), F.lit(0.0)) if s[1] == "sum" else F.col(s[0]) for s in reach})
    k = 1
    while any(n >= 2 * k for n in reach.values()):
        out = out.withColumns({at(s, 2 * k): _JOIN[s[1]](F.col(at(s, k)), F.lag(at(s, k), k).over(w)) for s, n in reach.items() if n >= 2 * k})
        k *= 2
    found = {}
    for name, (column, op, n) in wanted.items():
        value, offset = None, 0
        for bit in range(n.bit_length() - 1, -1, -1):
            if n >> bit & 1:
                part = F.lag(at((column, op), 1 << bit), offset).over(w) if offset else F.col(at((column, op), 1 << bit))
                value = part if value is None else _JOIN[op](value, part)
                offset += 1 << bit
        found[name] = value
    return out.withColumns(found).select(*columns, *wanted)
