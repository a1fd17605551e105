"""Rolling windows over the bars of a series."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from periodica.functions.series import per_series

SERIES = "series_id"


def along() -> WindowSpec:
    """Bars of a series in time."""
    return Window.partitionBy(SERIES).orderBy("ts")


def whole() -> WindowSpec:
    return Window.partitionBy(SERIES)


def last_bars(n: int) -> WindowSpec:
    return along().rowsBetween(-(n - 1), 0)


def rolling(x: Column | str, n: int, how: Callable[[Column], Column], least: int | None = None) -> Column:
    """how over the last n bars, null until least (n if not given) of them hold a value."""
    x = F.col(x) if isinstance(x, str) else x
    over = last_bars(n)
    return F.when(F.count(x).over(over) >= (least or n), how(x).over(over))


def lag(x: Column | str, n: int = 1) -> Column:
    return F.lag(x, n).over(along())


def lead(x: Column | str, n: int = 1) -> Column:
    return F.lead(x, n).over(along())


def emas(bars: DataFrame, x: str, spans: Sequence[int]) -> DataFrame:
    """Exponential moving averages ema_<span> without bias correction, y = a x + (1 - a) y', in one pass over each series; gaps before the first value stay gaps, later ones carry the average on with their weight."""
    names = {f"ema_{s}": s for s in spans}
    kept = [f for f in bars.schema.fields if f.name != SERIES]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.assign(**{n: frame[x].astype(float).ewm(span=s, adjust=False).mean() for n, s in names.items()})

    return per_series(bars, [f.name for f in kept if f.name != "ts"], lambda f: run(f)[[*[k.name for k in kept], *names]], kinds + "".join(f", {n} double" for n in names))


def correlation(a: str, b: str, over: WindowSpec | None = None) -> Column:
    """Pearson correlation of the rows where both columns are known, as an aggregate or over a window; null where either is constant, instead of an error."""
    within = lambda c: c.over(over) if over is not None else c
    deviation = lambda x, y: within(F.stddev_pop(F.when(F.col(y).isNotNull(), F.col(x))))
    return F.try_divide(within(F.covar_pop(a, b)), deviation(a, b) * deviation(b, a))
