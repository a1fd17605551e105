"""Bars (series_id, ts, open, high, low, close, volume) from ticks, tables, files and provider payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR = "series_id string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
#: Other names of the columns of bars.
ALIASES = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume", "vol": "volume", "datetime": "ts", "date": "ts", "time": "ts", "timestamp": "ts", "ltp": "close", "last_price": "close"}
#: Bars of a trading day by interval.
BARS_PER_DAY = {"1m": 390.0, "5m": 78.0, "15m": 26.0, "1h": 6.5, "1d": 1.0}


def from_ticks(ticks: DataFrame, series: Column, ts: Column, price: Column, order: Column, unit: str = "day") -> DataFrame:
    """One bar for each series and calendar unit with ticks: first, highest, lowest and last price in the order given; volume is the number of ticks."""
    rows = ticks.select(series.cast("string").alias("series_id"), F.date_trunc(unit, ts).cast("timestamp_ntz").alias("ts"), price.cast("double").alias("p"), order.alias("o"))
    return rows.groupBy("series_id", "ts").agg(F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.count("p").cast("double").alias("volume"))


def resample(bars: DataFrame, unit: str) -> DataFrame:
    """Tumbling calendar units: first open, highest high, lowest low, last close, sum of volumes; units without bars are left out."""
    out = bars.groupBy("series_id", F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("bucket"))
    return out.agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")).withColumnRenamed("bucket", "ts")


def normalize(df: DataFrame, series_id: str | None = None) -> DataFrame:
    """Any table with a time and a close, under their usual names, as bars: open, high and low default to close, volume to 0; rows without time or with a close not above 0 go, and of one time the first by value stays."""
    names = {}
    for c in df.columns:
        name = ALIASES.get(c.strip().lower(), c.strip().lower())
        names.setdefault(name, F.col(f"`{c}`"))
    if "ts" not in names:
        names["ts"] = next((F.col(f"`{c}`") for c in df.columns if "date" in c.lower() or "time" in c.lower()), None)
    if names["ts"] is None or "close" not in names:
        raise ValueError("a time and a close column are needed")
    close = names["close"].cast("double")
    picked = df.select(
        names.get("series_id", F.lit(series_id)).cast("string").alias("series_id"), F.try_to_timestamp(names["ts"].cast("string")).cast("timestamp_ntz").alias("ts"),
        *[F.coalesce(names[c].cast("double") if c in names else F.lit(None), close).alias(c) for c in ("open", "high", "low")], close.alias("close"), F.coalesce(names["volume"].cast("double") if "volume" in names else F.lit(None), F.lit(0.0)).alias("volume"),
    )
    first = F.row_number().over(Window.partitionBy("series_id", "ts").orderBy("open", "high", "low", "close", "volume"))
    return picked.where("ts is not null and close > 0 and not isnan(close)").withColumn("n", first).where("n = 1").drop("n")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    out = spark.read.parquet(path)
    return out.toDF(*[c.lower() for c in out.columns])


def write_parquet(bars: DataFrame, path: str) -> None:
    bars.write.partitionBy("series_id").mode("overwrite").parquet(path)


def read_csv(spark: SparkSession, path: str, series_id: str) -> DataFrame:
    return normalize(spark.read.option("header", True).csv(path), series_id)


def from_parallel_arrays(payload: DataFrame) -> DataFrame:
    """Payloads whose columns are arrays of one length: timestamp (seconds), open, high, low, close, volume."""
    rows = payload.select("series_id", F.explode(F.arrays_zip("timestamp", "open", "high", "low", "close", "volume")).alias("r"))
    return normalize(rows.select("series_id", F.timestamp_seconds("r.timestamp").cast("timestamp_ntz").alias("ts"), "r.open", "r.high", "r.low", "r.close", "r.volume"))


def from_time_map(payload: DataFrame) -> DataFrame:
    """Payloads (series_id, body) of JSON that maps times to numbered fields such as "1. open"."""
    rows = payload.select("series_id", F.explode(F.from_json("body", "map<string, map<string, string>>")).alias("ts", "fields"))
    field = lambda n, c: F.col("fields")[f"{n}. {c}"].alias(c)
    return normalize(rows.select("series_id", "ts", *[field(i + 1, c) for i, c in enumerate(("open", "high", "low", "close", "volume"))]))


def from_records(payload: DataFrame) -> DataFrame:
    """Payloads (series_id, body) of a JSON array of objects with datetime, open, high, low, close and volume."""
    kind = "array<struct<datetime string, open string, high string, low string, close string, volume string>>"
    return normalize(payload.select("series_id", F.inline(F.from_json("body", kind))))


def preview(bars: DataFrame, rows: int = 100) -> DataFrame:
    """The first rows of each series with its number of bars, begin and end."""
    each = Window.partitionBy("series_id")
    out = bars.withColumn("n", F.row_number().over(each.orderBy("ts"))).withColumn("total_bars", F.count("*").over(each)).withColumn("first_ts", F.min("ts").over(each)).withColumn("last_ts", F.max("ts").over(each))
    return out.where(F.col("n") <= rows)


#: Parts of symbols by kind of instrument, in the order in which they are tried, and whole symbols of indexes.
SYMBOL_PARTS = {"crypto": ("BTC", "ETH", "USDT", "BNB"), "forex": ("USD", "EUR", "GBP", "JPY", "FOREX"), "commodity": ("GOLD", "SILVER", "OIL", "CRUDE", "XAU", "XAG")}
INDEX_SYMBOLS = ("^NSEI", "^BSESN", "^NSEBANK", "NIFTY", "BANKNIFTY")


def instrument_class(symbol: Column, source: Column | None = None) -> Column:
    """Kind of instrument: the first of crypto, forex and commodity of which the symbol holds a part, else index or stock; all of source ccxt is crypto."""
    upper = F.upper(symbol)
    kind = F.when(F.coalesce(source == "ccxt", F.lit(False)) if source is not None else F.lit(False), "crypto")
    for name, parts in SYMBOL_PARTS.items():
        kind = kind.when(upper.rlike("|".join(parts)), name)
    return kind.when(upper.isin(*INDEX_SYMBOLS), "index").otherwise("stock")
