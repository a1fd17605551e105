"""Providers of bars: their catalog, the one suggested for a symbol, and the fallback from one provider's bars to the next one's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Key, name, region, whether a session is needed, and its kind.
CATALOG = [
    ("zerodha", "Zerodha Kite Connect", "india", True, "oauth_request_token"),
    ("upstox", "Upstox API v3", "india", True, "oauth_bearer"),
    ("angelone", "Angel One SmartAPI", "india", True, "totp_jwt"),
    ("dhan", "Dhan API", "india", True, "static_token"),
    ("fyers", "Fyers API v3", "india", True, "oauth_bearer"),
    ("yahoo", "Yahoo Finance", "global", False, "none"),
    ("stooq", "Stooq", "global", False, "none"),
    ("alpha_vantage", "Alpha Vantage", "global", True, "api_key"),
    ("twelve_data", "Twelve Data", "global", True, "api_key"),
    ("ccxt", "CCXT (Crypto)", "global", False, "none"),
]
#: Providers tried after the first one, in order.
FALLBACKS = ["yahoo", "stooq", "twelve_data", "alpha_vantage"]
#: Names of Indian indexes, and endings of Indian symbols.
INDIAN_INDEXES = ["NIFTY", "NIFTY 50", "BANKNIFTY", "NIFTY BANK", "FINNIFTY", "SENSEX", "MIDCPNIFTY", "NIFTY IT", "NIFTY AUTO", "NIFTY PHARMA", "NIFTY FMCG"]
INDIAN_ENDINGS = [".NS", ".BO"]


def providers(spark: SparkSession, region: str | None = None) -> DataFrame:
    """The catalog (key, name, region, requires_auth, auth_type), of one region if given."""
    rows = spark.createDataFrame(CATALOG, "key string, name string, region string, requires_auth boolean, auth_type string")
    return rows if region is None else rows.where(F.col("region") == region)


def suggested(symbol: Column, broker: Column | None = None) -> Column:
    """Provider for a symbol: pairs with a slash go to ccxt, Indian symbols to the broker if it is a known one, all else (a null symbol too) to yahoo."""
    indian = F.trim(F.upper(symbol)).isin(*INDIAN_INDEXES)
    for ending in INDIAN_ENDINGS:
        indian = indian | symbol.endswith(ending)
    out = F.when(F.contains(symbol, F.lit("/")), "ccxt")
    if broker is not None:
        out = out.when(indian & broker.isin(*[row[0] for row in CATALOG]), broker)
    return out.otherwise("yahoo")


def _chosen(bars: DataFrame, wanted: DataFrame, source: str, sessions: tuple[str, ...], fallback: bool, least: int) -> DataFrame:
    """(series_id, provider, place, tries) of every series of wanted (series_id, primary); place is null where no provider serves."""
    tries = F.array(F.col("primary"), *map(F.lit, FALLBACKS)) if fallback else F.array("primary")
    tried = wanted.select("series_id", F.array_distinct(tries).alias("tries"))
    each = tried.select("series_id", "tries", F.posexplode("tries").alias("place", "provider"))
    closed = [row[0] for row in CATALOG if row[3] and row[0] not in sessions]
    counts = bars.groupBy("series_id", F.col(source).alias("provider")).agg(F.count("*").alias("_n"))
    served = (F.col("_n") >= least) & ((F.col("place") == 0) | ~F.col("provider").isin(*closed))
    met = each.join(counts, ["series_id", "provider"], "left").withColumn("_at", F.when(served, F.struct("place", "provider")))
    best = met.groupBy("series_id", "tries").agg(F.min("_at").alias("_best"))
    return best.select("series_id", F.col("_best.provider").alias("provider"), F.col("_best.place").alias("place"), "tries")


def routes(bars: DataFrame, wanted: DataFrame, source: str = "source", sessions: tuple[str, ...] = (), fallback: bool = True, least: int = 10) -> DataFrame:
    """Which provider serves each series of wanted (series_id, primary), from bars (series_id, source, ...) of several providers: (series_id, provider, fell_back, attempts).

    Tried in order: the primary one, then the fallbacks; a provider of fewer than least bars fails, and one that needs a session is passed over unless it is the primary
    or named in sessions. Attempts hold the providers passed over too. Where all fail, provider is null, attempts hold all, and fell_back is true. A series that wanted
    names more than once takes the least of its primaries.
    """
    once = wanted.groupBy("series_id").agg(F.min("primary").alias("primary")).where("series_id is not null and primary is not null")
    found = _chosen(bars, once, source, sessions, fallback, least)
    upto = F.when(F.col("place").isNull(), F.col("tries")).otherwise(F.slice("tries", 1, F.col("place") + 1))
    return found.select("series_id", "provider", F.coalesce(F.col("place") > 0, F.lit(True)).alias("fell_back"), upto.alias("attempts"))


def routed(bars: DataFrame, wanted: DataFrame, source: str = "source", **how: object) -> DataFrame:
    """Bars of the provider that serves each series (see routes), with fell_back and attempts; series that none serves have no rows."""
    found = routes(bars, wanted, source, **how).where("provider is not null")
    return bars.join(found.withColumnRenamed("provider", source), ["series_id", source])


def same_time(bars: DataFrame, order: list[str], source: str = "source") -> DataFrame:
    """One bar for each series and time: that of the first provider in order which has it; others come last, by name."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(source)), F.lit(0)), F.lit(len(order) + 1))
    row = F.row_number().over(Window.partitionBy("series_id", "ts").orderBy(place, source))
    return bars.withColumn("_row", row).where("_row = 1").drop("_row")
