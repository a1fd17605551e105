"""Positions of sun, moon and planets by date, aspects between them, and when they become exact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

BODIES = ("sun", "moon", "mercury", "venus", "mars", "jupiter", "saturn", "uranus", "neptune", "pluto")
#: Aspects and their angles in degrees.
ASPECTS = {"conjunction": 0.0, "sextile": 60.0, "square": 90.0, "trine": 120.0, "opposition": 180.0}
SIGNS = ("Aries", "Taurus", "Gemini", "Cancer", "Leo", "Virgo", "Libra", "Scorpio", "Sagittarius", "Capricorn", "Aquarius", "Pisces")
#: Published Keplerian elements at J2000 and their change a century, for 1800 to 2050: semi-major axis (au), eccentricity, inclination, mean longitude, longitude of perihelion, and of the ascending node (degrees).
ELEMENTS = {
    "mercury": (0.38709927, 0.00000037, 0.20563593, 0.00001906, 7.00497902, -0.00594749, 252.25032350, 149472.67411175, 77.45779628, 0.16047689, 48.33076593, -0.12534081),
    "venus": (0.72333566, 0.00000390, 0.00677672, -0.00004107, 3.39467605, -0.00078890, 181.97909950, 58517.81538729, 131.60246718, 0.00268329, 76.67984255, -0.27769418),
    "earth": (1.00000261, 0.00000562, 0.01671123, -0.00004392, -0.00001531, -0.01294668, 100.46457166, 35999.37244981, 102.93768193, 0.32327364, 0.0, 0.0),
    "mars": (1.52371034, 0.00001847, 0.09339410, 0.00007882, 1.84969142, -0.00813131, -4.55343205, 19140.30268499, -23.94362959, 0.44441088, 49.55953891, -0.29257343),
    "jupiter": (5.20288700, -0.00011607, 0.04838624, -0.00013253, 1.30439695, -0.00183714, 34.39644051, 3034.74612775, 14.72847983, 0.21252668, 100.47390909, 0.20469106),
    "saturn": (9.53667594, -0.00125060, 0.05386179, -0.00050991, 2.48599187, 0.00193609, 49.95424423, 1222.49362201, 92.59887831, -0.41897216, 113.66242448, -0.28867794),
    "uranus": (19.18916464, -0.00196176, 0.04725744, -0.00004397, 0.77263783, -0.00242939, 313.23810451, 428.48202785, 170.95427630, 0.40805281, 74.01692503, 0.04240589),
    "neptune": (30.06992276, 0.00026291, 0.00859048, 0.00005105, 1.77004347, 0.00035372, -55.12002969, 218.45945325, 44.96476227, -0.32241464, 131.78422574, -0.00508664),
    "pluto": (39.48211675, -0.00031596, 0.24882730, 0.00005170, 17.14001206, 0.00004818, 238.92903833, 145.20780515, 224.06891629, -0.04062942, 110.30393684, -0.01183482),
}
#: The largest terms of the moon's longitude and latitude (degrees) with their multiples of elongation, sun's anomaly, moon's anomaly and argument of latitude.
MOON_LONGITUDE = ((6.288774, 0, 0, 1, 0), (1.274027, 2, 0, -1, 0), (0.658314, 2, 0, 0, 0), (0.213618, 0, 0, 2, 0), (-0.185116, 0, 1, 0, 0), (-0.114332, 0, 0, 0, 2), (0.058793, 2, 0, -2, 0), (0.057066, 2, -1, -1, 0), (0.053322, 2, 0, 1, 0), (0.045758, 2, -1, 0, 0), (-0.040923, 0, 1, -1, 0), (-0.034720, 1, 0, 0, 0), (-0.030383, 0, 1, 1, 0))
MOON_LATITUDE = ((5.128122, 0, 0, 0, 1), (0.280602, 0, 0, 1, 1), (0.277693, 0, 0, 1, -1), (0.173237, 2, 0, 0, -1), (0.055413, 2, 0, -1, 1), (0.046271, 2, 0, -1, -1), (0.032573, 2, 0, 0, 1))
#: Mean longitude of the moon, elongation, sun's anomaly, moon's anomaly, argument of latitude, and their change a century.
MOON_ARGUMENTS = ((218.3164477, 481267.88123421), (297.8501921, 445267.1114034), (357.5291092, 35999.0502909), (134.9633964, 477198.8675055), (93.2720950, 483202.0175233))
#: Precession of the equinox in degrees a century; obliquity of the ecliptic and its change a century.
PRECESSION, OBLIQUITY = 1.396971, (23.439291, -0.0130042)
DAY = 1 / 36525


def centuries(ts: Column) -> Column:
    """Julian centuries from noon of 2000-01-01."""
    return F.timestamp_diff("SECOND", F.lit("2000-01-01 12:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz")) / (86400.0 * 36525)


def wrapped(degrees: Column) -> Column:
    """Degrees from -180 (included) to 180."""
    return F.pmod(degrees + 180.0, F.lit(360.0)) - 180.0


def in_space(orbit: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Heliocentric x, y, z in the ecliptic of J2000 of bodies with the elements orbit (a row each) at t centuries, by Kepler's equation."""
    a, e, i, l, w, n = (orbit[:, k] + orbit[:, k + 1] * t for k in range(0, 12, 2))
    i, m, w, n = np.radians(i), np.radians((l - w + 180) % 360 - 180), np.radians(w - n), np.radians(n)
    x = m.copy()
    for _ in range(7):  # Newton's steps
        x -= (x - e * np.sin(x) - m) / (1 - e * np.cos(x))
    u, v = a * (np.cos(x) - e), a * np.sqrt(1 - e * e) * np.sin(x)
    ahead, across = u * np.cos(w) - v * np.sin(w), u * np.sin(w) + v * np.cos(w)  # along the line of nodes and at right angles to it
    return np.stack([ahead * np.cos(n) - across * np.sin(n) * np.cos(i), ahead * np.sin(n) + across * np.cos(n) * np.cos(i), across * np.sin(i)])


def moon(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude of the moon in degrees of date."""
    mean, *angles = (a + b * t for a, b in MOON_ARGUMENTS)
    angles = np.radians(np.stack(angles) % 360)
    total = lambda terms: sum(c * np.sin(np.array(k) @ angles) for c, *k in terms)
    return (mean + total(MOON_LONGITUDE)) % 360, total(MOON_LATITUDE)


def sky(place: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of bodies by their number in BODIES, at t centuries: geocentric longitude and latitude, heliocentric longitude (of the sun that of the earth, of the moon its geocentric one), in degrees of date, and declination in radians."""
    orbits = np.array([ELEMENTS.get(b, ELEMENTS["earth"]) for b in BODIES])
    own, earth = in_space(orbits[place], t), in_space(orbits[np.zeros(len(place), int)], t)
    sun, luna = place == BODIES.index("sun"), place == BODIES.index("moon")
    x, y, z = np.where(sun, -earth, own - earth)
    lon, lat = (np.degrees(np.arctan2(y, x)) + PRECESSION * t) % 360, np.degrees(np.arctan2(z, np.hypot(x, y)))
    its = moon(t)
    lon, lat = np.where(luna, its[0], lon), np.where(luna, its[1], lat)
    helio = np.where(luna, lon, (np.degrees(np.arctan2(own[1], own[0])) + PRECESSION * t) % 360)
    tilt = np.radians(OBLIQUITY[0] + OBLIQUITY[1] * t)
    dec = np.arcsin(np.sin(np.radians(lat)) * np.cos(tilt) + np.cos(np.radians(lat)) * np.sin(tilt) * np.sin(np.radians(lon)))
    return lon, lat, helio, dec


def placed(rows: DataFrame, place: str, t: Column, name: str) -> DataFrame:
    """rows with name_lon, name_lat, name_helio_lon and name_dec (see sky) of the bodies whose number is in the column place, at t centuries.

    Batches of columns go through a kernel: as native columns the orbits make expressions so large that planning them took most of the time.
    """
    given = rows.withColumn("_t", t)
    new = [f"{name}_{c}" for c in ("lon", "lat", "helio_lon", "dec")]
    kind = StructType([*given.schema.fields, *[StructField(c, DoubleType()) for c in new]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moments = batch.column("_t").to_numpy(zero_copy_only=False).astype(float)
            found = sky(batch.column(place).to_numpy(zero_copy_only=False).astype(int), np.nan_to_num(moments))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, mask=np.isnan(moments)) for x in found]], names=[*batch.schema.names, *new])

    return given.mapInArrow(run, kind).drop("_t")


def of_bodies(dates: DataFrame) -> DataFrame:
    """A row (place, body) for each of the ten bodies and row of dates; few rows that take much work each are dealt out over all tasks."""
    spread = dates.repartition(int(dates.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ts")
    return spread.select("*", F.posexplode(F.array(*map(F.lit, BODIES))).alias("place", "body"))


def positions(dates: DataFrame) -> DataFrame:
    """A row for each ts of dates and body: lon, lat and helio_lon (degrees), speed and helio_speed (degrees since a day before, from -180 to 180), retrograde (speed is below 0), dec (radians). Good to a few minutes of arc between 1800 and 2050."""
    t = centuries(F.col("ts"))
    both = placed(placed(of_bodies(dates.select("ts")), "place", t, "now"), "place", t - DAY, "before")
    step = lambda c: wrapped(F.col(f"now_{c}") - F.col(f"before_{c}"))
    out = both.select("ts", "body", F.col("now_lon").alias("lon"), F.col("now_lat").alias("lat"), F.col("now_helio_lon").alias("helio_lon"), step("lon").alias("speed"), step("helio_lon").alias("helio_speed"), F.col("now_dec").alias("dec"))
    return out.withColumn("retrograde", F.col("speed") < 0)


def features(dates: DataFrame, longitude: str = "lon") -> DataFrame:
    """(ts, feature, value): of each body lon, lon_sin, lon_cos, speed, speed_abs, retrograde and dec, by geocentric (lon) or heliocentric longitude (helio_lon)."""
    speed = F.col("speed" if longitude == "lon" else "helio_speed")
    values = {"lon": F.col(longitude), "lon_sin": F.sin(F.radians(longitude)), "lon_cos": F.cos(F.radians(longitude)), "speed": speed, "speed_abs": F.abs(speed), "retrograde": (speed < 0).cast("double"), "dec": F.col("dec")}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), v.alias("v")) for n, v in values.items()]))
    return positions(dates).select("ts", "body", each.alias("f")).select("ts", F.concat_ws("_", "body", "f.n").alias("feature"), F.col("f.v").alias("value"))


def in_pairs(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Pairs of bodies of the same keys, the earlier in BODIES first: keys, i, j, body_a, body_b, and of each value name_a and name_b."""
    side = lambda n, at: rows.select(*keys, F.col("place").alias(at), F.col("body").alias(f"body_{n}"), *[F.col(v).alias(f"{v}_{n}") for v in values])
    return side("a", "i").join(side("b", "j"), keys).where("i < j")


def kinds(ways: bool = False) -> Column:
    """Aspects (k, aspect, exact) to explode; with ways also the other way round, at the negative angle."""
    return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("aspect"), F.lit(x * s).alias("exact")) for k, (n, x) in enumerate(ASPECTS.items()) for s in ((1, -1) if ways and 0 < x < 180 else (1,))])


def angles(dates: DataFrame, keys: list[str], longitude: str) -> DataFrame:
    """Angle of each pair of bodies, folded to 0 to 180."""
    rows = placed(of_bodies(dates), "place", centuries(F.col("ts")), "now").select(*keys, "place", "body", F.col(f"now_{longitude}").alias("lon"))
    return in_pairs(rows, keys, ["lon"]).withColumn("angle", F.abs(wrapped(F.col("lon_a") - F.col("lon_b"))))


def aspects(dates: DataFrame, longitude: str = "lon", orb: float = 5.0) -> DataFrame:
    """(ts, body_a, body_b, aspect, angle, proximity, active) for each of 45 pairs and 5 aspects at each ts of dates (each once): the angle between longitudes, geocentric (lon) or heliocentric (helio_lon), how far it is from the aspect's, and whether that is at most orb."""
    rows = angles(dates.select("ts").distinct(), ["ts"], longitude).select("*", F.explode(kinds()).alias("s"))
    out = rows.select("ts", "body_a", "body_b", "s.aspect", "angle", F.abs(F.col("angle") - F.col("s.exact")).alias("proximity"))
    return out.withColumn("active", F.col("proximity") <= orb)


def current(as_of: DataFrame) -> DataFrame:
    """Positions at each ts of as_of for reading: longitude, sign, degree_in_sign, speed, is_retrograde, declination in degrees, rounded."""
    sign = F.get(F.array(*map(F.lit, SIGNS)), F.floor(F.col("lon") / 30).cast("int"))
    return positions(as_of).select("ts", "body", F.round("lon", 4).alias("longitude"), sign.alias("sign"), F.round(F.col("lon") % 30, 2).alias("degree_in_sign"), F.round("speed", 4).alias("speed"), F.col("retrograde").alias("is_retrograde"), F.round(F.degrees("dec"), 4).alias("declination"))


def upcoming(as_of: DataFrame, days: int = 30, orb: float = 1.0, most: int = 50, longitude: str = "lon") -> DataFrame:
    """The first most aspects within orb at the begin of the days days from each ts of as_of: (as_of, rank, ts, days_from_now, body_a, body_b, aspect, orb), by day, pair and aspect."""
    dates = as_of.select(F.col("ts").alias("as_of")).distinct().select("as_of", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("days_from_now"))
    dates = dates.withColumn("ts", F.timestamp_add("DAY", F.col("days_from_now"), F.col("as_of")))
    rows = angles(dates, ["as_of", "days_from_now", "ts"], longitude).select("*", F.explode(kinds()).alias("s")).withColumn("orb", F.abs(F.col("angle") - F.col("s.exact"))).where(F.col("orb") <= orb)
    rank = F.row_number().over(Window.partitionBy("as_of").orderBy("days_from_now", "i", "j", "s.k"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select("as_of", "rank", "ts", "days_from_now", "body_a", "body_b", "s.aspect", F.round("orb", 2).alias("orb"))


def exact_aspects(dates: DataFrame, longitude: str = "lon", steps: int = 4) -> DataFrame:
    """When aspects become exact in the day from each ts of dates: (ts, body_a, body_b, aspect, exact_ts, error).

    Where the difference of longitudes less the aspect's angle (either way round) changes its sign within the day, the root is bracketed
    and refined by steps of false position, each of which works out both bodies anew at the point between; error is what is left, in degrees.
    """
    t = centuries(F.col("ts"))
    ends = placed(placed(of_bodies(dates.select("ts").distinct()), "place", t, "now"), "place", t + DAY, "next")
    ends = ends.select("ts", "place", "body", F.col(f"now_{longitude}").alias("now"), F.col(f"next_{longitude}").alias("next"))
    rows = in_pairs(ends, ["ts"], ["now", "next"])
    rows = rows.select("*", F.explode(kinds(ways=True)).alias("s")).withColumn("f0", wrapped(F.col("now_a") - F.col("now_b") - F.col("s.exact"))).withColumn("f1", wrapped(F.col("next_a") - F.col("next_b") - F.col("s.exact")))
    rows = rows.where((F.abs("f0") < 90) & (F.abs("f1") < 90) & ((F.col("f0") == 0) | (F.col("f0") * F.col("f1") < 0)))
    kept = ["ts", "i", "j", "body_a", "body_b", "s"]
    rows = rows.select(*kept, t.alias("t0"), (t + DAY).alias("t1"), "f0", "f1")
    for _ in range(steps):
        rows = rows.withColumn("t", F.coalesce(F.col("t0") - F.col("f0") * F.try_divide(F.col("t1") - F.col("t0"), F.col("f1") - F.col("f0")), "t0"))
        rows = placed(placed(rows, "i", F.col("t"), "a"), "j", F.col("t"), "b").withColumn("f", wrapped(F.col(f"a_{longitude}") - F.col(f"b_{longitude}") - F.col("s.exact"))).withColumn("_left", F.signum("f") == F.signum("f0"))
        pick = lambda x, y, n: F.when(F.col("_left"), F.col(x)).otherwise(F.col(y)).alias(n)
        rows = rows.select(*kept, "t", "f", pick("t", "t0", "t0"), pick("f", "f0", "f0"), pick("t1", "t", "t1"), pick("f1", "f", "f1"))
    seconds = F.round((F.col("t") - centuries(F.col("ts"))) * (86400.0 * 36525)).cast("int")
    return rows.select("ts", "body_a", "body_b", "s.aspect", F.timestamp_add("SECOND", seconds, F.col("ts")).alias("exact_ts"), F.abs("f").alias("error"))
