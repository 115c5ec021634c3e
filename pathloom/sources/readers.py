"""Sources: coordinate, survey, prompt, episode and location files as CSV, stations as OpenStreetMap XML, and traces derived from an event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = "uuid string, timestamp_epoch bigint, h_accuracy double, longitude double, latitude double"
PROMPTS = "id int, uuid string, response string, latitude double, longitude double, displayed_at_UTC string, recorded_at_UTC string, prompt_num int, displayed_at_epoch bigint, recorded_at_epoch bigint"
EPISODES = "user_id string, sequence int, location_id string, mode string, unknown string, local_start_time string, unix_start_time double"
LOCATIONS = "user_id string, location_id int, lon double, lat double, description string, used string"
#: Survey columns of each kind of place, in the order in which names are joined.
PLACES = {"home": "home", "work": "work", "school": "study"}


def by_header(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of schema found by their header names, in any order and among any others; null where the file has no such column."""
    raw = spark.read.csv(path, header=True, mode="FAILFAST", enforceSchema=False)
    names = {c.lower(): c for c in raw.columns}
    kinds = T._parse_datatype_string(schema)
    return raw.select(*[(F.col(f"`{names[f.name.lower()]}`") if f.name.lower() in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds])


def coordinates(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, t, ord, acc, lon, lat); ord is the row's place in the input, which decides ties in time."""
    raw = by_header(spark, path, POINTS).withColumn("ord", F.monotonically_increasing_id())
    return raw.select(F.col("uuid").alias("user_id"), F.col("timestamp_epoch").alias("t"), "ord", F.col("h_accuracy").alias("acc"), F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))


def survey(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, name, lon, lat): up to three places a user from the user's last row; a blank or missing longitude is no place."""
    columns = ", ".join(f"location_{c}_{x} double" for c in PLACES.values() for x in ("lon", "lat"))
    raw = by_header(spark, path, f"uuid string, {columns}").withColumn("ord", F.monotonically_increasing_id())
    last = raw.groupBy("uuid").agg(F.max_by(F.struct(*raw.columns[1:-1]), "ord").alias("s"))
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"s.location_{c}_lon").alias("lon"), F.col(f"s.location_{c}_lat").alias("lat")) for n, c in PLACES.items()])
    return last.select(F.col("uuid").alias("user_id"), F.inline(each)).where("lon is not null")


def prompts(spark: SparkSession, path: str) -> DataFrame:
    return by_header(spark, path, PROMPTS)


def episodes(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, sequence, location_id, unknown, start): the time is taken by its name, as a number; a location called None is none."""
    raw = by_header(spark, path, EPISODES)
    return raw.select("user_id", "sequence", F.when(F.col("location_id") != "None", F.col("location_id")).cast("int").alias("location_id"), (F.col("unknown") == "True").alias("unknown"), F.col("unix_start_time").alias("start")).fillna({"unknown": False})


def locations(spark: SparkSession, path: str) -> DataFrame:
    return by_header(spark, path, LOCATIONS)


def stations(spark: SparkSession, path: str) -> DataFrame:
    """(lon, lat) of nodes tagged railway=station and station=subway in OpenStreetMap XML; coordinates have seven decimals."""
    tag = "tag array<struct<_k: string, _v: string>>"
    raw = spark.read.format("xml").option("rowTag", "node").schema(f"_id bigint, _lat double, _lon double, {tag}").load(path)
    has = lambda k, v: F.exists("tag", lambda t: (t["_k"] == k) & (t["_v"] == v))
    return raw.where(has("railway", "station") & has("station", "subway")).select(F.round("_lon", 7).alias("lon"), F.round("_lat", 7).alias("lat"))


def gps_from_events(events: DataFrame) -> DataFrame:
    """Traces with stays, trips, jitter and outliers from an event table: (user_id, t, ord, acc, lon, lat, place)."""
    whole = lambda a, n: F.expr(f"{a} div {n}")
    rel = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 10000000.0)
    e = events.select("event_id", "event_type", "value", whole("user_id", 5).alias("trace_id"), rel.alias("rel"))
    e = e.select("*", whole("rel", 14400).alias("blk"), (F.col("rel") % 14400).alias("off"))
    place = (F.col("blk") * 7 + F.col("trace_id") * 3) % 4
    before = ((F.col("blk") - 1) * 7 + F.col("trace_id") * 3 + 28) % 4
    e = e.select("*", place.alias("place"), before.alias("prev_place"), F.least(F.lit(1.0), F.col("off") / 3600.0).alias("frac"))
    still = (F.col("event_type") == "signup") & (F.col("frac") == 1)

    def jitter(n: int, half: int) -> Column:
        return F.when(still, 0.0).otherwise((F.col("event_id") % n - half) * 0.00001)

    lon = F.round(-79.40 + 0.008 * (F.col("prev_place") + F.col("frac") * (F.col("place") - F.col("prev_place"))) + jitter(11, 5), 7)
    lat = F.round(43.65 + 0.001 * (F.col("trace_id") % 10) + F.when(F.col("event_id") % 37 == 0, 0.004).otherwise(0.0) + jitter(7, 3), 7)
    return e.select(F.col("trace_id").alias("user_id"), (F.lit(1704067200) + F.col("rel")).alias("t"), F.col("event_id").alias("ord"), F.col("value").alias("acc"), lon.alias("lon"), lat.alias("lat"), "place")
