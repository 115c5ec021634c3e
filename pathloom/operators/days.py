"""Days: episodes sliced at local midnight and summed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import Params

#: A day's pairs of columns (minutes, pieces), and the types of episodes in them.
KINDS = {"unknown": ("unknown_time", "unknown_count"), "travel": ("travel_time", "trip_count"), "home": ("home_time", "home_count"), "work": ("work_time", "work_count"), "school": ("school_time", "school_count"), "other": ("other_time", "other_count")}


#: A timestamp without a zone, so that the session's own zone has no say.
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def utc(seconds: Column) -> Column:
    """An instant as a wall-clock time at longitude 0, to the microsecond."""
    return F.expr(EPOCH) + F.make_dt_interval(secs=F.round(seconds.cast("double"), 6).cast("decimal(18,6)"))


def local(seconds: Column, p: Params) -> Column:
    """Local wall-clock time of an instant."""
    return F.convert_timezone(F.lit("UTC"), F.lit(p.zone), utc(seconds))


def day_of(seconds: Column, p: Params) -> Column:
    """The date that an instant belongs to, where days begin day_start_hour hours after midnight."""
    return F.to_date(local(seconds, p) - F.expr(f"interval {p.day_start_hour} hours"))


def day_start(date: Column, p: Params) -> Column:
    """The instant at which a local day begins, in seconds: 23, 24 or 25 hours before the next day does."""
    begin = date.cast("timestamp_ntz") + F.expr(f"interval {p.day_start_hour} hours")
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), F.convert_timezone(F.lit(p.zone), F.lit("UTC"), begin)) / 1e6


def local_text(seconds: Column, p: Params) -> Column:
    """An instant as local time with its offset, 2017-11-05 01:30:00-04:00; a part of a second has six digits."""
    here = local(seconds, p)
    minutes = F.timestamp_diff("MINUTE", utc(seconds), here)
    whole, part = F.date_format(here, "yyyy-MM-dd HH:mm:ss"), F.date_format(here, ".SSSSSS")
    offset = F.format_string("%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(F.abs(minutes) / 60), F.abs(minutes) % 60)
    return F.concat(whole, F.when(part == ".000000", "").otherwise(part), offset)


def day_slices(episodes: DataFrame, p: Params) -> DataFrame:
    """(user_id, sequence, type, date, minutes) for every date that an episode with a duration touches, its end's included, so an episode that ends
    at midnight has an empty piece after it. Minutes lie between instants: a day on which clocks change has 23 or 25 hours, and an episode's pieces
    add up to its duration."""
    q = episodes.where("duration is not null").withColumns({"a": F.col("start").cast("double"), "b": F.col("start") + F.col("duration")})
    q = q.withColumns({"d1": day_of(F.col("a"), p), "d2": day_of(F.col("b"), p)}).where("d2 >= d1").withColumn("date", F.explode(F.sequence("d1", "d2")))
    low, high = F.greatest("a", day_start(F.col("date"), p)), F.least("b", day_start(F.date_add("date", 1), p))
    return q.select("user_id", "sequence", "type", "date", ((high - low) / 60).alias("minutes"))


def day_summary(slices: DataFrame) -> DataFrame:
    """One row per user and date with minutes and pieces in total and by type; dow counts from Monday, 0."""
    sums = [F.sum("minutes").alias("total_time"), F.count("*").alias("total_count")]
    for kind, (time, count) in KINDS.items():
        sums += [F.sum(F.when(F.col("type") == kind, F.col("minutes")).otherwise(0.0)).alias(time), F.count_if(F.col("type") == kind).alias(count)]
    return slices.groupBy("user_id", "date").agg(*sums).withColumn("dow", F.weekday("date"))
