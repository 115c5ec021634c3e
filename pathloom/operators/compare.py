"""Scoring computed locations and episodes against known ones."""

from __future__ import annotations

import statistics

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import great_circle
from ..params import Params


def distance_matrix(truth: DataFrame, computed: DataFrame) -> DataFrame:
    """(user_id, true_id, comp_id, metres) of each pair of a user's locations (user_id, location_id, lon, lat); of repeated ids the last row."""

    def last(df: DataFrame, tag: str) -> DataFrame:
        row = F.max_by(F.struct("lon", "lat"), "_o")
        return df.withColumn("_o", F.monotonically_increasing_id()).groupBy("user_id", F.col("location_id").alias(f"{tag}_id")).agg(row.alias(tag))

    q = last(truth, "true").join(last(computed, "comp"), "user_id")
    return q.select("user_id", "true_id", "comp_id", great_circle(F.col("true.lat"), F.col("true.lon"), F.col("comp.lat"), F.col("comp.lon")).alias("metres"))


def match(pairs: list[tuple[float, int, int]], wanted: int, semantics: str) -> list[float]:
    """Distances of a greedy matching of (distance, computed, true): the smallest pair is taken off the list and those that conflict with it are
    struck, which in reference semantics passes over the pair after each one struck. Ids decide ties as texts, as they stand in the files."""
    left, out = sorted(pairs, key=lambda x: (x[0], str(x[1]), str(x[2]))), []
    while left and len(out) < wanted:
        (distance, comp, true), *left = left
        out.append(distance)
        kept, passed = [], False
        for x in left:
            struck = not passed and (x[1] == comp or x[2] == true)
            passed = struck and semantics == "reference"
            if not struck:
                kept.append(x)
        left = kept
    return out


def location_quality(truth: DataFrame, computed: DataFrame, p: Params) -> DataFrame:
    """(user_id, excess, mean_distance, median_distance) of users with both kinds of locations. A user's pairs are matched in memory."""
    size = lambda df, name: df.groupBy("user_id").agg(F.countDistinct("location_id").alias(name))
    q = distance_matrix(truth, computed).join(size(truth, "n_true"), "user_id").join(size(computed, "n_comp"), "user_id")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        n, m = int(frame["n_true"].iloc[0]), int(frame["n_comp"].iloc[0])
        found = match(list(zip(frame["metres"], frame["comp_id"], frame["true_id"], strict=True)), min(n, m), p.semantics)
        return pd.DataFrame({"user_id": [frame["user_id"].iloc[0]], "excess": [(m - n) / n], "mean_distance": [statistics.fmean(found)], "median_distance": [statistics.median(found)]})

    kind = truth.schema["user_id"].dataType.simpleString()
    return q.groupBy("user_id").applyInPandas(one, f"user_id {kind}, excess double, mean_distance double, median_distance double")


def spans(episodes: DataFrame) -> DataFrame:
    """Adds finish, the start of the user's next episode; the last has none."""
    w = Window.partitionBy("user_id").orderBy("start", "sequence")
    return episodes.withColumn("finish", F.lead("start").over(w))


def observed_window(truth: DataFrame, computed: DataFrame) -> DataFrame:
    """(user_id, low, high): what both sides cover."""
    ends = lambda df, a, b: df.groupBy("user_id").agg(F.min("start").alias(a), F.max("start").alias(b))
    q = ends(truth, "a1", "b1").join(ends(computed, "a2", "b2"), "user_id")
    return q.select("user_id", F.greatest("a1", "a2").alias("low"), F.least("b1", "b2").alias("high"))


def overlaps(truth: DataFrame, computed: DataFrame) -> DataFrame:
    """(user_id, t, c, seconds): the time that a true and a computed episode share within the observed window."""
    side = lambda df, tag: spans(df).where("finish is not null").select("user_id", F.struct("start", "finish", "location_id", "unknown").alias(tag))
    q = side(truth, "t").join(side(computed, "c"), "user_id").join(observed_window(truth, computed), "user_id")
    low, high = F.greatest("t.start", "c.start", "low"), F.least("t.finish", "c.finish", "high")
    return q.where((F.col("t.start") < F.col("c.finish")) & (F.col("c.start") < F.col("t.finish")) & (low < high)).select("user_id", "t", "c", (high - low).alias("seconds"))


def ratios(truth: DataFrame, computed: DataFrame) -> DataFrame:
    """Six ratios a user: of the unknown, travelled and stationary time the share identified, and of all other time the share taken for it. Unknown
    time counts as travelled; a ratio without a denominator is null."""
    known = lambda s: F.col(f"{s}.location_id").isNotNull()
    off = lambda s: F.col(f"{s}.unknown")
    tests = [off("t") & off("c"), ~known("t") & ~known("c"), known("t") & known("c"), off("t"), ~known("t"), known("t"), off("c") & ~off("t"), known("t") & ~known("c"), ~known("t") & known("c")]
    sums = overlaps(truth, computed).groupBy("user_id").agg(*[F.sum(F.when(x, F.col("seconds")).otherwise(0.0)).alias(f"s{i}") for i, x in enumerate(tests)])
    q = observed_window(truth, computed).join(sums, "user_id").withColumn("total", F.col("high") - F.col("low"))
    share = lambda a, b: F.try_divide(F.col(a), b)
    return q.select(
        "user_id",
        share("s0", F.col("s3")).alias("identified_unknown"),
        share("s1", F.col("s4")).alias("identified_travel"),
        share("s2", F.col("s5")).alias("identified_location"),
        share("s6", F.col("total") - F.col("s0")).alias("misidentified_unknown"),
        share("s7", F.col("total") - F.col("s1")).alias("misidentified_travel"),
        share("s8", F.col("total") - F.col("s2")).alias("misidentified_location"),
    )


def letter(unknown: Column, location: Column) -> Column:
    return F.when(unknown, "U").when(location.isNotNull(), "A").otherwise("T")


def strings(truth: DataFrame, computed: DataFrame) -> DataFrame:
    """(user_id, true_eps, comp_eps): a letter for each episode that ends within the observed window, in order. A computed one that ends with the
    window is left out if a true episode begins or ends then as well."""
    window = observed_window(truth, computed)

    def one(df: DataFrame, name: str, ends: DataFrame | None = None) -> DataFrame:
        q = spans(df).where("finish is not null").join(window, "user_id").where("finish >= low and finish <= high")
        if ends is not None:
            q = q.join(ends, "user_id", "left").where("finish < high or not coalesce(array_contains(bounds, high), false)")
        ordered = F.array_sort(F.collect_list(F.struct("start", "sequence", letter(F.col("unknown"), F.col("location_id")).alias("x"))))
        return q.groupBy("user_id").agg(F.array_join(F.transform(ordered, lambda e: e["x"]), "").alias(name))

    bounds = truth.groupBy("user_id").agg(F.collect_set("start").alias("bounds"))
    out = window.join(one(truth, "true_eps"), "user_id", "left").join(one(computed, "comp_eps", bounds), "user_id", "left")
    return out.select("user_id", F.coalesce("true_eps", F.lit("")).alias("true_eps"), F.coalesce("comp_eps", F.lit("")).alias("comp_eps"))


def report(locations: DataFrame, episode_ratios: DataFrame, texts: DataFrame) -> DataFrame:
    """The comparison table, a row a user: numbers rounded to two decimals, halves to even, with the edit distance and the lengths of the strings."""
    q = locations.join(episode_ratios, "user_id").join(texts, "user_id")
    numbers = [c for c, kind in q.dtypes if kind == "double"]
    q = q.withColumns({c: F.bround(c, 2) for c in numbers})
    return q.withColumns({"edit_distance": F.levenshtein("true_eps", "comp_eps"), "record_length": F.length("true_eps"), "computed_length": F.length("comp_eps")})


#: The columns of the comparison file, in order, and those of report() that they are taken from.
COMPARISON = {
    "user": "user_id",
    "percent_excess_locations": "excess",
    "mean_distance": "mean_distance",
    "median_distance": "median_distance",
    "percent_identified_unknown": "identified_unknown",
    "percent_identified_travel": "identified_travel",
    "percent_identified_location": "identified_location",
    "percent_misidentified_unknown": "misidentified_unknown",
    "percent_misidentified_travel": "misidentified_travel",
    "percent_misidentified_location": "misidentified_location",
    "true_eps": "true_eps",
    "comp_eps": "comp_eps",
    "edit_distance": "edit_distance",
    "record_length": "record_length",
    "computed_length": "computed_length",
}


def comparison_table(found: DataFrame) -> DataFrame:
    """report() under the names of the comparison file."""
    return found.select(*[F.col(v).alias(k) for k, v in COMPARISON.items()])


def write_comparison(found: DataFrame, path: str) -> None:
    """The comparison file, in order of user: a row a user, so one task writes it."""
    comparison_table(found).coalesce(1).sortWithinPartitions("user").write.mode("overwrite").csv(path, header=True)


def timeline(truth: DataFrame, computed: DataFrame) -> DataFrame:
    """(user_id, side, sequence, start, finish, class): the episodes of both sides that have an end, to be drawn one above the other."""
    one = lambda df, side: spans(df).where("finish is not null").select("user_id", F.lit(side).alias("side"), "sequence", "start", "finish", letter(F.col("unknown"), F.col("location_id")).alias("class"))
    return one(truth, "truth").unionByName(one(computed, "computed"))


def only_in_truth(truth: DataFrame, computed: DataFrame) -> DataFrame:
    """Users that nothing was computed for."""
    return truth.select("user_id").distinct().join(computed, "user_id", "left_anti")


def mark_repeated_lines(lines: DataFrame, mark: str = " *") -> DataFrame:
    """Adds marked: the value of (line_no, value), with the mark from its second time on."""
    w = Window.partitionBy("value").orderBy("line_no")
    return lines.withColumn("marked", F.when(F.row_number().over(w) > 1, F.concat("value", F.lit(mark))).otherwise(F.col("value")))
