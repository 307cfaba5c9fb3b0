"""Leaderboards from run logs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import basename
from tessera.operators.scoring import bits_per, compression_rate

METRICS = ("bpc", "bpb", "compression_rate", "nats_per_char")


def _number(name: str) -> Column:
    """Return a figure of a log, null where it is not a number."""
    c = F.col(f"`{name}`")
    return F.when(~F.isnan(c), c)


def metric(name: str) -> Column:
    """Return a metric of a run log; null where the log lacks a figure."""
    nll = _number("neg_log_prob_sum")
    return {
        "bpc": bits_per(nll, _number("avg character count")),
        "bpb": bits_per(nll, _number("avg bytes")),
        "compression_rate": compression_rate(nll, _number("avg bytes")),
        "nats_per_char": F.try_divide(nll, _number("avg character count")),
    }[name]


def latest(logs: DataFrame, name: str = "bpc") -> DataFrame:
    """Return the metric of each model and data set from its latest log.

    Models are told apart by their full path. Later means a greater time of the run, then of
    its arrival, then a greater id. Logs that lack the figures do not count.
    """
    value = logs.select(
        "model_name_or_path",
        basename(F.col("data_path")).alias("dataset"),
        metric(name).alias("value"),
        F.struct("run_ts", "ingested_at", "run_id").alias("when"),
    ).filter("value is not null and model_name_or_path is not null and dataset is not null")
    return value.groupBy("model_name_or_path", "dataset").agg(F.max_by("value", "when").alias("value"))


def parameters(logs: DataFrame) -> DataFrame:
    """Return the parameter count of each model from its latest log that has one."""
    known = logs.filter("model_name_or_path is not null").filter(_number("parameters count").isNotNull())
    return known.groupBy("model_name_or_path").agg(
        F.max_by("parameters count", F.struct("run_ts", "ingested_at", "run_id")).alias("parameters_b")
    )


def leaderboard(logs: DataFrame, name: str = "bpc") -> DataFrame:
    """Return the mean of each model over its data sets, its parameters and its rank.

    Models are compared on the data sets they have; ``n_datasets`` tells how many.
    """
    mean = latest(logs, name).groupBy("model_name_or_path").agg(
        F.round(F.avg("value"), 6).alias("average"), F.count("*").alias("n_datasets")
    )
    order = Window.orderBy(F.asc_nulls_last("average"), "model_name_or_path")
    return mean.join(parameters(logs), "model_name_or_path", "left").select(
        "model_name_or_path",
        basename(F.col("model_name_or_path")).alias("model"),
        "parameters_b",
        "average",
        "n_datasets",
        F.row_number().over(order).alias("position"),
    )


def top(logs: DataFrame, n: int = 7, name: str = "bpc") -> DataFrame:
    """Return the ``n`` best models."""
    mean = latest(logs, name).groupBy("model_name_or_path").agg(F.round(F.avg("value"), 6).alias("average"))
    return mean.orderBy(F.asc_nulls_last("average"), "model_name_or_path").limit(n)


def pivot(values: DataFrame, datasets: list[str], by: str = "model_name_or_path") -> DataFrame:
    """Turn (model, dataset, value) into a row for each model and a column for each data set."""
    return values.groupBy(by).pivot("dataset", datasets).agg(F.max("value"))


def profile(logs: DataFrame, n: int = 7, name: str = "bpc", low: float = 0.80, high: float = 0.95) -> DataFrame:
    """Return, for the best models, each data set's value scaled so that the best is ``high``.

    The scale is that of the best models only; where all are equal it is null. ``angle`` is the
    data set's place on a circle, in order of name.
    """
    best = latest(logs, name).join(top(logs, n, name).select("model_name_or_path"), "model_name_or_path", "left_semi")
    same = Window.partitionBy("dataset")
    spread = F.max("value").over(same) - F.min("value").over(same)
    unit = 1 - F.try_divide(F.col("value") - F.min("value").over(same), spread)
    place = F.dense_rank().over(Window.orderBy("dataset")) - 1
    scaled = best.withColumn("scaled", F.round(unit * (high - low) + low, 6))
    names = scaled.select("dataset").distinct()
    angles = names.select(
        "dataset", F.round(2 * math.pi * place / F.count("*").over(Window.partitionBy()), 6).alias("angle")
    )
    return scaled.join(angles, "dataset").select("model_name_or_path", "dataset", F.round("value", 6).alias("value"), "scaled", "angle")


def colour_position(logs: DataFrame, name: str = "bpc") -> DataFrame:
    """Return each value's place, 0 to 1, between the least and the greatest of its data set."""
    same = Window.partitionBy("dataset")
    low, high = F.min("value").over(same), F.max("value").over(same)
    return latest(logs, name).select(
        "model_name_or_path", "dataset", F.round(F.try_divide(F.col("value") - low, high - low), 6).alias("position")
    )


def colour(position: Column) -> Column:
    """Return the colour of a position: green at 0, white at the middle, red at 1."""
    part = F.least(F.greatest(position, F.lit(0.0)), F.lit(1.0))
    fade = F.when(part < 0.5, part * 2).otherwise((1 - part) * 2)
    level = F.lpad(F.lower(F.hex((fade * 255).cast("int"))), 2, "0")
    return F.when(part < 0.5, F.concat(F.lit("#"), level, F.lit("ff"), level)).otherwise(F.concat(F.lit("#ff"), level, level))


#: Upper bounds, in billions of parameters, of the size tiers.
TIERS = (("1.5B", 2.0), ("3B", 5.0), ("7B", 8.0), ("9B", 11.0), ("14B", 20.0))


def tier(count: Column) -> Column:
    """Return the size tier of a parameter count; null if it is unknown."""
    out = F.lit("larger")
    for name, bound in reversed(TIERS):
        out = F.when(count < bound, name).otherwise(out)
    return F.when(count.isNotNull(), out)


def leaderboard_by_tier(logs: DataFrame, name: str = "bpc") -> DataFrame:
    """Rank the models within their size tiers."""
    board = leaderboard(logs, name).withColumn("tier", tier(F.col("parameters_b")))
    order = Window.partitionBy("tier").orderBy(F.asc_nulls_last("average"), "model_name_or_path")
    return board.filter("tier is not null").select(
        "tier", "model_name_or_path", "average", F.row_number().over(order).alias("rank")
    )


def rank_changes(logs: DataFrame, name: str = "bpc") -> DataFrame:
    """Rank the models by month of their logs, with the change against their month before."""
    month = F.date_format("run_ts", "yyyy-MM")
    rows = logs.select("model_name_or_path", metric(name).alias("value"), month.alias("month")).filter(
        "value is not null and model_name_or_path is not null"
    )
    mean = rows.groupBy("month", "model_name_or_path").agg(F.round(F.avg("value"), 6).alias("average"))
    rank = F.row_number().over(Window.partitionBy("month").orderBy("average", "model_name_or_path"))
    ranked = mean.withColumn("rank", rank)
    before = F.lag("rank").over(Window.partitionBy("model_name_or_path").orderBy("month"))
    return ranked.select("month", "model_name_or_path", "average", "rank", (before - F.col("rank")).alias("gained"))


def html_table(df: DataFrame, caption: str, rows: int = 1000) -> str:
    """Return a small result as an HTML table, numbers with three digits."""
    head = "".join(f"<th>{c}</th>" for c in df.columns)
    lines = []
    for row in df.limit(rows).collect():
        cells = "".join(f"<td>{v:.3f}</td>" if isinstance(v, float) else f"<td>{v if v is not None else ''}</td>" for v in row)
        lines.append(f"<tr>{cells}</tr>")
    return f"<table><caption>{caption}</caption><tr>{head}</tr>{''.join(lines)}</table>"
