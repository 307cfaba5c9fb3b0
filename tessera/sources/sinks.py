"""Writers of corpora and run logs."""

from __future__ import annotations

import json
import uuid
from datetime import date, datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_file_name(name: str) -> str:
    """Return a corpus file's name, with one ``.json`` at its end."""
    return name.replace(".json", "") + ".json"


def write_corpus(df: DataFrame, path: str) -> None:
    """Write (``dataset``, ``idx``, ``text``) as Parquet, partitioned by data set."""
    df.write.mode("overwrite").partitionBy("dataset").parquet(path)


def export_corpora(df: DataFrame, path: str, ascii_only: bool = True) -> None:
    """Write each data set as JSON lists of strings, in order of ``idx``, one folder for each.

    A file is written by one task, row by row: rows are range-sorted within the data set and
    streamed, so no list is held. For exchange only; ``write_corpus`` is the store.
    """

    def quote(batches):
        import pandas as pd

        for pdf in batches:
            pdf["value"] = [json.dumps(t, ensure_ascii=ascii_only) for t in pdf["text"]]
            yield pd.DataFrame({"dataset": pdf["dataset"], "value": pdf["value"], "idx": pdf["idx"]})

    quoted = df.select("dataset", "idx", "text").mapInPandas(quote, "dataset string, value string, idx long")
    last = quoted.groupBy("dataset").agg(F.max("idx").alias("last"), F.min("idx").alias("first"))
    lines = quoted.join(last, "dataset").select(
        "dataset",
        "idx",
        F.concat(
            F.when(F.col("idx") == F.col("first"), "[\n").otherwise(""),
            F.lit("    "),
            "value",
            F.when(F.col("idx") == F.col("last"), "\n]").otherwise(","),
        ).alias("value"),
    )
    placed = lines.repartition("dataset").sortWithinPartitions("dataset", "idx").select("dataset", "value")
    placed.write.mode("overwrite").partitionBy("dataset").text(path)


def serializable(value: Any) -> Any:
    """Return a value as JSON can hold it: dates as ISO, arrays as lists, objects as their fields."""
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    if hasattr(value, "tolist"):
        return value.tolist()
    if hasattr(value, "__dict__"):
        return vars(value)
    return str(value)


def as_map(config: dict[str, Any]) -> dict[str, str]:
    """Return a configuration with each value as a JSON string, for a map column."""
    return {k: v if isinstance(v, str) else json.dumps(v, default=serializable) for k, v in config.items()}


def write_run_logs(df: DataFrame, path: str) -> None:
    """Append run logs as JSON lines; each gets an id and a time, so none replaces another."""
    stamped = df.withColumn("run_id", F.lit(uuid.uuid4().hex)).withColumn("run_ts", F.current_timestamp())
    stamped.write.mode("append").json(path)
