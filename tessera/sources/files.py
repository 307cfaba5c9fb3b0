"""Corpora, run logs and archives in files."""

from __future__ import annotations

import io
import tarfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schema import RUN_LOG


def dataset_name(file_name: F.Column) -> F.Column:
    """Return a data set's name: the file's base name without its ending."""
    return F.regexp_replace(F.substring_index(file_name, "/", -1), r"\.json$", "")


def dataset_fields(df: DataFrame) -> DataFrame:
    """Split ``dataset`` names of the form site_variant_STARTtoEND into columns."""
    pattern = r"^([^_]+)_(.*)_(\d{8})to(\d{8})$"
    part = lambda i: F.regexp_extract("dataset", pattern, i)
    return df.select(
        "*",
        part(1).alias("site"),
        part(2).alias("variant"),
        F.try_to_date(F.nullif(part(3), F.lit("")), "yyyyMMdd").alias("start_date"),
        F.try_to_date(F.nullif(part(4), F.lit("")), "yyyyMMdd").alias("end_date"),
    )


def read_corpora(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Read JSON arrays of strings, a file or a folder of them, as (``dataset``, ``idx``, ``text``).

    Positions are kept. Elements that are not strings become null; a file that is no array
    gives no rows. Below a folder ``dataset=NAME`` a file belongs to the data set of that name.
    """
    rows = _lists(spark, path, glob).select("dataset", F.posexplode("list").alias("idx", "element"))
    return rows.select("dataset", "idx", _string("element").alias("text"))


def _lists(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Return (``dataset``, ``list``) of each file: its elements as variants, or null if it is no list."""
    files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path, wholetext=True)
    folder = F.nullif(F.regexp_extract(F.col("_metadata.file_path"), r"/dataset=([^/]+)/[^/]*$", 1), F.lit(""))
    name = F.coalesce(folder, dataset_name(F.col("_metadata.file_name")))
    return files.select(name.alias("dataset"), F.from_json("value", "array<variant>", {"mode": "PERMISSIVE"}).alias("list"))


def _string(element: str) -> F.Column:
    return F.when(F.schema_of_variant(element) == "STRING", F.try_variant_get(element, "$", "string"))


def preview_corpora(spark: SparkSession, path: str, n: int = 10, glob: str = "*.json") -> DataFrame:
    """Return the first ``n`` elements of each list as (``dataset``, ``idx``, ``text``, ``length``, ``error``).

    ``error`` names the type of an element that is no string, and is "no list" for a file that is none.
    """
    rows = _lists(spark, path, glob).select(
        "dataset", F.col("list").isNull().alias("broken"), F.posexplode_outer(F.slice("list", 1, n)).alias("idx", "element")
    )
    kind = F.schema_of_variant("element")
    error = F.when(F.col("broken"), "no list").when(F.col("idx").isNotNull() & F.coalesce(kind != "STRING", F.lit(True)), F.coalesce(kind, F.lit("VOID")))
    text = _string("element")
    return rows.filter("broken or idx is not null").select("dataset", "idx", text.alias("text"), F.length(text).alias("length"), error.alias("error"))


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """Read a folder of run logs; keys that a log lacks are null.

    A file holds one object, over as many lines as it likes, or one object a line.
    """
    files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    objects = F.split(F.regexp_replace("value", r"\}\s*\n\s*\{", "}\u0001{"), "\u0001")
    rows = files.select(F.explode(objects).alias("value"), F.col("_metadata.file_modification_time").alias("run_ts"))
    parsed = rows.filter(F.trim("value") != "").select(
        F.from_json("value", RUN_LOG, {"allowNonNumericNumbers": "true"}).alias("log"), "run_ts"
    )
    return parsed.select("log.*", "run_ts")


def read_archives(spark: SparkSession, path: str, ending: str = ".tex") -> DataFrame:
    """Read gzipped tar archives as (``archive``, ``ord``, ``path``, ``content``).

    Members are read in memory and never unpacked to disk. A broken archive gives no rows, a
    member that is not UTF-8 null content.
    """
    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    return unpacked(files.select(F.col("path").alias("archive"), "content"), ending)


def unpacked(archives: DataFrame, ending: str = ".tex") -> DataFrame:
    """Unpack (``archive``, ``content``), gzipped tar archives as binary, as ``read_archives`` does."""

    def unpack(batches):
        for pdf in batches:
            rows = []
            for name, data in zip(pdf["archive"], pdf["content"]):
                try:
                    with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz") as tar:
                        for i, member in enumerate(m for m in tar if m.isfile() and m.name.endswith(ending)):
                            raw = tar.extractfile(member).read()
                            try:
                                text = raw.decode("utf-8")
                            except UnicodeDecodeError:
                                text = None
                            rows.append((name, i, member.name, text))
                except (tarfile.ReadError, EOFError, OSError):
                    continue
            yield pd.DataFrame(rows, columns=["archive", "ord", "path", "content"])

    return archives.select("archive", "content").mapInPandas(unpack, "archive string, ord int, path string, content string")
