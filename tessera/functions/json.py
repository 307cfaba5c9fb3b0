"""Paths into JSON documents, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CONTENTS = "array<struct<type:string,model:struct<blocks:array<struct<model:struct<text:string>>>>>>"


def news_text(c: Column) -> Column:
    """Join the text blocks of a news page's data by line feeds; null if the path is missing.

    The path goes through the first key under ``page``, whatever its name.
    """
    pages = F.from_json(F.get_json_object(c, "$.props.pageProps.page"), "map<string,string>")
    first = F.try_element_at(F.map_values(pages), F.lit(1))
    contents = F.from_json(F.get_json_object(first, "$.contents"), _CONTENTS)
    blocks = F.flatten(F.transform(F.filter(contents, lambda x: x["type"] == "text"), lambda x: x["model"]["blocks"]))
    return F.array_join(F.transform(blocks, lambda b: b["model"]["text"]), "\n")


def field_of_each(c: Column, path: str, field: str) -> Column:
    """Return a field of each object of the array at ``path``; an empty array if it is missing."""
    rows = F.from_json(F.get_json_object(c, path), f"array<struct<`{field}`:string>>")
    return F.coalesce(F.transform(rows, lambda r: r[field]), F.array().cast("array<string>"))


def base64_text(c: Column) -> Column:
    """Decode base64 to text; null if it is not base64 or not UTF-8."""
    return F.try_validate_utf8(F.try_to_binary(c, F.lit("base64")).cast("string"))
