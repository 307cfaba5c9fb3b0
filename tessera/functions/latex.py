"""Fields of a LaTeX source, as column expressions, and an approximate conversion to text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import close_punctuation, collapse_whitespace, drop_tags

_TITLE = r"(?s)\\title\{(.*?)\}"
_ABSTRACT = r"(?s)\\begin\{abstract\}(.*?)\\end\{abstract\}"
_BODY = r"(?s)\\begin\{document\}(.*?)\\end\{document\}"


def drop_front_matter(c: Column) -> Column:
    """Remove the title command, the date and the author; braces end at the first closing one."""
    for pattern in (r"\\maketitle", r"(?s)\\date\{.*?\}", r"(?s)\\author\{.*?\}"):
        c = F.regexp_replace(c, pattern, "")
    return c


def unwrap_links(c: Column) -> Column:
    """Replace a link command by its text."""
    return F.regexp_replace(c, r"\\href\{[^\n]*?\}\{([^\n]*?)\}", "$1")


def title(c: Column) -> Column:
    """Return the title, empty if there is none."""
    return F.regexp_extract(c, _TITLE, 1)


def abstract(c: Column) -> Column:
    """Return the first abstract, empty if there is none."""
    return F.regexp_extract(c, _ABSTRACT, 1)


def without_abstract(c: Column) -> Column:
    """Remove the first abstract."""
    found = F.regexp_substr(c, F.lit(_ABSTRACT))
    at = F.instr(c, found)
    rest = F.concat(F.substring(c, F.lit(1), at - 1), F.substring(c, at + F.length(found), F.length(c)))
    return F.when(found.isNull(), c).otherwise(rest)


def body(c: Column) -> Column:
    """Return what is between the document commands, empty if there is nothing."""
    return F.regexp_extract(c, _BODY, 1)


def with_paper(df: DataFrame, source: str, out: str) -> DataFrame:
    """Add title, abstract and body, put together as plain text, as the column ``out``.

    Each part is a step of its own, so none is computed twice.
    """
    cleaned = df.withColumn("_s", unwrap_links(drop_front_matter(F.col(source))))
    c = F.col("_s")
    parts = cleaned.withColumns({"_t": title(c), "_a": abstract(c), "_b": body(without_abstract(c))}).drop("_s")
    text = collapse_whitespace(close_punctuation(drop_tags(collapse_whitespace(F.col("_b")))))
    head = F.when(F.col("_t") != "", F.concat(collapse_whitespace(F.col("_t")), F.lit("\n"))).otherwise("")
    lead = F.when(F.col("_a") != "", F.concat(F.lit("§ Abstract "), collapse_whitespace(F.col("_a")))).otherwise("")
    return parts.withColumn(out, F.concat(head, lead, text)).drop("_t", "_a", "_b")


def plain_text(s: str | None) -> str | None:
    """Convert LaTeX to text approximately: comments, commands, environments and math marks go."""
    if s is None:
        return None
    s = re.sub(r"(?<!\\)%.*", "", s)
    s = re.sub(r"\\(?:begin|end)\{[^}]*\}(?:\[[^\]]*\])?", "", s)
    s = re.sub(r"\\(?:cite|ref|label|eqref|includegraphics|bibliography\w*)\*?(?:\[[^\]]*\])*\{[^}]*\}", "", s)
    s = re.sub(r"\\(?:sub)*section\*?\{([^}]*)\}", r"\n§ \1\n", s)
    for _ in range(4):
        s = re.sub(r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1", s)
    s = re.sub(r"\\[a-zA-Z]+\*?", "", s)
    return re.sub(r"[{}$]|\\(?=[%&_#])", "", s).replace("~", " ").replace("\\\\", "\n")


def plain(source: Column) -> Column:
    """Apply ``plain_text`` to a column, in Arrow batches."""
    return F.pandas_udf(lambda s: s.map(plain_text), "string")(source)
