"""Text cleaning as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space of Unicode, as a Java character class.
SPACE = r"[\t-\r\x1c-\x20\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# The section markers at which an encyclopedia page is cut, in this order. Two of
# the original list's entries are one string, and some have no line feed; results depend on that.
MARKERS = [
    "\n参考", "\n注释", "\n注脚", "\n脚注", "\n参考资料", "\n参考文献", "\n参考来源", "\n资料来源", "\n参见", "\n外部链接",
    "\nReferences", "\n来源", "\n^ ",
    "\nReferencias", "\n↑ ",
    "\nWeblinks", "\nEinzelnachweise", "\nLiteratur\nRéférences", "\nLiens externes", "\nArticles connexes",
    "\nArticles connexes", "\nNotes et références", "Références",
    "\nReferences", "\n^ ",
    "المراجع", "المصادر", "المصادn", "المراجع", "انظر أيضًا", "مراجع", "مصادر",
]

#: The same list with the joined entry split and every marker at the start of a line.
LINE_MARKERS = list(
    dict.fromkeys("\n" + part for m in MARKERS for part in m.strip("\n").split("\n"))
)


def char_length(c: Column) -> Column:
    """Count code points."""
    return F.length(c)


def byte_length(c: Column) -> Column:
    """Count UTF-8 bytes."""
    return F.octet_length(c)


def truncate(c: Column, n: int) -> Column:
    """Keep the first ``n`` code points."""
    return F.substring(c, 1, n)


def cut(c: Column, begin: int, end: int) -> Column:
    """Keep code points ``begin`` (from 0) up to but not including ``end``."""
    return F.substring(c, begin + 1, end - begin)


def collapse_newlines(c: Column) -> Column:
    """Make each run of line feeds one line feed."""
    return F.regexp_replace(c, "\n+", "\n")


def drop_brackets(c: Column) -> Column:
    """Remove square brackets and what is between them, within a line."""
    return F.regexp_replace(c, r"\[[^\n]*?\]", "")


def cut_at_markers(c: Column, markers: Sequence[str] = tuple(MARKERS)) -> Column:
    """Cut at the first occurrence of each marker, one marker after another."""

    def step(acc: Column, marker: Column) -> Column:
        at = F.instr(acc, marker)
        return F.when(at > 0, F.substring(acc, F.lit(1), at - 1)).otherwise(acc)

    return F.aggregate(F.array(*map(F.lit, markers)), c, step)


def strip(c: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def collapse_whitespace(c: Column) -> Column:
    """Make each run of white space one space and strip."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def drop_tags(c: Column) -> Column:
    """Remove angle brackets and what is between them, across lines."""
    return F.regexp_replace(c, "<[^>]*>", "")


def close_punctuation(c: Column) -> Column:
    """Remove white space before punctuation and strip."""
    return strip(F.regexp_replace(c, rf"{SPACE}+([,.!?;:])", "$1"))


def strip_newlines(c: Column) -> Column:
    """Remove line feeds."""
    return F.replace(c, F.lit("\n"), F.lit(""))


def collapse_spaces(c: Column) -> Column:
    """Make each run of spaces one space."""
    return F.regexp_replace(c, " +", " ")


def drop_invalid(c: Column) -> Column:
    """Replace invalid UTF-8 and remove the replacement characters that this adds."""
    return F.when(F.is_valid_utf8(c), c).otherwise(F.replace(F.make_valid_utf8(c), F.lit("\ufffd"), F.lit("")))


def letter_count(c: Column) -> Column:
    """Count ASCII letters."""
    return F.length(c) - F.length(F.regexp_replace(c, "[a-zA-Z]", ""))


def basename(c: Column) -> Column:
    """Return what follows the last slash."""
    return F.substring_index(c, "/", -1)


def owner_and_repo(c: Column) -> tuple[Column, Column]:
    """Return the last two parts of an address."""
    parts = F.split(c, "/")
    return F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1))


def starts_with_any(c: Column, prefixes: Sequence[str]) -> Column:
    """Tell whether the string starts with one of the prefixes."""
    return reduce(lambda a, b: a | b, (F.startswith(c, F.lit(p)) for p in prefixes), F.lit(False))


def work_id(c: Column) -> Column:
    """Return the id in a link to a work, without its chapters."""
    return basename(F.substring_index(c, "/chapters", 1))


def fill_template(template: Column | str, values: dict[str, Column | str]) -> Column:
    """Replace ``<KEY>`` by its value for each key."""
    out = F.lit(template) if isinstance(template, str) else template
    for key, value in values.items():
        out = F.replace(out, F.lit(f"<{key}>"), F.lit(value) if isinstance(value, str) else value)
    return out


def join_paragraphs(paragraphs: Column) -> Column:
    """Join an array of paragraphs without a separator; no-break spaces become line feeds."""
    joined = F.array_join(F.transform(paragraphs, lambda p: F.translate(p, "\u00a0", "\n")), "")
    return strip(collapse_newlines(joined))


def header_label(c: Column) -> Column:
    """Let a long data set name break after underscores and drop its file ending."""
    return F.replace(F.replace(c, F.lit(".json"), F.lit("")), F.lit("_"), F.lit("_\u200b"))


def words(c: Column) -> Column:
    """Return the runs of characters that are not white space."""
    return F.array_remove(F.split(collapse_whitespace(c), " "), "")


def characters(c: Column) -> Column:
    """Return the code points as one-character strings."""
    return F.filter(F.split(c, ""), lambda x: x != "")


TOKENIZERS = {"word": words, "char": characters}


def repr_bytes(c: Column) -> Column:
    """Count the UTF-8 bytes of a string as Python writes it in a list, with quotes and escapes.

    Kept for comparison with old statistics; ``byte_length`` is the size of the text.
    """
    return F.pandas_udf(lambda s: s.map(lambda x: len(repr(x).encode("utf-8", "backslashreplace"))).astype("int64"), "long")(c)
