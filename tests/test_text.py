"""Text, date, LaTeX, HTML and JSON functions against plain Python."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import dates as D
from tessera.functions import html as H
from tessera.functions import json as J
from tessera.functions import latex as L
from tessera.functions import text as T

HARD = [
    "", " ", "a  b\u0085c d\x1ce\x0bf", "x​y", "\r\n\r\n", "a [1] b [2\n3] c", "[", "a ] [b]", "<b>x</b> <br\n/> y",
    "a ,b .c !", "emoji 😀 𝒳 é é", "\n\n\nx\n\n", "no match", "a  b   c", "x\nReferences\ny\n^ z", "Références", "مصادر x",
]


def values(spark, rows, expression):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("t"))).collect()]


@pytest.mark.parametrize(
    ("ours", "plain"),
    [
        (T.char_length, len),
        (T.byte_length, lambda s: len(s.encode())),
        (lambda c: T.truncate(c, 5), lambda s: s[:5]),
        (lambda c: T.cut(c, 2, 6), lambda s: s[2:6]),
        (T.collapse_newlines, lambda s: re.sub(r"\n+", "\n", s)),
        (T.drop_brackets, lambda s: re.sub(r"\[.*?\]", "", s)),
        (T.collapse_whitespace, lambda s: re.sub(r"\s+", " ", s).strip()),
        (T.drop_tags, lambda s: re.sub(r"<[^>]*>", "", s)),
        (T.close_punctuation, lambda s: re.sub(r"\s+([,.!?;:])", r"\1", s).strip()),
        (T.strip_newlines, lambda s: s.replace("\n", "")),
        (T.collapse_spaces, lambda s: re.sub(" +", " ", s)),
        (T.letter_count, lambda s: len(re.findall("[a-zA-Z]", s))),
        (T.words, str.split),
        (T.repr_bytes, lambda s: len(repr(s).encode())),
        (T.basename, lambda s: s.split("/")[-1]),
        (lambda c: T.join_paragraphs(F.array(c, c)), lambda s: re.sub(r"\n+", "\n", (s + s).replace(" ", "\n")).strip()),
    ],
)
def test_like_python(spark, ours, plain):
    assert values(spark, HARD, ours) == [plain(s) for s in HARD]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), min_size=1, max_size=5))
def test_whitespace_property(spark, rows):
    got = values(spark, rows, T.collapse_whitespace)
    assert got == [re.sub(r"\s+", " ", s).strip() for s in rows]
    assert values(spark, got, T.collapse_whitespace) == got


def test_markers(spark):
    def plain(s):
        for m in T.MARKERS:
            if m in s:
                s = s[: s.index(m)]
        return s

    assert values(spark, HARD, T.cut_at_markers) == [plain(s) for s in HARD]
    assert len(T.MARKERS) == 32
    assert values(spark, ["\nLiteratur x"], T.cut_at_markers) == ["\nLiteratur x"]
    assert values(spark, ["a\nLiteratur x"], lambda c: T.cut_at_markers(c, T.LINE_MARKERS)) == ["a"]


def test_addresses(spark):
    assert values(spark, ["/works/12/chapters/3", "/works/7", "x"], T.work_id) == ["12", "7", "x"]
    assert values(spark, ["ab", "b", ""], lambda c: T.starts_with_any(c, ["a", "c"])) == [True, False, False]
    assert values(spark, ["h/o/r", "r"], lambda c: T.owner_and_repo(c)[0]) == ["o", None]
    assert values(spark, ["x"], lambda c: T.fill_template("<A>-<B>", {"A": c, "B": "2"})) == ["x-2"]
    assert values(spark, ["a_b.json"], T.header_label) == ["a_​b"]


def test_dates(spark):
    row = spark.sql("select date'2024-05-03' d, date'2024-05-05' e").select(
        D.us_date(F.col("d")), D.compact(F.col("d")), F.size(D.days(F.col("d"), F.col("e"))), F.size(D.days(F.col("e"), F.col("d"))),
        D.age_window(F.col("d"), F.col("e"), F.lit("2024-05-10").cast("date")), D.day_bounds(F.col("d"))[1],
    ).first()
    assert list(row) == ["5/3/2024", "20240503", 3, 0, "5-7+days", "2024-05-03T23:59:59Z"]
    with pytest.raises(Exception, match="not a date"):
        values(spark, ["2024-13-01"], D.valid_date)
    with pytest.raises(Exception, match="earlier than today"):
        values(spark, ["2024-01-01"], lambda c: D.age_window(c.cast("date"), c.cast("date"), F.lit("2024-01-01").cast("date")))


def test_latex(spark):
    source = r"\title{A  b}\maketitle\date{x}\author{a{b}c}\begin{abstract} Q. \end{abstract}\begin{document}We , see \href{u}{it} <i>.\end{document}"
    df = L.with_paper(spark.createDataFrame([(source,), ("none",), (None,)], "s string"), "s", "p")
    assert [r["p"] for r in df.collect()] == ["A b\n§ Abstract Q.We, see it.", "", None]
    assert L.plain_text(r"\section{A} $x$ \emph{b} % c") .split() == ["§", "A", "x", "b"]
    assert L.plain_text(None) is None


def test_html():
    page = (
        '<div><p>a &amp; b</p><table><tr><td>t</td></tr></table><math>m</math><h2><span id="References">R</span></h2><ul><li>r</li></ul>tail</div>'
    )
    assert H.page_text(page) == "a & btail"
    assert H.page_text('<p class="x redirectMsg">r</p>') is None
    assert H.page_text(None) is None
    assert H.page_text("<p>broken <b>x</i>") == "broken x"
    assert H.links('<a href="u">x</a><a>y</a><a href="v?a=1&amp;b=2">') == ["u", "v?a=1&b=2"]
    works = (
        '<ol class="work index group"><li class="work blurb group"><a href="/works/1">a</a><a href="/works/2/chapters/3">b</a>'
        '<a href="/works/3?x">c</a><a href="/works/4#k">d</a><a href="/works/5/bookmarks">e</a></li></ol><a href="/works/9">n</a>'
    )
    assert H.work_links(works) == ["/works/1", "/works/2/chapters/3"]
    work = '<div id="chapter-1"><div class="userstuff module"><p>a b</p><p>c</p></div></div>'
    assert H.work_paragraphs(work) == ["a b", "c"]
    assert H.work_paragraphs("<p>x</p>") == []
    assert H.source_links('<li class="arxiv-result"><a href="x/pdf/1">pdf</a><a href="y">abs</a></li><a href="z/pdf/2">pdf</a>') == ["x/src/1"]
    assert H.embedded_json('<script id="__NEXT_DATA__" type="application/json">{"a":1}</script>') == '{"a":1}'
    assert H.embedded_json("<p>") is None


def test_json(spark):
    data = '{"props":{"pageProps":{"page":{"k":{"contents":[{"type":"text","model":{"blocks":[{"model":{"text":"a"}},{"model":{"text":"b"}}]}},{"type":"image","model":{}}]},"z":{}}}}}'
    assert values(spark, [data, "{}", "no", None], J.news_text)[0] == "a\nb"
    assert values(spark, ['{"r":[{"t":"x"},{"u":1}]}', "{}", None], lambda c: J.field_of_each(c, "$.r", "t")) == [["x", None], [], []]
    assert values(spark, ["aGk=", "/////w==", "", "?"], J.base64_text) == ["hi", None, "", None]
