"""Transports against recorded answers."""

import base64
import json

import pytest

from tessera.sources import sites
from tessera.sources.sites import Answer
from tessera.sources.web import NEWS_PREFIXES, register

ANSWERS: dict[str, list] = {}
ASKED: list = []


def fetch(request, proxy):
    """Answer by the first key that the address contains; a list is used up, its last answer stays."""
    ASKED.append((request, proxy))
    for key, answers in ANSWERS.items():
        if key in request.address:
            found = answers.pop(0) if len(answers) > 1 else answers[0]
            if isinstance(found, Exception):
                raise found
            return found
    return Answer(404)


@pytest.fixture(autouse=True)
def clean():
    ANSWERS.clear()
    ASKED.clear()


OPTIONS = {"fetch": "tests.test_sites:fetch", "backoff": "0", "attempts": "3"}


def ok(x):
    return Answer(200, x if isinstance(x, bytes) else x.encode() if isinstance(x, str) else json.dumps(x).encode())


def all_rows(transport, options, partition):
    rows, token = [], None
    while True:
        more, token = transport(OPTIONS | options, partition, token)
        rows += more
        if token is None:
            return rows


def test_encyclopedia():
    page = lambda *t: {"query": {"recentchanges": [{"title": x, "timestamp": "T"} for x in t]}}
    ANSWERS["rccontinue"] = [ok(page("c"))]
    ANSWERS["de.wiki"] = [Answer(503), OSError("lost"), ok(page("a", "b") | {"continue": {"rccontinue": "1|2", "continue": "-||"}})]
    got = all_rows(sites.new_pages, {"start": "2025-01-01T00:00:00Z", "end": "2025-01-02T00:00:00Z"}, "german")
    assert [r["title"] for r in got] == ["a", "b", "c"]
    assert ASKED[0][0].params["rctype"] == "new" and ASKED[-1][0].params["continue"] == "-||"
    ANSWERS["fr.wiki"] = [ok({"error": {"code": "x"}})]
    with pytest.raises(RuntimeError):
        all_rows(sites.new_pages, {"start": "", "end": ""}, "french")
    ANSWERS["page=One"] = [ok({"parse": {"text": {"*": "<p>x</p>"}}})]
    ANSWERS["page=Two"] = [ok({"error": {}})]
    got = all_rows(sites.page_html, {}, json.dumps(["chinese", ["One", "Two", "Three"]]))
    assert [r["html"] for r in got] == ["<p>x</p>", None, None]
    assert ASKED[-1][0].params["variant"] == "zh-cn"


def test_news():
    link = NEWS_PREFIXES[0] + "c1"
    ANSWERS["start=0&"] = [ok(f'<a href="{link}">x</a><a href="/other">y</a>')]
    ANSWERS["start="] = [ok("<p>none</p>")]
    options = {"search": "https://search.example/?start=<START>&d=<DATE>", "empty": "2"}
    assert all_rows(sites.news_links, options, "1/2/2025") == [{"link": link}]
    assert len(ASKED) == 3
    data = {"props": {"pageProps": {"page": {"@": {"contents": [{"type": "image"}, {"type": "text", "model": {"blocks": [{"model": {"text": "A"}}, {"model": {"text": "B"}}]}}]}}}}}
    ANSWERS["/good"] = [ok(f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(data)}</script>')]
    ANSWERS["/bad"] = [ok("<p></p>")]
    got = all_rows(sites.news_text, {}, json.dumps(["https://n.example/good", "https://n.example/bad", "https://n.example/gone"]))
    assert [r["text"] for r in got] == ["A\nB", None, None]


def test_papers():
    item = '<li class="arxiv-result"><a href="https://p.example/pdf/1">pdf</a><a href="/x">other</a></li>'
    ANSWERS["start=0"] = [ok(item)]
    ANSWERS["start=50"] = [Answer(500)]
    ANSWERS["start=100"] = [ok(item.replace("/1", "/2"))]
    ANSWERS["start=150"] = [ok("<p></p>")]
    options = {"start": "2025-01-01", "end": "2025-01-09", "size": "50"}
    assert all_rows(sites.paper_links, options, "physics") == [{"link": "https://p.example/src/1"}, {"link": "https://p.example/src/2"}]
    assert "classification-physics" in ASKED[0][0].params
    with pytest.raises(ValueError):
        all_rows(sites.paper_links, options | {"size": "20"}, "physics")
    ANSWERS["/src/1"] = [Answer(200, b"data", {"Content-Type": "application/gzip"})]
    ANSWERS["/src/2"] = [Answer(200, b"data", {"Content-Type": "application/pdf"})]
    got = all_rows(sites.paper_archive, {}, json.dumps(["https://p.example/src/1", "https://p.example/src/2"]))
    assert [r["content"] for r in got] == [b"data", None]


def test_works():
    ANSWERS["search"] = [ok('<ol class="work index group"><li class="work blurb group"><a href="/works/7/chapters/9">a</a></li></ol>')]
    assert all_rows(sites.work_ids, {"age": "10-24+days"}, "3") == [{"work_id": "7"}]
    ANSWERS["works/7"] = [ok('<div id="chapters"><div class="userstuff"><p>One</p><p> Two</p></div></div>')]
    assert all_rows(sites.work_text, {}, json.dumps(["7", "8"])) == [{"work_id": "7", "text": "One\nTwo"}, {"work_id": "8", "text": None}]


def test_code():
    repos = [{"html_url": f"https://c.example/o/r{i}", "default_branch": "main"} for i in range(101)]
    ANSWERS["&page=1"] = [ok({"items": repos[:100]})]
    ANSWERS["&page=2"] = [ok({"items": repos[100:]})]
    got = all_rows(sites.repositories, {"token": "t", "language": "cpp"}, json.dumps(["2025-01-01", "2025-01-02"]))
    assert len(got) == 101 and ASKED[0][0].headers["Authorization"] == "token t" and "C++" in ASKED[0][0].params["q"]
    ANSWERS["git/trees"] = [ok({"tree": [{"path": "a/b.py"}, {"path": "c.txt"}]})]
    got = all_rows(sites.repository_files, {"language": "python"}, json.dumps(["https://c.example/o/r1", "main"]))
    assert got == [{"html_url": "https://c.example/o/r1", "path": "a/b.py"}]
    ANSWERS["contents/good"] = [ok({"content": base64.b64encode("é".encode()).decode()})]
    ANSWERS["contents/bad"] = [ok({"content": "/////w=="})]
    got = all_rows(sites.file_content, {}, json.dumps(["o/r1", ["good.py", "bad.py", "none.py"]]))
    assert [r["content"] for r in got] == ["é", None, None]


def test_in_the_paged_source(spark):
    register(spark)
    source = spark.read.format("paged").schema("title string, timestamp string").option("transport", "tessera.sources.sites:new_pages")
    for key, value in {"fetch": "tests.recorded:fetch", "start": "a", "end": "b", "partitions": '["english", "german"]', "proxies": "tests.recorded:Own"}.items():
        source = source.option(key, value)
    want = [f"{host}.wikipedia.org via {page}" for host in ("de", "en") for page in (1, 2)]
    assert sorted(r["title"] for r in source.load().collect()) == want
