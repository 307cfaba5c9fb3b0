"""Transports of the five kinds of sites for the ``paged`` source: requests, paging and parsing.

A transport never touches the network itself. The option ``fetch`` (module:function) sends a
``Request`` and returns an ``Answer``; or else the option ``answers`` names a folder of recorded answers
(Parquet with ``address``, ``status``, ``body``). Failures of a
page give its rows with null values or none, as each transport says; the source retries lost
connections and the statuses in ``Retry.statuses``, or those of the option ``statuses``.

| Transport | Partition | Token | Rows |
|---|---|---|---|
| ``new_pages`` | language | continuation, as JSON | language, title, timestamp |
| ``page_html`` | JSON of language and titles | - | title, html |
| ``news_links`` | date M/D/YYYY | first result | link |
| ``news_text`` | JSON list of addresses | - | link, text |
| ``paper_links`` | subject | first result | link |
| ``paper_archive`` | JSON list of addresses | - | link, content |
| ``work_ids`` | page number | - | work_id |
| ``work_text`` | JSON list of ids | - | work_id, text |
| ``repositories`` | JSON of two days | page number | html_url, default_branch |
| ``repository_files`` | JSON of address and branch | - | html_url, path |
| ``file_content`` | JSON of repository and paths | - | path, content |
"""

from __future__ import annotations

import base64
import json
import re
from dataclasses import dataclass, field
from functools import partial
from urllib.parse import quote, urlencode

import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs

from tessera.functions import html as H
from tessera.sources.web import CONTENT_PARAMETERS, NEWS_PREFIXES, Retry, encyclopedia_host, is_gzip, named

Rows = tuple[list[dict], str | None]

# Addresses of the services and the parameters that they know.
LISTING = {"action": "query", "format": "json", "list": "recentchanges", "rcdir": "newer", "rctype": "new", "rcprop": "title|timestamp", "rcnamespace": "0"}
PARSE = {"action": "parse", "prop": "text", "format": "json"}
PAPERS = "https://arxiv.org/search/advanced"
PAPER_SEARCH = {
    "advanced": "1", "terms-0-operator": "AND", "terms-0-term": "", "terms-0-field": "title", "classification-include_cross_list": "exclude",
    "date-year": "", "date-filter_by": "date_range", "date-date_type": "submitted_date_first", "abstracts": "hide", "order": "-announced_date_first",
}
WORKS = "https://archiveofourown.org/works"
WORK_SEARCH = {"commit": "Search", "work_search[single_chapter]": "0", "work_search[sort_column]": "created_at", "work_search[sort_direction]": "desc"}
CODE = "https://api.github.com"
CODE_LANGUAGES = {"python": ("Python", ".py"), "cpp": ("C++", ".cpp"), "java": ("Java", ".java")}


@dataclass(frozen=True)
class Request:
    """What to ask for."""

    url: str
    params: dict[str, str] = field(default_factory=dict)
    headers: dict[str, str] = field(default_factory=dict)
    method: str = "GET"

    @property
    def address(self) -> str:
        """Return the whole address."""
        return f"{self.url}?{urlencode(self.params)}" if self.params else self.url


@dataclass(frozen=True)
class Answer:
    """What came back."""

    status: int
    body: bytes = b""
    headers: dict[str, str] = field(default_factory=dict)


def ask(options: dict[str, str], request: Request) -> Answer | None:
    """Return the first answer that is no failure of the service, or None if all attempts fail."""
    fetch = named(options["fetch"]) if "fetch" in options else partial(recorded, options["answers"])
    retry = Retry(int(options.get("attempts", 5)), float(options.get("backoff", 0.1)))
    retry.statuses = tuple(json.loads(options["statuses"])) if "statuses" in options else retry.statuses

    def once() -> Answer:
        answer = fetch(request, options.get("proxy"))
        if answer.status in retry.statuses:
            raise OSError(f"status {answer.status}")
        return answer

    try:
        return retry.run(once)
    except OSError:
        return None


def recorded(folder: str, request: Request, proxy: str | None) -> Answer:
    """Look an answer up by its address; one that was not recorded is 404."""
    system, path = fs.FileSystem.from_uri(folder)
    table = ds.dataset(path, filesystem=system, format="parquet")
    found = table.to_table(filter=pc.field("address") == request.address).to_pylist()
    return Answer(found[0]["status"], found[0]["body"].encode()) if found else Answer(404)


def _json(answer: Answer | None) -> dict:
    """Return an answer as an object; empty for a failure or anything else."""
    if answer is None or answer.status != 200:
        return {}
    try:
        found = json.loads(answer.body)
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def _text(answer: Answer | None) -> str | None:
    return answer.body.decode("utf-8", "replace") if answer is not None and answer.status == 200 else None


def new_pages(options: dict[str, str], partition: str, token: str | None) -> Rows:
    """List the pages made from ``start`` to ``end`` (ISO times), oldest first; an error of the service is raised.

    The service keeps about a month. The continuation is handed back as it came.
    """
    params = LISTING | {"rcstart": options["start"], "rcend": options["end"], "rclimit": options.get("limit", "500")}
    found = _json(ask(options, Request(encyclopedia_host(partition), params | json.loads(token or "{}"))))
    if "error" in found:
        raise RuntimeError(f"listing of {partition}: {found['error']}")
    rows = found.get("query", {}).get("recentchanges", [])
    follow = found.get("continue")
    return [{"language": partition, "title": r.get("title"), "timestamp": r.get("timestamp")} for r in rows], json.dumps(follow) if follow else None


def page_html(options: dict[str, str], partition: str, token: str | None) -> Rows:
    """Fetch the HTML of pages; null for one that the service has not or cannot show."""
    language, titles = json.loads(partition)
    params = PARSE | CONTENT_PARAMETERS.get(language, {})
    rows = []
    for title in titles:
        found = _json(ask(options, Request(encyclopedia_host(language), params | {"page": title})))
        rows.append({"title": title, "html": found.get("parse", {}).get("text", {}).get("*")})
    return rows, None


def news_links(options: dict[str, str], partition: str, token: str | None) -> Rows:
    """Read the result pages of a search for a date: ``search`` has <DATE> and <START>.

    Pages of ten follow up to ``pages`` (100), but no further than the ``empty``-th (5) without a link to an article;
    the token carries the start and the empty pages so far.
    """
    start, empty = json.loads(token or "[0, 0]")
    address = options["search"].replace("<DATE>", partition).replace("<START>", str(start))
    links = [x for x in H.links(_text(ask(options, Request(address)))) or [] if x.startswith(tuple(NEWS_PREFIXES))]
    empty += not links
    ended = empty >= int(options.get("empty", 5)) or start // 10 + 1 >= int(options.get("pages", 100))
    return [{"link": x} for x in links], None if ended else json.dumps([start + 10, empty])


def news_text(options: dict[str, str], partition: str, token: str | None) -> Rows:
    """Fetch articles and return the text blocks of their page data; null where a page has none."""
    rows = []
    for link in json.loads(partition):
        data = H.embedded_json(_text(ask(options, Request(link))))
        try:
            page = next(iter(json.loads(data)["props"]["pageProps"]["page"].values()))
            blocks = [b["model"]["text"] for part in page["contents"] if part["type"] == "text" for b in part["model"]["blocks"]]
            rows.append({"link": link, "text": "\n".join(blocks)})
        except (TypeError, KeyError, ValueError, AttributeError, StopIteration):
            rows.append({"link": link, "text": None})
    return rows, None


def paper_links(options: dict[str, str], partition: str, token: str | None) -> Rows:
    """List the source archives of the papers of a subject from ``start`` to ``end``; ends with the first empty page.

    A page that fails is passed over, as long as fewer than ``failed`` (3) in a row do.
    """
    size = int(options.get("size", "200"))
    if not 50 <= size <= 200:
        raise ValueError("size must be 50 to 200")
    first, failed = json.loads(token or "[0, 0]")
    own = {f"classification-{partition}": "y", "date-from_date": options["start"], "date-to_date": options["end"], "size": str(size), "start": str(first)}
    page = _text(ask(options, Request(PAPERS, PAPER_SEARCH | own)))
    if page is None:
        return [], json.dumps([first + size, failed + 1]) if failed + 1 < int(options.get("failed", 3)) else None
    links = H.source_links(page) or []
    return [{"link": x} for x in links], json.dumps([first + size, 0]) if links else None


def paper_archive(options: dict[str, str], partition: str, token: str | None) -> Rows:
    """Fetch archives whose head says that they are gzip; null for others and for failures."""
    options = {"statuses": "[403, 429, 500, 502, 503, 504]"} | options
    rows = []
    for link in json.loads(partition):
        head = ask(options, Request(link, method="HEAD"))
        good = head is not None and head.status == 200 and is_gzip(head.headers)
        answer = ask(options, Request(link)) if good else None
        rows.append({"link": link, "content": answer.body if answer is not None and answer.status == 200 else None})
    return rows, None


def work_ids(options: dict[str, str], partition: str, token: str | None) -> Rows:
    """List the works on a page of a search by ``language`` (a number) and ``age`` (such as 10-24+days)."""
    own = {"page": partition, "work_search[language_id]": options.get("language", "1"), "work_search[revised_at]": options["age"]}
    links = H.work_links(_text(ask(options, Request(f"{WORKS}/search", WORK_SEARCH | own)))) or []
    return [{"work_id": x.split("/chapters")[0].rsplit("/", 1)[-1]} for x in links], None


def work_text(options: dict[str, str], partition: str, token: str | None) -> Rows:
    """Fetch works and join their paragraphs; an empty text where there are none, null for a failure."""
    rows = []
    for work in json.loads(partition):
        found = H.work_paragraphs(_text(ask(options, Request(f"{WORKS}/{work}"))))
        text = None if found is None else re.sub(r"\n+", "\n", "".join(found).replace(" ", "\n")).strip()
        rows.append({"work_id": work, "text": text})
    return rows, None


def _authorized(options: dict[str, str], **more: str) -> dict[str, str]:
    return more | ({"Authorization": f"token {options['token']}"} if options.get("token") else {})


def repositories(options: dict[str, str], partition: str, token: str | None) -> Rows:
    """Search the repositories of a ``language`` (a key of ``CODE_LANGUAGES``) made between two days, most starred first.

    Ten pages of a hundred, which is what the service shows of a search; a shorter page is the last.
    """
    first, last = json.loads(partition)
    page = int(token or 1)
    language = CODE_LANGUAGES[options.get("language", "python")][0]
    params = {"q": f"created:{first}..{last} language:{language}", "sort": "stars", "order": "desc", "per_page": "100", "page": str(page)}
    items = _json(ask(options, Request(f"{CODE}/search/repositories", params, _authorized(options)))).get("items", [])
    rows = [{"html_url": r["html_url"], "default_branch": r["default_branch"]} for r in items]
    return rows, str(page + 1) if len(items) == 100 and page < 10 else None


def repository_files(options: dict[str, str], partition: str, token: str | None) -> Rows:
    """List the paths of a repository's tree that end as the files of ``language`` do; none if there is no tree."""
    address, branch = json.loads(partition)
    owner, name = address.split("/")[-2:]
    headers = _authorized(options, Accept="application/vnd.github.v3+json")
    tree = _json(ask(options, Request(f"{CODE}/repos/{owner}/{name}/git/trees/{quote(branch)}", {"recursive": "1"}, headers))).get("tree") or []
    ending = CODE_LANGUAGES[options["language"]][1] if "language" in options else ""
    return [{"html_url": address, "path": x["path"]} for x in tree if x["path"].endswith(ending)], None


def file_content(options: dict[str, str], partition: str, token: str | None) -> Rows:
    """Fetch files of a repository; null for a failure and for bytes that are no UTF-8."""
    repository, paths = json.loads(partition)
    rows = []
    for path in paths:
        coded = _json(ask(options, Request(f"{CODE}/repos/{repository}/contents/{quote(path)}", headers=_authorized(options)))).get("content")
        try:
            rows.append({"path": path, "content": base64.b64decode(coded).decode("utf-8") if coded else None})
        except ValueError:
            rows.append({"path": path, "content": None})
    return rows, None
