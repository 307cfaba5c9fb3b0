"""Answers for a transport that runs in worker processes."""

import json

from tessera.sources.sites import Answer
from tessera.sources.web import Proxies


class Own(Proxies):
    def choose(self):
        return {"https": "http://proxy.example"}


def fetch(request, proxy):
    assert json.loads(proxy) == {"https": "http://proxy.example"}
    page = 2 if "rccontinue" in request.params else 1
    rows = [{"title": f"{request.url.split('/')[2]} via {page}", "timestamp": "T"}]
    more = {"continue": {"rccontinue": "x"}} if page == 1 else {}
    return Answer(200, json.dumps({"query": {"recentchanges": rows}, **more}).encode())
