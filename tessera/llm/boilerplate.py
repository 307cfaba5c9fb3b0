"""Problem 4: the lines of a page that belong to the site and not to the article.

A page is a list of flat text blocks, its lines. Each block is described by its word count, its
link density (how much of it is a list of short labels), its ending, and by what its words say
(log odds of site against article, learned from a small labelled table), together with the same
figures of its neighbours and its place in a run of short blocks. A decision tree trained on the
labelled table decides. Nothing but the page itself is needed, so pages are scored where they lie.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import labelled_blocks

_WORD = re.compile(r"[぀-ヿ㐀-鿿]+|[^\W\d_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_SPLIT = re.compile(r"\s*[|·•\t/>]\s*|\s{2,}|,\s+|\s+-\s+")
_BAR = re.compile(r"[|·•\t/>]|\s{2,}")
_JOINED = re.compile(r"[a-zà-ÿ][A-Z]")
_END = re.compile(r"[.!?。！？؟…][\"”’'»)\]]*\s*$")
FEATURES = (
    "words", "ends", "links", "site", "known", "listed", "opens", "number", "before", "after",
    "links_before", "links_after", "site_before", "site_after", "body_above", "body_below",
)


def tokens(line: str) -> list[str]:
    """Return lower-case words and pairs of words, and a short line as a whole.

    For Chinese and Japanese these are pairs of characters.
    """
    out: list[str] = []
    words = []
    for w in _WORD.findall(line.lower()):
        if _CJK.match(w):
            out += [w[i : i + 2] for i in range(max(1, len(w) - 1))]
        else:
            words.append(w)
    if "©" in line:
        words.append("©")
    whole = ["^" + " ".join(words)] if 0 < len(words) <= 4 else []
    return out + words + [f"{a} {b}" for a, b in zip(words, words[1:])] + whole


def length(line: str) -> float:
    """Return the number of words; two Chinese or Japanese characters count as one."""
    cjk = len(_CJK.findall(line))
    return len(_CJK.sub(" ", line).split()) + cjk / 2


def link_density(line: str) -> float:
    """Return the share of the line that lies in a list of labels of at most four words."""
    if _END.search(line) and not _BAR.search(line):
        return 0.0
    parts = [p for p in _SPLIT.split(line.strip()) if p]
    if len(parts) >= 3:
        labels = [p for p in parts if len(p.split()) <= 4 and length(p) <= 6 and not _END.search(p)]
        return sum(map(len, labels)) / max(1, sum(map(len, parts)))
    return 1.0 if len(_JOINED.findall(line)) >= 3 else 0.0


class Odds:
    """Log odds of site against article of the tokens of a labelled table."""

    def __init__(self, lines: list[tuple[str, str]]) -> None:
        self.counts = (Counter(), Counter())
        for label, line in lines:
            self.counts[label != "+"].update(set(tokens(line)))
        self.lines = (sum(x == "+" for x, _ in lines), sum(x != "+" for x, _ in lines))

    def score(self, line: str) -> tuple[float, float]:
        """Return the mean log odds of the tokens, 0 for unknown ones, and the share known."""
        values, found = 0.0, set(tokens(line))
        known = 0
        for t in found:
            article, site = self.counts[0][t], self.counts[1][t]
            if article + site > 1:
                known += 1
                values += np.log((site + 0.2) / (self.lines[1] + 1)) - np.log((article + 0.2) / (self.lines[0] + 1))
        return (values / len(found), known / len(found)) if found else (0.0, 0.0)


class Tree:
    """A binary decision tree by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 2) -> None:
        self.value = float(y.mean())
        self.feature = -1
        if depth == 0 or self.value in (0.0, 1.0) or len(y) < 2 * least:
            return
        best = (1.0, -1, 0.0)
        impurity = self.value * (1 - self.value) * len(y)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, t = x[order, f], y[order]
            ones = np.cumsum(t)[:-1]
            n = np.arange(1, len(t))
            rest, m = t.sum() - ones, len(t) - n
            gain = impurity - ones * (1 - ones / n) - rest * (1 - rest / m)
            gain[(v[1:] == v[:-1]) | (n < least) | (m < least)] = 0
            if len(gain) and gain.max() > best[0]:
                i = int(gain.argmax())
                best = (float(gain[i]), f, (v[i] + v[i + 1]) / 2)
        _, self.feature, self.cut = best
        if self.feature >= 0:
            left = x[:, self.feature] <= self.cut
            self.low = Tree(x[left], y[left], depth - 1, least)
            self.high = Tree(x[~left], y[~left], depth - 1, least)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Return the share of site lines in the leaf of each row."""
        if self.feature < 0:
            return np.full(len(x), self.value)
        left = x[:, self.feature] <= self.cut
        out = np.empty(len(x))
        if left.any():
            out[left] = self.low(x[left])
        if not left.all():
            out[~left] = self.high(x[~left])
        return out

    def text(self, indent: str = "") -> str:
        """Return the rules of the tree."""
        if self.feature < 0:
            return f"{indent}{self.value:.2f}\n"
        name = FEATURES[self.feature]
        return f"{indent}{name} <= {self.cut:.3g}\n{self.low.text(indent + '  ')}{indent}else\n{self.high.text(indent + '  ')}"


class Classifier:
    """The tree and the log odds, trained on pages made from the labelled table.

    One half of the pages gives the log odds of words, the other half trains the tree, which
    so learns what to do with words it has not seen.
    """

    def __init__(self, n: int = 2400, seed: int = 7) -> None:
        pages = labelled_blocks.Maker(seed).pages(n // 2)
        self.odds = Odds([line for page in pages for line in page])
        tables = [labelled_blocks.NEWS, *labelled_blocks.ENCYCLOPEDIA.values()]
        self.openers = {self._plain(x) for table in tables for x in labelled_blocks.lines(table, "opener")}
        self.openers |= {"tags", "topics"}
        self.starts = tuple(f"{x}{end}" for x in sorted(self.openers) for end in (" ", ":"))
        self.memory: dict[str, tuple] = {}
        rest = labelled_blocks.Maker(seed + 1, foreign=True).pages(n // 2)
        x = np.concatenate([self.features([line for _, line in page]) for page in rest])
        y = np.array([label != "+" for page in rest for label, _ in page], float)
        self.tree = Tree(x, y, depth=12, least=4)

    @staticmethod
    def _plain(line: str) -> str:
        return line.strip().rstrip(":").strip().lower()

    def _own(self, line: str) -> tuple:
        if line in self.memory:
            return self.memory[line]
        words = length(line)
        plain = self._plain(line)
        opens = 1.0 if plain in self.openers else 0.5 * plain.startswith(self.starts)
        start = re.match(r"\s*\d+[.)]?\s+\S", line) is not None
        own = (words, bool(_END.search(line)), link_density(line), *self.odds.score(line), opens, start)
        if words < 12:
            if len(self.memory) > 100_000:
                self.memory.clear()
            self.memory[line] = own
        return own

    def features(self, lines: list[str]) -> np.ndarray:
        """Return the features of the lines of one page that are not blank."""
        own = [self._own(line) for line in lines]
        n = len(own)
        body = [w >= 8 and ends and site < 0.5 and links < 0.5 for w, ends, links, site, *_ in own]
        edge = (0, False, 1.0, 1.0, 1.0, 0.0, False)
        out = np.zeros((n, len(FEATURES)))
        above, listed = False, False
        for i, (words, ends, links, site, known, opens, number) in enumerate(own):
            listed &= not body[i]
            before = own[i - 1] if i else edge
            after = own[i + 1] if i + 1 < n else edge
            out[i, :15] = (
                words, ends, links, site, known, listed, opens, number,
                before[0], after[0], before[2], after[2], before[3], after[3], above,
            )
            above |= body[i]
            listed |= opens == 1
        below = False
        for i in range(n - 1, -1, -1):
            out[i, 15] = below
            below |= body[i]
        return out

    def site_lines(self, text: str) -> list[int]:
        """Return the numbers, from 1, of the lines of a page that belong to the site."""
        kept = [(i, line) for i, line in enumerate(text.split("\n"), 1) if line.strip()]
        if not kept:
            return []
        chosen = self.tree(self.features([line for _, line in kept])) > 0.5
        return [i for (i, _), c in zip(kept, chosen) if c]


@lru_cache(maxsize=1)
def classifier() -> Classifier:
    """Return the trained classifier; it is trained once in a process."""
    return Classifier()


def site_lines(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Return (``id``, ``line_no``) for each site line.

    Lines are split at line feeds and counted from 1; blank lines are of neither kind and never
    returned. Null and empty texts give no rows; other columns are ignored, and repeated pages
    give their rows each.
    """
    model = pages.sparkSession.sparkContext.broadcast(classifier())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = model.value.site_lines(text.as_py())
                ids += [i] * len(found)
                numbers += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int64())], ["id", "line_no"])

    kept = pages.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    return kept.mapInArrow(find, "id long, line_no long")


def main_text(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Return (``id``, ``text``, ``removed``): each page without its site lines, and their number.

    A null page stays null with 0 lines removed.
    """
    model = pages.sparkSession.sparkContext.broadcast(classifier())

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for value in batch.column(1):
                text = value.as_py()
                if text is None:
                    texts.append(None)
                    removed.append(0)
                    continue
                found = set(model.value.site_lines(text))
                texts.append("\n".join(line for i, line in enumerate(text.split("\n"), 1) if i not in found))
                removed.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], ["id", "text", "removed"]
            )

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        clean, "id long, text string, removed long"
    )
