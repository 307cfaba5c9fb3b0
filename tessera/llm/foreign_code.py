"""Problem 3: files that were generated, minified, taken from a third party, or are data blobs.

Third-party code is found by Merkle hashes over the directory trees of the repositories. A leaf is
the hash of a file's content; a directory is the sum of the hashes of its children, each times an odd
number that stands for its name. The recursion is linear, so it unrolls: a file adds its leaf times
the product of the names between, to each directory above it, and all hashes of all trees come
from one aggregation with partial sums, however deep the trees are.

A subtree (a file or a directory of at least ``LEAST`` characters) that unrelated repositories share is
judged by what its occurrences say: a place for third-party code, or a comment that names the
origin, is evidence for the tree. An occurrence with such evidence is third-party code. One without it
is so only if at least ``OWNERS`` other owners keep the same tree as third-party code and it is not
the first that was crawled, which is taken for the original. Sharing alone marks nothing: files
copied between repositories stay. A tree in such a place that no other repository has is third-party
code by its place.

Generated, minified and data files are found by header and layout rules, file by file.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.shared import written

#: Directory names that hold third-party code.
PLACES = frozenset(
    "vendor vendored _vendor third_party third-party thirdparty 3rdparty node_modules bower_components"
    " deps pods site-packages extern external".split()
)
CONFIG = re.compile(r"\.(json|ya?ml|ini|env|toml|cfg|conf|properties|xml|md|txt)$", re.I)
#: A comment line, without its comment signs, is group 1.
_COMMENT = re.compile(r"^[ \t]*(?://+!?|#+|/\*+!?|\*+|<!--|--|;+|%+)[ \t]*(.*?)[ \t]*(?:\*/|-->)?[ \t]*\r?$", re.M)
_TOOL = re.compile(
    r"^(?:"
    r"<auto-?generated>|@generated\b|auto-?generated\b"
    r"|(?:this (?:file|code|class|module) (?:was|is|has been) )?(?:automatically |auto-?|machine[- ])"
    r"(?:generated|created|produced|written|built)\b"
    r"|this (?:file|code|class|module) (?:was|is|has been) (?:generated|produced|created) (?:by|from|with)\b"
    r"|(?:code |file |source )?(?:generated|produced|created|emitted) (?:by|from|with) \S+.*(?:\d\.\d|edit|change|modif|template|instead)"
    r"|(?:converted|exported|compiled|transpiled) (?:by|with) \S+ from\b"
    r"|built with \S+; .*overwritten"
    r"|ce fichier (?:est|a été) (?:produit|généré)"
    r"|diese datei wurde (?:automatisch )?(?:erzeugt|generiert|erstellt)|diese datei wurde automatisch"
    r"|este (?:archivo|fichero) (?:fue|es|ha sido) (?:generado|creado|producido)"
    r")",
    re.I,
)
_WARNING = re.compile(r"\bdo not (?:edit|modify|change)\b", re.I)
_ORIGIN = re.compile(
    r"^(?:bundled copy\b|vendored (?:from|copy)\b|imported third-party\b|third-party source\b"
    r"|(?:taken|copied|imported|vendored) from https?://\S+.*(?:release|version|commit|tag|patch)"
    r"|@name \S+ @version\b)",
    re.I,
)
_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|\b0x[0-9a-fA-F]+\b|[-+]?\b\d[\d.eE_]*\b")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
#: Numbers with what separates them, and encoded bytes.
_BLOB = re.compile(r"(?:[-+]?\d[\d.eE+-]*[,;\s]*){8,}|[A-Za-z0-9+/=]{60,}")


def shape(line: str) -> str:
    """Return a line with its literals and names replaced."""
    return _NAME.sub("w", re.sub(r"\s+", " ", _LITERAL.sub("9", line.strip())))


def reasons(path: str | None, content: str) -> list[str]:
    """Return why a file is not hand-written, judged by itself: some of tool, origin, minified,
    data, repeated, place. Empty and blank contents have no reasons but their place."""
    found = []
    if any(places((path or "").split("/")[:-1])):
        found.append("place")
    lines = [x for x in re.split(r"\r\n|\n|\r", content) if x.strip()]
    if not lines:
        return found
    for m in _COMMENT.finditer(content):
        if "tool" not in found and (_TOOL.match(m[1]) or (_WARNING.search(m[1]) and "generated" in m[1].lower())):
            found.append("tool")
        if "origin" not in found and _ORIGIN.match(m[1]):
            found.append("origin")
    size = sum(map(len, lines))
    if path and CONFIG.search(path):
        # People write long values into configuration; no one lays all of it out in lines of a thousand.
        if size >= 2000 and sum(len(x) for x in lines if len(x) >= 1000) > 0.6 * size:
            found.append("minified")
        elif size >= 2000 and sum(map(len, _BLOB.findall(content))) > 0.7 * size:
            found.append("data")
        return found
    if sum(len(x) for x in lines if len(x) >= 250) > 0.6 * size:
        found.append("minified")
        return found
    code = [x for x in lines if not re.match(r"\s*(//|#(?!define|include)|/\*|\*|\"\"\")", x)]
    body = "\n".join(code)
    rest = _LITERAL.sub("", body)
    if len(body) >= 600 and sum(map(str.isalpha, rest)) < 0.1 * len(body):
        found.append("data")
    shapes = Counter(map(shape, code))
    long = [(k, n) for k, n in shapes.most_common(6) if len(k) >= 10]
    if len(code) >= 8 and sum(n for _, n in long[:4] if n >= 3) >= 0.7 * len(code):
        found.append("repeated")
    return found


#: Least size of a subtree, in characters without white space, that says anything by being shared.
LEAST = 200
#: Other owners that must keep a tree as third-party code to mark it where nothing says so.
OWNERS = 2
SIGNS = (
    "file_id long, repo string, owner string, path string, leaf long, size long, reasons array<string>,"
    " nodes array<struct<node:long,hash:long,placed:boolean>>"
)
_NODES = pa.list_(pa.struct([("node", pa.int64()), ("hash", pa.int64()), ("placed", pa.bool_())]))
_MASK = (1 << 64) - 1


def _signed(x: int) -> int:
    return (x & _MASK) - (1 << 64) if x >> 63 & 1 else x & _MASK


def places(segments: list[str]) -> list[bool]:
    """Tell of each directory of a path, given by its names, whether it is a place for third-party code or below one."""
    out, below = [], False
    for name in segments:
        low = name.lower()
        below = below or low in PLACES or (re.fullmatch(r"[a-z]+-\d[\d.]*", low) is not None and low.split("-")[0] in PLACES)
        out.append(below)
    return out


def nodes(repo: str, path: str, leaf: int) -> list[tuple[int, int, bool]]:
    """Return the file's own node and every directory above it, root left out: (node, what it adds to its hash, placed)."""
    *above, name = path.split("/")
    placed = places(above)
    out = [(xxhash.xxh3_64_intdigest(f"{repo}\n{path}"), leaf, bool(placed and placed[-1]))]
    hash_, at = leaf, name
    for depth in range(len(above), 0, -1):
        hash_ = hash_ * (xxhash.xxh3_64_intdigest(at) | 1) & _MASK
        at = above[depth - 1]
        where = "/".join(above[:depth])
        out.append((xxhash.xxh3_64_intdigest(f"{repo}\n{where}"), hash_, placed[depth - 1]))
    return [(_signed(node), _signed(h), p) for node, h, p in out]


def signs(files: DataFrame) -> DataFrame:
    """Return the reasons of each file by itself, its leaf hash (of its content without white space) and its nodes."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves, sizes, found, trees = [], [], [], []
            for repo, path, content in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                text = content.as_py()
                bare = "".join(text.split())
                leaf = xxhash.xxh3_64_intdigest(bare)
                found.append(reasons(path, text))
                leaves.append(_signed(leaf))
                sizes.append(len(bare))
                known = repo is not None and path is not None
                trees.append([dict(zip(("node", "hash", "placed"), x)) for x in nodes(repo, path, leaf)] if known else [])
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:4],
                    pa.array(leaves, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(found, pa.list_(pa.string())),
                    pa.array(trees, _NODES),
                ],
                ["file_id", "repo", "owner", "path", "leaf", "size", "reasons", "nodes"],
            )

    return (
        files.select(
            F.col("file_id").cast("long").alias("file_id"),
            F.col("html_url").alias("repo"),
            owner(F.col("html_url")).alias("owner"),
            F.col("target_file").alias("path"),
            "content",
        )
        .filter("content is not null")
        .mapInArrow(judge, SIGNS)
    )


def owner(repo: Column) -> Column:
    """Return the owner part of a repository's address; repositories of one owner are related."""
    return F.coalesce(F.try_element_at(F.split(repo, "/"), F.lit(-2)), repo)


def merkle(judged: DataFrame) -> DataFrame:
    """Return the nodes of all trees: ``node``, ``owner``, ``hash``, ``size``, ``first`` (least file id) and ``known``.

    ``known`` tells that the node lies in a place for third-party code, or that all its files name
    their origin. Of a file that was crawled several times the latest makes the tree.
    """
    latest = judged.filter("size(nodes) > 0").select(
        "file_id", "owner", "size", F.array_contains("reasons", "origin").alias("origin"), "nodes", F.col("nodes")[0]["node"].alias("file")
    )
    newest = latest.groupBy("file").agg(F.max("file_id").alias("file_id"), F.min("file_id").alias("first")).drop("file")
    entries = latest.join(newest, "file_id").select("first", "owner", "size", "origin", F.explode("nodes").alias("n"))
    return entries.groupBy(F.col("n.node").alias("node")).agg(
        F.min("owner").alias("owner"),
        F.sum(F.col("n.hash").cast("decimal(20,0)")).alias("hash"),
        F.sum("size").alias("size"),
        F.min("first").alias("first"),
        (F.max("n.placed") | F.min("origin")).alias("known"),
    )


def vendored(trees: DataFrame) -> DataFrame:
    """Return the ``node`` of each third-party subtree that unrelated repositories share."""
    large = trees.filter(F.col("size") >= LEAST)
    by_owner = large.groupBy("hash", "owner").agg(
        F.max("known").alias("known"), F.min(F.when(~F.col("known"), F.col("first"))).alias("first")
    )
    shared = by_owner.groupBy("hash").agg(
        F.count("*").alias("owners"),
        F.sum(F.col("known").cast("int")).alias("keepers"),
        F.min("first").alias("original"),
    ).filter("owners >= 2 and keepers >= 1")
    own = F.when(F.col("known"), F.lit(0)).otherwise(F.lit(OWNERS))
    return large.join(shared, "hash").filter((F.col("keepers") >= own) & (F.col("known") | (F.col("first") > F.col("original")))).select("node")


def foreign_files(files: DataFrame) -> DataFrame:
    """Return (``file_id``, ``reasons``) of the files that are not hand-written in their repository.

    ``reasons`` has ``tool``, ``repeated`` (generated), ``minified``, ``data``, ``shared`` (in a
    third-party subtree that unrelated repositories share), ``place`` and ``origin`` (third-party by
    its place or its comments; kept beside ``shared`` as its evidence). Files of null content
    give no row; a file of null path or repository belongs to no tree and is judged by its content.
    Empty and small files are marked by no tree of their own. Repeated rows and crawls of a file are judged
    each; other columns are ignored, and an empty table gives no rows.
    """
    judged = written(signs(files), "p3-signs")
    marked = vendored(merkle(judged))
    below = judged.filter("size(nodes) > 0").select("file_id", F.explode("nodes.node").alias("node"))
    also = below.join(marked, "node", "left_semi").select("file_id").distinct().withColumn("also", F.lit(True))
    return judged.join(also, "file_id", "left").select(
        "file_id",
        F.when(F.col("also"), F.array_append("reasons", "shared")).otherwise(F.col("reasons")).alias("reasons"),
    ).filter("size(reasons) > 0")
