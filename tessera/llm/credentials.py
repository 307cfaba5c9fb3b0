"""Problem 2: credentials written out in source and configuration files.

Candidates are literals, and bare values of configuration. Each is segmented by Viterbi into words
of a dictionary, counted over the identifiers of all files; what no word explains is its residual.
The name it stands under is segmented by the same words and tells how much is needed:

* where a credential is expected (assigned to, compared with or passed under a telling name, in an
  authorization header, in the user part of an address, in a login call, in a secret manifest, in a
  note "user / value"), a residual of a few letters is one; what words explain is a placeholder or
  an identifier. Digests count only here, in place of a password.
* under any other name, or as an argument of a call, nearly all of a long value must be residual,
  it must be of no known format (digest, UUID, address, public key) and its name of no
  public kind (an id, a checksum, a version).
* a phrase with blanks is one under a telling name if its words are no words of the files.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most words of the dictionary, which is sent to the workers, and their least share of the files.
WORDS, SHARE = 20_000, 1e-4
_IDENTIFIER = re.compile(r"[A-Za-z]+(?:_[A-Za-z]+)*")
_PART = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}(?![a-z])")
_STRINGS = re.compile(
    r"\"\"\".*?\"\"\"|'''.*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|//[^\n]*|/\*.*?\*/|(?<!\S)#[^\n]*", re.S
)
_PLAIN = (
    "password passwd passphrase secret token key api auth access your my the here change replace redacted todo example"
    " dummy test sample none null true false undefined default placeholder insert enter value user admin fixme changeme"
    " xxx yyy foo bar baz"
).split()

#: Names that tell of a credential, with any letters before them, and those that must stand alone.
_LONG = (
    r"(?:password|passwd|passphrase|passwort|passcode|secret|token|api[_-]?key|bearer|credentials?|kennwort"
    r"|(?:secret|signing|licen[cs]e|access|private|auth|encryption|master|account|storage|tls|ssl|service|deploy)[_-]?key"
    r"|schluessel|contrasena|contraseña|mot[_-]?de[_-]?passe|wachtwoord|lösenord|haslo|hasło|adgangskode"
    r"|(?:signature|signing|hmac|otp|totp|wallet)[_-]?seed)"
)
_SHORT = r"(?:pass|pwd|pw|clave|senha|parola|creds?)"
_NAME = rf"(?:{_LONG}|{_SHORT})"
_TELLING = (
    rf"(?:(?i:{_LONG}|(?<![a-z]){_SHORT})|(?<=[a-z])(?:Pass|Pwd|Pw|Clave))(?:_?(?:\d+|prod|dev|live|test|value|text))?(?![A-Za-z0-9_-])"
)
_QUOTED = r"(?:\"(?P<d>(?:[^\"\\\n]|\\.)*)\"|'(?P<s>(?:[^'\\\n]|\\.)*)'|`(?P<t>[^`\n]*)`)"
_ASSIGN = re.compile(
    rf"{_TELLING}[\"'`]?\]?(?:\[\])?\s*(?::=|===?|!==?|=>|[:=,{{(]|\s)\s*\(?\s*(?:[rbuLf]|std::string\()?{_QUOTED}"
)
_MORE = re.compile(rf"\s*(?:\+|\.|\\\r?\n)?\s*{_QUOTED}")
_AFTER = re.compile(rf"{_QUOTED}\s*\)\s*(?:[A-Za-z<>]+\s+)+\w*?{_TELLING}")
_BARE = re.compile(rf"^[ \t]*(?:-[ \t]+|export[ \t]+|set[ \t]+)?[\w.-]*?{_TELLING}[ \t]*[:=][ \t]*(?P<v>[^\s\"'`#][^\s\"'`]*)[ \t]*\r?$", re.M)
_INSIDE = re.compile(rf"{_TELLING}=(?P<v>[^\s\"'`&;,)(<>]+)")
_HEADER = re.compile(
    r"(?i:authorization)[\"'`]?\s*[:,=]\s*[\"'`]?(?:(?i:bearer|basic|token|apikey|digest)\s+)?(?P<v>[A-Za-z0-9._~+/=\-]{6,})"
)
_ADDRESS = re.compile(r"[a-z][a-z0-9+.-]*://[^\s:/@\"'`<>]+:(?P<v>[^\s@/\"'`<>]+)@[A-Za-z0-9]")
_LOGIN = re.compile(
    r"\.(?:login|connect|authenticate|auth|sign_?in|basic_?auth)\(\s*(?:(?:\"[^\"\n]*\"|'[^'\n]*')\s*,\s*)+" + _QUOTED + r"\s*\)", re.I
)
_OPTION = re.compile(r"(?:sshpass\s+-p\s*|(?:mysql|mysqldump|psql)\s[^\n]*?\s-p|--pass(?:word)?[= ]|curl\s[^\n]*?-u\s+[^\s:]+:)[\"']?(?P<v>[^\s\"']+)")
_NOTE = re.compile(r"^[ \t]*(?://|#|/?\*|--|;)[^\n]*?[\s:(]([A-Za-z][\w.-]*)[ \t]+/[ \t]+(?P<v>\S{6,})[ \t]*(?:\*/)?\r?$", re.M)
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----.*?-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----", re.S)
_MANIFEST = re.compile(r"^kind:[ \t]*Secret\b.*?(?=^---|\Z)", re.M | re.S)
_DATA = re.compile(r"^(?P<in>[ \t]*)(?:data|stringData):[ \t]*\r?\n(?P<rows>(?:(?P=in)[ \t]+\S[^\n]*\n?)+)", re.M)
_ROW = re.compile(r"^[ \t]+[\w.-]+:[ \t]*[\"']?(?P<v>[^\s\"']+)", re.M)
_KNOWN = re.compile(
    r"(?<![A-Za-z0-9_./+-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{16,}|sk_(?:live|test)_[A-Za-z0-9]{16,}"
    r"|xox[abprs]-[0-9]+-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{20,}"
    r"|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{20,}|[a-z]{3,8}_(?:tok|key|prod|live|secret)_[A-Za-z0-9]{16,})"
    r"(?![A-Za-z0-9_/+=-])"
)
#: What a line must have to be looked at.
_HINT = re.compile(
    rf"{_NAME}|authorization|://[^\s/@:]+:[^\s/@]+@|login|connect|authenticate|sshpass|mysql|psql|curl| / \S+[ \t]*(?:\*/)?\r?$"
    r"|(?:akia|asia)[0-9a-z]{16}|gh[pousr]_|xox[abprs]-|aiza|\bsg\.|eyj|_(?:tok|key|prod|live)_",
    re.M,
)
_PLACEHOLDER = re.compile(
    r"^(?:[*.x•?_-]+|<[^>]*>|\$\{[^}]*\}|\$\([^)]*\)|\$[A-Za-z_]\w*|\{\{?[^}]*\}?\}|%\(?[A-Za-z_]\w*\)?[s%]?|\[[^\]]*\]|__\w+__"
    r"|(?:AKIA|ASIA|ghp_|sk_live_|sk_test_|AIza)?[Xx]{6,}|(?:none|null|nil|true|false|undefined)|\d{1,4})$",
    re.I,
)
_LOOKUP = re.compile(r"^(?:(?:os|process|env|ENV|System|vault|secrets|config|settings|self|this)\.[\w.\[\]()]+|\w+\(.*|\w[\w.]*\[.*)$")
_HASH = re.compile(r"^(?:(?:md5|sha\d+)[:-].*|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})$", re.I)
#: Quoted or bare values without blanks that have letters and digits.
_OPAQUE = re.compile(
    r"(?P<q>[\"'`])(?=[^\"'`\n]*\d)(?=[^\"'`\n]*[A-Za-z])(?P<v>[^\s\"'`\\]{16,})(?P=q)|(?<=[:=])[ \t]*(?=[^\s\"'`#]*\d)(?P<b>[^\s\"'`#]{16,})[ \t]*\r?$", re.M
)
#: What a value stands under: the name it is assigned to or compared with, its key, or the call.
_UNDER = re.compile(r"([A-Za-z_$][\w$-]*)[\"'`]?\]?\s*(?:\((?:[^();\n]*,)?|:=|=>|[=!]=+|[:=])\s*$")
_FORMAT = re.compile(
    r"^(?:\{?[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\}?|(?:0x)?[0-9a-f]+|[\d.,:+TZ-]+|\w[\w+.-]*://.*|(?:md5|sha\d*|blake\w+)[:-].*|ssh-\S+"
    r"|[\w-]+(?:\.[\w-]+)*\.[a-z]{2,10}(?:[:/].*)?|\.{0,2}/.*|(?:[\w.@-]+/)+[\w.@-]*|data:.*|\w+@\w[\w.]*(?::.*)?)$",
    re.I,
)
#: Words of names whose values are meant to be seen.
_PUBLIC = frozenset(
    "id ids uid uuid guid node request tenant trace span sha md crc hash digest checksum integrity fingerprint etag commit revision rev"
    " version tag build url uri host addr address path file icon image logo font pub public cert certificate pem nonce pattern regex re"
    " compile banner alphabet charset chars test expected sample fixture vector serial index ref color error raise assert print log"
    " format name title label message text html css svg json xml yaml base data blob bytes payload encoded decode content body".split()
)
_CONFIG = re.compile(r"\.(?:ya?ml|ini|env|toml|cfg|conf|properties|sh|bash)$|(?:^|/)\.env|(?:^|/)Dockerfile", re.I)


def words_of(content: str) -> set[str]:
    """Return the words that make up the identifiers of a file, without strings and comments."""
    bare = _STRINGS.sub(" ", content)
    return {p.lower() for name in set(_IDENTIFIER.findall(bare)) for p in _PART.findall(name) if len(p) >= 3}


class Dictionary:
    """Words with their shares, and the segmentation of a value into them."""

    def __init__(self, shares: dict[str, float]) -> None:
        total = sum(shares.values()) or 1.0
        self.cost = {w: -math.log(n / total) for w, n in shares.items()}
        self.cost |= {w: min(6.0, self.cost.get(w, 6.0)) for w in _PLAIN}
        self.longest = max(map(len, self.cost))

    def residual(self, value: str) -> int:
        """Return how many letters and digits of ``value`` no word explains (Viterbi)."""
        text, price, longest = value.lower(), self.cost.get, self.longest
        unknown = 4.5
        costs, left = [0.0], [0]
        for end in range(1, len(text) + 1):
            word = text[end - 1].isalnum()
            cost, rest = costs[-1] + unknown * word, left[-1] + word
            for start in range(max(0, end - longest), end - 2 if word else 0):
                found = price(text[start:end])
                if found is not None and costs[start] + found < cost:
                    cost, rest = costs[start] + found, left[start]
            costs.append(cost)
            left.append(rest)
        return left[-1]

    def words(self, name: str) -> set[str]:
        """Return the words of an identifier, run-together ones told apart by Viterbi as well."""
        parts = {p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", name)}
        return parts | {w for p in parts if p not in self.cost for w in self._split(p)}

    def _split(self, text: str) -> list[str]:
        best: list[tuple[float, list[str]]] = [(0.0, [])]
        for end in range(1, len(text) + 1):
            step = (best[-1][0] + 4.5, best[-1][1])
            for start in range(max(0, end - self.longest), end - 1):
                found = self.cost.get(text[start:end])
                if found is not None and best[start][0] + found < step[0]:
                    step = (best[start][0] + found, [*best[start][1], text[start:end]])
            best.append(step)
        return best[-1][1]


class Finder:
    """Finds the credentials of a file."""

    def __init__(self, dictionary: Dictionary) -> None:
        self.words = dictionary

    def _is(self, value: str, named: bool = True) -> bool:
        """Tell whether a value in place of a credential is one."""
        if len(value) < 4 or _PLACEHOLDER.match(value) or _LOOKUP.match(value):
            return False
        if re.search(r"\s", value):
            return named and self._phrase(value)
        if "..." in value or "${" in value or "{{" in value or "<" in value and ">" in value:
            return False
        if not named and _HASH.match(value):
            return False
        if len(set(value.lower())) < 4 or re.search(r"[Xx]{8,}|\*{4,}", value):
            return False
        return self.words.residual(value) >= 3

    def _phrase(self, value: str) -> bool:
        """Tell whether a value with blanks is a pass phrase: words and numbers that are mostly none of the files."""
        parts = value.split(" ")
        if len(parts) < 4 or not all(re.fullmatch(r"[A-Za-z]{2,}|\d+", p) for p in parts) or not any(p.isdigit() for p in parts):
            return False
        letters = sum(map(len, parts))
        return not any(p.lower() in _PLAIN for p in parts) and 2 * self.words.residual(value) >= letters

    def _opaque(self, name: str, value: str) -> bool:
        """Tell whether a value under a name that does not tell is one by itself: long, and no words at all."""
        if _FORMAT.match(value) or _PLACEHOLDER.match(value) or _LOOKUP.match(value) or _HASH.match(value):
            return False
        kinds = sum(any(map(test, value)) for test in (str.islower, str.isupper, str.isdigit))
        solid = sum(map(str.isalnum, value))
        if kinds < 3 or solid < 0.85 * len(value) or len(set(value)) < 10 or self.words.words(name) & _PUBLIC:
            return False
        return self.words.residual(value) >= max(14, 0.8 * solid)

    def find(self, path: str | None, content: str) -> list[tuple[int, int]]:
        """Return the spans of credentials in ``content``, from 0 and with the end excluded."""
        lower = content.lower()
        if len(lower) != len(content):
            lower = "".join(c.lower() if c.isascii() else c for c in content)
        windows = self._windows(lower)
        manifest = "kind: Secret" in content
        pem = "PRIVATE KEY" in content
        config = path is None or _CONFIG.search(path) is not None
        opaque = [m for m in _OPAQUE.finditer(content) if config or m["v"]]
        if not windows and not manifest and not pem and not opaque:
            return []
        spans: set[tuple[int, int]] = set()
        keys = []
        if pem:
            keys = [m.span() for m in _PEM.finditer(content) if len(re.sub(r"\\[nr]|[^A-Za-z0-9+/=]", "", m[0])) > 100]
            spans.update(keys)

        def inside(a: int, b: int) -> bool:
            return any(x < b and a < y for x, y in keys)

        def add(m: re.Match, group: str = "v", named: bool = True) -> bool:
            a, b = m.span(group)
            if a < 0 or inside(a, b) or not self._is(m[group], named):
                return False
            spans.add((a, b))
            return True

        def literal(m: re.Match) -> str:
            return next(g for g in "dst" if m[g] is not None)

        def matches(pattern: re.Pattern) -> Iterator[re.Match]:
            for start, end in windows:
                yield from pattern.finditer(content, start, end)

        for m in matches(_ASSIGN):
            group = literal(m)
            value = m[group]
            if "://" in value or inside(*m.span(group)):
                continue
            parts, at = [m.span(group)], m.end()
            while (more := _MORE.match(content, at)) and "\n" in content[at : more.start(literal(more))]:
                parts.append(more.span(literal(more)))
                at = more.end()
            whole = "".join(content[a:b] for a, b in parts)
            if self._is(whole):
                spans.update(parts)
        for m in matches(_AFTER):
            add(m, literal(m))
        for m in matches(_LOGIN):
            add(m, literal(m))
        if config:
            for m in matches(_BARE):
                if "://" not in m["v"]:
                    add(m)
        for pattern in (_INSIDE, _HEADER, _ADDRESS, _OPTION):
            for m in matches(pattern):
                add(m)
        for m in matches(_NOTE):
            if re.search(r"\d", m["v"]) or self.words.residual(m["v"]) >= 8:
                add(m, named=False)
        for m in matches(_KNOWN):
            add(_Whole(m), named=False)
        for m in _MANIFEST.finditer(content) if manifest else ():
            for block in _DATA.finditer(m[0]):
                for row in _ROW.finditer(block["rows"]):
                    start = m.start() + block.start("rows") + row.start("v")
                    try:
                        plain = base64.b64decode(row["v"], validate=True).decode()
                    except ValueError:
                        plain = row["v"]
                    if self._is(plain):
                        spans.add((start, start + len(row["v"])))
        for m in opaque:
            group = "v" if m["v"] else "b"
            a, b = m.span(group)
            if not inside(a, b) and not any(x < b and a < y for x, y in spans):
                under = _UNDER.search(content, max(content.rfind("\n", 0, a) + 1, a - 200), m.start())
                if under and self._opaque(under[1], m[group]):
                    spans.add((a, b))
        return self._merged(spans)

    @staticmethod
    def _windows(lower: str) -> list[tuple[int, int]]:
        """Return the lines that have a hint, each with the two lines after it."""
        out: list[tuple[int, int]] = []
        for m in _HINT.finditer(lower):
            if out and m.start() < out[-1][2]:
                continue
            start = lower.rfind("\n", 0, m.start()) + 1
            end = own = lower.find("\n", m.end())
            for _ in range(2):
                end = lower.find("\n", end + 1) if end >= 0 else -1
            end, own = (x if x >= 0 else len(lower) for x in (end, own))
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], end, own)
            else:
                out.append((start, end, own))
        return [(a, b) for a, b, _ in out]

    @staticmethod
    def _merged(spans: set[tuple[int, int]]) -> list[tuple[int, int]]:
        """Return the spans without those that lie inside another one."""
        out: list[tuple[int, int]] = []
        for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
            if not out or a >= out[-1][1]:
                out.append((a, b))
        return out


class _Whole:
    """A match whose only group is all of it."""

    def __init__(self, match: re.Match) -> None:
        self.match = match

    def span(self, _: str) -> tuple[int, int]:
        return self.match.span()

    def __getitem__(self, _: str) -> str:
        return self.match[0]


def dictionary(files: DataFrame) -> Dictionary:
    """Count the words of the identifiers of all files that are not configuration.

    A word's count is the number of files that have it. Words are summed within each task
    before the shuffle. At most ``WORDS`` words, those of the greatest counts, are kept, and of
    them those in at least two files and a share of ``SHARE`` of all.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                found[""] += 1
                if not path or not (_CONFIG.search(path) or path.endswith(".json")):
                    found.update(words_of(content.as_py()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "files"]
        )

    counted = files.select("target_file", "content").filter("content is not null").mapInArrow(
        count, "word string, files long"
    )
    rows = counted.groupBy("word").agg(F.sum("files").alias("files")).orderBy(F.desc("files"), "word").limit(WORDS + 1)
    shares = {r["word"]: r["files"] for r in rows.collect()}
    total = max(1, shares.pop("", 0))
    return Dictionary({w: n / total for w, n in shares.items() if n >= max(2, SHARE * total)})


def credentials(files: DataFrame) -> DataFrame:
    """Return (``file_id``, ``start_pos``, ``end_pos``) of each credential.

    Positions count code points from 1 and are both inclusive. A file of null content has none;
    one of null path is read both as code and as configuration. Repeated files give their rows
    each, an empty table gives none, and other columns are ignored.
    """
    sent = files.sparkSession.sparkContext.broadcast(dictionary(files))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(sent.value)
        for batch in batches:
            ids, starts, ends = [], [], []
            for i, path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for a, b in finder.find(path, content.as_py()):
                    ids.append(i)
                    starts.append(a + 1)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (ids, starts, ends)], ["file_id", "start_pos", "end_pos"]
            )

    return (
        files.select(F.col("file_id").cast("long").alias("file_id"), "target_file", "content")
        .filter("content is not null")
        .mapInArrow(find, "file_id long, start_pos long, end_pos long")
    )


def masked(value: str) -> str:
    """Return ``value`` with an X for each character but white space and escapes."""
    return re.sub(r"\\.|\s|.", lambda m: m[0] if len(m[0]) == 2 or m[0].isspace() else "X", value, flags=re.S)


def redacted(files: DataFrame) -> DataFrame:
    """Return (``file_id``, ``content``, ``masked``): all files, with their credentials masked.

    Everything else stays as it was, and so do the lengths; ``masked`` counts the values.
    """
    sent = files.sparkSession.sparkContext.broadcast(dictionary(files))

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(sent.value)
        for batch in batches:
            out, counts = [], []
            for path, content in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                spans = finder.find(path, content) if content is not None else []
                at, parts = 0, []
                for a, b in spans:
                    parts += [content[at:a], masked(content[a:b])]
                    at = b
                out.append(None if content is None else "".join([*parts, content[at:]]))
                counts.append(len(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.string()), pa.array(counts, pa.int64())],
                ["file_id", "content", "masked"],
            )

    return files.select(F.col("file_id").cast("long").alias("file_id"), "target_file", "content").mapInArrow(
        mask, "file_id long, content string, masked long"
    )
