"""Plain Python versions to test against."""

import random
import re
from itertools import combinations


def words(text):
    return [w.lower() for w in re.findall(r"[^\W_]+", text or "")]


def grams(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def similarity(a, b, n):
    x, y = grams(a, n), grams(b, n)
    return len(x & y) / len(x | y) if x and y else 0.0


def groups(texts, n, threshold):
    parent = {i: i for i, t in texts.items() if grams(t, n)}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(parent), 2):
        if similarity(texts[a], texts[b], n) >= threshold - 1e-12:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in parent}


def rejected(rows, n, threshold):
    """``rows``: (id, turn, text) in order; turn 0 is all accepted."""
    accepted, out = [], {}
    for i, turn, text in rows:
        like = [j for j, t in accepted if similarity(t, text, n) >= threshold - 1e-12] if turn else []
        if like:
            out[i] = min(like)
        else:
            accepted.append((i, text))
    return out


def family(seed, bases=8, copies=6, length=90, vocabulary=400):
    """Random texts with lightly and heavily edited copies of each."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(vocabulary)]
    out = []
    for _ in range(bases):
        base = r.choices(vocab, k=length)
        for c in range(copies):
            text = list(base)
            for _ in range(r.choice([0, 1, 2, 4, 6, 9, 30])):
                at = r.randrange(len(text))
                text[at : at + r.randint(0, 1)] = [r.choice(vocab)]
            out.append(" ".join(text))
    r.shuffle(out)
    return out
