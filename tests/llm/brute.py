"""Plain single-machine versions of the operators, to hold their results against."""

from __future__ import annotations

import html
import re
from collections import Counter

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


def quality_counts(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def roots(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def page_text(source):
    """Texts of the paragraphs and headings of the only article of a generated page."""
    body = re.search(r"<article>(.*?)(?:</article>|\Z)", source or "", re.S)
    if not body:
        return ""
    parts = re.split(r"</?(?:p|h1)>", body[1])
    parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*(?:>|\Z)", "", p))).strip() for p in parts]
    return " ".join(p for p in parts if p)


def targets(sizes, share=1.5, weights=(5.0, 2.0, 1.0), limit=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        stops = [s for s in open_ if rest * w[s] / total > limit * sizes[s]]
        if not stops:
            out.update({s: rest * w[s] / total for s in open_})
            break
        for s in stops:
            out[s] = limit * sizes[s]
            open_.discard(s)
        rest -= sum(out[s] for s in stops)
    return out


def covered(spans, n):
    mark = [False] * n
    for a, b in spans:
        mark[a:b] = [True] * (b - a)
    return mark
