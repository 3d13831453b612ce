"""Main text of web pages by consensus of a host's pages.

Every page is cut into text blocks, each with the path of the elements around it; a path is generalised
by keeping tag names and classes without digits and dropping positions. On each page the containers on
the path are scored by the text they hold, less links and boilerplate. The pages of a host vote
for the paths they scored best, Spark counts the votes, and every page is extracted again from the
winning path that it has.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import cut_lineage, named
from tidemark.llm.url_filter import host_of

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# Elements without content, elements that break a line of text, elements never part of an article.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript template textarea title iframe svg math xmp".split())
NEVER = frozenset("nav header footer aside form button select option label fieldset dialog menu canvas object audio video head".split()) | RAW
CONTAINER = frozenset("article main section div td body blockquote".split())
# Words of class, id and role names that mark what is not article text.
NOISE = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar aside menu nav navbar navigation "
    "breadcrumb breadcrumbs header masthead footer comment comments disqus reply replies respond cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended toolbar widget contentinfo "
    "complementary search copyright legal".split()
)
CLOSED_BY = {"p": BLOCK - {"br"}, "li": frozenset({"li"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "tr": frozenset({"tr"}), "option": frozenset({"option"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"})}
# Votes of at most so many (host, path) pairs are broadcast to the pages.
BROADCAST_VOTES = 100_000
LAYOUT = re.compile(r"(?:no|has|with|without|is)[-_]", re.I)
SPACE = re.compile(r"\s+")


def _described(tag: str, attributes: str) -> tuple[str, bool]:
    """The generalised step of a path, and whether the element is no article text."""
    if not attributes:
        return tag, tag in NEVER
    step, noise = tag, tag in NEVER
    for kind, *values in ATTRIBUTE.findall(attributes):
        # A name like has-sidebar says what is around the element, not what it is.
        named_ = " ".join(v for v in "".join(values).split() if not LAYOUT.match(v))
        words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", named_).lower())
        noise = noise or (tag not in ("html", "body", "article", "main") and not NOISE.isdisjoint(words))
        if kind.lower() == "class" and words:
            step += "." + "-".join(words)
    return step, noise


# Words of an element that is not the wrapper of a page, however much of its text it holds; the share of a wrapper, in percent.
TALK = frozenset("comment comments disqus reply replies respond".split())
WRAPPER_PERCENT = 95


def blocks_of(source: str) -> list[tuple[str, str, int]]:
    """The text blocks of a page, see `_parsed`; forms and elements named like boilerplate that hold the whole page are none."""
    blocks, wrappers = _parsed(source, frozenset())
    return _parsed(source, wrappers)[0] if wrappers else blocks


def _parsed(source: str, wrappers: frozenset[int]) -> tuple[list[tuple[str, str, int]], frozenset[int]]:
    """The text blocks of a page in page order: path of the containers around it, text, characters inside links.

    Scripts, styles, menus and other boilerplate elements are left out; references are decoded and
    white space is one blank. Unclosed elements end where the next of their kind begins; a closing
    tag without its opening is ignored. ``wrappers`` are places of elements that are no boilerplate; also
    returned are the places of all others with nearly all text of the page, boilerplate included, in them.
    """
    out: list[tuple[str, str, int]] = []
    stack: list[tuple[str, str, bool, tuple[int, ...]]] = []  # tag, path, noise, places of possible wrappers around
    held: dict[int, int] = {}
    total = 0
    words: list[str] = []
    links = at = 0

    def flush() -> None:
        nonlocal links
        if words:
            text = SPACE.sub(" ", html.unescape("".join(words))).strip()
            if text:
                out.append((next((p for t, p, *_ in reversed(stack) if t in CONTAINER), ""), text, links))
            words.clear()
        links = 0

    def count(text: str) -> None:
        nonlocal total
        size = len(text.strip())
        total += size
        for place in stack[-1][3] if stack else ():
            held[place] = held.get(place, 0) + size

    while m := MARKUP.search(source, at):
        if m.start() > at:
            count(source[at:m.start()])
            if not (stack and stack[-1][2]):
                words.append(source[at:m.start()])
                links += (m.start() - at) * any(t == "a" for t, *_ in stack)
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in BLOCK:
            flush()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if stack[i][0] in CONTAINER and tag not in BLOCK:
                    break
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = re.compile(f"</{tag}(?![a-z0-9])[^>]*>?", re.I).search(source, at)
                at = end.end() if end else len(source)
        elif tag not in VOID and not m[3].endswith("/"):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CONTAINER:
                    break
                if tag in CLOSED_BY.get(stack[i][0], ()):
                    del stack[i:]
                    break
            step, noise = _described(tag, m[3])
            over = stack[-1] if stack else ("", "", False, ())
            around = over[3]
            if m.start() in wrappers:
                noise = False
            elif noise and (tag == "form" or tag not in NEVER) and TALK.isdisjoint(re.findall("[a-z]+", m[3].lower())):
                around = (*around, m.start())
            stack.append((tag, f"{over[1]}/{step}" if tag in CONTAINER else over[1], noise or over[2], around))
    if at < len(source):
        count(source[at:])
        if not (stack and stack[-1][2]):
            words.append(source[at:])
    flush()
    return out, frozenset(place for place, size in held.items() if 100 * size >= WRAPPER_PERCENT * total > 0)


def main_blocks(blocks: list[tuple[str, str, int]], container: str) -> tuple[list[str], str]:
    """The texts that belong to a container, and the container itself or the article around it.

    All of the outermost article around it belongs to it, or else of the main element. Without either, what stands
    directly in the elements around it does (a heading, a lead), unless it is all links.
    """
    steps = container.split("/")
    for tag in ("article", "main"):
        at = next((i for i, step in enumerate(steps) if step.partition(".")[0] == tag), None)
        if at is not None:
            container = "/".join(steps[: at + 1])
            return [t for p, t, _ in blocks if p == container or p.startswith(container + "/")], container
    around = {"/".join(steps[:i]) for i in range(2, len(steps))}
    inside = [t for p, t, n in blocks if not container or p == container or p.startswith(container + "/") or (p in around and len(t) > 2 * n)]
    return inside, container


def scored(blocks: list[tuple[str, str, int]]) -> list[tuple[str, float]]:
    """The containers of a page by falling score: text outside links in them and, at a discount, below them."""
    score: dict[str, float] = {}
    for path, text, links in blocks:
        value = max(0, len(text) - 2 * links)
        while path:
            score[path] = score.get(path, 0.0) + value
            # A wider container must bring clearly more text to win over a tighter one.
            value, path = value * 0.8, path.rpartition("/")[0]
    return sorted(score.items(), key=lambda x: (-x[1], -len(x[0]), x[0]))


def extract_main(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``id_col, url_col, text, n_chars``, plus the ``container`` path it was taken from.

    Votes weigh by score, at most one page's worth each. The path with most votes on a host that a
    page has with text is its container; a page with none of its host's voted paths (each page votes,
    so it has its own at least) keeps its own best. Null or empty html gives an empty text; a null
    URL is the host ``''``; repeated pages vote repeatedly and each give a row; other columns are
    ignored. Votes are aggregated map-side, so a hot host costs one row per task and path.
    """
    base = pages.select(named(id_col).alias("id"), named(url_col).alias("url"), named(html_col).alias("html"))
    base = base.withColumn("host", host_of(F.col("url")))

    def vote(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            best = [(h, s[0][0]) for h, source in zip(f["host"], f["html"], strict=True) if (s := scored(blocks_of(source or "")))]
            yield pd.DataFrame(best, columns=["host", "path"])

    votes = base.select("host", "html").mapInPandas(vote, "host string, path string").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"))
    # A path with one vote cannot beat a page's own best, so the list per host holds shared paths only.
    votes = cut_lineage(votes.filter("votes > 1"))
    ranked = votes.groupBy("host").agg(F.reverse(F.sort_array(F.collect_list(F.struct("votes", "path")))).alias("ranked"))
    ranked = ranked.select("host", F.transform("ranked", lambda r: r["path"]).alias("ranked"))
    # Pages do not move by host unless there are very many hosts.
    ranked = F.broadcast(ranked) if votes.count() <= BROADCAST_VOTES else ranked

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for source, paths in zip(f["html"], f["ranked"], strict=True):
                blocks = blocks_of(source or "")
                own = scored(blocks)
                known = {p for p, _ in own}
                container = next((p for p in (paths if paths is not None else ()) if p in known), own[0][0] if own else "")
                inside, container = main_blocks(blocks, container)
                rows.append((" ".join(inside), container))
            yield pd.DataFrame({"id": f["id"], "url": f["url"], "text": [t for t, _ in rows], "container": [c for _, c in rows]})

    kinds = dict(base.dtypes)
    joined = base.join(ranked, "host", "left").select("id", "url", "html", "ranked")
    found = joined.mapInPandas(extract, f"id {kinds['id']}, url {kinds['url']}, text string, container string")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"), "container")
