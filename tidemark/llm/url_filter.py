"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A listed entry is a canonical ``host + path`` start: it fits its host and all subdomains of it if the
path of a URL starts with the entry's path. Each URL offers as keys its host suffixes joined with the
path starts of the listed lengths; a key that the Bloom filter does not know is certainly not listed,
so only the few possible hits reach the join with the list, which removes the false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import cut_lineage, named

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The filter: blocks of BLOCK_WORDS 64-bit words, PROBES bits per key, at most MAX_BLOCKS blocks (4 MB in all).
BLOCK_WORDS, PROBES, KEYS_PER_BLOCK, MAX_BLOCKS = 4, 6, 16, 1 << 17
# A list of at most so many entries is broadcast to the join; a longer one is shuffled.
BROADCAST_ENTRIES = 100_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty for none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def _bits(key: Column, blocks: int) -> tuple[Column, Column]:
    """The block of a key, and its PROBES bit positions there."""
    block = F.pmod(F.xxhash64(key), F.lit(blocks))
    second = F.xxhash64(key, F.lit(1))
    places = F.array(*[F.shiftrightunsigned(second, 8 * i).bitwiseAND(F.lit(64 * BLOCK_WORDS - 1)) for i in range(PROBES)])
    return block, places


def bloom_words(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """One row with the filter's words as an array of ``blocks * BLOCK_WORDS`` longs."""
    block, places = _bits(F.col(key), blocks)
    bits = listed.select(block.alias("block"), F.explode(places).alias("bit"))
    word = F.col("block") * BLOCK_WORDS + F.shiftright("bit", 6)
    words = bits.groupBy(word.cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")
    )
    known = words.agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("known"))
    every = F.sequence(F.lit(0), F.lit(blocks * BLOCK_WORDS - 1))
    return known.select(F.transform(every, lambda i: F.coalesce(F.try_element_at("known", i), F.lit(0).cast("long"))).alias("words"))


def maybe_listed(key: Column, words: Column, blocks: int) -> Column:
    """False only if the key is certainly not in the filter."""
    block, places = _bits(key, blocks)
    return F.forall(
        places,
        lambda bit: F.getbit(F.get(words, (block * BLOCK_WORDS + F.shiftright(bit, 6)).cast("int")), bit.bitwiseAND(F.lit(63)).cast("int")) == 1,
    )


def filter_urls(pages: DataFrame, listed: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: ``id_col, host, path, rule, verdict, entry``.

    ``listed`` has the columns ``host, path, verdict, is_rule``: entries that are rules win over others,
    among their like the longest wins, then the longer host, then the smaller text. ``entry`` is
    what decided, ``rule`` is the same if it is a rule, else null; without an entry the verdict is
    ``default``. Null URLs and URLs without ``://`` have an empty host and path and hit nothing; a
    path that is empty does not start with ``/``. Repeated pages give repeated rows; a null id is
    kept; other columns of ``pages`` are ignored. An empty list leaves all at ``default``.
    """
    entries = listed.select(
        F.translate("host", UPPER, LOWER).alias("host"), F.col("path"), F.col("verdict"), F.col("is_rule")
    ).filter("host <> '' AND path IS NOT NULL").withColumn("key", F.concat("host", "path"))
    entries = cut_lineage(entries.dropDuplicates(["key", "is_rule"]))
    size, labels, lengths = entries.agg(
        F.count(F.lit(1)), F.max(F.size(F.split("host", r"\.", -1))), F.sort_array(F.collect_set(F.length("path")))
    ).first()
    urls = pages.select(named(id_col).alias("__id"), named(url_col).alias("__url"))
    urls = urls.withColumns({"host": host_of(F.col("__url")), "path": path_of(F.col("__url"))})
    if not size:
        hits = None
    else:
        blocks = min(MAX_BLOCKS, 1 << max(0, (size // KEYS_PER_BLOCK).bit_length()))
        words = bloom_words(entries, "key", blocks).scalar()
        # No entry's host has more labels than the longest listed one, so longer suffixes cannot fit.
        parts = F.split("host", r"\.", -1)
        depths = F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels)))
        suffixes = F.transform(depths, lambda n: F.array_join(F.slice("__parts", -n, n), "."))
        starts = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
        starts = F.transform(starts, lambda n: F.substring(F.col("path"), F.lit(1), n))
        keys = F.flatten(F.transform("__suffixes", lambda h: F.transform("__starts", lambda p: F.concat(h, p))))
        distinct = urls.filter("host <> ''").select("host", "path").distinct()
        offered = distinct.withColumn("__parts", parts).withColumns({"__suffixes": suffixes, "__starts": starts})
        offered = offered.select("host", "path", keys.alias("__keys"), words.alias("__words"))
        possible = F.filter("__keys", lambda k: maybe_listed(k, F.col("__words"), blocks))
        possible = offered.select("host", "path", F.explode(possible).alias("key"))
        known = entries.select("key", F.col("host").alias("entry_host"), "verdict", "is_rule")
        known = F.broadcast(known) if size <= BROADCAST_ENTRIES else known.hint("shuffle_hash")
        best = F.max(F.struct(
            F.col("is_rule"), F.length("key").alias("n"), F.length("entry_host").alias("m"), F.col("key").alias("entry"), F.col("verdict")
        ))
        hits = possible.join(known, "key").groupBy("host", "path").agg(best.alias("__best"))
    out = urls.join(hits, ["host", "path"], "left") if hits is not None else urls.withColumn("__best", F.lit(None).cast("struct<is_rule:boolean,entry:string,verdict:string>"))
    return out.select(
        F.col("__id").alias(id_col), "host", "path",
        F.when(F.col("__best.is_rule"), F.col("__best.entry")).alias("rule"),
        F.coalesce("__best.verdict", F.lit(default)).alias("verdict"),
        F.col("__best.entry").alias("entry"),
    )
