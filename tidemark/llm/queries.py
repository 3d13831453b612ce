"""One registered query per operator of this folder, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bisector_clusters, bpe, embedding_dedup, filter_audit, html_text, line_dedup, mixing, packing, quality, simhash, substring_dedup, suffix_dedup, url_filter
from tidemark.llm.shared import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# The rules of the URL filter as (verdict, host, path), and listed domains to block.
URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]
LISTED_NAMES = ["ads-track", "free-bets", "cheap-pills", "spam-farm", "casino-win", "adult-x"]
LISTED_ZONES = ["com", "net", "org"]


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def packed(docs: DataFrame) -> DataFrame:
    """Sequences of 2048 tokens; the tokenizer's files lie on every machine."""
    import public_tokenizers

    files = {"tokenizer": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken")}
    return packing.pack_documents(docs, capacity=2048, end_id=0, pattern=public_tokenizers.PATTERN, **files)


@query("op1_best_fit_packing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    out = packed(read(spark, folder, "documents", "doc_id", "text"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op2_substring_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    out = substring_dedup.dedup_passages(read(spark, folder, "documents", "doc_id", "text"), length=35)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(F.col("id").alias("doc_id"), "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_suffix_array_dedup")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    out = suffix_dedup.dedup_bytes(read(spark, folder, "documents", "doc_id", "text"), length=50)
    return out.select(
        F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def mixed(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs, share=1.5, weights=(5.0, 2.0, 1.0), limit=2)


@query("op3_mix_sources")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    out = mixed(read(spark, folder, "documents", "doc_id", "text", "source"))
    return out.select(
        "doc_id", F.col("m_size").alias("size"), F.col("m_source_size").alias("source_size"),
        F.col("m_target").alias("target"), F.col("m_taken").alias("taken"),
    )


@query("op4_embedding_dedup")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    out = embedding_dedup.near_duplicates(read(spark, folder, "embeddings", "vec_id", "embedding", "label"), cosine=0.98)
    return out.withColumnRenamed("id", "vec_id")


@query(
    "op5_line_dedup",
    """
    WITH lines AS (
        SELECT doc_id, generate_subscripts(x, 1) - 1 AS ln, unnest(x) AS line
        FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)
    ),
    full_lines AS (
        SELECT doc_id, ln, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS s,
               row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS place
        FROM lines WHERE trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> ''
    ),
    gone AS (
        SELECT doc_id, place FROM (SELECT doc_id, place, row_number() OVER (PARTITION BY s ORDER BY doc_id, place) AS n FROM full_lines) WHERE n > 1
    ),
    marked AS (SELECT g.doc_id, f.ln, g.place, g.place - row_number() OVER (PARTITION BY g.doc_id ORDER BY g.place) AS island
               FROM gone g JOIN full_lines f ON g.doc_id = f.doc_id AND g.place = f.place),
    kept AS (
        SELECT l.doc_id, count(*) AS n_lines, count(m.ln) AS n_removed, count(DISTINCT m.island) AS n_runs,
               coalesce(string_agg(l.line, chr(10) ORDER BY l.ln) FILTER (WHERE m.ln IS NULL), '') AS kept
        FROM lines l LEFT JOIN marked m ON l.doc_id = m.doc_id AND l.ln = m.ln GROUP BY 1
    )
    SELECT doc_id, n_lines, n_removed, n_runs, sha256(kept) AS kept_sha256 FROM kept
    """,
)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.dedup_lines(read(spark, folder, "documents", "doc_id", "text"), least_lines=1)
    return out.select(
        "doc_id", F.col("l_lines").alias("n_lines"), F.col("l_removed").alias("n_removed"), F.col("l_runs").alias("n_runs"),
        F.sha2("l_text", 256).alias("kept_sha256"),
    )


def listed_urls(spark: SparkSession) -> DataFrame:
    """The rules and the listed canonical URLs of the query."""
    domains = [("block", f"{name}.example.{zone}", "/", False) for name in LISTED_NAMES for zone in LISTED_ZONES]
    return spark.createDataFrame([(*r, True) for r in URL_RULES] + domains, "verdict string, host string, path string, is_rule boolean")


_RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}', true)" for v, h, p in URL_RULES) + ", " + ", ".join(
    f"('block', '{n}.example.{z}', '/', false)" for n in LISTED_NAMES for z in LISTED_ZONES
)


@query(
    "op6_url_filter",
    f"""
    WITH entries(verdict, host, path, is_rule) AS (VALUES {_RULES_SQL}),
    u AS (
        SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
               regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*(/[^?#]*)', 1) AS path
        FROM pages
    ),
    hits AS (
        SELECT u.host, u.path, arg_max(e.host || e.path, (e.is_rule::INT * 1000000 + length(e.host || e.path)) * 1000 + length(e.host)) AS entry,
               arg_max(e.verdict, (e.is_rule::INT * 1000000 + length(e.host || e.path)) * 1000 + length(e.host)) AS verdict, bool_or(e.is_rule) AS is_rule
        FROM (SELECT DISTINCT host, path FROM u) u JOIN entries e
          ON (u.host = e.host OR ends_with(u.host, '.' || e.host)) AND starts_with(u.path, e.path)
        GROUP BY 1, 2
    )
    SELECT page_id, u.host, u.path, CASE WHEN is_rule THEN entry END AS rule, coalesce(verdict, 'allow') AS verdict
    FROM u LEFT JOIN hits h ON u.host = h.host AND u.path = h.path
    """,
)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    out = url_filter.filter_urls(read(spark, folder, "pages", "page_id", "url"), listed_urls(spark))
    return out.drop("entry")


@query("op7_simhash")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    out = simhash.near_duplicates(read(spark, folder, "documents", "doc_id", "text"), shingle=4, seed=42, radius=4)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_quality_rules")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    out = quality.judge(read(spark, folder, "documents", "doc_id", "text", "source"))
    return out.select("doc_id", *[F.col(f"q_{c}").alias(c) for c in (*quality.COUNTS, "base_failed", "kept")])


@query("op10_html_extraction")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_main(read(spark, folder, "pages", "page_id", "url", "html")).drop("container")


@query("op11_byte_bpe")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.encode(read(spark, folder, "documents", "doc_id", "text"), ranks=ranks, pattern=public_tokenizers.PATTERN)
    out = bpe.decode(out, ranks=ranks)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query(
    "op12_filter_audit",
    r"""
    WITH d AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
               list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
        FROM documents
    ),
    m AS (
        SELECT part, list_filter([
                 CASE WHEN len(w) < 100 THEN 'A' END,
                 CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' END,
                 CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' END,
                 CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
                 CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' END], lambda x: x IS NOT NULL) AS fails,
               doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic
        FROM d
    ),
    c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY ALL),
    l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
    orders AS (
        SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
        WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
    ),
    steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
    s AS (
        SELECT c.*, filter_order, step, filter_order[step] AS f, list_has_any(fails, string_split(filter_order[:step - 1], '')) AND step > 1 AS early
        FROM c, steps
    ),
    out AS (
        SELECT part, filter_order, step, f,
               sum(CASE WHEN NOT early AND NOT list_contains(fails, f) THEN n ELSE 0 END)::BIGINT AS kept,
               sum(CASE WHEN NOT early AND list_contains(fails, f) THEN n ELSE 0 END)::BIGINT AS removed,
               sum(CASE WHEN early AND list_contains(fails, f) THEN n ELSE 0 END)::BIGINT AS redundant,
               sum(CASE WHEN fails = [f] THEN n ELSE 0 END)::BIGINT AS unique_fails,
               sum(CASE WHEN NOT early AND list_contains(fails, f) THEN good ELSE 0 END)::BIGINT AS good_lost,
               sum(CASE WHEN NOT early AND list_contains(fails, f) THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
        FROM s GROUP BY ALL
    )
    SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley
    FROM out
    """,
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    words, distinct, upper, chars, symbols = (F.col(c) for c in filter_audit.MEASURES)
    filters = {"A": words < 100, "B": 100 * distinct < 80 * words, "C": 100 * upper > 10 * chars, "D": symbols > 0}
    docs, labels = read(spark, folder, "documents", "doc_id", "text", "lang"), read(spark, folder, "labels", "doc_id", "quality", "toxic")
    return filter_audit.audit(docs, labels, filters)


def _clusters_sql(rounds: int = 10, k: int = 8, size: int = 64) -> str:
    """Every round as a table of (centroid, dimension, value), from the one before."""
    assign = """
        SELECT vec_id, arg_min(num, (d, num)) AS num, min(d) AS d FROM (
            SELECT v.vec_id, c.num, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{0} c ON v.i = c.i GROUP BY 1, 2
        ) GROUP BY 1"""
    text = f"""
    WITH kept AS (
        SELECT vec_id, embedding FROM embeddings
        WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {size}
    ),
    v AS MATERIALIZED (
        SELECT vec_id, i, floor(1024 * embedding[i]::DOUBLE)::BIGINT AS x FROM (SELECT vec_id, embedding, unnest(range(1, {size + 1})) AS i FROM kept)
    ),
    starts AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS num FROM kept ORDER BY num LIMIT {k}),
    c0 AS MATERIALIZED (SELECT num, i, x FROM v JOIN starts USING (vec_id)),"""
    for n in range(rounds):
        text += f"""
    m{n} AS MATERIALIZED (
        SELECT num, i, ((s - ((s % n) + n) % n) / n)::BIGINT AS x FROM (
            SELECT a.num, v.i, sum(v.x)::BIGINT AS s, count(*) AS n FROM v JOIN ({assign.format(n)}) a ON v.vec_id = a.vec_id GROUP BY 1, 2
        )
    ),
    c{n + 1} AS MATERIALIZED (SELECT num, i, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m USING (num, i)),"""
    return text + f"""
    a AS MATERIALIZED ({assign.format(rounds)}),
    h AS (SELECT num, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY 1)
    SELECT vec_id, num::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY num)::BIGINT AS cluster_inertia,
           sum(d) OVER ()::BIGINT AS inertia, centroid_sha256
    FROM a JOIN h USING (num)
    """


@query("op13_bisector_clusters", _clusters_sql())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    out = bisector_clusters.cluster(read(spark, folder, "embeddings", "vec_id", "embedding"), k=8, rounds=10, seed=3)
    digest = F.sha2(F.array_join(F.transform("centroid", lambda c: c.cast("string")), ","), 256)
    return out.withColumn("centroid_sha256", digest).drop("centroid")
