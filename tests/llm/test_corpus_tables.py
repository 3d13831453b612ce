"""Mixing, URL filter, quality rules and HTML extraction against plain versions and on odd tables."""

import brute
import numpy as np
import pytest
from compare import check, connection
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.llm import html_text, line_dedup, mixing, quality, url_filter
from tidemark.llm.queries import listed_urls

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, `a.b` string"


def odd_docs(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, None, None, None, None, 5, "x"), (2, "", "en", "a", 0, None, None), (3, "one two\nthree", "en", "a", 13, 1, "y"), (3, "one two\nthree", "en", "a", 13, 1, "y"),
        (None, "one\u00a0two  é\tx", "en", None, 3, 1, "z"), (4, long, "en", "b", len(long), 1, "q"), (5, " \n ", "en", "b", 3, 1, "q"), (6, "é" * 70, "en", "𝒳", 70, 1, ""),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name", ["op5_line_dedup", "op6_url_filter"])
def test_sql(spark, folder, name):
    problem, _, _ = check(spark, connection(folder), name, entry.queries()[name], entry.oracle_sql()[name], folder)
    assert problem is None


def test_quality_counts(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = entry.queries()["op9_quality_rules"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, dup, repeat = brute.quality_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (r.kept and r.base_failed)


def test_quality_odd(spark):
    docs = odd_docs(spark)
    rows = quality.judge(docs).collect()
    assert len(rows) == 8 and rows[0].asDict().keys() >= {"a.b", "size"}
    for r in rows:
        assert (r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words) == brute.quality_counts(r.text)
    assert quality.judge(docs.limit(0)).count() == 0


def test_frequent_lines_go(spark):
    body = [" ".join(f"d{d}w{i}" for i in range(60)) for d in range(60)]
    rows = [(d, f" Shared Header\n{body[d]}\n", "en", "h", 0, 0, "") for d in range(60)]
    rows += [(100 + d, ("share line one two three four five six seven\n" * 9) + f"u{d} v{d}\n", "en", "h", 0, 0, "") for d in range(40)]
    out = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, DOCS), at_least=20, least_words=5, repeat_percent=100).collect()}
    assert all(out[d].q_kept for d in range(60)) and "Shared" not in out[3].q_text
    assert not any(out[100 + d].q_kept for d in range(40)) and out[101].q_text == "u1 v1\n"


def test_copies_of_a_text_are_one_document(spark):
    text = "\n".join(" ".join(f"l{j}w{i}" for i in range(20)) for j in range(5))
    rows = [(d, text, "en", "h", 0, 0, "") for d in range(300)]
    assert all(r.q_kept for r in quality.judge(spark.createDataFrame(rows, DOCS)).collect())


def test_mix_targets_and_budget(spark, folder):
    rows = entry.queries()["op3_mix_sources"](spark, folder).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    sizes, taken, target = {}, {}, {}
    for r in rows:
        s = docs[r.doc_id].source
        assert r.size == len(brute.words(docs[r.doc_id].text)) and r.taken in (0, r.size, 2 * r.size)
        sizes[s], taken[s], target[s] = sizes.get(s, 0) + r.size, taken.get(s, 0) + r.taken, r.target
        assert r.source_size >= r.size
    want = brute.targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 0.02 * target[s]
    again = entry.queries()["op3_mix_sources"](spark, folder).collect()
    assert sorted(rows) == sorted(again)


def test_mix_odd(spark):
    rows = mixing.mix(odd_docs(spark)).collect()
    assert len(rows) == 8 and all(r.m_taken == r.m_copies * r.m_size for r in rows)
    assert {r.source: r.m_target for r in rows} == pytest.approx(brute.targets({None: 3, "a": 6, "b": 60_000, "𝒳": 1}))
    assert mixing.mix(odd_docs(spark).limit(0)).count() == 0


def test_fit_is_exact_where_a_sum_exists():
    rng = np.random.default_rng(3)
    for _ in range(40):
        sizes = np.unique(rng.integers(1, 60, 6))
        counts = rng.integers(0, 5, len(sizes))
        sums = {0}
        for s, c in zip(sizes, counts):
            sums = {x + s * k for x in sums for k in range(c + 1)}
        budget = int(rng.integers(0, int((sizes * counts).sum()) + 3))
        got = mixing.fit_counts(sizes, counts, budget)
        assert (got <= counts).all() and (got >= 0).all()
        want = min(abs(x - budget) for x in sums)
        assert budget > max(sums) or abs(int((sizes * got).sum()) - budget) == want
    big = np.arange(1, 3000)
    got = mixing.fit_counts(big, np.full(len(big), 40), 71_234_567)
    assert (big * got).sum() == 71_234_567


def test_urls_odd(spark):
    rows = [
        (1, None), (2, "no scheme"), (3, "http://A.Example.ORG/es/x"), (3, "http://A.Example.ORG/es/x"), (4, "http://example.org"), (None, "https://x.com/fr/a?b#c"),
        (5, "http://notorg/"), (6, "http://org/"), (7, "http://a.example.org/en/12"), (8, "x://" + "a." * 5000 + "com/de/"), (9, "http://www.spam-farm.example.net/q"), (10, "http://casino-win.example.org/q"), (11, "http://h?x://y/de"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("clash"))
    got = [(r.page_id, r.rule, r.verdict) for r in url_filter.filter_urls(pages, listed_urls(spark)).collect()]
    want = [
        (1, None, "allow"), (2, None, "allow"), (3, "example.org/es/", "block"), (3, "example.org/es/", "block"), (4, None, "allow"), (None, "com/fr/", "allow"),
        (5, None, "allow"), (6, "org/", "allow"), (7, "example.org/en/1", "block"), (8, "com/de/", "block"), (9, None, "block"), (10, "org/", "allow"), (11, None, "allow"),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)
    none = url_filter.filter_urls(pages, listed_urls(spark).limit(0)).collect()
    assert len(none) == len(rows) and {r.verdict for r in none} == {"allow"}
    assert url_filter.filter_urls(pages.limit(0), listed_urls(spark)).count() == 0


def test_bloom_has_no_false_negative(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"))
    words = url_filter.bloom_words(keys, "key", 256).scalar()
    seen = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"), "id", words.alias("w")).filter(url_filter.maybe_listed(F.col("key"), F.col("w"), 256))
    inside, outside = seen.filter("id < 2000").count(), seen.filter("id >= 2000").count()
    assert inside == 2000 and outside < 1200


def test_pages(spark, folder):
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = entry.queries()["op10_html_extraction"](spark, folder).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == brute.page_text(pages[r.page_id].html) and r.n_chars == len(r.text)


PAGE = """<html><head><title>no</title></head><body><header class=top>no</header><div class="sidebar left">no</div><div id="cookie-notice">no</div>
<div class="post-body3 has-sidebar"><h2>Head &amp; more</h2><p>First   <a href=x>linked</a> &eacute;<br>text</p><script>if(a<b){x="</p>"}</script><div class="ad-box">no <b>no</b></div>
<ul><li>one<li>two</ul><form><p>no</p></form><blockquote>quote</blockquote></div><div class="comments"><p>%s</p></div><footer>no</footer></body></html>"""


def test_other_layouts(spark):
    rows = [(i, f"http://h.example/{i}", PAGE % ("comment " * 80)) for i in range(4)]
    rows += [(9, None, None), (10, "u", ""), (11, "http://h.example/p", "plain &lt;text&gt;"), (11, "http://h.example/p", "plain &lt;text&gt;"), (None, "http://h.example/c", "<p>cut <b>off <i")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = [(r.page_id, r.text) for r in html_text.extract_main(pages).collect()]
    article = "Head & more First linked é text one two quote"
    want = [(i, article) for i in range(4)] + [(9, ""), (10, ""), (11, "plain <text>"), (11, "plain <text>"), (None, "cut off")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert html_text.extract_main(pages.limit(0)).count() == 0


def plain_lines(rows, least):
    """rows: (id, text), each row a document of its own; which lines of each stay."""
    seen, out = set(), []
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0)):
        lines = (rows[i][1] or "").split("\n")
        at = [k for k, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
        gone = set()
        for p in range(len(at) - least + 1):
            run = tuple(lines[k].strip(" \t\r\x0b\x0c") for k in at[p : p + least])
            if run in seen:
                gone.update(at[p : p + least])
            seen.add(run)
        out.append((rows[i][0], None if rows[i][1] is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_line_runs(spark, least):
    rng = np.random.default_rng(least)
    rows = [(int(i) if i else None, "\n".join(str(rng.choice(["a", " a ", "b", "c\r", "", "d"])) for _ in range(rng.integers(0, 14)))) for i in range(60)]
    docs = spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], DOCS)
    got = line_dedup.dedup_lines(docs, least_lines=least).collect()
    assert sorted([(r.doc_id, r.l_text, r.l_removed) for r in got], key=str) == plain_lines(rows, least)


def test_lines_odd(spark):
    docs = odd_docs(spark)
    got = {(r.doc_id, r.l_text, r.l_removed, r.l_lines) for r in line_dedup.dedup_lines(docs).collect()}
    assert (1, None, 0, 0) in got and (3, "one two\nthree", 0, 2) in got and len(got) == 7
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_copies_of_one_line_go_and_many_lines_take_no_square(spark):
    many = "\n".join(f"line {i % 40_000}" for i in range(80_000))
    docs = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in enumerate(["only line", " only line", many])], DOCS)
    got = {r.doc_id: (r.l_text, r.l_removed, r.l_runs) for r in line_dedup.dedup_lines(docs, least_lines=1).collect()}
    assert got == {0: ("only line", 0, 0), 1: ("", 1, 1), 2: ("\n".join(f"line {i}" for i in range(40_000)), 40_000, 1)}


def test_single_long_lines_go(spark):
    long, short = " ".join(f"p{i}" for i in range(50)), " ".join(f"q{i}" for i in range(49))
    texts = [long, f"a\n{long}\nb", f" {long} ", f"{short}\nc\n{long}\n{long}\nd", short, f"{short}\ne"]
    docs = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: (r.l_text, r.l_removed, r.l_runs) for r in line_dedup.dedup_lines(docs, long_words=50).collect()}
    assert got == {0: (long, 0, 0), 1: ("a\nb", 1, 1), 2: ("", 1, 1), 3: (f"{short}\nc\nd", 2, 1), 4: (short, 0, 0), 5: (f"{short}\ne", 0, 0)}
    from corpus_pipeline import line_stage

    assert {r.doc_id: r.text for r in line_stage(spark, docs, "").collect()} == {i: t for i, (t, _, _) in got.items()}


NESTED = """<html><body><nav>menu</nav><article><h1>Head %d</h1><p>lead</p><div class=body><p>%s</p></div></article><div class=x><h2>%s</h2></div></body></html>"""
DIVS = """<html><body><nav>menu</nav><div class=post><h1>Head %d</h1><p>lead</p><div class=body><p>%s</p></div></div></body></html>"""
FORM = """<html><body><form action=x><nav>menu</nav><div class="%s"><header>no</header><h1>Head %d</h1><p>%s</p><div class=ad>no</div></div></form></body></html>"""


def test_text_beside_the_widest_container_and_inside_wrappers(spark):
    long = "many words " * 40
    rows = [(i, f"http://n.example/{i}", NESTED % (i, long, "elsewhere")) for i in range(3)]
    rows += [(10 + i, f"http://d.example/{i}", DIVS % (i, long)) for i in range(3)]
    rows += [(20 + i, f"http://f.example/{i}", FORM % ("menu-open", i, long)) for i in range(3)]
    rows += [(30 + i, f"http://g.example/{i}", FORM % ("page-header-fixed", i, long)) for i in range(3)]
    got = {r.page_id: r.text for r in html_text.extract_main(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"Head {i % 10}{' lead' if i < 20 else ''} {long.strip()}" for i, _, _ in rows}


def test_near_copies_count_once(spark):
    lines = [" ".join(f"l{j}w{i}" for i in range(20)) for j in range(8)]
    rows = [(d, "\n".join([*lines, f"copy {d}"]), "en", "h", 0, 0, "") for d in range(40)]
    rows += [(100 + d, "Top\nHeader Line\n" + " ".join(f"d{d}w{i}" for i in range(60)), "en", "h", 0, 0, "") for d in range(60)]
    out = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(r.q_kept for r in out.values()) and out[7].q_text == out[7].text
    assert all("Top" not in out[100 + d].q_text and "Header" not in out[100 + d].q_text for d in range(60))
