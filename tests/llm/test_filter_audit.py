"""The filter audit against SQL and against a plain count of every document in every order."""

from itertools import permutations

import brute
import pytest
from compare import check, connection
from pyspark.sql import functions as F
from test_corpus_tables import odd_docs

import __spark_entry__ as entry
from tidemark.llm import filter_audit


def filters():
    words, distinct, upper, chars, symbols = (F.col(c) for c in filter_audit.MEASURES)
    return {"A": words < 2, "B": 100 * distinct < 80 * words, "C": 100 * upper > 10 * chars, "D": symbols > 0}


def plain(docs, labels):
    """docs: (id, text, part); labels: (id, quality, toxic)."""
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = []
    for i, t, part in docs:
        t = t or ""
        w = brute.words(t)
        fails = {"A": len(w) < 2, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t)}
        fails["E"] = t in least and (i is None or i > least[t])
        rows.append((part or "", {c for c, x in fails.items() if x}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = sum(r[0] == part and f in r[1] for r in rows)
                only = sum(r[0] == part and r[1] == {f} for r in rows)
                out[part, "".join(order), step] = [len(left), len(here), failing - len(here), only, sum(r[2] for r in here), sum(r[3] for r in here)]
                shapley[f] += len(here)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[f])
    return out


def found(table):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r.part, r.filter_order, r.step): [r[c] for c in names] for r in table.collect()}


def test_sql(spark, folder):
    name = "op12_filter_audit"
    problem, _, _ = check(spark, connection(folder), name, entry.queries()[name], entry.oracle_sql()[name], folder)
    assert problem is None


@pytest.mark.parametrize("bits", [64, 3, 0])
def test_odd(spark, bits):
    docs = odd_docs(spark)
    more = [(i, f"text {i % 7} A" if i % 3 else "hot # text text text", "de" if i % 2 else None) for i in range(40)] + [(None, "text 1 A", "en"), (1, "text 1 A", "en")]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id bigint, text string, lang string"), allowMissingColumns=True).withColumnRenamed("size", "n_words")
    marks = [(1, 1, 0), (1, 0, 1), (3, 1, 1), (5, None, 1), (None, 1, 1), (99, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    got = found(filter_audit.audit(docs, labels, filters(), name_bits=bits))
    assert got == plain([(r.doc_id, r.text, r.lang) for r in docs.collect()], marks)
    assert filter_audit.audit(docs.limit(0), labels, filters()).count() == 0


def test_unique_texts_are_cleared(spark):
    names = spark.range(20_000).select(F.xxhash64("id").alias("h")).unionAll(spark.range(50).select(F.xxhash64("id").alias("h")))
    suspects = {r.h for r in filter_audit.possible_repeats(names, 20_050).collect()}
    assert {r.h for r in spark.range(50).select(F.xxhash64("id").alias("h")).collect()} <= suspects and len(suspects) < 150
