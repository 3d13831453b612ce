"""SimHash: fingerprints, links and groups against plain versions."""

import brute
import numpy as np
import xxhash
from pyspark.sql import functions as F
from test_corpus_tables import odd_docs

import __spark_entry__ as entry
from tidemark.llm import shared, simhash


def plain(text):
    w = [x.translate({65 + i: 97 + i for i in range(26)}) for x in brute.words(text)]
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, ids, radius=4):
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= radius]
    root = brute.roots(len(fps), links)
    least = {}
    for r, i in zip(root, ids):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [least.get(r) for r in root]


def test_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    fps = [plain(d.text) for d in docs]
    want = sorted((d.doc_id, f"{f:016x}", c) for d, f, c in zip(docs, fps, components(fps, [d.doc_id for d in docs])))
    rows = entry.queries()["op7_simhash"](spark, folder).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, rows)) == want


def test_odd(spark):
    docs = odd_docs(spark)
    rows = simhash.near_duplicates(docs).collect()
    source = docs.collect()
    fps = [plain(d.text) for d in source]
    want = [(d.doc_id, f, c) for d, f, c in zip(source, fps, components(fps, [d.doc_id for d in source]))]
    assert sorted([(r.id, r.fp % 2**64, r.component_id) for r in rows], key=str) == sorted(want, key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted({w[2] for w in want}, key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def random_fps(n, seed):
    rng = np.random.default_rng(seed)
    fps = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    for i in range(0, n - 1, 2):
        flip = rng.choice(64, rng.integers(0, 7), replace=False)
        fps[i + 1] = fps[i] ^ np.uint64(sum(1 << int(b) for b in flip))
    return np.unique(fps)


def test_links_of_all_tables_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 40)
    fps = np.concatenate([random_fps(150, 1), np.uint64(7 << 40) ^ (np.uint64(1) << np.arange(60, dtype=np.uint64))])
    fps = np.unique(fps)
    want = components([int(f) for f in fps], [int(f) for f in fps])
    for rows in (1, 1 << 24):
        monkeypatch.setattr(simhash, "tables_for", lambda n, radius, rows=rows: TABLES(rows, radius))
        table = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp bigint")
        root = {r.node % 2**64: r.root for r in simhash.link(table, 4).collect()}
        groups = {}
        for f, w in zip(fps, want):
            groups.setdefault(w, set()).add(root.get(int(f), int(np.int64(f.view(np.int64)))))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


TABLES = simhash.tables_for


def test_every_choice_covers_the_radius():
    assert [len(simhash.tables_for(n, 4)) for n in (1, 10**8, 10**11)] == [5, 15, 35]


def test_bit_sliced_distances():
    rng = np.random.default_rng(2)
    fps = random_fps(300, 9)
    runs = np.array([0, 1, 70, 70, 200, len(fps)])
    for radius in (0, 3, 4, 8):
        a, b = simhash.near_in_runs(fps, runs, radius)
        want = {(i, j) for lo, hi in zip(runs[:-1], runs[1:]) for i in range(lo, hi) for j in range(i + 1, hi) if int(fps[i] ^ fps[j]).bit_count() <= radius}
        assert set(zip(a.tolist(), b.tolist())) == want
    del rng


def edited_docs(seed=7):
    """Texts of one, of few and of many changed words: groups of like texts, chains, and unlike ones."""
    rng = np.random.default_rng(seed)
    out = []
    for g in range(6):
        words = [f"g{g}w{i}" for i in range(80)]
        for _ in range(25):
            copy = words.copy()
            for at in rng.choice(80, rng.integers(0, 4), replace=False):
                copy[at] = f"x{rng.integers(0, 1 << 30)}"
            out.append(" ".join(copy))
            words = copy if rng.random() < 0.3 else words
    return out + ["", " \n ", "one", "ONE", "two words", None]


def similar_roots(texts, fps, radius, shingle=5):
    sets = []
    for t in texts:
        w = [x.lower() for x in brute.words(t)]
        sets.append({" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {" ".join(w)} if w else set())
    alike = lambda x, y: x == y or 5 * len(x & y) >= 4 * len(x | y)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if (sets[i] == sets[j] or (fps[i] ^ fps[j]).bit_count() <= radius) and alike(sets[i], sets[j])]
    return brute.roots(len(sets), links)


def test_links_are_verified_against_brute_force(spark, monkeypatch):
    texts = edited_docs()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    fps = [int(f) for f in simhash.fingerprints(texts, 5, 42)]
    monkeypatch.setattr(simhash, "TILE", 20)
    monkeypatch.setattr(simhash, "FIRST_CANDIDATES", 1)
    # All pairs are compared, however far apart their fingerprints are.
    want = similar_roots(texts, fps, 64)
    assert want != similar_roots(texts, fps, 12)
    got = [r.doc_id for r in simhash.keep_one(docs, shingle=5).collect()]
    assert sorted(got) == sorted(set(want)) and 6 < len(got) < len(texts)


def test_next_candidates_name_every_pair():
    fps = np.sort(np.concatenate([random_fps(200, 5), np.uint64(7 << 40) ^ (np.uint64(1) << np.arange(60, dtype=np.uint64))]))
    runs, label = np.array([0, 1, 90, 90, len(fps)]), np.arange(len(fps)) // 2
    want = {(i, j) for i, j in zip(*map(np.ndarray.tolist, simhash.near_in_runs(fps, runs, 4))) if label[i] != label[j]}
    after, named = np.full(len(fps), -1), set()
    while True:
        a, b, more = simhash.next_near(fps, label, after, runs, 4, 3)
        named |= set(zip(a.tolist(), b.tolist()))
        after = np.full(len(fps), 1 << 40)
        after[more] = -1
        np.maximum.at(after, a[more[a]], b[more[a]])
        if not more.any():
            break
    assert named == want


def test_components_are_contracted_until_one_task_can_finish(spark, monkeypatch):
    rng = np.random.default_rng(9)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (220, 2))] + [(1000 + i, 1001 + i) for i in range(300)]
    table = spark.createDataFrame(links, "a bigint, b bigint")
    want = brute.roots(1400, links)
    for most in (1_000_000, 40):
        monkeypatch.setattr(shared, "LOCAL_EDGES", most)
        got = {r.node: r.root for r in shared.components(table).collect()}
        assert got.keys() == {i for two in links if two[0] != two[1] for i in two}
        assert all((got[a] == got[b]) == (want[a] == want[b]) for a in list(got)[:60] for b in got)
    assert shared.components(table.limit(0)).count() == 0


def test_rare_shingles_meet(spark):
    """Every pair of similar sets has a candidate, also with hot shingles and empty sets."""
    rng = np.random.default_rng(10)
    sets = {}
    for i in range(120):
        base = set(range(100 * (i % 8), 100 * (i % 8) + 40)) | set(range(5000, 5030))
        for x in rng.choice(sorted(base), 8, replace=False):
            base.discard(int(x))
        sets[i] = sorted(base | {int(x) for x in rng.integers(10_000, 99_999, 4)})
    sets[500], sets[501] = [], []
    table = spark.createDataFrame([(i, [x * 0x9E3779B97F4A7C15 % (1 << 64) - (1 << 63) for x in s]) for i, s in sets.items()], "node bigint, shingles array<bigint>")
    table = table.withColumn("shingles", F.array_sort("shingles"))
    buckets = {}
    for r in simhash.sharing(table, 80).collect():
        buckets.setdefault(r.node, set()).add(r.bucket)
    for i, x in sets.items():
        for j, y in sets.items():
            if i < j and 5 * len(set(x) & set(y)) >= 4 * len(set(x) | set(y)):
                assert buckets[i] & buckets[j]


def test_one_row_per_group_not_per_id(spark):
    rows = [(1, "alpha beta gamma"), (1, "quite another text here"), (None, "first without id"), (None, "second of them all"), (None, "first without id"), (2, "first  WITHOUT id")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted([tuple(r) for r in kept], key=str) == sorted([rows[0], rows[1], rows[3], rows[5]], key=str)


def test_sketches_rule_out_no_similar_pair(spark):
    """Pairs of all similarities and of sizes on both sides of a power of two; unlike ones are ruled out before a set moves."""
    rng = np.random.default_rng(12)
    sets = {0: [], 1: []}
    for i, n in enumerate([3, 60, 64, 70, 120, 130, 250, 260, 700], 1):
        base = rng.integers(-(1 << 62), 1 << 62, n)
        for k, changed in enumerate((0, n // 20, n // 9, n // 5, n)):
            sets[10 * i + k] = sorted({*base[changed:].tolist(), *rng.integers(-(1 << 62), 1 << 62, changed - changed // 4).tolist()})
    table = spark.createDataFrame(list(sets.items()), "node bigint, shingles array<bigint>").cache()
    pairs = spark.createDataFrame([(a, b) for a in sets for b in sets if a < b], "a bigint, b bigint").cache()
    drawn = simhash.sketches(table).cache()
    alike = lambda x, y: 5 * len({*x} & {*y}) >= 4 * len({*x} | {*y})
    want = {(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])}
    assert {tuple(r) for r in simhash.similar_pairs(pairs, table, drawn, 80).collect()} == want and len(want) > 20
    met = drawn.toDF("a", "n", "x").join(pairs, "a").join(drawn.toDF("b", "m", "y"), "b")
    left = {(r.a, r.b) for r in met.filter(simhash.sketches_allow(80)).select("a", "b").collect() if r.a >= 20 and r.b // 10 == r.a // 10}
    assert want >= {p for p in left if p[1] % 10 < 4 and p in want} and not any(p[1] % 10 == 4 for p in left)


def test_groups_are_joined_in_two_comparisons(spark, monkeypatch):
    """Two groups with many unlike candidates between them and one similar pair: no step per share of the candidates."""
    rng = np.random.default_rng(3)
    sets = {n: rng.integers(-(2**62), 2**62, 40) for n in range(48)}
    sets[47] = np.append(sets[0][:39], 5)
    table = spark.createDataFrame([(n, sorted(map(int, s))) for n, s in sets.items()], "node bigint, shingles array<bigint>").localCheckpoint()
    roots = spark.createDataFrame([(n, 24 * (n // 24)) for n in sets], "node bigint, root bigint").localCheckpoint()
    found = spark.createDataFrame([(a, b) for a in range(24) for b in range(24, 48)], "a bigint, b bigint").localCheckpoint()
    calls, own = [], simhash.similar_pairs
    monkeypatch.setattr(simhash, "similar_pairs", lambda *args: calls.append(1) or own(*args))
    joined = simhash.join_groups(found, roots, table, simhash.sketches(table).localCheckpoint(), 80).collect()
    assert len({r["root"] for r in joined}) == 1 and len(joined) == 48 and len(calls) <= 2


def test_unlike_texts_with_rare_shingles_in_common_name_no_candidates(spark, monkeypatch):
    """Sketches are compared where candidates meet: pairs of unlike texts are not handed on, however many share a passage; near copies are."""
    rng = np.random.default_rng(21)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 10**9, n)]
    passage = words(60)
    unlike = [" ".join([*words(70), *passage, *words(20)]) for _ in range(60)]
    base = words(200)
    # Near copies of sizes on both sides of a power of two, and sets whose sketches are cut to their brief form.
    near = [" ".join([*base, *words(10 * i)]) for i in range(5)]
    long = words(3000)
    texts = [*unlike, *near, " ".join(long), " ".join([*long, *words(500)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(simhash, "BRIEF_BITS", 1 << 11)
    handed, own = [], simhash.join_groups
    monkeypatch.setattr(simhash, "join_groups", lambda found, *args: handed.extend(map(tuple, found.collect())) or own(found, *args))
    found = {r["id"]: r["root"] for r in simhash.similar_groups(docs, radius=0).collect()}
    sets = [set(simhash.shingle_set(simhash.shingle_digests(t, 5, 42)).tolist()) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = brute.roots(len(sets), links)
    assert all((found[i] == found[j]) == (want[i] == want[j]) for i in found for j in found) and len(links) > 5
    assert len(handed) < 200 and len({n for pair in handed for n in pair}) <= len(near) + 2


def test_brief_sketches_rule_out_no_similar_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BRIEF_BITS", 256)
    rng = np.random.default_rng(22)
    sets = {0: []}
    for i, n in enumerate([3, 60, 64, 70, 130, 260, 700], 1):
        base = rng.integers(-(1 << 62), 1 << 62, n)
        for k, changed in enumerate((0, n // 20, n // 9, n // 5, n)):
            sets[10 * i + k] = sorted({*base[changed:].tolist(), *rng.integers(-(1 << 62), 1 << 62, changed - changed // 4).tolist()})
    table = spark.createDataFrame(list(sets.items()), "node bigint, shingles array<bigint>")
    drawn = simhash.briefs(simhash.sketches(table)).toPandas()
    assert drawn["brief"].str.len().max() == 32
    node = np.array([*sets, *sets])
    size = np.array([len(sets[n]) for n in node])
    allowed = simhash.brief_test(drawn["node"].to_numpy(), drawn["brief"], node, size, 80)
    a, b = (x.ravel() for x in np.indices((len(node), len(node))))
    out = allowed(a, b)
    alike = np.array([5 * len({*sets[x]} & {*sets[y]}) >= 4 * len({*sets[x]} | {*sets[y]}) for x, y in zip(node[a], node[b])])
    assert out[alike].all() and alike.sum() > 60 and out.sum() < 0.5 * len(out)
