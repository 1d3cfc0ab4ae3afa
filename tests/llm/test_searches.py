import itertools
import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom.llm import kneser_ney, line_dedup, simhash, topk, words

from .helpers import edge_docs, no_docs, table


def brute_topk(rows, k=10, step=100):
    ok = [(n, i, [math.floor(1024 * float(x)) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in ok:
        if i is not None and i % step == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j is None, j or 0) for m, j, v in ok if m != n and len(v) == len(q))[:k]
            out += [(i, r, None if null else j, -s) for r, (s, null, j) in enumerate(found, 1)]
    return sorted(map(repr, out))


def got_topk(df, **how):
    return sorted(repr((r.query_id, r["rank"], r.vec_id, r.score)) for r in topk.top_k(df, **how).collect())


def test_topk_with_many_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 60)
    monkeypatch.setattr(topk, "LEAF", 8)
    monkeypatch.setattr(topk, "BLOCK", 3)
    df = table(spark, "embeddings")
    assert got_topk(df, step=50) == brute_topk([(r.vec_id, r.embedding) for r in df.collect()], step=50)


def test_topk_copies_and_edges(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 50)
    monkeypatch.setattr(topk, "LEAF", 4)
    rnd = random.Random(3)
    rows = [(n, [0.5, -0.25, 1.0] if n % 3 else [rnd.uniform(-1, 1) for _ in range(3)]) for n in range(300)]
    rows += [(400, None), (500, [1.0, None, 0.0]), (600, [1.0, float("nan"), 0.0]), (700, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (100, [2.0, 2.0, 2.0]), (800, [1.0, 2.0]), (801, [1.0, 3.0]), (900, []), (-100, [0.0, 0.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    assert got_topk(df) == brute_topk([(r.vec_id, r.embedding) for r in df.collect()])
    assert got_topk(df.limit(0)) == []


def shingle_set(text, size=5):
    w = (text or "").split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def near_texts(rnd, base, edits):
    out = list(base)
    for i in rnd.sample(range(len(base)), edits):
        out[i] = f"x{rnd.randrange(10**6)}"
    return " ".join(out)


def test_shingles_are_those_of_words():
    rnd = random.Random(1)
    texts = [" ".join(f"w{rnd.randrange(9)}" for _ in range(rnd.randrange(40))) for _ in range(60)] + [None, "", " \n", "ü é\tü  é ü é", "a b c"]
    got = words.shingles(texts)
    assert [len(s) for s in got] == [len(shingle_set(t)) for t in texts]
    for a, b in itertools.combinations(range(20), 2):
        assert len(np.intersect1d(got[a], got[b])) == len(shingle_set(texts[a]) & shingle_set(texts[b]))


def test_simhash_finds_links_of_the_similarity(spark):
    rnd = random.Random(5)
    docs, n = [], 0
    for _ in range(40):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randrange(60, 400))]
        for edits in (0, 0, 1, 2, 3, len(base) // 40):
            docs.append((n, near_texts(rnd, base, edits)))
            n += 1
    docs += [(n + k, " ".join(f"q{rnd.randrange(10**6)}" for _ in range(100))) for k in range(100)]
    sets = {i: shingle_set(t) for i, t in docs}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] & sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    rows = simhash.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    of = {r.doc_id: r.class_id for r in rows}
    assert len(links) > 300
    assert sum(of[a] == of[b] for a, b in links) >= 0.99 * len(links)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    assert all(find(i) == find(c) for i, c in of.items())  # nothing is joined that no links join
    assert sum(r.kept for r in rows) == len(set(of.values()))


def test_simhash_deals_out_a_large_cluster(spark):
    rnd = random.Random(8)
    base = [f"w{n}" for n in range(500)]
    docs = [(n, near_texts(rnd, base, 2)) for n in range(400)] + [(1000 + n, " ".join(f"q{rnd.randrange(10**6)}" for _ in range(80))) for n in range(60)]
    rows = simhash.classes(spark.createDataFrame(docs, "doc_id long, text string"), longest=50).collect()
    assert len({r.class_id for r in rows if r.doc_id < 1000}) == 1 and len({r.class_id for r in rows}) == 61


def test_simhash_edges(spark):
    rows = simhash.classes(edge_docs(spark)).collect()
    assert len(rows) == 8
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].class_id == by[5][0].class_id == 1 and by[1][0].class_size == 3 and by[1][0].kept and not any(r.kept for r in by[5])
    assert by[2][0].class_size == by[3][0].class_size == by[6][0].class_size == 1
    kept = simhash.kept(edge_docs(spark))
    assert kept.count() == 6 and kept.columns == edge_docs(spark).columns
    assert simhash.classes(no_docs(spark)).collect() == []


def brute_lines(docs):
    rows = [(d, k, frozenset(line.split())) for d, t in sorted(docs) for k, line in enumerate((t or "").split("\n")) if line.split()]
    gone = {d: [] for d, _ in docs}
    seen = []
    for d, k, s in rows:
        if any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in seen):
            gone[d].append(k)
        seen.append(s)
    return gone


def test_line_dedup_against_brute_force(spark):
    rnd = random.Random(2)
    lines = [" ".join(f"w{min(int(rnd.expovariate(0.1)), 60)}" for _ in range(rnd.randrange(1, 14))) for _ in range(160)]
    docs = [(n, "\n".join(near_texts(rnd, x.split(), rnd.choice([0, 0, 1])) if x.split() else x for x in rnd.sample(lines, rnd.randrange(1, 8)))) for n in range(80)]
    docs += [(200, "a b c d"), (201, "a b c d e"), (202, "d c b a"), (203, "\n\na b c d x y\n")]
    got = {r.doc_id: list(r.removed_lines) for r in line_dedup.removals(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_lines(docs)


def test_line_dedup_edges(spark):
    rows = line_dedup.removals(edge_docs(spark)).collect()
    assert len(rows) == 8
    fives = sorted((r.copy, list(r.removed_lines)) for r in rows if r.doc_id == 5)
    assert fives == [(1, [0]), (2, [0])]
    assert {r.doc_id: r.n_lines for r in rows if r.doc_id in (2, 3, 6)} == {2: 0, 3: 0, 6: 0}
    out = line_dedup.without(edge_docs(spark))
    assert out.columns == edge_docs(spark).columns and {r.doc_id: r.text for r in out.collect()}[5] == ""
    assert line_dedup.removals(no_docs(spark)).collect() == []


def test_kneser_ney_probabilities(spark):
    """Probabilities of all bytes after a context sum to one, and agree with a direct computation."""
    texts = ["abab abba", "the theme", "abab"]
    counts = {}
    for t in texts:
        raw = b"\0" * 4 + t.encode()
        for i in range(4, len(raw)):
            g = int.from_bytes(raw[i - 4 : i + 1], "big")
            counts[g] = counts.get(g, 0) + 1
    context = int.from_bytes(b" the"[-4:], "big") << 8
    asked = [(0, "en", 0, sorted(counts), [counts[g] for g in sorted(counts)]), (1, "en", 0, [context | b for b in range(256)], [0] * 256)]
    told = kneser_ney.answers(spark.createDataFrame(asked, "block long, lang string, shard long, grams array<long>, counts array<long>"), 1).collect()
    row = {b: math.exp(logp) for r in told if r.block == 1 for b, logp in enumerate(r.logps)}
    assert sum(row.values()) == pytest.approx(1, rel=1e-5)
    levels, level = {}, dict(counts)
    for o in range(5, 0, -1):
        levels[o] = level
        below = {}
        for g in level:
            below[g & (256 ** (o - 1) - 1)] = below.get(g & (256 ** (o - 1) - 1), 0) + 1
        level = below

    def p(gram, o):
        if o == 0:
            return 1 / 256
        c, n = levels[o], [sum(v == k for v in levels[o].values()) for k in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else None
        cut = [min(max(k - (k + 1) * y * n[k] / n[k - 1] if y is not None and n[k - 1] else k - 0.5, 0.05), k - 0.05) for k in (1, 2, 3)]
        g = gram & (256**o - 1)
        same = [v for x, v in c.items() if x >> 8 == g >> 8]
        if not same:
            return p(gram, o - 1)
        lower = sum(cut[min(v, 3) - 1] for v in same) / sum(same)
        return max(c.get(g, 0) - (cut[min(c[g], 3) - 1] if g in c else 0), 0) / sum(same) + lower * p(gram, o - 1)

    for b in (ord("m"), ord("a"), ord("z"), 200):
        assert row[b] == pytest.approx(p(context | b, 5), rel=1e-5)


def test_quality_classifier_on_labelled_documents(spark):
    docs, labels = table(spark, "documents", "sf0.01"), table(spark, "labels", "sf0.01")
    rows = kneser_ney.classify(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    share = {r.quality: r.kept for r in rows}
    assert share[1] >= 0.98 and share[0] <= 0.4


def test_quality_classifier_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None), (4, 0, 0), (None, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    rows = kneser_ney.classify(edge_docs(spark), labels).collect()
    assert len(rows) == 8
    by = {r.doc_id: r for r in rows}
    assert not by[2].kept and not by[3].kept and by[3].perplexity is None
    assert by[5].kept and by[5].threshold is None  # no trusted text in its language
    assert by[1].kept and by[1].perplexity > 1 and by[None].perplexity > 1
    kept = kneser_ney.kept(edge_docs(spark), labels)
    assert kept.columns == edge_docs(spark).columns
    assert kneser_ney.classify(no_docs(spark), labels.limit(0)).collect() == []


def star(copies, rng):
    """An original and copies that reach the similarity with it and not with one another; and the Jaccard similarities that hold."""
    base = [f"w{n}" for n in rng.integers(0, 10**9, 204)]
    docs = [(0, " ".join(base))]
    for n in range(1, copies + 1):
        own = list(base)
        for at in rng.choice(np.arange(6, 198, 6), 4, replace=False) + rng.integers(0, 2):
            own[at] = f"c{n}at{at}"
        docs.append((n, " ".join(own)))
    sets = [{tuple(w[i : i + 5]) for w in [t.split()] for i in range(len(w) - 4)} for _, t in docs]
    alike = lambda a, b: len(a & b) / len(a | b)
    assert all(alike(sets[0], s) >= 0.8 for s in sets) and np.mean([alike(sets[1], s) >= 0.8 for s in sets[2:]]) < 0.05
    return docs


def test_simhash_finds_the_links_of_stars(spark):
    docs = [(1001 * k + i, t) for k in range(3) for i, t in star(1000, np.random.default_rng(3 + k))]
    rows = simhash.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    # by family, as whether an original meets its copies at all depends on the few lists it is in
    found = [np.mean([r.class_id == 1001 * k for r in rows if r.doc_id // 1001 == k]) for k in range(3)]
    assert np.mean(found) >= 0.95, found


def test_simhash_compares_all_chunks_of_a_long_list(spark):
    rng = np.random.default_rng(6)
    f = rng.integers(-(2**62), 2**62, size=4)
    # equal fingerprints in one list of 90 nodes, 50 of them with one label already
    rows = [(7, n, 0 if n < 50 else n, *map(int, f)) for n in range(90)] + [(8, n, n, *map(int, f)) for n in range(5)]
    lists = spark.createDataFrame(rows, "list long, node long, label long, f0 long, f1 long, f2 long, f3 long")
    got = {(r.a, r.b) for r in simhash._compared(simhash._dealt(lists, 20, False), 55, None).collect()}
    assert got == {(a, b) for a in range(90) for b in range(max(a + 1, 50), 90)} | {(a, b) for a in range(5) for b in range(a + 1, 5)}
    first = simhash._compared(simhash._dealt(lists, 20, True), 55, 2).collect()
    assert {n for n in range(90)} == {r.a for r in first if r.a == r.b}


def test_line_dedup_of_short_lines_with_few_words(spark):
    """Lines of few words, so that every prefix word is in many lines, and repeated rows without an id."""
    rnd = random.Random(4)
    lines = sorted({" ".join(sorted(rnd.sample("abcdefghij", rnd.randrange(4, 9)))) for _ in range(400)})
    docs = [(n, "\n".join(lines[k : k + 3])) for n, k in enumerate(range(0, len(lines), 3))]
    got = line_dedup.removals(spark.createDataFrame([*docs, (None, lines[0]), (None, lines[0])], "doc_id long, text string")).collect()
    assert {r.doc_id: list(r.removed_lines) for r in got if r.doc_id is not None} == brute_lines(docs)
    sets = {line: set(line.split()) for line in lines}
    linked = {x: sum(y != x and 9 * len(sets[x] & sets[y]) >= 4 * (len(sets[x]) + len(sets[y])) for y in lines) for x in lines}
    assert {r.doc_id: r.n_links for r in got if r.doc_id is not None} == {d: sum(linked[x] for x in t.split("\n")) for d, t in docs}
    assert sorted((r.copy, list(r.removed_lines), r.n_links) for r in got if r.doc_id is None) == [(1, [0], linked[lines[0]]), (2, [0], linked[lines[0]])]


def test_line_dedup_verifies_in_little_memory():
    """Pairs are compared in slices, so what is computed beside a bucket's sets doesn't grow with the bucket; slices give what whole sets give."""
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 2**62, (400, 100))
    sets = [np.where(rnd.random(100) < 0.1 * (k % 3), rnd.integers(0, 2**62, 100), base[k % 400])[: 100 - k % 7] for k in range(8000)]
    lists = pa.array([*sets, base.reshape(-1), base.reshape(-1)[:33_000]], pa.list_(pa.int64()))
    a = rnd.integers(0, 8000, 30_000)
    pairs = np.stack([np.append(a, 8000), np.append((a + 400 * rnd.integers(1, 20, 30_000)) % 8000, 8001)])
    tracemalloc.start()
    got = line_dedup._reaching(*pairs, lists)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = [set(x.tolist()) for x in [*sets, base.reshape(-1), base.reshape(-1)[:33_000]]]
    want = [9 * len(whole[x] & whole[y]) >= 4 * (len(whole[x]) + len(whole[y])) for x, y in pairs.T.tolist()]
    assert got.tolist() == want and 0 < sum(want) < len(want) and want[-1]
    assert peak < 32 << 20


def test_line_dedup_sends_prefix_words_once(spark):
    """Both sides of the prefix join read one exchange; the members of sets go to their buckets without another."""
    nodes = spark.createDataFrame([(n, 9, 0, [(7 << 32) | i for i in range(2)]) for n in range(50)], "node long, n int, parities long, prefix array<long>")
    found = line_dedup.candidates(nodes)
    assert found.count() == 50 * 49 // 2
    found.collect()
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()
