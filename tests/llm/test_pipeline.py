import math
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from codeloom.llm import kneser_ney as K

from .helpers import edge_docs, no_docs


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        if name != "mixing":
            assert 0 < docs.count() <= before
            before = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == docs.count() and out.filter("n_tokens > 0").count() > 0


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.agg(F.count("*")).first()[0] > 50


def test_stages_on_edge_cases(spark):
    """Nulls, empty and long texts, repeated rows, clashing columns and empty tables, for each stage."""
    sf, stages = "/root/testdata/sf0.001", dict(corpus_pipeline.STAGES)
    ids = {name: sorted((r.doc_id for r in stages[name](spark, edge_docs(spark), sf).select("doc_id").collect()), key=repr) for name in ("quality", "exact_dedup", "near_dedup")}
    # white space alone is text like any other to the classifier; null and empty texts go
    assert not {2, 3} & set(ids["quality"]) and ids["exact_dedup"] == ids_of(1, 4, 6, None) and ids["near_dedup"] == ids_of(1, 2, 3, 4, 6, None)
    mixed = stages["mixing"](spark, edge_docs(spark), sf)
    assert mixed.columns == edge_docs(spark).columns and not {2, 3, 6} & {r.doc_id for r in mixed.collect()}
    assert stages["tokens"](spark, edge_docs(spark), sf).count() == 8
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs(spark), sf).collect() == []


def ids_of(*ids):
    return sorted(ids, key=repr)


def brute_quality(docs, labels, held):
    """Kept ids by a model computed with dictionaries."""
    trusted = {}
    for r in labels:
        ok = r.quality == 1 and not r.toxic
        trusted[r.doc_id] = trusted.get(r.doc_id, True) and ok
    kept, bits = set(), K.ORDER
    for lang in {r.lang for r in docs}:
        mine = [r for r in docs if r.lang == lang]
        grams = lambda t: [int.from_bytes(raw[i : i + bits], "big") for raw in [b"\0" * (bits - 1) + t.encode()] for i in range(len(raw) - bits + 1)]
        level = Counter(g for r in mine if trusted.get(r.doc_id) and not held[r.doc_id] for g in grams(r.text))
        levels = {}
        for o in range(bits, 0, -1):
            n = [sum(v == k for v in level.values()) for k in range(1, 5)]
            y = n[0] / (n[0] + 2 * n[1]) if n[0] else None
            cut = [min(max(k - (k + 1) * y * n[k] / n[k - 1] if y is not None and n[k - 1] else k - 0.5, 0.05), k - 0.05) for k in (1, 2, 3)]
            sums = {}
            for g, v in level.items():
                total, off = sums.get(g >> 8, (0, 0.0))
                sums[g >> 8] = (total + v, off + cut[min(v, 3) - 1])
            levels[o] = (level, cut, sums)
            level = Counter(g & (256 ** (o - 1) - 1) for g in level)
        memory = {}

        def p(g, o):
            if not o:
                return 1 / 256
            g &= 256**o - 1
            if (g, o) not in memory:
                counts, cut, sums = levels[o]
                total, off = sums.get(g >> 8, (0, 0.0))
                v = counts.get(g, 0)
                memory[g, o] = (max(v - cut[min(v, 3) - 1], 0) if v else 0) / total + off / total * p(g, o - 1) if total else p(g, o - 1)
            return memory[g, o]

        steps = {}
        for r in mine:
            all_ = grams(r.text or "")
            steps[r.doc_id] = -sum(math.log(p(g, bits)) for g in all_) / len(all_) / K.STEP if all_ else None
        sure = [i for i in steps if trusted.get(i) and steps[i] is not None]
        own = [i for i in sure if held[i]]
        used = sorted(math.floor(steps[i]) for i in own)
        limit = used[math.ceil(K.QUANTILE * len(used) - 1e-9) - 1] + round(K.SLACK / K.STEP) if used else math.inf
        kept |= {i for i, s in steps.items() if s is not None and math.floor(s) <= limit}
    return kept


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = docs.collect()
    held = {r.doc_id: r.h for r in docs.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(K.HELD_OUT)) == 0).alias("h")).collect()}
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, sf).cache()
    assert {r.doc_id for r in good.collect()} == brute_quality(rows, labels.collect(), held)
    unique = stages["exact_dedup"](spark, good, sf).cache()
    best = {}
    for r in good.collect():
        key = "".join(c for c in r.text if c not in " \t\n\x0b\x0c\r")
        best[key] = min(best.get(key, (0, 1 << 62)), (-len(r.text), r.doc_id))
    assert {r.doc_id for r in unique.collect()} == {d for _, d in best.values()}
    near = {r.doc_id for r in stages["near_dedup"](spark, unique, sf).collect()}
    sets = {r.doc_id: {tuple(w[i : i + 5]) for w in [r.text.split()] for i in range(max(1, len(w) - 4))} if r.text.split() else set() for r in unique.collect()}
    first = {}
    for d in sorted(sets):
        twin = next((e for e in first if sets[d] & sets[e] and len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e])), None)
        if twin is None:
            first[d] = True
    assert near == set(first)
