"""Quality classifier: an interpolated modified Kneser-Ney model of byte n-grams.

The model is trained on trusted text (labels: quality 1, not toxic), one model for
each language, on all of it but a fifth that is held out. Counts are gathered in
blocks of documents, combined there and summed over shards of n-grams. Every
distinct n-gram of the whole corpus is resolved to its probability by joins with the
sharded counts, the answers go back to the blocks that asked for them, and each
document gets its perplexity in bytes. A language's threshold is a quantile of the
perplexities of its held-out trusted documents, at every size of the input; a document
above it is rejected.

What is counted and joined are distinct n-grams of blocks, so copies and frequent
n-grams weigh no more than rare ones, and texts cross the network once for counting
and once for scoring, in blocks of bounded bytes.

Null or empty texts have no perplexity and are rejected. A null language is a
language of its own. A language without held-out trusted text has no threshold and
its documents are kept. Documents without a label are scored like others; repeated
labels are trusted if all of them are. Null ids have no label. Repeated rows are
scored each. Very long texts are scored whole. Empty tables give empty tables. Where
a column of the input has the name of a result, the result replaces it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import dropped, free_name, written

ORDER = 5
#: Text bytes of a block, about.
BLOCK_BYTES = 12_000_000
QUANTILE = 0.998
#: What a threshold lies above its quantile, of the logarithm of perplexity.
SLACK = 0.1
HELD_OUT = 5
#: Rows of discounts or of single bytes that may be broadcast; beyond that they are joined like the rest.
FEW = 10_000
#: Perplexities are compared in steps of this much of their natural logarithm.
STEP = 0.001
_PIECE = 1 << 20
_NO_LANG = "\x00none"


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends in each byte of the texts, packed in a number, and the bytes of each text. Before a text stand ORDER - 1 zero bytes."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    pad = b"\0" * (ORDER - 1)
    x = np.frombuffer(pad + pad.join(raw), dtype=np.uint8)
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    out = x[: len(x) - ORDER + 1].astype(np.int64)
    for k in range(1, ORDER):
        out <<= 8
        out |= x[k : len(x) - ORDER + 1 + k]
    ends = np.cumsum(sizes + ORDER - 1) - (ORDER - 1)  # after text t come ORDER - 1 places that end in padding
    inside = np.ones(len(out), dtype=bool)
    for k in range(ORDER - 1):
        inside[(ends + k)[:-1]] = False
    return out[inside], sizes


def _pieces(texts: list, size: int = _PIECE):
    """Runs of texts of about so many characters."""
    start, total = 0, 0
    for n, t in enumerate(texts):
        total += len(t or "")
        if total >= size:
            yield start, n + 1
            start, total = n + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _counted(texts: list[str | None]) -> pd.Series:
    """Count of each distinct n-gram."""
    found: list[pd.Series] = []
    for a, z in _pieces(texts):
        grams, _ = _grams(texts[a:z])
        codes, distinct = pd.factorize(grams)
        found.append(pd.Series(np.bincount(codes, minlength=len(distinct)), index=distinct))
        if len(found) > 8:
            found = [pd.concat(found).groupby(level=0).sum()]
    return pd.concat(found).groupby(level=0).sum() if found else pd.Series(dtype=np.int64)


def _by_shard(grams: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of n-grams by shard and then by number, where each shard's end (from 0), and the shards that have any."""
    shard = grams % shards
    order = np.lexsort((grams, shard))
    some, n = np.unique(shard, return_counts=True)
    return order, np.concatenate([[0], np.cumsum(n)]), some.astype(np.int64)


def _block(blocks: int) -> Column:
    """The block of a document: from its id, so that its label finds it; without an id, from its text."""
    return F.pmod(F.when(F.col("id").isNotNull(), F.xxhash64("id")).otherwise(F.xxhash64("text")), F.lit(blocks))


def _shards(blocks: int) -> int:
    """Into how many shards n-grams fall: as many as blocks, so that a shard's requests stay bounded; odd, so that all bits of an n-gram count."""
    return max(15, blocks) | 1


def asked_and_counted(docs: DataFrame, trusted: DataFrame, blocks: int) -> DataFrame:
    """(block, lang, shard, grams, counts): the distinct n-grams of each block by shard, in order, and how often its training text has each."""
    shards = _shards(blocks)

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        known = set(right.column("label_id").to_pylist())
        ids, langs, texts, train = (left.column(c).to_pylist() for c in ("id", "lang", "text", "train"))
        parts: dict[tuple[str, bool], list[str]] = {}
        for i, lang, text, in_fold in zip(ids, langs, texts, train, strict=True):
            parts.setdefault((lang, in_fold and i in known), []).append(text)
        block, out = left.column("block")[0].as_py() if left.num_rows else 0, []
        for lang in dict.fromkeys(lang for lang, _ in parts):
            yes, no = _counted(parts.get((lang, True), [])), _counted(parts.get((lang, False), []))
            n = yes.reindex(yes.index.union(no.index), fill_value=0)
            grams, counts = n.index.to_numpy(dtype=np.int64), n.to_numpy(dtype=np.int64)
            order, ends, some = _by_shard(grams, shards)
            at = pa.array(ends.astype(np.int32))
            out.append(pa.table({
                "block": np.full(len(some), block), "lang": pa.array([lang] * len(some), pa.string()), "shard": some,
                "grams": pa.ListArray.from_arrays(at, pa.array(grams[order])), "counts": pa.ListArray.from_arrays(at, pa.array(counts[order])),
            }))
        kinds = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("shard", pa.int64()), ("grams", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
        return pa.concat_tables([t.cast(kinds) for t in out]) if out else kinds.empty_table()

    labels = trusted.select(F.col("doc_id").alias("label_id"))
    left = docs.select("id", "lang", "text", "train", _block(blocks).alias("block"))
    return left.groupBy("block").cogroup(labels.select("label_id", F.pmod(F.xxhash64("label_id"), F.lit(blocks)).alias("block")).groupBy("block")).applyInArrow(count, "block long, lang string, shard long, grams array<long>, counts array<long>")


def _tail(gram: str, n: int) -> Column:
    return F.col(gram).bitwiseAND(F.lit(256**n - 1))


def model(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (lang, gram, n) of the highest order, by orders: what n-grams get after discounting, and each context's weight of the order below.

    Below the highest order an n-gram counts as often as different bytes precede it.
    """
    level, levels = counts.filter("n > 0").groupBy("lang", "gram").agg(F.sum("n").alias("c")), []
    for order in range(ORDER, 0, -1):
        levels.append(level.select("lang", F.lit(order).alias("o"), "gram", "c"))
        level = level.groupBy("lang", _tail("gram", order - 1).alias("gram")).agg(F.count("*").alias("c"))
    grams = levels[0]
    for other in levels[1:]:
        grams = grams.unionByName(other)
    grams = written(grams)
    n = [F.count_if(F.col("c") == k).cast("double") for k in range(1, 5)]
    found = grams.groupBy("lang", "o").agg(*[x.alias(f"n{k}") for k, x in enumerate(n, 1)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    cut = lambda k: F.least(F.greatest(F.coalesce(F.try_subtract(F.lit(float(k)), (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))), F.lit(k - 0.5)), F.lit(0.05)), F.lit(k - 0.05))
    y_safe = found.withColumn("has", F.col("n1") > 0)
    cuts = y_safe.select("lang", "o", *[F.when(F.col("has"), cut(k)).otherwise(F.lit(k - 0.5)).alias(f"d{k}") for k in (1, 2, 3)])
    discount = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    cutted = grams.join(_few(cuts), ["lang", "o"]).withColumn("d", discount).withColumn("context", F.shiftright("gram", 8))
    contexts = cutted.groupBy("lang", "o", "context").agg(F.sum("c").alias("total"), F.sum("d").alias("cut"))
    mass = cutted.select("lang", "o", "gram", (F.col("c") - F.col("d")).alias("mass"))
    return mass, contexts.select("lang", "o", "context", "total", (F.col("cut") / F.col("total")).alias("lower"))


def _few(df: DataFrame) -> DataFrame:
    """df, a row for each of a few things of a language: sent to all tasks if there are few rows, which is checked."""
    out = written(df)
    return F.broadcast(out) if out.count() <= FEW else out


def probabilities(asked: DataFrame) -> DataFrame:
    """(lang, gram, logp) of every distinct n-gram that was asked for."""
    counted = asked.select("lang", F.explode(F.arrays_zip("grams", "counts")).alias("x")).select("lang", F.col("x.grams").alias("gram"), F.col("x.counts").alias("n"))
    mass, contexts = model(counted)
    distinct = asked.select("lang", F.explode("grams").alias("gram")).distinct()
    bytes_ = contexts.filter("o = 1").select("lang", "total", "lower", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(255).cast("long"))).alias("w"))
    single = bytes_.join(mass.filter("o = 1").select("lang", F.col("gram").alias("w"), "mass"), ["lang", "w"], "left")
    first = _few(single.select("lang", "w", (F.coalesce(F.col("mass") / F.col("total"), F.lit(0.0)) + F.col("lower") / 256).alias("p1")))
    orders = F.array(*[F.struct(F.lit(o).alias("o"), _tail("gram", o).alias("g")) for o in range(2, ORDER + 1)])
    each = distinct.select("lang", F.col("gram").alias("whole"), F.explode(orders).alias("x")).select("lang", "whole", "x.o", F.col("x.g").alias("gram"), F.shiftright("x.g", 8).alias("context"))
    looked = each.join(contexts, ["lang", "o", "context"], "left").join(mass, ["lang", "o", "gram"], "left")
    step = F.struct("o", F.coalesce(F.col("mass") / F.col("total"), F.lit(0.0)).alias("a"), F.coalesce("lower", F.lit(1.0)).alias("b"))
    steps = looked.groupBy("lang", "whole").agg(F.array_sort(F.collect_list(step)).alias("steps")).withColumn("w", F.col("whole").bitwiseAND(F.lit(255)))
    p = F.aggregate("steps", F.coalesce("p1", F.lit(1 / 256)), lambda below, s: s["a"] + s["b"] * below)
    return steps.join(first, ["lang", "w"], "left").select("lang", F.col("whole").alias("gram"), F.ln(p).alias("logp"))


def answers(asked: DataFrame, shards: int) -> DataFrame:
    """(block, lang, shard, logps): the probabilities of the n-grams that a block asked a shard for, in the n-grams' order."""
    logs = written(probabilities(asked)).withColumn("shard", F.col("gram") % shards)

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        index, logp = pd.Index(right.column("gram").to_numpy()), right.column("logp").to_numpy()
        grams = left.column("grams").combine_chunks()
        flat = grams.flatten().to_numpy()
        out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(grams.value_lengths().to_numpy())]).astype(np.int32)), pa.array(logp[index.get_indexer(flat)].astype(np.float32)))
        return pa.table({"block": left.column("block"), "lang": left.column("lang"), "shard": left.column("shard"), "logps": out})

    left = asked.select("block", "lang", "shard", "grams").groupBy("lang", "shard")
    return left.cogroup(logs.groupBy("lang", "shard")).applyInArrow(tell, "block long, lang string, shard long, logps array<float>")


def scored(docs: DataFrame, told: DataFrame, blocks: int) -> DataFrame:
    """(id, key, lang, bytes, logp) of every document."""
    shards = _shards(blocks)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        langs, texts = np.array(left.column("lang").to_pylist(), dtype=object), left.column("text").to_pylist()
        sizes, sums = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
        told_of: dict[str, list] = {}
        for of, shard, logps in zip(right.column("lang").to_pylist(), right.column("shard").to_pylist(), right.column("logps"), strict=True):
            told_of.setdefault(of, []).append((shard, logps.values.to_numpy()))
        for lang in dict.fromkeys(langs):
            rows = np.flatnonzero(langs == lang)
            own = [texts[r] for r in rows]
            spans = list(_pieces(own))
            asked = np.unique(np.concatenate([pd.unique(_grams(own[a:z])[0]) for a, z in spans]))
            got = [x for _, x in sorted(told_of.get(lang, []), key=lambda x: x[0])]
            order, logp = _by_shard(asked, shards)[0], np.empty(len(asked))
            if sum(map(len, got)) != len(asked):
                raise ValueError(f"block asked for {len(asked)} n-grams and got {sum(map(len, got))}")
            logp[order] = np.concatenate(got) if got else 0.0
            index = pd.Index(asked)
            for a, z in spans:
                found, n = _grams(own[a:z])
                total = np.concatenate([[0.0], np.cumsum(logp[index.get_indexer(found)])])
                ends = np.cumsum(n)
                sizes[rows[a:z]], sums[rows[a:z]] = n, total[ends] - total[ends - n]
        return pa.table({"id": left.column("id"), "key": left.column("key"), "lang": left.column("lang"), "bytes": sizes, "logp": sums})

    kind = docs.schema["id"].dataType.simpleString()
    left = docs.select("id", "key", "lang", "text", _block(blocks).alias("block"))
    return left.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, f"id {kind}, key long, lang string, bytes long, logp double")


def _thresholds(marked: DataFrame) -> DataFrame:
    """(lang, limit): the step of log perplexity below which QUANTILE of a language's held-out trusted documents lie, and SLACK. A language has one row for each step, however many documents."""
    held = Window.partitionBy("lang")
    used = marked.filter("trusted AND held AND steps IS NOT NULL").groupBy("lang", "steps").agg(F.count("*").alias("n"))
    share = F.sum("n").over(held.orderBy("steps")) / F.sum("n").over(held)
    return used.withColumn("share", share).filter(F.col("share") >= QUANTILE).groupBy("lang").agg((F.min("steps") + round(SLACK / STEP)).alias("limit"))


def row_key(id_col: str, lang: str, text: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(lang), F.col(text))


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, row_key, lang, n_bytes, perplexity, threshold (null: none), kept, for every row."""
    fold = F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(HELD_OUT)) == 0
    docs = df.select(F.col(id_col).alias("id"), row_key(id_col, lang, text).alias("key"), F.coalesce(F.col(lang), F.lit(_NO_LANG)).alias("lang"), F.col(text).alias("text"), (~fold).alias("train"))
    trusted = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).filter("q = 1 AND coalesce(t, 0) = 0 AND doc_id IS NOT NULL").select("doc_id")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_BYTES))
    asked = written(asked_and_counted(docs, trusted, blocks))
    told = written(answers(asked, _shards(blocks)))
    dropped(asked)
    scores = written(scored(docs, told, blocks))
    dropped(told)
    log_ppl = F.when(F.col("bytes") > 0, -F.col("logp") / F.col("bytes"))
    marked = scores.join(trusted.withColumn("trusted", F.lit(True)), F.col("id") == F.col("doc_id"), "left").select(
        "id", "key", "lang", "bytes", log_ppl.alias("log_ppl"), F.floor(log_ppl / STEP).alias("steps"), F.coalesce("trusted", F.lit(False)).alias("trusted"), (F.pmod(F.xxhash64(F.col("id"), F.lit(7)), F.lit(HELD_OUT)) == 0).alias("held")
    )
    judged = marked.join(_thresholds(marked), "lang", "left")
    return judged.select(
        F.col("id").alias("doc_id"), F.col("key").alias("row_key"), F.when(F.col("lang") != _NO_LANG, F.col("lang")).alias("lang"), F.col("bytes").alias("n_bytes"), F.exp("log_ppl").alias("perplexity"),
        F.exp(F.col("limit") * STEP).alias("threshold"), ((F.col("bytes") > 0) & (F.col("limit").isNull() | (F.col("steps") <= F.col("limit")))).alias("kept"),
    )


def kept(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of df that the classifier keeps, with their columns."""
    key = free_name(df, "quality_key")
    rejected = written(classify(df, labels, id_col, text, lang).filter("NOT kept").select(F.col("row_key").alias(key)).distinct())
    return df.withColumn(key, row_key(id_col, lang, text)).join(rejected.hint("shuffle_hash"), key, "left_anti").select(*df.columns)
