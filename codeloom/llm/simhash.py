"""Near-duplicate detection: SimHash fingerprints, found by the May-Ozerov recursion.

A text's shingles are its runs of five words; two texts are near duplicates when the
Jaccard similarity of their shingle sets is 0.8 or more. Fingerprints have 256 bits.

Each repetition draws random strips of 32 coordinates and for each strip random
centres. A fingerprint passes a centre when its bits of the strip, XORed with the
centre, have a weight of TAU at most; those that pass the same centre form a list,
in which the next strip filters again. Lists small enough are compared by brute
force. The number of levels follows from the number of fingerprints, the number of
repetitions from the target recall for a pair at the similarity bound. Close pairs
are then verified by their exact Jaccard similarity, and classes are the connected
components of the verified links.

Texts with the same shingle set are one node throughout, so copies cost nothing. In
a list, a node with up to PAIRS close partners gives all of them, another one its
nearest. After their exact check, components get a label, and nodes that had more
partners are compared again, only with those of another label, with ever more of the
nearest and in the last pass with all. So every close pair of a list is either checked
or lies within a component of checked links. A list of more than LIST nodes is dealt
into chunks, by itself in the first pass; later passes compare each chunk with each.

Null and empty texts have no shingles; each such document is a class of its own.
Texts of under five words have one shingle of all their words. Repeated rows belong
to one class. Of a class the document with the smallest id stays (null ids last);
of repeated rows, one. Very long texts are taken whole. Empty tables give empty tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm import words
from codeloom.llm.common import free_name, written
from codeloom.llm.components import components

SIMILAR = 0.8
BITS, STRIP, CENTRES, TAU = 256, 32, 64, 10
#: Close: what a pair at the bound differs in at most, but for three standard deviations.
RECALL = 0.97
#: Rows that lists should have on average; rows of a list at most; partners of a node up to which it gives all of them.
WANTED, LIST, PAIRS = 256, 2048, 8
#: How many of its nearest partners a node gives at least, by pass; None: all.
NEAREST = (2, 16, 128, None)
SEED = 11


def _angle(similar: float) -> float:
    """The share of bits in which two sets of this Jaccard similarity differ on average."""
    return math.acos(2 * similar / (1 + similar)) / math.pi


def close_bits(similar: float = SIMILAR) -> int:
    p = _angle(similar)
    return math.floor(BITS * p + 3 * math.sqrt(BITS * p * (1 - p)))


def _pass_rate() -> float:
    return sum(math.comb(STRIP, k) for k in range(TAU + 1)) / 2**STRIP


def repetitions(levels: int, recall: float = RECALL, similar: float = SIMILAR) -> int:
    """How often to repeat so that a pair at the bound meets in some list with the target recall."""
    p, both = _angle(similar), 0.0
    for a in range(TAU + 1):  # weight of the one, then flips up and down to the other's
        for up in range(STRIP - a + 1):
            for down in range(a + 1):
                if a + up - down <= TAU:
                    both += math.comb(STRIP, a) / 2**STRIP * math.comb(STRIP - a, up) * p**up * (1 - p) ** (STRIP - a - up) * math.comb(a, down) * p**down * (1 - p) ** (a - down)
    meet = (1 - (1 - both) ** CENTRES) ** levels
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def levels_for(nodes: int) -> int:
    return max(1, math.ceil(math.log(max(nodes, 1) / WANTED) / -math.log(_pass_rate())))


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """For each set 256 bits in four words: a bit is the majority among the shingles' hashes, 0 for none."""
    out = np.zeros((len(sets), BITS // 64), dtype=np.uint64)
    full = [n for n, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):
        z, total = at, 0
        while z < len(full) and (z == at or total + len(sets[full[z]]) <= 30_000):
            total += len(sets[full[z]])
            z += 1
        some = full[at:z]
        joined, starts = np.concatenate([sets[n] for n in some]), np.cumsum([0, *[len(sets[n]) for n in some]])
        half = np.diff(starts)[:, None]
        for w in range(BITS // 64):
            bits = np.unpackbits(words.mix(joined, 10 + w).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts = np.add.reduceat(bits, starts[:-1], axis=0, dtype=np.int32)
            out[some, w] = np.packbits(2 * counts > half, axis=1, bitorder="little").view(np.uint64)[:, 0]
        at = z
    return out


def _set_hash(sets: list[np.ndarray]) -> np.ndarray:
    """One number for each set, whatever the order; sets of equal members have equal numbers."""
    with np.errstate(over="ignore"):
        return np.array([words.mix(np.sum(words.mix(s, 3), dtype=np.uint64, keepdims=True) + np.uint64(len(s)), 4)[0] for s in sets], dtype=np.uint64).view(np.int64)


_PRINT = "node long, some boolean, f0 long, f1 long, f2 long, f3 long"


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def prints(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc_id, key, node, some, f0..f3) of every row; key tells rows apart, node is the shingle set, some: it has members."""
    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            sets = words.shingles(b.column(2).to_pylist())
            f = fingerprints(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_set_hash(sets)), pa.array([len(s) > 0 for s in sets]), *[pa.array(f[:, w].copy()) for w in range(4)]], names=["doc_id", "key", "node", "some", "f0", "f1", "f2", "f3"])

    return slim.mapInArrow(run, f"doc_id long, key long, {_PRINT}")


def row_key(id_col: str, text: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text))


def _listed(nodes: DataFrame, levels: int, times: int, seed: int) -> DataFrame:
    """(list, node, label, f0..f3): the lists that each node's fingerprint passes to, over all repetitions."""
    rng = np.random.default_rng(seed)
    strips = [[rng.permutation(BITS)[:STRIP] for _ in range(levels)] for _ in range(times)]
    centres = rng.integers(0, 2**32, size=(times, levels, CENTRES), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            f = np.stack([b.column(f"f{w}").to_numpy() for w in range(4)], axis=1)
            bits = np.unpackbits(np.ascontiguousarray(f).view(np.uint8), axis=1, bitorder="little")
            for t in range(times):
                rows, path = np.arange(len(f)), np.full(len(f), t, dtype=np.int64)
                for level in range(levels):
                    part = np.ascontiguousarray(np.packbits(bits[:, strips[t][level]], axis=1)).view(np.uint32)[:, 0]
                    passes = np.bitwise_count(part[:, None] ^ centres[t, level]) <= TAU
                    at, c = np.nonzero(passes[rows])
                    rows, path = rows[at], words.mix((path[at] * CENTRES + c).view(np.uint64), 20 + level).view(np.int64)
                if len(rows):
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(path), b.column("node").take(at), b.column("label").take(at), *[pa.array(f[rows, w].copy()) for w in range(4)]], names=["list", "node", "label", "f0", "f1", "f2", "f3"])

    return nodes.select("node", "label", "f0", "f1", "f2", "f3").mapInArrow(run, "list long, node long, label long, f0 long, f1 long, f2 long, f3 long")


def _partners(a: np.ndarray, b: np.ndarray, label: np.ndarray, f: np.ndarray, close: int, most: int | None) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Close pairs of rows of a with rows of b that have another label, and the rows of a that have more of them.

    A row gives all its partners if they are PAIRS at most or no limit is set, else the nearest ones.
    """
    left, right, more = [], [], []
    limit = len(b) if most is None else max(most, PAIRS)
    columns, labels = np.ascontiguousarray(f[b].T), label[b]
    for at in range(0, len(a), 256):
        rows = a[at : at + 256]
        d = np.zeros((len(rows), len(b)), dtype=np.uint16)
        for w in range(f.shape[1]):
            d += np.bitwise_count(f[rows, w][:, None] ^ columns[w])
        d[label[rows][:, None] == labels] = BITS + 1
        n = np.count_nonzero(d <= close, axis=1)
        few, many = np.flatnonzero((n > 0) & (n <= limit)), np.flatnonzero(n > limit)
        if len(few):
            i, j = np.nonzero(d[few] <= close)
            left.append(rows[few[i]])
            right.append(b[j])
        if len(many):
            j = np.argpartition(d[many], most - 1, axis=1)[:, :most]
            left.append(np.repeat(rows[many], most))
            right.append(b[j.ravel()])
            more.append(rows[many])
    return left, right, more


def _links(nodes: np.ndarray, label: np.ndarray, f: np.ndarray, side: np.ndarray, close: int, most: int | None, part: bool, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Close pairs of a list's nodes with different labels; a node paired with itself has more of them (part: may have them elsewhere)."""
    order = rng.permutation(len(nodes))  # so that ties fall on other nodes in each list
    if side[0] == 2:
        left, right, more = _partners(order, order, label, f, close, most)
    else:
        one, two = order[side[order] == 0], order[side[order] == 1]
        left, right, more = (x + y for x, y in zip(_partners(one, two, label, f, close, most), _partners(two, one, label, f, close, most), strict=True))
    if part:
        more = [order]
    if not left and not more:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    a, b = nodes[np.concatenate([*left, *more])], nodes[np.concatenate([*right, *more])]
    return np.minimum(a, b), np.maximum(a, b)


def _compared(lists: DataFrame, close: int, most: int | None) -> DataFrame:
    """(a, b): close pairs of each task's nodes with different labels; a = b: this node has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def close_in(table: pa.Table):
            key, task, side, part, node, label = (table.column(c).to_numpy() for c in ("list", "task", "side", "part", "node", "label"))
            f = np.stack([table.column(f"f{w}").to_numpy() for w in range(4)], axis=1).view(np.uint64)
            edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (task[1:] != task[:-1]), [True]]))
            out = []
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if part[s] or (label[s:e] != label[s]).any():
                    out.append(_links(node[s:e], label[s:e], f[s:e], side[s:e], close, most, bool(part[s]), np.random.default_rng([SEED, int(key[s]) & 0xFFFFFFFF])))
            if out:
                a, b = (np.concatenate(x) for x in zip(*out, strict=True))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            last = (b.column("list")[b.num_rows - 1].as_py(), b.column("task")[b.num_rows - 1].as_py())
            key, task = b.column("list").to_numpy(), b.column("task").to_numpy()
            start = np.flatnonzero((key == last[0]) & (task == last[1]))[0]
            if start:
                yield from close_in(pa.Table.from_batches([*kept, b.slice(0, start)]))
                kept = []
            elif kept and (kept[-1].column("list")[-1].as_py(), kept[-1].column("task")[-1].as_py()) != last:
                yield from close_in(pa.Table.from_batches(kept))
                kept = []
            kept.append(b.slice(start))
        if kept:
            yield from close_in(pa.Table.from_batches(kept))

    return lists.repartition("list", "task").sortWithinPartitions("list", "task").mapInArrow(run, "a long, b long")


def _dealt(lists: DataFrame, longest: int, first: bool) -> DataFrame:
    """lists with their tasks. side: 0 is compared with 1, 2 with itself; part: the task does not compare its nodes with the whole list.

    In the first pass a long list is dealt into chunks. Later all its chunks meet each other, but for those within
    a label that fills chunks of its own.
    """
    long = written(lists.groupBy("list").count().filter(F.col("count") > longest).select("list", F.ceil(F.col("count") / longest).cast("long").alias("salts")))
    whole = lambda x: x.withColumn("task", F.lit(0).cast("long")).withColumn("side", F.lit(2)).withColumn("part", F.lit(False))
    if long.isEmpty():
        return whole(lists)
    if first:
        dealt = lists.join(long, "list", "left").fillna(1, "salts").withColumn("task", F.pmod(F.xxhash64("node", "list"), F.col("salts")))
        return dealt.withColumn("side", F.lit(2)).withColumn("part", F.col("salts") > 1).drop("salts")
    own = lists.join(long, "list", "left_semi").groupBy("list", "label").count().withColumn("big", F.col("count") > longest)
    own = written(own.withColumn("group", F.when(F.col("big"), F.col("label")).otherwise(0)))
    groups = own.groupBy("list", "big", "group").agg(F.ceil(F.sum("count") / longest).cast("long").alias("salts"))
    chunk = F.xxhash64("big", "group", "salt")
    chunks = written(groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).select("list", "big", "group", chunk.alias("chunk")))
    other = chunks.select("list", *[F.col(c).alias(f"other_{c}") for c in ("big", "group", "chunk")])
    within = F.col("big") & F.col("other_big") & (F.col("group") == F.col("other_group"))
    met = chunks.join(other, "list").filter((F.col("chunk") <= F.col("other_chunk")) & ~within).withColumn("task", F.xxhash64("chunk", "other_chunk"))
    sides = F.when(F.col("chunk") == F.col("other_chunk"), F.array(F.struct("chunk", F.lit(2).alias("side")))).otherwise(F.array(F.struct("chunk", F.lit(0).alias("side")), F.struct(F.col("other_chunk").alias("chunk"), F.lit(1).alias("side"))))
    tasks = written(met.select("list", "task", F.explode(sides).alias("x")).select("list", "task", "x.chunk", "x.side"))
    of_label = own.join(groups, ["list", "big", "group"]).select("list", "label", "big", "group", "salts")
    placed = lists.join(of_label, ["list", "label"]).withColumn("salt", F.pmod(F.xxhash64("node", "list"), F.col("salts"))).withColumn("chunk", chunk)
    dealt = placed.join(tasks, ["list", "chunk"]).select(*lists.columns, "task", "side", F.lit(False).alias("part"))
    return whole(lists.join(long, "list", "left_anti")).unionByName(dealt)


def links(df: DataFrame, rows: DataFrame, nodes: DataFrame, text: str, id_col: str, similar: float = SIMILAR, recall: float = RECALL, longest: int = LIST) -> DataFrame:
    """(a, b): verified links of nodes, enough of them to connect all that any close pair of a list connects.

    A pass compares the nodes of each list that have different labels, verifies the pairs and gives the nodes of a
    component one label. Nodes that had more partners than the pass took go on; the last pass takes all.
    """
    n = nodes.count()
    levels = levels_for(n)
    times = repetitions(levels, recall, similar)
    left, found, tried, sets = nodes.withColumn("label", F.col("node")), None, None, None
    for turn, most in enumerate(NEAREST):
        out = written(_compared(_dealt(_listed(left, levels, times, SEED), longest, turn == 0), close_bits(similar), most).distinct())
        pairs = out.filter("a < b")
        pairs = pairs if tried is None else written(pairs.join(tried, ["a", "b"], "left_anti"))
        sets = shingle_sets(df, rows, pairs, text, id_col, sets)
        good = written(verified(pairs, sets, similar))
        found, tried = (good, pairs) if found is None else (found.unionByName(good), tried.unionByName(pairs))
        more = out.filter("a = b").select(F.col("a").alias("node"))
        if more.isEmpty():
            return found
        left = written(nodes.join(more, "node", "left_semi").join(components(found), "node", "left").withColumn("label", F.coalesce("label", "node")))


def shingle_sets(df: DataFrame, rows: DataFrame, pairs: DataFrame, text: str, id_col: str, known: DataFrame | None = None) -> DataFrame:
    """(node, members) of all nodes in pairs, besides the known ones."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    if known is not None:
        ends = written(ends.join(known.select("node"), "node", "left_anti"))
        if ends.isEmpty():
            return known
    wanted = rows.groupBy("node").agg(F.min("key").alias("key")).join(ends, "node", "left_semi").select("key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches, 512):
            sets = words.shingles(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "members"])

    texts = df.select(row_key(id_col, text).alias("key"), F.col(text).alias("text")).join(wanted.hint("shuffle_hash"), "key").select("node", "text")
    sets = written(texts.mapInArrow(run, "node long, members array<long>").dropDuplicates(["node"]))
    return sets if known is None else known.unionByName(sets)


def verified(pairs: DataFrame, sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The pairs whose shingle sets have the exact Jaccard similarity."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches, 512):
            a, z = b.column(2), b.column(3)
            good = []
            for n in range(b.num_rows):
                x, y = a[n].values.to_numpy(), z[n].values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similar * (len(x) + len(y) - both) - 1e-9)
            yield b.select([0, 1]).filter(pa.array(good))

    one, two = sets.select(F.col("node").alias("a"), F.col("members").alias("of_a")), sets.select(F.col("node").alias("b"), F.col("members").alias("of_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "of_a", "of_b").mapInArrow(compare, "a long, b long")


def classes(df: DataFrame, id_col: str = "doc_id", text: str = "text", similar: float = SIMILAR, recall: float = RECALL, longest: int = LIST) -> DataFrame:
    """doc_id, row_key, class_id (the smallest id of the class), class_size, kept, for every row."""
    rows = written(prints(df, id_col, text))
    nodes = written(rows.filter("some").groupBy("node").agg(*[F.first(f"f{w}").alias(f"f{w}") for w in range(4)]))
    labels = components(links(df, rows, nodes, text, id_col, similar, recall, longest))
    alone = F.when(F.col("some"), F.coalesce("label", "node")).otherwise(F.xxhash64("key"))
    counted = rows.groupBy("node", "some", "doc_id", "key").agg(F.count("*").alias("times"))
    # rows without shingles are classes by row; repeated ones are one class
    of_class = counted.join(labels, "node", "left").withColumn("label", alone)
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))
    sums = of_class.groupBy("some", "label").agg(F.min(first).alias("first"), F.sum("times").alias("class_size"))
    joined = of_class.join(sums, ["some", "label"]).withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return joined.select("doc_id", F.col("key").alias("row_key"), F.col("first.doc_id").alias("class_id"), "class_size", ((F.col("key") == F.col("first.key")) & (F.col("time") == 1)).alias("kept"))


def kept(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of df for each class, with its columns."""
    key = free_name(df, "near_key")
    gone = written(classes(df, id_col, text).groupBy("row_key").agg(F.max("kept").alias("kept")).filter("NOT kept").select(F.col("row_key").alias(key)))
    return df.withColumn(key, row_key(id_col, text)).join(gone.hint("shuffle_hash"), key, "left_anti").dropDuplicates([key]).select(*df.columns)
