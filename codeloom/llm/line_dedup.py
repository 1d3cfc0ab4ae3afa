"""Line deduplication by an exact set-similarity join.

A line is the set of its words (runs of other than ASCII white space). Lines match
when the Jaccard similarity of their sets is 0.8 or more. A line that matches an
earlier line, by (document id, line number), is removed; null ids come last, and
repeated documents follow one another. Lines without words match nothing.

Lines with one word set are one node, with its first place; copies are never paired.
A set is told from others by 128 bits, a word by 64 bits of hash. Nodes are joined by
prefix filtering: the words of each set are put in one global order, rare words
first, and two sets of the similarity share a word among their first
n - ceil(0.8 n) + 1, for the shorter set among its first n / 9 + 1. Rarity is taken
from two rows of counters of fixed size, summed over all words; what order it gives
decides only the cost, not the result. Words of which there is one in all lines meet
nothing and are left out.

Two sets that meet on a prefix word are a candidate if their lengths agree with the
bound, if the words after the two positions can still reach the overlap, and if the
parities of their words in 64 classes differ in no more classes than the sets may
differ in words. These filters run inside the join, so what leaves it is nearly all
true; those few candidates are verified on their whole sets, in buckets of clusters.

Null and empty texts have no lines. Very long texts and lines are taken whole.
Columns of the input other than those named are not read. Empty tables give empty
tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm import words
from codeloom.llm.common import dropped, free_name, written

SIMILAR = 0.8
#: Candidate pairs that are verified in one call, about.
BUCKET = 100_000
#: Words of the two sets of pairs that are compared at a time, about; a worker holds some 50 bytes for each beside its bucket.
WORDS = 1 << 18
#: Counters in each of two rows, a power of two. Each takes a byte on its way to the tasks: 4 MB together, whatever the input.
COUNTERS = 1 << 21
#: Bits of a filter of row keys, a power of two; 2 MB are sent to the tasks, whatever the input.
BITS = 1 << 24
_BLOCK = 1 << 16
_SLICE = 1024
_COUNTED = 128


def _needed(n):
    """Words of a set of n that a match shares at least: ceil(0.8 n), in whole numbers."""
    return -(-4 * n // 5)


def row_key(id_col: str, text: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text))


def _parts(batches: Iterator[pa.RecordBatch], rows: int = _SLICE) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _counter(hashes: np.ndarray, row: int) -> np.ndarray:
    return ((hashes >> np.uint64(28 * row + 8)) & np.uint64(COUNTERS - 1)).astype(np.int64) + row * COUNTERS


def _counters(texts: DataFrame) -> np.ndarray:
    """How many words fall to each counter, as steps of their logarithm: 0 is none, 1 is one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * COUNTERS, dtype=np.uint32)  # a task's text has fewer words than this holds
        for b in _parts(batches, _COUNTED):
            hashes, _ = words.word_hashes(b.column(0).to_pylist())
            for row in range(2):
                np.add.at(total, _counter(hashes, row), 1)
        for block, n in enumerate(total.reshape(-1, _BLOCK)):
            some = np.flatnonzero(n)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([some.astype(np.uint16).tobytes()]), pa.array([n[some].tobytes()])], names=["block", "at", "n"])

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, at, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                total.setdefault(block, np.zeros(_BLOCK, dtype=np.uint64))[np.frombuffer(at, dtype=np.uint16)] += np.frombuffer(n, dtype=np.uint32)
        for block, n in total.items():
            out = np.where(n > 0, np.minimum(1 + np.round(4 * np.log2(np.maximum(n, 1))), 255), 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([out.tobytes()])], names=["block", "steps"])

    out = np.zeros(2 * COUNTERS, dtype=np.uint8)
    summed = texts.mapInArrow(count, "block int, at binary, n binary").repartition(2 * COUNTERS // _BLOCK, "block")
    for r in summed.mapInArrow(steps, "block int, steps binary").collect():
        out[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["steps"], dtype=np.uint8)
    return out


class _Sets:
    """The word sets of the lines of some texts that have words: which text and line, how many words, and the words' hashes one set after another."""

    def __init__(self, texts: list[str | None]):
        hashes, line, first = words.line_words(texts)
        owner, self.hashes = words.distinct(line, hashes)
        new = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])[: len(owner)])
        at = owner[new]
        self.starts, self.n = new, np.diff(new, append=len(owner))
        self.text = np.searchsorted(first, at, "right") - 1
        self.line = at - first[self.text]

    def sums(self, seed: int) -> np.ndarray:
        """A number for each set, whatever the order of its words."""
        if not len(self.n):
            return np.empty(0, dtype=np.int64)
        with np.errstate(over="ignore"):
            return words.mix(np.add.reduceat(words.mix(self.hashes, seed), self.starts) + self.n.astype(np.uint64), seed + 1).view(np.int64)

    def parities(self) -> np.ndarray:
        """A bit for each of 64 classes of words: whether the number of words in it is odd."""
        return np.bitwise_xor.reduceat(np.uint64(1) << (self.hashes >> np.uint64(58)), self.starts).view(np.int64)

    def only(self, which: np.ndarray) -> np.ndarray:
        """The words of some sets, and the sets' numbers among them."""
        n = self.n[which]
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[which], n)


def _prefixes(sets: _Sets, which: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of some sets the prefix words that others may have, each as 32 bits of hash and 32 of its place, and how many of each set."""
    at, n = sets.only(which), sets.n[which]
    hashes, of = sets.hashes[at], np.repeat(np.arange(len(n)), n)
    rarity = np.minimum(seen[_counter(hashes, 0)], seen[_counter(hashes, 1)])
    key = (of.astype(np.uint64) << np.uint64(40)) | (rarity.astype(np.uint64) << np.uint64(32)) | (hashes >> np.uint64(32))
    order = np.argsort(key)
    if (key[order][1:] == key[order][:-1]).any():  # words that agree in their high bits must have one order everywhere
        order = np.lexsort((hashes, rarity, of))
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(n) - n, n)
    used = np.where(n > 3, n - _needed(n) + 1, 0)  # sets of up to 3 words match no other set
    take = (place < np.repeat(used, n)) & (rarity[order] > 1)
    low = hashes[order][take] << np.uint64(32)
    return (low | place[take].astype(np.uint64)).view(np.int64), np.bincount(of[take], minlength=len(n))


def _lines(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc_id, key, line, high, low) of each line with words; n, parities and prefix with the first line of each set among some documents."""
    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text).alias("key"), F.col(text).alias("text"))
    counters = df.sparkSession.sparkContext.broadcast(_counters(slim.select("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = counters.value
        for b in _parts(batches):
            sets = _Sets(b.column(2).to_pylist())
            if not len(sets.n):
                continue
            high, low = sets.sums(3), sets.sums(5)
            rows = pa.array(sets.text)
            doc, key = b.column(0).take(rows), b.column(1).take(rows)
            no_id = doc.is_null().to_numpy(zero_copy_only=False)
            order = np.lexsort((sets.line, key.to_numpy(), doc.fill_null(0).to_numpy(), no_id, low, high))
            new = np.concatenate([[True], (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])])
            first = np.sort(order[new])
            found, sizes = _prefixes(sets, first, seen)
            counts = np.zeros(len(sets.n), dtype=np.int64)
            counts[first] = sizes
            own = np.zeros(len(sets.n), dtype=bool)
            own[first] = True
            lone = pa.array(~own)
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            prefix = pa.ListArray.from_arrays(ends, pa.array(found), mask=lone)
            yield pa.RecordBatch.from_arrays(
                [doc, key, pa.array(sets.line.astype(np.int32)), pa.array(high), pa.array(low), pa.array(sets.n.astype(np.int32), mask=~own), pa.array(sets.parities(), mask=~own), prefix],
                names=["doc_id", "key", "line", "high", "low", "n", "parities", "prefix"],
            )

    return slim.mapInArrow(run, "doc_id long, key long, line int, high long, low long, n int, parities long, prefix array<long>")


def _nodes(wide: DataFrame) -> DataFrame:
    """A row for each set: node, a number of its own, high, low, place (its first), n, parities, prefix."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "line")
    first = F.min(F.struct(place.alias("place"), "n", "parities", "prefix")).alias("first")
    return wide.filter("n IS NOT NULL").groupBy("high", "low").agg(first).select(F.monotonically_increasing_id().alias("node"), "high", "low", "first.*")


def candidates(nodes: DataFrame) -> DataFrame:
    """(a, b): distinct pairs of nodes that share a prefix word and pass the filters of length, place and parities; a has no more words than b.

    That a word stands among the first n / 9 + 1 of the shorter set is asked together with the other set's length, which is never
    negative: a condition on one side alone would go below its exchange, and the same words would be sent twice.
    """
    tokens = nodes.filter("n > 3").select("node", "n", "parities", F.explode("prefix").alias("x"))
    tokens = tokens.select(F.shiftright("x", 32).cast("int").alias("word"), "node", "n", F.col("x").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("i"), "parities")
    x, y = (tokens.select(*[F.col(c).alias(f"{c}_{side}") for c in tokens.columns]) for side in "ab")
    both = F.col("n_a") + F.col("n_b")
    met = (
        (F.col("word_a") == F.col("word_b")) & (F.least(F.col("n_a") - 9 * F.col("i_a"), F.col("n_b")) >= 0) & ((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b"))))
        & (5 * F.col("n_a") >= 4 * F.col("n_b")) & (9 * F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b")) >= 4 * both)
        & (9 * F.bit_count(F.col("parities_a").bitwiseXOR(F.col("parities_b"))) <= both)
    )
    return x.join(y.hint("merge"), met).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _bits(keys: DataFrame) -> DataFrame:
    """(block, bits): which remainders the keys have, a bit each; the table has BITS bits at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column("at").to_numpy()
            for block in np.unique(at >> 19).tolist():
                found.setdefault(block, np.zeros(1 << 19, dtype=np.uint8))[at[at >> 19 == block] & 0x7FFFF] = 1
        for block, x in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes()])], names=["block", "bits"])

    at = keys.select(F.col("key").bitwiseAND(F.lit(BITS - 1)).alias("at")).distinct()
    return written(at.repartition(BITS >> 19, F.shiftright("at", 19)).mapInArrow(run, "block long, bits binary"))


def _with_bit(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """The rows whose key has its bit; others may pass too."""
    at = F.col("row").bitwiseAND(F.lit(BITS - 1))
    byte = F.conv(F.hex(F.substr("bits", F.shiftright(at, 3).bitwiseAND(F.lit(0xFFFF)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(bits), F.shiftright(at, 19) == F.col("block")).filter(F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1).drop("block", "bits")


def _members(df: DataFrame, nodes: DataFrame, goes: DataFrame, id_col: str, text: str) -> DataFrame:
    """(set, to, doc_id, key, line, members): the word hashes, 8 bytes each, of every set that goes to a bucket, read again from the place where it stands first, and that place."""
    wanted = nodes.select(F.col("node").alias("set"), "place.doc_id", "place.key", "place.line").join(goes, "set")
    lists = written(wanted.groupBy(F.col("doc_id").alias("of"), "key").agg(F.collect_list(F.struct("line", "set", "to")).alias("asked")))
    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text).alias("row"), F.col(text).alias("text"))
    same = (F.col("row") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("of"))
    bits = _bits(lists)
    texts = _with_bit(slim, bits).join(lists.hint("shuffle_hash"), same).select("text", "asked.line", "asked.set", "asked.to", "doc_id", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            cut = [t.split("\n") for t in b.column(0).to_pylist()]
            sets = _Sets([lines[k] for lines, some in zip(cut, b.column(1).to_pylist(), strict=True) for k in some])
            ends = 8 * np.concatenate([sets.starts, [len(sets.hashes)]]).astype(np.int32)
            members = pa.Array.from_buffers(pa.binary(), len(sets.n), [None, pa.py_buffer(ends), pa.py_buffer(sets.hashes)])
            row = pa.array(np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy()))
            yield pa.RecordBatch.from_arrays(
                [b.column(2).flatten(), b.column(3).flatten(), b.column(4).take(row), b.column(5).take(row), b.column(1).flatten(), members],
                names=["set", "to", "doc_id", "key", "line", "members"],
            )

    out = written(texts.mapInArrow(run, "set long, to array<long>, doc_id long, key long, line int, members binary"))
    dropped(lists, bits)
    return out


def _lists(members: pa.BinaryArray) -> pa.ListArray:
    """The same bytes as lists of whole numbers."""
    _, ends, data = members.buffers()
    at = np.frombuffer(ends, dtype=np.int32)[members.offset : members.offset + len(members) + 1] // 8
    return pa.ListArray.from_arrays(pa.array(at), pa.Array.from_buffers(pa.int64(), data.size // 8, [None, data]))


def _reaching(one: np.ndarray, two: np.ndarray, lists: pa.ListArray, at_once: int = WORDS) -> np.ndarray:
    """For pairs of places in lists whether nine times the words in common reach four times the words of both."""
    sizes = lists.value_lengths().to_numpy().astype(np.int64)
    starts, flat = np.cumsum(sizes) - sizes, lists.flatten().to_numpy()
    order = np.argsort(one, kind="stable")  # pairs of one set come together, so a slice of pairs has few sets
    ends = np.cumsum((sizes[one] + sizes[two])[order])
    good = np.empty(len(one), dtype=bool)
    at = 0
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(ends, at_once + (ends[at - 1] if at else 0), "right")))
        some, k = order[at:to], to - at
        sets, place = np.unique(np.concatenate([one[some], two[some]]), return_inverse=True)
        a, b, n = place[:k], place[k:], sizes[sets]
        first = np.cumsum(n) - n
        words_, word = np.unique(flat[np.arange(n.sum()) + np.repeat(starts[sets] - first, n)], return_inverse=True)
        has = np.repeat(np.arange(len(sets)) * len(words_), n) + word
        has.sort()
        begin = np.cumsum(n[a]) - n[a]
        asked = np.repeat(b * len(words_), n[a]) + word[np.arange(n[a].sum()) + np.repeat(first[a] - begin, n[a])]
        both = np.add.reduceat(has[np.minimum(np.searchsorted(has, asked), len(has) - 1)] == asked, begin, dtype=np.int64)
        good[some] = 9 * both >= 4 * (n[a] + n[b])
        at = to
    return good


def linked(df: DataFrame, nodes: DataFrame, pairs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(node, links, later): how many other nodes each one reaches the similarity with, and whether one of them stands earlier.

    Pairs of one cluster go to one bucket, by the least set within two links, and take each set there once; a cluster of more
    than BUCKET pairs is dealt over a square of buckets, a set to those of its row and column. A bucket sends back a row for
    a set, not for a pair.
    """
    buckets = max(1, -(-pairs.count() // BUCKET))
    least = lambda pairs, x, y: pairs.select(F.explode(F.array(F.struct(F.col("a").alias("set"), F.col(x).alias("near")), F.struct(F.col("b").alias("set"), F.col(y).alias("near")))).alias("x")).groupBy("x.set").agg(F.least(F.min("x.near"), F.col("set")).alias("near"))
    near = least(pairs, "b", "a")
    led = written(pairs.join(near.withColumnsRenamed({"set": "a", "near": "near_a"}), "a").join(near.withColumnsRenamed({"set": "b", "near": "near_b"}), "b").select("a", "b", F.least("near_a", "near_b").alias("near")))
    led = written((one := led).join(least(one, "near", "near").withColumnsRenamed({"set": "a", "near": "lead"}), "a").select("a", "b", "lead"))
    large = led.groupBy("lead").count().filter(F.col("count") > BUCKET).select("lead", F.ceil(F.sqrt(F.col("count") / BUCKET)).alias("parts"))
    part = [F.pmod(F.xxhash64(side), F.coalesce("parts", F.lit(1)).cast("long")) for side in ("a", "b")]
    placed = written(led.join(large, "lead", "left").select("a", "b", F.pmod(F.xxhash64("lead", *part), F.lit(buckets)).alias("bucket")))
    dropped(one)
    goes = placed.select("bucket", F.explode(F.array("a", "b")).alias("set")).groupBy("set").agg(F.collect_set("bucket").alias("to"))
    members = _members(df, nodes, goes, id_col, text)
    needed = members.select(F.explode("to").alias("of"), "set", "doc_id", "key", "line", "members")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "later": pa.array([], pa.bool_())})
        sets, by = np.unique(right.column("set").to_numpy(), return_index=True)  # repeated rows give a set more than once
        a, b = (np.searchsorted(sets, left.column(c).to_numpy()) for c in ("a", "b"))
        good = _reaching(by[a], by[b], _lists(right.column("members").combine_chunks()))
        a, b = a[good], b[good]
        right = right.select(["doc_id", "key", "line"]).take(pa.array(by))
        doc = right.column("doc_id").combine_chunks()
        order = np.lexsort((right.column("line").to_numpy(), right.column("key").to_numpy(), doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False)))
        rank = np.empty(len(sets), dtype=np.int64)
        rank[order] = np.arange(len(sets))
        n = np.bincount(a, minlength=len(sets)) + np.bincount(b, minlength=len(sets))
        later = np.bincount(np.where(rank[a] > rank[b], a, b), minlength=len(sets)) > 0
        some = np.flatnonzero(n)
        return pa.table({"node": sets[some], "links": n[some], "later": later[some]})

    sums = placed.groupBy("bucket").cogroup(needed.groupBy("of")).applyInArrow(compare, "node long, links long, later boolean")
    found = written(sums.groupBy("node").agg(F.sum("links").alias("links"), F.max("later").alias("later")))
    dropped(led, placed, members)
    return found


def removals(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: doc_id, row_key, copy (from 1, of repeated rows), n_lines (those with words), removed_lines (numbers from 0), n_removed, n_links (of its lines to different lines)."""
    wide = written(_lines(df, id_col, text))
    full = written(_nodes(wide))
    lines = written(wide.select("doc_id", "key", "line", "high", "low"))
    dropped(wide)
    pairs = written(candidates(full))
    nodes = written(full.select("node", "high", "low", "place"))
    dropped(full)
    found = linked(df, nodes, pairs, id_col, text)
    dropped(pairs)
    known = nodes.select("node", "high", "low", "place").join(found, "node", "left").drop("node")
    here = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "line")
    each = lines.join(known, ["high", "low"]).select("doc_id", "key", F.struct("line", (F.coalesce("later", F.lit(False)) | (here != F.col("place"))).alias("gone"), F.coalesce("links", F.lit(0)).alias("links")).alias("x"))
    listed = each.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("x")).alias("xs"))
    gone, all_lines = F.transform(F.filter("xs", lambda x: x["gone"]), lambda x: x["line"]), F.transform("xs", lambda x: x["line"])
    summed = listed.select(F.col("doc_id").alias("of"), F.col("key").alias("row_key"), F.size("xs").cast("long").alias("n_lines"), gone.alias("removed"), all_lines.alias("all"), F.aggregate("xs", F.lit(0).cast("long"), lambda n, x: n + x["links"]).alias("n_links"))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text).alias("key")).groupBy("doc_id", "key").agg(F.count("*").alias("times"))
    joined = rows.join(summed, (F.col("key") == F.col("row_key")) & F.col("doc_id").eqNullSafe(F.col("of")), "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    removed = F.coalesce(F.when(F.col("copy") > 1, F.col("all")).otherwise(F.col("removed")), F.expr("CAST(array() AS ARRAY<INT>)"))
    return joined.select("doc_id", F.col("key").alias("row_key"), "copy", F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_lines"), removed.alias("removed_lines"), F.size(removed).cast("long").alias("n_removed"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def without(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """df with the removed lines taken out of its texts; of repeated rows one is left."""
    key, of, gone = (free_name(df, f"line_{x}") for x in ("key", "of", "gone"))
    found = written(removals(df, id_col, text).filter("copy = 1").select(F.col("row_key").alias(key), F.col("doc_id").alias(of), F.col("removed_lines").alias(gone)))
    row = free_name([*df.columns, key, of, gone], "line_row")
    rows = df.withColumn(row, row_key(id_col, text)).dropDuplicates([row, id_col]).join(found, (F.col(row) == F.col(key)) & F.col(id_col).cast("long").eqNullSafe(F.col(of)))
    left = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda _, i: ~F.array_contains(gone, i)), "\n")
    return rows.withColumn(text, F.when(F.size(gone) > 0, left).otherwise(F.col(text))).select(*df.columns)
