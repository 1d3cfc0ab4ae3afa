"""Mixing sources to target weights by capped water-filling, in DataFrame operations alone.

A document's size is its number of words (runs of other than white space; null: 0).
Sources, by code point with null last, have the given weights in turn and share the
sum of all sizes. No target may exceed ``epochs`` times its source's size: such
sources are clamped there and their excess goes to the others by weight, until none
is above. That fixed point is found in one sorted pass over the sources: clamped
are those with the least cap for their weight.

A source then takes its target, rounded to whole words, as whole repetitions of all
its documents and a fraction of one more. The fraction goes to documents in a
seeded order, each whole, until the words are used up; the last one is taken in
part. So the words taken sum to the rounded target, and no document exceeds
``epochs`` times its size.

The order's running sum is taken in 4096 hash ranges of each source, whose sums are
added up first, so no source meets in one task. Repeated ids are taken as separate
rows; rows that agree in id and size may swap places. Sizes of zero take nothing.
An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import free_name, written

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """A source as a string that is never null."""
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source))


def seeded(id_col: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) with target; one row for each source, however many documents there are."""
    by_name, fill = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("fill", F.col("source").asc_nulls_last())
    cap = F.col("source_size") * epochs
    turn = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", turn).withColumn("cap", cap).withColumn("fill", F.col("cap") / F.col("weight"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    here = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(here)
    leveled = ranked.withColumn("level", level)
    # the first source in this order that its share does not fill sets the level for all after it
    free = leveled.withColumn("water", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("fill", F.col("source").isNull(), F.col("source"), "level"))).over(all_rows)["level"])
    share = F.col("water") * F.col("weight")
    return free.select("source", "source_size", F.when(share <= F.col("cap"), share).otherwise(F.col("cap").cast("double")).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED, row: str | None = None) -> DataFrame:
    """For each row: doc_id, source, size, source_size, target, taken, and row, the column that tells rows apart, if given."""
    rows = [] if row is None else [row]
    slim = written(df.select(*rows, F.col(id_col).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size")))
    hashed = slim.withColumn("order", seeded(F.col("doc_id"), seed)).withColumn("range", F.substring("order", 1, 3)).withColumn("key", _key(F.col("source")))
    ranges = hashed.groupBy("key", "range").agg(F.first("source").alias("source"), F.sum("size").alias("range_size"))
    goals = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, epochs)
    goals = goals.select(_key(F.col("source")).alias("key"), "source_size", "target")
    earlier = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("key", "range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("start")).join(goals, "key")
    inside = Window.partitionBy("key", "range").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.join(starts, ["key", "range"]).withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    want = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("CAST(floor(target + 0.5) AS BIGINT) DIV source_size")).otherwise(F.lit(0)).cast("long")
    rest = want - whole * F.col("source_size")
    part = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), rest - F.col("before")))
    return placed.select(*rows, "doc_id", "source", "size", "source_size", "target", (whole * F.col("size") + part).alias("taken"))


def repeated(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: each row of df as often as it is taken whole, and once more cut after the words that it is taken in part.

    Rows are told apart by a number that is written once with them, so ids may be null or repeated. Rows without words
    aren't taken. Columns are those of df.
    """
    names = [free_name(df, f"mix_{x}") for x in ("size", "taken", "time")]
    size, taken, time = map(F.col, names)
    row = free_name(df, "mix_row")
    df_rows = written(df.withColumn(row, F.monotonically_increasing_id()))
    plan = mix(df_rows, id_col, text, source, row=row, **how).filter("taken > 0").select(row, F.col("size").alias(names[0]), F.col("taken").alias(names[1]))
    joined = df_rows.join(plan, row).withColumn(names[2], F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(taken / size).cast("long"))))
    left = taken - (time - 1) * size
    start = F.regexp_extract(F.col(text), r"^[\x20\x09-\x0D]*", 0)
    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.concat(start, F.array_join(F.slice(words, F.lit(1), left.cast("int")), ""))
    return joined.withColumn(text, F.when(left >= size, F.col(text)).otherwise(cut)).select(*df.columns)
