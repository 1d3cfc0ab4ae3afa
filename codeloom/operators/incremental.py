"""Incremental maintenance: an index and graphs that follow changes of their files.

What a change gives equals a build from scratch; ids are never used again, and a table
with too many dead rows is built anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom import defaults as D
from codeloom.operators import resolve as R


def apply_to_chunks(chunks: DataFrame, fresh: DataFrame, change: DataFrame, file: str = "file_path") -> DataFrame:
    """chunks (chunk_id, dead, ...) after a change (path, change): rows of changed files are dead, fresh rows are appended under new ids."""
    touched = change.filter("change IN ('modified', 'removed')").select(F.col("path").alias(file))
    hit = chunks.join(touched, file, "left_semi").select("chunk_id", F.lit(True).alias("_hit"))
    old = chunks.join(hit, "chunk_id", "left").withColumn("dead", F.col("dead") | F.coalesce("_hit", F.lit(False))).drop("_hit")
    last = chunks.agg(F.coalesce(F.max("chunk_id"), F.lit(-1)).alias("_last"))
    added = change.filter("change IN ('added', 'modified')").select(F.col("path").alias(file))
    place = F.row_number().over(Window.orderBy(file, "n"))  # the rows of one delta
    new = fresh.join(added, file, "left_semi").withColumn("_p", place).join(F.broadcast(last)).withColumn("chunk_id", (F.col("_last") + F.col("_p")).cast("long")).withColumn("dead", F.lit(False))
    return old.unionByName(new.select(*old.columns))


def needs_compaction(chunks: DataFrame, ratio: float = D.COMPACT_RATIO) -> bool:
    r = chunks.agg(F.count_if("dead").alias("d"), F.count("*").alias("n")).first()
    return bool(r["n"]) and r["d"] / r["n"] > ratio


def live(chunks: DataFrame) -> DataFrame:
    return chunks.filter("NOT dead")


def apply_to_rows(rows: DataFrame, fresh: DataFrame, change: DataFrame, file: str = "file") -> DataFrame:
    """Rows by file after a change: those of changed files go, those of new contents come."""
    gone = change.filter("change IN ('modified', 'removed')").select(F.col("path").alias(file))
    come = change.filter("change IN ('added', 'modified')").select(F.col("path").alias(file))
    return rows.join(gone, file, "left_anti").unionByName(fresh.join(come, file, "left_semi").select(*rows.columns))


def apply_to_calls(edges: DataFrame, sites: DataFrame, callables: DataFrame, types: DataFrame, imports: DataFrame, dep_edges: DataFrame, change: DataFrame, renamed: DataFrame) -> DataFrame:
    """Call edges after a change. sites and the other tables are those after it; renamed (name): names declared in changed files before or after.

    Only sites of changed files, sites of files that reach changed ones by imports, and sites of those names are bound again; all others keep their edges.
    """
    moved = change.filter("change <> 'mtime_only'").select(F.col("path").alias("file"))
    from codeloom.operators.graph import bfs, reversed_edges

    near = bfs(reversed_edges(dep_edges.select("src", "dst")), moved.select(F.col("file").alias("node")), D.CLOSURE_DEPTH).select(F.col("node").alias("file"))
    files = moved.unionByName(near).distinct()
    by_file = sites.join(files, "file", "left_semi")
    by_name = sites.join(files, "file", "left_anti").join(renamed.select("name").distinct(), "name", "left_semi").select(*sites.columns)
    again = by_file.unionByName(by_name)
    fresh = R.resolve_calls(again, callables, types, imports, dep_edges)
    said = again.select(F.col("source_qn").alias("src"), "line", "kind").distinct()
    kept = edges.join(files, "file", "left_anti").join(said, ["src", "line", "kind"], "left_anti").join(moved, "file", "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)
