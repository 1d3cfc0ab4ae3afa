"""Exact deduplication, safe for hot groups, in DataFrame operations alone.

Texts are equal when they are identical after deletion of white space
(``[\\x20\\x09-\\x0D]``); null counts as empty. Of equal texts the row with the most
code points stays, then the one with the smallest id (null ids come last).

1. Each task combines its own rows (the partial aggregate before the exchange),
   grouped by digest and whole content.
2. Groups are merged by digest, salt and whole content. The salt comes from the
   task, so a task sends one row for a text however many copies it read, and the
   copies of one text meet in many tasks.
3. The winners of all salts are merged by digest and whole content.

Content is a grouping key at each stage, so two contents with one digest never
merge. Rows then find their group by digest, as soon as it is known that each digest has
one content; where a digest has several, by digest and content. Repeated rows (same id, same text) are one group; exactly
one of them stays. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import free_name, written

SALTS = 16
_TWO_64 = "18446744073709551616BD"
_LAST_ID = "9223372036854775807"


def squashed(text: Column) -> Column:
    """The text without space, tab, line feed, vertical tab, form feed and carriage return; null gives empty."""
    out = F.coalesce(text, F.lit(""))
    for c in " \t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def _prepared(df: DataFrame, id_col: str, text: str, digest) -> DataFrame:
    """(doc_id, n, content, digest), n the code points of the original text."""
    cut = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.char_length(text), F.lit(0)).alias("n"), squashed(F.col(text)).alias("content"))
    return cut.withColumn("digest", digest(F.col("content")))


def _best() -> Column:
    """One number that orders rows by code points, then by smaller id; it has a fixed width, so hash aggregation holds it."""
    return F.expr(f"CAST(n AS DECIMAL(10,0)) * {_TWO_64} + ({_LAST_ID}BD - CAST(coalesce(doc_id, {_LAST_ID}L) AS DECIMAL(20,0)))").cast("decimal(38,0)")


def _merged(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max("best").alias("best"), F.sum("copies").alias("copies"))


def groups(df: DataFrame, id_col: str = "doc_id", text: str = "text", digest=sha256) -> DataFrame:
    """One row for each distinct content: digest, content, best, copies."""
    rows = _prepared(df, id_col, text, digest).select("digest", "content", _best().alias("best"), F.lit(1).cast("long").alias("copies"), F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
    return _merged(_merged(rows, "digest", "salt", "content"), "digest", "content")


def _winners(found: DataFrame) -> DataFrame:
    best = F.col("best")
    n = F.floor(best / F.expr(_TWO_64)).cast("long")
    doc = F.expr(f"CAST({_LAST_ID}BD - (best - CAST(floor(best / {_TWO_64}) AS DECIMAL(38,0)) * {_TWO_64}) AS BIGINT)")
    return found.select(*[c for c in ("digest", "content") if c in found.columns], n.alias("keep_n"), F.when(doc != F.expr(f"{_LAST_ID}L"), doc).alias("keep_id"), F.col("copies").alias("group_size"))


def decisions(df: DataFrame, id_col: str = "doc_id", text: str = "text", digest=sha256) -> DataFrame:
    """For each row: doc_id, keep_id, group_size, kept, text_sha256."""
    found = written(groups(df, id_col, text, digest).drop("content"))
    several = _several(found)
    rows = _prepared(df, id_col, text, digest)
    if several.isEmpty():
        slim = rows.drop("content") if digest is sha256 else rows.withColumn("sha", sha256(F.col("content"))).drop("content")
        return _decided(slim, _winners(found), ["digest"])
    # a digest with several contents: its rows are told apart by content
    shared = rows.join(several, "digest", "left_semi")
    contents = groups(df.select(id_col, text), id_col, text, digest).join(several, "digest", "left_semi")
    alone = rows.join(several, "digest", "left_anti").withColumn("sha", sha256(F.col("content"))).drop("content")
    return _decided(alone, _winners(found), ["digest"]).unionByName(_decided(shared.withColumn("sha", sha256(F.col("content"))), _winners(contents), ["digest", "content"]))


def _decided(rows: DataFrame, winners: DataFrame, on: list[str]) -> DataFrame:
    """Rows that agree in id, text and length are counted as one and come out as many again, one of them kept."""
    sha = "sha" if "sha" in rows.columns else "digest"
    counted = rows.groupBy(*dict.fromkeys([*on, sha]), "doc_id", "n").agg(F.count("*").alias("times"))
    joined = counted.join(winners, on, "inner")
    first = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n"))
    return joined.select("doc_id", "keep_id", "group_size", first.alias("first"), F.col(sha).alias("text_sha256"), F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("time")).select(
        "doc_id", "keep_id", "group_size", (F.col("first") & (F.col("time") == 1)).alias("kept"), "text_sha256"
    )


def _several(found: DataFrame) -> DataFrame:
    """The digests that more than one content has."""
    return found.groupBy("digest").agg(F.count("*").alias("contents")).filter("contents > 1").select("digest")


def kept(df: DataFrame, id_col: str = "doc_id", text: str = "text", digest=sha256) -> DataFrame:
    """The rows of df that stay, with all their columns.

    Rows find the winner of their text by digest, length and id; where several contents have one digest, by content too.
    """
    names = [free_name(df, f"kept_{x}") for x in ("digest", "n", "id", "content")]
    d, n, i, c = names
    no_id = F.expr(f"{_LAST_ID}L")
    found = written(groups(df, id_col, text, digest).drop("content"))
    content = squashed(F.col(text))
    tagged = df.withColumn(d, digest(content)).withColumn(n, F.coalesce(F.char_length(text), F.lit(0)).cast("long")).withColumn(i, F.coalesce(F.col(id_col).cast("long"), no_id))
    win = lambda groups_, *more: _winners(groups_).select(F.col("digest").alias(d), F.col("keep_n").alias(n), F.coalesce("keep_id", no_id).alias(i), *more)
    shared = _several(found)
    if shared.isEmpty():
        return tagged.join(win(found), [d, n, i], "left_semi").dropDuplicates([d, n, i]).select(*df.columns)
    mark = shared.withColumnRenamed("digest", d)
    alone = tagged.join(mark, d, "left_anti").join(win(found), [d, n, i], "left_semi").dropDuplicates([d, n, i]).select(*df.columns)
    contents = groups(df.select(id_col, text), id_col, text, digest).join(shared, "digest", "left_semi")
    by_content = tagged.join(mark, d, "left_semi").withColumn(c, content).join(win(contents, F.col("content").alias(c)), [d, n, i, c], "left_semi")
    return alone.unionByName(by_content.dropDuplicates([d, n, i, c]).select(*df.columns))
