"""Chunking: splitting texts and packing the pieces in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom import defaults as D
from codeloom.functions import text as T

#: Possessive, so that long runs of blank lines need no stack.
PARAGRAPH = r"(?:\r?\n[ \t]*+){2,}+"


def pieces(text: Column, end: str = PARAGRAPH) -> Column:
    """The pieces of a text up to and with each match of a pattern; joined they are the text. None is empty but the last may be."""
    nul, own, mark = F.lit("\x00"), F.lit("\x00\x01"), "\x00\x02"  # a NUL of the text is never taken for a mark
    marks = F.split(F.regexp_replace(F.replace(text, nul, own), f"({end})", f"$1{mark}"), mark)
    return F.transform(marks, lambda piece: F.replace(piece, own, nul))


def paragraphs(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, n, start, end, content): pieces up to and with each run of blank lines; offsets in bytes. Joined they are the text."""
    each = df.select(key, F.posexplode(pieces(F.col(text))).alias("n", "content")).filter("content <> ''")
    w = Window.partitionBy(key).orderBy("n")
    end = F.sum(F.octet_length("content")).over(w)
    return each.select(key, "n", (end - F.octet_length("content")).alias("start"), end.alias("end"), "content")


def fold(sizes: Column, limit: int) -> Column:
    """For an array of sizes the number of the chunk each falls into: a chunk takes the next piece while its sum stays within the limit."""
    start = F.expr("named_struct('at', CAST(0 AS BIGINT), 'sum', CAST(0 AS BIGINT), 'out', CAST(array() AS ARRAY<BIGINT>))")

    def step(acc: Column, size: Column) -> Column:
        fits = (acc["sum"] + size <= limit) | (F.size(acc["out"]) == 0)
        at = F.when(fits, acc["at"]).otherwise(acc["at"] + 1)
        return F.struct(at.alias("at"), F.when(fits, acc["sum"] + size).otherwise(size).alias("sum"), F.concat(acc["out"], F.array(at)).alias("out"))

    return F.aggregate(F.transform(sizes, lambda s: s.cast("long")), start, step, lambda acc: acc["out"])


def pack(pieces: DataFrame, key: str, order: str = "n", content: str = "content", limit: int = D.CHUNK_BYTES) -> DataFrame:
    """(key, chunk, content, n_bytes): pieces packed in order into chunks of limit bytes at most; a larger piece stays whole; blank chunks go."""
    size = F.octet_length(content)
    parts = pieces.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, content, size.alias("_size")))).alias("_p"))
    zipped = parts.select(key, F.explode(F.zip_with("_p", fold(F.transform("_p", lambda p: p["_size"]), limit), lambda p, c: F.struct(p[order].alias("o"), p[content].alias("t"), c.alias("chunk")))).alias("_z"))
    joined = zipped.groupBy(key, F.col("_z.chunk").alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_z.o", "_z.t"))), lambda x: x["t"]), "").alias("content"))
    return joined.filter(F.trim("content") != "").withColumn("n_bytes", F.octet_length("content"))


def headings(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, level, title, crumbs): Markdown headings outside fences and front matter, with their ancestors' titles."""
    lines = df.select(key, F.posexplode(F.split(text, "\r?\n")).alias("i", "s")).withColumn("line", F.col("i") + 1)
    w = Window.partitionBy(key).orderBy("line")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    front = F.first("s").over(w.rowsBetween(Window.unboundedPreceding, 0)).rlike(r"^(﻿)?---\s*$")
    rule = (F.col("s").rlike(r"^---\s*$") | F.col("s").rlike(r"^﻿---\s*$")).cast("int")
    marked = lines.withColumn("in_front", front & (F.coalesce(F.sum(rule).over(before), F.lit(0)) < 2)).withColumn("fence", F.coalesce(F.sum(F.col("s").rlike(r"^ {0,3}(```|~~~)").cast("int")).over(before), F.lit(0)) % 2 == 1)
    plain = ~F.col("in_front") & ~F.col("fence")
    level = F.length(F.regexp_extract("s", r"^ {0,3}(#{1,6})(?:[ \t]|$)", 1))
    under = F.lead("s").over(w)
    setext = F.when(under.rlike(r"^ {0,3}=+\s*$"), 1).when(under.rlike(r"^ {0,3}-+\s*$"), 2).otherwise(0)
    found = marked.withColumn("level", F.when(~plain, 0).when(level > 0, level).when((F.trim("s") != "") & ~F.col("s").rlike(r"^\s*(```|~~~|[-*>|])"), setext).otherwise(0)).filter("level > 0")
    title = F.trim(F.regexp_replace(F.regexp_replace("s", r"^ {0,3}#{1,6}", ""), r"\s#+\s*$", ""))
    named = found.select(key, "line", "level", title.alias("title"))
    # an ancestor of level l is the last heading of that level since the last one above it
    spots = [F.last(F.when(F.col("level") <= l, F.struct("level", "title")), ignorenulls=True).over(before) for l in range(1, 6)]
    crumbs = F.array_compact(F.array(*[F.when((F.lit(l) < F.col("level")) & (spots[l - 1]["level"] == l), spots[l - 1]["title"]) for l in range(1, 6)]))
    return named.withColumn("crumbs", crumbs)


def sections(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, end_line, title): what stands from a heading to the next."""
    heads = headings(df, key, text)
    last = df.select(key, F.size(F.split(text, "\n")).alias("_lines"))
    w = Window.partitionBy(key).orderBy("line")
    return heads.join(last, key).select(key, "line", F.coalesce(F.lead("line").over(w) - 1, F.col("_lines")).alias("end_line"), "title")


#: Widths of the cells on which ranges of bytes meet, by level.
CELLS = [64 * 8**n for n in range(19)]


def _level(start: Column, end: Column) -> Column:
    """The first level whose cells are as wide as a range, so that it touches two of them at most."""
    return F.size(F.filter(F.array(*[F.lit(w) for w in CELLS]), lambda w: w < end - start))


def _on_cells(df: DataFrame, start: Column, end: Column, at: Column) -> DataFrame:
    """df once for each cell (_level, _cell) of the given levels that a range touches."""
    cell = lambda byte, n: F.floor(byte / F.element_at(F.array(*[F.lit(w) for w in CELLS]), n + 1))
    touched = lambda n: F.transform(F.sequence(cell(start, n), cell(F.greatest(start, end - 1), n)), lambda c: F.struct(n.alias("_level"), c.alias("_cell")))
    return df.withColumn("_at", F.explode(F.flatten(F.transform(at, touched)))).select(*df.columns, "_at.*")


def near_ranges(c: DataFrame, m: DataFrame, file: str) -> DataFrame:
    """Pairs of ranges _s to _e and _a to _z of one file that touch a common cell: all that overlap and few others; a pair may come out twice.

    A pair meets on the level of its longer range. That range goes to its own level alone, the shorter one to each level above
    its own that occurs, so a file's length doesn't multiply the pairs.
    """
    own_c, own_m = _level(F.col("_s"), F.col("_e")), _level(F.col("_a"), F.col("_z"))
    occurring = lambda df, own: F.array(*[F.lit(r[0]) for r in df.select(own).distinct().collect()]).cast("array<int>")  # noqa: E731  19 at most
    longer_m, longer_c = F.filter(occurring(m, own_m), lambda n: n > own_c), F.filter(occurring(c, own_c), lambda n: n >= own_m)
    at_m = _on_cells(c, F.col("_s"), F.col("_e"), longer_m).join(_on_cells(m, F.col("_a"), F.col("_z"), F.array(own_m)), [file, "_level", "_cell"])
    at_c = _on_cells(c, F.col("_s"), F.col("_e"), F.array(own_c)).join(_on_cells(m, F.col("_a"), F.col("_z"), longer_c), [file, "_level", "_cell"])
    return at_m.unionByName(at_c)


def breadcrumbs(chunks: DataFrame, members: DataFrame, file: str = "file_path") -> DataFrame:
    """chunks with the trail of the smallest member that encloses them, else of that which overlaps most of them, by thousandths; ties to the earlier."""
    c = chunks.select("chunk_id", file, F.col("start_byte").alias("_s"), F.col("end_byte").alias("_e"))
    m = members.select(F.col("file").alias(file), F.col("start_byte").alias("_a"), F.col("end_byte").alias("_z"), "trail")
    met = near_ranges(c, m, file).filter((F.col("_a") < F.col("_e")) & (F.col("_z") > F.col("_s")))
    inside = (F.col("_a") <= F.col("_s")) & (F.col("_z") >= F.col("_e"))
    share = F.floor((F.least("_z", "_e") - F.greatest("_a", "_s")) * 1000 / (F.col("_e") - F.col("_s")))
    best = met.groupBy("chunk_id").agg(F.min_by("trail", F.struct(F.when(inside, 0).otherwise(1), F.when(inside, F.col("_z") - F.col("_a")).otherwise(-share), F.col("_a"))).alias("breadcrumb"))
    return chunks.drop("breadcrumb").join(best, "chunk_id", "left")


def lines_of(spots: DataFrame, df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """spots (key, byte) with the line, from 1, that each byte offset lies in: a range join with the lines' own offsets."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("_i", "_t"))
    end = F.sum(F.octet_length("_t") + 1).over(Window.partitionBy(key).orderBy("_i"))
    spans = lines.select(key, (F.col("_i") + 1).alias("line"), (end - F.octet_length("_t") - 1).alias("_from"), end.alias("_to"))
    return spots.join(spans, key).filter((F.col("byte") >= F.col("_from")) & (F.col("byte") < F.col("_to"))).select(*spots.columns, "line")


def outline(declarations: DataFrame, limit: int = D.OUTLINE_BYTES) -> DataFrame:
    """(file, chunk, content): the signatures of each file in order, a line each under its path, in pieces of limit bytes."""
    lines = declarations.select("file", F.col("ord_path").alias("n"), F.concat(F.repeat(F.lit("  "), F.size("ord_path") - 1), F.substring("signature", 1, 200), F.lit("\n")).alias("content"))
    return pack(lines, "file", limit=limit).select("file", "chunk", F.concat("file", F.lit("\n"), "content").alias("content"))


def bm25_text(path: Column, breadcrumb: Column, content: Column) -> Column:
    """What the lexical index reads of a chunk: its content, the file's stem twice, its last three folders, its trail."""
    stem, parts = T.stem(path), F.split(path, "/")
    folders = F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 3), F.least(F.lit(3), F.size(parts) - 1))
    return F.concat_ws(" ", content, stem, stem, F.array_join(folders, " "), breadcrumb)


def levels(chunks: DataFrame, regions: DataFrame, file: str = "file_path") -> DataFrame:
    """chunks with kind enclosing where they hold an oversized region, and the region's own pieces as parts."""
    c, r = chunks.alias("c"), regions.select(F.col("file").alias("_f"), F.col("start_byte").alias("_s"), F.col("end_byte").alias("_e"))
    holding = chunks.join(r, (F.col(file) == F.col("_f")) & (F.col("start_byte") <= F.col("_s")) & (F.col("end_byte") >= F.col("_e")), "left_semi").select("chunk_id", F.lit("enclosing").alias("_k"))
    return c.join(holding, "chunk_id", "left").withColumn("kind", F.coalesce("_k", "kind")).drop("_k")
