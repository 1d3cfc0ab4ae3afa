"""Reports: impact of a change, context within a budget, and the greedy packing below them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom import defaults as D
from codeloom.functions.text import is_test_path
from codeloom.operators import graph as G
from codeloom.operators import resolve as R


def impact(edges: DataFrame, dep_edges: DataFrame, targets: DataFrame, types: DataFrame | None = None, depth: int = D.IMPACT_DEPTH, mode: str = "all", keep: Column | None = None) -> DataFrame:
    """(section, node, depth): calls, imports, called_by, imported_by, transitive and tests of targets (node). mode: all, deps, dependents, tests.

    Implementors and constructors of a type stand at depth 1; constructors of implementors, which start the deeper walk, at 2.
    """
    spark, files = edges.sparkSession, targets.select(R.qn_file(F.col("node")).alias("node")).distinct()
    calls = G.callees(edges, targets, 1).select(F.lit("calls").alias("section"), F.col("target").alias("node"), "depth")
    imports = G.bfs(dep_edges, files, 1).select(F.lit("imports").alias("section"), "node", "depth")
    back = G.callers(edges, targets, depth, keep)
    if types is not None:
        names = targets.select(R.qn_name(F.col("node")).alias("n")).distinct()
        impl = types.select(F.concat_ws("::", "path", "name").alias("node"), F.explode("bases").alias("b")).join(names, R.type_key(F.col("b")) == F.col("n")).select("node").distinct()
        made = edges.filter("kind = 'construct'").select(F.col("src").alias("node"), R.qn_name(F.col("dst")).alias("n"))
        direct = impl.unionByName(made.join(names, "n").select("node")).distinct().withColumn("base", F.lit(1))
        second = made.join(impl.select(R.qn_name(F.col("node")).alias("n")).distinct(), "n").select("node", F.lit(2).alias("base"))
        seeds = direct.unionByName(second).groupBy("node").agg(F.min("base").alias("base"))
        deeper = G.bfs(G.reversed_edges(edges.filter("target_kind = 'resolved'").select("src", "dst")), seeds, depth)
        both = back.unionByName(seeds.select("node", F.col("base").cast("int").alias("depth")).filter(F.col("depth") <= depth)).unionByName(deeper)
        back = both.groupBy("node").agg(F.min("depth").alias("depth")).join(targets.select("node"), "node", "left_anti")
    called = back.filter("depth = 1").select(F.lit("called_by").alias("section"), "node", "depth")
    further = back.filter("depth > 1").select(F.lit("transitive").alias("section"), "node", "depth")
    imported = G.bfs(G.reversed_edges(dep_edges.select("src", "dst")), files, 1).select(F.lit("imported_by").alias("section"), "node", "depth")
    tests = back.filter(is_test_path(R.qn_file(F.col("node")))).select(F.lit("tests").alias("section"), "node", "depth")
    wanted = {"all": (calls, imports, called, imported, further, tests), "deps": (calls, imports), "dependents": (called, imported, further), "tests": (tests,)}[mode]
    out = spark.createDataFrame([], "section string, node string, depth int")
    for part in wanted:
        out = out.unionByName(part.select("section", "node", F.col("depth").cast("int").alias("depth")))
    return out


def capped(rows: DataFrame, limit: int = D.LIMIT, group: str = "section") -> DataFrame:
    """Rows up to limit of each group by (depth, node), with the group's total of all rows."""
    w = Window.partitionBy(group)
    numbered = rows.withColumn("total", F.count("*").over(w)).withColumn("_n", F.row_number().over(w.orderBy("depth", "node")))
    return numbered.filter(F.col("_n") <= limit).drop("_n")


def pack(items: DataFrame, budget: int = D.BUDGET_TOKENS, key: str | None = None) -> DataFrame:
    """Items (qn, bucket, body, signature) taken in order of (bucket, qn) while they fit: the body, else the signature, else neither; smaller ones later may still fit.

    An item counts ceil(bytes / 4); its first bucket is the one that counts, whether it fitted there or not. With key, a budget for each key.
    """
    group = [key] if key else []
    first = items.withColumn("_n", F.row_number().over(Window.partitionBy(*group, "qn").orderBy("bucket"))).filter("_n = 1").drop("_n")
    cost = lambda c: F.ceil(F.coalesce(F.octet_length(c), F.lit(0)) / D.BYTES_PER_TOKEN).cast("long")
    listed = first.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("bucket", "qn", cost("body").alias("b"), F.when(F.col("signature").isNotNull(), cost("signature")).alias("s")))).alias("all"))
    start = F.expr("named_struct('used', CAST(0 AS BIGINT), 'out', CAST(array() AS ARRAY<STRUCT<qn: STRING, form: STRING, cost: BIGINT, used: BIGINT>>))")

    def step(acc: Column, x: Column) -> Column:
        form = F.when((x["b"] > 0) & (acc["used"] + x["b"] <= budget), "body").when(x["s"].isNotNull() & (acc["used"] + x["s"] <= budget), "signature")
        price = F.when(form == "body", x["b"]).when(form == "signature", x["s"]).otherwise(F.lit(0).cast("long"))
        row = F.struct(x["qn"].alias("qn"), form.alias("form"), price.alias("cost"), (acc["used"] + price).alias("used"))
        return F.struct((acc["used"] + price).alias("used"), F.when(form.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(row))).alias("out"))

    return listed.select(*group, F.posexplode(F.aggregate("all", start, step, lambda a: a["out"])).alias("place", "x")).select(*group, "place", "x.*")


def context_pack(edges: DataFrame, sources: DataFrame, targets: DataFrame, budget: int = D.BUDGET_TOKENS) -> DataFrame:
    """The target, what it calls, its callers' signatures, then callees and callers two away, within the budget. sources: qn, body, signature; ambiguous edges aren't followed."""
    sure = edges.filter("confidence <> 'ambiguous' AND target_kind = 'resolved'")
    out = G.callees(sure, targets, 2, hide_external=True).select(F.col("target").alias("qn"), "depth")
    back = G.callers(sure, targets, 2).select(F.col("node").alias("qn"), "depth")
    near = back.filter("depth = 1").orderBy("qn").limit(50)
    rows = (
        targets.select(F.col("node").alias("qn"), F.lit(0).alias("bucket"), F.lit(True).alias("whole"))
        .unionByName(out.filter("depth = 1").select("qn", F.lit(1).alias("bucket"), F.lit(True).alias("whole"))).unionByName(near.select("qn", F.lit(2).alias("bucket"), F.lit(False).alias("whole")))
        .unionByName(out.filter("depth = 2").select("qn", F.lit(3).alias("bucket"), F.lit(False).alias("whole"))).unionByName(back.filter("depth = 2").select("qn", F.lit(4).alias("bucket"), F.lit(False).alias("whole")))
    )
    return pack(rows.join(sources, "qn").select("qn", "bucket", F.when(F.col("whole"), F.col("body")).alias("body"), "signature"), budget)


def source_of(decls: DataFrame, files: DataFrame, names: DataFrame) -> DataFrame:
    """(qn, body, signature): the lines of declarations (qn, file, start_line, end_line); the signature is the first of them."""
    lines = F.split("text", "\n")
    return decls.join(names, "qn", "left_semi").join(files.select(F.col("path").alias("file"), "text"), "file").select("qn", F.array_join(F.slice(lines, F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n").alias("body"), F.trim(F.get(lines, F.col("start_line") - 1)).alias("signature"))


def cap_map(decls: DataFrame, limit: int = 64_000) -> DataFrame:
    """Declarations of each file that fit limit bytes, types before callables before the rest, then in order; one too wide is passed over, and what stands under a dropped one falls with it."""
    rank = F.when(F.size("ord_path") == 1, 0).otherwise(1) * 3 + F.when(F.col("kind").isin("class", "struct", "interface", "trait", "enum"), 0).when(F.col("kind").isin("function", "method"), 1).otherwise(2)
    listed = decls.groupBy("file").agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "ord_path", (F.octet_length("signature") + 1).cast("long").alias("b")))).alias("all"))
    start = F.expr("named_struct('used', CAST(0 AS BIGINT), 'out', CAST(array() AS ARRAY<ARRAY<INT>>))")

    def step(acc: Column, x: Column) -> Column:
        parent = F.slice(x["ord_path"], F.lit(1), F.size(x["ord_path"]) - 1)
        fits = (acc["used"] + x["b"] <= limit) & ((F.size(parent) == 0) | F.array_contains(acc["out"], parent))
        return F.struct((acc["used"] + F.when(fits, x["b"]).otherwise(0)).alias("used"), F.when(fits, F.concat(acc["out"], F.array(x["ord_path"]))).otherwise(acc["out"]).alias("out"))

    kept = listed.select("file", F.explode(F.aggregate("all", start, step, lambda a: a["out"])).alias("ord_path"))
    return decls.join(kept, ["file", "ord_path"], "left_semi")
