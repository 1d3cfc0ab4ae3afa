"""The public surface: what a package exposes after its re-exports.

exports (module, item, target_module, target_item, line): item ``*`` re-exports all of a
module; a row without target declares the item in the module itself. visible items of a
module are found in rounds from the root; of two ways to one exposed name the first by
(depth, line) stands, and each row carries its chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom import defaults as D
from codeloom.plans.tables import cut


def surface(exports: DataFrame, roots: DataFrame, max_depth: int = D.SURFACE_DEPTH) -> DataFrame:
    """(root, exposed, module, item, depth, via_glob, chain) for roots (module)."""
    e = exports.select("module", "item", "target_module", "target_item", "line")
    # a wish: which item of which module, under which exposed name; item * wishes all
    wish = cut(roots.select(F.col("module").alias("root"), "module", F.lit("*").alias("want"), F.lit(None).cast("string").alias("name"), F.lit(False).alias("via_glob"), F.expr("CAST(array() AS ARRAY<STRING>)").alias("chain"), F.lit(0).alias("line0")))
    found, seen = None, wish.select("root", "module", "want", "name")
    for depth in range(max_depth + 1):
        hit = wish.join(e, "module").filter((F.col("want") == "*") | (F.col("want") == F.col("item")) | (F.col("item") == "*"))
        own = hit.filter("target_module IS NULL AND item <> '*'").select("root", F.coalesce("name", "item").alias("exposed"), "module", "item", F.lit(depth).alias("depth"), "via_glob", "chain", "line")
        found = cut(own if found is None else found.unionByName(own))
        link = F.concat("chain", F.array(F.concat_ws(":", "module", F.col("line").cast("string"))))
        glob = F.col("item") == "*"
        onward = hit.filter("target_module IS NOT NULL").select(
            "root", F.col("target_module").alias("module"), F.when(glob, F.col("want")).otherwise(F.coalesce("target_item", "item")).alias("want"),
            F.when(glob, F.col("name")).otherwise(F.coalesce("name", "item")).alias("name"), (F.col("via_glob") | glob).alias("via_glob"), link.alias("chain"), F.col("line").alias("line0"),
        )
        key = ["root", "module", "want", "name"]
        once = onward.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("line0", F.array_join("chain", "/")))).filter("_n = 1").drop("_n")
        old = seen.withColumnRenamed("root", "r").withColumnRenamed("module", "m").withColumnRenamed("want", "w").withColumnRenamed("name", "n")
        wish = cut(once.join(old, (F.col("root") == F.col("r")) & (F.col("module") == F.col("m")) & (F.col("want") == F.col("w")) & F.col("name").eqNullSafe(F.col("n")), "left_anti"))
        if wish.isEmpty():
            break
        seen = cut(seen.unionByName(wish.select(*key)))
    best = F.row_number().over(Window.partitionBy("root", "exposed").orderBy("depth", "line", F.array_join("chain", "/"), "module"))
    return found.withColumn("_n", best).filter("_n = 1").drop("_n", "line")


def python_exports(decls: DataFrame, imports: DataFrame, dunder_all: DataFrame) -> DataFrame:
    """exports of Python modules (file as module): top declarations and relative imports, by __all__ (file, name) where a module has one, else without a leading underscore."""
    own = decls.filter(F.size("ord_path") == 1).select(F.col("file").alias("module"), F.col("name").alias("item"), F.lit(None).cast("string").alias("target_module"), F.lit(None).cast("string").alias("target_item"), F.col("start_line").alias("line"))
    folder = F.regexp_replace("file", r"/?[^/]*$", "")
    name = F.regexp_replace(F.substring_index("module", ":", 1), r"^\.+", "")
    place = F.concat_ws("/", F.when(folder != "", folder), F.when(name != "", F.replace(name, F.lit("."), F.lit("/"))))
    rel = imports.filter(F.col("module").startswith(".")).select(F.col("file").alias("module"), F.col("local").alias("item"), place.alias("_place"), F.substring_index("module", ":", -1).alias("target_item"), "line")
    files = decls.select(F.col("file").alias("target_module")).unionByName(imports.select(F.col("file").alias("target_module"))).distinct().withColumn("_place", F.regexp_replace("target_module", r"(/__init__)?\.py$", ""))
    moved = rel.join(files, "_place").select("module", "item", "target_module", "target_item", "line")
    both = own.unionByName(moved)
    listed = dunder_all.select(F.col("file").alias("module"), F.col("name").alias("item")).distinct()
    with_all = both.join(listed, ["module", "item"], "left_semi").select(*both.columns)
    return with_all.unionByName(both.join(listed.select("module").distinct(), "module", "left_anti").filter(~F.col("item").startswith("_")).select(*both.columns))


def public_only(decls: DataFrame) -> DataFrame:
    """The fallback for other languages: public declarations under their own names."""
    return decls.filter("visibility = 'public'").select(F.concat_ws("::", "file", F.array_join("trail", "::"), "name").alias("exposed"), "file", "kind", "signature")
