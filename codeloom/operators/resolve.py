"""Resolution of calls and imports by joins.

Tables: callables (qn, file, name, kind), types (path, line, name, bases), call_sites
(file, source_qn, name, receiver, line, kind), imports (file, local, module, line).
Edges: (src, dst, target_kind, confidence, kind, line, file, receiver, candidates).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom import defaults as D
from codeloom.functions.text import type_key
from codeloom.operators.graph import closure

SELF = ("self", "this", "Self", "cls", "super", "@self")


def qn_file(qn: Column) -> Column:
    return F.substring_index(qn, "::", 1)


def qn_name(qn: Column) -> Column:
    return F.substring_index(qn, "::", -1)


def qn_parent(qn: Column) -> Column:
    return F.regexp_replace(qn, r"::[^:]*$", "")


def symbol_table(callables: DataFrame) -> DataFrame:
    """(name, candidates): the qualified names that each bare name may mean, sorted."""
    return callables.groupBy("name").agg(F.array_sort(F.collect_set("qn")).alias("candidates"))


def resolve_target(names: DataFrame, target: str, file: str | None = None) -> DataFrame:
    """Rows (qn, ...) that a target means: a whole qualified name, a bare one, a dotted suffix, or path:symbol."""
    if file is None and ":" in target and "::" not in target:
        file, target = target.rsplit(":", 1)
    if file is None and "::" in target and ("/" in target or "." in target.split("::")[0]):
        return names.filter(F.col("qn") == target)
    segments = [s for s in target.replace("::", ".").split(".") if s]
    own = F.split("qn", "::")
    ends = F.slice(own, F.greatest(F.lit(1), F.size(own) - len(segments) + 1), F.lit(len(segments))) == F.array(*[F.lit(s) for s in segments])
    out = names.filter(ends & (F.size(own) > len(segments)))
    return out if file is None else out.filter((qn_file(F.col("qn")) == file) | qn_file(F.col("qn")).endswith("/" + file))


def suffixes(paths: DataFrame, path: str = "path") -> DataFrame:
    """(suffix, path): every suffix of whole components."""
    parts = F.split(path, "/")
    return paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))).alias("suffix"), F.col(path).alias("path"))


def shared_prefix(a: Column, b: Column) -> Column:
    """How many components two paths begin with in common."""
    pairs = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(pairs, False)
    return F.when(first == 0, F.size(pairs)).otherwise(first - 1)


def resolve_imports(imports: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, kind, line, local_name, raw_path) of imports that a file's path ends in, to the closest such file; and (file, spec) of the others.

    A module path becomes a suffix without its extension; of equally close files the first by name.
    """
    bare = files.select("path", F.regexp_replace(F.regexp_replace("path", r"\.[A-Za-z]+$", ""), r"/(__init__|mod|index)$", "").alias("_bare"))
    index = suffixes(bare, "_bare").select("suffix", F.col("path").alias("_bare")).join(bare, "_bare").select("suffix", "path")
    spec = F.regexp_replace(F.regexp_replace(F.regexp_replace("module", r"^(crate|self|super|\.|/)+(::)?", ""), r"::|\\|:", "/"), r"(?<![/.])\.(?!/)", "/")
    plain = F.regexp_replace(F.regexp_replace(spec, r"/(rs|py|ts|tsx|js|h|hpp|rb|go)$", ""), r"^[./]+", "")
    # the whole spec, else all but its last part, which may be a name in the module
    tries = F.array(F.struct(F.lit(0).alias("t"), plain.alias("suffix")), F.struct(F.lit(1).alias("t"), F.regexp_replace(plain, r"/[^/]*$", "").alias("suffix")))
    asked = imports.withColumn("_id", F.xxhash64("file", "module", "line", "local")).withColumn("_x", F.explode(tries)).select("*", "_x.*")
    met = asked.join(index, "suffix").filter(F.col("path") != F.col("file"))
    best = met.groupBy("_id").agg(F.min_by(F.struct("file", "path", "local", "module", "line"), F.struct("t", -shared_prefix(F.col("file"), F.col("path")), "path")).alias("b"))
    edges = best.select(F.col("b.file").alias("src"), F.col("b.path").alias("dst"), F.lit("import").alias("kind"), F.col("b.line").alias("line"), F.col("b.local").alias("local_name"), F.col("b.module").alias("raw_path"))
    outside = imports.withColumn("_id", F.xxhash64("file", "module", "line", "local")).join(best.select("_id"), "_id", "left_anti").select("file", F.col("module").alias("spec")).distinct()
    return edges, outside


def resolve_calls(sites: DataFrame, callables: DataFrame, types: DataFrame, imports: DataFrame, dep_edges: DataFrame) -> DataFrame:
    """Edges of call sites, by the first pass that binds them.

    A: a callable of the caller's own file, by receiver (self-like: in the caller's scope; a type's name: its method;
    none: any), the one with the longest scope in common. A': the name's or receiver's import, whose file has the name.
    B: the only callable of that name anywhere, for calls without receiver. C: candidates in files that the caller's file
    reaches by imports: one is inferred, several are ambiguous over those, none over all. What no callable is named for is
    external with an import, else bare.
    """
    s = sites.withColumn("_id", F.xxhash64("file", "source_qn", "name", "receiver", "line", "kind")).dropDuplicates(["_id"])
    c = callables.select(F.col("qn").alias("_qn"), F.col("file").alias("_file"), F.col("name").alias("_name"), qn_parent(F.col("qn")).alias("_parent"))
    shared = F.size(F.filter(F.zip_with(F.split("source_qn", "::"), F.split("_qn", "::"), lambda a, b: a == b), lambda x: x))
    selfish, plain = F.col("receiver").isin(*SELF), F.col("receiver").isNull()
    of_type = qn_name(F.col("_parent")) == type_key(F.col("receiver"))
    fits = plain | (selfish & (F.col("_parent") != F.col("_file"))) | of_type
    same = s.join(c, (s["file"] == c["_file"]) & (s["name"] == c["_name"])).filter(fits).groupBy("_id").agg(F.max_by("_qn", F.struct(shared, F.length("_qn") * -1)).alias("dst"))
    a = same.select("_id", "dst", F.lit("exact").alias("confidence"), F.expr("CAST(NULL AS ARRAY<STRING>)").alias("candidates"))
    rest = s.join(a, "_id", "left_anti")
    named = imports.join(dep_edges.select(F.col("src").alias("file"), F.col("local_name").alias("local"), F.col("dst").alias("_to")), ["file", "local"]).select(F.col("file").alias("_from"), "local", "_to").distinct()
    key = F.coalesce(F.regexp_extract("receiver", r"^[A-Za-z_$][\w$]*", 0), F.col("name"))
    via = rest.withColumn("_key", key).join(named, (F.col("file") == F.col("_from")) & (F.col("_key") == F.col("local"))).join(c, (F.col("_to") == F.col("_file")) & (F.col("name") == F.col("_name")), "left")
    bound = via.groupBy("_id").agg(F.min("_qn").alias("q"), F.min(F.concat_ws("::", "_to", "name")).alias("made"))
    b1 = bound.select("_id", F.coalesce("q", "made").alias("dst"), F.when(F.col("q").isNotNull(), "exact").otherwise("inferred").alias("confidence"), F.expr("CAST(NULL AS ARRAY<STRING>)").alias("candidates"))
    rest = rest.join(b1, "_id", "left_anti")
    table = symbol_table(callables)
    open_ = rest.join(table, "name")
    only = open_.filter((F.size("candidates") == 1) & plain).select("_id", F.get("candidates", F.lit(0)).alias("dst"), F.lit("exact").alias("confidence"), F.expr("CAST(NULL AS ARRAY<STRING>)").alias("candidates"))
    many = open_.join(only, "_id", "left_anti")
    reach = closure(dep_edges.select("src", "dst"), many.select(F.col("file").alias("node")).distinct(), D.CLOSURE_DEPTH).select(F.col("origin").alias("file"), F.col("node").alias("_near"))
    near = many.select("_id", "file", F.explode("candidates").alias("q")).withColumn("_near", qn_file(F.col("q"))).join(reach, ["file", "_near"], "left_semi").groupBy("_id").agg(F.array_sort(F.collect_set("q")).alias("near"))
    judged = many.join(near, "_id", "left")
    left = F.coalesce("near", F.expr("CAST(array() AS ARRAY<STRING>)"))
    ambiguous = F.when(F.size(left) == 1, F.expr("CAST(NULL AS ARRAY<STRING>)")).when(F.size(left) > 1, left).otherwise(F.col("candidates"))
    c1 = judged.select("_id", F.when(F.size(left) == 1, F.get(left, F.lit(0))).alias("dst"), F.when(F.size(left) == 1, "inferred").otherwise("ambiguous").alias("confidence"), ambiguous.alias("candidates"))
    done = a.unionByName(b1).unionByName(only).unionByName(c1)
    joined = s.join(done, "_id", "left")
    outside = named.select(F.col("_from").alias("file"), F.col("local").alias("name")).distinct().withColumn("_imported", F.lit(True))
    known = imports.select("file", F.col("local").alias("name")).distinct().withColumn("_spec", F.lit(True)).join(outside, ["file", "name"], "left")
    tagged = joined.join(known, ["file", "name"], "left")
    kind = F.when(F.col("dst").isNotNull(), "resolved").when(F.col("_spec"), "external").otherwise("bare")
    return tagged.select(
        F.col("source_qn").alias("src"), F.coalesce("dst", "name").alias("dst"), kind.alias("target_kind"), F.coalesce("confidence", F.lit("ambiguous")).alias("confidence"),
        "kind", "line", "file", "receiver", "candidates",
    )


def resolve_scoped(sites: DataFrame, scopes: DataFrame) -> DataFrame:
    """(site columns, scope): of a receiver path written without its start, the scope reached from the innermost enclosing one that has it. scopes: scope."""
    parts = F.split("source_qn", "::")
    tries = sites.withColumn("_n", F.explode(F.sequence(F.lit(0), F.size(parts)))).withColumn("scope", F.concat_ws("::", F.array_join(F.slice(parts, F.lit(1), F.col("_n")), "::"), "receiver"))
    tries = tries.withColumn("scope", F.regexp_replace("scope", "^::", ""))
    met = tries.join(scopes.select("scope").distinct(), "scope")
    best = met.groupBy(*sites.columns).agg(F.max_by("scope", "_n").alias("scope"))
    return sites.join(best, sites.columns, "left")


def unattributed(edges: DataFrame, name: str, types: DataFrame) -> DataFrame:
    """Sites that name a target but weren't bound to it, once for each (file, line, src), those of the fewest candidates first; receivers that name another type are left out."""
    names = types.select(type_key(F.col("name")).alias("_t")).distinct()
    open_ = edges.filter((F.col("target_kind") == "bare") & (qn_name(F.col("dst")) == name))
    other = open_.withColumn("_t", type_key(F.coalesce("receiver", F.lit("")))).join(names.filter(F.col("_t") != name), "_t", "left_anti").drop("_t")
    breadth = F.coalesce(F.size("candidates"), F.lit(0))
    best = F.row_number().over(Window.partitionBy("file", "line", "src").orderBy(breadth, "dst")) == 1
    return other.withColumn("_b", best).filter("_b").drop("_b").withColumn("breadth", breadth).orderBy("breadth", "file", "line", "src")


def type_usages(edges: DataFrame, types: DataFrame, name: str) -> DataFrame:
    """(file, line, source, how): implementors of a type, places that construct it, and calls on it; each place once."""
    key = type_key(F.lit(name))
    made = edges.filter((F.col("kind") == "construct") & (type_key(F.col("dst")) == key)).select("file", "line", F.col("src").alias("source"), F.lit("construct").alias("how"))
    on = edges.filter(F.col("receiver").isNotNull() & (type_key(F.col("receiver")) == key)).select("file", "line", F.col("src").alias("source"), F.lit("receiver").alias("how"))
    impl = types.filter(F.exists("bases", lambda b: type_key(b) == key)).select(F.col("path").alias("file"), "line", F.concat_ws("::", "path", "name").alias("source"), F.lit("implement").alias("how"))
    return impl.unionByName(made).unionByName(on).groupBy("file", "line", "source").agg(F.min("how").alias("how"))


def methods_of(callables: DataFrame, type_qn: str) -> DataFrame:
    return callables.filter(qn_parent(F.col("qn")) == type_qn)


def name_breadth(callables: DataFrame) -> DataFrame:
    """(name, declarers, listed): how many declare a name; up to three are listed."""
    return symbol_table(callables).select("name", F.size("candidates").alias("declarers"), F.when(F.size("candidates") <= 3, F.col("candidates")).alias("listed"))


def shown(edges: DataFrame, hide_ambiguous: bool = False, hide_external: bool = False) -> DataFrame:
    out = edges
    if hide_ambiguous:
        out = out.filter("confidence <> 'ambiguous'")
    return out.filter("target_kind <> 'external'") if hide_external else out
