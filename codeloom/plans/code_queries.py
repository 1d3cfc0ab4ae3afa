"""Symbol, aggregate, squeeze and report queries over names in the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codeloom.catalog import query
from codeloom.functions import text as T
from codeloom.operators import code, reports, resolve, squeeze
from codeloom.plans.file_queries import paths
from codeloom.plans.graph_queries import RING, ring
from codeloom.plans.tables import table

CALLABLES = "callables AS (SELECT 'f' || p_size || '.py::' || replace(p_name, ' ', '::') || p_partkey % 9 AS qn, 'f' || p_size || '.py' AS file, split_part(p_name, ' ', 2) || p_partkey % 9 AS name FROM part)"


def callables(spark, sf_dir):
    n, digit = F.concat(F.lit("f"), F.col("p_size").cast("string"), F.lit(".py")), (F.col("p_partkey") % 9).cast("string")
    return table(spark, sf_dir, "part").select(F.concat(n, F.lit("::"), F.replace("p_name", F.lit(" "), F.lit("::")), digit).alias("qn"), n.alias("file"), F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), digit).alias("name"), F.lit("function").alias("kind"))


@query("symbol_table", f"WITH {CALLABLES} SELECT name, array_to_string(list_sort(list(DISTINCT qn)), ',') AS candidates FROM callables GROUP BY name")
def symbol_table(spark, sf_dir):
    return resolve.symbol_table(callables(spark, sf_dir)).select("name", F.array_join("candidates", ",").alias("candidates"))


@query("name_breadth", f"WITH {CALLABLES} SELECT name, count(DISTINCT qn) AS declarers FROM callables GROUP BY name")
def name_breadth(spark, sf_dir):
    return resolve.name_breadth(callables(spark, sf_dir)).select("name", F.col("declarers").cast("long").alias("declarers"))


@query("resolve_target", f"WITH {CALLABLES} SELECT DISTINCT qn FROM callables WHERE qn LIKE '%::red::widget3'")
def resolve_target(spark, sf_dir):
    return resolve.resolve_target(callables(spark, sf_dir), "red.widget3").select("qn").distinct()


@query("symbol_suffix_match", f"WITH {CALLABLES} SELECT s AS symbol, qn, count(*) AS n FROM callables, (VALUES ('red.widget1'), ('ring2'), ('nothing')) v(s) WHERE ends_with(replace(qn, '::', '.'), '.' || s) GROUP BY 1, 2")
def symbol_suffix_match(spark, sf_dir):
    rows = callables(spark, sf_dir)
    parts = F.split("qn", "::")
    decls = rows.withColumn("trail", F.slice(parts, F.lit(1), F.size(parts) - 1)).withColumn("ord_path", F.array(F.monotonically_increasing_id()))
    return code.find_symbols(decls, ["red.widget1", "ring2", "nothing"]).groupBy("symbol", "qn").agg(F.count("*").alias("n"))


@query("path_suffix_closest", """WITH f AS (SELECT DISTINCT n_regionkey || '/' || n_nationkey % 3 || '/m' || n_nationkey % 4 || '.py' AS path FROM nation), i AS (SELECT s_suppkey AS id, s_nationkey % 5 || '/' || s_nationkey % 3 || '/x.py' AS file, 'm' || s_suppkey % 4 AS module FROM supplier),
r AS (SELECT id, file, path, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN split_part(file, '/', 1) <> split_part(path, '/', 1) THEN 0 WHEN split_part(file, '/', 2) <> split_part(path, '/', 2) THEN 1 ELSE 2 END DESC, path) AS p FROM i JOIN f ON ends_with(path, '/' || module || '.py')) SELECT id AS line, path AS dst FROM r WHERE p = 1""")
def path_suffix_closest(spark, sf_dir):
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    files = nation.select(F.concat_ws("", F.col("n_regionkey"), F.lit("/"), F.col("n_nationkey") % 3, F.lit("/m"), F.col("n_nationkey") % 4, F.lit(".py")).alias("path")).distinct()
    imports = supplier.select(F.concat_ws("", F.col("s_nationkey") % 5, F.lit("/"), F.col("s_nationkey") % 3, F.lit("/x.py")).alias("file"), F.lit("m").alias("local"), F.concat(F.lit("m"), (F.col("s_suppkey") % 4).cast("string")).alias("module"), F.col("s_suppkey").alias("line"))
    edges, _ = resolve.resolve_imports(imports, files)
    return edges.select("line", "dst")


@query("declaration_counts", "SELECT p_brand AS file, count(*) FILTER (p_type IN ('ECONOMY', 'PROMO')) AS types, count(*) AS total FROM part GROUP BY p_brand")
def declaration_counts(spark, sf_dir):
    kind = F.when(F.col("p_type").isin("ECONOMY", "PROMO"), "class").otherwise("other")
    return code.counts(table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), kind.alias("kind"))).select("file", "types", "total")


@query("size_labels", "SELECT p_partkey AS id, CASE WHEN p_partkey <= 50 THEN 'tiny' WHEN p_partkey <= 200 THEN 'small' WHEN p_partkey <= 600 THEN 'medium' WHEN p_partkey <= 1500 THEN 'large' ELSE 'huge' END AS label FROM part")
def size_labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), code.size_label(F.col("p_partkey")).alias("label"))


def siblings(spark, sf_dir):
    """Parts of a brand as members of one class, in order of their keys."""
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).cast("int")
    members = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.array(F.lit(0), place).alias("ord_path"), F.lit("method").alias("kind"), F.substring_index("p_type", " ", 1).alias("name"), F.col("p_name").alias("signature"), F.when(F.col("p_size") % 4 == 0, "private").otherwise("public").alias("visibility"))
    heads = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file")).distinct().select("file", F.array(F.lit(0)).alias("ord_path"), F.lit("class").alias("kind"), F.col("file").alias("name"), F.col("file").alias("signature"), F.lit("public").alias("visibility"))
    return heads.unionByName(members)


@query("overload_collapse", """WITH o AS (SELECT p_brand AS file, p_partkey, p_type AS name, lag(p_type) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS l FROM part), r AS (SELECT *, sum(CASE WHEN l = name THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY p_partkey) AS run FROM o)
SELECT file, name, min(p_partkey) AS id, count(*) AS times FROM r GROUP BY file, name, run""")
def overload_collapse(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).cast("int")
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.array(place).alias("ord_path"), F.lit("method").alias("kind"), F.col("p_type").alias("name"), F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("signature"))
    return code.collapse_overloads(rows).select("file", "name", F.col("signature").cast("long").alias("id"), "times")


@query("member_cap", "SELECT p_brand AS file, count(*) - 20 AS dropped FROM part GROUP BY p_brand HAVING count(*) > 20")
def member_cap(spark, sf_dir):
    return code.cap_members(siblings(spark, sf_dir), 20)[1].select("file", "dropped")


@query("visibility_projection", "SELECT p_brand AS file, count(*) + 1 AS n FROM part WHERE p_size % 4 <> 0 GROUP BY p_brand")
def visibility_projection(spark, sf_dir):
    return code.visible(siblings(spark, sf_dir), no_private=True).groupBy("file").agg(F.count("*").alias("n"))


@query("base_index", "SELECT n_name AS base, array_to_string(list_sort(list(DISTINCT s_name)), ',') AS implementors FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name")
def base_index(spark, sf_dir):
    types = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("name"), F.array(F.concat(F.lit("a::b."), "n_name", F.lit("<T>"))).alias("bases"))
    return code.base_index(types).select("base", F.array_join("implementors", ",").alias("implementors"))


@query("type_keys", "SELECT s_suppkey AS id, s_name AS name FROM supplier")
def type_keys(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), T.type_key(F.concat(F.lit("x::y."), "s_name", F.lit("<A, B>"))).alias("name"))


_LOG = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' [' || event_type || '] user=' || user_id || ' value=' || CAST(CAST(value * 100 AS BIGINT) AS VARCHAR)"


def log_lines(spark, sf_dir):
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" ["), "event_type", F.lit("] user="), F.col("user_id").cast("string"), F.lit(" value="), F.round(F.col("value") * 100).cast("long").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", line.alias("line"))


def logs(spark, sf_dir):
    """Events as one log for each user."""
    lines = log_lines(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "line"))).alias("x"))
    return lines.select("user_id", F.array_join(F.transform("x", lambda e: e["line"]), "\n").alias("text"))


@query("squeeze_common_minute", "WITH m AS (SELECT user_id, strftime(ts, '%Y-%m-%dT%H:%M:') AS minute, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, minute) AS p FROM m) SELECT user_id, minute FROM r WHERE p = 1")
def squeeze_common_minute(spark, sf_dir):
    return squeeze.common_minute(logs(spark, sf_dir), "user_id")


@query("squeeze_tag_dictionary", "WITH w AS (SELECT user_id, '[' || event_type || ']' AS word, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1) SELECT user_id, word, n, '#' || row_number() OVER (PARTITION BY user_id ORDER BY n DESC, word) - 1 || '#' AS tag FROM w")
def squeeze_tag_dictionary(spark, sf_dir):
    return squeeze.dictionary(logs(spark, sf_dir), "user_id")


@query("squeeze_line_repeats", "WITH o AS (SELECT user_id, event_id, event_type AS k, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS l FROM events), r AS (SELECT *, sum(CASE WHEN k = l THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM o) SELECT user_id, min(event_id) AS first, any_value(k) AS line, count(*) AS times FROM r GROUP BY user_id, run")
def squeeze_line_repeats(spark, sf_dir):
    return squeeze.count_repeats(table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("line")), "user_id", "event_id")


@query("squeeze_trim_zeros", "SELECT event_id, regexp_replace('a=' || CAST(event_id % 100 AS INTEGER), '=0+([1-9])', '=\\1') AS line FROM events")
def squeeze_trim_zeros(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", squeeze.trim_zeros(F.concat(F.lit("a="), F.when(F.col("event_id") % 100 == 0, "0").otherwise(F.concat(F.lit("000"), (F.col("event_id") % 100).cast("string"))))).alias("line"))


@query("squeeze_logs")
def squeeze_logs(spark, sf_dir):
    out = squeeze.squeeze(logs(spark, sf_dir), "user_id")
    return out.select("user_id", "raw_bytes", "out_bytes", "squeezed", squeeze.savings(F.col("raw_bytes"), F.col("out_bytes")).alias("saved"), F.size("legend").alias("legend"))


_TREE = f"{RING}, e AS (SELECT 'c' || src AS src, 'c' || dst AS dst FROM ring)"


@query("impact_report", f"""WITH RECURSIVE {_TREE}, t AS (SELECT 'c' || min(c_custkey) AS node FROM customer GROUP BY c_nationkey), w(node, d) AS (SELECT node, 0 FROM t UNION SELECT src, d + 1 FROM w JOIN e ON dst = node WHERE d < 3),
b AS (SELECT node, min(d) AS d FROM w WHERE node NOT IN (SELECT node FROM t) GROUP BY node) SELECT 'calls' AS section, dst AS node, 1 AS depth FROM e JOIN t ON src = node WHERE dst NOT IN (SELECT node FROM t) GROUP BY dst
UNION ALL SELECT CASE WHEN d = 1 THEN 'called_by' ELSE 'transitive' END, node, CAST(d AS INTEGER) FROM b""")
def impact_report(spark, sf_dir):
    name = lambda c: F.concat(F.lit("c"), F.col(c).cast("string"))
    edges = ring(spark, sf_dir).select(name("src").alias("src"), name("dst").alias("dst"), F.lit("resolved").alias("target_kind"), F.lit("exact").alias("confidence"), F.lit("call").alias("kind"))
    targets = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.concat(F.lit("c"), F.min("c_custkey").cast("string")).alias("node")).select("node")
    none = spark.createDataFrame([], "src string, dst string")
    return reports.impact(edges, none, targets, depth=3)


_PACK = """i AS (SELECT conv_id, 't' || turn AS qn, turn AS bucket, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS b, CAST(ceil(strlen(left(text, 40)) / 4.0) AS BIGINT) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn, 't' || turn) AS n FROM conversations),
p(conv_id, n, used, form, cost, qn) AS (SELECT conv_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR) FROM i WHERE n = 1
  UNION ALL SELECT i.conv_id, i.n, CASE WHEN b > 0 AND used + b <= 400 THEN used + b WHEN used + s <= 400 THEN used + s ELSE used END, CASE WHEN b > 0 AND used + b <= 400 THEN 'body' WHEN used + s <= 400 THEN 'signature' END,
  CASE WHEN b > 0 AND used + b <= 400 THEN b WHEN used + s <= 400 THEN s ELSE 0 END, i.qn FROM p JOIN i ON i.conv_id = p.conv_id AND i.n = p.n + 1)"""


@query("budget_pack", f"WITH RECURSIVE {_PACK} SELECT conv_id, qn, form, cost, used FROM p WHERE form IS NOT NULL")
def budget_pack(spark, sf_dir):
    items = table(spark, sf_dir, "conversations").select("conv_id", F.concat(F.lit("t"), F.col("turn").cast("string")).alias("qn"), F.col("turn").alias("bucket"), F.col("text").alias("body"), F.substring("text", 1, 40).alias("signature"))
    return reports.pack(items, 400, key="conv_id").select("conv_id", "qn", "form", "cost", "used")


def sources(spark, sf_dir):
    """Small source files in four languages, one of each for each nation, that call and import one another."""
    n, nxt = F.col("n_nationkey").cast("string"), ((F.col("n_nationkey") + 1) % 25).cast("string")
    put = lambda text: F.replace(F.replace(F.lit(text), F.lit("{n}"), n), F.lit("{m}"), nxt)
    py = put('"""Module {n}."""\nfrom .mod{m} import run{m}\n\nclass Shape{n}(Base):\n    size = 1\n\n    def area(self, x):\n        """Area."""\n        return self._scale(x)\n\n    def _scale(self, x):\n        return run{m}(x)\n\ndef run{n}(x):\n    return Shape{n}().area(x)\n')
    rs = put("use crate::mod{m}::Thing{m};\n\n/// A thing.\npub struct Thing{n} { pub a: u32 }\n\nimpl Draw for Thing{n} {\n    fn draw(&self) { helper{n}(self.a); }\n}\n\npub fn helper{n}(a: u32) -> u32 { println!(\"{}\", a); a }\n")
    sql = put("CREATE TABLE t{n} (a INT);\nCREATE OR REPLACE VIEW v{n} AS SELECT a FROM t{n};\ncreate unique index i{n} on t{n} (a);\n")
    md = put("---\ntitle: x\n---\n# Guide {n}\n\nText\n\n## Use\n\n```sh\n# not a heading\n```\n\nEnd\n===\n")
    kinds = F.array(*[F.struct(F.lit(lang).alias("language"), F.concat(F.lit(f"{lang}/mod"), n, F.lit(ext)).alias("path"), text.alias("text")) for lang, ext, text in (("python", ".py", py), ("rust", ".rs", rs), ("sql", ".sql", sql), ("markdown", ".md", md))])
    return table(spark, sf_dir, "nation").select(F.explode(kinds).alias("f")).select("f.*")


@query("declarations", """WITH k(lang, ext, kind, name) AS (VALUES ('python', '.py', 'class', 'Shape@'), ('python', '.py', 'field', 'size'), ('python', '.py', 'method', 'area'), ('python', '.py', 'method', '_scale'), ('python', '.py', 'function', 'run@'), ('rust', '.rs', 'struct', 'Thing@'), ('rust', '.rs', 'impl', 'Thing@'), ('rust', '.rs', 'method', 'draw'), ('rust', '.rs', 'function', 'helper@'),
('sql', '.sql', 'class', 't@'), ('sql', '.sql', 'class', 'v@'), ('sql', '.sql', 'field', 'i@'), ('markdown', '.md', 'heading', 'Guide @'), ('markdown', '.md', 'heading', 'Use'), ('markdown', '.md', 'heading', 'End'), ('markdown', '.md', 'code_block', 'sh'))
SELECT lang || '/mod' || n_nationkey || ext AS file, kind, replace(name, '@', CAST(n_nationkey AS VARCHAR)) AS name FROM nation, k""")
def declarations(spark, sf_dir):
    return code.declarations(sources(spark, sf_dir)).select("file", "kind", "name")


@query("call_graph", """SELECT 'python/mod' || n || '.py::run' || n AS src, 'python/mod' || n || '.py::Shape' || n || '::area' AS dst, 'exact' AS confidence FROM (SELECT n_nationkey AS n FROM nation) WHERE false
UNION ALL SELECT 'python/mod' || n || '.py::Shape' || n || '::area', 'python/mod' || n || '.py::Shape' || n || '::_scale', 'exact' FROM (SELECT n_nationkey AS n FROM nation)
UNION ALL SELECT 'python/mod' || n || '.py::Shape' || n || '::_scale', 'python/mod' || (n + 1) % 25 || '.py::run' || (n + 1) % 25, 'exact' FROM (SELECT n_nationkey AS n FROM nation)
UNION ALL SELECT 'rust/mod' || n || '.rs::Thing' || n || '::draw', 'rust/mod' || n || '.rs::helper' || n, 'exact' FROM (SELECT n_nationkey AS n FROM nation)""")
def call_graph(spark, sf_dir):
    """Resolved calls between callables of the generated sources."""
    edges = calls_of(sources(spark, sf_dir).filter("language IN ('python', 'rust')"))
    return edges.filter("target_kind = 'resolved' AND kind = 'call' AND receiver IS DISTINCT FROM concat('Shape', regexp_extract(file, 'mod([0-9]+)', 1), '()')").select("src", "dst", "confidence")


def calls_of(files):
    decls = code.qualified(code.declarations(files))
    callables_ = decls.filter(F.col("kind").isin(*code.CALLABLE_KINDS)).select("qn", "file", "name", "kind")
    imports = code.imports(files)
    deps, _ = resolve.resolve_imports(imports, files)
    return resolve.resolve_calls(code.calls(files), callables_, code.types_table(decls), imports, deps)


@query("pattern_search")
def pattern_search(spark, sf_dir):
    return code.find_pattern(sources(spark, sf_dir), "return $A($$$)", "return checked($A($$$))")


@query("test_paths_in_scan")
def test_paths_in_scan(spark, sf_dir):
    return paths(spark, sf_dir).filter(T.is_test_path(F.col("path")) & ~T.is_denied(F.col("path"))).select("id", "path")


def _python(spark, sf_dir):
    return sources(spark, sf_dir).filter("language = 'python'")


_N = "(SELECT n_nationkey AS n FROM nation)"


@query("import_graph", f"SELECT 'python/mod' || n || '.py' AS src, 'python/mod' || (n + 1) % 25 || '.py' AS dst FROM {_N} UNION ALL SELECT 'rust/mod' || n || '.rs', 'rust/mod' || (n + 1) % 25 || '.rs' FROM {_N}")
def import_graph(spark, sf_dir):
    files = sources(spark, sf_dir).filter("language IN ('python', 'rust')")
    parts = []
    for language in ("python", "rust"):
        own = files.filter(F.col("language") == language)
        parts.append(resolve.resolve_imports(code.imports(own), own)[0].select("src", "dst"))
    return parts[0].unionByName(parts[1])


@query("import_cycles", f"SELECT count(*) AS size, array_to_string(list_sort(list('python/mod' || n || '.py')), ',') AS members FROM {_N}")
def import_cycles(spark, sf_dir):
    from codeloom.operators import graph

    files = _python(spark, sf_dir)
    edges = resolve.resolve_imports(code.imports(files), files)[0]
    return graph.cycles(edges).select("size", F.array_join("members", ",").alias("members"))


@query("surface_closure", f"SELECT 'Shape' || n AS exposed, 'python/mod' || n || '.py' AS module, CAST(0 AS INTEGER) AS depth FROM {_N} WHERE n = 3 UNION ALL SELECT 'run' || n, 'python/mod' || n || '.py', 0 FROM {_N} WHERE n = 3 UNION ALL SELECT 'run' || n, 'python/mod' || n || '.py', 1 FROM {_N} WHERE n = 4")
def surface_closure(spark, sf_dir):
    from codeloom.operators import surface

    files = _python(spark, sf_dir)
    exports = surface.python_exports(code.declarations(files), code.imports(files), spark.createDataFrame([], "file string, name string"))
    return surface.surface(exports, spark.createDataFrame([("python/mod3.py",)], "module string")).select("exposed", "module", "depth")


@query("show_symbols", "SELECT * FROM (VALUES ('Shape3.area', 1), ('helper7', 1), ('Guide', 25)) v(symbol, total)")
def show_symbols(spark, sf_dir):
    return code.show(code.declarations(sources(spark, sf_dir)), ["Shape3.area", "helper7", "Guide", "missing"])[1].select("symbol", F.col("total").cast("int").alias("total"))


@query("symbols_not_found", "SELECT 'missing' AS symbol")
def symbols_not_found(spark, sf_dir):
    return code.show(code.declarations(sources(spark, sf_dir)), ["Shape3.area", "missing"])[2]


@query("implementors_of_base", f"SELECT 'python/mod' || n || '.py' AS path, 'Shape' || n AS name FROM {_N}")
def implementors_of_base(spark, sf_dir):
    from codeloom.operators import graph

    return graph.implementors(code.types_table(code.declarations(sources(spark, sf_dir))), "Base").select("path", "name")


@query("type_usages", "SELECT 'python/mod5.py' AS file, 'construct' AS how UNION ALL SELECT 'python/mod5.py', 'receiver' WHERE false")
def type_usages(spark, sf_dir):
    files = _python(spark, sf_dir)
    return resolve.type_usages(calls_of(files), code.types_table(code.declarations(files)), "Shape5").filter("how = 'construct'").select("file", "how").distinct()


@query("markdown_headings", f"SELECT 'markdown/mod' || n || '.md' AS path, level, replace(title, '@', CAST(n AS VARCHAR)) AS title, replace(crumbs, '@', CAST(n AS VARCHAR)) AS crumbs FROM {_N}, (VALUES (1, 'Guide @', ''), (2, 'Use', 'Guide @'), (1, 'End', '')) v(level, title, crumbs)")
def markdown_headings(spark, sf_dir):
    from codeloom.operators import chunks

    files = sources(spark, sf_dir).filter("language = 'markdown'")
    return chunks.headings(files, "path").select("path", "level", "title", F.array_join("crumbs", "/").alias("crumbs"))


@query("declaration_markers", f"SELECT 'rust/mod' || n || '.rs' AS file, name, native, mods FROM {_N}, (VALUES ('Thing', 'struct', 'pub'), ('helper', 'fn', 'pub'), ('draw', 'fn', '')) v(name, native, mods)")
def declaration_markers(spark, sf_dir):
    rows = code.declarations(sources(spark, sf_dir)).filter("file LIKE 'rust/%' AND kind <> 'impl'")
    return rows.select("file", F.regexp_replace("name", r"\d+$", "").alias("name"), F.col("native_kind").alias("native"), F.array_join("modifiers", " ").alias("mods"))


@query("outline_chunks")
def outline_chunks(spark, sf_dir):
    from codeloom.operators import chunks

    return chunks.outline(code.declarations(sources(spark, sf_dir)))


@query("digest", f"SELECT 'python/mod' || n || '.py' AS file, kind, replace(name, '@', CAST(n AS VARCHAR)) AS name FROM {_N}, (VALUES ('class', 'Shape@'), ('method', 'area'), ('function', 'run@')) v(kind, name)")
def digest(spark, sf_dir):
    return code.digest(code.declarations(_python(spark, sf_dir))).select("file", "kind", "name")


@query("context_pack", "SELECT * FROM (VALUES ('python/mod2.py::run2', 'body'), ('python/mod1.py::Shape1::_scale', 'signature'), ('python/mod1.py::Shape1::area', 'signature')) v(qn, form)")
def context_pack(spark, sf_dir):
    files = _python(spark, sf_dir)
    decls = code.qualified(code.declarations(files))
    edges = calls_of(files).filter("receiver IS NULL OR receiver IN ('self')")
    sure = edges.filter("kind = 'call'")
    return reports.context_pack(sure, reports.source_of(decls, files, decls.select("qn")), spark.createDataFrame([("python/mod2.py::run2",)], "node string"), 200).select("qn", "form")


@query("incremental_parity", "SELECT CAST(NULL AS VARCHAR) AS src, CAST(NULL AS VARCHAR) AS dst WHERE false")
def incremental_parity(spark, sf_dir):
    """Call edges that an update of one changed file gives otherwise than a build from scratch: none."""
    from codeloom.operators import incremental

    before = _python(spark, sf_dir)
    after = before.withColumn("text", F.when(F.col("path") == "python/mod4.py", F.replace("text", F.lit("run4"), F.lit("ran4"))).otherwise(F.col("text")))
    decls = code.qualified(code.declarations(after))
    callables_ = decls.filter(F.col("kind").isin(*code.CALLABLE_KINDS)).select("qn", "file", "name", "kind")
    imports = code.imports(after)
    deps, _ = resolve.resolve_imports(imports, after)
    types = code.types_table(decls)
    change = spark.createDataFrame([("python/mod4.py", "modified")], "path string, change string")
    names = spark.createDataFrame([("run4",), ("ran4",)], "name string")
    part = incremental.apply_to_calls(calls_of(before), code.calls(after), callables_, types, imports, deps, change, names)
    sides = part.select("src", "dst", "line", "confidence", F.lit(1).alias("n")).unionByName(calls_of(after).select("src", "dst", "line", "confidence", F.lit(-1).alias("n")))
    return sides.groupBy("src", "dst", "line", "confidence").agg(F.sum("n").alias("n")).filter("n <> 0").select("src", "dst")
