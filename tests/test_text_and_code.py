import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import chunks as C
from codeloom.operators import code, incremental, reports, resolve, squeeze, surface
from codeloom.sources import files as S


def test_squeeze_round_trip():
    rnd = random.Random(6)
    for n in range(12):
        text = "\n".join(f"2024-03-0{rnd.randrange(1, 3)}T10:{rnd.randrange(20, 23)}:{i % 60:02d}.5 [{rnd.choice(['Win', 'WinFocus', 'WinFocusMonitor'])}] user={rnd.randrange(5)} path=/a/{rnd.choice('bcd')} & done" for i in range(rnd.randrange(1, 60)))
        body, legend = squeeze.squeeze_text(text, lossy=False)
        assert squeeze.expand_text(body, legend) == text
        if n > 3 and text.count("\n") > 30:
            assert len(squeeze.render(body, legend)) < len(text)


def test_squeeze_table(spark):
    log = "\n".join(f"2024-03-01T10:20:{i % 60:02d} [Worker] state=ok id={i}" for i in range(200))
    rows = {r.d: r for r in squeeze.squeeze(spark.createDataFrame([(1, log), (2, "tiny"), (3, None), (4, "has #0# inside " * 30)], "d int, text string"), "d").collect()}
    assert rows[1].squeezed and rows[1].out_bytes < rows[1].raw_bytes and rows[1].legend
    assert not rows[2].squeezed and rows[2].body == "tiny" and rows[3].body == "" and rows[4].body == "has #0# inside " * 30


def test_zero_trim_and_sizes(spark):
    df = spark.createDataFrame([("a=007 0x00ff 1.500 2.0",)], "t string")
    assert df.select(squeeze.trim_zeros(F.col("t"))).first()[0] == "a=7 0xff 1.5 2"
    assert spark.range(1).select(squeeze.human_bytes(F.lit(1500)), squeeze.savings(F.lit(200), F.lit(50))).first()[:] == ("1.5 kB", 75)


def test_pack_keeps_order_and_bytes(spark):
    rnd = random.Random(1)
    texts = {d: [("x" * rnd.randrange(1, 900)) + "\n\n" for _ in range(20)] + ["y" * 4000] for d in range(3)}
    pieces = spark.createDataFrame([(d, n, t) for d, ts in texts.items() for n, t in enumerate(ts)], "d int, n int, content string")
    rows = C.pack(pieces, "d").orderBy("d", "chunk").collect()
    for d, ts in texts.items():
        mine = [r.content for r in rows if r.d == d]
        assert "".join(mine) == "".join(ts) and all(len(m) <= 1500 or m == "y" * 4000 for m in mine)


def test_paragraphs_tile_the_text(spark):
    texts = ["a\n\nb\r\n \r\nc\n\n\n\nd", "\n\nx", "plain"]
    rows = C.paragraphs(spark.createDataFrame(list(enumerate(texts)), "d int, text string"), "d").orderBy("d", "n").collect()
    for d, t in enumerate(texts):
        mine = [r for r in rows if r.d == d]
        assert "".join(r.content for r in mine) == t and mine[0].start == 0 and mine[-1].end == len(t.encode())
    assert [r.content for r in rows if r.d == 0] == ["a\n\n", "b\r\n \r\n", "c\n\n\n\n", "d"]


def test_headings(spark):
    text = "---\ntitle: x\n---\n# One\n## Two ##\n```\n# no\n```\n### Three\n# Four\nFive\n---\n"
    rows = C.headings(spark.createDataFrame([(1, text)], "d int, text string"), "d").orderBy("line").collect()
    assert [(r.line, r.level, r.title, r.crumbs) for r in rows] == [(4, 1, "One", []), (5, 2, "Two", ["One"]), (9, 3, "Three", ["One", "Two"]), (10, 1, "Four", []), (11, 2, "Five", ["Four"])]
    decls, _, _ = code.parse_markdown("a.md", text)
    assert [(d[3], d[4], d[2]) for d in decls] == [("heading", "One", []), ("heading", "Two", ["One"]), ("heading", "Three", ["One", "Two"]), ("heading", "Four", []), ("heading", "Five", ["Four"]), ("code_block", "", [])]


SOURCES = {
    "java": ("A.java", "package p;\nimport java.util.List;\npublic class A extends Base implements I {\n  private int n;\n  public A(int n) { this.n = n; }\n  int get(List<X> l) { return helper(l); }\n}\n", {("class", "A"), ("ctor", "A"), ("method", "get")}),
    "go": ("a.go", "package a\n\ntype Shape struct {\n\tn int\n}\n\nfunc (s *Shape) Area(x int) int {\n\treturn scale(x)\n}\n\nfunc scale(x int) int { return x }\n", {("struct", "Shape"), ("function", "Area"), ("function", "scale")}),
    "typescript": ("a.ts", "import { x } from './b';\nexport class T extends Q {\n  run(a: string): void { x(a); }\n}\nexport function f(a: number) { return new T(); }\ninterface I { a: string }\n", {("class", "T"), ("method", "run"), ("function", "f"), ("interface", "I")}),
    "csharp": ("a.cs", "using System;\nnamespace N {\n  public class C : B {\n    public int Add(int a) { return Sum(a); }\n  }\n}\n", {("module", "N"), ("class", "C"), ("method", "Add")}),
    "cpp": ("a.cpp", "#include \"b.h\"\nclass D : public E {\n public:\n  ~D() { }\n  int go(int a) { return b(a); }\n};\nint main() { return 0; }\n", {("class", "D"), ("dtor", "D"), ("method", "go"), ("function", "main")}),
    "kotlin": ("a.kt", "import a.b\nclass K(val x: Int) : Base() {\n  fun go(a: Int): Int { return f(a) }\n}\nfun top(a: Int) { }\n", {("class", "K"), ("method", "go"), ("function", "top")}),
    "scala": ("a.scala", "import a.b\ntrait S {\n  def go(a: Int): Int = { f(a) }\n}\nobject O extends S { }\n", {("trait", "S"), ("method", "go"), ("object", "O")}),
    "php": ("a.php", "<?php\nclass P extends Q {\n  public function go($a) { return f($a); }\n}\nfunction top($a) { }\n", {("class", "P"), ("method", "go"), ("function", "top")}),
    "ruby": ("a.rb", "require 'b'\nmodule M\n  class R < Base\n    def go(a)\n      f(a)\n    end\n    private\n    def hid\n    end\n  end\nend\n", {("module", "M"), ("class", "R"), ("method", "go"), ("method", "hid")}),
    "elixir": ("a.ex", "defmodule M.E do\n  alias A.B\n  def go(a) do\n    a\n  end\n  defp hid(a), do: a\nend\n", {("module", "M.E"), ("method", "go"), ("method", "hid")}),
    "rust": ("a.rs", "use crate::m::{X, y::Z};\n/// Doc.\npub struct R { pub a: u32 }\nimpl Draw for R {\n    fn draw(&self) { help!(self.a); other(1); }\n}\npub fn other(a: u32) -> u32 { a }\n", {("struct", "R"), ("impl", "R"), ("method", "draw"), ("function", "other")}),
    "sql": ("a.sql", "create table a.b (x int);\nCREATE OR REPLACE FUNCTION f() RETURNS int AS $$ $$;\n-- create nothing\nCREATE INDEX i ON t (x);\n", {("class", "a.b"), ("function", "f"), ("field", "i")}),
}


@pytest.mark.parametrize("lang", SOURCES)
def test_languages(lang):
    file, text, want = SOURCES[lang]
    decls, calls, imports = code.parse(file, lang, text)
    assert want <= {(d[3], d[4]) for d in decls}
    assert all(d[10] <= d[11] for d in decls) and len({tuple(d[1]) for d in decls}) == len(decls)
    if lang not in ("sql", "elixir", "go"):
        assert imports or lang == "php"
    if lang not in ("sql", "elixir"):
        assert calls or lang == "scala"


def source_files(spark):
    py = 'from .b import run\n\nclass Shape(Base):\n    def area(self, x):\n        """Doc."""\n        return self._scale(x)\n\n    def _scale(self, x):\n        return run(x)\n\ndef make():\n    return Shape()\n'
    rows = [("pkg/a.py", "python", py), ("pkg/b.py", "python", "def run(x):\n    return x\n"), ("pkg/__init__.py", "python", "from .a import Shape as Form\nfrom .b import run, _hid\n"), ("bad.py", "python", "def (:")]
    return spark.createDataFrame(rows, "path string, language string, text string")


def test_call_resolution_and_reports(spark):
    files = source_files(spark)
    decls = code.qualified(code.declarations(files)).cache()
    calls = decls.filter(F.col("kind").isin(*code.CALLABLE_KINDS)).select("qn", "file", "name", "kind")
    imports = code.imports(files)
    deps, outside = resolve.resolve_imports(imports, files)
    assert {(r.src, r.dst) for r in deps.collect()} >= {("pkg/a.py", "pkg/b.py"), ("pkg/__init__.py", "pkg/a.py"), ("pkg/__init__.py", "pkg/b.py")}
    edges = resolve.resolve_calls(code.calls(files), calls, code.types_table(decls), imports, deps).cache()
    got = {(r.src, r.dst, r.target_kind, r.confidence) for r in edges.collect()}
    assert ("pkg/a.py::Shape::area", "pkg/a.py::Shape::_scale", "resolved", "exact") in got
    assert ("pkg/a.py::Shape::_scale", "pkg/b.py::run", "resolved", "exact") in got
    assert {r.how for r in resolve.type_usages(edges, code.types_table(decls), "Shape").collect()} == {"construct"}
    target = spark.createDataFrame([("pkg/b.py::run",)], "node string")
    rows = {(r.section, r.node) for r in reports.impact(edges, deps.select("src", "dst"), target).collect()}
    assert rows == {("called_by", "pkg/a.py::Shape::_scale"), ("transitive", "pkg/a.py::Shape::area"), ("imported_by", "pkg/a.py"), ("imported_by", "pkg/__init__.py")}
    bodies = reports.source_of(decls, files, decls.select("qn"))
    packed = reports.context_pack(edges, bodies, target, budget=60).orderBy("place").collect()
    assert packed[0].qn == "pkg/b.py::run" and packed[0].form == "body" and packed[-1].used <= 60
    assert {r.file: r.errors for r in code.parse_errors(files).collect()}["bad.py"] == 1
    # incremental: changed sources give the edges of a build from scratch
    changed = files.withColumn("text", F.when(F.col("path") == "pkg/b.py", "def ran(x):\n    return x\n").otherwise(F.col("text")))
    decls2 = code.qualified(code.declarations(changed))
    calls2, imports2 = decls2.filter(F.col("kind").isin(*code.CALLABLE_KINDS)).select("qn", "file", "name", "kind"), code.imports(changed)
    deps2, _ = resolve.resolve_imports(imports2, changed)
    whole = resolve.resolve_calls(code.calls(changed), calls2, code.types_table(decls2), imports2, deps2)
    change = spark.createDataFrame([("pkg/b.py", "modified")], "path string, change string")
    names = spark.createDataFrame([("run",), ("ran",)], "name string")
    part = incremental.apply_to_calls(edges, code.calls(changed), calls2, code.types_table(decls2), imports2, deps2, change, names)
    assert sorted(map(repr, part.collect())) == sorted(map(repr, whole.collect()))
    exposed = {r.exposed: (r.module, r.item) for r in surface.surface(surface.python_exports(decls, imports, spark.createDataFrame([], "file string, name string")), spark.createDataFrame([("pkg/__init__.py",)], "module string")).collect()}
    assert exposed == {"Form": ("pkg/a.py", "Shape"), "run": ("pkg/b.py", "run")}


def test_surface_globs_and_loops(spark):
    rows = [("root", "*", "a", None, 1), ("root", "B", "b", "Inner", 2), ("a", "X", None, None, 1), ("a", "*", "root", None, 2), ("b", "Inner", "c", "Deep", 1), ("c", "Deep", None, None, 1)]
    e = spark.createDataFrame(rows, "module string, item string, target_module string, target_item string, line int")
    got = {r.exposed: (r.module, r.via_glob, len(r.chain)) for r in surface.surface(e, spark.createDataFrame([("root",)], "module string")).collect()}
    assert got == {"X": ("a", True, 1), "B": ("c", False, 2)}


def test_budget_pack_skips_and_goes_on(spark):
    rows = [("a", 0, "x" * 40, "sig"), ("b", 1, "y" * 400, "s" * 20), ("c", 2, "z" * 8, None), ("a", 3, "x", None), ("d", 4, "w" * 200, None)]
    got = [(r.qn, r.form, r.used) for r in reports.pack(spark.createDataFrame(rows, "qn string, bucket int, body string, signature string"), 20).orderBy("place").collect()]
    assert got == [("a", "body", 10), ("b", "signature", 15), ("c", "body", 17)]


def test_pattern_search_and_rewrite(spark):
    files = spark.createDataFrame([("a.py", "foo(1, bar(2))\nx = foo(a, a)\nfoo(a, b)\n")], "path string, text string")
    assert [r.match for r in code.find_pattern(files, "foo($A, $A)").collect()] == ["foo(a, a)"]
    hits = code.find_pattern(files, "foo($A, $$$)", "baz($$$; $A)")
    assert code.rewritten(files, hits).first().text == "baz(bar(2); 1)\nx = baz(a; a)\nbaz(b; a)\n"


def test_scan_and_delta(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "src/run").write_text("#!/usr/bin/env python3\n")
    (tmp_path / "node_modules/b.js").write_text("1")
    rows = {r.path: r for r in S.scan(spark, str(tmp_path)).collect()}
    assert set(rows) == {"src/a.py", "src/run"} and {r.language for r in rows.values()} == {"python"} and rows["src/a.py"].line_count == 1
    cols = "path string, size long, mtime_ns long, content_hash string"
    a = spark.createDataFrame([("a", 1, 1, "h"), ("b", 1, 1, "h"), ("c", 1, 1, "h"), ("d", 1, 1, "h")], cols)
    b = spark.createDataFrame([("a", 1, 1, "h"), ("b", 1, 2, "h"), ("c", 1, 2, "i"), ("e", 1, 1, "h")], cols)
    assert {(r.path, r.change) for r in S.delta(a, b).collect()} == {("b", "mtime_only"), ("c", "modified"), ("d", "removed"), ("e", "added")}
    with pytest.raises(S.PathNotFound):
        S.split_targets([str(tmp_path / "none")])
    assert S.parse_range("3-5") == (3, 5) and S.compare_corpus(["/a"], ["/a/b"]) == ("subset", "/a")


def test_ignore_rules(spark):
    df = spark.createDataFrame([(p,) for p in ("a/x.log", "keep.log", "out/y", "src/out/z", "src/a.py", "doc/b.md")], "p string")
    kept = df.filter(S.not_ignored(["# c", "*.log", "!keep.log", "/out/", "doc/**"], F.col("p"))).collect()
    assert {r.p for r in kept} == {"keep.log", "src/out/z", "src/a.py"}
    mix = spark.createDataFrame([(p,) for p in ("m/mix.exs", "m/deps/a.ex", "deps/b.ex", "m/lib/c.ex")], "path string")
    assert {r.path for r in S.pruned_mix(mix).collect()} == {"m/mix.exs", "deps/b.ex", "m/lib/c.ex"}


def test_new_files_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one")
    out = S.new_files(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination()
    assert [r.text for r in spark.table("seen").collect()] == ["one"]


def test_member_cap_and_subtree(spark):
    rows = [("f", [0], "class", "C", "public"), *[("f", [0, n], "method", f"m{n}", "public") for n in range(5)], ("f", [1], "class", "P", "private"), ("f", [1, 0], "method", "x", "public")]
    d = spark.createDataFrame(rows, "file string, ord_path array<int>, kind string, name string, visibility string").withColumn("signature", F.col("name"))
    kept, dropped = code.cap_members(d, 3)
    assert kept.count() == 6 and [(r.parent, r.dropped) for r in dropped.collect()] == [([0], 2)]
    assert {r.name for r in code.visible(d, no_private=True).collect()} == {"C", "m0", "m1", "m2", "m3", "m4"}
    assert {tuple(r.ord_path) for r in reports.cap_map(d, 6).collect()} == {(0,), (1,), (1, 0)}


def test_index_compaction(spark):
    rows = spark.createDataFrame([(0, True), (1, False), (2, False)], "chunk_id long, dead boolean")
    assert incremental.needs_compaction(rows) and incremental.live(rows).count() == 2


def test_paragraphs_tile_any_text(spark):
    from codeloom.operators import chunks

    texts = ["a\0b\n\nc", "\n" * 1_000_000, "x\r\n \t\r\ny\n\n", "", None, "\0\1\0\2\n\n\0"]
    got = chunks.paragraphs(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id").orderBy("id", "n").collect()
    for n, text in enumerate(texts):
        mine = [r for r in got if r.id == n]
        assert "".join(r.content for r in mine) == (text or "")
        assert [r.start for r in mine] == [0, *[r.end for r in mine]][: len(mine)]
    assert [r.content for r in got if r.id == 0] == ["a\0b\n\n", "c"]


def test_breadcrumbs_meet_on_cells(spark):
    rnd = random.Random(3)
    spans = lambda n, most: [(rnd.choice("fg"), a := rnd.randrange(4000), a + rnd.choice([0, 1, rnd.randrange(70), rnd.randrange(most)])) for _ in range(n)]
    rows = [(i, f, s, e) for i, (f, s, e) in enumerate(spans(150, 900))] + [(150, "f", 5, 9), (151, "f", 10**7, 10**7 + 4)]
    around = [(f, a, z, f"t{i}") for i, (f, a, z) in enumerate(sorted(set(spans(80, 3000))))] + [("f", 0, 10**9, "whole")]
    want = {}
    for i, f, s, e in rows:
        met = [(0 if a <= s and z >= e else 1, z - a if a <= s and z >= e else -((min(z, e) - max(a, s)) * 1000 // (e - s)), a, t) for g, a, z, t in around if g == f and a < e and z > s]
        want[i] = {t for *k, t in met if k == list(min(met)[:3])} or {None}
    c = spark.createDataFrame(rows, "chunk_id int, file_path string, start_byte long, end_byte long")
    m = spark.createDataFrame(around, "file string, start_byte long, end_byte long, trail string")
    got = C.breadcrumbs(c, m).collect()
    assert len(got) == len(rows) and all(r.breadcrumb in want[r.chunk_id] for r in got)
    line = lambda a, z: spark.range(3000).select(F.lit("f").alias("file"), (F.col("id") * 50).alias(a), (F.col("id") * 50 + 60).alias(z))
    assert C.near_ranges(line("_s", "_e"), line("_a", "_z"), "file").count() < 20 * 3000  # of 9 million pairs in the file


def runs_by_counting(lines, tag, longest, must):
    """The run that saves most, by counting all."""
    counts = {}
    for line in lines:
        for n in range(2, longest + 1):
            for i in range(len(line) - n + 1):
                counts[tuple(line[i : i + n])] = counts.get(tuple(line[i : i + n]), 0) + 1
    saved = {g: n * (len("".join(g).encode()) - len(tag)) - (len(tag) + 3 + len("".join(g).encode())) for g, n in counts.items() if n > 1 and (must is None or must in "".join(g))}
    return min(((-x, "".join(g), list(g)) for g, x in saved.items() if x > 0), default=None)


def test_best_runs_are_those_of_all_counts():
    rnd = random.Random(5)
    for k in range(60):
        lines = [[rnd.choice(["a", "bé", " ", "#1#", "="]) for _ in range(rnd.randrange(25))] for _ in range(rnd.randrange(12))]
        must, want = (None, "#")[k % 2], None
        got, want = squeeze._best_run(lines, "#7#", 8, must), runs_by_counting(lines, "#7#", 8, must)
        assert (got and (-got[0], got[1], got[2])) == want


def test_squeezing_is_dealt_to_many_tasks(spark):
    logs = spark.range(200).groupBy(F.col("id").alias("d")).agg(F.max(F.lit("a text")).alias("text"))
    assert squeeze.squeeze(logs, "d").select(F.spark_partition_id().alias("p")).distinct().count() == 4


def test_symbols_are_found_without_a_row_for_each_suffix(spark):
    rows = [("a", [1], ["m", "Box"], "open", "method"), ("a", [2], ["Box"], "open", "function"), ("b", [1], [], "open", "function"), ("b", [2], ["x", "open"], "y", "field"), ("c", [1], [], "The Open door", "heading")]
    decls = spark.createDataFrame(rows, "file string, ord_path array<int>, trail array<string>, name string, kind string")
    found = code.find_symbols(decls, ["open", "Box::open", "m.Box.open", "z.open", "::"])
    got = sorted((r.symbol, r.file, r.ord_path[0]) for r in found.collect())
    assert got == [("Box::open", "a", 1), ("Box::open", "a", 2), ("m.Box.open", "a", 1), ("open", "a", 1), ("open", "a", 2), ("open", "b", 1), ("open", "c", 1)]
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
