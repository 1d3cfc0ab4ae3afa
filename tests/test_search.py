import math

import pytest
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import search as S


def one(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_identifier_parts(spark):
    words = {"my_func": ["my", "func"], "simple": [], "getHTTPResponse": ["get", "http", "response"], "XMLParser": ["xml", "parser"], "h2o": ["h", "2", "o"], "_foo_": [], "_foo_bar_": ["foo", "bar"]}
    assert one(spark, T.identifier_parts, words) == list(words.values())


def test_tokens(spark):
    texts = ["def getUserById(user_id):", "foo + 42 - bar", "a + b1c (d_e) 2f", None]
    want = [["def", "getuserbyid", "get", "user", "by", "id", "user_id", "user", "id"], ["foo", "bar"], ["a", "b1c", "b", "1", "c", "d_e", "d", "e", "f"], []]
    assert one(spark, T.tokens, texts) == want
    assert [S.query_tokens(t or "") for t in texts] == want


def test_symbol_queries(spark):
    yes = ["HandlerStack", "Sinatra::Base", "app.use", "Foo->bar", "_internal", "snake_case_thing"]
    no = ["session", "how do i do x"]
    assert one(spark, T.is_symbol_query, yes + no) == [True] * 6 + [False] * 2
    assert [S.alpha_of(q) for q in yes + no] == [0.3] * 6 + [0.5] * 2 and S.alpha_of("x", 0.9) == 0.9


def scores(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, score double")


def test_rank_fusion(spark):
    got = {r.chunk_id: r.rr for r in S.rrf(scores(spark, [(30, 0.1), (10, 0.9), (20, 0.5)])).collect()}
    assert got == {10: 1 / 61, 20: 1 / 62, 30: 1 / 63}
    sem, lex = scores(spark, [(1, 1.0), (2, 0.5)]), scores(spark, [(2, 0.4), (3, 0.6)])
    got = {r.chunk_id: r.score for r in S.combine(sem, lex, 0.5, value="score").collect()}
    assert got == {1: pytest.approx(0.5), 2: pytest.approx(0.45), 3: pytest.approx(0.3)}
    got = {r.chunk_id: r.score for r in S.combine(scores(spark, [(1, 1.0)]), scores(spark, [(1, 0.5), (2, 0.5)]), 1.0, value="score").collect()}
    assert got == {1: 1.0, 2: 0.0}


def test_coherence_and_saturation(spark):
    rows = spark.createDataFrame([(0, 1.0, "a"), (1, 0.5, "a"), (2, 0.4, "b")], "chunk_id long, score double, file_path string")
    got = {r.chunk_id: round(r.score, 4) for r in S.coherence(rows).collect()}
    assert got == {0: 1.2, 1: 0.5, 2: 0.4533}
    rows = spark.createDataFrame([(0, 1.0, "a"), (1, 0.9, "a"), (2, 0.8, "a")], "chunk_id long, score double, file_path string")
    assert [round(r.score, 6) for r in S.saturate(rows, 5).collect()] == [1.0, 0.45, 0.2]


def test_path_penalty_once(spark):
    assert [round(x, 3) for x in one(spark, T.path_penalty, ["tests/test_foo.py", "src/main.rs", "a/types.d.ts", "pkg/__init__.py", "x/compat/y.py"])] == [0.3, 1.0, 0.7, 0.5, 0.3]


def test_test_paths(spark):
    yes, no = ["Foo.Tests/x.cs", "e2e/a.ts", "a/b_test.go", "x/test_x.py"], ["latest/a.py", "src/test_utils.rs", "contest.py"]
    assert one(spark, T.is_test_path, yes + no) == [True] * 4 + [False] * 3


def test_query_filters():
    q = S.parse_query("lang:Rust path:src/auth name:Login refresh the token")
    assert (q.lang, q.path, q.name, q.text) == (["rust"], ["src/auth"], ["login"], "refresh the token")
    for text in ("TODO: fix the parser", "name: thing"):
        q = S.parse_query(text)
        assert (q.text, q.lang, q.path, q.name) == (text, [], [], [])
    q = S.parse_query('path:"src/some path" parse')
    assert q.path == ["src/some path"] and q.text == "parse"


def corpus(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chunk_id long, content string")


def bm(spark, texts, query, **how):
    return {r.chunk_id: r.score for r in S.bm25(corpus(spark, texts), query, **how).collect()}


def test_bm25_properties(spark):
    assert bm(spark, [], "x") == {}
    texts = ["apple apple pear", "apple pear plum", "apple", "plum plum", "fig"]
    got = bm(spark, texts, "apple")
    assert got[0] > got[1] and got[2] > got[1] and got[3] == 0
    assert bm(spark, texts, "fig")[4] > got[2] * 0.9 and set(bm(spark, texts, "unknown").values()) == {0.0}
    assert bm(spark, texts, "apple apple")[0] == pytest.approx(2 * got[0])
    masked = bm(spark, texts, "apple", keep=F.col("chunk_id") != 0)
    assert 0 not in masked and masked[1] == got[1]  # statistics are those of all chunks
    lengths = corpus(spark, texts).select("chunk_id", F.size(T.tokens(F.col("content"))).alias("dl"))
    stored = {r.chunk_id: r.score for r in S.bm25_indexed(S.postings(corpus(spark, texts)), lengths, "apple").collect()}
    assert stored == {k: pytest.approx(v) for k, v in got.items() if v > 0}


def test_vector_topk_leaves_out_what_is_no_number(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [float("nan"), 1.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 2.0]), (5, [0.0, 0.0])], "chunk_id long, vector array<double>")
    got = [(r.chunk_id, r.score) for r in S.top_vectors(S.cosine(rows, [3.0, 0.0]), 3).collect()]
    assert got == [(0, 1.0), (2, 1.0), (4, 0.0)]
    assert S.top_vectors(S.cosine(rows, [1.0, 0.0]), 0).collect() == []


def test_embedding(spark):
    vectors = spark.createDataFrame([("foo", [1.0, 0.0]), ("bar", [0.0, 1.0])], "token string, vector array<double>")
    texts = spark.createDataFrame([(0, "foo bar"), (1, "zzz"), (2, "foo " * 2000)], "chunk_id long, content string")
    got = {r.chunk_id: r.vector for r in S.embed(texts, vectors, dims=2).collect()}
    assert got[0] == [pytest.approx(math.sqrt(0.5))] * 2 and got[1] == [0.0, 0.0] and got[2] is None


def chunk_rows(spark):
    rows = [
        (0, "class Login:\n  pass", "src/login.py", "python", "Login", "source", 1, 2, [1.0, 0.0]),
        (1, "Login() refresh token", "tests/test_login.py", "python", None, "source", 1, 2, [0.9, 0.1]),
        (2, "refresh token", "src/auth.rs", "rust", None, "enclosing", 1, 9, [0.5, 0.5]),
        (3, "refresh the token", "src/auth.rs", "rust", None, "part", 2, 5, [0.4, 0.6]),
        (4, "nothing here", "lib/other.go", "go", None, "outline", 1, 2, [0.0, 1.0]),
    ]
    return spark.createDataFrame(rows, "chunk_id long, content string, file_path string, language string, breadcrumb string, kind string, start_line int, end_line int, vector array<double>")


def test_hybrid_search(spark):
    rows = chunk_rows(spark)
    assert S.search(rows, "Login", [1.0, 0.0]).first().chunk_id == 0
    ids = [r.chunk_id for r in S.search(rows, "refresh token", [0.5, 0.5]).collect()]
    assert 2 not in ids and 3 in ids  # an enclosing chunk gives way to its part
    assert {r.chunk_id for r in S.search(rows, "Login lang:rust", [1.0, 0.0]).collect()} <= {2, 3}
    few, many = S.search(rows, "refresh token", [0.5, 0.5], k=1).collect(), S.search(rows, "refresh token", [0.5, 0.5], k=4).collect()
    assert few == many[:1]


def test_chunk_at_and_related(spark):
    rows = chunk_rows(spark)
    assert S.chunk_at(rows, "src/auth.rs", 3).first().chunk_id == 2 and S.chunk_at(rows, "src/auth.rs", 9).first().chunk_id == 2
    assert S.chunk_at(rows, "src/auth.rs", 40).collect() == []
    depths = spark.createDataFrame([("tests/test_login.py", 1)], "file_path string, depth int")
    (got,) = S.related(rows, 0, depths=depths).collect()
    assert got.chunk_id == 1 and got.score == pytest.approx(1.4 * 0.9 / math.hypot(0.9, 0.1))


def counting(spark, name):
    """A function of texts that gives them back, and the number of texts it has read."""
    read = spark.sparkContext.accumulator(0)
    return F.udf(lambda t: (read.add(1), t)[1], "string").asNondeterministic()(name), read


def test_searches_read_texts_once(spark):
    texts = ["def lookup_word(): pass", "lookup word lookup", "class Other: pass", "the word again", "a word of lookup_word"] * 8
    rows = spark.createDataFrame([(i, t, f"d{i % 7}/f{i}.py", "outline" if i % 4 == 0 else "source") for i, t in enumerate(texts)], "chunk_id long, content string, file_path string, kind string")
    rows = rows.select("*", F.lit("python").alias("language"), F.lit("c").alias("breadcrumb"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"))
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(0, 40, 3)], "chunk_id long, vector array<double>")
    put, read = counting(spark, "content")
    plain = S.bm25(rows, "lookup word").orderBy("chunk_id").collect()
    assert S.bm25(rows.withColumn("content", put), "lookup word").orderBy("chunk_id").collect() == plain and read.value == 40
    put, read = counting(spark, "content")
    want = S.search(rows.join(vectors, "chunk_id", "left"), "where is lookup_word", [1.0, 0.5]).collect()
    got = S.search(rows.withColumn("content", put), "where is lookup_word", [1.0, 0.5], vectors=vectors).collect()
    assert [(r.chunk_id, round(r.score, 9)) for r in got] == [(r.chunk_id, round(r.score, 9)) for r in want] and want
    assert read.value <= 80  # once for the counts, once for the pool


def test_index_is_read_once(spark):
    rows = spark.createDataFrame([(i, f"word other{i} lookup") for i in range(40)], "chunk_id long, content string")
    put, read = counting(spark, "content")
    once = rows.withColumn("content", put)
    lengths = once.select("chunk_id", F.size(T.tokens(F.col("content"))).alias("dl"))
    assert S.bm25_indexed(S.postings(once), lengths, "lookup").count() == 40 and read.value <= 80


def test_only_known_tokens_are_counted(spark):
    rows = spark.createDataFrame([(1, "a b c a"), (2, "x y"), (3, None), (4, "a " * 5000)], "chunk_id long, content string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 3.0])], "token string, vector array<double>")
    got = S.embed(rows, vectors, dims=2)
    length = 13**0.5
    assert {r.chunk_id: r.vector and [round(x, 9) for x in r.vector] for r in got.collect()} == {1: [round(2 / length, 9), round(3 / length, 9)], 2: [0.0, 0.0], 3: [0.0, 0.0], 4: None}
    counted = got._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in counted  # a row for each dimension of each token
    assert counted.index("Aggregate [chunk_id") < counted.index("LeftSemi")  # the join lies under the count
