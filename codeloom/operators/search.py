"""Lexical and vector retrieval, rank fusion and re-ranking."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom import defaults as D
from codeloom.functions import text as T
from codeloom.plans.tables import cut


def top(df: DataFrame, k: int, score: str = "score", tie: str = "chunk_id") -> DataFrame:
    """The k rows of greatest positive score; ties to the smaller id."""
    return df.filter(F.col(score) > 0).orderBy(F.col(score).desc(), F.col(tie)).limit(k)


def query_tokens(query: str) -> list[str]:
    """The tokens of a query, by the rules that texts follow; repeated ones count again."""
    out = []
    for w in re.findall(T.IDENTIFIER, query):
        spaced = w.lower().replace("_", " ") if "_" in w else w
        if "_" not in w:
            for p, r in T._CAMEL:
                spaced = re.sub(p, r.replace("$1", r"\1").replace("$2", r"\2"), spaced)
        parts = [p for p in spaced.lower().split(" ") if p]
        out += [w.lower(), *(parts if len(parts) >= 2 else [])]
    return out


def bm25(chunks: DataFrame, query: str, keep: Column | None = None, text: str = "content", tie: str = "chunk_id") -> DataFrame:
    """(chunk_id, score) of every chunk, by Lucene's BM25.

    Term counts come from each chunk's own token list and the corpus statistics from one
    aggregate over them, so nothing is shuffled but a row for each task. The statistics
    are those of all chunks; keep only decides which chunks come out.
    """
    return bm25_masks(chunks, query, [keep if keep is not None else F.lit(True)], text, tie)[0]


def bm25_masks(chunks: DataFrame, query: str, keeps: list[Column], text: str = "content", tie: str = "chunk_id") -> list[DataFrame]:
    """bm25() for several masks. Texts are read once: the counts, a row of numbers for each chunk, are written."""
    wanted = {t: query_tokens(query).count(t) for t in dict.fromkeys(query_tokens(query))}
    masks = [keep.alias(f"_keep{n}") for n, keep in enumerate(keeps)]
    # the length and the words of the query in one array, so that the tokens are found once
    both = F.transform(F.array(T.tokens(F.col(text))), lambda t: F.struct(F.size(t).alias("dl"), F.filter(t, lambda x: x.isin(*wanted)).alias("said")))
    rows = chunks.select(tie, *masks, F.explode(both).alias("_t"))
    counted = cut(rows.select(tie, *[f"_keep{n}" for n in range(len(keeps))], F.col("_t.dl").alias("_dl"), *[F.size(F.filter("_t.said", _equals(t))).alias(f"_tf{n}") for n, t in enumerate(wanted)]))
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avg"), *[F.count_if(F.col(f"_tf{n}") > 0).alias(f"_df{n}") for n in range(len(wanted))])
    parts = []
    for n, times in enumerate(wanted.values()):
        df, tf = F.col(f"_df{n}"), F.col(f"_tf{n}")
        idf = F.ln(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
        parts.append(times * idf * tf * (D.BM25_K1 + 1) / (tf + D.BM25_K1 * (1 - D.BM25_B + D.BM25_B * F.col("_dl") / F.col("_avg"))))
    score = reduce(lambda a, b: a + b, parts) if parts else F.lit(0.0)
    scored = counted.join(F.broadcast(stats))  # one row is broadcast
    return [scored.filter(f"_keep{n}").select(tie, F.coalesce(score, F.lit(0.0)).alias("score")) for n in range(len(keeps))]


def _equals(term: str):
    return lambda x: x == term


def postings(chunks: DataFrame, text: str = "content", tie: str = "chunk_id") -> DataFrame:
    """(term, chunk_id, tf): the inverted index as a table."""
    return chunks.select(tie, F.explode(T.tokens(F.col(text))).alias("term")).groupBy("term", tie).agg(F.count("*").alias("tf"))


def term_stats(index: DataFrame, n_chunks: int) -> DataFrame:
    df = F.count("*")
    return index.groupBy("term").agg(df.alias("df"), F.sum("tf").alias("cf"), F.ln(1 + (n_chunks - df + 0.5) / (df + 0.5)).alias("idf"))


def bm25_indexed(index: DataFrame, lengths: DataFrame, query: str, tie: str = "chunk_id") -> DataFrame:
    """BM25 from a stored inverted index: only the query's postings are read. They and the lengths are written, as both are used twice."""
    wanted = {t: query_tokens(query).count(t) for t in dict.fromkeys(query_tokens(query))}
    if not wanted:
        return lengths.select(tie, F.lit(0.0).alias("score")).limit(0)
    times = F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])
    hits, lengths = cut(index.filter(F.col("term").isin(*wanted))), cut(lengths)
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    corpus = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avg"))
    tf, idf = F.col("tf"), F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = times[F.col("term")] * idf * tf * (D.BM25_K1 + 1) / (tf + D.BM25_K1 * (1 - D.BM25_B + D.BM25_B * F.col("dl") / F.col("avg")))
    # a row for each word of the query, and one for the corpus
    return hits.join(F.broadcast(df), "term").join(lengths, tie).join(F.broadcast(corpus)).groupBy(tie).agg(F.sum(part).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v at length 1; a zero vector stays."""
    length = F.sqrt(dot(v, v))
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine(chunks: DataFrame, query: list[float], vector: str = "vector", keep: Column | None = None, tie: str = "chunk_id", also: list[str] = ()) -> DataFrame:
    """(chunk_id, score, and columns of also) by cosine to a vector; rows without a vector or with a score that is no number don't come out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = chunks.filter(F.col(vector).isNotNull())
    if keep is not None:
        rows = rows.filter(keep)
    out = rows.select(tie, dot(unit(F.col(vector)), unit(q)).alias("score"), *also)
    return out.filter(F.col("score").isNotNull() & ~F.isnan("score"))


def top_vectors(scored: DataFrame, k: int, tie: str = "chunk_id") -> DataFrame:
    """The k rows of greatest cosine, whatever its sign; ties to the smaller id."""
    return scored.orderBy(F.col("score").desc(), F.col(tie)).limit(k)


def embed(chunks: DataFrame, vectors: DataFrame, text: str = "content", tie: str = "chunk_id", dims: int = 64, prefix: str | None = None) -> DataFrame:
    """(chunk_id, vector): the mean of the token vectors (token, vector), at length 1; zero without known tokens; none for texts over the limit."""
    whole = F.concat_ws("\n", prefix, text) if prefix else F.coalesce(F.col(text), F.lit(""))
    rows = chunks.select(tie, whole.alias("_text"), (F.octet_length(whole) <= D.EMBED_BYTES).alias("_fits"))
    vectors = cut(vectors)
    known = F.broadcast(vectors.select("token"))  # the words of a vocabulary
    # a text's known tokens go to one task, where they are counted and its vectors added up
    said = rows.filter("_fits").select(tie, F.explode(T.tokens(F.col("_text"))).alias("token")).join(known, "token", "left_semi").groupBy(tie, "token").agg(F.count("*").alias("times"))
    met = said.join(vectors, "token").groupBy(tie).agg(F.array_sort(F.collect_list(F.struct("token", "times", F.col("vector").cast("array<double>").alias("v")))).alias("_w"))
    add = lambda sums, w: F.zip_with(sums, w["v"], lambda a, x: F.coalesce(a, F.lit(0.0)) + w["times"] * x)
    total = F.aggregate("_w", F.lit(0).cast("long"), lambda n, w: n + w["times"])
    mean = met.select(tie, F.transform(F.aggregate("_w", F.expr("CAST(array() AS ARRAY<DOUBLE>)"), add), lambda x: x / total).alias("_v"))
    zero = F.array_repeat(F.lit(0.0), dims)
    return rows.join(mean, tie, "left").select(tie, F.when(F.col("_fits"), unit(F.coalesce("_v", zero))).alias("vector"))


def alpha_of(query: str, alpha: float | None = None) -> float:
    """The weight of the vectors: as given, else by whether the query names code."""
    if alpha is not None:
        return alpha
    q = query.strip()
    symbol = re.fullmatch(r"[\\A-Za-z_]\w*((::|->|\.|\\)[A-Za-z_]\w*)+|_\w*|[A-Za-z0-9]+(_[A-Za-z0-9]*)+|[A-Z][A-Za-z0-9]*|[a-z]+[A-Z][A-Za-z0-9]*", q, re.ASCII)
    return D.ALPHA_SYMBOL if symbol else D.ALPHA_TEXT


def rrf(scored: DataFrame, tie: str = "chunk_id") -> DataFrame:
    """(chunk_id, rr): 1 / (60 + rank). The input is a candidate pool of bounded size."""
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), F.col(tie)))
    return scored.select(tie, (1 / (D.RRF_K + rank)).alias("rr"))


def combine(semantic: DataFrame, lexical: DataFrame, alpha: float, tie: str = "chunk_id", value: str = "rr") -> DataFrame:
    """alpha * semantic + (1 - alpha) * lexical over all ids of both; what one lacks is 0."""
    a, b = semantic.select(tie, (alpha * F.col(value)).alias("s")), lexical.select(tie, ((1 - alpha) * F.col(value)).alias("s"))
    return a.unionByName(b).groupBy(tie).agg(F.sum("s").alias("score"))


def coherence(scored: DataFrame, file: str = "file_path", tie: str = "chunk_id") -> DataFrame:
    """Adds to the best chunk of each file 0.2 * max * (the file's sum / the greatest sum)."""
    of_file = Window.partitionBy(file)
    best = F.row_number().over(of_file.orderBy(F.col("score").desc(), F.col(tie))) == 1
    summed = cut(scored.withColumn("_best", best).withColumn("_sum", F.sum("score").over(of_file)))
    most = summed.agg(F.max("score").alias("_max"), F.max("_sum").alias("_max_sum"))
    boost = F.when(F.col("_best") & (F.col("_max_sum") > 0), D.COHERENCE * F.col("_max") * F.col("_sum") / F.col("_max_sum")).otherwise(0.0)
    return summed.join(F.broadcast(most)).withColumn("score", F.col("score") + boost).drop("_best", "_sum", "_max", "_max_sum")


def file_prior(outline_semantic: DataFrame, outline_lexical: DataFrame, files: DataFrame, tie: str = "chunk_id", file: str = "file_path") -> DataFrame:
    """(file_path, prior): the greatest fused score of a file's outline chunks, over the greatest of all."""
    fused = combine(rrf(top(outline_semantic, D.PRIOR_POOL)), rrf(top(outline_lexical, D.PRIOR_POOL)), 0.5)
    each = cut(files.select(tie, file).join(F.broadcast(fused), tie).groupBy(file).agg(F.max("score").alias("s")))  # two pools' rows are broadcast
    return each.join(F.broadcast(each.agg(F.max("s").alias("m")))).select(file, (F.col("s") / F.col("m")).alias("prior"))


def with_prior(scored: DataFrame, prior: DataFrame, file: str = "file_path") -> DataFrame:
    return scored.join(prior, file, "left").withColumn("score", F.col("score") * (1 + D.PRIOR_WEIGHT * F.coalesce("prior", F.lit(0.0)))).drop("prior")


_DEFINES = r"(?m)(?:^|[^\w.])(?:fn|def|class|struct|enum|trait|interface|impl|type|func|function|module|object|record|protocol|union|macro_rules!|const|let|var|val)\s+(?:[A-Za-z_]\w*\s*::\s*)?"


def definition_boost(scored: DataFrame, all_chunks: DataFrame, symbol: str, keep: Column | None = None, file: str = "file_path", tie: str = "chunk_id") -> DataFrame:
    """A symbol's definition gains 3 * max, half as much again where the file bears its name; such files' definitions join even if no candidates."""
    bare = re.split(r"::|->|\.|\\", symbol.strip())[-1]
    defines = F.col("content").rlike(_DEFINES + re.escape(bare) + r"\b")
    named = F.lower(F.regexp_replace(T.stem(F.col(file)), "_", "")) == bare.lower().replace("_", "")
    most = scored.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("_max"))
    allowed = keep if keep is not None else F.lit(True)
    fresh = all_chunks.filter(named & defines & allowed).join(F.broadcast(scored.select(tie)), tie, "left_anti").select(*[c for c in scored.columns if c != "score"]).withColumn("score", F.lit(0.0))
    both = scored.unionByName(fresh.select(*scored.columns))
    boost = F.when(defines, D.DEFINITION_BOOST * F.col("_max") * F.when(named, D.STEM_FACTOR).otherwise(1.0)).otherwise(0.0)
    return both.join(F.broadcast(most)).withColumn("score", F.col("score") + boost).drop("_max")


def embedded_symbol_boost(scored: DataFrame, query: str, file: str = "file_path") -> DataFrame:
    """In a query of words, identifiers count half of what a symbol query's would, by definition or by the start of the file's name."""
    symbols = [w for w in re.findall(T.IDENTIFIER, query) if "_" in w.strip("_") or re.search(r"[a-z][A-Z]", w)]
    most, boost = scored.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("_max")), F.lit(0.0)
    for s in symbols:
        defines = F.col("content").rlike(_DEFINES + re.escape(s) + r"\b")
        stem = F.lower(F.regexp_replace(T.stem(F.col(file)), "_", ""))
        near = F.lit(s.lower().replace("_", "")).startswith(stem) & (F.length(stem) >= D.STEM_LETTERS)
        boost = boost + F.when(defines, D.EMBEDDED_SCALE * D.DEFINITION_BOOST * F.col("_max") * F.when(near, D.STEM_FACTOR).otherwise(1.0)).otherwise(0.0)
    return scored.join(F.broadcast(most)).withColumn("score", F.col("score") + boost).drop("_max")


def keyword_boost(scored: DataFrame, query: str, file: str = "file_path") -> DataFrame:
    """Adds max * matches / keywords where a tenth of the keywords at least name the file or its folder, or begin alike."""
    words = [w for w in dict.fromkeys(w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9]*", query)) if w not in T.STOP_WORDS and len(w) > 1]
    if not words:
        return scored
    folder = F.coalesce(F.get(F.reverse(F.split(F.col(file), "/")), F.lit(1)), F.lit(""))
    parts = F.transform(F.concat(T.tokens(T.stem(F.col(file))), T.tokens(folder)), F.lower)
    hit = lambda w: F.exists(parts, lambda p: (p == w) | ((F.least(F.length(p), F.lit(len(w))) >= D.PREFIX_LETTERS) & (p.startswith(w) | F.lit(w).startswith(p))))
    ratio = reduce(lambda a, b: a + b, [F.when(hit(w), 1).otherwise(0) for w in words]) / len(words)
    most = scored.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("_max"))
    return scored.join(F.broadcast(most)).withColumn("score", F.col("score") + F.when(ratio >= D.KEYWORD_RATIO, F.col("_max") * ratio).otherwise(0.0)).drop("_max")


def without_covered(scored: DataFrame, file: str = "file_path") -> DataFrame:
    """Leaves out enclosing chunks of which a part is a candidate too."""
    parts = scored.filter("kind = 'part'").select(F.col(file).alias("_f"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e"))
    inside = (F.col(file) == F.col("_f")) & (F.col("_s") >= F.col("start_line")) & (F.col("_e") <= F.col("end_line"))
    covered = scored.filter("kind = 'enclosing'").join(parts, inside, "left_semi").select("chunk_id")
    return scored.join(covered, "chunk_id", "left_anti")


def saturate(scored: DataFrame, k: int, file: str = "file_path", tie: str = "chunk_id") -> DataFrame:
    """Each further chunk of a file counts half of the one before, in order of penalised score; then the k best."""
    turn = F.row_number().over(Window.partitionBy(file).orderBy(F.col("score").desc(), F.col(tie)))
    return top(scored.withColumn("score", F.col("score") * F.pow(F.lit(D.DECAY), turn - 1)), k, tie=tie)


def rerank(scored: DataFrame, k: int, file: str = "file_path") -> DataFrame:
    """Penalties of path and kind, suppression of covered chunks, saturation, top k."""
    kind = F.when(F.col("kind") == "enclosing", 0.7).when(F.col("kind") == "outline", 0.8).otherwise(1.0)
    return saturate(without_covered(scored.withColumn("score", F.col("score") * T.path_penalty(F.col(file)) * kind), file), k, file)


@dataclass
class Query:
    """A query's text with its filters; values of one field are alternatives, fields must all hold."""

    text: str
    lang: list[str] = field(default_factory=list)
    path: list[str] = field(default_factory=list)
    name: list[str] = field(default_factory=list)

    def mask(self, file: str = "file_path", language: str = "language", crumb: str = "breadcrumb", scope: str | None = None) -> Column:
        any_ = lambda tests: reduce(lambda a, b: a | b, tests)
        out = F.lit(True)
        if self.lang:
            out = out & F.lower(F.col(language)).isin(*self.lang)
        if self.path:
            out = out & any_([F.contains(F.lower(F.col(file)), F.lit(p)) for p in self.path])
        if self.name:
            out = out & any_([F.contains(F.lower(F.coalesce(F.col(crumb), F.lit(""))), F.lit(n)) for n in self.name])
        if scope:
            out = out & T.under(F.col(file), F.lit(scope))
        return F.coalesce(out, F.lit(False))


def parse_query(query: str) -> Query:
    """Takes lang:, language:, path: and name: with a value out of a query; quotes keep spaces; any other prefix is text."""
    out, rest = Query(""), []
    for word in re.findall(r'(?:[^\s"]|"[^"]*")+', query):
        m = re.fullmatch(r'(lang|language|path|name):("?)(.+?)\2', word)
        if m:
            getattr(out, {"language": "lang"}.get(m[1], m[1])).append(m[3].lower())
        else:
            rest.append(word)
    out.text = " ".join(rest)
    return out


def search(chunks: DataFrame, query: str, query_vector: list[float] | None = None, k: int = D.TOP_K, alpha: float | None = None, scope: str | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Hybrid search: fuse, coherence, file prior, query boosts, rerank.

    chunks: chunk_id, content, file_path, language, breadcrumb, kind, start_line, end_line, and vector unless vectors
    (chunk_id, vector) are a table of their own. Filters never change the corpus statistics and hold for chunks that a
    boost brings in. The pool does not depend on k up to 100. Texts are read once for the counts and once for the pool.
    """
    q = parse_query(query)
    mask, weight = q.mask(scope=scope), alpha_of(q.text, alpha)
    pool, outlines = max(D.POOL, k), F.col("kind") == "outline"
    lexical, lexical_outlines = bm25_masks(chunks, q.text, [mask, mask & outlines])
    lexical = top(lexical, pool)
    if query_vector is not None:
        facts = chunks.select("chunk_id", mask.alias("_mask"), outlines.alias("_outline"), *(["vector"] if vectors is None else [])).filter("_mask")
        near = cosine(facts if vectors is None else facts.join(vectors, "chunk_id"), query_vector, also=["_outline"])
        semantic, semantic_outlines = top_vectors(near.drop("_outline"), pool), near.filter("_outline").drop("_outline")
    else:
        semantic = semantic_outlines = lexical.limit(0)
    fused = combine(rrf(semantic), rrf(lexical), weight)
    rows = chunks.select("chunk_id", "content", "file_path", "kind", "start_line", "end_line")
    scored = coherence(rows.join(F.broadcast(fused), "chunk_id"))  # two pools' rows are broadcast
    scored = with_prior(scored, file_prior(semantic_outlines, lexical_outlines, chunks))
    if weight == D.ALPHA_SYMBOL and alpha is None:
        scored = definition_boost(scored, chunks, q.text, mask)
    else:
        scored = keyword_boost(embedded_symbol_boost(scored, q.text), q.text)
    return rerank(scored, k)


def chunk_at(chunks: DataFrame, path: str, line: int) -> DataFrame:
    """The first chunk of a file with start <= line < end, else the last that ends in the line."""
    inside, edge = (F.col("start_line") <= line) & (F.col("end_line") > line), F.col("end_line") == line
    order = F.when(inside, F.col("chunk_id")).otherwise(-F.col("chunk_id"))
    return chunks.filter((F.col("file_path") == path) & (inside | edge)).orderBy(F.when(inside, 0).otherwise(1), order).limit(1)


def related(chunks: DataFrame, seed: int, k: int = D.TOP_K, depths: DataFrame | None = None, scope: str | None = None) -> DataFrame:
    """Chunks of the seed's language nearest to its vector; those of files one or two dependencies away gain. depths: (file_path, depth)."""
    s = chunks.filter(F.col("chunk_id") == seed).select("vector", "language").first()
    if s is None or s["vector"] is None:
        return chunks.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    keep = (F.col("language").eqNullSafe(s["language"])) & (F.col("chunk_id") != seed)
    if scope:
        keep = keep & T.under(F.col("file_path"), F.lit(scope))
    pool = top_vectors(cosine(chunks, s["vector"], keep=keep), D.RELATED_POOL * k)
    if depths is not None:
        near = pool.join(chunks.select("chunk_id", "file_path"), "chunk_id").join(depths, "file_path", "left")
        factor = reduce(lambda rest, d: F.when(F.col("depth") == d, D.RELATED_BOOST[d]).otherwise(rest), D.RELATED_BOOST, F.lit(1.0))
        pool = near.select("chunk_id", (F.col("score") * factor).alias("score"))
    return top_vectors(pool, k)
