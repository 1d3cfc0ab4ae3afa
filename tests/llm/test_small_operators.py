import base64
import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from codeloom.llm import bpe, exact_dedup, mixing, pii, revisit, shard

from .helpers import edge_docs, no_docs, table

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WHITE = re.compile(r"[\x20\x09-\x0D]")


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected_tokens(tik, text):
    ids = tik.encode_ordinary(text or "")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(ids), sha(",".join(map(str, ids)).encode()), sha(tik.decode_bytes(ids))


def test_bpe_round_trip_agrees_with_tiktoken(spark, tik):
    df = table(spark, "documents")
    texts = {r.doc_id: r.text for r in df.collect()}
    got = bpe.round_trip(df, PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected_tokens(tik, texts[r.doc_id])


def test_bpe_edges(spark, tik):
    odd = ["  a  b \n\n c", "\x1cx\x1c", "a b", "👩‍👩‍👧 familie", "don't I'LL\r\n", "1234567 12", "\u0000 x", " ", "é" * 50_000, "<|endoftext|>"]
    df = edge_docs(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(100 + n, t) for n, t in enumerate(odd)], "doc_id long, text string"))
    want = sorted((r.doc_id is None, r.doc_id or 0, *expected_tokens(tik, r.text)) for r in df.collect())
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(df, PATH, public_tokenizers.PATTERN).collect())
    assert got == want
    assert bpe.round_trip(no_docs(spark), PATH, public_tokenizers.PATTERN).collect() == []


def test_bpe_offsets_and_decode(spark, tik):
    df = spark.createDataFrame([(1, "Ünïcode 👩‍👧 x"), (2, None)], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    out = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    rows = {r.doc_id: r for r in out.collect()}
    text = rows[1].text
    assert bytes(rows[1].decoded).decode() == text and rows[1].ids == tik.encode_ordinary(text)
    assert rows[2].ids == [] and bytes(rows[2].decoded) == b""
    spans = [(s.start, s.end) for s in rows[1].offsets]
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a < z for a, z in spans)
    for (_, z), (a, _) in zip(spans, spans[1:]):
        assert a in (z, z - 1)  # a character split over tokens belongs to both


def brute_exact(rows):
    groups = defaultdict(list)
    for n, (doc, text) in enumerate(rows):
        groups[WHITE.sub("", text or "")].append((-len(text or ""), doc is None, doc or 0, n))
    out = []
    for content, members in groups.items():
        best = min(members)
        for m in members:
            out.append((rows[m[3]][0], rows[best[3]][0], len(members), m == best, hashlib.sha256(content.encode()).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(F.sha2(c, 256), 1, 1), lambda c: F.lit("same")], ids=["sha256", "clashing", "constant"])
def test_exact_dedup_compares_content(spark, digest):
    df = edge_docs(spark).select("doc_id", "text", "size").unionByName(
        spark.createDataFrame([(50, "x y"), (51, "xy"), (52, " x\ty "), (53, "x y"), (54, "z"), (-7, "z")], "doc_id long, text string").withColumn("size", F.lit("s"))
    )
    want = brute_exact([(r.doc_id, r.text) for r in df.collect()])
    got = sorted(repr((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in exact_dedup.decisions(df, digest=digest).collect())
    assert got == want


def test_exact_dedup_keeps_one_of_each(spark):
    df = edge_docs(spark)
    kept = exact_dedup.kept(df)
    assert kept.columns == df.columns
    assert sorted(WHITE.sub("", r.text or "") for r in kept.collect()) == sorted({WHITE.sub("", r.text or "") for r in df.collect()})
    assert exact_dedup.decisions(no_docs(spark)).collect() == [] and exact_dedup.kept(no_docs(spark)).collect() == []


def brute_targets(sizes, weights, epochs):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[n % len(weights)] for n, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(epochs * sizes[s] for s in capped)) / sum(w[s] for s in free) if free else 0
        over = {s for s in free if level * w[s] > epochs * sizes[s]}
        if not over:
            return {s: epochs * sizes[s] if s in capped else level * w[s] for s in names}
        capped |= over


def check_mix(df):
    rows = mixing.mix(df).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = brute_targets(dict(sizes), mixing.WEIGHTS, mixing.EPOCHS)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    return rows


def test_mixing(spark):
    rows = check_mix(table(spark, "documents"))
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(table(spark, "documents").repartition(7)).collect()))
    check_mix(edge_docs(spark))
    assert mixing.mix(no_docs(spark)).collect() == []
    skew = [(n, "w " * 100, "a") for n in range(5)] + [(100 + n, "w w", s) for n, s in enumerate("bcdef")] + [(200, "", "g")]
    check_mix(spark.createDataFrame(skew, "doc_id long, text string, source string"))


def test_mixing_repeats_documents(spark):
    df = table(spark, "documents")
    taken = {r.doc_id: r.taken for r in mixing.mix(df).collect()}
    words = defaultdict(int)
    for r in mixing.repeated(df).collect():
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert dict(words) == {k: v for k, v in taken.items() if v}
    assert mixing.repeated(df).columns == df.columns


@pytest.mark.parametrize("range_rows", [10, 1_000_000])
def test_histogram_shards(spark, range_rows):
    df = table(spark, "documents")
    rows = shard.shard(df, range_rows=range_rows).collect()
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert len(rows) == df.count() and set(slots) <= set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in rows)
    assert max(abs(b - sum(sizes.values()) / 24) for b in sizes.values()) <= largest + sum(sizes.values()) * 0.001


def test_shards_split_copies_and_edges(spark):
    copies = spark.range(960).select(F.col("id").alias("doc_id"), F.lit("one text").alias("text"))
    sizes = shard.shard(copies).groupBy("shard").count().collect()
    assert len(sizes) == 24 and {r["count"] for r in sizes} == {40}
    repeated = spark.range(480).select(F.lit(7).cast("long").alias("doc_id"), F.lit("t").alias("text"))
    assert {r["count"] for r in shard.shard(repeated).groupBy("shard").count().collect()} == {20}
    odd = shard.shard(edge_docs(spark), carry=("lang", "label")).collect()
    assert len(odd) == 8 and all(r.law == "bytes" and r.grown_shard is None and r.label == "x" for r in odd)
    assert {(r["size"], r.text_crc32) for r in odd if r.doc_id in (2, 3)} == {(8, 0)}
    assert shard.shard(no_docs(spark)).collect() == []


def test_pii_surrogates(spark):
    texts = [
        (1, "Mail anna.12@mail9.example.com or ANNA.12@MAIL9.EXAMPLE.COM!! call +1 (555) 123-4567, +1 555 123 4567."),
        (2, 'token = "12ab34cd12ab34cd12ab34cd12ab34cd12ab34cd" ip 10.0.200.7. card 4111111111111111!!'),
        (3, "Mr. John Smith met Mrs. Anna Smith and Mr. Smith; Г-жа Анна Иванова"),
        (4, None), (5, ""), (6, "nothing in Version 2.0. of 3.5.6 a.b@c"), (6, "nothing in Version 2.0. of 3.5.6 a.b@c"),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("n_replaced", F.lit("clash")).withColumn("key", F.lit("k"))
    got = defaultdict(list)
    for r in pii.replace_pii(df, "secret").collect():
        got[r.doc_id].append(r)
    one = got[1][0].text
    small, big = re.findall(r"[\w.]+@[\w.]+", one)
    assert small == big.lower() and small != "anna.12@mail9.example.com" and small.endswith(".com")
    a, b = re.search(r"call (.*), (.*)\.$", one).groups()
    assert re.fullmatch(r"\+\d \(\d{3}\) \d{3}-\d{4}", a) and re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "15551234567"
    two = got[2][0].text
    assert re.fullmatch(r'token = "[0-9a-f]{40}" ip \d{2}\.\d\.\d{3}\.\d\. card 4\d{15}!!', two) and "12ab34cd" not in two and "4111111111111111" not in two
    three = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+) and Mr\. (\w+); Г-жа (\w+) (\w+)", got[3][0].text).groups()
    assert three[1] == three[3] == three[4] != "Smith"
    assert three[0] in pii._GIVEN["latin m"] and three[2] in pii._GIVEN["latin f"] and re.fullmatch(r"[а-яА-Я]+", three[5] + three[6])
    assert got[4][0].text is None and got[5][0].text == "" and len(got[6]) == 2
    assert all(r.text == texts[5][1] and r.n_replaced == 0 for r in got[6])
    assert pii.replace_pii(no_docs(spark), "k").collect() == []


def test_surrogates_stay_distinct_in_small_formats(spark):
    ips = [("ip", f"{a}.{b}.1.1") for a in range(1, 10) for b in range(1, 10)]
    crowd = spark.createDataFrame([*ips, *[("given m", f"name{n}") for n in range(60)], *[("ssn", f"{n:09d}") for n in range(200)]], "kind string, value string")
    rows = pii.surrogates(crowd, "k").collect()
    assert len(rows) == 81 + 60 + 200
    assert len({(r.kind, r.surrogate) for r in rows}) == len(rows)
    assert not {(r.kind, r.surrogate) for r in rows} & {(r.kind, r.value) for r in rows}


def test_pii_leaves_no_original_in_documents(spark):
    df = table(spark, "documents").select("doc_id", "text")
    said = {r.mention for r in pii.mentions(df, "text", F.col("doc_id")).collect()}
    after = pii.replace_pii(df, "k").select("text").collect()
    assert said and not [m for m in said for r in after if m in r.text]


def test_canonical_urls(spark):
    urls = {
        "http://WWW.Example.com:80/a/?utm_source=feed&b=2&a=1#top": "example.com/a?a=1&b=2",
        "https://example.com/a?a=1&b=2": "example.com/a?a=1&b=2",
        "https://example.com": "example.com",
        "https://m.example.com/x.html": "m.example.com/x.html",
        "": "",
    }
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.c for r in df.select("u", revisit.canonical_url(F.col("u")).alias("c")).collect()} == urls


CAPTURES = "record_id long, url string, ts long, full boolean, etag string, last_modified string, headers map<string,string>, digest string, status string"


def test_revisits(spark):
    rows = [
        (1, "http://a.com/", 10, True, "x", "mon", {"ETag": "x", "Content-Type": "text/html", "Cache-Control": "old"}, "d1", "s"),
        (2, "https://www.a.com", 20, True, "y", "tue", {"ETag": "y"}, "d2", "s"),
        (3, "a.com", 15, False, "W/x", None, {"etag": "W/x", "Content-Type": "bad", "cache-control": "new"}, None, "s"),
        (4, "a.com", 25, False, "x", None, None, None, "s"),
        (5, "a.com", 5, False, "x", None, {}, None, "s"),
        (6, "a.com", 30, False, None, "tue", {}, None, "s"),
        (7, "a.com", 30, False, None, None, {}, None, "s"),
        (8, None, 30, False, "x", None, {}, None, "s"),
        (9, "b.com", None, False, "x", None, {}, None, "s"),
        (9, "b.com", None, False, "x", None, {}, None, "s"),
        (10, None, 1, True, "x", "mon", {}, "d", "s"),
    ]
    got = {r.record_id: r for r in revisit.resolve(spark.createDataFrame(rows, CAPTURES)).collect()}
    assert {k: (r.status, r.response_id) for k, r in got.items()} == {
        3: ("resolved", 1), 4: ("mismatch", 2), 5: ("no_response", None), 6: ("resolved", 2), 7: ("unverified", 2), 8: ("no_response", None), 9: ("no_response", None),
    }
    assert got[3].headers == {"etag": "W/x", "content-type": "text/html", "cache-control": "new"} and got[3].response_digest == "d1"
    assert got[4].headers is None
    assert revisit.resolve(spark.createDataFrame([], CAPTURES)).collect() == []


def test_revisits_of_a_hot_url(spark):
    rows = [(n, "hot.com", n, n % 7 == 0, f"e{n}", None, {}, None, "s") for n in range(3000)]
    got = revisit.resolve(spark.createDataFrame(rows, CAPTURES).repartition(5)).collect()
    assert {(r.record_id, r.response_id) for r in got} == {(n, n // 7 * 7) for n in range(3000) if n % 7}


def test_mixing_repeats_rows_with_null_and_repeated_ids(spark):
    df = edge_docs(spark)
    df = df.unionByName(df.filter("doc_id = 1").withColumn("text", F.lit("another text of the same id and source")))
    want, got = Counter(), Counter()
    for r in mixing.mix(df).filter("taken > 0").collect():
        want[r.doc_id, r.source] += r.taken
    out = mixing.repeated(df)
    for r in out.collect():
        got[r.doc_id, r.source] += len(r.text.split())
    assert got == want and got[None, "books"] > 0 and out.columns == df.columns


def test_exact_dedup_keeps_texts_that_share_a_digest(spark):
    """With a digest of the first letter alone, content tells texts apart."""
    rows = [(1, "ab"), (2, "a b"), (3, "ac"), (4, "a c "), (5, None), (6, ""), (None, "ac"), (7, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = exact_dedup.kept(df, digest=lambda c: F.substring(c, 1, 1))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 7] == sorted(r.doc_id for r in exact_dedup.kept(df).collect())


def test_pii_takes_very_long_texts(spark):
    texts = ["a@b" + ".c" * 3_000, "x" * 1_000_000, "1 " * 300_000, "Mr " + "A" * 3_000, "a" * 3_000 + "@b.org"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replace_pii(df, "k").collect()}
    assert got[0].n_replaced == 1 and got[1].text == texts[1] and len(got) == 5


def test_bpe_decodes_by_its_table_of_characters():
    """A vocabulary of single bytes and a few merges: every byte comes back, split characters too."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, "é".encode(): 257, b" a": 258}
    coder = bpe.ByteBPE(ranks, public_tokenizers.PATTERN)
    assert coder.decode_bytes(range(256)) == bytes(range(256))
    for text in ("ab é €uro \U0001f600", "", "\x00\x7f\xa0"):
        ids = coder.encode(text)
        assert coder.decode_bytes(ids) == text.encode() and len(coder.offsets(text, ids)) == len(ids)
    assert len(coder.encode("€")) == 3 and coder.offsets("€", coder.encode("€")) == [(0, 1)] * 3
