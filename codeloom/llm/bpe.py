"""Byte-level BPE encoding and decoding over Arrow batches.

A text is cut into pieces by the vocabulary's pattern; each piece's bytes are
mapped to printable characters, one for each byte, and the tokenizers library's
BPE model merges those. Decoding maps every character of a token back to its byte
and joins the bytes, so characters split over several tokens come out whole.

Null texts count as empty: no tokens, and the digest of nothing. Very long texts
are taken whole. Rows are independent, so ties, repeated rows and empty tables
need no rule; one row comes out for each row in. Input columns other than those
named are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unicode White_Space. Between another character and one of these a piece always ends,
#: so what lies between two such places can be encoded once and remembered.
WHITE = "\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Bytes, about, of recent chunks that a worker remembers, and as many of older ones; which are forgotten changes no result.
REMEMBERED = 96_000_000
#: What a remembered chunk takes besides its characters and ids.
_EACH = 250


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 0x100
    for b in range(256):
        if b in prints:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class ByteBPE:
    """A vocabulary of byte strings with ranks, as the tokenizers library's BPE model and as a table of bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        from tokenizers import Tokenizer, models

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.chars = byte_chars()
        self.to_char = {b: ord(c) for b, c in enumerate(self.chars)}
        self.to_byte = {c: b for b, c in self.to_char.items()}
        self.pattern = regex.compile(pattern)
        word = lambda token: "".join(self.chars[b] for b in token)
        merges = []
        for token in sorted(ranks, key=ranks.get):
            cuts = [(ranks[token[:i]], ranks[token[i:]], i) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
            merges += [(word(token[:i]), word(token[i:])) for _, _, i in sorted(cuts)]
        self.model = models.BPE(vocab={word(t): i for t, i in ranks.items()}, merges=merges)
        self.tokenizer = Tokenizer(self.model)
        self.shown = [self.tokenizer.id_to_token(i) for i in range(max(ranks.values(), default=-1) + 1)]  # None: no such id
        self.held = 0
        self.recent: dict[str, tuple[bytes, int, bytes]] = {}
        self.older: dict[str, tuple[bytes, int, bytes]] = {}

    def ids_of(self, pieces: list[str]) -> list[list[int]]:
        mapped = [p.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_char) for p in pieces]
        return [e.ids for e in self.tokenizer.encode_batch_fast(mapped, add_special_tokens=False)]

    def encode(self, text: str | None) -> list[int]:
        return [i for ids in self.ids_of(self.pattern.findall(text or "")) for i in ids]

    def decode_bytes(self, ids) -> bytes:
        """The characters of the tokens, each turned back to its byte. Characters of a text that are split over tokens come out whole."""
        return "".join([self.shown[i] for i in ids]).translate(self.to_byte).encode("latin-1")

    def offsets(self, text: str | None, ids: list[int]) -> list[tuple[int, int]]:
        """For each token the characters of the text that its bytes lie in, end not included; a character split over tokens belongs to each."""
        starts = [0, *accumulate(len(c.encode("utf-8", "surrogatepass")) for c in text or "")]
        out, at = [], 0
        for i in ids:
            end = at + len(self.shown[i])  # a character for each byte
            out.append((bisect_right(starts, at) - 1, bisect_right(starts, end - 1)))
            at = end
        return out

    def learn(self, chunks: set[str]) -> None:
        """Encodes chunks that are not remembered, their distinct pieces in one call."""
        if self.held >= REMEMBERED:
            self.recent, self.older, self.held = {}, self.recent, 0
        todo = []
        for c in chunks.difference(self.recent):
            if (got := self.older.get(c)) is not None:
                self.recent[c] = got
                self.held += _EACH + 2 * len(c) + len(got[0])
            else:
                todo.append(c)
        cut = [self.pattern.findall(c) for c in todo]
        distinct = list({p for pieces in cut for p in pieces})
        ids = dict(zip(distinct, self.ids_of(distinct), strict=True))
        for c, pieces in zip(todo, cut, strict=True):
            got = [i for p in pieces for i in ids[p]]
            self.recent[c] = (",".join(map(str, got)).encode(), len(got), self.decode_bytes(got))
            self.held += _EACH + 2 * len(c) + len(self.recent[c][0])

    def digests(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """For each text the count of ids, SHA-256 of the ids in decimal joined by commas, SHA-256 of what the ids decode to."""
        cut = [_CHUNK.findall(t or "") for t in texts]
        self.learn({c for chunks in cut for c in chunks})
        for chunks in cut:
            found = [self.recent[c] for c in chunks]
            csv, back = b",".join([x[0] for x in found]), b"".join([x[2] for x in found])
            yield csv.count(b",") + 1 if found else 0, hashlib.sha256(csv).hexdigest(), hashlib.sha256(back).hexdigest()


@lru_cache(maxsize=2)
def _loaded(content: bytes, pattern: str) -> ByteBPE:
    return ByteBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}, pattern)


def _vocabulary(path: str, pattern: str):
    """Reads the vocabulary on the driver and sends it along: executors need no file. It is of fixed size, under 1 MB."""
    with open(path, "rb") as f:
        content = f.read()
    return lambda: _loaded(content, pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", offsets: str = "offsets") -> DataFrame:
    """df with the token ids of each text and the character offsets (start, end) of each token; columns of these names are replaced."""
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    rest = df.drop(ids, offsets)
    span = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
    schema = StructType([*rest.schema.fields, StructField(ids, ArrayType(IntegerType())), StructField(offsets, ArrayType(span))])
    load, kinds = _vocabulary(path, pattern), (pa.list_(pa.int32()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load()
        for batch in batches:
            texts = batch.column(text).to_pylist()
            got = [bpe.encode(t) for t in texts]
            spans = [[{"start": a, "end": b} for a, b in bpe.offsets(t, i)] for t, i in zip(texts, got, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, kinds[0]), pa.array(spans, kinds[1])], names=[*batch.schema.names, ids, offsets])

    return rest.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes that the ids stand for. Null ids give null; an id out of the vocabulary is an error."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    rest = df.drop(out)
    load = _vocabulary(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load()
        for batch in batches:
            got = [None if i is None else bpe.decode_bytes(i) for i in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], names=[*batch.schema.names, out])

    return rest.mapInArrow(run, StructType([*rest.schema.fields, StructField(out, BinaryType())]))


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every text: it is encoded, and the ids are decoded again."""
    load = _vocabulary(path, pattern)
    slim = df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, ids, back = zip(*bpe.digests(part.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return slim.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
