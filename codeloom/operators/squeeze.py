"""Reversible compression of logs and other repetitive text.

Stages, in this order: leading zeros are cut; the commonest minute of ISO times becomes
``#T#``; ``[Tag]`` words and then ``key=`` words that occur more than once become
``#0#``, ``#1#`` ...; adjacent pieces of lines are merged while that saves enough;
merged tags are merged again (``!1!`` ...); lines that are alike but for one tag share a
template (``&1:``); equal lines in a row are counted. A legend restores everything but
what zero trimming, line counting and blank lines drop.

Dictionaries are DataFrame operations over all lines of each document; merging is
sequential by nature and runs in one Arrow call for each document.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import base62

ZEROS = ((r"\b0x0+([0-9a-fA-F]+)\b", "0x$1"), (r"(^|[\s=,\[(])0+([1-9]\d*)\b", "$1$2"), (r"(\.\d*[1-9])0+\b", "$1"), (r"(\d)\.0+\b", "$1"))
MINUTE = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:"
TAGS, KEYS = r"\[[A-Za-z][A-Za-z0-9_]*\]", r"[A-Za-z_][A-Za-z0-9_]*==?"
STAMP = "#T#"
MAX_MERGES, MAX_GRAM, MAX_META = 100, 20, 15
FLOOR_MARK = "---\n"


def trim_zeros(text: Column) -> Column:
    for pattern, put in ZEROS:
        text = F.regexp_replace(text, pattern, put)
    return text


def common_minute(df: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """(doc, minute): the commonest minute of each document, of equal ones the first."""
    said = df.select(doc, F.explode(F.regexp_extract_all(F.col(text), F.lit(MINUTE), F.lit(0))).alias("minute")).groupBy(doc, "minute").agg(F.count("*").alias("n"))
    return said.groupBy(doc).agg(F.min_by("minute", F.struct(-F.col("n"), F.col("minute"))).alias("minute"))


def dictionary(df: DataFrame, doc: str, text: str = "text", pattern: str = TAGS, first: Column | None = None) -> DataFrame:
    """(doc, word, n, tag): words of a pattern that occur more than once, commonest first, then by text; tags number on from first."""
    said = df.select(doc, F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("word")).groupBy(doc, "word").agg(F.count("*").alias("n")).filter("n > 1")
    place = F.row_number().over(Window.partitionBy(doc).orderBy(F.col("n").desc(), "word")) - 1
    return said.select(doc, "word", "n", F.concat(F.lit("#"), base62(place + (first if first is not None else F.lit(0))), F.lit("#")).alias("tag"))


def count_repeats(lines: DataFrame, doc: str, order: str, line: str = "line") -> DataFrame:
    """(doc, first, line, times): runs of lines that are equal but for a time at their start."""
    w = Window.partitionBy(doc).orderBy(order)
    key = F.regexp_replace(line, r"^#T#\d{2}(\.\d+)?Z?\s*", "")
    marked = lines.filter(F.trim(F.col(line)) != "").withColumn("_key", key)
    runs = marked.withColumn("_new", F.when(F.lag("_key").over(w) == F.col("_key"), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy(doc, "_run").agg(F.min(order).alias("first"), F.min_by(line, order).alias("line"), F.count("*").alias("times")).drop("_run")


def _base62(n: int) -> str:
    digits, out = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", ""
    while True:
        out = digits[n % 62] + out
        n //= 62
        if not n:
            return out


def _replace_common(text: str, pattern: str, first: int, legend: list) -> tuple[str, int]:
    counts = Counter(re.findall(pattern, text))
    tags = {}
    for word, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        if n > 1:
            tags[word] = f"#{_base62(first)}#"
            legend.append((tags[word], word))
            first += 1
    return re.sub(pattern, lambda m: tags.get(m[0], m[0]), text), first


def _best_run(lines: list[list[str]], tag: str, longest: int, must: str | None) -> tuple[int, str, list[str]] | None:
    """(saved, text, pieces) of the run of 2 to longest pieces within lines whose merging saves most, of equal ones the one with the smaller text.

    A run occurs twice only if both shorter runs in it do, so runs grow by one piece from those that do, and a run is known
    by the numbers of these two.
    """
    flat, room, upto = [p for line in lines for p in line], [left for line in lines for left in range(len(line), 0, -1)], [0]
    for p in flat:
        upto.append(upto[-1] + len(p.encode()))
    number: dict = {}
    key = {i: number.setdefault(p, len(number)) for i, p in enumerate(flat)}
    best, top, cost = None, 0, len(tag)
    for n in range(2, longest + 1):
        spots: dict = {}
        for i, k in key.items():
            if room[i] >= n and (after := key.get(i + 1)) is not None:
                spots.setdefault((k, after), []).append(i)
        key = {}
        for name, where in enumerate(spots.values()):
            if len(where) > 1:
                for i in where:
                    key[i] = name
                i = where[0]
                size = upto[i + n] - upto[i]
                saved = len(where) * (size - cost) - (cost + 3 + size)
                if saved > 0 and saved >= top:
                    whole = "".join(flat[i : i + n])
                    if (must is None or must in whole) and (saved > top or whole < best[1]):
                        best, top = (saved, whole, flat[i : i + n]), saved
        if not key:
            break
    return best


def _merge(lines: list[list[str]], legend: list, tag_of, longest: int, floor: int, must: str | None) -> list[list[str]]:
    """Greedy merging of runs of pieces within lines, the most saving first."""
    for turn in range(MAX_MERGES):
        tag = tag_of(turn)
        best = _best_run(lines, tag, longest, must)
        if best is None or best[0] < floor:
            break
        _, whole, gram = best
        legend.append((tag, whole))
        first, size = gram[0], len(gram)
        for k, line in enumerate(lines):
            out, i = [], 0
            while i < len(line):
                if line[i] == first and line[i : i + size] == gram:
                    out.append(tag)
                    i += size
                else:
                    out.append(line[i])
                    i += 1
            lines[k] = out
    return lines


def _templates(lines: list[str], legend: list) -> list[str]:
    """Lines that are equal but for one tag become a template's number and the tag."""
    tag = re.compile(r"#[0-9A-Za-z]+#|![0-9A-Za-z]+!")
    found: dict[str, set[int]] = {}
    for k, line in enumerate(lines):
        for m in tag.finditer(line):
            found.setdefault(line[: m.start()] + "\0" + line[m.end() :], set()).add(k)
    used: set[int] = set()
    number = 1
    for template, where in sorted(found.items(), key=lambda x: (-len(x[0]), -len(x[1]), x[0])):
        left = sorted(where - used)
        name = f"&{number}:"
        saved = len(left) * (len(template.encode()) - 1 - len(name)) - (len(template.encode()) + len(name) + 3)
        if len(left) > 1 and (saved > 0 or len(left) >= 4) and len(template) > len(name) + 1:
            head, tail = template.split("\0", 1)
            for k in left:
                lines[k] = name + lines[k][len(head) : len(lines[k]) - len(tail) or None]
            legend.append((name, template))
            used |= set(left)
            number += 1
    return lines


def squeeze_text(text: str, lossy: bool = True) -> tuple[str, list[tuple[str, str]]]:
    """Body and legend. Without lossy stages, expand() gives the text back exactly."""
    legend: list[tuple[str, str]] = []
    raw = text
    if lossy:
        for pattern, put in ZEROS:
            text = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", put), text)
    text_before = text
    minutes = Counter(re.findall(MINUTE, text))
    if minutes:
        minute = min(minutes, key=lambda m: (-minutes[m], m))
        legend.append((STAMP, minute))
        text = text.replace(minute, STAMP)
    text, nxt = _replace_common(text, TAGS, 0, legend)
    text, nxt = _replace_common(text, KEYS, nxt, legend)
    pieces = re.compile(r"#[0-9A-Za-z]+#|[A-Za-z0-9_]+|\s+|.", re.S)
    floor = max(5, len(text.encode()) // 200)
    lines = [pieces.findall(x) for x in text.split("\n")]
    lines = _merge(lines, legend, lambda n: f"#{_base62(nxt + n)}#", MAX_GRAM, floor, None)
    lines = _merge(lines, legend, lambda n: f"!{_base62(n + 1)}!", MAX_META, floor, "#")
    flat = _templates(["".join(x) for x in lines], legend)
    if expand_text("\n".join(flat), legend) != text_before:
        return raw, []  # marks of the text's own would be read as tags
    if lossy:
        out: list[tuple[str, str, int]] = []
        for line in flat:
            if not line.strip():
                continue
            key = re.sub(r"^#T#\d{2}(\.\d+)?Z?\s*", "", line)
            if out and out[-1][0] == key:
                out[-1] = (key, out[-1][1], out[-1][2] + 1)
            else:
                out.append((key, line, 1))
        flat = [x for key, line, n in out for x in ([line] if n == 1 else [line, f"    ... x{n}"])]
    return "\n".join(flat), legend


def expand_text(body: str, legend: list[tuple[str, str]]) -> str:
    """The legend applied in reverse."""
    templates = {name: value for name, value in legend if name.startswith("&")}
    lines = []
    for line in body.split("\n"):
        m = re.match(r"(&\d+:)(.*)$", line, re.S)
        if m and m[1] in templates:
            # the one mark that stands for the tag is where the template was cut
            head, tail = _cut(templates[m[1]])
            line = head + m[2] + tail
        lines.append(line)
    place = {name: n for n, (name, _) in enumerate(legend)}

    def tags(part: str, before: int) -> str:
        """part with the tags replaced that the legend has before a place; a value is made of earlier ones alone."""

        def one(m: re.Match) -> str:
            n = place.get(m[0], before)
            return m[0] if n >= before else legend[n][1] if m[0] == STAMP else tags(legend[n][1], n)

        return re.sub(r"#[0-9A-Za-z]+#|![0-9A-Za-z]+!", one, part)

    return tags("\n".join(lines), len(legend))


def _cut(template: str) -> tuple[str, str]:
    head, _, tail = template.partition("\0")
    return head, tail


def render(body: str, legend: list[tuple[str, str]]) -> str:
    return "".join(f"{name} = {value}\n" for name, value in legend) + FLOOR_MARK + body


def squeeze(df: DataFrame, doc: str, text: str = "text", lossy: bool = True) -> DataFrame:
    """(doc, body, legend, raw_bytes, out_bytes, squeezed): each text squeezed, or as it was if that isn't smaller."""
    kind = df.schema[doc].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for key, t in zip(b[doc], b[text], strict=True):
                t = t or ""
                body, legend = squeeze_text(t, lossy)
                whole = len(render(body, legend).encode())
                good = bool(legend) and whole < len(t.encode())
                rows.append((key, body if good else t, [{"tag": a, "value": v} for a, v in legend] if good else [], len(t.encode()), whole if good else len(t.encode()), good))
            yield pd.DataFrame(rows, columns=[doc, "body", "legend", "raw_bytes", "out_bytes", "squeezed"])

    # texts are few bytes and much work, so they are dealt to as many tasks as the session has partitions; by a hash of the key, since a
    # table that is dealt by the key itself would stay as it is, its partitions joined by size
    spread = df.select(doc, text).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(doc))
    return spread.mapInPandas(run, f"{doc} {kind}, body string, legend array<struct<tag:string,value:string>>, raw_bytes long, out_bytes long, squeezed boolean")


def expand(df: DataFrame, doc: str) -> DataFrame:
    kind = df.schema[doc].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pd.DataFrame({doc: b[doc], "text": [expand_text(body, [(x["tag"], x["value"]) for x in legend]) if len(legend) else body for body, legend in zip(b["body"], b["legend"], strict=True)]})

    return df.select(doc, "body", "legend").mapInPandas(run, f"{doc} {kind}, text string")


def savings(raw: Column, out: Column) -> Column:
    """Per cent saved, a whole number, 0 at least."""
    return F.when(raw > 0, F.greatest(F.lit(0).cast("long"), F.floor((raw - out) * 100 / raw))).otherwise(F.lit(0).cast("long"))


def human_bytes(n: Column) -> Column:
    return F.when(n < 1000, F.format_string("%d B", n)).when(n < 1_000_000, F.format_string("%.1f kB", n / 1000.0)).otherwise(F.format_string("%.1f MB", n / 1_000_000.0))
