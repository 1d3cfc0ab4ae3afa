"""Sharding by histogram sort.

Rows are ordered by (hash of the text, id, row number), so equal texts lie side by
side and a group of any size can be cut between its rows. Splitters are found by
counting: each round counts the exact bytes and rows below a few probes for every
open splitter, one partial count for each task, and narrows each splitter to the
gap between two probes, until the bytes below it are within tolerance or no row
lies in the gap. A gap of a single hash is refined by id, then by row number.
Rows are then exchanged once and numbered within their range; what lies below a
range is known from the counts.

Size is the UTF-8 bytes of the text plus 8; a null text has size 8 and the CRC of
nothing. Null ids sort first. Repeated rows are separate rows. A row larger than a
shard gets its shard's splitters as near as rows allow. An empty table gives an
empty table. All columns of the input are carried along where asked for; those with
the names of the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import free_name, written

SHARDS = 24
#: Of a shard's ideal bytes.
TOLERANCE = 0.001
PROBES = 16
#: Rows in a range at most, about; a shard of more rows is exchanged as several ranges.
RANGE_ROWS = 1_000_000
LOW, HIGH = -(2**63), 2**63


@dataclass
class Splitter:
    """A cut of the key order: rows below it go left. lo and hi bound it in one part of the key, the parts before that are fixed."""

    goal: float
    hi_bytes: int
    hi_rows: int
    lo_bytes: int = 0
    lo_rows: int = 0
    fixed: tuple[int, ...] = ()
    lo: int = LOW
    hi: int = HIGH
    base: tuple[int, int] = (0, 0)
    at: tuple[int, int, int] | None = None
    rows: int = 0
    probes: list[int] = field(default_factory=list)

    def key(self, edge: int) -> tuple[int, int, int]:
        return (*self.fixed, edge, LOW, LOW)[:3]

    def settle(self, tolerance: float) -> None:
        low, high = abs(self.lo_bytes - self.goal), abs(self.hi_bytes - self.goal)
        if min(low, high) <= tolerance or self.hi_rows - self.lo_rows <= 1:
            # above the whole of a fixed part there's no key with these parts: the next value of the part before is the cut
            self.at, self.rows = (self.key(self.lo), self.lo_rows) if low <= high else (self.upper(), self.hi_rows)
        elif self.hi - self.lo == 1:
            self.fixed, self.lo, self.hi, self.base = (*self.fixed, self.lo), LOW, HIGH, (self.lo_bytes, self.lo_rows)

    def upper(self) -> tuple[int, int, int]:
        edge, fixed = self.hi, self.fixed
        while edge == HIGH and fixed:
            edge, fixed = fixed[-1] + 1, fixed[:-1]
        return (*fixed, edge, LOW, LOW)[:3]


def _below(keys: DataFrame, groups: list[tuple[tuple[int, ...], list[int]]]) -> dict[tuple[int, int], tuple[int, int]]:
    """(group, probe) -> exact bytes and rows below the probe among the rows with the group's fixed parts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [np.zeros((2, len(p) + 1), dtype=np.int64) for _, p in groups]
        for b in batches:
            parts, size = [b["h"].to_numpy(), b["i"].to_numpy(), b["u"].to_numpy()], b["size"].to_numpy()
            for (fixed, probes), total in zip(groups, sums, strict=True):
                inside = slice(None)
                if fixed:
                    inside = np.logical_and.reduce([p == f for p, f in zip(parts, fixed, strict=False)])
                place = np.searchsorted(np.array(probes, dtype=np.int64), parts[len(fixed)][inside], side="right")
                np.add.at(total[0], place, size[inside])
                total[1] += np.bincount(place, minlength=len(probes) + 1)
        for g, total in enumerate(sums):
            some = np.flatnonzero(total[1])
            yield pd.DataFrame({"g": np.full(len(some), g), "b": some, "bytes": total[0][some], "rows": total[1][some]})

    found = keys.mapInPandas(count, "g long, b long, bytes long, rows long").groupBy("g", "b").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect()
    out = {}
    for g, (_, probes) in enumerate(groups):
        each = np.zeros((2, len(probes) + 1), dtype=object)
        for r in found:
            if r["g"] == g:
                each[0][r["b"]], each[1][r["b"]] = r["bytes"], r["rows"]
        for x, (nb, nr) in enumerate(zip(np.cumsum(each[0]), np.cumsum(each[1]), strict=True)):
            if x < len(probes):
                out[g, probes[x]] = (int(nb), int(nr))
    return out


def splitters(keys: DataFrame, parts: int, tolerance: float = TOLERANCE, shards: int = SHARDS) -> list[Splitter]:
    """The parts - 1 cuts of a table (h, i, u, size) into ranges of near equal bytes."""
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    cuts = [Splitter(total["b"] * j / parts, total["b"], total["n"]) for j in range(1, parts)]
    allowed = tolerance * total["b"] / max(shards, 1)
    while open_ := [c for c in cuts if c.at is None]:
        wanted: dict[tuple[int, ...], set[int]] = {}
        for c in open_:
            gap = c.hi - c.lo
            c.probes = sorted({c.lo + gap * k // PROBES for k in range(1, PROBES)} - {c.lo, c.hi})
            wanted.setdefault(c.fixed, set()).update(c.probes)
        groups = [(fixed, sorted(p)) for fixed, p in wanted.items()]
        number = {fixed: g for g, (fixed, _) in enumerate(groups)}
        counted = _below(keys, groups) if any(p for _, p in groups) else {}
        for c in open_:
            for p in groups[number[c.fixed]][1]:
                if c.lo < p < c.hi:
                    nb, nr = (x + y for x, y in zip(counted[number[c.fixed], p], c.base, strict=True))
                    if nb <= c.goal:
                        c.lo, c.lo_bytes, c.lo_rows = p, nb, nr
                    else:
                        c.hi, c.hi_bytes, c.hi_rows = p, nb, nr
                        break
            c.settle(allowed)
    return sorted(cuts, key=lambda c: (c.at, c.goal))


def _placed(keyed: DataFrame, cuts: list[Splitter]) -> DataFrame:
    """keyed with the number of its range."""
    at = [np.array([c.at[k] if c.at[k] < HIGH else HIGH - 1 for c in cuts], dtype=np.int64) for k in range(3)]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h, i, u = b["h"].to_numpy(), b["i"].to_numpy(), b["u"].to_numpy()
            part = np.searchsorted(at[0], h, side="left")
            last = np.searchsorted(at[0], h, side="right")
            for row in [np.flatnonzero(part < last)]:
                for j in np.unique(np.concatenate([np.arange(a, z) for a, z in {*zip(part[row], last[row], strict=True)}])) if len(row) else ():
                    tied = row[h[row] == at[0][j]]
                    part[tied] += (i[tied] > at[1][j]) | ((i[tied] == at[1][j]) & (u[tied] >= at[2][j]))
            yield b.assign(part=part)

    return keyed.mapInPandas(place, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema) + ", part long")


def shard(df: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int = SHARDS, carry: tuple[str, ...] = (), tolerance: float = TOLERANCE, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the carried columns of every row."""
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    results = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "h", "i", "u", "part")
    extra = {c: free_name([*results, *df.columns], f"carried_{n}") for n, c in enumerate(carry) if c not in results}
    keyed = written(
        df.select(
            F.col(id_col).alias("doc_id"), (F.octet_length(content) + 8).cast("long").alias("size"), F.crc32(content).alias("text_crc32"),
            F.xxhash64(content).alias("h"), F.coalesce(F.col(id_col).cast("long"), F.lit(LOW)).alias("i"), F.monotonically_increasing_id().alias("u"),
            *[F.col(c).alias(n) for c, n in extra.items()],
        )
    )
    rows = keyed.count()
    each = max(1, -(-rows // (shards * range_rows)))
    cuts = splitters(keyed.select("h", "i", "u", "size"), shards * each, tolerance, shards)
    below = [0, *[c.rows for c in cuts]]
    start = F.element_at(F.array(*[F.lit(below[p] - below[p // each * each]).cast("long") for p in range(shards * each)]), (F.col("part") + 1).cast("int"))
    order = Window.partitionBy("part").orderBy("h", "i", "u")
    return _placed(keyed, cuts).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.expr(f"CAST(part DIV {each} AS INT)").alias("shard"),
        (start + F.row_number().over(order) - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *[F.col(n).alias(c) for c, n in extra.items()],
    )
