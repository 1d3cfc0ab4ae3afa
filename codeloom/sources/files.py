"""Source files as DataFrames: scanning, pruning, identity, slices and deltas."""

from __future__ import annotations

import fnmatch
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import defaults as D
from codeloom.functions import text as T

MANIFESTS = ("Cargo.toml", "pyproject.toml", "package.json", "go.mod", "pom.xml", "build.gradle", "composer.json", "mix.exs", "build.sbt")


class PathNotFound(FileNotFoundError):
    """A path to scan doesn't exist."""


class SymbolNotFound(LookupError):
    """A name that a query starts from isn't known."""


class BadArgument(ValueError):
    """An argument out of its range."""


def scan(spark: SparkSession, root: str, glob: str | None = None, max_bytes: int = D.INDEX_FILE_BYTES) -> DataFrame:
    """(path, size, mtime_ns, text, language, content_hash, line_count) of the files under root, by Spark's binary reader.

    Names and sizes are tested before contents are read; denied folders are left out.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.load(root)
    base = re.sub(r"^file:/*", "/", root.rstrip("/"))
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), f"^{re.escape(base)}/", "")
    rows = raw.select(path.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), "content").filter((F.col("size") <= max_bytes) & ~T.is_denied(F.col("path")))
    text = F.col("content").cast("string")
    return rows.withColumn("text", text).withColumn("content_hash", F.sha2("content", 256)).drop("content").withColumn("language", T.language_of(F.col("path"), F.col("text"))).withColumn("line_count", line_count(F.col("text")))


def line_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(F.regexp_replace(text, r"\n$", ""), "\n")))


def ignore_regex(rule: str) -> tuple[str, bool] | None:
    """A rule of an ignore file as a regular expression for whole paths, and whether it takes matches back in; None for blanks and comments."""
    rule = rule.rstrip("\n")
    if not rule.strip() or rule.startswith("#"):
        return None
    back, rule = rule.startswith("!"), rule.lstrip("!").strip()
    folder, rule = rule.endswith("/"), rule.rstrip("/")
    anchored, rule = "/" in rule, rule.lstrip("/")
    out = ""
    for part in re.split(r"(\*\*/|\*\*|\*|\?)", rule):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return ("^" if anchored else "(?:^|/)") + out + ("/" if folder else "(?:/|$)"), back


def not_ignored(rules: list[str], path: Column) -> Column:
    """Whether a path stays: of the rules that match, the last one decides."""
    out = F.lit(True)
    for regex, back in filter(None, map(ignore_regex, rules)):
        out = F.when(path.rlike(regex), back).otherwise(out)
    return out


def glob_match(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(fnmatch.translate(p).replace(r"\Z", "$").replace(r"\z", "$").replace("(?s:", "(?:"))
    return out


def pruned_mix(files: DataFrame) -> DataFrame:
    """Without deps and _build folders beside a mix.exs."""
    owners = files.filter(F.col("path").rlike(r"(^|/)mix\.exs$")).select(F.regexp_replace("path", r"mix\.exs$", "").alias("_dir"))
    spots = files.select("path", F.explode(F.transform(F.expr("sequence(1, size(split(path, '/')))"), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))).alias("_at")).filter(F.col("_at").rlike(r"(^|/)(deps|_build)$"))
    gone = spots.withColumn("_dir", F.regexp_replace("_at", r"(deps|_build)$", "")).join(owners, "_dir", "left_semi").select("path").distinct()
    return files.join(gone, "path", "left_anti")


def one_spelling(files: DataFrame, identity: str = "identity") -> DataFrame:
    """One row for each file: its shortest path, of equal ones the first; in path order."""
    best = files.groupBy(identity).agg(F.min(F.struct(F.length("path"), "path")).alias("_b")).select(identity, F.col("_b.path").alias("path"))
    return files.join(best, [identity, "path"], "left_semi").dropDuplicates([identity]).orderBy("path")


def slice_lines(df: DataFrame, text: str, first: int, last: int) -> DataFrame:
    """Lines first to last, from 1 and inclusive, cut to those that exist."""
    if first < 1 or last < first:
        raise BadArgument(f"lines {first}-{last}")
    return df.withColumn(text, F.array_join(F.slice(F.split(text, "\n"), first, last - first + 1), "\n"))


def parse_range(spec: str) -> tuple[int, int]:
    m = re.fullmatch(r"(\d+)(?:[-:](\d+))?", spec)
    if not m or int(m[1]) < 1 or int(m[2] or m[1]) < int(m[1]):
        raise BadArgument(f"line range {spec!r}")
    return int(m[1]), int(m[2] or m[1])


def project_root(path: str, home: str | None = None) -> str:
    """The nearest folder upwards with .git, else with a manifest, never above home; else the path's own folder."""
    start = at = os.path.abspath(path if os.path.isdir(path) else os.path.dirname(path))
    ups = [at]
    while at != os.path.dirname(at) and at != home:
        at = os.path.dirname(at)
        ups.append(at)
    for marks in ((".git",), MANIFESTS):
        for up in ups:
            if any(os.path.exists(os.path.join(up, m)) for m in marks):
                return up
    return start


def compare_corpus(recorded: list[str], wanted: list[str]) -> tuple[str, str]:
    """How what is wanted lies to what is recorded (same, subset, superset, sibling), and their common folder."""
    inside = lambda a, b: all(any(x == y or x.startswith(y.rstrip("/") + "/") for y in b) for x in a)
    down, up = inside(wanted, recorded), inside(recorded, wanted)
    kind = "same" if down and up else "subset" if down else "superset" if up else "sibling"
    return kind, os.path.commonpath(recorded + wanted)


def split_targets(args: list[str]) -> dict[str, list[str]]:
    """Arguments by what they are: globs, folders, files; what isn't there is an error."""
    out: dict[str, list[str]] = {"globs": [], "folders": [], "files": []}
    for a in args:
        if re.search(r"[*?\[]", a):
            out["globs"].append(a)
        elif os.path.isdir(a):
            out["folders"].append(a)
        elif os.path.isfile(a):
            out["files"].append(a)
        else:
            raise PathNotFound(a)
    return out


def delta(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change): added, removed, modified or mtime_only of two snapshots (path, size, mtime_ns, content_hash); unchanged paths don't come out."""
    a, b = before.select("path", *[F.col(c).alias(f"_{c}") for c in ("size", "mtime_ns", "content_hash")]), now.select("path", "size", "mtime_ns", "content_hash", F.lit(True).alias("_here"))
    both = a.withColumn("_was", F.lit(True)).join(b, "path", "full_outer")
    change = (
        F.when(F.col("_was").isNull(), "added").when(F.col("_here").isNull(), "removed").when(F.col("size").eqNullSafe(F.col("_size")) & F.col("mtime_ns").eqNullSafe(F.col("_mtime_ns")), F.lit(None))
        .when(F.col("content_hash").eqNullSafe(F.col("_content_hash")), "mtime_only").otherwise("modified")
    )
    return both.select("path", change.alias("change")).filter("change IS NOT NULL")


def new_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """A stream of the files that appear under root: (path, size, mtime_ns, text)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return raw.select("path", F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("content").cast("string").alias("text"))


