"""Identifier tokens and classes of paths and queries, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"
_CAMEL = (("([A-Z]+)([A-Z][a-z])", "$1 $2"), ("([a-z])([A-Z])", "$1 $2"), ("([A-Za-z])([0-9])", "$1 $2"), ("([0-9])([A-Za-z])", "$1 $2"))
#: DuckDB's form of tokens(): a list expression over a column t.
TOKENS_SQL = """flatten(list_transform(regexp_extract_all({t}, '[A-Za-z_][A-Za-z0-9_]*'), lambda w:
  CASE WHEN len(list_filter(string_split(CASE WHEN contains(w, '_') THEN replace(lower(w), '_', ' ') ELSE lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g')) END, ' '), lambda p: p <> '')) >= 2
  THEN list_concat([lower(w)], list_filter(string_split(CASE WHEN contains(w, '_') THEN replace(lower(w), '_', ' ') ELSE lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g')) END, ' '), lambda p: p <> ''))
  ELSE [lower(w)] END))"""


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))


#: What an identifier of two parts or more holds.
_JOINT = "[_0-9]|[a-z][A-Z]|[A-Z][A-Z][a-z]"


def identifier_parts(word: Column) -> Column:
    """The parts of an identifier, lower case: by underscores if it has any, else by case and digits; none if there's but one."""
    spaced = word
    for pattern, put in _CAMEL:
        spaced = F.regexp_replace(spaced, pattern, put)
    parts = F.filter(F.split(F.when(F.contains(word, F.lit("_")), F.replace(F.lower(word), F.lit("_"), F.lit(" "))).otherwise(F.lower(spaced)), " "), lambda p: p != "")
    return F.flatten(F.filter(F.array(parts), lambda p: F.size(p) >= 2))  # so the parts are found once


def tokens(text: Column) -> Column:
    """Each identifier in lower case, followed by its parts, which are sought only where there can be two."""
    whole = lambda w: F.array(F.lower(w))
    return F.flatten(F.transform(identifiers(F.coalesce(text, F.lit(""))), lambda w: F.when(w.rlike(_JOINT), F.concat(whole(w), identifier_parts(w))).otherwise(whole(w))))


def is_symbol_query(query: Column) -> Column:
    """Whether a query names code: a qualified name, an inner capital, an underscore, or one capitalised word."""
    q = F.trim(query)
    return (
        q.rlike(r"^[\\A-Za-z_][A-Za-z0-9_]*((::|->|\.|\\)[A-Za-z_][A-Za-z0-9_]*)+$") | q.rlike(r"^_[A-Za-z0-9_]*$")
        | q.rlike(r"^[A-Za-z0-9]+(_[A-Za-z0-9]*)+$") | q.rlike(r"^(?:[A-Z][A-Za-z0-9]*|[a-z]+[A-Z][A-Za-z0-9]*)$")
    )


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def under(path: Column, scope: Column) -> Column:
    """Whether a path is the scope or lies in it, by whole components."""
    bare = F.regexp_replace(scope, "/+$", "")
    return (path == bare) | path.startswith(F.concat(bare, F.lit("/")))


_TEST_DIRS = ("test", "tests", "spec", "specs", "__tests__", "testing")
_RANK_TEST = r"(?i)(^|/)(tests?|specs?|__tests__|testing)/"
_RANK_TEST_FILE = r"(^|/)(test_[^/]*\.py|[^/]*_test\.[a-z]+|[^/]*\.(test|spec)\.[a-z]+|[^/]*Tests?\.(java|kt|cs|scala|php))$"
_COMPAT = r"(?i)(^|/)(compat|_?legacy|deprecated|polyfills?)(/|\.|_)"
_EXAMPLE = r"(?i)(^|/)(examples?|samples?|demos?|docs_src)/"
_GENERATED = r"(?i)(\.pb\.(go|cc|h)$|_pb2\.py$|\.generated\.|\.g\.dart$|\.min\.js$|(^|/)generated/)"
_RE_EXPORT = r"(^|/)(__init__\.py|index\.(ts|js|tsx|jsx)|mod\.rs)$"
_TYPES_ONLY = r"\.d\.ts$"
PENALTIES = ((f"({_RANK_TEST}|{_RANK_TEST_FILE})", 0.3), (_COMPAT, 0.3), (_EXAMPLE, 0.3), (_GENERATED, 0.3), (_RE_EXPORT, 0.5), (_TYPES_ONLY, 0.7))


def path_penalty(path: Column) -> Column:
    """The product of what a path's classes cost: tests, compatibility layers, examples, generated code, re-exports, bare types."""
    out = F.lit(1.0)
    for pattern, cost in PENALTIES:
        out = out * F.when(path.rlike(pattern), cost).otherwise(1.0)
    return out


def is_test_path(path: Column) -> Column:
    """The scan's own idea of tests: a component that names a test folder, a stem that ends in a test word, or test_*.py."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    named = lambda c: F.exists(F.split(c, r"[._-]"), lambda t: F.lower(t).isin("test", "tests", "spec", "specs", "e2e", "cypress", "fixtures", "__tests__"))
    name = F.element_at(F.split(path, "/"), -1)
    return F.exists(folders, named) | stem(path).rlike(r"(_test|_spec|\.test|\.spec)$|([a-z0-9](Tests?|Spec))$") | name.rlike(r"^test_.*\.py$")


DENIED = (
    "node_modules", "target", "dist", "build", "out", "vendor", "__pycache__", "venv", ".venv", ".git", ".hg", ".svn", ".idea", ".vscode", ".tox", ".mypy_cache",
    ".pytest_cache", ".ruff_cache", ".next", ".nuxt", ".cache", ".gradle", "coverage", "bin", "obj",
)


def is_denied(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in DENIED]))


LANGUAGES = {
    "rust": ("rs",), "python": ("py", "pyi"), "typescript": ("ts", "tsx", "mts", "cts"), "javascript": ("js", "jsx", "mjs", "cjs"), "csharp": ("cs",), "cpp": ("cpp", "cc", "cxx", "h", "hpp", "hh", "hxx"),
    "java": ("java",), "kotlin": ("kt", "kts"), "scala": ("scala", "sc"), "go": ("go",), "php": ("php",), "ruby": ("rb", "rake"), "elixir": ("ex", "exs"), "sql": ("sql",), "markdown": ("md", "markdown", "mdx"),
}
_SHEBANGS = {"python": "python", "ruby": "ruby", "node": "javascript", "php": "php", "elixir": "elixir", "deno": "typescript"}


def language_of(path: Column, text: Column) -> Column:
    """By extension; without one, by the interpreter of a #! line within the first 256 characters, its version left out."""
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.lower(F.regexp_extract(name, r".\.([^.]+)$", 1))
    by_ext = F.lit(None).cast("string")
    for lang, exts in LANGUAGES.items():
        by_ext = F.when(ext.isin(*exts), lang).otherwise(by_ext)
    line = F.regexp_extract(F.substring(text, 1, 256), r"^#!([^\n]*)", 1)
    words = F.filter(F.split(line, r"\s+"), lambda w: (w != "") & ~w.startswith("-") & ~w.contains("="))
    programs = F.transform(words, lambda w: F.regexp_replace(F.element_at(F.split(w, "/"), -1), r"[0-9.]+$", ""))
    program = F.when(F.get(programs, F.lit(0)) == "env", F.get(programs, F.lit(1))).otherwise(F.get(programs, F.lit(0)))
    by_bang = F.lit(None).cast("string")
    for p, lang in _SHEBANGS.items():
        by_bang = F.when(program == p, lang).otherwise(by_bang)
    return F.when(ext != "", by_ext).otherwise(by_bang)


def approx_tokens(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 4)


def base62(n: Column) -> Column:
    """A number in base 62, digits before lower before upper case."""
    digits = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    at = lambda x: F.substr(F.lit(digits), (x % 62 + 1).cast("int"), F.lit(1))
    n = n.cast("long")
    return F.concat(F.when(n >= 62**3, at(F.floor(n / 62**3))).otherwise(""), F.when(n >= 62**2, at(F.floor(n / 62**2))).otherwise(""), F.when(n >= 62, at(F.floor(n / 62))).otherwise(""), at(n))


STOP_WORDS = tuple("a an and are as at be by do does for from how i in is it of on or that the this to we what when where which who why with you".split())


def type_key(name: Column) -> Column:
    """A type's bare name: without type arguments, the last segment of its path."""
    return F.trim(F.element_at(F.split(F.regexp_replace(F.regexp_replace(name, r"[<\[(].*$", ""), r"::", "."), r"\."), -1))
