"""Declarations of source files: parsers, markers, projections and lookups.

A file becomes rows (file, ord_path, trail, kind, name, signature, bases, attrs, docs,
visibility, start_line, end_line, native_kind, modifiers, deprecated). ord_path is the
declaration's place among its siblings on each level, so order and ancestry are columns.
Python is parsed by its own grammar; SQL and Markdown by patterns; the languages of
braces, Ruby and Elixir by a scanner that knows comments and strings, tracks nesting and
reads declaration heads. Parsers run over Arrow batches, one file to many rows.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom import defaults as D
from codeloom.functions.text import type_key

DECLARATION = (
    "file string, ord_path array<int>, trail array<string>, kind string, name string, signature string, bases array<string>, attrs array<string>, docs array<string>, "
    "visibility string, start_line int, end_line int, parse_errors int"
)
CALL = "file string, source_qn string, name string, receiver string, line int, kind string"
IMPORT = "file string, local string, module string, line int"
TYPE_KINDS = ("class", "struct", "interface", "trait", "enum", "record", "object", "union", "module", "impl")
CALLABLE_KINDS = ("function", "method", "ctor", "dtor", "operator", "macro")


def _row(file, path, trail, kind, name, signature, bases=(), attrs=(), docs=(), visibility="public", start=1, end=1, errors=0):
    return (file, list(path), list(trail), kind, name, " ".join(signature.split())[:400], list(bases), list(attrs), list(docs), visibility, start, end, errors)


def parse_python(file: str, text: str) -> tuple[list, list, list]:
    """Declarations, calls and imports of a Python file; none, and one error, where it doesn't parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return [_row(file, [0], [], "error", "", "", errors=1)], [], []
    lines, decls, calls, imports = text.split("\n"), [], [], []

    def name_of(node) -> str:
        return ast.unparse(node)

    def visit_calls(node, qn: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                continue
            if isinstance(child, ast.Call):
                f = child.func
                if isinstance(f, ast.Name):
                    calls.append((file, qn, f.id, None, child.lineno, "construct" if f.id[:1].isupper() else "call"))
                elif isinstance(f, ast.Attribute):
                    on = name_of(f.value)
                    calls.append((file, qn, f.attr, "super" if on.startswith("super(") else on, child.lineno, "super" if on.startswith("super(") else "call"))
            visit_calls(child, qn)

    def walk(body, path, trail, in_class) -> None:
        n = 0
        for node in body:
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                attrs = ["@" + name_of(d) for d in node.decorator_list]
                head = lines[node.lineno - 1].strip()
                if isinstance(node, ast.ClassDef):
                    kind, bases, signature = "class", [name_of(b) for b in node.bases], head.rstrip(":")
                else:
                    kind = "ctor" if in_class and node.name == "__init__" else "property" if any(a in ("@property", "@cached_property") or a.endswith((".setter", ".getter")) for a in attrs) else "method" if in_class else "function"
                    arrow = f" -> {name_of(node.returns)}" if node.returns else ""
                    bases, signature = [], f"{'async ' if isinstance(node, ast.AsyncFunctionDef) else ''}def {node.name}({ast.unparse(node.args)}){arrow}"
                doc = ast.get_docstring(node)
                own = [*path, n]
                decls.append(_row(file, own, trail, kind, node.name, signature, bases, attrs, [doc] if doc else [], "private" if node.name.startswith("_") and not node.name.endswith("__") else "public", node.lineno, node.end_lineno))
                visit_calls(node, "::".join([file, *trail, node.name]))
                walk(node.body, own, [*trail, node.name], isinstance(node, ast.ClassDef))
                n += 1
            elif isinstance(node, ast.Assign | ast.AnnAssign) and (in_class or not trail):
                for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    if isinstance(t, ast.Name):
                        decls.append(_row(file, [*path, n], trail, "field", t.id, lines[node.lineno - 1].strip(), visibility="private" if t.id.startswith("_") else "public", start=node.lineno, end=node.end_lineno))
                        n += 1
            elif isinstance(node, ast.If | ast.Try | ast.With):
                walk([*node.body], path, trail, in_class)

    walk(tree.body, [], [], False)
    visit_calls(tree, file)
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            imports += [(file, a.asname or a.name.split(".")[0], a.name, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports += [(file, a.asname or a.name, "." * node.level + (node.module or "") + ":" + a.name, node.lineno) for a in node.names]
    return decls, calls, imports


_SQL = re.compile(r"(?im)^[ \t]*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+|unique\s+|materialized\s+)*(table|view|function|procedure|index|sequence)\s+(?:if\s+not\s+exists\s+)?((?:[\w$]+|\"[^\"]+\"|`[^`]+`|\[[^\]]+\])(?:\.(?:[\w$]+|\"[^\"]+\"|`[^`]+`))*)")
_SQL_KIND = {"table": "class", "view": "class", "function": "function", "procedure": "function", "index": "field", "sequence": "field"}


def parse_sql(file: str, text: str) -> tuple[list, list, list]:
    out = []
    for n, m in enumerate(_SQL.finditer(text)):
        end = text.find(";", m.end())
        end = len(text) if end < 0 else end
        first = text.count("\n", 0, m.start() + len(m[0]) - len(m[0].lstrip())) + 1
        out.append(_row(file, [n], [], _SQL_KIND[m[1].lower()], m[2].strip('"`[]'), m[0], start=first, end=text.count("\n", 0, end) + 1))
    return out, [], []


def parse_markdown(file: str, text: str) -> tuple[list, list, list]:
    lines, heads, fence = text.replace("\r\n", "\n").lstrip("﻿").split("\n"), [], None
    at = 0
    if lines and lines[0].strip() == "---" and "---" in [x.strip() for x in lines[1:]]:
        at = [x.strip() for x in lines[1:]].index("---") + 2
    blocks = []
    while at < len(lines):
        line = lines[at]
        m = re.match(r" {0,3}(```|~~~)(.*)$", line)
        if m and fence is None:
            fence = (m[1], at + 1, m[2].strip())
        elif m and fence and m[1] == fence[0]:
            blocks.append((fence[2], fence[1], at + 1))
            fence = None
        elif fence is None:
            h = re.match(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:\s#+)?\s*$", line)
            if h:
                heads.append((len(h[1]), (h[2] or "").strip(), at + 1))
            elif at + 1 < len(lines) and line.strip() and re.match(r" {0,3}(=+|-+)\s*$", lines[at + 1]) and not re.match(r"\s*[-*>|]", line):
                heads.append((1 if "=" in lines[at + 1] else 2, line.strip(), at + 1))
        at += 1
    out, stack, counts = [], [], {(): 0}
    for k, (level, title, line) in enumerate(heads):
        while stack and stack[-1][0] >= level:
            stack.pop()
        path = stack[-1][1] if stack else ()
        own = (*path, counts[path])
        counts[path] += 1
        counts[own] = 0
        end = next((later - 1 for other, _, later in heads[k + 1 :] if other <= level), len(lines))
        out.append(_row(file, own, [t for _, _, t in stack], "heading", title, f"{'#' * level} {title}", start=line, end=end))
        stack.append((level, own, title))
    for lang, first, last in blocks:
        path = ()
        for r in out:
            if r[3] == "heading" and r[10] <= first <= r[11] and len(r[1]) > len(path):
                path = tuple(r[1])
        own = (*path, counts[path])
        counts[path] += 1
        out.append(_row(file, own, [], "code_block", lang, f"```{lang}", start=first, end=last))
    return out, [], []


_MODS = r"(?:(?:pub(?:\([^)]*\))?|public|private|protected|internal|static|final|abstract|sealed|override|virtual|async|export|default|declare|open|inline|const|unsafe|extern(?:\s*\"[^\"]*\")?|partial|readonly|suspend|data|case|implicit|lazy|given|companion|inner|tailrec|operator|infix|explicit|constexpr|noexcept|synchronized|native|transient|volatile|new|ref|fileprivate|abstract)\s+)*"
_HEAD = {
    "type": re.compile(rf"^\s*{_MODS}(class|struct|interface|trait|enum(?:\s+class)?|record|object|union|protocol|module|defmodule|mod|namespace|impl|type)\b\s*(?:<[^>]*>\s*)?([A-Za-z_$][\w$.:]*)?(.*)$", re.S),
    "fn": re.compile(rf"^\s*{_MODS}(fn|func|function|fun|def|defp|defmacro|macro_rules!)(?![\w])\s*(?:\([^)]*\)\s*)?(?:<[^>]*>\s*)?([A-Za-z_$][\w$.?!]*)(.*)$", re.S),
    "method": re.compile(rf"^\s*{_MODS}(?:[\w$<>\[\],.?*&:]+\s+)*?~?([A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\s*\(([^;]*)\)\s*(?:const|override|noexcept|throws\s+[\w., ]+|->\s*[^{{]+|:\s*[^{{]+|=>\s*[^{{]*|where\s+[^{{]+)*\s*$", re.S),
    "value": re.compile(rf"^\s*{_MODS}(let|var|val|const|static|field)\s+(?:mut\s+)?([A-Za-z_$][\w$]*)(.*)$", re.S),
}
_NOT_METHODS = {"if", "for", "while", "switch", "catch", "return", "else", "match", "when", "do", "try", "synchronized", "using", "lock", "foreach", "loop", "new", "throw", "with", "func", "fn", "function", "fun"}
_KIND = {"fn": "function", "func": "function", "fun": "function", "def": "function", "defp": "function", "defmacro": "macro", "macro_rules!": "macro", "mod": "module", "namespace": "module", "defmodule": "module", "protocol": "interface", "enum class": "enum", "type": "alias"}
_CALL = re.compile(r"(?:([A-Za-z_$][\w$]*(?:(?:\.|::|->)[A-Za-z_$][\w$]*)*)(?:\.|::|->))?\b(new\s+)?([A-Za-z_$][\w$]*)(!?)\s*(?:<[\w, ]*>)?\(")
_IMPORTS = (
    re.compile(r"(?m)^\s*(?:pub\s+)?use\s+([\w:{}, *\n]+)(?:\s+as\s+(\w+))?;"), re.compile(r"(?m)^\s*import\s+(?:static\s+)?([\w.*]+(?:\.\{[^}]*\})?)(?:\s+as\s+(\w+))?\s*;?\s*$"),
    re.compile(r"(?m)^\s*(?:import|export)\s+[^;'\"]*?from\s+['\"]([^'\"]+)['\"]()"), re.compile(r"(?m)^\s*#include\s+[<\"]([^>\"]+)[>\"]()"), re.compile(r"(?m)^\s*using\s+([\w.]+)()\s*;"),
    re.compile(r"(?m)^\s*require(?:_relative|_once)?\s*\(?['\"]([^'\"]+)['\"]()"), re.compile(r"(?m)^\s*(?:alias|import|use|require)\s+([A-Z][\w.]*)()"), re.compile(r"(?m)^\s*(?:import\s+)?(?:\w+\s+)?\"([^\"\n]+)\"()\s*$"),
)


def blanked(text: str, hash_comments: bool = False) -> str:
    """The text with comments and string contents as spaces, of the same length and lines."""
    pattern = r'"""[\s\S]*?"""|"(?:\\.|[^"\\\n])*"|`[^`]*`|//[^\n]*|/\*[\s\S]*?\*/' + (r"|#[^\n]*" if hash_comments else r"|'(?:\\.|[^'\\\n])'")
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), text)


_GOES_ON = re.compile(r"^\s*(?:extends|implements|where|with|throws|[:,)\].&|>?]|->|=>)")


def _last_statement(head: str) -> int:
    """Where in the text before a brace the statement begins that the brace belongs to: its last line, and those before it that brackets or a continuation tie to it."""
    at, depth = len(head.rstrip()), 0
    while True:
        start = head.rfind("\n", 0, at) + 1
        line = head[start:at]
        depth += sum(line.count(c) for c in ")]") - sum(line.count(c) for c in "([")
        if start == 0 or (depth <= 0 and line.strip() and not _GOES_ON.match(line) and not head[:start].rstrip().endswith((",", "=>", "=", "(", "->"))):
            return start
        at = start - 1


def parse_braces(file: str, text: str, lang: str) -> tuple[list, list, list]:
    """Declarations, calls and imports of a language of braces, by the text before each opening brace or semicolon."""
    code = blanked(text)
    out, calls = [], []
    stack: list[tuple[tuple[int, ...] | None, str]] = []
    counts, errors, start = {(): 0}, 0, 0
    types: set[str] = set()

    def place() -> tuple[tuple[int, ...], list[str], str]:
        named = [(p, n) for p, n in stack if p is not None]
        return (named[-1][0] if named else ()), [n for _, n in named], (out[index[named[-1][0]]][3] if named else "")

    index: dict[tuple[int, ...], int] = {}

    def declare(head: str, at: int, body: bool):
        path, trail, outer = place()
        skip = _last_statement(head)
        head, at = head[skip:], at + skip
        head = re.sub(r"^(\s*(?:#!?\[[^\]]*\]|@\w+(?:\([^)]*\))?|\[[^\]]*\]))+", lambda m: re.sub(r"[^\n]", " ", m[0]), head)
        if not head.strip():
            return None
        kind = name = None
        bases: list[str] = []
        if m := _HEAD["type"].match(head):
            word, name, rest = re.sub(r"\s+", " ", m[1]), m[2] or "", m[3]
            kind = _KIND.get(word, word)
            if word == "impl" and (f := re.search(r"\bfor\s+([\w:.]+)", rest)):
                bases, name = [name], f[1]
            elif word == "type" and not name:
                return None
            elif word == "type" and (f := re.match(r"\s*(struct|interface)\b", rest)):
                kind = f[1]
            else:
                f = re.search(r"(?:\bextends\b|\bimplements\b|(?<!:):(?!:)|<(?!=)\s*(?=[A-Z]))(.*)$", re.sub(r"\([^)]*\)", "", rest), re.S)
                bases = [b.strip() for b in re.split(r",|\bextends\b|\bimplements\b|\bwith\b", f[1]) if b.strip()] if f else []
            types.add(name)
        elif m := _HEAD["fn"].match(head):
            kind, name = _KIND.get(m[1], "function"), m[2]
            kind = "method" if kind == "function" and outer in TYPE_KINDS and outer != "module" else kind
        elif (m := _HEAD["method"].match(head)) and m[1] not in _NOT_METHODS and not re.match(r"\s*(?:return|throw|else|await|yield)\b", head) and (body or outer in TYPE_KINDS):
            name = m[1]
            kind = "dtor" if "~" in head[: m.end(1)] else "ctor" if trail and name in (trail[-1], "constructor", "__construct") else "method" if outer in TYPE_KINDS else "function"
            if not body and not re.search(r"\S\s+[~\w$]+\s*\(", head):
                return None
        elif (m := _HEAD["value"].match(head)) and outer in (*TYPE_KINDS, ""):
            kind, name = "field", m[2]
        if kind is None or not name:
            return None
        own = (*path, counts[path])
        counts[path] += 1
        counts[own] = 0
        first = at + len(head) - len(head.lstrip())
        line = text.count("\n", 0, first) + 1
        private = bool(re.search(r"\b(private|fileprivate|defp)\b", head)) or (lang == "rust" and outer not in ("trait",) and not re.search(r"\bpub\b", head) and kind != "impl") or (lang == "go" and not name[:1].isupper())
        before = text[:first].rstrip("\n").split("\n")
        docs = []
        while before and re.match(r"\s*(///|//|\*|/\*\*|\*/|#\[)", before[-1]):
            docs.insert(0, before.pop().strip())
        attrs = [d for d in docs if d.startswith("#[")] + re.findall(r"@\w+", text[at:first])
        index[own] = len(out)
        out.append(_row(file, own, trail, kind, name, text[first : at + len(head)], bases, attrs, [d for d in docs if not d.startswith("#[")], "private" if private else "public", line, line))
        return own, name

    for m in re.finditer(r"[{};]", code):
        head = code[start : m.start()]
        if m[0] == "{":
            got = declare(head, start, True)
            stack.append(got or (None, ""))
        elif m[0] == ";":
            declare(head, start, False)
        else:
            if stack:
                path, _ = stack.pop()
                if path is not None:
                    r = list(out[index[path]])
                    r[11] = text.count("\n", 0, m.start()) + 1
                    out[index[path]] = tuple(r)
            else:
                errors += 1
        start = m.end()
    errors += len(stack)
    spans = sorted(((r[10], r[11], "::".join([file, *r[2], r[4]])) for r in out if r[3] in CALLABLE_KINDS), key=lambda s: (s[0], -s[1]))
    heads = {(r[10], r[4]) for r in out}
    for m in _CALL.finditer(code):
        line, name = code.count("\n", 0, m.start(3)) + 1, m[3]
        if name in _NOT_METHODS or (line, name) in heads or name in ("fn", "func", "function", "fun", "def"):
            continue
        inside = [s for s in spans if s[0] <= line <= s[1]]
        kind = "macro" if m[4] else "construct" if m[2] or name in types else "super" if (m[1] or "") in ("super", "base", "parent") else "call"
        calls.append((file, inside[-1][2] if inside else file, name, m[1], line, kind))
    imports = []
    for p in _IMPORTS:
        for m in p.finditer(text):
            spec, line = " ".join(m[1].split()), text.count("\n", 0, m.start(1)) + 1
            for one in _use_tree(spec):
                imports.append((file, m[2] or re.split(r"::|\.|/", one)[-1], one, line))
    if errors and out:
        out[0] = (*out[0][:-1], errors)
    return out, calls, list(dict.fromkeys(imports))


def _use_tree(spec: str) -> list[str]:
    """a::{b, c::d} as a::b and a::c::d."""
    m = re.match(r"^([^{]*)\{(.*)\}$", spec)
    if not m:
        return [spec]
    parts, depth, cur = [], 0, ""
    for c in m[2]:
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            parts.append(cur)
            cur = ""
        else:
            cur += c
    return [x for p in [*parts, cur] if p.strip() for x in _use_tree(m[1] + p.strip())]


def parse_ends(file: str, text: str, lang: str) -> tuple[list, list, list]:
    """Ruby and Elixir: blocks that end in ``end``."""
    code = blanked(text, hash_comments=True)
    out, calls, stack, counts = [], [], [], {(): 0}
    opens = re.compile(r"^\s*(class|module|defmodule|defprotocol|defimpl|def|defp|defmacro)\s+(?:self\.)?([\w.:?!]+)(.*)$")
    private = False
    for n, line in enumerate(code.split("\n"), 1):
        m = opens.match(line)
        named = [s for s in stack if s[0] is not None]
        path = named[-1][0] if named else ()
        if re.match(r"^\s*private\s*$", line):
            private = True
        if m:
            own = (*path, counts[path])
            counts[path] += 1
            counts[own] = 0
            kind = {"class": "class", "module": "module", "defmodule": "module", "defprotocol": "interface", "defimpl": "impl", "defmacro": "macro"}.get(m[1], "method" if named else "function")
            base = re.match(r"\s*<\s*([\w:]+)", m[3])
            out.append(_row(file, own, [s[1] for s in named], kind, m[2], line.strip().removesuffix(" do"), [base[1]] if base else [], (), (), "private" if m[1] == "defp" or (private and kind == "method") else "public", n, n))
            if not re.search(r",\s*do:|\bend\s*$", line):
                stack.append((own, m[2], len(out) - 1))
        elif re.match(r"^\s*(if|unless|case|cond|while|until|begin|for|try|receive|fn)\b", line) and not re.search(r"\bend\b|,\s*do:", line) or re.search(r"\bdo\s*(\|[^|]*\|)?\s*$", line):
            stack.append((None, "", -1))
        if re.match(r"^\s*end\b", line) and stack:
            own, _, k = stack.pop()
            if own is not None:
                r = list(out[k])
                r[11] = n
                out[k] = tuple(r)
                private = private and out[k][3] == "method"
        if lang == "ruby" and not m:
            qn = "::".join([file, *[s[1] for s in stack if s[0] is not None]])
            calls += [(file, qn, c[2], c[1] or None, n, "construct" if c[2] == "new" else "call") for c in re.finditer(r"(?:([A-Za-z_][\w:]*)\.)?([a-z_]\w*[?!]?)\s*\(", line)]
    imports = [(file, re.split(r"[./]", m[1])[-1], m[1], text.count("\n", 0, m.start()) + 1) for p in _IMPORTS[5:7] for m in p.finditer(text)]
    return out, calls, imports


def parse(file: str, language: str, text: str) -> tuple[list, list, list]:
    text = text or ""
    if language == "python":
        return parse_python(file, text)
    if language == "sql":
        return parse_sql(file, text)
    if language == "markdown":
        return parse_markdown(file, text)
    if language in ("ruby", "elixir"):
        return parse_ends(file, text, language)
    return parse_braces(file, text, language) if language else ([], [], [])


def _parsed(files: DataFrame, which: int, schema: str) -> DataFrame:
    names = [c.split()[0] for c in re.split(r",\s*(?![^<]*>)", schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for p, lang, t in zip(b["path"], b["language"], b["text"], strict=True) for r in parse(p, lang, t)[which]]
            yield pd.DataFrame(rows, columns=names)

    return files.filter("language IS NOT NULL").select("path", "language", "text").mapInPandas(run, schema)


def declarations(files: DataFrame) -> DataFrame:
    """Declarations of files (path, language, text) with their markers."""
    return with_markers(_parsed(files, 0, DECLARATION).filter("kind <> 'error'"))


def calls(files: DataFrame) -> DataFrame:
    return _parsed(files, 1, CALL)


def imports(files: DataFrame) -> DataFrame:
    return _parsed(files, 2, IMPORT)


def parse_errors(files: DataFrame) -> DataFrame:
    return _parsed(files, 0, DECLARATION).groupBy("file").agg(F.sum("parse_errors").alias("errors"))


_MODIFIERS = ("pub", "public", "private", "protected", "internal", "static", "final", "abstract", "sealed", "override", "virtual", "async", "const", "unsafe", "export", "default", "open", "suspend", "readonly", "mut", "extern", "inline")


def with_markers(decls: DataFrame) -> DataFrame:
    """native_kind, modifiers (those before the name) and deprecated, from signature, attributes and docs."""
    head = F.split(F.substring_index("signature", "(", 1), r"[^A-Za-z_]+")
    native = F.regexp_extract("signature", r"\b(struct|class|interface|trait|enum|record|object|union|impl|fn|func|fun|def|function|namespace|mod|module|type|let|var|val)\b", 1)
    attrs = F.concat_ws(" ", F.coalesce("attrs", F.array()), F.coalesce("docs", F.array()))
    return decls.withColumns({
        "native_kind": F.when(native != "", native), "modifiers": F.array_intersect(head, F.array(*[F.lit(m) for m in _MODIFIERS])),
        "deprecated": attrs.rlike(r"(?i)@deprecated\b|#\[deprecated|\[\[deprecated|\[Obsolete|\bDEPRECATED\b|:deprecated:"),
    })


def qualified(decls: DataFrame) -> DataFrame:
    return decls.withColumn("qn", F.concat_ws("::", "file", F.array_join("trail", "::"), "name")).withColumn("qn", F.regexp_replace("qn", "::::", "::"))


def visible(decls: DataFrame, no_fields: bool = False, no_private: bool = False) -> DataFrame:
    """Without fields and the like, without private ones, and without what stands below a dropped one."""
    drop = F.lit(False)
    if no_fields:
        drop = drop | F.col("kind").isin("field", "property", "event", "indexer", "code_block")
    if no_private:
        drop = drop | (F.col("visibility") == "private")
    gone = decls.filter(drop).select(F.col("file").alias("_f"), F.col("ord_path").alias("_p"))
    ups = decls.filter(~drop).withColumn("_up", F.explode(F.transform(F.sequence(F.lit(1), F.size("ord_path")), lambda n: F.slice("ord_path", F.lit(1), n))))
    under = ups.join(gone, (F.col("file") == F.col("_f")) & (F.col("_up") == F.col("_p")), "left_semi").select("file", "ord_path").distinct()
    return decls.filter(~drop).join(under, ["file", "ord_path"], "left_anti")


def counts(decls: DataFrame) -> DataFrame:
    kinds = {"types": TYPE_KINDS, "callables": CALLABLE_KINDS, "fields": ("field", "property", "event", "indexer"), "headings": ("heading",)}
    return decls.groupBy("file").agg(*[F.count_if(F.col("kind").isin(*k)).alias(n) for n, k in kinds.items()], F.count("*").alias("total"))


def size_label(lines: Column) -> Column:
    return F.when(lines <= 50, "tiny").when(lines <= 200, "small").when(lines <= 600, "medium").when(lines <= 1500, "large").otherwise("huge")


def collapse_overloads(decls: DataFrame) -> DataFrame:
    """Siblings next to each other of one kind and name as one row, with their number."""
    parent = F.slice("ord_path", F.lit(1), F.size("ord_path") - 1)
    w = Window.partitionBy("file", "_parent").orderBy("ord_path")
    same = (F.lag("kind").over(w) == F.col("kind")) & (F.lag("name").over(w) == F.col("name"))
    runs = decls.withColumn("_parent", parent).withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy("file", "_parent", "_run", "kind", "name").agg(F.min("ord_path").alias("ord_path"), F.min_by("signature", "ord_path").alias("signature"), F.count("*").alias("times")).drop("_parent", "_run")


def cap_members(decls: DataFrame, cap: int = D.MEMBER_CAP) -> tuple[DataFrame, DataFrame]:
    """The first cap members of each type, and (file, parent, dropped) for types with more."""
    rows = decls.withColumn("_parent", F.slice("ord_path", F.lit(1), F.size("ord_path") - 1))
    types = decls.filter(F.col("kind").isin(*TYPE_KINDS)).select("file", F.col("ord_path").alias("_parent"), F.lit(True).alias("_capped"))
    counted = ~F.col("kind").isin(*TYPE_KINDS)
    turn = F.sum(F.when(counted, 1).otherwise(0)).over(Window.partitionBy("file", "_parent").orderBy("ord_path"))
    placed = rows.join(types, ["file", "_parent"], "left").withColumn("_n", turn).withColumn("_over", F.coalesce("_capped", F.lit(False)) & counted & (F.col("_n") > cap))
    dropped = placed.filter("_over").groupBy("file", F.col("_parent").alias("parent")).agg(F.count("*").alias("dropped"))
    return placed.filter("NOT _over").drop("_parent", "_capped", "_n", "_over"), dropped


def find_symbols(decls: DataFrame, symbols: list[str]) -> DataFrame:
    """Declarations of which the last segments of trail and name are a symbol's; headings that contain it, whatever the case."""
    spark = decls.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(s, [p for p in re.split(r"::|\.|#", s) if p]) for s in symbols], "symbol string, segments array<string>"))  # a row for each symbol
    full, size = F.concat("trail", F.array("name")), F.size("segments")
    ends = (F.size(full) >= size) & (F.slice(full, F.greatest(F.lit(1), F.size(full) - size + 1), size) == F.col("segments"))
    exact = decls.filter("kind <> 'heading'").join(wanted, (F.col("name") == F.get("segments", size - 1)) & ends).select("symbol", *decls.columns)
    heads = decls.filter("kind = 'heading'").join(wanted, F.contains(F.lower("name"), F.lower("symbol"))).select("symbol", *decls.columns)
    return exact.unionByName(heads).dropDuplicates(["symbol", "file", "ord_path"])


def show(decls: DataFrame, symbols: list[str], limit: int = D.SHOW_LIMIT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matches up to limit for each symbol, the totals of all matches, and the symbols without one."""
    found = find_symbols(decls, symbols)
    totals = found.groupBy("symbol").agg(F.count("*").alias("total"))
    shown = found.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy("file", "ord_path"))).filter(F.col("_n") <= limit).drop("_n")
    asked = decls.sparkSession.createDataFrame([(s,) for s in symbols], "symbol string")
    return shown, totals, asked.join(totals, "symbol", "left_anti")


def types_table(decls: DataFrame) -> DataFrame:
    return decls.filter(F.col("kind").isin(*TYPE_KINDS)).select(F.col("file").alias("path"), F.col("start_line").alias("line"), "name", "bases")


def base_index(types: DataFrame) -> DataFrame:
    """(base, implementors): the names of the types that name each base, sorted."""
    return types.select("name", F.explode("bases").alias("b")).groupBy(type_key(F.col("b")).alias("base")).agg(F.array_sort(F.collect_set("name")).alias("implementors"))


def digest(decls: DataFrame) -> DataFrame:
    """Public names without fields, members up to the cap, overloads counted."""
    return collapse_overloads(cap_members(visible(decls, no_fields=True, no_private=True))[0]).orderBy("file", "ord_path")


def find_pattern(files: DataFrame, pattern: str, rewrite: str | None = None) -> DataFrame:
    """(path, line, match, replacement): tokens that match a pattern; $A is one token or bracketed group, $$$ any run; the same name must match the same text."""
    token = r"[A-Za-z_$][\w$]*|\d[\w.]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|::|->|=>|[^\s\w]"
    wanted = re.findall(r"\$\$\$|\$[A-Z_]\w*|" + token, pattern)
    closing = {"(": ")", "[": "]", "{": "}"}

    def group_end(toks, i):
        if toks[i][0] not in closing:
            return i + 1
        depth = 0
        for j in range(i, len(toks)):
            depth += (toks[j][0] in closing) - (toks[j][0] in closing.values())
            if not depth:
                return j + 1
        return None

    def match(toks, i, p, bound):
        if p == len(wanted):
            return i, bound
        w = wanted[p]
        if w == "$$$":
            j = i
            while j is not None and j <= len(toks):
                if got := match(toks, j, p + 1, bound | {"$$$": (i, j)}):
                    return got
                if j == len(toks) or toks[j][0] in closing.values():
                    return None
                j = group_end(toks, j)
            return None
        if i >= len(toks):
            return None
        if w.startswith("$") and len(w) > 1:
            if toks[i][0] in closing.values() or (j := group_end(toks, i)) is None:
                return None
            said = "".join(t[0] for t in toks[i:j])
            if w in bound and "".join(t[0] for t in toks[bound[w][0] : bound[w][1]]) != said:
                return None
            return match(toks, j, p + 1, bound | {w: (i, j)})
        return match(toks, i + 1, p + 1, bound) if toks[i][0] == w else None

    def run(batches):
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"], strict=True):
                toks = [(m[0], m.start(), m.end()) for m in re.finditer(token, text or "")]
                i = 0
                while i < len(toks):
                    got = match(toks, i, 0, {})
                    if got and got[0] > i:
                        end, bound = got
                        put = None
                        if rewrite is not None:
                            span = lambda m: text[toks[bound[m[0]][0]][1] : toks[bound[m[0]][1] - 1][2]] if m[0] in bound and bound[m[0]][1] > bound[m[0]][0] else ""  # noqa: B023, E731
                            put = re.sub(r"\$\$\$|\$[A-Z_]\w*", span, rewrite)
                        rows.append((path, text.count("\n", 0, toks[i][1]) + 1, toks[i][1], toks[end - 1][2], text[toks[i][1] : toks[end - 1][2]], put))
                        i = end
                    else:
                        i += 1
            yield pd.DataFrame(rows, columns=["path", "line", "start", "end", "match", "replacement"])

    return files.filter(F.octet_length("text") <= D.PATTERN_FILE_BYTES).select("path", "text").mapInPandas(run, "path string, line int, start int, end int, match string, replacement string")


def rewritten(files: DataFrame, matches: DataFrame) -> DataFrame:
    """(path, text, changed): files with the matches replaced; a dry run, written as a new version of the table by the caller."""
    edits = matches.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("_e"))
    joined = files.join(edits, "path")
    step = F.aggregate("_e", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda a, e: F.struct(e["end"].alias("at"), F.concat(a["out"], F.substr("text", a["at"] + 1, e["start"] - a["at"]), e["replacement"]).alias("out")))
    done = joined.withColumn("_d", step)
    return done.select("path", F.concat("_d.out", F.substr("text", F.col("_d.at") + 1, F.length("text"))).alias("text"), F.size("_e").alias("changed"))
