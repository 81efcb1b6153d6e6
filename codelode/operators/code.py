"""Definitions in source files: functions, methods and classes with their lines and scope.

Python files are parsed by the interpreter's own parser (by indentation where that
fails).  Files of the other languages go through a lexer, which blanks comments, strings,
patterns and here-documents, and are then matched against the forms of definitions;
brackets tell where a definition ends, and containment gives the scopes of its name.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType

from codelode import schema
from codelode.functions import text as X
from codelode.operators.lexers import closing, masked


@dataclass(frozen=True)
class Span:
    """A definition of a text: bytes [start, end), its name ('' if it has none), and whether it is a class or only names a scope."""

    start: int
    end: int
    name: str
    is_class: bool = False
    scope_only: bool = False


def python_spans(text: str) -> list[Span]:
    lines = text.splitlines(keepends=True)
    offs = [0]
    for line in lines:
        offs.append(offs[-1] + len(line))

    def offset(line: int, byte: int) -> int:
        return offs[line - 1] + len(lines[line - 1].encode()[:byte].decode(errors="replace")) if line <= len(lines) else len(text)

    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return _indented(lines, offs)
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    return [Span(offset(n.lineno, n.col_offset), offset(n.end_lineno, n.end_col_offset), n.name, isinstance(n, ast.ClassDef)) for n in ast.walk(tree) if isinstance(n, kinds)]


def _indented(lines: list[str], offs: list[int]) -> list[Span]:
    """Definitions by indentation, in one pass: a line that is not indented further ends what is open."""
    out, open_ = [], []
    last = 0

    def close(width: int) -> None:
        while open_ and open_[-1][0] >= width:
            _, start, name, is_class = open_.pop()
            out.append(Span(start, offs[last] + len(lines[last].rstrip("\r\n")), name, is_class))

    for k, line in enumerate(lines):
        if not line.strip():
            continue
        wide = line.expandtabs()
        close(len(wide) - len(wide.lstrip()))
        last = k
        if m := re.match(r"([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)", line):
            open_.append((len(m[1].expandtabs()), offs[k] + len(m[1]), m[3], m[2] == "class"))
    close(0)
    return out


_PAIRS = {"(": "()", "[": "[]", "{": "{}"}


def _until(code: str, at: int) -> int:
    """The end of a definition whose head ends at ``at``: its block, or its semicolon; parentheses and brackets are passed over."""
    while m := re.compile(r"[{;(\[]").search(code, at):
        if m[0] == ";":
            return m.end()
        at = closing(code, m.start(), _PAIRS[m[0]])
        if m[0] == "{":
            return at
    return len(code)


def _past_angles(code: str, at: int) -> int:
    """The place after type parameters, if they begin at ``at``; a function's arrow closes nothing."""
    if code[at : at + 1] != "<":
        return at
    depth = 0
    for m in re.compile(r"=>|[<>(;{]").finditer(code, at):
        if m[0] in "<>":
            depth += 1 if m[0] == "<" else -1
            if not depth:
                return m.end()
        elif m[0] == ";":
            break
    return at


def _body(code: str, paren: int, between: str) -> int | None:
    """The end of a function whose parameters open at ``paren``, if a block follows after only ``between``."""
    m = re.compile(between).match(code, closing(code, paren, "()"))
    return closing(code, m.end() - 1) if m else None


def _typed_body(code: str, paren: int) -> int | None:
    """The same where a type may stand before the block; an object type follows an operator or is within angles."""
    at = re.compile(r"\s*").match(code, closing(code, paren, "()")).end()
    if code[at : at + 1] == "{":
        return closing(code, at)
    if code[at : at + 1] != ":":
        return None
    angles, before = 0, ":"
    for m in iter(lambda: re.compile(r"\s*(=>|[A-Za-z_$][\w$.]*|\S)").match(code, at), None):
        token = m[1]
        if token in "([" or (token == "{" and (angles or before in ":|&<,?" or before in ("=>", "is", "extends", "keyof", "readonly", "asserts"))):
            at = closing(code, m.start(1), _PAIRS[token])
        elif token == "{":
            return closing(code, m.start(1))
        elif token in ";})=":
            return None
        else:
            angles += (token == "<") - (token == ">")
            at = m.end()
        before = token if token not in "([{" else ")"
    return None


_NO_METHOD = {"if", "for", "while", "switch", "catch", "function", "return", "with", "do", "else", "super", "new", "await", "typeof", "using", "lock", "fixed", "foreach", "when", "nameof", "elseif", "until", "trap", "param"}


#: What an expression stands behind; a class or function there is no declaration.
_EXPRESSION = re.compile(r"(?:[=(,:?\[&|!~+\-*/%<>]|\b(?:return|new|typeof|case|in|of|delete|void|throw|extends|yield|await))\s*\Z")


def _script_spans(code: str, typed: bool) -> list[Span]:
    declared = lambda at: not _EXPRESSION.search(code, max(0, at - 60), at)
    body = _typed_body if typed else (lambda code, paren: _body(code, paren, r"\s*\{"))
    out = []
    for m in re.finditer(r"(?<![\w$.])(abstract\s+)?class\s+([A-Za-z_$][\w$]*)", code):
        if m[2] not in ("extends", "implements") and not (typed and m[1]) and declared(m.start()):
            out.append(Span(m.start(), _until(code, m.end()), m[2], True))
    for m in re.finditer(r"(?<![\w$.])(?:async\s+)?function\s+([A-Za-z_$][\w$]*)\s*", code):
        paren = re.compile(r"\s*\(").match(code, _past_angles(code, m.end()))
        if paren and declared(m.start()) and (end := body(code, paren.end() - 1)):
            out.append(Span(m.start(), end, m[1]))
    for m in re.finditer(r"(?<![\w$.#])((?:(?:public|private|protected|static|readonly|override|async|get|set|accessor)\s+)*(?:\*\s*)?)(#?[A-Za-z_$][\w$]*+|\[[^\]\n]*\])\s*(?=[<(])", code):
        paren = re.compile(r"\s*\(").match(code, _past_angles(code, m.end()))
        if not paren or m[2] in _NO_METHOD or re.search(r"(?:\bfunction\s*\*?|\bnew|\bclass|[\w$\])])\s*\Z", code[max(0, m.start() - 20) : m.start()]) and not re.search(r"\n\s*\Z", code[max(0, m.start() - 20) : m.start()]):
            continue
        if end := body(code, paren.end() - 1):
            out.append(Span(m.start(), end, m[2]))
    return out


def _from_attributes(code: str, at: int) -> int:
    """Where a declaration begins whose modifiers begin at ``at``: with the attribute lists before them."""
    while m := re.search(r"\]\s*\Z", code[max(0, at - 400) : at]):
        last, depth, k = max(0, at - 400) + m.start(), 0, max(0, at - 400) + m.start()
        while k >= 0:
            depth += (code[k] == "]") - (code[k] == "[")
            if not depth:
                break
            k -= 1
        if k < 0 or last < 0 or not re.search(r"[{};\]]\s*\Z|\A\s*\Z", code[max(0, k - 400) : k]):
            break
        at = k
    return at


def _csharp_spans(code: str) -> list[Span]:
    types = []
    for m in re.finditer(r"\b(?=[a-z])(?:\b(?:public|private|protected|internal|static|sealed|abstract|partial|readonly|ref|unsafe|new|file)\s+)*\b(?:class|interface|struct|record(?:\s+(?:class|struct))?)\s+([A-Za-z_]\w*)", code):
        if not re.search(r"\bwhere\s+\w+\s*:\s*(?:[^{};]*,\s*)?\Z", code[max(0, m.start() - 200) : m.start()]):
            types.append(Span(_from_attributes(code, m.start()), _until(code, m.end()), m[1], True))
    names, out = {s.name for s in types}, []
    # No match begins within a word that could begin it, and words are never given back: they are tried once, not at each letter.
    head = r"(?:(?<![A-Za-z_])|(?=ref\s))((?:\b(?:public|private|protected|internal|static|virtual|override|abstract|sealed|async|extern|unsafe|new|partial|readonly)\s+)*)(?:((?:ref\s+(?:readonly\s+)?)?(?:\([^()]*\)|[A-Za-z_][\w.]*+(?:<[^;{}()=]*>)?)(?:\[[,\s]*\]|\?)*)\s+)?([A-Za-z_][\w.]*+(?:<[^;{}()=]*>\.\w+)?)\s*(?:<[^;{}()=]*>)?\s*\("
    for m in re.finditer(head, code):
        tail = re.compile(r"\s*(?::\s*(?:base|this)\s*(?=\())?").match(code, closing(code, m.end() - 1, "()"))
        after = closing(code, tail.end(), "()") if tail[0].strip() else tail.end()
        stop = re.compile(r"\s*(?:where\s[^{;=]*)?(\{|=>|;)").match(code, after)
        constructor = not m[2] and m[3] in names
        if not stop or m[3] in _NO_METHOD or m[2] in _NO_METHOD | {"return", "throw", "case", "in", "is", "as", "record", "class", "struct", "delegate"} or not (m[2] or constructor):
            continue
        if re.search(r"\bdelegate\s*\Z", code[max(0, m.start() - 20) : m.start()]):
            continue
        end = closing(code, stop.end() - 1) if stop[1] == "{" else stop.end() if stop[1] == ";" else _until(code, stop.end()) if "{" not in code[stop.end() : code.find(";", stop.end()) + 1] else code.find(";", _until(code, stop.end())) + 1 or len(code)
        out.append(Span(_from_attributes(code, m.start()), end, m[3].rpartition(".")[2]))
    # A function counts where a type holds it directly; within another it is local.
    kept, open_ = [], []
    for s in sorted(types + out, key=lambda s: (s.start, -s.end)):
        while open_ and open_[-1].end <= s.start:
            open_.pop()
        if s.is_class or (open_ and open_[-1].is_class):
            kept.append(s)
            open_.append(s)
    return kept


def _go_spans(code: str) -> list[Span]:
    out = []
    for m in re.finditer(r"^func\s+(\((?:[^()]|\([^()]*\))*\)\s*)?([A-Za-z_]\w*)", code, re.MULTILINE):
        out.append(Span(m.start(), _until_line(code, m.end()), m[2]))
    for m in re.finditer(r"^\s*type\s+(\()?", code, re.MULTILINE):
        stop = closing(code, m.end() - 1, "()") if m[1] else (code.find("\n", m.end()) + 1 or len(code))
        for s in re.compile(r"([A-Za-z_]\w*)(?:\[[^\]\n]*\])?\s+(?!=)\S" if not m[1] else r"(?:(?<=\n)|(?<=\())[ \t]*([A-Za-z_]\w*)(?:\[[^\]\n]*\])?[ \t]+(?!=)\S", re.MULTILINE).finditer(code, m.end(), stop):
            out.append(Span(s.start(1), _until_line(code, s.end() - 1), s[1], True))
            if not m[1]:
                break
    return out


def _until_line(code: str, at: int) -> int:
    """The end of a block that opens before the line does, or of the line."""
    while at < len(code) and code[at] != "\n":
        if code[at] in "({[":
            at = closing(code, at, _PAIRS[code[at]])
            continue
        at += 1
    return at - (at > 0 and code[at - 1 : at] == "\r")


def _rust_spans(code: str) -> list[Span]:
    lead = r"(?:\bpub(?:\([^)]*\))?\s+)?"
    out = [Span(m.start(), _until(code, m.end()), m[1]) for m in re.finditer(lead + r"(?:\b(?:const|async|unsafe|default|extern(?:\s+\"?\s*\"?)?)\s+)*\bfn\s+([A-Za-z_]\w*)", code)]
    out += [Span(m.start(), _until(code, m.end()), m[2], True) for m in re.finditer(lead + r"(?:unsafe\s+)?\b(struct|enum|trait)\s+([A-Za-z_]\w*)", code)]
    for m in re.finditer(r"^[ \t]*(?:unsafe\s+)?impl\b\s*(?:<[^{]*?>\s*)?([^{;]*?)\s*(?:\bwhere\b[^{]*)?\{", code, re.MULTILINE):
        of = re.split(r"\bfor\b", m[1])[-1].strip()
        out.append(Span(m.start(), closing(code, m.end() - 1), of, scope_only=True))
    return out


def _bash_spans(code: str) -> list[Span]:
    form = r"(?:^|(?<=[;&|{(\n]))[ \t]*(?:function[ \t]+([\w:.-]+)[ \t]*(?:\([ \t]*\))?|([\w:.-]+)[ \t]*\([ \t]*\))\s*([{(])"
    return [Span(m.start() + len(m[0]) - len(m[0].lstrip()), closing(code, m.end() - 1, _PAIRS[m[3]]), m[1] or m[2]) for m in re.finditer(form, code, re.MULTILINE)]


def _powershell_spans(code: str) -> list[Span]:
    out = [Span(m.start(), _until(code, m.end()), m[1]) for m in re.finditer(r"(?i)\b(?:function|filter|workflow)\s+([\w:.-]+)", code)]
    classes = [Span(m.start(), _until(code, m.end()), m[1], True) for m in re.finditer(r"(?i)^\s*class\s+([A-Za-z_]\w*)", code, re.MULTILINE)]
    classes = [Span(s.start + len(code[s.start :]) - len(code[s.start :].lstrip()), s.end, s.name, True) for s in classes]
    for c in classes:
        for m in re.compile(r"(?:(?:\bstatic|\bhidden)\s+)*(?:\[[^\]\n]*\]\s*)?(?<![\w$.])([A-Za-z_]\w*)\s*\(", re.IGNORECASE).finditer(code, c.start, c.end):
            end = _body(code, m.end() - 1, r"(?i)\s*(?::\s*base\s*\([^)]*\)\s*)?\{") if m[1].lower() not in _NO_METHOD | {"base"} else None
            if end and code.count("{", c.start, m.start()) - code.count("}", c.start, m.start()) == 1:
                out.append(Span(m.start(), end, m[1]))
    return out + classes


_SPANS: dict[str, Callable[[str], list[Span]]] = {
    "csharp": _csharp_spans,
    "javascript": lambda code: _script_spans(code, False),
    "typescript": lambda code: _script_spans(code, True),
    "go": _go_spans,
    "rust": _rust_spans,
    "bash": _bash_spans,
    "powershell": _powershell_spans,
}


def definitions(text: str, language: str) -> list[tuple[str, str, int, int, str]]:
    """(name with scopes, kind, first line, last line, text) of the definitions, the last of the text first.

    Of definitions with the same name and kind the one that comes last here counts, so the earliest of a text does.
    """
    spans = python_spans(text) if language == "python" else _SPANS[language](masked(text, language))
    spans.sort(key=lambda s: (s.start, -s.end))
    out: list[tuple[str, str, int, int, str]] = []
    open_: list[Span] = []
    breaks = [m.start() for m in re.finditer("\n", text)]
    for s in spans:
        while open_ and open_[-1].end <= s.start:
            open_.pop()
        if not s.scope_only and s.name:
            name = ".".join([*(o.name for o in open_ if o.name), s.name])
            last = bisect_left(breaks, max(s.start, s.end - 1)) + 1
            out.append((name, "class" if s.is_class else "function", bisect_left(breaks, s.start) + 1, last, text[s.start : s.end]))
        open_.append(s)
    return out[::-1]


#: Characters of a batch of definitions, which the last file in it may exceed.
_BATCH_CHARS = 1 << 20
_LANGUAGE_OF = {e: language for language, (exts, _) in schema.LANGUAGES.items() for e in exts}
_ARROW = pa.schema([(f.name, pa.int32() if isinstance(f.dataType, IntegerType) else pa.string()) for f in schema.EXTRACTED])


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def carved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """EXTRACTED rows of file_path, ext, content.

    Files are taken out of a batch one at a time, and definitions leave in small batches, however large those of the files are.
    """
    for batch in batches:
        rows, size = [], 0
        for path, ext, raw in zip(*(batch.column(c) for c in ("file_path", "ext", "content")), strict=True):
            path, language = path.as_py(), _LANGUAGE_OF[ext.as_py()]
            text = raw.as_py().decode("utf-8", "replace") if raw.is_valid else ""
            for seq, (name, kind, first, last, body) in enumerate(definitions(text, language)):
                rows.append((path, name, kind, language, first, last, body, seq))
                size += len(path) + len(name) + len(body)
            if size >= _BATCH_CHARS:
                yield _packed(rows)
                rows, size = [], 0
        yield _packed(rows)


def code_symbols(files: DataFrame) -> DataFrame:
    """EXTRACTED rows of source files: file_path and content (bytes) or text; files of other suffixes give none."""
    content = F.col("content") if "content" in files.columns else F.col("text").cast("binary")
    chosen = files.select("file_path", X.suffix("file_path").alias("ext"), content.alias("content")).filter(F.col("ext").isin(*_LANGUAGE_OF))
    return chosen.mapInArrow(carved, schema.EXTRACTED)
