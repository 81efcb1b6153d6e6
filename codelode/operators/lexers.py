"""Blanking what is no code: comments, strings, patterns and here-documents become spaces of the same length.

Each language has a list of forms, tried from left to right; line ends stay, so places and lines do not move.
"""

from __future__ import annotations

import re
from collections.abc import Callable


_BRACKETS = {pair: re.compile(f"[{re.escape(pair)}]") for pair in ("{}", "()", "[]")}


def closing(code: str, at: int, pair: str = "{}") -> int:
    """The position after the bracket that closes the one at ``at``; the text's end if none does."""
    depth = 0
    for m in _BRACKETS[pair].finditer(code, at):
        depth += 1 if m[0] == pair[0] else -1
        if not depth:
            return m.end()
    return len(code)


def _spaces(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


_LINE, _BLOCK = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"
_DOUBLE, _SINGLE = r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'"
_FORMS = {
    "javascript": rf"{_LINE}|{_BLOCK}|{_DOUBLE}|{_SINGLE}|`|/",
    "go": rf"{_LINE}|{_BLOCK}|{_DOUBLE}|{_SINGLE}|`[^`]*`",
    "csharp": rf'{_LINE}|{_BLOCK}|^[ \t]*#[^\n]*|\$*(?P<raw>"""+).*?(?:(?P=raw)|\Z)|\$@?"|@\$"|@"(?:""|[^"])*"|{_DOUBLE}|{_SINGLE}',
    "rust": rf"{_LINE}|/\*|\bb?r(?P<hashes>#*)\".*?(?:\"(?P=hashes)|\Z)|\"(?:\\.|[^\"\\])*\"|'(?:\\[^\n']*|[^'\\\n])'",
    "bash": r"""(?<![^\s;&|()])\#[^\n]*|\(\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\)|<<-?[ \t]*(?P<quote>["']?)(?P<mark>[A-Za-z_]\w*)(?P=quote)|\$'(?:\\.|[^'\\])*'|'[^']*'|"|\\.|<<<""",
    "powershell": r"""<\#.*?(?:\#>|\Z)|\#[^\n]*|@"[ \t]*\n.*?(?:\n"@|\Z)|@'[ \t]*\n.*?(?:\n'@|\Z)|"|'(?:''|[^'])*'|`.""",
}
_FORMS["typescript"] = _FORMS["javascript"]
_COMPILED = {language: re.compile(form, re.DOTALL | re.MULTILINE) for language, form in _FORMS.items()}
#: Words of scripts after which a slash begins a pattern, not a division.
_BEFORE_PATTERN = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "instanceof", "else", "do", "yield", "await"}
_PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")


def _closes_condition(text: str, at: int) -> bool:
    """Whether the bracket at ``at`` ends the condition of a statement, which a pattern may begin after."""
    depth = 0
    for k in range(at, max(-1, at - 2_000), -1):
        depth += (text[k] == ")") - (text[k] == "(")
        if not depth:
            return re.search(r"(?<![\w$.])(?:if|while|for|with|await)\s*\Z", text[max(0, k - 20) : k]) is not None
    return False


def _script_end(text: str, at: int) -> int:
    """The end of a template or a pattern that begins at ``at``; ``at`` + 1 for a division."""
    if text[at] == "/":
        word = re.search(r"([\w$]+|[^\s\w$])\s*\Z", text[max(0, at - 40) : at])
        condition = word and word[1] == ")" and _closes_condition(text, max(0, at - 40) + word.start())
        if word and not condition and (word[1] in ")]" or (re.match(r"[\w$]", word[1]) and word[1] not in _BEFORE_PATTERN)):
            return at + 1
        m = _PATTERN.match(text, at)
        return m.end() if m else at + 1
    at += 1
    while at < len(text) and text[at] != "`":
        if text[at] == "\\":
            at += 1
        elif text.startswith("${", at):
            at = _embedded(text, at + 2, "{", "}", _COMPILED["javascript"], _script_end) - 1
        at += 1
    return at + 1


def _embedded(text: str, at: int, opens: str, closes: str, form: re.Pattern, special: Callable[[str, int], int]) -> int:
    """The end of code in a string, after the bracket that closes it."""
    depth = 1
    while at < len(text):
        m = form.match(text, at)
        if m:
            at = special(text, at) if m[0] in _SPECIAL else m.end()
            continue
        depth += (text[at] == opens) - (text[at] == closes)
        at += 1
        if not depth:
            break
    return at


def _quoted_end(text: str, at: int, language: str) -> int:
    """The end of a string that may hold code with strings of its own: ``$(...)``, or ``{...}`` in C#."""
    escape, (mark, opens, closes) = _ESCAPES[language], ("{", "{", "}") if language == "csharp" else ("$(", "(", ")")
    verbatim = language == "csharp" and "@" in text[at : at + 2]
    at = text.index('"', at) + 1
    special = _END_OF[language]
    while at < len(text):
        if text[at] == escape and not verbatim:
            at += 1
        elif text[at] == '"':
            if not (text.startswith('""', at) and (language == "powershell" or verbatim)):
                return at + 1
            at += 1
        elif language == "csharp" and text.startswith("{{", at):
            at += 1
        elif text.startswith(mark, at):
            at = _embedded(text, at + len(mark), opens, closes, _COMPILED[language], special) - 1
        at += 1
    return at


_ESCAPES = {"bash": "\\", "powershell": "`", "csharp": "\\"}
_END_OF: dict[str, Callable[[str, int], int]] = {language: lambda text, at, language=language: _quoted_end(text, at, language) for language in _ESCAPES}
#: What begins a form whose end must be looked for.
_SPECIAL = {"`", "/", '"', '$"', '$@"', '@$"'}


def _nested_comment(text: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


def masked(text: str, language: str) -> str:
    out, at, form = [], 0, _COMPILED[language]
    documents: list[tuple[str, bool]] = []  # here-documents that the next line begins
    for_lines = re.compile(r"\n")
    while m := form.search(text, at):
        if documents and (line := for_lines.search(text, at, m.start())):
            at = _skip_documents(text, at, line.end(), documents, out)
            continue
        begin, end = m.span()
        if language in ("javascript", "typescript") and m[0] in ("`", "/"):
            end = _script_end(text, begin)
            if m[0] == "/" and end == begin + 1:
                out.append(text[at:end])
                at = end
                continue
        elif language == "rust" and m[0] == "/*":
            end = _nested_comment(text, begin)
        elif language in _ESCAPES and m[0] in _SPECIAL:
            end = _quoted_end(text, begin, language)
        elif language == "bash" and m["mark"]:
            documents.append((m["mark"], m[0].startswith("<<-")))
        out += [text[at:begin], _spaces(text[begin:end])]
        at = end
    if documents and (line := for_lines.search(text, at)):
        at = _skip_documents(text, at, line.end(), documents, out)
        return "".join(out) + masked(text[at:], language)
    code = "".join([*out, text[at:]])
    return _without_macros(code) if language == "rust" else code


def _skip_documents(text: str, at: int, begin: int, documents: list[tuple[str, bool]], out: list[str]) -> int:
    """The place after the here-documents that begin at ``begin``; what is passed over is appended to out."""
    out.append(text[at:begin])
    for mark, tabs in documents:
        m = re.compile(rf"^{'[\t]*' if tabs else ''}{re.escape(mark)}[ \t]*$", re.MULTILINE).search(text, begin)
        end = m.end() if m else len(text)
        out.append(_spaces(text[begin:end]))
        begin = end
    documents.clear()
    return begin


def _without_macros(code: str) -> str:
    """Arguments and bodies of macros are tokens, not items."""
    out, at = [], 0
    for m in re.compile(r"\b[A-Za-z_]\w*!\s*(?:[A-Za-z_]\w*\s*)?([({\[])").finditer(code):
        if m.start() < at:
            continue
        end = closing(code, m.end() - 1, {"(": "()", "{": "{}", "[": "[]"}[m[1]])
        out += [code[at : m.end() - 1], _spaces(code[m.end() - 1 : end])]
        at = end
    return "".join([*out, code[at:]])
