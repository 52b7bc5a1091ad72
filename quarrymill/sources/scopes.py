"""What source files define, import, decorate, call and quote, with the function around each.

A file's comments and strings are blanked first, of the same length, so that nothing in them counts and every place stays.
Definitions then get extents by one walk over the rest with a stack of what is open: lines by their indentation, braces, or
words that an `end` closes. What stands in an extent belongs to the innermost one. A file is read by itself, in a small
helper; whatever joins names or files is left to Spark.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import text as T

_QUOTED = r'"(?:[^"\\\n]|\\.)*+"'
_SINGLE = r"'(?:[^'\\\n]|\\.)*+'"
_BLOCK = r"/\*.*?(?:\*/|\Z)"
_LINE = r"//[^\n]*"


class Language(NamedTuple):
    """comment and string: what is blanked; style: what an extent ends by; the others: one group each that is a name."""

    style: str
    comment: str
    string: str
    function: str
    kind: str = r"(?!)"
    imported: str = r"(?!)"
    decorator: str = r"(?!)"


_MODIFIED = r"(?m)^[ \t]*(?:(?:%s)\s+)+[\w<>\[\], ?.]+?\s+([A-Za-z_]\w*)\s*\("
_SCRIPT = Language(
    "brace", f"{_LINE}|{_BLOCK}", rf"{_QUOTED}|{_SINGLE}|`(?:[^`\\]|\\.)*+`", r"\bfunction\b\s*\*?\s*([A-Za-z_$][\w$]*)", r"\bclass\s+([A-Za-z_$][\w$]*)",
    r"(?:\bfrom\s+['\"]([^'\"\n]+)['\"]|\brequire\(\s*['\"]([^'\"\n]+)['\"])", r"(?m)^[ \t]*(@[\w.]+)",
)
LANGUAGES = {
    ".py": Language("indent", r"#[^\n]*", rf'(?:\b[rRbBuUfF]{{1,2}})?(?:"""(?:[^\\]|\\.)*?(?:"""|\Z)|\'\'\'(?:[^\\]|\\.)*?(?:\'\'\'|\Z)|{_QUOTED}|{_SINGLE})', r"(?m)^[ \t]*(?:async\s+)?def\s+([A-Za-z_]\w*)", r"(?m)^[ \t]*class\s+([A-Za-z_]\w*)", r"(?m)^[ \t]*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", r"(?m)^[ \t]*(@[\w.]+)"),
    ".js": _SCRIPT,
    ".ts": _SCRIPT,
    ".java": Language("brace", f"{_LINE}|{_BLOCK}", rf'"""(?:[^\\]|\\.)*?(?:"""|\Z)|{_QUOTED}|{_SINGLE}', _MODIFIED % "public|private|protected|static|final", r"\bclass\s+([A-Za-z_]\w*)", r"(?m)^import\s+(?:static\s+)?([\w.]+)", r"(?m)^[ \t]*(@[\w.]+)"),
    ".go": Language("brace", f"{_LINE}|{_BLOCK}", rf"{_QUOTED}|{_SINGLE}|`[^`]*`", r"(?m)^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)", r"(?m)^type\s+([A-Za-z_]\w*)", r"(?m)^(?:import\s+|\s+)\"([^\"\n]+)\""),
    ".cs": Language("brace", f"{_LINE}|{_BLOCK}", rf'@"(?:[^"]|"")*+"|{_QUOTED}|{_SINGLE}', _MODIFIED % "public|private|protected|internal|static|async", r"\bclass\s+([A-Za-z_]\w*)", r"(?m)^using\s+([\w.]+)", r"(?m)^[ \t]*(\[[\w.]+)"),
    ".rb": Language("end", r"#[^\n]*|^=begin.*?^=end", rf"{_QUOTED}|{_SINGLE}", r"(?m)^[ \t]*def\s+(?:self\.)?([A-Za-z_]\w*[?!]?)", r"(?m)^[ \t]*class\s+([A-Z]\w*)", r"(?m)^[ \t]*require(?:_relative)?\s+['\"]([^'\"\n]+)['\"]"),
    ".php": Language("brace", rf"{_LINE}|#(?!\[)[^\n]*|{_BLOCK}", rf"{_QUOTED}|{_SINGLE}", r"\bfunction\s+([A-Za-z_]\w*)", r"\bclass\s+([A-Za-z_]\w*)", r"(?m)^(?:use\s+([\w\\]+)|(?:include|require)(?:_once)?\s*\(?['\"]([^'\"\n]+)['\"])", r"(#\[\w+)"),
    ".sh": Language("brace", r"(?<![^\s;])#[^\n]*", r'"(?:[^"\\]|\\.)*+"|\'[^\']*\'', r"(?m)^[ \t]*(?:function\s+)?([A-Za-z_]\w*)\s*\(\)", imported=r"(?m)^[ \t]*(?:source|\.)\s+(\S+)"),
    ".rs": Language("brace", f"{_LINE}|{_BLOCK}", rf"{_QUOTED}|'(?:[^'\\\n]|\\.)'", r"\bfn\s+([A-Za-z_]\w*)", r"\b(?:struct|impl)\s+([A-Za-z_]\w*)", r"(?m)^use\s+([\w:]+)", r"(#\[\w+)"),
}
#: What stands before a bracket without being called.
NOT_CALLED = frozenset(("if", "for", "while", "switch", "catch", "return", "def", "function", "func", "fn", "class", "elif", "and", "or", "not", "in"))
_CALL = re.compile(r"([A-Za-z_][\w.]*)\s*\(")
_RUBY = re.compile(r"(?m)^[ \t]*(?:def|class|module|if|unless|case|while|until|for|begin)\b|\bdo\b|(?<==)[ \t]*(?:if|unless|case|begin)\b|\bend\b")
_READ = {ext: {what: re.compile(getattr(lang, what)) for what in ("function", "kind", "imported", "decorator")} | {"blank": re.compile(f"(?sm)(?P<c>{lang.comment})|{lang.string}")} for ext, lang in LANGUAGES.items()}


class Item(NamedTuple):
    kind: str
    name: str
    start: int
    stop: int


def blanked(text: str, ext: str) -> tuple[str, list[Item]]:
    """The text with comments and the insides of strings as blanks, line ends kept, and the strings."""
    strings: list[Item] = []

    def blank(m: re.Match) -> str:
        if m["c"] is not None:
            return re.sub(r"[^\n]", " ", m[0])
        body = m[0].lstrip("rRbBuUfF@")
        mark = body[:3] if body[:3] in ('"""', "'''") else body[0]
        strings.append(Item("string", body[len(mark) : len(body) - len(mark) if body.endswith(mark) else None], m.start(), m.end()))
        return m[0][: len(m[0]) - len(body) + 1] + re.sub(r"[^\n]", " ", body[1:-1]) + body[-1:]

    return _READ[ext]["blank"].sub(blank, text), strings


def _by_indent(text: str, starts: list[int]) -> list[int]:
    """Where each definition ends: before the first later line, outside brackets, that isn't indented further. starts: of their first words."""
    ends, stack, depth, at, last = [0] * len(starts), [], 0, 0, 0
    which = {s: i for i, s in enumerate(starts)}
    for line in text.split("\n"):
        body = line.strip()
        indent = len(line) - len(line.lstrip())
        if body and depth == 0:
            while stack and stack[-1][0] >= indent:
                ends[stack.pop()[1]] = last
            if at + indent in which:
                stack.append((indent, which[at + indent]))
        depth = max(0, depth + sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}"))
        at += len(line) + 1
        last = at - 1 - (len(line) - len(line.rstrip())) if body else last
    for _, i in stack:
        ends[i] = last
    return ends


def _by_braces(text: str, starts: list[int]) -> list[int]:
    """Where each definition ends: behind the brace that closes the first one after its brackets, or before a semicolon that comes first."""
    ends, stack, waiting, depth = [-1] * len(starts), [], None, 0
    opened, k = 0, 0
    for m in re.finditer(r"[{}();]", text):
        while k < len(starts) and starts[k] <= m.start():
            waiting, opened, k = k, depth, k + 1
        c = m[0]
        if c in "()":
            depth = max(0, depth + (1 if c == "(" else -1))
        elif c == "{":
            mine = waiting if waiting is not None and depth == opened else None
            stack.append((mine, depth))
            if mine is not None:
                waiting = None
        elif c == "}" and stack:
            mine, depth = stack.pop()
            if mine is not None:
                ends[mine] = m.end()
        elif c == ";" and waiting is not None and depth == opened:
            ends[waiting], waiting = m.start(), None
    return [len(text) if e < 0 else e for e in ends]


def _by_words(text: str, starts: list[int]) -> list[int]:
    """Where each definition ends: behind its `end`."""
    ends, stack, loops = [len(text)] * len(starts), [], -1
    which = {s: i for i, s in enumerate(starts)}
    for m in _RUBY.finditer(text):
        word, at = m[0].strip(), m.end() - len(m[0].lstrip())
        line_end = text.find("\n", m.end())
        if word == "end":
            if stack and (mine := stack.pop()) is not None:
                ends[mine] = m.end()
        elif word == "do" and at < loops:
            continue  # of a loop whose word has opened it
        elif word == "def" and re.match(r"[^\n;]*?\)\s*=\s", text[m.end() :]):
            ends[which[at]] = len(text) if line_end < 0 else line_end
        else:
            loops = (len(text) if line_end < 0 else line_end) if word in ("while", "until", "for") else loops
            stack.append(which.get(at))
    return ends


_EXTENTS = {"indent": _by_indent, "brace": _by_braces, "end": _by_words}


def items_of(text: str, ext: str) -> Iterator[tuple[str, str, int, int, str | None]]:
    """(kind, name, start, stop, within) of everything in a file: functions and classes with their extents, the others with their places."""
    masked, strings = blanked(text, ext)
    read = _READ[ext]
    defined = []
    for kind, what in (("function", "function"), ("class", "kind")):
        defined += [(m.end() - len(m[0].lstrip()), m.start(1), kind, m[1]) for m in read[what].finditer(masked)]
    defined.sort()
    ends = _EXTENTS[LANGUAGES[ext].style](masked, [d[0] for d in defined])
    scopes = [Item(kind, name, start, max(stop, start)) for (start, _, kind, name), stop in zip(defined, ends, strict=True)]
    marks = [Item("decorator", m[1], m.start(1), m.end(1)) for m in read["decorator"].finditer(masked)]
    for m in read["imported"].finditer(text):
        g = m.lastindex or 0
        word = m.end() - len(m[0].lstrip())
        if masked[word] == text[word] and masked[m.start(g) - 1] == text[m.start(g) - 1]:  # not in a comment or string
            marks.append(Item("import", m[g], m.start(g), m.end(g)))
    names = {d[1] for d in defined}
    marks += [Item("call", m[1], m.start(1), m.end(1)) for m in _CALL.finditer(masked) if m.start(1) not in names and m[1] not in NOT_CALLED]
    functions = [s for s in scopes if s.kind == "function"]
    begins, around, stack = [f.start for f in functions], [], []
    for i, f in enumerate(functions):
        while stack and functions[stack[-1]].stop <= f.start:
            stack.pop()
        around.append(stack[-1] if stack else -1)
        stack.append(i)
    for item in [*scopes, *marks, *strings]:
        i = bisect_right(begins, item.start - (item.kind in ("function", "class"))) - 1
        while i >= 0 and functions[i].stop < item.stop:
            i = around[i]
        yield (*item, functions[i].name if i >= 0 else None)


def items(files: DataFrame) -> DataFrame:
    """path, kind (function, class, import, decorator, call, string), name, start, stop (characters from 0) and within of files (path, text) of known extensions.

    within: the innermost function around it, null outside of all. Names of 200 characters or more are none. A null text is empty.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "kind", "name", "start", "stop", "within"]
        for part in parts:
            rows: list[tuple] = []
            for path, ext, text in zip(part["path"], part["ext"], part["text"], strict=True):
                rows += [(path, *item) for item in items_of(text, ext)]
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    known = files.select("path", T.suffix(F.col("path")).alias("ext"), F.coalesce("text", F.lit("")).alias("text")).where(F.col("ext").isin(list(LANGUAGES)))
    found = known.mapInPandas(run, "path string, kind string, name string, start long, stop long, within string")
    return found.where((F.col("kind") == "string") | T.sane_length(F.col("name"), "identifier"))
