"""Globs as regular expressions, made once on the driver."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _segment(glob: str) -> str:
    """One path component: * and ? stay within it."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = end
        else:
            out += re.sub(r"([\\.^$|()\[\]{}*+?])", r"\\\1", c)
        i += 1
    return out


def match_regex(glob: str) -> str:
    """The right-anchored dialect: as many components as the glob has, from the right; ** is one component."""
    parts = [p for p in glob.split("/") if p]
    body = "/".join(_segment(p) if p != "**" else "[^/]+" for p in parts)
    return f"^{body}$" if glob.startswith("/") else f"(?:^|/){body}$"


class GlobIndex:
    """Many globs of the right-anchored dialect as a tree of components from the right; a path walks only the branches that it fits.

    A branch without wildcards is found by name. One with wildcards is found by the fixed text that it ends with, else by
    the one that it begins with, and then tried; only what has neither is tried on every component.
    """

    def __init__(self, globs: Sequence[str]):
        self.root = _Node()
        for number, glob in enumerate(globs):
            node = self.root
            for part in reversed([p for p in glob.split("/") if p]):
                node = node.below(part)
            (node.rooted if glob.startswith("/") else node.ends).append(number)
        self.tried = 0

    def matches(self, path: str) -> list[int]:
        """Numbers of the globs that a path has, ascending."""
        found: list[int] = []
        parts = path.split("/")
        todo = [(self.root, len(parts))]
        while todo:
            node, left = todo.pop()
            if node is not self.root:
                found += node.ends if left else [*node.ends, *node.rooted]
            if left:
                for child in node.fitting(parts[left - 1], self):
                    todo.append((child, left - 1))
        return sorted(found)


class _Node:
    def __init__(self) -> None:
        self.ends: list[int] = []
        self.rooted: list[int] = []
        self.exact: dict[str, _Node] = {}
        self.wild: dict[str, _Node] = {}
        #: What wildcards stand before, behind, or on both sides of: fixed text -> (pattern, child)s.
        self.tails: dict[str, list[tuple[re.Pattern[str], _Node]]] = {}
        self.heads: dict[str, list[tuple[re.Pattern[str], _Node]]] = {}

    def below(self, part: str) -> _Node:
        if part != "**" and not set(part) & set("*?["):
            return self.exact.setdefault(part, _Node())
        if part not in self.wild:
            child = self.wild[part] = _Node()
            pattern = re.compile("[^/]+" if part == "**" else _segment(part), re.DOTALL)
            tail, head = re.search(r"[^*?\[\]]*$", part)[0], re.match(r"[^*?\[]*", part)[0]
            table, fixed = (self.tails, tail) if tail or not head else (self.heads, head)
            table.setdefault(fixed, []).append((pattern, child))
        return self.wild[part]

    def fitting(self, name: str, index: GlobIndex) -> list[_Node]:
        found = [self.exact[name]] if name in self.exact else []
        for table, cut in ((self.tails, lambda n: name[len(name) - n :]), (self.heads, lambda n: name[:n])):
            for size in {len(k) for k in table} if len(table) < len(name) else range(len(name) + 1):
                if size <= len(name):
                    for pattern, child in table.get(cut(size), ()):
                        index.tried += 1
                        if pattern.fullmatch(name):
                            found.append(child)
        return found


def path_regex(glob: str) -> str:
    """The whole-path dialect: ** is any number of components, none included; at the end, it is anything below."""
    parts, out = [p for p in glob.split("/") if p], "^"
    for i, p in enumerate(parts):
        last = i == len(parts) - 1
        if p == "**":
            out += ".*" if last else "(?:[^/]+/)*"
        else:
            out += _segment(p) + ("" if last else "/")
    return out + "$"


def reduce_glob(glob: Column) -> Column:
    """A glob as the suffix or the name that decides it: its last component without leading stars; if that has a
    dot, the dot and what follows the last one; null if nothing is left."""
    last = F.regexp_replace(F.element_at(F.split(glob, "/"), -1), r"^\*+", "")
    short = F.when(F.instr(last, ".") > 0, F.concat(F.lit("."), F.element_at(F.split(last, r"\."), -1))).otherwise(last)
    return F.when(last == "", None).otherwise(short)


def matches_reduced(path: Column, reduced: Column) -> Column:
    """Whether a path has the suffix (.x) or is the file of that name."""
    return F.when(F.startswith(reduced, F.lit(".")), F.endswith(path, reduced)).otherwise((path == reduced) | F.endswith(path, F.concat(F.lit("/"), reduced)))


#: Files that a scan leaves out.
EXCLUDED_PATHS = (
    "**/.git/**", "**/.svn/**", "**/.hg/**",
    "**/.vscode/**", "**/.idea/**", "**/.project/**", "**/.settings/**", "**/*.code-workspace",
    "**/node_modules/**", "**/bower_components/**", "**/vendor/**",
    "**/dist/**", "**/build/**", "**/target/**", "**/bin/**", "**/obj/**", "**/__pycache__/**", "**/*.egg-info/**",
    "**/*.log", "**/logs/**", "**/*.tmp", "**/*.swp", "**/*.swo",
    "**/*.png", "**/*.jpg", "**/*.jpeg", "**/*.gif", "**/*.svg", "**/*.ico", "**/*.webp",
    "**/*.pdf", "**/*.doc", "**/*.docx", "**/*.xls", "**/*.xlsx", "**/*.ppt", "**/*.pptx",
    "**/*.zip", "**/*.tar", "**/*.gz", "**/*.rar", "**/*.7z", "**/*.jar", "**/*.war", "**/*.ear",
    "**/*.mp3", "**/*.mp4", "**/*.avi", "**/*.mov", "**/*.flv", "**/*.wmv",
    "**/*.eot", "**/*.ttf", "**/*.woff", "**/*.woff2",
    "**/*.dll", "**/*.exe", "**/*.so",
    "**/.*",
    "**/package-lock.json", "**/yarn.lock", "**/composer.lock", "**/Gemfile.lock", "**/Pipfile.lock", "**/poetry.lock",
    "**/*.min.js", "**/*.min.css", "**/*.map", "**/*.bundle.js", "**/*.chunk.js", "**/*-lock.json", "**/*.generated.*", "**/*.pb.go", "**/*_pb2.py", "**/*.d.ts",
)


def excluded(path: Column, globs: tuple[str, ...] = EXCLUDED_PATHS) -> Column:
    """Whether any of the globs takes a path (relative to the scanned folder): one alternation, no join."""
    return path.rlike("|".join(f"(?:{path_regex(g)})" for g in globs))
