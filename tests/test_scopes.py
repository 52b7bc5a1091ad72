"""Scopes of source files, read from their texts."""

import time

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import graph
from quarrymill.sources import parsers, scopes

PYTHON = '''# g9() in a comment
import os
from .x import y
@route("/a")
async def outer(a,
    b=f(2),
):
    """ def fake(): call()
import nothing
"""
    def inner(b):
        return h1(b)

    s = 'g(1)'  # h()
    return inner(a)
h2(0)
class K:
    def m(self): return q()
    x = z()
t = r"\\\\" + 'it' 's g(3)'
'''
SCRIPT = """// function fake() { h(); }
import a from "./lib";
/* require("no") */ const b = require('yes');
function outer(a = {}) {
  function inner(b) { return h1(b); }
  const s = "}" + `h(${a}) \\` {`;
  return inner(a);
} h2(0);
class K { m() { return q(); } }
"""
RUBY = """require 'x'
# def no
=begin
def neither
=end
class K
  def a
    while x do
      b(1)
    end
    c(2) if d
    [1].each do |z|
      e(3)
    end
  end
  def sq(x) = f(x)
  def self.g
    if x then h(1) end
    i(2)
  end
end
j(4)
"""
GO = """package m
import "fmt"
// func no() {}
type T struct { a int }
func (t *T) Go(x int) int {
	s := `}`
	return f(x)
}
var _ = g(1)
"""
JAVA = """import a.b.C;
@Svc("x)")
public class A {
  abstract void none(int x);
  @Override
  public int run(int x) { if (x > 0) { return go("}"); } return '}'; }
  public abstract int later(int x); static int y = f(2);
}
"""
RUST = """use std::io;
#[derive(X)]
struct S;
fn life<'a>(x: &'a str) -> char { let c = '{'; call(x); '}' }
fn two() { life(1) } // two()
"""


def calls(text, ext):
    return [(name, within) for kind, name, *_, within in scopes.items_of(text, ext) if kind == "call"]


@pytest.mark.parametrize(
    "text, ext, want",
    [
        (PYTHON, ".py", [("route", None), ("f", "outer"), ("h1", "inner"), ("inner", "outer"), ("h2", None), ("q", "m"), ("z", None)]),
        (SCRIPT, ".js", [("require", None), ("h1", "inner"), ("inner", "outer"), ("h2", None), ("m", None), ("q", None)]),
        (RUBY, ".rb", [("b", "a"), ("c", "a"), ("e", "a"), ("f", "sq"), ("h", "g"), ("i", "g"), ("j", None)]),
        (GO, ".go", [("f", "Go"), ("g", None)]),
        (JAVA, ".java", [("Svc", None), ("none", None), ("go", "run"), ("f", None)]),
        (RUST, ".rs", [("derive", None), ("call", "life"), ("life", "two")]),
        ("go() {\n  echo \"${x}\" # }\n  f(1)\n}\nf(2)\n", ".sh", [("f", "go"), ("f", None)]),
        ("<?php\n#[Route]\n# function no() {}\nfunction go($x) { return f('}'); }\ng(1);\n", ".php", [("f", "go"), ("g", None)]),
        ("using A.B;\n[Route(1)]\nclass C {\n  public int Go(int x) { var s = @\"a\"\"}\"; return f(x); } }\n", ".cs", [("Route", None), ("f", "Go")]),
    ],
)
def test_calls_belong_to_the_scope_they_stand_in(text, ext, want):
    assert calls(text, ext) == want


def test_extents_imports_decorators_and_strings():
    found = list(scopes.items_of(PYTHON, ".py"))
    assert {n: PYTHON[a:b] for k, n, a, b, _ in found if k in ("function", "class") and n in ("inner", "m", "K")} == {"inner": "def inner(b):\n        return h1(b)", "m": "def m(self): return q()", "K": "class K:\n    def m(self): return q()\n    x = z()"}
    assert [n for k, n, *_ in found if k == "import"] == ["os", ".x"]
    assert [n for k, n, *_ in scopes.items_of(SCRIPT, ".js") if k == "import"] == ["./lib", "yes"]
    assert [(n, w) for k, n, *_, w in found if k == "decorator"] == [("@route", None)]
    assert [n for k, n, *_ in found if k == "string"] == ["/a", ' def fake(): call()\nimport nothing\n', "g(1)", "\\\\", "it", "s g(3)"]


@pytest.mark.parametrize("text", ["", "'", '"""', "/*", "}}}{", "def", "def f(", "def f(:\n(\n)", "\n\n", "end end", "class A {", "function f(a = {}", "`", "\\", "'\\"])
@pytest.mark.parametrize("ext", sorted(scopes.LANGUAGES))
def test_broken_files_are_read_all_the_same(text, ext):
    for _, _, start, stop, _ in scopes.items_of(text, ext):
        assert 0 <= start <= stop <= len(text)


def test_large_files_take_time_in_proportion():
    many = "".join(f"def f{i}(a):\n    return g{i}(a)\n" for i in range(20_000)) + "top()\n" * 20_000
    began = time.process_time()
    assert calls(many, ".py")[-1] == ("top", None)
    deep = "".join("function f%d() { " % i for i in range(3000)) + "x(1); " + "}" * 3000
    assert calls(deep, ".js")[-1] == ("x", "f2999")
    assert time.process_time() - began < 20


def test_null_texts_and_unknown_files(spark):
    files = spark.createDataFrame([("a.py", None), ("b.md", "def f(): g()"), ("c.py", "def f(): g()"), ("c.py", "def f(): g()")], "path string, text string")
    assert sorted((r["path"], r["kind"], r["within"]) for r in scopes.items(files).collect()) == [("c.py", "call", "f"), ("c.py", "call", "f"), ("c.py", "function", None), ("c.py", "function", None)]
    assert scopes.items(files.where("false")).collect() == []
    edges = {tuple(r) for r in parsers.build_graph(files)[1].collect()}
    assert edges == {("c.py", "c.py:f", "defines"), ("b.md", "b.md:f", "defines")}


def test_a_decorator_meets_only_what_starts_near_it(spark):
    marks = spark.range(2000).select(F.lit("f").alias("file"), F.concat(F.lit("@d"), "id").alias("name"), (F.col("id") * 500).alias("stop"))
    defined = spark.range(50_000).select(F.lit("f").alias("file"), F.concat(F.lit("g"), "id").alias("name"), F.lit("function").alias("type"), (F.col("id") * 20 + 7).alias("start"))
    near = graph.attached_decorators(marks, defined)
    assert near.count() == 2000 and near.where("decorator = '@d1'").first()["target"] == "g25"
    plan = near._jdf.queryExecution().toString()
    assert "stretch" in plan and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
