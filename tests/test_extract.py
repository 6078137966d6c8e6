"""Extraction rules on inline source text."""

import argparse
import ast
import dataclasses
import inspect
import pathlib
import typing

import pytest
from pyspark.sql import functions as F

from archgraph.operators.extract import extract_ir, extract_rows, parse_summary
from archgraph.operators.python_source import extract_python
from archgraph.operators.resolve import resolve_relationships

SOURCE = '''"""Shop orders."""
import json
from decimal import Decimal as D, ROUND_UP
from . import prices
from ..core.store import *
from __future__ import annotations


class Entity:
    pass


class Order(Entity, base.Mixin, metaclass=Meta, *extra):
    """An order."""

    limit = compute()

    @staticmethod
    @app.post("/orders",
              tags=[1])
    def create(items=default()):
        """Create it."""
        def check(x):
            return inner(x)
        rows = [round(price(i)) for i in items]
        return store.session.add(json.dumps(rows)), (pick or choose)(1), table[0](2)

    if True:
        async def later(self):
            await self.create(lambda v: hook(v))


def helper(x):
    import os.path
    return x + 1
'''


def extracted(source, path="shop/orders.py"):
    emitted = list(extract_python(path, source))
    symbols = [f for kind, f in emitted if kind == "symbol"]
    relationships = [f for kind, f in emitted if kind == "relationship"]
    errors = [f for kind, f in emitted if kind == "error"]
    return symbols, relationships, errors


@pytest.fixture(scope="module")
def parts():
    return extracted(SOURCE)


def names(symbols, kind):
    return [s["qualified_name"] for s in symbols if s["symbol_type"] == kind]


def test_file_symbol(parts):
    file = parts[0][0]
    assert (file["id"], file["name"], file["symbol_type"]) == ("shop.orders", "orders.py", "file")
    assert file["docstring"] == '"""Shop orders."""'
    assert (file["start_line"], file["end_line"]) == (1, SOURCE.count("\n") + 1)


def test_classes_functions_and_methods(parts):
    assert names(parts[0], "class") == ["shop.orders.Entity", "shop.orders.Order"]
    assert names(parts[0], "method") == ["shop.orders.Order.create", "shop.orders.Order.later"]
    assert names(parts[0], "function") == ["shop.orders.Order.create.check", "shop.orders.helper"]


def test_decorators_docstring_and_span(parts):
    create = next(s for s in parts[0] if s["name"] == "create")
    assert create["decorators"] == ["@staticmethod", '@app.post("/orders",\n              tags=[1])']
    assert create["docstring"] == '"""Create it."""'
    assert SOURCE.split("\n")[create["start_line"] - 1].strip().startswith("def create")


def test_imports(parts):
    assert names(parts[0], "import") == [
        "json", "decimal.Decimal", "decimal.ROUND_UP", "..prices", "..core.store.*", "os.path"]
    json_import = next(s for s in parts[0] if s["name"] == "json")
    assert json_import["id"] == "shop/orders.py::import::json::1"
    inside = next(r for r in parts[1] if r["target_name"] == "os.path")
    assert (inside["source_id"], inside["confidence"]) == ("shop.orders.helper", 1.0)


def test_bases_must_be_names(parts):
    bases = [r for r in parts[1] if r["relationship_type"] == "inherits"]
    assert [(r["target_name"], r["confidence"]) for r in bases] == [("Entity", 0.6), ("base.Mixin", 0.6)]


def test_calls_belong_to_the_innermost_function(parts):
    calls = [(r["source_id"].rsplit(".", 1)[-1], r["target_name"]) for r in parts[1]
             if r["relationship_type"] == "calls"]
    assert [t for s, t in calls if s == "create"] == [
        "round", "price", "add", "json.dumps", "(pick or choose)", "table[0]"]
    assert [t for s, t in calls if s == "check"] == ["inner"]
    assert [t for s, t in calls if s == "later"] == ["self.create", "hook"]
    assert not [t for _, t in calls if t in ("compute", "default", "app.post")]


def test_contains(parts):
    contains = {(r["source_id"], r["target_id"]) for r in parts[1] if r["relationship_type"] == "contains"}
    assert ("shop.orders", "shop.orders.Order") in contains
    assert ("shop.orders.Order", "shop.orders.Order.later") in contains
    assert ("shop.orders.Order.create", "shop.orders.Order.create.check") in contains
    assert len(contains) == 6


@pytest.mark.parametrize("source, docstring", [
    ("'one'\n", "'one'"),
    ("# note\n'one'\n", None),
    ("\n\n'one'\n", "'one'"),
    ("'one' 'two'\n", None),
    ("('one')\n", None),
    ("'one'.upper()\n", None),
    ("x = 1\n'one'\n", None),
    ("r'''a\n\"b'''\n", "r'''a\n\"b'''"),
    ("'" + "x" * 600 + "'\n", "'" + "x" * 600 + "'"),
])
def test_docstrings(source, docstring):
    assert extracted(source)[0][0]["docstring"] == docstring


@pytest.mark.parametrize("expression, name", [
    ("f()", "f"), ("a.b()", "a.b"), ("a.b.c()", "c"), ("a().b()", "b"), ("(a)()", "(a)"), ("(a).b()", "b"),
    ("f()()", "f()"), ("d['k']()", "d['k']"), ("(lambda: 1)()", "(lambda: 1)"), ("'é'.join(x)", "join"),
    ("f'{g(1)}'", "g"), ("d['" + "k" * 100 + "']()", "d['" + "k" * 100 + "']"),
])
def test_callee_names(expression, name):
    calls = [r["target_name"] for r in extracted(f"def run():\n    é = 1; {expression}\n")[1]
             if r["relationship_type"] == "calls"]
    assert calls[0] == name


def test_other_line_ends_and_marks():
    symbols, relationships, errors = extracted("\ufeff'doc'\r\nclass A:\r\n    def m(self):\r\n        go()\r\n")
    assert not errors and symbols[0]["docstring"] == "'doc'" and symbols[0]["end_line"] == 5
    assert relationships[-1]["target_name"] == "go" and relationships[-1]["source_line"] == 4


def test_package_file_and_foreign_suffix():
    assert extracted("", "pkg/__init__.py")[0][0]["id"] == "pkg.__init__"
    assert extracted("", "pkg/tool.PY")[0][0]["id"] == "pkg.tool.PY"


class Recount(ast.NodeVisitor):
    """Calls per function body by recursion, as an independent count."""

    def __init__(self):
        self.calls, self.owner = [], None

    def visit_FunctionDef(self, node):
        outer, self.owner = self.owner, node.name
        for child in node.body:
            self.visit(child)
        self.owner = outer

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node):
        outer, self.owner = self.owner, None
        for child in node.body:
            self.visit(child)
        self.owner = outer

    def visit_Call(self, node):
        if self.owner:
            self.calls.append((self.owner, node.lineno))
        self.generic_visit(node)


@pytest.mark.parametrize("module", [ast, argparse, typing, dataclasses, inspect])
def test_calls_of_real_modules(module):
    source = pathlib.Path(module.__file__).read_text()
    recount = Recount()
    recount.visit(ast.parse(source))
    _, relationships, errors = extracted(source, "lib.py")
    found = [(r["source_id"].rsplit(".", 1)[-1], r["source_line"]) for r in relationships
             if r["relationship_type"] == "calls"]
    assert not errors and sorted(found) == sorted(recount.calls)


def test_deep_nesting_is_no_failure():
    symbols, _, errors = extracted("x = " + "(" * 5000 + ")" * 5000)
    assert symbols[0]["symbol_type"] == "file" and len(errors) == 1


BROKEN = '''"""Text
def not_a_definition(:
"""
import os

@first(
    1)
class A(B):
    """Kept."""
    def sound(self):
        return one()

    def broken(self,
               y):
        print "x"
        return two()

    @property
    def last(self):
        return """
def inside a string
"""

x = = 1
if True:
    def guarded(): return three()
else:
    print "no"

async def tail(y):
\treturn y.go()
'''


def test_what_parses_of_a_broken_file_is_kept():
    symbols, relationships, errors = extracted(BROKEN)
    assert len(errors) == 1 and symbols[0]["docstring"].startswith('"""Text')
    found = {(s["name"], s["symbol_type"], s["start_line"], s["end_line"]) for s in symbols[1:]}
    assert found == {("os", "import", 4, 4), ("A", "class", 8, 22), ("sound", "method", 10, 11), ("broken", "method", 13, 16),
                     ("last", "method", 19, 22), ("guarded", "function", 26, 26), ("tail", "function", 30, 31)}
    calls = [r["target_name"] for r in relationships if r["relationship_type"] == "calls"]
    assert calls == ["one", "two", "three", "y.go"]


def test_whole_callee_text_is_the_target():
    chain = "a" + "".join(f".m{i}(1)" for i in range(40))
    _, relationships, _ = extracted(f"def f():\n    ({chain})(2)\n")
    assert max(len(r["target_name"]) for r in relationships if r["relationship_type"] == "calls") > 200


@pytest.mark.parametrize("source", ["print x\n", "class A:\n", "  x = 1\n", "\x00", "def f(:\n" * 50, '"""open\nclass A: pass\n'])
def test_faults_of_any_kind_give_one_error(source):
    symbols, _, errors = extracted(source)
    assert symbols[0]["symbol_type"] == "file" and len(errors) == 1


def test_tables_keep_going_after_a_bad_file(tables):
    files = tables.rows(
        "repo_id string, path string, size_bytes long, content string",
        ("r", "shop/orders.py", 1, SOURCE), ("r", "bad.py", 1, "def f(:\n  pass"), ("r", "empty.py", 0, ""),
        ("r", "gone.py", 0, None), ("r", "page.js", 1, "function f() {}"), ("r", "node_modules/p/i.py", 1, SOURCE),
        ("r", "venv/lib/q.py", 1, "def f(:"))
    ir = extract_ir(files)
    assert {r.file_path for r in ir.parse_errors.collect()} == {"bad.py"}
    assert ir.symbols.filter("symbol_type = 'file'").count() == 3
    assert ir.symbols.select("repo_id", "file_path", "seq").distinct().count() == ir.symbols.count()
    summary = parse_summary(files, ir.parse_errors).first()
    assert (summary.parsed_files, summary.parse_errors) == (3, 1)


def test_an_extractor_that_raises_keeps_what_it_emitted(tables):
    def failing(path, content):
        yield next(extract_python(path, content))
        raise KeyError("lost")

    files = tables.rows("repo_id string, path string, size_bytes long, content string", ("r", "a.py", 1, "x = 1"))
    ir = extract_ir(files, {"python": failing})
    assert ir.symbols.count() == 1
    assert ir.parse_errors.first().error.startswith("KeyError")


def test_resolution_within_a_file(tables):
    files = tables.rows("repo_id string, path string, size_bytes long, content string",
                        ("r", "shop/orders.py", 1, SOURCE))
    ir = extract_ir(files)
    links = resolve_relationships(ir.symbols, ir.relationships).filter(F.col("target_id").isNotNull())
    found = {(r.target_name, r.relationship_type): (r.target_id, r.confidence) for r in links.collect()}
    assert found[("Entity", "inherits")] == ("shop.orders.Entity", 0.75)
    assert found[("self.create", "calls")] == ("shop.orders.Order.create", 0.75)
    assert found[("json", "imports")] == ("shop/orders.py::import::json::1", 0.95)


BLOCKS = """\
import os

if os.name == "nt" and detect(os):
    import ntpath
    class Windows(Base):
        def path(self):
            return joined(self)
    x = = 1
elif fallback():
    def posix():
        return plain()
else:
    y = [1, 2
    def other():
        pass

try:
    import fast
    z = = 2
    def quick():
        return fast.run()
except (ImportError, lookup.Error) as problem:
    def slow():
        return problem
finally:
    def last():
        pass

for item in listed(
        os):
    print "x"
    def in_loop(): return item

while waiting():
    broken broken
    class Waits:
        pass

with opened(os) as f, other(f):
    f = = f
    async def within():
        return f.read()

def outer():
    before()
    if check():
        a = = 1
        inner_call()
        def nested():
            deep()
    after()

match os.name:
    case "posix":
        b = = 3
        def matched():
            pass
    case other if guard(other):
        def guarded():
            pass

if bad = = header:
    def under_bad_header():
        pass

def sound_tail():
    pass
"""


def test_broken_blocks_keep_every_sound_definition():
    emitted = list(extract_python("m.py", BLOCKS))
    lines = BLOCKS.split("\n")
    found = {(f["qualified_name"], f["symbol_type"]) for kind, f in emitted if kind == "symbol"}
    expected = {("m", "file"), ("os", "import"), ("ntpath", "import"), ("fast", "import"), ("m.Windows", "class"), ("m.Windows.path", "method"),
                ("m.posix", "function"), ("m.other", "function"), ("m.quick", "function"), ("m.slow", "function"), ("m.last", "function"),
                ("m.in_loop", "function"), ("m.Waits", "class"), ("m.within", "function"), ("m.outer", "function"), ("m.outer.nested", "function"),
                ("m.matched", "function"), ("m.guarded", "function"), ("m.under_bad_header", "function"), ("m.sound_tail", "function")}
    assert found == expected
    for kind, f in emitted:
        if kind == "symbol" and f["symbol_type"] in ("class", "function", "method"):
            assert f["name"] in lines[f["start_line"] - 1]
    calls = {(f["source_id"], f["target_name"]) for kind, f in emitted if kind == "relationship" and f["relationship_type"] == "calls"}
    assert calls == {("m.Windows.path", "joined"), ("m.posix", "plain"), ("m.quick", "fast.run"), ("m.within", "f.read"), ("m.outer", "before"),
                     ("m.outer", "check"), ("m.outer", "inner_call"), ("m.outer.nested", "deep"), ("m.outer", "after")}
    assert [kind for kind, _ in emitted].count("error") == 1


@pytest.mark.parametrize("fault", ["x = = 1", "print 'y'", "return return", "a b c", "def f(:"])
@pytest.mark.parametrize("opening", ["if c:", "while c:", "for i in c:", "with c:", "try:", "class K:", "def k():"])
def test_a_fault_in_a_block_costs_its_own_line(opening, fault):
    source = f"{opening}\n    def first(): pass\n    {fault}\n    def second(): pass\n" + ("finally:\n    pass\n" if opening == "try:" else "")
    names = {f["name"] for kind, f in extract_python("m.py", source) if kind == "symbol"}
    assert {"first", "second"} <= names


def test_files_of_one_part_are_parsed_by_several_tasks(spark):
    files = spark.range(0, 400, 1, 1).selectExpr("'r' repo_id", "concat('f', id, '.py') path", "length('x = 1') size_bytes", "'def f(): pass' content")
    rows = extract_rows(files).withColumn("task", F.spark_partition_id())
    assert rows.select("task").distinct().count() > 1
    assert rows.filter("kind = 'symbol'").count() == 800
