"""Symbols and relationships of one Python source text.

A generator over a single file, used inside the extraction tasks. Everything
that needs more than one file happens in Spark.
"""

import ast
import re
from functools import cache

# Confidences of the extraction rules.
CALL_CONFIDENCE = 0.5
BASE_CONFIDENCE = 0.6
CERTAIN = 1.0

_DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
_BLOCKS = ("body", "handlers", "orelse", "finalbody", "cases")
# Where no call can be, which the walk over function bodies leaves out.
_LEAVES = {ast.Name, ast.Constant, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal, ast.alias,
           ast.Import, ast.ImportFrom, str, int, float, complex, bool, bytes, type(None), type(...)}
_PLAIN_FIELDS = {"ctx", "op", "ops", "id", "attr", "arg", "name", "names", "kind", "type_comment", "conversion",
                 "simple", "is_async", "rest", "kwd_attrs"}
_NEWLINE = re.compile(rb"\r\n|\r|\n")
_ONE_STRING = re.compile(
    r"""[a-z]{0,2}(?:\"{3}(?:\\.|(?!\"{3}).)*\"{3}|'{3}(?:\\.|(?!'{3}).)*'{3}"""
    r"""|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')""",
    re.IGNORECASE | re.DOTALL,
)


class _Text:
    """Source slices by the (line, UTF-8 column) positions that ``ast`` reports."""

    def __init__(self, source: str):
        self.raw = source.encode("utf-8", "replace")
        self.starts = [0] + [m.end() for m in _NEWLINE.finditer(self.raw)]

    def at(self, line, column):
        return self.starts[line - 1] + column

    def begin(self, node):
        return self.at(node.lineno, node.col_offset)

    def end(self, node):
        return self.at(node.end_lineno, node.end_col_offset)

    def cut(self, begin, end):
        return self.raw[begin:end].decode("utf-8", "replace")

    def of(self, node):
        return self.cut(self.begin(node), self.end(node))


def module_name(path: str) -> str:
    return (path[:-3] if path.endswith(".py") else path).replace("/", ".")


def _docstring(text, body, leading=None):
    """The literal, quotes included, when the body starts with one plain string."""
    if not body or not isinstance(body[0], ast.Expr):
        return None
    value = body[0].value
    if not isinstance(value, (ast.Constant, ast.JoinedStr)) or text.begin(body[0]) != text.begin(value):
        return None
    if leading is not None and text.cut(leading, text.begin(value)).strip():
        return None  # a comment comes first
    literal = text.of(value)
    return literal if _ONE_STRING.fullmatch(literal) else None


def _callee(text, call):
    """Name of the called thing; a parenthesised callee counts as any other text."""
    func = call.func
    opening = text.cut(text.begin(call), text.begin(func))
    if not opening:
        if isinstance(func, ast.Name):
            return text.of(func)
        if isinstance(func, ast.Attribute):
            owner = func.value
            plain = isinstance(owner, ast.Name) and text.begin(owner) == text.begin(func)
            return f"{text.of(owner)}.{func.attr}" if plain else func.attr
    end = text.end(func)
    for _ in range(opening.count("(")):
        end = text.raw.index(b")", end) + 1
    return text.cut(text.begin(call), end)


@cache
def _node_fields(kind):
    """Fields of a node class that can lead to a call."""
    return () if kind in _LEAVES else tuple(f for f in kind._fields if f not in _PLAIN_FIELDS)


def _calls(body):
    """Call nodes in source order, without those of nested definitions."""
    pending = body[::-1]
    while pending:
        node = pending.pop()
        kind = type(node)
        if kind in _DEFINITIONS:
            continue
        if kind is ast.Call:
            yield node
        for field in reversed(_node_fields(kind)):
            value = getattr(node, field, None)
            if type(value) is list:
                pending.extend(value[::-1])
            elif value is not None:
                pending.append(value)


def _nested_statements(node):
    """Statements, handlers and cases directly inside a statement."""
    return [child for field in _BLOCKS for child in getattr(node, field, ())]


def _imported_names(node):
    if isinstance(node, ast.Import):
        return [alias.name for alias in node.names]
    if node.module == "__future__" and not node.level:
        return []
    prefix = "." * node.level + (node.module or "")
    return [f"{prefix}.{alias.name}" for alias in node.names]


def _symbol(symbol_id, name, qualified_name, kind, first, last, decorators=(), docstring=None):
    return "symbol", {
        "id": symbol_id, "name": name, "qualified_name": qualified_name, "symbol_type": kind,
        "start_line": first, "end_line": last, "language": "python",
        "decorators": list(decorators), "docstring": docstring,
    }


def _relationship(source, target, name, kind, line, confidence):
    return "relationship", {
        "source_id": source, "target_id": target, "target_name": name,
        "relationship_type": kind, "source_line": line, "confidence": confidence,
    }


_PROBLEMS = (SyntaxError, ValueError, RecursionError, MemoryError)
_STRINGS = re.compile(
    r"""\"{3}(?:\\.|(?!\"{3}).)*(?:\"{3}|\Z)|'{3}(?:\\.|(?!'{3}).)*(?:'{3}|\Z)"""
    r"""|"(?:\\.|[^"\\\n])*["\n]|'(?:\\.|[^'\\\n])*['\n]|\#[^\n]*""",
    re.DOTALL,
)
_CONTINUES = re.compile(r"(?:else|elif|except|finally)\b|[)\]}]")
_HEADER = re.compile(r"(?:async\s+def|def|class)\b")
_CLAUSE = re.compile(r"(?:async\s+)?(if|elif|else|for|while|try|except|finally|with|match|case)\b")
# What a clause's word is read as, at the same columns, so that its expressions parse alone.
_READ_AS = {"elif": "if  ", "match": "while"}
_WITHOUT_EXPRESSION = {"else", "try", "except", "finally", "case"}


def _inside_strings(source):
    """Numbers (from 0) of the lines that begin inside a string."""
    inside = set()
    for found in _STRINGS.finditer(source):
        first = source.count("\n", 0, found.start())
        inside.update(range(first + 1, first + 1 + found.group().count("\n", 0, -1)))
    return inside


def _indent(line):
    return len(line) - len(line.lstrip(" \t"))


def _blocks(lines, first, last, indent, inside):
    """Ranges of lines that hold one statement each, with its decorators, at an indentation."""
    begins, decorated = [], False
    for i in range(first, last):
        line = lines[i].strip()
        if not line or i in inside or _indent(lines[i]) > indent or line.startswith("#") or _CONTINUES.match(line):
            continue
        if not decorated:
            begins.append(i)
        decorated = line.startswith("@")
    return zip(begins, [*begins[1:], last])


def _parsed(lines, first, last, indent, more=()):
    """Statements of the lines at their own places, or None."""
    opening = ["if 1:"] if indent else []
    try:
        tree = ast.parse("\n".join([""] * (first - len(opening)) + opening + lines[first:last] + list(more)))
    except _PROBLEMS:
        return None
    return tree.body[0].body if indent else tree.body


def _recovered(lines, first, last, indent, inside):
    """Statements of every block that parses; of a compound one that does not, what parses inside."""
    found = []
    for begin, end in _blocks(lines, first, last, indent, inside):
        body = _parsed(lines, begin, end, indent)
        found.extend(_salvaged(lines, begin, end, indent, inside) if body is None else body)
    return found


def _salvaged(lines, first, last, indent, inside):
    while last > first and not lines[last - 1].strip():
        last -= 1
    if first < last and _CLAUSE.match(lines[first].strip()):
        return _clauses(lines, first, last, indent, inside)
    header = next((i for i in range(first, last) if i not in inside and _HEADER.match(lines[i].strip())), None)
    if header is None or _indent(lines[header]) != indent:
        return []
    node, end = _header(lines, first, header, last, indent)
    if node is None:
        return []
    node[-1].body = _body(lines, end, last, indent, inside)
    node[-1].end_lineno = last
    return node


def _header(lines, first, header, last, indent):
    """The statement that the line ``header`` opens, with an empty body, and the line after; lines from ``first`` on decorate it."""
    for end in range(header + 1, last + 1):
        node = _parsed(lines, first, end, indent, [lines[header][:indent] + " pass"])
        if node is not None:
            return node, end
        if end < last and lines[end].strip() and _indent(lines[end]) <= indent and not _CONTINUES.match(lines[end].strip()):
            break
    return None, first


def _body(lines, first, last, indent, inside):
    inner = next((_indent(line) for i, line in enumerate(lines[first:last], first) if line.strip() and i not in inside), 0)
    return _recovered(lines, first, last, inner, inside) if inner > indent else []


def _clauses(lines, first, last, indent, inside):
    """What parses inside of every clause of an if, loop, try, with or match, and the clauses' own expressions."""
    starts = [first] + [i for i in range(first + 1, last)
                        if i not in inside and _indent(lines[i]) == indent and _CLAUSE.match(lines[i].strip())]
    found = []
    for begin, end in zip(starts, [*starts[1:], last]):
        word = _CLAUSE.match(lines[begin].strip()).group(1)
        node, after = None, begin
        if word not in _WITHOUT_EXPRESSION:
            plain = lines[begin]
            lines[begin] = lines[begin].replace(word, _READ_AS.get(word, word), 1)
            node, after = _header(lines, begin, begin, end, indent)
            lines[begin] = plain
        if node is None:  # the clause has no expression, or the fault is in it
            after = next((i + 1 for i in range(begin, end) if i not in inside and lines[i].split("#")[0].rstrip().endswith(":")), end)
        body = _body(lines, after, end, indent, inside)
        if node is None:
            found.extend(body)
        else:
            node[-1].body = body
            found.extend(node)
    return found


def _statements(source):
    """Top-level statements, and the problem if the whole does not parse."""
    try:
        return ast.parse(source).body, None
    except _PROBLEMS as problem:
        plain = source.replace("\r\n", "\n").replace("\r", "\n")
        lines = plain.split("\n")
        return _recovered(lines, 0, len(lines), 0, _inside_strings(plain)), f"{type(problem).__name__}: {problem}"


def extract_python(path: str, source: str):
    """Yield ('symbol' | 'relationship' | 'error', fields) in emission order.

    A file that does not parse as a whole gives one error and all that parses:
    statements are taken one by one, at any depth. A class or function with a
    fault inside keeps its own symbol, and an if, loop, try, with or match the
    statements of its clauses.
    """
    source = source.removeprefix("\ufeff")
    module = module_name(path)
    lines = source.count("\n") + 1
    text = _Text(source)
    body, problem = _statements(source)
    yield _symbol(module, path.rsplit("/", 1)[-1], module, "file", 1, lines, docstring=_docstring(text, body, leading=0))
    if problem is not None:
        yield "error", problem
    # Stack entries: node, id of the container, name prefix, directly in a class?
    pending = [(node, module, module, False) for node in reversed(body)]
    while pending:
        node, container, prefix, in_class = pending.pop()
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            for name in _imported_names(node):
                yield _symbol(f"{path}::import::{name}::{node.lineno - 1}", name, name, "import",
                              node.lineno, node.end_lineno)
                yield _relationship(container, None, name, "imports", node.lineno, CERTAIN)
        elif isinstance(node, _DEFINITIONS):
            is_class = isinstance(node, ast.ClassDef)
            qualified = f"{prefix}.{node.name}"
            kind = "class" if is_class else "method" if in_class else "function"
            yield _symbol(qualified, node.name, qualified, kind, node.lineno, node.end_lineno,
                          [_decorator(text, d) for d in node.decorator_list], _docstring(text, node.body))
            yield _relationship(container, qualified, node.name, "contains", node.lineno, CERTAIN)
            if is_class:
                for base in node.bases:
                    if isinstance(base, (ast.Name, ast.Attribute)):
                        yield _relationship(qualified, None, text.of(base), "inherits",
                                            base.lineno, BASE_CONFIDENCE)
            else:
                for call in _calls(node.body):
                    yield _relationship(qualified, None, _callee(text, call), "calls",
                                        call.lineno, CALL_CONFIDENCE)
            pending.extend((child, qualified, qualified, is_class) for child in reversed(node.body))
        else:
            pending.extend((child, container, prefix, in_class) for child in reversed(_nested_statements(node)))


def _decorator(text, expression):
    """Source of a decorator from its ``@`` on."""
    begin = text.raw.rindex(b"@", 0, text.begin(expression))
    end = text.end(expression)
    opening = text.raw[begin:text.begin(expression)].count(b"(")
    for _ in range(opening):
        end = text.raw.index(b")", end) + 1
    return text.cut(begin, end)
