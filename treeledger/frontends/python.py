"""Python source to rows of syntax facts.

The standard library's parser gives the structure and its tokenizer the leaves. A fact row stands for
one node that matters to a measure; nodes are numbered in pre-order, and ``last`` is the last number
in a node's subtree. Nesting is filled in on the way down; all sums are left to Spark.
"""

from __future__ import annotations

import ast
import io
import keyword
import re
import token as tk
import tokenize
import zlib
from bisect import bisect_left
from dataclasses import dataclass, field

# Texts that count as operators.
OPERATORS = frozenset(
    "+ - * / % ** = += -= *= /= %= == != < <= > >= ~ & | ^ << >> **= <<= >>= &= |= ^= // //= @= := ... . -> as and or not in is return raise yield await break continue".split()
)
LOOPS = (ast.For, ast.AsyncFor, ast.While)
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


@dataclass
class Fact:
    node: int
    last: int
    kind: str
    nest: int  # structural nesting at the node
    inner: int  # and what its children get
    bonus: int  # of functions in functions
    sens: int = 0  # increments that weigh by nesting
    flat: int = 0
    ncss: int = 0
    is_fn: bool = False
    frame: int = -1  # the innermost function around it
    name: str | None = None
    start_line: int = 0
    start_col: int = 0
    end_line: int = 0
    end_col: int = 0
    parameters: int = 0
    dep_degree: int = 0
    sequence: list[int] = field(default_factory=list)


@dataclass
class Walk:
    facts: list[Fact] = field(default_factory=list)
    lines: list[str] = field(default_factory=list)

    def column(self, line: int, offset: int) -> int:
        """A column in characters, from one in bytes."""
        return len(self.lines[line - 1].encode()[:offset].decode(errors="replace"))

    def add(self, kind: str, nest: int, bonus: int, frame: int, **more) -> Fact:
        fact = Fact(len(self.facts), 0, kind, nest, more.pop("inner", nest), bonus, frame=frame, **more)
        self.facts.append(fact)
        return fact

    def done(self, fact: Fact) -> None:
        fact.last = len(self.facts) - 1

    def body(self, nodes, nest: int, bonus: int, frame: int, inside: bool) -> None:
        for node in nodes:
            self.visit(node, nest, bonus, frame, inside, None)

    def clause(self, kind: str, nodes, nest: int, bonus: int, frame: int, inside: bool, **more) -> None:
        fact = self.add(kind, nest, bonus, frame, **more)
        self.body(nodes, fact.inner, bonus, frame, inside)
        self.done(fact)

    def visit(self, node: ast.AST, nest: int, bonus: int, frame: int, inside: bool, parent: ast.AST | None) -> None:
        go = lambda children, n=nest: [self.visit(c, n, bonus, frame, inside, node) for c in children if c is not None]
        if isinstance(node, (*FUNCTIONS, ast.Lambda)):
            self.function(node, nest, bonus + inside, frame)
        elif isinstance(node, ast.ClassDef):
            go(node.decorator_list)
            fact = self.add("class_definition", nest, bonus, frame, ncss=1)
            go([*node.bases, *node.keywords, *node.body])
            self.done(fact)
        elif isinstance(node, ast.If):
            fact = self.add("if_statement", nest, bonus, frame, sens=1, ncss=1, inner=nest + 1)
            go([node.test, *node.body], nest + 1)
            self.chain(node, nest + 1, bonus, frame, inside)
            self.done(fact)
        elif isinstance(node, LOOPS):
            kind = "while_statement" if isinstance(node, ast.While) else "for_statement"
            fact = self.add(kind, nest, bonus, frame, sens=1, ncss=1, inner=nest + 1)
            heads = [node.test] if isinstance(node, ast.While) else [node.target, node.iter]
            go([*heads, *node.body], nest + 1)
            if node.orelse:
                self.clause("else_clause", node.orelse, nest + 1, bonus, frame, inside, flat=1, ncss=1)
            self.done(fact)
        elif isinstance(node, (ast.Try, ast.TryStar)):
            self.body(node.body, nest, bonus, frame, inside)
            for handler in node.handlers:
                starred = isinstance(node, ast.TryStar)
                fact = self.add("except_group_clause" if starred else "except_clause", nest, bonus, frame, sens=int(not starred), ncss=1, inner=nest + (not starred))
                if handler.type is not None:
                    self.visit(handler.type, fact.inner, bonus, frame, inside, node)
                self.body(handler.body, fact.inner, bonus, frame, inside)
                self.done(fact)
            if node.orelse:
                self.clause("else_clause", node.orelse, nest, bonus, frame, inside, flat=1, ncss=1)
            if node.finalbody:
                self.clause("finally_clause", node.finalbody, nest, bonus, frame, inside, ncss=1)
        elif isinstance(node, ast.Match):
            fact = self.add("match_statement", nest, bonus, frame, sens=1, ncss=1)
            go([node.subject])
            for case in node.cases:
                inner = self.add("case_clause", nest, bonus, frame, ncss=1, inner=nest + 1, flat=int(case.guard is not None))
                if case.guard is not None:
                    self.visit(case.guard, nest + 1, bonus, frame, inside, node)
                self.body(case.body, nest + 1, bonus, frame, inside)
                self.done(inner)
            self.done(fact)
        elif isinstance(node, ast.IfExp):
            fact = self.add("conditional_expression", nest, bonus, frame, sens=1, inner=nest + 1)
            go([node.body, node.test, node.orelse], nest + 1)
            self.done(fact)
        elif isinstance(node, ast.BoolOp):
            goes_on = isinstance(parent, ast.BoolOp) and type(parent.op) is type(node.op)
            if not goes_on:
                self.done(self.add("boolean_operator", nest, bonus, frame, flat=1))
            go(node.values)
        elif isinstance(node, ast.comprehension):
            for _ in node.ifs:
                self.done(self.add("if_clause", nest, bonus, frame, flat=1))
            go(ast.iter_child_nodes(node))
        else:
            simple = isinstance(node, ast.stmt)
            fact = self.add("statement", nest, bonus, frame, ncss=1) if simple else None
            go(ast.iter_child_nodes(node))
            if fact:
                self.done(fact)

    def chain(self, node: ast.If, nest: int, bonus: int, frame: int, inside: bool) -> None:
        """The elif and else parts of an if, which hang below it without further nesting."""
        rest = node.orelse
        while len(rest) == 1 and isinstance(rest[0], ast.If) and getattr(rest[0], "is_elif", False):
            part = rest[0]
            fact = self.add("elif_clause", nest, bonus, frame, flat=1, ncss=1)
            self.visit(part.test, nest, bonus, frame, inside, part)
            self.body(part.body, nest, bonus, frame, inside)
            self.done(fact)
            rest = part.orelse
        if rest:
            self.clause("else_clause", rest, nest, bonus, frame, inside, flat=1, ncss=1)

    def function(self, node, nest: int, bonus: int, frame: int) -> None:
        named = isinstance(node, FUNCTIONS)
        if named:
            for d in node.decorator_list:
                self.visit(d, nest, bonus, frame, frame >= 0, None)
        a = node.args
        count = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + (a.vararg is not None) + (a.kwarg is not None)
        first = (a.posonlyargs + a.args)[:1]
        if named and getattr(node, "in_class", False) and first and first[0].arg in ("self", "cls"):
            count -= 1
        fact = self.add("function_definition" if named else "lambda", nest, bonus, frame, ncss=int(named), is_fn=True, name=node.name if named else getattr(node, "bound", None), parameters=count)
        fact.start_line, fact.start_col, fact.end_line, fact.end_col = node.lineno, self.column(node.lineno, node.col_offset), node.end_lineno, self.column(node.end_lineno, node.end_col_offset)
        for x in (*a.defaults, *[d for d in a.kw_defaults if d is not None]):
            self.visit(x, nest, bonus, fact.node, True, node)
        self.body(node.body if named else [node.body], nest, bonus, fact.node, True)
        self.done(fact)


def facts(code: str) -> list[Fact]:
    tree = ast.parse(code)
    lines = code.split("\n")
    for node in ast.walk(tree):
        if isinstance(node, ast.If):
            # An elif begins where its keyword stands; a nested if begins with "if".
            for inner in node.orelse[:1]:
                inner.is_elif = isinstance(inner, ast.If) and lines[inner.lineno - 1].encode()[inner.col_offset :].startswith(b"elif")
        elif isinstance(node, ast.ClassDef):
            for inner in node.body:
                inner.in_class = True
        elif isinstance(node, ast.Assign) and isinstance(node.value, ast.Lambda) and isinstance(node.targets[0], ast.Name):
            node.value.bound = node.targets[0].id
    walk = Walk(lines=lines)
    root = walk.add("module", 0, 0, -1)
    walk.body(tree.body, 0, 0, -1, False)
    walk.done(root)
    with_data_flow(code, tree, [f for f in walk.facts if f.is_fn], walk)
    return walk.facts


# What after a name writes it, and what reads and writes it.
ASSIGNS = ("=", ":=")
UPDATES = frozenset("+= -= *= /= %= **= //= <<= >>= &= |= ^= @=".split())


def bound_places(tree: ast.AST, walk: Walk) -> set[tuple[int, int]]:
    """Where names are bound by their place in the syntax: loop and list targets, annotated targets, parameters."""
    out = set()
    for node in ast.walk(tree):
        targets: list[ast.AST] = []
        if isinstance(node, (ast.For, ast.AsyncFor, ast.comprehension, ast.AnnAssign)):
            targets = [node.target]
        elif isinstance(node, ast.Assign):
            targets = node.targets
        elif isinstance(node, ast.arg):
            out.add((node.lineno, walk.column(node.lineno, node.col_offset)))
        for target in targets:
            for name in target.elts if isinstance(target, ast.Tuple) else [target]:
                if isinstance(name, ast.Name):
                    out.add((name.lineno, walk.column(name.lineno, name.col_offset)))
    return out


def with_data_flow(code: str, tree: ast.AST, functions: list[Fact], walk: Walk) -> None:
    """Fills in each function's def-use pairs and its token sequence, in which names are numbered by first use."""
    if not functions:
        return
    bound = bound_places(tree, walk)
    skip = (tk.COMMENT, tk.NL, tk.NEWLINE, tk.INDENT, tk.DEDENT, tk.ENDMARKER)
    tokens = [t for t in tokenize.generate_tokens(io.StringIO(code).readline) if t.type not in skip]
    starts = [t.start for t in tokens]
    for f in functions:
        first, end = bisect_left(starts, (f.start_line, f.start_col)), bisect_left(starts, (f.end_line, f.end_col))
        inner = [g for g in functions if f.node < g.node <= f.last]
        edges = sorted([((g.start_line, g.start_col), 1, g.node) for g in inner] + [((g.end_line, g.end_col), 0, g.node) for g in inner])
        scope: tuple[int, ...] = ()
        defined: dict[str, set[tuple[int, ...]]] = {}
        numbers: dict[str, int] = {}
        e = 0
        for i in range(first, end):
            t = tokens[i]
            while e < len(edges) and edges[e][0] <= t.start:
                scope = (*scope, edges[e][2]) if edges[e][1] else tuple(x for x in scope if x != edges[e][2])
                e += 1
            is_name = t.type == tk.NAME and not keyword.iskeyword(t.string)
            symbol = f"id{numbers.setdefault(t.string, len(numbers))}" if is_name else "number" if t.type == tk.NUMBER else "string" if t.type == tk.STRING else t.string
            f.sequence.append(zlib.crc32(symbol.encode()) & 0x7FFFFFFF)
            if not is_name:
                continue
            after = tokens[i + 1].string if i + 1 < end else ""
            seen = any(scope[: len(d)] == d for d in defined.get(t.string, ()))
            if after in UPDATES:
                f.dep_degree += seen
                defined.setdefault(t.string, set()).add(scope)
            elif after in ASSIGNS or t.start in bound:
                defined.setdefault(t.string, set()).add(scope)
            else:
                f.dep_degree += seen


STRING = re.compile(r"""(?s)^([A-Za-z]*)(\"\"\"|'''|"|')(.*)\2$""")
ESCAPE = re.compile(r"""\\(?:\r\n|[\n\r\\'"abfnrtv0-7]|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|N\{)""")


def leaves(code: str) -> list[tuple[bool, str, int, int]]:
    """(is operand, text, line, column) of all leaves that count."""
    out = []
    previous = None
    for t in tokenize.generate_tokens(io.StringIO(code).readline):
        said, (line, column) = t.string, t.start
        if t.type == tk.NAME:
            if said == "_" and previous is not None and previous.string == "case":
                pass  # the pattern that takes all is no name
            elif said in ("True", "False", "None") or not keyword.iskeyword(said) and said != "__future__" and not soft(said, t, previous):
                out.append((True, said, line, column))
            elif said in OPERATORS:
                out.append((False, said, line, column))
        elif t.type == tk.NUMBER:
            out.append((True, said, line, column))
        elif t.type == tk.STRING and (m := STRING.match(said)):
            raw = "r" in m[1].lower()
            if m[3] and (raw or not ESCAPE.search(m[3])):
                out.append((True, m[3], line, column))
        elif t.type == getattr(tk, "FSTRING_MIDDLE", -1):
            if said and not ESCAPE.search(said) and "{" not in said:
                out.append((True, said, line, column))
        elif t.type == tk.OP and said in OPERATORS:
            out.append((False, said, line, column))
        elif t.type == tk.OP and said == "@" and previous is not None and previous.type not in (tk.NEWLINE, tk.NL, tk.INDENT, tk.DEDENT, tk.COMMENT):
            out.append((False, said, line, column))
        if t.type not in (tk.COMMENT, tk.NL):
            previous = t
    return out


def soft(said: str, t, previous) -> bool:
    """Whether match, case or type is a keyword here: it begins a line that ends with a colon, or names a type."""
    starts = previous is None or previous.type in (tk.NEWLINE, tk.INDENT, tk.DEDENT)
    return starts and (said in ("match", "case") and re.match(r"\s*(match|case)\b\s*[^=.(\s].*:\s*(#.*)?$|\s*(match|case)\s*\(.*\)\s*:\s*(#.*)?$|\s*(match|case)\s+.*:", t.line) is not None or said == "type" and re.match(r"\s*type\s+\w+.*=", t.line) is not None)
