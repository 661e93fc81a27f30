"""Queries that are built from what is not literal and then executed, as data flow.

One walk over a file's tree notes every definition of a name (what it is given) and every use (a call that executes it), each with
its scope and place. Which definition reaches a use is then a question about sorted places: the last one before it, in its
scope; one that only renames asks the same of the other name, at its own place.
"""

from __future__ import annotations

import ast
from bisect import bisect_left
from collections import defaultdict, deque
from typing import NamedTuple

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
# What a query looks like, and what runs one.
SQL_WORDS = ("select ", "insert ", "update ", "delete ", "drop ", "alter ", "truncate ")
EXECUTORS = frozenset({"execute", "executemany", "executescript", "executescalar"})


class Built(NamedTuple):
    line: int
    how: str
    text: str


class Definition(NamedTuple):
    place: tuple[int, int]
    built: Built | None
    renames: str | None


class Taint(NamedTuple):
    line: int
    name: str
    how: str
    text: str
    executed_at: int


def _operands(node: ast.expr) -> list[ast.expr]:
    """The operands of a sum, from left to right, without recursion."""
    found, open_ = [], [node]
    while open_:
        top = open_.pop()
        match top:
            case ast.BinOp(left=left, op=ast.Add(), right=right):
                open_ += [right, left]
            case _:
                found.append(top)
    return found


def built_query(node: ast.expr, line: int) -> Built | None:
    """What an expression builds, if it is a query with a part that is no literal."""
    match node:
        case ast.BinOp(op=ast.Add()):
            parts = _operands(node)
            how, texts = "concatenation", [p.value for p in parts if isinstance(p, ast.Constant) and isinstance(p.value, str)]
            open_part = len(texts) < len(parts)
        case ast.BinOp(left=ast.Constant(value=str(text)), op=ast.Mod()):
            how, texts, open_part = "%-formatting", [text], True
        case ast.JoinedStr(values=parts):
            how, texts = "f-string", [p.value for p in parts if isinstance(p, ast.Constant)]
            open_part = len(texts) < len(parts)
        case ast.Call(func=ast.Attribute(value=ast.Constant(value=str(text)), attr="format")):
            how, texts, open_part = "str.format", [text], True
        case _:
            return None
    text = " ".join(t for t in texts if t)
    is_query = any(word in text.lower() + " " for word in SQL_WORDS)
    return Built(line, how, text) if is_query and open_part else None


def called(function: ast.AST) -> str:
    return function.attr if isinstance(function, ast.Attribute) else function.id if isinstance(function, ast.Name) else ""


def _events(tree: ast.AST) -> tuple[dict, dict]:
    """Definitions and uses (place of the statement, line of the call) by (scope, name).

    A call counts for each statement around it: the head of a block is read before what the block assigns. Statements right in
    a class, or under a case, are in no scope.
    """
    definitions, uses = defaultdict(list), defaultdict(list)
    open_ = deque([(tree, None, None)])  # node, scope of the statements below it, (scope, place, further out) of the statements around it
    while open_:
        node, scope, around = open_.popleft()
        if isinstance(node, (ast.Module, *FUNCTIONS)):
            scope = node
        elif isinstance(node, (ast.ClassDef, ast.match_case)):
            scope = None
        elif isinstance(node, ast.stmt) and scope is not None:
            around = (scope, (node.lineno, node.col_offset), around)
            if isinstance(node, (ast.Assign, ast.AnnAssign)) and node.value is not None:
                renames = node.value.id if isinstance(node.value, ast.Name) else None
                given = Definition(around[1], built_query(node.value, node.lineno), renames)
                for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    if isinstance(target, ast.Name):
                        definitions[scope, target.id].append(given)
        elif isinstance(node, ast.Call) and node.args and isinstance(node.args[0], ast.Name) and called(node.func) in EXECUTORS:
            link = around
            while link:
                uses[link[0], node.args[0].id].append((link[1], node.lineno))
                link = link[2]
        open_ += [(child, scope, around) for child in ast.iter_child_nodes(node)]
    return definitions, uses


def sql_taint(tree: ast.AST) -> list[Taint]:
    """Built queries that reach an executor, by the line that builds them.

    A name is told once, until it is given something that is no such query; the next build is told again.
    """
    definitions, uses = _events(tree)
    for given in definitions.values():
        given.sort(key=lambda d: d.place)
    places = {key: [d.place for d in given] for key, given in definitions.items()}

    def origin(scope: ast.AST, name: str, before: tuple[int, int]) -> Built | None:
        while True:
            last = bisect_left(places.get((scope, name), ()), before) - 1
            if last < 0:
                return None
            given = definitions[scope, name][last]
            if given.built or given.renames is None:
                return given.built
            name, before = given.renames, given.place

    found = []
    for (scope, name), asked in uses.items():
        given = definitions.get((scope, name), ())
        cleared = [d.place for d in given if not (d.built or (d.renames and origin(scope, d.renames, d.place)))]
        told = set()
        for place, line in sorted(asked, key=lambda use: use[0]):
            period, reached = bisect_left(cleared, place), origin(scope, name, place)
            if reached and period not in told:
                told.add(period)
                found.append(Taint(reached.line, name, reached.how, reached.text, line))
    return sorted(found, key=lambda t: (t.line, t.executed_at))
