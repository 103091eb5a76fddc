"""Source of a tracked script: statements by line, assignment targets, access chains in calls."""

from __future__ import annotations

import ast
import bisect


class SourceCode:
    """Statements of a script, or of one function of it, from the one that activates capture on.

    ``scope`` is the function's name and ``at`` the line of its definition; without a call of ``activate`` in the scope
    all its statements count.
    """

    def __init__(self, text: str, first_line: int = 1, scope: str = "<module>", at: int = 0):
        self.lines = text.splitlines()
        self.offset = first_line - 1
        self.tree = ast.parse(text)
        found = self._scope(scope, at - self.offset)
        inside = [s for top in found for s in ast.walk(top) if isinstance(s, ast.stmt)]
        self.activate_line = self._activated(found) + self.offset
        self.statements = sorted(inside, key=lambda s: (s.lineno, -(s.end_lineno or 0), s.col_offset))
        self.statements = [s for s in self.statements if (s.end_lineno or 0) >= self.activate_line - self.offset]
        self.starts = [s.lineno for s in self.statements]

    def _scope(self, scope: str, at: int) -> list[ast.stmt]:
        """The body of the function, the innermost that begins at or before the line; the whole script without one."""
        named = [n for n in ast.walk(self.tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name == scope]
        first = lambda n: min([n.lineno, *(d.lineno for d in n.decorator_list)])
        named = [n for n in named if at <= 0 or first(n) <= at <= (n.end_lineno or 0)]
        return max(named, key=first).body if named else self.tree.body

    @staticmethod
    def _activated(body: list[ast.stmt]) -> int:
        """The line of the first statement that calls ``activate``, by its name or as an attribute; 0 without one."""
        lines = [0]
        for top in body:
            for call in (n for n in ast.walk(top) if isinstance(n, ast.Call)):
                if "activate" in (getattr(call.func, "id", None), getattr(call.func, "attr", None)):
                    lines.append(call.lineno)
        return min(lines[1:], default=0)

    def line_map(self) -> list[tuple[int, int]]:
        """(first, last) line of each statement that holds no others, whatever block it stands in."""
        plain = [s for s in self.statements if not hasattr(s, "body")]
        return [(s.lineno + self.offset, (s.end_lineno or s.lineno) + self.offset) for s in plain]

    def node(self, line: int) -> ast.stmt | None:
        """The last statement that starts at or before the line and reaches it; of a compound one's head, itself."""
        line -= self.offset
        for i in range(bisect.bisect_right(self.starts, line) - 1, -1, -1):
            if (self.statements[i].end_lineno or 0) >= line:
                return self.statements[i]
        return None

    def statement(self, line: int) -> str | None:
        s = self.node(line)
        if s is None:
            return None
        end = s.end_lineno
        if body := getattr(s, "body", None):
            end = max(s.lineno, body[0].lineno - 1) if body[0].lineno > s.lineno else s.lineno
        return "\n".join(self.lines[s.lineno - 1 : end]).strip()

    def targets(self, line: int) -> list[str]:
        """Names on the left of an assignment; attributes and items by their text; none for other statements."""
        s = self.node(line)
        if isinstance(s, (ast.AnnAssign, ast.AugAssign)):
            return [ast.unparse(s.target)]
        if not isinstance(s, ast.Assign):
            return []
        first = s.targets[0]
        return [ast.unparse(e) for e in (first.elts if isinstance(first, (ast.Tuple, ast.List)) else [first])]

    def call_arguments(self, line: int, function: str) -> list[ast.expr]:
        """Positional and keyword argument expressions of calls of the function in the statement."""
        s = self.node(line)
        out = []
        for c in ast.walk(s) if s is not None else ():
            if isinstance(c, ast.Call) and (getattr(c.func, "id", None) or getattr(c.func, "attr", None)) == function.split(".")[-1]:
                out += [*c.args, *(k.value for k in c.keywords)]
        return out


def index_value(s: ast.expr, names: dict):
    """The value of an index or slice of constants, signed constants and names; LookupError for other expressions."""
    if isinstance(s, ast.Slice):
        return slice(*(None if p is None else index_value(p, names) for p in (s.lower, s.upper, s.step)))
    if isinstance(s, ast.Constant):
        return s.value
    if isinstance(s, ast.UnaryOp) and isinstance(s.op, (ast.USub, ast.UAdd)) and isinstance(s.operand, ast.Constant):
        return -s.operand.value if isinstance(s.op, ast.USub) else s.operand.value
    if isinstance(s, ast.Name) and s.id in names:
        return names[s.id]
    raise LookupError("an expression")


def slice_text(s: ast.expr, names: dict) -> str | None:
    """Index or slice as text, start:stop:step; None for expressions that aren't decoded."""
    try:
        found = index_value(s, names)
    except LookupError:
        return None
    if not isinstance(found, slice):
        return str(found)
    parts = [found.start, found.stop] + ([found.step] if found.step is not None else [])
    return ":".join("" if p is None else str(p) for p in parts)


def access_chain(e: ast.expr, names: dict) -> list[tuple[object, object, str, str]]:
    """Steps (parent, child, 'attribute' or 'subscript', text) of a.b[0].c, from the root name; none without one.

    Nothing is evaluated but the attributes and decoded indexes themselves; the chain ends at any other expression.
    """
    steps = []
    while isinstance(e, (ast.Attribute, ast.Subscript)):
        steps.append(e)
        e = e.value
    if not steps or not isinstance(e, ast.Name) or e.id not in names:
        return []
    at, out = names[e.id], []
    for s in reversed(steps):
        if isinstance(s, ast.Attribute):
            child, kind, text = getattr(at, s.attr), "attribute", s.attr
        else:
            text = slice_text(s.slice, names)
            if text is None:
                return out
            child, kind = at[index_value(s.slice, names)], "subscript"
        out.append((at, child, kind, text))
        at = child
    return out
