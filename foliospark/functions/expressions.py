"""The form expression language.

A script is parsed once on the driver.  Scripts of plain expressions and conditions
become one Spark column, which Catalyst folds and compiles; scripts with variables,
loops or functions run in a small interpreter inside an Arrow function.

Values are numbers, strings and null.  Arithmetic reads blank, null and other text as 0;
concatenation writes whole numbers without fraction and null as ''.  Comparisons and
logic give 1 or 0; null equals null only.
"""

from __future__ import annotations

import datetime as dt
import math
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from . import text as T

_TOKEN = re.compile(
    r"""(?P<blank>[ \t\r\n]+|;[^\n]*|//[^\n]*)|(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)|"(?P<string>(?:[^"]|"")*)"|(?P<name>[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)|(?P<op><=|>=|==|<>|[-+*/=<>(),&|\[\]])""",
    re.X,
)
_KEYWORDS = frozenset("if then elseif else endif while do endwhile for upto downto step endfor foreach in func endfunc var return break continue and or not eq ne lt le gt ge null".split())
_WORD_OPS = {"eq": "==", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">=", "and": "and", "or": "or", "&": "and", "|": "or"}
_LEVELS = (("or",), ("and",), ("==", "<>"), ("<", "<=", ">", ">="), ("+", "-"), ("*", "/"))

#: Steps after which a script is stopped.
STEPS = 200_000
#: Depth of calls after which a script is stopped.
DEPTH = 200


class ScriptError(ValueError):
    """A script that cannot be parsed or run."""


@dataclass
class Node:
    kind: str
    value: Any = None
    parts: list = field(default_factory=list)


def tokens(script: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    while at < len(script):
        m = _TOKEN.match(script, at)
        if not m:
            raise ScriptError(f"unexpected sign {script[at]!r} at {at}")
        at = m.end()
        if m.group("number") is not None:
            out.append(("number", float(m.group("number"))))
        elif m.group("string") is not None:
            out.append(("string", m.group("string").replace('""', '"')))
        elif m.group("name") is not None:
            word = m.group("name")
            out.append(("key", word.lower()) if word.lower() in _KEYWORDS else ("name", word))
        elif m.group("op") is not None:
            out.append(("op", m.group("op")))
    return [*out, ("end", None)]


class Parser:
    def __init__(self, script: str):
        self.tokens, self.at = tokens(script), 0

    def peek(self, *values: str) -> bool:
        kind, value = self.tokens[self.at]
        return kind in ("key", "op") and value in values

    def take(self, *values: str) -> Any:
        if values and not self.peek(*values):
            raise ScriptError(f"expected {' or '.join(values)}, found {self.tokens[self.at][1]!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def name(self) -> str:
        kind, value = self.tokens[self.at]
        if kind != "name":
            raise ScriptError(f"expected a name, found {value!r}")
        self.at += 1
        return value

    def block(self, *ends: str) -> Node:
        out = Node("block")
        while not self.peek(*ends) and self.tokens[self.at][0] != "end":
            out.parts.append(self.statement())
        return out

    def script(self) -> Node:
        out = self.block()
        if self.tokens[self.at][0] != "end":
            raise ScriptError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def statement(self) -> Node:
        if self.peek("var"):
            self.take()
            name = self.name()
            return Node("assign", name, [self._after("=") or Node("literal")])
        if self.peek("while"):
            self.take()
            test = self.expression()
            self.take("do")
            body = self.block("endwhile")
            self.take("endwhile")
            return Node("while", None, [test, body])
        if self.peek("for"):
            self.take()
            name = self.name()
            self.take("=")
            start = self.expression()
            way = self.take("upto", "downto")
            stop = self.expression()
            step = self._after("step") or Node("literal", 1.0)
            self.take("do")
            body = self.block("endfor")
            self.take("endfor")
            return Node("for", (name, way), [start, stop, step, body])
        if self.peek("foreach"):
            self.take()
            name = self.name()
            self.take("in")
            values = self.arguments()
            self.take("do")
            body = self.block("endfor")
            self.take("endfor")
            return Node("foreach", name, [Node("list", None, values), body])
        if self.peek("func"):
            self.take()
            name, names = self.name(), []
            self.take("(")
            while not self.peek(")"):
                if self.peek("var", ","):
                    self.take()
                    continue
                names.append(self.name())
            self.take(")")
            if self.peek("do"):
                self.take()
            body = self.block("endfunc")
            self.take("endfunc")
            return Node("func", (name.lower(), names), [body])
        if self.peek("break", "continue"):
            return Node(self.take())
        if self.peek("return"):
            self.take()
            return Node("return", None, [self.expression()])
        if self.tokens[self.at][0] == "name" and self.tokens[self.at + 1] == ("op", "="):
            name = self.name()
            self.take("=")
            return Node("assign", name, [self.expression()])
        return self.expression()

    def _after(self, word: str) -> Node | None:
        if not self.peek(word):
            return None
        self.take()
        return self.expression()

    def condition(self) -> Node:
        self.take("if", "elseif")
        test = self.expression()
        self.take("then")
        parts = [test, self.block("elseif", "else", "endif")]
        if self.peek("elseif"):
            return Node("if", None, [*parts, self.condition()])
        if self.peek("else"):
            self.take()
            parts.append(self.block("endif"))
        self.take("endif")
        return Node("if", None, parts)

    def arguments(self) -> list[Node]:
        self.take("(")
        out = []
        while not self.peek(")"):
            out.append(self.expression())
            if not self.peek(")"):
                self.take(",")
        self.take(")")
        return out

    def expression(self, level: int = 0) -> Node:
        if level == len(_LEVELS):
            return self.unary()
        left = self.expression(level + 1)
        while True:
            kind, value = self.tokens[self.at]
            op = _WORD_OPS.get(value, value) if kind in ("op", "key") else None
            if op not in _LEVELS[level]:
                return left
            self.at += 1
            left = Node("binary", op, [left, self.expression(level + 1)])

    def unary(self) -> Node:
        if self.peek("-", "+", "not"):
            op = self.take()
            return Node("unary", op, [self.unary()])
        kind, value = self.tokens[self.at]
        if self.peek("if"):
            if self.tokens[self.at + 1] == ("op", "("):  # If(...) is a function too
                mark = self.at
                self.take()
                args = self.arguments()
                if not self.peek("then"):
                    return Node("call", "if", args)
                self.at = mark
            return self.condition()
        if self.peek("null"):
            self.take()
            if self.peek("("):
                self.arguments()
            return Node("literal")
        if self.peek("("):
            self.take()
            inner = self.expression()
            self.take(")")
            return inner
        if kind in ("number", "string"):
            self.at += 1
            return Node("literal", value)
        name = self.name()
        return Node("call", name.lower(), self.arguments()) if self.peek("(") else Node("path", name)


def parse(script: str) -> Node:
    return Parser(script).script()


# Values at run time: float, str or None.


def number(v: Any) -> float:
    if isinstance(v, float):
        return v
    try:
        return float(v) if isinstance(v, str) and re.fullmatch(r"\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*", v) else 0.0
    except ValueError:
        return 0.0


def string(v: Any) -> str:
    if v is None:
        return ""
    return str(int(v)) if isinstance(v, float) and v.is_integer() and abs(v) < 1e15 else str(v)


def truth(v: Any) -> bool:
    return number(v) != 0


def compare(op: str, a: Any, b: Any) -> float:
    if a is None or b is None:
        equal = a is None and b is None
        return float(equal if op in ("==", "<=", ">=") else op == "<>" and not equal)
    if not (isinstance(a, str) and isinstance(b, str)):
        a, b = number(a), number(b)
    return float({"==": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op])


def _half_up(x: float, digits: float = 0) -> float:
    scale = 10.0 ** int(digits)
    return math.copysign(math.floor(abs(x) * scale + 0.5 + 1e-9) / scale, x)


def _payment(principal: float, rate: float, periods: float) -> float:
    return principal / periods if rate == 0 else principal * rate / (1 - (1 + rate) ** -periods)


def _rate(future: float, present: float, periods: float) -> float:
    return (future / present) ** (1 / periods) - 1


_EPOCH = dt.date(1899, 12, 31)
_MASK = (("YYYY", "%Y"), ("MM", "%m"), ("DD", "%d"), ("HH", "%H"), ("SS", "%S"))


def _mask(mask: str, clock: bool) -> str:
    for sign, code in _MASK:
        mask = mask.replace(sign, "%M" if clock and sign == "MM" else code)
    return mask


def _date_number(text: str, mask: str = "YYYY-MM-DD") -> float:
    try:
        return float((dt.datetime.strptime(text, _mask(mask, False)).date() - _EPOCH).days)
    except ValueError:
        return 0.0


def _time_number(text: str, mask: str = "HH:MM:SS") -> float:
    try:
        t = dt.datetime.strptime(text, _mask(mask, True))
    except ValueError:
        return 0.0
    return (t.hour * 3600 + t.minute * 60 + t.second) * 1000.0 + 1


def _clock(n: float, mask: str) -> str:
    return (dt.datetime(2000, 1, 1) + dt.timedelta(milliseconds=n - 1)).strftime(_mask(mask, True))


# Number words.
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".title().split()
_TENS = "- - twenty thirty forty fifty sixty seventy eighty ninety".title().split()


def number_words(n: int) -> str:
    if n < 20:
        return _ONES[n]
    if n < 100:
        return _TENS[n // 10] + (f" {_ONES[n % 10]}" if n % 10 else "")
    for size, name in ((10**9, "Billion"), (10**6, "Million"), (1000, "Thousand"), (100, "Hundred")):
        if n >= size:
            return f"{number_words(n // size)} {name}" + (f" {number_words(n % size)}" if n % size else "")
    return ""


def _stuff(s: str, start: float, delete: float, insert: str = "") -> str:
    i = max(int(start) - 1, 0)
    return s[:i] + insert + s[i + int(delete) :]


_N, _S = number, string
BUILTINS: dict[str, Callable] = {
    "abs": lambda x: abs(_N(x)), "avg": lambda *a: sum(map(_N, a)) / len(a) if a else 0.0, "ceil": lambda x: float(math.ceil(_N(x))),
    "floor": lambda x: float(math.floor(_N(x))), "count": lambda *a: float(sum(x is not None for x in a)), "max": lambda *a: max(map(_N, a)),
    "min": lambda *a: min(map(_N, a)), "mod": lambda a, b: math.fmod(_N(a), _N(b)), "round": lambda x, n=0.0: _half_up(_N(x), _N(n)),
    "sum": lambda *a: float(sum(map(_N, a))), "at": lambda s, t: float(_S(s).find(_S(t)) + 1), "concat": lambda *a: "".join(map(_S, a)),
    "left": lambda s, n: _S(s)[: int(_N(n))], "right": lambda s, n: _S(s)[-int(_N(n)) :] if _N(n) >= 1 else "", "len": lambda s: float(len(_S(s))),
    "lower": lambda s: _S(s).lower(), "upper": lambda s: _S(s).upper(), "ltrim": lambda s: _S(s).lstrip(), "rtrim": lambda s: _S(s).rstrip(),
    "replace": lambda s, a, b="": _S(s).replace(_S(a), _S(b)), "space": lambda n: " " * int(_N(n)),
    "stuff": lambda s, i, n, t="": _stuff(_S(s), _N(i), _N(n), _S(t)), "substr": lambda s, i, n: _S(s)[max(int(_N(i)) - 1, 0) :][: int(_N(n))],
    "uuid": lambda dashed=0.0: str(uuid.uuid4()) if truth(dashed) else uuid.uuid4().hex, "choose": lambda n, *a: a[int(_N(n)) - 1] if 1 <= _N(n) <= len(a) else "",
    "if": lambda c, a, b=0.0: a if truth(c) else b, "oneof": lambda x, *a: float(any(compare("==", x, y) for y in a)),
    "within": lambda x, a, b: compare(">=", x, a) * compare("<=", x, b), "hasvalue": lambda x: float(x is not None and _S(x).strip() != ""),
    "exists": lambda x: float(x is not None), "date": lambda: float((dt.date.today() - _EPOCH).days),
    "time": lambda: (dt.datetime.now() - dt.datetime.combine(dt.date.today(), dt.time())).total_seconds() // 0.001 + 1,
    "date2num": lambda s, m="YYYY-MM-DD": _date_number(_S(s), _S(m)), "num2date": lambda n, m="YYYY-MM-DD": (_EPOCH + dt.timedelta(days=int(_N(n)))).strftime(_mask(_S(m), False)),
    "time2num": lambda s, m="HH:MM:SS": _time_number(_S(s), _S(m)), "num2time": lambda n, m="HH:MM:SS": _clock(_N(n), _S(m)),
    "pmt": lambda p, r, n: _payment(_N(p), _N(r), _N(n)), "fv": lambda a, r, n: _N(a) * (((1 + _N(r)) ** _N(n) - 1) / _N(r) if _N(r) else _N(n)),
    "pv": lambda a, r, n: _N(a) * ((1 - (1 + _N(r)) ** -_N(n)) / _N(r) if _N(r) else _N(n)), "rate": lambda f, p, n: _rate(_N(f), _N(p), _N(n)),
    "term": lambda a, r, f: math.log(1 + _N(f) * _N(r) / _N(a)) / math.log(1 + _N(r)), "cterm": lambda r, f, p: math.log(_N(f) / _N(p)) / math.log(1 + _N(r)),
    "npv": lambda r, *a: sum(_N(x) / (1 + _N(r)) ** (i + 1) for i, x in enumerate(a)), "wordnum": lambda n, *_: number_words(int(abs(_N(n)))),
}


class _Break(Exception):
    pass


class _Continue(Exception):
    pass


class _Return(Exception):
    def __init__(self, value: Any):
        self.value = value


#: Calls that reach into a tree where their first argument is a path.
PATH_CALLS = frozenset(["get", "put", "set", "exists"])


def is_tree_path(value: Any) -> bool:
    """Whether an argument is a path into a tree: no address, and with a dot, a bracket, a root or 'this'."""
    return isinstance(value, str) and "://" not in value and (value == "this" or value[:1] in ("$", "!") or "." in value or "[" in value)


def tree_path(path: str) -> str:
    """A path with the number of each step, as the values of a tree are kept: the first one unless it is given."""
    steps = [s for s in path.lstrip("!").split(".") if s and not s.startswith("$") and s != "this"]
    return ".".join(s if s.endswith("]") else f"{s}[0]" for s in steps)


class Interpreter:
    """Runs a script over the fields of one row, and over the values of a tree by their paths if there is one."""

    def __init__(self, fields: dict[str, Any] | None = None, tree: dict[str, Any] | None = None):
        self.tree = tree
        self.scopes: list[dict[str, Any]] = [dict(fields or {})]
        self.functions: dict[str, tuple[list[str], Node]] = {}
        self.steps = 0

    def run(self, node: Node) -> Any:
        self.steps += 1
        if self.steps > STEPS:
            raise ScriptError("the script takes too many steps")
        return getattr(self, "_" + node.kind)(node)

    def _block(self, node: Node) -> Any:
        value = None
        for part in node.parts:
            value = self.run(part)
        return value

    def _literal(self, node: Node) -> Any:
        return node.value

    def _path(self, node: Node) -> Any:
        for scope in (self.scopes[-1], self.scopes[0]):
            if node.value in scope:
                return scope[node.value]
        return None

    def _assign(self, node: Node) -> Any:
        value = self.run(node.parts[0])
        self.scopes[-1][node.value] = value
        return value

    def _if(self, node: Node) -> Any:
        if truth(self.run(node.parts[0])):
            return self.run(node.parts[1])
        return self.run(node.parts[2]) if len(node.parts) > 2 else None

    def _loop(self, body: Node) -> bool:
        try:
            self.run(body)
        except _Continue:
            pass
        except _Break:
            return False
        return True

    def _while(self, node: Node) -> Any:
        while truth(self.run(node.parts[0])) and self._loop(node.parts[1]):
            pass
        return None

    def _for(self, node: Node) -> Any:
        name, way = node.value
        at, stop, step = (number(self.run(p)) for p in node.parts[:3])
        if step <= 0:
            raise ScriptError("a step must be positive")
        while at <= stop if way == "upto" else at >= stop:
            self.scopes[-1][name] = at
            if not self._loop(node.parts[3]):
                break
            at += step if way == "upto" else -step
        return None

    def _foreach(self, node: Node) -> Any:
        for value in [self.run(p) for p in node.parts[0].parts]:
            self.scopes[-1][node.value] = value
            if not self._loop(node.parts[1]):
                break
        return None

    def _func(self, node: Node) -> Any:
        self.functions[node.value[0]] = (node.value[1], node.parts[0])

    def _break(self, node: Node) -> Any:
        raise _Break

    def _continue(self, node: Node) -> Any:
        raise _Continue

    def _return(self, node: Node) -> Any:
        raise _Return(self.run(node.parts[0]))

    def _unary(self, node: Node) -> Any:
        value = number(self.run(node.parts[0]))
        return {"-": -value, "+": value, "not": float(value == 0)}[node.value]

    def _binary(self, node: Node) -> Any:
        op, a, b = node.value, self.run(node.parts[0]), self.run(node.parts[1])
        if op in ("and", "or"):
            return float(truth(a) and truth(b) if op == "and" else truth(a) or truth(b))
        if op not in "+-*/":
            return compare(op, a, b)
        x, y = number(a), number(b)
        if op == "/" and y == 0:
            raise ScriptError("division by zero")
        return {"+": x + y, "-": x - y, "*": x * y, "/": x / y if y else 0.0}[op]

    def _call(self, node: Node) -> Any:
        values = [self.run(p) for p in node.parts]
        if node.value in self.functions:
            names, body = self.functions[node.value]
            if len(self.scopes) > DEPTH:
                raise ScriptError("calls are nested too deeply")
            self.scopes.append(dict(zip(names, [*values, *[None] * len(names)])))
            try:
                return self.run(body)
            except _Return as r:
                return r.value
            finally:
                self.scopes.pop()
        if self.tree is not None and node.value in PATH_CALLS and values and is_tree_path(values[0]):
            return self._reach(node.value, tree_path(values[0]), *values[1:])
        if node.value not in BUILTINS:
            raise ScriptError(f"unknown function {node.value!r}")
        try:
            return BUILTINS[node.value](*values)
        except (TypeError, ZeroDivisionError, OverflowError, IndexError) as e:
            raise ScriptError(str(e)) from e


    def _reach(self, name: str, path: str, value: Any = None) -> Any:
        if name == "exists":
            return float(path in self.tree)
        if name == "get":
            return self.tree.get(path)
        if path not in self.tree:
            raise ScriptError(f"no node at {path!r}")
        self.tree[path] = value
        return value


def evaluate(script: str, fields: dict[str, Any] | None = None) -> Any:
    """The value of a script; numbers are floats."""
    return Interpreter(fields).run(parse(script))


# Columns.  Each compiled value is a (kind, column) pair; kind is 'n' for numbers, 's' for strings.

_NATIVE: dict[str, tuple[str, Callable]] = {
    "abs": ("n", lambda n, s: F.abs(n[0])),
    "ceil": ("n", lambda n, s: F.ceil(n[0]).cast("double")),
    "floor": ("n", lambda n, s: F.floor(n[0]).cast("double")),
    "sum": ("n", lambda n, s: sum(n[1:], n[0])),
    "avg": ("n", lambda n, s: sum(n[1:], n[0]) / len(n)),
    "max": ("n", lambda n, s: F.greatest(*n) if len(n) > 1 else n[0]),
    "min": ("n", lambda n, s: F.least(*n) if len(n) > 1 else n[0]),
    "mod": ("n", lambda n, s: n[0] % n[1]),
    "round": ("n", lambda n, s: F.signum(n[0]) * F.floor(F.abs(n[0]) * F.pow(F.lit(10.0), n[1] if len(n) > 1 else F.lit(0.0)) + 0.5 + 1e-9) / F.pow(F.lit(10.0), n[1] if len(n) > 1 else F.lit(0.0))),
    "concat": ("s", lambda n, s: F.concat(*s)),
    "left": ("s", lambda n, s: F.left(s[0], n[1].cast("int"))),
    "right": ("s", lambda n, s: F.right(s[0], n[1].cast("int"))),
    "len": ("n", lambda n, s: F.length(s[0]).cast("double")),
    "lower": ("s", lambda n, s: F.lower(s[0])),
    "upper": ("s", lambda n, s: F.upper(s[0])),
    "at": ("n", lambda n, s: F.instr(s[0], s[1]).cast("double")),
    "substr": ("s", lambda n, s: F.substring(s[0], n[1].cast("int"), n[2].cast("int"))),
    "replace": ("s", lambda n, s: F.replace(s[0], s[1], s[2])),
    "within": ("n", lambda n, s: n[0].between(n[1], n[2]).cast("double")),
    "oneof": ("n", lambda n, s: n[0].isin(*n[1:]).cast("double")),
}


class NotNative(Exception):
    """The script has parts that no column can express."""


def _num(v: tuple[str, Column]) -> Column:
    kind, c = v
    if kind == "s":
        c = F.when(c.rlike(r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"), F.trim(c).try_cast("double"))
    return F.coalesce(c, F.lit(0.0))


def _str(v: tuple[str, Column]) -> Column:
    kind, c = v
    return F.coalesce(T.plain_number(c) if kind == "n" else c, F.lit(""))


def _compile(node: Node, kinds: dict[str, str]) -> tuple[str, Column]:
    if node.kind == "block" and len(node.parts) == 1:
        return _compile(node.parts[0], kinds)
    if node.kind == "literal":
        if node.value is None:
            return "n", F.lit(None).cast("double")
        return ("s" if isinstance(node.value, str) else "n"), F.lit(node.value)
    if node.kind == "path" and node.value in kinds:
        c = F.col(node.value)
        return (kinds[node.value], c.cast("double") if kinds[node.value] == "n" else c)
    if node.kind == "unary":
        x = _num(_compile(node.parts[0], kinds))
        return "n", {"-": -x, "+": x, "not": (x == 0).cast("double")}[node.value]
    if node.kind == "binary":
        a, b = (_compile(p, kinds) for p in node.parts)
        if node.value in ("and", "or"):
            x, y = _num(a) != 0, _num(b) != 0
            return "n", (x & y if node.value == "and" else x | y).cast("double")
        if node.value in "+-*/":
            x, y = _num(a), _num(b)
            return "n", {"+": x + y, "-": x - y, "*": x * y, "/": x / F.nullif(y, F.lit(0.0))}[node.value]
        both, one = a[1].isNull() & b[1].isNull(), a[1].isNull() | b[1].isNull()
        x, y = (a[1], b[1]) if a[0] == b[0] == "s" else (_num(a), _num(b))
        test = {"==": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[node.value]
        empty = both if node.value in ("==", "<=", ">=") else (~both if node.value == "<>" else F.lit(False))
        return "n", F.when(one, empty.cast("double")).otherwise(test.cast("double"))
    if node.kind == "if" or node.kind == "call" and node.value == "if":
        test, *rest = node.parts
        values = [_compile(p, kinds) for p in rest]
        if len({k for k, _ in values}) > 1:
            raise NotNative("branches of different kinds")
        last = values[1][1] if len(values) > 1 else F.lit(None)
        return values[0][0], F.when(_num(_compile(test, kinds)) != 0, values[0][1]).otherwise(last)
    if node.kind == "call" and node.value in _NATIVE:
        values = [_compile(p, kinds) for p in node.parts]
        kind, make = _NATIVE[node.value]
        return kind, make([_num(v) for v in values], [_str(v) for v in values])
    raise NotNative(node.kind)


def names_in(node: Any) -> set[str]:
    """All names and other words of a script."""
    if isinstance(node, (list, tuple)):
        return set().union(*map(names_in, node))
    if isinstance(node, Node):
        own = {node.value} if isinstance(node.value, str) else names_in(node.value) if isinstance(node.value, (list, tuple, Node)) else set()
        return own | names_in(node.parts)
    return {node} if isinstance(node, str) else set()


def compiled(script: str, df: DataFrame, errors: bool = False) -> Column:
    """The script as a string column over the columns of ``df``; whole numbers have no fraction.

    Division by zero and scripts that fail give null.  With ``errors`` the result is a
    struct of ``value`` and ``error``, the latter what made a script fail.  Scripts that
    columns cannot express are interpreted, with the columns they name only.
    """
    node = parse(script)
    kinds = {n: "s" if t in ("string", "boolean", "date", "timestamp") else "n" for n, t in df.dtypes if t.split("(")[0] in ("string", "int", "bigint", "double", "float", "decimal", "smallint", "tinyint")}
    try:
        kind, c = _compile(node, kinds)
        value = T.plain_number(c) if kind == "n" else c
        return F.struct(value.alias("value"), F.lit(None).cast("string").alias("error")) if errors else value
    except NotNative:
        words = {w.lower() for w in names_in(node)}
        names = sorted(n for n in kinds if n.lower() in words)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in frame[names].itertuples(index=False, name=None) if names else [()] * len(frame):
            fields = {n: None if v is None or v != v else v if isinstance(v, str) else float(v) for n, v in zip(names, row)}
            try:
                value = Interpreter(fields).run(node)
                out.append((None if value is None else string(value), None))
            except (ScriptError, _Break, _Continue, _Return, RecursionError) as e:
                out.append((None, f"{type(e).__name__}: {e}".strip(": ")))
        return pd.DataFrame(out, columns=["value", "error"], dtype=object)

    made = F.pandas_udf(run, StructType().add("value", StringType()).add("error", StringType()))(F.struct(*(names or [F.lit(0).alias("none")])))
    return made if errors else made["value"]
