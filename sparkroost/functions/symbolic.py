"""Equality of formulas: the steps of math equality that need a parser.

A formula is read into a tree: numbers (exact fractions), one-letter and Greek variables, ``+ - * / ^``,
products without a sign, fractions, roots, common functions, absolute values, and the usual TeX around them.
Two trees are compared

1. exactly, in a prime field at random points. Variables, pi and e are random elements, i is a root of -1, and what is
   no rational function (a root, a sine, an absolute value) is a random element of its own, the same one wherever its
   argument has the same values. Rational functions are settled here (a wrong "equal" needs a root of their
   difference at all points, less than one in 10^50 for any degree that fits a text), and so are formulas that agree
   or differ by a constant;
2. else, by value at positive, negative and complex points: all points where both are defined must agree within 1e-9, so
   that ``|x|`` or a root of ``x^2`` is not ``x``.

Formulas without variables are equal within a relative 1e-4. What can't be read equals only its own text.
"""

from __future__ import annotations

import cmath
import functools
import hashlib
import math
import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from . import scores as S
from . import text as T
from .once import each_once

#: A node: its kind, and numbers, names or nodes.
Tree = tuple
#: A prime with a root of -1, the points in its field, and how often other points are tried where one is a pole.
PRIME, FIELD_POINTS, TRIES = (1 << 61) - 31, 3, 3
IMAGINARY = next(r for r in (pow(a, (PRIME - 1) // 4, PRIME) for a in range(2, 100)) if r * r % PRIME == PRIME - 1)
#: Sizes of the points of each kind (positive, negative, complex): an absolute value turns at its formula's constants, so
#: some are large. At least a third of all points must be defined on both sides.
SCALES = (1, 1, 13, 180, 2500, 40_000)
#: Texts longer than this are no formulas; also bounds the depth of the reader.
LONGEST = 2000
_FUNCTIONS = {"sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "ln": cmath.log, "log": cmath.log, "exp": cmath.exp, "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan, "sinh": cmath.sinh, "cosh": cmath.cosh, "tanh": cmath.tanh}
_CONSTANTS = {"pi": math.pi, "e": math.e, "i": 1j}
_SIGNS = {"cdot": "*", "times": "*", "div": "/"}
_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*|\.\d+)|\\?([a-zA-Z]+)|(\*\*|[-+*/^(){}\[\]|]))")
_MATRIX = re.compile(r"^\\begin\{[pb]matrix\}(.*)\\end\{[pb]matrix\}$", re.DOTALL)


class Unreadable(ValueError):
    """The text is no formula that this reader knows."""


class _Reader:
    """Recursive descent over the tokens of one formula."""

    def __init__(self, text: str):
        text = re.sub(r"\\(left|right|,|;|!|quad|qquad|displaystyle)(?![a-zA-Z])", " ", text).replace("\\$", "").replace("$", "").replace("\u03c0", "\\pi ")
        text = re.sub(r"\\[dt]frac", r"\\frac", text)
        text = re.sub(r"\\operatorname\{(\w+)\}|\\mathrm\{(\w+)\}", lambda m: "\\" + (m[1] or m[2]), text)
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise Unreadable(text[at:])
            if m[2] and m[0].strip()[0] != "\\" and m[2] not in _FUNCTIONS and m[2] not in ("pi", "sqrt"):
                self.tokens += list(m[2])  # letters side by side are a product
            elif m[2]:
                self.tokens.append(_SIGNS.get(m[2], "\\" + m[2]))
            else:
                self.tokens.append("^" if m[3] == "**" else m[1] or m[3])
            at = m.end()
        self.at, self.names = 0, set()

    def read(self) -> Tree:
        out = self.total()
        if self.at < len(self.tokens):
            raise Unreadable(self.tokens[self.at])
        return out

    def next(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, want: str = "") -> str:
        got = self.next()
        if not got or want and got != want:
            raise Unreadable(got)
        self.at += 1
        return got

    def total(self) -> Tree:
        out = self.product()
        while self.next() in ("+", "-"):
            minus, left, right = self.take() == "-", out, self.product()
            out = ("-" if minus else "+", left, right)
        return out

    def product(self) -> Tree:
        out = self.signed()
        while True:
            sign = self.next()
            if sign in ("*", "/"):
                self.take()
                left, right = out, self.signed()
                out = (sign, left, right)
            elif sign and sign not in "+-)}]|^":
                out = ("*", out, self.power())
            else:
                return out

    def signed(self) -> Tree:
        if self.next() in ("+", "-"):
            minus, own = self.take() == "-", self.signed()
            return ("-", number(0), own) if minus else own
        return self.power()

    def power(self) -> Tree:
        base = self.atom()
        if self.next() != "^":
            return base
        self.take()
        return ("^", base, self.signed())

    def group(self, close: str) -> Tree:
        out = self.total()
        self.take(close)
        return out

    def argument(self) -> Tree:
        """What stands after a macro: a group in braces, or one digit or letter."""
        if self.next() == "{":
            self.take()
            return self.group("}")
        own = self.next()
        if len(own) > 1 and own.isdigit():  # a fraction such as \frac12
            self.tokens[self.at] = own[1:]
            return number(own[0])
        return self.atom()

    def atom(self) -> Tree:
        got = self.take()
        if got in "({[":
            return self.group({"(": ")", "{": "}", "[": "]"}[got])
        if got == "|":
            return ("call", "abs", self.group("|"))
        if got[0].isdigit() or got[0] == ".":
            return number(got)
        name = got.lstrip("\\")
        if name == "frac":
            return ("/", self.argument(), self.argument())
        if name == "sqrt":
            if self.next() == "[":
                self.take()
                degree = self.group("]")
                return ("^", self.argument(), ("/", number(1), degree))
            return ("^", self.argument(), number("1/2"))
        if name in _FUNCTIONS:
            top = None
            if self.next() == "^":
                self.take()
                top = self.argument()
            inner = self.group(")") if self.next() == "(" and self.take() else self.power()
            called = ("call", "ln" if name == "log" else name, inner)
            return ("^", called, top) if top else called
        if name in _CONSTANTS:
            return ("constant", name)
        if name.isalpha() and (len(name) == 1 or got[0] == "\\"):
            self.names.add(name)
            return ("variable", name)
        raise Unreadable(got)


def number(text: str | int) -> Tree:
    return ("number", Fraction(text))


def read(text: str) -> tuple[Tree, set[str]]:
    """A formula's tree, and its variables."""
    if len(text) > LONGEST:
        raise Unreadable("too long")
    reader = _Reader(text)
    return reader.read(), reader.names


def _random(*of: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(of).encode(), digest_size=16).digest(), "big") % PRIME


def _fraction(tree: Tree) -> Fraction | None:
    """The value of a tree of numbers alone."""
    kind, *own = tree
    if kind == "number":
        return own[0]
    if kind not in ("+", "-", "*", "/", "^"):
        return None
    a, b = map(_fraction, own)
    if a is None or b is None or b == 0 and kind == "/":
        return None
    if kind == "^":
        return a ** int(b) if b.denominator == 1 and abs(b) <= 64 and (a or b > 0) else None
    return a + b if kind == "+" else a - b if kind == "-" else a * b if kind == "*" else a / b


class _Field:
    """Values of trees at ``FIELD_POINTS`` points of the field; ``rational`` falls if a tree has a part that is
    no rational function."""

    def __init__(self, seed: int):
        self.seed, self.rational = seed, True

    def atom(self, *of: object) -> list[int]:
        self.rational = False
        return [_random(self.seed, k, *of) for k in range(FIELD_POINTS)]

    def inverse(self, a: list[int]) -> list[int]:
        if 0 in a:
            raise ZeroDivisionError
        return [pow(x, -1, PRIME) for x in a]

    def power(self, base: Tree, top: Tree) -> list[int]:
        own, n = self.value(base), _fraction(top)
        if n is None:
            return self.atom("^", own, self.value(top))
        if n.denominator > 1:
            own = self.atom("root", n.denominator, own)
        return [pow(x, abs(n.numerator), PRIME) for x in (self.inverse(own) if n < 0 else own)]

    def value(self, tree: Tree) -> list[int]:
        kind, *own = tree
        if kind == "number":
            x = own[0]
            return [x.numerator * pow(x.denominator, -1, PRIME) % PRIME] * FIELD_POINTS
        if kind == "variable":
            return [_random(self.seed, k, own[0]) for k in range(FIELD_POINTS)]
        if kind == "constant":
            return [IMAGINARY] * FIELD_POINTS if own[0] == "i" else [_random(self.seed, k, "constant", own[0]) for k in range(FIELD_POINTS)]
        if kind == "call":
            return self.power(("constant", "e"), own[1]) if own[0] == "exp" else self.atom(own[0], self.value(own[1]))
        if kind == "^":
            return self.power(*own)
        a, b = map(self.value, own)
        if kind == "/":
            b = self.inverse(b)
        return [(x + y if kind == "+" else x - y if kind == "-" else x * y) % PRIME for x, y in zip(a, b, strict=True)]


def identical(a: Tree, b: Tree) -> bool | None:
    """Whether two trees are the same function; null if the field can't tell."""
    for seed in range(TRIES):
        field = _Field(seed)
        try:
            gap = [(x - y) % PRIME for x, y in zip(field.value(a), field.value(b), strict=True)]
        except ZeroDivisionError:
            continue
        if not any(gap):
            return True
        return False if field.rational or len(set(gap)) == 1 else None
    return None


def _value(tree: Tree, at: dict[str, complex], largest: list[float]) -> complex:
    """A tree's value; ``largest`` holds the largest absolute value of its sums' parts."""
    kind, *own = tree
    if kind == "number":
        return complex(own[0])
    if kind == "variable":
        return at[own[0]]
    if kind == "constant":
        return complex(_CONSTANTS[own[0]])
    if kind == "call":
        inner = _value(own[1], at, largest)
        return complex(abs(inner)) if own[0] == "abs" else _FUNCTIONS[own[0]](inner)
    a, b = (_value(x, at, largest) for x in own)
    if kind in ("+", "-"):
        largest[0] = max(largest[0], abs(a), abs(b))
        return a + b if kind == "+" else a - b
    return a * b if kind == "*" else a / b if kind == "/" else a**b


def _values(tree: Tree, names: set[str]) -> list[complex | None]:
    """A tree's values at the sample points, null where it is undefined or has lost its digits in sums."""
    out = []
    for k in range(3 * len(SCALES)):
        scale = SCALES[k // 3] if k % 3 < 2 else 1  # functions of large complex numbers are too large
        size = {n: scale * (0.3 + _random("size", n, k) % 9973 / 3989) for n in names}
        turn = {n: (1, -1, cmath.exp(1j * (0.4 + _random("turn", n, k) % 9973 / 3989)))[k % 3] for n in names}
        largest = [0.0]
        try:
            value = _value(tree, {n: size[n] * turn[n] for n in names}, largest)
            out.append(value if cmath.isfinite(value) and largest[0] * 1e-14 <= 1e-9 * max(abs(value), 1e-9) else None)
        except (ArithmeticError, ValueError):
            out.append(None)
    return out


def _agree(a: list[complex | None], b: list[complex | None], near: float) -> bool:
    pairs = [(x, y) for x, y in zip(a, b, strict=True) if x is not None and y is not None]
    return len(pairs) * 3 >= len(a) and all(abs(x - y) <= near * max(abs(x), abs(y), 1e-9) for x, y in pairs)


def formulas_equal(a: str, b: str) -> bool:
    """Two formulas; constants within a relative 1e-4, formulas of variables as functions."""
    try:
        (x, names), (y, others) = read(a), read(b)
        names = names | others
        same = identical(x, y) if names else None
    except (Unreadable, RecursionError):
        return a.strip() == b.strip()
    return _agree(_values(x, names), _values(y, names), 1e-9 if names else 1e-4) if same is None else same


def _number(text: str) -> float | None:
    t = text.strip().replace(",", "")
    try:
        return float(t.rstrip("%").rstrip("\\")) / 100 if t.endswith("%") else float(t)
    except ValueError:
        return None


def _same(a: str, b: str) -> bool:
    """An entry of a matrix, or a side of an equation."""
    if a.strip().lower() == b.strip().lower():
        return True
    x, y = _number(a), _number(b)
    if x is not None and y is not None:
        return any(math.isclose(x, z, rel_tol=1e-4) for z in (y / 100, y, y * 100))
    return equal(a, b)


def _rows(text: str) -> list[list[str]] | None:
    """The entries of a matrix by row."""
    m = _MATRIX.match(text)
    return None if m is None else [line.split("&") for line in (x.strip() for x in m[1].split("\\\\")) if line]


def as_matrix(text: str) -> str:
    """The lists in braces of a text as column matrices."""
    found = re.findall(r"\{.*,.*\}", text.strip())
    return ", ".join("\\begin{pmatrix}" + x.strip("{}").replace(",", "\\") + "\\end{pmatrix}" for x in found)


def equal(answer: str | None, truth: str | None) -> bool:
    """Matrices by entry, equations by the difference of their sides (either sign), an equation with a
    short left side by its right side, else as formulas. A null or empty text equals nothing."""
    if not answer or not truth:
        return False
    a, b = answer.strip(), truth.strip()
    if "pmatrix" in a and "pmatrix" not in b:
        b = as_matrix(b)
    x, y = _rows(a), _rows(b)
    if x is not None and y is not None:
        return [len(r) for r in x] == [len(r) for r in y] and all(_same(p, q) for r, s in zip(x, y, strict=True) for p, q in zip(r, s, strict=True))
    sides, others = a.split("="), b.split("=")
    if len(sides) == 2 and len(others) == 2:
        p, q = (f"({s[0]}) - ({s[1]})" for s in (sides, others))
        return formulas_equal(p, q) or formulas_equal(f"-({p})", q)
    if len(sides) == 2 and len(others) == 1 and len(sides[0].strip()) <= 2:
        return _same(sides[1], b)
    if len(others) == 2 and len(sides) == 1 and len(others[0].strip()) <= 2:
        return _same(a, others[1])
    return formulas_equal(a, b)


@F.pandas_udf(StructType([StructField("equal", BooleanType()), StructField("error", StringType())]))
def _equal(answer: pd.Series, truth: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_entry(a, b) for a, b in zip(answer, truth, strict=True)], columns=["equal", "error"])


@functools.lru_cache(maxsize=1 << 16)
def _entry(a: str | None, b: str | None) -> tuple[bool, str | None]:
    """Answers repeat, so a worker remembers some."""
    try:
        return equal(a, b), None
    except Exception as e:  # a formula that breaks the comparison is an error of its row alone
        return False, f"{type(e).__name__}: {e}"


def with_math_scores(rows: DataFrame, text: str = "text", truth: str = "truth") -> DataFrame:
    """``rows`` with score and error by the whole ladder. Each different pair of a text and a truth is scored once and
    joined to the rows that have it, so that the ladder's work grows with the pairs. Each step is a column, so that none is
    worked out twice. Only pairs that the native steps leave open, and that aren't two numbers (which those steps
    settle), carry texts to the reader; the others send it nulls."""
    a, b = F.col("math__.a"), F.col("math__.b")
    pairs = each_once(rows.select(F.col(text).alias("text__"), F.col(truth).alias("truth__")))
    out = pairs.withColumn("math__", F.struct(T.strip(F.substring_index(T.math_answer(F.col("text__")), "=", -1)).alias("a"), F.col("truth__").alias("b")))
    out = out.withColumn("native__", S.math_equal(a, b))
    settled = F.col("native__") | (S.parse_digits(a).isNotNull() & S.parse_digits(b).isNotNull())
    out = out.withColumn("open__", F.when(~settled, F.col("math__")))
    out = out.withColumn("read__", _equal(F.col("open__.a"), F.col("open__.b")))
    scored = out.select("text__", "truth__", S.score_if(F.col("native__") | F.col("read__.equal")).alias("score"), F.col("read__.error").alias("error"))
    same = F.col(text).eqNullSafe(F.col("text__")) & F.col(truth).eqNullSafe(F.col("truth__"))
    return rows.drop("score", "error").join(scored, same, "left").drop("text__", "truth__")


def math_metric(text: Column, truth: Column) -> Column:
    """The score alone, as a column; :func:`with_math_scores` does the same with less work."""
    answer = T.strip(F.substring_index(T.math_answer(text), "=", -1))
    native = S.math_equal(answer, truth)
    settled = native | (S.parse_digits(answer).isNotNull() & S.parse_digits(truth).isNotNull())
    return S.score_if(native | _equal(F.when(~settled, answer), F.when(~settled, truth))["equal"])
