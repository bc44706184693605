"""Answers compared as formulas, without a symbolic library.

An answer is read once: a scanner turns LaTeX and plain text into tokens (dressing such as signs of currency, spacing or
units is no token), and a grammar turns tokens into lists, intervals, matrices, relations and formulas. A formula's
normal form is a quotient of two sparse polynomials with rational coefficients and rational exponents. Its unknowns are
letters, pi, primes (whose exponents are proper fractions: a radical), roots of sums, functions and symbolic powers. Two
formulas are equal when the cross products of their quotients are.

All numbers are exact. A prime's power of over ``MOST_BITS`` bits stays an unknown whose exponent takes in all of that prime
that the coefficient holds. A formula of more than ``MOST_TERMS`` terms, with numbers of over ``MOST_DIGITS`` digits (or
``MOST_BITS`` bits on the way) or nested deeper than ``MOST_DEPTH`` is no formula for us: such answers are equal as
token sequences only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from fractions import Fraction

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

MOST_TERMS, MOST_DIGITS, MOST_BITS, MOST_DEPTH = 2000, 4000, 1 << 15, 150
#: Higher powers of a term are taken prime by prime, if its coefficient has so many bits at most.
MOST_POWER, MOST_FACTORED = 1000, 512

# Units that an answer may carry, and magnitudes by name.
UNITS = ("degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard", "liter")
MAGNITUDES = {"million": 6, "billion": 9, "trillion": 12}

_FUNCTIONS = frozenset("sin cos tan cot sec csc sinh cosh tanh arcsin arccos arctan log ln".split())
_GREEK = frozenset("alpha beta gamma delta epsilon theta lambda mu nu rho sigma tau phi psi omega".split())
_MEANS = {
    "cdot": "*", "times": "*", "div": "/", "cup": "U", "infty": "inf", "pi": "pi", "le": "<=", "leq": "<=", "ge": ">=", "geq": ">=", "lt": "<", "gt": ">", "neq": "!=", "ne": "!=", "pm": "+-", "mid": "|",
    "dfrac": "frac", "tfrac": "frac", "cfrac": "frac", "lbrace": "\\{", "rbrace": "\\}", "infinity": "inf", "and": ",", "or": ",", "oplus": "^^",
    "√": "sqrt", "π": "pi", "∞": "inf", "∪": "U", "·": "*", "×": "*", "÷": "/", "−": "-", "≤": "<=", "≥": ">=", "≠": "!=", "±": "+-", "**": "^",
}
#: LaTeX commands that say how something looks, not what it is.
_LOOKS = frozenset("left right text mathrm mathbf textbf mbox operatorname displaystyle quad qquad circ degree big Big bigg Bigg limits".split())
_SCAN = re.compile(
    r"(?P<number>\d+(?:(?:,\\!|\{,\}|,)\d{3})+(?!\d)(?:\.\d+)?|\d+\.?\d*|\.\d+)|\\(?P<command>[a-zA-Z]+)|(?P<brace>\\[{}|])|(?P<space>\\[,!;: ]|[\s$%~°]+|\\[$%])|(?P<row>\\\\)"
    r"|(?P<word>[^\W\d_]+)|(?P<sign><=|>=|!=|\*\*|[-+*/^()\[\]{}|,;&=<>_!:'\"√π∞∪·×÷−≤≥≠±])|(?P<other>.)"
)
_DEGREE = re.compile(r"\^\s*(?:\\circ|\{\s*\\circ\s*\}|\\degree)")


class Unreadable(Exception):
    """Not a formula, or one beyond the limits."""


def tokens(answer: str) -> list[str]:
    """The tokens of an answer, lower-cased; what only dresses it is left out."""
    out: list[str] = []
    for m in _SCAN.finditer(_DEGREE.sub("", answer)):
        kind, t = m.lastgroup, m[m.lastgroup]
        if kind == "space" or kind == "command" and t in _LOOKS:
            # A gap tells numbers apart: 7 3/4.
            if out and out[-1] != " " and kind == "space" and t.isspace():
                out.append(" ")
            continue
        if kind == "number":
            out.append(re.sub(r"[^\d.]", "", t))
        elif kind in ("command", "word"):
            out += _named(t, kind == "command")
        else:
            out.append(_MEANS.get(t, t))
    out = [t for i, t in enumerate(out) if t != " " or (0 < i < len(out) - 1 and out[i - 1][-1:].isdigit() and out[i + 1][0].isdigit())]
    while out and out[-1] in ".,":
        out.pop()
    return out


def _named(name: str, command: bool) -> list[str]:
    """Tokens of a word: a known name, letters to be multiplied, or a word of text in quotes."""
    low = name.lower()
    if name in _MEANS or low in _MEANS:
        return [_MEANS.get(name) or _MEANS[low]]
    if command or low in _FUNCTIONS or low in ("sqrt", "pi", "inf", "u", *_GREEK):
        return ["U"] if name == "U" else [low]
    if low in MAGNITUDES:
        return ["*", "10", "^", str(MAGNITUDES[low])]
    if any(low in (u, u + "s", u + "es") for u in UNITS):
        return []
    return [c for x in low for c in x] if len(low) < 4 else [f'"{low}"']


# Polynomials: {monomial: coefficient}, a monomial being sorted pairs of an unknown and its exponent.
Poly = dict
ONE: Poly = {(): Fraction(1)}


@dataclass(frozen=True)
class Quotient:
    over: Poly
    under: Poly


def _large(g: str, e: int) -> bool:
    """Whether the power e of a number is too large for a coefficient."""
    return abs(e) >= MOST_BITS or abs(e) * math.log2(int(g)) >= MOST_BITS


def _taken(c: Fraction, g: int) -> tuple[Fraction, int]:
    """``c`` without its factors ``g``, and how many there were; in a denominator they count as negative."""
    k = 0
    while c.numerator % g == 0:
        c, k = c / g, k + 1
    while c.denominator % g == 0:
        c, k = c * g, k - 1
    return c, k


def _gathered(p: Poly) -> Poly:
    """Primes of large powers leave the coefficients of their terms, so that a number has one form."""
    while True:
        out: Poly = {}
        for m, c in p.items():
            exponents = dict(m)
            for g, e in m:
                if g.isdigit() and abs(e) >= 1:
                    c, k = _taken(c, int(g))
                    e += k
                    up = math.floor(e)
                    if not _large(g, up):
                        c, e = c * Fraction(int(g)) ** up, e - up
                    exponents[g] = e
            n = tuple(sorted((g, e) for g, e in exponents.items() if e))
            out[n] = out.get(n, 0) + c
        out = {m: c for m, c in out.items() if c}
        if out == p:
            return out
        p = out


def _checked(p: Poly) -> Poly:
    if any(g.isdigit() and abs(e) >= 1 for m in p for g, e in m):
        p = _gathered(p)
    if len(p) > MOST_TERMS or any(max(c.numerator.bit_length(), c.denominator.bit_length()) > MOST_BITS for c in p.values()):
        raise Unreadable("too large")
    return p


def _sum(p: Poly, q: Poly, sign: int = 1) -> Poly:
    out = dict(p)
    for m, c in q.items():
        out[m] = out.get(m, 0) + sign * c
    return _checked({m: c for m, c in out.items() if c})


def _key(p: Poly) -> str:
    return "+".join(f"{c}{''.join(f'[{g}^{e}]' for g, e in m)}" for m, c in sorted(p.items(), key=str)) or "0"


class Formulas:
    """Arithmetic of quotients; keeps what a root's name stands for."""

    def __init__(self) -> None:
        self.sums: dict[str, Poly] = {}

    def product(self, p: Poly, q: Poly) -> Poly:
        if len(p) * len(q) > 50 * MOST_TERMS:
            raise Unreadable("too large")
        out: Poly = {}
        for m, c in p.items():
            for n, d in q.items():
                part = self._reduced(m, n, c * d)
                out = _sum(out, part) if len(part) != 1 else self._added(out, part)
        return _checked({m: c for m, c in out.items() if c})

    @staticmethod
    def _added(out: Poly, part: Poly) -> Poly:
        for m, c in part.items():
            out[m] = out.get(m, 0) + c
        return out

    def _reduced(self, m: tuple, n: tuple, c: Fraction) -> Poly:
        """c * m * n, primes to whole exponents in the coefficient, roots of sums to sums."""
        exponents, whole = Counter(), ONE
        for g, e in (*m, *n):
            exponents[g] += e
        left = []
        for g, e in exponents.items():
            if g.isdigit():
                up = math.floor(e)
                if not _large(g, up):
                    c, e = c * Fraction(int(g)) ** up, e - up
            elif g == "+-":
                e %= 2
            elif g == "im":
                e %= 4
                if e >= 2:
                    c, e = -c, e - 2
            elif g in self.sums and e >= 1:
                up = math.floor(e)
                e -= up
                for _ in range(up):
                    whole = self.product(whole, self.sums[g])
            if e:
                left.append((g, e))
        out = {tuple(sorted(left)): c}
        return out if whole is ONE else self.product(out, whole)

    def times(self, a: Quotient, b: Quotient) -> Quotient:
        return Quotient(self.product(a.over, b.over), ONE if a.under is ONE and b.under is ONE else self.product(a.under, b.under))

    def plus(self, a: Quotient, b: Quotient, sign: int = 1) -> Quotient:
        if a.under == b.under:
            return Quotient(_sum(a.over, b.over, sign), a.under)
        return Quotient(_sum(self.product(a.over, b.under), self.product(b.over, a.under), sign), self.product(a.under, b.under))

    def inverse(self, a: Quotient) -> Quotient:
        if not a.over:
            raise Unreadable("division by zero")
        if len(a.over) == 1:
            ((m, c),) = a.over.items()
            # The inverse of a term is a term: its exponents turn.
            return Quotient(self.product(a.under, self._reduced((), tuple((g, -e) for g, e in m), 1 / c)), ONE)
        return Quotient(a.under, a.over)

    def power(self, a: Quotient, b: Quotient) -> Quotient:
        if b.under != ONE:
            return self._unknown(f"({_key(a.over)}/{_key(a.under)})^({_key(b.over)}/{_key(b.under)})")
        out = Quotient(ONE, ONE)
        for m, c in b.over.items():
            out = self.times(out, self._raised(a, c) if not m else self._symbolic(a, _key({m: Fraction(1)}), c))
        return out

    def _symbolic(self, a: Quotient, exponent: str, times: Fraction) -> Quotient:
        """a^(times * exponent) of an exponent that is no number."""
        if a.under == ONE and list(a.over) == [()] and a.over[()] > 0:
            primes = [*((p, k) for p, k in _factors(a.over[()].numerator)), *((p, -k) for p, k in _factors(a.over[()].denominator))]
            return Quotient({tuple(sorted((f"{p}^{exponent}", k * times) for p, k in primes)): Fraction(1)}, ONE)
        return Quotient({((f"({_key(a.over)}/{_key(a.under)})^{exponent}", times),): Fraction(1)}, ONE)

    def _plain(self, a: Quotient) -> bool:
        """Whether it is one term without roots of sums, and its coefficient small enough to be factored."""
        return a.under == ONE and len(a.over) == 1 and not any(g in self.sums for m in a.over for g, _ in m) and all(max(c.numerator.bit_length(), c.denominator.bit_length()) <= MOST_FACTORED for c in a.over.values())

    def _raised(self, a: Quotient, e: Fraction) -> Quotient:
        if e.denominator == 1:
            base, n, out = self.inverse(a) if e < 0 else a, abs(int(e)), Quotient(ONE, ONE)
            if n > MOST_POWER and self._plain(base):
                # A term's power is a term, by its primes.
                ((m, c),) = base.over.items()
                primes = [(str(q), k * n) for q, k in _factors(abs(c).numerator)] + [(str(q), -k * n) for q, k in _factors(abs(c).denominator)]
                return Quotient(_checked(self._reduced(tuple(primes), tuple((g, x * n) for g, x in m), Fraction(-1 if c < 0 and n % 2 else 1))), ONE)
            if n.bit_length() > 16:
                return self._unknown(f"({_key(a.over)}/{_key(a.under)})^{e}")
            while n:
                if n & 1:
                    out = self.times(out, base)
                n >>= 1
                base = self.times(base, base) if n else base
            return out
        if not a.over:
            return a
        if a.under != ONE:
            return self.times(self._raised(Quotient(a.over, ONE), e), self._raised(Quotient(a.under, ONE), -e))
        return self._root(a.over, e)

    def _root(self, p: Poly, e: Fraction) -> Quotient:
        """p^e of a proper fraction e: the rational content's primes, and what is left as one unknown."""
        if len(p) == 1:
            ((m, c),) = p.items()
        else:
            m, c = None, Fraction(math.gcd(*[x.numerator for x in p.values()]), math.lcm(*[x.denominator for x in p.values()]))
        if m is not None and c < 0 and e.denominator % 2 == 0:
            c, unit = -c, [("im", Fraction(2 * e.numerator, e.denominator))]
        else:
            unit = []
        sign = -1 if c < 0 and e.numerator % 2 else 1
        primes = [(str(q), k * e) for q, k in _factors(abs(c).numerator)] + [(str(q), -k * e) for q, k in _factors(abs(c).denominator)]
        if m:
            primes += [(g, x * e) for g, x in m if g.isdigit() and abs(x) >= 1]
            m = tuple((g, x) for g, x in m if not (g.isdigit() and abs(x) >= 1))
        if m is None:
            rest = {n: x / c for n, x in p.items()}
            name = f"sum {_key(rest)}"
            self.sums[name] = rest
            unit.append((name, e))
        elif len(m) == 1 and m[0][1] == 1:
            unit.append((m[0][0], e))
        elif m:
            name = f"term {_key({m: Fraction(1)})}"
            self.sums[name] = {m: Fraction(1)}
            unit.append((name, e))
        return Quotient(self._reduced(tuple(primes), tuple(unit), Fraction(sign)), ONE)

    def _unknown(self, name: str) -> Quotient:
        return Quotient({((name, Fraction(1)),): Fraction(1)}, ONE)

    def function(self, name: str, a: Quotient) -> Quotient:
        return self._unknown(f"{name}({_key(a.over)}/{_key(a.under)})")

    def equal(self, a: Quotient, b: Quotient) -> bool:
        x, y = self.product(a.over, b.under), self.product(b.over, a.under)
        # Roots of sums in denominators are cleared on both sides, so that their powers come out.
        least: dict[str, Fraction] = {}
        for m in (*x, *y):
            for g, e in m:
                if g in self.sums and e < 0:
                    least[g] = min(least.get(g, e), e)
        clear = {tuple(sorted((g, -e) for g, e in least.items())): Fraction(1)}
        return self.product(x, clear) == self.product(y, clear) if least else x == y


def _factors(n: int) -> list[tuple[int, int]]:
    """Prime factors up to 10^4 with their exponents, and what is left of ``n``: a square's root counts twice."""
    out, p = [], 2
    while p * p <= n and p <= 10_000:
        k = 0
        while n % p == 0:
            n, k = n // p, k + 1
        if k:
            out.append((p, k))
        p += 1 if p == 2 else 2
    if n > 1:
        r = math.isqrt(n)
        out.append((r, 2) if r * r == n else (n, 1))
    return out


@dataclass(frozen=True)
class Group:
    """A list, tuple, interval, set or matrix."""

    open: str
    close: str
    items: tuple


@dataclass(frozen=True)
class Relation:
    sign: str
    left: Quotient
    right: Quotient


class Grammar:
    """Reads tokens to a Group, a Relation or a Quotient."""

    CLOSED = {"(": ")", "[": "]", "{": "}"}

    def __init__(self, found: list[str], formulas: Formulas):
        self.found, self.at, self.f, self.depth = found, 0, formulas, 0

    def peek(self) -> str:
        return self.found[self.at] if self.at < len(self.found) else ""

    def take(self, want: str = "") -> str:
        t = self.peek()
        if not t or want and t != want:
            raise Unreadable(f"{want or 'more'} expected")
        self.at += 1
        return t

    def answer(self):
        parts = [self.listed()]
        while self.peek() == "U":
            self.take()
            parts.append(self.listed())
        if self.peek():
            raise Unreadable(self.peek())
        return parts[0] if len(parts) == 1 else Group("U", "U", tuple(parts))

    def listed(self):
        items = [self.item()]
        while self.peek() in (",", ";"):
            self.take()
            items.append(self.item())
        return items[0] if len(items) == 1 else Group("", "", tuple(items))

    def item(self):
        return self.bracketed() or self.related()

    def bracketed(self):
        """A tuple, interval, set or matrix from here, if it is one that ends the item."""
        t, back = self.peek(), self.at
        if t == "begin":
            return self.matrix()
        if t not in ("(", "[", "\\{"):
            return None
        self.take()
        try:
            items = [self.item()]
            while self.peek() in (",", ";"):
                self.take()
                items.append(self.item())
            close = self.take()
        except Unreadable:
            close = ""
        if close in (")", "]", "\\}") and (len(items) > 1 or t == "\\{") and self.peek() in ("", ",", ";", "U", ")", "]"):
            return Group(t, close, tuple(items))
        self.at = back
        return None

    def matrix(self) -> Group:
        name = self._environment("begin")
        rows, row = [], []
        while True:
            row.append(self.related())
            t = self.take()
            if t == "&":
                continue
            if t in ("\\\\", "end"):
                rows.append(Group("row", "row", tuple(row)))
                row = []
            if t == "end":
                self.at -= 1
                if self._environment("end") != name:
                    raise Unreadable(name)
                return Group("matrix", "matrix", tuple(rows))
            if t != "\\\\":
                raise Unreadable(t)

    def _environment(self, command: str) -> str:
        self.take(command)
        self.take("{")
        out = ""
        while self.peek() != "}":
            out += self.take().strip('"')
        self.take("}")
        return out

    def related(self):
        left = self.sum()
        if self.peek() not in ("=", "<", ">", "<=", ">=", "!="):
            return left
        sign, right = self.take(), self.sum()
        if sign == "=" and left.under == ONE and list(left.over.values()) == [1] and [e for _, e in next(iter(left.over))] == [1]:
            # ``x = 5`` answers what 5 does.
            return right
        if sign in (">", ">="):
            return Relation(sign.replace(">", "<"), right, left)
        return Relation(sign, left, right)

    def sum(self) -> Quotient:
        out = self.product()
        while self.peek() in ("+", "-", "+-"):
            sign = self.take()
            more = self.product()
            out = self.f.plus(out, self.f.times(Quotient({(("+-", Fraction(1)),): Fraction(1)}, ONE), more) if sign == "+-" else more, -1 if sign == "-" else 1)
        return out

    def product(self) -> Quotient:
        out, before = self.signed(), self.found[self.at - 1]
        while (t := self.peek()) and t not in ("+", "-", "+-", ")", "]", "}", "\\}", ",", ";", "&", "\\\\", "end", "U", "=", "<", ">", "<=", ">=", "!=", "|", ":"):
            if t in ("*", "/"):
                self.take()
                more = self.signed()
                out = self.f.times(out, self.f.inverse(more) if t == "/" else more)
            elif t == " " or t == "frac" and before.isdigit() and self._mixed():
                # 7 3/4 and 7\frac{3}{4} are sums.
                if t == " ":
                    self.take()
                more = self.signed()
                if t == " ":
                    self.take("/")
                    more = self.f.times(more, self.f.inverse(self.power()))
                out = self.f.plus(out, more, -1 if out.over.get((), 0) < 0 else 1)
            else:
                out = self.f.times(out, self.power())
            before = self.found[self.at - 1]
        return out

    def _mixed(self) -> bool:
        """Whether a fraction of two whole numbers is next."""
        return re.fullmatch(r"frac ?(?:\{ \d+ \}|\d) ?(?:\{ \d+ \}|\d).*|frac \d\d.*", " ".join(self.found[self.at : self.at + 7])) is not None

    def signed(self) -> Quotient:
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise Unreadable("too deep")
        sign = 1
        while self.peek() in ("+", "-"):
            sign = -sign if self.take() == "-" else sign
        out = self.f.times(Quotient({(("+-", Fraction(1)),): Fraction(1)}, ONE), self.signed()) if self.peek() == "+-" and self.take() else self.power()
        self.depth -= 1
        return out if sign > 0 else self.f.plus(Quotient({}, ONE), out, -1)

    def power(self) -> Quotient:
        base = self.atom()
        while self.peek() == "!":
            self.take()
            base = self.f.function("factorial", base)
        if self.peek() == "^":
            self.take()
            return self.f.power(base, self.signed())
        return base

    def group(self) -> Quotient:
        close = self.CLOSED[self.take()]
        out = self.sum()
        self.take(close)
        return out

    def argument(self) -> Quotient:
        """What ``\\frac`` or ``\\sqrt`` take: a group, or one digit or letter."""
        t = self.peek()
        if t in self.CLOSED:
            return self.group()
        if len(t) > 1 and t.isdigit():
            # Of ``\frac34`` each takes a digit.
            self.found[self.at : self.at + 1] = [t[0], t[1:]]
        return self.atom()

    def atom(self) -> Quotient:
        t = self.peek()
        if t in self.CLOSED:
            return self.group()
        self.take()
        if t[0].isdigit() or t[0] == "." and len(t) > 1:
            if len(t) > MOST_DIGITS:
                raise Unreadable("too large")
            return Quotient({(): Fraction(t)} if Fraction(t) else {}, ONE)
        if t == "frac":
            top = self.argument()
            return self.f.times(top, self.f.inverse(self.argument()))
        if t == "sqrt":
            degree = Quotient({(): Fraction(2)}, ONE)
            if self.peek() == "[":
                degree = self.group()
            return self.f.power(self.argument(), self.f.inverse(degree))
        if t in _FUNCTIONS:
            return self.called(t)
        if t == "|":
            out = self.f.function("abs", self.sum())
            self.take("|")
            return out
        if t[0] == '"' or t.isalpha() and (len(t) == 1 or t in ("pi", "inf") or t in _GREEK):
            name = t
            if self.peek() == "_":
                self.take()
                name = f"{t}_{_key(self.argument().over)}"
            return self.f._unknown(name)
        raise Unreadable(t)

    def called(self, name: str) -> Quotient:
        raised = None
        while self.peek() in ("_", "^"):
            if self.take() == "_":
                name = f"{name}_{_key(self.argument().over)}"
            else:
                raised = self.argument()
        if self.peek() == "(":
            inner = self.group()
        else:
            inner = self.power()
            while self.peek() and (self.peek()[0].isalnum() and self.peek() not in _FUNCTIONS and self.peek() not in ("frac", "sqrt", "U", "end")):
                inner = self.f.times(inner, self.power())
        out = self.f.function(name, inner)
        return out if raised is None else self.f.power(out, raised)


def _bare(found: list[str]) -> list[str]:
    """Tokens without ``x =`` before them or braces around them."""
    if len(found) > 2 and found[1] == "=" and found[0].isalpha():
        found = found[2:]
    depth, ends = 0, []
    for i, t in enumerate(found):
        depth += (t == "{") - (t == "}")
        if not depth:
            ends.append(i)
    return _bare(found[1:-1]) if found[:1] == ["{"] and ends[:1] == [len(found) - 1] else found


def _written(found: list[str]) -> tuple | None:
    """An integer, or a fraction of integers, as it is written."""
    text = "".join(found)
    m = re.fullmatch(r"([-+]*)(\d+)(?:\.0*)?", text)
    if m:
        return ("whole",)
    m = re.fullmatch(r"(-?)(?:frac\{(-?\d+)\}\{(-?\d+)\}|frac(\d)(\d)|(\d+)/(\d+))", text)
    return ("fraction", m[1], *[int(x) for x in m.groups()[1:] if x]) if m else None


def _pieces(found: list[str]) -> list[list[str]]:
    """Tokens of the items of a flat list, tuple or interval."""
    inner = found[1:-1] if found[:1] and found[0] in ("(", "[") and found[-1] in (")", "]") and not {"(", "[", ")", "]"} & set(found[1:-1]) else found
    out: list[list[str]] = [[]]
    for t in inner:
        if t == ",":
            out.append([])
        else:
            out[-1].append(t)
    return out


def _same(f: Formulas, a, b) -> bool:
    if isinstance(a, Group) and isinstance(b, Group):
        if (a.open, a.close, len(a.items)) != (b.open, b.close, len(b.items)):
            return False
        if a.open != "\\{":
            return all(_same(f, x, y) for x, y in zip(a.items, b.items, strict=True))
        # A set's items come in any order.
        left = list(b.items)
        for x in a.items:
            at = next((i for i, y in enumerate(left) if _same(f, x, y)), None)
            if at is None:
                return False
            left.pop(at)
        return True
    if isinstance(a, Relation) and isinstance(b, Relation):
        both = a.sign == b.sign and f.equal(a.left, b.left) and f.equal(a.right, b.right)
        return both or a.sign == b.sign and a.sign in ("=", "!=") and f.equal(a.left, b.right) and f.equal(a.right, b.left)
    return isinstance(a, Quotient) and isinstance(b, Quotient) and f.equal(a, b)


def same_value(a: str, b: str) -> bool:
    """Whether two answers are equal as formulas; False for what can't be read."""
    f = Formulas()
    try:
        return _same(f, Grammar(tokens(a), f).answer(), Grammar(tokens(b), f).answer())
    except (Unreadable, RecursionError, OverflowError, ZeroDivisionError):
        return False


def graded_equal(given: str | None, truth: str | None, lenient: bool = False) -> bool:
    """Whether an answer is the truth: the same tokens, or equal as a formula. Null and an empty answer are never right.

    Unless ``lenient``, the answer must also be written as the truth is where that is a whole number (5.0 is one) or a
    fraction of whole numbers (2/4 is not 1/2), item by item of a list.
    """
    if given is None or truth is None:
        return False
    a, t = _bare(tokens(given)), _bare(tokens(truth))
    if not a or not t:
        return False
    if a == t:
        return True
    if not lenient:
        for x, y in zip(_pieces(a), _pieces(t)):
            p, q = _written(x), _written(y)
            if (p == ("whole",)) != (q == ("whole",)) or (p and q and p[0] == q[0] == "fraction" and p != q):
                return False
    return same_value(given, truth)


def boxed(text: str) -> str | None:
    """What the last ``\\boxed`` or ``\\fbox`` of a text holds."""
    from rillflow.functions.mathtext import last_boxed, unboxed

    return unboxed(last_boxed(text))


def graded_any(answer: str | None, golds: list[str | None] | None, lenient: bool = True) -> bool:
    """Whether an answer equals any of several truths; of a truth with a box, what it holds counts."""
    return any(g is not None and graded_equal(answer, boxed(g) if "\\boxed" in g else g, lenient) for g in (golds if golds is not None else []))


def boxed_reward(reply: str | None, golds: list[str | None] | None, lenient: bool = True) -> dict:
    """``formatted``: the reply has a box; ``correct``: what it holds equals any of the truths."""
    answer = boxed(reply) if reply and "\\boxed" in reply else None
    return {"formatted": answer is not None, "correct": answer is not None and graded_any(answer, golds, lenient)}


def tagged_reward(reply: str | None, golds: list[str | None] | None, lenient: bool = True) -> dict:
    """``formatted``: thoughts end and one space on an ``<answer>`` begins; the last one's text, or the box in it, is graded."""
    if not reply or "</think> <answer>" not in reply or "</answer>" not in reply:
        return {"formatted": False, "correct": False}
    answer = reply.rpartition("<answer>")[2].replace("</answer>", "")
    if "\\boxed" in answer:
        answer = boxed(answer)
    return {"formatted": True, "correct": graded_any(answer, golds, lenient)}


_GRADED = StructType([StructField("formatted", BooleanType()), StructField("correct", BooleanType())])


@F.pandas_udf(BooleanType())
def math_graded(given: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series([graded_equal(x, y) for x, y in zip(given, truth, strict=True)], dtype=bool)


@F.pandas_udf(BooleanType())
def math_graded_lenient(given: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series([graded_equal(x, y, lenient=True) for x, y in zip(given, truth, strict=True)], dtype=bool)


@F.pandas_udf(_GRADED)
def graded_box(reply: pd.Series, golds: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([boxed_reward(x, y) for x, y in zip(reply, golds, strict=True)], columns=["formatted", "correct"])


@F.pandas_udf(_GRADED)
def graded_tag(reply: pd.Series, golds: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([tagged_reward(x, y) for x, y in zip(reply, golds, strict=True)], columns=["formatted", "correct"])
