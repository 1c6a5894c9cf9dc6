"""Whether two formulas are the same: exact arithmetic on polynomials over the rationals, with roots.

A formula is read into a small tree and computed twice at most: exactly, as a quotient of
polynomials whose generators are variables, constants, roots (whose powers reduce) and calls;
and, where a generator is opaque or nothing has a variable, in complex numbers at a few points.
Formulas of more than ``MOST`` characters, terms or powers are not read: they are the same as
text or not at all.
"""

from __future__ import annotations

import cmath
import functools
import math
import re
from fractions import Fraction

#: Bounds of what is computed exactly: characters of a formula, terms of a polynomial, a power, a root's trial divisor.
MOST, TERMS, POWER, DIVISOR = 1000, 600, 64, 100_000
TOLERANCE = 1e-4

_FUNCTIONS = {"sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "cot": lambda z: 1 / cmath.tan(z), "sec": lambda z: 1 / cmath.cos(z), "csc": lambda z: 1 / cmath.sin(z), "log": cmath.log, "ln": cmath.log, "exp": cmath.exp, "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan, "sinh": cmath.sinh, "cosh": cmath.cosh, "tanh": cmath.tanh}
_TOKEN = re.compile(r"\d+(?:\.\d+)?|\.\d+|\\[A-Za-z]+|[A-Za-z]+|\*\*|[^\sA-Za-z0-9]")
#: LaTeX and signs that are read as others.
_READ = [(r"\\left|\\right|\\displaystyle|\\[,;!: ]|~|\\quad", " "), (r"\\[dt]frac", r"\\frac"), (r"\\cdot|\\times|×|·|⋅", "*"), (r"\\div|÷", "/"), (r"−|–", "-"), (r"π", r"\\pi "), (r"√", r"\\sqrt "), (r"∞", r"\\infty "), (r"\\(?:operatorname|mathrm|text|mbox)\{(\w+)\}", r"\1"), (r"\^\{?\\circ\}?|°", ""), (r"(\d)\s*(?=\\frac)", r"\1+"), (r"(\d) +(?=\d)", r"\1+"), (r"(?<=\d)\{,\}(?=\d{3})|(?<=\d),(?=\d{3}(?!\d))", "")]


class Unreadable(ValueError):
    """A formula, or a step with it, that is not computed."""


# Trees: ("num", Fraction), ("sym", name), ("+" | "*" | "/" | "^", a, b), ("root", degree, a), ("call", name, a), ("abs" | "!", a).


class _Reader:
    """Recursive descent over LaTeX or plain formulas."""

    def __init__(self, text: str):
        for pattern, new in _READ:
            text = re.sub(pattern, new, text)
        if len(text) > MOST:
            raise Unreadable("too long")
        self.tokens, self.at = _TOKEN.findall(text), 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def next(self) -> str:
        if self.at >= len(self.tokens):
            raise Unreadable("ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def expect(self, token: str) -> None:
        if self.next() != token:
            raise Unreadable(f"no {token}")

    def whole(self):
        found = self.sum()
        if self.peek() is not None:
            raise Unreadable(f"{self.peek()} left over")
        return found

    def sum(self):
        found = self.product()
        while self.peek() in ("+", "-"):
            sign, other = self.next(), self.product()
            found = ("+", found, other if sign == "+" else ("*", ("num", Fraction(-1)), other))
        return found

    def product(self):
        found = self.signed()
        while (token := self.peek()) is not None and token not in ("+", "-", ")", "}", "]", "|", ",", "=", "&"):
            if token in ("*", "/"):
                self.next()
                found = (token, found, self.signed())
            else:
                found = ("*", found, self.power())
        return found

    def signed(self):
        if self.peek() in ("+", "-"):
            return self.signed() if self.next() == "+" else ("*", ("num", Fraction(-1)), self.signed())
        return self.power()

    def power(self):
        found = self.single()
        while self.peek() == "!":
            self.next()
            found = ("!", found)
        if self.peek() in ("^", "**"):
            self.next()
            sign = self.next() if self.peek() in ("+", "-") else "+"
            other = self.power()
            found = ("^", found, other if sign == "+" else ("*", ("num", Fraction(-1)), other))
        return found

    def argument(self):
        """One group in braces or, after a command, one digit or letter."""
        if self.peek() == "{":
            return self.single()
        token = self.next()
        if token[0].isalnum() and len(token) > 1:
            self.tokens[self.at - 1 : self.at] = [token[0], token[1:]]
            token = token[0]
        self.at -= 1
        return self.single()

    def single(self):
        token = self.next()
        if token[0].isdigit() or token[0] == ".":
            return ("num", Fraction(token))
        if token in ("(", "{", "["):
            found = self.sum()
            self.expect({"(": ")", "{": "}", "[": "]"}[token])
            return found
        if token == "|":
            found = self.sum()
            self.expect("|")
            return ("abs", found)
        name = token.lstrip("\\")
        if token == "\\frac":
            return ("/", self.argument(), self.argument())
        if name == "sqrt":
            degree = 2
            if self.peek() == "[":
                self.next()
                degree = int(self.next()) if self.peek() and self.peek().isdigit() else 0
                self.expect("]")
            if not 1 < degree <= POWER:
                raise Unreadable("degree of a root")
            return ("root", degree, self.single() if self.peek() == "(" else self.argument())
        if name in _FUNCTIONS:
            power = None
            if self.peek() == "^":  # sin^2 x
                self.next()
                power = self.argument()
            inner = self.single() if self.peek() in ("(", "{") else self.signed()
            return ("call", name, inner) if power is None else ("^", ("call", name, inner), power)
        if token in ("\\infty", "inf", "oo"):
            return ("sym", "infinity")
        if token == "\\pi" or name == "pi":
            return ("sym", "pi")
        if token[0] == "\\" and len(token) > 2:
            return ("sym", name)
        if token.isalpha():
            if len(token) > 2:
                return ("sym", token)
            letters = [("sym", c) for c in token]
            return functools.reduce(lambda a, b: ("*", a, b), letters)
        raise Unreadable(f"{token} means nothing here")


# Polynomials: {((generator, power), ...) in order of generators: coefficient}.


def _plus(a: dict, b: dict, times: int = 1) -> dict:
    out = dict(a)
    for m, c in b.items():
        out[m] = out.get(m, 0) + times * c
        if not out[m]:
            del out[m]
    return out


def _name(p: dict) -> str:
    return " ".join(f"{c}*{m}" for m, c in sorted(p.items(), key=repr))


class _Field:
    """Quotients of polynomials; roots are generators that know what a power of them is."""

    def __init__(self):
        self.roots: dict[str, tuple[int, dict]] = {"i": (2, {(): Fraction(-1)})}
        self.opaque = False

    def times(self, a: dict, b: dict) -> dict:
        if len(a) * len(b) > TERMS * 8:
            raise Unreadable("too many terms")
        out: dict = {}
        for m, c in a.items():
            for n, d in b.items():
                powers = dict(m)
                for g, e in n:
                    powers[g] = powers.get(g, 0) + e
                if max(powers.values(), default=0) > POWER:
                    raise Unreadable("too high a power")
                term, extra = {tuple(sorted((g, e % self.roots[g][0] if g in self.roots else e) for g, e in powers.items() if g not in self.roots or e % self.roots[g][0])): c * d}, []
                for g, e in powers.items():
                    if g in self.roots:
                        extra += [self.roots[g][1]] * (e // self.roots[g][0])
                for p in extra:
                    term = self.times(term, p)
                out = _plus(out, term)
        if len(out) > TERMS:
            raise Unreadable("too many terms")
        return out

    def symbol(self, name: str) -> tuple[dict, dict]:
        return {((name, 1),): Fraction(1)}, {(): Fraction(1)}

    def power(self, base: tuple[dict, dict], n: int) -> tuple[dict, dict]:
        if abs(n) > POWER:
            raise Unreadable("too high a power")
        num, den = base if n >= 0 else base[::-1]
        out = ({(): Fraction(1)}, {(): Fraction(1)})
        for _ in range(abs(n)):
            out = self.times(out[0], num), self.times(out[1], den)
        if not out[1]:
            raise Unreadable("division by zero")
        return out

    def _whole_root(self, value: Fraction, degree: int) -> dict:
        """A root of a rational number as rational times roots of primes."""
        number, out = value.numerator * value.denominator ** (degree - 1), {(): Fraction(1, value.denominator)}
        if number < 0:
            if degree % 2 == 0 and degree > 2:
                raise Unreadable("a root of a negative number")
            out = self.times(out, {(("i", 1),): Fraction(1)} if degree == 2 else {(): Fraction(-1)})
            number = -number
        prime = 2
        while number > 1:
            if prime * prime > number:
                prime = number
            elif prime > DIVISOR:
                prime = number  # what is left counts as one factor
            times = 0
            while number % prime == 0:
                number, times = number // prime, times + 1
            if times:
                out = {m: c * prime ** (times // degree) for m, c in out.items()}
                if times % degree:
                    shared = math.gcd(times % degree, degree)
                    n, name = degree // shared, f"root{degree // shared}:{prime}"
                    self.roots[name] = (n, {(): Fraction(prime)})
                    out = self.times(out, {((name, times % degree // shared),): Fraction(1)})
            prime += 1
        return out

    def root(self, value: tuple[dict, dict], degree: int) -> tuple[dict, dict]:
        num, den = value
        if not num:
            return value
        if set(den) != {()}:
            return self.symbol_of(f"root{degree}:{_name(num)}/{_name(den)}")
        num = {m: c / den[()] for m, c in num.items()}
        size = functools.reduce(lambda a, b: Fraction(math.gcd(a.numerator * b.denominator, b.numerator * a.denominator), a.denominator * b.denominator), map(abs, num.values()))
        if set(num) == {()}:
            return self._whole_root(num[()], degree), {(): Fraction(1)}
        inner = {m: c / size for m, c in num.items()}
        name = f"root{degree}:{_name(inner)}"
        self.roots[name], self.opaque = (degree, inner), True
        return self.times(self._whole_root(size, degree), {((name, 1),): Fraction(1)}), {(): Fraction(1)}

    def symbol_of(self, name: str) -> tuple[dict, dict]:
        self.opaque = True
        return self.symbol(name)

    def key(self, value: tuple[dict, dict]) -> str:
        num, den = value
        lead = den[min(den, key=repr)]
        return f"{_name({m: c / lead for m, c in num.items()})}/{_name({m: c / lead for m, c in den.items()})}"

    def of(self, node) -> tuple[dict, dict]:
        kind = node[0]
        if kind == "num":
            return ({(): node[1]} if node[1] else {}), {(): Fraction(1)}
        if kind == "sym":
            return self.symbol(node[1])
        if kind == "root":
            return self.root(self.of(node[2]), node[1])
        a = self.of(node[-1] if kind in ("call", "abs", "!") else node[1])
        constant = lambda v: Fraction(0) if not v[0] else v[0][()] / v[1][()] if set(v[0]) == set(v[1]) == {()} else None
        if kind == "call":
            return self.symbol_of(f"{'log' if node[1] == 'ln' else node[1]}({self.key(a)})")
        if kind in ("abs", "!"):
            value = constant(a)
            if value is None:
                return self.symbol_of(f"{kind}({self.key(a)})")
            if kind == "abs":
                return self.of(("num", abs(value)))
            if value.denominator != 1 or not 0 <= value <= POWER:
                raise Unreadable("factorial")
            return self.of(("num", Fraction(math.factorial(int(value)))))
        b = self.of(node[2])
        if kind == "+":
            return _plus(self.times(a[0], b[1]), self.times(b[0], a[1])), self.times(a[1], b[1])
        if kind == "*":
            return self.times(a[0], b[0]), self.times(a[1], b[1])
        if kind == "/":
            if not b[0]:
                raise Unreadable("division by zero")
            return self.times(a[0], b[1]), self.times(a[1], b[0])
        exponent = constant(b)
        if exponent is not None and exponent.denominator == 1:
            return self.power(a, int(exponent))
        if exponent is not None and exponent.denominator <= POWER:
            return self.power(self.root(a, exponent.denominator), exponent.numerator)
        return self.symbol_of(f"({self.key(a)})^({self.key(b)})")


def _symbols(node) -> set[str]:
    return {node[1]} if node[0] == "sym" else set().union(*(_symbols(x) for x in node[1:] if isinstance(x, tuple)))


def _number(node, at: dict[str, complex]) -> complex:
    kind = node[0]
    if kind == "num":
        return complex(node[1])
    if kind == "sym":
        return at[node[1]]
    if kind == "call":
        return _FUNCTIONS[node[1]](_number(node[2], at))
    if kind == "root":
        inner = _number(node[2], at)
        if node[1] % 2 and abs(inner.imag) < 1e-12 and inner.real < 0:
            return -((-inner.real) ** (1 / node[1]))
        return inner ** (1 / node[1])
    if kind == "abs":
        return abs(_number(node[1], at))
    if kind == "!":
        return math.gamma(_number(node[1], at).real + 1)
    a, b = _number(node[1], at), _number(node[2], at)
    return a + b if kind == "+" else a * b if kind == "*" else a / b if kind == "/" else a**b


def read(text: str):
    """The tree of a formula; ``Unreadable`` where it isn't one."""
    try:
        return _Reader(text).whole()
    except (RecursionError, OverflowError, IndexError) as e:
        raise Unreadable(str(e)) from None


def same_formula(one: str, other: str, tolerance: float = TOLERANCE) -> bool:
    """Equal as quotients of polynomials, or in value: at every point for formulas with variables, within ``tolerance`` for numbers."""
    try:
        a, b = read(one), read(other)
        field = _Field()
        try:
            x, y = field.of(a), field.of(b)
            difference = _plus(field.times(x[0], y[1]), field.times(y[0], x[1]), -1)
            if not difference:
                return True
            exact = not field.opaque
        except (Unreadable, ZeroDivisionError):
            exact = False
        names = (_symbols(a) | _symbols(b)) - {"pi", "e", "i"}
        if names and exact or "infinity" in names:
            return False
        for pi in (math.pi, 3.14):
            alike = True
            for k in range(5 if names else 1):
                at = {"pi": pi, "e": math.e, "i": 1j} | {n: 0.37 + 0.61 * ((k * 7 + j * 3) % 11) for j, n in enumerate(sorted(names))}
                p, q = _number(a, at), _number(b, at)
                bound = 1e-9 * max(1, abs(p), abs(q)) if names else tolerance * max(abs(p), abs(q))
                alike = alike and abs(p - q) <= bound
            if alike:
                return True
        return False
    except (Unreadable, ZeroDivisionError, OverflowError, ValueError, RecursionError, TypeError):
        return False
