"""Formulas of propositional and modal logic: syntax trees, a parser for the prefix notation, infix printing, rewriting."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass


class FormulaError(ValueError):
    """A text that is no formula."""


@dataclass(frozen=True)
class Formula:
    @property
    def parts(self) -> tuple[Formula, ...]:
        return tuple(v for v in vars(self).values() if isinstance(v, Formula))

    def atoms(self) -> Iterator[str]:
        """Different atoms, in order of first appearance."""
        seen: dict[str, None] = {}
        stack: list[Formula] = [self]
        while stack:
            f = stack.pop()
            if isinstance(f, Var):
                seen.setdefault(f.name)
            stack += reversed(f.parts)
        return iter(seen)

    def mapped(self, rename: Callable[[str], str]) -> Formula:
        """The same formula with its atoms renamed."""
        if isinstance(self, Var):
            return Var(rename(self.name))
        return type(self)(*(p.mapped(rename) for p in self.parts))

    def is_modal(self) -> bool:
        return isinstance(self, Box | Diamond) or any(p.is_modal() for p in self.parts)


@dataclass(frozen=True)
class Var(Formula):
    name: str

    def __str__(self) -> str:
        return f'"{self.name}"'


@dataclass(frozen=True)
class Not(Formula):
    body: Formula

    def __str__(self) -> str:
        return f"!{self.body}"


@dataclass(frozen=True)
class And(Formula):
    left: Formula
    right: Formula

    def __str__(self) -> str:
        return f"({self.left} & {self.right})"


@dataclass(frozen=True)
class Or(Formula):
    left: Formula
    right: Formula

    def __str__(self) -> str:
        return f"({self.left} | {self.right})"


@dataclass(frozen=True)
class Imp(Formula):
    left: Formula
    right: Formula

    def __str__(self) -> str:
        return f"({self.left} -> {self.right})"


@dataclass(frozen=True)
class Box(Formula):
    body: Formula

    def __str__(self) -> str:
        return f"[]{self.body}"


@dataclass(frozen=True)
class Diamond(Formula):
    body: Formula

    def __str__(self) -> str:
        return f"<>{self.body}"


#: The heads of the input notation.
HEADS: dict[str, type[Formula]] = {"Var": Var, "Not": Not, "And": And, "Or": Or, "Imp": Imp, "[]": Box, "<>": Diamond}


def parse(text: str, modal: bool = True) -> Formula:
    """Reads ``(Var t)``, ``(Not f)``, ``(And f g)``, ``(Or f g)``, ``(Imp f g)``, ``([] f)`` and ``(<> f)``.

    An atom is the trimmed rest up to its closing parenthesis and may have blanks inside.  ``modal=False`` allows only the
    propositional heads.
    """
    if not text.strip():
        raise FormulaError("empty formula")
    if text.count("(") != text.count(")"):
        raise FormulaError("the numbers of opening and closing parentheses differ")
    text = text.strip()
    formula, end = _read(text, 0, modal)
    if text[end:].strip():
        raise FormulaError(f"text after the formula: {text[end:].strip()!r}")
    return formula


def _read(text: str, at: int, modal: bool) -> tuple[Formula, int]:
    while at < len(text) and text[at].isspace():
        at += 1
    if at >= len(text) or text[at] != "(":
        raise FormulaError(f"no opening parenthesis at place {at}")
    start = at + 1
    at = start
    while at < len(text) and not text[at].isspace() and text[at] not in "()":
        at += 1
    kind = HEADS.get(text[start:at])
    if kind is None or (not modal and kind in (Box, Diamond)):
        raise FormulaError(f"unknown head {text[start:at]!r}")
    if kind is Var:
        depth, end = 1, at
        while end < len(text):
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            if not depth:
                return Var(text[at:end].strip()), end + 1
            end += 1
        raise FormulaError("an atom is not closed")
    parts = []
    for _ in range(2 if kind in (And, Or, Imp) else 1):
        part, at = _read(text, at, modal)
        parts.append(part)
    while at < len(text) and text[at].isspace():
        at += 1
    if at >= len(text) or text[at] != ")":
        raise FormulaError(f"no closing parenthesis at place {at}")
    return kind(*parts), at + 1


def junction(kind: type[And] | type[Or], atoms: list[str]) -> Formula | None:
    """A left-nested conjunction or disjunction of atoms; nothing for no atoms."""
    found: Formula | None = None
    for a in atoms:
        found = Var(a) if found is None else kind(found, Var(a))
    return found
