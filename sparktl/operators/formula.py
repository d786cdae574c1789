"""Temporal formulas as Python values: ``atom(gt("x", 5)).eventually(0, 10).always(0, 100)``.

A formula holds margin columns at its leaves. ``&``, ``|``, ``~`` and ``>>`` are and, or, not, implies.
Intervals are closed, in the units of the trace's time, and may end at infinity.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column

from sparktl.functions.margins import Term

INF = float("inf")
UNARY = ("always", "eventually", "historically", "once")


@dataclass(frozen=True, eq=False)
class Formula:
    kind: str
    parts: tuple[Formula, ...] = ()
    margin: Column | Term | None = None
    low: float = 0.0
    high: float = INF

    def __post_init__(self):
        if not (0 <= self.low < INF and self.low <= self.high):
            raise ValueError(f"not an interval: [{self.low}, {self.high}]")

    def __and__(self, other: Formula) -> Formula:
        return Formula("and", (self, other))

    def __or__(self, other: Formula) -> Formula:
        return Formula("or", (self, other))

    def __invert__(self) -> Formula:
        return Formula("not", (self,))

    def __rshift__(self, other: Formula) -> Formula:
        return Formula("implies", (self, other))

    def always(self, low: float = 0, high: float = INF) -> Formula:
        return Formula("always", (self,), None, float(low), float(high))

    def eventually(self, low: float = 0, high: float = INF) -> Formula:
        return Formula("eventually", (self,), None, float(low), float(high))

    def historically(self, low: float = 0, high: float = INF) -> Formula:
        return Formula("historically", (self,), None, float(low), float(high))

    def once(self, low: float = 0, high: float = INF) -> Formula:
        return Formula("once", (self,), None, float(low), float(high))

    def until(self, other: Formula, low: float = 0, high: float = INF) -> Formula:
        return Formula("until", (self, other), None, float(low), float(high))

    def since(self, other: Formula, low: float = 0, high: float = INF) -> Formula:
        return Formula("since", (self, other), None, float(low), float(high))

    def next(self) -> Formula:
        return Formula("next", (self,))

    def depth(self) -> int:
        return 1 + max((p.depth() for p in self.parts), default=0)

    def has_temporal(self) -> bool:
        return self.kind in (*UNARY, "until", "since", "next") or any(p.has_temporal() for p in self.parts)

    def atoms(self) -> list[Formula]:
        return [self] if self.kind == "atom" else [a for p in self.parts for a in p.atoms()]

    def variables(self) -> set[str]:
        """The names of the signals that it reads; its margins are to be Terms."""
        if not all(isinstance(a.margin, Term) for a in self.atoms()):
            raise ValueError("a margin that is a Column does not tell its signals; make it of names and signal()")
        return {name for a in self.atoms() for name in a.margin.signals}

    def expect(self, columns: list[str]) -> None:
        """Raises for signals that are none of the columns."""
        missing = {name for a in self.atoms() if isinstance(a.margin, Term) for name in a.margin.signals} - set(columns)
        if missing:
            raise ValueError(f"no such signal: {', '.join(sorted(missing))}")

    def horizon(self) -> float:
        """How far after a sample its value looks; infinite for unbounded future operators and next."""
        own = self.high if self.kind in ("always", "eventually", "until") else INF if self.kind == "next" else 0.0
        return own + max((p.horizon() for p in self.parts), default=0.0)

    def memory(self) -> float:
        """How far before a sample its value looks."""
        own = self.high if self.kind in ("historically", "once", "since") else 0.0
        return own + max((p.memory() for p in self.parts), default=0.0)


def atom(margin: Column | Term) -> Formula:
    return Formula("atom", margin=margin)
