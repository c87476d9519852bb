"""Syntax of programs: predicates, queries and rules, with a lossless printer."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Field:
    """A typed column; ``agg`` names the function that folds it over a group."""

    type: str
    agg: str | None = None

    def __str__(self) -> str:
        return self.type + (f"^{self.agg}" if self.agg else "")


@dataclass(frozen=True)
class Var:
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Const:
    """A constant: a possibly qualified name, or an expression in parentheses."""

    text: str

    def __str__(self) -> str:
        return "~" + self.text


@dataclass(frozen=True)
class Wild:
    def __str__(self) -> str:
        return "_"


Match = Var | Const | Wild


@dataclass(frozen=True)
class Predicate:
    """Ordered fields are called arg0, arg1, ...; ``named`` tells the two styles apart."""

    name: str
    fields: tuple[tuple[str, Field], ...]
    named: bool

    def __str__(self) -> str:
        if self.named:
            return f"{self.name}{{{', '.join(f'{n}: {f}' for n, f in self.fields)}}}"
        return f"{self.name}({', '.join(str(f) for _, f in self.fields)})"


@dataclass(frozen=True)
class Clause:
    """``matches`` pairs a field name (None in ordered clauses) with what it is matched to, as written."""

    predicate: str
    matches: tuple[tuple[str | None, Match], ...]
    named: bool
    circumscribed: bool = False

    def __str__(self) -> str:
        mark = "~" if self.circumscribed else ""
        if self.named:
            return f"{mark}{self.predicate}{{{', '.join(f'{n}: {m}' for n, m in self.matches)}}}"
        return f"{mark}{self.predicate}({', '.join(str(m) for _, m in self.matches)})"


@dataclass(frozen=True)
class Query:
    name: str
    body: tuple[Clause, ...]

    def __str__(self) -> str:
        return f"?{self.name}: {' & '.join(map(str, self.body))}"


@dataclass(frozen=True)
class Rule:
    name: str
    head: Clause
    body: tuple[Clause, ...]
    callback: str | None = None
    stage: int | None = None

    def __str__(self) -> str:
        stage = "" if self.stage is None else f"@{self.stage}"
        call = f" + {self.callback}" if self.callback else ""
        return f"{self.name}{stage}: {self.head} <- {' & '.join(map(str, self.body))}{call}"


@dataclass
class Program:
    predicates: list[Predicate] = field(default_factory=list)
    queries: list[Query] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)

    def __str__(self) -> str:
        return "\n".join(map(str, [*self.predicates, *self.queries, *self.rules]))
