"""Proofs of facts, assembled from supports."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Derivation:
    """``rule`` is None for base facts and where the depth limit cut the proof."""

    fact: str
    rule: str | None = None
    premises: tuple[Derivation, ...] = ()
    truncated: bool = False

    def depth(self) -> int:
        return 0 if self.rule is None else 1 + max((p.depth() for p in self.premises), default=0)

    def _lines(self, indent: int) -> list[str]:
        pad = "  " * indent
        if self.rule is None:
            return [f"{pad}{self.fact}."]
        return [f"{pad}{self.fact} by {self.rule},"] + [line for p in self.premises for line in p._lines(indent + 1)]

    def __str__(self) -> str:
        return "\n".join(self._lines(0))
