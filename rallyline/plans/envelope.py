"""Answers: rows with what a reader must know about them — coverage, exclusions, paging, minutes basis, caveats."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

DEFAULT_LIMIT, MAX_LIMIT = 50, 200
#: Columns that mean nothing without the basis of the clock or minutes they come from.
NEEDS_BASIS = frozenset({"seconds", "minutes", "seconds_remaining_raw", "mean_seconds_remaining_at_start", "elapsed_corrected"})
STRADDLE = "A possession that runs past its stint's end is credited to the units that were on the floor when it began."


class BadRequest(ValueError):
    """An argument that the query surface can't serve."""


def clamp(limit: int | None) -> int:
    if limit is None:
        return DEFAULT_LIMIT
    if limit < 1:
        raise BadRequest("limit must be at least 1")
    return min(limit, MAX_LIMIT)


@dataclass
class Answer:
    rows: list[dict[str, Any]]
    coverage: list[dict[str, Any]]
    excluded: dict[str, Any]
    offset: int = 0
    total_available: int | None = None
    basis: str | None = None
    caveats: list[str] = field(default_factory=list)
    empty_reason: str | None = None

    def as_dict(self) -> dict[str, Any]:
        named = {c for r in self.rows[:1] for c in r}
        if named & NEEDS_BASIS and not self.basis:
            raise BadRequest(f"rows with {sorted(named & NEEDS_BASIS)} need a basis")
        caveats = list(self.caveats)
        if {"offense_lineup", "straddles"} & named and STRADDLE not in caveats:
            caveats.append(STRADDLE)
        made: dict[str, Any] = {
            "coverage": self.coverage, "excluded": self.excluded, "rows": self.rows, "row_count": len(self.rows), "caveats": caveats,
        }
        if self.basis:
            made["minutes_basis"] = self.basis
        if self.total_available is not None:
            after = self.offset + len(self.rows)
            made |= {"total_available": self.total_available, "truncated": after < self.total_available}
            if made["truncated"]:
                made["next_offset"] = after
        if not self.rows and self.empty_reason:
            made["empty_result"] = self.empty_reason
        return made
