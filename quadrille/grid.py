"""The integer grid a tree lives on: its dimension and its deepest level."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

# Deepest level whose interleaved codes stay below 2**63, per dimension.
MAX_LEVEL_LIMIT = {2: 31, 3: 21}


def max_level_limit(dim: int) -> int:
    return MAX_LEVEL_LIMIT[dim]


@dataclass(frozen=True)
class Grid:
    dim: int
    max_level: int

    def __post_init__(self) -> None:
        if self.dim not in MAX_LEVEL_LIMIT:
            raise ValueError(f"dim must be 2 or 3, got {self.dim}")
        if not 0 <= self.max_level <= MAX_LEVEL_LIMIT[self.dim]:
            raise ValueError(
                f"max_level must be in [0, {MAX_LEVEL_LIMIT[self.dim]}], got {self.max_level}"
            )

    @property
    def children(self) -> int:
        return 1 << self.dim

    @property
    def full_mask(self) -> int:
        """Bit mask of a complete family of children."""
        return (1 << self.children) - 1

    @property
    def bits(self) -> int:
        return self.dim * self.max_level

    @property
    def last_code(self) -> int:
        return (1 << self.bits) - 1

    @property
    def width(self) -> int:
        return 1 << self.max_level

    @property
    def axes(self) -> tuple[str, ...]:
        return ("x", "y", "z")[: self.dim]

    @property
    def stencil(self) -> list[tuple[int, ...]]:
        """Directions the 2:1 rule covers: faces in 2D, faces and edges in 3D."""
        return [
            d
            for d in product((-1, 0, 1), repeat=self.dim)
            if 1 <= sum(map(abs, d)) <= self.dim - 1
        ]
