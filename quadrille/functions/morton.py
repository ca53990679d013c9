"""Z-order codes as SQL expressions.

Every function takes and returns SQL text made of built-in bit operators, ready
for ``selectExpr`` or ``F.expr``: whole expressions compile into generated code
and nothing calls Python per row.  ``code`` stands for any BIGINT expression,
``level`` for an INT expression or a Python int (which folds all masks into
literals).  A missing neighbour is NULL.
"""

from __future__ import annotations

from functools import reduce

from quadrille.grid import Grid

_WIDTH = {2: 32, 3: 21}


def _groups_mask(dim: int, group: int) -> int:
    """Where the bits of a coordinate sit once split in ``group``-bit runs."""
    mask = 0
    for i in range(_WIDTH[dim]):
        pos = (i // group) * group * dim + i % group
        if pos < 63:
            mask |= 1 << pos
    return mask


def _rounds(bits: int) -> list[int]:
    """Run lengths a ``bits``-wide coordinate passes through, widest first."""
    return [g for g in (16, 8, 4, 2, 1) if g < bits]


def spread(value: str, dim: int, bits: int | None = None) -> str:
    """Move bit ``i`` to bit ``i * dim``."""
    bits = bits or _WIDTH[dim]
    out = f"(CAST({value} AS BIGINT) & {(1 << bits) - 1}L)"
    for g in _rounds(bits):
        out = f"(({out} | shiftleft({out}, {(dim - 1) * g})) & {_groups_mask(dim, g)}L)"
    return out


def compact(value: str, dim: int, bits: int | None = None) -> str:
    """Inverse of :func:`spread`; other bits are dropped."""
    bits = bits or _WIDTH[dim]
    out = f"({value} & {_groups_mask(dim, 1)}L)"
    for g in reversed(_rounds(bits)):
        out = f"(({out} | shiftright({out}, {(dim - 1) * g})) & {_groups_mask(dim, 2 * g)}L)"
    return out


def encode(coords: list[str] | tuple[str, ...], bits: int | None = None) -> str:
    """Interleave coordinates, first one fastest."""
    dim = len(coords)
    parts = [f"shiftleft({spread(c, dim, bits)}, {a})" for a, c in enumerate(coords)]
    return reduce(lambda a, b: f"({a} | {b})", parts)


def decode(code: str, dim: int, bits: int | None = None) -> list[str]:
    return [compact(f"shiftright({code}, {a})", dim, bits) for a in range(dim)]


def corner(code: str, grid: Grid) -> list[str]:
    """Coordinates of a cell of ``grid``."""
    return decode(code, grid.dim, max(grid.max_level, 1))


def below(level: str | int, grid: Grid) -> str | int:
    """Number of code bits below ``level``."""
    if isinstance(level, int):
        return grid.dim * (grid.max_level - level)
    return f"(({grid.max_level} - ({level})) * {grid.dim})"


def _bits_from(n: str | int) -> str:
    """All ones but for the ``n`` lowest bits; never overflows, unlike ``2**n - 1``."""
    return f"{-1 << n}L" if isinstance(n, int) and n < 63 else f"shiftleft(-1L, {n})"


def ancestor(code: str, level: str | int, grid: Grid) -> str:
    """Code of the cell at ``level`` that holds ``code``."""
    return f"({code} & {_bits_from(below(level, grid))})"


def child(code: str, level: str | int, k: int, grid: Grid) -> str:
    if not k:
        return code
    if isinstance(level, int):
        return f"({code} | {k << below(level + 1, grid)}L)"
    return f"({code} | shiftleft({k}L, {below(f'{level} + 1', grid)}))"


def child_index(code: str, level: str | int, grid: Grid) -> str:
    """Position of a cell at ``level`` among its siblings."""
    return f"CAST(shiftright({code}, {below(level, grid)}) & {grid.children - 1}L AS INT)"


def child_bit(code: str, level: str | int, grid: Grid) -> str:
    return f"shiftleft(1, {child_index(code, level, grid)})"


def last_code(code: str, level: str | int, grid: Grid) -> str:
    """Inclusive end of a cell's code range."""
    return f"({code} | ~{_bits_from(below(level, grid))})"


def size(level: str, grid: Grid) -> str:
    return f"shiftleft(1L, {grid.max_level} - {level})"


def volume(level: str, grid: Grid) -> str:
    """Share of the domain a cell covers; a power of two, so exact."""
    return f"pow(2.0D, -{grid.dim}.0D * {level})"


def move(code: str, level: str | int, axis: int, sign: int, grid: Grid) -> str:
    """Cell next to ``code`` along one axis at the same level, NULL beyond the domain.

    The other axes' bits are filled with ones (or left out) so that the carry
    (or borrow) of a plain addition runs through this axis' bits alone.
    """
    mask = sum(1 << b for b in range(axis, 63, grid.dim))
    low = below(level, grid)
    if isinstance(low, int):
        one = f"{1 << (low + axis)}L"
        top = f"{mask & grid.last_code & (-1 << low)}L"
    else:
        one = f"shiftleft(1L, {low} + {axis})"
        top = f"({mask & grid.last_code}L & shiftleft(-1L, {low}))"
    here, rest = f"({code} & {mask}L)", f"({code} & {~mask}L)"
    if sign > 0:
        return f"IF({here} = {top}, NULL, ((({code} | {~mask}L) + {one}) & {mask}L) | {rest})"
    return f"IF({here} < {one}, NULL, (({here} - {one}) & {mask}L) | {rest})"


def neighbour(code: str, level: str | int, direction: tuple[int, ...], grid: Grid) -> str:
    """Same-level cell in ``direction``; NULL outside the domain or for a bad level."""
    out = code
    for axis, sign in enumerate(direction):
        if sign:
            out = move(out, level, axis, sign, grid)
    if not any(direction):
        return out
    return f"IF({level} > 0 AND {level} <= {grid.max_level}, {out}, NULL)"
