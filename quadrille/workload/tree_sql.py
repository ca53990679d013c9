"""DuckDB formulations of the tree operators, on coordinates instead of codes."""

from __future__ import annotations

from quadrille.grid import Grid
from quadrille.workload.inputs import Points


def enc(grid: Grid, level: str | None = "level", prefix: str = "") -> str:
    """Interleaved code by a loop over bits; ``level`` scales cell coordinates first."""
    up = f"({grid.max_level} - {prefix}{level})" if level else "0"
    terms = " | ".join(f"(((({prefix}{a} << {up}) >> i) & 1) << ({grid.dim} * i + {k}))"
                       for k, a in enumerate(grid.axes))
    return (f"CAST(coalesce(list_sum(list_transform(range({grid.max_level}), lambda i: {terms})), 0) "
            "AS BIGINT)")


def _xyz(grid: Grid, template: str) -> str:
    return ", ".join(template.format(a=a) for a in grid.axes)


def _same(grid: Grid, left: str, right: str, shift: str = "0") -> str:
    return " AND ".join(f"{left}.{a} = {right}.{a} >> ({shift})" for a in grid.axes)


def stencil(grid: Grid, with_zero: bool = False) -> str:
    rows = [tuple([0] * grid.dim)] * with_zero + grid.stencil
    values = ", ".join("(" + ", ".join(map(str, (i, *r))) + ")" for i, r in enumerate(rows))
    return f"(VALUES {values}) AS st(dir, {', '.join('d' + a for a in grid.axes)})"


def _inside(grid: Grid, level: str, table: str) -> str:
    return " AND ".join(f"{table}.{a} + d{a} >= 0 AND {table}.{a} + d{a} < (1 << {level})"
                        for a in grid.axes)


def crowded(p: Points) -> str:
    """CTE ``split0``: cells above the deepest level with more points than the capacity."""
    g = p.grid
    up = _xyz(g, f"{{a}} >> ({g.max_level} - level) AS {{a}}")
    keys = ", ".join(str(i + 2) for i in range(g.dim))
    return (f"pts AS ({p.duck}), levels AS (SELECT CAST(range AS INT) AS level FROM range({g.max_level})), "
            f"split0 AS (SELECT level, {up} FROM pts, levels GROUP BY 1, {keys} "
            f"HAVING count(*) > {p.capacity})")


def leaves(grid: Grid, split: str, name: str) -> str:
    """CTE with the leaves ``(level, x, y[, z], code)`` of the tree split at ``split``."""
    bits = "(VALUES (0), (1))"
    factors = ", ".join(f"{bits} AS bit_{a}(o{a})" for a in grid.axes)
    kids = _xyz(grid, "2 * s.{a} + o{a} AS {a}")
    root = ", ".join(f"0 AS {a}" for a in grid.axes)
    match = " AND ".join(f"i.{a} = k.{a}" for a in grid.axes)
    return (f"{name}_k AS (SELECT level + 1 AS level, {kids} FROM {split} s, {factors} "
            f"UNION ALL SELECT 0, {root} WHERE NOT EXISTS (SELECT 1 FROM {split})), "
            f"{name} AS (SELECT CAST(k.level AS INT) AS level, {_xyz(grid, 'CAST(k.{a} AS BIGINT) AS {a}')}, "
            f"{enc(grid, prefix='k.')} AS code FROM {name}_k k "
            f"WHERE NOT EXISTS (SELECT 1 FROM {split} i WHERE i.level = k.level AND {match}))")


def balanced(grid: Grid, split: str = "split0", name: str = "split1", region: bool = False) -> str:
    """Recursive CTE: split cells closed under the 2:1 rule (or its region form)."""
    if region:
        cells = _xyz(grid, "(s.{a} >> 1) + d{a} AS {a}")
        bounds = " AND ".join(f"(s.{a} >> 1) + d{a} >= 0 AND (s.{a} >> 1) + d{a} < (1 << (s.level - 1))"
                              for a in grid.axes)
    else:
        cells = _xyz(grid, "(s.{a} + d{a}) >> 1 AS {a}")
        bounds = _inside(grid, "s.level", "s")
    return (f"{name} AS (SELECT level, {_xyz(grid, '{a}')} FROM {split} UNION "
            f"SELECT s.level - 1, {cells} FROM {name} s, {stencil(grid, True)} "
            f"WHERE s.level > 0 AND {bounds})")


def tree(p: Points, balance: bool = False, region: bool = False) -> str:
    """``WITH`` clause ending in ``leaves``."""
    parts = [crowded(p)]
    if balance or region:
        parts.append(balanced(p.grid, region=region))
    parts.append(leaves(p.grid, "split1" if balance or region else "split0", "leaves"))
    return "WITH RECURSIVE " + ", ".join(parts)


def end(grid: Grid, table: str = "l") -> str:
    """Inclusive end of a leaf's code range."""
    return f"({table}.code + (1::BIGINT << ({grid.dim} * ({grid.max_level} - {table}.level))) - 1)"


def neighbours(grid: Grid, source: str = "leaves", extra: str = "") -> str:
    """CTE ``nb``: same-size neighbour cells with their code and end."""
    cells = _xyz(grid, "l.{a} + d{a} AS {a}")
    return (f"nb0 AS (SELECT l.code AS lcode, l.level, st.dir AS dir, {cells}{extra} "
            f"FROM {source} l, {stencil(grid)} WHERE l.level > 0 AND {_inside(grid, 'l.level', 'l')}), "
            f"nb AS (SELECT *, {enc(grid)} AS n_code, {enc(grid)} + (1::BIGINT << ({grid.dim} * "
            f"({grid.max_level} - level))) - 1 AS n_end FROM nb0)")


def too_coarse(grid: Grid) -> str:
    """CTE ``bad``: (leaf, direction) pairs whose neighbour lies in a leaf two levels coarser."""
    return (neighbours(grid) + ", bad AS (SELECT c.code, c.level FROM nb JOIN leaves c "
            f"ON c.level < nb.level - 1 AND {_same(grid, 'c', 'nb', 'nb.level - c.level')})")


def ripple(grid: Grid) -> str:
    """Recursive CTE ``rip(pass, level, x, ...)``: the whole tree after each pass that splits every leaf found too coarse."""
    at, keys = _xyz(grid, "{a}"), "level, " + _xyz(grid, "{a}")
    moved = _xyz(grid, "n.{a} + d{a} AS {a}")
    up = _xyz(grid, "nb.{a} >> (nb.level - v.level) AS {a}")
    kids = _xyz(grid, "2 * b.{a} + o{a}")
    factors = ", ".join(f"(VALUES (0), (1)) AS bit_{a}(o{a})" for a in grid.axes)
    bad = (f"SELECT {keys} FROM rip SEMI JOIN (SELECT CAST(v.level AS INT) AS level, {up} FROM (SELECT n.level, {moved} FROM rip n, {stencil(grid)} "
           f"WHERE n.level > 1 AND {_inside(grid, 'n.level', 'n')}) nb JOIN (SELECT range AS level FROM range({grid.max_level})) v ON v.level < nb.level - 1) asked "
           f"USING ({keys})")
    now = "(SELECT max(pass) + 1 FROM rip)"
    return (f"rip AS (SELECT 0 AS pass, level, {at} FROM leaves UNION ALL (SELECT {now}, {keys} FROM rip ANTI JOIN ({bad}) b USING ({keys}) "
            f"WHERE EXISTS ({bad}) UNION ALL SELECT {now}, CAST(b.level + 1 AS INT), {kids} FROM ({bad}) b, {factors}))")


def measured(p: Points, sums: str, rule: str) -> str:
    """``WITH`` clause ending in ``leaves``: cells split from the root down while ``rule`` over ``sums`` of their points holds."""
    g = p.grid
    keys, up = _xyz(g, "{a}"), _xyz(g, f"{{a}} >> ({g.max_level} - level) AS {{a}}")
    below = " AND ".join(f"c.{a} >> 1 = s.{a}" for a in g.axes)
    return (f"WITH RECURSIVE pts AS ({p.duck}), levels AS (SELECT CAST(range AS INT) AS level FROM range({g.max_level})), "
            f"ms AS MATERIALIZED (SELECT level, {up}, {sums} FROM pts, levels GROUP BY level, {', '.join(str(i + 2) for i in range(g.dim))}), "
            f"ok AS MATERIALIZED (SELECT level, {keys} FROM ms WHERE {rule}), "
            f"split0 AS (SELECT level, {keys} FROM ok WHERE level = 0 UNION ALL SELECT c.level, {_xyz(g, 'c.{a}')} FROM split0 s JOIN ok c "
            f"ON c.level = s.level + 1 AND {below}), " + leaves(g, "split0", "leaves"))
