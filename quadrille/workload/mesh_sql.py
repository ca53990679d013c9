"""DuckDB formulations of the unstructured-mesh operators for simplex meshes."""

from __future__ import annotations

from quadrille.operators.shapes import T3, T4, shape
from quadrille.operators.structured import CELL_TETS
from quadrille.workload.inputs import MESH_COLUMNS

VERTICES = {2: 3, 3: 4}
SHAPE = {2: T3, 3: T4}


def seed(dim: int, table: str, key: str) -> str:
    """CTEs ``nd0(id, x, y, z)``, ``el0(e, v)`` and an empty ``hn0(seq, node, lo, hi)``."""
    if dim == 2:
        nx, cells = MESH_COLUMNS + 1, f"(SELECT (max({key}) // {MESH_COLUMNS}) + 1 FROM {table})"
        size = f"sz AS (SELECT {nx} AS nx, {cells} + 1 AS ny)"
        nodes = ("nd0 AS (SELECT CAST(i * ny + j AS INT) AS id, CAST(i AS DOUBLE) AS x, CAST(j AS DOUBLE) AS y, "
                 "0.0::DOUBLE AS z FROM sz, range(nx) a(i), range(ny) b(j))")
        ids = ", ".join(f"(i + {dx}) * ny + j + {dy} AS {n}" for n, dx, dy in
                        (("a", 0, 0), ("b", 1, 0), ("c", 1, 1), ("d", 0, 1)))
        elements = (f"cl0 AS (SELECT i * (ny - 1) + j AS cell, (i < (nx - 1) // 2) = (j < (ny - 1) // 2) AS diag, {ids} "
                    "FROM sz, range(nx - 1) p(i), range(ny - 1) q(j)), "
                    "el0 AS (SELECT CAST(2 * cell + t AS INT) AS e, CASE WHEN diag AND t = 0 THEN [a, b, c] WHEN diag THEN [c, d, a] "
                    "WHEN t = 0 THEN [a, b, d] ELSE [b, c, d] END AS v FROM cl0, (VALUES (0), (1)) k(t))")
    else:
        cells = f"(SELECT (max({key}) // 100) + 1 FROM {table})"
        size = f"sz AS (SELECT 11 AS nx, 11 AS ny, {cells} + 1 AS nz)"
        nodes = ("nd0 AS (SELECT CAST((k * nx + i) * ny + j AS INT) AS id, CAST(i AS DOUBLE) AS x, CAST(j AS DOUBLE) AS y, "
                 "CAST(k AS DOUBLE) AS z FROM sz, range(nx) a(i), range(ny) b(j), range(nz) c(k))")
        tets = ", ".join("(" + ", ".join(map(str, (t, *tet))) + ")" for t, tet in enumerate(CELL_TETS))
        corner = "((k + (({c} >> 2) & 1)) * nx + i + ({c} & 1)) * ny + j + (({c} >> 1) & 1)"
        v = ", ".join(corner.format(c=c) for c in "abcd")
        elements = (f"el0 AS (SELECT CAST(((k * (nx - 1) + i) * (ny - 1) + j) * 6 + t AS INT) AS e, [{v}] AS v FROM sz, "
                    f"range(nx - 1) p(i), range(ny - 1) q(j), range(nz - 1) r(k), (VALUES {tets}) s(t, a, b, c, d))")
    empty = "hn0 AS (SELECT 0 AS seq, 0 AS node, 0 AS lo, 0 AS hi WHERE false)"
    return ", ".join([size, nodes, elements, empty])


def marks(c: int, error: str, theta: float, beta: float) -> str:
    """CTE ``sel{c}(e)``: bulk marking with integer errors and the arithmetic flags."""
    return (f"in{c} AS (SELECT e, {error} AS err, (e::BIGINT * 104729) % 10 < 3 AS f FROM el{c}), "
            f"tt{c} AS (SELECT sum(err * err) AS total, count(*) AS n FROM in{c}), "
            f"cu{c} AS (SELECT e, err * err AS e2, sum(err * err) OVER w AS cum, row_number() OVER w AS rn FROM in{c} "
            f"WHERE f WINDOW w AS (ORDER BY err * err DESC, e ROWS UNBOUNDED PRECEDING)), "
            f"mk{c} AS (SELECT e, rn FROM cu{c}, tt{c} WHERE rn = 1 OR (cum - e2)::DOUBLE / total < {theta}), "
            f"sel{c} AS (SELECT e FROM mk{c}, tt{c} WHERE rn <= ceil({beta} * n))")


def _pairs(dim: int, c: int) -> str:
    n = VERTICES[dim]
    rows = ", ".join(f"({a + 1}, {b + 1})" for a in range(n) for b in range(a + 1, n))
    return (f"ed{c} AS (SELECT e, least(v[a], v[b]) AS lo, greatest(v[a], v[b]) AS hi "
            f"FROM el{c}, (VALUES {rows}) t(a, b))")


def closed(dim: int, c: int) -> str:
    """CTE ``cs{c}(e)``: the closure of ``sel{c}``."""
    return (f"{_pairs(dim, c)}, vx{c} AS (SELECT e, unnest(v) AS node FROM el{c}), "
            f"as{c} AS (SELECT DISTINCT vx{c}.e AS src, ed{c}.e AS dst FROM vx{c} JOIN hn{c} USING (node) "
            f"JOIN ed{c} USING (lo, hi)), "
            f"cs{c} AS (SELECT e FROM sel{c} UNION SELECT dst FROM cs{c} JOIN as{c} ON src = e)")


def _quality(points: list[str], dim: int) -> str:
    """Mean-ratio quality of a tetrahedron given by struct expressions."""
    a, b, c, d = points
    u, v, w = ([f"({q}.{k} - {a}.{k})" for k in "xyz"] for q in (b, c, d))
    det = (f"({u[0]} * ({v[1]} * {w[2]} - {v[2]} * {w[1]}) - {u[1]} * ({v[0]} * {w[2]} - {v[2]} * {w[0]}) "
           f"+ {u[2]} * ({v[0]} * {w[1]} - {v[1]} * {w[0]}))")
    edges = " + ".join(f"({q}.{k} - {p}.{k}) * ({q}.{k} - {p}.{k})" for i, p in enumerate(points)
                       for q in points[i + 1:] for k in "xyz")
    return f"(12.0::DOUBLE * pow(abs({det}) / 2.0::DOUBLE, {2 / 3!r}::DOUBLE) / ({edges}))"


def choice(source: str, name: str) -> str:
    """CTE ``name(e, choice)`` for tetrahedra ``source(e, p)``, ``p`` a list of ten points."""
    worst = [f"least({', '.join(_quality([f'p[{i + 1}]' for i in nodes], 3) for _, nodes in ch)}) AS q{k}"
             for k, ch in enumerate(shape(T4).choices)]
    tie = "(1 + 1e-9::DOUBLE)"
    return (f"{name}_q AS (SELECT e, {', '.join(worst)} FROM {source}), "
            f"{name} AS (SELECT e, CASE WHEN q2 > (CASE WHEN q1 > q0 * {tie} THEN q1 ELSE q0 END) * {tie} THEN 2 "
            f"WHEN q1 > q0 * {tie} THEN 1 ELSE 0 END AS choice FROM {name}_q)")


def refined(dim: int, c: int) -> str:
    """CTEs of cycle ``c + 1`` from ``cs{c}``: nodes, elements, hanging nodes, new nodes ``nw``."""
    s, n = shape(SHAPE[dim]), c + 1
    asked = ", ".join(f"({o}, {a + 1}, {b + 1})" for o, (a, b) in enumerate(s.new_nodes))
    kids = []
    for ch in range(max(len(s.choices), 1)):
        for k, (_, nodes) in enumerate(s.child_list(ch)):
            kids.append("(" + ", ".join(map(str, (ch, k, *[i + 1 for i in nodes]))) + ")")
    cols = "abcd"[: VERTICES[dim]]
    out = [
        f"rq{c} AS (SELECT el.e, ord, least(v[a], v[b]) AS lo, greatest(v[a], v[b]) AS hi FROM el{c} el "
        f"JOIN cs{c} USING (e), (VALUES {asked}) t(ord, a, b))",
        f"fs{c} AS (SELECT lo, hi, min(e::BIGINT * 32 + ord) AS k FROM rq{c} GROUP BY lo, hi)",
        f"kn{c} AS (SELECT fs.lo, fs.hi, k, hn.node FROM fs{c} fs LEFT JOIN hn{c} hn USING (lo, hi))",
        f"nw{c} AS (SELECT lo, hi, CAST((SELECT count(*) FROM nd{c}) + row_number() OVER (ORDER BY k) - 1 AS INT) AS node "
        f"FROM kn{c} WHERE node IS NULL)",
        f"no{c} AS (SELECT lo, hi, node FROM nw{c} UNION ALL SELECT lo, hi, node FROM kn{c} WHERE node IS NOT NULL)",
        f"nd{n} AS (SELECT * FROM nd{c} UNION ALL SELECT node, (a.x + b.x) / 2, (a.y + b.y) / 2, (a.z + b.z) / 2 "
        f"FROM nw{c} JOIN nd{c} a ON a.id = lo JOIN nd{c} b ON b.id = hi)",
        f"lc{c} AS (SELECT rq.e, list(node ORDER BY ord) AS w FROM rq{c} rq JOIN no{c} USING (lo, hi) GROUP BY rq.e)",
        f"lo{c} AS (SELECT e, list_concat(v, w) AS loc FROM el{c} JOIN lc{c} USING (e))",
    ]
    if dim == 3:
        xyz = "{{'x': q.x, 'y': q.y, 'z': q.z}}".replace("{{", "{").replace("}}", "}")
        out += [
            f"px{c} AS (SELECT e, unnest(loc) AS id, generate_subscripts(loc, 1) AS pos FROM lo{c})",
            f"pp{c} AS (SELECT px.e, list({xyz} ORDER BY pos) AS p FROM px{c} px JOIN nd{n} q USING (id) GROUP BY px.e)",
            choice(f"pp{c}", f"ch{c}"),
        ]
    else:
        out.append(f"ch{c} AS (SELECT e, 0 AS choice FROM lo{c})")
    local = ", ".join(f"loc[{k}]" for k in cols)
    out += [
        f"kd{c} AS (SELECT 0 AS late, e, k, [{local}] AS v FROM lo{c} JOIN ch{c} USING (e) "
        f"JOIN (VALUES {', '.join(kids)}) t(choice, k, {', '.join(cols)}) USING (choice) "
        f"UNION ALL SELECT 1, e, 0, v FROM el{c} WHERE e NOT IN (SELECT e FROM cs{c}))",
        f"el{n} AS (SELECT CAST(row_number() OVER (ORDER BY late, e, k) - 1 AS INT) AS e, v FROM kd{c})",
        _pairs(dim, n).replace(f"ed{n} AS", f"eh{n} AS"),
        f"hx{c} AS (SELECT 0 AS old, node AS ord, node, lo, hi FROM nw{c} UNION ALL SELECT 1, seq, node, lo, hi FROM hn{c})",
        f"hn{n} AS (SELECT CAST(row_number() OVER (ORDER BY old, ord) - 1 AS INT) AS seq, node, lo, hi FROM hx{c} "
        f"WHERE (lo, hi) IN (SELECT (lo, hi) FROM eh{n}))",
    ]
    return ", ".join(out)


# Errors: the first cycle reads the table, later ones follow from the numbers.
LATER_ERROR = "(e::BIGINT * 7919) % 1000"


def cycles(dim: int, table: str, key: str, error: str, n: int, theta: float = 0.15,
           beta: float = 0.30) -> str:
    """``n`` mark-close-refine cycles as one WITH clause."""
    per = 2 if dim == 2 else 6
    first = (f"coalesce((SELECT {error} FROM {table} t WHERE t.{key} = e // {per}), 0)")
    parts = [seed(dim, table, key)]
    for c in range(n):
        parts += [marks(c, first if c == 0 else LATER_ERROR, theta, beta), closed(dim, c), refined(dim, c)]
    return "WITH RECURSIVE " + ", ".join(parts)
