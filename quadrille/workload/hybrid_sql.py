"""DuckDB formulation of meshes of every shape: seeds, closure, refinement and conformity.

It takes nothing from the engine's tables.  Squares, hexahedra and wedges are refined by the coordinates of their lattices;
triangles, tetrahedra and pyramids by the literal tables below.  Sides are found from reference solids.
"""

from __future__ import annotations

from itertools import product

from quadrille.workload.mesh_sql import _quality
from quadrille.workload.meshes import _duck_measure, _faces

# New nodes (their parents) and children of triangles, tetrahedra and pyramids, in local numbers.
_T3 = ("1.2 0.2 0.1", "2,4,3 3,5,1 4,0,5 5,3,4")
_T4 = ("1.3 0.3 0.1 2.3 1.2 0.2", "3,7,4,5", ("4,6,5,9 4,8,6,9 4,7,8,9 4,5,7,9", "6,7,5,4 6,7,9,5 6,7,8,9 6,7,4,8", "5,8,4,6 5,8,6,9 5,8,9,7 5,8,7,4"),
       "4,8,1,6 5,9,6,0 7,2,8,9")
_P5 = ("0.1 1.2 2.3 0.3 0.1.2.3 0.4 1.4 2.4 3.4", "0,5,9,8,10 5,1,6,9,11 9,6,2,7,12 8,9,7,3,13 10,11,12,13,4 10,13,12,11,9",
       "11,5,10,9 12,6,11,9 13,7,12,9 10,8,13,9")
# What fills a box, by kind, in corner numbers x + 2y + 4z; 8 is the centre.
CONTENTS = {
    2: ["Q4 0,1,3,2", "T3 0,1,3 0,3,2", "T3 0,1,2 1,3,2"],
    3: ["H8 0,1,3,2,4,5,7,6", "P5 0,2,6,4,8 1,5,7,3,8 0,4,5,1,8 2,3,7,6,8 0,1,3,2,8 4,6,7,5,8",
        "P5 0,2,6,4,8 1,5,7,3,8 0,4,5,1,8 2,3,7,6,8 0,1,3,2,8 T4 4,5,8,7 4,7,8,6",
        "T4 0,1,3,7 0,1,7,5 0,2,7,3 0,2,6,7 0,4,5,7 0,4,7,6", "W6 0,1,3,4,5,7 0,3,2,4,7,6"],
}
CODES = {"T3": 0, "Q4": 1, "T4": 4, "H8": 5, "W6": 8, "P5": 14}
# Corners of the reference solids, doubled.
_SQUARE = [(0, 0), (2, 0), (2, 2), (0, 2)]
SOLIDS = {"T3": [(0, 0, 0), (2, 0, 0), (0, 2, 0)], "Q4": [(*p, 0) for p in _SQUARE], "T4": [(0, 0, 0), (2, 0, 0), (0, 2, 0), (0, 0, 2)],
          "H8": [(*p, z) for z in (0, 2) for p in _SQUARE], "W6": [(x, y, z) for z in (0, 2) for x, y in ((0, 0), (2, 0), (0, 2))],
          "P5": [*((*p, 0) for p in _SQUARE), (0, 0, 2)]}


def _numbers(text: str, sep: str = ",") -> list[list[int]]:
    return [[int(n) for n in part.split(sep)] for part in text.split()]


def _by_lattice(name: str, cells, order) -> tuple[list[list[int]], list[list[int]]]:
    """New nodes and children from coordinates: ``order`` lists lattice points, ``cells`` the corners of the children."""
    solid = [p[:len(order[0])] for p in SOLIDS[name]]
    number = {p: i for i, p in enumerate(solid)}
    new = [p for p in order if p not in number]
    number |= {p: len(solid) + i for i, p in enumerate(new)}

    def parents(point):
        if name == "W6":  # a triangle's points lie between its corners, a prism's are pairs with a height
            flat = [(a, b) for a, b in product(range(3), repeat=2) if a <= b and tuple((u + v) // 2 for u, v in zip(solid[a][:2], solid[b][:2])) == point[:2]]
            ends = {0: (0,), 1: (0, 1), 2: (1,)}[point[2]]
            return sorted({v + 3 * z for v in flat[0] for z in ends})
        return [i for i, p in enumerate(solid) if all(c == 1 or c == v for c, v in zip(point, p))]

    return [parents(p) for p in new], [[number[p] for p in cell] for cell in cells]


def _templates() -> tuple[dict[str, list], list[tuple]]:
    """New nodes by shape; children as (shape, choice or None, number, child's shape, corners)."""
    ticks = (0, 2, 1)
    new, kids = {}, []

    def add(name, choice, child, lists, start=0):
        kids.extend((name, choice, start + k, child, c) for k, c in enumerate(lists))

    for name, dim in (("Q4", 2), ("H8", 3)):
        corners = [p[:dim] for p in SOLIDS[name]]
        cells = [[tuple(a + c // 2 for a, c in zip(low, p)) for p in corners] for low in product((0, 1), repeat=dim)]
        new[name], lists = _by_lattice(name, cells, list(product(ticks, repeat=dim)))
        add(name, None, name, lists)
    flat = [(0, 0), (2, 0), (0, 2), (1, 0), (0, 1), (1, 1)]
    thirds = [((0, 0), (1, 0), (0, 1)), ((1, 0), (2, 0), (1, 1)), ((0, 1), (1, 0), (1, 1)), ((0, 1), (1, 1), (0, 2))]
    cells = [[(*p, z + h) for h in (0, 1) for p in tri] for tri in thirds for z in (0, 1)]
    new["W6"], lists = _by_lattice("W6", cells, [(*p, z) for p in flat for z in ticks])
    add("W6", None, "W6", lists)
    new["T3"], new["T4"], new["P5"] = (_numbers(t[0], ".") for t in (_T3, _T4, _P5))
    add("T3", None, "T3", _numbers(_T3[1]))
    add("P5", None, "P5", _numbers(_P5[1]))
    add("P5", None, "T4", _numbers(_P5[2]), 6)
    add("T4", None, "T4", _numbers(_T4[1]))
    for choice, lists in enumerate(_T4[2]):
        add("T4", choice, "T4", _numbers(lists), 1)
    add("T4", None, "T4", _numbers(_T4[3]), 5)
    return new, kids


def _list(numbers, more: int = 1) -> str:
    return "[" + ", ".join(str(n + more) for n in numbers) + "]"


def tables(dim: int) -> str:
    """CTEs ``tn(s, ord, ps)``, ``tk(s, choice, k, cs, vs)`` and ``tb(kind, t, s, ps)``; lists are 1-based."""
    new, kids = _templates()
    mine = [n for n in CODES if (n in ("T3", "Q4")) == (dim == 2)]
    nodes = ", ".join(f"({CODES[n]}, {o}, {_list(p)})" for n in mine for o, p in enumerate(new[n]))
    children = ", ".join(f"({CODES[n]}, {'NULL' if c is None else c}, {k}, {CODES[m]}, {_list(v)})" for n, c, k, m, v in kids if n in mine)
    boxes, t = [], 0
    for kind, text in enumerate(CONTENTS[dim]):
        name, t = None, 0
        for word in text.split():
            if word in CODES:
                name = word
                continue
            boxes.append(f"({kind}, {t}, {CODES[name]}, {_list(map(int, word.split(',')), 0)})")
            t += 1
    return (f"tn(s, ord, ps) AS (VALUES {nodes}), tk(s, choice, k, cs, vs) AS (VALUES {children}), tb(kind, t, s, ps) AS (VALUES {', '.join(boxes)})")


def seed(dim: int, boxes: str) -> str:
    """CTEs ``nd0``, ``el0(e, s, v)`` and ``hn0(seq, node, ps)`` from ``boxes``: SQL with columns i, j, k, kind, val."""
    at = ", ".join(f"2 * {k} + CASE WHEN p = 8 THEN 1 ELSE 2 * ((p >> {a}) & 1) END AS {c}" for a, (k, c) in enumerate(zip("ijk"[:dim], "xyz")))
    flat = ", 0 AS z" if dim == 2 else ""
    return ", ".join([
        f"bx AS ({boxes})", "cl AS (SELECT *, row_number() OVER (ORDER BY i, j, k) - 1 AS cell FROM bx)",
        "ce AS (SELECT row_number() OVER (ORDER BY cell, t) - 1 AS e, s, i, j, k, ps FROM cl JOIN tb USING (kind))",
        f"cp AS (SELECT e, n, {at}{flat} FROM (SELECT e, i, j, k, unnest(ps) AS p, generate_subscripts(ps, 1) AS n FROM ce))",
        "nf AS (SELECT x, y, z, min(e * 16 + n) AS f FROM cp GROUP BY ALL)",
        "ni AS (SELECT CAST(row_number() OVER (ORDER BY f) - 1 AS INT) AS id, x, y, z FROM nf)",
        "nd0 AS (SELECT id, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z FROM ni)",
        "el0 AS (SELECT CAST(e AS INT) AS e, s, v FROM ce JOIN (SELECT e, list(id ORDER BY n) AS v FROM cp JOIN ni USING (x, y, z) GROUP BY e) USING (e))",
        "hn0 AS (SELECT 0 AS seq, 0 AS node, [0] AS ps WHERE false)",
    ])


def picked(dim: int, c: int, rule: str) -> str:
    """CTE ``sel{c}(e)``: elements for which ``rule`` over ``e`` and their box's ``val`` holds."""
    axes = list(zip("ijk"[:dim], "xyz"))
    return (f"vp{c} AS (SELECT e, s, {', '.join(f'floor(min({x}) / 2) AS {k}' for k, x in axes)} FROM (SELECT e, s, unnest(v) AS id FROM el{c}) "
            f"JOIN nd{c} USING (id) GROUP BY e, s), "
            f"sel{c} AS (SELECT e FROM vp{c} JOIN bx USING ({', '.join(k for k, _ in axes)}) WHERE {rule})")


def _having(c: int, rows: str, key: str) -> str:
    """(key, e): elements of cycle ``c`` that have all of a row's ``ps``."""
    return (f"(SELECT {key}, e FROM (SELECT {key}, unnest(ps) AS id, len(ps) AS n FROM {rows}) JOIN vx{c} USING (id) "
            f"GROUP BY {key}, e, n HAVING count(*) = n)")


def closed(c: int) -> str:
    return (f"vx{c} AS (SELECT e, unnest(v) AS id FROM el{c}), "
            f"as{c} AS (SELECT DISTINCT a.e AS src, b.e AS dst FROM hn{c} h JOIN vx{c} a ON a.id = h.node JOIN {_having(c, f'hn{c}', 'node')} b ON b.node = h.node), "
            f"cs{c} AS (SELECT e FROM sel{c} UNION SELECT dst FROM cs{c} JOIN as{c} ON src = e)")


def refined(dim: int, c: int) -> str:
    n = c + 1
    out = [
        f"rq{c} AS (SELECT e, ord, list_sort(list_transform(ps, lambda p: v[p])) AS ps FROM el{c} JOIN cs{c} USING (e) JOIN tn USING (s))",
        f"kn{c} AS (SELECT f.ps, f.k, h.node FROM (SELECT ps, min(e::BIGINT * 64 + ord) AS k FROM rq{c} GROUP BY ps) f LEFT JOIN hn{c} h USING (ps))",
        f"nw{c} AS (SELECT ps, CAST((SELECT count(*) FROM nd{c}) + row_number() OVER (ORDER BY k) - 1 AS INT) AS node FROM kn{c} WHERE node IS NULL)",
        f"no{c} AS (SELECT ps, node FROM nw{c} UNION ALL SELECT ps, node FROM kn{c} WHERE node IS NOT NULL)",
        f"nd{n} AS (SELECT * FROM nd{c} UNION ALL SELECT node, sum(x) / len(any_value(ps)), sum(y) / len(any_value(ps)), sum(z) / len(any_value(ps)) "
        f"FROM (SELECT node, ps, unnest(ps) AS id FROM nw{c}) JOIN nd{c} USING (id) GROUP BY node)",
        f"lo{c} AS (SELECT e, s, list_concat(v, w) AS loc FROM el{c} JOIN (SELECT e, list(node ORDER BY ord) AS w FROM rq{c} JOIN no{c} USING (ps) GROUP BY e) USING (e))",
    ]
    if dim == 3:
        worst = ", ".join("least(" + ", ".join(_quality([f"p[{i + 1}]" for i in four], 3) for four in _numbers(ch)) + f") AS q{k}" for k, ch in enumerate(_T4[2]))
        tie = "(1 + 1e-9::DOUBLE)"
        out += [
            f"pp{c} AS (SELECT e, list({{'x': x, 'y': y, 'z': z}} ORDER BY n) AS p FROM (SELECT e, unnest(loc) AS id, generate_subscripts(loc, 1) AS n "
            f"FROM lo{c} WHERE s = 4) JOIN nd{n} USING (id) GROUP BY e)",
            f"ql{c} AS (SELECT e, {worst} FROM pp{c})",
            f"ch{c} AS (SELECT e, CASE WHEN q2 > (CASE WHEN q1 > q0 * {tie} THEN q1 ELSE q0 END) * {tie} THEN 2 WHEN q1 > q0 * {tie} THEN 1 ELSE 0 END AS best FROM ql{c})",
        ]
    else:
        out.append(f"ch{c} AS (SELECT e, 0 AS best FROM lo{c})")
    out += [
        f"kd{c} AS (SELECT 0 AS late, e, k, cs AS s, list_transform(vs, lambda p: loc[p]) AS v FROM lo{c} JOIN tk USING (s) LEFT JOIN ch{c} USING (e) "
        f"WHERE choice IS NULL OR choice = best UNION ALL SELECT 1, e, 0, s, v FROM el{c} WHERE e NOT IN (SELECT e FROM cs{c}))",
        f"el{n} AS (SELECT CAST(row_number() OVER (ORDER BY late, e, k) - 1 AS INT) AS e, s, v FROM kd{c})",
        f"vx{n}_ AS (SELECT e, unnest(v) AS id FROM el{n})",
        f"hx{c} AS (SELECT 0 AS old, node AS ord, node, ps FROM nw{c} UNION ALL SELECT 1, seq, node, ps FROM hn{c})",
        f"hn{n} AS (SELECT CAST(row_number() OVER (ORDER BY old, ord) - 1 AS INT) AS seq, node, ps FROM hx{c} WHERE node IN "
        f"(SELECT node FROM {_having(n, f'hx{c}', 'node').replace(f'vx{n} ', f'vx{n}_ ')}))",
    ]
    return ", ".join(out)


def cycles(dim: int, boxes: str, rules: list[str]) -> str:
    parts = [tables(dim), seed(dim, boxes)]
    for c, rule in enumerate(rules):
        parts += [picked(dim, c, rule), closed(c), refined(dim, c)]
    return "WITH RECURSIVE " + ", ".join(parts)


# --- one cycle within a ceiling -----------------------------------------------------------

def within(dim: int, c: int, error: str, flag: str, theta: float, beta: float, room: str, floor: float = 0.0) -> str:
    """CTEs from the mesh of cycle ``c``: ``fg`` flagged, ``cd`` candidates, ``se(e, rk)`` marked within theta, cap and ceiling,
    and ``fit(e, chosen)``: the closure of the longest prefix of them that adds at most ``room`` elements."""
    grown = "CASE s " + " ".join(f"WHEN {CODES[n]} THEN {len([k for k in _templates()[1] if k[0] == n and k[1] in (None, 0)]) - 1}" for n in CODES) + " END"
    axes = list(zip("ijk"[:dim], "xyz"))
    mine = [n for n in CODES if (n in ("T3", "Q4")) == (dim == 2)]
    names = [f"{x}{i}" for i in range(8) for x in "xyz"]
    measure = "CASE s " + " ".join(f"WHEN {CODES[n]} THEN {_duck_measure(CODES[n])}" for n in mine) + " END"
    return ", ".join([
        f"vq AS (SELECT e, any_value(s) AS s, list({{'x': x, 'y': y, 'z': z}} ORDER BY n) AS p, {', '.join(f'floor(min({x}) / 2) AS {k}' for k, x in axes)} "
        f"FROM (SELECT e, s, unnest(v) AS id, generate_subscripts(v, 1) AS n FROM el{c}) JOIN nd{c} USING (id) GROUP BY e)",
        f"ix AS (SELECT e, s, {error} AS err, {flag} AS f, {', '.join(f'p[{int(n[1:]) + 1}].{n[0]} AS {n}' for n in names)} "
        f"FROM vq JOIN bx USING ({', '.join(k for k, _ in axes)}))",
        f"ie AS (SELECT e, s, err, f, pow(abs({measure}), {1.0 / dim!r}::DOUBLE) AS length, {grown} AS growth FROM ix)",
        "fg AS (SELECT * FROM ie WHERE f)", f"cd AS (SELECT * FROM fg WHERE length > {2 * floor!r})",
        "tz AS (SELECT sum(err * err) AS total, count(*) AS n FROM ie)",
        "cz AS (SELECT *, sum(err * err) OVER w AS cum, row_number() OVER w AS rk FROM cd WINDOW w AS (ORDER BY err * err DESC, e ROWS UNBOUNDED PRECEDING))",
        f"mz AS (SELECT *, sum(growth) OVER (ORDER BY rk ROWS UNBOUNDED PRECEDING) AS used FROM cz, tz WHERE (rk = 1 OR (cum - err * err)::DOUBLE / total < {theta}) "
        f"AND rk <= ceil({beta} * n))",
        f"se AS (SELECT e, rk FROM mz WHERE used <= {room})",
        "rr AS (SELECT e, rk FROM se UNION SELECT dst, rk FROM rr JOIN asz ON src = e)",
        "mr AS (SELECT e, min(rk) AS rk FROM rr GROUP BY e)",
        "cg AS (SELECT rk, sum(sum(growth)) OVER (ORDER BY rk ROWS UNBOUNDED PRECEDING) AS added FROM mr JOIN ie USING (e) GROUP BY rk)",
        f"ct AS (SELECT coalesce(min(rk), 1000000000000000) AS cut FROM cg WHERE added > {room})",
        "fit AS (SELECT m.e, coalesce(s.rk < cut, false) AS chosen FROM ct, mr m LEFT JOIN se s USING (e) WHERE m.rk < cut)",
    ])


def asks(c: int) -> str:
    """CTE ``asz(src, dst)``: which elements an element's refinement asks for."""
    return closed(c).split(f", cs{c} AS")[0].replace(f"as{c} AS", "asz AS")


# --- broken meshes and what is wrong with them -----------------------------------------

_FIELD = "((id::BIGINT * 7919 + (id::BIGINT // 3) * 104729) % 2001 - 1000)::DOUBLE"


def broken(dim: int, c: int, more: int) -> str:
    """CTEs ``bn(id, x, y, z)``, ``be(e, s, v)``, ``bh(node, ps, ws)``: the mesh of cycle ``c`` with faults from the boxes' values."""
    on = "USING (i, j)" if dim == 2 else "USING (i, j, k)"
    box = ", ".join(f"floor({x} / 2) AS {k}" for k, x in list(zip("ijk", "xyz"))[:dim])
    low = ", ".join(f"floor(min({x}) / 2) AS {k}" for k, x in list(zip("ijk", "xyz"))[:dim])
    return ", ".join([
        f"nv AS (SELECT id, x, y, z, val FROM (SELECT *, {box} FROM nd{c}) LEFT JOIN bx {on})",
        f"ev AS (SELECT e, s, v, val FROM el{c} JOIN (SELECT e, {low} FROM (SELECT e, unnest(v) AS id FROM el{c}) JOIN nd{c} USING (id) GROUP BY e) USING (e) JOIN bx {on})",
        f"bn AS (SELECT id, x, y, z FROM nv UNION ALL SELECT id + {more}, x, y, z FROM nv WHERE (val + id) % 40 = 0)",
        "be AS (SELECT e, s, CASE WHEN s IN (0, 4) AND (val + e) % 6 = 0 THEN list_concat([v[2], v[1]], v[3:]) ELSE v END AS v FROM ev WHERE (val + e) % 6 <> 1 "
        f"UNION ALL SELECT e + {more}, s, v FROM ev WHERE (val + e) % 6 = 2)",
        "bh AS (SELECT node, ps, list_transform(ps, lambda p, n: 1.0::DOUBLE / len(ps) + CASE WHEN coalesce((val + node) % 5, 9) <> 1 OR n > 2 THEN 0 "
        f"WHEN n = 1 THEN 0.125::DOUBLE ELSE -0.125::DOUBLE END) AS ws FROM hn{c} JOIN nv ON nv.id = node WHERE coalesce((val + node) % 5, 9) <> 0)",
    ])


def _sides(name: str) -> list[list[int]]:
    n = len(SOLIDS[name])
    return [[i, (i + 1) % n] for i in range(n)] if name in ("T3", "Q4") else _faces(SOLIDS[name])


def faults(dim: int) -> str:
    """A SELECT of fault, item, x, y, z over ``bn``, ``be``, ``bh``, preceded by its CTEs."""
    mine = [n for n in CODES if (n in ("T3", "Q4")) == (dim == 2)]
    sides = ", ".join(f"({CODES[n]}, {_list(f)})" for n in mine for f in _sides(n))
    corners = "abcd"[:2 if dim == 2 else 4]
    weights = {2: {"a": "1 - s", "b": "s"}, 3: {"a": "1 - s - r", "b": "s", "c": "r"},
               4: {"a": "(1 - s) * (1 - r)", "b": "s * (1 - r)", "c": "s * r", "d": "(1 - s) * r"}}
    samples = []
    for n in (2,) if dim == 2 else (3, 4):
        mixed = ", ".join(" + ".join(f"({w}) * {k}.{c}" for k, w in weights[n].items()) + f" AS {'w' if c == 'u' else c}" for c in "xyzu")
        joins = " ".join(f"JOIN us {k} ON {k}.id = f[{i + 1}]" for i, k in enumerate(weights[n]))
        rule = {2: "r = 0", 3: "s + r <= 1", 4: "true"}[n]
        samples.append(f"SELECT e, {mixed} FROM fc {joins}, tk4 p(s), tk4 q(r) WHERE len(f) = {n} AND {rule}")
    names = [f"{c}{i}" for i in range(8) for c in "xyz"]
    measure = "CASE s " + " ".join(f"WHEN {CODES[n]} THEN {_duck_measure(CODES[n])}" for n in mine) + " END"
    blank = ", ".join(f"NULL::DOUBLE AS {c}" for c in "xyz")
    return ", ".join([
        f"sd(s, f) AS (VALUES {sides})", "tk4 AS (SELECT i / 4.0::DOUBLE AS t FROM range(5) g(i))",
        "hp AS (SELECT node, unnest(ps) AS id, unnest(ws) AS w FROM bh)",
        f"us AS (SELECT id, x, y, z, coalesce(h, {_FIELD}) AS u FROM bn LEFT JOIN (SELECT node AS id, sum(w * {_FIELD}) AS h FROM hp GROUP BY node) USING (id))",
        "fc AS (SELECT e, list_transform(f, lambda n: v[n]) AS f FROM be JOIN sd USING (s))",
        f"sm AS MATERIALIZED ({' UNION ALL '.join(samples)})",
        "fo AS MATERIALIZED (SELECT DISTINCT id FROM bn JOIN sm USING (x, y, z) JOIN be USING (e) WHERE NOT list_contains(v, id))",
        "pl AS (SELECT e, any_value(s) AS s, list({'x': x, 'y': y, 'z': z} ORDER BY n) AS p FROM (SELECT e, s, unnest(v) AS id, generate_subscripts(v, 1) AS n FROM be) "
        "JOIN bn USING (id) GROUP BY e)",
        f"px AS (SELECT e, s, {', '.join(f'p[{int(n[1:]) + 1}].{n[0]} AS {n}' for n in names)} FROM pl)",
    ]) + (
        f" SELECT 'node hangs on a hanging node' AS fault, node::BIGINT AS item, {blank} FROM bh WHERE list_has_any(ps, (SELECT list(node) FROM bh))"
        f" UNION ALL SELECT 'node off its parents'' mean', node, {blank} FROM (SELECT node, sum(w * x) AS x, sum(w * y) AS y, sum(w * z) AS z FROM hp JOIN bn USING (id) "
        "GROUP BY node) m JOIN bn b ON b.id = m.node WHERE (m.x, m.y, m.z) <> (b.x, b.y, b.z)"
        " UNION ALL SELECT 'position held twice', NULL, x, y, z FROM bn GROUP BY x, y, z HAVING count(*) > 1"
        " UNION ALL SELECT 'field jumps', NULL, x, y, z FROM sm GROUP BY x, y, z HAVING count(DISTINCT w) > 1"
        f" UNION ALL SELECT 'node hangs unlisted', id, {blank} FROM fo WHERE id NOT IN (SELECT node FROM bh)"
        f" UNION ALL SELECT 'node listed without hanging', node, {blank} FROM bh WHERE node NOT IN (SELECT id FROM fo)"
        f" UNION ALL SELECT 'element turned', e, {blank} FROM px WHERE NOT {measure} > 0")


def covered(dim: int, points: str) -> str:
    """A SELECT of pid, elements, preceded by its CTEs; elements lie within boxes."""
    mine = [n for n in CODES if (n in ("T3", "Q4")) == (dim == 2)]
    keys, axes = "ijk"[:dim], "xyz"[:dim]

    def beyond(side: list[int]) -> str:
        a, b = side[0] + 1, side[1] + 1
        e = [f"(p[{b}].{c} - p[{a}].{c})" for c in "xyz"]
        t = [f"(q.{c} - p[{a}].{c})" for c in "xyz"]
        if dim == 2:
            return f"{e[1]} * {t[0]} - {e[0]} * {t[1]} < 0"
        g = [f"(p[{side[2] + 1}].{c} - p[{a}].{c})" for c in "xyz"]
        return " + ".join(f"({e[m]} * {g[n]} - {e[n]} * {g[m]}) * {t[k]}" for k, (m, n) in enumerate(((1, 2), (2, 0), (0, 1)))) + " < 0"

    inside = "CASE s " + " ".join(f"WHEN {CODES[n]} THEN " + " AND ".join(beyond(f) for f in _sides(n)) for n in mine) + " END"
    return ", ".join([
        f"qs AS ({points})", "qb AS (SELECT *, " + ", ".join(f"floor({c} / 2) AS {k}" for k, c in zip(keys, axes)) + " FROM qs)",
        "pl AS (SELECT e, any_value(s) AS s, list({'x': x, 'y': y, 'z': z} ORDER BY n) AS p, " + ", ".join(f"floor(min({c}) / 2) AS {k}" for k, c in zip(keys, axes))
        + " FROM (SELECT e, s, unnest(v) AS id, generate_subscripts(v, 1) AS n FROM be) JOIN bn USING (id) GROUP BY e)",
        f"ct AS (SELECT pid, count(*) AS n FROM qb q JOIN pl USING ({', '.join(keys)}) WHERE {inside} GROUP BY pid)",
    ]) + " SELECT pid, coalesce(n, 0) AS elements FROM qs LEFT JOIN ct USING (pid)"
