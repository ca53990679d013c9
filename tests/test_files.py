"""Round trips, hostile input, exports and the command line."""

import struct

import pytest
from pyspark.sql import functions as F

from quadrille import Grid, cli
from quadrille.operators import oracles as O
from quadrille.operators import tree as T
from quadrille.operators.mesh import validate
from quadrille.operators.structured import structured
from quadrille.sources import amr1, smx2
from quadrille.sources.binary import FormatError
from quadrille.sources.export import write_svg, write_vtk


def test_amr1_round_trip(spark, tmp_path):
    grid = Grid(2, 6)
    leaves = T.refine_converge(T.root(spark), grid, O.tower()).selectExpr(
        "code", "level", "code * 0.1D AS wide", "level * 0.1D AS narrow")
    path = str(tmp_path / "t.amr")
    n = amr1.write_amr1(leaves, path, 2, 6, element=1, origin=(1.0, 2.0), size=(3.0, 4.0), float32=("narrow",))
    header, back = amr1.read_amr1(spark, path)
    assert (header.leaves, header.element, header.origin, header.size) == (n, 1, (1.0, 2.0), (3.0, 4.0))
    want = leaves.withColumn("narrow", F.col("narrow").cast("float").cast("double"))
    assert back.exceptAll(want).isEmpty() and back.count() == n
    amr1.write_amr1(leaves.limit(0), path, 3, 6)
    header, back = amr1.read_amr1(spark, path)
    assert header.element == 4 and back.isEmpty()


def head(version=2, dim=2, element=0, n=0, magic=b"AMR1"):
    mark = struct.pack("<I", element) if version != 1 else b""
    return magic + struct.pack("<3I", version, dim, 4) + mark + struct.pack("<Q", n) + bytes(16 * max(dim, 1))


AMR1_BAD = {
    "magic": head(magic=b"AMR2") + bytes(4), "version": head(version=3) + bytes(4), "bad dim": head(dim=4) + bytes(4),
    "element": head(element=3) + bytes(4), "leaf count": head(n=2**60) + bytes(4), "truncated": head(),
    "field count": head() + struct.pack("<I", 99),
    "dtype": head() + struct.pack("<II", 1, 1) + b"f" + struct.pack("<I", 7),
}


@pytest.mark.parametrize("message", AMR1_BAD)
def test_amr1_rejects(tmp_path, message):
    path = tmp_path / "bad.amr"
    path.write_bytes(AMR1_BAD[message])
    with pytest.raises(FormatError, match=message):
        amr1.read_header(str(path))


def test_amr1_version_one(tmp_path):
    path = tmp_path / "v1.amr"
    path.write_bytes(head(version=1, dim=3) + struct.pack("<I", 0) + b"ignored")
    assert amr1.read_header(str(path)).element == 4
    with pytest.raises(FormatError, match="cannot open"):
        amr1.read_header(str(tmp_path / "none.amr"))


def layout(nodes=0, elements=0, rows=0, parents=0, fields=0, dim=2, body=b"", magic=b"SMX2"):
    return magic + struct.pack("<I5Q", dim, nodes, elements, rows, parents, fields) + body


ONE_FIELD = struct.pack("<I", 1) + b"a" + struct.pack("<BQ", 0, 0)
SMX2_BAD = {
    "not an SMX2": layout(magic=b"SMX1"), "dim must be": layout(dim=4), "index type": layout(nodes=2**31),
    "truncated": layout(nodes=5), "trailing": layout(body=b"x"), "unknown or not 2D": layout(elements=1, body=b"\x04"),
    "constraint counts": layout(rows=1, parents=1, body=struct.pack("<iiid", 0, 0, 0, 0.0)),
    "repeats": layout(fields=2, body=ONE_FIELD * 2),
    "field type": layout(fields=1, body=struct.pack("<I", 1) + b"a" + struct.pack("<BQ", 9, 0)),
}


@pytest.mark.parametrize("message", SMX2_BAD)
def test_smx2_rejects(tmp_path, message):
    path = tmp_path / "bad.smx"
    path.write_bytes(SMX2_BAD[message])
    with pytest.raises(FormatError, match=message):
        smx2.read_layout(str(path))


def test_command_line(spark, tmp_path):
    source, refined, out = (str(tmp_path / n) for n in ("in.smx", "refined.smx", "out.smx"))
    mesh = structured(spark, (4, 4), (5, 5), (0, 0))
    n = mesh.elements.count()

    def array(values, kind):
        return spark.createDataFrame(list(enumerate(values)), f"pos int, value {kind}")

    doubles = {"error": array([float(e % 7) for e in range(n)], "double"), "ratio": array([2.0] * n, "double"),
               "params": array([0.3, 0.3, 0.0, 0.0, 0.0], "double"), "empty": array([], "double")}
    smx2.write_smx2(source, mesh, {"elements": array([3, 8], "int")}, doubles)
    back = smx2.read_smx2(spark, source)
    assert back.counts["empty"] == 0 and back.mesh.elements.exceptAll(mesh.elements).isEmpty()
    assert cli.main(["refine", source, refined], spark) == 0
    r = smx2.read_smx2(spark, refined)
    validate(r.mesh)
    assert r.mesh.elements.count() == n + 6 and r.counts["prolongation_weights"] == 2 * r.counts["prolongation_count"]
    assert r.mesh.constraints.count() > 0
    assert cli.main(["adapt", source, out], spark) == 0
    a = smx2.read_smx2(spark, out)
    assert [x["value"] for x in a.array("status").collect()] == [0]
    assert a.mesh.elements.count() == n + 3 * a.counts["balanced"] and a.counts["seconds"] == 3
    assert cli.main(["adapt", refined, out], spark) == 1  # no error field
    assert cli.main(["unknown", source, out], spark) == 2


def test_exports(spark, tmp_path):
    for dim, points, kind in ((2, 16, "9"), (3, 64, "12")):
        grid = Grid(dim, 4)
        cells = T.refine(T.root(spark), grid, O.always())
        path = tmp_path / f"m{dim}.vtk"
        write_vtk(cells, grid, str(path))
        text = path.read_text().splitlines()
        n = 2**dim
        assert f"POINTS {points} double" in text and f"CELLS {n} {n * (n + 1)}" in text
        at = text.index(f"CELL_TYPES {n}")
        assert text[at + 1: at + 1 + n] == [kind] * n and text[-n:] == ["1"] * n
        assert text[5: 5 + n][-1].count(" ") == 2
    svg = tmp_path / "m.svg"
    write_svg(T.refine(T.root(spark), Grid(2, 4), O.always()), Grid(2, 4), str(svg))
    lines = svg.read_text().splitlines()
    assert len(lines) == 7 and lines[-1] == "</svg>"
    assert lines[2].startswith('<rect x="0" y="500" width="500" height="500" fill="hsl(210,75%,60%)"')
    with pytest.raises(ValueError):
        write_svg(T.root(spark), Grid(3, 4), str(svg))
