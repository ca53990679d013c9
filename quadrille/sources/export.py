"""SVG and legacy VTK export of trees."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.grid import Grid
from quadrille.operators.tree import with_corner
from quadrille.plans.prefix import row_index
from quadrille.plans.staging import stage
from quadrille.sources.binary import write_lines

# Corner order and cell types of the legacy VTK format.
_CORNERS = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))
_CELL_TYPE = {2: 9, 3: 12}
_SVG_HEAD = ('<svg width="800" height="800" viewBox="0 0 1000 1000" '
             'xmlns="http://www.w3.org/2000/svg">\n'
             '<rect width="1000" height="1000" fill="white"/>\n')


def level_hue(level: str, lmin: str, lmax: str) -> str:
    """Blue (210) at the coarsest level to red (0) at the finest, truncated."""
    t = f"CAST({level} - {lmin} AS DOUBLE) / ({lmax} - {lmin})"
    return f"IF({lmax} <= {lmin}, 210, CAST(210.0D - 210.0D * ({t}) AS INT))"


def svg_cells(leaves: DataFrame, grid: Grid) -> DataFrame:
    """Rectangles of a 1000 x 1000 view with y upwards: ``code, level, x, y, side, hue``."""
    if grid.dim != 2:
        raise ValueError("SVG output requires dim == 2")
    scale = f"{1000.0 / grid.width!r}D"
    levels = F.broadcast(leaves.agg(F.min("level").alias("lmin"), F.max("level").alias("lmax")))
    hue = f"IF(lmax > lmin, {level_hue('level', 'lmin', 'greatest(lmax, lmin + 1)')}, 210)"
    return with_corner(leaves.select("code", "level"), grid).crossJoin(levels).selectExpr(
        "code", "level", f"x * {scale} AS x", f"1000.0D - y * {scale} - size * {scale} AS y",
        f"size * {scale} AS side", f"{hue} AS hue")


def vtk_points(leaves: DataFrame, grid: Grid) -> DataFrame:
    """Unshared cell corners in VTK order, in the unit domain: ``code, k, px, py, pz``."""
    corners = _CORNERS[: grid.children]
    norm = f"{1.0 / grid.width!r}D"
    at = [[f"({a} + {c[i]} * size) * {norm}" for i, a in enumerate(grid.axes)] + ["0.0D"] * (3 - grid.dim)
          for c in corners]
    points = ", ".join(f"named_struct('px', {p[0]}, 'py', {p[1]}, 'pz', {p[2]})" for p in at)
    return with_corner(leaves.select("code", "level"), grid).selectExpr(
        "code", f"posexplode(array({points})) AS (k, p)").select("code", "k", "p.*")


def _format(df: DataFrame, template: str, columns: list[str], keys: list[str]) -> DataFrame:
    """Add ``line``: numbers printed with up to 17 significant digits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = zip(*(b[c].tolist() for c in columns))
            yield b[keys].assign(line=[template % r for r in rows])

    fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.mapInPandas(run, f"{fields}, line string")


def write_svg(leaves: DataFrame, grid: Grid, path: str) -> None:
    template = ('<rect x="%.17g" y="%.17g" width="%.17g" height="%.17g" '
                'fill="hsl(%d,75%%,60%%)" stroke="black" stroke-width="0.4"/>')
    cells = svg_cells(leaves, grid).withColumn("side2", F.col("side"))
    lines = _format(cells, template, ["x", "y", "side", "side2", "hue"], ["code"])
    write_lines(lines, ["code"], path, _SVG_HEAD, "</svg>\n")


def write_vtk(leaves: DataFrame, grid: Grid, path: str) -> None:
    """Sections follow each other in one file; lines are placed by a running byte count."""
    indexed = stage(row_index(leaves.select("code", "level"), ["code"], "i"), "vtk")
    n, corners = indexed.count(), grid.children
    points = vtk_points(indexed, grid).join(indexed.select("code", "i"), "code") \
        .withColumn("j", F.col("i") * corners + F.col("k"))
    ids = ", ' ', ".join(f"i * {corners} + {k}" for k in range(corners))
    parts = [
        _format(points, "%.17g %.17g %.17g", ["px", "py", "pz"], ["j"]).selectExpr("0 AS section", "j", "line"),
        indexed.selectExpr("1", "i", f"concat('{corners} ', {ids})"),
        indexed.selectExpr("2", "i", f"'{_CELL_TYPE[grid.dim]}'"),
        indexed.selectExpr("3", "i", "CAST(level AS STRING)"),
    ]
    spark = leaves.sparkSession
    heads = [f"POINTS {n * corners} double", f"\nCELLS {n} {n * (corners + 1)}", f"\nCELL_TYPES {n}",
             f"\nCELL_DATA {n}\nSCALARS level int 1\nLOOKUP_TABLE default"]
    lines = spark.createDataFrame([(s, -1, h) for s, h in enumerate(heads)],
                                  "section int, j bigint, line string")
    for part in parts:
        lines = lines.union(part)
    write_lines(lines, ["section", "j"], path,
                "# vtk DataFile Version 3.0\nAMR Mesh\nASCII\nDATASET UNSTRUCTURED_GRID\n")
