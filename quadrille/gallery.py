"""A small set of meshes and checks for a look by eye: ``python -m quadrille.gallery [FOLDER]``."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession

from quadrille.grid import Grid
from quadrille.operators.balance import balance, balance_passes
from quadrille.operators.oracles import Config, band
from quadrille.operators.tree import refine_converge, root, same_leaves, summary
from quadrille.operators.verify import InvalidTree, verify
from quadrille.plans.staging import stage
from quadrille.session import get_session
from quadrille.sources.export import write_svg, write_vtk


def _checks(name: str, leaves, grid: Grid, ripple, before: int) -> list[tuple[str, bool, str]]:
    try:
        verify(leaves, grid)
        valid = True
    except InvalidTree:
        valid = False
    row = summary(leaves, grid).first()
    return [
        (f"{name} valid after balance", valid, f"{before} -> {row['leaves']} cells, {ripple.passes} passes"),
        (f"{name} volumes sum to 1", abs(row["volume"] - 1) < 1e-12, f"sum = {row['volume']}"),
        (f"{name} sweep equals ripple", same_leaves(leaves, ripple.leaves), "same leaves"),
    ]


def build(spark: SparkSession, folder: str) -> bool:
    os.makedirs(folder, exist_ok=True)
    checks = []
    for dim, level in ((2, 6), (3, 5)):
        grid = Grid(dim, level)
        oracle = band(Config(level, 0.30, coarse_level=2, fine_level=level))
        leaves = stage(refine_converge(root(spark), grid, oracle), "gallery")
        balanced = stage(balance(leaves, grid), "gallery")
        checks += _checks(f"{dim}D", balanced, grid, balance_passes(leaves, grid), leaves.count())
        if dim == 2:
            write_svg(leaves, grid, os.path.join(folder, "mesh_2d_refined.svg"))
            write_svg(balanced, grid, os.path.join(folder, "mesh_2d_balanced.svg"))
        else:
            write_vtk(balanced, grid, os.path.join(folder, "mesh_3d_balanced.vtk"))
    rows = "".join(f"<tr><td>{n}</td><td>{'PASS' if ok else 'FAIL'}</td><td>{d}</td></tr>\n" for n, ok, d in checks)
    with open(os.path.join(folder, "index.html"), "w") as f:
        f.write("<!doctype html><meta charset=utf-8><title>Mesh gallery</title>\n<h1>Mesh gallery</h1>\n"
                "<p>Before and after balancing, coloured by level; the solid is mesh_3d_balanced.vtk.</p>\n"
                "<img src=mesh_2d_refined.svg width=45%> <img src=mesh_2d_balanced.svg width=45%>\n"
                f"<table><tr><th>Check<th>Result<th>Detail</tr>\n{rows}</table>\n")
    with open(os.path.join(folder, "summary.txt"), "w") as f:
        f.writelines(f"{'PASS' if ok else 'FAIL'}  {n:34}{d}\n" for n, ok, d in checks)
    return all(ok for _, ok, _ in checks)


if __name__ == "__main__":
    sys.exit(0 if build(get_session("quadrille-gallery"), *(sys.argv[1:2] or ["results"])) else 1)
