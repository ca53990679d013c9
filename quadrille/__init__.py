"""Adaptive quadtrees, octrees and hybrid meshes as Spark DataFrames."""

from quadrille.grid import Grid
from quadrille.session import get_session

__all__ = ["Grid", "get_session"]
