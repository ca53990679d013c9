"""Imports every operator module, so that all queries are registered."""

from quadrille.llm import (  # noqa: F401
    decontaminate, html, language, lm, merkle, neighbours, ngram_join, packing, quality, secrets, spelling, substring, toxicity,
)
from quadrille.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
