"""Concept-lattice analytics over graded object x attribute tables, on Spark DataFrames."""

from gradelattice.operators.context import Context

__all__ = ["Context"]
