"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and the same in DuckDB SQL."""

from threadloom.plans import catalogue, evaluated  # noqa: F401
from threadloom.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
