"""Query catalogue: name -> function of (spark, sf_dir), and DuckDB SQL for the same rows."""

from lectern.plans import accounts, desk, layout, reads, relational, texts  # noqa: F401  (they register their queries)
from lectern.plans.roles import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
