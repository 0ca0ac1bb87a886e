"""All registered queries over the given tables and the DuckDB SQL of each."""

from cliploom.plans import clip_queries, gate_queries, media_queries, more_queries, source_queries, text_queries, variant_queries  # noqa: F401
from cliploom.plans.registration import ORACLES, QUERIES

FLAGSHIP = "wn13_best_window"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
