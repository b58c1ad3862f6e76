"""turfline: player and match analytics expressed as Spark DataFrame operators.

Subpackages
-----------
sources    readers for the driver tables, fixture views, JSON/XML/CSV ingest, sinks
functions  column-level helpers (rounding, clipping, tiers, keyword flags)
operators  DataFrame -> DataFrame operators (upsert, features, aggregates,
           windows, text, vectors, ml, serving)
plans      size guards, checkpointing and the key -> (query, oracle SQL) catalog
streaming  Structured Streaming jobs built on the batch operators
"""

from turfline.session import get_spark, ensure_checkpoint_dir  # noqa: F401
