"""Column-level helpers: every function returns a ``Column`` built from
``pyspark.sql.functions``, so it stays inside whole-stage codegen."""

from turfline.functions.columns import *  # noqa: F401,F403
