"""Key -> (Spark query, DuckDB oracle SQL) registry.

Each entry is a callable ``(spark, sf_dir) -> DataFrame`` plus, when the
operator is SQL-expressible, the oracle SQL. ``rounded`` lists double columns
that are rounded half-even to 6 decimals on both sides at the output only
(``rint(x*1e6)/1e6`` in Spark, ``round_even(x, 6)`` in DuckDB, which agree).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.functions.columns import round_half_even
from turfline.plans.oracle import with_fx


@dataclass
class Entry:
    key: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle_body: str | None = None
    fx: list[str] = field(default_factory=list)
    ctes: list[tuple[str, str]] = field(default_factory=list)
    rounded: list[str] = field(default_factory=list)

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        if self.rounded:
            df = df.withColumns({c: round_half_even(F.col(c).cast("double"), d) for c, d in self._digits()})
        return df

    def _digits(self) -> list[tuple[str, int]]:
        """``rounded`` entries are ``col`` (6 decimals) or ``col:digits``."""
        out = []
        for r in self.rounded:
            c, _, d = r.partition(":")
            out.append((c, int(d) if d else 6))
        return out

    def oracle(self) -> str | None:
        if self.oracle_body is None:
            return None
        body = self.oracle_body.strip()
        if self.rounded:
            repl = ", ".join(f"round_even(CAST({c} AS DOUBLE), {d}) AS {c}" for c, d in self._digits())
            body = f"SELECT * REPLACE ({repl}) FROM (\n{body}\n) _q"
        return with_fx(self.fx, body, self.ctes)


REGISTRY: dict[str, Entry] = {}


def register(key: str, oracle: str | None = None, fx: list[str] | None = None,
             ctes: list[tuple[str, str]] | None = None, rounded: list[str] | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if key in REGISTRY:
            raise ValueError(f"duplicate key {key}")
        REGISTRY[key] = Entry(key, fn, oracle, list(fx or []), list(ctes or []), list(rounded or []))
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    # Importing the query modules fills the registry.
    from turfline.plans import queries  # noqa: F401
    return REGISTRY
