"""Named queries: each is ``(spark, sf_dir) -> DataFrame`` plus, where SQL can
state the same result, the DuckDB oracle text.

Doubles are rounded to 6 decimals on both sides (Spark and DuckDB differ in
the last bits of sums and transcendental functions).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventsurv.sources.materialize import source_key

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


_MODELS: dict[tuple, object] = {}


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    """A trained model (model-sized, on the driver) per input, kept for the
    session: several queries report on the same training."""
    key = (spark.sparkContext.applicationId, source_key(f"{sf_dir}/events.parquet"), name)
    if key not in _MODELS:
        _MODELS[key] = build()
    return _MODELS[key]


#: below this size a double scaled to the digits kept is an exact whole number and a half
PLAIN = 1e14


def round_plain(x: Column, digits: int) -> Column:
    """Rounding half away from zero; in double arithmetic (without the decimal text of
    every number) where the scaled value is small enough, else Spark's ``round``."""
    scale = 10.0 ** digits
    big = F.abs(x) * F.lit(scale)
    return F.when(big < F.lit(PLAIN), F.signum(x) * (F.floor(big + F.lit(0.5)) / F.lit(scale))).otherwise(F.round(x, digits))


def rounded(df: DataFrame, digits: int = 6, only: list[str] | None = None) -> DataFrame:
    """Round double columns (all, or ``only``) and turn -0.0 into 0.0.

    Used for values whose last bits depend on the engine (transcendental
    functions, order of floating additions); exact arithmetic is left as is.
    """
    return df.select(*[(round_plain(F.col(f.name), digits) + F.lit(0.0)).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) and (only is None or f.name in only)
                       else F.col(f.name) for f in df.schema.fields])
