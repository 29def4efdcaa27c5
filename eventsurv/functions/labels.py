"""Survival label encodings (L1-L3, L5) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def signed_duration(t: Column, status: Column) -> Column:
    """L1: +t for an observed event, -t for a censored row."""
    return F.when(status == 1, t).otherwise(-t).cast("double")


def signed_log_duration(t: Column, status: Column) -> Column:
    """L2: +-ln(t + 1).  An event at t = 0 gets 0 and loses its sign."""
    return F.when(status == 1, F.log1p(t)).otherwise(-F.log1p(t)).cast("double")


def raw_duration(t: Column) -> Column:
    """L3: the duration alone, censoring ignored."""
    return t.cast("double")


def transition_key() -> Column:
    """the key string of a transition, ``index_outcome``."""
    return F.concat_ws("_", "index_event", "outcome_event")
