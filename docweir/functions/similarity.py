"""Ratcliff-Obershelp similarity, as the standard library computes it."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the least ratio of a match.
CUTOFF = 0.90


def close(held: str, probe: str, cutoff: float = CUTOFF) -> float | None:
    """The ratio that a match reports, or null below the cutoff.

    The ratio depends on the order of the two: whether there is a match is
    decided with the probe second, what is reported has it first.
    """
    m = SequenceMatcher(None, held, probe)
    if m.real_quick_ratio() >= cutoff and m.quick_ratio() >= cutoff and m.ratio() >= cutoff:
        return m.ratio()
    return None


@F.pandas_udf(T.StructType([T.StructField("decided", T.DoubleType()), T.StructField("reported", T.DoubleType())]))
def ratios(held: pd.Series, probe: pd.Series) -> pd.DataFrame:
    """Vectorised: the ratio that decides, null below the cutoff, and the one that is reported."""
    decided = [close(h, p) if h is not None and p is not None else None for h, p in zip(held, probe)]
    reported = [SequenceMatcher(None, p, h).ratio() if d is not None else None for h, p, d in zip(held, probe, decided)]
    return pd.DataFrame({"decided": pd.Series(decided, dtype=float), "reported": pd.Series(reported, dtype=float)})


def lengths_allow(a: Column, b: Column, cutoff: float = CUTOFF) -> Column:
    """An exact bound: two texts can reach the cutoff only if their lengths are this near."""
    return 2.0 * F.least(F.length(a), F.length(b)) >= F.lit(cutoff) * (F.length(a) + F.length(b))
