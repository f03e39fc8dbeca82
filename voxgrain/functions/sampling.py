"""Reproducible random draws: a row's draw depends on the seed and its key alone.

No task order, partitioning or retry can change the result, unlike ``rand(seed)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxgrain.functions.text import as_column

DEFAULT_SEED = 42
DRAW_RANGE = 2**32


def draw(key: Column | str, seed: int = DEFAULT_SEED) -> Column:
    """A whole number in [0, 2^32), evenly spread over the keys."""
    text = F.concat(F.lit(f"{seed}:"), as_column(key).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def uniform(key: Column | str, seed: int = DEFAULT_SEED) -> Column:
    """The draw scaled to [0, 1)."""
    return draw(key, seed) / F.lit(float(DRAW_RANGE))
