"""Joins of whole documents with a list that is usually short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a list of keys that is sent to all executors: some 30 MB at most.
MOST = 400_000


def listed(keys: DataFrame, most: int = MOST) -> DataFrame:
    """A written list of keys as the small side of a join: broadcast if it has at most `most` rows, so
    that documents are not shuffled for it; a longer one is left to a shuffle join. The
    result of the join is the same."""
    return F.broadcast(keys) if keys.count() <= most else keys
