"""Rows dealt to buckets by ranges of doc_id, so that whole-table order needs no single task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands before every id: rows without one come first.
NO_ID = -(2**63)


def bounds(docs: DataFrame, parts: int | None = None) -> list[int]:
    """Ids at which buckets begin, from approximate quantiles of the id column alone; fewer than ``parts``."""
    parts = parts or max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = docs.select(F.col("doc_id").cast("double").alias("doc_id")).approxQuantile("doc_id", np.linspace(0, 1, parts + 1)[1:-1].tolist(), 1 / (4 * parts))
    return sorted({int(x) for x in found})


def bucket(at: list[int]) -> Column:
    """How many bounds are not above the row's id; 0 for no id. Looked up in two steps, so in about 2 * sqrt(bounds) comparisons."""
    if not at:
        return F.lit(0)
    own = f"coalesce(cast(doc_id as bigint), {NO_ID + 1}L)"
    array = lambda numbers: f"array({','.join(f'{x}L' for x in numbers)})"
    width = max(1, int(len(at) ** 0.5))
    parts = [at[k : k + width] for k in range(0, len(at), width)]
    part = f"size(filter({array([p[0] for p in parts])}, b -> b <= {own}))"
    inside = f"size(filter(element_at(array({','.join(map(array, parts))}), {part}), b -> b <= {own}))"
    return F.expr(f"case when {own} < {at[0]}L then 0 else ({part} - 1) * {width} + {inside} end")
