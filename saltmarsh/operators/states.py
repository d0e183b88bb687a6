"""The status machine of a listing: each observation is judged from the last legal state, however long the history.

An observation is a function from states to states, and functions compose in any grouping. A history is cut into spans; each span's
observations are composed to one function, the spans' functions in order give the state in which each span begins, and from
it the span's own observations are judged. So no task needs a whole history in one piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saltmarsh.operators.rules import LEGAL

STATES = ("active", "removed", "sold", "pending", "relisted")
#: Observations of a span at most.
SPAN = 1_000
_START = "0"
_CODES = {s: str(k) for k, s in enumerate(STATES, 1)}
_SAME = "".join([_START, *_CODES.values()])


def function_of(status: Column) -> Column:
    """A text that has the new state's digit at each old state's place; unknown statuses change nothing."""
    out = F.lit(_SAME)
    for name, code in _CODES.items():
        moved = "".join(code if s == _START or any((a, b) == (name_of(s), name) for a, b in LEGAL) else s for s in _SAME)
        out = F.when(status == name, F.lit(moved)).otherwise(out)
    return out


def name_of(code: str) -> str | None:
    return next((s for s, c in _CODES.items() if c == code), None)


def applied(function: Column, state: Column) -> Column:
    return function.substr(state.cast("int") + 1, F.lit(1))


def composed(first: Column, then: Column) -> Column:
    return F.concat(*(applied(then, first.substr(F.lit(k + 1), F.lit(1))) for k in range(len(_SAME))))


def histories(rows: DataFrame, key: str, order: tuple[str, ...], status: str, period: Column | None = None, span: int = SPAN) -> DataFrame:
    """Every observation with from_status (the state before it, null at first), state (after it) and kind: ``first``, ``same``,
    ``legal``, ``illegal`` (the state stays as it was) or ``unknown`` (null, or no status at all).

    ``period``: a value that grows with the order, such as a month; observations are numbered within it, so that one listing's
    sorting is dealt to several tasks too. Repeated and tied observations are taken in the order of their statuses.
    """
    period = F.lit(0) if period is None else period
    rows = rows.select(key, *(c for c in order if c != key), F.col(status).alias("_status"), function_of(F.col(status)).alias("_f"), period.alias("_period"))
    number = F.row_number().over(W.partitionBy(key, "_period").orderBy(*order, "_status")) - 1
    numbered = rows.withColumn("_part", F.floor(number / span))
    own = F.struct(*(c for c in order if c != key), "_status", "_f")
    spans = numbered.groupBy(key, "_period", "_part").agg(F.sort_array(F.collect_list(own)).alias("_rows"))
    spans = spans.withColumn("_whole", F.aggregate("_rows", F.lit(_SAME), lambda f, x: composed(f, x["_f"])))
    # Each span's first state: the digits of all spans of a listing, one after the other.
    lists = spans.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_period", "_part", "_whole"))).alias("_spans"))
    entries = lists.withColumn("_entries", F.aggregate("_spans", F.lit(_START), lambda out, x: F.concat(out, applied(x["_whole"], F.right(out, F.lit(1))))))
    entry = entries.select(key, "_entries", F.posexplode("_spans").alias("_at", "_s")).select(key, "_s._period", "_s._part", F.col("_entries").substr(F.col("_at") + 1, F.lit(1)).alias("_entry"))
    judged = spans.drop("_whole").join(entry, [key, "_period", "_part"])
    judged = judged.withColumn("_path", F.aggregate("_rows", F.col("_entry"), lambda out, x: F.concat(out, applied(x["_f"], F.right(out, F.lit(1))))))
    each = judged.select(key, "_path", F.posexplode("_rows").alias("_at", "_r"))
    before, after = F.col("_path").substr(F.col("_at") + 1, F.lit(1)), F.col("_path").substr(F.col("_at") + 2, F.lit(1))
    named = lambda digit: F.element_at(F.create_map(*(F.lit(x) for pair in ((c, s) for s, c in _CODES.items()) for x in pair), F.lit(_START), F.lit(None).cast("string")), digit)
    seen, old, new = F.col("_r._status"), named(before), named(after)
    kind = F.when(~F.coalesce(seen.isin(*STATES), F.lit(False)), "unknown").when(old.isNull(), "first").when(old == seen, "same").when(new == seen, "legal").otherwise("illegal")
    return each.select(key, *(F.col(f"_r.{c}").alias(c) for c in order if c != key), seen.alias("status"), old.alias("from_status"), new.alias("state"), kind.alias("kind"))


def split(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The legal history, and the observations that go to the reject table."""
    bad = F.col("kind").isin("illegal", "unknown")
    return judged.filter(~bad), judged.filter(bad)
