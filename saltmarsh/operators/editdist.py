"""Texts of one block within an edit distance, without comparing all pairs: an index of segments.

A text of n characters that may differ from a shorter one in t edits is cut into t + 1 even pieces. Some piece k stands unchanged in the
shorter text, moved by k characters at most from the left and by t - k at most from the right, so texts meet by their pieces
alone, at such places, and only texts that met are compared.

It pays for a likeness of about 0.8 and more, where pieces have five characters. At 0.6 they have two or three, which many texts share
in place. Texts that are one character repeated meet at every place: the operator is for titles, not for whole documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Below this likeness pieces are hardly longer than a character and bring nearly all texts together.
LEAST = 0.3


def edits(n: Column, least: float) -> Column:
    """Most edits between a text of n characters and one that isn't longer, at a likeness above ``least``."""
    return (F.ceil((1 - least) * n - 1e-9) - 1).cast("int")


def _met(texts: DataFrame, least: float) -> DataFrame:
    """block, a, b, most: pairs of distinct texts that share a piece in place, once for each such piece. A piece goes to every place where it
    may stand in a shorter text, so that texts meet by piece and place at once."""
    if not LEAST <= least < 1:
        raise ValueError(f"least must be from {LEAST} to 1")
    own = texts.select("block", "text").filter("block is not null and text != ''").distinct().withColumn("n", F.length("text"))
    cut = own.withColumn("most", edits(F.col("n"), least)).filter("most > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("most"))))
    start = lambda k: F.floor(k * F.col("n") / (F.col("most") + 1)).cast("int")
    cut = cut.withColumns({"at": start(F.col("k")), "end": start(F.col("k") + 1)})
    moved = F.sequence(F.greatest(-F.col("k"), -F.col("at")), F.least("k", F.col("most") - F.col("k")))  # b is no longer than a, so the right side bounds moves to the right
    cut = cut.select("block", F.col("text").alias("a"), "n", "most", "k", F.col("text").substr(F.col("at") + 1, F.col("end") - F.col("at")).alias("piece"), "at", F.explode(moved).alias("d"))
    cut = cut.withColumn("here", F.col("at") + F.col("d")).drop("at")

    def widths(n: Column) -> Column:
        """Widths of the pieces of texts of n characters."""
        each = n / F.greatest(edits(n, least) + 1, F.lit(2))
        return F.array(F.floor(each).cast("int"), F.ceil(each).cast("int"))

    met = F.array_distinct(F.flatten(F.transform(F.sequence(F.col("n"), F.floor(F.col("n") / least).cast("int")), widths)))
    held = own.withColumn("w", F.explode(met)).filter("w between 1 and n").withColumn("here", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("w"))))
    held = held.select("block", F.col("text").alias("b"), F.col("n").alias("m"), "here", F.col("text").substr(F.col("here") + 1, F.col("w")).alias("piece"))
    shorter = (F.col("m") <= F.col("n")) & (F.col("n") - F.col("m") <= F.col("most")) & ((F.col("m") < F.col("n")) | (F.col("b") < F.col("a")))
    right = F.abs(F.col("m") - F.col("n") - F.col("d"))
    return cut.join(held, ["block", "piece", "here"]).filter(shorter & (right <= F.col("most") - F.col("k"))).select("block", "a", "b", "most")


def candidates(texts: DataFrame, least: float) -> DataFrame:
    """block, a, b, most: pairs of distinct texts of ``texts`` (block, text) that share a piece in place; b isn't longer than a."""
    return _met(texts, least).distinct()


def near_texts(texts: DataFrame, least: float) -> DataFrame:
    """block, a, b, distance: pairs a < b of distinct texts of one block of ``texts`` (block, text) whose edit distance, as a share of the
    longer one's characters, is below 1 - ``least``. Null blocks and null or empty texts have no pairs; an empty table gives none."""
    found = _met(texts, least).withColumn("distance", F.expr("levenshtein(a, b, most)")).filter("distance >= 0")  # -1 beyond most; only near pairs are shuffled
    return found.distinct().select("block", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")
