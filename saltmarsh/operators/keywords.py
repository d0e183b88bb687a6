"""Vocabularies as tables: which keywords stand in which texts, found by plain searches or by each keyword's rarest trigram.

Up to FEW keywords each text is searched for each of them, which takes one pass over the texts and no shuffle of them. Beyond that
keywords are an index: a keyword can only stand in a text that has all its trigrams, so keywords and texts meet by equality of one: the keyword's
trigram that the fewest keywords have. What meets is confirmed by a plain search. So thousands of keywords cost no more than one pass
over the texts' trigrams, where a chain of searches costs one pass for each keyword. Keywords of one or two letters meet
by themselves. Searches are in lower case; null texts have no keywords.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.functions.once import once
from saltmarsh.functions.places import trigrams

#: Most keywords that texts are searched for one by one.
FEW = 500


def vocabulary(spark: SparkSession, classes: dict[str, list[str]]) -> DataFrame:
    """class, rank (its place among the classes), keyword."""
    rows = [(name, k, w.lower()) for k, (name, words) in enumerate(classes.items()) for w in dict.fromkeys(words)]
    return spark.createDataFrame(rows, "class string, rank int, keyword string")


def index(words: DataFrame) -> DataFrame:
    """keyword, gram: each keyword's rarest trigram, itself if it is shorter."""
    own = words.filter("keyword != ''").select("keyword").distinct()
    grams = own.select("keyword", F.explode(F.when(F.length("keyword") >= 3, trigrams(F.col("keyword"))).otherwise(F.array("keyword"))).alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("often"))
    return grams.join(often, "gram").groupBy("keyword").agg(F.min(F.struct("often", "gram")).alias("rarest")).select("keyword", "rarest.gram")


def _grams(low: Column, sizes: list[int]) -> Column:
    """The distinct grams of these sizes. The characters are cut once: to find the i-th one in a text takes a walk over those before."""
    gram = lambda chars, i, n: F.concat(*(F.get(chars, i + d) for d in range(n)))
    of = lambda chars, n: F.when(F.size(chars) >= n, F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: gram(chars, i, n))).otherwise(F.array().cast("array<string>"))
    return once(F.regexp_extract_all(low, F.lit("(?s)."), F.lit(0)), lambda chars: F.array_distinct(F.concat(*(of(chars, n) for n in sizes))))


def hits(texts: DataFrame, words: DataFrame, key: str, text: str) -> DataFrame:
    """key, class, rank, keyword: each keyword of each class that stands in a text. ``key`` names one row."""
    known = [r.keyword for r in words.filter("keyword != ''").select("keyword").distinct().limit(FEW + 1).collect()]
    if not known:
        return texts.select(key).limit(0).join(words, F.lit(True))
    low = texts.select(key, F.lower(text).alias("_low")).filter("_low is not null")
    if len(known) <= FEW:
        there = low.select(key, F.explode(once(F.col("_low"), lambda t: F.filter(F.array(*map(F.lit, known)), lambda k: F.contains(t, k)))).alias("keyword"))
        return there.join(words, "keyword").select(key, "class", "rank", "keyword")
    found = index(words)
    sizes = [r.n for r in found.select(F.length("gram").alias("n")).distinct().collect()]  # three at most
    pairs = low.select(key, F.explode(_grams(F.col("_low"), sizes)).alias("gram")).join(found, "gram")
    met = pairs.groupBy(key).agg(F.collect_list("keyword").alias("_met"))
    there = low.join(met, key).select(key, F.explode(F.filter("_met", lambda k: F.contains(F.col("_low"), k))).alias("keyword"))
    return there.join(words, "keyword").select(key, "class", "rank", "keyword")


def best(found: DataFrame, key: str) -> DataFrame:
    """key, class, score: of hits the class with most keywords, the earliest of equals."""
    counted = found.groupBy(key, "class", "rank").agg(F.countDistinct("keyword").alias("n"))
    top = counted.groupBy(key).agg(F.max(F.struct("n", -F.col("rank"), "class")).alias("top"))
    return top.select(key, "top.class", F.col("top.n").alias("score"))


def first(found: DataFrame, key: str) -> DataFrame:
    """key, class: of hits the earliest class that has any."""
    return found.groupBy(key).agg(F.min(F.struct("rank", "class")).alias("top")).select(key, "top.class")
