"""The page loop over stored pages: chains of next links, followed from start pages to where the loop stops.

A page has one next page at most, so the pages of a start are a list. Its places are found by pointer doubling: from places 1 to
2^k, links that jump 2^k pages lead to places up to 2^(k+1), so 100 pages take seven joins. Then windows over each list find
where it stops. Many starts may run into one chain, and chains may close to cycles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saltmarsh.functions import places
from saltmarsh.functions.shown import resolved
from saltmarsh.sources.shared import written

#: Pages of a loop at most, of the plain loop, empty pages in a row that end it, and pages without anything new of one vendor.
MOST_PAGES, PLAIN_MOST, MOST_EMPTY, MOST_STALE = 100, 20, 3, 5
#: What marks an anchor as the next page's, in the order tried: classes, its text, its rel.
_ANCHOR = r"(?is)<a\s[^>]*>.*?</a\s*>"
_NEXT = (
    r"(?is)^<a\s[^>]*\bclass\s*=\s*([\"'])(?:(?!\1).)*(?<![\w-])next(?![\w-])(?:(?!\1).)*\1",
    r"(?is)^<a\s[^>]*\bclass\s*=\s*([\"'])(?:(?!\1).)*(?<![\w-])next-page(?![\w-])(?:(?!\1).)*\1",
    r"(?is)^<a\s[^>]*>.*next.*</a\s*>$",
    r"(?is)^<a\s[^>]*>.*(?:&gt;|(?<![\w\"'/])>).*</a\s*>$",
    r"(?is)^<a\s[^>]*\brel\s*=\s*([\"']?)next\b",
)
_HREF = r"(?is)^<a\s[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"


def next_url(url: Column, html: Column) -> Column:
    """Where a stored page's loop goes on: the first anchor that is marked as next and has a link, else its own url with a page number raised."""
    anchors = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_ANCHOR), F.lit(0))

    def href_of(mark: str) -> Column:
        first = F.get(F.filter(anchors, lambda a: a.rlike(mark)), F.lit(0))
        return F.nullif(F.regexp_extract(first, _HREF, 1), F.lit(""))

    href = F.coalesce(*map(href_of, _NEXT))
    return F.when(href.isNotNull(), resolved(url, href)).otherwise(places.next_page(url))


def walk(pages: DataFrame, starts: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """start, page_no, url: the first ``most`` places of the list of each start. ``pages``: url (one row each) and next; ``starts``: url.

    A next page that isn't stored is a place too, the last one of its list.
    """
    links = pages.filter("url is not null and next is not null").select(F.col("url").alias("from"), F.col("next").alias("to"))
    found = starts.filter("url is not null").select(F.col("url").alias("start"), F.lit(1).alias("page_no"), "url").distinct()
    step = 1
    while step < most:
        hop = found.join(links, found["url"] == links["from"]).select("start", (F.col("page_no") + step).alias("page_no"), F.col("to").alias("url"))
        found = written(found.union(hop.filter(F.col("page_no") <= most)), "places")
        step *= 2
        if step < most:
            on = links.select(F.col("from").alias("to"), F.col("to").alias("further"))
            links = written(links.join(on, "to").select("from", F.col("further").alias("to")), "jumps")
    return found.filter(F.col("page_no") <= most)


def new_listings(places_: DataFrame, listings: DataFrame) -> DataFrame:
    """start, page_no, new: how many of a page's listings (url, listing) no earlier page of its start has. Pages without any have no row."""
    first = places_.join(listings.select("url", "listing").distinct(), "url").groupBy("start", "listing").agg(F.min("page_no").alias("page_no"))
    return first.groupBy("start", "page_no").agg(F.count("*").alias("new"))


def marked(places_: DataFrame, pages: DataFrame, most_empty: int | None = MOST_EMPTY, most_stale: int | None = None) -> DataFrame:
    """The places with their page's ``found`` (listings; null: no pattern) and ``why`` the loop stops there, null where it goes on.

    ``visited``: an earlier place has the url; ``missing``: the page isn't stored; ``no pattern``; ``empty``: the last of
    ``most_empty`` empty pages in a row; ``nothing new``: the last of ``most_stale`` pages in a row without (column ``new``).
    A page that stops the loop isn't part of it.
    """
    columns = ["url", "found", *(["new"] if "new" in pages.columns else [])]
    own = pages.select(*columns, F.lit(True).alias("stored")) if "new" not in places_.columns else pages.select("url", "found", F.lit(True).alias("stored"))
    rows = places_.join(own, "url", "left")
    order = W.partitionBy("start").orderBy("page_no")
    in_a_row = lambda flag, n: F.sum(flag.cast("int")).over(order.rowsBetween(1 - n, 0)) == n
    again = F.row_number().over(W.partitionBy("start", "url").orderBy("page_no")) > 1
    why = F.when(again, "visited").when(F.col("stored").isNull(), "missing").when(F.col("found").isNull(), "no pattern")
    if most_empty:
        why = why.when(in_a_row(F.coalesce(F.col("found") == 0, F.lit(False)), most_empty), "empty")
    if most_stale:
        why = why.when(in_a_row(F.coalesce(F.col("new"), F.lit(0)) == 0, most_stale), "nothing new")
    return rows.withColumn("why", why).drop("stored")


def paged(pages: DataFrame, starts: DataFrame, most: int = MOST_PAGES, most_empty: int | None = MOST_EMPTY, listings: DataFrame | None = None, most_stale: int | None = None) -> DataFrame:
    """start, page_no, url, found: the pages that the loop takes from each start, in order. With ``listings`` (url, listing) the loop
    also ends after ``most_stale`` pages in a row that give nothing new."""
    found = walk(pages, starts, most)
    if listings is not None:
        found = found.join(new_listings(found, listings), ["start", "page_no"], "left")
    return taken(marked(found, pages, most_empty, most_stale if listings is not None else None))


def taken(rows: DataFrame) -> DataFrame:
    """Of marked places those before their list's first stop."""
    stop = F.min(F.when(F.col("why").isNotNull(), F.col("page_no"))).over(W.partitionBy("start"))
    return rows.withColumn("stop", stop).filter(F.col("stop").isNull() | (F.col("page_no") < F.col("stop"))).select("start", "page_no", "url", "found")


def ends(rows: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """start, pages, why: of marked places how many pages each start's loop takes, and why it stops; ``limit`` after ``most`` pages, with or without a next one, ``last`` where fewer have none."""
    first = F.min(F.when(F.col("why").isNotNull(), F.struct("page_no", "why")))
    one = rows.groupBy("start").agg(first.alias("stop"), F.max("page_no").alias("n"))
    return one.select("start", F.coalesce(F.col("stop.page_no") - 1, F.col("n")).alias("pages"), F.coalesce("stop.why", F.when(F.col("n") >= most, "limit").otherwise("last")).alias("why"))
