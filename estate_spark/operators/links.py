"""Links out of captured search pages, their pagination facts, and link-set work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estate_spark.functions.text import inner_text, listing_id, listing_id_strict
from estate_spark.session import staged

# The first href of an ``a`` tag, quoted either way or bare. Attributes are read one by one, so that neither a ``>`` nor
# an ``href=`` within quotes counts; every step is possessive and a tag ends at ``<``, so a page is read once. The href
# stands among the first thousand attributes, which bounds the matcher's stack.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'<>]*+)"""
_OTHER = rf"""(?!href\s*+=)[^\s"'<>/=]++(?:\s*+=\s*+{_VALUE})?+[\s/]*+|["'=][\s/]*+"""
HREF = rf"""(?is)<a[\s/]++(?:{_OTHER}){{0,1000}}+href\s*+=\s*+("[^"]++"|'[^']++'|[^\s"'<>]++)"""

# Path pieces of listing links and of pages that only look like them.
ACTIVE_PATH = "/bostad/"
ACTIVE_EXCLUDED = ("/bostader", "/sok", "/filter")
SOLD_PATH = "/salda/lagenhet-"

# Fixed patterns: result counts and page numbers.
# Possessive and never begun inside a run of digits, so that long runs are read once.
RESULT_COUNT = r"(?<!\d)(?<!\d\s)(\d(?:\s?+\d)*+)\s*+(?:objekt|träffar)"
SHOWN, OF_TOTAL = "Visar ", r"^[^\n]*?av[\s\u00a0]*+(\d++(?:[\s\u00a0]\d{3}(?!\d))*+)"  # thousands apart by one blank
PAGE_NUMBER = r"page=(\d+)(?:&|$)"

RESULTS_PER_PAGE = 50
RESULT_LIMIT = 2500
ROWS_PER_PART = 500_000  # ids merged by one task, copies counted


def page_hrefs(html: Column) -> Column:
    """Hrefs of all ``a`` tags in page order, without quotes and with ``&amp;`` undone."""
    raw = F.regexp_extract_all(html, F.lit(HREF), F.lit(1))
    return F.transform(raw, lambda h: F.replace(F.regexp_replace(h, "^[\"']|[\"']$", ""), F.lit("&amp;"), F.lit("&")))


def _absolute(href: Column, page_url: Column) -> Column:
    """Site-relative links get scheme and host of the page they stand on, host-relative ones its scheme."""
    scheme = F.regexp_extract(page_url, r"^([a-zA-Z]+:)//", 1)
    site = F.regexp_extract(page_url, r"^([a-zA-Z]+://[^/?#]+)", 1)
    return (
        F.when(F.startswith(href, F.lit("//")), F.concat(scheme, href))
        .when(F.startswith(href, F.lit("/")), F.concat(site, href))
        .otherwise(href)
    )


def _links(pages: DataFrame, keep) -> DataFrame:
    """First occurrence of each wanted link per page, told by its absolute URL, settled inside the row: no shuffle."""
    kept = F.filter(page_hrefs(F.col("html")), keep)
    wanted = F.array_distinct(F.transform(kept, lambda href: _absolute(href, F.col("url"))))
    return pages.select(
        "page_id", F.col("url").alias("page_url"), F.posexplode(wanted).alias("pos", "_link")
    ).withColumnRenamed("_link", "url")


def active_links(pages: DataFrame, path: str = ACTIVE_PATH, excluded: Sequence[str] = ACTIVE_EXCLUDED) -> DataFrame:
    def keep(href: Column) -> Column:
        ok = F.contains(href, F.lit(path))
        for piece in excluded:
            ok = ok & ~F.contains(href, F.lit(piece))
        return ok

    return _links(pages, keep).withColumn("property_id", listing_id_strict(F.col("url")))


def sold_links(pages: DataFrame, path: str = SOLD_PATH) -> DataFrame:
    def keep(href: Column) -> Column:
        return F.contains(href, F.lit(path)) & ~F.contains(href, F.lit("#"))

    return _links(pages, keep).withColumn("property_id", listing_id(F.col("url")))


def pagination(pages: DataFrame, count_pattern: str = RESULT_COUNT) -> DataFrame:
    """Current page from the page's own URL, last page from its links, stated result count."""
    current = F.regexp_extract("url", PAGE_NUMBER, 1).try_cast("int")
    numbers = F.transform(
        page_hrefs(F.col("html")),
        lambda href: F.regexp_extract(href, PAGE_NUMBER, 1).try_cast("int"),
    )
    stated = F.regexp_extract(inner_text(F.col("html")), count_pattern, 1)
    return pages.select(
        "page_id",
        F.coalesce(current, F.lit(1)).alias("current_page"),
        F.coalesce(F.array_max(numbers), F.lit(1)).alias("total_pages"),
        F.regexp_replace(stated, r"[\s ]", "").try_cast("long").alias("total_results"),
    )


def stated_total(text: Column, opening: str = SHOWN, pattern: str = OF_TOTAL) -> Column:
    """Total from a 'shown X of N' sentence of a page's text (``inner_text``); 0 when it cannot be read.

    The text is cut at each ``opening`` and each piece tried once from its
    start, so a text of many openings is read once.
    """
    pieces = F.split(text, opening)
    found = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))), lambda piece: F.regexp_extract(piece, pattern, 1))
    digits = F.regexp_replace(F.get(F.filter(found, lambda d: d != ""), F.lit(0)), r"[\s ]", "")
    return F.coalesce(digits.try_cast("long"), F.lit(0))


def page_plan(totals: DataFrame, total: str = "total_results", max_pages: int = 50) -> DataFrame:
    """One row per page to read; ``over_limit`` marks totals the source would cut off."""
    pages = F.least(F.ceil(F.col(total) / RESULTS_PER_PAGE), F.lit(max_pages))
    return (
        totals.withColumn("n_pages", pages.cast("int"))
        .withColumn("over_limit", F.col(total) >= RESULT_LIMIT)
        .filter("n_pages > 0")
        .withColumn("page_no", F.explode(F.sequence(F.lit(1), F.col("n_pages"))))
    )


def first_per(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """First row per key in the given order.

    The rank limit is applied on the map side before the shuffle, so a hot key
    sends one row per input partition. Rows without a key count as one key.
    """
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter("_rn = 1").drop("_rn")


def merge_links(parts: Sequence[DataFrame], order: Sequence[str] = ("found_at", "property_id")) -> DataFrame:
    """Union of link lists, earlier lists first, one row per URL."""
    tagged = [p.withColumn("_list", F.lit(i)) for i, p in enumerate(parts)]
    union = tagged[0]
    for part in tagged[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    return first_per(union, "url", "_list", *order).drop("_list")


def consolidate(range_rows: DataFrame, file: str = "file_name") -> DataFrame:
    """One row per id over all range files, in file-name order."""
    return first_per(range_rows, "property_id", file, "scraped_at", "url")


def distinct_links(df: DataFrame, column: str = "url") -> DataFrame:
    return df.select(column).distinct()


def same_ids(left: DataFrame, right: DataFrame, key: str = "property_id") -> DataFrame:
    """One row: are the two id sets equal, and how many ids each lacks.

    The ids are staged, counted and dealt into parts that follow their number
    before they are merged: what a task holds of them does not grow with the
    input.
    """
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    sides = staged(sides)
    parts = max(1, -(-sides.count() // ROWS_PER_PART))
    per_id = sides.repartition(parts, key).groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return per_id.agg(
        F.count_if((F.col("l") == 1) & (F.col("r") == 0)).alias("only_left"),
        F.count_if((F.col("l") == 0) & (F.col("r") == 1)).alias("only_right"),
    ).withColumn("same", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def ids_in_many(df: DataFrame, key: str = "property_id", part: str = "sold_month") -> DataFrame:
    """Ids present in more than one partition, with the first and last one.

    Copies of an id inside a partition are merged first on the map side.
    """
    per_part = df.select(key, part).distinct()
    return (
        per_part.groupBy(key)
        .agg(F.count("*").alias("n_parts"), F.min(part).alias("first_part"), F.max(part).alias("last_part"))
        .filter("n_parts > 1")
    )


def partition_overlap(df: DataFrame, key: str = "property_id", part: str = "sold_month") -> DataFrame:
    """Number of ids shared by each pair of partitions.

    Ids with the same set of partitions are counted together before sets are
    opened into pairs, so the work follows the number of distinct sets, not of
    ids. A set holds partition names only: months or ranges, a short list.
    """
    sets = (
        df.select(key, part)
        .distinct()
        .groupBy(key)
        .agg(F.array_sort(F.collect_set(part)).alias("parts"))
        .filter(F.size("parts") > 1)
        .groupBy("parts")
        .agg(F.count("*").alias("n"))
    )
    pairs = F.flatten(
        F.transform(
            "parts",
            lambda a, i: F.transform(
                F.slice("parts", i + 2, F.size("parts")),
                lambda b: F.struct(a.alias("part_a"), b.alias("part_b")),
            ),
        )
    )
    return (
        sets.select(F.explode(pairs).alias("p"), "n")
        .groupBy("p.part_a", "p.part_b")
        .agg(F.sum("n").alias("shared_ids"))
    )
