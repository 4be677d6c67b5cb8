"""Registered queries: market statistics, comparables and density ranges (C4, C7-C9, D1-D5, D14-D17, E1-E2, R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from estate_spark.operators import clean, comps, history, market, ranges
from estate_spark.plans.registry import query
from estate_spark.sources import views

NUMBERS = ("number_of_rooms", "living_area", "year_of_construction", "asking_price", "final_price")
KEPT = "final_price > 100000 AND final_price < 15000000"


def cleaned(spark, sf):
    return clean.price_between(views.sales(spark, sf))


MEDIANS = f"""SELECT neighborhood, CAST(count(*) AS BIGINT) AS n_sales, CAST(median(final_price) AS DOUBLE) AS median_price
              FROM sales WHERE {KEPT} GROUP BY 1 HAVING count(*) >= 100"""


@query("d1_neighborhood_medians", MEDIANS, "sales")
def _(spark, sf):
    return market.neighborhood_medians(cleaned(spark, sf))


@query(
    "e1_extreme_neighborhoods",
    f"""WITH m AS ({MEDIANS})
        SELECT * FROM (SELECT *, 'top' AS side FROM m ORDER BY median_price DESC, neighborhood LIMIT 10)
        UNION ALL
        SELECT * FROM (SELECT *, 'bottom' AS side FROM m ORDER BY median_price, neighborhood LIMIT 10)""",
    "sales",
)
def extreme_neighborhoods(spark, sf):
    return market.extreme_neighborhoods(market.neighborhood_medians(cleaned(spark, sf)))


@query(
    "d2_yearly_prices",
    """SELECT sale_year, CAST(count(final_price) AS BIGINT) AS n_sales, CAST(median(final_price) AS DOUBLE) AS median_price,
              avg(final_price) AS mean_price FROM sales GROUP BY 1""",
    "sales",
)
def _(spark, sf):
    return market.yearly_prices(views.sales(spark, sf))


@query(
    "d3_numeric_ranges",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, CAST(min({c}) {'FILTER (WHERE ' + c + ' >= 1800)' if c.startswith('year') else ''} AS DOUBLE)
            AS min_value, CAST(max({c}) AS DOUBLE) AS max_value FROM sales"""
        for c in NUMBERS
    ),
    "sales",
)
def _(spark, sf):
    return market.numeric_ranges(views.sales(spark, sf), NUMBERS)


@query(
    "d4_category_options",
    """SELECT DISTINCT 'ownership_form' AS feature, ownership_form AS value FROM sales
       UNION ALL SELECT DISTINCT 'neighborhood', neighborhood FROM sales""",
    "sales",
)
def _(spark, sf):
    return market.category_options(views.sales(spark, sf), ["ownership_form", "neighborhood"])


BOX = """box AS (SELECT ownership_form, quantile_cont(final_price, 0.25) AS q1, quantile_cont(final_price, 0.5) AS median,
         quantile_cont(final_price, 0.75) AS q3, count(*) AS n_rows FROM sales GROUP BY 1),
         f AS (SELECT s.ownership_form, final_price, q1, median, q3, n_rows,
               final_price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
               FROM sales s JOIN box b ON s.ownership_form = b.ownership_form)"""


@query(
    "d5_box_plot",
    f"""WITH {BOX} SELECT ownership_form, CAST(n_rows AS BIGINT) AS n_rows, CAST(q1 AS DOUBLE) AS q1, CAST(median AS DOUBLE) AS median,
        CAST(q3 AS DOUBLE) AS q3, min(final_price) FILTER (WHERE inside) AS whisker_low,
        max(final_price) FILTER (WHERE inside) AS whisker_high, CAST(count(*) FILTER (WHERE NOT inside) AS BIGINT) AS n_outliers
        FROM f GROUP BY ALL""",
    "sales",
)
def _(spark, sf):
    return market.box_plot(views.sales(spark, sf))


@query(
    "d5_box_plot_outliers",
    """WITH sales2 AS (SELECT ownership_form, final_price * CASE WHEN number_of_rooms = 7 AND living_area > 90 THEN 9 ELSE 1 END
                       AS final_price FROM sales), """
    + BOX.replace("FROM sales ", "FROM sales2 ")
    + " SELECT ownership_form, final_price, CAST(count(*) AS BIGINT) AS n FROM f WHERE NOT inside GROUP BY 1, 2",
    "sales",
)
def _(spark, sf):
    grown = F.when((F.col("number_of_rooms") == 7) & (F.col("living_area") > 90), 9).otherwise(1)
    priced = views.sales(spark, sf).withColumn("final_price", F.col("final_price") * grown)
    return market.box_plot_outliers(priced)


@query(
    "d15_neighborhood_table",
    """SELECT neighborhood AS name, city, round(avg(final_price / living_area), 4) AS avg_price_m2,
              CAST(median(final_price) AS DOUBLE) AS median_price, CAST(count(*) AS BIGINT) AS properties_count
       FROM sales GROUP BY 1, 2""",
    "sales",
)
def _(spark, sf):
    return market.neighborhood_table(views.sales(spark, sf)).withColumn("avg_price_m2", F.round("avg_price_m2", 4))


@query(
    "d16_price_histogram",
    """WITH b AS (SELECT CASE WHEN final_price < 0 THEN 0 WHEN final_price >= 15000000 THEN 31
                  ELSE final_price // 500000 + 1 END AS bin FROM sales)
       SELECT CAST(bin AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n_sales, CAST((bin - 1) * 500000 AS DOUBLE) AS bin_start
       FROM b GROUP BY bin""",
    "sales",
)
def _(spark, sf):
    return market.price_histogram(views.sales(spark, sf), 0, 15_000_000, 30)


@query(
    "d16_price_by_rooms",
    """SELECT number_of_rooms, CAST(count(*) AS BIGINT) AS n_sales, CAST(median(final_price) AS DOUBLE) AS median_price,
              avg(final_price) AS mean_price FROM sales GROUP BY 1""",
    "sales",
)
def _(spark, sf):
    return market.price_by_rooms(views.sales(spark, sf))


@query(
    "d16_price_per_sqm_by_area",
    """SELECT CAST(floor(living_area / 10) * 10 AS BIGINT) AS area_from, CAST(count(*) AS BIGINT) AS n_sales,
              CAST(sum(final_price) AS DOUBLE) / sum(living_area) AS price_per_sqm FROM sales WHERE living_area > 0 GROUP BY 1""",
    "sales",
)
def _(spark, sf):
    return market.price_per_sqm_by_area(views.sales(spark, sf))


@query(
    "d17_negotiation",
    """WITH u AS (SELECT neighborhood, asking_price, final_price, CAST(sold_date - listed_date AS INTEGER) AS days FROM sales
                  WHERE sold_date >= listed_date AND asking_price > 0)
       SELECT neighborhood, avg(days) AS mean_days, CAST(median(days) AS DOUBLE) AS median_days,
              CAST(sum(final_price) - sum(asking_price) AS DOUBLE) / CAST(sum(asking_price) AS DOUBLE) * 100 AS change_pct,
              CAST(count(*) FILTER (WHERE final_price > asking_price) AS BIGINT) AS n_over_asking,
              CAST(count(*) AS BIGINT) AS n_sales FROM u GROUP BY 1""",
    "sales",
)
def _(spark, sf):
    return market.negotiation(views.sales(spark, sf), ["neighborhood"])


@query(
    "c4_comparable_sales",
    """WITH p AS (SELECT DISTINCT neighborhood, number_of_rooms, living_area AS probe_area FROM sales),
       c AS (SELECT p.*, s.property_id AS comp_id, s.final_price AS comp_price, s.living_area AS comp_area,
                    s.sale_year AS comp_year,
                    row_number() OVER (PARTITION BY p.neighborhood, p.number_of_rooms, p.probe_area
                                       ORDER BY s.sale_year DESC, s.property_id) AS comp_rank
             FROM p JOIN sales s ON p.neighborhood = s.neighborhood AND p.number_of_rooms = s.number_of_rooms
              AND abs(s.living_area - p.probe_area) <= 10)
       SELECT s.property_id AS probe_id, c.neighborhood, c.number_of_rooms, c.probe_area, CAST(comp_rank AS INTEGER) AS comp_rank,
              comp_id, comp_price, comp_area, comp_year, comp_price / comp_area AS comp_per_sqm
       FROM sales s JOIN c ON s.neighborhood = c.neighborhood AND s.number_of_rooms = c.number_of_rooms
         AND s.living_area = c.probe_area WHERE comp_rank <= 5""",
    "sales",
)
def comparable_sales(spark, sf):
    sales = views.sales(spark, sf)
    return comps.comparable_sales(sales, sales)


@query(
    "e2_newest_comparables_fine_areas",
    """WITH t AS (SELECT row_number() OVER () AS probe_row, property_id, neighborhood, number_of_rooms, sale_year, final_price,
                         living_area + (final_price % 1000) / 1000 AS living_area FROM sales),
       r AS (SELECT p.property_id AS probe_id, s.property_id AS comp_id,
                    row_number() OVER (PARTITION BY p.probe_row ORDER BY s.sale_year DESC, s.property_id) AS comp_rank
             FROM t p JOIN t s ON p.neighborhood = s.neighborhood AND p.number_of_rooms = s.number_of_rooms
              AND abs(s.living_area - p.living_area) <= 10)
       SELECT probe_id, comp_id, CAST(comp_rank AS INTEGER) AS comp_rank FROM r WHERE comp_rank <= 5""",
    "sales",
)
def _(spark, sf):
    fine = views.sales(spark, sf).withColumn(
        "living_area", F.col("living_area") + (F.col("final_price") % 1000) / 1000
    )
    return comps.comparable_sales(fine, fine).select("probe_id", "comp_id", "comp_rank")


@query(
    "c7_inflation_adjusted",
    """WITH ix AS (SELECT DISTINCT sale_year AS year, 100.0::DOUBLE + (sale_year - 1990) * 2 AS level FROM sales),
       r AS (SELECT year, (SELECT level FROM ix WHERE year = 2000) / level AS ratio FROM ix)
       SELECT property_id, sale_year, CAST(floor(final_price * ratio + 0.5) AS BIGINT) AS adjusted_price
       FROM sales JOIN r ON sale_year = year""",
    "sales",
)
def _(spark, sf):
    sales = views.sales(spark, sf)
    index = sales.select(F.col("sale_year").alias("year")).distinct().withColumn(
        "level", F.lit(100.0) + (F.col("year") - 1990) * 2
    )
    return history.to_base_year(sales, index, 2000).select("property_id", "sale_year", "adjusted_price")


@query(
    "c8_underpriced_listings",
    """WITH m AS (SELECT neighborhood, number_of_rooms, CAST(median(final_price) AS DOUBLE) AS predicted_price FROM sales GROUP BY 1, 2)
       SELECT property_id, (predicted_price - asking_price) / predicted_price * 100 AS gap_pct
       FROM sales JOIN m USING (neighborhood, number_of_rooms)
       WHERE (predicted_price - asking_price) / predicted_price * 100 >= 10""",
    "sales",
)
def _(spark, sf):
    from estate_spark.functions.quantiles import exact_quantiles

    sales = views.sales(spark, sf)
    keys = ["neighborhood", "number_of_rooms"]
    fair = exact_quantiles(sales, keys, "final_price", {"predicted_price": 0.5}).drop("n_rows")
    return history.flag_underpriced(sales.join(fair, keys)).filter("underpriced").select("property_id", "gap_pct")


@query(
    "c9_similar_sales",
    """WITH p AS (SELECT DISTINCT neighborhood, number_of_rooms, living_area AS a, ownership_form AS f FROM sales),
       s AS (SELECT p.neighborhood, p.number_of_rooms, p.a, p.f, s.property_id AS comp_id, s.sale_year,
                    round((1 - abs(s.living_area - p.a) / 10) * 0.7::DOUBLE + CASE WHEN s.ownership_form = p.f THEN 0.3::DOUBLE ELSE 0::DOUBLE END, 6) AS score
             FROM p JOIN sales s ON p.neighborhood = s.neighborhood AND p.number_of_rooms = s.number_of_rooms
              AND abs(s.living_area - p.a) <= 10),
       r AS (SELECT *, row_number() OVER (PARTITION BY neighborhood, number_of_rooms, a, f
                    ORDER BY score DESC, sale_year DESC, comp_id) AS comp_rank FROM s WHERE score >= 0.7)
       SELECT x.property_id AS probe_id, CAST(comp_rank AS INTEGER) AS comp_rank, score, comp_id
       FROM sales x JOIN r ON x.neighborhood = r.neighborhood AND x.number_of_rooms = r.number_of_rooms
         AND x.living_area = r.a AND x.ownership_form = r.f WHERE comp_rank <= 5""",
    "sales",
)
def _(spark, sf):
    sales = views.sales(spark, sf)
    return comps.similar_sales(sales, sales)


@query(
    "d14_range_counts",
    """WITH r AS (SELECT range AS lo, range + 25 AS hi FROM range(0, 500, 25))
       SELECT CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi,
              CAST((SELECT count(*) FROM sales WHERE living_area >= lo AND living_area < hi) AS BIGINT) AS n_rows FROM r""",
    "sales",
)
def _(spark, sf):
    wanted = spark.range(0, 500, 25).select(
        F.col("id").cast("int").alias("lo"), (F.col("id") + 25).cast("int").alias("hi")
    )
    return ranges.range_counts(ranges.unit_histogram(views.sales(spark, sf)), wanted)


# widest range under the cap from each start; an empty step moves on by one unit
RANGE_CHAIN = """h AS (SELECT u.unit, COALESCE(n, 0) AS n FROM (SELECT range AS unit FROM range(0, 500)) u
         LEFT JOIN (SELECT CAST(floor(living_area) AS BIGINT) AS unit, count(*) AS n FROM sales GROUP BY 1) c ON u.unit = c.unit),
       cum AS (SELECT unit, n, COALESCE(sum(n) OVER (ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM h
               UNION ALL SELECT 500, 0, (SELECT sum(n) FROM h)),
       nxt AS (SELECT a.unit AS lo,
                 CASE WHEN max(b.below) = a.below THEN a.unit + 1
                      ELSE greatest(a.unit + 1, COALESCE(max(b.unit) FILTER (WHERE b.below - a.below < 2400), 0)) END AS hi
               FROM cum a JOIN cum b ON b.unit > a.unit AND b.unit <= least(a.unit + 50, 500) GROUP BY a.unit, a.below),
       chain AS (SELECT lo, hi FROM nxt WHERE lo = 0
                 UNION ALL SELECT n.lo, n.hi FROM chain c JOIN nxt n ON n.lo = c.hi),
       rng AS (SELECT c.lo, c.hi, e.below - s.below AS n_rows FROM chain c JOIN cum s ON s.unit = c.lo JOIN cum e ON e.unit = c.hi)"""


@query(
    "r1_density_ranges",
    f"""WITH {RANGE_CHAIN} SELECT CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi, CAST(n_rows AS BIGINT) AS n_rows,
        n_rows >= 2400 AS over_cap FROM rng""",
    "sales",
    recursive=True,
)
def _(spark, sf):
    return ranges.density_ranges(ranges.unit_histogram(views.sales(spark, sf)))


@query(
    "r2_range_assignment",
    f"""WITH {RANGE_CHAIN} SELECT property_id, CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi
        FROM sales LEFT JOIN (SELECT lo, CAST(hi AS BIGINT) AS hi FROM rng UNION ALL SELECT 500, NULL)
        ON living_area >= lo AND (hi IS NULL OR living_area < hi)""",
    "sales",
    recursive=True,
)
def _(spark, sf):
    sales = views.sales(spark, sf)
    found = ranges.density_ranges(ranges.unit_histogram(sales))
    return ranges.assign_ranges(sales, found).select("property_id", "lo", "hi")
