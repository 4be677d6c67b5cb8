"""Shapes that keep the plans fit for large inputs."""

import re

import pytest

import __spark_entry__ as entry_points

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are when no side is small."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield spark
    spark.conf.set(name, before)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["c1_not_processed", "c4_comparable_sales", "c5_listing_sale_match", "c6_price_in_force", "c7_inflation_adjusted",
     "d1_neighborhood_medians", "g5_month_overlap", "j3_price_changes", "r2_range_assignment"],
)
def test_no_pairwise_joins(no_broadcast, name):
    plan = plan_of(entry_points.queries()[name](no_broadcast, SF_DIR))
    assert not re.search("NestedLoop|Cartesian", plan)


def test_price_filter_reads_needed_columns_only(spark):
    plan = plan_of(entry_points.queries()["d1_neighborhood_medians"](spark, SF_DIR))
    lineitem = next(line for line in plan.splitlines() if "lineitem.parquet" in line)
    schema = re.search(r"ReadSchema: (\S+)", lineitem).group(1)
    assert "l_shipdate" not in schema and "l_quantity" not in schema


def test_counts_are_shuffled_once(spark):
    df = entry_points.queries()["d2_yearly_prices"](spark, SF_DIR)
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert "ReusedExchange [sale_year" in final


def test_page_json_is_parsed_once(spark):
    plan = plan_of(entry_points.queries()["p16_sold_fields"](spark, SF_DIR))
    assert plan.count("from_json(") == 1


def exchanges(df) -> list[str]:
    return re.findall(r"\bExchange (\w+)", plan_of(df).split("== Initial Plan ==")[0])


@pytest.mark.parametrize("name", ["e4_slice", "e5_batches", "e5_batches_between"])
def test_numbering_moves_no_row_once_laid_out(no_broadcast, monkeypatch, name):
    """One range exchange lays rows out; numbers and limits need none after it."""
    from estate_spark.functions import ordering

    before = []
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 50)
    real = ordering.materialise
    monkeypatch.setattr(ordering, "materialise", lambda df: (before.append(exchanges(df)), real(df))[1])
    df = entry_points.queries()[name](no_broadcast, SF_DIR)
    assert exchanges(df) == []
    assert len(before) == 1 and before[0].count("rangepartitioning") == 1
    joins = 2 if name == "e4_slice" else 0  # rows and fingerprints, for the processed mark
    assert before[0].count("hashpartitioning") >= joins
