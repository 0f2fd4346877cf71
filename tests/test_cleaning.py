from pyspark.sql import functions as F

import pytest

from shelfcast.config import RAW_COLUMNS, RAW_FIELD_NAMES
from shelfcast.contract import transactions
from shelfcast.contract.queries import csv_ingest
from shelfcast.contract.queries import csv_ingest
from shelfcast.functions import numbers, text
from shelfcast.operators.cleaning import explode_errors, to_bronze, to_silver
from shelfcast.operators.daily import gold_daily_sales, strict_daily_sales, type_transactions
from shelfcast.operators.quality import GOLD_GATES, QualityError, gold_quality, require_clean
from shelfcast.session import compile_wide_projections
from tests.helpers import day

ROWS = [
    ("2025-01-01", "1", "sku-01", "5", "12,5", "62.5", "5,0", "25"),
    ("2025-01-01", "2", "SKU-01", "-2", "12,5", "-25", "5,0", "-10"),
    ("2025-01-02", "3", "SKU-02", "1", "10", "10", "4", "4"),
]
BAD = ("bad-date", "1", "", "1", "not-a-number", "10", "5,0", "5")


def raw(spark, rows):
    frame = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in RAW_FIELD_NAMES))
    return frame.select(
        F.lit("b1").alias("batch_id"),
        F.lit("f.csv").alias("source_file"),
        F.monotonically_increasing_id().alias("source_row_number"),
        *RAW_FIELD_NAMES,
        F.current_timestamp().alias("ingested_at"),
    )


def silver(spark, rows):
    return to_silver(to_bronze(raw(spark, rows)))


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given, expected",
    [
        ("12,5", 12.5),
        ("1.234,5", 1234.5),
        ("62.5", 625.0),
        ("1d", None),
        ("nan", None),
        ("", None),
        ("\t7,5 ", 7.5),
        ("1 000,5", 1000.5),
        ("1\t000", None),
        ("-25", -25.0),
        ("+5", 5.0),
        ("1e3", 1000.0),
        ("inf", float("inf")),
        ("1,2,3", None),
        (None, None),
    ],
)
def test_vn_decimal(spark, given, expected):
    assert one(spark, given, text.vn_decimal) == expected


@pytest.mark.parametrize(
    "given, expected",
    [
        ("2025-09-05", day("2025-09-05")),
        ("2025-9-5", day("2025-09-05")),
        (" 2025-09-05", None),
        ("20250905", None),
        ("2025-02-30", None),
        ("2025-09-05 10:00", None),
    ],
)
def test_iso_date(spark, given, expected):
    assert one(spark, given, text.iso_date) == expected


def test_item_code_and_split(spark):
    assert one(spark, " sku- 01 ", text.item_code) == "SKU-01"
    assert one(spark, "  ", text.item_code) is None
    split = lambda c: F.array(numbers.positive_part(c.cast("double")), numbers.positive_part(-c.cast("double")))
    assert one(spark, "-3", split) == [0.0, 3.0]
    assert one(spark, None, split) == [None, None]


def test_wide_id(spark):
    assert one(spark, "SKU-1_x_validation", text.wide_id_item) == "SKU-1_x"
    assert one(spark, "SKU-1_other", text.wide_id_item) is None


def test_safe_ratio_and_median(spark):
    ratio = spark.range(1).select(numbers.safe_ratio(F.lit(1.0), F.lit(0.0)).alias("x")).first()["x"]
    assert ratio == 0.0

    def median(values, n):
        column = numbers.median_with_zeros(F.array(*[F.lit(float(v)) for v in values]), F.lit(n))
        return spark.range(1).select(column.alias("x")).first()["x"]

    assert median([2, 4, 6], 3) == 4.0
    assert median([2, 4, 6], 4) == 3.0
    assert median([2, 4, 6], 6) == 1.0
    assert median([2, 4, 6], 9) == 0.0


def test_gold_merges_spellings(spark):
    rows = {(r["date"], r["item_code"]): r for r in gold_daily_sales(silver(spark, ROWS)).collect()}
    assert len(rows) == 2
    first = rows[(day("2025-01-01"), "SKU-01")]
    assert (first["quantity_sold"], first["return_quantity"], first["net_quantity"]) == (5.0, 2.0, 3.0)
    assert first["transaction_count"] == 2
    assert first["sales_amount"] == 625.0 - 25.0
    assert first["avg_unit_price"] == 12.5


def test_bad_row_is_flagged_and_gate_raises(spark):
    flagged = silver(spark, [BAD])
    row = flagged.first()
    assert row["error_reason"] == "invalid_date;missing_item_code;invalid_unit_price"
    assert row["is_valid"] is False
    both = silver(spark, [*ROWS, BAD])
    with pytest.raises(QualityError, match="invalid_silver_rows"):
        require_clean(gold_quality(both, gold_daily_sales(both)), GOLD_GATES, "Data")
    clean = silver(spark, ROWS)
    report = require_clean(gold_quality(clean, gold_daily_sales(clean)), GOLD_GATES, "Data")
    assert (report["silver_rows"], report["gold_rows"], report["duplicate_gold_keys"]) == (3, 2, 0)


def test_gate_counts_surplus_rows(spark):
    gold = gold_daily_sales(silver(spark, ROWS))
    doubled = gold.unionByName(gold).unionByName(gold)
    assert gold_quality(silver(spark, ROWS), doubled).first()["duplicate_gold_keys"] == 4


def test_gold_is_deterministic(spark):
    first, second = (sorted(gold_daily_sales(silver(spark, ROWS)).collect()) for _ in range(2))
    assert first == second


def test_strict_and_loose_returns_differ(spark):
    # Negative quantity with a positive amount: a return only in the loose definition.
    row = ("2025-01-01", "1", "SKU-1", "-1", "5", "5", "2", "-2")
    assert silver(spark, [row]).first()["is_return"] is True
    frame = spark.createDataFrame([row], ", ".join(f"`{c}` string" for c in RAW_COLUMNS))
    typed = type_transactions(frame, "vn").first()
    assert typed["is_return"] is False and typed["return_qty"] == 0.0 and typed["profit"] == 7.0


def test_amount_inference(spark):
    schema = ", ".join(f"`{c}` string" for c in RAW_COLUMNS)
    plain = spark.createDataFrame([("2025-01-01", "1", "A", "2", "1,5", "62.5", "1", "10")], schema)
    assert type_transactions(plain).first()["sales_amount"] == 62.5
    mixed = plain.union(spark.createDataFrame([("2025-01-01", "2", "A", "x", "1,5", "1.000,5", "1", "10")], schema))
    assert sorted(r["sales_amount"] for r in type_transactions(mixed).collect()) == [625.0, 1000.5]
    total = strict_daily_sales(type_transactions(mixed)).first()
    assert (total["sales_qty"], total["line_count"]) == (2.0, 2)


def test_row_numbers_are_checked_without_a_shuffle_of_rows(spark, tmp_path):
    lines = [(k // 7 + 1, k % 5 + 1, k % 7 + 1, 1.0 + k % 9, 100.0 + k, 0.05, 0.02, "R" if k % 3 == 0 else "N", day("2001-01-01")) for k in range(70)]
    schema = "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate date"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = [(k, f"Brand#{k}", 10.0 + k) for k in range(1, 6)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    rows = csv_ingest(spark, str(tmp_path))
    assert "Exchange hashpartitioning(source_file" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [r["row_numbers_contiguous"] for r in rows.collect()] == [True] * 70


def test_row_numbers_are_checked_without_a_shuffle_of_rows(spark, tmp_path):
    lines = [(k // 7 + 1, k % 5 + 1, k % 7 + 1, 1.0 + k % 9, 100.0 + k, 0.05, 0.02, "R" if k % 3 == 0 else "N", day("2001-01-01")) for k in range(70)]
    schema = "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate date"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = [(k, f"Brand#{k}", 10.0 + k) for k in range(1, 6)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    rows = csv_ingest(spark, str(tmp_path))
    assert "Exchange hashpartitioning(source_file" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [r["row_numbers_contiguous"] for r in rows.collect()] == [True] * 70


def test_a_filter_on_silver_parses_no_field_again(spark):
    rows = silver(spark, [ROWS[0], ("bad", "2", "", "x", "1", "1", "1", "1")])

    def patterns(frame):
        return frame._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(")

    gold, errors = gold_daily_sales(rows), explode_errors(rows)
    assert patterns(gold) <= patterns(rows) and patterns(errors) <= patterns(rows)
    assert [(r["quantity_sold"], r["transaction_count"]) for r in gold.collect()] == [(5.0, 1)]
    assert sorted(r["reason"] for r in errors.collect()) == ["invalid_date", "invalid_quantity", "missing_item_code"]


ODD_TEXTS = [
    "12.345,67", "-12.345,67", "+5", "5", "-5", "0", "-0", "1d", "1f", "1D", "0x1p3", "0X1P3", "-0x1p3", "0 x.1p3", "0.x1", "nan", "NaN", "-nan", "inf",
    "-Infinity", "1e5", "1e+5", "1e400", "-1e-400", "1E5", "1e", "1,2,3", "1-2", "--5", "-", "", " ", ".", ",", ",5", "5,", ".5", "5.", "-,5", "-.5",
    " 5", "5 ", "\t5\t", "5\n", "5\n.", "5\n6", "1 000,5", "1\t000", ". \t5", "-.\t5", "1\x005", "\x005", "5\x00", "1\u00a0000", "\u00a05", "5\u2003",
    "\u0665", "1\u0665", "1\u06655", "5\u0665", "1_000", "n/a", "9" * 400, "0," + "1" * 40, "007", "12.34.56", "2 5 . 0,5 0", None,
]
ODD_DATES = [
    "2025-09-05", "2025-9-5", "2025-02-30", "2025-13-01", "2025", "2025-09", "2025-09-05T", "2025-09-05 10:00", "2025-9-5T1", " 2025-09-05", "2025-09-05 ",
    "2025-9-05 ", "2025-09-05\n", "+2025-09-05", "-2025-09-05", "02025-09-05", "10000-01-01", "+10000-01-01", "0001-01-01", "0000-01-01", "1-1-1",
    "2025-009-05", "05/09/2025", "20250905", "", "today", "epoch", "\u0662025-09-05", None,
]


def test_fields_equal_what_the_patterns_alone_give(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(ODD_TEXTS)], "i int, t string")
    by_pattern = lambda c: F.regexp_substr(c, F.lit(text.NUMBER_PATTERN)).try_cast("double")
    column, edged = F.col("t"), text.trimmed(F.col("t"))
    for given, expected in (
        (text.vn_decimal(column), by_pattern(F.translate(edged, ",. ", "."))),
        (text.plain_number(column), by_pattern(edged)),
    ):
        rows = texts.select("i", given.alias("given"), expected.alias("expected")).orderBy("i").collect()
        assert [(r["i"], repr(r["given"])) for r in rows] == [(r["i"], repr(r["expected"])) for r in rows]
    dates = spark.createDataFrame([(i, t) for i, t in enumerate(ODD_DATES)], "i int, t string")
    given, expected = text.iso_date(column), F.regexp_substr(column, F.lit(text.DATE_PATTERN)).try_cast("date")
    rows = dates.select("i", given.cast("string").alias("given"), expected.cast("string").alias("expected")).orderBy("i").collect()
    assert [(r["i"], r["given"]) for r in rows] == [(r["i"], r["expected"]) for r in rows]


def test_patterns_run_on_odd_fields_only(spark):
    plan = silver(spark, ROWS)._jdf.queryExecution().optimizedPlan().toString()
    # A pattern outside the branch for odd fields would run on every row.
    assert plan.count("ELSE try_cast(regexp_extract(") == plan.count("regexp_extract(") > 0


def test_amounts_as_text_around_the_thousands(spark):
    amounts = [0.0, 0.05, -0.05, 999.99, 999.996, 1000.0, -1005.5, 12_034.07, 999_999.99, 1_000_000.0, 1_234_567.89, None]
    expected = ["0,00", "0,05", "-0,05", "999,99", "1.000,00", "1.000,00", "-1.005,50", "12.034,07", "999.999,99", "1.000.000,00", "1.234.567,89", None]
    frame = spark.createDataFrame([(i, a) for i, a in enumerate(amounts)], "i int, amount double")
    rows = frame.select("i", transactions._vn_text(F.col("amount")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in rows] == expected


def test_wide_projections_are_split_up_in_any_session(spark):
    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    try:
        for given, kept in (("65535", "8000"), ("4000", "4000")):
            spark.conf.set("spark.sql.codegen.hugeMethodLimit", given)
            compile_wide_projections(spark)
            assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == kept
    finally:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", before)


def test_fields_that_are_no_numbers_are_told_without_a_failing_cast(spark):
    given = {
        "n/a": None, "": None, "0x1p3": None, "-0X1p3": None, "0.x1p3": None, "1x5": None, "1 0x1": None, "5d": None,
        "1e5": 1e5, "-1.234,50": -1234.5, "0,05": 0.05, " 12 ": 12.0, "12\n.": 12.0, "inf": float("inf"), "-": None,
    }
    frame = spark.createDataFrame(list(enumerate(given)), "i int, v string").select("i", text.vn_decimal(F.col("v")).alias("x"))
    assert [r["x"] for r in frame.orderBy("i").collect()] == list(given.values())
    # Only what the pattern takes is cast: a cast that fails makes an exception for each field.
    assert "RLIKE" in frame._jdf.queryExecution().analyzed().toString()
