from pyspark.sql import functions as F

from gleaner.functions import numbers


def test_compact_counts(spark):
    cases = [(999, "999", "999"), (1000, "1.0k", "1.0k"), (1250, "1.3k", "1.3k"), (1450, "1.4k", "1.4k"), (9999, "10.0k", "10.0k"), (10500, "11k", "10.5k"), (12500, "13k", "12.5k"), (1234567, "1235k", "1234.6k")]
    rows = spark.createDataFrame(cases, "n long, header string, sheet string")
    got = rows.select("*", numbers.count_header(F.col("n")).alias("h"), numbers.count_sheet(F.col("n")).alias("s")).collect()
    assert [r for r in got if (r["h"], r["s"]) != (r["header"], r["sheet"])] == []


def test_counts_against_exact_decimals(spark):
    from decimal import ROUND_HALF_UP, Decimal

    rows = spark.range(1000, 60000, 7).union(spark.range(1250, 60000, 250)).select("id", numbers.count_header(F.col("id")).alias("h")).collect()
    for r in rows:
        digits = "1" if r["id"] >= 10000 else "0.1"
        assert r["h"] == f"{Decimal(r['id'] / 1000).quantize(Decimal(digits), ROUND_HALF_UP)}k"


def test_radius_by_zoom(spark):
    want = {9: 50000, 10: 40000, 14: 2500, 16: 625, 17: 313, 18: 300, None: 2500}
    rows = spark.createDataFrame([(z, r) for z, r in want.items()], "z int, r int").select("r", numbers.radius(F.col("z")).alias("got")).collect()
    assert all(r["r"] == r["got"] for r in rows)


def test_small_ones(spark):
    row = spark.range(1).select(
        numbers.clamp(F.lit(-1), F.lit(5)).alias("a"), numbers.clamp(F.lit(9), F.lit(5)).alias("b"), numbers.price_marks(F.lit(3))[0].alias("c"), numbers.price_marks(F.lit(3))[1].alias("d"),
        numbers.parse_float(F.lit("1.5e1x")).alias("e"), F.isnan(numbers.parse_float(F.lit("x1"))).alias("f"), numbers.gesture(F.lit(10), F.lit(200)).alias("g"), numbers.gesture(F.lit(-70), F.lit(0)).alias("h"),
        numbers.rating_text(F.lit(4.25)).alias("i"), numbers.rating_text(F.lit(4.0)).alias("j"),
    ).first()
    assert tuple(row) == (0, 4, "$$$", "$", 15.0, True, "close", "next", "4.3", "4.0")
