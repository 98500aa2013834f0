from pyspark.sql import functions as F

from gleaner.functions import display


def test_wordings(spark):
    rows = spark.createDataFrame([("Soup", True, "owner", True), ("Pie", False, "user", False), ("", False, "user", None), (None, True, None, None)], "name string, m boolean, a string, o boolean")
    name, m = F.col("name"), F.col("m")
    got = rows.select(
        display.alt_text(name), display.aria_label(name), display.badge_visible(F.lit(True), name, m), display.caption(name, m), display.attribution_label(F.col("a")), display.opening(F.col("o")),
    ).collect()
    assert [tuple(r) for r in got] == [
        ("Soup", "View Soup", True, "Menu Match", "Management", "Open Now"), ("Pie", "View Pie", False, "Identified", "User", "Closed"),
        ("Restaurant photo", "View photo", False, "No dish identified", "User", None), ("Restaurant photo", "View photo", False, "No dish identified", "User", None),
    ]


def test_counts(spark):
    n = [F.lit(x) for x in (0, 1, 2, 3, 4)]
    row = spark.range(1).select(
        display.section_title(n[1], n[2]), display.section_title(n[1], n[0]), display.section_counts(n[0], n[1], n[2], n[4]), display.section_counts(n[1], n[1], n[2], n[4]),
        display.section_counts(n[2], n[1], n[2], n[4]), display.dish_count(n[1]), display.dish_count(n[2]), display.location_denied(F.lit("User DENIED it")), display.position_of(n[2], n[4]),
    ).first()
    assert tuple(row) == ("More Dishes", "Identified Dishes", "1 of 4 photos", "3 identified · 4 total", "4 total", "1 dish", "2 dishes", True, "3 / 4")
