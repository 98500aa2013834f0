"""What is shown beside an item or a section, as Columns. The wordings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(name: Column) -> Column:
    return F.coalesce(F.length(name) > 0, F.lit(False))


def alt_text(name: Column) -> Column:
    return F.when(named(name), name).otherwise("Restaurant photo")


def aria_label(name: Column) -> Column:
    return F.when(named(name), F.concat(F.lit("View "), name)).otherwise("View photo")


def label_visible(loaded: Column, name: Column) -> Column:
    return loaded & named(name)


def badge_visible(loaded: Column, name: Column, is_match: Column) -> Column:
    return label_visible(loaded, name) & is_match


def caption(name: Column, is_match: Column) -> Column:
    return F.when(~named(name), "No dish identified").when(is_match, "Menu Match").otherwise("Identified")


def attribution_label(attribution: Column) -> Column:
    return F.when(attribution == "owner", "Management").otherwise("User")


def section_title(bucket: Column, matched: Column) -> Column:
    """The title of the section of named items depends on whether there are matched ones."""
    return F.when(bucket == 1, F.when(matched > 0, "More Dishes").otherwise("Identified Dishes"))


def section_counts(bucket: Column, matched: Column, named_: Column, total: Column) -> Column:
    text = lambda x: x.cast("string")
    return (
        F.when(bucket == 0, F.concat(text(matched), F.lit(" of "), text(total), F.lit(" photos")))
        .when(bucket == 1, F.concat(text(matched + named_), F.lit(" identified · "), text(total), F.lit(" total")))
        .otherwise(F.concat(text(total), F.lit(" total")))
    )


def dish_count(n: Column) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, " dish").otherwise(" dishes"))


def opening(is_open: Column) -> Column:
    """Null where it is not known."""
    return F.when(is_open, "Open Now").when(~is_open, "Closed")


def location_denied(error: Column) -> Column:
    return F.contains(F.lower(error), F.lit("denied"))


def position_of(index: Column, total: Column) -> Column:
    """ "3 / 12" for index 2."""
    return F.concat((index + 1).cast("string"), F.lit(" / "), total.cast("string"))
