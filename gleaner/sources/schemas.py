"""Schemas of the records that are read; nothing is inferred."""

from __future__ import annotations

_NESTED_PLACE = "geometry struct<location: struct<lat: double, lng: double>>, rating double, user_ratings_total bigint, price_level int, opening_hours struct<open_now: boolean>"
PLACE_NEARBY = f"place_id string, name string, vicinity string, {_NESTED_PLACE}"
PLACE_DETAILS = f"place_id string, name string, formatted_address string, {_NESTED_PLACE}"
PHOTO = "photo_reference string, width int, height int, html_attributions array<string>"
REVIEW = "text string, rating double, author_name string"
DETAILS_RESPONSE = (
    "place_id string, result struct<photos: array<struct<photo_reference: string, width: int, height: int, html_attributions: array<string>>>, "
    "reviews: array<struct<text: string, rating: double, author_name: string>>>"
)
NEARBY_RESPONSE = (
    "results array<struct<place_id: string, name: string, vicinity: string, geometry: struct<location: struct<lat: double, lng: double>>, "
    "rating: double, user_ratings_total: bigint, price_level: int, opening_hours: struct<open_now: boolean>>>"
)
MENU_RESPONSE = "place_id string, menuItems array<struct<displayName: struct<text: string>>>"
BUSINESS = "id string, name string, alias string"
BUSINESS_REVIEWS = "business_id string, reviews array<struct<id: string, text: string, user: struct<name: string>>>"
BUSINESS_DETAIL = "business_id string, photos array<string>, categories array<struct<alias: string, title: string>>"
#: A recorded answer for one place: what was asked for, and the place, as it comes, under result; or a place that lies flat.
PLACE_RESPONSE = (
    f"{PLACE_DETAILS}, result struct<place_id: string, name: string, formatted_address: string, geometry: struct<location: struct<lat: double, lng: double>>, "
    "rating: double, user_ratings_total: bigint, price_level: int, opening_hours: struct<open_now: boolean>>"
)
