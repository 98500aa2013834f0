"""Scans of recorded responses and of media bytes, and the nested results that are written.

Every reader names its schema and reads what does not fit as null, never failing; what is missing is empty.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions.text import caption_name, js_trim, mime_type
from gleaner.operators.ranking import zip_names
from gleaner.sources import schemas


def setting(spark: SparkSession, name: str, default: str | None = None) -> str | None:
    """A setting of the session, gleaner.<name>, or its default."""
    return spark.conf.get(f"gleaner.{name}", default)


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def nearby(spark: SparkSession, path: str) -> DataFrame:
    """ord and the nested places of recorded searches, in their order."""
    rows = _json(spark, path, schemas.NEARBY_RESPONSE).select(F.posexplode("results").alias("ord", "place"))
    return rows.select("ord", "place.*")


def details(spark: SparkSession, path: str, place_id: str | None = None) -> DataFrame:
    """The nested places of recorded answers, each under `result` (or flat); an answer without one has no place."""
    rows = details_of(_json(spark, path, schemas.PLACE_RESPONSE))
    return rows if place_id is None else rows.where(F.col("place_id") == place_id)


def details_of(responses: DataFrame) -> DataFrame:
    """The places of answers of schemas.PLACE_RESPONSE, under result or flat. The id is the answer's own, else the one that it was asked for."""
    fields = [c for c in responses.columns if c != "result"]
    return responses.select(*[F.coalesce(f"result.{c}", c).alias(c) for c in fields]).where("name is not null or formatted_address is not null or geometry is not null")


def photos(spark: SparkSession, path: str) -> DataFrame:
    rows = _json(spark, path, schemas.DETAILS_RESPONSE).select("place_id", F.posexplode("result.photos").alias("ord", "photo"))
    return rows.select("place_id", "ord", "photo.*")


def reviews(spark: SparkSession, path: str) -> DataFrame:
    """place, ord and text, as phrases.* take them, with rating and author_name."""
    rows = _json(spark, path, schemas.DETAILS_RESPONSE).select(F.col("place_id").alias("place"), F.posexplode("result.reviews").alias("ord", "review"))
    return rows.select("place", "ord", "review.*")


def parsed(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Responses from a column of JSON texts; what does not fit is null."""
    return rows.select(F.from_json(column, schema, {"mode": "PERMISSIVE"}).alias("_response")).select("_response.*")


def details_lists(responses: DataFrame) -> DataFrame:
    """place_id, photos and reviews of each response of schemas.DETAILS_RESPONSE: a place without photos or reviews has empty lists."""
    kept = lambda c: F.coalesce(F.col(f"result.{c}"), F.array().cast(responses.select(f"result.{c}").schema[0].dataType)).alias(c)
    return responses.select("place_id", kept("photos"), kept("reviews"))


def menus(spark: SparkSession, path: str) -> DataFrame:
    """place_id and items: the texts of its menu that are not blank, empty if there is none."""
    return menu_items(_json(spark, path, schemas.MENU_RESPONSE))


def menu_items(responses: DataFrame) -> DataFrame:
    items = F.filter(F.transform("menuItems", lambda i: i["displayName"]["text"]), lambda t: t.isNotNull() & (F.length(js_trim(t)) > 0))
    return responses.select("place_id", F.coalesce(items, F.array().cast("array<string>")).alias("items"))


def media(spark: SparkSession, path: str, types: DataFrame | None = None) -> DataFrame:
    """path, data (base64) and mime_type of media files. types: path and content_type as they were recorded; without it, or where it has none,
    the file's extension tells the type."""
    rows = spark.read.format("binaryFile").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    named = F.when(kind == "png", "image/png").when(kind == "webp", "image/webp").when(kind == "gif", "image/gif")
    if types is not None:
        rows = rows.join(types.select("path", F.col("content_type").alias("_type")), "path", "left")
        named = F.coalesce("_type", named)
    return rows.select("path", F.base64("content").alias("data"), mime_type(named).alias("mime_type"))


def businesses(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.BUSINESS)


def business_details(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.BUSINESS_DETAIL)


#: Reviews of a business that are asked for, and used.
MOST_REVIEWS = 20


def first_reviews(reviews: DataFrame, key: str = "business_id", order: str = "ord", most: int = MOST_REVIEWS) -> DataFrame:
    """The first reviews of each business in the order they were sorted in; the limit works before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return reviews.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def business_photos(details: DataFrame, reviews: DataFrame, place: str = "business_id") -> DataFrame:
    """pos, url, name and attribution of each business's photos: the n-th with the name that its n-th review with one gives, of the first reviews."""
    told = first_reviews(reviews, place).withColumn("name", caption_name(F.col("text")))
    names = told.groupBy(place).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda s: F.coalesce(s["name"], F.lit(""))).alias("names"))
    rows = details.select(place, "photos").join(names, place, "left")
    zipped = zip_names(F.col("photos"), F.coalesce("names", F.array().cast("array<string>")))
    return rows.select(place, F.explode(zipped).alias("z")).select(place, "z.*")


def business_reviews(spark: SparkSession, path: str) -> DataFrame:
    rows = _json(spark, path, schemas.BUSINESS_REVIEWS).select("business_id", F.posexplode("reviews").alias("ord", "review"))
    return rows.select("business_id", "ord", F.col("review.text").alias("text"))


class RequestError(ValueError):
    """A request that cannot be answered; status is 400 for a bad one, 404 where nothing is found."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def route(params: Mapping[str, str | None]) -> tuple[str, tuple]:
    """Which lookup a request asks for: by place_id, or else by both coordinates."""
    if params.get("placeId"):
        return "details", (params["placeId"],)
    if params.get("lat") and params.get("lng"):
        return "nearby", (params["lat"], params["lng"])
    raise RequestError(400, "give placeId, or lat and lng")


def routed(place_id: Column, lat: Column, lng: Column) -> Column:
    """As route, for rows of requests: details, nearby, or bad (answered with 400)."""
    given = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    return F.when(given(place_id), "details").when(given(lat) & given(lng), "nearby").otherwise("bad")


#: What is answered besides 200.
ERRORS = {400: "bad request", 404: "not found", 500: "failed"}


def answers(requests: DataFrame, found: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """request, status and body (JSON) of each request (request, and route as of routed): 400 for a bad one, 500 for one of `failed` (request),
    404 where `found` has no row of it, else 200 with that row's other columns. Requests repeat in the result as they do in the input."""
    columns = [c for c in found.columns if c != "request"]
    bodies = found.groupBy("request").agg(F.min(F.to_json(F.struct(*columns))).alias("_body"))
    out = requests.select("request", "route").join(bodies, "request", "left")
    broke = F.lit(False)
    if failed is not None:
        out = out.join(failed.select("request", F.lit(True).alias("_failed")).distinct(), "request", "left")
        broke = F.coalesce("_failed", F.lit(False))
    status = F.when(F.col("route") == "bad", 400).when(broke, 500).when(F.col("_body").isNull(), 404).otherwise(200)
    error = F.coalesce(*[F.when(F.col("status") == s, F.to_json(F.struct(F.lit(m).alias("error")))) for s, m in ERRORS.items()])
    return out.withColumn("status", status).select("request", "status", F.coalesce(error, "_body").alias("body"))


def at_paths(text: Column, paths: Mapping[str, str]) -> dict[str, Column]:
    """Values at deep paths of JSON texts, as VARIANT: path to type. A text that is no JSON, a path that is not there, and a value that is
    no such type are null, each for itself, so records may differ in shape."""
    parsed_ = F.try_parse_json(text)
    return {path: F.try_variant_get(parsed_, path, kind) for path, kind in paths.items()}


def response(dishes: DataFrame, phrases: DataFrame, key: str, most: int = 20) -> DataFrame:
    """One nested row for each key: dishes (by position, at most `most`) and popularDishes."""
    some = dishes.where(F.col("position") < most)
    columns = [c for c in some.columns if c != key]
    nested = some.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", *[c for c in columns if c != "position"]))).alias("dishes"))
    out = nested.join(phrases.select(F.col("place").alias(key), F.col("names").alias("popularDishes")), key, "full")
    return out.select(key, F.coalesce("dishes", F.array().cast(nested.schema["dishes"].dataType)).alias("dishes"), F.coalesce("popularDishes", F.array().cast("array<string>")).alias("popularDishes"))


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def model_names(text: str, parts: tuple[str, ...]) -> list[str]:
    """Of a recorded list of models, the names that hold any of some parts."""
    return [m["name"] for m in json.loads(text).get("models", []) if any(p in m.get("name", "") for p in parts)]
