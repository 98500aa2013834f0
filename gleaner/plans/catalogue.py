"""Queries over the test tables, and the same in DuckDB SQL.

The tables hold no places, photos or reviews; other columns stand in for them: a document's source for a place, its text for a review,
lineitem rows for photos (upright where l_tax > l_discount), part names for a model's answers and a brand's names for a menu.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import display, numbers, text
from gleaner.operators import asof, labels, matching, phrases, places, ranking
from gleaner.operators.positions import zip_tables
from gleaner.operators.lexicon import Lexicon
from gleaner.sources import readers, recorded, schemas
from gleaner.streaming import sessions

#: Words that the documents do have, in the roles of the food lexicon.
STAND_IN = Lexicon(
    triggers=("of the ", "in the ", "and the ", "was the "),
    parts=("on", "er", "th", "ing"),
    stops=("the", "and", "it", "was", "i", "very", "of"),
    known=("a an", "be a"),
    praise=("of", "the", "and"),
)
PHOTO_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select(F.col("source").alias("place"), F.col("doc_id").alias("ord"), "text")


def phrase_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrase_weights(_reviews(spark, sf_dir), STAND_IN).select("place", "phrase", "weight", F.col("first.ord").alias("first_ord"), F.col("first.way").alias("first_way"))


def popular_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.popular_phrases(_reviews(spark, sf_dir), STAND_IN)
    return found.select("place", F.posexplode("names").alias("pos", "name"))


def phrase_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _read(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("phrase"))
    lexicon = Lexicon(triggers=(), parts=("blue", "green", "ring"), stops=("red", "large"), known=("small gear",))
    return names.select("p_partkey", "phrase", phrases.is_valid(F.col("phrase"), lexicon).alias("valid"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")
    return _read(spark, sf_dir, "documents").select("doc_id", words).where("word <> ''")


def lexicon_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.in_lexicon(_tokens(spark, sf_dir), "word", STAND_IN.stops).groupBy("doc_id").agg(F.count("*").alias("n"))


def lexicon_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.in_lexicon(_tokens(spark, sf_dir), "word", STAND_IN.stops, keep=False).groupBy("doc_id").agg(F.count("*").alias("n"))


def candidates_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select(*PHOTO_ORDER, (F.col("l_tax") > F.col("l_discount")).alias("portrait"))
    return ranking.candidates(rows, "l_suppkey", F.col("portrait"), PHOTO_ORDER).withColumn("l_shipdate", F.col("l_shipdate").cast("date").cast("string"))


def _menus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand's names of smaller parts, odd ones spelled otherwise, in order."""
    spelled = F.when(F.col("p_partkey") % 2 == 1, F.concat(F.lit(" "), F.upper("p_name"), F.lit(" "))).otherwise(F.col("p_name"))
    rows = _read(spark, sf_dir, "part").where("p_size <= 20").groupBy("p_brand", "p_name").agg(F.min_by(F.struct("p_partkey", spelled.alias("item")), "p_partkey").alias("s"))
    return rows.select("p_brand", F.col("s.p_partkey").alias("ord"), F.col("s.item").alias("item"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with names, matches and scores: popular are the five most frequent names of a supplier's candidates."""
    part = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    rows = candidates_top20(spark, sf_dir).join(part, "l_partkey")
    raw = F.when(F.col("l_partkey") % 7 == 0, "null").when(F.col("l_partkey") % 11 == 0, "").otherwise(F.col("p_name"))
    rows = matching.match_table(rows.withColumn("text", text.answer_text(raw)), _menus(spark, sf_dir), "p_brand")
    counts = rows.where("name is not null").groupBy("l_suppkey", F.lower(F.trim("name")).alias("phrase")).agg(F.count("*").alias("n"))
    top = F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "phrase"))), lambda s: s["phrase"]), 1, 5)
    popular = counts.groupBy("l_suppkey").agg(top.alias("popular"))
    rows = rows.join(popular, "l_suppkey", "left").withColumn("is_food", F.col("l_partkey") % 7 != 0)
    score = ranking.priority(F.col("name"), F.col("is_match"), F.col("is_food"), F.coalesce("popular", F.array().cast("array<string>")))
    return rows.withColumn("score", score)


def photo_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.rank(_scored(spark, sf_dir), "l_suppkey", "photo")
    return out.select("l_suppkey", "id", "position", "l_orderkey", "l_linenumber", "l_partkey", "name", "is_match", "score")


def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = photo_ranking(spark, sf_dir).withColumn("bucket", ranking.bucket(F.col("is_match"), F.col("name")))
    n = lambda b: F.count_if(F.col("bucket") == b)
    out = rows.groupBy("l_suppkey").agg(n(0).alias("matched"), n(1).alias("named"), n(2).alias("unnamed"), F.count("*").alias("total"))
    return out.withColumn("label", display.dish_count(F.col("total"))).withColumn("title", display.section_title(F.lit(1), F.col("matched"))).withColumn("counts", display.section_counts(F.lit(1), F.col("matched"), F.col("named"), F.col("total")))


def bucket_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three buckets one after the other: what was ranked by score is in that order already."""
    rows = photo_ranking(spark, sf_dir).withColumn("bucket", ranking.bucket(F.col("is_match"), F.col("name")))
    return rows.groupBy("l_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "position"))), lambda s: s["position"].cast("string")), ",").alias("positions"))


def reference_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    first = _read(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name", rank.alias("rank")).where(F.col("rank") <= matching.MOST_MENU)
    rows = first.groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda s: s["p_name"]).alias("names"))
    menu = F.when(F.col("p_brand").endswith("1"), F.array().cast("array<string>")).otherwise(F.col("names"))
    listed = matching.reference_list(menu, F.col("names"))
    return rows.select("p_brand", F.size(listed).alias("n"), text.numbered(listed).alias("lines"))


def menu_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.upper("p_name").alias("text"))
    return matching.match_table(rows, _menus(spark, sf_dir), "p_brand").select("p_partkey", "name", "is_match")


def popular_theta_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    popular = F.array(*map(F.lit, ("Red", "blue", "large", "old steel", "re")))
    names = _read(spark, sf_dir, "part").select("p_partkey", "p_name", matching.first_index(F.col("p_name"), popular).alias("idx"))
    return names


def caption_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("caption"))
    some = _read(spark, sf_dir, "part").select((-F.col("p_partkey")).alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.element_at(F.array(
        F.concat(F.lit("The "), "p_name"), F.concat(F.lit("We tried the "), "p_name", F.lit(", and it was good.")), F.concat(F.lit('They had "'), "p_name", F.lit('" there.')), F.lit("x"),
    ), (F.col("p_partkey") % 4 + 1).cast("int")).alias("caption"))
    return rows.unionByName(some).select("conv_id", "turn", text.caption_name(F.col("caption")).alias("name"))


def answer_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    raw = F.when(F.col("turn") == 1, " NULL \nx").when(F.col("turn") == 2, F.lit(None)).otherwise(F.concat(F.lit("  "), F.col("text")))
    return rows.select("conv_id", "turn", text.answer_text(raw).alias("answer"), text.answer_text(raw).isNotNull().alias("is_food"))


def attribution_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://maps.google.com/maps/contrib/"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    links = F.when(F.col("page_id") % 5 == 0, F.array().cast("array<string>")).when(F.col("page_id") % 9 == 0, F.array(link, F.lit("Downer"))).otherwise(F.array(link))
    return _read(spark, sf_dir, "pages").select("page_id", ranking.attribution(links).alias("attribution"))


def url_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return _read(spark, sf_dir, "pages").select("page_id", text.query_param(url, "page").alias("page"), text.query_param(url, "ref").alias("ref"), text.query_param(url, "utm_source").alias("utm_source"), text.uri_component(F.concat(F.lit("a b"), url)).alias("encoded"))


def place_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.search(places.flatten(_places(spark, sf_dir)), "tion_1", "id").select("id", "name", "address")


def place_search_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many searches at once: pieces of customers' names, some of one or two characters, over all suppliers."""
    text = F.substring("c_name", F.lit(-1) - F.col("c_custkey") % 6, F.col("c_custkey") % 6 + 1)
    asked = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request"), F.when(F.col("c_custkey") % 11 == 0, F.lit("nation_1")).when(F.col("c_custkey") % 13 == 0, "").otherwise(F.upper(text)).alias("text"))
    return places.search_each(asked, places.flatten(_places(spark, sf_dir)), "id")


def popular_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names against a table of each brand's popular phrases: some hold a name, some are held by one."""
    part = _read(spark, sf_dir, "part")
    phrase = F.when(F.col("p_size") % 3 == 0, F.split_part("p_name", F.lit(" "), F.lit(1))).when(F.col("p_size") % 3 == 1, F.concat(F.upper("p_name"), F.lit(" deluxe"))).otherwise(F.substring("p_name", 2, 2))
    listed = part.where("p_partkey % 40 = 7").select("p_brand", phrase.alias("item"), F.col("p_partkey").alias("ord"))
    return matching.first_containing(part.select("p_partkey", "p_brand", F.col("p_name").alias("text")), listed, "p_brand").select("p_partkey", F.col("idx").cast("long").alias("idx"))


def utf16_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with characters of two units among them."""
    name = F.concat(F.replace("p_name", F.lit("r"), F.lit("\U0001f35c")), F.when(F.col("p_size") % 2 == 0, "\u00e9").otherwise(""))
    return _read(spark, sf_dir, "part").select("p_partkey", text.units(name).alias("units"), text.first_units(name, 5).alias("start"))


def display_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    urls = [ranking.display_url("https://media.example.com/photo", reference, w).alias(f"url_{w}") for w in (400, 800)]
    return _read(spark, sf_dir, "part").select("p_partkey", *urls, text.mime_type(F.concat(F.lower("p_type"), F.lit("; q=1"))).alias("mime_type"), F.base64(F.col("p_name").cast("binary")).alias("data"))


def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return _read(spark, sf_dir, "events").select("event_id", k.alias("k"), F.coalesce(k, F.lit(0)).alias("k_or_zero"), F.to_json(F.struct(F.col("event_id").alias("id"), k.alias("k"))).alias("json"))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as nested places; their account balance stands for a rating."""
    rows = _read(spark, sf_dir, "supplier").join(_read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    at = F.struct((F.col("s_suppkey") % 90).cast("double").alias("lat"), (F.col("s_nationkey") * 7).cast("double").alias("lng"))
    return rows.select(
        F.col("s_suppkey").cast("string").alias("place_id"), F.when(F.col("s_suppkey") % 6 != 0, F.col("s_name")).otherwise(F.lit("")).alias("name"),
        F.when(F.col("s_suppkey") % 4 != 0, F.col("n_name")).alias("vicinity"), F.col("n_name").alias("formatted_address"),
        F.when(F.col("s_suppkey") % 10 != 0, F.struct(at.alias("location"))).alias("geometry"), (F.col("s_acctbal") / 1000).alias("rating"),
        F.col("s_suppkey").alias("user_ratings_total"), (F.col("s_suppkey") % 5).cast("int").alias("price_level"),
        F.struct(F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey") % 3 == 1).alias("open_now")).alias("opening_hours"),
    )


def place_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = places.flatten(_places(spark, sf_dir))
    flat = flat.withColumn("visible", ranking.stats_visible(F.col("rating"), F.col("priceLevel"), F.col("isOpen")))
    return flat.withColumn("isOpen", F.col("isOpen").cast("string"))


def place_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.pin(_places(spark, sf_dir))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    coordinate = lambda i: F.col("embedding")[i].cast("double")
    return _read(spark, sf_dir, "embeddings").select("vec_id", (coordinate(0) * 90).alias("lat"), (coordinate(1) * 180).alias("lng"))


def nearest_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.nearest(_points(spark, sf_dir), 10.0, 20.0, "vec_id").select("vec_id", F.round("distance", 3).alias("distance"))


def nearest_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    asked = points.select(F.col("vec_id").alias("request"), (F.col("lat") + 0.25).alias("lat"), (F.col("lng") - 0.25).alias("lng"))
    return places.nearest_each(asked, points, "vec_id").select("request", "vec_id", F.round("distance", 3).alias("distance"))


def within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.within(_points(spark, sf_dir), 10.0, 20.0, 1_000_000.0, "vec_id").select("vec_id", F.round("distance", 3).alias("distance"))


def within_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point as the centre of a map, at zooms from 7 to 11, over the points whose number is no multiple of three."""
    points = _points(spark, sf_dir)
    views = points.select(F.col("vec_id").alias("request"), "lat", "lng", (F.col("vec_id") % 5 + 7).alias("zoom"))
    stock = points.select("vec_id", "lat", "lng", F.when(F.col("vec_id") % 3 > 0, "restaurant").otherwise("bar").alias("kind"))
    return places.within_each(views, stock, "vec_id", kind="restaurant").select("request", "rank", "vec_id", F.round("distance", 3).alias("distance"))


def zoom_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    zoom = F.when(F.col("p_size") != 14, F.col("p_size") % 22)
    return _read(spark, sf_dir, "part").select("p_partkey", numbers.radius(zoom).alias("radius"))


def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.bounding_box(_points(spark, sf_dir))


def lateral_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    businesses = _read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("s_nationkey"), F.col("c_acctbal").alias("bal"), "c_custkey")
    rows = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return places.best_business(rows, businesses, "c_custkey", ["s_nationkey"], ["bal", "c_custkey"]).select("s_suppkey", "business_id")


def zip_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    name = F.when(F.length("text") % 3 != 0, F.col("text")).otherwise(F.lit(""))
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("url"), name.alias("name")))).alias("s"))
    zipped = ranking.zip_names(F.transform("s", lambda x: x["url"]), F.transform("s", lambda x: x["name"]))
    return lists.select("conv_id", F.explode(zipped).alias("z")).select("conv_id", "z.*")


def compact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor(F.col("o_totalprice") / 5).cast("long")
    return _read(spark, sf_dir, "orders").select("o_orderkey", numbers.count_header(n).alias("header"), numbers.count_sheet(n).alias("sheet"), numbers.count_header(F.col("o_orderkey") * 125).alias("ties"))


def price_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    on, off = numbers.price_marks(F.col("p_size") % 5)
    return _read(spark, sf_dir, "part").select("p_partkey", on.alias("marks"), off.alias("missing"), numbers.rating_text((F.col("p_size") % 21) / F.lit(4.0)).alias("rating"))


def clamp_prev_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, n = (F.col("event_id") % 20).cast("int"), F.lit(12)
    swipe = numbers.gesture(F.col("value") * 3 - 150, F.col("event_id") % 300 - 100)
    return _read(spark, sf_dir, "events").select("event_id", numbers.clamp(i - 1, n).alias("prev"), numbers.clamp(i + 1, n).alias("next"), swipe.alias("gesture"), numbers.parse_float(F.concat(F.col("event_id").cast("string"), F.lit("px"))).alias("parsed"))


def first_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.first_events(_read(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"]).select("user_id", "event_id")


def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = sessions.debounced(_read(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts", "10 minutes")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return runs.select("user_id", micros("first_at").alias("first_at"), micros("fires_at").alias("fires_at"), "n")


def label_fail_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade over recorded answers, made of part keys."""
    status = lambda k: F.element_at(F.array(*map(F.lit, (200, 429, 403, 500))), (F.floor(F.col("p_partkey") / k) % 4 + 1).cast("int"))
    raw = lambda k: F.when(F.col("p_partkey") % k == 0, "null").otherwise(F.upper("p_name"))
    answers = F.array(*[F.struct(status(k).alias("status"), raw(k + 2).alias("text")) for k in (1, 4)])
    rows = _read(spark, sf_dir, "part").select("p_partkey", answers.alias("answers"), F.array(F.col("p_name"), F.lit("Other")).alias("items"), (F.col("p_partkey") % 13 != 0).alias("fetched"))
    return labels.interpret(rows).select("p_partkey", "name", "is_match", "is_food")


def business_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _read(spark, sf_dir, "nation")
    rows = _read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.select("s_suppkey", F.col("n_name").alias("name"), (F.col("s_suppkey") % 90).cast("double").alias("lat"), (F.col("s_nationkey") * 7).cast("double").alias("lng"))
    near = _read(spark, sf_dir, "customer").where("c_acctbal > 0").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    near = near.select("c_custkey", F.concat(F.lit(" "), F.lower("n_name"), F.lit("\t")).alias("name"), (F.col("c_custkey") % 80).cast("double").alias("lat"), (F.col("c_acctbal") / 60).alias("lng"))
    return places.business_by_name(rows, near, "s_suppkey", "c_custkey").select("s_suppkey", "business_id")


def details_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as recorded responses, their orders as reviews; some have none."""
    review = F.struct(F.col("o_orderpriority").alias("text"), (F.col("o_orderkey") % 5).cast("double").alias("rating"))
    orders = _read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(review).alias("reviews"))
    rows = _read(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    texts = rows.select(F.to_json(F.struct(F.col("c_custkey").cast("string").alias("place_id"), F.struct("reviews").alias("result"))).alias("json"))
    found = readers.details_lists(readers.parsed(texts, "json", schemas.DETAILS_RESPONSE))
    said = F.array_join(F.array_sort(F.transform("reviews", lambda r: F.concat(r["text"], F.lit(":"), r["rating"].cast("int").cast("string")))), ",")
    return found.select("place_id", F.size("photos").alias("n_photos"), F.size("reviews").alias("n_reviews"), said.alias("reviews"))


def menu_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as recorded menus of up to two items, one of them blank at times; every seventh is no JSON."""
    item = lambda x: F.struct(F.struct(x.alias("text")).alias("displayName"))
    items = F.array(item(F.col("p_name")), item(F.when(F.col("p_size") % 3 == 0, F.lit(" \u00a0 ")).when(F.col("p_size") % 3 == 1, F.col("p_type"))))
    whole = F.to_json(F.struct(F.col("p_partkey").cast("string").alias("place_id"), F.when(F.col("p_size") % 5 > 0, items).alias("menuItems")))
    texts = _read(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 7 > 0, whole).otherwise("not json").alias("json"))
    found = readers.menu_items(readers.parsed(texts, "json", schemas.MENU_RESPONSE))
    return found.select("place_id", F.size("items").alias("n"), F.array_join("items", "|").alias("items"))


def dishes_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested response of each supplier, flat enough to compare: its ranked photos, and its name as the only popular one."""
    dishes = photo_ranking(spark, sf_dir).select("l_suppkey", "position", "id", "name")
    names = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("place"), F.array("s_name").alias("names"))
    nested = readers.response(dishes, names, "l_suppkey")
    shown = F.array_join(F.transform("dishes", lambda d: F.concat(d["id"], F.lit("="), F.coalesce(d["name"], F.lit("")))), "|")
    return nested.select("l_suppkey", F.size("dishes").alias("n"), shown.alias("dishes"), F.array_join("popularDishes", "|").alias("popular"))


def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    first = _read(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name", rank.alias("rank")).where("rank <= 3")
    rows = first.groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda s: s["p_name"]).alias("names"))
    none = F.array().cast("array<string>")
    menu = F.when(F.substring("p_brand", -1, 1).isin("1", "3"), none).otherwise(F.col("names"))
    popular = F.when(F.endswith("p_brand", F.lit("3")), none).otherwise(F.slice("names", 1, 2))
    return rows.select("p_brand", labels.prompt(F.col("p_brand"), menu, popular, matching.reference_list(menu, popular)).alias("prompt"))


def place_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "supplier")
    given = F.when(F.col("s_suppkey") % 3 == 0, "").when(F.col("s_suppkey") % 3 == 1, F.col("s_name"))
    return rows.select("s_suppkey", places.place_key(given, F.col("s_suppkey").cast("string")).alias("key"), places.coordinate((F.col("s_suppkey") % 4).cast("double"), 40.5).alias("lat"))


def display_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, F.col("p_name"))
    loaded, matched, is_open = F.col("p_size") % 2 == 0, F.col("p_size") % 5 < 2, F.when(F.col("p_size") % 4 > 0, F.col("p_size") % 4 == 1)
    return _read(spark, sf_dir, "part").select(
        "p_partkey", display.alt_text(name).alias("alt"), display.aria_label(name).alias("aria"), display.label_visible(loaded, name).alias("label"), display.badge_visible(loaded, name, matched).alias("badge"),
        display.caption(name, matched).alias("caption"), display.attribution_label(F.when(matched, "owner").otherwise("user")).alias("attribution"), display.opening(is_open).alias("opening"),
        display.location_denied(F.concat(F.lit("User "), F.upper("p_name"), F.when(matched, " Denied it").otherwise(""))).alias("denied"), display.position_of(F.col("p_size"), F.lit(60)).alias("position"),
        ranking.stats_visible_sheet(F.when(loaded, F.col("p_size")), F.when(matched, F.col("p_size"))).alias("stats"),
    )


def route_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = lambda n, c: F.when(F.col("event_id") % n == 0, "").when(F.col("event_id") % n == 1, F.lit(None)).otherwise(c)
    text = F.col("value").cast("string")
    return _read(spark, sf_dir, "events").select("event_id", readers.routed(some(4, F.col("event_type")), some(3, text), some(5, text)).alias("route"))


def raw_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" \u00a0"), F.upper(F.replace("p_name", F.lit(" "), F.lit(" \n "))), F.lit("\t"))
    lexicon = Lexicon(triggers=(), parts=("blue", "green", "ring"), stops=("red", "large"), known=("small gear",))
    return _read(spark, sf_dir, "part").select("p_partkey", phrases.is_valid(raw, lexicon).alias("valid"))


def fresh_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    return sessions.fresh(_read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz")), "ts", now, 3600).select("event_id")


def names_with_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").where(matching.holds_any(F.col("p_name"), ("gear", "old"))).select("p_partkey", "p_name")


def label_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As label_fail_open, but each model is asked by a call, the second only where the first failed."""
    status = lambda k: F.element_at(F.array(*map(F.lit, (200, 429, 403, 500))), (F.floor(F.col("p_partkey") / k) % 4 + 1).cast("int"))
    rows = _read(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("shown"), status(1).alias("first"), status(4).alias("second"), F.array(F.col("p_name"), F.lit("Other")).alias("items"), (F.col("p_partkey") % 13 != 0).alias("fetched"))
    models = [lambda r: (r["first"], "null" if r["p_partkey"] % 3 == 0 else r["shown"]), lambda r: (r["second"], "null" if r["p_partkey"] % 6 == 0 else r["shown"])]
    return labels.label_staged(rows, models).select("p_partkey", "name", "is_match", "is_food")


def asof_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase or view the last click of any user of its tenth of users, an hour old at most."""
    rows = _read(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value", (F.col("user_id") % 10).alias("team"))
    asked, given = rows.where("event_type in ('purchase', 'view')").select("event_id", "ts", "team"), rows.where("event_type = 'click'")
    found = asof.last_before(asked, given, "team", "ts", 3600, "event_id", ["value"])
    return found.select("event_id", F.coalesce(F.unix_micros(F.col("fix_at").cast("timestamp")), F.lit(-1)).alias("fix_at"), "value")


def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's suppliers, in order, with its customers by their balance, place by place."""
    left = _read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey")
    right = _read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_acctbal", "c_custkey")
    return zip_tables(left, right, ["s_suppkey"], [F.desc("c_acctbal"), "c_custkey"], ["nation"]).select("nation", F.col("pos").cast("long").alias("pos"), "s_suppkey", F.coalesce("c_custkey", F.lit(-1)).alias("c_custkey"))


def recorded_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as recorded answers, read back for a few ids by the data source, which opens their buckets alone."""
    flat = _places(spark, sf_dir)
    whole = flat.select("place_id", F.to_json(F.struct(*[c for c in flat.columns if c != "place_id"])).alias("result"))
    path = recorded.record(whole)
    wanted = [str(10 * k) for k in range(10)]
    lines = recorded.read(spark, path).where(F.col("place_id").isin(*wanted))
    answers = lines.select("place_id", F.from_json(F.get_json_object(F.concat(F.lit('{"r":'), "result", F.lit("}")), "$.r"), schemas.PLACE_DETAILS).alias("r"))
    return answers.select("place_id", "r.name", F.col("r.formatted_address").alias("address"), F.col("r.rating").alias("rating"))


def details_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details as they are recorded, under result, every fifth without one, as flat places with the long address."""
    rows = _places(spark, sf_dir).withColumn("k", F.col("place_id").cast("int"))
    result = F.struct("name", "formatted_address", "geometry", "rating", "user_ratings_total", "price_level", "opening_hours")
    texts = rows.select(F.to_json(F.struct("place_id", F.lit("OK").alias("status"), F.when(F.col("k") % 5 > 0, result).alias("result"))).alias("json"))
    flat = places.flatten(readers.details_of(readers.parsed(texts, "json", schemas.PLACE_RESPONSE)), "formatted_address")
    return flat.withColumn("isOpen", F.col("isOpen").cast("string"))


def request_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for suppliers by id, some bad, some for what is not there, some that failed."""
    rows = _read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 > 0, (F.col("c_custkey") % 130).cast("string")).alias("id"))
    asked = rows.select(F.col("c_custkey").alias("request"), readers.routed(F.col("id"), F.lit(None).cast("string"), F.lit("1")).alias("route"), "id")
    stock = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"))
    found = asked.join(stock, "id").select("request", "name")
    return readers.answers(asked, found, asked.where("request % 10 = 3").select("request"))


def business_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Businesses by name, of the categories that a restaurant's search asks for."""
    nation = _read(spark, sf_dir, "nation")
    rows = _read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.select("s_suppkey", F.col("n_name").alias("name"), (F.col("s_suppkey") % 90).cast("double").alias("lat"), (F.col("s_nationkey") * 7).cast("double").alias("lng"))
    kinds = F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.array(F.lit("bars"), F.lit("food"))).when(F.col("c_mktsegment") == "MACHINERY", F.array(F.lit("restaurants"))).otherwise(F.array(F.lit("shops")))
    near = _read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    near = near.select("c_custkey", F.col("n_name").alias("name"), (F.col("c_custkey") % 80).cast("double").alias("lat"), (F.col("c_acctbal") / 60).alias("lng"), kinds.alias("categories"))
    return places.business_by_name(rows, near, "s_suppkey", "c_custkey", places.FOOD_CATEGORIES).select("s_suppkey", F.coalesce("business_id", F.lit(-1)).alias("business_id"))


def business_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as businesses, their orders as reviews, of which the first twenty give names to 25 photos."""
    said = F.when(F.col("o_orderkey") % 4 == 0, F.lit("ok")).otherwise(F.concat(F.lit("The "), F.lower("o_orderpriority")))
    reviews = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("business_id"), F.col("o_orderkey").alias("ord"), said.alias("text"))
    urls = F.transform(F.sequence(F.lit(1), F.lit(25)), lambda i: F.concat(F.lit("u"), i.cast("string")))
    details = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("business_id"), urls.alias("photos"))
    return readers.business_photos(details, reviews).select("business_id", "pos", "url", "name", "attribution")


def json_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deep paths of records that differ in shape: numbers as texts, lists for values, and texts that are no JSON."""
    k = F.get_json_object("props", "$.k")
    shape = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"a":[{"b":'), k, F.lit('},{"b":7}]}'))).when(F.col("event_id") % 5 == 1, F.concat(F.lit('{"a":[{"b":"x'), k, F.lit('"}]}')))
    shape = shape.when(F.col("event_id") % 5 == 2, F.lit('{"a":{"b":1},"c":"t"}')).when(F.col("event_id") % 5 == 3, F.lit("{no json")).otherwise(F.concat(F.lit('{"a":[],"c":"v'), k, F.lit('"}')))
    found = readers.at_paths(shape, {"$.a[0].b": "int", "$.a[1].b": "int", "$.c": "string"})
    first, second, c = found.values()
    return _read(spark, sf_dir, "events").select("event_id", first.cast("string").alias("first"), second.cast("string").alias("second"), c.alias("c"), F.coalesce(first, F.lit(0)).alias("or_zero"))


QUERIES = {
    f.__name__: f
    for f in (
        popular_phrases, phrase_weights, phrase_validity, lexicon_semi, lexicon_anti, candidates_top20, photo_ranking, bucket_counts, bucket_order, reference_prefix,
        menu_first_match, popular_theta_match, caption_names, answer_parse, attribution_class, url_params, display_urls, json_extract, place_flatten, place_pins,
        nearest_place, nearest_each, within_radius, zoom_radius, bounding_box, lateral_top1, zip_positional, compact_counts, price_marks, clamp_prev_next, first_event,
        debounce_sessions, label_fail_open, place_search, business_by_name, details_children, menu_items, dishes_response, prompt_text, place_keys, display_labels, route_requests,
        raw_phrases, fresh_events, names_with_parts, place_search_each, popular_first_match, utf16_units, within_each,
        label_cascade, asof_fix, positional_join, recorded_details, details_answers, request_answers, business_category, business_photos, json_variant,
    )
}
