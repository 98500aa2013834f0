"""The catalogue's queries in DuckDB SQL."""

from __future__ import annotations

from gleaner.functions.text import CAPTION_PATTERNS, JS_SPACE, S
from gleaner.plans.catalogue import STAND_IN

_text = lambda s: "'" + s.replace("'", "''") + "'"
_list = lambda xs: "[" + ", ".join(map(_text, xs)) + "]"
_L = STAND_IN

#: RE2 has no look-ahead: what must follow is matched too, outside the group that is taken.
_MENTIONS = rf"""
    docs as (select source place, doc_id ord, lower(coalesce(text, '')) t from documents),
    triggers(j, g) as (values {", ".join(f"({i}, {_text(t)})" for i, t in enumerate(_L.triggers))}),
    parts as (select place, ord, j, g, t, string_split(t, g) p from docs, triggers where contains(t, g)),
    hits as (select place, ord, j, i - 1 occ, t, list_sum(list_transform(p[1:i], lambda x: length(x))) + i * length(g) pos
             from (select *, unnest(range(1, len(p))) i from parts)),
    windows as (select place, ord, j, occ, substr(t, cast(pos as bigint) + 1, 60) w from hits),
    first_way as (select place, ord, 1 way, j, occ, 1 weight, coalesce(
            nullif(regexp_extract(w, '^([a-z]+(?:\s+[a-z]+){{0,3}})(?:[.,!?;:\n]|$|\s{{2}})', 1), ''),
            regexp_extract(w, '^([a-z]+(?:\s+[a-z]+){{0,2}})', 1)) raw from windows),
    quotes as (select place, ord, regexp_extract_all(t, '["'']([a-z][a-z\s]{{2,30}})["'']', 1) m from docs),
    praises as (select place, ord, regexp_extract_all(t, '([a-z]+(?:\s+[a-z]+){{0,3}})\s+(?:is|was|are|were)\s+(?:{"|".join(_L.praise)})', 1) m from docs),
    ways as (select * from first_way
        union all select place, ord, 2, 0, i - 1, 3, m[i] from (select *, unnest(range(1, len(m) + 1)) i from quotes)
        union all select place, ord, 3, 0, i - 1, 2, m[i] from (select *, unnest(range(1, len(m) + 1)) i from praises)),
    mentions as (select place, ord, way, j, occ, weight, trim(regexp_replace(regexp_replace(regexp_replace(
            trim(raw, e' \t\n\r'), '[.,!?;:()"'']+$', ''), '^[''"(]+', ''), '\s+', ' ', 'g')) phrase from ways),
    valid as (select * from mentions where len(string_split(phrase, ' ')) between 1 and 5 and length(phrase) between 3 and 40
        and not regexp_matches(phrase, '^[0-9]') and not list_has_any(string_split(phrase, ' '), {_list(_L.stops)})
        and (phrase in ({", ".join(map(_text, _L.known))}) or {" or ".join(f"contains(phrase, {_text(p)})" for p in _L.parts)})),
    weights as (select place, phrase, sum(weight) weight, min(struct_pack(ord := ord, way := way, j := j, occ := occ)) first from valid group by all)"""

_CANDIDATES = """
    candidates as (select * from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d') l_shipdate, l_tax > l_discount portrait,
        row_number() over (partition by l_suppkey order by l_tax > l_discount, l_orderkey, l_linenumber, l_partkey, l_suppkey, lineitem.l_shipdate)::int candidate
        from lineitem) where candidate <= 20)"""

_MENUS = """
    menus as (select p_brand, min(p_partkey) ord, arg_min(case when p_partkey % 2 = 1 then ' ' || upper(p_name) || ' ' else p_name end, p_partkey) item
              from part where p_size <= 20 group by p_brand, p_name),
    firsts as (select p_brand, trim(lower(item)) normal, arg_min(item, ord) item from menus group by all)"""

_SCORED = f"""{_CANDIDATES}, {_MENUS},
    answers as (select c.*, p_brand, case when l_partkey % 7 = 0 or l_partkey % 11 = 0 then null else p_name end answer from candidates c join part on l_partkey = p_partkey),
    named as (select a.*, coalesce(item, answer) as name, item is not null is_match from answers a left join firsts f on a.p_brand = f.p_brand and lower(answer) = normal),
    counts as (select l_suppkey, lower(trim(name)) phrase, count(*) n from named where name is not null group by all),
    popular as (select l_suppkey, list(phrase order by n desc, phrase)[1:5] popular from counts group by all),
    indexed as (select n.*, coalesce(list_position(list_transform(popular, lambda p: contains(lower(p), lower(n.name)) or contains(lower(n.name), lower(p))), true), 0) - 1 idx
                from named n left join popular using (l_suppkey)),
    scored as (select *, case when l_partkey % 7 = 0 then -1 when name is null then 5 when is_match and idx >= 0 then 100 + greatest(0, 8 - idx)
               when is_match then 50 when idx >= 0 then 30 + greatest(0, 8 - idx) else 10 end score from indexed),
    ranked as (select *, row_number() over (partition by l_suppkey order by score desc, candidate)::int - 1 as position from scored where score >= 0)"""

_DISTANCE = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians({lat} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({lat})) * pow(sin(radians({lng} - {b}) / 2), 2))))"
_HERE = _DISTANCE.format(lat="lat", lng="lng", a="10.0", b="20.0")
_POINTS = "points as (select vec_id, embedding[1]::double * 90 lat, embedding[2]::double * 180 lng from embeddings)"

_PLACES = """
    places as (select s_suppkey k, cast(s_suppkey as varchar) place_id, case when s_suppkey % 6 <> 0 then s_name else '' end as name,
        case when s_suppkey % 4 <> 0 then n_name end vicinity, n_name, s_suppkey % 10 <> 0 located, (s_suppkey % 90)::double lat, (s_nationkey * 7)::double lng,
        s_acctbal / 1000 rating, (s_suppkey % 5)::int price, case when s_suppkey % 3 <> 0 then s_suppkey % 3 = 1 end open_now
        from supplier join nation on s_nationkey = n_nationkey)"""


def _thousands(n: str, digits: int) -> str:
    tie = f"case when {n} % 1000 = 250 then {n} + 50 else {n} end" if digits else f"case when {n} % 2000 = 500 then {n} + 500 else {n} end"
    return f"printf('%.{digits}f', ({tie}) / 1000.0::double) || 'k'"


def _header(n: str) -> str:
    return f"case when {n} >= 10000 then {_thousands(n, 0)} when {n} >= 1000 then {_thousands(n, 1)} else cast({n} as varchar) end"


_N = "cast(floor(o_totalprice / 5) as bigint)"


def _caption() -> str:
    found = []
    for p in CAPTION_PATTERNS:
        # RE2 knows fewer spaces by name; the test tables have none of the others.
        ours = p.replace(S, r"[\s\x0B]").replace(JS_SPACE, r"\s\x0B")
        x = f"trim(regexp_extract(caption, {_text(ours)}, 1), e' \\t\\n\\r')"
        found.append(f"case when length({x}) between 3 and 39 then {x} end")
    short = r"regexp_replace(trim(caption, e' \t\n\r'), '(?i)^(the|a|an)\s+', '')"
    own = f"case when length(caption) < 50 and not contains(caption, '.') and length({short}) between 3 and 39 then {short} end"
    return f"case when length(caption) >= 3 then coalesce({own}, {', '.join(found)}) end"


_TITLE = "array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"

ORACLES = {
    "phrase_weights": f"with {_MENTIONS} select place, phrase, cast(weight as bigint) weight, first.ord first_ord, first.way first_way from weights",
    "popular_phrases": f"""with {_MENTIONS},
        ranked as (select place, list(phrase order by weight desc, first) names from weights group by all),
        folded as (select place, list_reduce(list_transform(names, lambda x: [x]), lambda a, x: case when len(a) >= 8
            or len(list_filter(a, lambda e: contains(e, x[1]) or contains(x[1], e))) > 0 then a else list_concat(a, x) end) kept from ranked)
        select place, cast(i - 1 as int) pos, {_TITLE.format(x="kept[i]")} as name from (select place, kept, unnest(range(1, len(kept) + 1)) i from folded)""",
    "phrase_validity": """select p_partkey, lower(p_name) phrase, len(string_split(lower(p_name), ' ')) between 1 and 5 and length(p_name) between 3 and 40
        and not regexp_matches(lower(p_name), '^[0-9]') and not list_has_any(string_split(lower(p_name), ' '), ['red', 'large'])
        and (lower(p_name) = 'small gear' or regexp_matches(lower(p_name), 'blue|green|ring')) valid from part""",
    "lexicon_semi": f"""select doc_id, count(*) n from (select doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) word from documents)
        where word in ({", ".join(map(_text, _L.stops))}) group by all""",
    "lexicon_anti": f"""select doc_id, count(*) n from (select doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) word from documents)
        where word <> '' and word not in ({", ".join(map(_text, _L.stops))}) group by all""",
    "candidates_top20": f"with {_CANDIDATES} select * from candidates",
    "photo_ranking": f"""with {_SCORED} select l_suppkey, 'photo-' || l_suppkey || '-' || position id, position, l_orderkey, l_linenumber, l_partkey, name, is_match, score from ranked""",
    "bucket_counts": f"""with {_SCORED}, b as (select l_suppkey, case when is_match then 0 when name is not null then 1 else 2 end bucket from ranked)
        select l_suppkey, count(*) filter (bucket = 0) matched, count(*) filter (bucket = 1) named, count(*) filter (bucket = 2) unnamed, count(*) total,
        count(*) || case when count(*) = 1 then ' dish' else ' dishes' end as label,
        case when count(*) filter (bucket = 0) > 0 then 'More Dishes' else 'Identified Dishes' end title,
        count(*) filter (bucket < 2) || ' identified · ' || count(*) || ' total' counts from b group by all""",
    "place_search": f"""with {_PLACES} select place_id id, name, vicinity address from places where contains(lower(name), 'tion_1') or contains(lower(vicinity), 'tion_1')""",
    "bucket_order": f"""with {_SCORED} select l_suppkey, string_agg(cast(position as varchar), ',' order by case when is_match then 0 when name is not null then 1 else 2 end, position) positions
        from ranked group by all""",
    "reference_prefix": """with names as (select p_brand, list(p_name order by p_partkey) names from part group by all),
        listed as (select p_brand, case when ends_with(p_brand, '1') then names[1:20] else names[1:60] end l from names)
        select p_brand, cast(len(l) as int) n, array_to_string(list_transform(range(1, len(l) + 1), lambda i: i || '. ' || l[i]), chr(10)) as lines from listed""",
    "menu_first_match": f"""with {_MENUS} select p_partkey, coalesce(item, upper(p_name)) as name, item is not null is_match
        from part p left join firsts f on p.p_brand = f.p_brand and lower(upper(p_name)) = normal""",
    "popular_theta_match": """select p_partkey, p_name, cast(coalesce(list_position(list_transform(['red', 'blue', 'large', 'old steel', 're'],
        lambda x: contains(lower(p_name), x) or contains(x, lower(p_name))), true), 0) - 1 as int) idx from part""",
    "caption_names": f"""with captions as (select conv_id, turn, text caption from conversations union all
        select -p_partkey, 0, case p_partkey % 4 when 0 then 'The ' || p_name when 1 then 'We tried the ' || p_name || ', and it was good.'
            when 2 then 'They had "' || p_name || '" there.' else 'x' end from part)
        select conv_id, turn, {_TITLE.format(x="raw")} as name from (select conv_id, turn, {_caption()} raw from captions)""",
    "answer_parse": r"""with raw as (select conv_id, turn, case turn when 1 then '' when 2 then '' else
            trim(substr(string_split(trim('  ' || text, e' \t\n\r'), chr(10))[1], 1, 80), e' \t\n\r') end a from conversations)
        select conv_id, turn, case when a <> '' and lower(a) <> 'null' then a end answer, a <> '' and lower(a) <> 'null' is_food from raw""",
    "attribution_class": """with links as (select page_id, case when page_id % 5 = 0 then '' else
            lower(case when page_id % 3 = 0 then 'https://maps.google.com/maps/contrib/' || page_id else url end || case when page_id % 9 = 0 then ' downer' else '' end) end t from pages)
        select page_id, case when contains(t, 'owner') or contains(t, 'the official') or (not contains(t, 'maps.google.com/maps/contrib') and t <> '') then 'owner' else 'user' end attribution from links""",
    "url_params": """with q as (select page_id, url, '&' || regexp_extract(url, '\\?([^#]*)', 1) q from pages)
        select page_id, case when regexp_matches(q, '&page=') then url_decode(regexp_extract(q, '&page=([^&]*)', 1)) end page,
        case when regexp_matches(q, '&ref=') then url_decode(regexp_extract(q, '&ref=([^&]*)', 1)) end ref,
        case when regexp_matches(q, '&utm_source=') then url_decode(regexp_extract(q, '&utm_source=([^&]*)', 1)) end utm_source, url_encode('a b' || url) encoded from q""",
    "display_urls": """select p_partkey, 'https://media.example.com/photo?maxwidth=400&photo_reference=p' || p_partkey url_400,
        'https://media.example.com/photo?maxwidth=800&photo_reference=p' || p_partkey url_800, lower(p_type) mime_type, base64(encode(p_name)) data from part""",
    "json_extract": """select event_id, cast(props->>'$.k' as int) k, coalesce(cast(props->>'$.k' as int), 0) k_or_zero,
        case when props->>'$.k' is null then '{"id":' || event_id || '}' else '{"id":' || event_id || ',"k":' || cast(props->>'$.k' as int) || '}' end json from events""",
    "place_flatten": f"""with {_PLACES} select place_id id, name, vicinity address, case when located then lat end lat, case when located then lng end lng, place_id "placeId", rating, k "reviewCount",
        price "priceLevel", cast(open_now as varchar) "isOpen", rating is not null or coalesce(price > 0, false) or open_now is not null visible from places""",
    "place_pins": f"""with {_PLACES} select place_id "placeId", coalesce(nullif(name, ''), 'Restaurant') as name, coalesce(vicinity, n_name, '') vicinity, rating, k "userRatingsTotal", price "priceLevel"
        from places where located""",
    "nearest_place": f"with {_POINTS} select vec_id, round({_HERE}, 3) distance from points order by {_HERE}, vec_id limit 1",
    "nearest_each": f"""with {_POINTS}, asked as (select vec_id request, lat + 0.25 a, lng - 0.25 b from points),
        met as (select request, vec_id, {_DISTANCE.format(lat="lat", lng="lng", a="a", b="b")} d from asked cross join points where lat is not null)
        select request, arg_min(vec_id, (d, vec_id)) vec_id, round(min(d), 3) distance from met group by all""",
    "within_radius": f"with {_POINTS} select vec_id, round({_HERE}, 3) distance from points where {_HERE} <= 1000000 order by {_HERE}, vec_id limit 20",
    "zoom_radius": """select p_partkey, cast(greatest(300, least(50000, floor(40000 / pow(2.0, coalesce(case when p_size <> 14 then p_size % 22 end, 14) - 10) + 0.5))) as int) radius from part""",
    "bounding_box": f"with {_POINTS} select min(lat) south, max(lat) north, min(lng) west, max(lng) east from points",
    "lateral_top1": """select s_suppkey, c_custkey business_id from supplier left join lateral
        (select c_custkey from customer where c_nationkey = s_nationkey and c_acctbal > 0 order by c_acctbal, c_custkey limit 1) on true""",
    "zip_positional": """with lists as (select conv_id, list(role order by turn) urls,
            list_filter(list(case when length(text) % 3 <> 0 then text else '' end order by turn), lambda x: x <> '') names from conversations group by all)
        select conv_id, cast(i - 1 as int) pos, urls[i] url, names[i] as name, case when i = 1 then 'owner' else 'user' end attribution, 600 width, 400 height
        from (select *, unnest(range(1, len(urls) + 1)) i from lists)""",
    "compact_counts": f"""select o_orderkey, {_header(_N)} header, case when {_N} >= 1000 then {_thousands(_N, 1)} else cast({_N} as varchar) end sheet, {_header("(o_orderkey * 125)")} ties from orders""",
    "price_marks": """select p_partkey, repeat('$', p_size % 5) marks, repeat('$', 4 - p_size % 5) missing,
        printf('%.1f', case when p_size % 21 % 4 in (1, 3) then (p_size % 21) / 4.0::double + 0.05 else (p_size % 21) / 4.0::double end) rating from part""",
    "clamp_prev_next": """select event_id, cast(greatest(0, least(11, event_id % 20 - 1)) as int) prev, cast(greatest(0, least(11, event_id % 20 + 1)) as int) as next,
        case when abs(event_id % 300 - 100) > abs(value * 3 - 150) and event_id % 300 - 100 > 100 then 'close' when value * 3 - 150 > 60 then 'prev' when value * 3 - 150 < -60 then 'next' else 'none' end gesture,
        event_id::double parsed from events""",
    "first_event": "select user_id, arg_min(event_id, (ts, event_id)) event_id from events group by all",
    "debounce_sessions": """with gaps as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 10 minutes then 0 else 1 end fresh from events),
        runs as (select user_id, ts, sum(fresh) over (partition by user_id order by ts) run from gaps)
        select user_id, epoch_us(min(ts)) first_at, epoch_us(max(ts)) + 600000000 fires_at, count(*) n from runs group by user_id, run""",
    "label_fail_open": """with a as (select p_partkey, p_name, p_partkey % 13 <> 0 fetched, [200, 429, 403, 500][p_partkey % 4 + 1] s1, [200, 429, 403, 500][p_partkey // 4 % 4 + 1] s2 from part),
        b as (select *, case when not fetched then 0 when s1 = 200 then 1 when s1 = 403 then 0 when s2 = 200 then 2 else 0 end won from a),
        c as (select *, case won when 1 then p_partkey % 3 = 0 when 2 then p_partkey % 6 = 0 end none from b)
        select p_partkey, case when won > 0 and not none then p_name end as name, won > 0 and not coalesce(none, false) is_match, won = 0 or not none is_food from c""",
    "business_by_name": f"""with here as (select s_suppkey, n_name, (s_suppkey % 90)::double lat, (s_nationkey * 7)::double lng from supplier join nation on s_nationkey = n_nationkey),
        near as (select c_custkey, n_name, (c_custkey % 80)::double a, c_acctbal / 60 b from customer join nation on c_nationkey = n_nationkey where c_acctbal > 0)
        select s_suppkey, arg_min(c_custkey, ({_DISTANCE.format(lat="lat", lng="lng", a="a", b="b")}, c_custkey)) business_id from here left join near on here.n_name = near.n_name group by all""",
    "details_children": """select cast(c_custkey as varchar) place_id, 0 n_photos, cast(count(o_orderkey) as int) n_reviews,
        coalesce(string_agg(o_orderpriority || ':' || (o_orderkey % 5), ',' order by o_orderpriority || ':' || (o_orderkey % 5)), '') reviews
        from customer left join orders on c_custkey = o_custkey group by c_custkey""",
    "menu_items": """with m as (select case when p_partkey % 7 > 0 then cast(p_partkey as varchar) end place_id,
            case when p_partkey % 7 > 0 and p_size % 5 > 0 then case when p_size % 3 = 1 then [p_name, p_type] else [p_name] end else [] end items from part)
        select place_id, cast(len(items) as int) n, coalesce(array_to_string(items, '|'), '') items from m""",
    "dishes_response": f"""with {_SCORED}, listed as (select l_suppkey, count(*) n, string_agg('photo-' || l_suppkey || '-' || position || '=' || coalesce(name, ''), '|' order by position) dishes
            from ranked where position < 20 group by all)
        select coalesce(l_suppkey, s_suppkey) l_suppkey, cast(coalesce(n, 0) as int) n, coalesce(dishes, '') dishes, coalesce(s_name, '') popular
        from listed full join supplier on l_suppkey = s_suppkey""",
    "prompt_text": """with names as (select p_brand, list(p_name order by p_partkey)[1:3] names from part group by all),
        l as (select p_brand, case when right(p_brand, 1) in ('1', '3') then [] else names end menu, case when ends_with(p_brand, '3') then [] else names[1:2] end popular from names),
        i as (select *, case when len(menu) > 0 then menu else popular end items from l)
        select p_brand, 'Name the dish or drink in this photo from ' || p_brand || '. ' || case when len(items) > 0 then
            case when len(menu) > 0 then 'Menu:' else 'Often ordered:' end || chr(10) || array_to_string(list_transform(range(1, len(items) + 1), lambda i: i || '. ' || items[i]), chr(10))
            || chr(10) || 'Answer with an item of the list, word for word; with 2 to 5 words if what is shown is not listed; with null if there is no food or drink.'
            else 'Answer with 2 to 5 words, or with null if there is no food or drink.' end prompt from i""",
    "place_keys": """select s_suppkey, case when s_suppkey % 3 = 1 then s_name else cast(s_suppkey as varchar) end as key,
        case when s_suppkey % 4 = 0 then 40.5::double else (s_suppkey % 4)::double end lat from supplier""",
    "display_labels": """with p as (select *, p_size % 3 = 1 named, p_size % 2 = 0 loaded, p_size % 5 < 2 matched from part)
        select p_partkey, case when named then p_name else 'Restaurant photo' end alt, case when named then 'View ' || p_name else 'View photo' end aria, loaded and named as label,
        loaded and named and matched badge, case when not named then 'No dish identified' when matched then 'Menu Match' else 'Identified' end caption,
        case when matched then 'Management' else 'User' end attribution, case when p_size % 4 = 1 then 'Open Now' when p_size % 4 > 1 then 'Closed' end opening,
        matched or contains(lower(p_name), 'denied') denied, (p_size + 1) || ' / 60' as position, loaded or matched stats from p""",
    "route_requests": """select event_id, case when event_id % 4 > 1 and event_type <> '' then 'details' when event_id % 3 > 1 and event_id % 5 > 1 and value is not null then 'nearby' else 'bad' end route from events""",
    "raw_phrases": """select p_partkey, len(string_split(p_name, ' ')) between 1 and 5 and length(replace(p_name, ' ', '   ')) between 3 and 40 and not regexp_matches(p_name, '^[0-9]')
        and not list_has_any(string_split(lower(p_name), ' '), ['red', 'large']) and (lower(replace(p_name, ' ', '   ')) = 'small gear' or regexp_matches(lower(p_name), 'blue|green|ring')) valid from part""",
    "fresh_events": "select event_id from events where ts >= timestamp '2024-01-01 12:00:00' - interval 3600 seconds",
    "names_with_parts": "select p_partkey, p_name from part where contains(p_name, 'gear') or contains(p_name, 'old')",
    "place_search_each": f"""with {_PLACES}, asked as (select c_custkey request, case when c_custkey % 11 = 0 then 'nation_1' when c_custkey % 13 = 0 then null
            else lower(right(c_name, cast(c_custkey % 6 + 1 as int))) end t from customer)
        select request, place_id id from asked join places on contains(lower(name), t) or contains(lower(vicinity), t)""",
    "popular_first_match": """with listed as (select p_brand, p_partkey ord, lower(case p_size % 3 when 0 then split_part(p_name, ' ', 1) when 1 then upper(p_name) || ' deluxe' else substr(p_name, 2, 2) end) item
            from part where p_partkey % 40 = 7)
        select p_partkey, coalesce(min(ord), -1) idx from part p left join listed l on p.p_brand = l.p_brand and (contains(item, lower(p_name)) or contains(lower(p_name), item)) group by all""",
    "utf16_units": """with n as (select p_partkey, replace(p_name, 'r', chr(127836)) || case when p_size % 2 = 0 then 'é' else '' end t from part),
        u as (select *, list_transform(range(1, length(t) + 1), lambda i: i + length(t[1:i]) - length(replace(t[1:i], chr(127836), ''))) u from n)
        select p_partkey, cast(coalesce(u[len(u)], 0) as int) units, t[1:len(list_filter(u, lambda x: x <= 5))] as start from u""",
    "within_each": f"""with {_POINTS}, views as (select vec_id request, lat a, lng b, greatest(300, least(50000, floor(40000 / pow(2.0, vec_id % 5 + 7 - 10) + 0.5))) reach from points),
        met as (select request, vec_id, {_DISTANCE.format(lat="lat", lng="lng", a="a", b="b")} d, reach from views join points on vec_id % 3 > 0 and abs(lat - a) < 1),
        ranked as (select request, vec_id, d, cast(row_number() over (partition by request order by d, vec_id) as int) rank from met where d <= reach)
        select request, rank, vec_id, round(d, 3) distance from ranked where rank <= 20""",
    "asof_fix": """with rows as (select event_id, ts, event_type, value, user_id % 10 team from events),
        asked as (select * from rows where event_type in ('purchase', 'view')), given as (select * from rows where event_type = 'click')
        select a.event_id, case when a.ts - g.ts <= interval 1 hour then epoch_us(g.ts) else -1 end fix_at, case when a.ts - g.ts <= interval 1 hour then g.value end as value
        from asked a asof left join given g on a.team = g.team and a.ts >= g.ts""",
    "positional_join": """with l as (select s_nationkey nation, s_suppkey, row_number() over (partition by s_nationkey order by s_suppkey) - 1 pos from supplier),
        r as (select c_nationkey nation, c_custkey, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) - 1 pos from customer)
        select l.nation, l.pos, s_suppkey, coalesce(c_custkey, -1) c_custkey from l left join r on l.nation = r.nation and l.pos = r.pos""",
    "recorded_details": f"""with {_PLACES} select place_id, name, n_name address, rating from places where k % 10 = 0 and k < 100""",
    "details_answers": f"""with {_PLACES} select place_id id, name, n_name address, case when located then lat end lat, case when located then lng end lng, place_id "placeId", rating, k "reviewCount",
        price "priceLevel", cast(open_now as varchar) "isOpen" from places where k % 5 > 0""",
    "request_answers": """with asked as (select c_custkey request, case when c_custkey % 7 > 0 then c_custkey % 130 end id from customer)
        select request, case when id is null then 400 when request % 10 = 3 then 500 when s_suppkey is null then 404 else 200 end status,
        case when id is null then '{"error":"bad request"}' when request % 10 = 3 then '{"error":"failed"}' when s_suppkey is null then '{"error":"not found"}' else '{"name":"' || s_name || '"}' end body
        from asked left join supplier on id = s_suppkey""",
    "business_category": f"""with here as (select s_suppkey, n_name, (s_suppkey % 90)::double lat, (s_nationkey * 7)::double lng from supplier join nation on s_nationkey = n_nationkey),
        near as (select c_custkey, n_name, (c_custkey % 80)::double a, c_acctbal / 60 b from customer join nation on c_nationkey = n_nationkey where c_mktsegment in ('HOUSEHOLD', 'MACHINERY'))
        select s_suppkey, coalesce(arg_min(c_custkey, ({_DISTANCE.format(lat="lat", lng="lng", a="a", b="b")}, c_custkey)), -1) business_id from here left join near on here.n_name = near.n_name group by all""",
    "business_photos": f"""with r as (select o_custkey c, o_orderkey, lower(o_orderpriority) p, row_number() over (partition by o_custkey order by o_orderkey) n from orders),
        named as (select c, row_number() over (partition by c order by o_orderkey) - 1 pos, {_TITLE.format(x="p")} t from r where n <= 20 and o_orderkey % 4 > 0)
        select c_custkey business_id, u.pos, 'u' || (u.pos + 1) url, t as name, case when u.pos = 0 then 'owner' else 'user' end attribution
        from (select c_custkey, cast(unnest(range(0, 25)) as int) pos from customer) u left join named n on n.c = u.c_custkey and n.pos = u.pos""",
    "json_variant": """select event_id, case event_id % 5 when 0 then props->>'$.k' end as first, case event_id % 5 when 0 then '7' end as second,
        case event_id % 5 when 2 then 't' when 4 then 'v' || (props->>'$.k') end c, case event_id % 5 when 0 then coalesce(cast(props->>'$.k' as int), 0) else 0 end or_zero from events""",
}
ORACLES["label_cascade"] = ORACLES["label_fail_open"]
