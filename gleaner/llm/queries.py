"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import byte_repeats, collision_search, collocations, language, licenses, mixing, piece_codec, prefix_trie, rabitq, simhash, suffixes, token_files, url_lists
from gleaner.llm.common import read

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.near_duplicates(read(spark, sf_dir, "embeddings"), 0.9)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_shards(token_files.write_shards(read(spark, sf_dir, "documents"), WORD_BPE))


def op4_url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages have no time of fetching: it is set from page_id, within three years."""
    day = F.date_add(F.lit("2022-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(1096)).cast("int"))
    captures = read(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched"))
    entries = spark.sql(f"select domain, action, cast(day as date) as day from values {url_lists.values(url_lists.LIST)} as list(domain, action, day)")
    found = url_lists.filter_captures(captures, entries)
    return found.select("page_id", "host", F.col("fetched").cast("string").alias("fetched"), "listed", "list_domain", F.col("listed_since").cast("string").alias("listed_since"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "license", "dice", "license_passages")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.identify(docs, PIECES).select("doc_id", "held_out", "lang_pred", "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_search.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3)
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), PIECES)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a text that is no UTF-8 the hash takes U+FFFD for what is not."""
    found = suffixes.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "), r"\A | \z", "")
    return found.select("doc_id", "n_words", "n_removed", F.sha2(words.cast("binary"), 256).alias("kept_sha256"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read(spark, sf_dir, "conversations"))


def op13_byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = byte_repeats.remove_byte_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.coalesce("text", F.lit(b"")), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_embedding_near_dedup, op2_mixing, op3_token_files, op4_url_list, op5_licenses, op6_language, op7_nearest, op8_simhash, op9_pieces, op10_substring_dedup,
    op11_collocations, op12_prefix_trie, op13_byte_dedup,
)}

_LIST = ", ".join(f"('{d}', '{a}', date '{t}')" for d, a, t in url_lists.LIST)
_TEMPLATES = ", ".join(f"""('{k.split("#")[0]}', '{v.replace("'", "''")}')""" for k, v in sorted(licenses.TEMPLATES.items()))
_PLAIN = "trim(regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))"
_T = licenses.THRESHOLD

ORACLES = {
    "op4_url_list": f"""
        with entries(domain, action, day) as (values {_LIST}),
        events as (select lower(domain) domain, day, max(action) action from entries group by all),
        changes as (select *, lag(action) over (partition by domain order by day) before from events),
        kept as (select domain, action, day, lead(day) over (partition by domain order by day) valid_to from changes
                 where before is null and action = 'add' or before is not null and before <> action),
        spans as (select domain, day valid_from, valid_to from kept where action = 'add'),
        captures as (select page_id, date '2022-01-01' + cast(page_id * 37 % 1096 as int) fetched,
            nullif(lower(regexp_replace(regexp_replace(regexp_replace(
                regexp_extract(url, '^[hH][tT][tT][pP][sS]?://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\\.$', '')), '') host from pages),
        hits as (select page_id, domain, valid_from, row_number() over (partition by page_id order by length(domain) desc, valid_from desc) n
                 from captures join spans on (host = domain or ends_with(host, '.' || domain))
                 and valid_from <= fetched and (valid_to is null or fetched < valid_to))
        select c.page_id, host, cast(cast(fetched as date) as varchar) fetched, h.page_id is not null listed, domain list_domain, cast(valid_from as varchar) listed_since
        from captures c left join hits h on c.page_id = h.page_id and n = 1""",
    "op5_licenses": f"""
        with notices(license, t) as (values {_TEMPLATES}),
        notice_words as (select license, string_split({_PLAIN.format(x="t")}, ' ') w from notices),
        templates as (select license, grams, len(grams) n from (select license, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) grams from notice_words)),
        passages as (select doc_id, unnest(list_concat(string_split(t, chr(10)), regexp_split_to_array(t, '[.!?;][^A-Za-z0-9]*[ \t\n\r]|\n[^A-Za-z0-9]*\n'), regexp_split_to_array(t, '\n[^A-Za-z0-9]*\n'))) p
                     from (select doc_id, coalesce(text, '') t from documents)),
        normal as (select distinct doc_id, {_PLAIN.format(x="p")} p from passages),
        words as (select doc_id, p, string_split(p, ' ') w from normal where length(p) < 4000),
        grams as (select doc_id, p, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] g from words where len(w) between 2 and 400),
        scores as (select doc_id, p, license, 2.0::double * len(list_intersect(list_distinct(g), t.grams)) / (len(g) + n) dice
                   from grams join templates t on len(g) between n::double * {_T / (2 - _T)} and n::double * {(2 - _T) / _T}),
        best as (select doc_id, p, max(dice) dice, arg_min(license, (-dice, license)) license from scores where dice >= {_T} group by all),
        found as (select doc_id, count(*) n, max(dice) dice, min(struct_pack(d := -dice, l := license)).l license from best group by doc_id)
        select documents.doc_id, license, dice, cast(coalesce(n, 0) as int) license_passages from documents left join found using (doc_id)""",
    "op11_collocations": r"""
        with docs as (select row_number() over () d, coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
        pieces as (select d, lang, unnest(p) p, unnest(range(1, len(p) + 1)) piece from (select d, lang, regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]') p from docs)),
        words as (select d, lang, piece, unnest(w) w, unnest(range(1, len(w) + 1)) i from (select d, lang, piece, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') w from pieces)),
        totals as (select lang, count(*) n from words group by all),
        runs as (select lang, w a, lead(w, 1) over x b, lead(w, 2) over x c, lead(w, 3) over x e from words window x as (partition by d, piece order by i)),
        phrases as (select lang, a phrase, 1 k from runs union all select lang, a || ' ' || b, 2 from runs where b is not null
            union all select lang, a || ' ' || b || ' ' || c, 3 from runs where c is not null union all select lang, a || ' ' || b || ' ' || c || ' ' || e, 4 from runs where e is not null),
        counts as materialized (select lang, phrase, k, count(*) f from phrases group by all),
        candidates as (select lang, phrase, k, f a, string_split(phrase, ' ') w from counts where k > 1 and f >= 30),
        held as (select lang, array_to_string(w[i : i + m - 1], ' ') phrase, a from (select *, unnest(range(1, k - m + 2)) i from (select *, unnest(range(2, k)) m from candidates))),
        gone as (select distinct c.lang, c.phrase from candidates c join held h on c.lang = h.lang and c.phrase = h.phrase and 100 * h.a::hugeint >= 80 * c.a::hugeint),
        halves as materialized (select lang, phrase, a, j, array_to_string(w[1:j], ' ') x, array_to_string(w[j + 1:], ' ') y from (select *, unnest(range(1, k)) j from candidates)),
        lefts as materialized (select h.*, f l from halves h join counts c on c.lang = h.lang and c.phrase = h.x),
        cuts as (select h.lang, h.phrase, a, j, l, f r, cast(2000000::hugeint * a // (l + f) as bigint) score from lefts h join counts c on c.lang = h.lang and c.phrase = h.y),
        worst as (select lang, phrase, a, min(struct_pack(s := score, j := j, l := l, r := r)) m from cuts anti join gone using (lang, phrase) group by all),
        ranked as (select *, row_number() over (partition by lang order by m.s desc, a desc, encode(phrase)) rank from worst)
        select lang, rank, phrase, a, m.l l, m.r r, n, m.s score from ranked join totals using (lang) where rank <= 2000""",
}
