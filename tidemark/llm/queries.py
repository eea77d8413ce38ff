"""The named queries of this package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.decontaminate import contamination_digest
from tidemark.llm.jaccard import near_duplicates
from tidemark.llm.language import language_digest
from tidemark.llm.mask_search import ranked_search
from tidemark.llm.merge_encoding import encoding_digest
from tidemark.llm.mixing import mixing_digest
from tidemark.llm.order_minhash import compare_edited
from tidemark.llm.passages import repeated_passages
from tidemark.llm.periodic_runs import runs_digest, with_planted_runs
from tidemark.llm.quality import quality_digest
from tidemark.llm.secrets import secret_digest
from tidemark.llm.warc import archived_captures
from tidemark.llm.token_counts import token_counts

#: The vocabulary file of the two token operators.
VOCABULARY = "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if check is not None:
            CHECKS[name] = check
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_pieces")
def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoding_digest(documents, public_tokenizers.path(VOCABULARY))


@query("op2_secrets")
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op3_language")
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_digest(table(spark, sf_dir, "documents"))


@query("op4_passages")
def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


@query(
    "op5_warc",
    """
    with payloads as (select page_id, url, encode(coalesce(html, '')) as body from pages),
    firsts as (select body, min(page_id) as first from payloads group by body),
    hashed as (
        select p.page_id, octet_length(p.body) as payload_bytes, f.first, sha1(p.body) as hexed
        from payloads p join firsts f on p.body = f.body)
    select page_id, payload_bytes,
        translate(
            to_base(cast('0x' || substr(hexed, 1, 10) as bigint), 32, 8) || to_base(cast('0x' || substr(hexed, 11, 10) as bigint), 32, 8)
            || to_base(cast('0x' || substr(hexed, 21, 10) as bigint), 32, 8) || to_base(cast('0x' || substr(hexed, 31, 10) as bigint), 32, 8),
            '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') as payload_digest,
        case when page_id = first then 'response' else 'revisit' end as record_type,
        case when page_id <> first then first end as refers_to
    from hashed
    """,
)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archived_captures(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    "op7_jaccard",
    r"""
    with recursive words as (
        select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
        from documents),
    shingles as (
        select distinct doc_id, array_to_string(w[p:p + 4], ' ') as s
        from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as p from words where len(w) > 0)),
    sizes as (select doc_id, count(*) as n from shingles group by doc_id),
    shared as (
        select a.doc_id as x, b.doc_id as y, count(*) as k
        from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all),
    links as (
        select x, y from shared join sizes a on a.doc_id = x join sizes b on b.doc_id = y
        where 100 * k >= 80 * (a.n + b.n - k)),
    reach as (
        select doc_id as x, doc_id as y from words
        union
        select r.x, l.y from reach r join links l on l.x = r.y)
    select w.doc_id, coalesce(s.n, 0) as n_shingles, (select min(y) from reach r where r.x = w.doc_id) as component_id
    from words w left join sizes s using (doc_id)
    """,
)
def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_order_minhash")
def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(documents, public_tokenizers.path(VOCABULARY), keep_text=False, ranked=True)


@query(
    "op10_decontamination",
    r"""
    with words as (
        select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
        from documents),
    items as (
        select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
        from benchmark),
    windows as (
        select distinct item_id, least(len(w), 13) as size, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') as run
        from (select item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) as p from items where len(w) > 0)),
    positions as (select doc_id, w, len(w) as n, unnest(range(1, len(w) + 1)) as p from words),
    found as (
        select distinct d.doc_id, d.p, s.size, v.item_id
        from positions d
        join (select distinct size from windows) s on d.p + s.size - 1 <= d.n
        join windows v on v.size = s.size and v.run = array_to_string(d.w[d.p:d.p + s.size - 1], ' ')),
    hit as (
        select doc_id, count(distinct q) as n_hit
        from (select doc_id, unnest(range(p, p + size)) as q from found) group by doc_id),
    named as (
        select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
        from (select distinct doc_id, item_id from found) group by doc_id)
    select w.doc_id, cast(len(w.w) as bigint) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(i.n_items, 0) as n_items,
        sha256(coalesce(i.ids, '')) as items_sha256,
        coalesce(h.n_hit, 0) > 0 and 20 * coalesce(h.n_hit, 0) >= len(w.w) as contaminated
    from words w left join hit h using (doc_id) left join named i using (doc_id)
    """,
)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_mixing")
def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_digest(table(spark, sf_dir, "documents"))


@query(
    "op12_mask_search",
    r"""
    with found as (
        select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
        from documents),
    docs as (select doc_id, w, cast(len(w) as bigint) as n from found where len(w) > 0),
    totals as (select cast(count(*) as bigint) as d, cast(sum(n) as bigint) as l from docs),
    postings as (select doc_id, n, term, count(*) as tf from (select doc_id, n, unnest(w) as term from docs) group by all),
    terms as (
        select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as term
        from benchmark),
    weights as (
        select term, cast(floor(1000 * ln((2 * d + 2) / (2 * count(*) + 1))) as bigint) as w from postings, totals group by term, d),
    scored as (
        select t.item_id, p.doc_id, cast(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * p.n * o.d) // o.l)))) as bigint) as score
        from terms t join weights w using (term) join postings p using (term), totals o group by all),
    ranked as (
        select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
        from scored where score > 0)
    select item_id, rank, doc_id, score from ranked where rank <= 50
    """,
)
def op12_mask_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_runs")
def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_digest(with_planted_runs(table(spark, sf_dir, "documents")))
