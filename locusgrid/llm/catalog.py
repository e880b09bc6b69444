"""The registered queries of this folder, with SQL for a second engine where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, langid, lexical, licenses, packing, pii, positional, simhash, topk, toxicity, urlfilter, warc, whitening
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of each document."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@query
def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license notice of each document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


ORACLES["op3_license_scans"] = licenses.oracle()


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in each document."""
    return pii.find(table(spark, sf_dir, "documents"))


@query
def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest inner products of every fiftieth vector with all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


ORACLES["op5_exact_top_k"] = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
    from embeddings
    where len(embedding) > 0 and len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
s as (
    select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
    from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (
    select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
    from s)
select * from r where rank <= 5
"""


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as an archive record, read back."""
    return warc.archive_pages(table(spark, sf_dir, "pages")).drop("url")


ORACLES["op6_warc"] = """
with p as (
    select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as payload_bytes
    from pages),
r as (
    select page_id, payload_bytes, sha1(html) as payload_digest,
        case when payload_bytes >= 1000 then max(page_id) over (partition by html) end as first_id
    from p)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
    case when page_id < first_id then 'revisit' else 'response' end as record_type,
    case when page_id < first_id then first_id end as refers_to
from r
"""


#: Fixed values (the contract's rules).
URL_RULES = [
    urlfilter.Rule("allow", "com", "/"),
    urlfilter.Rule("block", "example.com", "/en/"),
    urlfilter.Rule("allow", "www.example.com", "/en/"),
    urlfilter.Rule("block", "net", "/es/"),
    urlfilter.Rule("block", "net", "/fr/"),
]


@query
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of each page's URL."""
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


ORACLES["op7_url_filters"] = """
with rules(verdict, host, path) as (values
    ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
cut as (
    select page_id,
        translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path
    from pages),
fitting as (
    select page_id, r.host || r.path as rule, r.verdict,
        row_number() over (partition by page_id order by length(r.host || r.path) desc) as nth
    from cut c join rules r
    on (c.host = r.host or ends_with(c.host, '.' || r.host)) and starts_with(c.path, r.path))
select c.page_id, c.host, c.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from cut c left join fitting f on f.page_id = c.page_id and f.nth = 1
"""


@query
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation formatted, and one whose texts are control strings, read back."""
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    hard = spark.sql("select -1L as conv_id, posexplode(array('user', 'assistant')) as (turn, role)").select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "role", F.lit(said).alias("text"))
    return chat.read_back(chat.named(chat.conversations(chat.linear(rows.unionByName(hard)))))


ORACLES["op9_chat_formatting"] = r"""
with c as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t as (
    select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
        coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as learnt,
        -- each turn: <s>, role, newline, text, </s>, newline; three characters are written as two
        cast(sum(9 + length(role) + length(regexp_replace(role, '[^\\<\[\n]', '', 'g'))
                 + length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g'))) as bigint) as formatted_chars
    from c group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(learnt) as loss_chars, sha256(learnt) as loss_sha256, formatted_chars
from t
"""


@query
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each document occurs in benchmark items."""
    return positional.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("runs")


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLES["op8_benchmark_decontamination"] = f"""
with d as (select doc_id, {_WORDS} as w from documents),
i as (select item_id, w, least(13, len(w)) as k from (select item_id, {_WORDS} as w from benchmark) where len(w) > 0),
iw as (
    select distinct item_id, k, array_to_string(w[n:n + k - 1], ' ') as g
    from (select *, unnest(generate_series(1, len(w) - k + 1)) as n from i)),
dw as (
    select doc_id, n, k, array_to_string(w[n:n + k - 1], ' ') as g
    from (select *, unnest(generate_series(1, len(w) - k + 1)) as n from d, (select distinct k from iw) where len(w) >= k)),
hits as (select doc_id, n, dw.k, item_id from dw join iw on dw.k = iw.k and dw.g = iw.g),
covered as (
    select doc_id, count(distinct p) as n_hit
    from (select doc_id, unnest(generate_series(n, n + k - 1)) as p from hits) group by doc_id),
items as (
    select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as ids
    from (select distinct doc_id, cast(item_id as varchar) as x from hits) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join covered using (doc_id) left join items using (doc_id)
"""


@query
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op11_ranked_lexical_search"] = f"""
with d as (
    select row_number() over () as k, doc_id, w, len(w) as n from (select doc_id, {_WORDS} as w from documents) where len(w) > 0),
s as (select count(*) as docs, cast(sum(n) as bigint) as terms from d),
m as (select k, doc_id, 25 + (75 * n * docs) // terms as m from d, s),
tf as (select k, t, count(*) as tf from (select k, unnest(w) as t from d) group by all),
q as (select item_id, t, count(*) as qf from (select item_id, unnest({_WORDS}) as t from benchmark) group by all),
w as (
    select t, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint) as w
    from (select t, count(*) as df from tf where t in (select t from q) group by t), s),
found as (
    select item_id, k, doc_id, cast(sum(qf * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
    from q join tf using (t) join w using (t) join m using (k) group by all),
r as (
    select item_id, doc_id, score,
        cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank
    from found where score > 0)
select item_id, rank, doc_id, score from r where rank <= 10
"""


@query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding on the unit principal components of all, whitened."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


@query
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document."""
    return langid.identify(table(spark, sf_dir, "documents")).drop("phrases")
