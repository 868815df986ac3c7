"""The queries opN_<name> over the driver's tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.llm import bpe, chat, decontam, near_dedup, oracles, quality, repair, secrets, sharding, span_dedup, tokenbin, toxicity, trie, urlfilter
from tessellum.llm.common import fresh_path, table

VOCABULARY = "byte_bpe_50k.json"
SHARDS = [f"shard-{i:03d}" for i in range(64)]
#: (action, host, path)
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op1_subsequence_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, by a model that has seen the labels of two thirds of the ids."""
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), toxicity.held_out()
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences of repeated spans."""
    return span_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_likelihood_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and verdict for every document; those that labels call good are the trusted target."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return quality.judge(table(spark, sf_dir, "documents"), labels.filter("quality = 1"))


def op4_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue from the perspective of each participant; masks as start-end pairs."""
    mask = F.array_join(F.transform("mask", lambda x: F.concat_ws("-", x["start"], x["end"])), ",").alias("mask")
    return chat.rotate(table(spark, sf_dir, "conversations")).select("conv_id", "perspective", "block", F.array_join(F.col("part").cast("array<string>"), "/").alias("part"), "n_turns", "n_trained", "rendered", mask)


def op5_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a window of a benchmark item."""
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("matches", "text_key")


def op6_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near duplicates of every document."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, written to flat files and read back from them."""
    out = fresh_path(spark, "tokens")
    tokenbin.write_tokens(table(spark, sf_dir, "documents"), out, public_tokenizers.path(VOCABULARY))
    return tokenbin.read_tokens(spark, out, digests=True)


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op10_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot and shard of every document."""
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], SHARDS)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation after planted damage."""
    conversations = table(spark, sf_dir, "conversations")
    return repair.repair(conversations, repair.damaged(repair.spaced(conversations)))


def op13_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document; a source is an owner, with a repository for each language."""
    return secrets.find(table(spark, sf_dir, "documents"), F.concat_ws("/", "source", "lang"), F.col("source"))


QUERIES = {f.__name__: f for f in (op1_subsequence_kernel, op2_sentence_spans, op3_likelihood_ratio, op4_perspective_rotation, op5_positional_index, op6_superminhash, op7_url_rules, op8_token_files, op9_bpe_round_trip, op10_slot_sharding, op11_prefix_trie, op12_turn_repair, op13_secret_owners)}

#: A text with A-Z in lower case.
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op4_perspective_rotation": """
with parties as (select distinct conv_id, role as perspective from conversations where role <> 'system'),
m as (
  select c.conv_id, p.perspective, cast(floor(c.turn / 64) as bigint) as block, c.turn, c.role, coalesce(c.text, '') as text, c.role = p.perspective as own,
    case when c.role = p.perspective then '<|assistant|>' || chr(10) when c.role = 'system' then '<|system|>' || chr(10)
         else '<|user name=' || translate(coalesce(c.role, 'unknown'), '|' || chr(10) || chr(13), '/  ') || '|>' || chr(10) end as head,
    replace(coalesce(c.text, ''), '<|', '<||') || '<|end|>' || chr(10) as body
  from conversations c join parties p using (conv_id)),
n as (
  select *, coalesce(sum(length(head) + length(body)) over (partition by conv_id, perspective, block order by turn, role, text rows between unbounded preceding and 1 preceding), 0) + length(head) as begin_at
  from m)
select conv_id, perspective, block, '' as part, cast(count(*) as int) as n_turns, cast(count(*) filter (own) as int) as n_trained,
  string_agg(head || body, '' order by turn, role, text) as rendered,
  coalesce(string_agg(cast(begin_at as bigint) || '-' || cast(begin_at + length(body) as bigint), ',' order by turn, role, text) filter (own), '') as mask
from n group by all
""",
    "op7_url_rules": """
with r(action, host, path) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
p as (
  select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
f as (
  select p.*, r.host || r.path as rule, r.action,
    row_number() over (partition by page_id order by length(r.host || r.path) desc nulls last, length(r.host) desc, r.action desc) as n
  from p left join r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path))
select page_id, host, path, rule, coalesce(action, 'allow') as verdict from f where n = 1
""",
    "op5_positional_index": f"""
with d as (select doc_id, regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
t as (select item_id, regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
iw as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as g from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as i from (select *, least(10, len(w)) as n from t where len(w) > 0))),
dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from iw) where len(w) >= n)),
hits as (select doc_id, i, n, item_id from dw join iw using (n, g)),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, cast(item_id as varchar) as id from hits) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join found using (doc_id)
""",
    "op6_superminhash": f"""
with recursive d as (select doc_id, regexp_extract_all({_FOLDED}, '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as g from d),
e as (select doc_id, len(g) as n, unnest(g) as x from s),
c as (select a.doc_id as a, b.doc_id as b, count(*) as k, any_value(a.n) + any_value(b.n) as n from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by all),
l as (select a, b from c where 100 * k >= 75 * (n - k) union all select b, a from c where 100 * k >= 75 * (n - k)),
reach(doc_id, r) as (select doc_id, doc_id from s union select doc_id, l.b from reach join l on reach.r = l.a),
m as (select doc_id, min(r) as component_id from reach group by doc_id)
select doc_id, cast(len(g) as bigint) as n_shingles, component_id, doc_id = component_id as kept from s join m using (doc_id)
""",
    "op11_prefix_trie": oracles.TRIE,
    "op12_turn_repair": oracles.REPAIR,
    "op13_secret_owners": oracles.SECRETS,
}
