"""The registered queries of this package: each operator over its whole table, with its comparison SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quoteflow.llm import alignment, chat, embeddings, interactions, merkle, mixing, pieces, quality, sharding, simhash, toxicity, urlfilter, warc
from quoteflow.llm.common import settle, shared_path, table, vocabulary

#: block or allow, host, path
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), with_ids=False)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    # read once: only segments keep their block here
    records = settle(warc.read_records(spark, path, with_payload=False))
    whole = warc.reassemble(records, with_payload=False)
    return whole.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", (F.col("payload_digest") == F.col("declared")).alias("verified"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), shards=24)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rule_table(spark, URL_RULES))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.control_case(spark))
    return chat.read_back(chat.render(chat.fold(chat.as_events(rows))))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(*mixing.mix(table(spark, sf_dir, "documents")))


def op11_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup, op2_sentencepiece, op3_warc, op4_sharding, op5_toxicity, op6_url_filters, op7_chat_formatting,
        op8_embedding_near_dedup, op9_quality_rules, op10_mixing, op11_merkle_fingerprints, op12_filter_audit, op13_alignment,
    )
} | {"pipeline": corpus_pipeline.run}

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS n, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, 5 * (i // 4)::INT + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to, true AS verified
FROM d
"""

_URLS = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT page_id, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) AS k
  FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT h.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN m ON h.page_id = m.page_id AND k = 1
"""

_CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS shown, replace(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '%', '%25'), chr(10), '%0A') AS head FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(head) + 1 + length(shown) + 11)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

_EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
u AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda c: c * c))) AS norm FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.9),
w(vec_id, seen) AS (SELECT vec_id, vec_id FROM u UNION SELECT l.a, w.seen FROM w JOIN l ON l.b = w.vec_id),
c AS (SELECT vec_id, min(seen) AS component_id FROM w GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
  e.vec_id = coalesce(c.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.vec_id = e.vec_id
"""

#: from the definition: every document walks every order; shares are sums of its removals
_AUDIT = r"""
WITH l AS (SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
f AS (
  SELECT w.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
     regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > first_id, false)] AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
x(i) AS (VALUES (1), (2), (3), (4), (5)),
o AS (
  SELECT [a.i, b.i, d.i, e.i, g.i] AS o FROM x a, x b, x d, x e, x g
  WHERE a.i <> b.i AND a.i <> d.i AND a.i <> e.i AND a.i <> g.i AND b.i <> d.i AND b.i <> e.i AND b.i <> g.i AND d.i <> e.i AND d.i <> g.i AND e.i <> g.i),
s AS (
  SELECT part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, x.i AS step, o[x.i] AS letter,
    n, good, toxic, fails[o[x.i]] AS failing, len(list_filter(o[1 : x.i - 1], lambda k: fails[k])) > 0 AS gone,
    len(list_filter(fails, lambda k: k)) = 1 AS alone FROM c, o, x),
r AS (
  SELECT part, filter_order, step, letter, sum(n) FILTER (NOT gone AND NOT failing) AS kept, sum(n) FILTER (failing AND NOT gone) AS removed,
    sum(n) FILTER (failing AND gone) AS redundant, sum(n) FILTER (failing AND alone) AS unique_fails,
    sum(good) FILTER (failing AND NOT gone) AS good_lost, sum(toxic) FILTER (failing AND NOT gone) AS toxic_lost
  FROM s GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM r
"""

_MERKLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT doc_id, text, coalesce(lead(text) OVER o, first_value(text) OVER o) AS following FROM d WINDOW o AS (ORDER BY doc_id DESC)),
e AS (SELECT doc_id, length(text) AS n, text, following, substr(text, 1, length(text) - length(text) // 2) || substr(following, 1, length(text) // 2) AS edited FROM f),
v AS (SELECT doc_id, 'own' AS kind, text AS t FROM e UNION ALL SELECT doc_id, 'edited', edited FROM e UNION ALL SELECT doc_id, 'following', following FROM e),
p AS (
  SELECT doc_id, kind, list_transform(regexp_extract_all(t, '(?s).{0,398}?(?:\n|[.!?] )|.{1,400}'), lambda x: sha256(x) || ':' || length(x)) AS pieces FROM v),
w AS (
  SELECT doc_id, kind, list_transform(pieces, lambda x: substr(x, 1, 32) || substr(x, 65)) AS pieces,
    array_to_string(list_transform(pieces, lambda x: substr(x, 1, 32) || substr(x, 65) || CASE WHEN x[1] = '0' THEN chr(10) ELSE ' ' END), '') AS written FROM p),
s AS (
  SELECT doc_id, kind, list_distinct(pieces) AS pieces, len(pieces) AS n_pieces,
    list_filter(list_transform(string_split(written, chr(10)), lambda x: rtrim(x)), lambda x: x <> '') AS sections FROM w),
r AS (
  SELECT doc_id, kind, pieces, n_pieces, len(sections) AS n_sections, sha256(array_to_string(list_transform(sections, lambda x: sha256(x)), ' ')) AS root,
    coalesce(list_sum(list_transform(pieces, lambda x: substr(x, 34)::BIGINT)), 0)::BIGINT AS weight FROM s),
k AS (
  SELECT a.doc_id, b.kind, b.root, CASE WHEN a.root = b.root THEN 1.0::DOUBLE ELSE least(0.999999::DOUBLE,
    2.0::DOUBLE * coalesce(list_sum(list_transform(list_intersect(a.pieces, b.pieces), lambda x: substr(x, 34)::BIGINT)), 0)::BIGINT / (a.weight + b.weight)) END AS near
  FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.kind = 'own' AND b.kind <> 'own')
SELECT e.doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, o.root AS fingerprint, c.root AS edited_fingerprint,
  c.near AS near_edited, x.near AS near_next, o.n_pieces::BIGINT AS n_pieces, o.n_sections::BIGINT AS n_sections
FROM e JOIN r o ON o.doc_id = e.doc_id AND o.kind = 'own' JOIN k c ON c.doc_id = e.doc_id AND c.kind = 'edited' JOIN k x ON x.doc_id = e.doc_id AND x.kind = 'following'
"""

SQL = {"op3_warc": _WARC, "op6_url_filters": _URLS, "op7_chat_formatting": _CHAT, "op8_embedding_near_dedup": _EMBEDDINGS, "op11_merkle_fingerprints": _MERKLE, "op12_filter_audit": _AUDIT}
