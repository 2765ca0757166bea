"""The operators of this package over the standard tables, with the SQL that some of them must equal."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm import bpe, decontaminate, embeddings, language, merkle, minhash, quality, secret_scan, sharding, suffixes, trie, urls, warc
from shoal.llm.common import held_out
from shoal.plans.registry import table
from shoal.session import fresh_path, materialize

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
URL_RULES = [urls.Rule("com", "/", "allow"), urls.Rule("example.com", "/en/", "block"),
             urls.Rule("www.example.com", "/en/", "allow"), urls.Rule("net", "/es/", "block"), urls.Rule("net", "/fr/", "block")]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    return bpe.decode(encoded, RANKS).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    told = "array_join(transform({}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    base = "filter(spans, x -> x.kind IN ('assign', 'access', 'hex'))"
    return found.selectExpr(
        "doc_id", *(f"cast(size(filter(spans, x -> x.kind = '{k}')) AS long) AS n_{k}" for k in ("assign", "access", "hex")),
        f"sha2({told.format(base)}, 256) AS base_sha256", f"{told.format('spans')} AS spans")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(quality.features(table(spark, sf_dir, "documents")), "features")
    model = quality.fit(rows, table(spark, sf_dir, "labels"))
    return quality.score(rows, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).drop("removed")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.to_warc(warc.arc_records(warc.pages_to_arc(table(spark, sf_dir, "pages")))).write.parquet(path)
    return warc.read_warc(spark.read.parquet(path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 0)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.write_shards(table(spark, sf_dir, "documents"), fresh_path(spark, "shards"), shards=8)
    return placed.selectExpr(
        "doc_id", "cast(coalesce(octet_length(text), 0) AS long) + 1 AS size", "crc32(coalesce(text, '')) AS text_crc32",
        "'rows' AS law", "shard", "slot", "cast(NULL AS int) AS grown_shard")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.with_common_heads(trie.sequences(table(spark, sf_dir, "conversations"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_byte_bpe, op2_secret_scan, op3_embedding_dedup, op4_quality, op5_url_filter, op6_language,
                            op7_decontamination, op8_minhash_dedup, op9_suffix_dedup, op10_warc, op11_merkle_manifest,
                            op12_sharding, op13_prefix_trie)}

_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"
_COMPONENTS = """
reached(v, c) AS (SELECT DISTINCT a, a FROM links UNION SELECT l.b, r.c FROM reached r JOIN links l ON l.a = r.v),
smallest AS (SELECT v, min(c) AS c FROM reached GROUP BY v)"""
#: CRC-32 of a short text of ASCII: every byte, then eight shifts.
_CRC = """xor(list_reduce(flatten(list_transform(range(1, length({0}) + 1), lambda i: [ascii({0}[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
 lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, 4294967295), 4294967295)"""
_FIELD = "coalesce(strlen(({0})::VARCHAR)::VARCHAR || ':' || ({0})::VARCHAR, '-')"


def _leaf(length: str) -> str:
    return f"sha256(concat({', '.join(_FIELD.format(c) for c in ('doc_id', 'source', 'lang', length, 'text'))}))"


ORACLES: dict[str, str] = {
    "op3_embedding_dedup": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE n > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id
          WHERE list_inner_product(x.e, y.e) / (x.n * y.n) >= 0.95),
{_COMPONENTS}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, coalesce(c, vec_id) AS component_id,
       coalesce(c, vec_id) = vec_id AS kept
FROM v LEFT JOIN smallest s ON s.v = v.vec_id""",
    "op5_url_filter": """
WITH s AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM s),
r AS (SELECT *, CASE
  WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
  WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
  WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
  WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
  WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM r""",
    "op7_decontamination": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text", "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("text", "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, list_slice(w, i, i + least(len(w), 13) - 1) AS x
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS x
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw))),
hits AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN iw ON dw.x = iw.x AND dw.n = iw.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
          sha256(array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',')) AS items_sha256 FROM hits GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_minhash_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS.format("text", "[^\\x20\\x09-\\x0D]+")}, []) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w]
             ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: list_slice(w, i, i + 2))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
           FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n GROUP BY 1, 2),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 85 * (na + nb - k)),
{_COMPONENTS}
SELECT s.doc_id, len(s) AS n_shingles, coalesce(c, s.doc_id) AS component_id, coalesce(c, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN smallest m ON m.v = s.doc_id""",
    "op10_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to FROM f""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('+' || lang, '') AS tree, {_leaf("n_chars")} AS leaf,
         CASE WHEN {_CRC.format("(doc_id::VARCHAR)")} % 7 = 0 AND n_chars IS NOT NULL THEN {_leaf("n_chars + 1")} END AS found FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d),
nodes AS (
  SELECT tree, n, 0 AS level, i, leaf AS h FROM l
  UNION ALL SELECT tree, (n + 1) // 2, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY tree, n, level, i // 2),
subs AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (
  SELECT n, 0 AS level, i, h FROM subs
  UNION ALL SELECT (n + 1) // 2, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY n, level, i // 2),
steps AS (
  SELECT tree, l.i, level, CASE WHEN x.h IS NULL THEN '-' WHEN x.i < l.i >> level THEN 'L' || x.h ELSE 'R' || x.h END AS step
  FROM l JOIN (SELECT DISTINCT tree, level FROM nodes WHERE n > 1) USING (tree)
  LEFT JOIN nodes x USING (tree, level) WHERE x.i IS NULL OR x.i = xor(l.i >> level, 1)
  UNION ALL
  SELECT tree, l.i, level, '-' FROM l JOIN (SELECT tree, level, max(i) AS most FROM nodes WHERE n > 1 GROUP BY ALL) USING (tree)
  WHERE xor(l.i >> level, 1) > most
  UNION ALL
  SELECT l.tree, l.i, 1000 + level, CASE WHEN xor(s.i >> level, 1) > most THEN '-' ELSE
    (SELECT CASE WHEN x.i < s.i >> level THEN 'L' ELSE 'R' END || x.h FROM upper x WHERE x.level = u.level AND x.i = xor(s.i >> u.level, 1)) END
  FROM l JOIN subs s ON s.tree = l.tree, (SELECT level, max(i) AS most FROM upper WHERE n > 1 GROUP BY ALL) u),
paths AS (SELECT tree, i, list(step ORDER BY level) AS path FROM steps GROUP BY ALL),
folded AS (
  SELECT doc_id, leaf, s.h AS subroot, (SELECT h FROM upper WHERE n = 1) AS root,
    sha256(array_to_string(list_transform(list_filter(coalesce(path, []), lambda s: s <> '-'), lambda s: s[2:]), '')) AS proof_sha256,
    list_reduce(coalesce(path, []), lambda a, s: CASE s[1] WHEN '-' THEN sha256(a) WHEN 'L' THEN sha256(s[2:] || a) ELSE sha256(a || s[2:]) END,
                coalesce(found, leaf)) AS folded_root
  FROM l JOIN subs s ON s.tree = l.tree LEFT JOIN paths p ON p.tree = l.tree AND p.i = l.i)
SELECT *, folded_root = root AS verified FROM folded""",
    "op13_prefix_trie": f"""
WITH u AS (
  SELECT conv_id, turn, concat(left(sha256(concat(strlen(coalesce(role, '')), ':', role, text)), 32), ':', strlen(coalesce(text, ''))) AS unit
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(unit ORDER BY turn NULLS FIRST, unit) AS own, {_CRC.format("(conv_id::VARCHAR)")} % 9 AS h FROM u GROUP BY conv_id),
r AS (SELECT c.conv_id, list_concat(coalesce(b.own, [])[1:c.h], c.own[c.h + 1:]) AS s FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 5),
nodes AS (SELECT d, s[1:d] AS k, min(conv_id) AS conv_id, count(*) AS n FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM r) GROUP BY d, k),
ends AS (SELECT s AS k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS e FROM r GROUP BY s),
below AS (SELECT k[1:d - 1] AS k, count(*) AS children FROM nodes WHERE d > 0 GROUP BY 1),
worth AS (SELECT d, k, CASE WHEN d > 0 THEN (n - 1) * substr(k[d], 34)::BIGINT ELSE 0 END AS saved, (children IS NULL)::INT AS leaf
          FROM nodes LEFT JOIN below USING (k)),
sums AS (SELECT k[1:a] AS k, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves
         FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM worth) GROUP BY 1)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(children, 0) AS n_children, n_leaves, saved_tokens,
       coalesce(e, sha256('')) AS ends_sha256
FROM nodes x JOIN sums USING (k) LEFT JOIN below USING (k) LEFT JOIN ends USING (k) LEFT JOIN nodes p ON x.d > 0 AND p.k = x.k[1:x.d - 1]""",
}
