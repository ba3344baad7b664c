"""Queries of the operators, under their production settings: (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aerostrata.llm import (
    bpe, hmm, lines, packing, pivots, quality, repair, search, secret_scan, simhash, substring, trie, warc,
)
from aerostrata.llm.common import prepared

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(prepared(spark), folder)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


@query
def op9_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(table(spark, folder, "documents"))


@query
def op10_bpe_encode_decode(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encoded(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query
def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring.deduplicated(table(spark, folder, "documents"))


@query
def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


# Five hex digits are four base-32 characters.
ORACLE_SQL["op7_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (
  SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x FROM p
),
m AS (SELECT x, max(page_id) AS first_id FROM d GROUP BY x),
c AS (
  SELECT x, first_id, array_to_string(list_transform(range(8), lambda j: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(x, 1 + 5 * j, 5) AS INTEGER) >> s) & 31), 1)), '')), '') AS digest
  FROM m
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d JOIN c USING (x)
"""

ORACLE_SQL["op2_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
),
p AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM p),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM f, range(20) AS r(j) WHERE again),
v AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n
  FROM v ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@query
def op4_hmm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return hmm.scored(table(spark, folder, "documents"))


@query
def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.resampled(docs, quality.fit(docs, table(spark, folder, "labels")))


@query
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.deduplicated(table(spark, folder, "documents"))


@query
def op5_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return pivots.near_groups(table(spark, folder, "embeddings"))


@query
def op1_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return search.search(docs, search.query_set(docs))


ORACLE_SQL["op1_topk_search"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents
),
s AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM d),
t AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS word FROM d) GROUP BY ALL),
f AS (SELECT word, count(*) AS df FROM t GROUP BY word),
p AS (
  SELECT t.doc_id, t.word, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean)) AS w
  FROM t JOIN f USING (word) JOIN d USING (doc_id), s
),
r AS (
  SELECT q.doc_id AS query_id, p.doc_id, round(sum(q.tf * p.w), 6) AS score
  FROM t AS q JOIN p USING (word) WHERE q.doc_id % 50 = 0 GROUP BY ALL
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r QUALIFY rank <= 10
"""


@query
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    mended = repair.repaired(repair.damaged(table(spark, folder, "conversations")))
    return mended.withColumnRenamed("conv", "conv_id")


@query
def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.shared_trie(table(spark, folder, "conversations"))


@query
def op13_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scanned(table(spark, folder, "documents")).drop("base")


# CRC-32 of a text of ASCII characters, as an unsigned number.
_CRC = """xor(4294967295, list_reduce(list_transform(string_split({}, ''), lambda z: CAST(ascii(z) AS BIGINT)),
    lambda r, b: list_reduce(range(8), lambda q, k: xor(q >> 1, (q & 1) * 3988292384), xor(r, b)), CAST(4294967295 AS BIGINT)))"""

# Costs from each state (z nothing, s, u, a) to the end, from the last row up; then the edits from the first row down.
ORACLE_SQL["op11_conversation_repair"] = r"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    @CRC@ % 20 AS act
  FROM conversations
),
g AS (
  SELECT conv_id, turn, CASE act WHEN 4 THEN 'user' ELSE role END AS role,
    CASE act WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE act WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM o
),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(len(role) || ':' || role || text), copy) AS i
  FROM g
),
f AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS r, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS after,
    row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS last,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault
  FROM n
),
c AS (SELECT *, fault IN ('b', 'd') AS gone, CASE fault WHEN 't' THEN 1 ELSE 0 END AS t FROM f),
b AS (
  SELECT conv_id, max(i) + 1 AS i, 0 AS z, 4 AS s, 2 AS u, 0 AS a FROM c GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, least(z, 2 + least(u, 2 + a)), least(s, 2 + least(u, 2 + a)), least(u, 2 + a), least(a, 2 + u)
  FROM (
    SELECT c.conv_id, c.i,
      least(3 + z, CASE WHEN NOT gone THEN least(2 + t + u, CASE r WHEN 's' THEN t + s WHEN 'u' THEN t + u END) END) AS z,
      least(3 + s, CASE WHEN NOT gone THEN least(2 + t + u, CASE r WHEN 'u' THEN t + u END) END) AS s,
      least(3 + u, CASE WHEN NOT gone THEN least(2 + t + a, CASE r WHEN 'a' THEN t + a END) END) AS u,
      least(3 + a, CASE WHEN NOT gone THEN least(2 + t + u, CASE r WHEN 'u' THEN t + u END) END) AS a
    FROM b JOIN c ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND c.i = b.i - 1
  )
),
v AS (
  SELECT x.conv_id, x.i, x.z, x.s, x.u, x.a, y.z AS z2, y.s AS s2, y.u AS u2, y.a AS a2, gone, t, r, role, text
  FROM b AS x LEFT JOIN b AS y ON x.conv_id IS NOT DISTINCT FROM y.conv_id AND y.i = x.i + 1
    LEFT JOIN c ON x.conv_id IS NOT DISTINCT FROM c.conv_id AND c.i = x.i
),
e AS (
  SELECT conv_id, CAST(1 AS BIGINT) AS i, 'z' AS q, '' AS audit, CAST([] AS VARCHAR[]) AS rows, false AS done FROM b WHERE i = 1
  UNION ALL
  SELECT conv_id, CASE WHEN edit IN ('I', '') THEN i ELSE i + 1 END,
    CASE WHEN edit IN ('I', 'R') THEN following WHEN edit = 'K' THEN r ELSE q END, audit || edit,
    CASE edit WHEN 'I' THEN list_append(rows, CASE following WHEN 'u' THEN 'user:' ELSE 'assistant:' END)
      WHEN 'R' THEN list_append(rows, CASE following WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text)
      WHEN 'K' THEN list_append(rows, role || ':' || text) ELSE rows END, edit = ''
  FROM (
    SELECT *, CASE WHEN z2 IS NULL AND q IN ('z', 'a') THEN ''
        WHEN cost = 3 + CASE q WHEN 'z' THEN z2 WHEN 's' THEN s2 WHEN 'u' THEN u2 ELSE a2 END THEN 'D'
        WHEN cost = 2 + CASE q WHEN 'u' THEN a ELSE u END THEN 'I'
        WHEN NOT gone AND (r = following OR (r = 's' AND q = 'z')) AND cost = t + CASE r WHEN 's' THEN s2 WHEN 'u' THEN u2 ELSE a2 END THEN 'K'
        ELSE 'R' END AS edit
    FROM (
      SELECT e.conv_id, e.i, q, audit, rows, z, s, u, a, z2, s2, u2, a2, gone, t, r, role, text,
        CASE q WHEN 'u' THEN 'a' ELSE 'u' END AS following, CASE q WHEN 'z' THEN z WHEN 's' THEN s WHEN 'u' THEN u ELSE a END AS cost
      FROM e JOIN v ON e.conv_id IS NOT DISTINCT FROM v.conv_id AND e.i = v.i WHERE NOT done
    )
  )
),
k AS (
  SELECT conv_id, CASE WHEN max(turn) IS NULL THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (last > 1 AND r || after NOT IN ('su', 'ua', 'au')) AS illegal
  FROM c GROUP BY conv_id
)
SELECT w.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(z, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(array_to_string(rows, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS w
  LEFT JOIN k ON w.conv_id IS NOT DISTINCT FROM k.conv_id
  LEFT JOIN b ON w.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = 1
  LEFT JOIN e ON w.conv_id IS NOT DISTINCT FROM e.conv_id AND e.done
""".replace("@CRC@", _CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"))

ORACLE_SQL["op12_conversation_trie"] = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL
),
k AS (SELECT c, count(*) AS n, @CRC@ % 4 AS h FROM t GROUP BY c),
v AS (SELECT x.c, x.n, x.h, x.c - x.c % 20 AS base, least(x.h, coalesce(y.n, 0)) AS taken FROM k AS x LEFT JOIN k AS y ON y.c = x.c - x.c % 20),
r AS (
  SELECT v.c, i + 1 AS d, role, text FROM v JOIN t ON t.c = v.base AND i < taken
  UNION ALL
  SELECT v.c, i - h + taken + 1, role, text FROM v JOIN t ON t.c = v.c AND i >= h
),
p AS (
  SELECT c, d, md5(string_agg(len(role) || ':' || role || len(text) || ':' || text, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS key,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM r
  UNION ALL SELECT c, 0, '', 0 FROM v
),
q AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS ends FROM p),
m AS (
  SELECT key, min(c) AS conv_id, any_value(d) AS d, any_value(up) AS up, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM q GROUP BY key
),
f AS (SELECT up AS key, count(*) AS n FROM m WHERE up IS NOT NULL GROUP BY up),
w AS (
  SELECT q.key, count(*) FILTER (f.n IS NULL) AS n_leaves, sum(saved) AS saved
  FROM m LEFT JOIN f ON m.key = f.key JOIN q ON q.c = m.conv_id AND q.d <= m.d GROUP BY q.key
)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, m.n_convs, CAST(coalesce(f.n, 0) AS BIGINT) AS n_children,
  CAST(w.n_leaves AS BIGINT) AS n_leaves, CAST(w.saved AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN w ON m.key = w.key LEFT JOIN f ON m.key = f.key LEFT JOIN m AS u ON m.up = u.key
""".replace("@CRC@", _CRC.format("CAST(c AS VARCHAR)"))
