"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fingerprint, line_dedup, marked_words, minhash, neighbours, packing, quality, suffix_dedup, token_counts, whitening, word_tries

RANKS, PIECES = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4)


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = fingerprint.fingerprints(_table(spark, sf_dir, "documents"))
    return prints.select("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), decode=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False, encode_special_tokens=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.histogram(token_counts.lengths(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS)))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.drop_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    each = white.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "c"), "identity_error")
    return each.select("vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = word_tries.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = marked_words.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), decode=True)
    return coded.select("doc_id", "n_tokens", F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


_ALL = (
    op1_minhash, op2_neighbours, op3_line_dedup, op4_quality, op5_fingerprint, op6_bpe, op7_packing, op8_token_counts, op9_suffix_dedup, op10_chat,
    op11_whitening, op12_resampling, op13_sentencepiece,
)
QUERIES = {f.__name__: f for f in _ALL}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL = {
    "op1_minhash": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS sh FROM w
), x AS (SELECT doc_id, unnest(sh) AS g FROM s), c AS (
  SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS n FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT p, q FROM c JOIN s a ON a.doc_id = p JOIN s b ON b.doc_id = q WHERE 100 * n >= 80 * (len(a.sh) + len(b.sh) - n)
), e AS (SELECT p, q FROM l UNION ALL SELECT q, p FROM l), r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.q, r.root FROM r JOIN e ON e.p = r.doc_id
), m AS (SELECT doc_id, min(root) AS root FROM r GROUP BY 1)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, root AS component_id, s.doc_id = root AS kept FROM s JOIN m USING (doc_id)""",
    "op3_line_dedup": f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), k AS (SELECT *, translate(trim(line, {_BLANKS}), '{_UPPER}', '{_LOWER}') AS key FROM l
), f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), j AS (SELECT k.*, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id""",
    # bytes as two hex digits each; a string of 100 bytes is one of 200 digits that starts at an even place
    "op9_suffix_dedup": """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents
), s AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS g FROM (SELECT doc_id, h, unnest(range(n_bytes - 99)) AS p FROM d WHERE n_bytes >= 100)
), f AS (SELECT g, min(struct_pack(doc_id := doc_id, p := p)) AS first FROM s GROUP BY g HAVING count(*) > 1
), r AS (SELECT doc_id, p FROM s JOIN f USING (g) WHERE struct_pack(doc_id := doc_id, p := p) <> first
), m AS (SELECT *, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, true) AS fresh FROM r
), k AS (SELECT doc_id, p, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM m
), o AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM k GROUP BY doc_id, k
), e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM o
), x AS (
  SELECT doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed, max(b) AS stop, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM e JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)""",
    "op10_chat": f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, role, text,
    CASE WHEN role IS NULL THEN 'n' ELSE 'r' || length(role) || ':' || role END || CASE WHEN text IS NULL THEN 'n' ELSE 't' || length(text) || ':' || text END AS u
  FROM conversations WHERE conv_id IS NOT NULL
), p AS (SELECT conv_id, i, md5(string_agg(u, '' ORDER BY i) OVER (PARTITION BY conv_id ORDER BY i)) AS h, max(i) OVER (PARTITION BY conv_id) AS n FROM t
), w AS (SELECT h, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE i = n GROUP BY ALL
), m AS (SELECT w.* FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.i < p.n AND p.i = w.n AND p.h = w.h))
SELECT m.conv_id, m.n AS n_turns, n_copies,
  string_agg('{chat.START}' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '{chat.STOP}' || chr(10), '' ORDER BY t.i) AS chat
FROM m JOIN t USING (conv_id) GROUP BY ALL""",
    # crc32 of each distinct word: a table of the 256 single bytes' remainders, then a fold over the word's bytes
    "op12_resampling": f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents
), m AS (SELECT list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM benchmark
), dw AS (SELECT doc_id, unnest(ws) AS w FROM d), mw AS (SELECT unnest(ws) AS w FROM m
), k AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t
), v AS MATERIALIZED (SELECT w, lower(hex(encode(w))) AS x FROM (SELECT w FROM dw UNION SELECT w FROM mw)
), c AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_transform(range(0, length(x) // 2), lambda i: CAST(16 * (strpos('0123456789abcdef', substr(x, 2 * i + 1, 1)) - 1) + strpos('0123456789abcdef', substr(x, 2 * i + 2, 1)) - 1 AS BIGINT)),
    lambda h, b: xor(h >> 8, t[CAST(xor(h & 255, b) AS INT) + 1]), 4294967295), 4294967295) % 10000 AS b FROM v, k
), s AS (SELECT b, count(*) AS s FROM dw JOIN c USING (w) GROUP BY b), t AS (SELECT b, count(*) AS t FROM mw JOIN c USING (w) GROUP BY b
), g AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT count(*) FROM dw) + 10000) / ((s + 1) * ((SELECT count(*) FROM mw) + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (b)
), a AS (SELECT doc_id, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM dw JOIN c USING (w) JOIN g USING (b) GROUP BY doc_id
), e AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN a USING (doc_id)
), r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS i, count(*) FILTER (WHERE n_features >= 20) OVER () * 10 // 100 AS drawn FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND i <= drawn THEN i END AS rank FROM r""",
}
