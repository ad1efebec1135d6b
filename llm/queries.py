"""The queries ``opN_<name>``: each derives the agreed columns from its operator's result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from llm import alignment, huffman, nbsvm, nearest, packing, pieces, prefix_trie, quality_rules, simhash, suffixes, superkmers, toxicity, warc
from llm.common import held_out, table


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each query vector (ids divisible by 20) among all other ``embeddings``; vectors without use take no part."""
    return nearest.nearest(table(spark, sf_dir, "embeddings"), queries=20, k=20)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all ``documents`` in sequences of 1,024 tokens; rows without an id are left out."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = packing.pack(table(spark, sf_dir, "documents"), path, window=1024, end_id=0)
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _predicted(scored: DataFrame, held: F.Column, threshold: float) -> DataFrame:
    return scored.select("doc_id", held.alias("held_out"), "score",
                         F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels are learnt outside the held-out fifth only."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = nbsvm.scored(docs, nbsvm.fit(docs, labels, "quality", held_out(5) != 0))
    return _predicted(found, held_out(5) == 0, 0.3)


def op4_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all ``documents`` read back from Huffman files written in the order of doc_id."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return huffman.read(*huffman.archive(table(spark, sf_dir, "documents"), path, end_id=2))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's piece ids and of the text they decode to."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    found = pieces.decoded(pieces.encoded(table(spark, sf_dir, "documents"), path), path)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of each document and the least doc_id reachable over links of at most four bits."""
    found = simhash.groups(table(spark, sf_dir, "documents"), shingle=4, words=1, segments=5, limit=4)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document outside strings of 50 bytes that a smaller doc_id has."""
    found = suffixes.deduplicated(table(spark, sf_dir, "documents"), length=50)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels are learnt outside the held-out third only."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.scored(docs, toxicity.fit(docs, labels, "toxic", held_out(3) != 1))
    return _predicted(found, held_out(3) == 1, 0.7)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all ``pages`` read back from archives, large equal payloads as revisits of the largest page_id."""
    return warc.read(*warc.write(table(spark, sf_dir, "pages"))).drop("url")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and verdict of every document; rows whose doc_id is null come back too, with a null doc_id."""
    found = quality_rules.judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned groups and links of two tokenizers over ``documents``; rows without an id are left out."""
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    found = alignment.aligned(table(spark, sf_dir, "documents"), a, b)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_superkmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` outside windows of 13 that a smaller doc_id has; rows without an id are left out."""
    found = superkmers.deduplicated(table(spark, sf_dir, "documents"), window=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all rebuilt ``conversations``; rows without a conv_id are left out."""
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_nearest, op2_packing, op3_quality, op4_huffman, op5_pieces, op6_simhash, op7_suffixes, op8_toxicity, op9_warc, op10_quality_rules,
    op11_alignment, op12_superkmers, op13_prefix_trie)}
ORACLES: dict[str, str] = {
    "op12_superkmers": r"""
WITH docs AS (
  SELECT doc_id::BIGINT AS doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents WHERE doc_id IS NOT NULL
), word AS (
  SELECT doc_id, r, unnest(words) AS word, unnest(range(len(words))) AS i, len(words) AS n, words FROM docs
), win AS (
  SELECT doc_id, r, i, word, CASE WHEN i + 13 <= n THEN array_to_string(list_slice(words, i + 1, i + 13), ' ') END AS win FROM word
), least AS (
  SELECT win, min(doc_id) AS first FROM win WHERE win IS NOT NULL GROUP BY win
), marked AS (
  SELECT w.*, max(CASE WHEN first < doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
  FROM win w LEFT JOIN least USING (win)
), kept AS (
  SELECT r, count(*) AS n_words, count(CASE WHEN gone = 1 THEN 1 END) AS n_removed,
         string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY i) AS kept
  FROM marked GROUP BY r
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)""",
    "op13_prefix_trie": r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
         sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, strlen(coalesce(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(conv_id::VARCHAR)), lambda i: ascii(substr(conv_id::VARCHAR, i + 1, 1))::BIGINT)),
           lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)),
         4294967295::BIGINT) % 9 AS h
  FROM (SELECT conv_id, count(*) AS size FROM t GROUP BY conv_id)
), k AS (
  SELECT c.*, least(c.h, coalesce(b.size, 0)) AS k, least(c.h, coalesce(b.size, 0)) + greatest(c.size - c.h, 0) AS n
  FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 5
), r AS (
  SELECT k.conv_id, t.pos, id, bytes FROM k JOIN t ON t.conv_id = k.conv_id - k.conv_id % 5 AND t.pos < k.h
  UNION ALL SELECT k.conv_id, k.k + t.pos - k.h, id, bytes FROM k JOIN t USING (conv_id) WHERE t.pos >= k.h
), path AS (
  SELECT conv_id, n, coalesce(ids, []) AS ids, coalesce(bytes, []) AS bytes
  FROM k LEFT JOIN (SELECT conv_id, list(id ORDER BY pos) AS ids, list(bytes ORDER BY pos) AS bytes FROM r GROUP BY conv_id) USING (conv_id)
), member AS (
  SELECT conv_id, n, depth, array_to_string(list_slice(ids, 1, depth), ',') AS key, CASE WHEN depth > 0 THEN bytes[depth] ELSE 0 END AS last
  FROM (SELECT *, unnest(range(n + 1)) AS depth FROM path)
), node AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(last) AS saved,
         sha256(coalesce(string_agg(CASE WHEN n = depth THEN conv_id END, ',' ORDER BY conv_id), '')) AS ends
  FROM member GROUP BY key, depth
), kid AS (
  SELECT m.key, m.depth, count(*) AS n FROM node c JOIN member m ON m.conv_id = c.conv_id AND m.depth = c.depth - 1 GROUP BY m.key, m.depth
), full_node AS (
  SELECT node.*, coalesce(kid.n, 0) AS n_children FROM node LEFT JOIN kid USING (key, depth)
), below AS (
  SELECT m.key, m.depth, sum(u.saved)::BIGINT AS saved_tokens, count(CASE WHEN u.n_children = 0 THEN 1 END) AS n_leaves
  FROM full_node u JOIN member m ON m.conv_id = u.conv_id AND m.depth <= u.depth GROUP BY m.key, m.depth
)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends AS ends_sha256
FROM full_node v JOIN below USING (key, depth) LEFT JOIN member m ON m.conv_id = v.conv_id AND m.depth = v.depth - 1
LEFT JOIN node p ON p.key = m.key AND p.depth = m.depth""",
}
