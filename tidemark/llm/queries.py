"""Registered queries of the subpackage: each applies one operator to its whole table. SQL is given where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, chat, host_rules, lm_score, minhash, packing, pieces, prefix_trie, pu_quality, resampling, simhash, token_counts, warc
from tidemark.llm.common import table

def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file, the same on every worker."""
    return public_tokenizers.path(name)


def op1_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: four-word shingles, links of at most four differing bits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_groups(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every whole text, decoded again; ids as their number and hash."""
    model = tokenizer_file("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = pieces.decode(pieces.encode(docs, model), model)
    return back.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
                       (F.col("decoded") == F.col("text")).alias("round_trip"))


def op3_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document from trusted positives and unlabelled text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pu_quality.scored(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return found.select("doc_id", "held_out", "score", "predicted")


def packed_pieces(docs: DataFrame, release: bool = False) -> DataFrame:
    """Pieces of packed documents with the checksum of their ids in place of the ids."""
    packed = packing.pack(docs, tokenizer_file("word_bpe_49k.json"), release=release)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens along the Hilbert curve."""
    return packed_pieces(table(spark, sf_dir, "documents"))


def op5_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, rendered once for each participant as the assistant."""
    return chat.rotated(table(spark, sf_dir, "conversations"))


OP5_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn::BIGINT AS turn, coalesce(role, 'unknown') AS name, replace(coalesce(text, ''), '<|', '<\|') AS content FROM conversations),
named AS (SELECT DISTINCT conv_id, name, regexp_replace(name, '[<>|#\s]', '_', 'g') AS shown FROM turns),
names AS (
  SELECT conv_id, name, shown || CASE WHEN k > 1 THEN '#' || k ELSE '' END AS speaker
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, shown ORDER BY name <> 'system', name) AS k FROM named)),
people AS (SELECT conv_id, speaker AS assistant FROM names WHERE name <> 'system'),
said AS (
  SELECT t.conv_id, t.turn, n.speaker, t.content FROM turns t JOIN names n ON t.conv_id IS NOT DISTINCT FROM n.conv_id AND t.name = n.name),
shown AS (
  SELECT t.*, p.assistant, t.speaker = p.assistant AS own,
         CASE WHEN t.speaker = p.assistant THEN '<|assistant|>' WHEN t.speaker = 'system' THEN '<|system|>'
              ELSE '<|user name=' || t.speaker || '|>' END || chr(10) AS head
  FROM said t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(content) + 8) OVER (
    PARTITION BY conv_id, assistant ORDER BY turn NULLS FIRST, speaker, content ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM shown)
SELECT conv_id, assistant, turn, speaker, head || content || '<|end|>' || chr(10) AS segment, start,
       CASE WHEN own THEN start + length(head) END AS mask_start,
       CASE WHEN own THEN start + length(head) + length(content) + 7 END AS mask_end
FROM placed
"""


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records, read back from the archives that the manifest lists."""
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target (labelled quality 1) against background (all documents) entropy of every document."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_score.entropy_difference(table(spark, sf_dir, "documents").select("doc_id", "text"), good)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text under the byte-level vocabulary of 50,257 entries."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    counted = token_counts.count_tokens(docs, tokenizer_file("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules of every document and the verdict of its source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return host_rules.judged_by_host(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, win FROM windows GROUP BY doc_id, win HAVING count(*) >= 2),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM windows JOIN twice USING (doc_id, win), (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (
  SELECT doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS docs, sum(base_failed::INT) AS failed FROM judged GROUP BY source),
total AS (
  SELECT sum(docs)::DOUBLE AS n, sum(failed)::DOUBLE AS x, count(*) AS k, sum(docs * docs)::DOUBLE AS n2, sum(failed * failed / docs) AS x2,
         sum(failed) / sum(docs) AS m FROM hosts),
apart AS (SELECT m, x2 - x * m - m * (1 - m) * (k - 1) AS excess, m * (1 - m) * (n - n2 / n) - m * (1 - m) * (k - 1) AS room FROM total),
prior AS (SELECT m, CASE WHEN excess > 0 AND room > 0 THEN least(greatest(room / excess - 1, 1), 1000) ELSE 1000 END AS k FROM apart),
rates AS (SELECT source, (failed + m * k) / (docs + k) AS rate FROM hosts, prior)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND rate <= 0.5 AS kept
FROM judged JOIN rates ON judged.source IS NOT DISTINCT FROM rates.source
"""


def op10_minhash_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, with their likeness and that of the next document."""
    return minhash.neighbour_likeness(table(spark, sf_dir, "documents"))


def op11_byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text under the multilingual ranks, decoded again; both as digests."""
    ranks = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = byte_bpe.decode(byte_bpe.encode(docs, ranks).drop("text"), ranks)
    return back.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


OP12_SQL = r"""
WITH RECURSIVE turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
bits AS (  -- CRC-32 bit by bit: each step takes eight bits of the decimal conv_id
  SELECT conv_id, 0 AS done, 4294967295::BIGINT AS crc FROM (SELECT DISTINCT conv_id FROM turns)
  UNION ALL
  SELECT conv_id, done + 1,
         list_reduce([xor(crc, ascii(substr(conv_id::VARCHAR, done + 1, 1))::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
                     lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)
  FROM bits WHERE done < length(conv_id::VARCHAR)),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS source, CASE WHEN conv_id % 20 = 0 THEN 0 ELSE xor(crc, 4294967295) % 4 END AS h
  FROM bits WHERE done = length(conv_id::VARCHAR)),
lent AS (
  SELECT c.conv_id, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.source WHERE t.place < c.h),
taken AS (SELECT conv_id, count(*) AS n FROM lent GROUP BY conv_id),
made AS (
  SELECT * FROM lent
  UNION ALL
  SELECT t.conv_id, t.place - c.h + coalesce(k.n, 0), t.role, t.text
  FROM turns t JOIN convs c USING (conv_id) LEFT JOIN taken k USING (conv_id) WHERE t.place >= c.h),
steps AS (
  SELECT conv_id, place + 1 AS depth, string_agg(md5(role || chr(1) || text), '') OVER (PARTITION BY conv_id ORDER BY place) AS key,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM made
  UNION ALL
  SELECT conv_id, 0, '', 0 FROM convs),
lengths AS (SELECT conv_id, max(depth) AS total FROM steps GROUP BY conv_id),
nodes AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, bool_and(depth = total) AS leaf,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = total), '')) AS ends_sha256
  FROM steps JOIN lengths USING (conv_id) GROUP BY depth, key),
sums AS (
  SELECT up, sum(leaf::INT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens, count(*) FILTER (WHERE length(key) = length(up) + 32) AS n_children
  FROM (SELECT *, unnest(list_transform(range(0, depth + 1), lambda d: left(key, 32 * d))) AS up FROM nodes) GROUP BY up)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.up = n.key LEFT JOIN nodes p ON n.depth > 0 AND p.key = left(n.key, 32 * (n.depth - 1))
"""


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document weighed towards the benchmark's texts; a quarter of the longer ones drawn."""
    found = resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_groups": op1_simhash_groups,
    "op2_sentencepiece_round_trip": op2_sentencepiece_round_trip,
    "op3_pu_quality": op3_pu_quality,
    "op4_hilbert_packing": op4_hilbert_packing,
    "op5_perspective_rotation": op5_perspective_rotation,
    "op6_warc_round_trip": op6_warc_round_trip,
    "op7_entropy_difference": op7_entropy_difference,
    "op8_token_counts": op8_token_counts,
    "op9_host_rules": op9_host_rules,
    "op10_minhash_neighbours": op10_minhash_neighbours,
    "op11_byte_bpe_round_trip": op11_byte_bpe_round_trip,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_importance_resampling": op13_importance_resampling,
}
SQL = {"op12_prefix_trie": OP12_SQL, "op5_perspective_rotation": OP5_SQL, "op9_host_rules": OP9_SQL}
