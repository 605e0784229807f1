"""One query for each operator, applied with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtrace.llm.context_tree import score_texts
from voxtrace.llm.conversation_trie import conversation_trie
from voxtrace.llm.forest import forest_top_k
from voxtrace.llm.licenses import scan_licenses
from voxtrace.llm.line_quality import MENU, PHRASES, line_quality
from voxtrace.llm.mixing import mix
from voxtrace.llm.neardup import near_duplicates
from voxtrace.llm.packing import pack, pieces
from voxtrace.llm.spelling import spelling_variants
from voxtrace.llm.substring import kept_digest, remove_repeats
from voxtrace.llm.textblocks import held_out
from voxtrace.llm.topk import exact_top_k
from voxtrace.llm.toxicity import fit_toxicity, toxicity_score, training_labels
from voxtrace.llm.warc import round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; a fifth of the labels is held out."""
    documents = table(spark, sf_dir, "documents")
    model = fit_toxicity(documents, training_labels(table(spark, sf_dir, "labels")))
    return documents.select(
        "doc_id",
        held_out(F.col("doc_id"), 5, 0).alias("held_out"),
        toxicity_score(model, F.col("text")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES["op1_toxicity"] = op1_toxicity


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document when sources weigh 5, 2, 1, repeating."""
    mixed = mix(table(spark, sf_dir, "documents"), keep_text=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "shards")


QUERIES["op9_mix"] = op9_mix


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2,048 tokens."""
    return pack(pieces(table(spark, sf_dir, "documents"), specials=True))


QUERIES["op8_pack"] = op8_pack


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten largest integer inner products of every hundredth vector with all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


QUERIES["op2_topk"] = op2_topk
ORACLES["op2_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank,
         vec_id, score
  FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def op10_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty nearest vectors found for every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return forest_top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


QUERIES["op10_forest"] = op10_forest


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that remain of each document when repeated windows of 50 words go."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return kept_digest(remove_repeats(documents))


QUERIES["op4_substring"] = op4_substring
ORACLES["op4_substring"] = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s
  FROM d, unnest(range(1, len(w) - 48)) AS u(i)
  WHERE len(w) >= 50
), l AS (SELECT s, min(doc_id) AS least FROM p GROUP BY s),
g AS (
  SELECT p.doc_id, list_sort(list_distinct(flatten(list(range(p.i, p.i + 50))))) AS gone
  FROM p JOIN l USING (s) WHERE p.doc_id > l.least GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(coalesce(gone, [])) AS BIGINT) AS n_removed,
       sha256(array_to_string(
         CASE WHEN gone IS NULL THEN w
              ELSE list_transform(
                list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(gone, k)), lambda k: w[k]) END,
         ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a similarity of 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


QUERIES["op3_neardup"] = op3_neardup
ORACLES["op3_neardup"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(
    CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM w
), e AS (SELECT doc_id, unnest(s) AS x FROM s),
c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM c JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b
  WHERE 100 * n >= 85 * (len(p.s) + len(q.s) - n)
), u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(id, root) AS (
  SELECT doc_id, doc_id FROM s
  UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.id
), m AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN m ON m.id = s.doc_id
"""


def op7_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of all documents under a context tree and a word model of six sevenths."""
    return score_texts(table(spark, sf_dir, "documents"))


QUERIES["op7_context_tree"] = op7_context_tree


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in all documents."""
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


QUERIES["op6_licenses"] = op6_licenses


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to archives and read back."""
    records = round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES["op5_warc"] = op5_warc
ORACLES["op5_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS f FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr(
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)),
         '') AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to
FROM d
"""


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line rules and what they leave of all documents."""
    return line_quality(table(spark, sf_dir, "documents")).drop("cleaned_text", "rule_counts")


QUERIES["op11_lines"] = op11_lines


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in sorted(values))


ORACLES["op11_lines"] = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM d, unnest(range(1, len(w) - 6)) AS u(i) WHERE len(w) >= 8
), twice AS (SELECT doc_id, s FROM win GROUP BY doc_id, s HAVING count(*) > 1),
rep AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM win JOIN twice USING (doc_id, s), unnest(range(i, i + 8)) AS u(k) GROUP BY doc_id
), parts AS (SELECT doc_id, string_split(t, chr(10)) AS p FROM d),
l AS (
  SELECT doc_id, i, p[i] AS line, regexp_extract_all(p[i], '[^\\x20\\x09-\\x0D]+') AS w, lower(p[i]) AS low
  FROM parts, unnest(range(1, len(p) + 1)) AS u(i)
), m AS (
  SELECT *, len(w) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS seen,
         len(regexp_extract_all(line, '[|>»·•]')) AS seps, len(regexp_extract_all(line, '[#*$%&|<>]')) AS syms,
         len(regexp_extract_all(line, '[!?]')) AS marks
  FROM l WHERE len(w) > 0
), r AS (
  SELECT *, CASE
    WHEN (seps >= 2 AND 4 * seps >= n) OR (n <= 12 AND len(list_filter(
      list_transform(regexp_extract_all(low, '[^\\x20\\x09-\\x0D]+'), lambda x: trim(x, '|>»·•,/-')),
      lambda x: x <> '' AND NOT list_contains([{_sql_list(MENU)}], x))) = 0) THEN 1
    WHEN syms >= 2 AND 10 * syms > n THEN 1
    WHEN seen AND n >= 3 THEN 1
    WHEN len(list_filter([{_sql_list(PHRASES)}], lambda x: contains(low, x))) > 0 THEN 1
    WHEN marks >= 4 AND 2 * marks > n THEN 1
    WHEN NOT regexp_matches(regexp_replace(line, '[\\x20\\x09-\\x0D]+$', ''), '[.!?:;…。！？]["''”’»)\\]]*$')
      AND NOT regexp_matches(line, '[.!?…。！？]["''”’»)\\]]*[\\x20\\x09-\\x0D]') THEN 1
    ELSE 0 END AS gone
  FROM m
), s AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (seen) AS n_dup_lines, sum(gone) AS n_lines_removed,
         sum(gone * n) AS n_words_removed
  FROM r GROUP BY doc_id
), f AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_lines_removed, 0) AS BIGINT) AS n_lines_removed,
         CAST(coalesce(n_words_removed, 0) AS BIGINT) AS n_words_removed
  FROM d LEFT JOIN s USING (doc_id) LEFT JOIN rep USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_words_removed > 50 * n_words) AS kept
FROM f
"""

#: crc32 of a text ``s`` in SQL: the table of its 256 bytes, and the steps through the text's bytes.
CRC_TABLE = """
crc_steps(i, step, k) AS (
  SELECT i, 0, i FROM range(0, 256) u(i)
  UNION ALL
  SELECT i, step + 1, CASE WHEN k & 1 = 1 THEN xor(k >> 1, 3988292384) ELSE k >> 1 END FROM crc_steps WHERE step < 8
), crc_table AS (SELECT list(k ORDER BY i) AS crc FROM crc_steps WHERE step = 8)"""
CRC_OF = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
  list_transform(range(0, strlen({s})), lambda i: CAST('0x' || substr(hex(encode({s})), 2 * i + 1, 2) AS BIGINT))),
  lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])))"""


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES["op12_spelling"] = op12_spelling
ORACLES["op12_spelling"] = f"""
WITH RECURSIVE {CRC_TABLE}, r AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents
), g AS (
  SELECT run, doc_id || ':' || run AS s, count(*) AS c FROM r WHERE length(run) >= 7 GROUP BY ALL
), h AS (SELECT run, c, {CRC_OF.format(s="s")} AS h FROM g, crc_table),
w AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c
  FROM h
), v AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2
), k AS (
  SELECT word, p, substr(word, 1, p - 1) || substr(word, p + 1) AS cut FROM v, unnest(range(1, length(word) + 1)) AS u(p)
), e AS (
  SELECT a.word AS a, b.word AS b FROM k a JOIN k b ON a.p = b.p AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT a.word, k.word FROM v a JOIN k ON k.cut = a.word
  UNION SELECT k.word, a.word FROM v a JOIN k ON k.cut = a.word
), b AS (
  SELECT e.a AS word, count(*) AS n_near, max(v.n) AS best_n, arg_min(e.b, (-v.n, e.b)) AS best
  FROM e JOIN v ON v.word = e.b GROUP BY e.a
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * v.n THEN best END AS form,
         CASE WHEN best_n >= 10 * v.n THEN best_n END AS form_n
  FROM v LEFT JOIN b USING (word)
), walk(word, stop) AS (
  SELECT word, word FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.stop WHERE f.form IS NOT NULL
), ends AS (SELECT walk.word, walk.stop AS root FROM walk JOIN f ON f.word = walk.stop WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)
"""


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct prefixes of all rebuilt conversations."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES["op13_trie"] = op13_trie
ORACLES["op13_trie"] = f"""
WITH RECURSIVE {CRC_TABLE}, t AS (
  SELECT conv_id, k, b, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, k) AS p
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, CAST(strlen(coalesce(text, '')) AS BIGINT) AS b,
               md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k
        FROM conversations WHERE conv_id IS NOT NULL)
), i AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t),
h AS (SELECT conv_id, {CRC_OF.format(s="s")} % 9 AS h FROM i, crc_table),
r AS (
  SELECT h.conv_id, 0 AS part, p, k, b FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 5 AND p <= h
  UNION ALL SELECT h.conv_id, 1, p, k, b FROM h JOIN t ON t.conv_id = h.conv_id AND p > h
), w AS (
  SELECT h.conv_id, coalesce(list(k ORDER BY part, p) FILTER (k IS NOT NULL), []) AS ks,
         coalesce(list(b ORDER BY part, p) FILTER (k IS NOT NULL), []) AS bs
  FROM h LEFT JOIN r USING (conv_id) GROUP BY h.conv_id
), m AS (
  SELECT conv_id, d, ks[1:d] AS node, ks[1:d - 1] AS up, CASE WHEN d > 0 THEN bs[d] ELSE 0 END AS b, len(ks) = d AS stops
  FROM w, unnest(range(0, len(ks) + 1)) AS u(d)
), g AS (
  SELECT node, d, CASE WHEN d > 0 THEN any_value(up) END AS up, min(conv_id) AS conv_id, count(*) AS n,
         (count(*) - 1) * any_value(b) AS saves,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (stops), '')) AS ends
  FROM m GROUP BY node, d
), c AS (SELECT up AS node, count(*) AS n_children FROM g WHERE up IS NOT NULL GROUP BY up),
a AS (
  SELECT g.node[1:v] AS node, count(*) FILTER (n_children IS NULL) AS n_leaves, sum(saves) AS saved
  FROM g LEFT JOIN c USING (node), unnest(range(0, d + 1)) AS u(v) GROUP BY 1
)
SELECT g.conv_id, g.d AS depth, p.conv_id AS parent_conv_id, g.n AS n_convs, coalesce(n_children, 0) AS n_children,
       n_leaves, CAST(saved AS BIGINT) AS saved_tokens, g.ends AS ends_sha256
FROM g JOIN a ON a.node = g.node LEFT JOIN c ON c.node = g.node LEFT JOIN g p ON p.node = g.up
"""
