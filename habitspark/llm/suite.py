"""Registered queries: each applies one operator with production settings to its whole table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from habitspark.llm import contextmix, jaccard, language, lines, mixing, neighbours, passages, quality, spellings, surrogates, templates, turntrie, urls
from habitspark.llm.registry import QUERIES, SQL, query, table

__all__ = ["QUERIES", "SQL"]


def fold(modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id has fold 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % modulus


@query("op1_line_dedup")
def op1(spark, folder):
    return lines.deduplicate_lines(table(spark, folder, "documents"))


@query("op2_benchmark_decontamination")
def op2(spark, folder):
    return templates.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op3_lm_scoring")
def op3(spark, folder):
    held_out = fold(7) == 2
    scored = contextmix.score_texts(table(spark, folder, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


@query("op4_source_mixing")
def op4(spark, folder):
    return mixing.mix(table(spark, folder, "documents"))


# the exact answer, summed in the order of the components; the search finds the same where it misses no neighbour
EXACT_NEIGHBOURS = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  scored AS (
    SELECT q.vec_id AS query_id, v.vec_id, list_reduce(list_transform(list_zip(v.e, q.e), lambda p: p[1] * p[2]), lambda a, b: a + b)
      / (sqrt(list_reduce(list_transform(v.e, lambda x: x * x), lambda a, b: a + b)) * sqrt(list_reduce(list_transform(q.e, lambda x: x * x), lambda a, b: a + b))) AS score
    FROM v AS q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5"""


@query("op5_nearest_neighbours", EXACT_NEIGHBOURS)
def op5(spark, folder):
    vectors = neighbours.usable(table(spark, folder, "embeddings"))
    return neighbours.nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@query("op6_url_filter")
def op6(spark, folder):
    return urls.judge(table(spark, folder, "pages"), URL_RULES)


@query("op7_quality_classifier")
def op7(spark, folder):
    held_out = fold(5) == 0
    scored = quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op8_language_id")
def op8(spark, folder):
    docs = table(spark, folder, "documents")
    held_out = fold(4) == 2
    found = language.identify(docs, language.fit(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op9_pii_surrogates")
def op9(spark, folder):
    return surrogates.replace_entities(table(spark, folder, "documents"), key="registered query")


DOCUMENT_LINKS = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
  shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
    FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0)),
  sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
  shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * m >= 80 * (p.n + q.n - m)),
  edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
  reach AS (SELECT doc_id AS node, doc_id AS found FROM words UNION SELECT node, y FROM reach JOIN edges ON found = x)
SELECT node AS doc_id, coalesce(max(n), 0) AS n_shingles, min(found) AS component_id FROM reach LEFT JOIN sizes ON doc_id = node GROUP BY node"""


@query("op10_ngram_jaccard_join", DOCUMENT_LINKS)
def op10(spark, folder):
    return jaccard.link_documents(table(spark, folder, "documents"))


# crc32 by bytes: a table of 256 values, and a fold over the list of bytes
CRC_TABLE = """crc AS MATERIALIZED (
    SELECT list(v ORDER BY i) AS t
    FROM (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS v
          FROM range(256) AS r(i)))"""


def _crc_sql(byte_list: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {byte_list}), lambda c, b: xor(c // 256, crc.t[1 + xor(c % 256, b)])), 4294967295)"


VARIANTS = rf"""
WITH RECURSIVE {CRC_TABLE},
  runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
    FROM documents),
  points AS (
    SELECT run, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: unicode(x)::BIGINT) AS p FROM runs),
  hashed AS (
    SELECT run, {_crc_sql("flatten(list_transform(p, lambda x: CASE WHEN x < 128 THEN [x] ELSE [192 + x // 64, 128 + x % 64] END))")} AS h FROM points, crc),
  words AS (
    SELECT word, count(*) AS n
    FROM (SELECT CASE WHEN h % 31 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word FROM hashed)
    WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
  cuts AS (SELECT word, n, i, word[1 : i] || word[i + 2 :] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
  near AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
  best AS (
    SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS r FROM near),
  forms AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 10 * w.n THEN b.other END AS form, CASE WHEN b.other_n >= 10 * w.n THEN b.other_n END AS form_n
    FROM words w LEFT JOIN best b ON b.word = w.word AND b.r = 1),
  chain AS (
    SELECT word, word AS root, form AS next FROM forms
    UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL"""


@query("op11_spelling_variants", VARIANTS)
def op11(spark, folder):
    return spellings.spelling_variants(table(spark, folder, "documents"))


TRIE = f"""
WITH {CRC_TABLE},
  own AS (
    SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
  hashed AS (SELECT conv_id, own.t, {_crc_sql("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)")} % 9 AS h FROM own, crc),
  rebuilt AS (
    SELECT a.conv_id, list_concat(coalesce(b.t[1 : a.h], []), a.t[a.h + 1 :]) AS t
    FROM hashed a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
  nodes AS (
    SELECT t[1 : d] AS p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
      sha256(coalesce(string_agg(CASE WHEN len(t) = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
    FROM (SELECT conv_id, t, unnest(range(len(t) + 1)) AS d FROM rebuilt) GROUP BY p, d),
  children AS (SELECT p[1 : depth - 1] AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
  own_sums AS (
    SELECT n.p, n.depth, CASE WHEN c.p IS NULL THEN 1 ELSE 0 END AS leaf, CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * octet_length(encode(n.p[n.depth].t)) END AS saved
    FROM nodes n LEFT JOIN children c ON c.p = n.p),
  below AS (
    SELECT p[1 : a] AS p, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS a FROM own_sums) GROUP BY 1)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children,
  CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.p = n.p LEFT JOIN children c ON c.p = n.p LEFT JOIN nodes u ON n.depth > 0 AND u.p = n.p[1 : n.depth - 1]"""


@query("op12_conversation_trie", TRIE)
def op12(spark, folder):
    return turntrie.conversation_trie(table(spark, folder, "conversations"))


@query("op13_suffix_array_dedup")
def op13(spark, folder):
    cut = passages.remove_repeated_passages(table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return cut.select(
        "doc_id", (F.length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
