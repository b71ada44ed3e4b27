"""The registered queries of the training-text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, exact_topk, hard_negatives, html_extract, line_dedup, mixing, ngram_join, prefix_trie, quality, secrets, sentencepiece_codec, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]

SPACES = r"[\x20\x09-\x0D]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``, learned from ``labels`` outside the held-out fold."""
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return ngram_join.similar_groups(_table(spark, sf_dir, "documents"), 3, Fraction(9, 10))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that many documents share, dropped from the whole of ``documents``."""
    lines = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``."""
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts in the whole of ``documents``."""
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge-dropout encodings of every whole text of ``documents``, decoded again."""
    return sentencepiece_codec.encoding_digests(_table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curriculum over the whole of ``documents``, in the order of first positions."""
    plan = mixing.curriculum(_table(spark, sf_dir, "documents"))
    first = F.round(F.get("positions", F.lit(0)), 6).alias("position")
    return plan.select("doc_id", "size", "source_size", "target", "taken", first).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` written as WARC archives, read back, and merged into one capture index."""
    index = warc.archive_pages(_table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the divergence verdict of every document."""
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page of ``pages``."""
    return html_extract.extract_main_text(_table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives in the whole of ``embeddings`` for every vec_id divisible by 100, with every seventh label changed."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations of ``conversations``."""
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows of ``embeddings`` for every vec_id divisible by 50, against all rows."""
    return exact_topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_line_dedup": op3_line_dedup,
    "op4_secret_scans": op4_secret_scans,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_mix_sources": op7_mix_sources,
    "op8_warc": op8_warc,
    "op9_quality_rules": op9_quality_rules,
    "op10_html_extraction": op10_html_extraction,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_exact_topk": op13_exact_topk,
}



def _quality_sql() -> str:
    """Counts, shares and distances spelled out for each bin of both histograms."""
    n_class, n_word = len(quality.CLASSES) + 1, max(map(len, quality.COMMON_WORDS.values())) + 1
    names = [f"c{i}" for i in range(n_class)] + [f"h{i}" for i in range(n_word)]
    classes = [f"len(regexp_extract_all(t, '{c}'))" for c in quality.CLASSES]
    lists = " ".join(f"WHEN '{k}' THEN {list(v)}" for k, v in quality.COMMON_WORDS.items())
    words = [f"len(list_filter(l, lambda x: x = cw[{i + 1}]))" for i in range(n_word - 1)]
    counts = ", ".join(f"{x} AS {n}" for n, x in zip(names, [*classes, "0", *words, "0"], strict=True) if n not in (f"c{n_class - 1}", f"h{n_word - 1}"))
    rest = f"length(t) - ({' + '.join(names[: n_class - 1])}) AS c{n_class - 1}, len(l) - ({' + '.join(names[n_class:-1])}) AS h{n_word - 1}"

    def share(row: str, name: str) -> str:
        own = [n for n in names if n[0] == name[0]]
        total = "(" + " + ".join(f"{row}.{n}" for n in own) + ")"
        return f"(CASE WHEN {total} > 0 THEN {row}.{name}::DOUBLE / {total}::DOUBLE ELSE 0 END)"

    def distance(kind: str) -> str:
        part = lambda x, y: f"(CASE WHEN {x} > 0 THEN {x} * log2({x} / (({x} + {y}) / 2)) ELSE 0 END)"
        terms = [f"{part(share('f', n), share('r', n))} + {part(share('r', n), share('f', n))}" for n in names if n[0] == kind]
        return f"sqrt(greatest(0, ({' + '.join(terms)}) / 2))"

    return f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN {quality.LANGS} THEN lang ELSE 'other' END AS reference FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(regexp_split_to_array(lower(t), '[^\\pL]+'), lambda x: x <> '') AS l,
         CASE reference {lists} ELSE [''] END AS cw, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM t
), windows AS (
  SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), repeated AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM windows) WHERE k > 1
  ) GROUP BY doc_id
), c AS (SELECT *, {counts} FROM w), f AS (SELECT *, {rest} FROM c),
refs AS (SELECT reference, {', '.join(f'sum({n}) AS {n}' for n in names)} FROM f GROUP BY reference),
d AS (
  SELECT f.doc_id, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words,
         CASE WHEN length(t) >= {quality.MIN_CHARS} THEN {distance('c')} END AS class_distance,
         CASE WHEN len(w) >= {quality.MIN_WORDS} AND f.reference <> 'other' THEN {distance('h')} END AS word_distance
  FROM f JOIN refs r ON r.reference = f.reference LEFT JOIN repeated ON repeated.doc_id = f.doc_id
)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(class_distance < {quality.MAX_CLASS_DISTANCE}, true) AND coalesce(word_distance < {quality.MAX_WORD_DISTANCE}, true) AS kept,
       round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance
FROM d
"""


def _vectors_sql(label: str, more: str = "") -> str:
    fine = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    return f"v AS (SELECT DISTINCT vec_id AS id, {label} AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND {fine}{more})"


#: CRC-32 of a decimal number, bit by bit.
_CRC = (
    "xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), "
    "lambda a, b: list_reduce([xor(a, b)] || range(8), lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"
)

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TRIM = "trim({}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

SQL: dict[str, str] = {
    "op3_line_dedup": f"""
WITH parts AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, {_LOWER.format(_TRIM.format('line'))} AS key FROM parts
), common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(c.keeper <> k.doc_id, false) AS gone
  FROM keyed k LEFT JOIN common c USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op5_exact_dedup": f"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '{SPACES}', '', 'g')) AS text_sha256
  FROM documents
), w AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
""",
    "op7_mix_sources": """
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5('0:' || doc_id::VARCHAR) AS h
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM s GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][rank % 3 + 1] AS weight FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM weighed
  WINDOW before AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT *, CASE WHEN level * weight >= 3 * source_size THEN (3 * source_size)::DOUBLE
            ELSE weight * max(CASE WHEN level * weight < 3 * source_size THEN level END) OVER () END AS target
  FROM levels
), places AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.rank,
         coalesce(sum(s.size) OVER (PARTITION BY t.rank ORDER BY s.h, s.doc_id, s.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + s.size / 2.0 AS middle
  FROM s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), share AS (
  SELECT *, CASE WHEN size > 0 AND middle < target THEN middle / target END AS x,
         [1.5, 1.0, 0.5][rank % 3 + 1]::DOUBLE AS a, [0.5, 1.0, 1.5][rank % 3 + 1]::DOUBLE AS b
  FROM places
)
SELECT doc_id, size, source_size, target,
       size * (CASE WHEN size = 0 THEN 0 ELSE (middle < target)::INT + (middle + source_size < target)::INT
               + (middle + 2 * source_size < target)::INT END)::BIGINT AS taken,
       round(2 * x * ((a + b) / 2) / (a + sqrt(a * a + 2 * (b - a) * x * ((a + b) / 2))), 6) AS position
FROM share
""",
    "op8_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), g AS (
  SELECT h, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY h HAVING count(*) > 1
)
SELECT page_id, payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN g USING (h)
""",
    "op9_quality_rules": _quality_sql(),
    "op11_hard_negatives": f"""
WITH {_vectors_sql("(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)", " AND label IS NOT NULL")},
positives AS (
  SELECT q.id AS anchor_id, q.v, q.label, p.id AS positive_id, list_inner_product(q.v, p.v)::BIGINT AS positive_score,
         row_number() OVER (PARTITION BY q.id, q.v, q.label ORDER BY list_inner_product(q.v, p.v) DESC, p.id) AS place
  FROM v q JOIN v p ON q.label = p.label AND q.id <> p.id WHERE q.id % 100 = 0
), negatives AS (
  SELECT p.*, n.id AS negative_id, list_inner_product(p.v, n.v)::BIGINT AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, p.v, p.label, place ORDER BY list_inner_product(p.v, n.v) DESC, n.id)::INT AS rank
  FROM positives p JOIN v n ON p.label <> n.label
  WHERE place <= 5 AND 100 * list_inner_product(p.v, n.v) BETWEEN 30 * positive_score AND 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
""",
    "op12_prefix_trie": f"""
WITH turns AS (
  SELECT conv_id, coalesce(text, '') AS text, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS turn,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT c.conv_id, 0 AS part, t.* EXCLUDE (conv_id) FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place <= c.h
  UNION ALL SELECT c.conv_id, 1 AS part, t.* EXCLUDE (conv_id) FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.h
), steps AS (
  SELECT conv_id, strlen(text) AS bytes, row_number() OVER w AS depth, string_agg(turn, '') OVER w AS path,
         lead(turn) OVER w IS NULL AS ends
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)
), members AS (
  SELECT conv_id, depth, path, bytes, ends FROM steps
  UNION ALL SELECT conv_id, 0, '', 0, conv_id NOT IN (SELECT conv_id FROM steps) FROM convs
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY path, depth
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, p.path AS up FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = left(n.path, 64 * (n.depth - 1))
), weighed AS (
  SELECT l.*, coalesce(k.n, 0) AS n_children FROM linked l LEFT JOIN (SELECT up, count(*) AS n FROM linked WHERE depth > 0 GROUP BY up) k ON k.up = l.path
), below AS (
  SELECT a.path, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.bytes)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(list_transform(range(depth + 1), lambda i: left(path, 64 * i))) AS above FROM weighed) b JOIN weighed a ON a.path = b.above
  GROUP BY a.path
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM weighed JOIN below USING (path)
""",
    "op13_exact_topk": f"""
WITH {_vectors_sql("0")},
scores AS (
  SELECT q.id AS query_id, c.id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score,
         row_number() OVER (PARTITION BY q.id, q.v ORDER BY list_inner_product(q.v, c.v) DESC, c.id)::INT AS rank
  FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 50 = 0
)
SELECT query_id, rank, vec_id, score FROM scores WHERE rank <= 5
""",
}
