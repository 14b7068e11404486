"""Registered queries of the operators, each over its whole table, and SQL where it can express them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, conversation_trie, html_text, licenses, quality, sentence_pieces, toxicity, vector_codes
from .mixing import mix_sizes
from .near_text import near_duplicates
from .near_vectors import near_vectors
from .neighbours import nearest
from .sharding import kd_shards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op1_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes; copies share a shard unless a cut must part a hot group. The dimensions
    are properties of the text, so that copies have one place in the tree."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long") + 8
    points = docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "lang",
                         F.log2(size).alias("log_size"), F.xxhash64(F.col("text").isNull(), "text").alias("fingerprint"))
    placed = kd_shards(points, "size", ["lang", "log_size"], "fingerprint", ["doc_id", "fingerprint"], shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query
def op2_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labels of documents that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, keep=["doc_id"]).select("row.doc_id", "score")
    return scored.select("doc_id", toxicity.in_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query
def op3_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@_query
def op4_chat_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one made of control strings, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")],
                                   "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(rows.union(tricky)))


@_query
def op5_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of every vector whose vec_id 20 divides."""
    found = nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "id % 20 = 0")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


@_query
def op6_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies."""
    classes = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return classes.select(F.col("id").alias("doc_id"), "class_id", "kept")


@_query
def op7_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links at cosine 0.95 and its component."""
    found = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


@_query
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    mixed = mix_sizes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    times = F.coalesce(F.size("takes"), F.lit(0))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.when(F.col("takes").isNull(), 0).otherwise(F.col("size") * times).cast("long").alias("taken"))


@_query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice in every document."""
    found = licenses.scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumnRenamed("id", "doc_id")


@_query
def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's piece ids, and whether they spell its text again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return sentence_pieces.encode(docs, check="round_trip").select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "round_trip")


@_query
def op11_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learned from preferences between labelled documents that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rated = quality.rate(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rated.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted", "worth")


@_query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code, with codebooks of 16 entries for each of 8 parts after 6 rounds."""
    found = vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return vector_codes.with_label_errors(found.rows).select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error",
                                                             F.lit(found.sha256()).alias("codebooks_sha256"))


@_query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of conversations that begin with turns of the first conversation of their hundred."""
    conv = F.col("conv_id")
    turns = conversation_trie.turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    rebuilt = conversation_trie.sequences(turns, conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6, 5)
    return conversation_trie.prefix_trie(rebuilt)


#: Turns as the template writes them: marks, and a backslash for each control string and each backslash in a text.
_MARKS = "['<<SYS>>','<</SYS>>','[INST]','[/INST]','<s>','</s>','<|role|>','<|text|>','<|end|>']"
_LENGTH = ("length({0}) + length({0}) - length(replace({0}, chr(92), '')) + list_sum(list_transform(" + _MARKS +
           ", lambda m: (length({0}) - length(replace({0}, m, ''))) // length(m)))")
ORACLES["op4_chat_templates"] = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
w AS (SELECT *, {_LENGTH.format('text')} AS written, CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
  ELSE 23 + {_LENGTH.format('role')} END AS marks FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(written + marks) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id"""

ORACLES["op7_sorted_projections"] = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least ON least.a = vec_id LEFT JOIN n ON n.a = vec_id"""

ORACLES["op8_source_mixing"] = r"""
WITH d AS (SELECT doc_id, coalesce('s' || source, 'n') AS k, md5(coalesce(doc_id::VARCHAR, '~') || '|' || coalesce(text, '~')) AS d,
  CAST(coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) AS BIGINT) AS size FROM documents),
cells AS (SELECT k, CAST('0x' || substr(d, 1, 3) AS INTEGER) AS cell, CAST(sum(size) AS BIGINT) AS words, count(*) AS docs FROM d GROUP BY 1, 2),
sizes AS (SELECT k, CAST(sum(words) AS BIGINT) AS source_size, CAST(sum(docs) AS BIGINT) AS docs FROM cells GROUP BY k),
weighed AS (SELECT *, 1 + (row_number() OVER (ORDER BY k = 'n', k) - 1) % 3 AS weight, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM sizes),
filled AS (SELECT *, 3 * source_size / weight AS full_at FROM weighed),
levels AS (SELECT *, (total - (CAST(sum(3 * source_size) OVER f AS BIGINT) - 3 * source_size)) / sum(weight) OVER (ORDER BY full_at, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM filled WINDOW f AS (ORDER BY full_at, k ROWS UNBOUNDED PRECEDING)),
one AS (SELECT level FROM levels WHERE level <= full_at ORDER BY full_at, k LIMIT 1),
targets AS (SELECT k, source_size, docs, total, least(source_size * 3.0::DOUBLE, (SELECT level FROM one) * weight) AS target FROM levels),
passes AS (SELECT *, least(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END, 3)::INTEGER AS passes FROM targets),
sources AS (SELECT *, target - passes * source_size AS rest, pow(2, least(12, greatest(0, round(log2(4096.0::DOUBLE
  * greatest(total / (64.0::DOUBLE * 16), 64.0::DOUBLE * source_size / docs, 1.0) / greatest(source_size, 1))))))::INTEGER AS run FROM passes),
blocks AS (SELECT k, cell // run AS block, passes, rest, CAST(sum(words) AS BIGINT) AS words FROM cells JOIN sources USING (k) GROUP BY ALL),
ranked AS (SELECT *, CAST(sum(words) OVER (PARTITION BY k ORDER BY md5(k || '|' || block || '|' || passes), block ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM blocks),
drawn AS (SELECT *, upto <= rest AS whole, upto > rest AND upto - words < rest AS part, rest - (upto - words) AS left_ FROM ranked),
docs AS (SELECT d.*, source_size, target, s.passes, whole, part, left_ FROM d JOIN sources s USING (k)
  JOIN drawn b ON b.k = d.k AND b.block = CAST('0x' || substr(d, 1, 3) AS INTEGER) // s.run),
tries AS (SELECT k, try, md5(d || '|' || try) AS h, size, left_ FROM docs, range(16) t(try) WHERE part),
sums AS (SELECT k, try, h, left_, abs(CAST(sum(size) OVER (PARTITION BY k, try ORDER BY h) AS BIGINT) - left_) AS off FROM tries),
cuts AS (SELECT k, min({'off': off, 'try': try, 'h': h}) AS c FROM sums WHERE off < left_ GROUP BY k)
SELECT doc_id, size, source_size, target, CAST(size * (passes + CASE WHEN whole THEN 1 WHEN part AND md5(d || '|' || c.try) <= c.h THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM docs LEFT JOIN cuts USING (k)"""


def _codes_sql(rounds: int) -> str:
    """Rounds of integer k-means written out: x holds components, books the entries, near the assignment of each part."""
    steps = []
    for t in range(rounds + 1):
        if t:
            steps.append(f"""books{t} AS MATERIALIZED (SELECT part, entry, place, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE v END AS v
  FROM books{t - 1} LEFT JOIN (SELECT part, entry, place, CAST(sum(x.v) AS BIGINT) AS total, count(*) AS n FROM x JOIN near{t - 1} USING (vec_id, part) GROUP BY ALL) USING (part, entry, place))""")
        steps.append(f"""near{t} AS MATERIALIZED (SELECT vec_id, part, (min((d, entry)))[2] AS entry, min(d) AS d FROM (SELECT vec_id, part, entry, CAST(sum((x.v - b.v) * (x.v - b.v)) AS BIGINT) AS d
  FROM x JOIN books{t} b USING (part, place) GROUP BY ALL) GROUP BY ALL)""")
    return ",\n".join(steps)


ORACLES["op12_vector_codes"] = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor(4096 * v::DOUBLE) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v::DOUBLE))) = 0),
x AS MATERIALIZED (SELECT vec_id, i // (n // 8) AS part, i % (n // 8) AS place, v FROM (SELECT vec_id, len(e) AS n, unnest(range(len(e))) AS i, unnest(e) AS v FROM kept)),
books0 AS MATERIALIZED (SELECT part, entry, place, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 16) USING (vec_id)),
{_codes_sql(vector_codes.ROUNDS)},
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{vector_codes.ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) FROM books{vector_codes.ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""

ORACLES["op13_conversation_trie"] = """
WITH RECURSIVE turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT conv_id, md5(length(role) || ':' || role || text) AS letter, length(text) AS size,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) - 1 AS pos FROM turns),
ids AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS digits FROM turns),
crc(conv_id, digits, bit, v) AS (SELECT conv_id, digits, 0, 4294967295::BIGINT FROM ids
  UNION ALL SELECT conv_id, digits, bit + 1, xor(w >> 1, CASE WHEN w % 2 = 1 THEN 3988292384 ELSE 0 END)
  FROM (SELECT conv_id, digits, bit, CASE WHEN bit % 8 = 0 THEN xor(v, ascii(substr(digits, CAST(bit // 8 + 1 AS BIGINT), 1))::BIGINT) ELSE v END AS w FROM crc WHERE bit < 8 * length(digits))),
lent AS (SELECT conv_id, conv_id - conv_id % 100 AS lender, xor(v, 4294967295::BIGINT) % 6 AS h FROM crc WHERE bit = 8 * length(digits)),
rebuilt AS (SELECT l.conv_id, 0 AS own, pos, letter, size FROM lent l JOIN placed p ON p.conv_id = lender AND pos < h
  UNION ALL SELECT l.conv_id, 1, pos, letter, size FROM lent l JOIN placed p ON p.conv_id = l.conv_id AND pos >= h),
paths AS (SELECT conv_id, size, row_number() OVER w AS depth, string_agg(letter, '') OVER w AS path, count(*) OVER (PARTITION BY conv_id) AS n
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos ROWS UNBOUNDED PRECEDING)),
members AS (SELECT conv_id, size, depth, path, depth = n AS ends FROM paths
  UNION ALL SELECT conv_id, 0, 0, '', NOT EXISTS (SELECT 1 FROM rebuilt r WHERE r.conv_id = ids.conv_id) FROM ids),
nodes AS MATERIALIZED (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends) AS ends FROM members GROUP BY path, depth),
kids AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
subtrees AS (SELECT left(path, 32 * d) AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM counted) GROUP BY 1)
SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, c.n_convs, CAST(c.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(c.ends, '')) AS ends_sha256
FROM counted c JOIN subtrees USING (path) LEFT JOIN nodes p ON c.depth > 0 AND p.path = left(c.path, 32 * (c.depth - 1))"""
