"""The operators bound to the supplied tables, and their expected results as SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docproof.llm import centroids, chat, embed_dedup, language, lexical, mixing, pieces, quality, shards, simhash
from docproof.llm import token_files, topk, urls
from docproof.llm.common import remainder, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
SHARDS = 16
DOMAIN_TARGETS = {"en": 0.50, "de": 0.18, "fr": 0.18, "es": 0.14}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op6_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return urls.judge_urls(table(spark, folder, "pages"), rules)


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"
ORACLE_SQL["op6_url_filters"] = f"""
WITH rules(rh, rp, v) AS (VALUES {_RULE_ROWS}),
split AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '{_PARTS}', 1), ''), '{urls.UPPER}', '{urls.LOWER}') AS host,
         coalesce(regexp_extract(url, '{_PARTS}', 2), '') AS path
  FROM pages),
fits AS (
  SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
  FROM (SELECT DISTINCT host, path FROM split) JOIN rules
    ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM split LEFT JOIN fits USING (host, path)
"""


@query
def op7_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE_SQL["op7_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w::DOUBLE[], c.w::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id != c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


@query
def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shards.shard_records(table(spark, folder, "documents"), [1.0] * SHARDS)



def tokenizer_file(name: str) -> bytes:
    """A vocabulary file of a public tokenizer; read by the driver and sent along, executors need no copy."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


@query
def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.digest_documents(table(spark, folder, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query
def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    model = tokenizer_file("byte_bpe_50k.json").decode()
    return token_files.token_files(table(spark, folder, "documents"), model, end_id=2, vocabulary=50_257)


@query
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    model = language.fit(docs.filter(remainder(F.col("doc_id"), 5) != 0))
    return language.predict(docs, model, [F.col("doc_id"), held_out.alias("held_out")])


@query
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = quality.fit(docs, labels.filter(remainder(F.col("doc_id"), 4) != 2))
    return quality.predict(docs, model, [F.col("doc_id"), held_out.alias("held_out")])


@query
def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return mixing.mix(docs, docs.withColumnRenamed("lang", "domain"), DOMAIN_TARGETS)


@query
def op4_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, folder, "embeddings"))


@query
def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORACLE_SQL["op11_lexical_search"] = f"""
WITH words AS MATERIALIZED (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, '{urls.UPPER}', '{urls.LOWER}'), '{_TERMS}')) AS term
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
sizes AS MATERIALIZED (SELECT r, count(*) AS n FROM words GROUP BY r),
whole AS MATERIALIZED (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_words FROM sizes),
asked AS MATERIALIZED (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, '{urls.UPPER}', '{urls.LOWER}'), '{_TERMS}')) AS term
    FROM (SELECT item_id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id)) GROUP BY ALL),
tf AS MATERIALIZED (
  SELECT r, doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM df, whole),
impacts AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // n_words)))) AS v
  FROM tf JOIN w USING (term) JOIN sizes USING (r), whole),
scores AS (
  SELECT item_id, r, doc_id, sum(times * v)::BIGINT AS score FROM asked JOIN impacts USING (term)
  WHERE doc_id IS NOT NULL GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""


@query
def op12_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, folder, "embeddings"))


def _assign(n: int) -> str:
    """Nearest centroid of each vector among those of round n; squares of whole numbers below 2^53 are exact doubles."""
    apart = "list_inner_product(v.d, v.d) + list_inner_product(c.d, c.d) - 2 * list_inner_product(v.d, c.d)"
    return f"""a{n} AS MATERIALIZED (
  SELECT r, arg_min(c, far * 16 + c) AS c, min(far) AS far
  FROM (SELECT r, c, ({apart})::HUGEINT AS far FROM v, c{n} c) GROUP BY r)"""


def _move(n: int) -> str:
    return f"""s{n} AS (
  SELECT a.c, i, sum(w[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{n} a JOIN v USING (r), range(1, 65) t(i) GROUP BY a.c, i),
m{n} AS (SELECT c, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY i) AS w FROM s{n} GROUP BY c),
c{n + 1} AS MATERIALIZED (
  SELECT c, coalesce(m.w, old.w) AS w, coalesce(m.w, old.w)::DOUBLE[] AS d FROM c{n} old LEFT JOIN m{n} m USING (c))"""


ORACLE_SQL["op12_centroids"] = f"""
WITH k AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
v AS MATERIALIZED (SELECT r, vec_id, w, w::DOUBLE[] AS d FROM k),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), w) - 1 AS c, w, d FROM v WHERE vec_id IS NOT NULL
  QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), w) <= 16),
{", ".join(f"{_assign(n)}, {_move(n)}" for n in range(3))}, {_assign(3)}
SELECT vec_id, c::INTEGER AS cluster, far::BIGINT AS distance, (sum(far) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(far) OVER ())::BIGINT AS inertia, sha256(array_to_string(c3.w, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (c) JOIN v USING (r)
"""


@query
def op13_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digest_conversations(rows.unionByName(own))


def _quoted(text: str) -> str:
    return text.replace("'", "''")


_CONTROL = "|".join(chat.re.escape(c[0]) + r"\\*" + chat.re.escape(c[1:]) for c in chat.CONTROLS)
_HITS = "len(regexp_extract_all({0}, '" + _quoted(_CONTROL) + "'))"
_LENGTHS = " ".join(f"WHEN '{r}' THEN {len(a + b)}" for r, a, b in chat.MARKS)
_ROLES = ", ".join(f"'{m[0]}'" for m in chat.MARKS)
ORACLE_SQL["op13_chat_format"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
u AS (
  SELECT *, {_HITS.format("text")} + CASE WHEN role IN ({_ROLES}) THEN 0 ELSE {_HITS.format("role")} END AS hits,
         CASE role {_LENGTHS} ELSE length(role) + {len(chat.NAMED + chat.NAME_END + chat.NAMED_END)} END AS marks FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       ({len(chat.BEGIN)} + sum(length(text) + marks + hits))::BIGINT AS formatted_chars,
       (count(*) FILTER (hits > 0))::BIGINT AS n_escaped
FROM u GROUP BY conv_id
"""
