"""The corpus operators as queries, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digests

    return digests(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digests

    return digests(table(spark, sf_dir, "documents"))


def op5_probminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_groups

    return near_groups(table(spark, sf_dir, "documents")).drop("body_hash")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearest import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score

    return score(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(table(spark, sf_dir, "pages"))


def op10_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .id_store import stored_digests

    return stored_digests(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical_search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(table(spark, sf_dir, "documents"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import digests, formatted, turn_rows

    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, [("user", said), ("assistant", said)])], "conv_id long, messages array<struct<role:string,content:string>>")
    # The added conversation has a layout of its own, and stays apart from one of the table with its number.
    turns = turn_rows(table(spark, sf_dir, "conversations"), default="turn rows").withColumn("added", F.lit(False)).unionByName(turn_rows(more).withColumn("added", F.lit(True)))
    key = ("conv_id", "added")
    return digests(formatted(turns, key), key).drop("added")


def queries() -> dict:
    found = (op1_pii, op2_best_fit_packing, op3_exact_dedup, op4_bpe, op5_probminhash_dedup, op6_language_id, op7_hnsw, op8_lm_scoring, op9_url_filter, op10_id_store, op11_lexical_search, op12_divergence, op13_chat_format)
    return {f.__name__: f for f in found}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Each item's best documents, from all products of its terms' counts.
SEARCH_SQL = rf"""
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
      i AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)),
      asked AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(t) AS term FROM i) GROUP BY ALL),
      size AS (SELECT count(*) AS docs, sum(len(t)) AS terms FROM d WHERE len(t) > 0),
      tf AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
      weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, size GROUP BY term),
      m AS (SELECT k, doc_id, 25 + (75 * len(t) * CAST(docs AS BIGINT)) // CAST(terms AS BIGINT) AS m FROM d, size WHERE len(t) > 0),
      part AS (SELECT k, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS part FROM tf JOIN weights USING (term) JOIN m USING (k)),
      scores AS (SELECT i, item_id, k, doc_id, CAST(sum(times * part) AS BIGINT) AS score FROM asked JOIN part USING (term) GROUP BY ALL HAVING sum(times * part) > 0)
    SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scores) WHERE rank <= 10
"""

#: Shares of all groups for all kept terms of their language, and their distances.
DIVERGENCE_SQL = rf"""
    WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
      w AS (SELECT k, lang, source, term, count(*) AS n FROM (SELECT k, lang, source, unnest(t) AS term FROM d) GROUP BY ALL),
      kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(*) >= 30),
      size AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
      g AS (SELECT DISTINCT lang, source FROM d),
      c AS (SELECT lang, source, term, sum(n) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
      total AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
      every AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n, coalesce(total, 0) AS total, v FROM g JOIN kept ON g.lang = kept.lang JOIN size ON g.lang = size.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term LEFT JOIN total ON total.lang = g.lang AND total.source = g.source),
      p AS (SELECT lang, source, term, n, 1 + CAST((CAST(1000000000 AS HUGEINT) * (n + 5)) // (total + 5 * v) AS BIGINT) AS p, sum(n) OVER (PARTITION BY lang, term) AS all_n, v FROM every),
      whole AS (SELECT lang, sum(n) AS total FROM c GROUP BY ALL),
      q AS (SELECT p.*, 1 + CAST((CAST(1000000000 AS HUGEINT) * (all_n + 5)) // (whole.total + 5 * v) AS BIGINT) AS q FROM p JOIN whole USING (lang)),
      pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
      rows AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
               UNION ALL SELECT lang, source, 'term', term, p - q FROM q WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows) WHERE part = 'pair' OR rank <= 50
"""

#: Turns, the assistant's texts, and the size of the formatted text as the template makes it.
CHAT_SQL = r"""
    WITH said AS (SELECT conv_id, false AS added, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, true, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, true, 1, 'assistant', '\### Assistant: </turn> ok')
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(length('### ' || replace(replace(replace(role, '\', '\b'), ':', '\c'), chr(10), '\n') || ': ' || replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>') || chr(10) || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
    FROM said GROUP BY conv_id, added
"""

ORACLE_SQL = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_lexical_search": SEARCH_SQL,
    "op12_divergence": DIVERGENCE_SQL,
    "op13_chat_format": CHAT_SQL,
}


def oracle_sql() -> dict[str, str]:
    return ORACLE_SQL
