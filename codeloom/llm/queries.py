"""The registered queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """Where the subword model lies on this machine; each executor has it at the same place."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def _removed() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])


def word_digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", _removed().alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def byte_digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_bytes", _removed().alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_later")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeated_words

    return word_digests(remove_repeated_words(table(spark, sf_dir, "documents")))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_array_dedup import remove_repeated_strings

    return byte_digests(remove_repeated_strings(table(spark, sf_dir, "documents")))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import digest_documents

    return digest_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_documents, train

    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import find_contamination

    # the matches themselves are for the operator's other users
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("matches")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_counts

    return secret_counts(table(spark, sf_dir, "documents"))


#: Where the query finds its key; without one it uses a key that protects nothing, for comparisons.
KEY_SETTING, CHECK_KEY = "spark.codeloom.pseudonym.key", "not-a-secret"


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pseudonyms import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents"), spark.conf.get(KEY_SETTING, None) or CHECK_KEY)


#: The extra conversation of the contract: it says the control strings of the format.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_conversations, read_back

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return read_back(format_conversations(rows.unionByName(extra)))


_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _benchmark_words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


ORACLE: dict[str, str] = {
    "op3_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
least AS (SELECT t, min(doc_id) AS m FROM win GROUP BY t),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least USING (t) WHERE m < doc_id),
each AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op4_suffix_array_dedup": r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
win AS (SELECT doc_id, i, md5(b[i:i + 399]) AS t FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d)),
times AS (SELECT t, count(*) AS n, min(doc_id) AS m FROM win GROUP BY t),
gone AS (SELECT doc_id, i, m < doc_id AS later FROM win JOIN times USING (t) WHERE n > 1),
reach AS (SELECT *, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, max(CASE WHEN later THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM gone),
spans AS (SELECT doc_id, min(i) AS lo, max(i) + 400 AS hi FROM (SELECT *, count(*) FILTER (p IS NULL OR i > p + 400) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM reach) GROUP BY doc_id, g),
least AS (SELECT doc_id, sum(least(400, coalesce(i - q, 400))) AS n FROM reach WHERE later GROUP BY doc_id),
ends AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 1) AS before, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS next FROM spans),
kept AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, string_agg(hex(b[before:lo - 1]) || CASE WHEN next IS NULL THEN hex(b[hi:octet_length(b)]) ELSE '' END, '' ORDER BY lo) AS t FROM ends JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(CASE WHEN t IS NULL THEN b ELSE unhex(t) END) AS kept_sha256, coalesce(n, 0)::BIGINT AS n_later
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN least USING (doc_id)""",
    "op7_decontamination": f"""
WITH d AS (SELECT doc_id, {_benchmark_words('text')} AS ws FROM documents),
b AS (SELECT item_id, {_benchmark_words('text')} AS ws FROM benchmark),
win AS (SELECT item_id, i AS j, least(len(ws), 13) AS k, md5(array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ')) AS t FROM (SELECT *, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, k, i, md5(array_to_string(ws[i:i + k - 1], ' ')) AS t FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win))),
found AS (SELECT doc_id, item_id, i, j, k FROM dw JOIN win USING (k, t)),
runs AS (SELECT doc_id, count(*) + any_value(k) - 1 AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS g FROM (SELECT DISTINCT * FROM found)) GROUP BY doc_id, item_id, i - j, g),
longest AS (SELECT doc_id, max(n) AS n FROM runs GROUP BY 1),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS t FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM found) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated, coalesce(n, 0)::BIGINT AS longest_match
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)""",
    "op10_chat": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), said AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h') AS escaped,
    replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h'), ':', '\c') AS named
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### : ' || named || escaped || ' </turn>' || chr(10)))::BIGINT AS formatted_chars,
  regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text), 's?(ua)+') AS valid_order
FROM said GROUP BY conv_id""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_near_duplicates, op3_substring_dedup, op4_suffix_array_dedup, op5_pieces, op6_toxicity, op7_decontamination, op8_secrets, op9_pseudonyms, op10_chat)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
