"""The queries of this package, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii, secrets
from .chat_format import chat_format, read_back, streamed_events, trained_texts
from .decontamination import MASKS, OVERLAP, SIMILARITY, contaminated
from .packing import packed
from .quality_model import scored, train
from .quality_rules import quality_rules
from .simhash import near_duplicates
from .suffix_dedup import without_repeats
from .token_counts import token_counts


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(documents(spark, sf_dir)))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.credentials(documents(spark, sf_dir)))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality_rules(documents(spark, sf_dir))
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    text = r"\### Assistant: </turn> ok"
    rows = rows.union(spark.range(2).select(F.lit(-7), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(text)))
    out = chat_format(streamed_events(rows)).withColumn("turns", read_back(F.col("formatted")))
    loss = F.array_join(trained_texts(F.col("formatted"), F.col("loss_spans")), "")
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    out = out.withColumns({"loss": loss, "said": said})
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2("said", 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).select("doc_id", "held_out", "score", "predicted")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "item_words", "matched", "similarity")


QUERIES = {f.__name__: f for f in (op1_pii, op2_simhash, op3_secrets, op4_suffix_dedup, op5_quality_rules, op6_chat_format, op7_token_counts, op8_packing, op9_quality_model, op10_decontamination)}

_HEAD, _TAIL = len('<turn role="">\n'), len("\n</turn>\n")


def _seeds_sql(words: str, masks: list[str]) -> str:
    """Unnests (mask, position from 1, words under the mask) of a list of words."""
    one = "list_transform(range(1, len({w}) - {n} + 2), lambda p: {{'m': {k}, 'p': p, 's': {words}}})"
    return "list_concat(" + ", ".join(one.format(w=words, n=len(m), k=k, words=" || ' ' || ".join(f"{words}[p + {i}]" for i, x in enumerate(m) if x == "1")) for k, m in enumerate(masks)) + ")"


def _words_sql(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


ORACLE_SQL: dict[str, str] = {
    # All items of the tables have more words than the masks.
    "op10_decontamination": f"""
        WITH d AS (SELECT doc_id, {_words_sql("text")} AS w FROM documents), b AS (SELECT item_id, {_words_sql("text")} AS v FROM benchmark),
        ds AS (SELECT doc_id, unnest({_seeds_sql("w", MASKS)}) AS x FROM d), bs AS (SELECT item_id, unnest({_seeds_sql("v", MASKS)}) AS x FROM b),
        hits AS (SELECT DISTINCT doc_id, item_id, ds.x.p - bs.x.p AS off FROM ds JOIN bs ON ds.x.m = bs.x.m AND ds.x.s = bs.x.s),
        e AS (SELECT doc_id, item_id, len(v) AS n, least(len(v), {OVERLAP}) AS span,
            list_transform(range(1, len(v) + 1), lambda k: CASE WHEN k + off >= 1 AND w[k + off] = v[k] THEN 1 ELSE 0 END) AS eq FROM hits JOIN d USING (doc_id) JOIN b USING (item_id)),
        f AS (SELECT doc_id, item_id, n, list_sum(eq) AS matched, list_max(list_transform(range(1, n - span + 2), lambda i: list_sum(eq[i : i + span - 1]))) >= {SIMILARITY} * span AS near FROM e)
        SELECT doc_id, item_id, CAST(any_value(n) AS BIGINT) AS item_words, CAST(max(matched) AS BIGINT) AS matched, max(matched) / any_value(n) AS similarity
        FROM f WHERE near OR matched >= {SIMILARITY} * n GROUP BY doc_id, item_id""",
    "op6_chat_format": rf"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
            UNION ALL SELECT -7, n, role, '\### Assistant: </turn> ok', role, '' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(n, role)
        ), sized AS (
            SELECT *, {_HEAD + _TAIL} + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '"', '&quot;'))
                + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '"', '&quot;')) AS chars FROM said
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM sized GROUP BY conv_id""",
}
