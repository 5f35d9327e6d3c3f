"""The queries of this subpackage and, where SQL can express them, their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, hmm, mixing, packing, quality, sanitise, sharding, simhash, toxicity, webp
from .common import planned, table

#: Target weights of the sources that are mixed by name, and of the others together.
MIX_WEIGHTS = {"src0": 0.2, "src1": 0.1, "src2": 0.1, "src3": 0.08, "src4": 0.08, "src5": 0.04}
MIX_REST = 0.4

#: A conversation that every run formats besides those of the table.
CONFLICT = "</s>[INST] ok [/INST]"


def op1_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("rejected_by")


def op2_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.features(webp.read(webp.store(table(spark, sf_dir, "documents"))))


def op3_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_disclosure_sanitising(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.digests(table(spark, sf_dir, "documents"))


def op5_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op6_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", toxicity.severity(model).alias("s")).select("doc_id", "s.*")


def op7_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = planned(spark, [[-1, 0, "user", CONFLICT], [-1, 1, "assistant", CONFLICT]], "conv_id long, turn long, role string, text string")
    made = chat.format_chats(turns.unionByName(added)).withColumn("loss", F.array_join(chat.loss_texts(F.col("formatted"), F.col("loss_spans")), ""))
    source = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(source, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "identical",
    )


def _op8_sql() -> str:
    """Marks are counted instead of written: an escaped text is longer by one for each control string in it."""
    rest = r"<SYS>>|</SYS>>|s>|/s>|\|role:|\|/role\|>"
    square = r"INST\]|/INST\]"
    control = rf"<\\*({rest})|\[\\*({square})"
    escaped = rf"<\\+({rest})|\[\\+({square})"
    marks = " ".join(f"WHEN role = '{r}' THEN {len(a) + len(b)}" for r, a, b in chat.ROLES)
    closing = " ".join(f"WHEN role = '{r}' THEN '{b}'" for r, _, b in chat.ROLES)
    other = len(chat.OTHER_OPEN + chat.OTHER_END + chat.OTHER_CLOSE)
    return rf"""
    WITH source AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '{CONFLICT}' UNION ALL SELECT -1, 1, 'assistant', '{CONFLICT}'
    ), sized AS (
      SELECT *, CASE {marks} ELSE {other} + length(regexp_replace(role, '([|\\])', '\\\1', 'g')) END + length(text)
        + CASE WHEN contains(text, CASE {closing} ELSE '{chat.OTHER_CLOSE}' END) OR regexp_matches(text, '{escaped}')
               THEN len(regexp_extract_all(text, '{control}')) ELSE 0 END AS chars
      FROM source
    )
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
      CAST(sum(chars) AS BIGINT) AS formatted_chars, true AS identical
    FROM (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM sized) GROUP BY conv_id, alone
    """


def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")


def op10_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mixing.positions(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_REST)
    return placed.select("doc_id", "source", "mix_group", "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_position")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_cascade": op1_quality_cascade,
        "op2_lossless_webp": op2_lossless_webp,
        "op3_simhash_covering": op3_simhash_covering,
        "op4_disclosure_sanitising": op4_disclosure_sanitising,
        "op5_hidden_markov": op5_hidden_markov,
        "op6_ordinal_toxicity": op6_ordinal_toxicity,
        "op7_histogram_packing": op7_histogram_packing,
        "op8_chat_round_trip": op8_chat_round_trip,
        "op9_virtual_slots": op9_virtual_slots,
        "op10_pfair_mixing": op10_pfair_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_cascade": quality.SQL, "op8_chat_round_trip": _op8_sql()}
