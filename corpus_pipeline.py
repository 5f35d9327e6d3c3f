"""From documents to packed training sequences: reject toxic texts, keep one of each group of near duplicates, sanitise
personal data, mix sources to target weights, pack into sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
documents, further ones included. Texts may be of any length. Between stages the documents are written and read again, which keeps rows but not their order: what the mixing
stage decided travels as metadata of the first column (weights, from which the same positions follow), and packing fills
and numbers sequences by it.
"""

from __future__ import annotations

import json

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm import mixing, packing, sanitise, simhash, toxicity
from skarn.llm.catalogue import MIX_REST, MIX_WEIGHTS
from skarn.llm.common import Stored, named, table

#: Words of a shingle and the similarity of near duplicates.
SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Metadata of the first column of mixed documents: the weights as JSON.
MIXED = "skarn.mixed"


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labels, doesn't find toxic. Empty and null texts have no evidence
    and stay, as do null ids; equal texts share their fate; without documents or labels of both kinds nothing goes."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles are similar by 0.8 or more: that of the smallest
    doc_id, null first. Texts without words, null ones included, are one component; of equal rows one stays."""
    return simhash.deduplicate(docs, shingle=SHINGLE_WORDS, similarity=SIMILARITY)


def sanitise_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with labels for personal data and for terms that give it away; n_chars, where there is such a column,
    counts the new text. A null text stays null with its n_chars; equal texts come out equal."""
    out = sanitise.sanitise(docs)
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.coalesce(F.length(named("text")).cast(kind), F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, dealt and ordered by the schedule that interleaves sources by their target weights, which go with the
    schema. Null sources are among the rest; equal rows are placed each; no documents give no rows."""
    mixed = mixing.mix(docs, MIX_WEIGHTS, MIX_REST)
    return mixed.withMetadata(docs.columns[0], {**docs.schema[0].metadata, MIXED: json.dumps([MIX_WEIGHTS, MIX_REST])})


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place, in mixed order where the documents were mixed. Each document,
    also an empty or null one, has at least the end id; equal documents are packed each; no documents give no rows."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    mixed = docs.schema[0].metadata.get(MIXED) if docs.columns else None
    if mixed is None:
        return packing.pack(docs, tokenizer)

    def order(read: DataFrame) -> DataFrame:
        placed = mixing.positions(read, *json.loads(mixed), key=F.col("order_hash"))
        return placed.withColumnRenamed(placed.columns[-1], "place")

    return packing.pack(docs, tokenizer, carry={"source": named("source").cast("string"), "order_hash": mixing.order_hash()}, order=order)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", sanitise_texts),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Hashes of the model, fingerprints and tokenizer are not in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = Stored(stage(spark, docs, sf_dir), f"pipeline-{name}").df
    return STAGES[-1][1](spark, docs, sf_dir)
