"""From raw documents to token ids, in five stages that each keep the columns of documents but the last.

language: documents in which no language is recognised go.
near_duplicates: of each group of near-duplicates, proposed by SimHash and checked exactly, the one with the least id stays.
secrets: found secrets are masked in the texts.
mixing: sources are brought to their target weights; documents are dropped or repeated.
tokens: each document's ids, and the text they decode to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import bpe, langid, mixing, secrets, simhash
from lamina.llm.common import cut, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A long text whose best cosine is lower than this is in no known language. Of a text of n trigrams sqrt(n / (n + FEW)) times that is asked: few trigrams
#: are less like any prototype.
LEAST_COSINE = 0.12
FEW = 50
#: Near-duplicates: distinct runs of five words and a similarity of 0.8 or more.
SHINGLE = 5
SIMILARITY = 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts unlike every language learned; the rest is unchanged."""
    langs, protos = langid.learn(docs, F.lit(True))
    found = langid.predict(docs, langs, protos, keep=COLUMNS, counts=True)
    n = F.col("n_trigrams")
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_COSINE * F.sqrt(n / (n + FEW)))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the least id of each component; rows with a null id stay. Of rows with equal ids all stay or go."""
    found = simhash.similar_texts(docs, k=SHINGLE, threshold=SIMILARITY)
    gone = cut(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == F.col("_gone"), "left_anti").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every span found; n_chars follows where a text changes."""
    clean = secrets.redact(docs.select(*COLUMNS, F.col("text").alias("_before")))
    n = F.when(F.col("text").eqNullSafe(F.col("_before")), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))
    return clean.withColumn("n_chars", n).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document 0 to 3 times, so that the sources' words meet their targets."""
    taken = mixing.mix(docs.select(*COLUMNS))
    return taken.where("mix_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of each row."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix),
    ("tokens", tokens),
]

#: Profiles, fingerprints, entropies, knapsack and merges are beyond SQL; tests hold each stage against plain restatements.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each but the last is written as a table in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
