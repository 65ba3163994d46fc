"""Registered queries of this subpackage. Each reads whole tables and returns its full result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabkit.llm import (decontaminate, divergence, jaccard_join, lines, mixing, packing, pii, quality, repeats, secrets, spelling, tokens,
                        toxicity)
from tabkit.sources.workspace import new_path

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")

QUERIES = {}
ORACLES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_containment_search(spark, folder):
    """Every document with every benchmark item that it holds."""
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLES["op1_containment_search"] = decontaminate.CONTAINED_SQL


@query
def op2_best_two_fit(spark, folder):
    """Every document packed into sequences of at most 1024 tokens."""
    places = packing.pack(table(spark, folder, "documents"), new_path(spark, "pieces"), BYTE_BPE, end_id=2)
    return places.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op3_randomness_battery(spark, folder):
    """Secrets in every document: known forms and tokens as random as keys."""
    return secrets.secret_spans(table(spark, folder, "documents"))


@query
def op4_boosted_candidates(spark, folder):
    """Personal data in every document: known forms and chosen candidates."""
    return pii.personal_spans(table(spark, folder, "documents"))


@query
def op5_ngram_ratio(spark, folder):
    """Every document's counts, n-gram log-likelihood ratio and verdict."""
    scored = quality.quality_scores(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"))
    return scored.select("doc_id", *quality.COUNTS, "base_failed", "kept", "score")


@query
def op6_nearest_labelled(spark, folder):
    """Every document's toxicity score from its nearest labelled examples."""
    scored = toxicity.toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query
def op7_fuzzy_lines(spark, folder):
    """Every document's lines that repeat or nearly repeat an earlier one anywhere."""
    docs = table(spark, folder, "documents")
    return lines.line_counts(docs, lines.removed_lines(docs))


@query
def op8_universe_partition(spark, folder):
    """Every document's shingle count and component of near duplicates."""
    return jaccard_join.jaccard_components(table(spark, folder, "documents"))


@query
def op9_token_table(spark, folder):
    """Every document's token ids written to Parquet and read back."""
    path = new_path(spark, "tokens")
    tokens.write_token_table(table(spark, folder, "documents"), path, BYTE_BPE, end_id=0)
    return tokens.token_digest(spark, path)


@query
def op10_repeated_passages(spark, folder):
    """Every document without the bytes of 200-byte strings that start anywhere else."""
    return repeats.without_repeats(table(spark, folder, "documents"), 200)


@query
def op11_curriculum(spark, folder):
    """Every document's share of the mix and its first place in training, in that order."""
    schedule = mixing.rotating(mixing.FALLING, mixing.MIDDLE, mixing.RISING)
    mix = mixing.mixed(table(spark, folder, "documents"), schedule)
    first = F.get("placements", F.lit(0))["place"].alias("place")
    return mix.select("doc_id", "size", "source_size", "target", "taken", first).orderBy("place", "doc_id")


ORACLES["op11_curriculum"] = mixing.MIXED_SQL


@query
def op12_run_lengths(spark, folder):
    """Every source's distance from the others of its language, and its foremost terms."""
    return divergence.source_divergence(table(spark, folder, "documents"))


ORACLES["op12_run_lengths"] = divergence.DIVERGENCE_SQL


@query
def op13_letter_signatures(spark, folder):
    """Every word with its commoner form, the root where forms lead, and its near words."""
    return spelling.spelling_variants(table(spark, folder, "documents"))
