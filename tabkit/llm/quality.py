"""Quality rules: plain counts of each text, and how much likelier its n-grams are in trusted text.

Two hashed multinomials over n-grams (words and word pairs, as written) are counted in one pass: over the
trusted documents and over the whole corpus. N-grams share 2^bits buckets; ``bits`` grows with the corpus
up to ``MOST_BITS``. A document's score is the mean over its n-grams of the log ratio of the two. Each
task adds its documents up before anything is shuffled, the ratios are one bounded array that every task
gets, and scoring moves no text. A fifth of the trusted documents is held out of the trusted counts;
the threshold is a low fence of their scores, so that it means the same at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType

from tabkit.llm.texts import blocks, is_space, joined, mixed, owner, prefix_sums, raw, span_hashes, words
from tabkit.sources.workspace import ship_package

#: Characters that count as symbols (fixed by the rule).
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
LEAST_WORDS, HELD_OUT, BLOCK, MOST_BITS, LISTED = 50, 5, 12, 22, 4_000_000
LEAST_MARGIN = 0.05
SENT = ["block", "at", "n", "spots", "trusted"]
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each (document, value) stands there twice or more, and whether it isn't the first one."""
    key = mixed(value + mixed(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again, twice = np.zeros(len(key), bool), np.zeros(len(key), bool)
    again[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, again


def per_document(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def text_counts(data: np.ndarray, offsets: np.ndarray, sums: np.ndarray, found) -> dict[str, np.ndarray]:
    """The counts of each document in a block; ``found``: its words' hashes and documents."""
    hashes, doc = found
    n = len(offsets) - 1
    solid = ~is_space(data)
    n_words = np.bincount(doc, minlength=n)
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    filled = np.concatenate([[0], np.cumsum(solid)])
    spoken = filled[ends] > filled[starts]
    starts, ends = starts[spoken], ends[spoken]
    lines = owner(starts, offsets)
    _, again = repeated(lines, span_hashes(sums, starts, ends))
    covered = np.zeros(len(doc), bool)
    if len(doc) > 2:
        whole = doc[2:] == doc[:-2]
        at = np.flatnonzero(whole)
        twice, _ = repeated(doc[at], joined([hashes[at], hashes[at + 1], hashes[at + 2]]))
        for k in range(3):
            covered[at[twice] + k] = True
    return {"n_words": n_words, "word_chars": per_document(solid & ((data & 0xC0) != 0x80), offsets),
            "n_symbols": per_document(SYMBOLS[data], offsets), "n_dup_lines": np.bincount(lines[again], minlength=n),
            "n_repeat_words": np.bincount(doc[covered], minlength=n)}


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def hashed_words(data, offsets):
    sums = prefix_sums(data)
    starts, ends, doc = words(data, offsets)
    return sums, span_hashes(sums, starts, ends), doc


def ngrams(hashes: np.ndarray, doc: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of each word and each pair of neighbouring words."""
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    both = np.concatenate([hashes, joined([hashes[pair], hashes[pair + 1]])])
    return (both >> np.uint64(64 - bits)).astype(np.int64), np.concatenate([doc, doc[pair]])


class Members:
    """Which rows of a batch have an id in a sorted array."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Trusted rows that count, and those that are held out."""
        known = column.is_valid().to_numpy(zero_copy_only=False)
        ids = column.fill_null(0).to_numpy()
        at = np.minimum(np.searchsorted(self.ids, ids), max(len(self.ids) - 1, 0))
        good = known & (self.ids[at] == ids) if len(self.ids) else np.zeros(len(ids), bool)
        out = held_out(ids)
        return good & ~out, good & out


def held_out(ids: np.ndarray) -> np.ndarray:
    return mixed(ids.astype(np.uint64) + np.uint64(1)) % np.uint64(HELD_OUT) == 0


def trusted_column(batch: pa.RecordBatch, members: Members | None) -> tuple[np.ndarray, np.ndarray]:
    if members is not None:
        return members.of(batch.column("doc_id"))
    good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
    out = held_out(batch.column("doc_id").fill_null(0).to_numpy())
    return good & ~out, good & out


def bucket_ratios(rows: DataFrame, members, bits: int, weight: float) -> np.ndarray:
    """The log ratio of each bucket: its trusted occurrences to those expected at the corpus's rate, each
    with ``weight`` occurrences more, so that it rests on the bucket's own evidence.

    A task adds its documents up in one array of at most 32 MB and sends it in blocks, without the empty buckets.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << bits), np.int32)
        for batch in blocks(batches):
            _, hashes, doc = hashed_words(*raw(batch.column("text")))
            gram, owners = ngrams(hashes, doc, bits)
            good, _ = trusted_column(batch, members.value if members else None)
            for row, some in enumerate((gram, gram[good[owners]])):
                some, n = np.unique(some, return_counts=True)
                sums[row, some] += n.astype(np.int32)
        for block in range((1 << bits) + (1 << BLOCK) - 1 >> BLOCK):
            n, trusted = sums[:, block << BLOCK:(block + 1) << BLOCK]
            at = np.flatnonzero(n)
            if len(at):
                spots = np.flatnonzero(trusted[at])
                sent = at.astype("<u2"), n[at].astype("<i4"), spots.astype("<u2"), trusted[at[spots]].astype("<i4")
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in sent)], SENT)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, at, n, where, values in zip(*(batch.column(c).to_pylist() for c in SENT)):
                both = sums.setdefault(block, np.zeros((2, 1 << BLOCK), np.int64))
                at = np.frombuffer(at, "<u2")
                both[0, at] += np.frombuffer(n, "<i4")
                both[1, at[np.frombuffer(where, "<u2")]] += np.frombuffer(values, "<i4")
        for block, both in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([both.tobytes()], pa.binary())], ["block", "sums"])

    sent = rows.mapInArrow(count, "block int, at binary, n binary, spots binary, trusted binary")
    counts = np.zeros((2, 1 << bits), np.int64)
    for r in sent.repartition("block").mapInArrow(add, "block int, sums binary").toLocalIterator():      # 2^bits numbers twice, at most 64 MB
        both = np.frombuffer(r["sums"], np.int64).reshape(2, -1)
        at = r["block"] << BLOCK
        counts[:, at:at + both.shape[1]] = both[:, :counts.shape[1]]
    rate = counts[1].sum() / max(counts[0].sum(), 1)
    return np.log((counts[1] + weight) / (counts[0] * rate + weight)).astype(np.float32)


def text_scores(hashes: np.ndarray, doc: np.ndarray, documents: int, ratios: np.ndarray) -> np.ndarray:
    """Mean log ratio of each document's n-grams; 0 without words."""
    gram, owners = ngrams(hashes, doc, int(len(ratios)).bit_length() - 1)
    n = np.bincount(owners, minlength=documents)
    return np.bincount(owners, weights=ratios[gram], minlength=documents) / np.maximum(n, 1)


def low_fence(rows: DataFrame, members, ratios, quantile: float) -> float:
    """The given quantile of held-out trusted scores, less one and a half times its distance from their median, at
    least ``LEAST_MARGIN`` (few held-out documents lie close together).

    Scores are counted in steps of 1e-4, so that what reaches the driver does not grow with the rows. Without
    held-out documents nothing is below the fence.
    """
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            _, out = trusted_column(batch, members.value if members else None)
            batch = batch.filter(pa.array(out))
            _, hashes, doc = hashed_words(*raw(batch.column("text")))
            scores = text_scores(hashes, doc, batch.num_rows, ratios.value)[np.bincount(doc, minlength=batch.num_rows) >= LEAST_WORDS]
            step, n = np.unique(np.floor(scores * 10_000).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(n)], ["step", "n"])

    found = rows.mapInArrow(score, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).orderBy("step").collect()
    if not found:
        return float("-inf")
    step, upto = np.array([r["step"] for r in found]) / 10_000, np.cumsum([r["n"] for r in found])
    low, middle = (float(step[np.searchsorted(upto, q * upto[-1], "left")]) for q in (quantile, 0.5))
    return low - max(1.5 * (middle - low), LEAST_MARGIN)


def quality_scores(docs: DataFrame, labels: DataFrame, *, bits: int | None = None, weight: float = 10.0,
                   quantile: float = 0.05, listed: int = LISTED) -> DataFrame:
    """Counts, score and verdict of every row of ``docs``; other columns than doc_id and text are passed on.

    A row is kept unless it has under 50 words, more than half of its words stand in repeated three-word
    windows, or its score is below the fence of held-out trusted scores. Null and empty texts have no
    words: counts and score are 0 and they are not kept. Texts of any length are read whole. Without trusted
    rows all scores are 0 and none is below the fence. Columns of ``docs`` named like an added column are
    left out. Repeated rows count each time and each get their row; a null doc_id has no label. An empty
    table gives no rows. Trusted ids are broadcast up to ``listed`` of them (8 bytes each); beyond, they are joined.
    """
    spark = docs.sparkSession
    ship_package(spark)
    added = [*COUNTS, "base_failed", "score", "kept"]
    passed = [c for c in docs.columns if c not in added]
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    rows, members = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL"), None
    ids = [r[0] for r in good.limit(listed + 1).collect()]
    if len(ids) <= listed:
        members = spark.sparkContext.broadcast(Members(np.sort(np.array(ids, np.int64))))
    else:
        rows = rows.join(good.withColumn("good", F.lit(True)), "doc_id", "left").withColumn("good", F.coalesce("good", F.lit(False)))
    if bits is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(MOST_BITS, max(BLOCK, (size >> 6).bit_length()))
    ratios = spark.sparkContext.broadcast(bucket_ratios(rows, members, bits, weight))
    fence = low_fence(rows, members, ratios, quantile)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            data, offsets = raw(batch.column("text"))
            sums, hashes, doc = hashed_words(data, offsets)
            counts = text_counts(data, offsets, sums, (hashes, doc))
            failed, score = base_failed(counts), text_scores(hashes, doc, batch.num_rows, ratios.value)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in passed), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS),
                 pa.array(failed), pa.array(score), pa.array(~failed & (score >= fence))], [*passed, *added])

    schema = docs.select(*passed).schema
    for c in added:
        schema = schema.add(c, DoubleType() if c == "score" else LongType() if c in COUNTS else BooleanType())
    return docs.select(*passed).mapInArrow(judge, schema)
