"""Toxicity from the nearest labelled examples under exact TF-IDF cosine.

Examples are a bounded sample of the labelled rows (``examples`` per class, smallest hashes of
doc_id first). Terms are words without outer punctuation, in lower case, and their first four to nine
bytes, each also as a term of its own where it stands twice, three or five times in a text; the
``terms`` of them most associated with the label in the examples make the vectors, and their
document frequencies are counted over all documents. The index has, for each
term and block of examples, the postings and their largest weight. A query takes blocks by the
bound that these maxima give and stops when no other block can hold one of its ``k`` nearest, so
the neighbours are exact. Votes are weighted by similarity and calibrated on the examples, each
scored without itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.llm.texts import blocks, lower_ascii, mixed, prefix_sums, raw, span_hashes, words
from tabkit.sources.workspace import ship_package

PREFIXES = (4, 5, 6, 7, 8, 9)
LEVELS = (1, 2, 3, 5)
TRIMMED = np.isin(np.arange(256), np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8))
BLOCK = 64


def term_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each occurrence of a term."""
    data, offsets = raw(batch.column("text"))
    data = lower_ascii(data)
    starts, ends, doc = words(data, offsets)
    for _ in range(2):                                      # up to two outer marks on each side
        starts = starts + ((ends - starts > 1) & TRIMMED[data[np.minimum(starts, len(data) - 1)]])
        ends = ends - ((ends - starts > 1) & TRIMMED[data[ends - 1]])
    sums = prefix_sums(data)
    out, owners = [span_hashes(sums, starts, ends)], [doc]
    for n in PREFIXES:
        long = ends - starts > n
        out.append(mixed(span_hashes(sums, starts[long], starts[long] + n) + np.uint64(n)))
        owners.append(doc[long])
    return np.concatenate(owners), np.concatenate(out)


class Vocabulary:
    """Chosen terms: a hash, and the occurrences from which on the term is there."""

    def __init__(self, hashes: np.ndarray, levels: np.ndarray):
        self.hashes, at = np.unique(hashes.astype(np.uint64), return_inverse=True)
        self.number = np.full((len(self.hashes) + 1, len(LEVELS)), -1)
        self.number[at, np.searchsorted(LEVELS, levels)] = np.arange(len(hashes))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def counted(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, term number and count, by document and term."""
        doc, term = term_rows(batch)
        keep = self.maybe[(term >> np.uint64(44)).astype(np.int64)]
        doc, term = doc[keep], term[keep]
        at = np.searchsorted(self.hashes, term)
        keep = at < len(self.hashes)
        keep[keep] = self.hashes[at[keep]] == term[keep]
        size = np.int64(len(self.hashes) + 1)
        key, n = np.unique(doc[keep] * size + at[keep], return_counts=True)
        doc, at = np.divmod(key, size)
        out = []
        for column, level in enumerate(LEVELS):
            own = (n >= level) & (self.number[at, column] >= 0)
            out.append((doc[own], self.number[at[own], column], n[own] if level == 1 else np.ones(own.sum(), np.int64)))
        doc, term, n = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((term, doc))
        return doc[order], term[order], n[order]


def unit(doc: np.ndarray, term: np.ndarray, n: np.ndarray, idf: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF weights of unit length per document, and the length that each document had."""
    w = (1 + np.log(n)) * idf[term] if len(n) else np.zeros(0)
    length = np.sqrt(np.bincount(doc, weights=w * w, minlength=documents))
    return (w / length[doc] if len(n) else w), length


def expanded(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of several ranges, and the range of each."""
    n = ends - starts
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + starts[which], which


class BlockMaxIndex:
    """Postings of unit vectors by term and block of ``BLOCK`` examples, with the blocks' largest weights."""

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, examples: int, terms: int):
        self.blocks = max(1, -(-examples // BLOCK))
        cell = term * self.blocks + example // BLOCK
        order = np.lexsort((example, cell))
        self.example, self.weight = example[order], weight[order]
        self.bounds = np.searchsorted(cell[order], np.arange(terms * self.blocks + 1))
        self.most = np.zeros((max(terms, 1), self.blocks))
        np.maximum.at(self.most.reshape(-1), cell, weight)

    def nearest(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, documents: int, k: int,
                but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each document its k examples of largest cosine (smallest number among ties), -1 where
        fewer are above 0, and the cosines. ``but``: an example that each document must not take.
        """
        best = np.full((documents, k), -1.0)
        who = np.full((documents, k), -1, np.int64)
        first = np.searchsorted(doc, np.arange(documents + 1))
        some = np.flatnonzero(np.diff(first))
        if not len(some):
            return who, best
        bound = np.zeros((documents, self.blocks))
        bound[some] = np.add.reduceat(self.most[term] * weight[:, None], first[some], axis=0)
        ranked = np.argsort(-bound[some], axis=1, kind="stable")
        live = np.arange(len(some))
        for r in range(self.blocks):
            block = ranked[live, r]
            top = bound[some[live], block]
            go = (top > 0) & (top + 1e-9 >= best[some[live], -1])
            live, block = live[go], block[go]
            if not len(live):
                break
            q = some[live]
            entry, row = expanded(first[q], first[q + 1])
            cell = term[entry] * self.blocks + block[row]
            posting, pair = expanded(self.bounds[cell], self.bounds[cell + 1])
            slot = row[pair] * BLOCK + self.example[posting] % BLOCK
            score = np.bincount(slot, weights=weight[entry][pair] * self.weight[posting], minlength=len(q) * BLOCK)
            score = np.round(score.reshape(len(q), BLOCK), 9)
            names = block[:, None] * BLOCK + np.arange(BLOCK)
            score[(score <= 0) | (False if but is None else names == but[q][:, None])] = -1
            both = np.concatenate([best[q], score], axis=1)
            all_names = np.concatenate([who[q], names], axis=1)
            order = np.lexsort((all_names, -both), axis=1)[:, :k]
            best[q] = np.take_along_axis(both, order, 1)
            who[q] = np.where(best[q] > 0, np.take_along_axis(all_names, order, 1), -1)
        return who, best


def votes(who: np.ndarray, best: np.ndarray, toxic: np.ndarray, base: float, prior: float = 0.1) -> np.ndarray:
    """Share of similarity that votes toxic, drawn towards the base rate by ``prior``."""
    near = np.where(who >= 0, best, 0.0)
    yes = (near * (toxic[np.maximum(who, 0)] == 1)).sum(1)
    return (yes + prior * base) / (near.sum(1) + prior)


def seen_by(vote: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What the calibration sees: the vote, how much text backs it, and both together."""
    backing = np.log1p(length)
    return np.stack([vote, backing, vote * backing, np.ones_like(vote)], 1)


START = np.array([8.0, 0.0, 0.0, -4.0])


def calibration(x: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Coefficients of a weighted logistic curve, with a slight pull to a plain one in the vote."""
    theta, pull = START.copy(), 0.3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (weight * (toxic - p)) - pull * (theta - START)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(START)), gradient)
        theta = theta + step
        if np.abs(step).max() < 1e-8:
            break
    return theta


def held_out(doc_id):
    """Rows that no label may be learned from: crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def association(yes, no, all_yes: int, all_no: int):
    """Log-likelihood ratio of a term's document counts in the two classes."""
    n, total = yes + no, all_yes + all_no
    part = lambda seen, of: F.when(seen > 0, seen * F.log(seen * total / (n * of))).otherwise(0.0)
    rest = lambda seen, of: F.when(seen < of, (of - seen) * F.log((of - seen) * total / ((total - n) * of))).otherwise(0.0)
    return 2 * (part(yes, all_yes) + part(no, all_no) + rest(yes, all_yes) + rest(no, all_no))


def fit(docs: DataFrame, labels: DataFrame, *, examples: int = 1500, terms: int = 4096, least: float = 20.0, k: int = 16):
    """The index and all that scoring needs; at most 2 * ``examples`` rows and ``terms`` terms reach the driver."""
    spark = docs.sparkSession
    ship_package(spark)
    known = (labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    sample = []
    for y in (1, 0):
        sample += known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples).collect()
    chosen = spark.createDataFrame(sample, "doc_id long, toxic int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            doc, term = term_rows(batch)
            order = np.lexsort((term, doc))
            doc, term = doc[order], term[order]
            first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])])[:len(doc)])
            n = np.diff(np.append(first, len(doc)))
            for level in LEVELS:
                at = first[n >= level]
                yield pa.RecordBatch.from_arrays([pa.array(term[at].view(np.int64)), pa.array(np.full(len(at), level, np.int32)),
                                                  batch.column("toxic").take(pa.array(doc[at]))], ["term", "level", "toxic"])

    n = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    yes, no = n.get(1, 0), n.get(0, 0)
    top = []
    if yes and no:
        counts = (texts.mapInArrow(found, "term long, level int, toxic int").groupBy("term", "level")
                  .agg(F.sum("toxic").alias("yes"), F.sum(1 - F.col("toxic")).alias("no"))
                  .withColumn("g", association(F.col("yes"), F.col("no"), yes, no)).filter(F.col("g") >= least))
        top = counts.orderBy(F.desc("g"), "term", "level").limit(terms).collect()
    hashes = np.array([r["term"] for r in top], np.int64)
    vocabulary = Vocabulary(hashes.view(np.uint64), np.array([r["level"] for r in top], np.int64))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(hashes), np.int64), 0
        for batch in blocks(batches):
            total += np.bincount(vocabulary.counted(batch)[1], minlength=len(hashes))
            rows += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(hashes) + 1)), pa.array(np.append(total, rows))], ["term", "n"])

    seen = np.zeros(len(hashes) + 1)
    for r in docs.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        seen[r["term"]] = r["n"]
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            doc, term, n = vocabulary.counted(batch)
            first = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(first), pa.array(x))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), lists(term), lists(n)], ["doc_id", "toxic", "term", "n"])

    rows = sorted(texts.mapInArrow(vectors, "doc_id long, toxic int, term array<long>, n array<long>").collect())
    toxic = np.array([r["toxic"] for r in rows], np.int64)
    name = np.array([r["doc_id"] for r in rows], np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(r["term"]) for r in rows]).astype(np.int64)
    term = np.array([t for r in rows for t in r["term"]], np.int64)
    weight, length = unit(doc, term, np.array([x for r in rows for x in r["n"]], np.int64), idf, len(rows))
    index = BlockMaxIndex(doc, term, weight, len(rows), len(hashes))
    who, best = index.nearest(doc, term, weight, len(rows), k, but=np.arange(len(rows)))
    vote = votes(who, best, toxic, share)
    balance = np.where(toxic == 1, share / max(yes, 1), (1 - share) / max(no, 1)) * len(rows)
    curve = calibration(seen_by(vote, length), toxic, balance) if yes and no else START
    return vocabulary, idf, index, toxic, name, share, curve


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, k: int = 16, evidence: int = 3, **fitting) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (nearest examples) of every row of ``docs``.

    Null and empty texts, and texts without a known term, get the score of no evidence. Without
    labelled rows of both classes every score is that one. Repeated rows each get their row; other
    columns are not read. Rows with null doc_id are scored and count as not held out.
    """
    spark = docs.sparkSession
    vocabulary, idf, index, toxic, name, share, curve = fit(docs, labels, k=k, **fitting)
    model = spark.sparkContext.broadcast((vocabulary, idf, index, toxic, name))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, idf, index, toxic, name = model.value
        for batch in blocks(batches):
            doc, term, n = vocabulary.counted(batch)
            weight, length = unit(doc, term, n, idf, batch.num_rows)
            who, best = index.nearest(doc, term, weight, batch.num_rows, k)
            vote = votes(who, best, toxic, share) if len(toxic) else np.full(batch.num_rows, share)
            out = 1 / (1 + np.exp(-np.clip(seen_by(vote, length) @ curve, -30, 30)))
            shown = who[:, :evidence]
            first = np.concatenate([[0], np.cumsum((shown >= 0).sum(1))]).astype(np.int32)
            at = shown[shown >= 0]
            near = pa.StructArray.from_arrays([pa.array(name[at]), pa.array(toxic[at].astype(np.int32)), pa.array(best[:, :evidence][shown >= 0])],
                                              ["doc_id", "toxic", "similarity"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out), pa.array((out >= 0.7).astype(np.int32)), pa.ListArray.from_arrays(pa.array(first), near)],
                ["doc_id", "score", "predicted", "evidence"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(score, "doc_id long, score double, predicted int, "
                               "evidence array<struct<doc_id: long, toxic: int, similarity: double>>")
            .select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "evidence"))
