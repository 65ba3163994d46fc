"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

Only a document's length matters to its place, and there are at most ``capacity`` lengths. The
heuristic therefore runs on the number of pieces of each length: it fills one bin greedily with
the longest piece that still fits, replaces the bin's smallest piece by the two unpacked pieces
that fill the gap with it more tightly, and repeats this bin as often as the counts allow. That
is the packing of all documents together, while what the driver holds is ``capacity`` counts and
the bins' patterns. Pieces then find their places by their number among those of their length:
a count per file and length, summed up over the files, plus the number within the file.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabkit.llm.texts import blocks
from tabkit.llm.tokens import Encoder, crc_of_lists, encoder_of, lists_of, with_end

PIECES = "doc_id long, piece int, start long, length long, ids array<int>, part int, nth long"


@dataclass
class Plan:
    """Slots by length and number: ``key`` is length << 40 | number of the first piece they hold."""
    key: np.ndarray
    repeats: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = np.searchsorted(self.key, (length << 40) | number, "right") - 1
        within = number - (self.key[slot] & ((1 << 40) - 1))
        nth, copy = np.divmod(within, self.repeats[slot])
        return self.sequence[slot] + copy, self.offset[slot] + nth * length


def best_pair(free: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two free lengths with the largest sum up to ``room``."""
    have = np.flatnonzero(free > 0)
    a = have[have < room]
    if not len(a):
        return None
    at = np.searchsorted(have, room - a, "right") - 1
    b = np.where(at >= 0, have[np.maximum(at, 0)], 0)
    alone = (a == b) & (free[a] < 2)                        # one piece can't be taken twice
    at = np.where(alone, at - 1, at)
    b = np.where(at >= 0, have[np.maximum(at, 0)], 0)
    total = np.where(at >= 0, a + b, 0)
    best = int(np.argmax(total))
    return (int(a[best]), int(b[best])) if total[best] else None


def best_two_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Pack ``counts[length]`` pieces of each length up to ``capacity``."""
    left = np.array(counts, np.int64)
    left[0] = 0
    taken = np.zeros(capacity + 1, np.int64)
    slots, sequences = [], 0
    while left.any():
        used = np.zeros(capacity + 1, np.int64)
        gap, content = capacity, []
        while gap > 0:
            fits = np.flatnonzero(left[:gap + 1] > used[:gap + 1])
            if not len(fits):
                break
            size = int(fits[-1])
            n = int(min(left[size] - used[size], gap // size))
            used[size] += n
            gap -= n * size
            content.append(size)
        smallest = content[-1]
        if gap and used.sum() > 1:
            pair = best_pair(left - used, gap + smallest)
            if pair and sum(pair) > smallest:
                used[smallest] -= 1
                for size in pair:
                    used[size] += 1
        sizes = np.flatnonzero(used)
        repeats, offset = int((left[sizes] // used[sizes]).min()), 0
        for size in sizes[::-1]:
            slots.append((int(size) << 40 | int(taken[size]), repeats, sequences, offset))
            offset += int(size * used[size])
            taken[size] += used[size] * repeats
        left -= used * repeats
        sequences += repeats
    key, repeats, sequence, offset = np.array(sorted(slots), np.int64).reshape(-1, 4).T
    return Plan(key, repeats, sequence, offset, sequences)


def write_pieces(docs: DataFrame, path: str, tokenizer: str, end_id: int, capacity: int) -> None:
    """Tokenize, append the end id, cut documents longer than ``capacity`` and write the pieces.

    A cut document's first piece takes the remainder, the others are full. A null or empty text is
    the end id alone. Rows with equal or null doc_id are documents of their own.
    """
    definition = encoder_of(docs.sparkSession, tokenizer)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, part = Encoder(definition.value), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in blocks(batches, limit=6 << 20):
            ids, counts = with_end(*encoder.encode(batch.column("text")), end_id)
            n = -(-counts // capacity)
            row = np.repeat(np.arange(len(counts)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            head = counts - (n - 1) * capacity
            length = np.where(piece == 0, head[row], capacity)
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            group = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
            nth = np.empty(len(row), np.int64)
            nth[order] = np.arange(len(row)) - np.repeat(group, np.diff(np.append(group, len(row))))
            nth += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                 lists_of(ids, length), pa.array(np.full(len(row), part, np.int32)), pa.array(nth)],
                ["doc_id", "piece", "start", "length", "ids", "part", "nth"])

    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)
     .write.parquet(path))


def placed_pieces(spark: SparkSession, path: str, capacity: int) -> DataFrame:
    """Every written piece with ids_crc32, sequence_id and offset; the ids stay in the files."""
    def digest(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(crc_of_lists(batch.column("ids")), pa.int64())], [*kept, "ids_crc32"])

    kept = ["doc_id", "piece", "start", "length", "part", "nth"]
    pieces = spark.read.parquet(path)
    by_file = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_file.groupBy("length").agg(F.sum("n").alias("n")).collect():        # one row per length
        counts[r["length"]] = r["n"]
    plan = spark.sparkContext.broadcast(best_two_fit(counts, capacity))
    before = Window.partitionBy("length").orderBy("part")
    bases = by_file.select("part", "length", (F.sum("n").over(before) - F.col("n")).alias("base"))

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sequence, offset = plan.value.place(*(batch.column(c).to_numpy() for c in ("length", "number")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "part")),
                                              pa.array(sequence), pa.array(offset)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "part", "sequence_id", "offset"])

    return (pieces.mapInArrow(digest, "doc_id long, piece int, start long, length long, part int, nth long, ids_crc32 long")
            .join(bases, ["part", "length"])
            .select("doc_id", "piece", "start", "length", "ids_crc32", "part", (F.col("base") + F.col("nth")).alias("number"))
            .mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, sequence_id long, offset long"))


def pack(docs: DataFrame, path: str, tokenizer: str, end_id: int, capacity: int = 1024) -> DataFrame:
    """Pack ``docs`` (doc_id, text): pieces go to ``path``, their places are returned."""
    write_pieces(docs, path, tokenizer, end_id, capacity)
    return placed_pieces(docs.sparkSession, path, capacity)


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids. A sequence has at most ``capacity`` pieces."""
    key = ["part", "length", "start", "doc_id", "piece"]
    both = pieces.join(places.select("part", "doc_id", "piece", "start", "length", "sequence_id", "offset"),
                       [pieces[c].eqNullSafe(places[c]) for c in key])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return both.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
