"""Token ids of documents, and their Parquet table with selective reads.

The table has one row per document in ascending doc_id order: ``doc_id``, ``part`` (file number),
``first`` (ids before it in its file), ``n_tokens`` and ``ids`` (list of int). Ids are dictionary
encoded or, with ``encoding="delta"``, delta packed; row groups and pages have given sizes, and
the column index of each page lets a reader skip pages by doc_id and columns it does not name.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabkit.llm.texts import blocks, raw
from tabkit.sources.workspace import ship_package

PIECE = 1 << 14
KEPT = 1 << 20                                              # pieces whose ids an encoder keeps
_loaded: dict[int, tuple] = {}


class Encoder:
    """The tokenizers library over columns of text, each distinct word encoded once.

    Words of earlier blocks keep their ids, up to ``KEPT`` of them; then a new set begins.

    Text is cut before a space or line feed that follows a printable character. The byte-level
    pattern always begins a new pre-token there, so pieces encode as they do within the text.
    Other tokenizers encode whole texts (``split=False``).
    """

    def __init__(self, definition: str, split: bool | None = None):
        import json
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        key = zlib.crc32(definition.encode())
        if key not in _loaded:
            tokenizer = Tokenizer.from_str(definition)
            about = json.loads(definition)
            pre = about.get("pre_tokenizer") or {}
            can = (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
                   and not about.get("normalizer"))
            sizes = None
            if can:
                vocabulary = tokenizer.get_vocab()
                sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
                for token, i in vocabulary.items():
                    sizes[i] = len(token)                   # one printable character stands for each byte
            _loaded[key] = tokenizer, sizes
        self.tokenizer, self.sizes = _loaded[key]
        self.split = self.sizes is not None if split is None else split
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids, self.starts = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column, and how many each text has."""
        if not self.split:
            column = column.fill_null("") if column.null_count else column
            found = self.tokenizer.encode_batch_fast(column.to_pylist(), add_special_tokens=False)
            counts = np.fromiter((len(x.ids) for x in found), np.int64, len(found))
            return np.fromiter(itertools.chain.from_iterable(x.ids for x in found), np.int32, counts.sum()), counts
        data, offsets = raw(column)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        cut = np.zeros(len(data) + 1, bool)
        printable = (data[:-1] > 32) & (data[:-1] < 127)
        printable[1:] |= (data[1:-1] >= 128) & (data[:-2] == 0xC3)      # Latin letters of two bytes
        cut[1:-1] = ((data[1:] == 32) | (data[1:] == 10)) & printable
        cut[offsets] = True
        at = np.flatnonzero(cut)
        pieces = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))
        coded = pieces.dictionary_encode()
        ids, starts, place = self._looked_up(coded.dictionary)
        which = place[coded.indices.to_numpy()]
        counts = np.diff(starts)[which]
        ends = np.cumsum(counts)
        take = np.arange(ends[-1]) + np.repeat(starts[which] - ends + counts, counts)
        until = np.concatenate([np.zeros(1, np.int64), ends])[np.searchsorted(at, offsets)]
        return ids[take], np.diff(until)

    def _looked_up(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all known pieces, where each piece's begin, and which of them the given ones are."""
        if len(self.known) > KEPT:
            self._forget()
        place = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(place.is_null())
        place = place.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        place[place < 0] = len(self.known) + np.arange(len(new))
        if len(new):
            ids, starts = self._distinct(new)
            self.starts = np.concatenate([self.starts, starts[1:] + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])
            self.known = pa.concat_arrays([self.known, new])
        return self.ids, self.starts, place

    def _distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each piece one after another, and where each piece's begin.

        Pieces are encoded as a few long texts; the bytes of each token tell where a piece ends.
        A text is joined only where the cut rule holds, so a piece that begins a document
        (no space or line feed before it) begins a text of its own.
        """
        data, offsets = raw(pieces)
        lead = data[np.minimum(offsets[:-1], len(data) - 1)]
        last, before = data[offsets[1:] - 1], data[np.maximum(offsets[1:] - 2, 0)]
        printable = ((last > 32) & (last < 127)) | ((last >= 128) & (before == 0xC3))
        apart = ~((lead == 32) | (lead == 10))
        apart[1:] |= ~printable[:-1]
        group = np.cumsum(apart) + offsets[:-1] // PIECE
        begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        text = pa.StringArray.from_buffers(len(begins), pa.py_buffer(np.append(offsets[begins], offsets[-1]).astype(np.int32)),
                                           pa.py_buffer(data))
        found = self.tokenizer.encode_batch_fast(text.to_pylist(), add_special_tokens=False)
        lists = [x.ids for x in found]
        ids = np.fromiter(itertools.chain.from_iterable(lists), np.int32, sum(map(len, lists)))
        ends = np.cumsum(self.sizes[ids])
        if len(ends) and ends[-1] != offsets[-1]:
            raise ValueError("the tokens' bytes are not the text's")
        return ids, np.concatenate([[0], np.searchsorted(ends, offsets[1:], "left") + 1])


def encoder_of(spark: SparkSession, path: str):
    """The tokenizer's definition for all workers: one file, whose size does not depend on the data."""
    ship_package(spark)
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append one id to each document."""
    ends = np.cumsum(counts)
    return np.insert(ids, ends, end), counts + 1


def lists_of(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))


def crc_of_lists(column: pa.Array) -> list[int]:
    """Unsigned crc32 of each list as little-endian unsigned 32-bit integers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = memoryview(column.values.to_numpy().astype("<u4").tobytes())
    at = column.offsets.to_numpy()
    return [zlib.crc32(values[4 * a:4 * b]) for a, b in zip(at[:-1], at[1:])]


def write_token_table(docs: DataFrame, path: str, tokenizer: str, end_id: int, *, encoding: str = "dictionary",
                      row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> None:
    """Encode ``docs`` (doc_id, text; other columns are left out) and write the table.

    Rows are range partitioned by doc_id and, among equal ones, by a hash of the text, so that no
    doc_id has to fit in one task. A null or empty text gives the end id alone; null doc_ids come
    first; repeated rows stay. An empty input writes an empty table.
    """
    spark = docs.sparkSession
    definition = encoder_of(spark, tokenizer)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before, part = Encoder(definition.value), 0, TaskContext.get().partitionId()
        for batch in blocks(batches, limit=6 << 20):
            ids, counts = with_end(*encoder.encode(batch.column("text")), end_id)
            first = before + np.cumsum(counts) - counts
            before += int(counts.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(counts), part, np.int32)), pa.array(first), pa.array(counts),
                 lists_of(ids, counts)], ["doc_id", "part", "first", "n_tokens", "ids"])

    order = ["doc_id", "tie"]
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
     .repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
     .mapInArrow(encode, "doc_id long, part int, first long, n_tokens long, ids array<int>")
     .write.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
     .option("parquet.page.write-checksum.enabled", "true")
     .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
     .option("parquet.writer.version", "v2" if encoding == "delta" else "v1")
     .parquet(path))


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows whose doc_id is in the range; the bounds reach the row groups and pages."""
    table = spark.read.parquet(path)
    table = table if first is None else table.filter(F.col("doc_id") >= first)
    return table if last is None else table.filter(F.col("doc_id") <= last)


def token_starts(spark: SparkSession, path: str) -> DataFrame:
    """``part`` and ``base``: the ids in all files before it, from the table's small columns."""
    sums = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files."""
    def digest(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "part", "first")), batch.column("ids").value_lengths().cast(pa.int64()),
                 pa.array(crc_of_lists(batch.column("ids")), pa.int64())],
                ["doc_id", "part", "first", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).mapInArrow(digest, "doc_id long, part int, first long, n_tokens long, ids_crc32 long")
    return rows.join(token_starts(spark, path), "part").select(
        "doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
