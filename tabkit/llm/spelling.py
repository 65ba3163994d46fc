"""Spelling variants: words of the corpus one letter apart, and the commoner form that each stands for.

A word's letters are a multiset, a binary vector over (letter, occurrence). One inserted or deleted
letter changes one place of it, a replaced letter two. The letters are partitioned into parts of about
equal use; a word is entered, for every choice of left-out parts, under the hash of its letters in the
parts that are left: pairs of one length leave out two of five parts, pairs of lengths one apart leave
out one of three. Words one letter apart agree outside the parts that the edit touches, so an
equi-join on these signatures finds them all. Within a signature only words that also share their first
or their last half are compared, since an edit leaves one of the halves alone, and letters are compared
one by one. Each pair is found under one signature and one half alone.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.llm.texts import blocks, joined, lower_ascii, mixed, owner, prefix_sums, raw, runs, span_hashes
from tabkit.sources.workspace import new_path

SAME_PARTS, NEXT_PARTS = 5, 3
PAIRS_OUT = list(itertools.combinations(range(SAME_PARTS), 2))
SIGNED = "key long, kind int, word string, n long"
_CELLS = 8 << 20


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def crc_of_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """CRC-32 of each span, each going on from the checksum of what stands before it."""
    size = ends - starts
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(-size, kind="stable")
    long = int((size > 64).sum())
    for i in order[:long]:
        out[i] = zlib.crc32(data[starts[i]:ends[i]].tobytes(), int(begun[i]))
    order = order[long:]
    state, at, left = begun[order] ^ np.uint32(0xFFFFFFFF), starts[order], size[order]
    for j in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left, -j, "left"))                   # spans with more than j bytes stand first
        s = state[:live]
        state[:live] = _CRC[(s ^ data[at[:live] + j]) & np.uint32(255)] ^ (s >> np.uint32(8))
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def word_tally(ids: list, column: pa.Array, least: int, every: int) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of at least ``least`` letters in a block, and how often each occurs.

    A word is a run of A-Z, a-z and U+00C0 to U+00FF, lower-cased in A to Z. Where ``every`` divides the
    checksum of ``<doc_id>:<word>``, the letter at the checksum modulo the length is gone.
    """
    data, offsets = raw(column)
    lead = data == 0xC3
    tail = np.zeros(len(data), bool)
    tail[1:] = lead[:-1]
    low = lower_ascii(data)
    inside = lead | tail | ((low >= 97) & (low <= 122))
    starts, ends, doc = runs(inside, offsets)
    letter = inside & ~tail
    before = np.concatenate([[0], np.cumsum(letter)])
    size = before[ends] - before[starts]
    keep = size >= least
    starts, ends, doc, size = starts[keep], ends[keep], doc[keep], size[keep]
    begun = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    crc = crc_of_runs(low, starts, ends, begun[doc]).astype(np.int64)
    hit = crc % every == 0
    at = np.flatnonzero(letter)[before[starts[hit]] + crc[hit] % size[hit]]
    gone = np.zeros(len(data) + 1, bool)
    gone[at] = True
    gone[at[lead[at]] + 1] = True
    keep = size - hit >= least
    starts, ends = starts[keep], ends[keep]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    kept = (np.cumsum(edge)[:-1] > 0) & ~gone[:-1]
    upto = np.concatenate([[0], np.cumsum(kept)])
    bounds = np.concatenate([upto[starts], upto[-1:]]).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(low[kept])).dictionary_encode()
    return coded.dictionary, np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))


def word_counts(docs: DataFrame, least: int = 7, every: int = 31) -> DataFrame:
    """Every distinct word of ``docs`` (doc_id, text) with its number of occurrences n."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words, n = word_tally(block.column("doc_id").to_pylist(), block.column("text"), least, every)
            yield pa.RecordBatch.from_arrays([words, pa.array(n, pa.int64())], ["word", "n"])

    return docs.select("doc_id", "text").mapInArrow(tally, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letters_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points (up to 255) of words of the letters above, and where each word begins."""
    data, offsets = raw(words)
    lead = data == 0xC3
    tail = np.zeros(len(data), bool)
    tail[1:] = lead[:-1]
    codes = data.copy()
    codes[tail] += 0x40
    upto = np.concatenate([[0], np.cumsum(~lead)])
    return codes[~lead], upto[offsets]


def balanced_parts(use: dict[int, int], parts: int) -> np.ndarray:
    """Part of each code point: the commonest letters first, each to the part with the least use so far."""
    load, part = [0] * parts, np.arange(256) % parts
    for code, n in sorted(use.items(), key=lambda x: (-x[1], x[0])):
        least = load.index(min(load))
        part[code] = least
        load[least] += n
    return part


class Signatures:
    """Signatures of words for given parts of the letters."""

    def __init__(self, use: dict[int, int]):
        self.same, self.next = balanced_parts(use, SAME_PARTS), balanced_parts(use, NEXT_PARTS)
        self.value = mixed(np.arange(1, 257, dtype=np.uint64))

    def _sums(self, codes, at, part, parts) -> list[np.ndarray]:
        """Hash of the multiset of each word's letters in each part: the sum of their values."""
        out = []
        for k in range(parts):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(part == k, self.value, 0).astype(np.uint64)[codes])])
            out.append(total[at[1:]] - total[at[:-1]])
        return out

    def rows(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, kind and word of each entry. Kinds: a pair left out; then, by part left out, the shorter and the longer side."""
        codes, at = letters_of(words)
        size = np.diff(at).astype(np.uint64)
        keys, kinds = [], []
        same = self._sums(codes, at, self.same, SAME_PARTS)
        for kind, out in enumerate(PAIRS_OUT):
            keys.append(joined([same[k] for k in range(SAME_PARTS) if k not in out] + [size, np.full(len(size), kind, np.uint64)]))
            kinds.append(kind)
        following = self._sums(codes, at, self.next, NEXT_PARTS)
        for k in range(NEXT_PARTS):
            rest = [following[i] for i in range(NEXT_PARTS) if i != k]
            for longer in (0, 1):
                keys.append(joined(rest + [size - np.uint64(longer), np.full(len(size), len(PAIRS_OUT) + k, np.uint64)]))
                kinds.append(len(PAIRS_OUT) + 2 * k + longer)
        return np.concatenate(keys), np.repeat(kinds, len(size)), np.tile(np.arange(len(size)), len(kinds))


def _ranges(lo: np.ndarray, hi: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) with lo[i] <= j < hi[i], about ``limit`` at a time."""
    n = np.maximum(hi - lo, 0)
    total = np.cumsum(n)
    first = 0
    while first < len(n):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + limit, "right")))
        take = n[first:last]
        left = np.repeat(np.arange(first, last), take)
        yield left, np.arange(len(left)) - np.repeat(np.cumsum(take) - take, take) + lo[left]
        first = last


def _width_blocks(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Pairs by the length of their first word, so many at a time that their letters fill no more than a block."""
    order = np.argsort(size[a], kind="stable")[::-1]
    a, b = a[order], b[order]
    first = 0
    while first < len(a):
        width = int(size[a[first]])
        last = first + max(1, _CELLS // max(width, 1))
        yield a[first:last], b[first:last], width
        first = last


def _replaced(codes, at, size, a, b, kind, part) -> np.ndarray:
    """Pairs that differ in one letter, under the first choice of left-out parts that serves them."""
    keep = []
    for x, y, width in _width_blocks(a, b, size):
        j = np.arange(width)
        inside = j < size[x][:, None]
        place = np.where(inside, j, 0)
        differ = (codes[at[x][:, None] + place] != codes[at[y][:, None] + place]) & inside
        one = differ.sum(1) == 1
        x, y, spot = x[one], y[one], differ[one].argmax(1)
        gx, gy = part[codes[at[x] + spot]], part[codes[at[y] + spot]]
        other = np.where(gx == gy, np.where(gx == 0, 1, 0), gy)
        low, high = np.minimum(gx, other), np.maximum(gx, other)
        out = np.array(PAIRS_OUT)[kind[x]]
        mine = (out[:, 0] == low) & (out[:, 1] == high)
        keep.append(np.stack([x[mine], y[mine]]))
    return np.concatenate(keep, 1) if keep else np.zeros((2, 0), np.int64)


def _inserted(codes, at, size, a, b, kind, part, suffix) -> np.ndarray:
    """Pairs of a word and a longer one that has one more letter; those that share the first half are left to its pass."""
    keep = []
    for x, y, width in _width_blocks(a, b, size):
        j = np.arange(width)
        inside = j < size[x][:, None]
        place = np.where(inside, j, 0)
        short = codes[at[x][:, None] + place]
        differ = (short != codes[at[y][:, None] + place]) & inside
        spot = np.where(differ.any(1), differ.argmax(1), size[x])
        behind = inside & (j >= spot[:, None])
        one = ~((short != codes[at[y][:, None] + place + 1]) & behind).any(1)
        one &= (kind[x] - len(PAIRS_OUT)) // 2 == part[codes[at[y] + spot]]
        if suffix:
            one &= spot < size[x] // 2
        keep.append(np.stack([x[one], y[one]]))
    return np.concatenate(keep, 1) if keep else np.zeros((2, 0), np.int64)


def near_of_groups(key: np.ndarray, kind: np.ndarray, words: pa.Array, signatures: Signatures) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose words are one letter apart, among rows with equal keys."""
    codes, at = letters_of(words)
    size = np.diff(at)
    same = kind < len(PAIRS_OUT)
    longer = ~same & ((kind - len(PAIRS_OUT)) % 2 == 1)
    base = size - longer                                                 # length of the shorter side
    half = base // 2
    sums = prefix_sums(codes)
    found = []
    for suffix, hashes in ((False, span_hashes(sums, at[:-1], at[:-1] + half)), (True, span_hashes(sums, at[1:] - (base - half), at[1:]))):
        meet = joined([key, hashes])
        order = np.lexsort((longer, meet))
        ranked = meet[order]
        end = np.searchsorted(ranked, ranked, "right")
        begin = np.searchsorted(ranked, ranked, "left")
        ahead = np.concatenate([[0], np.cumsum(~longer[order])])
        first_longer = begin + ahead[end] - ahead[begin]
        lo = np.where(same[order], np.arange(len(order)) + 1, first_longer)
        hi = np.where(longer[order], lo, end)
        for i, j in _ranges(lo, hi, 1 << 20):
            a, b = order[i], order[j]
            equal = (key[a] == key[b]) & (same[a] == same[b]) & (base[a] == base[b])
            a, b = a[equal], b[equal]
            alike = same[a]
            found.append(_replaced(codes, at, size, a[alike], b[alike], kind, signatures.same))
            found.append(_inserted(codes, at, size, a[~alike], b[~alike], kind, signatures.next, suffix))
    pairs = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
    return pairs[0].astype(np.int64), pairs[1].astype(np.int64)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """Each pair of ``vocabulary`` (word, n) one letter apart, in both directions: word, near, near_n.

    Rows of one signature meet in one task, a stretch of signatures at a time; they are words of one length
    with the same letters in three of five (two of three) parts. Of the letters' use, one row per letter
    reaches the driver.
    """
    spark = vocabulary.sparkSession
    use = (vocabulary.select(F.explode(F.split("word", "")).alias("letter")).filter("letter <> ''").groupBy("letter").count().collect())
    shared = spark.sparkContext.broadcast({ord(r["letter"]): r["count"] for r in use})

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = Signatures(shared.value)
        for block in blocks(batches, "word", 1 << 18):
            key, kind, row = signatures.rows(block.column("word"))
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(kind.astype(np.int32)), block.column("word").take(row),
                                              block.column("n").take(row)], ["key", "kind", "word", "n"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = Signatures(shared.value)
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                held.append(batch)
                key = batch.column("key").to_numpy()
                if held[0].column("key")[0].as_py() == key[-1]:
                    continue                                             # the signature goes on
            if not held:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key = whole.column("key").to_numpy()
            done = len(key) if batch is None else int(np.flatnonzero(key != key[-1])[-1]) + 1
            held = [whole.slice(done)] if done < len(key) else []
            words, n = whole.column("word").slice(0, done), whole.column("n").slice(0, done)
            a, b = near_of_groups(key[:done].view(np.uint64), whole.column("kind").to_numpy()[:done], words, signatures)
            for left, right in ((pa.array(a), pa.array(b)), (pa.array(b), pa.array(a))):
                yield pa.RecordBatch.from_arrays([words.take(left), words.take(right), n.take(right)], ["word", "near", "near_n"])

    return (vocabulary.mapInArrow(sign, SIGNED).repartition("key").sortWithinPartitions("key")
            .mapInArrow(meet, "word string, near string, near_n long"))


def roots_of(links: DataFrame) -> DataFrame:
    """word and root for ``links`` (word, form): forms followed to the last, twice as far each round.

    A form has ten times its word's occurrences, so a chain has few steps and no circle.
    """
    spark = links.sparkSession
    reached = links.select("word", F.col("form").alias("root"))
    while True:
        path = new_path(spark, "roots")
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        reached.join(onward, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")).write.parquet(path)
        reached = spark.read.parquet(path)
        if reached.filter("moved").isEmpty():
            return reached.select("word", "root")


def spelling_variants(docs: DataFrame, least: int = 7, twice: int = 2, times: int = 10, every: int = 31) -> DataFrame:
    """Every word of ``docs`` (doc_id, text) with at least ``least`` letters and ``twice`` occurrences.

    Returns word, form, root, n, n_near, form_n. Words are near if one inserted, deleted or replaced letter
    turns one into the other. A word's form is its commonest near word, the first in code-point order of
    equals, if that has ``times`` its occurrences; the root is where forms lead.

    A null or empty text has no words; texts and words of any length are whole. Rows that repeat count each
    time; a null doc_id is written as nothing before the colon of the checksum. Other columns are not looked
    at. An empty table gives no rows.
    """
    spark = docs.sparkSession
    words_path, found_path = new_path(spark, "words"), new_path(spark, "forms")
    word_counts(docs, least, every).filter(F.col("n") >= twice).write.parquet(words_path)
    vocabulary = spark.read.parquet(words_path)
    best = near_words(vocabulary).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    form = (-F.col("best.less") >= F.col("n") * times)
    (vocabulary.join(best, "word", "left")
     .select("word", F.when(form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
             F.when(form, -F.col("best.less")).alias("form_n")).write.parquet(found_path))
    found = spark.read.parquet(found_path)
    roots = roots_of(found.filter("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
