"""Repeated passages by suffix order and longest previous factors.

A passage of ``length`` bytes that stands twice has, at both places, the same anchor: the least
hash among its windows of ``WINDOW`` bytes. Anchors therefore split the suffixes into groups that
can be ordered apart:

1. Every text gives its anchors, each with the range of starts whose passage it anchors. One
   aggregate finds anchors met at two places, and whether all their surroundings are equal; then
   every start in range repeats and no text moves.
2. Other repeated anchors send their surroundings to the anchor's task. There the suffixes that
   begin in the ranges are put in order up to ``length`` bytes (by fingerprint, which keeps equal
   ones together; the bytes are compared to be sure), those equal so far by their place. The
   nearest smaller places before and after each suffix in this order give its longest previous
   factor and its longest later one.
3. Each text drops the bytes that such factors cover.

Equal texts are handled as one: each of their passages repeats. Anchors with more than
``hot_rows`` surroundings do not meet in one task; their passages are compared by an aggregate
over 128-bit fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.llm.texts import _power, blocks, mixed, owner, prefix_sums, raw, span_hashes
from tabkit.sources.workspace import checkpointed, ship_package

WINDOW = 48
BLOCK = 2 << 20
CHUNK = 1 << 20
SAME, MIXED, HOT = 0, 1, 2


def anchors(data: np.ndarray, offsets: np.ndarray, sums: np.ndarray, length: int):
    """Document, place, first and last start, and hash of each anchor; places count from the block's begin."""
    n = len(data) - WINDOW + 1
    width = length - WINDOW + 1
    nothing = np.zeros(0, np.int64)
    if n < width:
        return nothing, nothing, nothing, nothing, np.zeros(0, np.uint64)
    hashes = mixed((sums[WINDOW:] - sums[:-WINDOW]) * _power(len(sums))[1][:n])
    low = np.uint64((1 << max(23, n.bit_length())) - 1)
    least = (hashes & ~low) | np.arange(n, dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:span - width], least[width - span:])
    place = (least & low).astype(np.int64)
    start = np.arange(len(place))
    doc = owner(start, offsets)
    inside = start + length <= offsets[doc + 1]
    start, place, doc = start[inside], place[inside], doc[inside]
    if not len(start):
        return nothing, nothing, nothing, nothing, np.zeros(0, np.uint64)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
    last = start[np.append(new[1:] - 1, len(start) - 1)]
    return doc[new], place[new], start[new], last, hashes[place[new]]


def factors(data: np.ndarray, begins: np.ndarray, starts: np.ndarray, place: np.ndarray, length: int):
    """For suffixes of a task's text: whether an earlier one, and whether a later one shares ``length`` bytes.

    ``starts`` are the suffixes' offsets in ``data``, ``place`` their order in the corpus. In suffix
    order, equal ones by place, the suffix before is the nearest smaller place and the suffix after
    the nearest larger one as long as ``length`` bytes agree; where they don't agree, no suffix
    further off agrees either.
    """
    sums = prefix_sums(data)
    key = span_hashes(sums, starts, starts + length)
    order = np.lexsort((place, key))
    at = starts[order]
    same = key[order][1:] == key[order][:-1]
    pair = np.flatnonzero(same)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    agree = np.ones(len(pair), bool)
    for k in [*range(0, length - 8, 8), length - 8]:        # the common prefix, eight bytes at a time
        agree &= (words[at[pair] + k] == words[at[pair + 1] + k]).all(1)
    same[pair] = agree
    earlier, later = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    earlier[order[1:]] = same
    later[order[:-1]] = same
    return earlier, later


def repeated_spans(docs: DataFrame, length: int, hot_rows: int, keep_first: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct texts (k1, k2, copies, text), their marks, and ranges of repeated starts in mixed anchors."""
    spark = docs.sparkSession
    ship_package(spark)
    keyed = docs.select(F.coalesce("text", F.lit("")).alias("text")).select(
        F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2"), "text")
    long = keyed.filter(F.octet_length("text") >= length)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, limit=BLOCK):
            data, offsets = raw(batch.column("text"))
            sums = prefix_sums(data)
            doc, place, first, last, value = anchors(data, offsets, sums, length)
            around = span_hashes(sums, first, last + length) ^ mixed((place - first).astype(np.uint64))
            first = first - offsets[doc]
            pack = first << 16 | (place - offsets[doc] - first) << 8 | (last - offsets[doc] - first)
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(value.view(np.int64)), pa.array(around.view(np.int64)), batch.column("k1").take(rows),
                 batch.column("k2").take(rows), pa.array(pack)], ["anchor", "around", "k1", "k2", "pack"])

    marks = long.mapInArrow(found, "anchor long, around long, k1 long, k2 long, pack long")
    place = F.xxhash64("k1", "k2", "pack")
    kinds = (marks.select("anchor", "around", place.alias("place")).groupBy("anchor")
             .agg(F.min("place").alias("p"), F.max("place").alias("q"), F.min("around").alias("a"), F.max("around").alias("b"),
                  F.count("*").alias("n"))
             .filter("p <> q")
             .select("anchor", F.when(F.col("a") == F.col("b"), SAME).when(F.col("n") <= hot_rows, MIXED).otherwise(HOT).alias("kind")))
    own = marks.select("anchor", "k1", "k2", "pack").join(kinds, "anchor").groupBy("k1", "k2").agg(
        F.collect_set(F.struct("anchor", "kind", "pack")).alias("marks"))
    own = checkpointed(own)
    texts = keyed.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, limit=BLOCK):
            data, offsets = raw(batch.column("text"))
            listed = batch.column("marks")
            doc = np.repeat(np.arange(batch.num_rows), listed.value_lengths().to_numpy())
            flat = listed.flatten()
            kind, pack, anchor = (flat.field(c).to_numpy() for c in ("kind", "pack", "anchor"))
            some = np.flatnonzero(kind == MIXED)
            first, count = pack[some] >> 16, (pack[some] & 255) + 1
            begin = first + offsets[doc[some]]
            for k in range(0, len(some), 4096):
                part = slice(k, k + 4096)
                size = count[part] + length - 1
                ends = np.cumsum(size)
                take = np.arange(ends[-1]) + np.repeat(begin[part] - ends + size, size)
                body = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data[take])])
                rows = pa.array(doc[some][part])
                yield pa.RecordBatch.from_arrays([pa.array(anchor[some][part]), batch.column("k1").take(rows), batch.column("k2").take(rows),
                                                  pa.array(first[part]), body], ["anchor", "k1", "k2", "first", "body"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(rows: pa.Table) -> pa.RecordBatch:
            body = rows.column("body").combine_chunks().cast(pa.large_binary())
            bounds = np.frombuffer(body.buffers()[1], np.int64, len(body) + 1, 8 * body.offset)
            data = np.frombuffer(body.buffers()[2], np.uint8)[bounds[0]:bounds[-1]]
            bounds = bounds - bounds[0]
            k1, k2, first = (rows.column(c).to_numpy() for c in ("k1", "k2", "first"))
            n = np.diff(bounds) - length + 1
            row = np.repeat(np.arange(len(n)), n)
            within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            text = np.lexsort((first, k2, k1))              # places in the corpus: by text, then by start
            rank = np.empty(len(n), np.int64)
            rank[text] = np.arange(len(n))
            earlier, later = factors(data, bounds, bounds[row] + within, rank[row] << 9 | within, length)
            hit = earlier if keep_first else earlier | later
            at = np.flatnonzero(hit)
            broken = np.flatnonzero((row[at][1:] != row[at][:-1]) | (within[at][1:] != within[at][:-1] + 1)) + 1
            heads = at[np.concatenate([[0], broken])] if len(at) else at
            tails = at[np.concatenate([broken - 1, [len(at) - 1]])] if len(at) else at
            who = row[heads]
            return pa.RecordBatch.from_arrays([pa.array(k1[who]), pa.array(k2[who]), pa.array(first[who] + within[heads]),
                                               pa.array(first[who] + within[tails])], ["k1", "k2", "low", "high"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:                               # sorted by anchor: cut between anchors only
            if not batch.num_rows:
                continue
            anchor = batch.column("anchor").to_numpy()
            ends = np.append(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(anchor))
            if held and held[-1].column("anchor")[-1].as_py() != anchor[0] and size > CHUNK:
                yield solved(pa.Table.from_batches(held))
                held, size = [], 0
            lengths = np.cumsum(pa.compute.binary_length(batch.column("body")).to_numpy())
            first = 0
            for end in ends[:-1]:
                if size + lengths[end - 1] - (lengths[first - 1] if first else 0) > CHUNK:
                    held.append(batch.slice(first, end - first))
                    yield solved(pa.Table.from_batches(held))
                    held, size, first = [], 0, int(end)
            held.append(batch.slice(first))
            size += int(lengths[-1] - (lengths[first - 1] if first else 0))
        if held:
            yield solved(pa.Table.from_batches(held))

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, limit=BLOCK):
            data, offsets = raw(batch.column("text"))
            sums, other = prefix_sums(data), prefix_sums(data[::-1])
            listed = batch.column("marks")
            doc = np.repeat(np.arange(batch.num_rows), listed.value_lengths().to_numpy())
            flat = listed.flatten()
            some = np.flatnonzero(flat.field("kind").to_numpy() == HOT)
            pack = flat.field("pack").to_numpy()[some]
            n = (pack & 255) + 1
            row = np.repeat(doc[some], n)
            start = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(pack >> 16, n)
            at = start + offsets[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(span_hashes(sums, at, at + length).view(np.int64)),
                 pa.array(span_hashes(other, len(data) - at - length, len(data) - at).view(np.int64)),
                 batch.column("k1").take(pa.array(row)), batch.column("k2").take(pa.array(row)), pa.array(start)],
                ["g1", "g2", "k1", "k2", "low"])

    needed = F.exists("marks", lambda m: m["kind"] == MIXED)
    hot = F.exists("marks", lambda m: m["kind"] == HOT)
    both = texts.join(own, ["k1", "k2"])
    hits = (both.filter(needed).mapInArrow(surroundings, "anchor long, k1 long, k2 long, first long, body binary")
            .repartition("anchor").sortWithinPartitions("anchor")
            .mapInArrow(compare, "k1 long, k2 long, low long, high long"))
    if own.filter(hot).limit(1).count():
        single = both.filter(hot).mapInArrow(passages, "g1 long, g2 long, k1 long, k2 long, low long")
        place = F.struct("k1", "k2", "low")
        twice = single.groupBy("g1", "g2").agg(F.min(F.xxhash64("k1", "k2", "low")).alias("p"), F.max(F.xxhash64("k1", "k2", "low")).alias("q"),
                                               *([F.min(place).alias("least")] if keep_first else [])).filter("p <> q")
        found_hot = single.join(twice, ["g1", "g2"])
        found_hot = found_hot.filter(place != F.col("least")) if keep_first else found_hot
        hits = hits.unionByName(found_hot.select("k1", "k2", "low", F.col("low").alias("high")))
    return texts, own, hits


def without_repeats(docs: DataFrame, length: int = 200, *, hot_rows: int = 50_000, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs``; ``kept`` bytes on request.

    Each byte covered by a ``length``-byte string (56 to 200) that also starts anywhere else is
    removed, judged on the input. Matches never cross documents. A null text is an empty one;
    texts shorter than ``length`` lose nothing; a text that stands in several rows loses everything
    from ``length`` bytes on. Other columns are not read; an empty table gives an empty result.
    """
    if not WINDOW + 8 <= length <= WINDOW + 255:
        raise ValueError("length must lie between 56 and 303 bytes")
    texts, own, hits = repeated_spans(docs, length, hot_rows, keep_first=False)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("text", "copies", "marks", "hits")]
            out = []
            for text, copies, marks, ranges in zip(*columns):
                body = text.encode()
                if copies > 1 and len(body) >= length:
                    spans = [(0, len(body))]
                else:
                    spans = merged([(m["pack"] >> 16, (m["pack"] >> 16) + (m["pack"] & 255) + length) for m in marks or () if m["kind"] == SAME]
                                   + [(h["low"], h["high"] + length) for h in ranges or ()])
                kept = b"".join(body[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(body)]))
                out.append((len(body), len(body) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), *(pa.array(x, t) for x, t in zip(
                    zip(*out) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))],
                ["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    ranges = hits.groupBy("k1", "k2").agg(F.collect_list(F.struct("low", "high")).alias("hits"))
    per_text = (texts.join(own, ["k1", "k2"], "left").join(ranges, ["k1", "k2"], "left")
                .mapInArrow(digest, "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2"))
    out = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + (["kept"] if with_text else [])
    return rows.join(per_text, ["k1", "k2"]).select(*out)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]
