"""Exact Jaccard self join of word shingle sets, by partitions of the universe.

Two sets with ``100 * intersection >= 80 * union`` differ in at most a ninth of their summed sizes.
Their shingles are hashed into segments, as many as fit the largest set of their size band, so
two linked sets agree on at least one segment that isn't empty if one of them has more filled
segments than the pair may have differences. Each segment may be given an effort:

- 0: empty, or shared by so many texts (``hot`` and more) that it tells nothing;
- 1: the segment as it is;
- 2: also with any one shingle left out, so that it still meets after one difference.

A set is sure to meet its partners if its efforts exceed the differences. All sets index every
filled segment at effort 1. Only sets which that doesn't make sure spend effort 2, and the few
which even that doesn't make sure index each shingle; as every such set does so, two of them
meet. Hot segments are dropped for sets that are sure without them, the cheapest allocation.
Sets that are not sure without them are compared among themselves by prefixes of their shingles,
rarest first: of two linked sets with no other segment in common, neither is sure without hot ones.
Sets near the lower end of a band also take part in the band below.

Texts with equal sets are one class. Candidates are verified on the texts. Copies need not be
listed in pairs: each class first tries its best partner, links are merged to components, and
only candidates between different components are tried further, so that no link between
components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.llm.components import all_links, renamed
from tabkit.llm.prefixes import prefix_candidates, turns_of
from tabkit.llm.texts import blocks, lower_ascii, mixed, prefix_sums, raw, shingles, span_hashes, words
from tabkit.sources.workspace import Scratch, checkpointed, ship_package

FLUSH = 2_000_000
SMALL, SURE, LEFT_OUT, EACH = 0, 1, 2, 3                    # own band, band below, one-deletion, single shingles
ROW = ("kind int, part int, doc_id long, k1 long, k2 long, c long, check long, n int, spare0 int, spare1 int, odd array<bigint>, "
       "sigs binary, names binary, marks binary")
FOUND = "kind int, doc_id long, k1 long, k2 long, c long, check long, n int, spare0 int, spare1 int, odd array<bigint>, d long, m int, way int"
TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
DOCUMENT, POSTINGS, PAIR, MEMBER = 0, 1, 2, 3
WORDS = 16                                                  # 64-bit words of a small set's parities
STEP = np.log(1.002)                                        # sizes travel in steps of a fifth of a percent


def rows_of(schema: str, size: int, **columns) -> pa.RecordBatch:
    """A batch of the schema; columns that aren't given are null."""
    out, names = [], []
    for field in schema.split(", "):
        name, kind = field.split(" ")
        given = columns.get(name)
        if isinstance(given, int):
            given = np.full(size, given)
        out.append(pa.nulls(size, TYPES[kind]) if given is None else given if isinstance(given, pa.Array) else pa.array(given, TYPES[kind]))
        names.append(name)
    return pa.RecordBatch.from_arrays(out, names)


def shingle_sets(batch: pa.RecordBatch, size: int = 5):
    """Distinct shingles of each text: document and hash, sorted by document."""
    data, offsets = raw(batch.column("text"))
    data = lower_ascii(data)
    starts, ends, doc = words(data, offsets)
    value, owner = shingles(span_hashes(prefix_sums(data), starts, ends), doc, batch.num_rows, size)
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    order = np.argsort(owner, kind="stable")                # small integers: counted, not compared
    owner, value = owner[order], value[order]
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[keep], value[keep]


def band_of(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)


def segments_of(band: np.ndarray) -> np.ndarray:
    """Segments of a band: a little over a quarter of its largest size."""
    return np.ceil(0.53 * 2.0 ** band).astype(np.int64) + 2


def postings(owner: np.ndarray, value: np.ndarray, n: np.ndarray):
    """Signatures: (document, way, signature), and per (document, way) the efforts spared."""
    out = []
    spare = np.full((len(n), 4), -1, np.int64)
    unsure = np.zeros(len(n), bool)
    for way, low in ((SMALL, 0), (SURE, 1)):
        band = band_of(n) - low
        takes = (n > 0) & (band >= 0) & ((n * 4 <= 5 * 2 ** np.maximum(band + 1, 0)) | (low == 0))
        other = np.minimum(np.floor(1.25 * n), 2.0 ** (band + 1) - 1 if low else np.inf)
        differ = (n + other).astype(np.int64) // 9
        use = np.flatnonzero(takes[owner])
        doc = owner[use]
        segment = (mixed(value[use]) % segments_of(band)[doc].astype(np.uint64)).astype(np.int64)
        slot = doc << 32 | segment
        order = np.argsort(slot, kind="stable")
        slot, item = slot[order], mixed(value[use][order] ^ np.uint64(0x5DEECE66D))
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])[:len(slot)])
        total = np.add.reduceat(item, first) if len(first) else np.zeros(0, np.uint64)
        doc, segment = slot[first] >> 32, slot[first] & 0xFFFFFFFF
        place = mixed(mixed(segment.astype(np.uint64)) + band[doc].astype(np.uint64) * np.uint64(2) + np.uint64(1))
        out.append((doc, np.full(len(doc), way), mixed(total + place)))
        filled = np.bincount(doc, minlength=len(n))
        spare[:, way] = np.where(takes, filled - differ - 1, -1)
        unsure_here = takes & (filled < differ + 1)
        if unsure_here.any():                               # effort 2 on every filled segment of two or more
            size = np.diff(np.append(first, len(slot)))
            far = unsure_here[doc]
            effort = np.bincount(doc, weights=np.where(size > 1, 2, 1), minlength=len(n))
            base = mixed(place + np.uint64(2))
            out.append((doc[far], np.full(far.sum(), LEFT_OUT), mixed(total[far] + base[far])))
            row = np.repeat(np.arange(len(first)), size)
            less = far[row] & (size[row] > 1)
            out.append((doc[row[less]], np.full(less.sum(), LEFT_OUT), mixed(total[row[less]] - item[less] + base[row[less]])))
            unsure |= unsure_here & (effort < differ + 1)
    each = np.flatnonzero(unsure[owner])
    out.append((owner[each], np.full(len(each), EACH), mixed(value[each] + np.uint64(0xEAC4))))
    doc, way, sig = (np.concatenate(x) for x in zip(*out))
    return doc, way, sig, spare


def packed(sig: np.ndarray) -> np.ndarray:
    """The low five bytes of each signature."""
    return np.ascontiguousarray(sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def parities(owner: np.ndarray, value: np.ndarray, documents: int) -> pa.Array:
    """Of each set, per cell whether an odd number of shingles falls there: four cells or more a shingle, at least 1,024.

    Two sets differ in at least as many shingles as their parities differ in cells. The number of cells is
    a power of two, so that the halves of twice as many fold into one.
    """
    n = np.bincount(owner, minlength=documents)
    size = WORDS * 2 ** np.ceil(np.log2(np.maximum(n / (16 * WORDS), 1))).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    cell = mixed(value + np.uint64(0x0DD)) & (64 * size[owner] - 1).astype(np.uint64)
    odd = np.zeros(at[-1], np.uint64)
    np.bitwise_xor.at(odd, at[owner] + (cell >> np.uint64(6)).astype(np.int64), np.uint64(1) << (cell & np.uint64(63)))
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(odd.view(np.int64)))


def candidates(docs: DataFrame, parts: int, hot: int, name_bits: int) -> DataFrame:
    """Rows of FOUND: documents with their class, candidate pairs of classes, and the number m of hot groups of a class.

    Postings travel in blocks: each part of the signatures gets, from about every two million
    postings of a task, one row of signatures, class names, and sizes with ways.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush():
            sig, name, mark = (np.concatenate(x) for x in zip(*held))
            part = ((sig >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            sig, name, mark, part = sig[order], name[order], mark[order], part[order]
            at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            cells = list(zip(at, np.append(at[1:], len(part))))
            return rows_of(ROW, len(at), kind=POSTINGS, part=part[at], sigs=[packed(sig[a:b]).tobytes() for a, b in cells],
                           names=[name[a:b].tobytes() for a, b in cells], marks=[mark[a:b].tobytes() for a, b in cells])

        for batch in blocks(batches):
            owner, value = shingle_sets(batch)
            n = np.bincount(owner, minlength=batch.num_rows)
            salted = mixed(value)
            c, check = (np.zeros(batch.num_rows, np.uint64) for _ in range(2))
            np.add.at(c, owner, salted)
            np.add.at(check, owner, mixed(salted + np.uint64(1)))
            c = mixed(c + n.astype(np.uint64))
            c = (c if name_bits == 64 else c >> np.uint64(64 - name_bits)).view(np.int64)
            doc, way, sig, spare = postings(owner, value, n)
            yield rows_of(ROW, batch.num_rows, kind=DOCUMENT, part=np.arange(batch.num_rows) % parts, doc_id=batch.column("doc_id"), k1=batch.column("k1"),
                          k2=batch.column("k2"), c=c, check=check.view(np.int64), n=n, spare0=spare[:, SMALL], spare1=spare[:, SURE],
                          odd=parities(owner, value, batch.num_rows))
            mark = np.minimum(np.log(np.maximum(n[doc], 1)) / STEP, 16383).astype(np.uint16) << np.uint16(2) | way.astype(np.uint16)
            held.append((sig, c[doc], mark))
            count += len(sig)
            if count > FLUSH:
                yield flush()
                held, count = [], 0
        if count:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(part, group):
            five = np.frombuffer(b"".join(g[0] for g in group), np.uint8).reshape(-1, 5)
            wide = np.zeros((len(five), 8), np.uint8)
            wide[:, :5] = five
            sig = wide.reshape(-1).view("<u8")
            c, mark = np.frombuffer(b"".join(g[1] for g in group), "<i8"), np.frombuffer(b"".join(g[2] for g in group), "<u2")
            order = np.argsort(sig, kind="stable")
            sig, c, mark = sig[order], c[order], mark[order]
            shared = np.zeros(len(sig), bool)
            shared[1:] = sig[1:] == sig[:-1]
            shared[:-1] |= shared[1:]
            sig, c, mark = sig[shared], c[shared], mark[shared]
            order = np.lexsort((c, sig))
            sig, c, mark = sig[order], c[order], mark[order]
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (c[1:] != c[:-1])
            sig, c, mark = sig[new], c[new], mark[new]
            first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])[:len(sig)])
            size = np.diff(np.append(first, len(sig)))
            row = np.repeat(np.arange(len(first)), size)
            steps = (mark >> np.uint16(2)).astype(np.int64)
            left, right = [], []
            few = size[row] < hot
            for step in range(1, hot - 1):
                at = np.flatnonzero(few[:-step] & (row[:-step] == row[step:])) if step < len(row) else np.zeros(0, np.int64)
                if not len(at):
                    break
                left.append(at)
                right.append(at + step)
            many = np.flatnonzero(~few)
            if len(many):                                   # a star from the middle of each third of a hot group's sizes
                by_size = many[np.lexsort((c[many], steps[many], row[many]))]
                rank = np.arange(len(by_size)) - np.searchsorted(row[by_size], row[by_size])
                key = row[by_size] * 3 + np.minimum(3 * rank // size[row[by_size]], 2)
                head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                which = np.searchsorted(key[head], key)
                left.append(by_size[head[which] + np.diff(np.append(head, len(key)))[which] // 2])
                right.append(by_size)
            if left:
                left, right = np.concatenate(left), np.concatenate(right)
                near = (c[left] != c[right]) & (np.abs(steps[left] - steps[right]) <= np.log(1.25) / STEP + 2)
                a, b = np.minimum(c[left], c[right])[near], np.maximum(c[left], c[right])[near]
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[:len(a)])
                yield rows_of(FOUND, len(head), kind=PAIR, c=a[head], d=b[head], m=np.diff(np.append(head, len(a))))
            if len(many):
                way = (mark[many] & np.uint16(3)).astype(np.int32)
                order = np.lexsort((way, c[many]))
                at, way = c[many][order], way[order]
                head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (way[1:] != way[:-1])]))
                yield rows_of(FOUND, len(head), kind=MEMBER, c=at[head], way=way[head], m=np.diff(np.append(head, len(at))))

        part, group = None, []
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            own = batch.filter(pa.array(kind == DOCUMENT))
            if own.num_rows:
                yield rows_of(FOUND, own.num_rows, kind=DOCUMENT, **{x: own.column(x) for x in ("doc_id", "k1", "k2", "c", "check", "n", "spare0", "spare1", "odd")})
            rest = batch.filter(pa.array(kind == POSTINGS)).select(["part", "sigs", "names", "marks"]).to_pydict()
            for p, *blobs in zip(*(rest[x] for x in ("part", "sigs", "names", "marks"))):
                if p != part and group:
                    yield from solved(part, group)
                    group = []
                part = p
                group.append(blobs)
        if group:
            yield from solved(part, group)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2"), "text")
    return keyed.mapInArrow(emit, ROW).repartition("part").sortWithinPartitions("part").mapInArrow(meet, FOUND)


def element_rows(texts: DataFrame) -> DataFrame:
    """name, n and s: each shingle of the texts (c, text) with the size of its set."""
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            owner, value = shingle_sets(batch)
            n = np.bincount(owner, minlength=batch.num_rows)
            yield rows_of("name long, n int, s long", len(owner), name=batch.column("c").to_numpy()[owner], n=n[owner].astype(np.int32), s=value.view(np.int64))

    return texts.select("c", "text").mapInArrow(explode, "name long, n int, s long")


def promising(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows of ``pairs`` (a, b, ...) whose sizes and parities allow a link.

    Linked sets differ in at most a ninth of their summed sizes; pairs whose parities alone differ in more
    never fetch their texts. ``marks`` has c, n (the size of the set) and odd (its parities).
    """
    left, right = (marks.select(F.col("c").alias(c), F.col("n").alias(f"{c}n"), F.col("odd").alias(x)) for c, x in (("a", "x"), ("b", "y")))
    words = F.least(F.size("x"), F.size("y"))               # sizes that allow a link differ by one step at most

    def folded(odd: str):
        halves = F.zip_with(F.slice(odd, F.lit(1), words), F.slice(odd, words + 1, words), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(odd) > words, halves).otherwise(F.col(odd))

    apart = F.aggregate(F.zip_with(folded("x"), folded("y"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, k: total + k)
    return (pairs.join(left, "a").join(right, "b").filter("100 * least(an, bn) >= 80 * greatest(an, bn)")
            .filter(9 * apart <= F.col("an") + F.col("bn")).select(*pairs.columns))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose texts' sets reach the threshold."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(blocks(batches, "x"), "y"):
            sets = []
            for side in ("x", "y"):
                owner, value = shingle_sets(pa.RecordBatch.from_arrays([batch.column(side)], ["text"]))
                sets.append((owner, value, np.bincount(owner, minlength=batch.num_rows)))
            owner, value = (np.concatenate([sets[0][i], sets[1][i]]) for i in (0, 1))
            order = np.lexsort((value, owner))
            owner, value = owner[order], value[order]
            same = (owner[1:] == owner[:-1]) & (value[1:] == value[:-1])
            common = np.bincount(owner[1:][same], minlength=batch.num_rows)
            linked = 100 * common >= 80 * (sets[0][2] + sets[1][2] - common)
            yield batch.select(["a", "b"]).filter(pa.array(linked))

    left, right = (texts.select(F.col("c").alias(c), F.col("text").alias(t)) for c, t in (("a", "x"), ("b", "y")))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def jaccard_components(docs: DataFrame, *, hot: int = 17, dense: int = 20, name_bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, class_id and component_id of every row.

    Two more columns tell rows apart whose ids clash: text_key, the xxhash64 of the text, and component, a
    number of the component that does not come from ids.

    Words are maximal runs of characters other than \\x20 and \\x09 to \\x0D, with A-Z in lower case; a
    set holds the distinct runs of five words, or the whole sequence of fewer. Sets link when
    100 * intersection >= 80 * union. A null or empty text, or one without words, has an empty set and
    links with nothing, not even with its like. component_id is the least doc_id among rows reached by links;
    rows with null doc_id take part and get the least id of their component, null if there is none.
    Repeated rows each get their row; other columns are not read; an empty table gives none.
    ``hot`` and ``dense`` choose the way to the same rows; ``name_bits`` is for tests of shared names.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "jaccard")
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = scratch.keep(candidates(docs, parts, hot, name_bits), heavy=True)
    rows = found.filter(F.col("kind") == DOCUMENT).select("doc_id", "k1", "k2", "c", "check", "n", "spare0", "spare1", "odd")
    pairs = found.filter(F.col("kind") == PAIR).groupBy(F.col("c").alias("a"), F.col("d").alias("b")).agg(F.sum("m").alias("votes"))
    members = found.filter(F.col("kind") == MEMBER).groupBy("c", "way").agg(F.sum("m").alias("times"))
    rename, pairs, members = renamed(rows.filter("n > 0").drop("odd"), "c", "check", pairs, members, scratch)
    marked = rename(rows)
    rows, met, members = scratch.keep(marked.drop("odd")), scratch.keep(pairs), scratch.keep(members)
    classes = rows.filter("n > 0").groupBy("c").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "k1", "k2")).alias("one"),
                                                    F.max("spare0").alias("spare0"), F.max("spare1").alias("spare1"))
    spare = F.when(F.col("way") == SMALL, F.col("spare0")).when(F.col("way") == SURE, F.col("spare1")).otherwise(-1)
    unsure = scratch.keep(members.join(classes.select("c", "spare0", "spare1"), "c").filter(F.col("times") > spare).select("c").distinct())
    both = lambda df: df.select(F.explode(F.array("a", "b")).alias("c"))
    asked = both(met).unionByName(unsure).distinct()
    marks = scratch.keep(marked.filter("n > 0").join(asked, "c").groupBy("c").agg(F.first("n").alias("n"), F.first("odd").alias("odd")), heavy=True)
    scratch.free(found, members)
    listed = scratch.keep(promising(met, marks), heavy=True)
    scratch.free(met)
    asked = both(listed).select("c", F.lit(False).alias("unsure")).unionByName(unsure.select("c", F.lit(True).alias("unsure")))
    one = classes.join(asked.groupBy("c").agg(F.max("unsure").alias("unsure")), "c").select("c", "unsure", "one.*")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL").select(
        "doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2"), "text")
    same = [source[x].eqNullSafe(one[x]) for x in ("doc_id", "k1", "k2")]
    texts = scratch.keep(source.join(one, same).select("c", "unsure", "text"), heavy=True)
    elements, turns = element_rows(texts.filter("unsure")), turns_of(texts)
    elements = elements if turns == 1 else scratch.keep(elements)
    near, groups = prefix_candidates(elements, 80, scratch, turns)
    scratch.free(elements)
    pairs = scratch.keep(listed.unionByName(promising(near, marks)).groupBy("a", "b").agg(F.sum("votes").alias("votes")))
    scratch.free(listed, near, unsure)
    labels = all_links(pairs, groups, lambda some: verified(promising(some, marks), texts), scratch, dense=dense)
    scratch.free(marks, pairs, groups, texts)
    classed = (classes.select("c", "least").join(labels.select(F.col("node").alias("c"), "component"), "c", "left")
               .withColumn("component", F.coalesce("component", "c")))
    ids = classed.groupBy("component").agg(F.min("least").alias("component_id"))
    classed = classed.join(ids, "component").select("c", "component", "component_id")
    out = rows.select("doc_id", F.col("k1").alias("text_key"), "n", "c").join(classed, "c", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("c")).alias("class_id"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                      "text_key", F.when(F.col("n") > 0, F.col("component")).alias("component"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component of ``docs``: the least in doc_id, then text_key; equal rows of it are one.

    Rows are told apart by doc_id and text, so rows that only share an id all stay; null ids come first. Null
    and wordless texts stay. All columns are passed on; an empty table gives an empty one.
    """
    found = checkpointed(jaccard_components(docs).select("doc_id", F.col("text_key").alias("_key"), "n_shingles", "component"))
    least = found.filter("n_shingles > 0").groupBy("component").agg(F.min(F.struct("doc_id", "_key")).alias("kept"))
    rows = docs.withColumns({"_near_id": F.col("doc_id").cast("long"), "_near_key": F.xxhash64("text")})

    def among(some: DataFrame, how: str) -> DataFrame:
        side = some.select(F.col("doc_id").alias("_i"), F.col("_key").alias("_k")).distinct()
        return rows.join(side, rows["_near_id"].eqNullSafe(side["_i"]) & (rows["_near_key"] == side["_k"]), how)

    wordy = found.filter("n_shingles > 0")
    kept = least.select("kept.*")
    gone = wordy.join(kept, wordy["doc_id"].eqNullSafe(kept["doc_id"]) & (wordy["_key"] == kept["_key"]), "left_anti")
    twice = kept.join(wordy.groupBy("doc_id", "_key").agg(F.count("*").alias("n")).filter("n > 1").withColumnsRenamed({"doc_id": "_d", "_key": "_y"}),
                      kept["doc_id"].eqNullSafe(F.col("_d")) & (kept["_key"] == F.col("_y"))).select("doc_id", "_key")
    single = among(checkpointed(gone.select("doc_id", "_key").unionByName(twice)), "left_anti")
    return single.unionByName(among(twice, "left_semi").dropDuplicates(["_near_id", "_near_key"])).select(*docs.columns)
