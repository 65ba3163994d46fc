"""How far the sources of a language differ in their use of terms, over run-length columns.

A language's vocabulary is a table of columns, one for each of its sources: how often the source uses
each kept term. Terms are reordered by the list of (source, count) that they have, so that equal counts
of a source stand together, and the ordered vocabulary is dealt out in ranges. Within a range each
column is run-length encoded; for two sources the boundaries of their runs are merged, and the
difference of their smoothed frequencies is multiplied by the length of each stretch between two
boundaries. Sums over the ranges give the divergence of each pair.

All numbers are whole: a frequency is a floor of parts per ``SCALE``, divided digit by digit, so that
counts up to 9e15 are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabkit.llm.texts import blocks, distinct_pairs, lower_ascii, owner, raw, runs
from tabkit.sources.workspace import new_path

SCALE_DIGITS, SMOOTH = (1000, 1000, 1000), 5
ROWS = "lang string, source string, part string, item string, value long"
_SALTS = 16


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Terms (runs of letters A to Z in either case and of non-ASCII characters), lower-cased in A to Z, and their documents."""
    inside = (data >= 128) | ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122))
    starts, ends, doc = runs(inside, offsets)
    body = lower_ascii(data[inside])
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(body)).dictionary_encode(), doc


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by language and source; a group's own row has no term."""
    for block in blocks(batches):
        lang, source = (block.column(c).fill_null("").dictionary_encode() for c in ("lang", "source"))
        group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        coded, doc = terms_of(*raw(block.column("text")))
        code, size = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
        found, n = np.unique(group[doc] * size + code, return_counts=True)
        held_doc, held_code = distinct_pairs(doc, code)
        docs = np.unique(group[held_doc] * size + held_code, return_counts=True)[1]
        groups = np.unique(group)
        owners = np.concatenate([found // size, groups])
        terms = pa.concat_arrays([coded.dictionary.take(pa.array(found % size)), pa.nulls(len(groups), pa.string())])
        none = np.zeros(len(groups), np.int64)
        yield pa.RecordBatch.from_arrays(
            [lang.dictionary.take(pa.array(owners // len(source.dictionary))), source.dictionary.take(pa.array(owners % len(source.dictionary))),
             terms, pa.array(np.concatenate([n, none])), pa.array(np.concatenate([docs, none]))], ["lang", "source", "term", "n", "docs"])


def frequency(count: np.ndarray, total, terms: int) -> np.ndarray:
    """1 + floor(scale * (count + SMOOTH) / (total + SMOOTH * terms)), exactly."""
    whole = np.asarray(total, np.int64) + SMOOTH * terms
    out, rest = np.divmod(np.asarray(count, np.int64) + SMOOTH, whole)
    for digits in SCALE_DIGITS:
        step, rest = np.divmod(rest * digits, whole)
        out = out * digits + step
    return out + 1


def encode_runs(rows: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal counts begins, and the count; rows not named have none."""
    column = np.zeros(size, np.int64)
    column[rows] = counts
    starts = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]])) if size else np.zeros(0, np.int64)
    return starts, column[starts]


def run_distance(a: tuple, b: tuple, size: int) -> int:
    """Sum over all rows of the absolute difference of two run-length columns of (starts, values)."""
    edges = np.union1d(a[0], b[0])
    pa_, pb_ = a[1][owner(edges, a[0])], b[1][owner(edges, b[0])]
    return int((np.abs(pa_ - pb_) * np.diff(np.append(edges, size))).sum())


def _compare(lang: str, terms: pa.Array, row: np.ndarray, source: np.ndarray, count: np.ndarray, about, best: int) -> Iterator[tuple]:
    """Rows of one stretch of a language's vocabulary: distances of all pairs, and each source's foremost terms."""
    names, totals, vocabulary = about
    size = len(terms)
    columns = []
    for g in range(len(names)):
        mine = source == g
        starts, counts = encode_runs(row[mine], count[mine], size)
        columns.append((starts, frequency(counts, totals[g], vocabulary)))
    first, second = np.triu_indices(len(names), 1)
    values = np.array([run_distance(columns[i], columns[j], size) for i, j in zip(first, second)], np.int64)
    everyone = np.array(names, object)
    for a, b in ((first, second), (second, first)):
        yield lang, everyone[a], "pair", everyone[b], values
    if not size:
        return
    all_counts = np.zeros(size, np.int64)
    np.add.at(all_counts, row, count)
    over = frequency(count, totals[source], vocabulary) - frequency(all_counts, totals.sum(), vocabulary)[row]
    keep = np.flatnonzero(over > 0)
    rank = np.empty(size, np.int64)
    rank[pc.sort_indices(terms.cast(pa.binary())).to_numpy()] = np.arange(size)
    order = keep[np.lexsort((rank[row[keep]], -over[keep], source[keep]))]
    begun = np.searchsorted(source[order], source[order])
    order = order[np.arange(len(order)) - begun < best]
    yield lang, everyone[source[order]], "term", np.array(terms.take(pa.array(row[order])).to_pylist(), object), over[order]


def source_divergence(docs: DataFrame, least_docs: int = 30, best: int = 50) -> DataFrame:
    """Audit of every (lang, source) of ``docs`` (text, lang, source): lang, source, part, item, value, rank.

    Part ``pair`` has each other source of the language and the sum over kept terms of the difference of
    smoothed frequencies; part ``term`` the ``best`` terms that the source uses more than the language.
    A term is kept where at least ``least_docs`` of the language's documents hold it. Ranks go by value,
    the largest first, equal values by item in UTF-8 order.

    Null text, lang and source are empty. A group without terms is compared like any other, with counts of
    zero; a language without kept terms has distances of zero. Long texts and long terms are whole. Rows that
    repeat are documents of their own; doc_id and other columns are not looked at. An empty table gives no
    rows. The broadcast list has one row for each group; the result has one for each pair of groups of a
    language, so the list stays small beside it.
    """
    spark = docs.sparkSession
    path, kept_path = new_path(spark, "term_counts"), new_path(spark, "kept_terms")
    (docs.select("text", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
     .mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
     .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).write.parquet(path))
    counts = spark.read.parquet(path)
    (counts.filter("term IS NOT NULL").groupBy("lang", "term")
     .agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("uses"))
     .filter(F.col("docs") >= least_docs).select("lang", "term", "uses").write.parquet(kept_path))
    kept = spark.read.parquet(kept_path)
    uses = kept.select("lang", F.explode("uses").alias("u")).groupBy("lang", F.col("u.source").alias("source")).agg(F.sum("u.n").alias("n"))
    groups = counts.filter("term IS NULL").select("lang", "source").join(uses, ["lang", "source"], "left")
    sizes = dict(kept.groupBy("lang").count().collect())                 # one row per language
    about: dict[str, tuple] = {}
    for lang, source, n in sorted(map(tuple, groups.collect()), key=lambda r: (r[0], r[1])):     # one row per group
        names, totals, _ = about.setdefault(lang, ([], [], sizes.get(lang, 0)))
        names.append(source)
        totals.append(n or 0)
    shared = spark.sparkContext.broadcast({k: (names, np.array(totals, np.int64), v) for k, (names, totals, v) in about.items()})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column("lang").dictionary_encode()
            for code, name in enumerate(lang.dictionary.to_pylist()):
                names = shared.value[name][0]
                rows = pa.RecordBatch.from_struct_array(
                    batch.to_struct_array().filter(pc.equal(lang.indices, code)))
                rows = rows.filter(pc.is_valid(rows.column("term")))
                used = rows.column("uses")
                row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(used).to_numpy(zero_copy_only=False))
                cells = used.flatten()
                source = pc.index_in(cells.field("source"), pa.array(names, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
                for key, a, part, b, value in _compare(name, rows.column("term"), row, source,
                                                       cells.field("n").to_numpy(zero_copy_only=False).astype(np.int64), shared.value[name], best):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(a), pa.string()), pa.array(a, pa.string()), pa.array([part] * len(a), pa.string()),
                         pa.array(b, pa.string()), pa.array(value, pa.int64())], ["lang", "source", "part", "item", "value"])

    # One row without a term for each language, so that its sources are paired even where no term is kept.
    every = counts.filter("term IS NULL").select("lang").distinct().select(
        "lang", F.lit(None).cast("string").alias("term"), F.array().cast(kept.schema["uses"].dataType).alias("uses"))
    # Ranges are cut by the first uses alone: the cut points are sampled, and whole lists of uses are long.
    dealt = kept.unionByName(every).repartitionByRange("lang", F.slice("uses", 1, 2), "term").sortWithinPartitions("lang", "uses", "term")
    found = dealt.mapInArrow(compare, ROWS).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    # Foremost terms come from every range: they are cut in salted shares first, so that no source's shares meet in one task.
    share = Window.partitionBy("lang", "source", "part", F.pmod(F.xxhash64("item"), F.lit(_SALTS))).orderBy(F.desc("value"), "item")
    found = found.withColumn("rank", F.row_number().over(share)).filter((F.col("part") == "pair") | (F.col("rank") <= best))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return found.withColumn("rank", F.row_number().over(order)).filter((F.col("part") == "pair") | (F.col("rank") <= best))


DIVERGENCE_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS nth, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
found AS (SELECT nth, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT nth) AS docs FROM found GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL HAVING sum(docs) >= 30),
cells AS (SELECT g.lang, g.source, k.term, k.n AS all_n, coalesce(c.n, 0) AS n
    FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT lang, source, sum(n) AS total, count(*) AS v FROM cells GROUP BY ALL),
lang_sums AS (SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY ALL),
freq AS (SELECT c.lang, c.source, c.term, c.n,
        1 + CAST(1000000000 AS HUGEINT) * (c.n + 5) // (s.total + 5 * s.v) AS p,
        1 + CAST(1000000000 AS HUGEINT) * (c.all_n + 5) // (l.total + 5 * l.v) AS q
    FROM cells c JOIN sums s ON s.lang = c.lang AND s.source = c.source JOIN lang_sums l ON l.lang = c.lang),
pair_sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM freq a JOIN freq b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT lang, source, 'term', term, p - q FROM freq WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
    CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 50
"""
