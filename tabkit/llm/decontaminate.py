"""Benchmark items inside documents, by MinHash containment search.

Words are runs of letters and digits in lower case; an item is the set of its runs of five words.
A document holds an item if at least ``percent`` of the item's shingles are among its own. Items
are partitioned by size. The sketch of an item is the least ``m`` of its shingles' hashes, where
``m`` is one more than the shingles that a document may lack at the item's size, so a document
that holds the item holds part of the sketch however long it is. Documents look up those of
their shingles whose hashes are below the largest sketch value of any size they are large enough
for; what they meet is verified by the exact share of shingles. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.llm.spans import settled
from tabkit.sources.workspace import checkpointed, new_path

SIZE = 5


def word_list(text: Column) -> Column:
    return settled(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def shingle_hashes(words: str) -> Column:
    """Distinct hashes of the runs of five words in an array column."""
    first = F.sequence(F.lit(0), F.size(words) - SIZE)
    hashes = F.transform(first, lambda i: F.xxhash64(*(F.get(F.col(words), i + k) for k in range(SIZE))))
    return settled(F.when(F.size(words) >= SIZE, F.array_distinct(hashes)).otherwise(F.expr("CAST(array() AS array<bigint>)")))


def shingle_texts(words: str) -> Column:
    first = F.sequence(F.lit(0), F.size(words) - SIZE)
    parts = F.transform(first, lambda i: F.concat_ws(" ", *(F.get(F.col(words), i + k) for k in range(SIZE))))
    return settled(F.when(F.size(words) >= SIZE, F.array_distinct(parts)).otherwise(F.expr("CAST(array() AS array<string>)")))


def item_sketches(items: DataFrame, percent: int) -> DataFrame:
    """item, band, least size of a holder, and one row per value of the sketch."""
    n, lacking = F.size("hashes"), F.floor((100 - percent) * F.size("hashes") / 100)
    return (items.withColumn("n", n).filter("n > 0")
            .select("item", F.floor(F.log2("n")).cast("int").alias("band"), F.ceil(percent * F.col("n") / 100).cast("int").alias("least"),
                    F.explode(F.slice(F.sort_array("hashes"), F.lit(1), (lacking + 1).cast("int"))).alias("hash")))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, percent: int = 80) -> DataFrame:
    """doc_id, item_id, n_shingles of the item, n_found and containment for each row of ``docs`` and item that it holds.

    Items of fewer than five words have no shingle and are not searched; null and empty texts hold
    nothing. Repeated rows of either table each give their rows; null ids are kept as they are;
    other columns are not read; an empty table on either side gives no row.
    """
    spark = docs.sparkSession
    items = checkpointed(
        benchmark.select("item_id", "text").filter("text IS NOT NULL").groupBy("item_id", "text").agg(F.count("*").alias("copies"))
        .select("item_id", "copies", F.xxhash64("text", "item_id").alias("item"), word_list(F.col("text")).alias("words"))
        .select("item_id", "copies", "item", shingle_hashes("words").alias("hashes"), shingle_texts("words").alias("shingles")))
    sketches = checkpointed(item_sketches(items, percent))
    bands = sketches.groupBy("band").agg(F.max("hash").alias("bound"), F.min("least").alias("least")).orderBy("band").collect()   # one row per power of two
    if not bands:
        empty = T.StructType([docs.schema["doc_id"], benchmark.schema["item_id"]])
        return spark.createDataFrame([], empty.add("n_shingles", "integer").add("n_found", "integer").add("containment", "double"))
    source = docs.select("doc_id", "text").filter("text IS NOT NULL").withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(7), "text")})
    hashed = source.select("k1", "k2", word_list(F.col("text")).alias("words")).select("k1", "k2", shingle_hashes("words").alias("hashes"))
    largest = max(b["bound"] for b in bands)
    low = (hashed.select("k1", "k2", F.size("hashes").alias("size"), F.filter("hashes", lambda h: h <= largest).alias("low"))
           .select("k1", "k2", "size", F.explode("low").alias("hash")))
    fits = " OR ".join(f"(size >= {b['least']} AND hash <= {b['bound']})" for b in bands)
    looked = low.filter(fits)
    path = new_path(spark, "held")                          # written as files, so that the join below knows their size
    looked.join(sketches, "hash").filter("size >= least").select("k1", "k2", "item").distinct().write.parquet(path)
    maybe = spark.read.parquet(path)
    words = source.join(maybe.groupBy("k1", "k2").agg(F.collect_list("item").alias("items")), ["k1", "k2"]).select("doc_id", "items", word_list(F.col("text")).alias("words"))
    sets = words.select("doc_id", "items", shingle_texts("words").alias("own")).select("doc_id", "own", F.explode("items").alias("item"))
    both = sets.join(items.select("item", "item_id", "copies", "shingles"), "item")
    counted = both.select("doc_id", "item_id", F.size("shingles").alias("n_shingles"), F.size(F.array_intersect("shingles", "own")).alias("n_found"),
                          F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
    return (counted.filter(100 * F.col("n_found") >= percent * F.col("n_shingles"))
            .select("doc_id", "item_id", "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment")))


#: The same result as SQL, by comparing all shingles.
CONTAINED_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT row_number() OVER () AS r, item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT r, doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1))) AS k FROM d)),
it AS (SELECT DISTINCT r, item_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1))) AS k FROM i)),
n AS (SELECT r, count(*) AS n FROM it GROUP BY r)
SELECT doc_id, item_id, CAST(any_value(n.n) AS INTEGER) AS n_shingles, CAST(count(*) AS INTEGER) AS n_found, count(*) / CAST(any_value(n.n) AS DOUBLE) AS containment
FROM it JOIN ds USING (s) JOIN n ON n.r = it.r
GROUP BY it.r, ds.r, doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(n.n)
"""
