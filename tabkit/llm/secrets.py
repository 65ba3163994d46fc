"""Secrets: known forms, and other tokens that are as random as a key.

Tokens of 20 and more characters that no known form covers take a battery of tests for the
alphabet that their characters imply: chi-squared evenness, runs above and below the middle, and
correlation of neighbours. A token that any test tells from random at ``alpha`` is dropped. Whether
the rest could be words is a count of equal pairs of characters: words repeat theirs more often,
and the more so the longer they are, so the p-value knows the length. The p-values of all tokens,
by band of length, go through a false-discovery step at ``rate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabkit.llm.spans import located, listing, normal_tail, overlapping, settled, tagged
from tabkit.sources.workspace import checkpointed

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
#: Alphabets in the order they are tried, with what a token must look like; symbols stand in order.
ALPHABETS = (("decimal", "0123456789", "[0-9]+"), ("hex", "0123456789abcdef", "[0-9a-f]+"), ("HEX", "0123456789ABCDEF", "[0-9A-F]+"),
             ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "[A-Z2-7]+"),
             ("base36", "0123456789abcdefghijklmnopqrstuvwxyz", "[0-9a-z]+"),
             ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "[0-9A-Za-z]+"),
             ("base64", "+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_", "[0-9A-Za-z+/_-]+"))


def base_spans(text: Column) -> dict[str, Column]:
    assign = F.filter(located(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 1)) >= 6)
    access = F.when(text.contains("AKIA"), located(text, ACCESS)).otherwise(located(F.lit(""), ACCESS))
    return {"assign": assign, "access": access, "hex": located(text, HEX)}


def battery(tokens: DataFrame, alpha: float) -> DataFrame:
    """``tokens`` (match) with encoding, length, p_random, p_text; tokens told from random are left out."""
    which = F.coalesce(*(F.when(F.col("match").rlike(f"^{pattern}$"), F.lit(i)) for i, (_, _, pattern) in enumerate(ALPHABETS)))
    shape = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(symbols).alias("symbols")) for name, symbols, _ in ALPHABETS))
    coded = (tokens.withColumn("shape", settled(F.get(shape, which))).withColumn("n", F.length("match").cast("double"))
             .withColumn("size", F.when(F.col("shape.name") == "base64", 64).otherwise(F.length("shape.symbols")).cast("double"))
             .withColumn("code", settled(F.transform(F.filter(F.split("match", ""), lambda x: x != ""), lambda x: F.instr(F.col("shape.symbols"), x) - 1))))
    n, size = F.col("n"), F.col("size")
    counts = F.transform(F.array_distinct("code"), lambda x: F.size(F.filter("code", lambda y: y == x)).cast("double"))
    total = lambda array, value: F.aggregate(array, F.lit(0.0), lambda acc, x: acc + value(x))
    coded = coded.withColumns({"counts": settled(counts), "mean": settled(total("code", lambda x: x) / n)})
    pairs = F.zip_with(F.slice("code", F.lit(1), (n - 1).cast("int")), F.slice("code", F.lit(2), (n - 1).cast("int")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    high = lambda x: x * 2 >= size
    coded = coded.withColumn("pairs", settled(pairs))
    coded = coded.withColumns({
        "squares": total("counts", lambda x: x * x), "above": total("code", lambda x: F.when(high(x), 1.0).otherwise(0.0)),
        "turns": total("pairs", lambda p: F.when(high(p["a"]) != high(p["b"]), 1.0).otherwise(0.0)),
        "spread": total("code", lambda x: (x - F.col("mean")) * (x - F.col("mean"))),
        "lagged": total("pairs", lambda p: (p["a"] - F.col("mean")) * (p["b"] - F.col("mean")))})
    coded = coded.select("k1", "k2", "start", "end", "match", "band", F.col("shape.name").alias("encoding"), "n", "size", "squares", "above", "turns", "spread", "lagged") \
        .withColumns({"df": size - 1, "chi": size / n * F.col("squares") - n, "expected": 2 * F.col("above") * (n - F.col("above")) / n,
                      "equal": (F.col("squares") - n) / 2 + 1, "as_text": n * (n - 1) / 2 * F.greatest(F.lit(0.06), 1.5 / size)})     # equal pairs that words would have
    third, df, expected, equal = F.lit(1 / 3), F.col("df"), F.col("expected"), F.col("equal")
    scores = coded.withColumns({
        "z_even": (F.pow(F.greatest(F.col("chi"), F.lit(0.0)) / df, third) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)),
        "z_runs": F.abs((F.col("turns") - expected) / F.sqrt(F.greatest(expected * (expected * n - n) / (n * (n - 1)), F.lit(1e-9)))),
        "z_serial": F.abs((F.col("lagged") / F.nullif(F.col("spread"), F.lit(0.0)) + 1 / n) * F.sqrt(n)),
        "z_text": (F.pow(F.col("as_text") / equal, third) - (1 - 1 / (9 * equal))) / F.sqrt(1 / (9 * equal))})
    alone = (F.col("above") == 0) | (F.col("above") == n)
    tested = scores.withColumns({"p_even": normal_tail(F.col("z_even")), "p_runs": F.when(alone, 2 * F.pow(F.lit(0.5), n)).otherwise(2 * normal_tail(F.col("z_runs"))),
                                 "p_serial": F.coalesce(2 * normal_tail(F.col("z_serial")), F.lit(0.0)), "p_text": normal_tail(F.col("z_text"))})
    return (checkpointed(tested.select("k1", "k2", "start", "end", "match", "band", "encoding", "p_text",
                                       F.least(F.lit(1.0), 3 * F.least("p_even", "p_runs", "p_serial")).alias("p_random"))).filter(F.col("p_random") >= alpha))


def discovered(tokens: DataFrame, rate: float, tested: DataFrame) -> DataFrame:
    """Tokens whose p_text passes the false-discovery step of their band of length.

    p-values are rounded up to tenths of a power of ten, so the step looks at a few hundred counts
    however many tokens there are. ``tested``: the numbers of tokens by band, dropped ones included.
    """
    rows = tokens.withColumn("step", F.floor(-10 * F.log10(F.greatest("p_text", F.lit(1e-30)))).cast("int"))
    below = Window.partitionBy("band").orderBy(F.desc("step"))
    counts = rows.groupBy("band", "step").agg(F.count("*").alias("count")).withColumn("rank", F.sum("count").over(below)).join(tested, "band")
    cut = counts.filter(F.pow(F.lit(10.0), -F.col("step") / 10) <= rate * F.col("rank") / F.col("tested")).groupBy("band").agg(F.min("step").alias("cut"))
    return rows.join(cut, "band").filter("step >= cut").drop("step", "cut")


def secret_spans(docs: DataFrame, *, alpha: float = 0.005, rate: float = 0.01) -> DataFrame:
    """doc_id, counts of the known forms, base_sha256 and all spans of every row of ``docs``.

    Spans count code points. A null text is an empty one: no spans. Repeated rows each get their
    row; null doc_ids stay; other columns are not read; an empty table gives none.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(7), "text")})
    base = base_spans(F.col("text"))
    found = checkpointed(keyed.select("doc_id", "k1", "k2", *(v.alias(k) for k, v in base.items()), located(F.col("text"), TOKEN).alias("token")))
    known = F.concat("assign", "access", "hex")
    band = F.floor(F.log2(F.length("match").cast("double"))).cast("int")
    free = (found.filter(F.size("token") > 0)
            .select("k1", "k2", F.explode(F.filter("token", lambda t: ~overlapping(known, t["start"], t["end"]))).alias("t"))
            .select("k1", "k2", "t.*").distinct().withColumn("band", band))
    tested = free.groupBy("band").agg(F.count("*").alias("tested"))
    extra = (discovered(battery(free, alpha), rate, tested)
             .groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end", "match")).alias("random")))
    all_base = F.concat(*(tagged(F.col(k), k, i) for i, k in enumerate(KINDS[:3])))
    empty = F.expr("CAST(array() AS array<struct<start: int, end: int, match: string>>)")
    joined = found.join(extra, ["k1", "k2"], "left").withColumn("random", F.coalesce("random", empty))
    return joined.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), F.sha2(listing(all_base), 256).alias("base_sha256"),
        listing(F.concat(all_base, tagged(F.col("random"), "random", 3))).alias("spans"), F.size("random").cast("long").alias("n_random"))
