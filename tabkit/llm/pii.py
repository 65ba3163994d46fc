"""Personal data: known forms, and candidates chosen by boosted trees.

Generators with high recall propose spans that may overlap: loose and spelled-out addresses, and
groups of digits. Boosted trees learn from all candidates which of them carry a known form, by
format and context (the characters around); candidates alike in all features are one example with
their number as its weight. Their scores are calibrated on held out candidates, and the least
threshold of the wanted precision selects further redactions among candidates that no known form
covers. Known forms always stay.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.llm.spans import SPANS, listing, located, overlapping, tagged
from tabkit.sources.workspace import checkpointed

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOOSE_EMAIL = r"[A-Za-z0-9._%+-]{1,64}\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++"
DIGITS = r"\+?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+"
KINDS = ("email", "ip", "card", "phone", "other")
CUES = r"(?i)(?:phone|tel|call|fax|mobile|mail|contact|address|card|visa|account|ip|server|host)[^A-Za-z]*$"
AROUND = 24
#: Counts above this are alike. Up to the square of ``BINS`` examples, trees may split between any two values.
MOST_COUNT, BINS = 64, 1024
FEATURES = ("digits", "size", "breaks", "plus", "at", "spelled", "dots", "octets", "luhn", "leading_zero", "letter_before", "letter_after",
            "mark_before", "mark_after", "cue")


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Whether the digits pass the check sum; doubled digits above 9 lose 9."""
    d = F.transform(F.filter(F.split(F.reverse(digits_of(match)), ""), lambda x: x != ""), lambda x: F.ascii(x) - 48)
    part = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0)))
    return F.aggregate(part, F.lit(0), lambda acc, x: acc + x) % 10 == 0


def octets(match: Column) -> Column:
    """Whether all dotted parts are at most 255."""
    plain = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(match, r"\."), lambda p: (F.length(plain(p)) <= 3) & (F.coalesce(plain(p).try_cast("int"), F.lit(0)) <= 255))


def base_spans(text: Column) -> dict[str, Column]:
    count = lambda s: F.length(digits_of(s["match"]))
    none = F.expr(f"CAST(array() AS {SPANS})")
    return {"email": F.when(text.contains("@"), located(text, EMAIL)).otherwise(none),
            "ip": F.filter(located(text, IP), lambda s: octets(s["match"])),
            "card": F.filter(located(text, CARD), lambda s: (count(s) >= 12) & (count(s) <= 19) & luhn(s["match"])),
            "phone": F.when(text.contains("+"), F.filter(located(text, PHONE), lambda s: (count(s) >= 9) & (count(s) <= 15))).otherwise(none)}


def with_context(spans: Column, text: Column) -> Column:
    """Spans with the characters before and after them."""
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"),
        F.substring(text, F.greatest(s["start"] - AROUND + 1, F.lit(1)), F.least(s["start"], F.lit(AROUND))).alias("before"),
        F.substring(text, s["end"] + 1, F.lit(2)).alias("after")))


def features(rows: DataFrame) -> DataFrame:
    m, flag = F.col("match"), lambda c: F.when(c, 1.0).otherwise(0.0)
    dotted = m.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$")
    count = lambda part: F.least(F.length(part), F.lit(MOST_COUNT)).cast("double")
    return rows.withColumns({
        "digits": count(digits_of(m)), "size": count(m),
        "breaks": count(F.regexp_replace(m, "[^ ().-]", "")), "plus": flag(m.startswith("+")), "at": flag(m.contains("@")),
        "spelled": flag(m.rlike(r"\((?:at|dot)\)|\[(?:at|dot)\]")), "dots": count(F.regexp_replace(m, "[^.]", "")),
        "octets": flag(dotted & octets(m)), "luhn": flag(luhn(m)), "leading_zero": flag(m.startswith("0")),
        "letter_before": flag(F.col("before").rlike("[A-Za-z0-9_]$")), "letter_after": flag(F.col("after").rlike("^[A-Za-z0-9_]")),
        "mark_before": flag(F.col("before").rlike("[^\\sA-Za-z0-9]$")), "mark_after": flag(F.col("after").rlike("^[^\\sA-Za-z0-9]")),
        "cue": flag(F.col("before").rlike(CUES))})


def examples(candidates: DataFrame) -> DataFrame:
    """held, label, features and the number n of all candidates alike in them; a text's candidates are held out together."""
    rows = candidates.filter("known IS NOT NULL").select(
        "match", "before", "after", F.col("known").cast("double").alias("label"), (F.pmod(F.xxhash64(F.lit(3), "k1", "k2"), F.lit(4)) == 0).alias("held"))
    return features(rows).groupBy("held", "label", *FEATURES).agg(F.count("*").cast("double").alias("n"))


def chosen(candidates: DataFrame, precision: float) -> DataFrame | None:
    """Uncovered candidates whose calibrated score passes; None if there is nothing to learn from."""
    seen = checkpointed(examples(candidates).orderBy("held", "label", *FEATURES))
    classes = {(r["held"], r["label"]) for r in seen.select("held", "label").distinct().collect()}
    if len(classes) < 4:
        return None
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="vector")
    model = GBTClassifier(featuresCol="vector", weightCol="n", maxIter=12, maxDepth=4, maxBins=BINS, seed=1).fit(
        assemble.transform(seen.filter("NOT held")).select("vector", "label", "n"))
    scored = lambda df: model.transform(assemble.transform(df)).withColumn("score", F.round(vector_to_array("probability")[1], 2))
    steps = sorted(((r["score"], r["yes"], r["n"]) for r in scored(seen.filter("held")).groupBy("score").agg(
        F.sum(F.col("label") * F.col("n")).alias("yes"), F.sum("n").alias("n")).collect()), reverse=True)        # at most 101 scores
    threshold, yes, n = None, 0, 0
    for score, y, k in steps:
        yes, n = yes + y, n + k
        if yes >= precision * n:
            threshold = score
    if threshold is None:
        return None
    return scored(features(candidates.filter("NOT known"))).filter(F.col("score") >= max(threshold, 0.5))


def personal_spans(docs: DataFrame, *, precision: float = 0.98) -> DataFrame:
    """doc_id, counts of the known forms, base_sha256 and all spans of every row of ``docs``.

    Spans count code points. A null text is an empty one: no spans. Repeated rows each get their
    row; null doc_ids stay; other columns are not read; an empty table gives none. Without
    candidates of both classes to learn from, no span is added.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(7), "text")})
    text = F.col("text")
    none = F.expr(f"CAST(array() AS {SPANS})")
    loose = F.when(text.rlike(r"@|\(at\)|\[at\]"), located(text, LOOSE_EMAIL)).otherwise(none)
    found = checkpointed(keyed.select("doc_id", "k1", "k2", *(v.alias(k) for k, v in base_spans(text).items()),
                                      F.concat(with_context(loose, text), with_context(located(text, DIGITS), text)).alias("maybe")))
    known = F.concat(*KINDS[:4])
    candidates = (found.filter(F.size("maybe") > 0)
                  .select("k1", "k2", F.explode(F.transform("maybe", lambda s: F.struct(
                      s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), s["before"].alias("before"), s["after"].alias("after"),
                      overlapping(known, s["start"], s["end"]).alias("known")))).alias("s")).select("k1", "k2", "s.*").distinct())
    picked = chosen(candidates, precision)
    if picked is None:
        joined = found.withColumn("other", none)
    else:
        extra = picked.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end", "match")).alias("other"))
        joined = found.join(extra, ["k1", "k2"], "left").withColumn("other", F.coalesce("other", none))
    all_base = F.concat(*(tagged(F.col(k), k, i) for i, k in enumerate(KINDS[:4])))
    return joined.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]), F.sha2(listing(all_base), 256).alias("base_sha256"),
        listing(F.concat(all_base, tagged(F.col("other"), "other", 4))).alias("spans"), F.size("other").cast("long").alias("n_other"))
