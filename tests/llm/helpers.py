"""Document tables for tests, with other columns under names that operators use inside."""

CLASHES = ["size", "key", "term", "word", "n", "bucket", "place", "target", "value", "rank"]


def frame(spark, rows, columns="doc_id long, text string"):
    """Rows of the given columns, each with clashing columns behind them."""
    extra = ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in rows], f"{columns}, {extra}")
