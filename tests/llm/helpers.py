"""Small tables with awkward rows."""

CLASHING = ["key", "row", "sha", "hits", "measures", "verdict", "spans", "blob", "score", "node", "class_id", "tid", "label", "ids", "decoded", "refers_to"]


def frame(spark, rows, schema="doc_id long, text string"):
    """Rows with extra columns whose names operators use themselves."""
    extra = ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], f"{schema}, {extra}")


def awkward(texts):
    """Given texts, and null, empty, blank, very long, repeated rows, one row without an id."""
    rows = list(enumerate(texts))
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "word " * 60_000), (n + 4, "Ünïcödé ▁ 🎉 \x00\x01 end"), (None, "a row without an id"), (None, None)]
    return rows + [rows[0], rows[0]] if texts else rows
