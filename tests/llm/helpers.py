"""Small tables for the operators' tests."""

DOC_KIND = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """rows: (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], DOC_KIND)


def save(df, folder, name="documents"):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


#: Nulls, empty and blank texts, ties, repeated rows, a long text.
ODD = [
    (None, "a row without an id"),
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (4, "one"),
    (5, "two words"),
    (6, "Ünï 中文  a b \n c  " * 3),
    (7, "long text, " * 4000),
    (8, "long text, " * 4000),
]
