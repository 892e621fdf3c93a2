"""Fixtures of documents for the corpus operators."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

AWKWARD = [
    (0, "the quick brown fox jumps over the lazy dog near the old stone bridge", "en", "a", 1),
    (1, "the quick brown fox jumps over the lazy dog near the old stone bridge", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, " \n\t ", "en", "b", 4),
    (5, "word " * 30000, "en", "hot", 150000),
    (6, "Größe déjà vu 12,5 … \x01 <|endoftext|> é́ ΣΑΣ\r\nzwei", "de", "c", 5),
    (7, "short", "en", "c", 5),
    (None, "the quick brown fox jumps over the lazy dog near the old stone bridge", "en", "c", 5),
    (None, None, None, None, None),
    (7, "short", "en", "c", 5),
]


def docs(spark, rows=AWKWARD, clash=("id", "digest", "row", "key", "start", "ids", "words", "run", "component_id")):
    """Rows as documents, with extra columns whose names operators may use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("x") for c in clash})
