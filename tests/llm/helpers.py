"""Small document tables with every awkward case."""

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, first=0):
    """documents of texts (None: null text), with the columns of the real table."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts, first)], SCHEMA)


def clashing(documents):
    """Extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    return documents.withColumns({n: F.lit(7) for n in ("score", "hits", "found", "base", "n", "id", "key", "ids", "items", "digest", "w", "label", "registers", "component", "bucket", "carry", "c0", "quality_score", "with.dot", "with`tick")})


def odd_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows, a null id."""
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, "one two three four five six", "en", None, None), (4, "one two three four five six", "en", None, None), (5, "word é 日本 " * 20000, "fr", "s", 9), (None, "one two three four five six", "en", "s", 1), (6, "x" * 100000, "en", "s", 1)]
    return spark.createDataFrame(rows, SCHEMA)
