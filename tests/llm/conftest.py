import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows):
        """Rows of (doc_id, text[, source[, lang]])."""
        full = [(r[0], r[1], r[3] if len(r) > 3 else None, r[2] if len(r) > 2 else None,
                 len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make


@pytest.fixture(scope="session")
def odd_documents(documents):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    long_text = "lorem ipsum dolor sit amet " * 60_000
    return documents([
        (1, None), (2, ""), (3, "   \n\t"), (None, "a text without an id but with words", "s", "en"),
        (None, None, None, None), (4, "one two", None, "en"), (5, "one two", "s", "en"),
        (5, "one two", "s", "en"), (6, "12345 !!! ???", "s"), (7, long_text, "s", "la"),
        (8, "x" * 50_000, "s", "la"), (9, "nul \0 inside", "s", "en"), (10, "Ünïcödé ÉÈ 漢字", "t", "fr")])


@pytest.fixture(scope="session")
def clashing():
    """A frame with more columns whose names an operator might use itself."""
    from pyspark.sql import functions as F

    names = ("key", "row", "_row", "guess", "size", "place", "shard", "fp", "anchor", "tier", "block",
             "copies", "n", "p", "label", "stratum", "rank", "lang_score", "mix_key", "doc_key",
             "toxicity_sums", "_url", "_host", "probability", "component_id", "u", "item", "half")
    return lambda df: df.withColumns({c: F.lit(f"own {c}") for c in names if c not in df.columns})
