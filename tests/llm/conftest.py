import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    def make(texts, source="s"):
        rows = texts.items() if isinstance(texts, dict) else enumerate(texts)
        return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in rows], DOCS)

    return make


@pytest.fixture
def clashing(spark):
    """The same rows with columns named as the operators' own."""

    def add(df):
        from pyspark.sql import functions as F

        for name in ("chunk", "bucket", "node", "signature", "block", "place", "w", "item", "doc", "selected", "mix_order", "digest", "kept", "removed", "rated_key", "text_"):
            df = df.withColumn(name, F.lit("x"))
        return df

    return add
