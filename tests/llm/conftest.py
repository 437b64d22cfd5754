import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Builds a documents table from (doc_id, text) or (doc_id, text, source), with columns whose names clash."""
    from pyspark.sql import functions as F

    from apexframe.session import ship

    ship(spark)

    def make(rows, clash=True):
        rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(rows, DOCS)
        if clash:
            for c in ("size", "shard", "slot", "node", "key", "a", "b", "score", "target", "rank", "component", "toxic"):
                df = df.withColumn(c, F.lit("clash"))
        return df

    return make
