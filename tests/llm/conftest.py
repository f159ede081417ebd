import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, over several partitions."""

    def make(pairs, extra=None, parts=3):
        rows = [(k, t, "en", "src0", len(t) if t is not None else None) for k, t in pairs]
        df = spark.createDataFrame(rows, DOC_SCHEMA).repartition(parts)
        for name, value in (extra or {}).items():
            df = df.withColumn(name, value)
        return df

    return make


@pytest.fixture(scope="session")
def clashing():
    """Extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    return {n: F.lit(None).cast("string") for n in
            ("digest", "row", "keep_id", "cell", "size", "key", "kept", "component_id", "spans", "one", "_pid", "words", "lines", "h")}


ODD_TEXTS = [None, "", " ", "\n\n", "a", "a a a", "word " * 30000, "x" * 50000, "ünï  cödé\t😀 end ", "a\x1cb　c"]
