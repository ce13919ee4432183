import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (id, text) pairs; clashing=True adds columns named like the operators' own."""

    def made(rows, clashing=False):
        data = [(i, t, None if i is None else "en", None if i is not None and i % 3 == 0 else "s", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(data, DOCS).repartition(3)
        if clashing:
            for name in ("_k1", "uid", "id", "t", "f", "kept", "recipe", "Fingerprint", "a.b", "component_id", "length"):
                from pyspark.sql import functions as F

                df = df.withColumn(name, F.lit("x"))
        return df

    return made
