import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def documents(spark):
    """Documents with nulls, empty and long texts, repeated rows and a clashing further column."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("part", T.StringType())])
    long = " ".join(f"wort{i % 977} und" for i in range(6000))
    texts = {0: "The quick brown fox jumps over the lazy dog. " * 20, 1: None, 2: "", 3: "Élan vital, déjà vu!\nNaïve ΑΣ <|endoftext|> don't 42", 4: long, 5: "same text here", 6: "same text here", 7: " \n\t ", 8: "été \x1c odd\xa0space"}
    rows = [(k, t, "en", "src0", len(t or ""), "x") for k, t in texts.items()]
    return spark.createDataFrame([*rows, rows[5], (None, "no id", None, None, None, None)], schema)
