import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs."""
    return lambda rows: spark.createDataFrame([(i, t, "en", None if t is None else len(t)) for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, very long, unbroken, odd characters, special strings, repeats."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices(["an", "er", "th", "é", "ß", "ing", "ó"], k=rng.randint(1, 4)))
    long = " ".join(word() for _ in range(30000))
    return [
        None, "", " ", "\n\n", "a", "1 2 3 #", "x" * 20000, long, "<|endoftext|> a<|endoftext|>", "<s> </s>", "▁a ▁ b", "日本語 テキスト　です", "tab\tand\x0bothers\x1c\x85 end ",
        "  two  spaces ", "don't we'll I'D", "same text here. " * 40, "one line.\none line.\none line.", "😀😀 \U0001f1e9", "\x00nul\x00", "a | b | c | d | e | f",
    ]
