import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and blank texts, repeated rows, special strings and a long text."""
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
    rows = [
        (1, None, None),
        (2, "", "en"),
        (3, " \n\t ", "en"),
        (4, "one two three", None),
        (5, "One  TWO\tthree", "fr"),
        (6, "é́ñ <|endoftext|> \U0001f600 <|endoftext|><|endoftext|>x", "de"),
        (7, long, "en"),
        (8, long.upper(), "en"),
        (8, long.upper(), "en"),
        (9, "a b c d e a b c d e a b c d e f g h i j k l", "en"),
        (10, "!!! ??? ***", "en"),
    ]
    schema = "doc_id long, text string, lang string"
    from pyspark.sql import functions as F

    extra = {c: F.lit("clash") for c in ("id", "score", "n", "w", "a", "b", "rep", "digest", "component_id", "kept", "row", "family", "items", "value", "line", "secret")}
    return spark.createDataFrame(rows, schema).withColumns(extra)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("doc_id < 0")
