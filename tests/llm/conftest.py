import pytest


@pytest.fixture
def docs_with_edges(spark):
    """Nulls in every column, empty and very long texts, repeated rows, a null id, and extra columns with clashing names."""
    words = " ".join(f"w{i % 997}x{i % 89}" for i in range(60_000))
    rows = [
        (0, "one two three four five six seven eight nine ten", "en", "a"),
        (1, "one two three four five six seven eight nine ten", "en", None),
        (2, None, None, None),
        (3, "", "en", "a"),
        (4, " \t\n ", "en", "a"),
        (5, words, "en", "b"),
        (5, words, "en", "b"),
        (None, "no id", "en", "a"),
        (7, "Ünï 日本 emoji 👩‍👩‍👧  two  blanks \x00 nul", "de", "c"),
    ]
    extra = "score double, size long, shard int, kept boolean, rep long, key string, list int, grade int, part int, n long"
    names = [f.split()[0] for f in extra.split(", ")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "length(text) as n_chars", *[f"cast(null as {f.split()[1]}) as {f.split()[0]}" for f in extra.split(", ")]), names
