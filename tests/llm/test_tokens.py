import pytest

from framelake.llm.tokens import RANKS, encoding, token_counts


def test_counts_round_trip(spark):
    try:
        enc = encoding(RANKS)
    except FileNotFoundError:
        pytest.skip("no rank file")
    texts = ["", None, "a", "Hello, world's end", "Grüße 😀\n\n  x", "ab " * 50_000]
    for t in filter(None, texts):
        assert enc.decode(enc.encode_ordinary(t)) == t
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").selectExpr("id", "text", "'clash' as tokens_", "id as n")
    got = {r["id"]: r["tokens"] for r in token_counts(df).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
