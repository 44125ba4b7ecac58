"""Random keys with separators are found; paths of words are not."""

import random

from alignscope.llm import secrets


def test_random_keys_are_not_paths(spark):
    rng = random.Random(1)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["wJalrXUtnFEMI/K7MDENG/bPxRfiCYzQ9tKEYabc"] + ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(300)]
    paths = ["usr/local/share/documents/report", "alpha-beta-2024-01-15-release-notes", "some_long_snake_case_identifier_here"]
    docs = spark.createDataFrame(list(enumerate(keys + paths)), "doc_id long, text string")
    found = {r.doc_id for r in secrets.secret_scan(docs).where("n_entropy > 0").collect()}
    assert 0 in found and len(found) >= 0.99 * len(keys) and max(found) < len(keys)


def test_long_candidates(spark):
    """Neither many segments nor one long run takes stack, and a long key is found whole."""
    texts = ["ab1/" * 300_000, "aB3dE5gH7jK9mN1pQ2rS" * 5_000, "ab1/" * 300_000 + "aB3dE5gH7jK9mN1pQ2rS"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.secret_scan(docs).collect()}
    assert got[0] == "" and got[1] == "entropy:0:100000" and got[2].startswith("entropy:")


def test_many_matches(spark):
    """A text with 200,000 matches: more than one block of spans, in time that grows with their number."""
    n = 200_000
    docs = spark.createDataFrame([(1, "password=abcdefgh1 token: x " * n)], "doc_id long, text string")
    row = secrets.secret_scan(docs).first()
    assert row.n_assign == n and row.spans.split(",") == [f"assign:{28 * i}:{28 * i + 18}" for i in range(n)]
