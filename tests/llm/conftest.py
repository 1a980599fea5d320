from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows and near copies."""
    rng = random.Random(7)
    words = ["the", "of", "and", "stone", "River", "blue", "été", "straße", "x1", "|", "!!", "日本", "a", "sea", "mountain"]
    say = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) * rng.randrange(2) for _ in range(n))
    out = [(k, say(rng.randrange(1, 120)), rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src12", None]), 1) for k in range(120)]
    base = say(400)
    out += [(200 + k, base + f" tail{k}", "en", "src0", 1) for k in range(12)]  # near copies
    out += [(300 + k, base, "en", "src0", 1) for k in range(40)]  # a large group of copies
    out += [(400, None, "en", "src0", None), (401, "", None, None, 0), (402, " \n\t ", "en", "src0", 4), (403, "one", "en", "src0", 3), (404, "two words", "de", "src12", 9)]
    out += [(405, say(20_000), "en", "src0", 1), (406, "line\nline\nline\nother line", "en", "src0", 1), (407, "ab " * 500, "en", "src0", 1)]
    out += [(408, "same row", "en", "src0", 1)] * 2 + [(409, "same id, other text", "en", "src0", 1), (409, "same id", "en", "src0", 1)]
    out += [(None, "no id", "en", "src0", 1), (None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Columns of other people's, named like ours."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("x") for c in ("fp", "digest", "score", "shard", "slot", "tokens", "label", "group_size", "key", "n", "weights", "quota", "full")})
