import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def para(seed: int, n: int) -> str:
    """n words of invented prose, deterministic."""
    import random
    r = random.Random(seed)
    parts = "an be co de el fi go ha in jo ka lu mi no or pa qu re st tu".split()
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n))


def odd_rows():
    """Nulls in any column, empty and blank texts, repeated rows, very long and very short texts, ties."""
    base = para(1, 120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    rows = [(1, base, "en", "a", 5), (2, base, "en", "b", 5), (3, near, None, "a", None), (4, "", "fr", None, 0),
            (5, None, None, None, None), (6, "   \n\t ", "en", "a", 6), (7, "One two", "de", "a", 7), (8, "one TWO", "de", "a", 7),
            (9, "x" * 30000, "en", "c", 30000), (10, para(2, 9000), "en", "c", 1), (10, para(2, 9000), "en", "c", 1),
            (None, para(3, 40), "es", "a", 2), (12, "Ünï çödé 漢字 \U0001F600 text here.\nReleased under the MIT License.", "en", "d", 9)]
    return rows + [(20 + k, para(50 + k, 30 + k % 7), "en", f"s{k % 3}", k) for k in range(40)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def odd_wide(spark, odd):
    """Extra columns with the names the operators use inside."""
    from pyspark.sql import functions as F
    out = odd
    for c in ("score", "component", "component_id", "key", "piece", "bit", "label", "size", "rank", "pid", "token", "n", "held_out"):
        out = out.withColumn(c, F.lit("clash"))
    return out


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
