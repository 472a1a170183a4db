import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, hash string, leaf int, labels string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (doc_id, text[, lang[, source]]), with columns whose names the operators use themselves."""
    from foldspark.llm.common import let_workers_import

    let_workers_import(spark)

    def table(rows):
        full = [(*r, *[None] * (4 - len(r))) for r in rows]
        return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "k", 1, "h", 2, "l") for i, t, lang, s in full], SCHEMA)

    return table


def prose(seed, words, vocabulary=400):
    """Seeded words in sentences of 4 to 14 words."""
    import random

    rng = random.Random(seed)
    out, left = [], 0
    for _ in range(words):
        word = "".join(rng.choice(["ba", "ri", "to", "men", "sul", "ka", "ve"]) for _ in range(1 + rng.randrange(3))) + str(rng.randrange(vocabulary) % 7 or "")
        left = left or rng.randrange(4, 15)
        left -= 1
        out.append(word + ("." if not left else ""))
    return " ".join(out)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and blank texts, a very long text, ties, repeated rows, several writing systems."""
    text = prose(1, 120)
    return [
        (1, text, "en", "b"), (1, text, "en", "b"), (2, None, None, None), (3, "", "en", "a"), (None, "no id here.", None, "a"), (None, None, None, None),
        (4, " \t\n ", "en", ""), (5, text, "en", "b"), (6, "x", None, "b"), (7, prose(2, 60_000), "en", "c"), (8, "日本語のテキスト。 これは文です。", "ja", "é"),
        (9, "a" * 30_000, "en", "c"), (10, "naïve café  test \U0001f600 \x1c ok", "fr", "c"), (11, "word " * 500, "en", "a"),
    ]
