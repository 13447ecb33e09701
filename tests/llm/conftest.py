import random

import pytest

import tributary.llm.store as store


def prose(rng: random.Random, n: int, vocabulary: int = 300) -> str:
    return " ".join(f"w{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """(doc_id, text): copies, near copies, shared passages, nulls, empty, blank and long texts, repeated rows and ids."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 120), 5_000) for _ in range(60)]
    passage = prose(rng, 90, 5_000)
    for k in range(12):
        texts.append(f"{prose(rng, 20, 5_000)} {passage[: 300 + 20 * k]} {prose(rng, 15, 5_000)}")
    base = prose(rng, 200, 5_000).split()
    for k in range(8):
        near = list(base)
        near[10 + 20 * k] = f"x{k}"
        texts.append(" ".join(near))
    texts += [texts[3], texts[3], None, "", " \t\n", "a b", "A  b", "é ü 漢字 🎉", "z " * 3_000, prose(rng, 2_500, 50_000)]
    rows = list(enumerate(texts))
    return rows + [rows[5], (None, texts[7]), (None, None), (7, "another text of a used id")]


@pytest.fixture()
def docs(spark, corpus):
    """The corpus as documents with further columns, some with names that operators might use."""
    store.small_batches(spark, 16)
    rows = [(i, t, ("en", "de", None)[n % 3], (None, "s0", "s1", "s2")[n % 4] if n % 3 else "s0", len(t or ""), n, "x") for n, (i, t) in enumerate(corpus)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key long, bucket string").repartition(3, "key")
