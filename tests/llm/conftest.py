import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id long, label string, score double, kept boolean, size int, keys string, hash string, rank int, h string, batch string, node int, digest string"


def _words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices("abcdefghij", k=rng.randint(1, 7))) for _ in range(n)]


def odd_texts() -> list[tuple]:
    """(doc_id, text, lang, source): nulls, empty and long texts, copies, near copies, shared lines, repeated rows."""
    rng = random.Random(7)
    base = _words(rng, 300)
    shared = "This line is long enough to count as shared."
    rows = [
        (None, "a text of a document that has no identifier at all", "en", "b"),
        (1, None, "en", "a"),
        (2, "", None, "a"),
        (3, " \t\n\x0b\x0c\r", "en", None),
        (4, "one", "xx", "b"),
        (5, "ONE", "en", "b"),
        (6, "two words", "de", "b"),
        (7, " ".join(base), "en", "a"),
        (8, " ".join(base), "en", "a"),
        (9, "  ".join(base) + " \n", "fr", None),
        (10, " ".join(base[:297] + ["zz", "yy", "xx"]), "en", "a"),
        (11, " ".join(base[:150] + _words(rng, 150)), "en", "c"),
        (12, f"first\n  {shared.upper()}  \nÉté x\nlast", "fr", "c"),
        (13, f"{shared}\n\nother\n{shared}", "en", "c"),
        (14, f"{shared}\nmore\n", "en", ""),
        (15, "".join(rng.choices("ab cd\nÄé#|", k=60_000)), "de", "a"),
        (16, "x" * 30_000, "en", "a"),
        (17, "日本語 テスト ▁ \u0000 😀 end  of  it", "en", "b"),
        (20, "the same row twice, word for word, in this table", "en", "a"),
        (20, "the same row twice, word for word, in this table", "en", "a"),
        (21, "the same number", "en", "a"),
        (21, "but another text", "en", "a"),
        (2**62 + 1, "a large identifier, past what a double can hold", "es", "z"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, lang, s, None if t is None else len(t), 1, "l", 0.5, None, 3, "k", "h", 2, None, "b", 9, "d") for i, t, lang, s in odd_texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
