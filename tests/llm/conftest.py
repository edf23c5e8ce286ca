import random

import pytest

WORDS = "amber birch cedar delta ember fjord grove haven inlet jetty knoll larch marsh north ocean pearl quartz ridge stone tidal umber valley willow yarrow zephyr".split()


def sentence(rng: random.Random, n: int = 8) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, nulls, empty ones and a very long one; (doc_id, text, lang, source, n_chars)."""
    rng = random.Random(5)
    texts: list[str | None] = ["\n".join(" ".join(sentence(rng) for _ in range(3)) for _ in range(rng.randint(2, 8))) for _ in range(60)]
    for k in range(12):  # near copies of one text, and of each other
        words = texts[0].split(" ")
        for _ in range(2):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        texts.append(" ".join(words))
    texts += [texts[3]] * 5 + [texts[4].upper()]
    passage = " ".join(sentence(rng) for _ in range(9))
    texts += [f"{sentence(rng)} {passage} {sentence(rng)}" for _ in range(6)]
    texts += [None, "", " \n\t ", "one two", "One two", "é!", "...\n...", " ".join(sentence(rng) for _ in range(3000)), "a b c d e f g h " * 9]
    return [(k, t, "en", f"src{k % 2}" if k % 7 else None, len(t or "")) for k, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
