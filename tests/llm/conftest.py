import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))


def words(rng, n):
    return [rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("lmnrst") + rng.choice("aeiou") + str(rng.randrange(30)) * 0 + rng.choice(["", "n", "s", "der", "tion"]) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): originals, near and exact copies, a shared passage, and edge cases."""
    rng = random.Random(11)
    out, passage = [], " ".join(words(rng, 60))
    for i in range(24):
        w = words(rng, rng.randrange(40, 160))
        out.append(w)
    for i in range(16):  # near copies of one, of each other by degrees
        w = list(out[0])
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(["alpha", "beta"]) + str(i)
        out.append(w)
    texts = [" ".join(w) for w in out] + [" ".join(words(rng, 30)) + " " + passage + " " + " ".join(words(rng, 30)) for _ in range(6)]
    texts += [texts[3]] * 5 + [texts[4].upper()] + [None, "", "   \n ", "one two", "One  TWO", "ünïcode wörds hére änd thére again", "x" * 30_000, " ".join(words(rng, 20_000)), "a b c d e", "a b c d e"]
    return list(enumerate(texts, start=7))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(d, t, ["en", "de", None][d % 3], f"src{d % 4}" if d % 5 else None, len(t or ""), "extra", 1.5) for d, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, component_id string, score double").repartition(3)
