import hashlib
import random
import re

import pytest

SYLLABLES = "the of an in er on at re th st ou es ti".split()


@pytest.fixture(scope="session")
def prose():
    """Random words, the same for a seed."""

    def make(seed, n=120):
        rnd = random.Random(seed)
        return " ".join("".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 3))) for _ in range(n))

    return make


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def documents(spark, rows, extra=True):
    """Rows of (doc_id, text) with columns whose names clash with computed ones."""
    schema = "doc_id long, text string" + (", n_words long, score double, spans string, rank long, node long, id long" if extra else "")
    return spark.createDataFrame([(i, t, *([None] * 6 if extra else [])) for i, t in rows], schema)


#: Null and empty texts, ties, repeated rows and a null id.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (None, "b c"), (5, "é 日本 🙂")]
