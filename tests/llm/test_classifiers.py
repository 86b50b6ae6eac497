import random
import zlib

import pytest
from conftest_llm import ODD, documents

from veritome.llm import compression as C
from veritome.llm import quality_classifier as G
from veritome.llm import toxicity as X


def corpus(spark, prose, label):
    rnd = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        text = prose(i, rnd.randint(30, 120)).split()
        y = i % 3 == 0
        if label == "toxic" and y:
            for _ in range(4):
                text.insert(rnd.randrange(len(text)), rnd.choice(["grumbloid", "snarkface", "vilewort"]))
        if label == "quality" and not y:
            text = [w + rnd.choice(["%%%", "$$$", "###"]) for w in text]
        rows.append((i, " ".join(text)))
        labels.append((i, int(y), None))
    return documents(spark, ODD[:3] + rows[1:]), spark.createDataFrame([*labels, (None, 1, None), (5, None, None)], f"doc_id long, {label} int, text string"), labels


@pytest.mark.parametrize(("module", "label", "score"), [(X, "toxic", X.toxicity), (G, "quality", G.quality)])
def test_held_out_accuracy(spark, prose, module, label, score):
    docs, labels, truth = corpus(spark, prose, label)
    got = {r.doc_id: r for r in score(docs, module.fit(docs, labels)).collect()}
    held = [(i, y) for i, y, _ in truth if i in got and got[i].held_out and i > 5]
    assert {i for i, _ in held} == {i for i in got if i > 5 and zlib.crc32(str(i).encode()) % module.MODULUS == module.HELD_OUT}
    assert sum(got[i].predicted == y for i, y in held) / len(held) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= module.THRESHOLD) for r in got.values())
    assert {1, 2, 3} <= set(got)


def test_held_out_labels_are_not_read(spark, prose):
    docs, labels, _ = corpus(spark, prose, "toxic")
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(C.remainder(F.col("doc_id"), X.MODULUS) == X.HELD_OUT, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one = sorted(map(tuple, X.toxicity(docs, X.fit(docs, labels)).collect()), key=str)
    assert one == sorted(map(tuple, X.toxicity(docs, X.fit(docs, flipped)).collect()), key=str)


def test_no_labels_and_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    docs = documents(spark, ODD)
    assert {r.score for r in X.toxicity(docs, X.fit(docs, empty)).collect()} == {0.0}
    assert {r.score for r in G.quality(docs, G.fit(docs, empty)).collect()} == {1.0}
    assert X.toxicity(documents(spark, []), X.fit(docs, empty)).collect() == []


def test_windows_hold_the_whole_text():
    raw = b"ab cd " * 50 + b"x" * 300
    for size in (8, 64, 512):
        parts = C.windows(raw, size)
        assert b"".join(parts) == raw and max(map(len, parts)) <= size


def test_training_texts_are_whole(spark, prose, monkeypatch):
    long = prose(1, 30_000) + " veritas " + "zzzmark " * 40
    docs = documents(spark, [(i, prose(i, 60)) for i in range(1, 40)] + [(50, long)])
    labels = spark.createDataFrame([(i, int(i == 50)) for i in [*range(1, 40), 50]], "doc_id long, toxic int")
    texts = C.sample(docs, labels, "toxic", 3, 99, {1: 10, 0: 100})
    assert len(long) > 100_000 and texts[1] == [long] and len(texts[0]) == 39
    assert any(b"zzzmark" in w for w in X._windows(texts[1]))
    pieces: list = []
    monkeypatch.setattr(C, "trained", lambda windows, size: (b"".join(pieces.extend(windows) or windows), True))
    G.dictionary([long, *texts[0]])
    assert b"".join(pieces).startswith(long.encode())


def test_dictionaries_are_trained_apart(prose):
    words = ["grumbloid", "snarkface", "vilewort"]
    ordinary = [prose(i, 90) for i in range(400)]
    toxic = [f"{prose(1000 + i, 20)} {words[i % 3]} {prose(2000 + i, 20)} {words[i % 2]}" for i in range(200)]
    model = X.Model({1: toxic, 0: ordinary})
    assert any(w.encode() in model.toxic for w in words) and not any(w.encode() in model.ordinary for w in words)


def test_very_long_texts_are_scored_whole(spark, prose):
    docs, labels, _ = corpus(spark, prose, "toxic")
    model = X.fit(docs, labels)
    calm = prose(77, 40_000)
    marked = calm + " " + " ".join(f"{w} {prose(k, 3)}" for k, w in enumerate(["grumbloid", "snarkface", "vilewort"] * 6))
    got = {r.doc_id: r.score for r in X.toxicity(documents(spark, [(1, calm), (2, marked)]), model).collect()}
    assert len(calm) > 150_000 and got[2] > got[1]
