import random

import numpy as np
from conftest_llm import ODD, documents

from veritome.llm import decontamination as Q


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (Q.MATCH if x == y else Q.MISMATCH), h[i - 1][j] + Q.GAP, h[i][j - 1] + Q.GAP)
    return max(map(max, h))


def test_alignment_equals_the_table():
    rnd = random.Random(3)
    for _ in range(300):
        a, b = (np.array([rnd.randrange(4) for _ in range(rnd.randrange(1, n))]) for n in (12, 25))
        score, x, y = Q.align(a, b)
        assert score == smith_waterman(a, b) and (not score or smith_waterman(a, b[x:y]) == score)


def brute(rows, items):
    import re

    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = set()
    for d, t in rows:
        for i, u in items:
            a, b = words(u), words(t)
            share = 1 if len(a) < Q.GRAM else Q.LEAST_SCORE  # a short item is one n-gram
            if a and b and smith_waterman(a, b) >= share * Q.MATCH * len(a):
                out.add((d, i))
    return out


def test_copies_edits_and_clean_texts(spark, prose):
    rnd = random.Random(2)
    items = [(k, prose(500 + k, 30)) for k in range(6)] + [(90, None), (91, ""), (92, "Hi there")]
    rows = list(ODD)
    for k, (i, text) in enumerate(items[:6]):
        w = text.split()
        edited = [("zz" if j % 7 == 0 else x) for j, x in enumerate(w)]
        for n, passage in enumerate((w, edited, [x.upper() for x in w], w[: len(w) // 2 + 4], w[:5])):
            rows.append((100 * (k + 1) + n, f"{prose(rnd.random(), 60)} {' '.join(passage)}, {prose(rnd.random(), 60)}"))
    rows += [(5000, "Oh, HI there!"), (5001, prose(77, 2000))]
    items_df = spark.createDataFrame(items, "item_id long, text string")
    got = Q.find_leaks(documents(spark, rows), items_df).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(rows, items) and len(got) >= 25
    assert all(Q.LEAST_SCORE <= r.score <= 1 and r.first_word < r.end_word for r in got)
    clean = Q.keep_clean(documents(spark, rows), items_df)
    leaked = {r.doc_id for r in got}
    assert sorted(r.doc_id for r in clean.collect() if r.doc_id) == sorted(i for i, _ in rows if i and i not in leaked)


def test_blocks_and_empty_tables(spark, prose, monkeypatch):
    items = spark.createDataFrame([(k, prose(k, 20)) for k in range(5)], "item_id long, text string")
    docs = documents(spark, [(k, prose(k, 20)) for k in range(5)])
    assert [len(b.ids) for b in Q.blocks(items, "item_id", "text", 2)] == [2, 2, 1]
    assert {(r.doc_id, r.item_id) for r in Q.find_leaks(docs, items).collect()} == {(k, k) for k in range(5)}
    assert Q.find_leaks(docs, items.limit(0)).collect() == [] == Q.find_leaks(documents(spark, []), items).collect()


def test_long_items_stay_whole(spark, prose, monkeypatch):
    item = (prose(700, 9000)[:19_999]).rstrip()
    item += " " * (20_000 - len(item)) + "the"
    w = item.split()
    items = spark.createDataFrame([(1, item), (2, prose(701, 20))], "item_id long, text string")
    docs = documents(spark, [(1, item), (2, "only the word"), (3, " ".join(w[: len(w) * 2 // 3])), (4, " ".join(w[: len(w) // 3]))])
    got = {r.doc_id: r.score for r in Q.find_leaks(docs, items).collect()}
    assert set(got) == {1, 3} and got[1] == 1 and abs(got[3] - 2 / 3) < 0.01
    assert sorted(r.doc_id for r in Q.keep_clean(docs, items).collect()) == [2, 4]
    monkeypatch.setattr(Q, "BLOCK_CHARS", 10)
    assert [len(b.ids) for b in Q.blocks(items, "item_id", "text")] == [1, 1]


def test_ids_of_any_type_and_ties(spark, prose):
    item = prose(800, 20)
    docs = documents(spark, [(1, f"{prose(1, 30)} {item} {prose(2, 30)} {item}")])
    for kind, value in (("int", 7), ("string", "q"), ("smallint", 3)):
        items = spark.createDataFrame([(value, item), (None, prose(801, 20))], f"item_id {kind}, text string")
        got = Q.find_leaks(docs, items)
        assert got.schema["item_id"].dataType == items.schema["item_id"].dataType
        assert [(r.item_id, r.score, r.first_word, r.end_word) for r in got.collect()] == [(value, 1.0, 30, 50)]  # the first of two places


def test_recall_of_edited_copies(spark, prose):
    rnd, items, rows = random.Random(8), [], []
    for k in range(60):
        words = prose(900 + k, 40).split()
        items.append((k, " ".join(words)))
        edited = [f"new{rnd.randrange(99)}" if rnd.random() < 0.2 else w for w in words if rnd.random() > 0.05]
        rows.append((k, f"{prose(rnd.random(), 40)} {' '.join(edited)} {prose(rnd.random(), 40)}"))
    got = {(r.doc_id, r.item_id) for r in Q.find_leaks(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(k, k) for k in range(60)} <= got | {(k, k) for k in range(60) if (k, k) not in brute(rows[k : k + 1], items[k : k + 1])}


def test_clashing_names(spark, prose):
    item = prose(5, 20)
    docs = spark.createDataFrame([(1, item, 0.5, "x"), (2, "fine words", 0.1, "y")], "doc_id long, text string, score double, __text string")
    items = spark.createDataFrame([(1, item, "z")], "item_id long, text string, score string")
    assert [tuple(r) for r in Q.keep_clean(docs, items).collect()] == [(2, "fine words", 0.1, "y")]
    assert [r.doc_id for r in Q.find_leaks(docs, items).collect()] == [1]
