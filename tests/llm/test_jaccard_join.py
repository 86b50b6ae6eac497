import random

import numpy as np
from conftest_llm import ODD, documents, lower, words

from veritome.llm import jaccard_join as Q
from veritome.llm.components import components


def sets(rows):
    out = []
    for i, text in rows:
        w = words(lower(text or ""))
        out.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def brute(rows):
    all_sets = sets(rows)
    link = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if link(all_sets[i][1], all_sets[j][1]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for k, (i, s) in enumerate(all_sets):
        ids = [all_sets[m][0] for m in range(len(rows)) if group[m] == group[k] and all_sets[m][0] is not None]
        out.append((i, len(s), min(ids, default=None)))
    return sorted(out, key=str)


def family(prose, rnd):
    rows, n = [], 100
    for f in range(6):
        base = prose(f, rnd.choice([7, 30, 120])).split()
        for _ in range(12):
            w = list(base)
            for _ in range(rnd.randrange(6)):
                w[rnd.randrange(len(w))] = f"edit{rnd.randrange(999)}"
            rows.append((n, " ".join(w).upper() if rnd.random() < 0.2 else " ".join(w)))
            n += 1
    return rows


def test_equals_brute_force(spark, prose):
    rnd = random.Random(5)
    rows = ODD + family(prose, rnd) + [(50, prose(0, 120)), (51, "A b"), (52, "a  B")] + [(k, "common line of words here\n" + prose(k, 9)) for k in range(200, 230)]
    got = Q.jaccard_components(documents(spark, rows).repartition(3)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)


def test_all_links(spark, prose):
    rows = family(prose, random.Random(6))
    links, docs = Q.similar_pairs(documents(spark, rows))
    node = {r.id: r.node for r in docs.collect()}
    distinct = {node[i]: s for i, s in sets(rows)}
    want = {tuple(sorted((a, b))) for a, x in distinct.items() for b, y in distinct.items() if a < b and 100 * len(x & y) >= 80 * len(x | y)}
    got = [tuple(sorted((r.a, r.b))) for r in links.collect()]
    assert set(got) == want and len(got) == len(want) and want


def test_keep_one_and_empty_table(spark, prose):
    a = prose(1)
    docs = documents(spark, [(3, a), (1, a + " x"), (2, None), (4, None)])
    assert sorted(r.doc_id for r in Q.keep_one(docs).collect()) == [1, 2, 4]
    assert Q.keep_one(docs).columns == docs.columns
    assert Q.jaccard_components(documents(spark, [])).collect() == []


def test_one_row_of_a_group_stays(spark, prose):
    a, b, c = prose(1), prose(2), prose(3)
    rows = [(5, a), (5, a), (None, a), (5, b), (None, c), (None, c + " x"), (7, b), (None, None), (None, ""), (9, None), (9, None)]
    got = sorted(((r.doc_id, r.text) for r in Q.keep_one(documents(spark, rows).repartition(3)).collect()), key=str)
    texts = [t for _, t in got]
    assert texts.count(a) == 1 and (5, a) in got and (5, b) in got and (7, b) not in got
    assert sum(t in (c, c + " x") for t in texts) == 1 and texts.count("") == 1 and texts.count(None) == 3 and len(got) == 7


def test_very_long_texts(spark, prose):
    long = prose(4, 40_000)
    rows = [(1, long), (2, long + " " + prose(5, 200)), (3, prose(6, 40_000)), (4, prose(7, 30))]
    assert sorted(map(tuple, Q.jaccard_components(documents(spark, rows)).collect())) == brute(rows)


def test_copies_in_several_tasks_count_once(spark, prose):
    texts = [t for k in (1, 2) for t in (prose(k), prose(k) + " more")]
    rows = [(10 * copy + k, text) for copy in range(2) for k, text in enumerate(texts)]
    schema = documents(spark, []).schema
    docs = spark.createDataFrame(spark.sparkContext.parallelize([(i, t, *[None] * 6) for i, t in rows], 2), schema)
    got = {r.doc_id: r.component_id for r in Q.jaccard_components(docs).collect()}
    assert got == {0: 0, 1: 0, 10: 0, 11: 0, 2: 2, 3: 2, 12: 2, 13: 2}


def test_threshold_is_exact():
    a = np.arange(100, dtype=np.uint64)
    assert Q.overlap_reaches(a[:90], a[10:]) and not Q.overlap_reaches(a[:90], a[11:])  # 80 and 79 of 100
    assert Q.overlap_reaches(a[:80], a) and not Q.overlap_reaches(a[:79], a)
    assert (Q.unpack_set(Q.pack_set(a)) == a).all()


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, **{k: 100 for k in range(100, 140)}}
