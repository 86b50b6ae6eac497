import random

import numpy as np
from conftest_llm import ODD, documents, sha

from veritome.llm import induced_sort as I
from veritome.llm import repeats
from veritome.llm import suffix_dedup as Q


def brute(rows):
    first: dict = {}
    rank = lambda d: Q.LAST if d is None else d
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - 49):
            first[raw[i : i + 50]] = min(first.get(raw[i : i + 50], Q.LAST), rank(d))
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if first[raw[i : i + 50]] < rank(d):
                gone[i : i + 50] = b"\1" * 50
        runs = sum(1 for i in range(len(raw)) if gone[i] and (not i or not gone[i - 1]))
        out.append((d, len(raw), sum(gone), runs, sha(bytes(x for x, y in zip(raw, gone) if not y))))
    return sorted(out, key=str)


def check(spark, rows):
    assert sorted(map(tuple, Q.suffix_dedup(documents(spark, rows).repartition(3)).collect()), key=str) == brute(rows)


def test_equals_brute_force(spark, prose):
    base = prose(1, 200)
    check(spark, [])
    check(spark, ODD + [
        (15, base), (12, base[100:300]), (12, base[100:300]), (None, "x" + base[50:150]), (18, base[:49]), (13, "a" * 300), (14, "a" * 120), (19, "ab" * 200 + base[200:260]), (12, "other " + base[:60]),
        (20, base), (21, base[:180] + "Z" + base[181:]), (22, prose(2) + base[300:360] + prose(3)), (23, "é" * 60 + base[10:90]),
    ])


def test_pieces_of_long_texts(spark, prose, monkeypatch):
    long = prose(1, 900)
    monkeypatch.setattr(Q, "PIECE", 500)
    parts = list(Q.pieces(np.frombuffer(long.encode(), np.uint8), np.array([0, len(long)])))
    seen = sorted(a + int(s) + k for _, a, part, at in parts for s, e, *_ in zip(*Q.segments(part, at)) for k in range(int(e - s) - 49))
    assert len(parts) > 3 and seen == list(range(len(long) - 49))


def sort(strings, memory):
    """Descending (suffix, common prefix) of the strings, and what the sort did."""
    raw, got, work = b"\xff" + b"".join(s + b"\xff" for s in strings), [], I.Work(memory)
    I.sort_suffixes(np.frombuffer(raw + bytes(I.PAD), np.uint8), lambda p, c: got.extend(zip(p.tolist(), c.tolist())), work)
    assert sorted(p for p, _ in got) == [i for i, x in enumerate(raw) if x != 0xFF]
    return [(raw[p : raw.index(b"\xff", p)], c) for p, c in got], work


def common(a, b):
    k = 0
    while k < min(len(a), len(b), I.CAP) and a[k] == b[k]:
        k += 1
    return k


def check_order(got):
    for (a, _), (b, shared) in zip(got, got[1:]):
        k = common(a, b)
        assert a >= b and (shared == k if k < min(len(a), len(b)) else shared >= k)


def test_suffix_order_and_common_prefixes():
    rnd, levels = random.Random(4), 0
    for _ in range(250):
        m = rnd.choice([1, 2, 3, 8, 200])
        strings = [bytes(rnd.randrange(m) + 20 for _ in range(rnd.randrange(1, 40))) * rnd.choice([1, 1, 3]) for _ in range(rnd.choice([1, 1, 3, 20]))]
        got, work = sort(strings + strings[: rnd.choice([0, 2])], rnd.choice([0, 64, 1 << 20]))
        check_order(got)
        levels = max(levels, work.levels)
    assert levels >= 4


def test_a_shard_far_larger_than_memory(prose):
    strings = [prose(i % 60, 400)[7 * i % 90 :][:80].encode() for i in range(900)]
    got, work = sort(strings, 16384)
    size = sum(map(len, strings))
    assert size > 4 * work.memory and work.spilled > size and work.levels >= 3
    check_order(got)
    assert got == sort(strings, 1 << 26)[0] and sort(strings, 1 << 26)[1].spilled == 0


def test_shard_equals_brute_force(prose, monkeypatch):
    monkeypatch.setattr(Q, "BLOCK", 7)
    rnd, shard, held = random.Random(2), Q.Shard(I.Work(2048)), []
    texts = [prose(i, 30).encode()[:110] for i in range(5)]
    for blob in range(6):
        part = [(rnd.randrange(9), (t := rnd.choice(texts))[(a := rnd.randrange(30)) : a + rnd.randint(50, 80)]) for _ in range(25)]
        part = list({s: (d, s) for d, s in part}.values())
        held += [(d, 1000 * blob + k, s) for k, (d, s) in enumerate(part)]
        arrays = {"length": [len(s) for _, s in part], "places": [1] * len(part), "document": range(len(part)), "start": [1000 * blob + k for k in range(len(part))], "rank": [d for d, _ in part], "hash": [0] * len(part)}
        shard.add(Q._encode({k: np.array(v) for k, v in arrays.items()} | {"bytes": np.frombuffer(b"".join(s for _, s in part), np.uint8)}))
    least: dict = {}
    for d, _, s in held:
        for i in range(len(s) - 49):
            least[s[i : i + 50]] = min(least.get(s[i : i + 50], d), d)
    want = {(d, at + i + k) for d, at, s in held for i in range(len(s) - 49) if least[s[i : i + 50]] < d for k in range(50)}
    got = {(r["rank"], x) for batch in shard.spans() for r in batch.to_pylist() for x in range(r["start"], r["end"])}
    assert got == want and shard.work.spilled


def test_equal_hashes_of_different_bytes_stay_apart():
    data = np.frombuffer(b"aaabbbaaaccc", np.uint8)
    at, length = np.arange(0, 12, 3), np.full(4, 3)
    order, new = Q._alike(data, at, length, np.full(4, 9, np.uint64), np.array([4, 3, 2, 1]))
    groups = sorted(sorted(data[at[i] : at[i] + 3].tobytes() for i in g) for g in np.split(order, np.flatnonzero(new)[1:]))
    assert all(len(set(g)) == 1 for g in groups)


def test_the_largest_id(spark, prose):
    base = prose(1, 40)
    rows = [(Q.LAST, base), (3, base), (None, "x"), (Q.LAST, "y")]
    check(spark, rows)


def blob(rank, text, start):
    arrays = {"length": [len(text)], "places": [1], "document": [0], "start": [start], "rank": [rank], "hash": [rank]}
    return Q._encode({k: np.array(v) for k, v in arrays.items()} | {"bytes": np.frombuffer(text, np.uint8)})


def test_equal_strings_of_many_tasks_are_induced_once(prose):
    text, shard = prose(1).encode()[:70], Q.Shard()
    for rank in [5, 3, 9, 3, 7, 11]:
        shard.add(blob(rank, text, 10 * rank))
    shard.add(blob(1, text[:60], 0))
    got = sorted((r["rank"], r["start"], r["end"]) for batch in shard.spans() for r in batch.to_pylist())
    assert got == [(3, 30, 90), (5, 50, 120), (7, 70, 140), (9, 90, 160), (11, 110, 180)]
    assert shard.length.size == 2


def test_more_repeated_keys_than_one_filter_holds(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BITS", (1 << 10, 1 << 13))
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 10000).astype(np.uint64))
    many, others = keys[::2], keys[1::2]
    table = spark.createDataFrame([(int(b.column(0)[i].as_py()), b.column(1)[i].as_py()) for x, y in ((many, True), (others, False)) for b in repeats.by_shard(np.sort(x), np.full(len(x), y), 24) for i in range(b.num_rows)], repeats.SHARD_SCHEMA)
    found = repeats.repeated_blocks(table, 24)
    assert len(found.parts) == 8 and found.passes(many).all() and found.passes(others).mean() < 0.1
    assert repeats.repeated_filter(table).passes(others).mean() > 0.5  # one filter of that size is full
