import math
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from conftest_llm import ODD, documents, lower, words

from veritome.llm import lm_scoring as Q


def test_equals_brute_force(spark, prose, monkeypatch):
    monkeypatch.setattr(Q, "RESOLUTION", 700)  # few broadcast strings and words, so that all paths are met
    rows = ODD + [(10 + k, prose(k, 150)) for k in range(12)] + [(99, "x " * 500)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [t or "" for i, t in rows if not held(i)]
    count = Counter(w for t in train for w in [*words(lower(t)), None])
    n, v = sum(count.values()), len(count)
    grams = [defaultdict(Counter) for _ in range(4)]
    total = 0
    for t in train:
        x = b"\xff" * 3 + t.encode() + b"\xff"
        for p in range(3, len(x)):
            total += 1
            for k in range(4):
                grams[k][x[p - k : p]][x[p]] += 1
    assert total > 5 * 700  # so rare strings are joined, and none is left out

    @lru_cache(None)
    def dist(ctx):
        shorter = dist(ctx[1:]) if ctx else np.full(256, 1 / 256)
        seen = grams[len(ctx)].get(ctx)
        if not seen:
            return shorter
        p, size, kinds = shorter.copy(), sum(seen.values()), len(seen)
        p[list(seen)] = 0
        left = p.sum()
        p *= kinds / (size + kinds) / left
        for s, q in seen.items():
            p[s] = q / (size + kinds)
        return p

    assert all(abs(dist(c).sum() - 1) < 1e-9 for c in grams[3])
    got = Q.lm_scores(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        tokens, x = [*words(lower(t or "")), None], b"\xff" * 3 + (t or "").encode() + b"\xff"
        assert (by[i].held_out, by[i].n_tokens, by[i].n_known, by[i].train_tokens) == (held(i), len(tokens), sum(count[w] > 0 for w in tokens), n)
        assert by[i].base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens))
        assert by[i].score == pytest.approx(sum(math.log10(dist(x[p - 3 : p])[x[p]]) for p in range(3, len(x))), rel=1e-5)


def test_empty_tables(spark):
    assert Q.lm_scores(documents(spark, [])).collect() == []
    only_held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = Q.lm_scores(documents(spark, [(only_held, "ab")])).first()
    assert (row.n_known, row.train_tokens) == (0, 0) and row.score == pytest.approx(3 * math.log10(1 / 256))


def test_a_string_seen_once_counts(spark, prose, monkeypatch):
    train = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = [(i, prose(i, 120)) for i in train[:30]] + [(train[30], "日本 🙂 qzjx")] + [(train[31], "é" * 90_000)]
    scores = []
    for resolution in (1 << 20, 500):
        monkeypatch.setattr(Q, "RESOLUTION", resolution)
        scores.append([r.score for r in sorted(Q.lm_scores(documents(spark, rows)).collect(), key=lambda r: r.doc_id)])
    assert scores[0] == pytest.approx(scores[1], rel=1e-6)
