import hashlib
import random
import re

import numpy as np
from conftest_llm import ODD, documents

from veritome.llm import personal_data as Q
from veritome.llm.sequence_tagger import Tagger

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and Q.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_exact_spans_equal_the_patterns():
    rnd = random.Random(1)
    for _ in range(4000):
        text = "".join(rnd.choice("012 @.-+a(é\n") for _ in range(rnd.randrange(45)))
        assert Q.exact_spans(text) == brute(text), text
    assert Q.luhn("4111111111111111") and not Q.luhn("4111111111111112")


def test_gradients():
    t = Tagger(3, 4, 3)
    rng = np.random.default_rng(0)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    t.p["move"] = rng.standard_normal((3, 3))
    x, y = rng.integers(1, 129, (4, 6)), rng.integers(0, 3, (4, 6))
    _, grad = t.loss(x, y)
    for k in grad:
        for _ in range(4):
            i = (int(x.flat[0]), 1) if k == "embed" else tuple(rng.integers(0, n) for n in t.p[k].shape)
            old, step = t.p[k][i], 1e-3
            t.p[k][i] = old + step
            up = t.loss(x, y)[0]
            t.p[k][i] = old - step
            down = t.loss(x, y)[0]
            t.p[k][i] = old
            assert abs((up - down) / (2 * step) - grad[k][i]) < 1e-2 * (1e-2 + abs(grad[k][i]))


def test_spans_redaction_and_odd_rows(spark, prose):
    rows = ODD + [(10, f"{prose(1)} write a.b@mail.org or +1 (928) 555-7876, 10.0.0.1 4111 1111 1111 1111"), (11, prose(2, 3000) + " call (415) 555-2671 please " + prose(3))]
    docs = documents(spark, rows)
    tagger = Q.fit(docs)
    got = Q.personal_data(docs, tagger).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, text in rows:
        base = brute(text)
        assert by[i].base_sha256 == hashlib.sha256(Q.joined(base).encode()).hexdigest()
        assert set(Q.joined(base).split(",")) <= set(by[i].spans.split(",")) or not base
        for k in Q.KINDS:
            assert by[i][f"n_{k}"] == sum(s[0] == k for s in base)
    text = rows[-1][1]
    at = text.index("(415)")
    assert f"phone:{at}:{at + 14}" in by[11].spans  # found by the tagger alone
    clean = {r.doc_id: r.text for r in Q.redact(docs, tagger).collect()}
    assert clean[1] is None and clean[2] == "" and "555" not in clean[10] + clean[11] and "<EMAIL>" in clean[10]
    assert Q.personal_data(documents(spark, []), Q.fit(documents(spark, []))).collect() == []


def test_spans_do_not_depend_on_which_windows_are_decoded(spark, prose, monkeypatch):
    tagger = Q.fit(documents(spark, [(k, prose(k, 80)) for k in range(20)]))
    rnd = random.Random(3)
    items = ["x" * 150 + " @ mail.org", "(415) 555-2671", "a.b @ c.de", "call 415 555 2671 now", "10.0.0.1", "4111 1111 1111 1111", "no digits"]
    texts = [" ".join(f"{prose(rnd.random(), rnd.randrange(40))} {rnd.choice(items)}" for _ in range(5)) + " " + prose(rnd.random(), 50) for _ in range(40)] + ["", "@", "1", " 1 ", "é" * 70 + "1" + "é" * 70]
    some = Q.all_spans(texts, tagger)
    monkeypatch.setattr(Q, "_near_trigger", lambda points: np.ones(len(points), bool))
    assert some == Q.all_spans(texts, tagger)


def test_training_texts_are_whole(spark, prose):
    late = prose(1, 9000) + " late.person@mail.org"
    seen: list = []
    real = Q.training_set
    Q.training_set = lambda texts: seen.extend(texts) or real(texts)
    try:
        Q.fit(documents(spark, [(1, late)]))
    finally:
        Q.training_set = real
    assert seen == [late] and len(late) > 20_000
