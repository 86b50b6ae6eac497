from collections import Counter

from conftest_llm import ODD, documents, words

from veritome.llm import quality_rules as Q


def brute(text):
    text = text or ""
    w = words(text)
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text)}

    def covered(n):
        grams = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        hit = set()
        for i in range(len(w) - n + 1):
            if grams[tuple(w[i : i + n])] > 1:
                hit.update(range(i, i + n))
        return hit

    lines = [x for x in text.split("\n") if words(x)]
    count = Counter(lines)
    out["n_dup_lines"] = len(lines) - len(count)
    out["n_repeat_words"] = len(covered(8))
    out["dup_line_chars"] = sum(sum(map(len, words(x))) for x in lines if count[x] > 1)
    out["base_failed"] = len(w) < 20 or 100 * out["n_repeat_words"] > 30 * len(w)
    good = not out["base_failed"] and 100 * out["dup_line_chars"] <= Q.LINE_COVERAGE * out["word_chars"]
    for n, most in Q.COVERAGE.items():
        out[f"dup_chars_{n}"] = sum(len(w[i]) for i in covered(n))
        good &= 100 * out[f"dup_chars_{n}"] <= most * out["word_chars"]
    return out | {"kept": good}


def test_equals_brute_force(spark, prose):
    a, b = prose(1), prose(2, 40)
    rows = ODD + [(10, a), (11, f"{b}\n{b}\n{a}"), (12, "x y " * 60), (13, a + "\r\n# * $\n\n" + a[:200]), (14, "\n".join([prose(3, 9)] * 9)), (15, "w " * 30000), (16, prose(4, 21))]
    got = Q.quality_rules(documents(spark, rows)).collect()
    want = sorted([{"doc_id": i, **brute(t)} for i, t in rows], key=str)
    assert sorted([r.asDict() for r in got], key=str) == [dict(sorted(w.items(), key=lambda kv: list(got[0].asDict()).index(kv[0]))) for w in want] or sorted([sorted(r.asDict().items(), key=str) for r in got], key=str) == sorted([sorted(w.items(), key=str) for w in want], key=str)


def test_filter_and_empty_table(spark, prose):
    docs = documents(spark, [(1, prose(1)), (2, "bad " * 50), (3, None)])
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]
    assert Q.quality_rules(documents(spark, [])).collect() == []
