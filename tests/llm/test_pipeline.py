import random
import zlib

import corpus_pipeline as P
import numpy as np
import test_decontamination as leaks
import test_jaccard_join as near
import test_quality_rules as rules

from veritome.llm import packing, personal_data


def test_stages_equal_their_operators(spark, prose, tmp_path):
    item = prose(900, 30)
    leak = f"{prose(1, 80)} {item} {prose(2, 80)}"
    base = prose(3, 150)
    rows = [(1, base), (2, base + " more"), (3, "bad " * 60), (4, leak), (5, prose(5, 90) + " a.b@mail.org " + prose(6, 40)), (6, prose(7, 120)), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, now = [], docs
    for _, stage in P.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).cache()
        assert now.columns == docs.columns
        kept.append({r.doc_id: r for r in now.collect()})
    assert [sorted(k) for k in kept] == [[1, 2, 4, 5, 6], [1, 4, 5, 6], [1, 5, 6], [1, 5, 6]]
    assert "<EMAIL>" in kept[3][5].text and kept[3][5].n_chars == len(kept[3][5].text) and kept[3][1].text == base
    pieces = P.run(spark, str(tmp_path)).collect()
    encode = packing.encoder(packing.default_tokenizer())
    assert {r.doc_id: r.doc_tokens for r in pieces} == {i: len(encode(r.text)) + 1 for i, r in kept[3].items()}
    assert [name for name, _ in P.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "personal data", "packing"]


def brute(rows, items):
    """(id, text) after the first four stages, one after the other over all rows."""
    rows = [(i, t) for i, t in rows if rules.brute(t)["kept"]]
    least = {(i, n): c for i, n, c in near.brute(rows)}
    sets = dict(near.sets(rows))
    rows = [(i, t) for i, t in rows if least[i, len(sets[i])] == i]
    found = {d for d, _ in leaks.brute(rows, items)}
    rows = [(i, t) for i, t in rows if i not in found]
    tagger = personal_data.fit_texts([t for i, t in sorted(rows, key=lambda r: f"{r[0]},")])
    out = {}
    for i, text in rows:
        spans = sorted(personal_data.all_spans([text], tagger)[1][0], key=lambda s: (s[1], -s[2]))
        for kind, a, b in reversed([s for k, s in enumerate(spans) if all(s[1] >= e[2] for e in spans[:k])]):
            text = f"{text[:a]}<{kind.upper()}>{text[b:]}"
        out[i] = text
    return out


def test_pipeline_equals_brute_force(spark, prose, tmp_path):
    rnd = random.Random(11)
    items = [(k, prose(700 + k, 25)) for k in range(4)]
    rows = [(9000, None), (9001, ""), (9002, "few words")]
    for k in range(70):
        text = prose(k % 50, rnd.choice([15, 60, 150]))
        if k >= 50:  # near copies
            text += " " + prose(rnd.random(), 2)
        if rnd.random() < 0.15:
            text = (text + "\n") * 4
        if rnd.random() < 0.2:
            text += " " + items[k % 4][1] + " " + prose(rnd.random(), 20)
        if rnd.random() < 0.5:
            text += rnd.choice([" a.b@mail.org ", " 10.1.2.3 ", " +1 (928) 555-7876 ", " 4111 1111 1111 1111 "]) + prose(rnd.random(), 20)
        rows.append((rnd.randrange(10**6), text))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want, encode = brute(rows, items), packing.encoder(packing.default_tokenizer())
    pieces = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.doc_tokens for r in pieces} == {i: len(encode(t)) + 1 for i, t in want.items()}
    ids = {i: np.array([*encode(t), packing.END_ID], "<u4") for i, t in want.items()}
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) for r in pieces)  # so the texts are equal
    assert sum(r.length for r in pieces) == sum(map(len, ids.values())) and 20 < len(want) < 60
