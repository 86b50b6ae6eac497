import zlib

import numpy as np
from conftest_llm import ODD, documents

from veritome.llm import packing as Q


def test_round_trip(spark, prose):
    rows = ODD + [(10 + k, prose(k % 4, 400)) for k in range(20)] + [(99, "x<|endoftext|>y"), (100, prose(9, 6000))]
    encode = Q.encoder(Q.default_tokenizer())
    got = sorted(Q.pack(documents(spark, rows), Q.default_tokenizer()).collect(), key=lambda r: (r.sequence_id, r.offset))
    ids = lambda t: np.array(encode.exact.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
    want: dict = {}
    for i, t in rows:
        want.setdefault(i, []).append(ids(t))
    sequences: dict = {}
    for r in got:
        one = want[r.doc_id][0]
        assert r.doc_tokens == len(one) and r.ids_crc32 == zlib.crc32(one[r.start : r.start + r.length].tobytes())
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert sum(r.length for r in got) == sum(len(x) for v in want.values() for x in v)
    assert all(n == Q.LENGTH for s, n in sequences.items() if s < max(sequences)) and sorted(sequences) == list(range(len(sequences)))
    assert Q.pack(documents(spark, []), Q.default_tokenizer()).collect() == []


def test_ids_equal_the_tokenizer():
    encode = Q.encoder(Q.default_tokenizer())
    for text in ("", "  \n\n x  ", "don't ’s ÉÀ 日本語 🙂 \0 123４٣", "\r\n\t  a", "x" * 3000, "a<|endoftext|>b", "�\u2028z"):
        assert encode(text) == encode.exact.encode(text, add_special_tokens=False).ids


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 4), (3, 2), (4, 2)):
        points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        keys = Q.hilbert(points, bits)
        assert sorted(keys) == list(range(len(points)))
        assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_only_plain_files_take_the_fast_way(tmp_path):
    import json

    spec = json.load(open(Q.default_tokenizer()))
    assert Q.encoder(Q.default_tokenizer()).fast is not None
    text = "don't  stop 123 \u00e9\u00e8 <|endoftext|> x"
    for number, change in enumerate([{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"pre_tokenizer": {"type": "Whitespace"}}]):
        path = tmp_path / f"{number}.json"
        path.write_text(json.dumps(spec | change))
        encode = Q.encoder(str(path))
        assert encode.fast is None and encode(text) == encode.exact.encode(text, add_special_tokens=False).ids


def test_documents_follow_the_curve(spark, prose):
    rows = [(k, prose(k % 7, 60 + k)) for k in range(60)]
    got = Q.pack(documents(spark, rows), Q.default_tokenizer()).collect()
    encode = Q.encoder(Q.default_tokenizer())
    ids = [np.array(encode(t) + [Q.END_ID], np.uint32) for _, t in rows]
    keys = Q.curve_keys(np.concatenate(ids), np.array([len(x) for x in ids]))
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    assert [keys[d] for d in order] == sorted(keys.tolist())
