import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritome.errors import EvidenceError
from veritome.functions import fulltext, regex, utf8, vectors
from veritome.sources.chunk import chunk_lines, chunk_spans


def test_trim_column_matches_python(spark):
    texts = ["ééééé", "a😀", "", "abc", "日本語x", "é" * 9, "x" * 30]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for most in (0, 1, 2, 3, 4, 5, 9, 64):
        got = [r[0] for r in rows.select(utf8.trim_column(F.col("t"), most)).collect()]
        assert got == [utf8.trim(t, most) for t in texts]


def test_byte_slice(spark):
    row = spark.createDataFrame([("é́x日", 2, 5)], "s string, a int, b int").select(utf8.byte_slice(F.col("s"), F.col("a"), F.col("b")))
    assert row.first()[0] == "é́x日".encode()[2:5].decode()


REGEX = [
    ("a.b", "a\nb", True), ("^b", "a\nb", False), ("a$", "a\n", False), ("a$", "xa", True), ("[[:digit:]]+x", "12x", True), ("[^[:alpha:]]", "abc", False), (r"\mfoo\M", "a foo b", True), (r"\mfoo\M", "afoo", False),
    ("[]x]", "]", True), ("[a&&b]", "&", True), (r"\$", "$", True),
    (r"^\w$", "é", True), (r"\mé\M", "a é b", True), (r"\mb", "éb", False), (r"\yéa\y", "x éa", True), (r"^\d$", "٣", True), (r"\D", "٣", False), ("^[[:punct:]]$", "»", True), ("^[[:punct:]]$", "+", True), (r"^\s$", "\u2003", True), ("^[[:word:]]+$", "né_1", True),
]


def test_regex_dialect(spark):
    for pattern, text, want in REGEX:
        java = regex.checked(spark, pattern, False)
        assert spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(java)).first()[0] is want, (pattern, text)
    assert spark.createDataFrame([("ÉCLAIR",)], "t string").select(F.col("t").rlike(regex.checked(spark, "éclair", True))).first()[0]
    for bad in ("(", "[", "[[:nope:]]", "a{2,1}"):
        with pytest.raises(EvidenceError) as got:
            regex.checked(spark, bad, False)
        assert got.value.sqlstate == "2201B"


def test_lexical_queries(spark):
    texts = ["the quick brown fox", "quick the fox", "brown bear", "fox quick", "foo-bar baz"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("w", fulltext.tokens(F.col("t")))

    def hits(query, syntax):
        tree = fulltext.parse(query, syntax)
        return [r[0] for r in rows.where(fulltext.matches(tree, F.col("w"))).orderBy("i").select("i").collect()]

    assert hits("quick FOX", "plain") == [0, 1, 3]
    assert hits("quick brown", "phrase") == [0]
    assert hits('"quick brown" or bear', "websearch") == [0, 2]
    assert hits("quick -brown", "websearch") == [1, 3]
    assert hits("foo-bar", "websearch") == [4]
    assert hits("...", "plain") == [] and fulltext.parse("  ", "phrase") is None


def test_cover_density():
    rank = lambda q, t, s="plain": round(fulltext.cover_density(fulltext.parse(q, s), fulltext.split_tokens(t)), 6)
    assert rank("a", "a b a") == 0.2
    assert rank("a b", "a b") == 0.1
    assert rank("a b", "a x x b") == round(0.1 / 3, 6)
    assert rank("a b", "a a b a") == 0.2  # the second a with b, and b with the third a
    assert rank("a b", "a x a b", "phrase") == 0.1
    assert rank("a or b", "a x b", "websearch") == 0.2


def test_rank_column_agrees_with_python(spark):
    texts = ["x y x", "y y x z x", "x", "z y x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("w", fulltext.tokens(F.col("t")))
    for query in ("x", "x y", "x or z"):
        tree = fulltext.parse(query, "websearch")
        got = rows.where(fulltext.matches(tree, F.col("w"))).select("t", fulltext.rank(tree, F.col("w"))).collect()
        assert got and all(r[1] == pytest.approx(fulltext.cover_density(tree, r[0].split()), rel=1e-6) for r in got)


def test_cosine(spark):
    row = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0])], "a array<float>, b array<float>")
    d = vectors.cosine_distance
    assert row.select(d(F.col("a"), F.col("b")), d(F.col("a"), F.col("a"))).first()[:] == (1.0, 0.0)


def test_chunks(spark):
    for text in ("", "a\nbb\nccc\n", "x" * 25, "é" * 11 + "\nab\n", "\n\n\n", "ab\n" * 9 + "tail"):
        raw = text.encode()
        for most in (4, 5, 9, 100):
            spans = chunk_spans(raw, most)
            assert b"".join(raw[a:b] for a, b in spans) == raw
            assert all(0 < b - a <= most for a, b in spans)
            for a, b in spans:
                raw[a:b].decode()
            for (a, b), (_, d) in zip(spans, spans[1:]):  # a cut is at a line end, or the line was too long
                assert raw[b - 1 : b] == b"\n" or raw.find(b"\n", b) + 1 - raw.rfind(b"\n", 0, b) - 1 > most or raw.find(b"\n", b) < 0
    got = chunk_lines(spark.createDataFrame([(1, "a\nb"), (2, None), (3, "")], "doc_id long, text string"), 4).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 3)]


def test_rank_in_the_jvm_equals_cover_density(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 25))) for _ in range(60)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("w", fulltext.tokens(F.col("t")))
    for query, syntax, plain in (("a", "plain", True), ("a b", "plain", True), ("a a", "plain", False), ("a b c", "plain", False), ("a b", "phrase", True), ("a a", "phrase", True), ("a b a", "phrase", True), ('"a b" or c', "websearch", True), ('"a b" or b', "websearch", False), ("a b -c", "websearch", True), ("a or b or c -d", "websearch", True)):
        tree = fulltext.parse(query, syntax)
        assert (fulltext._plain_rank(fulltext._positive(tree), F.col("w")) is not None) is plain
        got = rows.where(fulltext.matches(tree, F.col("w"))).select("t", fulltext.rank(tree, F.col("w")).alias("r")).collect()
        assert got
        for r in got:
            assert r.r == pytest.approx(fulltext.cover_density(tree, r.t.split()), rel=1e-6), (query, r.t)


def test_chunks_end_with_lines():
    assert chunk_spans(b"a\rb\r\nc\n", 4) == [(0, 2), (2, 5), (5, 7)]
    assert chunk_spans(b"ab\r\ncd", 4) == [(0, 4), (4, 6)] and chunk_spans(b"abc\r\nd", 4) == [(0, 4), (4, 6)]
    assert chunk_spans("ééé\nx".encode(), 5) == [(0, 4), (4, 8)] and chunk_spans(b"", 4) == []


@given(st.text(st.sampled_from("a\r\né😀"), max_size=60), st.integers(4, 12))
def test_chunks_are_as_long_as_they_can_be(text, most):
    raw = text.encode()
    spans = chunk_spans(raw, most)
    ends = [sum(map(len, raw.splitlines(keepends=True)[:k])) for k in range(1, len(raw.splitlines()) + 1)]
    assert b"".join(raw[a:b] for a, b in spans) == raw
    for a, b in spans:
        assert 0 < b - a <= most and raw[a:b].decode() is not None
        fitting = [e for e in ends if a < e <= a + most]
        assert b == fitting[-1] if fitting else b + 4 > a + most


def test_chunks_leave_a_batch_in_pieces():
    import pyarrow as pa

    from veritome.sources import chunk

    texts = ["x\n" * 200_000, None, "", "é\n", "ab\n" * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts)], ["i", "t"])
    made = list(chunk.chunked(iter([batch]), 4, ["doc_id", "chunk", "start_byte", "end_byte"]))
    assert len(made) > 5 and max(b.num_rows for b in made) < 2 * chunk.CHUNK_ROWS
    want = [(i, k, a, b) for i, text in enumerate(texts) for k, (a, b) in enumerate(chunk_spans((text or "").encode(), 4))]
    assert [tuple(r.values()) for b in made for r in b.to_pylist()] == want
