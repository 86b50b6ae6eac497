"""Repetition coverage: which documents mostly repeat themselves.

Words are ``[^\\x20\\x09-\\x0D]+``.  Rolling hashes of several n-gram lengths
mark every word that lies in an n-gram found at least twice in its document; the
characters of the marked words against all word characters are the coverage.
The same is done for lines.  One pass, no shuffle, no state across documents.

Defined results: null and empty texts have zero counts and fail the base rule
(fewer than 20 words); every input row gives one row, repeated ids included; a
null id stays null; other input columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from veritome.llm import textkit as K

#: n-gram length -> most percent of word characters inside duplicated n-grams.
COVERAGE = {4: 40, 6: 35, 8: 30, 10: 30}
#: Most percent of word characters inside lines that occur more than once.
LINE_COVERAGE = 40
MIN_WORDS, BASE_WINDOW, BASE_PERCENT = 20, 8, 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
FIELDS = [
    ("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()),
    ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()),
    ("kept", T.BooleanType()), ("dup_line_chars", T.LongType()),
    *((f"dup_chars_{n}", T.LongType()) for n in COVERAGE),
]


def _twice(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key occurs at least twice, and whether it has occurred before."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    twice, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order[1:]] = same
    before[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, before


def _salt(rows: np.ndarray) -> np.ndarray:
    return K.mix(rows.astype(np.uint64) * K.U64(0x9E3779B97F4A7C15) + K.U64(1))


def measure(data: np.ndarray, offs: np.ndarray) -> dict:
    """All counts and the verdict for a run of documents."""
    n = len(offs) - 1
    starts, ends, rows = K.words(data, offs)
    prefix = K.Prefix(data)
    hashes = prefix.of(starts, ends)
    salt = _salt(np.arange(n))
    char = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=char[1:])
    chars = char[ends] - char[starts]
    total = np.bincount(rows, chars, n).astype(np.int64)
    n_words = np.bincount(rows, minlength=n)

    def covered(length: int) -> np.ndarray:
        h, at = K.grams(hashes, rows, length)
        hit, _ = _twice(h + salt[rows[at]])
        edge = np.zeros(len(rows) + 1, np.int64)
        edge[at[hit]] += 1
        np.add.at(edge, at[hit] + length, -1)
        return np.cumsum(edge[:-1]) > 0

    # Lines: ranges between line feeds and row edges, with the bytes as they are.
    feeds = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([offs[:-1], feeds + 1]), kind="stable")
    line_end = np.sort(np.concatenate([feeds, offs[1:]]), kind="stable")
    first_word = np.searchsorted(starts, line_start)
    last_word = np.searchsorted(starts, line_end)
    real = last_word > first_word
    line_start, line_end, first_word, last_word = line_start[real], line_end[real], first_word[real], last_word[real]
    line_row = rows[first_word] if len(rows) else np.empty(0, np.int64)
    twice, before = _twice(prefix.of(line_start, line_end) + salt[line_row])
    word_chars_before = np.concatenate([[0], np.cumsum(chars)])
    line_chars = word_chars_before[last_word] - word_chars_before[first_word]

    out = {
        "n_words": n_words, "word_chars": total, "n_symbols": K.per_row(_SYMBOL[data], offs),
        "n_dup_lines": np.bincount(line_row, before, n).astype(np.int64),
        "n_repeat_words": np.bincount(rows, covered(BASE_WINDOW), n).astype(np.int64),
        "dup_line_chars": np.bincount(line_row, line_chars * twice, n).astype(np.int64),
    }
    out["base_failed"] = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > BASE_PERCENT * n_words)
    good = ~out["base_failed"] & (100 * out["dup_line_chars"] <= LINE_COVERAGE * total)
    for length, most in COVERAGE.items():
        out[f"dup_chars_{length}"] = np.bincount(rows, chars * covered(length), n).astype(np.int64)
        good &= 100 * out[f"dup_chars_{length}"] <= most * total
    return out | {"kept": good}


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts, coverage per n-gram length, base verdict and verdict."""
    return K.map_documents(docs, measure, FIELDS, id_col, text_col)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text passes."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            data, offs = K.buffers(batch.column(at))
            good = [measure(part, o)["kept"] for _, _, part, o in K.slices(data, offs)]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _covered_sql(n: int) -> str:
    return f"""g{n} AS (SELECT r, i, count(*) OVER (PARTITION BY r, list_slice(w, i, i + {n - 1})) c
  FROM (SELECT r, w, unnest(range(1, len(w) - {n - 2})) i FROM t WHERE len(w) >= {n})),
c{n} AS (SELECT r, count(*) words, sum(length(w[i])) chars FROM (SELECT DISTINCT r, i + j AS i FROM g{n}, range({n}) x(j) WHERE c > 1) JOIN t USING (r) GROUP BY r)"""


ORACLE_SQL = f"""WITH d AS (SELECT row_number() OVER () r, doc_id, coalesce(text, '') text FROM documents),
t AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w FROM d),
b AS (SELECT r, doc_id, text, len(w) n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) word_chars FROM t),
l AS (SELECT r, line, list_sum(list_transform(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), lambda x: length(x))) chars
  FROM (SELECT r, unnest(string_split(text, chr(10))) line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
ld AS (SELECT r, sum(n - 1) dups, sum(CASE WHEN n > 1 THEN chars ELSE 0 END) chars FROM (SELECT r, line, count(*) n, sum(chars) chars FROM l GROUP BY ALL) GROUP BY r),
{", ".join(_covered_sql(n) for n in COVERAGE)},
m AS (SELECT b.doc_id, n_words, word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) n_symbols, coalesce(ld.dups, 0) n_dup_lines,
  coalesce(c{BASE_WINDOW}.words, 0) n_repeat_words, coalesce(ld.chars, 0) dup_line_chars, {", ".join(f"coalesce(c{n}.chars, 0) dup_chars_{n}" for n in COVERAGE)}
  FROM b LEFT JOIN ld USING (r) {" ".join(f"LEFT JOIN c{n} USING (r)" for n in COVERAGE)}),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT n_words, word_chars::BIGINT word_chars, n_symbols::BIGINT n_symbols, n_dup_lines::BIGINT n_dup_lines, n_repeat_words::BIGINT n_repeat_words,
  base_failed, NOT base_failed AND 100 * dup_line_chars <= {LINE_COVERAGE} * word_chars AND {" AND ".join(f"100 * dup_chars_{n} <= {p} * word_chars" for n, p in COVERAGE.items())} AS kept,
  dup_line_chars::BIGINT dup_line_chars, {", ".join(f"dup_chars_{n}::BIGINT dup_chars_{n}" for n in COVERAGE)} FROM v"""
