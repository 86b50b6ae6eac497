"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, A-Z lower-cased.  One pass over the corpus
counts how often each n-gram of a test item occurs.  The rarest 85 percent of an
item's n-grams are its seeds, so a passage that holds over 15 percent of them
holds a seed, however common the others are.  A second pass joins documents to
items on seeds and aligns the item with the words around them; the score is the
best local alignment over that of a perfect copy.

The test set is read in blocks of whole items, bounded by their number and
characters, and each block travels with the tasks; documents never move.  A document
of any length is aligned only around its seeds, and the counts cover all documents.

Defined results: null or empty texts and items match nothing; an item with fewer
than three words has itself as its only n-gram; each input row counts for itself,
repeated ids included; items with equal ids are scored apart, ids may be of any type.
Of equally good places the first is reported.  Other input columns are not read.

An edited copy is found if one run of three words survived: with every third word
replaced it scores about 0.5 and is not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritome.llm import textkit as K

GRAM, SEED_SHARE, LEAST_SCORE = 3, 0.85, 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Items and characters after which a block is full: some tens of megabytes of hashes.  Items are whole, so one may pass the latter.
BLOCK, BLOCK_CHARS = 20_000, 8_000_000

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def hashed_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = K.LOWER[data]
    starts, ends, rows = K.words(low, offs, _WORD)
    return K.Prefix(low).of(starts, ends), rows


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score and the half-open range of ``text`` words it covers."""
    n = len(text)
    above, start_above = np.zeros(n + 1, np.int64), np.arange(n + 1)
    column = np.arange(n + 1)
    best = (0, 0, 0)
    for word in item:
        score = np.zeros(n + 1, np.int64)
        start = column.copy()
        diagonal = above[:-1] + np.where(text == word, MATCH, MISMATCH)
        skip = above[1:] + GAP
        score[1:] = np.maximum(np.maximum(diagonal, skip), 0)
        start[1:] = np.where(score[1:] == 0, column[1:], np.where(score[1:] == diagonal, start_above[:-1], start_above[1:]))
        # A gap along the text: the running maximum of score + distance, carried right.
        lifted = score - GAP * column
        reach = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == reach, column, 0))
        through = reach + GAP * column
        start = np.where(through > score, start[source], start)
        score = np.maximum(score, through)
        top = int(score.argmax())
        if score[top] > best[0]:
            best = (int(score[top]), int(start[top]), top)
        above, start_above = score, start
    return best


class Block:
    """Test items with their n-gram hashes; seeds once the corpus counts are known."""

    def __init__(self, ids: list, texts: list[str]) -> None:
        data, offs = K.buffers(pa.array(texts, pa.string()))
        hashes, rows = hashed_words(data, offs)
        edges = np.searchsorted(rows, np.arange(len(texts) + 1))
        self.ids = ids
        self.items = [hashes[a:b] for a, b in zip(edges[:-1], edges[1:])]
        grams, owners = [], []
        for i, words in enumerate(self.items):
            if len(words):
                g = np.unique(K.grams(words, np.zeros(len(words), np.int64), min(GRAM, len(words)))[0])
                grams.append(g)
                owners.append(np.full(len(g), i))
        self.lengths = sorted({min(GRAM, len(w)) for w in self.items if len(w)})
        flat = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        owner = np.concatenate(owners) if owners else np.empty(0, np.int64)
        self._index(flat, owner)

    def _index(self, flat: np.ndarray, owner: np.ndarray) -> None:
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]
        self.keys = np.unique(flat)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.keys >> K.U64(42)] = True

    def keep_rarest(self, counts: dict[int, int]) -> None:
        """Leaves each item its rarest n-grams, by corpus count, then hash."""
        n = np.array([counts.get(k, 0) for k in self.flat.view(np.int64).tolist()], np.int64)
        order = np.lexsort((self.flat, n, self.owner))
        owner = self.owner[order]
        first = np.searchsorted(owner, owner)
        size = np.bincount(owner, minlength=len(self.items))[owner] if len(owner) else owner
        chosen = order[np.arange(len(owner)) - first < np.ceil(SEED_SHARE * size)]
        self._index(self.flat[chosen], self.owner[chosen])

    def hits(self, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key index, row and first word of each known n-gram of the rows."""
        found = []
        for n in self.lengths:
            g, at = K.grams(hashes, rows, n)
            maybe = np.flatnonzero(self.bits[g >> K.U64(42)])
            g, at = g[maybe], at[maybe]
            place = np.minimum(np.searchsorted(self.keys, g), max(0, len(self.keys) - 1))
            good = self.keys[place] == g if len(self.keys) else np.zeros(len(g), bool)
            found.append((place[good], at[good]))
        place, at = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
        return place, rows[at], at

    def matches(self, data: np.ndarray, offs: np.ndarray, least: float) -> list[tuple[int, int, float, int, int]]:
        """(row, item, score, first word, end word) of alignments that reach ``least``."""
        hashes, rows = hashed_words(data, offs)
        place, row, at = self.hits(hashes, rows)
        if not len(place):
            return []
        lo, hi = np.searchsorted(self.flat, self.keys[place]), np.searchsorted(self.flat, self.keys[place], "right")
        owner = self.owner[np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
        row, at = np.repeat(row, hi - lo), np.repeat(at, hi - lo)
        order = np.lexsort((at, owner, row))
        row, owner, at = row[order], owner[order], at[order]
        edges = np.searchsorted(rows, np.arange(len(offs)))
        cut = np.flatnonzero((np.diff(row) != 0) | (np.diff(owner) != 0)) + 1
        out = []
        for group in np.split(np.arange(len(row)), cut):
            r, item = int(row[group[0]]), int(owner[group[0]])
            words, begin, end = self.items[item], int(edges[row[group[0]]]), int(edges[row[group[0]] + 1])
            reach = 3 * len(words)  # no alignment above zero spans more text words: a gap takes half a match
            best, spots = (0, 0, 0), at[group]
            for part in np.split(spots, np.flatnonzero(np.diff(spots) > 2 * reach) + 1):
                a, b = max(begin, int(part[0]) - reach), min(end, int(part[-1]) + GRAM + reach)
                score, x, y = align(words, hashes[a:b])
                if score > best[0]:
                    best = (score, a + x - begin, a + y - begin)
            if best[0] >= least * MATCH * len(words):
                out.append((r, item, best[0] / (MATCH * len(words)), best[1], best[2]))
        return out


def blocks(items: DataFrame, id_col: str, text_col: str, size: int = BLOCK) -> Iterator[Block]:
    """The test set on the driver, block after block."""
    table = items.select(items[id_col].alias("i"), items[text_col].alias("t")).where(F.length("t") > 0)
    ids, texts, chars = [], [], 0
    for row in table.toLocalIterator():
        ids.append(row.i)
        texts.append(row.t)
        chars += len(row.t)
        if len(ids) == size or chars >= BLOCK_CHARS:
            yield Block(ids, texts)
            ids, texts, chars = [], [], 0
    if ids:
        yield Block(ids, texts)


def seed(docs: DataFrame, block: Block, text_col: str) -> Block:
    """Counts the block's n-grams over all documents and keeps each item's rarest."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        here, total = shared.value, np.zeros(len(shared.value.keys), np.int64)
        for batch in batches:
            data, offs = K.buffers(batch.column(0))
            for _, _, part, at in K.slices(data, offs):
                place, _, _ = here.hits(*hashed_words(part, at))
                total += np.bincount(place, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(here.keys[some].view(np.int64)), pa.array(total[some])], names=["key", "n"])

    counted = docs.select(docs[text_col].cast("string")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    block.keep_rarest({r.key: r.n for r in counted.collect()})  # at most one row an n-gram of the block
    return block


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """(doc id, item id, score, first_word, end_word) of every document and item that align well enough."""
    spark = docs.sparkSession
    narrow = docs.select(docs[id_col], docs[text_col].cast("string").alias("__text"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("item_id", items.schema[item_id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType())])
    out = spark.createDataFrame([], schema)
    for block in blocks(items, item_id_col, item_text_col):
        shared = spark.sparkContext.broadcast(seed(docs, block, text_col))

        def run(batches, shared=shared):
            from pyspark.sql.pandas.types import to_arrow_type

            here, kind = shared.value, to_arrow_type(schema["item_id"].dataType)
            for batch in batches:
                data, offs = K.buffers(batch.column(1))
                for lo, _, part, at in K.slices(data, offs):
                    if found := here.matches(part, at, least):
                        row, item, score, a, b = zip(*found)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([lo + r for r in row])), pa.array([here.ids[i] for i in item], kind), pa.array(score), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=schema.names)

        out = out.unionByName(narrow.mapInArrow(run, schema))
    return out


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns, that align with no test item."""
    place = docs.columns.index(text_col)
    out = docs
    for block in blocks(items, item_id_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(seed(docs, block, text_col))

        def run(batches, shared=shared):
            for batch in batches:
                data, offs = K.buffers(batch.column(place))
                clean = np.ones(batch.num_rows, bool)
                for lo, _, part, at in K.slices(data, offs):
                    for row, *_ in shared.value.matches(part, at, least):
                        clean[lo + row] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
