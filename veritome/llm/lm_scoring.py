"""Prediction by partial matching over byte contexts, and a unigram base score.

Training rows give counts of byte strings of length four (three bytes of context
and the byte that follows; 0xFF, which UTF-8 never uses, pads the start and marks
the end) and of words.  Counts of all training rows are summed by a shuffle after
each task has summed its own.

The trie has orders 3 to 0.  A context that saw a byte c times, n bytes in all
and d different ones gives it c / (n + d); the rest, d / (n + d), is the escape
(method C) to the context one byte shorter.  Exclusion: bytes seen in the longer
context cannot follow an escape, so their share of the shorter context's
distribution goes to the others.  Below order 0 all 256 bytes are equally likely.
The probabilities of all continuations of any context add up to one.  The trie holds
every trained string.  Tables that travel are bounded: contexts have at most three
bytes, and only strings that hold 2**-20 of the training bytes go along; all other
occurrences are joined with their exact value.

Base score: words seen at least 2**-20 of all tokens (at most 2**20 of them) are
scored in the same pass; every other occurrence is joined with its exact count.

Defined results: a null or empty text is the end alone; every input row gives one
row, repeated ids included; a null id is a training row; without training rows all
bytes are equally likely and no word is known.  Other input columns are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritome.llm import scratch
from veritome.llm import textkit as K
from veritome.llm.compression import remainder

MODULUS, HELD_OUT = 7, 2
END = 0xFF
#: Strings and words that are less than this part of all training bytes or tokens are joined, not broadcast.
RESOLUTION = 1 << 20
#: Keys that a task holds before it hands on what it has summed.
FLUSH_KEYS = 1 << 21
BYTES, WORDS, ENDS = 0, 1, 2

_tables: dict[str, object] = {}


def framed(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with three marks before and one after each row; positions to predict; offsets of rows in these."""
    n, lens = len(offs) - 1, np.diff(offs)
    out = np.full(len(data) + 4 * n, END, np.uint8)
    row = np.repeat(np.arange(n), lens)
    out[np.arange(len(data)) + 4 * row + 3] = data
    real = np.ones(len(out), bool)
    begins = offs[:-1] + 4 * np.arange(n)
    for k in range(3):
        real[begins + k] = False
    return out, np.flatnonzero(real), offs + np.arange(n + 1)


def strings4(framed_bytes: np.ndarray, at: np.ndarray) -> np.ndarray:
    a = framed_bytes.astype(np.uint32)
    return (a[at - 3] << np.uint32(24)) | (a[at - 2] << np.uint32(16)) | (a[at - 1] << np.uint32(8)) | a[at]


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word, A-Z lower-cased."""
    low = K.LOWER[data]
    starts, ends, rows = K.words(low, offs)
    return K.Prefix(low).of(starts, ends), rows


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    keys, back = np.unique(keys, return_inverse=True)
    return keys, np.bincount(back, counts, len(keys)).astype(np.int64)


def counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(kind, key, n): byte strings, words and ends of the training rows."""
    train = docs.where(F.coalesce(remainder(docs[id_col], MODULUS) != HELD_OUT, F.lit(True))).select(docs[text_col].cast("string").alias("t"))

    def run(batches):
        held: dict[int, list] = {BYTES: [], WORDS: []}
        ends = 0

        def flush():
            for kind, parts in held.items():
                if parts:
                    keys, n = _merge(parts)
                    for lo in range(0, len(keys), 1 << 16):
                        k = keys[lo : lo + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.astype(np.uint64).view(np.int64)), pa.array(n[lo : lo + (1 << 16)])], names=["kind", "key", "n"])
                    parts.clear()

        for batch in batches:
            data, offs = K.buffers(batch.column(0))
            ends += len(offs) - 1
            for _, _, part, at in K.slices(data, offs):
                frame, where, _ = framed(part, at)
                held[BYTES].append(np.unique(strings4(frame, where), return_counts=True))
                held[WORDS].append(np.unique(word_hashes(part, at)[0], return_counts=True))
                for kind, parts in held.items():
                    if len(parts) > 1 and sum(len(k) for k, _ in parts[1:]) > max(1 << 18, len(parts[0][0])):
                        parts[:] = [_merge(parts)]
                if sum(len(k) for parts in held.values() for k, _ in parts) > FLUSH_KEYS:
                    yield from flush()
        yield from flush()
        yield pa.RecordBatch.from_arrays([pa.array([ENDS], pa.int32()), pa.array([0], pa.int64()), pa.array([ends], pa.int64())], names=["kind", "key", "n"])

    return train.mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in an ascending table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    place = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return place, table[place] == keys


class Top:
    """Contexts of three bytes with size (occurrences and kinds) and escape, and the frequent strings."""

    def __init__(self, contexts: np.ndarray, total: np.ndarray, kinds: np.ndarray, shorter: np.ndarray, keys: np.ndarray, n: np.ndarray) -> None:
        self.contexts, self.size = contexts.astype(np.uint32), total + kinds
        self.escape = np.log10(kinds / self.size / np.maximum(1 - shorter, 1e-12)).astype(np.float32)
        self.keys = keys.astype(np.uint32)
        self.hits = np.log10(n / self.size[find(contexts, keys >> 8)[0]]).astype(np.float32) if len(keys) else np.empty(0, np.float32)


class Trie:
    """Log10 probabilities from the counts of strings of length three and less."""

    def __init__(self, keys3: np.ndarray, n3: np.ndarray, n2: np.ndarray) -> None:
        self.given = keys3, n3, n2

    def build(self) -> None:
        keys3, n3, n2 = self.given
        uniform = np.full(256, 1 / 256)
        zero = self._level(np.zeros(256, np.int64), np.arange(256), n2.sum(0).astype(float), uniform[None, :], 1)[0]
        one = self._level(np.repeat(np.arange(256), 256), np.tile(np.arange(256), 256), n2.astype(float).ravel(), np.broadcast_to(zero, (256, 256)), 256)
        self.two = np.empty((256, 256, 256), np.float32)
        for b in range(256):  # by the byte furthest back, to keep the working set small
            lo, hi = np.searchsorted(keys3, [b << 16, (b + 1) << 16])
            ctx, sym = (keys3[lo:hi] >> 8) & 0xFF, keys3[lo:hi] & 0xFF
            self.two[b] = np.log10(self._level(ctx, sym, n3[lo:hi].astype(float), one, 256))
        self.two = self.two.reshape(-1)
        self.given = None

    @staticmethod
    def _level(ctx: np.ndarray, sym: np.ndarray, n: np.ndarray, shorter: np.ndarray, rows: int) -> np.ndarray:
        """Probabilities (rows, 256) from counts a row and symbol and the next shorter distribution."""
        count = np.zeros((rows, 256))
        count[ctx, sym] = n
        seen = count > 0
        total, kinds = count.sum(1, keepdims=True), seen.sum(1, keepdims=True)
        free = np.where(seen, 0.0, shorter)
        mass = free.sum(1, keepdims=True)
        closed = mass <= 0  # nothing is left to escape to
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(seen, count / (total + np.where(closed, 0, kinds)), kinds / (total + kinds) * free / mass)
        return np.where(total > 0, p, shorter)

    def log10(self, top: Top, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log10 probability of each row and its end by the strings of ``top``; escapes of known contexts and row boundaries among them."""
        frame, at, edges = framed(data, offs)
        key = strings4(frame, at)
        value = self.two[key & np.uint32(0xFFFFFF)].astype(np.float64)
        place, hit = find(top.keys, key)
        value[hit] = top.hits[place[hit]]
        rest = np.flatnonzero(~hit)
        place, known = find(top.contexts, key[rest] >> np.uint32(8))
        rest = rest[known]
        value[rest] += top.escape[place[known]]
        total = np.concatenate([[0.0], np.cumsum(value)])
        return total[edges[1:]] - total[edges[:-1]], key[rest], np.searchsorted(rest, edges)

    def gains(self, top: Top, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What strings of these counts add to the value of an escape."""
        ctx = find(top.contexts, keys >> 8)[0]
        return np.log10(n / top.size[ctx]) - (top.escape[ctx].astype(np.float64) + self.two[keys & 0xFFFFFF])


def _pairs(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = rows.toArrow()
    key, n = table.column("key").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(key.view(np.uint64))
    return key[order], n[order]


def _contexts(strings: DataFrame, ready) -> tuple[np.ndarray, ...]:
    """Contexts, their occurrences, kinds and the share of their bytes one order below: at most 2**24 rows."""

    def run(batches):
        for batch in batches:
            key, n = batch.column(0).to_numpy(), batch.column(1)
            yield pa.RecordBatch.from_arrays([pa.array(key >> 8), n, pa.array(10.0 ** ready().two[key & 0xFFFFFF].astype(float))], names=["ctx", "n", "p"])

    table = strings.mapInArrow(run, "ctx long, n long, p double").groupBy("ctx").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.sum("p").alias("p")).toArrow()
    order = np.argsort(table.column("ctx").to_numpy())
    return tuple(table.column(c).to_numpy()[order] for c in ("ctx", "n", "kinds", "p"))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: split, token counts, base score and the model's score."""
    spark = docs.sparkSession
    count = scratch.cut(counts(docs, id_col, text_col))
    words, strings = count.where(F.col("kind") == WORDS), count.where(F.col("kind") == BYTES)
    sums = {r.kind: r for r in count.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("distinct")).collect()}
    size = lambda kind, field: int(getattr(sums.get(kind), field, 0) or 0)
    ends = size(ENDS, "n")
    tokens, distinct = size(WORDS, "n") + ends, size(WORDS, "distinct") + (ends > 0)
    share = max(1, -(-size(BYTES, "n") // RESOLUTION))
    by3 = strings.groupBy(F.col("key").bitwiseAND(0xFFFFFF).alias("key")).agg(F.sum("n").alias("n"))
    by2 = strings.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("key")).agg(F.sum("n").alias("n"))
    keys2, n2 = _pairs(by2)
    dense2 = np.zeros(65536, np.int64)
    dense2[keys2] = n2
    model_key = uuid.uuid4().hex  # workers outlive a call
    levels = spark.sparkContext.broadcast(Trie(*_pairs(by3), dense2.reshape(256, 256)))

    def ready() -> Trie:
        if _tables.get("key") != model_key:
            _tables.clear()
            if levels.value.given is not None:
                levels.value.build()
            _tables.update(key=model_key, trie=levels.value)
        return _tables["trie"]

    modelled = strings.select("key", "n")
    top = Top(*_contexts(modelled, ready), *_pairs(modelled.where(F.col("n") >= share)))
    joined = share > 1
    frequent = max(1, -(-tokens // RESOLUTION))
    known, known_n = _pairs(words.where(F.col("n") >= frequent).select("key", "n"))
    known = known.view(np.uint64)
    denominator = tokens + distinct + 1
    shared = spark.sparkContext.broadcast((top, known, np.log10((known_n + 1) / denominator)))
    end_value = float(np.log10((ends + 1) / denominator))

    fields = [("words", T.LongType()), ("sure", T.LongType()), ("base", T.DoubleType()), ("score", T.DoubleType()), ("rare", T.ArrayType(T.LongType())), ("escapes", T.ArrayType(T.LongType()))]

    def compute(data, offs):
        top, known, value = shared.value
        n = len(offs) - 1
        hashes, rows = word_hashes(data, offs)
        if len(known):
            place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = known[place] == hashes
            base = np.bincount(rows[hit], value[place[hit]], n)
        else:
            hit, base = np.zeros(len(hashes), bool), np.zeros(n)
        rare, rare_rows = hashes[~hit].view(np.int64), rows[~hit]
        edges = np.searchsorted(rare_rows, np.arange(n + 1)).astype(np.int32)
        score, escapes, escape_edges = ready().log10(top, data, offs)
        if not joined:
            escapes, escape_edges = escapes[:0], np.zeros(n + 1)
        return {
            "words": np.bincount(rows, minlength=n), "sure": np.bincount(rows[hit], minlength=n), "base": base,
            "score": score, "rare": pa.ListArray.from_arrays(pa.array(edges), pa.array(rare)),
            "escapes": pa.ListArray.from_arrays(pa.array(escape_edges.astype(np.int32)), pa.array(escapes.astype(np.int64))),
        }

    scored = scratch.cut(K.map_documents(docs, compute, fields, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode("rare").alias("key")).join(words.select("key", "n"), "key", "left")
    rare = rare.groupBy("row").agg(F.sum(F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(denominator)))).alias("more"), F.count("n").alias("met"))
    out = scored.drop("rare", "escapes").join(rare, "row", "left").withColumn("gain", F.lit(0.0))
    if joined:

        def gains(batches):
            for batch in batches:
                key, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ready().gains(shared.value[0], key, n))], names=["key", "gain"])

        gained = modelled.where(F.col("n") < share).mapInArrow(gains, "key long, gain double")
        gained = scored.select("row", F.explode("escapes").alias("key")).join(gained, "key").groupBy("row").agg(F.sum("gain").alias("gain"))
        out = out.drop("gain").join(gained, "row", "left")
    return out.select(
        F.col(id_col),
        F.coalesce(remainder(F.col(id_col), MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"),
        (F.col("words") + 1).alias("n_tokens"),
        (F.col("sure") + F.coalesce("met", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) + F.lit(end_value)).alias("base_score"),
        (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
