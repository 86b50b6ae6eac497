"""Packing along a space-filling curve.

1. One pass tokenises each document and projects its hashed vector (mean of a
   fixed pseudo-random vector a token id) to a few dimensions; the Hilbert index
   of the quantised point is the sort key.  Ids and keys go to a written table.
2. The keys alone are range-sorted; each partition numbers its tokens from 0, and
   the driver adds up one total a partition.  Every document then has its place
   in one stream of tokens that follows the curve.
3. Documents meet their place by row number, and the stream is cut every 1024
   tokens, so only the very last sequence is padded.

Equal documents have equal keys; the key is followed by the row number, so range
partitions split a large group of copies.  No task ever holds such a group.

Defined results: a null or empty text is the closing id alone (one piece of
length 1); every input row is packed, repeated ids included; an empty table gives
no pieces; other input columns are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritome.llm import scratch
from veritome.llm import textkit as K

LENGTH = 1024
DIMENSIONS, BITS = 4, 12
#: Spread of a mean token vector: means of a few hundred tokens fill the grid.
SCALE = 6.0
END_ID = 0

_loaded: dict[str, object] = {}


class Encoder:
    """Ids of the tokenizer in ``path``.

    Where the file describes plain byte-level byte-pair encoding (``_plain``), the merges
    are run by tiktoken on its very vocabulary, which gives the same ids several times
    faster; any other file, and a text that spells an added token, goes through the
    tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.exact, self.fast = Tokenizer.from_file(path), None
        chars, special = _byte_chars(), {x["content"] for x in spec["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, sorted(special))) or "(?!)")
        if not _plain(spec, chars, special):
            return
        ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: the byte-level pre-tokenizer's pattern
        self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or self.special.search(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def _plain(spec: dict, chars: dict[str, int], special: set[str]) -> bool:
    """Whether a tokenizer file says no more than: byte-level words, merged in the order of their ids."""
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or before.get("use_regex") is False:
        return False
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    words = {t: i for t, i in model["vocab"].items() if t not in special}
    if any(c not in chars for t in words for c in t) or not all(c in words for c in chars):
        return False
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
    ids = [words.get(t, -1) for t in merged]
    # Each longer word has one merge, and merges come in the order of ids.
    return ids == sorted(ids) and len(set(ids)) == len(ids) == len(words) - len(chars)


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def directions(ids: np.ndarray, dims: int) -> np.ndarray:
    """A pseudo-random vector for each token id: hashing and projection in one step."""
    seeds = ids.astype(np.uint64)[:, None] * K.U64(dims) + np.arange(1, dims + 1, dtype=np.uint64)
    return (K.mix(seeds) >> K.U64(11)).astype(np.float64) / 2.0**52 - 1.0


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (n, dims), each coordinate below 2**bits (Skilling's transposition)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            if i:
                x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flip ^= np.where((x[-1] & q) > 0, q - 1, 0)
    x ^= flip
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_keys(flat: np.ndarray, counts: np.ndarray, dims: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Sort key of each run of ids."""
    edges = np.concatenate([[0], np.cumsum(counts)])
    mean = np.add.reduceat(_table(dims, int(flat.max(initial=0)) + 1)[flat], edges[:-1]) / counts[:, None]
    # Logistic squashing keeps every real in the grid; the stop keeps the last cell.
    cells = (1.0 / (1.0 + np.exp(-SCALE * mean)) * (1 << bits)).astype(np.int64)
    return hilbert(np.clip(cells, 0, (1 << bits) - 1), bits)


def _table(dims: int, n: int) -> np.ndarray:
    have = _loaded.get(f"table{dims}")
    if have is None or len(have) < n:
        _loaded[f"table{dims}"] = have = directions(np.arange(max(n, 1 << 16)), dims)
    return have


def tokenise(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """id, key, number of ids and the ids (little-endian, 16 bits where they fit) of each row."""
    fields = [("key", T.LongType()), ("n", T.LongType()), ("wide", T.BooleanType()), ("ids", T.BinaryType())]

    def compute(data, offs):
        encode, raw = encoder(path), data.tobytes()
        ids = [encode(raw[a:b].decode("utf-8", "replace")) + [END_ID] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for one in ids for x in one), np.uint32, int(counts.sum()))
        wide = bool(flat.max(initial=0) > 0xFFFF)
        packed = flat if wide else flat.astype(np.uint16)
        edges = np.concatenate([[0], np.cumsum(counts)])
        return {"key": curve_keys(flat, counts), "n": counts, "wide": np.full(len(ids), wide), "ids": [packed[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]}

    return K.map_documents(docs, compute, fields, id_col, text_col)


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its document, its place there, its sequence and its place in that."""
    spark = docs.sparkSession
    tokens = scratch.cut(tokenise(docs, tokenizer_path, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.select("key", "row", "n").repartitionByRange(parts, "key", "row").sortWithinPartitions("key", "row")

    def number(batches):
        from pyspark import TaskContext

        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(2).to_numpy()
            ends = done + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.full(len(n), part)), pa.array(ends - n), pa.array(n)], names=["row", "part", "before", "n"])
            done = int(ends[-1]) if len(ends) else done

    places = scratch.cut(ordered.mapInArrow(number, "row long, part long, before long, n long"))
    totals = {r.part: r.total for r in places.groupBy("part").agg(F.sum("n").alias("total")).collect()}  # one row a partition
    base, at = {}, 0
    for part in sorted(totals):
        base[part], at = at, at + totals[part]

    # Neither side has a bound, so neither is broadcast, however small this run is.
    joined = tokens.select(id_col, "row", "wide", "ids").hint("merge").join(places.select("row", "part", "before"), "row")
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), *(T.StructField(k, T.LongType()) for k in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])

    def pieces(batches):
        for batch in batches:
            rows, out = [], {k: [] for k in schema.names[1:]}
            wides, blobs, parts_, befores = (batch.column(i).to_pylist() for i in (1, 2, 3, 4))
            for r, (wide, blob, part, before) in enumerate(zip(wides, blobs, parts_, befores)):
                ids = np.frombuffer(blob, "<u4" if wide else "<u2").astype("<u4")
                place, n, start = base[part] + before, len(ids), 0
                while start < n:
                    offset = (place + start) % length
                    size = min(n - start, length - offset)
                    rows.append(r)
                    for k, v in zip(out, (start, size, zlib.crc32(ids[start : start + size].tobytes()), n, (place + start) // length, offset)):
                        out[k].append(v)
                    start += size
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(v, pa.int64()) for v in out.values())], names=schema.names)

    return joined.select(id_col, "wide", "ids", "part", "before").mapInArrow(pieces, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), default_tokenizer())
