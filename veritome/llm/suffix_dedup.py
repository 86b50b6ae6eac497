"""Exact repeated passages: every byte inside a 50-byte string that an earlier document has too.

Two equal 50-byte strings have the same minimizer, the least hash among their
k-grams.  Runs of windows with one minimizer occurrence are cut from the texts
("segments", at most 80 bytes), and only segments with equal minimizers need to
be compared, so the suffixes of the corpus are sorted in independent shards:

1. One pass collects minimizers; ``repeats`` gives those of two places.
2. A second pass sends the segments of repeated minimizers to shards.  Of segments
   that are equal byte for byte a task sends, once for every few megabytes of text,
   those of its smallest document; for its other documents that already says that
   the whole segment is repeated.  So a passage found in a third of all documents
   costs a shard a few entries a task.
3. A shard sorts the strings it gets, a few megabytes at a time; equal ones have equal
   suffixes and become one, as in step 2.  It writes the others to files and sorts the
   suffixes of all of them by external induced sorting (``induced_sort``), in memory of
   a fixed size.  Suffixes
   whose common prefixes reach 50 bytes start with one string; its smallest owner is
   then known, and whatever larger documents have of it goes.
4. Spans go back to documents by id and text hash, and are cut out.

Hashes only decide what meets where; equality is always that of bytes.

Defined results: a null or empty text, or one below 50 bytes, loses nothing; ids
must be integers; a null id counts as 2**63 - 1; equal ids (also repeated rows) are
not smaller than each other; every input row gives one row.  Other input columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritome.llm import repeats, scratch
from veritome.llm import textkit as K
from veritome.llm.induced_sort import END, PAD, Column, Work, sort_suffixes

LENGTH, GRAM = 50, 20
SPAN = LENGTH - GRAM + 1
#: Bytes of text that are hashed at once.
PIECE = 1 << 19
#: Bytes of text between hand-overs of a task.
FLUSH_BYTES = 8 << 20
#: Shards a shuffle partition: a task sorts them one after the other, with files of about 20 times a shard.
SHARDS_A_PARTITION = 8
#: Segments or windows of a shard that are in memory at once.
BLOCK = 1 << 16
LAST = (1 << 63) - 1
_LOW24 = K.U64((1 << 24) - 1)


def pieces(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows, long rows in pieces that overlap by 49 bytes: first row, its first byte there, bytes, offsets."""
    for lo, _, part, at in K.slices(data, offs, PIECE):
        if len(part) <= 2 * PIECE:
            yield lo, 0, part, at
        else:
            for a in range(0, len(part) - LENGTH + 1, PIECE):
                one = part[a : a + PIECE + LENGTH - 1]
                yield lo, a, one, np.array([0, len(one)])


def segments(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, minimizer and row of each run of windows with one minimizer occurrence."""
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none, none, np.empty(0, np.uint64), none
    starts = np.arange(len(data) - GRAM + 1)
    least = (K.Prefix(data).of(starts, starts + GRAM) & ~_LOW24) | starts.astype(np.uint64)
    width = 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
    row = np.searchsorted(offs, np.arange(len(least)), "right") - 1
    valid = np.arange(len(least)) + LENGTH <= offs[row + 1]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    first = np.flatnonzero(new)
    stop = valid & ~np.append(valid[1:] & ~new[1:], False)
    return first, np.flatnonzero(stop) + LENGTH, least[first] >> K.U64(24), row[first]


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rank, text, hash, id): ids as numbers with null last, and the hash that tells texts of one id apart."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(LAST)).alias("rank"), text.alias("text"), F.xxhash64(text).alias("hash"), docs[id_col].alias("id"))


def _minimizers(narrow: DataFrame, shards: int) -> DataFrame:
    def run(batches):
        held, size = [], 0

        def flush():
            if held:
                keys, places = (np.concatenate(x) for x in zip(*held))
                held.clear()
                yield from repeats.by_shard(*repeats.distinct(keys, places), shards)

        for batch in batches:
            rank = batch.column(0).to_numpy()
            data, offs = K.buffers(batch.column(1))
            for lo, _, part, at in pieces(data, offs):
                _, _, keys, row = segments(part, at)
                held.append((keys, rank[lo + row]))
                size += len(keys)
                if size > 1 << 20:
                    yield from flush()
                    size = 0
        yield from flush()

    return narrow.select("rank", "text").mapInArrow(run, repeats.SHARD_SCHEMA)


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


#: Parts of a blob: a segment a row, its length and number of places; a place a row, its document and start; documents; the segments' bytes.
_PARTS = (("length", np.uint8), ("places", np.uint32), ("document", np.uint32), ("start", np.int64), ("rank", np.int64), ("hash", np.int64), ("bytes", np.uint8))


def _encode(parts: dict[str, np.ndarray]) -> bytes:
    sizes = np.array([len(parts[k]) for k, _ in _PARTS], np.int64)
    planes = [np.ascontiguousarray(parts[k].astype(t).view(np.uint8).reshape(len(parts[k]), -1).T).tobytes() for k, t in _PARTS]
    return zstandard.compress(sizes.tobytes() + b"".join(planes), 3)


def _decode(blob: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.decompress(blob)
    sizes, at, out = np.frombuffer(raw, np.int64, len(_PARTS)), 8 * len(_PARTS), {}
    for (k, t), n in zip(_PARTS, sizes.tolist()):
        width = np.dtype(t).itemsize
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out[k] = np.ascontiguousarray(planes.T).view(t).ravel()
        at += n * width
    return out


def _joined(rank, hashes, start, end) -> Iterator[tuple]:
    """Ranges of the same document that touch, made one."""
    order = np.lexsort((start, hashes, rank))
    rank, hashes, start, end = rank[order], hashes[order], start[order], end[order]
    if not len(rank):
        return
    group = np.cumsum(np.concatenate([[0], (rank[1:] != rank[:-1]) | (hashes[1:] != hashes[:-1])]))
    # Ends never fall back within a document; groups are lifted apart to keep one running maximum.
    lift = group * (int(end.max()) + 1)
    far = np.maximum.accumulate(end + lift)
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (start[1:] + lift[1:] > far[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rank)) - 1
    yield rank[first], hashes[first], start[first], far[last] - lift[last]


def _span_batches(rank, hashes, start, end) -> Iterator[pa.RecordBatch]:
    for r, h, a, b in _joined(rank, hashes, start, end):
        for lo in range(0, len(r), 1 << 16):
            s = slice(lo, lo + (1 << 16))
            n = len(r[s])
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(r[s]), pa.array(h[s]), pa.array(a[s]), pa.array(b[s])], names=["shard", "blob", "rank", "hash", "start", "end"])


_SPANS = "rank long, hash long, start long, end long"


def _alike(data: np.ndarray, at: np.ndarray, length: np.ndarray, content: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of segments by content, then rank, and which of them begin a group of equal ones."""
    while True:
        order = np.lexsort((rank, content))
        new = np.concatenate([[True], content[order][1:] != content[order][:-1]])
        first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        again = np.flatnonzero(~new)
        one, other = order[again], first[again]
        same = length[one] == length[other]
        one, other = one[same], other[same]
        if len(one):
            equal = data[_ragged(at[one], length[one])] == data[_ragged(at[other], length[one])]
            same[same] = np.logical_and.reduceat(equal, np.cumsum(length[one]) - length[one])
        if same.all():
            return order, new
        odd = order[again[~same]]  # equal hashes of different bytes: these stay single
        content = content.copy()
        content[odd] = K.mix(content[odd] + odd.astype(np.uint64) + K.U64(1))


def _send(narrow: DataFrame, shards: int, wanted: repeats.Blocks) -> DataFrame:
    """Blobs of segments for the shards, and spans already known in the task."""

    def run(batches):
        held: list = []
        texts: list[np.ndarray] = []
        ids: list = []
        size = documents = 0

        def flush():
            nonlocal size, documents
            if held:
                data = np.concatenate(texts)
                rank, hashes = (np.concatenate(x) for x in zip(*ids))
                at, length, key, content, document, start = (np.concatenate(x) for x in zip(*held))
                order, new = _alike(data, at, length, content, rank[document])
                first, group = np.flatnonzero(new), np.cumsum(new) - 1
                smallest = rank[document[order[first]]]
                sent = rank[document[order]] == smallest[group]
                rest = order[~sent]
                yield from _span_batches(rank[document[rest]], hashes[document[rest]], start[rest], start[rest] + length[rest])
                places = np.bincount(group[sent], minlength=len(first))
                one = order[first]
                shard = repeats.shard_of(key[one], shards)
                by = np.lexsort((key[one], shard))
                place_order = order[sent]
                place_first = np.cumsum(places) - places
                bounds = np.searchsorted(shard[by], np.arange(shards + 1))
                for s in range(shards):
                    mine = by[bounds[s] : bounds[s + 1]]
                    if not len(mine):
                        continue
                    where = place_order[_ragged(place_first[mine], places[mine])]
                    docs_here, local = np.unique(document[where], return_inverse=True)
                    blob = _encode({
                        "length": length[one[mine]], "places": places[mine], "document": local, "start": start[where],
                        "rank": rank[docs_here], "hash": hashes[docs_here], "bytes": data[_ragged(at[one[mine]], length[one[mine]])],
                    })
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([blob], pa.binary()), *(pa.nulls(1, pa.int64()) for _ in range(4))], names=["shard", "blob", "rank", "hash", "start", "end"])
            held.clear()
            texts.clear()
            ids.clear()
            size = documents = 0

        for batch in batches:
            rank, hashes = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            data, offs = K.buffers(batch.column(1))
            for lo, base, part, at in pieces(data, offs):
                a, b, key, row = segments(part, at)
                ok = np.flatnonzero(wanted.passes(key))
                a, b, key, row = a[ok], b[ok], key[ok], row[ok]
                if len(a):
                    content = K.Prefix(part).of(a, b)
                    n = len(at) - 1
                    held.append((a + size, b - a, key, content, documents + row, a - at[row] + base))
                    texts.append(part)
                    ids.append((rank[lo : lo + n], hashes[lo : lo + n]))
                    size += len(part)
                    documents += n
                if size > FLUSH_BYTES:
                    yield from flush()
        yield from flush()

    return narrow.select("rank", "text", "hash").mapInArrow(run, f"shard int, blob binary, {_SPANS}")


class Shard:
    """The segments of one shard in files; ``spans`` sorts their suffixes."""

    def __init__(self, work: Work | None = None) -> None:
        self.work = work or Work()
        self.raw, self.segment = Column(np.uint8), Column(np.uint32)  # bytes, and the segment of each
        self.begin, self.length, self.owner, self.first = Column(np.int64), Column(np.uint8), Column(np.int64), Column(np.int64)
        self.rank, self.hash, self.start = Column(np.int64), Column(np.int64), Column(np.int64)  # places
        self.known = [Column(np.int64) for _ in range(4)]  # rank, hash, start and end of places that are repeated as a whole
        self.raw.append(np.array([END], np.uint8))
        self.segment.append(np.zeros(1))
        self.held: list[dict[str, np.ndarray]] = []
        self.waiting = 0

    def add(self, blob: bytes) -> None:
        self.held.append(_decode(blob))
        self.waiting += sum(x.nbytes for x in self.held[-1].values())
        if 2 * self.waiting > self.work.memory:
            self._write()

    def _write(self) -> None:
        """Sorts the strings that wait, as suffixes of full length: equal ones become one, with the places of their smallest document."""
        if not self.held:
            return
        length, places, raw, start = (np.concatenate([x[k] for x in self.held]) for k in ("length", "places", "bytes", "start"))
        length, places = length.astype(np.int64), places.astype(np.int64)
        rank, hashes = (np.concatenate([x[k][x["document"]] for x in self.held]) for k in ("rank", "hash"))
        self.held, self.waiting = [], 0
        if not len(length):
            return
        # A byte that UTF-8 never uses ends each string, so that no common prefix runs on into the next.
        table = np.full((len(length), int(length.max()) + 1), END, np.uint8)
        table[np.arange(table.shape[1]) < length[:, None]] = raw
        place = np.cumsum(places) - places
        owner = rank[place]
        order = np.argsort(owner, kind="stable")
        strings = table[order]
        by = np.argsort(strings.view(f"S{table.shape[1]}").ravel(), kind="stable")
        order, strings = order[by], strings[by]
        new = np.append(True, (strings[1:] != strings[:-1]).any(1))
        first = np.flatnonzero(new)
        stays = owner[order] == owner[order[first]][np.cumsum(new) - 1]
        rest, kept, one = order[~stays], order[stays], order[first]
        at = _ragged(place[rest], places[rest])
        for column, values in zip(self.known, (rank[at], hashes[at], start[at], start[at] + np.repeat(length[rest], places[rest]))):
            column.append(values)
        length = length[one]
        self.segment.append(np.repeat(np.arange(self.length.size, self.length.size + len(length)), length + 1))
        self.begin.append(np.cumsum(length + 1) - (length + 1) + self.raw.size)
        self.length.append(length)
        many = np.add.reduceat(places[kept], np.flatnonzero(new[stays]))
        self.first.append(np.cumsum(many) - many + self.rank.size)
        self.owner.append(owner[one])
        at = _ragged(place[kept], places[kept])
        self.rank.append(rank[at])
        self.hash.append(hashes[at])
        self.start.append(start[at])
        self.raw.append(strings[first][np.arange(table.shape[1]) <= length[:, None]])

    def _windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Places with 50 bytes before their string ends, in order, and a number for what they start with."""
        segment, begin, length = self.segment.mapped(), self.begin.mapped(), self.length.mapped()
        kind = np.uint32 if len(segment) < 1 << 32 else np.int64
        window, group, breaks = Column(kind), Column(kind), 0

        def emit(position: np.ndarray, common: np.ndarray) -> None:
            nonlocal breaks
            # A shorter suffix shares less than 50 bytes with either neighbour, so windows between two breaks share 50.
            number = breaks + np.cumsum(common < LENGTH)
            of = segment[position]
            whole = begin[of] + length[of] - position >= LENGTH
            window.append(position[whole])
            group.append(number[whole])
            breaks = int(number[-1])

        self.raw.append(np.zeros(PAD))
        sort_suffixes(self.raw.mapped(), emit, self.work)
        return window.mapped(), group.mapped()

    def _repeated(self) -> np.ndarray:
        """1 at each place that starts a 50-byte string which a smaller document has too."""
        marks = Column.blank(np.uint8, self.segment.size).mapped("r+")
        segment, owner = self.segment.mapped(), self.owner.mapped()
        window, group = self._windows()
        lo = 0
        while lo < len(window):
            hi = min(len(window), lo + BLOCK)
            if hi < len(window) and group[hi - 1] == group[hi]:
                whole = int(np.searchsorted(group[lo:hi], group[hi]))
                hi = lo + whole if whole else int(np.searchsorted(group, group[hi], "right"))
            if group[lo] == group[hi - 1]:  # one group, perhaps far larger than a block
                low = min(int(owner[segment[window[a : min(a + BLOCK, hi)]]].min()) for a in range(lo, hi, BLOCK))
                for a in range(lo, hi, BLOCK):
                    some = window[a : min(a + BLOCK, hi)]
                    marks[some[owner[segment[some]] > low]] = 1
            else:
                some, number = window[lo:hi], group[lo:hi]
                own = owner[segment[some]]
                first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
                low = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, hi - lo)))
                marks[some[own > low]] = 1
            lo = hi
        return marks

    def spans(self) -> Iterator[pa.RecordBatch]:
        """Every place loses the windows of its segment that a smaller document has."""
        self._write()
        if not self.length.size:
            return
        known = [x.mapped() for x in self.known]
        for lo in range(0, len(known[0]), BLOCK):
            yield from (batch.select(["rank", "hash", "start", "end"]) for batch in _span_batches(*(x[lo : lo + BLOCK] for x in known)))
        marks, begin, length, first = self._repeated(), self.begin.mapped(), self.length.mapped(), self.first.mapped()
        rank, hashes, start = self.rank.mapped(), self.hash.mapped(), self.start.mapped()
        for lo in range(0, len(length), BLOCK):
            hi = min(lo + BLOCK, len(length))
            base = int(begin[lo])
            mark = marks[base : int(begin[hi - 1]) + int(length[hi - 1])]
            edge = np.diff(np.concatenate([[0], mark, [0]]).astype(np.int8))
            a, b = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0) - 1 + LENGTH
            of = np.searchsorted(begin[lo:hi], a + base, "right") - 1 + lo
            a, b = a + base - begin[of], b + base - begin[of]
            ends = np.append(first[lo + 1 : hi], first[hi] if hi < len(first) else len(rank))
            places = (ends - first[lo:hi])[of - lo]
            place, which = _ragged(first[of], places), np.repeat(np.arange(len(of)), places)
            for at in range(0, len(place), BLOCK):
                p, w = place[at : at + BLOCK], which[at : at + BLOCK]
                for batch in _span_batches(rank[p], hashes[p], start[p] + a[w], start[p] + b[w]):
                    yield batch.select(["rank", "hash", "start", "end"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rank, hash, start, end): byte ranges that lie in repeated strings; ranges of one document may overlap."""
    spark = docs.sparkSession
    narrow, shards = _narrow(docs, id_col, text_col), repeats.shards(spark)

    def merge(batches):
        shard, of = None, None
        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if s != of:
                    if shard:
                        yield from shard.spans()
                    shard, of = Shard(), s
                shard.add(blob.as_py())
        if shard:
            yield from shard.spans()

    with scratch.small_batches(spark):
        wanted = repeats.repeated_blocks(_minimizers(narrow, shards), shards)
        scratch.free(spark)
        sent = scratch.cut(_send(narrow, SHARDS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")), wanted))

        found = repeats.grouped(sent.where("shard is not null").select("shard", "blob")).mapInArrow(merge, _SPANS)
        spans = scratch.cut(found.unionByName(sent.where("shard is null").select("rank", "hash", "start", "end")))
    scratch.drop(sent)
    scratch.free(spark)
    return spans


def _cut_out(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, bytes]:
    """Bytes removed, runs, and the bytes that stay."""
    end, removed, runs, kept = 0, 0, 0, []
    zero = np.zeros(len(starts), np.int64)
    for _, _, first, last in _joined(zero, zero, starts, ends):
        for x, y in zip(first.tolist(), last.tolist()):
            kept.append(text[end:x])
            end, removed, runs = y, removed + y - x, runs + 1
    kept.append(text[end:])
    return removed, runs, b"".join(kept)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with ``keep_text`` the bytes that stay."""
    spans = repeated_spans(docs, id_col, text_col)
    # Spans and texts meet in one shuffle, spans first; a document's rows are read in a row.
    narrow, none = _narrow(docs, id_col, text_col), F.lit(None)
    id_type = docs.schema[id_col].dataType
    rows = spans.select("rank", "hash", "start", "end", none.cast("string").alias("text"), none.cast(id_type).alias("id")).unionByName(narrow.select("rank", "hash", none.cast("long").alias("start"), none.cast("long").alias("end"), "text", "id"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "rank", "hash").sortWithinPartitions("rank", "hash", F.col("start").asc_nulls_last())
    kinds = [("n_bytes", T.LongType(), pa.int64()), ("n_removed", T.LongType(), pa.int64()), ("n_spans", T.LongType(), pa.int64()), ("kept_sha256", T.StringType(), pa.string())]
    if keep_text:
        kinds.append(("kept", T.BinaryType(), pa.binary()))
    names = [id_col, *(k for k, _, _ in kinds)]

    def run(batches):
        owner, held = None, []  # spans of the document that comes next, which may lie in an earlier batch
        for batch in batches:
            n = batch.num_rows
            rank, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            start, end = (batch.column(k).fill_null(-1).to_numpy() for k in (2, 3))
            data, offs = K.buffers(batch.column(4))
            texts = np.flatnonzero(start < 0)
            raw, out, at = data.tobytes(), [[] for _ in kinds], 0
            for r in texts.tolist():
                if owner != (rank[r], hashes[r]):
                    owner, held = (rank[r], hashes[r]), []
                if r > at:
                    held.append((start[at:r], end[at:r]))
                at = r + 1
                text = raw[offs[r] : offs[r + 1]]
                removed, runs, kept = _cut_out(text, *(np.concatenate(x) for x in zip(*held))) if held else (0, 0, text)
                for column, v in zip(out, (len(text), removed, runs, hashlib.sha256(kept).hexdigest(), kept)):
                    column.append(v)
            if at < n:
                if owner != (rank[n - 1], hashes[n - 1]):
                    owner, held = (rank[n - 1], hashes[n - 1]), []
                held.append((start[at:].copy(), end[at:].copy()))
            yield pa.RecordBatch.from_arrays([batch.column(5).take(pa.array(texts)), *(pa.array(v, kind) for v, (_, _, kind) in zip(out, kinds))], names=names)

    return rows.select("rank", "hash", "start", "end", "text", "id").mapInArrow(run, T.StructType([T.StructField(id_col, id_type), *(T.StructField(k, t) for k, t, _ in kinds)]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE_SQL = f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {LAST}) AS k, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
w AS (SELECT r, k, i, substr(h, 2 * i + 1, {2 * LENGTH}) AS s FROM (SELECT r, k, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS i FROM t)),
f AS (SELECT s, min(k) AS k FROM w GROUP BY s HAVING min(k) < max(k)),
c AS (SELECT w.r, w.i FROM w JOIN f ON w.s = f.s AND f.k < w.k),
g AS (SELECT r, i, sum(CASE WHEN i - p <= {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS n FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM c)),
x AS (SELECT r, n, min(i) AS a, max(i) + {LENGTH} AS b FROM g GROUP BY r, n),
y AS (SELECT x.r, n, a, b, lag(b, 1, 0) OVER (PARTITION BY x.r ORDER BY n) AS before FROM x),
z AS (SELECT r, count(*) AS n, sum(b - a) AS removed, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY n) AS kept FROM y JOIN t USING (r) GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM t LEFT JOIN z USING (r)"""
