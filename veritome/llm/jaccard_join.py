"""N-gram Jaccard join by rare-first prefix filtering.

A document is the set of its distinct five-word shingles (A-Z lower-cased; fewer
words make one shingle).  Equal sets form one node, found by a hash of the set.

1. One pass gives each document's set size and node, and counts shingles in a
   sketch of fixed size; estimates order shingles from rare to common.  Any order
   gives right results, the estimates only keep common shingles out of prefixes.
2. Two sets that reach the threshold share a shingle among the first
   ``n - ceil(t n) + 1`` of each.  Prefix shingles of one set alone are left out by
   a filter (``repeats``), the others are shuffled, keyed by shingle; of shingles
   with the same holders the first is kept.  Length and positional filters drop
   pairs before any set is read.
3. Pairs are verified once: the suffix filter bounds the overlap from the sizes of
   the parts between pivots, then the overlap is counted.

For components not all pairs are needed.  Each shingle first pairs its nodes with
four of them only (smallest, largest, one by hash, the most typical).  Nodes of one shingle that
these links leave in different components are then all paired, so no link that
could join two components goes untested, while a group of thousands of near
copies costs a few pairs a member.  ``similar_pairs`` gives every pair instead.

Sets travel only for nodes in pairs, picked by a Bloom filter of bounded size (a
fuller one lets more sets through and changes no result).

Defined results: null texts and texts without words have no shingles, link with
nothing and are their own component; every input row gives one row, repeated ids
included (their component is the id); rows with a null id take part, and a
component of null ids alone is null.  Other input columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritome.llm import repeats, scratch
from veritome.llm import textkit as K
from veritome.llm.components import components

SHINGLE, PERCENT = 5, 80
#: Counters of the sketch, and the rows in which a task's sketch travels.
COUNTER_BITS, CHUNKS = 24, 256
COUNTERS = 1 << COUNTER_BITS
_SHIFT = K.U64(64 - COUNTER_BITS)
_LOW48 = K.U64((1 << 48) - 1)


def shingles(data: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the rows, not yet distinct, and row boundaries among them."""
    low = K.LOWER[data]
    starts, ends, rows = K.words(low, offs)
    words = K.Prefix(low).of(starts, ends)
    n = len(offs) - 1
    hashes, at = K.grams(words, rows, size)
    owner = rows[at]
    count = np.bincount(rows, minlength=n)
    edges = np.searchsorted(rows, np.arange(n + 1))
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        few = np.array([K.grams(words[edges[r] : edges[r + 1]], np.zeros(count[r], np.int64), int(count[r]))[0][0] for r in short], np.uint64)
        order = np.argsort(np.concatenate([owner, short]), kind="stable")
        hashes, owner = np.concatenate([hashes, few])[order], np.concatenate([owner, short])[order]
    return hashes, np.searchsorted(owner, np.arange(n + 1))


def needed(n, percent: int = PERCENT):
    """Least overlap of a set of n with any partner: ceil(t n)."""
    return (percent * n + 99) // 100


def node_of(tokens: np.ndarray) -> int:
    """One number for a set: both a sum and a product-like mix of its members."""
    if not len(tokens):
        return 0
    s = int(K.mix(tokens).sum(dtype=np.uint64)) ^ (int(np.bitwise_xor.reduce(K.mix(tokens ^ K.U64(0xA5A5A5A5A5A5A5A5)))) * 3 % 2**64) ^ (len(tokens) << 40)
    return int(np.array([s], np.uint64).view(np.int64)[0])


def _profile(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document its set size and node; per task its sketch, in chunks."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("node", T.LongType()), T.StructField("chunk", T.IntegerType()), T.StructField("sketch", T.BinaryType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        id_type, counters = to_arrow_type(schema["id"].dataType), np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            data, offs = K.buffers(batch.column(1))
            for lo, hi, part, at in K.slices(data, offs):
                hashes, edges = shingles(part, at)
                sizes, nodes = np.empty(hi - lo, np.int64), np.empty(hi - lo, np.int64)
                for r, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                    one = np.unique(hashes[a:b])
                    sizes[r], nodes[r] = len(one), node_of(one)
                np.add.at(counters, (hashes >> _SHIFT).astype(np.int64), np.uint32(1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes), pa.array(nodes), pa.nulls(hi - lo, pa.int32()), pa.nulls(hi - lo, pa.binary())], names=schema.names)
        blobs = [zstandard.compress(c.tobytes(), 1) for c in np.split(counters, CHUNKS)] if counters.any() else []
        if blobs:
            yield pa.RecordBatch.from_arrays([pa.nulls(CHUNKS, id_type), pa.nulls(CHUNKS, pa.int64()), pa.nulls(CHUNKS, pa.int64()), pa.array(range(CHUNKS), pa.int32()), pa.array(blobs, pa.binary())], names=schema.names)

    return docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(run, schema)


def _rarity(profile: DataFrame) -> np.ndarray:
    """16-bit rarity of each counter: eight steps a doubling of the count."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, blob in zip(*(batch.column(i).to_pylist() for i in range(2))):
                part = np.frombuffer(zstandard.decompress(blob), np.uint32)
                sums[chunk] = sums[chunk] + part if chunk in sums else part.astype(np.int64)
        levels = [np.round(8 * np.log2(1.0 + v)).astype(np.uint16).tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], names=["chunk", "levels"])

    merged = profile.where("chunk is not null").select("chunk", "sketch").repartition(CHUNKS, "chunk").mapInArrow(add, "chunk int, levels binary")
    total = np.zeros((CHUNKS, COUNTERS // CHUNKS), np.uint16)
    for row in merged.collect():  # a row a chunk
        total[row.chunk] = np.frombuffer(row.levels, np.uint16)
    return total.ravel()


def ordered_sets(data: np.ndarray, offs: np.ndarray, rarity: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Node and tokens of each row; a token is its shingle's rarity, then 48 bits of its hash, in ascending order."""
    hashes, edges = shingles(data, offs)
    tokens = (rarity[(hashes >> _SHIFT).astype(np.int64)].astype(np.uint64) << K.U64(48)) | (hashes & _LOW48)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        out.append((node_of(np.unique(hashes[a:b])), np.unique(tokens[a:b])))
    return out


def _sets(docs: DataFrame, rarity: np.ndarray, text_col: str, schema: str, emit) -> DataFrame:
    """Rows that ``emit`` makes from each distinct set of a task."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            data, offs = K.buffers(batch.column(0))
            for _, _, part, at in K.slices(data, offs):
                fresh = []
                for node, tokens in ordered_sets(part, at, shared.value):
                    if len(tokens) and node not in seen:
                        seen.add(node)
                        fresh.append((node, tokens))
                if fresh:
                    yield from emit(fresh)

    return docs.select(docs[text_col].cast("string")).mapInArrow(run, schema)


def _prefixes(docs: DataFrame, rarity: np.ndarray, text_col: str, percent: int) -> DataFrame:
    """(node, n, centre, tokens): a set's size, its mean rarity and its prefix."""

    def emit(fresh):
        sizes = np.array([len(t) for _, t in fresh])
        keep = sizes - needed(sizes, percent) + 1
        centre = [int(100 * float((t >> K.U64(48)).mean())) for _, t in fresh]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.array([n for n, _ in fresh], np.int64)), pa.array(sizes.astype(np.int32)), pa.array(centre, pa.int32()),
            pa.array([t[:k].tobytes() for (_, t), k in zip(fresh, keep)], pa.binary()),
        ], names=["node", "n", "centre", "tokens"])

    return _sets(docs, rarity, text_col, "node long, n int, centre int, tokens binary", emit)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, sizes, centres, all prefix tokens and the number of these a node."""
    blobs = batch.column(3).to_pylist()
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), np.frombuffer(b"".join(blobs), np.uint64), np.array([len(b) // 8 for b in blobs], np.int64)


def _shared_filter(prefixes: DataFrame) -> repeats.Filter:
    """The filter of prefix tokens that two nodes have."""
    count = repeats.shards(prefixes.sparkSession)

    def run(batches):
        held, size = [], 0

        def flush():
            if held:
                keys, places = (np.concatenate(x) for x in zip(*held))
                held.clear()
                yield from repeats.by_shard(*repeats.distinct(keys, places), count)

        for batch in batches:
            node, _, _, tokens, many = _flat(batch)
            held.append((tokens, np.repeat(node, many)))
            size += len(tokens)
            if size > 1 << 22:
                yield from flush()
                size = 0
        yield from flush()

    return repeats.repeated_filter(prefixes.mapInArrow(run, repeats.SHARD_SCHEMA))


def _entries(prefixes: DataFrame) -> DataFrame:
    """A row a prefix token that other nodes may share, with its place in the set."""
    shared = prefixes.sparkSession.sparkContext.broadcast(_shared_filter(prefixes))

    def run(batches):
        for batch in batches:
            node, n, centre, tokens, many = _flat(batch)
            owner = np.repeat(np.arange(len(node)), many)
            keep = np.flatnonzero(shared.value.passes(tokens))
            first = np.cumsum(many) - many
            mine = owner[keep]
            yield pa.RecordBatch.from_arrays([
                pa.array(tokens[keep].view(np.int64)), pa.array(node[mine]), pa.array(n[mine]),
                pa.array((keep - first[mine]).astype(np.int32)), pa.array(centre[mine]),
            ], names=["token", "node", "n", "pos", "centre"])

    return prefixes.mapInArrow(run, "token long, node long, n int, pos int, centre int")


def pack_set(tokens: np.ndarray) -> bytes:
    """A set as six bytes a shingle, ascending by hash."""
    return np.sort(tokens & _LOW48).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack_set(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel()


def _full_sets(docs: DataFrame, rarity: np.ndarray, text_col: str, pairs: DataFrame) -> DataFrame:
    """(node, set) of the nodes in pairs, and of the few others that the filter lets through."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    shared = docs.sparkSession.sparkContext.broadcast(repeats.key_filter(nodes))

    def emit(fresh):
        ok = shared.value.passes(np.array([n for n, _ in fresh], np.int64).view(np.uint64))
        if ok.any():
            some = [x for x, k in zip(fresh, ok) if k]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in some], pa.int64()), pa.array([pack_set(t) for _, t in some], pa.binary())], names=["node", "set"])

    return _sets(docs, rarity, text_col, "node long, set binary", emit).groupBy("node").agg(F.first("set").alias("set"))


def overlap_reaches(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two ascending sets reach the threshold: length, suffix filter, then the count."""
    both = len(x) + len(y)
    enough = -(-percent * both // (100 + percent))
    if min(len(x), len(y)) < enough:
        return False
    if len(y) >= 16:
        cuts = np.linspace(0, len(y), 9).astype(np.int64)
        in_x = np.concatenate([[0], np.searchsorted(x, y[cuts[1:-1]]), [len(x)]])
        if np.minimum(np.diff(cuts), np.diff(in_x)).sum() < enough:
            return False
    place = np.minimum(np.searchsorted(x, y), len(x) - 1)
    return int((x[place] == y).sum()) >= enough


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold."""

    def run(batches):
        for batch in batches:
            ok = [overlap_reaches(unpack_set(x), unpack_set(y), percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    left = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    return left.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _may_link(x: str, y: str, percent: int):
    """Length and positional filters for two entries of one token.

    The overlap is at most what follows the first common token in either set, so
    the entry of that token passes for every pair that reaches the threshold;
    entries of later tokens need not.
    """
    c = lambda side, name: F.col(f"{side}{name}")
    most = F.least(c(x, "n") - c(x, "pos"), c(y, "n") - c(y, "pos"))
    return (100 * F.least(c(x, "n"), c(y, "n")) >= percent * F.greatest(c(x, "n"), c(y, "n"))) & ((100 + percent) * most >= percent * (c(x, "n") + c(y, "n")))


class Join:
    """The tables of one join; each is written once and read by the steps after it."""

    def __init__(self, docs: DataFrame, percent: int, id_col: str, text_col: str) -> None:
        self.docs, self.percent, self.text_col = docs, percent, text_col
        profile = scratch.cut(_profile(docs, id_col, text_col))
        self.documents = scratch.cut(profile.where("chunk is null").select("id", "n", "node"))
        self.rarity = _rarity(profile)
        scratch.drop(profile)
        scratch.free(docs.sparkSession)
        prefixes = scratch.cut(_prefixes(docs, self.rarity, text_col, percent))
        entries = scratch.cut(_entries(prefixes))
        scratch.drop(prefixes)
        scratch.free(docs.sparkSession)
        # Each task that holds copies of a set gives its entries; a holder counts once, or even numbers of copies cancel in x and y.
        once = entries.repartition("token").dropDuplicates(["token", "node"])
        # The hub that serves most is the most typical set: near copies differ from it by their own edits only.
        me = ["node", "n", "pos"]
        hubs = once.groupBy("token").agg(
            F.min(F.struct(F.col("n").alias("h"), *me)).alias("low"), F.max(F.struct(F.col("n").alias("h"), *me)).alias("high"),
            F.min(F.struct(F.xxhash64("node").alias("h"), *me)).alias("any"), F.max(F.struct("centre", *me)).alias("typical"),
            F.count("*").alias("holders"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
        ).where("holders > 1")
        # Of shingles with the same holders the first is enough: it comes first in each of these sets.
        each = [F.struct(*(F.col(f"{h}.{c}").alias(c) for c in me)) for h in ("low", "high", "any", "typical")]
        hubs = hubs.select("token", F.array_distinct(F.array(*each)).alias("hubs"), "holders", "x", "y")
        firsts = hubs.groupBy("holders", "x", "y").agg(F.min(F.struct("token", "hubs")).alias("first")).select("first.*")
        self.shared = scratch.cut(once.join(firsts, "token"))
        scratch.drop(entries)
        scratch.free(docs.sparkSession)

    def star_pairs(self) -> DataFrame:
        met = self.shared.select("node", "n", "pos", F.explode("hubs").alias("hub")).where("node <> hub.node").where(_may_link("", "hub.", self.percent))
        return met.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()

    def all_pairs(self, labels: DataFrame | None = None) -> DataFrame:
        """Pairs that share a prefix shingle; with labels only those of different components."""
        rows = self.shared.select("token", "node", "n", "pos")
        if labels is None:
            rows = rows.withColumn("component", F.col("node"))
        else:
            rows = scratch.cut(rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")))
            mixed = scratch.cut(rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token"))
            rows = scratch.cut(rows.join(mixed, "token", "left_semi"))
        x, y = (rows.select(*(F.col(c).alias(f"{s}_{c}") for c in ("token", "node", "n", "pos", "component"))) for s in "xy")
        meet = x.join(y, (F.col("x_token") == F.col("y_token")) & (F.col("x_node") < F.col("y_node")) & (F.col("x_component") != F.col("y_component")) & _may_link("x_", "y_", self.percent))
        return meet.select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct()

    def verify(self, pairs: DataFrame) -> DataFrame:
        sets = scratch.cut(_full_sets(self.docs, self.rarity, self.text_col, pairs))
        scratch.free(self.docs.sparkSession)
        links = scratch.cut(_verify(pairs, sets, self.percent))
        scratch.drop(sets)
        scratch.free(self.docs.sparkSession)
        return links

    def labels(self) -> DataFrame:
        """(node, component) of all nodes with a link."""
        tested = scratch.cut(self.star_pairs())
        links = self.verify(tested)
        first = scratch.cut(components(links))
        rest = scratch.cut(self.all_pairs(first).join(tested, ["a", "b"], "left_anti"))
        if rest.isEmpty():
            return first
        more = self.verify(rest)
        return first if more.isEmpty() else scratch.cut(components(links.unionByName(more)))


def similar_pairs(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Every link between different sets as (a, b) nodes, and (id, n, node) of the documents."""
    join = Join(docs, percent, id_col, text_col)
    return join.verify(scratch.cut(join.all_pairs())), join.documents


def jaccard_components(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id for every row."""
    join = Join(docs, percent, id_col, text_col)
    labels = join.labels()
    nodes = scratch.cut(join.documents.where("n > 0").groupBy("node").agg(F.min("id").alias("least")))
    nodes = scratch.cut(nodes.join(labels, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component")))
    names = scratch.cut(nodes.groupBy("component").agg(F.min("least").alias("component_id")))
    named = scratch.cut(nodes.join(names, "component").select("node", "component_id"))
    full = join.documents.where("n > 0").join(named, "node").select("id", "n", "component_id")
    empty = join.documents.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return full.unionByName(empty).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, and every row without shingles; all columns.

    Of a group stays the row with the smallest id, null ids last; of several rows with
    that id one, by their node and place in the input.  Nodes tell rows apart, so a
    repeated id with other text, and a null id, are judged by their own group.
    """
    spark = docs.sparkSession
    # The rows with a number each, written once: numbers must not change between the passes.
    rows = scratch.cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__row").alias("row"))
    keyed = rows.select(key.alias("__key"), F.col(text_col).alias("__text"))
    join = Join(keyed, percent, "__key", "__text")
    nodes = scratch.cut(join.documents.where("n > 0").groupBy("node").agg(F.min("id").alias("least")))
    nodes = scratch.cut(nodes.join(join.labels(), "node", "left").select("node", "least", F.coalesce("component", "node").alias("component")))
    names = nodes.groupBy("component").agg(F.min("least").alias("stays"))
    stays = scratch.cut(nodes.join(names, "component").select("node", F.col("stays.row").alias("stays")))
    gone = scratch.cut(join.documents.where("n > 0").select("node", F.col("id.row").alias("__row")).join(stays, "node").where("__row <> stays").select("__row"))
    # Only rows that a filter of those to drop lets through meet that list; all others stay where they are.
    shared = spark.sparkContext.broadcast(repeats.key_filter(gone))

    def split(hit: bool) -> DataFrame:
        def run(batches):
            for batch in batches:
                found = shared.value.passes(batch.column(batch.num_columns - 1).to_numpy().view(np.uint64)) == hit
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(found)) for c in batch.columns], names=batch.schema.names)

        return rows.mapInArrow(run, rows.schema)

    return split(False).unionByName(split(True).join(gone, "__row", "left_anti")).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE_SQL = f"""WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ') g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id a, y.doc_id b, count(*) o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= {PERCENT} * (x.n + y.n - o)),
c(doc_id, r) AS (SELECT doc_id, doc_id FROM t UNION SELECT b, r FROM c JOIN l ON l.a = c.doc_id)
SELECT t.doc_id, coalesce(any_value(n.n), 0)::BIGINT n_shingles, min(c.r) component_id FROM t JOIN c USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY t.doc_id"""
