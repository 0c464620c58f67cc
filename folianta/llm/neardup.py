"""Near-duplicates by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

Weights. A text is the multiset of its runs of five words, as 32-bit ids; a shingle weighs
tf * idf with idf = 1 + ln((1 + N) / (1 + max(df, t))), which is 1 at least. Document frequencies
are counted for every shingle, once for each text, in a table dealt over the cluster; exact
counts of those in ``t`` texts or more reach the executors, and rarer ones weigh as those of
``t``. ``t`` is the number of all (text, shingle) pairs over ``FREQUENT``, so that at most
``FREQUENT`` shingles are kept: 1 (all counts exact) for small corpora, and else the same
share of the texts, about one in 10,000 for texts of 2.5 KB, however large the corpus.
In a text no shingle weighs more than its median one does: what a group of near copies shares
is as frequent as the group is large while each edit is unique, so plain idf would part near
copies the more, the more of them there are. Passages that are more frequent than most of
their text still weigh less than the rest of it.

Sketch. ICWS (Ioffe 2010): a sample agrees between two texts with a probability equal to
their weighted Jaccard similarity. ``BANDS`` bands of ``ROWS`` samples: a pair at 0.8 meets in
one band at least with probability 1 - (1 - 0.8^3)^12 > 0.9998.

Links. Texts with the same words are one node, so copies never pair up. In each bucket all
nodes are compared with its smallest node, by exact weighted Jaccard over whole texts. Links
found so far make components. A node of a bucket that is in another component than the
bucket's leader is compared further, with those nodes of other components that it can still
be linked to: the distance 1 - J is a metric, so the distances from the leader rule out most,
and their sketches most of the rest (a link is lost there with a chance of one in a million),
before whole texts are compared, likeliest first; what is connected meanwhile isn't compared.
Buckets of up to ``LOCAL_BYTES`` are finished so within one task; larger ones take another
round with a new leader first. No group is capped, and none is expanded into its pairs: only
links between components leave a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folianta.llm.common import cut, joined_by_hot_key, small_batches, slices, spread
from folianta.llm.components import components
from folianta.llm.wordkernel import Words, mix, shingles, words

#: Words of a shingle.
SHINGLE = 5
#: Weighted Jaccard similarity from which two texts are linked.
SIMILARITY = 0.8
#: Bands and samples in each.
BANDS, ROWS = 12, 3
#: Most shingles whose document frequency is kept: 20 MB, whatever the corpus.
FREQUENT = 1 << 22
#: Ids that a task gathers before it sorts and sends them.
GATHERED = 1 << 21
#: Buckets with at most so many bytes of content are finished within one task; larger ones take another round first.
LOCAL_BYTES = 32 << 20

_K = BANDS * ROWS
_RNG = np.random.Generator(np.random.PCG64(977))
_M1 = _RNG.integers(0, 2**63, _K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M2 = _RNG.integers(0, 2**63, _K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASK = np.uint64((1 << 21) - 1)
_BAND_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def ids_of(hashes: np.ndarray) -> np.ndarray:
    """All shingles of one text as 32-bit ids."""
    return (shingles(hashes, SHINGLE) >> np.uint64(32)).astype(np.uint32)


def counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids in rising order and how often each occurs."""
    if not len(ids):
        return ids, np.zeros(0, np.int64)
    ids = np.sort(ids)
    at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    return ids[at], np.diff(np.append(at, len(ids)))


@dataclass
class Idf:
    """Inverse document frequency of shingles: ``keys`` in rising order with ``values``; all others have ``rest``."""

    keys: np.ndarray
    values: np.ndarray
    rest: np.float32

    def __post_init__(self) -> None:
        self.mask = np.uint32((1 << max(10, (4 * len(self.keys)).bit_length())) - 1)
        self.known = np.zeros(int(self.mask) + 1, bool)
        self.known[self.keys & self.mask] = True

    def of(self, ids: np.ndarray) -> np.ndarray:
        out = np.full(len(ids), self.rest, np.float32)
        if len(self.keys):
            maybe = np.flatnonzero(self.known[ids & self.mask])
            at = np.minimum(np.searchsorted(self.keys, ids[maybe]), len(self.keys) - 1)
            hit = self.keys[at] == ids[maybe]
            out[maybe[hit]] = self.values[at[hit]]
        return out


def idf_of(ids: np.ndarray, counts: np.ndarray, n: int, least: int) -> Idf:
    """From the counts of all shingles in ``least`` texts or more (and maybe others), and the number of texts."""
    ids, counts = ids[counts >= least], counts[counts >= least]
    order = np.argsort(ids)
    return Idf(ids[order], (1 + np.log((1 + n) / (1 + counts[order]))).astype(np.float32), np.float32(1 + np.log((1 + n) / (1 + min(least, n)))))


def weights(ids: np.ndarray, tf: np.ndarray, idf: Idf) -> np.ndarray:
    """tf * idf, where no shingle counts as rarer than the text's typical one (its median by tf)."""
    rare = idf.of(ids)
    if len(ids):
        order = np.argsort(rare)
        upto = np.cumsum(tf[order], dtype=np.int64)
        rare = np.minimum(rare, rare[order[np.searchsorted(upto, (upto[-1] + 1) // 2)]])
    return tf.astype(np.float32) * rare


def icws(ids: np.ndarray, w: np.ndarray, step: int = 4096) -> np.ndarray:
    """The K samples of a weighted set as 64-bit values (shingle and level).

    For each sample and shingle: r, c ~ Gamma(2, 1) and b ~ U(0, 1) from the shingle's hash,
    t = floor(ln w / r + b), ln a = ln c - r (t - b) - r; the shingle with the smallest a and
    its level t are the sample.
    """
    best = np.full(_K, np.inf, np.float32)
    out = np.zeros(_K, np.uint64)
    every = np.arange(_K)
    for at in range(0, len(ids), step):
        h = mix(ids[at : at + step].astype(np.uint64) + np.uint64(0x51ED270B))[:, None]
        log_w = np.log(w[at : at + step])[:, None]
        x, y = h * _M1, h * _M2
        x ^= x >> np.uint64(32)
        unit = np.float32(1 / (1 << 21))
        field = lambda v, s: (((v >> np.uint64(s)) & _MASK).astype(np.float32) + np.float32(0.5)) * unit
        r = -np.log(field(x, 43) * field(x, 22))
        log_c = np.log(-np.log(field(x, 1) * field(y, 43)))
        b = field(y, 22)
        t = np.floor(log_w / r + b)
        log_a = log_c - r * (t - b + np.float32(1))
        i = log_a.argmin(0)
        low = log_a[i, every]
        better = low < best
        best = np.where(better, low, best)
        level = t[i, every].astype(np.int64).astype(np.uint64)
        out = np.where(better, mix(h[i, 0] + level * np.uint64(0x9E3779B97F4A7C15)), out)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    rows = samples.reshape(BANDS, ROWS)
    key = _BAND_SALT.copy()
    for j in range(ROWS):
        key = mix(key + rows[:, j])
    return key


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima; (ids in rising order, weights). Two empty texts: 1."""
    (ia, wa), (ib, wb) = a, b
    total = float(wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64))
    if not total:
        return 1.0
    at = np.searchsorted(ib, ia)
    hit = np.flatnonzero(at < len(ib))
    hit = hit[ib[at[hit]] == ia[hit]]
    low = float(np.minimum(wa[hit], wb[at[hit]]).sum(dtype=np.float64))
    return low / (total - low)


def node_of(hashes: np.ndarray) -> int:
    """Identity of a sequence of words."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def distinct_ids(found: Words) -> np.ndarray:
    """The ids of many texts, each once for each text that has it."""
    n = len(found.first) - 1
    lengths = np.diff(found.first)
    owner = np.repeat(np.arange(n, dtype=np.uint64), lengths)
    parts = [np.uint64(i) << np.uint64(32) | ids_of(found.of(i)).astype(np.uint64) for i in np.flatnonzero((lengths > 0) & (lengths < SHINGLE))]
    if len(owner) >= SHINGLE:
        inside = np.flatnonzero(owner[: len(owner) - SHINGLE + 1] == owner[SHINGLE - 1 :])
        parts.append(owner[inside] << np.uint64(32) | ids_of(found.hashes).astype(np.uint64)[inside])
    return (np.unique(np.concatenate(parts)) & np.uint64(0xFFFFFFFF)).astype(np.uint32) if parts else np.zeros(0, np.uint32)


def _packed(ids: np.ndarray) -> bytes:
    """Sorted ids byte by byte, which compresses to about half."""
    return ids.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _summed(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids in rising order with the sums of their counts."""
    order = np.argsort(ids, kind="stable")
    ids, counts = ids[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    return ids[at], np.add.reduceat(counts, at) if len(at) else counts


_COUNTS = "bucket int, ids binary, counts binary"


def _count_batch(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    bucket, ids, counts = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["bucket", "ids", "counts"])


def _frequencies(bits: int):
    """Ids of each bucket (their first ``bits`` bits) with counts, one for each text."""

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        ids, counts = counted(np.concatenate(held))
        ends = np.searchsorted(ids >> np.uint32(32 - bits), np.arange((1 << bits) + 1))
        pairs = [(k, a, b) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if a < b]
        return _count_batch([(k, _packed(ids[a:b]), counts[a:b].astype(np.uint32).tobytes()) for k, a, b in pairs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                held.append(distinct_ids(words(part.column("text"))))
                n += len(held[-1])
                if n >= GATHERED:
                    yield sent(held)
                    held, n = [], 0
        if n:
            yield sent(held)

    return run


def _frequent(least: int):
    """Of each bucket the ids with a count of ``least`` or more; and bucket -1 with the sum of all counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for _, held in _by_key(batches, ("ids", "counts"), "bucket"):
            ids, counts = _summed(np.concatenate([_unpacked(r[0]) for r in held]), np.concatenate([np.frombuffer(r[1], np.uint32) for r in held]).astype(np.int64))
            total += int(counts.sum())
            some = counts >= least
            if some.any():
                yield _count_batch([(0, ids[some].tobytes(), counts[some].tobytes())])
        if total:
            yield _count_batch([(-1, b"", np.array([total], np.int64).tobytes())])

    return run


def document_frequencies(texts: DataFrame, frequent: int = FREQUENT) -> Idf:
    """The idf of all shingles; at most some multiples of ``frequent`` counts reach the driver.

    A shingle occupies five bytes of text or so, and two at least; a first bound from the
    number of bytes keeps what is gathered small, the exact number of pairs then sets ``t``.
    """
    spark = texts.sparkSession
    n, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    least = max(1, int(size) // (8 * frequent))
    bits = min(16, max(6, math.ceil(math.log2(4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    partial = texts.select("text").mapInArrow(_frequencies(bits), _COUNTS)
    got = partial.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_frequent(least), _COUNTS).toArrow()
    raw = {c: got.column(c).to_pylist() for c in ("bucket", "ids", "counts")}
    total = sum(int(np.frombuffer(c, np.int64)[0]) for b, c in zip(raw["bucket"], raw["counts"], strict=True) if b < 0)
    some = [i for i, b in enumerate(raw["bucket"]) if b >= 0]
    ids = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(raw["ids"][i], np.uint32) for i in some)])
    counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(raw["counts"][i], np.int64) for i in some)])
    return idf_of(ids, counts, n, max(least, math.ceil(total / frequent), 1))


def _sketcher(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                found = words(part.column("text"))
                nodes, keys, sketches = [], [], []
                done: dict[int, tuple] = {}
                for i in range(part.num_rows):
                    hashes = found.of(i)
                    node = node_of(hashes)
                    if node not in done:
                        ids, tf = counted(ids_of(hashes))
                        samples = icws(ids, weights(ids, tf, idf)) if len(ids) else None
                        done[node] = (band_keys(samples).astype(np.int64).tolist(), samples.astype(np.uint32).tobytes()) if len(ids) else ([], b"")
                    nodes.append(node)
                    keys.append(done[node][0])
                    sketches.append(done[node][1])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("hash"), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["doc_id", "hash", "node", "bands", "sketch"])

    return run


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            found = words(part.column("text"))
            nodes, ids_out, tf_out = [], [], []
            for i in range(part.num_rows):
                hashes = found.of(i)
                ids, tf = counted(ids_of(hashes))
                nodes.append(node_of(hashes))
                ids_out.append(ids.tobytes())
                tf_out.append(b"" if (tf == 1).all() else tf.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(ids_out, pa.binary()), pa.array(tf_out, pa.binary())], names=["node", "ids", "tf"])


def unpack(ids: bytes, tf: bytes, idf: Idf) -> tuple[np.ndarray, np.ndarray]:
    """Ids and weights of a node's content."""
    i = np.frombuffer(ids, np.uint32)
    return i, weights(i, np.frombuffer(tf, np.uint32) if tf else np.ones(len(i), np.uint32), idf)


def _comparer(shared):
    """Similarity of each node to its leader, from groups (leader, salt) that begin with the leader's own content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        right = None
        for batch in batches:
            out = []
            for leader, member, node, ids, tf in zip(*(batch.column(x).to_pylist() for x in ("leader", "member", "node", "ids", "tf")), strict=True):
                if not member:
                    right = unpack(ids, tf, idf)
                else:
                    out.append((node, leader, weighted_jaccard(unpack(ids, tf, idf), right)))
            if out:
                a, b, sims = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sims, pa.float64())], names=["node", "leader", "sim"])

    return run


class Bucket:
    """The nodes of one bucket that may still be linked: what rules pairs out before whole texts are compared."""

    COLUMNS = ("node", "root", "open", "sim", "sketch", "bands")

    def __init__(self, key: int, rows: list[tuple], similarity: float) -> None:
        nodes, roots, opens, sims, sketches, bands = zip(*rows, strict=True)
        self.nodes, self.similarity = nodes, similarity
        #: number of each node's component, in the bucket
        self.part = np.unique(np.array(roots, np.int64), return_inverse=True)[1]
        self.opens, self.sims = np.array(opens, bool), np.array(sims)
        self.sketches = np.frombuffer(b"".join(sketches), np.uint32).reshape(-1, _K)
        self.bands = np.array(bands, np.int64)
        self.band = int(np.flatnonzero(self.bands[0] == key)[0])
        # linked texts agree in fewer samples than this (5 deviations) with a chance of one in a million or so
        self.least = max(0, int(np.floor(_K * similarity - 5 * np.sqrt(_K * similarity * (1 - similarity)))))

    def partners(self, i: int) -> np.ndarray:
        """Nodes that an open node may be linked to, those that agree most first.

        They are in another component, their distances from the bucket's leader differ by 1 - similarity
        at most, their sketches agree enough, and no earlier band has both (it has them there).
        """
        other = (self.part != self.part[i]) & (np.abs(self.sims - self.sims[i]) <= 1 - self.similarity + 1e-9)
        other[:i] &= ~self.opens[:i]
        near = np.flatnonzero(other)
        if self.band and len(near):
            near = near[~(self.bands[near, : self.band] == self.bands[i, : self.band]).any(1)]
        agree = (self.sketches[near] == self.sketches[i]).sum(1)
        near, agree = near[agree >= self.least], agree[agree >= self.least]
        return near[np.argsort(-agree, kind="stable")]

    def promising(self) -> np.ndarray:
        """Nodes with a partner."""
        out = np.zeros(len(self.nodes), bool)
        for i in np.flatnonzero(self.opens):
            if len(p := self.partners(i)):
                out[p] = out[i] = True
        return np.flatnonzero(out)

    def links(self, content) -> Iterator[tuple[int, int]]:
        """Links between components, by exact similarity; a pair that the links so far connect isn't compared."""
        for i in np.flatnonzero(self.opens):
            todo = self.partners(i)
            mine = content(i) if len(todo) else None
            while len(todo):
                j, todo = todo[0], todo[1:]
                if weighted_jaccard(mine, content(j)) >= self.similarity:
                    self.part[self.part == self.part[j]] = self.part[i]
                    todo = todo[self.part[todo] != self.part[i]]
                    yield self.nodes[i], self.nodes[j]


def _by_key(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], name: str = "key") -> Iterator[tuple[int, list[tuple]]]:
    """Groups of rows with the same key, from rows in the order of their keys."""
    key, held = None, []
    for b in batches:
        for k, *row in zip(*(b.column(c).to_pylist() for c in (name, *columns)), strict=True):
            if k != key:
                if held:
                    yield key, held
                key, held = k, []
            held.append(tuple(row))
    if held:
        yield key, held


def _in_batches(pairs: Iterator[tuple[int, int]], names: list[str]) -> Iterator[pa.RecordBatch]:
    while some := list(islice(pairs, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*some, strict=True)], names=names)


def _promising(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int]]:
            for key, held in _by_key(batches, Bucket.COLUMNS):
                bucket = Bucket(key, held, similarity)
                yield from ((key, bucket.nodes[i]) for i in bucket.promising())

        yield from _in_batches(rows(), ["key", "node"])

    return run


def _linking(similarity: float, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value

        def rows() -> Iterator[tuple[int, int]]:
            for key, held in _by_key(batches, (*Bucket.COLUMNS, "ids", "tf")):
                raw = [r[-2:] for r in held]
                yield from Bucket(key, [r[:-2] for r in held], similarity).links(lambda i, raw=raw: unpack(*raw[i], idf))

        yield from _in_batches(rows(), ["node", "root"])

    return run


def _identified(docs: DataFrame) -> list:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text")]


def classified(docs: DataFrame, similarity: float = SIMILARITY, local_bytes: int = LOCAL_BYTES, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, hash (of the text), class_id, class_size and kept of each row; see ``near_duplicates``."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(*_identified(docs))
    idf = spark.sparkContext.broadcast(document_frequencies(texts, frequent))
    sketched = cut(texts.mapInArrow(_sketcher(idf), "doc_id long, hash long, node long, bands array<long>, sketch binary"))
    # a node's copies shrink to one row before anything is joined; real ids come before null
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash"))
    per_node = cut(sketched.groupBy("node").agg(first.alias("first"), F.count("*").alias("copies")))

    # copies in one input split meet as one row
    members = sketched.select("node", F.explode("bands").alias("key")).distinct()
    shared_keys = members.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1")
    met = cut(joined_by_hot_key(members, shared_keys, "key", "n", "inner", "node").select("key", "node", "leader"))
    # whole texts of the nodes that meet another, one document for each
    active = met.select("node").distinct()
    firsts = per_node.join(active, "node", "left_semi").select(F.col("first.doc_id").alias("__id"), F.col("first.hash").alias("__hash"))
    contents = texts.join(firsts, (F.col("hash") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").mapInArrow(_contents, "node long, ids binary, tf binary")
    contents = cut(contents.dropDuplicates(["node"]))

    def compared(pairs: DataFrame) -> DataFrame:
        """The similarity of each node to its leader, whose content goes out once for every some hundred of its nodes."""
        pairs = cut(pairs)
        led = pairs.groupBy("leader").agg(F.count("*").alias("n"))
        salted, once = spread(pairs, led, "leader", "n", "node")
        mine = salted.join(contents, "node").select("leader", "salt", F.lit(1).alias("member"), "node", "ids", "tf")
        heads = once.join(contents.withColumnRenamed("node", "leader"), "leader").select("leader", "salt", F.lit(0).alias("member"), F.col("leader").alias("node"), "ids", "tf")
        dealt = mine.union(heads).repartition("leader", "salt").sortWithinPartitions("leader", "salt", "member")
        return cut(dealt.select("leader", "member", "node", "ids", "tf").mapInArrow(_comparer(idf), "node long, leader long, sim double"))

    one_each = sketched.select("node", "sketch", "bands").join(active, "node", "left_semi").dropDuplicates(["node"])
    sizes = contents.select("node", (F.octet_length("ids") + F.octet_length("tf") + 400).alias("bytes"))
    stars, roots = met, None
    while True:
        sims = compared(stars.filter("node <> leader").select("node", "leader").distinct())
        found = sims.filter(F.col("sim") >= similarity).select("node", "leader")
        roots = components(found if roots is None else found.union(roots.select("node", "root")), "node", "leader")
        # open: outside the component of the bucket's leader; whatever else isn't linked yet lies beside one of these
        own = roots.withColumnRenamed("root", "own")
        lead = roots.select(F.col("node").alias("leader"), F.col("root").alias("lead"))
        beside = sims.join(own, "node", "left").join(sizes, "node")
        led = sims.groupBy("leader").agg(F.count("*").alias("n")).join(lead, "leader", "left")
        beside = joined_by_hot_key(beside, led, "leader", "n", "left", "node").drop("n")
        beside = beside.select("node", "leader", F.coalesce("own", "node").alias("root"), (F.coalesce("own", "node") != F.coalesce("lead", "leader")).alias("open"), "sim", "bytes")
        seen = stars.filter("node <> leader").join(beside, ["node", "leader"])
        whole = seen.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("total"), F.min(F.when(F.col("open"), F.col("node"))).alias("next"))
        rest = cut(joined_by_hot_key(seen.drop("leader"), whole.filter("n > 1 AND next IS NOT NULL"), "key", "n", "inner", "node").withColumnRenamed("next", "leader"))
        here = rest.filter(F.col("total") <= local_bytes).join(one_each, "node").select("key", *Bucket.COLUMNS)
        some = here.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_promising(similarity), "key long, node long")
        full = here.join(some, ["key", "node"]).join(contents, "node").select("key", *Bucket.COLUMNS, "ids", "tf")
        close = cut(full.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_linking(similarity, idf), "node long, root long"))
        roots = components(roots.select("node", "root").union(close), "node", "root")
        stars = rest.filter(F.col("total") > local_bytes).select("key", "node", "leader")
        if not stars.limit(1).count():
            break

    of_node = per_node.join(roots, "node", "left").select("node", "first", "copies", F.coalesce("root", "node").alias("root"))
    classes = of_node.groupBy("root").agg(F.min("first").alias("rep"), F.sum("copies").alias("class_size"), F.count("*").alias("nodes"))
    of_node = cut(joined_by_hot_key(of_node, classes, "root", "nodes", "inner", "node").select("node", "copies", "rep", "class_size"))
    rows = joined_by_hot_key(sketched.select("doc_id", "hash", "node"), of_node, "node", "copies", "inner", "doc_id", "hash")
    kept = F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("hash") == F.col("rep.hash"))
    return rows.select("doc_id", "hash", F.col("rep.doc_id").alias("class_id"), "class_size", kept.alias("kept"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, local_bytes: int = LOCAL_BYTES, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest doc_id of its class), class_size, kept.

    A class is a connected component of links between texts of weighted Jaccard similarity
    ``similarity`` or more. Null text counts as empty; texts without words are one class; texts
    shorter than a shingle are one shingle. Null ids lose to others; repeated rows (same id
    and text) share a class, count each and are kept or dropped alike; rows with the same
    id and other texts are told apart by their texts. Other columns are ignored; an empty table gives no rows.
    """
    return classified(docs, similarity, local_bytes, frequent).drop("hash")


def keep_one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: one of each class, the smallest doc_id.

    Null text counts as empty, and a null id loses to others. Of rows that repeat id and text
    one stays (the row limit acts before the shuffle). An empty table gives no rows.
    """
    kept = classified(docs, similarity).filter("kept").select(F.col("doc_id").alias("__folianta_id"), F.col("hash").alias("__folianta_hash"))
    _, hashed, _ = _identified(docs)
    marked = docs.withColumns({"__folianta_a": F.col("doc_id").cast("long"), "__folianta_b": hashed})
    place = F.row_number().over(Window.partitionBy("__folianta_a", "__folianta_b").orderBy(F.lit(0)))
    single = marked.withColumn("__folianta_n", place).filter("__folianta_n = 1")
    same = F.col("__folianta_a").eqNullSafe(F.col("__folianta_id")) & (F.col("__folianta_b") == F.col("__folianta_hash"))
    return single.join(kept, same, "left_semi").drop("__folianta_a", "__folianta_b", "__folianta_n")
