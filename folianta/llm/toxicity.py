"""Toxicity scores by a factorization machine over hashed terms.

Each text is the set of its hashed words. The score is the logistic of
``b + sum w_i + sum_{i<j} <v_i, v_j>``: beside additive weights, every pair of terms has an
interaction, the product of two short learned vectors, so that an insult next to a mention
of a group can count for more than both alone. Training runs on the driver over a bounded
sample of labelled rows; scoring is one vectorised pass over every whole text. Terms without
any bearing of their own have a vector where rows that didn't train it bear it out, so that pairs
of terms that are neutral alone count too, and chance doesn't.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folianta.llm.common import cut, small_batches, slices
from folianta.llm.wordkernel import words

#: Hashed terms.
DIMENSIONS = 1 << 18
#: Length of the interaction vectors.
FACTORS = 4
#: At most about this many labelled rows train the model, taken by a hash of the id.
TRAIN_ROWS = 20_000
#: Terms in fewer training texts than this carry no weight.
MIN_TEXTS = 5
#: At most about so many bytes of hashed terms train the model.
TRAIN_BYTES = 64 << 20
#: Terms whose share of toxic texts is nearer to the overall share than so many deviations have no bearing alone.
SCREEN = 4.0
#: The other terms keep their weights if their interactions explain what is left on unseen rows, by so many deviations.
EVIDENCE = 4.0
#: L2 on the vectors: of terms with a bearing alone, and of the others while evidence for them is sought.
DECAY, SEEK_DECAY = 0.02, 0.75
#: Score from which a text is predicted toxic.
THRESHOLD = 0.3


@dataclass
class Model:
    """bias, and for each term frequent enough its place, linear weight and interaction vector."""

    bias: float
    place: np.ndarray
    linear: np.ndarray
    vectors: np.ndarray

    def scores(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        """Scores of n texts; (rows, terms): the distinct terms of each, as places."""
        z = np.full(n, self.bias)
        if len(rows):
            z += np.bincount(rows, self.linear[terms], n)
            for f in range(self.vectors.shape[1]):
                v = self.vectors[terms, f]
                z += 0.5 * (np.bincount(rows, v, n) ** 2 - np.bincount(rows, v * v, n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, term) for the distinct hashed terms of each text, ordered, and the number of texts."""
    found = words(texts)
    n = len(found.first) - 1
    rows = np.repeat(np.arange(n, dtype=np.int64), np.diff(found.first))
    keys = np.unique(rows * DIMENSIONS + (found.hashes & np.uint64(DIMENSIONS - 1)).astype(np.int64))
    return keys // DIMENSIONS, keys % DIMENSIONS, n


def _descend(starts: np.ndarray, ids: np.ndarray, labels: np.ndarray, some_rows: np.ndarray, alone: np.ndarray, bias: float, factors: int, epochs: int, seed: int, decay: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, linear weights and vectors of the terms 0 to len(alone) - 1, from ``some_rows``.

    Adagrad on the logistic loss, with L1 on the linear weights, which only ``alone`` terms have, and L2 on the vectors.
    """
    rng = np.random.default_rng(seed)
    n = len(alone)
    w, v = np.zeros(n), rng.normal(0, 0.02, (n, factors))
    gw, gv, gb = np.full(n, 1e-2), np.full((n, factors), 1e-1), 1.0
    lengths = np.diff(starts)
    for epoch in range(epochs):
        order = rng.permutation(some_rows)
        rate = 0.3 if epoch < epochs - 3 else 0.1
        for at in range(0, len(order), 512):
            some = order[at : at + 512]
            size = lengths[some]
            if not size.sum():
                continue
            local = np.repeat(np.arange(len(some)), size)
            first = np.repeat(starts[some] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
            t = ids[np.arange(size.sum()) + first]
            vt = v[t]
            sums = np.stack([np.bincount(local, vt[:, f], len(some)) for f in range(factors)], 1)
            squares = np.bincount(local, (vt * vt).sum(1), len(some))
            z = bias + np.bincount(local, w[t], len(some)) + 0.5 * ((sums**2).sum(1) - squares)
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]
            e = error[local]
            touched, inverse = np.unique(t, return_inverse=True)
            g = np.bincount(inverse, e, len(touched)) / len(some) * 32
            gw[touched] += g * g
            step = rate / np.sqrt(gw[touched])
            moved = w[touched] - step * g
            w[touched] = np.where(alone[touched], np.sign(moved) * np.maximum(0, np.abs(moved) - step * 0.01), 0)
            d = e[:, None] * (sums[local] - vt)
            for f in range(factors):
                gf = np.bincount(inverse, d[:, f], len(touched)) / len(some) * 32 + decay[touched] * v[touched, f]
                gv[touched, f] += gf * gf
                v[touched, f] -= 0.3 * rate / np.sqrt(gv[touched, f]) * gf
            gb += float(error.mean()) ** 2 * 32
            bias -= rate / np.sqrt(gb) * float(error.mean())
    return float(bias), w, v


def _compact(starts: np.ndarray, ids: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with the terms of the mask ``keep`` only, renumbered."""
    use = keep[ids]
    ends = np.concatenate([[0], np.cumsum(use)])
    return ends[starts], (np.cumsum(keep) - 1)[ids[use]].astype(np.int32)


def _interacting(starts: np.ndarray, ids: np.ndarray, labels: np.ndarray, alone: np.ndarray, bias: float, factors: int, seed: int) -> np.ndarray:
    """Mask of the terms without bearing alone whose interactions are borne out on rows that didn't train them.

    A machine with vectors for every term is trained on four fifths of the rows. On the rest, a
    term's interactions (its vector times the sum of the others in a text) are held against what a machine of
    the ``alone`` terms leaves unexplained, as a score statistic: by chance it is standard normal.
    """
    n = len(labels)
    unseen = np.arange(n) % 5 == 4
    train, test = np.flatnonzero(~unseen), np.flatnonzero(unseen)
    own_starts, own_ids = _compact(starts, ids, alone)
    b0, w0, v0 = _descend(own_starts, own_ids, labels, train, np.ones(alone.sum(), bool), bias, factors, 12, seed, np.full(alone.sum(), DECAY))
    p = _model_scores(b0, w0, v0, own_starts, own_ids)[test]
    _, _, v = _descend(starts, ids, labels, train, alone, bias, factors, 12, seed, np.where(alone, DECAY, SEEK_DECAY))
    top, spread = np.zeros(len(alone)), np.zeros(len(alone))
    residual, variance = labels[test] - p, p * (1 - p)
    for at in range(0, len(test), 512):
        some = test[at : at + 512]
        size = starts[some + 1] - starts[some]
        local = np.repeat(np.arange(len(some)), size)
        first = np.repeat(starts[some] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        t = ids[np.arange(size.sum()) + first]
        vt = v[t]
        sums = np.stack([np.bincount(local, vt[:, f], len(some)) for f in range(factors)], 1)
        q = (vt * (sums[local] - vt)).sum(1)
        top += np.bincount(t, q * residual[at : at + 512][local], len(alone))
        spread += np.bincount(t, q * q * variance[at : at + 512][local], len(alone))
    return ~alone & (top >= EVIDENCE * np.sqrt(spread)) & (spread > 0)


def _model_scores(bias: float, w: np.ndarray, v: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return Model(bias, np.zeros(0, np.int32), w, v).scores(rows, ids, len(starts) - 1)


def fit(rows: np.ndarray, terms: np.ndarray, labels: np.ndarray, factors: int = FACTORS, epochs: int = 20, seed: int = 7) -> Model:
    """A machine over the terms that have a bearing alone (by the binomial z-score of label 1 among
    their texts) and those that have one in company (``_interacting``).

    Among tens of thousands of terms without any bearing, weights learned from chance would drown the
    others. One class only, or no rows: a constant score, the smoothed share of label 1.
    """
    n = len(labels)
    positives = float(labels.sum())
    prior = (positives + 0.02) / (n + 1)
    bias = float(np.log(prior / (1 - prior)))
    place = np.full(DIMENSIONS, -1, np.int32)
    counts = np.bincount(terms, minlength=DIMENSIONS) if len(terms) else np.zeros(DIMENSIONS, np.int64)
    toxic = np.bincount(terms, labels[rows], minlength=DIMENSIONS) if len(terms) else counts
    z = (toxic - counts * prior) / np.sqrt(np.maximum(counts, 1) * prior * (1 - prior))
    # a term of nearly all texts, or of a few, pairs with nothing that its partner alone wouldn't say
    kept = np.flatnonzero((counts >= MIN_TEXTS) & ((counts <= n - MIN_TEXTS) | (np.abs(z) >= SCREEN)))
    if not len(kept) or positives in (0, n):
        return Model(bias, place, np.zeros(0), np.zeros((0, factors)))
    alone = (np.abs(z) >= SCREEN)[kept]
    place[kept] = np.arange(len(kept))
    use = place[terms] >= 0
    rows, ids = rows[use], place[terms[use]]
    del terms, use
    starts = np.searchsorted(rows, np.arange(n + 1, dtype=rows.dtype))
    del rows
    chosen = alone | _interacting(starts, ids, labels, alone, bias, factors, seed) if not alone.all() else alone
    place[:] = -1
    place[kept[chosen]] = np.arange(chosen.sum())
    starts, ids = _compact(starts, ids, chosen)
    # an exclusive pair needs linear weights that its interaction takes back
    bias, linear, vectors = _descend(starts, ids, labels, np.arange(n), np.ones(chosen.sum(), bool), bias, factors, epochs, seed, np.full(chosen.sum(), DECAY))
    return Model(bias, place, linear, vectors)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            rows, terms, n = terms_of(part.column("text"))
            ends = np.searchsorted(rows, np.arange(n + 1))
            packed = [terms[a:b].astype(np.int32).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic").cast(pa.int32()), pa.array(packed, pa.binary())], names=["doc_id", "toxic", "terms"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES) -> Model:
    """A model from labelled rows that aren't held out, about ``max_rows`` and ``max_bytes`` of their terms at most.

    Several labels of one document count as toxic if one of them is; null labels and ids don't count.
    """
    small_batches(docs.sparkSession)
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = marked.count()
    if n > max_rows:
        marked = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * (max_rows / n)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    encoded = cut(texts.join(marked, "doc_id").select("doc_id", "toxic", "text").mapInArrow(_encode, "doc_id long, toxic int, terms binary"))
    share = 1.0
    while (size := encoded.agg(F.sum(F.octet_length("terms"))).first()[0] or 0) > max_bytes:
        share *= 0.9 * max_bytes / size
        encoded = encoded.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < int((1 << 30) * share))
    got = encoded.toArrow()
    if not got.num_rows:
        return fit(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    column = got.column("terms").cast(pa.large_binary()).combine_chunks()
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1] // 4
    every = np.frombuffer(column.buffers()[2], np.int32) if column.buffers()[2] else np.zeros(0, np.int32)
    lengths = np.diff(offsets)
    order = np.lexsort((lengths, got.column("doc_id").to_numpy()))  # the order of arrival mustn't matter
    marks = got.column("toxic").to_numpy()[order].astype(float)
    every = np.concatenate([every[offsets[i] : offsets[i + 1]] for i in order])
    lengths = lengths[order]
    del got, column, offsets  # the driver is small, and fitting needs none of them
    return fit(np.repeat(np.arange(len(order), dtype=np.int32), lengths), every, marks)


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                found = words(part.column("text"))
                n = len(found.first) - 1
                at = model.place[(found.hashes & np.uint64(DIMENSIONS - 1)).astype(np.int64)]
                rows = np.repeat(np.arange(n, dtype=np.int64), np.diff(found.first))[at >= 0]
                keys = np.unique(rows * DIMENSIONS + at[at >= 0])
                score = model.scores(keys // DIMENSIONS, keys % DIMENSIONS, n)
                columns = [part.column(i) for i, name in enumerate(part.schema.names)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score, pa.float64())], names=[*part.schema.names, "__folianta_score"])

    return run


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (0 or 1).

    Every whole text is scored, null as the empty text, which gets the bias alone. Ids, labels
    and other columns never enter a score, and repeated rows score alike.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _scorer(shared)(batches):
            yield out.select(["doc_id", "__folianta_score"])

    scored = narrow.mapInArrow(run, "doc_id long, __folianta_score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__folianta_score").alias("score"), (F.col("__folianta_score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` below the threshold, with the columns of ``docs``.

    Null text counts as empty and has the bias as its score; ids play no part, so null and repeated ones
    are kept or dropped by their own texts. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _scorer(shared)(batches):
            yield out.filter(pc.less(out.column(out.num_columns - 1), threshold)).select(out.schema.names[:-1])

    return docs.mapInArrow(run, docs.schema)
