"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Words are maximal runs of letters and digits of the lower-cased text. A window of ``SPAN`` words
splits into five blocks; each of ten fixed masks keeps three blocks and ignores two. Any two
substituted words lie in two blocks at most, so at least one mask doesn't see them: a window
with up to ``MISSES`` substitutions always meets its benchmark window under some mask.

Hits are joined on the masked hash, and each is verified on the words of the two windows
themselves: a document is contaminated where ``SPAN`` consecutive words of it and of a benchmark
text agree in ``SPAN - MISSES`` places or more. The result is exact under that definition, since
every such window is itself a hit.

Before the join, a bitmap of the benchmark's hashes (sized by their number, 8 MB at most) drops
nearly all windows of the corpus inside the scan's own stage. A window that passes takes its own
words along, so no text is shuffled: what moves grows with the hits.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folianta.llm.common import cut

#: Words of a window.
SPAN = 13
#: Substitutions that a window may have.
MISSES = 2
#: Fixed blocks of places in a window; a mask ignores two of them.
BLOCKS = ((0, 1, 2), (3, 4, 5), (6, 7, 8), (9, 10), (11, 12))
#: Kept blocks of each mask.
MASKS = tuple(combinations(range(5), 3))
#: Words of 64 bits in the bitmap: least and most, and bits for each hash between them.
BITMAP_WORDS = (1 << 12, 1 << 20)
BITS_PER_HASH = 32
#: Contaminated rows of at most so many (16 bytes each, counted) are broadcast where rows are dropped.
BROADCAST_ROWS = 1 << 19

_SPLIT = r"[^\p{L}\p{N}]+"


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text, in order; null and wordless texts give an empty array."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), _SPLIT)
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seeds(df: DataFrame, keep: list[str]) -> DataFrame:
    """(mask, hash) rows of all windows, with their place ``pos``; ``df`` has the array ``w``.

    Hashes of blocks carry the block's number, and a mask's hash is the exclusive or of its three
    blocks. The masks come from a generator, so that no later filter is pushed to where it
    would compute every block again.
    """
    # no filter on the size, which would hash the words once more
    starts = F.when(F.size("w") >= SPAN, F.sequence(F.lit(0), F.size("w") - SPAN))
    at = df.select(*keep, "w", F.explode(starts).alias("pos"))
    blocks = [F.xxhash64(*[F.get("w", F.col("pos") + p) for p in block], F.lit(i)).alias(f"b{i}") for i, block in enumerate(BLOCKS)]
    masks = F.array(*[F.col(f"b{a}").bitwiseXOR(F.col(f"b{b}")).bitwiseXOR(F.col(f"b{c}")) for a, b, c in MASKS])
    return at.select(*keep, "w", "pos", *blocks).select(*keep, "w", "pos", F.posexplode(masks).alias("mask", "hash"))


def _window() -> Column:
    return F.slice("w", F.col("pos") + 1, SPAN)


def _bits(hash_: Column, n_words: int) -> list[tuple[Column, Column]]:
    """Two places of a hash in the bitmap, each as a word and a mask in it."""
    places = (hash_, F.shiftrightunsigned(hash_, 32))
    word = [F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(n_words - 1)).cast("int") for h in places]
    return [(w, F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(F.lit(63)).cast("int"))) for w, h in zip(word, places, strict=True)]


def bitmap_words(hashes: int) -> int:
    """Words of a bitmap for so many hashes: a power of two."""
    low, high = BITMAP_WORDS
    return min(high, max(low, 1 << (hashes * BITS_PER_HASH // 64).bit_length()))


def bitmap_of(seeds: DataFrame, n_words: int) -> DataFrame:
    """One row with ``bits``: ``n_words`` longs in order, two bits set for each hash; all zero without seeds."""
    both = F.array(*[F.struct(w.alias("word"), b.alias("bit")) for w, b in _bits(F.col("hash"), n_words)])
    filled = seeds.select(F.explode(both).alias("x")).select("x.word", "x.bit")
    empty = seeds.sparkSession.range(n_words, numPartitions=1).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("bigint").alias("bit"))
    every = filled.union(empty).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return every.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("held")).select(F.transform("held", lambda x: x["bits"]).alias("bits"))


def _identity() -> list[Column]:
    """What tells rows apart, of any id: the id and a hash of the text."""
    return [F.col("doc_id").cast("long").alias("__id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("__hash")]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(__id, __hash, item_id) once for each row (its doc_id and a hash of its text) that overlaps a benchmark text.

    Null texts, texts and items of fewer than SPAN words and items without an id never match. Rows
    with a null doc_id count as others; repeated rows give one pair; rows with the same id
    and other texts are judged each by its own.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text").cast("string")).alias("w"))
    starts = F.when(F.size("w") >= SPAN, F.sequence(F.lit(0), F.size("w") - SPAN))
    places = items.filter("item_id IS NOT NULL").select("item_id", "w", F.explode(starts).alias("pos")).select("item_id", _window().alias("window"))
    # windows that many items share are one row of the join
    windows = cut(places.select("item_id", "window", F.xxhash64("window").alias("window_id")).distinct())
    once = windows.select("window", "window_id").distinct()
    seeds = cut(_seeds(once.withColumnRenamed("window", "w"), ["window_id"]).select("mask", "hash", "window_id", F.col("w").alias("item_window")))
    n_words = bitmap_words(seeds.count())
    bits = cut(bitmap_of(seeds, n_words)).scalar()
    texts = docs.select(*_identity(), F.col("text").cast("string").alias("text"))
    (w1, b1), (w2, b2) = _bits(F.col("hash"), n_words)
    probes = _seeds(texts.select("__id", "__hash", word_hashes(F.col("text")).alias("w")), ["__id", "__hash"])
    probes = probes.filter((F.get(bits, w1).bitwiseAND(b1) != 0) & (F.get(bits, w2).bitwiseAND(b2) != 0))
    probes = probes.select("__id", "__hash", "mask", "hash", _window().alias("window"))
    same = F.aggregate(F.zip_with("window", "item_window", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda a, x: a + x)
    hits = probes.join(seeds, ["mask", "hash"]).filter(same >= SPAN - MISSES).select("__id", "__hash", "window_id").distinct()
    return hits.join(windows.select("window_id", "item_id"), "window_id").select("__id", "__hash", "item_id").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated, n_items, items (ids in order, comma-joined).

    Documents without an overlap and null texts have n_items 0 and items ''; null and
    repeated ids are judged by their own texts. An empty table gives no rows.
    """
    found = contaminated(docs, benchmark).groupBy("__id", "__hash").agg(F.sort_array(F.collect_set("item_id")).alias("held"))
    found = found.select(F.col("__id").alias("__a"), F.col("__hash").alias("__b"), "held")
    rows = docs.select(*_identity()).join(found, (F.col("__hash") == F.col("__b")) & F.col("__id").eqNullSafe(F.col("__a")), "left")
    return rows.select(
        F.col("__id").alias("doc_id"),
        F.col("held").isNotNull().alias("contaminated"),
        F.coalesce(F.size("held"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join(F.transform("held", lambda x: x.cast("string")), ","), F.lit("")).alias("items"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without an overlap, with its columns; rows of any id, null too, are judged by their texts.

    Null and empty texts stay, repeated rows stay or go together, and an empty table gives no rows. Few contaminated
    rows, which are counted, are broadcast, so that the rest of the corpus isn't shuffled.
    """
    found = cut(contaminated(docs, benchmark).select(F.col("__id").alias("__folianta_id"), F.col("__hash").alias("__folianta_hash")).distinct())
    side = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    own_id, own_hash = F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(side, (own_hash == F.col("__folianta_hash")) & own_id.eqNullSafe(F.col("__folianta_id")), "left_anti")
