"""Exact dedup by Patricia-trie owners.

Texts meet in partitions dealt by length and content hash. There the full byte strings go
into a compressed radix trie; a terminal node keeps the smallest identifier and the number
of rows of its text, so equality is decided by bytes, never by a hash alone.

Two tries work in turn. The first runs inside each input partition, before any shuffle: a
text with a billion copies leaves each partition as one entry. It holds at most
``trie_bytes`` of text; beyond that its heaviest subtree goes to the shuffle as it is and is
freed, as the second trie adds partial entries up. The second reads its partition in byte
order (Spark's spilling sort), so that only the path to the newest key stays open: what lies
left of it is a finished subtree, given out and dropped at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folianta.llm.common import small_batches, slices, text_array

#: Bytes of text that the trie of one map task holds before a subtree goes to the shuffle.
TRIE_BYTES = 48 << 20

_SPACES = frozenset(b" \t\n\v\f\r")


def normalise(text: bytes) -> bytes:
    """Each run of the six ASCII spaces as one space."""
    if not text:
        return text
    inner = b" ".join(text.split())
    head = b" " if text[0] in _SPACES else b""
    tail = b" " if inner and text[-1] in _SPACES else b""
    return head + inner + tail


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving: each step compares slices in C."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Node:
    """label: bytes on the edge into this node; owner: smallest id of the text that ends here."""

    __slots__ = ("children", "count", "label", "owner", "weight")

    def __init__(self, label: bytes) -> None:
        self.label, self.children, self.owner, self.count, self.weight = label, {}, None, 0, 0

    def own(self, owner: int | None, count: int) -> None:
        if self.count == 0 or (owner is not None and (self.owner is None or owner < self.owner)):
            self.owner = owner
        self.count += count


class PatriciaTrie:
    """A compressed radix trie over byte strings."""

    def __init__(self) -> None:
        self.root = Node(b"")

    @property
    def weight(self) -> int:
        """Bytes on the edges."""
        return self.root.weight

    def insert(self, key: bytes, owner: int | None, count: int = 1) -> None:
        node, at, path = self.root, 0, [self.root]
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                leaf = node.children[key[at]] = Node(key[at:])
                leaf.own(owner, count)
                leaf.weight = len(leaf.label)
                for x in path:
                    x.weight += leaf.weight
                return
            label = child.label
            if not key.startswith(label, at):
                shared = common_prefix(label, key[at : at + len(label)])
                upper = Node(label[:shared])
                upper.weight = child.weight
                child.label = label[shared:]
                child.weight -= shared
                upper.children[child.label[0]] = child
                node.children[key[at]] = upper
                child = upper
            at += len(child.label)
            node = child
            path.append(child)
        node.own(owner, count)

    def _terminals(self, node: Node, prefix: bytes) -> Iterator[tuple[bytes, int | None, int]]:
        stack = [(node, prefix)]
        while stack:
            x, before = stack.pop()
            key = before + x.label
            if x.count:
                yield key, x.owner, x.count
            stack += [(c, key) for c in x.children.values()]

    def spill(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Take out the root's heaviest subtree and give its terminals."""
        if not self.root.children:
            return
        first, child = max(self.root.children.items(), key=lambda x: x[1].weight)
        del self.root.children[first]
        self.root.weight -= child.weight
        yield from self._terminals(child, b"")

    def finished(self, key: bytes) -> Iterator[tuple[bytes, int | None, int]]:
        """In byte order: take out what no later key can reach, everything but the path to ``key``."""
        node, at = self.root, 0
        path = [self.root]
        while node is not None:
            done = {b: c for b, c in node.children.items() if at >= len(key) or b != key[at]}
            for b, c in done.items():
                del node.children[b]
                for x in path:
                    x.weight -= c.weight
                yield from self._terminals(c, key[:at])
            child = node.children.get(key[at]) if at < len(key) else None
            if child is not None and not key.startswith(child.label, at):
                child = None
            if node.count and node is not self.root and child is not None and at < len(key):
                yield key[:at], node.owner, node.count
                node.count, node.owner = 0, None
            if child is not None:
                at += len(child.label)
                path.append(child)
            node = child

    def drain(self) -> Iterator[tuple[bytes, int | None, int]]:
        """All terminals; the trie is empty afterwards."""
        root, self.root = self.root, Node(b"")
        yield from self._terminals(root, b"")


_ENTRY = pa.schema([("length", pa.int64()), ("content", pa.int64()), ("body", pa.large_binary()), ("owner", pa.int64()), ("copies", pa.int64())])
_OWNER = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
_MEMBER = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string())])


def _content_hash(body: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True)


def _as_batches(rows: Iterator[tuple], schema: pa.Schema, of_bytes: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of some 4 MB."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + (len(row[of_bytes]) if of_bytes is not None else 0)
        if size >= 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _local_entries(trie_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            trie = PatriciaTrie()
            for batch in batches:
                for part in slices(batch, "text"):
                    texts = text_array(part.column("text")).cast(pa.large_binary()).to_pylist()
                    for doc, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                        trie.insert(normalise(text), doc)
                    while trie.weight > trie_bytes:
                        yield from trie.spill()
            yield from trie.drain()

        yield from _as_batches(((len(k), _content_hash(k), k, owner, n) for k, owner, n in rows()), _ENTRY, 2)

    return run


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        trie, last = PatriciaTrie(), None
        for batch in batches:
            for body, owner, n in zip(batch.column("body").to_pylist(), batch.column("owner").to_pylist(), batch.column("copies").to_pylist(), strict=True):
                if body != last:
                    yield from trie.finished(body)
                    last = body
                trie.insert(body, owner, n)
        yield from trie.drain()

    yield from _as_batches(((hashlib.sha256(k).hexdigest(), owner, n) for k, owner, n in rows()), _OWNER)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts = text_array(part.column("text")).cast(pa.large_binary()).to_pylist()
            shas = [hashlib.sha256(normalise(t)).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(shas, pa.string())], schema=_MEMBER)


def owners(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct normalised text: text_sha256, keep_id (smallest doc_id), group_size."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    entries = narrow.mapInArrow(_local_entries(trie_bytes), "length long, content long, body binary, owner long, copies long")
    dealt = entries.repartition("length", "content").sortWithinPartitions("body")
    return dealt.select("body", "owner", "copies").mapInArrow(_owners, "text_sha256 string, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and all empty texts are one group. A null doc_id loses to any
    other; a group of null ids only has keep_id null and keeps its rows. Rows that repeat
    both id and text are all kept when theirs is the smallest id. Other columns are ignored.
    An empty table gives an empty result.

    Only groups of two or more meet the rows again, on the SHA-256 of the text the trie
    decided on; adaptive skew joins split a hot group's rows, as the owners' side has one.
    """
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    groups = owners(docs, trie_bytes).filter("group_size > 1")
    rows = narrow.mapInArrow(_members, "doc_id long, text_sha256 string")
    joined = rows.join(groups, "text_sha256", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )
