"""Chat formatting by token-level assembly.

Each segment (a role, a text) is encoded on its own; the template's marks are reserved ids that
no text can produce, spliced between the segments. The loss mask is the prefix sum of +1 at the
start and -1 at the end of each learned segment. Control strings that occur inside a text are
escaped with a backslash before encoding, so that the rendered string is unambiguous too, and
reading back takes exactly one backslash away.

A conversation leaves in parts of bounded size, in order, so that one with millions of turns
needs no more memory than one with two.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folianta.llm.common import slices, small_batches

#: Vocabulary file (ranks) of the tokenizer, by default the public one of this machine.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: pre-tokenisation pattern published with that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Rendered marks of a turn; their reserved ids follow the vocabulary's last id in this order.
OPEN, MIDDLE, CLOSE = "### ", ":\n", "</turn>\n"
#: Strings that texts and roles may hold only in escaped form.
CONTROL = re.compile(r"(### |</turn>)")
_ESCAPED = re.compile(r"\\(### |</turn>)")
#: Roles whose texts the loss mask covers.
LEARNED = ("assistant",)
#: Tokens after which a conversation goes on in another part; a part ends at a turn's end.
PART_TOKENS = 1 << 16

FORMATTED = "conv_id long, part int, n_turns long, ids array<int>, mask binary"


def escape(text: str) -> str:
    """One backslash before each control string."""
    return CONTROL.sub(r"\\\1", text)


def unescape(text: str) -> str:
    """The inverse of ``escape``."""
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Template:
    """Encodes and decodes with one vocabulary; ``raw`` is its file's content."""

    raw: bytes

    def __post_init__(self) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in self.raw.splitlines() if line)}
        self.encoding = tiktoken.Encoding("folianta", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        base = max(ranks.values()) + 1
        self.open, self.middle, self.close = base, base + 1, base + 2
        self.marks = {self.open: OPEN, self.middle: MIDDLE, self.close: CLOSE}

    def turns(self, turns: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of turns (role, text): open, role, middle, text, close for each."""
        return self.encoded(turns)[:2]

    def encoded(self, turns: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``turns`` and where each turn begins and ends, one call of the encoder for all segments."""
        segments: list[list[int]] = []
        learned: list[bool] = []
        flat = [x for role, text in turns for x in (escape(role), escape(text))]
        encoded = self.encoding.encode_ordinary_batch(flat, num_threads=1)
        for i, (role, _) in enumerate(turns):
            segments += [[self.open], encoded[2 * i], [self.middle], encoded[2 * i + 1], [self.close]]
            learned += [False, False, False, role in LEARNED, False]
        lengths = np.array([len(s) for s in segments], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        ids = np.fromiter((t for s in segments for t in s), np.int32, starts[-1])
        steps = np.zeros(starts[-1] + 1, np.int32)
        on = np.array(learned, bool)
        np.add.at(steps, starts[:-1][on], 1)
        np.add.at(steps, starts[1:][on], -1)
        return ids, np.cumsum(steps[:-1]).astype(np.uint8), starts[::5]

    def text(self, ids: np.ndarray) -> str:
        """Ordinary ids as text."""
        return self.encoding.decode_bytes(ids.tolist()).decode("utf-8")

    def render(self, ids: np.ndarray) -> str:
        """All ids as the formatted string."""
        at = np.flatnonzero(ids >= self.open)
        out, last = [], 0
        for i in at:
            out += [self.text(ids[last:i]), self.marks[int(ids[i])]]
            last = i + 1
        return "".join([*out, self.text(ids[last:])])

    def parse(self, ids: np.ndarray, mask: np.ndarray) -> Iterator[tuple[str, str, str]]:
        """(role, text, learned text) of each turn, unescaped, from ids and mask alone."""
        for role, text, learned, _ in self.read(ids, mask):
            yield role, text, learned

    def read(self, ids: np.ndarray, mask: np.ndarray) -> Iterator[tuple[str, str, str, int]]:
        """``parse`` with the characters of each turn in formatted form; every id belongs to one turn, or it raises."""
        at = [np.flatnonzero(ids == x) for x in (self.open, self.middle, self.close)]
        if len(ids) and not (at[0][0] == 0 and at[2][-1] == len(ids) - 1 and np.array_equal(at[0][1:], at[2][:-1] + 1)):
            raise ValueError("ids outside of turns")
        marks = len(OPEN) + len(MIDDLE) + len(CLOSE)
        for a, m, b in zip(*at, strict=True):
            body, on = ids[m + 1 : b], mask[m + 1 : b] > 0
            role, text = self.text(ids[a + 1 : m]), self.text(body)
            plain = unescape(text)
            learned = plain if on.all() and len(body) else unescape(self.text(body[on]))
            yield unescape(role), plain, learned, len(role) + len(text) + marks


def vocabulary(path: str = VOCABULARY) -> bytes:
    """The vocabulary file, read once on the driver (about a megabyte) and sent out from there."""
    with open(path, "rb") as f:
        return f.read()


def _encoder(shared):
    """Each row's own ids and mask; the rows of a batch go through the encoder together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                roles, texts = part.column("role").to_pylist(), part.column("text").to_pylist()
                ids, mask, bounds = template.encoded(list(zip(roles, texts, strict=True)))
                raw, marks = ids.tobytes(), mask.tobytes()
                spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("conv_id", "turn", "role", "text")), pa.array([raw[4 * a : 4 * b] for a, b in spans], pa.binary()), pa.array([marks[a:b] for a, b in spans], pa.binary())],
                    names=["conv_id", "turn", "role", "text", "ids", "mask"],
                )

    return run


def _formatter(part_tokens: int):
    """Turns of a conversation, which come in order, joined to parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []
        state = {"conv": None, "part": 0, "tokens": 0, "any": False}
        rows: list[tuple] = []

        def flush() -> None:
            if held:
                ids, mask = zip(*held, strict=True)
                rows.append((state["conv"], state["part"], len(held), b"".join(ids), b"".join(mask)))
                held.clear()
                state.update(part=state["part"] + 1, tokens=0)

        def batch() -> pa.RecordBatch:
            conv, part, n, ids, mask = zip(*rows, strict=True)
            rows.clear()
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32), pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(part, pa.int32()), pa.array(n, pa.int64()), lists, pa.array(mask, pa.binary())], names=["conv_id", "part", "n_turns", "ids", "mask"])

        for b in batches:
            for conv, ids, mask in zip(*(b.column(c).to_pylist() for c in ("conv_id", "ids", "mask")), strict=True):
                if not state["any"] or conv != state["conv"]:
                    flush()
                    state.update(conv=conv, part=0, any=True)
                held.append((ids, mask))
                state["tokens"] += len(mask)
                if state["tokens"] >= part_tokens:
                    flush()
            if sum(len(r[4]) for r in rows) >= 1 << 18:
                yield batch()
        flush()
        if rows:
            yield batch()

    return run


def format_conversations(turns: DataFrame, vocabulary_path: str = VOCABULARY, part_tokens: int = PART_TOKENS) -> DataFrame:
    """Parts of formatted conversations: conv_id, part (from 0), n_turns, ids, mask (a byte per id).

    Rows are ordered by turn (nulls first; ties by role, then text); a null role or text is the
    empty string; rows with a null conv_id are one conversation; repeated rows are turns of
    their own. Other columns are ignored, and an empty table gives no rows. Rows are encoded where
    they are read, however long their conversation; then its parts come one after the other in
    one partition, streamed, since a conversation's digests run over all of it.
    """
    spark = turns.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary(vocabulary_path))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    encoded = rows.mapInArrow(_encoder(shared), "conv_id long, turn long, role string, text string, ids binary, mask binary")
    dealt = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "ids", "mask").mapInArrow(_formatter(part_tokens), FORMATTED)


def _reader(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(shared.value)
        rows: list[tuple] = []
        now: dict = {}

        def close() -> None:
            if now:
                rows.append((now["conv"], now["n"], now["turns"].hexdigest(), now["loss_chars"], now["loss"].hexdigest(), now["chars"]))

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        for b in batches:
            values = b.column("ids").values.to_numpy(zero_copy_only=False)
            offsets = b.column("ids").offsets.to_numpy()
            for i, (conv, part, mask) in enumerate(zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "mask")), strict=True)):
                if not part:
                    close()
                    now = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
                ids = values[offsets[i] : offsets[i + 1]]
                for role, text, loss, chars in template.read(ids, np.frombuffer(mask, np.uint8)):
                    now["n"] += 1
                    now["chars"] += chars
                    now["turns"].update(f"{role}\n{text}\n".encode())
                    now["loss"].update(loss.encode())
                    now["loss_chars"] += len(loss)
            if len(rows) >= 2000:
                yield out()
        close()
        if rows:
            yield out()

    return run


def read_back(formatted: DataFrame, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """What formatted parts hold, one row per conversation, from their ids and masks alone.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. The parts of a
    conversation must stand in one partition in order, as ``format_conversations`` leaves them.
    """
    shared = formatted.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_path))
    return formatted.select("conv_id", "part", "ids", "mask").mapInArrow(_reader(shared), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def probe(spark: SparkSession) -> DataFrame:
    """A conversation of two turns whose texts look like marks."""
    text = "\\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
