"""License scans: Dice coefficient over word bigrams against licence templates.

A text is normalised to its words and cut into segments: every line, every block of lines
between blank ones, and the whole text. A licence that no segment reaches is sought in windows,
any runs of words: paragraphs of a longer text, or a notice within a line. Words that fit
another licence better don't count for it. For a segment with ``a`` distinct bigrams and a
template with ``b``, the coefficient 2 |A and B| / (a + b) can't reach the threshold ``t``
unless t / (2 - t) * b <= a <= (2 - t) / t * b; templates outside those bounds are pruned
before any bigram is compared. The templates' bigrams form one sorted table, so that segments
without a common bigram never leave the vectorised part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folianta.llm.common import small_batches, slices, text_array
from folianta.llm.license_templates import TEMPLATES
from folianta.llm.wordkernel import mix, words

#: Coefficient from which a segment is the template's.
DICE = 0.8


def bigrams(hashes: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words; a single word is one bigram of its own, no word none."""
    if len(hashes) < 2:
        return mix(hashes + np.uint64(11))
    return mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + mix(hashes[1:]))


@dataclass
class Library:
    """names, and for each template its number of distinct bigrams; table and owners list all (bigram, template)."""

    names: list[str]
    sizes: np.ndarray
    table: np.ndarray
    owners: np.ndarray
    threshold: float

    @staticmethod
    def of(templates=TEMPLATES, threshold: float = DICE) -> Library:
        found = words(pa.array([t[2] for t in templates], pa.large_string()))
        sets = [np.unique(bigrams(found.of(i))) for i in range(len(templates))]
        table, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(table, kind="stable")
        return Library([t[0] for t in templates], np.array([len(s) for s in sets]), table[order], owners[order], threshold)

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest number of bigrams of a segment for each template."""
        t = self.threshold
        return np.ceil(self.sizes * t / (2 - t) - 1e-9).astype(int), np.floor(self.sizes * (2 - t) / t + 1e-9).astype(int)

    def best(self, grams: np.ndarray) -> list[tuple[str, float]]:
        """Licences that a segment reaches, each with its best coefficient."""
        own = np.unique(grams)
        low, high = self.bounds()
        fit = (low <= len(own)) & (len(own) <= high)
        if not fit.any():
            return []
        a, b = np.searchsorted(self.table, own), np.searchsorted(self.table, own, "right")
        common = np.zeros(len(self.names), int)
        for i, j in zip(a[b > a], b[b > a], strict=True):
            common[self.owners[i:j]] += 1
        dice = np.where(fit, 2 * common / (len(own) + self.sizes), 0)
        out: dict[str, float] = {}
        for i in np.flatnonzero(dice >= self.threshold - 1e-12):
            out[self.names[i]] = max(out.get(self.names[i], 0.0), float(dice[i]))
        return list(out.items())

    def needed(self) -> int:
        """Common bigrams without which no template is reached: t / (2 - t) of the smallest one."""
        return int(np.ceil(self.sizes.min() * self.threshold / (2 - self.threshold) - 1e-9))


def best_window(grams: np.ndarray, mine: np.ndarray, size: int, high: int) -> tuple[float, int, int]:
    """Greatest coefficient of a run of ``grams`` against a template of ``size`` bigrams, and its first and last place.

    ``mine`` tells the template's bigrams. A best run begins and ends with one of those, so only such starts are tried,
    each up to where it has more than ``high`` distinct bigrams or has the whole template.
    """
    n = len(grams)
    order = np.argsort(grams, kind="stable")
    again = grams[order[1:]] == grams[order[:-1]]
    before = np.full(n, -1)
    before[order[1:][again]] = order[:-1][again]
    best = (0.0, 0, 0)
    for i in np.flatnonzero(mine).tolist():
        reach = 2 * high
        while True:
            fresh = before[i : i + reach] < i
            own, common = np.cumsum(fresh), np.cumsum(fresh & mine[i : i + reach])
            if i + reach >= n or own[-1] > high or common[-1] == size:
                break
            reach *= 2
        dice = np.where(own <= high, 2 * common / (own + size), 0)
        j = int(np.argmax(dice))
        if dice[j] > best[0]:
            best = (float(dice[j]), i, i + j)
    return best


def windows_in(grams: np.ndarray, templates: list[int], library: Library) -> list[tuple[str, float]]:
    """Licences of one text by windows. Where windows of different licences overlap, the greater coefficient has them."""
    high, least = library.bounds()[1], library.threshold - 1e-12
    queue: list[tuple[float, int, int, int, int, int]] = []

    def seek(t: int, low: int, end: int) -> None:
        part = grams[low:end]
        if len(part):
            dice, i, j = best_window(part, np.isin(part, library.table[library.owners == t]), int(library.sizes[t]), int(high[t]))
            if dice >= least:
                heapq.heappush(queue, (-dice, t, low + i, low + j + 1, low, end))

    for t in templates:
        seek(t, 0, len(grams))
    held: list[tuple[str, float, int, int]] = []
    while queue:
        dice, t, i, j, low, end = heapq.heappop(queue)
        other = next((x for x in held if x[0] != library.names[t] and x[1] > -dice + 1e-12 and x[2] < j and i < x[3]), None)
        if other is None:
            held.append((library.names[t], -dice, i, j))
        else:
            seek(t, low, other[2])
            seek(t, other[3], end)
    out: dict[str, float] = {}
    for name, dice, _, _ in held:
        out[name] = max(out.get(name, 0.0), dice)
    return list(out.items())


def _candidates(first: np.ndarray, known: np.ndarray, at: np.ndarray, hit: np.ndarray, library: Library) -> dict[int, list[int]]:
    """For each text the templates of which it has, anywhere, the common bigrams that the threshold needs."""
    places = np.flatnonzero(hit)
    texts = np.searchsorted(first, places, "right") - 1
    inside = places + 1 < first[texts + 1]
    keys = np.unique(texts[inside] * len(known) + at[places[inside]])
    texts, found = keys // len(known), keys % len(known)
    _, counts = np.unique(texts, return_counts=True)
    enough = np.repeat(counts >= library.needed(), counts)
    if not enough.any():
        return {}
    has = np.zeros((len(known), len(library.names)), np.int32)
    has[np.searchsorted(known, library.table), library.owners] = 1
    every, starts = np.unique(texts[enough], return_index=True)
    common = np.add.reduceat(has[found[enough]], starts, axis=0)
    reached = common >= library.bounds()[0]
    return {int(x): np.flatnonzero(r).tolist() for x, r in zip(every[reached.any(1)], reached[reached.any(1)], strict=True)}


#: Segments of a text, and what ends one.
SEGMENTS = ("line", "block", "text")


def _groups(found, segment: str) -> np.ndarray:
    """Index of the first word of each segment; a new text always begins a new one."""
    cuts = [found.first[:-1]]
    if segment != "text":
        breaks = np.flatnonzero(found.data == 10)
        if segment == "block" and len(breaks):
            inked = np.concatenate([[0], np.cumsum(~((found.data == 32) | ((found.data >= 9) & (found.data <= 13))))])
            blank = inked[breaks[1:]] == inked[breaks[:-1] + 1]
            breaks = breaks[:-1][blank]
        cuts.append(np.searchsorted(found.starts, breaks))
    firsts = np.unique(np.concatenate(cuts))
    return firsts[firsts < len(found.hashes)]


def licenses_in(texts: pa.Array, library: Library) -> list[dict[str, tuple[float, str]]]:
    """For each text, the best coefficient and its segment of each licence found; windows count for those without a segment."""
    found = words(texts)
    out: list[dict[str, tuple[float, str]]] = [{} for _ in range(len(found.first) - 1)]
    n = len(found.hashes)
    if not n:
        return out
    known = np.unique(library.table)
    pairs = bigrams(found.hashes) if n > 1 else np.zeros(0, np.uint64)
    at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
    hits = np.concatenate([[0], np.cumsum(known[at] == pairs)])
    for segment in SEGMENTS:
        starts = _groups(found, segment)
        ends = np.append(starts[1:], n)
        # pairs that lie inside the segment
        common = hits[ends - 1] - hits[starts]
        for a, b in zip(starts[common >= library.needed()].tolist(), ends[common >= library.needed()].tolist(), strict=True):
            m = library.best(bigrams(found.hashes[a:b]))
            if m:
                held = out[int(np.searchsorted(found.first, a, "right")) - 1]
                for name, dice in m:
                    if dice > held.get(name, (0.0, ""))[0]:
                        held[name] = (dice, segment)
    for i, templates in _candidates(found.first, known, at, known[at] == pairs, library).items():
        if all(library.names[t] in out[i] for t in templates):
            continue
        for name, dice in windows_in(bigrams(found.of(i)), templates, library):
            out[i].setdefault(name, (dice, "window"))
    return out


def scan_licenses(docs: DataFrame, library: Library | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, found (array of license, dice, segment, by license).

    Null text counts as empty; texts without a licence have an empty array; repeated rows have
    each their own; other columns are ignored. The templates are part of the code, so what is
    sent to the tasks doesn't grow with the data.
    """
    small_batches(docs.sparkSession)
    library = library or Library.of()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("license", pa.string()), ("dice", pa.float64()), ("segment", pa.string())])
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [[{"license": k, "dice": d, "segment": s} for k, (d, s) in sorted(x.items())] for x in licenses_in(text_array(part.column("text")), library)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.list_(kind))], names=["doc_id", "found"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, found array<struct<license:string,dice:double,segment:string>>")


def license_report(docs: DataFrame, library: Library | None = None) -> DataFrame:
    """``scan_licenses`` as doc_id, n_licenses and licenses (name:coefficient in thousandths, comma-joined by name)."""
    listed = F.transform("found", lambda x: F.concat_ws(":", x["license"], F.round(x["dice"] * 1000).cast("long").cast("string")))
    return scan_licenses(docs, library).select("doc_id", F.size("found").cast("long").alias("n_licenses"), F.array_join(listed, ",").alias("licenses"))
