"""Benchmark decontamination by pigeonhole edit matching.

With an error budget of k edits a test item is split into k + 1 pieces. A passage within k edits
leaves at least one piece untouched, so piece hits find every such passage. The same principle thins
the hits: of P pieces of four characters at least P - k are untouched, and stand within k of where they
would. Myers' bit-parallel distance on the text around a hit that is left confirms it.

A piece is looked up by the hashes of its first and last characters: hashes of 1, 2, 4, 8 and 16
characters at every place of a text are made in numpy, each from the one before. So an index takes
some tens of bytes a piece, and tens of thousands of items share one pass over the texts. Items are
a stated query set, read once and broadcast in blocks of bounded size; every block meets all texts.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import slices

#: Normalised characters of items in one block: its index takes some 8 bytes for each.
BLOCK_CHARS = 8_000_000
#: Places of a text that are looked up at a time.
STEP = 1 << 16
#: The longest run of characters that is hashed; a longer piece is known by its ends.
WIDEST = 16
#: Characters in the small pieces that thin the hits.
SMALL = 4
_GAPS = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    """Lower case; runs of anything but letters and digits become one space."""
    return _GAPS.sub(" ", (text or "").lower()).strip()


def budget(length: int, rate: float) -> int:
    return int(length * rate)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) for k + 1 pieces of nearly equal length that make up the item."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]


def distance(item: str, text: str, k: int, masks: dict[str, int] | None = None) -> int:
    """Myers: the least edit distance between item and any substring of text; k + 1 if more than k."""
    m = len(item)
    if masks is None:
        masks = {}
        for i, c in enumerate(item):
            masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | (~(xh | plus) & full), plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph = ph << 1 & full
        plus, minus = (mh << 1 & full) | (~(xv | ph) & full), ph & xv
        if score < best:
            best = score
    return min(best, k + 1)


@functools.lru_cache(maxsize=4096)
def masks_of(item: str) -> dict[str, int]:
    """For each character of the item a number whose bits are its places."""
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashes(points: np.ndarray) -> dict[int, np.ndarray]:
    """By width 1, 2, 4 ... WIDEST the 64-bit polynomial hashes of the runs of that many characters that start at each place.

    Equal hashes of different runs cost a look, no wrong result: what a hit leads to is confirmed on the text.
    """
    h, factor = points * np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93
    out, width = {1: h}, 1
    while width < WIDEST and len(h) > width:
        new = h[:-width] * np.uint64(factor)
        new += h[width:]
        h, width, factor = new, 2 * width, factor * factor % 2**64
        out[width] = h
    return out


class Pieces:
    """Pieces that are looked up by runs of one width, ordered by the hash of their first characters."""

    def __init__(self, width: int, rows: list[tuple[int, int, int, int, int]]):
        head, tail, item, offset, length = (np.array(c, t) for c, t in zip(zip(*rows, strict=True), ("u8", "u8", "i4", "i4", "i4"), strict=True))
        order = np.argsort(head, kind="stable")
        self.width, self.head, self.tail, self.item, self.offset, self.length = width, head[order], tail[order], item[order], offset[order], length[order]
        bits = max(10, (16 * len(head) - 1).bit_length())
        self.shift, self.seen = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.seen[head >> self.shift] = True

    def places(self, h: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(piece, place) of the pieces whose first and last characters stand at the places below ``limit``."""
        at = np.flatnonzero(self.seen[h[:limit] >> self.shift])
        first, past = np.searchsorted(self.head, h[at], "left"), np.searchsorted(self.head, h[at], "right")
        n = past - first
        at, row = np.repeat(at, n), np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        end = at + self.length[row] - self.width
        inside = end < len(h)
        at, row, end = at[inside], row[inside], end[inside]
        same = h[end] == self.tail[row]
        return row[same], at[same]


class Matcher:
    """The items of one block, and their pieces as arrays."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        if not 0 <= rate < 1:
            raise ValueError("rate must be at least 0 and below 1")
        self.items = [(key, item, budget(len(item), rate)) for key, item in items if item]
        rows: dict[int, list[tuple[int, int, int, int, int]]] = {}
        small = [np.zeros(0, np.uint64)]
        self.margin = 1
        for i, (_, item, k) in enumerate(self.items):
            by_width = hashes(codes(item))
            for offset, p in pieces(item, k):
                width = min(WIDEST, 1 << len(p).bit_length() - 1)
                h = by_width[width]
                rows.setdefault(width, []).append((int(h[offset]), int(h[offset + len(p) - width]), i, offset, len(p)))
            small.append(by_width.get(SMALL, small[0])[::SMALL])
            self.margin = max(self.margin, len(item) + k)
        self.small, self.first = np.concatenate(small), np.cumsum([len(x) for x in small])
        self.k = np.array([k for *_, k in self.items], np.int64)
        self.pieces = [Pieces(w, r) for w, r in sorted(rows.items())]

    def starts(self, text: str) -> Iterator[tuple[int, int]]:
        """(item, place where it would start) of each piece hit that isn't thinned out, ordered in every stretch of places."""
        points, step = codes(text), max(STEP, self.margin)
        for a in range(0, len(points), step):
            base = max(0, a - self.margin)
            by_width = hashes(points[base : a + step + self.margin])
            found = [np.zeros((2, 0), np.int64)]
            for p in self.pieces:
                if p.width in by_width:
                    row, at = p.places(by_width[p.width][a - base :], step)
                    found.append(np.stack([p.item[row].astype(np.int64), a + at - p.offset[row]]))
            item, start = np.concatenate(found, axis=1)
            order = np.lexsort((start, item))
            item, start = item[order], start[order]
            new = np.ones(len(item), bool)
            new[1:] = (item[1:] != item[:-1]) | (start[1:] != start[:-1])
            item, start = item[new], start[new]
            for lo in range(0, len(item), 1024):
                i, at = item[lo : lo + 1024], start[lo : lo + 1024]
                able = self.able(i, at - base, by_width.get(SMALL))
                yield from zip(i[able].tolist(), at[able].tolist(), strict=True)

    def able(self, item: np.ndarray, start: np.ndarray, h: np.ndarray | None) -> np.ndarray:
        """Whether enough small pieces of the items stand near their places, given where they would start among the hashes ``h``."""
        n = self.first[item + 1] - self.first[item]
        needed = n - self.k[item]
        if h is None or not len(item) or needed.max() <= 0:
            return np.ones(len(item), bool)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        want = self.small[np.repeat(self.first[item], n) + nth]
        at, near = np.repeat(start, n) + SMALL * nth, np.repeat(self.k[item], n)
        there = np.zeros(len(want), bool)
        for shift in range(-int(near.max()), int(near.max()) + 1):
            there |= (h.take(at + shift, mode="clip") == want) & (near >= abs(shift))
        sums = np.concatenate([[0], np.cumsum(there)])
        past = np.cumsum(n)
        return sums[past] - sums[past - n] >= needed

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(item key, distance, first place) of each item within its budget of a passage of the normalised text."""
        best: dict[int, tuple[int, int]] = {}
        for i, start in self.starts(text):
            if i in best and best[i][0] == 0:
                continue
            _, item, k = self.items[i]
            if start >= 0 and text.startswith(item, start):
                best[i] = (0, start)
            elif k:
                # all of a passage with this piece in place lies within k of where it would be
                lo = max(0, start - k)
                d = distance(item, text[lo : start + len(item) + k], k, masks_of(item))
                if d <= k and (d, lo) < best.get(i, (k + 1, 0)):
                    best[i] = (d, lo)
        return [(self.items[i][0], d, at) for i, (d, at) in sorted(best.items())]


HITS = "id long, item_id long, distance long, position long"


def _matched(index: Broadcast):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = index.value
        for b in (x for whole in batches for x in slices(whole, 1)):
            out = [(key, *h) for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True) if text.is_valid for h in m.hits(normal(text.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["id", "item_id", "distance", "position"])

    return run


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items' normalised texts, read once, in blocks of about BLOCK_CHARS characters (or one longer item); the driver holds one."""
    norm = F.trim(F.regexp_replace(F.lower(F.col(f"`{text_col}`")), r"(?U)[\W_]+", " "))
    items = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("k"), norm.alias("t")).filter("k is not null and t <> ''").distinct()
    block, held = [], 0
    for r in items.toLocalIterator():
        if item := normal(r["t"]):  # of combining marks alone nothing may be left
            block.append((r["k"], item))
            held += len(item)
        if held >= BLOCK_CHARS:
            yield block
            block, held = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item found in it: id_col, item_id, distance, position.

    Texts and items are normalised (lower case, anything but letters and digits one space). An item is found if
    some passage lies within rate * its length edits (rounded down; rate is below 1); position is where in the normalised
    text the best such passage, of several the first, is looked at. Items that are null or empty when normalised, and null or empty texts, match nothing.
    Equal rows are matched each. Empty tables give an empty result. Only the named columns are read.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = docs.sparkSession.createDataFrame([], HITS)
    for block in item_blocks(benchmark, item_col, item_text):
        index = docs.sparkSession.sparkContext.broadcast(Matcher(block, rate))
        out = out.unionByName(src.mapInArrow(_matched(index), HITS))
    return out.withColumnRenamed("id", id_col)
