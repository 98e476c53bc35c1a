"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a hash of its code point. The vector of an n-gram binds those of
its letters: each is rotated by its distance from the end, then they are multiplied. A text is the sum (bundle) of its
n-grams' vectors, a language the sum over its training texts, a prediction the language of greatest cosine.

Sums are whole numbers, so neither partitions nor the order of rows change a prototype.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import mix, slices

DIMENSIONS = 1024
#: Prototypes go out with the tasks, one vector of DIMENSIONS numbers each; more languages than are spoken are an error.
MOST_LANGUAGES = 10_000
#: Texts bundled at once, n-grams of theirs counted at once, and n-grams bound at once.
TEXTS, GRAMS, BOUND = 256, 1 << 14, 1 << 11
UNKNOWN = "und"
_GAP = 0


@functools.cache
def alphabet() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its symbol (a lower-case letter, a mark, or 0 for a gap), and whether it is a letter."""
    symbol, letter = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
    for i in (x for r in (range(0xD800), range(0xE000, 0x32000)) for x in r):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            symbol[i], letter[i] = ord(low) if len(low) == 1 else i, True
        elif unicodedata.category(c)[0] == "M":
            symbol[i] = i
    return symbol, letter


def letter_vectors(symbols: np.ndarray, dimensions: int) -> np.ndarray:
    """A row of +1 and -1 for each symbol, the gap included, the same on every machine."""
    lanes = np.arange(-(-dimensions // 64), dtype=np.uint64)
    bits = mix(mix((symbols.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))[:, None] + (lanes + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
    ones = np.unpackbits(bits.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, :dimensions]
    return (2 * ones.astype(np.int8) - 1).astype(np.int8)


class Profile:
    """N-grams of a run of texts: grams[i] are the symbols of gram i; at[j]:at[j + 1] are the grams of text j, as numbers in which."""

    def __init__(self, texts: list[str], n: int):
        symbol, letter = alphabet()
        sizes = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        doc = np.repeat(np.arange(len(texts)), sizes)
        self.has_letter = np.bincount(doc, weights=letter[points], minlength=len(texts)) > 0
        # each text between gaps of its own
        first = np.concatenate([[0], np.cumsum(sizes + 2)])
        s = np.zeros(int(first[-1]), np.uint32)
        s[np.arange(len(points)) + 2 * doc + 1] = symbol[points]
        owner = np.repeat(np.arange(len(texts)), sizes + 2)
        keep = s != _GAP
        keep[1:] |= (s[:-1] != _GAP) | (owner[1:] != owner[:-1])
        keep[:1] = True
        s, owner = s[keep], owner[keep]
        m = max(len(s) - n + 1, 0)
        whole = owner[:m] == owner[n - 1 :][:m]
        letters, place = np.unique(s, return_inverse=True) if len(s) < 1000 else self._dense(s)
        code = np.zeros(m, np.int64)
        size = max(len(letters), 1)
        if size**n < 1 << 62:
            for j in range(n):
                code = code * size + place[j : j + m]
            code, owner = code[whole], owner[:m][whole]
            codes, self.which = np.unique(code, return_inverse=True) if size**n > 1 << 22 else self._dense(code)
            parts = [codes // size ** (n - 1 - j) % size for j in range(n)]
        else:  # long grams of many letters
            rows = np.lib.stride_tricks.sliding_window_view(place, n)[whole] if m else np.zeros((0, n), int)
            owner = owner[:m][whole]
            codes, self.which = np.unique(rows, axis=0, return_inverse=True)
            parts = list(codes.T)
        self.letters, self.grams, self.owner, self.n_texts = letters, np.stack(parts, 1) if n else codes, owner, len(texts)

    @staticmethod
    def _dense(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """np.unique with its inverse for small numbers, in linear time."""
        there = np.zeros(int(x.max()) + 1 if len(x) else 1, bool)
        there[x] = True
        return np.flatnonzero(there), (np.cumsum(there) - 1)[x]

    def bundles(self, group: np.ndarray, n_groups: int, dimensions: int) -> np.ndarray:
        """For each group of texts (group[j] of text j) the sum of its n-grams' vectors, exact."""
        total = np.bincount(group[self.owner], minlength=n_groups) if len(self.owner) else np.zeros(n_groups)
        kind = np.float32 if total.max(initial=0) < 1 << 24 else np.float64
        out, vectors, n = np.zeros((n_groups, dimensions), kind), letter_vectors(self.letters, dimensions), self.grams.shape[1]
        turned = [np.roll(vectors, n - 1 - j, axis=1) for j in range(n)]
        of, whose = self.which, group[self.owner]
        if len(self.grams) > GRAMS:
            order = np.argsort(of, kind="stable")
            of, whose = of[order], whose[order]
        for a in range(0, len(self.grams), GRAMS):
            some = self.grams[a : a + GRAMS]
            lo, hi = (0, len(of)) if len(self.grams) <= GRAMS else np.searchsorted(of, [a, a + GRAMS])
            counts = np.bincount(whose[lo:hi] * len(some) + of[lo:hi] - a, minlength=n_groups * len(some)).reshape(n_groups, len(some)).astype(kind)
            for c in range(0, len(some), BOUND):
                bound = turned[0][some[c : c + BOUND, 0]]
                for j in range(1, n):
                    bound = bound * turned[j][some[c : c + BOUND, j]]
                out += counts[:, c : c + BOUND] @ bound.astype(kind)
        return out


def runs(b: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most TEXTS rows and a bounded number of bytes (or one row)."""
    for s in slices(b, text):
        for a in range(0, s.num_rows, TEXTS):
            yield s.slice(a, TEXTS)


def _sums(n: int, dimensions: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in (x for whole in batches for x in runs(whole, 1)):
            langs = b.column(0).to_pylist()
            names = sorted(set(langs))
            at = {x: i for i, x in enumerate(names)}
            sums = Profile(b.column(1).to_pylist(), n).bundles(np.array([at[x] for x in langs]), len(names), dimensions)
            for x, v in zip(names, sums, strict=True):
                total[x] = total.get(x, 0) + v.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([list(v) for v in total.values()], pa.list_(pa.int64()))], ["lang", "sums"])

    return run


def prototypes(train: DataFrame, n: int, dimensions: int, lang_col: str, text_col: str) -> tuple[list[str], np.ndarray]:
    """Languages in order and their summed vectors, over all rows with a language and a text."""
    rows = train.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).filter("lang is not null and text is not null")
    each = rows.mapInArrow(_sums(n, dimensions), "lang string, sums array<long>").select("lang", F.posexplode("sums"))
    sums = each.groupBy("lang", "pos").agg(F.sum("col").alias("v")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "v")))["v"].alias("sums"))
    found = sorted(sums.limit(MOST_LANGUAGES + 1).collect())
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MOST_LANGUAGES} values")
    found = [r for r in found if any(r["sums"])]
    return [r["lang"] for r in found], np.array([r["sums"] for r in found], float).reshape(len(found), dimensions)


def _predicted(langs: list[str], vectors: np.ndarray, n: int, dimensions: int, folds: int):
    units = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in runs(whole, 2)):
            texts = [t or "" for t in b.column(2).to_pylist()]
            p = Profile(texts, n)
            x = p.bundles(np.arange(len(texts)), len(texts), dimensions).astype(float)
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if langs:
                cosine = x @ units.T / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
                best = cosine.argmax(1)  # of equal ones the first in order
                score = np.where(p.has_letter, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0.0)
                lang = [langs[k] if has else UNKNOWN for k, has in zip(best, p.has_letter, strict=True)]
            held = np.asarray(b.column(1)) % folds == 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, n: int = 3, dimensions: int = DIMENSIONS, folds: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: id_col, held_out, lang_pred, score (the cosine with that language's prototype, 0 if negative).

    Prototypes come from rows whose crc32(id as text) mod folds is not 1 and whose language isn't null; these alone are
    never held out. A text without a letter, empty or null, is ``und`` with score 0, and so is every text if no
    training row has a language and a letter. Rows that repeat are counted and predicted each; a null id has the empty text as its
    own. An empty table gives an empty result. Only the named columns are read.
    """
    key = F.col(f"`{id_col}`").cast("long")
    crc = F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary"))
    langs, vectors = prototypes(docs.filter(crc % folds != 1), n, dimensions, lang_col, text_col)
    src = docs.select(key.alias("id"), crc.alias("crc"), F.col(f"`{text_col}`").alias("text"))
    return src.mapInArrow(_predicted(langs, vectors, n, dimensions, folds), "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
