"""Quality rules: a linear-chain conditional random field labels each line content or boilerplate.

Lines have binary features. Viterbi decoding finds the best label sequence of a text; it stays if
the share of its words in content lines is large enough. The weights have the greatest penalised log
likelihood (forward-backward, BFGS) over a bounded sample of labelled documents, whole texts, each line
taking its document's label. Tasks sum up likelihood and gradient; the driver sees those sums alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import forget, written
from tidemark.llm.words import Words, slices

FEATURES = ["bias", "short", "long", "marked", "mostly_marked", "upper", "bars", "bangs", "digits", "ends_sentence", "repeats_line", "repeats_word", "starts_lower"]
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_SYMBOL, _DIGIT = re.compile(r"[#*$%&<>]"), re.compile(r"[0-9]")


def line_features(line: str, seen: bool) -> tuple[int, int]:
    """(words, the features' bits). Only lines with a word are labelled."""
    words = line.split()
    n, size = len(words), len(line)
    marks = len(_SYMBOL.findall(line))
    letters = line.upper() == line and line.lower() != line
    bits = 1
    bits |= (n < 3) << 1 | (n > 12) << 2
    bits |= (marks * 4 > n) << 3 | (marks * 2 > n) << 4
    bits |= letters << 5 | (line.count("|") * 3 > n) << 6 | (line.count("!") * 3 > n) << 7
    bits |= (5 * len(_DIGIT.findall(line)) > size) << 8
    bits |= (line.rstrip()[-1:] in ".?!:") << 9
    bits |= seen << 10
    bits |= (n > 4 and 2 * len(set(words)) < n) << 11
    bits |= words[0][:1].islower() << 12
    return n, bits


def lines_of(text: str) -> tuple[list[tuple[int, int]], int]:
    """((words, features) of each line with a word, how many of those lines equal an earlier one)."""
    seen: set[str] = set()
    out, dup = [], 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r") and line.split():
            again = line in seen
            dup += again
            seen.add(line)
            out.append(line_features(line, again))
        elif line.strip(" \t\n\v\f\r"):  # only white space that isn't ASCII: a word, but of no letters
            again = line in seen
            dup += again
            seen.add(line)
            out.append((1, 1))
    return out, dup


@dataclass(frozen=True)
class Crf:
    emission: np.ndarray  # feature by label; label 1 is content
    transition: np.ndarray  # label by next label


    def decode(self, lines: list[tuple[int, int]], cache: dict[int, tuple[float, float]]) -> list[int]:
        """Viterbi: the labels of greatest score; ties go to content."""
        (t00, t01), (t10, t11) = self.transition.tolist()
        back, a, b = [], 0.0, 0.0
        for k, (_, bits) in enumerate(lines):
            e = cache.get(bits)
            if e is None:
                x = np.array([bits >> i & 1 for i in range(len(FEATURES))]) @ self.emission
                e = cache[bits] = (float(x[0]), float(x[1]))
            if k:
                to0, to1 = a + t00 > b + t10, a + t01 > b + t11
                back.append((not to0, not to1))
                a, b = (a + t00 if to0 else b + t10) + e[0], (a + t01 if to1 else b + t11) + e[1]
            else:
                a, b = e
        labels = [int(b >= a)]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]


N_EMISSION, N_ALL = 2 * len(FEATURES), 2 * len(FEATURES) + 4


def chain_sums(bits: np.ndarray, starts: np.ndarray, label: np.ndarray, weight: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Weighted log likelihood of sequences and its gradient in theta (emission by feature and label, then transition).

    bits: the lines' features, one sequence after another; starts: True at first lines; label, weight: by line. Between
    sequences the chain forgets, so all are one chain. It is cut into blocks of about the root of its length: the blocks'
    products carry messages from block to block, and steps within blocks are taken in all of them at once.
    """
    n = len(bits)
    emission, transition = theta[:N_EMISSION].reshape(-1, 2), theta[N_EMISSION:].reshape(2, 2)
    x = (bits[:, None] >> np.arange(len(FEATURES)) & 1).astype(float)
    e = x @ emission
    top, high = e.max(1), transition.max()
    m = np.exp(transition - high)[None] * np.exp(e - top[:, None])[:, None, :]
    m[starts] = np.exp(e[starts] - top[starts, None])[:, None, :]
    size = max(1, math.isqrt(n))
    blocks = -(-n // size)
    whole = np.broadcast_to(np.eye(2), (blocks * size, 2, 2)).copy()
    whole[:n] = m
    whole = whole.reshape(blocks, size, 2, 2)
    product = np.broadcast_to(np.eye(2), (blocks, 2, 2)).copy()
    for t in range(size):
        product = product @ whole[:, t]
        product /= product.sum((1, 2), keepdims=True)
    into, back = np.full((blocks, 2), 0.5), np.full((blocks, 2), 0.5)
    for b in range(1, blocks):
        v = into[b - 1] @ product[b - 1]
        into[b] = v / v.sum()
        v = product[blocks - b] @ back[blocks - b]
        back[blocks - b - 1] = v / v.sum()
    before, after, scale = (np.empty((blocks, size, 2)) for _ in range(3))
    for t in range(size):
        before[:, t] = into
        into = np.einsum("bj,bjk->bk", into, whole[:, t])
        scale[:, t] = into.sum(1, keepdims=True)
        into = into / scale[:, t]
    for t in reversed(range(size)):
        after[:, t] = back
        back = np.einsum("bjk,bk->bj", whole[:, t], back)
        back = back / back.sum(1, keepdims=True)
    before, after, scale = (a.reshape(-1, 2)[:n] for a in (before, after, scale))
    joint = before[:, :, None] * m * after[:, None, :]
    joint /= joint.sum((1, 2), keepdims=True)
    inner = ~starts
    log_z = np.log(scale[:, 0]) + top + inner * high
    true = np.stack([1.0 - label, label], 1)
    score = (e * true).sum(1) + inner * transition[label.astype(int), label.astype(int)]
    off = (true - joint.sum(1)) * weight[:, None]
    steps = true[:, :, None] * true[:, None, :] - joint
    return np.concatenate([[((score - log_z) * weight).sum()], (x.T @ off).ravel(), (steps * (weight * inner)[:, None, None]).sum(0).ravel()])


def maximum(f: Callable[[np.ndarray], tuple[float, np.ndarray]], size: int, rounds: int = 40) -> np.ndarray:
    """Where a concave f, given with its gradient, is greatest: BFGS with halved steps, from zero."""
    x, inverse = np.zeros(size), np.eye(size)
    value, slope = f(x)
    for _ in range(rounds):
        if np.abs(slope).max() < 1e-6:
            break
        step = inverse @ slope
        for _ in range(25):
            new, new_slope = f(x + step)
            if new >= value + 1e-4 * slope @ step:
                break
            step = step / 2
        else:
            break
        fall = slope - new_slope
        x, value, slope = x + step, new, new_slope
        if (bend := fall @ step) > 1e-14:
            left = np.eye(size) - np.outer(step, fall) / bend
            inverse = left @ inverse @ left.T + np.outer(step, step) / bend
    return x


#: The documents that fit() reads, half of each label at most.
SAMPLE_DOCS = 1200
RIDGE = 1e-3


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Crf:
    """Fit on the ``sample_docs`` labelled documents, half of each label, that come first by a hash of the id: whole texts.

    Labels weigh the same, and so do the documents of one. Rows with a sampled id are all used; without labels, every line is content.
    """
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter("id is not null and y in (0, 1)").distinct()
    order = F.xxhash64("id", F.lit("crf"))
    picked = [known.filter(F.col("y") == k).orderBy(order, "id").limit(sample_docs // 2) for k in (0, 1)]
    ids = [(r["id"], r["y"]) for p in picked for r in p.collect()]
    nothing = Crf(np.array([[0.0, 1.0]] + [[0.0, 0.0]] * (len(FEATURES) - 1)), np.zeros((2, 2)))
    if not ids:
        return nothing
    some = docs.sparkSession.createDataFrame(ids, "id long, y int")

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole, 1)):
            bits = [np.array([v for _, v in lines_of(t or "")[0]], np.uint16) for t in b.column(1).to_pylist()]
            full = np.array([len(x) > 0 for x in bits], bool)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(full)), pa.array([x.tobytes() for x in bits if len(x)], pa.binary())], ["y", "bits"])

    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(some), "id")
    rows = written(src.select("y", "text").mapInArrow(features, "y int, bits binary"))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return nothing
    by_label = {y: 1 / (len(counts) * n) for y, n in counts.items()}

    def evaluated(theta: np.ndarray) -> tuple[float, np.ndarray]:
        def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + N_ALL)
            for b in (x for whole in batches for x in slices(whole, 1)):
                seq = [np.frombuffer(x, np.uint16) for x in b.column(1).to_pylist()]
                size, y = np.array([len(x) for x in seq]), b.column(0).to_numpy()
                starts = np.zeros(size.sum(), bool)
                starts[np.cumsum(size) - size] = True
                weight = np.array([by_label[k] for k in y.tolist()]) / size
                total += chain_sums(np.concatenate(seq).astype(np.int64), starts, np.repeat(y, size), np.repeat(weight, size), theta)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tolist()], pa.list_(pa.float64()))], ["part", "total"])

        got = sorted((r["part"], r["total"]) for r in rows.mapInArrow(sums, "part long, total array<double>").collect())  # a row a partition
        total = np.sum([t for _, t in got], axis=0)
        return total[0] - RIDGE / 2 * theta @ theta, total[1:] - RIDGE * theta

    best = maximum(evaluated, N_ALL)
    forget(docs.sparkSession, [rows])
    return Crf(best[:N_EMISSION].reshape(-1, 2), best[N_EMISSION:].reshape(2, 2))


OUT = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double, base_failed boolean, kept boolean"


def _judged(crf: Crf, least: float, window: int, min_words: int, max_repeat: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[int, tuple[float, float]] = {}
        for whole in batches:
            for b in slices(whole, 1):
                w = Words(b.column(1))
                n = np.diff(w.doc_at)
                gone = np.concatenate([[0], np.cumsum(((w.data & 0xC0) == 0x80) | _sep(w.data))])
                total = np.diff(w.offsets)
                chars = total - (gone[w.offsets[1:]] - gone[w.offsets[:-1]])
                symbols = np.concatenate([[0], np.cumsum(_IS_SYMBOL[w.data])])
                symbols = symbols[w.offsets[1:]] - symbols[w.offsets[:-1]]
                at, h = w.windows(window)
                cut = np.searchsorted(at, w.doc_at)
                cols: dict[str, list] = {k: [] for k in ("dup", "repeat", "share", "failed", "kept")}
                for i in range(len(w)):
                    repeat = 0
                    if cut[i + 1] - cut[i] > 1:
                        own = h[cut[i] : cut[i + 1]]
                        _, inverse, count = np.unique(own, return_inverse=True, return_counts=True)
                        if (count > 1).any():
                            first = at[cut[i] : cut[i + 1]][count[inverse] > 1] - w.doc_at[i]
                            step = np.zeros(n[i] + 1, dtype=np.int64)
                            step[first] += 1
                            np.subtract.at(step, first + window, 1)
                            repeat = int((np.cumsum(step[:-1]) > 0).sum())
                    text = w.data[w.offsets[i] : w.offsets[i + 1]].tobytes().decode()
                    lines, dup = lines_of(text)
                    label = crf.decode(lines, cache) if lines else []
                    content = sum(c for (c, _), y in zip(lines, label, strict=True) if y)
                    share = content / max(sum(c for c, _ in lines), 1)
                    failed = bool(n[i] < min_words or 100 * repeat > max_repeat * n[i])
                    for k, v in zip(cols, (dup, repeat, share, failed, not failed and share >= least), strict=True):
                        cols[k].append(v)
                ints = [pa.array(np.asarray(x, dtype=np.int64)) for x in (n, chars, symbols, cols["dup"], cols["repeat"])]
                yield pa.RecordBatch.from_arrays([b.column(0), *ints, pa.array(cols["share"], pa.float64()), pa.array(cols["failed"], pa.bool_()), pa.array(cols["kept"], pa.bool_())], [x.split()[0] for x in OUT.split(", ")])

    return run


def _sep(data: np.ndarray) -> np.ndarray:
    return (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))


def judge(docs: DataFrame, crf: Crf, least_content: float = 0.5, window: int = 8, min_words: int = 20, max_repeat: int = 30, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content_share, base_failed, kept.

    A null text counts as empty: no words, base_failed. Repeated rows are judged each; a null id stays null. An empty
    table gives an empty result. Only id_col and text_col are read.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return src.mapInArrow(_judged(crf, least_content, window, min_words, max_repeat), OUT).withColumnRenamed("id", id_col)
