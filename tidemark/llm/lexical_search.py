"""Ranked lexical search: every item of a query set against all documents, by tiles of dense products.

Items are cut into tiles, each with the compact vocabulary of its own terms. A document keeps only the terms of some item, with their
counts. A tile of documents times a tile of items is then one float64 matrix product: what the terms give to the documents
times how often the items hold them, weighted. All numbers are whole; products are split so that no sum reaches 2^53, so they are exact,
and equal scores are equal. Each task keeps the best k of an item, ties decided by id.

Items are a stated query set. They go out in blocks of bounded size; every block meets all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import written
from tidemark.llm.terms import terms
from tidemark.llm.words import slices

#: Pairs of item and term in one block, which the tasks hold at some 200 bytes each; one item's terms stay together.
BLOCK_PAIRS = 500_000
#: Documents, items and terms of one product.
DOCS, ITEMS, TERMS = 512, 256, 4096
EXACT = 1 << 53
#: What a term gives to a document is below this before it is weighted.
IMPACT = 1_000_000
#: Best rows of one item are cut down within so many groups of tasks before they meet.
GROUPS = 64


@dataclass
class Tile:
    """items: their numbers; ids: the terms, ascending; of, at, times: entries (item here, term here, weight times count)."""

    items: np.ndarray
    ids: np.ndarray
    of: np.ndarray
    at: np.ndarray
    times: np.ndarray

    def products(self) -> list[tuple[slice, list[np.ndarray]]]:
        """Runs of terms, each with matrices (term by item) that sum to the tile's, whose products with impacts stay below 2^53."""
        out = []
        for a in range(0, len(self.ids), TERMS):
            z = min(a + TERMS, len(self.ids))
            some = (self.at >= a) & (self.at < z)
            whole = np.zeros((z - a, len(self.items)), np.int64)
            whole[self.at[some] - a, self.of[some]] = self.times[some]
            parts, rest = [], whole
            while True:
                # cut every entry to what leaves any sum of this run below the limit
                most = (EXACT // IMPACT - 1) // max(int((rest > 0).sum(0).max(initial=0)), 1)
                part = rest if int(rest.sum(0).max(initial=0)) < EXACT // IMPACT else np.minimum(rest, most)
                parts.append(part.astype(float))
                rest = rest - part
                if not rest.any():
                    break
            out.append((slice(a, z), parts))
        return out


def tiles(entries: list[tuple[int, dict[int, int]]]) -> list[Tile]:
    """Tiles of at most ITEMS items from (number, {term: weight times count})."""
    out = []
    for a in range(0, len(entries), ITEMS):
        some = entries[a : a + ITEMS]
        ids = np.unique(np.array([t for _, e in some for t in e], np.int64))
        of = np.repeat(np.arange(len(some)), [len(e) for _, e in some])
        term = np.array([t for _, e in some for t in e], np.int64)
        out.append(Tile(np.array([i for i, _ in some]), ids, of, np.searchsorted(ids, term), np.array([v for _, e in some for v in e.values()], np.int64)))
    return out


def _held(vocabulary: dict[bytes, int]):
    """Documents with their length, and numbers and counts of those of their terms that some item holds."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()
        for b in (x for whole in batches for x in slices(whole, 1)):
            ids, n_all, of, tf = [], [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()), strict=True):
                n, count = 0, Counter()
                for some in terms(text.as_py()):
                    n += len(some)
                    count.update(some)
                if n:
                    found = sorted((vocabulary[t], count[t]) for t in count.keys() & known)
                    ids.append(key)
                    n_all.append(n)
                    of.append([x for x, _ in found])
                    tf.append([x for _, x in found])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_all, pa.int64()), pa.array(of, kind), pa.array(tf, kind)], ["id", "n", "terms", "tf"])

    return run


def _ranked(block: list[Tile], top: int, k1_b: tuple[int, int], n_docs: int, n_terms: int):
    """The best rows of each item of the block in this task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(len(t.items), top) for t in block]
        ready = [t.products() for t in block] if len(block) == 1 else None
        for whole in batches:
            for a in range(0, whole.num_rows, DOCS):
                b = whole.slice(a, DOCS)
                ids, missing = np.asarray(b.column(0).fill_null(0)), np.asarray(b.column(0).is_null())
                of, tf = (b.column(i).combine_chunks() if isinstance(b.column(i), pa.ChunkedArray) else b.column(i) for i in (2, 3))
                doc = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(of.offsets)))
                term, times = np.asarray(of.flatten()), np.asarray(tf.flatten())
                unit, share = k1_b
                m = np.array([100 - share + share * n * n_docs // n_terms for n in b.column(1).to_pylist()], np.int64)
                impact = 1_000_000_000 * times // (1000 * times + unit * m[doc])
                for i, t in enumerate(block):
                    at = np.searchsorted(t.ids, term)
                    mine = at < len(t.ids)
                    mine[mine] = t.ids[at[mine]] == term[mine]
                    score = np.zeros((b.num_rows, len(t.items)), np.int64)
                    d, c, v = doc[mine], at[mine], impact[mine]
                    for run_of, parts in ready[i] if ready else t.products():
                        some = (c >= run_of.start) & (c < run_of.stop)
                        dense = np.zeros((b.num_rows, run_of.stop - run_of.start))
                        dense[d[some], c[some] - run_of.start] = v[some]
                        for p in parts:
                            score += (dense @ p).astype(np.int64)
                    best[i].add(score, ids, missing)
        out = [np.concatenate(x) for x in zip(*(w.rows(t.items) for w, t in zip(best, block, strict=True)), strict=True)] if block else [np.zeros(0, np.int64)] * 4
        yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1], mask=out[2].astype(bool)), pa.array(out[3])], ["number", "id", "score"])

    return run


class Best:
    """The k highest scores above 0 of each item so far; equal ones by ascending id, null first."""

    def __init__(self, n_items: int, k: int):
        self.k, self.floor = k, np.ones(n_items, np.int64)
        self.item, self.id, self.missing, self.score = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, score: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        doc, item = np.nonzero(score >= self.floor)  # a score equal to the last kept may still win by its id
        if not len(doc):
            return
        item, key, none, s = (np.concatenate(x) for x in ((self.item, item), (self.id, ids[doc]), (self.missing, missing[doc].astype(np.int64)), (self.score, score[doc, item])))
        order = np.lexsort((key, -none, -s, item))
        item = item[order]
        first = np.searchsorted(item, np.arange(len(self.floor)))
        keep = np.arange(len(item)) - first[item] < self.k
        order = order[keep]
        self.item, self.id, self.missing, self.score = item[keep], key[order], none[order], s[order]
        full = np.bincount(self.item, minlength=len(self.floor)) == self.k
        last = np.searchsorted(self.item, np.arange(len(self.floor)), side="right") - 1
        self.floor[full] = self.score[last[full]]

    def rows(self, numbers: np.ndarray) -> tuple[np.ndarray, ...]:
        return numbers[self.item], self.id, self.missing, self.score


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item, pairs (term, times), n: rows that share an item id are one item of all their terms."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole, 1)):
            out = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()), strict=True):
                count = Counter()
                for some in terms(text.as_py()):
                    count.update(some)
                out += [(key, t, n) for t, n in count.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.int64())], ["item", "term", "times"])

    rows = items.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "item long, term binary, times long")
    return rows.groupBy("item", "term").agg(F.sum("times").alias("times")).groupBy("item").agg(F.collect_list(F.struct("term", "times")).alias("pairs"), F.count(F.lit(1)).alias("n"))


def search(docs: DataFrame, items: DataFrame, top: int = 20, k1: float = 1.2, share: int = 25, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each item its ``top`` highest-scoring documents of a score above 0: item_col, rank, id_col, score.

    A term's weight is floor(1000 ln((2N + 2) / (2df + 1))); a document's score sums, over the item's terms with repeats, the
    weight times 10^9 tf div (1000 tf + 10 k1 m), m = 100 - share + share n N div L. Equal scores go by ascending id (null first).
    Texts without a term, null ones among them, count nowhere. Documents that repeat are ranked each; rows that share an item id are one item of all their
    terms. Empty tables give an empty result. Only the named columns are read.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("text is not null")
    asked = item_terms(items, item_col, item_text)
    total = asked.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // BLOCK_PAIRS) or 1
    asked = written(asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")).repartition(F.col("block"))) if blocks > 1 else asked.withColumn("block", F.lit(0))
    out = None
    for i in range(blocks):
        mine = [(r["item"], [(bytes(t), n) for t, n in r["pairs"]]) for r in asked.filter(F.col("block") == i).collect()]
        rows = _block(spark, src, mine, top, (round(10 * k1), share))
        out = rows if out is None else out.unionByName(rows)
    out = out.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    order = (F.desc("score"), F.asc_nulls_first("id"))
    few = out.withColumn("place", F.row_number().over(Window.partitionBy("item", "group").orderBy(*order))).filter(F.col("place") <= top)
    last = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)
    return last.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _block(spark, src: DataFrame, mine: list, top: int, k1_b: tuple[int, int]) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, pairs in mine for t, _ in pairs}))}
    held = written(src.mapInArrow(_held(vocabulary), "id long, n long, terms array<long>, tf array<long>"))
    n_docs, n_terms = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = held.mapInArrow(_frequencies(len(vocabulary)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    weight = {r["term"]: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1))) for r in found}
    numbers = sorted(range(len(mine)), key=lambda i: (mine[i][0] is not None, mine[i][0] or 0))
    entries = [(i, e) for i in numbers if (e := {k: n * w for t, n in mine[i][1] if (w := weight.get(k := vocabulary[t], 0))})]
    best = held.mapInArrow(_ranked(tiles(entries), top, k1_b, n_docs, n_terms), "number long, id long, score long")
    names = spark.createDataFrame([(i, key) for i, (key, _) in enumerate(mine)], "number long, item long")
    return best.join(F.broadcast(names), "number").select("item", "id", "score")


def _frequencies(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(np.asarray(b.column(2).flatten()), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "df"])

    return run
