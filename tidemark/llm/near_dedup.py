"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. Each document becomes the set of its distinct word shingles. Equal sets collapse to one class.
2. A signature of ``slots`` minima gives ``trees`` sorted orders: tree t reads the slots from
   t * step on. Classes with a long common prefix stand next to one another in a tree; a region is
   such a run. Its depth adapts: ``shallow`` slots where that leaves at most ``region`` classes,
   ``deep`` slots where it is denser. Prefixes that occur once are never shuffled as rows.
3. Within a region classes are compared by a byte sketch of the signature. In a region of at most
   ``full`` classes every pair that may reach the threshold is a candidate; in a larger one, each
   class with its nearest ones and with the region's hubs, the classes that are nearest to all.
   Regions denser than ``region`` even at the deep level are dealt into blocks, anew in each tree.
   In every dense region all classes are candidates with its most central class too.
4. Each class's best candidates and hubs are confirmed on full sets.
5. An exact pass finds what the forest missed. Shingles have one order, common ones last (by their
   counts in a sample; the order bears on the work, not on the result). Two sets that reach the
   threshold share a shingle of their first ones in that order, so every class sends those, and
   pairs that meet there, aren't in one component yet and can reach the threshold by their sizes,
   the shingle's places and all slots of their signatures (a link fails this with a probability
   below MISS) are candidates.
6. Classes with common shingles among their first ones consist of little else. Those that share such a
   shingle make up a family; a family of more than one component is dealt into blocks, and
   every two blocks are compared by counts in matrices, exactly: on full sets, or, in families of
   many blocks, on what the sets differ in from the family's centre (shingles that most sets of a
   sample hold; the centre bears on the work, not on the result). Only links that join
   components leave a task, and no pairs of a family's largest component are compared.
7. All candidates that still join two components are confirmed on full sets. None is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import repeats
from tidemark.llm.components import components
from tidemark.llm.scratch import forget, small_batches, written
from tidemark.llm.words import U, Words, blob, mix, slices, unblob

SLOTS, TREES, STEP = 160, 32, 5
SHALLOW, DEEP = 5, 12
SKETCH = 96
#: A pair whose sketches agree in fewer than (threshold - MARGIN) of the bytes is no candidate:
#: over five standard deviations below the threshold.
MARGIN = 0.22
REGION, FULL, NEAREST, HUBS = 768, 24, 6, 2
#: Documents whose prefixes go out as one chunk.
CHUNK = 5_000
#: Bytes of a batch of rows sent to Python, and text bytes worked on at once there.
BATCH, SLICE = 4 << 20, 256 << 10
#: Common shingles are counted in one document of SHARE; those found COMMON times there, at most MOST of them, go last.
SHARE, COMMON, MOST = 16, 4, 200_000
#: A family's blocks hold about so many classes, and sets of so many shingles; a matrix so many shingles at once.
BLOCK, BLOCK_SHINGLES, COLUMNS = 2048, 4_000_000, 2048
#: Shingles of two blocks that are sorted at once, and classes whose counts are judged at once.
AT_ONCE, STRIP = 500_000, 64
#: A family's centre is made of about so many of its sets, and sent to them in portions of so many.
CENTRE, PORTION = 16, 512
MISS = 1e-12
#: Shingles of the documents whose prefixes and rare shingles make up one range of keys.
RANGE = 2_000_000

_rng = np.random.default_rng(20240531)
XOR = _rng.integers(0, 2**32, SLOTS, dtype=np.uint32)
MULTIPLY = _rng.integers(0, 2**31, SLOTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles of every text in a row, where each text's begin; one longer than the texts).

    A text of fewer words than ``size`` has its whole sequence as its one shingle; without words, none.
    """
    at, h = words.windows(size)
    cut = np.searchsorted(at, words.doc_at)
    count = np.diff(words.doc_at)
    sets = []
    for i in range(len(words)):
        if count[i] == 0:
            sets.append(np.zeros(0, U))
        elif count[i] < size:
            w = words.hashes[words.doc_at[i] : words.doc_at[i + 1]]
            sets.append(np.array([hash_of_sequence(w)], dtype=U))
        else:
            sets.append(np.unique(h[cut[i] : cut[i + 1]]))
    return np.concatenate(sets) if sets else np.zeros(0, U), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def hash_of_sequence(word_hashes: np.ndarray) -> int:
    x = len(word_hashes)
    for h in word_hashes.tolist():
        x = (x * 0x9E3779B97F4A7C15 + h) % 2**64
    return int(mix(np.array([x], dtype=U))[0])


def signatures(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash minima, 16 bits each, of non-empty sets: an array of sets by SLOTS."""
    x = (shingles >> U(32)).astype(np.uint32)
    out = np.empty((len(at) - 1, SLOTS), dtype=np.uint16)
    for k in range(SLOTS):
        out[:, k] = (np.minimum.reduceat((x ^ XOR[k]) * MULTIPLY[k], at[:-1]) >> np.uint32(8)).astype(np.uint16)
    return out


def _summaries(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1, SLICE):
                w = Words(b.column(1), lower=True)
                sets, at = shingle_sets(w, size)
                n = np.diff(at)
                full = np.flatnonzero(n)
                sig: list[bytes | None] = [None] * len(n)
                low, high = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                if len(full):
                    starts = np.concatenate([at[full], at[-1:]])
                    s = signatures(sets, starts)
                    for j, i in enumerate(full):
                        sig[i] = s[j].tobytes()
                    low[full] = np.add.reduceat(mix(sets), starts[:-1]).view(np.int64)
                    high[full] = np.add.reduceat(mix(sets ^ U(0xA0761D6478BD642F)), starts[:-1]).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(low), pa.array(high), pa.array(sig, pa.binary())], ["id", "n_shingles", "low", "high", "sig"])

    return run


def prefix_keys(sig: np.ndarray, depth: int) -> np.ndarray:
    """A 64-bit key of the first ``depth`` slots in every tree: classes by TREES."""
    tree = np.arange(TREES, dtype=U)
    key = np.broadcast_to(mix(tree + U(depth << 8)), (len(sig), TREES)).copy()
    for d in range(depth):
        key = mix(key * U(0x9E3779B97F4A7C15) + sig[:, (np.arange(TREES) * STEP + d) % SLOTS].astype(U))
    return key


def _class_chunks(n_ranges: int):
    """Classes in chunks, and each chunk's message with the prefixes at both depths."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["chunk", "part", "keys", "counts", "id", "sig"]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
        chunk, pending, held = TaskContext.get().partitionId() << 24, [], 0

        def sent() -> pa.RecordBatch:
            m = [(chunk, *x, None, None) for x in repeats.packed(np.concatenate(pending), n_ranges)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in m], t) for i, t in enumerate(types)], names)

        for b in batches:
            if not len(b):
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(len(b), SLOTS)
            pending += [prefix_keys(sig, SHALLOW).ravel(), prefix_keys(sig, DEEP).ravel()]
            held += len(b)
            none = [pa.nulls(len(b), t) for t in types[1:4]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), chunk)), *none, b.column(0), b.column(1)], names)
            if held >= CHUNK:
                yield sent()
                chunk, pending, held = chunk + 1, [], 0
        if pending:
            yield sent()

    return run


def _regions(own: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
    """For each class and tree in which it isn't alone: the key of its region or block, and its sketch."""
    keys, totals = repeats.joined(replies)
    sig = np.frombuffer(b"".join(own["sig"]), np.uint16).reshape(len(own), SLOTS)
    ids = own["id"].to_numpy()

    def total(k: np.ndarray) -> np.ndarray:
        flat = k.ravel()
        if not len(keys):
            return np.zeros(k.shape, np.int64)
        at = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
        return np.where(keys[at] == flat, totals[at].astype(np.int64), 0).reshape(k.shape)

    shallow, deep = prefix_keys(sig, SHALLOW), prefix_keys(sig, DEEP)
    n_shallow, n_deep = total(shallow), total(deep)
    dense = n_shallow > REGION
    n, key = np.where(dense, n_deep, n_shallow), np.where(dense, deep, shallow)
    blocks = np.maximum(1, -(-n // REGION)).astype(U)
    salt = mix(ids.astype(np.int64).view(U)[:, None] * U(0x9E3779B97F4A7C15) + np.arange(TREES, dtype=U)) % blocks
    key = np.where(blocks > U(1), mix(key + salt * U(0xD6E8FEB86659FD93)), key)
    row, tree = np.nonzero(n > 1)
    sketch = [s.tobytes() for s in (sig[:, :SKETCH] & 0xFF).astype(np.uint8)]
    found = pd.DataFrame({"region": key[row, tree].view(np.int64), "id": ids[row], "sketch": [sketch[i] for i in row], "central": None})
    # how many classes are close to this one, over all trees: the most central class of a dense region is its hub
    central = n_deep.sum(1)
    row, tree = np.nonzero(dense)
    return pd.concat([found, pd.DataFrame({"region": shallow[row, tree].view(np.int64), "id": ids[row], "sketch": None, "central": central[row]})])


def _candidates(threshold: float):
    """Candidate pairs of sorted region rows: a < b, how many sketch bytes agree, whether one is a hub."""
    least = int(np.ceil((threshold - MARGIN) * SKETCH))

    def pairs(ids: np.ndarray, sk: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = len(ids)
        agree = np.empty((n, n), dtype=np.int16)
        for i in range(n):
            agree[i] = (sk == sk[i]).sum(1)
        np.fill_diagonal(agree, -1)
        if n <= FULL:
            a, b = np.nonzero(np.triu(agree >= least, 1))
            hub = np.zeros(len(a), dtype=bool)
        else:
            best = np.argpartition(-agree, NEAREST, axis=1)[:, :NEAREST]
            middle = np.argsort(-agree.sum(1, dtype=np.int64), kind="stable")[:HUBS]
            a = np.concatenate([np.repeat(np.arange(n), NEAREST), np.repeat(np.arange(n), HUBS)])
            b = np.concatenate([best.ravel(), np.tile(middle, n)])
            hub = np.arange(len(a)) >= n * NEAREST
            ok = agree[a, b] >= least
            a, b, hub = a[ok], b[ok], hub[ok]
        return ids[a], ids[b], agree[a, b], hub

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def out(region: np.ndarray, ids: np.ndarray, sk: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(region)) + 1, [len(region)]])
            found = [pairs(ids[a:z], sk[a:z]) for a, z in zip(cuts, cuts[1:], strict=False) if z - a > 1]
            if found:
                a, b, s, h = (np.concatenate(x) for x in zip(*found, strict=True))
                once = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "agree": s, "hub": h}).query("a != b").groupby(["a", "b"], sort=False).max().reset_index()
                yield pa.RecordBatch.from_arrays([pa.array(once["a"]), pa.array(once["b"]), pa.array(once["agree"].astype(np.int32)), pa.array(once["hub"])], ["a", "b", "agree", "hub"])

        for x in batches:
            now = (x.column(0).to_numpy(), x.column(1).to_numpy(), np.frombuffer(b"".join(x.column(2).to_pylist()), np.uint8).reshape(len(x), SKETCH))
            if held is not None:
                now = tuple(np.concatenate(y) for y in zip(held, now, strict=True))
            if not len(now[0]):
                continue
            last = int(np.searchsorted(now[0], now[0][-1]))  # rows are sorted: the last region may go on
            yield from out(*(y[:last] for y in now))
            held = tuple(y[last:] for y in now)
        if held is not None and len(held[0]):
            yield from out(*held)

    return run


def _shingles(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 0, SLICE):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(Words(b.column(0), lower=True), size)[0].view(np.int64))], ["key"])

    return run


def first_shingles(s: np.ndarray, common: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of a set of which another set that reaches the threshold has one among its own, rarest first."""
    n = len(s)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        s = s[np.lexsort((s, np.where(common[at] == s, counts[at], 0)))]
    return s[: n + (-percent * n) // 100 + 1]


def _first(size: int, percent: int, common: np.ndarray, counts: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1, SLICE):
                sets, at = shingle_sets(Words(b.column(1), lower=True), size)
                rare: list[bytes | None] = []
                often: list[list[int] | None] = []
                for x, y in zip(at, at[1:], strict=False):
                    f = first_shingles(sets[x:y], common, counts, percent) if y > x else sets[:0]
                    is_common = repeats.member(common, f)
                    rare.append(f[~is_common].tobytes())
                    often.append(f[is_common].view(np.int64).tolist() if is_common.any() else None)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at)), pa.array(rare, pa.binary()), pa.array(often, pa.list_(pa.int64()))], ["id", "n", "firsts", "often"])

    return run


MEETING = "key long, id long, label long, n long, place long"


def _meetings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each class and shingle of its first ones that isn't common."""
    for whole in batches:
        for b in (whole.slice(i, 500) for i in range(0, len(whole), 500)):
            firsts = [np.frombuffer(x, U) for x in b.column(3).to_pylist()]
            size = np.array([len(x) for x in firsts])
            key, row = np.concatenate(firsts), np.repeat(np.arange(len(b)), size)
            place = np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size)
            ids, labels, n = (b.column(i).to_numpy() for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), ids[row], labels[row], n[row], place)], [x.split()[0] for x in MEETING.split(", ")])


def _sets(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1, SLICE):
                sets, at = shingle_sets(Words(b.column(1), lower=True), size)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sets[x:y].tobytes() for x, y in zip(at, at[1:], strict=False)], pa.binary())], ["id", "shingles"])

    return run


def shared(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of one shares with each of two; sets are sorted. Equal parts of the hashes' range are counted one by one."""
    out, sets = np.zeros((len(one), len(two)), np.float32), one + two
    parts = 1 + sum(map(len, sets)) // AT_ONCE
    bounds = np.array([2**64 * p // parts for p in range(1, parts)], dtype=U)
    cuts = [np.concatenate([[0], np.searchsorted(s, bounds), [len(s)]]) for s in sets]
    for p in range(parts):
        _add_shared(out, [s[c[p] : c[p + 1]] for s, c in zip(sets, cuts, strict=True)])
    return out


def _add_shared(out: np.ndarray, sets: list[np.ndarray]) -> None:
    every = np.concatenate(sets)
    if not len(every):
        return
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(every, return_inverse=True, return_counts=True)
    # a shingle of one set alone is shared with none
    place = np.cumsum(count > 1) - 1
    row, column = row[(keep := count[column] > 1)], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for first in range(0, int(place[-1]) + 1, COLUMNS):
        a, z = np.searchsorted(column, [first, first + COLUMNS])
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[row[a:z], column[a:z] - first] = 1
        out += m[: len(out)] @ m[len(out) :].T


def centre(sets: list[np.ndarray]) -> np.ndarray:
    """The shingles of more than half of the sets, sorted."""
    every, count = np.unique(np.concatenate(sets), return_counts=True)
    return every[2 * count > len(sets)]


def _centre(f: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"family": f["family"].iloc[:1], "shingles": [centre([np.frombuffer(x, U) for x in f["shingles"]]).tobytes()]})


def _differences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets as what they differ in from their family's centre. Rows come sorted by portion, the centre (a null id) first; without one it is empty."""
    at, middle = None, np.zeros(0, U)
    for b in (whole.slice(i, 500) for whole in batches for i in range(0, len(whole), 500)):
        ids, out = [], []
        for family, portion, key, raw in zip(*(b.column(i) for i in range(4)), strict=True):
            if at != (now := (family.as_py(), portion.as_py())):
                at, middle = now, np.zeros(0, U)
            s = np.frombuffer(raw.as_py(), U)
            if not key.is_valid:
                middle = s
                continue
            ids.append(key.as_py())
            out.append(np.setxor1d(s, middle, assume_unique=True).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["id", "shingles"])


def _family_links(percent: int):
    """Links between components in each group of two blocks (or within one); rows come sorted by group. Of the links of a group,
    only those that join what earlier ones haven't joined. Sets come as differences from one centre, the empty set or another:
    two sets differ in what one of their differences holds and the other doesn't.
    """

    def links(rows: list[tuple[int, int, int, int, np.ndarray]]) -> list[tuple[int, int]]:
        sides = [[r for r in rows if r[0] == k] for k in (0, 1)]
        one, two = (sides[0] or sides[1], sides[1] or sides[0])
        same = shared([r[4] for r in one], [r[4] for r in two])
        n, m = (np.array([r[3] for r in x]) for x in (one, two))
        far, off = (np.array([len(r[4]) for r in x]) for x in (one, two))
        label, other = (np.array([r[2] for r in x]) for x in (one, two))
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := root.get(x, x)) != x:
                root[x] = root.get(y, y)
                x = y
            return x

        out = []
        for first in range(0, len(one), STRIP):
            some = slice(first, first + STRIP)
            total = n[some, None] + m[None]
            both = (total - far[some, None] - off[None] + 2 * same[some].astype(np.int64)) // 2
            found = np.argwhere((100 * both >= percent * (total - both)) & (both > 0) & (label[some, None] != other[None]))
            for i, j in (found + [first, 0]).tolist():
                x, y = top(one[i][2]), top(two[j][2])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((min(one[i][1], two[j][1]), max(one[i][1], two[j][1])))
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for b in batches:
            for g, family, side, key, label, n, raw in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if (g, family) != group:
                    if held and (out := links(held)):
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])
                    group, held = (g, family), []
                held.append((side, key, label, n, np.frombuffer(raw, U)))
        if held and (out := links(held)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return run


def family_links(firsts: DataFrame, known: DataFrame, size: int, percent: int, partitions: int) -> DataFrame | None:
    """Links (a, b) between components among classes that share a common first shingle. firsts: id, label, n, often."""
    dense = firsts.filter("often is not null").select("id", "label", "n", F.xxhash64("id", F.lit("class")).alias("node"), "often")
    if dense.isEmpty():
        return None
    # chance meetings of these hashes would only make families larger
    family = components(dense.select(F.col("node").alias("a"), F.explode("often").alias("k")).select("a", F.xxhash64("k", F.lit("key")).alias("b")))
    dense = dense.drop("often").join(family.withColumnRenamed("label", "family"), "node").select("id", "label", "n", "family")
    by_label = dense.groupBy("family", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    top = by_label.groupBy("family").agg(F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("c", "label")).alias("most"), F.max_by(F.struct("c", "s"), F.struct("c", "label")).alias("m"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    n_blocks = lambda c, s: F.greatest(F.ceil(c / BLOCK), F.ceil(s / BLOCK_SHINGLES), F.lit(1))
    top = top.filter("labels > 1").select("family", "most", F.col("c").alias("classes"), n_blocks(F.col("m.c"), F.col("m.s")).alias("wide"), n_blocks(F.col("c") - F.col("m.c"), F.col("s") - F.col("m.s")).alias("narrow"))
    rows = written(dense.join(top.hint("merge"), "family"))
    if rows.isEmpty():
        return None
    in_most = F.col("label") == F.col("most")
    block = F.pmod(F.xxhash64("id", F.lit("block")), F.when(in_most, F.col("wide")).otherwise(F.col("narrow")))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("narrow") - 1), lambda o: F.struct(F.when(in_most, o).otherwise(F.least(o, F.col("block"))).alias("x"), F.when(in_most, -F.col("block") - 1).otherwise(F.greatest(o, F.col("block"))).alias("y"), F.when(in_most, 1).when(o < F.col("block"), 1).otherwise(0).alias("side")))
    with_most = F.transform(F.sequence(F.lit(0).cast("long"), F.col("wide") - 1), lambda m: F.struct(F.col("block").alias("x"), (-m - 1).alias("y"), F.lit(0).alias("side")))
    groups = rows.withColumn("block", block).select("family", "id", "label", "n", F.explode(F.when(in_most, others).otherwise(F.concat(others, with_most))).alias("g"))
    groups = groups.select(F.xxhash64("family", "g.x", "g.y").alias("group"), "family", F.col("g.side").alias("side"), "id", "label", "n")
    texts = known.join(rows.select("id").hint("merge"), "id", "left_semi").groupBy("id").agg(F.max("text").alias("text"))
    sets = written(texts.mapInArrow(_sets(size), "id long, shingles binary"))
    # sets of one block go out once or twice as they are; those of several go to each as what they differ in from the family's centre
    many = F.col("wide") + F.col("narrow") > 2
    wide = rows.filter(many).select("id", "family", "classes").join(sets.hint("merge"), "id")
    in_centre = F.pmod(F.xxhash64("id", F.lit("centre")), F.ceil(F.col("classes") / CENTRE)) == 0
    centres = wide.filter(in_centre).select("family", "shingles").groupBy("family").applyInPandas(_centre, "family long, shingles binary")
    portions = F.ceil(F.col("classes") / PORTION)
    sizes = rows.filter(many).select("family", "classes").distinct()
    each = centres.join(sizes.hint("merge"), "family").select("family", F.explode(F.sequence(F.lit(0).cast("long"), portions - 1)).alias("portion"), F.lit(None).cast("long").alias("id"), "shingles")
    own = wide.select("family", F.pmod(F.xxhash64("id", F.lit("portion")), portions).alias("portion"), "id", "shingles")
    placed = own.unionByName(each).repartition(partitions, "family", "portion").sortWithinPartitions("family", "portion", F.asc_nulls_first("id"))
    differences = written(placed.mapInArrow(_differences, "id long, shingles binary"))
    whole = rows.filter(~many).select("id").join(sets.hint("merge"), "id").select("id", "shingles")
    groups = groups.join(differences.unionByName(whole).hint("merge"), "id").select("group", "family", "side", "id", "label", "n", "shingles")
    groups = groups.repartition(partitions, "group").sortWithinPartitions("group", "family")
    links = written(groups.mapInArrow(_family_links(percent), "a long, b long"))
    forget(firsts.sparkSession, [rows, sets, differences])
    return links


def _met(percent: int):
    """Pairs a < b of rows that share a key and lie in two components, and can reach the threshold if the key is their first
    common one. Of two such sets, the key is among the smaller one's earliest ones, which are fewer; those rows come first.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def out(key: np.ndarray, ids: np.ndarray, labels: np.ndarray, n: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
            end = np.searchsorted(key, key, side="right")
            left = np.flatnonzero((n - place) * (100 + percent) >= 2 * percent * n)
            found, held_pairs, d = [], 0, 1

            def sent() -> pa.RecordBatch:
                once = np.unique(np.concatenate(found), axis=0)
                return pa.RecordBatch.from_arrays([pa.array(once[:, 0]), pa.array(once[:, 1])], ["a", "b"])

            while len(left := left[end[left] > left + d]):
                i, j = left, left + d
                ok = (labels[i] != labels[j]) & (np.minimum(n[i] - place[i], n[j] - place[j]) * (100 + percent) >= percent * (n[i] + n[j]))
                i, j, d = i[ok], j[ok], d + 1
                if len(i):
                    found.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], 1))
                    held_pairs += len(i)
                if held_pairs > 500_000:
                    yield sent()
                    found, held_pairs = [], 0
            if found:
                yield sent()

        for x in batches:
            now = tuple(x.column(i).to_numpy() for i in range(5))
            if held is not None:
                now = tuple(np.concatenate(y) for y in zip(held, now, strict=True))
            if not len(now[0]):
                continue
            last = int(np.searchsorted(now[0], now[0][-1]))  # rows are sorted: the last key may go on
            if last:
                yield from out(*(y[:last] for y in now))
            held = tuple(y[last:] for y in now)
        if held is not None and len(held[0]):
            yield from out(*held)

    return run


def least_agreement(percent: int) -> int:
    """As many slots agree in all sets at the threshold but a share below MISS."""
    p, total, k = percent / 100, 0.0, 0
    while k < SLOTS and (total := total + math.comb(SLOTS, k) * p**k * (1 - p) ** (SLOTS - k)) < MISS:
        k += 1
    return k


def _low_bytes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([(np.frombuffer(x, np.uint16) & 0xFF).astype(np.uint8).tobytes() for x in b.column(1).to_pylist()], pa.binary())], ["id", "slots"])


def _alike(least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, SLOTS) for i in (2, 3))
            mask = pa.array((one == two).sum(1) >= least)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])

    return run


def _confirmed(size: int, percent: int):
    """Pairs whose full sets reach the threshold. Rows come sorted by a; a set in hand is kept."""

    def set_of(text: str) -> np.ndarray:
        return shingle_sets(Words(pa.array([text], pa.large_string()), lower=True), size)[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, None
        for b in batches:
            keep = []
            ids = b.column(0).to_pylist()
            for i, a in enumerate(ids):
                if a != last:
                    last, one = a, set_of(b.column(2)[i].as_py())
                two = set_of(b.column(3)[i].as_py())
                both = int(repeats.member(one, two).sum())
                keep.append(100 * both >= percent * (len(one) + len(two) - both) and both > 0)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id, kept.

    Two documents are linked if 100 * intersection >= percent * union of their sets of ``size``-word
    shingles (A-Z lower-cased; fewer words: the whole sequence). component_id is the smallest id that
    links lead to, kept says that the row's id is that one. Texts that are null or have no word are
    linked with nothing. Rows that repeat an id count as one document, whatever their texts.
    A null id gives a null component and kept true. An empty table gives an empty result. Only
    id_col and text_col are read.
    """
    with small_batches(docs.sparkSession, BATCH):
        return _near_duplicates(docs, percent, size, id_col, text_col)


def _near_duplicates(docs: DataFrame, percent: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """The jobs of near_duplicates; what is left to run of its result needs no Python."""
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    known = src.filter("id is not null")
    seen = written(src.mapInArrow(_summaries(size), "id long, n_shingles long, low long, high long, sig binary"))
    full = seen.filter("id is not null and n_shingles > 0")
    classes = full.groupBy("low", "high", "n_shingles").agg(F.min("id").alias("rep"), F.min("sig").alias("sig"))
    classes = classes.groupBy("rep").agg(F.min("sig").alias("sig"))
    n_shingles = int(full.agg(F.sum("n_shingles")).first()[0] or 0)
    n_ranges = max(repeats.shuffle_partitions(docs) * 4, n_shingles // RANGE)
    chunks = written(classes.select("rep", "sig").mapInArrow(_class_chunks(n_ranges), "chunk long, part long, keys binary, counts binary, id long, sig binary"))
    replies = repeats.repeated(chunks.filter("part is not null").select("chunk", "part", "keys", "counts"))
    own = chunks.filter("part is null").select("chunk", "id", "sig")
    members = written(own.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(_regions, "region long, id long, sketch binary, central long"))
    dense = members.filter("central is not null").select("region", "id", "central")
    hubs = dense.groupBy("region").agg(F.max_by("id", F.struct("central", -F.col("id"))).alias("hub_id"))
    spokes = dense.join(hubs.hint("merge"), "region").filter("id <> hub_id").select(F.least("id", "hub_id").alias("a"), F.greatest("id", "hub_id").alias("b"), F.lit(SKETCH).alias("agree"), F.lit(True).alias("hub"))
    regions = members.filter("central is null").select("region", "id", "sketch").repartition(repeats.shuffle_partitions(docs), "region").sortWithinPartitions("region", "id")
    pairs = regions.mapInArrow(_candidates(percent / 100), "a long, b long, agree int, hub boolean")
    slots = written(own.select("id", "sig").mapInArrow(_low_bytes, "id long, slots binary"))
    forget(docs.sparkSession, [chunks])
    pairs = written(pairs.unionByName(spokes).groupBy("a", "b").agg(F.max("agree").alias("agree"), F.max("hub").alias("hub")))

    forget(docs.sparkSession, [members])
    reps = classes.select(F.col("rep").alias("id"))

    def confirmed(some: DataFrame) -> DataFrame:
        ends = some.select(F.col("a").alias("id")).unionByName(some.select(F.col("b").alias("id"))).distinct()
        # hints: texts are never sent about by another plan at one size than at another
        texts = written(known.join(ends.hint("merge"), "id", "left_semi").groupBy("id").agg(F.max("text").alias("text")))
        one = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
        two = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
        with_texts = some.select("a", "b").join(two.hint("merge"), "b").join(one.hint("merge"), "a").select("a", "b", "ta", "tb")
        links = written(with_texts.mapInArrow(_confirmed(size, percent), "a long, b long"))
        forget(docs.sparkSession, [texts])
        return links

    ways = pairs.select("a", "b", "agree").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "agree"))
    best = ways.groupBy("a").agg(F.max_by("b", F.struct("agree", -F.col("b"))).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = written(best.unionByName(pairs.filter("hub").select("a", "b")).distinct())
    links = confirmed(first)
    # a class and its members are linked; so are texts that share an id
    copies = full.join(full.groupBy("low", "high", "n_shingles").agg(F.min("id").alias("rep")), ["low", "high", "n_shingles"]).select(F.col("rep").alias("a"), F.col("id").alias("b"))
    copies = copies.filter("a <> b")
    label = components(links)
    la, lb = (label.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    some = known.filter(f"pmod(xxhash64(id), {SHARE}) = 0").select("text").mapInArrow(_shingles(size), "key long")
    often = some.groupBy("key").count().filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "key").limit(MOST).collect()
    common, counts = np.array([r["key"] for r in often], np.int64).view(U), np.array([r["count"] for r in often], np.int64)
    order = np.argsort(common)
    common, counts = common[order], counts[order]
    labels = reps.join(label.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    firsts = known.mapInArrow(_first(size, percent, common, counts), "id long, n long, firsts binary, often array<long>").filter("n > 0")
    firsts = written(firsts.join(labels.hint("merge"), "id").select("id", "label", "n", "firsts", "often"))
    family = family_links(firsts, known, size, percent, n_ranges)
    meet = firsts.select("id", "label", "n", "firsts").mapInArrow(_meetings, MEETING).repartition(n_ranges // 2, "key")
    early = (F.col("n") - F.col("place")) * (100 + percent) >= 2 * percent * F.col("n")
    meet = meet.sortWithinPartitions("key", F.when(early, 0).otherwise(1)).select("key", "id", "label", "n", "place")
    met = meet.mapInArrow(_met(percent), "a long, b long").filter("a <> b").distinct()
    sa, sb = (slots.select(F.col("id").alias(x), F.col("slots").alias(f"s{x}")) for x in "ab")
    met = met.join(sa.hint("merge"), "a").join(sb.hint("merge"), "b").select("a", "b", "sa", "sb").mapInArrow(_alike(least_agreement(percent)), "a long, b long")
    rest = pairs.select("a", "b").join(first, ["a", "b"], "left_anti").join(la, "a", "left").join(lb, "b", "left")
    rest = rest.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
    rest = written(rest.unionByName(met).distinct().join(first, ["a", "b"], "left_anti"))
    links = links.unionByName(confirmed(rest))
    links = links.unionByName(family) if family is not None else links
    forget(docs.sparkSession, [firsts])
    label = components(links.unionByName(copies))
    out = seen.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("component_id", F.coalesce("label", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
