"""Substring dedup: remove every word covered by a window of ``n_words`` words that also starts elsewhere.

Level-wise doubling. A level has a length; every n-word window is represented at that level by the
smallest hash among the windows of that length inside it, so two equal n-word windows always have
the same representative and only about 2 / (n - length + 2) of the windows are looked at. A
window whose representative occurs once in all texts is done; windows whose representative repeats
at one length are extended to twice that length, up to n_words itself, where the representative
is the window. Keys are counted by ``repeats.repeated``: one packed entry per chunk and key.

Texts cross the network once on their way to level 2, and after that only those of documents with
surviving windows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import repeats
from tidemark.llm.scratch import forget, written
from tidemark.llm.words import Words, blob, slices, unblob

#: Text bytes whose keys go out as one chunk, and whose rows meet the replies in one group.
CHUNK = 16 << 20


def level_lengths(n_words: int, first: int | None = None) -> list[int]:
    """Lengths of the levels: ``first``, doubled while shorter than n_words, then n_words."""
    length, out = first or max(1, -(-n_words // 2)), []
    while length < n_words:
        out.append(length)
        length *= 2
    return [*out, n_words]


def sliding(a: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of a[i:i + width] for each i, by doubling."""
    span = 1
    while 2 * span <= width:
        a = best(a[:-span], a[span:])
        span *= 2
    return best(a[: len(a) - (width - span)], a[width - span :]) if width > span else a


def representatives(words: Words, n: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start of each n-word window, its representative's hash, start of each window of this length, its hash)."""
    inner_at, inner = words.windows(length)
    at = words.windows(n)[0]
    if not len(at):
        return at, np.zeros(0, np.uint64), inner_at, inner
    if n == length:
        return at, inner, inner_at, inner
    width = n - length + 1
    low = sliding(inner, width, np.minimum)
    return at, low[np.searchsorted(inner_at, at)], inner_at, inner


def chosen(at: np.ndarray, rep: np.ndarray, inner_at: np.ndarray, inner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the inner windows that represent one of the given windows; each position once."""
    if width == 1:
        return at, rep
    if not len(at):
        return at, rep
    first = np.searchsorted(inner_at, at)
    mark = np.zeros(len(inner), dtype=bool)
    for k in range(width):  # the representatives' places, in steps over whole arrays
        mark[first[inner[first + k] == rep] + k] = True
    return inner_at[mark], inner[mark]


def spans_of(flags: np.ndarray) -> np.ndarray:
    """[start, end) of each run of True, flattened."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.astype(np.int64)


def inside(spans: np.ndarray, n: int) -> np.ndarray:
    """The flags of which spans_of() made these spans."""
    step = np.zeros(n + 1, dtype=np.int64)
    step[spans[0::2]] += 1
    step[spans[1::2]] -= 1
    return np.cumsum(step[:-1]) > 0


def kept(words: Words, i: int, removed: np.ndarray | None, verbatim: bool) -> tuple[str, int, int]:
    """(kept words joined by one space, words, removed words) of text i; with ``verbatim`` a text that loses none as it is."""
    text = words.data[words.offsets[i] : words.offsets[i + 1]].tobytes()
    each = text.split()
    if removed is None or not removed.any():
        return (text if verbatim else b" ".join(each)).decode(), len(each), 0
    return b" ".join(w for w, gone in zip(each, removed, strict=True) if not gone).decode(), len(each), int(removed.sum())


def _messages(chunk: int, keys: list[np.ndarray], n_ranges: int) -> Iterator[tuple]:
    if keys:
        for part, k, c in repeats.packed(np.concatenate(keys), n_ranges):
            yield chunk, part, k, c


def _first_level(n: int, length: int, n_ranges: int):
    """Of each row the keys at the first level; of each chunk its messages."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_id = TaskContext.get().partitionId()
        chunk, size, pending, rows = part_id << 24, 0, [], []

        def flush() -> pa.RecordBatch:
            sent = list(_messages(chunk, pending, n_ranges))
            out = [(chunk, None, k, None, row) for row, k in rows] + [(*m, None) for m in sent]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()))],
                ["chunk", "part", "keys", "counts", "row_key"],
            )

        for whole in batches:
            for b in slices(whole, 1):
                w = Words(b.column(1))
                at, rep, inner_at, inner = representatives(w, n, length)
                pos, key = chosen(at, rep, inner_at, inner, n - length + 1)
                cut = np.searchsorted(pos, w.doc_at)
                for i, row in enumerate(b.column(0).to_pylist()):
                    if cut[i + 1] > cut[i]:
                        rows.append((row, blob(np.unique(key[cut[i] : cut[i + 1]]))))
                pending.append(key)
                size += len(w.data)
                if size >= CHUNK:
                    yield flush()
                    chunk, size, pending, rows = chunk + 1, 0, [], []
        if rows or pending:
            yield flush()

    return run


def _own_repeats(own: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
    """Of each row in a chunk, those of its keys that repeat."""
    known, _ = repeats.joined(replies)
    out = []
    for row, b in zip(own["row_key"], own["keys"], strict=True):
        k = unblob(b)
        if len(k := k[repeats.member(known, k)]):
            out.append((row, blob(k)))
    return pd.DataFrame(out, columns=["row_key", "known"])


ROW = "chunk long, part long, keys binary, counts binary, alive binary, n_words long, n_removed long, kept_text string"


def _next_level(n: int, length: int, following: int, n_ranges: int, schema: pa.Schema, text_at: int, known_at: int, verbatim: bool):
    """Rows with the keys known to repeat at one level: which windows survive, and their keys at the next level."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size, pending = TaskContext.get().partitionId() << 24, 0, []
        carried = [i for i in range(len(schema) - len(ROW.split(", ")))]

        def built(b: pa.RecordBatch | None, cols: dict[str, list]) -> pa.RecordBatch:
            n_rows = len(cols["chunk"])
            arrays = [b.column(i + 2).cast(schema.field(i).type) if b is not None else pa.nulls(n_rows, schema.field(i).type) for i in carried]
            if b is not None:  # a finished row's text is done with
                arrays[-1] = arrays[-1].take(pa.array([i if a is not None else None for i, a in enumerate(cols["alive"])], pa.int64()))
            arrays += [pa.array(cols.get(f.name) or [None] * n_rows, f.type) for f in list(schema)[len(carried) :]]
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        def sent() -> pa.RecordBatch | None:
            m = list(_messages(chunk, pending, n_ranges))
            return built(None, {"chunk": [x[0] for x in m], "part": [x[1] for x in m], "keys": [x[2] for x in m], "counts": [x[3] for x in m]}) if m else None

        for whole in batches:
            for b in slices(whole, text_at):
                w = Words(b.column(text_at))
                known = [unblob(x) for x in b.column(known_at).to_pylist()]
                cols: dict[str, list] = {k: [] for k in ("chunk", "alive", "n_words", "n_removed", "kept_text")}
                at, rep, _, _ = representatives(w, n, length)
                next_rep = inner_at = inner = None
                cut = np.searchsorted(at, w.doc_at)
                for i, k in enumerate(known):
                    a, z = cut[i], cut[i + 1]
                    flags = repeats.member(k, rep[a:z]) if len(k) and z > a else np.zeros(z - a, dtype=bool)
                    if flags.any():
                        if inner is None:
                            _, next_rep, inner_at, inner = representatives(w, n, following)
                        pending.append(chosen(at[a:z][flags], next_rep[a:z][flags], inner_at, inner, n - following + 1)[1])
                        size += int(w.offsets[i + 1] - w.offsets[i])
                        done, alive = (None, None, None), blob(spans_of(flags))
                    else:
                        done, alive = kept(w, i, None, verbatim), None
                    cols["chunk"].append(chunk)
                    cols["alive"].append(alive)
                    for name, v in zip(("kept_text", "n_words", "n_removed"), done, strict=True):
                        cols[name].append(v)
                yield built(b, cols)
                if size >= CHUNK:
                    if (m := sent()) is not None:
                        yield m
                    chunk, size, pending = chunk + 1, 0, []
        if (m := sent()) is not None:
            yield m

    return run


def _last_level(n: int, carry: list[str], verbatim: bool):
    """Rows of a chunk with surviving windows, and the replies for full windows: what stays of each text."""

    def run(own: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        known, _ = repeats.joined(replies)
        texts, counts, gone = [], [], []
        for text, alive in zip(own["text"], own["alive"], strict=True):
            w = Words(pa.array([text], pa.large_string()))
            at, h = w.windows(n)
            hit = np.zeros(len(at), dtype=bool)
            live = inside(unblob(alive, np.int64), len(at))
            hit[live] = repeats.member(known, h[live])
            step = np.zeros(len(w.hashes) + 1, dtype=np.int64)
            step[at[hit]] += 1
            np.subtract.at(step, at[hit] + n, 1)
            t, a, b = kept(w, 0, np.cumsum(step[:-1]) > 0, verbatim)
            texts.append(t)
            counts.append(a)
            gone.append(b)
        return own[carry].assign(n_words=counts, n_removed=gone, kept_text=texts)

    return run


def _middle_level(n: int, length: int):
    """Rows of a chunk and the replies at one level: of each row, those of its keys that repeat."""

    def run(own: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        known, _ = repeats.joined(replies)
        out = []
        for text, alive in zip(own["text"], own["alive"], strict=True):
            w = Words(pa.array([text], pa.large_string()))
            at, rep, _, _ = representatives(w, n, length)
            rep = np.unique(rep[inside(unblob(alive, np.int64), len(at))])
            out.append(blob(rep[repeats.member(known, rep)]))
        return own.drop(columns=["alive", "chunk"]).assign(known=out)

    return run


def remove_repeats(docs: DataFrame, n_words: int = 35, first: int | None = None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), verbatim: bool = False) -> DataFrame:
    """One row per input row: id_col, the columns of ``carry``, n_words, n_removed, kept_text (with ``verbatim``, a text that
    loses nothing keeps its white space).

    Windows are judged on the input, all copies go. Words are runs of bytes other than ASCII white
    space, compared unchanged. A null text counts as empty and yields kept_text ''; a text of fewer
    words than n_words keeps all. Rows repeated whole count as further occurrences. Null ids are
    allowed. An empty table gives an empty result. Only the named columns are read, so others may
    have any names.
    """
    lengths = level_lengths(n_words, first)
    if len(lengths) == 1:
        lengths = [n_words, n_words]
    names = [id_col, *carry]
    src = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # equal rows share a row key and then have the same keys and the same result
    src = src.withColumn("row_key", F.xxhash64(F.col("c0"), F.col("text")))
    n_ranges = repeats.ranges_for(repeats.text_bytes(src, "text"), repeats.shuffle_partitions(docs))

    level = written(src.select("row_key", "text").mapInArrow(_first_level(n_words, lengths[0], n_ranges), "chunk long, part long, keys binary, counts binary, row_key long"))
    messages = level.filter("part is not null").select("chunk", "part", "keys", "counts")
    own = level.filter("part is null").select("chunk", "row_key", "keys")
    known = own.groupBy("chunk").cogroup(repeats.repeated(messages).groupBy("chunk")).applyInPandas(_own_repeats, "row_key long, known binary")
    known = known.groupBy("row_key").agg(F.first("known").alias("known"))
    rows = src.join(known, "row_key", "left")

    kept_names = [f"c{i}" for i in range(len(names))] + ["text"]
    finished, used = None, level
    for length, following in zip(lengths, lengths[1:], strict=False):
        shape = rows.select("row_key", "known", *kept_names)
        struct = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shape.schema.fields[2:]) + ", " + ROW
        arrow = _arrow_schema(docs, struct)
        level = written(shape.mapInArrow(_next_level(n_words, length, following, n_ranges, arrow, 2 + len(names), 1, verbatim), struct))
        forget(docs.sparkSession, [used] if used is not None else [])
        used = None
        messages = level.filter("part is not null").select("chunk", "part", "keys", "counts")
        alive = level.filter("part is null and alive is not null").select("chunk", "alive", *kept_names)
        replies = repeats.repeated(messages).groupBy("chunk")
        if following != n_words:
            names_now = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in alive.schema.fields[2:])
            rows = alive.groupBy("chunk").cogroup(replies).applyInPandas(_middle_level(n_words, following), names_now + ", known binary")
            rows = rows.withColumn("row_key", F.lit(0).cast("long"))
        done = level.filter("part is null and alive is null").select(*kept_names[:-1], "n_words", "n_removed", "kept_text")
        finished = done if finished is None else finished.unionByName(done)
    last = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in finished.schema.fields)
    changed = alive.groupBy("chunk").cogroup(replies).applyInPandas(_last_level(n_words, kept_names[:-1], verbatim), last)
    return finished.unionByName(changed).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "n_words", "n_removed", "kept_text")


def _arrow_schema(df: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
