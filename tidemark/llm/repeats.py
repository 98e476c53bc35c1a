"""Which keys occur more than once in all chunks together.

Chunks send each of their keys once, packed by key range; a reducer holds one range. So a key
found in a third of all rows costs one entry per chunk, and no group of rows is ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import U, blob, unblob

REPLY = "chunk long, keys binary, totals binary"


def ranges_for(total_bytes: int, partitions: int) -> int:
    """Key ranges such that one holds the keys of about 16 MB of text."""
    return int(max(partitions, 32, total_bytes // (16 << 20)))


def packed(keys: np.ndarray, n: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(range, sorted distinct keys, their counts) of a chunk for each of the n ranges that it meets."""
    distinct, counts = np.unique(keys, return_counts=True)
    # ranges are equal parts of the upper 32 bits
    part = ((distinct >> U(32)) * U(n)) >> U(32)
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(distinct)], strict=True):
        if b > a:
            yield int(part[a]), blob(distinct[a:b]), blob(counts[a:b].astype(np.uint32))


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    keys = [unblob(b) for b in group["keys"]]
    counts = [unblob(b, np.uint32) for b in group["counts"]]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate(counts), minlength=len(every)).astype(np.int64)
    rows, at = [], 0
    for chunk, k in zip(group["chunk"], keys, strict=True):
        mine = total[place[at : at + len(k)]]
        at += len(k)
        if (hit := mine > 1).any():
            rows.append((chunk, blob(k[hit]), blob(np.minimum(mine[hit], 2**32 - 1).astype(np.uint32))))
    return pd.DataFrame(rows, columns=["chunk", "keys", "totals"])


def repeated(messages: DataFrame) -> DataFrame:
    """messages: chunk, part, keys, counts. Returns for each chunk and part the keys whose counts sum to 2 or more."""
    return messages.groupBy("part").applyInPandas(_answer, REPLY)


def joined(replies: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The replies to one chunk as sorted keys and totals."""
    if not len(replies):
        return np.zeros(0, U), np.zeros(0, np.uint32)
    keys = np.concatenate([unblob(b) for b in replies["keys"]])
    totals = np.concatenate([unblob(b, np.uint32) for b in replies["totals"]])
    order = np.argsort(keys)
    return keys[order], totals[order]


def member(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return sorted_keys[at] == x


def text_bytes(docs: DataFrame, text: str) -> int:
    return int(docs.select(F.sum(F.octet_length(text).cast("long")).alias("n")).first()["n"] or 0)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
