"""Packing by concatenate and cut.

Pass 1 tokenizes every text once and writes its ids with the running token total inside its
partition. The partition totals (one row each) are summed up into each partition's global offset.
Pass 2 adds it: token number g of the whole corpus goes to sequence g // width, place g % width,
and a document that crosses windows leaves one boundary record per window.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import written
from tidemark.llm.words import slices

_encoders: dict[str, object] = {}


def encoder(name: str):
    """Byte-level BPE ids of a text for a vocabulary of public_tokenizers, by the ranks of the same name.

    Gives the ids that ``tokenizers`` gives for name.json with add_special_tokens=False, four times as
    fast; tests compare the two over every assigned code point. A run of white space too long for the
    faster one's regular expressions goes to ``tokenizers`` itself.
    """
    if name not in _encoders:
        import json

        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(f"{name}.tiktoken"), "rb"))}
        added = {x["content"]: x["id"] for x in json.load(open(public_tokenizers.path(f"{name}.json"), encoding="utf-8"))["added_tokens"]}
        e = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        plain: list = []

        def encode(text: str) -> np.ndarray:
            try:
                return np.asarray(e.encode_to_numpy(text, allowed_special="all"), dtype=np.uint32)
            except ValueError:
                if not plain:
                    from tokenizers import Tokenizer

                    plain.append(Tokenizer.from_file(public_tokenizers.path(f"{name}.json")))
                return np.array(plain[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)

        _encoders[name] = encode
    return _encoders[name]


def _tokenized(vocabulary: str, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for b in (x for whole in batches for x in slices(whole, 1)):
            ids, starts, counts = [], [], []
            for text in b.column(1).to_pylist():
                x = np.append(encode(text or ""), np.uint32(end_id)).astype(np.uint32)
                # two bytes an id where they all fit
                ids.append(x.astype(np.uint16).tobytes() if x.max() < 1 << 16 else b"\0" + x.tobytes())
                starts.append(at)
                counts.append(len(x))
                at += len(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(b), pa.int64()), b.column(0), pa.array(ids, pa.binary()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())],
                ["part", "id", "ids", "start_in_part", "doc_tokens"],
            )

    return run


def ids_of(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint32, offset=1) if len(b) % 2 else np.frombuffer(b, np.uint16).astype(np.uint32)


PIECE = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _cut(width: int, with_ids: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for key, raw, at, n in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                ids, done = ids_of(raw), 0
                while done < n:
                    sequence, offset = divmod(at + done, width)
                    length = min(width - offset, n - done)
                    piece = ids[done : done + length].astype("<u4").tobytes()
                    for x, v in zip(out, (key, done, length, zlib.crc32(piece), n, sequence, offset, piece if with_ids else None), strict=True):
                        x.append(v)
                    done += length
            types = [pa.int64()] * 7 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], [x.split()[0] for x in PIECE.split(", ")])

    return run


def pack(docs: DataFrame, width: int = 1024, vocabulary: str = "byte_bpe_50k", end_id: int = 0, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids
    (little-endian unsigned 32-bit; null unless with_ids).

    A null text counts as empty and still has its end id. Documents follow one another in the order of
    the input's partitions; all sequences but the last are full. Null and repeated ids are allowed: each row
    is packed. An empty table gives no piece. Only id_col and text_col are read.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = written(src.mapInArrow(_tokenized(vocabulary, end_id), "part long, id long, ids binary, start_in_part long, doc_tokens long"))
    totals = rows.groupBy("part").agg(F.max(F.col("start_in_part") + F.col("doc_tokens")).alias("n")).collect()  # one row a partition
    offsets, at = [], 0
    for r in sorted(totals, key=lambda r: r["part"]):
        offsets.append((r["part"], at))
        at += r["n"]
    shift = docs.sparkSession.createDataFrame(offsets, "part long, shift long")
    placed = rows.join(F.broadcast(shift), "part").select("id", "ids", (F.col("start_in_part") + F.col("shift")).alias("at"), "doc_tokens")
    pieces = placed.mapInArrow(_cut(width, with_ids), PIECE)
    return pieces.withColumnRenamed("id", id_col)
