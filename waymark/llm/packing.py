"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups."""

from __future__ import annotations

import base64
import json
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from tokenizers import Tokenizer

from waymark.llm.common import bound_batches, materialize, named, read_table, release_memory

SEQUENCE = 1024
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: Mean number of pieces in a group; a group is one task's work and memory.
GROUP_PIECES = 8192


class ByteBpe:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    Texts go through the merge table as they are. Those that hold a special token's string go to the tokenizers library, which gives it an id
    of its own; so do those whose splitting pattern gives up, as on a million white spaces in a row.
    """

    def __init__(self, path: str | None = None, ranks: str | None = None) -> None:
        self.path = path or public_tokenizers.path(TOKENIZER)
        self.library: Tokenizer | None = None  # rarely needed, and large
        with open(self.path, encoding="utf-8") as f:
            self.specials = [t["content"] for t in json.load(f)["added_tokens"]]
        with open(ranks or public_tokenizers.path(RANKS), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not any(x in text for x in self.specials):
            try:
                return self.bpe.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
            except ValueError:  # the pattern's stack is exhausted
                pass
        self.library = self.library or Tokenizer.from_file(self.path)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_codec: ByteBpe | None = None


def codec() -> ByteBpe:
    """One per Python worker."""
    global _codec
    if _codec is None:
        _codec = ByteBpe()
    return _codec


PIECE = StructType([StructField(c, LongType()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt")])


def salt(doc_id: int | None, start: int, crc: int, times: int) -> int:
    """A piece's random number: of its content, and of how often the task has met it, so that copies part and other pieces' numbers don't depend on the split."""
    return xxhash.xxh3_64_intdigest(struct.pack("<?qqqq", doc_id is None, doc_id or 0, start, crc, times)) >> 2


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> pieces of at most SEQUENCE ids."""
    bpe, met = codec(), Counter()
    end = np.array([END_ID], "<u4").tobytes()
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = bpe.encode(text) + end
            n, own = len(ids) // 4, (doc_id, zlib.crc32(ids))
            times = met[own]
            met[own] = times + 1
            for at in range(0, n, SEQUENCE):
                part = ids[4 * at : 4 * (at + SEQUENCE)]
                crc = zlib.crc32(part)
                rows.append((doc_id, at, len(part) // 4, crc, n, salt(doc_id, at, crc, times)))
        if rows:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=PIECE.names)
    release_memory()


def first_fit(lengths: list[int], capacity: int = SEQUENCE) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, in the order given; each goes to the first bin with room.

    A tournament tree holds the largest free capacity below each node, so the first bin that fits is
    found, and the tree mended, in steps logarithmic in the number of bins.
    """
    size = 1 << max(0, len(lengths) - 1).bit_length()
    free = [capacity] * (2 * size)
    bins, offsets = [], []
    for length in lengths:
        if length > capacity:
            raise ValueError("an item is longer than a bin")
        node = 1
        while node < size:
            node *= 2
            if free[node] < length:
                node += 1
        bins.append(node - size)
        offsets.append(capacity - free[node])
        free[node] -= length
        while node > 1:
            node //= 2
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
    return bins, offsets


PACKED = StructType([StructField(c, LongType()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack_group(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["length", "salt"], ascending=[False, True], kind="stable")
    bins, offsets = first_fit(group["length"].tolist())
    group = group.assign(sequence_id=(int(key[0]) << 32) + np.array(bins, np.int64), offset=np.array(offsets, np.int64))
    return group[PACKED.names]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces of all rows of docs, each at one place of a sequence of at most 1024 ids.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Each row of docs is a document, repeated rows
    too; a null or empty text is the end id alone; a null id stays null. No rows give no pieces. Other
    columns are ignored. Sequence ids are unique: the group's number times 2^32 plus the bin's.
    """
    bound_batches(docs.sparkSession)
    pieces = materialize(docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text")).mapInArrow(cut, PIECE))
    groups = max(1, -(-pieces.count() // group_pieces))
    return pieces.withColumn("bundle", F.col("salt") % groups).groupBy("bundle").applyInPandas(pack_group, PACKED)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, packed."""
    return pack(read_table(spark, sf_dir, "documents"))
