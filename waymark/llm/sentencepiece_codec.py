"""SentencePiece BPE encoding by a table of each prefix's last token, and decoding."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import ahocorasick
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from waymark.llm.common import bound_batches, read_table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Units whose ids a Python worker keeps at most; beyond that it starts afresh.
CACHE_UNITS = 500_000
#: Tested pairs kept at most.
CACHE_PAIRS = 1_000_000


class PrefixCodec:
    """Encoder and decoder of a merge-type (BPE) model with byte fallback, identity normalisation and a dummy prefix.

    The encoding of every prefix of a text ends with one last token, and the encoding is that of the
    prefix before it plus this token. So one pass fills a table: at each end, of the vocabulary's matches there
    (an Aho-Corasick automaton lists them), the last token is the one that can stand after the last token
    of the prefix before it, that is, whose two texts joined encode to just these two. Walking the
    table back from the end gives the ids.

    No piece of the vocabulary has a space mark after another character, so a text is encoded in
    units that begin at space marks; line ends, which no piece holds, stand alone. Units are kept.
    """

    def __init__(self, path: str | None = None) -> None:
        library = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL))
        self.bos, self.eos, n = library.bos_id(), library.eos_id(), library.get_piece_size()
        self.score: dict[str, tuple[float, int]] = {}
        self.surface: list[bytes] = []
        self.bytes_ids = [0] * 256
        for i in range(n):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes_ids[value] = i
                self.surface.append(bytes([value]))
            elif library.is_control(i):
                self.surface.append(b"")
            elif library.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            else:
                if SPACE in piece.lstrip(SPACE) or "\n" in piece:
                    raise ValueError("a piece joins two units")
                self.score[piece] = (library.get_score(i), i)
                self.surface.append(piece.replace(SPACE, " ").encode())
        self.automaton = ahocorasick.Automaton()
        for piece, (_, i) in self.score.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.pieces = {i: p for p, (_, i) in self.score.items()}
        self.is_byte = frozenset(self.bytes_ids)
        self.units = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+").findall
        self.fits: dict[tuple[int, int], bool] = {}
        self.ids_of: dict[str, bytes] = {}
        self.text_of: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best-scored neighbours, leftmost first."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s[0] > best):
                    best, at = s[0], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def can_follow(self, left: int, right: int) -> bool:
        """Whether the two tokens' joined text encodes to just these two."""
        held = self.fits.get((left, right))
        if held is None:
            if len(self.fits) > CACHE_PAIRS:
                self.fits.clear()
            a, b = self.pieces[left], self.pieces[right]
            held = self.fits[left, right] = self.merged(a + b) == [a, b]
        return held

    def encode_unit(self, unit: str) -> list[int]:
        """Ids of a unit by its prefix table."""
        n = len(unit)
        last, size = [-1] * n, [1] * n  # of unit[: k + 1]: id and characters of the last token; -1: a character outside the vocabulary
        get, can_follow = self.fits.get, self.can_follow
        for k, (length, i) in self.automaton.iter(unit):
            if last[k] >= 0:
                continue
            before = k - length
            if before >= 0 and (left := last[before]) >= 0:
                held = get((left, i))
                if held is None:
                    held = can_follow(left, i)
                if not held:
                    continue
            last[k], size[k] = i, length
        out: list[int] = []
        k = n - 1
        while k >= 0:
            if last[k] < 0:
                out.extend(self.bytes_ids[b] for b in reversed(unit[k].encode()))
                k -= 1
            else:
                out.append(last[k])
                k -= size[k]
        out.reverse()
        return out

    def learn(self, units: list[str]) -> None:
        """Fill the stores of ids and decoded bytes by unit."""
        ids_of, text_of, surface = self.ids_of, self.text_of, self.surface
        if len(ids_of) > CACHE_UNITS:
            ids_of.clear()
            text_of.clear()
        for unit in units:
            if unit not in ids_of:
                ids = self.encode_unit(unit)
                ids_of[unit] = struct.pack(f"<{len(ids)}I", *ids)
                text_of[unit] = b"".join(map(surface.__getitem__, ids))

    def split(self, text: str) -> list[str]:
        return self.units(SPACE + text.replace(" ", SPACE)) if text else []

    def encode_packed(self, text: str) -> tuple[bytes, bytes]:
        """Ids with begin and end, as little-endian unsigned 32-bit integers, and the decoded text in UTF-8."""
        units = self.split(text)
        try:
            ids = b"".join(map(self.ids_of.__getitem__, units))
        except KeyError:
            self.learn(units)
            ids = b"".join(map(self.ids_of.__getitem__, units))
        return struct.pack("<I", self.bos) + ids + struct.pack("<I", self.eos), b"".join(map(self.text_of.__getitem__, units))[1:]

    def encode(self, text: str) -> list[int]:
        """Ids with begin and end."""
        ids, _ = self.encode_packed(text)
        return list(struct.unpack(f"<{len(ids) // 4}I", ids))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the dummy prefix goes, and bytes that are no UTF-8 become replacement characters, one each."""
        out, run, first = [], bytearray(), True
        for i in [*ids, self.eos]:
            if i in self.is_byte:
                run += self.surface[i]
                first = False
                continue
            if run:
                out.append(_replace_bytes(bytes(run)))
                run.clear()
            text = self.surface[i].decode()
            if text and first:
                text = text.removeprefix(" ") if i in self.pieces else text
                first = False
            out.append(text)
        return "".join(out)


def _replace_bytes(run: bytes) -> str:
    """Bytes as UTF-8; each byte that begins no valid character becomes U+FFFD."""
    out, k = [], 0
    while k < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[k : k + n].decode())
            except UnicodeDecodeError:
                continue
            k += len(run[k : k + n])
            break
        else:
            out.append("�")
            k += 1
    return "".join(out)


_codec: PrefixCodec | None = None


def codec() -> PrefixCodec:
    """One per Python worker."""
    global _codec
    if _codec is None:
        _codec = PrefixCodec()
    return _codec


ENCODED = StructType([StructField("doc_id", LongType()), StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, sha = codec(), hashlib.sha256
    for batch in batches:
        n, a, b = [], [], []
        for text in batch.column(1).to_pylist():
            ids, decoded = own.encode_packed(text or "")
            n.append(len(ids) // 4)
            a.append(sha(ids).hexdigest())
            b.append(sha(decoded).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=ENCODED.names)
    # units stay for the worker's next task: they are bounded, and most of a task's work would be to learn them anew


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = codec()
    for batch in batches:
        ids = [own.encode(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row, with begin and end ids. A null text counts as empty; other columns are ignored."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_ids, "doc_id long, ids array<int>")


def codec_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, without a shuffle. A null text counts as empty; repeated rows
    and null ids stay; other columns are ignored."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_digests, ENCODED)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return codec_digests(read_table(spark, sf_dir, "documents"))
