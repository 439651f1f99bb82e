"""Spelling variants: words one edit apart, by full neighbourhoods.

Each word of the vocabulary offers all texts that one deletion, replacement or insertion of a letter of the observed
alphabet makes of it; those that are words themselves are its near words. Offers go as rolling hashes, each worked
out in constant time from the word's own, so a word of n letters offers about 2 n alphabet-sized rows of fixed size,
however long it is. A Bloom filter of bounded size drops most that are no words before they are shuffled; the others
meet the vocabulary by equality. No distance is measured: of the few that meet, the offered
text is made and compared with the word met, so a collision of hashes links nothing.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import bound_batches, drop, materialize, named, read_table, release_memory

#: Letters that make up words; runs of these are words.
LETTERS = r"A-Za-zÀ-ÿ"
MIN_CHARS = 6
MIN_COUNT = 5
#: A near word that occurs so many times as often is a word's form.
RATIO = 5
#: The query deletes a letter of a run whose CRC this divides.
DROP_EVERY = 199
#: Larger alphabets are an error: no script with so many signs is spelled letter by letter.
MAX_ALPHABET = 4096
#: Code points that are searched for runs at once, and words counted before they are passed on.
PIECE = 1 << 20
HELD = 1 << 16
#: Offers made at once, and words whose offers one task makes: a word has some thousand offers, so tasks can't follow from the vocabulary's bytes.
OFFERS = 1 << 16
TASK_WORDS = 1024
MOST_TASKS = 20_000
BASE = 0x9E3779B97F4A7C15
DELETED, REPLACED, INSERTED = 0, 1, 2
#: Bits of the filter a word, and at most: 32 MB, whatever the vocabulary. A fuller filter lets more offers pass to the join, no fewer.
WORD_BITS = 64
MOST_BITS = 1 << 28
MIXERS = (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def _pieces(text: str, outside: re.Pattern) -> Iterator[str]:
    """A text in pieces that cut no run."""
    at = 0
    while len(text) - at > PIECE and (m := outside.search(text, at + PIECE)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


_LOWER = {k: k + 32 for k in range(ord("A"), ord("Z") + 1)}


def counter(min_chars: int, drop_every: int | None, letters: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, text) -> (word, n), a word coming up in several rows."""

    def batch_of(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, outside, held = re.compile(f"[{letters}]{{{min_chars},}}"), re.compile(f"[^{letters}]"), Counter()
        for batch in batches:
            for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own: Counter = Counter()
                for piece in _pieces(text or "", outside):
                    own.update(run.findall(piece))
                start = zlib.crc32(f"{'' if row_id is None else row_id}:".encode())
                for raw, n in own.items():
                    word = raw.lower() if raw.isascii() else raw.translate(_LOWER)
                    if drop_every:
                        h = zlib.crc32(word.encode(), start)
                        if h % drop_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < min_chars:
                                continue
                    held[word] += n
                if len(held) > HELD:
                    yield batch_of(held)
                    held = Counter()
        yield batch_of(held)
        release_memory()

    return count


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, drop_every: int | None = None, letters: str = LETTERS) -> DataFrame:
    """(word, n) of all words with min_chars code points, A-Z as a-z.

    With drop_every, a run whose CRC with its row's id is a multiple loses a letter, which makes known misspellings; a null id counts as no
    digits. Null and empty texts have no words, repeated rows count each. Other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(named(id_col).alias("id"), named(text_col).alias("text"))
    return rows.mapInArrow(counter(min_chars, drop_every, letters), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _powers(n: int) -> np.ndarray:
    """BASE to the powers 0 to n - 1, modulo 2^64."""
    out = np.full(n, BASE, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _codes(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64)


def hash_of(word: str) -> int:
    """Signed 64-bit rolling hash."""
    codes = _codes(word)
    return int((codes * _powers(len(codes))).sum(dtype=np.uint64).astype(np.int64))


def offers(word: str, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(hashes, places, indices of letters, kind) of all distinct texts one edit away; within equal letters the first place stands for all."""
    codes, n = _codes(word), len(word)
    powers = _powers(n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * powers[:n], dtype=np.uint64)))
    whole, up, down = sums[n], np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64))
    first = np.concatenate((np.ones(1, bool), codes[1:] != codes[:-1])) if n else np.ones(0, bool)
    cuts = np.flatnonzero(first)
    if n > 1:
        yield sums[cuts] + (whole - sums[cuts + 1]) * down, cuts, np.zeros(len(cuts), np.int64), DELETED
    step = max(1, OFFERS // max(1, len(alphabet)))
    for a in range(0, n + 1, step):
        at = np.arange(a, min(a + step, n + 1))
        before = np.where(at > 0, codes[at - 1] if n else 0, 0)  # no letter is 0
        place, letter = np.nonzero(alphabet[None, :] != before[:, None])
        yield sums[at][place] + alphabet[letter] * powers[at][place] + (whole - sums[at])[place] * up, at[place], letter, INSERTED
        at = at[at < n]
        place, letter = np.nonzero(alphabet[None, :] != codes[at][:, None])
        yield whole + (alphabet[letter] - codes[at][place]) * powers[at][place], at[place], letter, REPLACED


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) -> (word, n, key)."""
    for batch in batches:
        keys = [hash_of(w) for w in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64())], names=["word", "n", "key"])


OFFER = "own long, key long, at int, letter int, kind int"


def _slots(keys: np.ndarray, width: int) -> list[np.ndarray]:
    """Two places of each key in a filter of 2^width bits."""
    return [(keys * np.uint64(m)) >> np.uint64(64 - width) for m in MIXERS]


def _filter(vocabulary: DataFrame, n_words: int) -> np.ndarray:
    """A Bloom filter of the vocabulary's keys, as 64-bit words; its bits are combined before they come to the driver."""
    width = max(6, (min(MOST_BITS, WORD_BITS * max(1, n_words)) - 1).bit_length())

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_slots(batch.column(0).to_numpy().view(np.uint64), width))
            bits = np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bits.view(np.int64))], names=["at", "bits"])

    rows = vocabulary.select("key").mapInArrow(places, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (width - 6), np.uint64)
    table[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return table


def _passed(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    width = len(table).bit_length() + 5
    a, b = ((table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) for at in _slots(keys, width))
    return np.flatnonzero(a & b)


def _offering(alphabet: np.ndarray, table: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(word, key) -> offers that the filter lets pass, those of several words in one batch."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, n = table.value, [], 0
        for batch in batches:
            for word, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for keys, at, letter, kind in offers(word, alphabet):
                    some = _passed(known, keys)
                    held.append((np.full(len(some), own, np.int64), keys[some].view(np.int64), at[some].astype(np.int32), letter[some].astype(np.int32), np.full(len(some), kind, np.int32)))
                    n += len(some)
                if n >= OFFERS:
                    yield joined(held)
                    held, n = [], 0
        if held:
            yield joined(held)
        release_memory()

    def joined(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=["own", "key", "at", "letter", "kind"])

    return made


def _edited(word: Column, at: Column, letter: Column, kind: Column) -> Column:
    """The text that an offer stands for."""
    rest = F.substring(word, at + F.when(kind == INSERTED, 1).otherwise(2), F.length(word))
    return F.concat(F.substring(word, F.lit(1), at), F.when(kind == DELETED, "").otherwise(letter), rest)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, near, near_n) of all pairs, both ways, of a written vocabulary (word, n, key) of distinct words that aren't null."""
    seen = vocabulary.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at")).select(F.substring(F.col("word"), F.col("at"), F.lit(1)).alias("letter")).distinct()
    alphabet = sorted(r["letter"] for r in seen.limit(MAX_ALPHABET + 1).collect())
    if len(alphabet) > MAX_ALPHABET:
        raise ValueError(f"an alphabet of more than {MAX_ALPHABET} letters")
    n_words = vocabulary.count()
    tasks, table = min(MOST_TASKS, 1 + n_words // TASK_WORDS), vocabulary.sparkSession.sparkContext.broadcast(_filter(vocabulary, n_words))
    made = vocabulary.select("word", "key").repartition(tasks, "key").mapInArrow(_offering(np.array([ord(c) for c in alphabet], np.uint64), table), OFFER)
    own = vocabulary.select(F.col("key").alias("own"), "word")
    near = vocabulary.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = made.join(near, "key").join(own, "own")
    letter = F.element_at(F.lit(alphabet or [""]), F.col("letter") + 1)
    return pairs.where(_edited(F.col("word"), F.col("at"), letter, F.col("kind")) == F.col("near")).select("word", "near", "near_n").distinct()


def spelling_variants(counts: DataFrame, min_count: int = MIN_COUNT, ratio: float = RATIO) -> DataFrame:
    """Of (word, n), one row a word: (word, form, root, n, n_near, form_n).

    Words are those with n of min_count or more; null and empty ones go, rows of a word that repeats add up. n_near counts the near words. form is the near word of the
    largest n, of several the first in code-point order, if that n is ratio times the word's or more; form_n is its n. root is where the forms
    of forms end, the word itself without one. As n grows ratio-fold at each step, forms can't go round, and doubling finds all roots in a
    few rounds. Other columns are ignored; no rows give none.
    """
    if ratio <= 1:
        raise ValueError("a form must be more frequent than its word")
    bound_batches(counts.sparkSession)
    own = counts.where(F.length("word") > 0).groupBy("word").agg(F.sum("n").cast("long").alias("n")).where(F.col("n") >= min_count)
    vocabulary = materialize(own.mapInArrow(_hashed, "word string, n long, key long"))
    best = near_words(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = vocabulary.select("word", "n").join(best, "word", "left")
    is_form = -F.col("best.less") >= ratio * F.col("n")
    formed = materialize(known.select("word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    drop(vocabulary)
    roots = materialize(formed.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = materialize(roots.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        more = not stepped.where("moved").isEmpty()
        drop(roots)
        if not more:
            break
        roots = materialize(stepped.select("word", "root"))
        drop(stepped)
    return formed.join(stepped.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of documents with their near words and forms."""
    return spelling_variants(word_counts(read_table(spark, sf_dir, "documents"), drop_every=DROP_EVERY))


#: CRC-32 by a table of 256 rows that a rule gives; near words by equal texts without one letter; roots by recursion.
OP13_SQL = """
WITH RECURSIVE bits(b, k, v) AS (
  SELECT b, 0, b::BIGINT FROM range(256) t(b)
  UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
found AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')) AS run FROM documents WHERE text IS NOT NULL)),
own AS (SELECT doc_id, run, count(*) AS n FROM found WHERE length(run) >= 6 GROUP BY ALL),
crcs AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 1 + octet_length(encode(coalesce(doc_id::VARCHAR, '') || ':' || run))),
      lambda i: ('0x' || substr(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), 2 * i - 1, 2))::BIGINT)),
    lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)]))) AS h
  FROM own, crc_table),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM crcs)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS MATERIALIZED (
  SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS short FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.short = b.short AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.short = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.short = b.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM near GROUP BY word),
formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
    CASE WHEN b.top >= 5 * w.n THEN (SELECT min(x.near) FROM near x WHERE x.word = w.word AND x.near_n = b.top) END AS form,
    CASE WHEN b.top >= 5 * w.n THEN b.top END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
chain(word, place, k) AS (
  SELECT word, word, 0 FROM formed
  UNION ALL SELECT c.word, f.form, c.k + 1 FROM chain c JOIN formed f ON f.word = c.place WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(place, k) AS root FROM chain GROUP BY word)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN roots r ON f.word = r.word
"""
