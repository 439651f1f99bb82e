"""Language identification by cross-parsing against suffix automata.

A suffix automaton of a bounded sample of labelled text stands for each language. A text is parsed
against it from left to right into longest matches (phrases); a language that needs fewer phrases,
normalised by the length of its sample, is likelier. All texts of a batch are walked side by side, each from its
first character to its last; where few are long enough to go on, each goes on alone.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from waymark.llm.common import BROADCAST_ROWS, bound_batches, read_table, release_memory

#: Fit: characters of each language's sample, of all samples together (many languages share it), and sampled documents of a language, at most.
TRAIN_CHARS = 32_768
TOTAL_CHARS = 1 << 21
TRAIN_DOCS = 256
#: Languages from which labels are taken as broken: an error, since every language is learned.
MAX_LANGS = 10_000
#: Bytes up to which the transitions of all automata are one table of all symbols; beyond, each is looked up among those that exist.
DENSE_BYTES = 128 << 20
#: Texts that are worth walking side by side.
ABREAST = 24
#: Share of the evidence, in bits, that counts for the score: neighbouring phrases aren't independent.
TEMPER = 0.1
UNKNOWN = "und"
VERDICT = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])


def symbol_table(samples: dict[str, str]) -> tuple[np.ndarray, int]:
    """Code point -> symbol, letters by their lower case, all else a gap; and the number of symbols.

    Every letter of the samples has a symbol of its own; symbol 0 is any other letter, 1 a gap.
    """
    counts: dict[str, int] = {}
    for text in samples.values():
        for c in text.lower():
            if c.isalpha():
                counts[c] = counts.get(c, 0) + 1
    letters = sorted(counts, key=lambda c: (-counts[c], c))
    own = {c: k + 2 for k, c in enumerate(letters)}
    table = np.ones(sys.maxunicode + 1, np.min_scalar_type(len(own) + 1))
    for k in range(sys.maxunicode + 1):
        c = chr(k)
        if c.isalpha():
            table[k] = own.get(low, 0) if len(low := c.lower()) == 1 else own.get(low[0], 0)
    return table, len(own) + 2


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    """Symbols of a text, runs of gaps as one and none at the ends."""
    codes = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    gap = codes == 1
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    codes = codes[keep]
    return codes[(codes[:1] == 1).sum() : len(codes) - (codes[1:][-1:] == 1).sum()]


def suffix_automaton(text: list[int]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The suffix automaton of a symbol sequence: number of states, and of each transition the state, the symbol and the next state; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    length, link = [0], [-1]
    last = 0
    for c in text:
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = twin
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
        last = cur
    state, symbol, to = np.array([(s, c, t) for s, own in enumerate(step) for c, t in own.items()], np.int64).reshape(-1, 3).T
    return len(step), state, symbol, to


class LanguageModel:
    """Automata of all languages in one table, or in sorted lists where that were too large; entries are offsets of rows, 0 means no transition."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.langs = sorted(samples)
        self.table, self.width = symbol_table(samples)
        width = self.width
        moves, firsts, sizes, at = [], [], [], 1
        for lang in self.langs:
            seen = symbols(samples[lang], self.table).tolist()
            n, state, symbol, to = suffix_automaton(seen)
            # a state without transitions: a symbol that the sample lacks is a phrase of its own
            first = np.full(width, (at + n) * width, np.int64)
            first[symbol[state == 0]] = (to[state == 0] + at) * width
            firsts.append(first)
            key = (state + at) * width + symbol
            order = np.argsort(key)
            moves.append((key[order], (to[order] + at) * width))
            sizes.append(max(2, len(seen)))
            at += n + 1
        self.first = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
        #: Sorted offsets and where they lead, by language; the table of all is made of them where it is used, so that it is never sent.
        end = np.array([np.iinfo(np.int64).max])
        self.moves = [(np.concatenate((key, end)), np.concatenate((to, [0]))) for key, to in moves]
        self.size, self.dense = at * width, at * width * 4 <= DENSE_BYTES
        self.step: np.ndarray | None = None
        self.bits = np.array([math.log2(n) for n in sizes])
        self.by_key: dict[int, dict[int, int]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"step": None, "by_key": {}}

    def _ready(self) -> None:
        """Make the table of all transitions."""
        if self.dense and self.step is None:
            self.step = np.zeros(self.size, np.int32)
            for key, to in self.moves:
                self.step[key[:-1]] = to[:-1]

    def _next(self, lang: int, at: np.ndarray) -> np.ndarray:
        """Where the transitions at these offsets lead."""
        if self.step is not None:
            return self.step.take(at)
        key, to = self.moves[lang]
        k = np.searchsorted(key, at)
        return np.where(key.take(k) == at, to.take(k), 0)

    def phrases(self, codes: list[np.ndarray]) -> np.ndarray:
        """Phrases of each symbol sequence (rows) against each language (columns)."""
        out = np.zeros((len(codes), len(self.langs)), np.int64)
        sizes = np.fromiter(map(len, codes), np.int64, len(codes))
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        if not len(order) or not self.langs:
            return out
        self._ready()
        abreast = int(sizes[order[ABREAST - 1]]) if len(order) >= ABREAST else 1
        live = np.searchsorted(-sizes[order], -np.arange(abreast), side="left")  # texts longer than t
        states, counts = np.zeros((len(self.langs), len(order)), np.int64), np.zeros((len(self.langs), len(order)), np.int64)
        for start in range(0, abreast, 1024):  # the grid is made in slices, so that its size is bounded
            stop = min(abreast, start + 1024)
            grid = np.zeros((stop - start, live[start]), np.int32)
            for column in range(live[start]):
                part = codes[order[column]][start:stop]
                grid[: len(part), column] = part
            for j in range(len(self.langs)):
                first = self.first[j * self.width : (j + 1) * self.width]
                state, count = states[j], counts[j]
                for t in range(start, stop):
                    m = live[t]
                    now = grid[t - start, :m]
                    if t:
                        to = self._next(j, state[:m] + now)
                        ended = to == 0
                        count[:m] += ended
                        state[:m] = np.where(ended, first.take(now), to)
                    else:
                        state[:], count[:] = first.take(now), 1
        for column in range(len(order)):
            if sizes[order[column]] <= abreast:
                break
            rest = codes[order[column]][abreast:].tolist()
            for j in range(len(self.langs)):
                counts[j, column] += self._alone(j, int(states[j, column]), rest)
        out[order] = counts.T
        return out

    def _alone(self, lang: int, state: int, rest: list[int]) -> int:
        """Phrases that begin in the rest of one sequence."""
        first, count = self.first[lang * self.width : (lang + 1) * self.width].tolist(), 0
        if self.step is not None:
            step = memoryview(self.step)
            for c in rest:
                state = step[state + c]
                if not state:
                    count += 1
                    state = first[c]
            return count
        if lang not in self.by_key:
            key, to = self.moves[lang]
            self.by_key[lang] = dict(zip(key.tolist(), to.tolist(), strict=True))
        get = self.by_key[lang].get
        for c in rest:
            state = get(state + c, 0)
            if not state:
                count += 1
                state = first[c]
        return count

    def classify(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        codes = [symbols(t, self.table) if t else np.zeros(0, np.uint8) for t in texts]
        bits = self.phrases(codes) * self.bits
        langs, scores = [], []
        for c, own in zip(codes, bits, strict=True):
            if not len(c) or not self.langs:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            k = int(own.argmin())
            langs.append(self.langs[k])
            scores.append(float(1 / np.exp2(TEMPER * (own[k] - own)).sum()))
        return langs, scores


def held_out(id_col: str = "doc_id"):
    """Whether a row is held out of every fit."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def level(lengths: list[int], total: int) -> int:
    """The most characters that each text may give so that all give total at most."""
    left, most = total, 0
    for k, n in enumerate(sorted(lengths)):
        most = min(n, left // (len(lengths) - k))
        if most < n:
            break
        left -= n
    return most


def sample_of(texts: list[str], total: int) -> str:
    """Texts joined to at most total characters, to which all give alike, so that no long one is the whole; what short ones leave goes to the others."""
    texts = [t for t in texts if t]
    share = level([len(t) for t in texts], total - max(0, len(texts) - 1))
    return "\n".join(t[:share] for t in texts)[:total]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model of the labelled rows that aren't held out: at most TRAIN_DOCS documents of a language, chosen by a hash of the id,
    and TRAIN_CHARS characters of those, less where that were over TOTAL_CHARS for all languages. Every language is learned; more
    than MAX_LANGS are an error. Samples are cut where the rows are, one language in a task, so the driver gets TOTAL_CHARS characters.
    Rows with a null id, text or language are not learned from; of rows that repeat an id and a language one counts.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    usable = rows.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out("id"))
    narrow = usable.select("id", "lang", F.xxhash64("id").alias("h"))
    lots = 32
    near = Window.partitionBy("lang", F.pmod(F.col("h"), F.lit(lots))).orderBy("h", "id")
    chosen = narrow.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= TRAIN_DOCS // lots).select("id", "lang").distinct()
    n_langs = usable.select("lang").distinct().limit(MAX_LANGS + 1).count()
    if n_langs > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    total = min(TRAIN_CHARS, TOTAL_CHARS // max(1, n_langs))
    few = F.broadcast(chosen) if n_langs * TRAIN_DOCS <= BROADCAST_ROWS else chosen
    got = usable.where(F.col("text").isNotNull()).join(few, ["id", "lang"]).select("lang", "id", F.substring("text", 1, total).alias("text"))
    got = got.groupBy("lang", "id").agg(F.min("text").alias("text"))

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "text": [sample_of(group["text"].tolist(), total)]})

    samples = {r["lang"]: r["text"] for r in got.groupBy("lang").applyInPandas(joined, "lang string, text string").collect()}
    return LanguageModel({str(k): v for k, v in samples.items() if any(c.isalpha() for c in v)})


def classifier(spark: SparkSession, model: LanguageModel) -> Callable:
    """text column -> struct (lang_pred, score). A null text or one without a letter is `und` with score 0; equal costs go to the language that sorts first."""
    sent = spark.sparkContext.broadcast(model)

    def verdicts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for texts in batches:
            langs, scores = own.classify(texts.tolist())
            yield pd.DataFrame({"lang_pred": langs, "score": scores})
        release_memory()

    verdicts.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(verdicts, VERDICT)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row, without a shuffle.

    A null text or one without a letter is `und` with score 0. Equal costs go to the language that sorts
    first. Repeated rows and null ids stay; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    verdict = classifier(docs.sparkSession, model)
    return docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), verdict(F.col(text_col)).alias("v")).select("doc_id", "held_out", "v.lang_pred", "v.score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that aren't held out."""
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
