"""Quality rules: statistics of every document, fixed rules, and an isolation forest over the statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from waymark.llm.common import bound_batches, read_table, release_memory

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: The forest: trees, rows drawn for each, depth at most.
TREES, DRAWN, DEPTH = 100, 256, 8
#: Fit: the share of good rows that the threshold must keep, and its steps between 0 and 1.
KEEP_GOOD = 0.98
GRID = 20_000
#: Bad rows in the forest's sample, to a good one.
CONTAMINATION = 0.04
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHAPES = ("symbol_rate", "upper_rate", "letter_rate", "bang_rate", "mean_word", "distinct_rate", "repeat_rate", "dup_line_rate", "short_word_rate", "bare_line_rate")
BLANK = " \t\n\r\x0b\x0c"
VERDICT = StructType([StructField(c, LongType()) for c in COUNTS] + [StructField("base_failed", BooleanType()), StructField("kept", BooleanType()), StructField("anomaly", DoubleType())])
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))


def repeated_words(ids: np.ndarray) -> int:
    """Words inside windows of WINDOW words that occur twice or more, the first included. ids: a number for each distinct word."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + n]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    # equal hashes are compared word by word
    windows = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
    suspects = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
    _, back, counts = np.unique(windows[suspects], axis=0, return_inverse=True, return_counts=True)
    starts = suspects[counts[back.reshape(-1)] > 1]
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The counts of the contract and the shape rates that the forest sees."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    chars = len(text) - sum(map(text.count, BLANK))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    dup = len(lines) - len(set(lines))
    repeats = repeated_words(ids)
    less = lambda some: len(raw) - len(raw.translate(None, some))
    letters, size = less(_LETTERS), max(1, len(raw))
    shapes = [
        symbols / max(1, chars), less(_UPPER) / max(1, letters), letters / size, text.count("!") / max(1, n),
        min(30.0, chars / max(1, n)), len(number) / max(1, n) ** 0.9, repeats / max(1, n), dup / max(1, len(lines)),
        sum(len(w) < 3 for w in words) / max(1, n), sum(x[-1] not in ".!?:;\"'" for x in (y.rstrip(BLANK) for y in lines)) / max(1, len(lines)),
    ]
    return [n, chars, symbols, dup, repeats], shapes


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > REPEAT_PERCENT * n_words


class IsolationForest:
    """Random splits of drawn rows; a row that few splits set apart is anomalous."""

    def __init__(self, rows: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        nodes = 1 << (DEPTH + 1)
        self.column = np.zeros((TREES, nodes), np.int64)
        self.split = np.full((TREES, nodes), np.inf)
        self.length = np.zeros((TREES, nodes))
        self.drawn = min(DRAWN, len(rows))
        for t in range(TREES):
            stack = [(1, rows[rng.choice(len(rows), self.drawn, replace=False)] if len(rows) else rows, 0)]
            while stack:
                node, own, depth = stack.pop()
                low, high = (own.min(axis=0), own.max(axis=0)) if len(own) else (np.zeros(rows.shape[1]),) * 2
                open_columns = np.nonzero(high > low)[0]
                if depth == DEPTH or len(own) < 2 or not len(open_columns):
                    self.length[t, node] = depth + self.mean_depth(len(own))
                    self._leaf(t, node, depth)
                    continue
                c = int(rng.choice(open_columns))
                at = rng.uniform(low[c], high[c])
                self.column[t, node], self.split[t, node] = c, at
                left = own[:, c] < at
                stack += [(2 * node, own[left], depth + 1), (2 * node + 1, own[~left], depth + 1)]

    def _leaf(self, t: int, node: int, depth: int) -> None:
        """Below a leaf every row goes left; its last node keeps the length."""
        value = self.length[t, node]
        for _ in range(depth, DEPTH):
            node *= 2
        self.length[t, node] = value

    @staticmethod
    def mean_depth(n: int) -> float:
        """Mean depth of an unsuccessful search among n rows."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def anomaly(self, rows: np.ndarray) -> np.ndarray:
        """2^(-mean path / expected path): near 1 is anomalous, below 0.5 usual."""
        total, each = np.zeros(len(rows)), np.arange(len(rows))
        for t in range(TREES):
            node = np.ones(len(rows), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + (rows[each, self.column[t, node]] >= self.split[t, node])
            total += self.length[t, node]
        return np.exp2(-total / TREES / max(self.mean_depth(self.drawn), 1e-9))


class QualityModel:
    def __init__(self, forest: IsolationForest | None, threshold: float) -> None:
        self.forest, self.threshold = forest, threshold

    def verdicts(self, texts: list[str | None]) -> pd.DataFrame:
        stats = [statistics(t) for t in texts]
        out = pd.DataFrame([s[0] for s in stats], columns=list(COUNTS), dtype="int64")
        out["base_failed"] = [base_failed(s[0][0], s[0][4]) for s in stats]
        anomaly = self.forest.anomaly(np.array([s[1] for s in stats])) if self.forest and stats else np.zeros(len(stats))
        out["kept"] = ~out["base_failed"].astype(bool) & (anomaly <= self.threshold)
        out["anomaly"] = anomaly
        return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """A forest over rows that pass the base rules, nearly all of them good, and a threshold set on all labelled rows.

    All labelled rows count, equal texts once. Half of the good rows and of the bad ones are the forest's: each tree draws DRAWN rows, as an isolation forest does, from a pool of as many rows as all trees draw, those of least hash in each of TREES shares
    of all, with a few bad ones, so that statistics that no good row varies can split too. Every row of the other halves sets the threshold, the one that
    tells them apart best among those that keep a share KEEP_GOOD of the good, at a resolution of GRID. Without good rows nothing is anomalous.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and id is not null").groupBy("id").agg(F.max("y").alias("y"))
    shape = F.pandas_udf(_shapes, "array<double>")
    bound_batches(docs.sparkSession)
    # texts stay where they are: rates meet the labels, of all documents
    got = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), shape(text_col).alias("x")).where("x is not null").join(marks, "id").select("y", "h", "x")
    got = got.groupBy("h").agg(F.max("y").alias("y"), F.first("x").alias("x")).persist(StorageLevel.DISK_ONLY)
    try:
        tally = {(r["y"], r["part"]): r["n"] for r in got.groupBy("y", (F.col("h").bitwiseAND(1) == 1).alias("part")).agg(F.count("*").alias("n")).collect()}
        n = lambda y, part: tally.get((y, part), 0)
        if not n(1, True) + n(1, False):
            return QualityModel(None, 1.0)
        halved = n(1, True) >= 8 and n(1, False) >= 8
        grown = got.where("h & 1 = 1") if halved else got.where("y = 1")
        least = Window.partitionBy("y", "tree").orderBy(F.xxhash64("h"), "h")
        drawn = grown.withColumn("tree", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(TREES))).withColumn("at", F.row_number().over(least))
        few_bad = max(1, int(min(n(1, True), TREES * DRAWN) * CONTAMINATION))  # to all trees
        rows = drawn.where(F.col("at") <= F.when(F.col("y") == 1, DRAWN).otherwise(-(-few_bad // TREES))).orderBy("y", F.xxhash64("h"), "h").select("y", "x").toPandas()
        x, y = np.array(rows["x"].tolist()).reshape(len(rows), -1), rows["y"].to_numpy()
        forest = IsolationForest(np.concatenate((x[y == 1], x[y == 0][:few_bad])))
        if not halved:
            return QualityModel(forest, 1.0)
        sent = docs.sparkSession.sparkContext.broadcast(forest)
        cell = F.pandas_udf(lambda s: pd.Series(np.round(sent.value.anomaly(np.array(s.tolist()).reshape(len(s), -1)) * GRID).astype(np.int64)), "long")
        cells = got.where("h & 1 = 0").select("y", cell("x").alias("cell")).groupBy("y", "cell").agg(F.count("*").alias("n")).toPandas()  # GRID rows a label at most
    finally:
        got.unpersist()
    return QualityModel(forest, _threshold(*(np.bincount(c["cell"], c["n"], GRID + 1) for c in (cells[cells["y"] == 1], cells[cells["y"] == 0]))))


def _shapes(texts: pd.Series) -> pd.Series:
    """Shape rates of texts that pass the base rules, null for others."""
    got = (statistics(t) for t in texts)
    return pd.Series([None if base_failed(c[0], c[4]) else [float(v) for v in rates] for c, rates in got], dtype=object)


def _threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut between cells of the grid, counted for both labels, that loses least of all that keep KEEP_GOOD of the good; amid equal ones up to the next cell that holds a row."""
    kept, passed = np.cumsum(good) / max(1, good.sum()), np.cumsum(bad) / max(1, bad.sum())
    lost = np.where(kept >= KEEP_GOOD, 1 - kept + passed, np.inf)
    best = int(np.nonzero(lost == lost.min())[0][0])
    later = np.flatnonzero((good + bad)[best + 1 :])
    return (2 * best + 1 + (later[0] if len(later) else 0)) / 2 / GRID


def judge(spark: SparkSession, model: QualityModel) -> Callable:
    """text column -> struct of counts, base_failed, kept, anomaly. A null text has no words and fails the base rules; equal texts have equal verdicts."""
    sent = spark.sparkContext.broadcast(model)

    def verdicts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield sent.value.verdicts(texts.tolist())
        release_memory()

    verdicts.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(verdicts, VERDICT)


def quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts, base_failed, kept, anomaly) of every row, without a shuffle.

    A null text has no words and fails the base rules. Repeated rows and null ids stay; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    verdict = judge(docs.sparkSession, model)
    return docs.select(F.col(id_col).alias("doc_id"), verdict(F.col(text_col)).alias("v")).select("doc_id", "v.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and verdict of every document."""
    docs = read_table(spark, sf_dir, "documents")
    return quality(docs, fit(docs, read_table(spark, sf_dir, "labels")))
