"""Toxic passages as maximum-scoring segments of token log-odds.

Token weights are log-odds of toxic against clean documents under an informative Dirichlet prior,
shrunk towards zero by their standard error. All maximal segments of positive total are found in one pass
over a document. The segment scores of clean documents follow an extreme-value law whose
scale is the root of sum p(w) exp(scale * s(w)) = 1 and whose location is fitted on clean documents; it turns
each segment's score into a p-value. A document's evidence adds up -ln p of its significant
segments, and a logistic curve, fitted across two halves of the labelled documents, turns that into a score.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from waymark.llm.common import bound_batches, drop, materialize, read_table, release_memory
from waymark.llm.language_id import held_out, level

#: Labelled documents of each label that a fit takes at most. Each half is calibrated by the weights of the other.
FIT_DOCS = 1536
#: Characters of all of them that a fit takes at most; where there are more, all give alike.
FIT_CHARS = 1 << 25
#: A token must occur in so many different toxic documents of the sample.
MIN_TOXIC_DOCS = 3
#: Weight of the Dirichlet prior against the sample; standard errors that a weight loses; cost of each token.
PRIOR, SHRINK, DRIFT = 0.05, 1.64, 0.3
#: Besides whole tokens, beginnings of so many letters have weights, for inflected forms; a token takes its best weight.
STEMS = (4, 5)
#: Tokens whose weight a Python worker remembers at most.
CACHE_TOKENS = 150_000
#: p-value below which a segment is significant.
SIGNIFICANT = 0.05
WORDS = re.compile(r"[^\W\d_]+").findall
SEGMENT = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("score", DoubleType()), StructField("p_value", DoubleType())])


def tokens(text: str | None) -> list[str]:
    return WORDS(text.lower()) if text else []


def segments(weights: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a weight sequence, in linear time (Ruzzo and Tompa).

    A segment joins an earlier one if that began lower and ended lower; only positive weights open one.
    """
    sums = np.concatenate(([0.0], np.cumsum(weights)))
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    for k in np.nonzero(weights > 0)[0].tolist():
        start, end, low, high = k, k + 1, float(sums[k]), float(sums[k + 1])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j -= 1
            if j < 0 or found[j][3] >= high:
                found.append((start, end, low, high))
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high in found]


def kinds(word: str) -> list[str]:
    """The token and its beginnings, marked as such."""
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


class TokenScores(dict):
    """token -> score, worked out once."""

    def __init__(self, weights: dict[str, float]) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > CACHE_TOKENS:
            self.clear()
        get = self.weights.get
        self[word] = score = max(get(k, -DRIFT) for k in kinds(word))
        return score

    def __reduce__(self):
        return TokenScores, (self.weights,)

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), float, len(words))


class ToxicModel:
    """Weights, extreme-value law and calibration."""

    def __init__(self, weights: dict[str, float], scale: float = 1.0, location: float = 0.0, slope: float = 1.0, middle: float = 3.0) -> None:
        self.scores = TokenScores(weights)
        self.weights, self.scale, self.location, self.slope, self.middle = weights, scale, location, slope, middle

    def found(self, words: list[str]) -> list[tuple[int, int, float, float]]:
        """Maximal segments with their p-values."""
        if not words:
            return []
        scores = self.scores.of(words)
        shift = math.log(len(words)) + self.location
        return [(a, b, s, -math.expm1(-math.exp(min(50.0, shift - self.scale * s)))) for a, b, s in segments(scores)]

    def evidence(self, words: list[str]) -> float:
        return sum(-math.log(max(p, 1e-300)) for *_, p in self.found(words) if p < SIGNIFICANT)

    def score(self, text: str | None) -> float:
        x = self.slope * (self.evidence(tokens(text)) - self.middle)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))

    def passages(self, text: str | None) -> list[dict]:
        """Significant segments as character spans of the text, by start."""
        if not text:
            return []
        spans = [m.span() for m in re.finditer(r"[^\W\d_]+", text)]
        words = [text[a:b].lower() for a, b in spans]
        return [{"start": spans[a][0], "end": spans[b - 1][1], "score": s, "p_value": p} for a, b, s, p in self.found(words) if p < SIGNIFICANT]


def weigh(toxic: list[list[str]], clean: list[list[str]]) -> dict[str, float]:
    """Token -> shrunk log-odds less the drift, of tokens of positive weight. A token counts once a document."""
    a, b = (Counter(k for d in part for k in {k for w in set(d) for k in kinds(w)}) for part in (toxic, clean))
    na, nb = sum(a.values()), sum(b.values())
    total = PRIOR * (na + nb)
    out = {}
    for w, docs in a.items():
        if docs < MIN_TOXIC_DOCS:
            continue
        prior = PRIOR * (a[w] + b[w])
        ya, yb = a[w] + prior, b[w] + prior
        odds = math.log(ya / (na + total - ya)) - math.log(yb / (nb + total - yb))
        if (s := odds - SHRINK * math.sqrt(1 / ya + 1 / yb) - DRIFT) > 0:
            out[w] = s
    return out


def law(weights: dict[str, float], clean: list[list[str]]) -> tuple[float, float]:
    """Scale and location of the extreme-value law of clean documents. The scale is the root of the sum's equation, held between 0.05 and 2."""
    scores = TokenScores(weights)
    counts = Counter(round(scores[w], 6) for d in clean for w in d)
    total = sum(counts.values()) or 1
    hits = [(s, n / total) for s, n in counts.items() if s > 0]
    rest = 1 - sum(p for _, p in hits)

    def excess(x: float) -> float:
        return sum(p * math.exp(x * s) for s, p in hits) + rest * math.exp(-x * DRIFT) - 1

    scale = 1.0  # where clean text has no positive token any scale holds
    if hits:
        low, high = 0.0, 1.0
        while excess(high) < 0 and high < 64:
            high *= 2
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if excess(mid) < 0 else (low, mid)
        scale = max(0.05, min(high, 2.0))
    tops = []
    for d in clean:
        if d:
            s = segments(scores.of(d))
            tops.append(scale * max((x for *_, x in s), default=0.0) - math.log(len(d)))
    tops = np.array(tops or [0.0])
    return scale, float(np.log(np.mean(np.exp(np.clip(tops, -50, 50)))) if len(tops) < 8 else np.quantile(tops, 0.95) + math.log(-math.log(0.95)))


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and middle of a logistic curve: the middle splits best, the slope follows the classes' gap."""
    if not len(x) or y.min() == y.max():
        return 1.0, 3.0
    cuts = np.unique(x)
    cuts = np.concatenate(([cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]))
    pos, neg = np.sort(x[y == 1]), np.sort(x[y == 0])
    wrong = np.searchsorted(pos, cuts) + len(neg) - np.searchsorted(neg, cuts)
    best = cuts[wrong == wrong.min()]
    middle = float(best[len(best) // 2])
    near = np.median(np.abs(x - middle)) or 1.0
    return float(2 / near), middle


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicModel:
    """A model of labelled rows that aren't held out: the FIT_DOCS of each label with the least id hash, one of equal texts, and FIT_CHARS of their characters.

    Null ids, texts and labels are not learned from. A text of both labels counts as toxic. Without both labels the model finds nothing.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)").where(F.col("id").isNotNull() & ~held_out("id")).withColumn("h", F.xxhash64("id"))
    ids = [r for y in (0, 1) for r in marks.where(F.col("y") == y).groupBy("id", "y", "h").count().orderBy("h", "id").limit(FIT_DOCS).select("id", "y").collect()]
    if not ids:
        return ToxicModel({})
    few = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in ids], marks.select("id", "y").schema))
    counted = F.pandas_udf(lambda s: s.map(tokens), ArrayType(StringType()))
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(few, "id").where(F.col("text").isNotNull())
    sample = sample.groupBy(F.xxhash64("text").alias("h")).agg(F.min("id").alias("id"), F.max("y").alias("y"), F.min("text").alias("text"))
    sample = materialize(sample)
    share = level([r[0] for r in sample.select(F.length("text")).collect()], FIT_CHARS)  # a number for each of the sampled rows
    halves: dict[tuple[int, int], list[list[str]]] = {(y, part): [] for y in (0, 1) for part in (0, 1)}
    for r in sample.select("h", "y", counted(F.substring("text", 1, share)).alias("words")).orderBy("h").toLocalIterator():
        halves[r["y"], r["h"] & 1].append([*map(sys.intern, r["words"])])
    drop(sample)
    x, y = [], []
    for part in (0, 1):
        other = trained(halves[1, 1 - part], halves[0, 1 - part])
        for label in (0, 1):
            x += [other.evidence(d) for d in halves[label, part]]
            y += [label] * len(halves[label, part])
    model = trained(halves[1, 0] + halves[1, 1], halves[0, 0] + halves[0, 1])
    model.slope, model.middle = calibrate(np.array(x), np.array(y))
    return model


def trained(toxic: list[list[str]], clean: list[list[str]]) -> ToxicModel:
    weights = weigh(toxic, clean)
    return ToxicModel(weights, *law(weights, clean))


def scorer(spark: SparkSession, model: ToxicModel) -> Callable:
    """text column -> score, 0 to 1; a null or empty text has the score of no evidence. Equal texts have equal scores."""
    sent = spark.sparkContext.broadcast(model)

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([sent.value.score(t) for t in texts], dtype=float)
        sent.value.scores.clear()  # the worker outlives the task
        release_memory()

    scores.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(scores, DoubleType())


def toxic_passages(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, passages array<struct(start, end, score, p_value)>): the significant passages of every row as character spans.

    A null or empty text has none. Repeated rows and null ids stay; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    spans = F.pandas_udf(lambda s: s.map(lambda t: [tuple(x.values()) for x in sent.value.passages(t)]), ArrayType(SEGMENT))
    return docs.select(F.col(id_col).alias("doc_id"), spans(F.col(text_col)).alias("passages"))


def toxicity(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, without a shuffle.

    A null or empty text has no segment and gets the score of no evidence. Repeated rows and null ids stay;
    other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    score = scorer(docs.sparkSession, model)
    out = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), score(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast(IntegerType()))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labelled rows that aren't held out."""
    docs = read_table(spark, sf_dir, "documents")
    return toxicity(docs, fit(docs, read_table(spark, sf_dir, "labels")))
