"""Fill-in-middle transformation of texts held as ropes.

A text is cut into units (code points, or what a pattern matches) and held as a balanced tree whose leaves are
runs of units. Each node caches how many units and how many code points lie below it, so the tree can be split at a
rank of either kind in logarithmic time. The transformation splits at two unit ranks and joins the three
subtrees, rearranged, with sentinel leaves; the inverse splits at the sentinels' code points and joins what is left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from waymark.llm.common import fresh, named, read_table, release_memory

PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Units of a leaf. A unit is never cut, so a leaf with one unit may be longer in code points.
LEAF_UNITS = 1024


@dataclass(frozen=True, slots=True)
class Leaf:
    """A run of units; ends holds where each ends, or is None if every unit is one code point."""

    text: str
    ends: tuple[int, ...] | None = None
    depth = 0

    @property
    def units(self) -> int:
        return len(self.text) if self.ends is None else len(self.ends)

    @property
    def points(self) -> int:
        return len(self.text)


@dataclass(frozen=True, slots=True)
class Node:
    """Two ropes, one after the other, with their counts and depth."""

    left: Rope
    right: Rope
    units: int
    points: int
    depth: int


Rope = Leaf | Node
EMPTY = Leaf("")


def _node(left: Rope, right: Rope) -> Node:
    return Node(left, right, left.units + right.units, left.points + right.points, 1 + max(left.depth, right.depth))


def _balanced(left: Rope, right: Rope) -> Node:
    """A node of two ropes whose depths differ by two at most, its depths differing by one at most."""
    if left.depth > right.depth + 1:
        a, b = left.left, left.right
        return _node(a, _node(b, right)) if a.depth >= b.depth else _node(_node(a, b.left), _node(b.right, right))
    if right.depth > left.depth + 1:
        a, b = right.left, right.right
        return _node(_node(left, a), b) if b.depth >= a.depth else _node(_node(left, a.left), _node(a.right, b))
    return _node(left, right)


def join(left: Rope, right: Rope) -> Rope:
    """One rope of two, in steps of the difference of their depths."""
    if not left.points:
        return right
    if not right.points:
        return left
    if left.depth > right.depth + 1:
        return _balanced(left.left, join(left.right, right))
    if right.depth > left.depth + 1:
        return _balanced(join(left, right.left), right.right)
    return _node(left, right)


def split(rope: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
    """The first rank units (or points, for by="points") and the rest. A leaf with units that a point would cut is split inside its unit."""
    if rank <= 0:
        return EMPTY, rope
    if rank >= getattr(rope, by):
        return rope, EMPTY
    if isinstance(rope, Leaf):
        if rope.ends is None:
            return Leaf(rope.text[:rank]), Leaf(rope.text[rank:])
        at = rope.ends[rank - 1] if by == "units" else rank
        before = tuple(e for e in rope.ends if e < at)
        return Leaf(rope.text[:at], (*before, at)), Leaf(rope.text[at:], tuple(e - at for e in rope.ends if e > at))
    here = getattr(rope.left, by)
    if rank < here:
        a, b = split(rope.left, rank, by)
        return a, join(b, rope.right)
    a, b = split(rope.right, rank - here, by)
    return join(rope.left, a), b


def leaves(rope: Rope) -> Iterator[Leaf]:
    """From first to last."""
    todo = [rope]
    while todo:
        top = todo.pop()
        if isinstance(top, Node):
            todo += (top.right, top.left)
        else:
            yield top


def text_of(rope: Rope) -> str:
    return "".join(leaf.text for leaf in leaves(rope))


def _tree(runs: list[Leaf], a: int, b: int) -> Rope:
    """The tree of runs a to b, halved at each node."""
    if b - a < 2:
        return runs[a] if b > a else EMPTY
    return _node(_tree(runs, a, (a + b) // 2), _tree(runs, (a + b) // 2, b))


def rope_of(text: str, unit: re.Pattern | None = None, leaf_units: int = LEAF_UNITS) -> Rope:
    """A balanced rope of a text.

    Without a pattern a unit is a code point. Else units are the pattern's matches, from left to right, and each
    stretch that it leaves out is one unit, so that no text is lost.
    """
    if unit is None:
        runs = [Leaf(text[at : at + leaf_units]) for at in range(0, len(text), leaf_units)]
    else:
        runs, ends, began, last = [], [], 0, 0
        for m in unit.finditer(text):
            for end in (m.start(), m.end()):
                if end > last:
                    ends.append(end - began)
                    last = end
            if len(ends) >= leaf_units:
                runs.append(Leaf(text[began:last], tuple(ends)))
                ends, began = [], last
        if len(text) > last:
            ends.append(len(text) - began)
        if ends:
            runs.append(Leaf(text[began:], tuple(ends)))
    return _tree(runs, 0, len(runs))


@dataclass(frozen=True)
class Sentinels:
    """Three marks that begin a part. None may hold, or overlap with, another, so that the first place of each in an output is its own."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        for i, a in enumerate(self.each):
            for j, b in enumerate(self.each):
                if not a or (i != j and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b) + (i != j)))):
                    raise ValueError("sentinels must not be empty, equal, or overlap")

    @property
    def each(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def order(self, form: str) -> tuple[str, str, str]:
        """The sentinels in the order of a form's output."""
        return (self.prefix, self.suffix, self.middle) if form == PSM else (self.suffix, self.prefix, self.middle)


def rearrange(rope: Rope, a: int, b: int, form: str, marks: Sentinels) -> tuple[Rope, int, int]:
    """The output of a form for cuts after a and b units, a <= b; the code points of prefix and middle."""
    rest, suffix = split(rope, b)
    prefix, middle = split(rest, a)
    parts = {marks.prefix: prefix, marks.suffix: suffix, marks.middle: middle}
    out: Rope = EMPTY
    for mark in marks.order(form):
        out = join(join(out, Leaf(mark, (len(mark),))), parts[mark])
    return out, prefix.points, middle.points


def restore(output: str, form: str, marks: Sentinels) -> str:
    """The text that gave an output. An output without its form's sentinels in order is an error."""
    if form == PLAIN:
        return output
    rope, parts = rope_of(output), {}
    ends = [output.find(mark) for mark in marks.order(form)]
    if ends[0] != 0 or not 0 < ends[1] < ends[2]:
        raise ValueError(f"not an output of form {form}")
    for mark, at in zip(reversed(marks.order(form)), reversed(ends), strict=True):
        rope, tail = split(rope, at, "points")
        parts[mark] = split(tail, len(mark), "points")[1]
    return text_of(join(join(parts[marks.prefix], parts[marks.middle]), parts[marks.suffix]))


FIM = StructType([StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())])


def draws(seed: int, row_id: Column) -> list[Column]:
    """Four random numbers of 32 bits, of the SHA-256 of seed and id; a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transformed(text: Column, row_id: Column, *, seed: int = 1, rate: int = 90, spm: int = 20, unit: str | None = None, marks: Sentinels | None = None) -> Column:
    """Struct (n, form, prefix_chars, middle_chars, output) of a text.

    n counts units. Of 100 texts that can be transformed about ``rate`` are, of these about ``spm`` of 100 with the suffix first.
    Texts that are null (as empty), empty or hold a sentinel stay plain, with null lengths.
    """
    marks, pattern = marks or Sentinels(), unit and re.compile(unit, re.DOTALL)

    def each(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, *randoms in batches:
            rows = []
            for whole, h1, h2, h3, h4 in zip(texts, *randoms, strict=True):
                whole = whole or ""
                rope = rope_of(whole, pattern)
                n = rope.units
                if not whole or any(m in whole for m in marks.each) or h3 % 100 >= rate:
                    rows.append((n, PLAIN, None, None, whole))
                    continue
                form = SPM if h4 % 100 < spm else PSM
                out, prefix, middle = rearrange(rope, *sorted((h1 % (n + 1), h2 % (n + 1))), form, marks)
                rows.append((n, form, prefix, middle, text_of(out)))
            yield pd.DataFrame({f.name: pd.Series([r[k] for r in rows], dtype="Int64" if isinstance(f.dataType, LongType) else object) for k, f in enumerate(FIM)})
        release_memory()

    return F.pandas_udf(each, FIM)(text, *draws(seed, row_id))


def restored(output: Column, form: Column, *, marks: Sentinels | None = None) -> Column:
    """The texts that gave outputs of transformed(); null for a null output."""
    marks = marks or Sentinels()

    def each(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for outputs, forms in batches:
            yield pd.Series([None if o is None else restore(o, f, marks) for o, f in zip(outputs, forms, strict=True)], dtype=object)
        release_memory()

    return F.pandas_udf(each, StringType())(output, form)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """Each row of docs with n, form, prefix_chars, middle_chars and output; a column of docs that has such a name stays, and the new one ends in "_".

    Rows that repeat give the same result, as do rows that share id and text. Empty tables give empty ones.
    """
    (own,) = fresh(docs.columns, "fim")
    names = fresh(docs.columns, *FIM.names)
    done = docs.select("*", transformed(named(text_col), named(id_col), **options).alias(own))
    return done.select(*map(named, docs.columns), *[F.col(own)[f].alias(out) for f, out in zip(FIM.names, names, strict=True)])


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, cut, rearranged and rebuilt."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    done = transform(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))




OP11_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id::VARCHAR) AS d FROM documents),
numbers AS (
  SELECT doc_id, t, n, ('0x' || substr(d, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(d, 9, 8))::BIGINT % (n + 1) AS b,
    ('0x' || substr(d, 17, 8))::BIGINT % 100 AS c3, ('0x' || substr(d, 25, 8))::BIGINT % 100 AS c4 FROM drawn),
cut AS (
  SELECT doc_id, t, n, least(a, b) AS lo, greatest(a, b) AS hi,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c3 >= 90 THEN 'plain' WHEN c4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (SELECT *, substring(t, 1, lo) AS p, substring(t, lo + 1, hi - lo) AS m, substring(t, hi + 1) AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
