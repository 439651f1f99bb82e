"""Tokens, text scores, rounding and canonical hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that ask for an owner rather than a text. ASCII word bounds: letters with accents bound a word.
BEFORE, AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_INTENT = rf"(?i){BEFORE}(package|module|pkg|edit|change|where|owns?|ownership|handoff|start){AFTER}"
_QUESTION = r"(?i)\A(where|how).*(edit|change|package|module)"


def tokens(c: Column, keep: str = "@/_-") -> Column:
    """Lower-case runs of letters, digits and keep, two characters at least; repeats stay."""
    return F.filter(F.split(F.lower(c), f"[^a-z0-9{keep}]+"), lambda t: F.length(t) >= 2)


def wants_owner(term: Column) -> Column:
    return term.rlike(_INTENT) | term.rlike(_QUESTION)


def file_base(path: Column) -> Column:
    """The lower-case name of a path's file, without the ending of Markdown."""
    return F.lower(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.mdx?\z", ""))


def identity_boost(ident: Column, path: Column, words: Column, term: Column) -> Column:
    """What an entry gains because its id or file name is, or nearly is, the term or one of its tokens."""
    own, whole = F.lower(ident), F.lower(F.trim(term))
    base = file_base(path)
    is_own = lambda t: (own == t) | (base == t)
    first = F.get(words, F.lit(0))

    def one(total: Column, t: Column) -> Column:
        part = F.when(own == t, 120).when(own.startswith(F.concat(t, F.lit("-"))) | own.endswith(F.concat(F.lit("-"), t)), 40).when(own.contains(t) & (F.length(own) <= F.length(t) + 4), 30).otherwise(0)
        return total + part + F.when(base == t, 100).otherwise(0)

    boost = F.when(is_own(whole), 200).otherwise(0) + F.when((F.size(words) == 1) & is_own(first), 200).otherwise(0)
    return boost + F.aggregate(words, F.lit(0), one) + F.when(F.array_contains(words, own), F.greatest(F.lit(0), 40 - F.length(own))).otherwise(0)


def half_up(c: Column) -> Column:
    """Nearest integer, halves upwards."""
    return F.floor(c + 0.5).cast("long")


def percent(part: Column, total: Column) -> Column:
    return F.when(total > 0, half_up(100 * part / total)).otherwise(F.lit(0).cast("long"))


def badge_color(pct: Column) -> Column:
    return F.when(pct >= 80, "2ea44f").when(pct >= 50, "dbab09").otherwise("cb2431")


def canonical_json(c: Column) -> Column:
    """JSON text with sorted keys and no white space."""
    return F.to_json(F.parse_json(c))


def content_hash(c: Column) -> Column:
    return F.sha2(canonical_json(c), 256)


def one_line(c: Column, most: int = 100) -> Column:
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, most)
