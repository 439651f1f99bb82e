"""License scan by canonical digests, with DataFrame functions only.

A text and the known licences are normalised alike: lower case, lines of copyright notices and a line that is but the title dropped, all but letters and
digits as single spaces, and each word that has an equivalent spelling replaced by it. A whole text is looked up by the
digest of the result in a hash join. So are its single lines, for short notices such as "Released under the MIT License."
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import read_table
from waymark.llm.license_texts import NOTICES, TEXTS

# Spellings that count as equal, word by word.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "holder": "owner", "holders": "owners", "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center", "emphasised": "emphasized", "favour": "favor",
    "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "noncommercial": "non commercial",
    "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling", "sublicense": "sub license", "sublicence": "sub license",
    "sublicensed": "sub licensed", "sublicenced": "sub licensed", "utilisation": "utilization", "whilst": "while", "wilful": "willful", "percent": "per cent", "v2": "version 2", "v3": "version 3", "http": "https",
}

#: A line of a copyright notice: with a year, a mark, a name after "by" or a place to fill in; or the reservation of all rights alone.
_NOTICE_LINE = r"^[^a-z0-9\n]*(?:(?:copyright|\(c\)|©)[^\n]*(?:19|20)[0-9][0-9][^\n]*|copyright[ \t]*(?:\(c\)|©|by |[\[<{])[^\n]*|©[^\n]*|all rights reserved[^a-z0-9\n]*)$"


#: A line of a copyright notice without a year or mark: the word, a name, and at most seven more words.
_NAME_LINE = r"^[ \t/*#;.-]*copyright[ \t]+([^ \t\n]+)(?:[ \t]+[^ \t\n]+){0,7}[ \t\r]*$"
# Words behind "copyright" that are no name, as licences use them, so that a wrapped line stays.
NO_NAME = (
    "act", "and", "are", "as", "at", "by", "claim", "claims", "disclaimer", "doctrines", "exceptions", "for", "holder", "holders", "if", "in", "including", "infringement", "interest", "interests", "is", "law", "laws", "license", "licence", "may", "notice", "notices",
    "of", "on", "or", "owner", "owners", "ownership", "permission", "permissions", "protection", "protections", "resulting", "right", "rights", "statement", "statements", "status", "term", "terms", "that", "the", "this", "to", "treaty", "was", "which", "with", "work", "works",
)
#: A first line that only names a licence: six words at most up to "license", and one behind it, as in "The MIT License (MIT)".
_TITLE = r"\A[ \t\r\n(#*=>\"'-]*(?:[a-z0-9.,-]+[ \t]+){0,6}licen[cs]e(?:[^a-z0-9\n]+[a-z0-9.-]{1,20})?[^a-z0-9\n]*\n"


def _bare(text: Column) -> Column:
    """Lower case, without notice lines that have a year or a mark; nulls count as empty."""
    low = F.lower(F.coalesce(text, F.lit("")))
    noted = low.contains("copyright") | low.contains("©") | low.contains("(c)") | low.contains("all rights reserved")
    return F.when(noted, F.regexp_replace(low, "(?md)" + _NOTICE_LINE, " ")).otherwise(low)


def _spelled(bare: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " ")), " ")
    table = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.when(w.isin(list(SPELLINGS)), F.element_at(table, w)).otherwise(w)), " ")


def normal_line(line: Column) -> Column:
    """The normalised text of one line."""
    return _spelled(_bare(line))


def normal(text: Column) -> Column:
    """The normalised whole text; nulls count as empty. A title goes only where something follows."""
    bare = _bare(text)
    no_name = F.split(bare, "\n")
    no_name = F.array_join(F.filter(no_name, lambda line: ~(line.contains("copyright") & line.rlike(_NAME_LINE) & ~F.regexp_replace(F.regexp_extract(line, _NAME_LINE, 1), "[^a-z]+", "").isin(list(NO_NAME)))), "\n")
    named = F.when(bare.contains("copyright"), no_name).otherwise(bare)
    rest = F.regexp_replace(named, _TITLE, " ")
    return _spelled(F.when(F.substring(named, 1, 400).rlike("licen[cs]e") & rest.rlike("[a-z0-9]"), rest).otherwise(named))


#: Known texts at most; public lists have some hundreds.
MAX_LICENSES = 10_000
#: What nearly every notice holds, in all its spellings.
NOTICE_PART = "licen"
#: Words that a spelling may have brought into normalised text; a line need not hold them.
_BROUGHT = frozenset(word for becomes in SPELLINGS.values() for word in becomes.split())


def notice_parts(notices: list[str]) -> list[str]:
    """Parts of words such that a line whose normalised text is one of these notices holds one of them, in lower case."""
    own = lambda n: max((w for w in n.split() if w not in _BROUGHT), key=len, default="")
    parts = {NOTICE_PART if NOTICE_PART in n else own(n) for n in notices}
    return [""] if "" in parts else sorted(parts)


def digest(text: Column) -> Column:
    return F.sha2(normal(text), 256)


def digest_line(line: Column) -> Column:
    return F.sha2(normal_line(line), 256)


def known(spark: SparkSession) -> DataFrame:
    """(license_id, kind, text): the built-in texts (kind text) and notices (kind notice)."""
    return spark.createDataFrame([(k, "text", t) for k, t in TEXTS] + [(k, "notice", t) for k, t in NOTICES], "license_id string, kind string, text string")


def scan(docs: DataFrame, licenses: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, license_id, notices) of every row of docs.

    license_id: the known licence whose normalised text is the whole text's, else null. notices: the sorted distinct ids of licences
    of which a whole line is a known notice, with commas, empty if none. A null or empty text matches nothing. If several
    licences share a digest the least id counts. Repeated rows and null ids stay; extra columns are ignored.

    licenses (license_id, kind, text) is a list of known texts, at most MAX_LICENSES rows, so its digests are broadcast. Lines are looked up in
    each row, without a shuffle.
    """
    form = F.when(F.col("kind") == "notice", normal_line(F.col("text"))).otherwise(normal(F.col("text")))
    table = licenses.withColumn("form", form).where("form != ''").withColumn("digest", F.sha2("form", 256))
    table = table.groupBy("kind", "digest").agg(F.min("license_id").alias("license_id"))
    held = table.limit(MAX_LICENSES + 1).collect()
    if len(held) > MAX_LICENSES:
        raise ValueError(f"more than {MAX_LICENSES} known licences")
    spark = docs.sparkSession
    whole = spark.createDataFrame([(r["digest"], r["license_id"]) for r in held if r["kind"] == "text"], "digest string, license_id string")
    lines = {r["digest"]: r["license_id"] for r in held if r["kind"] == "notice"}
    names = F.create_map(*[F.lit(x) for pair in sorted(lines.items()) for x in pair]) if lines else F.create_map().cast("map<string,string>")
    stated = licenses.where("kind = 'notice'").select(normal_line(F.col("text")).alias("n")).where("n != ''").distinct()
    held_parts = notice_parts([r["n"] for r in stated.collect()])
    may_match = lambda line: reduce(Column.__or__, [F.lower(line).contains(p) for p in held_parts], F.lit(False))
    parts = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), may_match)
    notices = F.array_sort(F.array_distinct(F.array_compact(F.transform(parts, lambda line: F.element_at(names, digest_line(line))))))
    rows = docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest"), notices.alias("notices"))
    return rows.join(F.broadcast(whole), "digest", "left").select("doc_id", "digest", "license_id", F.concat_ws(",", "notices").alias("notices"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences and notices of every document."""
    return scan(read_table(spark, sf_dir, "documents"), known(spark))


def plain_digest(text: str, whole: bool = True) -> str:
    """The digest of a whole text, or of a line, without Spark, for the SQL's known texts."""
    bare = re.sub("(?m)" + _NOTICE_LINE, " ", text.lower())
    if whole:
        found = lambda line: re.match(_NAME_LINE, line)
        bare = "\n".join(line for line in bare.split("\n") if not ((m := found(line)) and re.sub("[^a-z]+", "", m[1]) not in NO_NAME))
        rest = re.sub(_TITLE, " ", bare)
        bare = rest if re.search("[a-z0-9]", rest) else bare
    return hashlib.sha256(" ".join(SPELLINGS.get(w, w) for w in re.findall("[a-z0-9]+", bare)).encode()).hexdigest()


def _values(rows: list[tuple[str, str]]) -> str:
    return ", ".join("('{}', '{}')".format(a.replace("'", "''"), b.replace("'", "''")) for a, b in rows)


#: Whole texts and all lines, word by word.
OP4_SQL = f"""
WITH spelling(w, becomes) AS (VALUES {_values(list(SPELLINGS.items()))}),
whole AS (SELECT digest, min(id) AS license_id FROM (VALUES {_values([(plain_digest(t), k) for k, t in TEXTS])}) AS t(digest, id) GROUP BY digest),
notice AS (SELECT digest, min(id) AS id FROM (VALUES {_values([(plain_digest(t, whole=False), k) for k, t in NOTICES])}) AS t(digest, id) GROUP BY digest),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
piece AS (SELECT r, 0 AS k, text AS x FROM d UNION ALL SELECT r, generate_subscripts(string_split(text, chr(10)), 1), unnest(string_split(text, chr(10))) FROM d),
bare AS (SELECT r, k, regexp_replace(lower(x), '(?m){_NOTICE_LINE}', ' ', 'g') AS x FROM piece),
named AS (SELECT r, k, CASE WHEN k = 0 THEN array_to_string(list_filter(string_split(x, chr(10)), lambda l: NOT regexp_matches(l, '{_NAME_LINE}') OR list_contains({list(NO_NAME)}, regexp_replace(regexp_extract(l, '{_NAME_LINE}', 1), '[^a-z]+', '', 'g'))), chr(10)) ELSE x END AS x FROM bare),
untitled AS (SELECT r, k, x, CASE WHEN k = 0 THEN regexp_replace(x, '{_TITLE.replace("'", "''")}', ' ') ELSE x END AS rest FROM named),
word AS (SELECT r, k, unnest(own) AS w, generate_subscripts(own, 1) AS i FROM (SELECT r, k, string_split(trim(regexp_replace(CASE WHEN regexp_matches(rest, '[a-z0-9]') THEN rest ELSE x END, '[^a-z0-9]+', ' ', 'g'), ' '), ' ') AS own FROM untitled)),
normal AS (SELECT r, k, sha256(string_agg(coalesce(becomes, w), ' ' ORDER BY i)) AS digest FROM word LEFT JOIN spelling USING (w) GROUP BY r, k),
hit AS (SELECT r, string_agg(DISTINCT id, ',' ORDER BY id) AS notices FROM normal JOIN notice USING (digest) WHERE k > 0 GROUP BY r)
SELECT d.doc_id, n.digest, w.license_id, coalesce(h.notices, '') AS notices
FROM d JOIN normal n ON n.r = d.r AND n.k = 0 LEFT JOIN whole w ON w.digest = n.digest LEFT JOIN hit h ON h.r = d.r
"""
