"""SentencePiece codec and packing against the libraries, fingerprints, licences and HTML against plain versions."""

import hashlib
import random
import re
import time
import unicodedata
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from waymark.llm import fingerprints, html_text, licenses, packing, sentencepiece_codec

SCHEMA = "doc_id long, text string, fingerprint string, start string, length string, ids string"
RNG = random.Random(9)
ODD = ["".join(RNG.choice(list("abthe ing▁é日本 \n\t 0123,.<s>\u0000😀ñ ßﬁİ'll")) for _ in range(RNG.randrange(0, 50))) for _ in range(300)]
TEXTS = [None, "", " ", "Hello, world", "The the  \n\n the", "<s> </s> <0x0A>", "<|endoftext|>a<|endoftext|>", "x" * 5000, *ODD]


def docs(spark, texts, first=0):
    return spark.createDataFrame([(k + first, t, "x", "y", "z", "w") for k, t in enumerate(texts)], SCHEMA)


def test_sentencepiece_matches_the_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece_codec.MODEL))
    own = sentencepiece_codec.PrefixCodec()
    got = {r["doc_id"]: r for r in sentencepiece_codec.codec_digests(docs(spark, TEXTS)).collect()}
    for k, t in enumerate(TEXTS):
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        assert own.encode(t or "") == ids
        assert own.decode(ids) == lib.decode(ids)
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    for _ in range(300):
        ids = [RNG.randrange(32_000) if RNG.random() < 0.5 else RNG.randrange(260) for _ in range(8)]
        assert own.decode(ids) == lib.decode(ids)
    assert sentencepiece_codec.encode_documents(docs(spark, [])).count() == 0


def test_packing(spark):
    lib = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    texts = [*TEXTS, "many words " * 3000, *["some words here " * RNG.randrange(1, 300) for _ in range(60)]]
    frame = docs(spark, texts).unionByName(docs(spark, texts[3:4], 3)).unionByName(spark.createDataFrame([(None, "null id", *"xyzw")], SCHEMA))
    got = packing.pack(frame, group_pieces=50).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
    for k, t in enumerate(texts):
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        own = sorted(pieces[k], key=lambda r: r["start"])
        times = 2 if k == 3 else 1
        assert sum(r["length"] for r in own) == times * len(ids)
        for r in own:
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    assert len(pieces[None]) == 1
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    total = sum(r["length"] for r in got)
    assert len(sequences) * packing.SEQUENCE < total * 1.25
    own = sum(len(parts) == 1 and parts[0][1] == packing.SEQUENCE for parts in sequences.values())
    assert own >= 2
    one, other = (sorted(map(tuple, packing.pack(docs(spark, texts).repartition(n), group_pieces=50).collect())) for n in (2, 7))
    assert one == other  # another split, the same packs
    assert packing.pack(docs(spark, [])).count() == 0


@pytest.mark.parametrize("text", [" " * 1_200_000, "\n " * 500_000 + "x", "\t" * 1_000_000 + "<|endoftext|>", "x" * 300_000, "ab " * 100_000])
def test_ids_of_extreme_texts(text):
    lib = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    assert packing.ByteBpe().encode(text) == np.array(lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("seed", range(5))
def test_first_fit_matches_a_plain_scan(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.randrange(1, 1025) for _ in range(200)), reverse=True)
    free, bins, offsets = [], [], []
    for n in lengths:
        k = next((k for k, f in enumerate(free) if f >= n), len(free))
        free += [1024] * (k == len(free))
        bins.append(k)
        offsets.append(1024 - free[k])
        free[k] -= n
    assert packing.first_fit(lengths) == (bins, offsets)


def plain_canonical(text):
    fold = lambda t: unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return re.sub(r"\s+", " ", fold(text)).strip()


def test_fingerprint_classes(spark, tmp_path):
    """op2 over a table: classes by plain canonical texts, and its exact columns by SQL."""
    texts = ["One  two", "one TWO", None, "", "  ", "unique", "ﬁne", "FINE", "one two "] * 3 + [t.replace("\0", "") for t in ODD[:40]]
    docs(spark, texts).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in fingerprints.op2_fingerprints(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    first, count = {}, {}
    for k, t in enumerate(texts):
        canon = plain_canonical(t or "")
        first.setdefault(canon, k)
        count[canon] = count.get(canon, 0) + 1
    for k, t in enumerate(texts):
        canon = plain_canonical(t or "")
        assert (got[k]["class_id"], got[k]["class_rows"]) == (first[canon], count[canon]) and got[k]["fingerprint"] == got[first[canon]]["fingerprint"]
    assert len({r["fingerprint"] for r in got.values()}) == len(first)
    sql = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')),
        n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS f FROM d)
        SELECT doc_id, length(t), sha256(left(t, length(t) - length(t) // 3) || left(f, length(t) // 3)) FROM n ORDER BY 1"""
    # length and left count characters as written, not code points, only where marks combine; none stand alone here
    assert duckdb.sql(sql).fetchall() == [(k, got[k]["n_chars"], got[k]["edited_sha256"]) for k in range(len(texts))]


def test_fingerprints(spark):
    texts = [None, "", "One  Two three", "one two\nTHREE", "Straße ﬁne", "STRASSE FINE", "é é", "x" * 100_000, *ODD[:60]]
    got = {r["doc_id"]: r for r in fingerprints.with_following(docs(spark, texts).repartition(7)).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        text, following = t or "", texts[k - 1] or "" if k else texts[-1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        r = got[k]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        canon = [plain_canonical(x) for x in (text, edited, following)]
        assert (r["near_edited"], r["near_next"]) == (float(canon[0] == canon[1]), float(canon[0] == canon[2]))
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (canon[0] == canon[1])
    assert got[2]["fingerprint"] == got[3]["fingerprint"] and got[4]["fingerprint"] == got[5]["fingerprint"] != got[2]["fingerprint"]
    assert fingerprints.with_following(docs(spark, [])).count() == 0
    alone = fingerprints.with_following(docs(spark, ["abcdef"])).collect()[0]
    assert alone["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and alone["near_next"] == 1.0
    same = spark.createDataFrame([(k, "abc", *"xyzw") for k in (1, 1, None, None, 2)], SCHEMA)
    assert fingerprints.with_following(same).count() == 5


def test_equal_digests_of_other_bytes_fall_apart(spark, monkeypatch):
    classes = {r["doc_id"]: r for r in fingerprints.exact_classes(docs(spark, ["A b", "a  B", "c", None, ""])).collect()}
    assert [classes[k]["class_id"] for k in range(5)] == [0, 0, 2, 3, 3]
    monkeypatch.setattr(fingerprints, "printed", lambda t: (fingerprints.canonical(t), "clash"))
    clash = {r["doc_id"]: r for r in fingerprints.exact_classes(docs(spark, ["A b", "a  B", "c"])).collect()}
    assert [clash[k]["class_id"] for k in range(3)] == [0, 0, 2] and clash[0]["fingerprint"] == clash[1]["fingerprint"] != clash[2]["fingerprint"]


def test_licenses(spark):
    mit = dict(licenses.TEXTS)["MIT"]
    apache = next(t for k, t in licenses.TEXTS if k == "Apache-2.0" and "[yyyy]" in t)
    texts = [
        f"Copyright (c) 2020 Someone\n\n{mit}", mit.upper().replace(" ", "  "), mit + " more", "prose\nReleased under the MIT License.\nprose", "released under the mit licence", None, "", "License",
        "Licensed under the Apache License, Version 2.0.\nThis work is licensed under the GNU General Public License, version 3.", "word " * 50_000,
        f"Copyright Jane Roe 2020\n\n{mit}", f"Copyright 2019, Jane Roe\nAll rights reserved.\n\n{dict(licenses.TEXTS[:7])['BSD-2-Clause']}", apache.replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2020 Jane Roe"),
        "licence licence licence", "license license license",
    ]
    frame = docs(spark, texts).unionByName(docs(spark, texts[:1]))
    rows = licenses.scan(frame, licenses.known(spark)).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts) + 1
    assert [got[k]["license_id"] for k in range(len(texts))] == ["MIT", "MIT", *[None] * 8, "MIT", "BSD-2-Clause", "Apache-2.0", None, None]
    assert [got[k]["notices"] for k in range(len(texts))] == ["", "", "", "MIT", "MIT", "", "", "", "Apache-2.0,GPL-3.0", "", "", "", "Apache-2.0", "", ""]  # the whole text holds its own header
    assert got[13]["digest"] == got[14]["digest"] and all(got[k]["digest"] == licenses.plain_digest(t or "") for k, t in enumerate(texts))
    con = duckdb.connect()
    con.register("documents", docs(spark, texts).toPandas()[["doc_id", "text"]])
    assert sorted(con.sql(f"SELECT doc_id, digest, license_id, notices FROM ({licenses.OP4_SQL})").fetchall()) == sorted(tuple(got[k]) for k in range(len(texts)))
    assert licenses.scan(docs(spark, []), licenses.known(spark)).count() == 0


def test_licenses_under_titles_and_names(spark):
    plain = dict(licenses.TEXTS[:7])
    mit, bsd, isc = plain["MIT"], plain["BSD-3-Clause"], plain["ISC"]
    heads = ["The MIT License (MIT)\n\n", "The MIT License\n", "(The MIT License)\n\n", "# MIT Licence\n=====\n", "Copyright Jane Roe\n\n", "MIT License\n\nCopyright Jane Roe and others\nCopyright Acme, Inc.\n\n", "// Copyright Jane Roe\nMIT License:\n", "\n\nLICENSE\n"]
    texts = [h + mit for h in heads] + [f"The 3-Clause BSD License\nCopyright 2001 A\n{bsd}", f"ISC License (ISC)\n{isc}", isc.replace("copyright notice", "\ncopyright notice")]
    known = len(texts)
    texts += ["This isn't about any of the terms of the MIT License\n" + mit, f"{mit}\nMIT License", "MIT License\n", "Copyright law\nMIT License\n", "Copyright Jane Roe", f"Ελληνικά MIT License\n{mit}", "copyright " * 5000, "x\n" * 5000 + "mit license\n"]
    got = sorted(licenses.scan(docs(spark, texts), licenses.known(spark)).collect(), key=lambda r: r["doc_id"])
    assert [r["license_id"] for r in got[:known]] == ["MIT"] * len(heads) + ["BSD-3-Clause", "ISC", "ISC"] and not any(r["license_id"] for r in got[known:])
    assert [r["digest"] for r in got] == [licenses.plain_digest(t) for t in texts]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    assert sorted(con.sql(f"SELECT doc_id, digest, license_id, notices FROM ({licenses.OP4_SQL})").fetchall()) == sorted(map(tuple, got))
    lines = {'Licensed under the Apache License, Version 2.0 (the "License");': "Apache-2.0", "SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0", " * SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1", "Released under the Unlicense.": "Unlicense", "released under CC0 1.0": "CC0-1.0", "Licensed under MIT": "MIT"}
    got = sorted(licenses.scan(docs(spark, list(lines)), licenses.known(spark)).collect(), key=lambda r: r["doc_id"])
    assert [r["notices"] for r in got] == list(lines.values())
    assert {k for k, _ in licenses.TEXTS} <= {k for k, _ in licenses.NOTICES}


def test_licenses_of_long_texts_and_every_notice(spark):
    full = {k: t for k, t in licenses.TEXTS if k in ("Apache-2.0", "GPL-2.0", "LGPL-2.1", "MPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0")}
    assert len(full) == 6
    lines = ["Released under CC BY 4.0.", "x\nDistributed under the CC BY-SA 4.0.\ny", "Distributed under CC BY", "released", "Some of https version 3", "sub licence"]
    texts = [*full.values(), *lines]
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, texts), licenses.known(spark)).collect()}
    assert [got[k]["license_id"] for k in range(len(full))] == list(full)
    assert [got[k]["notices"] for k in range(len(full), len(texts))] == ["CC-BY-4.0", "CC-BY-SA-4.0", "", "", "", ""]
    own = spark.createDataFrame([("A", "notice", "Free of charge"), ("B", "notice", "http version 3"), ("C", "notice", "Sub-license")], "license_id string, kind string, text string")
    for listed, want in ((own.where("license_id != 'B'"), "A,C"), (own, "A,B,C")):
        assert licenses.scan(docs(spark, ["FREE of charge!\nHTTPS v3\nsublicence"]), listed).collect()[0]["notices"] == want


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain", "plain"), ("a &amp; b&nbsp;c", "a & b\xa0c"), ("<p>a<p>b", "a\n\nb"), ("x<br>y", "x\ny"), ("Hello <b>big</b>world", "Hello bigworld"), ("<b>a</b> <i>b</i>", "a b"),
        ("<head><title>t</title><style>s</style></head><body>x", "x"), ("<script>var a='<p>';</script>x", "x"), ("<div hidden>n</div>y<span style='display: none'>n</span>", "y"), ("<ul><li>a<li>b<ol start=3><li>c</ol></ul>", "- a\n- b\n  3. c"),
        ("<table><tr><th>Name<th>N<tr><td>apple<td>10</table>", "Name   N\napple  10"), ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"), ("<pre> a\n  b</pre>", " a\n  b"), ("<p>a</div>b", "ab"), ("<!-- x -->a<![CDATA[b]]>", "ab"), ("<a href='x>y'>z", "z"), ("a < b", "a < b"),
        ("<div>" * 3000 + "deep", "deep"), ("<blockquote>q</blockquote>z", "> q\n\nz"), ("<dl><dt>t<dd>d</dl>", "t\n    d"), ("<img alt='pic'> <input type=hidden value=n>", "pic"), ("<script>never closed", ""),
    ],
)
def test_html(page, text):
    assert html_text.visible_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><tr><form><td>x</td></form></tr></table>", "x"), ("<table><tbody><td>x<td>y<tr><td>z</table>w", "x  y\nz\n\nw"), ("<table><tbody><form><tr><td>x</td></tr></form></tbody></table>", "x"), ("<table><tr>a <b>b</b><td>x</table>", "a b\n\nx"),
        ("<table><thead><p>h</p><tr><th>x<tbody>t<tr><div hidden>n<td>y</table>", "h\n\nt\n\nx\ny"), ("<table><td>x</td><tr><td>y</table>", "x\ny"), ("<table><colgroup><col>c<tr><td>x</table>", "c\n\nx"), ("<table><colgroup><a>c</a><td>x</table>", "c\n\nx"),
        ("<table><form hidden>f<tr><td>x</table>", "f\n\nx"), ("<table><div><tr><td>x<td>y</table>", "x  y"), ("<table><tr hidden>a<td>n</table>", "a"), ("<table hidden><tr>a<td>n</table>", "a"), ("<table><tr><td>x<table><tr>i<td>y</table></table>", "xi\n\ny"),
        ("<table><tr><td>a<table><tr><td>b</table>c<td>d</table>e", "a  d\n\nb\n\nc\n\ne"), ("<table><tr><td>x<tr><table><tr><td>y</table>", "x\n\ny"), ("<table><tr><td><template><td>n</template>x</table>", "x"), ("<tr>a<td>x", "a x"), ("<table><caption>c<td>x</table>", "c\nx"),
    ],
)
def test_html_between_table_parts(page, text):
    assert html_text.visible_text(page) == text


def test_html_loses_no_word_in_odd_tables():
    rng = random.Random(3)
    tags = [f"<{e}{n}>" for e in ("", "/") for n in "table thead tbody tfoot tr td th caption colgroup form div p b a span ul li".split()] + ["<col>", "<br>"]
    for _ in range(3000):
        parts = [x for k in range(rng.randrange(2, 25)) for x in (rng.choice(tags), *[f" w{k}w "] * (rng.random() < 0.6))]
        page = "<table>" * rng.randrange(2) + "".join(parts)
        assert sorted(html_text.visible_text(page).replace("\n", " ").replace("- ", " ").split()) == sorted(x.strip() for x in parts if x[0] == " "), page


@pytest.mark.parametrize("depth", [1, 7, 8, 9, 40, 400])
def test_html_lays_out_tables_at_any_depth(depth):
    inner = "<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>"
    assert html_text.visible_text("<table><tr><td>" * depth + inner + "</table>" * depth + "e") == "a    bb\nccc  d\n\ne"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<details><summary>s</summary>n</details>y", "s\ny"), ("<details open><summary>s</summary>x</details>y", "s\nx\ny"), ("<div style='visibility:hidden'>n<b style='visibility: visible'>x</b>n</div>y", "x\ny"), ("<table><tr><td>a<tr style='visibility:collapse'><td>n</table>", "a"),
        ("<table><tr><td><p>a<p>b<td>c</table>", "a  c\n\nb"), ("<a href=\"x>y", "y"), ("<a b = 'c>d' e>x", "x"), ("<ul><li><blockquote>q<li>r</ul>", "- > q\n\n- r"), ("<table><tr><td rowspan=2 colspan=2>a<td>b<tr><td>c<tr><td>d<td>e<td>f</table>", "a     b\n      c\nd  e  f"),
    ],
)
def test_html_visibility_and_spacing(page, text):
    assert html_text.visible_text(page) == text


LONG = 200_000


@pytest.mark.parametrize("unit", ["<div>", "<p>x", "<table><tr><td>x", "<table><tr><td>a<td>b<tr><td>c<td>", "<ul><li>x", "<blockquote><table><tr><td>x", "<tr><td rowspan=60000 colspan=100>x", "<tr><td rowspan={} colspan=3>x", '<a "', "<b></div>", "<!--"])
def test_html_takes_linear_time(unit):
    n = LONG // len(unit)
    page = "<table>" * unit.startswith("<tr>") + "".join(unit.format(n // 2 + k % (n // 2)) for k in range(n))
    began = time.process_time()
    text = html_text.visible_text(page)
    assert time.process_time() - began < 5
    assert sum(text.count(c) for c in "xabc") == n * sum(unit.partition("<td")[2].count(f">{c}") or unit.count(f">{c}") for c in "xabc")


def some_html(rng, depth, counter):
    """Random markup, end tags left out where they are implied, and its tree: (name, children) or a word."""
    out, tree = [], []
    for _ in range(rng.randrange(1, 4)):
        kind = rng.choice(["text", "p", "div", "ul", "ol", "blockquote", "table", "gone"] if depth else ["text"])
        if kind == "text":
            counter[0] += 1
            tree.append(f"w{counter[0]}")
            out.append(f" {tree[-1]}\n")
        elif kind == "gone":
            out.append(rng.choice(["<div hidden> no </div>", "<script>no</script>", "<p style='display:none'>no</p>", "<!-- no -->"]))
        elif kind == "p":
            inner, own = some_html(rng, 0, counter)
            out.append(f"<p>{inner}</p>")
            tree.append(("p", own))
        elif kind in ("ul", "ol", "table"):
            parts, own = [], []
            for _ in range(rng.randrange(1, 4)):
                if kind == "table":
                    cells = [some_html(rng, depth - 1 if rng.random() < 0.3 else 0, counter) for _ in range(rng.randrange(1, 4))]
                    parts.append("<tr>" + "".join(f"<td>{h}" + rng.choice(["", "</td>"]) for h, _ in cells) + rng.choice(["", "</tr>"]))
                    own.append([t for _, t in cells])
                else:
                    h, t = some_html(rng, depth - 1, counter)
                    parts.append(f"<li>{h}" + rng.choice(["", "</li>"]))
                    own.append(t)
            out.append(f"<{kind}>{''.join(parts)}</{kind}>")
            tree.append((kind, own))
        else:
            h, t = some_html(rng, depth - 1, counter)
            out.append(f"<{kind}>{h}</{kind}>")
            tree.append((kind, t))
    return "".join(out), tree


class Plain:
    """A renderer by plain recursion over a tree, tables bottom up as texts."""

    def __init__(self):
        self.lines, self.gap, self.inline = [], False, []
        self.prefix = self.first = ""

    def put(self, line):
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append(((self.first or self.prefix) + line).rstrip())
        self.first = ""

    def flush(self):
        if self.inline:
            self.put(" ".join(self.inline))
        self.inline = []

    def space(self, kind):
        self.gap = self.gap or kind in ("p", "blockquote", "table") or kind in ("ul", "ol") and not self.prefix

    def walk(self, nodes):
        for node in nodes:
            if isinstance(node, str):
                self.inline.append(node)
                continue
            kind, own = node
            self.flush()
            self.space(kind)
            if kind == "table":
                for line in self.table(own):
                    self.put(line)
            elif kind in ("ul", "ol"):
                before = self.prefix
                for k, item in enumerate(own):
                    self.flush()
                    mark = f"{k + 1}. " if kind == "ol" else "- "
                    self.prefix, self.first = before + " " * len(mark), before + mark
                    self.walk(item)
                    self.flush()
                    self.prefix, self.first = before, ""
            else:
                before, first = self.prefix, self.first
                if kind == "blockquote":
                    self.prefix, self.first = before + "> ", first and first + "> "
                self.walk(own)
                self.flush()
                self.prefix, self.first = before, self.first and first
            self.space(kind)

    def table(self, rows):
        cells = [[Plain.of(c) for c in row] for row in rows]
        wide = [max((len(x) for row in cells if len(row) > k for x in row[k]), default=0) for k in range(max(map(len, cells)))]
        for row in cells:
            for k in range(max(map(len, row))):
                line = ""
                for x, cell in enumerate(row):
                    if k < len(cell) and cell[k]:
                        at = sum(w + 2 for w in wide[:x] if w)
                        line = line + " " * max(at - len(line), 2 if line else 0) + cell[k]
                yield line

    @staticmethod
    def of(tree):
        out = Plain()
        out.walk(tree)
        out.flush()
        return out.lines


@pytest.mark.parametrize("seed", range(300))
def test_html_matches_plain_recursion(seed):
    page, tree = some_html(random.Random(seed), 4, [0])
    assert html_text.visible_text(page) == "\n".join(Plain.of(tree)).strip("\n"), page


def test_html_table(spark):
    frame = spark.createDataFrame([(1, "u", "<p>a", "t"), (1, "u", "<p>a", "t"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert sorted((r["page_id"] or 0, r["text"]) for r in html_text.extract(frame).collect()) == [(0, ""), (1, "a"), (1, "a")]
    assert html_text.extract(frame.limit(0)).count() == 0
