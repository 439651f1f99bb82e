"""Texts at addresses: a local server, files, and what fails."""

import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from waymark import tables
from waymark.operators import retrieve
from waymark.sources import web


class Handler(BaseHTTPRequestHandler):
    asked: list[str] = []
    at_once, most = 0, 0
    lock = threading.Lock()

    def do_GET(self):
        with Handler.lock:
            Handler.asked.append(self.path)
            Handler.at_once += 1
            Handler.most = max(Handler.most, Handler.at_once)
        try:
            if self.path.startswith("/slow"):
                time.sleep(1.2)
            if self.path == "/moved":
                self.send_response(302)
                self.send_header("Location", "/text")
                self.end_headers()
                return
            code = {"/none": 404, "/broken": 500}.get(self.path, 200)
            body = {"/empty": b"", "/big": b"x" * 5000, "/bytes": b"\xffok"}.get(self.path, b"# Text\n[more](/more.md)")
            time.sleep(0.02)
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body)
        except OSError:
            pass
        finally:
            with Handler.lock:
                Handler.at_once -= 1

    def log_message(self, *_):
        pass


@pytest.fixture
def site():
    Handler.asked, Handler.at_once, Handler.most = [], 0, 0
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_outcomes_of_addresses(spark, site, tmp_path):
    (tmp_path / "root").mkdir()
    (tmp_path / "root" / "a.md").write_text("own é")
    (tmp_path / "secret").write_text("no")
    want = {
        f"{site}/text": ("text", 23), f"{site}/moved": ("text", 23), f"{site}/none": ("status 404", None), f"{site}/broken": ("status 500", None), f"{site}/empty": ("empty", 0),
        f"{site}/big": ("too large", None), f"{site}/bytes": ("text", 3), f"{site}/slow": ("too slow", None), "http://127.0.0.1:9/x": ("away", None), "http://[bad": ("away", None), "odd://x/y": ("away", None),
        "a.md": ("text", 6), "gone.md": ("away", None), "../secret": ("outside", None), str(tmp_path / "secret"): ("outside", None), f"file://{tmp_path}/root/a.md": ("text", 6), "": ("away", None), None: ("away", None),
    }
    links = spark.createDataFrame([(u, 1) for u in want for _ in range(2)], "url string, other int")
    got = web.read_texts(links, str(tmp_path / "root"), timeout=0.6, max_bytes=4000)
    for _ in range(2):  # the second look asks nobody
        rows = {r["url"]: r for r in got.collect()}
        assert {u: (r["outcome"], r["bytes"]) for u, r in rows.items()} == want
    assert rows[f"{site}/bytes"]["raw"] == "�ok" and rows["a.md"]["raw"] == "own é" and rows[f"{site}/big"]["raw"] is None
    assert sorted(Handler.asked) == sorted(["/text", "/moved", "/text", "/none", "/broken", "/empty", "/big", "/bytes", "/slow"])
    tables.drop(got)


def test_requests_to_one_host_are_few(spark, site):
    links = spark.createDataFrame([(f"{site}/p{k}",) for k in range(40)], "url string")
    assert web.read_texts(links, per_host=2).where("outcome = 'text'").count() == 40
    assert len(Handler.asked) == 40 and Handler.most <= 2


def test_no_addresses(spark):
    assert web.read_texts(spark.createDataFrame([], "url string")).collect() == []


def test_sources_keep_outcomes(spark, site):
    sources = [{"id": "s", "llmsTxt": f"{site}/text"}, {"id": "t", "llmsTxt": f"{site}/none"}, {"id": "o", "llmsTxt": f"{site}/big", "includeInRetriever": False}, {"id": "p"}]
    got = web.federated_sources(spark, sources)
    assert sorted((r["source_id"], r["outcome"], r["raw"] is None) for r in got.collect()) == [("s", "text", False), ("t", "status 404", True)]
    texts = web.read_texts(retrieve.federated_links(got.where("raw is not null").withColumn("base", got["url"].substr(1, len(site)))))
    assert [r["outcome"] for r in texts.collect()] == ["text"] and Handler.asked[-1] == "/more.md"


def test_hosts(spark):
    rows = {"https://A.b:1/x": "a.b:1", "http://u:p@h/x": "h", "s3://k": "k", "a/b": "", "/a://b": "", "file:///x": ""}
    assert {r["u"]: r["h"] for r in spark.createDataFrame([(u,) for u in rows], "u string").select("u", web.host("u").alias("h")).collect()} == rows
