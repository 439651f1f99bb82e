"""Texts at addresses as a data source, read by the tasks: web addresses, files below a root, files of other stores.

Addresses are a table, never a list on the driver. It is dealt out by host, a host's addresses in few lanes, so that no host gets more than that many
requests at once; every address comes back as a row with its outcome, so a source that is away is seen and stops nothing.
"""

from __future__ import annotations

import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from waymark import tables
from waymark.sources.stores import store

#: Seconds that an address may take in all, and bytes that its text may have.
TIMEOUT, MAX_BYTES = 5.0, 16 << 20
#: Requests to one host at once.
PER_HOST = 4
#: Bytes read between two looks at the clock.
STEP = 1 << 16
SCHEMA = "url string, raw string, outcome string, bytes long"


def _read(stream, most: int, until: float) -> tuple[bytes | None, str]:
    held, size = [], 0
    while part := stream.read(STEP):
        size += len(part)
        if size > most:
            return None, "too large"
        if time.monotonic() > until:
            return None, "too slow"
        held.append(part)
    return b"".join(held), "text" if size else "empty"


def fetch(address: str | None, root: str = ".", timeout: float = TIMEOUT, max_bytes: int = MAX_BYTES) -> tuple[str | None, str, int | None]:
    """(text, outcome, bytes) of an address, tried once.

    Outcomes: text, empty, too large, too slow, outside (a file beyond the root), away (nothing there, or no answer), status and its number. Only text
    comes with a text, in UTF-8 with what isn't replaced.
    """
    until = time.monotonic() + timeout
    try:
        if not address:
            return None, "away", None
        if re.match(r"https?://", address):
            with urllib.request.urlopen(address, timeout=timeout) as answer:  # noqa: S310
                data, outcome = _read(answer, max_bytes, until)
        elif "://" in address:
            system, path = store(address) or (None, None)
            if system is None:
                return None, "away", None
            with system.open_input_stream(path) as f:
                data, outcome = _read(f, max_bytes, until)
        else:
            base, path = os.path.realpath(root), os.path.realpath(os.path.join(root, address))
            if os.path.commonpath([base, path]) != base:
                return None, "outside", None
            with open(path, "rb") as f:
                data, outcome = _read(f, max_bytes, until)
    except urllib.error.HTTPError as e:
        return None, f"status {e.code}", None
    except TimeoutError:
        return None, "too slow", None
    except urllib.error.URLError as e:
        return None, "too slow" if isinstance(e.reason, TimeoutError) else "away", None
    except Exception:  # an odd address or answer is an outcome like any other
        return None, "away", None
    return (data.decode("utf-8", "replace") if outcome == "text" else None), outcome, None if data is None else len(data)


class AddressFile(InputPartition):
    """A file of addresses."""

    def __init__(self, path: str) -> None:
        self.path = path


class TextReader(DataSourceReader):
    """Reads a Parquet table of addresses, a task a file, and gives their texts one by one."""

    def __init__(self, options: dict[str, str]) -> None:
        self.table, self.root = options["addresses"], options.get("root", ".")
        self.timeout, self.max_bytes = float(options.get("timeout", TIMEOUT)), int(options.get("maxbytes", MAX_BYTES))

    def partitions(self) -> list[AddressFile]:
        system, base = store(self.table)
        found = system.get_file_info(fs.FileSelector(base))
        return [AddressFile(f.path) for f in found if f.type == fs.FileType.File and f.base_name.endswith(".parquet")] or [AddressFile("")]

    def read(self, partition: AddressFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = store(self.table)
        with system.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(1024, columns=["url"]):
                for url in batch.column(0).to_pylist():
                    text, outcome, size = fetch(url, self.root, self.timeout, self.max_bytes)
                    values = [pa.array([url], pa.string()), pa.array([text], pa.string()), pa.array([outcome], pa.string()), pa.array([size], pa.int64())]
                    yield pa.RecordBatch.from_arrays(values, names=["url", "raw", "outcome", "bytes"])


class TextSource(DataSource):
    """Options: addresses (folder of a Parquet table with the column url), root, timeout (seconds), maxBytes."""

    @classmethod
    def name(cls) -> str:
        return "waymark_texts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> TextReader:
        return TextReader({k.lower(): v for k, v in self.options.items()})


def host(url: Column | str) -> Column:
    """What stands between the scheme and the path; empty for files, nulls among them."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), r"\A[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def read_texts(addresses: DataFrame, root: str = ".", timeout: float = TIMEOUT, max_bytes: int = MAX_BYTES, per_host: int = PER_HOST, tasks: int | None = None) -> DataFrame:
    """(url) -> (url, raw, outcome, bytes): each distinct address once, null among them, as a written table.

    What an address gives can change from one look to the next, so each is fetched once, and what is built on the rows reads them again; tables.drop deletes them. A task that is
    lost fetches its addresses again. tasks: four a core if none is given; files have no host and are dealt out over all of them.
    """
    spark = addresses.sparkSession
    spark.dataSource.register(TextSource)
    spread = tasks or 4 * spark.sparkContext.defaultParallelism
    at = host(F.col("url"))
    lane = F.when(at == "", F.pmod(F.xxhash64("url"), F.lit(spread * 16))).otherwise(F.pmod(F.xxhash64("url"), F.lit(per_host)))
    listed = tables.written(addresses.select("url").distinct().withColumns({"host": at, "lane": lane}).repartition(spread, "host", "lane").select("url"))
    try:
        read = spark.read.format("waymark_texts").options(addresses=listed.written_at, root=root, timeout=timeout, maxBytes=max_bytes)
        return tables.written(read.load())
    finally:
        tables.drop(listed)


def write_texts(rows: DataFrame, root: str) -> DataFrame:
    """(path, text) -> (path, bytes), written by the tasks as files below root; null texts make no file. Written again when a task is repeated, alike."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = store(root)
        for batch in batches:
            sizes = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = None if text is None else text.encode()
                sizes.append(None if data is None else len(data))
                if data is not None:
                    system.create_dir(f"{base}/{path}".rpartition("/")[0])
                    with system.open_output_stream(f"{base}/{path}") as f:
                        f.write(data)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return rows.select("path", "text").mapInArrow(put, "path string, bytes long")


def federated_sources(spark: SparkSession, sources: list[dict], **options) -> DataFrame:
    """(source_id, url, raw, base, outcome) of the configured sources that take part in retrieval; raw is null where the outcome isn't text. Options are those of read_texts."""
    rows = [(s["id"], s["llmsTxt"], s.get("rawBaseUrl")) for s in sources if s.get("includeInRetriever") is not False and s.get("llmsTxt")]
    asked = spark.createDataFrame(rows, "source_id string, url string, base string")
    return asked.join(read_texts(asked, **options), "url").select("source_id", "url", "raw", "base", "outcome")
