"""Deterministic sharded WARC writer, and its reader.

Writing: payload digests find equal payloads (a sum per digest, joined back as
ids only); records are range-sorted by page id. Where a range ends follows from the pages
alone: running sums of their bytes in order of (page id, payload) are cut at multiples of
``part_bytes``, or of a ``MOST_PARTS``-th of all bytes if that is more, and the few cuts go to
all tasks. A task for each range appends one gzip member
for each record to a file with a temporary name, starts the next file when the
compressed size passes ``roll_bytes``, and renames a finished file to a name made
of its range and number. Headers, record ids and digests are made anew from the
content and the date is a parameter, so writing the same pages again, however they are
partitioned and also in a repeated task, gives the same files and bytes. The files of successful tasks are listed in a
manifest, a Parquet table that Spark commits; what it doesn't list isn't read.

Files are written below a URI that all executors reach (``pyarrow.fs``).

Defined results: a null payload is empty; of equal payloads of at least
``least_bytes`` bytes the record with the smallest page id is a response and the
others revisit it (of rows that repeat a page id and payload the first is the
response; a null page id counts as the largest). An empty table writes no file. A range holds
all rows with one page id and payload; a very long payload is one record, in memory whole.
Only the three columns are read, so other columns' names don't matter.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penalytics.operators.ordered import running_sum

from .common import file_system, prepare_workers, scratch_path, stage

ROLL_BYTES = 64 << 20
#: Least bytes of payload of a range, and the largest number of ranges.
PART_BYTES, MOST_PARTS = 16 << 20, 20_000
#: A record's headers, roughly.
HEADER_BYTES = 512
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records long, compressed_bytes long, first_id long, last_id long, sha1 string"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public one for URLs


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}:{digest}')}>"


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [*headers, ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def page_record(page_id, url: str | None, payload: bytes, digest: str, refers_to, is_revisit: bool) -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", DATE), ("WARC-Target-URI", quote(url or "", safe="%/:=&?~#+!$,;'@()*[]-._")),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-ID", "" if page_id is None else page_id)]
    if is_revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest)),
                    ("X-Refers-To-Page-ID", "" if refers_to is None else refers_to)]
    return _record(headers, http if is_revisit else http + payload)


class _Roller:
    """Appends records to files of a bounded compressed size below a folder."""

    def __init__(self, fs: pyarrow.fs.FileSystem, folder: str, part: int, attempt: int, roll_bytes: int):
        self.fs, self.folder, self.part, self.attempt, self.roll = fs, folder, part, attempt, roll_bytes
        self.number, self.sink = 0, None

    def _open(self) -> None:
        self.name = f"part-{self.part:06d}-{self.number:05d}.warc.gz"
        self.temporary = f"{self.folder}/_temporary/{self.name}.{self.attempt}"
        self.fs.create_dir(f"{self.folder}/_temporary")
        self.sink, self.size, self.records, self.ids, self.digest = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, [], hashlib.sha1()
        info = f"software: penalytics\r\nformat: WARC File Format 1.1\r\nfile: {self.name}\r\n".encode()
        self._append(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id("info", self.name)),
                              ("WARC-Date", DATE), ("WARC-Filename", self.name),
                              ("Content-Type", "application/warc-fields")], info))

    def _append(self, record: bytes) -> None:
        member = gzip.compress(record, 6, mtime=0)
        self.sink.write(member)
        self.digest.update(member)
        self.size += len(member)

    def write(self, page_id, record: bytes) -> dict | None:
        if self.sink is None:
            self._open()
        self._append(record)
        self.records += 1
        self.ids = [self.ids[0] if self.ids else page_id, page_id]
        return self.close() if self.size >= self.roll else None

    def close(self) -> dict | None:
        if self.sink is None:
            return None
        self.sink.close()
        self.sink = None
        final = f"{self.folder}/{self.name}"
        if self.fs.get_file_info(final).type != pyarrow.fs.FileType.NotFound:
            self.fs.delete_file(final)  # left by an earlier attempt: the same bytes
        self.fs.move(self.temporary, final)
        self.number += 1
        return {"file": self.name, "records": self.records, "compressed_bytes": self.size, "first_id": self.ids[0],
                "last_id": self.ids[-1], "sha1": self.digest.hexdigest()}


def _place(page_id: Column, content: Column) -> list[Column]:
    """What ranges are cut by: the page id, null last, then the payload."""
    return [F.coalesce(page_id, F.lit((1 << 63) - 1)).alias("at"), page_id.isNull().alias("no_id"), F.xxhash64(content).alias("tie")]


def _cuts(rows: DataFrame, part_bytes: int, most_parts: int = MOST_PARTS) -> list[tuple]:
    """Where each range but the first begins, as (at, no_id, tie): ``most_parts`` of them or fewer."""
    sizes = rows.select(*_place(F.col("page_id"), F.col("content")), (F.octet_length("payload") + HEADER_BYTES).cast("long").alias("b"))
    sizes = stage(sizes.groupBy("at", "no_id", "tie").agg(F.sum("b").alias("b")).withColumn("every", F.lit(0)), "warc-sizes")
    total = sizes.agg(F.sum("b")).first()[0] or 0
    width = max(part_bytes, -(-total // most_parts))
    if total <= width:
        return []
    placed = running_sum(sizes, ["every"], ["at", "no_id", "tie"], ["b"])
    part = F.floor((F.col("cum_b") - F.col("b")) / width)
    first = placed.groupBy(part.alias("part")).agg(F.min(F.struct("at", "no_id", "tie")).alias("first"))
    return sorted(tuple(r["first"]) for r in first.where("part > 0").collect())


def _part_of(cuts: list[tuple]):
    """Range number of a place; most rows are told by the page id alone."""
    ids = np.array([c[0] for c in cuts], np.int64)

    @F.pandas_udf("int")
    def run(at: pd.Series, no_id: pd.Series, tie: pd.Series) -> pd.Series:
        values = at.to_numpy(np.int64)
        low, high = np.searchsorted(ids, values, "left"), np.searchsorted(ids, values, "right")
        out = high.astype(np.int32)
        for k in np.flatnonzero(low < high):
            out[k] = bisect.bisect_right(cuts, (int(values[k]), bool(no_id.iloc[k]), int(tie.iloc[k])))
        return pd.Series(out)

    return run


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", least_bytes: int = 0, roll_bytes: int = ROLL_BYTES,
                   part_bytes: int = PART_BYTES) -> tuple[str, DataFrame]:
    """Write a record for each row below ``folder`` (a URI); returns the folder and the manifest."""
    spark = pages.sparkSession
    prepare_workers(spark)
    folder = folder or scratch_path(spark, "warc")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        payload.alias("payload"), F.sha2(payload, 256).alias("content"))
    sized = rows.where(F.octet_length("payload") >= least_bytes).select("page_id", "content")
    groups = sized.groupBy("content").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    # staged, so that the join deals both sides anew and a payload of very many pages is split
    groups = stage(groups.drop("n"), "warc-groups")
    copies = stage(sized.join(groups, "content").distinct(), "warc-copies")
    # A marker row with the reference sorts just before the page's own rows.
    both = rows.withColumns({"kind": F.lit(1), "refers_to": F.lit(None).cast("long")}).unionByName(
        copies.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"),
                      "content", F.lit(0).alias("kind"), "refers_to"))
    key = F.col("page_id").asc_nulls_last()
    cuts = _cuts(rows, part_bytes)
    part = _part_of(cuts)(*_place(F.col("page_id"), F.col("content"))) if cuts else F.lit(0)
    # a stated number of tasks, one for each range
    ordered = both.repartitionById(len(cuts) + 1, part).sortWithinPartitions(key, "content", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, path = file_system(folder)
        roller = _Roller(fs, path, context.partitionId(), context.taskAttemptId(), roll_bytes)
        schema = pa.schema([("file", pa.string()), ("records", pa.int64()), ("compressed_bytes", pa.int64()),
                            ("first_id", pa.int64()), ("last_id", pa.int64()), ("sha1", pa.string())])
        marker, refers_to, first = None, None, True
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    marker, refers_to, first = (r["page_id"], r["content"]), r["refers_to"], True
                    continue
                copied = marker == (r["page_id"], r["content"])
                revisit = copied and (r["page_id"] != refers_to or not first)
                first = False
                digest = sha1_base32(r["payload"])
                done = roller.write(r["page_id"], page_record(r["page_id"], r["url"], r["payload"], digest, refers_to, revisit))
                if done:
                    yield pa.RecordBatch.from_pylist([done], schema)
        if done := roller.close():
            yield pa.RecordBatch.from_pylist([done], schema)

    manifest = ordered.mapInArrow(run, MANIFEST)
    manifest.write.parquet(f"{folder}/_manifest")
    return folder, spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


HEADER = re.compile(rb"([^:\r\n]+): ?([^\r\n]*)\r\n")


def _records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an open, uncompressed archive."""
    while line := source.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"no WARC record: {line[:40]!r}")
        headers = {}
        while (line := source.readline()) not in (b"\r\n", b""):
            name, value = HEADER.fullmatch(line).groups()
            headers[name.decode()] = value.decode()
        block = source.read(int(headers["Content-Length"]))
        if source.read(4) != b"\r\n\r\n" or headers["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}":
            raise ValueError(f"damaged record {headers.get('WARC-Record-ID')}")
        yield headers, block


RECORDS = ("page_id long, url string, record_type string, refers_to long, payload_digest string, "
           "payload_bytes long, payload binary")


def read_archives(folder: str, manifest: DataFrame, most_tasks: int = 50_000) -> DataFrame:
    """``RECORDS`` of the manifest's files, each digest checked; a revisit has no payload of its own.

    A task reads a file, or several where there are more than ``most_tasks`` files.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = file_system(folder)
        for batch in batches:
            for name in batch["file"]:
                with fs.open_input_stream(f"{path}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as source:
                    rows, size = [], 0
                    for headers, block in _records(source):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        revisit, digest = headers["WARC-Type"] == "revisit", headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if not revisit and (len(payload) != length or sha1_base32(payload) != digest):
                            raise ValueError(f"damaged payload in {headers['WARC-Record-ID']}")
                        page, ref = headers["X-Page-ID"], headers.get("X-Refers-To-Page-ID")
                        rows.append((int(page) if page else None, headers["WARC-Target-URI"], headers["WARC-Type"],
                                     int(ref) if ref else None, digest, length, None if revisit else payload))
                        size += len(payload)
                        if len(rows) >= 1000 or size > 16 << 20:
                            yield _frame(rows)
                            rows, size = [], 0
                    yield _frame(rows)

    # A stated number of tasks: names are few bytes, by which Spark would put all files into one task.
    tasks = max(1, min(manifest.count(), most_tasks))
    return manifest.select("file").repartitionByRange(tasks, "file").mapInPandas(run, RECORDS)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])
    return frame.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})
