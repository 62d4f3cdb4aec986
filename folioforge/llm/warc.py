"""WARC archives with a two-level capture index.

Archives are gzip-per-record WARC/1.1 files that tasks write to the shared folder. The index is sorted
by reversed-host URL key and cut into compressed blocks; a sparse directory holds each block's first key.
A lookup binary-searches the directory, then the block, then reads the record's byte range.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import math
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, new_path, written

#: The directory has about this many entries at most, of KEY characters at most: 16 MB.
DIRECTORY, KEY = 65_536, 256
BLOCK_LINES = 1_000
ARCHIVE_BYTES = 1 << 30
#: A revisit pays from this payload size on.
REVISIT_BYTES = 100
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """com,example,www)/path?query for http://www.example.com/path?query#fragment; what has no host stays itself."""
    url = quote((url or "").strip(), safe="%/:=&?~#+!$,;'@()*[]-._")
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port
    except ValueError:
        return url
    if not host:
        return url
    key = ",".join(reversed(host.split(".")))
    if port and (parts.scheme, port) not in (("http", 80), ("https", 443)):
        key += f":{port}"
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record; a revisit carries the HTTP head only."""
    block = HTTP if revisit else HTTP + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(page_id, digest), "WARC-Date": date,
        "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http; msgtype=response",
        "X-Payload-Length": str(len(payload)), "Content-Length": str(len(block)),
    }
    if url is not None:
        head["WARC-Target-URI"] = quote(url, safe="%/:=&?~#+!$,;'@()*[]-._")
    if page_id is not None:
        head["X-Page-Id"] = str(page_id)
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, digest)}
        if refers_to is not None:
            head["X-Refers-To-Page-Id"] = str(refers_to)
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of an uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, rest[: int(fields["content-length"])]


def gzipped(data: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


MANIFEST = "surt string, page_id long, archive string, at long, length long"


def classified(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, first (the smallest page_id of the payload where it is large enough).

    The smallest id per digest is aggregated map-side; the join back may be skewed by a payload that very
    many pages share, and adaptive execution splits that.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    large = F.octet_length(html) >= REVISIT_BYTES
    first = pages.where(large).groupBy(F.sha2(html, 256).alias("f_digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return p.join(first.drop("n"), p["digest"] == F.col("f_digest"), "left").drop("f_digest")


def write_archives(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes one record per page to archives in the shared folder; returns the manifest of captures.

    An attempt writes files of its own name, and only the files of the attempts that succeed are in the
    manifest, so that lost executors leave unreferenced files at most.
    """
    folder = new_path(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task, out, name, at, files = TaskContext.get(), None, "", 0, 0
        for batch in batches:
            rows: list[tuple] = []
            for page_id, url, html, digest, first in zip(*[batch[c].to_pylist() for c in ("page_id", "url", "html", "digest", "first")], strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at, files = f"part-{task.partitionId():06d}-{files:04d}-{uuid.uuid4().hex[:12]}.warc.gz", 0, files + 1
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                data = gzipped(record(page_id, url, html, digest, first, first is not None and page_id != first, date))
                out.write(data)
                rows.append((url_key(url), page_id, name, at, len(data)))
                at += len(data)
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["surt", "page_id", "archive", "at", "length"])
        if out is not None:
            out.close()

    manifest = written(classified(pages).mapInArrow(write, MANIFEST), "warc-manifest")
    return manifest.withColumn("archive", F.concat(F.lit(f"{folder}/"), "archive"))


class CaptureIndex:
    """blocks: block_id, first, lines, body. The directory is in memory: first keys by block_id."""

    def __init__(self, blocks: DataFrame, directory: list[tuple[int, str]]) -> None:
        self.blocks, self.directory = blocks, directory


def build_index(manifest: DataFrame, block_lines: int = BLOCK_LINES) -> CaptureIndex:
    """Range-partitions and sorts the captures, and compresses every block_lines of them.

    The block size grows with the captures so that the directory keeps its bound.
    """
    per_block = max(block_lines, math.ceil(manifest.count() / DIRECTORY))

    def compress(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, rest = TaskContext.get().partitionId(), 0, []

        def block(lines: list[tuple]) -> pd.DataFrame:
            body = "\n".join(json.dumps(x, ensure_ascii=False) for x in lines)
            return pd.DataFrame({"block_id": [(part << 32) | seq], "first": [lines[0][0][:KEY]], "lines": [len(lines)], "body": [zlib.compress(body.encode())]})

        for pdf in batches:
            rest += [(s, None if pd.isna(p) else int(p), a, int(o), int(n)) for s, p, a, o, n in pdf[["surt", "page_id", "archive", "at", "length"]].itertuples(index=False)]
            while len(rest) >= per_block:
                yield block(rest[:per_block])
                rest, seq = rest[per_block:], seq + 1
        if rest:
            yield block(rest)

    ordered = manifest.repartitionByRange("surt", "page_id", "archive", "at").sortWithinPartitions("surt", "page_id", "archive", "at")
    blocks = written(ordered.mapInPandas(compress, "block_id long, first string, lines int, body binary"), "warc-index")
    directory = sorted((r.block_id, r.first) for r in blocks.select("block_id", "first").collect())
    return CaptureIndex(blocks, directory)


def in_block(body: bytes, surts: list[str]) -> list[tuple]:
    """All captures of the wanted keys in one block, by binary search."""
    lines = [json.loads(x) for x in zlib.decompress(body).decode().split("\n")]
    keys = [x[0] for x in lines]
    return [tuple(lines[i]) for s in surts for i in range(bisect.bisect_left(keys, s), bisect.bisect_right(keys, s))]


def locate(index: CaptureIndex, urls: DataFrame, url: str = "url") -> DataFrame:
    """surt, page_id, archive, at, length of every capture of the given URLs (each URL counts once)."""
    spark = urls.sparkSession
    shipped = spark.sparkContext.broadcast(([b for b, _ in index.directory], [f for _, f in index.directory]))

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, firsts = shipped.value
        for pdf in batches:
            hit = []
            for s in {url_key(u) for u in pdf["url"]}:
                lo, hi = max(0, bisect.bisect_left(firsts, s[:KEY]) - 1), bisect.bisect_right(firsts, s[:KEY])
                hit += [(b, s) for b in ids[lo:hi]]
            yield pd.DataFrame(hit, columns=["block_id", "surt"])

    wanted = urls.select(F.col(url).alias("url")).distinct().mapInPandas(candidates, "block_id long, surt string").distinct()

    def search(lookups: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        found = [x for body in blocks["body"] for x in in_block(body, list(lookups["surt"]))] if len(lookups) else []
        out = pd.DataFrame(found, columns=["surt", "page_id", "archive", "at", "length"])
        return out.astype({"page_id": "Int64", "at": "int64", "length": "int64"})

    return wanted.groupBy("block_id").cogroup(index.blocks.groupBy("block_id")).applyInPandas(search, MANIFEST)


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html binary"
BUFFER = 4 << 20


def read_records(captures: DataFrame, payload: bool = False) -> DataFrame:
    """Range-reads the located records. The digest of a response is computed from what was read and must agree
    with its header; a revisit's is its header's. html is null unless payload is set, and for revisits."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs = handle = None
        name, base, buffer = "", 0, b""
        for pdf in batches:
            rows = []
            for archive, at, length in pdf[["archive", "at", "length"]].itertuples(index=False):
                if archive != name:
                    if handle is not None:
                        handle.close()
                    fs, path = pafs.FileSystem.from_uri(archive)
                    handle, name, base, buffer = fs.open_input_file(path), archive, 0, b""
                if not base <= at <= at + length <= base + len(buffer):  # neighbours share one read
                    base, buffer = at, handle.read_at(max(length, BUFFER), at)
                fields, block = parsed(zlib.decompress(memoryview(buffer)[at - base : at - base + length], 31))
                digest, body = fields["warc-payload-digest"].removeprefix("sha256:"), block.partition(b"\r\n\r\n")[2]
                if fields["warc-type"] == "response" and hashlib.sha256(body).hexdigest() != digest:
                    raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest")
                page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                rows.append((
                    page and int(page), fields.get("warc-target-uri"), int(fields["x-payload-length"]), digest, fields["warc-type"],
                    refers and int(refers), body if payload and fields["warc-type"] == "response" else None,
                ))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in RECORDS.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})
        if handle is not None:
            handle.close()

    piece = F.floor(F.col("at") / (64 << 20))
    ordered = captures.withColumn("piece", piece).repartition("archive", "piece").sortWithinPartitions("archive", "at")
    return ordered.drop("piece").mapInPandas(read, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html), indexes the archives, looks every URL up and
    reads the records back.

    Null html is an empty payload, null url the empty key, null page_id is kept as null. Of equal payloads
    of at least REVISIT_BYTES the row with the smallest page_id is the response (repeated rows with that id
    all are), others revisit it; where no such row has an id, all are responses. Empty table: no rows.
    """
    manifest = write_archives(pages.select("page_id", "url", "html"))
    return read_records(locate(build_index(manifest), pages))
