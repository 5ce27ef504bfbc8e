"""WARC archives of pages and their globally ordered capture index (operator 5).

Writing: every page becomes one WARC record, a gzip member of its own.  Among records of equal payload that with
the smallest page id is the ``response``, the others are ``revisit`` records that name it and carry no payload.
Each task gathers pages of up to RUN_BYTES, sorts them by URL key and capture time and writes them as an archive in the
shared folder, then the next ones; an archive is thus a locally sorted run, and no task holds more than one.  File names hold a random part, and only archives that a
finished task reports are read, so a task that runs twice leaves at most an unread file.

Reading: archives are parsed record by record, payloads checked against their digests, and each record gives an
index entry with its archive, offset and length.  The entries are dealt by ranges of (URL key, time, page id)
and every range merges its sorted pieces of all runs with a loser tree: the external index merge.  Ranges follow
each other, so the whole index is globally ordered.  The range key ends with the page id, hence captures of one
very frequent URL spread over several ranges.

Page captures have no time in the table; it is CAPTURE_START plus the page id in seconds.

Cases: a null html is an empty payload, a null url an empty target; line breaks in a url are percent-encoded in its header; a
null page id counts as the greatest one (a group of such rows alone is all ``response``) and as time 0; rows that repeat the
smallest page id of their payload are all ``response``; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch, table

CAPTURE_START = datetime(2024, 1, 1, tzinfo=timezone.utc)
#: Payload of one archive, and index entries of one merge range, about.
RUN_BYTES = 64 << 20
RANGE_ROWS = 100_000
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = "url_key string, capture_ts string, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, archive string, offset long, length long"


def file_system(uri: str):
    """The file system and path of a folder in the shared store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def url_key(url: str | None) -> str:
    """Sort key of a url: host labels reversed, a lower-case host, no scheme, port 80/443 or fragment."""
    rest = re.sub(r"^[^/?#]*?://", "", url or "").partition("#")[0]
    host, tail = re.match(r"([^/?]*)(.*)", rest, re.DOTALL).groups()
    host = re.sub(r":(80|443)$", "", host.lower())
    return ",".join(reversed(host.split("."))) + ")" + (tail or "/")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def write_record(page_id, url, digest: str, n_bytes: int, payload: bytes | None, refers_to) -> bytes:
    """One record as a gzip member; ``payload`` is None for a revisit."""
    kind = "response" if payload is not None else "revisit"
    block = HTTP_HEAD + (payload or b"")
    target = re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url or "")
    when = CAPTURE_START + timedelta(seconds=page_id if page_id is not None and 0 <= page_id < 2**37 else 0)
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n_bytes}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def read_records(stream) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """offset, length, headers and payload of each record of an archive (a binary file object)."""
    at, data, ended = 0, b"", False
    while True:
        unpack, parts, used = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if not data:
                data = stream.read(1 << 20)
                if not data:
                    ended = True
                    break
            parts.append(unpack.decompress(data))
            used += len(data) - len(unpack.unused_data)
            data = unpack.unused_data
        if ended:
            if any(parts):
                raise ValueError(f"the record at {at} is cut off")
            return
        head, _, block = b"".join(parts).partition(b"\r\n\r\n")
        version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines)
        size = int(headers["Content-Length"])
        if not version.startswith("WARC/") or block[size:] != b"\r\n\r\n":
            raise ValueError(f"no WARC record at {at}")
        yield at, used, headers, block[:size].partition(b"\r\n\r\n")[2]
        at += used


def loser_tree_merge(runs: list[Iterable], key) -> Iterator:
    """Merge sorted runs.  Each inner node keeps the loser of its match, so an item costs one path to the root."""
    heads = [iter(r) for r in runs]
    k = len(heads)
    if not k:
        return
    # a run that has ended loses against all others; equal keys go by run
    front: list = [None] * k
    items: list = [None] * k

    def advance(i):
        for x in heads[i]:
            items[i], front[i] = x, (0, key(x), i)
            return
        items[i], front[i] = None, (1, None, i)

    def less(a, b):
        x, y = front[a], front[b]
        return x[0] < y[0] if x[0] != y[0] else x[0] == 1 and x[2] < y[2] or x[0] == 0 and x[1:] < y[1:]

    for i in range(k):
        advance(i)
    losers = [0] * k
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if less(a, b) else (b, a)
    best = winners[1]
    while not front[best][0]:
        yield items[best]
        advance(best)
        node = (best + k) // 2
        while node:
            if less(losers[node], best):
                best, losers[node] = losers[node], best
            node //= 2


def write_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives; one row for each: archive, records.

    Payloads of fewer than ``min_bytes`` bytes are never revisits.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"sha": F.unhex(F.sha1("html")), "n_bytes": F.octet_length("html").cast("long")})
    small = rows.select("page_id", "sha", "n_bytes")
    groups = small.filter(F.col("n_bytes") >= min_bytes).groupBy("sha", "n_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    # of ids only, so that the pages themselves are dealt by page id and not by payload
    again = small.join(groups, ["sha", "n_bytes"]).filter(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "sha", F.col("first").alias("refers_to")).distinct()
    again = again.select(F.coalesce("page_id", F.lit(-(2**63))).alias("_page"), F.col("sha").alias("_sha"), "refers_to")
    # one exchange deals the pages for the join and for the archives
    left = rows.withColumn("_key", F.coalesce("page_id", F.lit(-(2**63))))
    joined = left.join(again, (F.col("_key") == F.col("_page")) & (F.col("sha") == F.col("_sha")), "left")
    joined = joined.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "sha", "n_bytes", "refers_to")
    folder = scratch(spark, "warc")

    def write(batches):
        store, path = file_system(folder)
        store.create_dir(path, recursive=True)
        clean = lambda x: None if x is None or x != x else int(x)
        rows, size = [], 0

        def flush():
            rows.sort(key=lambda r: (r[0], capture_time(r[1]), -1 if r[1] is None else r[1]))
            name = f"{uuid.uuid4().hex}.warc.gz"
            with store.open_output_stream(f"{path}/{name}", compression=None) as out:
                for _, p, url, html, sha, n, ref in rows:
                    out.write(write_record(p, url, base64.b32encode(sha).decode(), n, None if ref is not None else (html or "").encode(), ref))
            return pd.DataFrame({"archive": [name], "records": [len(rows)]})

        for pdf in batches:
            for p, url, html, sha, n, ref in pdf.itertuples(index=False, name=None):
                rows.append((url_key(url), clean(p), url, html, sha, n, clean(ref)))
                size += len(html or "")
                if size >= RUN_BYTES:
                    yield flush()
                    rows, size = [], 0
        if rows:
            yield flush()

    narrow = joined.withColumns({"page_id": F.col("page_id").cast("string"), "refers_to": F.col("refers_to").cast("string")})  # longs with nulls aren't exact in pandas
    made = narrow.mapInPandas(write, "archive string, records long")
    return materialise(made, "archives").withColumn("folder", F.lit(folder))


def capture_time(page_id: int | None) -> str:
    return f"{CAPTURE_START + timedelta(seconds=page_id if page_id is not None and 0 <= page_id < 2**37 else 0):%Y%m%d%H%M%S}"


def read_archives(archives: DataFrame) -> DataFrame:
    """The index entries of all records of ``archives`` (folder, archive), verified against their digests."""

    def read(batches):
        for pdf in batches:
            for folder, archive in zip(pdf["folder"], pdf["archive"]):
                store, path = file_system(folder)
                rows = []
                with store.open_input_stream(f"{path}/{archive}", compression=None) as stream:
                    for at, size, h, payload in read_records(stream):
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if h["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"{archive}: the payload at {at} doesn't have its digest")
                        own, first = (int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", h.get(x, ""))) else None for x in ("WARC-Record-ID", "WARC-Refers-To"))
                        when = re.sub("[^0-9]", "", h["WARC-Date"])
                        rows.append((url_key(h["WARC-Target-URI"]), when, own, h["WARC-Type"], digest, int(h["X-Payload-Length"]), first, archive, at, size))
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in INDEX.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})

    spread = archives.select("folder", "archive")
    return spread.repartition(max(1, spread.count()), "archive").mapInPandas(read, INDEX)


def merge_index(entries: DataFrame, total: int) -> DataFrame:
    """Globally ordered captures: each range merges its pieces of the sorted runs (one for each archive)."""
    key = ["url_key", "capture_ts", "page_id"]
    names = [x.split()[0] for x in INDEX.split(", ")]

    def merge(batches):
        runs: dict[str, list[tuple]] = {}
        for pdf in batches:
            pdf = pdf.astype({"page_id": object, "refers_to": object}).where(pdf.notna(), None)
            for row in pdf.itertuples(index=False, name=None):
                runs.setdefault(row[7], []).append(row)
        out = []
        for row in loser_tree_merge([runs[a] for a in sorted(runs)], key=lambda r: (r[0], r[1], -1 if r[2] is None else int(r[2]))):
            out.append(row)
            if len(out) == 10_000:
                yield frame(out)
                out = []
        if out:
            yield frame(out)

    def frame(rows):
        pdf = pd.DataFrame(rows, columns=names)
        for c in ("page_id", "refers_to"):
            pdf[c] = pd.array([None if x is None else int(x) for x in pdf[c]], dtype="Int64")
        return pdf

    ranges = max(1, math.ceil(total / RANGE_ROWS))
    # the shuffle doesn't promise to keep a run's order: the pieces are put back by their place in the archive
    exact = entries.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")}).withColumn("_p", F.col("page_id").cast("long"))
    dealt = exact.repartitionByRange(ranges, "url_key", "capture_ts", "_p").drop("_p").sortWithinPartitions("archive", "offset")
    return dealt.select(names).mapInPandas(merge, INDEX)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as WARC archives, read them back and return the ordered capture index."""
    archives = write_archives(pages, min_bytes)
    total = archives.agg(F.sum("records")).first()[0] or 0
    return merge_index(materialise(read_archives(archives), "captures"), total)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_CHARS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * g + 1}, 5))::BIGINT >> {15 - 5 * i}) & 31)::INTEGER + 1, 1)" for g in range(8) for i in range(4)
)
SPARK = {"op5_warc": op5_warc}
SQL = {
    "op5_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes, {_CHARS} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN g ON p.html = g.html"""
}
