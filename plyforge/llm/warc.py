"""WARC archives of page captures, and their transactions put together again.

Each capture is three records: a response (or a revisit of one with the same
payload), the request and metadata, which name the response in
WARC-Concurrent-To. Files are written by the tasks that hold the pages, one
gzip member a record, and read as streams. The assembly joins the records by
the concurrent-to identifiers and gives one nested row a capture.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import batches_of, join_by_key, materialize, open_fs, runs

DATE = "2024-01-01T00:00:00Z"
TYPES = ("response", "revisit", "request", "metadata")


def record_id(kind: str, name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{name}')}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    packed = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packed.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packed.flush()


def one_line(text: str | None) -> str:
    """A header value: line ends would end the header."""
    return " ".join((text or "").split())


def capture(name: str, page: str, url: str, payload: bytes, refers: tuple[str, int] | None) -> list[bytes]:
    """The records of one capture. name: unique; refers: the original's record and page, for a revisit."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    host = url.split("/")[2] if url.count("/") > 1 else ""
    common = [("WARC-Target-URI", url), ("WARC-Date", DATE)]
    kind = "response" if refers is None else "revisit"
    own = record_id("response", name)
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    main = [("WARC-Type", kind), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", digest), ("X-Page-ID", page)]
    if refers is None:
        block = status + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    else:
        main += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers[0]), ("X-Refers-To-Page", str(refers[1])), ("X-Payload-Bytes", str(len(payload)))]
        block = status + b"\r\n"
    main.append(("Content-Type", "application/http; msgtype=response"))
    request = [("WARC-Type", "request"), ("WARC-Record-ID", record_id("request", name)), ("WARC-Concurrent-To", own), *common, ("Content-Type", "application/http; msgtype=request")]
    get = f"GET {'/' + '/'.join(url.split('/')[3:])} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    about = [("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", name)), ("WARC-Concurrent-To", record_id("request", name)), *common, ("Content-Type", "application/warc-fields")]
    return [record(main, block), record(request, get), record(about, f"page: {page}\r\nfetchTimeMs: 1\r\n".encode())]


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 1000, most_broadcast: int = 500_000) -> list[str]:
    """Write all pages as archives below path; returns the files' paths.

    Of pages with equal payloads of at least least_bytes, that with the
    largest key is the response and others are revisits of its record; rows
    that share the largest key are responses. A null html is an empty payload,
    a null url an empty one, a null key never the original of another; no pages
    give no files. Originals are found from keys and digests alone. Up to
    most_broadcast payloads that occur twice (counted) are broadcast to the
    pages, so that no payload is shuffled. Beyond it the most frequent ones,
    50,000 at most, still are, and other pages meet their original by a join on
    the digest, none of which many pages share.
    """
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).cast("long").alias("page"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload")).withColumn("row", F.monotonically_increasing_id())
    digest = F.when((F.col("size") >= least_bytes) & F.col("page").isNotNull(), F.sha1("payload"))
    each = rows.select(digest.alias("digest"), "page").filter("digest is not null").groupBy("digest", "page").agg(F.count("*").alias("n"))
    originals = each.groupBy("digest").agg(F.max(F.struct("page", F.col("n").alias("same"))).alias("original"), F.sum("n").alias("n"))
    originals = materialize(originals.filter("n > 1"), "originals")
    # Rows without a digest get keys of their own, so that they don't meet in one task.
    keyed = rows.withColumn("digest", F.coalesce(digest, F.concat(F.lit("-"), F.col("row"))))
    if originals.count() <= most_broadcast:
        joined = keyed.join(F.broadcast(originals.drop("n")), "digest", "left")
    else:
        hot = F.col("n") > max(1000, rows.count() // 50_000)
        often, other = F.broadcast(originals.filter(hot).drop("n")), originals.filter(~hot).drop("n")
        joined = keyed.join(often, "digest").unionByName(keyed.join(often.select("digest"), "digest", "left_anti").join(other, "digest", "left"))
    # An original has a name that its revisits know; rows that repeat it are told apart by their place.
    known = F.when(F.col("original.same") == 1, F.concat_ws(":", "original.page", "digest"))
    revisit = F.coalesce(F.col("original.page") != F.col("page"), F.lit(False))
    name = F.coalesce(F.when(~revisit, known), F.concat(F.coalesce(F.col("page").cast("string"), F.lit("none")), F.lit("-"), F.col("row")))
    joined = joined.select(name.alias("name"), "page", "url", "payload", F.when(revisit, F.col("original.page")).alias("original"), F.when(revisit, F.coalesce(known, F.lit("repeated"))).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{path}/part-{TaskContext.get().partitionId():05d}.warc.gz"
        store, to = open_fs(name)
        store.create_dir(to.rpartition("/")[0], recursive=True)
        part, n = f"{to}.{uuid.uuid4().hex[:8]}.part", 0
        with store.open_output_stream(part, compression=None) as out:
            for batch, a, z in ((x, a, z) for x in batches for a, z in runs(x.column(3))):
                for own, page, link, body, original, known_as in zip(*(c[a:z].to_pylist() for c in batch.columns), strict=True):
                    refers = None if original is None else (record_id("response", known_as), original)
                    out.write(b"".join(capture(own, "" if page is None else str(page), one_line(link), body, refers)))
                    n += 1
        if n:
            store.move(part, to)
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["file"])
        else:
            store.delete_file(part)

    with batches_of(spark, 1000):
        return sorted({r[0] for r in joined.mapInArrow(run, "file string").collect()})


def members(source) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    held, packed = b"", zlib.decompressobj(31)
    parts: list[bytes] = []
    while True:
        if not held:
            held = source.read(1 << 20)
            if not held:
                break
        parts.append(packed.decompress(held))
        held = packed.unused_data
        if packed.eof:
            yield b"".join(parts)
            parts, packed = [], zlib.decompressobj(31)
    if any(parts):
        raise ValueError("an archive ends within a record")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(headers["content-length"])
    if len(rest) < size:
        raise ValueError("a record is cut")
    return headers, rest[:size]


SCHEMA = "file string, at long, type string, id string, concurrent_to string, refers_to string, declared_page long, uri string, page_id long, declared_digest string, payload_bytes long, payload_digest string, payload binary"


def read(spark: SparkSession, files: list[str], with_payload: bool = False) -> DataFrame:
    """One row a record. Digests are of what the archive holds; a revisit's are the declared ones.

    Headers that a record lacks are null; no files give no rows; a file that
    ends within a record, or holds something else, is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, path = open_fs(file)
                with store.open_input_stream(path, compression=None) as source:
                    rows, size = [], 0
                    for at, raw in enumerate(members(source)):
                        h, block = parse(raw)
                        kind, page = h.get("warc-type"), h.get("x-page-id") or None
                        digest, n, body = None, None, None
                        if kind == "response":
                            body = block.partition(b"\r\n\r\n")[2]
                            digest, n = hashlib.sha1(body).hexdigest(), len(body)
                        elif kind == "revisit":
                            digest, n = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex(), int(h["x-payload-bytes"])
                        rows.append((file, at, kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), int(h["x-refers-to-page"]) if "x-refers-to-page" in h else None, h.get("warc-target-uri"), int(page) if page else None, h.get("warc-payload-digest"), n, digest, body if with_payload else None))
                        size += len(body or b"") if with_payload else 0
                        if len(rows) == 5000 or size > 8 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], ARROW)
                            rows, size = [], 0
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], ARROW)

    paths = spark.createDataFrame([(f,) for f in files], "file string")
    out = paths.repartition(max(1, len(files))).mapInArrow(run, SCHEMA)
    return out if with_payload else out.drop("payload")


ARROW = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in SCHEMA.split(", ")])


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each response or revisit: itself, its request and its metadata.

    A record belongs to the response that its concurrent-to identifier names,
    or to that of the record so named (metadata often names the request).
    A revisit's refers_to is a record; refers_to_page is that record's page, or
    the declared page where the archives lack the record (or have it several
    times, from repeated rows). Where several requests or metadata records name one response, the first by
    file and place is shown and n_requests and n_metadata count them; captures
    without them have nulls. Records that reach no response are left out.
    records: as read() gives them; it is used several times, so pass a written table.
    """
    parts = [c for c in records.columns if c not in ("type", "concurrent_to")]
    fields: Column = F.struct(*parts)
    main = records.filter(F.col("type").isin("response", "revisit"))
    named = records.filter(F.col("type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    step = named.select(F.col("id").alias("via"), F.col("concurrent_to").alias("onward"))
    step = step.groupBy("via").agg(F.min("onward").alias("onward"))
    rooted = named.join(step, named.concurrent_to == step.via, "left").withColumn("root", F.coalesce("onward", "concurrent_to"))

    def of(kind: str) -> Column:
        return F.min_by(F.when(F.col("type") == kind, fields), F.when(F.col("type") == kind, F.struct("file", "at")))

    side = rooted.groupBy("root").agg(of("request").alias("request"), of("metadata").alias("metadata"), F.count_if(F.col("type") == "request").alias("n_requests"), F.count_if(F.col("type") == "metadata").alias("n_metadata"))
    revisits = main.filter("refers_to is not null").select("id", "refers_to")
    named = revisits.groupBy("refers_to").agg(F.count("*").alias("n")).join(main.select(F.col("id").alias("refers_to"), F.col("page_id").alias("refers_to_page")), "refers_to")
    pages = join_by_key(revisits, named, "refers_to", "n", revisits.count()).select("id", "refers_to_page")
    main = main.join(pages, "id", "left")
    rows = main.select(F.col("id").alias("capture_id"), F.col("type").alias("record_type"), fields.alias("response"), F.coalesce("refers_to_page", "declared_page").alias("refers_to_page"))
    joined = rows.join(side, rows.capture_id == side.root, "left").drop("root")
    return joined.withColumns({"n_requests": F.coalesce("n_requests", F.lit(0)), "n_metadata": F.coalesce("n_metadata", F.lit(0))})


def captures(pages: DataFrame, path: str, **more) -> DataFrame:
    """Write pages as archives (with write()'s parameters), read them back and assemble the transactions."""
    spark = pages.sparkSession
    files = write(pages, path, **more)
    return assemble(materialize(read(spark, files), "records"))
