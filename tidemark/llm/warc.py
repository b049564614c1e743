"""Deterministic sharded WARC writer and reader.

Records are range-sorted, and each range is written by one task to files that roll over at a compressed size. Every record is a gzip member
of its own with headers and digests made anew from its payload. A task writes under temporary names that carry its attempt; the files of
the attempts that Spark accepted are listed in a draft, renamed from that list, and published by a manifest. Readers trust the manifest only,
so what a lost or repeated attempt leaves behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_batches, new_folder, spread, staged

ROLL_BYTES = 16 << 20
#: Payloads of at least so many bytes are written once and revisited after.
LEAST_BYTES = 0
#: The archives' date is a parameter: equal input gives equal files.
DATE = "2000-01-01T00:00:00Z"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder as Spark names it; a bare path is local to the machines that share it."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | None, payload_digest: str, copy: int) -> str:
    return f"<urn:page:{'none' if page is None else page}:{payload_digest}:{copy}>"


def page_of(record: str) -> int | None:
    page = record.strip("<>").split(":")[2]
    return None if page == "none" else int(page)


def _member(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))]) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


def record(page: int | None, url: str | None, payload: bytes | None, payload_digest: str, size: int, refers: int | None, copy: int,
           date: str = DATE) -> bytes:
    """One compressed record: a response with its payload, or a revisit without it that names the response."""
    uri = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{page}"
    http = _HTTP.format(size).encode()
    block = http + (payload or b"") if refers is None else http
    fields = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", record_id(page, payload_digest, copy)),
              ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
              ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response")]
    if refers is not None:
        fields += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", record_id(refers, payload_digest, 0))]
    return _member(fields, block)


def records(data: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a compressed stream, one in memory at a time; a wrong digest or length raises an error."""
    unpack, parts, begun = zlib.decompressobj(31), [], False
    for chunk in data:
        while chunk:
            begun = True
            parts.append(unpack.decompress(chunk))
            chunk = unpack.unused_data
            if unpack.eof:
                head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
                fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                block = rest[: int(fields["Content-Length"])]
                if rest[len(block) :] != b"\r\n\r\n" or fields.get("WARC-Block-Digest", "sha1:" + digest(block)) != "sha1:" + digest(block):
                    raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
                yield fields, block
                unpack, parts, begun = zlib.decompressobj(31), [], False
            else:
                break
    if begun:
        raise ValueError("the archive ends within a record")


def _with_revisits(pages: DataFrame, page_id: str, url: str, payload: str, least_bytes: int) -> DataFrame:
    """Rows page_id, url, payload (null for revisits), sum, size, refers."""
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("sum"), F.octet_length("payload").cast("bigint").alias("size"))
    firsts = rows.where(F.col("size") >= least_bytes).groupBy("sum").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    # written first, so that the join is planned by its size: payloads are dealt by it only where repeated ones are many
    repeated = staged(firsts.where("n > 1").drop("n"), "warc-repeated")
    refers = F.when(F.coalesce("page_id", F.lit(-(1 << 63))) < F.col("first"), F.col("first"))
    found = rows.join(repeated, "sum", "left").withColumn("refers", refers)
    return found.select("page_id", "url", F.when(F.col("refers").isNull(), F.col("payload")).alias("payload"), F.sha1("payload").alias("sha1"),
                        "size", "refers")


def write_archives(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", payload: str = "html",
                   roll_bytes: int = ROLL_BYTES, least_bytes: int = LEAST_BYTES, date: str = DATE) -> DataFrame:
    """Write one record per row and return the manifest: path, shard, roll, records, bytes, sha256.

    Of equal payloads of `least_bytes` or more, the rows with the largest page_id are responses and the others revisits of it; smaller
    payloads are all responses. Rows that repeat that page_id are all responses. A null payload is empty, a null url is named after its
    page, a null page_id sorts first and is written as `none`. Other columns are ignored. An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    order = ["page_id", "sha1"]
    rows = _with_revisits(pages, page_id, url, payload, least_bytes)
    dealt = rows.repartitionByRange(spread(spark), *order).sortWithinPartitions(*order)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, attempt = task.partitionId(), task.taskAttemptId()
        files, root = store(folder)
        files.create_dir(f"{root}/tmp", recursive=True)
        out, done, last, copy = None, [], None, 0

        def close() -> None:
            out.close()
            done.append((shard, roll, temp, name, count, size, check.hexdigest()))

        roll = -1
        for batch in batches:
            for page, url_, payload_, sha1, length, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    roll += 1
                    name = f"{shard:06d}-{roll:06d}.warc.gz"
                    temp = f"tmp/{name}.{attempt}"
                    out, check, count, size = files.open_output_stream(f"{root}/{temp}", compression=None), hashlib.sha256(), 0, 0
                    info = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{name}>"), ("WARC-Date", date),
                                    ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    check.update(info)
                    size += len(info)
                b32 = base64.b32encode(bytes.fromhex(sha1)).decode()
                copy = copy + 1 if last == (page, sha1) else 0
                last = (page, sha1)
                data = record(page, url_, payload_, b32, length, refers, copy, date)
                out.write(data)
                check.update(data)
                count, size = count + 1, size + len(data)
                if size >= roll_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["shard", "roll", "temp", "name", "records", "bytes", "sha256"])

    schema = "shard bigint, roll bigint, temp string, name string, records bigint, bytes bigint, sha256 string"
    draft = staged(in_batches(dealt, write, schema), "warc-draft")

    def commit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                there = files.get_file_info(f"{root}/{row['name']}")
                if not (there.is_file and there.size == row["bytes"]):  # else an earlier attempt of this task has renamed it
                    files.move(f"{root}/{row['temp']}", f"{root}/{row['name']}")
            yield batch

    named = draft.repartition(min(spread(spark), 32)).mapInArrow(commit, schema)
    path = F.concat(F.lit(folder + "/"), F.col("name"))
    return staged(named.select(path.alias("path"), "shard", "roll", "records", "bytes", "sha256"), "warc-manifest")


_ROWS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()),
                   ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def read_archives(manifest: DataFrame, batch_bytes: int = 8 << 20) -> DataFrame:
    """Records of the files that a manifest lists: page_id, url, record_type, payload (null for revisits), payload_bytes, payload_digest,
    refers_to.

    Digests and lengths of responses are computed from what was read and held against their headers; those of revisits are the full
    payload's, from the revisit's HTTP and WARC headers. A file that differs from its manifest row, or a damaged record, is an error.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, want in ((p, w) for b in batches for p, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            files, at = store(path)
            rows, held, check = [], 0, hashlib.sha256()

            def chunks(stream) -> Iterator[bytes]:
                while data := stream.read(1 << 20):
                    check.update(data)
                    yield data

            with files.open_input_stream(at, compression=None) as stream:
                for fields, block in records(chunks(stream)):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.decode().rpartition("Content-Length: ")[2])
                    given = fields["WARC-Payload-Digest"].partition(":")[2]
                    refers = fields.get("WARC-Refers-To")
                    if refers is None and (size, given) != (len(payload), digest(payload)):
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its headers")
                    rows.append((page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"],
                                 payload if refers is None else None, size, given, page_of(refers) if refers else None))
                    held += len(block)
                    if held >= batch_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROWS)], schema=_ROWS)
                        rows, held = [], 0
            if check.hexdigest() != want:
                raise ValueError(f"{path} differs from its manifest")
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROWS)], schema=_ROWS)

    files = manifest.select("path", "sha256").repartition(spread(manifest.sparkSession))
    return files.mapInArrow(read, "page_id bigint, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, "
                                  "refers_to bigint")
