"""WARC archives: a writer, and a splittable reader.

write_archives() gives each task a file of gzip members, one per record, moved to its name once it is whole.
Of records with equal payloads of at least `revisit_bytes` the one with the largest page_id is a response, the
others revisit it. read_archives() cuts files into byte ranges. The task of a range looks for gzip's magic
bytes, accepts a place only if a WARC header can be decoded there, reads on member by member, and owns the
records that start inside its range, wherever they end.

Cases: a null html is an empty payload; a null url is left out; rows that repeat the largest page_id with the
same payload are responses all; a null page_id counts as smaller than any and is read back as null; an empty
table gives no records. Columns other than page_id, url and html are not read. A damaged archive is an error, never a
result with records missing: behind each record there must be another one's start or the file's end.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import new_path, partitions, slices, small_batches, written

#: Payloads under this size are stored each time.
REVISIT_BYTES = 1000
#: Bytes of an archive that a reading task owns.
SPLIT_BYTES = 8_000_000
_MAGIC = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _file(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append(f"WARC-Target-URI: {url.replace('\r', '%0D').replace('\n', '%0A')}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def write_archives(pages: DataFrame, folder: str | None = None, revisit_bytes: int = REVISIT_BYTES) -> list[tuple[str, int]]:
    """Writes the archives and returns their paths and sizes. folder: a URI that all executors reach; else one in the shared folder."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or new_path(spark, "warc")
    if "://" not in folder:
        folder = f"file://{folder}" if folder.startswith("/") else folder
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    keyed = rows.where(F.octet_length("html") >= revisit_bytes).select("page_id", "digest")
    # Written, so that the join has a plain shuffle on both sides and the engine cuts a hot digest; a small table is broadcast by its size.
    keepers = written(keyed.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1"), "warc-keepers")
    revisits = keyed.join(keepers, "digest").where("not page_id <=> keeper").groupBy("page_id", "digest").agg(F.max("keeper").alias("refers_to"))
    r = revisits.select(F.col("page_id").alias("r_page_id"), F.col("digest").alias("r_digest"), "refers_to")
    joined = rows.join(r, F.col("page_id").eqNullSafe(F.col("r_page_id")) & (F.col("digest") == F.col("r_digest")), "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _file(folder)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}.warc.gz"
        path, temporary, out, size = posixpath.join(base, name), posixpath.join(base, f".{name}.{context.taskAttemptId()}"), None, 0
        for batch in slices(batches, "html"):
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(temporary, compression=None)
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                member = _member(_record(page_id, url, html.encode(), refers_to))
                out.write(member)
                size += len(member)
        if out is not None:
            out.close()
            fs.move(temporary, path)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": pa.array([size], pa.int64())})

    return [(x["path"], x["bytes"]) for x in joined.mapInArrow(run, "path string, bytes long").collect()]


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}


def _starts_record(data: bytes, at: int) -> bool:
    """Whether a gzip member starts here and its first bytes decode to a WARC header."""
    try:
        return zlib.decompressobj(31).decompress(data[at : at + 4096], 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _records(fs: pafs.FileSystem, path: str, start: int, end: int) -> Iterator[bytes]:
    """The decoded members that start in [start, end). ValueError where a member is cut short, or something else than a member follows it."""
    own, at, after = end - start, 0, start == 0
    with fs.open_input_file(path) as f:
        f.seek(start)
        data = f.read(own + len(_MAGIC) - 1)
        while True:
            if not after:  # the range may begin inside a member of the range before
                at = data.find(_MAGIC, at)
                if not 0 <= at < own:
                    return
            f.seek(start + len(data))
            while len(data) - at < 4096 and (got := f.read(1 << 16)):
                data += got
            if not _starts_record(data, at):
                if after and at < len(data):
                    raise ValueError(f"{path}: no record at byte {start + at}, where one must begin")
                if after:
                    return
                at += 1
                continue
            if at >= own:
                return
            packer, out, fed = zlib.decompressobj(31), [], at
            try:
                while not packer.eof:
                    piece = data[fed : fed + (1 << 16)] or f.read(1 << 16)
                    if not piece:
                        raise zlib.error("the file ends inside it")
                    out.append(packer.decompress(piece))
                    fed += len(piece)
            except zlib.error as e:
                raise ValueError(f"{path}: the record at byte {start + at} is damaged: {e}") from e
            at, after = fed - len(packer.unused_data), True
            if at > len(data):  # the end lies beyond what is held
                f.seek(start + at)
                data, start, own = f.read(4096), start + at, own - at
                at = 0
            yield b"".join(out)


def read_archives(spark: SparkSession, files: list[tuple[str, int]], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A row per record: page_id, url, record_type, refers_to, payload (null for revisits), payload_bytes, payload_digest (lower-case hex SHA-1 of the full payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string()}
        out: dict[str, list] = {k: [] for k in types}
        held = 0
        for batch in batches:
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end")), strict=True):
                fs, name = _file(path)
                for raw in _records(fs, name, start, end):
                    head, _, block = raw.partition(b"\r\n\r\n")
                    h = _headers(head)
                    http, _, payload = block[: int(h["content-length"])].partition(b"\r\n\r\n")
                    kind, digest = h["warc-type"], base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if kind == "response":
                        if hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{path}: a payload differs from its digest")
                        size = len(payload)
                    else:
                        payload, size = None, int(_headers(http)["content-length"])
                    ids = [int(x[10:-1]) if x and x[10:-1] else None for x in (h["warc-record-id"], h.get("warc-refers-to"))]
                    for k, v in zip(types, (ids[0], h.get("warc-target-uri"), kind, ids[1], payload, size, digest), strict=True):
                        out[k].append(v)
                    held += size
                    if held > 4_000_000 or len(out["url"]) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in types.items()], list(types))
                        out, held = {k: [] for k in types}, 0
        if out["url"]:
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in types.items()], list(types))

    schema = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
    ranges = [(p, a, min(a + split_bytes, size)) for p, size in files for a in range(0, size, split_bytes)]
    if not ranges:
        return spark.createDataFrame([], schema)
    small_batches(spark)
    table = spark.createDataFrame(spark.sparkContext.parallelize(ranges, min(len(ranges), max(partitions(spark), 8 * spark.sparkContext.defaultParallelism))), "path string, start long, end long")
    return table.mapInArrow(run, schema)
