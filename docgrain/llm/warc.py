"""WARC archives: written as monolithic gzip, normalised to one member a record with a sidecar index, read back.

Files are written by tasks under names that hold the attempt, and count only if the manifest, which Spark commits,
lists them; so a task can be run again after its executor is lost. Files are reached by ``pyarrow.fs``.

Each file begins with a warcinfo record. Record ids are uuids by page_id and payload; rows that repeat both get their
place in the files as well. Extension fields hold page ids, and tell URIs whose bytes can't stand in a header line.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, new_dir, written

CHUNK = 1 << 20
MEMBER = 31  # zlib's window bits for a gzip member
DATE = "2000-01-01T00:00:00Z"
MANIFEST = "path string, index_path string, n_records long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


#: What can't stand in a header line; such URIs are escaped whole, others are kept as they are.
_NO_HEADER = re.compile(r"[\x00-\x20\x7f-\x9f\u2028\u2029]")
_ESCAPED = re.compile(r"[\x00-\x20\x7f-\x9f\u2028\u2029%]")


def record_id(page_id: int | None, payload_digest: str, place: str = "") -> str:
    """place: tells records apart that are equal otherwise."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {payload_digest} {place}').urn}>"


def _uri_fields(name: str, url: str | None) -> list[str]:
    if url is None:
        return []
    if not _NO_HEADER.search(url):
        return [f"{name}: {url}"]
    return [f"{name}: {_ESCAPED.sub(lambda m: ''.join(f'%{b:02X}' for b in m[0].encode()), url)}", f"X-Escaped: {name}"]


def _bytes(head: list[str], block: bytes) -> bytes:
    return "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warcinfo(name: str, date: str = DATE) -> bytes:
    """The record that a file begins with."""
    block = b"software: docgrain\r\nformat: WARC File Format 1.1\r\n"
    return _bytes(["WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(None, name)}", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], block)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, refers_url: str | None = None, refers_known: bool = True, place: str = "", date: str = DATE) -> bytes:
    """One record. A revisit holds the HTTP head of its payload and names the record that holds the payload.

    refers_known: one record alone has that page and payload, so its id is known.
    """
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind, said = "response" if refers_to is None else "revisit", digest(payload)
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, said, place)}", f"WARC-Date: {date}"]
    head += _uri_fields("WARC-Target-URI", url)
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{said}")
    if refers_to is None:
        block += payload
    else:
        if refers_known:
            head.append(f"WARC-Refers-To: {record_id(refers_to, said)}")
        head += [*_uri_fields("WARC-Refers-To-Target-URI", refers_url), f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-ID: {refers_to}"]
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return _bytes([*head, "Content-Type: application/http; msgtype=response"], block)


def fields(head: bytes) -> dict[str, str]:
    """Named fields of a record's or an HTTP head, names in lower case; X-Escaped fields have undone their escapes."""
    pairs = [(k.lower(), v) for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])]
    out = dict(pairs)
    for k, name in pairs:
        if k == "x-escaped":
            out[name.lower()] = re.sub(r"(?:%[0-9A-F]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode(), out[name.lower()])
    return out


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC fields, HTTP head and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    named = fields(head)
    http, _, payload = rest[: int(named["content-length"])].partition(b"\r\n\r\n")
    return named, http, payload


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream; holds one record and a chunk at a time."""
    held = bytearray()
    need = 0
    for chunk in chunks:
        held += chunk
        while True:
            if not need:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(fields(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError(f"{len(held)} bytes after the last whole record")


def inflated(stream) -> Iterator[bytes]:
    """The contents of a gzip file of one or more members, read once from start to end."""
    unzip = zlib.decompressobj(MEMBER)
    while data := stream.read(CHUNK):
        while data:
            out = unzip.decompress(data, CHUNK)
            if out:
                yield out
            if unzip.eof:
                data, unzip = unzip.unused_data, zlib.decompressobj(MEMBER)
            else:
                data = unzip.unconsumed_tail
    if rest := unzip.flush():
        yield rest


def _files(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _manifest(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"path": [r[0] for r in rows], "index_path": [r[1] for r in rows], "n_records": [r[2] for r in rows]}, pa.schema([("path", pa.string()), ("index_path", pa.string()), ("n_records", pa.int64())]))


def write_monolithic(records: DataFrame, out_dir: str, file_bytes: int = 1 << 28) -> DataFrame:
    """``records`` of with_revisits() as gzip WARC files of one stream each, of about ``file_bytes`` of
    records; returns the manifest, written. Nulls: an html is empty, a refers_to makes a response, other fields stay out.
    Row order, repeated rows and very long htmls stay; no rows give no file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _files(out_dir)
        task = TaskContext.get()
        rows, out, zipper, size, count = [], None, None, 0, 0

        def finish() -> None:
            out.write(zipper.flush())
            out.close()
            rows.append((f"{out_dir}/{name}", None, count))

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, refers_to, refers_url, refers_known, repeated = (c[i].as_py() for c in batch.columns)
                if out is None:
                    name = f"mono-{task.partitionId():06d}-{task.taskAttemptId()}-{len(rows)}.warc.gz"
                    where.create_dir(base, recursive=True)
                    out, zipper, size, count = where.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, MEMBER), 0, 1
                    out.write(zipper.compress(warcinfo(name)))
                place = f"{task.partitionId()} {len(rows)} {count}" if repeated or page_id is None else ""
                raw = record(page_id, url, (html or "").encode(), refers_to, refers_url, bool(refers_known), place)
                out.write(zipper.compress(raw))
                size, count = size + len(raw), count + 1
                if size >= file_bytes:
                    finish()
                    out = None
        if out is not None:
            finish()
        yield _manifest(rows)

    return written(map_arrow(records.select("page_id", "url", "html", "refers_to", "refers_url", "refers_known", "repeated"), write, MANIFEST), "warc-manifest")


def normalise(manifest: DataFrame, out_dir: str, level: int = 6) -> DataFrame:
    """Each file of the manifest, inflated once, with every record as its own gzip member, and beside it an index of
    lines ``offset length record-id``; returns the new manifest, written."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _files(out_dir)
        task = TaskContext.get()
        rows = []
        for batch in batches:
            for path in batch.column(batch.schema.get_field_index("path")).to_pylist():
                source, place = _files(path)
                name = f"{place.rpartition('/')[2].removesuffix('.warc.gz')}-{task.taskAttemptId()}"
                where.create_dir(base, recursive=True)
                at = n = 0
                with source.open_input_stream(place, compression=None) as stream, where.open_output_stream(f"{base}/{name}.warc.gz", compression=None) as out, where.open_output_stream(f"{base}/{name}.idx", compression=None) as index:
                    for raw in split_records(inflated(stream)):
                        zipper = zlib.compressobj(level, zlib.DEFLATED, MEMBER)
                        member = zipper.compress(raw) + zipper.flush()
                        out.write(member)
                        index.write(f"{at} {len(member)} {fields(raw.partition(b'\r\n\r\n')[0])['warc-record-id']}\n".encode())
                        at, n = at + len(member), n + 1
                rows.append((f"{out_dir}/{name}.warc.gz", f"{out_dir}/{name}.idx", n))
        yield _manifest(rows)

    return written(map_arrow(_one_file_a_task(manifest), rewrite, MANIFEST), "warc-manifest")


def _one_file_a_task(manifest: DataFrame) -> DataFrame:
    return manifest.repartition(max(1, min(manifest.count(), 10_000)))


def read_archives(manifest: DataFrame, payload: bool = False) -> DataFrame:
    """Every record that the indexes of normalised files list, read by its offset. A response's digest is checked
    against its payload; a revisit's size is that of its HTTP head. With ``payload`` comes a column of that name."""

    def number(said: str | None) -> int | None:
        return None if said is None else int(said)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + ([("payload", pa.binary())] if payload else []))
        for batch in batches:
            for path, index_path in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("path", "index_path"))):
                where, place = _files(path)
                with where.open_input_stream(_files(index_path)[1], compression=None) as index, where.open_input_file(place) as archive:
                    rows, held = [], 0
                    for line in index.read().decode().splitlines():
                        offset, length, _ = line.split(" ", 2)
                        archive.seek(int(offset))
                        named, http, body = parse(zlib.decompress(archive.read(int(length)), MEMBER))
                        if named["warc-type"] == "warcinfo":
                            continue
                        said = named["warc-payload-digest"].removeprefix("sha1:")
                        revisit = named["warc-type"] == "revisit"
                        if not revisit and digest(body) != said:
                            raise ValueError(f"{path} at {offset}: the payload doesn't have its digest")
                        rows.append((number(named.get("x-page-id")), named.get("warc-target-uri"), int(fields(http)["content-length"]), said, named["warc-type"], number(named.get("x-refers-to-page-id")), *([None if revisit else body] if payload else [])))
                        held += len(body) if payload else 100
                        if held > CHUNK * 4:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return map_arrow(_one_file_a_task(manifest), read, RECORDS + (", payload binary" if payload else ""))


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url and html of ``pages`` with ``refers_to``: the smallest page_id of an equal payload of at least
    ``least_bytes``, null for that page itself, for smaller payloads and for null page_ids. refers_url is that page's
    (the smallest), refers_known whether it has one row alone, repeated whether the row's page and payload have several.

    Digests alone are shuffled, after counting by page and digest on the map side; what is said of revisits and repeated
    rows, a written table, is broadcast if the planner finds it small. Else rows are joined by page and digest, which
    shuffles them once and evenly.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("__digest"))
    same = keyed.where("page_id IS NOT NULL").groupBy("__digest", "page_id").agg(F.min("url").alias("url"), F.count("*").alias("n"), F.first(F.octet_length("html") >= least_bytes).alias("counts"))
    same = written(same, "payloads")
    firsts = same.where("counts").groupBy("__digest").agg(F.min(F.struct("page_id", "url", "n")).alias("to"), F.count("*").alias("pages")).where("pages > 1").drop("pages")
    later = F.col("page_id") > F.col("to.page_id")
    said = same.join(written(firsts, "firsts"), "__digest", "left").select("__digest", "page_id", F.when(later, F.col("to.page_id")).alias("refers_to"), F.when(later, F.col("to.url")).alias("refers_url"), F.when(later, F.col("to.n") == 1).alias("refers_known"), (F.col("n") > 1).alias("repeated"))
    said = written(said.where("refers_to IS NOT NULL OR repeated"), "revisits")
    return keyed.join(said, ["page_id", "__digest"], "left").drop("__digest")


def round_trip(pages: DataFrame, least_bytes: int = 0, payload: bool = False) -> DataFrame:
    """A record for every row of ``pages`` (page_id, url, html), written, normalised and read back.

    Null html is an empty payload. Repeated rows are records each; those with the smallest page_id of their payload
    are all responses. Null page_ids are responses and come back null. Other columns are not read. No pages: no rows.
    """
    spark = pages.sparkSession
    first = new_dir(spark, "warc-mono")
    manifest = write_monolithic(with_revisits(pages, least_bytes), first)
    final = normalise(manifest, new_dir(spark, "warc"))
    where, place = _files(first)
    if where.get_file_info(place).type != fs.FileType.NotFound:
        where.delete_dir(place)
    return read_archives(final, payload)
