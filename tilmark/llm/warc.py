"""WARC archives of pages: written by tasks, read back as a chunked record table.

Writing. Pages of equal payloads (the html in UTF-8) share one digest. Of each such group the page with the smallest id is a response record, the
others are revisit records that name it and carry no payload. Groups are counted on narrow rows (id, address, digest), and only those of more than one page are joined to the pages: broadcast
if they are few, else by a shuffle, in which digests that very many pages share stay broadcast. So the payloads are not shuffled unless repeats are very many. Each task
writes archives of its own, one gzip member a record, and hands on only a manifest: ranges of about RANGE_BYTES that begin and end between records. Files have names
that no other attempt uses, so what a lost or repeated task left is never read.

Reading. A range of a file is a row that any task can take. A payload is read in chunks of CHUNK_BYTES, and each is a row (record, chunk, bytes so far, and on the last one the
digest), with one running SHA-1 carried from chunk to chunk; no record is ever whole in memory, however large. A digest or length that differs from the
record's header is an error. Archives of others, with or without gzip, are read the same way, a file to a row.

Defined cases: a null html is an empty payload, an empty one too; ids order as numbers, null ids come last, and a revisit of a page without id refers to null; rows equal in id, payload and
address are interchangeable: one of them is the response; among equal ids that of the smaller address (null last) is; repeated rows are records each; payloads under `least` bytes are all responses; an
empty table gives no archive and an empty result; extra columns are ignored, whatever their names; addresses with line breaks are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilmark.llm.runtime import dropped_folder, shared_dir, written

CHUNK_BYTES = 1 << 20
RANGE_BYTES = 32_000_000
FILE_BYTES = 1_000_000_000
#: So many groups of equal payloads are broadcast at most.
BROADCAST_GROUPS = 200_000
#: Copies that one task makes of a row at a time.
RUN = 10_000
#: Tasks that read ranges, where there are so many.
MOST_TASKS = 50_000
RESPONSE, REVISIT = "response", "revisit"
#: Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
RECORDS = "page_id string, record_type string, refers_to string, url string, chunk int, content binary, so_far long, final boolean, payload_bytes long, payload_digest string"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def opened(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


# --- which record is which


def keyed(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, payload, n, digest in hex) of pages."""
    raw = F.coalesce(F.col(html), F.lit("")).cast("binary")
    named = pages.select(F.col(key).alias("id"), F.col(url).cast("string").alias("url"), raw.alias("payload"))
    return named.select("*", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("digest"))


def _place(id_: Column | str, url: Column | str) -> Column:
    """What orders pages of one payload."""
    i, u = (F.col(c) if isinstance(c, str) else c for c in (id_, url))
    return F.struct(i.isNull().alias("no_id"), i.alias("id"), u.isNull().alias("no_url"), u.alias("url"))


def decided(pages: DataFrame, least: int = 0, broadcast: int = BROADCAST_GROUPS) -> DataFrame:
    """keyed pages with record_type and refers_to."""
    rows = pages.filter(F.col("n") >= least).groupBy("digest", "n", "id", "url").agg(F.count("*").alias("rows"))
    groups = rows.groupBy("digest", "n").agg(F.min(F.struct(_place("id", "url").alias("place"), "rows")).alias("first"), F.sum("rows").alias("members"))
    many = groups.filter("members > 1").select(F.col("digest").alias("of"), F.col("n").alias("of_n"), F.col("first.place").alias("first"), F.col("first.rows").alias("firsts"), "members")
    repeated = written(many, "repeats")
    found, members = repeated.agg(F.count("*"), F.sum("members")).head()
    same = (F.col("digest") == F.col("of")) & (F.col("n") == F.col("of_n"))
    if found <= broadcast:
        joined = pages.join(F.broadcast(repeated), same, "left")
    else:  # more members than an even share: at most `broadcast` groups
        hot = F.col("members") > members // broadcast
        joined = pages.join(F.broadcast(repeated.filter(hot)), same, "left")
        rest = repeated.filter(~hot).select(*[F.col(c).alias(f"rest_{c}") for c in repeated.columns])
        joined = joined.join(rest, F.col("of").isNull() & (F.col("digest") == F.col("rest_of")) & (F.col("n") == F.col("rest_of_n")), "left")
        joined = joined.select(*pages.columns, *[F.coalesce(c, f"rest_{c}").alias(c) for c in ("first", "firsts")])
    is_first = F.col("first").isNotNull() & F.col("first.id").eqNullSafe(F.col("id")) & F.col("first.url").eqNullSafe(F.col("url"))
    kind = F.when(F.col("first").isNull() | (is_first & (F.col("firsts") == 1)), RESPONSE).otherwise(REVISIT)
    refers = F.when(kind == REVISIT, F.col("first.id"))
    columns = ["id", "url", "payload", "n", "digest", "record_type", "refers_to"]
    alone = joined.filter(~(is_first & (F.col("firsts") > 1))).select("id", "url", F.when(kind == RESPONSE, F.col("payload")).alias("payload"), "n", "digest", kind.alias("record_type"), refers.alias("refers_to"))
    if not repeated.filter("firsts > 1").limit(1).count():
        return alone
    # rows that nothing tells apart: one response for them all, and revisits that need no payload, dealt out in runs
    equal = joined.filter(is_first & (F.col("firsts") > 1)).groupBy("id", "url", "digest", "n").agg(F.first("payload").alias("payload"), F.count("*").alias("rows"))
    one = equal.select("id", "url", "payload", "n", "digest", F.lit(RESPONSE).alias("record_type"), F.lit(None).cast(pages.schema["id"].dataType).alias("refers_to"))
    copies = equal.select("id", "url", "n", "digest", "rows", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("rows") - 2).cast("long"), F.lit(RUN).cast("long"))).alias("begin")).filter("rows > 1")
    runs = copies.repartition("id", "begin").select("*", F.explode(F.sequence(F.col("begin"), F.least(F.col("begin") + RUN - 1, F.col("rows") - 2))).alias("copy"))
    again = runs.select("id", "url", F.lit(None).cast("binary").alias("payload"), "n", "digest", F.lit(REVISIT).alias("record_type"), F.col("id").alias("refers_to"))
    return alone.unionByName(one).unionByName(again).select(*columns)


# --- writing


def _address(url: str | None) -> str:
    return (url or "urn:none").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if url is None or any(c in url for c in "\r\n") else url


def header(kind: str, page: object, url: str | None, n: int, sha1: str, refers_to: object, block: int) -> bytes:
    """A record's header. The page's id is a field of its own, as record ids must differ even between repeated rows."""
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _address(url)),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(bytes.fromhex(sha1))}"),
        ("Payload-Length", str(n)),
        *([("Page-ID", str(page))] if page is not None else []),
        *([("WARC-Profile", PROFILE)] if kind == REVISIT else []),
        *([("Refers-To-Page-ID", str(refers_to))] if refers_to is not None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(block)),
    ]
    return "".join([f"{VERSION}\r\n", *[f"{k}: {v}\r\n" for k, v in fields], "\r\n"]).encode()


def http_head(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def write_record(out: BinaryIO, head: bytes, parts: Iterator[bytes | memoryview] | tuple, level: int = 6) -> int:
    """One gzip member; bytes written."""
    pack, size = zlib.compressobj(level, zlib.DEFLATED, 31), 0
    for part in (head, *parts, END):
        size += out.write(pack.compress(part))
    return size + out.write(pack.flush())


def write_archives(records: DataFrame, folder: str, span: int = RANGE_BYTES, most: int = FILE_BYTES) -> DataFrame:
    """decided() records as archives in a folder that all executors see; returns the manifest (file, begin, end), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, name, at, begin, ranges = None, "", 0, 0, []
        system, base = opened(folder)
        for batch in batches:
            ids, urls, payloads, sizes, digests, kinds, refers = (batch.column(i) for i in range(7))
            for i in range(len(batch)):
                if file is None:
                    name, at, begin = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    system.create_dir(base, recursive=True)
                    file = system.open_output_stream(f"{base}/{name}", compression=None)
                kind, n = kinds[i].as_py(), sizes[i].as_py()
                body = payloads[i].as_buffer() if kind == RESPONSE else None
                view = memoryview(body) if body is not None else memoryview(b"")
                http = http_head(n)
                head = header(kind, ids[i].as_py(), urls[i].as_py(), n, digests[i].as_py(), refers[i].as_py(), len(http) + len(view))
                at += write_record(file, head, (http, *(view[p : p + CHUNK_BYTES] for p in range(0, len(view), CHUNK_BYTES))))
                if at - begin >= span:
                    ranges.append((name, begin, at))
                    begin = at
                if at >= most:
                    file = file.close()
                    ranges += [(name, begin, at)] if at > begin else []
                    begin = at
            # a range is handed on when its file is whole
            if file is None and ranges:
                yield _manifest(folder, ranges)
                ranges = []
        if file is not None:
            file.close()
            ranges += [(name, begin, at)] if at > begin else []
        if ranges:
            yield _manifest(folder, ranges)

    ordered = records.select("id", "url", "payload", "n", "digest", "record_type", "refers_to")
    return written(ordered.mapInArrow(run, "file string, begin long, end long"), "manifest")


def _manifest(folder: str, ranges: list[tuple[str, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"file": [f"{folder}/{r[0]}" for r in ranges], "begin": pa.array([r[1] for r in ranges], pa.int64()), "end": pa.array([r[2] for r in ranges], pa.int64())})


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows for the archives (.warc, .warc.gz) of a folder that have no manifest. Listed are names only."""
    system, base = opened(folder)
    scheme = folder.split("://")[0] + "://" if "://" in folder else ""
    found = sorted(f.path for f in system.get_file_info(FileSelector(base)) if f.path.endswith((".warc", ".warc.gz")))
    rows = spark.createDataFrame([(scheme + f, 0, None) for f in found], "file string, begin long, end long")
    return rows.repartition(max(1, len(found)))


# --- reading


class Source:
    """The bytes of a range of an archive, plain or of gzip members, read piece by piece."""

    def __init__(self, file: BinaryIO, begin: int, end: int | None, piece: int = 1 << 16):
        self.file, self.end, self.at, self.piece = file, end, begin, piece
        file.seek(begin)
        self.raw, self.ready = b"", b""
        self._fill()
        self.zip = zlib.decompressobj(31) if self.raw[:2] == b"\x1f\x8b" else None

    def _fill(self) -> bool:
        want = self.piece if self.end is None else min(self.piece, self.end - self.at)
        more = self.file.read(want) if want > 0 else b""
        self.at += len(more)
        self.raw += more
        return bool(more)

    def _more(self) -> bool:
        """Some more decoded bytes, at most about 16 pieces."""
        while True:
            if not self.raw and not self._fill():
                if self.zip is not None and not self.zip.eof and getattr(self, "inside", False):
                    raise ValueError("the archive breaks off")
                return False
            if self.zip is None:
                self.ready, self.raw = self.ready + self.raw, b""
                return True
            if self.zip.eof:
                self.zip = zlib.decompressobj(31)
            got = self.zip.decompress(self.raw, 16 * self.piece)
            self.raw = self.zip.unused_data if self.zip.eof else self.zip.unconsumed_tail
            self.inside = not self.zip.eof
            if got:
                self.ready += got
                return True

    def line(self) -> bytes | None:
        """Up to a line end, without it; None at the end."""
        while (cut := self.ready.find(b"\n")) < 0:
            if not self._more():
                if self.ready:
                    raise ValueError("the archive breaks off in a header")
                return None
        out, self.ready = self.ready[:cut], self.ready[cut + 1 :]
        return out.rstrip(b"\r")

    def take(self, n: int) -> bytes:
        """n bytes."""
        parts, missing = [], n
        while missing:
            if not self.ready and not self._more():
                raise ValueError("the archive breaks off in a block")
            part, self.ready = self.ready[:missing], self.ready[missing:]
            parts.append(part)
            missing -= len(part)
        return b"".join(parts)

    def heading(self) -> tuple[str, dict[str, str]] | None:
        """The next record's version line and fields, by lower-case names; None at the end."""
        first = self.line()
        while first == b"":
            first = self.line()
        if first is None:
            return None
        fields: dict[str, str] = {}
        last = ""
        while line := self.line():
            if line[:1] in b" \t" and last:
                fields[last] += " " + line.strip().decode("utf-8", "replace")
                continue
            name, _, value = line.partition(b":")
            last = name.strip().lower().decode("utf-8", "replace")
            fields[last] = value.strip().decode("utf-8", "replace")
        return first.decode("utf-8", "replace"), fields


def _http_head(source: Source, left: int) -> int:
    """Reads an HTTP head of a block with `left` bytes; what is left after it."""
    while left > 0:
        line, before = b"", left
        while left > 0:
            c = source.take(1)
            left -= 1
            line += c
            if c == b"\n":
                break
        if not line.strip() or before == left:
            break
    return left


def records(source: Source, chunk: int = CHUNK_BYTES, content: bool = True) -> Iterator[dict]:
    """The rows of the chunked record table of a source, in order. Records of other types than response, revisit and resource are passed over."""
    while (found := source.heading()) is not None:
        version, fields = found
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record: {version[:40]!r}")
        left, kind = int(fields["content-length"]), fields.get("warc-type", "")
        plain = {"page_id": fields.get("page-id"), "record_type": kind, "refers_to": fields.get("refers-to-page-id"), "url": fields.get("warc-target-uri")}
        if kind not in (RESPONSE, REVISIT, "resource"):
            while left:
                left -= len(source.take(min(chunk, left)))
            continue
        if fields.get("content-type", "").startswith("application/http"):
            left = _http_head(source, left)
        named = fields.get("warc-payload-digest", "").rpartition(":")[2].upper() if fields.get("warc-payload-digest", "").lower().startswith("sha1:") else None
        if kind == REVISIT:
            while left:
                left -= len(source.take(min(chunk, left)))
            n = fields.get("payload-length")
            yield plain | {"chunk": 0, "content": None, "so_far": 0, "final": True, "payload_bytes": int(n) if n else None, "payload_digest": named}
            continue
        running, so_far, number = hashlib.sha1(), 0, 0
        while True:
            data = source.take(min(chunk, left))
            left -= len(data)
            running.update(data)
            so_far += len(data)
            final = left == 0
            digest = base32_sha1(running.digest()) if final else None
            if final and named is not None and digest != named:
                raise ValueError(f"payload digest of page {plain['page_id']} differs: {digest}, its header says {named}")
            yield plain | {"chunk": number, "content": data if content else None, "so_far": so_far, "final": final, "payload_bytes": so_far if final else None, "payload_digest": digest}
            number += 1
            if final:
                break


def read_archives(manifest: DataFrame, chunk: int = CHUNK_BYTES, content: bool = True, rows: int = 512) -> DataFrame:
    """RECORDS of the ranges (file, begin, end) of a manifest; a null end is the file's. Batches have at most `rows` rows and about 4 chunks of content."""
    schema = pa.schema([("page_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("chunk", pa.int32()), ("content", pa.binary()), ("so_far", pa.int64()), ("final", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, begin, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, name = opened(file)
                held, size = [], 0
                with system.open_input_file(name) as f:
                    for row in records(Source(f, begin, end), chunk, content):
                        held.append(row)
                        size += len(row["content"] or b"")
                        if len(held) >= rows or size >= 4 * chunk:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    ranges = max(1, min(MOST_TASKS, manifest.count()))
    return manifest.select("file", "begin", "end").repartition(ranges).mapInArrow(run, RECORDS)


def archive_pages(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Writes a record per page and reads the archives back: the key, payload_bytes, payload_digest, record_type and refers_to. Without a folder the archives are
    temporary, under the shared one."""
    spark = pages.sparkSession
    where = folder or f"{shared_dir(spark)}/tilmark/warc-{uuid.uuid4().hex}"
    id_kind = pages.schema[key].dataType
    manifest = write_archives(decided(keyed(pages, key, url, html), least), where)
    last = read_archives(manifest, content=False).filter("final")
    out = last.select(F.col("page_id").cast(id_kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_kind).alias("refers_to"))
    if folder is not None:
        return out
    kept = written(out, "records")
    dropped_folder(spark, where)
    return kept
