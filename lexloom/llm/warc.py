r"""WARC archives in Zstandard: a writer, and a reader that checks what it reads.

An archive begins with a skippable frame that holds a dictionary, then has one frame per record. The reader loads the
dictionary, walks frame by frame (lengths are read from the frames' own headers), decompresses each
record, and validates version line, mandatory fields, block length, closing bytes and payload digest. A record that
fails gives a row with an ``error``; the ones after it are still read.

Archives are written through Spark's text writer, hence on any file system, with its commit protocol: one row is
a few MB of frames, and the line separator is itself an empty skippable frame (``P*M\x18\0\0\0\0``), which every decoder passes
over. After a fixed number of rows the writer begins another archive, again with the dictionary, so an archive is never
larger than a reader's memory allows. Which records are revisits is found on digests alone: (page_id, digest) rows are counted per
digest, and only digests that occur again are joined back, salted, since one payload may fill a third of all pages.

Defined results: null html is an empty payload; null urls get a name from the page_id; a null page_id is always a
response and nobody revisits it; rows that share the smallest page_id are all responses; an empty table gives an empty
result (and a folder without records reads as an empty table); a very long page is one record of its own; further columns are
ignored, whatever their names. ``revisit_errors`` holds what revisits say against the responses they refer to.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Frame kinds. Fixed values of the format.
DICTIONARY_MAGIC, SKIPPABLE, FRAME_MAGIC = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
SEPARATOR = "P*M\x18\x00\x00\x00\x00"

#: The dictionary is trained on so many pages, so many bytes of each; it only affects the size of archives.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 200, 8192, 32768
#: Revisit rows (page_id, SHA-1, page_id: under 100 bytes each) that may be broadcast to the writers.
BROADCAST_REVISITS, SALTS = 50_000, 16

_MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")


# ---------------------------------------------------------------- frames


def train(samples: list[bytes]) -> bytes:
    """A dictionary from samples; empty if there is too little to learn from."""
    samples = [s for s in samples if s]
    if sum(map(len, samples)) < 4 * DICTIONARY_BYTES or len(samples) < 16:
        return b"".join(samples)[:DICTIONARY_BYTES]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def frame_end(buf: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends, from its header and block headers."""
    (magic,) = struct.unpack_from("<I", buf, at)
    if magic & 0xFFFFFFF0 == SKIPPABLE:
        end = at + 8 + struct.unpack_from("<I", buf, at + 4)[0]
    elif magic == FRAME_MAGIC:
        head = buf[at + 4]
        single = head >> 5 & 1
        end = at + 5 + (1 - single) + (0, 1, 2, 4)[head & 3] + (single, 2, 4, 8)[head >> 6]
        last = 0
        while not last:
            block = int.from_bytes(buf[end : end + 3], "little")
            if end + 3 > len(buf):
                raise ValueError("a frame is cut off")
            last, kind, size = block & 1, block >> 1 & 3, block >> 3
            end += 3 + (1 if kind == 1 else size)
        end += 4 * (head >> 2 & 1)
    else:
        raise ValueError("no frame begins here")
    if end > len(buf):
        raise ValueError("a frame is cut off")
    return end


def frames(data: bytes) -> Iterator[tuple[bytes | None, str | None]]:
    """(record bytes, error) of each record frame of an archive."""
    buf, at, first = memoryview(data), 0, True
    decoder = zstandard.ZstdDecompressor()
    while at < len(buf):
        try:
            end = frame_end(buf, at)
        except (ValueError, struct.error, IndexError) as e:
            yield None, str(e)
            return  # without a length there is no next frame
        (magic,) = struct.unpack_from("<I", buf, at)
        if magic == FRAME_MAGIC:
            first = False
            try:
                yield decoder.decompressobj().decompress(buf[at:end]), None
            except zstandard.ZstdError as e:
                yield None, f"bad frame: {e}"
        elif magic == DICTIONARY_MAGIC and first:
            own = bytes(buf[at + 8 : end])
            if own[:4] == struct.pack("<I", FRAME_MAGIC):  # dictionaries may be compressed
                own = zstandard.ZstdDecompressor().decompressobj().decompress(own)
            decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(own))
            first = False
        at = end


# ---------------------------------------------------------------- records


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None, page_id: int | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A WARC record: a response, or a revisit of ``refers_to`` with the response's head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_uri(url, page_id)}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if refers_to is not None:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(m[1]) if m else None


def parse(data: bytes) -> dict:
    """Fields of one record, with ``error`` where a check fails."""
    out = dict.fromkeys(("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload", "error"))
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode(errors="replace").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        return out | {"error": "no WARC header"}
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    out |= {"page_id": _page(fields.get("warc-record-id")), "record_type": fields.get("warc-type"), "refers_to": _page(fields.get("warc-refers-to")), "url": fields.get("warc-target-uri")}
    if missing := [x for x in _MANDATORY if x not in fields]:
        return out | {"error": f"no {missing[0]}"}
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        return out | {"error": "wrong length"}
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http.replace(b"\r\n", b"\n"))
    if not gap or not length:
        return out | {"error": "no HTTP header"}
    told = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if out["record_type"] == "response":
        if len(payload) != int(length[1]):
            return out | {"error": "wrong payload length"}
        own = digest(payload)
        return out | {"payload_bytes": len(payload), "payload_digest": own, "payload": payload, "error": None if told in ("", own) else "wrong payload digest"}
    if out["record_type"] == "revisit":
        return out | {"payload_bytes": int(length[1]), "payload_digest": told or None, "error": None if told and out["refers_to"] is not None else "a revisit of nothing"}
    return out | {"error": "unknown type"}


# ---------------------------------------------------------------- Spark


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, sha, refers_to) of the pages that revisit another: payloads of at least ``least_bytes`` whose digest a smaller page_id has."""
    seen = pages.select("page_id", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).filter("page_id is not null").filter(F.octet_length("payload") >= least_bytes).select("page_id", F.sha1("payload").alias("sha"))
    seen = C.stored(seen, "digests")
    again = seen.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).filter("refers_to <> last").select("sha", "refers_to")
    spread = again.select("sha", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return seen.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(spread, ["sha", "salt"]).filter("page_id > refers_to").select("page_id", "sha", "refers_to").distinct()


#: Bytes of frames that a row of the text writer holds, rows that an archive holds: archives of about 64 MB, whatever the partitions.
ROW_BYTES, ARCHIVE_ROWS = 4 << 20, 16


def _frames(dictionary: bytes, level: int, row_bytes: int, archive_rows: int):
    """Rows of frames for archives of ``archive_rows`` rows each; the first row of each archive begins with the dictionary."""
    schema, gap = pa.schema([("value", pa.binary())]), SEPARATOR.encode()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        encoder = zstandard.ZstdCompressor(level=level, write_checksum=True, **how)
        held, size, written = [], 0, 0

        def row():
            head = [dictionary_frame(dictionary)] if dictionary and written % archive_rows == 0 else []
            return pa.RecordBatch.from_arrays([pa.array([gap.join([*head, *held])], pa.binary())], schema=schema)

        for batch in batches:
            for page_id, url, html, refers_to in zip(*batch.columns, strict=True):
                held.append(encoder.compress(record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers_to.as_py())))
                size += len(held[-1])
                if size >= row_bytes:
                    yield row()
                    held, size, written = [], 0, written + 1
        if held:
            yield row()

    return rows


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, level: int = 3) -> None:
    """Archives of bounded size, one or more per partition of ``pages`` (page_id, url, html), into the folder ``path``."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    sample = [(r["s"] or "").encode() for r in pages.select(F.substring("html", 1, SAMPLE_BYTES).alias("s")).limit(SAMPLE_PAGES).collect()]
    again = C.stored(revisits(pages, least_bytes).withColumnsRenamed({"page_id": "__id", "sha": "__sha"}), "revisits")
    sha = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    side = F.broadcast(again) if again.limit(BROADCAST_REVISITS + 1).count() <= BROADCAST_REVISITS else again
    rows = pages.withColumn("__own", sha).join(side, (F.col("page_id") == F.col("__id")) & (F.col("__own") == F.col("__sha")), "left").select("page_id", "url", "html", "refers_to")
    rows = rows.mapInArrow(_frames(train(sample), level, ROW_BYTES, ARCHIVE_ROWS), "value binary").select(F.col("value").cast("string"))
    rows.write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", ARCHIVE_ROWS).text(path)
    C.release(again)


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("error", pa.string()), ("archive", pa.string())])


def _records(with_payload: bool):
    schema = _READ if with_payload else _READ.remove(6)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                held, size = [], 0
                for data, error in frames(content.as_py()):
                    row = parse(data) if error is None else dict.fromkeys(schema.names) | {"error": error}
                    held.append({k: row.get(k) for k in schema.names} | {"archive": path.as_py()})
                    size += 200 + len(row.get("payload") or b"") * with_payload
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return rows


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row per record of the archives in a folder: page_id, payload_bytes, payload_digest, record_type, refers_to, url, (payload,) error, archive."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    columns = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, " + "payload binary, " * with_payload + "error string, archive string"
    return files.mapInArrow(_records(with_payload), columns)


def revisit_errors(records: DataFrame) -> DataFrame:
    """(page_id, refers_to, error): revisits whose response is missing or has another length or digest. ``records`` as read back."""
    said = records.filter("record_type = 'revisit' and error is null").select("page_id", "refers_to", F.col("payload_bytes").alias("__bytes"), F.col("payload_digest").alias("__digest"), F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("__salt"))
    held = records.filter("record_type = 'response' and error is null").select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").distinct()
    # one response may be what a third of all records refer to
    held = held.join(said.select("refers_to").distinct(), "refers_to", "left_semi").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    wrong = F.when(F.col("payload_digest").isNull(), "no response").when(F.col("payload_digest") != F.col("__digest"), "another digest").when(F.col("payload_bytes") != F.col("__bytes"), "another length")
    return said.join(held, ["refers_to", "__salt"], "left").select("page_id", "refers_to", wrong.alias("error")).filter("error is not null")


def op2_warc(spark, sf_dir: str) -> DataFrame:
    path = C.shared_path(spark, "archives")
    write_archives(C.table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")
