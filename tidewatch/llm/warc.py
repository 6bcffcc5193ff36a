"""WARC archives: writing with revisits, segments and chunked transfer framing, and reading back with segment reassembly.

A page becomes an HTTP response whose body is framed in chunks. Of pages with the same payload the one with the largest id is
the response, the others are revisits without a body. Blocks longer than ``SEGMENT`` bytes go on in continuation records. Files
are gzip, and hold at most ``RECORDS`` records, so a reader's task has a bounded file to hold.

Reading groups continuation records by origin identifier, orders them by segment number, verifies the total length, takes the chunk
framing apart and checks the payload's digest. Revisits get their length from the response they refer to. Errors in an
archive stop the job with a message; nothing is guessed.

Defined results: a null html is an empty payload; pages without an id come after all others (they revisit a page that has one, and are
responses where none has); rows that repeat the largest id with the same payload are all responses; a null url is
written as the page's own identifier; an empty table gives an archive without records and no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm.common import checkpointed, map_batches, salted_join, table
from tidewatch.llm.registry import query
from tidewatch.session import scratch_path

SEGMENT, CHUNK, RECORDS = 16 << 10, 4 << 10, 8192
#: Payloads of at least so many bytes are looked up for revisits.
LEAST_REVISIT = 0
#: Bytes of records a reading task hands on at once.
BATCH = 4 << 20
_EMPTY_LINE = b"\r\n\r\n"
#: Dates are those of the snapshot, so equal tables give equal archives.
DATE = "2024-01-01T00:00:00Z"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def framed(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunks of transfer coding."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at:at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0", _EMPTY_LINE])


def unframed(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are read over."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        parts.append(body[at:at + size])
        at += size + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block


def page_records(page_id, url, payload: bytes, kind: str, refers_to, segment: int = SEGMENT) -> Iterator[bytes]:
    """All records of one page, without the empty line that ends each."""
    digest = _digest(payload)
    name = _record_id(page_id, digest)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + _EMPTY_LINE
    target = "".join(c for c in url if c not in "\r\n") if url else f"urn:page:{page_id}"
    fields: list[tuple[str, object]] = [
        ("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-ID", "" if page_id is None else page_id),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page-ID", refers_to)]
        yield _record(fields, head)
        return
    block = head + framed(payload)
    if len(block) <= segment:
        yield _record(fields, block)
        return
    yield _record([*fields, ("WARC-Segment-Number", 1)], block[:segment])
    starts = list(range(segment, len(block), segment))
    for number, at in enumerate(starts, 2):
        more: list[tuple[str, object]] = [
            ("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{number}')}>"),
            ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", number)]
        if at == starts[-1]:
            more.append(("WARC-Segment-Total-Length", len(block)))
        yield _record(more, block[at:at + segment])


def write_archive(pages: DataFrame, folder: str, least: int = LEAST_REVISIT) -> None:
    """Writes ``(page_id, url, html)`` as WARC files below ``folder``."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"sha": F.sha1("payload"), "size": F.length("payload")})
    shared = rows.where(F.col("size") >= least).groupBy("sha", "size").agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
    same = shared.where("n > 1 AND largest IS NOT NULL").select("sha", "size", "largest")
    dealt = salted_join(rows, same, ["sha", "size"], F.struct("page_id", "url"))
    again = F.col("largest").isNotNull() & ~F.col("largest").eqNullSafe(F.col("page_id"))
    named = dealt.select("page_id", "url", "payload", F.when(again, F.col("largest")).alias("refers_to"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[bytes] = []
            for page_id, url, payload, refers_to in zip(
                    batch["page_id"], batch["url"], batch["payload"], batch["refers_to"], strict=True):
                known = None if pd.isna(page_id) else int(page_id)
                first = None if pd.isna(refers_to) else int(refers_to)
                out += page_records(known, url, bytes(payload), "response" if first is None else "revisit", first)
            yield pd.DataFrame({"record": out})

    # ids are read as text, so that a null does not turn them into rounded numbers
    as_text = named.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", F.col("refers_to").cast("string").alias("refers_to"))
    records = map_batches(as_text, run, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option(
        "compression", "gzip").option("maxRecordsPerFile", RECORDS).text(folder)


def parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields and block of every record of a stream."""
    buffer = b""
    more = True

    def fill(n: int) -> None:
        nonlocal buffer, more
        parts, size = [buffer], len(buffer)
        while more and size < n:
            piece = next(chunks, None)
            if piece is None:
                more = False
            else:
                parts.append(piece)
                size += len(piece)
        buffer = b"".join(parts)

    while True:
        while (end := buffer.find(_EMPTY_LINE)) < 0 and more:
            fill(len(buffer) + 1)
        if end < 0:
            if buffer.strip():
                raise ValueError("the archive ends inside a header")
            return
        lines = buffer[:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins with {lines[0][:40]!r}")
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(fields["content-length"])
        whole = end + 4 + size + 4
        fill(whole)
        if len(buffer) < whole:
            raise ValueError("the archive ends inside a record")
        yield fields, buffer[end + 4:end + 4 + size]
        buffer = buffer[whole:]


def _inflated(content: bytes, piece: int = 1 << 18) -> Iterator[bytes]:
    """A gzip file's text in pieces; members may follow each other."""
    view, at = memoryview(content), 0
    while at < len(view):
        unzip = zlib.decompressobj(31)
        while not unzip.eof and at < len(view):
            out = unzip.decompress(view[at:at + piece])
            at = min(at + piece, len(view)) - len(unzip.unused_data)
            yield out


def _payload(fields_digest: str, block: bytes) -> bytes:
    head, _, body = block.partition(_EMPTY_LINE)
    payload = unframed(body) if b"transfer-encoding: chunked" in head.lower() else body
    if f"sha1:{_digest(payload)}" != fields_digest:
        raise ValueError("a payload does not have the digest its record names")
    return payload


_PARSED = ("record_id string, record_type string, page_id long, refers_id string, refers_to long, payload_digest string, "
           "origin string, segment int, total long, block binary, payload_bytes long, payload binary")


def read_records(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """One row per record; whole responses are decoded at once, pieces of segmented ones keep their block."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _PARSED.split(", ")]

        def frame(rows):
            out = pd.DataFrame(rows, columns=names)
            return out.astype({"page_id": "Int64", "refers_to": "Int64", "segment": "Int32", "total": "Int64", "payload_bytes": "Int64"})

        rows, held = [], 0
        for batch in batches:
            for content in batch["content"]:
                for f, block in parse(_inflated(content)):
                    kind, segment = f["warc-type"], f.get("warc-segment-number")
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    payload = None
                    if kind == "response" and segment is None:
                        payload = _payload(f["warc-payload-digest"], block)
                    rows.append((
                        f["warc-record-id"], kind, int(f["x-page-id"]) if f.get("x-page-id") else None, f.get("warc-refers-to"),
                        int(f["x-refers-to-page-id"]) if f.get("x-refers-to-page-id") else None, f.get("warc-payload-digest"),
                        f.get("warc-segment-origin-id", f["warc-record-id"]), None if segment is None else int(segment),
                        int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None,
                        block if segment is not None else None, None if payload is None else len(payload),
                        payload if payloads else None))
                    held += len(block)
                    if held >= BATCH:
                        yield frame(rows)
                        rows, held = [], 0
        yield frame(rows)

    return map_batches(files, run, _PARSED)


def reassemble(records: DataFrame, payloads: bool = False) -> DataFrame:
    """Responses put together from the pieces in ``records``: grouped by origin, ordered, verified, decoded.

    A page that was written more than once has every piece as often; it comes back as often.
    """
    pieces = records.where("segment IS NOT NULL").groupBy("origin", "segment").agg(
        F.count("*").alias("n"), F.first("block").alias("block"), F.max("total").alias("total"),
        F.max("page_id").alias("page_id"), F.max("payload_digest").alias("payload_digest"))
    whole = pieces.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("pieces"), F.max("total").alias("total"),
        F.max("page_id").cast("string").alias("page_id"), F.max("payload_digest").alias("payload_digest"),
        F.min("n").alias("n"), F.max("n").alias("most"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                numbers = [p["segment"] for p in r.pieces]
                block = b"".join(bytes(p["block"]) for p in r.pieces)
                if numbers != list(range(1, len(numbers) + 1)) or r.n != r.most:
                    raise ValueError(f"segments of {r.origin} are missing")
                if pd.isna(r.total) or len(block) != int(r.total):
                    raise ValueError(f"{r.origin} does not have the length its last segment names")
                payload = _payload(r.payload_digest, block)
                rows += [(r.origin, r.page_id, r.payload_digest, len(payload), payload if payloads else None)] * int(r.n)
            yield pd.DataFrame(rows, columns=["record_id", "page_id", "payload_digest", "payload_bytes", "payload"])

    decoded = map_batches(whole, run, "record_id string, page_id string, payload_digest string, payload_bytes long, payload binary")
    return decoded.withColumn("page_id", F.col("page_id").cast("long"))


def read_archive(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` per page, with ``payloads`` also the payload."""
    records = checkpointed(read_records(spark, folder, payloads))
    names = ["record_id", "page_id", "payload_digest", "payload_bytes", "payload"]
    responses = records.where("record_type = 'response' AND segment IS NULL").select(*names).unionByName(reassemble(records, payloads))
    responses = checkpointed(responses) if payloads else responses
    one = responses.groupBy("record_id").agg(F.first("payload_bytes").alias("of_bytes"), F.first("payload").alias("of_payload"))
    revisits = records.where("record_type = 'revisit'").select(
        "page_id", "payload_digest", "refers_to", F.col("refers_id").alias("record_id"))
    found = salted_join(revisits, one, ["record_id"], F.col("page_id"))
    no_target = F.raise_error(F.concat(F.lit("no response "), F.col("record_id"))).cast("long")
    out = responses.select(
        "page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "payload",
    ).unionByName(found.select(
        "page_id", F.coalesce("of_bytes", no_target).alias("payload_bytes"), "payload_digest", F.lit("revisit").alias("record_type"),
        "refers_to", F.col("of_payload").alias("payload")))
    out = out.withColumn("payload_digest", F.substring("payload_digest", 6, 100))
    return out if payloads else out.drop("payload")


@query("op2_warc")
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to an archive in the shared folder and read back."""
    folder = scratch_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), folder)
    return read_archive(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
