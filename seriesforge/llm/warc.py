"""WARC archives with segmented records: writing, and reassembly on reading.

Archives are written with Spark's text writer, a record a row, and read by splitting at the version line, so files can
be as large as they like and lie in any store Spark reaches. A payload is sent in chunked transfer framing; a chunk
ends inside any version line that the payload holds, so none is in a block. Blocks longer than a segment go on in
continuation records, which reading groups by origin, orders by segment number, verifies against the total length, and
joins before the framing is decoded. Only segmented records are shuffled.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm._frames import arrow_map, delete_at_end, shared_dir, staged

VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
#: Bytes of a segment's block and of a chunk; payloads under LEAST bytes are never revisits.
SEGMENT, CHUNK, LEAST = 32_768, 8_192, 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARSED = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, segment int, origin string, total long, block binary, error string"
WHOLE = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload binary, error string"


def _letter_start(data: bytes, at: int) -> int:
    """The last character boundary at or before ``at``: records are texts."""
    while at and at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing; no version line is left whole, and no chunk ends with one."""
    out, i = [], 0
    while i < len(payload):
        j = min(i + size, len(payload))
        j = max(_letter_start(payload, j), i + 1)
        at = payload.find(VERSION, i, j)
        if at >= 0:
            j = at + 5  # after "WARC/"
        out.append(b"%x\r\n%s\r\n" % (j - i, payload[i:j]))
        i = j
    return b"".join(out) + b"0" + END


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body. Raises ValueError where the framing is broken."""
    out, i = [], 0
    while True:
        j = body.index(b"\r\n", i)
        n = int(body[i:j].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        if body[j + 2 + n:j + 4 + n] != b"\r\n":
            raise ValueError("a chunk isn't as long as it says")
        out.append(body[j + 2:j + 2 + n])
        i = j + 4 + n


def _uri(url: str | None) -> str:
    clean = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    return clean.replace("WARC/", "WARC%2F")


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return VERSION + b"\r\n" + lines.encode() + b"\r\n" + block


def records(page: str, place: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, segment: int = SEGMENT) -> list[bytes]:
    """The records of one page, without their closing empty lines. ``place`` (task and row) makes the record's name its
    own; up to the slash, it is the name of the page with that payload, which ``refers_to``, a page, is looked up by."""
    name = f"{page}.{digest[:16]}/{place}"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + END
    first = [("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        return [_record([("WARC-Type", "revisit"), *first, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}.{digest[:16]}>")], head)]
    block = head + chunked(payload)
    if len(block) <= segment:
        return [_record([("WARC-Type", "response"), *first], block)]
    cuts = [0]
    while cuts[-1] < len(block):
        cut = min(cuts[-1] + segment, len(block))
        cuts.append(max(_letter_start(block, cut), cuts[-1] + 1))
    out = [_record([("WARC-Type", "response"), *first, ("WARC-Segment-Number", "1")], block[:cuts[1]])]
    for i in range(1, len(cuts) - 1):
        headers = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{name}:{i + 1}>"), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url)),
                   ("WARC-Segment-Origin-ID", f"<urn:page:{name}>"), ("WARC-Segment-Number", str(i + 1))]
        if i == len(cuts) - 2:
            headers.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_record(headers, block[cuts[i]:cuts[i + 1]]))
    return out


def write_warc(pages: DataFrame, path: str, least: int = LEAST, segment: int = SEGMENT) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) to gzipped archives at ``path``.

    Null html is an empty payload. Of rows with equal payloads of ``least`` bytes or more, those with the smallest page_id
    are responses and the others revisit it; a null page_id is a response unless a row with an id has its payload. Rows
    alike in page_id and payload are alike in type. An empty table writes no records.
    """
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(F.encode(pages["html"].cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = staged(rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first"))
    known = rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", F.expr("if(page_id <=> first, null, first)").alias("refers_to"))

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for page, url, payload, digest, refers, row in zip(*(c.to_pylist() for c in b.columns)):
            out += records(str(page), str(row), url, payload, digest, None if refers is None else str(refers), segment)
        return pa.record_batch([pa.array(out, pa.binary())], names=["record"])
    arrow_map(known.withColumn("row", F.monotonically_increasing_id()), batch, "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


def _headers(lines: bytes) -> tuple[dict[str, str], str | None]:
    """The header lines that can be read, and what is wrong with the others. A line that begins with a blank goes on with
    the one before."""
    found, error, last = {}, None, None
    for line in lines.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if last and line[:1] in (" ", "\t"):
            found[last] += " " + line.strip()
        elif colon and name and not any(c.isspace() for c in name):
            found[name], last = value.strip(), name
        else:
            error, last = "a header line has no name", None
    return found, error


def _number(text: str | None) -> int | None:
    """A header's number, from 0 to 2^63; None for anything else."""
    return int(text) if text and text.isascii() and text.isdigit() and len(text) < 19 else None


def _parsed(b: pa.RecordBatch) -> pa.RecordBatch | None:
    """Each record as it is; one that is broken has an error and what can be read of its headers."""
    rows = []
    for text in b.column(0).to_pylist():
        if not text:
            continue  # before a file's first record
        lines, _, rest = text.partition(END)
        h, error = _headers(lines)
        number, total, n = (_number(h.get(k)) for k in ("WARC-Segment-Number", "WARC-Segment-Total-Length", "Content-Length"))
        if n is None:
            error = error or "no length"
        elif rest[n:] != END:
            error = error or "the record isn't as long as it says"
        if not h.get("WARC-Record-ID") or not h.get("WARC-Type"):
            error = error or "no record id or type"
        if number is None and "WARC-Segment-Number" in h or number is not None and number >= 1 << 31:
            number, error = None, error or "no segment number"
        rows.append((h.get("WARC-Record-ID"), h.get("WARC-Type"), h.get("WARC-Target-URI"), (h.get("WARC-Payload-Digest") or "").removeprefix("sha256:") or None, h.get("WARC-Refers-To"),
                     number, h.get("WARC-Segment-Origin-ID"), total, None if error else rest[:n], error))
    if not rows:
        return None
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.string())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in PARSED.split(", ")])


def _payload(block: bytes) -> bytes:
    head, _, body = block.partition(END)
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _decoded(b: pa.RecordBatch) -> pa.RecordBatch:
    payloads, errors = [], []
    for kind, block, error in zip(*(b.column(c).to_pylist() for c in ("record_type", "block", "error"))):
        payload = None
        if error is None and kind == "response":
            try:
                payload = _payload(block)
            except ValueError as e:
                error = str(e)
        payloads.append(payload)
        errors.append(error)
    return pa.record_batch([*(b.column(c) for c in ("record_id", "record_type", "target_uri", "payload_digest", "refers_to")), pa.array(payloads, pa.binary()), pa.array(errors, pa.string())],
                           names=["record_id", "record_type", "target_uri", "payload_digest", "refers_to", "payload", "error"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives at ``path``, whole: record_id, record_type, target_uri, payload_digest, refers_to,
    payload (null for revisits) and error (null if the record is sound).

    A segmented record whose numbers have gaps or repeat, or whose length isn't the total, has an error and no payload; so
    has a body whose framing is broken, and a record that isn't as long as it says or whose headers lack a name, an id, a
    type or a length (nulls stand for what can't be read). A broken segment is an error of the record that it belongs to,
    if it says which. A record of another version is part of the one before, which isn't as long as it says then. Other
    records are read whatever stands beside them.
    """
    parsed = arrow_map(spark.read.option("lineSep", (VERSION + b"\r\n").decode()).text(path).select(F.col("value").cast("binary").alias("value")), _parsed, PARSED)
    of_segments = F.col("segment").isNotNull() & F.coalesce("origin", "record_id").isNotNull()
    whole = parsed.where(~of_segments)
    parts = parsed.where(of_segments).withColumn("origin", F.coalesce("origin", "record_id"))
    head = F.first(F.when(F.col("segment") == 1, F.struct("record_type", "target_uri", "payload_digest", "refers_to")), ignorenulls=True)
    joined = parts.groupBy("origin").agg(
        head.alias("head"), F.max("error").alias("broken"), F.max("total").alias("total"), F.sum(F.octet_length("block")).alias("length"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"))
    sound = (F.col("length") == F.col("total")) & (F.transform("parts", lambda x: x["segment"]) == F.sequence(F.lit(1), F.size("parts")))
    reassembled = joined.select(
        F.col("origin").alias("record_id"), "head.*", F.when(F.coalesce(sound, F.lit(False)), F.lit(None).cast("string")).otherwise(F.coalesce("broken", F.lit("segments don't add up"))).alias("error"),
        F.aggregate(F.transform("parts", lambda x: x["block"]), F.lit(b""), lambda a, x: F.concat(a, x)).alias("block"))
    columns = ["record_id", "record_type", "target_uri", "payload_digest", "refers_to", "block", "error"]
    return arrow_map(whole.select(*columns).union(reassembled.select(*columns)), _decoded, WHOLE)


def archive_round_trip(pages: DataFrame, path: str | None = None, least: int = LEAST, segment: int = SEGMENT) -> DataFrame:
    """Write ``pages`` and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, error. A
    revisit's bytes and digest are those of the response it names."""
    spark = pages.sparkSession
    if path is None:
        path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
        delete_at_end(spark, path)
    write_warc(pages, path, least, segment)
    name = lambda c: F.regexp_extract(c, r"^<urn:page:([^.>]*)\.", 1)
    page = F.when(name("record_id") != "None", name("record_id")).cast("long")
    records_ = staged(read_warc(spark, path).select(
        page.alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
        "record_type", F.when(F.col("refers_to").isNotNull(), name("refers_to")).cast("long").alias("refers_to"), F.col("payload_digest").alias("claimed"), "error"))
    responses = records_.where("record_type = 'response' OR error IS NOT NULL AND record_type IS DISTINCT FROM 'revisit'")
    wrong = F.when(F.col("error").isNull() & (F.col("payload_digest") != F.col("claimed")), "payload digest differs").otherwise(F.col("error"))
    named = responses.join(records_.where("refers_to IS NOT NULL").select(F.col("refers_to").alias("page_id")).distinct(), "page_id", "left_semi")
    seen = staged(named.select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").dropDuplicates(["refers_to", "payload_digest"]))
    revisits = records_.where("record_type = 'revisit'").select("page_id", "refers_to", "claimed", "error").join(
        seen.withColumnRenamed("payload_digest", "claimed"), ["refers_to", "claimed"], "left")
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", wrong.alias("error")).union(revisits.select(
        "page_id", "payload_bytes", F.col("claimed").alias("payload_digest"), F.lit("revisit"), "refers_to",
        F.when(F.col("payload_bytes").isNull(), "no such response").otherwise(F.col("error"))))
