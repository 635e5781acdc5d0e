"""WARC archives: writing page captures, and assembling transactions from the records read back.

A capture is three records: the request, the response (or a revisit of an equal payload) and metadata. Request
and metadata name the capture's response or revisit as concurrent. Archives are written by Spark's own writer,
hence to any store, as gzip files of a bounded size, one member each.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import pick, stored

CRLF = "\r\n"
END = "\r\n\r\n"
#: Uncompressed payload bytes that a file holds at most, but for one capture that is larger by itself.
FILE_BYTES = 512 << 20
#: Largest payloads of the size classes.
CLASSES = (256 << 10, 4 << 20, 64 << 20)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = "record_id string, record_type string, concurrent_to string, target_uri string, payload_digest string, refers_to string, payload_bytes long, computed_digest string, block string"


def base32_sha1(data):
    """A binary column's SHA-1 in bare upper-case base32."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Each page with the capture that its payload revisits, if any.

    (page_id, capture, url, payload, n_bytes, payload_digest, refers_to capture or null). Of pages with equal payloads
    of at least `least_bytes` bytes the one with the smallest id is the response; null ids come last, and
    of repeated ids any one row is it. A null payload is an empty one. An empty table gives no rows.

    Pages are written once with their digests and numbers, so that a capture keeps its name whatever is recomputed.
    Pages of equal payload meet by digest without their payloads, which join by capture, a key without skew.
    """
    own = pick(pages, page_id=id_col, url=url_col, payload=html_col)
    own = own.select(F.col("page_id").cast("long"), F.monotonically_increasing_id().alias("row"), "url", F.coalesce("payload", F.lit("")).alias("payload"))
    capture = F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("row").cast("string"))
    own = own.select("page_id", "row", "url", "payload", capture.alias("capture"), F.octet_length("payload").alias("n_bytes"), base32_sha1(F.encode("payload", "UTF-8")).alias("payload_digest"))
    own = stored(own, "warc-pages", compression="zstd")
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id"), F.col("row"))
    rest = own.where(F.col("n_bytes") >= least_bytes)
    # Written first: Spark splits a popular payload in a join of two shuffles, but not above an aggregate.
    first = stored(rest.groupBy("payload_digest").agg(F.min_by("capture", order).alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "refers_to"), "warc-first")
    again = rest.select("capture", "n_bytes", "payload_digest").join(first, "payload_digest").where("refers_to <> capture")
    return own.join(again.select("capture", "n_bytes", "refers_to"), ["capture", "n_bytes"], "left").select("page_id", "capture", "url", "payload", "n_bytes", "payload_digest", "refers_to")


def _record(kind, record_id, uri, headers: list, content_type, block):
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: <urn:capture:"), record_id, F.lit(">")), F.lit("WARC-Date: 2024-01-01T00:00:00Z"), F.concat(F.lit("WARC-Target-URI: "), uri)]
    lines += [*headers, F.concat(F.lit("Content-Type: "), content_type), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(END), block)


def write(found: DataFrame, path: str) -> None:
    """Write `captures` rows as WARC files under path.

    Captures of one class of size share files, as many as FILE_BYTES hold if all are the class's largest; what is larger
    than any class has files of its own. So no file comes near the 2 GB that a reader takes as a whole.
    """
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x1F\x7F]", "%0A")
    concurrent = F.concat(F.lit("WARC-Concurrent-To: <urn:capture:"), F.col("capture"), F.lit(":capture>"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(END))
    request = _record(F.lit("request"), F.concat(F.col("capture"), F.lit(":request")), uri, [concurrent], F.lit("application/http;msgtype=request"), F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{END}")))
    refers = F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: <urn:capture:"), F.col("refers_to"), F.lit(":capture>")))
    response = _record(F.when(revisit, "revisit").otherwise("response"), F.concat(F.col("capture"), F.lit(":capture")), uri, [digest, refers], F.lit("application/http;msgtype=response"), F.concat(http, F.when(revisit, "").otherwise(F.col("payload"))))
    meta = _record(F.lit("metadata"), F.concat(F.col("capture"), F.lit(":metadata")), uri, [concurrent], F.lit("application/warc-fields"), F.concat(F.lit("payload-bytes: "), F.col("n_bytes").cast("string"), F.lit(CRLF)))
    # A record ends with two line ends: between records they are put here, after the last by the writer.
    rows = found.select(F.concat_ws(END, request, response, meta).alias("value"), F.when(revisit, 0).otherwise(F.col("n_bytes")).alias("n_bytes"))
    size_class = F.size(F.filter(F.array(*map(F.lit, CLASSES)), lambda x: x < F.col("n_bytes")))
    classes = sorted(r[0] for r in found.select(F.when(revisit, 0).otherwise(F.col("n_bytes")).alias("n_bytes")).select(size_class).distinct().collect())
    for k in classes or [0]:
        most = max(1, FILE_BYTES // CLASSES[k]) if k < len(CLASSES) else 1
        own = rows.where(size_class == k) if len(classes) > 1 else rows
        own.select("value").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", most).mode("append").text(path)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of a gzip file, which is inflated as it is read."""
    inflate = zlib.decompressobj(31)
    buffer, at, fed = bytearray(), 0, 0

    def more() -> bool:
        nonlocal fed, inflate, at
        chunk = inflate.unconsumed_tail
        if inflate.eof:  # the next member, if there is one
            chunk, inflate = inflate.unused_data, zlib.decompressobj(31)
        if not chunk:
            chunk = data[fed : (fed := fed + (1 << 18))]
        if not chunk:
            return False
        del buffer[:at]
        at = 0
        try:
            buffer.extend(inflate.decompress(chunk, 1 << 22))
        except zlib.error as e:
            raise ValueError("no gzip data") from e
        return True

    while True:
        while (head := buffer.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if bytes(buffer[at:]).strip():
                    raise ValueError("a WARC record is cut short")
                return
        lines = bytes(buffer[at:head]).decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        at = head + 4
        while len(buffer) - at < size + 4:
            if not more():
                raise ValueError("a WARC record is cut short")
        yield headers, bytes(buffer[at : at + size])
        at += size + 4


def _id(value: str | None) -> str | None:
    return value.strip("<>").removeprefix("urn:capture:") if value else None


def read(spark: SparkSession, path: str, with_block: bool = True) -> DataFrame:
    """One row per record under path, as FIELDS; block (decoded UTF-8) is null unless asked for.

    payload_bytes and computed_digest are those of a response's actual payload; of a revisit, which stores
    none, payload_bytes is what its HTTP header declares.
    """
    kinds = [(n, pa.int64() if k == "long" else pa.string()) for n, k in (x.split(" ") for x in FIELDS.split(", "))]
    schema = pa.schema(kinds)

    def run(batches):
        for b in batches:
            for data in b.column(0):
                rows: list[list] = []
                held = 0
                for h, block in records(data.as_py()):
                    n = digest = None
                    if h.get("warc-type") in ("response", "revisit"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        if h["warc-type"] == "response":
                            n, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        else:
                            n = next((int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                    stated = h.get("warc-payload-digest")
                    rows.append([_id(h.get("warc-record-id")), h.get("warc-type"), _id(h.get("warc-concurrent-to")), h.get("warc-target-uri"), stated.removeprefix("sha1:") if stated else None, _id(h.get("warc-refers-to")), n, digest, block.decode("utf-8", "replace") if with_block else None])
                    held += len(block) if with_block else 200
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, FIELDS)


def transactions(found: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, target_uri, request, response, metadata), structs or null.

    Records meet through concurrent-to: the group's name is the response's or revisit's own id. A capture
    without one of the records has null there; of several of a kind the one with the largest id counts.
    """
    group = F.coalesce("concurrent_to", "record_id")
    rest = F.struct("record_id", "record_type", "payload_digest", "refers_to", "payload_bytes", "computed_digest", "block")
    kind = F.col("record_type")
    return found.groupBy(group.alias("capture_id")).agg(
        F.max("target_uri").alias("target_uri"),
        F.max(F.when(kind == "request", rest)).alias("request"),
        F.max(F.when(kind.isin("response", "revisit"), rest)).alias("response"),
        F.max(F.when(kind == "metadata", rest)).alias("metadata"),
    )


def page_id(capture):
    """The page id in a record id; null where the page had none."""
    return F.nullif(F.split_part(capture, F.lit(":"), F.lit(1)), F.lit("")).cast("long")
