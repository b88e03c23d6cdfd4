"""WARC archives with segmented records: writing, reading back, and reassembly."""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut, fresh_dir

CRLF = "\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SMALLEST_REVISIT = 100


def _uuid(digest: F.Column) -> F.Column:
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _joined(parts: F.Column) -> F.Column:
    """The parts, an array of binaries, one after the other, each copied once; bytes are not read as characters."""
    return F.concat_ws("", F.transform(parts, lambda x: x.cast("string"))).cast("binary")


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment_bytes: int = 1 << 16, chunk_bytes: int = 8192, records_a_file: int = 1024) -> None:
    """Write a record for each row of pages as WARC files in path.

    A response's block is an HTTP response with the payload in chunked framing.  A block over segment_bytes is
    cut into segments: the first record, then continuation records that name it, their number and, in the
    last, the total length.  Of equal payloads of at least SMALLEST_REVISIT bytes the row with the smallest id is
    a response and the others revisit it; rows that repeat the smallest id are all responses, and a null id
    is after every other.  Null payloads are empty.  A file has at most records_a_file records, none much over
    segment_bytes, so a reader's task is of bounded size; files are gzipped whole, and Spark's committer makes one
    appear whole or not at all.
    """
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), body.alias("body"))
    rows = rows.select("*", F.octet_length("body").alias("size"), F.sha2("body", 256).alias("digest"))
    # Which rows revisit is settled on ids and digests alone; payloads are dealt once, by id and digest.
    narrow = rows.filter(F.col("size") >= SMALLEST_REVISIT).select("id", "digest")
    heads = narrow.groupBy("digest").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "head")
    later = narrow.join(heads, "digest").filter("id > head or (id is null and head is not null)").select(F.coalesce("id", F.lit(0)).alias("k"), F.col("id").isNull().alias("k0"), F.col("digest").alias("kd"), "head").distinct()
    # rows without an id are told apart by a number, not ranked: they may be many and alike
    salt = F.when(F.col("id").isNull(), F.monotonically_increasing_id()).otherwise(-1)
    keyed = rows.select("*", F.coalesce("id", F.lit(0)).alias("key"), F.col("id").isNull().alias("key0"), salt.alias("salt"))
    keyed = keyed.join(later, (F.col("key") == F.col("k")) & (F.col("key0") == F.col("k0")) & (F.col("digest") == F.col("kd")), "left").drop("k", "k0", "kd")
    turn = F.row_number().over(Window.partitionBy("key", "key0", "digest", "salt").orderBy("url"))
    text_id = F.coalesce(F.col("id").cast("string"), F.lit("-"))
    keyed = keyed.select("*", turn.alias("turn"), text_id.alias("name"))
    record = _uuid(F.md5(F.concat_ws("|", "name", "digest", F.col("turn").cast("string"), F.when(F.col("key0"), F.col("salt").cast("string"))).cast("binary")))
    origin = _uuid(F.md5(F.concat_ws("|", F.col("head").cast("string"), "digest", F.lit("1")).cast("binary")))
    keyed = keyed.select("*", record.alias("record"), F.when(F.col("head").isNotNull(), origin).alias("origin"))

    starts = F.sequence(F.lit(0), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(chunk_bytes))
    one = lambda at: F.concat(F.lower(F.hex(F.least(F.lit(chunk_bytes), F.col("size") - at).cast("long"))).cast("binary"), F.lit(CRLF).cast("binary"), F.col("body").substr(at + 1, F.lit(chunk_bytes)), F.lit(CRLF).cast("binary"))
    chunks = F.when(F.col("size") > 0, _joined(F.transform(starts, one))).otherwise(F.lit(b"").cast("binary"))
    http = lambda more: F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}{more}{CRLF}").cast("binary")
    block = F.when(F.col("origin").isNotNull(), http("")).otherwise(F.concat(http(f"Transfer-Encoding: chunked{CRLF}"), chunks, F.lit(f"0{CRLF}{CRLF}").cast("binary")))
    keyed = keyed.select("name", "url", "digest", "record", "origin", "head", block.alias("block"))
    keyed = keyed.select("*", F.octet_length("block").alias("total"))
    pieces = keyed.select("*", F.posexplode(F.sequence(F.lit(0), F.greatest(F.col("total") - 1, F.lit(0)), F.lit(segment_bytes))).alias("number", "from"))

    line = lambda label, value: F.concat(F.lit(label + ": "), value, F.lit(CRLF))
    many, last = F.col("total") > segment_bytes, F.col("from") + segment_bytes >= F.col("total")
    first = F.col("number") == 0
    opt = lambda when, text: F.when(when, text).otherwise("")
    piece = F.col("block").substr(F.col("from") + 1, F.lit(segment_bytes))
    number = (F.col("number") + 1).cast("string")
    target = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", " ")
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(~first, F.lit("continuation")).when(F.col("origin").isNotNull(), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.when(first, F.col("record")).otherwise(_uuid(F.md5(F.concat_ws("|", "record", number).cast("binary"))))),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        line("WARC-Target-URI", target),
        line("X-Page-Id", F.col("name")),
        opt(first, line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest"))),
        opt(first & F.col("origin").isNotNull(), F.concat(line("WARC-Profile", F.lit(REVISIT)), line("WARC-Refers-To", F.coalesce("origin", F.lit(""))))),
        opt(many, line("WARC-Segment-Number", number)),
        opt(~first, line("WARC-Segment-Origin-ID", F.col("record"))),
        opt(many & last & ~first, line("WARC-Segment-Total-Length", F.col("total").cast("string"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(piece).cast("string")),
        F.lit(CRLF),
    )
    # Two line ends close a record, so the text writer's line separator is the end of a record.
    value = F.concat(header.cast("binary"), piece).cast("string")
    pieces.select(value.alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", records_a_file).text(path)


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """Headers (names lower-cased) and block of each record of a WARC file."""
    out, at = [], 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode("utf-8").split(CRLF)[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(head["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError(f"record at byte {at} is cut short")
        out.append((head, block))
        at = end + 4 + size
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record before byte {at} does not end")
        at += 4
    return out


def dechunk(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size is missing")
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        part = body[end + 2 : end + 2 + size]
        if len(part) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(part)
        at = end + 4 + size


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response, with its chunked framing undone."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("HTTP header does not end")
    chunked = any(x.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for x in head.split(b"\r\n")[1:])
    return dechunk(body) if chunked else body


_RECORD = "origin string, number int, total long, kind string, page string, refers string, digest string, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, page, kind, refers, stated, payload) of the whole records in path's WARC files.

    Continuations are grouped by the record they name and put in order of their number; a gap, a repeated number,
    or a length other than the last segment's total is an error.  A file is read by one task, and a record by
    one, so files should be of a task's size, as write_archive leaves them.
    """

    def records(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                data = content.as_buffer().to_pybytes()
                for head, block in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    more = head["warc-type"] == "continuation"
                    number = int(head.get("warc-segment-number", 0))
                    total = head.get("warc-segment-total-length")
                    rows.append((head["warc-segment-origin-id"] if more else head["warc-record-id"], number, int(total) if total else None, None if more else head["warc-type"], head.get("x-page-id"), head.get("warc-refers-to"), head.get("warc-payload-digest"), block))
                names = [x.split()[0] for x in _RECORD.split(", ")]
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
                for a in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a : a + 1000]), kinds)], names)

    parts = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("content").mapInArrow(records, _RECORD)
    whole = parts.filter("number = 0").select("origin", "page", "kind", "refers", "digest", "block")
    pieces = (
        parts.filter("number > 0")
        .groupBy("origin")
        .agg(
            F.array_sort(F.collect_list(F.struct("number", "block"))).alias("s"),
            F.max("total").alias("total"),
            F.max("kind").alias("kind"),
            F.max("page").alias("page"),
            F.max("refers").alias("refers"),
            F.max("digest").alias("digest"),
        )
    )
    joined = _joined(F.transform("s", lambda x: x["block"]))
    sound = (F.element_at("s", -1)["number"] == F.size("s")) & (F.size(F.array_distinct(F.transform("s", lambda x: x["number"]))) == F.size("s"))
    pieces = pieces.select("*", joined.alias("block"), sound.alias("sound"))
    fault = F.raise_error(F.concat(F.lit("segments of "), "origin", F.lit(" are not whole")))
    pieces = pieces.select("origin", "page", "kind", "refers", "digest", F.when(F.col("sound") & (F.octet_length("block") == F.col("total")), F.col("block")).otherwise(fault).alias("block"))

    def decode(batches):
        for batch in batches:
            payload = [payload_of(b) for b in batch.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(payload, pa.binary())], ["record", "page", "kind", "refers", "stated", "payload"])

    return whole.union(pieces).mapInArrow(decode, "record string, page string, kind string, refers string, stated string, payload binary")


def archive_digests(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment_bytes: int = 1 << 16, path: str | None = None) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) as read back from an archive of pages.

    Every row comes from its record.  A revisit's size and digest are those of the payload it refers to.
    """
    spark = pages.sparkSession
    path = path or fresh_dir(spark, "warc")
    write_archive(pages, path, id_col, url_col, payload_col, segment_bytes)
    read = read_records(spark, path).select("record", "page", "kind", "refers", "stated", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("digest"))
    page = F.when(F.col("page") == "-", None).otherwise(F.col("page")).cast("long")
    fault = F.raise_error(F.concat(F.lit("digest of "), "record", F.lit(" differs")))
    read = cut(read.select("*", page.alias("id")), "warc-digests")
    own = read.filter("kind = 'response'")
    own = own.select("id", "record", "bytes", F.when(F.concat(F.lit("sha256:"), "digest") == F.col("stated"), F.col("digest")).otherwise(fault).alias("digest"))
    again = read.filter("kind = 'revisit'").select("id", "refers")
    seen = again.join(own.select(F.col("record").alias("refers"), "bytes", "digest", F.col("id").alias("head")), "refers")
    out = own.select("id", "bytes", "digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    out = out.union(seen.select("id", "bytes", "digest", F.lit("revisit"), "head"))
    return out.select(F.col("id").alias(id_col), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
