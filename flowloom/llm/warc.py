"""WARC archives of pages: write, normalise to one gzip member per record, read by index.

Writing: every page becomes one record, made of built-in expressions. Spark's
text writer stores them with the codec gzip, so each archive is one monolithic
stream, committed like any other output. Of equal payloads one record is the
response, the others revisit it.

Normalising: a task inflates an archive once, piece by piece, finds the records
by their lengths, and writes each as a gzip member of its own to a new archive.
What it returns is the index: file, offset and length of every member, stored
as a table beside the archives. A re-run task writes the same bytes under a
name of its own and moves the file into place.

Reading: the index tells where each member lies; members are fetched by
position, inflated alone and checked against their digest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowloom.llm.common import cut_lineage, map_batches
from flowloom.session import checkpoint_dir

# The base32 digits in order, and where Java's base 32 has them.
BASE32, JAVA32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
RECORD = "urn:page:"
STEP = 1 << 20
HEAVY = 1000
BROADCAST_ROWS = 100_000


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 160 bits are four numbers of 40 bits, eight digits each."""
    hexed = F.sha1(payload)
    fours = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*fours), JAVA32, BASE32)


def record_types(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Add ``_payload``, ``_bytes``, ``_digest`` and ``_leader``: the id that a revisit refers to,
    NULL for a response.

    Payloads are equal if their SHA-1 and length are. Only payloads that occur
    twice have a leader, the largest id. Groups with over a thousandth of all
    rows are at most a thousand, so their leaders are broadcast; the rest is
    joined by digest with no key above that share.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    base = pages.select("*", payload.alias("_payload")).withColumns({"_bytes": F.octet_length("_payload").cast("long"), "_digest": base32_sha1(F.col("_payload"))})
    slim = base.where(F.col("_bytes") >= least_bytes).groupBy("_digest", "_bytes").agg(
        F.count(F.lit(1)).alias("_n"), F.max(id_col).alias("_first")).where("_n > 1 AND _first IS NOT NULL")
    leaders = cut_lineage(slim)
    rows, in_groups = pages.count(), leaders.agg(F.count(F.lit(1)), F.sum("_n")).first()
    heavy = leaders.where(F.col("_n") * HEAVY > rows).select("_digest", "_bytes", F.col("_first").alias("_hot"))
    light = leaders.where(F.col("_n") * HEAVY <= rows).select("_digest", "_bytes", "_first")
    base = base.join(F.broadcast(heavy), ["_digest", "_bytes"], "left")  # at most HEAVY rows
    if in_groups[0] <= BROADCAST_ROWS:
        base = base.join(F.broadcast(light), ["_digest", "_bytes"], "left")  # counted
        leader = F.coalesce("_hot", "_first")
    else:
        # Rows of heavy groups get keys of their own, so that they spread.
        key = F.when(F.col("_hot").isNull(), F.xxhash64("_digest", "_bytes")).otherwise(F.xxhash64(F.col(id_col), F.lit(1)))
        base = base.withColumn("_key", key).join(
            light.select(F.xxhash64("_digest", "_bytes").alias("_key"), F.col("_digest").alias("_d"), F.col("_bytes").alias("_b"), "_first"), "_key", "left")
        same = F.col("_hot").isNull() & (F.col("_d") == F.col("_digest")) & (F.col("_b") == F.col("_bytes"))
        leader = F.coalesce("_hot", F.when(same, F.col("_first")))
    return base.withColumn("_leader", F.when(leader.eqNullSafe(F.col(id_col)), F.lit(None)).otherwise(leader))


def records(typed: DataFrame, id_col: str = "page_id", url_col: str = "url", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One column ``value``: the record's text up to the empty lines that end it."""
    crlf = F.lit("\r\n")
    name = lambda c: F.concat(F.lit(f"<{RECORD}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    url = F.replace(F.replace(F.col(url_col), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("_leader").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http.cast("binary"), F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("_payload")))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), crlf,
        F.lit("WARC-Record-ID: "), name(id_col), crlf,
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, crlf), F.lit("")),
        F.lit(f"WARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), F.col("_digest"), crlf,
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name("_leader"), crlf)).otherwise(F.lit("")),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    return typed.select(F.concat(head.cast("binary"), block).cast("string").alias("value"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   least_bytes: int = 0, file_records: int = 16_384) -> None:
    """Archives of at most ``file_records`` records under ``path``, each one gzip stream."""
    typed = record_types(pages.select(id_col, url_col, payload_col), id_col, payload_col, least_bytes)
    records(typed, id_col, url_col).write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option(
        "lineSep", "\r\n\r\n").option("maxRecordsPerFile", file_records).text(path)


def opened(path: str):
    """The file system that a URI names (local, hdfs, s3, gs, abfs) and the path in it."""
    from pyarrow import fs

    path = path.replace("s3a://", "s3://", 1) if path.startswith("s3a://") else path
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def inflated(stream) -> Iterator[bytes]:
    """The contents of a gzip file of any number of members, STEP bytes in at a time."""
    unzip = zlib.decompressobj(31)
    while data := stream.read(STEP):
        while data:
            yield unzip.decompress(data, STEP)
            if unzip.eof:
                data, unzip = unzip.unused_data, zlib.decompressobj(31)
            else:
                data = unzip.unconsumed_tail
    yield unzip.flush()  # what the limit on one piece held back


def cut_records(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, whole record) from a stream of inflated pieces. Memory follows the longest record."""
    held = bytearray()

    def more(size: int) -> bool:
        while len(held) < size:
            part = next(parts, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while more(1):
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not more(seen + 1):
                raise ValueError("an archive ends inside a record's header")
        fields = header(bytes(held[:end]))
        whole = end + 4 + int(fields["content-length"]) + 4
        if not more(whole) or held[whole - 4:whole] != b"\r\n\r\n":
            raise ValueError("a record's length does not lead to its end")
        yield fields, bytes(held[:whole])
        del held[:whole]


def header(text: bytes) -> dict[str, str]:
    first, *lines = text.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def normalise(spark: SparkSession, source: str, target: str, level: int = 6) -> DataFrame:
    """Rewrite all archives under ``source`` with one gzip member per record.

    The new archives lie under ``target``; the sidecar index, one row per member
    (``file``, ``record``, ``offset``, ``length``, ``record_id``, ``record_type``), is a
    table in ``target``/index and is returned. Concatenated or already split members
    are inflated alike. A source without archives gives an empty index.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                index = {k: [] for k in ("file", "record", "offset", "length", "record_id", "record_type")}
                old_fs, old = opened(path)
                name = f"{target}/{path.rsplit('/', 1)[1].split('.')[0]}.warc.gz"
                new_fs, new = opened(name)
                own = f"{new}.{uuid.uuid4().hex}"  # a second attempt must not meet half a file
                at = 0
                with old_fs.open_input_stream(old, compression=None, buffer_size=STEP) as stream, new_fs.open_output_stream(own, compression=None) as out:
                    for k, (fields, record) in enumerate(cut_records(inflated(stream))):
                        zipper = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = zipper.compress(record) + zipper.flush()
                        out.write(member)
                        for field, value in zip(index.values(), (name, k, at, len(member), fields["warc-record-id"], fields["warc-type"])):
                            field.append(value)
                        at += len(member)
                new_fs.move(own, new)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(index.values(), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], list(index))

    where = spark._jvm.org.apache.hadoop.fs.Path(target)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(where)
    index = map_batches(files, run, "file string, record bigint, offset bigint, length bigint, record_id string, record_type string")
    index.write.parquet(f"{target}/index")
    return spark.read.schema(index.schema).parquet(f"{target}/index")


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """Fetch the members that ``index`` lists, one by one by position.

    Returns ``id`` (text, NULL if the page had none), ``payload_bytes``, ``payload_digest``,
    ``record_type``, ``refers_to`` and, with ``with_payload``, ``payload`` (NULL for a revisit).
    A response whose payload does not have its digest raises an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stream = None, None
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if file != name:
                    if stream:
                        stream.close()
                    system, path = opened(file)
                    name, stream = file, system.open_input_file(path)
                stream.seek(offset)
                record = zlib.decompress(stream.read(length), 31)
                head, _, rest = record.partition(b"\r\n\r\n")
                fields = header(head)
                http, _, payload = rest[:int(fields["content-length"])].partition(b"\r\n\r\n")
                size = int(next(v for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.lower() == b"content-length"))
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                if fields["warc-type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
                plain = lambda x: x[len(RECORD) + 1:-1] or None if x else None
                found = (plain(fields["warc-record-id"]), size, digest, fields["warc-type"], plain(fields.get("warc-refers-to")),
                         payload if with_payload and fields["warc-type"] == "response" else None)
                for column, value in zip(rows, found):
                    column.append(value)
                if sum(map(len, filter(None, rows[5]))) > STEP:
                    yield batch_of(rows)
                    rows = [[], [], [], [], [], []]
            yield batch_of(rows)
        if stream:
            stream.close()

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
        names = ("id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, kinds)][:5 + with_payload], list(names[:5 + with_payload]))

    return map_batches(index.select("file", "offset", "length"), run,
                       "id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string" + ", payload binary" * with_payload)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  least_bytes: int = 0, level: int = 6) -> DataFrame:
    """Write, normalise and read back; one row per page.

    ``id_col``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``. NULL html is an
    empty payload; a NULL url leaves its field out. Of equal payloads of ``least_bytes`` or more the
    largest id is the response (repeated rows of it all are); groups without any id and smaller
    payloads are all responses. Other columns are ignored; an empty table gives no rows. Archives
    lie in the shared folder; the monolithic ones are deleted once they are rewritten.
    """
    spark = pages.sparkSession
    top = f"{checkpoint_dir(spark)}/stage-{uuid.uuid4().hex}"
    write_archives(pages, f"{top}/raw", id_col, url_col, payload_col, least_bytes)
    index = normalise(spark, f"{top}/raw", f"{top}/split", level)
    raw = spark._jvm.org.apache.hadoop.fs.Path(f"{top}/raw")
    raw.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(raw, True)
    kind = pages.schema[id_col].dataType
    return read_records(index).select(F.col("id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hexed FROM pages),
d AS (SELECT page_id, payload_bytes,
        list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + CAST((('0x' || substr(hexed, 1 + 10 * (k // 8), 10))::BIGINT >> (35 - 5 * (k % 8))::BIGINT) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS leader FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN leader = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN leader <> page_id THEN leader END AS refers_to
FROM g
"""
