"""Dictionary-compressed WARC archives (.warc.zst), written and read by Spark tasks.

Layout of an archive: a skippable frame (magic 0x184D2A5D) that holds the
Zstandard dictionary, then one frame per WARC record compressed with it, the
first of them a ``warcinfo`` record.  Spark's text writer puts the frames into
files through its own commit protocol, so that archives can lie in any store
that Spark writes to and a lost or repeated task leaves none of them damaged;
then the files get their extension.  The writer's line separator is an empty
skippable frame, which every Zstandard reader passes over.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import without

DICTIONARY_MAGIC = 0x184D2A5D
#: Magic 0x184D2A50 and length 0: eight bytes below 0x80, so a legal text separator.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
#: Equal payloads below this size are all stored.
REVISIT_BYTES = 100
#: Dictionary size, and how many bytes of an archive's records it is trained on (evenly spaced records).
DICTIONARY_BYTES, TRAINING_BYTES = 32 << 10, 3 << 20
#: Payload bytes an archive holds: the memory a task needs is a small multiple.
ARCHIVE_BYTES = 16 << 20


def plan_records(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """Add ``payload`` binary, ``digest``, ``record_type`` and ``refers_to`` to the pages.

    Of records with equal payloads of at least ``REVISIT_BYTES`` bytes the one
    with the smallest id is the response; the others revisit it.  Where all
    their ids are null, or ids repeat, rows with the smallest id are all
    responses.  Equality is that of SHA-256.  Digests are
    counted before they meet, so a payload that a third of the pages share
    costs a task one row for each task before it.
    """
    pages = without(pages, "payload", "digest", "payload_bytes", "record_type", "refers_to")
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    full = (
        pages.withColumn("payload", payload)
        .withColumn("digest", F.sha2("payload", 256))
        .withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    )
    shared = (
        full.where(F.col("payload_bytes") >= REVISIT_BYTES)
        .groupBy(F.col("digest").alias("__digest"))
        .agg(F.min(id_col).alias("__first"), F.count(F.lit(1)).alias("__n"))
        .where("__n > 1")
        .drop("__n")
    )
    revisit = F.col("__digest").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("__first"))
    return (
        full.join(shared, (F.col("digest") == F.col("__digest")) & (F.col("payload_bytes") >= REVISIT_BYTES), "left")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("__first")))
        .drop("__digest", "__first")
    )


def record_id(value: str | None, digest: str) -> str:
    """Rows that repeat an id have records of their own unless their payloads are equal, too."""
    return f"urn:page:{'null' if value is None else '=' + quote(value, safe='')}:{digest[:32]}"


def _parse_id(urn: str | None) -> str | None:
    value = (urn or "").strip("<>").split(":")[2:3]
    return None if value in ([], ["null"]) else unquote(value[0][1:])


def _line(value) -> str:
    return "" if value is None else str(value).replace("\r", "%0D").replace("\n", "%0A")


def warc_record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, date: str) -> bytes:
    """One WARC/1.1 record.  A revisit carries digest and length of the full payload, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id(page_id, digest)}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_line(url)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{record_id(refers_to, digest)}>",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warcinfo(records: list[bytes], date: str) -> bytes:
    """The record that describes an archive; its id follows from the archive's records."""
    seen = hashlib.sha256()
    for r in records:
        seen.update(r)
    block = b"software: tabprofile\r\nformat: WARC File Format 1.1\r\n"
    head = [
        "WARC/1.1",
        "WARC-Type: warcinfo",
        f"WARC-Record-ID: <urn:archive:{seen.hexdigest()[:32]}>",
        f"WARC-Date: {date}",
        "Content-Type: application/warc-fields",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def build_dictionary(records: list[bytes]) -> bytes:
    """Train on records evenly spaced over the archive; empty when there are too few to train on."""
    total = sum(map(len, records))
    step = max(1, -(-total // TRAINING_BYTES))
    samples = records[::step]
    if len(samples) < 8 or sum(map(len, samples)) < 8 * 1024:
        return b""
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:  # records too small or too alike
        return b""


def archive_frames(records: list[bytes], level: int = 3) -> Iterator[bytes]:
    """The frames of one archive, the dictionary's first."""
    trained = build_dictionary(records)
    yield struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained
    extra = {"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}
    packer = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True, **extra)
    for r in records:
        yield packer.compress(r)


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of one archive."""
    if not data:
        return
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("an archive starts with its dictionary")
    trained = data[8 : 8 + size]
    extra = {"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}
    unpack = zstandard.ZstdDecompressor(**extra)
    at, view = 8 + size, memoryview(data)
    while at < len(data):
        (magic,) = struct.unpack_from("<I", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:  # a skippable frame
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        one = unpack.decompressobj()
        out = one.decompress(view[at:])
        at = len(data) - len(one.unused_data)
        yield out


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    date: str = "1970-01-01T00:00:00Z",
    archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Write every page as a record to archives ``part-*.warc.zst`` below ``path``.

    A task turns to a new archive, with a dictionary of its own, each
    ``archive_bytes``, so its memory is bounded.  Payloads are shuffled once
    at most, to meet the first of their digest; where Spark sees that
    repeated digests are few and broadcasts them, not at all.  Null payloads
    are empty, a null URL is an empty field, extra columns are left out; rows
    with a null id have records of the id ``null``, rows that repeat an id
    each their own; an empty table writes no records.
    """
    cols = [id_col, url_col, "payload", "digest", "record_type", "refers_to"]
    planned = plan_records(pages.select(id_col, url_col, payload_col), id_col, payload_col).select(*cols)
    for c in (id_col, "refers_to"):  # a column with nulls would reach Python as doubles
        planned = planned.withColumn(c, F.col(c).cast("string"))

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush() -> pd.DataFrame:
            return pd.DataFrame({"archive": pd.Series([_joined(held, date)], dtype=object)})

        for batch in batches:
            for page_id, url, payload, digest, kind, ref in batch.itertuples(index=False, name=None):
                rec = warc_record(page_id, url, bytes(payload), digest, kind, ref, date)
                held.append(rec)
                size += len(rec)
                if size >= archive_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    (
        planned.mapInPandas(frames, "archive binary")
        .select(F.col("archive").cast("string").alias("value"))
        .write.option("lineSep", SEPARATOR)
        .option("maxRecordsPerFile", 1)
        .mode("errorifexists")
        .text(path)
    )
    _rename(pages.sparkSession, path)


def _joined(records: list[bytes], date: str) -> bytes:
    """An archive; its dictionary is built from its records, the one that describes it included."""
    return SEPARATOR.encode().join(archive_frames([warcinfo(records, date), *records]))


def _rename(spark: SparkSession, path: str) -> None:
    """Give the committed files their extension: names only, through the file system of the path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for one in files.listStatus(folder):
        name = one.getPath().getName()
        if name.startswith("part-") and name.endswith(".txt"):
            files.rename(one.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(".txt") + ".warc.zst"))


def read_archives(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """All records of the archives below ``path``.

    Columns: page_id, url string, record_type string, refers_to,
    payload_digest string, payload_bytes long (as the header has them),
    payload binary (empty for a revisit).  Ids are of ``id_type``, any that
    can be read from its text (records hold the id percent-encoded).  A response whose payload does not
    give its digest and length fails the job.
    """
    schema = "page_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for raw in read_archive(bytes(content)):
                    f, payload = parse_record(raw)
                    if f["warc-type"] == "warcinfo":
                        continue
                    digest, length = f["warc-payload-digest"].removeprefix("sha256:"), int(f["x-payload-length"])
                    if f["warc-type"] == "response" and (
                        len(payload) != length or hashlib.sha256(payload).hexdigest() != digest
                    ):
                        raise ValueError(f"record {f['warc-record-id']} is damaged")
                    rows.append(
                        (_parse_id(f["warc-record-id"]), f["warc-target-uri"], f["warc-type"], _parse_id(f.get("warc-refers-to")), digest, length, payload)
                    )
                    if len(rows) == 1000:
                        yield _frame(rows)
                        rows = []
                if rows:
                    yield _frame(rows)

    return files.mapInPandas(records, schema).withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(
        rows, columns=["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    )
    return out.astype({"page_id": object, "refers_to": object})


def archive_round_trip(pages: DataFrame, folder: str, id_col: str = "page_id", **options) -> DataFrame:
    """Write the pages to fresh archives below ``folder`` and read them back, with ids of the type that they have."""
    path = f"{folder}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, id_col=id_col, **options)
    return read_archives(pages.sparkSession, path, pages.schema[id_col].dataType.simpleString())
