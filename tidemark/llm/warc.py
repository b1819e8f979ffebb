"""WARC files as a Spark data source.

Read: ``spark.read.format("warc").load(folder)``; write: ``df.write.format("warc").mode("append").save(folder)``.
Files are gzip members, one per record, so a record can be skipped without looking at the others. A file is a
partition. Filters on record_type, record_id, target_uri and payload_digest are decided on the headers alone; a
record that they refuse, or any record when the option ``payload`` is ``false``, is skipped: files written here have
the offsets of their records beside them, so its payload is neither read on nor inflated; in a plain file it is passed
over; in a foreign compressed file, which tells no offsets, it is inflated piece by piece and not kept.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from tidemark.llm.common import shared_path, small, stored

SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, refers_to string, payload_digest string, content_length long, payload binary"
HEADERS = {
    "WARC-Record-ID": "record_id",
    "WARC-Type": "record_type",
    "WARC-Target-URI": "target_uri",
    "WARC-Date": "warc_date",
    "WARC-Refers-To": "refers_to",
    "WARC-Payload-Digest": "payload_digest",
}
COLUMN_OF = {name.lower(): column for name, column in HEADERS.items()}
PUSHED = ("record_id", "record_type", "target_uri", "refers_to", "payload_digest")
CHUNK = 1 << 20
PIECE = 1 << 16
BATCH_BYTES = 8 << 20
INDEX = "committed-"
OFFSETS = ".offsets"


class Folder:
    """A folder named by a path or URI: plain files where it is local or mounted, else the file system of its scheme."""

    def __init__(self, uri: str):
        uri = uri.rstrip("/")
        self.system = None
        self.root = re.sub("^file:(//)?(?=/)", "", uri)
        if "://" in self.root:
            self.system, self.root = fs.FileSystem.from_uri(uri)

    def names(self) -> list[str]:
        if self.system is None:
            return sorted(x.name for x in os.scandir(self.root) if x.is_file())
        return sorted(x.base_name for x in self.system.get_file_info(fs.FileSelector(self.root)) if x.type == fs.FileType.File)

    def reading(self, name: str) -> BinaryIO:
        path = f"{self.root}/{name}"
        return open(path, "rb") if self.system is None else self.system.open_input_file(path)

    def writing(self, name: str) -> BinaryIO:
        path = f"{self.root}/{name}"
        if self.system is None:
            os.makedirs(self.root, exist_ok=True)
            return open(path, "wb")
        self.system.create_dir(self.root, recursive=True)
        return self.system.open_output_stream(path, compression=None)

    def delete(self, name: str) -> None:
        path = f"{self.root}/{name}"
        os.unlink(path) if self.system is None else self.system.delete_file(path)


@dataclass
class WarcFile(InputPartition):
    """One file of a plan."""

    name: str
    indexed: bool = False


class Members:
    """Bytes of a file of gzip members (or of plain records), read and inflated step by step.

    At most ``CHUNK`` bytes are read and inflated at once, so what is held is the record that is asked for and little
    more, however far a member would inflate.
    """

    def __init__(self, stream: BinaryIO):
        self.stream, self.out, self.at = stream, bytearray(), 0
        self.chunk, self.start, self.read = stream.read(CHUNK), 0, 0  # raw bytes, where they start in the file, how many are used
        self.zipped = self.chunk[:2] == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31) if self.zipped else None

    def _raw(self, n: int) -> bytes:
        """Up to n raw bytes, not yet used."""
        if self.read == len(self.chunk):
            self.chunk, self.start, self.read = self.stream.read(CHUNK), self.start + len(self.chunk), 0
        return self.chunk[self.read : self.read + n]

    def _more(self) -> bool:
        """Add to ``out``; False at the end of the file."""
        if self.at > len(self.out) // 2:
            del self.out[: self.at]
            self.at = 0
        if not self.zipped:
            data = self._raw(CHUNK)
            self.read += len(data)
            self.out += data
            return bool(data)
        if self.inflate.eof:
            self.inflate = zlib.decompressobj(31)
        data = self._raw(PIECE)
        made = self.inflate.decompress(data, CHUNK)
        self.read += len(data) - len(self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail)
        self.out += made
        return bool(data or made)

    def until(self, mark: bytes, most: int = CHUNK) -> bytes | None:
        """Bytes up to and without ``mark``, at most ``most``; None at the end of the file."""
        begin = self.at
        while (found := self.out.find(mark, begin)) < 0:
            held = len(self.out) - self.at
            if held > most:
                raise ValueError(f"a header of more than {most} bytes")
            if not self._more():
                if self.out[self.at :].strip(b"\x00\r\n\t "):
                    raise ValueError("a header ends early")
                return None
            begin = self.at + max(0, held - len(mark) + 1)
        head, self.at = bytes(self.out[self.at : found]), found + len(mark)
        return head

    def take(self, n: int) -> bytes:
        while len(self.out) - self.at < n and self._more():
            pass
        found = bytes(memoryview(self.out)[self.at : self.at + n])
        self.at += len(found)
        if len(found) < n:
            raise ValueError(f"a record ends after {len(found)} of {n} bytes")
        return found

    def skip(self, n: int) -> None:
        """Pass over bytes without keeping them; those of a plain file aren't read either."""
        while n:
            step = min(n, len(self.out) - self.at)
            self.at, n = self.at + step, n - step
            if n and not self.zipped and n > len(self.chunk) - self.read:
                self.jump(self.start + self.read + n)
                return
            if n and not self._more():
                raise ValueError(f"a record ends {n} bytes early")

    def jump(self, offset: int) -> None:
        """Go on with the member (or record) at an offset of the file."""
        self.out, self.at = bytearray(), 0
        if self.zipped:
            self.inflate = zlib.decompressobj(31)
        if self.start <= offset <= self.start + len(self.chunk):
            self.read = offset - self.start
        else:
            self.stream.seek(offset)
            self.chunk, self.start, self.read = b"", offset, 0


def header_of(head: bytes) -> tuple[dict, int]:
    """Columns of a record header, whose names may stand in any case, and the length of its payload."""
    row: dict = {"payload": None}
    length = None
    for line in head.decode("utf-8", "replace").split("\r\n"):
        name, _, value = line.partition(":")
        name = name.strip().lower()
        if name in COLUMN_OF:
            row[COLUMN_OF[name]] = value.strip()
        elif name == "content-length":
            length = int(value)
    if length is None or length < 0:
        raise ValueError("a record without a length")
    row["content_length"] = length
    return row, length


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.schema = options["path"], schema
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.wanted: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | EqualNullSafe) and len(f.attribute) == 1 and f.attribute[0] in PUSHED and f.value is not None:
                self.wanted.append((f.attribute[0], frozenset([f.value])))
            elif isinstance(f, In) and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                self.wanted.append((f.attribute[0], frozenset(f.value)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        folder = Folder(self.path)
        names = folder.names()
        listed: set[str] = set()
        for name in (indexes := [n for n in names if n.startswith(INDEX)]):
            with folder.reading(name) as f:
                listed |= set(json.loads(f.read()))
        there = set(names)
        return [WarcFile(n, n + OFFSETS in there) for n in names if n.endswith((".warc", ".warc.gz")) and (not indexes or n in listed)]

    def read(self, partition: WarcFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a plan without files
            return
        schema = pa.schema([(f.name, {"long": pa.int64(), "bigint": pa.int64(), "binary": pa.binary()}.get(f.dataType.simpleString(), pa.string())) for f in self.schema.fields])
        rows: list[dict] = []
        held = 0
        folder = Folder(self.path)
        offsets: list[int] = []
        if partition.indexed:
            with folder.reading(partition.name + OFFSETS) as f:
                offsets = array("q", f.read()).tolist()
        with folder.reading(partition.name) as stream:
            source = Members(stream)
            n = 0
            while (head := source.until(b"\r\n\r\n")) is not None:
                row, length = header_of(head.lstrip(b"\r\n"))
                n += 1
                wanted = all(row.get(c) in values for c, values in self.wanted)
                if wanted:
                    if self.payload:
                        row["payload"] = source.take(length)
                    rows.append(row)
                    held += 500 + len(row["payload"] or b"")
                if wanted and self.payload:
                    source.skip(4)
                elif n < len(offsets):
                    source.jump(offsets[n])
                elif offsets:
                    break
                else:
                    source.skip(length + 4)
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)


@dataclass
class Written(WriterCommitMessage):
    """The file that a task attempt wrote."""

    name: str


class WarcWriter(DataSourceWriter):
    """A task attempt writes a file of its own; a read sees a file once the commit has listed it."""

    def __init__(self, options: dict[str, str]):
        self.path, self.level = options["path"], int(options.get("level", 6))

    def write(self, iterator: Iterator[Row]) -> Written:
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        offsets, at = array("q"), 0
        folder = Folder(self.path)
        with folder.writing(name) as out:
            for row in iterator:
                offsets.append(at)
                given = row.asDict()
                payload = bytes(given.get("payload") or b"")
                lines = ["WARC/1.1"]
                lines += [f"{h}: {one_line(given[c])}" for h, c in HEADERS.items() if given.get(c) is not None]
                lines += ["Content-Type: application/octet-stream", f"Content-Length: {len(payload)}"]
                pack = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                for part in ("\r\n".join(lines).encode() + b"\r\n\r\n", payload, b"\r\n\r\n"):
                    at += put(out, pack.compress(part))
                at += put(out, pack.flush())
        with folder.writing(name + OFFSETS) as out:
            out.write(offsets.tobytes())
        return Written(name if offsets else "")

    def commit(self, messages: list[Written | None]) -> None:
        with Folder(self.path).writing(f"{INDEX}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([m.name for m in messages if m and m.name]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and m.name:
                Folder(self.path).delete(m.name)
                Folder(self.path).delete(m.name + OFFSETS)


def put(out: BinaryIO, data: bytes) -> int:
    """Write bytes; their number."""
    out.write(data)
    return len(data)


def one_line(value: object) -> str:
    """A header value: line ends and control characters, which would end the header, become spaces."""
    return "".join(c if c >= " " else " " for c in str(value))


class WarcSource(DataSource):
    """Format ``warc``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only appended to")
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known and let filters reach its reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # reads are planned later, so it stays set
    spark.dataSource.register(WarcSource)


def records_of(pages: DataFrame, least: int = 100, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """WARC records of pages: response, or revisit of the equal payload (``least`` bytes or more) of the smallest id.

    A null html is an empty payload. Of rows that repeat an id with an equal payload all are response if the id is the
    smallest; each row stays a record. A row without an id is response, and nothing refers to it. Ids are whole numbers.
    Digests decide equality (SHA-256). Digest counts are summed before they are joined, and only repeated digests are;
    payloads are shuffled only where these were counted to be too many to broadcast.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    repeated = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = stored(repeated.where("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("same"), "first"), "repeated-payloads")
    revisit = F.coalesce(F.col("page_id") > F.col("first"), F.lit(False))
    return rows.join(small(repeated), F.col("digest") == F.col("same"), "left").select(
        F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("warc_date"),
        F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), F.col("digest")).alias("payload_digest"),
        F.lit(None).cast("long").alias("content_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def page_of(record_id: Column) -> Column:
    """The page id in a record id."""
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """Write pages as archives in the shared folder, read these back, and report each record.

    Responses are read with payloads, from which size and digest are taken anew; revisits are read from headers only
    and take their size from the response that they refer to, the one of equal digest where an id repeats with unlike
    payloads. An empty table gives no rows.
    """
    spark = pages.sparkSession
    register(spark)
    path = shared_path(spark, "warc")
    records_of(pages, least).write.format("warc").mode("append").save(path)
    response = spark.read.format("warc").load(path).where(F.col("record_type") == "response")
    response = response.select("record_id", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type")
    response = stored(response, "responses")
    revisit = spark.read.format("warc").option("payload", "false").load(path).where(F.col("record_type") == "revisit")
    revisit = stored(revisit.select("record_id", "refers_to", F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "record_type"), "revisits")
    meant = stored(revisit.select(F.col("refers_to").alias("record_id"), "payload_digest").distinct(), "referred")
    of = response.join(small(meant), ["record_id", "payload_digest"], "left_semi").groupBy(F.col("record_id").alias("refers_to"), "payload_digest")
    revisit = revisit.join(small(stored(of.agg(F.max("payload_bytes").alias("payload_bytes")), "referred-sizes")), ["refers_to", "payload_digest"], "left")
    columns = [page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to")]
    return response.withColumn("refers_to", F.lit(None).cast("string")).select(*columns).unionByName(revisit.select(*columns))


ROUND_TRIP_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN d.page_id > f.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN d.page_id > f.first THEN f.first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
