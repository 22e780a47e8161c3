"""WARC records as a table of chunks.

An archive is rows (archive, record_id, chunk, data, chain, digest): chunk 0 of a record is
its header, the last one its closing line ends, those between hold at most
`size` bytes of payload each. Joined in order, the data of an archive's
records is a WARC/1.1 file. No step copies a whole payload: pieces are views of
the column's buffer, each row carries the digest of what its record holds so
far chained over chunks, and the last row carries the payload's SHA-1.
Payload equality is by SHA-256 and length. A record's identifier is a hash of page, url,
payload and, among repeated rows of an archive, place, so that a task that runs again writes the same.

What decides a record's type moves without payloads, which are shuffled once at
most. `read` takes the rows as they lie in the files. A record that a split
cuts, or whose rows lie elsewhere, is named instead, and only the named records are
shuffled, ordered and read again; one that is still not whole raises an error.
Sizes and digests are those of the payload that was read; a revisit has
those of the response it refers to.

Cases: a null or empty html is an empty payload; a null url is written as
about:invalid; line ends in a url are escaped; a null page_id is written as
an empty identifier and reads back null, and refers only to a null one where all equal
records are null; pages repeated with equal payload and largest page_id are all responses; an
empty table gives no rows; other columns, of any name, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.llm.common import stash

CHUNK = 64 << 10
#: Equal payloads from this many bytes on become revisits.
LEAST_BYTES = 0
CHUNKS = "archive long, record_id string, chunk int, data binary, chain binary, digest string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
ROWS_A_BATCH = 256
END = b"\r\n\r\n"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def views(payload: pa.Buffer | None, size: int) -> Iterator[memoryview]:
    whole = memoryview(payload) if payload is not None else memoryview(b"")
    for at in range(0, len(whole), size):
        yield whole[at : at + size]


def header(row: dict, record_id: str, stored: int) -> bytes:
    """The WARC header of a record. A revisit stores no payload but says how long it is."""
    page = "" if row["page_id"] is None else row["page_id"]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <{record_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {(row['url'] or 'about:invalid').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        f"X-Page-Id: {page}",
        f"X-Payload-Length: {row['payload_bytes']}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if row["record_type"] == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {row['refers_to']}"]
    return "\r\n".join([*lines, f"Content-Length: {stored}", "", ""]).encode("utf-8", "surrogatepass")


def name_of(row: dict, place: int) -> str:
    """A record's identifier, the same whenever its archive is written again."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr((row['page_id'], row['url'], row['payload_digest'], place)))}"


def record_chunks(row: dict, payload: pa.Buffer | None, archive: int, place: int, size: int) -> Iterator[tuple]:
    record_id = name_of(row, place)
    revisit = row["record_type"] == "revisit"
    digest, chain, k = hashlib.sha1(), b"", 0
    pieces = iter(()) if revisit else views(payload, size)
    for data in (header(row, record_id, 0 if revisit else row["payload_bytes"]), *pieces, END):
        if k and data is not END:
            digest.update(data)
        chain = hashlib.sha1(chain + hashlib.sha1(data).digest()).digest()
        yield archive, record_id, k, bytes(data), chain, base32_sha1(digest.digest()) if data is END and not revisit else None
        k += 1


def writer(size: int):
    kinds = pa.schema([("archive", pa.int64()), ("record_id", pa.string()), ("chunk", pa.int32()), ("data", pa.binary()), ("chain", pa.binary()), ("digest", pa.string())])

    def write_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        archive = context.partitionId() if context else 0
        places: Counter = Counter()
        for batch in batches:
            rows = batch.drop_columns(["html"]).to_pylist()
            held: list[tuple] = []
            for row, value in zip(rows, batch.column("html"), strict=True):
                row["payload_digest"] = base32_sha1(bytes.fromhex(row["payload_digest"]))
                mark = hash((row["page_id"], row["url"], row["payload_digest"]))
                for chunk in record_chunks(row, value.as_buffer(), archive, places[mark], size):
                    held.append(chunk)
                    if len(held) == ROWS_A_BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds.types, strict=True)], schema=kinds)
                        held = []
                places[mark] += 1
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds.types, strict=True)], schema=kinds)

    return write_batches


def typed(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest (SHA-1 in hex), record_type, refers_to."""
    html = F.coalesce("html", F.lit(""))
    whole = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html, 256).alias("sha256"))
    # page, size and digest of each payload are all that is needed to find equal ones; payloads then meet what was found, evenly by page
    light = whole.select("page_id", "payload_bytes", "sha256")
    first = light.groupBy(F.col("sha256").alias("of"), F.col("payload_bytes").alias("of_bytes")).agg(F.max("page_id").alias("largest"))
    found = light.distinct().join(first, (F.col("sha256") == F.col("of")) & (F.col("payload_bytes") == F.col("of_bytes")))
    found = found.select(F.col("page_id").alias("of_page"), F.col("sha256").alias("of_sha256"), "largest")
    joined = whole.join(found, F.col("page_id").eqNullSafe(F.col("of_page")) & (F.col("sha256") == F.col("of_sha256")))
    again = (F.col("payload_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return joined.select("page_id", "url", "html", "payload_bytes", F.sha1("html").alias("payload_digest"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("largest")).alias("refers_to"))


def write(pages: DataFrame, least_bytes: int = LEAST_BYTES, size: int = CHUNK) -> DataFrame:
    """The chunk table, written to the shared folder."""
    return stash(typed(pages, least_bytes).mapInArrow(writer(size), CHUNKS), "warc")


def parse(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return dict(line.split(": ", 1) for line in lines[1:] if line)


class Reader:
    """One record at a time, chunk by chunk. A record that does not come whole goes to `broken`."""

    def __init__(self):
        self.key, self.broken = None, []

    def give_up(self, key: tuple) -> None:
        if not self.broken or self.broken[-1] != key:
            self.broken.append(key)

    def close(self) -> None:
        if self.key is not None:
            self.give_up(self.key)
        self.key = None

    def add(self, key: tuple, k: int, data: bytes, chain: bytes) -> tuple | None:
        if k == 0:
            self.close()
            self.key, self.fields, self.digest, self.size, self.chain, self.next = key, parse(data), hashlib.sha1(), 0, b"", 0
        if key != self.key or k != self.next:
            self.close()
            self.give_up(key)
            return None
        self.next += 1
        self.chain = hashlib.sha1(self.chain + hashlib.sha1(data).digest()).digest()
        if self.chain != chain:
            raise ValueError(f"chunk {k} of {key} is damaged")
        if k == 0:
            return None
        left = int(self.fields["Content-Length"]) - self.size
        if left > 0:
            self.digest.update(data)
            self.size += len(data)
            return None
        if left < 0 or data != END:
            raise ValueError(f"{key} does not end where it says")
        return self.done()

    def done(self) -> tuple:
        f, number = self.fields, lambda x: int(x) if x else None
        said, read, key = f["WARC-Payload-Digest"].removeprefix("sha1:"), base32_sha1(self.digest.digest()), self.key
        self.key = None
        if f["WARC-Type"] == "response":
            if read != said:
                raise ValueError(f"payload of {key} is damaged")
            return number(f.get("X-Page-Id", "")), self.size, read, "response", None
        return number(f.get("X-Page-Id", "")), None, said, f["WARC-Type"], number(f.get("X-Refers-To-Page-Id", ""))


def reader(last: bool):
    """Records, and the names of those that did not come whole; these are an error in the last pass."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "record_id"]

    def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Reader()

        def out(rows: list[tuple]) -> pa.RecordBatch:
            if last and state.broken:
                raise ValueError(f"record {state.broken[0]} is not whole")
            rows = [(*r, None, None) for r in rows] + [(None, None, None, None, None, *key) for key in state.broken]
            state.broken = []
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

        for batch in batches:
            columns = [batch.column(c) for c in ("archive", "record_id", "chunk", "data", "chain")]
            rows = []
            for i in range(batch.num_rows):
                archive, record_id, *rest = (c[i].as_py() for c in columns)
                if record := state.add((archive, record_id), *rest):
                    rows.append(record)
            yield out(rows)
        state.close()
        yield out([])

    return read_batches


def read(chunks: DataFrame) -> DataFrame:
    """RECORDS of a chunk table, whose rows may stand in any order. Chunks and payloads are verified."""
    rows = chunks.select("archive", "record_id", "chunk", "data", "chain")
    kinds = f"{RECORDS}, archive long, record_id string"
    first = stash(rows.mapInArrow(reader(False), kinds), "records")
    names = first.filter("record_id is not null").select(F.col("archive").alias("of_archive"), F.col("record_id").alias("of")).distinct()
    cut = rows.join(names, (F.col("archive") == F.col("of_archive")) & (F.col("record_id") == F.col("of")), "left_semi")
    again = cut.repartition("archive", "record_id").sortWithinPartitions("archive", "record_id", "chunk").mapInArrow(reader(True), kinds)
    records = first.filter("record_id is null")
    if not names.isEmpty():
        records = records.unionAll(again)
    own = records.filter("record_type = 'response'").groupBy(F.col("page_id").alias("of"), F.col("payload_digest").alias("of_digest")).agg(F.first("payload_bytes").alias("of_bytes"))
    whole = records.join(own, F.when(F.col("record_type") == "revisit", F.col("refers_to")).otherwise(F.col("page_id")).eqNullSafe(F.col("of")) & (F.col("payload_digest") == F.col("of_digest")), "left")
    size = F.coalesce("payload_bytes", "of_bytes", F.raise_error(F.concat(F.lit("no response for the revisit of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))).cast("long"))
    return whole.select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def payloads(chunks: DataFrame) -> DataFrame:
    """archive, record_id, chunk, data: the pieces of payloads, which joined by chunk number are each response's payload."""
    end = F.col("data") == F.lit(END)
    return chunks.filter((F.col("chunk") > 0) & ~(end & (F.col("digest").isNotNull() | (F.col("chunk") == 1)))).select("archive", "record_id", "chunk", "data")
