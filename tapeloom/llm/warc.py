"""WARC archives of pages, and an index of their captures merged from locally sorted runs.

Every archive is read back as one run of captures sorted by url key and time. Runs are cut at common
boundaries, and each range of keys merges its pieces of all runs with a loser tree, so that ranges laid
end to end are the capture histories in global order.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import parallelism, safe_unions, shared_folder

C = F.col
BREAK = "\r\n"
LEAST_BYTES = 100  # shorter payloads are always stored
RECORDS = 2000  # records of an archive at most
EPOCH, YEAR = 1_704_067_200, 31_536_000
CAPTURE = (
    "url_key string, captured_at bigint, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
    "refers_to bigint, archive string, offset bigint, length bigint"
)
INDEX = f"{CAPTURE}, index_part int, index_pos bigint"
FIELDS = [x.strip().split(" ")[0] for x in CAPTURE.split(",")]


def captured_at(page_id: Column) -> Column:
    """Seconds since 1970 given to a page: pages carry no time of their own."""
    return F.coalesce(F.lit(EPOCH) + F.pmod(page_id, F.lit(YEAR)), F.lit(EPOCH)).cast("bigint")


def url_key(url: str) -> str:
    """Host labels in reverse, then what follows the host up to a fragment."""
    _, found, rest = url.partition("://")
    if not found:
        return ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host = rest[:end].encode().lower().decode()
    return ",".join(reversed(host.split("."))) + ")" + rest[end:].partition("#")[0]


def typed(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes, record_type, refers_to."""
    rows = pages.select(C("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2(C("payload").cast("binary"), 256), "payload_bytes": F.octet_length("payload").cast("bigint")})
    heads = rows.filter(C("payload_bytes") >= LEAST_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("head"), F.count(F.lit(1)).alias("n"))
    heads = heads.filter(C("n") > 1).select("payload_digest", "head")
    again = C("head").isNotNull() & ~C("page_id").eqNullSafe(C("head"))
    out = rows.join(heads, "payload_digest", "left")
    return out.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, C("head"))}).drop("head")


def _record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page "), F.coalesce(page_id.cast("string"), F.lit(""))))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def record(rows: DataFrame) -> DataFrame:
    """value: the text of each row's WARC record, without the two line ends that close it."""

    def field(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(BREAK))).otherwise("")

    revisit = C("record_type") == "revisit"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), C("payload_bytes").cast("string"), F.lit(BREAK * 2)
    )
    block = F.concat("http", F.when(revisit, "").otherwise(C("payload")))
    stamp = F.date_format(F.timestamp_seconds(captured_at(C("page_id"))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(
        F.lit(f"WARC/1.1{BREAK}"),
        field("WARC-Type", C("record_type")),
        field("WARC-Record-ID", _record_id(C("page_id"))),
        field("WARC-Date", stamp),
        field("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), C("payload_digest"))),
        field("WARC-Refers-To", F.when(revisit, _record_id(C("refers_to")))),
        field("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        field("X-Page-Id", C("page_id").cast("string")),
        field("X-Captured-At", captured_at(C("page_id")).cast("string")),
        field("X-Refers-To-Page-Id", C("refers_to").cast("string")),
        F.lit(f"Content-Type: application/http; msgtype=response{BREAK}"),
        field("Content-Length", F.octet_length("block").cast("string")),
        F.lit(BREAK),
    )
    return rows.withColumn("http", http).withColumn("block", block).select(F.concat(head, C("block")).alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    """One gzipped WARC file per task and ``RECORDS`` records; a record ends in two line ends, which separate the writer's rows."""
    out = record(typed(pages)).write.option("lineSep", BREAK * 2).option("compression", "gzip")
    out.option("maxRecordsPerFile", RECORDS).text(path)


def parsed(archive: str, content: bytes) -> Iterator[tuple]:
    """Captures of one archive, in the order of its records."""
    data, at = gzip.decompress(content), 0
    while at < len(data):
        body = data.index(b"\r\n\r\n", at) + 4
        lines = data[at : body - 4].decode().split(BREAK)[1:]
        head = dict(line.split(": ", 1) for line in lines)
        end = body + int(head["Content-Length"])
        payload = data.index(b"\r\n\r\n", body) + 4
        stored = head["WARC-Type"] == "response"
        http = dict(line.split(": ", 1) for line in data[body : payload - 4].decode().split(BREAK)[1:])
        digest = hashlib.sha256(data[payload:end]).hexdigest() if stored else head["WARC-Payload-Digest"].removeprefix("sha256:")
        size = end - payload if stored else int(http["Content-Length"])
        page, refers = head.get("X-Page-Id"), head.get("X-Refers-To-Page-Id")
        yield (
            url_key(head.get("WARC-Target-URI", "")), int(head["X-Captured-At"]), page and int(page), size, digest, head["WARC-Type"],
            refers and int(refers), archive, at, end - at,
        )
        at = end + 4


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


class LoserTree:
    """Merges sorted runs; each inner node holds the loser of the match below it."""

    def __init__(self, runs: list[Iterable[tuple]]) -> None:
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.heads: list[tuple | None] = [None] * self.k
        for n in range(len(self.runs)):
            self._advance(n)
        self.losers = [-1] * self.k
        self.winner = self._play(1) if self.k > 1 else 0

    def _advance(self, n: int) -> None:
        row = next(self.runs[n], None) if n < len(self.runs) else None
        self.heads[n] = row and (_order(row), row)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x[0], a) < (y[0], b))

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        a, b = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[self.winner]) is not None:
            yield head[1]
            self._advance(self.winner)
            champion, node = self.winner, (self.winner + self.k) // 2
            while node >= 1:
                if self._beats(self.losers[node], champion):
                    champion, self.losers[node] = self.losers[node], champion
                node //= 2
            self.winner = champion


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    return pa.schema([(n, kinds[k]) for n, k in (x.strip().split(" ") for x in ddl.split(","))])


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            name = path.as_py().rsplit("/", 1)[-1]
            yield from _batches(sorted(parsed(name, content.as_py()), key=_order), _schema(CAPTURE))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            runs.setdefault(row[7], []).append(row)
    part = TaskContext.get().partitionId()
    yield from _batches(((*row, part, k) for k, row in enumerate(LoserTree(list(runs.values())))), _schema(INDEX))


def capture_index(archives: DataFrame) -> DataFrame:
    """The merged index of archive files (``path``, ``content``); index_part and index_pos give the global order.

    A range holds about as many captures as any other, also where one url has a large share, because
    time and page_id take part in the cuts. Only index rows move, never payloads.
    """
    runs = archives.select("path", "content").mapInArrow(_runs, CAPTURE)
    order = ["url_key", "captured_at", "page_id"]
    ranged = runs.repartitionByRange(parallelism(archives.sparkSession), *order)
    return ranged.sortWithinPartitions("archive", *order, "offset").mapInArrow(_merged, INDEX)


def archived(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the pages as WARC files below ``path`` (the shared folder, if not given), reads them back and indexes them.

    One row per page, repeated rows included. Of equal payloads of at least ``LEAST_BYTES`` bytes the
    row with the smallest page_id is a response and the others revisit it; rows that share that
    page_id are all responses, and so are all rows when none of them has an id. Null payloads are
    empty, null urls have an empty key and line ends inside urls are dropped. Other columns are
    ignored; an empty table gives an empty index.
    """
    spark = pages.sparkSession
    safe_unions(spark)
    path = path or shared_folder(spark, "warc")
    write_archives(pages, path)
    return capture_index(spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path))


WARC_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
h AS (SELECT payload_digest, min(page_id) AS head FROM d WHERE payload_bytes >= {LEAST_BYTES} GROUP BY 1),
t AS (SELECT d.*, CASE WHEN head IS NOT NULL AND page_id IS DISTINCT FROM head THEN head END AS refers_to FROM d LEFT JOIN h USING (payload_digest))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to,
    ({EPOCH} + coalesce(page_id, 0) % {YEAR})::BIGINT AS captured_at
FROM t
"""
