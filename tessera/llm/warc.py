"""Operator 2: WARC archives, and a capture index merged from locally sorted runs.

write_archives() turns page rows into WARC/1.1 files with Spark's own text writer, so task
retries and any Hadoop file system are its business. A record whose payload equals that of
a record with a larger key is a revisit of the largest one, unless the payload is smaller
than min_bytes. read_archives() parses whole files (plain, or gzip with one member per
record or one in all) by Content-Length, so payloads may hold anything.

capture_runs() writes, per task, one run of index entries sorted by URL key (host labels
reversed, then path), timestamp and identifier. merge_runs() then merges all runs: the key
space is cut into ranges of about RANGE_ROWS entries from sampled keys, and in each range a
loser tree merges the slices of the k runs that it got, each still in order. A URL with
very many captures is cut too, since timestamp and identifier are part of the key. A
range's slices are held as Arrow columns; the heads of the runs alone are compared.

Cases: a null payload is an empty one; a null URL counts as an empty one; captures of one
URL and time are ordered by identifier; rows that repeat an identifier and payload are
written as often as they come; extra columns are ignored; an empty table writes no record
and gives no rows. Keys are not null.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import shared_dir, written

CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
FILE_BYTES = 32 << 20  # about the size of an archive file
LARGE = 1 << 18  # bytes; larger payloads go to files of their own, fewer in each
MOST_BYTES = 1_500_000_000
RANGE_ROWS = 20_000
EPOCH = 1_704_067_200  # 2024-01-01T00:00:00Z, the time of the capture with key 0
CAPTURE = "urlkey string, ts string, key long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, file string, at long"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of SHA-1: four groups of 40 bits, eight characters each."""
    digest = F.sha1(payload)
    parts = []
    for g in range(4):
        bits = F.conv(F.substring(digest, 10 * g + 1, 10), 16, 10).cast("long")
        for k in range(7, -1, -1):
            parts.append(F.substring(F.lit(BASE32), F.shiftright(bits, 5 * k).bitwiseAND(31).cast("int") + 1, F.lit(1)))
    return F.concat(*parts)


def mark_revisits(pages: DataFrame, key: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """pages with payload_bytes, payload_digest and refers_to (null for responses).

    Payloads are equal when their size, SHA-1 and SHA-256 are (SHA-1 alone has known
    collisions). One narrow row per payload is aggregated before the shuffle and joined back;
    the join's skewed partitions can be split, as the aggregate is a written table.
    """
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    known = pages.withColumn("payload_bytes", F.octet_length(body).cast("long")).withColumn("payload_digest", base32_sha1(body))
    known = known.withColumn("_full", F.sha2(body, 256))
    large = known.where(F.col("payload_bytes") >= min_bytes)
    same = ["payload_digest", "payload_bytes", "_full"]
    last = large.groupBy(*same).agg(F.max(key).alias("_last"), F.count(F.lit(1)).alias("_n"))
    last = written(last.where("_n > 1").drop("_n"), "payloads")
    joined = known.join(last, same, "left")
    return joined.withColumn("refers_to", F.when(F.col("_last") != F.col(key), F.col("_last"))).drop("_last", "_full")


def _id(key: Column) -> Column:
    """A record id that holds the key: urn:uuid with its 16 hexadecimal digits at the end."""
    h = F.lower(F.lpad(F.hex(key), 16, "0"))
    return F.concat(F.lit("<urn:uuid:00000000-0000-4000-"), F.substring(h, 1, 4), F.lit("-"), F.substring(h, 5, 12), F.lit(">"))


def _time(key: Column) -> Column:
    return F.date_format(F.timestamp_seconds(key + EPOCH), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def write_archives(pages: DataFrame, path: str, key: str, url: str, payload: str, min_bytes: int = 0) -> None:
    """Writes one WARC record per row below path. Capture times are EPOCH + key seconds."""
    rows = mark_revisits(pages.select(key, url, payload), key, payload, min_bytes)
    revisit = F.col("refers_to").isNotNull()
    k = F.col(key)
    place = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "[\\r\\n]", "")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(CRLF + CRLF),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.coalesce(F.col(payload), F.lit(""))))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: "),
        _id(k),
        F.lit(f"{CRLF}WARC-Date: "),
        _time(k),
        F.lit(f"{CRLF}WARC-Target-URI: "),
        place,
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"),
        F.col("payload_digest"),
        F.when(
            revisit,
            F.concat(
                F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "),
                _id(F.col("refers_to")),
            ),
        ).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: application/http;msgtype=response{CRLF}Content-Length: "),
    )
    # lineSep, which ends every row, is the end of a record
    record = F.concat(header, F.octet_length(F.col("_b")).cast("string"), F.lit(CRLF + CRLF), F.col("_b"))

    def lines(some: DataFrame) -> DataFrame:
        return some.withColumn("_b", block).select(record.alias("value"))

    size = F.coalesce(F.octet_length(F.col(payload)), F.lit(0))
    small = size <= LARGE
    mean, most = pages.select(F.avg(F.when(small, size)), F.max(F.when(~small, size))).first()
    # no file outgrows MOST_BYTES, which is what a reader can hold in one piece
    writes = [(small, min(FILE_BYTES / ((mean or 0.0) + 600), MOST_BYTES / LARGE))]
    if most:
        writes.append((~small, min(FILE_BYTES / LARGE, MOST_BYTES / most)))
    for which, per_file in writes:
        lines(rows.where(which)).write.mode("append").option("lineSep", CRLF * 2).option("maxRecordsPerFile", max(1, int(per_file))).text(path)


_HEAD = re.compile(rb"WARC/1\.[01]\r?\n(.*?)\r?\n\r?\n", re.S)


def _members(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of a plain file, or of each gzip member."""
    if raw[:2] != b"\x1f\x8b":
        yield 0, raw
        return
    view, at = memoryview(raw), 0
    while at < len(raw):
        d, out, next_ = zlib.decompressobj(wbits=31), [], at
        while not d.eof and next_ < len(raw):  # in pieces, since the decompressor copies what it doesn't use
            out.append(d.decompress(view[next_ : next_ + 65_536]))
            next_ += 65_536
        if not d.eof:
            raise ValueError(f"the gzip member at {at} is cut off")
        yield at, b"".join(out)
        at = min(next_, len(raw)) - len(d.unused_data)


def parse_records(raw: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers with lower-case names, block) of each record of a file."""
    plain = raw[:2] != b"\x1f\x8b"
    for base, member in _members(raw):
        at = 0
        while m := _HEAD.match(member, at):
            lines = (x.split(b":", 1) for x in m[1].splitlines() if b":" in x)
            head = {a.strip().lower().decode(): b.strip().decode("utf-8", "replace") for a, b in lines}
            start = m.end()
            end = start + int(head["content-length"])
            if end > len(member):
                raise ValueError(f"a record at {base + at} is cut off")
            yield (at if plain else base), head, member[start:end]
            at = end
            while member[at : at + 1] in (b"\r", b"\n"):
                at += 1
        if member[at:].strip():
            raise ValueError(f"no record starts at {base + at}")


def url_key(url: str) -> str:
    """Sort-friendly form: reversed host labels, then port and path; www and fragments go."""
    m = re.match(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)", url)
    if not m:
        return url
    host = re.sub(r"^www\d*\.", "", m[1].lower())
    return ",".join(reversed(host.split("."))) + (m[2] or "") + ")" + (m[3].lower() or "/")


def _key_of(record_id: str | None) -> int | None:
    if not record_id:
        return None
    n = int(record_id.strip("<>").removeprefix("urn:uuid:").replace("-", "")[-16:], 16)
    return n - (1 << 64) if n >= 1 << 63 else n


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One index entry per record of all archives below path, in CAPTURE's columns.

    The digests of payloads that are there are computed anew; a record whose digest is not
    what its header says is an error.
    """

    def work(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for at, head, block in parse_records(raw.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                    size = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)[1])
                    if kind == "response":
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != size:
                            raise ValueError(f"{name}: the payload at {at} is not what its header says")
                    uri = head.get("warc-target-uri", "")
                    rows.append(
                        (url_key(uri), head["warc-date"], _key_of(head["warc-record-id"]), uri, kind, size, digest, _key_of(head.get("warc-refers-to")), name, at)
                    )
                if rows:
                    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                        names=[c.split()[0] for c in CAPTURE.split(", ")],
                    )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(work, CAPTURE)


def capture_runs(captures: DataFrame) -> DataFrame:
    """Sorted runs, one per task, written; with run and place of each entry."""
    order = ["urlkey", "ts", "key", "file", "at"]
    runs = captures.sortWithinPartitions(*order).withColumn("run", F.spark_partition_id())
    return written(runs.withColumn("place", F.monotonically_increasing_id()), "runs")


class LoserTree:
    """Merges k sorted lists of keys: next() gives (list, position), smallest key first.

    Inner nodes keep the loser of their match, so replacing the winner costs one match per
    level.
    """

    def __init__(self, lists: list[list]):
        self.lists, self.k = lists, len(lists)
        self.at = [0] * self.k
        self.tree = [-1] * max(1, self.k)  # -1: not played yet; [0] is the winner
        for i in range(self.k):
            self._play(i, build=True)

    def _less(self, a: int, b: int) -> bool:
        """Whether list a's head comes before list b's; an ended list comes last."""
        if self.at[a] >= len(self.lists[a]):
            return False
        if self.at[b] >= len(self.lists[b]):
            return True
        x, y = self.lists[a][self.at[a]], self.lists[b][self.at[b]]
        return x < y or (x == y and a < b)

    def _play(self, winner: int, build: bool = False) -> None:
        node = (winner + self.k) // 2
        while node:
            held = self.tree[node]
            if held < 0:
                if build:
                    self.tree[node] = winner
                    return
            elif self._less(held, winner):
                self.tree[node], winner = winner, held
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple[int, int]]:
        for _ in range(sum(map(len, self.lists))):
            w = self.tree[0]
            yield w, self.at[w]
            self.at[w] += 1
            self._play(w)


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All entries in global order of (urlkey, ts, key): partitions are ranges, each merged."""
    ranges = max(1, -(-runs.count() // range_rows))
    columns = [c.split()[0] for c in CAPTURE.split(", ")]
    sliced = runs.repartitionByRange(ranges, "urlkey", "ts", "key", "file", "at").sortWithinPartitions("run", "place")

    def work(batches):
        held = [b for b in batches if len(b)]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        run = t.column("run").to_pylist()
        starts = [0, *(i for i in range(1, len(run)) if run[i] != run[i - 1])]
        keys = list(zip(*[t.column(c).to_pylist() for c in ("urlkey", "ts", "key", "file", "at")], strict=True))
        lists = [keys[a:b] for a, b in zip(starts, [*starts[1:], len(keys)], strict=True)]
        order = pa.array([starts[w] + i for w, i in LoserTree(lists)], pa.int64())
        yield from t.select(columns).take(order).combine_chunks().to_batches()

    return sliced.mapInArrow(work, CAPTURE)


def archive_and_index(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes pages as archives, reads them back, and gives the merged capture index."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write_archives(pages, path, key, url, payload, min_bytes)
    return merge_runs(capture_runs(read_archives(spark, path)))


def compress(records: list[bytes]) -> bytes:
    """Records as gzip members, one each: the form in which archives are usually kept."""
    return b"".join(gzip.compress(r) for r in records)
