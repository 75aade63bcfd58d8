"""WARC archives of pages, read back through an external merge of capture indexes.

``write_archives`` writes one record per page into gzip-per-record archives in
the shared folder.  ``capture_runs`` reads archives and gives, for each, its
captures as a run sorted by URL key and capture time.  ``merge_runs`` deals the runs
by key range and merges the slices of a range with a loser tree, so the whole
is in order and a URL's captures are neighbours, however many it has.

Pages whose payload equals that of a page with a smaller id become revisit
records of it, if the payload has at least ``revisit_from`` bytes.  Rows that
repeat that smallest id are responses too.  A null html is an empty payload,
a null url has an empty key, a null id stands last among equal payloads, has
the earliest time of all and comes first in its URL's history.  An empty table gives no captures.  Other columns
are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.scratch import bound_batches
from ledgerlens.session import materialize, new_run_dir

#: Uncompressed bytes from which an archive is closed and a new one begun.
ARCHIVE_BYTES = 256 << 20
#: Pages carry no capture time; the page id gives the nanoseconds after this one, so times keep the order of any 64-bit ids.
BASE_TIME = "2024-01-01T00:00:00Z"
#: Captures of a range, about; a task merges one range.
RANGE_ROWS = 200_000
RUN_SCHEMA = ("url_key string, capture_time string, page_id long, url string, payload_bytes long, payload_digest string, "
              "record_type string, refers_to long, archive string, offset long, length long")
#: Times have a fixed width, so their text is in their order; rows that repeat an id have one time.
ORDER = ("url_key", "capture_time", "page_id", "offset")
#: A digest of more than one in so many of the repeated payloads is hot: there are fewer such digests than this.
HOT_DIGESTS = 1000


def url_key(url: str | None) -> str:
    """Sort-friendly form of a url: host labels from the last to the first, then path and query, in lower case."""
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^#]*)", url or "")
    if not m:
        return (url or "").lower()
    host = re.sub(r":(80|443)$", "", m[1].lower().rpartition("@")[2])
    labels = host.removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + ")" + (m[2] or "/").lower()


def capture_time(page_id: int | None, base_time: str = BASE_TIME) -> str:
    """The time that stands for a page id, to the nanosecond."""
    seconds, rest = divmod(-2**63 if page_id is None else page_id, 10**9)
    begin = datetime.strptime(base_time, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc)
    return f"{(begin + timedelta(seconds=seconds)).strftime('%Y-%m-%dT%H:%M:%S')}.{rest:09d}Z"


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _record(page: dict, time: str) -> bytes:
    """One gzip member."""
    body, revisit = page["payload"] or b"", page["refers_to"] is not None
    digest = base64.b32encode(bytes.fromhex(page["digest"])).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http if revisit else http + body
    url = re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", page["url"] or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page['page_id']}>",
            f"WARC-Date: {time}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{page['refers_to']}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(4, wbits=31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _members(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member of a file; one is held at a time."""
    offset, data = 0, stream.read(chunk)
    while data:
        unpack, out, length = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if not data and not (data := stream.read(chunk)):
                raise EOFError(f"the member at {offset} is cut")
            out.append(unpack.decompress(data))
            length += len(data) - len(unpack.unused_data)
            data = unpack.unused_data
        yield offset, length, b"".join(out)
        offset += length
        data = data or stream.read(chunk)


def parse_record(raw: bytes) -> dict:
    """Headers and payload facts of one WARC record; the payload's digest is checked against its header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, body = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    whole = fields["WARC-Type"] == "response"
    if whole and (len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload is not what its header says")
    page = lambda name: None if (got := fields.get(name, ":None>")[:-1].rpartition(":")[2]) == "None" else int(got)
    url = fields["WARC-Target-URI"]
    return {"url_key": url_key(url), "capture_time": fields["WARC-Date"], "page_id": page("WARC-Record-ID"), "url": url,
            "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": page("WARC-Refers-To")}


def _with_first(read: DataFrame, twice: DataFrame, revisit_from: int) -> DataFrame:
    """page_id, url, payload, digest and refers_to; twice: digest, first, n of the payloads that occur twice.

    Hot digests are told by a broadcast of fewer than ``HOT_DIGESTS`` rows;
    if the others are too many for one, their rows are joined by digest and
    those of hot digests are dealt out by page.
    """
    rows = twice.agg(F.sum("n")).first()[0] or 0
    hot = twice.filter(F.col("n") * HOT_DIGESTS > rows).select("digest", F.struct("first").alias("hot"))
    rest = twice.filter(F.col("n") * HOT_DIGESTS <= rows).select(F.col("digest").alias("key"), F.struct("first").alias("cool"))
    spread = F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.concat_ws(":", "digest", F.col("page_id").cast("string")))
    told = read.join(F.broadcast(hot), "digest", "left").withColumn("key", spread).join(rest, "key", "left")
    first = F.coalesce("hot", "cool")["first"]
    return told.select("page_id", "url", "payload", "digest", F.when(
        first.isNotNull() & ~first.eqNullSafe(F.col("page_id")) & (F.length("payload") >= revisit_from), first).alias("refers_to"))


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None,
                   revisit_from: int = 0, archive_bytes: int = ARCHIVE_BYTES, base_time: str = BASE_TIME) -> DataFrame:
    """Write the pages as records; one row an archive: archive, records, bytes.

    A lost task writes its archives anew under other names; only those of the
    attempt that succeeded are in the result.
    """
    folder = folder or new_run_dir(pages.sparkSession, "warc")
    bound_batches(pages.sparkSession)
    read = pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].cast("string").alias("url"),
                        F.encode(F.coalesce(pages[html].cast("string"), F.lit("")), "utf-8").alias("payload"))
    read = read.withColumn("digest", F.sha1("payload"))
    # only payloads that occur twice are joined back; their counts are summed before the shuffle
    twice = materialize(read.filter(F.length("payload") >= revisit_from).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "twice")
    told = _with_first(read, twice, revisit_from)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        out, path, records, size = None, "", 0, 0
        told = lambda: pa.RecordBatch.from_pylist([{"archive": path, "records": records, "bytes": size}])
        for batch in batches:
            for k in range(batch.num_rows):
                page = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                if out is None:
                    path, records, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                out.write(_record(page, capture_time(page["page_id"], base_time)))
                records, size = records + 1, size + len(page["payload"] or b"")
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield told()
        if out is not None:
            out.close()
            yield told()

    return materialize(told.mapInArrow(run, "archive string, records long, bytes long").withColumn("folder", F.lit(folder)), "manifest")


def capture_runs(manifest: DataFrame) -> DataFrame:
    """The captures of each archive, sorted by ``ORDER``: one run an archive, written in the shared folder."""
    archives = manifest.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RUN_SCHEMA.split(", ")]
        kinds = pa.schema([(n, pa.int64() if " long" in x else pa.string()) for n, x in zip(names, RUN_SCHEMA.split(", "))])
        for batch in batches:
            for row in batch.to_pylist():
                store, _ = _store(row["folder"])
                with store.open_input_stream(row["archive"], compression=None) as stream:
                    rows = [parse_record(raw) | {"archive": row["archive"], "offset": at, "length": n} for at, n, raw in _members(stream)]
                table = pa.RecordBatch.from_pylist(rows, schema=kinds)
                yield table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ORDER], null_placement="at_start"))

    spread = manifest.select("archive", "folder").repartition(max(1, archives), "archive")
    return materialize(spread.mapInArrow(run, RUN_SCHEMA), "runs")


class LoserTree:
    """Merges sorted sequences: each inner node keeps the loser of its match, the winner goes up.

    Taking the next item replays one path, log2(k) comparisons for k sequences.
    """

    def __init__(self, sequences: list[Iterator]):
        self.next = [iter(s).__next__ for s in sequences]
        self.k = max(1, len(sequences))
        self.head: list = [self._pull(i) if i < len(sequences) else None for i in range(self.k)]
        self.loser = [-1] * self.k
        winner = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.loser[node] = (a, b) if self._before(a, b) else (b, a)
        self.best = winner[1] if self.k > 1 else 0

    def _pull(self, i: int):
        try:
            return self.next[i]()
        except StopIteration:
            return None

    def _before(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None or x is not None and (x, a) <= (y, b)

    def __iter__(self) -> Iterator:
        while self.head[self.best] is not None:
            i = self.best
            yield self.head[i]
            self.head[i] = self._pull(i)
            node = (i + self.k) >> 1
            while node:
                if self._before(self.loser[node], i):
                    i, self.loser[node] = self.loser[node], i
                node >>= 1
            self.best = i


def merge_runs(runs: DataFrame, ranges: int | None = None) -> DataFrame:
    """All captures in the order of ``ORDER``, with ``position`` long, from 0.

    Ranges are cut by the whole order, so the captures of one URL can fill
    many; a task holds the slices of one range.
    """
    spark = runs.sparkSession
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)) if (first := next(batches, None)) is None else pa.Table.from_batches([first, *batches])
        if not held.num_rows:
            return
        archive = held.column("archive").to_pylist()
        cuts = [0, *(k for k in range(1, len(archive)) if archive[k] != archive[k - 1]), len(archive)]
        key, time, page, offset = (held.column(c).to_pylist() for c in ORDER)
        item = lambda k: (key[k], time[k], page[k] is not None, page[k] or 0, offset[k], k)
        tree = LoserTree([map(item, range(a, b)) for a, b in zip(cuts, cuts[1:])])
        merged = held.take(pa.array([x[-1] for x in tree], pa.int64()))
        yield from merged.append_column("place", pa.array(range(merged.num_rows), pa.int64())).to_batches(max_chunksize=10_000)

    dealt = runs.repartitionByRange(ranges, *[F.col(c).asc_nulls_first() for c in ORDER]) \
        .withColumn("part", F.spark_partition_id()).sortWithinPartitions("archive", *ORDER)
    schema = RUN_SCHEMA + ", part int, place long"
    merged = materialize(dealt.mapInArrow(run, schema), "merged")
    # a row a range, as many as there are partitions
    counts = {r["part"]: r["n"] for r in merged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(counts):
        before[part], total = total, total + counts[part]
    starts = spark.createDataFrame(sorted(before.items()) or [(0, 0)], "part int, start long")
    return merged.join(F.broadcast(starts), "part").withColumn("position", F.col("start") + F.col("place")).drop("part", "place", "start")
