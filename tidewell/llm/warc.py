"""WARC archives with a globally ordered capture index, by external merge.

Writing: payload digests are counted in Spark; of equal payloads the smallest page_id is a
response, the others are revisits that name it.  Each task writes gzip archives (a member
for each record) of at most `ARCHIVE_BYTES` into the shared folder.  The html meets only the
table of payloads that repeat, which is written first, so that Spark can split a payload of
very many pages over tasks.  Record ids are fresh; a revisit names its response by URL and date
as the format asks, and pages by fields of its own.

Reading: each task reads one archive from start to end, sorts its captures by URL key,
timestamp and page_id and writes them as a run of batches.  What lies where is a table: a row
for each batch, with its first and last key.  Groups of `FAN_IN` runs are cut at every
`FAN_IN`-th first key (of the whole key, not of the URL alone, so a hot URL is cut like any
other), and each range is a task that merges its part of every run by a loser tree, one batch
of each run in memory.  Passes go on until one group is left, whose ranges, one after the
other, are the global history in order.

A file's name holds a fresh token and only the files of finished tasks are listed, so lost
or repeated attempts leave no trace in the result.  The driver keeps counts, no rows.

Cases: null html is an empty payload; a null url has key `-`; pages without a `date` column
are dated by their id; a null page_id is a response only if no equal payload has an id, and
comes back as null; rows that repeat a page_id with its payload are records of their own and
all of the type of that id; payloads under `min_revisit` bytes are always responses; an
empty table gives an empty result; a very long payload is one record, held by one task; other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.sources.store import scratch

from .common import checkpointed, in_arrow

ARCHIVE_BYTES = 32 << 20
FAN_IN = 64
RUN_ROWS = 1024
#: Rows of the planning of a pass that a task orders.
PLAN_ROWS = 1 << 16
EPOCH = 1_704_067_200
CAPTURE = "urlkey string, ts long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, file string, offset long, length long"
FIELDS = [x.split()[0] for x in CAPTURE.split(", ")]
ARROW = pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in (x.split() for x in CAPTURE.split(", "))])
#: Extension fields: the page's id, and that of the response a revisit refers to.
PAGE, REFERS = "Tidewell-Page-ID", "Tidewell-Refers-To-Page-ID"
NULL_LAST = 2**63
#: A capture's whole key; pages without id come last.
KEY = "key struct<urlkey:string, ts:bigint, no_page:int, page_id:bigint, file:string, offset:bigint>"
#: The table of batches: the run, the file and place of a batch, its rows, its first and last key.
INDEX = f"run string, file string, k int, rows long, {KEY.replace('key ', 'head ', 1)}, {KEY.replace('key ', 'tail ', 1)}"

KEY_ARROW = pa.struct([("urlkey", pa.string()), ("ts", pa.int64()), ("no_page", pa.int32()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64())])
INDEX_ARROW = pa.schema([("run", pa.string()), ("file", pa.string()), ("k", pa.int32()), ("rows", pa.int64()), ("head", KEY_ARROW), ("tail", KEY_ARROW)])


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query, in lower case."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip().lower())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url.strip().lower()
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def stamp(seconds: int) -> str:
    import datetime

    return (datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


def seconds_of(text: str) -> int:
    import datetime

    return int((datetime.datetime.strptime(text, "%Y-%m-%dT%H:%M:%SZ") - datetime.datetime(1970, 1, 1)).total_seconds())


def target(url: str) -> str:
    return quote(url, safe="".join(map(chr, range(33, 127))))


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers: tuple | None, ts: int) -> bytes:
    """One record.  refers: (page_id, url, ts) of the response if it is a revisit, which holds the
    HTTP header (with the payload's length) alone."""
    revisit = refers is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {stamp(ts)}", f"WARC-Payload-Digest: sha1:{sha}"]
    if page_id is not None:
        head.append(f"{PAGE}: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {target(url)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Date: {stamp(refers[2])}", f"{REFERS}: {refers[0]}"]
        if refers[1] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {target(refers[1])}")
    body = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def members(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of every gzip member of a stream, read once."""
    at, rest = 0, stream.read(chunk)
    while rest:
        out, one, size = [], zlib.decompressobj(31), 0
        while True:
            out.append(one.decompress(rest))
            size += len(rest) - len(one.unused_data)
            rest = one.unused_data
            if one.eof:
                break
            rest = stream.read(chunk)
            if not rest:
                raise ValueError(f"archive ends inside the record at {at}")
        yield at, size, b"".join(out)
        at += size
        rest = rest or stream.read(chunk)


def parsed(raw: bytes) -> dict:
    """The capture in a record.  A response's payload is measured, a revisit's is as stated."""
    head, _, body = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = body[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    stated = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    sha = fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else digest(payload)
    if not revisit and (sha != fields["WARC-Payload-Digest"].removeprefix("sha1:") or len(payload) != stated):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "urlkey": url_key(fields.get("WARC-Target-URI")),
        "ts": seconds_of(fields["WARC-Date"]),
        "page_id": int(fields[PAGE]) if PAGE in fields else None,
        "record_type": fields["WARC-Type"],
        "refers_to": int(fields[REFERS]) if revisit else None,
        "payload_bytes": stated,
        "payload_digest": sha,
    }


def opened(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or not folder.startswith("file:") else "file://" + folder[5:])


def _writer(folder: str, limit: int):
    def run(batches):
        fs, root = opened(folder)
        sink, name, size, count = None, "", 0, 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers", "ts")]
            for page_id, url, html, refers, ts in zip(*columns, strict=True):
                if sink is None:
                    name = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    sink, size, count = fs.open_output_stream(name, compression=None), 0, 0
                payload = (html or "").encode()
                packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                packed = packer.compress(record(page_id, url, payload, digest(payload), refers and tuple(refers.values()), ts)) + packer.flush()
                sink.write(packed)
                size += len(packed)
                count += 1
                if size >= limit:
                    sink.close()
                    sink = None
                    yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([count], pa.int64()), "bytes": pa.array([size], pa.int64())})
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([count], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return run


def write_archives(pages: DataFrame, folder: str, min_revisit: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes every page; returns `file`, `records`, `bytes` of the archives (already written)."""
    date = F.unix_timestamp(F.col("date").cast("timestamp")) if "date" in pages.columns else F.lit(None).cast("long")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
        F.coalesce(date, F.lit(EPOCH) + F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(1 << 30))).alias("ts"),
    )
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary"))))
    # of the rows with the least page_id the one with the least date and URL is referred to
    own = F.struct("page_id", "ts", "url")
    again = rows.groupBy("sha").agg(F.min(F.when(F.col("page_id").isNotNull(), own)).alias("least"), F.count("*").alias("n")).where("n > 1 and least is not null")
    again = checkpointed(again.select("sha", F.struct(F.col("least.page_id").alias("page_id"), F.col("least.url").alias("url"), F.col("least.ts").alias("ts")).alias("first")))
    is_revisit = ~F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.coalesce(F.octet_length("html"), F.lit(0)) >= min_revisit)
    typed = rows.join(again, "sha", "left").withColumn("refers", F.when(F.col("first").isNotNull() & is_revisit, F.col("first")))
    fs, root = opened(folder)
    fs.create_dir(root, recursive=True)
    return checkpointed(in_arrow(typed.select("page_id", "url", "html", "refers", "ts"), _writer(folder, archive_bytes), "file string, records long, bytes long"))


def sort_key(row: tuple) -> tuple:
    """URL key, timestamp, page_id (null last), then the place in the archives."""
    return (row[0], row[1], NULL_LAST if row[2] is None else row[2], row[7], row[8])


def _runs(folder: str):
    """Reads archives, one run for each; yields the run's rows of the table of batches."""

    def run(batches):
        fs, root = opened(folder)
        for batch in batches:
            for file in batch.column("file").to_pylist():
                rows = []
                with fs.open_input_stream(file, compression=None) as stream:
                    for at, size, raw in members(stream):
                        rows.append((*parsed(raw).values(), file.rpartition("/")[2], at, size))
                rows.sort(key=sort_key)
                yield written(fs, root, file, iter(rows))

    return run


def struct_key(row: tuple) -> dict:
    return {"urlkey": row[0], "ts": row[1], "no_page": int(row[2] is None), "page_id": row[2], "file": row[7], "offset": row[8]}


def tuple_key(k: dict | None) -> tuple | None:
    """As `sort_key`, from the struct of the table of batches."""
    return k and (k["urlkey"], k["ts"], NULL_LAST if k["no_page"] else k["page_id"], k["file"], k["offset"])


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


def written(fs, root: str, run: str, rows: Iterator[tuple]) -> pa.RecordBatch:
    """Sorted rows as a file of Arrow batches, which is (a part of) a run."""
    name, out = f"{root}/{uuid.uuid4().hex}.run", []
    with fs.open_output_stream(name, compression=None) as sink, pa.ipc.new_file(sink, ARROW, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
        while part := list(itertools.islice(rows, RUN_ROWS)):
            out.append({"run": run, "file": name, "k": len(out), "rows": len(part), "head": struct_key(part[0]), "tail": struct_key(part[-1])})
            file.write_batch(as_batch(part))
    return pa.RecordBatch.from_pylist(out, schema=INDEX_ARROW)


class LoserTree:
    """k-way merge: inner nodes keep the losers, so each row out costs one path of compares."""

    def __init__(self, sources: list[Iterator[tuple]]) -> None:
        self.sources = sources
        self.k = max(1, len(sources))
        self.head = [self._next(i) for i in range(len(sources))] or [None]
        self.loser = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _next(self, i: int):
        row = next(self.sources[i], None)
        return None if row is None else (sort_key(row), i, row)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            other = self.loser[node]
            if other < 0:  # the first to arrive waits for its opponent
                self.loser[node] = winner
                return
            if self._beats(other, winner):
                self.loser[node], winner = winner, other
            node //= 2
        self.loser[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.head[self.loser[0]] is not None:
            winner = self.loser[0]
            yield self.head[winner][2]
            self.head[winner] = self._next(winner)
            self._play(winner)


def slice_of(fs, batches: list[dict], low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """Rows with low <= key < high of some batches of one run, in order, a batch at a time."""
    batches = sorted(batches, key=lambda x: tuple_key(x["head"]))
    for file, part in itertools.groupby(batches, key=lambda x: x["file"]):
        with fs.open_input_file(file) as source:
            reader = pa.ipc.open_file(source)
            for one in part:
                for row in zip(*(c.to_pylist() for c in reader.get_batch(one["k"]).columns), strict=True):
                    key = sort_key(row)
                    if high is not None and key >= high:
                        return
                    if low is None or key >= low:
                        yield row


def merged(fs, work: dict) -> Iterator[tuple]:
    """The rows of one range, from its batches of all runs of the group."""
    by_run: dict[str, list[dict]] = {}
    for x in work["batches"]:
        by_run.setdefault(x["run"], []).append(x)
    return iter(LoserTree([slice_of(fs, by_run[r], tuple_key(work["low"]), tuple_key(work["high"])) for r in sorted(by_run)]))


def _merge(folder: str):
    """The last pass: yields the captures."""

    def run(batches):
        fs, _ = opened(folder)
        for batch in batches:
            for work in batch.to_pylist():
                rows = merged(fs, work)
                while part := list(itertools.islice(rows, RUN_ROWS)):
                    yield as_batch(part)

    return run


def _merge_again(folder: str):
    """A pass before the last: a range becomes a part of the group's run."""

    def run(batches):
        fs, root = opened(folder)
        for batch in batches:
            for work in batch.to_pylist():
                yield written(fs, root, f"group-{work['group']}", merged(fs, work))

    return run


def grouped(runs: DataFrame, n_runs: int, fan_in: int) -> DataFrame:
    """`run` and its `group`, of at most `fan_in` runs.  Runs are numbered by cells of their hash, so
    that one task sees the cells' totals alone."""
    cells = runs.withColumn("cell", F.pmod(F.xxhash64("run"), F.lit(n_runs // PLAN_ROWS + 1)))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = cells.groupBy("cell").agg(F.count("*").alias("c")).select("cell", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    number = F.col("before") + F.row_number().over(Window.partitionBy("cell").orderBy("run")) - 1
    return cells.join(totals, "cell").select("run", F.floor(number / fan_in).alias("group"))


def ranges(index: DataFrame, fan_in: int, n_runs: int, n_batches: int) -> DataFrame:
    """`group`, `r`, `low`, `high` (null: open), `batches`: the merges of one pass.  A group has at most
    `fan_in` runs, a range as many first keys; a range's batches are those and at most one of
    each run that reaches into it from before.

    First keys are counted along the order of all keys, in parts of that order: Spark deals the
    keys by range, each part counts its own, and one task sees the parts' totals alone.
    """
    runs = grouped(index.select("run").distinct(), n_runs, fan_in)
    b = index.join(runs, "run").withColumn("id", F.struct("file", "k"))
    # first and last keys in one order; at equal keys the first come first
    ends = b.select("group", "id", F.explode(F.array(F.struct(F.col("head").alias("key"), F.lit(0).alias("last")), F.struct(F.col("tail").alias("key"), F.lit(1).alias("last")))).alias("e"))
    order = ("e.key", "e.last", "id")
    # written with its part, as the bounds between parts come from a sample
    ends = checkpointed(ends.repartitionByRange(2 * n_batches // PLAN_ROWS + 1, "group", *order).withColumn("part", F.spark_partition_id()))
    totals = ends.groupBy("group", "part").agg(F.sum(1 - F.col("e.last")).alias("c"))
    earlier = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("group", "part", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"))
    so_far = Window.partitionBy("group", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    heads = F.col("before") + F.sum(1 - F.col("e.last")).over(so_far)
    placed = ends.join(totals, ["group", "part"]).withColumn("r", F.floor((heads - 1) / fan_in))
    reach = placed.groupBy("group", "id").agg(F.min("r").alias("r0"), F.max("r").alias("r1"))
    lows = placed.where("e.last = 0").groupBy("group", "r").agg(F.min("e.key").alias("low"))
    lows = lows.withColumn("high", F.lead("low").over(Window.partitionBy("group").orderBy("r"))).withColumn("low", F.when(F.col("r") > 0, F.col("low")))
    work = b.join(reach, ["group", "id"]).withColumn("r", F.explode(F.sequence("r0", "r1")))
    work = work.groupBy("group", "r").agg(F.collect_list(F.struct("run", "file", "k", "head")).alias("batches"))
    return work.join(lows, ["group", "r"]).select("group", "r", "low", "high", "batches")


def read_archives(archives: DataFrame, folder: str, fan_in: int = FAN_IN) -> DataFrame:
    """Every capture in the archives, ordered by URL key, timestamp and page_id."""
    spark = archives.sparkSession
    files = archives.select("file").distinct()
    count = files.count()
    if not count:
        return spark.createDataFrame([], CAPTURE)
    index = checkpointed(in_arrow(files.repartition(min(count, 10_000)), _runs(folder), INDEX))
    while True:
        n_runs, n_batches = index.agg(F.count_distinct("run"), F.count("*")).first()
        work = checkpointed(ranges(index, fan_in, n_runs, n_batches))
        tasks = max(1, min(10_000, n_batches // fan_in + 1))
        if n_runs <= fan_in:
            ordered = work.repartitionByRange(tasks, "r").sortWithinPartitions("r")
            return in_arrow(ordered, _merge(folder), CAPTURE)
        index = checkpointed(in_arrow(work.repartition(tasks, "group", "r"), _merge_again(folder), INDEX))


def round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes the pages as WARC archives and returns the merged history read back from them."""
    folder = folder or scratch(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, **options), folder)
