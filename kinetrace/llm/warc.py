"""WARC archives with an externally merged capture index.

Writing tasks put gzip-compressed records into archive files and a locally sorted run of index lines beside each.
The runs are merged k ways by a loser tree, by URL key, then timestamp, then record id: over FAN_IN runs go in passes
of whole runs, and the last pass merges key ranges (by splitters sampled in the runs, found in each run by halving)
side by side. The merged index is a globally ordered history of captures, through which records are read back.
"""

from __future__ import annotations

import json
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, partitions, put_file, shared_dir, small

#: Runs that one merge reads at a time, and bytes it reads ahead of each.
FAN_IN, AHEAD = 64, 1 << 16
#: Splitter samples per run of the last pass, which has FAN_IN runs at most.
SAMPLES = 512
#: Repeated payloads (60 bytes each) up to which pages look theirs up without a shuffle.
REPEATED = 200_000
#: Payloads of fewer bytes are always stored.
REVISIT_BYTES = 1000
#: 2020-01-01T00:00:00Z; a page without a time of its own is dated this many seconds plus its id.
EPOCH = 1_577_836_800


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels from the top down, then the rest; no white space."""
    scheme, found, rest = (url or "").partition("://")
    host, tail = (re.split(r"(?=[/?#])", rest, maxsplit=1) + [""])[:2] if found else ("", url or "")
    key = ",".join(reversed(host.lower().split("."))) + ")" + tail
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", key)


def line_key(line: bytes) -> tuple[bytes, bytes, int]:
    key, stamp, number, _ = line.split(b" ", 3)
    return key, stamp, int(number)


class LoserTree:
    """k-way merge of sorted iterators of (key, item): each step replays one path of losers."""

    def __init__(self, streams: list):
        self.streams = [iter(s) for s in streams]
        self.k = max(1, len(self.streams))
        self.heads = [next(s, None) for s in self.streams] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x[0], a) < (y[0], b))

    def _replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            if self.losers[node] == -1:  # still building: wait for the sibling
                self.losers[node] = i
                return
            if self._beats(self.losers[node], i):
                self.losers[node], i = i, self.losers[node]
            node //= 2
        self.losers[0] = i

    def __iter__(self):
        while (head := self.heads[self.losers[0]]) is not None:
            yield head
            i = self.losers[0]
            self.heads[i] = next(self.streams[i], None)
            self._replay(i)


def line_at(f, at: int, size: int) -> tuple[int, bytes] | None:
    """The first whole line that starts behind position ``at`` (at 0: there), with its place; lines may be long."""
    block, step = f.read_at(min(4096, size - at), at), 4096
    while True:
        start = 0 if at == 0 else block.find(b"\n") + 1
        stop = block.find(b"\n", start) if start or at == 0 else -1
        if stop >= 0:
            return at + start, block[start:stop]
        if at + len(block) >= size:
            return None
        step *= 4
        block += f.read_at(min(step, size - at - len(block)), at + len(block))


def seek(f, low, size: int) -> int:
    """A line's place, near below the first line whose key is not below ``low``: halving over byte positions."""
    at, end = 0, size
    while end - at > AHEAD:
        mid = (at + end) // 2
        found = line_at(f, mid, size)
        if found is None or found[0] >= end:
            end = mid
        elif line_key(found[1]) < low:
            at = found[0]
        else:
            end = found[0]
    return at


def read_run(uri: str, low=None, high=None):
    """(key, line) of a run, which is sorted lines, with low <= key < high, by blocks."""
    fs, path = file_system(uri)
    with fs.open_input_file(path) as f:
        stop = f.size()
        at, rest = 0 if low is None else seek(f, low, stop), b""
        while at < stop:
            block = f.read_at(min(AHEAD, stop - at), at)
            at += len(block)
            *lines, rest = (rest + block).split(b"\n")
            for line in lines:
                key = line_key(line)
                if high is not None and key >= high:
                    return
                if low is None or key >= low:
                    yield key, line


def sample_run(uri: str) -> list[bytes]:
    """Keys (url, stamp, id) of the lines at SAMPLES even places of a run."""
    fs, path = file_system(uri)
    with fs.open_input_file(path) as f:
        size = f.size()
        found = {line_at(f, size * i // SAMPLES, size) for i in range(SAMPLES)} if size else set()
    return [line.split(b" {", 1)[0] for _, line in sorted(filter(None, found))]


def record(kind: str, page: int | None, url: str, stamp: str, payload: bytes, digest: str, refers_to: int | None, size: int) -> bytes:
    """One WARC/1.1 record: an HTTP response, or a revisit that has the headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % size
    body = http + (payload if kind == "response" else b"")
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Target-URI: {clean}", f"WARC-Date: {stamp}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    body = rest[: int(fields["content-length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def with_types(df: DataFrame, key: str, url: str, payload: str, least: int = REVISIT_BYTES) -> DataFrame:
    """page, url, html, size, digest, type and refers_to of each row."""
    html = F.coalesce(df[payload].cast("string"), F.lit(""))
    body = F.encode(html, "UTF-8")
    rows = df.select(df[key].cast("long").alias("page"), F.coalesce(df[url].cast("string"), F.lit("")).alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("size"), F.sha1(body).alias("digest"))
    groups = rows.filter(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = groups.filter("n > 1").select("digest", "size", "first")
    rows = rows.join(small(groups, REPEATED), ["digest", "size"], "left")
    again = F.col("page") < F.col("first")
    return rows.select("page", "url", "html", "size", "digest", F.when(again, "revisit").otherwise("response").alias("type"), F.when(again, F.col("first")).alias("refers_to"))


def write_archives(df: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = REVISIT_BYTES) -> list[str]:
    """Write archives and sorted runs; returns the runs' names, one per task."""
    rows = with_types(df, key, url, payload, least)

    def write(batches):
        import base64
        import uuid
        from datetime import UTC, datetime

        import pyarrow as pa
        from pyspark import TaskContext

        name = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        index = []

        def save(out):
            at = 0
            for batch in batches:
                for r in batch.to_pylist():
                    seconds = EPOCH + (r["page"] or 0) % (1 << 31)
                    when = datetime.fromtimestamp(seconds, UTC)
                    digest = base64.b32encode(bytes.fromhex(r["digest"])).decode()
                    data = _gzip(record(r["type"], r["page"], r["url"], when.strftime("%Y-%m-%dT%H:%M:%SZ"), r["html"].encode(), digest, r["refers_to"], r["size"]))
                    out.write(data)
                    head = f"{url_key(r['url'])} {when.strftime('%Y%m%d%H%M%S')} {-1 if r['page'] is None else r['page']} "
                    index.append(head.encode() + json.dumps({"file": f"{name}.warc.gz", "at": at, "n": len(data), "type": r["type"]}).encode())
                    at += len(data)

        put_file(f"{name}.warc.gz", save)
        if not index:
            return
        index.sort(key=line_key)
        put_file(f"{name}.cdxj", lambda out: out.writelines(line + b"\n" for line in index))
        yield pa.RecordBatch.from_pydict({"run": [f"{name}.cdxj"]})

    return [r.run for r in rows.mapInArrow(write, "run string").collect()]


def merge_runs(spark, runs: list[str], folder: str) -> list[str]:
    """Passes of whole-run merges until at most FAN_IN runs are left."""
    while len(runs) > FAN_IN:
        groups = [runs[i : i + FAN_IN] for i in range(0, len(runs), FAN_IN)]
        jobs = spark.createDataFrame(list(enumerate(groups)), "i int, runs array<string>").repartitionById(len(groups), F.col("i"))

        def work(batches):
            import uuid

            import pyarrow as pa

            for batch in batches:
                for job in batch.to_pylist():
                    uri = f"{folder}/merged-{uuid.uuid4().hex}.cdxj"
                    put_file(uri, lambda out, job=job: out.writelines(line + b"\n" for _, line in LoserTree([read_run(x) for x in job["runs"]])))
                    yield pa.RecordBatch.from_pydict({"run": [uri]})

        runs = [r.run for r in jobs.mapInArrow(work, "run string").collect()]
    return runs


def captures(spark, runs: list[str], folder: str, ranges: int | None = None) -> DataFrame:
    """The merged index in global order: range, place, url_key, stamp, page, file, at, n, type."""
    names = merge_runs(spark, runs, folder)

    def sample(batches):
        import pyarrow as pa

        for batch in batches:
            for uri in batch.column("run").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(sample_run(uri), pa.binary())], names=["mark"])

    jobs = spark.createDataFrame([(r, i) for i, r in enumerate(names)], "run string, i int").repartitionById(max(1, len(names)), F.col("i"))
    marks = sorted(line_key(bytes(r.mark) + b" ") for r in jobs.mapInArrow(sample, "mark binary").collect())  # at most FAN_IN * SAMPLES
    ranges = max(1, min(ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), len(marks)))
    cuts = sorted({marks[i * len(marks) // ranges] for i in range(1, ranges)}) if marks else []
    lows, highs = [None, *cuts], [*cuts, None]
    n = len(lows)

    def work(batches):
        import pyarrow as pa

        fields = ["range", "place", "url_key", "stamp", "page", "file", "at", "n", "type"]
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for i in batch.column("i").to_pylist():
                rows = []
                for place, (key, line) in enumerate(LoserTree([read_run(x, lows[i], highs[i]) for x in names])):
                    more = json.loads(line[line.index(b" {") + 1 :])
                    rows.append((i, place, key[0].decode(), key[1].decode(), key[2], more["file"], more["at"], more["n"], more["type"]))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=fields)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=fields)

    jobs = spark.createDataFrame([(i,) for i in range(n)], "i int").repartitionById(n, F.col("i"))
    return jobs.mapInArrow(work, "range int, place long, url_key string, stamp string, page long, file string, at long, n long, type string")


def read_back(index: DataFrame) -> DataFrame:
    """Read each indexed record from its archive: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Both payload columns of a response come from its stored payload, whose digest must equal the header's; a revisit
    has them from its headers.
    """

    def work(batches):
        import base64
        import hashlib

        import pyarrow as pa

        now, stream = None, None
        for batch in batches:  # archive by archive, in the order of their records: each is opened once
            out = []
            for e in batch.to_pylist():
                if e["file"] != now:
                    if stream:
                        stream.close()
                    fs, path = file_system(e["file"])
                    now, stream = e["file"], fs.open_input_file(path)
                fields, payload = parse(zlib.decompress(stream.read_at(e["n"], e["at"]), 31))
                said, size = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex(), int(fields["x-payload-length"])
                if fields["warc-type"] == "response":
                    if hashlib.sha1(payload).hexdigest() != said:
                        raise ValueError(f"digest of {e['page']} in {e['file']} at {e['at']}")
                    size = len(payload)
                page, refers = fields["warc-record-id"][10:-1], fields.get("warc-refers-to")
                out.append((int(page) if page else None, size, said, fields["warc-type"], int(refers[10:-1]) if refers else None))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if stream:
            stream.close()

    # the index is in URL order, records lie by writing task: index rows (no payloads) go to their archive
    near = index.select("file", "at", "n", "page").repartition(partitions(index.sparkSession), "file").sortWithinPartitions("file", "at")
    return near.mapInArrow(work, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(df: DataFrame, key: str = "page_id", **options) -> DataFrame:
    """Archive, index, merge and read back every row.

    Null payload and null URL are empty. A row with a null key is always a response; rows that repeat key and payload
    are all responses if theirs is the largest key. An empty table gives an empty result; extra columns are ignored.
    """
    spark, folder = df.sparkSession, shared_dir(df.sparkSession, "warc")
    index = captures(spark, write_archives(df, folder, key, **options), folder)
    return read_back(index).withColumnRenamed("page_id", key)
