"""WARC archives of pages, and one globally ordered index of their captures.

* ``write_archives``: each task writes its rows as an archive, a gzip member per record. Of equal
  payloads one record is the response and the others are revisit records without a payload.
* ``index_archives``: each archive is read back, every payload verified against its digest, and its
  entries are sorted by URL key and timestamp into a run: a file of lines, cut at the boundaries of
  the key ranges.
* ``merge_runs``: for each key range the runs' slices are merged by a loser tree, at most ``fan_in``
  at a time; more runs take more passes. Read range after range, the result is in global order.

All files lie in a folder that driver and executors share. A task writes under a name of its own
attempt and renames at the end, so a retry replaces what a lost task left.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import uuid
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from itertools import groupby
from urllib.parse import urlsplit

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookreplay.llm.common import cut, fresh_dir

#: Payloads below this many bytes are never revisits.
REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
ENTRY = "page_id long, url string, url_key string, captured_at string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"
FIELDS = [f.split()[0] for f in ENTRY.split(", ")]
SLICE = "run string, range int, offset long, length long, entries long"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def url_key(url: str | None) -> str:
    """Host labels from the right, then port, path and query, without scheme and fragment: captures of
    a site stand together. A null or unusual url is its own key; white space never enters a key."""
    clean = re.sub(r"\s", "", url or "")
    try:
        p = urlsplit(clean)
        host, port = (p.hostname or "").lower(), p.port
    except ValueError:
        return clean or "-"
    if not host:
        return clean or "-"
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (p.path or "/")
    return key + (f"?{p.query}" if p.query else "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, at: str) -> bytes:
    """One record; of a revisit the block holds the HTTP header only."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {at}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, digest and refers_to (the smallest page_id with an equal payload; null for
    responses). Only narrow rows meet by digest, over salts, so a payload that a third of the pages
    share is spread; the pages themselves meet their referral by page_id."""
    salts = 32
    held = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2("html", 256))
    ids = cut(held.select("page_id", "digest", F.octet_length("html").alias("n")).where((F.col("n") >= least) & F.col("page_id").isNotNull()), "digests")
    firsts = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first <> last")
    salted = firsts.select("digest", F.col("first").alias("refers_to"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    own = ids.select("page_id", "digest", F.pmod("page_id", F.lit(salts)).cast("int").alias("salt"))
    revisits = own.join(salted, ["digest", "salt"]).where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    return held.join(revisits, ["page_id", "digest"], "left")


def write_archives(pages: DataFrame, folder: str, level: int = 2) -> DataFrame:
    """Write every row as a record; returns (archive, records, bytes).

    The capture time of a page is EPOCH plus page_id seconds (EPOCH for a null id). A null html is an
    empty payload. Repeated rows are written each; rows with the same page_id and payload as the
    response are responses too. An empty table writes nothing."""
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        to, at = pafs.FileSystem.from_uri(folder)
        name, n, size = f"capture-{part:06d}.warc.gz", 0, 0
        out = None
        for b in batches:
            if b.num_rows and out is None:
                out = to.open_output_stream(f"{at}/_{name}.{attempt}", compression=None)
            cols = [b.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")]
            for i in range(b.num_rows):
                page_id, url, html, digest, refers_to = (c[i].as_py() for c in cols)
                when = EPOCH + timedelta(seconds=page_id or 0) if abs(page_id or 0) < 1 << 32 else EPOCH
                data = gzip.compress(record(page_id, url, html.encode(), digest, refers_to, when.strftime("%Y-%m-%dT%H:%M:%SZ")), level, mtime=0)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            to.move(f"{at}/_{name}.{attempt}", f"{at}/{name}")
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": [n], "bytes": [size]})

    rows = with_revisits(pages).select("page_id", "url", "html", "digest", "refers_to")
    return cut(rows.mapInArrow(write, "archive string, records long, bytes long"), "archives")


def read_records(data: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(header fields, block, offset, length) of each gzip member of an archive given in chunks."""
    import zlib

    offset, rest, source = 0, b"", iter(data)
    while True:
        rest = rest or next(source, b"")
        if not rest:
            return
        unpack, plain, length = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if not rest:
                rest = next(source, b"")
                if not rest:
                    raise ValueError(f"the archive ends inside the record at {offset}")
            plain.append(unpack.decompress(rest))
            length += len(rest) - len(unpack.unused_data)
            rest = unpack.unused_data
        head, _, block = b"".join(plain).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {offset}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        yield fields, block[: int(fields["Content-Length"])], offset, length
        offset += length


def chunks(fs: pafs.FileSystem, path: str, each: int = 1 << 16) -> Iterator[bytes]:
    with fs.open_input_stream(path, compression=None) as f:
        while data := f.read(each):
            yield data


def entry(fields: dict[str, str], block: bytes, archive: str, offset: int, length: int) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\nContent-Length: (\d+)", http)[1])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{archive} at {offset}: the payload is not what its digest says")
    page, refers, url = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id"), fields.get("WARC-Target-URI")
    values = (
        page and int(page), url, url_key(url), re.sub(r"\D", "", fields["WARC-Date"]), size, digest, kind,
        refers and int(refers), archive, offset, length,
    )
    return dict(zip(FIELDS, values))


def line_of(e: dict) -> bytes:
    return f"{e['url_key']} {e['captured_at']} {json.dumps(e)}\n".encode()


def order_of(line: bytes) -> tuple[bytes, bytes, bytes]:
    """URL key, timestamp, then the rest of the line, so that ties fall alike on every run."""
    key, at, rest = line.split(b" ", 2)
    return key, at, rest


def boundaries(pages: DataFrame, ranges: int, total: int, each: int = 8, least: int = 10_000) -> list[tuple[bytes, bytes]]:
    """Where the key ranges end, from about ``each`` sampled rows for every range, ``least`` at any rate:
    those whose hash of page and url is low enough. They only balance the merge: any boundaries give the
    same order. Where there are no more different keys than ranges, every key ends one. The driver holds
    ``each`` keys for a range, that is one row in thousands."""
    space = 1 << 30
    low = F.pmod(F.xxhash64("page_id", "url"), F.lit(space)) < min(space, space * max(each * ranges, least) // max(1, total))
    few = pages.select("page_id", "url").where(low).distinct().collect()
    stamp = lambda i: (EPOCH + timedelta(seconds=i or 0) if abs(i or 0) < 1 << 32 else EPOCH).strftime("%Y%m%d%H%M%S")
    keys = sorted({(url_key(r["url"]).encode(), stamp(r["page_id"]).encode()) for r in few})
    return cut_points(keys, ranges)


def cut_points(keys: list, ranges: int) -> list:
    """Boundaries of ``ranges`` ranges of about as many keys each; all keys if there are fewer."""
    return [keys[len(keys) * k // ranges] for k in range(1, ranges)] if len(keys) >= ranges else keys


def index_archives(archives: DataFrame, folder: str, bounds: list[tuple[bytes, bytes]]) -> DataFrame:
    """One locally sorted run per archive, and where its slices lie: run, range, offset, length, entries."""

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        fs, base = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for archive in b["archive"]:
                lines = [line_of(entry(*x[:2], archive, *x[2:])) for x in read_records(chunks(fs, f"{base}/{archive}"))]
                lines.sort(key=order_of)
                name = archive.replace(".warc.gz", ".run")
                with RunWriter(fs, base, name, attempt, bounds) as run:
                    for x in lines:
                        run.add(x)
                yield run.slices()

    parts = archives.select("archive").repartition(max(1, archives.count()), "archive")
    return cut(parts.mapInPandas(index, SLICE), "slices")


class RunWriter:
    """A run file, and the place of each key range in it."""

    def __init__(self, fs: pafs.FileSystem, base: str, name: str, attempt: int, bounds: list[tuple[bytes, bytes]]):
        self.fs, self.base, self.name, self.attempt, self.bounds = fs, base, name, attempt, bounds
        self.range, self.at, self.found = 0, 0, {}

    def __enter__(self) -> RunWriter:
        self.out = self.fs.open_output_stream(f"{self.base}/_{self.name}.{self.attempt}", compression=None)
        return self

    def __exit__(self, kind, *_) -> None:
        self.out.close()
        if kind is None:
            self.fs.move(f"{self.base}/_{self.name}.{self.attempt}", f"{self.base}/{self.name}")

    def add(self, line: bytes) -> None:
        while self.range < len(self.bounds) and order_of(line)[:2] >= self.bounds[self.range]:
            self.range += 1
        offset, length, entries = self.found.get(self.range, (self.at, 0, 0))
        self.found[self.range] = (offset, length + len(line), entries + 1)
        self.out.write(line)
        self.at += len(line)

    def slices(self) -> pd.DataFrame:
        return pd.DataFrame([(self.name, r, *x) for r, x in self.found.items()], columns=[f.split()[0] for f in SLICE.split(", ")])


def slice_lines(fs: pafs.FileSystem, path: str, offset: int, length: int, each: int = 1 << 18) -> Iterator[bytes]:
    """Lines of a slice, with one buffer of ``each`` bytes at a time."""
    with fs.open_input_file(path) as f:
        f.seek(offset)
        rest = b""
        while length:
            data = f.read(min(each, length))
            length -= len(data)
            *whole, rest = (rest + data).split(b"\n")
            yield from (x + b"\n" for x in whole)


def loser_tree(sources: list[Iterator[bytes]], order=order_of) -> Iterator[bytes]:
    """Merge sorted sources. Inner nodes keep the loser of the match below them, so replacing the
    winner replays one path from its leaf to the root: log2(k) comparisons for each line."""
    k = len(sources)
    if not k:
        return
    heads = [next(s, None) for s in sources]
    keys = [None if x is None else (order(x), i) for i, x in enumerate(heads)]

    def beats(a: int, b: int) -> bool:
        return keys[a] is not None and (keys[b] is None or keys[a] < keys[b])

    losers = [-1] * k
    for leaf in range(k):
        winner, node = leaf, (leaf + k) // 2
        while node:
            if losers[node] < 0:
                losers[node] = winner
                break
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2
        else:
            losers[0] = winner
    while keys[losers[0]] is not None:
        winner = losers[0]
        yield heads[winner]
        heads[winner] = next(sources[winner], None)
        keys[winner] = None if heads[winner] is None else (order(heads[winner]), winner)
        node = (winner + k) // 2
        while node:
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2
        losers[0] = winner


def _grouped(slices: DataFrame, fan_in: int) -> DataFrame:
    """Slices of one merge beside one another: of a range, ``fan_in`` runs in turn."""
    nth = F.row_number().over(Window.partitionBy("range").orderBy("run")) - 1
    held = slices.withColumn("group", F.floor(nth / fan_in).cast("int"))
    tasks = max(1, held.select("range", "group").distinct().count())
    return held.repartition(tasks, "range", "group").sortWithinPartitions("range", "group", "run")


def _merges(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[int, int], list]]:
    rows = (r for b in batches for r in b.itertuples(index=False))
    for key, own in groupby(rows, key=lambda r: (r.range, r.group)):
        yield key, list(own)


def merge_runs(slices: DataFrame, folder: str, fan_in: int = 64) -> DataFrame:
    """The capture histories: every entry with ``range`` and its place ``nth`` in the range. Ordered by
    (range, nth) they are in order of URL key, timestamp and the entry's line."""
    most = lambda: slices.groupBy("range").count().agg(F.max("count")).first()[0] or 0
    level = 0
    while most() > fan_in:
        level += 1

        def merge(batches: Iterator[pd.DataFrame], level: int = level) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            fs, base = pafs.FileSystem.from_uri(folder)
            for (r, g), own in _merges(batches):
                with RunWriter(fs, base, f"merged-{level}-{r:06d}-{g:06d}", TaskContext.get().taskAttemptId(), []) as run:
                    for x in loser_tree([slice_lines(fs, f"{base}/{s.run}", s.offset, s.length) for s in own]):
                        run.add(x)
                yield run.slices().assign(range=r)

        slices = cut(_grouped(slices, fan_in).mapInPandas(merge, SLICE), "slices")

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for (r, _), own in _merges(batches):
            rows, n = [], 0
            for x in loser_tree([slice_lines(fs, f"{base}/{s.run}", s.offset, s.length) for s in own]):
                rows.append({**json.loads(order_of(x)[2]), "range": r, "nth": n})
                n += 1
                if len(rows) == 5000:
                    yield _frame(rows)
                    rows = []
            if rows:
                yield _frame(rows)

    return _grouped(slices, fan_in).mapInPandas(last, f"{ENTRY}, range int, nth long")


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[*FIELDS, "range", "nth"])
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def capture_histories(pages: DataFrame, entries_each: int = 20_000, fan_in: int = 64, level: int = 2) -> DataFrame:
    """Write archives, read them back, and merge their indexes: an entry for every row of ``pages``, with
    its ``position`` (from 0) in the order of URL key, timestamp and the entry's line.

    Null urls and ids keep their rows (key ``-``, EPOCH); a null html is an empty payload. Captures with equal
    key and time fall in the order of their lines, so reruns over the same archives agree. Repeated rows have an
    entry each. Very long payloads are held one at a time. An empty table gives no rows; other columns
    are not carried."""
    folder = fresh_dir(pages.sparkSession, "warc")
    archives = write_archives(pages, folder, level)
    total = int(archives.agg(F.sum("records")).first()[0] or 0)
    bounds = boundaries(pages, max(1, -(-total // entries_each)), total)
    merged = cut(merge_runs(index_archives(archives, folder, bounds), folder, fan_in), "histories")
    # One row per range: thousands of entries each.
    sizes = merged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("range", F.coalesce(before, F.lit(0)).alias("base"))
    return merged.join(bases, "range").withColumn("position", F.col("base") + F.col("nth")).drop("base", "range", "nth")
