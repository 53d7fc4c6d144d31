"""Line dedup: minimal perfect hashes over shards of line hashes, probed by documents.

A line's key is hashed to 128 bits. Sums by hash give in how many documents it stands and the largest
doc_id that holds it. The hashes of lines in too many documents are dealt to shards by their first half;
each shard is one minimal perfect hash (levels of bit arrays: a hash alone at its place of a level is
settled there, the others go on to the next; its number is its rank among the settled) that indexes
three arrays: fingerprints (the hash's second half), counts and owners. Documents never meet lines in a
join: they compute their lines' hashes again and probe the arrays. Where the arrays' checked size allows,
every task has them all; beyond it, each line's hash goes to its shard, where the arrays come first in
the sorted stream, and only the numbers of dropped lines come back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookreplay.llm.common import cut, free_name

#: Hashes of a shard, on average.
SHARD_KEYS = 32_768
#: Bits of a level for each hash that reaches it, and levels; hashes that none settles are kept as a list.
BITS_PER_KEY, LEVELS = 2, 32
#: The arrays go to every task up to this size, else lines go to the arrays.
BROADCAST_BYTES = 32 << 20
#: Lines that go to a shard are spread over so many copies of it.
SALTS = 16
ROWS = 500


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    """Another 64-bit hash of ``h`` for each level."""
    with np.errstate(over="ignore"):
        z = h + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Numbers 0 to n - 1 for n distinct 64-bit hashes. What it wasn't made of gets a number too, or -1."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest, self.ranks, total = levels, rest, [], 0
        for bits in levels:
            self.ranks.append(np.cumsum(bits, dtype=np.int64) - 1 + total)
            total += int(bits.sum())
        self.settled = total

    @classmethod
    def of(cls, hashes: np.ndarray) -> PerfectHash:
        levels, left = [], hashes
        while len(left) and len(levels) < LEVELS:
            size = max(8, len(left) * BITS_PER_KEY)
            at = (_mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels, np.sort(left))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        todo = np.arange(len(hashes))
        for level, bits in enumerate(self.levels):
            if not len(todo):
                return out
            at = (_mixed(hashes[todo], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[todo[hit]] = self.ranks[level][at[hit]]
            todo = todo[~hit]
        if len(todo) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, hashes[todo]), len(self.rest) - 1)
            same = self.rest[at] == hashes[todo]
            out[todo[same]] = self.settled + at[same]
        return out


class Arrays:
    """A shard: its perfect hash, fingerprints, counts and owners, as bytes and back."""

    def __init__(self, sizes: list[int], bits: bytes, rest: bytes, prints: bytes, counts: bytes, owners: bytes):
        flat, levels, at = np.frombuffer(bits, np.uint8), [], 0
        for n in sizes:
            width = -(-n // 8)
            levels.append(np.unpackbits(flat[at : at + width], count=n).astype(bool))
            at += width
        self.index = PerfectHash(levels, np.frombuffer(rest, "<u8"))
        self.prints, self.counts, self.owners = np.frombuffer(prints, "<u8"), np.frombuffer(counts, "<u4"), np.frombuffer(owners, "<i8")

    @staticmethod
    def packed(first: np.ndarray, second: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> tuple:
        index = PerfectHash.of(first)
        at = index.numbers(first)
        # Equal first halves are never alone; they stand side by side in the list, by their second halves.
        rest = np.flatnonzero(at >= index.settled)
        at[rest[np.lexsort((second[rest], first[rest]))]] = index.settled + np.arange(len(rest))
        prints, many, own = np.zeros(len(first), "<u8"), np.zeros(len(first), "<u4"), np.zeros(len(first), "<i8")
        prints[at], many[at], own[at] = second, np.minimum(counts, 0xFFFFFFFF), owners
        bits = b"".join(np.packbits(x).tobytes() for x in index.levels)
        return [len(x) for x in index.levels], bits, index.rest.astype("<u8").tobytes(), prints.tobytes(), many.tobytes(), own.tobytes()

    def dropped(self, first: np.ndarray, second: np.ndarray, ids: np.ndarray, known: np.ndarray, least: int) -> np.ndarray:
        """Whether each line goes: its fingerprint stands at its number, in ``least`` documents or more, and its
        document isn't the owner (a document without an id, not ``known``, never is)."""
        at = self.index.numbers(first)
        found = at >= 0
        at = np.where(found, at, 0)
        if not len(self.prints):
            return np.zeros(len(first), bool)
        for _ in range(len(self.index.rest) - 1):
            after = np.minimum(at + 1, len(self.prints) - 1)
            twin = (at >= self.index.settled) & (after > at) & (self.prints[at] != second)
            twin[twin] = self.index.rest[after[twin] - self.index.settled] == first[twin]
            if not twin.any():
                break
            at = np.where(twin, after, at)
        return found & (self.prints[at] == second) & (self.counts[at] >= least) & ~((self.owners[at] == ids) & known)


PARTS = ["sizes", "bits", "rest", "prints", "counts", "owners"]


def lines_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def key_of(line: bytes, least: int) -> bytes | None:
    """The line without white space at its ends and with A-Z lower-cased; None if shorter than ``least``."""
    key = line.strip(b" \t\n\x0b\x0c\r").lower()
    if len(key) < least or not key.isascii() and len(key.decode("utf-8", "surrogatepass")) < least:
        return None
    return key


def hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of each key's XXH3 hash."""
    import xxhash

    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").reshape(-1, 2)
    return both[:, 0].astype("<u8"), both[:, 1].astype("<u8")


def line_hashes(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, h1, h2: the distinct long lines of each row."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part, ids, keys = b.slice(lo, ROWS), [], []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text")):
                    own = {k for line in lines_of(text.as_py()) if (k := key_of(line, least)) is not None}
                    ids += [doc] * len(own)
                    keys += own
                if keys:
                    first, second = hashes(keys)
                    columns = [pa.array(ids, pa.int64()), pa.array(first.view("<i8")), pa.array(second.view("<i8"))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h1", "h2"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(read, "doc_id long, h1 long, h2 long")


def common_lines(docs: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    """h1, h2, docs, owner of the lines that stand in ``least_docs`` documents or more. Documents are told
    apart by doc_id; those without one count as one. Both sums are made before their shuffles, so a line of
    every document is a row for each task."""
    once = line_hashes(docs, least_chars).groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    held = once.groupBy("h1", "h2").agg(F.count("one").alias("docs"), F.max("doc_id").alias("owner"))
    return held.where(F.col("docs") >= least_docs)


def shards_of(lines: DataFrame) -> DataFrame:
    """shard, sizes, bits, rest, prints, counts, owners: a row for each shard, of some 32,768 lines."""
    held = cut(lines, "common-lines")
    n = max(1, -(-held.count() // SHARD_KEYS))

    def build(key, part):
        u = lambda c: part[c].to_numpy("i8").view("<u8")
        made = Arrays.packed(u("h1"), u("h2"), part["docs"].to_numpy("i8"), part["owner"].to_numpy("i8"))
        import pandas as pd

        return pd.DataFrame([[int(key[0]), n, *made]], columns=["shard", "shards", *PARTS])

    # An owner is never null here: lines of two documents or more have an id among them.
    schema = "shard long, shards long, sizes array<int>, bits binary, rest binary, prints binary, counts binary, owners binary"
    dealt = held.withColumn("owner", F.coalesce("owner", F.lit(0).cast("long"))).withColumn("shard", F.pmod(F.col("h1"), F.lit(n)))
    return cut(dealt.groupBy("shard").applyInPandas(build, schema), "shards")


def index_bytes(shards: DataFrame) -> int:
    parts = sum((F.octet_length(c) for c in PARTS[1:]), F.lit(0))
    return int(shards.agg(F.sum(parts)).first()[0] or 0)


def _shard(first: np.ndarray, n: int) -> np.ndarray:
    return np.mod(first.view("<i8"), n)


def _kept(part, drops: list[set[int]], names: list[str]):
    """The columns of a batch with the text without its dropped lines, and the counts."""
    import pyarrow as pa

    texts, total, gone = [], [], []
    for text, drop in zip(part.column("_text"), drops):
        lines = lines_of(text.as_py())
        texts.append(b"\n".join(line for i, line in enumerate(lines) if i not in drop).decode("utf-8", "surrogatepass") if drop else text.as_py() or "")
        total.append(len(lines))
        gone.append(len(drop))
    return [part.column(c) for c in names] + [pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())]


def _probed(docs: DataFrame, shards: DataFrame, names: list[str], schema: str, out: list[str], least_chars: int, least_docs: int) -> DataFrame:
    """Every task has all shards."""
    held = docs.sparkSession.sparkContext.broadcast([r.asDict() for r in shards.collect()])

    def probe(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = {r["shard"]: Arrays(*(r[p] for p in PARTS)) for r in held.value}
        n = held.value[0]["shards"] if held.value else 1
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                drops: list[set[int]] = [set() for _ in range(part.num_rows)]
                rows, at, keys = [], [], []
                if known:
                    for r, text in enumerate(part.column("_text")):
                        for i, line in enumerate(lines_of(text.as_py())):
                            if (k := key_of(line, least_chars)) is not None:
                                rows.append(r)
                                at.append(i)
                                keys.append(k)
                if keys:
                    first, second = hashes(keys)
                    doc_ids = part.column("_doc")
                    rows_a, at_a = np.asarray(rows), np.asarray(at)
                    has = doc_ids.is_valid().to_numpy(zero_copy_only=False)[rows_a]
                    ids = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)[rows_a]
                    of = _shard(first, n)
                    for s in np.unique(of):
                        if s in known:
                            mine = np.flatnonzero(of == s)
                            for j in mine[known[s].dropped(first[mine], second[mine], ids[mine], has[mine], least_docs)]:
                                drops[rows_a[j]].add(int(at_a[j]))
                yield pa.RecordBatch.from_arrays(_kept(part, drops, names), names=out)

    return docs.mapInArrow(probe, schema)


def _dealt(docs: DataFrame, shards: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    """_row, drops: the numbers of the lines that go, for the rows that have any. Hashes of lines go to their
    shard, on one of its copies; a shard's arrays stand before them in the task's sorted stream."""
    n = int(shards.agg(F.max("shards")).first()[0] or 1)

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part, rows, ids, at, keys = b.slice(lo, ROWS), [], [], [], []
                for row, doc, text in zip(part.column("_row").to_pylist(), part.column("_doc").to_pylist(), part.column("_text")):
                    for i, line in enumerate(lines_of(text.as_py())):
                        if (k := key_of(line, least_chars)) is not None:
                            rows.append(row)
                            ids.append(doc)
                            at.append(i)
                            keys.append(k)
                if keys:
                    first, second = hashes(keys)
                    columns = [pa.array(_shard(first, n)), pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(at, pa.int64()), pa.array(first.view("<i8")), pa.array(second.view("<i8"))]
                    yield pa.RecordBatch.from_arrays(columns, names=["shard", "_row", "doc_id", "line", "h1", "h2"])

    probes = docs.select("_row", "_doc", "_text").mapInArrow(read, "shard long, _row long, doc_id long, line long, h1 long, h2 long")
    probes = probes.withColumns({"kind": F.lit(1), "salt": F.pmod(F.xxhash64("_row", "line"), F.lit(SALTS))})
    copies = shards.drop("shards").withColumns({"kind": F.lit(0), "salt": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))})
    stream = copies.unionByName(probes, allowMissingColumns=True).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def look(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shard, arrays = None, None
        for b in batches:
            at, of = 0, b.column("shard").to_pylist()
            kinds = b.column("kind").to_pylist()
            while at < b.num_rows:
                if not kinds[at]:
                    shard, arrays = of[at], Arrays(*(b.column(p)[at].as_py() for p in PARTS))
                    at += 1
                    continue
                to = at
                while to < b.num_rows and kinds[to] and of[to] == of[at]:
                    to += 1
                part = b.slice(at, to - at)
                if arrays is not None and shard == of[at]:
                    u = lambda c: part.column(c).to_numpy(zero_copy_only=False).view("<u8")
                    ids = part.column("doc_id")
                    gone = arrays.dropped(u("h1"), u("h2"), ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), least_docs)
                    if gone.any():
                        yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(gone)) for c in ("_row", "line")], names=["_row", "line"])
                at = to

    return stream.mapInArrow(look, "_row long, line long").groupBy("_row").agg(F.collect_list("line").alias("_drops"))


def deduplicated(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents with ``text`` rewritten, and n_lines (before) and n_dropped.

    Lines whose key has ``least_chars`` code points or more and stands in ``least_docs`` documents or more go,
    but for those of the largest doc_id that holds it. Null and empty texts are one empty line. Documents are
    told apart by doc_id: rows of one id are one document, so are all rows without an id, which never count
    as the largest. Texts of any length go whole; an empty table stays empty. Other columns are kept,
    whatever their names, but for n_lines and n_dropped, which are replaced."""
    shards = shards_of(common_lines(docs, least_chars, least_docs))
    names = [c for c in docs.columns if c.lower() not in ("text", "n_lines", "n_dropped")]
    inner = [f"_c{i}" for i in range(len(names))]
    held = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(names, inner)], F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("_text"))
    types = dict(held.dtypes)
    schema = ", ".join([f"{i} {types[i]}" for i in inner] + ["text string", "n_lines long", "n_dropped long"])
    out = [*inner, "text", "n_lines", "n_dropped"]
    if index_bytes(shards) <= broadcast_bytes:
        found = _probed(held, shards, inner, schema, out, least_chars, least_docs)
    else:
        # Rows need a number that a retry doesn't change.
        held = cut(held.withColumn("_row", F.monotonically_increasing_id()), "documents")
        drops = _dealt(held, shards, least_chars, least_docs).withColumnRenamed("_row", "_of")

        def rewrite(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in batches:
                for lo in range(0, b.num_rows, ROWS):
                    part = b.slice(lo, ROWS)
                    yield pa.RecordBatch.from_arrays(_kept(part, [set(d or ()) for d in part.column("_drops").to_pylist()], inner), names=out)

        found = held.join(drops, F.col("_row") == F.col("_of"), "left").drop("_of", "_row").mapInArrow(rewrite, schema)
    return found.withColumnsRenamed(dict(zip(inner, names)))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of deduplicated documents."""
    sha = free_name(docs, "kept_sha256")
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias(sha))
