"""Token-id files: documents compressed one by one against a shared zstandard dictionary.

Layout of a corpus folder:

* ``dictionary-<hash>.zdict``: the shared dictionary; ``<hash>`` is its SHA-256.
* ``part-NNNNN.ids``: for each document in turn a zstandard frame of its ids (little-endian
  unsigned 16-bit integers where the vocabulary allows, else 32-bit).
* ``part-NNNNN.idx``: a header line (JSON: dictionary hash, id width, counts), then for each document
  five little-endian signed 64-bit integers: doc_id, 1 if it is null, ids before it in the part, its
  number of ids, offset of its frame. A last record holds the totals.
* ``manifest/``: a Parquet table, a row per part: its number, ids before it, documents, ids, files.

A document is read by one seek into the index and one into the data (``read_document``).
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookreplay.llm import tokens
from bookreplay.llm.common import fresh_dir, parts_for, slices, text_bytes

RECORD = 5


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def put(folder: str, name: str, data: bytes, attempt: str) -> str:
    """Write under a name of this attempt's own, then rename: a retried task replaces the file whole."""
    fs, base = opened(folder)
    with fs.open_output_stream(f"{base}/_{name}.{attempt}", compression=None) as out:
        out.write(data)
    fs.move(f"{base}/_{name}.{attempt}", f"{base}/{name}")
    return f"{folder}/{name}"


def get(uri: str) -> bytes:
    fs, path = opened(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def serialized(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def widened(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{width}").astype("<u4")


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int, sample_docs: int, sample_chars: int, dict_bytes: int) -> bytes:
    """A dictionary from about ``sample_docs`` different whole texts, of those with at most ``sample_chars``
    characters, however many there are: those whose hash is low enough. It is for short documents, long ones have
    their own words to refer to, and only affects how small the files are. Where there is too little to
    train on, the dictionary is empty."""
    import zstandard

    part = docs.select(F.col("text").cast("string").alias("text")).where(F.length("text").between(1, sample_chars))
    space, total = 1 << 30, part.count()
    low = F.pmod(F.xxhash64("text"), F.lit(space)) < min(space, space * sample_docs // max(1, total))
    picked = part.where(low).distinct().orderBy(F.xxhash64("text"), "text").collect()
    ids_of = tokens.load(tokenizer).ids
    end = np.asarray([end_id], "<u4").tobytes()
    samples = [serialized(ids_of(r["text"]) + end, width) for r in picked]
    try:
        return zstandard.train_dictionary(dict_bytes, samples, threads=1).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_corpus(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, part_bytes: int = 24 << 20, level: int = 3,
    sample_docs: int = 800, sample_chars: int = 8000, dict_bytes: int = 64 << 10,
) -> DataFrame:
    """Write documents (doc_id, text) in ascending doc_id order, null ids first; returns the manifest.

    Rows with the same doc_id follow one another in the order of their texts. A null text is empty:
    the end id alone. ``part_bytes`` is how much text a part holds, about. An empty table writes the
    dictionary and a manifest without rows."""
    import zstandard
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    fs, base = opened(folder)
    fs.create_dir(base, recursive=True)
    highest = max(Tokenizer.from_file(tokenizer).get_vocab_size() - 1, end_id)
    width = 2 if highest < 1 << 16 else 4
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = train_dictionary(slim, tokenizer, end_id, width, sample_docs, sample_chars, dict_bytes)
    digest = hashlib.sha256(shared).hexdigest()
    put(folder, f"dictionary-{digest}.zdict", shared, "driver")
    parts = parts_for(text_bytes(slim, "text"), part_bytes)
    end = np.asarray([end_id], "<u4").tobytes()

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        ids_of = tokens.load(tokenizer).ids
        held = zstandard.ZstdCompressionDict(shared) if shared else None
        squeeze = zstandard.ZstdCompressor(level=level, dict_data=held).compress
        k, attempt = TaskContext.get().partitionId(), str(TaskContext.get().taskAttemptId())
        to, at = opened(folder)
        index, before, offset = [], 0, 0
        with to.open_output_stream(f"{at}/_part-{k:05d}.ids.{attempt}", compression=None) as out:
            for doc_id, texts in slices(batches, "doc_id", "text"):
                for doc, text in zip(doc_id, texts):
                    ids = ids_of(text) + end
                    frame = squeeze(serialized(ids, width))
                    out.write(frame)
                    index.append((doc or 0, int(doc is None), before, len(ids) // 4, offset))
                    before += len(ids) // 4
                    offset += len(frame)
        if not index:
            to.delete_file(f"{at}/_part-{k:05d}.ids.{attempt}")
            return
        to.move(f"{at}/_part-{k:05d}.ids.{attempt}", f"{at}/part-{k:05d}.ids")
        head = json.dumps({"dictionary": digest, "width": width, "documents": len(index), "ids": before}).encode() + b"\n"
        put(folder, f"part-{k:05d}.idx", head + np.asarray([*index, (0, 0, before, 0, offset)], "<i8").tobytes(), attempt)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([len(index)]), pa.array([before]), pa.array([f"part-{k:05d}"])], names=["part", "documents", "ids", "name"])

    # Spark samples what it ranges by, and texts are large: rows of one id part by the texts' beginnings.
    ranged = slim.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 32).asc_nulls_first())
    ordered = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    wrote = ordered.mapInArrow(write, "part int, documents long, ids long, name string")
    wrote.write.parquet(f"{folder}/_parts")
    done = spark.read.schema(wrote.schema).parquet(f"{folder}/_parts")
    # One row per part: a few MB of text each, so this window is over a small table.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = done.select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("start"), "documents", "ids", "name")
    manifest.coalesce(1).write.parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def _index(folder: str, name: str) -> tuple[dict, np.ndarray]:
    head, _, rest = get(f"{folder}/{name}.idx").partition(b"\n")
    return json.loads(head), np.frombuffer(rest, "<i8").reshape(-1, RECORD)


def _dictionary(folder: str, digest: str) -> bytes:
    held = get(f"{folder}/dictionary-{digest}.zdict")
    if hashlib.sha256(held).hexdigest() != digest:
        raise ValueError(f"the dictionary in {folder} is not the one that the index names")
    return held


def read_corpus(spark, folder: str, keep_ids: bool = False) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32; with ``keep_ids`` also ids. A task reads a part, a document at a time."""
    import zstandard

    manifest = spark.read.parquet(f"{folder}/manifest")

    columns = ["doc_id", "start", "n_tokens", "ids_crc32"] + (["ids"] if keep_ids else [])

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [*[pa.int64()] * 4, pa.list_(pa.int32())]
        for starts, names in slices(batches, "start", "name"):
            for start, name in zip(starts, names):
                head, index = _index(folder, name)
                shared = _dictionary(folder, head["dictionary"])
                held = zstandard.ZstdCompressionDict(shared) if shared else None
                unpack = zstandard.ZstdDecompressor(dict_data=held).decompress
                fs, base = opened(folder)
                with fs.open_input_stream(f"{base}/{name}.ids", compression=None) as f:
                    for lo in range(0, len(index) - 1, 1000):
                        rows = []
                        for i in range(lo, min(lo + 1000, len(index) - 1)):
                            doc, null, before, n, at = index[i].tolist()
                            ids = widened(unpack(f.read(int(index[i + 1][4]) - at)), head["width"])
                            row = (None if null else doc, start + before, len(ids), zlib.crc32(ids.tobytes()))
                            rows.append((*row, ids.astype("i4")) if keep_ids else row)
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=columns)

    parts = manifest.select("part", "start", "name").repartition(max(1, manifest.count()), "part").select("start", "name")
    return parts.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if keep_ids else ""))


def read_document(folder: str, name: str, nth: int) -> np.ndarray:
    """Ids of the nth document of a part, by its index entry alone."""
    import zstandard

    head, index = _index(folder, name)
    shared = _dictionary(folder, head["dictionary"])
    held = zstandard.ZstdCompressionDict(shared) if shared else None
    fs, base = opened(f"{folder}/{name}.ids")
    with fs.open_input_file(base) as f:
        f.seek(int(index[nth][4]))
        raw = f.read(int(index[nth + 1][4] - index[nth][4]))
    return widened(zstandard.ZstdDecompressor(dict_data=held).decompress(raw), head["width"])


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1, **options) -> DataFrame:
    """Write the documents to a new folder in the shared place and read the files back."""
    folder = fresh_dir(docs.sparkSession, "token-files")
    write_corpus(docs, folder, tokenizer, end_id, **options)
    return read_corpus(docs.sparkSession, folder)
