"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits and mapped to its 32 popcounts. The
Manhattan distance of two such vectors never exceeds the Hamming distance of the fingerprints, so
fingerprints within 3 bits lie within Manhattan distance 3. The vectors are kept as 64 bits, each
count 0, 1, 2 in unary (00, 01, 11), so that a Manhattan distance is a popcount of an xor.

Grid: the 32 dimensions form six bands. Vectors within distance 3 differ in three bands at most and
so share the grid cell of at least one of the 20 choices of three bands. The range join meets
vectors by cell, drops those beyond Manhattan distance 3, and verifies the Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookreplay.llm.common import cut, free_name, row_key, whole_row

#: Dimensions in each band of the grid.
BANDS = (6, 6, 5, 5, 5, 5)
ODD = 0x5555555555555555


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cells() -> list[int]:
    """Bit masks of the 20 choices of three bands."""
    masks, at = [], 0
    for n in BANDS:
        masks.append(((1 << 2 * n) - 1) << at)
        at += 2 * n
    return [signed(a | b | c) for a, b, c in combinations(masks, 3)]


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Bit set where more than half of the shingle hashes have it. Shingles are ``width`` words of
    the text with A-Z lower-cased, repeats included; with fewer words the whole sequence; no word: 0."""
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= width:
        h = np.asarray([xxhash.xxh64_intdigest(joined, seed)], "<u8")
    else:
        ends = np.cumsum(np.fromiter(map(len, w), "i8", len(w)) + 1)
        starts = np.concatenate(([0], ends[: -width])).tolist()
        stops = (ends[width - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        h = np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts, stops)], "<u8", len(starts))
    ones = np.zeros(64, "i8")
    for lo in range(0, len(h), 4096):
        bits = np.unpackbits(h[lo : lo + 4096].view("u1").reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype="i4")
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``fingerprint`` (long) added instead of the text."""
    names = [c for c in docs.columns if c != text]
    slim = docs.select(*names, F.col(text).cast("string").alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in slim.drop("_text").dtypes) + ", fingerprint long"

    def mark(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            marks = [signed(fingerprint(text.as_py())) for text in b.column("_text")]
            cols = [b.column(c) for c in names] + [pa.array(marks, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "fingerprint"])

    return slim.mapInArrow(mark, schema)


def unary(fp: Column) -> Column:
    """The popcounts of the 32 two-bit segments, each in unary."""
    low, high = fp.bitwiseAND(F.lit(ODD)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(ODD))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs (a < b) of different fingerprints at up to ``radius`` differing bits, each once."""
    if radius > len(BANDS) - 3:
        raise ValueError("the grid finds every pair up to 3 bits only")
    masks = F.array(*[F.lit(m) for m in cells()])
    held = distinct.select("fingerprint", unary(F.col("fingerprint")).alias("counts"))
    keyed = held.select("*", F.posexplode(masks).alias("choice", "mask"))
    keyed = keyed.select("choice", F.col("counts").bitwiseAND(F.col("mask")).alias("cell"), "counts", "fingerprint")
    a, b = keyed.alias("a"), keyed.alias("b")
    meet = (
        (F.col("a.choice") == F.col("b.choice")) & (F.col("a.cell") == F.col("b.cell"))
        & (F.col("a.fingerprint") < F.col("b.fingerprint"))
        & (F.bit_count(F.col("a.counts").bitwiseXOR(F.col("b.counts"))) <= radius)
        & (F.bit_count(F.col("a.fingerprint").bitwiseXOR(F.col("b.fingerprint"))) <= radius)
    )
    return a.join(b, meet).select(F.col("a.fingerprint").alias("a"), F.col("b.fingerprint").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: the smallest node that can be reached, for the nodes of ``edges`` (a, b).

    Every node points at the smallest node known in its component; each round replaces links by links
    between what their ends point at (hooking the larger root to the smaller) and then follows
    pointers twice, so paths shorten by half or better. Each round's table is written out, which cuts
    the lineage; the driver sees only counts."""
    spark = edges.sparkSession
    both = edges.select("a", "b").union(edges.select("b", "a"))
    roots = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("node"), "root"), "roots")
    for _ in range(rounds):
        at = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        to = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        live = edges.join(at, "a").join(to, "b").where("ra <> rb")
        live = cut(live.select(F.greatest("ra", "rb").alias("high"), F.least("ra", "rb").alias("low")).distinct(), "live")
        if live.isEmpty():  # all nodes of a component point at one node, which can only be the smallest
            return roots
        hooks = live.groupBy("high").agg(F.min("low").alias("low"))
        hooked = roots.join(hooks, roots["node"] == hooks["high"], "left")
        hooked = hooked.select("node", F.least(F.col("root"), F.coalesce("low", "root")).alias("root"))
        roots = cut(_followed(_followed(hooked)), "roots")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _followed(roots: DataFrame) -> DataFrame:
    up = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
    return roots.join(up, "root").select("node", F.col("above").alias("root"))


def rooted(docs: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """The documents' doc_id, key (long, see row_key) and fingerprint; and fingerprint, first_id, root:
    the fingerprints, each once, with the smallest fingerprint of their component.

    Equal fingerprints become one node before any pair is made, so a large group of copies costs one node."""
    marked = cut(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("key"), "text")), "fingerprints")
    nodes = cut(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "nodes")
    found = cut(links(nodes, radius), "links")
    if found.isEmpty():
        return marked, nodes.withColumn("root", F.col("fingerprint"))
    roots = components(found)
    owned = nodes.join(roots, nodes["fingerprint"] == roots["node"], "left")
    return marked, cut(owned.select("fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root")), "owned")


def near_duplicates(docs: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (long), component_id: the smallest doc_id that links lead to.

    Null and empty texts have fingerprint zero and link like any others; rows with a null doc_id are
    returned and never name a component unless it has no other id. An empty table gives no rows."""
    marked, owned = rooted(docs, radius)
    heads = owned.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = owned.join(heads, "root").select("fingerprint", "component_id")
    # A fingerprint that a third of all documents share has one row on the right; its left rows split.
    return marked.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, radius: int = 3) -> DataFrame:
    """The documents without near-duplicates: of each component one row, that with the smallest doc_id
    (null last); where rows of that id differ in text, the smallest hash of both; and where rows of one id and
    text differ in other columns, the smallest hash of the whole row. So reruns and other partitionings give
    the same row.

    Ids may be null or repeat: a row is kept or not for what its own text is like. Null and empty texts are
    alike; equal rows are one. An empty table stays empty; columns are kept as they are, whatever their
    names."""
    marked, owned = rooted(docs, radius)
    # Rows of a fingerprint first, so that a large group of copies is summed up where it stands.
    least = marked.groupBy("fingerprint").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("head"))
    heads = least.join(owned, "fingerprint").groupBy("root").agg(F.min("head").alias("head"))
    own, key, of = (free_name(docs, n) for n in ("_id", "_head_key", "_key"))
    heads = heads.select(F.col("head.doc_id").alias(own), F.col("head.key").alias(key))
    keyed = docs.withColumn(of, row_key(docs))
    kept = keyed.join(heads, (F.col(of) == F.col(key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(own)), "left_semi")
    # Copies go first, summed where they stand; what is left of an id and text differs in other columns.
    row, nth = free_name(kept, "_row"), free_name(kept, "_nth")
    once = kept.withColumn(row, whole_row(docs)).dropDuplicates(["doc_id", of, row])
    first = Window.partitionBy("doc_id", of).orderBy(row)
    return once.withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).drop(of, row, nth)
