"""The prefix trie of conversations rebuilt from a base's head and their own suffix.

A sequence of turns has a fingerprint that composes: (length, sum of hash(turn i) * B^i mod 2^61 - 1), for two
bases B at once; the product of x and y is (|x| + |y|, f(x) + B^|x| f(y)). So a conversation's prefix
products are running sums over its own turns, and those of a rebuilt conversation follow symbolically: the
base's first products, then base head times own suffix, the suffix being what remains of the own product
when its head is divided away. No rebuilt text is made; a rebuilt turn is a reference to a stored one.

Prefixes with equal depth and fingerprint are one node. Equality is verified: all of a node's members
have one parent fingerprint, and where their last turns are different stored ones, role and text of these are
compared through the references. Should a node fail, everything is done again with other bases.

Every node belongs to the chain of its smallest member, and a chain's nodes follow each other in depth. So sums
over subtrees are sums over chains: totals of the tree of chains by pointer doubling, then running sums
inside each chain, in blocks. No step loops over depths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookreplay.functions.windows import running
from bookreplay.llm.common import cut
from bookreplay.llm.turns import blocks_of, in_order

P = (1 << 61) - 1
#: Turns that a base lends at most, and how many conversations follow each base.
MOST_HEAD, PER_BASE = 5, 100
#: Members' ids that one row holds.
CHUNK = 4096
ATTEMPTS = 8


def base_of(seed: int, which: int) -> int:
    """A multiplier of its own for each attempt and component."""
    return int.from_bytes(hashlib.sha256(f"{seed}:{which}".encode()).digest()[:7], "big") + 256


def times(a: Column, b: Column) -> Column:
    """a * b mod P of longs below P: the product has 37 digits at most."""
    whole = a.cast("decimal(19,0)") * b.cast("decimal(19,0)")
    return (whole % F.lit(P).cast("decimal(19,0)")).cast("long")


def plus(a: Column, b: Column) -> Column:
    return (a + b) % P


def minus(a: Column, b: Column) -> Column:
    return (a - b + P) % P


def head_length(conv: Column) -> Column:
    return (F.crc32(conv.cast("string")) % (MOST_HEAD + 1)).cast("int")


def weighted(turns: DataFrame, seed: int) -> DataFrame:
    """Adds t1, t2: the turn's hash times B^i, for both bases. Two seeds make two hashes."""
    bases = [base_of(seed, w) for w in (1, 2)]
    hashed = turns.withColumns({f"t{w}": F.pmod(F.xxhash64(F.lit(seed), F.lit(w), "role", "text"), F.lit(P)) for w in (1, 2)})
    names = [c for c in hashed.columns if c not in ("role", "text")]

    def weigh(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            made = []
            at = b.column("i").to_pylist()
            for w, base in enumerate(bases, 1):
                made.append(pa.array([t * pow(base, i, P) % P for t, i in zip(b.column(f"t{w}").to_pylist(), at)], pa.int64()))
            kept = [made[0] if c == "t1" else made[1] if c == "t2" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(kept, names=names)

    slim = hashed.select(*names)
    return slim.mapInArrow(weigh, ", ".join(f"{c} {t}" for c, t in slim.dtypes))


def products(turns: DataFrame, spans: DataFrame, seed: int) -> DataFrame:
    """conv_id, block, i (from 0), pos, n_chars, and the products f1, f2 of the turns before it and g1, g2 of those up to it."""
    at = spans.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "first_pos", "before")
    held = turns.withColumn("n_chars", F.length("text").cast("long"))
    held = held.join(at, (F.col("block") == F.col("_b")) & (F.col("conv_id") == F.col("_c"))).withColumn("i", F.col("pos") - F.col("first_pos") + F.col("before"))
    held = weighted(held.select("conv_id", "block", "i", "pos", "n_chars", "role", "text"), seed)
    sums = {f"g{w}": ("sum", F.col(f"t{w}").cast("decimal(38,0)")) for w in (1, 2)}
    held = running(held, sums, by="conv_id", order="i", inclusive=True)
    for w in (1, 2):
        held = held.withColumn(f"g{w}", (F.col(f"g{w}") % F.lit(P).cast("decimal(19,0)")).cast("long"))
        held = held.withColumn(f"f{w}", minus(F.col(f"g{w}"), F.col(f"t{w}")))
    return held.select("conv_id", "block", "i", "pos", "n_chars", "f1", "f2", "g1", "g2")


def rebuilt(own: DataFrame, spans: DataFrame, seed: int) -> DataFrame:
    """The prefixes of the rebuilt conversations: conv_id, depth, g1, g2 (product), f1, f2 (that of the parent), pos (the stored turn that
    it ends in), n_chars, is_end. Depth 0 has no turn."""
    head = F.struct("i", "pos", "n_chars", "f1", "f2", "g1", "g2")
    heads = own.where(F.col("i") < MOST_HEAD).groupBy("conv_id").agg(F.array_sort(F.collect_list(head)).alias("head"))
    heads = cut(heads.join(spans.groupBy("conv_id").agg(F.sum("n").alias("n")), "conv_id"), "heads")
    base = F.col("conv_id") - F.col("conv_id") % PER_BASE
    lent = heads.select(F.col("conv_id").alias("_base"), F.col("head").alias("lent"))
    # A base is met by at most PER_BASE conversations.
    convs = heads.withColumns({"h": head_length(F.col("conv_id")), "_of": base}).join(lent, F.col("_of") == F.col("_base"), "left")
    convs = convs.withColumn("lent", F.slice(F.coalesce("lent", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h")))
    m = F.size("lent")
    mine = F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))
    inverse = {w: F.array(*[F.lit(pow(base_of(seed, w), -k, P)) for k in range(MOST_HEAD + 1)]) for w in (1, 2)}
    zero = F.lit(0).cast("long")
    more: dict[str, Column] = {"m": m, "size": m.cast("long") + mine}
    for w in (1, 2):
        more[f"a{w}"] = F.coalesce(F.get("lent", F.size("lent") - 1)[f"g{w}"], zero)  # the base head's product
        more[f"b{w}"] = F.when(F.col("h") < F.col("n"), F.get("head", F.col("h") - 1)[f"g{w}"])  # the own head's, which is divided away
        more[f"b{w}"] = F.coalesce(more[f"b{w}"], zero)
        more[f"s{w}"] = F.get(inverse[w], F.col("h") - F.size("lent"))  # B^(m - h)
    convs = cut(convs.withColumns(more), "rebuilt")
    root = convs.select("conv_id", zero.alias("depth"), zero.alias("g1"), zero.alias("g2"), F.lit(None).cast("long").alias("f1"), F.lit(None).cast("long").alias("f2"),
                        F.lit(None).cast("long").alias("pos"), zero.alias("n_chars"), (F.col("size") == 0).alias("is_end"))
    start = convs.select("conv_id", "size", F.explode("lent").alias("x"))
    start = start.select("conv_id", (F.col("x.i") + 1).alias("depth"), *[F.col(f"x.{c}").alias(c) for c in ("g1", "g2", "f1", "f2", "pos", "n_chars")], (F.col("x.i") + 1 == F.col("size")).alias("is_end"))
    # Turns meet their conversation's few numbers by (conversation, block), so a long one is many keys.
    told = spans.select("conv_id", "block").join(convs.drop("lent", "head", "n", "_of", "_base"), "conv_id")
    rest = own.join(told, ["conv_id", "block"]).where(F.col("i") >= F.col("h"))
    depth = F.col("m") + F.col("i") - F.col("h") + 1
    move = lambda c, w: plus(F.col(f"a{w}"), times(minus(F.col(c), F.col(f"b{w}")), F.col(f"s{w}")))
    rest = rest.select("conv_id", depth.alias("depth"), *[move(f"{c}{w}", w).alias(f"{c}{w}") for c in "gf" for w in (1, 2)], "pos", "n_chars", (depth == F.col("size")).alias("is_end"))
    return root.unionByName(start).unionByName(rest)


def grouped(prefixes: DataFrame) -> DataFrame:
    """A row for each depth and product: conv_id (smallest member), n_convs, parent product, last turn's size, and what the check needs."""
    low_high = [f(c).alias(f"{n}_{c}") for c in ("f1", "f2", "pos") for n, f in (("low", F.min), ("high", F.max))]
    return prefixes.groupBy("depth", "g1", "g2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_chars").alias("n_chars"), *low_high)


def verified(nodes: DataFrame, prefixes: DataFrame, turns: DataFrame) -> bool:
    """Whether each node is one sequence: one parent, and one role and text by all its stored turns."""
    if not nodes.where("low_f1 <> high_f1 or low_f2 <> high_f2").isEmpty():
        return False
    open_ = nodes.where("low_pos <> high_pos").select("depth", "g1", "g2")
    # Each stored turn of such a node once; a turn that many members share is one row.
    refs = prefixes.join(open_, ["depth", "g1", "g2"], "left_semi").select("depth", "g1", "g2", "pos").distinct()
    said = refs.join(turns.select("pos", "role", "text"), "pos").groupBy("depth", "g1", "g2")
    return said.agg(F.min(F.struct("role", "text")).alias("low"), F.max(F.struct("role", "text")).alias("high")).where("low <> high").isEmpty()


def chain_totals(chains: DataFrame) -> DataFrame:
    """chain, leaves, saved: over the chain and all below it. ``chains``: chain, up (the chain that it hangs on,
    null for the root's), leaves, saved. Each round doubles the reach: a chain takes the sums of those that
    reach it, and then looks twice as far up; the driver sees whether any still looks up."""
    held = cut(chains, "chains")
    while not held.where("up is not null").isEmpty():
        given = held.where("up is not null").groupBy(F.col("up").alias("_to")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
        further = held.select(F.col("chain").alias("_at"), F.col("up").alias("_up")).where("_up is not null")
        held = held.join(given, F.col("chain") == F.col("_to"), "left").join(further, F.col("up") == F.col("_at"), "left")
        zero = F.lit(0).cast("long")
        held = cut(held.select("chain", F.col("_up").alias("up"), (F.col("leaves") + F.coalesce("_l", zero)).alias("leaves"), (F.col("saved") + F.coalesce("_s", zero)).alias("saved")), "chains")
    return held.select("chain", "leaves", "saved")


def ends(prefixes: DataFrame) -> DataFrame:
    """depth, g1, g2, ends_sha256 of the nodes where conversations end.

    Ids are sorted over all tasks and joined into texts of at most 4,096; a node's texts then pass one task in
    order, as its SHA-256 asks, a batch at a time."""
    keys = ["depth", "g1", "g2"]
    dealt = prefixes.where("is_end").select(*keys, "conv_id").repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id")

    def chunks(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([(c, pa.int64()) for c in (*keys, "first")] + [("ids", pa.string())])
        node, ids = None, []
        for b in batches:
            out = []
            for *k, conv in zip(*(b.column(c).to_pylist() for c in (*keys, "conv_id"))):
                if k != node or len(ids) >= CHUNK:
                    if ids:
                        out.append((*node, ids[0], ",".join(map(str, ids))))
                    node, ids = k, []
                ids.append(conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip((*node, ids[0], ",".join(map(str, ids))), schema)], schema=schema)

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([(c, pa.int64()) for c in keys] + [("ends_sha256", pa.string())])
        node, sha = None, None
        for b in batches:
            out = []
            for *k, ids in zip(*(b.column(c).to_pylist() for c in (*keys, "ids"))):
                if k != node:
                    if node:
                        out.append((*node, sha.hexdigest()))
                    node, sha = k, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip((*node, sha.hexdigest()), schema)], schema=schema)

    texts = dealt.mapInArrow(chunks, "depth long, g1 long, g2 long, first long, ids string")
    return texts.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(fold, "depth long, g1 long, g2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns go by turn (null first; of one turn by role and text), null roles and texts are empty. Conversation c is
    rebuilt from the first h turns of c - c % 100 (the remainder has c's sign; none if absent) and its own after
    its first h, h being crc32 of c in decimal modulo 6. Rows without a conv_id are no conversation and take no
    part. Repeated rows are turns of their own. Texts of any length go whole; other columns are not carried; an
    empty table gives no rows."""
    turns = in_order(conversations.where(F.col("conv_id").isNotNull()))
    spans = cut(blocks_of(turns), "spans")
    for seed in range(ATTEMPTS):
        own = cut(products(turns, spans, seed), "products")
        prefixes = cut(rebuilt(own, spans, seed), "prefixes")
        nodes = cut(grouped(prefixes), "nodes")
        if verified(nodes, prefixes, turns):
            return _described(nodes, prefixes)
    raise RuntimeError(f"fingerprints met in {ATTEMPTS} attempts")


def _described(nodes: DataFrame, prefixes: DataFrame) -> DataFrame:
    key = ["depth", "g1", "g2"]
    zero = F.lit(0).cast("long")
    # A node that very many hang on, such as the root, has its children summed before the shuffle; that they then
    # ask it for its smallest member is one join, whose larger side Spark splits where it is skewed.
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("low_f1").alias("g1"), F.col("low_f2").alias("g2")).agg(F.count(F.lit(1)).alias("n_children"))
    slim = nodes.select(*key, "conv_id", "n_convs", "low_f1", "low_f2", ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved"))
    slim = slim.join(below, key, "left").withColumn("n_children", F.coalesce("n_children", zero)).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    up = nodes.select((F.col("depth") + 1).alias("_d"), F.col("g1").alias("_g1"), F.col("g2").alias("_g2"), F.col("conv_id").alias("parent_conv_id"))
    slim = slim.join(up, (F.col("depth") == F.col("_d")) & (F.col("low_f1") == F.col("_g1")) & (F.col("low_f2") == F.col("_g2")), "left")
    slim = cut(slim.drop("_d", "_g1", "_g2", "low_f1", "low_f2"), "trie")
    chains = slim.groupBy(F.col("conv_id").alias("chain")).agg(
        F.min_by("parent_conv_id", "depth").alias("up"), (F.min("depth") - 1).alias("at"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    chains = cut(chains, "chains")
    totals = cut(chain_totals(chains.drop("at")), "totals")
    hung = chains.select("chain", "up", "at").where("up is not null").join(totals, "chain").groupBy(F.col("up").alias("_c"), F.col("at").alias("_d")).agg(
        F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
    held = slim.join(hung, (F.col("conv_id") == F.col("_c")) & (F.col("depth") == F.col("_d")), "left").drop("_c", "_d")
    held = held.withColumns({"_l": F.col("leaf") + F.coalesce("_l", zero), "_s": F.col("saved") + F.coalesce("_s", zero)})
    held = running(held, {"_lb": ("sum", F.col("_l")), "_sb": ("sum", F.col("_s"))}, by="conv_id", order="depth")
    # A chain's total reaches each of its nodes through its (conversation, block) of depths.
    held = held.withColumn("_block", F.floor(F.col("depth") / CHUNK))
    blocks = held.select("conv_id", "_block").distinct().join(totals.select(F.col("chain").alias("conv_id"), "leaves", F.col("saved").alias("_saved")), "conv_id")
    held = held.join(blocks, ["conv_id", "_block"])
    held = held.withColumns({"n_leaves": F.col("leaves") - F.coalesce("_lb", zero), "saved_tokens": F.col("_saved") - F.coalesce("_sb", zero)})
    held = held.join(ends(prefixes), key, "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return held.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
