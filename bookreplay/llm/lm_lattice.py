"""Language-model scores of texts by a subword lattice.

The vocabulary is that of a public tokenizer and stays as it is. A word is spelled by pieces of that
vocabulary; all its segmentations count, each weighted by the unigram scores of its pieces, and the
log-space forward recursion over the lattice gives the word's marginal probability. The scores are
counted on the words of the training documents: one table for the first piece of a word and one for
those after it, each over (piece, ends the word or not), so that the probabilities of all words sum
to one. A training word is an arc of its own across its lattice, weighted by its discounted count;
what the discounts free goes to the pieces. There is a set of tables for each class of documents (by
default their language); a text's probability is the mixture over classes of the product over its
words and its end.

Work is laid out so that nothing is gathered whole. Documents are read in chunks of a few MB; a chunk
keeps its documents as word numbers and sends each word once to the word's bucket. A bucket counts
its words over all chunks, later scores each of them once, and sends every chunk the numbers of its
words alone. Chunks and buckets grow in number with the corpus; the words of a bucket stay as many, but a
bucket with a very common word gets a row from every chunk.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookreplay.llm.common import cut, parts_for, text_bytes

#: Classes of documents: by a hash of the class column, so that any number of values gives no more.
CLASSES = 8
SPACE = "▁"

BAGS = "chunk string, bucket int, words array<binary>, word_at array<int>, word_class array<int>, word_n array<int>, doc_ids array<long>, held array<boolean>, sizes array<int>, at array<int>, n array<int>, tokens long, ends array<long>"
COUNTED = "bucket int, chunk string, idx array<int>, words array<binary>, by_class array<int>, keys array<long>, key_n array<long>, stats array<long>, distinct_train long"
#: What a training word's count gives up to the pieces.
DISCOUNT = 0.75
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double"


def is_held_out(doc_id: int | None) -> bool:
    """A null id is a training document."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


class Chunk:
    """Documents as word numbers, and the words they number."""

    def __init__(self, name: str, buckets: int):
        self.name, self.buckets = name, buckets
        self.number: dict[bytes, int] = {}
        self.docs: list[tuple] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str, kind: int) -> None:
        found = text.encode().lower().split()
        number = self.number
        at, n = np.unique(np.fromiter([number.setdefault(w, len(number)) for w in found], "i8", len(found)), return_counts=True)
        self.docs.append((doc_id, is_held_out(doc_id), kind, at, n))
        self.size += len(text)

    def rows(self) -> list[dict]:
        import xxhash

        words = list(self.number)
        bucket = np.fromiter([xxhash.xxh64_intdigest(w, 1) % self.buckets for w in words], "i8", len(words))
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(words), "i8")
        place[order] = np.arange(len(words))
        counts = np.zeros((CLASSES, len(words)), "i8")
        tokens, ends = 0, np.zeros(CLASSES, "i8")
        for _, held, kind, at, n in self.docs:
            if not held:
                counts[kind][place[at]] += n
                tokens += int(n.sum()) + 1
                ends[kind] += 1
        rows = []
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:]):
            kinds, at = np.nonzero(counts[:, a:b])
            rows.append({
                "chunk": self.name, "bucket": int(bucket[order[a]]), "words": [words[i] for i in order[a:b]],
                "word_at": at, "word_class": kinds, "word_n": counts[:, a:b][kinds, at],
            })
        flat = lambda k: np.concatenate([d[k] for d in self.docs]) if self.docs else np.empty(0, "i8")
        rows.append({
            "chunk": self.name, "bucket": -1, "doc_ids": [d[0] for d in self.docs], "held": [d[1] for d in self.docs],
            "sizes": [len(d[3]) for d in self.docs], "at": place[flat(3)] if len(words) else [], "n": flat(4), "tokens": tokens, "ends": ends,
        })
        return rows


def bags(docs: DataFrame, class_column: str | None, chunk_chars: int, buckets: int) -> DataFrame:
    """For each chunk a row of its documents (bucket -1), and one for each bucket that its words meet."""
    kind = F.coalesce(F.col(class_column).cast("string"), F.lit("")) if class_column else F.lit("")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (F.crc32(kind) % CLASSES).cast("int").alias("kind"))

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        chunk = Chunk(f"{part}-{nth}", buckets)

        def out(c: Chunk) -> Iterator:
            for row in c.rows():
                yield pa.RecordBatch.from_pylist([{k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in row.items()}], schema=arrow)

        arrow = pa.schema([
            ("chunk", pa.string()), ("bucket", pa.int32()), ("words", pa.list_(pa.binary())), ("word_at", pa.list_(pa.int32())),
            ("word_class", pa.list_(pa.int32())), ("word_n", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
            ("sizes", pa.list_(pa.int32())), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32())), ("tokens", pa.int64()), ("ends", pa.list_(pa.int64())),
        ])
        for b in batches:
            for doc_id, text, kind in zip(b.column("doc_id"), b.column("text"), b.column("kind")):
                chunk.add(doc_id.as_py(), text.as_py(), kind.as_py())
                if chunk.size >= chunk_chars:
                    yield from out(chunk)
                    nth += 1
                    chunk = Chunk(f"{part}-{nth}", buckets)
        if chunk.docs:
            yield from out(chunk)

    return slim.mapInArrow(read, BAGS)


class Pieces:
    """The pieces of a vocabulary file by their text, with their beginnings, and its byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.vocab_size()
        m = self.model
        usable = [i for i in range(self.size) if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i))]
        texts = [m.id_to_piece(i) for i in usable]
        self.ids: dict[str, int] = {t[:k]: -1 for t in texts for k in range(1, len(t))}
        self.ids |= dict(zip(texts, usable))
        self.bytes = {i: m.piece_to_id(f"<0x{i:02X}>") for i in range(256)}
        self.longest = max(map(len, texts))

    def spelled(self, word: str) -> list[int]:
        """A segmentation by single characters, for words that the tokenizer would alter."""
        out: list[int] = []
        for c in SPACE + word:
            i = self.ids.get(c, -1)
            out += [i] if i >= 0 else [self.bytes[b] for b in c.encode()]
        return out

    def segment(self, words: list[str]) -> list[list[int]]:
        """The tokenizer's own segmentation of each word."""
        m, out = self.model, []
        for word, ids in zip(words, m.encode(words, num_threads=1)):
            text = "".join([m.id_to_piece(i) for i in ids])
            out.append(ids if text == SPACE + word else self.spelled(word))
        return out

    def counts(self, words: list[str], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, count) of each table entry that the words' pieces use; n: (CLASSES, words)."""
        ids = self.segment(words)
        lens = np.fromiter(map(len, ids), "i8", len(ids))
        flat = np.fromiter((i for x in ids for i in x), "i8", int(lens.sum()))
        ends = np.cumsum(lens)
        rest, final = np.ones(len(flat), "i8"), np.zeros(len(flat), "i8")
        rest[ends - lens], final[ends - 1] = 0, 1
        entry = (rest * 2 + final) * self.size + flat
        keys, sums = [], []
        for kind in range(CLASSES):
            each = np.repeat(n[kind], lens)
            total = np.bincount(entry, weights=each, minlength=4 * self.size) if each.any() else np.zeros(0)
            used = np.flatnonzero(total)
            keys.append(used + kind * 4 * self.size)
            sums.append(total[used].astype("i8"))
        return np.concatenate(keys), np.concatenate(sums)


def forward(words: list[str], pieces: Pieces, tables: np.ndarray, cells: int = 60_000) -> np.ndarray:
    """Log probability of each word in each class: (words, classes). tables: (classes, rest or not,
    final or not, pieces) in log. Words go in batches of like lengths, of ``cells`` lattice nodes; a word
    longer than that goes alone, a character at a time."""
    out = np.empty((len(words), tables.shape[0]), "f4")
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    lo = 0
    while lo < len(order):
        if len(words[order[lo]]) + 2 > cells:
            out[order[lo]] = _forward_long(SPACE + words[order[lo]], pieces, tables)
            lo += 1
            continue
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * (len(words[order[hi]]) + 2) <= cells:
            hi += 1
        part = order[lo:hi]
        out[part] = _forward([SPACE + words[i] for i in part], pieces, tables)
        lo = hi
    return out


def _forward(words: list[str], pieces: Pieces, tables: np.ndarray) -> np.ndarray:
    get, k = pieces.ids.get, tables.shape[0]
    arcs: list[tuple[int, int, int, int]] = []  # end, word, start, piece
    odd: list[tuple[int, str]] = []
    for w, s in enumerate(words):
        n = len(s)
        for i in range(n):
            for j in range(i + 1, n + 1):
                p = get(s[i:j])
                if p is None:
                    break
                if p >= 0:
                    arcs.append((j, w, i, p))
            if get(s[i], -1) < 0:
                odd.append((len(arcs), s[i]))
                arcs.append((i + 1, w, i, 0))
    a = np.asarray(arcs, "i8")
    n = np.fromiter(map(len, words), "i8", len(words))
    end, word, start, piece = a.T
    rest, final = (start > 0).astype("i8"), (end == n[word]).astype("i8")
    weight = tables[:, rest, final, piece].T.astype("f8")  # a copy of its own
    for at, c in odd:  # characters that no piece has are spelled in bytes
        ids = [pieces.bytes[b] for b in c.encode()]
        weight[at] = sum(tables[:, int(rest[at] or m > 0), int(final[at] and m == len(ids) - 1), b] for m, b in enumerate(ids))
    order = np.lexsort((word, end))
    end, word, start, weight = end[order], word[order], start[order], weight[order]
    alpha = np.full((len(words), int(n.max()) + 1, k), -np.inf)
    alpha[:, 0] = 0
    steps = np.flatnonzero(np.diff(end, prepend=0, append=0))
    for x, y in zip(steps[:-1], steps[1:]):
        own, value = word[x:y], alpha[word[x:y], start[x:y]] + weight[x:y]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        top = np.maximum.reduceat(value, first)
        shift = np.where(np.isfinite(top), top, 0)
        spread = np.repeat(shift, np.diff(np.append(first, y - x)), axis=0)
        with np.errstate(divide="ignore"):
            alpha[own[first], end[x]] = shift + np.log(np.add.reduceat(np.exp(value - spread), first))
    return alpha[np.arange(len(words)), n]


def _forward_long(s: str, pieces: Pieces, tables: np.ndarray) -> np.ndarray:
    """The same for one word: only the last nodes that a piece can reach back to are held."""
    get, width = pieces.ids.get, pieces.longest + 1
    alpha = np.full((width, tables.shape[0]), -np.inf)
    alpha[0] = 0
    for j in range(1, len(s) + 1):
        final, terms = int(j == len(s)), []
        for i in range(max(0, j - pieces.longest), j):
            p = get(s[i:j], -1)
            if p >= 0:
                terms.append(alpha[i % width] + tables[:, int(i > 0), final, p])
        if get(s[j - 1], -1) < 0:
            ids = [pieces.bytes[b] for b in s[j - 1].encode()]
            terms.append(alpha[(j - 1) % width] + sum(tables[:, int(j > 1 or m > 0), int(final and m == len(ids) - 1), b] for m, b in enumerate(ids)))
        alpha[j % width] = np.logaddexp.reduce(terms, axis=0) if terms else -np.inf
    return alpha[len(s) % width]


_PIECES: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def lists(t, name: str):
    """All values of a list column in a row, and how many each row has."""
    column = t.column(name).combine_chunks()
    return column.flatten(), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype("i8")


def as_lists(values: np.ndarray, lens, kind):
    """A list column from its values in a row."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype("i4")), pa.array(values, kind))


def counted(bagged: DataFrame, path: str) -> DataFrame:
    """By bucket: its words with their training counts and piece counts (chunk null), and for each
    chunk where its words stand among them."""

    def count(t):
        import pyarrow as pa

        flat, lens = lists(t, "words")
        coded = flat.dictionary_encode()
        codes, distinct = coded.indices.to_numpy().astype("i8"), coded.dictionary
        at, at_lens = lists(t, "word_at")
        kinds, n = lists(t, "word_class")[0].to_numpy(), lists(t, "word_n")[0].to_numpy()
        own = codes[np.repeat(np.cumsum(lens) - lens, at_lens) + at.to_numpy()]
        total = np.zeros((CLASSES, len(distinct)), "i8")
        np.add.at(total, (kinds, own), n)
        all_n = total.sum(0)
        seen = np.flatnonzero(all_n)
        keys = sums = np.empty(0, "i8")
        if len(seen):
            # Pieces have to spell words not seen before, so each word counts once.
            keys, sums = pieces_of(path).counts([w.decode() for w in distinct.take(pa.array(seen)).to_pylist()], total[:, seen] > 0)
        stats = np.concatenate([total.sum(1), (total > 0).sum(1)])
        rows, bucket = t.num_rows, t.column("bucket")[0].as_py()
        none = lambda kind: pa.nulls(rows, kind)
        longs = pa.list_(pa.int64())
        first = [
            pa.array([bucket] * rows, pa.int32()), t.column("chunk").combine_chunks(), as_lists(codes, lens, pa.int32()),
            none(pa.list_(pa.binary())), none(pa.list_(pa.int32())), none(longs), none(longs), none(longs), none(pa.int64()),
        ]
        last = [
            pa.array([bucket], pa.int32()), pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct),
            as_lists(total.T.ravel(), [total.size], pa.int32()), *(as_lists(x, [len(x)], pa.int64()) for x in (keys, sums, stats)), pa.array([len(seen)], pa.int64()),
        ]
        names = [c.split()[0] for c in COUNTED.split(", ")]
        return pa.concat_tables([pa.Table.from_arrays(x, names=names) for x in (first, last)])

    return bagged.where("bucket >= 0").select("chunk", "bucket", "words", "word_at", "word_class", "word_n").groupBy("bucket").applyInArrow(count, COUNTED)


def score_tables(sums, active: list[int], size: int, alpha: float) -> np.ndarray:
    """Log scores (active classes and, last, all together; rest or not, final or not, pieces) from a pandas
    table of key and n. Each (piece, final) pair of a table has ``alpha`` counts to begin with, so every
    text has a probability."""
    dense = np.zeros(CLASSES * 4 * size)
    dense[sums["key"].to_numpy("i8")] = sums["n"].to_numpy("f8")
    t = dense.reshape(CLASSES, 2, 2, size)[active]
    t = np.concatenate([t, t.sum(axis=0, keepdims=True)]) + alpha
    return np.log(t / t.sum(axis=(2, 3), keepdims=True))


def lattice_scores(
    docs: DataFrame, vocabulary: str, class_column: str | None = "lang", chunk_chars: int = 4 << 20, bucket_bytes: int = 16 << 20, alpha: float = 0.1
) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and
    lattice_score (log10), learned from the documents that are not held out. ``lattice_score`` is that of
    the pieces alone: one set of tables for all classes, no word as an arc of its own.

    A null or empty text is its end alone; a null id is a training document. Repeated rows are counted and
    scored each. Words of any length are spelled whole. Without training documents the scores are those of
    the uniform tables. An empty table gives no rows; other columns are not carried, whatever their names.
    Only table entries reach the driver: four per piece and class, whatever the corpus."""
    spark = docs.sparkSession
    buckets = parts_for(text_bytes(docs, "text"), bucket_bytes)
    bagged = cut(bags(docs, class_column, chunk_chars, buckets), "lm-bags")
    words = cut(counted(bagged, vocabulary), "lm-words")
    sums = words.where("chunk is null").select(F.explode(F.arrays_zip("keys", "key_n")).alias("x")).groupBy(F.col("x.keys").alias("key")).agg(F.sum("x.key_n").alias("n")).toPandas()
    distinct = int(words.agg(F.sum("distinct_train")).first()[0] or 0)
    stats = np.zeros(2 * CLASSES)
    for r in words.select(F.posexplode("stats").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect():
        stats[r["i"]] = r["n"]
    of_docs = bagged.where("bucket = -1")
    tokens = int(of_docs.agg(F.sum("tokens")).first()[0] or 0)
    ends = np.zeros(CLASSES)
    for r in of_docs.select(F.posexplode("ends").alias("kind", "n")).groupBy("kind").agg(F.sum("n").alias("n")).collect():
        ends[r["kind"]] = r["n"]
    active = [i for i in range(CLASSES) if ends[i]] or [0]
    vocabulary_size = distinct + (ends.sum() > 0)
    log_prior = np.log((ends[active] + 0.5) / (ends[active].sum() + 0.5 * len(active)))
    stop = (ends.sum() + 0.5) / (tokens + 1)
    tables = spark.sparkContext.broadcast(score_tables(sums, active, pieces_of(vocabulary).size, alpha))
    seen, freed = np.maximum(stats[:CLASSES][active], 1), np.minimum(DISCOUNT * stats[CLASSES:][active], stats[:CLASSES][active])
    # Without a training word of its own a class has its pieces alone.
    to_pieces = np.log(np.where(freed > 0, freed / seen, 1.0))
    floor = np.log10(tokens + 0.5 * (vocabulary_size + 1))
    end_base, end_known = float(np.log10(ends.sum() + 0.5) - floor), bool(ends.sum())
    width = len(active) + 1

    def score_words(t):
        import pyarrow as pa
        import pyarrow.compute as pc

        row = t.filter(pc.is_null(t.column("chunk")))
        rest = t.filter(pc.is_valid(t.column("chunk")))
        own = lists(row, "words")[0]
        lp = forward([w.decode() for w in own.to_pylist()], pieces_of(vocabulary), tables.value)
        by_class = lists(row, "by_class")[0].to_numpy().reshape(-1, CLASSES)
        total = by_class.sum(1, dtype="i8")
        with np.errstate(divide="ignore"):
            whole = np.log(np.maximum(by_class[:, active] - DISCOUNT, 0) / seen)
        lp[:, :-1] = np.logaddexp(whole, lp[:, :-1] + to_pieces)
        idx, lens = lists(rest, "idx")
        idx = idx.to_numpy()
        columns = [rest.column("chunk").combine_chunks(), rest.column("bucket").combine_chunks(), as_lists(total[idx], lens, pa.int64()), as_lists(lp[idx].ravel(), lens * width, pa.float32())]
        return pa.Table.from_arrays(columns, names=["chunk", "bucket", "total", "lp"])

    scored = words.select("bucket", "chunk", "idx", "words", "by_class").groupBy("bucket").applyInArrow(score_words, "chunk string, bucket int, total array<long>, lp array<float>")
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("doc_ids", "array<long>"), ("held", "array<boolean>"), ("sizes", "array<int>"), ("at", "array<int>"), ("n", "array<int>"))]
    both = scored.select("chunk", "bucket", "total", "lp", *empty).unionByName(
        of_docs.select("chunk", "bucket", F.lit(None).cast("array<long>").alias("total"), F.lit(None).cast("array<float>").alias("lp"), "doc_ids", "held", "sizes", "at", "n")
    )

    def score_docs(t):
        import pyarrow as pa

        t = t.sort_by("bucket")
        total, lp = lists(t, "total")[0].to_numpy(), lists(t, "lp")[0].to_numpy().astype("f8").reshape(-1, width)
        base = np.log10(total + 0.5) - floor
        at, n, sizes = (lists(t, c)[0].to_numpy().astype("i8") for c in ("at", "n", "sizes"))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        add = lambda x: np.bincount(doc, weights=x, minlength=len(sizes))
        n_words = add(n)
        by_class = np.stack([add(n * lp[at, k]) for k in range(width)], axis=1)
        by_class += (n_words * np.log1p(-stop) + np.log(stop))[:, None]
        pieces_alone, by_class = by_class[:, -1] / np.log(10), by_class[:, :-1] + log_prior
        top = by_class.max(1)
        score = (top + np.log(np.exp(by_class - top[:, None]).sum(1))) / np.log(10)
        known = add(n * (total[at] > 0)).astype("i8") + end_known
        columns = [
            lists(t, "doc_ids")[0], lists(t, "held")[0], n_words.astype("i8") + 1, known, np.full(len(sizes), tokens, "i8"), add(n * base[at]) + end_base, score, pieces_alone,
        ]
        return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[c.split()[0] for c in RESULT.split(", ")])

    return both.groupBy("chunk").applyInArrow(score_docs, RESULT)
