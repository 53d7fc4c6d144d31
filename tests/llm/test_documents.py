"""Operators on documents against brute force: nulls, empty and long texts, ties, repeated rows, empty
tables and clashing column names."""

import collections
import contextlib
import functools
import io
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from bookreplay.llm import lm_lattice, mixing, packing, quality, simhash, token_files, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _h string, size string, _id string, block string, copies int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sample():
    base = "the quick brown fox jumps over the lazy dog while seven wizards box quietly in a dim room near the old harbour wall"
    long = " ".join(f"word{i % 700}" for i in range(9000))
    texts = [
        base, base, base.replace("quietly", "Quietly"), None, "", "   ", "a b c d e f g h i j", "one", long, base + "\n" + base, "x " * 40, "naïve café ÉTÉ 日本語 \x1f end",
        "line one here\nline one here\n\nother line\n", "# $ * % & | < >  words of symbols and more of them here", " lead and trail ", "a\n b  c\t\td",
    ]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("s1", "s2", None, "s3")[i % 4], 0, "clash", "clash", "clash", "clash", 7) for i, t in enumerate(texts)]
    rows += [rows[0], (None, base, "en", "s1", 0, None, None, None, None, None), (None, None, None, None, 0, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_ids_are_the_tokenizers(name):
    path = public_tokenizers.path(name)
    plain, ours = Tokenizer.from_file(path), tokens.load(path)
    texts = [t or "" for _, t, *_ in sample()] + ["<|endoftext|> x<|endoftext|>", "it's we'll\n\n  don't", "é İ ǅ Σας", "1² ½ ª_º"]
    for t in texts:
        assert np.frombuffer(ours.ids(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def token_bytes(name, end):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda t: np.asarray(plain.encode(t or "", add_special_tokens=False).ids + [end], "<u4")


def test_packing(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack_documents(docs, path, size=64, keep_ids=True).collect()
    ids_of = token_bytes("byte_bpe_50k.json", 0)
    want = collections.Counter()
    for doc, t, *_ in sample():
        ids = ids_of(t)
        first = (len(ids) - 1) % 64 + 1
        cuts = [0, *range(first, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and sum(n for _, n in places) <= 64
    total = sum(r.length for r in got)
    assert len(by) <= total / 64 * 1.1 + 2
    assert packing.pack_documents(none, path).count() == 0


@pytest.mark.parametrize("counts", [{5: 3}, {10: 1}, {3: 4, 7: 4}, {2: 2, 3: 2, 5: 2}, {6: 1, 4: 1, 1: 9}, {9: 5, 8: 5, 2: 3, 1: 2}])
def test_plan_uses_every_piece_once(counts):
    used = collections.Counter()
    for lengths, times in packing.plan(counts, 10):
        assert sum(lengths) <= 10
        for v in lengths:
            used[v] += times
    assert used == collections.Counter(counts)
    places = packing.places(packing.plan(counts, 10))
    for v, n in counts.items():
        spans = sorted((a, b) for length, a, b, *_ in places if length == v)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


def test_exact_complements_close_sequences():
    assert packing.plan({6: 1, 3: 1, 1: 1, 4: 1, 5: 1}, 10) in ([((6, 4), 1), ((5, 3, 1), 1)],)
    assert packing.plan({7: 2, 1: 4, 2: 1}, 10)[0] == ((7, 2, 1), 1)


def test_token_files_round_trip(spark, docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    folder = token_files.fresh_dir(spark, "files")
    manifest = token_files.write_corpus(docs, folder, path, 1, part_bytes=20_000).orderBy("part").collect()
    got = token_files.read_corpus(spark, folder, keep_ids=True).collect()
    ids_of = token_bytes("word_bpe_49k.json", 1)
    order = sorted(sample(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, start = [], 0
    for doc, t, *_ in order:
        ids = ids_of(t)
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        start += len(ids)
    assert sorted((r.start, r.n_tokens, r.ids_crc32, tuple(r.ids)) for r in got) == sorted((s, n, c, tuple(i)) for _, s, n, c, i in want)
    assert collections.Counter((r.doc_id, r.ids_crc32) for r in got) == collections.Counter((d, c) for d, _, _, c, _ in want)
    assert [m.start for m in manifest] == np.cumsum([0, *[m.ids for m in manifest]])[:-1].tolist()
    last = manifest[-1]
    assert token_files.read_document(folder, last.name, last.documents - 1).tolist() == want[-1][4]
    assert token_files.round_trip(none, path).count() == 0


def slow_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(spark, docs, none):
    got = simhash.near_duplicates(docs).select("doc_id", simhash.as_hex(simhash.F.col("fingerprint")).alias("f"), "component_id").collect()
    assert collections.Counter((r.doc_id, r.f) for r in got) == collections.Counter((d, f"{slow_fingerprint(t):016x}") for d, t, *_ in sample())
    assert {r.component_id for r in got if r.doc_id in (0, 1, 2)} == {0}
    assert {r.component_id for r in got if r.f == "0" * 16} == {3}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and len({r.doc_id for r in kept.collect()}) == kept.count()


def test_keep_one_keeps_a_row_of_each_component(spark):
    text = lambda k: " ".join(f"{zlib.crc32(f'{k} {i}'.encode()):x}" for i in range(40))
    rows = [(None, text(k)) for k in range(6)] + [(None, text(0)), (1, text(10)), (1, text(11)), (1, text(11)), (2, text(11)), (3, text(5)), (4, text(12)), (None, text(12))]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, _id string, key string").repartition(3)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    want = [(None, text(k)) for k in range(5)] + [(3, text(5)), (1, text(10)), (1, text(11)), (4, text(12))]
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == collections.Counter(want)


def test_mixing_places_rows_of_one_id_apart(spark):
    df = spark.createDataFrame([(None if k % 2 else 7, f"w{k} w w", "one") for k in range(600)], "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(df, budget=0.5, most=1.0).collect()
    assert abs(sum(r.taken for r in got) - 900) <= 6 and {r.taken for r in got} == {0, 3}
    assert mixing.mixed_documents(df, budget=0.5, most=1.0).count() == sum(r.copies for r in got)


def test_links_and_components_by_brute_force(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 40, dtype="u8")
    marks = {int(s) for s in seeds}
    for s in seeds:
        x = int(s)
        for _ in range(12):  # chains whose ends are far apart
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(b)
            marks.add(x)
    fps = sorted(simhash.signed(m) for m in marks)
    df = spark.createDataFrame([(f,) for f in fps], "fingerprint long")
    want = {(a, b) for a in fps for b in fps if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    edges = simhash.links(df)
    assert {(r.a, r.b) for r in edges.collect()} == want
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in want:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {r.node: r.root for r in simhash.components(edges).collect()} == {f: find(f) for f in fps if any(f in p for p in want)}


def test_mixing(spark, docs, none):
    rows = [(i, "w " * (i % 7 + 1), "en", f"s{i % 5}" if i % 5 else None, 0, "", "", "", "", 1) for i in range(4000)] + [(9999, None, "en", "empty", 0, "", "", "", "", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = mixing.mix(df).collect()
    size = collections.Counter()
    for _, t, _, s, *_ in rows:
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(size.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * size[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2 * size[s]
            left -= target[s]
        open_ -= full
    taken = collections.Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 and r.taken == r.copies * r.size and r.copies in (0, 1, 2)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 8 for s in order)
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix(none).count() == 0 and mixing.mix(docs).count() == len(sample()) and mixing.mixed_documents(docs).columns == docs.columns


def test_nested_budgets_take_supersets(spark):
    df = spark.createDataFrame([(i, "w " * (i % 3 + 1), "", "one", 0, "", "", "", "", 1) for i in range(500)], SCHEMA)
    small, large = ({r.doc_id for r in mixing.mix(df, budget=b, most=1.0).collect() if r.taken} for b in (0.3, 0.6))
    assert small < large


def slow_base(t):
    w = words(t)
    c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_labels_set_the_quality_threshold(spark):
    rng = np.random.default_rng(7)
    common, rare = [f"w{i}" for i in range(20)], [f"v{i}" for i in range(20)]
    text = lambda share: " ".join(str(rng.choice(rare if rng.random() < share else common)) for _ in range(80))
    rows = [(i, text(0 if i % 4 else 0.05), i % 4) for i in range(800)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(k > 0), 0) for i, _, k in rows if i < 600], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(df, labels).collect()}
    assert sum(got[i].score >= quality.THRESHOLD for i, _, k in rows if not k) > 100  # the fixed threshold keeps most of the bad ones
    kept = lambda ids: sum(got[i].kept for i in ids) / len(ids)
    for new in (False, True):  # labelled or not
        assert kept([i for i, _, k in rows if k and (i >= 600) == new]) > 0.9 and kept([i for i, _, k in rows if not k and (i >= 600) == new]) < 0.1
    assert {r.doc_id: r.kept for r in quality.judge(df.repartition(5), labels).collect()} == {i: r.kept for i, r in got.items()}
    assert quality.split_point([3.0, 4.0, 5.0], [0.0, 1.0, 3.0]) == 3.5 and quality.split_point([3.0, 4.0], [0.0, 1.0]) == 2.0


def labelled_corpus(spark):
    """More labelled documents than any bound that once held: 22,000 good ones, 6,000 bad ones, 2,000 without a label."""
    word = "concat(if(pmod(hash(id, k), 10) < if(id % 30 < 6, 5, 2), 'v', 'w'), pmod(hash(k, id, 7), 15))"
    docs = spark.range(30_000).selectExpr("id as doc_id", f"array_join(transform(sequence(1, 12), k -> {word}), ' ') as text")
    labels = spark.range(30_000).where("id % 30 < 28").selectExpr("id as doc_id", "cast(id % 30 >= 6 as int) as quality", "0 as toxic")
    return docs, labels


def slow_quality(rows, good, bad):
    """Scores and threshold from every labelled document, one at a time; all texts have 12 words, repeat no window."""
    import struct

    word = functools.cache(lambda w: xxhash.xxh64_intdigest(w.encode(), 42))
    pair = functools.cache(lambda a, b: xxhash.xxh64_intdigest(struct.pack("<Q", word(b)), xxhash.xxh64_intdigest(struct.pack("<Q", word(a)), 42)))
    bucket = lambda h: (h - (1 << 64) if h >> 63 else h) % quality.BUCKETS
    grams = {}
    for d, t in rows:
        w = t.split(" ")
        grams[d] = np.asarray([bucket(word(x)) for x in w] + [bucket(pair(x, y)) for x, y in zip(w, w[1:])])
    n = np.bincount(np.concatenate(list(grams.values())), minlength=quality.BUCKETS) + 0.5
    held = np.bincount(np.concatenate([grams[d] for d in good]), minlength=quality.BUCKETS)
    p = n / n.sum()
    ratio = np.log((held + quality.PRIOR * p) / (held.sum() + quality.PRIOR) / p)

    def own(g):
        mine = (g[:, None] == g[None, :]).sum(1)
        return np.log((held[g] - mine + quality.PRIOR * p[g]) / (held.sum() - len(g) + quality.PRIOR) / p[g]).mean()

    at = quality.split_point([round(own(grams[d]), 9) for d in good], [round(ratio[grams[d]].mean(), 9) for d in bad])
    return {d: ratio[g].mean() for d, g in grams.items()}, at


def test_quality_counts_and_threshold_take_every_label(spark, monkeypatch):
    docs, labels = labelled_corpus(spark)
    rows, of = docs.collect(), {r.doc_id: r.quality for r in labels.collect()}
    want, at = slow_quality(rows, [d for d in of if of[d]], [d for d in of if not of[d]])
    for rows_broadcast in (500_000, 0):  # labels by broadcast, and by a shuffle
        monkeypatch.setattr(quality, "BROADCAST_ROWS", rows_broadcast, raising=False)
        got = quality.judge(docs, labels).select("doc_id", "score", "kept", "base_failed").collect()
        assert len(got) == 30_000 and max(abs(r.score - want[r.doc_id]) for r in got) < 1e-8
        wrong = [r for r in got if r.kept != (not r.base_failed and r.score >= at) and abs(r.score - at) > 1e-8]
        assert not wrong and 0 < sum(r.kept for r in got) < 30_000


def test_pipeline_quality_stage_takes_every_label(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled_corpus(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows, of = docs.collect(), {r.doc_id: r.quality for r in labels.collect()}
    want, at = slow_quality(rows, [d for d in of if of[d]], [d for d in of if not of[d]])
    got = {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, str(tmp_path)).collect()}
    failed = {r.doc_id for r in quality.judge(docs, labels).where("base_failed").collect()}
    clear = [d for d in want if abs(want[d] - at) > 1e-8 and d not in failed]
    assert len(clear) > 29_000 and all((d in got) == (want[d] >= at) for d in clear) and not got & failed


def test_quality_threshold_takes_toxic_documents_of_good_quality(spark, tmp_path):
    import corpus_pipeline

    word = lambda i, k: f"{'v' if (i + k) % 10 < (7, 3, 5)[i % 3] else 'w'}{(i * 7 + k * k) % 9}"
    rows = [(i, " ".join(word(i, k) for k in range(12))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # Of low quality; good; good and toxic, or with no word on that: not trusted, but good.
    labels = spark.createDataFrame([(i, int(i % 3 > 0), (None if i % 2 else 1) if i % 3 == 2 else 0) for i in range(900)], "doc_id long, quality int, toxic int")
    want = slow_threshold(rows, [i for i in range(900) if i % 3 == 1], [i for i in range(900) if i % 3 == 2], [i for i in range(900) if i % 3 == 0])
    bits, failed = quality.label_bits(labels), quality.judge(docs, labels).where("base_failed").count()
    got = quality.threshold_of(docs, bits, quality.gram_counts(docs, bits))
    assert not failed and abs(got - want) < 1e-8
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, str(tmp_path)).collect()}
    assert kept == {r.doc_id for r in quality.judge(docs, labels, threshold=want).where("kept").collect()}


def slow_threshold(rows, trusted, toxic, bad):
    """``slow_quality``'s threshold where toxic documents of good quality have no counts but a say."""
    scores, _ = slow_quality(rows, trusted, bad)
    own, split = [], quality.split_point
    try:
        quality.split_point = lambda good, bad: own.extend(good) or 0.0
        slow_quality(rows, trusted, bad)
    finally:
        quality.split_point = split
    return split(own + [round(scores[d], 9) for d in toxic], [round(scores[d], 9) for d in bad])


def test_quality_plans_hold_no_bucket_values(spark, docs, monkeypatch):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(9)], "doc_id long, quality int, toxic int")
    shown, split_of = [], quality.split_of

    def said(df):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            df.explain("extended")
        shown.append(len(out.getvalue()))

    monkeypatch.setattr(quality, "split_of", lambda scores: said(scores) or split_of(scores))
    said(quality.judge(docs, labels))
    said(quality.kept_documents(docs, labels))
    assert len(shown) == 4 and max(shown) < 10 * quality.BUCKETS  # 10,000 values alone take some 200,000 characters


def test_quality_split_on_many_and_few_scores(spark):
    rng = np.random.default_rng(3)
    for n, step in ((3000, 10**9), (3000, 7), (50, 10**8), (10, 1)):
        good, bad = (rng.integers(0, 100, n) * step + 30 * step).tolist(), (rng.integers(0, 100, n) * step).tolist()
        df = spark.createDataFrame([(x, 1, 0) for x in good] + [(x, 0, 1) for x in bad] + [(-5, 0, 0)], "at long, good int, bad int")
        want = quality.split_point([x / 1e9 for x in good], [x / 1e9 for x in bad]) if n >= quality.LEAST else None
        assert quality.split_of(df) == want
    apart = spark.createDataFrame([(1, 0, 1)] * 30 + [(1, 1, 0)] * 30, "at long, good int, bad int")
    assert quality.split_of(apart) == 1e-9  # nothing parts them: all stay


def test_quality_base_columns_and_score(spark, docs, none):
    labels = spark.createDataFrame([(0, 1, 0), (6, 1, 0), (8, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels).collect()
    want = collections.Counter()
    for d, t, *_ in sample():
        b = slow_base(t)
        want[(d, *b, b[0] < 10 or 100 * b[4] > 20 * b[0])] += 1
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    import struct

    def grams(t):
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in words(t)]
        pair = lambda a, b: xxhash.xxh64_intdigest(struct.pack("<Q", b), xxhash.xxh64_intdigest(struct.pack("<Q", a), 42))
        return [signed(x) % quality.BUCKETS for x in [*h, *map(pair, h, h[1:])]]

    n, good = np.full(quality.BUCKETS, 0.5), np.zeros(quality.BUCKETS)
    for d, t, *_ in sample():
        np.add.at(n, grams(t), 1)
        if d in (0, 6):
            np.add.at(good, grams(t), 1)
    p = n / n.sum()
    ratio = np.log((good + quality.PRIOR * p) / (good.sum() + quality.PRIOR) / p)
    scores = {r.doc_id: r.score for r in got if r.doc_id is not None}
    for d, t, *_ in sample():
        if d is not None:
            g = grams(t)
            assert abs(scores[d] - (ratio[g].mean() if g else 0)) < 1e-6
    assert all(r.kept == (not r.base_failed and r.score >= quality.THRESHOLD) for r in got)
    kept = quality.kept_documents(docs, labels)
    assert kept.columns == docs.columns and {r._h for r in kept.collect()} <= {"clash", None} and kept.count() == sum(r.kept for r in got)
    assert quality.judge(none, labels.limit(0)).count() == 0


def slow_word(word, pieces, table):
    """Marginal log probability by recursion over all segmentations, in plain probabilities."""
    s = lm_lattice.SPACE + word

    def spell(i, first):
        if i == len(s):
            return 1.0
        total = 0.0
        for j in range(i + 1, len(s) + 1):
            p, final = pieces.ids.get(s[i:j], -1), int(j == len(s))
            if p >= 0:
                total += np.exp(table[int(not first), final, p]) * spell(j, False)
        if pieces.ids.get(s[i], -1) < 0:
            ids = [pieces.bytes[b] for b in s[i].encode()]
            q = sum(table[int(not first or m > 0), int(i + 1 == len(s) and m == len(ids) - 1), b] for m, b in enumerate(ids))
            total += np.exp(q) * spell(i + 1, False)
        return total

    return np.log(spell(0, True))


def test_forward_recursion_is_the_sum_over_segmentations():
    pieces = lm_lattice.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(1)
    t = rng.random((2, 2, 2, pieces.size))
    tables = np.log(t / t.sum(axis=(2, 3), keepdims=True))
    words_ = ["the", "harbour", "a", "日本", "x\U0001F600y", "naïve", "###", "thing" * 3]
    got = lm_lattice.forward(words_, pieces, tables, cells=30)
    for i, w in enumerate(words_):
        for k in range(2):
            assert abs(got[i, k] - slow_word(w, pieces, tables[k])) < 1e-4


def test_lattice_scores(spark, docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = lm_lattice.lattice_scores(docs, path, chunk_chars=300, bucket_bytes=2000).collect()
    train, end = collections.Counter(), 0
    for d, t, *_ in sample():
        if not lm_lattice.is_held_out(d):
            train.update((t or "").encode().lower().split())
            end += 1
    n = sum(train.values()) + end
    v = len(train) + 1
    want = collections.Counter()
    for d, t, *_ in sample():
        w = (t or "").encode().lower().split()
        base = sum(np.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w) + np.log10((end + 0.5) / (n + 0.5 * (v + 1)))
        want[d, lm_lattice.is_held_out(d), len(w) + 1, sum(train[x] > 0 for x in w) + 1, n, round(float(base), 5)] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    whole = lm_lattice.lattice_scores(docs, path).collect()  # neither chunks nor buckets change a score
    assert sorted((r.doc_id or -1, round(r.score, 3)) for r in whole) == sorted((r.doc_id or -1, round(r.score, 3)) for r in got)
    assert lm_lattice.lattice_scores(none, path).count() == 0


def test_lattice_model_beats_the_base_on_held_out_texts(spark):
    rng = np.random.default_rng(5)
    lex = {k: [f"{k}{'abcdefghij'[i % 10]}{'klmnop'[i % 6]}er{i % 4}" for i in range(60)] for k in ("la", "der", "el")}
    rows = []
    for i in range(400):
        k = ("la", "der", "el")[i % 3]
        rows.append((i, " ".join(rng.choice(lex[k], 40)), k, "s", 0, "", "", "", "", 1))
    got = lm_lattice.lattice_scores(spark.createDataFrame(rows, SCHEMA), public_tokenizers.path("piece_bpe_32k.model")).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_caches_are_bounded_and_decide_nothing(name):
    path = public_tokenizers.path(name)
    plain, ours = Tokenizer.from_file(path), tokens.TokenIds(path, room=1 << 14)
    rng = np.random.default_rng(4)
    parts = [" ", "  ", "\n", "a", "Ab", "É", "ß", "İ", "日", "½", ".", ",'s", "’", "…", "\x1f", "\x85", "\xa0", "Ɓ", "œ", "<|endoftext|>", "\r\n", "-", "9"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 14))) for _ in range(3000)] + [" ".join(f"w{k}x{j}" for j in range(50)) for k in range(40)]
    texts += [f"a {chr(c)} b{chr(c)}" for c in (*range(1, 0x250), *range(0x2000, 0x2100))]
    for t in texts:
        assert np.frombuffer(ours.ids(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)
        assert ours.pieces.held <= ours.pieces.room and len(ours.pieces) + len(ours.pieces.older) <= 2 * ours.pieces.room / tokens.ENTRY


def test_sums_index_finds_every_exact_complement():
    rng = np.random.default_rng(6)
    for _ in range(60):
        left = [0, *rng.choice([0, 0, 1, 2], 24).tolist()]
        have = [v for v in range(1, 25) if left[v]]
        sums, fits = packing.Sums(left), lambda x: all(left[v] >= x.count(v) for v in x)
        for gap in range(1, 25):
            pairs = [x for x in ((a, gap - a) for a in have if gap - a in have and gap - a <= a) if fits(x)]
            triples = [x for x in ((a, b, gap - a - b) for a in have for b in have if b <= a and gap - a - b in have and gap - a - b <= b) if fits(x)]
            got = sums.exact(gap, {})
            want = [(gap,)] if left[gap] else pairs or triples
            assert (got in want) if want else got is None, (left, gap, got, want)


def test_parts_split_a_repeated_id(spark):
    rows = [(None if k % 2 else 5, f"text {k % 900:04d} " + "x" * 40) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = public_tokenizers.path("word_bpe_49k.json")
    folder = token_files.fresh_dir(spark, "files")
    assert token_files.write_corpus(df, folder, path, 1, part_bytes=16_000).count() > 4
    got = [tuple(r) for r in token_files.read_corpus(spark, folder).orderBy("start").collect()]
    ids_of = token_bytes("word_bpe_49k.json", 1)
    want, start = [], 0
    for doc, t in sorted(rows, key=lambda r: (r[0] is not None, r[1])):
        ids = ids_of(t)
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_long_words_are_spelled_whole():
    pieces = lm_lattice.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    t = np.random.default_rng(2).random((2, 2, 2, pieces.size))
    tables = np.log(t / t.sum(axis=(2, 3), keepdims=True))
    words_ = ["the", "a", "日本x\U0001F600y", "thing" * 9, "naïve###" * 7]
    assert np.allclose(lm_lattice.forward(words_, pieces, tables), lm_lattice.forward(words_, pieces, tables, cells=1), atol=1e-3)
    assert np.isfinite(lm_lattice.forward(["ab" * 40_000], pieces, tables)).all()


def test_lattice_score_by_brute_force(spark):
    path, alpha = public_tokenizers.path("piece_bpe_32k.model"), 0.1
    rng = np.random.default_rng(9)
    lex = ["sun", "moon", "tide", "été", "run", "runs", "x1", "日本"]
    rows = [(i, " ".join(rng.choice(lex, rng.integers(0, 9))), ("en", "fr")[i % 2]) for i in range(40)] + [(41, None, None), (44, "unseen words", "de")]
    got = {r.doc_id: (r.score, r.lattice_score) for r in lm_lattice.lattice_scores(spark.createDataFrame(rows, "doc_id long, text string, lang string"), path, alpha=alpha, chunk_chars=40, bucket_bytes=60).collect()}
    kind = {lang: zlib.crc32((lang or "").encode()) % lm_lattice.CLASSES for _, _, lang in rows}
    train = [(t or "", kind[lang]) for i, t, lang in rows if not lm_lattice.is_held_out(i)]
    classes = sorted({k for _, k in train})
    pieces = lm_lattice.pieces_of(path)
    counts = {k: collections.Counter(w for t, c in train if c == k for w in t.split()) for k in classes}
    ends = {k: sum(c == k for _, c in train) for k in classes}
    tables, whole = {}, np.full((2, 2, pieces.size), alpha)
    for k in classes:
        table = np.full((2, 2, pieces.size), alpha)
        for w in counts[k]:
            ids = pieces.segment([w])[0]
            for n, p in enumerate(ids):
                table[int(n > 0), int(n == len(ids) - 1), p] += 1
        tables[k] = np.log(table / table.sum(axis=(1, 2), keepdims=True))
        whole += table - alpha
    whole = np.log(whole / whole.sum(axis=(1, 2), keepdims=True))
    total = sum(sum(c.values()) for c in counts.values()) + len(train)
    stop = (len(train) + 0.5) / (total + 1)

    def word(w, k):
        seen, kinds = sum(counts[k].values()), len(counts[k])
        freed = min(lm_lattice.DISCOUNT * kinds, seen)
        spelled = np.exp(slow_word(w, pieces, tables[k]))
        return max(counts[k][w] - lm_lattice.DISCOUNT, 0) / max(seen, 1) + (freed / seen if freed else 1.0) * spelled

    for i, t, _ in rows:
        p = sum((ends[k] + 0.5) / (len(train) + 0.5 * len(classes)) * np.prod([word(w, k) * (1 - stop) for w in (t or "").split()] or [1.0]) * stop for k in classes)
        alone = sum(slow_word(w, pieces, whole) + np.log(1 - stop) for w in (t or "").split()) + np.log(stop)
        assert abs(got[i][0] - np.log10(p)) < 1e-4 and abs(got[i][1] - alone / np.log(10)) < 1e-4, (i, got[i])


def test_keep_one_and_mix_agree_over_partitionings(spark):
    """Rows of one id and text but other sources and languages, and copies of whole rows."""
    base = "the quick brown fox jumps over the lazy dog while seven wizards box"
    rows = [(1, base, lang, source, n) for lang in ("en", "fr") for source in ("s2", "s1", None) for n in (3, 4)] + [(1, base, "en", "s2", 3)] * 5 + [(2, "other text of its own here " * 3, None, None, 0)] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [sorted(map(repr, simhash.keep_one(df.repartition(n, *by)).collect())) for n, *by in ((1,), (3, "lang"), (5, "source", "n_chars"))]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 2
    mixed = [sorted(map(repr, mixing.mixed_documents(df.repartition(n, *by)).collect())) for n, *by in ((1,), (3, "lang"), (5, "source", "n_chars"))]
    assert mixed[0] == mixed[1] == mixed[2] and mixed[0]


def test_mix_meets_its_target_with_copies_of_one_row(spark):
    """1,000 copies of a row of four words, target 6,000 words: within one document of it."""
    one = (1, "four words of text", "en", "s1", 0)
    df = spark.createDataFrame([one] * 1000, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = mixing.mix(df).collect()
    assert len(got) == 1000 and {r.target for r in got} == {6000.0}
    assert abs(sum(r.taken for r in got) - 6000) <= 4 and max(r.taken for r in got) <= 8
    out = mixing.mixed_documents(df)
    assert out.count() * 4 == sum(r.taken for r in got) and out.distinct().count() == 1
    both = mixing.mix(df.union(spark.createDataFrame([(i, "w " * (1 + i % 9), "en", "s2", 0) for i in range(500)], df.schema)))
    for r in both.groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 9
