"""Conversation repair, line dedup and the prefix trie against brute force."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from bookreplay.llm import conversation_repair, line_dedup, prefix_trie, turns

SCHEMA = "conv_id long, turn long, role string, text string, pos long, block string, _c int, kind string"
SPACE = " \t\n\x0b\x0c\r"
CLASH = (7, "clash", 7, "clash")


def sample(seed=5, convs=60, longest=12):
    rng, out = random.Random(seed), []
    said = ["Yes.", "No!", "Why", "  ", "", "A longer thing. And more", "Fine?  ", "tail\x1f", None]
    for c in range(convs):
        for t in range(rng.randrange(0, longest)):
            role = rng.choice(["user", "assistant", "assistant", "user", "system", "User", "tool", "", None] if rng.random() < 0.4 else ["user", "assistant"])
            turn = rng.choice([t, t, t, t + rng.randrange(3), None])
            out.append((c * 7 % 230, turn, role, rng.choice(said), *CLASH))
    out += [(300, 0, "user", "Same.", *CLASH)] * 7 + [(None, 1, "user", "Null.", *CLASH), (None, 2, "assistant", "Of it.", *CLASH), (-5, 0, "user", "Low.", *CLASH)]
    return out


def key(r):
    return (r[1] is not None, r[1] or 0, r[2], r[3])


def repaired(rows):
    """The row of the contract for one conversation's rows, by dynamic programming over (cost, audit, text)."""
    rows = sorted(((r[0], r[1], r[2] or "", r[3] or "") for r in rows), key=key)
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "k")
        seen.add((role, text))
    go = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    names = {"u": "user", "a": "assistant"}
    best = {0: (0, "", ())}

    def inserted(best):
        out = dict(best)
        for _ in range(3):
            for s, (cost, audit, text) in list(out.items()):
                for w in "ua":
                    if (s, w) in go:
                        new = (cost + 5, audit + "I", text + (f"{names[w]}:",))
                        out[go[s, w]] = min(out.get(go[s, w], new), new)
        return out

    for (_, _, role, text), fault in zip(rows, faults):
        out = {}
        for s, (cost, audit, lines) in inserted(best).items():
            steps = [(2, "D", s, ())]
            if fault in "kt":
                more = 5 if fault == "t" else 0
                if (s, role[:1]) in go:
                    steps.append((more, "K", go[s, role[:1]], (f"{role}:{text}",)))
                steps += [(1 + more, "R", go[s, w], (f"{names[w]}:{text}",)) for w in "ua" if (s, w) in go]
            for c, e, to, line in steps:
                new = (cost + c, audit + e, lines + line)
                out[to] = min(out.get(to, new), new)
        best = out
    cost, audit, lines = min(v for s, v in inserted(best).items() if s in (0, 3))
    initials = [r[2][:1] for r in rows]
    known = [r[1] for r in rows if r[1] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def damage(rows):
    out = []
    for c, t, role, text, *_ in rows:
        say = lambda x: " " if x is None else str(x)
        role, text, fate = say(role), say(text), zlib.crc32(f"{say(c)}:{say(t)}".encode()) % 20
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            out += [(c, t, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def by_conversation(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    return out


def test_repair(spark):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.audited(df, conversation_repair.damaged(df)).collect()}
    left = by_conversation(damage(rows))
    want = {c: repaired(left[c]) if left[c] else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in by_conversation(rows)}
    assert got == want
    none = spark.createDataFrame([], SCHEMA)
    assert conversation_repair.audited(none, conversation_repair.damaged(none)).count() == 0


def test_repair_in_blocks(spark, monkeypatch):
    """Blocks of eight rows: long conversations go through the tables of crossings."""
    monkeypatch.setattr(turns, "BLOCK_BITS", 3)
    rows = sample(seed=9, convs=12, longest=60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    summary, repaired_rows = conversation_repair.repair(df)
    shas = {r.conv_id: r.repaired_sha256 for r in conversation_repair.digests(repaired_rows).collect()}
    got = {r.conv_id: (*tuple(r)[1:], shas[r.conv_id]) for r in summary.collect()}
    assert got == {c: repaired(x) for c, x in by_conversation(rows).items()}


def test_auction_takes_the_first_of_the_cheapest():
    rng = random.Random(3)
    for _ in range(300):
        rows = [(rng.choice("suax"), rng.choice("kkktbd")) for _ in range(rng.randrange(1, 40))]
        (cost, state, edits), = conversation_repair.auction([conversation_repair.ARCS[a + b] for a, b in rows], list(conversation_repair.ENDS), [0])
        audit = (edits + conversation_repair.TAIL[state]).translate(str.maketrans("uaUA", "IIRR"))
        roles = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
        plain = [(0, i, roles[a], " " if b == "b" else f"text {i}" + ("" if b == "t" else ".")) for i, (a, b) in enumerate(rows) if b != "d"]
        if len(plain) == len(rows):
            want = repaired(plain)
            assert (cost, audit) == want[5:7]


def documents(rng):
    common = [f"This is a line that stands in very many documents, number {i} of all" for i in range(6)]
    out = []
    for d in range(40):
        lines = [rng.choice(common) if rng.random() < 0.3 else f"own line of document {d} with something {rng.random()}" for _ in range(rng.randrange(0, 9))]
        lines = [rng.choice(["  {} ", "{}\t", "{}"]).format(x.upper() if rng.random() < 0.2 else x) for x in lines] + ["short"] * rng.randrange(3)
        out.append((d, "\n".join(lines), "x", 1, "clash"))
    out += [(100 + i, "é" * 39 + "\n" + "É" * 40, None, 0, None) for i in range(6)]
    out += [(None, common[0], None, 0, None), (None, common[1] + "\n" + common[1], None, 0, None), (900, None, None, 0, None), (901, "", None, 0, None), (902, "\n\n", None, 0, None)]
    out += [(903, common[2], "a", 0, None)] * 6 + [(904, (common[3] + "\n") * 3 + "w " * 200_000, None, 0, None)]
    out += [(d, "a line of one document id only, repeated in six rows", None, 0, None) for d in [905] * 6]
    return out


def kept_lines(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(SPACE))
    holders = collections.defaultdict(set)
    for d, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(d)
    out = []
    for d, text, *_ in rows:
        lines = (text or "").split("\n")
        own = lambda k: d is not None and d == max(x for x in holders[k] if x is not None)
        stay = [x for x in lines if len(key(x)) < 40 or len(holders[key(x)]) < 5 or own(key(x))]
        out.append((d, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("size", [1 << 20, -1])
def test_line_dedup(spark, size, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 3)
    rows = documents(random.Random(2))
    df = spark.createDataFrame(rows, "doc_id long, text string, _text string, n_lines int, _row string").repartition(3)
    found = line_dedup.deduplicated(df, broadcast_bytes=size)
    assert set(found.columns) == {"doc_id", "text", "_text", "n_lines", "_row", "n_dropped"}
    got = line_dedup.digests(found).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert collections.Counter(map(tuple, got)) == kept_lines(rows)
    assert line_dedup.deduplicated(df.limit(0), broadcast_bytes=size).count() == 0


def test_perfect_hash():
    import numpy as np

    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 1 << 63, 50_000, dtype=np.uint64))
    made = line_dedup.PerfectHash.of(h)
    assert sorted(made.numbers(h).tolist()) == list(range(len(h)))
    # Equal first halves are told apart by the second.
    first, second = np.array([5, 5, 9, 5], "<u8"), np.array([1, 2, 3, 4], "<u8")
    arrays = line_dedup.Arrays(*line_dedup.Arrays.packed(first, second, np.array([9, 8, 7, 6]), np.array([1, 2, 3, 4])))
    yes = np.ones(4, bool)
    assert arrays.dropped(first, second, np.array([1, 0, 3, 0]), yes, 5).tolist() == [False, True, False, True]
    assert arrays.dropped(first, second, np.zeros(4, int), yes, 7).tolist() == [True, True, True, False]
    assert not arrays.dropped(np.array([5, 77], "<u8"), np.array([3, 1], "<u8"), np.zeros(2, int), yes[:2], 1).any()


def trie(rows):
    convs = {c: sorted(((r[0], r[1], r[2] or "", r[3] or "") for r in x), key=key) for c, x in by_conversation(rows).items() if c is not None}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = convs.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])
        built[c] = [r[2:] for r in base[:h] + own[h:]]
    members = collections.defaultdict(list)
    for c, x in built.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    out = []
    for node, held in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) == len(n) + 1 for m in members)]
        saved = sum((len(members[n]) - 1) * (len(n[-1][1]) if n else 0) for n in below)
        ends = ",".join(map(str, sorted(c for c in held if len(built[c]) == len(node))))
        out.append((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("bits", [12, 2])
def test_prefix_trie(spark, monkeypatch, bits):
    monkeypatch.setattr(turns, "BLOCK_BITS", bits)
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rows = sample(seed=4, convs=45, longest=9)
    more = [(c, t, "user", f"Line {t}.", *CLASH) for c in (1000, 1001, 1002, 1003, 1050, 1101, 1102) for t in range(8)]
    rows = rows + more + [(1004, 0, "user", "One.", *CLASH), (2001, 0, "user", "One.", *CLASH)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = collections.Counter(map(tuple, prefix_trie.prefix_trie(df).collect()))
    assert got == trie(rows)
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0


def test_prefix_trie_does_again_what_meets(spark, monkeypatch):
    """With the first attempt's hashes all equal, verification sends it back."""
    plain = prefix_trie.weighted
    asked = []

    def weighted(held, seed):
        asked.append(seed)
        from pyspark.sql import functions as F

        return plain(held, seed).withColumns({"t1": F.lit(1).cast("long"), "t2": F.lit(1).cast("long")}) if seed == 0 else plain(held, seed)

    monkeypatch.setattr(prefix_trie, "weighted", weighted)
    rows = sample(seed=6, convs=20, longest=6)
    got = collections.Counter(map(tuple, prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == trie(rows) and asked == [0, 1]
