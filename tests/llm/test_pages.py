"""Operators on pages and vectors against brute force, and the pipeline."""

import collections
import hashlib
import heapq
import importlib.util
import random
import re
from pathlib import Path

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from bookreplay.llm import ann, html_extract, url_filter, warc
from bookreplay.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, html string, digest string, host string, row long, block int"
LONG = "<html>" + "same payload " * 20 + "</html>"


def page_rows():
    rows = [
        (1, "http://A.Example.com/en/7x?q=1#f", LONG), (2, "https://example.net/de/8/x", LONG), (3, "http://b.org/es/", None), (4, None, ""), (5, "no scheme", "short"), (6, "x://HÉ.com/en/a", "short"),
        (7, "http://com/en/", "<p>é"), (8, "http://notexample.com/en/7", LONG + "!"), (9, "http://b.example.net/de/9#z", "x" * 3000), (10, "http://listed.com/a/?utm_source=q&b=1&a=2", "q" * 100),
        (11, "https://www.listed.com/a?a=2&b=1", "q" * 99), (12, "http://[bad/en/", "q" * 99), (13, "http://b.com?x://y/z", "tail"), (14, "a\nb://c.com/p\tq", LONG),
    ]
    out = [(*r, "clash", "clash", 1, 1) for r in rows]
    return [*out, out[1], (None, "http://com/en/", LONG, None, None, None, None)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(page_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def parts(url):
    if not url or "://" not in url:
        return "", ""
    after = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", after)[0]
    path = re.match(r"[^?#]*", after[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def test_url_filter(spark, pages, none):
    listed = spark.createDataFrame([("listed.com/a?a=2&b=1",), ("c.com/p",), ("gone.com/",)], "url string")
    got = url_filter.filter_urls(pages, listed, URL_RULES).collect()
    assert len(got) == len(page_rows())
    for r in got:
        urls = [p[1] for p in page_rows() if p[0] == r.page_id]
        assert (r.host, r.path) == parts(urls[0])
        fits = [(len(rule), verdict, rule) for verdict, rule in URL_RULES for h, _, p in [rule.partition("/")] if (r.host == h or r.host.endswith("." + h)) and r.path.startswith("/" + p)]
        want = max(fits, default=(0, None, None))
        assert r.rule == want[2] and (want[1] is None or r.verdict == want[1])
        if want[1] is None:
            assert r.verdict == ("block" if r.page_id in (10, 11) else "allow") and r.is_listed == (r.page_id in (10, 11))
        assert r.maybe or not r.is_listed
    assert url_filter.filter_urls(none, listed, URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, listed.limit(0), []).collect()} == {"allow"}


def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark):
    rows = spark.range(20_000).select(F.concat(F.lit("h.com/"), "id").alias("url"), F.col("id").alias("page_id"))
    got = url_filter.listed_urls(rows, rows.where("page_id % 10 = 0").select("url")).agg(
        F.count_if((F.col("page_id") % 10 == 0) == F.col("is_listed")).alias("right"), F.count_if(F.col("maybe") & ~F.col("is_listed")).alias("wrong"), F.count_if("maybe").alias("maybe")).first()
    assert got.right == 20_000 and 2000 <= got.maybe and got.wrong < 200


def test_filter_by_block_join_gives_the_same(spark, monkeypatch):
    rows = spark.range(300).select(F.concat(F.lit("h.com/"), F.col("id") % 30).alias("url"), F.col("id").alias("page_id"))
    keys = rows.where("page_id % 7 = 0").select("url")
    small = sorted(url_filter.listed_urls(rows, keys).collect())
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 0)
    assert sorted(url_filter.listed_urls(rows, keys).collect()) == small


def slow_captures():
    first = {}
    for i, _, h, *_ in page_rows():
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = collections.Counter()
    for i, _, h, *_ in page_rows():
        data = (h or "").encode()
        again = i is not None and len(data) >= 100 and first[h] != i
        out[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[h] if again else None] += 1
    return out


@pytest.mark.parametrize("fan_in", [64, 2])
def test_warc_round_trip_and_global_order(pages, none, fan_in):
    got = warc.capture_histories(pages, entries_each=4, fan_in=fan_in).orderBy("position").collect()
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == slow_captures()
    assert [r.position for r in got] == list(range(len(got)))
    keys = [(r.url_key.encode(), r.captured_at) for r in got]
    assert keys == sorted(keys)
    assert warc.capture_histories(none).count() == 0


def test_records_parse_in_any_chunks_and_damage_is_found(spark, pages):
    folder = warc.fresh_dir(spark, "warc")
    archives = [r.archive for r in warc.write_archives(pages, folder).collect()]
    fs, base = pafs.FileSystem.from_uri(folder)
    data = b"".join(warc.chunks(fs, f"{base}/{archives[0]}"))
    whole = list(warc.read_records([data]))
    assert list(warc.read_records([data[i : i + 7] for i in range(0, len(data), 7)])) == whole
    fields, block, at, n = whole[-1]
    assert list(warc.read_records([data[at : at + n]]))[0][1] == block and fields["WARC-Record-ID"].startswith("<urn:uuid:")
    with pytest.raises(ValueError):
        list(warc.read_records([data[:-9]]))
    held = next(x for x in whole if x[0]["WARC-Type"] == "response" and len(x[1]) > 120)
    with pytest.raises(ValueError):
        warc.entry(held[0], held[1][:-1] + b"?", "a", 0, 0)


def test_ranges_never_collapse():
    for keys, ranges in ((30_000, 9_000), (30_000, 10_001), (30_000, 29_999), (500, 500), (500, 501), (500, 9_999), (1, 4), (0, 4)):
        cuts = warc.cut_points(list(range(keys)), ranges)
        assert len(cuts) == min(ranges - 1, keys) and cuts == sorted(set(cuts))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(30))) for _ in range(k)]
    assert list(warc.loser_tree([iter(r) for r in runs], order=lambda x: x)) == list(heapq.merge(*runs))


def test_main_text_rules():
    p = """<!DOCTYPE html><head><title>T</title><style>p{}</style><script>var a="</p><article>"</script></head><body><nav><ul><li>Menu</ul></nav><header>Site</header>
    <article class="post"><header><h1>Head &amp; tail</h1></header><p>One <b>bo</b>ld<br>line.<p class="ad">Buy<p>Two&nbsp; &#233; &lt;x&gt; &ampz<ul><li>a<li>b</ul><form>name</form><!-- no --><aside>side</aside>
    <div id="comments"><p>nice</div></article><footer>foot</footer>"""
    assert " ".join(t for k, t in html_extract.parse(p) if k == html_extract.CONTENT) == "Head & tail One bold line. Two é <x> &z a b"
    for odd in ("", "plain", "<p>open <b>bold", "<p", "a < b", "<article>", "<article><p>cut</p", "<!-- never ends", "<script>x", "<ARTICLE><P>Up</ARTICLE>", "<a href='>'>q</a>"):
        html_extract.parse(odd)
    assert html_extract.parse("<ARTICLE><P>Up</ARTICLE>tail") == [(2, "Up"), (0, "tail")]
    assert html_extract.parse("<main><p>in</p></main><p>out") == [(2, "in"), (0, "out")]
    assert html_extract.parse("a < b <i>c</i>") == [(1, "a < b c")]


def test_marks_on_what_holds_the_article_say_nothing():
    text = lambda p: " ".join(t for k, t in html_extract.parse(p) if k == html_extract.CONTENT)
    article = "<article><p>the whole story</p></article>"
    for p in (
        f"<html><body class='single-post has-sidebar'>{article}</body></html>", f"<html class='no-js ad-free'><body class='search'>{article}", f"<body id=menu>{article}",
        f"<div id='content' class='search-results'>{article}</div>", f"<div class='widget'><div class='overlay'>{article}</div></div>",
        "<article class='post share related'><p>the whole story</p></article>", "<main class='search'><p>the whole story</p></main>", "<div class='modal'><main><p>the whole story",
        "<div class='banner'><div role='main'><p>the whole story</div></div>", "<div class=search itemprop=articleBody>the whole story</div>",
        "<article><div class='ad-free-zone'>the whole story</div></article>", f"<body class='has-sidebar'><div class='sidebar'><p>links</p></div>{article}<div class='related'><article>teaser</article></div>",
        "<article><p>the whole story<div class='comments'><article>nice, nice, nice and nice again</article></div></article>", f"<nav><article>a long, long, long menu</article></nav>{article}",
    ):
        assert text(p) == "the whole story", p
    deep = "<div class='widget'><b>" * 20_000
    assert html_extract.parse(f"{deep}x{article}")[-1] == (html_extract.CONTENT, "the whole story")


def test_runs_shared_by_pages_of_a_host_go(spark, none):
    menu, note = "home news sport weather travel money more about us", "all rights reserved by the owners of this very site"
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(12))
    rows = [(i, f"http://{'a' if i < 6 else 'b'}.com/{i}", f"<div>{menu}</div><p>{body(i)}</p><div>{note if i % 2 else 'short'}</div>") for i in range(7)]
    rows += [(7, "http://a.com/7", f"<article><p>{menu}</p></article>"), (8, None, None), rows[0], (9, "http://c.com/", f"<div>{body(9)}</div><p>{body(9)}")]
    df = spark.createDataFrame([(*r, "clash", "clash", 1, 1) for r in rows], SCHEMA)
    got = collections.defaultdict(set)
    for r in html_extract.main_text(df).collect():
        got[r.page_id].add(r.text)
        assert r.n_chars == len(r.text)
    for i in range(6):  # nine shared words: menu; the page's own words stay, short blocks too
        assert got[i] == {body(i) + ("" if i % 2 else " short")}, (i, got[i])
    assert got[6] == {f"{menu} {body(6)} short"}  # alone on its host
    assert got[7] == {menu} and got[8] == {""}  # an article is content; a null page is empty
    assert got[9] == {f"{body(9)} {body(9)}"}  # twice in one page is no boilerplate
    assert html_extract.main_text(df).count() == len(rows) and html_extract.main_text(none).count() == 0


def test_whole_copies_stay_and_articles_are_in_the_stream(spark):
    menu, note = "home news sport weather travel money more about us", "all rights reserved by the owners of this very site"
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(12))
    open_page = lambda i: f"<div>{menu}</div><p>{body(i)}</p>"
    pages = {0: open_page(0), 1: open_page(0), 2: open_page(2), 3: f"<article><p>{body(3)}</p><p>{note}</p></article>", 4: f"<div>{body(4)}</div><p>{note}</p>",
             5: f"<nav>{menu}</nav><article>{body(5)}</article>", 6: f"<p>{body(5)}</p>", 7: f"<nav>{menu}</nav><p>{body(5)}</p>"}
    df = spark.createDataFrame([(i, f"http://a.com/{i}", h) for i, h in pages.items()], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.main_text(df).collect()}
    assert got[0] == got[1] == body(0) and got[2] == body(2)  # two copies and a third page: the menu goes, the copies stay
    assert got[3] == f"{body(3)} {note}" and got[4] == body(4)  # a run that an article of the host holds too
    assert got[5] == got[6] == got[7] == body(5)  # a copy with other markup


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24)) * rng.uniform(0.5, 2, (3000, 1))
    x[100:160] = x[100]
    rows = [(i, [float(v) for v in x[i]], "clash", 1) for i in range(3000)]
    rows += [(5000, None, "", 1), (5001, [0.0] * 24, "", 1), (5002, [float("nan")] + [1.0] * 23, "", 1), (5003, [None] + [1.0] * 23, "", 1), (5004, [float("inf")] + [1.0] * 23, "", 1), (None, rows[0][1], "", 1), rows[7], (5020, [1.0, 2.0], "", 1), (5021, [2.0, 1.0], "", 1)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard string, rank int").repartition(4)


def test_forest_recall_and_scores(spark, vectors):
    x, df = vectors
    got = collections.defaultdict(list)
    for r in ann.nearest(df, shard_rows=1000, queries_each=40).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert got.pop(5020) == [(1, 5021, 4.0)]
    assert set(got) == set(range(0, 3000, 20))
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r for r, *_ in rows] == list(range(1, 21)) and all(v != q for _, v, _ in rows)
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        scores = x @ x[q]
        assert all(abs(s - scores[v]) < 1e-9 for _, v, s in rows)
        best = [v for v in np.lexsort((np.arange(3000), -scores)) if v != q][:20]
        hits += len({v for _, v, _ in rows} & set(best))
    assert hits / (20 * len(got)) >= 0.9


def test_forest_recall_on_the_given_vectors(spark):
    path = "/root/testdata/sf0.01/embeddings.parquet"
    if not Path(path).exists():
        pytest.skip("no given tables here")
    df = spark.read.parquet(path)
    x = {r.vec_id: np.asarray(r.embedding, "f8") for r in df.collect() if r.embedding is not None and None not in r.embedding}
    x = {i: v for i, v in x.items() if np.isfinite(v).all() and v.any()}
    ids, all_ = np.asarray(sorted(x)), np.stack([x[i] for i in sorted(x)])
    got = collections.defaultdict(set)
    for r in ann.nearest(df).collect():
        got[r.query_id].add(r.vec_id)
        assert r.score == (x[r.query_id] * x[r.vec_id]).sum()
    hits = 0
    for q in got:
        scores = all_ @ x[q]
        scores[ids == q] = -np.inf
        hits += len(got[q] & set(ids[np.argsort(-scores)[:20]].tolist()))
    assert set(got) == {i for i in x if i % 20 == 0} and hits >= 0.9 * 20 * len(got)


def test_equal_vectors_rank_by_id(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 33))
    x[1::2] = x[0]
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(600)], "vec_id long, embedding array<double>").repartition(3)
    for r in ann.nearest(df, shard_rows=100, queries_each=7).where("query_id = 0").orderBy("rank").collect():
        assert r.vec_id == 2 * r["rank"] - 1


def test_huge_and_tiny_components(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 16))
    for power in (200, -150):
        df = spark.createDataFrame([(i, [float(v) for v in x[i] * 10.0**power]) for i in range(300)], "vec_id long, embedding array<double>")
        got = ann.nearest(df, shard_rows=100).collect()
        assert len(got) == 15 * 20
        for q in range(0, 300, 20):
            best = [v for v in np.lexsort((np.arange(300), -(x @ x[q]))) if v != q][:20]
            rows = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
            if power < 0:
                assert len({r.vec_id for r in rows} & set(best)) >= 16 and all(np.isclose(r.score, x[q] @ x[r.vec_id] * 1e-300) for r in rows)
            else:  # all products are beyond a double: infinite, so the smaller id comes first
                assert all(r.score == float("inf") and x[q] @ x[r.vec_id] > 0 for r in rows) and [r.vec_id for r in rows] == sorted(r.vec_id for r in rows)
    mixed = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1e200, 1e200]), (2, [1e-200, 1.0]), (3, [-1e200, 1e190])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in ann.nearest(mixed).orderBy("rank").collect()] == [1, 2, 3]


def test_forest_takes_all_candidates_where_there_are_few(spark):
    df = spark.createDataFrame([(i, [1.0 + i, 1.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in ann.nearest(df).orderBy("rank").collect()] == [(1, 4), (2, 3), (3, 2), (4, 1)]
    assert ann.nearest(df.limit(0)).count() == 0


def pipeline_module():
    spec = importlib.util.spec_from_file_location("corpus_pipeline", Path(__file__).resolve().parents[2] / "corpus_pipeline.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_pipeline_stages(spark, tmp_path):
    from tests.llm.test_documents import slow_base, slow_fingerprint

    rng = random.Random(4)
    lex = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te") for b in ("sen", "dor", "vik", "pal", "nim", "gor")]
    good = [" ".join(rng.choice(lex) for _ in range(60)) for _ in range(60)]
    texts = [*good, good[0], good[1] + " end", "few words", "spam " * 50, None, *("buy " + " ".join(f"zz{rng.randrange(9**6)}" for _ in range(40)) for _ in range(30))]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or ""), "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, _row string, _nth string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    module = pipeline_module()
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in module.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == docs.columns, name
        df = spark.createDataFrame(df.collect(), docs.schema)
        seen.append(collections.Counter(r.doc_id for r in df.collect()))
    assert set(seen[0]) <= {i for i, t in enumerate(texts) if slow_base(t)[0] >= 10} and set(range(60)) <= set(seen[0])
    marks = {i: slow_fingerprint(texts[i]) for i in seen[0]}
    assert set(seen[1]) <= set(seen[0]) and 60 not in seen[1] and max(seen[1].values()) == 1
    for i in set(seen[0]) - set(seen[1]):
        assert any(bin(marks[i] ^ marks[j]).count("1") <= 3 for j in seen[0] if j < i)
    assert set(seen[2]) <= set(seen[1]) and set(seen[2].values()) <= {1, 2}
    end = module.run(spark, str(tmp_path)).collect()
    assert collections.Counter(r.doc_id for r in end if r.piece == 0) == seen[2]


def test_pipeline_takes_null_and_repeated_ids_and_empty_tables(spark, tmp_path):
    rng = random.Random(5)
    text = lambda: " ".join(f"{a}{b}" for a, b in zip(rng.choices("klmrt", k=60), rng.choices(["sen", "dor", "vik", "pal", "nim", "gor", "tus"], k=60)))
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else 100 + i, text(), "en", f"s{i % 2}", 0) for i in range(90)]
    rows += [rows[0], rows[1], (7, None, None, None, 0), (None, "", "en", "s0", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, 1, 0) for i in range(100, 190)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    module = pipeline_module()
    for name, data in (("odd", rows), ("none", [])):
        df = spark.createDataFrame(data, schema)
        for k, (_, stage) in enumerate(module.STAGES):
            df = stage(spark, df, str(tmp_path))
            if k < len(module.STAGES) - 1:
                assert df.columns == schema.replace(" long", "").replace(" string", "").split(", ")
                kept = df.collect()
                df = spark.createDataFrame(kept, schema)
                if k == 1:  # unlike texts all stay, whatever their ids; copies of one row are one
                    assert collections.Counter((r.doc_id, r.text) for r in kept) == collections.Counter({(i, t): 1 for i, t, *_ in data if t})
        assert (df.count() > 0) == bool(data)


def test_words_beside_shared_blocks_stay(spark):
    """A header and a footer on six pages, and stories that begin and end alike: nothing of a story goes."""
    story = lambda i: f"Page {'abcdef'[i]} unique story text about topic {'stuvwx'[i]} and more words here."
    page = lambda i: f"<div>Home News Sport Weather Travel</div><div>{story(i)}</div><div>All rights reserved by the owners</div>"
    df = spark.createDataFrame([(i, f"http://a.com/{i}", page(i)) for i in range(6)], "page_id long, url string, html string")
    # "and more words here." and the footer are ten words on every page: of the story's block that is neither all nor eight.
    assert {r.page_id: r.text for r in html_extract.main_text(df, run=8).collect()} == {i: f"Home News Sport Weather Travel {story(i)}" for i in range(6)}
    menu = "<ul>" + "".join(f"<li>{x}</li>" for x in "Home News Sport Weather Travel Money Food Music Film".split()) + "</ul>"
    page = lambda i: f"{menu}<div>{story(i)}</div><div>All rights reserved by the owners of this very site</div>"
    df = spark.createDataFrame([(i, f"http://a.com/{i}", page(i)) for i in range(6)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.main_text(df).collect()} == {i: story(i) for i in range(6)}
    # One page alone has nothing to compare with: the runs decide, not the markup.
    assert html_extract.main_text(df.where("page_id = 0")).first().text.startswith("Home News")


def test_compound_class_names():
    story = "the whole story that fills most of what this page has to say to anyone who reads it"
    text = lambda p: " ".join(t for k, t in html_extract.parse(p) if k != html_extract.BOILERPLATE)
    for name in ("ad-container", "comment-list", "cookie-banner", "share-buttons", "article_ads", "page-nav-links"):
        for p in (f"<article><p>{story}</p><div class='{name}'>gone</div></article>", f"<div>{story}</div><div class='x {name}'><p>gone</p></div>"):
            assert text(p) == story, (name, p)
    for name in ("site-header", "site-footer", "page-header-wrapper"):
        assert text(f"<div class='{name}'>gone</div><div>{story}</div>") == story, name
    for name in ("search-results", "no-sidebar", "layout-with-sidebar", "entry-content", "thread-header-comment-free"):
        assert text(f"<div class='{name}'>here</div><div>{story}</div>") == f"here {story}", name
    assert text(f"<article><div class='entry-header'>Title</div>{story}</article>") == f"Title {story}"
    # What holds most of the page is not judged by a compound name.
    assert text(f"<div class='main-sidebar'>{story}<p>x</p></div>") == f"{story} x"


def slow_unique(pages, run):
    """page -> words kept: maximal stretches whose every window of ``run`` words stands in another page; of a block they
    cover all of it or ``run`` words of it or nothing."""
    streams = {p: " ".join(blocks).split(" ") for p, blocks in pages.items()}
    windows = {p: [tuple(s[i : i + run]) for i in range(len(s) - run + 1)] for p, s in streams.items()}
    out = {}
    for p, blocks in pages.items():
        other = {w for q in pages if streams[q] != streams[p] for w in windows[q]}
        hit = [w in other for w in windows[p]] + [False]
        stretches, i = [], 0
        while i < len(hit):
            k = i
            while hit[k]:
                k += 1
            if k > i:
                stretches.append((i, k - 1 + run))
            i = k + 1
        kept, at = [], 0
        for b in blocks:
            words = b.split(" ")
            whole = (at, at + len(words))
            gone = set()
            for lo, hi in stretches:
                a, z = max(lo, whole[0]), min(hi, whole[1])
                if z > a and (z - a >= run or (a, z) == whole):
                    gone |= set(range(a, z))
            kept += [w for i, w in enumerate(words, at) if i not in gone]
            at += len(words)
        out[p] = " ".join(kept)
    return out


def test_unique_words_are_the_slow_version_s(spark):
    import random

    rng = random.Random(7)
    parts = [" ".join(rng.choice("abcde") + str(rng.randrange(4)) for _ in range(n)) for n in (1, 2, 3, 5, 8, 9, 13)]
    pages = {}
    for p in range(14):
        blocks = []
        for _ in range(rng.randrange(2, 7)):
            b = rng.choice(parts) if rng.random() < 0.6 else " ".join(f"p{p}x{rng.randrange(30)}" for _ in range(rng.randrange(1, 9)))
            blocks.append(b if rng.random() < 0.6 else f"{b} {rng.choice(parts)}")
        pages[p] = blocks
    df = spark.createDataFrame([(p, f"http://a.com/{p}", "".join(f"<p>{b}</p>" for b in blocks)) for p, blocks in pages.items()], "page_id long, url string, html string")
    want = slow_unique(pages, 4)
    for words_each in (262_144, 120, 1):  # hosts in one array; the host over several; a page each
        assert {r.page_id: r.text for r in html_extract.main_text(df, run=4, words_each=words_each).collect()} == want
    assert any(want[p] != " ".join(b) for p, b in pages.items())
    # Two hosts with the same passages share arrays, not runs; a page alone on its host loses nothing.
    both = df.union(df.selectExpr("page_id + 100", "replace(url, 'a.com', 'b.com')", "html")).union(df.where("page_id = 3").selectExpr("page_id + 200", "'http://c.com/'", "html"))
    alone = {203: " ".join(pages[3])}
    got = {r.page_id: r.text for r in html_extract.main_text(both, run=4, words_each=150).collect()}
    assert got == want | {p + 100: t for p, t in want.items()} | alone


def test_suffix_array_is_sorted_by_first_tokens(spark):
    rng = np.random.default_rng(3)
    for run in (1, 2, 3, 5, 8, 11):
        tokens = [rng.integers(0, 3, rng.integers(0, 40)).astype("i8") for _ in range(6)]
        copies = np.asarray([1, 1, 2, 3, 4, 4])
        order, page, place, group, heads, low, high = html_extract.repeats(tokens, copies, run)
        of = [tuple(tokens[p][a : a + run]) for p, a in zip(page, place)]
        assert of == sorted(of) and len(of) == sum(max(0, len(t) - run + 1) for t in tokens) == len(set(order.tolist()))
        where = collections.defaultdict(set)
        for p, w in zip(page, of):
            where[w].add(copies[p])
        assert [(min(where[w]), max(where[w])) for w in sorted(where)] == list(zip(low, high))
        assert [sorted(where).index(w) for w in of] == group.tolist()
        keys = html_extract.run_keys(np.concatenate(tokens), heads, run)
        assert len(set(keys.tolist())) == len(where)
    assert all(len(x) == 0 for x in html_extract.repeats([np.asarray([1, 2], "i8")], np.asarray([1]), 8))


def test_the_array_judges_further_articles(spark):
    """Articles beside a page's longest: teasers of other pages of the host go, a part of this page alone stays. The longest stays
    whole, even where other pages hold its words."""
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(20))
    lead = lambda i: " ".join(body(i).split()[:9])
    page = lambda i: f"<nav>Home</nav><article><h1>Story {i}</h1><p>{body(i)}</p></article><article><p>{lead((i + 1) % 6)}</p></article><article><p>part {i} of it</p></article>"
    rows = [(i, f"http://a.com/{i}", page(i)) for i in range(6)]
    rows += [(6, "http://b.com/", page(0)), rows[3], rows[3]]  # alone on its host; repeated rows
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = [(i, f"Story {i} {body(i)} part {i} of it") for i in range(6)] + [(3, f"Story 3 {body(3)} part 3 of it")] * 2
    want += [(6, f"Story 0 {body(0)} {lead(1)} part 0 of it")]
    for words_each in (262_144, 60, 1):
        assert sorted((r.page_id, r.text) for r in html_extract.main_text(df, words_each=words_each).collect()) == sorted(want)


def test_streams_and_packed_keys():
    import pandas as pd
    import zstandard

    texts = ["2one two\n0two é two", "", "1" + "x" * 3000 + " one", "2\u4f60\u597d one\n1one"]
    held = pd.DataFrame({"host": [5, 5, 5, -6], "blocks": [zstandard.compress(t.encode()) for t in texts]})
    pages, tokens = html_extract.streams(held)
    assert [p.decode() for p in pages] == texts and [len(x) for x in tokens] == [5, 0, 2, 3]
    (one, two, _, e, _), (_, one_too), (_, other, again) = tokens[0], tokens[2], tokens[3]
    assert tokens[0][1] == tokens[0][2] == tokens[0][4] and one == one_too != other == again and len({one, two, e}) == 3
    assert html_extract.streams(held[:0])[1] == [] and [len(x) for x in html_extract.streams(held[1:2])[1]] == [0]
    rng = np.random.default_rng(1)
    for top in (3, 2**40, 2**62):
        x = rng.integers(-top if top == 3 else 0, top, 1000)
        assert np.array_equal(html_extract.ranks(x), np.unique(x, return_inverse=True)[1])
    for n in (0, 1, 500):
        keys = np.unique(rng.integers(0, 2**64, n, "u8"))
        assert np.array_equal(html_extract.unpacked(html_extract.packed(keys)), keys)


def test_keys_meet_across_shards():
    import pandas as pd

    rng = np.random.default_rng(4)
    for bits in (32, 64):
        keys = [np.unique(rng.choice(np.append(rng.integers(0, 2**bits, 40, "u8"), np.uint64(2**bits - 1)), 60)) for _ in range(2)]
        keys.append(np.unique(np.concatenate([keys[0][:9], keys[1][-9:]])))
        sent = pd.concat([html_extract.messages(s, k, bits, 5) for s, k in enumerate(keys)])
        found = [html_extract.met(x) for _, x in sent.groupby("slice")]
        got = {(s, k) for f in found for s, p in zip(f["shard"], f["keys"]) for k in html_extract.unpacked(p).tolist()}
        where = collections.Counter(k for x in keys for k in x.tolist())
        assert got == {(s, k) for s, x in enumerate(keys) for k in x.tolist() if where[k] > 1}
    # One copy in two shards is no repeat; two copies in one shard are.
    a, b = np.asarray([3, 2**63], "u8"), np.asarray([3], "u8")
    sent = pd.concat([html_extract.messages(0, a, 64, 1, low=np.asarray([7, 7]), high=np.asarray([7, 8])), html_extract.messages(1, b, 64, 1, low=np.asarray([7]), high=np.asarray([7]))])
    found = html_extract.met(sent)
    assert found["shard"].tolist() == [0] and html_extract.unpacked(found["keys"][0]).tolist() == [2**63]
