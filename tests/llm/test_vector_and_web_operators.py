"""Vector searches, page texts and archives against brute force, on small and awkward tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from versehall.llm import adaptive_ann, common, consensus_html, exact_topk, warc

VEC = "vec_id long, embedding array<float>, label int, u long, score double"


def vectors_of(spark, rows):
    """With extra columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(i, v, 0, 3, 0.5) for i, v in rows], VEC)


def awkward(rng, n=400, d=8):
    rows = [(i, [float(x) for x in rng.standard_normal(d).astype(np.float32)]) for i in range(n)]
    hot = rows[7][1]
    rows += [(5000 + i, hot) for i in range(150)]  # one vector that many rows share
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * (d - 2)), (2002, [float("nan")] * d), (2003, [float("inf")] * d), (2004, [0.0] * d), (2005, [1.0]), (None, hot), (3, rows[3][1])]
    return rows


def clean(rows):
    ok = {i: v for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    width = max(map(len, ok.values()))
    ids = sorted(ok)
    return ids, np.array([ok[i] + [0.0] * (width - len(ok[i])) for i in ids])


def best(ids, scores, own, k):
    order = [j for j in sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j])) if ids[j] != own][:k]
    return [(ids[j], scores[j]) for j in order]


# -- exact top-k ------------------------------------------------------------------------------


def test_exact_topk_against_all(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "ROW_BLOCK", 100)
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 10)
    rows = awkward(np.random.default_rng(1))
    ids, m = clean(rows)
    q = np.floor(64 * m).astype(np.int64)
    got = {}
    for r in exact_topk.search(vectors_of(spark, rows), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    asks = [i for i in ids if i % 20 == 0]
    assert sorted(got) == asks
    for i in asks:
        want = best(ids, (q @ q[ids.index(i)]).tolist(), i, 20)
        assert sorted(got[i]) == [(n + 1, a, s) for n, (a, s) in enumerate(want)]


def test_exact_topk_awkward(spark):
    few = vectors_of(spark, [(0, [1.0, 2.0]), (1, [3e18, 0.0]), (2, [-1.5])])
    got = exact_topk.search(few, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, (1 << 63) - 1), (2, -96 * 64)]
    assert exact_topk.search(few.limit(0), F.col("vec_id") == 0).count() == 0
    assert exact_topk.search(few, F.col("vec_id") == 9).count() == 0


def test_accumulate_types():
    rng = np.random.default_rng(2)
    for size in (10, 1 << 20, 1 << 40):
        a, b = rng.integers(-size, size, (30, 5)), rng.integers(-size, size, (7, 5))
        a[::3, 1] = 0
        want = b.astype(object) @ a.astype(object).T
        assert (exact_topk.accumulate(a, b) == want).all()


# -- adaptive scan ----------------------------------------------------------------------------


def test_ann_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(adaptive_ann, "CHUNK", 60)
    monkeypatch.setattr(adaptive_ann, "QUERY_CHUNK", 5)
    rows = awkward(np.random.default_rng(3), n=1500, d=32)
    ids, m = clean(rows)
    alive = [j for j in range(len(ids)) if m[j].any()]
    ids, m = [ids[j] for j in alive], m[alive]
    found = {}
    for r in adaptive_ann.search(vectors_of(spark, rows), F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    place = {i: j for j, i in enumerate(ids)}
    for i in (i for i in ids if i % 20 == 0):
        want = best(ids, (m @ m[place[i]]).tolist(), i, 20)
        got = sorted(found[i])
        assert len(got) == 20 and i not in {v for _, v, _ in got}
        assert all(abs(s - m[place[v]] @ m[place[i]]) < 1e-9 for _, v, s in got)
        assert got == sorted(got, key=lambda x: (-x[2], x[1]))
        hits += len({v for _, v, _ in got} & {v for v, _ in want})
        total += 20
    assert hits / total >= 0.9


def test_ann_awkward(spark):
    few = vectors_of(spark, [(0, [1.0, 2.0]), (1, [3.0, 0.0]), (2, [-1.5])])
    got = adaptive_ann.search(few, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 3.0), (2, -1.5)]
    assert adaptive_ann.search(few.limit(0), F.col("vec_id") == 0).count() == 0


def test_scan_abandons_but_keeps_the_nearest():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((5000, 130)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:40] + rng.standard_normal((40, 130)).astype(np.float32) / 20
    own = rng.integers(0, 9, 5000)
    everywhere = np.tile(np.arange(9), 40)
    d = ((q[:, None] - x[None]) ** 2).sum(2)
    near = np.argsort(d, axis=1)[:, :21]
    got = adaptive_ann.scan_lists(x, own, q, np.repeat(np.arange(40), 9), everywhere, np.full(40, np.inf, np.float32), 21)
    pairs = set(zip(*map(np.ndarray.tolist, got)))
    want = {(i, j) for i in range(40) for j in near[i].tolist()}
    assert len(want & pairs) >= 0.98 * len(want) and len(pairs) < 3 * len(want)
    some = adaptive_ann.scan(x, q, np.partition(d, 20, axis=1)[:, 20].astype(np.float32))
    assert len(some[0]) < 1.1 * len(want)


def test_ann_of_many_lists(spark, monkeypatch):
    """More lists than the sample can give: they are cut in Spark."""
    monkeypatch.setattr(adaptive_ann, "LIST_ROWS", 10)
    monkeypatch.setattr(adaptive_ann, "CHUNK", 50)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((30, 16)) * 3
    rows = [(i, [float(x) for x in (centres[i % 30] + rng.standard_normal(16)).astype(np.float32)]) for i in range(2000)]
    m = np.array([v for _, v in rows])
    found = {}
    for r in adaptive_ann.search(vectors_of(spark, rows), F.col("vec_id") % 20 == 0, k=10, sample=200).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(found[i] & {v for v, _ in best(list(range(2000)), (m @ m[i]).tolist(), i, 10)}) for i in range(0, 2000, 20))
    assert hits >= 0.93 * 1000


# -- main text --------------------------------------------------------------------------------

PAGE = """<html><head><title>t</title><style>p{{}}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav>menu</nav>
<div id="wrap"><div class="{box}"><h1>T &amp; U</h1><p>Hello   <b>wor</b>ld &eacute;<br>next {i}<p>Second para, long enough to count as text.<ul><li>one<li>two</ul>
<form>f</form><script>if(a<b){{}}</script><!-- c --></div><div class="side-bar sidebar">side</div><div class="comments"><p>a comment {i}</p></div>
<div class="cookie-notice">cookies</div></div><footer>&copy; f</footer></body>"""
TEXT = "T & U\nHello world é next {i}\nSecond para, long enough to count as text.\none\ntwo"


def test_page_text(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(box="main-content x12", i=i)) for i in range(6)]
    # on the same host a page whose teaser is longer than its article: the host's path decides
    teaser = PAGE.format(box="main-content x99", i=9).replace('<div class="side-bar sidebar">side</div>', '<div class="teasers"><p>' + "teaser text " * 30 + "</p></div>")
    rows += [(9, "http://h.example/9", teaser), (20, "x", None), (21, None, ""), (22, "http://z/", "plain &lt;text&gt;"), (23, "http://z/", "<div><p>cut of"), (24, "http://z/", "<p>x<a href='b>c'>link</a> t</p>"), (24, "http://z/", "<p>" + "long " * 40000)]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "page_id long, url string, html string, host int, path string")
    got = consensus_html.extract(df).collect()
    assert len(got) == len(rows)
    text = {}
    for r in got:
        text.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert all(text[i] == [TEXT.format(i=i)] for i in (*range(6), 9))
    assert text[20] == text[21] == [""] and text[22] == ["plain <text>"] and text[23] == ["cut of"]
    assert sorted(text[24], key=len) == ["xlink t", ("long " * 40000).strip()]
    assert consensus_html.extract(df.limit(0)).count() == 0


def test_page_text_outside_the_largest_box(spark):
    """Pages without article or main keep titles, leads and second parts, by themselves and against their host's path."""
    long, short = "A sentence of the longer part. " * 13, "One of the other. " * 12
    lead = f"<body><div class=w><h1>Title</h1><p>The lead.</p><div class=body><p>{long}</p></div></div></body>"
    parts = f"<body><div class=w><{{0}} class=a><p>{long}</p></{{0}}><{{0}} class=b><p>{short}</p></{{0}}></div></body>"
    plain = f"<body><div class=box><h1>First</h1><p>{long}</p></div></body>"
    other = f"<body><div class=box><p>{short}</p></div><div class=story><h1>Second</h1><p>{long}</p></div></body>"
    late = f"<body><div class=box><h1>Third</h1><p>{short}</p></div><div class=story><p>{long * 2}</p></div></body>"
    twice = f"<body><div class=box><h1>Fourth</h1><p>{long}</p></div><div class=box><p>{short}</p></div></body>"
    cases = [("a", lead), ("b", parts.format("div")), ("c", parts.format("section"))]
    cases += [("d", plain)] * 5 + [("d", other)] + [("e", plain)] * 5 + [("e", late)] * 2 + [("f", plain)] * 5 + [("f", twice)]
    df = spark.createDataFrame([(i, f"http://{h}.example/", x) for i, (h, x) in enumerate(cases)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in consensus_html.extract(df).collect()}
    long, short = long.strip(), short.strip()
    want = [f"Title\nThe lead.\n{long}"] + [f"{long}\n{short}"] * 2 + [f"First\n{long}"] * 5 + [f"{short}\nSecond\n{long}"]
    want += [f"First\n{long}"] * 5 + [f"Third\n{short}\n{long} {long}"] * 2 + [f"First\n{long}"] * 5 + [f"Fourth\n{long}\n{short}"]
    assert [got[i] for i in range(len(cases))] == want


def test_page_text_of_many_templates(spark):
    """Hosts of ten templates with random boilerplate around a known article."""
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet elit sed do eiusmod tempor".split()) for _ in range(n)).capitalize()
    junk = [
        lambda: f"<nav><ul><li><a href=/>{words(2)}</a><li><a href=/>{words(1)}</a></ul></nav>", lambda: f"<aside class='sidebar'><p>{words(30)}</p></aside>", lambda: f"<div class='cookie-banner'>{words(12)}</div>",
        lambda: f"<div id='comments'><h3>2 comments</h3><p>{words(25)}</p></div>", lambda: f"<footer>{words(9)} &copy;</footer>", lambda: f"<form><input><button>{words(2)}</button></form>", lambda: f"<div class='ad-box ads'><p>{words(14)}</p></div>",
        lambda: f"<script>var a = '<p>{words(5)}</p>';</script>", lambda: f"<style>p{{}}</style><!-- {words(8)} -->", lambda: f"<div style='display:none'><p>{words(20)}</p></div>",
    ]
    boxes = ["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div class='post-body'>{}</div>", "<div id=content><div class='entry'>{}</div></div>", "<section class='text'>{}</section>", "<table><tr><td>{}</td></tr></table>", "<div><div><div class='a1'>{}</div></div></div>", "<center>{}</center>", "<div class='wrap'><section>{}</section></div>"]
    rows, want = [], {}
    for host, box in enumerate(boxes):
        for i in range(6):
            blocks = [("h1", words(4))] + [(rng.choice(["p", "p", "p", "blockquote", "h2"]), words(rng.randint(12, 40))) for _ in range(rng.randint(3, 8))]
            body = "".join(f"<{t}>{x[:9]}<b>{x[9:]}</b></{t}>\n" for t, x in blocks)
            some = rng.sample(junk, 5)
            html = f"<html><body><div class=page>{some[0]()}{some[1]()}{box.format(body)}{some[2]()}{some[3]()}{some[4]()}</div></body></html>"
            rows.append((host * 100 + i, f"https://h{host}.example/{i}", html))
            want[host * 100 + i] = "\n".join(x for _, x in blocks)
    got = {r["page_id"]: r["text"] for r in consensus_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_page_nesting_is_linear():
    for source in ("<div>" * 30000 + "text " * 50 + "</div>" * 30000, "<b>" * 20000 + "</p>x" * 20000, "<b>" * 20000 + "<p>t</p>" * 20000):
        page = consensus_html.Page(source)
        assert page.choose(page.path(page.best()))[0]


# -- archives ---------------------------------------------------------------------------------

INSIDE = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
PAYLOADS = [INSIDE * 3, "x" * 5000, "", None, "é" * 99, "dup" * 50, "dup" * 50, "sm", "sm", "WARC/1.0\r\n" * 700, "\r\n\r\n", "WARC/1.0", "WARC/1.0\r\nContent-Length: 100000\r\n\r\n" + "z" * 3000]


@pytest.mark.parametrize("split", ["512", "10m"])
def test_archive_round_trip(spark, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rng = random.Random(1)
        rows = [(i, f"http://a/{i}\r\n", h) for i, h in enumerate(PAYLOADS)]
        rows += [(100 + i, None, f"pad{i} " * rng.randint(1, 40)) for i in range(40)]
        df = spark.createDataFrame([(*r, "q", 1) for r in rows], "page_id long, url string, html string, digest string, first int").coalesce(2)
        path = f"{common.shared_dir(spark)}/archive-{split}"
        warc.write(df, path)
        got = {r["page_id"]: r for r in warc.read(spark, path).collect()}
        data = {i: (h or "").encode() for i, _, h in rows}
        assert sorted(got) == sorted(data)
        for i, body in data.items():
            first = min(j for j, b in data.items() if b == body) if len(body) >= 100 else i
            r = got[i]
            assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
            assert (r["record_type"], r["refers_to"]) == (("response", None) if first == i else ("revisit", first))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("split", ["2k", "10m"])
def test_archive_of_long_and_torn_headers(spark, split):
    """Addresses of 200 KB, ones that end with the magic line so that splits tear their headers, and repeated ids."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        mark = "WARC/1.0"
        rows = [(i, f"http://a/{i}", f"page {i} " * 30) for i in range(12)]
        rows[3] = (3, "http://a/" + "x" * 200_000, "behind a long header")
        rows[5] = (5, "http://a/" + "y" * 600 + mark, "torn once")
        rows[6] = (6, "http://a/" + f"{'z' * 700}{mark}\r\n" * 4 + mark, "torn often " * 90)
        rows[7] = (7, mark, f"{mark}\r\nContent-Length: 7\r\nno blank line {mark}\r\n" * 60)
        rows += [(0, "again", rows[0][2]), (4, "again", rows[0][2]), (4, "again", rows[0][2])]
        df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
        path = f"{common.shared_dir(spark)}/long-{split}"
        warc.write(df, path)
        got = sorted(tuple(r)[2:] for r in warc.read(spark, path).collect())
        want = []
        for i, _, h in rows:
            kind = ("revisit", i, 0) if h == rows[0][2] and i else ("response", i, None)
            want.append((*kind, len(h.encode()), hashlib.sha256(h.encode()).hexdigest()))
        assert sorted(got, key=str) == sorted(want, key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_archive_damaged(spark, tmp_path):
    record = lambda i, n: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {n}\r\n\r\n{'p' * 20}\r\n\r\n"
    for name, text in {"cut": record(1, 20) + record(2, 99), "gap": record(1, 20) + record(2, 10) + record(3, 20), "start": "x" + record(1, 20)}.items():
        (tmp_path / name).write_bytes(text.encode())
        with pytest.raises(ValueError):
            warc.read(spark, str(tmp_path / name))
        left = [r["page_id"] for r in warc.read(spark, str(tmp_path / name), strict=False).collect()]
        assert sorted(left) == {"cut": [1], "gap": [1, 2], "start": []}[name]
    (tmp_path / "good").write_bytes((record(1, 20) + record(2, 20)).encode())
    assert warc.read(spark, str(tmp_path / "good")).count() == 2


def test_attach_beyond_a_broadcast(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else f"k{i % 5}") for i in range(300)], "i long, k string")
    small = spark.createDataFrame([(f"k{j}", j) for j in range(4)], "k string, v int")
    both = [sorted(map(tuple, common.attach(rows, small, "k", F.col("i"), most).select("i", "k", "v").collect()), key=str) for most in (10, 1)]
    assert both[0] == both[1] and len(both[0]) == 300


def test_archive_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    path = f"{common.shared_dir(spark)}/archive-empty"
    warc.write(df, path)
    assert warc.read(spark, path).count() == 0


def test_components_against_search(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500, 500 + i) for i in range(1, 80)] + [(600 + i, 601 + i) for i in range(70)]
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {v for v in root if all(a == b for a, b in edges if v in (a, b))}
    assert got == {v: find(v) for v in root if v not in alone}
