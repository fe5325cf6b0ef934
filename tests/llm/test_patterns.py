"""Vector codes, periodic runs and page text against plain versions, and their edge cases."""

import hashlib
import math
import random
import re
from html import unescape
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm import html_template, periodic_runs, vector_codes
from holdfast.llm.common import table
from holdfast.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
DIR = "/root/testdata/sf0.01"


# Vector codes


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """The rule read word for word, in Python's integers."""
    kept = [(i, tuple(math.floor(1024 * x) for x in v), label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = len(kept[0][1]) if kept else 0
    w = dim // parts
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    order = sorted((k for k in range(len(kept)) if kept[k][0] is not None), key=lambda k: kept[k][:2])[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]

    def nearest(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return min(range(len(d)), key=lambda j: (d[j], j)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(nearest(c[p], books[p])[0], []).append(c[p])
            books[p] = [tuple(sum(col) // len(groups[j]) for col in zip(*groups[j])) if j in groups else e
                        for j, e in enumerate(books[p])]
    out, by_label = [], {}
    for (i, _, label), c in zip(kept, cut):
        near = [nearest(c[p], books[p]) for p in range(parts)]
        error = sum(d for _, d in near)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{j:02x}" for j, _ in near), error, label))
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[label], digest) for i, c, e, label in out), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, code string"


def test_codes_equal_the_plain_version(spark):
    rnd = random.Random(3)
    centres = [[rnd.uniform(-1, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [c + rnd.gauss(0, 0.01) for c in centres[i % 5]], rnd.choice([None, 1, 2])) for i in range(60)]
    rows += [(100 + i, [float(rnd.randint(-2, 2)) for _ in range(8)], 7) for i in range(40)]  # many ties
    rows += [(3, rows[3][1], 1), (None, rows[5][1], 2), (200, None, 1), (201, [None] + [0.0] * 7, 1),
             (202, [math.nan] * 8, 1), (203, [math.inf] + [0.0] * 7, 7), (204, [-math.inf] + [0.0] * 7, 7)]
    rows = [(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    df = spark.createDataFrame([(*r, "clash") for r in rows], VECTORS).repartition(5)
    for entries in (4, 16):
        got = sorted((tuple(r) for r in vector_codes.compress(df, entries=entries).collect()), key=repr)
        assert got == plain_codes(rows, entries=entries)


@pytest.mark.parametrize("mantissa", [12, 20, 53])
def test_products_of_limbs_are_exact(mantissa):
    rnd = np.random.default_rng(mantissa)
    for top in (1, 1000, 1 << 27):
        x, c = rnd.integers(-top, top + 1, (40, 16)), rnd.integers(-top, top + 1, (9, 16))
        x[0], c[0], c[1] = top, -top, top
        exact = [[sum(int(a) * int(b) for a, b in zip(u, v)) for v in c] for u in x]
        assert vector_codes.exact_products(x, c, mantissa).tolist() == exact
    books = rnd.integers(-top, top, (4, 9, 4))
    code, error = vector_codes.assign(rnd.integers(-top, top, (30, 16)), books, mantissa)
    assert (code >= 0).all() and (error >= 0).all()


def test_codes_of_odd_tables(spark):
    empty = vector_codes.compress(spark.createDataFrame([], VECTORS))
    assert empty.collect() == [] and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    rows = [(1, [0.5] * 8, 1, ""), (2, [0.5] * 4, 1, ""), (3, [1e30] * 8, 2, ""), (4, [0.25] * 8, 1, ""), (5, [], 3, "")]
    got = {r["vec_id"]: r for r in vector_codes.compress(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got[1]["code"] == "00000000" and got[4]["code"] == "01010101" and got[1]["label_error"] == 0
    assert all(got[i]["code"] is None and got[i]["error"] is None for i in (2, 3, 5)) and got[3]["label_error"] is None
    nameless = vector_codes.compress(spark.createDataFrame([(None, [0.5] * 4, 1, "")], VECTORS)).collect()
    assert nameless[0]["code"] is None
    none = vector_codes.compress(spark.createDataFrame([(1, [], None, ""), (2, [], None, "")], VECTORS)).collect()
    assert [(r["code"], r["error"], r["label_error"]) for r in none] == [("00000000", 0, 0)] * 2


# Periodic runs


def plain_runs(x):
    out, n = [], len(x)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            a = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            if i > a and i + q - a >= max(6, 4 * q) and not any(s <= a and i + q <= s + k for s, k, _ in out):
                out.append((a, i + q - a, q))
            i += i == a
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + k for s, k, q in runs)]
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(kept)))


def repetitive(rnd, n, k):
    x = [rnd.randrange(k) for _ in range(n)]
    for _ in range(rnd.randrange(4)):
        if n > 8:
            s, q = rnd.randrange(n), rnd.randint(1, n // 4)
            w = x[s:s + q]
            for i in range(s, min(n, s + rnd.randint(q, 7 * q))):
                x[i] = w[(i - s) % len(w)]
    return x


def test_runs_equal_the_plain_version():
    rnd = random.Random(4)
    texts = [repetitive(rnd, rnd.choice([0, 1, 5, 6, 7, 20, 60, 200]), rnd.choice([1, 2, 3, 5, 30])) for _ in range(600)]
    texts += [([0] * 30 + [1]) * 20, list(range(150)) * 4, list(range(150)) * 3 + list(range(149)), [0, 1, 2] * 30 + [0, 1] * 40]
    ids = np.concatenate([np.array(x, np.int64) for x in texts])
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    got = periodic_runs.runs_of(ids, offsets)
    assert got == [plain_runs(x) for x in texts]
    assert sum(map(len, got)) > 100


def test_more_primes_where_sums_are_greater():
    rnd = np.random.default_rng(5)
    for top in (100, 1 << 22, 1 << 31):
        block, window = rnd.integers(0, top, (7, 8)).astype(np.uint64), rnd.integers(0, top, (7, 15)).astype(np.uint64)
        window[2, 3:11] = block[2]
        got = periodic_runs.mismatches(block, window, top)
        assert len(got) == (1 if top == 100 else 2 if top == 1 << 22 else 3)
        for r in range(7):
            for lag in range(8):
                exact = sum((int(a) - int(b)) ** 2 for a, b in zip(block[r], window[r, lag:lag + 8]))
                assert [int(m[r, lag]) for m in got] == [exact % p for p, _ in periodic_runs.PRIMES[:len(got)]]


DOCS = "doc_id long, text string, n_runs string"


def test_digests_equal_the_plain_version(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(f"w{x}" for x in repetitive(rnd, rnd.randint(0, 120), rnd.choice([2, 9, 90])))) for i in range(150)]
    rows += [(151, None), (152, ""), (153, " \t\r\n "), (None, "a a a a a a b"), (None, None), (5, rows[5][1]), (160, "\x00 \x00 \x00 " * 9),
             (161, "é\u00a0é\u2028é " * 7), (162, "one\x0btwo\x0c" * 5), (163, "long " * 3000 + " ".join(map(str, range(3000))))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], DOCS).repartition(4)
    got = sorted((tuple(r) for r in periodic_runs.digest(df, periodic_runs.with_cycles).collect()), key=repr)
    assert got == sorted((plain_digest(*r) for r in rows), key=repr)
    assert periodic_runs.digest(spark.createDataFrame([], DOCS)).collect() == []


def test_digests_of_documents(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in QUERIES["op12_periodic_runs"](spark, SMALL).collect())
    assert got == sorted(plain_digest(*r) for r in rows)


def test_collapse_and_runs(spark):
    rows = [(1, "x " + "a b c " * 6 + "y", "k"), (2, None, "k"), (3, "plain  words", "k"), (None, "z " * 9, "k")]
    df = spark.createDataFrame(rows, DOCS)
    got = periodic_runs.collapse(df)
    assert got.columns == df.columns
    assert sorted((tuple(r)[1] for r in got.collect()), key=repr) == sorted(["x a b c y", None, "plain words", "z"], key=repr)
    assert sorted((tuple(r) for r in periodic_runs.runs(df).collect()), key=repr) == sorted([(1, 1, 18, 3), (None, 0, 9, 1)], key=repr)


# Text of pages


def plain_article(html):
    """For the pages of the test tables: what stands between the article's tags."""
    inside = re.search(r"<article>(.*)</article>", html, re.S)[1]
    found = (" ".join(unescape(re.sub(r"</?b>|<br>", " ", x) if "<br>" in x else re.sub(r"</?b>", "", x)).split())
             for x in re.split(r"</?(?:p|h1)>", inside))
    return "\n".join(x for x in found if x)


@pytest.mark.parametrize("held", [html_template.HELD, 0])
def test_text_of_the_tables_pages(spark, held):
    pages = table(spark, DIR, "pages")
    html = {r["page_id"]: r for r in pages.collect()}
    got = html_template.extract(pages, held=held).collect()
    assert len(got) == len(html)
    for r in got:
        assert r["text"] == plain_article(html[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"])
        assert r["url"] == html[r["page_id"]]["url"]


PAGES = "page_id long, url string, html string, text int"


def words(i, n=30):
    return " ".join(random.Random(i).choices("lorem ipsum dolor sit amet consectetur adipiscing elit sed do".split(), k=n))


def site(i):
    links = "".join(f'<li><a href="/{k}">Topic {k} {words(i + k, 2)}</a></li>' for k in range(8))
    return (f'<html><body><div class="top1"><ul>{links}</ul></div><div id="c">'
            f"<div class=note{i}>We store small files on your machine.</div>"
            f"<h2>Title {i}</h2><p>{words(i)}<p>{words(i + 1000)} &lt;b&gt; &amp; so&nbsp;on</div>"
            f"<div class='x9'>All rights lie with the makers of this site.</div></body>")


@pytest.mark.parametrize("held", [html_template.HELD, 0])
def test_template_text_and_link_slots_go(spark, held):
    rows = [(i, f"https://News.Example.com/{i}", site(i), 0) for i in range(12)]
    rows += [(50 + i, "https://copies.example.com/", site(1), 0) for i in range(5)]  # copies: no template can be told
    rows += [(60 + i, f"https://few.example.com/{i}", site(i), 0) for i in range(2)]
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    got = {r["page_id"]: r["text"] for r in html_template.extract(df, held=held).collect()}
    for i in range(12):
        assert got[i] == f"Title {i}\n{words(i)}\n{words(i + 1000)} <b> & so on"
    for i in (*range(50, 55), 60, 61):  # no template: what the page alone does not tell stays
        assert "Title" in got[i] and "makers of this site" in got[i] and "Topic" not in got[i]


def test_pages_that_are_near_copies_keep_their_text(spark):
    page = lambda i: f"<div class=z><p>{words(1)}<p>{words(2)}<p>{i}</div>"
    rows = [(i, "http://same.example.com", page(i), 0) for i in range(6)]
    for r in html_template.extract(spark.createDataFrame(rows, PAGES)).collect():
        assert r["text"] == f"{words(1)}\n{words(2)}\n{r['page_id']}"


def test_classes_follow_occurrence_vectors(spark):
    rows = [(i, "http://h.example.com", f"<div><p>shared</p>{'<hr><h3>odd</h3>' * (i % 2)}<p>{words(i)}</p></div>", 0) for i in range(8)]
    df = spark.createDataFrame(rows, PAGES)
    found = html_template.classes(df).collect()
    assert {(r["is_tag"], r["n_pages"], r["times"]) for r in found} == {(True, 8, 8), (True, 8, 16), (True, 4, 4), (False, 8, 8), (False, 4, 4)}
    assert html_template.template_roles(html_template.classes(df)).count() == 2


HARD = [
    ("<p>a<p>b", "a\nb"),
    ("<article><h1>T</h1>x<br>y <b>bo<i>ld</i></b>!</article>", "T\nx y bold!"),
    ("<header><h1>Site</h1></header><main><header><h1>T</h1></header><p>x</p><footer>f</footer></main><footer>f</footer>", "T\nx"),
    ("<article><p>x</p><div class='related-posts'>r</div><section id=comments><article>c</article></section></article>", "x"),
    ("<article><p>x</p><article><p>reader's word</p></article></article>", "x"),
    ("<div class=sidebar>s</div><aside>a</aside><div class='cookie-notice'>n</div><form><p>f</p></form><p>x</p>", "x"),
    ("<body class='has-sidebar'><div class='no-menu'>x</div>", "x"),
    ("<form><main><p>x</p></main></form>", "x"),
    ("<form><article><p>x</p><form><p>Leave a word<input></form></article></form>", "x"),
    ("<script>if (a<b) '<p>no</p>'</script><style>p{}</style><p>x<script>", "x"),
    ("<p>x<!-- <p>no</p> -->y<!--", "xy"),
    ("<p>1 < 2 &amp &copy; &#65;&#x42; &unknown;</p>", "1 < 2 & © AB &unknown;"),
    ("<p title='a>b'>x</p><p title=\"it's\">y</p><a href='", "x\ny"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e<tr><td>f</table>", "a\nb\nc\nd\ne\nf"),
    ("</div></p>x</b><p hidden>h</p><div style='display: none'>i</div>", "x"),
    ("plain text\n only", "plain text only"),
    ("<article></article><p>outside</p>", ""),
    ("", ""), (None, ""), ("<", "<"), ("<p", ""), ("<>", "<>"), ("\x00<p>\ud7ff\U0001f600</p>", "\x00\n\ud7ff\U0001f600"),
]


def test_hard_pages(spark):
    rows = [(i, None if i % 3 else "no host", h, 1) for i, (h, _) in enumerate(HARD)]
    rows += [(None, "http://x.example.com", "<p>x", 1), (1000, None, None, None), (1000, None, None, None)]
    got = html_template.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows)
    assert {r["page_id"]: r["text"] for r in got} == {**{i: t for i, (_, t) in enumerate(HARD)}, None: "x", 1000: ""}
    assert html_template.extract(spark.createDataFrame([], PAGES)).collect() == []


@pytest.mark.parametrize("part", ["<div>", "<a", "<p><b>", "</div>", "<a href=\"", "<!--", "<li>x", "<article>y", "&amp", "<td><table>", "< "])
def test_long_pages_take_linear_time(part):
    import time

    start = time.perf_counter()
    html_template.Page(part * 40_000).main_text(lambda x: np.zeros(len(x), bool))
    assert time.perf_counter() - start < 10


def test_hosts(spark):
    urls = ["HTTP://A.Example.com/x://y", "x://b?c", "://c#d", "none", None, "http://", "http:///p", "a://É.com"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [r[0] for r in df.select(html_template.host_of(F.col("url"))).collect()]
    assert got == ["a.example.com", "b", "c", None, None, None, None, "É.com"]
