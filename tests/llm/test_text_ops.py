"""Spelling variants, main text of pages, importance resampling: against brute force, on odd rows and planted cases."""

import hashlib
import html
import html.parser
import math
import random
import re
import time
import zlib
from collections import Counter

import pytest

from tidewatch.llm import html_text, importance, spelling


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


# spelling variants


def words_by_hand(plain, drop=31, least=7, fewest=2):
    n = Counter()
    for i, t in plain:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % drop == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= least:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= fewest}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(words, factor=10):
    near = {w: [v for v in words if v != w and is_near(w, v)] for w in words}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= factor * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def got_variants(docs, **how):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs, **how).collect()}


def test_variants_of_odd_rows(docs, plain):
    assert got_variants(docs) == variants_by_hand(words_by_hand(plain))


@pytest.mark.parametrize("limit", [1, 60, 1 << 20])
def test_variants(spark, limit):
    """Random words of few letters, so that most are near others; chains of forms; keys split down to single positions."""
    rng = random.Random(limit)
    pool = ["".join(rng.choice("abé") for _ in range(rng.randint(3, 7))) for _ in range(150)]
    texts = [" ".join(rng.choice(pool[: rng.choice((5, 30, 150))]) for _ in range(400)) for _ in range(12)] + ["aaaaaaaa " * 500, "aaaaaaa " * 40 + "aaaaaab " * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    how = {"least": 3, "drop": 5}
    want = variants_by_hand(words_by_hand(enumerate(texts), **how))
    assert any(w[1] for w in want) and any(w[1] and w[2] != w[1] for w in want)
    assert got_variants(docs, limit=limit, bucket=500, **how) == want


def test_pairs_are_found_once():
    """Repeated letters allow an insertion in many places."""
    words = [b"aaaa", b"aaab", b"aaaaa", b"aabaa", b"baaaa", b"aaaab", b"abab", b"ababa", b"babab"]
    want = {(a, b) for a in words for b in words if a != b and is_near(a, b) and 4 in (len(a), len(b))}
    got = [(words[x], words[y]) for lo, hi in ((0, 2), (2, 5)) for a, b in spelling.near_pairs(words, 4, lo, hi) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want


def test_wavelet_tree_reports_rectangles():
    import numpy as np

    rng = np.random.default_rng(3)
    values = rng.permutation(300)
    tree = spelling.WaveletTree(values)
    box = np.sort(rng.integers(0, 301, (200, 2, 2)), axis=2)
    q, v = tree.report(box[:, 0, 0], box[:, 0, 1], box[:, 1, 0], box[:, 1, 1])
    want = {(k, int(x)) for k, ((a, b), (c, d)) in enumerate(box.tolist()) for x in values[a:b] if c <= x < d}
    assert len(q) == len(want) and set(zip(q.tolist(), v.tolist(), strict=True)) == want


def test_very_long_words(spark):
    """Words of 200,000 code points that differ at either end and in the middle."""
    rng = random.Random(1)
    a = "".join(rng.choice("abcdefgh") for _ in range(200_000))
    some = [a, a[:5] + "z" + a[6:], a[:100_000] + a[100_001:], a + "q", a[:199_990] + "z" + a[199_991:]]
    docs = spark.createDataFrame([(i, " ".join(some)) for i in range(2)], "doc_id long, text string")
    start = time.time()
    got = {r.word: r.n_near for r in spelling.variants(docs, drop=10**9).collect()}
    assert got == {w: sum(v != w and is_long_near(w, v) for v in some) for w in some} and time.time() - start < 120


def is_long_near(a, b):
    a, b = sorted((a, b), key=len)
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return len(b) - len(a) < 2 and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :])


def test_variants_of_nothing(spark, no_docs):
    assert spelling.variants(no_docs).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 0


# importance resampling


def features_by_hand(text, orders):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, orders + 1) for i in range(len(words) - k + 1)]


def resampled_by_hand(plain, target, orders, percent, least, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    made = [features_by_hand(t, orders) for _, t in plain]
    s, t = Counter(bucket(f) for _, fs in made for f in fs), Counter(bucket(f) for x in target for f in features_by_hand(x, orders)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    rows = []
    for k, ((i, _), (n, fs)) in enumerate(zip(plain, made, strict=True)):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n, k])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in rows)


@pytest.mark.parametrize("orders", [1, 3])
@pytest.mark.parametrize("percent", [10, 70])
def test_resample(spark, docs, plain, orders, percent):
    target = [None, "", "alpha1 BETA2 gamma3 übung", "omega39 one two"]
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, least=2, orders=orders)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()) == resampled_by_hand(plain, target, orders, percent, 2)


def test_resample_of_nothing(spark, no_docs, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(no_docs, none).count() == 0
    assert importance.resample(docs, none).count() == docs.count()


def test_gains_by_hand(spark):
    counts = lambda rows: spark.createDataFrame(rows, "bucket int, n long")
    got = {r.bucket: r.gain for r in importance.gains(counts([(0, 3)]), counts([(1, 2)]), 2).collect()}
    assert got == {0: math.floor(1000 * math.log(1 * 5 / (4 * 4))), 1: math.floor(1000 * math.log(3 * 5 / (1 * 4)))}


# main text of pages


def test_given_pages_against_another_parser(spark):
    """The given pages mark their articles, so a plain pass of the standard parser over these gives their text."""

    class Article(html.parser.HTMLParser):
        def __init__(self):
            super().__init__()
            self.depth, self.parts = 0, []

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            self.parts.append("\0" if tag in ("p", "h1", "article") else " " if tag == "br" else "")

        def handle_endtag(self, tag):
            self.depth -= tag == "article"
            self.parts.append("\0" if tag in ("p", "h1", "article") else "")

        def handle_data(self, data):
            self.parts.append(data if self.depth else "")

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html_text.main_text(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        a = Article()
        a.feed(r.html)
        a.close()
        want = "\n".join(b for b in (" ".join(x.split()) for x in "".join(a.parts).split("\0")) if b)
        assert got[r.page_id] == (r.url, want, len(want))


def text_of(source):
    return "\n".join(t for t, _ in html_text.structure(source)[1])


@pytest.mark.parametrize(
    "source, want",
    [
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<p>a<p>b  c<br>d\n e</p>f", "a\nb c d e\nf"),
        ("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><th>3</table>", "a\nb\n1\n2\n3"),
        ("<body><script>'<p>x'</script><style>p{}</style><p>a<!-- <p>no --> b<!-- open", "a b"),
        ("<nav>menu</nav><header>top</header><article><header><h1>T</h1></header><p>x</p><aside>s</aside><section id='comments'><article>c</article></section></article><footer>f</footer>", "T\nx"),
        ("<div class='cookie-notice'>c</div><div id=main-sidebar>s</div><main><h1>T</h1><p>x &eacute;&#8364;&nbsp;y</p><div class='share-buttons'>s</div></main>", "T\nx é€ y"),
        ("<div class='site-header'>h</div><div class='page with-sidebar'><h1>T</h1><p>x</p></div>", "T\nx"),
        ("<h1>T</h1><article><p>x</p></article><p>y</p>", "T\nx"),
        ("<div><a href=1>One</a> | <a href=2>Two</a> | <a href=3>Three</a></div><p>x <a href=4>y</a></p>", "x y"),
        ("<div role=navigation>n</div><form>f</form><p hidden>h</p><p>x</p><div class='adBox'>ad</div><div class='read-more'>r</div>", "x\nr"),
        ("<p title='a\">b</p><p>c 1 < 2 & 3</p>", "b\nc 1 < 2 & 3"),
        ("<article><p>cut <b>off<a hre", "cut off"),
        ("<article><p>a</b></i></div>b</article>", "ab"),
        ("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>x", "deep\nx"),
        ("<b>" * 20000 + "<p>y" * 2000, "\n".join(["y"] * 2000)),
    ],
)
def test_structure(source, want):
    start = time.time()
    assert text_of(source) == want and time.time() - start < 5


PAGES = "page_id long, url string, html string, host string, no long, text string, gone int"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, "t", 2) for i, (u, h) in enumerate(rows)], PAGES).repartition(3)


def test_templates(spark):
    """Plain boxes that recur on a host go; copies, near copies, shared passages and other hosts' boxes stay."""
    rng = random.Random(2)
    sentence = lambda: " ".join(rng.choice("red green blue cyan pink grey".split()) + str(rng.randrange(90)) for _ in range(12))
    box, foot = "<div><span>Read <i>us</i></span> daily</div>", "<div>All rights</div>"
    rows, want = [], []

    def page(host, body, text):
        rows.append((f"https://u@{host}:80/{len(rows)}", body))
        want.append(text)

    for _ in range(10):
        s, t = sentence(), sentence()
        page("A.example", f"{box}<div><p>{s}</p><p>{t}</p></div>{foot}", f"{s}\n{t}")
    for k in range(10):
        s = sentence()
        page("b.example", f"<article><h1>{s}</h1>{box}<p>{s} {k}</p></article>{box}", f"{s}\n{s} {k}")
    for _ in range(2):  # too few pages to know
        s = sentence()
        page("c.example", f"{box}<p>{s}</p>", f"Read us daily\n{s}")
    s = sentence()
    for _ in range(9):  # copies of one article
        page("d.example", f"<div><p>{s}</p></div>", s)
    for k in range(9):  # near copies
        page("e.example", f"<article><p>{s}</p><p>{s} again</p><p>v{k}</p></article>", f"{s}\n{s} again\nv{k}")
    for k in range(9):  # a passage on a third of the pages
        t = sentence()
        page("f.example", f"<article><p>{t}</p>{'<p>' + s + '</p>' if k % 3 == 0 else ''}</article>", t + ("\n" + s if k % 3 == 0 else ""))
    for u in (None, "", "no address"):
        for _ in range(4):
            rows.append((u, f"{box}<p>x</p>"))
            want.append("Read us daily\nx")
    rows.append(("http://a.example/null", None))
    want.append("")
    for sent in (html_text.SENT, 0):
        got = sorted(html_text.main_text(pages_of(spark, rows), sent=sent).collect(), key=lambda r: r.page_id)
        assert [r.text for r in got] == want and [r.url for r in got] == [u for u, _ in rows]
        assert all(r.n_chars == len(r.text) for r in got) and list(got[0].asDict()) == ["page_id", "url", "text", "n_chars"]


def test_no_pages(spark):
    assert html_text.main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_plans_shuffle_no_pages(spark):
    """Where templates are few, texts of pages are not shuffled."""
    plan = html_text.main_text(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
