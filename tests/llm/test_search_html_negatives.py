"""Lexical search, main-text extraction and hard negatives against brute force, with edge rows and empty tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import hard_negatives, html_extraction, lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(docs, items, k):
    """(item, rank, id, score) by comparing all with all."""
    bags = [Counter(TERM.findall((t or "").translate(LOWER))) for _, t in docs]
    n_docs, total = sum(1 for b in bags if b), sum(sum(b.values()) for b in bags)
    df = Counter(t for b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for (ident, _), bag in zip(docs, bags, strict=True):
            n = sum(bag.values())
            m = 75 + 25 * n * n_docs // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m)) for t in TERM.findall((text or "").translate(LOWER)) if bag[t])
            if score > 0:
                scored.append((-score, ident is None, ident or 0))
        out += [(item, place + 1, None if null else ident, -s) for place, (s, null, ident) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def test_lexical_search(spark, docs, empty, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    queries = [(i, " ".join(t.split()[:25])) for i, (_, t) in enumerate(rows[:12]) if t] + [(100, None), (101, ""), (102, "漢字 Ünïcödé HERE here same"), (None, "same words"), (103, "zzzz no such"), (104, "a a a b"), (104, "a a a b")]
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in queries], "item_id long, text string, rank string, score int")
    for block in (2_000, 4):  # one block and several
        monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", block)
        got = sorted((tuple(r) for r in lexical_search.lexical_search(docs, items, k=7).collect()), key=str)
        assert got == ranked(rows, queries, 7)
    assert lexical_search.lexical_search(empty, items).count() == 0 and lexical_search.lexical_search(docs, items.limit(0)).count() == 0


def test_bounds_of_the_index_hold_and_rule_documents_out():
    rng = np.random.default_rng(3)
    tf, n = rng.integers(1, 200, 5000), rng.integers(1, 100_000, 5000)
    exact = lexical_search.impacts(tf, n, 1000, 700_000)
    level = -(-exact // lexical_search.UNIT)
    assert level.max() < 256 and (level * lexical_search.UNIT >= exact).all() and ((level - 1) * lexical_search.UNIT < exact).all()


def test_sums_beyond_a_float_are_exact():
    items = lexical_search.Items([b"a b", b"a"])
    scorer = lexical_search.Scorer(items, np.array([1, 1]))
    values = np.array([2**53 + 1, 2**53 + 3, 5], np.int64)
    assert scorer.summed(np.array([0, 0, 1]), values, 1).tolist() == [[2**54 + 4, 5]]


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<nav>menu</nav><article><header><h1>Head</h1></header><p>one &amp two&nbsp;&#x41;<br>  three<b>!</b></p><section class='comments'><p>me too</p></section></article><footer>f</footer>", "Head\n\none & two A three!"),
        ("<p>a<p>b <i>c</i><ul><li>x<li>y</ul><div>t<div class='sideBar'>no</div>u</div>", "a\n\nb c\n\nx\n\ny\n\nt\n\nu"),
        ("<table><tr><td>1<td>2<tr><th>3</table>", "1 2\n\n3"),
        ("<p a='x>y'>ok</p><script>var t=\"</p><p>no\";</script><style>p{}</style><p>z < 3 &lt;b&gt; <!-- c > --> d", "ok\n\nz < 3 <b> d"),
        ("<main><p>in</p><form><p>mail?</p></form><p>end <span class='ad'>buy</span> now</p></main><div>out</div>", "in\n\nend now"),
        ("<div role='navigation'>m</div><div id='cookie-notice'>c</div><div style='display: none'>h</div><p hidden>h</p><p>text</p><article class='comment'>no</article>", "text"),
        ("<p>open <em>all <p>the way", "open all\n\nthe way"),
        ("<pre> a\n b </pre>&am &copy &notit; &#0; &unknown;", "a b\n\n&am © ¬it; � &unknown;"),
        ("<nav>only</nav>", ""),
        ("text without any element", "text without any element"),
        ("<br/><p/>x</div></p><p>y", "x\n\ny"),
    ],
)
def test_declared_parts(body, want):
    for text in (page(body), body):
        assert html_extraction.main_text(html_extraction.read(text), set()) == want


def test_long_and_broken_pages_take_linear_time():
    for text in ("<div>" * 100_000 + "x", "<p>a<b>" * 50_000, "<a href='" * 50_000, "<!--" * 100_000, "<li><ul>" * 30_000, "&" * 200_000, "<" * 200_000, "<p title=\"" + "x>" * 100_000):
        html_extraction.read(text)


def test_style_tree(spark):
    """Of pages without any declared part the branches that repeat go; small hosts and equal pages lose nothing."""
    rng = random.Random(4)
    own = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(12))
    rows, want = [], {}
    for i in range(30):
        texts = [own() for _ in range(rng.randint(1, 6))]
        top = f"<div class='x1'><span>Home</span> <a>About</a></div><div class=y><p>{'Imprint' if i % 3 else 'Legal'}</p><p>All rights</p></div>"
        rows.append((i, f"http://User@Big.example:80/{i}", top + "<div class=z>" + "".join(f"<p>{t}</p>" for t in texts) + "</div>"))
        want[i] = "\n\n".join(texts)
    for i in range(40, 45):
        rows.append((i, "https://small.example/", "<div class=x>Home</div><p>same text on few pages</p>"))
        want[i] = "Home\n\nsame text on few pages"
    for i in range(50, 70):
        rows.append((i, "https://copies.example/p", "<p>one page, many times</p>"))
        want[i] = "one page, many times"
    rows += [(80, None, None), (None, "no host", "<p>a</p>"), (None, "no host", "<p>a</p>"), (81, "", "")]
    pages = spark.createDataFrame([(*r, "x", 1, "h") for r in rows], "page_id long, url string, html string, text string, n_chars int, host string")
    out = html_extraction.extract(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in out.collect()]
    texts = want | {80: "", 81: ""}
    assert sorted(got, key=str) == sorted(((i, u, t := texts.get(i, "a"), len(t)) for i, u, _ in rows), key=str)
    assert html_extraction.extract(pages.limit(0)).count() == 0


def test_importance_by_hand(spark):
    """Eight pages: one presentation and one content of low entropy, one element of eight presentations."""
    rows = [("h", f"<div><b>{'x' if i else 'y'}</b></div><section>{'<p>a</p><hr>' * (2**i)}{i}</section>") for i in range(8)]
    tree = html_extraction.style_tree(spark.createDataFrame(rows, "host string, html string")).collect()
    own = sorted(round(r["own"], 6) for r in tree if r["depth"] == 1)
    assert own == [round(1 - math.log(7) / 2 / math.log(8), 6), 1.0] and {r["pages"] for r in tree} == {8.0}


def mined(rows, anchors, n_positives=5, n_negatives=10):
    fine = [(i, label, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = max((len(v) for *_, v in fine), default=0)
    vec = np.array([np.pad(v, (0, dims - len(v))) for *_, v in fine]).reshape(len(fine), dims)
    order = lambda s, j: (-s[j], fine[j][0] is None, fine[j][0] or 0)
    out = []
    for a, (ident, label, _) in enumerate(fine):
        if not anchors(ident):
            continue
        s = [int(x) for x in vec @ vec[a]]
        for p in sorted((j for j in range(len(fine)) if j != a and fine[j][1] == label), key=lambda j: order(s, j))[:n_positives]:
            near = sorted((j for j in range(len(fine)) if fine[j][1] != label and 30 * s[p] <= 100 * s[j] <= 90 * s[p]), key=lambda j: order(s, j))
            out += [(ident, fine[p][0], place + 1, fine[j][0], s[p], s[j]) for place, j in enumerate(near[:n_negatives])]
    return sorted(out, key=str)


@pytest.mark.parametrize("dims", [1, 8, 9])
def test_hard_negatives(spark, dims, monkeypatch):
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(4, dims))
    rows = [(i, [float(x) for x in np.round(centres[i % 4] + rng.normal(size=dims), 2)], int(i % 4)) for i in range(600)]
    rows += [rows[0], rows[0], rows[20], (2000, [0.0] * dims, 1), (2020, rows[3][1], None), (2040, None, 1), (2060, [None] * dims, 2), (2080, [float("nan")] * dims, 2), (2100, [float("-inf")] * dims, 2), (None, rows[5][1], 0), (None, rows[6][1], 1), (2120, [0.5], 1), (2140, [], 3)]
    df = spark.createDataFrame([(*r, "x", 1, "c") for r in rows], "vec_id long, embedding array<double>, label int, row string, anchor int, codes string").repartition(3)
    for block in (1_024, 9):
        monkeypatch.setattr(hard_negatives, "BLOCK", block)
        got = sorted((tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 20 == 0).collect()), key=str)
        assert got == mined(rows, lambda i: i is not None and i % 20 == 0) and got
    assert hard_negatives.hard_negatives(df.limit(0), F.lit(True)).count() == 0
    assert hard_negatives.hard_negatives(df, F.lit(False)).count() == 0


def test_bounds_of_the_codes_hold():
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (500, 6))
    books = hard_negatives.fit_codewords(x[:400])
    near = np.stack([hard_negatives.nearest(x[:, 2 * s : 2 * s + 2], b) for s, b in enumerate(books)], 1)
    left = x - np.concatenate([b[near[:, s]] for s, b in enumerate(books)], 1)
    rows = [{"row": i, "label": 0, "vec": x[i].tolist()} for i in range(20)]
    anchors = hard_negatives.Anchors(rows, books, 6)
    low, up = anchors.bounds(anchors.tables(), near.astype(np.uint8), hard_negatives.up_root((left**2).sum(1)))
    exact = x[:20] @ x.T
    assert (low <= exact).all() and (exact <= up).all() and (up - low).mean() < 0.5 * np.abs(exact).mean()
