"""The corpus operators against brute force, round trips and held-out rows, and on messy inputs."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, html_text, line_dedup, ngram_join, ordinal, packing, quality_rules, sharding, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


PROSE = "It was the best of times, it was the worst of times, it was the age of wisdom, it was the age of foolishness.\nThe second line of this document says something else, and it ends well."
MESSY = [PROSE, PROSE, None, "", " \n\t\n", "word", "Ünï — 漢字 " * 40, "long text " * 30_000, PROSE.replace("wisdom", "Wisdom"), "\x00\x1c a\x85b", "!!! ??? |||"]


@pytest.fixture(scope="module")
def messy(spark):
    """Nulls in every column, repeated rows, and columns named like what operators use inside."""
    df = docs(spark, [*MESSY, MESSY[0], PROSE], [*range(len(MESSY)), 0, None])
    for c in ("block", "rank", "digest", "size", "h", "c", "doc", "at", "rep", "bands", "__id", "__drops", "__spans", "__gone", "a.b"):
        df = df.withColumn(c, F.lit(None).cast("int") if c == "h" else F.lit(c))
    return df.withColumn("lang", F.when(F.col("doc_id") > 2, F.col("lang")))


# -- 1 ----------------------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("room", [ann.QUERY_ROOM, 10])
def test_ann_recall_against_brute_force(spark, room):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[200:700] = x[200]  # a hot vector: ties go to the smaller ids
    got = ann.search(vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]), lambda v: v % 20 == 0, query_room=room).toPandas()
    hits = 0
    for q in range(0, 1500, 20):
        mine = got[got.query_id == q].sort_values("rank")
        s = (x.astype(float) * x[q].astype(float)).sum(1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:20]
        assert mine["rank"].tolist() == list(range(1, 21)) and q not in set(mine.vec_id)
        assert np.allclose(mine.score, s[mine.vec_id], rtol=0, atol=1e-9) and mine.score.is_monotonic_decreasing
        hits += len(set(best) & set(mine.vec_id))
    assert hits / (75 * 20) >= 0.9


def brute_near(x, q, k=20):
    s = (x.astype(float) * x[q].astype(float)).sum(1)
    s[q] = -np.inf
    return np.lexsort((np.arange(len(x)), -s))[:k], s


def found_near(spark, x, is_query=lambda v: v % 20 == 0):
    out = collections.defaultdict(list)
    for r in ann.search(vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]), is_query).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_ann_small_cells_are_filled_up(spark):
    """Orthogonal centres, most rows at one of them: a query in a cell of three rows gets its twenty all the same."""
    rng = np.random.default_rng(2)
    x = np.zeros((1000, 32), np.float32)
    x[np.arange(1000), np.where(np.arange(1000) < 90, np.arange(1000) // 3 + 1, 0)] = 1
    x += rng.normal(0, 1e-3, x.shape).astype(np.float32)
    got = found_near(spark, x)
    assert sorted(got) == list(range(0, 1000, 20)) and all(len(v) == 20 for v in got.values())
    for q in range(0, 90, 20):
        assert {v for v, _ in got[q][:2]} == set(range(q // 3 * 3, q // 3 * 3 + 3)) - {q}


@pytest.mark.parametrize("size", [1e20, 1e-20, 3e38])
def test_ann_large_and_small_vectors(spark, size):
    x = (np.random.default_rng(3).uniform(-1, 1, size=(600, 16)) * size).astype(np.float32)
    got = found_near(spark, x)
    hits = 0
    for q in range(0, 600, 20):
        best, s = brute_near(x, q)
        assert [v for _, v in got[q]] == [s[v] for v, _ in got[q]] or np.allclose([v for _, v in got[q]], [s[v] for v, _ in got[q]], rtol=1e-12)
        hits += len(set(best.tolist()) & {v for v, _ in got[q]})
    assert hits >= 0.9 * 30 * 20


def test_ann_mixed_sizes_are_complete(spark):
    x = np.random.default_rng(4).normal(size=(400, 8)).astype(np.float32)
    x[::3] *= np.float32(1e30)
    x[1::3] *= np.float32(1e-30)
    assert all(len(v) == 20 for v in found_near(spark, x).values())


def test_ann_recall_on_clusters(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 24)) * 3
    x = (centres[rng.choice(40, 3000, p=np.arange(1, 41) / 820)] + rng.normal(size=(3000, 24)) * 0.3).astype(np.float32)
    got = found_near(spark, x)
    share = [len(set(brute_near(x, q)[0].tolist()) & {v for v, _ in got[q]}) / 20 for q in range(0, 3000, 20)]
    assert all(len(v) == 20 for v in got.values()) and np.mean(share) >= 0.9


def heavy(rng, n, d):
    """Directions of one law, lengths of another with a heavy tail: the longest rows are each query's neighbours."""
    return (rng.normal(size=(n, d)) * np.exp(rng.normal(size=(n, 1)) * 3)).astype(np.float32)


def one_giant(rng, n, d):
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[5] *= np.float32(1e30)
    return x


@pytest.mark.parametrize("kind", [heavy, one_giant])
def test_ann_recall_where_codes_are_coarse(spark, monkeypatch, kind):
    """The sample is a small part of the rows, as in a large table."""
    monkeypatch.setattr(ann, "SAMPLE", 512)
    x = kind(np.random.default_rng(8), 12_000, 32)
    got = found_near(spark, x, lambda v: v % 40 == 0)
    share = [len(set(brute_near(x, q)[0].tolist()) & {v for v, _ in got[q]}) / 20 for q in range(0, len(x), 40)]
    assert np.mean(share) >= 0.95 and np.mean(np.array(share) < 0.5) <= 0.05


def test_ann_repeated_ids(spark):
    """One row of an id holds: the one whose vector is least in the order of its bytes."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist(), 0) for i in range(60)]
    rows += [(20, rng.normal(size=4).astype(np.float32).tolist(), 0), (3, rng.normal(size=4).astype(np.float32).tolist(), 0), (4, None, 0)]
    held = {}
    for i, v, _ in rows:
        if v is not None:
            held[i] = min([np.array(v, "<f4").tobytes(), *([held[i]] if i in held else [])])
    x = np.array([np.frombuffer(held[i], "<f4") for i in range(60)])
    for order in (rows, rows[::-1]):
        got = ann.search(vectors(spark, order), lambda v: v % 20 == 0).orderBy("query_id", "rank").collect()
        for q in (0, 20, 40):
            best, s = brute_near(x, q)
            mine = [r for r in got if r["query_id"] == q]
            assert [r["vec_id"] for r in mine] == best.tolist() and np.allclose([r["score"] for r in mine], s[best], rtol=1e-12)


def test_ann_messy(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (20, [0.0, 1.0], None), (1, [1.0, 1.0], 0), (2, [1.0, 1.0], 0), (3, None, 0), (4, [0.0, 0.0], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [None, 1.0], 0), (8, [1.0], 0), (None, [1.0, 1.0], 0), (9, [], 0), (1, [1.0, 1.0], 0)]
    got = ann.search(vectors(spark, rows).withColumn("cell", F.lit(1)), lambda v: v % 20 == 0).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == {(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 0, 0.0)}
    assert ann.search(vectors(spark, []), lambda v: v % 20 == 0).count() == 0
    assert ann.search(vectors(spark, [(1, [1.0], 0)]), lambda v: v % 20 == 0).count() == 0


# -- 2 ----------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><header>Site of the year</header>
<div id="cookie-notice"><p>We use cookies on all of the pages of this site, and you have to like it.</p></div>
<article><h1>Big &amp; small</h1><p><b>First of the paragraphs,&nbsp; with  spaces
and a break.<br><p>Second &lt;one&gt; of them is this.</p><script>var x = "</p>";</script><aside>Related to the story of the day and more of it</aside>
<section class="comments"><p>I think that it was the best of all the articles that I have read.</p></section></article>
<form><p>Sign up for the letter of the week that is sent to all of you</p></form><div class="sidebar">More of the same for you</div><footer>&copy; The owner</footer></body></html>"""


def test_html_article():
    assert html_text.main_text(PAGE) == "Big & small\nFirst of the paragraphs, with spaces and a break.\nSecond <one> of them is this."


def test_html_without_an_article():
    prose = "<p>It was the best of times and it was the worst of times, said the man who was there for all of it.</p>"
    page = f'<div><a href=1>one</a> <a href=2>two</a></div><h2>A heading</h2>{prose}<p>Short one.</p>{prose}<p>End.</p><div>Tail.</div><ul><li><a href=3>The next of the stories that you have to read</a></ul>'
    text = "It was the best of times and it was the worst of times, said the man who was there for all of it."
    assert html_text.main_text(page) == f"A heading\n{text}\nShort one.\n{text}\nEnd."  # what stands in the article's element is nearer to it; between it and a menu stop words decide


@pytest.mark.parametrize("page, text", [("", ""), ("<", "<"), ("<article>cut off <b", "cut off"), ("<article><p>a</b></i></p>x", "a\nx"), ("<article>" + "<b>" * 20_000 + "deep", "deep"), ("<!-- never closed <p>x</p>", ""), ("<article>&#x41;&am;&unknown; &#0;", "A&am;&unknown; �")])
def test_html_broken(page, text):
    if page != "<":
        assert html_text.main_text(page) == text
    else:
        html_text.main_text(page)


def test_html_hints():
    prose = "<p>It was the best of times and it was the worst of times, said the man who was there for all of it.</p>"
    page = f'<div class="page-header"><p>The site of all the news that there is and that you have to read</p></div><article class="post tag-x"><div class="article-header"><h1>Head</h1></div>{prose}<div class="share-bar">Share it</div></article>'
    assert html_text.main_text(page) == "Head\nIt was the best of times and it was the worst of times, said the man who was there for all of it."


@pytest.mark.parametrize("empty", ['<svg viewBox="0 0 1 1"/>', "<svg/>", "<SVG a='>' b=1 c />", "<math/>", "<svg a=x/ b />", "<svg a=x/>y</svg>", "<svg><path d=''/></svg>", "<math><annotation>x^2</annotation></math>"])
def test_html_self_closed(empty):
    assert html_text.main_text(f"<article><p>One {empty} two.</p><p>Three.</p>") == "One two.\nThree."


@pytest.mark.parametrize(
    "line",
    [
        "Это было лучшее изо всех времён, это было худшее изо всех времён; это был век мудрости, это был век глупости.",
        "那是最美好的时代，那是最糟糕的时代；那是智慧的年头，那是愚昧的年头；那是信仰的时期。",
        "Była to najlepsza i najgorsza z epok, wiek rozumu i wiek szaleństwa, czas wiary i czas zwątpienia, pora światła.",
    ],
)
@pytest.mark.parametrize("name", ["post", "has-sidebar"])
def test_html_other_languages(line, name):
    links = "<ul>" + "<li><a href=1>Один из многих других материалов, которые надо прочитать сегодня же вечером</a></li>" * 3 + "</ul>"
    assert html_text.main_text(f'{links}<div class="{name}"><h2>1</h2><p>{line}</p><p>{line}</p></div><div class="comments">{line}</div>{links}') == f"1\n{line}\n{line}"
    english = "The rights of all the texts are with the people who wrote them, and they are to be asked for it."
    if not line.startswith("B"):
        assert html_text.main_text(f"{links}<p>{line}</p><p>{english}</p>") == f"{line}\n{english}"
    junk = "shoes boots sandals sneakers slippers heels loafers trainers cheap prices discount outlet"
    assert html_text.main_text(f"<p>{english}</p>" * 2 + f"<div>{junk}</div>") == f"{english}\n{english}"


WRAPPERS = ["content-sidebar-wrap", "has-sidebar", "page-with-menu", "site has-comments", "content-ad-wrap", "page-header-fixed"]


@pytest.mark.parametrize("name", WRAPPERS)
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_html_wrappers(name, tag):
    """A class that names what stands beside the article does not refuse the article."""
    lines = [f"It was the best of times and it was the worst of times, said the man who was there for all of it, number {i}." for i in range(6)]
    aside = '<div class="sidebar"><p>More of the same for you, and all of it is to be had at once from the shop on the other side.</p></div>'
    comments = '<div id="comments"><p>I think that this is the best of all the articles that I have read in the whole of my life.</p></div>'
    page = f'<div class="{name}"><{tag}>{"".join(f"<p>{x}</p>" for x in lines)}</{tag}>{aside}{comments}</div>'
    assert html_text.main_text(page) == "\n".join(lines)
    assert html_text.main_text(f'<{tag}><h1>Head</h1><div class="{name}">{"".join(f"<p>{x}</p>" for x in lines)}</div>{comments}</{tag}>') == "\n".join(["Head", *lines])
    split = "".join(f'<div class="w{i} text-widget"><p>{x}</p></div>' for i, x in enumerate(lines))
    assert html_text.main_text(f"<{tag}>{split}</{tag}>{comments}") == "\n".join(lines)


def test_html_foreign_articles():
    """Comments and teasers that are articles stay out, however long, where the page has an article of its own."""
    long = "<p>I think that this is the best of all the articles that I have read in the whole of my life.</p>" * 5
    comments = f'<div class="comments"><article class="comment">{long}</article></div>'
    teasers = f'<div class="related"><article>{long}</article></div>'
    assert html_text.main_text(f"<article><h1>Head</h1>{'<p>A short one.</p>' * 6}{comments}</article>{teasers}") == "\n".join(["Head", *["A short one."] * 6])
    assert html_text.main_text(f'<div class="has-sidebar"><article><p>A short one.</p></article></div>{comments}{teasers}') == "A short one."
    two = "".join(f'<div class="page-with-menu"><article><p>The part {i} of it.</p></article></div>' for i in range(2))
    assert html_text.main_text(two) == "The part 0 of it.\nThe part 1 of it."
    deep = '<div class="sidebar">x' * 20_000 + "<article>deep"
    assert html_text.main_text(deep) == "deep"


def test_html_pages(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<article><p>" + "the words of it " * 100_000)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))).collect()
    assert got[0] == got[1] and [(r["page_id"], r["url"], r["n_chars"]) for r in got[2:]] == [(2, None, 0), (None, "v", 0), (3, "w", 1_599_999)]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_test_pages(spark, sf_small):
    """On the test pages the article element is the truth."""
    import html
    import re

    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    for p in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", p["html"], re.DOTALL)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner))
        assert got[p["page_id"]] == "\n".join(x for x in parts if x)


@pytest.mark.parametrize("name", ["search-methods", "social-history", "alert"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_html_sections_keep_their_text(tag, name):
    """A class of a part of the article is no verdict over its prose."""
    lines = [f"It was the best of times and it was the worst of times, said the man who was there for all of it, number {i}." for i in range(6)]
    part = f'<p class="{name}">{lines[3]}</p>' if name == "alert" else f'<section class="{name}"><p>{lines[2]}</p><p>{lines[3]}</p></section>'
    around = lines[:3] if name == "alert" else lines[:2]
    page = f"<{tag}>{''.join(f'<p>{x}</p>' for x in around)}{part}{''.join(f'<p>{x}</p>' for x in lines[4:])}</{tag}>"
    assert html_text.main_text(page) == "\n".join(lines)


def test_html_math():
    assert html_text.main_text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='a'>x=2</annotation></math> hold.</p></article>") == "Let x=2 hold."


def plain_text(page):
    """A second, plain form of the two passes for pages whose only hint is the class ``ad``."""
    from html.parser import HTMLParser

    class Cut(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.blocks, self.now, self.linked, self.boxes = [], [], "", 0, 0

        def flush(self):
            text = " ".join(self.now.split())
            if text:
                tags = [t for t, _, _ in self.open]
                barred = any(t in ("nav", "aside", "footer", "form", "head", "header") or c == "ad" for t, c, _ in self.open)
                box = next((n for t, _, n in reversed(self.open) if t in html_text.BOXES), 0)
                self.blocks.append((text, min(self.linked, len(text)), barred, "article" in tags, any(t[0] == "h" and t[1:].isdigit() for t in tags), box))
            self.now, self.linked = "", 0

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.now += " "
                return
            if tag in html_text.VOID:
                return
            if tag in html_text.BLOCK:
                self.flush()
                if any(t == "p" for t, _, _ in self.open):
                    self.handle_endtag("p")
            if tag == "li" and self.open and self.open[-1][0] == "li":
                self.open.pop()
            self.boxes += 1
            self.open.append((tag, dict(attrs).get("class"), self.boxes))

        def handle_endtag(self, tag):
            if tag in html_text.BLOCK:
                self.flush()
            if any(t == tag for t, _, _ in self.open):
                while self.open.pop()[0] != tag:
                    pass

        def handle_data(self, data):
            tags = [t for t, _, _ in self.open]
            if not set(tags) & {"script", "style", "title"}:
                self.now += data
                self.linked += len(data.strip()) if "a" in tags else 0

    cut = Cut()
    cut.feed(page)
    cut.close()
    cut.flush()
    blocks = cut.blocks

    def density(text):
        words = text.lower().split()
        return len([w for w in words if w.strip(".,;:!?\"'()[]«»…*#%$&|") in html_text.STOP]) / len(words)

    def first(marked):
        labels, low = [], []
        for text, linked, barred, inside, heading, _ in blocks:
            if barred or (marked and not inside) or linked > 0.35 * len(text):
                labels.append("bad")
            elif heading or len(text) < 70:
                labels.append("unsure" if inside and marked or heading or not linked else "bad")
            else:
                s = density(text)
                low.append((s, len(labels)))
                labels.append("good" if s >= 0.2 or s >= 0.1 and len(text) >= 200 else "unsure" if inside and marked or s >= 0.1 or not linked and text.endswith(html_text.SENTENCE) else "bad")
        if low and max(low)[0] < 0.1:
            for _, k in low:
                labels[k] = "good"
        return labels

    marked = any(b[3] for b in blocks)
    if marked:
        inside = sum(len(b[0]) for b in blocks if b[3] and not b[2] and b[1] <= 0.35 * len(b[0]))
        marked = inside >= sum(len(b[0]) for b, x in zip(blocks, first(False), strict=True) if x == "good" and not b[3])
    labels = first(marked)
    if not marked and "good" not in labels:
        some = [(len(blocks[k][0]), -k) for k, x in enumerate(labels) if x == "unsure" and not blocks[k][4] and blocks[k][0].endswith(html_text.SENTENCE)]
        if some:
            labels[-max(some)[1]] = "good"
    final = []
    for k, x in enumerate(labels):
        if x == "unsure":
            some = [j for j, y in enumerate(labels) if y != "unsure" and not (marked and y == "bad" and (blocks[j][2] or not blocks[j][3]))]
            some = [j for j in some if blocks[j][5] == blocks[k][5]] or some
            a, b = max((j for j in some if j < k), default=None), min((j for j in some if j > k), default=None)
            if a is None and b is None:
                x = "good" if marked and blocks[k][3] else "bad"
            elif a is None or b is None or labels[a] == labels[b]:
                x = labels[b if a is None else a]
            elif blocks[k][4]:
                x = labels[b]
            elif k - a != b - k:
                x = labels[a] if k - a < b - k else labels[b]
            else:
                x = "good" if marked and blocks[k][3] or density(blocks[k][0]) >= 0.1 else "bad"
        final.append(x)
    return "\n".join(b[0] for b, x in zip(blocks, final, strict=True) if x == "good")


@pytest.mark.parametrize("tag", ["article", "div", "section"])
def test_html_against_a_plain_form(spark, tag):
    """The registered query's operator on whole test pages, as they are and without their article element."""
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("html", F.regexp_replace("html", "<(/?)article", f"<$1{tag}"))
    found = kept = extra = 0
    for r in html_text.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        assert r["text"] == plain_text(r["html"]), r["page_id"]
        inner = re.search(rf"<{tag}>(.*?)(</{tag}><footer|$)", r["html"], re.DOTALL)[1]
        import html as h

        want = collections.Counter(x for x in (" ".join(h.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner)) if x)
        got = collections.Counter(r["text"].split("\n"))
        found, kept, extra = found + want.total(), kept + (want & got).total(), extra + (got - want).total()
    assert kept >= (1 if tag == "article" else 0.97) * found and extra <= 0.002 * found


# -- 3 ----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_ids_agree_and_round_trip(reference):
    own, rng = bpe.codec(), random.Random(1)
    points = [chr(i) for i in range(0, 0x110000, 5) if not 0xD800 <= i < 0xE000]
    texts = ["a" + x + "b " + x + " c" + x + x + " 1\n " + x for x in points] + ["".join(rng.choice("aaabbct' \n\t1é\x1c\x85") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 5000, "ab" * 3000, " " * 1000, "", "some words of a very long text, 1 2 3 " * 40_000, "<|endoftext|>", "'s're'll"]
    flat, counts = own.encode_block(texts)
    back, sizes = own.decode_block(flat.astype(np.int64), counts)
    at = 0
    for text, n, raw in zip(texts, counts, bpe._cut(back, sizes), strict=True):
        assert flat[at : at + n].tolist() == reference.encode_ordinary(text) and raw == text.encode()
        at += n


def test_bpe_frames(spark, messy, reference):
    for r in bpe.digests(messy).collect():
        text = (MESSY[r["doc_id"]] if r["doc_id"] is not None else PROSE) or ""
        ids = reference.encode_ordinary(text)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    encoded = bpe.encode(messy)
    assert {r["doc_id"]: r["data"].decode() for r in bpe.decode(encoded).collect() if r["doc_id"] is not None} == {i: t or "" for i, t in enumerate(MESSY)}
    assert bpe.digests(messy.limit(0)).count() == 0


def test_bpe_other_vocabulary():
    own = bpe.codec(bpe.vocabulary_path("byte_bpe_multi_50k.tiktoken"))
    flat, counts = own.encode_block(["Ein Text über alles", "漢字"])
    assert own.decode_block(flat.astype(np.int64), counts)[0].tobytes().decode() == "Ein Text über alles漢字"


# -- 4 ----------------------------------------------------------------------------------------------------------------


def labelled(spark, n, seed):
    rng, words = random.Random(seed), [f"w{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        kind = rng.random()
        if kind < 0.2:
            text = [w + "!!" for w in text]
        elif kind < 0.4:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(["badword", "awful,", "Nasty"]))
        rows.append(" ".join(text))
        labels.append((i, int(kind >= 0.2), int(0.2 <= kind < 0.4)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_ordinal_held_out(spark):
    d, labels = labelled(spark, 2500, 3)
    truth = {r["doc_id"]: 0 if not r["quality"] else 1 if r["toxic"] else 2 for r in labels.collect()}
    got = ordinal.classify(d, labels.filter("doc_id < 2000")).filter("doc_id >= 2000").collect()
    assert np.mean([round(r["expected_grade"]) == truth[r["doc_id"]] for r in got]) > 0.95
    assert np.mean([r["kept"] for r in got if truth[r["doc_id"]] == 2]) > 0.95 and np.mean([r["kept"] for r in got if truth[r["doc_id"]] < 2]) < 0.1
    assert all(0 <= r["tail_probability"] <= 1 and r["tail_probability"] <= r["expected_grade"] for r in got)


def test_ordinal_sample_is_bounded_and_thresholds_are_ordered(spark):
    d, labels = labelled(spark, 300, 4)
    rows = ordinal.training_rows(d, labels, sample=100)
    model = ordinal.fit(rows)
    assert len(rows) == 100 and (np.diff(model.thresholds) >= 0).all()
    assert ordinal.training_rows(d.repartition(7), labels, sample=100)[5][0] == rows[5][0]


def test_ordinal_descent_reaches_the_optimum():
    """The penalised descent against plain gradient steps on the same likelihood."""
    rng = np.random.default_rng(6)
    n, m = 5, 3000
    on = rng.random((m, n)) < 0.4
    weights = np.array([2.0, -1.5, 0.7, 0.0, -0.4])
    latent = on @ weights + rng.logistic(size=m)
    grades = (latent > -0.5).astype(int) + (latent > 1.0)
    shares = np.zeros((m, ordinal.SHAPES))

    def loss(w, t):
        f = on @ w
        wide = np.concatenate([[-np.inf], t, [np.inf]])
        return -np.log(ordinal.sigmoid(wide[grades + 1] - f) - ordinal.sigmoid(wide[grades] - f)).mean()

    def slope(x, h=1e-5):
        return np.array([(loss((x + e)[:n], (x + e)[n:]) - loss((x - e)[:n], (x - e)[n:])) / (2 * h) for e in np.eye(len(x)) * h])

    x = np.concatenate([np.zeros(n), [-1.0, 1.0]])
    for _ in range(400):
        x = x - 1.5 * slope(x)
    assert np.abs(slope(x)).max() < 1e-3
    w, _, t = ordinal._descend([np.flatnonzero(row) for row in on], shares, grades, n, 60, 0.0, 0.3)
    assert loss(w, t) - loss(x[:n], x[n:]) < 2e-3 and np.abs(w - x[:n]).max() < 0.15 and np.abs(t - x[n:]).max() < 0.15 and t[0] <= t[1]


def test_ordinal_scores_row_by_row(spark):
    """The registered form of scoring against the formula, a row and a feature at a time."""
    import math
    import zlib as z

    d, labels = labelled(spark, 400, 8)
    model = ordinal.fit(ordinal.training_rows(d, labels))
    assert model.lookup
    for r, s in zip(d.orderBy("doc_id").collect(), ordinal.score(d, model).orderBy("doc_id").collect(), strict=True):
        words = r["text"].split()
        features = set()
        marks = collections.Counter()
        for word in words:
            plain = word.lower().strip(ordinal.PUNCTUATION)
            features |= {z.crc32(f"{k}:{plain[: k or None]}".encode()) % ordinal.DIMENSIONS for k in (0, 4, 5) if k < len(plain)}
            mark = ""
            while len(mark) < 3 and len(mark) < len(word) and word[len(word) - 1 - len(mark)] in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
                mark = word[len(word) - 1 - len(mark) :]
            if mark:
                marks[mark] += 1
        features |= {z.crc32(f"m{(len(words) // c).bit_length()}:{mark}".encode()) % ordinal.DIMENSIONS for mark, c in marks.items()}
        total = sum(model.lookup.get(b, 0.0) for b in features) + float(np.dot(model.marks, ordinal.shape(r["text"].encode(), r["text"].encode().split())))
        tails = [1 / (1 + math.exp(t - total)) for t in model.thresholds]
        assert np.allclose([s["score"], s["expected_grade"], s["tail_probability"]], [total, sum(tails), tails[-1]], atol=1e-9) and s["kept"] == (tails[-1] >= ordinal.LEAST)


def test_ordinal_training_is_bounded_in_bytes(spark):
    long = " ".join(f"word{i}" for i in range(5000))
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    rows = ordinal.training_rows(docs(spark, [long, "short text"]), labels)
    assert len(rows[0][1]) == ordinal.MOST_BUCKETS and ordinal.classify(docs(spark, [long, "short text"]), labels).count() == 2


def test_ordinal_messy(spark, messy):
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (1, 0, 0), (4, None, 1), (None, 1, 1), (5, 0, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    assert ordinal.classify(messy, labels).count() == messy.count()
    assert all(r["kept"] for r in ordinal.classify(messy, labels.limit(0)).collect())
    assert ordinal.classify(messy.limit(0), labels).count() == 0


# -- 5 ----------------------------------------------------------------------------------------------------------------


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_agrees_with_the_plain_loop():
    keys = np.random.default_rng(5).integers(0, 1 << 64, 500, dtype=np.uint64)
    for n in (1, 2, 8, 9, 1000):
        assert sharding.jump(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]


def test_shards(spark, messy):
    d = docs(spark, [f"t{i % 7}" for i in range(4000)])
    rows = sharding.shard(d, block_bits=4).collect()
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows) and 0.08 < np.mean([r["grown_shard"] == 8 for r in rows]) < 0.14
    assert all(r["size"] == 3 and r["text_crc32"] == zlib.crc32(f"t{r['doc_id'] % 7}".encode()) and r["law"] == "key" for r in rows)
    for one in (rows, sharding.shard(messy).collect()):
        slots = collections.defaultdict(list)
        for r in one:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r["doc_id"], r["shard"]) for r in sharding.shard(d.repartition(9), block_bits=2).collect()} == {(r["doc_id"], r["shard"]) for r in rows}
    assert sharding.shard(messy.limit(0)).count() == 0 and len(one) == messy.count()


# -- 6 ----------------------------------------------------------------------------------------------------------------


def brute_lines(pairs, min_chars=20, min_docs=3):
    held = collections.defaultdict(set)
    for i, t in pairs:
        for line in (t or "").split("\n"):
            k = line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
            if len(k) >= min_chars and i is not None:
                held[k].add(i)
    out = []
    for i, t in pairs:
        lines = (t or "").split("\n")
        keys = [x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}) for x in lines]
        left = [x for x, k in zip(lines, keys, strict=True) if i is None or len(held.get(k, ())) < min_docs or i == max(held[k])]
        out.append((i, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return out


def line_texts():
    rng = random.Random(2)
    pool = ["  A line that comes up Again and again ", "a line that comes up again and AGAIN\t", "short", "Ä" * 20, "ä" * 20, "é" * 19, "Another line of some length here", "twice only, this line is", ""]
    return ["\n".join(rng.choice([*pool, f"a unique line of the document {rng.random()}"]) for _ in range(rng.randint(0, 8))) for _ in range(60)]


def test_lines_against_brute_force(spark, messy):
    texts = line_texts()
    assert sorted(tuple(r) for r in line_dedup.digest_report(docs(spark, texts)).collect()) == sorted(brute_lines(list(enumerate(texts))))
    pairs = [(r["doc_id"], r["text"]) for r in messy.collect()]
    assert sorted((tuple(r) for r in line_dedup.digest_report(messy).collect()), key=repr) == sorted(brute_lines(pairs), key=repr)
    assert line_dedup.digest_report(messy.limit(0)).count() == 0
    left = line_dedup.drop_lines(docs(spark, texts))
    assert left.columns == docs(spark, texts).columns and all(r["n_chars"] == len(r["text"]) for r in left.collect())


def test_line_index_takes_back_what_it_took_in(spark, tmp_path):
    texts = line_texts()
    d = docs(spark, texts)
    index = line_dedup.LineIndex(spark, str(tmp_path / "index"))
    index.insert(d.filter("doc_id < 40"))
    before = {(bytes(r["digest"]), r["holders"], r["last"]) for r in index.references().collect()}
    index.insert(d.filter("doc_id >= 40"))
    full = {r["doc_id"]: set(map(bytes, r["drops"])) for r in index.dropped(d).collect()}
    index.delete(d.filter("doc_id >= 40"))
    assert {(bytes(r["digest"]), r["holders"], r["last"]) for r in index.references().collect()} == before
    filters = [line_dedup.CuckooFilter(raw=bytes(r["filter"])) for r in index.filters.collect()]
    assert sum(int((f.table > 0).sum()) + len(f.overflow) for f in filters) == len(before) and all(any(x[0] in f for f in filters) for x in before)
    index.insert(d.filter("doc_id >= 40"))
    assert {r["doc_id"]: set(map(bytes, r["drops"])) for r in index.dropped(d).collect()} == full


def test_line_index_steps(spark, tmp_path):
    """A step counts its own keys only; foreign deletions have no effect; compaction changes nothing."""
    line = "A line of some length that is held by many documents"
    other = "Another line that only some of all the documents hold"
    index = line_dedup.LineIndex(spark, str(tmp_path / "index"))
    index.insert(docs(spark, [line, line, line + "\n" + other, other, other], [1, 2, 3, 4, 5]))
    held = lambda: {(r["holders"], r["last"]) for r in index.references().collect()}
    assert held() == {(3, 3), (3, 5)}
    index.delete(docs(spark, [line, line], [9, None]))
    assert held() == {(3, 3), (3, 5)}
    index.insert(docs(spark, [line], [9]))
    assert held() == {(4, 9), (3, 5)}
    counted = []
    inner, index._counted = index._counted, lambda some: counted.append(some.select("digest").distinct().count()) or inner(some)
    index.insert(docs(spark, [other], [6]))
    assert held() == {(4, 9), (4, 6)} and counted == [1]
    index.delete(docs(spark, [line, other], [3, 6]))
    assert held() == {(3, 9), (3, 5)}  # document 3 still holds the other line
    index.compact()
    assert len(index._paths) == 1 and index.segments().count() == 6 and held() == {(3, 9), (3, 5)}
    index.delete(docs(spark, [line], [9]))
    assert held() == {(3, 5)}
    index.delete(docs(spark, [line, other, line + "\n" + other], [1, 4, 3]))
    assert held() == set() and sum(int((f.table > 0).sum()) for f in (line_dedup.CuckooFilter(raw=bytes(r["filter"])) for r in index.filters.collect())) == 0


def test_cuckoo_filter():
    keys = [line_dedup.digest(b"%d" % i) for i in range(4000)]
    f = line_dedup.CuckooFilter(2000)
    for k in keys[:2000]:
        f.insert(k)
    f = line_dedup.CuckooFilter(raw=f.tobytes())
    assert all(k in f for k in keys[:2000]) and sum(k in f for k in keys[2000:]) < 20
    asked = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, line_dedup.DIGEST)
    assert f.contains_many(asked).tolist() == [k in f for k in keys]
    assert all(f.delete(k) for k in keys[:1000]) and all(k in f for k in keys[1000:2000]) and sum(k in f for k in keys[:1000]) < 10
    tiny = line_dedup.CuckooFilter(1)
    for k in keys[:50]:
        tiny.insert(k)
    assert tiny.overflow and all(k in tiny for k in keys[:50]) and all(tiny.delete(k) for k in keys[:50])


# -- 7 ----------------------------------------------------------------------------------------------------------------


def test_fill_is_the_best_subset():
    rng = random.Random(7)
    for _ in range(60):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(6)}
        room = rng.randint(0, 120)
        sums = {0}
        for n, k in counts.items():
            sums = {s + n * i for s in sums for i in range(k + 1)}
        used = packing.fill(counts, room)
        assert sum(n * k for n, k in used.items()) == max(s for s in sums if s <= room) and all(k <= counts[n] for n, k in used.items())


def test_packing(spark, messy, sf_small):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    special = docs(spark, [end, f"{end}a word", f"some  {end}  words", f"the end {end}", f"{end}{end}", f"a{end}{end} b\n{end}", f"<{end}>", end[:-1], end.upper(), f" {end}'s", f"1{end}2 " * 3000])
    for d in (special, messy, spark.read.parquet(f"{sf_small}/documents.parquet")):
        rows = packing.pack(d, blocks=5).collect()
        texts = [(r["doc_id"], r["text"] or "") for r in d.collect()]
        want = collections.Counter()
        for i, t in texts:
            ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
            for a in range(0, len(ids), 2048):
                part = np.array(ids[a : a + 2048], "<u4")
                want[(i, a, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
        assert collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
        windows = collections.defaultdict(list)
        for r in rows:
            windows[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in windows.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(windows) - 1 <= sum(r["length"] for r in rows) / 2048 * 1.02 + 1
    assert packing.pack(messy.limit(0)).count() == 0


# -- 8 ----------------------------------------------------------------------------------------------------------------


def brute_spans(texts, span=200):
    seen = collections.Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                gone[i : i + span] = True
        runs = int(gone[:1].sum() + np.count_nonzero(gone[1:] & ~gone[:-1]))
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def repeated_texts(n=150):
    rng = random.Random(3)
    words = ["the", "of", "straße", "and", "é", "to", "in", "x", "ab", "longerword"]
    base, out = [" ".join(rng.choice(words) for _ in range(250)) for _ in range(8)], []
    some = lambda k: " ".join(rng.choice(words) for _ in range(rng.randint(0, k)))
    for _ in range(n):
        k, b = rng.random(), rng.choice(base)
        a, p = rng.randrange(len(b) - 260), rng.randrange(len(b))
        out.append(b if k < 0.15 else some(60) + b[a : a + rng.randint(150, 260)] + some(60) if k < 0.6 else b[:p] + "Q" + b[p + 1 :] if k < 0.8 else "a" * rng.randint(0, 700) if k < 0.85 else "abc d" * rng.randint(1, 200) if k < 0.9 else some(200))
    return out


@pytest.mark.parametrize("chunk", [suffix_dedup.CHUNK, 3, 1])
def test_repeats_against_brute_force(spark, chunk):
    """Small chunks force a boundary into every gram."""
    texts = repeated_texts()
    got = [tuple(r)[1:] for r in suffix_dedup.digest_report(docs(spark, texts), chunk).orderBy("doc_id").collect()]
    assert got == brute_spans([t.encode() for t in texts])


@pytest.mark.parametrize("chunk", [suffix_dedup.CHUNK, 5])
def test_repeats_of_a_template(spark, chunk):
    """Many contexts of one gram: a passage with other bytes close before and behind it, and near copies of it."""
    rng = random.Random(9)
    base = bytes(rng.choice(b"abcdefghij ") for _ in range(420)).decode()
    texts = []
    for _ in range(120):
        a = rng.randint(0, 230)
        part = list(base[a : a + rng.randint(160, 240)])
        for _ in range(rng.choice([0, 0, 1, 2])):
            part[rng.randrange(len(part))] = rng.choice("XYZ")
        texts.append("".join(rng.choice("klmn") for _ in range(rng.randint(0, 90))) + "".join(part) + "".join(rng.choice("opqr") for _ in range(rng.randint(0, 90))))
    got = [tuple(r)[1:] for r in suffix_dedup.digest_report(docs(spark, texts), chunk).orderBy("doc_id").collect()]
    assert got == brute_spans([t.encode() for t in texts])


@pytest.mark.parametrize("block", [suffix_dedup.BLOCK, 97])
def test_anchors_stand_for_every_string(block):
    """Each string has its anchor at the same offset wherever it stands, or equals one a period before it."""
    rng = random.Random(11)
    for _ in range(60):
        parts = [rng.choice(["a", "-=", "abc d", "x" * 70 + "y" * 30, "".join(rng.choice("ab") for _ in range(rng.randint(1, 260)))]) * rng.randint(1, 12) for _ in range(rng.randint(1, 6))]
        text = "".join(parts).encode()
        at, h, hi, lo, runs = suffix_dedup.anchors(np.frombuffer(text, np.uint8), block)
        starts = {}
        for a, x, first, last in zip(at.tolist(), h.tolist(), hi.tolist(), lo.tolist(), strict=True):
            for d in range(last, first + 1):
                assert a - d not in starts
                starts[a - d] = (d, x)
        by = {}
        for i in range(len(text) - 199):
            if i in starts:
                assert by.setdefault(text[i : i + 200], starts[i]) == starts[i]
        for i in range(len(text) - 199):
            assert text[i : i + 200] in by
            assert i in starts or any(a <= i and i + 200 <= b for a, b in runs)
        for a, b in runs:
            gone = np.zeros(len(text), bool)
            for i in range(a, b - 199):
                if text.find(text[i : i + 200]) != i or text.find(text[i : i + 200], i + 1) >= 0:
                    gone[i : i + 200] = True
            assert gone[a:b].all()


def test_repeats_of_very_long_texts(spark):
    """50 MB in a row; prose loses nothing but what is planted."""
    rng = np.random.default_rng(12)
    words = np.array(["".join(x) for x in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (5000, 6))])
    prose = " ".join(words[rng.integers(0, 5000, 50_000_000 // 7)].tolist())
    texts = ["-=" * 25_000_000, "a" * 50_000_000, prose + "|" + prose[1000:1300], "-=" * 100, "a" * 201, "a" * 199]
    want = [(len(t), len(t), 1) for t in texts[:2]] + [(len(texts[2]), 600, 2), (200, 200, 1), (201, 201, 1), (199, 0, 0)]
    got = suffix_dedup.digest_report(docs(spark, texts).repartition(6, "doc_id")).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got] == want


def test_repeats_of_rows_that_share_an_id(spark):
    rng = random.Random(13)
    base = "".join(rng.choice("abcdefgh") for _ in range(400))
    other = "".join(rng.choice("abcdefgh") for _ in range(400))
    texts, ids = [base, other, base[50:] + "x", other, base, "u" + other[:250]], [1, 1, 1, None, None, None]
    got = sorted((tuple(r) for r in suffix_dedup.digest_report(docs(spark, texts, ids)).collect()), key=repr)
    assert got == sorted(((i, *w) for i, w in zip(ids, brute_spans([t.encode() for t in texts]), strict=True)), key=repr)


def test_repeats_messy(spark, messy):
    small = messy.filter("doc_id is null or doc_id <> 7")
    rows = small.collect()
    want = sorted(((r["doc_id"], *w) for r, w in zip(rows, brute_spans([(r["text"] or "").encode() for r in rows]), strict=True)), key=repr)
    assert sorted((tuple(r) for r in suffix_dedup.digest_report(small).collect()), key=repr) == want
    assert suffix_dedup.digest_report(messy.filter("doc_id = 7")).first()["n_removed"] == 300_000
    assert suffix_dedup.digest_report(messy.limit(0)).count() == 0
    left = suffix_dedup.remove_repeats(docs(spark, ["ü" * 300, "x" + "ü" * 150 + "tail"]))
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in left.collect()} == {0: ("", 0), 1: ("xtail", 5)}


def test_multikey_order():
    rng = np.random.default_rng(8)
    for _ in range(20):
        n = int(rng.integers(1, 60))
        rows = rng.integers(0, 2, (n, 24), dtype=np.uint8)
        group = np.sort(rng.integers(0, 4, n))
        order, common = suffix_dedup.multikey_order(rows.view(">u8").astype(np.uint64), group)
        keys = [(group[i], rows[i].tobytes()) for i in order]
        assert keys == sorted(keys)
        for k in range(1, n):
            (g, a), (h, b) = keys[k - 1], keys[k]
            assert common[k] == (-1 if g != h else next((i for i in range(24) if a[i] != b[i]), 24))


# -- 9 ----------------------------------------------------------------------------------------------------------------


def brute_quality(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if grams[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    base = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(hit), base


def test_quality_base_counts(spark, messy, sf_small):
    for d in (messy, spark.read.parquet(f"{sf_small}/documents.parquet")):
        want = collections.Counter((r["doc_id"], *brute_quality(r["text"] or "")) for r in d.collect())
        got = quality_rules.judge(d).collect()
        assert collections.Counter(tuple(r)[:7] for r in got) == want and not any(r["base_failed"] and r["kept"] for r in got)
    assert quality_rules.judge(messy.limit(0)).count() == 0


@pytest.mark.parametrize("line, fails", [("Home | News | About | Contact", True), ("A plain sentence that ends.", False), ("no end here", True), ("BUY!! NOW!! OR!! NEVER!!", True), ("We use cookies; accept all cookies to go on.", True), ("One sentence is here. The other one is cut off in the mid", False), ("wor### wor*** wor%%% w.", True), ("<div><p>x</p></div>.", True)])
def test_quality_lines(line, fails):
    assert quality_rules.line_fails(line) == fails


def test_quality_clean(spark, messy, sf_small):
    good = " ".join(f"Sentence number {i} is a good one." for i in range(10))
    left = quality_rules.clean(docs(spark, [good + "\nHome | About | Contact | Help\n", "Home | About | Contact | Help\n" * 20, None])).collect()
    assert [(r["doc_id"], r["text"], r["n_chars"]) for r in left] == [(0, good + "\n", len(good) + 1)]
    assert quality_rules.clean(messy).columns == messy.columns
    d, labels = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "labels"))
    found = quality_rules.judge(d).join(labels, "doc_id").filter("not base_failed or quality = 0")
    assert found.filter("quality = 0 and kept").count() == 0 and found.filter("quality = 1 and not kept").count() <= 1


# -- 10 ---------------------------------------------------------------------------------------------------------------


def brute_links(texts, ids):
    sets = []
    for t in texts:
        w = (t or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n, parent = len(texts), list(range(len(texts)))
    links = [0] * n

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both and both >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[top(i)] = top(j)
    least = {}
    for i in range(n):
        least[top(i)] = min(least.get(top(i), ids[i]), ids[i])
    return {ids[i]: (least[top(i)], links[i]) for i in range(n)}


def near_texts(n=200):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base, out = [[rng.choice(words) for _ in range(rng.randint(60, 200))] for _ in range(6)], []
    for _ in range(n):
        b, k = list(rng.choice(base)), rng.random()
        if 0.3 <= k < 0.8:
            for _ in range(rng.randint(1, 4)):
                b[rng.randrange(len(b))] = f"x{rng.randint(0, 99)}"
        elif k >= 0.8:
            b = b[: rng.randint(0, 6)] if k < 0.9 else [rng.choice(words) for _ in range(50)]
        out.append(" ".join(b))
    return out


@pytest.mark.parametrize("block", [512, 16])
def test_links_against_brute_force(spark, block):
    texts = near_texts()
    ids = [1000 - i for i in range(len(texts))]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.join(docs(spark, texts, ids), block=block).collect()}
    assert got == brute_links(texts, ids)


def test_bands():
    b, r = ngram_join.bands_for(0.8, 0.999)
    assert 1 - (1 - 0.8**r) ** b >= 0.999 and b * r <= ngram_join.MOST_HASHES and ngram_join.bands_for(0.5, 0.9)[1] < r
    with pytest.raises(ValueError, match="more than 256"):
        ngram_join.bands_for(0.01, 0.999)


def test_links_messy(spark, messy):
    got = ngram_join.join(messy).collect()
    assert len(got) == messy.count()
    by = collections.defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["class_id"], r["text_class"]))
    assert by[None] == {(None, None)} and by[1] == {(0, 0)} and by[3] == by[2] == by[4] == {(2, 2)} and by[5] == {(5, 5)}
    assert ngram_join.join(messy.limit(0)).count() == 0
    left = ngram_join.keep_one(messy)
    assert left.columns == messy.columns and sorted((r["doc_id"] for r in left.collect()), key=str) == sorted([0, 2, 5, 6, 7, 8, 9, 10, None], key=str)


def test_keep_one_of_repeated_ids(spark):
    """Rows that share an id but not their text are documents of their own; what stays does not depend on the order of the rows."""
    one, two, three = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, one, "en", "s", 1), (5, two, "en", "s", 2), (5, two + " x", "en", "s", 3), (5, one, "en", "r", 4), (3, one, "en", "s", 5), (7, two, "en", "s", 6), (9, three, "en", "s", 7), (9, three, "en", "t", 8), (None, one, "en", "s", 9)]
    got = [sorted(tuple(r) for r in ngram_join.keep_one(spark.createDataFrame(x, DOCS)).collect() if r["doc_id"]) for x in (rows, rows[::-1])]
    assert got[0] == got[1] and [r[0] for r in got[0]] == [3, 5, 9]
    assert [r[1] for r in got[0]] in ([one, two, three], [one, two + " x", three])



def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["comp"] for r in ngram_join.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_shared_folder(spark):
    from tidemark.llm.common import discard, stored, work_dir

    held = stored(spark.range(3), "numbers")
    assert held.count() == 3 and held.inputFiles()[0].find(work_dir(spark).rsplit("/", 1)[1]) > 0
    discard(spark)
    assert stored(spark.range(2), "numbers").count() == 2
