"""What the entropies of a host's pages decide, and the pages' text."""

import math
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest

from tidemark.llm import style_tree


def texts(spark, pages):
    frame = spark.createDataFrame([(k, "http://s.example/", html) for k, html in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in style_tree.main_text(frame).orderBy("page_id").collect()]


def words(k):
    return " ".join(f"word{k}x{j}" for j in range(20))


def test_copies_keep_their_text(spark):
    page = "<html><body><div class=b><p>{}</p></div><footer>page {}</footer></body></html>"
    for copies in (2, 3, 40):
        assert texts(spark, [page.format(words(0), k) for k in range(copies)] + [page.format(words(k), k) for k in range(1, 4)]) == [words(0)] * copies + [words(1), words(2), words(3)]
    assert texts(spark, [page.format(words(0), 0)] * 3) == [words(0)] * 3


def test_alike_blocks_go_among_distinct_pages(spark):
    page = "<body><div class=a>The same promise everywhere</div><div class=b><p>{}</p></div></body>"
    assert texts(spark, [page.format(words(k // 2)) for k in range(6)]) == [words(k // 2) for k in range(6)]
    lists = "<body><div class=a><b>same</b></div><div class=a><b>same</b></div><div class=a><b>same</b></div></body>"
    assert texts(spark, [lists]) == ["same\n\nsame\n\nsame"]


def test_alike_blocks_in_articles_go(spark):
    page = "<body><article><h1>Title {0}</h1><div class=intro>Subscribe <b>now</b></div><p>{1} <b>Note</b></p><div class=bio><p>By the staff</p></div></article></body>"
    assert texts(spark, [page.format(k, words(k)) for k in range(5)]) == [f"Title {k}\n\n{words(k)} Note" for k in range(5)]
    # copies and hosts of two pages bring nothing down, and a unique block on a path of alike ones stays
    assert texts(spark, [page.format(0, words(0))] * 9) == [f"Title 0\n\nSubscribe now\n\n{words(0)} Note\n\nBy the staff"] * 9
    last = page.format(9, words(9)).replace("By the staff", "By a guest")
    got = texts(spark, [page.format(k, words(k)) for k in range(9)] + [last])
    assert got[0] == f"Title 0\n\n{words(0)} Note" and got[9] == f"Title 9\n\n{words(9)} Note\n\nBy a guest"


TEXT = {"kept": "<article><h1>A</h1><p>one <math><mi>x</mi></math> and <svg><text>drawn</text></svg> two</p><object><p>instead</p></object><p>end</p></article>"}


def test_no_text_of_the_article_is_lost():
    get = style_tree.extract
    assert get(TEXT["kept"]) == "A\n\none x and drawn two\n\ninstead\n\nend"
    for tag in ("svg", "math", "object", "video", "audio", "canvas"):
        assert get(f"<article><p>one</p><{tag}><p>two</p></article><footer>f</footer>") == "one\n\ntwo"
    for tag in ("textarea", "title", "iframe", "noscript", "select", "template"):
        assert get(f"<article><p>one</p><{tag}></article><article><p>two</p></article>").endswith("two"), tag
    assert get("<article><p>one</p><script>var a = '<p>no</p>'") == "one"
    assert get("<article><p>one</p><select><option>a</select><noscript>on?</noscript><xmp>a < b</xmp></article>") == "one\n\na < b"


def tree(html):
    """A page's elements by a parser of its own: path, signatures of the blocks in it, text, whether in an article."""

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.all = [], []

        def handle_starttag(self, tag, attrs):
            sign = " ".join([tag, *dict(attrs).get("class", "").split()])
            node = {"path": (*(self.open[-1]["path"] if self.open else ()), sign), "tag": tag, "below": [], "text": [], "main": tag == "article" or bool(self.open and self.open[-1]["main"])}
            if self.open and tag in style_tree.BLOCKS:
                self.open[-1]["below"].append(sign)
            self.open.append(node)
            self.all.append(node)

        def handle_endtag(self, tag):
            self.open.pop()

        def handle_data(self, data):
            for node in self.open:
                node["text"].append(data)

    reader = Reader()
    reader.feed(html)
    return reader.all


def test_entropies_against_brute_force(spark):
    pages = [f"<html><body><div class='top x{k % 3}'><ul>{'<li>a</li>' * (1 + k % 2)}</ul></div><article><h1>Title {k}</h1><div class=bio><p>{'staff' if k % 4 else 'guest'}</p></div><p>text {k // 2}</p></article><div class=low>same</div></body></html>" for k in range(12)]
    layouts, contents, mains, on = defaultdict(Counter), defaultdict(Counter), {}, defaultdict(Counter)
    for html in pages:
        seen = {(n["path"], tuple(n["below"]), "".join(n["text"]), n["main"]) for n in tree(html) if n["tag"] in style_tree.BLOCKS - {"html", "body"}}
        for path, below, _, main in {(p, b, 0, m) for p, b, _, m in seen}:
            mains[path] = main
            if not main:
                layouts[path][below] += 1
        for path, text in {(p, t) for p, _, t, _ in seen}:
            contents[path][text] += 1
        for path in {p for p, *_ in seen}:
            on[path]["pages"] += 1

    def entropy(counts):
        n = sum(counts.values())
        return -sum(c / n * math.log(c / n) for c in counts.values()) / math.log(n) if n > 1 else 1.0

    want = sorted((on[p]["pages"], mains[p], round(entropy(layouts[p]), 6) if layouts[p] else 0.0, round(entropy(contents[p]), 6)) for p in contents if on[p]["pages"] >= style_tree.MIN_PAGES)
    frame = spark.createDataFrame([("h", html) for html in pages], "host string, html string")
    rows = style_tree.style_tree(frame).collect()
    assert sorted((r["pages"], r["main"], round(r["presentation"], 6) + 0.0, round(r["content"], 6) + 0.0) for r in rows) == want
    recurring = sorted(v["k"] for r in rows for v in r["own"] or () if r["main"])
    assert recurring == [] and all(v["k"] > 1 for r in rows for v in r["own"] or ())


def off(pages):
    return [style_tree.extract(html) for html in pages]


def test_entropies_decide_inside_and_outside_of_articles(spark):
    """With the entropies off other texts come out: blocks go from articles, and stay outside of them."""
    items = lambda k: "".join(f"<p>{words(100 * k + j)}</p>" for j in range(1 + k % 2))
    page = "<body><div class=lead>{2}</div><div class=box><p>All rights</p></div><article><h1>T{0}</h1><p>{1}</p><div class=bio>By the staff</div></article><div class=tags>{2}</div><div class=comments>{2}</div></body>"
    pages = [page.format(k, words(k), items(k)) for k in range(30)]
    # two layouts: the branch outside goes; without entropies the alike block in the article stays
    few = texts(spark, pages)
    assert few == [f"T{k}\n\n{words(k)}" for k in range(30)]
    assert off(pages) == [f"T{k}\n\n{words(k)}\n\nBy the staff" for k in range(30)]
    # a layout and content of its own on every page: the branch before the article stays, and so does an ambiguous name's; never comments
    rich = [page.format(k, words(k), "".join(f"<{'p' if k >> j & 1 else 'h2'}>{words(100 * k + j)}</{'p' if k >> j & 1 else 'h2'}>" for j in range(5))) for k in range(30)]
    body = lambda k: "\n\n".join(words(100 * k + j) for j in range(5))
    assert texts(spark, rich) == [f"{body(k)}\n\nT{k}\n\n{words(k)}\n\n{body(k)}" for k in range(30)]


@pytest.mark.parametrize("most", [100_000, 0])
def test_known_paths_come_by_broadcast_or_join(spark, monkeypatch, most):
    monkeypatch.setattr(style_tree, "BROADCAST_PATHS", most)
    page = "<body><article><h1>Title {0}</h1><p>{1}</p><div class=bio><p>By the staff</p></div></article></body>"
    assert texts(spark, [page.format(k, words(k)) for k in range(6)]) == [f"Title {k}\n\n{words(k)}" for k in range(6)]
