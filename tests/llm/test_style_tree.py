import math
from collections import defaultdict
from html.parser import HTMLParser

from sonde.llm import style_tree as T

BLOCKS = {"div", "p", "nav", "ul", "li", "h1", "footer", "title", "head", "body", "html"}


class Plain(HTMLParser):
    """Nested lists [look, child, ...] of a well-formed page, by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = ["#"]
        self.stack = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag + "".join(f".{v}" for k, v in attrs if k in ("class", "id"))]
        self.stack[-1].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        if data.strip():
            self.stack[-1].append(" ".join(data.split()) if data == data.strip() else data)


def brute(pages, threshold=0.4, gamma=0.9):
    """Importances by path, and every page's lines: nested recursion over paths, one host, without the operator's parser."""
    seen, styles, feats = defaultdict(int), defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(list))

    def visit(path, node):
        seen[path] += 1
        kids = [c for c in node[1:] if isinstance(c, list)]
        style = tuple(c[0] if isinstance(c, list) else "#text" for c in node[1:])
        styles[path][style] += 1
        own = defaultdict(int)
        for c in node[1:]:
            if isinstance(c, str):
                own[c.strip().lower()] += 1
        for f, n in own.items():
            feats[path][f].append(n)
        for i, c in enumerate(kids):
            visit((*path, style, i, c[0]), c)

    roots = [Plain(p).root for p in pages]
    for r in roots:
        visit(("#",), r)

    def imp(path):
        """importance and the greatest importance at or below a node"""
        m = seen[path]
        if m == 1:
            return 1.0, 1.0
        hs = [min(1.0, -sum(c / sum(cs) * math.log(c / sum(cs)) for c in cs) / math.log(m)) for cs in feats[path].values()]
        content = 1 - sum(hs) / len(hs) if hs else None
        own, inner, top = 0.0, 0.0, content or 0.0
        for style, n in styles[path].items():
            looks = [x for x in style if x != "#text"]
            below = [imp((*path, style, i, look)) for i, look in enumerate(looks)]
            top = max([top, *(t for _, t in below)])
            vals = [v for v, _ in below] + ([content] if content is not None else [])
            own -= n / m * math.log(n / m) / math.log(m)
            inner += n / m * (sum(vals) / len(vals) if vals else 0.0)
        if all(x == "#text" for style in styles[path] for x in style):
            return content or 0.0, top
        w = gamma ** len(styles[path])
        v = (1 - w) * own + w * inner
        return v, max(v, top)

    values = {path: imp(path) for path in seen}

    def text(path, node):
        """pieces of text, None where a line ends"""
        tag = node[0].split(".")[0]
        if values[path][1] < threshold and tag in BLOCKS - {"head", "body", "html"}:
            return [None]
        style = tuple(c[0] if isinstance(c, list) else "#text" for c in node[1:])
        out, i = [], 0
        for c in node[1:]:
            if isinstance(c, list):
                out += text((*path, style, i, c[0]), c)
                i += 1
            else:
                out.append(c)
        return [None, *out, None] if tag in BLOCKS or tag == "#" else out

    def lines(pieces):
        out = [""]
        for x in pieces:
            if x is None:
                out.append("")
            else:
                out[-1] += x
        return "\n".join(" ".join(x.split()) for x in out if x.strip())

    return {p: v for p, v in values.items() if seen[p] > 1}, [lines(text(("#",), r)) for r in roots]


def page(i, paragraphs):
    body = "".join(f"<p>para {i} {k} <b>bold</b></p>" for k in range(paragraphs))
    return f"<html><head><title>t{i}</title></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About</a></li></ul></nav><div class=main><h1>Head {i}</h1>{body}<div><p>Read also</p><p>Share &amp; print</p></div></div><footer>All rights</footer></body></html>"


def wrapped(i, k):
    return f"<html><body><nav>Home</nav>{'<div class=w>' * k}<p>Unique words of {i}</p><p>Share</p>{'</div>' * k}</body></html>"


def rows():
    return [(i, f"http://site.example.com/{i}", page(i, 1 + i % 4)) for i in range(24)] + [(100, "http://few.example.com/1", page(1, 2)), (101, "http://few.example.com/2", page(2, 2))]


def test_importance_and_text_equal_brute_force(spark):
    pages = [p for _, u, p in rows() if "site" in u] + [wrapped(i, 5) for i in range(6)]
    df = spark.createDataFrame([("h", p) for p in pages], "host string, html string").repartition(5)
    want, texts = brute(pages)
    for deep in (T.DEEP, 3, 1):  # level by level, and deep branches in one go
        got = T.importance(df, 5, 0.9, deep).collect()
        assert len({r.e for r in got}) == len(got) == len(want)
        for k, v in (("importance", 0), ("top", 1)):
            assert all(abs(a - b) < 1e-9 for a, b in zip(sorted(r[k] for r in got), sorted(x[v] for x in want.values()), strict=True))
    full = spark.createDataFrame([(i, "http://h/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    for most in (10**6, 0):
        assert [r.text for r in T.extract(full, most=most).orderBy("page_id").collect()] == texts


def test_an_article_below_uniform_wrappers_stays(spark):
    df = spark.createDataFrame([(100 * k + i, f"http://k{k}.example.com/{i}", wrapped(i, k)) for k in (1, 2, 3, 4, 6, 8, 12) for i in range(8)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in T.extract(df).collect()}
    assert len(got) == 56 and all(t == f"Unique words of {i % 100}" for i, t in got.items())


def test_extract(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows()], "page_id long, url string, html string, host string, e int")
    for most in (10**6, 0):
        got = {r.page_id: r for r in T.extract(df, most=most).collect()}
        t = got[5].text.split("\n")
        assert "Head 5" in t and "para 5 0 bold" in t and "Home" not in t and "All rights" not in t and got[5].n_removed >= 2
        assert "Home" in got[100].text and got[100].n_removed == 0


def test_edges(spark):
    bad = "<p>a<p>b<div><<<x </b></table>&amp; <b>c" + "<div>" * 5000 + "deep"
    df = spark.createDataFrame([(1, None, None), (2, "", ""), (3, "http://x.y/", bad), (None, "http://x.y/", "t " * 300000), (3, "http://x.y/", bad)], "page_id long, url string, html string")
    got = T.extract(df).collect()
    assert len(got) == 5 and {r.text for r in got if r.page_id in (1, 2)} == {""}
    texts = [r.text for r in got if r.page_id == 3]
    assert texts[0] == texts[1] and texts[0].startswith("a\nb") and texts[0].endswith("deep") and "& " in texts[0]
    assert T.extract(df.limit(0)).count() == 0
    copies = spark.createDataFrame([(i, "http://x.y/", bad) for i in range(6)], df.schema)
    assert {r.text for r in T.extract(copies).collect()} != {texts[0]}  # what all pages share goes, at any depth


def test_parse():
    r = T.parse("<ul><li>a<li><a class='x y'>b</a></ul><!-- <p> --><br>z")
    assert [c.look if isinstance(c, T.Node) else c for c in r.children] == ["ul", "br", "z"]
    assert [c.children[0] if isinstance(c.children[0], str) else c.children[0].look for c in r.children[0].children] == ["a", "a.x y"]
