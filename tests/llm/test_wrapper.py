"""Main text of pages: planted layouts, a second parser on the given pages, alignment of token streams, edge rows."""

import random
from html.parser import HTMLParser

import pytest

from tapeloom.llm import wrapper
from tapeloom.llm.markup import CLOSE, OPEN, TEXT, stream
from tapeloom.llm.wrapper import Node, Slots, align, extracted, one_page, plan, wrappers

SMALL = "/root/testdata/sf0.001"
SCHEMA = "page_id bigint, url string, html string, host string, text string, slots string, task bigint"


@pytest.fixture
def pages_of(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "h", "t", "s", 9) for r in rows], SCHEMA).repartition(3)

    return make


class Article(HTMLParser):
    """Blocks inside <article>, read by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks, self.raw = False, [""], False

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.raw = tag in ("script", "style")
        if tag == "br":
            self.blocks[-1] += " "
        elif tag not in ("b", "a"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self.raw = False
        if tag not in ("b", "a"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside and not self.raw:
            self.blocks[-1] += data


def by_parser(page):
    parser = Article()
    parser.feed(page)
    parser.close()
    return "\n".join(b for b in (" ".join(b.split()) for b in parser.blocks) if b)


def test_given_pages_by_another_parser(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    want = {(r.page_id, r.url, by_parser(r.html)) for r in pages.collect()}
    got = extracted(pages).collect()
    assert {(r.page_id, r.url, r.text) for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


WORDS = [f"w{k}" for k in range(300)]


def prose(rng, n=30):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def framed(rng, k, body):
    """A page of one host: what a reader sees besides the article differs from page to page."""
    side = "".join(f"<li><a href='/{rng.random()}'>{prose(rng, 3)}</a></li>" for _ in range(rng.randint(2, 6)))
    return (
        f"<!doctype html><html><head><title>{prose(rng, 4)}</title><script>if (a < b) x('</p><article>')</script></head><body class='home page-{k}'>"
        f"<header class=top><h1>Daily {k}</h1><nav><ul>{side}</ul></nav></header><div class='cookie-notice'>{prose(rng)}</div>"
        f"<div id=wrap><aside>{prose(rng)}</aside>{body}<div class='sidebar'><p>{prose(rng)}</p></div></div>"
        f"<form><label>Search</label> all <input name=q></form><footer><p>&copy; {prose(rng)}</p></footer></body></html>"
    )


def article(rng, parts):
    out, texts = [], []
    for _ in range(parts):
        text = prose(rng, rng.randint(1, 40))
        kind = rng.choice(["p", "p", "h2", "li", "quote"])
        texts.append(text)
        head, _, tail = text.partition(" ")
        inner = f"<b>{head}</b>  \n&#32;{tail}" if tail else f"<i>{head}"
        out.append({"li": f"<ul><li>{inner}</ul>", "quote": f"<blockquote><p>{inner}</blockquote>"}.get(kind, f"<{kind}>{inner}</{kind}>"))
    return "".join(out), texts


@pytest.mark.parametrize("frame", ["<article>{}<div class=comments><p>nice</p></div></article>", "<main class=x>{}</main>", "<div class='post-body c1'>{}</div>", "<div class=c7>{}</div>"])
def test_planted_layouts(pages_of, frame):
    rng = random.Random(len(frame))
    rows, want = [], {}
    for k in range(24):
        body, texts = article(rng, rng.randint(3, 12))
        rows.append((k, f"http://site.example/{k}", framed(rng, k, frame.format(body))))
        want[k] = "\n".join(texts)
    assert {r.page_id: r.text for r in extracted(pages_of(rows)).collect()} == want


def test_same_texts_of_a_host_without_landmarks_are_no_article(pages_of):
    rng = random.Random(3)
    texts = [prose(rng) for _ in range(6)]
    rows = [(k, "http://x/", f"<div><h4>Welcome to all our readers today</h4><p>{t}</p></div>") for k, t in enumerate(texts)]
    assert {r.page_id: r.text for r in extracted(pages_of(rows)).collect()} == dict(enumerate(texts))


def test_articles_alike_on_one_host_are_kept(pages_of):
    page = "<nav>menu</nav><article><h1>One</h1><p>Two three</p></article>"
    got = extracted(pages_of([(k, "http://x/", page) for k in (1, 1, 2)])).collect()
    assert [r.text for r in got] == ["One\nTwo three"] * 3 and [r.n_chars for r in got] == [13] * 3


CASES = [
    ("<article><p><b>One<br><p>Two&amp;&ampx &am</article><footer>no", "One\nTwo&&x &am"),
    ("<article><header><h1>T</h1><p>by</p></header>a<p>b</p>c<!-- no --><aside>no</aside> d</article>", "T\na\nb\nc\nd"),
    ("<article><p>a &lt;b&gt; 1 < 2</p><script>x</script><svg><text>no</text></svg><style>p{}</style></article>", "a <b> 1 < 2"),
    ("<nav><ul><li>menu<article><p>left open menu</p>", "left open menu"),
    ("<form action=x><div><article><p>page in a form</p></article></div></form>", "page in a form"),
    ("<article><p>story</p><article><p>a reader's comment</p></article></article>", "story"),
    ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\nb\nc"),
    ("<article><p title='>'>kept</p><p hidden>no</p><p class=ad-box>no</p><div class='with-sidebar'>yes</div></article>", "kept\nyes"),
    ("just   text", "just text"),
    ("<article><p>end is <a href='cut", "end is"),
    ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after</p></article>", "deep\nafter"),
    ("<article><p>" + "long " * 200_000 + "</p></article>", " ".join(["long"] * 200_000)),
    (None, ""),
    ("", ""),
    (" \n ", ""),
    ("<nav>only a menu</nav>", ""),
]


def test_single_pages(pages_of):
    rows = [(k, f"https://h{k}.example/?x", page) for k, (page, _) in enumerate(CASES)]
    assert {r.page_id: r.text for r in extracted(pages_of(rows)).collect()} == {k: t for k, (_, t) in enumerate(CASES)}


def test_edge_rows(pages_of):
    page = "<article>x</article>"
    rows = [(None, None, page), (None, None, page), (1, "no host", None), (2, "HTTP://A?b", page), (2, "http://a#c", page), (3, "", "")]
    got = extracted(pages_of(rows))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(
        map(str, [(i, u, "x" if h else "", 1 if h else 0) for i, u, h in rows])
    )
    assert {r.host: r.pages for r in wrappers(pages_of(rows)).collect()} == {"": 4, "a": 2}
    assert extracted(pages_of([])).count() == 0 and wrappers(pages_of([])).count() == 0


def test_more_tasks_and_shuffled_wrappers_give_the_same(spark, pages_of, monkeypatch):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    once = sorted(map(tuple, extracted(pages).collect()))
    monkeypatch.setattr(wrapper, "SENT", 0)
    assert sorted(map(tuple, extracted(pages.repartition(17)).collect())) == once


def made(page):
    return one_page(stream(page))


def test_mismatches_become_optional_repeated_and_slots():
    one, two = made("<div><h2>A</h2><p>x</p></div>"), made("<div><p>y</p><p>z</p><ul><li>q</li></ul></div>")
    align(one, two)
    assert one.expression() == "<page><div>(<h2>#same</>)? <p>#text</>+ (<ul><li>#same</></>)?</></>"
    assert made("<h2>a</h2><p>b</p><h2>c</h2><p>d</p><hr>").expression() == "<page>((<h2>#text</>+)? (<p>#text</>+)?)+</>"


def matches(node, tokens):
    """Brute force: whether a wrapper matches a balanced token stream."""
    children, depth, start = [], 0, None
    for k, t in enumerate(tokens):
        if depth == 0 and t[0] == TEXT:
            children.append(("#", []))
        elif t[0] == OPEN:
            start = k if depth == 0 else start
            depth += 1
        elif t[0] == CLOSE:
            depth -= 1
            if depth == 0:
                children.append((t[1], tokens[start + 1 : k]))
    at = 0
    for group in node.groups:
        known = {m.key: m for m in group}
        seen = 0
        while at < len(children) and children[at][0] in known and (len(group) > 1 or group[0].rep or not seen):
            key, inner = children[at]
            if key != "#" and not matches(known[key], inner):
                return False
            at, seen = at + 1, seen + 1
        if not seen and len(group) == 1 and group[0].held == node.n:
            return False
    return at == len(children)


def test_wrappers_match_every_page_in_any_order():
    rng = random.Random(5)
    for _ in range(60):
        def tree(depth):
            parts = []
            for _ in range(rng.randint(0, 5)):
                tag = rng.choice(["div", "ul", "section"])
                parts.append(f"<{tag}>{tree(depth - 1)}</{tag}>" if depth and rng.random() < 0.6 else f"<p>{rng.choice(WORDS)}</p>")
            return "".join(parts)

        pages = [stream(tree(2)) for _ in range(8)]
        whole = one_page(pages[0])
        for p in pages[1:]:
            align(whole, one_page(p))
        left, right = one_page(pages[0]), one_page(pages[4])
        for k in (1, 2, 3):
            align(left, one_page(pages[k]))
            align(right, one_page(pages[4 + k]))
        align(left, Node.load(right.dump()))
        for w in (whole, left):
            assert w.n == len(pages) and all(matches(w, p) for p in pages)


def test_many_classes_become_one_token():
    node = made("<div class=a>x</div>")
    for k in range(200):
        align(node, made(f"<div class={chr(97 + k % 26)}{chr(97 + k // 26)}>{k}</div><div class=ads-{chr(97 + k % 26)}{chr(97 + k // 26)}>no</div>"))
    assert sum(len(g) for g in node.groups) <= 2 * (wrapper.MANY + 1)
    assert Slots(plan(node)).read(stream("<div class=zb>kept</div><div class=ads-zb>no</div>")) == "kept"
