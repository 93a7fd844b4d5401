"""Main text by composite text density, against a plain version that walks whole subtrees for each figure."""

import math
import random
import time
from html.parser import HTMLParser

import pytest

from quernal.llm import html_text

OUT = {"nav", "footer", "aside", "form", "script"}
BLOCKS = ["div", "section", "p", "ul", "nav", "article", "footer"]


class Tree(HTMLParser):
    """(tag, children) lists of well-formed markup; the library's own parser has no part in it."""

    def __init__(self, page):
        super().__init__()
        self.root = ["body", []]
        self.open = [self.root]
        self.feed(page.removeprefix("<body>").removesuffix("</body>"))

    def handle_starttag(self, tag, attrs):
        self.open[-1][1].append([tag, []])
        self.open.append(self.open[-1][1][-1])

    def handle_endtag(self, tag):
        assert self.open.pop()[0] == tag

    def handle_data(self, data):
        self.open[-1][1].append(data)


def elements(x):
    return [y for c in x[1] if isinstance(c, list) for y in (c, *elements(c))]


def letters(x, links_only=False):
    total, links_only = 0, links_only and x[0] != "a"
    for c in x[1]:
        if isinstance(c, list):
            total += letters(c, links_only)
        elif not links_only:
            total += sum(ch != " " for ch in c)
    return total


def linked(x):
    return [y for y in elements(x) if y[0] == "a"]


def density(x, body):
    c, t, lc, lt = letters(x), max(1, len(elements(x))), letters(x, True), max(1, len(linked(x)))
    if not c:
        return 0.0
    base = math.log(c / max(1, c - lc) * lc + letters(body, True) / letters(body) * c + math.e)
    return c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / math.log(base)


def texts(x):
    """The blocks of a part: every p, li and h2 in it that is not outside."""
    if x[0] in OUT:
        return []
    own = " ".join("".join(flat(x)).split())
    if x[0] in ("p", "li", "h2"):
        return [own] if own else []
    return [y for c in x[1] if isinstance(c, list) for y in texts(c)]


def flat(x):
    return [y for c in x[1] for y in ([c] if isinstance(c, str) else flat(c))]


def plain(page):
    body = Tree(page).root
    inside = lambda x: [x, *(z for c in x[1] if isinstance(c, list) and c[0] not in OUT | {"a"} for z in inside(c))]
    total = lambda x: math.fsum(density(c, body) for c in x[1] if isinstance(c, list) and c[0] not in OUT)
    full = [x for x in inside(body) if letters(x)]
    if not full:
        return []
    best = max(full, key=total)
    path = []  # from the body down to best

    def down(x):
        if x is best or any(isinstance(c, list) and down(c) for c in x[1]):
            path.insert(0, x)
            return True
        return False

    down(body)
    threshold = min(density(x, body) for x in path)
    strict = min((density(x, body) for x in path if x is not body), default=threshold)
    main = next((x for x in path if x[0] == "article"), None)
    marked, out = [main] if main else [], []

    def walk(x, in_main):
        in_main = in_main or x[0] == "article"
        if x[0] in OUT or not letters(x):
            return
        if density(x, body) >= (threshold if in_main or main is None else strict) and not any(x is m for m in marked):
            # Of equal sums the node nearest the root, then the page's beginning, counts.
            marked.append(max([y for y in inside(x)], key=total))
        if any(x is m for m in marked):
            out.extend(texts(x))
        else:
            for c in x[1]:
                if isinstance(c, list):
                    walk(c, in_main)

    walk(body, False)
    return out


def page_of(r, depth=0):
    words = lambda n: " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 9))) for _ in range(n))
    parts = []
    for _ in range(r.randint(1, 5)):
        tag = r.choice(BLOCKS if depth < 3 else ["p", "ul"])
        if tag == "p":
            link = f" <a>{words(r.randint(1, 3))}</a>" if r.random() < 0.3 else ""
            parts.append(f"<p>{words(r.choice([1, 4, 30, 90]))}{link}</p>")
        elif tag == "ul":
            items = "".join(f"<li><a>{words(2)}</a></li>" if r.random() < 0.7 else f"<li>{words(9)}</li>" for _ in range(r.randint(1, 5)))
            parts.append(f"<ul>{items}</ul>")
        else:
            parts.append(f"<{tag}>{page_of(r, depth + 1)}</{tag}>")
    return "".join(parts)


@pytest.mark.parametrize("seed", range(12))
def test_against_plain_version(seed):
    r = random.Random(seed)
    seen = 0
    for _ in range(40):
        page = f"<body>{page_of(r)}</body>"
        body = Tree(page).root
        if html_text.main_parts(html_text.parse(page)) and html_text.main_parts(html_text.parse(page))[0].tag == "body":
            continue  # the whole body, less lists of links: the next test's
        got = [x for x in html_text.main_text(page).split("\n\n") if x]
        assert got == plain(page)
        assert letters(body)
        seen += 1
    assert seen > 10


def boilerplate(prose, tag):
    text = [prose(i, 60) for i in range(6)]
    article = f"<{tag}><h2>A title</h2>" + "".join(f"<p>{x}</p>" for x in text) + f"</{tag}>"
    menu = "<div>" + "".join(f"<span><a href={i}>{prose(50 + i, 2)}</a></span>" for i in range(12)) + "</div>"
    return f"<body>{menu}<div class='ad'>Buy it now, it is cheap</div>{article}<div>by <a href=1>A. Nonymous</a></div></body>", ["A title", *text]


@pytest.mark.parametrize("tag", ["article", "div"])
@pytest.mark.parametrize("constant", [0.0, 1.0])
def test_density_decides(prose, tag, constant, monkeypatch):
    page, want = boilerplate(prose, tag)
    assert html_text.main_text(page).split("\n\n") == want
    monkeypatch.setattr(html_text, "_density", lambda x, body: constant)
    assert html_text.main_text(page).split("\n\n") != want


def test_names_are_evidence_only(prose):
    text = [prose(i, 40) for i in range(4)]
    held = "".join(f"<p>{x}</p>" for x in text)
    for name in ("widget-body", "top", "ad", "sidebar", "comments"):
        for key in ("class", "id"):
            assert html_text.main_text(f"<body><div {key}='{name}'>{held}</div></body>").split("\n\n") == text, name
    got = html_text.main_text(f"<body><article>{held}<p class='related-work'>{prose(9, 12)}</p></article></body>")
    assert got.split("\n\n") == [*text, prose(9, 12)]


@pytest.mark.parametrize("markup", ["<div></b>", "<b><hr>", "<p><object><b><hr>", "<li><div>", "<table><tr><td>", "<b></i>"])
def test_time_is_linear(markup):
    took = []
    for n in (20_000, 100_000):
        began = time.perf_counter()
        html_text.main_text(markup * n + "text")
        took.append(time.perf_counter() - began)
    assert took[1] < 25 * took[0] + 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, text string, ID int")
    assert html_text.extract(empty).columns == ["id", "url", "text"] and html_text.extract(empty).count() == 0
