import random
from collections import Counter
from html.parser import HTMLParser

from hopscope.llm import html_text

PROSE = "It was the first of the days that we had in the town and the weather had been as good as it is in the south for most of the year."


def test_article_without_its_surroundings():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a = "</p><p>no";</script></head><body class="no-sidebar">
    <header><h2>Site name</h2></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
    <div class="cookie-notice">We use cookies of all kinds, and that is that.</div>
    <article class="post with-comments"><header><h1>Head &amp;&nbsp;line</h1></header><p>One<b>two</b>\n three<br>four<p>Short.
    <div class="ad-slot">Buy <a href="x">now</a></div><form><p>Name</p><input></form><!-- hidden <p>x</p> -->
    <ul><li>first <a href="z">link</a> in a list<li>second</ul><pre>a  b</pre>
    <p>5 < 6 &lt; 7 &#x41;&unknown;</p><aside>An aside.</aside><section id="comments"><article class="comment"><p>{PROSE}</p></article></section></article>
    <footer>&copy; x</footer><script>tail"""
    want = ["Head & line", "Onetwo three four", "Short.", "first link in a list", "second", "a b", "5 < 6 < 7 A&unknown;"]
    assert html_text.main_text(page).split("\n\n") == want


def test_two_passes_without_an_article():
    page = f"<body><div>Log in</div><div><a href=1>one</a> | <a href=2>two</a></div><h2>Title</h2><p>{PROSE}</p><p>Yes.</p><p>{PROSE}</p><div>Terms</div><div><a href=3>about</a></div>"
    assert html_text.main_text(page).split("\n\n") == ["Title", PROSE, "Yes.", PROSE]


def test_odd_pages():
    for page in (None, "", "<", "<p", "<!-- x", "<script>", "<a href='", "</p></div>", "<br><br>", "<![CDATA[x"):
        assert html_text.main_text(page) == ""
    deep = "<div>" * 3000 + f"<p>{PROSE}</p>"
    assert html_text.main_text(deep) == PROSE
    assert html_text.main_text("<article>" + "<p>word</p>" * 50_000 + "</article>").count("word") == 50_000


def test_rows_and_clashing_columns(spark):
    rows = [(1, "u", "<article><p>é x</p></article>", "old"), (1, "u", "<article><p>é x</p></article>", "old"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract(pages).collect())
    assert got == [(0, "", 0), (1, "é x", 3), (1, "é x", 3)]
    assert html_text.extract(pages.limit(0)).count() == 0


class Blocks(HTMLParser):
    """A second reader of simple pages: (text, characters in links, where) of each block, by the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.parts, self.links, self.inside, self.link = [], [], 0, [], False

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.found.append((text, self.links, list(self.inside)))
        self.parts, self.links = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.link = True
        elif tag not in ("b", "i"):
            self.flush()
            self.inside.append(tag)

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = False
        elif tag not in ("b", "i"):
            self.flush()
            self.inside.pop()

    def handle_data(self, data):
        self.parts.append(data)
        if self.link:
            self.links += len(" ".join(data.split()))


def second(page):
    """The rules once more, block by block: what is decided by density, and what by the nearest decided block."""
    reader = Blocks()
    reader.feed(page)
    reader.flush()
    first = []
    for text, links, inside in reader.found:
        words = [w.strip(".,").lower() for w in text.split()]
        stops = sum(w in html_text.STOP_WORDS for w in words) / len(words)
        if links / len(text) > 0.33:
            first.append(False)
        elif inside[-1] in ("h1", "h2") or len(text) < 70:
            first.append(False if links else None)
        else:
            first.append(True if stops >= 0.2 else None if stops >= 0.1 else False)
    out = []
    for k, (text, _, inside) in enumerate(reader.found):
        label = first[k]
        if label is None:
            decided = [j for j, x in enumerate(first) if x is not None]
            if inside[-1] in ("h1", "h2") and any(j > k for j in decided):
                label = first[min(j for j in decided if j > k)]
            elif decided:
                near = min(abs(j - k) for j in decided)
                label = all(first[j] for j in decided if abs(j - k) == near)
            else:
                label = any(c.isalnum() for c in text)
        if label:
            out.append(text)
    return out, first


def unmarked(rng):
    """A page without any marks: paragraphs, headings, lists of links and short lines in any order."""
    stops, other = sorted(html_text.STOP_WORDS), ["zorp", "quix", "blarg", "fnord", "mumble", "&amp;", "caf&eacute;"]
    draw = lambda n, share: " ".join(rng.choice(stops) if rng.random() < share else rng.choice(other) for _ in range(n))
    out = []
    for _ in range(rng.randint(1, 25)):
        kind = rng.randrange(6)
        if kind == 0:
            out.append("<ul>" + "".join(f'<li><a href="/{k}">{draw(rng.randint(1, 20), 0.3)}</a></li>' for k in range(rng.randint(1, 5))) + "</ul>")
        elif kind == 1:
            out.append(f"<h2>{draw(rng.randint(1, 12), 0.3)}</h2>")
        elif kind == 2:
            out.append(f"<p>{draw(rng.randint(1, 6), 0.3)}</p>")
        else:
            link = f' <a href="x">{draw(rng.randint(1, 12), 0.3)}</a>' if rng.random() < 0.4 else ""
            out.append(f"<div>{draw(rng.randint(14, 60), rng.choice([0, 0.12, 0.5]))}{link}</div>")
    return "<html><body>" + "".join(out) + "</body></html>"


def test_rules_match_a_second_implementation():
    rng, seen = random.Random(4), Counter()
    for _ in range(400):
        page = unmarked(rng)
        want, first = second(page)
        assert [t for t in html_text.main_text(page).split("\n\n") if t] == want
        seen.update(first)
    assert min(seen.values()) > 500 and set(seen) == {True, False, None}


def test_articles_of_generated_pages():
    """The article of pages with surroundings of all kinds, by the generator's own truth."""
    rng = random.Random(6)
    prose = lambda n: " ".join(rng.choice("the of and to in is it that for zorp quix blarg".split()) for _ in range(n))
    for _ in range(200):
        body = [f"h {prose(3)}", *[prose(rng.choice([1, 4, 30, 90])) for _ in range(rng.randint(1, 8))]]
        surroundings = [
            f"<nav><a href=1>{prose(2)}</a></nav>", f"<header>{prose(20)}</header>", f"<aside>{prose(40)}</aside>", f"<form><p>{prose(30)}</p></form>",
            f"<div class='ad'>{prose(20)}</div>", f"<div role='alert'>{prose(25)}</div>", f"<section id='comments'><p>{prose(40)}</p><p>{prose(2)}</p></section>",
        ]
        around = [rng.choice(surroundings) for _ in range(rng.randint(0, 6))]
        cut = rng.randint(0, len(around))
        page = "<body>" + "".join(around[:cut]) + f"<article><h1>{body[0]}</h1>" + "".join(f"<p>{p}" for p in body[1:]) + "</article>" + "".join(around[cut:]) + f"<footer>{prose(30)}</footer>"
        assert html_text.main_text(page).split("\n\n") == body
