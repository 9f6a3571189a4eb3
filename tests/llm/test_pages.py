import random
import time

import numpy as np
import pytest

from tessera.llm import html, urls

ARTICLE = """<!DOCTYPE html><html><head><title>Site</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
<header><h2>Site name</h2><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav></header>
<div id="cookie-notice">We use cookies</div><div class="ad banner">Buy now</div>
<main><article><header><h1>A &amp; B &ldquo;title&rdquo;</h1></header>
<p>First   paragraph with <b>bold</b> and <a href="/x">a link</a>&nbsp;here, long enough to count as text of the article.<br>next line
<p>Second, unclosed paragraph that goes on for some time so that its ratio of text to tags is high.
<ul><li>Short item<li>Other item</ul><p>Be.</p>
<form><label>Name</label><input><button>Send</button></form>
<aside><p>Read also something else</p></aside>
<blockquote>Quoted words that belong to the article, too, and run on.</blockquote></article>
<section class="comments"><p>I disagree with every word of this article, says a reader at length, and goes on and on.</p></section></main>
<div class="sidebar"><ul><li><a href="/1">One</a><li><a href="/2">Two</a><li><a href="/3">Three</a></ul></div>
<footer>&copy; 2024 Site</footer></body></html>"""

TEXT = "A & B “title”\nFirst paragraph with bold and a link here, long enough to count as text of the article. next line\nSecond, unclosed paragraph that goes on for some time so that its ratio of text to tags is high.\nShort item\nOther item\nBe.\nQuoted words that belong to the article, too, and run on."


def test_article_alone():
    assert html.main_text(ARTICLE) == TEXT


def test_marks_of_layout_and_of_the_article_itself():
    page = """<body class="no-sidebar"><div class="page has-sidebar"><div class="site-header">Site</div><article class="related-post"><div class="entry-header"><h1>Title</h1></div>
    <p>Words of the article that go on for a while, as they do.</p><div class="adbox">Buy</div><div id="comment-list"><p>Reader words that go on for a while, too.</p></div></article>
    <div class="sidebar">Side</div><div class="site-footer">End</div></div></body>"""
    assert html.main_text(page) == "Title\nWords of the article that go on for a while, as they do."


@pytest.mark.parametrize("page", [None, "", "   ", "<html></html>", "<p", "<![CDATA[x]]>", "<!-- only", "</p></div>", "<script>x"])
def test_odd_pages_give_no_text(page):
    assert html.main_text(page) == ""


def test_plain_text_and_no_landmarks():
    assert html.main_text("just words") == "just words"
    body = "".join(f"<p>Paragraph {k} of the text with a fair number of words in it.</p>" for k in range(5))
    page = f"<body><div class='menu'><a href=1>x</a></div><div>{body}</div></body>"
    assert html.main_text(page).count("\n") == 4


def test_long_page_is_whole():
    words = " ".join(f"word{k}" for k in range(200_000))
    assert html.main_text(f"<article><p>{words}</p><p>end</p></article>") == words + "\nend"


def sentence(rng, low, high):
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "and", "réseau", "straße", "year", "found", "in"]
    return " ".join(rng.choices(words, k=rng.randint(low, high))) + "."


def planted(rng, landmark):
    """A page and its article's text."""
    lines, body = [sentence(rng, 4, 9)], []
    body.append(f"<h1>{lines[0]}</h1>")
    for _ in range(rng.randint(3, 9)):
        kind = rng.randrange(6)
        if kind == 0:
            items = [sentence(rng, 8, 20) for _ in range(3)]
            lines += items
            body.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
        elif kind == 1:
            lines.append(sentence(rng, 3, 6))
            body.append(f"<h2>{lines[-1]}</h2>")
        else:
            text = sentence(rng, 30, 90)
            lines.append(text.replace("and", "& co"))
            body.append("<p>" + text.replace("and", "&amp; <b>co</b>") + ("</p>" if kind > 2 else ""))
    lines.append(sentence(rng, 40, 60))
    body.append(f"<p>{lines[-1]}</p>")
    around = [
        f'<div class="{rng.choice(["ad", "ad-slot", "box", "sponsored promo"])}">{sentence(rng, 4, 9)}</div>',
        f'<div id="cookie-notice">{sentence(rng, 10, 30)}</div>',
        f'<div class="sidebar"><ul>{"".join(f"<li><a href=/x>{sentence(rng, 2, 4)}</a></li>" for _ in range(5))}</ul></div>',
    ]
    rng.shuffle(around)
    after = [
        f'<section class="comments"><h3>3 replies</h3><p>{sentence(rng, 20, 50)}</p><p>{sentence(rng, 20, 50)}</p></section>' if rng.random() < 0.7 else f'<div class="reader-talk"><p>{sentence(rng, 20, 40)}</p></div>',
        f'<form><label>Name</label><input><p>{sentence(rng, 10, 30)}</p></form>',
        f"<footer><p>&copy; {sentence(rng, 5, 30)}</p></footer>",
    ]
    tag = rng.choice(["article", "main"]) if landmark else "div"
    return f"<html><head><title>t</title><style>p {{}}</style></head><body><nav><a href=/>Home</a> <a href=/b>B</a></nav>{''.join(around)}<{tag}>{''.join(body)}</{tag}>{''.join(after)}</body></html>", "\n".join(lines)


def test_planted_pages():
    rng = random.Random(12)
    pages = [planted(rng, True) for _ in range(200)]
    assert [html.main_text(page) for page, _ in pages] == [text for _, text in pages]
    pages = [planted(rng, False) for _ in range(300)]
    same = [sum(html.main_text(page, sigma) == text for page, text in pages) for sigma in (1.0, 0.0)]
    assert same[0] >= 0.95 * len(pages) and same[1] < same[0]  # without smoothing the headline and short lines go


def brute_rich(ratios):
    """Lines whose smoothed ratio is above half the standard deviation, by the definition alone."""
    smooth = []
    for i in range(len(ratios)):
        near = [(np.exp(-(d * d) / 2), ratios[min(max(i + d, 0), len(ratios) - 1)]) for d in range(-2, 3)]
        smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    mean = sum(smooth) / len(smooth)
    deviation = (sum((x - mean) ** 2 for x in smooth) / len(smooth)) ** 0.5
    return [x >= 0.5 * deviation for x in smooth]


def test_rich_lines_match_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        sizes = [(rng.randint(1, 300), rng.randint(1, 4)) for _ in range(rng.randint(1, 30))]
        parser = html._Lines()
        parser.feed("<body>" + "".join("<hr>" * (tags - 1) + f"<p>{'x' * size}" for size, tags in sizes))
        parser.end_line()
        ratios = [len(text) / max(tags, 1) for text, tags, _, _ in parser.lines]
        assert [len(text) for text, *_ in parser.lines] == [size for size, _ in sizes]
        assert html._Regions(parser, 1.0).rich.tolist() == brute_rich(ratios)


@pytest.mark.parametrize("name", ["social-contract", "legal", "search-results", "commentary", "adaptation"])
def test_words_with_another_meaning_stay(name):
    text = "A paragraph of the article that goes on for a while, as they all do, with many words."
    page = f"<article><h1>Title</h1><p>{text}</p><div class='{name}'><p>{text} Two.</p></div><p class='{name}'>{text} Three.</p></article>"
    assert html.main_text(page) == f"Title\n{text}\n{text} Two.\n{text} Three."


def test_headline_of_a_marked_header_stays():
    text = "A paragraph of the article that goes on for a while, as they all do, with many words."
    assert html.main_text(f"<body><div class='box'>Buy now</div><div><div class='post-header'><h1>The headline</h1></div><p>{text}</p><p>{text}</p></div></body>") == f"The headline\n{text}\n{text}"


@pytest.mark.parametrize("page", ['<div class="x">a ' * 40_000, "<p><li>" + "<b>" * 50_000 + "<h2>x" * 20_000, "<div>" + "<b>" * 50_000 + "</i></p>" * 20_000, "<ul><li>" * 40_000 + "x"])
def test_deep_pages_take_seconds(page):
    began = time.perf_counter()
    html.main_text(page)
    assert time.perf_counter() - began < 20


def test_extract_keeps_rows(spark):
    pages = spark.createDataFrame([(1, ARTICLE, "old"), (1, ARTICLE, "old"), (2, None, None)], "page_id long, html string, text string")
    assert sorted((r["page_id"], r["text"]) for r in html.extract(pages).collect()) == [(1, TEXT), (1, TEXT), (2, "")]


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]


def brute_urls(rows, rounds=10, damping=0.85):
    import re

    def parts(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        return ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")

    def rule(host, path):
        fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits, key=lambda x: len(x[0]), default=(None, None))

    met = [(i, *parts(u), *rule(*parts(u))) for i, u, _ in rows]
    hosts = {h for _, h, _, _, _ in met if h}
    good = {h: sum(m[4] == "allow" for m in met if m[1] == h) / sum(m[1] == h for m in met) for h in hosts}
    bad = {h: sum(m[4] == "block" for m in met if m[1] == h) / sum(m[1] == h for m in met) for h in hosts}
    count = {}
    for (_, host, *_), (_, _, page) in zip(met, rows, strict=True):
        for link in re.findall(r"href=\"((?:https?:)?//[^\"]+)\"", page or ""):
            to = parts(link if "://" in link else "http:" + link)[0]
            if host and to and to != host:
                count[host, to] = count.get((host, to), 0) + 1
    total = {}
    for (a, _), n in count.items():
        total[a] = total.get(a, 0) + n
    edge = {k: n / total[k[0]] for k, n in count.items()}
    into = {}
    for (_, b), w in edge.items():
        into[b] = into.get(b, 0) + w
    back = {k: w / into[k[1]] for k, w in edge.items()}

    def spread(seed, edges, flip):
        seed = {h: s for h, s in seed.items() if s > 0}
        score = dict(seed)
        for _ in range(rounds):
            new = {h: (1 - damping) * s for h, s in seed.items()}
            for (a, b), w in edges.items():
                a, b = (b, a) if flip else (a, b)
                if a in score:
                    new[b] = new.get(b, 0) + damping * w * score[a]
            score = new
        return score

    trust, distrust = spread(good, edge, False), spread(bad, back, True)
    own = lambda h: "block" if distrust.get(h, 0) > trust.get(h, 0) + (1 - damping) / 2 else "allow"
    return sorted(((i, h, p, r, v or own(h)) for i, h, p, r, v in met), key=repr)


def test_urls_match_brute_force(spark):
    rng = random.Random(6)
    hosts = [f"{a}.{b}" for a in ("www.example", "blog.example", "x", "y.z") for b in ("com", "net", "org")]
    paths = ["", "/", "/en/1", "/es/2?q=/en/", "/en", "#/en/", "?a"]
    rows = [(k, f"HTTP://{rng.choice(hosts).upper()}{rng.choice(paths)}", "".join(f'<a href="{rng.choice(["http:", "https:", ""])}//{rng.choice(hosts)}/p">' for _ in range(rng.randint(0, 3)))) for k in range(80)]
    rows += [(100, None, None), (101, "no scheme", "x"), (102, "://", ""), (103, "http://a\nb/c\nd", None), (None, "http://x.org/", None), (5, rows[5][1], rows[5][2])]
    pages = spark.createDataFrame([(*r, "a", "b") for r in rows], "page_id long, url string, html string, host string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    found = urls.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, found), key=repr) == brute_urls(rows)


def test_many_rules_of_one_host(spark):
    """Thousands of rules on one suffix; each page meets those alone that its path starts with."""
    rng = random.Random(8)
    rules = [("com", "/" + "".join(rng.choices("abc", k=rng.randint(0, 7))), rng.choice(["allow", "block"])) for _ in range(3000)] + [("a.com", "/ab", "block"), ("a.com", "/ab", "allow"), (None, "/", "allow"), ("b.com", None, "block")]
    rows = [(k, f"http://{rng.choice(['a.com', 'b.com', 'www.a.com', 'com', 'acom'])}/{''.join(rng.choices('abc', k=rng.randint(0, 9)))}", None) for k in range(300)]
    fits = lambda host, path: [(len(h + p), v, h + p) for h, p, v in rules if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    want = {k: max(fits(*url[7:].partition("/")[::2][:1], "/" + url[7:].partition("/")[2]), default=(0, None, None)) for k, url, _ in rows}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = urls.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert all((r["rule"], r["verdict"]) == (want[r["page_id"]][2], want[r["page_id"]][1]) for r in found.collect() if want[r["page_id"]][2])
    assert all(r["rule"] is None for r in found.collect() if not want[r["page_id"]][2])


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert urls.judge(pages, rules).collect() == [] and html.extract(pages).collect() == []


LONG = "A paragraph of the article that goes on for long enough to be told from a menu by its ratio of text to tags."


@pytest.mark.parametrize(
    "inside, text",
    [
        ("Before <img src=x> after it.", "Before after it."),
        ("super<wbr>califragilistic", "supercalifragilistic"),
        ("one <button>Press</button> two", "one two"),
        ("one<script>var a = 1;</script> two", "one two"),
        ("<nobr>one</nobr> <x-word>two</x-word><svg><text>no</text></svg>", "one two"),
        ("one<br>two", "one two"),
    ],
)
def test_only_blocks_end_a_line(inside, text):
    assert html.main_text(f"<article><p>{LONG}</p><p>{inside}</p><p>{LONG}</p></article>") == f"{LONG}\n{text}\n{LONG}"


def test_several_articles_and_small_ones_lose_nothing():
    two = f"<main><article><h2>One</h2><p>{LONG}</p></article><article><h2>Two</h2><p>{LONG} </p></article></main>"
    assert html.main_text(two) == f"One\n{LONG}\nTwo\n{LONG}"
    small = f"<main><h1>Head</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><article><p>{LONG}</p></article></main>"
    assert html.main_text(small) == "\n".join(["Head"] + [LONG] * 4)
    assert html.main_text(f"<article><h2>One</h2><p>{LONG}</p></article><div class=ad>Buy</div><article><p>{LONG}</p></article>") == f"One\n{LONG}\n{LONG}"
    around = f"<main><p>{LONG[:30]}</p><article><p>{LONG}</p><p>{LONG}</p></article></main>"
    assert html.main_text(around) == f"{LONG}\n{LONG}"


def test_lists_of_links_under_a_heading_stay_and_bars_go():
    links = "<ul><li><a href=1>First source</a></li><li><a href=2>Second source</a></li><li><a href=3>Third source</a></li></ul>"
    assert html.main_text(f"<article><p>{LONG}</p><h3>Sources</h3>{links}</article>") == f"{LONG}\nSources\nFirst source\nSecond source\nThird source"
    bar = "<div><a href=1>Mail</a></div><div><a href=2>Print</a></div><div><a href=3>Tweet</a></div><div><a href=4>Save</a></div><div><a href=5>Like</a></div>"
    assert html.main_text(f"<article><p>{LONG}</p><p>{LONG}</p>{bar}</article>") == f"{LONG}\n{LONG}"


@pytest.mark.parametrize("said", ['<section class="user-responses"><p>{}</p></section>', '<ol id="thread"><li>{}</li></ol>', "<section><h3>3 Comments</h3><div><p>{}</p></div></section>", '<div class="reader-opinions"><div><p>{}</p></div></div>', "<h4>Kommentare (2)</h4><p>{}</p>"])
def test_what_readers_say_goes(said):
    assert html.main_text(f"<article><p>{LONG}</p><p>{LONG}</p>" + said.format("I disagree with this, and at length, since there is so much to be said about it.") + "</article>") == f"{LONG}\n{LONG}"


def test_names_of_users_in_the_middle_stay():
    page = f'<article><p>{LONG}</p><div class="discussion"><p>{LONG}</p></div><p>{LONG}</p><div class="user-content"><p>{LONG}</p></div></article>'
    assert html.main_text(page) == "\n".join([LONG] * 4)


def brute_smooth(ratios, sigma):
    reach = int(np.ceil(2 * sigma))
    out = []
    for i in range(len(ratios)):
        weights = [(np.exp(-((j - i) ** 2) / (2 * sigma * sigma)), ratios[min(max(j, 0), len(ratios) - 1)]) for j in range(i - reach, i + reach + 1)]
        out.append(sum(w * r for w, r in weights) / sum(w for w, _ in weights))
    return np.array(out)


def brute_text(parts, sigma=1.0):
    """Main text of an article given as (kind, text, tags, linked) lines: rich ones by smoothing and threshold, then rows of links go that no heading stands over."""
    ratios = [len(t) / max(tags, 1) for _, t, tags, _ in parts]
    smooth = brute_smooth(ratios, sigma)
    rich = smooth >= 0.5 * smooth.std()
    out, k = [], 0
    while k < len(parts):
        to = k
        while to < len(parts) and parts[to][0] != "h2" and 2 * parts[to][3] >= len(parts[to][1]):
            to += 1
        if to - k < 2 or 2 * rich[k:to].sum() >= to - k or k and (parts[k - 1][0] == "h2" or parts[k - 1][1].endswith(":")):
            out += [p[1] for p in parts[k : max(to, k + 1)]]
        k = max(to, k + 1)
    return "\n".join(out)


def test_whole_text_matches_brute_force_and_smoothing_decides():
    """Articles of paragraphs, headings and rows of links in random order; in a fair share of them smoothing makes the difference."""
    rng = random.Random(11)
    decided = 0
    for _ in range(200):
        body, parts = [], []
        for _ in range(rng.randint(3, 14)):
            kind = rng.choice(["p", "p", "h2", "links", "links", "short"])
            if kind == "links":
                for _ in range(rng.randint(1, 5)):
                    text = sentence(rng, 1, 3)
                    body.append(f"<p><a href=x>{text}</a></p>")
                    parts.append(["p", text, 4, len(text)])
            else:
                text = sentence(rng, *{"p": (10, 40), "h2": (1, 4), "short": (1, 6)}[kind])
                tag = "h2" if kind == "h2" else "p"
                body.append(f"<{tag}>{text}</{tag}>")
                parts.append([tag, text, 2, 0])
        parts[0][2] += 1  # <article>
        page = "<article>" + "".join(body) + "</article>"
        assert html.main_text(page) == brute_text(parts)
        decided += html.main_text(page) != html.main_text(page, sigma=0)
    assert decided >= 20


def test_many_talk_elements_take_linear_time():
    def seconds(n):
        page = "<article>" + f"<p>{LONG}</p>" * n + '<div class="thread"><h3>Comments</h3><p>x</p></div>' * n + "</article>"
        began = time.perf_counter()
        html.main_text(page)
        return time.perf_counter() - began

    seconds(50)
    assert seconds(4000) < 12 * max(seconds(500), 0.02)
