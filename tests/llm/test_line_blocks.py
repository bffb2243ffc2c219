import random
import time
import tracemalloc

import pytest

from shelfwise.llm import line_blocks as lb
from shelfwise.llm.line_blocks import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{a:b}</style></head><body class="has-sidebar">
<header><h1>Site</h1><p>A slogan that is long enough to look like a paragraph of some text.</p></header>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies, and here is why we do so at length.</div>
%s
<section id="comments"><p>A reader's comment which is long and dense but does not belong to the article.</p></section>
<form><label>Mail</label><input><p>Subscribe to the letter</p></form><aside><p>Other things to read in a sidebar.</p></aside>
<footer>&copy; 2024 &middot; Someone</footer><script>var t = "<p>no</p>";</script></body></html>"""
BODY = """<h1>Title &lt;1&gt;</h1><p>First   <b>bold</b> &amp; plain,<br>next&nbsp;line.</p><p>The second is long enough to be
an article's paragraph by any measure.<div class="ad">Buy &amp; save</div><p>Short.</p><ul><li>one<li>two</ul><!-- gone -->"""
WANT = ("Title <1>\n\nFirst bold & plain, next line.\n\nThe second is long enough to be an article's paragraph by any "
        "measure.\n\nShort.\n\none\n\ntwo")


def test_article_and_container():
    assert extract(PAGE % f"<article>{BODY}</article>") == WANT
    assert extract(PAGE % f"<main>{BODY}</main>") == WANT
    assert extract(PAGE % f"<div class='post-body'>{BODY}</div>") == WANT
    title, rest = BODY.split("</h1>")
    assert extract(PAGE % f"<div><div class='post-header'>{title}</h1></div><div>{rest}</div></div>") == WANT


def test_container_holds_all_of_the_text():
    first, second = "one two three. " * 50, "four five six. " * 17
    want = f"{first.strip()}\n\n{second.strip()}"
    links = "<div class=list><a href=x>Home</a> <a href=y>News</a></div>"
    assert extract(f"<div class=story><div class=part1>{first}</div><div class=part2>{second}</div></div>") == want
    assert extract(f"<body>{links}<div class=story><section>{first}</section><p>{second}</p></div>{links}</body>") == want
    assert extract(f"<table><tr><td>{first}</td><td>{second}</td></tr></table>") == want
    intro, closing = "An intro of some words.", "A closing line."
    assert extract(f"<div><div>{intro}</div><div>{first}</div><div>{closing}</div></div>") \
        == f"{intro}\n\n{first.strip()}\n\n{closing}"


def test_links_in_the_text_stay():
    text, items = "one two three. " * 50, "".join(f"<li><a href=x>item {k}</a>" for k in range(4))
    report, closing = "<p><a href=x>The full report</a></p>", "<p>So long.</p>"
    parts = [text.strip(), "item 0", "item 1", "item 2", "item 3", "So long.", "The full report"]
    body = f"<p>{text}</p><ul>{items}</ul>{closing}{report}"
    for tag in ("article", "main", "div", "body"):
        assert extract(f"<{tag}>{body}</{tag}>") == "\n\n".join(parts)
    assert extract(f"<article><p>{text}</p>{report}</article>") == f"{text.strip()}\n\nThe full report"
    assert extract("<article><a href=x><b>All</b> of it</a></article>") == "All of it"
    both = f"<div><section>{text}</section><ul>{items}</ul><section>{text}</section></div>"
    assert extract(both) == "\n\n".join([*parts[:5], parts[0]])
    # a menu right in the body is none of the text
    assert "item 0" not in extract(f"<body><ul>{items}</ul><p>{text}</p></body>")
    assert extract(f"<div><ul>{items}</ul></div><div><p>{text}</p></div>") == text.strip()


def brute_runs(sizes, span):
    """Runs of lines whose window of ``span`` lines, from each on, has any text."""
    sums = [sum(sizes[i:i + span]) for i in range(len(sizes))]
    out, i = [], 0
    while i < len(sizes):
        j = i
        while j < len(sizes) and sums[j] > 0:
            j += 1
        if j > i:
            out.append((i, j, max(sums[i:j])))
        i = j + 1
    return out


def test_window_rule_against_brute_force():
    rng = random.Random(6)
    for _ in range(2000):
        sizes = [rng.choice([0, 0, 0, 5, 20, 90]) for _ in range(rng.randrange(25))]
        for span in (1, 3, 5):
            assert lb.surges(sizes, span) == brute_runs(sizes, span)


def test_pages_without_marks_against_the_window_rule():
    """Divisions of the body, some of them adverts: what is kept is what the rule keeps of their lengths."""
    rng = random.Random(7)
    for _ in range(300):
        sizes = [rng.choice([0, 0, 0, 0, 8, 30, 200]) for _ in range(rng.randrange(1, 30))]
        page = "".join(f"<p>{'w' * n}</p>" if n else "<div class=ad>Buy</div>" for n in sizes)
        found = [0 if k and not n and not sizes[k - 1] else n for k, n in enumerate(sizes)]
        lines = [n for k, n in enumerate(sizes) if n or not k or sizes[k - 1]]  # one gap for adverts in a row
        runs = brute_runs(lines, lb.SPAN)
        enough = min(lb.SURGE, lb.SHARE * max([r[2] for r in runs], default=0))
        kept = [n for b, e, strength in runs if strength >= enough for n in lines[b:e] if n]
        # all stand in the body alone, so what has text of its own and stands beside kept text is kept as well
        want = [n for n in lines if n] if kept else []
        assert [len(x) for x in extract(page).split("\n\n") if x] == want and len(found) == len(sizes)


def test_names_of_parts():
    yes = ("ad ads-1 sidebar left-sidebar adblock adBlock ad-box-2 cookie-notice cookieconsent comments_list navbar site_footer "
           "related-posts" "").replace("related-posts", "related").split()
    no = "add radish headline shadow story widgetry badge load content main post wrapper ad-q 1ad download header-image article".split()
    part = lambda n: extract(f"<div><p>{'text ' * 30}</p><div class='{n}'>gone</div><p>{'more ' * 30}</p></div>")
    assert [n for n in yes if "gone" in part(n)] == [] and [n for n in no if "gone" not in part(n)] == []


@pytest.mark.parametrize("page", [
    '<div id="widget-%s_q">x</div>' % ("1" * 200), '<div class="ad%sq">x</div>' % ("box" * 300),
    '<div class="%s">x</div>' % ("ad-" * 5000)])
def test_long_names_are_read_once(page):
    began = time.time()
    extract(page)
    assert time.time() - began < 0.5


@pytest.mark.parametrize("piece", ["<a ", "<div>x", "<p a='", "</p>", "<p>x</p></p>", "<!-- ", "<a =\"", "<li>", "</span>", "<b", "&#"])
def test_time_and_memory_grow_with_the_page(piece):
    def cost(n):
        tracemalloc.start()
        began = time.process_time()
        extract(piece * n)
        took, peak = time.process_time() - began, tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return took, peak

    n = 600_000 // len(piece)
    (_, small), (took, large) = cost(n // 8), cost(n)
    assert took < 20 and large < 16 * small + 4_000_000


def test_marks_are_evidence():
    story, teaser = "one two three. " * 50, "<article class=card><h3>Teaser one</h3></article>"
    for page in (f"{teaser}<div class=story><p>{story}</p></div>", f"<div class=story><p>{story}</p></div>{teaser * 3}",
                 f"<main></main><div>{story}</div>"):
        got = extract(f"<body>{page}</body>")
        assert story.strip() in got
    both = f"<article><p>{story}</p></article><div><p>Something short beside it.</p></div>"
    assert extract(both) == story.strip()
    assert extract("<body><p><a href=x>All there is</a></p></body>") == "All there is"


def test_links_to_other_pages_under_their_heading_go():
    story = "one two three. " * 50
    other = "<h2>More stories</h2><ul><li><a href=x>Other story one</a><li><a href=y>Other story two</a></ul>"
    for tag in ("main", "article", "div"):
        assert extract(f"<{tag}><p>{story}</p>{other}</{tag}>") == story.strip()
        # a heading of the text, a link without one, and links before more text are no menu
        kept = extract(f"<{tag}><p>{story}</p><h2>Sources</h2><p><a href=x>Other story one</a></p></{tag}>")
        assert kept.endswith("Sources\n\nOther story one")
        assert "Other story one" in extract(f"<{tag}><p>{story}</p>{other}<p>{story}</p></{tag}>")


def test_unclosed_and_odd_markup():
    assert extract("<article><p><b>Head.<br><p>Text of it") == "Head.\n\nText of it"
    assert extract("a &amp;lt; b") == "a &lt; b"
    assert extract("<p>x</p><script>never closed <p>y</p>") == "x"
    assert extract("<div>one<span> two</span>three</div>") == "one twothree"
    assert extract("<p>5 < 6 and 7 > 6</p>") == "5 < 6 and 7 > 6"
    assert extract("<p title=it's>Don't <b class='a\"b'>stop</b> it's fine</p>") == "Don't stop it's fine"
    assert extract("<p data-a=\"x > y\">text</p>") == "text"
    for junk in ("<", "<a", "<!--", "</", "<p title=\"", "\x00", "<>", "&#xZZ; &#0;"):
        extract(junk)


def test_edges(spark):
    schema = "page_id long, url string, html string, text int"
    big = "<article>" + "".join(f"<p>paragraph number {k} of a very long page</p>" for k in range(30000)) + "</article>"
    rows = [(1, "u", None, 0), (2, None, "", 0), (3, "u", "<p>only</p>", 0), (3, "u", "<p>only</p>", 0), (None, "u", big, 1)]
    got = main_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in got if r["page_id"]) == [
        (1, "", 0), (2, "", 0), (3, "only", 4), (3, "only", 4)]
    assert [r["text"].count("\n\n") for r in got if r["page_id"] is None] == [29999]
    assert main_text(spark.createDataFrame([], schema)).collect() == []
