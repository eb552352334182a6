"""HTML extraction against hand-written pages, the pages table, and a brute-force search for repeats."""

import html
import random
import re

import numpy as np
import pytest

from faultline.llm import html_text
from faultline.llm.queries import llm_queries
from faultline.llm.shared import table


def text_of(source):
    return html_text.main_text(html_text.parse(source))


@pytest.mark.parametrize("source, text", [
    ("", ""), ("plain words", "plain words"), ("<p>One<p>Two", "One Two"), ("<article><h1>T</h1><p>a&amp;b&nbsp;c &#233;&eacute;&lt;</p></article>", "T a&b c éé<"),
    ("<nav>menu</nav><article>text <b>bo</b>ld<br>next</article><footer>end</footer>", "text bold next"),
    ("<article><header><h1>Title</h1></header><p>Body</p><aside>side</aside><form>f<input></form><div class='comments'><p>nice</p></div></article>", "Title Body"),
    ("<article>a<div class=\"ad\">buy</div>b<section id=comments>c</section><p hidden>d</p><p style='display: none'>e</p></article>", "a b"),
    ("<body><header>head</header><div>main words</div><div class='cookie-notice'>cookies</div><script>var a='<p>x</p>';</script><style>p{}</style></body>", "main words"),
    ("<article>a<!-- <p>hidden</p> -->b<!--unclosed", "ab"), ("<article>x<script>never closed <p>y", "x"), ("<article title='a>b'>c</article>", "c"), ("<ARTICLE>Upper</ARTICLE>", "Upper"),
    ("<article><p><b>open bold<br><p>second</article><footer>f</footer>", "open bold second"), ("<article><ul><li>one<li>two</ul></article>", "one two"), ("a < b and c > d", "a < b and c > d"),
    ("<main><p>m</p></main><div>outside</div>", "m"), ("<div role=main>m</div><div>outside</div>", "m"), ("<article>a</article><article>b</article>", "a b"),
    ("<article><textarea>t</textarea><noscript>n</noscript><select><option>o</select>x</article>", "x"), ("<article><pre>a\n  b</pre></article>", "a b"), ("<article>a</p></b></div>b</article>", "a b"),
    ("<article>x<iframe>y</iframe>z<svg><text>s</text></svg></article>", "x z"), ("<div class='content with-sidebar'><article>a<div class=ad>b</div>c</article></div>", "a c"), ("<article>post<section id=comments><article class=comment>nice</article></section></article>", "post"),
    ("<article>post</article><div class=comments><article>first!</article></div>", "post"), ("<article class='post ad-free'>p</article><aside>x</aside>", "p"), ("<article>x<img alt=i>y<hr>z</article>", "xy z"),
    ("<body><nav>n</nav><div id=content><h1>T</h1><p>one two</p></div><div class=sidebar>s</div></body>", "T one two"), ("<article>f<script>x</script>oo<style>y</style></article>", "foo"),
])
def test_pages(source, text):
    assert text_of(source) == text


def test_every_beginning_is_counted():
    """Tokens covered by repeats of a run, and the suffix order, by brute force."""
    rng = random.Random(8)
    for _ in range(30):
        shared = [[rng.choice("abc") for _ in range(rng.randint(3, 14))] for _ in range(3)]
        streams = [[w for _ in range(rng.randint(0, 4)) for w in rng.choice([*shared, [rng.choice("abcdefgh") for _ in range(6)]])] for _ in range(5)]
        run = html_text.Run.of([" ".join(s).encode() for s in streams], list(range(5)))
        got = html_text.cover(run.counts() > 1)
        for k, stream in enumerate(streams):
            want = np.zeros(len(stream), bool)
            others = {tuple(s[i:i + 8]) for j, s in enumerate(streams) if j != k for i in range(len(s) - 7)}
            for i in range(len(stream) - 7):
                if tuple(stream[i:i + 8]) in others:
                    want[i:i + 8] = True
            assert got[run.starts[k]:run.ends[k]].tolist() == want.tolist()
    assert html_text.Run.of([], []).counts().tolist() == [] and html_text.Run.of([b"", b"a b"], [1, 2]).counts().tolist() == [0, 0, 0, 0]
    tokens = np.array([rng.randrange(3) for _ in range(200)], np.uint64)
    order, rank = html_text.suffix_order(tokens)
    beginnings = [tuple(tokens[i:i + 8].tolist()) for i in range(200)]
    assert [beginnings[i] for i in order] == sorted(beginnings)
    assert all((rank[i] == rank[j]) == (beginnings[i] == beginnings[j]) for i in range(0, 200, 7) for j in range(200))


@pytest.mark.parametrize("pattern", ["<a ", '<a href="x ', "<div>x ", "<b>x ", "</ x", "<p>x<b>", "<li><b>", "<i><div>x</i>", "<a b='", "&amp", "</b>", '<a href="x>'])
def test_damaged_pages_take_linear_time(pattern):
    import time

    def took(size):
        start = time.process_time()
        html_text.parse((pattern * size)[:size] + ">")
        return time.process_time() - start

    took(1000)
    assert took(1 << 20) < 15 and took(1 << 20) < 24 * max(took(1 << 17), 0.02)


def brute_texts(rows):
    """Page by page over the whole host, from the blocks that the parser gives: (page_id, text)."""
    pages = [(k, re.sub(r"^https?://([^/]*).*", r"\1", u), html_text.parse(h)) for k, u, h in rows]
    out = []
    for k, host, page in pages:
        others = {p.content(): [w for _, link, text in p.blocks for w in (link, *text.split())] for _, h, p in pages if h == host}
        beginnings = {c: {tuple(s[i:i + 8]) for i in range(len(s) - 7)} for c, s in others.items()}
        own = [(n, w) for n, (_, link, text) in enumerate(page.blocks) for w in (link, *text.split())]
        main = page.main_kind()
        least = 2 if main == "open" else max(4, 0.75 * len(others))
        lost = set()
        for i in range(len(own) - 7):
            if sum(tuple(w for _, w in own[i:i + 8]) in b for b in beginnings.values()) >= least:
                lost |= set(range(i, i + 8))
        out.append((k, " ".join(w for i, (n, w) in enumerate(own) if i not in lost and page.blocks[n][0] == main and not w.startswith("<"))))
    return sorted(out)


@pytest.mark.parametrize("run_pages", [2, 512])
def test_extract_as_brute_force(spark, run_pages):
    rng = random.Random(4)
    passages = [" ".join(f"p{i}w{k}" for k in range(rng.randrange(10, 30))) for i in range(6)]
    rows = []
    for k in range(60):
        parts = [rng.choice([" ".join(f"own{k}x{rng.randrange(999)}" for _ in range(rng.randrange(12))), rng.choice(passages)]) for _ in range(rng.randrange(7))]
        if k % 3 == 0:
            html_page = f"<nav>{passages[0]}</nav><article>{''.join(f'<p>{p}' for p in parts)}<p>{passages[1]}</article>"
        else:
            html_page = f"<div>{passages[2]}</div>" + "".join(f"<p>{p}</p>" for p in parts) + f"<div>tail {passages[3]}</div>"
        rows.append((k, f"https://h{k % 2}.example/{k}", html_page))
    rows += [(100 + k, "https://h0.example/copy", rows[4][2]) for k in range(5)] + [(200, "https://alone.example/", rows[0][2])]
    got = sorted((r["page_id"], r["text"]) for r in html_text.extract(pages_frame(spark, rows), run_pages=run_pages).collect())
    assert got == brute_texts(rows)


def unmarked(k, host):
    """A page that marks neither its article nor its boilerplate."""
    body = " ".join(f"word{k}x{i}" for i in range(60))
    return k, f"https://{host}/p/{k}", f"<div><p>Welcome to our site with all the daily things you want</p><p>{body}</p><p>Call us now or write a letter to the usual place</p></div>"


def pages_frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string").repartition(3)


def test_a_host_shows_its_boilerplate(spark):
    rows = [unmarked(k, "a.example") for k in range(12)] + [unmarked(99, "other.example")]
    got = {r["page_id"]: r for r in html_text.extract(pages_frame(spark, rows)).collect()}
    for k in range(12):
        assert got[k]["text"] == " ".join(f"word{k}x{i}" for i in range(60))
    assert got[99]["text"].startswith("Welcome") and got[99]["n_chars"] == len(got[99]["text"])


def test_copies_are_no_boilerplate(spark):
    one = unmarked(1, "a.example")
    rows = [one, (2, one[1], one[2]), (3, one[1], one[2])]
    assert {r["text"] for r in html_text.extract(pages_frame(spark, rows)).collect()} == {text_of(one[2])}


def test_a_hot_host_is_dealt_out(spark):
    rows = [unmarked(k, "hot.example") for k in range(60)]
    got = html_text.extract(pages_frame(spark, rows), run_pages=8)
    assert all(r["text"] == " ".join(f"word{r['page_id']}x{i}" for i in range(60)) for r in got.collect())


def test_repeats_are_found_over_the_whole_host(spark):
    """Two pages share a passage, whatever shards they are dealt to; many shards of one page each."""
    passage = "these eleven words stand on no more than two pages here"
    rows = [unmarked(k, "hot.example") for k in range(40)]
    rows = [(k, u, h.replace("</p><p>Call", f" {passage}</p><p>Call") if k in (3, 31) else h) for k, u, h in rows]
    for run_pages in (1, 512):
        got = html_text.extract(pages_frame(spark, rows), run_pages=run_pages).collect()
        assert {r["page_id"]: "Welcome" in r["text"] or "Call" in r["text"] for r in got} == dict.fromkeys(range(40), False)
    run = html_text.Run.of([html_text.parse(h).stream() for _, _, h in rows], list(range(40)))
    assert [int(html_text.cover(run.counts() > 1)[a:b].sum()) for a, b in zip(run.starts, run.ends)][:5] == [25, 25, 25, 36, 25]


def test_unique_words_beside_repeated_ones(spark):
    """A block mostly of shared words keeps its own, one with few loses them; a short article stays under a long menu, which goes."""
    shared = " ".join(f"quoted{i}" for i in range(30))
    menu = " ".join(f"entry{i}" for i in range(400))
    rows = [(k, "http://q.example/x", f"<div><p>own{k} {shared} end{k}</p><p>{' '.join(f'word{k}x{i}' for i in range(40))} {shared}</p></div>") for k in range(2)]
    rows += [(k, "http://m.example/x", f"<div>{menu}</div><div>short text {k}</div>") for k in range(10, 12)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages_frame(spark, rows)).collect()}
    for k in range(2):
        assert got[k] == f"own{k} end{k} " + " ".join(f"word{k}x{i}" for i in range(40))
    assert [got[k].split()[-1] for k in (10, 11)] == ["10", "11"] and not any("entry" in got[k] for k in (10, 11))


def test_boilerplate_within_articles(spark):
    """A host's unmarked share line goes from its articles, copies of a page or not; a passage that two of them share stays."""
    share = "Share this story with your friends and tell us what you think"
    body = {k: " ".join(f"word{k}x{i}" for i in range(30)) for k in range(12)}
    passage = " ".join(f"quoted{i}" for i in range(20))
    text = {k: body[k] + (f" {passage}" if k in (4, 9) else "") for k in body}
    rows = [(k, "http://s.example/x", f"<nav>menu</nav><article><p>{text[k]}</p><div>{share}</div></article>") for k in body]
    rows += [(100 + k, "http://copies.example/x", f"<div class=ad>{k}</div><article><p>{text[4]}</p><div>{share}</div></article>") for k in range(6)]
    for run_pages in (2, 512):
        got = {r["page_id"]: r["text"] for r in html_text.extract(pages_frame(spark, rows), run_pages=run_pages).collect()}
        assert got == text | {100 + k: f"{text[4]} {share}" for k in range(6)}


def test_an_article_shows_what_an_unmarked_page_repeats(spark):
    passage = " ".join(f"quoted{i}" for i in range(20))
    rows = [(1, "http://a.example/1", f"<article>{passage} told at length</article>"), (2, "http://a.example/2", f"<div>own words {passage} here</div>")]
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages_frame(spark, rows)).collect()}
    assert got == {1: f"{passage} told at length", 2: "own words here"}


def test_odd_pages(spark):
    rows = [(None, None, None), (1, None, "<p>x"), (1, None, "<p>x"), (2, "no url at all", ""), (3, "http://h/", "<article>" + "long words " * 200_000 + "</article>")]
    got = html_text.extract(pages_frame(spark, rows)).collect()
    assert len(got) == 5 and sorted(r["text"] for r in got)[:2] == ["", ""]
    assert max(r["n_chars"] for r in got) == len("long words " * 200_000) - 1
    assert html_text.extract(pages_frame(spark, rows).where("false")).count() == 0


def test_pages_table(spark):
    sf = "/root/testdata/sf0.01"
    sources = {r["page_id"]: r["html"] for r in table(spark, sf, "pages").collect()}
    got = llm_queries()["op5_html_extraction"](spark, sf).collect()
    assert len(got) == len(sources)
    for r in got:
        article = re.search(r"<article>(.*)</article>", sources[r["page_id"]], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<(?!/?b>)[^>]*>", " ", article).replace("<b>", "").replace("</b>", "")).split())
        assert (r["text"], r["n_chars"]) == (want, len(want))
