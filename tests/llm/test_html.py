import time

from shardloom.llm.html import extract, main_text, parse

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";x()</script></head><body>
<nav><ul><li><a href="/">Home</a></ul></nav><!-- ad 1 --><div class="ad">Buy</div><header>Site</header>
<article><h1>Title &amp; more</h1><p><b>First  para&nbsp;one.<br><p>Second <a href='x>y'>link</a> &lt;b&gt;</p><div class="share-tools">Share</div>
<form><input name=q>Ask</form><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table></article>
<aside>Side</aside><section id="comments"><p>Nice!</p></section><footer>&copy; Me</footer>"""


def test_article():
    assert main_text(PAGE).split("\n\n") == ["Title & more", "First para one.", "Second link <b>", "one", "two", "a b", "c"]


def test_odd_inputs():
    assert main_text(None) == main_text("") == ""
    assert main_text("plain < text & more") == "plain < text & more"
    assert main_text("<p>a <p>b<!-- never closed <p>c") == "a\n\nb"
    assert main_text('<div title="never closed>x <p>y') == "y" or "y" in main_text('<div title="never closed>x <p>y')
    assert main_text("<script>x") == "" and main_text("</p></div>z") == "z"
    assert main_text("<main><p>in</p></main><p>out</p>") == "in"
    assert main_text("<div>" * 30000 + "deep") == "deep"
    assert main_text("<![CDATA[a & b]]>") == "a & b"


def test_long_broken_page_is_fast():
    t = time.time()
    main_text("<a b='" * 50000)
    main_text("<p " * 50000)
    assert time.time() - t < 20
    assert parse("<").children == ["<"]


def test_templates_per_host(spark):
    rows = []
    for i in range(12):
        rows.append((i, f"http://a.net/{i}", f"<body><div><p>Welcome to A</p></div><p>story {i}</p><p>shared by two {i // 2}</p></body>", "t"))
    rows += [(20 + i, "http://b.net/", "<p>Welcome to A</p><p>only b</p>", "t") for i in range(2)]
    rows += [(30, None, "<p>no url</p>", "t"), (31, "http://a.net/x", None, "t"), (31, "http://a.net/x", "", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    for most in (10**6, 0):
        got = sorted((r.page_id, r.text) for r in extract(df, most_broadcast=most).collect())
        want = sorted([(i, f"story {i}\n\nshared by two {i // 2}") for i in range(12)] + [(20 + i, "Welcome to A\n\nonly b") for i in range(2)] + [(30, "no url"), (31, ""), (31, "")])
        assert got == want
    assert extract(df.limit(0)).count() == 0


def test_copies_of_a_page_are_no_template(spark):
    page = "<body><div><p>Welcome to C</p></div><article><h1>{0}</h1><p>story {0}</p><div>more {0}</div></article><footer>seen {1} times</footer></body>"
    plain = "<body><div><p>Welcome to D</p></div><p>story {0}</p></body>"
    rows = [(i, f"http://c.net/{i}", page.format(max(0, i - 30), i), "t") for i in range(40)]  # 31 copies, 9 others
    rows += [(100 + i, f"http://d.net/{i}", plain.format(max(0, i - 8)), "t") for i in range(16)]
    rows += [(200, "http://e.net/", plain.format("once"), "t")] * 5
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text) for r in extract(df).collect())
    story = lambda i: f"{i}\n\nstory {i}\n\nmore {i}"
    want = [(i, story(max(0, i - 30))) for i in range(40)] + [(100 + i, f"story {max(0, i - 8)}") for i in range(16)] + [(200, "Welcome to D\n\nstory once")] * 5
    assert got == want


def site(i, words):
    nav = "".join(f"<li><a href='/{w}{i}'>{w} {i}</a></li>" for w in words.split())
    return f"""<html><body class="page-{i}"><div class="top bar-{i}"><ul>{nav}</ul></div><div class="promo box">offer number {i} of today</div>
<div id="story"><h2>Introduction</h2><p>{words} {i}. {'A long text of the page goes here, word by word. ' * 6}</p><p>Read <b>more</b> of {i}</p></div><div class="end">made in {1900 + i}</div></body></html>"""


def test_parts_recur_by_their_skeleton_whatever_their_words(spark):
    rows = [(i, f"http://s.net/{i}", site(i, f"alpha beta w{i}"), "t") for i in range(9)]
    rows += [(20 + i, "http://few.net/", site(20 + i, "x"), "t") for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    for most in (10**6, 0):
        got = {r.page_id: r.text for r in extract(df, most_broadcast=most, words=frozenset()).collect()}
        for i in range(9):
            assert got[i].startswith("Introduction\n\nalpha") and got[i].endswith(f"Read more of {i}")  # a heading and inline words that recur stay
        assert all("offer number" in got[20 + i] for i in range(3))  # too few pages


def test_template_counts_against_brute_force(spark):
    from collections import Counter

    from shardloom.llm import html

    pages = [(f"h{i % 3}.net", site(i // 2 if i % 3 else i, f"one two {i // 2}")) for i in range(30)] + [("h0.net", None), ("h9.net", ""), ("", site(1, "x"))]
    got = {(r.host, r.hash) for r in html.templates(spark.createDataFrame(pages, "host string, html string")).collect()}
    want = set()
    for host in {h for h, _ in pages if h}:
        distinct = {}
        for h, page in pages:
            if h == host:
                distinct.setdefault(html.main_text(page), []).append(page)
        n, mass, total = Counter(), Counter(), 0
        for copies in distinct.values():
            found, most = {}, 0
            for page in copies:
                root = html.parse(page or "")
                exact = html.hash_subtrees(root)
                most = max(most, root.mass)
                for key, m in [*((x, (0, 0)) for x in exact), *html.hash_slots(root).items()]:
                    found[key] = tuple(map(max, found.get(key, (0, 0)), m))
            total += most
            for key, m in found.items():
                n[key] += 1
                mass[key] += m[0]
                mass["depth", key] = max(mass["depth", key], m[1])
        often = [k for k in n if n[k] >= html.LEAST_PAGES and n[k] >= html.SHARE * len(distinct)]
        content = [k for k in often if k % 2 and mass[k] >= html.CONTENT * total]
        want |= {(host, k) for k in often if k not in content}
        if content:
            want.add((host, -max(content, key=lambda k: (mass["depth", k], k))))
    assert got == want and want
