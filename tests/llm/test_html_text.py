import collections
import html
import random
import re

import numpy as np

from cairn.llm import html_text as H
from cairn.llm import queries as Q

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head>
<body class="has-sidebar"><header>Site</header><nav><ul><li><a href="/x">Home</a></ul></nav><!-- ad <p>x</p> --><div class="ad">Buy</div>
<article><h1>Head&amp;line</h1><p><b>Bold<br>text &lt;b&gt; a&nbsp;b
 c<p>sec<i>ond</i> <aside>side</aside><form>name</form>para</p><div id='comments'><p>first!</p></div><p>3 < 4 &copy;</article>
<footer>&copy; site</footer></body></html>"""


def text_of(page):
    return H.solve([H.blocks(page)])[0][0]


def test_article_of_a_page_with_landmarks():
    assert text_of(PAGE) == "Head&line Bold text <b> a b c second para 3 < 4 ©"
    assert text_of(None) == text_of("") == "" and text_of("<<<") == "<<<"


def test_odd_markup():
    assert text_of("<p>unclosed <b>one <script>x") == "unclosed one"
    assert text_of("<textarea>x<p>kept</p>") == "kept"
    assert text_of("<article><p>one</p><datalist><option>a</datalist><p>two</p></article><p>x") == "one two"
    assert text_of("<article><div class='share-holder report'>kept</div><div class='comment-list'>c</div><p class='shareholder'>too</p></article>") == "kept too"
    assert text_of('<main class="content has-sidebar">kept</main>') == "kept"
    assert text_of('<div class="page-with-sidebar"><article>kept</article></div><div class="sidebarLeft">x</div>') == "kept"
    assert text_of("<article>teaser</article><p>a page whose text stands outside of its landmark</p>") == "teaser a page whose text stands outside of its landmark"
    assert text_of("<article>" + "long text " * 5000 + "</article>") == "long text " * 4999 + "long text"
    assert text_of("<script>" * 3000 + "<p>x") == "x"  # no search of the whole rest for each


def plain_runs(pages):
    """Per token on how many pages the run that begins there stands."""
    runs = lambda q: [tuple(q[k : k + H.MIN_RUN].tolist()) if k + H.MIN_RUN <= len(q) else None for k in range(len(q))]
    have = [set(runs(q)) for q in pages]
    return [[0 if r is None else sum(r in h for h in have) for r in runs(q)] for q in pages]


def test_run_pages_match_brute_force():
    rng = random.Random(0)
    for _ in range(60):
        pages = [np.array([rng.choice([1, 2, 3, 4]) for _ in range(rng.randint(0, 40))], dtype=np.int64) for _ in range(5)]
        assert [x.tolist() for x in H.run_pages(pages)] == plain_runs(pages)


def plain_text(page, runs, pages):
    """:func:`html_text.main_text`, token by token."""
    at, found = 0, []
    covered = lambda i, n: any(runs[k] >= n for k in range(max(0, i - H.MIN_RUN + 1), i + 1))
    some, most = max(H.LEAST_PAGES, -(-pages // 20)), max(H.PROTECTED_PAGES, pages // 2 + 1)
    for kind, words in page:
        at += 1
        found.append((kind, words, [covered(at + i, some) for i in range(len(words))], all(covered(at + i, most) for i in range(len(words)))))
        at += len(words)
    protected = [w for k, words, _, _ in found if k == H.PROTECTED for w in words]
    open_ = [w for k, words, gone, _ in found if k == H.OPEN for w, g in zip(words, gone, strict=True) if not g]
    drop = 2 * sum(len(words) for k, words, _, whole in found if k == H.PROTECTED and whole) < len(protected)
    out = []
    for k, words, gone, whole in found:
        if k == H.PROTECTED and not (drop and whole):
            out += words
        if k == H.OPEN and (not protected or len(protected) < len(open_)):
            out += [w for w, g in zip(words, gone, strict=True) if not g]
    return " ".join(out)


def test_whole_query_matches_brute_force(spark):
    """The registered query on the small tables, and on the same pages without their landmarks and names."""
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    bare = [(i + 10**6, u, re.sub(r"<(/?)(?:nav|footer|article)\b", r"<\1div", h or "")) for i, u, h in rows]
    for data in (rows, bare):
        hosts = collections.defaultdict(list)
        for r in data:
            hosts[H.host(r[1])].append((r[0], H.blocks(r[2])))
        want = {}
        for group in hosts.values():
            numbers = {}
            streams = [np.array([1 if w is None else numbers.setdefault(w, len(numbers) + 2) for _, words in p for w in (None, *words)] + [1]) for _, p in group]
            for (i, p), runs in zip(group, plain_runs(streams), strict=True):
                want[i] = plain_text(p, runs, len(group))
        if data is rows:
            found = Q.op8_html_text(spark, "/root/testdata/sf0.001").collect()
        else:
            found = H.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()
        assert {r["page_id"]: r["text"] for r in found} == want


def test_suffix_arrays_alone_find_the_article(spark):
    """The given pages' articles, in a menu and a footer that their host repeats, without any landmark or name: repetition decides."""
    rows = [(r["page_id"], r["url"], text_of(r["html"])) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect() if r["html"]]
    size = collections.Counter(H.host(u) for _, u, _ in rows)
    many = [r for r in rows if size[H.host(r[1])] >= 5 and r[2]]
    frame = lambda u, t: f"<div><a>Home of {H.host(u)}</a> news about us contact</div><div><p>{html.escape(t)}</p></div><div>All rights of {H.host(u)} are kept by its owners</div>"
    found = {r["page_id"]: r for r in H.extract(spark.createDataFrame([(i, u, frame(u, t)) for i, u, t in many], "page_id long, url string, html string")).collect()}
    assert len(many) > 100 and all(r["n_repeated"] >= 12 and "Home of" not in r["text"] and "rights of" not in r["text"] for r in found.values())
    same = sum(found[i]["text"] == t for i, _, t in many)  # others hold a line that many pages of the host have
    assert same >= 0.9 * len(many)


def site(n):
    rng = random.Random(1)
    words = ["w%d" % i for i in range(400)]
    rows, want = [], []
    for i in range(n):
        body = " ".join(rng.choice(words) for _ in range(30))
        rows.append((i, f"http://a.example/{i}", f"<div>Home About Us Contact Now</div><p>{body}</p><div>All rights kept by the site owners</div>", "x"))
        want.append(body)
    return rows, want


def test_repetition_decides_pages_without_landmark(spark, monkeypatch):
    rows, want = site(12)
    rows.append((12, "http://b.example/", "<p>Home About Us Contact Now</p>", "y"))  # another host
    rows += [(13, None, PAGE, ""), (14, None, None, ""), (14, None, None, "")]
    want += ["Home About Us Contact Now", "Head&line Bold text <b> a b c second para 3 < 4 ©", "", ""]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").coalesce(2)
    for limit in (200, 11):  # 11: the host is dealt into parts
        monkeypatch.setattr(H, "HOST_PAGES", limit)
        out = sorted(H.extract(df).collect(), key=lambda r: r["page_id"])
        assert [r["text"] for r in out] == want and all(r["n_chars"] == len(r["text"]) for r in out)
    assert H.extract(df.limit(0)).collect() == []


def test_runs_on_few_pages_of_a_host_stay(spark, monkeypatch):
    rows, want = site(40)
    phrase = "at the end of the day we went"
    twice = "this article of the agency was printed here two times"
    for i, extra in ((3, phrase), (9, phrase), (4, twice), (8, twice)):
        rows[i] = (*rows[i][:2], rows[i][2].replace("</p>", f" {extra}</p><p>{extra}</p>"), rows[i][3])
        want[i] += f" {extra} {extra}"
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").coalesce(2)
    for limit in (200, 20):
        monkeypatch.setattr(H, "HOST_PAGES", limit)
        assert [r["text"] for r in sorted(H.extract(df).collect(), key=lambda r: r["page_id"])] == want


def test_a_block_on_most_pages_goes_from_articles_but_no_article(spark):
    rows, want = site(9)
    line = "subscribe to this letter of ours now and read it every day"
    rows = [(i, u, f"<article>{h.replace('<div>', '<footer>').replace('</div>', '</footer>')}<p>{line}</p></article>", x) for i, u, h, x in rows]
    rows += [(100 + i, "http://b.example/", "<article><p>" + want[0] + "</p></article>", "") for i in range(8)]  # the article repeats
    want += [want[0]] * 8
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert [r["text"] for r in sorted(H.extract(df).collect(), key=lambda r: r["page_id"])] == want


def test_copies_of_a_page_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(H, "HOST_PAGES", 10)
    rows = [(i, "http://a.example/", PAGE) for i in range(100)]
    found = H._parsed(spark.createDataFrame(rows, "id long, url string, html string").coalesce(1), "bigint").collect()
    parts = collections.Counter(r["salt"] % 10 for r in found)
    assert len(parts) == 10 and max(parts.values()) < 30


def test_texts_do_not_depend_on_how_a_host_is_dealt(spark, monkeypatch):
    """Runs on a little more and less than the shares, unevenly over the parts: each count is that of the whole host."""
    rng = random.Random(4)
    rows = []
    for h, n in (("a", 60), ("b", 37), ("c", 2)):
        base, _ = site(n)
        for i, (_, _, page, _) in enumerate(base):
            extra = "".join(f"<p>line {k} stands on {k} pages of this host</p>" for k in (2, 3, 4, 5, 6, 18, 19, 30, 31) if i < k)
            rows.append((len(rows), f"http://{h}.example/{rng.random()}", rng.choice(["<article>%s</article>", "%s"]) % (page + extra) if i % 5 else page + extra))
    rows.append((len(rows), "http://a.example/empty", "<p>short</p>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    found = {}
    for limit in (1000, 30, 7, 1):
        monkeypatch.setattr(H, "HOST_PAGES", limit)
        found[limit] = sorted(map(tuple, H.extract(df).collect()))
    assert len(found[1000]) == len(rows) and len({t for _, _, t, _, _ in found[1000]}) > 50
    for limit in (30, 7, 1):
        assert found[limit] == found[1000]
