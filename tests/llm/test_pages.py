"""Main text of pages: markup cases by hand, and furniture that only a site's pages together show."""

import math
import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spanforge.llm import pages


def text(html):
    return pages.main_text(html or "", {})


def test_markup():
    assert text("<html><head><title>T</title><style>p{}</style><script>var a='</p><p>x';</script></head><body><nav><a>n</a></nav><div class='ad'>ad</div><article><h1>A &amp; B</h1><p>one <b>two<br>three</b>\n four</p><p>five<p>six</article><footer>f</footer>") == "A & B\n\none two three four\n\nfive\n\nsix"
    assert text("<body><header>top</header><main><header><h1>Title</h1></header><p>x</p><aside>side</aside><form><p>q</p></form><div class='comments'><p>c</p></div><div id=cookie-notice>n</div></main>") == "Title\n\nx"
    assert text("<article><p>a<!-- <p>no</p> -->b</p><p>1 < 2 &lt; 3</p><article class=comment><p>no</p></article></article>") == "ab\n\n1 < 2 < 3"
    assert text("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>") == "a\n\nb\n\nc\n\nd"
    assert text("<p>no article</p><div class='sidebar'>x</div><p hidden>y</p>") == "no article"
    assert text("<article><p>unclosed <b>bold<p>next</article><script>alert(1)") == "unclosed bold\n\nnext"
    assert text(None) == text("") == text("<nav>x</nav>") == ""
    assert text("plain") == "plain"
    assert text("<article><p>café &eacute;&#233;&nbsp;x</p></article>") == "café éé x"


def test_site_tree(spark):
    rng = random.Random(1)
    prose = lambda: " ".join(rng.choice("lorem ipsum dolor sit amet elit sed do".split()) + str(rng.randrange(99)) for _ in range(20))
    rows = [(k, f"https://Site.example:80/p{k}", f"<body><div class=strip><span>Welcome to our site</span><p>Call now {k % 2}</p></div><div class=story><p>{prose()}</p><p>{prose()}</p></div></body>", "m") for k in range(40)]
    rows += [(100, "https://lone.example/", "<body><div class=strip><p>Only here</p></div></body>", "m"), (101, None, None, "m"), (0, rows[0][1], rows[0][2], "m")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    out = pages.extract(df)
    assert out.columns == [*df.columns, "main_text"]
    got = sorted((r["page_id"], r["main_text"]) for r in out.collect())
    assert len(got) == 43 and not any("Welcome" in t or "Call now" in t for k, t in got if k < 100)
    assert all(t.count("\n\n") == 1 for k, t in got if k < 100) and (100, "Only here") in got and (101, "") in got
    assert sorted((r["page_id"], r["main_text"]) for r in pages.extract(df, max_broadcast_nodes=0).collect()) == got
    tree = [r["read"] for r in pages.style_tree(df.where("page_id < 100")).collect() if r["read"] is not None]
    assert min(tree) < 0.3 < max(tree)


def test_copies_and_empty(spark):
    same = "<body><div class=story><p>" + "copied words " * 30 + "</p></div></body>"
    df = spark.createDataFrame([(k, "http://a.example/", same) for k in range(30)], "page_id long, url string, html string")
    assert {r["main_text"] for r in pages.extract(df).collect()} == {("copied words " * 30).strip()}
    assert pages.extract(df.where("page_id > 99")).count() == 0


def generated(rng, hosts):
    """Pages of sites whose furniture has neutral names, with what should stay of each."""
    rows = []
    words = "lorem ipsum dolor sit amet elit sed do tempor".split()
    prose = lambda n=15: " ".join(rng.choice(words) + str(rng.randrange(999)) for _ in range(n))
    for h in range(hosts):
        links = [f"link{h}x{k}" for k in range(6)]
        for k in range(rng.randrange(15, 40)):
            story = [prose() for _ in range(rng.randrange(2, 6))]
            body = "".join(f"<p>{x}</p>" for x in story)
            page = f"<body><div class=k1><ul>{''.join(f'<li><a href=/>{x}</a></li>' for x in links)}</ul></div><div class=k2><div class=k3>{body}<div class=k6>Written by site {h}. Follow it.</div></div></div><div class=k4><p>Imprint of site {h}</p><p>Since 19{h:02d}</p></div></body>"
            rows.append((len(rows), f"https://h{h}.example/{k}", page, "\n\n".join(story)))
    return rows


def test_neutral_names(spark):
    """Furniture that no name gives away goes by the tree, inside the story too; without the tree it all stays."""
    rows = generated(random.Random(4), 6)
    out = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, want string")).collect()
    assert all(r["main_text"] == r["want"] for r in out) and len(out) == len(rows)
    assert all(text(r[2]) != r[3] for r in rows)


def test_neutral_names_and_texts_that_never_repeat(spark):
    """Furniture whose names are neutral and whose texts differ on every page: its constant presentation beside a main branch gives it away."""
    rng = random.Random(12)
    prose = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet elit sed".split()) + str(rng.randrange(999)) for _ in range(n))
    rows = []
    for h in range(4):
        for k in range(rng.randrange(20, 45)):
            story = [prose(6), *(prose(rng.randrange(5, 60)) for _ in range(rng.randrange(2, 14)))]
            links = "".join(f"<li><a href=/>{prose(1)}</a></li>" for _ in range(6))
            page = f"<body><div class=q1><ul>{links}</ul></div><div class=q2>{prose(9)}</div><div class=q3><h1>{story[0]}</h1>{''.join(f'<p>{x}</p>' for x in story[1:])}</div><div class=q4>{prose(8)}</div></body>"
            rows.append((len(rows), f"https://n{h}.example/{k}", page, "\n\n".join(story)))
    out = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, want string")).collect()
    assert sum(r["main_text"] == r["want"] for r in out) >= 0.9 * len(rows) and all(r["want"] in r["main_text"] for r in out)
    assert not any(text(r[2]) == r[3] for r in rows)


def test_tree_by_plain_python(spark):
    """Entropies, shares and composite importance against their definitions."""
    rows = generated(random.Random(7), 2)
    df = spark.createDataFrame([(r[1].split("/")[2], r[2]) for r in rows], "host string, html string")
    tree = {(r["host"], r["node"]): r for r in pages.style_tree(df.repartition(3)).collect()}
    seen = defaultdict(list)
    for _, url, page, _ in rows:
        children, texts, below = defaultdict(list), defaultdict(list), defaultdict(list)
        for path, t in pages.blocks(page):
            ids = pages.node_ids(path)
            for k in ids:
                below[k].append(len(t))
            for a, b in zip(ids, ids[1:], strict=False):
                if children[a][-1:] != [b]:
                    children[a].append(b)
            texts[ids[-1]].append(t)
        for k, x in [*((("look", n), (*children[n], len(c), math.floor(math.log2(sum(c))))) for n, c in below.items()), *((("read", n), tuple(c)) for n, c in texts.items())]:
            seen[(url.split("/")[2], *k)].append(x)
    for (host, kind, node), shown in seen.items():
        m = len(shown)
        h = -sum(n / m * math.log(n / m, m) for n in Counter(shown).values()) if m > 1 else 1
        r = tree[host, node]
        assert math.isclose(r[kind], (m * h + pages.EXTRA) / (m + pages.EXTRA), abs_tol=1e-9)
        if kind == "look":
            assert r["ways"] == len(set(shown)) and math.isclose(r["firm"], m * h / (m + pages.EXTRA), abs_tol=1e-9)
    assert {(h, n) for h, _, n in seen} == set(tree)
    site = {1: (0.5, 0.2, 2, False, 0.0), 2: (1.0, 0.1, 1, False, 0.0), 3: (0.0, 1.0, 1, False, 0.0)}
    value = pages.importance({2: (1, 1), 1: (0, None), 4: (2, 3), 3: (1, 1)}, {2: 10, 4: 30, 1: 5}, {1: 45, 2: 10, 3: 30, 4: 30}, site)
    three = 0.1 * 0.0 + 0.9 * 1.0
    assert value[2] == 0.1 and value[4] == 1 and math.isclose(value[3], three)
    assert math.isclose(value[1], 0.19 * 0.5 + 0.81 * (10 * 0.1 + 30 * three + 5 * 0.2) / 45)


def test_names_are_a_prior_inside_articles(spark):
    """A named container inside an article goes where the site has it on many pages or nothing is known; headings and paragraphs never go by name."""
    assert text("<article><h2 id=related-work>Related</h2><p class=notice-period>x</p><p>a <span class=social>b</span></p></article>") == "Related\n\nx\n\na b"
    rng = random.Random(9)
    rows = [(k, f"http://p.example/{k}", f"<article><p>story {rng.random()}</p>{'<section id=search-methods><p>We searched.</p></section>' if k == 3 else ''}<div class=newsletter><p>Mail {rng.random()}</p></div></article>") for k in range(60)]
    got = {r["page_id"]: r["main_text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert "We searched." in got[3] and not any("Mail" in t for t in got.values())


def test_long_pages_and_clashing_names(spark):
    long = "<article>" + "".join(f"<p>paragraph {k}</p>" for k in range(20_000)) + "</article>"
    df = spark.createDataFrame([(1, "http://a.example/", long, "x", "y", 3)], "page_id long, url string, html string, host string, nodes string, row int")
    r = pages.extract(df).first()
    assert r["main_text"].count("\n\n") == 19_999 and (r["host"], r["nodes"], r["row"]) == ("x", "y", 3)
    with pytest.raises(ValueError):
        pages.extract(df.withColumn("main_text", F.lit("")))


@pytest.mark.parametrize("html", ["<a x " * 200_000, "<div>x" * 20_000, "<x>" * 20_000 + "<p>y" * 20_000, "<p><div>" + "<x>" * 20_000 + "<p>y" * 20_000, "<div>x" * 20_000 + "</b>" * 20_000 + "</div>" * 20_000, "<table>" + "<tr><td>x" * 20_000, "<script>" + "</script x" * 50_000, "<!x" * 200_000, "<a b='" * 100_000, "<td>x<td><p>" * 20_000])
def test_long_and_bad_markup(html):
    """A megabyte of tags without an end, or twenty thousand elements in one another: seconds, with and without a site."""
    place = next(pages.blocks("<div>x"))[0]
    for site in ({}, {place.id: (0.1, 0.1, 2, True, 0.9)}):
        began = time.perf_counter()
        pages.main_text(html, site)
        list(pages.gathered(list(pages.blocks(html))))
        assert time.perf_counter() - began < 10


def test_nested_blocks():
    """Paths, ends of elements by others, and sequences of children as a plain reading has them."""
    page = "<div>a<p>b<p>c<ul><li>d<li>e<p>f</ul>g</div><table><tr><td>h<td><p>i<tr><td>j</table></b>k<p>l<div>m</p>n"
    got = [("/".join(x.node[0] for x in pages.path_of(p)), t) for p, t in pages.blocks(page)]
    assert got == [("div", "a"), ("div/p", "b"), ("div/p", "c"), ("div/ul/li", "d"), ("div/ul/li", "e"), ("div/ul/li/p", "f"), ("div", "g"), ("table/tr/td", "h"), ("table/tr/td/p", "i"), ("table/tr/td", "j"), ("", "k"), ("p", "l"), ("div", "m"), ("div", "n")]
    up, number, length, children, _ = pages.gathered(list(pages.blocks("<div><p>a<b>x</b></p><p>bb</p><ul><li>c</ul><p>d</div>")))
    names = {p.id: p.node[0] for p, _ in pages.blocks("<div>r<p>a<ul><li>c")} | {p.around.id: p.around.node[0] for p, _ in pages.blocks("<ul><li>c") if p.around}
    root = next(k for k, (d, _) in up.items() if d == 0)
    assert number[root] == 4 and length[root] == 6 and [names.get(c, "ul") for c in children[root]] == ["p", "ul", "p"]
