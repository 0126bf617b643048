import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import cross_polytope, line_blocks, url_rules

URLS = ["https://Sub.Example.ORG/es/1?x#y", "http://example.org/en/1", "http://example.org/en/2", "http://notexample.org/es/", "http://org", "x.org/es/", None, "", "ftp://a.com/de/", "http://com/fr/a", "http://a.fr/com/de/", "http://EXAMPLE.org/es/?q=://x", "://", "http://a.com?/de/", "http://a.com/fr", "http://a..com/fr/", "http://b.org:80/es/"]


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = next((rest[:i] for i, c in enumerate(rest) if c in "/?#"), rest)
    path = rest[len(host) :]
    path = next((path[:i] for i, c in enumerate(path) if c in "?#"), path)
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host + r.path), len(r.host), r.action == "block"), default=None)
    return host, path, best and best.host + best.path, best.action if best else "allow"


@pytest.mark.parametrize("rules", [url_rules.RULES, (), (url_rules.Rule("block", "a.com", ""), url_rules.Rule("allow", "a.com", "/fr"), url_rules.Rule("block", "org", "/e"))])
def test_url_rules_match_brute_force(spark, rules):
    rows = [(k % 12, u) for k, u in enumerate(URLS * 2)] + [(None, "http://x.example.org/es/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("z") for c in ("host", "rule", "digest", "head")})
    got = sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in url_rules.judge_urls(pages, rules).collect())
    want = []
    for p, u in rows:
        h, path, rule, verdict = brute(u, rules)
        want.append((str(p), h, path, str(rule), verdict))
    assert got == sorted(want)
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0


def test_rule_hosts_fold_a_to_z_only(spark):
    pages = spark.createDataFrame([(1, "http://ÉCOLE.org/a"), (2, "http://école.org/a")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_rules.judge_urls(pages, (url_rules.Rule("block", "ÉCOLE.ORG", "/"),)).collect()}
    assert got == {1: "block", 2: "allow"}


def test_url_rules_run_no_python(spark):
    pages = spark.createDataFrame([(1, URLS[0])], "page_id long, url string")
    plan = url_rules.judge_urls(pages)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


PAGES = {
    "<nav><a href=/>Menu</a></nav><article><h1>Title</h1><p>First  para.<br><p><b>Second &amp; third</b></p></article><footer>x</footer>": "Title\nFirst para.\nSecond & third",
    "<body><header>Top</header><main><p>A</p><aside>side</aside><p>B</p><div class='ad-box'>buy</div><section id=comments><p>rude</p></section><form>f<p>g</p></form><p>C</p></main>": "A\nB\nC",
    "<script>var t='</p><p>no</p>';</script><style>p{}</style><article><p>x<script>1<2</script>y</p></article": "xy",
    "<article><p>cut in the mid": "cut in the mid",
    "<article><p>&lt;b&gt; &eacute; &#233; &nope; &amp</p><!-- <p>no</p> --></article>": "<b> é é &nope; &",
    "<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>": "one\ntwo\na\nb",
    "<article><p>a&nbsp;&nbsp;b\n\tc</p></article>": "a b c",
    "<article><p hidden>no</p><p style='display: none'>no</p><div role=dialog>no</div><div class='cookie-notice'>no</div>yes</article>": "yes",
    "<article><p>t</p></article><article><p>u</p></article>": "t\nu",
    "": "",
    "plain words only, of some length": "plain words only, of some length",
}


def test_extraction_of_small_pages():
    for html, want in PAGES.items():
        assert line_blocks.main_text(html) == want, html
    assert line_blocks.main_text(None) == ""


def test_surge_and_dive_without_an_article():
    body = [f"<p>This is paragraph {k} of the text and it has some words in it.</p>" for k in range(6)]
    menu = "".join(f"<div><a href=/{k}>Entry {k}</a></div>" for k in range(8))
    html = f"<body><div>{menu}</div><p>Short.</p>" + "".join(body[:3]) + "<p>Yes.</p>" + "".join(body[3:]) + f"<div>{menu}</div><p>Bye</p></body>"
    text = line_blocks.main_text(html)
    assert "Entry" not in text and "Yes." in text and text.count("paragraph") == 6 and "Bye" not in text


def test_text_broken_by_short_items_is_kept_whole():
    items = [f"Entry number {k} of six."[:20] for k in range(6)]
    lines = ["a" * 300, *items, "b" * 280, "c" * 200]
    menu = "".join(f"<div><a href=/{k}>Go {k}</a></div>" for k in range(8))
    html = "<body>" + menu + f"<p>{lines[0]}</p><ul>" + "".join(f"<li>{x}</li>" for x in items) + f"</ul><p>{lines[7]}</p><p>{lines[8]}</p>" + menu + "</body>"
    assert line_blocks.main_text(html) == "\n".join(lines)
    assert line_blocks.main_text(f"<p>{lines[0]}</p>{menu}<p>{lines[8]}</p>") == lines[0] + "\n" + lines[8]


def test_linked_text_of_an_article_is_kept():
    page = "<article><h1><a href=/>Headline</a></h1><p>Text.</p><p><a href=/>One linked sentence.</a></p><ul>{}</ul></article>"
    refs = [f"Reference {k}" for k in range(5)]
    html = page.format("".join(f"<li><a href=/{k}>{x}</a></li>" for k, x in enumerate(refs)))
    assert line_blocks.main_text(f"<div><a href=/>Home</a></div>{html}") == "\n".join(["Headline", "Text.", "One linked sentence.", *refs])
    assert line_blocks.main_text("<article><h1><a href=/>Headline</a></h1></article><p>(c)</p>") == "Headline"
    teaser = "<article><a href=/>Teaser</a></article>"
    assert line_blocks.main_text(f"{teaser * 3}<p>{'a' * 100}</p>") == "a" * 100
    long, menu = "a" * 100, "".join(f"<div><a href=/{k}>Go {k}</a></div>" for k in range(3))
    assert line_blocks.main_text(f"{menu}<p>{long}</p><p>see <a href=/>a long title</a></p><p>{long}</p>{menu}") == f"{long}\nsee a long title\n{long}"


def test_classes_that_only_contain_a_noise_word_are_text():
    text = ["<h2 id='search'>A</h2>", "<section id='related-work'>B</section>", "<p class='section-header'>C</p>", "<div class='share-price'>D</div>", "<div class='skip-intro'>E</div>", "<p class='notice'>F</p>", "<div id='réseau-social'>G</div>", "<div class='lead-story social-history'>H</div>"]
    noise = ["<div class='ad-box'>no</div>", "<div class='wide related-posts'>no</div>", "<div id='ad_3'>no</div>", "<section class=comments>no</section>", "<div class='share-buttons'>no</div>", "<div class='nav__item'>no</div>"]
    html = "".join(a + b for a, b in zip(text, noise + ["", ""]))
    assert line_blocks.main_text(f"<article>{html}</article>") == "\n".join("ABCDEFGH")
    body = "a" * 100
    assert line_blocks.main_text(f"<p class='notice'>no</p><div class='share-price'>{body}</div><p class='ad-box'>no</p>") == body


def test_surge_and_dive_by_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        weight = [rng.choice([0, 0, 3, 12, 30, 60, 200]) for _ in range(rng.randrange(0, 12))]
        config = line_blocks.LineBlockConfig(window=rng.randrange(1, 5), surge=rng.choice([1, 40, 80, 300]))
        sums = [sum(weight[k : k + config.window]) for k in range(len(weight))]
        high = [k for k, s in enumerate(sums) if s >= min(config.surge, max(sums)) and s > 0]
        kept = [j for j, w in enumerate(weight) if w and high and high[0] <= j < high[-1] + config.window]
        a, b = line_blocks.surge_and_dive(weight, config)
        assert [j for j in range(a, b) if weight[j]] == kept and (not kept or (weight[a] and weight[b - 1]))


def test_windows_decide_which_marked_articles_are_text():
    long = "<p>" + "a" * 90 + "</p>"
    cards = "".join(f"<article>Card {k}</article><div>no</div><div>no</div>" for k in range(2))
    page = f"{cards}<article><h1>T</h1><p>s</p><p>s</p><p>s</p>{long}<p>s</p><p>s</p><p>e</p></article><div>no</div><div>no</div>{cards}"
    assert line_blocks.main_text(page) == "\n".join(["T", "s", "s", "s", "a" * 90, "s", "s", "e"])
    wide = line_blocks.LineBlockConfig(surge=1)
    assert line_blocks.main_text(page, wide).count("Card") == 4


@pytest.mark.parametrize("html", ["<b>x</i>" * 60_000, "<a " * 160_000 + '"', "<div>" * 100_000 + "x", "<li><b>" + "<b><div>" * 50_000, "<" * 500_000, "<!--" * 120_000, "<p " + "'" * 400_001, "<p><b>" * 80_000, "<table><tr><td>" * 30_000, "<script>" * 60_000])
def test_hostile_pages_take_seconds(html):
    start = time.monotonic()
    line_blocks.main_text(html)
    assert time.monotonic() - start < 8


def test_extraction_query(spark):
    rows = [(k, f"http://u/{k}", h) for k, h in enumerate(PAGES)] + [(None, None, None), (3, "http://u/3", "<p>twice</p>"), (3, "http://u/3", "<p>twice</p>"), (99, "u", "<article>" + "<p>long text</p>" * 20000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("id", "text", "n_chars")})
    out = line_blocks.extract_pages(pages).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    assert {r.n_chars for r in out if r.page_id == 99} == {20000 * 10 - 1}
    assert line_blocks.extract_pages(pages.limit(0)).count() == 0


def vectors():
    rng = np.random.default_rng(5)
    rows = []
    for k in range(300):
        rows.append((k, rng.normal(size=16).tolist(), k % 3))
    for c in range(6):
        center = rng.normal(size=16)
        for _ in range(25):
            rows.append((len(rows), (center + 0.04 * rng.normal(size=16)).tolist(), c % 3))
    rows += [(len(rows) + k, rows[0][1], 0) for k in range(5)]
    rows += [(len(rows), [2 * x for x in rows[0][1]], 0)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] + [1.0] * 15, 0), (n + 3, [None] + [1.0] * 15, 0), (n + 4, rows[0][1], None), (n + 5, rows[0][1][:8], 0), (n + 6, [], 0), (n + 7, [float("inf")] * 16, 0), (None, rows[0][1], 0)]
    random.Random(1).shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [512, 7])
def test_vector_links_match_brute_force(spark, block):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("z") for c in ("id", "rep", "codes", "a", "n_links", "component_id", "root")})
    out = {r.vec_id: r for r in cross_polytope.link_vectors(df, cross_polytope.PolytopeConfig(block=block)).collect()}
    good = [r for r in rows if r[0] is not None and r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links = {r[0]: set() for r in rows if r[0] is not None}
    for i, a in enumerate(good):
        for b in good[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]) and np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.98:
                links[a[0]].add(b[0])
                links[b[0]].add(a[0])
    assert len(out) == len(rows) and out[None].kept and out[None].n_links == 0
    found = sum(out[k].n_links for k in links)
    assert found == sum(map(len, links.values())) and all(out[k].n_links == len(v) for k, v in links.items())
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        assert out[k].component_id == min(seen) and out[k].kept == (k == min(seen))


def test_hadamard_keeps_lengths_and_inverts():
    x = np.random.default_rng(0).normal(size=(5, 32))
    y = cross_polytope.hadamard(x)
    assert np.allclose((x**2).sum(1), (y**2).sum(1)) and np.allclose(cross_polytope.hadamard(y), x)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert cross_polytope.link_vectors(df).count() == 0


def test_vectors_that_repeat_an_id(spark):
    rows = [(1, [1.0, 0, 0, 0], 0), (1, [0, 1.0, 0, 0], 0), (2, [1, 0.01, 0, 0], 0), (3, [0, 1, 0.01, 0], 0), (4, [0, 0, 0, 1.0], 0), (4, [0, 0, 0, 2.0], 0), (4, [0, 0, 0, 2.0], 1)]
    df = spark.createDataFrame([(i, [float(x) for x in v], g) for i, v, g in rows], "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in cross_polytope.link_vectors(df).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True), (4, 1, 4, True), (4, 1, 4, True)]


@pytest.mark.parametrize("width", [2, 3, 4, 5, 6])
def test_recall_at_every_width(width):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * noise
    config = cross_polytope.PolytopeConfig()
    a, b = (cross_polytope.bucket_codes(z, config, width) for z in (x, y))
    found = np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b, strict=True)])
    assert found >= 0.98
