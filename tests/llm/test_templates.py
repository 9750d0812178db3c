"""Main text of pages: classes against brute force, and pages whose article is known."""

from __future__ import annotations

import html
import random
import re
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hirelens.llm import registry, templates

WORDS = "alpha beta gamma delta über naïve épsilon zeta eta theta iota".split()


def prose(rng, low=4, high=30):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(low, high))).capitalize() + "."


def frame(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("host", "template", "text", "n_chars", "uid", "token"):
        df = df.withColumn(name, F.lit("x"))
    return df


def texts(df):
    return {r.page_id: r.text for r in df.collect()}


def named(rng, blocks):
    """An article by its element, with all that may stand around and inside it."""
    body = "".join(f"<p>{html.escape(b)}</p>\n" for b in blocks[1:])
    return f"""<!DOCTYPE html><html><head><title>{prose(rng)}</title><style>p{{color:red}}</style></head><body class="no-sidebar">
<header><a href="/">Site {prose(rng)}</a></header><nav><ul>{''.join(f'<li><a>{w}</a>' for w in rng.sample(WORDS, 5))}</ul></nav>
<div class="cookie-notice">We use cookies. <button>OK</button></div><aside><h2>Popular</h2><p>{prose(rng)}</p></aside>
<article><h1>{html.escape(blocks[0])}</h1><div class="ad">{prose(rng)}</div>{body}<form><label>Mail</label><input><p>Subscribe</p></form>
<script>document.write("</p><p>no</p>")</script><section id="comments"><article><p>{prose(rng)}</p></article></section></article>
<div id="sidebar"><p>{prose(rng)}</p></div><footer>&copy; {prose(rng)}</footer><noscript>Please enable it</noscript></body></html>"""


def unnamed(rng, blocks):
    """No element or name tells the article: only its text varies and is long."""
    body = "".join(f"<p>{html.escape(b)}" for b in blocks[1:])
    return f"""<html><body><div id=a1><span>Home</span> <span>About us</span></div><div id=b2><p>This site asks for your consent to everything at once.</p></div>
<div id=q><h2>{html.escape(blocks[0])}</h2><div>{body}</div><ul><li>{html.escape(blocks[-1])} again</ul></div><div id=z9><p>Published by the makers of this site.</p></div></body></html>"""


@pytest.fixture(scope="module")
def site():
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(40):
        make, host = (named, "named.example") if i % 2 else (unnamed, "plain.example")
        blocks = [prose(rng) + f" {i} & <more>" for _ in range(rng.randint(3, 7))]
        rows.append((i, f"https://{host}/{i}?x#y", make(rng, blocks)))
        want[i] = "\n\n".join(blocks if i % 2 else [*blocks, blocks[-1] + " again"])
    return rows, want


def test_known_articles(spark, site):
    rows, want = site
    assert texts(templates.main_text(frame(spark, rows))) == want


def test_small_bound_for_broadcasts_gives_the_same(spark, site):
    rows, want = site
    assert texts(templates.main_text(frame(spark, rows), broadcast_bytes=0)) == want


def test_odd_rows(spark):
    page = "<article><h1>A &lt;b&gt;&nbsp;&amp;amp;</h1><p><b>one<br>two<p>  three \n\t four</article>"
    rows = [
        (1, "http://a.example/1", None),
        (2, None, ""),
        (3, None, page),
        (3, None, page),
        (None, "no scheme", page),
        (5, "http://b.example", "bare text &eacute;&#233; <b>bold</b>ly"),
        (6, "http://c.example", "<p>unclosed <a href='x>quote <div>in"),
        (7, "http://d.example", "<article>" + "<p>" + "long " * 200_000 + "</article><footer>f"),
        (8, "http://e.example", "<nav>only a menu</nav><script>"),
        (9, "http://f.example", "<!-- <article>no</article> --><main><header><h1>Head</h1></header>1 < 2 </p>and<hr>more</main>tail"),
    ]
    found = templates.main_text(frame(spark, rows)).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    by_id = {r.page_id: r.text for r in found}
    odd = "A <b> &amp;\n\none two\n\nthree four"
    assert by_id[1] == by_id[2] == by_id[8] == "" and by_id[3] == by_id[None] == odd
    assert by_id[5] == "bare text éé boldly"
    assert by_id[6] == "unclosed quote\n\nin"
    assert by_id[7] == ("long " * 200_000).strip()
    assert by_id[9] == "Head\n\n1 < 2\n\nand\n\nmore"


def test_equal_pages_keep_their_article(spark):
    """On a host of copies all text is as constant as the template; the article stays."""
    rng = random.Random(1)
    page = named(rng, ["Title", "Body one.", "Body two."])
    rows = [(i, "http://copies.example/", page) for i in range(30)]
    assert set(texts(templates.main_text(frame(spark, rows))).values()) == {"Title\n\nBody one.\n\nBody two."}


def test_no_rows(spark):
    assert templates.main_text(frame(spark, [])).collect() == []


def test_classes_are_those_of_whole_vectors(spark, site):
    """Fingerprints put the same tokens together as the vectors of occurrences themselves."""
    rows = [r for r in site[0] if "named" in r[1]]
    vectors = defaultdict(dict)
    for i, _, page in rows:
        for token, n in Counter((e[0], e[1] is None) for e in templates.events(page)).items():
            vectors[token][i] = n
    groups = defaultdict(set)
    for token, vector in vectors.items():
        if len(vector) >= 3:
            groups[frozenset(vector.items())].add(token)
    want = {frozenset(g) for g in groups.values() if len(g) > 1 and any(tag for _, tag in g)}
    batch = pd.DataFrame({"host": "h", "uid": [r[0] for r in rows], "html": [r[2] for r in rows]})
    sums = pd.concat(templates.counted(iter([batch])))
    found = templates.classes(sums[sums["pages"] >= 3])["classes"]
    assert {frozenset(zip(*map(tuple, c))) for c in found} == want


def test_classes_that_are_not_nested_are_dropped(spark):
    """Two classes of equal size that cross each other on some pages are no part of the template."""
    rng = random.Random(5)
    rows, want = [], {}
    for i in range(12):
        blocks = [prose(rng, 20, 40) + str(i) for _ in range(4)]
        mixed = ["<p>{}</p>".format(b) for b in blocks[:2]] + ["<h3>{}</h3>".format(b) for b in blocks[2:]]
        rng.shuffle(mixed)
        rows.append((i, "http://mixed.example", f"<html><body><nav>m</nav><article>{''.join(mixed)}</article></body></html>"))
        want[i] = "\n\n".join(re.findall(r">([^<]+)</(?:p|h3)", "".join(mixed)))
    assert texts(templates.main_text(frame(spark, rows))) == want


def test_whole_table(spark):
    """In the given pages the article is one element; all its blocks and nothing else come out."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html or "<article></article>", re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        want[r.page_id] = "\n\n".join(b for b in blocks if b)
    assert texts(registry.op13_main_text(spark, "/root/testdata/sf0.01")) == want and any(want.values())
