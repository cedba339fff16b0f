"""Collocations, page text and lexical search against plain versions and SQL."""

import collections
import html
import math
import random
import re

import duckdb
import numpy as np
import pytest

from basketry.llm import collocations, entry, html_text, lexical_search
from tests.conftest import SF_DIR
from tests.llm.conftest import SCHEMA, prose, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_sql(name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    found = c.execute(entry.oracle_sql()[name])
    return [d[0] for d in found.description], found.fetchall()


@pytest.mark.parametrize("name", ["op11_collocations", "op13_lexical_search"])
def test_query_equals_sql(spark, name):
    columns, want = by_sql(name)
    got = [tuple(r) for r in entry.queries()[name](spark, SF_DIR).select(*columns).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and want


def plain_collocations(rows, limit, least):
    """All phrases counted, nothing pruned."""
    out, counts, totals = [], collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            own = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(own)
            for k in range(1, 5):
                for i in range(len(own) - k + 1):
                    counts[lang][tuple(own[i:i + k])] += 1
    for lang, f in counts.items():
        ranked = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            inside = lambda q: any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and n >= least and 100 * n >= 80 * a and inside(q) for q, n in f.items()):
                continue
            ranked.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(ranked)[:limit], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("limit, frontier", [(3, 1), (40, 1), (2000, 4)])
def test_collocations_against_all_phrases(spark, limit, frontier):
    """Small limits need several rounds; ties, overlapping repeats and covered phrases occur."""
    rng = random.Random(5)
    vocabulary = words(rng, 14)
    fixed = [" ".join(rng.choice(vocabulary) for _ in range(5)) for _ in range(4)]
    rows = []
    for i in range(160):
        parts = [rng.choice(vocabulary) if rng.random() < 0.7 else rng.choice(fixed) for _ in range(rng.randint(0, 14))]
        rows.append((i, rng.choice([" ", "\t", ". ", "\n", " ! "]).join(parts), rng.choice(["en", "de", None]), "s", 0))
    rows += [(900 + i, "Rare Pair x x x x x", "fr", "s", 0) for i in range(3)]
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA), limit, 3, frontier)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain_collocations([(r[2], r[1]) for r in rows], limit, 3)
    assert sorted(tuple(r) for r in got.collect()) == want and {r[0] for r in want} == {"en", "de", "fr", "und"}


def test_collocations_of_odd_rows(spark, odd, no_rows):
    got = collocations.collocations(odd, 50, 2)
    want = plain_collocations([(r.lang, r.text) for r in odd.collect() if len(r.text or "") < 9000], 50, 2)
    langs = {"de"}  # the very long text
    assert sorted(tuple(r) for r in got.where("lang != 'de'").collect()) == [w for w in want if w[0] not in langs]
    assert got.where("lang = 'de'").count() == 50
    assert collocations.collocations(no_rows).count() == 0


def test_share_is_exact_beyond_64_bits(spark):
    rows = spark.createDataFrame([(2**62 - 1, 2**62, 2**62 - 3)], "a long, l long, r long")
    got = rows.select(collocations.share("l", "r").alias("x")).first().x
    assert got == 2_000_000 * (2**62 - 1) // (2**63 - 3)


def plain_search(docs, items, size):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    vectors = [(i, collections.Counter(terms(t))) for i, t in docs]
    vectors = [(i, v) for i, v in vectors if v]
    total, length = len(vectors), sum(sum(v.values()) for _, v in vectors)
    df = collections.Counter(t for _, v in vectors for t in v)
    out = []
    for item, text in items:
        found = []
        for doc, v in vectors:
            m = 50 + 50 * sum(v.values()) * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * v[t] // (1000 * v[t] + 20 * m))
                        for t in set(terms(text)) if v[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, k, None if none else doc, -score) for k, (score, none, doc) in enumerate(sorted(found)[:size], 1)]
    return sorted(out, key=str)


def test_search_against_all_products(spark, odd, monkeypatch):
    rng = random.Random(8)
    docs = [(i, prose(rng, rng.randint(1, 90)), "en", "s", 0) for i in range(300)]
    docs += [(1000 - i, docs[5][1], "en", "s", 0) for i in range(70)]  # ties beyond the last place
    docs += [tuple(r)[:5] for r in odd.collect()]
    items = [(i, " ".join(docs[i][1].split()[:12])) for i in range(0, 40, 5)] + [(5, docs[5][1]), (5, "One"), (70, ""), (71, None), (72, "!!")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    want = plain_search([(d[0], d[1]) for d in docs], [x for x in items if x[1]], 20)
    for tree, leaf, block in ((2048, 64, 1 << 18), (50, 4, 60)):
        monkeypatch.setattr(lexical_search, "TREE_DOCS", tree)
        monkeypatch.setattr(lexical_search.build, "__defaults__", (leaf,))
        got = lexical_search.search(spark.createDataFrame(docs, SCHEMA).repartition(3), frame, 20, block)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_search_of_empty_tables(spark, no_rows):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical_search.search(no_rows, items).count() == 0
    assert lexical_search.search(spark.createDataFrame([(1, "one", "en", "s", 3)], SCHEMA), items.limit(0)).count() == 0


def test_bounds_hold_for_every_document_below_a_node():
    rng = np.random.default_rng(4)
    width = 60
    parts = [np.sort(rng.choice(width, rng.integers(1, 12), replace=False)).astype(np.int32) for _ in range(500)]
    rows = lexical_search.Rows(np.append(0, np.cumsum([len(p) for p in parts])), np.concatenate(parts), rng.integers(1, 10**6, sum(map(len, parts))))
    tree = lexical_search.build(np.arange(500), np.ones(500, bool), rows, width, 16)
    kept = lexical_search.Tree(**{n: getattr(tree, n).astype(k) for n, k in lexical_search.KINDS.items()})
    terms = [np.sort(rng.choice(width, 6, replace=False)).astype(np.int32) for _ in range(20)]
    items = lexical_search.Items(np.arange(20), lexical_search.Rows(np.arange(0, 121, 6), np.concatenate(terms), rng.integers(1, 9000, 120)), width)
    reader = lexical_search.Reader(kept, items)
    for item in range(20):
        weights = np.zeros(width, dtype=np.int64)
        weights[terms[item]] = items.rows.values[item * 6:item * 6 + 6]
        scores = lexical_search.Rows(kept.starts, kept.terms, kept.values.astype(np.int64)).dot(weights)
        for node in range(len(kept.begins)):
            assert scores[kept.begins[node]:kept.ends[node]].max() <= reader.bounds[node, item]
    assert sorted(kept.ids.tolist()) == list(range(500))


PAGES = [
    ("", ""),
    ("plain words without a tag &amp; more of them so that the block is long enough to be read as the text of a page on its own here, yes", None),
    ('<body><header><a href="/">Site</a></header><nav><ul><li><a href=x>A</a><li><a href=y>B</a></ul></nav><main><h1>Title</h1><p>Be.<p>One &lt;two&gt;'
     ' <b>th</b>ree<br>four</p></main><footer>&copy; x</footer>', "Title Be. One <two> three four"),
    ('<div class="cookie-notice">We use cookies <button>OK</button></div><article class="post"><header><h1>T &eacute;</h1></header><p>Text&nbsp;here.</p>'
     '<aside>Ad</aside><form><label>Mail</label><input><button>Go</button></form><div class="share-buttons">Share this</div></article>'
     '<section id="comments"><article class="comment"><p>I like this very much and write a long remark about it, so long that it could be a text.</p></article></section>',
     "T é Text here."),
    ('<form id="aspnet"><div id="sidebar"><h2>Links</h2></div><article><p>Inside a form</p><script>if (a < b) "</p>"</script><style>p{}</style>'
     '<!-- <p>no</p> --><noscript>no</noscript><textarea><p>no</p></textarea></article></form>', "Inside a form"),
    ('<article><p hidden>no</p><p style="display: none">no</p><p>yes</p><div class="ad-slot">no</div><p>and <a href="x>y">link</a></article>', "yes and link"),
    ('<article><p>kept</p><p title="never closed>lost? <p>next</article>', None),
    ("<article>a<![CDATA[x]]>b<?php no ?>c</3>d &#x41;&#66; &unknown; < 5", "abc</3>d AB &unknown; < 5"),
    ('<div class="has-sidebar"><div class="entry-content"><p>Few words.</p></div><div class="sidebar">no</div></div>', "Few words."),
]


def test_page_text():
    tree = html_text.grow(*html_text.labelled_blocks())
    for source, want in PAGES:
        text, blocks, kept = html_text.extract(source, tree)
        assert want is None or text == want, source
        assert kept <= blocks


def test_labelled_blocks_are_told_apart():
    rows, labels = html_text.labelled_blocks()
    right = 0
    for k in range(len(labels)):  # leave one out
        rest = np.arange(len(labels)) != k
        right += html_text.grow(rows[rest], labels[rest]).predict(rows[k:k + 1])[0] == labels[k]
    assert (html_text.grow(rows, labels).predict(rows) == labels).all() and right >= 0.85 * len(labels)


def test_tree_against_plain_gini():
    rng = np.random.default_rng(2)
    rows, labels = rng.integers(0, 6, (80, 3)).astype(float), rng.integers(0, 2, 80)
    gini = lambda y: len(y) * y.mean() * (1 - y.mean()) if len(y) else 0.0
    best = min((gini(labels[rows[:, j] <= t]) + gini(labels[rows[:, j] > t]), j, t) for j in range(3) for t in np.arange(0.5, 5))
    tree = html_text.grow(rows, labels, depth=1)
    assert (tree.feature[0], tree.threshold[0]) == best[1:]


def test_pages_of_the_tables(spark, no_rows):
    """Every page of the test tables holds one article element: its text is known."""
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    got = {r.page_id: r for r in entry.queries()["op12_html_text"](spark, SF_DIR).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", inner).replace("<b>", "").replace("</b>", "")).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_odd_pages(spark):
    long = "<article>" + "<p>word &amp; word</p>" * 60_000
    rows = [(1, "u", None), (1, "u", ""), (None, None, long), (2, "u", "<div>" * 30_000 + "x" + "</i>" * 30_000), (3, "u", "<a " + "'\">" * 30_000)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got[:2]] == [(1, "", 0), (1, "", 0)]
    assert got[2].page_id is None and got[2].text.count("word & word") == 60_000 and len(got) == 5
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0
