"""Each operator of the subpackage against brute force on small rows, with nulls, empty tables, repeats and further columns."""

import hashlib
import html as html_
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import decontam, html_extract, lm_score, mixing, near_dedup, quality_knn, quality_rules, registry, secrets, sharding, toxicity
from quarry.llm._common import Alphabet, connected_components, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, size int, __n long"
WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "pra", "sto", "tri") for b in ("n", "r", "s", "lle", "mon", "ter")]


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    rng = random.Random(4)
    texts = [text_of(rng, rng.randint(1, 120)) for _ in range(60)]
    texts += [texts[3]] * 6 + [texts[5].upper(), "  ".join(texts[7].split())]
    base = text_of(rng, 80).split()
    for _ in range(25):  # a chain of near copies
        base[rng.randrange(80)] = rng.choice(WORDS) + "x"
        texts.append(" ".join(base))
    texts += [None, "", " \n\t", "one", "one two", "One Two", text_of(rng, 6000)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), None, "x", 1, 2) for i, t in enumerate(texts)]
    return rows + [rows[2], rows[2], (None, texts[1], None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_words_and_hashes():
    texts = ["a b", "", "Ab  a", "é\x0bz", "b"]
    raw = [t.encode() for t in texts]
    w = words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), Alphabet())
    assert np.diff(w.first).tolist() == [2, 0, 2, 2, 1]
    h = w.hash.tolist()
    assert h[0] == h[3] and h[1] == h[6] and len(set(h)) == 5


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, 1000 + i) for i in range(1, 80)] + [(2000 + i, 2001 + i) for i in range(50)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def brute_components(rows, width, percent):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().translate(low).split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return [(r[0], len(s), least.get(root(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_dedup(spark, docs, none, width, percent, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", 4)  # buckets of several blocks
    monkeypatch.setattr(near_dedup, "HEAD_NODES", 4)
    key = lambda x: tuple((v is None, v or 0) for v in x)
    got = near_dedup.components(docs, width, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute_components(corpus(), width, percent), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dedup.components(none, width, percent).count() == 0
    kept = near_dedup.keep_one(docs, width, percent)
    # one row for each component, and each row without words
    groups = Counter(r.component_id for r in got if r.n_shingles)
    left = Counter((r.doc_id, r.text) for r in kept.collect())
    assert kept.columns == docs.columns and max(left.values()) == 1
    assert sorted(i for i, t in left if (t or "").split()) == sorted(groups) and sum(left.values()) == len(groups) + sum(not r.n_shingles for r in got)


def test_near_dedup_large_buckets(spark, monkeypatch):
    rng = random.Random(14)
    base = text_of(rng, 100).split()

    def changed(words_, n):
        words_ = list(words_)
        for k in rng.sample(range(len(words_)), n):
            words_[k] = f"x{rng.randrange(10**6)}"
        return words_

    # copies of one text with 1 or 2 words changed, most of them linked; and texts that share half and aren't
    rows = [" ".join(changed(base, rng.randint(1, 2))) for _ in range(250)]
    rows += [" ".join(base[:70] + [f"y{i}w{k}" for k in range(25)]) for i in range(250)]
    rows = [(i, t) for i, t in enumerate(rows)]
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", 64)
    monkeypatch.setattr(near_dedup, "HEAD_NODES", 50)
    got = near_dedup.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 3, 85)


def test_near_dedup_keeps_one_of_equal_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (1, text + " end"), (None, "a b c"), (None, "a b c"), (None, None), (None, None), (2, ""), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "array(doc_id) as `a.b`")
    got = near_dedup.keep_one(df)
    assert got.columns == df.columns
    assert Counter((r.doc_id, (r.text or "")[:2]) for r in got.collect()) == {(1, "w0"): 1, (None, "a "): 1, (None, ""): 2, (2, ""): 2}


def test_mixing(spark, docs, none):
    rows = mixing.amounts(docs).collect()
    assert len(rows) == len(corpus())
    size = Counter()
    for _, t, _, s, *_ in corpus():
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    target, open_, left = {}, {s: i % 3 + 1 for i, s in enumerate(order)}, float(sum(size.values()))
    while open_:  # clamp and share again until none is above
        level = left / sum(open_.values())
        over = [s for s, w in open_.items() if level * w > 3 * size[s]]
        if not over:
            target |= {s: level * w for s, w in open_.items()}
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
            del open_[s]
    taken = Counter()
    for r in rows:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    largest = max(r.size for r in rows)
    assert all(abs(taken[s] - target[s]) <= largest for s in size)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.amounts(docs.repartition(7)).collect()))
    assert mixing.mix(docs).count() == sum(r.times for r in rows) and mixing.mix(docs).columns == docs.columns
    assert mixing.amounts(none).count() == 0


def test_mixing_ties_and_names(spark):
    text = " ".join(["w"] * 100)
    # repeated rows, rows without ids, and columns with the names of what the operator adds
    rows = [(None, f"{text} {i}", "a") for i in range(30)] + [(5, text, "b")] * 40 + [(None, None, "b"), (None, text, None)]
    names = ["size", "h", "k", "row", "target", "times", "extra", "prefix", "__source"]
    df = spark.createDataFrame([(*r, *[i] * len(names)) for i, r in enumerate(rows)], "doc_id long, text string, source string, " + ", ".join(f"{x} long" for x in names)).repartition(3)
    got = mixing.amounts(df).collect()
    assert len(got) == len(rows)
    for s in ("a", "b", None):
        mine = [r for r in got if r.source == s]
        assert mine[0].target > 0 and abs(sum(r.taken for r in mine) - mine[0].target) <= 51
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    out = Counter(tuple(r) for r in mixed.collect())
    assert set(out) <= {(*r, *[i] * len(names)) for i, r in enumerate(rows)}
    taken = lambda rs: Counter((i, t, s) for (i, t, s, *_), n in rs for _ in range(n))
    assert Counter((i, len(t.split()), s) for i, t, s in taken(out.items()).elements() if t) == Counter({k: v for k, v in Counter(x for r in got for x in [(r.doc_id, r.size, r.source)] * r.times).items() if k[1]})


def test_sharding(spark, docs, none):
    rows = sharding.shard_table(docs).collect()
    assert len(rows) == len(corpus())
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    counts = [len(by.get(s, [])) for s in range(8)]
    assert max(counts) - min(counts) <= 1 and all(sorted(x) == list(range(len(x))) for x in by.values())
    import zlib

    want = sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in corpus())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == want
    copies = {r.shard for r in rows if r.doc_id in (3, *range(60, 66))}
    assert len(copies) == 1
    assert sharding.shard_table(none).count() == 0
    full = sharding.assign(docs)
    assert full.count() == len(corpus()) and full.columns == [*docs.columns, "shard", "slot"]


def test_sharding_beside_a_hot_group(spark):
    # a third of all rows has one text; pairs and larger groups stay whole beside it
    texts = ["hot"] * 600 + [f"pair {i}" for i in range(250) for _ in range(2)] + [f"five {i}" for i in range(40) for _ in range(5)] + ["hundred"] * 150 + [f"single {i}" for i in range(350)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = sharding.shard_table(df).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    counts = Counter(r.shard for r in rows)
    assert len(counts) == 8 and max(counts.values()) - min(counts.values()) <= 1
    assert len({(r.shard, r.slot) for r in rows}) == len(rows) and all(0 <= r.slot < counts[r.shard] for r in rows)
    where = {}
    for r in rows:
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert [t for t, x in where.items() if len(x) > 1] == ["hot"]


def test_sharding_keeps_groups_that_fit(spark):
    # five whole groups a shard leave no room at all
    df = spark.createDataFrame([(i, f"group {i % 40}") for i in range(800)], "doc_id long, text string").repartition(3)
    where = {}
    for r in sharding.shard_table(df).collect():
        where.setdefault(r.doc_id % 40, set()).add(r.shard)
    assert len(where) == 40 and all(len(x) == 1 for x in where.values())


def test_sharding_repeated_rows(spark, monkeypatch):
    rows = [(7, "same", 1, 2, 3)] * 40 + [(7, "same", 9, 9, 9)] + [(i, f"t{i}", 1, 1, 1) for i in range(60)] + [(None, None, 1, 1, 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, h long, shard long, row long").repartition(3)
    for listed in (10_000, 10):
        monkeypatch.setattr(sharding, "LISTED", listed)
        got = sharding.assign(df)
        assert got.columns == ["doc_id", "text", "h", "row", "shard", "slot"]
        got = got.collect()
        assert sorted(map(str, ((r.doc_id, r.text, r.h, r.row) for r in got))) == sorted(map(str, ((a, b, c, e) for a, b, c, _, e in rows)))
        assert len({(r.shard, r.slot) for r in got}) == len(rows) and set(Counter(r.shard for r in got).values()) == {13}


def test_sharding_fill():
    assert sharding._fill({5: 2, 3: 1, 2: 3}, [9, 10]) == ([(5, 1, 0, 2), (3, 0, 0, 1), (2, 0, 0, 3)], True)
    assert sharding._fill({7: 3}, [9, 9]) == ([(7, 0, 0, 1), (7, 1, 1, 2)], False)


def test_quality_rules(spark, none):
    rng = random.Random(9)
    good = [(i, ". ".join(text_of(rng, 12).capitalize() for _ in range(12)) + ".", "en") for i in range(80)]
    bad = [(100, " ".join(w + "***$$$" for w in text_of(rng, 120).split()), "en"), (101, "x y z w v " * 40, "en"), (102, "short text", "en"), (103, None, "en"), (104, "", None)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    assert sum(got[i].kept for i, *_ in good) >= 78 and not any(got[i].kept for i, *_ in bad)
    for i, t, _ in good[:10] + bad:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        wins = {}
        for k in range(len(w) - 4):
            wins.setdefault(tuple(w[k : k + 5]), []).append(k)
        cover = {x for v in wins.values() if len(v) > 1 for k in v for x in range(k, k + 5)}
        ls = [x for x in (t or "").split("\n") if x.split()]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(ls) - len(set(ls)), len(cover))
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w))
    assert quality_rules.keep(df).count() == sum(r.kept for r in got.values()) and quality_rules.judge(none).count() == 0
    p = np.array([[0.5, 0.5], [1.0, 0.0]])
    assert np.allclose(quality_rules.distance(p, np.array([0.5, 0.5])), [0, 0.5579230452841438])


def test_html():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><ul><li><a href=x>Home</a></ul></header><div class="cookie-notice">We use cookies.</div><div id=main>
<h2>Title &amp; more</h2><p>First  para, with text. And <a href=y>link</a>&nbsp;here.<p>Second &lt;para&gt;.<ul><li>one<li>two</ul></div><aside>Other, things.</aside>
<section id="comments"><p>Nice post, thanks. I liked it.</p></section><form><label>Name</label></form><footer>c</footer><script>x="<p>no</p>"</script></body></html>"""
    assert html_extract.main_text(page) == "Title & more\nFirst para, with text. And link here.\nSecond <para>.\none\ntwo"
    assert [html_extract.main_text(x) for x in ("", "plain  text", "<p", "<p></p>", "a &lt; b")] == ["", "plain text", "", "", "a < b"]
    long = "".join(f"<p>Sentence {i}, of some length.</p>" for i in range(3000))
    assert html_extract.main_text(f"<body><nav>x</nav><article><h1>H</h1>{long}</article></body>").count("\n") == 3000


def test_html_roots():
    story = "".join(f"<p>Sentence {i}, which tells part of the story, at some length.</p>" for i in range(8))
    told = "\n".join(f"Sentence {i}, which tells part of the story, at some length." for i in range(8))
    # a teaser is no root: the story outside it stays
    got = html_extract.main_text(f"<body><div class=content><h1>Title</h1>{story}</div><article class=card><p>Teaser, short.</p></article></body>")
    assert got.startswith("Title\n" + told)
    # short articles beside a long one stay
    short = "<article><h2>Second</h2><p>A short piece, complete in itself.</p></article>"
    assert html_extract.main_text(f"<body><article><h2>First</h2>{story}</article>{short}</body>") == f"First\n{told}\nSecond\nA short piece, complete in itself."
    # title and lead outside the deepest block with the bulk
    got = html_extract.main_text(f"<body><div><h1>Title of it</h1><p>The lead, which says what happened.</p><div class=body>{story}</div></div></body>")
    assert got == f"Title of it\nThe lead, which says what happened.\n{told}"
    # paths under the threshold: link lists without a telling name
    links = "<ul>" + "".join(f"<li><a href=x{i}>Go to {i}</a></li>" for i in range(9)) + "</ul>"
    got = html_extract.main_text(f"<body><article><h1>Title</h1>{story}<div>{links}</div></article></body>")
    assert got.startswith("Title\n" + told) and "Go to 5" not in got


def test_html_names():
    story = "".join(f"<p>Sentence {i}, which tells part of the story, at some length.</p>" for i in range(8))
    told = "Title\n" + "\n".join(f"Sentence {i}, which tells part of the story, at some length." for i in range(8))
    ad = "<div class=ad><p>Buy it, now. Really.</p></div><div class='menu-list'><p>Home, and more.</p></div>"
    for tag, names in [("div", "layout has-sidebar"), ("div", "with-sidebar"), ("article", "post comments-open"), ("article", "post category-legal tag-search"), ("div", "no-ads"), ("div", "hasSidebar"), ("div", "sidebar-left layout"), ("article", "promo")]:
        assert html_extract.main_text(f"<body><{tag} class='{names}'><h1>Title</h1>{story}{ad}</{tag}></body>") == told, names
    # small elements with names of states beside the story, and long comments apart from the article
    assert html_extract.main_text(f"<body><div><h1>Title</h1>{story}</div><div class=no-ads><p>More of it, at the end.</p></div></body>") == told + "\nMore of it, at the end."
    comments = "<section class=comments>" + "<p>I liked it, thanks. A long reply, by a reader, of some length.</p>" * 40 + "</section>"
    assert html_extract.main_text(f"<body><main><article><h1>Title</h1>{story}</article>{comments}</main></body>") == told


def naive_main_text(page):
    """The same definition with whole paths as strings, ancestors walked and every sum recomputed."""
    parsed = html_extract._Page(page)
    live = [x for x in parsed.nodes if x.text and not x.at.dropped]
    some = [x for x in live if x.text.strip()]
    if not some:
        return ""

    def line(e):
        return [e, *line(e.parent)] if e.parent is not None else [e]

    def scored(prior):
        of = [tuple(y.path for y in line(x.at)) for x in some]
        text, punct = {}, {}
        for path in set(of):
            mine = [x for x, p in zip(some, of) if p == path]
            chars = sum(len(x.text.strip()) for x in mine)
            free = 1 - sum(len(x.text.strip()) for x in mine if any(y.tag == "a" for y in line(x.at))) / chars
            text[path] = chars / len(mine) * free
            punct[path] = np.log1p((1 + sum(len(html_extract._PUNCT.findall(x.text)) for x in mine)) / len(mine) * free)
        gauss = [np.exp(-(k**2) / 2) for k in range(-2, 3)]

        def smooth(v):
            if len(v) < 3:
                return v
            return [sum(g * v[min(max(i + k - 2, 0), len(v) - 1)] for k, g in enumerate(gauss)) / sum(gauss) for i in range(len(v))]

        fused = [a * b for a, b in zip(smooth([text[p] for p in of]), smooth([punct[p] for p in of]))]
        mean = {p: np.mean([f for f, q in zip(fused, of) if p == q]) for p in set(of)}
        out = [mean[p] * (html_extract.PRIOR if prior(x.at) else 1.0) for x, p in zip(some, of)]
        return out, 0.1 * np.std(list({(p, s): s for p, s in zip(of, out)}.values()))

    def weight(e, scores, cut):
        return sum(len(x.text.strip()) * (0.1 if x.at.link else 1.0) for x, s in zip(some, scores) if s >= cut and e in line(x.at))

    scores, cut = scored(lambda e: False)
    top = parsed.elements[0]

    def void(e):
        apart = [r for r in parsed.elements if r.root and e not in line(r) and r not in line(e)]
        apart = [r for r in apart if not any(y in apart for y in line(r)[1:])]
        all_ = weight(top, scores, cut)
        return e.often and weight(e, scores, cut) > 0.5 * all_ and sum(weight(r, scores, cut) for r in apart) < 0.1 * all_

    stays = {e for e in parsed.elements if e.marked and not void(e)}
    marked = lambda e: any(y in stays for y in line(e))
    scores, cut = scored(marked)
    all_ = weight(top, scores, cut)
    roots = [e for e in parsed.elements if e.root and weight(e, scores, cut) > 0]
    if sum(weight(e, scores, cut) for e in roots if not any(y in roots for y in line(e)[1:])) < 0.75 * all_:
        fit = [e for e in parsed.elements if weight(e, scores, cut) >= 0.75 * all_ and (e.tag in html_extract._BLOCK or e is top)]
        deep = max(fit, key=lambda e: e.depth)
        roots = [deep.parent if deep.tag in ("p", "h1", "h2", "h3", "li", "blockquote", "pre", "td") else deep]
    kept = [x for x, s in zip(some, scores) if s >= cut or not x.at.link and not marked(x.at) and any(y in roots for y in line(x.at))]
    out = {}
    for x in live:
        if any(x.block == y.block for y in kept) and (x in kept or not marked(x.at)):
            out[x.block] = out.get(x.block, "") + x.text
    return "\n".join(" ".join(v.split()) for v in out.values() if v.split())


def test_html_against_naive():
    rng = random.Random(23)
    tags = ["div", "p", "p", "span", "b", "a href=x", "ul", "li", "nav", "article", "section class=comments", "div class='ad-box'", "h2", "footer", "form", "header", "main", "div class=has-sidebar", "table", "tr", "td", "aside", "br", "script", "div id=related-posts"]

    def tree(depth):
        out = ""
        for _ in range(rng.randint(1, 4)):
            tag = rng.choice(tags)
            body = text_of(rng, rng.randint(1, 25)) + rng.choice(["", ".", ", so. "])
            inner = tree(depth - 1) if depth and rng.random() < 0.7 else body
            out += f"<{tag}>{inner}" + (f"</{tag.split()[0]}>" if rng.random() < 0.9 else "") + rng.choice(["", body, " "])
        return out

    pages = ["<body>" + tree(4) for _ in range(120)]
    assert [html_extract.main_text(x) for x in pages] == [naive_main_text(x) for x in pages]


def test_html_scores_decide(monkeypatch):
    story = "".join(f"<p>Sentence {i}, which tells part of the story, at some length.</p>" for i in range(8))
    page = f"<body><nav>Home, <a href=x>About</a></nav><article><h1>Title</h1>{story}<p><a href=y>More, elsewhere.</a></p></article></body>"
    got = html_extract.main_text(page)
    assert got.startswith("Title\nSentence 0") and "Home" not in got
    monkeypatch.setattr(html_extract, "path_scores", lambda found: np.ones(len(found)))
    monkeypatch.setattr(html_extract, "_threshold", lambda found, scores: 0.0)
    assert html_extract.main_text(page) != got


def test_html_names_quotes_and_nesting():
    said = "<p>There it is, at last, in full. And on it goes.</p>"
    for open_ in ("<div class='side-by-side'>", "<div class=tags-explained>", "<h1 class=post-header>", "<p class='it's'>", "<p title=it's class=x>", "<div data-x='a>b'>"):
        assert html_extract.main_text(f"<body>{said * 3}{open_}Hello you").endswith("Hello you"), open_
    assert [html_extract.marks(x) for x in ("ad", "comment-list", "relatedPosts", "site-footer", "sidebar_2", "no-ads", "comments-open", "article-footer", "byline")] == [True] * 5 + [False] * 4
    assert html_extract.main_text("<div>" * 50_000 + "deep") == "deep"
    assert html_extract.main_text("<div class=y>x " * 5_000).count("x") == 5_000


def test_html_table(spark):
    rows = [(1, "u", "<article><p>" + html_.escape("a & b") + "</article>", "x", 1), (2, None, None, "y", 1)]
    pages = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string, text string, n_chars int")
    assert sorted((r.page_id, r.url, r.text, r.n_chars) for r in html_extract.extract(pages).collect()) == [(1, "u", "a & b", 5)] * 2 + [(2, None, "", 0)]
    assert html_extract.extract(pages.limit(0)).count() == 0


MORE = (("github", re.compile("gh[pousr]_[A-Za-z0-9]+"), lambda m: len(m[0]) >= 40), ("pem", re.compile("-----BEGIN [A-Z ]*PRIVATE KEY-----"), lambda m: True), ("slack", re.compile("xox[abeoprs]-[A-Za-z0-9-]+"), lambda m: len(m[0]) >= 15))
BASE = (("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24))


def test_secrets():
    rng = random.Random(2)
    parts = ["token", "secret", "=", ":", " ", '"', "'", "api_key", "apikey", "PassWord", "passwd", "abcdef", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "\n", "x", "-", "token=secret:abcdef", "token=token:abcdef", "ghp_", "Zz9" * 13, "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "xoxb-", "xoxp-1234-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)] + [None, "", "0" * 5000, "é" * 700 + " token = abcdefg", "token = " * 3000 + "x" * 9]
    out = [x for b in secrets._scan([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])]) for x in b.to_pylist()]
    for t, r in zip(texts, out):
        found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in p.finditer(t or "") if ok(m))
        told = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in found)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest(), (t, told, r)
        every = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE + MORE) for m in p.finditer(t or "") if ok(m))
        assert r["spans"] == ",".join(f"{(BASE + MORE)[k][0]}:{a}:{b}" for a, k, b in every), (t, r)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in found) for i in range(3)]


def test_secrets_table(spark, docs, none):
    assert secrets.find_secrets(docs).count() == len(corpus()) and secrets.find_secrets(none).count() == 0


def labelled(spark, n, seed, mark):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        y = int(rng.random() < 0.3)
        ss = [text_of(rng, 8) + "." for _ in range(rng.randint(2, 8))]
        if y:
            k = rng.randrange(len(ss))
            ss[k] = mark(ss[k], rng)
        rows.append((i, " ".join(ss)))
        labels.append((i, 1 - y, y))
    return spark.createDataFrame([*rows, (n, None), (n + 1, "")], "doc_id long, text string"), labels_of(spark, [*labels, (None, 1, 1), (0, None, None)]), {i: y for i, _, y in labels}


def test_toxicity(spark, none):
    df, labels, truth = labelled(spark, 500, 3, lambda s, r: s.replace(".", " " + r.choice(["vileword", "nastyterm", "foulness"]) + "."))
    got = {r.doc_id: r for r in toxicity.score(df, labels).collect()}
    held = [i for i in truth if got[i].held_out]
    import zlib

    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in truth)
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.95 and got[500].score == 0 == got[501].score
    assert toxicity.score(none, labels).count() == 0 and {r.score for r in toxicity.score(df, labels.limit(0)).collect()} == {0.0}


def test_toxicity_locates_sentences():
    rng = random.Random(15)
    rows = []
    for i in range(300):
        ss = [text_of(rng, 6) for _ in range(rng.randint(1, 6))]
        if i % 4 == 0:
            ss[rng.randrange(len(ss))] += " vileword nastyterms"
        rows.append((". ".join(ss), int(i % 4 == 0)))
    weights, bias = toxicity.train(rows, {1: 75, 0: 225})
    # the document's loss falls against the bias alone, and the marked sentence explains its label
    texts = [t for t, _ in rows] + ["", " . ! ", "Ünïcode vileword? " + "clean words here. " * 2000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([False] * len(texts)), pa.array(texts)], ["doc_id", "held_out", "text"])
    got = [r for b in toxicity._score(weights, bias, 0.7)([batch]) for r in b.to_pylist()]
    for t, r in zip(texts, got):
        sentences = [re.sub(r"[^0-9a-zA-Z\x80-\U0010ffff]", " ", s).lower().split() for s in re.split(r"[\n.!?]", t)]
        p = []
        for words_ in filter(None, sentences):
            z = bias
            for w in words_:
                z += sum(weights.get(f.encode(), 0.0) for f in [w, *(w[:n] + "-" for n in (4, 5, 6) if len(w) > n)])
            p.append(1 / (1 + math.exp(-z)))
        assert abs(r["score"] - (1 - math.prod(1 - x for x in p))) < 1e-6 and r["predicted"] == int(r["score"] >= 0.7)
        assert (r["worst_sentence"], r["worst_score"]) == (None, None) if not p else abs(max(p) - r["worst_score"]) < 1e-9
    for (t, y), r in zip(rows, got):
        assert not y or "vileword" in [s for s in re.split(r"[.]", t) if s.strip()][r["worst_sentence"]]


def test_quality_knn(spark, none):
    df, labels, truth = labelled(spark, 400, 5, lambda s, r: " | ".join(s.split()) * 4)
    got = {r.doc_id: r for r in quality_knn.score(df, labels).collect()}
    held = [i for i in truth if got[i].held_out]
    auc = np.mean([got[i].score < got[j].score for i in held if truth[i] for j in held if not truth[j]])
    assert auc > 0.95 and all(0 <= r.score <= 1 for r in got.values()) and len(got) == 402
    assert quality_knn.score(none, labels).count() == 0 and {r.score for r in quality_knn.score(df, labels.limit(0)).collect()} == {0.5}


def test_quality_knn_neighbours(spark):
    rng = random.Random(6)
    rows = [(text_of(rng, rng.randint(1, 80)) if i % 3 else " ".join([rng.choice(WORDS)] * 30), int(bool(i % 3))) for i in range(120)]
    model = quality_knn.Model(rows, {0: 400, 1: 800})
    texts = [text_of(rng, n) for n in (1, 5, 40, 300)] + ["", " \n", "a a a a a a", "x" * 50_000]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    some, top, sim = model.nearest(data, off)
    got = model.score(data, off)
    assert some.tolist() == [True] * 4 + [False] * 2 + [True] * 2 and got[4] == got[5] == model.prior == 800 / 1200
    for d, t in enumerate(texts):
        if not some[d]:
            continue
        one = quality_knn.terms(np.frombuffer(raw[d], np.uint8), np.array([0, len(raw[d])]))[0]
        assert np.array_equal(one, quality_knn.terms(data, off)[d])
        w = Counter(t.split())
        assert np.allclose(one[-quality_knn.OCTAVES :], [sum(n for n in w.values() if 2**k <= n < 2 ** (k + 1)) ** 0.5 for k in range(quality_knn.OCTAVES)])
        v = (one * model.idf).astype(float) @ model.basis.astype(float)
        cos = sorted(((v @ u) / np.linalg.norm(v) / np.linalg.norm(u) for u in model.vectors.astype(float)), reverse=True)
        assert np.allclose(sorted(sim[d], reverse=True), cos[: quality_knn.NEIGHBOURS], atol=1e-4)
        share = [max(0.0, float(s)) ** 4 * model.weights[i] for i, s in zip(top[d], sim[d])]
        assert abs(got[d] - sum(x * model.labels[i] for i, x in zip(top[d], share)) / sum(share)) < 1e-5


def test_learners_with_repeats_and_names(spark):
    df, labels, truth = labelled(spark, 150, 9, lambda s, r: s.replace(".", " vileword."))
    again = df.union(df.where("doc_id < 20")).union(spark.createDataFrame([(3, "another text"), (None, "no id")], df.schema))
    again = again.selectExpr("*", "1 as y", "'x' as o", "2 as id", "3 as score", "'z' as t", "4 as held_out").repartition(4)
    more = labels.selectExpr("*", "1 as y", "'x' as o")
    for op in (toxicity, quality_knn):
        once, twice = op.score(again, more).collect(), op.score(again.repartition(2), more.repartition(3)).collect()
        assert sorted(map(str, once)) == sorted(map(str, twice)) and len(once) == 174
        by = {}
        for r in once:
            by.setdefault(r.doc_id, set()).add(r.score)
        assert all(len(x) == 1 for i, x in by.items() if i != 3) and not [r for r in once if r.doc_id is None and r.held_out]


def edit_infix(p, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark, none):
    rng = random.Random(8)
    items = [(i, text_of(rng, rng.randint(8, 40)) + f" item{i}") for i in range(20)] + [(20, None), (21, "too short")]
    rows = []
    for d in range(120):
        w = text_of(rng, rng.randint(0, 90)).split()
        if d % 2:
            x = items[rng.randrange(20)][1].split()
            for _ in range(rng.randint(0, int(0.3 * len(x)))):
                k = rng.randrange(len(x))
                x[k : k + rng.randint(0, 1)] = rng.choice([[], ["zz"], ["q", "r"]])
            k = rng.randrange(len(w) + 1)
            w[k:k] = x
        rows.append((d, " ".join(w).title() + "!", "e"))
    rows += [(200, None, "e"), (201, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.matches(df, bench).collect()}
    token = lambda s: re.sub(r"[^\w]+", " ", (s or "").lower()).split()
    want = {}
    for d, t, _ in rows:
        for i, x in items[:20]:
            e = edit_infix(token(x), token(t))
            if e <= int(0.2 * len(token(x))):
                want[(d, i)] = e
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want) and all(got[k] == want[k] for k in got)
    hit = {d for d, _ in got}
    clean = decontam.drop(df, bench)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, *_ in rows if d not in hit) and clean.columns == df.columns
    assert decontam.matches(df, bench.limit(0)).count() == 0 and decontam.matches(none, bench).count() == 0


def shortened(rng, x, kind):
    """x after floor(0.2 * len) edits: words dropped at random, the first or middle ones dropped, changed, added, or each in turn."""
    k = int(0.2 * len(x))
    if kind in ("front", "middle"):
        at = 0 if kind == "front" else len(x) // 2
        return x[:at] + x[at + k :]
    picked = set(rng.sample(range(len(x)), k))
    out = []
    for i, v in enumerate(x):
        how = ("drop", "change", "add")[i % 3] if kind == "mixed" else kind
        out += [v] if i not in picked else {"drop": [], "change": ["zz"], "add": ["zz", v]}[how]
    return out


def test_decontamination_long_items():
    rng = random.Random(18)
    # words of a small vocabulary, so that few are rare, and words of their own
    items = [(i, text_of(rng, n) if i % 2 else " ".join(f"w{rng.randrange(4000)}" for _ in range(n))) for i, n in enumerate([5, 8, 12, 20, 40, 60, 61, 90, 120, 121, 180, 240, 241, 300])]
    items.append((14, "buffalo " * 60))
    index = decontam.Index(items, 0.2)
    for kind in ("drop", "front", "middle", "change", "add", "mixed"):
        texts, want = [], {}
        for i, x in items:
            for _ in range(5):
                body = shortened(rng, x.split(), kind)
                want[(len(texts), i)] = edit_infix(x.split(), body)
                texts.append(text_of(rng, rng.randint(0, 60)).split() + body + ["end", *text_of(rng, 30).split()])
        raw = [" ".join(t).encode() for t in texts]
        batch = pa.RecordBatch.from_arrays([pa.array([x.decode() for x in raw])], ["text"])
        got = {(h[0], h[1]): h[2] for t in decontam.text_slices([batch]) for h in index.hits(t)}
        assert all(got.get(k, 99) <= d for k, d in want.items()), kind


def test_decontamination_short_items():
    items = [(1, "zig"), (2, "zig zag"), (3, "One two, THREE four!"), (4, "今天天气很好。"), (5, ""), (6, "..."), (7, "one two three four five")]
    texts = ["a zig b", "x zig-zag", "zag zig", "so one two three four", "one two three", "他说: 今天天气很好。 ok", "one two three five", ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    got = {h[:3] for t in decontam.text_slices([batch]) for h in decontam.Index(items, 0.2).hits(t)}
    assert got == {(0, 1, 0), (1, 1, 0), (1, 2, 0), (2, 1, 0), (3, 3, 0), (3, 7, 1), (5, 4, 0), (6, 7, 1)}


def test_decontamination_recall():
    # walks grow with the items' size until the most of them don't reach the target
    got = [decontam.walks(n, n // 5) for n in (5, 8, 20, 40, 240, 2000)]
    assert got[0] and got[:4] == sorted(got[:4]) and got[4:] == [0, 0]
    index = decontam.Index([(1, " ".join(f"w{i}" for i in range(240))), (2, " ".join(f"v{i}" for i in range(8)))], 0.2)
    assert index.whole == {240} and set(index.tables(0)[1].tolist()) == {1}


def test_decontamination_blocks(spark, monkeypatch):
    rng = random.Random(31)
    items = [(i, text_of(rng, 12)) for i in range(12)] + [(3, text_of(rng, 14)), (50, " ".join(f"w{i}" for i in range(3000)))]
    rows = [(i, text_of(rng, 20) + " " + items[i % 14][1] + " " + text_of(rng, 5), 1) for i in range(28)] + [(90, text_of(rng, 9), 1), (None, None, 1)]
    rows.append(rows[0])
    df, bench = spark.createDataFrame(rows, "doc_id long, text string, h int"), spark.createDataFrame(items + items[:3], "item_id long, text string")
    once, left = decontam.matches(df, bench).collect(), decontam.drop(df, bench).collect()
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 8_000)
    assert sorted(decontam.matches(df, bench).collect()) == sorted(once) and {r.doc_id for r in once} == set(range(28)) and len(once) >= 29
    assert sorted(map(str, decontam.drop(df, bench).collect())) == sorted(map(str, left)) and {r.doc_id for r in left} == {90, None}


def test_infix_distance():
    rng = random.Random(6)
    for _ in range(300):
        p, t = [rng.randrange(4) for _ in range(rng.randint(1, 12))], [rng.randrange(4) for _ in range(rng.randint(0, 20))]
        assert decontam.infix_distance(p, t)[0] == edit_infix(p, t)


def test_lm(spark, none):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice([("the", "red", "fox", "ran"), ("a", "big", "dog", "sat")])[k % 4] for k in range(200))) for i in range(80)]
    odd = [(100, " ".join(rng.sample(["fox", "the", "sat", "dog", "a", "ran", "red", "big"] * 25, 200))), (101, None), (102, "")]
    got = {r.doc_id: r for r in lm_score.score(spark.createDataFrame(rows + odd, "doc_id long, text string").repartition(2)).collect()}
    assert got[100].mean_log_prob < np.mean([got[i].mean_log_prob for i, _ in rows]) - 0.5
    assert got[101].log_prob == 0 and got[101].mean_log_prob is None and got[102].n_words == 0
    assert lm_score.score(none).count() == 0


def test_lm_vocabulary(spark, none, monkeypatch):
    rng = random.Random(3)
    # 400 words, more than have a symbol of their own, and words that occur once
    usual = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(usual) for _ in range(150))) for i in range(60)]
    rows += [(100, " ".join(f"invented{i}" for i in range(150))), (101, None), (None, rows[3][1]), rows[4]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    counts = Counter(w for _, t in rows for w in (t or "").split())
    hashed = lambda t: words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), lm_score._ABC).hash
    number = dict(zip(map(int, hashed(" ".join(counts))), counts.values()))
    for share in (1e-6, 0.002, 0.5):  # all words known, some, none
        monkeypatch.setattr(lm_score, "SHARE", share)
        staged = lm_score.count_words(df)
        assert {r.key % (1 << 64): r.n for r in staged.collect()} == number
        v = lm_score.vocabulary(staged)
        flat = lm_score.train(df, v.top, sum(number.values()))
        assert np.array_equal(flat, lm_score.train(df.repartition(5), v.top, sum(number.values())))
        monkeypatch.setattr(lm_score, "train", lambda docs, top, total, flat=flat: flat)
        got = lm_score.score(df).collect()
        monkeypatch.undo()
        assert len(got) == len(rows) and len({r.log_prob for r in got if r.doc_id in (3, None)}) == 1
        classes, net = {}, lm_score.Network(flat)
        symbol = dict(zip(number, lm_score.symbols(np.array(list(number), np.uint64), v.top).tolist()))
        for x, s in symbol.items():
            classes[s] = classes.get(s, 0) + number[x]
        by = {r.doc_id: r for r in got}
        for i in (0, 7, 100):
            t = rows[i][1] if i < 60 else rows[60][1]
            target, context, *_ = lm_score.windows(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), v.top)
            looped = 0.0
            for s, c in zip(target.tolist(), context.tolist()):
                hidden = [math.tanh(net.parts[1][u] + sum(net.parts[0][k][c[k]][u] for k in range(len(c)))) for u in range(lm_score.HIDDEN)]
                logits = [net.parts[3][x] + sum(hidden[u] * net.parts[2][u][x] for u in range(lm_score.HIDDEN)) for x in range(lm_score.SYMBOLS)] if i == 7 else None
                looped += logits[s] - math.log(sum(map(math.exp, logits))) if logits else 0.0
            assert i != 7 or abs(looped - net.log_probs(target, context).sum()) < 0.01
            want = net.log_probs(target, context).sum() + sum(np.log(number[x] / classes[symbol[x]]) for x in map(int, hashed(t)))
            assert abs(by[i].log_prob - want) < 0.01, (share, i, len(v.known), v.least)
        assert by[100].mean_log_prob < min(by[i].mean_log_prob for i in range(60)) - 2 and by[101].mean_log_prob is None


def test_lm_rounds_see_all(spark, monkeypatch):
    """Each model that is averaged comes from every word of all documents, however many shards there are."""
    rng = random.Random(8)
    rows = [(i, text_of(rng, rng.randint(1, 60))) for i in range(200)] + [(None, "no id"), (7, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    v, seen, averaged = lm_score.vocabulary(lm_score.count_words(df)), [], lm_score._averaged

    def watched(models):
        models = models.localCheckpoint()
        seen.append((models.agg({"n": "sum"}).first()[0], models.count()))
        return averaged(models)

    monkeypatch.setattr(lm_score, "_averaged", watched)
    monkeypatch.setattr(lm_score, "LEAST", v.words // 8, raising=False)
    monkeypatch.setattr(lm_score, "SHARD", v.words // 5)
    lm_score.train(df, v.top, v.words)
    assert v.words > 4000 and seen and {n for n, _ in seen} == {v.words} and all(k > 3 for _, k in seen)


def test_lm_average(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "FAN", 3)
    rng = np.random.default_rng(4)
    rows = [(s, int(rng.integers(1, 9)), rng.normal(size=5)) for s in range(40)]
    models = spark.createDataFrame([(s, n, bytearray((w * n).tobytes())) for s, n, w in rows], "s long, n long, w binary").repartition(4)
    assert np.allclose(lm_score._averaged(models), sum(w * n for _, n, w in rows) / sum(n for _, n, _ in rows), atol=1e-6)
    assert lm_score._averaged(models.limit(0)) is None


def test_lm_gradient():
    net = lm_score.Network(seed=2)
    rng = np.random.default_rng(0)
    target, context = rng.integers(0, lm_score.SYMBOLS, 64), rng.integers(0, lm_score.SYMBOLS, (64, 2 * lm_score.SIDE))
    before = net.log_probs(target, context).mean()
    for _ in range(30):
        net.step(target, context, 0.01)
    assert net.log_probs(target, context).mean() > before + 0.5
    z, total = net.softmax(net.hidden(context))
    assert np.allclose((z / total[:, None]).sum(axis=1), 1, atol=1e-4)


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    rows = [(i, ". ".join(text_of(rng, 10) for _ in range(8)), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100, rows[4][1], "en", "s1", 1), (101, "bad", "en", "s1", 1)]
    items = [(1, text_of(rng, 20) + " leak")]
    rows.append((102, rows[9][1][::1] + " " + items[0][1], "en", "s0", 1))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = Counter(r.doc_id for r in out)
    assert not {100, 101, 102} & set(ids) and max(ids.values()) <= 3 and len(ids) > 20
    counts = Counter(r.shard for r in out)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(registry.queries()) >= {"pipeline", "op1_mixing"}


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(41)
    rows = [(i, ". ".join(text_of(rng, 10) for _ in range(rng.randint(3, 9))), "en", f"s{i % 3}", 1, i % 5, "x") for i in range(70)]
    for i in range(8):  # copies with a word changed, exact ones, repeated rows, copies without an id
        w = rows[i][1].split()
        w[rng.randrange(len(w))] = "changed"
        rows += [(200 + i, " ".join(w), "en", "s1", 1, 0, "x"), (300 + i, rows[i + 10][1], None, None, 1, 0, None), rows[i + 20], (None, rows[i + 30][1], "en", "s2", None, 1, "x")]
    items = [(i, text_of(rng, 18)) for i in range(6)] + [(9, None)]
    for i, (_, x) in enumerate(items[:6]):
        w = x.split()
        w[3:5] = ["edited"]
        rows.append((400 + i, rows[40 + i][1] + " " + " ".join(w), "en", "s0", 1, 0, "x"))
    rows += [(500, None, None, None, None, None, None), (501, "", "en", "s1", 0, 0, "x"), (None, None, None, None, None, None, None), (502, "too short", "en", "s0", 1, 1, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard int, h string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    key = lambda r: str((r[0], r[1], r[2], r[3]))
    steps = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    path = f"{tmp_path}/step"

    def apply(name, docs):
        out = steps[name](spark, docs, str(tmp_path))
        out.write.parquet(f"{path}-{name}")
        return spark.read.parquet(f"{path}-{name}")

    kept = apply("quality_rules", docs)
    verdicts = quality_rules.judge(docs).select("doc_id", "n_words", "n_repeat_words", "kept").collect()
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in verdicts)
    assert not any(r.kept for r in verdicts if r.n_words < 10) and kept.count() >= 90
    before, deduped = [tuple(r) for r in kept.collect()], apply("near_dedup", kept)
    groups = {}
    for r, (_, n, c) in zip(before, brute_components(before, 5, 80)):
        groups.setdefault((c, None if c is not None else r[1]), []).append(r)
    got = [tuple(r) for r in deduped.collect()]
    assert deduped.columns == docs.columns and len(got) == len(groups)
    for (c, _), members in groups.items():
        mine = [r for r in got if r in members]
        assert len(mine) == 1 and mine[0][0] == c
    clean = apply("decontamination", deduped)
    token = lambda s: re.sub(r"[^\w]+", " ", (s or "").lower()).split()
    hit = {key(r) for r in got for _, x in items if token(x) and edit_infix(token(x), token(r[1])) <= int(0.2 * len(token(x)))}
    assert len(hit) >= 6 and sorted(key(r) for r in clean.collect()) == sorted(key(r) for r in got if key(r) not in hit)
    mixed = apply("mixing", clean)
    times = Counter(key(r) for r in mixed.collect())
    plan_ = {str((r.doc_id, r.size)): r.times for r in mixing.amounts(clean).collect()}
    assert mixed.columns == docs.columns and all(times.get(key(r), 0) == plan_[str((r[0], len((r[1] or "").split())))] for r in clean.collect())
    sharded = apply("sharding", mixed)
    assert sharded.columns == ["doc_id", "text", "lang", "source", "n_chars", "h", "shard", "slot"]
    assert Counter(key(r) for r in sharded.collect()) == times
    counts = Counter(r.shard for r in sharded.collect())
    assert max(counts.values()) - min(counts.values()) <= 1 and len({(r.shard, r.slot) for r in sharded.collect()}) == mixed.count()
    where = {}
    for r in sharded.collect():
        where.setdefault(r.text, set()).add(r.shard)
    assert all(len(x) == 1 for x in where.values())
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "text", "source").collect())) == sorted(map(str, sharded.select("doc_id", "text", "source").collect()))


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"] and out.count() == 0


def test_further_columns_change_nothing(spark):
    rows = [r[:4] for r in corpus()]
    rows = rows[:12] + rows[58:]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    names = "h sig id key size source_size target taken times extra row shard slot law score predicted held_out o t y n w s g kept n_words total inside rare rest share distance item_id spans word __h __id label node part prefix last".split()
    more = plain.selectExpr("*", *[f"'x' as `{c}`" for c in names])
    bench = spark.createDataFrame([(1, rows[0][1]), (1, rows[2][1]), (None, "one two"), (2, None)], "item_id long, text string")
    # the other operators have tests of their own with such columns
    ops = [quality_rules.judge, lm_score.score, secrets.find_secrets, lambda d: decontam.matches(d, bench)]
    for op in ops:
        a, b = op(plain), op(more)
        found = sorted(map(str, a.collect()))
        assert a.columns == b.columns and found == sorted(map(str, b.collect())), op
        assert a.columns[1] == "item_id" or len(found) == len(rows)
    for keep in (quality_rules.keep, lambda d: decontam.drop(d, bench)):
        a, b = keep(plain), keep(more)
        assert b.columns == more.columns and sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect())), keep
