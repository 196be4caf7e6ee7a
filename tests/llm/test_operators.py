"""Corpus operators on small cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import html
import math
import random
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from capture_spark.llm import licenses, mixing, neardup, neighbours, pages, pieces, quality, scoring, sharding, substrings
from capture_spark.llm.tables import WRITING, positions, settled, stored

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b + c for a in ("th", "er", "on", "an", "re") for b in ("a", "e", "ing", "o") for c in ("nd", "st", "ly", "m", "")]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def near(text, seed, edits):
    r, words = random.Random(seed), text.split()
    for _ in range(edits):
        words[r.randrange(len(words))] = f"edit{r.randrange(10**6)}"
    return " ".join(words)


BASE = prose(200, 1)
PASSAGE = prose(60, 2)
TEXTS = [
    BASE, BASE, BASE.upper(), near(BASE, 3, 3), near(BASE, 4, 30), prose(300, 5) + "\n" + PASSAGE + " " + prose(40, 6), prose(100, 7) + " " + PASSAGE, PASSAGE + " " + PASSAGE,
    None, "", "   \n\t ", "one", "two words", "ONE", "a b c", "A b  c", "line here\nline here\nline here", "spam " * 400, prose(5000, 8), "ünïcode ▁ mark 日本 \x0b end", "# $ % & | < > * word",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [(None, BASE, None, None, None), (3, TEXTS[3], "en", "a", 0)]
    return spark.createDataFrame(rows, DOC).repartition(3)


def rows(df):
    return [r.asDict() for r in df.collect()]


def empty(spark):
    return spark.createDataFrame([], DOC)


def test_quality(spark, docs):
    clash = docs.withColumn("kept", docs["doc_id"])
    got = rows(quality.repetition(clash))
    assert len(got) == len(TEXTS) + 2
    for r in got:
        words = (r["text"] or "").encode().split()
        seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        inside = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = Counter(x for x in (r["text"] or "").split("\n") if x.encode().split())
        assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) == (len(words), len(inside), sum(lines.values()) - len(lines))
        assert r["word_chars"] == sum(len(w.decode()) for w in words)
        assert r["base_failed"] == (len(words) < 20 or 100 * len(inside) > 30 * len(words))
        assert r["kept"] in (True, False) and not (r["base_failed"] and r["kept"])
    assert rows(quality.repetition(empty(spark))) == []


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)} or ({tuple(words)} if words else set())


def components_of(pairs):
    sets = [(i, shingles(t)) for i, t in pairs]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets:
        for j, b in sets:
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def test_near_duplicates(spark, docs):
    want = components_of(list(enumerate(TEXTS)))
    got = rows(neardup.near_duplicates(docs.withColumn("component_id", docs["n_chars"])))
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] == 0 and not r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert rows(neardup.near_duplicates(empty(spark))) == []


def test_near_duplicates_in_a_crowd(spark):
    """A large group of copies with from few to many edits, by lists and by blocks alike."""
    texts = [(i, near(BASE, i, i % 14)) for i in range(150)] + [(150 + i, prose(60, 900 + i)) for i in range(50)]
    want = components_of(texts)
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in texts], DOC)
    for crowd in (64, 4):
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(neardup.near_duplicates(df, crowd=crowd))} == want


def test_settled_keeps_only_its_result(spark):
    held, before = [], {k: spark.conf.get(k) for k in WRITING}

    def make():
        held.append(stored(spark.range(100), "held"))
        held.append(settled(spark, "inner", lambda: stored(held[0], "gone").filter("id < 50")))
        return held[0].join(held[1], "id")

    out = settled(spark, "out", make)
    assert out.count() == 50
    assert {k: spark.conf.get(k) for k in WRITING} == before
    for df in held:
        with pytest.raises(Exception, match="(?i)not.?exist"):
            df.collect()


def shingles5(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def kept_rows(source):
    """The rows (id, text) that near-dedup keeps, in plain Python."""
    sets = [shingles5(t) for _, t in source]
    root = list(range(len(source)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, t) in enumerate(source):
        groups[find(i) if sets[i] else -1 - i].append((d is None, d or 0, hashlib.md5((t or "").encode()).digest(), t))
    return Counter((None if m[0] else m[1], m[3]) for m in (min(g, key=lambda x: x[:3]) for g in groups.values()))


def test_near_dedup_keeps_one(spark, docs):
    """Rows of one id with other texts, rows without ids and repeated rows are judged each."""
    more = spark.createDataFrame([(3, "x y", None, None, 0), (3, "p q r s t u", None, None, 0), (None, "only here", None, None, 0), (None, "only here", None, None, 0), (3, "x y", None, "b", 1), (None, None, None, None, 0)], DOC)
    df = docs.unionByName(more).withColumn("row_number", F.lit(1)).withColumn("of_row", F.lit("x"))
    out = neardup.deduplicated(df)
    assert out.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in rows(out)) == kept_rows([(r["doc_id"], r["text"]) for r in rows(df)])
    assert rows(neardup.deduplicated(empty(spark))) == []


CLASHES = "range_part range_row part_start start_source start_range_part of_source mix_digest mix_copy position size source_size target copies cut_key of_key kept kept_text row_number of_row key seq".split()


def test_columns_of_any_name(spark, docs):
    """Extra columns named like an operator's own come through the stages that keep rows."""
    df = docs.withColumns({c: F.concat(F.lit(f"{c}-"), F.coalesce("text", F.lit(""))) for c in CLASHES})
    for op in (neardup.deduplicated, substrings.cut, mixing.mixed):
        out = op(df)
        assert out.columns == df.columns and op(df.limit(0)).count() == 0
        for r in rows(out):
            assert all(r[c].startswith(f"{c}-") for c in CLASHES) and r["size"][5:] == r["mix_copy"][9:]


PAGES = [
    ("http://a.example/1", "<html><head><title>T</title></head><body><nav><a>Menu</a></nav><div class='ad'>Buy</div><article><h1>Ti&amp;tle</h1><p>One <b>two</b>\n three</p><p>Four<br>five<aside>no</aside></p></article><footer>c</footer>", "Ti&tle\nOne two three\nFour five"),
    ("http://a.example/2", "<main><p>Main text<script>var t='</p>';</script></p><form><p>No</p></form><div id='comments'><p>Reader</p></div></main>", "Main text"),
    ("http://b.example/1", "<p>Shared words that stand on every single page here today</p><p>Own text number one of this page</p>", "Own text number one of this page"),
    ("http://b.example/2", "<p>Shared words that stand on every single page here today</p><p>Another page with other own text</p>", "Another page with other own text"),
    ("http://b.example/3", "<div>Third page alone<p>Shared words that stand on every single page here today</div>", "Third page alone"),
    (None, None, ""),
    ("not a url", "", ""),
    ("http://c.example/1", "<article><p>Printed twice word for word in two places</p></article>", "Printed twice word for word in two places"),
    ("http://c.example/2", "<article><p>Printed twice word for word in two places</p></article>", "Printed twice word for word in two places"),
    ("http://c.example/3", "<article><p>Unclosed <b>bold <p>Next &lt;p&gt; &eacute;&#8212;</article><p>out", "Unclosed bold\nNext <p> é—"),
]


def test_pages(spark):
    df = spark.createDataFrame([(i, u, h, "x") for i, (u, h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in rows(pages.main_text(df))}
    assert got == {i: (t, len(t)) for i, (_, _, t) in enumerate(PAGES)}
    assert rows(pages.main_text(df.limit(0))) == []


def test_pages_large_hosts(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    whole, small, joined = (sorted(map(tuple, rows(pages.main_text(df, *o)))) for o in ((512, 100_000), (3, 100_000), (3, 0)))
    assert whole == small == joined and len(small) == df.count()


def plain_texts(source):
    """The texts of (url, html) rows by counting each 8 words of each block over a host's distinct pages."""
    cut = [pages.page_blocks(h) for _, h in source]
    hosts = defaultdict(dict)
    for (u, _), x in zip(source, cut):
        if u and "://" in u:
            hosts[u.split("/")[2]]["\n".join(b for b, _ in x)] = x
    out = []
    for (u, _), x in zip(source, cut):
        blocks, main = [b.split(" ") for b, _ in x], bool(x) and x[0][1]
        own = {t: y for t, y in hosts[u.split("/")[2]].items() if t} if u and "://" in u else {}
        n = Counter()
        for y in own.values():
            n.update({tuple(w[i : i + 8]) for w in (b.split(" ") for b, _ in y) for i in range(len(w) - 7)})
        least = max(3, (0.5 if main else 0.25) * len(own))
        gone = [{j for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] >= least for j in range(i, i + 8)} for w in blocks]
        if sum(map(len, gone)) >= (0.5 if main else 0.9) * sum(map(len, blocks)):
            gone = [set() for _ in blocks]
        kept = [" ".join(v for j, v in enumerate(w) if j not in g) for w, g in zip(blocks, gone)]
        out.append("\n".join(b for b in kept if b))
    return out


def test_pages_boilerplate_of_a_host(spark):
    """A host's boilerplate is the same however its pages are dealt, goes from marked parts too, and is no repeated article."""
    notice, promo = prose(12, 70), prose(14, 71)
    own = [prose(30, 100 + i) for i in range(80)]
    open_ = [("http://open.example/", f"<p>{own[i]}</p>" + (f"<p>{notice}</p>" if i < 30 else ""), own[i]) for i in range(80)]
    inside = [("http://inside.example/", f"<p>{x} {promo} tail{i} of</p>", f"{x} tail{i} of") for i, x in enumerate(own[:20])]
    marked = [("http://main.example/", f"<article><p>{x}</p><p>{promo}</p></article>", x) for x in own[:20]]
    article = prose(60, 72)
    twice = [("http://twice.example/", f"<p>{x}</p>", x) for x in (near(article, 1, 2), near(article, 2, 2), *own[:3])]
    often = [("http://often.example/", f"<article><p>{x}</p></article>", x) for x in (near(article, i, 2) for i in range(6))]
    copies = [("http://copies.example/", f"<article><p>{own[0]}</p></article>", own[0])] * 9 + [("http://copies.example/", f"<article><p>{own[1]}</p></article>", own[1])]
    none = [("page/", f"<p>{own[i]}</p><p>{notice}</p>", own[i] + "\n" + notice) for i in range(8)]
    want = dict(enumerate([*open_, *inside, *marked, *twice, *often, *copies, *none]))
    assert plain_texts([(u, h) for u, h, _ in want.values()]) == [t for _, _, t in want.values()]
    df = spark.createDataFrame([(i, u + str(i), h) for i, (u, h, _) in want.items()], "page_id long, url string, html string")
    for o in ((512, 100_000), (7, 100_000), (7, 0)):
        assert {r["page_id"]: r["text"] for r in rows(pages.main_text(df, *o))} == {i: t for i, (_, _, t) in want.items()}


def test_pages_marks():
    """Classes of an article or main element hide nothing, nor do subjects and states; names that begin or end with furniture do."""
    said = {
        '<article class="post category-legal"><p>The court ruled</p></article>': "The court ruled",
        '<main class="search-enabled"><p>Text</p></main>': "Text",
        '<article><div class="has-sidebar"><p>One</p></div><div class="comment-list"><p>Two</p></div><div id="cookieNotice">Three</div><div class="post-related">Four</div></article>': "One\nFour",
        '<body class="nav"><div class="menu">No</div><p>Yes</p></body>': "Yes",
    }
    assert ["\n".join(b for b, _ in pages.page_blocks(h)) for h in said] == list(said.values())


def test_pages_main_part():
    """The main part is told by its mass of prose, names by all their words, and furniture left open does not swallow a page."""
    long, more, card = prose(60, 1), prose(40, 2), prose(12, 3)
    said = {
        f'<div class="content"><p>{long}</p></div><article class="card">{card}</article>': long,
        f'<div class="content"><p>{long}</p></div><div><article class="comment"><p>{more}</p></article></div>': long,
        f'<article><p>{long}</p><article class="comment-body"><p>{more}</p></article></article><div>{card}</div>': long,
        f'<main><p>{card}</p></main><ul>{"".join(f"<li><a href=x>{w} and the rest of it all at once over here</a></li>" for w in more.split())}</ul>': card,
        f'<article><p>{long}</p><div class="post-comments"><p>{more}</p></div><div id="article-comments">{more}</div></article>': long,
        f'<div class="page-footer">{more}</div><p>{long}</p><div class="entry-nav">{more}</div><div class="col-right-sidebar-area">{more}</div>': long,
        f'<article><div class="legal-analysis"><p>{long}</p></div><p>A <span class="notice">small</span> thing</p><div class="notice">{more}</div></article>': long + "\nA small thing",
        f"<nav><ul><li><a href=x>Home</a></li></ul><div><p>{long}</p></div>": long,
        f'<body><div class="menu"><ul><li>Home</li></ul><h1>Title</h1><p>{long}</p></body>': "Title\n" + long,
        f"<article><p>{long}</p></article><article><p>{more}</p></article>": long + "\n" + more,
        "<nav>": "",
    }
    assert ["\n".join(b for b, _ in pages.page_blocks(h)) for h in said] == list(said.values())


def test_pages_given(spark, sf):
    import re

    raw = {r["page_id"]: r["html"] for r in rows(spark.read.parquet(f"{sf}/pages.parquet"))}
    for r in rows(pages.query(spark, sf)):
        body = re.search(r"<article>(.*)</article>", raw[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(b for b in blocks if b)


def test_suffix_order():
    tokens = np.array([3, 1, 2, 3, 1, 2, 9, 3, 1])
    order, rank = pages.suffix_order(tokens)
    assert order.tolist() == sorted(range(9), key=lambda i: tokens[i:].tolist())
    r = np.random.default_rng(0).integers(0, 2, 400)
    _, rank = pages.suffix_order(r)
    keys = [tuple(r[i : i + 8]) for i in range(400)]
    assert rank.tolist() == [sorted(set(keys)).index(k) for k in keys]


@pytest.mark.parametrize("seed", [0, 1])
def test_top_k(spark, seed):
    r = np.random.default_rng(seed)
    data = [(int(i), [float(x) for x in r.normal(size=4).round(seed)]) for i in range(300)]
    data += [(300, None), (350, [1.0, None, 0.0, 0.0]), (400, [float("nan")] * 4), (450, [1.0, 2.0]), (None, [0.0] * 4), (50, data[50][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in data], "vec_id long, embedding array<float>, rank int")
    got = defaultdict(list)
    for x in sorted(rows(neighbours.top_k(df, block=64)), key=lambda x: (x["query_id"], x["rank"])):
        got[x["query_id"]].append((x["vec_id"], x["score"]))
    q = {i: np.floor(256 * np.float32(v).astype(float)).astype(int) for i, v in data[:300]}
    for i in range(0, 300, 50):
        assert got[i] == sorted(((j, int(q[i] @ q[j])) for j in q if j != i), key=lambda x: (-x[1], x[0]))[:5]
    assert 450 not in got and rows(neighbours.top_k(df.limit(0))) == []


def lower(text):
    return [*"".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split(), b""]


def test_scoring(spark, docs):
    got = rows(scoring.score(docs.withColumn("score", docs["n_chars"]), frequent=40))
    source = [(r["doc_id"], r["text"]) for r in rows(docs)]
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in source}
    counts = Counter(w for i, t in source if not held[i] for w in lower(t))
    n, v = sum(counts.values()), len(counts)
    texts = defaultdict(list)
    for i, t in source:
        texts[i].append(t)
    assert len(got) == len(source)
    for r in got:
        tokens = lower(texts[r["doc_id"]][0])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(tokens), sum(w in counts for w in tokens), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), rel_tol=1e-9)
        assert r["score"] < 0
    assert rows(scoring.score(empty(spark))) == []


def test_scoring_is_the_same_for_any_broadcast(spark, docs):
    """What is broadcast does not change scores: rare tokens have their class counts too."""
    few, all_ = (sorted((str(r["doc_id"]), r["n_known"], r["score"]) for r in rows(scoring.score(docs, **o))) for o in ({"frequent": 16}, {}))
    assert [x[:2] for x in few] == [x[:2] for x in all_]
    assert all(math.isclose(x[2], y[2], rel_tol=1e-9) for x, y in zip(few, all_, strict=True))


def test_scoring_is_the_same_for_any_partitions(spark, sf):
    """Scores are the same to the last bit, however rows and shuffles are dealt."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n, o in ((3, {}), (16, {"frequent": 2000}), (7, {"frequent": 2000})):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got.append(sorted((r["doc_id"], r["base_score"], r["score"]) for r in rows(scoring.score(docs.repartition(n), **o))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[1] == got[2]
    assert all(math.isclose(a[2], b[2], rel_tol=1e-9) and math.isclose(a[1], b[1], rel_tol=1e-9) for a, b in zip(got[0], got[1], strict=True))


def test_spelling_is_a_distribution():
    """Over all bytes at a place, the spelled probabilities add up to one."""
    r = np.random.default_rng(0)
    model = scoring.Mixer(r.integers(0, 9, scoring.SLOTS).astype(np.float32), r.integers(0, 9, scoring.SLOTS).astype(np.float32), scoring.START, r.uniform(0.1, 0.9, (scoring.GATES, scoring.BUCKETS)))
    flat = np.array([x for b in range(256) if b != 32 for x in (b,)], np.uint8)
    one = model.log10(flat, np.arange(255), np.ones(255, np.int64))
    two = model.log10(np.repeat(flat, 256), np.arange(255) * 256, np.zeros(255, np.int64))[:1]
    assert two[0] < 0 and (10**one).sum() + 10 ** two[0] < 1 + 1e-9


def test_scoring_learns(spark, sf):
    got = [r for r in rows(scoring.query(spark, sf)) if r["held_out"]]
    new = sum(r["n_tokens"] - r["n_known"] for r in got)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got) - 6 * new


def test_mixing(spark, docs):
    got = rows(mixing.mix_sized(mixing.sized(docs).withColumn("copies", docs["n_chars"])))
    assert len(got) == len(TEXTS) + 2
    total = sum(r["size"] for r in got)
    of = {r["source"]: (r["source_size"], r["target"]) for r in got}
    assert math.isclose(sum(t for _, t in of.values()), total) and all(t <= 3 * s + 1e-9 for s, t in of.values())
    assert all(0 <= r["copies"] <= 3 for r in got)
    again = rows(mixing.mix_sized(mixing.sized(docs.repartition(5))))
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["copies"])
    assert [key(r) for r in sorted(got, key=key)] == [key(r) for r in sorted(again, key=key)]
    assert mixing.mixed(docs).count() == sum(r["copies"] for r in got)
    assert rows(mixing.mix_sized(mixing.sized(empty(spark)))) == []


def test_mixing_capped(spark):
    df = spark.createDataFrame([(i, "w " * 10, None, s, 0) for i, s in enumerate(["a"] * 50 + ["b"] * 2 + ["c"])], DOC)
    of = {r["source"]: r["target"] for r in rows(mixing.mix_sized(mixing.sized(df)))}
    assert of == {"a": 530 - 60 - 30, "b": 60.0, "c": 30.0}


def test_licenses(spark, docs):
    texts = {
        100: "Some code.\nLicensed under the Apache License, Version 2.0.\nEnd",
        101: " ".join(licenses.SENTENCES[s] for s in licenses.RULES["bsd-3-clause/text"][1]),
        102: licenses.SENTENCES["bsd-grant"] + " Other text here. " + licenses.SENTENCES["bsd-source"],
        103: "RELEASED   under the mit license. Then text. Licensed under CC BY-NC 4.0.",
    }
    df = docs.unionByName(spark.createDataFrame([(i, t, None, None, 0) for i, t in texts.items()], DOC))
    got = {r["doc_id"]: r for r in rows(licenses.scan(df))}
    assert [got[i]["licenses"] for i in texts] == ["Apache-2.0", "BSD-3-Clause", "", "CC-BY-NC-4.0,MIT"]
    assert got[8]["n_sentences"] == 0 and got[8]["licenses"] == ""
    assert rows(licenses.scan(empty(spark))) == []


APACHE = """
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */"""


def test_licenses_wrapped_and_numbered(spark):
    said = licenses.SENTENCES
    bsd = [said[s] for s in licenses.RULES["bsd-3-clause/text"][1]]
    texts = [
        "/*\n * Copyright 2020 Some One\n *" + APACHE,
        *["\n\n".join(textwrap.fill(said[s], width) for s in licenses.RULES["mit/text"][1]) for width in (72, 80)],
        "Own words\n" + "\n".join(textwrap.fill(x, 76, initial_indent=f"{i}. " if i else "", subsequent_indent="   ") for i, x in enumerate(bsd)) + "\nMore",
        "\n".join(textwrap.fill(x, 76, initial_indent=f"({'abc'[i - 1]}) " if i else "") for i, x in enumerate(bsd[:3])),
        bsd[0] + " " + said["reserved"] + " " + bsd[1] + " " + bsd[2],
        bsd[0] + "\nOther words here\n" + bsd[1] + "\n" + bsd[2],
        "Never released\nunder the MIT License.",
        "Some | code: x | y\nReleased under\nthe MIT License.",
    ]
    got = {r["doc_id"]: r["licenses"] for r in rows(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    assert [got[i] for i in range(len(texts))] == ["Apache-2.0", "MIT", "MIT", "BSD-3-Clause", "BSD-2-Clause", "BSD-2-Clause,LicenseRef-all-rights-reserved", "", "", "MIT"]


def test_substrings(spark, docs):
    got = rows(substrings.removed(docs.withColumn("n_words", docs["n_chars"])))
    source = [(r["doc_id"], (r["text"] or "").encode().split()) for r in rows(docs)]
    seen = Counter(tuple(w[i : i + 35]) for _, w in source for i in range(len(w) - 34))
    want = defaultdict(set)
    for i, w in source:
        gone = {j for s in range(len(w) - 34) if seen[tuple(w[s : s + 35])] > 1 for j in range(s, s + 35)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        want[i].add((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    assert len(got) == len(source)
    assert all((r["n_words"], r["n_removed"], r["kept_sha256"]) in want[r["doc_id"]] for r in got)
    cut = {r["doc_id"]: r for r in rows(substrings.cut(docs))}
    assert cut[0]["text"] == "" and cut[16]["text"] == TEXTS[16] and cut[8]["text"] is None
    assert PASSAGE not in cut[6]["text"] and cut[6]["n_chars"] == len(cut[6]["text"])
    assert rows(substrings.removed(empty(spark))) == []


def test_shards(spark, docs):
    many = docs.unionByName(spark.createDataFrame([(1000 + i, prose(20 + i % 30, i), None, None, 0) for i in range(2000)], DOC))
    got = rows(sharding.shard_documents(many.withColumn("shard", many["n_chars"]), shards=8, per_part=300))
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(TEXTS) + 2002 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert set(sizes) == set(range(8)) and max(sizes.values()) < 1.02 * min(sizes.values())
    texts = {r["doc_id"]: r["text"] or "" for r in rows(many)}
    for r in got:
        assert r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["law"] == "bytes" and r["grown_shard"] is None
    assert len({r["shard"] for r in got if r["text_crc32"] == zlib.crc32(BASE.encode())}) == 1
    assert rows(sharding.shard_documents(empty(spark))) == []


def plain_packing(items, capacity):
    """Vector bin packing of {key: (bytes, tokens, rows)}, one step after another."""
    unit = [sum(c) / len(capacity) for c in zip(*capacity)]
    left = [[x / u for x, u in zip(c, unit)] for c in capacity]
    size = {k: [x / u for x, u in zip(v, unit)] for k, v in items.items()}
    out = {}
    for k in sorted(items, key=lambda k: (-max(size[k]), k)):
        fits = [s for s in range(len(left)) if left[s][0] >= size[k][0]]
        out[k] = max(fits, key=lambda s: (sum(a * b for a, b in zip(left[s], size[k])), -s)) if fits else max(range(len(left)), key=lambda s: (left[s][0], -s))
        left[out[k]] = [a - b for a, b in zip(left[out[k]], size[k])]
    return out


def test_shards_are_packed(spark):
    """One part without heavy groups is packed as plain Python packs it."""
    texts = [prose(5 + (i * 7) % 60, i) for i in range(400)] + [prose(9, 3)] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["shard"] for r in rows(sharding.shard_documents(df, shards=4, heavy=1))}
    of = Counter(texts)
    items = {hashlib.md5(t.encode()).digest(): ((len(t) + 1) * n, len(t.split()) * n, n) for t, n in of.items()}
    total = [sum(x) for x in zip(*items.values())]
    want = plain_packing(items, [[x / 4 for x in total]] * 4)
    assert [got[i] for i in range(len(texts))] == [want[hashlib.md5(t.encode()).digest()] for t in texts]


def test_shards_with_one_large_group(spark):
    """Half of all rows are one text: it is cut evenly; sizes stay level."""
    df = spark.createDataFrame([(i, BASE if i % 2 else prose(150 + i % 90, i)) for i in range(3000)], "doc_id long, text string")
    sizes, copies = Counter(), Counter()
    for r in rows(sharding.shard_documents(df, shards=4)):
        sizes[r["shard"]] += r["size"]
        copies[r["shard"]] += r["text_crc32"] == zlib.crc32(BASE.encode())
    assert max(sizes.values()) < 1.005 * min(sizes.values()) and sum(copies.values()) == 1500


def test_positions(spark):
    df = spark.createDataFrame([(None if i % 3 == 0 else f"g{i % 3}", (i * 37) % 100, i) for i in range(500)], "source string, size long, range_part long").repartition(4)
    seen = defaultdict(list)
    for r in rows(positions(df, ["source"], ["size"], "places")):
        seen[r["source"]].append((r["position"], r["size"]))
    assert all([p for p, _ in sorted(v)] == list(range(len(v))) and [s for _, s in sorted(v)] == sorted(s for _, s in v) for v in seen.values()) and len(seen) == 3


def vocabulary():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Vocabulary(f.read())


def encode(text, encoder):
    """(scores, paths, what the first decodes to, round trips) of one text."""
    ids, path_ends, row_ends, scores, trips, decoded = encoder.encode(pa.array([text], pa.string()))
    starts = [0, *path_ends]
    return scores[0], [ids[a:b].tolist() for a, b in zip(starts, path_ends)], decoded[0].as_py(), trips[0]


def test_pieces(spark, docs):
    v = vocabulary()

    def brute(text, n):
        chunk, found = pieces.matched(" " + text), []

        def go(at, cuts, score):
            if at == 0:
                found.append((score, cuts))
                return
            for start, s in v.edges_into(chunk, at):
                go(start, [at, *cuts], score + s)

        go(len(chunk), [], 0.0)
        found.sort(key=lambda x: -x[0])
        return [s for s, _ in found[:n]], {tuple(v.ids(" " + text, chunk, cuts)) for s, cuts in found if s >= found[:n][-1][0] - 1e-9}

    for text in ("the cat", "  a b  ", "ab\ncd", "é▁x", "Thnd here an", "日本 x", "a", "\ue581 ▁", "aaaaaaa", "x\x00y"):
        scores, paths, decoded, trips = encode(text, pieces.Encoder(v, 4))
        want, allowed = brute(text, 4)
        assert np.allclose(scores, want) and {tuple(p) for p in paths} <= allowed
        assert len({tuple(p) for p in paths}) == len(paths) and all(trips) and decoded == text
        assert all(v.decode(p) == text for p in paths)
    for r in rows(pieces.encoded(docs.withColumn("ids", docs["n_chars"]))):
        assert r["decoded"] == (r["text"] or "") and r["best_scores"] == sorted(r["best_scores"], reverse=True)
    assert rows(pieces.encoded(empty(spark))) == []


def test_pieces_of_all_paths(docs):
    """A text alone and among others has the same paths; each is another, and decodes to the text."""
    alone = pieces.Encoder(vocabulary(), pieces.N_BEST)
    for r in rows(pieces.encoded(docs)):
        scores, paths, _, trips = encode(r["text"], alone)
        assert r["paths"] == paths and r["ids"] == paths[0] and r["best_scores"] == scores
        assert len(paths) == len(scores) == len(r["round_trips"]) and all(r["round_trips"]) and all(trips)
        assert len({tuple(p) for p in paths}) == len(paths) == (pieces.N_BEST if len(r["text"] or "") > 8 else len(paths))


def test_pieces_many_chunks_like_one():
    v = vocabulary()
    chunks = sorted({pieces.matched(" " + w) for t in TEXTS if t for w in t.split(" ") if len(w) < 20} | {"▁日本", "▁", "▁▁▁a"})
    best, second, ids, counts = pieces.forward_all(chunks, v)
    at = 0
    for k, c in enumerate(chunks):
        one, two, cuts = pieces.forward(c, v)
        assert (one[-1], two) == (best[k], second[k])
        assert ids[at : at + counts[k]].tolist() == [v.pieces.get(c[a:b], (0, -1))[1] for a, b in zip([0, *cuts], cuts)]
        at += counts[k]


def test_pieces_of_very_long_texts():
    """Unspaced texts of up to a million characters, with and without ties, take time in proportion."""
    encoder = pieces.Encoder(vocabulary(), 3)
    for unit, n in (("世界和平中国人民", 1_000_000), ("a", 200_000), ("ab", 200_000)):
        text = (unit * n)[:n]
        _, paths, decoded, trips = encode(text, encoder)
        assert decoded == text and all(trips) and len(paths) == (1 if unit[0] == "世" else 3)


def test_pieces_near_the_models_own():
    """The scores by rank give about as few pieces as the model's own merges do."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    text = "The quick brown fox jumps over the lazy dog while people everywhere keep reading long newspapers. " * 3
    assert len(encode(text, pieces.Encoder(vocabulary(), 1))[1][0]) <= 1.05 * len(own.encode(text))


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
    source = {r["doc_id"]: r["text"] for r in rows(docs)}
    kept = {r["doc_id"] for r in rows(quality.repetition(docs).filter("kept"))}
    left = [(i, t) for i, t in source.items() if i in kept]
    stay = {i for i, _ in kept_rows(left)}
    left = {i: t.encode().split() for i, t in left if i in stay}
    seen = Counter(tuple(w[i : i + 35]) for w in left.values() for i in range(len(w) - 34))
    words = {i: sum(not any(seen[tuple(w[s : s + 35])] > 1 for s in range(max(0, j - 34), min(j, len(w) - 35) + 1)) for j in range(len(w))) for i, w in left.items()}
    final = rows(corpus_pipeline.run(spark, sf))
    assert {r["doc_id"] for r in final} <= stay and all(r["round_trip"] for r in final)
    total, taken = sum(words.values()), sum(words[r["doc_id"]] for r in final)
    assert abs(taken - total) < 0.1 * total
