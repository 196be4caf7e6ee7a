"""Language identification, fill-in-middle and token alignment against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from capture_spark.llm import alignment, infill, langid

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = ["", " ", "\n", " a ", "a", "\t\tb", "漢字 éa b", "x▁y", "<P> a b", "<s> <|endoftext|>", "a\x00b \x1c\x85", "　  x", "w " * 3000 + "end", "q" * 20000, " " * 20000]


def folder_of(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def odd_rows():
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(ODD)]
    return [*rows, (90, None, None, None, None), (None, "no id here", "en", None, 1), (3, " a ", "en", "s", 3), (3, " a ", "en", "s", 3)]


# Fill-in-middle


def plain_infill(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNITS.findall(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in infill.MARKS) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    form = "spm" if h[3] % 100 < 80 else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_infill_of_odd_texts(spark):
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(ODD * 40)] + odd_rows()
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("source", "form").repartition(5)
    got = infill.transformed(df).withColumn("back", infill.restored()).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_infill(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}
    assert infill.transformed(df.limit(0)).collect() == []


def test_infill_batches_at_any_offset():
    r = random.Random(5)
    for _ in range(200):
        texts = [r.choice([None, "", "".join(r.choice(" \t\n\x0babé漢𝄞\x00\x1c\x7f<P>S") for _ in range(r.randint(0, 40)))]) for _ in range(r.randint(1, 20))]
        h = np.array([[r.getrandbits(32) for _ in range(4)] for _ in texts])
        n, form, prefix, middle, output = infill.apart(pa.array([None, "zz", *texts], pa.string()).slice(2), h, 100, 50)
        for k, t in enumerate(texts):
            units = UNITS.findall(t or "")
            a, b = sorted(int(x) % (len(units) + 1) for x in h[k, :2])
            assert n[k].as_py() == len(units)
            if form[k].as_py() != "plain":
                assert (prefix[k].as_py(), middle[k].as_py()) == (len("".join(units[:a])), len("".join(units[a:b])))
                assert sorted(re.split("<P>|<S>|<M>", output[k].as_py())) == sorted(["", "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])])


def test_infill_query_and_sql(spark, sf, tmp_path):
    for folder, one in ((sf, f"{sf}/documents.parquet"), (folder_of(spark, tmp_path, odd_rows()), f"{tmp_path}/documents.parquet/*.parquet")):
        con = duckdb.connect()
        con.sql(f"create view documents as select * from '{one}'")
        want = con.sql(infill.ORACLE).fetchall()
        got = [tuple(r) for r in infill.query(spark, folder).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


# Token alignment


@pytest.fixture(scope="module")
def aligner():
    with open(alignment.MODEL_A, encoding="utf-8") as f, open(alignment.MODEL_B, "rb") as g:
        return alignment.Aligner(f.read(), g.read())


def plain_alignment(aligner, text):
    """By whole texts through both libraries, and all pairs of spans."""
    none = ([], [], 0, 0, 0, 0, "", [])
    if not text:
        return none
    ids = aligner.a.whole.encode(" " + text, add_special_tokens=False).ids, aligner.b.model.encode(text)
    spans = []
    for side, raw in zip(ids, (aligner.a.raw, aligner.b.raw), strict=True):
        ends = np.cumsum([0, *[len(raw[i]) for i in side]])
        if b"".join(raw[i] for i in side) != (" " + text).encode():
            return none
        spans.append(list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)))
    links = [x * aligner.n_b + y for x, (s, e) in zip(ids[0], spans[0], strict=True) for y, (u, v) in zip(ids[1], spans[1], strict=True) if u < e and s < v]
    groups, before = [], 0
    for end in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
        parts = [",".join(str(i) for i, (_, e) in zip(ids[k], spans[k], strict=True) if before < e <= end) for k in range(2)]
        groups.append("|".join(parts))
        before = end
    return *ids, *map(len, ids), len(groups), len(links), ";".join(groups), sorted(links)


def test_alignment_of_odd_texts(aligner, monkeypatch):
    monkeypatch.setattr(alignment, "LONG", 60)
    r = random.Random(7)
    parts = [" ", "  ", "\n", "\t", "a", "the ", " and", "Zürich", "漢字", "don't", "'ll", "　", " ", "é", "©", "▁", "<s>", "<|endoftext|>", "<0x41>", "123", "!!", "\x00", "\x1c", "\x85", "𝄞", "ﬁ", "\r\n"]
    for _ in range(400):
        texts = [r.choice([None, ""]) if r.random() < 0.1 else "".join(r.choice(parts) for _ in range(r.randint(1, 25))) for _ in range(r.randint(1, 8))]
        got = list(zip(*[c.to_pylist() for c in aligner.align(pa.array(["x", *texts], pa.string()).slice(1))], strict=True))
        assert got == [plain_alignment(aligner, t) for t in texts]


def plain_sums(aligner, rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of rows of (doc_id, text)."""
    found = [(d, plain_alignment(aligner, t)) for d, t in rows]
    counts = Counter(x for _, one in found for x in set(one[7]))
    best = defaultdict(int)
    for x, n in counts.items():
        best[x // aligner.n_b] = max(best[x // aligner.n_b], n)
    return [(d, *one[2:6], sum(counts[x] == best[x // aligner.n_b] for x in one[7]), sum(counts[x] for x in one[7]), hashlib.sha256(one[6].encode()).hexdigest() if one[6] else "") for d, one in found]


def test_alignment_query(spark, aligner, tmp_path):
    rows = odd_rows() + [(100 + k, f"the {w} of {w} Zürich's {k}", "en", "s", 1) for k, w in enumerate(["cat", "dog", "cat", "unlikeliest", ""] * 4)]
    rows = [(d, t[:400] if t and len(t) > 400 else t, *x) for d, t, *x in rows]
    want = sorted(plain_sums(aligner, [r[:2] for r in rows]), key=str)
    folder = folder_of(spark, tmp_path, rows)
    assert sorted(map(tuple, alignment.query(spark, folder).collect()), key=str) == want
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumnRenamed("source", "n_best").withColumnRenamed("n_chars", "groups")
    for heavy in (1, 40):  # what is broadcast changes nothing
        got = alignment.pair_sums(alignment.aligned(docs), heavy=heavy)
        assert sorted([(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"]) for r in got.collect()], key=str) == sorted([w[:7] for w in want], key=str)
    assert alignment.pair_sums(alignment.aligned(docs.limit(0))).collect() == []


def test_alignment_of_very_long_texts(aligner):
    for text in (" " * 300_000, "a" * 300_000, " \n" * 150_000, "word " * 60_000):
        got = [c.to_pylist()[0] for c in aligner.align(pa.array([text]))]
        assert got[0] == aligner.a.whole.encode(" " + text, add_special_tokens=False).ids and got[1] == aligner.b.model.encode(text)
        assert got[5] == len(got[7]) >= max(got[2], got[3])


# Language identification


def plain_bits(rows, text):
    """Code lengths in bits of each language, by dictionaries; ``rows`` are (text, lang) to learn from."""
    n = Counter(lang for _, lang in rows)
    trees = {lang: defaultdict(Counter) for lang in n}
    for t, lang in rows:
        data = b"\n" * 4 + t.lower().encode()
        for i in range(4, len(data)):
            for k in range(5):
                trees[lang][data[i - k : i]][data[i]] += 1
    out = {}
    for lang, tree in trees.items():
        bits = -math.log2(n[lang] / len(rows))
        data = b"\n" * 4 + text.lower().encode()
        for i in range(4, len(data)):
            for k in range(4, -1, -1):
                seen = tree.get(data[i - k : i])
                if seen is None:
                    continue
                whole = sum(seen.values()) + len(seen)
                if data[i] in seen:
                    bits += math.log2(whole / seen[data[i]])
                    break
                bits += math.log2(whole / len(seen))
            else:
                bits += 8
        out[lang] = bits
    return out


def held_out(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5 == 0


SAID = {"en": "the cat and the dog went over the hill to see what was there", "de": "der Hund und die Katze gingen über den Hügel und sahen nichts", "xx": "ñandú ñoño 漢字 𝄞 ñ"}


def language_rows():
    r = random.Random(2)
    rows = []
    for k in range(120):
        lang = r.choice(list(SAID))
        words = SAID[lang].split()
        rows.append((k, " ".join(r.choice(words) for _ in range(r.randint(1, 30))), lang, "s", 1))
    return rows + [(200, None, "en", "s", 1), (201, "", "en", "s", 1), (202, "123 !!", "de", "s", 1), (203, "the hill", None, "s", 1), (None, "die Katze", "de", "s", 1), (5, rows[5][1], "en", "s", 1)]


def test_languages_by_plain_trees(spark):
    rows = language_rows()
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("source", "score").repartition(4)
    learn = [(t, lang) for d, t, lang, *_ in rows if lang and t and not held_out(d)]
    got = langid.predicted(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == held_out(r["doc_id"])
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"], r["bits"]) == ("und", 0.0, None)
            continue
        want = plain_bits(learn, r["text"])
        least = min(want.values())
        assert r["bits"] == pytest.approx(least, abs=0.01 + len(r["text"]) / langid.UNIT)
        assert r["score"] == pytest.approx(1 / sum(2 ** (least - x) for x in want.values()), abs=0.01)
        assert want[r["lang_pred"]] == pytest.approx(least, abs=0.05)
    again = langid.predicted(df.repartition(7)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


def test_languages_of_nothing(spark):
    rows = [(1, "der Hund", None, "s", 1), (2, None, "de", "s", 1)]
    got = langid.predicted(spark.createDataFrame(rows, DOCS)).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 2
    assert langid.predicted(spark.createDataFrame([], DOCS)).collect() == []


def test_languages_with_bounds_and_long_texts(spark, monkeypatch):
    rows = [(k, t * 50, lang, s, n) for k, t, lang, s, n in language_rows()[:120]]
    df = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(langid, "SLICE", 1000)  # texts over several blocks
    trees = langid.trained(df, sample=2000, cells=9 * 300)
    assert len(trees.grams[4].keys) <= 3 * 300
    assert len(langid.trained(df, languages=2).names) == 2
    whole = langid.trained(df)
    texts = pa.array([r[1] for r in rows])
    small = whole.code_lengths(*langid.led(texts))
    monkeypatch.setattr(langid, "SLICE", 1 << 20)
    assert (whole.code_lengths(*langid.led(texts)) == small).all()
    assert np.mean([a == r[2] for a, r in zip(whole.predict(texts)[0], rows, strict=True)]) == 1


def test_languages_held_out_accuracy(spark, sf):
    got = langid.query(spark, sf).collect()
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    out = [r for r in got if r["held_out"]]
    assert len(got) == len(langs) and len(out) > 20
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in out]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_kept_chunks_are_packed_and_compared_by_bytes():
    import random
    import tracemalloc

    from capture_spark.llm import pieces
    from capture_spark.llm import text as tx

    with open(pieces.MODEL, "rb") as f:
        v = pieces.Vocabulary(f.read())
    r = random.Random(4)
    words = list(dict.fromkeys("".join(r.choices("abcdefghij", k=r.randint(4, 9))) for _ in range(40_000)))
    tracemalloc.start()
    kept = pieces.Encoder(v, 3)
    for k in range(0, len(words), 10_000):
        kept.encode(pa.array([" ".join(words[k : k + 10_000])]))
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(kept.best) >= len(words) and size < 120 * len(words)
    again = kept.encode(pa.array([" ".join(words[::7])]))
    fresh = pieces.Encoder(v, 3).encode(pa.array([" ".join(words[::7])]))
    assert again[0].tolist() == fresh[0].tolist() and again[1:5] == fresh[1:5]
    one = pieces.Encoder(v, 3)
    one.encode(pa.array(["alpha"]))
    data = np.frombuffer(b" gamma", np.uint8)
    one.hashes = tx.span_hashes(data, np.array([0]), np.array([6]))  # a hash that two chunks share
    assert one.encode(pa.array(["gamma"]))[0].tolist() == pieces.Encoder(v, 3).encode(pa.array(["gamma"]))[0].tolist()
