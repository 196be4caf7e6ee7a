"""Cases that once gave wrong answers or ended a task."""

import numpy as np
import pyarrow as pa
import pytest

from capture_spark.llm import licenses, mixing, neardup, neighbours, substrings
from capture_spark.llm import text as tx

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") & 1] for k in range(n))


def test_word_hashes_tell_thue_morse_words_apart():
    one = thue_morse(4096)
    two = one.translate(str.maketrans("ab", "ba"))
    for salt in (0, tx.SECOND):
        h = tx.Words(pa.array([f"{one} {two} {one}"])).hashes(salt)
        assert h[0] == h[2] != h[1]
    v = np.array([["ab".index(c) for c in x] for x in (one, two)], np.uint64).ravel()
    s = tx.sequence_hashes(v, np.array([0, 4096, 8192]))
    assert s[0] != s[1]


def test_span_hashes_by_their_bytes():
    data = np.frombuffer(b"abcdefgh" * 3 + b"xabcdefghabcdefghabcdefgh" + b"\0\0", np.uint8)
    h = tx.span_hashes(data, np.array([0, 25, 0, 8, 49, 49, 0]), np.array([24, 49, 8, 16, 50, 51, 0]))
    assert h[0] == h[1] and h[2] == h[3] and len(set(h.tolist())) == 5


def test_unlike_words_are_kept(spark):
    shared = " ".join(f"w{k}" for k in range(34))
    one = thue_morse(1024)
    rows = [(1, f"{shared} {one}", None, None, 1), (2, f"{shared} {one.translate(str.maketrans('ab', 'ba'))}", None, None, 1)]
    df = spark.createDataFrame(rows, DOCS)
    assert sorted(r["text"] for r in substrings.cut(df).collect()) == sorted(r[1] for r in rows)
    words = [[x, y] for x, y in zip(one, one.translate(str.maketrans("ab", "ba")), strict=True)]
    texts = [(k, " ".join(w[k] for w in words), None, None, 1) for k in range(2)]
    got = neardup.near_duplicates(spark.createDataFrame(texts, DOCS)).collect()
    assert len(got) == 2


@pytest.mark.parametrize("big", [3e6, 3e4])
def test_products_past_doubles(spark, big):
    rows = [(0, [big, 1 / 256]), (1, [big, 1 / 256]), (2, [big, 2 / 256]), (3, [-big, 5.0]), (4, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in neighbours.top_k(df).orderBy("rank").collect()]
    scaled = {k: [int(np.floor(256 * c)) for c in v] for k, v in rows}
    want = sorted(((-sum(a * b for a, b in zip(scaled[0], scaled[k], strict=True)), k) for k in range(1, 5)))
    assert got == [(n + 1, k, -s) for n, (s, k) in enumerate(want)] and got[0][1] == 2


def test_products_by_plain_numbers():
    r = np.random.default_rng(3)
    for scale in (10, 2**20, 2**28):
        x = np.floor(r.normal(size=(400, 6)) * scale)
        ids = np.arange(400)
        got, scores = neighbours.search(x[::50], ids[::50], x, ids)
        for k, q in enumerate(range(0, 400, 50)):
            want = sorted((-sum(int(a) * int(b) for a, b in zip(x[q], x[j], strict=True)), j) for j in range(400) if j != q)[:5]
            assert [(-int(s), int(i)) for s, i in zip(scores[k], got[k], strict=True)] == want


def test_products_that_no_long_holds(spark):
    df = spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="long"):
        neighbours.top_k(df)


def test_many_licence_lines(spark):
    plain = "\n".join(next(iter(licenses.SENTENCES.values())) for _ in range(3))
    rows = [(1, "All rights reserved.\n" * 20_000, None, None, 1), (2, plain + "\n" + "All rights reserved.\n" * 5000 + plain, None, None, 1)]
    got = licenses.scan(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 2 and all(r["n_sentences"] > 4000 for r in got)


def test_mix_of_rows_without_ids(spark):
    rows = [(None, f"word{k} and another", None, "s" if k % 3 else "t", 1) for k in range(400)]
    df = spark.createDataFrame(rows, DOCS)
    taken = [sorted(r["text"] for r in mixing.mixed(df.repartition(n)).collect()) for n in (3, 7)]
    assert taken[0] == taken[1] and len(taken[0]) > 100
    clash = df.withColumnRenamed("lang", "mix_tie")
    assert sorted(mixing.mixed(clash).columns) == sorted(clash.columns)
