"""The method's own rules: texts and hosts that the base rules let pass."""

import pyarrow.dataset as ds

from tessera.llm import quality

from .test_measures import measures

GOOD = " ".join(f"word{j}" for j in range(60))
LINES = "\n".join(f"word{j}a word{j}b word{j}c" for j in range(20))
JUNK = {
    "symbols": " ".join(f"$$%word{j}" for j in range(60)),
    "short": " ".join(chr(0x4E00 + j) for j in range(60)),
    "long": " ".join(f"word{j}" * 4 for j in range(60)),
    "lines": "\n".join([*(f"w{j}a w{j}b w{j}c w{j}d" for j in range(30)), *(["one"] * 40)]),
}


def test_each_rule_rejects(spark):
    rows = [(0, GOOD, None), (1, LINES, None), *((i, t, None) for i, t in enumerate(JUNK.values(), 2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert not any(r.base_failed for r in got.values()) and all(r.kept for r in got.values())
    assert [got[i].method_kept for i in range(6)] == [True, True, False, False, False, False]
    assert sorted(r.doc_id for r in quality.filtered(docs).collect()) == [0, 1]


def test_host_of_junk_is_rejected(spark):
    rows = [(i, GOOD, f"good{i % 5}") for i in range(300)] + [(1000 + i, JUNK["symbols"], "bad") for i in range(200)] + [(2000, GOOD, "bad")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert got[0].method_kept and got[2000].kept and not got[2000].method_failed and not got[2000].method_kept
    assert sorted(r.doc_id for r in quality.filtered(docs).collect()) == list(range(300))


def test_no_junk_is_left(spark):
    at = "/root/testdata/sf0.01"
    texts = dict(zip(*ds.dataset(f"{at}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pydict().values(), strict=True))
    left = [r.doc_id for r in quality.filtered(spark.read.parquet(f"{at}/documents.parquet")).collect()]
    for i in left:
        n_words, chars, symbols, dup, repeated = measures(texts[i])
        assert n_words >= 50 and 100 * repeated <= 50 * n_words and symbols <= n_words and 2 * n_words <= chars <= 15 * n_words
