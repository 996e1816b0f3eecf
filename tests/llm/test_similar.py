"""Near copies of the pipeline's stage against all pairs, and other distances of SimHash."""

from fractions import Fraction

import numpy as np
import pyarrow.dataset as ds
import pytest

import corpus_pipeline as c
from tessera.llm import similar, simhash

from .test_measures import brute_components


def runs_of(text, k=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def roots_by_hand(texts):
    sets = [runs_of(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            small, great = sorted((len(a), len(b)))
            if 5 * small >= 4 * great and (both := len(a & b)) * 9 >= 4 * (len(a) + len(b)) and (both or not a):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(sets))]


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return sorted(r.doc_id for r in c.near_duplicates(spark, docs, "").collect())


def test_pivots_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(similar, "MEMBERS", 2)
    test_near_copies_at_the_threshold(spark)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_near_copies_of_a_table(spark, size):
    t = ds.dataset(f"/root/testdata/{size}/documents.parquet").to_table(columns=["doc_id", "text"])
    rows = sorted(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))
    assert kept(spark, rows) == [rows[i][0] for i in sorted(set(roots_by_hand([x for _, x in rows])))]


def test_near_copies_at_the_threshold(spark):
    """Chains of changed copies, pairs just above and below 0.8, a passage in all texts, short and empty texts."""
    rng = np.random.default_rng(3)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    passage, texts = words(30), ["", None, " \n", "a b", "A  B", "a b c"]
    for _ in range(40):
        text = words(int(rng.integers(40, 120)))
        for _ in range(int(rng.integers(1, 6))):
            texts.append(" ".join(text + passage))
            text = list(text)
            for at in rng.integers(0, len(text), int(rng.integers(1, 5))):
                text[at] = "x" + str(rng.integers(0, 10**6))
    want = roots_by_hand(texts)
    assert 46 <= len(set(want)) < len(texts) - 20
    assert kept(spark, list(enumerate(texts))) == sorted(set(want))


def test_bands_meet_similar_sets():
    """Of 2000 pairs at a similarity of 0.8, one at most shares no band; of pairs at 0.3, few share one."""
    rng = np.random.default_rng(8)
    met = [0, 0]
    for k, (both, own) in enumerate(((160, 20), (60, 70))):
        for _ in range(2000):
            x = rng.integers(0, 1 << 63, both + 2 * own, dtype=np.uint64)
            met[k] += bool((similar.bands(np.sort(x[: both + own])) == similar.bands(np.sort(np.concatenate([x[:both], x[both + own :]])))).any())
    assert met[0] >= 1999 and met[1] <= 100
    assert similar.similar(np.arange(9), np.arange(1, 10), Fraction(4, 5)) and not similar.similar(np.arange(9), np.arange(2, 11), Fraction(4, 5))


@pytest.mark.parametrize("distance", [0, 1, 3, 5])
def test_links_at_other_distances(spark, distance):
    rng = np.random.default_rng(distance)
    fps = set()
    for _ in range(20):
        f = int(rng.integers(0, 1 << 62))
        for _ in range(6):
            fps.add(f)
            for b in rng.integers(0, 64, 3):
                f ^= 1 << int(b)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(df, distance, full_bucket=2)).collect()}
    names = [got.get(simhash.signed(f), simhash.signed(f)) for f in fps]
    want = brute_components(fps, distance)
    assert [names.index(n) for n in names] == [want.index(w) for w in want]


def test_fingerprints_find_near_copies_without_bands(spark, monkeypatch):
    """Texts that differ in one word of 3000 are found by their fingerprints alone; texts with like fingerprints but other words are not linked."""
    monkeypatch.setattr(similar, "bands", lambda held: np.zeros(0, np.int64))
    rng = np.random.default_rng(12)
    texts = []
    for _ in range(4):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 3000)]
        texts.append(" ".join(words))
        words[1500] = "x"
        texts.append(" ".join(words))
    prints = [similar.fingerprint(similar.shingles(t.encode())) for t in texts]
    assert any(a != b for a, b in zip(prints[::2], prints[1::2], strict=True))
    near = [((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in zip(prints[::2], prints[1::2], strict=True)]
    assert sum(near) >= 2
    assert kept(spark, list(enumerate(texts))) == sorted([0, 2, 4, 6] + [2 * i + 1 for i in range(4) if not near[i]])
    monkeypatch.setattr(similar, "fingerprint", lambda held: len(held) % 2)
    other = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, n)) for n in (60, 60, 61, 62)]
    assert kept(spark, list(enumerate(other))) == [0, 1, 2, 3]
