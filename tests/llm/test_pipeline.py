"""Each stage against the operators' plain versions, on its own input."""

import hashlib

import corpus_pipeline as c
from tessera.llm import secrets

from .test_measures import check_pieces, measures
from .test_scans import repeats_by_hand
from .test_similar import roots_by_hand


def kept_by_rules(rows):
    """The ids that the base rules, the method's own rules and the hosts' verdicts keep."""
    failed, hosts = {}, {}
    for r in rows:
        n, chars, symbols, dup, repeated = measures(r.text)
        lines = sum(bool(x.split()) for x in (r.text or "").split("\n"))
        failed[r.doc_id] = n < 50 or 100 * repeated > 50 * n or symbols > n or chars < 2 * n or chars > 15 * n or 2 * dup > lines
        total, bad = hosts.get(r.source, (0, 0))
        hosts[r.source] = (total + 1, bad + failed[r.doc_id])
    n, k = sum(x for x, _ in hosts.values()), sum(x for _, x in hosts.values())
    mean, share = k / n, len(hosts) / n
    within = mean * (1 - mean)
    between = max((sum(b * b / t for t, b in hosts.values()) / n - mean**2 - within * share) / max(1 - share, 1e-9), within / 1001)
    weight = 1000 if within <= 0 else max(1, min(1000, within / between - 1))
    good = {h for h, (t, b) in hosts.items() if (b + mean * weight) / (t + weight) <= 0.5}
    return {r.doc_id for r in rows if not failed[r.doc_id] and r.source in good}


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = [docs.collect()]
    for i, (_, stage) in enumerate(c.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        held.append(docs.collect())
    start, rules, dedup, passages, secret, packed = held
    assert {r.doc_id for r in rules} == kept_by_rules(start) and len({r.doc_id for r in start}) == len(start)
    assert all(r in start for r in rules)
    by_id = sorted(rules, key=lambda r: r.doc_id)
    roots = roots_by_hand([r.text for r in by_id])
    assert sorted(r.doc_id for r in dedup) == [by_id[i].doc_id for i in sorted(set(roots))]
    want = repeats_by_hand([r.text for r in dedup], 35)
    got = {r.doc_id: r.text for r in passages}
    assert [hashlib.sha256(b" ".join(got[r.doc_id].encode().split())).hexdigest() for r in sorted(dedup, key=lambda r: r.doc_id)] == [w[2] for _, w in sorted(zip([r.doc_id for r in dedup], want, strict=True))]
    clean = {r.doc_id: r.text for r in secret}
    assert set(clean) == set(got) and not any(secrets.base_spans(t) for t in clean.values())
    assert all(r.n_chars == len(r.text) for r in secret)
    assert {r.doc_id for r in packed} == set(clean) and check_pieces(packed, clean) == 0


def test_run_equals_the_stages(spark, sf_dir):
    assert c.run(spark, sf_dir).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_stages_take_odd_rows(spark, odd_docs, no_docs, tmp_path, sf_dir):
    for name, start in (("odd", odd_docs), ("none", no_docs)):
        docs = start.select(*c.COLUMNS)
        for i, (_, stage) in enumerate(c.STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}{i}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{i}")
        assert name == "odd" or docs.count() == 0
