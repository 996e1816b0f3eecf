"""Key-value stores: round trips, the layout of pages, odd rows."""

import io
import random
import struct

import pytest

from tessera.sources import files, keyvalue


def made(tmp_path, items):
    path = tmp_path / "data.mdb"
    with open(path, "wb") as f:
        keyvalue.Writer(f).write(items)
    return str(path)


@pytest.mark.parametrize("n", [0, 1, 3, 200, 60_000])
def test_items_return(tmp_path, n):
    rng = random.Random(n)
    items = [(b"%08d" % i, rng.randbytes(rng.choice([0, 5, 40, 2000, 2030, 4080, 4081, 9000]) if n < 1000 else 12)) for i in range(n)]
    with keyvalue.Store(made(tmp_path, items)) as store:
        assert [x for page in store.units() for x in store.items(page)] == items
        assert store.entries == n and len(store.units()) <= 512
        for key, value in rng.sample(items, min(n, 50)):
            assert store.get(key) == value
        assert store.get(b"00000000x") is None and store.get(b"") is None


def test_layout(tmp_path):
    items = [(b"k%0100d" % i, bytes(30)) for i in range(20_000)]
    data = open(made(tmp_path, items), "rb").read()
    assert len(data) % 4096 == 0
    for n in (0, 1):
        page, _, flags = struct.unpack_from("<QHH", data, 4096 * n)
        assert (page, flags) == (n, 8) and struct.unpack_from("<II", data, 4096 * n + 16) == (0xBEEFC0DE, 1)
    depth, branches, leaves, over, entries, root = struct.unpack_from("<HQQQQQ", data, 4096 + 16 + 24 + 48 + 6)
    assert (over, entries) == (0, 20_000) and depth == 3 and 2 + branches + leaves == len(data) // 4096
    for n in range(2, len(data) // 4096):
        page, _, flags, lower, upper = struct.unpack_from("<QHHHH", data, 4096 * n)
        places = struct.unpack_from(f"<{(lower - 16) // 2}H", data, 4096 * n + 16)
        assert page == n and flags in (1, 2) and lower <= upper == min(places) and all(p % 2 == 0 for p in places)
        assert flags == 2 or len(places) > 1
    assert struct.unpack_from("<H", data, 4096 * root + 10) == (1,)


def test_bad_keys():
    for items in ([(b"b", b""), (b"a", b"")], [(b"a", b""), (b"a", b"")], [(b"", b"")], [(b"x" * 512, b"")]):
        with pytest.raises(ValueError):
            keyvalue.Writer(io.BytesIO()).write(items)


def test_odd_rows(spark, tmp_path):
    rows = [(3, 1, b"c"), (1, -2, b""), (None, 1, b"x"), (4, None, b"x"), (5, 1, None), (3, 1, b"b"), (123456789, 7, b"z" * 10_000)]
    df = spark.createDataFrame(rows, "idx long, label long, payload binary")
    at = str(tmp_path / "stores")
    assert sum(r.entries for r in keyvalue.write_key_values(df, at, 2, {"a": 1}).collect()) == 3
    again = keyvalue.write_key_values(df, at, 2, {"a": 1}).collect()
    got = sorted((r.key, r.label, bytes(r.payload)) for r in keyvalue.key_values(spark, at).collect())
    assert got == [("00000001", -2, b""), ("00000003", 1, b"b"), ("123456789", 7, b"z" * 10_000)]
    assert sum(files.read_any(spark, r.store).count() for r in again) == 3
    facts = keyvalue.facts(at)
    assert len(facts) == len(again) and sum(f["len"] for f in facts) == 3 and all(f["num_classes"] == 3 and f["label_map"] == {"a": 1} for f in facts)
    assert keyvalue.write_key_values(df.limit(0), str(tmp_path / "none"), 2).count() == 0
    assert keyvalue.key_values(spark, str(tmp_path / "none")).count() == 0
