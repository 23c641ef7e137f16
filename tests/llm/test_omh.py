import hashlib
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SF_TINY
from helpers import docs, edge_texts, words
from ledgerlane.llm import omh

HIGH = ~omh.POSITION & (2 ** 64 - 1)


def signed(x):
    return x - 2 ** 64 if x >= 2 ** 63 else x


def chain(values):
    h = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        h = xxhash.xxh64_intdigest(data, seed=h)
    return h


def signature(text, k=omh.K, slots=omh.SLOTS, size=omh.TUPLE):
    w, seen, items = words(text), {}, []
    for at in range(max(len(w) - k, 0) + 1 if w else 0):
        mer = chain(w[at:at + k]) & HIGH
        occurrence = seen[mer] = seen.get(mer, -1) + 1
        items.append((chain([signed(mer), (occurrence,)]) & HIGH, at))
    bits, out = slots.bit_length() - 1, [0] * slots
    for j in range(slots):
        least = sorted((signed(h), at) for h, at in items if h >> (64 - bits) == j)[:size]
        if least:
            hashes = [h for _, h in sorted((at, h) for h, at in least)]
            out[j] = signed(chain(hashes)) % (2 ** 31 - 1) + 1
    return out


def test_signature_is_the_brute_force_one(spark):
    texts = [t for _, t, _ in edge_texts()] + ["a b a b a b a b a b a b", "x", "x y", "a b c " * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: list(r.s) for r in df.select("i", omh.signature(F.col("t")).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == signature(t), t and t[:50]


def test_order_and_edits_count(spark):
    a = [f"w{i}" for i in range(300)]
    pairs = {"same": a, "edit": a[:150] + ["new"] + a[151:], "quarter": a[:225] + [f"n{i}" for i in range(75)],
             "blocks": [x for k in range(0, 300, 6) for x in a[k:k + 6]][::-1], "other": [f"z{i}" for i in range(300)]}
    df = spark.createDataFrame([(k, " ".join(a), " ".join(v)) for k, v in pairs.items()], "k string, a string, b string")
    got = {r.k: r.x for r in df.select("k", omh.likeness(omh.signature(F.col("a")), omh.signature(F.col("b"))).alias("x")).collect()}
    assert got["same"] == 1 and got["edit"] > 0.9 and 0.2 < got["quarter"] < got["edit"]
    assert got["other"] == 0 and got["blocks"] < 0.1  # the same words in another order are far away


def expected(rows):
    rows = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    return rows


def check(spark, rows, cells=None):
    table = docs(spark, rows)
    if cells:
        spark.conf.set("spark.sql.shuffle.partitions", str(cells))
    got = omh.compare(table).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    ordered = expected(rows)
    assert len(got) == len(ordered)
    ids = [i for i, _ in ordered]
    for k, (i, text) in enumerate(ordered):
        if ids.count(i) > 1 or ids.count(ids[(k + 1) % len(ids)]) > 1:
            continue  # rows of one id follow each other in an order of their own
        (r,), after = by_id[i], ordered[(k + 1) % len(ordered)][1]
        cut = len(text) // 4
        edited = text[:len(text) - cut] + after[:cut]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, e, b = signature(text), signature(edited), signature(after)
        assert r.fingerprint == "".join(f"{x:08x}" for x in a) and r.edited_fingerprint == "".join(f"{x:08x}" for x in e)
        for found, other in ((r.near_edited, e), (r.near_next, b)):
            used = [(x, y) for x, y in zip(a, other) if x or y]
            assert found == pytest.approx(sum(x == y for x, y in used) / len(used) if used else 1.0)


def test_edges(spark):
    check(spark, edge_texts())


def test_one_and_no_document(spark):
    check(spark, [(5, "a b c d e f g", "s")])
    check(spark, [])


def test_table_and_cells(spark):
    table = spark.read.parquet(f"{SF_TINY}/documents.parquet")
    check(spark, [(r.doc_id, r.text, r.source) for r in table.collect()])


def test_range_cells_are_sorted(spark):
    bounds = [-5, 0, 3, 10, 11, 40, 41, 90]
    got = {r.id: r.c for r in spark.range(-10, 100).select("id", omh.range_cell(F.col("id"), bounds).alias("c")).collect()}
    assert all(got[i] == sum(b <= i for b in bounds) or (got[i] == 0 and i < -5) for i in got)
