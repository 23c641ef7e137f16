import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF_TINY
from helpers import docs, edge_texts
from ledgerlane.llm import pack, tokens
from ledgerlane.llm.queries import vocabulary_path
from ledgerlane.llm.tokenizer import Encoder


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(vocabulary_path())
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_cached_encoding_is_the_librarys(plain):
    enc = Encoder(vocabulary_path(), cache_entries=20)
    texts = [t for _, t, _ in edge_texts() if t] + [
        "a  b", " a", "a ", "\n\n a\n", "\na,b\r\n\tc", "it's we're 12 3.5%", "\n Word!? \n  x", "é́ ñ«»", "a​b",
        "tab\tword  \t two", "!\x1cx", "a b", "...\n", "x\n\n\ny", " \n", "Ünder_score _x_", "ﬁ ½ ² Ⅷ"]
    for t in texts * 2:
        assert enc.encode(t) == np.array(plain(t), "<u4").tobytes(), t


def test_orc_round_trip_on_edges(spark, plain, tmp_path):
    rows, path = edge_texts(), f"file://{tmp_path}/orc"
    tokens.write_tokens(docs(spark, rows), path, vocabulary_path(), shards=3)
    got = sorted(map(tuple, tokens.token_digests(spark, path).collect()), key=lambda r: r[1])
    ids = {}
    for i, t, _ in rows:
        ids.setdefault(i, []).append([*plain(t), 0])
    assert [r[0] for r in got] == sorted((i for i, _, _ in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for doc_id, start, n, found in got:
        assert start == at
        at += n
        assert (n, found) in [(len(x), crc(x)) for x in ids[doc_id]]


def test_files_carry_bloom_filters_and_prune(spark, tmp_path):
    from pyarrow import orc
    path = f"{tmp_path}/orc"
    tokens.write_tokens(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text")),
                        f"file://{path}", vocabulary_path(), shards=4, index_stride=1000)
    assert tokens.read_tokens(spark, path, F.col("doc_id").isin(7, 3999)).count() == 2
    assert sum(orc.ORCFile(p).nrows for p in tmp_path.glob("orc/*.orc")) == 4000
    raw = b"".join(p.read_bytes() for p in tmp_path.glob("orc/*.orc"))
    assert raw


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    tokens.write_tokens(docs(spark, []), path, vocabulary_path())
    assert tokens.token_digests(spark, path).count() == 0
    assert pack.pack_documents(docs(spark, []), vocabulary_path()).count() == 0


def check_packed(rows, packed, plain, window):
    ids = {}
    for i, t, _ in rows:
        ids.setdefault(i, []).append(tuple([*plain(t), 0]))
    pieces, sequences = {}, {}
    for r in packed:
        part = tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())
        assert len(part) == r.length > 0
        pieces.setdefault(r.doc_id, []).append((r.start, part, r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, want in ids.items():
        for size in {len(x) for x in want}:
            found = sorted((s, p) for s, p, n in pieces[i] if n == size)
            alike = [x for x in want if len(x) == size]
            assert sum(len(p) for _, p in found) == size * len(alike)
            assert all(any(x[s:s + len(p)] == p for x in alike) for s, p in found)
            for x in alike if len(set(alike)) == 1 else []:
                starts = sorted(s for s, _ in found)
                assert starts.count(0) == len(alike)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0


@pytest.mark.parametrize("window,shard", [(64, 4), (1024, 1024), (1024, 3)])
def test_packing_places_every_id_once(spark, plain, window, shard):
    rows = edge_texts()
    pieces = pack.encode_pieces(docs(spark, rows), vocabulary_path(), window)
    check_packed(rows, pack.pack(pieces, window, shard).collect(), plain, window)


def test_packing_a_table(spark, plain):
    table = spark.read.parquet(f"{SF_TINY}/documents.parquet")
    rows = [(r.doc_id, r.text, None) for r in table.collect()]
    check_packed(rows, pack.pack_documents(table, vocabulary_path()).collect(), plain, 1024)


def test_index_scores_are_bm25():
    rng = np.random.default_rng(3)
    pieces = [rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint32) for _ in range(30)]
    index, mean = pack.Index(pieces), np.mean([len(p) for p in pieces])
    for seed in (0, 7):
        want = np.zeros(30)
        for t in set(pieces[seed].tolist()):
            df = sum(t in p for p in pieces)
            idf = np.log((30 - df + 0.5) / (df + 0.5))
            if idf > 0:
                for k, p in enumerate(pieces):
                    tf = int((p == t).sum())
                    want[k] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(p) / mean)) if tf else 0
        assert np.allclose(index.scores(seed), want)


def test_neighbours_share_a_window(spark):
    """Pieces on one topic are packed together rather than in table order."""
    rows = [(k, " ".join(f"{'apple' if k % 2 else 'stone'}{(k * 7 + j) % 25}" for j in range(40)), "s") for k in range(40)]
    packed = pack.pack_documents(docs(spark, rows, clash=False).coalesce(1), vocabulary_path(), 512).collect()
    same = [len({r.doc_id % 2 for r in packed if r.sequence_id == s}) for s in {r.sequence_id for r in packed}]
    assert np.mean(same) < 1.5


def test_key_brings_alike_pieces_together(spark):
    """The end id, which all pieces hold, has no part in the key, and one common id doesn't gather the table."""
    rng = np.random.default_rng(4)
    topics = [100 + 40 * k + np.arange(40) for k in range(30)]
    pieces = [(k, 0, np.concatenate([rng.choice(topics[k % 30], 25), rng.integers(1, 20, 60), [0]]).astype("<u4")) for k in range(900)]
    table = spark.createDataFrame([(k, s, x.tobytes()) for k, s, x in pieces], "doc_id long, start long, ids binary")
    total, held = pack.holders(table)
    assert total == 900 and held[0] == 900
    assert all(held[t] == sum(t in p for _, _, p in pieces) for t in (1, 19, 100, 1299))
    orders = pack.key_orders(pack.rarity(total, held))
    assert (orders[:, 0] == orders.max(axis=1)).all()
    keys = np.array([pack._key(p, orders) for _, _, p in pieces])
    assert np.unique(keys, return_counts=True)[1].max() < 45
    by_key = np.argsort(keys, kind="stable")
    assert np.mean(by_key[1:] % 30 == by_key[:-1] % 30) > 0.8


def test_terms_that_most_of_a_block_holds_score():
    """Weights are of the whole table, and none is dropped: a block of copies scores, and so do two topics of half a block."""
    weights = pack.rarity(1000, np.array([1000, 20, 20, 20, 20]))
    assert (weights > 0).all()
    index = pack.Index([np.array([1, 2, 0], "<u4")] * 4, weights=weights)
    assert (index.scores(0) > 0).all()
    topics = [np.array([1, 2, 0] if k % 2 else [3, 4, 0], "<u4") for k in range(8)]
    score = pack.Index(topics, weights=weights).scores(1)
    assert score[1::2].min() > 100 * score[::2].max() > 0
    want = sum(weights[t] * 2.2 / 2.2 for t in (0, 1, 2))
    assert np.allclose(score[3], want)


def test_batches_of_texts_are_small_and_the_setting_returns(spark):
    """What is written within the block reaches Python in few rows at a time, as the writers of tokens and pieces do."""
    from ledgerlane.llm import common

    def sizes(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    was = spark.conf.get(common.BATCH_ROWS)
    with common.small_batches(spark, 100):
        most = common.staged(spark.range(0, 1000, 1, 1).mapInArrow(sizes, "n long"), "sizes").agg({"n": "max"}).first()[0]
    assert most == 100 and spark.conf.get(common.BATCH_ROWS) == was


def test_keys_of_a_batch_and_best_scores():
    """A batch's keys are those of its pieces, and the best scores are the head of the full order, ties included."""
    rng = np.random.default_rng(11)
    orders = np.stack([rng.permutation(500) for _ in range(3)])
    pieces = [rng.integers(0, 500, int(n)).astype("<u4") for n in rng.integers(1, 40, 50)]
    want = [tuple(int(x) for x in orders[:, p].min(axis=1)) for p in pieces]
    assert pack._keys([p.tobytes() for p in pieces], orders).tolist() == [(a << 42) | (b << 21) | c for a, b, c in want]
    for n in (1, 5, 33, 200):
        score = rng.integers(0, 6, 120).astype(float)
        near = np.flatnonzero(score > 0)
        assert pack._best(score, n).tolist() == near[np.lexsort((near, -score[near]))][:n].tolist()
