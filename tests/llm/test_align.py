"""Cross-tokenizer alignment against whole-text encodings and plain counting."""

import hashlib
import random
from collections import Counter

import pytest
from helpers import as_tuples, docs, edge_texts

from ledgerlane.llm import align
from ledgerlane.llm.queries import vocabulary_path

A, B = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def whole(text):
    """(A ids, B ids, A byte ranges, B byte ranges) of a whole text; None without tokens."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    if not whole.tools:
        whole.tools = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        whole.tools[0].encode_special_tokens = True
    a, b = whole.tools
    if not text:
        return None
    raw = (" " + text).encode()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    sign = {c: n for n, c in align_signs().items()}
    sides = ([bytes(sign[c] for c in a.id_to_token(i)) for i in ids_a],
             [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
              for i in ids_b])
    if any(b"".join(s) != raw for s in sides):
        return None
    ranges = []
    for s in sides:
        at, own = 0, []
        for part in s:
            own.append((at, at + len(part)))
            at += len(part)
        ranges.append(own)
    return ids_a, ids_b, *ranges


whole.tools = None


def align_signs():
    """Byte -> sign, as the byte-level alphabet is published."""
    plain = list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1)) + list(range(ord("®"), ord("ÿ") + 1))
    out, n = {}, 0
    for byte in range(256):
        if byte in plain:
            out[byte] = chr(byte)
        else:
            out[byte] = chr(256 + n)
            n += 1
    return out


def brute(rows):
    """The contract, by comparing every A range with every B range."""
    seen, pairs_of = [], Counter()
    for doc_id, text in rows:
        found = whole(text)
        if found is None:
            seen.append((doc_id, 0, 0, 0, [], ""))
            continue
        ids_a, ids_b, ra, rb = found
        links = [(ids_a[i], ids_b[j]) for i, (s, e) in enumerate(ra) for j, (t, u) in enumerate(rb) if s < u and t < e]
        pairs_of.update(set(links))
        cuts = sorted({e for _, e in ra} & {e for _, e in rb})
        groups, start = [], 0
        for cut in cuts:
            mine = [",".join(str(x) for x, (s, e) in zip(ids, r) if start <= s and e <= cut)
                    for ids, r in ((ids_a, ra), (ids_b, rb))]
            groups.append("|".join(mine))
            start = cut
        seen.append((doc_id, len(ids_a), len(ids_b), len(groups), links,
                     hashlib.sha256(";".join(groups).encode()).hexdigest()))
    high = {}
    for (a, _), n in pairs_of.items():
        high[a] = max(high.get(a, 0), n)
    return sorted([(d, na, nb, g, len(links), sum(pairs_of[x] == high[x[0]] for x in links),
                    sum(pairs_of[x] for x in links), sha) for d, na, nb, g, links, sha in seen], key=repr)


TRICKY = ["▁", "a▁b", " ", "  ", "a  b", " lead", "trail ", "trail\n", "x\n\n  y", "x \n y", "a\r\nb", ";\r", "tab\there",
          "<|endoftext|>", "<s> </s> <unk> <0x41>", "don't  won't\n'll", "漢字かな 🙂🙂", "ﬁ ﬂ", "a b", "éé",
          "\x00\x01", "0123456789 12345", "....\n....", "A" * 200, "\n", "\n\n", "　x", "a​b", "﻿x"]


def test_edges_and_ties_match_brute_force(spark):
    rows = edge_texts()
    rows = [(i, t if t is None else t[:3000], s) for i, t, s in rows] + [(100 + k, t, "t") for k, t in enumerate(TRICKY)]
    got = as_tuples(align.align_documents(docs(spark, rows).repartition(3), A, B), *COLUMNS)
    assert got == brute([(i, t) for i, t, _ in rows])


def test_random_texts_chunked_as_whole():
    rng, one = random.Random(3), align.aligner(A, B)
    pool = [" ", " ", "  ", "\n", "a", "the", "Hello", ",", ".", "'s", "n't", "é", "漢", "🙂", "1", "23", "://", "\n\n", "_", "\t"]
    for _ in range(1500):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(1, 14)))
        [found], expected = one.align([text]), whole(text)
        assert bool(found) == (expected is not None), text
        if found:
            ids = [g.split("|") for g in b";".join(p[4] for p in found).decode().split(";")]
            assert [int(x) for g in ids for x in g[0].split(",")] == expected[0], text
            assert [int(x) for g in ids for x in g[1].split(",")] == expected[1], text


@pytest.mark.parametrize("spill_links, fan, task_bytes, radixes", [(200, 2, 100, 3), (50, 3, 64, 1)])
def test_small_spills_many_merge_levels(spark, spill_links, fan, task_bytes, radixes):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choice(["the", "then", "Zebra", "naïve", "token", "tokenizer"]) for _ in range(rng.randint(0, 25))), "s")
            for k in range(70)] + [(200, None, "s")]
    got = align.align_documents(docs(spark, rows).repartition(4), A, B, radixes=radixes, spill_links=spill_links,
                                fan=fan, task_bytes=task_bytes)
    assert as_tuples(got, *COLUMNS) == brute([(i, t) for i, t, _ in rows])


def test_empty_table_and_no_tokens(spark):
    none = docs(spark, []).limit(0)
    assert align.align_documents(none, A, B).count() == 0
    got = as_tuples(align.align_documents(docs(spark, [(1, None, "a"), (2, "", "a")]), A, B), *COLUMNS)
    assert got == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_a_hot_radix_is_shared(spark):
    rows = [(k, "the the the", "s") for k in range(60)]
    spilled = align.spill(docs(spark, rows, clash=False).select("doc_id", "text").repartition(4), A, B, 2, 8).cache()
    runs = spilled.filter("radix is not null")
    counts = align.merge_runs(runs, 60, 4)
    plan = align.contributions(runs, counts, task_bytes=40)
    busy = plan.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(1 for n in busy if n) > 4
    spilled.unpersist()
