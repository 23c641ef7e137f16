"""Personal data: base patterns against plain regular expressions, the model by held-out accuracy."""

import hashlib
import random
import re

import numpy as np
import pytest
from helpers import as_tuples, docs, edge_texts
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerlane.llm import pii
from ledgerlane.llm.bilstm import Tagger

COLUMNS = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]


def brute_base(text):
    """The contract's patterns as they stand."""
    def ok(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            total = sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(digits[::-1]))
            return 16 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    patterns = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    return [(kind, m.start(), m.end()) for kind, p in patterns for m in re.finditer(p, text) if ok(kind, m[0])]


def test_base_spans_match_the_patterns():
    rng = random.Random(4)
    pool = ["a", "b.c", "@", "@x.y", ".", "-", " ", "+", "1", "25", "255", "256", "007", "1.2.3.4", "4539148803436467", "(", ")",
            "é", "😀", "+1 (017) 555-7713", "x@y", "%", "_", "\n", "4539 1488 0343 6467", "--", "  ", "0000"]
    for _ in range(4000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(1, 18)))
        assert pii.base_spans(text) == brute_base(text), text


def test_base_spans_of_long_runs_take_one_pass():
    for text in ("x" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 150_000, "+1" + "(" * 300_000, "9 " * 200_000):
        assert pii.base_spans(text) == [] or text.startswith("1.")


def test_gradients_are_those_of_the_likelihood():
    rng = np.random.default_rng(0)
    allowed, first = pii.label_rules()
    tagger = Tagger(9, allowed, first, size=3, embed=2, kind=np.float64)
    x, y = rng.integers(0, 9, (4, 7)), np.array([[0, 1, 2, 2, 0, 0, 3], [0, 0, 0, 0, 0, 0, 0], [7, 8, 0, 5, 6, 6, 1], [3, 3, 4, 0, 1, 0, 0]])
    _, grads = tagger.gradients(x, y)
    for name, g in grads.items():
        w = tagger.weights[name]
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in w.shape)
            was, e = w[at], 1e-6
            w[at] = was + e
            up, _ = tagger.gradients(x, y)
            w[at] = was - e
            down, _ = tagger.gradients(x, y)
            w[at] = was
            assert abs((up - down) / (2 * e) - g[at]) < 1e-6, (name, at)


def test_marginals_match_all_paths():
    rng = np.random.default_rng(1)
    tagger = Tagger(5, *pii.label_rules(), size=2, embed=2, kind=np.float64)
    tagger.weights["trans"] = rng.normal(size=(9, 9))
    x = rng.integers(0, 5, (1, 3))
    w = tagger.weights
    e = (tagger._both(tagger._states(x)[1]) @ w["out"] + w["bias"])[:, 0]
    total = np.zeros((3, 9))
    for path in np.ndindex(9, 9, 9):
        if tagger.first[path[0]] and all(tagger.allowed[a, b] for a, b in zip(path, path[1:])):
            p = np.exp(w["start"][path[0]] + sum(e[t, k] for t, k in enumerate(path)) + sum(w["trans"][a, b] for a, b in zip(path, path[1:])))
            for t, k in enumerate(path):
                total[t, k] += p
    assert np.allclose(tagger.marginals(x)[0], total / total.sum(1, keepdims=True))


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text"))


def test_held_out_spans(model):
    """Fresh windows of other values and other surroundings than those learnt from."""
    x, y = pii.training_set([], 600, seed=77)
    guess = model.marginals(x).argmax(2)
    assert (guess == y).mean() > 0.95 and (guess > 0)[y == 0].mean() < 0.03 and (guess == y)[y > 0].mean() > 0.85


def test_other_spellings_are_added_and_other_numbers_are_not(model):
    rng, texts, where = np.random.default_rng(5), [], []
    for k in range(200):
        kind = pii.KINDS[k % 4]
        value = pii.respelled(rng, kind, pii.stand_in(rng, kind))
        head = "and the onth of the " * int(rng.integers(1, 9))
        texts.append(f"{head}{value} the onre and ing of the")
        where.append((kind, len(head), len(head) + len(value)))
    base = [pii.base_spans(t) for t in texts]
    found = pii.added_spans(model, texts, base)
    open_ = [k for k in range(200) if not base[k] and pii.accepted(where[k][0], texts[k][slice(*where[k][1:])])]
    assert len(open_) > 100 and np.mean([where[k] in found[k] for k in open_]) > 0.6
    calm = ["the " * int(rng.integers(1, 9)) + pii.decoy(rng) + " of the onre and the ing" for _ in range(400)]
    wrong = sum(map(len, pii.added_spans(model, calm, [pii.base_spans(t) for t in calm])))
    assert wrong <= 8


def test_undecoded_windows_hold_no_span(model):
    """Windows far from any trigger sign don't change the result."""
    rng = np.random.default_rng(8)
    texts = ["and the of on " * 40 + pii.respelled(rng, k, pii.stand_in(rng, k)) + " onre ing the " * 40 for k in pii.KINDS * 4]
    base = [pii.base_spans(t) for t in texts]
    some = pii.added_spans(model, texts, base)
    step, was = pii.WINDOW // 2, pii.chains
    try:
        pii.chains = lambda text: [list(range(0, len(text), step))]
        every = pii.added_spans(model, texts, base)
    finally:
        pii.chains = was
    assert some == every and sum(map(len, some)) > 4


def test_windows_meet_in_a_long_chain(model):
    rng = np.random.default_rng(6)
    values = [pii.respelled(rng, "ip", pii.stand_in(rng, "ip")) for _ in range(120)]
    text = " the ".join(values)
    whole = pii.added_spans(model, [text], [pii.base_spans(text)])[0]
    assert len(whole) > 60 and all(text[a:b] in values for _, a, b in whole)


def test_table_with_edges(spark, model):
    rows = edge_texts() + [(30, "mail a.b@c.de now", "a"), (31, "💳 4539148803436467, +49 (030) 555-1234 @ 10.0.0.255!", "a"),
                           (31, "💳 4539148803436467, +49 (030) 555-1234 @ 10.0.0.255!", "a")]
    got = as_tuples(pii.find(docs(spark, rows).repartition(3), model), *COLUMNS)
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows if i is not None}
    for doc_id, *counts, sha, spans, n_added in got:
        if doc_id is None:
            continue
        base = brute_base(texts[doc_id] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert counts == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert sha == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(spans.split(",")) | {""}
        assert len([s for s in spans.split(",") if s]) == len(base) + n_added
    assert pii.find(docs(spark, rows).limit(0), model).count() == 0


def test_fit_without_labelled_spans_and_reruns(spark):
    empty = docs(spark, [(1, None, "a"), (2, "no numbers", "a")]).select("doc_id", "text")
    one, two = pii.fit(empty, examples=64, steps=3), pii.fit(empty.repartition(2), examples=64, steps=3)
    assert all(np.array_equal(one.weights[k], two.weights[k]) for k in one.weights)


def test_sample_is_bounded(spark):
    rows = docs(spark, [(k, f"number {k} " + "x" * (50_000 if k == 3 else 3), "s") for k in range(50)]).select("doc_id", "text")
    texts = pii.sample_texts(rows, 10)
    assert len(texts) == 10 and max(map(len, texts)) <= 40_000
    assert sorted(texts) == sorted(pii.sample_texts(rows.withColumn("doc_id", F.col("doc_id") + 1).repartition(5), 10))
