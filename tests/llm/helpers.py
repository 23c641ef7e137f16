"""Edge-case tables and plain-Python twins that several tests share."""

import random
import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Names that the operators use inside; a table may have columns called so.
CLASHES = ["size", "key", "n", "rep", "lid", "place", "tile", "score", "d", "r", "gone", "gone_id",
           "u_id", "base", "extra", "units", "mix_size", "copies", "shard", "block", "tokens", "component"]


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.expovariate(1 / 80)) % vocabulary}x" for _ in range(n))


def edge_texts():
    """(doc_id, text, source): nulls in any column, empty and long texts, ties, repeated rows, other scripts."""
    rng = random.Random(5)
    base = prose(rng, 60)
    near = base.split(" ")
    near[30] = "changed"
    long_ = "\n".join(prose(rng, 300, 4000) for _ in range(40))
    return [(1, base, "a"), (2, base, "b"), (2, base, "b"), (3, " ".join(near), "a"), (4, None, "a"), (5, "", "b"),
            (6, " \t\n", None), (7, long_, "c"), (8, "one", "a"), (9, "ünï cödé 漢字 🙂 ź", "b"),
            (10, "A a\x0bB\x0cb\r\nC  c", None), (None, base, "a"), (None, None, None),
            (12, prose(rng, 50), "a"), (13, prose(rng, 45), "c"), (14, "<|endoftext|> x\xa0y z", "b"),
            (15, "x" * 3000, "a"), (16, base.upper(), "b"), (-17, prose(rng, 8), "c"), (18, "the same line\n" * 30, "a")]


def docs(spark, rows, clash=True):
    """A documents table; with ``clash``, extra columns of the names in ``CLASHES``."""
    df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows],
                               "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"other {c}") for c in CLASHES}) if clash else df


def as_tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
