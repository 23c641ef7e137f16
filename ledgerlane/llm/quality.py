"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

Both dictionaries are built from a bounded sample of labelled texts. A text is compressed in
short blocks with either; its features are the mean difference of the two sizes over their
sum, and the log of the compressed share. A logistic curve, fitted on other labelled texts,
turns them into a score.

Null and empty texts score by the curve at no difference and no saving. Equal texts score
alike. Without labels of both kinds every text scores 0.5. An empty table gives no rows.
Labels with a null or with both values for one id are left out. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlane.llm.common import fresh, ship

#: Labelled documents per class that the model may see, and how much of each one's text
#: goes into a dictionary (from pieces of ``PIECE`` characters all over it).
SAMPLE_DOCS, PIECE, PIECES_PER_CLASS = 1500, 2000, 2500
BLOCK, DICTIONARY, LEVEL = 256, 65_536, 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    curve: tuple[float, float, float]
    scale: tuple[float, float, float, float]

    def score(self, features: np.ndarray) -> np.ndarray:
        d, r = (features[:, 0] - self.scale[0]) / self.scale[1], (features[:, 1] - self.scale[2]) / self.scale[3]
        z = self.curve[0] + self.curve[1] * d + self.curve[2] * r
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _compressor(data: bytes):
    import zstandard

    kind = zstandard.DICT_TYPE_AUTO
    words = zstandard.ZstdCompressionDict(data, dict_type=kind)
    words.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False,
                                    write_dict_id=False)


def _dictionary(samples: list[bytes]) -> bytes:
    """Trained dictionary, or where the samples are too few to train one, their plain end."""
    import zstandard

    try:
        return zstandard.train_dictionary(min(DICTIONARY, sum(map(len, samples)) // 4), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def text_features(text: str, good, bad) -> tuple[float, float]:
    """Mean over the text's blocks, by length, of (bad - good) / (bad + good), and the log of
    the smaller size's share; (0, 0) for an empty text."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return 0.0, 0.0
    diff = size = 0.0
    for at in range(0, len(data), BLOCK):
        block = data[at:at + BLOCK]
        g, b = len(good.compress(block)), len(bad.compress(block))
        diff += len(block) * (b - g) / (b + g)
        size += min(g, b)
    return diff / len(data), float(np.log(size / len(data)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic fit by Newton's steps with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.05 * w)
    return w


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_ids(labels: DataFrame, per_class: int = SAMPLE_DOCS) -> DataFrame:
    """At most ``per_class`` ids of either quality outside the held-out fold, by hash order."""
    sure = (labels.filter("doc_id is not null and quality is not null and quality in (0, 1)")
            .filter(~held_out(F.col("doc_id"))).groupBy("doc_id")
            .agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
            .filter("label = other").select("doc_id", "label"))
    order = [F.xxhash64(F.lit("sample"), "doc_id"), F.col("doc_id")]
    parts = [sure.filter(F.col("label") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
    return parts[0].union(parts[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Dictionaries and curve from a bounded sample; None without texts of both kinds."""
    ids = [(r.doc_id, int(r.label)) for r in training_ids(labels).collect()]  # bound: 2 * SAMPLE_DOCS
    if len({k for _, k in ids}) < 2:
        return None
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame(ids, "doc_id long, label int"))  # the same bound
    texts = (docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
             .join(wanted, "doc_id").groupBy("doc_id", "label").agg(  # one row an id, the least text by hash
                 F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
             .withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))))
    starts = F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / PIECE).cast("int"))
    pieces = (texts.filter("half = 0 and text <> ''").select("label", "doc_id", "text", F.explode(starts).alias("k"))
              .select("label", "doc_id", "k", F.expr(f"substring(text, k * {PIECE} + 1, {PIECE})").alias("piece")))
    order = [F.xxhash64(F.lit("piece"), "doc_id", "k"), F.col("piece")]
    sample = {k: [r.piece.encode() for r in pieces.filter(F.col("label") == k).orderBy(*order)
                  .limit(PIECES_PER_CLASS).collect()] for k in (0, 1)}
    if not sample[0] or not sample[1]:
        return None
    model = Model(_dictionary(sample[1]), _dictionary(sample[0]), (0, 0, 0), (0, 1, 0, 1))
    seen = (_with_features(texts.filter("half = 1").select("text", "label"), model)
            .select("label", "d", "r").collect())  # two numbers a document of the sample
    if len({r.label for r in seen}) < 2:
        return None
    x, y = np.array([[r.d, r.r] for r in seen]), np.array([r.label for r in seen], float)
    mid, wide = x.mean(0), np.maximum(x.std(0), 1e-6)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)
    curve = _logistic((x - mid) / wide, y, weight)
    return Model(model.good, model.bad, tuple(map(float, curve)),
                 (float(mid[0]), float(wide[0]), float(mid[1]), float(wide[1])))


def _with_features(rows: DataFrame, model: Model, columns: tuple[str, str, str] = ("d", "r", "score"),
                   text_col: str = "text") -> DataFrame:
    """``rows`` with the two features and the score, in the batches Spark hands over."""
    ship(rows.sparkSession)
    place = rows.columns.index(text_col)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = _compressor(model.good), _compressor(model.bad)
        for batch in batches:
            found = np.array([text_features(t.as_py() or "", good, bad) for t in batch.column(place)],
                             dtype=float).reshape(-1, 2)
            more = [pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(model.score(found))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *columns])

    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.DoubleType()) for c in columns)])
    return rows.mapInArrow(measure, schema)


def score(docs: DataFrame, model: Model | None, threshold: float = 0.7, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = (rows.withColumn("score", F.lit(0.5)) if model is None
              else _with_features(rows, model))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model | None, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The documents that score ``threshold`` or more, with their columns; all without a model."""
    if model is None:
        return docs
    added = fresh(docs, "d", "r", "score")
    return _with_features(docs, model, tuple(added), text_col).filter(
        F.col(added[2]) >= threshold).select(*docs.columns)


def fold_of(doc_id: int) -> int:
    """The fold as plain arithmetic, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 4
