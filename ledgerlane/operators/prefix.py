"""Distributed running count / running sum in a total order (the changelog
operators A1 and A2).

``Window.partitionBy(key).orderBy(t)`` puts every row of a key in one task; the
revenue changelog has a single key, so that is one task for all data. Here
the work is spread evenly instead:

1. ``repartitionByRange(N, key…, order…)``: a sampled range shuffle. The
   order columns include a unique tie-break, so even a key that holds a third
   of all rows is cut into many partitions. Rows are sorted inside each
   partition and tagged with ``spark_partition_id()``.
2. Local prefix per partition (``mapInArrow``): running count and sum per key
   in the partition's sorted order, vectorised with Arrow/numpy. Spark has no
   partition-local window, and expressing one with a window function costs a
   second full shuffle; this pass needs none.
3. The prefixed rows are written once to the shared checkpoint folder; this
   cuts the lineage, so partition ids and local values can no longer change
   under a recomputation. Offsets: per (partition, key) totals by a JVM
   aggregation over the stored rows (reading four columns), then an exclusive
   prefix over partitions per key. Keys are contiguous in range order, so only a
   partition's first key can have rows in earlier partitions: the offsets
   table has at most N rows, a proven bound, and is broadcast.
4. Running value = offset + local value, null-safe on keys.

Sums are exact: decimals stay 128-bit decimals and are added in 32-bit limbs;
a sum of more than 38 digits raises, within and across batches and
partitions, with and without ANSI. The result follows SQL
``SUM/COUNT(...) OVER (PARTITION BY key ORDER BY order ROWS UNBOUNDED
PRECEDING)``: a running sum over only nulls so far is null.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlane.session import partitions_for, shared_path, ship

_PART = "_lp_part"


#: Largest magnitude of a DECIMAL(38, s) as an unscaled integer.
_LIMIT = 10 ** 38 - 1


def _limbs(col) -> list:
    """Unscaled decimals (null: 0) as four 32-bit limbs in int64 arrays; the last one is signed."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    filled = pc.fill_null(col, pa.scalar(Decimal(0), col.type)) if col.null_count else col
    words = np.frombuffer(filled.buffers()[1], "<u4")
    words = words[4 * filled.offset:4 * (filled.offset + len(filled))].reshape(-1, 4)
    return [words[:, 0].astype(np.int64), words[:, 1].astype(np.int64), words[:, 2].astype(np.int64),
            np.ascontiguousarray(words[:, 3]).view("<i4").astype(np.int64)]


def _decimals(limbs: list, scale: int):
    """Limb sums, carries included, as DECIMAL(38, scale); raises where 38 digits don't do."""
    import numpy as np
    import pyarrow as pa

    low, carry = [], 0
    for part in limbs[:3]:
        total = part + carry
        low.append(total & 0xFFFFFFFF)
        carry = total >> 32
    top = limbs[3] + carry
    over = (top < -(1 << 31)) | (top >= 1 << 31)
    # 38 digits end between these upper halves; values on the edge are looked at one by one.
    upper = (top << 32) + low[2]
    edge = _LIMIT >> 64
    for k in np.flatnonzero((upper >= edge) | (upper <= -edge - 1)):
        value = (int(top[k]) << 96) + (int(low[2][k]) << 64) + (int(low[1][k]) << 32) + int(low[0][k])
        over[k] |= abs(value) > _LIMIT
    if over.any():
        raise OverflowError("a running sum needs more than 38 digits")
    words = np.stack([*low, top & 0xFFFFFFFF], axis=1).astype("<u4")
    return pa.Array.from_buffers(pa.decimal128(38, scale), len(words), [None, pa.py_buffer(words.tobytes())])


def _local_prefix_fn(key_names: list[str], sums: list[tuple[str, int]], count_out: str,
                     sum_outs: list[str], nn_outs: list[str]):
    """Partition function for mapInArrow: rows arrive sorted by (key, order). ``sums``: column and
    scale of each DECIMAL(38, scale) to add up."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        names = [count_out, *sum_outs, *nn_outs]
        kinds = [pa.int64(), *[pa.decimal128(38, s) for _, s in sums], *[pa.int64()] * len(sums)]
        prev_key = None
        carry_cnt = 0
        carry_sum = [[0, 0, 0, 0] for _ in sums]
        carry_nn = [0] * len(sums)
        for b in batches:
            n = b.num_rows
            if n == 0:
                yield pa.RecordBatch.from_arrays(
                    b.columns + [pa.array([], k) for k in kinds], names=b.schema.names + names)
                continue
            starts = np.zeros(n, dtype=bool)
            starts[0] = True
            for k in key_names:
                col = b.column(k)
                if n > 1:
                    cur, prv = col.slice(1), col.slice(0, n - 1)
                    one_null = pc.xor(pc.is_null(cur), pc.is_null(prv))
                    differs = pc.or_(one_null, pc.fill_null(pc.not_equal(cur, prv), False))
                    starts[1:] |= differs.to_numpy(zero_copy_only=False)
            first_key = tuple(b.column(k)[0].as_py() for k in key_names)
            continues = prev_key is not None and first_key == prev_key
            seg = np.cumsum(starts) - 1
            seg_start = np.flatnonzero(starts)
            head = seg == 0
            cnt = np.arange(n, dtype=np.int64) - seg_start[seg] + 1
            if continues:
                cnt[head] += carry_cnt

            def within(v):
                """Running sum of an int64 array within its segment."""
                c = np.cumsum(v)
                return c - (c[seg_start] - v[seg_start])[seg]

            out_sums, out_nns = [], []
            for j, (name, scale) in enumerate(sums):
                col = b.column(name)
                limbs = [within(v) for v in _limbs(col)]
                nn = within((~pc.is_null(col).to_numpy(zero_copy_only=False)).astype(np.int64))
                if continues:
                    for limb, carry in zip(limbs, carry_sum[j]):
                        limb[head] += carry
                    nn[head] += carry_nn[j]
                total = _decimals(limbs, scale)
                carry_sum[j] = [int(x[0]) for x in _limbs(total.slice(n - 1))]
                carry_nn[j] = int(nn[-1])
                out_sums.append(total)
                out_nns.append(pa.array(nn, pa.int64()))
            prev_key = tuple(b.column(k)[n - 1].as_py() for k in key_names)
            carry_cnt = int(cnt[-1])
            yield pa.RecordBatch.from_arrays(
                b.columns + [pa.array(cnt, pa.int64())] + out_sums + out_nns, names=b.schema.names + names)

    return run


def _scale_of(dt: T.DataType) -> int:
    if isinstance(dt, T.DecimalType):
        return dt.scale
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return 0
    raise TypeError(f"running sums need an exact numeric column, got {dt}")


def running_totals(df: DataFrame, order_by: list[str], keys: list[str] | None = None,
                   sums: dict[str, str] | None = None, count_as: str | None = "running_count",
                   num_partitions: int | None = None, stage_path: str | None = None) -> DataFrame:
    """Append the running count (``count_as``) and running sums (``sums``:
    output name → input column) per ``keys`` in the order ``order_by``.

    ``order_by`` must be a total order (end it with a unique column) so the
    result is deterministic and recomputation after a lost executor yields the
    same rows. The prefixed rows are staged under ``stage_path`` (overwritten)
    or, by default, under a new folder in the shared checkpoint folder.
    """
    ship(df.sparkSession)
    keys = list(keys or [])
    sums = dict(sums or {})
    n_parts = num_partitions or partitions_for(df)
    fields = {f.name: f.dataType for f in df.schema.fields}
    scales = {out: _scale_of(fields[src]) for out, src in sums.items()}

    # Widening to 38 digits loses nothing, whatever the session's ANSI setting.
    wide = {out: f"_lp_i_{i}" for i, out in enumerate(sums)}
    prepared = df.withColumns({wide[out]: F.col(src).cast(T.DecimalType(38, scales[out]))
                               for out, src in sums.items()}) if sums else df

    ranged = (prepared.repartitionByRange(n_parts, *keys, *order_by)
                      .sortWithinPartitions(*keys, *order_by)
                      .withColumn(_PART, F.spark_partition_id()))

    lc = "_lp_cnt"
    ls = {out: f"_lp_s_{i}" for i, out in enumerate(sums)}
    ln = {out: f"_lp_n_{i}" for i, out in enumerate(sums)}
    out_schema = T.StructType(
        ranged.schema.fields
        + [T.StructField(lc, T.LongType())]
        + [T.StructField(ls[o], T.DecimalType(38, scales[o])) for o in sums]
        + [T.StructField(ln[o], T.LongType()) for o in sums])
    local = ranged.mapInArrow(
        _local_prefix_fn(keys, [(wide[o], scales[o]) for o in sums], lc, [ls[o] for o in sums],
                         [ln[o] for o in sums]),
        out_schema)

    # Cut the lineage: the partition ids and local prefixes are stored, so the
    # offsets and the final rows come from the very same rows even if a stage
    # is recomputed (a re-run range shuffle may sample other bounds).
    path = stage_path or shared_path(df.sparkSession, "running-totals")
    local.write.mode("overwrite").parquet(path)
    local = df.sparkSession.read.parquet(path)

    # Per (partition, key) totals, then the exclusive prefix over partitions.
    totals = local.groupBy(_PART, *keys).agg(
        F.count(F.lit(1)).alias("_lp_tc"),
        *[F.sum(F.col(src)).alias(f"_lp_ts_{i}") for i, src in enumerate(sums.values())],
        *[F.count(F.col(src)).alias(f"_lp_tn_{i}") for i, src in enumerate(sums.values())])
    group = keys if keys else [F.lit(0)]
    before = Window.partitionBy(*group).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (totals
               .select(F.col(_PART).alias("_o_part"),
                       *[F.col(k).alias(f"_o_k{i}") for i, k in enumerate(keys)],
                       F.sum("_lp_tc").over(before).alias("_o_cnt"),
                       *[F.sum(f"_lp_ts_{i}").over(before).alias(f"_o_s_{i}")
                         for i in range(len(sums))],
                       *[F.sum(f"_lp_tn_{i}").over(before).alias(f"_o_n_{i}")
                         for i in range(len(sums))])
               .filter(F.col("_o_cnt").isNotNull()))

    cond = F.col(_PART) == F.col("_o_part")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_o_k{i}"))
    # At most one offsets row per range partition: bounded by n_parts.
    joined = local.join(F.broadcast(offsets), cond, "left")

    outs = []
    if count_as:
        outs.append((F.col(lc) + F.coalesce(F.col("_o_cnt"), F.lit(0))).alias(count_as))
    for i, out in enumerate(sums):
        result_type = T.DecimalType(38, scales[out])
        total_nn = F.col(ln[out]) + F.coalesce(F.col(f"_o_n_{i}"), F.lit(0))
        # Without ANSI an overflow is null here, never a wrong number: make it an error as well.
        value = F.try_add(F.col(ls[out]), F.coalesce(F.col(f"_o_s_{i}").cast(result_type),
                                                     F.lit(0).cast(result_type))).cast(result_type)
        checked = F.coalesce(value, F.raise_error(F.lit("a running sum needs more than 38 digits"))
                             .cast(result_type))
        outs.append(F.when(total_nn > 0, checked).alias(out))
    return joined.select(*[F.col(c) for c in df.columns], *outs)
