"""Score tests of variant-major dosages against several null models at once.

Dosages are cut into slices, the dosages of a run of variants among the people of one bucket, as bytes. A bucket's models are one row that comes
before its slices, so a task holds them while the slices go by; what it gives is a small matrix of sums for each slice, and the sums of a run's
slices are the tests of its variants. Each dosage is shuffled once, as a byte, and a bucket's models as often as there are lanes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinspark.functions.normal import neg_log10_p

from . import families as fam
from .blocks import REPAIRED, chosen_order
from .many import ManyModel, finish_many, sums_of_many
from .nullmodel import NullModel
from .scoretest import sums_of

#: Variants of a run, and people of a bucket, about.
RUN_VARIANTS, BUCKET_PEOPLE = 64, 2000
#: The places of the people are broadcast up to so many bytes; more people raise.
MOST_BYTES = 512 << 20
SLICES = "run long, bucket int, lane int, kind int, snps binary, payload binary"


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def placed_people(order: DataFrame, models: dict[str, NullModel | ManyModel], buckets: int | None = None) -> DataFrame:
    """iid, bucket, rank (place in the bucket), position, of the people of any model. A block lies in one bucket, the blocks of the model with the fewest
    blocks deciding; a block of another model that then lies in two raises, and so does a person without a position."""
    largest = max(models.values(), key=lambda m: m.n - m.members.select("block").distinct().count())
    every = None
    for model in models.values():
        ids = model.members.select("iid")
        every = ids if every is None else every.union(ids)
    every = every.distinct().join(largest.members.select("iid", "block"), "iid", "left")
    # whoever the deciding model lacks goes by the block that another model gives
    for model in models.values():
        other = model.members.select("iid", F.col("block").alias("_other"))
        every = every.join(other, "iid", "left").withColumn("block", F.coalesce("block", "_other")).drop("_other")
    n = every.count()
    buckets = buckets or max(1, -(-n // BUCKET_PEOPLE))
    dealt = every.select("iid", F.pmod(F.xxhash64("block"), F.lit(buckets)).cast("int").alias("bucket"))
    dealt = dealt.join(order.select("iid", "position"), "iid", "left").checkpoint()
    missing = dealt.filter("position IS NULL").count()
    if missing:
        raise ValueError(f"{missing} people of the models are not among the genotyped")
    if 16 * n > MOST_BYTES:
        raise ValueError(f"the places of {n} people are too large to be sent to all executors")
    for name, model in models.items():
        apart = model.members.select("iid", "block").join(dealt, "iid").groupBy("block").agg(F.countDistinct("bucket").alias("n")).filter("n > 1")
        if not apart.isEmpty():
            raise ValueError(f"a block of {name} lies in blocks of another model: fit the models with the same blocks")
    return dealt


def _models_rows(models: dict[str, NullModel | ManyModel], people: DataFrame) -> DataFrame:
    """A row per bucket, with each model's people: their places in the bucket, blocks, weights and forms."""
    parts = None
    for k, model in enumerate(models.values()):
        rows = model.members.drop("bucket").join(people.select("iid", "bucket", "position"), "iid").withColumn("model", F.lit(k))
        parts = rows if parts is None else parts.unionByName(rows)

    def pack(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "payload": pa.array([_pack(rows.drop_columns(["bucket"]))], pa.binary())})

    packed = parts.groupBy("bucket").applyInArrow(pack, "bucket int, payload binary")
    return packed


def repaired(g: np.ndarray, starts: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Variants (rows) that are constant among the places `seen`, which are in a fixed order of people, get blocks.REPAIRED there, from the place on that
    the variant's start decides, as blocks.repair_constant does with long dosages."""
    own = g[:, seen]
    constant = np.flatnonzero(own.min(axis=1) == own.max(axis=1))
    if len(constant):
        g = g.copy()
        for row in constant.tolist():
            g[row, seen[np.mod(starts[row] + np.arange(len(REPAIRED)), len(seen))]] = REPAIRED
    return g


def slices(variants: DataFrame, people: DataFrame, seen: DataFrame | None, lanes: int) -> DataFrame:
    """SLICES of kind 1: a run's snps (packed), and its dosages among a bucket's people, which are in the order of their positions."""
    spark = variants.sparkSession
    table = people.select("bucket", "position").toArrow().sort_by([("bucket", "ascending"), ("position", "ascending")])
    bucket, position = table.column("bucket").to_numpy(), table.column("position").to_numpy()
    firsts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    order = None
    if seen is not None:
        ordered = seen.select("position", chosen_order(F.col("iid"), 13).alias("o"), "iid").toArrow().sort_by([("o", "ascending"), ("iid", "ascending")])
        order = ordered.column("position").to_numpy()
        if len(order) < len(REPAIRED):
            raise ValueError(f"a repair needs {len(REPAIRED)} observed people")
    shared = spark.sparkContext.broadcast((position, bucket[firsts], np.split(np.arange(len(position)), firsts[1:]), order))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, names, own, order = shared.value
        done = 0
        for batch in batches:
            for at in range(0, batch.num_rows, RUN_VARIANTS):
                part = batch.slice(at, RUN_VARIANTS)
                flat = pc.fill_null(part.column("dosage").flatten().cast(pa.int8()), 0).to_numpy()
                g = flat.reshape(part.num_rows, -1)
                if order is not None:
                    g = repaired(g, part.column("start").to_numpy(), order)
                g = g[:, place]
                run = (part.column("part")[0].as_py() << 32) + done
                done += 1
                snps = _pack(pa.table({"snp": part.column("snp")}))
                rows = [(run, int(b), run % lanes, 1, snps, np.ascontiguousarray(g[:, members]).tobytes()) for b, members in zip(names, own)]
                names_ = [c.split()[0] for c in SLICES.split(", ")]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names_)

    return variants.select("snp", "dosage", F.xxhash64("snp").alias("start"), F.spark_partition_id().alias("part")).mapInArrow(cut, SLICES)


def _held(payload: bytes, n: int) -> list[tuple[np.ndarray, pa.Table]]:
    """Of each of n models: places of its people among the bucket's, and its people by block and id."""
    rows = _unpack(payload)
    every = np.unique(rows.column("position").to_numpy())
    out = []
    for k in range(n):
        own = rows.filter(pc.equal(rows.column("model"), k)).sort_by([("block", "ascending"), ("iid", "ascending")]).combine_chunks()
        out.append((np.searchsorted(every, own.column("position").to_numpy()), own))
    return out


def score_slices(
    variants: DataFrame, order: DataFrame, models: dict[str, NullModel | ManyModel], observed: DataFrame | None = None, lanes: int | None = None, buckets: int | None = None,
) -> DataFrame:
    """snp, and for each model its t_score, neg_log10_p, beta and var_beta, named model_column (of many responses, model_response_column), of dosages that come as one array per variant.

    variants: snp, dosage (copies up to 127, null as 0), in an order that is the same when read again; order: iid and position, the place in the
    arrays, from 0. observed (iid): variants that are constant among these people get varied dosages first, as by blocks.repair_constant. A variant that the
    covariates explain, or without carriers, has nulls.
    """
    people = placed_people(order, models, buckets)
    held_in = people.select("bucket").distinct().count()
    lanes = lanes or max(1, -(-2 * variants.sparkSession.sparkContext.defaultParallelism // held_in))
    seen = None if observed is None else observed.select("iid").join(order.select("iid", "position"), "iid")
    sizes = [m.width for m in models.values()]
    # what tasks need of the models, without their rows
    small = [(m.kind, m.n_forms, m.arrays, m.p, m.variances if m.kind == "many" else None) for m in models.values()]
    tests = [f"{name}_{r}" if m.kind == "many" else name for name, m in models.items() for r in (m.names if m.kind == "many" else [""])]
    one = _models_rows(models, people).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    one = one.select(F.lit(-1).cast("long").alias("run"), "bucket", "lane", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("snps"), "payload")
    both = one.unionByName(slices(variants, people, seen, lanes))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, pa.Table]] = []
        for batch in batches:
            runs, snps, sums = [], [], []
            for row in range(batch.num_rows):
                payload = batch.column(5)[row].as_buffer()
                if batch.column(3)[row].as_py() == 0:
                    held = _held(payload, len(small))
                    continue
                names = batch.column(4)[row].as_py()
                g = np.frombuffer(payload, np.int8).reshape(_unpack(names).num_rows, -1).astype(float)
                total = []
                for (places, own), size, (kind, n_forms, _, p, variances) in zip(held, sizes, small):
                    if not len(places):
                        total.append(np.zeros((len(g), size)))
                    else:
                        total.append(sums_of_many(g[:, places], own, variances, p) if kind == "many" else sums_of(g[:, places], own, n_forms))
                runs.append(batch.column(0)[row].as_py())
                snps.append(names)
                sums.append(np.concatenate(total, axis=1).ravel())
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.int64()), pa.array(snps, pa.binary()), pa.array(sums, pa.list_(pa.float64()))], ["run", "snps", "sums"])

    dealt = both.repartition("bucket", "lane").sortWithinPartitions("bucket", "lane", "kind", "run")
    parts = dealt.mapInArrow(multiply, "run long, snps binary, sums array<double>")
    names = [f"{m}_{c}" for m in tests for c in ("num", "info", "var")]
    schema = T.StructType([variants.schema["snp"], *[T.StructField(c, T.DoubleType()) for c in names]])

    def finish(rows: pa.Table) -> pa.Table:
        snp = _unpack(rows.column("snps")[0].as_py()).column("snp")
        total = sum(v.values.to_numpy() for v in rows.column("sums")).reshape(len(snp), -1)
        done = []
        for part, (kind, _, arrays, p, _) in zip(np.split(total, np.cumsum(sizes)[:-1], axis=1), small):
            done += finish_many(part, arrays, p) if kind == "many" else [fam.finish(part, arrays, p)]
        return pa.table([snp, *[pa.array(c, mask=np.isnan(c)) for d in done for c in d.T]], names=["snp", *names])

    found = parts.groupBy("run").applyInArrow(finish, schema)
    columns = [F.col("snp")]
    for m in tests:
        num, info, var = (F.col(f"{m}_{c}") for c in ("num", "info", "var"))
        columns += [(num * num / var).alias(f"{m}_t_score"), (num / info).alias(f"{m}_beta"), (var / (info * info)).alias(f"{m}_var_beta")]
    found = found.select(*columns)
    found = found.withColumns({f"{m}_neg_log10_p": F.expr(neg_log10_p(f"{m}_t_score")) for m in tests})
    return found.select("snp", *[f"{m}_{c}" for m in tests for c in ("t_score", "neg_log10_p", "beta", "var_beta")])
