"""Vector metrics over groups: best similarity, diversity, dispersion."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import dot, reaches
from .skew import copy_per_piece, hot_groups, with_pieces

BLOCK_ROWS = 2_048


def _matrices(column: pa.ChunkedArray | pa.Array) -> Iterator[np.ndarray]:
    """One (n, d) float64 matrix per row of a list-of-vectors column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for cell in column:
        rows = cell.values
        flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield flat.reshape(len(rows), -1) if len(rows) else flat.reshape(0, 0)


def _best_per_target(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blocks = zip(batch["keys"].to_pylist(), _matrices(batch["target_vecs"]), _matrices(batch["gen_vecs"]))
        seeds, items, best = [], [], []
        for seed, (keys, targets, gens) in zip(batch["seed_id"].to_pylist(), blocks):
            seeds += [seed] * len(keys)
            items += keys
            best.append((targets @ gens.T).max(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(seeds, batch["seed_id"].type), pa.array(items, batch["keys"].type.value_type),
             pa.array(np.concatenate(best) if best else np.zeros(0))],
            names=["seed_id", "item_id", "best_cos"],
        )


def best_similarity(generations: DataFrame, targets: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per target the highest cosine to any generation of its seed.

    Inputs have (seed_id, item_id, vec). Both sides are packed into blocks of about
    ``block_rows`` vectors; a joined row carries one block of each side and becomes one
    matrix product, so pairs are never emitted. Blocks of a hot seed meet under separate
    join keys: the generations are copied once per target piece. Targets of a seed
    without generations get NULL.
    """
    hot_targets = hot_groups(targets, ["seed_id"], block_rows)
    hot_gens = hot_groups(generations, ["seed_id"], block_rows)
    target_blocks = (
        with_pieces(targets, ["seed_id"], F.col("item_id"), block_rows, hot_targets)
        .groupBy("seed_id", "piece")
        .agg(F.collect_list(F.struct("item_id", "vec")).alias("t"))
        .select("seed_id", "piece", F.col("t.item_id").alias("keys"), F.col("t.vec").alias("target_vecs"))
    )
    gen_blocks = (
        with_pieces(generations, ["seed_id"], F.col("item_id"), block_rows, hot_gens)
        .groupBy("seed_id", "piece").agg(F.collect_list("vec").alias("gen_vecs")).drop("piece")
    )
    met = target_blocks.join(copy_per_piece(gen_blocks, ["seed_id"], hot_targets), ["seed_id", "piece"])
    kinds = dict(targets.dtypes)
    schema = f"seed_id {kinds['seed_id']}, item_id {kinds['item_id']}, best_cos double"
    found = met.select("seed_id", "keys", "target_vecs", "gen_vecs").mapInArrow(_best_per_target, schema)
    if hot_gens is not None:
        found = found.groupBy("seed_id", "item_id").agg(F.max("best_cos").alias("best_cos"))
    return targets.drop("vec").join(found, ["seed_id", "item_id"], "left")


def cosine_coverage(scored: DataFrame, group: Sequence[str] = ("seed_id",)) -> DataFrame:
    """M07."""
    return scored.groupBy(*group).agg(F.avg("best_cos").alias("coverage"), F.count("best_cos").alias("n_targets"))


def coverage_at(scored: DataFrame, tau: float, group: Sequence[str] = ("seed_id",)) -> DataFrame:
    """Share of targets whose best similarity reaches ``tau``; a target without any similarity is a miss."""
    return scored.groupBy(*group).agg(F.avg(reaches(F.col("best_cos"), tau).cast("double")).alias("coverage_at_tau"))


def _keyed(items: DataFrame, group: Sequence[str]) -> DataFrame:
    """Group columns, their text as ``_key`` (nulls included) and the vector."""
    return items.select(*group, F.to_json(F.struct(*group)).alias("_key"), "vec")


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[str, int, np.ndarray]]:
    """(key, place of one of its rows, its vectors as a matrix) for each key of a batch."""
    codes = batch["_key"].dictionary_encode()
    code, keys = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.to_pylist()
    vectors = batch["vec"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
    order = np.argsort(code, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
        yield keys[code[rows[0]]], int(rows[0]), vectors[rows]


def _key_schema(df: DataFrame, group: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in group)


def _sums(items: DataFrame, group: Sequence[str]) -> DataFrame:
    """Per group: n, sum of squared norms and the squared length of the sum vector.

    Vectors are added inside Arrow batches; a batch sends one sum vector per group, whose
    elements are then summed with map-side combining. No group is gathered, whatever its size.
    """
    group = list(group)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = list(_parts(batch))
            at = pa.array([i for _, i, _ in found])
            yield pa.RecordBatch.from_arrays([
                *[batch[k].take(at) for k in group], pa.array([len(v) for *_, v in found], pa.int64()),
                pa.array([float((v * v).sum()) for *_, v in found]), pa.array([v.sum(0) for *_, v in found], pa.list_(pa.float64())),
            ], names=[*group, "n", "norms", "sums"])

    partial = _keyed(items, group).mapInArrow(add, f"{_key_schema(items, group)}, n long, norms double, sums array<double>")
    elements = partial.select(*group, "n", "norms", F.posexplode("sums").alias("pos", "s")).groupBy(*group, "pos").agg(
        F.sum("s").alias("s"), F.sum("norms").alias("norms"), F.sum("n").alias("n"))
    # A group has as many rows here as a vector has elements.
    return elements.groupBy(*group).agg(
        F.max("n").alias("n"), F.max("norms").alias("norms"), F.sum(F.col("s") * F.col("s")).alias("sum_sq"),
    )


def mean_pairwise_similarity(items: DataFrame, group: Sequence[str] = ("seed_id",)) -> DataFrame:
    """Mean off-diagonal similarity from the sum vector; NaN below two items."""
    n = F.col("n")
    value = (F.col("sum_sq") - F.col("norms")) / (n * (n - 1))
    return _sums(items, group).select(*group, "n", F.when(n >= 2, value).otherwise(F.lit(float("nan"))).alias("mps"))


def centroid_dispersion(items: DataFrame, group: Sequence[str] = ("seed_id",)) -> DataFrame:
    """Mean cosine distance to the normalised centroid; NaN below two items.

    The mean of v.c over the group equals centroid.c, so only the sum vector is needed.
    """
    n = F.col("n")
    length = F.sqrt(F.col("sum_sq")) / n
    value = F.lit(1.0) - length * length / (length + F.lit(1e-12))
    return _sums(items, group).select(*group, "n", F.when(n >= 2, value).otherwise(F.lit(float("nan"))).alias("disp"))


def seed_similarity(items: DataFrame, seeds: DataFrame, group: Sequence[str] = ("seed_id",)) -> DataFrame:
    """(group, item_id, sim) of each item to its group's seed vector (``seed_vec``)."""
    return items.join(seeds, list(group)).select(*group, "item_id", dot(F.col("vec"), F.col("seed_vec")).alias("sim"))


def _entropy_count(factor: np.ndarray, n: int) -> float:
    """Effective number from a factor F with F' F = V' V, whose nonzero spectrum is that of V V'."""
    spectrum = np.linalg.svd(factor, compute_uv=False) ** 2 / n
    spectrum = spectrum[spectrum > 1e-12]
    return float(np.exp(-np.sum(spectrum * np.log(spectrum))))


class _Factors:
    """Running factor per key: the vectors themselves, or the triangle of their QR decomposition once they are many."""

    def __init__(self, group: Sequence[str], most_rows: int):
        self.group, self.most_rows = group, most_rows
        self.held: dict[str, list] = {}

    def add(self, key: str, names: pa.RecordBatch, n: int, rows: np.ndarray) -> None:
        entry = self.held.setdefault(key, [names, 0, []])
        entry[1] += n
        entry[2].append(rows)
        if sum(map(len, entry[2])) > max(self.most_rows, 2 * rows.shape[1]):
            entry[2] = [self.squeezed(entry[2])]

    @staticmethod
    def squeezed(parts: list[np.ndarray]) -> np.ndarray:
        rows = np.concatenate(parts)
        return np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows

    def emptied(self, task: int) -> pa.RecordBatch:
        factors = [self.squeezed(parts) for _, _, parts in self.held.values()]
        columns = [pa.concat_arrays([names.column(i) for names, *_ in self.held.values()]) for i in range(len(self.group) + 1)]
        out = pa.RecordBatch.from_arrays([
            *columns, pa.array([task] * len(factors), pa.int64()), pa.array([n for _, n, _ in self.held.values()], pa.int64()),
            pa.array([f.shape[1] for f in factors], pa.int32()), pa.array([f.tobytes() for f in factors], pa.binary()),
        ], names=[*self.group, "_key", "_task", "n", "_width", "_factor"])
        self.held = {}
        return out


# Groups whose factors a task holds at a time, and factors of a group that meet in one step of the tree.
HELD_GROUPS = 256
FAN_IN = 64


def vendi(items: DataFrame, group: Sequence[str] = ("seed_id",), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Effective number of distinct items, with the item count ``n``.

    A task folds the vectors of a group into a factor of at most d rows (the triangle of a QR
    decomposition, ``block_rows`` vectors at a time) that has their second moments. Factors
    of a group are joined in a tree, ``FAN_IN`` tasks at a time, so no step meets more than
    that however many vectors the group has. The spectrum of the last factor gives the
    same score as the n x n kernel would.
    """
    group = list(group)
    names = [*group, "_key"]
    shape = f"{_key_schema(items, group)}, _key string, _task long, n long, _width int, _factor binary"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, factors = TaskContext.get().partitionId(), _Factors(group, block_rows)
        for batch in batches:
            for key, at, rows in _parts(batch) if batch.num_rows else ():
                if key not in factors.held and len(factors.held) >= HELD_GROUPS:
                    yield factors.emptied(task)
                factors.add(key, batch.select(names).slice(at, 1), len(rows), rows)
        if factors.held:
            yield factors.emptied(task)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, at = _Factors(group, block_rows), (None, 0)
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("_key", "_task", "n", "_width", "_factor"))
            for i, (key, task, n, width, raw) in enumerate(zip(*columns)):
                if at != (key, task) and factors.held:
                    yield factors.emptied(at[1])
                at = (key, task)
                factors.add(key, batch.select(names).slice(i, 1), n, np.frombuffer(raw, np.float64).reshape(-1, width))
        if factors.held:
            yield factors.emptied(at[1])

    def spectrum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [_entropy_count(np.frombuffer(raw, np.float64).reshape(-1, width), n) for n, width, raw in zip(
                *(batch[c].to_pylist() for c in ("n", "_width", "_factor")))]
            yield pa.RecordBatch.from_arrays(
                [*[batch[k] for k in group], batch["n"], pa.array(values, pa.float64())], names=[*group, "n", "vendi"])

    factors = _keyed(items, group).mapInArrow(fold, shape)
    for size in (FAN_IN, FAN_IN, None):
        up = F.floor(F.col("_task") / size) if size else F.lit(0)
        factors = factors.withColumn("_task", up.cast("long")).repartition("_key", "_task").sortWithinPartitions("_key", "_task").mapInArrow(meet, shape)
    return factors.mapInArrow(spectrum, f"{_key_schema(items, group)}, n long, vendi double")
