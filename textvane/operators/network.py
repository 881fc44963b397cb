"""Feed-forward nets of sigmoid layers: dense inputs, training, scoring, model tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.vectors import dot, sigmoid
from ..session import discard, stage
from .skew import grid

# Up to this many keys a sparse record becomes one dense row by a literal key list.
LITERAL_KEYS = 10_000
# A net up to this size travels inside the plan; the nodes of a larger one meet the rows in a join.
LITERAL_WEIGHTS = 2_000_000
# The training defaults of the reference design, and the range of the first weights.
RATE, MOMENTUM, ERROR, FIRST_WEIGHT = 0.3, 0.1, 0.005, 0.2
MODEL_SCHEMA = "layer int, node int, bias double, weights array<double>"


def input_index(records: DataFrame, key: str) -> DataFrame:
    """(key, idx) of all keys, in key order."""
    from .numbering import number_rows

    return number_rows(records.select(key).filter(F.col(key).isNotNull()).distinct(), [F.col(key)], name="idx", start=0)


def dense_from_sparse(records: DataFrame, row: str, key: str, value: str) -> DataFrame:
    """(row, idx, key, value): a value for every key of every row, 0 where a row lacks the key.

    Records with a null key count as none; of several records of one row and key the largest value holds.
    """
    records = records.groupBy(row, key).agg(F.max(value).alias(value))
    keys = records.select(key).filter(F.col(key).isNotNull()).distinct().orderBy(key).limit(LITERAL_KEYS + 1).collect()
    if len(keys) <= LITERAL_KEYS:
        # A group is one record, as wide as the key list.
        rows = records.groupBy(row).agg(F.map_from_entries(F.collect_list(F.when(F.col(key).isNotNull(), F.struct(key, value)))).alias("m"))
        lookup = F.array(*[F.lit(k[0]) for k in keys])
        return rows.select(row, "m", F.posexplode(lookup).alias("idx", key)).select(
            row, "idx", key, F.coalesce(F.try_element_at("m", F.col(key)), F.lit(0.0)).alias(value)
        )
    cells = grid(input_index(records, key), records.select(row).distinct())
    return cells.join(records.select(row, key, value), [row, key], "left").select(
        row, F.col("idx").cast("int").alias("idx"), key, F.coalesce(value, F.lit(0.0)).alias(value)
    )


def sparse_from_dense(vector: Column, keys: Sequence[str]) -> Column:
    """A map of key to value from a dense array."""
    return F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), vector)


def forward(rows: DataFrame, model: DataFrame, input_column: str = "input", name: str = "output") -> DataFrame:
    """Run each row's input array through the net (null for a null input)."""
    size = model.agg(F.sum(F.size("weights") + 1)).first()[0] or 0
    if size > LITERAL_WEIGHTS:
        return _forward_joined(rows, model, input_column, name)
    layers: dict[int, list] = {}
    for r in model.orderBy("layer", "node").collect():
        layers.setdefault(r["layer"], []).append(r)
    out = rows.withColumn(name, F.col(input_column))
    for i in sorted(layers):
        nodes = F.array(
            *[F.struct(F.lit(float(n["bias"])).alias("bias"), F.lit(np.array(n["weights"], float)).alias("weights")) for n in layers[i]]
        )
        # One step per layer, so that a layer's output is computed once for all nodes of the next.
        out = out.withColumn(name, _outputs(nodes, F.col(name)))
    return out


def _outputs(nodes: Column, values: Column) -> Column:
    sums = F.transform(nodes, lambda n: sigmoid(n["bias"] + dot(n["weights"], values)))
    return F.when(values.isNotNull(), sums)


def _forward_joined(rows: DataFrame, model: DataFrame, input_column: str, name: str, nodes_per_block: int = 256) -> DataFrame:
    """The same for a net too large for a plan: blocks of a layer's nodes meet slices of the rows.

    A row is repeated once for each block of a layer, and its outputs are put together again, in
    node order, under a number that is written once.
    """
    kept = [c for c in rows.columns if c != name]
    packed_rows = rows.select(F.struct(*kept).alias("_kept"), F.col(input_column).alias("_in"))
    numbered = stage(packed_rows.withColumn("_row", F.monotonically_increasing_id()), "net_rows")
    values = numbered.select("_row", "_in")
    slices = numbered.sparkSession.sparkContext.defaultParallelism
    for (layer,) in model.select("layer").distinct().orderBy("layer").collect():  # one per layer of the net
        block = F.floor(F.col("node") / nodes_per_block).cast("int").alias("_block")
        packed = model.filter(F.col("layer") == layer).groupBy(block).agg(
            F.array_sort(F.collect_list(F.struct("node", "bias", "weights"))).alias("_nodes")
        )
        blocks = [r[0] for r in packed.select("_block").orderBy("_block").collect()]
        packed = packed.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        spread = values.withColumn("_slice", F.pmod(F.xxhash64("_row"), F.lit(slices)).cast("int"))
        spread = spread.withColumn("_block", F.explode(F.array(*[F.lit(b) for b in blocks])))
        parts = spread.join(packed, ["_slice", "_block"]).select("_row", "_block", _outputs(F.col("_nodes"), F.col("_in")).alias("_out"))
        whole = F.flatten(F.array_sort(F.collect_list(F.struct("_block", "_out")))["_out"])
        values = stage(parts.groupBy("_row").agg(whole.alias("_in")), "net_layer")
    return numbered.select("_row", "_kept").join(values, "_row").select("_kept.*", F.col("_in").alias(name))


@dataclass
class Net:
    """A trained net: its table, the error of its last pass and the passes it took."""

    model: DataFrame
    error: float
    passes: int


def _first_weights(sizes: Sequence[int], seed: int) -> list[np.ndarray]:
    """One matrix a layer, a row for each node, with its bias in the last column."""
    drawn = np.random.default_rng(seed)
    return [drawn.uniform(-FIRST_WEIGHT, FIRST_WEIGHT, (n, before + 1)) for before, n in zip(sizes, sizes[1:])]


def _unflatten(flat: np.ndarray, sizes: Sequence[int]) -> list[np.ndarray]:
    ends = np.cumsum([n * (before + 1) for before, n in zip(sizes, sizes[1:])])
    parts = np.split(flat, ends[:-1])
    return [p.reshape(n, before + 1).copy() for p, before, n in zip(parts, sizes, sizes[1:])]


def _learn(weights: list[np.ndarray], steps: list[np.ndarray], given: np.ndarray, wanted: np.ndarray, rate: float, momentum: float) -> float:
    """Move the weights by one row; the mean squared error before the move.

    A bias takes no momentum.
    """
    seen = [np.append(given, 1.0)]
    for w in weights:
        seen.append(np.append(1.0 / (1.0 + np.exp(-np.clip(w @ seen[-1], -700, 700))), 1.0))
    miss = wanted - seen[-1][:-1]
    error = float(miss @ miss) / len(miss)
    for i in range(len(weights) - 1, -1, -1):
        out = seen[i + 1][:-1]
        delta = miss * out * (1.0 - out)
        miss = delta @ weights[i][:, :-1]  # by the weights the outputs came from
        steps[i] *= momentum
        steps[i] += rate * np.outer(delta, seen[i])
        weights[i] += steps[i]
        steps[i][:, -1] = 0.0
    return error


def _pass(rows: DataFrame, sizes: Sequence[int], state: np.ndarray, rate: float, momentum: float) -> tuple[np.ndarray, float]:
    """One pass over all rows, each partition from the same state: the mean state by rows, and the mean error."""
    half = len(state) // 2
    start = rows.sparkSession.sparkContext.broadcast(state)  # twice the net, whatever the rows are

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, steps = _unflatten(start.value[:half], sizes), _unflatten(start.value[half:], sizes)
        n, error = 0, 0.0
        for batch in batches:
            for given, wanted in zip(batch["input"], batch["output"]):
                error += _learn(weights, steps, given, wanted, rate, momentum)
                n += 1
        if n:
            flat = np.concatenate([m.ravel() for m in (*weights, *steps)])
            yield pd.DataFrame({"n": [n], "error": [error], "state": [flat]})

    learned = rows.mapInPandas(learn, "n long, error double, state array<double>")
    # Position -1 carries the error, so that rows are learned from once a pass.
    values = F.concat(F.array(F.col("error") / F.col("n")), F.col("state"))
    mean = learned.select("n", F.posexplode(values).alias("pos", "x")).groupBy("pos").agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("x"))
    found = mean.toPandas().sort_values("pos")["x"].to_numpy()  # as long as the state
    start.unpersist()
    return found[1:], float(found[0])


def train(
    rows: DataFrame,
    hidden: Sequence[int] | None = None,
    passes: int = 200,
    error: float = ERROR,
    rate: float = RATE,
    momentum: float = MOMENTUM,
    seed: int = 42,
) -> Net:
    """Fit a net of sigmoid layers to (input array<double>, output array<double>), outputs from 0 to 1.

    Learning goes row by row by back-propagation with a rate and momentum. A pass starts every
    partition from the same weights and ends with their mean by rows, steps of the momentum included;
    with one partition this is plain row-by-row learning. Passes end when the mean squared error of
    one is at most `error`, or after `passes`. The hidden layers are `hidden` nodes each, by default
    one of half the inputs, three at least.

    A partition takes its rows in their order: `repartition` rows that come sorted by class. It keeps
    the net and a batch of rows in memory. Rows with a null array or a null or non-finite value take no part;
    arrays of differing lengths, or no rows at all, are errors.
    """
    bad = [F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) for c in ("input", "output")]
    doubles = [F.col(c).cast("array<double>").alias(c) for c in ("input", "output")]
    usable = stage(rows.select(*doubles).filter(F.col("input").isNotNull() & F.col("output").isNotNull() & ~bad[0] & ~bad[1]), "net_training")
    shape = usable.agg(*[f(F.size(c)) for c in ("input", "output") for f in (F.min, F.max)]).first()
    if shape[0] is None or shape[0] != shape[1] or shape[2] != shape[3] or not shape[0] or not shape[2]:
        discard(usable)
        raise ValueError(f"training needs rows of one input and one output length, found {tuple(shape)}")
    sizes = [shape[0], *(hidden or [max(3, shape[0] // 2)]), shape[2]]
    flat = np.concatenate([w.ravel() for w in _first_weights(sizes, seed)])
    state, found, done = np.concatenate([flat, np.zeros_like(flat)]), np.inf, 0
    while done < passes and found > error:
        state, found = _pass(usable, sizes, state, rate, momentum)
        done += 1
    discard(usable)
    weights = _unflatten(state[: len(flat)], sizes)
    return Net(model_table(rows.sparkSession, weights), found, done)


def model_table(spark: SparkSession, weights: Sequence[np.ndarray]) -> DataFrame:
    """(layer, node, bias, weights) of a matrix a layer, biases last."""
    rows = [(i, j, float(node[-1]), node[:-1].tolist()) for i, w in enumerate(weights) for j, node in enumerate(w)]
    return spark.createDataFrame(rows, MODEL_SCHEMA)
