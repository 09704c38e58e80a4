"""Graph attention over tables of nodes and edges: the encoder of the learned tier and the classifier of entities.

A layer has, for each head, a weight matrix and two score vectors.  A node hears itself and its neighbours; each of them by the softmax
of LeakyReLU(source score + target score) over what the target hears.  Products run inside array functions at the
nodes.  Edges carry the scores and either the input of a layer or its product, whichever is shorter, as the weighted sum and the
product may change places.  The softmax takes two grouped passes over each target's incoming edges, the maximum and then the sums of
exponentials; both are partial sums first, so a hub's edges are added up where they lie, and a hub as a source is a skewed join
that Spark splits.  Over whole sheets touching nodes meet in grid cells and are added up there in one pass (``touching``).

Tables are keyed by (comparison_id, revision, entity_id), so all graphs of all comparisons go through in one job.  A node without
edges hears itself; without nodes the result is empty.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import ship, written
from . import touching
from .features import NAMES
from .graph import KEY, SheetGraph, both_directions, sheet_graph
from .match import cosine, unit

#: Classes in order, heads and widths of the layers, slope of LeakyReLU.
CLASSES = ["dimension", "door", "furniture", "linework", "note", "room-label", "title", "wall"]
HEADS, HIDDEN, VECTOR, SLOPE = 4, 32, 32, 0.2
INPUTS, PLACED = len(NAMES), len(NAMES) + 2

Model = dict[str, np.ndarray]


def _layer(name: str, heads: int, out: int, inputs: int) -> dict[str, tuple[int, ...]]:
    return {f"{name}.weight": (heads, out, inputs), f"{name}.source": (heads, out), f"{name}.target": (heads, out), f"{name}.bias": (heads * out,)}


#: Shapes of the parts of the two models.
ENCODER = _layer("conv1", HEADS, HIDDEN, INPUTS) | _layer("conv2", 1, VECTOR, HEADS * HIDDEN)
CLASSIFIER = (
    {"self.weight": (HEADS * HIDDEN, PLACED), "self.bias": (HEADS * HIDDEN,)}
    | _layer("conv1", HEADS, HIDDEN, PLACED)
    | _layer("conv2", 1, HIDDEN, HEADS * HIDDEN)
    | {"head.weight": (len(CLASSES), HEADS * HIDDEN + HIDDEN), "head.bias": (len(CLASSES),)}
)


def probe(shapes: dict[str, tuple[int, ...]]) -> Model:
    """Weights by a rule that SQL can state, for checks: row i, column j of part p is ((31 i + 17 j + 7 p) mod 19 - 9) / 40."""
    out = {}
    for p, (name, shape) in enumerate(shapes.items()):
        rows, columns = int(np.prod(shape[:-1])), shape[-1]
        i, j = np.indices((rows, columns))
        out[name] = (((31 * i + 17 * j + 7 * p) % 19 - 9) / 40).reshape(shape)
    return out


def start(shapes: dict[str, tuple[int, ...]], seed: int) -> Model:
    """Weights to start training from: uniform in a range by the widths on both sides, biases zero."""
    rng = np.random.default_rng(seed)
    out = {}
    for name, shape in shapes.items():
        bound = np.sqrt(6 / (shape[-1] + (shape[-2] if len(shape) > 1 else 1)))
        out[name] = np.zeros(shape) if name.endswith("bias") else rng.uniform(-bound, bound, shape)
    return out


def _matrix(m: np.ndarray) -> Column:
    """A small matrix as one constant of the plan."""
    return F.from_json(F.lit(json.dumps(m.tolist())), "array<array<double>>" if m.ndim == 2 else "array<double>")


def product(m: np.ndarray, x: Column, bias: np.ndarray | None = None) -> Column:
    out = F.transform(_matrix(m), lambda row: cosine(row, x))
    return out if bias is None else F.zip_with(out, _matrix(bias), lambda a, b: a + b)


def elu(x: Column) -> Column:
    return F.transform(x, lambda v: F.when(v > 0, v).otherwise(F.exp(v) - 1))


def _leaky(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(SLOPE * x)


def attend(nodes: DataFrame, heard: DataFrame | SheetGraph, model: Model, name: str) -> DataFrame:
    """(KEY, entity_id, x) after one layer.  ``heard``: (KEY, source, target), every direction once and every node from itself; or a
    graph whose nodes stand for several entities."""
    if isinstance(heard, SheetGraph):
        return _attend_sheets(nodes, heard, model, name)
    weight, bias = model[f"{name}.weight"], model[f"{name}.bias"]
    heads, out, inputs = weight.shape
    scores = {side: np.einsum("hoi,ho->hi", weight, model[f"{name}.{side}"]) for side in ("source", "target")}
    first = out < inputs  # the product is what edges carry
    carried = product(weight.reshape(heads * out, inputs), F.col("x")) if first else F.col("x")
    n = nodes.select(*KEY, "entity_id", carried.alias("carried"), product(scores["source"], F.col("x")).alias("s"), product(scores["target"], F.col("x")).alias("t"))
    n = written(n, "nodes")
    at = lambda c, k: F.get(F.col(c), F.lit(k))
    source, target = F.col("entity_id").alias("source"), F.col("entity_id").alias("target")
    # LeakyReLU rises, so the largest score of a target belongs to its largest source score.
    most = heard.join(n.select(*KEY, source, "s"), [*KEY, "source"]).groupBy(*KEY, "target").agg(*[F.max(at("s", h)).alias(f"m{h}") for h in range(heads)])
    most = written(most.select(*KEY, "target", F.array(*[F.col(f"m{h}") for h in range(heads)]).alias("m")), "most")
    edges = heard.join(n.select(*KEY, source, "s", "carried"), [*KEY, "source"]).join(n.select(*KEY, target, "t").join(most, [*KEY, "target"]), [*KEY, "target"])
    for h in range(heads):
        edges = edges.withColumn(f"w{h}", F.exp(_leaky(at("s", h) + at("t", h)) - _leaky(at("m", h) + at("t", h))))
    width = out if first else inputs
    of = lambda h, d: at("carried", h * out + d if first else d)
    total = edges.groupBy(*KEY, F.col("target").alias("entity_id")).agg(
        *[F.sum(f"w{h}").alias(f"n{h}") for h in range(heads)], *[F.sum(F.col(f"w{h}") * of(h, d)).alias(f"v{h}_{d}") for h in range(heads) for d in range(width)]
    )
    mean = [F.array(*[F.col(f"v{h}_{d}") / F.col(f"n{h}") for d in range(width)]) for h in range(heads)]
    parts = mean if first else [product(weight[h], mean[h]) for h in range(heads)]
    x = F.zip_with(F.concat(*parts), _matrix(bias), lambda a, b: a + b)
    return total.select(*KEY, "entity_id", x.alias("x"))


def _attend_sheets(nodes: DataFrame, g: SheetGraph, model: Model, name: str) -> DataFrame:
    """``attend`` over a graph of sheets: touching nodes are added up in their cells by matrix products, the few other edges beside them."""
    weight, bias = model[f"{name}.weight"], model[f"{name}.bias"]
    heads, out, inputs = weight.shape
    source, target = (np.einsum("hoi,ho->hi", weight, model[f"{name}.{side}"]) for side in ("source", "target"))
    first = out < inputs  # the product is what is passed on
    ship(nodes.sparkSession)
    of_key = ", ".join(f"{c} {t}" for c, t in nodes.dtypes if c in (*KEY, "entity_id"))
    names = [*KEY, "entity_id"]
    told = touching.scores(names, source, target, weight.reshape(heads * out, inputs) if first else None)
    n = written(nodes.select(*names, "x").mapInArrow(told, f"{of_key}, carried array<double>, s array<double>, t array<double>"), "nodes")
    # Cells near each other go to one task, so most of a node's sums meet there.
    tile = {"_tx": F.shiftright("_cx", 2), "_ty": F.shiftright("_cy", 2)}
    cell = [*KEY, "_i", "_j", "_tx", "_ty", "_cx", "_cy"]
    rows = g.cells(n).withColumns(tile).repartition(*cell[:-2]).sortWithinPartitions(*cell)
    sums = rows.mapInArrow(touching.cell_sums(KEY, cell, heads, out if first else None, SLOPE), f"{of_key}, sums array<double>")
    e = g.apart.join(n.select(*KEY, F.col("entity_id").alias("source"), "s", "carried"), [*KEY, "source"])
    e = e.join(n.select(*KEY, F.col("entity_id").alias("target"), "t"), [*KEY, "target"])
    level = F.zip_with("s", "t", lambda a, b: _leaky(a + b))
    alone = F.concat(level, F.array_repeat(F.lit(1.0), heads), *["carried"] * (1 if first else heads))
    sums = sums.union(e.select(*KEY, F.col("target").alias("entity_id"), alone.alias("sums")))
    done = touching.finished(KEY, heads, None if first else weight, bias)
    return sums.repartition(*names).sortWithinPartitions(*names).mapInArrow(done, f"{of_key}, x array<double>")


def heard(features: DataFrame, edges: DataFrame) -> DataFrame:
    """Who hears whom: edges both ways, and everyone themselves."""
    own = features.select(*KEY, F.col("entity_id").alias("source"), F.col("entity_id").alias("target"))
    return written(both_directions(edges).unionByName(own), "heard")


def _encoded(x: DataFrame, around: DataFrame | SheetGraph, model: Model) -> DataFrame:
    x = attend(x, around, model, "conv1").withColumn("x", elu(F.col("x")))
    return attend(x, around, model, "conv2").select(*KEY, "entity_id", unit(F.col("x")).alias("vector"))


def encode(features: DataFrame, edges: DataFrame, model: Model) -> DataFrame:
    """(KEY, entity_id, vector): vectors of unit length from features without place and two rounds over ``edges`` (graph_edges)."""
    return _encoded(features.select(*KEY, "entity_id", F.array(*NAMES).alias("x")), heard(features, edges), model)


def encode_sheets(entities: DataFrame, sheets: DataFrame, features: DataFrame, model: Model) -> DataFrame:
    """``encode`` over ``graph_edges(entities, sheets)``, without a table of the edges."""
    g = sheet_graph(entities, sheets, features.select(*KEY, "entity_id", F.array(*NAMES).alias("x")))
    return g.spread(written(_encoded(g.inputs(), g, model), "encoded"))


def probabilities(features: DataFrame, edges: DataFrame, model: Model) -> DataFrame:
    """(KEY, entity_id, p): chances of CLASSES from features with place; own features skip the two rounds."""
    x = written(features.select(*KEY, "entity_id", F.array(*NAMES, "px", "py").alias("x")), "inputs")
    return _chances(x, heard(features, edges), model)


def _chances(x: DataFrame, around: DataFrame | SheetGraph, model: Model) -> DataFrame:
    own = F.transform(product(model["self.weight"], F.col("x"), model["self.bias"]), lambda v: F.greatest(v, F.lit(0.0)))
    g = attend(x, around, model, "conv1").withColumn("x", elu(F.col("x")))
    g = attend(g, around, model, "conv2").select(*KEY, "entity_id", elu(F.col("x")).alias("g"))
    both = x.select(*KEY, "entity_id", own.alias("own")).join(g, [*KEY, "entity_id"])
    raw = both.select(*KEY, "entity_id", product(model["head.weight"], F.concat("own", "g"), model["head.bias"]).alias("raw"))
    raw = raw.select(*KEY, "entity_id", F.transform("raw", lambda v: F.exp(v - F.array_max("raw"))).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, v: a + v)
    return raw.select(*KEY, "entity_id", F.transform("e", lambda v: v / total).alias("p"))


def classify_graph(features: DataFrame, edges: DataFrame, model: Model) -> DataFrame:
    """(KEY, entity_id, semantic_label, semantic_confidence): the likeliest class, the first in order among equals, and its chance to
    six digits."""
    return _labels(probabilities(features, edges, model))


def classify_sheets(entities: DataFrame, sheets: DataFrame, features: DataFrame, model: Model) -> DataFrame:
    """``classify_graph`` over ``graph_edges(entities, sheets)``, without a table of the edges."""
    g = sheet_graph(entities, sheets, features.select(*KEY, "entity_id", F.array(*NAMES, "px", "py").alias("x")))
    return g.spread(written(_labels(_chances(g.inputs(), g, model)), "labels"))


def _labels(p: DataFrame) -> DataFrame:
    label = F.get(F.array(*[F.lit(c) for c in CLASSES]), (F.array_position("p", F.array_max("p")) - 1).cast("int"))
    return p.select(*KEY, "entity_id", label.alias("semantic_label"), F.round(F.array_max("p"), 6).alias("semantic_confidence"))
