"""Training of the two attention models: full gradients as sums over comparisons, one step a job.

A comparison (two small graphs) is a row.  Every step hands the weights to the tasks; each adds up the gradients of its comparisons,
in whole units of 2^-32 so that the sum does not depend on order, and Spark adds up the tasks' sums by position.  The
driver holds the state (weights and two moments of each, a few ten thousand numbers) and nothing of the data.  The same data and seed
give the same weights.

The encoder learns that an entity is nearest itself in the other revision, both ways (symmetric contrastive loss over all entities of
the comparison); the classifier learns the class of the entities that have one.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import ship, written
from .attention import CLASSES, CLASSIFIER, ENCODER, HIDDEN, SLOPE, Model, start
from .features import NAMES
from .graph import KEY, both_directions

TEMPERATURE = 0.1
UNIT = float(1 << 32)

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass
class Graph:
    x: np.ndarray
    source: np.ndarray
    target: np.ndarray
    label: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    @cached_property
    def heard(self) -> np.ndarray | None:
        """How often each node (row) hears each other, where that table is smaller than one of the edges' values; else nothing."""
        n = len(self.x)
        if n * n > len(self.source) * HIDDEN:
            return None
        return np.bincount(self.target * np.int64(n) + self.source, minlength=n * n).reshape(n, n).astype(float)

    @cached_property
    def by_source(self) -> Runs:
        return _runs(self.source)

    @cached_property
    def by_target(self) -> Runs:
        return _runs(self.target)


def _runs(index: np.ndarray) -> Runs:
    """(order, first, values): places of ``index`` by value, where each value's run begins, and the values."""
    order = np.argsort(index, kind="stable")
    ordered = index[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1])))
    return order, first, ordered[first]


def _gather(runs: Runs, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, *values.shape[1:]))
    order, first, nodes = runs
    if len(first):
        out[nodes] = np.add.reduceat(values[order], first, axis=0)
    return out


class Layer:
    """One attention layer on one graph, forwards and backwards."""

    def __init__(self, model: Model, name: str, g: Graph):
        self.name, self.g = name, g
        self.weight, self.a, self.b, self.bias = (model[f"{name}.{part}"] for part in ("weight", "source", "target", "bias"))

    def forward(self, x: np.ndarray) -> np.ndarray:
        g, n, (heads, out, inputs) = self.g, len(x), self.weight.shape
        self.x, self.z = x, (x @ self.weight.reshape(heads * out, inputs).T).reshape(n, heads, out)
        source, target = (self.z * self.a).sum(-1), (self.z * self.b).sum(-1)
        if g.heard is not None:
            # A matrix for each head: rows are targets.
            self.by_head = np.ascontiguousarray(self.z.transpose(1, 0, 2))
            raw = source.T[:, None, :] + target.T[:, :, None]
            self.slope = np.where(raw > 0, 1.0, SLOPE)
            score = np.where(g.heard > 0, raw * self.slope, -np.inf)
            top = score.max(2, keepdims=True, initial=-1e300)
            w = np.exp(score - top) * g.heard
            self.alpha = w / np.maximum(w.sum(2, keepdims=True), 1e-300)
            return (self.alpha @ self.by_head).transpose(1, 0, 2).reshape(n, -1) + self.bias
        raw = source[g.source] + target[g.target]
        self.slope = np.where(raw > 0, 1.0, SLOPE)
        score = raw * self.slope
        top = np.zeros((n, heads))
        order, first, nodes = g.by_target
        if len(first):
            top[nodes] = np.maximum.reduceat(score[order], first, axis=0)
        w = np.exp(score - top[g.target])
        self.alpha = w / _gather(g.by_target, w, n)[g.target]
        return _gather(g.by_target, self.alpha[:, :, None] * self.z[g.source], n).reshape(n, -1) + self.bias

    def backward(self, d: np.ndarray, grad: Model) -> np.ndarray:
        g, n, (heads, out, inputs) = self.g, len(self.x), self.weight.shape
        up = d.reshape(self.z.shape)
        if g.heard is not None:
            up = np.ascontiguousarray(up.transpose(1, 0, 2))
            dz = (self.alpha.transpose(0, 2, 1) @ up).transpose(1, 0, 2)
            da = self.alpha * (up @ self.by_head.transpose(0, 2, 1))
            draw = (da - self.alpha * da.sum(2, keepdims=True)) * self.slope
            ds, dt = draw.sum(1).T, draw.sum(2).T
        else:
            up = up[g.target]
            dz = _gather(g.by_source, self.alpha[:, :, None] * up, n)
            da = self.alpha * (up * self.z[g.source]).sum(-1)
            draw = (da - self.alpha * _gather(g.by_target, da, n)[g.target]) * self.slope
            ds, dt = _gather(g.by_source, draw, n), _gather(g.by_target, draw, n)
        dz = dz + ds[:, :, None] * self.a + dt[:, :, None] * self.b
        grad[f"{self.name}.source"] += (ds[:, :, None] * self.z).sum(0)
        grad[f"{self.name}.target"] += (dt[:, :, None] * self.z).sum(0)
        dz = dz.reshape(n, heads * out)
        grad[f"{self.name}.weight"] += (dz.T @ self.x).reshape(heads, out, inputs)
        grad[f"{self.name}.bias"] += d.sum(0)
        return dz @ self.weight.reshape(heads * out, inputs)


def _elu(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x, np.expm1(np.minimum(x, 0)))


def _elu_slope(y: np.ndarray) -> np.ndarray:
    return np.where(y > 0, 1.0, y + 1)


class Encoder:
    def __init__(self, model: Model, g: Graph):
        self.one, self.two = Layer(model, "conv1", g), Layer(model, "conv2", g)
        self.h = _elu(self.one.forward(g.x))
        z = self.two.forward(self.h)
        self.norm = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        self.vector = z / self.norm

    def backward(self, d: np.ndarray, grad: Model) -> None:
        dz = (d - self.vector * (d * self.vector).sum(1, keepdims=True)) / self.norm
        self.one.backward(self.two.backward(dz, grad) * _elu_slope(self.h), grad)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def contrastive(model: Model, grad: Model, old: Graph, new: Graph, i: np.ndarray, j: np.ndarray) -> float:
    """Loss of one comparison whose true pairs are (i, j); adds its gradient to ``grad``."""
    a, b = Encoder(model, old), Encoder(model, new)
    logits = a.vector @ b.vector.T / TEMPERATURE
    rows, columns = _softmax(logits[i]), _softmax(logits.T[j])
    k, m = np.arange(len(i)), len(i)
    loss = -(np.log(rows[k, j]).mean() + np.log(columns[k, i]).mean()) / 2
    rows[k, j] -= 1
    columns[k, i] -= 1
    d = (_gather(_runs(i), rows, len(old.x)) + _gather(_runs(j), columns, len(new.x)).T) / (2 * m * TEMPERATURE)
    a.backward(d @ b.vector, grad)
    b.backward(d.T @ a.vector, grad)
    return float(loss)


def classified(model: Model, grad: Model, g: Graph) -> float:
    """Loss over the entities of one graph that have a class."""
    some = np.flatnonzero(g.label >= 0)
    if not len(some):
        return 0.0
    one, two = Layer(model, "conv1", g), Layer(model, "conv2", g)
    own = np.maximum(g.x @ model["self.weight"].T + model["self.bias"], 0)
    h = _elu(one.forward(g.x))
    k = _elu(two.forward(h))
    joined = np.concatenate([own, k], 1)
    p = _softmax(joined @ model["head.weight"].T + model["head.bias"])
    loss = -np.log(p[some, g.label[some]]).mean()
    d = np.zeros_like(p)
    d[some] = p[some]
    d[some, g.label[some]] -= 1
    d /= len(some)
    grad["head.weight"] += d.T @ joined
    grad["head.bias"] += d.sum(0)
    back = d @ model["head.weight"]
    mine = back[:, : own.shape[1]] * (own > 0)
    grad["self.weight"] += mine.T @ g.x
    grad["self.bias"] += mine.sum(0)
    one.backward(two.backward(back[:, own.shape[1] :] * _elu_slope(k), grad) * _elu_slope(h), grad)
    return float(loss)


def _flat(model: Model) -> np.ndarray:
    return np.concatenate([model[k].ravel() for k in model])


def _shaped(flat: np.ndarray, shapes: dict) -> Model:
    out, at = {}, 0
    for name, shape in shapes.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def graphs(features: DataFrame, edges: DataFrame, names: list[str], extra: str) -> DataFrame:
    """(comparison_id, revision, x, extra, source, target): one row per graph.  ``extra`` is a column of ``features`` that goes along;
    nodes are in order of their names, edges are pairs of their numbers, both ways, and each node hears itself."""
    node = F.struct(F.col("entity_id").alias("id"), F.array(*names).alias("x"), F.col(extra).alias("extra"))
    n = features.groupBy(*KEY).agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    e = both_directions(edges).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("source", "target"))).alias("edges"))
    return n.join(e, KEY, "left").select(*KEY, F.col("nodes.id").alias("ids"), F.col("nodes.x").alias("x"), F.col("nodes.extra").alias("extra"), F.col("edges.source").alias("sources"), F.col("edges.target").alias("targets"))


#: Columns of one revision in a row of examples: numbers of features and nodes by node, ends of edges as numbers of nodes.
_SIDE = "{s}_x array<double>, {s}_extra array<string>, {s}_source array<int>, {s}_target array<int>"
_EXAMPLE = ", ".join(["comparison_id int", *[_SIDE.format(s=s) for s in ("old", "new")]])


def _numbered(batches):
    """Rows of numbers in place of names, one row at a time: no batch becomes Python objects as a whole."""
    schema = pa.schema([("comparison_id", pa.int32()), *[(f"{s}_{c}", pa.list_(t)) for s in ("old", "new") for c, t in (("x", pa.float64()), ("extra", pa.string()), ("source", pa.int32()), ("target", pa.int32()))]])
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            out = {"comparison_id": row["comparison_id"]}
            for s in ("old", "new"):
                ids = {name: i for i, name in enumerate(row[f"{s}_ids"] or [])}
                own = np.arange(len(ids), dtype=np.int32)
                source, target = (np.concatenate([np.array([ids[x] for x in row[f"{s}_{c}"] or []], np.int32), own]) for c in ("sources", "targets"))
                out |= {f"{s}_x": np.array(row[f"{s}_x"] or [], float).ravel(), f"{s}_extra": row[f"{s}_extra"] or [], f"{s}_source": source, f"{s}_target": target}
            yield pa.RecordBatch.from_pylist([out], schema)


def _examples(batches):
    """(comparison_id, graphs and extras of the revisions that have nodes) of each row; numbers are views of the batch."""
    for batch in batches:
        columns = {name: batch.column(name) for name in batch.schema.names}
        for k in range(batch.num_rows):
            graph, extra = {}, {}
            for s in ("old", "new"):
                names = columns[f"{s}_extra"][k].as_py()
                if names:
                    x, source, target = (columns[f"{s}_{c}"][k].values.to_numpy(zero_copy_only=False) for c in ("x", "source", "target"))
                    graph[s], extra[s] = Graph(x.reshape(len(names), -1), source, target), names
            yield columns["comparison_id"][k].as_py(), graph, extra


def _gradients(kind: str, weights: np.ndarray):
    """Sums over the comparisons of a task: position -1 is the loss, -2 their number."""

    def run(batches):
        shapes = ENCODER if kind == "encoder" else CLASSIFIER
        model = _shaped(weights, shapes)
        total, loss, count = np.zeros(len(weights), np.int64), 0, 0
        for _, graph, extra in _examples(batches):
            grad = {k: np.zeros_like(v) for k, v in model.items()}
            if kind == "encoder":
                # A key stands for the entity that the two revisions share; the first of equals counts.
                place = {k: i for i, k in reversed(list(enumerate(extra.get("new", [])))) if k is not None}
                seen = {k: i for i, k in reversed(list(enumerate(extra.get("old", [])))) if k in place}
                if not seen:
                    continue
                pairs = sorted((i, place[k]) for k, i in seen.items())
                value = contrastive(model, grad, graph["old"], graph["new"], *(np.array(c) for c in zip(*pairs)))
            else:
                value = 0.0
                for s, g in graph.items():
                    g.label = np.array([CLASSES.index(c) if c in CLASSES else -1 for c in extra[s]], np.int64)
                    value += classified(model, grad, g) / len(graph)
            total += np.rint(_flat(grad) * UNIT).astype(np.int64)
            loss += round(value * UNIT)
            count += 1
        if count:
            where = np.concatenate([np.arange(len(total)), [-1, -2]])
            yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), pa.array(np.concatenate([total, [loss, count]]))], ["i", "v"])

    return run


def examples(features: DataFrame, edges: DataFrame, names: list[str], extra: str) -> DataFrame:
    """Comparisons as written rows, both revisions side by side, nodes by number."""
    ship(features.sparkSession)
    g = graphs(features, edges, names, extra)
    columns = ["ids", "x", "extra", "sources", "targets"]
    side = lambda s: g.where(F.col("revision") == s).select(F.col("comparison_id").cast("int"), *[F.col(c).alias(f"{s}_{c}") for c in columns])
    return written(side("old").join(side("new"), "comparison_id", "full").mapInArrow(_numbered, _EXAMPLE), "examples")


#: Rows of vectors whose products with all others are held at once.
AT_ONCE = 1024


def _gaps(weights: np.ndarray):
    def run(batches):
        model = _shaped(weights, ENCODER)
        for k, graph, extra in _examples(batches):
            if len(graph) < 2:
                continue
            a, b = (Encoder(model, graph[s]).vector for s in ("old", "new"))
            number = {name: i for i, name in enumerate(dict.fromkeys(x for s in ("old", "new") for x in extra[s] if x is not None))}
            of_a, of_b = (np.array([number.get(x, -1) for x in extra[s]]) for s in ("old", "new"))
            least, most, named = [], [], of_b >= 0
            for at in range(0, len(a), AT_ONCE):
                product, mine = a[at : at + AT_ONCE] @ b.T, of_a[at : at + AT_ONCE]
                true, known = mine[:, None] == of_b, (mine >= 0)[:, None] & named
                least += [product[true & known].min(initial=np.inf)]
                most += [product[~true & known].max(initial=-np.inf)]
            found = [pa.array([v if np.isfinite(v) else None], pa.float64()) for v in (min(least), max(most))]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *found], ["comparison_id", "min_true", "max_false"])

    return run


def similarity_gaps(rows: DataFrame, model: Model) -> DataFrame:
    """(comparison_id, min_true, max_false): the least similarity of an entity with its namesake in the other revision and the largest with
    any other, by the encoder ``model``.  ``rows``: examples with ``uid``; a matrix product per comparison, no table of pairs."""
    ship(rows.sparkSession)
    return rows.mapInArrow(_gaps(_flat(model)), "comparison_id int, min_true double, max_false double")


def train(rows: DataFrame, kind: str, steps: int, rate: float, seed: int = 1337) -> tuple[Model, list[float]]:
    """(model, loss of each step) by Adam over the mean gradient of all ``rows`` (examples)."""
    ship(rows.sparkSession)
    shapes = ENCODER if kind == "encoder" else CLASSIFIER
    weights = _flat(start(shapes, seed))
    first, second, losses = np.zeros_like(weights), np.zeros_like(weights), []
    for step in range(1, steps + 1):
        sums = rows.mapInArrow(_gradients(kind, weights), "i int, v long").groupBy("i").agg(F.sum("v").alias("v")).collect()
        if not sums:
            raise ValueError("no comparison to learn from")
        found = {r.i: r.v for r in sums}
        n = found[-2]
        grad = np.array([found[i] for i in range(len(weights))], float) / (UNIT * n)
        losses.append(found[-1] / (UNIT * n))
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        weights = weights - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return _shaped(weights, shapes), losses


def train_encoder(features: DataFrame, edges: DataFrame, steps: int = 60, rate: float = 0.005, seed: int = 1337) -> tuple[Model, list[float]]:
    """``features`` without place and with ``uid``, the name that an entity has in both revisions."""
    return train(examples(features, edges, NAMES, "uid"), "encoder", steps, rate, seed)


def train_labels(features: DataFrame, edges: DataFrame, steps: int = 80, rate: float = 0.005, seed: int = 1337) -> tuple[Model, list[float]]:
    """``features`` with place and with ``semantic``, one of CLASSES or null."""
    return train(examples(features, edges, [*NAMES, "px", "py"], "semantic"), "classifier", steps, rate, seed)
