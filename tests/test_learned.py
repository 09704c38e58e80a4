"""Attention models on tables: against numpy, trained, pinned, and in the whole flow."""

import glob
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sheetdelta.functions.identity import with_identity
from sheetdelta.operators import attention, training
from sheetdelta.operators import features as ft
from sheetdelta.operators.graph import KEY, graph_edges
from sheetdelta.operators.match import cosine
from sheetdelta.operators.report import canonical_reports
from sheetdelta.plans import synth
from sheetdelta.plans.compare import compare
from sheetdelta.sources import models
from sheetdelta.tables import written


def random_graphs(spark, seed):
    """Two graphs: one with a hub and a node alone, one of a single node."""
    r = random.Random(seed)
    names = [*ft.NAMES, "px", "py"]
    nodes = [(1, "old", f"e{k:02}", *[r.uniform(-1, 1) for _ in names]) for k in range(12)] + [(1, "new", "x", *[r.uniform(-1, 1) for _ in names])]
    pairs = {("e00", f"e{k:02}") for k in range(1, 11)} | {tuple(sorted((f"e{r.randint(1, 10):02}", f"e{r.randint(1, 10):02}"))) for _ in range(15)}
    edges = [(1, "old", a, b, kind) for a, b in pairs if a < b for kind in (("knn-proximity",) if r.random() < 0.5 else ("knn-proximity", "connectivity"))]
    f = spark.createDataFrame(nodes, f"comparison_id int, revision string, entity_id string, {', '.join(f'{c} double' for c in names)}")
    return f, spark.createDataFrame(edges, "comparison_id int, revision string, source string, target string, edge_kind string")


def by_numpy(rows, width):
    """(ids, graph) of collected nodes, with edges added by the caller."""
    ids = [r.entity_id for r in rows]
    return ids, np.array([[r[c] for c in [*ft.NAMES, "px", "py"][:width]] for r in rows])


def plain_layer(m, name, x, edges):
    """One layer, node by node."""
    out = []
    for i in range(len(x)):
        around = [i] + [a for a, b in edges if b == i]
        parts = []
        for w, s, t in zip(m[f"{name}.weight"], m[f"{name}.source"], m[f"{name}.target"]):
            z = {j: w @ x[j] for j in around}
            score = [s @ z[j] + t @ z[i] for j in around]
            e = np.exp([v if v > 0 else 0.2 * v for v in score])
            parts.append(sum(a * z[j] for a, j in zip(e / e.sum(), around)))
        out.append(np.concatenate(parts) + m[f"{name}.bias"])
    return np.array(out)


def elu(x):
    return np.where(x > 0, x, np.exp(np.minimum(x, 0)) - 1)


@pytest.mark.parametrize("weights", [attention.probe, lambda s: attention.start(s, 5)])
def test_attention_against_numpy(spark, weights):
    f, edges = random_graphs(spark, 1)
    encoder, classifier = weights(attention.ENCODER), weights(attention.CLASSIFIER)
    got = {(r.revision, r.entity_id): r.vector for r in attention.encode(f, edges, encoder).collect()}
    chances = {(r.revision, r.entity_id): r.p for r in attention.probabilities(f, edges, classifier).collect()}
    labels = {(r.revision, r.entity_id): (r.semantic_label, r.semantic_confidence) for r in attention.classify_graph(f, edges, classifier).collect()}
    for revision in ("old", "new"):
        ids, x = by_numpy(f.where(F.col("revision") == revision).orderBy("entity_id").collect(), 19)
        pairs = {(ids.index(a), ids.index(b)) for r in edges.where(F.col("revision") == revision).collect() for a, b in ((r.source, r.target), (r.target, r.source))}
        z = plain_layer(encoder, "conv2", elu(plain_layer(encoder, "conv1", x[:, :17], pairs)), pairs)
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        own = np.maximum(x @ classifier["self.weight"].T + classifier["self.bias"], 0)
        k = elu(plain_layer(classifier, "conv2", elu(plain_layer(classifier, "conv1", x, pairs)), pairs))
        raw = np.concatenate([own, k], 1) @ classifier["head.weight"].T + classifier["head.bias"]
        p = np.exp(raw - raw.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for i, name in enumerate(ids):
            assert np.allclose(got[revision, name], z[i], atol=1e-9) and abs(np.linalg.norm(got[revision, name]) - 1) < 1e-9
            assert np.allclose(chances[revision, name], p[i], atol=1e-9)
            assert labels[revision, name] == (attention.CLASSES[int(p[i].argmax())], round(float(p[i].max()), 6))
    assert len(got) == len(chances) == 13
    nothing = f.where("false")
    assert attention.encode(nothing, edges.where("false"), encoder).count() == 0


def test_ties_take_the_first_class(spark):
    f, edges = random_graphs(spark, 2)
    flat = {k: np.zeros(s) for k, s in attention.CLASSIFIER.items()}
    assert {(r.semantic_label, r.semantic_confidence) for r in attention.classify_graph(f, edges, flat).collect()} == {("dimension", 0.125)}


def test_gradients_by_differences():
    """Both losses' gradients against differences of the loss."""
    r = np.random.default_rng(4)

    def graph(n):
        source, target = r.integers(0, n, 3 * n), r.integers(0, n, 3 * n)
        keep = source != target
        own = np.arange(n)
        return np.concatenate([source[keep], own]), np.concatenate([target[keep], own])

    old, new = (training.Graph(r.normal(size=(n, 17)), *graph(n)) for n in (6, 7))
    i, j = np.array([0, 1, 4]), np.array([2, 1, 6])
    g = training.Graph(r.normal(size=(8, 19)), *graph(8), np.array([0, 3, -1, 7, 2, 2, -1, 5]))
    for shapes, loss in ((attention.ENCODER, lambda m, d: training.contrastive(m, d, old, new, i, j)), (attention.CLASSIFIER, lambda m, d: training.classified(m, d, g))):
        m = attention.start(shapes, 6)
        zero = lambda: {k: np.zeros(s) for k, s in shapes.items()}
        grad = zero()
        loss(m, grad)
        for name in shapes:
            at = tuple(int(r.integers(0, n)) for n in m[name].shape)
            up, down = ({k: v.copy() for k, v in m.items()} for _ in range(2))
            up[name][at] += 1e-6
            down[name][at] -= 1e-6
            assert abs((loss(up, zero()) - loss(down, zero())) / 2e-6 - grad[name][at]) < 1e-5, name


def learning(spark, seeds):
    e = written(with_identity(synth.learning_pairs(spark, seeds)))
    s = synth.sheets(spark, seeds)
    f = ft.entity_features(e, s).join(e.select(*KEY, "entity_id", "uid", "semantic"), [*KEY, "entity_id"])
    return written(f), written(graph_edges(e, s))


@pytest.fixture(scope="module")
def trained(spark):
    f, edges = learning(spark, list(range(1, 13)))
    return training.train_encoder(f, edges, steps=40), training.train_labels(f, edges, steps=40), (f, edges)


def test_training(spark, trained):
    (encoder, losses), (classifier, label_losses), (f, edges) = trained
    assert losses[-1] < losses[0] / 2 and label_losses[-1] < label_losses[0] / 2
    again, _ = training.train_encoder(f.repartition(3), edges.repartition(5), steps=3)
    once, _ = training.train_encoder(f, edges, steps=3)
    assert all((again[k] == once[k]).all() for k in again)
    # Seeds that were not learned from: the class of nearly all entities, and true pairs above false ones.
    f, edges = learning(spark, [202, 203])
    found = attention.classify_graph(f, edges, classifier).join(f.select(*KEY, "entity_id", "semantic"), [*KEY, "entity_id"])
    right, n, low = found.agg(F.count_if(F.col("semantic_label") == F.col("semantic")), F.count("*"), F.count_if(F.col("semantic_confidence") < 0.5)).first()
    assert right / n >= 0.9 and low <= n
    v = attention.encode(f, edges, encoder).join(f.select(*KEY, "entity_id", "uid"), [*KEY, "entity_id"])
    side = lambda s, p: v.where(F.col("revision") == s).select("comparison_id", F.col("uid").alias(p + "uid"), F.col("vector").alias(p))
    pairs = side("old", "a").join(side("new", "b"), "comparison_id").select("comparison_id", (F.col("auid") == F.col("buid")).alias("is_true"), cosine(F.col("a"), F.col("b")).alias("similarity"))
    mean = {r.is_true: r.s for r in pairs.groupBy("is_true").agg(F.avg("similarity").alias("s")).collect()}
    assert mean[True] > 0.8 and mean[True] - mean[False] > 0.4
    gap = ft.similarity_gap(pairs, ["comparison_id"]).collect()
    assert len(gap) == 2 and all(g.min_true is not None and g.max_false is not None for g in gap)


def test_nothing_to_learn(spark):
    f, edges = random_graphs(spark, 3)
    with pytest.raises(ValueError, match="no comparison"):
        training.train_encoder(f.withColumn("uid", F.lit(None).cast("string")), edges, steps=1)


def test_pinned_models(spark, tmp_path):
    model = attention.start(attention.ENCODER, 1)
    folder = str(tmp_path)
    found = models.save_model(spark, model, folder, "encoder")
    models.save_model(spark, attention.start(attention.CLASSIFIER, 2), folder, "classifier")
    back = models.load_model(spark, folder, "encoder", attention.ENCODER)
    assert models.digest(back) == found == models.save_model(spark, back, folder, "encoder")
    version = models.pipeline_version(spark, folder)
    assert version.endswith(f"+encoder.{found[:8]}") and version.startswith("1+classifier.")
    # Another number, a missing one, one too many, and another byte of the file are all refused.
    rows = models.as_rows(spark, model)
    path = f"{folder}/encoder/{found}"
    for changed in (rows.withColumn("value", F.when(F.col("i") == 3, F.col("value") + 1e-9).otherwise(F.col("value"))), rows.where("i <> 3"), rows.union(rows.limit(1))):
        changed.coalesce(1).write.mode("overwrite").parquet(path)
        with pytest.raises(models.PinError):
            models.load_model(spark, folder, "encoder", attention.ENCODER)
    rows.coalesce(1).write.mode("overwrite").option("compression", "none").parquet(path)
    assert models.digest(models.load_model(spark, folder, "encoder", attention.ENCODER)) == found
    file = glob.glob(f"{path}/*.parquet")[0]
    data = bytearray(open(file, "rb").read())
    data[len(data) // 2] ^= 1
    for check in glob.glob(f"{path}/.*.crc"):
        open(check, "wb").close()
    with open(file, "wb") as out:
        out.write(data)
    with pytest.raises(Exception):
        models.load_model(spark, folder, "encoder", attention.ENCODER)
    with pytest.raises(Exception):
        models.pinned(spark, folder, "another")


def test_report_names_its_models(spark, tmp_path, trained):
    """A comparison with the pinned encoder pairs an entity that moved far; its report carries the version that follows from both models."""
    (encoder, _), (classifier, _), _ = trained
    folder = str(tmp_path)
    models.save_model(spark, encoder, folder, "encoder")
    models.save_model(spark, classifier, folder, "classifier")
    version = models.pipeline_version(spark, folder, "2")
    assert version == f"2+classifier.{models.digest(classifier)[:8]}+encoder.{models.digest(encoder)[:8]}"
    sheets = synth.sheets(spark, [0])
    c = compare(synth.pair(spark, ["move"], distance=60.0), sheets, encoder=models.load_model(spark, folder, "encoder", attention.ENCODER))
    rows = c.deltas.collect()
    assert [(r.change_type, r.tier, list(r.kinds)) for r in rows] == [("modified", "learned", ["moved"])] and rows[0].similarity >= 0.3
    assert f'"pipeline_version":"{version}"' in canonical_reports(sheets, c.deltas, version).first().report


def test_examples_are_numbers(spark):
    """Rows to learn from hold numbers that tasks read in place (F11): each node hears itself, ends are places of nodes."""
    f, edges = random_graphs(spark, 8)
    f = f.withColumn("uid", F.when(F.col("entity_id") != "e03", F.col("entity_id")))
    rows = training.examples(f, edges, ft.NAMES, "uid")
    assert {t for c, t in rows.dtypes if c.endswith(("_source", "_target"))} == {"array<int>"}
    (row,) = rows.collect()
    both = edges.select("source", "target").union(edges.select("target", "source")).distinct().collect()
    place = {f"e{k:02}": k for k in range(12)}
    assert sorted(zip(row.old_source, row.old_target)) == sorted([(place[a], place[b]) for a, b in both] + [(k, k) for k in range(12)])
    assert len(row.old_x) == 12 * len(ft.NAMES) and row.old_extra[3] is None and (row.new_source, row.new_target) == ([0], [0])


def test_attention_by_matrix_equals_by_edges():
    """Both forms of a layer, forwards and backwards (F10): a node that hears another twice, and one that hears nobody."""
    r = np.random.default_rng(9)
    x = r.normal(size=(7, 17))
    source, target = np.array([0, 1, 1, 2, 3, 4, 5, 5, 6]), np.array([1, 0, 0, 2, 2, 5, 5, 4, 1])
    m = attention.start(attention.ENCODER, 3)
    found = []
    for by_edges in (False, True):
        g = training.Graph(x, source, target)
        assert g.heard is not None
        if by_edges:
            g.heard = None
        layer, grad = training.Layer(m, "conv1", g), {k: np.zeros_like(v) for k, v in m.items()}
        y = layer.forward(x)
        found.append([y, layer.backward(np.cos(y), grad), *grad.values()])
    assert all(np.allclose(a, b, atol=1e-12) for a, b in zip(*found))


def test_similarity_gaps_equal_the_pairs(spark):
    """The gap by a matrix product per comparison against the table of pairs (F10), with names that are null or given twice."""
    f, edges = learning(spark, [5, 6])
    n = F.row_number().over(Window.partitionBy(*KEY).orderBy("entity_id"))
    f = written(f.withColumn("uid", F.when(n == 2, F.lit(None)).when(n == 3, F.lit("twice")).when(n == 4, F.lit("twice")).otherwise(F.col("uid"))))
    model = attention.start(attention.ENCODER, 2)
    v = attention.encode(f, edges, model).join(f.select(*KEY, "entity_id", "uid"), [*KEY, "entity_id"])
    side = lambda s, p: v.where(F.col("revision") == s).select("comparison_id", F.col("uid").alias(p + "uid"), F.col("vector").alias(p))
    pairs = side("old", "a").join(side("new", "b"), "comparison_id").select("comparison_id", (F.col("auid") == F.col("buid")).alias("is_true"), cosine(F.col("a"), F.col("b")).alias("similarity"))
    want = {r.comparison_id: (r.min_true, r.max_false) for r in ft.similarity_gap(pairs, ["comparison_id"]).collect()}
    got = {r.comparison_id: (r.min_true, r.max_false) for r in training.similarity_gaps(training.examples(f, edges, ft.NAMES, "uid"), model).collect()}
    assert len(want) == 2 and got.keys() == want.keys()
    assert all(abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k]))
