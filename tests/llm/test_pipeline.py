"""The pipeline's stages one after another on a small table, each against brute force on its own input."""

import re
from collections import Counter, defaultdict

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from sheetdelta.llm import op1_secrets, op7_packing  # noqa: E402
from test_operators import brute_components, brute_pieces, brute_quality, brute_repeats, brute_secrets  # noqa: E402


def without(text, removed):
    """``text`` less its removed spans and one white-space character behind each."""
    out, last = [], 0
    for a, b in (map(int, s.split(":")) for s in removed.split(",") if s):
        out.append(text[last:a])
        last = b + (b < len(text) and text[b] in " \t\n\v\f\r")
    return "".join(out) + text[last:]


def masked(text):
    whole = re.compile(op1_secrets.WHOLE_KEY.replace(r"\z", r"\Z"))
    out, at = [], 0
    for a, b in sorted([(a, b) for a, _, b in brute_secrets(text)] + [m.span() for m in whole.finditer(text)]):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, [(r.doc_id, r.text) for r in docs.collect()]
    for name, f in pipeline.STAGES[:-1]:
        out = f(spark, docs, data)
        assert out.columns == columns, name
        rows = out.collect()
        now = [(r.doc_id, r.text) for r in rows]
        if name == "quality rules":
            assert not Counter(now) - Counter(before)
            good = [d for d, t in before if not brute_quality(t)[-1]]
            assert {d for d, _ in now} <= set(good) and len(now) >= 0.9 * len(good)
        elif name == "near-duplicates":
            kept = brute_components(before, 80)
            assert sorted(now) == sorted((d, t) for d, t in before if kept[d][2])
        elif name == "substring dedup":
            removed = brute_repeats([(d, t or "") for d, t in before])
            assert dict(now) == {d: without(t, removed[d][0]) for d, t in before}
        else:
            assert dict(now) == {d: masked(t) for d, t in before}
        docs, before = spark.createDataFrame(rows, docs.schema), now
    packed = pipeline.STAGES[-1][1](spark, docs, data).collect()
    ids = brute_pieces(before, op7_packing.vocabulary())
    total, sequences = Counter(), defaultdict(list)
    for r in packed:
        total[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert total == {d: len(x[0]) for d, x in ids.items()}
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= op7_packing.LENGTH


def test_run(spark, data):
    assert pipeline.run(spark, data).count() > 0
