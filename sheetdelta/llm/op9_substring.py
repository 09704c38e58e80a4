"""Repeated passages by hashing lines, paragraphs, and the clauses within them.

Units are normalised (A-Z lowered, white space between words ignored) and named by a 128-bit digest.  The digests are grouped
over the whole table, and the document that ranks first (smallest doc_id) owns a unit; other documents, and later places of the
same document, repeat it.
- Lines and paragraphs (between lines without words) are the units of the method.  A line of at least 5 words that its own
  document has already held goes.  A run of lines that repeat, short ones included, or a paragraph goes if it has at least 20
  words (MIN_RUN): a shared heading, license line or greeting by itself is no repeated passage.
- Clauses are an addition, since passages are often quoted or edited inside a line, where no line or paragraph is equal.  A
  clause ends with a sentence, with its line, and after any word whose hash is a multiple of 16, so equal passages fall into equal
  clauses wherever they stand.  A run of repeated clauses, with clauses under 3 words between them, goes if the repeats in it have at
  least 20 words.
Removed spans are given as code points of the original text: all of them, and apart those by lines or paragraphs and by clauses.

Only (digest, document) pairs are shuffled; texts move once, to meet the list of digests that others own.

Defined results: a null text has no units and stays null; rows with the same doc_id are versions of one document and do not remove
passages from each other; every row without a doc_id is a document of its own, ranked behind those with one by a row key; an
empty table gives an empty result; further columns, whatever their names, are kept by the stage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrow import by_bytes
from .common import materialise, prepare, table
from .shingles import _SPACE, _LOWER, _power_table, mix

MIN_LINE, MIN_CLAUSE, MIN_RUN = 5, 3, 20
CUT_MASK = np.uint64(15)
CHUNK = 1 << 21
#: A document: whether it lacks a doc_id, and its doc_id or else its row key.
DOCUMENT = ["_late", "_rank"]


class Units:
    """Words, clauses and lines of many texts at once, as arrays over their joined bytes."""

    def __init__(self, texts: list[bytes]):
        raw = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(raw, np.uint8)
        low = np.frombuffer(raw.translate(_LOWER), np.uint8)
        space = _SPACE[self.data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        up, down = _power_table(len(low))
        total = np.empty(len(low) + 1, np.uint64)
        total[0] = 0
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], out=total[1:])
        self.words = mix((total[self.end] - total[self.start]) * down[self.start])
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        self.text_start = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        self.text_of = np.searchsorted(self.text_start, self.start, "right") - 1
        n = len(self.words)
        newlines = np.concatenate(([0], np.cumsum(self.data == 10)))
        # A text ends in the line break that joins it to the next.
        line_end = newlines[np.concatenate((self.start[1:], [len(raw)]))[:n]] > newlines[self.end] if n else np.zeros(0, bool)
        stop = np.isin(self.data[self.end - 1], np.frombuffer(b".!?", np.uint8)) if n else line_end
        self.lines = self._cut(line_end)
        # A line without words, or the end of a text, stands between two paragraphs.
        breaks = newlines[np.concatenate((self.start[1:], [len(raw)]))[:n]] - newlines[self.end] if n else np.zeros(0, np.int64)
        last = np.concatenate((self.text_of[1:] != self.text_of[:-1], [True])) if n else line_end
        self.paragraphs = self._cut((breaks > 1) | last)
        self.clauses = self._cut(line_end | stop | ((self.words & CUT_MASK) == 0))

    def _cut(self, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first word, last word, number of words, digest halves) of the units that end where ``last`` says."""
        b = np.flatnonzero(last)
        a = np.concatenate(([0], b[:-1] + 1)) if len(b) else b
        up, down = _power_table(len(self.words) + 1)
        halves = []
        for salt in (np.uint64(0), np.uint64(0x5851F42D4C957F2D)):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(self.words ^ salt) * up[: len(self.words)], dtype=np.uint64)))
            halves.append(mix((total[b + 1] - total[a]) * down[a] + np.uint64(1)) if len(b) else np.empty(0, np.uint64))
        return a, b, b - a + 1, halves[0].view(np.int64), halves[1].view(np.int64)


def _units(batches):
    for batch in batches:
        for part in by_bytes(batch, "text", CHUNK):
            u = Units(part.column("text").fill_null("").cast(pa.binary()).to_pylist())
            text, h1, h2 = [], [], []
            for (a, _, n, x, y), least in ((u.lines, 1), (u.paragraphs, MIN_RUN), (u.clauses, MIN_CLAUSE)):
                keep = n >= least
                text.append(u.text_of[a[keep]] if len(a) else a)
                h1.append(x[keep])
                h2.append(y[keep])
            t, x, y = np.concatenate(text), np.concatenate(h1), np.concatenate(h2)
            # A line of one clause has the digest of the clause; one row for each digest of a text.
            first = np.sort(_first_of_each(t, x, y))
            of = pa.array(t[first])
            yield pa.RecordBatch.from_arrays([*[part.column(c).take(of) for c in DOCUMENT], pa.array(x[first]), pa.array(y[first])], [*DOCUMENT, "h1", "h2"])


def _first_of_each(t: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    order = np.lexsort((y, x, t))
    new = np.ones(len(t), bool)
    new[1:] = (t[order][1:] != t[order][:-1]) | (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
    return order[new]


def _intervals(n: np.ndarray, repeat: np.ndarray, short: int) -> list[tuple[int, int]]:
    """First and last unit of every run of repeats with at least MIN_RUN words.  Units under ``short`` words do not end a run."""
    live = np.flatnonzero(repeat)
    if not len(live):
        return []
    fixed = np.concatenate(([0], np.cumsum(~repeat & (n >= short))))
    cut = np.flatnonzero(fixed[live[1:]] > fixed[live[:-1] + 1]) + 1
    return [(int(run[0]), int(run[-1])) for run in np.split(live, cut) if n[run].sum() >= MIN_RUN]


def _joined(cuts: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for p, q in sorted(cuts):
        if out and p <= out[-1][1]:
            out[-1][1] = max(out[-1][1], q)
        else:
            out.append([p, q])
    return out


def _clean(batches):
    for batch in batches:
        for part in by_bytes(batch, "text", CHUNK):
            column = part.column("text").fill_null("").cast(pa.binary()).to_pylist()
            u = Units(column)
            point = np.concatenate(([0], np.cumsum((u.data & 0xC0) != 0x80)))
            others = part.column("others")
            pair = others.flatten()
            pairs = list(zip(pair.field("h1").to_pylist(), pair.field("h2").to_pylist()))
            sizes = np.asarray(others.value_lengths().fill_null(0), np.int64)
            ends = np.cumsum(sizes)
            levels = []
            for (a, b, n, x, y), least in ((u.lines, 1), (u.paragraphs, MIN_RUN), (u.clauses, MIN_CLAUSE)):
                t = u.text_of[a] if len(a) else a
                again = np.ones(len(t), bool)
                if len(t):
                    again[_first_of_each(t, x, y)] = False
                levels.append((a, b, n, x, y, again & (n >= least), n >= least, np.searchsorted(t, np.arange(len(column) + 1))))
            texts, spans, counts = [], ([], [], []), []
            for i, raw in enumerate(column):
                known = set(pairs[ends[i] - sizes[i] : ends[i]])
                found = []
                for level, (a, b, n, x, y, again, long, at) in enumerate(levels):
                    s = slice(int(at[i]), int(at[i + 1]))
                    repeat = again[s]
                    if known and s.stop > s.start:
                        repeat = repeat | long[s] & np.fromiter(((p, q) in known for p, q in zip(x[s].tolist(), y[s].tolist())), bool, s.stop - s.start)
                    runs = _intervals(n[s], repeat, MIN_CLAUSE if level == 2 else 1)
                    if level == 0:
                        runs += [(k, k) for k in np.flatnonzero(again[s] & (n[s] >= MIN_LINE)).tolist()]
                    found.append([(int(u.start[a[s][p]]), int(u.end[b[s][q]])) for p, q in runs])
                base = int(u.text_start[i])
                whole, inner = _joined(found[0] + found[1]), _joined(found[2])
                joined = _joined(whole + inner)
                out, last = [], 0
                for p, q in joined:
                    # The white space behind a removed span goes with it, as far as one character.
                    stop = q - base
                    out.append(raw[last : p - base])
                    last = stop + (stop < len(raw) and bool(_SPACE[raw[stop]]))
                out.append(raw[last:])
                texts.append(b"".join(out).decode("utf-8", "replace"))
                zero = int(point[base])
                for k, cuts in enumerate((joined, whole, inner)):
                    spans[k].append(",".join(f"{int(point[p]) - zero}:{int(point[q]) - zero}" for p, q in cuts))
                counts.append(int(sum(point[q] - point[p] for p, q in joined)))
            text = pa.array(texts, pa.string(), mask=np.asarray(part.column("text").is_null()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), text, *[pa.array(x, pa.string()) for x in spans], pa.array(counts, pa.int64())],
                ["doc", "text", "removed", "removed_lines", "removed_clauses", "removed_chars"],
            )


def _ranked(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of DOCUMENT.  Only rows without a doc_id are written, since their keys must not change."""
    rank = F.col("doc_id").cast("long")
    named = docs.where(rank.isNotNull()).withColumns({"_late": F.lit(False), "_rank": rank})
    nameless = docs.where(rank.isNull()).withColumns({"_late": F.lit(True), "_rank": F.monotonically_increasing_id()})
    return named.unionByName(materialise(nameless, "nameless"))


def repeated_units(rows: DataFrame) -> DataFrame:
    """(DOCUMENT, others): for every document of ``rows`` (DOCUMENT, text) with units that an earlier one owns, their digests."""
    prepare(rows.sparkSession)
    units = rows.select(*DOCUMENT, "text").mapInArrow(_units, "_late boolean, _rank long, h1 long, h2 long")
    early, late = F.when(~F.col("_late"), F.col("_rank")), F.when(F.col("_late"), F.col("_rank"))
    owners = units.groupBy("h1", "h2").agg(F.min(early).alias("owner"), F.max(early).alias("last"), F.min(late).alias("late_owner"), F.max(late).alias("late_last"))
    # A document with a doc_id owns a unit before any without one.
    owners = owners.where("owner < last or late_owner < late_last or owner is not null and late_owner is not null").drop("last", "late_last")
    behind = F.when(F.col("_late"), F.col("owner").isNotNull() | (F.col("_rank") > F.col("late_owner"))).otherwise(F.col("_rank") > F.col("owner"))
    later = units.join(owners, ["h1", "h2"]).where(behind)
    return later.groupBy(*DOCUMENT).agg(F.collect_set(F.struct("h1", "h2")).alias("others"))


def remove_repeats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """For every row: the columns ``keep`` as a struct ``doc``, text (without the repeats), removed ("start:end,..." of the original),
    removed_lines and removed_clauses (the spans by lines or paragraphs, and by clauses) and removed_chars."""
    doc = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc")
    ranked = _ranked(docs.select("doc_id", doc, F.col("text").cast("string").alias("text")))
    joined = ranked.select(*DOCUMENT, "doc", "text").join(repeated_units(ranked), DOCUMENT, "left").select("doc", "text", "others")
    return joined.mapInArrow(_clean, _schema(joined))


def _schema(joined: DataFrame) -> StructType:
    out = StructType([joined.schema["doc"]])
    for c in ("text", "removed", "removed_lines", "removed_clauses"):
        out = out.add(c, "string")
    return out.add("removed_chars", "long")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without repeated passages; n_chars follows the text.  Every row stays."""
    done = remove_repeats(docs, [c for c in docs.columns if c != "text"])
    n_chars = F.when(F.col("removed_chars") > 0, F.char_length("text").cast("long")).otherwise(F.col("doc.n_chars"))
    new = {"text": F.col("text"), "n_chars": n_chars}
    return done.select(*[new[c].alias(c) if c in new else F.col(f"doc.`{c}`") for c in docs.columns])


def op9_repeated_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return done.select("doc.doc_id", "removed", "removed_lines", "removed_clauses", "removed_chars", "text")
