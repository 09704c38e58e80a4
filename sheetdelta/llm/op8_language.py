"""Language identification by cross-parsing entropy.

A bounded sample of labelled text per language is indexed by a suffix automaton.  A text is parsed against each language:
the longest prefix that occurs in the sample is a phrase, and parsing goes on behind it.  Few, long phrases mean low cross
entropy.  Phrases are normalised by one code for all languages: a phrase costs the bits of a place in the longest sample and of a
length, or those of its letters spelled out in the alphabet of all samples, whichever are fewer, and a letter that the sample lacks
is a phrase spelled out.  So a short sample does not make phrases cheap, and the language with the fewest bits wins.

Texts are parsed in segments of 512 characters, so that numpy steps through many segments of a batch at once; every
character of a text is used.  Letters count in lower case and anything else is a blank.

Sample: rows with text and lang whose crc32(doc_id) mod 4 is not 2; of each language, one row for each of 64 hash values of
doc_id, texts of at most 3,000 characters first, until there are 12,000 characters (SAMPLE_CHARS; less where there are over
SAMPLE_TOTAL / SAMPLE_CHARS languages, so that the sample as a whole is bounded).  A sampled text counts by its first 20,000
characters (LONGEST).  Up to MAX_LANGS languages are learned, those with most rows.

Defined results: lang_pred is ``und`` (score 0) if the text is null or has no letter, or nothing could be learned; a language whose
sample has no letter is no candidate; rows of languages beyond MAX_LANGS get one of those learned; ties go to the language first in
order; repeated rows each get a row; held_out is false for a null ``doc_id``; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow import by_bytes
from .common import materialise, prepare, table

SAMPLE_CHARS, SAMPLE_ROWS, SHORT, LONGEST = 12_000, 64, 3_000, 20_000
SAMPLE_TOTAL, MAX_LANGS = 1_200_000, 500
SEGMENT = 512
#: Bits that name a phrase's length.
LENGTH_BITS = 4.0
CHUNK = 4 << 20
UNKNOWN = "und"

_tables: dict[int, tuple] = {}


def blanked(text: str) -> str:
    return "".join(c if c.isalpha() else " " for c in text.lower())


def suffix_automaton(symbols: list[int], size: int) -> np.ndarray:
    """Transitions (states, size) of the suffix automaton of a symbol sequence; -1 where there is none."""
    link, length, to = [-1], [0], [{}]
    last = 0
    for c in symbols:
        new = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    out = np.full((len(to), size), -1, np.int32)
    for s, row in enumerate(to):
        for c, t in row.items():
            out[s, c] = t
    return out


class CrossParser:
    """Phrase counts of texts against every sample.  A table entry holds the next state, and whether a phrase starts with the symbol."""

    def __init__(self, samples: list[tuple[str, str]]):
        plain = [(lang, " ".join(blanked(t).split())) for lang, t in samples]
        self.langs = [lang for lang, t in plain if t]
        texts = [t for _, t in plain if t]
        letters = sorted(set("".join(texts)) - {" "})
        # 0 pads, 1 is a blank, 2 is a letter of no sample
        self.symbol = {c: i + 3 for i, c in enumerate(letters)}
        self.size = len(letters) + 3
        # What the l-th letter of a phrase adds to the bits of the phrase.
        spelled = np.log2(self.size - 1)
        place = np.log2(max([2, *map(len, texts)])) + LENGTH_BITS
        self.adds = np.diff(np.minimum(np.arange(int(place / spelled) + 3) * spelled, place), prepend=0.0)
        parts, at = [], 0
        self.roots = []
        for t in texts:
            step = suffix_automaton([1 if c == " " else self.symbol[c] for c in t], self.size).astype(np.int64)
            miss = step < 0
            fresh = np.where(step[0] < 0, 0, step[0])
            step = np.where(miss, fresh[None, :], step)
            # The root is left at the start of a text and behind a letter of no sample: a phrase starts there, too.
            miss[0] = True
            code = ((step + at) * self.size) << 1 | miss
            code[:, 0] = ((np.arange(len(step)) + at) * self.size) << 1
            parts.append(code.ravel())
            self.roots.append(at * self.size)
            at += len(step)
        joined = np.concatenate(parts) if parts else np.empty(0, np.int64)
        self.table = joined.astype(np.int32) if len(joined) and joined.max() < 1 << 31 else joined
        bmp = np.full(65536, 2, np.uint8 if self.size < 256 else np.uint16)
        codes = np.arange(65536)
        alpha = np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in codes), bool, 65536)
        bmp[~alpha] = 1
        for c, i in self.symbol.items():
            if ord(c) < 65536:
                bmp[ord(c)] = i
        self.alpha, self.bmp = alpha, bmp

    def symbols(self, text: str) -> tuple[np.ndarray, bool]:
        """Symbols of a text, and whether it has a letter."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        low = np.minimum(codes, 65535)
        out = self.bmp[low]
        some = bool(self.alpha[low].any())
        for i in np.flatnonzero(codes > 65535).tolist():
            c = chr(codes[i])
            out[i] = self.symbol.get(c, 2) if c.isalpha() else 1
            some = some or c.isalpha()
        return out, some

    def parse(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(rows, languages) numbers of phrases, and bits."""
        n, langs = len(rows), len(self.langs)
        out, bits = np.zeros((n, langs), np.int64), np.zeros((n, langs))
        sizes = np.array([len(r) for r in rows], np.int64)
        pieces = -(-sizes // SEGMENT)
        total = int(pieces.sum())
        if not total or not langs:
            return out, bits
        owner = np.repeat(np.arange(n), pieces)
        flat = np.concatenate([*rows, np.zeros(SEGMENT, rows[0].dtype)])
        base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        number = np.arange(total) - np.repeat(np.concatenate(([0], np.cumsum(pieces)[:-1])), pieces)
        start = base[owner] + number * SEGMENT
        length = np.minimum(SEGMENT, sizes[owner] - number * SEGMENT)
        order = np.argsort(-length, kind="stable")
        start, length, owner = start[order], length[order], owner[order]
        active = np.searchsorted(-length, -np.arange(SEGMENT), "left")
        state = np.repeat(np.array(self.roots, self.table.dtype)[:, None], total, 1)
        begun = np.zeros((langs, total), np.int32)
        # Letters of the present phrase, up to where another adds nothing; how often each number was reached.
        last = len(self.adds) - 1
        letters = np.zeros((langs, total), np.int8)
        spent = np.zeros((langs, total), np.float32)
        adds = self.adds.astype(np.float32)
        for t in range(int(length[0])):
            k = int(active[t])
            sym = flat[start[:k] + t].astype(self.table.dtype)
            code = self.table[state[:, :k] + sym]
            new = code & 1
            begun[:, :k] += new
            state[:, :k] = code >> 1
            here = np.where(new, 1, np.minimum(letters[:, :k] + 1, last)).astype(np.int8)
            letters[:, :k] = here
            spent[:, :k] += adds[here]
        for j in range(langs):
            out[:, j] = np.bincount(owner, weights=begun[j], minlength=n).astype(np.int64)
            bits[:, j] = np.bincount(owner, weights=spent[j], minlength=n)
        return out, bits

    def phrases(self, rows: list[np.ndarray]) -> np.ndarray:
        return self.parse(rows)[0]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        rows, where = [], []
        for i, t in enumerate(texts):
            if t:
                s, some = self.symbols(t)
                if some:
                    rows.append(s)
                    where.append(i)
        if not rows or not self.langs:
            return out
        cost = np.round(self.parse(rows)[1], 3)
        best = cost.argmin(1)
        gap = np.minimum(cost - cost.min(1)[:, None], 700)
        score = 1 / np.exp2(-gap).sum(1)
        for i, b, s in zip(where, best.tolist(), score.tolist()):
            out[i] = (self.langs[b], min(1.0, s))
        return out


def parser(samples: list[tuple[str, str]]) -> CrossParser:
    """The parser of a sample, kept for the life of the Python worker."""
    key = hash(tuple(samples))
    if key not in _tables:
        _tables.clear()
        _tables[key] = CrossParser(samples)
    return _tables[key]


def _apply(samples: list[tuple[str, str]]):
    def run(batches):
        from sheetdelta.llm import op8_language

        p = op8_language.parser(samples)
        for batch in batches:
            for part in by_bytes(batch, "text", CHUNK):
                found = p.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    return run


def learn(docs: DataFrame, most: int = MAX_LANGS) -> list[tuple[str, str]]:
    """[(language, sample text)] in order.  At most SAMPLE_TOTAL characters, and one more text of each language, come to the driver."""
    keep = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2))
    keep = keep.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"), "text")
    part = F.pmod("h", F.lit(SAMPLE_ROWS)).alias("part")
    chosen = keep.groupBy("lang", part).agg(F.min(F.struct("h", "doc_id"))["doc_id"].alias("doc_id"), F.count("*").alias("n"))
    chosen = materialise(chosen, "sample")
    langs = [r.lang for r in chosen.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()]
    if not langs:
        return []
    ids = F.broadcast(chosen.where(F.col("lang").isin(langs)).select("lang", "doc_id"))  # at most SAMPLE_ROWS * MAX_LANGS rows
    # Of rows with one doc_id the first text in order stands for all.
    text = F.substring("text", 1, LONGEST)
    rows = keep.join(ids, ["lang", "doc_id"], "left_semi").groupBy("lang", "doc_id", "h").agg(F.min(text).alias("text"))
    before = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy(F.length("text") > SHORT, "h", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    share = min(SAMPLE_CHARS, SAMPLE_TOTAL // len(langs))
    rows = rows.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < share)
    by_lang: dict[str, list] = {}
    for r in rows.select("lang", "before", "text").collect():
        by_lang.setdefault(r.lang, []).append((r.before, r.text))
    return [(lang, "\n".join(t for _, t in sorted(by_lang[lang]))) for lang in sorted(by_lang)]


def identify(docs: DataFrame, samples: list[tuple[str, str]]) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, held_out, lang_pred, score."""
    prepare(docs.sparkSession)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_apply(samples), "doc_id long, held_out boolean, lang_pred string, score double")


def op8_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, learn(docs))
