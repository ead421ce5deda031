"""Toxicity by a weighted lexicon, matched with Aho-Corasick.

Texts are folded first: compatibility forms, look-alike letters of other scripts,
invisible characters, and digits or signs that stand for letters within a word. The
lexicon holds beginnings of words; an entry's weight is the lower end of a confidence
interval of its log odds between toxic and clean training rows. Exception phrases are
two words in a row, one of which an entry begins, that speak for a clean row by the same
measure; they are matched with the same automaton and cover the entries inside them. A document's
matched weight, as a sum and normalised by its length, goes through a logistic
calibration; it is fitted on training rows measured with a lexicon from other rows
(two halves, each with the other's), while the final lexicon is of both halves.

Fitting uses at most SAMPLE_ROWS training rows a class, and of what could be an entry or
an exception the MOST_ENTRIES in most rows; every row's whole text is scored.

Defined results: a null text is scored as an empty one. Without rows of both classes
every score is the rate of label 1 (0.5 without any label). A row with a null id has
held_out false. Rows that repeat an id are each scored. An empty table gives an empty
result.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import fit
from cellweave.llm.common import discard, materialise, pieces, table, text_of

FOLD = (5, 0)
SAMPLE_ROWS = 4000
#: Entries have so many letters, and so many toxic training rows at least.
SHORTEST, LONGEST, LEAST_ROWS = 3, 10, 4
#: Lower end of the interval, in standard errors; least weight of an entry.
ERRORS, LEAST_WEIGHT = 2.0, 0.8
#: Candidates for entries, and for exceptions, that travel to the driver.
MOST_ENTRIES = 100_000
FEATURES = 3

# Letters of other scripts that look like Latin ones, and signs used for letters.
_LOOKALIKES = str.maketrans(
    "аеорсухіјѕԁԛвнкмтһɡαορνικτυχεηıɑոսօհ",
    "aeopcyxijsdqbhkmthgaopviktuxenianuoh",
)
_SIGNS = str.maketrans("013457@$!|8", "oieastasiib")
_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")
_SIGN_RUN = re.compile(r"(?<=[^\W\d_])[013457@$!|8]+(?=[^\W\d_])|(?<![\w@$])[01345@$78](?=[^\W\d_][013457@$!|8]*[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")
_NARROW = re.compile("[^\x00-ɏ]")


def fold(text: str) -> str:
    """Lower-cased, without disguises; letters of the Latin alphabets keep their accents."""
    if _NARROW.search(text):
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).lower().translate(_LOOKALIKES)
    elif "­" in text:
        text = text.replace("­", "").lower()
    else:
        text = text.lower()
    return _SIGN_RUN.sub(lambda m: m[0].translate(_SIGNS), text)


def beginnings(text: str) -> set[str]:
    """The entries that a folded text could match."""
    out: set[str] = set()
    for w in set(_WORD.findall(text)):
        out.update(w[:n] for n in range(SHORTEST, min(len(w), LONGEST) + 1))
    return out


def contexts(text: str, found: ahocorasick.Automaton | None) -> set[str]:
    """The two-word phrases of a folded text in which an entry begins a word."""
    starts = {end - length + 1 for end, (length, weight) in found.iter(text) if weight} if found is not None else ()
    if not starts:
        return set()
    ws = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    out: set[str] = set()
    for i, (begin, _) in enumerate(ws):
        if begin in starts:
            out.update(text[ws[j][0] : ws[j + 1][1]] for j in (i - 1, i) if 0 <= j < len(ws) - 1 and ws[j + 1][0] - ws[j][1] == 1)
    return out


def _counted(entries_of):
    """Rows kind (2 * half + label), text to rows entry and in how many texts of each kind it is, as far as a task has counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter() for _ in range(4)]

        def out() -> Iterator[pa.RecordBatch]:
            entries = list(set().union(*counts))
            for i in range(0, len(entries), 100_000):
                part = entries[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([c[e] for e in part], pa.int64()) for c in counts)], names=["entry", "c0", "t0", "c1", "t1"])
            for c in counts:
                c.clear()

        entries_in = entries_of()
        for b in pieces(batches, "text"):
            for kind, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[kind].update(entries_in(fold(text)))
                if sum(map(len, counts)) > 300_000:
                    yield from out()
        yield from out()

    return run


def _log_odds(a: int, b: int, of_a: int, of_b: int) -> float:
    """Lower end of the interval of the log odds of a in of_a rows against b in of_b."""
    odds = np.log((a + 0.5) / (of_a - a + 0.5)) - np.log((b + 0.5) / (of_b - b + 0.5))
    error = np.sqrt(1 / (a + 0.5) + 1 / (of_a - a + 0.5) + 1 / (b + 0.5) + 1 / (of_b - b + 0.5))
    return float(odds - ERRORS * error)


def weights(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """The lexicon: an entry is left out if a beginning of it weighs about as much."""
    weighed = {entry: _log_odds(t, c, toxic, clean) for entry, t, c in counts}
    out: dict[str, float] = {}
    for entry in sorted(weighed, key=len):
        before = max((out[entry[:n]] for n in range(SHORTEST, len(entry)) if entry[:n] in out), default=0.0)
        if weighed[entry] >= LEAST_WEIGHT and weighed[entry] > before + 0.5:
            out[entry] = weighed[entry]
    return out


def exceptions_of(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> tuple[str, ...]:
    """The phrases that speak for a clean row as an entry does for a toxic one."""
    return tuple(sorted(phrase for phrase, t, c in counts if _log_odds(c, t, clean, toxic) >= LEAST_WEIGHT))


def automaton(lexicon: dict[str, float], exceptions: tuple[str, ...] = ()) -> ahocorasick.Automaton | None:
    found = ahocorasick.Automaton()
    for entry, weight in lexicon.items():
        found.add_word(entry, (len(entry), weight))
    for phrase in exceptions:
        if folded := fold(phrase):
            found.add_word(folded, (len(folded), 0.0))
    if not len(found):
        return None
    found.make_automaton()
    return found


def matched(text: str, found: ahocorasick.Automaton | None) -> tuple[float, int]:
    """The weight and the number of words of a folded text that match; of several entries of a word the heaviest counts."""
    best: dict[int, float] = {}
    covered: list[tuple[int, int]] = []
    for end, (length, weight) in found.iter(text) if found is not None else ():
        start = end - length + 1
        if start and text[start - 1].isalpha():
            continue
        if weight:
            if weight > best.get(start, 0.0):
                best[start] = weight
        elif end + 1 == len(text) or not text[end + 1].isalpha():
            covered.append((start, end))
    if covered:
        ends: list[int] = []  # of stretches covered without a gap, and where they begin
        begins: list[int] = []
        for a, b in sorted(covered):
            if ends and a <= ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                begins.append(a)
                ends.append(b)
        best = {s: w for s, w in best.items() if not ((k := bisect_right(begins, s)) and s <= ends[k - 1])}
    return sum(best.values()), len(best)


def features(weight: np.ndarray, hits: np.ndarray, length: np.ndarray) -> np.ndarray:
    share = weight / np.maximum(length, 20) * 1000
    return np.column_stack([np.log1p(weight), np.log1p(share), np.log1p(hits)])


def _measured(lexicon: dict[str, float], exceptions: tuple[str, ...]):
    """Rows id, text to rows id, weight, hits, length (in code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(lexicon, exceptions)
        for b in pieces(batches, "text"):
            texts = b.column(1).to_pylist()
            sums = [matched(fold(t), found) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in sums], pa.float64()), pa.array([n for _, n in sums], pa.int64()), pa.array(map(len, texts), pa.int64())], names=["id", "weight", "hits", "length"])

    return run


def train(docs: DataFrame, labels: DataFrame, fold_by: tuple[int, int] = FOLD, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS, exceptions: tuple[str, ...] = ()) -> dict:
    """lexicon, exceptions (those given and those learned), calibration."""
    sample, totals = fit.labelled_texts(docs, labels, label, *fold_by, sample_rows, id_col, text_col)
    sample = materialise(sample)
    # copies count once, else what one text says many times would look like a rule
    first = materialise(sample.groupBy("half", "label", F.xxhash64("text").alias("same")).agg(F.first("text").alias("text")).select(F.expr("2 * half + label").cast("int").alias("kind"), "text"))
    seen = {r["kind"]: r["n"] for r in first.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    toxic, clean = ([seen.get(2 * h + k, 0) for h in (0, 1)] for k in (1, 0))
    if not sum(toxic) or not sum(clean):
        everything = sum(totals.values())
        return {"lexicon": {}, "exceptions": exceptions, "calibration": fit.constant(totals.get(1, 0) / everything if everything else 0.5, FEATURES)}

    def counted(entries_of, of: str, against: str, sizes: tuple[int, int]) -> list:
        """Entries in LEAST_ROWS rows of one label and twice as frequent there as in those of the other."""
        counts = first.mapInArrow(_counted(entries_of), "entry string, c0 long, t0 long, c1 long, t1 long").groupBy("entry").agg(*(F.sum(c).alias(c) for c in ("t0", "t1", "c0", "c1")))
        most = F.expr(f"{of}0 + {of}1")
        counts = counts.where((most >= LEAST_ROWS) & (most * sizes[1] > 2 * F.expr(f"{against}0 + {against}1") * sizes[0]))
        return counts.orderBy(most.desc(), "entry").limit(MOST_ENTRIES).collect()

    counts = counted(lambda: beginnings, "t", "c", (sum(toxic), sum(clean)))
    lexicon = weights([(r["entry"], r["t0"] + r["t1"], r["c0"] + r["c1"]) for r in counts], sum(toxic), sum(clean))

    def phrases_of():
        found = automaton(lexicon)
        return lambda text: contexts(text, found)

    phrases = counted(phrases_of, "c", "t", (sum(clean), sum(toxic))) if lexicon else []
    xs, ys = [], []
    for h in (0, 1):  # each half is measured with the other's lexicon and exceptions
        o = 1 - h
        partial = weights([(r["entry"], r[f"t{o}"], r[f"c{o}"]) for r in counts if r[f"t{o}"]], toxic[o], clean[o])
        but = exceptions + exceptions_of([(r["entry"], r[f"t{o}"], r[f"c{o}"]) for r in phrases if r[f"c{o}"]], toxic[o], clean[o])
        rest = sample.where(F.col("half") == h).select(F.col("label").cast("long").alias("id"), "text").mapInArrow(_measured(partial, but), "id long, weight double, hits long, length long").toPandas()
        xs.append(features(*(rest[c].to_numpy() for c in ("weight", "hits", "length"))))
        ys.append(rest["id"].to_numpy())
    discard(sample, first)
    learned = exceptions_of([(r["entry"], r["t0"] + r["t1"], r["c0"] + r["c1"]) for r in phrases], sum(toxic), sum(clean))
    return {"lexicon": lexicon, "exceptions": exceptions + learned, "calibration": fit.calibrate(np.concatenate(xs), np.concatenate(ys), totals)}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, weight, hits of every row's whole text."""
    kind = docs.schema[id_col].dataType.simpleString()
    calibration, measure = model["calibration"], _measured(model["lexicon"], model["exceptions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in measure(batches):
            p = fit.probability(calibration, features(*(b.column(i).to_numpy() for i in (1, 2, 3)))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), b.column(1), b.column(2)], names=["id", "score", "weight", "hits"])

    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double, weight double, hits long")


def drop_toxic(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows of docs that score under one half."""
    calibration, measure = model["calibration"], _measured(model["lexicon"], model["exceptions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text_col):
            texts = b.column(b.schema.get_field_index(text_col)).fill_null("")
            for m in measure(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(b.num_rows)), texts], names=["id", "text"])])):
                p = fit.probability(calibration, features(*(m.column(i).to_numpy() for i in (1, 2, 3)))) if m.num_rows else np.zeros(0)
                at = m.column(0).to_numpy()
                yield b.take(pa.array(at[p < 0.5]))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return fit.scored(score(docs, train(docs, labels)), *FOLD)
