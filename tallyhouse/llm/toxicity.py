"""Toxicity by gradient-boosted trees over dense text features, with isotonic calibration.

Features: densities of a seed lexicon and of a lexicon learned from the labels, closeness of such words to the second
person, capitals, punctuation and obfuscation. Lexicon, trees and calibration are fitted on a bounded sample of labelled
rows; every whole text is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import documents, staged

#: Common insults, and second-person words of the languages of the corpus.
SEED_WORDS = ("bastard", "clown", "disgusting", "dumb", "fool", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "scum", "shut up", "stupid", "trash", "ugly", "vermin", "worthless")
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "euch", "ihr", "tu", "toi", "te", "ton", "vous", "votre", "tú", "ti", "usted", "ustedes", "vosotros")

FEATURES = [
    "seed_count", "seed_density", "learned_count", "learned_density", "learned_terms", "disguised_count", "near_person", "person_density",
    "capital_rate", "capital_words", "exclamations", "questions", "punctuation", "obfuscation", "stretched", "words",
]

_LEET = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"})
_GAPS = re.compile(r"[\W_]+")
_MIXED = re.compile(rb"[A-Za-z]+[@$*!0-9]+(?=[A-Za-z])")
_LOUD = re.compile(rb"\b[A-Z]{3,}\b")
_STRETCH = re.compile(rb"([A-Za-z])\1\1")
NEAR = 60


def _automaton(terms: list[str]) -> ahocorasick.Automaton | None:
    if not terms:
        return None
    found = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        found.add_word(f" {t}", i)
    found.make_automaton()
    return found


class Features:
    """Feature rows of texts under a lexicon of word beginnings."""

    def __init__(self, lexicon: list[str]):
        self.seed, self.learned = _automaton(list(SEED_WORDS)), _automaton(lexicon)
        self.person = _automaton([f"{w} " for w in SECOND_PERSON])

    def row(self, data: bytes) -> list[float]:
        text = data.decode()
        plain = f" {_GAPS.sub(' ', text.lower())} "
        words = max(1, plain.count(" ") - 1)
        seed = [at for at, _ in self.seed.iter(plain)]
        hits = list(self.learned.iter(plain)) if self.learned else []
        person = np.array([at for at, _ in self.person.iter(plain)])
        places = np.array(sorted({*seed, *(at for at, _ in hits)}))
        near = 0
        if len(places) and len(person):
            right = np.searchsorted(person, places)
            gap = np.minimum(np.abs(person[np.minimum(right, len(person) - 1)] - places), np.abs(person[np.maximum(right - 1, 0)] - places))
            near = int((gap <= NEAR).sum())
        mixed = len(_MIXED.findall(data))
        disguised = 0
        if mixed:
            bare = f" {_GAPS.sub(' ', text.lower().translate(_LEET).replace('*', ''))} "
            disguised = max(0, sum(1 for a in (self.seed, self.learned) if a for _ in a.iter(bare)) - len(seed) - len(hits))
        count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        capitals, letters = int(count[65:91].sum()), int(count[65:91].sum() + count[97:123].sum())
        marks = int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum())
        size = max(1, len(data))
        per = 1000 / words
        return [
            np.log1p(len(seed)), len(seed) * per, np.log1p(len(hits)), len(hits) * per, np.log1p(len({i for _, i in hits})), np.log1p(disguised), np.log1p(near), len(person) * per,
            capitals / max(1, letters), len(_LOUD.findall(data)) * per, int(count[33]) * per, int(count[63]) * per, marks / size, mixed * per, len(_STRETCH.findall(data)) * per, np.log1p(words),
        ]


def _feature_batches(batches: Iterator[pa.RecordBatch], lexicons: list[list[str]], fold: bool) -> Iterator[pa.RecordBatch]:
    """The last column holds the text, or whole rows with a field text; with fold, the column before it tells which lexicon serves a row."""
    makers = [Features(x) for x in lexicons]
    for batch in batches:
        for at in range(0, len(batch), 1024):
            part = batch.slice(at, 1024)
            last = part.columns[-1]
            whole = pa.types.is_struct(last.type)
            passed = part.columns if whole else part.columns[:-1]
            which = part.columns[-2].to_pylist() if fold else [0] * len(part)
            texts = (last.field("text") if whole else last).cast(pa.binary())
            table = np.array([makers[w].row(t.as_py() or b"") for w, t in zip(which, texts, strict=True)], float).reshape(len(part), len(FEATURES))
            yield pa.RecordBatch.from_arrays([*passed, *(pa.array(table[:, i]) for i in range(len(FEATURES)))], names=[*part.schema.names[: len(passed)], *FEATURES])


def _passed(rows: DataFrame) -> list:
    fields = rows.schema.fields
    return fields if fields[-1].dataType.typeName() == "struct" else fields[:-1]


def features(rows: DataFrame, lexicons: list[list[str]], fold: bool = False) -> DataFrame:
    """rows with features after their columns. The last column is the text, which goes, or a struct of whole rows with a field text, which stays."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in _passed(rows)), *(f"{x} double" for x in FEATURES)])
    return rows.mapInArrow(partial(_feature_batches, lexicons=lexicons, fold=fold), schema)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, fold, toxic, clean): document counts of word beginnings, summed over a batch."""
    for batch in batches:
        seen: dict[tuple[str, int], list[int]] = {}
        for fold, toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            words = set(_GAPS.sub(" ", text.as_py().lower()).split())
            for term in {w[:n] for w in words for n in (4, 5, 6, 8, 12) if len(w) >= n} | {w for w in words if len(w) == 3}:
                seen.setdefault((term, fold), [0, 0])[0 if toxic else 1] += 1
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in seen]), pa.array([f for _, f in seen], pa.int32()), *(pa.array([c[i] for c in seen.values()], pa.int64()) for i in (0, 1))], names=["term", "fold", "toxic", "clean"])


def learn_lexicon(counts: DataFrame, toxic: int, clean: int, least: int, odds: float, size: int) -> list[str]:
    """The word beginnings most tied to the label: in at least least toxic rows, with that many times the odds of a clean row; size at most."""
    ratio = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1))
    rows = counts.where(F.col("toxic") >= least).withColumn("ratio", ratio).where(F.col("ratio") >= odds).orderBy(F.desc("toxic"), F.desc("ratio"), "term").limit(size).collect()
    chosen: set[str] = set()
    for term in sorted((r.term for r in rows), key=len):
        if not any(term[:n] in chosen for n in range(3, len(term))):
            chosen.add(term)
    return sorted(chosen)


class ToxicityModel:
    """Lexicon, trees and calibration."""

    def __init__(self, lexicon: list[str], trees=None, calibration=None, prior: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.prior = lexicon, trees, calibration, prior

    def score(self, rows: DataFrame) -> DataFrame:
        """rows with score. Their last column is the text, which goes, or a struct of whole rows with a field text, which stays.

        Calibrated scores are steps; a hundredth of the trees' own probability orders rows within a step.
        """
        table = features(rows, [self.lexicon])
        keep = [f"`{f.name}`" for f in _passed(rows)]
        if self.trees is None:
            return table.select(*keep, F.least(F.lit(0.99), F.lit(self.prior) + F.col("seed_density") / 100).alias("score"))
        raw = self.trees.transform(VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(table)).withColumn("_p", vector_to_array("_probability")[1])
        calibrated = self.calibration.setFeaturesCol("_p").setPredictionCol("_calibrated").transform(raw)
        return calibrated.select(*keep, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.99 * F.col("_calibrated") + 0.01 * F.col("_p"))).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, max_rows: int = 40_000, lexicon_size: int = 400, trees: int = 20, depth: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on the labelled rows for which usable (over doc_id) holds: all of them, or about max_rows chosen by a hash of the id.

    The lexicon is learned on two folds, and each fold's features use the lexicon of the other, so that the trees see
    words as new texts will show them. A quarter of the rows is held for the calibration. Rows without label or id are
    not used; of several labels of an id the largest holds. If one of the classes is missing there is nothing to learn,
    and scores rest on the seed lexicon alone.
    """
    known = labels.where(F.col(f"`{label_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("doc_id")).agg(F.max(f"`{label_col}`").alias("toxic")).where(F.col("doc_id").isNotNull() & usable)
    total = known.count()
    mix = lambda salt, n: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(n)).cast("int")
    if total > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 62)) < int((1 << 62) * max_rows / total))
    # max_rows bounds the labels that are left, so they go to the texts
    rows = documents(docs, id_col, text_col).join(F.broadcast(known), "doc_id").select("doc_id", "toxic", mix("fold", 2).alias("fold"), "text")
    sample = staged(rows, "labelled")
    sizes = {(r.fold, r.toxic): r["count"] for r in sample.groupBy("fold", "toxic").count().collect()}
    number = lambda toxic, *folds: sum(n for (f, t), n in sizes.items() if f in folds and (t > 0) == toxic)
    toxic, clean = number(True, 0, 1), number(False, 0, 1)
    if not toxic or not clean:
        return ToxicityModel([], prior=0.0)
    counts = staged(sample.select("fold", "toxic", "text").mapInArrow(_terms, "term string, fold int, toxic bigint, clean bigint").groupBy("term", "fold").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic > 0"), "terms")
    learn = lambda c, *folds: learn_lexicon(c, number(True, *folds), number(False, *folds), least=max(4, number(True, *folds) // 200), odds=10.0, size=lexicon_size)
    whole = learn(counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), 0, 1)
    others = [learn(counts.where("fold = 1"), 1), learn(counts.where("fold = 0"), 0)]
    table = staged(features(sample.select("doc_id", "toxic", "fold", "text"), others, fold=True), "features")
    table = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(table).withColumn("label", (F.col("toxic") > 0).cast("double")).withColumn("part", mix("calibration", 4))
    table = table.select("label", "part", "_features").cache()
    try:
        parts = {(r.part == 0, r.label): r["count"] for r in table.groupBy("part", "label").count().collect()}
        held = all(parts.get((c, y)) for c in (True, False) for y in (0.0, 1.0))
        kinds = {"featuresCol": "_features", "labelCol": "label", "predictionCol": "_prediction", "seed": 1}
        boosting = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, **kinds).setRawPredictionCol("_raw").setProbabilityCol("_probability")
        model = boosting.fit(table.where("part > 0") if held else table)
        scored = model.transform(table.where("part = 0") if held else table).select("label", vector_to_array("_probability")[1].alias("_p"))
        calibration = IsotonicRegression(featuresCol="_p", labelCol="label", predictionCol="_calibrated").fit(scored)
    finally:
        table.unpersist()
    return ToxicityModel(whole, model, calibration)


def scores(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """(doc_id, score) for every row of docs; null text is empty and scored like an empty one. An empty table gives no rows."""
    model = fit(docs, labels, usable, id_col=id_col, text_col=text_col, **limits)
    return model.score(documents(docs, id_col, text_col))
