"""Problem 8: the reading level of each text, in its own language.

Words have an acquisition grade: the mean level of the distribution over levels in which graded texts use them, each level's
texts weighing the same. A text's level is predicted from quantiles of the grades of its known words: for each step between
levels, a logistic calibration fitted on graded texts maps the quantiles to the probability that the text lies above it. The
score is 1 plus these probabilities, the level 1 plus the number that are at least a half. Words that are not known in the
language are left out.

A text's language is told by words whose use differs most between the languages. Which these are is learned from the written
labels of the same texts: word frequencies by label, then by the language they tell, so that wrong labels lose their weight.

The model is fitted on a bounded sample of graded texts (at most MAX_LABELLED, those of the least hashed ids), so it fits
in the driver. The calibration sees each graded text with word grades that come from
other texts (folds), since a text's own label would make its rare words look too telling. Every text is then graded
where it is read, whole, in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import TOPIC_SOURCES, canonical
from ..runtime import table

MAX_LABELLED = 20_000
LEVELS = 4
QUANTILES = tuple(range(5, 100, 5))
LEAST = 3  # graded texts that must use a word; 1 to 5 grade held-out texts alike
FOLDS = 5
CODE_SOURCES = tuple(source for source, prefix in TOPIC_SOURCES.items() if prefix == "code:")  # the sources whose topics are programming languages
LEAST_SHARE = 0.01  # of the texts: written labels that are rarer are no language of the model
TELLING = 300  # words of each language that tell it
ROUNDS = 3
MARGIN = 2.0  # log odds from which the words overrule the written label

_BROKEN = re.compile(r"(?<=\w)[-­‐]\s*\n\s*(?=\w)")
_TAG = re.compile(r"<[^<>\n]{1,200}>")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(_BROKEN.sub("", _TAG.sub(" ", text)).lower())


@dataclass
class Languages:
    """The languages of a corpus and the words that tell them: for each word the log of its frequency in texts of each language."""

    names: list[str] = field(default_factory=list)
    place: dict[str, int] = field(default_factory=dict)
    logs: np.ndarray | None = None

    def odds(self, counts: dict[str, int]) -> np.ndarray | None:
        """Log likelihood of each language, by which telling words a text has; null if it has none."""
        found = [k for k in map(self.place.get, counts) if k is not None]
        return self.logs[found].sum(axis=0) if found else None

    def of(self, counts: dict[str, int], written: str | None) -> str:
        """The likeliest language; the written label where the words don't tell, ``und`` where there is none either."""
        odds = self.odds(counts) if len(self.names) > 1 else None
        if odds is None:
            return written or "und"
        first, second = np.sort(odds)[::-1][:2]
        return self.names[int(np.argmax(odds))] if first - second >= MARGIN or written not in self.names else written


def fit_languages(texts: list[tuple[str | None, dict[str, int]]]) -> Languages:
    """From texts with written labels, of which some may be wrong or missing."""
    labels = Counter(written for written, _ in texts if written and written != "und")
    names = sorted(name for name, n in labels.items() if n >= LEAST_SHARE * labels.total())
    if len(names) < 2:
        return Languages(names)
    told: list[str | None] = [written if written in names else None for written, _ in texts]
    model = Languages(names)
    for _ in range(ROUNDS):
        place = {name: k for k, name in enumerate(names)}
        uses, sizes = defaultdict(lambda: np.zeros(len(names))), np.zeros(len(names))
        for name, (_, counts) in zip(told, texts):
            if name in place:
                sizes[place[name]] += 1
                for w in counts:
                    uses[w][place[name]] += 1
        vocabulary = [w for w, v in uses.items() if v.sum() >= LEAST]
        chance = (np.array([uses[w] for w in vocabulary]).reshape(-1, len(names)) + 0.5) / (sizes + 1)
        others = (chance.sum(axis=1, keepdims=True) - chance) / max(1, len(names) - 1)
        telling = chance * np.log(chance / others) if len(names) > 1 else chance  # how often, times how clearly
        chosen = sorted(set(np.argsort(-telling, axis=0, kind="stable")[:TELLING].ravel().tolist()))
        model = Languages(names, {vocabulary[k]: i for i, k in enumerate(chosen)}, np.log(chance[chosen]))
        found = [model.odds(counts) for _, counts in texts]
        told = [name if odds is None else names[int(np.argmax(odds))] for name, odds in zip(told, found)]
        names = [name for name, n in sorted(Counter(told).items(), key=str) if name is not None and n >= LEAST_SHARE * len(texts)]
    return model


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression for targets in 0 .. 1, by Newton steps."""
    weights = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        curve = p * (1 - p) + 1e-6
        hessian = (x * curve[:, None]).T @ x + penalty * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, x.T @ (y - p) - penalty * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    return weights


@dataclass
class Model:
    grades: dict[str, dict[str, float]] = field(default_factory=dict)  # language -> word -> grade
    middle: np.ndarray | None = None
    spread: np.ndarray | None = None
    weights: np.ndarray | None = None  # a row for each step between levels
    languages: Languages = field(default_factory=Languages)

    def known(self, name: str, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        table_, grades, often = self.grades.get(name, {}), [], []
        for w, n in counts.items():
            g = table_.get(w)
            if g is not None:
                grades.append(g), often.append(n)
        return np.array(grades), np.array(often)

    def features(self, name: str, counts: dict[str, int]) -> np.ndarray | None:
        grades, often = self.known(name, counts)
        if not len(grades):
            return None
        order = np.argsort(grades, kind="stable")
        grades, often = grades[order], often[order]
        ends = np.cumsum(often)
        at = np.searchsorted(ends, np.array(QUANTILES) / 100 * ends[-1])
        return np.concatenate((grades[at], [float((grades * often).sum() / ends[-1])]))

    def steps(self, name: str, counts: dict[str, int]) -> np.ndarray | None:
        """The probabilities that the text lies above level 1, 2, ...; null if no word is known."""
        x = self.features(name, counts) if self.weights is not None else None
        if x is None:
            return None
        z = np.append((x - self.middle) / self.spread, 1.0)
        return 1 / (1 + np.exp(-np.clip(self.weights @ z, -30, 30)))


def _grades(texts: list[tuple[str, list[float], dict[str, int]]]) -> dict[str, dict[str, float]]:
    """Acquisition grades of words from graded texts (language, share of the raters per level, word counts)."""
    uses: dict[str, dict[str, np.ndarray]] = defaultdict(dict)
    texts_of: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(LEVELS))
    for name, raters, counts in texts:
        share = np.array(raters)
        texts_of[name] += share
        own = uses[name]
        for w in counts:
            have = own.get(w)
            own[w] = share.copy() if have is None else have + share
    out: dict[str, dict[str, float]] = {}
    steps = np.arange(1, LEVELS + 1)
    for name, own in uses.items():
        size = np.maximum(texts_of[name], 1)
        prior = 0.5 / size.mean()
        out[name] = {}
        for w, v in own.items():
            if v.sum() >= LEAST:
                p = v / size + prior / 2
                out[name][w] = float((p * steps).sum() / p.sum())
    return out


def fit(written: list[tuple[str | None, list[float], dict[str, int]]]) -> Model:
    """The model of graded texts (written label, share of the raters per level, word counts); folds are dealt by position.
    Without usable texts the model knows no word."""
    model = Model(languages=fit_languages([(label, counts) for label, _, counts in written]))
    texts = [(model.languages.of(counts, label), raters, counts) for label, raters, counts in written]
    rows, wanted = [], []
    for fold in range(FOLDS):
        part = Model(grades=_grades([t for i, t in enumerate(texts) if i % FOLDS != fold]))
        for name, raters, counts in texts[fold::FOLDS]:
            x = part.features(name, counts)
            if x is not None:
                rows.append(x), wanted.append([sum(raters[k:]) for k in range(1, LEVELS)])
    model.grades = _grades(texts)
    if rows:
        x, y = np.array(rows), np.array(wanted)
        model.middle, model.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.column_stack(((x - model.middle) / model.spread, np.ones(len(x))))
        model.weights = np.array([logistic(z, y[:, k]) for k in range(LEVELS - 1)])
    return model


def graded_texts(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> list[tuple[str | None, list[float], dict[str, int]]]:
    """At most ``bound`` graded texts, for the driver: written label, share of the raters per level, word counts. Labels outside 1 .. LEVELS are ignored."""
    fair = labels.where(F.col("reading_level").between(1, LEVELS) & F.col("doc_id").isNotNull())
    by_doc = fair.groupBy("doc_id").agg(F.array(*[F.count_if(F.col("reading_level") == k) / F.count("*") for k in range(1, LEVELS + 1)]).alias("levels"))
    chosen = by_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, numbers = [], []
            for text in batch.column("text").to_pylist():
                counts = Counter(words(text))
                lists.append(list(counts)), numbers.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("levels"), batch.column("written"), pa.array(lists, pa.list_(pa.string())), pa.array(numbers, pa.list_(pa.int32()))],
                names=["doc_id", "levels", "written", "words", "counts"],
            )

    # the join keeps few texts: the chosen ids go to the texts, not the texts through a shuffle (at most ``bound`` ids)
    texts = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "levels", "text", "written")
    counted = texts.mapInArrow(count, "doc_id long, levels array<double>, written string, words array<string>, counts array<int>")
    found, same = [], {}
    for batch in counted.toArrow().sort_by("doc_id").to_batches(max_chunksize=500):
        for r in batch.to_pylist():
            if r["words"]:  # each word is one string, however many texts have it
                found.append((r["written"], r["levels"], {same.setdefault(w, w): n for w, n in zip(r["words"], r["counts"])}))
    return found


def graded(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep``, ``language``, ``score`` and ``level`` of every text; null where no word of it is known."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("language", "string").add("score", "double").add("level", "integer")

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            names, scores, levels = [], [], []
            for text, written in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist()):
                counts = Counter(words(text))
                name = model.languages.of(counts, written)
                steps = model.steps(name, counts)
                names.append(name)
                scores.append(None if steps is None else float(1 + steps.sum()))
                levels.append(None if steps is None else int(1 + (steps >= 0.5).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(levels, pa.int32())], names=schema.names)

    return docs.select(*keep, "text", "written").mapInArrow(grade, schema)


def running_text(documents: DataFrame, catalog: DataFrame) -> DataFrame:
    """Documents of running text: not program code, not null or blank; canonical source; ``written``, the language label."""
    from .budget import language

    filled = documents.where("text is not null").where(~F.col("text").rlike(r"(?U)\A\s*\z"))
    named = canonical(filled.select("doc_id", "source", "topic", "lang", "text"), catalog, vigintile=None)
    prose = named.where(F.coalesce(~F.col("source").isin(*CODE_SOURCES), F.lit(True)))
    return prose.withColumn("written", language(F.col("lang")))


def _levels(spark: SparkSession, folder: str) -> DataFrame:
    docs = running_text(table(spark, folder, "documents", spread=True), table(spark, folder, "doc_counts"))
    model = fit(graded_texts(docs, table(spark, folder, "level_labels")))
    return graded(docs, model, ["doc_id", "source"])


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(spark, folder).where(f"level = {LEVELS}").select("doc_id")


def p8_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Language, score and level of every document of running text."""
    return _levels(spark, folder).withColumn("score", F.round("score", 4))


def p8_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and their share per source, language and level."""
    counted = _levels(spark, folder).groupBy("source", "language", "level").agg(F.count("*").alias("n_docs"), F.round(F.avg("score"), 4).alias("mean_score"))
    whole = counted.groupBy("source", "language").agg(F.sum("n_docs").alias("of"))
    return counted.join(whole, ["source", "language"]).withColumn("share", F.round(F.col("n_docs") / F.col("of"), 6)).drop("of")
