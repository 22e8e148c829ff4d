"""Quality by co-training: a text-content view and a page-metadata view teach each other.

Each view has its own logistic model.  The content view sees the text only; the metadata
view sees origin, language and the declared size, never the text.  In every round both
views score all unlabelled pages and each hands the ones it is surest of, with their
pseudo-labels, to the other view's training set.  At the end each view is calibrated on
labelled rows kept aside, and a two-input logistic model over both combines them.  Texts are
read once to make a small table of figures; the rounds scan that table.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import cut, field, lean, ship, stored

ship(__name__)

#: Bound of the sample of labelled rows that training reads.
LABELLED = 8000
#: Rounds, pseudo-labels that a view hands over in each, the greatest doubt about one of them.
ROUNDS, EXCHANGED, DOUBT = 4, 200, 0.05
THRESHOLD = 0.5
CONTENT, BUCKETS = 21, 24
META = 3 + 2 * BUCKETS
SCORES = "doc_id long, content_score double, metadata_score double, score double, kept boolean"
# Characters counted by the content view, and frequent short words of the four languages.
SYMBOLS, STOPS, DIGITS = "#*$%&|<>{}[]=_~^\\@", ".,;:?!", "0123456789"
FUNCTION_WORDS = frozenset("the of and to in is that with for was der die und den von zu mit ist nicht ein le la les des est que un une dans pour el los las una por con para".split())


def content(text: str) -> list[float]:
    """Figures of the words and lines of a text alone."""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    pairs = len(set(zip(words, words[1:])))
    upper = sum(map(str.isupper, words))
    count = lambda letters: sum(map(text.count, letters))
    symbols, marks = count(SYMBOLS), count(STOPS)
    lines = text.split("\n")
    lengths = list(map(len, lines))
    raw = text.encode("utf-8", "surrogatepass")
    return [
        np.log1p(len(words)), min(20.0, sum(map(len, words)) / n), len(set(words)) / n, pairs / max(1, n - 1), upper / n, min(5.0, symbols / n), min(5.0, marks / n),
        min(5.0, text.count("!") / n), min(5.0, text.count("|") / n), count(DIGITS) / size, sum(map(FUNCTION_WORDS.__contains__, map(str.lower, words))) / n,
        sum(map(str.istitle, words)) / n, float(upper / n > 0.3), float(symbols / n > 0.2), np.log1p(len(text)), np.log1p(len(lines)),
        np.log1p(sum(lengths) / len(lines)), np.log1p(max(lengths)), len(set(lines)) / len(lines), len(text.encode("ascii", "ignore")) / size, min(3.0, len(zlib.compress(raw, 1)) / size),
    ]


def metadata(lang: str | None, source: str | None, n_chars: float | None) -> list[float]:
    """Figures of a page known without its text: origin, language and declared size."""
    unknown = n_chars is None or n_chars != n_chars
    bucket = np.zeros(2 * BUCKETS)
    bucket[zlib.crc32((source or "").encode("utf-8", "surrogatepass")) % BUCKETS] = 1
    bucket[BUCKETS + zlib.crc32((lang or "").encode("utf-8", "surrogatepass")) % BUCKETS] = 1
    return [0.0 if unknown else np.log1p(max(0.0, float(n_chars))), float(unknown), float(lang is None), *bucket]


@dataclass
class Logistic:
    """Ridge logistic regression on standardised columns, fitted by Newton steps."""

    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> Logistic:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        model = cls(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(x.shape[1] + 1))
        z = model._design(x)
        penalty = ridge * np.eye(z.shape[1])
        penalty[0, 0] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ model.beta, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ model.beta)
            model.beta = model.beta + step
            if np.abs(step).max() < 1e-6:
                break
        return model

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), np.clip((x - self.mean) / self.scale, -8, 8)])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._design(x) @ self.beta, -30, 30)

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


@dataclass
class CoTrained:
    """Both views, their calibrations, and the model that combines them."""

    views: list[Logistic]
    calibrations: list[Logistic]
    combined: Logistic

    def scores(self, content_x: np.ndarray, metadata_x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        logits = [v.logit(x) for v, x in zip(self.views, (content_x, metadata_x), strict=True)]
        calibrated = [c.logit(z[:, None]) for c, z in zip(self.calibrations, logits, strict=True)]
        return (*(1 / (1 + np.exp(-z)) for z in calibrated), self.combined.chance(np.column_stack(calibrated)))


#: Sure rows of each view: its features for the other view, and the pseudo-labels.
Handed = list[tuple[np.ndarray, np.ndarray]]


def surest(models: list[Logistic], views: list[np.ndarray], order: np.ndarray, quota: tuple[int, int], free: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """View, label, rows and doubt: at most ``quota[label]`` free rows of each, the least doubtful first, ties by ``order``."""
    for view, (model, x) in enumerate(zip(models, views, strict=True)):
        chance = model.chance(x).round(9)  # last digits depend on how rows are batched
        for label, doubt in ((0, chance), (1, 1 - chance)):
            rows = np.flatnonzero(free & (doubt <= DOUBT))
            rows = rows[np.lexsort((order[rows], doubt[rows]))][: quota[label]]
            yield view, label, rows, doubt[rows]


def co_train(views: list[np.ndarray], y: np.ndarray, ask: Callable[[list[Logistic], tuple[int, int]], Handed], rounds: int = ROUNDS, exchanged: int = EXCHANGED) -> CoTrained:
    """Train on three quarters of the labelled rows and the rows handed over; calibrate on the rest.

    ``ask(models, quota)`` returns, for each view, what it hands to the other one.
    """
    aside = np.arange(len(y)) % 4 == 3
    if len({*y[aside]}) < 2 or len({*y[~aside]}) < 2:
        aside = np.zeros(len(y), dtype=bool)
    check = aside if aside.any() else ~aside
    sets = [[v[~aside], y[~aside]] for v in views]
    good = round(exchanged * y[~aside].mean())
    models = [Logistic.fit(*s) for s in sets]
    for _ in range(rounds):
        handed = ask(models, (exchanged - good, good))
        if not any(len(labels) for _, labels in handed):
            break
        for taught, (rows, labels) in zip((1, 0), handed, strict=True):
            sets[taught] = [np.concatenate([sets[taught][0], rows]), np.concatenate([sets[taught][1], labels])]
        models = [Logistic.fit(*s) for s in sets]
    logits = [m.logit(v[check]) for m, v in zip(models, views, strict=True)]
    calibrations = [Logistic.fit(z[:, None], y[check]) for z in logits]
    both = np.column_stack([c.logit(z[:, None]) for c, z in zip(calibrations, logits, strict=True)])
    return CoTrained(models, calibrations, Logistic.fit(both, y[check]))


FIGURES = "doc_id long, lang string, source string, n_chars long, content array<double>"


def _stack(figures: pd.DataFrame) -> list[np.ndarray]:
    meta = [metadata(*r) for r in zip(figures["lang"], figures["source"], figures["n_chars"].astype(float), strict=True)]
    return [np.array(figures["content"].tolist(), dtype=float).reshape(-1, CONTENT), np.array(meta, dtype=float).reshape(-1, META)]


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 1000):
            part = batch.iloc[at : at + 1000]
            yield part.assign(doc_id=part["doc_id"].astype("Int64"), n_chars=part["n_chars"].astype("Int64"), content=[content(t or "") for t in part["text"]]).drop(columns="text")


def figures(docs: DataFrame) -> DataFrame:
    """Figures of every row, written to the shared folder: metadata as given and numbers of the text."""
    pages = docs.select(*[field(docs, n, k).alias(n) for n, k in (("doc_id", "long"), ("lang", "string"), ("source", "string"), ("n_chars", "long"), ("text", "string"))])
    return stored(pages.mapInPandas(lean(_measure), FIGURES), "figures")


def _handing(unlabelled: DataFrame) -> Callable[[list[Logistic], tuple[int, int]], Handed]:
    """Lets both views score all unlabelled pages and keeps the surest ones; a page is handed over once."""
    taken: set[int] = set()
    shape = "view int, label int, doubt double, doc_id long, turn long, lang string, source string, n_chars long, content array<double>"

    def ask(models: list[Logistic], quota: tuple[int, int]) -> Handed:
        gone = frozenset(taken)  # at most 2 * ROUNDS * EXCHANGED ids

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                free = ~batch["doc_id"].isin(gone).to_numpy()
                for view, label, rows, doubt in surest(models, _stack(batch), batch["turn"].to_numpy(), quota, free):
                    yield batch.iloc[rows].assign(view=view, label=label, doubt=doubt, n_chars=batch["n_chars"].iloc[rows].astype("Int64"))

        first = F.row_number().over(W.partitionBy("view", "label").orderBy("doubt", "turn", "doc_id"))
        chosen = unlabelled.mapInPandas(lean(best), shape).withColumn("_n", first).where((F.col("_n") <= max(quota)) & (F.col("_n") <= F.when(F.col("label") == 1, quota[1]).otherwise(quota[0])))
        rows = chosen.toPandas().sort_values(["view", "label", "_n"], ignore_index=True)
        taken.update(map(int, rows["doc_id"]))
        handed = []
        for view in (0, 1):
            part = rows[rows["view"] == view]
            handed.append((_stack(part)[1 - view], part["label"].to_numpy(dtype=float)))
        return handed

    return ask


def train(rows: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> CoTrained | None:
    """Co-train on figures: at most ``labelled`` labelled ids, the first in hash order, and all other pages as unlabelled ones.

    None where the labels hold fewer than two classes.  Rows whose label is not 0 or 1 count as unlabelled.
    An id that many rows share is one page, the row first in the order of its columns.
    """
    known = labels.select(field(labels, "doc_id", "long").alias("doc_id"), field(labels, "quality", "int").alias("quality")).where("quality in (0, 1) and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))  # an id with both labels is bad
    some = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled))
    once = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("content", "lang", "source", "n_chars")).alias("page")).select("doc_id", "page.*")
    pages = stored(once.join(F.broadcast(some), "doc_id", "left").withColumn("turn", F.xxhash64("doc_id")), "once")
    seen = pages.where("quality is not null").toPandas().sort_values("doc_id", kind="stable")
    if seen["quality"].nunique() < 2:
        return None
    return co_train(_stack(seen), seen["quality"].to_numpy(dtype=float), _handing(pages.where("quality is null").drop("quality")), rounds)


def _score(model: CoTrained | None, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = model.scores(*_stack(batch)) if model else [np.ones(len(batch))] * 3
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "content_score": found[0], "metadata_score": found[1], "score": found[2], "kept": found[2] >= threshold})

    return run


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The quality of every row: doc_id, content_score, metadata_score, score, kept.

    One row per input row.  Null text counts as empty; null lang, source and n_chars have
    values of their own.  Without labels of both classes every score is 1 and all is kept.
    Repeated rows get equal scores.
    """
    rows = figures(docs)
    return rows.mapInPandas(_score(train(rows, labels), threshold), SCORES)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier keeps, with all their columns, without a shuffle."""
    model = train(figures(docs), labels)

    @F.pandas_udf("double")
    def chance(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.Series:
        batch = pd.DataFrame({"content": [content(t or "") for t in text], "lang": lang, "source": source, "n_chars": n_chars})
        return pd.Series(model.scores(*_stack(batch))[2] if model else np.ones(len(batch)))

    return docs.where(chance(*[field(docs, n, k) for n, k in (("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "long"))]) >= threshold)
