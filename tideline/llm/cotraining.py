"""Quality classifier by co-training.

Two views of a document, each with a classifier of its own: the text, and metadata of the document and
of the web page it came from. Over some rounds each classifier scores every unlabelled document, and what
it is confident of is training data for the other. Both are then calibrated and combined by a logistic
model on held-out labels, and all documents are scored.

Features are made once, on the executors, and written as arrays of hashed tokens. A fit is one task over a
bounded sample, so that a round is a handful of jobs; scoring is a pass over the written arrays. Only the
models, two arrays of a fixed length, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, words

#: Labelled rows that are fitted on at most, taken by least hash of the id; a view gets no more pseudo-labels than that.
LABELLED = 20_000
#: Every so many-th labelled row is held out for calibration.
HELD_OUT = 5
ROUNDS = 2
CONFIDENT = 0.98
#: Hashed features of each view.
FEATURES = {"text": 1 << 16, "meta": 1 << 10}
OTHER = {"text": "meta", "meta": "text"}
RIDGE = 3e-5
STEPS = 60
#: Features that a step of a fit works on at a time.
PART = 1 << 18

Models = dict[str, np.ndarray]


def text_tokens(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits, word shapes, and how much of the text repeats."""
    shaped = F.coalesce(text, F.lit(""))
    for pattern, sign in (("[\\p{Ll}\\p{Lo}]+", "a"), ("\\p{Lu}+", "A"), ("\\p{N}+", "0")):
        shaped = F.regexp_replace(shaped, pattern, sign)
    runs = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")
    different = F.array_distinct(runs)
    shapes = F.transform(F.array_distinct(words(shaped)), lambda s: F.concat(F.lit("\t"), s))
    fresh = F.round(10 * F.size(different) / F.greatest(F.size(runs), F.lit(1))).cast("int").cast("string")
    length = F.floor(F.log2(F.size(runs) + 1)).cast("int").cast("string")
    return F.concat(different, shapes, F.array(F.concat_ws(":", F.lit("\tfresh"), length, fresh)))


def page_metadata(pages: DataFrame) -> DataFrame:
    """Metadata of the page that a document came from: its number is the last of the page's path."""
    number = F.regexp_extract("url", r"/([0-9]+)(?:\.html)?/?(?:[?#].*)?$", 1)
    page = pages.select(
        number.try_cast("bigint").alias("doc_id"),
        F.regexp_extract("url", r"^(\w+)://", 1).alias("scheme"),
        F.regexp_extract("url", r"^\w+://([^/]+)", 1).alias("host"),
        F.regexp_extract("url", r"[?#](\w+)", 1).alias("query"),
        F.floor(F.log2(F.length("html") + 1)).cast("string").alias("size"),
    )
    return page.where("doc_id is not null").groupBy("doc_id").agg(
        F.array(*[F.concat(F.lit(f"{c}="), F.coalesce(F.min(c), F.lit(""))) for c in ("scheme", "host", "query", "size")]).alias("page")
    )


def _hashed(tokens: Column, view: str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(FEATURES[view])).cast("int"))))


def _views(docs: DataFrame, pages: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, the hashed features ``text`` and ``meta``, and ``good``, null where the document has no label."""
    about = F.array(
        F.concat(F.lit("lang="), F.coalesce("lang", F.lit(""))),
        F.concat(F.lit("source="), F.coalesce("source", F.lit(""))),
        F.concat(F.lit("chars="), F.coalesce(F.floor(F.log2(F.col("n_chars") + 1)).cast("string"), F.lit(""))),
    )
    own = docs.select(F.col("doc_id").cast("long"), _hashed(text_tokens(F.col("text")), "text").alias("text"), about.alias("_about"))
    rows = own.join(pages, "doc_id", "left").join(known, "doc_id", "left")
    meta = F.concat("_about", F.coalesce("page", F.array().cast("array<string>")))
    return rows.select("doc_id", "text", _hashed(meta, "meta").alias("meta"), "good")


def _lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of an array column, and where those of each row end."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.concatenate([[0], np.cumsum(array.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return array.flatten().to_numpy(zero_copy_only=False), ends


def _logits(model: np.ndarray, features: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(model[features])])
    return sums[ends[1:]] - sums[ends[:-1]] + model[-1]


def _share(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def logistic(features: np.ndarray, ends: np.ndarray, good: np.ndarray, start: np.ndarray, ridge: float, steps: int) -> np.ndarray:
    """Weights, the intercept last, of a ridge-regularized logistic model over sparse binary rows (limited-memory BFGS)."""
    n = len(good)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], PART), "left"), [0, n]))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        total, slope = 0.0, np.zeros(len(w))
        for a, b in zip(cuts[:-1], cuts[1:]):  # some rows at a time bound the memory of a step
            own, to = features[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
            z = _logits(w, own, to)
            off = _share(z) - good[a:b]
            slope[:-1] += np.bincount(own, weights=np.repeat(off, np.diff(to)), minlength=len(w) - 1)
            slope[-1] += off.sum()
            total += np.logaddexp(0, np.where(good[a:b] > 0, -z, z)).sum()
        slope /= n
        slope[:-1] += ridge * w[:-1]
        return total / n + ridge / 2 * (w[:-1] ** 2).sum(), slope

    w = start
    value, slope = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        toward, alphas = slope.copy(), []
        for s, y in reversed(past):
            alphas.append(s @ toward / (y @ s))
            toward -= alphas[-1] * y
        toward *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 0.1 / max(np.sqrt(slope @ slope), 1e-9)
        for (s, y), alpha in zip(past, reversed(alphas)):
            toward += (alpha - y @ toward / (y @ s)) * s
        step = 1.0
        while step > 1e-6:
            after, after_slope = loss(w - step * toward)
            if after <= value - 1e-4 * step * (slope @ toward):
                break
            step /= 2
        else:
            break
        if (after_slope - slope) @ (-step * toward) > 1e-14:
            past = [*past[-7:], (-step * toward, after_slope - slope)]
        small = value - after < 1e-7 * max(value, 1e-9)
        w, value, slope = w - step * toward, after, after_slope
        if small:
            break
    return w


def calibrate(logits: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Weights, the intercept last, of a logistic model over a few columns of logits (Newton's method, slight ridge)."""
    x = np.column_stack([logits, np.ones(len(good))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _share(x @ w)
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w = w - np.linalg.solve(curve, x.T @ (p - good) + 1e-3 * w)
    return w


def _fit(sets: DataFrame, models: Models, ridge: float, steps: int) -> Models:
    """One model a view from ``sets`` (view, doc_id, features, good): a bounded group each, the last weights its start."""

    def run(group: pa.Table) -> pa.Table:
        view = group.column("view")[0].as_py()
        group = group.sort_by("doc_id")  # sums do not depend on how rows arrive
        made = logistic(*_lists(group.column("features")), group.column("good").to_numpy(), models[view], ridge, steps)
        return pa.table({"view": [view], "weights": pa.array([made], pa.list_(pa.float64()))})

    return {r["view"]: np.array(r["weights"]) for r in sets.groupBy("view").applyInArrow(run, "view string, weights array<double>").collect()}


def _confident(rows: DataFrame, models: Models, confident: float) -> DataFrame:
    """What each view is confident of: doc_id, the other ``view`` and the label for it."""
    least = float(np.log(confident / (1 - confident)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for view, other in OTHER.items():
                z = _logits(models[view], *_lists(batch.column(view)))
                sure = np.flatnonzero(np.abs(z) >= least)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(sure)), pa.array([other] * len(sure), pa.string()), pa.array((z[sure] > 0).astype(float))],
                    names=["doc_id", "view", "good"],
                )

    return rows.select("doc_id", *OTHER).mapInArrow(run, "doc_id bigint, view string, good double")


def classify(
    docs: DataFrame,
    labels: DataFrame,
    pages: DataFrame,
    labelled: int = LABELLED,
    rounds: int = ROUNDS,
    confident: float = CONFIDENT,
    ridge: float = RIDGE,
    steps: int = STEPS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, p_text and p_meta (each view alone), score and kept (score >= 0.5).

    ``labels`` has doc_id, quality and toxic (0 or 1); a document is good if its quality is 1 and it is
    not toxic. Fitting uses at most ``labelled`` labelled rows. In each round all documents without a
    label are scored by both views; of those that a view is at least ``confident`` of, the other view gets
    at most ``labelled``, by least hash of the id, good and bad ones in the proportion of the labels.
    All rows are scored in the end.

    Defined results: a null or empty text has no words and is scored on what is left; documents without a
    page are scored on their own metadata; null ids and labels of null are not fitted on; of repeated
    labels the least counts, and of rows with one id the one with the least features is fitted on; without
    labels of both kinds every score is null and every row kept; an empty table gives no rows; other
    columns are ignored. A task holds the features of its longest text.
    """
    known = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(F.expr("if(quality = 1 and coalesce(toxic, 0) = 0, 1.0D, 0.0D)")).alias("good"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    rows = staged(_views(docs, page_metadata(pages), known), "views")

    def one_each(some: DataFrame, *keys: str) -> DataFrame:
        """Features of the rows of ``some``, whose number is bounded: one row for each id."""
        found = rows.drop("good").join(F.broadcast(some), "doc_id").groupBy(*keys, *some.drop(*keys).columns)
        return found.agg(F.min(F.struct(*OTHER)).alias("_f")).select("*", "_f.*").drop("_f")

    some = staged(rows.where("good is not null").select("doc_id", "good").distinct().orderBy(*order).limit(labelled), "labelled")
    fit_on = one_each(some, "doc_id").withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(HELD_OUT)))
    fit_on = staged(fit_on, "fit-on")
    train = fit_on.where("fold > 0")
    kinds = {r["good"]: r["count"] for r in train.groupBy("good").count().collect()}  # two rows
    if len(kinds) < 2:
        none = F.lit(None).cast("double")
        return docs.select("doc_id", none.alias("p_text"), none.alias("p_meta"), none.alias("score"), F.lit(True).alias("kept"))

    def for_view(some: DataFrame, view: str) -> DataFrame:
        return some.select(F.lit(view).alias("view"), "doc_id", F.col(view).alias("features"), "good")

    own = reduce(DataFrame.unionByName, [for_view(train, view) for view in OTHER])
    models = _fit(own, {view: np.zeros(n + 1) for view, n in FEATURES.items()}, ridge, steps)
    for _ in range(rounds):
        said = staged(_confident(rows.where("good is null and doc_id is not null"), models, confident).distinct(), "confident")
        picked = [
            said.where((F.col("view") == view) & (F.col("good") == good)).orderBy(*order).limit(labelled * n // sum(kinds.values()))
            for view in OTHER
            for good, n in sorted(kinds.items())
        ]
        pseudo = one_each(staged(reduce(DataFrame.unionByName, picked), "picked"), "view", "doc_id")
        more = [for_view(pseudo.where(F.col("view") == view), view) for view in OTHER]
        models = _fit(staged(reduce(DataFrame.unionByName, more, own), "sets"), models, ridge, steps)

    def judge(group: pa.Table) -> pa.Table:
        group = group.sort_by("doc_id")
        z = np.column_stack([_logits(models[view], *_lists(group.column(view))) for view in OTHER])
        good, held = group.column("good").to_numpy(), group.column("fold").to_numpy() == 0
        if len(set(good[held])) < 2:
            held[:] = True
        text, meta = (calibrate(z[held, k : k + 1], good[held]) for k in (0, 1))
        views = np.column_stack([z[held, 0] * text[0] + text[1], z[held, 1] * meta[0] + meta[1]])
        return pa.table({"w": pa.array([np.concatenate([text, meta, calibrate(views, good[held])])], pa.list_(pa.float64()))})

    scale = np.array(fit_on.groupBy().applyInArrow(judge, "w array<double>").first()["w"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, meta = (_logits(models[view], *_lists(batch.column(view))) for view in OTHER)
            text, meta = text * scale[0] + scale[1], meta * scale[2] + scale[3]
            z = text * scale[4] + meta * scale[5] + scale[6]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(_share(x)) for x in (text, meta, z)], pa.array(z >= 0)], names=["doc_id", "p_text", "p_meta", "score", "kept"])

    return rows.select("doc_id", *OTHER).mapInArrow(score, "doc_id bigint, p_text double, p_meta double, score double, kept boolean")
