"""Quality rules: base limits, then robust multivariate outliers (DataFrame operations only).

Each document gets a vector of transformed statistics. Per language and source, a deterministic
minimum-covariance-determinant estimate gives a centre and a covariance that junk cannot pull away: from
two starts (coordinate-wise medians, and plain means) one concentration step each, on the closest three
quarters; the start with the lesser determinant goes on until its determinant stops falling; one
reweighting step follows. Documents far from the centre by Mahalanobis distance are rejected.

Every group has its own estimate, however small. It is shrunk towards that of its language, and that
towards that of all documents, by ``n / (n + SHRINK)``: a group of few documents mostly follows its
language, a large one itself, and no number of documents switches from one rule to another.

All vectors are fixed-point integers, so that sums are exact whatever the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, let, staged, words

SYMBOLS = "#*$%&|<>"
FEATURES = ("word_len", "symbols", "dup_lines", "repeats")
SCALE = 1000
#: Squared distance beyond which a document is rejected: the chi-square quantile 0.9999 for four degrees of freedom.
CUTOFF = 23.513
#: Least standard deviation of each feature, in fixed point: rarer than that is not yet odd. The last two features
#: reach 1000 ln 11 = 2398 and, at the base limit of half the words, 1000 ln 6 = 1792 at most; their floors are half
#: of that by the cutoff's root, so that beyond half of its range either rejects by itself where others have none.
FLOORS = (83, 277, 247, 185)
#: Documents with which an estimate weighs as much as the wider one that it is shrunk towards.
SHRINK = 200
#: Concentration steps at most, and the share by which a determinant has to fall to count.
STEPS, FALL = 8, 1e-6
#: Chi-square quantiles for four degrees of freedom: 0.975 for the reweighting step.
CHI2_975 = 11.143
#: Consistency factors of the covariance of the closest 75 % and of the reweighted rows.
FACTOR_RAW, FACTOR_REWEIGHTED = 1.487, 1.0645

#: Up to so many different repeated windows are looked up one by one; beyond, places are sorted by window.
FEW = 24


def _repeat_words(ws: Column, hs: Column, twice: Column) -> Column:
    """Words of ``ws`` in three-word windows found at least twice.

    ``hs`` are the windows' 64-bit hashes in order, ``twice`` the hashes found at least twice.
    """
    by_lookup = F.filter(
        F.transform(hs, lambda h, i: F.when(F.array_contains(twice, h), i.cast("long"))), lambda i: i.isNotNull()
    )

    def places(pairs: Column) -> Column:
        found = F.filter(
            pairs,
            lambda e, k: ((k > 0) & (F.get(pairs, k - 1)["h"] == e["h"])) | F.get(pairs, k + 1)["h"].eqNullSafe(e["h"]),
        )
        return F.array_sort(F.transform(found, lambda e: e["i"]))

    def covered(at: Column) -> Column:
        # a window covers three words; overlaps count once
        following = F.concat(F.slice(at, 2, F.size(at) - 1), F.array(F.lit(1 << 40)))
        gaps = F.zip_with(at, following, lambda a, b: F.least(b - a, F.lit(3).cast("long")))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, b: a + b)

    by_sorting = let(
        F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i")))), places
    )
    return (
        F.when(F.size(twice) == 0, F.lit(0).cast("long"))
        .when(F.size(twice) <= FEW, let(by_lookup, covered))
        .otherwise(let(by_sorting, covered))
    )


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words.

    Three-word windows are compared by 64-bit hash. Arrays are built column by column, each used more
    than once, so that Catalyst keeps them as columns and sorts and compares them in compiled code.
    """
    keep = [c for c in docs.columns if c != text]
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.trim(x, F.lit(SPACE_CHARS))) > 0)
    rows = docs.select(
        *keep,
        words(F.col(text)).alias("_ws"),
        lines.alias("_ls"),
        F.regexp_count(body, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
    )
    ws, hs, ordered = F.col("_ws"), F.col("_hs"), F.col("_ordered")
    windows = F.transform(
        F.slice(ws, 1, F.greatest(F.size(ws) - 2, F.lit(0))),
        lambda a, i: F.xxhash64(a, F.get(ws, i + 1), F.get(ws, i + 2)),
    )
    rows = rows.select(
        *keep,
        "n_symbols",
        F.size(ws).cast("long").alias("n_words"),
        F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
        F.size("_ls").cast("long").alias("n_lines"),
        (F.size("_ls") - F.size(F.array_distinct("_ls"))).cast("long").alias("n_dup_lines"),
        "_ws",
        windows.alias("_hs"),
    )
    rows = rows.withColumn("_ordered", F.sort_array(hs))
    twice = F.array_distinct(F.filter(ordered, lambda h, k: (k > 0) & (F.get(ordered, k - 1) == h)))
    rows = rows.withColumn("_twice", F.when(F.size(ordered) > F.size(F.array_distinct(hs)), twice).otherwise(F.array().cast("array<bigint>")))
    return rows.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        _repeat_words(ws, hs, F.col("_twice")).alias("n_repeat_words"),
        "n_lines",
    )


def vector_sql() -> dict[str, str]:
    """Transformed statistics as fixed-point integers, in SQL that other engines share."""
    n = "greatest(n_words, 1)"
    rate = "cast(round({s} * ln(1 + 10e0 * {a} / greatest({b}, 1))) as bigint)"
    return {
        "x0": f"cast(round({SCALE} * ln((word_chars + 1e0) / {n})) as bigint)",
        "x1": rate.format(s=SCALE, a="n_symbols", b="n_words"),
        "x2": rate.format(s=SCALE, a="n_dup_lines", b="n_lines"),
        "x3": rate.format(s=SCALE, a="n_repeat_words", b="n_words"),
    }


def sums_sql() -> dict[str, str]:
    p = range(len(FEATURES))
    return {"n": "cast(count(*) as double)"} | {
        f"s{i}": f"cast(sum(x{i}) as double)" for i in p
    } | {f"s{i}{j}": f"cast(sum(x{i} * x{j}) as double)" for i in p for j in p if j <= i}


def moments_sql(factor: float) -> list[dict[str, str]]:
    """Mean and covariance from the sums, as projections to be applied one after the other."""
    p = range(len(FEATURES))
    floor = lambda i, j: f" + {float(FLOORS[i]) ** 2}" if i == j else ""
    return [{f"m{i}": f"s{i} / n" for i in p}, {f"c{i}{j}": f"{factor} * (s{i}{j} / n - m{i} * m{j})" + floor(i, j) for i in p for j in p if j <= i}]


def cholesky_sql() -> list[dict[str, str]]:
    """Cholesky factor of the covariance, and the root of its determinant."""
    p = range(len(FEATURES))
    layers = []
    for j in p:
        known = "".join(f" - l{j}{k} * l{j}{k}" for k in range(j))
        layers.append({f"l{j}{j}": f"sqrt(greatest(c{j}{j}{known}, 1e0))"})
        if below := {f"l{i}{j}": f"(c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j)) + f") / l{j}{j}" for i in p if i > j}:
            layers.append(below)
    return [*layers, {"det": " * ".join(f"l{i}{i}" for i in p)}]


def shrunk_sql() -> dict[str, str]:
    """Mean and covariance of a group of ``n_rows`` and of the wider one (``w_``...), as of a mixture of both."""
    p = range(len(FEATURES))
    w, v = f"(n_rows / (n_rows + {SHRINK}e0))", f"({SHRINK}e0 / (n_rows + {SHRINK}e0))"
    means = {f"m{i}": f"{w} * m{i} + {v} * w_m{i}" for i in p}
    return means | {f"c{i}{j}": f"{w} * c{i}{j} + {v} * w_c{i}{j} + {w} * {v} * (m{i} - w_m{i}) * (m{j} - w_m{j})" for i in p for j in p if j <= i}


def distance_sql() -> list[dict[str, str]]:
    """Squared Mahalanobis distance by forward substitution."""
    p = range(len(FEATURES))
    layers = [
        {f"z{i}": f"(x{i} - m{i}" + "".join(f" - l{i}{k} * z{k}" for k in range(i)) + f") / l{i}{i}"} for i in p
    ]
    return [*layers, {"d2": " + ".join(f"z{i} * z{i}" for i in p)}]


#: Distances are ranked in fixed point too, so that a group's quantile needs bounded memory.
RANKED_SQL = "cast(floor(least(d2, 1e4) * 100) as bigint)"
PAIRS = [f"{i}{j}" for i in range(len(FEATURES)) for j in range(len(FEATURES)) if j <= i]
MOMENTS = [f"m{i}" for i in range(len(FEATURES))] + [f"c{x}" for x in PAIRS]
MODEL = [f"m{i}" for i in range(len(FEATURES))] + [f"l{x}" for x in PAIRS]


def _layers(df: DataFrame, layers: list[dict[str, str]]) -> DataFrame:
    for layer in layers:
        df = df.withColumns({k: F.expr(v) for k, v in layer.items()})
    return df


def _estimate(rows: DataFrame, factor: float, *more: str) -> DataFrame:
    """Moments, Cholesky factor and determinant of the rows of each ``grp`` (and of what else tells them apart)."""
    sums = rows.groupBy("grp", *more).agg(*[F.expr(v).alias(k) for k, v in sums_sql().items()])
    return _layers(sums, moments_sql(factor) + cholesky_sql()).select("grp", *more, *MOMENTS, *MODEL[len(FEATURES) :], "det")


def _concentrated(vectors: DataFrame, model: DataFrame, *more: str) -> DataFrame:
    """The estimate from the three quarters of each group that are closest to ``model``."""
    x = [f"x{i}" for i in range(len(FEATURES))]
    near = _layers(vectors.join(model.select("grp", *more, *MODEL), "grp"), distance_sql()).select("grp", *more, *x, F.expr(RANKED_SQL).alias("q"))
    limit = staged(near.groupBy("grp", *more).agg(F.expr("percentile(q, 0.75)").alias("q75")), "limit")
    return _estimate(near.join(limit, ["grp", *more]).where("q <= q75"), FACTOR_RAW, *more)


def mcd(vectors: DataFrame) -> DataFrame:
    """Per ``grp``, the reweighted moments m0.. and c00.. of the vectors x0.. .

    Only whether any determinant still falls reaches the driver.
    """
    p = range(len(FEATURES))
    medians = staged(vectors.groupBy("grp").agg(*[F.expr(f"percentile(x{i}, 0.5)").alias(f"m{i}") for i in p]), "medians")
    spreads = vectors.join(medians, "grp").groupBy("grp").agg(*[F.expr(f"percentile(abs(x{i} - m{i}), 0.5)").alias(f"a{i}") for i in p])
    zeros = {f"l{i}{j}": F.lit(0.0) for i in p for j in p if j < i}
    robust = medians.join(spreads, "grp").withColumns({f"l{i}{i}": F.greatest(1.4826 * F.col(f"a{i}"), F.lit(float(FLOORS[i]))) for i in p} | zeros)
    plain = _estimate(vectors, 1.0)
    starts = staged(robust.select("grp", F.lit(0).alias("start"), *MODEL).unionByName(plain.select("grp", F.lit(1).alias("start"), *MODEL)), "starts")
    both = _concentrated(vectors, starts, "start")
    rest = [*MOMENTS, *MODEL[len(FEATURES) :], "det"]
    # of equal determinants the medians' start goes on
    least = F.min_by(F.struct(*rest), F.struct(F.when(F.col("start") == 0, F.col("det") * (1 - FALL)).otherwise(F.col("det")), "start"))
    model = staged(both.groupBy("grp").agg(least.alias("_m")).select("grp", "_m.*"), "chosen")
    for k in range(STEPS):
        after = _concentrated(vectors, model).select("grp", *[F.col(c).alias(f"a_{c}") for c in rest])
        falls = F.coalesce(F.col("a_det") < F.col("det") * (1 - FALL), F.lit(False))
        after = staged(model.join(after, "grp", "left").withColumn("_falls", falls), f"step{k}")
        model = after.select("grp", *[F.when(F.col("_falls"), F.col(f"a_{c}")).otherwise(F.col(c)).alias(c) for c in rest])
        if after.where("_falls").isEmpty():
            break
    near = _layers(vectors.join(model.select("grp", *MODEL), "grp"), distance_sql()).where(f"d2 <= {CHI2_975}")
    return _estimate(near, FACTOR_REWEIGHTED).select("grp", *MOMENTS)


def _names(rows: DataFrame) -> DataFrame:
    """lang and source of every group with the names of the group, of its language's, and of that of all."""
    lang = F.coalesce(F.concat(F.lit("l"), F.col("lang")), F.lit(""))
    fine = F.concat(F.lit("f"), lang, F.lit("/"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")))
    counts = rows.groupBy("lang", "source").agg(F.count("*").alias("n_rows"))
    return counts.withColumns({"fine": fine, "wide": F.concat(F.lit("w"), lang), "all": F.lit("*")})


def _shrunk(own: DataFrame, wider: DataFrame) -> DataFrame:
    """``own`` (grp, n_rows, wider, moments) shrunk towards the moments of the group named by ``wider``."""
    wider = wider.select(F.col("grp").alias("wider"), *[F.col(c).alias(f"w_{c}") for c in MOMENTS])
    return own.join(wider, "wider").select("grp", *[F.expr(v).alias(k) for k, v in shrunk_sql().items()])


BASE_SQL = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _measured(docs: DataFrame) -> DataFrame:
    rows = statistics(docs).withColumn("base_failed", F.expr(BASE_SQL))
    return rows.withColumns({k: F.expr(v) for k, v in vector_sql().items()})


def _judged(rows: DataFrame, model: DataFrame) -> DataFrame:
    """``rows`` with ``d2`` and ``kept``; ``model`` has one row for each language and source."""
    keys = [F.coalesce(rows[c], F.lit("")).eqNullSafe(model[f"_{c}"]) & rows[c].isNull().eqNullSafe(model[f"_{c}_null"]) for c in ("lang", "source")]
    judged = _layers(rows.join(model, keys[0] & keys[1], "left"), distance_sql())
    return judged.withColumns(
        {
            "d2": F.when(~F.col("base_failed"), F.col("d2")),
            "kept": ~F.col("base_failed") & F.coalesce(F.expr(f"d2 <= {CUTOFF}"), F.lit(False)),
        }
    )


def _fitted(rows: DataFrame) -> DataFrame:
    """The model of each language and source among the ``rows`` that pass the base limits."""
    x = [f"x{i}" for i in range(len(FEATURES))]
    good = rows.where("not base_failed")
    names = staged(_names(good), "names")  # a row a group
    keys = {c: good[c].eqNullSafe(names[c]) for c in ("lang", "source")}
    dealt = good.select("lang", "source", *x).join(names, keys["lang"] & keys["source"]).select(F.explode(F.array("fine", "wide", "all")).alias("grp"), *x)
    moments = staged(mcd(staged(dealt, "vectors")), "moments")
    top = moments.where("grp = '*'")
    sizes = lambda level, wider: names.groupBy(F.col(level).alias("grp"), F.col(wider).alias("wider")).agg(F.sum("n_rows").alias("n_rows"))
    wide = _shrunk(moments.join(sizes("wide", "all"), "grp"), top)
    fine = _shrunk(moments.join(sizes("fine", "wide"), "grp"), wide)
    model = _layers(fine, cholesky_sql()).select("grp", *MODEL)
    named = names.select(
        F.col("fine").alias("grp"),
        *[F.coalesce(c, F.lit("")).alias(f"_{c}") for c in ("lang", "source")],
        *[F.col(c).isNull().alias(f"_{c}_null") for c in ("lang", "source")],
    )
    return staged(named.join(model, "grp"), "model")


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """Statistics and verdict of every row of ``docs`` (doc_id, text, lang, source).

    Returns doc_id, the statistics, ``base_failed``, ``d2`` (squared robust distance; null where the
    base limits fail) and ``kept``. Only documents that pass the base limits are used for the
    estimates and judged by distance.

    Defined results: a null text is an empty one and fails the base limits; null languages and
    sources form groups of their own; repeated rows are judged alike; an empty table gives no rows;
    columns of other names are ignored. A group as uniform as to have no spread has the floors', and a group of few documents mostly follows its language.
    """
    rows = _measured(docs.select("doc_id", F.col(text).alias("text"), "lang", "source"))
    rows = staged(rows, "statistics")
    return _judged(rows, _fitted(rows)).select("doc_id", *COLUMNS, "d2", "kept")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, source, any others) that :func:`judge` keeps, as they are.

    The measured rows are written once, texts included, so that model and verdict read them without
    measuring again; only statistics are moved between tasks.
    """
    # the row travels as one column, so that no name in it can clash
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), "text", "lang", "source")
    rows = staged(_measured(rows), "measured")
    return _judged(rows, _fitted(rows)).where("kept").select("_row.*")
