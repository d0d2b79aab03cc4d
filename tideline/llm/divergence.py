"""How far the sources of a language differ in their words: row accumulation through a term-major index.

Counts of the terms that a language keeps form a sparse matrix of groups (language, source) by terms, dealt to blocks
of terms. In a block, each group walks its own terms; the index says which peers have the term too and how often, and
each of them gets its share in a dense accumulator of one number a peer. A pair of postings is never a row, and what
leaves a block is one number for each pair of groups.

Most counts are zero, but a zero has a probability as well. With p(g, t) the group's and z(g) that of a term it does
not have, the distance of g and h is

    V * |z(g) - z(h)|  +  A(g, h) + A(h, g)  +  S(g, h)

where A(g, h) adds |p(g, t) - z(h)| - |z(g) - z(h)| over g's own terms, as if h had none of them, and S corrects that
for the terms that both have. A needs no index: g's probabilities are sorted once and met with all z by bisection.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

#: Documents that a kept term has at least, what is added to each count, and what probabilities are multiplied by.
LEAST_DOCUMENTS, PRIOR, UNIT = 30, 5, 1_000_000_000
#: Terms that are reported of each group.
TOP = 50
#: Entries of a block of terms, about.
BLOCK = 1 << 14
#: Terms that a task adds up before it passes them on.
HELD = 200_000
#: Bytes of a text that are split at a time.
STRETCH = 1 << 20
#: Letters A-Z become small; all other ASCII characters but a-z part terms.
_TERM_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
GROUP = ["lang", "source"]


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, those of a very long one some at a time."""
    data = text.translate(_TERM_BYTES)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + STRETCH)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """lang, source, term with its occurrences ``n`` and its documents ``df``; a row without a term for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurs: dict[tuple[str, str], Counter] = {}
        within: dict[tuple[str, str], Counter] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            rows = ((lang, source, term, n, within[lang, source][term] if n else 0) for (lang, source), own in occurs.items() for term, n in chain([(None, 0)], own.items()))
            while some := list(islice(rows, 50_000)):
                columns = [pa.array(c, t) for c, t in zip(zip(*some), (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "df"])
            occurs.clear()
            within.clear()

        for batch in batches:
            for lang, source, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                seen: set[bytes] = set()
                own = occurs.setdefault((lang, source), Counter())
                for terms in _terms(body.as_py()):
                    own.update(terms)
                    seen.update(terms)
                within.setdefault((lang, source), Counter()).update(seen)
            if sum(map(len, occurs.values())) > HELD:
                yield from flushed()
        yield from flushed()

    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP], F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    found = own.mapInArrow(run, "lang string, source string, term binary, n bigint, df bigint")
    return found.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def probability(n: str, total: str, kept: str) -> Column:
    """1 + floor(UNIT * (n + PRIOR) / (total + PRIOR * kept)) of named columns, exact beyond 64 bits."""
    wide = "cast({} as decimal(19, 0))".format
    return F.expr(f"1 + cast({UNIT} as decimal(10, 0)) * {wide(f'{n} + {PRIOR}')} div {wide(f'{total} + {PRIOR} * {kept}')}")


def _block_distances(index: pa.Table, peers: pa.Table) -> pa.Table:
    """A block's share of the distance of each pair of groups, the one with the lesser name first."""
    peers = peers.sort_by("source")
    names = peers.column("source").combine_chunks()
    base = peers.column("z").to_numpy()
    group = np.asarray(pc.index_in(index.column("source"), value_set=names).to_numpy(), dtype=np.int64)
    term = index.column("term").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # term-major: postings of a term stand together
    order = np.argsort(term, kind="stable")
    group, term, p = group[order], term[order], index.column("p").to_numpy()[order]
    start = np.searchsorted(term, np.arange(term.max() + 2)) if len(term) else np.zeros(1, dtype=np.int64)
    by_group = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[by_group], np.arange(len(names) + 1))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for g in range(len(names)):
        own = by_group[bounds[g] : bounds[g + 1]]
        if not len(own):
            continue
        apart = np.abs(base[g] - base)
        # as if no peer had any of the group's terms
        mine = np.sort(p[own])
        below = np.concatenate([[0], np.cumsum(mine)])
        k = np.searchsorted(mine, base)
        row = base * k - below[k] + (below[-1] - below[k]) - base * (len(mine) - k) - len(mine) * apart
        # what the peers that have them change; each pair once, from its first group
        first, size = start[term[own]], start[term[own] + 1] - start[term[own]]
        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        peer, theirs, ours = group[at], p[at], np.repeat(p[own], size)
        later = peer > g
        peer, theirs, ours = peer[later], theirs[later], ours[later]
        share = np.abs(ours - theirs) - np.abs(ours - base[peer]) - np.abs(base[g] - theirs) + apart[peer]
        np.add.at(row, peer, share)
        others = np.flatnonzero(np.arange(len(names)) != g)
        out.append((np.minimum(others, g), np.maximum(others, g), row[others]))
    a, b, value = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, dtype=np.int64),) * 3
    if len(value):  # both groups' shares of a pair together
        pair, place = np.unique(a * len(names) + b, return_inverse=True)
        added = np.zeros(len(pair), dtype=np.int64)
        np.add.at(added, place, value)
        a, b, value = pair // len(names), pair % len(names), added
    lang = pa.array([peers.column("lang")[0].as_py()] * len(value), pa.string())
    return pa.table({"lang": lang, "a": names.take(pa.array(a)), "b": names.take(pa.array(b)), "value": pa.array(value)})


def audit(docs: DataFrame, text: str = "text", least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: each group's distance to its language's other sources, and its own terms.

    Defined results: null text, lang and source are ''; a group without terms is measured by its zeros; a language
    that keeps no terms has distances of 0 and no terms; the only source of a language has no pairs; an empty table
    gives no rows; repeated rows count each; further columns are ignored.
    """
    found = staged(term_counts(docs, text), "terms")
    some = found.where("term is not null")
    kept = some.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("df")).where(F.col("df") >= least).drop("df")
    kept = staged(kept, "kept")
    matrix = staged(some.drop("df").join(kept, ["lang", "term"]), "matrix")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = matrix.groupBy(*GROUP).agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    blocks = totals.groupBy("lang").agg(F.ceil(F.sum("own") / BLOCK).alias("blocks"))
    groups = found.select(*GROUP).distinct().join(totals.drop("own"), GROUP, "left").join(langs, "lang", "left").join(blocks, "lang", "left")
    groups = groups.na.fill(0, ["total", "v", "lang_total", "blocks"]).withColumn("z", F.when(F.col("v") > 0, probability("0", "total", "v")).otherwise(0).cast("long"))
    groups = staged(groups, "groups")

    sized = matrix.join(groups.select(*GROUP, "total", "v", "lang_total", "blocks"), GROUP)
    sized = sized.withColumns({"p": probability("n", "total", "v"), "q": probability("lang_n", "lang_total", "v")})
    own = sized.where("p > q").select(*GROUP, F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    best = W.partitionBy(*GROUP, "part").orderBy(F.desc("value"), "item")
    terms = own.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    index = sized.select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "source", "term", "p")
    peers = groups.where("v > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("lang", "block", "source", "z")
    shares = index.groupBy("lang", "block").cogroup(peers.groupBy("lang", "block")).applyInArrow(_block_distances, "lang string, a string, b string, value bigint")
    shares = shares.groupBy("lang", "a", "b").agg(F.sum("value").alias("share"))
    # the result has a row for each group and peer: this join is as large as it
    one, other = (groups.select("lang", F.col("source").alias(s), F.col("z").alias(f"z{s}"), F.col("v").alias(f"v{s}")) for s in "ab")
    pairs = one.join(other, "lang").where("a < b").join(shares, ["lang", "a", "b"], "left")
    value = F.col("va") * F.abs(F.col("za") - F.col("zb")) + F.coalesce("share", F.lit(0))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", value.alias("value"), sides.alias("_s")).select("lang", "_s.source", F.lit("pair").alias("part"), "_s.item", "value")
    ranked = pairs.withColumn("rank", F.row_number().over(best))
    return ranked.unionByName(terms).select(*GROUP, "part", "item", "value", "rank")
