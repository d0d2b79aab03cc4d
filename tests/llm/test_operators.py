import hashlib
import json
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tideline.llm import chat, cotraining, covertree, minhash, mixing, packing, quality, repeats, sharding, substring, suffix  # noqa: E402
from tideline.llm.queries import tokenizer_path  # noqa: E402

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, size int, id string, `rank` int, keys string"


def docs(spark, rows):
    """Documents with columns of clashing names."""
    return spark.createDataFrame([(i, t, ("en", None)[k % 7 == 0], ("a", "b", None)[k % 3], 5, "x", 1, "y") for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)


def odd_rows():
    rng = random.Random(1)
    base = "".join(rng.choice("abcde ") for _ in range(2000))
    rows = []
    for i in range(40):
        text = ""
        while len(text) < rng.choice([50, 300, 900]):
            at = rng.randrange(1900)
            text += base[at : at + rng.choice([30, 90, 99, 100, 101, 130, 250])]
            text += rng.choice(["", "", "é", " \n", "\t", "x"])
        rows.append((i, text))
    edited = " ".join(f"w{k}" for k in range(200))
    rows += [(50, edited), (51, edited.replace("w100", "other")), (52, edited.upper()), (53, edited.replace("w1", "v1")), (54, "one two"), (55, "ONE  two"), (56, "one"), (57, "   ")]
    return rows + [(100, None), (101, ""), (102, rows[3][1]), (103, rows[3][1]), (104, "ab " * 400), (105, "a" * 500), (106, "a" * 99), (107, "a" * 100), (108, "é" * 90)]


def real_rows(spark):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


def collected(df, *columns):
    return {r[0]: tuple(r)[1:] for r in df.select(*columns).collect()}


@pytest.mark.parametrize("kind", ["odd", "real"])
def test_suffix_and_substring_against_brute_force(spark, kind):
    rows = odd_rows() if kind == "odd" else real_rows(spark)
    found = suffix.deduplicate(docs(spark, rows), carry=["size", "id"])
    assert collected(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffix(rows)
    assert {r["id"] for r in found.collect()} == {"x"}
    assert collected(substring.deduplicate(docs(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.substring(rows)


def test_factors_decide_what_is_removed(spark, monkeypatch):
    """Factors that do not go on greedily leave words behind, and without factors nothing is removed."""
    b, rows = repeats.Spec("words", 13, 5), [(1, " ".join(f"w{k}" for k in range(60))), (2, " ".join(f"w{k}" for k in range(5, 50)))]
    data, offsets = np.frombuffer("".join(t for _, t in rows).encode(), dtype=np.uint8), np.array([0, len(rows[0][1]), len(rows[0][1]) + len(rows[1][1])])
    chunk = repeats.Blocks(b, data, offsets)
    own = np.flatnonzero(chunk.row == 1)
    keys = chunk.keys(own)
    places = chunk.first[own] - chunk.bounds[1] + 5
    given = (keys, np.ones(len(own), dtype=np.int64), np.ones(len(own), dtype=np.int64), places)
    gone, factors = substring.parse(chunk, *given)
    assert gone[60:].all() and not gone[:60].any() and factors.tolist() == [[1, 0, 45, 1, 5]]
    whole = substring.greedy
    monkeypatch.setattr(substring, "greedy", lambda found: whole(found)[:, :] - np.array([0, 0, 3, 0, 0]))
    assert substring.parse(chunk, *given)[0].sum() == 42
    monkeypatch.setattr(substring, "greedy", lambda found: whole(found)[:0])
    assert substring.parse(chunk, *given)[0].sum() == 0


def test_spans_and_factors_describe_what_is_kept(spark):
    rows = dict(odd_rows())
    for r in suffix.deduplicate(docs(spark, rows.items())).collect():
        raw, left, at = (rows[r["doc_id"]] or "").encode(), b"", 0
        for s in r["spans"]:
            left, at = left + raw[at : s["start"]], s["end"]
        assert left + raw[at:] == bytes(r["kept"]) and len(r["spans"]) == r["n_spans"]
    for r in substring.deduplicate(docs(spark, rows.items())).collect():
        ws = brute.words(rows[r["doc_id"]])
        gone = {k for f in r["factors"] for k in range(f["start"], f["end"])}
        assert r["kept"] == " ".join(w for k, w in enumerate(ws) if k not in gone)
        assert sum(f["end"] - f["start"] for f in r["factors"]) == r["n_removed"]
        for k, f in enumerate(r["factors"]):
            # a factor has a place in an earlier document, where the same words stand
            there = brute.words(rows[f["ref"]])
            assert f["ref"] < r["doc_id"] and ws[f["start"] : f["end"]] == there[f["ref_start"] : f["ref_start"] + f["end"] - f["start"]]
            before = r["factors"][k - 1] if k else None
            assert not k or before["end"] <= f["start"]
            # greedy: a factor is not cut where its document goes on alike
            assert not k or (before["ref"], before["ref_start"] - before["start"], before["end"]) != (f["ref"], f["ref_start"] - f["start"], f["start"])


def test_a_copy_of_two_documents_is_two_factors(spark):
    text = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    rows = [(1, text("a", 60)), (2, text("b", 60)), (3, "new " + text("a", 60) + " " + text("b", 40) + " end"), (2**63 - 1, text("a", 13)), (None, text("b", 20))]
    got = {r["doc_id"]: [tuple(f) for f in r["factors"]] for r in substring.deduplicate(docs(spark, rows)).collect()}
    assert got == {1: [], 2: [], 3: [(1, 61, 1, 0), (61, 101, 2, 0)], 2**63 - 1: [(0, 13, 1, 0)], None: [(0, 20, 2, 0)]}


@pytest.mark.parametrize("kind", ["odd", "real"])
def test_near_duplicates_against_brute_force(spark, kind):
    rows = odd_rows() if kind == "odd" else real_rows(spark)
    assert collected(minhash.near_duplicates(docs(spark, rows)), "doc_id", "n_shingles", "component_id", "kept") == brute.near(rows)


@pytest.mark.parametrize("block", [minhash.BLOCK, 4])
def test_last_round_finds_links_between_components(spark, monkeypatch, block):
    """Chains of texts of which each is like the next only; stars alone would break them."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(3)
    rows, chain = [], [f"t{k}" for k in range(120)]
    for i in range(60):
        chain = list(chain)
        for _ in range(2):
            chain[rng.randrange(120)] = f"n{i}{rng.random()}"
        rows.append((i, " ".join(chain)))
    assert collected(minhash.near_duplicates(docs(spark, rows)), "doc_id", "n_shingles", "component_id", "kept") == brute.near(rows)


def test_signature_bytes_agree_where_the_values_do():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**64, 400, dtype=np.uint64)) for _ in range(2)]
    sets.append(np.unique(np.concatenate([sets[0][:340], sets[1][:60]])))  # three quarters of the first, and more
    hashes, at = np.concatenate(sets), np.cumsum([0] + [len(x) for x in sets])
    values = minhash.signatures.min_max(hashes, at, minhash.PERMUTATIONS)
    low = values & np.uint64(255)
    for i, j in ((0, 1), (0, 2), (1, 2)):
        true = len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
        assert ((low[i] == low[j]) | (values[i] != values[j])).all()
        assert abs((low[i] == low[j]).mean() - true) < 0.15


def vector_rows():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(5, 8))
    rows = [(i, (base[i % 5] + rng.normal(size=8) * rng.choice([0.02, 0.1, 0.3])).tolist(), i % 2) for i in range(300)]
    bad = [None, [0.0] * 8, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7, [], [1.0, 2.0]]
    rows += [(700 + k, v, 0) for k, v in enumerate(bad)]
    return rows + [(710, rows[0][1], None), (711, rows[0][1], 0), (712, [3 * x for x in rows[0][1]], 0), (713, [1e300] * 8, 1)]


def test_embeddings_against_brute_force(spark):
    rows = vector_rows()
    frame = spark.createDataFrame([(i, v, label, "x") for i, v, label in rows], "vec_id long, embedding array<double>, label int, unit string")
    assert collected(covertree.near_duplicates(frame), "vec_id", "n_links", "component_id", "kept") == brute.vectors(rows)


def test_null_vector_ids(spark):
    one, other, far = [1.0, 0.0], [1.0, 0.01], [0.0, 1.0]
    rows = [(None, one, 1), (None, other, 1), (7, one, 1), (None, far, 1), (None, None, 1), (9, far, None)]
    got = covertree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, 0, False), (0, 0, 0, False), (0, 2, 7, False), (0, 2, 7, False), (7, 2, 7, True), (9, 0, 9, True)]


def test_cover_tree_is_nested_separated_and_covering():
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(12, 16)), 80, axis=0) + 0.15 * np.repeat(rng.normal(size=(48, 16)), 20, axis=0) + rng.normal(size=(960, 16)) * 0.02
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = covertree.grow(x[rng.permutation(len(x))])
    assert len(tree.radius) > 12
    known = {tuple(v) for v in x}
    for node in range(len(tree.radius)):
        below = tree.children(node)
        assert tuple(tree.centre[node]) in known
        if len(below):
            r = tree.radius[below[0]]
            apart = covertree._distances(tree.centre[below], tree.centre[below]) + 9 * np.eye(len(below))
            assert (tree.radius[below] == r).all() and r <= tree.radius[node] / 2 and apart.min() > r
            assert covertree._distances(tree.centre[below], tree.centre[node : node + 1]).max() <= tree.radius[node]


def test_tree_prunes_and_includes():
    rng = np.random.default_rng(1)
    far = np.eye(8)[:3].repeat(60, axis=0) + rng.normal(size=(180, 8)) * 0.005
    far /= np.linalg.norm(far, axis=1)[:, None]
    tree = covertree.grow(far)
    node, distance = tree.assign(far)
    covering = np.array([distance[node == i].max(initial=-1) for i in range(len(tree.radius))])
    compare, linked = covertree.traverse(tree, covering, 0.2)
    used = set(node.tolist())
    assert len(used) >= 3 and {(i, i) for i in used} <= set(linked) | set(compare)
    centres = {i: int(np.abs(tree.centre[i]).argmax()) for i in used}
    assert all(centres[a] == centres[b] for a, b in compare + linked)


def vectors_in_groups(groups: int, size: int, alone: int, spread: float, dims: int = 32) -> np.ndarray:
    rng = np.random.default_rng(groups + dims)
    x = np.repeat(rng.normal(size=(groups, dims)), size, axis=0) + rng.normal(size=(groups * size, dims)) * spread
    x = np.concatenate([x, rng.normal(size=(alone, dims))])
    return (x / np.linalg.norm(x, axis=1)[:, None])[rng.permutation(len(x))]


def test_levels_of_a_block_are_nested_separated_and_covering():
    x = vectors_in_groups(40, 12, 100, 0.03)
    path = covertree.descent(x)
    for level, radius in enumerate(covertree.LEVELS):
        nodes = np.unique(path[:, level])
        assert (path[nodes, level] == nodes).all() and (level == 0 or np.isin(path[:, level - 1], nodes).all())
        assert np.sqrt(((x - x[path[:, level]]) ** 2).sum(axis=1)).max() <= radius + 1e-7
        if level:  # within their parent, as in the tree over the sample
            parent = path[nodes, level - 1]
            assert (path[path[:, level], level - 1] == path[:, level - 1]).all()
        else:
            parent = np.zeros(len(nodes))
        apart = covertree._distances(x[nodes], x[nodes]) + 9 * (parent[:, None] != parent) + 9 * np.eye(len(nodes))
        assert apart.min() > radius


@pytest.mark.parametrize("x", [vectors_in_groups(40, 12, 100, 0.01), vectors_in_groups(3, 300, 20, 0.04, 8), vectors_in_groups(9, 60, 500, 0.1, 3), vectors_in_groups(5, 40, 0, 0.3, 2), vectors_in_groups(1, 1, 0, 0)])
@pytest.mark.parametrize("step", [0, 1500, 10**9])
def test_dual_traversal_against_all_pairs(monkeypatch, x, step):
    monkeypatch.setattr(covertree, "STEP", step)
    monkeypatch.setattr(covertree, "ROWS", 64)
    count = np.random.default_rng(0).integers(1, 4, len(x))
    true = x @ x.T >= 0.98
    np.fill_diagonal(true, False)
    half = len(x) // 2
    sides = [(np.arange(len(x)), np.arange(len(x)))] + ([(np.arange(half), np.arange(half, len(x)))] if half else [])
    for a, b in sides:
        path = np.zeros((len(x), len(covertree.LEVELS)), dtype=np.int64)
        for rows in (a, b):
            path[rows] = rows[covertree.descent(x[rows])]
        links, p, q, work = covertree.dual(x, path, count, a, b, 0.98)
        own = np.zeros_like(true)
        own[np.ix_(a, b)] = own[np.ix_(b, a)] = True
        own &= true
        assert (links == own @ count).all()
        nodes = range(len(x))
        assert brute.groups(nodes, zip(p.tolist(), q.tolist())) == brute.groups(nodes, zip(*np.nonzero(own)))


def test_dual_traversal_spares_pairs_of_grouped_vectors():
    """Groups that fit the threshold are counted whole, and those apart pruned whole: a centre stands for its group."""
    x = vectors_in_groups(100, 20, 0, 0.005)
    every = np.arange(len(x))
    _, p, q, work = covertree.dual(x, covertree.descent(x), np.ones(len(x), dtype=np.int64), every, every, 0.98)
    assert work <= 100 * 100 + 100 and len(set(brute.groups(every.tolist(), zip(p.tolist(), q.tolist())).values())) == 100


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rows = odd_rows() + [(200, "word " * 5000), (201, "mind <|endoftext|> the gap"), (202, "naïve café ☕ 漢字 " * 50), (203, " " * 3000)]
    packed = packing.pack_documents(docs(spark, rows), tokenizer_path(), with_ids=True).collect()
    tokenizer, by = Tokenizer.from_file(tokenizer_path()), {}
    for r in packed:
        assert zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] <= 1024
        by.setdefault(r["doc_id"], []).append(r)
    for i, text in rows:
        own = sorted(by[i], key=lambda r: r["piece"])
        assert [t for r in own for t in r["ids"]] == tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert all(r["length"] == 1024 for r in own[1:]) and [r["start"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own])[:-1])
    for sequence in {r["sequence_id"] for r in packed}:
        own = sorted((r for r in packed if r["sequence_id"] == sequence), key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own])[:-1]) and sum(r["length"] for r in own) <= 1024
    total = sum(r["length"] for r in packed)
    assert len({r["sequence_id"] for r in packed}) <= total / 1024 * 1.02 + 2


def test_ids_are_those_of_the_tokenizer():
    """The faster encoder against the tokenizer itself, on every document and on odd texts."""
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    texts += ["", " ", "\n\n  x", "a\u0301 \u200b\ufeff", "𝒳😀\r\n\t", "1234567 12,3", "it's IT'S we'll", "<|endoftext|>", "\x00\x7f", "ß" * 3000]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    for text in texts:
        assert packing.encode(text or "", tokenizer_path()).tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_packing_against_plain_best_fit():
    """Best-fit over the histogram of lengths opens as many sequences as best-fit over single pieces, give or take one in a hundred."""
    rng = random.Random(9)
    lengths = sorted((min(1024, int(rng.paretovariate(0.7) * 20)) for _ in range(4000)), reverse=True)
    free = []  # sorted
    import bisect

    for n in lengths:
        at = bisect.bisect_left(free, n)
        room = free.pop(at) if at < len(free) else 1024
        if room - n:
            bisect.insort(free, room - n)
    opened = -(-(sum(lengths) + sum(free)) // 1024)
    histogram = {n: lengths.count(n) for n in set(lengths)}
    runs = packing.best_fit(histogram, packing.Capacity())
    used = max(first + count for _, _, count, first, _ in runs)
    assert used <= opened * 1.01 + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_respects_every_capacity(rule):
    rng = random.Random(2)
    histogram = {n: rng.randrange(1, 50) for n in rng.sample(range(1, 101), 60)}
    room = packing.Capacity(tokens=100, documents=4, attention=5000 if max(histogram) <= 70 else 10_000)
    load = {}
    for n, rank, count, first, offset in packing.best_fit(histogram, room, rule=rule):
        for k in range(count):
            load.setdefault(first + k, []).append((offset, n))
    seen = {}
    for own in load.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0] + [n for _, n in own])[:-1])
        assert sum(n for _, n in own) <= room.tokens and len(own) <= room.documents and sum(n * n for _, n in own) <= room.attention
        for _, n in own:
            seen[n] = seen.get(n, 0) + 1
    assert seen == histogram


def test_sharding_law(spark):
    rows = docs(spark, [*odd_rows(), *[(i, "t") for i in range(1000, 3000)], (None, "n"), (5, "twice"), (5, "twice")])
    got = sharding.shard_rows(rows).collect()
    assert len(got) == rows.count()
    for s in range(24):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["grown_shard"] in (r["shard"], 24) for r in got) and any(r["grown_shard"] == 24 for r in got)
    assert len({r["shard"] for r in got if r["doc_id"] == 5}) == 1
    heavy = sharding.shard_rows(rows, weights=(3.0, 1.0, 0.0)).groupBy("shard").count().collect()
    share = {r["shard"]: r["count"] / len(got) for r in heavy}
    assert 2 not in share and abs(share[0] - 0.75) < 0.05


def test_mixing_meets_its_targets(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(0, 60), f"s{min(int(rng.expovariate(0.5)), 7)}") for i in range(1500)] + [(9000, None, None), (9001, "a b c", None), (5, "again", "s0")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(frame)
    got = mixed.collect()
    again = collected(mixing.mix(frame.repartition(5)), "doc_id", "taken", "shards")
    assert all(again[r["doc_id"]] == (r["taken"], r["shards"]) for r in got if r["doc_id"] != 5)
    sizes, taken, target = {}, {}, {}
    for r in got:
        assert r["taken"] == r["size"] * r["copies"] and len(r["shards"]) == r["copies"] <= 3
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    names = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, want, open_ = sum(sizes.values()), {}, list(names)
    while True:
        left = total - sum(want.values())
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not full:
            want |= {s: level * weight[s] for s in open_}
            break
        want |= {s: 3.0 * sizes[s] for s in full}
        open_ = [s for s in open_ if s not in full]
    for s in names:
        assert abs(target[s] - want[s]) < 1e-6 * total and abs(taken[s] - want[s]) <= 30
    copies = mixing.drawn(frame, ordered=True)
    assert copies.count() == sum(r["copies"] for r in got) and copies.select("shard").distinct().count() == 16
    # names that the operator would use stay the caller's
    clash = frame.selectExpr("*", "'own' as size", "doc_id as shard", "'x' as shuffle", "1 as mix_size")
    names = dict(mixing.mix(clash).dtypes)
    assert names["size"] == "string" and names["mix_mix_size"] == "bigint" and names["shard"] == "bigint"
    twice = mixing.drawn(clash)
    assert twice.columns == [*clash.columns, "copy", "mix_shard", "mix_shuffle"] and twice.where("size = 'own' and shard <=> doc_id").count() == copies.count()


def test_split_tree_is_exact(spark):
    quotas = spark.createDataFrame([("a", 700), ("b", 37), ("c", 0), ("d", 1)], "skey string, units long")
    rows = mixing.split_tree(quotas, 3).collect()
    assert sorted((r["skey"], r["unit"]) for r in rows) == [(s, k) for s, n in (("a", 700), ("b", 37), ("d", 1)) for k in range(n)]
    counts = [sum(r["shard"] == k for r in rows) for k in range(8)]
    assert max(counts) - min(counts) <= 3


def plain_statistics(text):
    ws = brute.words(text)
    grams = [tuple(ws[k : k + 3]) for k in range(len(ws) - 2)]
    twice = {g for g in grams if grams.count(g) > 1}
    covered = {k + j for k, g in enumerate(grams) if g in twice for j in range(3)}
    lines = [x for x in (text or "").split("\n") if brute.words(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark):
    texts = ["a b c a b c a b", "x " * 400, "a b c d a b c", "one\ntwo\none\n \n \n", "# a | b <> é𝒳", None, "", "a", "a b", "a b c", " ".join(str(k % 31) for k in range(300)), "q w e r\x0bt y\x0c" * 9]
    got = collected(quality.judge(docs(spark, list(enumerate(texts)))), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for i, text in enumerate(texts):
        want = plain_statistics(text)
        assert got[i] == (*want, want[0] < 50 or 100 * want[4] > 50 * want[0]), text


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(60, 300)))) for i in range(400)]
    rows += [(1000 + k, " ".join(w + "###" for w in rows[k][1].split())) for k in range(20)]
    got = collected(quality.judge(docs(spark, rows)), "doc_id", "kept")
    assert all(got[i][0] for i in range(400)) and not any(got[1000 + k][0] for k in range(20))
    kept = quality.keep(docs(spark, rows))
    assert {r["doc_id"] for r in kept.collect()} == set(range(400)) and kept.columns == docs(spark, rows).columns


def plain_mcd(x, floors):
    """Moments by a minimum-covariance-determinant estimate of many random starts, each iterated until it stands still."""
    rng, h, best = np.random.default_rng(3), max(1, int(np.ceil(0.75 * len(x)))), None
    floor = np.diag(np.square(floors).astype(float))
    cov = lambda rows: np.cov(rows.T, bias=True)
    distance = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    for _ in range(40):
        chosen = rng.choice(len(x), min(10, len(x)), replace=False)
        for _ in range(100):
            m, c = x[chosen].mean(0), 1.487 * cov(x[chosen]) + floor
            again = np.sort(np.argsort(distance(m, c))[:h])
            if np.array_equal(again, chosen):
                break
            chosen = again
        det = np.linalg.det(c)
        if best is None or det < best[0]:
            best = det, m, c
    near = x[distance(*best[1:]) <= 11.143]
    return near.mean(0), cov(near) * 1.0645 + floor


def plain_shrunk(own, n, wider):
    w, apart = n / (n + 200), own[0] - wider[0]
    return w * own[0] + (1 - w) * wider[0], w * own[1] + (1 - w) * wider[1] + w * (1 - w) * np.outer(apart, apart)


def test_quality_against_a_plain_estimate(spark):
    """Verdicts are those of the plain estimate in every group, but for distances within a tenth of the cutoff."""
    rng = random.Random(10)
    rows, of = [], {}
    kinds = {("en", "a"): (400, 4.5, 0.03), ("en", "b"): (120, 6.5, 0.05), ("en", None): (25, 5, 0.02), ("de", "a"): (260, 8, 0.1), (None, "c"): (60, 3.5, 0.0)}
    for (lang, source), (n, base, marks) in kinds.items():
        for k in range(n):
            long, odd, same = rng.uniform(base - 1, base + 1), rng.uniform(0, 2 * marks), rng.uniform(0, 0.2)
            if k % 12 == 0:
                long, odd, same = rng.choice([(14, 0.05, 0.1), (5, 0.9, 0.1), (5, 0.05, 0.9), (12, 0.6, 0.6)])
            lines = []
            for _ in range(rng.randrange(12, 30)):
                ws = ["".join(rng.choice("abcdefghijkl") for _ in range(max(1, int(rng.gauss(long, 1))))) + ("#" if rng.random() < odd else "") for _ in range(7)]
                lines.append(" ".join(ws))
                if rng.random() < same:
                    lines.append("ab")
            of[len(rows)] = (lang, source)
            rows.append((len(rows), "\n".join(["ab", *lines]), lang, source))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sorted((r for r in quality.judge(frame).collect() if not r["base_failed"]), key=lambda r: r["doc_id"])
    lines = {r[0]: len(r[1].split("\n")) for r in rows}
    ratio = lambda a, b: np.log(1 + 10 * a / max(b, 1))
    x = np.round(1000 * np.array([(np.log((r["word_chars"] + 1) / r["n_words"]), ratio(r["n_symbols"], r["n_words"]), ratio(r["n_dup_lines"], lines[r["doc_id"]]), ratio(r["n_repeat_words"], r["n_words"])) for r in got]))
    group = [of[r["doc_id"]] for r in got]
    top, rejected = plain_mcd(x, quality.FLOORS), 0
    for lang in {g[0] for g in group}:
        wide = [k for k, g in enumerate(group) if g[0] == lang]
        language = plain_shrunk(plain_mcd(x[wide], quality.FLOORS), len(wide), top)
        for own in {g for g in group if g[0] == lang}:
            some = [k for k, g in enumerate(group) if g == own]
            m, c = plain_shrunk(plain_mcd(x[some], quality.FLOORS), len(some), language)
            d2 = np.einsum("ij,jk,ik->i", x[some] - m, np.linalg.inv(c), x[some] - m)
            rejected += (d2 > quality.CUTOFF).sum()
            for k, d in zip(some, d2):
                assert got[k]["kept"] == (d <= quality.CUTOFF) or abs(d / quality.CUTOFF - 1) < 0.1, (own, got[k], d)
    assert rejected >= 20


def test_no_number_of_documents_switches_the_estimate(spark):
    """A group's own estimate counts from the first document on, and more so with each one."""
    rng = random.Random(4)
    text = lambda size: " ".join("".join(rng.choice("abcdefgh") for _ in range(max(1, int(rng.gauss(size, 0.5))))) for _ in range(80))
    base = [(k, text(4), "en", "base") for k in range(600)]
    probe = (10_000, text(10), "en", "own")
    seen = []
    for n in (1, 20, 199, 200, 400):
        rows = [*base, probe, *[(1000 + k, text(9), "en", "own") for k in range(n)]]
        frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        seen.append(next(r["d2"] for r in quality.judge(frame).where("doc_id = 10000").collect()))
    assert seen == sorted(seen, reverse=True) and seen[2] / seen[3] < 1.2


def test_repeated_lines_and_words_reject_by_themselves(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    text = lambda n: [word() for _ in range(n)]
    lines = lambda ws: "\n".join(" ".join(ws[k : k + 10]) for k in range(0, len(ws), 10))
    rows = [(i, lines(text(rng.randrange(60, 300)))) for i in range(400)]
    # short lines repeat, so that the words between them are few in repeated windows
    rows += [(1000 + k, "\n".join("ab\n" + " ".join(text(8)) for _ in range(20))) for k in range(20)]
    # two fifths of the words come twice, in other lines
    for k in range(20):
        ws = text(160)
        ws[105:137] = ws[20:52]
        rows.append((2000 + k, lines(ws)))
    got = collected(quality.judge(docs(spark, rows)), "doc_id", "n_words", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert not any(got[i][3] for i, _ in rows)
    assert all(got[1000 + k][1] == 19 and got[1000 + k][2] < 10 and got[2000 + k][1] < 2 and got[2000 + k][2] >= 60 for k in range(20))
    assert [i for i, _ in rows if not got[i][4]] == [i for i, _ in rows if i >= 1000]


def test_chat_perspectives(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", "yo"), (1, 2, "bob", "yo"), (1, 3, "ann", None), (2, 0, "system", "alone"), (None, 0, None, "who"), (3, 600, "a", "late"), (3, 0, "b", "x")]
    rows = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, perspective string")
    got = {(r["conv_id"], r["perspective"], r["window"]): r for r in chat.rotate_perspectives(rows).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (None, "unknown", 0), (3, "a", 0), (3, "b", 0)}
    assert all(got[3, who, 0]["n_messages"] == 2 for who in "ab")  # sparse numbers make no windows
    got |= {(r["conv_id"], r["perspective"], r["window"]): r for r in chat.rotate_perspectives(rows.where("conv_id = 3"), window_turns=1).collect()}
    ann = got[1, "ann", 0]
    assert ann["rendered"] == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n<|im_start|>user name=bob\nyo<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    )
    assert [ann["rendered"][m["start"] : m["end"]] for m in ann["mask"]] == ["hi < |im_end|><|im_end|>", "<|im_end|>"]
    assert (ann["n_messages"], ann["n_trained"]) == (4, 2) and got[3, "a", 0]["mask"] == []
    assert (got[3, "a", 0]["offset"], got[3, "a", 1]["offset"]) == (0, len(got[3, "a", 0]["rendered"]))


def test_cutting_a_dialogue_changes_no_text_and_no_mask(spark):
    rng = random.Random(7)
    turns = [(c, t, rng.choice(["system", "ann", "bob", "<|x", None]), "w" * rng.randrange(9)) for c in ("null", None, "7") for t in [None, *range(-4, 30)] for _ in range(2)]
    rows = spark.createDataFrame(turns, "conv_id string, turn long, role string, text string")

    def whole(window):
        found = {}
        for r in sorted(chat.rotate_perspectives(rows, window_turns=window).collect(), key=lambda r: r["window"]):
            text, mask = found.get((r["conv_id"], r["perspective"]), ("", []))
            assert len(text) == r["offset"]
            found[r["conv_id"], r["perspective"]] = (text + r["rendered"], mask + [tuple(m) for m in r["mask"]])
        return found

    small, large = whole(3), whole(10_000)
    assert small == large and len({c for c, _ in large}) == 3


@pytest.mark.parametrize("number", [lambda k: k, lambda k: k * 1_000_000, lambda k: 5, lambda k: None, lambda k: -k])
def test_windows_hold_so_many_messages_whatever_the_numbers(spark, number):
    turns = [(1, number(k), "ab"[k % 2], f"{k:03d}") for k in range(50)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = chat.rotate_perspectives(rows, window_turns=8).collect()
    assert sorted((r["perspective"], r["window"], r["n_messages"]) for r in got) == [(who, w, 8 if w < 6 else 2) for who in "ab" for w in range(7)]
    said = sorted(turns, key=lambda t: ((t[1] is not None, t[1] or 0), t[2], t[3]))
    for who in "ab":
        whole = "".join(r["rendered"] for r in sorted(got, key=lambda r: r["window"]) if r["perspective"] == who)
        assert [line[:3] for line in whole.split("\n") if line[:1].isdigit()] == [t[3] for t in said]


def test_classifier_on_held_out_labels(spark):
    """Held-out documents, against the share of the larger class and each view alone."""
    d = "/root/testdata/sf0.1"
    frames = [spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels", "pages")]
    known = frames[1].where("doc_id % 3 <> 0")
    scores = collected(cotraining.classify(frames[0], known, frames[2]), "doc_id", "p_text", "p_meta", "score", "kept")
    held = frames[1].where("doc_id % 3 = 0").collect()
    good = {r["doc_id"]: r["quality"] == 1 and r["toxic"] == 0 for r in held}
    share = lambda says: sum(says(scores[i]) == y for i, y in good.items()) / len(good)
    most = max(sum(good.values()), len(good) - sum(good.values())) / len(good)
    assert len(scores) == frames[0].count() and share(lambda s: s[3]) >= 0.92 > most + 0.1
    assert share(lambda s: s[3]) >= max(share(lambda s: s[0] >= 0.5), share(lambda s: s[1] >= 0.5)) - 0.005
    low = [r["doc_id"] for r in held if r["quality"] == 0]
    assert sum(scores[i][3] for i in low) <= 0.1 * len(low)


def plain_logistic(x, y, ridge):
    """Newton's method on dense rows, the intercept last and free."""
    x = np.column_stack([x, np.ones(len(y))])
    w, r = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, ridge), 0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(r + 1e-12), x.T @ (p - y) / len(y) + r * w)
    return w


def test_co_training_against_a_plain_version(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.6
        pick = lambda yes, no: rng.choice(yes if (rng.random() < 0.9) == good else no)
        rows.append((i, " ".join(pick("abcd", "wxyz") for _ in range(6)), pick(["en"], ["de"]), pick(["s1", "s2"], ["s3"]), 100))
        if i % 3 == 0:
            labels.append((i, int(good), 0))
    docs_ = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(1, "http://h/1", "x")], "page_id long, url string, html string")
    got = collected(cotraining.classify(docs_, known, pages, ridge=0.02, steps=400, confident=0.8), "doc_id", "p_text", "p_meta", "score")
    views = cotraining._views(docs_, cotraining.page_metadata(pages), known.selectExpr("doc_id", "cast(quality as double) good"))
    views = views.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(cotraining.HELD_OUT))).orderBy("doc_id").collect()

    def dense(view):
        used = sorted({f for r in views for f in r[view]})
        return np.array([[f in set(r[view]) for f in used] for r in views], float)

    x = {view: dense(view) for view in ("text", "meta")}
    good, fold = np.array([np.nan if r["good"] is None else r["good"] for r in views]), np.array([r["fold"] for r in views])
    free, train, held = np.isnan(good), ~np.isnan(good) & (fold > 0), ~np.isnan(good) & (fold == 0)
    logit = lambda w, view: x[view] @ w[:-1] + w[-1]
    sets = {view: (train, good) for view in x}
    for k in range(cotraining.ROUNDS + 1):
        w = {view: plain_logistic(x[view][m], y[m], 0.02) for view, (m, y) in sets.items()}
        for view, other in (("text", "meta"), ("meta", "text")):
            z = logit(w[view], view)
            sure = free & (np.abs(z) >= np.log(4))
            sets[other] = (train | sure, np.where(sure, z > 0, good))
    z = np.column_stack([logit(w[v], v) for v in ("text", "meta")])
    scale = [cotraining.calibrate(z[held, k : k + 1], good[held]) for k in (0, 1)]
    both = np.column_stack([z[:, k] * scale[k][0] + scale[k][1] for k in (0, 1)])
    last = cotraining.calibrate(both[held], good[held])
    want = 1 / (1 + np.exp(-(both @ last[:2] + last[2])))
    assert max(abs(got[i][2] - want[i]) for i in range(400)) < 0.02


def test_classifier_on_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, good string, view string, features string"
    text = lambda i: ("fine words here " if i % 2 else "bad stuff there ") * 5 + f"n{i}"
    rows = [(i, text(i), "en", None, 9, "x", "y", "z") for i in range(60)] + [(None, None, None, None, None, "x", "y", "z"), (70, "", "en", "s", 0, "x", "y", "z"), (5, text(5), "en", None, 9, "x", "y", "z"), (71, "fine " * 200_000, None, "s", 1, "x", "y", "z")]
    frame = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([*[(i, i % 2, 0) for i in range(40)], (3, 0, 1), (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(1, "http://h/1", "x"), (2, None, None), (3, "http://h/1", "y")], "page_id long, url string, html string")
    got = cotraining.classify(frame, labels, pages).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got) and sum(r["doc_id"] == 5 for r in got) == 2
    assert sum((r["score"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in got if r["doc_id"] is not None and 40 <= r["doc_id"] < 60) >= 18
    none = cotraining.classify(frame, labels.limit(0), pages)
    assert none.where("score is null and kept").count() == len(rows)
    assert cotraining.classify(frame.limit(0), labels, pages).isEmpty()


def test_empty_tables(spark):
    nothing = docs(spark, [(1, "x")]).limit(0)
    assert suffix.deduplicate(nothing).isEmpty() and substring.deduplicate(nothing).isEmpty() and minhash.near_duplicates(nothing).isEmpty()
    assert packing.pack_documents(nothing, tokenizer_path()).isEmpty() and sharding.shard_rows(nothing).isEmpty()
    assert mixing.mix(nothing).isEmpty() and quality.judge(nothing).isEmpty() and quality.keep(nothing).isEmpty()
    assert covertree.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).isEmpty()
    assert chat.rotate_perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).isEmpty()


def test_repeated_and_null_ids(spark):
    rows = docs(spark, [(1, "a b c d e f g " * 20), (1, "a b c d e f g " * 20), (None, "a b c d e f g " * 20), (None, None)])
    for frame in (suffix.deduplicate(rows), substring.deduplicate(rows), minhash.near_duplicates(rows), sharding.shard_rows(rows), mixing.mix(rows), quality.judge(rows)):
        assert sorted((r["doc_id"] is None) for r in frame.collect()) == [False, False, True, True]
    lost = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in substring.deduplicate(rows).collect()}
    assert lost == {(1, 140): 0, (None, 140): 140, (None, 0): 0}


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    d = DATA
    frame = spark.read.parquet(f"{d}/documents.parquet")
    kept = pipeline.quality_rules(spark, frame, d)
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    near = {i for i, (_, _, yes) in brute.near(list(texts.items())).items() if yes}
    single = pipeline.minmax_near_dedup(spark, kept, d)
    assert {r["doc_id"] for r in single.collect()} == near and single.columns == frame.columns
    left = pipeline.suffix_dedup(spark, single, d)
    want = brute.suffix([(i, texts[i]) for i in near])
    for r in left.collect():
        assert r["n_chars"] == len(r["text"]) and len(r["text"].encode()) <= want[r["doc_id"]][0] - want[r["doc_id"]][1]
    assert {r["doc_id"] for r in left.collect()} == {i for i, w in want.items() if w[0] > w[1]} and left.columns == frame.columns
    whole = {i: t.encode() for i, t in texts.items() if i in near}
    cut = {r["doc_id"]: bytes(r["kept"]) for r in suffix.deduplicate(single).collect()}
    for r in left.collect():
        # the bytes that stay, but for characters that a cut left incomplete
        assert hashlib.sha256(cut[r["doc_id"]]).hexdigest() == want[r["doc_id"]][3] and len(cut[r["doc_id"]]) <= len(whole[r["doc_id"]])
        assert r["text"] == cut[r["doc_id"]].decode(errors="replace").replace("\ufffd", "")
    mixed = pipeline.source_mixing(spark, left, d)
    assert mixed.columns == frame.columns
    packed = pipeline.best_fit_packing(spark, mixed, d)
    assert packed.where("piece = 0").count() == mixed.count()
    assert json.dumps([name for name, _ in pipeline.STAGES]) == json.dumps(["quality rules", "min-max near-dedup", "suffix dedup", "source mixing", "best-fit packing"])


def test_pipeline_on_odd_tables(spark):
    """Nulls in every column, repeated rows, and further columns whose names the operators use themselves."""
    import corpus_pipeline as pipeline

    frame = spark.read.parquet(f"{DATA}/documents.parquet")
    empty = spark.createDataFrame([(None, None, None, None, None), (9001, None, "en", "src0", 0), (9002, "", None, None, None)], frame.schema)
    frame = frame.unionByName(frame.limit(3)).unionByName(empty)
    extra = "'k' as kept, 1 as id, 2 as size, 'c' as shard, array(1) as keys, 3 as row, 'd' as d2, 4 as shuffle, 5 as component_id, 6 as also_0, 7 as `odd name`"
    frame = frame.selectExpr("*", *extra.split(", "))
    for rows in (frame, frame.limit(0)):
        docs_ = rows
        for name, stage in pipeline.STAGES[:-1]:
            out = stage(spark, docs_, DATA)
            assert out.columns == frame.columns, name
            got = out.collect()
            assert all(tuple(r)[5:] == ("k", 1, 2, "c", [1], 3, "d", 4, 5, 6, 7) for r in got), name
            docs_ = spark.createDataFrame(got, out.schema)
        packed = pipeline.best_fit_packing(spark, docs_, DATA)
        assert packed.where("piece = 0").count() == docs_.count() and (docs_.count() > 20) == (rows is frame)
