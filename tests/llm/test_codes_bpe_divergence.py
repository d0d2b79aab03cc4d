import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tideline.llm import bpe, divergence, gnat
from tideline.llm.queries import op11_gnat_vector_codes, op12_bpe_round_trip, tokenizer_path

DATA = "/root/testdata/sf0.001"
RANKS = tokenizer_path("byte_bpe_50k.tiktoken")


def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# vector codes


def plain_codes(rows, rounds=6, parts=8, entries=16):
    """vec_id: code and error, by looking at every entry; rows are (vec_id, vector) in the order of ids."""
    ints = [(i, [int(np.floor(4096 * c)) for c in v]) for i, v in rows]
    width = len(ints[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v in ints[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(book))

    for _ in range(rounds):
        after = []
        for p in range(parts):
            own = defaultdict(list)
            for _, v in ints:
                own[near(cut(v, p), books[p])[1]].append(cut(v, p))
            after.append([[sum(c) // len(own[e]) for c in zip(*own[e])] if e in own else y for e, y in enumerate(books[p])])
        books = after
    found = {i: [near(cut(v, p), books[p]) for p in range(parts)] for i, v in ints}
    digest = hashlib.sha256(",".join(str(c) for part in books for y in part for c in y).encode()).hexdigest()
    return {i: ("".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for i, f in found.items()}, digest


SCHEMA = "vec_id long, label int, embedding array<float>, code string, x int, n int"


def vectors(spark, rows):
    """Rows (vec_id, label, vector) with columns of clashing names."""
    return spark.createDataFrame([(*r, "c", 1, 2) for r in rows], SCHEMA).repartition(3)


def test_gnat_finds_the_nearest_and_drops_subtrees():
    rng = np.random.default_rng(5)
    spared = 0
    for spread in (3, 40, 4000):
        for n in (1, 2, 4, 5, 16, 60):
            centres = rng.integers(-4000, 4000, (5, 8))
            entries = (centres[rng.integers(0, 5, n)] + rng.integers(-spread, spread, (n, 8))).astype(np.int64)
            entries[n // 2] = entries[0]  # ties
            queries = np.concatenate([entries, centres[rng.integers(0, 5, 200)] + rng.integers(-spread, spread, (200, 8)), entries[rng.integers(0, n, 50)] + rng.integers(-1, 2, (50, 8))])
            index, d2, measured = gnat.nearest(gnat.build(entries), entries, queries)
            all_d2 = ((queries[:, None] - entries[None]) ** 2).sum(2)
            assert (index == all_d2.argmin(1)).all() and (d2 == all_d2.min(1)).all()
            spared += measured < 0.6 * all_d2.size
    assert spared >= 4  # clustered entries


def test_a_wrong_range_gives_wrong_codes():
    """The ranges decide what is looked at: halved ones lose entries."""
    rng = np.random.default_rng(1)
    entries = rng.integers(-1000, 1000, (16, 8))
    tree = gnat.build(entries)
    tree.high /= 2
    queries = rng.integers(-1000, 1000, (500, 8))
    assert (gnat.nearest(tree, entries, queries)[0] != ((queries[:, None] - entries[None]) ** 2).sum(2).argmin(1)).any()


def test_codes_against_every_entry(spark):
    rng = random.Random(3)
    good = [(k, (None, 1, 2)[k % 3], [rng.choice([-0.25, 0.1, 0.5]) + rng.random() / 50 for _ in range(16)]) for k in range(60)]
    good[40] = (40, 1, good[3][2])
    good[41] = (41, None, [0.0] * 16)
    # 65 and 66 are in the table, but cannot be coded
    odd = [(61, 1, None), (62, 1, [None] * 16), (63, 1, [float("nan")] * 16), (64, 2, [float("inf")] + [0.0] * 15), (65, 2, [1e30] * 16), (66, 7, [0.5] * 8), (0, 7, [])]
    frame, books = gnat.compress(vectors(spark, good + odd))
    got = {(r["vec_id"], r["code"] is None): r for r in frame.collect()}
    want, digest = plain_codes([(i, [float(np.float32(c)) for c in v]) for i, _, v in good])
    assert {i: (r["code"], r["error"]) for (i, bare), r in got.items() if not bare} == want and books.digest() == digest
    assert sorted(i for i, bare in got if bare) == [0, 65, 66] and got[65, True]["error"] is None
    labels = defaultdict(int)
    for i, label, _ in good:
        labels[label] += want[i][1]
    assert all(r["label_error"] == labels[r["label"]] for r in got.values())


def test_codes_of_small_tables(spark):
    frame, books = gnat.compress(vectors(spark, [(1, 1, [0.5] * 8), (1, 1, [0.25] * 8), (None, 2, [0.5] * 8)]))
    assert books.entries.shape == (8, 3, 1)
    # the smaller of the vectors of id 1 comes first, and entries that tie go to the lower number
    assert sorted((r["vec_id"] or 0, r["code"], r["error"]) for r in frame.collect()) == [(0, "01" * 8, 0), (1, "00" * 8, 0), (1, "01" * 8, 0)]
    for rows in ([], [(1, 1, None)], [(1, 1, [])]):
        frame, books = gnat.compress(vectors(spark, rows))
        assert books is None and frame.where("code is not null").isEmpty()


def test_codes_of_the_table(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").where("embedding is not null").orderBy("vec_id").select("vec_id", "embedding").collect()]
    want, digest = plain_codes(rows)
    got = op11_gnat_vector_codes(spark, DATA).collect()
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == want and {r["codebooks_sha256"] for r in got} == {digest}


# byte-level BPE


def small_vocabulary(rng):
    voc = bpe.Vocabulary.__new__(bpe.Vocabulary)
    tokens = [bytes([b]) for b in b"abc"]
    while len(tokens) < rng.choice([5, 10, 25]):
        new = rng.choice(tokens) + rng.choice(tokens)
        if new not in tokens and len(new) < 12:
            tokens.append(new)
    rng.shuffle(tokens)
    voc.ranks = {t: k for k, t in enumerate(tokens)}
    voc.tokens = dict(enumerate(tokens))
    voc._pairs, voc._kept, voc._halves = {}, {}, {}
    return voc


def by_definition(data, ranks):
    parts = [data[i : i + 1] for i in range(len(data))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_the_tree_gives_the_plain_encoding():
    rng, widened = random.Random(11), 0
    for _ in range(300):
        voc = small_vocabulary(rng)
        data = bytes(rng.choice(b"abc" if rng.random() < 0.7 else b"ab") for _ in range(rng.randrange(1, 60)))
        if rng.random() < 0.2:
            data = data[:2] * 25
        want = by_definition(data, voc.ranks)
        assert voc.merged(data) == want
        leaves = [voc.merged(data[i : i + 3]) for i in range(0, len(data), 3)]
        assert bpe.fold(leaves, voc.join, []) == want and voc.halves(data) == want
        at = rng.randrange(len(data) + 1)
        assert voc.join(voc.merged(data[:at]), voc.merged(data[at:])) == want
        widened += voc.merged(data[:at]) + voc.merged(data[at:]) != want
    assert widened > 50  # many joins change tokens at the boundary


ODD = [None, "", " ", "\n", "  \n\t  x", "a", "a" * 3000, "ab" * 2000, " " * 2500, "\x00\x1c\x85 ", "don't I'LL we've", "🙂" * 40, "éé" * 9, "ﷺ", "1234567 ١٢٣", "<|endoftext|>",
       "x" + "!?" * 300, "漢字かな交じり文" * 30, "Ünïcödé" * 20, "�", "supercalifragilisticexpialidocious" * 20]


def test_ids_and_bytes_as_the_library(spark):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("ab cd'é\n1🙂.") for _ in range(rng.randrange(200))) for _ in range(100)]
    rows = spark.createDataFrame([(k // 2, t, 5, "x") for k, t in enumerate(texts)], "doc_id long, text string, ids int, decoded string").repartition(3)
    own, pattern = library(), public_tokenizers.PATTERN
    encoded = bpe.encode(rows, RANKS, pattern)
    got = bpe.decode(encoded, RANKS, pattern).collect()
    want = sorted((k // 2, own.encode_ordinary(t or "")) for k, t in enumerate(texts))
    assert sorted((r["doc_id"], r["ids"]) for r in got) == want
    assert sorted(bytes(r["decoded"]) for r in got) == sorted((t or "").encode() for t in texts)
    assert bpe.decode(bpe.encode(rows.limit(0), RANKS, pattern), RANKS, pattern).count() == 0


def test_ids_that_are_no_tokens_have_no_bytes(spark):
    rows = spark.createDataFrame([(1, [64]), (2, [64, 10**6]), (3, [None, 64]), (4, None), (5, []), (6, [-1]), (None, [65, 66])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] and bytes(r["decoded"]) for r in bpe.decode(rows, RANKS, public_tokenizers.PATTERN).collect()}
    tokens = bpe.vocabulary(RANKS, public_tokenizers.PATTERN).tokens
    assert got == {1: tokens[64], 2: None, 3: None, 4: None, 5: b"", 6: None, None: tokens[65] + tokens[66]}


def test_invalid_bytes_count_as_replacement_characters(spark):
    rows = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("cast(unhex('61FF62') as string)").alias("text"))
    assert bpe.encode(rows, RANKS, public_tokenizers.PATTERN).first()["ids"] == library().encode_ordinary("a�b")


def test_round_trip_of_the_table(spark):
    own = library()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        ids = own.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), sha(" ".join(map(str, ids)).encode()), sha((r["text"] or "").encode()))
    got = op12_bpe_round_trip(spark, DATA).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want


# divergence of sources


def plain_audit(rows, least, top=50):
    """Rows (lang, source, part, item, value, rank) straight from the definition."""
    count, documents, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate({k: k + 32 for k in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        count[lang, source].update(terms)
        documents[lang].update(set(terms))
        langs[lang].add(source)
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in documents[lang].items() if n >= least]
        whole = Counter()
        for s in sources:
            whole.update(count[lang, s])

        def p(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}

        q, each = p(whole), {s: p(count[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(each[s][t] - each[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(each[s][t] - q[t], t) for t in kept if count[lang, s][t] and each[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("block", [8, 1 << 14])
def test_audit_against_its_definition(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "STRETCH", 50)
    rng = random.Random(4)
    names = "zeta Alpha alpha beta é É 漢字 x1y don't \x00nul\x7f under_score naïve end".split(" ")
    rows = [(" ".join(rng.choices(names, k=rng.randrange(60))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s10", None, "ß"])) for _ in range(150)]
    rows += [(None, "en", "silent"), ("", "fr", "only"), ("rare words here", "fr", "only"), ("", "it", "a"), (None, "it", "b"), ("tie tie", "xx", "a"), ("tie tie", "xx", "a"), ("tie tie", "xx", "b"), ("tie tie", "xx", "b")]
    frame = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, n int, term string").repartition(4)
    got = sorted(tuple(r) for r in divergence.audit(frame, least=4, top=5).collect())
    assert got == plain_audit(rows, 4, 5)
    assert divergence.audit(frame.limit(0)).count() == 0


def test_probabilities_are_exact_beyond_64_bits(spark):
    rows = [(10**12 + 7, 3 * 10**13 + 11, 1000), (0, 0, 1), (9 * 10**15, 9 * 10**15, 1), (1, 7, 3)]
    got = spark.createDataFrame(rows, "n long, total long, v long").select("n", "total", "v", divergence.probability("n", "total", "v").alias("p")).collect()
    assert [r["p"] for r in got] == [1 + 10**9 * (n + 5) // (t + 5 * v) for n, t, v in rows]
