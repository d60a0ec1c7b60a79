"""Vector codes, Merkle manifests and piecewise hashes against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwatch.llm import fuzzy_hash, merkle, vector_codes

# --- vector codes


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """(id, code, error) of rows (id, vector, label), with Python integers."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    dim = len(min(kept, key=lambda r: (r[0] is None, r[0] or 0))[1])
    kept = [r for r in kept if len(r[1]) == dim]
    cuts = [p * dim // parts for p in range(parts + 1)]
    starts = {}
    for i, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        starts.setdefault(i, v)
    books = [[v[a:b] for v in list(starts.values())[:entries]] for a, b in zip(cuts, cuts[1:], strict=False)]

    def choose(v):
        out = []
        for p, book in enumerate(books):
            part = v[cuts[p] : cuts[p + 1]]
            out.append(min((sum((x - y) ** 2 for x, y in zip(part, e, strict=True)), j) for j, e in enumerate(book)))
        return out

    for _ in range(rounds):
        members = {}
        for _, v, _ in kept:
            for p, (_, j) in enumerate(choose(v)):
                members.setdefault((p, j), []).append(v[cuts[p] : cuts[p + 1]])
        for (p, j), some in members.items():
            books[p][j] = [sum(c) // len(some) for c in zip(*some, strict=True)]
    coded = [(i, label, choose(v)) for i, v, label in kept]
    out = [(i, label, "".join(f"{j:02x}" for _, j in c), sum(d for d, _ in c)) for i, label, c in coded]
    totals = {}
    for _, label, _, error in out:
        totals[label] = totals.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted((repr((i, code, error, totals[label], digest)) for i, label, code, error in out))


def coded(spark, rows, **also):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    out = vector_codes.compress(df.withColumn("error", F.lit("x")).withColumn("_v", F.lit(1)), **also)
    return sorted(repr(tuple(r)) for r in out.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def vectors(n, dim, seed, scale=1.0):
    random.seed(seed)
    middles = [[random.gauss(0, scale) for _ in range(dim)] for _ in range(9)]
    f32 = [[float(np.float32(x + random.gauss(0, scale / 3))) for x in random.choice(middles)] for _ in range(n)]
    return [(i * 3, v, random.choice([1, 2, None])) for i, v in enumerate(f32)]


@pytest.mark.parametrize(("n", "dim", "scale"), [(300, 32, 1.0), (40, 16, 0.01), (150, 37, 2e4), (90, 5, 1.0), (1, 16, 1.0)])
def test_codes_equal_brute_force(spark, n, dim, scale):
    rows = vectors(n, dim, n, scale)
    assert coded(spark, rows) == brute_codes(rows)


def test_codes_of_odd_rows(spark):
    rows = vectors(120, 16, 5)
    hot = rows[7][1]
    odd = [(900 + i, hot, 1) for i in range(200)] + [(2, None, 1), (2, [], 1), (2, [1.0], 2), (2, [None] * 16, 2), (2, [math.nan] * 16, 2), (2, [math.inf] * 16, None), rows[0], rows[0], (None, hot, None), (3, hot, 1)]
    assert coded(spark, rows + odd) == brute_codes(rows + odd)
    assert coded(spark, [(1, None, 1), (2, [], None)]) == []
    assert coded(spark, []) == []


def test_saturated_components_have_a_code_and_an_error(spark):
    rows = [(i, [float(10 ** (i * 3))] * 16, 1) for i in range(12)] + [(99, [-3e38] * 16, 1)]
    out = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert len(out) == 13 and all(r.error is not None and r.error >= 0 for r in out)


def test_labels_beyond_the_broadcast_bound_give_the_same(spark, monkeypatch):
    rows = vectors(80, 16, 3)
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    assert coded(spark, rows) == brute_codes(rows)


def test_only_parts_that_change_their_entry_move(spark):
    rows = vectors(400, 16, 8)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select(F.col("embedding").cast("array<double>").alias("v"))
    first = vector_codes.integers(np.array([v for _, v, _ in rows[:64]]))
    books = vector_codes.Codebooks(16, [first[:, p : p + 1] for p in range(16)])
    before = vector_codes._settle(df, books, 4)
    after = vector_codes._migrate(before, vector_codes._update(before, books), 4)
    n = {name: table.agg(F.sum(F.length("counts") / 8)).first()[0] for name, table in (("before", before), ("after", after))}
    assert n["after"] >= n["before"] > 0  # blocks of arrivals may repeat a part
    total = "aggregate(sequence(1, cast(length(counts) / 8 as int)), 0L, (a, i) -> a + conv(hex(reverse(substring(counts, 8 * i - 7, 8))), 16, 10))"
    assert [t.agg(F.sum(F.expr(total.replace("reverse(substring(counts, 8 * i - 7, 8))", "substring(counts, 8 * i - 7, 1)")))).first()[0] for t in (before, after)] == [400 * 16] * 2
    moved = [r for r in after.collect() if r.entry is not None]
    assert {(r.position, r.entry) for r in moved} <= {(p, e) for p in range(16) for e in range(64)}


def test_decoding_gives_the_entries_named(spark):
    rows = vectors(70, 16, 4)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    books = vector_codes.fit_codebooks(df, rounds=1)
    for r in vector_codes.decode(vector_codes.encode(df, books), books).collect():
        want = [x / 256 for p, b in enumerate(books.books) for x in b[int(r.code[2 * p : 2 * p + 2], 16)]]
        assert r.decoded == want
    with pytest.raises(ValueError):
        vector_codes.fit_codebooks(df, entries=257)


# --- Merkle manifests


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(row):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def brute_tree(nodes, arity):
    """The root and, for each leaf, the levels of (left, right) siblings."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, j in enumerate(place):
            first = j - j % arity
            paths[leaf].append((nodes[first:j], nodes[j + 1 : first + arity]))
        place = [j // arity for j in place]
        nodes = [sha("".join(nodes[j : j + arity])) for j in range(0, len(nodes), arity)]
    return nodes[0], paths


def brute_manifest(rows, arity=2):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    for g in groups:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([brute_leaf(r) for r in groups[g]], arity) for g in order}
    root, tops = brute_tree([trees[g][0] for g in order], arity)
    out = []
    for g, top in zip(order, tops, strict=True):
        for r, path in zip(groups[g], trees[g][1], strict=True):
            value = brute_leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                value = brute_leaf((*r[:3], r[3] + 1, r[4]))
            for left, right in path + top:
                value = sha("".join([*left, value, *right]))
            proof = sha("".join(x for a, b in path + top for x in [*a, *b]))
            out.append(repr((r[0], brute_leaf(r), trees[g][0], root, proof, value, value == root)))
    return sorted(out)


DOC = "doc_id long, source string, lang string, n_chars long, text string"


def proved(spark, rows, **also):
    df = spark.createDataFrame(rows, DOC).repartition(3).withColumn("i", F.lit(1)).withColumn("g", F.lit("x"))
    tamper = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return sorted(repr(tuple(r)) for r in merkle.manifest(df, tamper=tamper, changed={"n_chars": F.col("n_chars") + 1}, **also).collect())


def doc_rows(n, langs, seed=1):
    random.seed(seed)
    ids = random.sample(range(-50, 10 * n), n)
    return [(i, random.choice(["web", None]), random.choice(langs), random.choice([None, 3, 10**12]), random.choice(["", None, "text é 漢", "x" * 50])) for i in ids]


@pytest.mark.parametrize(("n", "langs", "arity", "height"), [(150, ["de", "en", None], 2, 10), (150, ["de", "en", None, ""], 2, 2), (61, ["en"], 2, 1), (90, ["a", "b", "é"], 3, 2), (1, ["en"], 2, 10), (33, [str(i) for i in range(40)], 2, 3)])
def test_manifest_equals_brute_force(spark, n, langs, arity, height):
    rows = doc_rows(n, langs)
    assert proved(spark, rows, arity=arity, height=height) == brute_manifest(rows, arity)


def test_manifest_of_odd_rows(spark, monkeypatch):
    rows = doc_rows(20, ["en", None])
    odd = rows + [rows[0]] * 3 + [(None, None, None, None, None)] * 2 + [(5, "s", "en", 1, "y" * 300_000), (5, "s", "en", 1, "z")]
    assert proved(spark, odd) == brute_manifest(odd)
    monkeypatch.setattr(merkle, "BROADCAST_OFFSETS", 0)
    assert proved(spark, odd, height=1) == brute_manifest(odd)
    assert proved(spark, []) == []


def test_a_fold_hashes_nothing_left_of_the_path(monkeypatch):
    block = merkle.Block([sha(str(i)).encode() for i in range(27)], 3, None)
    want, _ = brute_tree([sha(str(i)) if i != 17 else sha("new") for i in range(27)], 3)
    assert block.fold(17, sha("new").encode()).decode() == want
    block.nodes = [[None if i < j else x for i, x in enumerate(level)] for level, j in zip(block.nodes, (17, 5, 1, 0), strict=True)]
    assert block.fold(17, sha("new").encode()).decode() == want


# --- piecewise hashes


def brute_fingerprint(text):
    """The rule of the module's docstring, byte by byte."""
    data = text.encode()
    ends = []
    for i in range(len(data)):
        window = [data[i - j] if i >= j else 0 for j in range(7)]
        mixed = 0
        for j, x in enumerate(window):
            mixed ^= x << 5 * j & 0xFFFFFFFF
        ends.append((sum(window) + sum(x * (7 - j) for j, x in enumerate(window)) + mixed) % 2**32)

    def cuts(level):
        size = 3 << level
        return [i for i, r in enumerate(ends) if r % size == size - 1]

    few = [k for k in range(40) if len(cuts(k)) <= 1024]
    level = max([k for k in few if len(cuts(k)) >= 32], default=few[0])

    def signature(level):
        out, start = "", 0
        for end in sorted({*cuts(level), len(data) - 1} - {-1}):
            total = sum((x + 1) * pow(6364136223846793005, n % 65536 + 1, 2**64) for n, x in enumerate(data[start : end + 1])) % 2**64
            total ^= total >> 29
            out += fuzzy_hash.PAIRS[total * 0xBF58476D1CE4E5B9 % 2**64 >> 52]
            start = end + 1
        return out

    return f"{level}:{signature(level)}:{signature(level + 1)}"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_likeness(a, b):
    (i, *one), (j, *two) = a.split(":"), b.split(":")
    best = float(a == b)
    for k, x in enumerate(one):
        for n, y in enumerate(two):
            if int(i) + k == int(j) + n and x and y:
                p, q = ([s[m : m + 2] for m in range(0, len(s), 2)] for s in (x, y))
                best = max(best, 1 - levenshtein(p, q) / max(len(p), len(q)))
    return best


def brute_documents(rows):
    ordered = sorted(rows, key=lambda r: -math.inf if r[0] is None else r[0], reverse=True)
    out = []
    for (i, text), (_, after) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        text, after = text or "", after or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        a, b, c = map(brute_fingerprint, (text, edited, after))
        out.append(repr((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, brute_likeness(a, b), brute_likeness(a, c))))
    return sorted(out)


def texts_of(n, seed=2):
    random.seed(seed)
    letters = "abcdefghij é漢𝄞\n"
    return ["".join(random.choice(letters) for _ in range(random.choice([0, 1, 2, 5, 40, 300, 900]))) for _ in range(n)]


@pytest.mark.parametrize("n", [1, 2, 45])
def test_fingerprints_equal_brute_force(spark, n):
    rows = list(zip(random.sample(range(1000), n), texts_of(n), strict=True))
    if n > 10:
        rows += [(2000, None), (None, "no id"), (2001, "the same line\n" * 40), (2002, "the same line\n" * 40), (2003, "a" * 500), (2004, "abc" * 1500), (2005, " ".join(random.choices(["one", "two", "three"], k=400)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("range", F.lit("x")).withColumn("id", F.lit(0))
    out = fuzzy_hash.fingerprints(df).collect()
    assert sorted(repr(tuple(r)) for r in out) == brute_documents(rows)


def test_no_documents_no_fingerprints(spark):
    assert fuzzy_hash.fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_repeated_rows_follow_each_other(spark):
    rows = [(1, "x" * 90), (1, "x" * 90), (1, "y" * 90), (1, None)]
    out = fuzzy_hash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 4 and len({r.fingerprint for r in out}) == 3 and sum(r.near_next == 1 for r in out) == 1


def test_stretches_do_not_show(monkeypatch):
    texts = [t.encode() for t in texts_of(30)]
    want = [fuzzy_hash.fingerprint(t) for t in texts]
    for stretch in (7, 100):
        monkeypatch.setattr(fuzzy_hash, "STRETCH", stretch)
        assert [fuzzy_hash.fingerprint(t) for t in texts] == want


def test_edit_distance_equals_the_table_of_all():
    random.seed(4)
    for _ in range(300):
        a, b = ([random.choice("abcd") for _ in range(random.randint(0, 80))] for _ in range(2))
        assert fuzzy_hash.edit_distance(a, b) == levenshtein(a, b)


def test_a_small_edit_leaves_most_of_a_long_text_alike():
    text = " ".join(random.Random(3).choices(["one", "two", "three", "four", "five", "six", "seven"], k=3000))
    other = text[:7000] + "a sentence put in" + text[7000:]
    assert fuzzy_hash.likeness(*(fuzzy_hash.fingerprint(t.encode()) for t in (text, other))) > 0.9
