"""MinHash near-dedup, Merkle manifest and embedding whitening against brute force."""

import hashlib
import random
import re
import string
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from palinode.llm.merkle import fold, leaf_digest, merkle_manifest, proof_digest
from palinode.llm.minhash import _agreeing, _histograms, least_agreements, minhash_components
from palinode.llm.queries import QUERIES
from palinode.llm.whitening import (
    charpoly_mod, components, fit_whitening, greatest_roots, primes_below, whiten,
)

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "a", "A", "a b", "a b c", "É é ß 日本語", "x" * 5000, " ".join(f"w{i}" for i in range(30_000)),
       "same text here twice", "same text here twice"]


def sets_of(text, n=2):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows):
    """{id: component} of (id, text) rows, all pairs compared."""
    sets, root = [(i, sets_of(t)) for i, t in rows], {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and 5 * len(x & y) >= 4 * len(x | y):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: find(i) for i in root}


def altered(text, share, rng):
    return " ".join(f"{w}x{rng.random()}" if rng.random() < share else w for w in text.split())


@pytest.fixture(scope="module")
def near(spark):
    """Chains, groups and near misses: 40 texts, each with altered copies of several degrees."""
    rng, rows = random.Random(5), []
    for t in range(40):
        base = " ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 6, 12, 40, 120])))
        for k in range(6):
            rows.append((7 * len(rows) % 241, altered(base, [0, 0.02, 0.05, 0.08, 0.12, 0.2][k], rng)))
    return rows


def test_minhash_finds_the_components_of_all_pairs(spark, near):
    df = spark.createDataFrame(near, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_components(df).collect()}
    want = brute(near)
    assert got == {i: (len(sets_of(t)), want[i]) for i, t in near}


def test_minhash_on_odd_rows(spark):
    rows = [*enumerate(ODD), (None, "same text here twice"), (3, "same text here twice"), (3, "same text here twice"), (50, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"id": F.lit(1), "node": F.lit("x"), "key": F.lit(0), "n": F.lit(None).cast("int")})
    want = brute(rows)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash_components(df).collect()), key=str)
    assert got == sorted(((i, len(sets_of(t)), want.get(i)) for i, t in rows), key=str)
    assert minhash_components(df.where("false")).count() == 0


def test_minhash_chain_and_large_group(spark):
    """Steps of a chain are alike, its ends are not; a group of many near copies has one component."""
    words = [f"c{i}" for i in range(300)]
    rows = [(i, " ".join(words[10 * i:10 * i + 150])) for i in range(10)]
    rng = random.Random(2)
    base = " ".join(f"g{i}" for i in range(200))
    rows += [(100 + i, altered(base, 0.03, rng)) for i in range(300)]
    got = {r.doc_id: r.component_id for r in minhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_pruning_loses_hardly_a_pair_at_the_threshold():
    rng = np.random.default_rng(3)
    for n in (32, 96, 250):
        least = least_agreements(n, 0.8, 1e-9)
        assert (rng.binomial(n, 0.8, 200_000) < least).sum() == 0
        assert (rng.binomial(n, 0.3, 10_000) < least).mean() > 0.8 or n == 32


def test_agreeing_bytes(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 4, (2, 500, 8), dtype=np.uint8)
    rows = list(zip(a.view(np.int64).ravel().tolist(), b.view(np.int64).ravel().tolist()))
    got = spark.createDataFrame(rows, "a long, b long").select(_agreeing(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == (a == b).sum(1).tolist()


# ---- Merkle manifest ---------------------------------------------------------------------------------

def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def tree(hashes, arity=8):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def path_of(levels, i, arity=8):
    out = []
    for nodes in levels[:-1]:
        at = i // arity * arity
        out.append(("".join(nodes[at:i]), "".join(nodes[i + 1:at + arity])))
        i //= arity
    return out


def framed(values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def manifest(rows, arity=8):
    """[(key, group, leaf, subroot, root, path)] of (key, group, leaf) rows."""
    groups = {}
    for key, group, leaf in rows:
        groups.setdefault(group, []).append((key, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {g: tree([leaf for _, leaf in groups[g]], arity) for g in names}
    top = tree([trees[g][-1][0] for g in names], arity)
    return [(key, g, leaf, trees[g][-1][0], top[-1][0], path_of(trees[g], i, arity) + path_of(top, k, arity))
            for k, g in enumerate(names) for i, (key, leaf) in enumerate(groups[g])]


def test_merkle_query_against_recomputation(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    own = manifest([(r.doc_id, r.lang, framed([r[f] for f in fields])) for r in docs])
    texts, want = {r.doc_id: r for r in docs}, {}
    for key, _, leaf, subroot, root, path in own:
        r, at = texts[key], leaf
        if zlib.crc32(str(key).encode()) % 3 == 0:
            low = r.text and r.text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
            at = framed([r.doc_id, r.source, r.lang, r.n_chars, low])
        for left, right in path:
            at = sha(left, at, right)
        want[key] = (leaf, subroot, root, sha(*[s for run in path for s in run]), at, at == root)
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_merkle_manifest"](spark, SMALL).collect()}
    assert got == want
    assert 0 < sum(not w[-1] for w in want.values()) < len(want)


@pytest.mark.parametrize("n, arity", [(0, 8), (1, 8), (8, 8), (9, 8), (65, 8), (513, 8), (30, 2), (30, 3)])
def test_merkle_shapes(spark, n, arity):
    """Full, single and ragged runs; many groups; null, empty and odd names; repeated rows."""
    groups = [None, "", "a", "é", "b", "日", *[f"g{i}" for i in range(12)]]
    rows = [(i % 40 if i % 7 else None, groups[i * i % len(groups)] if i % 3 else "a", f"leaf{i % 29}") for i in range(n)]
    df = spark.createDataFrame(rows, "k long, g string, h string").withColumns(
        {"group": F.lit(1), "idx": F.lit(2), "path": F.lit("p"), "slot": F.lit(None).cast("int")})
    made = merkle_manifest(df, F.sha2(F.col("h").cast("binary"), 256), "k", "g", carry=["h", "slot"], arity=arity).collect()
    got = [(r.k, r.g, r.leaf, r.subroot, r.root, [tuple(p) for p in r.path]) for r in made]
    want = manifest([(k, g, sha(h)) for k, g, h in rows], arity)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(sha(r.carried.h) == r.leaf for r in made)


def test_merkle_fold_and_leaf_columns(spark):
    rows = [(1, None, ""), (None, "é", "x" * 100_000)]
    df = spark.createDataFrame(rows, "a long, b string, c string")
    got = [r[0] for r in df.select(leaf_digest(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [framed(r) for r in rows]
    one = spark.createDataFrame([("x", [("l", "r"), ("", "")])], "h string, path array<struct<left:string,right:string>>")
    row = one.select(fold(F.col("h"), F.col("path")).alias("f"), proof_digest(F.col("path")).alias("p")).first()
    assert row.f == sha("", sha("l", "x", "r"), "") and row.p == sha("l", "r")


# ---- whitening ---------------------------------------------------------------------------------------

def check_whitened(rows, vectors, got, most=4):
    """`got` against a plain recomputation of kept (id, vector) rows."""
    x = np.floor(256 * np.array([v for _, v in vectors], float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    cov = (fit - sums / n).T @ (fit - sums / n) / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(most, int((values > 1e-9 * values[0]).sum()))
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, c + 1) for i, _ in vectors for c in range(k))
    table = {}
    for r in got:
        table.setdefault(r.component, {})[r.vec_id] = r.whitened
        assert r.n == n and r.identity_error < 1e-9
        assert abs(r.explained - values[r.component - 1] / np.trace(cov)) < 1e-9
    for c in range(k):
        want = (x - sums / n) @ axes[:, c] / np.sqrt(values[c])
        own = np.array([table[c + 1][i] for i, _ in vectors])
        assert min(abs(own - want).max(), abs(own + want).max()) < 1e-8
    deviations = {i: int(((n * v - sums) ** 2).sum()) for (i, _), v in zip(vectors, x)}
    assert {r.vec_id: r.deviation for r in got} == deviations


def test_whitening_query_against_numpy(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    kept = [(r.vec_id, r.embedding) for r in rows if r.embedding and all(v is not None and np.isfinite(v) for v in r.embedding)]
    check_whitened(rows, kept, QUERIES["op13_embedding_whitening"](spark, SMALL).collect())


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(40)]
    good = rows + [(100, rows[0][1]), (101, rows[0][1])]
    bad = [(200, None), (201, []), (202, [1.0, None, 2.0]), (203, [float("nan"), 0.0, 0.0]), (204, [float("inf"), 0.0, 0.0]),
           (205, [1.0, 2.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").withColumns(
        {"x": F.lit(1), "n": F.lit("n"), "whitened": F.lit(None).cast("int"), "v": F.lit(0), "key": F.lit(0)})
    check_whitened(df, good, whiten(df).collect())
    assert whiten(df.where("false")).count() == 0
    assert whiten(df.where("vec_id = 7")).count() == 0
    assert whiten(df.where("vec_id in (0, 100, 101)")).count() == 0
    assert {r.component for r in whiten(df.where("vec_id in (1, 2, 3)")).collect()} == {1, 2}


def test_whitening_of_large_entries_stays_exact(spark):
    rows = [(0, [3e9, 1.0]), (1, [-3e9, 5.0]), (2, [1e30, 0.0]), (3, [0.5, -1e12])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whiten(df).collect()
    assert len(got) == 8 and all(np.isfinite(r.whitened) for r in got)
    assert all(r.deviation is None or r.deviation >= 0 for r in got)


def test_characteristic_polynomial_and_roots():
    rng = np.random.default_rng(1)
    a = rng.integers(-50, 50, (7, 4))
    m = (a @ a.T).tolist()  # rank 4
    primes = primes_below(1 << 31, 10**40)
    coefficients, product = [0] * 8, 1
    for p, c in zip(primes, charpoly_mod(m, np.array(primes)).tolist()):
        inverse = pow(product, -1, p)
        coefficients = [v + product * ((x - v) * inverse % p) for v, x in zip(coefficients, c)]
        product *= p
    coefficients = [v if 2 * v < product else v - product for v in coefficients]
    assert coefficients == charpoly_exact(m)
    roots = greatest_roots(coefficients, 7)
    assert len(roots) == 4
    assert np.allclose([float(r) for r in roots], np.linalg.eigvalsh(m)[::-1][:4], rtol=1e-12)


def test_repeated_and_close_roots_have_orthogonal_components():
    # eigenvalues 5, 5, 2 and 5 + 1e-12 beside 5
    for m in ([[5, 0, 0], [0, 5, 0], [0, 0, 2]], [[5 * 10**12, 0, 0], [0, 5 * 10**12 + 1, 0], [0, 0, 2]],
              [[3, 1, 1], [1, 3, 1], [1, 1, 3]]):
        q = components(m, greatest_roots([int(v) for v in charpoly_exact(m)], 3))
        assert np.allclose(q @ q.T, np.eye(3), atol=1e-14)
        back = q @ np.array(m, float) @ q.T
        assert np.allclose(back - np.diag(np.diag(back)), 0, atol=1e-3 if m[0][0] > 100 else 1e-13)


def charpoly_exact(m):
    """Coefficients, constant first, by Faddeev and LeVerrier in fractions."""
    d = len(m)
    eye = [[Fraction(int(i == j)) for j in range(d)] for i in range(d)]
    c, b = [Fraction(0)] * d + [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        b = [[sum(m[i][t] * b[t][j] for t in range(d)) + c[d - k + 1] * eye[i][j] for j in range(d)] for i in range(d)]
        c[d - k] = -sum(m[i][t] * b[t][i] for i in range(d) for t in range(d)) / k
    return c


def test_fit_is_exact_over_many_partitions(spark):
    rng = np.random.default_rng(6)
    x = np.unique(rng.integers(-2**31, 2**31, (300, 3)), axis=0)
    df = spark.createDataFrame([(v,) for v in x.tolist()], "x array<long>").repartition(7)
    model = fit_whitening(df, 3)
    assert model.n == len(x) and model.sums == [int(v) for v in x.astype(object).sum(0)]
    cov = np.cov(x.T.astype(float), bias=True)
    assert np.allclose([float(e) for e in model.eigenvalues], np.linalg.eigvalsh(cov)[::-1], rtol=1e-12)


def test_histograms_bound_the_overlap(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-2**63, 2**63 - 1, 60_000)
    sets = [np.unique(base[rng.random(60_000) < share]) for share in (0.003, 0.003, 0.5, 0.9)] + [base[:0]]
    sets += [base[i:i + 3] for i in range(1200)]  # more than a slice
    df = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sets)], "node long, grams array<long>").coalesce(1)
    got = {r.node: (np.array(r.parts, int), r.over) for r in _histograms(df).collect()}
    assert sorted(got) == list(range(1205)) and all(got[i][0].sum() == 3 for i in range(5, 1205))
    sets = [*sets[:5], sets[1204]]
    got[5] = got[1204]
    for i, s in enumerate(sets):
        assert got[i][0].sum() + got[i][1] == len(s) and (got[i][1] > 0) == (i in (2, 3))
        for j, t in enumerate(sets):
            bound = np.minimum(got[i][0], got[j][0]).sum() + min(got[i][1], got[j][1])
            assert len(np.intersect1d(s, t)) <= bound <= min(len(s), len(t))
