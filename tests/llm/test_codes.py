"""Fingerprints, hard negatives and centroids against brute force, with odd inputs."""
import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetcost.llm import centroids, fingerprints, negatives
from fleetcost.llm.vectors import whole

R = random.Random(11)
VOCAB = ["".join(R.choice("abcdefgé") for _ in range(R.randint(2, 7))) for _ in range(400)]
BASE = [R.choice(VOCAB) for _ in range(220)]


def changed(n):
    out = list(BASE)
    for i in R.sample(range(len(out)), n):
        out[i] = R.choice(VOCAB)
    return " ".join(out)


#: Null, empty and blank texts, null and repeated ids, repeated rows, copies, a group of near copies, a long text.
DOCS = ([(1, None), (2, ""), (3, " \n\t"), (None, "one two"), (None, "three"), (5, "a"), (5, "a"), (6, " ".join(BASE)), (7, " ".join(BASE).upper()), (8, "🙂é x"), (9, "word " * 9000)]
        + [(20 + i, changed(i % 4)) for i in range(40)] + [(80 + i, " ".join(R.choice(VOCAB) for _ in range(R.randint(1, 60)))) for i in range(30)])


def docs(spark, rows=DOCS, parts=5):
    return spark.createDataFrame([(i, t, "x", 1.5, "y") for i, t in rows], "doc_id long, text string, fp string, least double, id string").repartition(parts)


def brute_print(text):
    votes = [0] * 128
    for w, n in Counter((text or "").encode().lower().split()).items():
        h = fingerprints.xxhash.xxh3_128_intdigest(w)
        weight = round(64 * (1 + math.log(n)))
        votes = [v + (weight if h >> 127 - b & 1 else -weight) for b, v in enumerate(votes)]
    return sum((v > 0) << 127 - b for b, v in enumerate(votes))


@pytest.mark.parametrize("large, radius", [(20_000, 3), (4, 3), (4, 2), (20_000, 12)])
def test_fingerprints_are_brute_force(spark, large, radius):
    got = fingerprints.fingerprints(docs(spark), radius, large).collect()
    order = sorted(DOCS, key=lambda r: (r[0] is None, -(r[0] or 0), spark.range(1).select(F.xxhash64(F.lit(r[1] or ""))).first()[0] if r[0] is None else 0))
    prints = {t: brute_print(t) for _, t in DOCS}
    want = []
    for n, (i, t) in enumerate(order):
        t, after = t or "", order[(n + 1) % len(order)][1] or ""
        h = len(t) // 2
        new = t[:len(t) - h] + after[:h]
        like = lambda a, b: 1 - bin(a ^ b).count("1") / 128
        a, b = brute_print(t), brute_print(new)
        near = [j for j, u in DOCS if j is not None and bin(prints[u] ^ a).count("1") <= radius]
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), f"{a:032x}", f"{b:032x}", like(a, b), like(a, brute_print(after)), min(near) if near else None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert max(Counter(r.near_id for r in got).values()) > 10


def test_fingerprints_of_no_and_one_document(spark):
    assert fingerprints.fingerprints(docs(spark, [])).count() == 0
    one = fingerprints.fingerprints(docs(spark, [(4, "abcd efgh")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcd abcd").hexdigest() and one.near_next == 1.0 and one.near_id == 4


def test_block_tables_find_all_within_the_radius(spark):
    bits = np.random.default_rng(3).integers(0, 2, (40, 128), np.uint8)
    rows = []
    for n in range(300):
        x = bits[n % 40].copy()
        x[R.sample(range(128), n % 7)] ^= 1
        rows.append((n, np.packbits(x).tobytes()))
    df = spark.createDataFrame([*rows, (900, None)], "id long, fp binary")
    for radius in (1, 4):
        got = sorted(map(tuple, fingerprints.search(df, df.where("id % 20 = 0"), radius).collect()))
        far = lambda a, b: (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
        assert got == sorted((q, i, far(a, b)) for q, a in rows if q % 20 == 0 for i, b in rows if far(a, b) <= radius)
        masks = fingerprints.block_masks(radius)
        assert len(masks) == (radius + 2) * (radius + 1) // 2


def vectors(spark, rows):
    return spark.createDataFrame([(i, la, v, "b", 3) for i, la, v in rows], "id long, label int, vector array<float>, block string, query int").repartition(4)


def odd_vectors(size):
    """Random vectors, few different ones among them, with ties; then rows that take no part."""
    rows = [(i, R.randint(0, 3), [R.gauss(0, 0.2) for _ in range(size)]) for i in range(120)]
    rows += [(200 + i, i % 4, [0.25] * size) for i in range(30)] + [(240, 1, [0.25] * size)] * 3 + [(250, 2, [0.0] * size), (251, 3, [-0.25] * size)]
    bad = [(300, None, [0.1] * size), (301, 1, None), (302, 1, [None] + [0.1] * (size - 1)), (303, 1, [float("nan")] * size), (304, 2, [float("inf")] + [0.1] * (size - 1)), (320, 2, [-float("inf")] * size)]
    return rows, bad


def brute_negatives(rows, k, m):
    rows = {(i, la, tuple(math.floor(256 * np.float64(np.float32(x))) for x in v)) for i, la, v in rows}
    size, out = max(len(v) for _, _, v in rows), []
    for i, la, v in (r for r in rows if r[0] % 20 == 0):
        score = sorted((-sum(a * b for a, b in zip(v, w)), j, lb) for j, lb, w in rows)
        for s, j, _ in [x for x in score if x[2] == la and x[1] != i][:k]:
            fit = [(t, n) for t, n, lb in score if lb != la and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(fit[:m])]
    assert size
    return sorted(out)


@pytest.mark.parametrize("size, levels, block_rows", [(64, 6, 1 << 15), (7, 2, 8), (100, 3, 1 << 15)])
def test_hard_negatives_are_brute_force(spark, size, levels, block_rows):
    rows, bad = odd_vectors(size)
    rows += [(500, 1, [0.3] * (size - 3)), (501, 2, [0.29])]
    got = negatives.mine(vectors(spark, rows + bad), F.col("id") % 20 == 0, levels=levels, block_rows=block_rows).collect()
    assert sorted(map(tuple, got)) == brute_negatives(rows, 5, 5) and len(got) > 50
    assert negatives.mine(vectors(spark, rows).limit(0), F.col("id") % 20 == 0).count() == 0
    assert negatives.mine(vectors(spark, bad), F.col("id") % 20 == 0).count() == 0


def test_bounds_hold_and_close_in():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.125, (3000, 64))
    x[:40] = x[0]
    lists = pa.array(x.tolist())
    block = pa.table({"id": np.arange(3000), "label": np.zeros(3000, np.int64), "vector": lists})
    codes = negatives.Codes(block, 64, 256)
    exact = codes.x @ codes.x[7]
    q, before = negatives.Query(codes.x[7]), np.inf
    y = negatives.rotated(codes.x)
    assert (y @ y[7] == 64 * exact).all()
    u = np.round(negatives.rotated(codes.x[7:8])[0] / q.step)
    bits = np.unpackbits(codes.code[0].view(np.uint8), axis=1).astype(int)
    assert (q.product(codes.code[0]) == (2 * bits - 1) @ u).all()
    steps = negatives._bounds(codes, q, np.arange(3000))
    low, high = next(steps)
    for level in range(negatives.LEVELS):
        assert (low <= exact).all() and (exact <= high).all() and (high - low).mean() < before
        before = (high - low).mean()
        if level < negatives.LEVELS - 1:
            low, high = steps.send(np.ones(3000, bool))
    left = negatives._narrowed(codes, q, np.arange(3000), lambda low, high, _: high >= negatives._kth(low, 5))
    assert set(np.argsort(-exact)[:5]) <= set(left) and len(left) < 300


def brute_clusters(rows, k, rounds, size):
    kept = [(i, tuple(math.floor(64 * np.float64(np.float32(x))) for x in v)) for i, _, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    draw = sorted((i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)
    centre = [list(v) for _, _, v in draw[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centre))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, v in kept:
            of[near(v)[1]].append(v)
        centre = [[sum(x) // len(of[n]) for x in zip(*of[n])] if n in of else c for n, c in enumerate(centre)]
    inertia = Counter()
    for _, v in kept:
        inertia[near(v)[1]] += near(v)[0]
    return [(i, near(v)[1], near(v)[0], inertia[near(v)[1]], sum(inertia.values()), hashlib.sha256(",".join(map(str, centre[near(v)[1]])).encode()).hexdigest()) for i, v in kept]


@pytest.mark.parametrize("size, k, width, chunk", [(8, 5, 2, 7), (7, 16, 3, 1 << 14), (5, 400, 2, 50), (1, 3, 1, 10)])
def test_clusters_are_brute_force(spark, size, k, width, chunk):
    rows, bad = odd_vectors(size)
    rows += bad + [(None, 1, [0.5] * size), (None, 1, [0.4] * size), (700, 1, [0.1] * (size + 1)), (701, None, [])]
    got = centroids.cluster(vectors(spark, rows), k=k, size=size, width=width, rows=chunk).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_clusters(rows, k, 3, size)))
    assert centroids.cluster(vectors(spark, rows).limit(0), size=size).count() == 0


def test_components_too_large_are_an_error():
    with pytest.raises(ArithmeticError):
        whole(pa.array([[1e6]]), 64, 1)
    assert whole(pa.array([[1.0], [0.5, -0.01]]).slice(1), 64, 3).tolist() == [[32, -1, 0]]
