import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathloom.llm import pivot_index as pi
from pathloom.llm import simhash as sh
from pathloom.llm.groups import components, forest, links_in_lists
from pathloom.llm.queries import queries
from pathloom.llm.textbatch import Texts


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
@settings(max_examples=12, deadline=None)
def test_components(spark, pairs):
    want = union(31, pairs)
    df = spark.createDataFrame([(f"{a:02}", f"{b:02}") for a, b in pairs], "a string, b string")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {f"{x:02}": f"{want[x]:02}" for x in nodes}


def test_a_long_chain(spark):
    df = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in components(df).collect()} == {0}


@given(st.integers(0, 10_000), st.integers(2, 90), st.floats(0.5, 12))
@settings(max_examples=200, deadline=None)
def test_links_connect_what_all_pairs_connect(seed, n, limit):
    """On a line and in the plane, in short and in long lists."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 60, (n, rng.integers(1, 3))).astype(float)
    distance = lambda a, b: np.sqrt(((a - b) ** 2).sum(1))
    keys = np.sort(rng.integers(0, 3, n))
    i, j = links_in_lists(keys, x, distance, limit)
    assert (distance(x[i], x[j]) <= limit).all() and (keys[i] == keys[j]).all()
    every = [(a, b) for a in range(n) for b in range(a + 1, n) if keys[a] == keys[b] and distance(x[a : a + 1], x[b : b + 1])[0] <= limit]
    assert union(n, zip(i.tolist(), j.tolist())) == union(n, every)


def test_a_hot_list_costs_its_size():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, (1, 4), dtype=np.uint64)
    x = np.repeat(base, 20_000, 0)
    x[:, 0] ^= np.uint64(1) << rng.integers(0, 60, 20_000).astype(np.uint64)
    looked = 0

    def distance(a, b):
        nonlocal looked
        looked += len(a)
        return sh.hamming(a, b)

    i, _ = links_in_lists(np.zeros(20_000, np.int64), x, distance, 30)
    assert len(i) == 19_999 and looked == 19_999


@given(st.integers(0, 10_000), st.integers(1, 60), st.integers(0, 200))
@settings(max_examples=100, deadline=None)
def test_a_forest_joins_the_same(seed, n, links):
    rng = np.random.default_rng(seed)
    i, j = rng.integers(0, n, (2, links))
    some = forest(i, j, n)
    assert union(n, zip(i[some].tolist(), j[some].tolist())) == (want := union(n, zip(i.tolist(), j.tolist())))
    assert len(some) == n - len(set(want))


def test_many_near_copies_have_few_links(spark):
    """Clusters whose members are all near each other but no two equal: links by their number, not its square."""
    rng, p = np.random.default_rng(4), sh.Params()
    base = rng.integers(0, 2**63, (4, 4), dtype=np.uint64)
    flips = (rng.random((2000, 256)) < 0.05).astype(np.uint8)
    f = base[np.arange(2000) % 4] ^ np.packbits(flips, axis=1).view(np.uint64)
    prints = spark.createDataFrame([(bytearray(x.tobytes()),) for x in f], "f binary")
    found = sh.links(prints, len(f), p).collect()
    number = {x.tobytes(): k for k, x in enumerate(f)}
    pairs = [(number[bytes(r["a"])], number[bytes(r["b"])]) for r in found]
    i, j = np.array(pairs).T
    assert (sh.hamming(f[i], f[j]) <= p.bits).all()
    _, lists = sh.plan(len(f), p)
    assert len(pairs) <= lists * len(f)
    x, y = np.triu_indices(len(f), 1)
    near = sh.hamming(f[x], f[y]) <= p.bits
    near[near] = sh.meets(f[x[near]], f[y[near]], p, *sh.plan(len(f), p)).any(1) & (sh.shared_bytes(f[x[near]], f[y[near]]) >= p.least)
    assert union(len(f), pairs) == union(len(f), zip(x[near].tolist(), y[near].tolist()))


def parted(rng, n, bits):
    """Fingerprints and partners at exactly that distance, the differing bits anywhere."""
    a = rng.integers(0, 2**63, (n, 4), dtype=np.uint64)
    flips = np.zeros((n, 256), np.uint8)
    np.put_along_axis(flips, np.argsort(rng.random((n, 256)), 1)[:, :bits], 1, 1)
    b = a ^ np.packbits(flips, axis=1).view(np.uint64)
    assert (sh.hamming(a, b) == bits).all()
    return a, b


def test_shared_bytes_are_guaranteed():
    """A pair agrees in as many bytes as the filter asks for: surely up to 27 bits, nearly always at the limit; others do not."""
    rng, p = np.random.default_rng(1), sh.Params()
    for bits in (1, 10, 20, sh.BYTES - p.least):
        assert (sh.shared_bytes(*parted(rng, 2000, bits)) >= p.least).all()
    worst = np.zeros((1, 4), np.uint64)
    worst.view(np.uint8)[0, : sh.BYTES - p.least] = 1  # each differing bit in another byte
    assert sh.shared_bytes(np.zeros((1, 4), np.uint64), worst)[0] == p.least and sh.hamming(np.zeros((1, 4), np.uint64), worst)[0] == sh.BYTES - p.least
    assert (sh.shared_bytes(*parted(rng, 20_000, p.bits)) >= p.least).mean() >= 0.999
    assert (sh.shared_bytes(rng.integers(0, 2**63, (200_000, 4), dtype=np.uint64), rng.integers(0, 2**63, (200_000, 4), dtype=np.uint64)) >= p.least).sum() <= 1


def test_many_unrelated_items_in_a_list(monkeypatch):
    """10,000 fingerprints that have nothing but the three bytes of their cut in common, among them groups of close ones."""
    rng, p = np.random.default_rng(2), sh.Params()
    f = rng.integers(0, 2**63, (10_000, 4), dtype=np.uint64)
    f[5000:5040] = f[17]
    f[5000:5040, 1] ^= np.uint64(1) << rng.integers(0, 60, 40).astype(np.uint64)
    f[6000:6300], f[7000:7300] = parted(rng, 300, 26)
    f.view(np.uint8).reshape(-1, 32)[:, [3, 9, 20]] = 77
    looked = [0, 0]
    for k, name in enumerate(("hamming", "shared_bytes")):
        real = getattr(sh, name)
        monkeypatch.setattr(sh, name, lambda a, b, k=k, real=real: (looked.__setitem__(k, looked[k] + len(a)), real(a, b))[1])
    i, j = sh.links_among(f, np.zeros(len(f), np.int64), np.arange(len(f)), p)
    assert looked[0] < 500_000 and looked[1] < 500_000  # all pairs are 50 million
    roots = union(len(f), zip(i.tolist(), j.tolist()))
    assert len({roots[x] for x in (17, *range(5000, 5040))}) == 1
    assert all(roots[6000 + k] == roots[7000 + k] for k in range(300))
    assert len(set(roots)) == len(f) - 40 - 300
    same = np.repeat(f[:1], 600, 0)
    same.view(np.uint8).reshape(-1, 32)[:, 27:] = rng.integers(0, 256, (600, 5), dtype=np.uint8)  # all share 27 bytes
    i, j = sh.links_among(same, np.zeros(600, np.int64), np.arange(600), p)
    x, y = np.triu_indices(600, 1)
    near = sh.hamming(same[x], same[y]) <= p.bits
    assert union(600, zip(i.tolist(), j.tolist())) == union(600, zip(x[near].tolist(), y[near].tolist()))


@given(st.integers(0, 10_000), st.integers(30, 400), st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_splitting_loses_no_pair_with_bytes_enough(seed, n, groups):
    rng, p = np.random.default_rng(seed), sh.Params()
    f = rng.integers(0, 2**63, (groups, 4), dtype=np.uint64)[rng.integers(0, groups, n)]
    for _ in range(int(rng.integers(1, 25))):
        f[np.arange(n), rng.integers(0, 4, n)] ^= np.uint64(1) << rng.integers(0, 63, n).astype(np.uint64)
    i, j = sh.links_among(f, np.zeros(n, np.int64), np.arange(n), p)
    assert (sh.hamming(f[i], f[j]) <= p.bits).all()
    x, y = np.triu_indices(n, 1)
    near = (sh.hamming(f[x], f[y]) <= p.bits) & (sh.shared_bytes(f[x], f[y]) >= p.least)
    roots = union(n, zip(i.tolist(), j.tolist()))
    assert all(roots[a] == roots[b] for a, b in zip(x[near].tolist(), y[near].tolist()))


def near_copy(text, rng, part):
    words = text.split(" ")
    for k in rng.choice(len(words), max(1, int(len(words) * part)), replace=False):
        words[k] = "".join(rng.choice(list("abcdefghij"), 7))
    return " ".join(words)


def test_simhash_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    f = sh.fingerprints(Texts.of([r["text"] for r in docs]))
    pairs = [(i, j) for i in range(len(f)) for j in i + 1 + np.flatnonzero(sh.hamming(np.broadcast_to(f[i], f[i + 1 :].shape), f[i + 1 :]) <= sh.Params().bits)]
    roots = union(len(f), pairs)
    want = {docs[r]["doc_id"] for r in set(roots)}
    got = {r["doc_id"] for r in queries()["op4_simhash_dedup"](spark, sf).collect()}
    assert want <= got and len(got) <= len(want) + max(1, 0.02 * (len(docs) - len(want)))


def test_planted_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(3)
    pool = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(5, 10))) for _ in range(4000)]
    small = ["the", "of", "and", "to", "in"]
    make = lambda n: " ".join(rng.choice(small) if rng.random() < 0.3 else rng.choice(pool) for _ in range(n))
    rows, group = [], {}
    for g in range(60):
        text = make(int(rng.integers(60, 500)))
        for c in range(1 + g % 4):
            rows.append((len(rows), text if c < 2 else near_copy(text, rng, 0.04)))
            group[len(rows) - 1] = g
    df = spark.createDataFrame(rows, "doc_id int, text string")
    kept = [r["doc_id"] for r in sh.near_dedup_ids(df).collect()]
    by_group = [group[k] for k in kept]
    assert set(by_group) == set(range(60))
    assert len(kept) <= 61
    assert sorted(r["doc_id"] for r in sh.near_dedup(df).collect()) == sorted(kept)


@pytest.mark.parametrize("n", [1000, 1 << 26, 1 << 34, 1 << 42])
def test_index_recall_at_exactly_the_limit(n):
    """Longer keys agree less often; more lists and cuts make up for it, so that recall is the same at every size."""
    rng, p = np.random.default_rng(9), sh.Params()
    width, lists = sh.plan(n, p)
    a, b = parted(rng, 2000, p.bits)
    found = [(sh.meets(a[s : s + 100], b[s : s + 100], p, width, lists).any(1) & (sh.shared_bytes(a[s : s + 100], b[s : s + 100]) >= p.least)).mean() for s in range(0, 2000, 100)]
    assert np.mean(found) >= 0.98
    near = parted(rng, 300, 20)
    assert sh.meets(*near, p, width, lists).any(1).all()


@pytest.mark.parametrize("n", [1000, 1 << 26, 1 << 34])
def test_pairs_meet_by_their_keys(n):
    rng, p = np.random.default_rng(5), sh.Params()
    width, lists = sh.plan(n, p)
    a, b = parted(rng, 500, 18)
    met = sh.meets(a, b, p, width, lists)
    one = sh.list_keys(a, p, width, lists) == sh.list_keys(b, p, width, lists)
    for x in range(0, lists, 7):
        cut = sh.cut_keys(a, np.full(500, x), p, width, lists) == sh.cut_keys(b, np.full(500, x), p, width, lists)
        assert (met[:, x] == (one[:, x] & cut.any(1))).all()


def test_simhash_odd_rows(odd_docs, no_docs):
    ids = sorted(repr(r["doc_id"]) for r in sh.near_dedup_ids(odd_docs).collect())
    assert ids == sorted(map(repr, [1, 2, 3, None, 4, 5, 6, 7]))
    out = sh.near_dedup(odd_docs)
    assert out.columns == odd_docs.columns
    assert sorted(repr(r["doc_id"]) for r in out.collect()) == ids
    assert sh.near_dedup_ids(no_docs).count() == sh.near_dedup(no_docs).count() == 0


def test_empty_texts_are_one_group(spark):
    df = spark.createDataFrame([(1, ""), (2, ""), (3, None), (4, None), (5, "..."), (6, "..."), (7, "!")], "doc_id int, text string")
    assert sorted(r["doc_id"] for r in sh.near_dedup_ids(df).collect()) == [1, 3, 4, 5, 7]


def test_both_ways_of_joining(spark, odd_docs, sf):
    docs = odd_docs.union(odd_docs)
    for df in (docs, spark.read.parquet(f"{sf}/documents.parquet")):
        one, other = (sorted(map(repr, sh.near_dedup(df, many=m).collect())) for m in (1 << 20, -1))
        assert one == other


def test_one_id_with_two_texts(spark):
    df = spark.createDataFrame([(1, "first text of one id"), (1, "quite another content altogether"), (2, "first text of one id")], "doc_id int, text string")
    assert sorted((r["doc_id"], r["text"][:5]) for r in sh.near_dedup(df).collect()) == [(1, "first"), (1, "quite")]


def vectors(rng, n, dim=32, copies=3):
    base = rng.normal(size=(n, dim))
    out = [base]
    for c in range(copies):
        some = base[: n // (c + 2)]
        out.append(some + rng.normal(size=some.shape) * 0.25 * np.linalg.norm(some, axis=1, keepdims=True) / np.sqrt(dim))
    x = np.concatenate(out)
    return x[rng.permutation(len(x))]


def test_embedding_recall_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = vectors(rng, 1200, 48)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u @ u.T
    pairs = [(int(i), int(j)) for i, j in np.argwhere(np.triu(sim >= 0.9, 1))]
    assert len(pairs) > 300
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id int, embedding array<double>")
    group = {r["vec_id"]: r["group_id"] for r in pi.near_groups(df).collect()}
    assert np.mean([group[i] == group[j] for i, j in pairs]) >= 0.9
    want = union(len(x), pairs)
    assert all(want[i] == want[group[i]] for i in group)  # nothing joined that brute force leaves apart
    assert len(group) == len(x)


def concentrated(rng, n, mean, dim=64):
    """Unit vectors of about the mean cosine `mean` to each other."""
    z = rng.normal(size=(n, dim))
    x = np.sqrt(mean) * np.eye(dim)[0] + np.sqrt(1 - mean) * z / np.linalg.norm(z, axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def at_limit(rng, x, cosine=0.9):
    """A partner of each unit vector at exactly that cosine."""
    g = rng.normal(size=x.shape)
    g -= (g * x).sum(1, keepdims=True) * x
    return cosine * x + np.sqrt(1 - cosine**2) * g / np.linalg.norm(g, axis=1, keepdims=True)


@pytest.mark.parametrize("n", [4000, 100_000, 5_000_000, 100_000_000])
@pytest.mark.parametrize("mean", [0.0, 0.5, 0.7])
def test_recall_at_the_limit(n, mean):
    """Pairs at exactly the limit that become candidates, whatever the size and however close the vectors are to each other."""
    rng, p = np.random.default_rng(8), pi.Params()
    centre, pivots, near = pi.fitted(concentrated(rng, pi.pivot_count(n, p) + p.probes, mean).astype(np.float32), n, p)
    x = concentrated(rng, 1000, mean)
    a, b = (pi.permutations(v - centre, pivots, near) for v in (x, at_limit(rng, x)))
    assert (pi.shared_pivots(a, b) >= p.shared).mean() >= 0.9


@pytest.mark.parametrize("mean", [0.9, 0.97])
def test_very_close_vectors_are_all_compared(mean):
    rng, p = np.random.default_rng(8), pi.Params()
    centre, pivots, near = pi.fitted(concentrated(rng, 5000, mean).astype(np.float32), 5_000_000, p)
    x = concentrated(rng, 1000, mean)
    a, b = (pi.permutations(v - centre, pivots, near) for v in (x, at_limit(rng, x)))
    assert near <= p.widest and (pi.shared_pivots(a, b) >= p.shared).mean() >= 0.9


def test_isolated_pairs_of_concentrated_vectors(spark):
    """End to end: groups of two at the limit, among vectors as close to each other as those of encoders."""
    rng = np.random.default_rng(4)
    x = concentrated(rng, 20_000, 0.7)
    y = at_limit(rng, x[:400], 0.9001)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(20_400), "embedding": list(np.concatenate([x, y]))}))
    group = dict(map(tuple, pi.near_groups(df).collect()))
    assert np.mean([group[i] == group[20_000 + i] for i in range(400)]) >= 0.9


def test_embedding_query(spark, sf):
    rows = queries()["op6_embedding_dedup"](spark, sf).collect()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in sorted(table, key=lambda r: r["vec_id"])], float)
    ids = sorted(r["vec_id"] for r in table)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = union(len(x), [(int(i), int(j)) for i, j in np.argwhere(np.triu(x @ x.T >= 0.9, 1))])
    assert {r["vec_id"]: r["group_id"] for r in rows} == {ids[i]: ids[w] for i, w in enumerate(want)}


def test_embedding_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (None, [3.0, 0.01]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0, None]), (8, [1.0, 0.0, 0.0]), (9, [-1.0, 0.0]), (10, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>").withColumns({n: F.lit(1) for n in ("id", "v", "dim", "key", "w", "root", "node", "least", "same")})
    got = sorted((repr(r["vec_id"]), r["group_id"]) for r in pi.near_groups(df).collect())
    assert got == sorted([("1", 1), ("2", 1), ("2", 1), ("None", 1), ("3", 3), ("4", 4), ("5", 5), ("6", 6), ("7", 7), ("8", 8), ("9", 9), ("10", 10)])
    assert pi.near_groups(df.limit(0)).count() == 0
    assert pi.near_groups(df.where("vec_id = 3")).collect()[0]["group_id"] == 3


@pytest.mark.parametrize("n", [1, 100, 10**6, 10**10])
def test_plans_grow_slowly(n):
    assert pi.pivot_count(n, pi.Params()) <= max(128, 2 * n**0.5)
    width, lists = sh.plan(n, sh.Params())
    assert 256 ** (width + 2) >= n and lists < 300
