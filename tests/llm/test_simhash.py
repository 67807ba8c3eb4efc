import re

import numpy as np
import xxhash

from strideframe.llm._common import stage
from strideframe.llm.components import connected_components, thin_edges
from strideframe.llm.queries import op1_simhash_pivot
from strideframe.llm.simhash import alike, bucket_keys, bucket_links, confirmed_links, fingerprint, majority, near_duplicates, pivot_table, probe_keys


def plain_fingerprint(text, size):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(max(1, len(words) - size + 1))]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def plain_components(prints, bits):
    """prints: (id, fingerprint); the smallest id reachable, by comparing all pairs."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (ident, _) in enumerate(prints):
        if ident is not None:
            least[find(i)] = min(ident, least.get(find(i), ident))
    return [least.get(find(i)) for i in range(len(prints))]


def check(docs, out, rows=None):
    prints = [(i, plain_fingerprint(t, 4)) for i, t in rows or [tuple(r) for r in docs.select("doc_id", "text").collect()]]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(prints, plain_components(prints, 4), strict=True)), key=str)
    assert sorted((tuple(r)[:3] for r in out.select("doc_id", "fingerprint", "component_id").collect()), key=str) == want


def test_odd_rows(odd_docs):
    check(odd_docs, near_duplicates(odd_docs))


def test_query_against_all_pairs(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"), op1_simhash_pivot(spark, sf_dir))


def test_chains_and_hot_buckets(spark, monkeypatch):
    # Fingerprints at steps of 4 bits from each other make long chains in shared buckets.
    import strideframe.llm.simhash as simhash

    rng = np.random.default_rng(1)
    values = [int(rng.integers(0, 2**62))]
    for _ in range(60):
        flips = rng.choice(64, 4, replace=False)
        values.append(values[-1] ^ sum(1 << int(b) for b in flips))
    values += [values[0] ^ (1 << int(b)) for b in range(40)]
    distinct = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, 0) for v in dict.fromkeys(values)], "fp long, fp_high long")
    links = simhash.near_links(distinct, bits=4, cell_rows=8)
    roots = {r.node: r.root for r in simhash.connected_components(links).collect()}
    prints = [(r.fp, r.fp % (1 << 64)) for r in distinct.collect()]
    got = [roots.get(i, i) for i, _ in prints]
    want = plain_components(prints, 4)
    group = lambda xs: sorted(sorted(i for i, x in enumerate(xs) if x == y) for y in set(xs))
    assert group(got) == group(want)


def test_every_pair_within_the_radius_shares_a_key():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**64, 300, dtype=np.uint64)
    for n in range(1, 5):
        other = fps.copy()
        for i in range(len(fps)):
            for b in rng.choice(64, n, replace=False):
                other[i] ^= np.uint64(1) << np.uint64(b)
        a, b = bucket_keys(fps[:, None], 4), bucket_keys(other[:, None], 4)
        assert (a == b).any(axis=1).all()


def test_wide_fingerprints_recall_of_near_copies():
    """Of all pairs of long texts with a similarity of 0.8 or more, those that are candidates of the pipeline's radius."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    shared = found = 0
    for _ in range(160):
        words = list(rng.choice(vocabulary, 500))
        changed = list(words)
        for at in rng.choice(500, rng.integers(3, 11), replace=False):
            changed[at] = "new" + changed[at]
        shingles = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (words, changed)]
        if len(shingles[0] & shingles[1]) / len(shingles[0] | shingles[1]) < 0.8:
            continue
        a, b = (np.array([fingerprint(" ".join(x), 5, 2)], np.uint64) for x in (words, changed))
        shared += 1
        keys = [probe_keys(f, np.argsort(np.abs(majority(" ".join(x), 5, 2)), kind="stable")[None, :]) for f, x in ((a, words), (b, changed))]
        found += bool(np.intersect1d(*keys).size) and np.bitwise_count(a ^ b).sum() <= 32
    assert shared > 100 and found / shared >= 0.98


def test_no_link_of_short_texts_is_lost(spark, monkeypatch):
    """Short texts with a word changed, dropped or added, and some that share a frequent line: groups equal those of all pairs."""
    from strideframe.llm import simhash

    monkeypatch.setattr(simhash, "FREQUENT", 4)
    rng = np.random.default_rng(12)
    vocabulary = [f"w{i}" for i in range(4000)]
    line = " ".join(f"boiler{i}" for i in range(18))
    texts = []
    for n in range(260):
        words = list(rng.choice(vocabulary, rng.integers(4, 60)))
        other = list(words)
        kind, at = n % 4, int(rng.integers(len(words)))
        if kind == 0:
            other[-1 if n % 8 else 0] = "changed"
        elif kind == 1:
            del other[at]
        elif kind == 2:
            other.insert(at, "added")
        else:
            other[at] = "changed"
        texts += [" ".join(words), " ".join(other)]
        if n % 6 == 0:
            texts += [f"{line} {' '.join(words[:4])}", f"{' '.join(words[:3])} {line}"]
    sets = [frozenset(zip(*[t.split()[k:] for k in range(5)], strict=False)) or frozenset([tuple(t.split())]) for t in texts]
    links = {(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    group = list(range(len(texts)))
    for _ in range(len(texts)):
        before = list(group)
        for i, j in links:
            group[i] = group[j] = min(group[i], group[j])
        if group == before:
            break
    out = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shingle=5, bits=32, words=2, confirm=0.8).collect()
    assert len(links) > 100
    assert {r.doc_id: r.component_id for r in out} == dict(enumerate(group))


def test_wide_mode_runs_and_groups_copies(odd_docs):
    out = near_duplicates(odd_docs, shingle=5, bits=25, words=2).collect()
    assert len(out) == odd_docs.count() and all(len(r.fingerprint) == 32 for r in out)
    assert {r.component_id for r in out if r.doc_id in (1, 2, 12)} == {1}


def test_empty_table(no_docs):
    assert near_duplicates(no_docs).count() == 0


def test_thinned_edges_keep_components(spark):
    rng = np.random.default_rng(11)
    edges = rng.integers(-400, 400, (600, 2))
    edges = np.concatenate([edges, edges[:50], np.stack([edges[:20, 0]] * 2, axis=1)])  # repeated edges, loops
    want = {}
    for v in np.unique(edges).tolist():
        want[v] = v
    changed = True
    while changed:
        changed = False
        for a, b in edges.tolist():
            low = min(want[a], want[b])
            changed |= want[a] != low or want[b] != low
            want[a] = want[b] = low
    table = stage(spark.createDataFrame(edges.tolist(), "a long, b long").repartition(7), "test")
    for most in (16, 1 << 20):
        thin = thin_edges(stage(table, "test"), most)
        got = {r.node: r.root for r in connected_components(thin).collect()}
        assert all(got.get(v, v) == root for v, root in want.items())
        if most > 1000:
            assert thin.count() == len(want) - len(set(want.values()))
    assert thin_edges(stage(table.filter("a > 1000"), "test")).count() == 0


def test_pivot_table_discards_pairs_and_loses_no_link():
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 2**64, (400, 1), dtype=np.uint64)
    for i in range(200, 400):  # half are within 4 bits of one of the first
        fps[i] = fps[i - 200]
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            fps[i] ^= np.uint64(1) << np.uint64(b)
    table = pivot_table(fps)
    rows = np.ascontiguousarray(table).view(np.uint8).astype(int)
    near = np.array([[(int(a) ^ int(b)).bit_count() for b in fps[:, 0]] for a in fps[:, 0]]) <= 4
    passed = np.abs(rows[:, None] - rows[None]).max(axis=2) <= 4
    assert (passed | ~near).all() and (passed & ~near).mean() < 0.01
    a, b = bucket_links(np.zeros(400, np.uint64), fps, table, 4)
    assert near[a, b].all() and {*zip(a.tolist(), b.tolist())} and len(a) == 200


def test_both_words_count(spark):
    # Two texts cannot be made to share a first word, but fingerprints can.
    import strideframe.llm.simhash as simhash

    far = (1 << 60) - 1
    rows = [(10, 7, 0, bytes(range(128))), (11, 7, far, bytes(range(128))), (12, 7, 1, bytes(range(128)))]
    links = simhash.near_links(spark.createDataFrame(rows, "node long, fp long, fp_high long, weak binary"), bits=25, words=2).collect()
    assert {frozenset(r) for r in links} == {frozenset((10, 12))}


def test_keys_of_wide_fingerprints_are_made_in_small_tasks(spark, monkeypatch):
    from strideframe.llm import simhash

    rng = np.random.default_rng(11)
    fps = rng.integers(-(2**63), 2**63 - 1, (90, 2))
    fps[50:] = fps[10:50] ^ (1 << rng.integers(0, 60, (40, 1)))  # near copies of 40 others
    rows = [(i, *map(int, f), rng.permutation(128).astype(np.uint8).tobytes()) for i, f in enumerate(fps)]
    distinct = spark.createDataFrame(rows, "node long, fp long, fp_high long, weak binary").coalesce(1)

    def groups():
        links = simhash.near_links(distinct, bits=4, words=2)
        plan = links._jdf.queryExecution().optimizedPlan().toString()
        return plan, sorted((r.node, r.root) for r in connected_components(links).collect())

    plan, want = groups()
    monkeypatch.setattr(simhash, "ENTERED", 16)
    small, got = groups()
    assert got == want and {n for n, r in got if n != r} == set(range(50, 90))
    assert "Repartition 6, true" in small and "Repartition 1, true" in plan


def test_hubs_and_hot_groups(spark, monkeypatch):
    import strideframe.llm._common as common

    monkeypatch.setattr(common, "HOT", 4)
    edges = [(0, i) for i in range(1, 50)] + [(60, 61), (61, 62), (70, 69)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(50)} | {60: 60, 61: 60, 62: 60, 69: 69, 70: 69}
    rows = [(i, "one text that many rows share, word for word") for i in range(40)] + [(100 + i, f"text number {i} of its own {i * i}") for i in range(20)]
    check(None, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_confirmed_groups_against_all_pairs(spark):
    """Bases with copies of rising distance, a shared passage, short texts, null and repeated ids."""
    from tests.llm.test_pipeline import shingles

    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(2000)]
    rows, passage = [], " ".join(rng.choice(words, 120))
    for g in range(12):
        base = rng.choice(words, 150).tolist()
        for changes in (0, 1, 2, 3, 5, 8, 12):
            copy = list(base)
            for at in rng.choice(150, changes, replace=False):
                copy[at] = "x" + copy[at]
            rows.append((len(rows), " ".join(copy)))
        rows.append((len(rows), passage + " " + " ".join(rng.choice(words, 60))))
    rows += [(900, ""), (901, None), (902, "one two"), (903, "one two"), (904, "One two"), (None, rows[0][1]), (None, "one two three"), (3, rows[3][1])]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, bits=32, words=2, confirm=0.8).collect()
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if not sets[i] and not sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    least = {}
    for (i, _), p in zip(rows, parent, strict=True):
        if i is not None:
            least[p] = min(i, least.get(p, i))
    assert sorted(((r.doc_id, r.component_id) for r in out), key=str) == sorted(((i, least.get(p)) for (i, _), p in zip(rows, parent, strict=True)), key=str)


def test_cells_of_a_large_group_see_all_pairs(spark):
    rng = np.random.default_rng(7)
    base = [f"b{i}" for i in range(100)]
    texts = []
    for i in range(60):
        own = list(base)
        for at in rng.choice(100, rng.integers(1, 8), replace=False):
            own[at] = f"c{i}_{at}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    members = docs.selectExpr("id", "id AS node", "0L AS root", "60L AS members")
    from strideframe.llm.simhash import shingle_set
    from tests.llm.test_pipeline import shingles

    sets = [shingles(t) for t in texts]
    parent = list(range(60))
    for i in range(60):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    for chunk in (7, 256):
        links = confirmed_links(docs, members, 5, 0.8, chunk)
        got = {r.node: r.root for r in connected_components(links).collect()}
        assert [got.get(i, i) for i in range(60)] == parent
    a, b = alike(np.arange(60), [shingle_set(t, 5) for t in texts], 0.8)
    assert len(a) == 60 - len(set(parent))
