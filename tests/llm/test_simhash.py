import re

import numpy as np
import pytest
import xxhash

from halyard.llm import simhash
from halyard.llm.components import connected_components


def plain_fingerprint(text, width=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, tau=2):
    """[(fingerprint, component)] by comparing all pairs."""
    prints = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= tau and root(i) != root(j):
                parent[root(i)] = root(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[root(i)] = min(least.get(root(i), name), name)
    return [(f"{prints[i]:016x}", least.get(root(i))) for i in range(len(rows))]


def result(docs):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs, ["doc_id"]).collect()), key=str)


def expected(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    return sorted(((d, *x) for (d, _), x in zip(rows, brute(rows))), key=str)


def test_components_equal_all_pairs(small_docs):
    assert result(small_docs) == expected(small_docs)


def test_awkward_rows(odd):
    assert result(odd) == expected(odd)
    got = {(r["doc_id"], r["fingerprint"]) for r in simhash.near_duplicates(odd, ["doc_id"]).collect()}
    assert {(d, "0" * 16) for d in (1, 2, 3)} <= got


def test_empty_table(empty):
    assert simhash.near_duplicates(empty, ["doc_id"]).count() == 0
    assert simhash.keep_first(empty).columns == empty.columns and simhash.keep_first(empty).count() == 0


def test_one_row_of_each_group_stays(odd):
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    groups = brute(rows)
    assert kept.count() == len({f for f, _ in groups}) - sum(  # no two different fingerprints of this table link
        (int(a, 16) ^ int(b, 16)).bit_count() <= 2 for a in {f for f, _ in groups} for b in {f for f, _ in groups} if a < b
    )
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] in (1, 2, 3, 4, 5, None)) == [1, 4]


def test_clashing_columns(odd):
    clash = odd.withColumnRenamed("source", "fingerprint").withColumnRenamed("n_chars", "component_id")
    assert result(clash) == result(odd)
    assert simhash.keep_first(clash).columns == clash.columns


@pytest.mark.parametrize("tau", [0, 1, 2, 3])
def test_links_connect_what_all_pairs_connect(spark, tau):
    """Random clusters, a dense ball (heavy buckets) and correlated bits."""
    rng = np.random.default_rng(tau)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = {int(c) for c in centres}
    for c in centres:
        for _ in range(6):
            flips = rng.integers(0, 64, rng.integers(0, 4))
            prints.add(int(c) ^ int(np.bitwise_xor.reduce(np.uint64(1) << flips.astype(np.uint64))) if len(flips) else int(c))
    prints |= {int(centres[0]) ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)}
    values = sorted(prints)
    frame = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "__fp long")
    links = simhash.near_links(frame, tau).collect()
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= tau for a, b in links)
    parent = {v: v for v in values}

    def root(x, of):
        while of[x] != x:
            x = of[x]
        return x

    for k, a in enumerate(values):
        for b in values[:k]:
            if (a ^ b).bit_count() <= tau:
                parent[root(a, parent)] = root(b, parent)
    found = {v: v for v in values}
    for a, b in links:
        found[root(a & (2**64 - 1), found)] = root(b & (2**64 - 1), found)
    groups = lambda of: {frozenset(v for v in values if root(v, of) == r) for r in {root(v, of) for v in values}}
    assert groups(found) == groups(parent)


def test_thresholds_sum_and_cost():
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    bits = simhash._bit_matrix(fps).astype(float)
    parts = simhash.group_bits(bits.T @ bits, len(fps), 3)
    assert sorted(b for p in parts for b in p) == list(range(64))
    plan = simhash.Plan(parts, 2)
    plan.fit({(i, s): np.bincount(simhash._gather(fps, b), minlength=1 << len(b)).astype(float) for i, own in enumerate(plan.subs) for s, b in enumerate(own)}, len(fps))
    thresholds, cost = plan.allocate(fps)
    assert (thresholds.sum(axis=0) == 2 - 3 + 1).all()
    costs = plan.costs(fps)
    options = [(a, b, c) for a in range(4) for b in range(4) for c in range(4) if a + b + c == 3]
    least = np.min([costs[0, a] + costs[1, b] + costs[2, c] for a, b, c in options], axis=0)
    assert np.allclose(cost, least)


def test_components_of_long_and_wide_shapes(spark):
    chain = [(k, k + 1) for k in range(60)]
    star = [(1000, 1000 + k) for k in range(1, 300)]
    links = spark.createDataFrame([*chain, *star, (5, 5), (None, 3), (2, 1)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(links, "a", "b").collect()}
    assert got == {k: 0 for k in range(61)} | {1000 + k: 1000 for k in range(300)}
