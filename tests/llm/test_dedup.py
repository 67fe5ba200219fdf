"""Exact and SimHash de-duplication against brute force."""

import hashlib
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from wattsift.llm.components import connected_components
from wattsift.llm.exact_dedup import build_perfect_hash, exact_dedup, find_slots
from wattsift.llm.queries import ORACLE_SQL
from wattsift.llm.simhash_dedup import linked_pairs, similar_groups, simhash_components


def order(x):
    return sorted(x, key=repr)


def brute_exact(rows):
    sha = [hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t).encode()).hexdigest() for _, t in rows]
    groups = defaultdict(list)
    for (i, t), h in zip(rows, sha):
        groups[h].append((-len(t), i is None, i))
    keep = {h: min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2] for h, g in groups.items()}
    out, left = [], set(groups)
    for (i, t), h in sorted(zip(rows, sha), key=lambda x: -len(x[0][1])):
        stays = h in left and i == keep[h]
        left -= {h} if stays else set()
        out.append((i, keep[h], len(groups[h]), stays, h))
    return out


@pytest.mark.parametrize("segment", [1, 8192])
def test_exact_dedup(edge, rows, segment):
    assert order(tuple(r) for r in exact_dedup(edge, segment=segment).collect()) == order(brute_exact(rows))


def test_exact_dedup_all_documents(docs, doc_rows, sf_dir):
    ours = order(tuple(r) for r in exact_dedup(docs).collect())
    assert ours == order(brute_exact(doc_rows))
    theirs = duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'").execute(ORACLE_SQL["op4_exact_dedup"]).fetchall()
    assert ours == order(theirs)


def test_exact_dedup_empty(empty):
    assert exact_dedup(empty).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(0, 1 << 63, (5000, 4)).astype(np.uint64)
    pilots, slots = build_perfect_hash(keys)
    assert sorted(slots.tolist()) == list(range(5000))
    assert (find_slots(keys, pilots) == slots).all()


def brute_simhash(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if x]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for k in range(64):
            ones[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * ones[k] > len(grams))


def brute_components(rows, radius=2):
    prints = [brute_simhash(t) for _, t in rows]
    distinct = sorted(set(prints))
    a = np.array(distinct, np.uint64)
    root = list(range(len(a)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a) <= radius):
            root[find(int(j))] = find(i)
    least = {}
    for (i, _), f in zip(rows, prints):
        k = find(distinct.index(f))
        least[k] = i if least.get(k) is None else least[k] if i is None else min(least[k], i)
    return [(i, f"{f:016x}", least[find(distinct.index(f))]) for (i, _), f in zip(rows, prints)]


@pytest.mark.parametrize("node_size", [2, 4096])
def test_simhash_components(edge, rows, node_size):
    assert order(tuple(r) for r in simhash_components(edge, node_size=node_size).collect()) == order(brute_components(rows))


def test_simhash_components_all_documents(docs, doc_rows):
    assert order(tuple(r) for r in simhash_components(docs, node_size=16).collect()) == order(brute_components(doc_rows))


def test_simhash_empty(empty):
    assert simhash_components(empty).count() == 0
    assert similar_groups(empty).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_trie_join_finds_all_pairs(radius):
    g = np.random.default_rng(radius)
    base = g.integers(0, 1 << 63, 40).astype(np.uint64)
    a = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << g.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << g.integers(0, 64, 40).astype(np.uint64)) for _ in range(10)]))
    got = sorted((int(x), int(y)) for i, j in linked_pairs(a, a, True, radius, small=1, frontier=64) for x, y in zip(i, j))
    i, j = np.nonzero(np.triu(np.bitwise_count(a[:, None] ^ a[None]) <= radius, 1))
    assert got == sorted(zip(i.tolist(), j.tolist()))


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (None, 3), (7, 7), (100, 101)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_similar_groups(edge):
    groups = {r["doc_id"]: r["group_id"] for r in similar_groups(edge).collect()}
    assert groups[10] == 9 and groups[13] == 12  # a copy, and a near copy
    assert groups[2] == 1 and groups[3] == 1 and groups[5] == 4
    assert not {7, 8, 11, 14, 16} & groups.keys()


def test_similar_groups_when_all_share_passages(spark):
    """Common passages put all texts in one block; only the near copies are linked."""
    common = " ".join(f"c{i}" for i in range(12))
    rows = [(i, common + " " + " ".join(f"d{i}x{k}" for k in range(60))) for i in range(60)]
    rows += [(1000 + i, t + " tail") for i, t in rows[:20]]
    found = {r["doc_id"]: r["group_id"] for r in similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), block=8).collect()}
    assert {1000 + i: i for i in range(20)}.items() <= found.items()
    assert not set(range(20, 60)) & found.keys()


def test_similar_groups_in_parts(spark, monkeypatch, tmp_path):
    """Blocks far above the size of a part: no task holds more than two parts and the pivots, and no near copy is lost."""
    import wattsift.llm.simhash_dedup as module

    task, seen = module._similar_task, str(tmp_path / "sizes")

    def watched(radius, least):
        run = task(radius, least)

        def counted(rows):
            with open(seen, "a") as f:
                f.write(f"{len(rows)}\n")
            return run(rows)

        return counted

    monkeypatch.setattr(module, "_similar_task", watched)
    base = [f"b{k}" for k in range(120)]
    copies = [(i, " ".join([*base[: 2 * i], f"e{i}", *base[2 * i + 1 :]])) for i in range(60)]
    passage = " ".join(f"c{k}" for k in range(40))
    unlike = [(1000 + i, passage + " " + " ".join(f"d{i}x{k}" for k in range(80))) for i in range(200)]
    near = [(5000 + i, t + " tail") for i, t in unlike]
    found = {r["doc_id"]: r["group_id"] for r in similar_groups(spark.createDataFrame(copies + unlike + near, "doc_id long, text string"), block=16, dealt=16).collect()}
    assert {k: v for k, v in found.items() if k != v} == {i: 0 for i in range(1, 60)} | {6000 + i: 1000 + i for i in range(200)}
    with open(seen) as f:
        assert 16 < max(map(int, f)) < 100


def test_similar_groups_are_of_exact_similarity(spark):
    """Pairs from 0.8 on are linked and those just below are not, for short and long texts."""
    rows, want = [], {}
    for n, size in enumerate([45, 60, 200, 400] * 5):
        for near in (False, True):
            # the tail replaces so many words that the similarity is the least from 0.8 on, or the greatest below
            cut = max(c for c in range(size) if (size - 4 - c) / (size - 4 + c) >= 0.8) + (not near)
            i = 10 * (2 * n + near)
            words = [f"w{i}x{k}" for k in range(size)]
            rows += [(i, " ".join(words)), (i + 1, " ".join(words[: size - cut] + [f"v{i}x{k}" for k in range(cut)]))]
            if near:
                want[i + 1] = i
    found = {r["doc_id"]: r["group_id"] for r in similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), radius=64).collect()}
    assert {k: v for k, v in found.items() if k != v} == want


def brute_similar(rows, similarity=0.8):
    """{doc_id: group_id} by the Jaccard similarity of all pairs of five-word shingle sets."""
    sets = []
    for i, t in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))))
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            holders[g].append(k)
    pairs = {(a, b) for own in holders.values() for n, a in enumerate(own) for b in own[n + 1 :]}
    for a, b in pairs:
        (i, x), (j, y) = sets[a], sets[b]
        both = len(x & y)
        if both >= similarity * (len(x) + len(y) - both) - 1e-9:
            low, high = sorted((find(i), find(j)))
            root[high] = low
    groups = defaultdict(list)
    for i in root:
        groups[find(i)].append(i)
    return {i: g for g, own in groups.items() if len(own) > 1 for i in own}


@pytest.mark.parametrize("block, dealt", [(4, 16), (2048, 1024)])
def test_similar_groups_all_documents(docs, doc_rows, block, dealt):
    """The same groups as of all pairs, with blocks compared whole and in parts."""
    others = lambda groups: {i: g for i, g in groups.items() if i != g}
    found = {r["doc_id"]: r["group_id"] for r in similar_groups(docs, block=block, dealt=dealt).collect()}
    assert others(found) == others(brute_similar(doc_rows))
