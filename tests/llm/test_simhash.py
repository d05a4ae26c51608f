import itertools

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from trajspark.llm import simhash_dedup as s
from trajspark.llm.components import connected_components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_groups(fps):
    """Smallest id reachable, by a search over all pairs."""
    group = {i: i for i, _ in fps}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for (i, a), (j, b) in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 3:
            x, y = sorted((top(i), top(j)))
            group[y] = x
    return {i: top(i) for i, _ in fps}


@pytest.mark.parametrize("text", [None, "", " \n ", "one", "Two WORDS", "a b c", "É é A a É b", "a b c d " * 50, "x\x0by\x0cz w"])
def test_fingerprint(text):
    assert s.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


def test_fingerprint_of_a_long_text_in_chunks():
    text = " ".join(str(i * i % 977) for i in range(400_000))
    assert s.fingerprint(text.encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("parts", [2, 4, 8])
def test_blocks_find_all_near_pairs(spark, parts):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = [x ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), False))) for x in base for _ in range(4)]
    fps = np.unique(np.array([*base, *near, 0, 2**64 - 1], np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    roots = {r.node: r.root for r in connected_components(s.fingerprint_links(df, parts=parts)).collect()}
    want = brute_groups([(int(np.int64(x.view(np.int64))), int(x)) for x in np.sort(fps)])
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    full = {int(x): roots.get(int(x), int(x)) for x in fps.view(np.int64)}
    assert groups(full) == groups(want)


@pytest.mark.parametrize("tile_rows", [1, 7, 10**6])
def test_split_tiles_find_all_near_pairs(spark, tile_rows):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    near = [x ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), False))) for x in base for _ in range(9)]
    fps = np.unique(np.array([*base, *near], np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    roots = {r.node: r.root for r in connected_components(s.fingerprint_links(df, tile_rows=tile_rows)).collect()}
    want = brute_groups([(int(np.int64(x.view(np.int64))), int(x)) for x in np.sort(fps)])
    full = {int(x): roots.get(int(x), int(x)) for x in fps.view(np.int64)}
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert groups(full) == groups(want)


def test_one_row_of_each_group_whatever_ids_repeat(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(80)) for c in "xyz")
    rows = [(1, one, "a"), (1, two, "b"), (1, two, "c"), (2, one + " end", "d"), (None, three, "e"), (None, three, "f"), (None, one, "g"), (3, None, "h"), (None, "", "i")]
    names = ["__keep", "__nth", "row", "fp", "id", "key"]
    docs = spark.createDataFrame([(*r, *names) for r in rows], "doc_id bigint, text string, v string, " + ", ".join(f"`{n}` string" for n in names))
    kept = s.simhash_dedup(docs)
    assert kept.columns == docs.columns and all(list(r)[3:] == names for r in kept.collect())
    near = (brute_fingerprint(one) ^ brute_fingerprint(one + " end")).bit_count() <= 3
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(0, three), (1, one), (1, two), (3, "")] + ([] if near else [(2, one + " end")]))
    assert s.simhash_dedup(docs, parts=8).count() == kept.count()


def test_groups_and_dedup(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(5, long, "a"), (3, long, "b"), (9, long + " tail", "c"), (4, "quite another text here", "d"), (4, "quite another text here", "d"), (7, None, "e"), (8, "", "f"), (None, long, "g"), (None, "lonely text without id", "h")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    got = s.simhash_groups(docs).collect()
    assert len(got) == len(rows)
    fps = [(i, brute_fingerprint(t)) for i, t, _ in rows if i is not None]
    want = brute_groups(list(dict.fromkeys(fps)))
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id]
    assert {r.fingerprint for r in got if r.doc_id in (7, 8)} == {"0" * 16}
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is None} == {(None, want[3]), (None, None)}
    kept = s.simhash_dedup(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(want.values()))
    assert [r.fp for r in kept if r.doc_id is None] == ["h"]
    assert s.simhash_dedup(docs).columns == docs.columns


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert s.simhash_groups(docs).collect() == []
    assert s.simhash_dedup(docs).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}, 200: 200, 201: 200}


@pytest.mark.parametrize("hub", [0, 3, 1000])
def test_hubs_are_joined_by_broadcast(spark, monkeypatch, hub):
    from trajspark.llm import components

    monkeypatch.setattr(components, "HUB_EDGES", hub)
    rng = np.random.default_rng(9)
    links = [(7, k) for k in range(100, 300)] + [(k, 7000) for k in range(250, 400)] + [tuple(map(int, rng.integers(0, 2000, 2) + 10_000)) for _ in range(900)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    top = {n: n for x in links for n in x}

    def root(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        top[y] = x
    lonely = {a for a, b in links if a == b} - {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: root(n) for n in top if n not in lonely}
