import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from loamline.llm import exact_dedup as E
from loamline.llm import near_dup as N

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def test_perfect_hash_is_minimal_and_checked():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    shard = E.Shard.build(keys, list(range(5000)), list(range(5000)), [1] * 5000)
    at = shard.find(keys)
    assert sorted(at) == list(range(5000)) and [shard.winners[k] for k in at] == list(range(5000))
    others = [hashlib.sha256(f"x{i}".encode()).digest() for i in range(5000)]
    assert (shard.find(others) == -1).all()
    assert E.Shard.build([], [], [], []).find(others).tolist() == [-1] * 5000


def exact_expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = Counter()
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        keep, first = max(known) if known else None, True
        for i in sorted(ids, key=lambda x: (x is None, x or 0)):
            out[i, keep, len(ids), i == keep and first] += 1
            first = first and i != keep
    return out


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (3, "a"), (3, "a"), (5, "a "), (None, "b"), (4, "b"), (None, "c"), (None, "c"), (6, "x" * 200_000), (7, "x" * 200_000)], [(i, "hot" if i % 3 else f"t{i % 50}") for i in range(3000)]])
def test_exact_dedup(spark, rows):
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in E.exact_dedup(frame(spark, rows))[0].collect())
    assert got == exact_expected(rows)


def judged(rows):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept, r.seen) for r in rows.collect()}


def test_members_and_nonmembers(spark):
    """Both ways are taken in one call: texts of the first batch are members when the second comes."""
    rows = [(i, f"t{i % 40}" if i < 300 else f"own{i}") for i in range(400)]
    got = judged(E.exact_dedup(frame(spark, rows))[0])
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    assert {i: v[:3] for i, v in got.items()} == {i: (max(ids), len(ids), i == max(ids)) for ids in groups.values() for i in ids}
    assert 100 < sum(v[3] for v in got.values()) < 250 and any(v[3] and v[2] for v in got.values())


def test_history(spark):
    """Three tables one after another against one plain loop; the index keeps what came two tables ago."""
    tables = [[(1, "a"), (9, "b"), (3, "c")], [(5, "a"), (6, "d"), (7, "d")], [(4, "b"), (8, "c"), (2, "a"), (9, "b"), (10, "e"), (None, "d")]]
    index, known = None, {}
    for n, rows in enumerate(tables):
        got, index = E.exact_dedup(frame(spark, rows), history=index, shards=None if n else 4)
        want, old = {}, {t: list(ids) for t, ids in known.items()}
        for i, t in rows:
            known.setdefault(t, []).append(i)
        for i, t in rows:
            best = max(x for x in known[t] if x is not None)
            want[i] = (best, len(known[t]), i == best and i not in old.get(t, ()))
        assert {i: v[:3] for i, v in judged(got).items()} == want
        assert all(v[3] for i, v in judged(got).items() if dict(rows)[i] in old)
    held = E.index_groups(index).collect()
    assert {bytes(r.digest): (r.winner, r["size"]) for r in held} == {hashlib.sha256(t.encode()).digest(): (max(x for x in ids if x is not None), len(ids)) for t, ids in known.items()}


def test_another_number_of_shards(spark):
    old = [(i, f"t{i}") for i in range(50)]
    _, index = E.exact_dedup(frame(spark, old), shards=3)
    rows, index = E.exact_dedup(frame(spark, [(100 - i, t) for i, t in old] + [(200, "new")]), history=index, shards=8)
    got = judged(rows)
    assert {i for i, v in got.items() if v[2]} == {100 - i for i in range(50)} | {200} and sum(v[1] == 2 for v in got.values()) == 50
    assert {r.shards for r in index.select("shards").collect()} == {8} and E.index_groups(index).count() == 51
    with pytest.raises(ValueError, match="shards"):
        E.exact_dedup(frame(spark, old), history=index.unionByName(index.withColumn("shards", index.shards + 1)))


def test_nothing_leaves_the_history(spark):
    _, index = E.exact_dedup(frame(spark, [(1, "a")]))
    rows, index = E.exact_dedup(frame(spark, []), history=index)
    assert rows.count() == 0 and E.index_groups(index).count() == 1
    assert judged(E.exact_dedup(frame(spark, [(2, "a")]), history=index)[0]) == {2: (2, 2, True, True)}


def test_drop_repeats_keeps_columns(spark):
    schema = "doc_id bigint, text string, _id int, _digest string, _once int, _0 int, DIGEST string, kept boolean"
    df = spark.createDataFrame([(1, "a", 78, "x", 5, 1, "y", False), (2, "a", 79, "x", 6, 2, "y", False), (2, "a", 79, "x", 6, 2, "y", False), (3, None, 80, None, None, None, None, None)], schema)
    got = E.drop_repeats(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [(2, "a", 79, "x", 6, 2, "y", False), (3, None, 80, None, None, None, None, None)]
    same = spark.createDataFrame([(7, "hot", 0)] * 500 + [(i, "cold", 0) for i in range(9)], "doc_id bigint, text string, row int")
    assert sorted((r.doc_id, r.text) for r in E.drop_repeats(same).collect()) == [(7, "hot"), (8, "cold")]


def near_expected(rows, n=5, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        k = min(n, len(w))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links, texts = Counter(), defaultdict(set)
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                for x, y in ((a, b), (b, a)):
                    links[x] += 1
                    if sets[x] != sets[y]:
                        texts[x].add(sets[y])
                p, q = root(a), root(b)
                if p != q:
                    up[min(p, q)] = max(p, q)
    return {i: (root(i), len(texts[i]), links[i]) for i in ids}


def corpus(seed, groups=12, copies=9):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows, i = [], 0
    passage = [rnd.choice(words) for _ in range(60)]
    for _ in range(groups):
        base = [rnd.choice(words) for _ in range(rnd.randint(3, 200))]
        for _ in range(copies):
            own = base[:]
            for _ in range(rnd.randint(0, 4)):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            if rnd.random() < 0.3:
                own += passage
            rows.append((i, " ".join(own)))
            i += 1
    return [*rows, (i, None), (i + 1, ""), (i + 2, " \n "), (i + 3, "one two"), (i + 4, "one  two"), (i + 5, "one two three")]


@pytest.mark.parametrize(("seed", "dense"), [(1, 48), (2, 1), (3, 4)])
def test_near_duplicates(spark, monkeypatch, seed, dense):
    monkeypatch.setattr(N, "DENSE", dense)
    monkeypatch.setattr(N, "BLOCK", 4)
    rows = corpus(seed)
    got = {r.doc_id: (r.class_id, r.text_links, r.links) for r in N.near_duplicates(frame(spark, rows)).collect()}
    assert got == near_expected(rows)


def test_near_duplicates_of_nothing(spark):
    assert N.near_duplicates(frame(spark, [])).count() == 0
    df = frame(spark, [(1, None), (2, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")])
    kept = N.one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    clash = spark.createDataFrame([(1, "a b c d e f", 5, 6, "x"), (2, "a b c d e f", 7, 8, "y"), (None, None, 9, 9, "z")], "doc_id bigint, text string, _0 int, root int, CLASS_ID string")
    assert sorted(map(tuple, N.one_of_each(clash).collect()), key=str) == [(2, "a b c d e f", 7, 8, "y"), (None, None, 9, 9, "z")]


def test_one_id_on_two_texts(spark):
    one, two = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, one), (1, two), (2, one + " more"), (3, two + " more"), (0, one)]
    got = sorted((r.doc_id, r.class_id, r.text_links, r.links) for r in N.near_duplicates(frame(spark, rows)).collect())
    assert got == [(0, 2, 1, 2), (1, 2, 1, 2), (1, 3, 1, 1), (2, 2, 1, 2), (3, 3, 1, 1)]
    assert sorted((r.doc_id, r.text) for r in N.one_of_each(frame(spark, rows)).collect()) == [rows[2], rows[3]]
    both = [(5, one), (5, one + " more"), (4, one + " x"), (None, one), (None, one)]
    kept = sorted((r.doc_id or 0, r.text) for r in N.one_of_each(frame(spark, both)).collect())
    assert len(kept) == 2 and kept[0] == (0, one) and kept[1][0] == 5


def test_sizes_in_a_cluster(spark, monkeypatch):
    """Classes of many lengths that share bands: neighbouring size cells meet, however the blocks fall."""
    monkeypatch.setattr(N, "DENSE", 2)
    monkeypatch.setattr(N, "BLOCK", 3)
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[: rnd.randint(30, 400)])) for i in range(70)]
    got = {r.doc_id: (r.class_id, r.text_links, r.links) for r in N.near_duplicates(frame(spark, rows)).collect()}
    assert got == near_expected(rows)


def test_pruning_keeps_similar_pairs():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (20_000, N.VALUES), dtype=np.uint8)
    b = np.where(rng.random(a.shape) < 0.8, a, rng.integers(0, 256, a.shape, dtype=np.uint8))
    assert N.prune(a, b, 0.8).all()
    c = np.where(rng.random(a.shape) < 0.3, a, rng.integers(0, 256, a.shape, dtype=np.uint8))
    assert N.prune(a, c, 0.8).mean() < 0.01


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 102), (200, 200)]
    got = {r.node: r.root for r in N.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 20 for i in range(21)} | {100: 102, 101: 102, 102: 102}


def test_components_of_long_chains(spark, monkeypatch):
    shuffled = list(range(2000, 2400))
    random.Random(7).shuffle(shuffled)
    chains = [[999, *range(500)], shuffled]  # the largest number at one end, and numbers in no order
    edges = [e for c in chains for e in zip(c, c[1:], strict=False)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.root for r in N.components(df).collect()}
    assert got == {x: max(c) for c in chains for x in c}
    monkeypatch.setattr(N, "ROUNDS", 1)
    with pytest.raises(RuntimeError):
        N.components(df)


def test_a_long_chain_of_revisions_is_one_class(spark):
    words = [f"w{i}" for i in range(700)]
    order = [149, *range(149)]  # each revision is at 0.8 or more to the next only
    rows = [(i, " ".join(words[4 * k : 4 * k + 48])) for k, i in enumerate(order)]
    got = {r.doc_id: r.class_id for r in N.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: r[0] for i, r in near_expected(rows).items()} and set(got.values()) == {149}
