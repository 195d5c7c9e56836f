"""Top N, splits, near-duplicates and overlaps against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from doctax.llm import neardup, overlap, splits, topn


def brute_top(rows, n):
    groups = {}
    for g, i, s in rows:
        if s is not None and np.isfinite(s):
            groups.setdefault(g, []).append((-s, i if i is not None else 1 << 62))
    return [(g, i) for g, v in groups.items() for _, i in sorted(v)[:n]]


@pytest.mark.parametrize("n", [1, 3, 10])
def test_top_n_with_ties_skew_and_bad_scores(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), i, rng.choice([None, float("nan"), float("inf"), 0.0, -0.0, -1.5, 2.25, rng.random(), rng.random()])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, id bigint, score double").withColumn("__score2", F.lit(1)).repartition(5)
    got = topn.top_n_per_group(df, ["g"], "score", "id", n, block_rows=200)
    assert sorted(((r.g, r.id) for r in got.collect()), key=str) == sorted(brute_top(rows, n), key=str)
    assert got.columns == df.columns


def test_top_n_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([("g", 1, 1.0)] * 7 + [("g", 2, 0.5)], "g string, id bigint, score double")
    assert [r.id for r in topn.top_n_per_group(df, ["g"], "score", "id", 5).collect()] == [1] * 5
    assert topn.top_n_per_group(df.limit(0), ["g"], "score", "id", 5).count() == 0


def test_shared_folder_is_a_must_on_a_cluster():
    from types import SimpleNamespace as N

    from doctax.llm import common

    unset = N(getConf=lambda: {}, _jsc=N(sc=lambda: N(getCheckpointDir=lambda: N(isDefined=lambda: False))), master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(N(sparkContext=unset, conf=N(get=lambda *_: None)))


def test_labels_must_be_few(spark, monkeypatch):
    monkeypatch.setattr(splits, "MOST_LABELS", 3)
    counts = spark.createDataFrame([(i, str(i), 1) for i in range(4)], "component bigint, label string, n bigint")
    with pytest.raises(ValueError, match="labels"):
        splits.stratified_assignment(counts, [("a", 1.0)])


def test_cutoffs_hold_exactly_n():
    rng = np.random.default_rng(0)
    group, code = rng.integers(0, 40, 5000), rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    need = np.minimum(np.bincount(group, minlength=40), 7)
    cut, above = topn.bisect_cutoffs(group, code, need)
    for g in range(40):
        own = np.sort(code[group == g])[::-1]
        assert own[need[g] - 1] == cut[g] and above[g] == (own > cut[g]).sum()


SPELLINGS = {
    "a/b-1.md": ["a/b-1.md", " A/B-1.MD\t", "./a//b-1.md", "a\\b-1.md", "a/x/../b-1.md", "a%2Fb%2D1.md", "a/b-1.md#page=3", "file:///a/b-1.md", "a/b-1.md?x=1"],
    "a/b+1.md": ["a/b+1.md", "a/b%2B1.md"],
}


def test_spellings(spark):
    rows = spark.createDataFrame([(k, s) for k, v in SPELLINGS.items() for s in v], "k string, s string")
    assert all(r.k == r.c for r in rows.withColumn("c", splits.canonical_source(F.col("s"))).collect())
    odd = spark.createDataFrame([(None,), ("",), ("../x",), ("c/b-1.md",), ("a/b-1.txt",), ("100%.md",)], "s string")
    assert [r.c for r in odd.select(splits.canonical_source(F.col("s")).alias("c")).collect()] == [None, "", "../x", "c/b-1.md", "a/b-1.txt", "100%.md"]


def test_components(spark):
    rng = random.Random(3)
    rows = [(str(rng.randint(0, 60)) if rng.random() > 0.1 else None, str(rng.randint(0, 60)) if rng.random() > 0.1 else None) for _ in range(70)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for k, (a, b) in enumerate(rows):
        for e in (("p", a), ("q", b)):
            if e[1] is not None:
                parent[find(("r", a, b))] = find(e)
    got = {(r.p, r.q): r.component for r in splits.connected_groups(spark.createDataFrame(rows, "p string, q string"), ["p", "q"]).collect()}
    for x in got:
        for y in got:
            assert (got[x] == got[y]) == (find(("r", *x)) == find(("r", *y)))
    assert splits.connected_groups(spark.createDataFrame([], "p string, q string"), ["p", "q"]).count() == 0


def test_assignment_keeps_proportions(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["x", "y", None]), rng.randint(1, 9)) for i in range(3000)] + [(9999, "x", 1500)]
    counts = spark.createDataFrame(rows, "component bigint, label string, n bigint")
    got = splits.stratified_assignment(counts, [("test", 0.1), ("train", 0.8), ("validation", 0.1), ("none", 0.0)])
    assert got.groupBy("component").count().where("count > 1").count() == 0
    size = {r.split: r.n for r in counts.join(got, "component").groupBy("split").agg(F.sum("n").alias("n")).collect()}
    total = sum(size.values())
    assert set(size) == {"test", "train", "validation"} and abs(size["train"] / total - 0.8) < 0.02 and abs(size["test"] / total - 0.1) < 0.02
    assert splits.stratified_assignment(counts.limit(0), [("a", 1.0)]).count() == 0


WORD = re.compile(r"[^\W_]+")


def texts(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    made = []
    for _ in range(n):
        if made and rng.random() < 0.5:
            words = rng.choice(made).split()
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 2)] = [rng.choice(vocabulary) for _ in range(rng.randint(0, 2))]
            if rng.random() < 0.3:
                half = len(words) // 2
                words = words[half:] + words[:half]
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(3, 40))]
        made.append(" ".join(words) or "w")
    made += ["", " ", "w1 " * 30, "ÄÖ Straße１２ 你好 " * 6, made[0].upper().replace(" ", " – ")]
    return list(enumerate([*made, None]))


def brute_pairs(rows, k, threshold, least):
    sets = {}
    for i, t in rows:
        words = WORD.findall((t or "").lower())
        if len(words) >= max(least, k):
            sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize("k,threshold,boundary", [(3, 0.5, None), (3, 0.5, 25), (5, 0.8, None), (1, 0.6, 1000), (2, 0.34, 12)])
def test_near_duplicates_equal_brute_force(spark, k, threshold, boundary):
    rows = texts(220, int(threshold * 100) + k)
    df = spark.createDataFrame([*rows, rows[3]], "id bigint, t string").repartition(3)
    got = neardup.near_duplicates(df, "id", "t", k, threshold, 6, boundary).collect()
    assert len(got) == len(set(got)) and {(r.a, r.b) for r in got} == brute_pairs(rows, k, threshold, 6)


def test_many_copies_are_a_star(spark):
    same = "one two three four five six seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(i, same) for i in range(100)] + [(200, same + " thirteen")], "id bigint, t string")
    got = {(r.a, r.b) for r in neardup.near_duplicates(df, "id", "t", 3, 0.5, 1).collect()}
    assert got == {(0, i) for i in range(1, 100)} | {(0, 200)}
    groups = neardup.duplicate_groups(df, "id", "t", 3, 0.5)
    assert groups.count() == 101 and {r.group_id for r in groups.collect()} == {0}
    assert {(r.rep, r.links) for r in groups.collect()} == {(0, 100), (200, 1)}


def test_groups_have_every_id(spark):
    rows = [(1, "Contents"), (2, "contents!"), (3, "Contents page"), (4, None), (5, ""), (6, "a b c d e f g"), (7, "A b c d e, f g"), (None, "Contents"), (1, "Contents")]
    got = {r.id: (r.group_id, r.rep, r.links) for r in neardup.duplicate_groups(spark.createDataFrame(rows, "id bigint, t string"), "id", "t").collect()}
    assert got == {1: (1, 1, 1), 2: (1, 1, 1), 3: (3, 3, 0), 4: (4, 4, 0), 5: (5, 5, 0), 6: (6, 6, 1), 7: (6, 6, 1)}


@pytest.mark.parametrize("parts,hot,boundary", [(1, 10, 0), (40, 6, 30), (7, 50_000, 18)])
def test_blocks_of_long_lists_and_any_number_of_parts(spark, parts, hot, boundary):
    rows = texts(200, 77)
    df = spark.createDataFrame(rows, "id bigint, t string").repartition(3)
    got = neardup.near_duplicates(df, "id", "t", 2, 0.5, 4, boundary, parts, hot).collect()
    assert len(got) == len(set(got)) and {(r.a, r.b) for r in got} == brute_pairs(rows, 2, 0.5, 4)


def test_tiers_of_very_different_sizes(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        words = [f"v{rng.randrange(400)}" for _ in range(int(6 * 2 ** (rng.random() * 8)))]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(words[: rng.randint(len(words) // 2, len(words))])), (3 * i + 2, " ".join(w for w in words if rng.random() > 0.05))]
    df = spark.createDataFrame(rows, "id bigint, t string").repartition(3)
    assert len(neardup.size_tiers({len(t.split()): 1 for _, t in rows}, 0.5, 0)) > 2
    for boundary in (None, 40):
        got = neardup.near_duplicates(df, "id", "t", 2, 0.5, 1, boundary).collect()
        assert {(r.a, r.b) for r in got} == brute_pairs(rows, 2, 0.5, 1)


def test_no_texts(spark):
    empty = spark.createDataFrame([], "id bigint, t string")
    assert neardup.near_duplicates(empty, "id", "t").count() == 0
    assert neardup.near_duplicates(spark.createDataFrame([(1, None), (2, "a b")], "id bigint, t string"), "id", "t").count() == 0


def test_boundary_by_cost():
    sizes = {8: 100_000, 100: 100_000}
    assert neardup.small_boundary(sizes, 1e4, 0.5) == 8
    assert neardup.small_boundary(sizes, 1.0, 0.5) == 0


def test_small_sets_enumerate_pairs_by_cost(spark):
    rng = np.random.default_rng(3)
    drawn = rng.integers(0, 18, (4000, 9))
    rows = [(i, " ".join(f"v{x}" for x in row)) for i, row in enumerate(drawn)]
    join = neardup.SimilarSets(spark.createDataFrame(rows, "id bigint, t string").repartition(3), "id", "t", 1, 0.8)
    assert join.boundary > 0
    has = np.zeros((4000, 18))
    has[np.arange(4000)[:, None], drawn] = 1
    size, common = has.sum(1), has @ has.T
    a, b = np.nonzero(np.triu(common >= 0.8 * (size[:, None] + size[None, :] - common) - 1e-9, 1))
    got = neardup.expanded(join.links(), join.members, None).unionByName(neardup.copy_pairs(join.members))
    assert {(r.a, r.b) for r in got.distinct().collect()} == set(zip(a.tolist(), b.tolist()))


def test_overlaps_equal_brute_force(spark):
    rows = texts(160, 9)
    split = [random.Random(i).choice(["train", "test", "validation", None]) for i in range(len(rows))]
    df = spark.createDataFrame([(i, t, s) for (i, t), s in zip(rows, split)], "id bigint, t string, s string")
    got = {(r.train_id, r.eval_id) for r in overlap.cross_split_overlaps(df, "id", "t", "s", k=3, threshold=0.5, min_words=6).collect()}
    want = set()
    for a, b in brute_pairs(rows, 3, 0.5, 6):
        if split[a] and split[b] and (split[a] == "train") != (split[b] == "train"):
            want.add((a, b) if split[a] == "train" else (b, a))
    assert got == want


def test_overlaps_list_all_members_of_large_classes(spark):
    same = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(i, same, "train") for i in range(70)] + [(100 + i, same, "test" if i % 2 else "validation") for i in range(80)] + [(500, same + " thirteen", "test")]
    df = spark.createDataFrame(rows, "id bigint, t string, s string").repartition(3)
    got = [(r.train_id, r.eval_id) for r in overlap.cross_split_overlaps(df, "id", "t", "s", k=3, threshold=0.5, min_words=12).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i in range(70) for j in [*range(100, 180), 500]}


def test_report_counts_all_members_of_large_classes(spark, tmp_path):
    same = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(0, same, "train", "a.md")] + [(i, same, "validation" if i <= 30 else "test", "b.md" if i <= 30 else "c.md") for i in range(1, 71)]
    spark.createDataFrame(rows, "chunk_id bigint, text string, split_name string, source string").write.parquet(str(tmp_path / "chunks.parquet"))
    got = {tuple(r) for r in overlap.p6_report(spark, str(tmp_path)).collect()}
    assert got == {("validation", "b.md", 30, 30, 1), ("test", "c.md", 40, 40, 1)}


def test_banded_distance():
    rng = np.random.default_rng(1)
    one, two = [], []
    for _ in range(80):
        a = rng.permutation(50)[: rng.integers(0, 30)]
        one.append(a.astype(np.int64))
        two.append(np.concatenate([a[rng.random(len(a)) < 0.7], rng.integers(50, 60, rng.integers(0, 4))]).astype(np.int64))
    most = rng.integers(1, 20, 80)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last, row = row, [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[-1]))
        return row[-1]

    want = [min(len(a) + len(b) - 2 * lcs(a, b), m + 1) for a, b, m in zip(one, two, most)]
    assert overlap.banded_distance(one, two, most).tolist() == want
    assert (overlap.least_distance(one, two) <= np.array([len(set(a) ^ set(b)) for a, b in zip(one, two)])).all()
