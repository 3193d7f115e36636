import random

import numpy as np

from sieveline.llm import near_dedup


def brute(rows, n=3, percent=85):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(near_dedup.shingles(near_dedup.words(t or ""), n))
    own = [(i, s) for i, many in sets.items() if i is not None for s in many]
    root = {i: i for i, _ in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(own):
        for j, b in own[:k]:
            c = len(a & b)
            if c and 100 * c >= percent * (len(a) + len(b) - c):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in own}


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(120)]
    rows, i = [], 100
    for size in (2, 3, 30, 120):  # groups of near copies, drifting away from their first
        base = [word() for _ in range(rng.choice([40, 150, 400]))]
        for _ in range(size):
            i += 1
            rows.append((i, " ".join(base)))
            base = list(base)
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = word()
    for _ in range(150):  # a passage that many share without being copies
        i += 1
        rows.append((i, " ".join(passage + [word() for _ in range(rng.randint(10, 160))])))
    rows += [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One\x0btwo "), (8, "É b c"), (9, "é b c"), (10, "x " * 30000), (11, "x x x")]
    rng.shuffle(rows)
    return rows


def test_classes_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 5) for i, t in rows] + [(None, "one", 5), (4, "one", 5)], "doc_id long, text string, component_id int")
    out = near_dedup.near_duplicates(df).collect()
    want = brute(rows)
    assert len(out) == len(rows) + 2
    for r in out:
        text = dict(rows).get(r.doc_id, "one") or ""
        assert r.n_shingles == len(near_dedup.shingles(near_dedup.words(text), 3))
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id == r.component_id)
    assert near_dedup.near_duplicates(df.where("false")).count() == 0
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([str(i) for i, _ in rows if want[i] == i] + ["None", "4"])


def test_rounds_go_on_for_buckets_with_several_classes(spark):
    """Bands of one coordinate put unlike documents into one bucket, so hubs have to follow each other."""
    rng = random.Random(5)
    common = ["w%d" % k for k in range(60)]
    rows = [(i, " ".join(common[: 58 - i % 7] + [f"u{i}x{k}" for k in range(rng.choice([2, 25, 60]))])) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, bands=24, rows=1).collect()}
    assert got == brute(rows)


def test_several_texts_under_one_id(spark):
    rows = [(1, "a b c d"), (2, "e f g h"), (2, "a b c d"), (3, "e f g h")]
    got = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}


def test_three_and_more_texts_under_one_id(spark):
    unlike = [" ".join(f"t{k}x{j}" for j in range(9)) for k in range(6)]
    rows = [(k + 1, t) for k, t in enumerate(unlike)] + [(50, t) for t in unlike] + [(7, "z " * 9)]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in out} == {*((i, 1) for i in (*range(1, 7), 50)), (7, 7)}


def test_hubs_with_several_texts(spark):
    """Each near copy of any of a hub's texts is linked with it."""
    base = [[f"b{k}w{j}" for j in range(60)] for k in range(3)]
    rows = [(1, " ".join(t)) for t in base]
    rows += [(10 * k + i, " ".join([*t[:59], f"end{k}{i}"])) for k, t in enumerate(base, 1) for i in range(4)]
    got = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(brute(rows).items())


def test_classes_named_by_an_id_outside_the_buckets(spark):
    rng = random.Random(5)
    common = ["w%d" % k for k in range(60)]
    rows = [(i + 100, " ".join(common[: 58 - i % 7] + [f"u{i}x{k}" for k in range(rng.choice([2, 25, 60]))])) for i in range(90)]
    apart = " ".join(f"apart{j}" for j in range(30))
    rows += [(0, apart)] + [(i, t) for i in range(500, 520) for t in (apart, rows[3 * (i - 500) + 20][1])]
    got = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bands=24, rows=1).collect()}
    assert got == set(brute(rows).items())


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(3)
    for n in (1, 2, 30, 400, 50_000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        bins = near_dedup.sketch(a, 128)
        assert bins.max() != 0xFFFFFFFFFFFFFFFF and (near_dedup.sketch(a[::-1].copy(), 128) == bins).all()
    both = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
    a, b = np.r_[both, rng.integers(0, 1 << 63, 100, dtype=np.uint64)], np.r_[both, rng.integers(0, 1 << 63, 100, dtype=np.uint64)]
    assert abs((near_dedup.sketch(a, 2048) == near_dedup.sketch(b, 2048)).mean() - 0.8) < 0.05


def test_linked_members_of_a_center_share_a_difference_key(spark, tmp_path):
    """Not those that both are linked with the center; the shared place has to leave room for what they need in common."""
    from sieveline.llm.common import Scratch

    rng = random.Random(8)
    for percent in (60, 80, 85):
        center = set(range(rng.randint(30, 60)))
        sets = {}
        for i in range(150):
            s = set(sets[rng.randrange(i)]) if i and rng.random() < 0.6 else set(center)
            for _ in range(rng.randint(1, 9)):
                s.discard(rng.choice(sorted(s))) if rng.random() < 0.5 else s.add(rng.randint(1000, 1060))
            sets[i] = s
        rows = [(i, -1, len(s), len(center), len(s ^ center), sorted(s ^ center)) for i, s in sets.items() if s != center]
        df = spark.createDataFrame(rows, "a long, b long, n long, nb long, d long, x array<long>")
        scratch = Scratch(spark, "keys")
        got = near_dedup.difference_keys(near_dedup.differences(scratch, df), percent).collect()
        by = {}
        for r in got:
            by.setdefault(r.a, {}).setdefault(r.key, r)
        linked = lambda x, y, p=percent: 100 * len(x & y) >= p * len(x | y)
        seen = 0
        for i, x in sets.items():
            for j in range(i):
                y = sets[j]
                if x != y and x != center and y != center and linked(x, y) and not (linked(x, center) and linked(y, center)):
                    seen += 1
                    both = by.get(i, {}).keys() & by.get(j, {}).keys()
                    first = [k for k in both if min(by[i][k].d - by[i][k].pos, by[j][k].d - by[j][k].pos) >= len((x ^ center) & (y ^ center))]
                    assert first
        assert seen > 20


def test_a_bucket_of_many_unlinked_near_neighbours(spark, monkeypatch):
    """Copies of a text that isn't there, each with changes of its own: they fill buckets, and few pairs of them are compared."""
    from sieveline.llm.common import Scratch

    rng = random.Random(4)
    base = [f"w{k}" for k in range(110)]
    rows = []
    for i in range(2000):
        t = list(base)
        for place in rng.sample(range(110), rng.choice([1, 2, 6, 8])):
            t[place] = f"new{rng.randrange(40)}"
        rows.append((i, " ".join(t)))
    made, save = {}, Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [near_dedup.shingles(t.encode().split(), 3) for _, t in rows]
    names = {g: k for k, g in enumerate({g for x in sets for g in x})}
    has = np.zeros((len(rows), len(names)), dtype=np.float32)
    for i, x in enumerate(sets):
        has[i, [names[g] for g in x]] = 1
    common, size = has @ has.T, has.sum(axis=1)
    linked, want = 100 * common >= 85 * (size[:, None] + size - common), np.arange(len(rows))
    while True:
        lower = np.where(linked, want[None, :], len(rows)).min(axis=1)
        if (lower == want).all():
            break
        want = lower
    assert got == dict(enumerate(want.tolist()))
    assert sum(n for name, n in made.items() if name.startswith("found-")) < 60 * len(rows)
