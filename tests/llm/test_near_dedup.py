import random
import re
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest

from spanforest.llm import near_dedup as nd

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def multiset(text):
    w = WORD.findall((text or "").lower())
    n = min(5, len(w))
    counts = {}
    for i in range(len(w) - n + 1 if n else 0):
        k = tuple(w[i : i + n])
        counts[k] = counts.get(k, 0) + 1
    return counts


def jaccard(a, b):
    keys = a.keys() | b.keys()
    top = sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / top if top else 0.0


def brute_groups(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, multiset(t))
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.8:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def changed(rng, base, k):
    w = list(base)
    for _ in range(k):
        at = rng.randrange(len(w))
        if rng.random() < 0.2 and len(w) > 30:
            del w[at]
        else:
            w[at] = f"n{rng.randrange(10**9)}"
    return w


def test_groups_equal_brute_force(spark):
    rng = random.Random(11)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, i = [], 0
    hot = say(120)
    for _ in range(150):  # a hot group whose members differ each in its own way, many beyond the threshold
        rows.append((i, " ".join(changed(rng, hot, rng.choice([0, 1, 1, 2, 3, 4, 6])))))
        i += 1
    for _ in range(15):
        base = say(rng.choice([4, 6, 30, 80, 300]))
        for _ in range(rng.choice([1, 2, 4])):
            rows.append((i, ", ".join(changed(rng, base, rng.choice([0, 1, 2, 4])))))
            i += 1
    repeated = " ".join(["same words again"] * 40)
    extra = [None, "", "!!!", "one", "ONE", "two words", repeated, repeated + " same words", " ".join(hot).upper(), "x " * 20000, "x " * 24000, "x " * 30000]
    rows += [(1000 + k, t) for k, t in enumerate(extra)] + [(1000, None), (1003, "one"), (None, "one"), (None, None)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, bands int").repartition(5)
    got = nd.near_duplicates(docs).collect()
    want = brute_groups(rows)
    assert len(got) == len(rows)
    named = [r for r in got if r.doc_id is not None]
    assert {r.doc_id: r.group_id for r in named} == want
    sizes = {g: sum(v == g for v in want.values()) for g in set(want.values())}
    assert all(r.group_size == sizes[r.group_id] and r.kept == (r.doc_id == r.group_id) for r in named)
    assert all(r.group_id is None and r.kept for r in got if r.doc_id is None)
    left = nd.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted({r.doc_id for r in left.collect() if r.doc_id is not None}) == sorted(set(want.values()))
    assert nd.near_duplicates(docs.limit(0)).count() == 0


def test_hot_change_is_linear(spark, monkeypatch):
    """n texts share a change of 15 % against a more popular group: comparisons grow with n, not with its square."""
    verify, differ = nd.verified, nd.differences
    made = []

    def counting(f):
        def run(pairs, *rest):
            pairs = nd.written(pairs, "counted")
            made.append(pairs.count())
            return f(pairs, *rest)

        return run

    monkeypatch.setattr(nd, "verified", counting(verify))
    monkeypatch.setattr(nd, "differences", counting(differ))
    many = {}
    for n in (40, 160):
        rng = random.Random(n)
        base = [f"w{rng.randrange(5000)}" for _ in range(400)]
        other = list(base)
        for at in range(0, 400, 33):
            other[at] = f"shared{at}"
        rows = [" ".join(changed(rng, base, rng.choice([0, 1, 2]))) for _ in range(int(1.6 * n))] + [" ".join(changed(rng, other, rng.choice([0, 1, 2]))) for _ in range(n)]
        rows = list(enumerate(rows))
        made.clear()
        got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert {r.doc_id: r.group_id for r in got} == brute_groups(rows) and len({r.group_id for r in got}) == 2
        many[n] = sum(made)
    assert many[160] <= 4.5 * many[40] and many[160] <= 5 * 2.6 * 160


def test_tables_on_the_way_are_swept(spark):
    folder = Path(urlparse(spark.conf.get("spark.checkpoint.dir")).path)
    before = {p.name for p in folder.iterdir()}
    got = nd.near_duplicates(spark.createDataFrame([(i, "some words that stand here twice or more " * 3 + str(i % 3)) for i in range(30)], "doc_id long, text string"))
    assert sorted(p.name.split("-")[0] + "-" + p.name.split("-")[1] for p in folder.iterdir() if p.name not in before) == ["group-sizes", "near-rows"]
    assert got.count() == 30


def test_repeated_ids_lose_no_text(spark):
    rng = random.Random(5)
    a, b, c = (" ".join(f"{k}{rng.randrange(900)}" for _ in range(60)) for k in "abc")
    rows = [(1, a), (7, a + " more"), (7, b), (7, b), (9, b), (9, c), (4, c), (None, a), (12, a)]
    for order in (rows, rows[::-1]):
        left = nd.drop_near_duplicates(spark.createDataFrame(order, "doc_id long, text string").repartition(2)).collect()
        # Of the two texts of 7 one is compared with others; no row goes for the other text of its id.
        names = {a: "a", b: "b", c: "c", a + " more": "a more"}
        found = sorted((r.doc_id, names[r.text]) for r in left if r.doc_id is not None)
        assert [f for f in found if f != (7, "a more")] == [(1, "a"), (4, "c"), (7, "b"), (7, "b")] and sum(r.doc_id is None for r in left) == 1


def test_signature_is_unbiased_for_weighted_sets():
    rng = np.random.default_rng(3)
    trials, slots = 300, 64
    for a, b in (({1: 1, 2: 1, 3: 1}, {2: 1, 3: 1, 4: 1}), ({1: 7, 2: 1}, {1: 3, 2: 2}), ({1: 100, 2: 5}, {1: 37, 2: 9, 3: 20})):
        want = jaccard(a, b)
        doc, element, weight = [], [], []
        for t in range(trials):
            salt = rng.integers(1 << 62, dtype=np.uint64)
            for side, bag in enumerate((a, b)):
                for e, c in bag.items():
                    doc.append(2 * t + side)
                    element.append(nd.splitmix(np.array([salt + np.uint64(e)]))[0])
                    weight.append(c)
        s = nd.bag_min_hash(np.array(doc), np.array(element, np.uint64), np.array(weight), 2 * trials, slots)
        assert np.isfinite(s).all()
        agree = (s[::2] == s[1::2]).mean()
        assert abs(agree - want) < 4 * np.sqrt(want * (1 - want) / (trials * slots)) + 1e-3


def test_overlap_counts_occurrences():
    texts = ["a b c d e f", "a b c d e f a b c d e f", "a b c d e"]
    from spanforest.llm.common import binary
    from spanforest.llm.words import words
    import pyarrow as pa

    for x in texts:
        for y in texts:
            offsets, data = binary(pa.array([x, y]))
            doc, h = nd.runs(words(offsets, data))
            d, e, c = nd.counted(doc, h)
            bags = [dict(zip(e[d == k].tolist(), c[d == k].tolist(), strict=True)) for k in (0, 1)]
            assert jaccard(*bags) == pytest.approx(jaccard(multiset(x), multiset(y)))


def test_small_tables_are_few_files(spark, monkeypatch):
    rng = random.Random(12)
    texts = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(60)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, " ".join(changed(rng, t.split(" "), 1))) for i, t in enumerate(texts * 3)]
    files, plain = {}, nd.written

    def counted(df, what, **more):
        table = plain(df, what, **more)
        files[what] = max(files.get(what, 0), len(table.inputFiles()))
        return table

    monkeypatch.setattr(nd, "written", counted)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.doc_id: r.group_id for r in got} == brute_groups(rows)
    few = 2 * spark.sparkContext.defaultParallelism
    assert few < 64 and {k: n for k, n in files.items() if n > few and k not in ("multisets", "differences")} == {}
