import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforest.llm import decontaminate, exact_dedup

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, kept string, key int"


def docs_of(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).repartition(parts)


def brute_copies(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACE.sub(" ", t or ""), []).append(i)
    out = []
    for t, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep = min(named) if named else None
        first = True
        for i in ids:
            kept = i == keep and first
            first = first and not kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 3, 20, 70])
def test_copies_equal_brute_force(spark, parts):
    rng = random.Random(parts)
    texts = ["", None, " ", "a b", "a\t\x0bb", "a  b", " a b", "a b", "é" * 3000, "x" * 50000, "long  text " * 150_000, *(f"t{i}" for i in range(30))]
    rows = [(i, rng.choice(texts)) for i in range(-5, 300)] + [(None, "a b"), (None, "only null"), (None, "only null"), (7, "t1"), (7, "t1"), (8, "same"), (8, "same")]
    got = exact_dedup.exact_duplicates(docs_of(spark, rows, parts)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_copies(rows)


def test_hot_text_and_empty_table(spark):
    rows = [(i, "hot text") for i in range(400)] + [(i, f"own {i}") for i in range(400, 800)]
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs_of(spark, rows, 40)).collect()}
    assert len(got) == 800 and all(got[i].keep_id == 0 and got[i].group_size == 400 for i in range(400)) and sum(r.kept for r in got.values()) == 401
    assert exact_dedup.exact_duplicates(docs_of(spark, [], 2)).count() == 0
    left = exact_dedup.drop_duplicates(docs_of(spark, rows))
    assert left.columns == ["doc_id", "text", "kept", "key"] and left.count() == 401


@pytest.mark.parametrize("order", [1, -1])
def test_texts_of_one_id_all_stay(spark, order):
    rows = [(5, "B"), (5, "A"), (3, "B"), (5, " A"), (5, "A"), (None, "A"), (None, "C"), (None, "C")][::order]
    left = exact_dedup.drop_duplicates(docs_of(spark, rows, 2)).collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=repr) == sorted([(3, "B"), (5, "A"), (5, " A"), (None, "C")], key=repr)


def test_merge_keeps_the_smallest_id():
    rng = random.Random(1)
    for _ in range(200):
        runs, number = [], 0
        for _ in range(rng.randrange(1, 6)):
            number += rng.randrange(1, 9)
            keys = sorted(rng.sample([bytes([c]) * exact_dedup.KEY for c in range(65, 75)], rng.randrange(1, 8)))
            runs.append([(k, null := int(rng.random() < 0.3), 0 if null else rng.randrange(-4, 5), number, rng.randrange(1, 4)) for k in keys])
        line = [e for run in runs for e in run]
        keeps = np.array([e[1:] for e in line], exact_dedup.KEEP)
        keys, out, _ = exact_dedup._merged(np.array([e[0] for e in line], f"S{exact_dedup.KEY}"), keeps)
        want = [(k, *min(e[1:4] for e in line if e[0] == k), sum(e[4] for e in line if e[0] == k)) for k in sorted({e[0] for e in line})]
        assert [(k, *o) for k, o in zip(keys.tolist(), out.tolist(), strict=True)] == want


def brute_hits(docs, items, window=10):
    def norm(t):
        return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    wanted = {}
    for i, t in items:
        w = norm(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            wanted.setdefault(tuple(w[k : k + window]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w = norm(t)
        hit, found = set(), set()
        for size in {len(k) for k in wanted}:
            for k in range(len(w) - size + 1):
                if (own := tuple(w[k : k + size])) in wanted:
                    hit |= set(range(k, k + size))
                    found |= wanted[own]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [8 << 20, 60])
def test_hits_equal_brute_force(spark, block_bytes):
    rng = random.Random(5)
    pool = ["the", "Of", "é1", "ÀB", "x9", "on", "in"]

    def say(n):
        return "".join(rng.choice(pool) + rng.choice([" ", "\n", ", ", "--", "\u007f", "\t'"]) for _ in range(n))

    items = [(i, say(rng.choice([0, 1, 3, 9, 10, 11, 30]))) for i in range(25)] + [(100, None), (101, ""), (None, "null item words here"), (9, "again the same id"), (3, "of of of of")]
    docs = [(i, say(rng.choice([0, 1, 5, 40, 400]))) for i in range(60)] + [(200, None), (201, ""), (202, "ENDS WITH a"), (203, items[5][1]), (203, items[5][1]), (204, "x " * 30000 + (items[-4][1] or "")), (None, "again The same-ID")]
    docs += [(300 + k, f"before {t} after") for k, (_, t) in enumerate(items)]
    docs.append((400, say(200_000) + (items[-4][1] or "") + say(90_000)))  # goes alone
    assert len(docs[-1][1].encode()) > decontaminate.LOOK_BYTES
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(docs_of(spark, docs), bench, block_bytes=block_bytes)
    rows = got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, rows), key=repr) == brute_hits(docs, items)


def test_removal(spark):
    text = "one two three four five six seven eight nine ten eleven"
    docs = docs_of(spark, [(1, f"Éa {text.upper()}, end"), (2, "clean"), (3, None)])
    bench = spark.createDataFrame([(0, text)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.remove(docs, bench).collect()} == {2, 3}
    cut = decontaminate.remove(docs, bench, what="spans")
    assert cut.columns == docs.columns and {r.doc_id: r.text for r in cut.collect()} == {1: "Éa , end", 2: "clean", 3: None}
    none = bench.filter(F.lit(False))
    assert decontaminate.remove(docs, none).count() == 3
    many = spark.createDataFrame([(k, text if k == 7 else f"other {k} words of item") for k in range(20)], "item_id long, text string")
    for what in ("documents", "spans"):
        one, several = (decontaminate.remove(docs, many, what=what, block_bytes=b).collect() for b in (8 << 20, 50))
        assert sorted(map(repr, one)) == sorted(map(repr, several)) and len(one) == (2 if what == "documents" else 3)
    assert decontaminate.scan(docs.filter(F.lit(False)), bench).count() == 0
