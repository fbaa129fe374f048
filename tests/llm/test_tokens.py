import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanforest.llm import packing, repair, tokens
from spanforest.llm.common import binary
from spanforest.llm.tokens import PieceTokenizer, vocabulary

TEXTS = ["", None, " ", "a", " lead", "tail ", "two  spaces", " \n x \n\n y", "<|endoftext|>", "é ü 　z", "it's we'll", "x" * 5000, "word " * 3000, "\x00\x1f ᠎"]


@pytest.fixture(scope="module")
def tokenizer():
    return PieceTokenizer(vocabulary())


@settings(max_examples=600, deadline=None)
@given(st.lists(st.lists(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sabcde.,?!1éßñ\u00a0\u2003\u180e"), st.sampled_from(["ab cd", "ab\ncd, ef", "Straße!!!", "l'été...", "a_b", "x-y%%%"])), max_size=40).map("".join), max_size=6))
def test_pieces_encode_as_whole_texts(tokenizer, texts):
    ids, counts = tokenizer.encode(texts)
    whole = [e.ids for e in tokenizer.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == list(map(len, whole)) and ids.tolist() == [x for w in whole for x in w]
    ids, counts = tokenizer.encode_column(pa.array([None, *texts], pa.string()).slice(1), 2)
    assert counts.tolist() == [len(w) + 1 for w in whole] and ids.tolist() == [x for w in whole for x in [*w, 2]]


def rows_of():
    rng = random.Random(2)
    rows = [(i, rng.choice(TEXTS)) for i in range(40)] + [(1000 - i, t) for i, t in enumerate(TEXTS)]
    return rows


def ids_of(tokenizer, text, end):
    return [*tokenizer.tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark, tokenizer):
    rows = [*rows_of(), (3, "again"), (3, "again"), (None, "no id")]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, part int, ids string").repartition(4)
    pieces = packing.pack(docs)
    got = pieces.collect()
    known = {}
    for i, t in rows:
        known.setdefault(i, []).append(ids_of(tokenizer, t, 0))
    for r in got:
        assert any(crc(k[r.start : r.start + r.length]) == r.ids_crc32 and len(k) == r.doc_tokens for k in known[r.doc_id])
        assert r.opens == (r.start == 0) and r.closes == (r.start + r.length == r.doc_tokens)
    assert sum(r.length for r in got) == sum(len(k) for ks in known.values() for k in ks)
    by = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert sorted(by) == list(range(len(by))) and all(by[k] == 1024 for k in range(len(by) - 1))
    whole = packing.sequences(pieces, pad_id=9).collect()
    assert len(whole) == len(by) and all(len(r.ids) == 1024 and r.n_tokens == by[r.sequence_id] for r in whole)
    plain = packing.pack(docs, with_ids=False)
    assert "ids" not in plain.columns and sorted(map(repr, plain.collect())) == sorted(map(repr, pieces.drop("ids").collect()))
    assert packing.pack(docs.limit(0)).count() == 0


def test_shards(spark, tokenizer):
    rows = [*{i: (i, t) for i, t in rows_of()}.values(), (-7, "negative"), (None, "no id")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, file int").repartition(4)
    manifest = repair.write_shards(docs, shard_tokens=2000)
    got = sorted(repair.read_shards(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, *sorted(i for i, _ in rows if i is not None)]
    known, at = dict(rows), 0
    for r in got:
        ids = ids_of(tokenizer, known[r.doc_id], 2)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    plain = repair.read_shards(manifest, with_ids=False).collect()
    assert sorted(map(repr, plain)) == sorted(map(repr, repair.read_shards(manifest).drop("ids").collect()))
    assert repair.read_shards(repair.write_shards(docs.limit(0))).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=40), max_size=8), st.sampled_from([4, 50257, 65530, 100000, 1 << 31]), st.integers(2, 6))
def test_grammar_round_trip(docs, base, least):
    counts = np.array(list(map(len, docs)), np.int64)
    flat = np.array([x for d in docs for x in d], np.uint32)
    symbols, per, rules = repair.compress(flat, counts, base, least)
    shard = repair.Shard.load(repair.dump(np.arange(len(docs)), np.zeros(len(docs), bool), flat, counts, base, least))
    assert shard.all().tolist() == flat.tolist()
    small = repair.Shard(np.arange(len(docs)), np.zeros(len(docs), bool), counts, per, rules, repair.expansion_lengths(rules, base), symbols, base)
    assert small.all().tolist() == flat.tolist()
    for i, d in enumerate(docs):
        assert small.document(i).tolist() == d
        for a in range(0, len(d) + 1, 3):
            for b in range(a, len(d) + 1, 4):
                assert small.part(i, a, b).tolist() == d[a:b]


def test_grammar_compresses_and_detects_damage():
    flat = np.tile(np.array([5, 6, 7, 8], np.uint32), 1000)
    data = repair.dump(np.zeros(1, np.int64), np.zeros(1, bool), flat, np.array([4000]), 50257)
    assert len(data) < 1500
    with pytest.raises(ValueError):
        repair.Shard.load(data[:-9] + b"123456789")


def pair_counts(docs):
    """How often each pair occurs, occurrences that overlap once."""
    counts = {}
    for own in docs:
        end = {}
        for i, pair in enumerate(zip(own, own[1:], strict=False)):
            if end.get(pair, -1) < i:
                counts[pair] = counts.get(pair, 0) + 1
                end[pair] = i + 1
    return counts


def replaced(own, pair, by):
    out, i = [], 0
    while i < len(own):
        hit = tuple(own[i : i + 2]) == pair
        out.append(by if hit else own[i])
        i += 1 + hit
    return out


def frequent_pairs(symbols, per, least):
    ends = np.cumsum(per)
    return {p for p, n in pair_counts([symbols[e - n : e].tolist() for e, n in zip(ends, per, strict=True)]).items() if n >= least}


def test_grammar_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(3)
    hot = rng.integers(0, 50000, 300)
    docs = [np.append(hot, 2) for _ in range(400)]
    # More rules than 16 bits have room for: 17,000 pairs, eight times each.
    pairs = rng.permutation(50000)[:34000].reshape(-1, 2)
    docs += [np.concatenate([np.append(p, rng.integers(0, 50257)) for p in pairs[rng.permutation(len(pairs))]]) for _ in range(8)]
    docs += [rng.integers(0, 40, 20000), np.full(5000, 7)]
    counts, flat = np.array(list(map(len, docs))), np.concatenate(docs).astype(np.uint32)
    symbols, per, rules = repair.compress(flat, counts, 50257)
    assert not frequent_pairs(symbols, per, repair.LEAST) and len(rules) > 15279
    assert per[:400].tolist() == [1] * 400 and repair.expansion_lengths(rules, 50257).max() >= 301
    shard = repair.Shard.load(repair.dump(np.arange(len(docs)), np.zeros(len(docs), bool), flat, counts, 50257))
    assert shard.all().tolist() == flat.tolist() and shard.document(399).tolist() == docs[399].tolist() and shard.part(3, 17, 290).tolist() == docs[3][17:290].tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), max_size=8), st.sampled_from([4, 50257, 65530, 1 << 31]), st.integers(2, 5))
def test_rules_are_those_of_plain_re_pair(docs, base, least):
    """Replaced one by one, each rule's pair is the most frequent one of its time; at the end none is frequent."""
    counts = np.array(list(map(len, docs)), np.int64)
    symbols, per, rules = repair.compress(np.array([x for d in docs for x in d], np.uint32), counts, base, least)
    for k, pair in enumerate(map(tuple, rules.tolist())):
        now = pair_counts(docs)
        assert now[pair] == max(now.values()) >= least
        docs = [replaced(d, pair, base + k) for d in docs]
    assert max(pair_counts(docs).values(), default=0) < least
    assert symbols.tolist() == [x for d in docs for x in d] and per.tolist() == list(map(len, docs))


def test_repeated_rows_and_long_texts_in_shards(spark, tokenizer):
    long = " ".join(f"w{k % 997}" for k in range(900_000))
    assert len(long) > repair.TEXT_BYTES
    rows = [(5, "same row"), (5, "same row"), (5, "other text"), (9, long), (None, "no id"), (None, "no id"), (7, None), (7, "")]
    got = repair.read_shards(repair.write_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))).collect()
    want = sorted(((i, len(ids := ids_of(tokenizer, t, 2)), crc(ids)) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == [None, None, 5, 5, 5, 7, 7, 9]


def test_table_of_pieces_is_exact():
    """Strings that differ by a length, a last byte, a zero byte or their kind have numbers of their own, also while the table grows."""
    texts = sorted({a + b + "\0" * z for a in ("", "a", "abcdefg", "abcdefgh", "abcdefghijklmn") for b in ("", "x", "é") for z in range(3)} | {f"w{i}" for i in range(70_000)})
    texts = [t for t in texts if len(t.encode()) <= tokens._Table.MOST]
    own, table = pa.array(texts), tokens._Table(4)
    offsets, data = binary(own)
    plain, spaced = (table.keys(offsets, data, kind) for kind in (0, 1))
    assert (table.get(plain) == -1).all()
    for at in range(0, len(texts), 999):
        table.put(plain[at : at + 999], np.arange(at, min(at + 999, len(texts))))
    assert (table.get(plain) == np.arange(len(texts))).all() and (table.get(spaced) == -1).all()
    table.put(spaced, np.arange(len(texts)) + 10**6)
    assert (table.get(plain) == np.arange(len(texts))).all() and (table.get(spaced) == np.arange(len(texts)) + 10**6).all()


def test_pieces_of_a_column_are_no_python_strings():
    """Only pieces too long for the table are kept as strings, and the ids are the library's at any length, mark and script."""
    rng = random.Random(3)
    letters = ["a", "Q", "z", "é", "Ж", "7", "'", ",", ")", "中", "_"]
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 24))) for _ in range(30)) for _ in range(60)]
    own = tokens.PieceTokenizer(tokens.vocabulary())
    for _ in range(2):
        ids, counts = own.encode_column(pa.array(texts), 2)
        want = [e.ids + [2] for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]
    kept = [*own.plain, *own.spaced]
    assert kept and all(len(p.encode()) > tokens._Table.MOST for p in kept) and own.table.used > 500
