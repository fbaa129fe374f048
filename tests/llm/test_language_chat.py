import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanforest.llm import chat, language_id
from spanforest.llm.common import BLOCK_BYTES

SYLLABLES = {"en": ["the", "ing", "tion", "and", "wh"], "de": ["sch", "ung", "ein", "keit", "ß"], "fr": ["eau", "oi", "ê", "ment", "que"], "es": ["ción", "ñ", "rr", "ado", "ll"]}


def say(rng, lang, n=30):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_on_held_out_rows(spark):
    rng = random.Random(4)
    rows = [(i, say(rng, lang := rng.choice(list(SYLLABLES)), rng.choice([4, 30, 300])), lang) for i in range(600)]
    odd = [(9000, None, "en"), (9001, "", "en"), (9002, "123 !?", None), (9003, "Éa", None), (None, say(rng, "de"), "de"), (9004, say(rng, "fr", 20000), None), (7, rows[7][1], rows[7][2])]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows + odd], "doc_id long, text string, lang string, score double").repartition(5)
    model = language_id.learn(docs)
    got = language_id.identify(docs.select("doc_id", "text", "lang"), model).withColumn("held", language_id.held_out(F.col("doc_id"))).collect()
    assert len(got) == len(rows) + len(odd)
    held = [r for r in got if r.held and r.doc_id is not None and r.doc_id < 9000]
    assert len(held) > 100 and all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (9000, 9001, 9002)] == ["und"] * 3 and by[9003].lang_pred != "und" and by[9004].lang_pred == "fr"
    kept = language_id.keep_known(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(got) - 3


def test_labels_of_held_out_rows_are_not_learned(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        held = zlib.crc32(str(i).encode()) % 4 == 2
        rows.append((i, say(rng, "en" if i % 2 else "de"), "zz" if held else ("en" if i % 2 else "de")))
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"] and model.pairs == [(0, 1)]


def plain_trigrams(text):
    line = [0, *(language_id.CODES[b] for b in text.encode()), 0, 0]
    return [(int(a) << 12) | (int(b) << 6) | int(c) for a, b, c in zip(line, line[1:], line[2:], strict=False)]


def plain_prediction(model, text):
    """Family by posterior, then votes of the pairs in it, one text at a time."""
    at = plain_trigrams(text)
    many = max(1, sum(t != 0 for t in at))
    mean = [sum(float(w[t]) for t in at) / many + float(b) for w, b in zip(model.weight, model.bias, strict=True)]
    f = len(model.families)
    family = max(range(f), key=lambda k: (mean[k], -k))
    own = model.members[family]
    votes, belief = dict.fromkeys(own, 0), dict.fromkeys(own, 0.0)
    for k, (a, b) in enumerate(model.pairs):
        if a in own:
            p = 1 / (1 + np.exp(-np.clip(mean[f + k] * model.slope[k], -60, 60)))
            votes[a if p >= 0.5 else b] += 1
            belief[a] += p
            belief[b] += 1 - p
    best = max(own, key=lambda x: (votes[x] + 1e-3 * belief[x], -x))
    sure = 1 / sum(np.exp((m - mean[family]) * min(many, 100)) for m in mean[:f])
    return best, sure * (belief[best] / (len(own) - 1) if len(own) > 1 else 1.0)


def test_predictions_equal_plain_ones():
    rng = random.Random(8)
    texts = [say(rng, lang, rng.choice([1, 5, 40])) for lang in SYLLABLES for _ in range(40)]
    model = language_id.fit(texts, [lang for lang in SYLLABLES for _ in range(40)])
    asked = [say(rng, rng.choice(list(SYLLABLES)), rng.choice([1, 2, 50])) for _ in range(60)] + ["a", "Ж", "x" * 3000, "a b  c\n1", "the schung ción"]
    asked.append(say(rng, "es", 300_000))
    assert len(asked[-1]) > BLOCK_BYTES
    offsets, data = language_id.binary(pa.array(asked))
    best, score = language_id.predict(model, offsets, data)
    for i, text in enumerate(asked):
        want, sure = plain_prediction(model, text)
        assert best[i] == want and abs(score[i] - sure) < 1e-6
    # The pairs' machines have nearly all that they were trained on on its side.
    rows, names = language_id._sparse(texts), [lang for lang in SYLLABLES for _ in range(40)]
    for (one, other), w, c in zip(model.pairs, model.weight[len(model.families) :], model.bias[len(model.families) :], strict=True):
        right = [(w[at] @ share + c > 0) == (name == model.languages[one]) for (at, share), name in zip(rows, names, strict=True) if name in (model.languages[one], model.languages[other])]
        assert np.mean(right) > 0.9


def test_sample_is_bounded(spark):
    rng = random.Random(3)
    rows = [(1, say(rng, "en"), "en")] * 3000 + [(i, say(rng, lang), lang) for i in range(2, 1500) for lang in ("en", "de")] + [(5000 + i, say(rng, "de", 4000), "de") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    seen, fit = [], language_id.fit
    try:
        language_id.fit = lambda texts, languages: seen.append((texts, languages)) or fit(texts, languages)
        language_id.learn(docs, per_language=50, sample_bytes=16000)
    finally:
        language_id.fit = fit
    texts, languages = seen[0]
    for lang in ("en", "de"):
        own = [t for t, x in zip(texts, languages, strict=True) if x == lang]
        assert 10 < len(own) <= 50 and len(set(own)) == len(own) and sum(len(t.encode()) for t in own) <= 8000


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, "12 !", None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in language_id.keep_known(docs, language_id.learn(docs)).collect()] == [1]
    docs = docs.limit(1)
    assert [r.lang_pred for r in language_id.identify(docs, language_id.learn(docs)).collect()] == ["und"]
    assert language_id.identify(docs.limit(0), language_id.learn(docs)).count() == 0


NASTY = ["", None, "<|im_end|>", "<|im_start|>assistant ok", "<\\|", "<\\\\|x<|", "<", "|", "<<||", "a\nb\n", "\\", "$1", "é<|nl|>"]


def test_turns_round_trip(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd\nrole", "<|im_end|>", None]), rng.choice(NASTY)) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(77, t, "assistant" if t % 2 else "user", f"long {t} <|") for t in range(700)] + [(None, 0, "user", "x"), (None, None, "assistant", "y"), (5, 0, "user", "again"), (5, 0, "user", "again")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, id int").repartition(4)
    chats = chat.format_chats(chat.replies_by_turn(df))
    got = {r.conv: r for r in chats.select("conv", "formatted", chat.parsed(F.col("formatted")).alias("turns"), chat.loss_text(F.col("parts")).alias("loss")).collect()}
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        assert [tuple(t) for t in got[c].turns] == turns
        assert got[c].loss == "".join(x for r, x in turns if r == "assistant")
        assert got[c].formatted.count("<|im_start|>") == len(turns) == got[c].formatted.count("<|im_end|>")
    assert chat.format_chats(chat.replies_by_turn(df.limit(0))).count() == 0


def test_trees_and_ranks(spark):
    #      1 -> 2 -> 4, 1 -> 3 -> 5 -> 6, a second root 9, a ring 20 <-> 21 with leaf 22
    rows = [(0, 1, None, 1.0), (0, 2, 1, 5.0), (0, 4, 2, 0.0), (0, 3, 1, None), (0, 5, 3, 9.0), (0, 6, 5, 9.0), (0, 9, 404, 4.75), (0, 20, 21, 99.0), (0, 21, 20, 99.0), (0, 22, 20, 99.0), (0, 6, 5, 9.0)]
    df = spark.createDataFrame([(*r, "assistant", f"m{r[1]}") for r in rows], "conv long, id long, parent long, score double, role string, text string")
    got = chat.format_chats(df, top=3).orderBy("rank").collect()
    assert [(r.leaf, r.rank, [p.text for p in r.parts if p.loss]) for r in got] == [(6, 1, ["m1", "m3", "m5", "m6"]), (9, 2, ["m9"]), (4, 3, ["m1", "m2", "m4"])]
    assert [r.path_score for r in got] == pytest.approx([4.75, 4.75, 2.0])
    assert [r.leaf for r in chat.format_chats(df).collect()] == [6]


def test_escape_is_one_to_one(spark):
    rng = random.Random(1)
    texts = list({"".join(rng.choice("<\\|a") for _ in range(rng.randint(0, 9))) for _ in range(3000)})
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u"))
    rows = df.collect()
    assert all(r.t == r.u and "<|" not in r.e for r in rows) and len({r.e for r in rows}) == len(texts)
    assert hashlib.sha256(b"").hexdigest()
