import random
import re
import subprocess
import sys
import zlib

import pytest
from pyspark.rdd import RDD
from pyspark.sql import functions as F

import corpus_pipeline
from spanforest.llm import language_id
from spanforest.llm.common import written
from spanforest.llm.tokens import PieceTokenizer, vocabulary

from .test_near_dedup import brute_groups, changed

SPACE = re.compile(r"[\x20\x09-\x0D]+")
SYLLABLES = {"en": ["the", "ing", "tion", "and", "wh"], "de": ["sch", "ung", "ein", "keit", "ß"], "fr": ["eau", "oi", "ê", "ment", "que"], "es": ["ción", "ñ", "rr", "ado", "ll"]}


def corpus(rng):
    def say(lang, n):
        return ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(2, 5))) for _ in range(n)]

    rows = []
    for i in range(160):
        lang = rng.choice(list(SYLLABLES))
        rows.append([i, " ".join(say(lang, rng.choice([20, 60, 200]))), lang])
    for i in range(160, 220):
        base = rows[rng.randrange(160)]
        rows.append([i, base[1].replace(" ", rng.choice(["  ", "\n", " "])), base[2]])
    for i in range(220, 280):
        base = rows[rng.randrange(160)]
        rows.append([i, " ".join(changed(rng, base[1].split(" "), rng.choice([1, 2, 4]))), base[2]])
    item = say("en", 14)
    for i in range(280, 290):
        rows.append([i, " ".join(say("en", 30) + item + say("en", 30)), "en"])
    rows += [[400, None, None], [401, "123 --- !!", "en"], [402, "", None], [403, "Ein einziges schung", "de"]]
    return rows, " ".join(item)


def test_each_stage_does_its_work_and_keeps_clean_documents(spark, tmp_path):
    rng = random.Random(21)
    rows, item = corpus(rng)
    spark.createDataFrame([(i, t, lang, "src", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(5, item), (6, "words that stand in no document of this corpus at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]

    def step(name, docs):
        out = written(stages[name](spark, docs, str(tmp_path)), name)
        rows = {r.doc_id: r.text for r in out.collect()}
        assert out.columns == columns and len(rows) == out.count()
        return out, rows

    texts = {i: t for i, t, _ in rows}
    docs, got = step("language_id", docs)
    assert got == {i: t for i, t in texts.items() if i not in (400, 401, 402)}
    docs, after = step("exact_dedup", docs)
    first = {}
    for i in sorted(got):
        first.setdefault(SPACE.sub(" ", got[i]), i)
    assert after == {i: got[i] for i in first.values()}
    docs, near = step("near_dedup", docs)
    groups = brute_groups(after.items())
    assert near == {i: after[i] for i in set(groups.values())}
    docs, clean = step("decontamination", docs)
    assert clean == {i: t for i, t in near.items() if item not in t} and len(clean) < len(near)
    pieces = stages["packing"](spark, docs, str(tmp_path)).collect()
    tokenizer = PieceTokenizer(vocabulary())
    ids = {i: [*tokenizer.tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in clean.items()}
    assert {r.doc_id for r in pieces} == set(clean) and sum(r.length for r in pieces) == sum(map(len, ids.values()))
    for r in pieces:
        own = b"".join(x.to_bytes(4, "little") for x in ids[r.doc_id][r.start : r.start + r.length])
        assert zlib.crc32(own) == r.ids_crc32 and bytes(r.ids) == own
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sum(r.length for r in whole.select("length").collect()) == sum(map(len, ids.values()))


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_null_ids_survive_with_their_columns(spark, tmp_path, name):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, "some words of a text", "en", 1), (None, "other words without an id", "en", 2), (None, "other words  without an id", "en", 3), (None, "some words of a text", "en", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    for extra in ("_kept_id", "_gone_id", "_lang_pred", "_lang_score", "_has_letter", "_text_sha256", "score", "id", "part"):
        docs = docs.withColumn(extra, F.lit(1))
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    got = sorted(r.kept for r in out.collect())
    assert got in ([1, 2], [1, 3]) if name == "exact_dedup" else got == [1, 2, 3, 4]


def test_learning_starts_no_python_processes_on_executors(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text number {i} in {lang}", lang) for i in range(40) for lang in ("en", "de")], "doc_id long, text string, lang string").cache()
    docs.count()
    monkeypatch.setattr(RDD, "_to_java_object_rdd", lambda self: pytest.fail("a list goes through Python workers"))
    assert language_id.learn(docs).languages == ["de", "en"]


MEMORY = """
import re
import numpy as np, pyarrow as pa
from spanforest.llm.common import claim
def now():
    return int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
claim("language_id")
claim("near_dedup")
np.ones(3 << 20)  # of 24 MB; glibc takes smaller ones for its heap from now on
before = now()
arrays = [np.ones(1 << 18) for _ in range(20)]  # of 2 MB
between = now()
del arrays
print(before, between, now(), pa.default_memory_pool().backend_name)
"""


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_a_worker_of_several_stages_gives_freed_arrays_back():
    before, between, after, pool = subprocess.run([sys.executable, "-c", MEMORY], capture_output=True, text=True, check=True).stdout.split()
    assert float(between) - float(before) > 35 and float(after) - float(before) < 10 and pool == "system"
