"""Language identification in two steps: the family, then the language in it.

Features are letter trigrams of the whole text, lower-cased, with everything
that is no letter as one border symbol. A multinomial model over trigrams picks
the family; inside a family a linear support vector machine for each pair of
languages votes. Both are trained here on a bounded sample of labelled rows:
per language the different rows (id and text) with the smallest hashes, at most
`per_language` rows and an equal part of `sample_bytes` bytes; of a longer row
only so many characters are learned from, so no row or repeated id makes the
sample larger. The rows are thinned by hash where they are read, before any
shuffle: what is ranked does not grow with the table.

Defined results: `und` with score 0 for null texts, texts without a letter and
when nothing was learned (`keep_known` then keeps every text with a letter);
equal scores go to the language that sorts first; a null id is never learned
from and counts as held out; repeated rows are learned from once; an empty table
gives an empty result; other columns are passed through or not read, whatever
their names.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import binary, blocks, claim, fresh, ready, trim

PER_LANGUAGE, SAMPLE_BYTES = 1500, 24 << 20
#: Labels that can be learned; a column with more is no language.
MOST_LANGUAGES = 2000
UNKNOWN = "und"
#: Families of languages by ISO 639-1 code. A language that is not here is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "rm", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "celtic": ["br", "cy", "ga", "gd"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "ky", "tr", "tt", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"],
}
BITS = 18
_EDGE = 0


def _codes() -> np.ndarray:
    """A symbol of six bits for each byte: 0 a border, 1 to 26 letters, the rest bytes of characters outside ASCII."""
    byte = np.arange(256)
    code = np.zeros(256, np.int32)
    letter = ((byte | 32) >= 97) & ((byte | 32) <= 122) & (byte < 128)
    code[letter] = (byte[letter] | 32) - 96
    high = byte >= 128
    code[high] = 27 + (byte[high] - 128) % 37
    return code


CODES = _codes()


def family_of(language: str) -> str:
    base = language.lower().replace("_", "-").split("-")[0]
    return next((f for f, members in FAMILIES.items() if base in members), language)


def trigrams(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(trigram at each place, first place of each row); every row has borders around it, so at least one place."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    line = np.zeros(len(data) + 2 * rows + 2, np.int32)
    line[np.arange(len(data)) + np.repeat(2 * np.arange(rows) + 1, size)] = CODES[data]
    at = line[:-2] << 12 | line[1:-1] << 6 | line[2:]
    first = offsets[:-1] + 2 * np.arange(rows)
    at = at[: len(data) + 2 * rows]
    at[first + size + 1] = 0  # from a row's last border on stand the next row's symbols
    return at, first


class Model(NamedTuple):
    languages: list[str]
    families: list[str]
    members: list[list[int]]  # of each family: its languages
    pairs: list[tuple[int, int]]  # of languages in one family; the first has the positive side
    weight: np.ndarray  # (families + pairs) x 2**BITS, float32
    bias: np.ndarray
    slope: np.ndarray  # of each pair's probability by its margin


def _sparse(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Trigrams of each text with their share of all, borders alone left out."""
    out = []
    for text in texts:
        offsets, data = binary(pa.array([text], pa.large_string()))
        at, _ = trigrams(offsets, data)
        found, count = np.unique(at[at != 0], return_counts=True)
        out.append((found, count / max(1, count.sum())))
    return out


_SCALE = 10.0


def _svm(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, cost: float = 1.0, rounds: int = 12) -> tuple[np.ndarray, float]:
    """A linear support vector machine by dual coordinate descent on the hinge loss."""
    weight, bias = np.zeros(1 << BITS), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([(_SCALE * v) @ (_SCALE * v) + 1 for _, v in rows])
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            found, share = rows[i]
            share = _SCALE * share
            gradient = sign[i] * (weight[found] @ share + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            step = (new - alpha[i]) * sign[i]
            if step:
                weight[found] += step * share
                bias += step
                alpha[i] = new
                moved += abs(step)
        if moved < 1e-3 * len(rows):
            break
    return weight, bias


def fit(texts: list[str], languages: list[str]) -> Model:
    names = sorted(set(languages))
    families = sorted({family_of(x) for x in names})
    members = [[i for i, x in enumerate(names) if family_of(x) == f] for f in families]
    rows = _sparse(texts)
    own = np.array([names.index(x) for x in languages], int)
    weight, bias, slope, pairs = [], [], [], []
    # Shares and not counts, and languages alike: neither long texts nor frequent languages weigh more.
    by_language = np.zeros((len(names), 1 << BITS))
    for (found, share), k in zip(rows, own, strict=True):
        by_language[k][found] += share
    by_language /= np.maximum(by_language.sum(1, keepdims=True), 1e-9)
    smooth = 1e-6
    for m in members:
        p = by_language[m].mean(0) + smooth
        w = np.log(p / p.sum())
        w[0] = 0
        weight.append(w)
        bias.append(0.0)
    for m in members:
        for i, a in enumerate(m):
            for b in m[i + 1 :]:
                at = np.flatnonzero((own == a) | (own == b))
                sign = np.where(own[at] == a, 1.0, -1.0)
                w, c = _svm([rows[j] for j in at], sign)
                margin = np.array([w[rows[j][0]] @ (_SCALE * rows[j][1]) + c for j in at]) * sign
                pairs.append((a, b))
                weight.append(_SCALE * w)
                bias.append(c)
                slope.append(4.0 / max(float(np.median(np.abs(margin))), 1e-6))
    stack = np.stack(weight).astype(np.float32) if weight else np.zeros((0, 1 << BITS), np.float32)
    return Model(names, families, members, pairs, stack, np.array(bias), np.array(slope))


def predict(model: Model, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language, score) of each row; every row is taken to have a letter."""
    rows = len(offsets) - 1
    if not model.languages or not rows:
        return np.full(rows, -1), np.zeros(rows)
    at, first = trigrams(offsets, data)
    many = np.maximum(np.add.reduceat((at != 0).astype(np.int64), first), 1)
    mean = np.stack([np.add.reduceat(w[at], first, dtype=np.float64) / many for w in model.weight], 1) + model.bias
    f, n = len(model.families), len(model.languages)
    # The family: posterior of a text of at most 100 independent trigrams.
    log = mean[:, :f] * np.minimum(many, 100)[:, None]
    odds = np.exp(log - log.max(1, keepdims=True))
    family = log.argmax(1)
    sure = odds.max(1) / odds.sum(1)
    votes, belief, against = np.zeros((rows, n)), np.zeros((rows, n)), np.zeros(n)
    for k, (a, b) in enumerate(model.pairs):
        p = 1 / (1 + np.exp(-np.clip(mean[:, f + k] * model.slope[k], -60, 60)))
        votes[:, a] += p >= 0.5
        votes[:, b] += p < 0.5
        belief[:, a] += p
        belief[:, b] += 1 - p
        against[a] += 1
        against[b] += 1
    best, score = np.zeros(rows, np.int64), np.zeros(rows)
    for k, m in enumerate(model.members):
        own = np.flatnonzero(family == k)
        rank = votes[np.ix_(own, m)] + 1e-3 * belief[np.ix_(own, m)]
        pick = rank.argmax(1)
        best[own] = np.array(m)[pick]
        score[own] = sure[own] * np.where(against[best[own]] > 0, belief[own, best[own]] / np.maximum(against[best[own]], 1), 1.0)
    return best, np.clip(score, 0, 1)


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, per_language: int = PER_LANGUAGE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits on the labelled rows that aren't held out, by a bounded sample of them."""
    usable = ~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & (F.col(lang_col) != UNKNOWN) & F.col(text_col).isNotNull()
    rows = docs.filter(usable).select(F.col(lang_col).alias("language"), F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"))
    # A row a language, with partial sums: sent to every task, so that rows are thinned before they are shuffled.
    many = rows.groupBy("language").agg(F.approx_count_distinct("h").alias("many")).limit(MOST_LANGUAGES + 1).collect()
    if len(many) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in {lang_col}")
    if not many:
        return fit([], [])
    spark = docs.sparkSession
    # Arrow tables: of a list Spark makes an RDD, for which each executor starts Python processes of their own kind that stay beside the operators'.
    known = F.broadcast(spark.createDataFrame(pa.table({"language": [r.language for r in many], "many": [r.many for r in many]}, pa.schema([("language", pa.string()), ("many", pa.int64())]))))
    # Hashes are even over 64 bits: below this share of them lie about four times the rows wanted, however frequent the language is.
    share = (F.col("h").cast("double") + 2.0**63) / 2.0**64
    low = rows.join(known, "language").filter(share * F.col("many") <= 4.0 * per_language).select("language", "h", F.octet_length("text").alias("size")).distinct()
    by_hash = Window.partitionBy("language").orderBy("h", "size")
    sized = low.withColumn("place", F.row_number().over(by_hash)).filter(F.col("place") <= per_language).select("language", "h", "size").collect()
    chosen, used, most = [], {}, max(1, sample_bytes // len(many))
    for r in sorted(sized, key=lambda r: (r.language, r.h, r.size)):
        size = min(r.size, most)
        if used.get(r.language, 0) + size <= most:
            used[r.language] = used.get(r.language, 0) + size
            chosen.append((r.language, r.h))
    wanted = F.broadcast(spark.createDataFrame(pa.table({"language": [x for x, _ in chosen], "h": [h for _, h in chosen]}, pa.schema([("language", pa.string()), ("h", pa.int64())]))))
    # Characters, at most four bytes each: a longer row's beginning is no more than its language's part.
    text = F.when(F.octet_length("text") > most, F.substring("text", 1, max(1, most // 4))).otherwise(F.col("text")).alias("text")
    taken = rows.join(wanted, ["language", "h"]).select("language", "h", text).groupBy("language", "h").agg(F.min("text").alias("text"))
    got = taken.filter(F.col("text").rlike("\\p{L}")).collect()
    got.sort(key=lambda r: (r.language, r.h))
    model = fit([r.text for r in got], [r.language for r in got])
    del got, sized, chosen, many
    trim()  # the driver has other work after this
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text", *, lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """The documents with the predicted language and its score as last columns."""
    spark = docs.sparkSession
    ready(spark)
    held = spark.sparkContext.broadcast(tuple(model))
    names = pa.array([*model.languages, UNKNOWN])
    place = docs.columns.index(text_col)
    letters = fresh(docs, "_has_letter")

    def run(batches):
        claim("language_id")
        known = Model(*held.value)
        for batch in batches:
            whole, bytes_ = binary(batch.column(place))
            letter = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            batch = batch.select(range(batch.num_columns - 1))
            for at, to in blocks(whole):
                best, score = predict(known, whole[at : to + 1] - whole[at], bytes_[whole[at] : whole[to]])
                none = ~letter[at:to] | (best < 0)
                best, score = np.where(none, len(known.languages), best), np.where(none, 0.0, score)
                part = batch.slice(at, to - at)
                yield pa.record_batch([*part.columns, names.take(pa.array(best)), pa.array(score)], [*(f"c{i}" for i in range(part.num_columns)), "lang", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    inner = StructType([StructField(f"c{i}", f.dataType, True) for i, f in enumerate(docs.schema)] + [StructField("lang", StringType()), StructField("score", DoubleType())])
    marked = docs.withColumn(letters, F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)))
    return marked.mapInArrow(run, inner).toDF(*docs.columns, lang_as, score_as)


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", *, least_score: float = 0.0) -> DataFrame:
    """The documents, all columns as they were, whose language is recognised with at least that score; with a model of nothing, all with a letter."""
    if not model.languages:
        return docs.filter(F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)))
    lang, score = fresh(docs, "_lang_pred"), fresh(docs, "_lang_score")
    found = identify(docs, model, text_col, lang_as=lang, score_as=score)
    return found.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= least_score)).select(*docs.columns)
