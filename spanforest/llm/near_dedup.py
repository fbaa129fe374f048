"""Near duplicates by BagMinHash signatures, bands, and exact multiset overlap.

A text is the multiset of its runs of five words (shorter texts: one run of all
words). The signature is BagMinHash: each run has a Poisson process of points
over (weight, time), where weights are cut at 0, 1, 2, 4, 8, ...; each dyadic
interval has a process of its own, its points are dealt to the signature's
slots at random, and inside an interval that the weight covers only in part a
point descends to one half or the other until it is known whether the weight
covers it. A slot keeps the earliest covered point, so two texts agree in a
slot with a probability equal to their weighted Jaccard similarity. Points are
drawn in order of time and only up to a bound under which nearly every slot is
filled; texts with an open slot are drawn again with twice the bound, so the
bound changes the work and never the signature.

Texts with equal multisets are one class and only its smallest id goes on.
Bands of slots make buckets. A member's popularity is the sum of its buckets'
sizes; each member is compared with the most popular center of its buckets, and
verified links make components. That leaves buckets with several components,
whose pairs are not made either. All members x of such a bucket are compared
with one reference c, the most popular leader of its components. If x lacks m of
c's n runs and has e others, and y likewise, x and y are similar only if they
share at least t = s(x) + s(y) - (1 - 2A)n of these differences, where
s = (1 - A)m + Ae and A = similar / (1 + similar); and t is above 0 unless both
are similar to c, and then they are in one component already. So candidates are
found by shared differences, rarest first, with the prefix that t allows: exact
whatever the bucket. The members that share such a difference are a bucket in
turn: each is compared with the most popular one of them, what is linked goes,
and so on while links appear, so a group inside the bucket costs a comparison a
member. Only members that are still apart after that are paired, if they share a
difference, lie in different components, and sizes and distances from c (one
minus the similarity is a metric) allow it: few where members differ from c each
in its own way. Two large groups that share a change against c, and stand just
apart, are paired member by member where those bounds don't tell them apart.
Every link that is used was verified on the whole multisets of 64-bit hashes of runs.

Defined results: null texts and texts without words resemble nothing and are
groups of one; rows with the same id and the same runs of words are one
document; where several contents have the same smallest id, one of them is
compared with others and the rest are groups of their copies alone, so no row
goes for another row of its id; a null id is in no group and its row has nulls;
an empty table gives an empty result; columns other than the id and the text are
not read.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import binary, blocks, claim, fresh, ready, splitmix, swept, written
from .words import Words, windows, words

SHINGLE, SIMILAR = 5, 0.8
#: Slots a band, and bands: a pair of similarity 0.8 shares no bucket once in 38,000 times.
ROWS, BANDS = 4, 20
#: Bytes of texts whose runs are hashed in one go: their arrays take some 60 times as much.
TEXT_BYTES = 1 << 19


def runs(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of words, by row."""
    at, hashes = windows(w, size)
    docs = [w.doc[at]]
    many = np.diff(w.first)
    parts = [hashes]
    for n in range(1, size):
        if (many == n).any():
            at, own = windows(w, n)
            whole = many[w.doc[at]] == n
            docs.append(w.doc[at[whole]])
            parts.append(splitmix(own[whole] + np.uint64(n)))
    if len(parts) == 1:
        return docs[0], parts[0]
    doc, hashes = np.concatenate(docs), np.concatenate(parts)
    order = np.argsort(doc, kind="stable")
    return doc[order], hashes[order]


def counted(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of each distinct run of a row, in any order."""
    key = splitmix(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    at = order[first]
    return doc[at], hashes[at], count


def _uniform(seed: np.ndarray) -> np.ndarray:
    return ((splitmix(seed) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def bag_min_hash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, slots: int) -> np.ndarray:
    """Signature (rows x slots) of points in time; infinite where a row has no element. Weights are whole numbers from 1."""
    out = np.full(rows * slots, np.inf)
    total = np.bincount(doc, weight, rows)
    bound = np.divide(np.log(slots) + 4, total, out=np.zeros(rows), where=total > 0)
    todo = np.arange(len(doc))
    while len(todo):
        d, e, c = doc[todo], element[todo], weight[todo]
        level = 0
        while len(d):
            # The interval (0, 1], then (1, 2], (2, 4], ...
            low, length = (0, 1) if level == 0 else (1 << level - 1, 1 << level - 1)
            if level:
                over = c > low
                d, e, c = d[over], e[over], c[over]
                if not len(d):
                    break
            rate = float(slots * length)
            seed = splitmix(e ^ np.uint64(0xA0761D6478BD642F * (level + 1) % (1 << 64)))
            first = _uniform(seed)
            live = np.flatnonzero(first >= np.exp(-rate * bound)[d])
            time = -np.log(first[live]) / rate
            k = 0
            while len(live):
                mark = splitmix(seed[live] ^ np.uint64(0xE7037ED1A0B428DB))
                slot = (mark >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)
                covered = c[live] >= low + length
                if not covered.all():  # descend by halves: the low bits are the way down
                    step = (mark & np.uint64(0xFFFFFFFF)) * np.uint64(length) >> np.uint64(32)
                    covered |= low + step.astype(np.int64) < c[live]
                np.minimum.at(out, d[live[covered]] * slots + slot[covered].astype(np.int64), time[covered])
                k += 1
                seed[live] += np.uint64(0x8EBC6AF09C88C6E3)
                time = time - np.log(_uniform(seed[live])) / rate
                soon = time <= bound[d[live]]
                live, time = live[soon], time[soon]
            level += 1
        open_ = np.zeros(rows, bool)
        open_[np.unique(np.flatnonzero(np.isinf(out)) // slots)] = True
        todo = todo[open_[doc[todo]]]
        bound = np.where(open_, bound * 2, bound)
    return out.reshape(rows, slots)


def bands_of(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), -1, rows)
    key = np.broadcast_to(np.arange(bits.shape[1], dtype=np.uint64), bits.shape[:2])
    for j in range(rows):
        key = splitmix(key * np.uint64(0x9FB21C651E98DF25) + bits[:, :, j])
    return key.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """id, a hash of the text, size, two class hashes and band keys of each row; no keys for texts without words."""

    def run(batches):
        claim("near_dedup")
        for batch in batches:
            whole, bytes_ = binary(batch.column(1))
            for at, to in blocks(whole, TEXT_BYTES):
                n = to - at
                doc, hashes = runs(words(whole[at : to + 1] - whole[at], bytes_[whole[at] : whole[to]]))
                size = np.bincount(doc, minlength=n)
                cut = np.concatenate([[0], np.cumsum(size)])
                same = [_sums(hashes, cut, salt) for salt in _SAME]
                d, e, c = counted(doc, hashes)
                key = bands_of(bag_min_hash(d, e, c, n, rows * bands), rows)
                full = size > 0
                ends = np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(key[full].reshape(-1)))
                yield pa.record_batch([batch.column(0).slice(at, n), batch.column(2).slice(at, n), pa.array(size), *map(pa.array, same), lists], ["id", "text_hash", "size", "same0", "same1", "bands"])

    return docs.select(F.col(id_col).cast("long"), text_col, F.xxhash64(text_col)).mapInArrow(run, "id long, text_hash long, size long, same0 long, same1 long, bands array<long>")


_SAME = 0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93


def _sums(hashes: np.ndarray, cut: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each row's multiset, whatever its order."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(splitmix(hashes ^ np.uint64(salt)), dtype=np.uint64)])
    return (total[cut[1:]] - total[cut[:-1]]).view(np.int64)


def multisets(texts: DataFrame) -> DataFrame:
    """id, same0, runs: the sorted hashes of a text's runs, each occurrence with a hash of its own."""

    def run(batches):
        claim("near_dedup")
        for batch in batches:
            whole, bytes_ = binary(batch.column(1))
            for at, to in blocks(whole, TEXT_BYTES):
                doc, hashes = runs(words(whole[at : to + 1] - whole[at], bytes_[whole[at] : whole[to]]))
                cut = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=to - at))])
                same = _sums(hashes, cut, _SAME[0])
                order = np.lexsort((hashes, doc))
                doc, hashes = doc[order], hashes[order]
                first = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else np.zeros(0, bool)
                place = np.arange(len(doc))
                place = place - np.maximum.accumulate(np.where(first, place, 0)) if len(doc) else place
                own = splitmix(hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                own = own[np.lexsort((own, doc))].astype("<u8")
                data = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer((cut * 8).astype(np.int32)), pa.py_buffer(own)])
                yield pa.record_batch([batch.column(0).slice(at, to - at), pa.array(same), data], ["id", "same0", "runs"])

    return texts.mapInArrow(run, "id long, same0 long, runs binary")


def overlap(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two multisets."""
    if a == b:
        return 1.0
    n, m = len(a) // 8, len(b) // 8
    if min(n, m) == 0:
        return 0.0
    line = np.sort(np.concatenate([np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")]))
    both = int((line[1:] == line[:-1]).sum())
    return both / (n + m - both)


def verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose multisets overlap enough, with their similarity."""

    def run(batches):
        claim("near_dedup")
        for batch in batches:
            score = np.array([overlap(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3), strict=True)])
            good = np.flatnonzero(score >= similar) if len(score) else np.zeros(0, np.int64)
            yield pa.record_batch([batch.column(0).take(pa.array(good)), batch.column(1).take(pa.array(good)), pa.array(score[good])], ["a", "b", "similarity"])

    left = sets.select(F.col("id").alias("a"), F.col("runs").alias("runs_a"))
    right = sets.select(F.col("id").alias("b"), F.col("runs").alias("runs_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "runs_a", "runs_b")
    return joined.mapInArrow(run, "a long, b long, similarity double")


def differences(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """For pairs (a, b): their similarity, and b's differences from a with
    how many of them, rarest first, must be looked at: `short` if the other side is
    not similar to a, `long` whatever the other side is (0 if b is similar to a);
    `weight` is s of b and `spare` what two of them may lack, as numbers of `unit`."""
    # In whole numbers, with similar = p / q and all of s, t and n times p + q: no bound is off by a rounding.
    p, q = Fraction(str(similar)).as_integer_ratio()

    def run(batches):
        claim("near_dedup")
        for batch in batches:
            numbers, lists = [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                line = np.concatenate([x, y])
                order = np.argsort(line, kind="stable")
                twice = line[order[1:]] == line[order[:-1]]
                alone = np.ones(len(line), bool)
                alone[order[1:][twice]] = alone[order[:-1][twice]] = False
                lack, extra = x[alone[: len(x)]], y[alone[len(x) :]]
                s, spare = q * len(lack) + p * len(extra), (q - p) * len(x)
                over, many = s - spare, len(lack) + len(extra)
                numbers.append(((len(x) - len(lack)) / max(1, len(x) + len(extra)), many - s // (p + q), many - max(1, -(-over // (p + q))) + 1 if over > 0 else 0, s, spare))
                lists.append(np.concatenate([extra, splitmix(lack ^ np.uint64(_SAME[1]))]).view(np.int64))
            ends = np.concatenate([[0], np.cumsum(list(map(len, lists)), dtype=np.int64)]).astype(np.int32)
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            kinds = pa.float64(), *[pa.int64()] * 4
            columns = [pa.array(c, k) for c, k in zip(zip(*numbers, strict=True) if numbers else [[]] * 5, kinds, strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), *columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["a", "b", "similarity", "short", "long", "weight", "spare", "differs"])

    left = sets.select(F.col("id").alias("a"), F.col("runs").alias("runs_a"))
    right = sets.select(F.col("id").alias("b"), F.col("runs").alias("runs_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "runs_a", "runs_b")
    return joined.mapInArrow(run, "a long, b long, similarity double, short long, long long, weight long, spare long, differs array<long>")


def shared_differences(differ: DataFrame) -> DataFrame:
    """The rows a, d, b that must be looked at: members b that have difference d from reference a among their rarest ones."""
    # Written, so that its size is known before the join is planned: small, it is sent to the members, and they stay where they are.
    apart = written(differ.filter("long > 0").select("a").distinct(), "apart", small=True)
    each = differ.join(apart, "a", "left_semi").withColumn("many", F.size("differs")).withColumn("d", F.explode("differs")).drop("differs")
    # A difference of one member alone can't be shared: it is only counted.
    common = written(each.groupBy("a", "d").agg(F.count("*").alias("n")).filter("n > 1"), "common", small=True)
    line = Window.partitionBy("a", "b").orderBy("n", "d")
    whole = Window.partitionBy("a", "b")
    place = F.col("many") - F.count("*").over(whole) + F.row_number().over(line)
    ranked = each.join(common, ["a", "d"]).withColumn("place", place).filter(F.col("place") <= F.greatest("short", "long"))
    return written(ranked.drop("n"), "shared-differences", small=True)


def candidates(ranked: DataFrame, labels: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) of different components (labels: b, of) that share enough of their rarest differences from one reference to be similar at all."""
    p, q = Fraction(str(similar)).as_integer_ratio()
    named = ranked.join(labels, "b")
    mixed = written(named.groupBy("a", "d").agg(F.min("of").alias("low"), F.max("of").alias("high")).filter("low <> high").select("a", "d"), "mixed-differences", small=True)
    named = written(named.join(mixed, ["a", "d"], "left_semi"), "mixed-members", small=True)
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("b", "of", "weight", "many", "similarity")]
    met = named.filter("place <= long").select("a", "d", "spare", *side("x")).join(named.filter("place <= short").select("a", "d", *side("y")), ["a", "d"])
    enough = F.col("weight_x") + F.col("weight_y") - F.col("spare") <= (p + q) * F.least("many_x", "many_y")
    met = met.filter(enough & (F.abs(F.col("similarity_x") - F.col("similarity_y")) <= 1 - similar + 1e-9) & (F.col("of_x") != F.col("of_y")))
    return met.select(F.least("b_x", "b_y").alias("a"), F.greatest("b_x", "b_y").alias("b")).distinct()


def _labelled(links: DataFrame, needed: DataFrame) -> DataFrame:
    return written(connected_components(links, needed, u="a", v="b").select(F.col("vertex").alias("b"), F.col("component").alias("of")), "near-labels", small=True)


def _stars(ranked: DataFrame, rank: DataFrame, links: DataFrame, labels: DataFrame, needed: DataFrame, sets: DataFrame, similar: float) -> tuple[DataFrame, DataFrame]:
    """(links, labels) after members that share a difference were compared with the most popular of them, while links appear."""
    rest = ranked.select("a", "d", "b").join(rank.withColumnRenamed("id", "b"), "b").select("a", "d", "b", F.struct("popular", (-F.col("b")).alias("low"), "b").alias("rank"))
    while True:
        now = rest.join(labels, "b")
        center = now.groupBy("a", "d").agg(F.max(F.struct("rank", "of")).alias("lead"), F.min("of").alias("low"), F.max("of").alias("high")).filter("low <> high")
        center = written(center.select("a", "d", F.col("lead.rank").alias("lead"), F.col("lead.of").alias("lead_of")), "centers", small=True)
        rest = written(now.join(center, ["a", "d"]).filter("of <> lead_of").drop("of", "lead_of"), "apart", small=True)
        star = rest.groupBy("b").agg(F.max("lead").alias("lead")).select(F.col("lead.b").alias("a"), "b")
        found = written(verified(star, sets, similar), "near-links", small=True)
        if found.isEmpty():
            return links, labels
        links = links.unionByName(found)
        labels = _labelled(links, needed)
        rest = rest.drop("lead")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, similar: float = SIMILAR, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, group_id (the smallest id of its group), group_size, kept, for every row.

    Groups are the components of the verified links, copies included.
    """
    return grouped(docs, id_col, text_col, similar, rows, bands).drop("text_hash")


def grouped(docs: DataFrame, id_col: str, text_col: str, similar: float, rows: int, bands: int) -> DataFrame:
    """doc_id, text_hash, group_id, group_size, kept, for every row."""
    ready(docs.sparkSession)
    with swept(docs.sparkSession) as kept:  # of the tables written on the way the result reads two
        told, sizes = _told(docs, id_col, text_col, similar, rows, bands)
        kept += [told, sizes]
    return told.join(sizes, "group_id", "left").select(F.col("id").alias("doc_id"), "text_hash", "group_id", "group_size", F.coalesce(F.col("id") == F.col("group_id"), F.lit(True)).alias("kept"))


def _told(docs: DataFrame, id_col: str, text_col: str, similar: float, rows: int, bands: int) -> tuple[DataFrame, DataFrame]:
    """(id, text_hash and group_id of every row, size of each group)."""
    signed = written(signatures(docs, id_col, text_col, rows, bands), "signatures")
    named = signed.filter("id is not null")
    # Sums are written before rows are joined with them: Spark splits a skewed join only where both sides come straight from a shuffle.
    same = ["same0", "same1", "size"]
    classes = named.filter("size > 0").groupBy(*same).agg(F.min("id").alias("first_id"))
    own = Window.partitionBy("first_id").orderBy(*same)
    classes = written(classes.withColumn("node", F.when(F.row_number().over(own) == 1, F.col("first_id"))), "classes", small=True)
    nodes = classes.filter("node is not null").select(F.col("node").alias("id"), *same)
    firsts = named.select("id", *same, "bands").join(nodes, ["id", *same], "left_semi")
    keyed = written(firsts.select("id", F.explode("bands").alias("key")).distinct(), "bands", small=True)
    shared = written(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared", small=True)
    placed = written(keyed.join(shared, "key").select("key", "id", "n"), "buckets", small=True)
    # Popularity, and beside it the smaller id as the larger number.
    rank = written(placed.groupBy("id").agg(F.sum("n").alias("popular")), "popularity", small=True)
    placed = placed.select("key", "id").join(rank, "id").select("key", "id", F.struct("popular", (-F.col("id")).alias("low"), "id").alias("rank"))
    needed = rank.select("id")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(needed, "id", "left_semi")
    # Of rows with the same id, one of the content that is compared.
    sets = written(multisets(texts).join(nodes, ["id", "same0"], "left_semi").groupBy("id").agg(F.first("runs").alias("runs")), "multisets")

    center = written(placed.groupBy("key").agg(F.max("rank").alias("center")), "centers", small=True)
    star = placed.select("key", "id").join(center, "key").groupBy("id").agg(F.max("center").alias("center")).select(F.col("center.id").alias("a"), F.col("id").alias("b")).filter("a <> b")
    links = written(verified(star, sets, similar), "near-links", small=True)
    labels = connected_components(links, needed, u="a", v="b").select(F.col("vertex").alias("id"), F.col("component").alias("of"))
    labels = written(labels, "near-labels", small=True)

    at = placed.join(labels, "id")
    mixed = written(at.groupBy("key").agg(F.min("of").alias("low"), F.max("of").alias("high")).filter("low <> high").select("key"), "mixed-buckets", small=True)
    at = written(at.join(mixed, "key", "left_semi"), "mixed", small=True)
    leader = at.select("of", "rank").distinct().groupBy("of").agg(F.max("rank").alias("lead"))
    reference = at.select("key", "of").distinct().join(leader, "of").groupBy("key").agg(F.max("lead").alias("lead")).select("key", F.col("lead.id").alias("a"))
    reference = written(reference, "references", small=True)
    against = at.select("key", F.col("id").alias("b")).join(reference, "key").filter("a <> b").select("a", "b").distinct()
    differ = written(differences(against, sets, similar), "differences")
    links = links.unionByName(differ.filter("long = 0").select("a", "b", "similarity"))
    labels = _labelled(links, needed)
    ranked = shared_differences(differ)
    if not ranked.isEmpty():
        links, labels = _stars(ranked, rank, links, labels, needed, sets, similar)
        across = written(verified(candidates(ranked, labels, similar), sets, similar), "near-links", small=True)
        labels = _labelled(links.unionByName(across), needed)

    groups = written(classes.join(labels, F.col("node") == F.col("b"), "left").select(*same, F.coalesce("of", "first_id").alias("group_id")), "near-groups", small=True)
    told = named.select("id", "text_hash", *same).join(groups, same, "left").select("id", "text_hash", F.coalesce("group_id", "id").alias("group_id"))
    told = written(told.unionByName(signed.filter("id is null").select("id", "text_hash", F.col("id").alias("group_id"))), "near-rows", small=True)
    sizes = written(told.filter("id is not null").select("id", "group_id").distinct().groupBy("group_id").agg(F.count("*").alias("group_size")), "group-sizes", small=True)
    return told, sizes


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, similar: float = SIMILAR, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """The documents, all columns, without those that are in a group of a smaller id; null ids stay."""
    name, mark = fresh(docs, "_gone_id"), fresh(docs, "_gone_hash")
    gone = grouped(docs, id_col, text_col, similar, rows, bands).filter("not kept").select(F.col("doc_id").alias(name), F.col("text_hash").alias(mark)).distinct()
    return docs.join(gone, (F.col(id_col).cast("long") == F.col(name)) & (F.xxhash64(text_col) == F.col(mark)), "left_anti")
