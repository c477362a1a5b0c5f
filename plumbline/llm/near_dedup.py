"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

A document's set holds the 64-bit hashes of its distinct word shingles. A sketch has one
coordinate per bin: in each round every element of the set is thrown into one bin by a
hash of round and element, and a bin keeps the smallest hash of the first round that hit
it. Bins still empty after as many rounds as there are bins are filled one by one in a
second set of rounds, so every coordinate is filled, and the share of equal coordinates of
two sketches concentrates around the sets' similarity.

1. Documents with equal sets become one class, numbered apart from all ids, as two classes
   may have a doc_id in common. A component is named by its smallest doc_id at the end.
2. Bands of coordinates deal the classes into buckets. Every bucket has one hub, chosen by
   a hash; a member is checked against its most similar hubs on the full sets.
3. The links found make components. In a bucket that still holds several of them, the rows
   outside the largest one are compared to all others by sketch, in blocks of bounded size;
   the nearest few of each are checked on the full sets. Pairs inside a component can't
   change the result, so a large group of copies costs no square of it.
4. Buckets in which a row had more such neighbours, and which still hold several components,
   are joined to regions where they share members, and decided in blocks that hold the full
   sets; only links leave these. Most tables have no such bucket.

Links are decided on full sets alone. What sketches decide is which pairs to check: the
bands are so many and so long that a pair at the threshold shares none with probability
under MISSED, and a pair is checked if its sketches agree in up to 0.15 less than the
threshold, six deviations of that share.

Null and empty texts have an empty set and are linked with nothing. A repeated doc_id is
one document with as many rows; rows whose texts differ are linked by the id. Rows with a
null doc_id are linked with nothing: their component_id is null and they are kept. doc_id
must be an integer. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import Written, lean, slices

BINS, MISSED = 256, 1e-6
#: Hubs that a member is checked against at first, neighbours of a row that leave a block of sketches, and the rows of such a block.
HUBS, NEAREST, SKETCHES = 2, 8, 1024
#: Rows, and bytes of full sets, of a block of a region.
BLOCK, BLOCK_BYTES = 512, 1 << 24
#: At most so many ids are sent to every executor; more are joined by a shuffle.
MAX_SENT = 2_000_000
#: Word hashes that a Python worker remembers.
REMEMBERED, KEPT = 500_000, 100_000
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
EMPTY = np.uint64(2**64 - 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


def seed(i: int) -> np.uint64:
    return np.uint64((i + 1) * 0x165667B19E3779F9 & 2**64 - 1)


class Shingles:
    """Sets of word shingles as sorted 64-bit hashes. ASCII capitals are lowered; words end at ASCII white space."""

    def __init__(self, words: int):
        self.n, self.known = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.n:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
        if len(self.known) > REMEMBERED:
            self.known = dict(islice(self.known.items(), KEPT))
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        a = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = len(a) - self.n + 1
        h = a[:n]
        for k in range(1, self.n):
            h = mix(h * M3 + a[k : k + n] + np.uint64(k))
        return np.unique(h)


def sketch(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row of `bins` 64-bit values per set: the round in the top 10 bits, then the hash. Rows of empty sets are EMPTY."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full((len(sets), bins), EMPTY)
    flat, left = out.reshape(-1), np.flatnonzero(sizes)
    for i in range(bins):
        if not len(left):
            return out
        x = mix(np.concatenate([sets[k] for k in left]) ^ seed(i))
        at = np.repeat(left, sizes[left]) * bins + (x % np.uint64(bins)).astype(np.int64)
        np.minimum.at(flat, at, np.uint64(i << 54) | (x >> np.uint64(10)))
        left = left[(out[left] == EMPTY).any(1)]
    for k in left:
        for b in np.flatnonzero(out[k] == EMPTY):
            i = bins + int(b)
            out[k, b] = np.uint64(i << 54) | (mix(sets[k] ^ seed(i)) >> np.uint64(10)).min()
    return out


def banding(threshold: int) -> tuple[int, int]:
    """(bands, coordinates of each): the longest bands of which enough fit into a sketch, so that few buckets hold pairs that aren't similar."""
    if not 50 <= threshold <= 100:
        raise ValueError("thresholds of 50 to 100 hundredths are possible")
    for rows in range(16, 0, -1):
        n = math.ceil(math.log(MISSED) / math.log1p(-((threshold / 100) ** rows))) if threshold < 100 else BINS // 16
        if n * rows <= BINS:
            return n, rows
    raise AssertionError


def agreement(threshold: int) -> int:
    """Equal coordinates below which a pair is not checked."""
    return int((threshold - 15) / 100 * BINS)


def bands(sketches: np.ndarray, n: int, rows: int) -> np.ndarray:
    keys = np.empty((len(sketches), n), np.uint64)
    for b in range(n):
        h = np.full(len(sketches), seed(b))
        for c in range(b * rows, (b + 1) * rows):
            h = mix(h * M3 + sketches[:, c])
        keys[:, b] = h
    return keys.view(np.int64)


def sketched(docs: DataFrame, words: int, threshold: int) -> DataFrame:
    """(doc_id, n, digest, bands, sketch) of every row; the last three null for empty sets."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shape = banding(threshold)

    def run(batches):
        shingles = Shingles(words)
        for b in batches:
            for part in slices(b, "text"):
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                full = np.array([len(s) > 0 for s in sets])
                values = sketch(sets)
                keys = bands(values, *shape)
                low = (values & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([k if f else None for k, f in zip(keys, full, strict=True)], pa.list_(pa.int64())),
                    pa.array([v.tobytes() if f else None for v, f in zip(low, full, strict=True)], pa.binary()),
                ], names=["doc_id", "n", "digest", "bands", "sketch"])

    return rows.mapInArrow(lean(run), "doc_id bigint, n bigint, digest binary, bands array<bigint>, sketch binary")


def full_sets(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(id, shingles) of classes (id, first, digest); texts of the first doc_ids are scanned again rather than sets kept of all.

    A doc_id may have several texts, so a set is known by its digest.
    """
    n = classes.count()
    wanted = classes.select(F.col("first").alias("doc_id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(wanted) if n <= MAX_SENT else wanted, "doc_id", "left_semi")

    def run(batches):
        shingles = Shingles(words)
        for b in batches:
            for part in slices(b, "text"):
                sets = [shingles(t).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["digest", "shingles"])

    sets = rows.mapInArrow(lean(run), "digest binary, shingles binary").dropDuplicates(["digest"])
    known = classes.select("id", "digest")
    return sets.join(F.broadcast(known) if n <= MAX_SENT else known, "digest").select("id", "shingles")


def agreeing(pairs: DataFrame) -> DataFrame:
    """Pairs with `agree`, the number of equal coordinates of sketches sa and sb (which go)."""

    def run(batches):
        for b in batches:
            sa, sb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("sa", "sb"))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), b.column("member"), pa.array((sa == sb).sum(1), pa.int64())], names=["a", "b", "member", "agree"])

    return pairs.mapInArrow(lean(run), "a bigint, b bigint, member bigint, agree bigint")


def similar(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    at = np.searchsorted(x, y)
    common = int((x[np.minimum(at, len(x) - 1)] == y).sum())
    return 100 * common >= threshold * (len(x) + len(y) - common)


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(a, b, linked) by the full sets."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb")), "b")

    def run(batches):
        for batch in batches:
            linked = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), threshold) for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return both.select("a", "b", "xa", "xb").mapInArrow(lean(run), "a bigint, b bigint, linked boolean")


def components(edges: DataFrame, out: Written) -> DataFrame:
    """(id, component) of every node of edges (a, b): the smallest id reachable. Large-star and small-star rounds.

    A hub with many neighbours is no hot task: minima are pre-aggregated, and the joins back
    to the edges are ones that Spark can split.
    """
    e, path = out.put(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new, new_path = out.put(small)
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        out.drop(path)
        e, path = new, new_path
        if now == mark:
            return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").unionAll(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        mark = now


def in_blocks(columns: list[str], work: Callable[[pa.Table, np.ndarray, np.ndarray], pa.RecordBatch]) -> Callable:
    """For rows sorted by columns: work(rows, firsts, ends) of whole blocks, rows that agree in all columns."""

    def found(t: pa.Table, own: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]).any(1)))
        return work(t, first, np.append(first[1:], len(own)))

    def run(batches):
        held: list[pa.RecordBatch] = []
        key = None
        for b in batches:
            if not b.num_rows:
                continue
            own = np.stack([b.column(c).to_numpy() for c in columns], 1)
            if key is not None and (own == key).all():
                held.append(b)
                continue
            t = pa.Table.from_batches([*held, b])
            own = np.stack([t.column(c).to_numpy() for c in columns], 1)
            key = own[-1]
            last = int(np.flatnonzero((own != key).any(1))[-1]) + 1 if (own != key).any() else 0
            if last:
                yield found(t.slice(0, last), own[:last])
            held = t.slice(last).to_batches()
        if held:
            t = pa.Table.from_batches(held)
            yield found(t, np.stack([t.column(c).to_numpy() for c in columns], 1))

    return run


COLUMNS = ["key", "home", "probe"]


def others(i: int, homes: np.ndarray, comps: np.ndarray, n: np.ndarray, sketches: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of homes in other components whose sizes and sketches allow a link with row i, the most similar first, and in how many coordinates they agree."""
    c = homes[(comps[homes] != comps[i]) & (np.minimum(n[homes], n[i]) * 100 >= np.maximum(n[homes], n[i]) * threshold)]
    agree = (sketches[c] == sketches[i]).sum(1)
    order = np.argsort(-agree, kind="stable")[: int((agree >= agreement(threshold)).sum())]
    return c[order], agree[order]


def neighbours(rows: DataFrame, threshold: int) -> DataFrame:
    """(key, a, b, more) from blocks of rows (key, home, probe, is_probe, id, component, n, sketch): each probe with its
    nearest rows of other components that may be linked with it; `more` says that it has others."""

    def work(t: pa.Table, firsts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        keys, ids, comps, n, probes = (t.column(c).to_numpy() for c in ("key", "id", "component", "n", "is_probe"))
        sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
        found = []
        for a, b in zip(firsts, ends, strict=True):
            homes = a + np.flatnonzero(~probes[a:b])
            for i in a + np.flatnonzero(probes[a:b]):
                c, _ = others(i, homes, comps, n, sk, threshold)
                found += [(keys[i], min(ids[i], ids[k]), max(ids[i], ids[k]), len(c) > NEAREST) for k in c[:NEAREST]]
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["key", "a", "b", "more"])

    return rows.repartition(*COLUMNS).sortWithinPartitions(*COLUMNS).mapInArrow(lean(in_blocks(COLUMNS, work)), "key bigint, a bigint, b bigint, more boolean")


def across(rows: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) between components, from blocks of rows (key, home, probe, is_probe, id, component, n, sketch, shingles).

    A block compares its probes to its other rows by sketch and decides on the full sets;
    what it has linked once needs no second link.
    """

    def work(t: pa.Table, firsts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        ids, comps, n, probes = (t.column(c).to_numpy() for c in ("id", "component", "n", "is_probe"))
        sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
        shingles, found = t.column("shingles").combine_chunks(), []
        of = lambda k: np.frombuffer(shingles[int(k)].as_buffer(), np.uint64)
        for a, b in zip(firsts, ends, strict=True):
            roots: dict[int, int] = {}

            def root(x: int, roots: dict[int, int] = roots) -> int:
                while x in roots:
                    x = roots[x]
                return x

            homes = a + np.flatnonzero(~probes[a:b])
            for i in a + np.flatnonzero(probes[a:b]):
                for k in others(i, homes, comps, n, sk, threshold)[0]:
                    x, y = root(int(comps[i])), root(int(comps[k]))
                    if x != y and similar(of(i), of(k), threshold):
                        roots[max(x, y)] = min(x, y)
                        found.append((int(ids[i]), int(ids[k])))
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.repartition(*COLUMNS).sortWithinPartitions(*COLUMNS).mapInArrow(lean(in_blocks(COLUMNS, work)), "a bigint, b bigint")


def mixed_blocks(label: DataFrame, facts: DataFrame, rows: int, size: int | None = None) -> DataFrame:
    """Blocks of the keys of label (key, id, component) that hold several components, with the columns of facts (id, n, ...).

    Every row of such a key is a home and every one outside its largest component a probe;
    each home meets each probe in one block of about `rows` of either, and of about `size`
    bytes of full sets.
    """
    label = label.join(facts.select("id", "n"), "id") if size else label.withColumn("n", F.lit(0))
    counts = label.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    mixed = counts.groupBy("key").agg(F.count("*").alias("k"), F.max_by("component", "c").alias("most"), F.sum("c").alias("size"), F.max("c").alias("top"), F.sum("n").alias("all")).where("k > 1")
    least = F.ceil(F.col("all") * 8 / size) if size else F.lit(1)
    parts = lambda c: F.greatest(F.ceil(c / rows), least).cast("long")
    mixed = mixed.select("key", "most", parts(F.col("size")).alias("homes"), parts(F.col("size") - F.col("top")).alias("probes"))
    near = label.drop("n").join(mixed, "key").join(facts, "id")
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cols = ["id", "component", *(c for c in facts.columns if c != "id")]
    home = near.select("key", place("homes").alias("home"), every("probes").alias("probe"), F.lit(False).alias("is_probe"), *cols)
    probe = near.where("component <> most").select("key", every("homes").alias("home"), place("probes").alias("probe"), F.lit(True).alias("is_probe"), *cols)
    return home.unionAll(probe)


def labelled_by(rows: DataFrame, part: DataFrame) -> DataFrame:
    """rows (key, id) with each id's component, itself where it has none."""
    return rows.select("key", "id").join(part, "id", "left").withColumn("component", F.coalesce("component", "id"))


def groups(docs: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs. threshold is in hundredths, 50 to 100."""
    spark = docs.sparkSession
    out = Written(spark, "near-dedup")
    rows, _ = out.put(sketched(docs, words, threshold))
    classes = rows.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), *(F.first(c).alias(c) for c in ("n", "bands", "sketch")))
    classes, _ = out.put(classes.withColumn("id", F.monotonically_increasing_id()))
    keys = classes.select(F.explode("bands").alias("key"), "id")
    hubs = keys.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("key", "id"), "id")).getField("id").alias("hub")).where("size > 1")
    members, _ = out.put(keys.join(hubs, "key"))
    facts = classes.select("id", "first", "digest", "n", "sketch")
    known = facts.join(members.select("id").distinct(), "id", "left_semi")
    known, _ = out.put(known)
    sets, _ = out.put(full_sets(docs, known, words))
    known = known.drop("first", "digest")

    tested = members.where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"), F.col("id").alias("member")).distinct()
    one, two = (known.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in "ab")
    tested = tested.join(one, "a").join(two, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * threshold)
    tested = agreeing(tested.select("a", "b", "member", "sa", "sb")).where(F.col("agree") >= agreement(threshold))
    nearest = W.partitionBy("member").orderBy(F.desc("agree"), "a", "b")
    tested = tested.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= HUBS).select("a", "b").distinct()
    tested, _ = out.put(verified(tested, sets, threshold))
    # a repeated doc_id with several texts links their classes
    owned = rows.where("digest IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "digest").distinct()
    several = owned.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    owned, _ = out.put(owned.join(several, "doc_id").join(classes.select("digest", "id"), "digest").select("doc_id", "id"))
    twice = owned.join(owned.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b")).distinct()
    links = tested.where("linked").select("a", "b").unionAll(twice.where("a <> b"))
    links, _ = out.put(links)
    part, _ = out.put(components(links, out))

    found, _ = out.put(neighbours(mixed_blocks(labelled_by(members, part), known, SKETCHES), threshold))
    new = found.select("a", "b").distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    new, _ = out.put(verified(new, sets, threshold).where("linked").select("a", "b"))
    if not new.isEmpty():
        links = links.unionAll(new)
        part, _ = out.put(components(links, out))

    full = found.where("more").select("key").distinct()
    if not full.isEmpty():
        held = labelled_by(members.join(full, "key", "left_semi"), part)
        several = held.groupBy("key").agg((F.min("component") < F.max("component")).alias("several")).where("several").select("key")
        left, _ = out.put(members.join(several, "key", "left_semi").select("key", "id", "hub"))
        regions = components(left.select(F.col("id").alias("a"), F.col("hub").alias("b")), out)
        label, _ = out.put(labelled_by(regions.select(F.col("component").alias("key"), "id"), part))
        more, _ = out.put(across(mixed_blocks(label, known.join(sets, "id"), BLOCK, BLOCK_BYTES), threshold))
        if not more.isEmpty():
            part, _ = out.put(components(links.unionAll(more), out))

    names = part.join(classes.select("id", "first"), "id").groupBy("component").agg(F.min("first").alias("name"))
    named = classes.select("digest", "id", "first").join(part.join(names, "component").select("id", "name"), "id", "left")
    found = rows.select("doc_id", "n", "digest").join(named.select("digest", F.coalesce("name", "first").alias("class")), "digest", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("class", "doc_id"))
    found = found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
    found, _ = Written(spark, "near-dedup-result").put(found)
    out.drop()
    return found


def dedup(docs: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of docs of which one of each group stays: the smallest doc_id. Of rows with one doc_id one stays, that of the first text in order."""
    found = groups(docs, words, threshold)
    gone = found.where("NOT kept").select("doc_id").distinct()
    left = docs.join(F.broadcast(gone) if gone.count() <= MAX_SENT else gone, "doc_id", "left_anti")
    twice = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return left
    settled = F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind))
    again = left.join(twice, "doc_id", "left_semi").withColumn("__place", F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), settled))).where("__place = 1")
    return left.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(again.select(docs.columns))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 85)
