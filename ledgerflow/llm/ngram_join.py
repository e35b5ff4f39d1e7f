"""Similarity join of documents on their word n-grams: grouped prefix join.

Documents with the same n-gram set form one class. Of every class the n-grams are ordered,
rare ones first, and its prefix is so long that two sets at or above the threshold share an
n-gram of their prefixes. Classes with the same prefix and size collapse into one group; only
groups enter the inverted index. Group pairs that share a prefix n-gram are filtered by size,
by where in the prefixes it stands, by parities of the whole sets and by the n-grams missing
among the smallest hashes, all exact bounds; then the pair is expanded to its members and
verified on whole sets.

What is asked for are links up to reachability, so a pair inside one component need not be
looked at: every list first meets one of its members (a hub), what was linked is contracted,
and after a few such rounds, each with other hubs, the pairs that still join different
components are verified one by one, most of them made in one list only. A list of thousands
of copies costs about its length, not its square, and no link between components is lost. The
order of the n-grams is by hash, except that at most ``HOT_NGRAMS`` most frequent ones come
last; the order decides the work, never the result.

Texts without words, null or empty, have an empty set and link with nothing. Repeated rows
are members of one class. Sets are held as 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.components import components, extended
from ledgerflow.llm.tables import release, stored
from ledgerflow.llm.text import MIXED_LOWER, runs, shingle_hashes, span_hashes, words

HOT_NGRAMS = 50_000
HOT_LEAST = 24
HUB_ROUNDS = 3
FIRST = 16  # n-grams at the start of a prefix that tell where two groups meet first
SKETCH = [f"s{k}" for k in range(8)]  # columns of 64 parity bits each


def ngram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes, first of each row and one past the last)."""
    start, end, first = words(data, offsets)
    hashes, rows = shingle_hashes(span_hashes(data, start, end, MIXED_LOWER), first, n)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[new], rows[new]
    # Signed order, as Spark compares its longs.
    return hashes.view(np.int64), np.searchsorted(rows, np.arange(len(offsets)))


def signed_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    flat, at = ngram_sets(data, offsets, n)
    return [np.sort(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def class_of(grams: np.ndarray) -> int:
    """One number for equal sets."""
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def parities(grams: np.ndarray) -> np.ndarray:
    """For each of 512 classes of hashes whether the set holds an odd number of them. Two sets
    differ in at least as many n-grams as their parities differ in."""
    odd = np.bincount(grams & 511, minlength=512).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


class Measure:
    """Jaccard similarity of at least ``percent`` in whole numbers, in columns and numpy alike."""

    def __init__(self, percent: int):
        self.percent = percent

    def prefix(self, n: int) -> int:
        return n + (-self.percent * n // 100) + 1 if n else 0

    def sizes_fit(self, a: str, b: str):
        return (F.least(a, b) * 100 >= F.greatest(a, b) * self.percent)

    def holds(self, shared, a: str, b: str):
        return shared * 100 >= (F.col(a) + F.col(b) - shared) * self.percent

    def near(self, one: str, other: str):
        """Whether the parities of two rows of prefixes leave room for enough shared n-grams."""
        apart = sum((F.bit_count(F.col(one + s).bitwiseXOR(F.col(other + s))) for s in SKETCH), F.lit(0))
        return apart <= F.col(f"{one}n") + F.col(f"{other}n") - 2 * self.least_shared(f"{one}n", f"{other}n")

    def early(self, one: str, other: str):
        """Whether a shared n-gram at these places of the prefixes can be the first of enough."""
        shared = self.least_shared(f"{one}n", f"{other}n")
        return (F.col(f"{one}pos") + shared <= F.col(f"{one}n")) & (F.col(f"{other}pos") + shared <= F.col(f"{other}n"))

    def least_shared(self, a: str, b: str):
        return F.ceil((F.col(a) + F.col(b)) * self.percent / (100 + self.percent) - 1e-9)


def once(gram):
    """Whether this list is the one in which two rows of open lists count as a pair: the list of
    their group, or of the earliest n-gram that the starts of both prefixes hold. Pairs whose
    starts share nothing count in every list. Where a pair is at the threshold, its earliest
    shared n-gram passes ``Measure.early``, so no link is lost."""
    common = F.array_intersect("x_first", "y_first")
    apart = (F.size(common) == 0) | (F.get(common, F.lit(0)) == gram)
    return F.when(F.col("x_group") == F.col("y_group"), gram == group_list("x_group")).otherwise(apart)


def group_list(group: str):
    """The number, among those of n-grams, of the list of a group's own members."""
    return F.xxhash64(group, F.lit("group"))


def signatures(docs: DataFrame, measure: Measure, n: int, key: str, text: str) -> DataFrame:
    """(doc_id, n, node, low, parities): set size, class, the smallest hashes, half as many again
    as the prefix, and the parities of the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in runs(batch, "text"):
                sets = signed_sets(data, offsets, n)
                low = [s[: measure.prefix(len(s)) * 3 // 2 + 16] for s in sets]
                node = [class_of(s) for s in sets]
                ends = np.cumsum([0, *map(len, low)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(low)))
                bits = np.array([parities(s) for s in sets]).T
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.int64()), lists, *map(pa.array, bits)],
                    names=["doc_id", "n", "node", "low", *SKETCH],
                )

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n long, node long, low array<long>, " + ", ".join(f"{s} long" for s in SKETCH))


def texts_to_sets(chosen: DataFrame, n: int) -> DataFrame:
    """(node, extra, grams) from (node, text, extra): the whole set of each class.

    An id may repeat with another text; only the class's own text counts."""
    extra = chosen.schema["extra"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in runs(batch, "text"):
                sets = signed_sets(data, offsets, n)
                own = [k for k, (node, s) in enumerate(zip(rows.column(0).to_pylist(), sets, strict=True)) if class_of(s) == node]
                kept = [np.zeros(0, np.int64), *(sets[k] for k in own)]
                ends = np.cumsum([0, *map(len, kept[1:])], dtype=np.int32)
                at = pa.array(own, pa.int64())
                grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept)))
                yield pa.RecordBatch.from_arrays([rows.column(0).take(at), rows.column(2).take(at), grams], names=["node", "extra", "grams"])

    return chosen.select("node", "text", "extra").mapInArrow(run, f"node long, extra {extra}, grams array<long>")


class Join:
    def __init__(self, docs: DataFrame, n: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text"):
        self.docs, self.n = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), n
        self.spark = docs.sparkSession
        self.measure = Measure(percent)
        self.rows = stored(signatures(docs, self.measure, n, key, text), "signatures")
        # One row per class, by its smallest id.
        self.classes = stored(self.rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), *(F.min(c).alias(c) for c in ("n", *SKETCH))), "classes")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(node, extra, grams) for the classes of ``wanted`` (node, doc_id, extra), by the class's own id."""
        return texts_to_sets(self.docs.join(wanted, "doc_id"), self.n)

    def frequent(self) -> np.ndarray:
        """The most frequent n-grams of the prefixes by hash, at most ``HOT_NGRAMS``."""
        first = F.slice("low", 1, F.least(F.size("low"), (F.col("n") * (100 - self.measure.percent) / 100 + 2).cast("int")))
        counts = self.rows.filter("n > 0").select(F.explode(first).alias("gram")).groupBy("gram").agg(F.count("*").alias("c"))
        hot = counts.filter(F.col("c") >= HOT_LEAST).orderBy(F.desc("c"), "gram").limit(HOT_NGRAMS).select("gram").collect()
        return np.array(sorted(r.gram for r in hot), np.int64)

    def index(self) -> tuple[DataFrame, DataFrame]:
        """((gram, pos, group) over the prefixes, (node, group, first)); equal prefixes of one size are one group."""
        measure = self.measure
        shared = self.spark.sparkContext.broadcast(self.frequent())

        def prefix(s: np.ndarray, size: int) -> np.ndarray | None:
            """Frequent n-grams last; None where the part of the set at hand does not decide it."""
            known = shared.value
            common = known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s if len(known) else np.zeros(len(s), bool)
            k = measure.prefix(size)
            if k > len(s) - common.sum() and len(s) < size:
                return None
            return np.concatenate([s[~common], s[common]])[:k]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ends, flat = np.asarray(batch.column(2).offsets), np.asarray(batch.column(2).values)
                made = [prefix(flat[a:b], size) for a, b, size in zip(ends[:-1], ends[1:], np.asarray(batch.column(1)), strict=True)]
                group = [m if m is None else class_of(np.append(m, size)) for m, size in zip(made, batch.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64())), pa.array(group, pa.int64())], names=["node", "prefix", "group"])

        schema = "node long, prefix array<long>, group long"
        from_low = self.rows.filter("n > 0").select("node", "n", "low").mapInArrow(run, schema)
        first = F.slice("prefix", 1, FIRST).alias("first")
        member = stored(from_low.select("node", "group", first).distinct(), "members")
        # Sets whose smallest hashes are nearly all frequent n-grams are decided on the whole set.
        undecided = member.filter("group is null").select("node").join(self.classes.select("node", "doc_id", F.col("n").alias("extra")), "node")
        if undecided.isEmpty():
            made = from_low
        else:
            whole = stored(self.sets(undecided).select("node", F.col("extra").alias("n"), F.col("grams")).mapInArrow(run, schema), "whole")
            made = from_low.filter("group is not null").unionByName(whole)
            member = member.filter("group is not null").unionByName(whole.select("node", "group", first).distinct())
        return made.select("group", F.posexplode("prefix").alias("pos", "gram")), member

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes at or above the threshold, as edges (u, v).

        The smallest hashes, of which both sides know all up to a common bound, rule out most
        pairs exactly: no more of them may be missing than the threshold leaves missing in all.
        """
        m = self.measure
        side = self.low
        known = (
            pairs.join(side.select(F.col("node").alias("a"), F.col("doc_id").alias("d1"), F.col("n").alias("n1"), F.col("low").alias("l1")), "a")
            .join(side.select(F.col("node").alias("b"), F.col("doc_id").alias("d2"), F.col("n").alias("n2"), F.col("low").alias("l2")), "b")
            .filter(m.sizes_fit("n1", "n2"))
        )
        end = [F.when(F.size(f"l{i}") < F.col(f"n{i}"), F.element_at(f"l{i}", -1)).otherwise(F.lit(2**63 - 1)) for i in (1, 2)]
        bound = F.least(*end)
        missing = [F.size(F.filter(F.array_except(f"l{i}", f"l{3 - i}"), lambda g: g <= F.col("bound"))) for i in (1, 2)]
        likely = known.withColumn("bound", bound).filter(
            (missing[0] <= F.col("n1") - m.least_shared("n1", "n2")) & (missing[1] <= F.col("n2") - m.least_shared("n1", "n2"))
        )
        likely = stored(likely.select("a", "b", "d1", "d2", "n1", "n2"), "likely")
        release(self.spark)
        # Each second member's set travels to the first's: one set per pair, and one per hub.
        sent = self.sets(likely.select(F.col("b").alias("node"), F.col("d2").alias("doc_id"), F.struct("a", "n1", "n2").alias("extra")))
        sent = sent.select(F.col("extra.a").alias("a"), F.col("node").alias("b"), F.col("extra.n1").alias("n1"), F.col("extra.n2").alias("n2"), F.col("grams").alias("g2"))
        hubs = self.sets(likely.select(F.col("a").alias("node"), F.col("d1").alias("doc_id")).distinct().withColumn("extra", F.lit(0)))
        shared = F.size(F.array_intersect("g1", "g2"))
        links = sent.join(hubs.select(F.col("node").alias("a"), F.col("grams").alias("g1")), "a").filter(m.holds(shared, "n1", "n2"))
        links = stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
        release(self.spark)
        return links

    def components(self) -> DataFrame:
        """(node, component) for every class that links with another."""
        m = self.measure
        index, member = self.index()
        lists = index.groupBy("gram").agg(F.min("group").alias("hub"), F.max("group").alias("last")).filter("hub < last").select("gram", "hub")
        lists = stored(lists, "lists")
        release(self.spark)
        index = stored(index.join(lists, "gram"), "index")
        release(self.spark)
        traits = self.classes.select("node", "n", *SKETCH)
        groups = member.groupBy("group").agg(F.min("node").alias("head"), F.count("*").alias("members"))
        groups = stored(groups.join(traits.withColumnRenamed("node", "head"), "head"), "groups")

        def prefixed(frame: DataFrame, by: str, start: str) -> DataFrame:
            """The traits of a frame under names with a prefix, keyed by ``by``."""
            return frame.select(by, *(F.col(c).alias(start + c) for c in frame.columns if c != by))

        # First round: every group meets the hub of each of its lists, every member its group's head.
        heads = groups.select("group", F.col("head").alias("node"), "n", *SKETCH)
        meet = index.filter("group <> hub").select("group", "hub").distinct()
        meet = meet.join(prefixed(heads, "group", "x_"), "group").join(prefixed(heads.withColumnRenamed("group", "hub"), "hub", "y_"), "hub")
        meet = meet.filter(m.sizes_fit("x_n", "y_n") & m.near("x_", "y_")).select(F.col("y_node").alias("a"), F.col("x_node").alias("b"))
        crowd = member.join(groups.filter("members > 1").select("group", "head"), "group").filter("node <> head")
        tested = stored(meet.unionByName(crowd.select(F.col("head").alias("a"), F.col("node").alias("b"))).distinct(), "tested")
        places = index.groupBy("gram", "group").agg(F.min("pos").alias("pos"))
        places = places.unionByName(groups.filter("members > 1").select(group_list("group").alias("gram"), "group", F.lit(0).alias("pos")))
        places = stored(places, "places")
        # Only classes in some list can link; their smallest hashes are all that is needed before sets.
        able = member.join(places.select("group").distinct(), "group").select("node").join(self.classes.select("node", "doc_id"), "node")
        self.low = stored(self.rows.join(able, ["node", "doc_id"]).select("node", "doc_id", "n", "low").dropDuplicates(["node"]), "low")
        release(self.spark)
        found = stored(components(self.verified(tested)), "components")

        def open_lists() -> DataFrame:
            """(gram, pos, node, group, first, n, parities, component) of the lists that still hold
            different components, groups expanded to members; a group of several members is a list too."""
            placed = member.join(found, "node", "left").join(traits, "node")
            placed = placed.select("node", "group", "first", "n", *SKETCH, F.coalesce("component", "node").alias("component"))
            # Components per group first: most groups are of one component.
            spread = placed.groupBy("group").agg(F.min("component").alias("c1"), F.max("component").alias("c2"))
            mixed = places.join(spread, "group").groupBy("gram").agg(F.min("c1").alias("c1"), F.max("c2").alias("c2")).filter("c1 < c2").select("gram")
            return places.join(mixed, "gram").join(placed, "group").select("gram", "pos", "node", "group", "first", "n", *SKETCH, "component")

        now = None
        for turn in range(HUB_ROUNDS + 1):
            if now is None:
                now = stored(open_lists(), "open")
                if now.isEmpty():
                    break
            fits = m.sizes_fit("x_n", "y_n") & m.early("x_", "y_") & m.near("x_", "y_")
            one = prefixed(now, "gram", "x_")
            if turn < HUB_ROUNDS:
                # Every list has a hub of its own, so the lists of one crowd try many of its members.
                order = F.xxhash64("gram", "node", F.lit(turn))
                hubs = now.groupBy("gram").agg(F.min_by(F.struct(*(c for c in now.columns if c != "gram")), order).alias("hub"))
                pairs = one.join(prefixed(hubs.select("gram", "hub.*"), "gram", "y_"), "gram").filter((F.col("x_component") != F.col("y_component")) & fits)
            else:
                other = prefixed(now, "gram", "y_")
                pairs = one.join(other, (one.gram == other.gram) & (F.col("x_component") < F.col("y_component")) & fits & once(one.gram))
            pairs = pairs.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
            known = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            pairs = stored(pairs.join(known, ["a", "b"], "left_anti"), "pairs")
            if pairs.isEmpty():
                continue
            more = self.verified(pairs)
            tested = tested.unionByName(pairs)
            if not more.isEmpty():
                found, now = stored(extended(found, more), "components"), None
        return found


def linked(docs: DataFrame, n: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: the size of its set and the smallest
    id reachable over links of at least ``percent`` Jaccard similarity."""
    join = Join(docs, n, percent, key, text)
    found = join.components()
    least = (
        join.classes.select("node", "doc_id")
        .join(found, "node")
        .groupBy("component")
        .agg(F.min("doc_id").alias("least"))
        .join(found, "component")
        .select("node", "least")
    )
    least = join.classes.select("node", "doc_id").join(least, "node", "left").select("node", F.coalesce("least", "doc_id").alias("least"))
    made = join.rows.select("doc_id", F.col("n").alias("n_shingles"), "node").join(least, "node", "left")
    return made.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def without_near_copies(docs: DataFrame, n: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those that reach a smaller id over links; rows without words stay, and
    rows that repeat the id that stays do too."""
    copies = linked(docs, n, percent, key, text).filter("component_id < doc_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(stored(copies, "copies"), key, "left_anti").select(*docs.columns)
