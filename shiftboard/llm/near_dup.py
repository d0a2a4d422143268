"""Near-duplicate documents: one-permutation MinHash with optimal densification.

One hash per shingle fills all bins of a signature: its high bits choose the bin, the smallest hash of
a bin is kept.  An empty bin copies the first filled bin along a random order of its own, which keeps
the collision probability of every bin equal to the Jaccard similarity.  Bands of bins are bucket keys.

Documents with equal shingle sets are one class from the start, so copies meet as one row.
Within a bucket only a star of candidate edges is made, from its most connected member to the others: a
bucket of m members costs m - 1 pairs.  Every edge is confirmed on the full shingle sets.  A bucket
whose members do not all end up in one component goes another round, around its next most connected
member, if its round at least halved the number of its components; so rounds number at most the logarithm of the largest bucket.

Members of all other buckets that are still apart meet in an exact join: every pair of them that is similar enough shares
one of the rarest shingles of both (see ``remaining``).  So a bucket ends only when its members are one component
or all their pairs in different components are settled.

Shingle sets are stored for members of buckets only, and cut to the members of open buckets as these grow fewer.  Joins with them
are shuffled at every size, never broadcast.  What is stored on the way is removed as soon as nothing reads it.

Defined results: null, empty or wordless texts have an empty set, link with nothing and are kept; a
text of fewer words than a shingle is one shingle; rows that share a document id are
one document, answered row by row; a null id links with nothing and is kept; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import bloom, store
from .components import smallest_reachable
from .ids import own_id
from .ship import map_arrow
from .words import Words, grams, mix, signed, split_column

BINS = 128
ROWS = 4  # bins of a band: at a similarity of 0.8 a pair misses all 32 bands once in 20 million
SEED = 5
KEY, ROW = "__text_near_key", "__text_near_row"


def probe_orders(bins: int = BINS) -> np.ndarray:
    """For each bin, the random order in which it looks for a filled one."""
    rng = np.random.default_rng(SEED)
    return np.array([np.concatenate([[b], rng.permutation(np.delete(np.arange(bins), b))]) for b in range(bins)])


def shingle_sets(w: Words, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes = grams(w.hash, size)
    out = []
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(hashes[a : b - size + 1]))
        elif b > a:
            out.append(grams(w.hash[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """The densified one-permutation signature of a sorted, non-empty set."""
    bins = len(orders)
    width = np.uint64(64 - (bins - 1).bit_length())
    at = np.searchsorted(shingles, np.arange(bins, dtype=np.uint64) << width)
    filled = np.diff(np.append(at, len(shingles))) > 0
    out = shingles[np.minimum(at, len(shingles) - 1)]
    empty = np.flatnonzero(~filled)
    if len(empty):
        probes = orders[empty]
        out[empty] = out[probes[np.arange(len(empty)), filled[probes].argmax(axis=1)]]
    return out


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    parts = mix(sig).reshape(-1, rows)
    key = np.arange(len(parts), dtype=np.uint64)
    for j in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, j])
    return key


def sketch_rows(shingle: int, lower: bool, rows: int):
    orders = probe_orders()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in split_column(batch.column("text"), "graphic", lower):
                sets = shingle_sets(w, shingle)
                keys = [signed(bands(signature(s, orders), rows)) if len(s) else None for s in sets]
                # two sums stand for the whole set
                one = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                two = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(signed(one)),
                        pa.array(signed(two)),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    ["id", "n", "one", "two", "keys"],
                )

    return step


def set_rows(shingle: int, lower: bool, wanted: bloom.Filter):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            near = wanted.may_have(mix(ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)))
            batch = batch.filter(pc.and_(pa.array(near), ids.is_valid()))
            for a, b, w in split_column(batch.column("text"), "graphic", lower):
                sets = [signed(s) for s in shingle_sets(w, shingle)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array(sets, pa.list_(pa.int64()))], ["rep", "shingles"]
                )

    return step


def id_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("rep").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(signed(mix(ids.view(np.uint64))))], ["key"])


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (hub, rep, ...) edges whose full sets are at least ``percent`` per cent similar."""
    # both ends read the sets through the same shuffle
    mine = sets.select(F.col("rep").alias("end"), F.col("shingles").alias("mine"))
    of_hub = sets.select(F.col("rep").alias("start"), "shingles")
    of_rep = mine.join(edges.hint("merge"), F.col("end") == F.col("rep")).drop("end")
    both = of_hub.join(of_rep.hint("merge"), F.col("start") == F.col("hub")).drop("start")
    common = F.size(F.array_intersect("mine", "shingles"))
    union = F.size("mine") + F.size("shingles") - common
    return both.filter(100 * common >= percent * union).drop("mine", "shingles")


def remaining(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(component, other) of all similar pairs of open members in different components.

    Shingles stand in one order for all sets: first those of one component only, then the others, rarest first.
    A pair's first common shingle at a place ``pos`` leaves at most ``n - pos`` common ones, and a similar pair has at least
    ``percent / (100 + percent)`` of both sizes in common.  So the first common shingle stands early in both sets, earliest
    in the smaller one: with its own size as the other's bound, a set in a family that shares a template but
    too little of it has no row on that side, and the family's common shingles are not paired.
    """
    spark = open_.sparkSession
    mine = sets.join(open_.select("rep", "component").distinct().hint("merge"), "rep").withColumn("own", F.xxhash64("shingles"))
    # a document id may have several texts: each set counts by itself
    mine = mine.groupBy("rep", "component", "own").agg(F.first("shingles").alias("shingles"))
    mine = mine.withColumn("n", F.size("shingles").cast("long"))
    mine = store.keep(mine.select("rep", "component", "own", "n", F.explode("shingles").alias("shingle")), "shingles")
    shared = mine.groupBy("shingle").agg(F.count("*").alias("held"), F.min("component").alias("low"), F.max("component").alias("high"))
    ordered = mine.join(shared.filter("low <> high").select("shingle", "held"), "shingle")
    ordered = ordered.groupBy("rep", "component", "own", "n").agg(F.array_sort(F.collect_list(F.struct("held", "shingle"))).alias("shared"))
    early = ordered.select("rep", "component", "n", (F.col("n") - F.size("shared")).alias("before"), F.posexplode("shared").alias("at", "s"))
    early = early.select("rep", "component", "n", F.col("s.shingle").alias("shingle"), (F.col("n") - F.col("before") - F.col("at")).alias("most"))
    early = store.keep(early.filter(100 * F.col("most") >= percent * F.col("n")), "early")
    small = early.filter((100 + percent) * F.col("most") >= 2 * percent * F.col("n"))
    large = early.select("shingle", F.col("rep").alias("hub"), F.col("component").alias("other"), F.col("n").alias("hub_n"), F.col("most").alias("hub_most"))
    enough = percent * (F.col("n") + F.col("hub_n"))
    pairs = small.join(large, "shingle").filter(
        (F.col("component") != F.col("other"))
        & (F.struct("n", "rep") < F.struct("hub_n", "hub"))
        & (100 * F.col("n") >= percent * F.col("hub_n"))
        & ((100 + percent) * F.least("most", "hub_most") >= enough)
    )
    found = store.keep(confirmed(pairs.select("rep", "hub", "component", "other").distinct(), sets, percent).select("component", "other"), "links")
    store.drop(spark, mine)
    store.drop(spark, early)
    return found


def near_duplicates(
    documents: DataFrame,
    *,
    shingle: int = 5,
    percent: int = 80,
    rows: int = ROWS,
    doc_id: str = "doc_id",
    text: str = "text",
    lower: bool = True,
) -> DataFrame:
    """Per document row: id, n_shingles, component_id (smallest reachable id), kept."""
    spark = documents.sparkSession
    texts = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    sketches = store.keep(
        map_arrow(texts, sketch_rows(shingle, lower, rows), "id bigint, n bigint, one bigint, two bigint, keys array<bigint>"),
        "sketches",
    )
    linked = sketches.filter("id is not null and n > 0")
    same = ["n", "one", "two"]
    reps = linked.groupBy(same).agg(F.min("id").alias("rep"), F.first("keys").alias("keys"))
    reps = store.keep(reps, "classes")
    # a document id with several texts has a row in several classes; both are the same node
    entries = reps.select("rep", "n", F.explode("keys").alias("key"))
    # similar documents share many buckets; those with the same members are one, counted
    held = [F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("y")]
    shapes = entries.groupBy("key").agg(F.count("*").alias("size"), *held).filter("size > 1")
    shapes = shapes.groupBy("size", "x", "y").agg(F.min("key").alias("key"), (F.col("size") * F.count("*")).alias("weight"))
    members = store.keep(entries.join(shapes.select("key", "weight"), "key"), "buckets")
    weight = members.groupBy("rep").agg(F.sum("weight").alias("weight"))
    n_reps = weight.count()
    wanted = bloom.build(map_arrow(weight.select("rep"), id_hashes, "key bigint"), F.col("key"), n_reps)
    sets = map_arrow(texts, set_rows(shingle, lower, wanted), "rep bigint, shingles array<bigint>")
    # the filter has a fixed size: what it lets through beyond that is left out here
    sets = store.keep(sets.join(weight.select("rep").hint("merge"), "rep", "left_semi"), "sets")
    # a node's component so far; bucket entries carry it along, so that rounds need not look it up
    nodes = store.keep(weight.select("rep", F.col("rep").alias("component")), "nodes")
    entries = members.select("key", "rep", "n").join(weight, "rep").withColumn("component", F.col("rep"))
    open_, held = store.keep(entries, "open"), n_reps
    store.drop(spark, members)
    parked: list[DataFrame] = []  # members of buckets whose rounds are over
    while held:
        order = F.struct("weight", (-F.col("rep")).alias("low"))
        hub = open_.groupBy("key").agg(F.max_by(F.struct("rep", "n", "component"), order).alias("hub"), F.count_distinct("component").alias("were"))
        star = open_.join(hub, "key").filter("component <> hub.component")
        likely = star.filter(100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n"))
        edges = likely.select("rep", F.col("hub.rep").alias("hub"), "component", F.col("hub.component").alias("other"))
        new = store.keep(confirmed(edges.distinct(), sets, percent).select("component", "other").distinct(), "links")
        merged = _merged(new)
        before, nodes = nodes, store.keep(_moved(nodes, merged), "nodes")
        # the hub has met every member of its bucket
        rest = open_.join(hub.select("key", F.col("hub.rep").alias("hub"), "were"), "key").filter("rep <> hub").drop("hub")
        rest = store.keep(_moved(rest, merged), "rest")
        apart = rest.groupBy("key").agg(F.count_distinct("component").alias("are"), F.first("were").alias("were")).filter("are > 1")
        apart = store.keep(apart.select("key", (2 * F.col("are") <= F.col("were")).alias("goes_on")), "apart")
        parked.append(store.keep(rest.join(apart.filter(~F.col("goes_on")).select("key"), "key").select("rep").distinct(), "parked"))
        was_open, open_ = open_, store.keep(rest.drop("were").join(apart.filter("goes_on").select("key"), "key"), "open")
        for done in (before, was_open, rest, apart, new):
            store.drop(spark, done)
        # the sets that are still to be compared, once they are less than half
        needed = reduce(DataFrame.unionByName, [open_.select("rep"), *parked]).distinct()
        left = needed.count()
        if 2 * left < held:
            was_sets, sets = sets, store.keep(sets.join(needed.hint("merge"), "rep", "left_semi"), "sets")
            store.drop(spark, was_sets)
            held = left
        if open_.isEmpty():
            break
    store.drop(spark, open_)
    if parked:
        outside = reduce(DataFrame.unionByName, parked).distinct().join(nodes, "rep")
        new = remaining(store.keep(outside, "outside"), sets, percent)
        nodes = store.keep(_moved(nodes, _merged(new)), "nodes")
    found = reps.select(*same, "rep").join(nodes.select("rep", "component"), "rep", "left")
    found = found.withColumn("component", F.coalesce("component", "rep"))
    alone = sketches.filter("id is null or n = 0").select("id", "n", F.col("id").alias("component"))
    out = linked.join(found.select(*same, "component"), same).select("id", "n", "component").unionByName(alone)
    out = store.keep(out, "components")
    for done in (sketches, reps, sets, nodes, *parked):
        store.drop(spark, done)
    return out.select(
        "id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")
    )


def _merged(links: DataFrame) -> DataFrame:
    """(component, into): where the components that links tie together go."""
    return smallest_reachable(links, "component", "other").select(F.col("node").alias("component"), F.col("component").alias("into"))


def _moved(d: DataFrame, merged: DataFrame) -> DataFrame:
    return d.join(merged, "component", "left").withColumn("component", F.coalesce("into", "component")).drop("into")


def drop_near_duplicates(
    documents: DataFrame,
    *,
    shingle: int = 5,
    rows: int = ROWS,
    doc_id: str = "doc_id",
    text: str = "text",
    lower: bool = True,
    **options,
) -> DataFrame:
    """One document of each group stays: the one with the smallest id; other columns as they are.

    A text with a null id is a document of its own, after those that have one.  Of rows that repeat the
    id that stays, one of each set of shingles stays.  Texts without words all stay, unless their id goes.
    """
    spark = documents.sparkSession
    own = own_id(doc_id, text)
    keyed = documents.select(own.alias("id"), F.col(text).alias("text"))
    found = near_duplicates(keyed, shingle=shingle, rows=rows, doc_id="id", text="text", lower=lower, **options)
    found = store.keep(found, "found")
    copies = found.filter("not kept").select(F.col("id").alias(KEY)).distinct()
    stay = documents.join(copies, own == F.col(KEY), "left_anti")
    again = found.filter("kept and n_shingles > 0").groupBy("id").agg(F.count("*").alias("held")).filter("held > 1")
    again = store.keep(again.select(F.col("id").alias(KEY)), "again")
    if again.isEmpty():
        return stay
    # only rows that repeat an id need a number of their own
    repeats = stay.join(again, own == F.col(KEY), "left_semi").withColumn(ROW, F.monotonically_increasing_id())
    repeats = store.keep(repeats, "repeats")
    texts = repeats.select(F.col(ROW).alias("id"), F.col(text).cast("string").alias("text"))
    sums = map_arrow(texts, sketch_rows(shingle, lower, rows), "id bigint, n bigint, one bigint, two bigint, keys array<bigint>")
    sums = repeats.select(F.col(ROW).alias("id"), own.alias(KEY)).join(sums.drop("keys"), "id")
    wordless = F.when(F.col("n") == 0, F.col("id"))
    first = sums.groupBy(KEY, "n", "one", "two", wordless.alias("each")).agg(F.min("id").alias("first"))
    first = repeats.join(first.select(F.col("first").alias(ROW)), ROW, "left_semi").select(*repeats.drop(ROW).columns)
    return stay.join(again, own == F.col(KEY), "left_anti").union(first)
