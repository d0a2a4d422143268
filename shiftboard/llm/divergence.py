"""Source divergence audit: how far the sources of a language lie from each other, and by which terms.

Counting is an Arrow compute pipeline inside the tasks: ``ascii_lower``, ``split_pattern_regex``, ``dictionary_encode`` and
hash ``group_by``, first by (row, term), which gives the documents a term is in, then by (language, source, term).  A task adds up
its partial counts and hands on a row per group and term, so a source with a third of all rows costs one partial row per task.

Spark adds up the partial counts and keeps a language's terms that stand in enough documents.  Kept counts are dealt into columnar
shards of bounded size by the term's hash.  Each shard compares its groups on all its terms and gives partial divergences
per pair of sources and the leading terms of each source; the sums over a language's shards are exact integers.

Smoothed share: ``p = 1 + floor(ONE * (count + 2) / (N + 2 * V))`` over the V kept terms of the language, N their count in the
group.  Divergence of two shares: ``floor((p - q)^2 / (p + q))``.  Quotients are formed digit by digit, so
counts up to 2^52 keep all arithmetic in 64 bits and exact.

Defined results: a null text, language or source counts as ''; documents are rows, also where they share or lack an id; a
group without terms has N = 0 and is compared like others; a language without kept terms gives 0 for each pair of its
sources and no terms; a language with one source has no pairs; ties go to the smaller item by its UTF-8 bytes; an
empty table gives an empty result; other columns are ignored.  A text of any length is counted whole, in one task.
The result holds a row per ordered pair of a language's sources, so it grows with their square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from . import store
from .ship import map_arrow, package
from .words import slices, text_bytes

#: what stands between terms, once A-Z are lower-cased
BETWEEN = r"[\x00-\x60\x7B-\x7F]+"
ONE = 1_000_000_000
SLICE = 1 << 21  # bytes of text split at once
PENDING = 1 << 19  # partial rows a task adds up before it hands them on
CELLS = 1 << 18  # groups x terms that a shard holds at most
BLOCK = 128  # sources that one comparison task takes as first of a pair
COUNTS = "lang string, source string, term string, n bigint, docs bigint"
FOUND = "lang string, source string, part string, item string, value bigint"


KEYS = ("lang", "source", "term")


def _summed(table: pa.Table) -> pa.Table:
    """One row per key: the three texts become one number, by which the hash table groups."""
    coded = [pc.dictionary_encode(table.column(c)).combine_chunks() for c in KEYS]
    values, number = [c.dictionary for c in coded], np.zeros(len(table), np.int64)
    for c, v in zip(coded, values):
        number = number * len(v) + c.indices.to_numpy()
    held = pa.table({"key": pa.array(number), "n": table.column("n"), "docs": table.column("docs")})
    out = held.group_by("key", use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    rest, columns = out.column("key").to_numpy(), []
    for v in reversed(values):
        columns.insert(0, v.take(pa.array(rest % len(v))))
        rest = rest // len(v)
    return pa.table([*columns, out.column("n_sum"), out.column("docs_sum")], [*KEYS, "n", "docs"])


def slice_counts(text: pa.Array, group: pa.Table) -> pa.Table:
    """Counts of some whole texts: lang, source, term, n, docs.  The term '' counts a group's documents."""
    parts = pc.split_pattern_regex(pc.ascii_lower(text), BETWEEN)
    row, term = pc.list_parent_indices(parts), pc.list_flatten(parts)
    filled = pc.not_equal(term, "")
    coded = term.filter(filled).dictionary_encode()
    pairs = pa.table({"row": row.filter(filled), "code": coded.indices, "n": pa.array(np.ones(len(coded), np.int64))})
    pairs = pairs.group_by(["row", "code"], use_threads=False).aggregate([("n", "sum")])
    # a row's group as a number, so that documents of one group add up before texts come back
    lang, source = (pc.dictionary_encode(group.column(c)).combine_chunks() for c in KEYS[:2])
    of_row = lang.indices.to_numpy().astype(np.int64) * max(len(source.dictionary), 1) + source.indices.to_numpy()
    held = {"group": pa.array(of_row[pairs.column("row").to_numpy()]), "code": pairs.column("code"), "n": pairs.column("n_sum")}
    held = pa.table(held | {"docs": pa.array(np.ones(len(pairs), np.int64))})
    sums = held.group_by(["group", "code"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    of_group = sums.column("group").to_numpy()
    names = [lang.dictionary.take(pa.array(of_group // max(len(source.dictionary), 1))), source.dictionary.take(pa.array(of_group % max(len(source.dictionary), 1)))]
    terms = coded.dictionary.take(sums.column("code").combine_chunks())
    counted = pa.table([*names, terms, sums.column("n_sum"), sums.column("docs_sum")], [*KEYS, "n", "docs"])
    texts = len(group)
    there = [pa.array([""] * texts, pa.large_string()), pa.array(np.zeros(texts, np.int64)), pa.array(np.ones(texts, np.int64))]
    there = _summed(pa.table([group.column("lang"), group.column("source"), *there], counted.column_names))
    return pa.concat_tables([counted, there.cast(counted.schema)])


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shape = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
    waiting: list[pa.Table] = []
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        group = pa.Table.from_batches([batch.select(["lang", "source"])])
        for a, b in slices(offsets, SLICE):
            # arrays of their own: ``ascii_lower`` reads past the start of a sliced one
            ends, held = pa.py_buffer(offsets[a : b + 1] - offsets[a]), pa.py_buffer(data[offsets[a] : offsets[b]])
            waiting.append(slice_counts(pa.LargeStringArray.from_buffers(b - a, ends, held), group.slice(a, b - a)))
            if sum(map(len, waiting)) > PENDING:
                waiting = [_summed(pa.concat_tables(waiting))]
                if len(waiting[0]) > PENDING // 2:
                    yield from waiting.pop().cast(shape).to_batches()
    if waiting:
        yield from _summed(pa.concat_tables(waiting)).cast(shape).to_batches()


def share(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(ONE * (count + 2) / (total + 2 * terms)), three decimal digits at a time."""
    by, rest = np.int64(total + 2 * terms), count.astype(np.int64) + 2
    out = rest // by
    rest = rest % by
    for _ in range(3):
        out = out * 1000 + rest * 1000 // by
        rest = rest * 1000 % by
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def compare_shard(most: int):
    """Compares the groups of one shard: its kept counts, and all groups of its language."""

    def step(key: tuple, counts: pa.Table, groups: pa.Table) -> pa.Table:
        lang, block = key[0].as_py(), key[2].as_py()
        groups = groups.sort_by("source")
        sources, totals = groups.column("source").to_pylist(), groups.column("total").to_pylist()
        out: dict[str, list] = {"source": [], "part": [], "item": [], "value": []}
        if len(counts) and sources:
            v, whole = counts.column("v")[0].as_py(), counts.column("lang_total")[0].as_py()
            coded = counts.column("term").combine_chunks().dictionary_encode()
            terms = coded.dictionary.to_pylist()
            at = {s: i for i, s in enumerate(sources)}
            held = np.zeros((len(sources), len(terms)), np.int64)
            rows = np.array([at[s] for s in counts.column("source").to_pylist()])
            held[rows, coded.indices.to_numpy()] = counts.column("n").to_numpy()
            of_lang = np.zeros(len(terms), np.int64)
            of_lang[coded.indices.to_numpy()] = counts.column("lang_n").to_numpy()
            shares = np.array([share(row, total, v) for row, total in zip(held, totals)])
            expected = share(of_lang, whole, v)
            order = np.argsort(np.array([t.encode() for t in terms], object))
            for i in range(block * BLOCK, min((block + 1) * BLOCK, len(sources))):
                sums = apart(shares[i], shares).sum(axis=1).tolist()
                out["source"] += [sources[i]] * (len(sources) - 1)
                out["part"] += ["pair"] * (len(sources) - 1)
                out["item"] += sources[:i] + sources[i + 1 :]
                out["value"] += sums[:i] + sums[i + 1 :]
                leads = order[((held[i] > 0) & (shares[i] > expected))[order]]
                values = apart(shares[i][leads], expected[leads])
                best = np.argsort(-values, kind="stable")[:most]
                out["source"] += [sources[i]] * len(best)
                out["part"] += ["term"] * len(best)
                out["item"] += [terms[t] for t in leads[best]]
                out["value"] += values[best].tolist()
        columns = [pa.array([lang] * len(out["source"]), pa.string()), *(pa.array(out[c], pa.string()) for c in ("source", "part", "item"))]
        return pa.table([*columns, pa.array(out["value"], pa.int64())], ["lang", "source", "part", "item", "value"])

    return step


def audit(
    documents: DataFrame, *, least: int = 10, most: int = 10, cells: int = CELLS, text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """Rows lang, source, part, item, value, rank.

    Part ``pair``: item is another source of the language, value the divergence from it over all kept terms, all ranks.  Part
    ``term``: item is a kept term that the source holds more often than its language does, the ``most`` leading ones.
    ``least``: in how many documents of the language a term must stand.
    """
    spark = documents.sparkSession
    package(spark)
    rows = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = map_arrow(rows, partial_counts, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = store.keep(counts, "counts")
    terms = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= least)
    kept = store.keep(counts.select("lang", "source", "term", "n").join(terms.drop("docs"), ["lang", "term"]), "kept")
    # a row per group, and a row per language
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left")
    groups = store.keep(groups.withColumn("total", F.coalesce("total", F.lit(0).cast("bigint"))), "groups")
    wide = groups.groupBy("lang").agg(F.count("*").alias("held"), F.sum("total").alias("lang_total"))
    of_terms = terms.groupBy("lang").agg(F.count("*").alias("v"))
    shape = wide.join(of_terms, "lang").withColumn("shards", F.ceil(F.col("v") * F.col("held") / F.lit(float(cells))).cast("int"))
    shape = shape.withColumn("blocks", F.ceil(F.col("held") / BLOCK).cast("int"))
    shape = store.keep(shape, "shape")
    blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    dealt = kept.join(shape.select("lang", "v", "lang_total", "shards", "blocks"), "lang")
    shard = F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard")
    dealt = dealt.select("lang", shard, "source", "term", "n", "lang_n", "v", "lang_total", blocks)
    beside = groups.join(shape.select("lang", "shards", "blocks"), "lang")
    beside = beside.select("lang", "source", "total", "blocks", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    beside = beside.select("lang", "source", "total", "shard", blocks)
    by = ["lang", "shard", "block"]
    parts = dealt.groupBy(*by).cogroup(beside.groupBy(*by)).applyInArrow(compare_shard(most), FOUND)
    parts = store.keep(parts, "parts")
    # every ordered pair of a language's sources, also where nothing is to be compared
    others = groups.select("lang", F.col("source").alias("item"))
    every = groups.select("lang", "source").join(others, "lang").filter("source <> item")
    sums = parts.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = every.join(sums, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("bigint")).alias("value"))
    found = pairs.unionByName(parts.filter("part = 'term'"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return found.withColumn("rank", F.row_number().over(order)).filter((F.col("part") == "pair") | (F.col("rank") <= most))
