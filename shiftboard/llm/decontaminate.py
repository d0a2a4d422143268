"""Benchmark decontamination by winnowing.

A text's fingerprints are the k-gram hashes that are smallest in some window of ``n - k + 1``
consecutive k-grams.  Two texts that share ``n`` words in a row share such a window and choose the
same k-gram at the same place in it, so every shared span of ``n`` words or more has a common
fingerprint.  Matching fingerprints are extended to the ``n``-word windows that chose them, which
are compared as text.

Spark does the join: documents pass once through a numpy step that keeps, for each document, only
windows whose fingerprint may belong to the benchmark (a filter of fixed size, see ``bloom``); those
windows meet the benchmark's distinct windows in an ordinary equi-join.  A window's items are one sorted list before they meet
documents, and a document's lists are united, so a window that very many documents or items share costs one row per document or
item, never a row for each of their pairs.

Defined results: a null or wordless text has no words and no hits; an item of fewer than ``n`` words is one
window of its own length; repeated items each count; rows that share a document id are one document whose
counts are those of its longest text and whose hits are united; null ids form one such document; empty tables
give empty or hitless results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import bloom, store
from .ids import own_id
from .ship import map_arrow
from .words import Words, gram_bounds, grams, mix, signed, split_column

GOES = "__text_contaminated"
WINDOWS = "array<struct<fp: bigint, size: int, window: string, starts: array<int>>>"
SPANS = pa.list_(
    pa.struct([("fp", pa.int64()), ("size", pa.int32()), ("window", pa.string()), ("starts", pa.list_(pa.int32()))])
)


def chosen(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``width`` grams: its first gram and the last smallest gram in it.

    ``first`` and ``last`` bound each text's grams; windows stay inside one text.
    """
    n = max(len(hashes) - width + 1, 0)
    best, at = hashes[:n].copy(), np.arange(n)
    for j in range(1, width):
        other = hashes[j : j + n]
        lower = other <= best
        best[lower] = other[lower]
        at[lower] = np.flatnonzero(lower) + j
    counts = np.maximum(last - first - width + 1, 0)
    starts = np.repeat(first - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    return starts, at[starts]


def windows(w: Words, n: int, k: int, shorter: list[int], whole_short: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, first words, fingerprints) of all windows of ``n`` words and of the ``shorter`` sizes.

    A shorter window is its own fingerprint: winnowing with one gram per window.  ``whole_short``
    keeps only windows that are a whole text.
    """
    hashes = grams(w.hash, k)
    first, last = gram_bounds(w.bounds, k)
    starts, at = chosen(hashes, first, last, n - k + 1)
    yield n, starts, mix(hashes[at] ^ np.uint64(n))
    counts = w.counts()
    for size in shorter:
        hashes = grams(w.hash, size)
        if whole_short:
            starts = w.bounds[:-1][counts == size]
        else:
            first, last = gram_bounds(w.bounds, size)
            runs = last - first
            starts = np.repeat(first - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
        yield size, starts, mix(hashes[starts] ^ np.uint64(size))


def window_rows(ident: str, n: int, k: int, shorter: list[int], wanted: bloom.Filter | None):
    """A mapInArrow step: one row per text with its words and windows.

    ``wanted`` drops windows whose fingerprint no benchmark item has; without it the texts are items.
    Equal windows of a text are one entry with all their places.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(ident)
            for a, b, w in split_column(batch.column("text"), "alnum", lower=True):
                found: list[dict] = [{} for _ in range(b - a)]
                for size, starts, fps in windows(w, n, k, shorter, wanted is None):
                    if wanted is not None:
                        near = wanted.may_have(fps)
                        starts, fps = starts[near], fps[near]
                    rows = np.searchsorted(w.bounds, starts, "right") - 1
                    local = starts - w.bounds[rows]
                    for s, row, place, fp in zip(starts.tolist(), rows.tolist(), local.tolist(), signed(fps).tolist()):
                        found[row].setdefault((fp, size, w.text(s, s + size)), []).append(place)
                spans = [
                    [{"fp": fp, "size": size, "window": text, "starts": at} for (fp, size, text), at in x.items()] for x in found
                ]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(w.counts(), pa.int64()), pa.array(spans, SPANS)], ["id", "n_words", "spans"]
                )

    return step


def _texts(d: DataFrame, ident: str, text: str) -> DataFrame:
    return d.select(F.col(ident).cast("long").alias("id"), F.col(text).cast("string").alias("text"))


def contaminated_documents(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    n: int = 10,
    k: int = 5,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per document: id, n_words; matched spans: id, start, end, window, size; per document with hits: id, items).

    Words count from 0; ``end`` is one past the span's last word.  All frames come from one stored
    table, so the documents are read once.
    """
    spark = documents.sparkSession
    out = f"id bigint, n_words bigint, spans {WINDOWS}"
    sizes = map_arrow(_texts(benchmark, item_id, text), window_rows("id", n, k, list(range(1, n)), None), out)
    items = store.keep(sizes.select("id", F.explode("spans").alias("s")).select("id", "s.fp", "s.size", "s.window"), "items")
    shorter = sorted(r[0] for r in items.select("size").distinct().collect() if r[0] < n)  # at most n - 1 values
    distinct = items.select("fp", "size", "window").distinct()
    wanted = bloom.build(distinct.select("fp"), F.col("fp"), distinct.count())
    per_text = map_arrow(_texts(documents, doc_id, text), window_rows("id", n, k, shorter, wanted), out)
    # a text without windows keeps one row, whose key no benchmark window has
    spans = per_text.select("id", "n_words", F.explode_outer("spans").alias("s"))
    spans = spans.select("id", "n_words", F.coalesce("s.fp", F.xxhash64("id")).alias("fp"), "s.size", "s.window", "s.starts")
    marked = distinct.withColumn("hit", F.lit(True))
    hits = store.keep(spans.join(marked, ["fp", "size", "window"], "left"), "windows")
    per_document = hits.groupBy("id").agg(F.max("n_words").alias("n_words"))
    matched = hits.filter("hit").select("id", "size", "window", F.explode("starts").alias("start"))
    matched = matched.withColumn("end", F.col("start") + F.col("size"))
    lists = items.groupBy("size", "window").agg(F.array_sort(F.collect_set("id")).alias("items"))
    per_item = hits.filter("hit").select("id", "size", "window").distinct().join(lists, ["size", "window"])
    # windows of the same items give one list
    united = F.array_distinct(F.flatten(F.collect_set("items")))
    return per_document, matched, per_item.groupBy("id").agg(united.alias("items"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items (sorted ids as strings), contaminated."""
    per_document, matched, per_item = contaminated_documents(documents, benchmark, **options)
    before = Window.partitionBy("id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = matched.withColumn("done", F.coalesce(F.max("end").over(before), F.lit(0)))
    n_hit = covered.groupBy("id").agg(
        F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "done"))).cast("long").alias("n_hit")
    )
    items = per_item.select(F.col("id").alias("item_hit_id"), F.array_sort(F.col("items").cast("array<string>")).alias("items"))
    found = n_hit.withColumnRenamed("id", "hit_id").join(items, F.col("hit_id").eqNullSafe(F.col("item_hit_id")), "left")
    out = per_document.join(found, F.col("id").eqNullSafe(F.col("hit_id")), "left")
    return out.select(
        "id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(
    documents: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """The documents without those that hold a benchmark window; other columns as they are.

    A row with a null id is judged by its own text.
    """
    own = own_id(doc_id, text)
    keyed = documents.select(own.alias("id"), F.col(text).alias("text"))
    _, matched, _ = contaminated_documents(keyed, benchmark, doc_id="id", text="text", **options)
    bad = matched.select(F.col("id").alias(GOES)).distinct()
    return documents.join(bad, own == F.col(GOES), "left_anti")
