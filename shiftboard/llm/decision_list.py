"""Quality rules: an ordered decision list learnt from labelled statistics.

Sequential covering: grow a conjunction of thresholds by information gain on two thirds of the sample,
prune it from its end on the last third, keep it if it is precise there, remove what it covers, repeat.  A rule grows while a
condition gains, every middle between two neighbouring values being a possible bound; the list grows while its last rule holds.
The list becomes one CASE expression over the statistics' columns, so applying it is plain Spark.

Defined results: null and empty texts count 0 everywhere and fail the base rule; without labels of both
kinds the list is empty and rejects nothing; repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import store
from .labels import training_sample
from .text_stats import COUNTS, counts, shares
from .ship import map_arrow
from .words import slices, text_bytes

SHARES = list(shares({k: np.zeros(0) for k in COUNTS}))
MOST_SAMPLE = 20_000  # labelled rows that reach the driver, 10 numbers each
PRECISION = 0.9  # of a rule on the pruning rows
SUPPORT = 3  # rejected pruning rows a rule must cover


@dataclass(frozen=True)
class Condition:
    stat: str
    above: bool
    bound: float

    def covers(self, stats: dict[str, np.ndarray]) -> np.ndarray:
        return stats[self.stat] > self.bound if self.above else stats[self.stat] <= self.bound

    def column(self) -> Column:
        return F.col(self.stat) > self.bound if self.above else F.col(self.stat) <= self.bound

    def __str__(self) -> str:
        return f"{self.stat} {'>' if self.above else '<='} {self.bound:g}"


Rule = tuple[Condition, ...]


def covered(rule: Rule, stats: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.covers(stats)
    return out


def _best_bound(x: np.ndarray, bad: np.ndarray) -> tuple[float, float, bool]:
    """(gain, bound, above) of the condition on ``x`` that gains most, over all middles between neighbouring values.

    Of equal gains the smallest bound counts, above it before below.
    """
    order = np.argsort(x, kind="stable")
    values, wrong = x[order], bad[order]
    cuts = np.flatnonzero(values[1:] > values[:-1]) + 1
    if not len(cuts):
        return 0.0, 0.0, True
    p, n = int(wrong.sum()), int((~wrong).sum())
    low_bad = np.concatenate([[0], np.cumsum(wrong)])[cuts]
    low_good = cuts - low_bad
    # above and below each bound
    q = np.column_stack([p - low_bad, low_bad]).astype(float)
    m = np.column_stack([n - low_good, low_good]).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        gains = np.where(q > 0, q * (np.log2(q / (q + m)) - np.log2(p / (p + n))), -1.0)
    at, below = divmod(int(gains.argmax()), 2)
    cut = cuts[at]
    return float(gains[at, below]), float((values[cut] + values[cut - 1]) / 2), below == 0


def grow(stats: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while (inside & bad).any() and (inside & ~bad).any():
        best, gain = None, 1e-9
        for stat, x in stats.items():
            g, bound, above = _best_bound(x[inside], bad[inside])
            if g > gain:
                best, gain = Condition(stat, above, bound), g
        if best is None or best.covers(stats)[inside].all():
            break
        rule.append(best)
        inside &= best.covers(stats)
    return tuple(rule)


def _worth(rule: Rule, stats: dict[str, np.ndarray], bad: np.ndarray) -> float:
    hit = covered(rule, stats, len(bad))
    p, n = (hit & bad).sum(), (hit & ~bad).sum()
    return (p - n) / (p + n) if p + n else -1.0


def prune(rule: Rule, stats: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The prefix that does best on rows the rule was not grown on; the shorter one on a tie."""
    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (_worth(r, stats, bad), -len(r)))


def learn(stats: dict[str, np.ndarray], bad: np.ndarray, part: np.ndarray) -> list[Rule]:
    """Ordered rules that reject; ``part`` deals rows to growing (0, 1) and pruning (2)."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while True:
        growing, pruning = left & (part != 2), left & (part == 2)
        if not (growing & bad).any() or not (growing & ~bad).any():
            break
        rule = grow({k: x[growing] for k, x in stats.items()}, bad[growing])
        if not rule:
            break
        held = {k: x[pruning] for k, x in stats.items()}
        rule = prune(rule, held, bad[pruning])
        hit = covered(rule, held, int(pruning.sum()))
        right = (hit & bad[pruning]).sum()
        if right < SUPPORT or right < PRECISION * hit.sum():
            break
        rules.append(rule)
        # a rule that holds covers pruning rows, so fewer rows are left each time
        left &= ~covered(rule, stats, len(bad))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the first rule that covers a row rejects it."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for a, b in slices(offsets):
            part = offsets[a : b + 1]
            found, _ = counts(data[part[0] : part[-1]], part - part[0])
            columns = [batch.column("id").slice(a, b - a)] + [pa.array(found[k], pa.int64()) for k in COUNTS]
            columns += [pa.array(x, pa.float64()) for x in shares(found).values()]
            yield pa.RecordBatch.from_arrays(columns, ["id", *COUNTS, *SHARES])


def statistics(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: id, the counts and the shares of ``text_stats``."""
    texts = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    schema = ", ".join(["id bigint", *(f"{c} bigint" for c in COUNTS), *(f"{s} double" for s in SHARES)])
    return map_arrow(texts, _rows, schema)


def learn_rules(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", most: int = MOST_SAMPLE) -> list[Rule]:
    """A decision list from at most about ``most`` labelled training rows; shares only, never ids or sources."""
    sample = stats.join(training_sample(labels, doc_id, label, most), "id").select("id", "label", *SHARES)
    got = sample.toPandas().sort_values(["id", *SHARES])
    part = (got["id"].to_numpy() * 2654435761 >> 8) % 3
    return learn({s: got[s].to_numpy() for s in SHARES}, got["label"].to_numpy() == 0, part)


def judge(
    documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = MOST_SAMPLE
) -> DataFrame:
    """Per document row: id, counts, shares, base_failed, kept."""
    stats = store.keep(statistics(documents, doc_id, text), "statistics")
    rules = learn_rules(stats, labels, doc_id, label, most)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return stats.select("*", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
