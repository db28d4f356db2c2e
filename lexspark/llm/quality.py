"""Quality rules as a short-circuit cascade.

What rules read of a text, its facts, is timed on a bounded sample, and counted which rules
reject a document jointly. The rules are then ordered greedily by rejection per cost among the
documents that the rules before them let through; a fact that an earlier rule has needed costs
a later one nothing. The order decides what is computed, never what is kept: a document is
kept when no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh, hash_words, map_arrow, mark_windows, require, text_bytes, window_hashes, words_of

#: Documents of the sample on which rules are timed, at most, drawn from all rows alike.
SAMPLE, SEED = 256, 7
_SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))


class Facts:
    """What rules read of one text; each fact is computed when first asked for."""

    def __init__(self, raw: bytes | None) -> None:
        self.raw = raw or b""

    @cached_property
    def words(self) -> list[bytes]:
        return words_of(self.raw)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(b"".join(self.words).translate(None, _CONTINUATION))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.raw.split(b"\n") if line.strip(b" \t\n\x0b\x0c\r")]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def hashes(self) -> np.ndarray:
        return hash_words(self.words)

    @cached_property
    def n_repeat_words(self) -> int:
        if self.n_words <= 5:
            return 0
        _, back, times = np.unique(window_hashes(self.hashes, 5), return_inverse=True, return_counts=True)
        return int(mark_windows(np.flatnonzero(times[back] > 1), 5, self.n_words).sum())

    @cached_property
    def n_stutters(self) -> int:
        """Words equal to the word before."""
        return int((self.hashes[1:] == self.hashes[:-1]).sum())

    @cached_property
    def n_shouted(self) -> int:
        return sum(len(w) > 1 and w.isupper() for w in self.words)


#: Facts that take time, each after those it is made from.
FACTS = ("words", "word_chars", "n_symbols", "lines", "n_dup_lines", "hashes", "n_repeat_words", "n_stutters", "n_shouted")


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Facts], bool]


# Thresholds are fixed parameters; whole numbers keep every comparison exact.
FEW_WORDS = Rule("few_words", ("words",), lambda d: d.n_words < 10)
REPEATS = Rule("repeats", ("words", "hashes", "n_repeat_words"), lambda d: 100 * d.n_repeat_words > 20 * d.n_words)
SYMBOLS = Rule("symbols", ("words", "n_symbols"), lambda d: 10 * d.n_symbols > d.n_words)
DUP_LINES = Rule("dup_lines", ("lines", "n_dup_lines"), lambda d: 100 * d.n_dup_lines > 50 * len(d.lines))
STUTTER = Rule("stutter", ("words", "hashes", "n_stutters"), lambda d: 100 * d.n_stutters > 30 * d.n_words)
SHOUTING = Rule("shouting", ("words", "n_shouted"), lambda d: 100 * d.n_shouted > 50 * d.n_words)
WORD_LENGTH = Rule("word_length", ("words", "word_chars"), lambda d: not 2 * d.n_words <= d.word_chars <= 15 * d.n_words)
RULES = (FEW_WORDS, REPEATS, SYMBOLS, DUP_LINES, STUTTER, SHOUTING, WORD_LENGTH)
BASE_RULES = (FEW_WORDS, REPEATS)
_BY_NAME = {r.name: r for r in RULES}


@dataclass
class Estimates:
    """Seconds of each fact, the facts of each rule, and how many sampled documents each set of
    rules rejects."""

    cost: dict[str, float] = field(default_factory=dict)
    needs: dict[str, tuple[str, ...]] = field(default_factory=dict)
    rejected: dict[frozenset[str], int] = field(default_factory=dict)

    def order(self) -> list[str]:
        left, out, known = dict(self.rejected), [], set()
        waiting = sorted(self.needs)
        while waiting:
            price = {r: sum(self.cost[f] for f in self.needs[r] if f not in known) + 1e-9 for r in waiting}
            gain = {r: sum(n for names, n in left.items() if r in names) / price[r] for r in waiting}
            best = max(waiting, key=lambda r: (gain[r], -price[r]))
            out.append(best)
            waiting.remove(best)
            known.update(self.needs[best])
            left = {names: n for names, n in left.items() if best not in names}
        return out


def _probe(names: list[str], batch: pa.RecordBatch) -> pa.RecordBatch:
    costs, masks = [], []
    for raw in batch.column(0).to_pylist():
        facts, spent = Facts(raw), []
        for name in FACTS:
            began = time.perf_counter()
            getattr(facts, name)
            spent.append(time.perf_counter() - began)
        masks.append(sum(int(_BY_NAME[name].rejects(facts)) << i for i, name in enumerate(names)))
        costs.append(spent)
    return pa.RecordBatch.from_arrays([pa.array(masks, pa.int64()), pa.array(costs, pa.list_(pa.float64()))], names=["mask", "costs"])


def estimate(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> Estimates:
    """Costs and joint selectivity on ``sample`` documents from the whole table; only sums reach the
    driver, one row for each set of rules that rejects a document."""
    names = [r.name for r in rules]
    share = min(1.0, (sample + 4 * sample**0.5) / max(1, docs.count()))
    chosen = docs.select(text_bytes(text_col).alias("raw")).sample(share, seed=SEED).limit(sample)
    probes = map_arrow(chosen, partial(_probe, names), "mask long, costs array<double>")
    sums = [F.sum(F.col("costs")[i]).alias(f"c{i}") for i in range(len(FACTS))]
    found = Estimates(dict.fromkeys(FACTS, 0.0), {r.name: r.needs for r in rules})
    for row in probes.groupBy("mask").agg(F.count("*").alias("n"), *sums).collect():
        found.rejected[frozenset(n for i, n in enumerate(names) if row["mask"] >> i & 1)] = row["n"]
        for i, name in enumerate(FACTS):
            found.cost[name] += row[f"c{i}"]
    return found


def first_rejection(facts: Facts, order: list[str]) -> str | None:
    return next((name for name in order if _BY_NAME[name].rejects(facts)), None)


def _filter(order: list[str], batch: pa.RecordBatch) -> pa.RecordBatch:
    failed = [first_rejection(Facts(raw), order) for raw in batch.column(0).to_pylist()]
    return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(failed, pa.string())], names=[*batch.schema.names[1:], "failed_rule"])


def quality_verdicts(docs: DataFrame, text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """``docs`` plus ``failed_rule``: the first rule of the cascade that rejects the text, null
    if it is kept. Null texts count as empty and fail ``few_words``; a column ``failed_rule``
    of the input is replaced, all others are carried along; repeated rows each have theirs; an
    empty table gives an empty table; no shuffle."""
    require(docs, text_col)
    order = order or estimate(docs, text_col).order()
    keep = [c for c in docs.columns if c.lower() != "failed_rule"]
    lead = fresh(docs, "__text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), "failed_rule string"])
    return map_arrow(docs.select(text_bytes(text_col).alias(lead), *keep), partial(_filter, order), schema)


def quality_filter(docs: DataFrame, text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, columns unchanged, whatever their names; null
    and empty texts go, repeated rows stay or go together, an empty table stays empty."""
    return quality_verdicts(docs, text_col, order).where("failed_rule is null").select(*docs.columns)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _report(order: list[str], batch: pa.RecordBatch) -> pa.RecordBatch:
    columns, base, kept = {c: [] for c in _COUNTS}, [], []
    for raw in batch.column(1).to_pylist():
        facts = Facts(raw)
        kept.append(first_rejection(facts, order) is None)
        base.append(any(r.rejects(facts) for r in BASE_RULES))
        for name in _COUNTS:
            columns[name].append(getattr(facts, name))
    arrays = [batch.column(0), *(pa.array(columns[c], pa.int64()) for c in _COUNTS), pa.array(base, pa.bool_()), pa.array(kept, pa.bool_())]
    return pa.RecordBatch.from_arrays(arrays, names=["id", *_COUNTS, "base_failed", "kept"])


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """``(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)``,
    one row per input row: the cascade's verdict, and the facts completed for rows on which
    it stopped early. Null texts count as empty; ids may be null or repeat; rows do not influence
    each other; other columns are not read; an empty table gives an empty table."""
    require(docs, id_col, text_col)
    order = order or estimate(docs, text_col).order()
    source = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("raw"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = map_arrow(source, partial(_report, order), f"id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", base_failed boolean, kept boolean")
    return out.withColumnRenamed("id", id_col)
