"""Secret scans by grammar inference.

Labelled credentials become a prefix tree whose states are merged while their outgoing
frequencies are statistically compatible (state merging with Hoeffding bounds, after
Carrasco and Oncina, 1994). The resulting probabilistic automaton gives any candidate string
a likelihood, and so do the lengths of labels that begin alike. A second automaton, of identifiers made of ordinary
words, gives the likelihood that a name in code or prose would have. A candidate is reported if the
first is so many times the second, for its length, as it is for credentials held out from learning; base patterns always are.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from functools import cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import map_arrow, require, text_bytes
from ._spans import Covered, Span, code_points, digest, joined, ordered

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "format")
#: Leading characters of a credential that are kept as they are; later ones by class.
LITERAL = 4
#: Merging: confidence of the Hoeffding test.
ALPHA = 0.05
#: Labelled credentials used, at most, and the share of them that sets the threshold.
LABELLED, HELD_OUT = 1200, 0.25
#: Length of the shortest candidate in terms of the shortest label, and the probability of a step that
#: was never seen, anywhere and by a state.
SHORTEST, UNSEEN, RARE = 0.5, 1e-4, 0.1
#: Held-out credentials that may score below the threshold, as a share, and how far below the next one it lies.
MISSED, SLACK = 0.01, 0.1

#: Spread of a label's length, at least.
SPREAD = 0.1
# Words of which ordinary identifiers are made.
_ORDINARY = (
    "access account action address after and animation array background base based before block body browser buffer build button cache case change check "
    "class client code color column command common config content context copy count create current data date default delete detail device display document "
    "down download duration edit element end error event exchange export feature field file filter first font for form frame from function get global group handler "
    "header height history home host html icon image implementation import index info input internal item key label language last layout length level library "
    "line link list live load local location log main manager map menu message method mode model module name negotiation network new node north notes number object of on "
    "online open option order output override package page panel parent path pattern point position prefix preview primary process profile project property public query "
    "random range read record registry remote remove report request reset resource response result role root route row rule save scale schema screen script search section "
    "security select server service session setting settings shared shop show size slug sort source south stack start state static status step store stream street string style system table tag "
    "target template test text theme thread time title token tool tonight total track transaction transfer tree type update upload user util valid value vector version "
    "video view visible weather web west widget width window with word worker world write zone"
).split()

_ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
_WORDS = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(rb"[0-9a-f]{24,}")
#: Where a candidate may begin within a run: behind a separator, a percent or a backslash escape.
_START = re.compile(rb"(?<![A-Za-z0-9])|(?<=%[0-9A-Fa-f]{2})|(?<=\\[a-z])")


def labelled_credentials(n: int = LABELLED, seed: int = 7) -> list[tuple[str, str]]:
    """``(kind, value)`` in well-known public formats, drawn by rule; a team that has real
    labelled credentials passes its own list instead."""
    rnd = random.Random(seed)
    draw = lambda letters, k: "".join(rnd.choices(letters, k=k))
    word = string.ascii_letters + string.digits
    formats = {
        "forge": lambda: "ghp_" + draw(word, 36),
        "chat": lambda: "xoxb-" + draw(string.digits, 11) + "-" + draw(word, 24),
        "payment": lambda: "sk_live_" + draw(word, 24),
        "maps": lambda: "AIza" + draw(word + "_-", 35),
        "packages": lambda: "npm_" + draw(word, 36),
        "mail": lambda: "key-" + draw("0123456789abcdef", 32),
    }
    return [(kind, make()) for _ in range(n // len(formats)) for kind, make in formats.items()]


def _kind(c: str) -> str:
    """A character's class; letters that may be hexadecimal digits are apart from others."""
    if c.isdigit():
        return "9"
    if c.islower():
        return "f" if c <= "f" else "a"
    if c.isupper():
        return "F" if c <= "F" else "A"
    return c


def symbols(value: str) -> list[str]:
    return [*value[:LITERAL], *map(_kind, value[LITERAL:])]


def ordinary_names(n: int = LABELLED, seed: int = 11) -> list[str]:
    """Identifiers as they stand in code and prose: ordinary words, joined in the usual ways."""
    rnd = random.Random(seed)
    joins = {
        "kebab": lambda w: "-".join(w),
        "snake": lambda w: "_".join(w),
        "camel": lambda w: w[0] + "".join(x.capitalize() for x in w[1:]),
        "pascal": lambda w: "".join(x.capitalize() for x in w),
        "upper": lambda w: "_".join(w).upper(),
        "path": lambda w: "/".join(w),
        "plain": lambda w: "".join(w),
    }
    ends = ("", "", "", "1", "2", "-1", "_v2", "2024", "-2024-01-15", "=", "==true", "=1")
    return [join(rnd.choices(_ORDINARY, k=rnd.randint(2, 6))) + rnd.choice(ends) for _ in range(n // len(joins)) for join in joins.values()]


class Automaton:
    """States as dicts: ``steps`` (symbol -> [next state, count]), ``ends`` and ``seen``."""

    def __init__(self) -> None:
        self.steps: list[dict[str, list[int]]] = [{}]
        self.ends: list[int] = [0]
        self.seen: list[int] = [0]
        #: Symbols behind the literal ones, of all words.
        self.kinds: Counter[str] = Counter()

    def add(self, word: list[str]) -> None:
        state = 0
        self.kinds.update(word[LITERAL:])
        for symbol in word:
            self.seen[state] += 1
            step = self.steps[state].get(symbol)
            if step is None:
                self.steps.append({})
                self.ends.append(0)
                self.seen.append(0)
                step = self.steps[state][symbol] = [len(self.steps) - 1, 0]
            step[1] += 1
            state = step[0]
        self.seen[state] += 1
        self.ends[state] += 1

    @staticmethod
    def _differ(f1: int, n1: int, f2: int, n2: int, alpha: float) -> bool:
        bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))
        return abs(f1 / n1 - f2 / n2) > bound

    def compatible(self, a: int, b: int, alpha: float) -> bool:
        waiting = [(a, b)]
        while waiting:
            a, b = waiting.pop()
            n1, n2 = self.seen[a], self.seen[b]
            if not n1 or not n2 or a == b:
                continue
            if self._differ(self.ends[a], n1, self.ends[b], n2, alpha):
                return False
            for symbol in self.steps[a].keys() | self.steps[b].keys():
                s, t = self.steps[a].get(symbol), self.steps[b].get(symbol)
                if self._differ(s[1] if s else 0, n1, t[1] if t else 0, n2, alpha):
                    return False
                if s and t:
                    waiting.append((s[0], t[0]))
        return True

    def apart(self, a: int, b: int) -> float:
        """How much the next steps of two states differ."""
        share = lambda q, symbol: self.steps[q][symbol][1] / self.seen[q] if symbol in self.steps[q] else 0.0
        ends = abs(self.ends[a] / self.seen[a] - self.ends[b] / self.seen[b])
        return ends + sum(abs(share(a, s) - share(b, s)) for s in self.steps[a].keys() | self.steps[b].keys())

    def fold(self, into: int, tree: int) -> None:
        """Add the counts of the tree below ``tree`` to the states from ``into`` on."""
        waiting = [(into, tree)]
        while waiting:
            a, b = waiting.pop()
            self.ends[a] += self.ends[b]
            self.seen[a] += self.seen[b]
            for symbol, (to, count) in self.steps[b].items():
                step = self.steps[a].get(symbol)
                if step is None:
                    self.steps[a][symbol] = [to, count]
                else:
                    step[1] += count
                    waiting.append((step[0], to))

    def infer(self, alpha: float) -> None:
        """Merge: settled states stay, each state they lead to is merged into the nearest that it is compatible
        with or settled: a state with little evidence is compatible with many."""
        settled, frontier = [0], [(0, s) for s in self.steps[0]]
        while frontier:
            # the best supported state first, so that merges rest on the most evidence
            frontier.sort(key=lambda e: self.steps[e[0]][e[1]][1])
            source, symbol = frontier.pop()
            state = self.steps[source][symbol][0]
            if state in settled:
                continue
            home = min((q for q in settled if q and self.compatible(q, state, alpha)), key=lambda q: self.apart(q, state), default=None)
            if home is None:
                settled.append(state)
            else:
                self.steps[source][symbol][0] = home
                self.fold(home, state)
            held = set(settled)
            frontier = [(q, s) for q in settled for s, (to, _) in self.steps[q].items() if to not in held]

    def log_likelihood(self, word: list[str]) -> float:
        """Natural logarithm of the word's probability, the end included. A symbol that a state has never seen is
        a share ``RARE`` of what it is in all words."""
        state, total, all_kinds = 0, 0.0, sum(self.kinds.values())
        for symbol in word:
            step = self.steps[state].get(symbol)
            if step is None:
                total += math.log(max(UNSEEN, RARE * self.kinds[symbol] / all_kinds) if all_kinds else UNSEEN)
            else:
                total += math.log(step[1] / self.seen[state])
                state = step[0]
        return total + math.log(max(self.ends[state] / max(1, self.seen[state]), UNSEEN))


def by_last_symbol(words: list[list[str]], mixed: float = 0.1) -> Automaton:
    """The automaton whose states are the symbols that lead to them. Each state also has, for a share ``mixed`` of what it
    has seen, the symbols of all words together: what never followed a symbol is unlikely there, not impossible."""
    kinds = Counter(symbol for word in words for symbol in word)
    at = {symbol: i + 1 for i, symbol in enumerate(kinds)}
    follow: list[Counter[str]] = [Counter() for _ in range(len(at) + 1)]
    out, total = Automaton(), sum(kinds.values())
    out.ends = [0] * len(follow)
    for word in words:
        for before, symbol in zip([None, *word[:-1]], word, strict=True):
            follow[at.get(before, 0)][symbol] += 1
        out.ends[at[word[-1]] if word else 0] += 1
    seen = [sum(own.values()) + end for own, end in zip(follow, out.ends, strict=True)]
    out.steps = [{k: [at[k], own[k] + 1 + round(mixed * n * kinds[k] / total)] for k in kinds} for own, n in zip(follow, seen, strict=True)]
    out.seen = [sum(step[1] for step in steps.values()) + end for steps, end in zip(out.steps, out.ends, strict=True)]
    return out


@cache
def ordinary_automaton() -> Automaton:
    return by_last_symbol([[_kind(c) for c in name] for name in ordinary_names()])


class Lengths:
    """How likely a length is for what begins like some labels: their own lengths, each spread a little."""

    def __init__(self, values: list[str]) -> None:
        self.of: dict[str, Counter[int]] = {}
        for v in values:
            self.of.setdefault(v[:LITERAL], Counter())[len(v)] += 1

    def log_likelihood(self, value: str) -> float:
        own = self.of.get(value[:LITERAL])
        if not own:
            return math.log(UNSEEN)
        total = sum(own.values())
        mean = sum(k * n for k, n in own.items()) / total
        spread = max(SPREAD, math.sqrt(sum(n * (k - mean) ** 2 for k, n in own.items()) / total))
        r = spread / (1 + spread)
        far = math.log((1 - r) / (1 + r)) + min(abs(len(value) - k) for k in own) * math.log(r)
        if far < -600:  # below what a float holds
            return far
        return math.log(sum(n / total * (1 - r) / (1 + r) * r ** abs(len(value) - k) for k, n in own.items()))


class FormatModel:
    """An automaton, the lengths of labels, the score from which a candidate fits, and the lengths of the shortest
    candidate and the longest label."""

    def __init__(self, automaton: Automaton, lengths: Lengths, threshold: float, shortest: int, longest: int) -> None:
        self.automaton, self.lengths, self.threshold, self.shortest, self.longest = automaton, lengths, threshold, shortest, longest
        self.candidate = re.compile(rb"[A-Za-z0-9_+/=-]{%d,}" % shortest)
        self.known = {symbol for steps in automaton.steps for symbol in steps}

    def score(self, value: str) -> float:
        """Logarithm of the likelihood ratio of credential and ordinary name, by character."""
        own = self.automaton.log_likelihood(symbols(value)) + self.lengths.log_likelihood(value)
        return (own - ordinary_automaton().log_likelihood([_kind(c) for c in value])) / (len(value) + 1)

    def fits(self, value: str) -> bool:
        return self.score(value) >= self.threshold

    def begins(self, value: str) -> bool:
        """Whether the automaton has steps for all literal symbols."""
        state = 0
        for symbol in value[:LITERAL]:
            step = self.automaton.steps[state].get(symbol)
            if step is None:
                return False
            state = step[0]
        return True

    def longest_fit(self, value: str) -> int:
        """Length of the longest candidate at the start of ``value`` that fits and ends where letters
        and digits do, 0 if none; sought up to four times the longest label, and up to a separator
        that no label holds."""
        value = value[: 4 * self.longest + 1]
        value = value[: next((i for i, c in enumerate(value) if not c.isalnum() and c not in self.known), len(value))]
        ends = [i for i in range(len(value), self.shortest - 1, -1) if i == len(value) or not value[i].isalnum()]
        return next((i for i in ends if i <= 4 * self.longest and self.fits(value[:i])), 0)


def split(labelled: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """Values to learn from and held-out ones: one of every few rows of each kind."""
    rank: Counter[str] = Counter()
    out: tuple[list[str], list[str]] = ([], [])
    for kind, value in labelled:
        out[rank[kind] % round(1 / HELD_OUT) == 0].append(value)
        rank[kind] += 1
    return out


def learn(labelled: list[tuple[str, str]], alpha: float = ALPHA) -> FormatModel:
    """An automaton from at most ``LABELLED`` credentials; the held-out ones set the threshold so that all but a share of
    ``MISSED`` pass with ``SLACK`` to spare, but none fits that is likelier as an ordinary name. Without labels nothing fits."""
    labelled = [(k, v) for k, v in labelled[:LABELLED] if v]
    seen, held = split(labelled)
    automaton = Automaton()
    for value in seen:
        automaton.add(symbols(value))
    automaton.infer(alpha)
    sizes = [len(v) for _, v in labelled] or [2]
    model = FormatModel(automaton, Lengths(seen), 0.0, max(1, int(min(sizes) * SHORTEST)), max(sizes))
    scores = sorted(model.score(v) for v in held)
    model.threshold = max(0.0, scores[int(len(scores) * MISSED)] - SLACK) if scores else math.inf
    return model


def labelled_rows(table: DataFrame, kind_col: str = "kind", value_col: str = "value", n: int = LABELLED) -> list[tuple[str, str]]:
    """At most ``n`` labelled credentials ``(kind, value)`` of a table, for :func:`learn`: of each kind, in turn,
    those of the least hashes. Null kinds are one kind; null and empty values are left out."""
    rows = table.select(F.coalesce(F.col(kind_col).cast("string"), F.lit("")).alias("kind"), F.col(value_col).cast("string").alias("value"))
    rows = rows.where("length(value) > 0").distinct()
    nth = F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value"))
    first = rows.withColumn("nth", nth).where(F.col("nth") <= n).orderBy("nth", "kind").limit(n)
    return [(r["kind"], r["value"]) for r in first.collect()]


@cache
def default_model() -> FormatModel:
    return learn(labelled_credentials())


def base_spans(raw: bytes) -> list[Span]:
    found: list[Span] = []
    low = raw.lower()
    if any(w in low for w in _WORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(low) if m.end(1) - m.start(1) >= 6]
    if b"AKIA" in raw:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(raw)]
    return found + [("hex", m.start(), m.end()) for m in _HEX.finditer(raw)]


def parts(raw: bytes, start: int, end: int, model: FormatModel) -> list[tuple[int, int]]:
    """Parts of a run that fit, from left to right without overlap: a name, an address or a path may
    stand before a credential, and more behind it."""
    found, free, run = [], start, raw[start:end].decode()
    for m in _START.finditer(raw, start, end - model.shortest + 1):
        at = m.start()
        if at >= free and model.begins(run[at - start : at - start + LITERAL]):
            size = model.longest_fit(run[at - start : at - start + 4 * model.longest + 1])
            if size:
                free = at + size
                found.append((at, free))
    return found


def find(raw: bytes | None, model: FormatModel) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, in code points, ordered by start and kind."""
    raw = raw or b""
    base = ordered(base_spans(raw), KINDS)
    added: list[Span] = []
    taken = Covered(base)
    for m in model.candidate.finditer(raw):
        own = [("format", a, b) for a, b in parts(raw, m.start(), m.end(), model) if not taken.meets(a, b)]
        if not own and not taken.meets(m.start(), m.end()) and model.fits(m[0].decode()):
            own = [("format", m.start(), m.end())]
        added += own
    return code_points(raw, base), code_points(raw, ordered(base + added, KINDS))


def _run(model: FormatModel, batch: pa.RecordBatch) -> pa.RecordBatch:
    counts, digests, spans = [[] for _ in BASE], [], []
    for raw in batch.column(1).to_pylist():
        base, every = find(raw, model)
        for column, kind in zip(counts, BASE, strict=True):
            column.append(sum(s[0] == kind for s in base))
        digests.append(digest(base))
        spans.append(joined(every))
    columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: FormatModel | None = None) -> DataFrame:
    """``(id_col, n_assign, n_access, n_hex, base_sha256, spans)``, one row per input row.

    The base kinds are found by pattern; kind ``format`` by the automaton's likelihood, outside
    base spans: the parts of a run of credential characters that fit, else the whole run if it does. Runs shorter
    than ``SHORTEST`` of the shortest label are not scored, and parts are sought up to four times the longest
    label: with labels of fixed lengths, the likelihood of a length falls off so fast that nothing there fits.
    One pass without a shuffle over whole texts. Null texts count as empty; ids may be null or
    repeat; other columns are not read, whatever their names; a run of equal characters of any
    length is one candidate; an empty table gives an empty table.
    """
    require(docs, id_col, text_col)
    source = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("raw"))
    kind = docs.schema[id_col].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in BASE)
    out = map_arrow(source, partial(_run, model or default_model()), f"id {kind}, {counts}, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)
