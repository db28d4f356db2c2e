"""Tokenisation and text functions, as Column expressions and, for query strings, in Python.

A token is a run of letters, digits, marks, hyphens, apostrophes and underscores. It is
normalised (NFKD, diacritics dropped, lower case), trimmed of joiners, and yields variants:
the whole form, its parts at joiners, and on request its camel-case parts. All of it runs
in the JVM; only driver-side query strings use the Python twin, which tests hold against it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a token, its joiners and its camel-case parts are, and how long it may be.
TOKEN = r"[\p{L}\p{N}\p{M}_'’-]+"
WORD_CHAR = r"[\p{L}\p{N}]"
JOINERS = r"[-'’_]+"
EDGES = r"^[-'’_]+|[-'’_]+$"
CAMEL = r"\p{Lu}+(?!\p{Ll})|\p{Lu}\p{Ll}*|\p{Ll}+|\p{N}+"
LONGEST = 64


@cache
def diacritics() -> str:
    """Characters of the Unicode property Diacritic, which Java lacks, read from ICU."""
    jvm = SparkSession.active().sparkContext._jvm
    held = jvm.com.ibm.icu.text.UnicodeSet("[:Diacritic:]")
    spans = [(held.getRangeStart(i), held.getRangeEnd(i)) for i in range(held.getRangeCount())]
    return "".join(chr(c) for a, b in spans for c in range(a, b + 1))


def normalize(raw: Column) -> Column:
    """NFKD, without diacritics, in lower case; ASCII takes the short way."""
    apart = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), F.coalesce(raw, F.lit("")), F.lit(True))
    return F.when(raw.rlike(r"^[\x00-\x5D\x5F\x61-\x7F]*$"), F.lower(raw)).otherwise(F.lower(F.translate(apart, diacritics(), "")))


def trim_joiners(col: Column) -> Column:
    return F.regexp_replace(col, EDGES, "")


def base_form(raw: Column) -> Column:
    return trim_joiners(normalize(raw))


def raw_tokens(text: Column) -> Column:
    """Tokens of at most 64 characters that hold a letter or digit, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0)
    return F.filter(found, lambda t: (F.length(t) <= LONGEST) & t.rlike(WORD_CHAR))


def _camel_parts(raw: Column, base: Column) -> Column:
    parts = F.transform(F.regexp_extract_all(raw, F.lit(CAMEL), 0), base_form)
    mixed = (F.lower(raw) != raw) & (F.upper(raw) != raw)
    return F.when(mixed, F.filter(parts, lambda p: (p != "") & (p != base))).otherwise(F.array().cast("array<string>"))


def variants_of_base(raw: Column, base: Column, camel: bool = False) -> Column:
    none = F.array().cast("array<string>")
    parts = F.when(base.rlike(JOINERS), F.filter(F.split(base, JOINERS), lambda p: p != "")).otherwise(none)
    whole = F.concat(F.array(base), parts)
    return F.when(base == "", none).otherwise(F.concat(whole, _camel_parts(raw, base)) if camel else whole)


def variants(raw: Column, camel: bool = False) -> Column:
    """Forms of one token, the whole one first; empty if nothing is left of it."""
    return variants_of_base(raw, base_form(raw), camel)


def _bases(raws: Column) -> Column:
    """Normal forms of an array of tokens, untrimmed, one for each. They are normalised as one
    string with line breaks between, which no token holds and no form grows, loses or crosses."""
    return F.split(normalize(F.array_join(raws, "\n")), "\n")


def _joined_forms(raw: Column, base: Column, camel: bool) -> Column:
    """Variants of a token whose untrimmed normal form is ``base``; most hold no joiner and are one."""
    plain = F.when(base == "", F.array().cast("array<string>")).otherwise(F.array(base))
    full = variants_of_base(raw, trim_joiners(base), camel)
    return full if camel else F.when(base.rlike(JOINERS), full).otherwise(plain)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is named there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokenize(text: Column, camel: bool = False) -> Column:
    """Distinct variants of all tokens in order of first sight. The distinct tokens of a text are
    taken once and normalised at once; where no form holds a joiner, the forms are the variants."""

    def spelled(raws: Column, joined: Column) -> Column:
        forms = F.zip_with(raws, F.split(joined, "\n"), lambda raw, base: F.when(raw.isNotNull(), _joined_forms(raw, base, camel)))
        every = F.array_join(F.flatten(F.filter(forms, lambda f: f.isNotNull())), "\n")
        return every if camel else F.when(joined.rlike(JOINERS[:-1]), every).otherwise(joined)

    joined = let(F.array_distinct(raw_tokens(text)), lambda raws: let(F.array_join(raws, "\n"), lambda s: let(normalize(s), lambda low: spelled(raws, low))))
    return F.array_distinct(F.array_remove(F.split(joined, "\n"), ""))


def may_hold(raw: Column, words: list[str]) -> Column:
    """Whether a form of the token may be, or begin with, one of the (normalised) words; cheap, and
    true for every token that is not plain ASCII."""
    low, out = F.lower(raw), raw.rlike(r"[^\x00-\x7F]")
    for w in words:
        out = out | low.contains(w)
    return out


def running_sums(values: Column) -> Column:
    """Sums of an array of whole numbers up to each of them. Chunks are summed first, of about the cube root of the
    array's size: an array only grows by being copied, and short ones are copied cheaply."""
    none = F.struct(F.array().cast("array<int>").alias("sums"), F.lit(0).alias("at"))

    def add(acc: Column, x: Column) -> Column:
        return F.struct(F.concat(acc["sums"], F.array(acc["at"] + x)).alias("sums"), (acc["at"] + x).alias("at"))

    def short(v: Column) -> Column:
        return F.aggregate(v, none, add, lambda acc: acc["sums"])

    def whole(v: Column) -> Column:
        step = F.greatest(F.lit(16), F.ceil(F.cbrt(F.size(v))).cast("int"))
        chunks = F.transform(F.sequence(F.lit(1), F.size(v), step), lambda at: short(F.slice(v, at, step)))
        last = lambda c: F.element_at(c, -1)
        joined = let(chunks, lambda cs: F.flatten(F.zip_with(cs, short(F.transform(cs, last)), lambda c, upto: F.transform(c, lambda x: x + upto - last(c)))))
        return F.when(F.size(v) > 0, joined).otherwise(F.array().cast("array<int>"))

    return let(values, whole)


def holding(words: list[str]) -> str:
    """Pattern of the tokens that :func:`may_hold` one of the words."""
    inside = TOKEN[1:-2]
    ascii_ = [w.replace("-", r"\-") for w in words if w.isascii()]
    some = "|".join([rf"[[{inside}]&&[^\x00-\x7F]]", *([f"(?i:{'|'.join(ascii_)})"] if ascii_ else [])])
    return rf"(?<![{inside}])(?=[{inside}]*?(?:{some}))[{inside}]+"


def _quoted(words: list[str]) -> list[str]:
    """Those of the words that a token of ASCII can hold, as patterns."""
    return [w.replace("-", r"\-") for w in words if regex.fullmatch(r"[a-z0-9_'-]+", w)]


_ASCII, _INSIDE, _PART = "[A-Za-z0-9_'-]", TOKEN[1:-2], r"\p{L}\p{N}\p{M}"
#: What lies between two tokens of ASCII that count.
_BETWEEN = rf"[^{_INSIDE}]++(?:(?:[-'_]++|{_ASCII}{{{LONGEST + 1},}}+)(?![{_INSIDE}])[^{_INSIDE}]++)*+"


def _spelled(word: str) -> str:
    """Pattern of a token of ASCII of which ``word`` is the whole form or, without joiners, a part."""
    before, after = ("[-'_]*+", "[-'_]*+") if regex.search(JOINERS, word) else (rf"(?:[A-Za-z0-9]*+[-'_]++){{0,{LONGEST}}}?", f"(?:[-'_]{_ASCII}*+)?")
    return f"{before}(?i:{_quoted([word])[0]}){after}(?![{_INSIDE}])"


def _perhaps(words: list[str]) -> str:
    """Pattern of a token of which some part between joiners may be the first part of a word: each of its letters stands there, or
    a character that is not ASCII, for that may spell any letters or none, but no joiner."""
    other = rf"[[{_PART}]&&[^\x00-\x7F]]*+"
    parts = ["".join(f"(?i:{c})?+{other}" for c in regex.split(JOINERS, w)[0] if c.isascii() and c.isalnum()) for w in words]
    return rf"(?:[{_PART}]*+{JOINERS}+){{0,{LONGEST}}}?{other}(?:{'|'.join(parts)})(?:{JOINERS[:-1]}|(?![{_INSIDE}]))"


def in_ascii(words: list[str]) -> list[str]:
    """Patterns of the texts where tokens of ASCII with the words among their forms, camel-case parts aside, follow each other; a
    text must fit both, and few fit the first, quick one alone. None if tokens of ASCII cannot hold the words."""
    if len(_quoted(words)) < len(words):
        return []
    each = [f"(?={_spelled(w)})(?={_ASCII}{{1,{LONGEST}}}+(?![{_INSIDE}])){_ASCII}++" for w in words]
    return [_BETWEEN.join([f"(?i:{_quoted(words)[0]})(?:[-'_]{_ASCII}*+)?+(?![{_INSIDE}])", *each[1:]]), f"(?<![{_INSIDE}])" + _BETWEEN.join(each)]


def chains_of(words: list[str], camel: bool = False) -> str:
    """Pattern of the longest chains of as many tokens as words or more of which each may hold one of the words or may not
    count. Loops are possessive: others take a call of the stack a turn."""
    loose = "|".join([rf"[[{_INSIDE}]&&[^\x00-\x7F]]", *_quoted(words)])
    some = rf"[{_INSIDE}]*?(?i:{loose})|[-'_]++(?![{_INSIDE}])" if camel else _perhaps(words)
    one = rf"(?:(?={some})[{_INSIDE}]++|[{_INSIDE}]{{{LONGEST + 1},}}+)"
    return rf"(?<![{_INSIDE}]){one}(?:[^{_INSIDE}]++{one}){{{len(words) - 1},}}+"


#: A token of ASCII that counts, in a gap between others.
PASSED = rf"(?<![A-Za-z0-9_'-])(?=[_'-]*[A-Za-z0-9])[A-Za-z0-9_'-]{{1,{LONGEST}}}(?![A-Za-z0-9_'-])"
SPAN = "pos", "start", "length", "line", "variants"


def spans_of(text: Column, camel: bool = False, words: list[str] | None = None, lines: bool = False) -> Column:
    """The tokens of a text in order: an array of ``SPAN``, its number, its place in the original text in code points, its
    zero-based line (with ``lines``) and its variants. With ``words``, those that may hold one of them.

    Starts and lines are running sums over tokens and the gaps between them. All of it happens within a row: no
    token is shuffled or sorted, and a task holds one text at a time. Tokens that hold none of the words are left to the
    gaps: numbers of tokens that follow each other differ by one, those with others between them by more."""
    zipped, none = "array<struct<tk:string,till:int,line:int,bs:string,nth:int>>", F.array().cast("array<int>")
    pattern = TOKEN if words is None else holding(words)

    def kept(tk: Column, base: Column) -> Column:
        # a letter or digit of ASCII is never lost on the way to a form
        held = tk.rlike("[A-Za-z0-9]") | (tk.rlike(WORD_CHAR) & (trim_joiners(base) != ""))
        return (F.length(tk) <= LONGEST) & held

    def step(tk: Column, gap: Column) -> Column:
        return F.when(kept(tk, normalize(tk)), 1).otherwise(0) + F.when(gap.rlike(PASSED), 1).otherwise(0)

    def placed(tk: Column, gp: Column) -> Column:
        till = running_sums(F.zip_with(tk, gp, lambda t, g: F.length(t) + F.length(g)))
        breaks = F.transform(gp, lambda g: F.length(g) - F.length(F.replace(g, F.lit("\n"), F.lit(""))))
        bases = _bases(tk) if words is None else F.transform(tk, normalize)
        nth = none if words is None else running_sums(F.zip_with(tk, gp, step))
        return F.arrays_zip(tk, till, running_sums(breaks) if lines else none, bases, nth).cast(zipped)

    def span(z: Column, i: Column) -> Column:
        whole, size = _joined_forms(z["tk"], z["bs"], camel), F.length(z["tk"])
        shown = whole if words is None else F.when(may_hold(z["tk"], words), whole)
        return F.struct(*[c.alias(n) for n, c in zip(SPAN, (i if words is None else z["nth"], z["till"] - size, size, z["line"], shown), strict=True)])

    def cut(t: Column) -> Column:
        tokens = F.regexp_extract_all(t, F.lit(pattern), 0)
        return let(tokens, lambda tk: F.when(F.size(tk) > 0, placed(tk, F.slice(F.split(t, pattern, -1), 1, F.size(tk)))).otherwise(F.array().cast(zipped)))

    return F.transform(F.filter(let(F.coalesce(text, F.lit("")), cut), lambda z: kept(z["tk"], z["bs"])), span)


def span_rows(df: DataFrame, key: str, text: str, camel: bool = False, words: list[str] | None = None, lines: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(key, spans)`` and the columns of ``keep``: one row a document."""
    return df.select(key, *keep, spans_of(F.col(text), camel, words, lines).alias("spans"))


def token_spans(df: DataFrame, key: str, text: str, camel: bool = False, words: list[str] | None = None, lines: bool = True) -> DataFrame:
    """The same as rows ``(key, pos, start, length, line, variants)``, one a token."""
    rows = df.select(key, F.explode(spans_of(F.col(text), camel, words, lines)).alias("s"))
    return rows.select(key, *[F.col("s")[n].alias(n) for n in SPAN])


def frontmatter_end(content: Column) -> Column:
    """Length of the leading ``---`` block with its line break; 0 without one."""
    return F.length(F.regexp_extract(F.coalesce(content, F.lit("")), r"\A---\r?\n[\s\S]*?\r?\n---(?:\r?\n|\z)", 0))


def line_of_offset(content: Column, offset: Column) -> Column:
    """Zero-based line of a code-point offset; a line break belongs to the line it ends."""
    head = F.substring(content, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))


def lf(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def extension(path: Column) -> Column:
    """What follows the last dot of the lower-cased path; without a dot, the whole path."""
    return F.element_at(F.split(F.lower(path), r"\."), -1)


def file_type(path: Column) -> Column:
    """Coarse type of a file, for labels and icons."""
    ext = extension(path)
    return F.when(ext == "canvas", "canvas").when(ext == "pdf", "pdf").when(ext.isin("png", "jpg", "jpeg", "webp", "gif", "bmp"), "image").when(ext.isin("docx", "xlsx"), "office").otherwise("text")


def edit_distance(a: Column, b: Column, limit: int | None = None) -> Column:
    return F.levenshtein(a, b) if limit is None else F.levenshtein(a, b, limit)


def term_matches(term: Column, wanted: Column, fuzziness: float = 0.1, min_fuzzy: int = 4) -> Column:
    """Equal, a longer form, or within ``floor(fuzziness * length)`` edits."""
    budget = F.floor(F.lit(fuzziness) * F.length(wanted))
    near = (F.length(wanted) >= min_fuzzy) & (budget > 0) & (F.abs(F.length(term) - F.length(wanted)) <= budget) & (F.levenshtein(term, wanted) <= budget)
    return (term == wanted) | term.startswith(wanted) | near


def significant_terms(terms: Column) -> Column:
    """Terms of three characters or more, or all of them if there is none."""
    long = F.filter(terms, lambda t: F.length(t) >= 3)
    return F.when(F.size(long) > 0, long).otherwise(terms)


def significant_for_query(terms: Column, query_terms: Column, fuzziness: float = 0.1, min_fuzzy: int = 4) -> Column:
    """Matched terms that answer a significant query term; all of them if every one is significant."""
    wanted = significant_terms(query_terms)
    answer = F.filter(terms, lambda t: F.exists(wanted, lambda q: term_matches(t, q, fuzziness, min_fuzzy)))
    return F.when(F.size(wanted) == F.size(query_terms), terms).otherwise(answer)


# The same for query strings, on the driver.

_TOKEN, _WORD, _CAMEL = regex.compile(TOKEN), regex.compile(WORD_CHAR), regex.compile(CAMEL)
_DIACRITIC, _JOINERS = regex.compile(r"\p{Diacritic}"), regex.compile(JOINERS)


def py_base(raw: str) -> str:
    return _DIACRITIC.sub("", unicodedata.normalize("NFKD", raw)).lower().strip("-'’_")


def py_variants(raw: str, camel: bool = False) -> list[str]:
    base = py_base(raw)
    if not base:
        return []
    out = [base]
    if _JOINERS.search(base):
        out += [p for p in _JOINERS.split(base) if p]
    if camel and raw.lower() != raw and raw.upper() != raw:
        out += [p for p in map(py_base, _CAMEL.findall(raw)) if p and p != base]
    return out


def py_tokens(text: str) -> list[str]:
    return [t for t in _TOKEN.findall(text) if len(t) <= LONGEST and _WORD.search(t)]


def py_tokenize(text: str, camel: bool = False) -> list[str]:
    return list(dict.fromkeys(v for t in py_tokens(text) for v in py_variants(t, camel)))


def phrase_sequence(phrase: str) -> list[str]:
    """Whole forms of a phrase's tokens, without their parts."""
    return [v[0] for t in py_tokens(phrase) if (v := py_variants(t))]


def py_significant(terms: list[str]) -> list[str]:
    return [t for t in terms if len(t) >= 3] or terms
