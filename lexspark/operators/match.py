"""Matching inside documents: phrases, term places, excerpts, highlights, lines.

Everything works on the spans of a document as one array in its row, so that no token is shuffled or sorted, whether the
documents are those of a result page or all of a collection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chains_of, frontmatter_end, in_ascii, let, lf, line_of_offset, normalize, phrase_sequence, py_significant, py_tokenize, running_sums, span_rows, spans_of
from ..functions.text import extension as extension_of

RADIUS, WINDOW = 120, 240
TEXT_LIKE = ("md", "txt", "canvas")


def _held(spans: DataFrame, key: str) -> DataFrame:
    """One row a document with its ``spans`` in order: as they come from :func:`span_rows`, or put together from rows."""
    if "spans" in spans.columns:
        return spans
    rest = [c for c in spans.columns if c not in (key, "pos")]
    return spans.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", *rest))).alias("spans"))


def _fits_at(spans: Column, i: Column, fits: list) -> Column:
    """Whether spans that follow each other from number ``i`` on satisfy ``fits``."""
    ok, first = F.lit(bool(fits)), F.get(spans, i)["pos"]
    for j, fit in enumerate(fits):
        at = F.get(spans, i + j)
        ok = ok & F.coalesce((at["pos"] - first == j) & fit(at["variants"]), F.lit(False))
    return ok


def _runs_of(spans: Column, fits: list) -> Column:
    """Array of ``(start, length, line)`` where consecutive spans satisfy ``fits``."""

    def run(all_: Column, s: Column, i: Column) -> Column:
        end = F.get(all_, i + (len(fits) - 1))
        place = F.struct(s["start"].alias("start"), (end["start"] + end["length"] - s["start"]).alias("length"), s["line"].alias("line"))
        return F.when(_fits_at(all_, i, fits), place)

    return let(spans, lambda all_: F.filter(F.transform(all_, lambda s, i: run(all_, s, i)), lambda r: r.isNotNull()))


def _upto(found: Column, most: int | None) -> Column:
    return found if most is None else F.slice(found, 1, most)


def _places(spans: DataFrame, key: str, fits: list, most: int | None) -> DataFrame:
    """Rows ``(key, start, length)`` of the first ``most`` runs of each document."""
    rows = _held(spans, key).select(key, F.explode(_upto(_runs_of(F.col("spans"), fits), most)).alias("r"))
    return rows.select(key, "r.start", "r.length")


def _whole_fits(wanted: list[str]) -> list:
    return [lambda v, w=w: F.array_contains(v, w) for w in wanted]


def phrase_offsets(spans: DataFrame, phrase: str, key: str = "path", most: int | None = 100) -> DataFrame:
    """``(key, start, length)`` where the phrase's whole forms stand in a row."""
    wanted = phrase_sequence(phrase)
    if not wanted:
        return spans.select(key, F.lit(0).alias("start"), F.lit(0).alias("length")).limit(0)
    return _places(spans, key, _whole_fits(wanted), most)


def _near_fits(wanted: list[str]) -> list:
    """Tests for a near phrase of two tokens or more: a token of three characters or more, and the
    last one, may also be the beginning of a form."""

    def fit(word: str, last: bool):
        if len(word) >= 3 or last:
            return lambda v: F.exists(v, lambda x: x.startswith(word))
        return lambda v: F.array_contains(v, word)

    return [fit(w, i == len(wanted) - 1) for i, w in enumerate(wanted)] if len(wanted) > 1 else []


def approx_phrase_offsets(spans: DataFrame, phrase: str, key: str = "path", most: int | None = 3) -> DataFrame:
    """Like :func:`phrase_offsets` for two tokens or more, where most may be beginnings of words."""
    fits = _near_fits(phrase_sequence(phrase))
    if not fits:
        return spans.select(key, F.lit(0).alias("start"), F.lit(0).alias("length")).limit(0)
    return _places(spans, key, fits, most)


def holds_phrase(text: Column, words: list[str], camel: bool = False) -> Column:
    """Whether the text holds the whole forms ``words`` in a row; false without text or words. Where tokens of ASCII spell them, one
    pattern tells; of other texts only chains of tokens that may hold a word, or may not count, are cut into spans."""
    if not words:
        return F.lit(False)
    whole, other = F.coalesce(text, F.lit("")), r"[^\x00-\x7F]"

    def held(chain: Column) -> Column:
        spelled = let(normalize(chain), lambda low: reduce(Column.__and__, [low.contains(w) for w in words]))
        return (F.lit(True) if camel else chain.rlike(other)) & spelled & (F.size(_runs_of(spans_of(chain, camel, words), _whole_fits(words))) > 0)

    chains = F.exists(F.regexp_extract_all(whole, F.lit(chains_of(words, camel)), 0), held)
    plain = [whole.rlike(p) for p in in_ascii(words)] or [F.lit(False)]
    return F.when(reduce(Column.__and__, plain), True).otherwise(chains if camel else whole.rlike(other) & chains)


def contains_phrase(docs: DataFrame, phrase: str, key: str = "path", text: str = "content", camel: bool = False) -> DataFrame:
    """Keys of documents whose text holds the phrase."""
    return docs.where(holds_phrase(F.col(text), phrase_sequence(phrase), camel)).select(key).distinct()


def refine(hits: DataFrame, docs: DataFrame, phrases: list[str], excluded: list[str], camel: bool = False, text_like: tuple[str, ...] | None = None, page: bool = False) -> DataFrame:
    """Hits whose text holds every phrase and no excluded one; without phrases all hits, and no text
    is read. With ``text_like``, files of other kinds pass unverified. Texts are read once and tested where they are read, and
    paths alone meet the hits. ``page``: the hits are few, and only their texts are tested."""
    if not phrases and not excluded:
        return hits
    of_kind = lambda df: df.where(extension_of(F.col("path")).isin(*text_like)) if text_like else df
    texts = of_kind(docs.select("path", "content"))
    if page:
        texts = texts.join(F.broadcast(hits.select("path")), "path", "left_semi")  # as many as the page has
    holds = lambda p: holds_phrase(F.col("content"), phrase_sequence(p), camel)
    some = reduce(Column.__or__, [holds(p) for p in excluded], F.lit(False))
    if phrases:
        out = of_kind(hits).join(texts.where(reduce(Column.__and__, [*[holds(p) for p in phrases], ~some])).select("path"), "path", "left_semi")
    else:
        out = of_kind(hits).join(texts.where(some).select("path"), "path", "left_anti")
    return out.unionByName(hits.where(~extension_of(F.col("path")).isin(*text_like))) if text_like else out


def matched_term(variants: Column, terms: Column) -> Column:
    """The first form's first term that it equals, or else begins with (two characters or more)."""
    starts = F.filter(terms, lambda t: F.length(t) >= 2)
    hit = F.transform(variants, lambda v: F.when(F.array_contains(terms, v), v).otherwise(F.get(F.filter(starts, lambda p: v.startswith(p)), F.lit(0))))
    return F.get(F.filter(hit, lambda t: t.isNotNull()), F.lit(0))


def _terms_of(spans: Column, wanted: Column) -> Column:
    """Array of ``(start, length, term, line)`` of the spans that match a term; ``length`` is that of the matched beginning
    of a whole form, else of the whole token."""

    def place(s: Column) -> Column:
        term = F.when(s["variants"].isNotNull(), matched_term(s["variants"], wanted))

        def shown(t: Column) -> Column:
            begins = F.get(s["variants"], F.lit(0)).startswith(t)
            size = F.when(begins, F.least(s["length"], F.length(t))).otherwise(s["length"])
            return F.struct(s["start"].alias("start"), size.alias("length"), t.alias("term"), s["line"].alias("line"))

        return let(term, shown)

    return F.filter(F.transform(F.filter(spans, lambda s: s["variants"].isNotNull()), place), lambda m: m["term"].isNotNull())


def _wanted(terms: list[str] | Column) -> Column:
    return terms if isinstance(terms, Column) else F.array(*[F.lit(t) for t in terms]).cast("array<string>")


def term_offsets(spans: DataFrame, terms: list[str] | Column, key: str = "path", most: int | None = None) -> DataFrame:
    """``(key, start, length, term)`` of the spans that match a term, or of the first ``most`` of each document; ``terms`` may be a column of what
    :func:`span_rows` keeps beside them."""
    rows = _held(spans, key).select(key, F.explode(_upto(_terms_of(F.col("spans"), _wanted(terms)), most)).alias("m"))
    return rows.select(key, "m.start", "m.length", "m.term")


def best_window(matches: DataFrame, key: str = "path", chars: int = WINDOW) -> DataFrame:
    """The matches of each document inside its best stretch of ``chars``: most different terms,
    then most matches, then first. However many a document has, one is held against those of the stretch before it
    alone, and none are put into one row but these."""
    start, before = F.col("start"), Window.partitionBy(key).orderBy("start").rangeBetween(-chars, 0)
    near = F.collect_list(F.struct("start", "term")).over(before)
    inside = F.filter("near", lambda x: x["start"] >= F.least(start, start + F.col("length") - chars))
    terms = F.size(F.array_distinct(F.transform("inside", lambda x: x["term"])))
    # what ends at a match: its score, and where it begins and ends
    stretch = F.struct(terms.alias("d"), F.size("inside").alias("c"), (-start).alias("early"), F.array_min("inside")["start"].alias("from"), start.alias("to"))
    rows = matches.withColumn("near", near).withColumn("inside", inside).select(*matches.columns, stretch.alias("stretch"))
    best = rows.withColumn("best", F.max("stretch").over(Window.partitionBy(key)))
    return best.where(start.between(F.col("best.from"), F.col("best.to"))).select(*matches.columns)


def highlight(text: Column, offsets: Column, base: Column | int = 0, before: str = "<mark>", after: str = "</mark>") -> Column:
    """``text`` with each ``{start, length}`` of the sorted ``offsets`` marked; overlapping ones
    and those outside are skipped, the last is cut at the end."""
    shift = F.lit(base) if isinstance(base, int) else base
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, o: Column) -> Column:
        s = o["start"] - shift
        e = F.least(s + o["length"], F.length(text))
        gap = F.substring(text, acc["at"] + 1, s - acc["at"])
        marked = F.concat(acc["out"], gap, F.lit(before), F.substring(text, s + 1, e - s), F.lit(after))
        skip = (s < acc["at"]) | (s >= F.length(text))
        return F.when(skip, acc).otherwise(F.struct(marked.alias("out"), e.cast("int").alias("at")))

    return F.aggregate(offsets, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def _gather(matches: DataFrame, key: str) -> DataFrame:
    """One row a document: its places in order."""
    one = F.struct(F.col("start").cast("int").alias("start"), F.col("length").cast("int").alias("length"))
    return matches.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("offsets"))


def anchors(docs: DataFrame, query_text: str, terms: list[str] | DataFrame, key: str = "path", text: str = "content", camel: bool = False, body_only: bool = True) -> DataFrame:
    """``(key, offsets)``: the query as a near phrase where it occurs, else the best window of terms:
    the same for all documents, or each document's own of a table ``(key, terms)``."""
    held = docs.select(key, lf(F.col(text)).alias(text))
    own = isinstance(terms, DataFrame)
    keep = (text,)
    if own:
        held, keep = held.join(terms.select(key, "terms"), key, "left"), (text, "terms")
    spans = span_rows(held, key, text, camel, None if own else [*phrase_sequence(query_text), *terms], keep=keep)
    if body_only:
        spans = spans.withColumn("spans", let(frontmatter_end(F.col(text)), lambda body: F.filter("spans", lambda s: s["start"] >= body)))
    near = approx_phrase_offsets(spans, query_text, key, 1)
    wanted = spans.where("terms is not null") if own else spans
    found = best_window(term_offsets(wanted, F.col("terms") if own else terms, key, 500), key).select(key, "start", "length")
    return _gather(near, key).unionByName(_gather(found.join(near.select(key), key, "left_anti"), key))


def highlight_titles(docs: DataFrame, terms: DataFrame, key: str = "path", name: str = "basename", camel: bool = False) -> DataFrame:
    """``(key, title)``: names with the first ten places of each document's own terms marked."""
    spans = span_rows(docs.join(terms.select(key, "terms"), key), key, name, camel, keep=("terms",))
    places = _gather(term_offsets(spans, F.col("terms"), key, 10), key)
    none = F.array().cast("array<struct<start:int,length:int>>")
    return docs.select(key, name).join(places, key, "left").select(key, highlight(F.col(name), F.coalesce("offsets", none)).alias("title"))


def excerpts(docs: DataFrame, query_text: str, terms: list[str] | DataFrame, key: str = "path", text: str = "content", camel: bool = False) -> DataFrame:
    """``(key, excerpt)``: a stretch of text around the anchor, cut at a space, with marks and
    ellipses; without a match, the beginning of the body."""
    held = docs.select(key, lf(F.coalesce(F.col(text), F.lit(""))).alias(text))
    rows = held.join(anchors(docs, query_text, terms, key, text, camel), key, "left").withColumn("first", F.col("offsets")[0])
    size = F.length(text)
    rows = rows.withColumn("cut", F.greatest(F.lit(0), F.col("first.start") - RADIUS))
    space = F.expr(f"locate(' ', {text}, cut + 1) - 1")
    rows = rows.withColumn("space", space)
    snap = (F.col("cut") > 0) & (F.col("space") >= 0) & (F.col("space") < F.col("first.start"))
    rows = rows.withColumn("from", F.when(snap, F.col("space") + 1).otherwise(F.col("cut")))
    rows = rows.withColumn("to", F.least(size, F.col("first.start") + F.col("first.length") + 2 * RADIUS))
    rows = rows.withColumn("window", F.translate(F.substring(F.col(text), F.col("from") + 1, F.col("to") - F.col("from")), "\r\n", "  "))
    seen = F.filter("offsets", lambda o: (o["start"] >= F.col("from")) & (o["start"] < F.col("to")))
    shown = F.concat(F.when(F.col("from") > 0, "…").otherwise(""), highlight(F.col("window"), seen, F.col("from").cast("int")), F.when(F.col("to") < size, "…").otherwise(""))
    plain = F.trim(F.regexp_replace(F.substring(F.col(text), frontmatter_end(F.col(text)) + 1, F.lit(2 * RADIUS)), r"\s+", " "))
    return rows.select(key, F.when(F.col("offsets").isNull(), plain).otherwise(shown).alias("excerpt"))


def jump_targets(docs: DataFrame, query_text: str, terms: list[str] | DataFrame, key: str = "path", text: str = "content", camel: bool = False) -> DataFrame:
    """``(key, start, length, line)`` of the best match of each document, metadata included."""
    found = anchors(docs, query_text, terms, key, text, camel, body_only=False).join(docs.select(key, lf(F.col(text)).alias("__t")), key)
    first = F.col("offsets")[0]
    return found.select(key, first["start"].alias("start"), first["length"].alias("length"), line_of_offset(F.col("__t"), first["start"]).alias("line"))


def search_lines(docs: DataFrame, raw: str, key: str = "path", text: str = "content", camel: bool = False, matches: int = 2000, rows: int = 200) -> DataFrame:
    """In-document search: ``(key, line, line_start, line_text, offsets, distinct_terms, phrase)``, at most ``rows``
    lines of each document: near phrases first, then most different terms, then in order."""
    terms, fits = py_significant(py_tokenize(raw, camel)), _near_fits(phrase_sequence(raw))
    held = docs.select(key, lf(F.coalesce(F.col(text), F.lit(""))).alias("content"))
    spans = span_rows(held, key, "content", camel, [*terms, *phrase_sequence(raw)], lines=True, keep=("content",))

    def ranked_lines(found: Column, near: Column) -> Column:
        """Array of the best lines: where a line's matches begin in ``found``, they stand together."""
        fresh = lambda i: (i == 0) | (F.get(found, i - 1)["line"] != F.get(found, i)["line"])
        heads = F.filter(F.transform(found, lambda m, i: F.when(fresh(i), i)), lambda i: i.isNotNull())

        def line(from_: Column, to: Column) -> Column:
            def scored(places: Column) -> Column:
                distinct, at = F.size(F.array_distinct(F.transform(places, lambda m: m["term"]))), F.get(places, F.lit(0))["line"]
                offsets = F.transform(places, lambda m: F.struct(m["start"].alias("start"), m["length"].alias("length")))
                phrase = F.array_contains(near, at)
                order = F.struct((~phrase).alias("a"), (-distinct).alias("b"), at.alias("line"))
                return F.struct(order.alias("order"), at.alias("line"), offsets.alias("offsets"), distinct.cast("long").alias("distinct_terms"), phrase.alias("phrase"))

            return let(F.slice(found, from_ + 1, to - from_), scored)

        each = let(heads, lambda hs: F.transform(hs, lambda h, j: line(h, F.coalesce(F.get(hs, j + 1), F.size(found)))))
        return F.slice(F.sort_array(each), 1, rows)

    found = _upto(_terms_of(F.col("spans"), _wanted(terms)), matches)
    near = F.transform(_upto(_runs_of(F.col("spans"), fits), 50), lambda r: r["line"]) if fits else F.array().cast("array<int>")
    best = spans.select(key, "content", let(found, lambda f: let(near, lambda n: ranked_lines(f, n))).alias("best"))

    def with_text(texts: Column, upto: Column) -> Column:
        at = lambda line: F.coalesce(F.get(upto, line - 1), F.lit(0))
        return F.transform("best", lambda b: F.struct(at(b["line"]).cast("long").alias("line_start"), F.get(texts, b["line"]).alias("line_text"), b.alias("b")))

    sizes = lambda texts: running_sums(F.transform(texts, lambda t: F.length(t) + 1))
    shown = let(F.split("content", "\n"), lambda texts: let(sizes(texts), lambda upto: with_text(texts, upto)))
    out = best.where(F.size("best") > 0).select(key, F.posexplode(shown).alias("nth", "x"))
    own = [F.col(f"x.b.{c}").alias(c) for c in ("offsets", "distinct_terms", "phrase")]
    return out.select(key, (F.col("nth") + 1).alias("rank"), F.col("x.b.line").alias("line"), "x.line_start", "x.line_text", *own)
