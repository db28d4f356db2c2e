"""Each operator against a brute-force version, with nulls, empty and odd texts, repeated rows,
empty tables and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lexspark.llm import language_id, pii, quality, secrets
from lexspark.llm import line_dedup as line_dedup_module
from lexspark.llm.bpe import BpeCodec, MergeRules, bpe_decode, bpe_encode, bpe_encode_decode, bpe_round_trip, merge_symbols
from lexspark.llm.components import connected_components
from lexspark.llm.decontaminate import benchmark_matches, decontaminate
from lexspark.llm.line_dedup import line_dedup
from lexspark.llm.minhash import CHUNKS, DISTANCE, SLOTS, chunk_keys, near_duplicates
from lexspark.llm.similarity import block_links
from lexspark.llm.substring_dedup import substring_dedup
from lexspark.llm.token_files import read_tokens, token_checksums, write_tokens

WORD_BPE, BYTE_BPE = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))
RND = random.Random(11)
VOCABULARY = ["".join(RND.choices("abcdefghij", k=RND.randint(2, 7))) for _ in range(400)]


def prose(n, rnd=RND):
    return " ".join(rnd.choices(VOCABULARY, k=n))


@pytest.fixture(scope="module")
def texts():
    base, passage = prose(120), prose(30)
    edited = base.split()
    edited[3] = edited[60] = "changed"
    rows = [(0, base), (1, base), (2, " ".join(edited)), (3, None), (4, ""), (5, " \n\t "), (6, "one two"), (7, "ONE  two"), (8, prose(15) + " " + passage), (9, passage + "\n" + prose(10))]
    rows += [(10 + i, prose(40)) for i in range(10)] + [(20, "la " * 50), (21, "naïve 😀 café x " * 8), (6, "one two"), (30, "x" * 40000), (31, prose(3000))]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "src") for i, t in texts], "doc_id long, text string, kept string").repartition(3)


def words(t):
    return (t or "").encode().split()


# --- near duplicates ---


def brute_components(rows, width=4, percent=80):
    sets = {}
    for i, t in rows:
        w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        k = min(width, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (len(sets[i]), label[i], i == label[i]) for i in sets}


def test_near_duplicates(docs, texts):
    out = near_duplicates(docs, width=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == brute_components(texts)
    assert len(out) == len(texts)


def test_pigeonhole_shares_a_key_within_the_distance():
    rnd = np.random.default_rng(5)
    for _ in range(200):
        a = rnd.integers(0, 2**16, SLOTS, dtype=np.uint16)
        b = a.copy()
        b[rnd.choice(SLOTS, DISTANCE, replace=False)] ^= 1
        keys = chunk_keys(np.stack([a, b]))
        assert (keys[0] == keys[1]).any()
    assert DISTANCE // CHUNKS == 1


def test_block_links_match_pairs():
    rnd = np.random.default_rng(6)
    sets = [np.unique(rnd.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    side = np.array([0] * 15 + [1] * 15)
    node = np.arange(30)
    got = set(block_links(side, node, node, sets, 60))
    want = {(i, j) for i in range(15) for j in range(15, 30) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))}
    assert got == want


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (2, 3), (None, 1)], "src long, dst long")
    assert dict(connected_components(links).collect()) == {2: 2, 3: 2, 4: 2, 5: 2, 8: 8, 9: 8}


# --- substring dedup ---


def test_substring_dedup(docs, texts):
    seen, want = {}, {}
    for i, t in sorted(dict(texts).items()):
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone[s : s + 20] = [True] * 20
            seen.setdefault(key, (i, s))
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    out = substring_dedup(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == want and len(out) == len(texts)


# --- secrets and personal data ---

PIECES = ["token=abc", "secret = 'Zx81_kk9='", "API_KEY:qwerty12", "password: token=abcdef", "AKIA" + "Q7" * 9, "AKIAshort", "0a1b2c" * 5, "é", "word", "\n", "ghp_" + "aB3dE5gH" * 4 + "wxYZ"]
PERSONAL = ["a.b@c-d.co.uk", "x@y", "a@b@c.de", "1.2.3.4", "999.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111111111111112", "+49 (30) 1234-5678", "+1", "ü", "call 030 1234567", "IBAN DE89 3704 0044 0532 0130 00", "12"]


def spans_by(patterns, text):
    out = []
    for kind, pattern, ok in patterns:
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, re.A) if ok(m)]
    order = [p[0] for p in patterns]
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(out, key=lambda s: (s[0], order.index(s[1]))))


def digits(m):
    return re.sub(r"\D", "", m.group())


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


SECRET_PATTERNS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
]
PII_PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
]


@pytest.mark.parametrize("module,pieces,patterns", [(secrets, PIECES, SECRET_PATTERNS), (pii, PERSONAL, PII_PATTERNS)])
def test_base_spans_equal_plain_patterns(module, pieces, patterns):
    rnd = random.Random(4)
    find = (lambda raw: secrets.find(raw, secrets.default_model())) if module is secrets else pii.find
    for _ in range(1500):
        text = "".join(rnd.choice(pieces) + rnd.choice(["", " ", ".", "=", "-", ": "]) for _ in range(rnd.randint(0, 9)))
        base, every = find(text.encode())[:2]
        assert ",".join(f"{k}:{a}:{b}" for k, a, b in base) == spans_by(patterns, text), text
        assert set(base) <= set(every)


def test_secret_grammar_on_held_out_formats():
    model, fresh = secrets.default_model(), secrets.labelled_credentials(600, seed=123)
    assert sum(model.fits(v) for _, v in fresh) >= 0.95 * len(fresh)
    rnd = random.Random(8)
    plain = ["".join(rnd.choices("abcdefghijklmnop0123_-", k=rnd.randint(16, 40))) for _ in range(2000)]
    assert sum(model.fits(v) for v in plain) <= 5


def test_every_format_is_held_out():
    labelled = secrets.labelled_credentials()
    seen, held = secrets.split(labelled)
    kinds = {v: k for k, v in labelled}
    assert {kinds[v] for v in held} == {kinds[v] for v in seen} == set(kinds.values()) and len(held) * 4 == len(labelled)
    model = secrets.learn(labelled)
    scores = sorted(map(model.score, held))
    assert scores[int(len(scores) * secrets.MISSED)] == pytest.approx(model.threshold + secrets.SLACK)


def test_secrets_behind_names_and_addresses():
    model = secrets.default_model()
    values = {kind: v for kind, v in secrets.labelled_credentials(60, seed=31)}
    around = [("GH_PAT=", ""), ("https://", "@host.example"), ("https://a.example/js?key=", "&v=1"), ("https://a.example/x-1/", "/raw"), ("a%3D", ""), ("", "=")]
    for kind in ("forge", "chat", "payment", "maps", "packages"):
        for before, after in around:
            text = f"see {before}{values[kind]}{after} here"
            spans = [(a, b) for k, a, b in secrets.find(text.encode(), model)[1] if k == "format"]
            at = text.index(values[kind])
            assert spans == [(at, at + len(values[kind]))], (kind, text, spans)
    two = f"{values['forge']}/{values['packages']}"
    assert [text[0] for text in secrets.find(two.encode(), model)[1]] == ["format", "format"]
    for plain in ("https://a.example/docs/getting-started-with-version-2/index", "a=b/c-d_e=1/" * 400, "key-" * 2000 + "1"):
        assert not secrets.find(plain.encode(), model)[1]


def test_added_personal_data():
    kinds = [s[0] for s in pii.find(f"Konto: IBAN DE89 3704 0044 0532 0130 00, {'word ' * 12} tel 030 1234567, {'word ' * 12} order 030 7654321".encode())[1]]
    assert kinds.count("iban") == 1 and kinds.count("local_phone") == 1
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")


def test_account_numbers_in_lists_and_of_all_countries():
    german, british = "DE89370400440532013000", "GB82WEST12345698765432"
    spaced = "DE89 3704 0044 0532 0130 00"
    others = ["TR330006100519786457841326", "UA213223130000026007233566001", "SA0380000000608010167519", "AE070331234567890123456", "IL620108000000099999999", "BR1800360305000010009795493C1"]
    failing = [f"ZZ12 {german}", f"DE00 {german}", f"DE88370400440532013000 {german}", f"AB12 {spaced}"]

    def found(text):
        return [text[a:b] for k, a, b in pii.find(text.encode())[1] if k == "iban"]

    assert found(f"{german} {british}") == [german, british]
    assert found(f"{spaced} {spaced} {british}") == [spaced, spaced, british]
    assert found(" ".join(others)) == others
    assert all(found(text) == [text.split(" ", 1)[1]] for text in failing)
    assert found(german + "1") == [] and found("X" + german) == []


def test_scans_keep_every_row(docs, texts):
    for out in (secrets.find_secrets(docs), pii.find_pii(docs)):
        assert out.count() == len(texts)
    empty = secrets.find_secrets(docs.where("doc_id = 3")).first()
    assert (empty.n_hex, empty.spans, empty.base_sha256) == (0, "", hashlib.sha256(b"").hexdigest())


# --- quality ---


def test_quality_report_and_order(docs, texts):
    out = {r.doc_id: r for r in quality.quality_report(docs).collect()}
    for i, t in dict(texts).items():
        w = words(t)
        runs = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        held = {p for j, r in enumerate(runs) if runs.count(r) > 1 for p in range(j, j + 5)} if len(runs) < 500 else None
        r = out[i]
        assert (r.n_words, r.word_chars) == (len(w), sum(len(x.decode()) for x in w))
        if held is not None:
            assert r.n_repeat_words == len(held)
            assert r.base_failed == (len(w) < 10 or 100 * len(held) > 20 * len(w))
        assert not (r.kept and r.base_failed)
    assert out[10].kept and not out[20].kept and not out[3].kept
    names = [r.name for r in quality.RULES]
    kept = [{r.doc_id for r in quality.quality_filter(docs, order=o).collect()} for o in (names, names[::-1])]
    assert kept[0] == kept[1] == {i for i, r in out.items() if r.kept}


def test_cascade_order_takes_rejection_per_cost_among_the_rest():
    own = {r: (r.upper(),) for r in "abc"}
    e = quality.Estimates({"A": 1.0, "B": 1.0, "C": 4.0}, own, {frozenset("ab"): 10, frozenset("b"): 5, frozenset("c"): 8, frozenset(): 50})
    assert e.order() == ["b", "c", "a"]
    # a and c share the dear fact: once a has paid for it, c comes before the cheaper b
    shared = {"a": ("S",), "b": ("B",), "c": ("S", "C")}
    assert quality.Estimates({"S": 9.0, "B": 2.0, "C": 0.1}, shared, {frozenset("a"): 90, frozenset("b"): 10, frozenset("c"): 5}).order() == ["a", "c", "b"]


def test_facts_of_a_rule_are_all_it_computes(docs):
    for rule in quality.RULES:
        facts = quality.Facts(b"one two two THREE\nfour # five\n" * 5)
        rule.rejects(facts)
        assert set(vars(facts)) & set(quality.FACTS) == set(rule.needs)
    assert 0 < sum(quality.estimate(docs, sample=8).rejected.values()) <= 8
    assert sum(quality.estimate(docs).rejected.values()) == docs.count()
    assert len(quality.estimate(docs.limit(0)).order()) == len(quality.RULES)


# --- tokens ---

ODD = ["", " ", "it's I'LL don't", "<|endoftext|>a <|startoftext|>", "İΣΑΣ ﬁ é 　x", "a\n\n b  c\t", "한국어 ‍ 123 4567", "\x1c\x85"]


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(WORD_BPE), BpeCodec(WORD_BPE, remembered=8)
    for text in [*ODD, prose(200)]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    rules = MergeRules([(1, 1, 2), (2, 1, 3)])
    assert merge_symbols([1, 1, 1], rules) == [3] and merge_symbols([1, 1, 1, 1], rules) == [2, 2] and merge_symbols([5], rules) == [5]


def test_bpe_frames(docs, texts):
    df = bpe_decode(bpe_encode(docs.withColumn("ids", F.lit(1)), WORD_BPE), WORD_BPE)
    rows = {r.doc_id: r for r in df.collect()}
    assert rows[3].ids == [] and rows[3].decoded == "" and rows[6].kept == "src"
    once = {r.doc_id: r for r in bpe_encode_decode(docs, WORD_BPE).collect()}
    assert all((once[i].ids, once[i].decoded) == (rows[i].ids, rows[i].decoded) for i in rows)
    trip = {r.doc_id: r for r in bpe_round_trip(docs, WORD_BPE).collect()}
    assert all(trip[i].decoded_sha256 == hashlib.sha256(rows[i].decoded.encode()).hexdigest() for i in rows)


def test_token_files(spark, docs, texts, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_BPE)
    extra = spark.createDataFrame([(100 + i, t, "src") for i, t in enumerate(ODD)], docs.schema)
    out = write_tokens(docs.unionByName(extra), f"file://{tmp_path}/tokens", BYTE_BPE, 2, files=3)
    want, at = [], 0
    for i, t in sorted([(i, t or "") for i, t in texts] + [(100 + i, t) for i, t in enumerate(ODD)]):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_checksums(spark, out).collect())) == want
    plan = read_tokens(spark, out).select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "tokens:array" not in plan.split("ReadSchema")[-1]


# --- benchmark ---


def test_decontamination(spark, docs):
    item = prose(40)
    edited = item[:50] + "Q" + item[51:90] + item[92:]
    rows = [(0, prose(20) + " " + item.upper().replace(" ", "\n") + " tail"), (1, edited), (2, prose(300)), (3, None), (4, item[: len(item) // 2]), (0, item)]
    held = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "short"), (7, item)], "item_id long, text string")
    got = benchmark_matches(held, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(0, 7), (0, 7), (1, 7)]
    assert {r.edits for r in got if r.doc_id == 1} == {3}
    assert sorted(r.doc_id for r in decontaminate(held, bench).collect()) == [2, 3, 4]
    assert benchmark_matches(held, bench.limit(0)).count() == 0 and decontaminate(held.limit(0), bench).count() == 0


# --- lines ---


def test_line_dedup(spark):
    rows = [(i, f"{prose(12)}\nPage {i} of the yearly report was printed here today\n\n{prose(9)}", "x") for i in range(30)]
    copies = [(100 + i, "a copied line of some words\nanother copied line that has words", "x") for i in range(30)]
    df = spark.createDataFrame([*rows, *copies, (200, None, "x"), (201, "", "x")], "doc_id long, text string, n_lines string")
    out = {r.doc_id: r for r in line_dedup(df).collect()}
    assert all(out[i].n_dropped == 1 and "Page" not in out[i].kept_text and out[i].n_lines == 3 for i in range(30))
    assert all(out[100 + i].n_dropped == 0 and out[100 + i].kept_text == copies[0][1] for i in range(30))
    assert out[200].kept_text is None and out[201].kept_text == "" and len(out) == 62
    assert line_dedup(df.limit(0)).count() == 0


def test_line_dedup_is_not_outvoted_by_copies(spark):
    line = "all rights to these pages are reserved"
    pages = [(i, f"{prose(12)}\n{line}\n{prose(9)}") for i in range(12)]
    copies = [(100 + i, pages[0][1]) for i in range(120)]
    df = spark.createDataFrame([*pages, *copies], "doc_id long, text string")
    out = {r.doc_id: r for r in line_dedup(df).collect()}
    assert len(out) == 132 and all(r.n_dropped == 1 and line not in r.kept_text for r in out.values())

    base = prose(200).split()
    edits = [" ".join(base[:k] + [f"{w}x"] + base[k + 1 :]) for k, w in enumerate(base)]
    near = spark.createDataFrame([(i, f"{t}\n{line}") for i, t in enumerate(edits)], "doc_id long, text string")
    assert all(r.n_dropped == 0 for r in line_dedup(near).collect())


def test_lines_find_any_template_similar_enough(monkeypatch):
    def grouped(rows):
        leaf = line_dedup_module.Leaf(len(rows[0]))
        return [leaf._template(np.array(r, dtype=np.uint16)) for r in rows]

    assert len(set(grouped([[1, 2, 3, 4], [1, 2, 3, 5], [1, 2, 3, 6]]))) == 1
    far = list(range(1, 18))
    for place in (3, 6, 10, 13, 16):
        far[place] += 100
    assert grouped([list(range(1, 18)), far]) == [0, 0]
    rnd = random.Random(6)
    for width in (1, 3, 4, 5, 6, 9, 17, 40):
        bases = [[1, 2, 3, *rnd.choices(range(4, 9), k=width)][:width] for _ in range(40)]
        rows = [[t if i < 3 or rnd.random() < 0.8 else rnd.randint(4, 30) for i, t in enumerate(rnd.choice(bases))] for _ in range(300)]
        every = grouped(rows)
        monkeypatch.setattr(line_dedup_module, "COMPARED", 0)
        assert grouped(rows) == every
        monkeypatch.undo()


def test_short_lines_of_one_template_recur(spark):
    topics = ["Sports", "Politics", "Weather", "Music", "Travel", "Food"]
    df = spark.createDataFrame([(i, f"{prose(15)}\nPosted in category {t}") for i, t in enumerate(topics)], "doc_id long, text string")
    assert all(r.n_dropped == 1 and "Posted" not in r.kept_text for r in line_dedup(df).collect())


def test_short_texts_are_copies_and_few_documents_are_counted_exactly(spark):
    alone = [(1000 + i, t) for i, t in enumerate(["hello", prose(5), "hello there", prose(4)] * 12)]
    rows = [(5 * k + i, f"{prose(20)}\n{head} is a notice under every page") for k, head in enumerate(VOCABULARY[:80]) for i in range(5)]
    rare = [(2000 + i, f"{prose(20)}\nonly four pages hold this one") for i in range(4)]
    df = spark.createDataFrame([*alone, *rows, *rare], "doc_id long, text string")
    out = {r.doc_id: r for r in line_dedup(df).collect()}
    assert all(out[i].n_dropped == 0 for i, t in alone if t.startswith("hello"))
    assert all(out[i].n_dropped == 1 for i, _ in rows) and not any(out[i].n_dropped for i, _ in rare)


# --- language ---


def test_language(spark):
    rnd = random.Random(2)
    speech = {"de": "und der die nicht schöne straße", "en": "and the which with there", "fr": "et le les être avec français"}
    rows = [(i, " ".join(rnd.choices(speech[l].split(), k=25)), l, f"h{i % 4}") for i, l in enumerate(list(speech) * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language_id.train(df.where("doc_id < 60"))
    got = {r.id: r.lang for r in language_id.identify(df, model, "doc_id", "text", host_col="source").collect()}
    assert all(got[i] == l for i, _, l, _ in rows)
    pages = [(1, "http://a.example.de/x", "<html lang='de'><body></body></html>"), (2, None, None), (3, "https://b.example.fr/", "<p>et le les avec</p>")]
    web = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = {r.id: r for r in language_id.identify(web, model, "page_id", "html", url_col="url", markup=True).collect()}
    assert (out[1].declared, out[1].suffix, out[1].lang, out[3].lang) == ("de", "de", "de", "fr") and out[2].lang in speech
    assert language_id.identify(web.limit(0), model, "page_id", "html", url_col="url", markup=True).count() == 0


def test_every_label_is_told_apart(spark, monkeypatch):
    rnd = random.Random(12)
    speech = {f"l{i:02}": ["".join(rnd.choices("abcdefghijklmnop", k=6)) for _ in range(8)] for i in range(70)}
    rows = [(" ".join(rnd.choices(speech[l], k=20)), l) for l in speech for _ in range(2)]
    labelled = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    model = language_id.train(labelled)
    assert model.languages == tuple(speech)
    assert all(model.languages[int(np.argmax(model.scores(t.encode())))] == l for t, l in rows)
    monkeypatch.setattr(language_id, "LABELS", 69)
    with pytest.raises(ValueError, match="more than 69 labels"):
        language_id.train(labelled)


def test_labelled_credentials_from_a_table(spark):
    rows = [*secrets.labelled_credentials(120, seed=5), ("forge", None), (None, ""), ("chat", "xoxb-1")]
    table = spark.createDataFrame([(v, k, 1) for k, v in rows], "value string, kind string, extra int")
    got = secrets.labelled_rows(table, n=60)
    assert got == secrets.labelled_rows(table.repartition(5), n=60) and len(got) == 60
    assert min(sum(k == kind for k, _ in got) for kind in {k for k, _ in got}) >= 9
    assert not secrets.learn([]).fits("ghp_" + "a1" * 18)


def test_merges_are_tested_and_all_candidates_are_scored():
    automaton = secrets.Automaton()
    for word in ["ab"] * 6 + ["ac"] * 2 + ["bb"] * 6 + ["bc"] * 2 + ["cdddd"] * 8:
        automaton.add(list(word))
    a, b, c = (automaton.steps[0][x][0] for x in "abc")
    assert automaton.compatible(a, b, 0.05) and not automaton.compatible(a, c, 0.9)
    model = secrets.default_model()
    letters = "npm_" + "aBcDeFgH" * 4 + "aBcD"
    assert model.score(letters) > model.threshold - 1  # scored like any other, digits or not
    assert secrets.find(("x" * 50_000).encode(), model)[1] == []
