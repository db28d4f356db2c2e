"""What secrets and personal data add to the base spans, against plain rules."""

import random
import re
import time

import pytest

from lexspark.llm import pii, secrets
from lexspark.llm._spans import Covered


def overlapping(a, b, spans):
    return any(a < e and s < b for _, s, e in spans)


def plain_score(text, kind, a, b):
    near = (text[max(0, a - pii.NEARBY) : a] + " " + text[b : b + pii.NEARBY]).lower()
    value = pii.PRIOR[kind] + 0.3 * any(w.decode() in near for w in pii.FOR[kind]) - 0.3 * any(w.decode() in near for w in pii.AGAINST)
    return min(1.0, max(0.0, value))


def plain_pii(text, base):
    """Account numbers at every place, from left to right; then national phone numbers; ASCII texts."""
    found, at = [], 0
    while at < len(text):
        size = pii.IBAN_LENGTH.get(text[at : at + 2])
        if size and (at == 0 or not text[at - 1].isalnum()):
            end, held = at, ""
            while end < len(text) and len(held) < size and (text[end].isdigit() or "A" <= text[end] <= "Z" or text[end] == " "):
                if text[end] == " " and (len(held) < 4 or text[end - 1] == " " or end + 1 == len(text) or not text[end + 1].isalnum()):
                    break
                held += text[end].strip()
                end += 1
            whole = len(held) == size and held[2:4].isdigit() and (end == len(text) or not text[end].isalnum())
            number = "".join(str(int(c, 36)) for c in held[4:] + held[:4]) if whole else "0"
            if int(number) % 97 == 1:
                found.append(("iban", at, end))
                at = end
                continue
        at += 1
    found += [("local_phone", m.start(), m.end()) for m in re.finditer(r"(?<![A-Za-z0-9+])\(?0[0-9]{1,4}\)?[ /-]?[0-9](?:[ -]?[0-9]){5,9}(?![A-Za-z0-9])", text)]
    added = []
    for kind, a, b in found:
        if plain_score(text, kind, a, b) >= pii.ENOUGH and not overlapping(a, b, base + added):
            added.append((kind, a, b))
    return set(added)


PIECES = [
    "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32", "DE88370400440532013000", "NO9386011117947", "XX11", "FR14",
    "030 1234567", "(040) 7654321", "0171-2345678", "call", "phone", "order", "invoice", "bank", "konto", "a.b@c.de", "4111 1111 1111 1111", "word", "word " * 12, "9", "A", "1.2.3.4",
]


def test_personal_data_added():
    rnd = random.Random(21)
    kinds = set()
    for _ in range(3000):
        text = "".join(rnd.choice(PIECES) + rnd.choice(["", " ", " ", ", ", "-", "\n"]) for _ in range(rnd.randint(0, 8)))
        base, every, scores = pii.find(text.encode())
        added = set(every) - set(base)
        assert added == plain_pii(text, base), text
        assert [round(s, 9) for s in scores] == [round(plain_score(text, *span), 9) for span in every]
        kinds |= {k for k, _, _ in added}
    assert kinds == {"iban", "local_phone"}


def plain_secrets(text, model, base):
    """In each run of credential characters: from every allowed start, the longest part that fits."""
    added = set()
    for m in re.finditer(r"[A-Za-z0-9_+/=-]+", text):
        run, free, own = m[0], 0, []
        if len(run) < model.shortest:
            continue
        for at in range(len(run)):
            before = text[: m.start() + at]
            starts = not re.search(r"[A-Za-z0-9]$", before) or re.search(r"(%[0-9A-Fa-f]{2}|\\[a-z])$", before)
            known = all(c in model.automaton.steps[s] for s, c in walk(model, run[at : at + secrets.LITERAL]))
            if at < free or len(run) - at < model.shortest or not starts or not known:
                continue
            for end in range(min(len(run), at + 4 * model.longest), at + model.shortest - 1, -1):
                part = run[at:end]
                clean = all(c.isalnum() or c in model.known for c in part)
                if clean and (end == len(run) or not run[end].isalnum()) and model.fits(part):
                    own.append(("format", m.start() + at, m.start() + end))
                    free = end
                    break
        own = {s for s in own if not overlapping(*s[1:], base)}
        if not own and not overlapping(m.start(), m.end(), base) and model.fits(run):
            own = {("format", m.start(), m.end())}
        added |= own
    return added


def walk(model, symbols):
    """States before each symbol, as far as there are steps."""
    state = 0
    for c in symbols:
        yield state, c
        if c not in model.automaton.steps[state]:
            return
        state = model.automaton.steps[state][c][0]


@pytest.mark.parametrize("seed", [1, 2])
def test_secrets_added(seed):
    rnd, model = random.Random(seed), secrets.default_model()
    values = [v for _, v in secrets.labelled_credentials(60, seed=seed)]
    pieces = [*values, *values, "key=", "https://", "/", "=", "-", "_", "%3D", "\\n", "token=", "internationalization", "0a1b2c" * 5, "word", "x" * 40, "AKIA" + "Q7" * 9]
    seen = 0
    for _ in range(1500):
        text = "".join(rnd.choice(pieces) + rnd.choice(["", " ", " ", "."]) for _ in range(rnd.randint(0, 6)))
        base, every = secrets.find(text.encode(), model)
        assert set(every) - set(base) == plain_secrets(text, model, base), text
        seen += len(every) - len(base)
    assert seen > 500


ORDINARY = [
    "key-value-store-implementation-notes", "key-frame-animation-duration-property", "npm_config_registry_settings_override", "sk_live_stream_of_the_concert_tonight",
    "AIzawa-street-corner-shop-in-the-north", "key-down-event-handler-function-name", "key-based-authentication-for-servers", "key-exchange-algorithm-negotiation",
    "key-" + "a" * 20, "https://a.example/key-concepts-of-distributed-systems/index", "KEY_DOWN_EVENT_HANDLER_FUNCTION_NAME", "ghp_" + "x" * 36,
]


def test_ordinary_names_are_no_credentials():
    model = secrets.default_model()
    assert not [t for t in ORDINARY if secrets.find(t.encode(), model)[1]]
    # other names than those learnt from, plain and behind the beginnings of every format
    names = secrets.ordinary_names(1400, seed=77)
    for lead in ("ghp_", "key-", "AIza", "npm_", "sk_live_", "xoxb-"):
        names += [lead + n for n in secrets.ordinary_names(700, seed=78)]
    assert sum(bool(secrets.find(n.encode(), model)[1]) for n in names) <= 0.003 * len(names)
    fresh = secrets.labelled_credentials(1200, seed=79)
    assert sum(model.fits(v) for _, v in fresh) >= 0.99 * len(fresh)


def test_a_likely_beginning_of_an_unlikely_length_is_none():
    model, values = secrets.default_model(), [v for k, v in secrets.labelled_credentials(600, seed=80) if k == "mail"]
    assert all(model.fits(v) for v in values)
    assert not any(model.fits(v[:20]) for v in values)
    assert all(model.score(v + v[4:12]) < model.score(v) > model.score(v[:32]) for v in values)
    assert model.lengths.log_likelihood("none" * 5) < model.lengths.log_likelihood(values[0])


def test_covered_equals_all_pairs():
    rnd = random.Random(12)
    for _ in range(300):
        spans = [("x", a, a + rnd.randrange(1, 6)) for a in (rnd.randrange(40) for _ in range(rnd.randrange(8)))]
        taken = Covered(spans)
        for a in range(44):
            for b in range(a + 1, 46):
                assert taken.meets(a, b) == overlapping(a, b, spans)


@pytest.mark.parametrize("what", ["hashes", "phones"])
def test_many_spans_take_time_in_proportion(what):
    model, took = secrets.default_model(), {}
    for n in (2_000, 64_000):
        lines = [f"{k * 7919**9:032x}" if what == "hashes" else f"call 030 {k:07d} {'word ' * 6}" for k in range(n)]
        raw = "\n".join(lines).encode()
        began = time.perf_counter()
        found = secrets.find(raw, model)[0] if what == "hashes" else pii.find(raw)[1]
        took[n] = time.perf_counter() - began
        assert len(found) == n
    assert took[64_000] < 32 * 5 * took[2_000] + 1  # 1,024 times were it quadratic
