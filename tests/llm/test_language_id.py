"""Language identification against a plain version of Bayes' rule, and cases that fusion decides."""

import math
import random

import numpy as np
import pytest

from lexspark.llm import language_id as module
from lexspark.llm.language_id import DOMAIN_WEIGHT, HOST_WEIGHT, identify, train

SPEECH = {"de": "und der die nicht schöne straße über", "en": "and the which with there", "fr": "et le les être avec français"}


def speak(rnd, lang, n):
    return " ".join(rnd.choices(SPEECH[lang].split(), k=n))


@pytest.fixture(scope="module")
def model(spark):
    rnd = random.Random(2)
    return train(spark.createDataFrame([(speak(rnd, l, 25), l) for l in list(SPEECH) * 20], "text string, lang string"))


def brute(model, rows):
    """``rows`` are (id, url, declared, body); everything by loops."""
    langs, hosts, out = model.languages, {}, {}
    facts = []
    for i, url, declared, body in rows:
        host = url.split("/")[2] if url else None
        labels = (host or "").split(".")
        keep = 3 if len(labels) > 2 and labels[-2] in module.REGISTRY_LABELS and len(labels[-1]) == 2 else 2
        domain = ".".join(labels[-keep:]) if len(labels) > 1 else ""
        suffix = module.SUFFIX_LANGUAGE.get(labels[-1])
        scores = model.scores(body.encode())
        best = int(np.argmax(scores)) if len(body.encode()) > 2 else None
        facts.append((i, host, domain, declared if declared in langs else None, suffix if suffix in langs else None, scores, best))

    def trust(k):
        said = [(f[k], langs[f[6]]) for f in facts if f[k] and f[6] is not None]
        return (sum(a == b for a, b in said) + 8) / (len(said) + 10)

    sure = {3: trust(3), 4: trust(4)}
    for me in facts:
        others = [f for f in facts if f is not me and f[6] is not None]

        def share(part, weight, above):
            n = [sum(f[6] == x for f in part) for x in range(len(langs))]
            return [(n[x] + weight * above[x]) / (sum(n) + weight) for x in range(len(langs))]

        prior = [(sum(f[6] == x for f in others) + 1) / (len(others) + len(langs)) for x in range(len(langs))]
        if me[1] is not None:
            prior = share([f for f in others if f[2] == me[2] and f[1] is not None], DOMAIN_WEIGHT, prior)
            prior = share([f for f in others if f[1] == me[1]], HOST_WEIGHT, prior)
        total = [math.log(p) + s for p, s in zip(prior, me[5])]
        for k in (3, 4):
            if me[k]:
                total = [t + math.log(sure[k] if langs[x] == me[k] else (1 - sure[k]) / (len(langs) - 1)) for x, t in enumerate(total)]
        out[me[0]] = langs[int(np.argmax([round(t, 9) for t in total]))], 1 / sum(math.exp(t - max(total)) for t in total)
    return out


def pages(rnd):
    rows = []
    for i in range(150):
        lang = rnd.choice(list(SPEECH))
        host = rnd.choice([f"www.{lang}-{rnd.randint(0, 2)}.example.{'co.uk' if lang == 'en' else lang}", "mixed.example.com", "news.co.uk", "a.b.news.co.uk", None])
        body = rnd.choice([speak(rnd, lang, rnd.randint(1, 12)), speak(rnd, lang, 1)[:3], "", "xyz qqq"])
        rows.append((i, f"https://{host}/p/{i}" if host else None, rnd.choice([lang, "", "xx", rnd.choice(list(SPEECH))]), body))
    return rows


def test_equals_the_plain_rule(spark, model):
    rows = pages(random.Random(7))
    web = [(i, url, f"<html lang='{declared}'>{body}</html>" if declared else body) for i, url, declared, body in rows]
    df = spark.createDataFrame(web, "page_id long, url string, html string").repartition(3)
    rows = [(i, url, declared, module.visible(html.encode()).decode()) for (i, url, declared, _), (_, _, html) in zip(rows, web)]
    got = identify(df, model, "page_id", "html", url_col="url", markup=True).collect()
    want = brute(model, rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.lang == want[r.id][0] and abs(r.confidence - want[r.id][1]) < 1e-5, r


def test_each_kind_of_evidence_turns_a_verdict(spark, model):
    rnd = random.Random(3)
    rows = [(i, f"https://haus.example.com/{i}", speak(rnd, "de", 20)) for i in range(40)]
    rows += [(100 + i, f"https://shop{i}.example.org/", f"<html lang='fr'>{speak(rnd, 'fr', 20)}</html>") for i in range(40)]
    rows += [(200 + i, f"https://w{i}.example.fr/", speak(rnd, "fr", 20)) for i in range(40)]
    unclear = "qq"
    rows += [(900, "https://haus.example.com/x", unclear), (901, "https://other.example.net/", f"<html lang='fr'>{unclear}</html>"), (902, "https://neu.example.fr/", unclear)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.id: r for r in identify(df, model, "page_id", "html", url_col="url", markup=True).collect()}
    assert [got[i].lang for i in (900, 901, 902)] == ["de", "fr", "fr"]
    assert got[900].text_lang is None and got[902].suffix == "fr"


def test_registry_labels_nulls_and_ties(spark, model):
    rows = [(1, "https://a.co.uk/", "x"), (2, "https://b.co.uk/", None), (None, None, None), (2, "http://b.co.uk/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = identify(df, model, "page_id", "html", url_col="url", markup=True).collect()
    assert len(out) == 4 and {r.host for r in out} == {"a.co.uk", "b.co.uk", None}
    assert all(r.lang == "en" for r in out if r.host)


def test_training_reads_whole_texts_and_stays_the_same(spark):
    rows = [("x " * 15_000 + "ñandú " * 4_000, "es"), ("x " * 15_000 + "straße " * 4_000, "de"), (None, "de"), ("", "fr")]
    df = spark.createDataFrame(rows, "text string, lang string")
    one, two = train(df), train(df.repartition(4))
    assert one.languages == ("de", "es", "fr") and np.array_equal(one.table, two.table)
    assert int(np.argmax(one.scores("ñandú".encode()))) == 1
