"""Operators that learn or align, against held-out rows and plain Python."""

import numpy as np
import odd_rows
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from tidelog.llm import langid, license_scan, toxicity, words
from tidelog.llm.queries import QUERIES, fold, table

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def odd(spark):
    return odd_rows.frame(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], odd_rows.SCHEMA)


def test_language_of_held_out_documents(spark):
    found = QUERIES["op1_language_mixture"](spark, LARGER)
    truth = table(spark, LARGER, "documents").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").where("held_out and lang is not null").collect()
    assert len(rows) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_mixture_of_two(spark):
    docs = table(spark, LARGER, "documents")
    model = langid.train(docs)
    pure = langid.predict(docs, model).where("size(languages) = 1").select("doc_id")  # some documents mix languages
    long = docs.where("length(text) > 2000").join(pure, "doc_id").select("lang", "text").collect()
    by_lang = {r["lang"]: r["text"] for r in long}
    both = by_lang["de"][:1200] + " " + by_lang["fr"][:1200]
    row = langid.predict(spark.createDataFrame([(1, both)], "doc_id long, text string"), model).first()
    shares = {x["lang"]: x["share"] for x in row["languages"]}
    assert set(shares) == {"de", "fr"} and min(shares.values()) > 0.25
    alone = langid.predict(spark.createDataFrame([(1, by_lang["es"])], "doc_id long, text string"), model).first()
    assert [x["lang"] for x in alone["languages"]] == ["es"]


def test_language_edge_cases(spark, odd, empty):
    model = langid.train(odd)
    found = {(r["doc_id"], r["lang_pred"] == "und", r["score"] > 0) for r in langid.predict(odd, model).collect()}
    silent = {
        (r[0], True, False) for r in odd_rows.rows() if not any(c.isalpha() for c in r[1] or "")
    }
    assert {f for f in found if f[1]} == silent
    assert langid.predict(empty, model).collect() == []
    nothing = langid.predict(odd, langid.train(empty)).collect()
    assert len(nothing) == len(odd_rows.rows()) and {r["lang_pred"] for r in nothing} == {"und"}


def test_em_finds_the_proportions():
    random = np.random.default_rng(4)
    tables = random.dirichlet(np.full(50, 0.1), 3)
    counts = np.array([400, 300, 1])
    drawn = np.concatenate(
        [
            np.where(random.random(400) < 0.3, random.choice(50, 400, p=tables[0]), random.choice(50, 400, p=tables[1])),
            random.choice(50, 300, p=tables[2]),
            random.choice(50, 1, p=tables[0]),
        ]
    )
    shares = langid.mixtures(tables[:, drawn].T.astype(np.float32), counts, 2.0)
    assert np.allclose(shares.sum(axis=1), 1, atol=1e-4)
    assert abs(shares[0, 0] - 0.3) < 0.1 and shares[0, 2] == 0
    assert list(shares[1]) == [0, 0, 1]


def test_toxicity_of_held_out_documents(spark):
    """Most toxic documents are found, clean ones are left alone. The smaller tables have too few labels to learn from."""
    large = "/root/testdata/sf0.1"
    found = QUERIES["op6_toxicity"](spark, large).join(table(spark, large, "labels"), "doc_id").where("held_out").collect()
    bad = [r["predicted"] for r in found if r["toxic"]]
    good = [r["predicted"] for r in found if not r["toxic"]]
    assert len(bad) >= 100
    assert sum(bad) >= 0.9 * len(bad) and sum(good) <= 0.01 * len(good)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in found)


def test_toxicity_marks_vote():
    """A mark moves the posterior as far as marks agree with the voters; useless marks move nothing."""
    chosen = np.random.default_rng(3)
    truth = chosen.random(4000) < 0.1
    belief = np.where(truth, 0.9, 0.02)
    belief[:200] = 0.1  # the voters know little of these
    marks = (truth ^ (chosen.random(4000) < 0.02)).astype(float)
    after = toxicity.with_marks(belief, marks)
    assert ((after[:200] > 0.3) == truth[:200]).mean() > 0.95 and ((after > 0.3) == truth).mean() > 0.97
    assert np.abs(toxicity.with_marks(belief, chosen.permutation(marks)) - belief).max() < 0.1
    assert np.isfinite(toxicity.with_marks(np.array([0.0, 1.0]), np.array([1, 0]))).all()


def test_toxicity_learns_one_text_of_each_id(spark):
    """Rows that share a labelled doc_id count as one."""
    rows = [(1, f"vile{i} text") for i in range(300)] + [(i, f"plain text {i}") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 40)], "doc_id long, toxic int")
    assert len(toxicity.fit(docs, labels).mined.keys) == 0  # one toxic text is no evidence for a word
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == len(rows)


def test_toxicity_edge_cases(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (27, 1), (12, 0)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    found = {r["doc_id"]: r["score"] for r in toxicity.score(odd, model).collect()}
    assert all(0 <= s <= 1 for s in found.values())
    assert found[27] > max(found[i] for i in (2, 4, 11))
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    assert toxicity.score(empty, model).collect() == []
    for docs, marks in ((empty, labels), (odd, labels.limit(0)), (empty, labels.limit(0)), (odd, labels.where("toxic = 0"))):
        assert toxicity.score(odd, toxicity.fit(docs, marks)).count() == len(odd_rows.rows())


def test_toxicity_counts_all_but_copies(spark):
    """Texts that share a rare word are no copies; equal words are, whatever their case and punctuation."""
    other = [f"a common opening and {i} of its own" for i in range(20)]
    copies = ["One text, told twice.", "one text told TWICE", "\u00dcber uns!", "\u00fcber  uns"]
    silent = ["!!!", "???", "", None]
    rows = [(t, 0) for t in [*other, *copies, *silent, "!!!"]] + [(other[0], 1)]
    kept = toxicity.one_of_each(spark.createDataFrame(rows, "text string, toxic int")).collect()
    good = [r["text"] for r in kept if not r["toxic"]]
    assert [r["text"] for r in kept if r["toxic"]] == [other[0]]
    assert set(other) | set(silent) <= set(good)
    assert len(good) == len(other) + 2 + len(silent)


def test_label_model_recovers_voters():
    random = np.random.default_rng(6)
    truth = random.random(20_000) < 0.1
    rates = [(0.9, 0.02), (0.8, 0.03), (0.85, 0.02), (0.7, 0.01), (0.5, 0.45)]
    votes = np.stack([np.where(truth, random.random(20_000) < a, random.random(20_000) < b) for a, b in rates], axis=1)
    votes = np.concatenate([votes, votes[:, :1]], axis=1)  # a copy of the first voter
    patterns, times = np.unique(votes, axis=0, return_counts=True)
    model = toxicity.label_model(patterns, times, 0.1)
    assert np.allclose(model.accuracies[0][:4], [a for a, _ in rates[:4]], atol=0.06)
    assert model.correlations[0, 5] > 0.9 and abs(model.correlations[0, 1]) < 0.2
    assert model.weights[0][0] < 0.7 * model.weights[0][2]  # the copy shares its evidence
    assert ((toxicity.posterior(votes, model) > 0.5) == truth).mean() > 0.98


def aligned(text, template):
    """Best local alignment of all, without a band: matched words, start, end."""
    best = (0, 0, 0, 0)
    score = {}
    for i in range(len(template) + 1):
        for j in range(len(text) + 1):
            options = [(0, 0, j)]
            if i and j:
                same = text[j - 1] == template[i - 1]
                value, hits, first = score[i - 1, j - 1]
                options.append((value + (2 if same else -1), hits + same, first if value > 0 else j - 1))
                value, hits, first = score[i, j - 1]
                options.append((value - 1, hits, first))
                value, hits, first = score[i - 1, j]
                options.append((value - 1, hits, first))
            score[i, j] = max(options, key=lambda o: o[0])
            if score[i, j][0] > best[0]:
                best = (score[i, j][0], score[i, j][1], score[i, j][2], j)
    return best[1:]


def test_license_alignment(spark):
    filler = odd_rows.prose(70, 40)
    texts = [
        " ".join(filler[:10]) + " Released under the MIT License. " + " ".join(filler[10:]),
        "This work is licensed, under the GNU General Public Licence version 3",
        "this work is hereby licensed under GNU General Public License version 3 " + " ".join(filler),
        "Licensed under the Apache License, Version 2.0. x y z Licensed under the Apache License, Version 2.0.",
        "under the hood",
        "",
        None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["matches"] for r in license_scan.scan_licenses(docs).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        w = odd_rows.words(text, odd_rows.ALNUM, lower=True)
        expected = set()
        for name, template in license_scan.TEMPLATES:
            t = odd_rows.words(template, odd_rows.ALNUM, lower=True)
            matched, start, end = aligned(w, t)
            if matched >= 0.8 * len(t):
                expected.add((name, matched, start, end))
        got = {(m["license"], m["matched"], m["start"], m["end"]) for m in found[i]}
        assert {g[0] for g in got} == {e[0] for e in expected}
        assert got >= expected
    assert len(found[3]) == 2


def test_license_notices_with_other_words(spark):
    """Every short notice with a word changed, missing or inserted, or two of these, is found when enough of it is left."""
    texts = ["released under an MIT License", "Released under MIT License"]
    for _, template in license_scan.TEMPLATES[:5]:
        t = odd_rows.words(template, odd_rows.ALNUM, lower=True)
        for i in range(len(t)):
            once = [t[:i] + ["zz"] + t[i + 1 :], t[:i] + t[i + 1 :], t[:i] + ["zz"] + t[i:]]
            texts += [" ".join(["aa", "bb", *x, "cc"]) for x in once]
            texts += [" ".join(x[:j] + ["yy"] + x[j:]) for x in once for j in range(1, len(x), 2)]
    texts.append("released aa under aa the aa mit aa license")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: {(m["license"], m["matched"]) for m in r["matches"]} for r in license_scan.scan_licenses(docs).collect()}
    expected = {i: set() for i in range(len(texts))}
    for i, text in enumerate(texts):
        w = odd_rows.words(text, odd_rows.ALNUM, lower=True)
        for name, template in license_scan.TEMPLATES:
            t = odd_rows.words(template, odd_rows.ALNUM, lower=True)
            matched, _, _ = aligned(w, t)
            if matched >= 0.8 * len(t):
                expected[i].add((name, matched))
    assert all(expected[i] for i in (0, 1, len(texts) - 1))
    assert found == expected


def test_license_templates_with_long_runs(spark):
    """With a high coverage long templates are known by fingerprints; the result is that of the alignment."""
    t = odd_rows.prose(71, 90)
    texts = [" ".join(t), " ".join(t[:40] + ["zz"] + t[41:]), " ".join(t[:40] + ["yy", "zz"] + t[40:]), " ".join(t[:80])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = license_scan.scan_licenses(docs, [("long", " ".join(t)), ("word", "qqq")], coverage=0.98).collect()
    assert {r["doc_id"]: [m["matched"] for m in r["matches"]] for r in rows} == {0: [90], 1: [89], 2: [90], 3: []}
    one = license_scan.scan_licenses(docs, [("word", "zz")]).collect()
    assert [len(r["matches"]) for r in sorted(one, key=lambda r: r["doc_id"])] == [0, 1, 1, 0]


def test_license_scan_of_all_documents(spark, odd, empty):
    """Every document that has a notice word by word is found, with full coverage."""
    docs = table(spark, LARGER, "documents").union(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    found = license_scan.scan_licenses(docs).select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*").collect()
    got = {(r["doc_id"], r["license"]) for r in found if r["coverage"] == 1.0}
    expected = set()
    for row in docs.collect():
        text = " " + " ".join(odd_rows.words(row["text"], odd_rows.ALNUM, lower=True)) + " "
        for name, template in license_scan.TEMPLATES:
            if " " + " ".join(odd_rows.words(template, odd_rows.ALNUM, lower=True)) + " " in text:
                expected.add((row["doc_id"], name))
    assert len(expected) > 20 and got == expected
    assert license_scan.scan_licenses(empty).collect() == []
    assert license_scan.scan_licenses(odd, templates=[("none", "")]).where("size(matches) > 0").collect() == []


def test_held_out_folds(spark):
    rows = spark.createDataFrame([(None,), (1,), (2,)], "doc_id long").select("doc_id", fold("doc_id", 3, 1).alias("x")).collect()
    import zlib

    assert {(r[0], r[1]) for r in rows} == {(None, True)} | {(i, zlib.crc32(str(i).encode()) % 3 == 1) for i in (1, 2)}
    assert words.SPACES.sum() == 6 and SF_DIR
