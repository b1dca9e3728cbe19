"""Bytes that are not UTF-8, crowds of equal keys and repetitive inputs, in every operator."""

import random

import numpy as np
import odd_rows
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import (
    blocks,
    decontaminate,
    exact_dedup,
    host_rules,
    importance,
    jaccard,
    langid,
    license_scan,
    mixing,
    substring,
    suffix_dedup,
    toxicity,
    url_filter,
)

TEXTS = "doc_id long, text string"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def raw(spark):
    """Ten documents, most of them with bytes that are not UTF-8; 3 and 4 differ in blanks only."""
    tail = " ".join(odd_rows.prose(3, 70)).encode()
    texts = [b"\xff" + tail, b"\xfe" + tail, b"a\xc3\x28" + tail, b" a\xc3 \x28" + tail, b"\x80\x81\x82", b"\xf0\x9f\x98", b"\xed\xa0\x80 x", tail[:90] + b"\xc0\xaf", b"", b"\xff"]
    rows = [(i + 1, bytearray(t), f"s{i % 2}", "en") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, bytes binary, source string, lang string").repartition(3)
    return frame.select("doc_id", F.col("bytes").cast("string").alias("text"), "lang", "source", F.length("bytes").cast("long").alias("n_chars"))


def ids(frame):
    return sorted(r["doc_id"] for r in frame.select("doc_id").collect())


def test_no_document_vanishes(spark, raw):
    every = list(range(1, 11))
    marks = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.mark_duplicates(raw).collect()}
    assert {i for i, (_, kept) in marks.items() if kept} == set(every) - {3} and marks[3] == (4, False)
    for most in (exact_dedup.MOST_BROADCAST, 0):
        assert ids(exact_dedup.deduplicate(raw, most_broadcast=most)) == [i for i in every if i != 3]
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    model = toxicity.fit(raw, labels)
    assert ids(toxicity.score(raw, model)) == every
    assert ids(langid.predict(raw, langid.train(raw))) == every
    assert ids(jaccard.join_components(raw)) == every
    assert ids(substring.remove_repeats(raw)) == every
    assert ids(suffix_dedup.remove_repeats(raw)) == every
    bench = spark.createDataFrame([(1, "nothing of this kind")], "item_id long, text string")
    assert ids(decontaminate.find_items(raw, bench)) == every == ids(decontaminate.keep_clean(raw, bench))
    assert ids(mixing.mix(raw)) == every
    assert ids(license_scan.scan_licenses(raw)) == every
    assert ids(host_rules.judge(raw)) == every
    assert ids(importance.resample(raw, bench)) == every
    pages = raw.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.net/"), "text").alias("url"))
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    judged = url_filter.judge(pages, rules)
    assert sorted(r["page_id"] for r in judged.collect()) == every and {r["verdict"] for r in judged.collect()} == {"block"}


def test_the_pipeline_accounts_for_every_document(spark, raw):
    """What each stage drops is named by the operator on the same input."""
    docs = raw
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SMALL).checkpoint()
        gone = set(ids(docs)) - set(ids(kept))
        assert set(ids(kept)) | gone == set(ids(docs)) and len(ids(kept)) + len(gone) == docs.count()
        if name == "exact_dedup":
            marks = exact_dedup.mark_duplicates(docs).where("not kept")
            assert gone == set(ids(marks))
        elif name == "ngram_jaccard":
            assert gone == {r["doc_id"] for r in jaccard.join_components(docs).collect() if r["component_id"] != r["doc_id"]}
        elif name == "decontamination":
            assert gone == set()
        docs = kept
    assert len(ids(docs)) >= 5


def test_deduplicate_reduces_equal_rows(spark):
    rows = [(7, "same text")] * 40 + [(None, "other")] * 40 + [(8, "same  text"), (9, "third"), (9, "third ")]
    docs = spark.createDataFrame(rows, TEXTS).repartition(4)
    for most in (exact_dedup.MOST_BROADCAST, 0):
        left = sorted((r["doc_id"] or 0, r["text"]) for r in exact_dedup.deduplicate(docs, most_broadcast=most).collect())
        assert left == [(0, "other"), (8, "same  text"), (9, "third ")]


def test_rows_without_an_id_are_dealt_by_their_text(spark):
    rows = [(None if i % 3 == 0 else i, " ".join(odd_rows.prose(i % 60, 40))) for i in range(600)]
    docs = spark.createDataFrame(rows, TEXTS).repartition(4)
    dealt = blocks.in_blocks(docs, "doc_id", "text", blocks.Layout(16, 16)).where("doc_id is null")
    sizes = [r["count"] for r in dealt.groupBy("block").count().collect()]
    assert len(sizes) > 10 and max(sizes) <= 60
    found = substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, odd_rows.substring_dedup(rows)))
    joined = jaccard.join_components(docs)
    assert sorted(map(repr, map(tuple, joined.collect()))) == sorted(map(repr, odd_rows.jaccard_components(rows)))
    cut = suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", F.size("removed"), F.sha2("kept", 256))
    assert sorted(map(repr, map(tuple, cut.collect()))) == sorted(map(repr, odd_rows.byte_dedup(rows)))


def template_texts(count):
    """Texts of 40 words with four slots that are filled from 30 words, hardly any of them linked."""
    chosen, base = random.Random(9), odd_rows.prose(200, 40)
    rows = []
    for i in range(count):
        text = list(base)
        for slot in (4, 14, 24, 34):
            text[slot] = f"fill{chosen.randrange(30)}"
        rows.append((i, " ".join(text)))
    return rows


def test_template_texts_are_hardly_compared(spark, monkeypatch):
    """Pairs of which sets are joined, not those that merely meet in a list."""
    seen = []
    compared = jaccard.compared

    def counting(pairs, *rest):
        seen.append(pairs.count())
        return compared(pairs, *rest)

    monkeypatch.setattr(jaccard, "compared", counting)
    counts = []
    for size in (400, 1200):
        rows = template_texts(size)
        seen.clear()
        found = jaccard.join_components(spark.createDataFrame(rows, TEXTS).repartition(3))
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, odd_rows.jaccard_components(rows)))
        counts.append(sum(seen))
    assert counts[1] <= 4 * counts[0] and counts[1] < 3 * 1200


def test_equal_and_repetitive_items(spark):
    """A passage that 3,000 items hold, alone and within other words, is one entry of the index."""
    passage = odd_rows.prose(300, 30)
    items = [(i, " ".join(passage)) for i in range(2000)]
    items += [(5000 + i, " ".join([f"x{i}", "y"] + passage)) for i in range(1000)]
    items += [(9000, "la " * 400), (9001, "short one"), (9002, "short one")]
    docs = [(1, " ".join(passage * 60)), (2, "la " * 3000), (3, "a short one here"), (4, " ".join(odd_rows.prose(301, 300)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_items(spark.createDataFrame(docs, TEXTS), bench).collect()
    got = sorted((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["hits"]), r["items"]) for r in found)
    assert got == sorted(odd_rows.contamination(docs, items))
    listed, slices = decontaminate.sliced(bench, "item_id", "text", decontaminate.SLICE_BYTES)
    assert slices == 1 and listed.count() == 1003
    part = listed.toArrow()
    index = decontaminate.build_index(part["names"].to_pylist(), part["text"], 5, 10)
    assert len(index.prints) < 6000 and np.max(np.unique(index.prints, return_counts=True)[1]) < 1100


def test_items_of_one_text_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "NAMES", 50)
    passage = " ".join(odd_rows.prose(300, 30))
    items = [(i, passage) for i in range(400)] + [(None, passage), (1, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(1, "before " + passage), (2, "none"), (2, "none"), (None, passage)]
    for slice_bytes in (decontaminate.SLICE_BYTES, 2000):
        found = decontaminate.find_items(spark.createDataFrame(docs, TEXTS), bench, slice_bytes=slice_bytes).collect()
        got = [(r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["hits"]), r["items"]) for r in found]
        assert sorted(map(repr, got)) == sorted(map(repr, odd_rows.contamination(docs, items)))
        clean = decontaminate.keep_clean(spark.createDataFrame(docs, TEXTS), bench, slice_bytes=slice_bytes)
        assert [r["doc_id"] for r in clean.collect()] == [2, 2]


def test_long_urls_with_many_folders(spark):
    deep = "/".join(f"d{i}" for i in range(8000))
    host = ".".join(f"h{i}" for i in range(300)) + ".example.com"
    urls = [(1, f"http://{host}/{deep}"), (2, f"http://a.net/{deep}/x"), (3, "http://" + "a" * 65_000 + ".com/"), (4, f"http://b.org/{'/' * 30_000}")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    listed = [("example.com", "/d0/d1/", "block"), ("net", "/", "block"), ("a.net", "/" + "/".join(f"d{i}" for i in range(3000)) + "/", "allow"), ("org", "//", "block")]
    rules = spark.createDataFrame(listed, "host string, path string, verdict string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, rules).collect()} == {1: "block", 2: "allow", 3: "allow", 4: "block"}


def test_licenses_come_by_fingerprints(spark):
    """At the coverage in use, whole and slightly changed notices are led to by the index of fingerprints."""
    filler = odd_rows.prose(400, 30)
    rows, expected = [], []
    for i, (name, text) in enumerate(license_scan.TEMPLATES):
        w = text.split()
        rows.append((i, " ".join(filler + w + filler)))
        expected.append((i, name))
        if len(w) >= 16:
            rows.append((100 + i, " ".join(filler + w[:7] + ["otherword"] + w[8:] + filler)))
            expected.append((100 + i, name))
    docs = spark.createDataFrame(rows, TEXTS)
    found = license_scan.scan_licenses(docs).select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*").collect()
    by = {(r["doc_id"], r["license"]): r["by"] for r in found}
    assert all(by[key] == "fingerprint" for key in expected)
    broken = spark.createDataFrame([(1, "released under an mit license")], TEXTS)
    assert [m["by"] for r in license_scan.scan_licenses(broken).collect() for m in r["matches"]] == ["word"]
