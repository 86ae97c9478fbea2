"""The query functions against plain Python, and cases that every operator and stage has to take."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lexmill.llm import decontaminate, embedding_dedup, html_extract, license_scan, mixing, quality, queries, sharding, simhash, toxicity, url_filter

from ..oracle import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet").collect()


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_op3(spark):
    got = {r.doc_id: r for r in queries.op3_sharding(spark, DATA).collect()}
    docs = table(spark, "documents")
    assert len(got) == len(docs)
    sums, places = Counter(), {}
    for d in docs:
        r, raw = got[d.doc_id], (d.text or "").encode()
        assert (r.size, r.text_crc32, r["law"], r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        sums[r.shard] += r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert set(sums) == set(range(16)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(sums.values()) - min(sums.values()) <= max(r.size for r in got.values())


def plain_licenses(text):
    """Labels and score by places of words, without an automaton or a stack."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    hold = {**license_scan.NOTICES, **license_scan.BASE}
    starts = {p: [k for k in range(len(words)) if words[k:k + len(p.split())] == p.split()] for p in hold}
    labels = {hold[p] for p, at in starts.items() if at}
    base = sorted(k for p in license_scan.BASE for k in starts[p])
    return words, base, {license_scan.BASE[p] for p in license_scan.BASE if starts[p]}, labels


def test_op5(spark):
    got = {r.doc_id: r for r in queries.op5_license_scan(spark, DATA).collect()}
    seen = Counter()
    for d in table(spark, "documents"):
        r = got[d.doc_id]
        words, base, base_labels, labels = plain_licenses(d.text)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(base), base[0] if base else None, base[-1] if base else None)
        assert r.base_labels == ",".join(sorted(base_labels))
        tagged = re.findall(r"(?i)SPDX-License-Identifier[^0-9a-z\\x80-\U0010ffff]*([0-9A-Za-z.+-]+)", d.text or "")
        labels |= {t.lower().rstrip("+.") for t in tagged}
        assert set(filter(None, r.labels.split(","))) >= labels and (tagged or r.labels == ",".join(sorted(labels)))
        if not tagged:
            assert r.score == max((license_scan.burden(x) for x in labels), default=0)
        seen.update(labels)
    assert seen


def test_op6(spark):
    got = {r.doc_id: r for r in queries.op6_simhash(spark, DATA).collect()}
    fps = {}
    for d in table(spark, "documents"):
        words = WORD.findall(low(d.text))
        shingles = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        counts = Counter(b for s in shingles for b, bit in enumerate(bin(xxhash.xxh64_intdigest(s.encode(), 42))[2:].zfill(64)) if bit == "1")
        fps[d.doc_id] = int("".join("1" if 2 * counts[b] > len(shingles) else "0" for b in range(64)), 2)
    root = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if i < j and (fps[i] ^ fps[j]).bit_count() <= 2 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{f:016x}", root[i]) for i, f in fps.items()}


def test_op8(spark):
    """On these pages the article is one element, whose paragraphs are cut out by pattern."""
    import html

    got = {r.page_id: r for r in queries.op8_html_extraction(spark, DATA).collect()}
    for p in table(spark, "pages"):
        inner = re.search(r"(?s)<article>(.*?)(?:</article>|$)", p.html)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n\n".join(filter(None, parts))
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (want, len(want), p.url)


def test_op9(spark):
    docs = table(spark, "documents")
    label = {r.doc_id: r.quality for r in table(spark, "labels")}
    got = {r.doc_id: r for r in queries.op9_quality(spark, DATA).collect()}
    model = quality.fit(spark.read.parquet(f"{DATA}/documents.parquet"))
    assert sum(got[i].keep != bool(q) for i, q in label.items()) <= 0.01 * len(label)  # no labels are read in training
    for d in docs:
        s = quality.stats(d.text)
        z = model.bias + math.fsum(model.weights[i] * v for i, v in quality.features(s, d.text).items()) if s.words else -math.inf
        assert got[d.doc_id].score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))) if s.words else 0, abs=1e-9)


def test_op10(spark):
    label = {r.doc_id: r.toxic for r in table(spark, "labels")}
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    got = {r.doc_id: r for r in queries.op10_toxicity(spark, DATA).collect()}
    chain = toxicity.fit(docs, labels)
    assert chain.held_out_errors < sum(label.values()) / len(label)  # better than to call nothing toxic
    for d in table(spark, "documents"):
        present, p = {chain.used[i] for i in toxicity.word_features(d.text) if i in chain.used}, []
        for weights, bias, earlier in chain.models:
            p.append(1 / (1 + math.exp(-(bias + sum(weights[k] for k in present) + sum(w * x for w, x in zip(earlier, p))))))
        r = got[d.doc_id]
        assert [r.p_toxic, r.p_repeated, r.p_varied] == pytest.approx(p, abs=1e-6) and r.toxic == (r.p_toxic > 0.5)
    assert not any(got[i].toxic for i, t in label.items() if not t)
    assert sum(got[i].toxic for i, t in label.items() if t) > 0.5 * sum(label.values())  # so few labels tell few words


# ---- cases of every operator: null, empty, very long, tied, repeated, clashing ------------------------

LONG = " ".join(f"word{k % 977} and" for k in range(90_000))  # about 1 MB
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta.", "a"), (1, "Alpha beta gamma delta epsilon zeta eta theta.", "a"), (2, "", "a"), (3, None, None), (None, None, "b"), (None, "Beta only here", None),
    (4, LONG, "b"), (5, "Alpha beta gamma delta epsilon zeta eta theta.", "b"), (6, " \n\t ", "a"), (7, "Other words of the same length as before.", "a"), (8, "Other words of the same length as after.", "a"),
]
CLASH = "toxic, quality_score, _tk, _gone, leaked, _p, lexmill_leaked, lexmill_key, lexmill_copies, lexmill_quality, lexmill_p, lexmill_gone, row_key, h, size, copies, place"


def frames(spark):
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    more = docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASH.split(", "))))
    labels = spark.createDataFrame([(1, 1, 1), (7, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(0, "gamma delta epsilon zeta eta theta"), (1, None), (2, "")], "item_id long, text string")
    return docs, more, labels, items


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


OPERATORS = {
    "mixing": lambda d, labels, items: mixing.mix_sources(d).select("doc_id", "size", "source_size", "target", "taken"),
    "sharding": lambda d, labels, items: sharding.with_slots(d).select("doc_id", "size", "text_crc32"),
    "licenses": lambda d, labels, items: license_scan.scan_licenses(d),
    "simhash": lambda d, labels, items: simhash.simhash_groups(d),
    "decontamination": lambda d, labels, items: decontaminate.contaminated(d, items),
    "quality": lambda d, labels, items: quality.classify(d).selectExpr("doc_id", "round(`" + ("quality_score_" if "quality_score" in d.columns else "quality_score") + "`, 9)"),
    "toxicity": lambda d, labels, items: toxicity.classify(d, labels).selectExpr("doc_id", "round(p_toxic, 9)", "toxic_" if "toxic" in d.columns else "toxic"),
    "pages": lambda d, labels, items: html_extract.extract_articles(d, url_col="source", html_col="text", id_col="doc_id"),
    "urls": lambda d, labels, items: url_filter.filter_urls(d, url_col="source", html_col="text", id_col="doc_id"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators_take_every_case(spark, name):
    docs, more, labels, items = frames(spark)
    run = OPERATORS[name]
    got = rows_of(run(docs, labels, items))
    assert got == rows_of(run(more, labels, items)) == rows_of(run(docs.repartition(3), labels, items))
    if name != "decontamination":
        assert sum(got.values()) == len(ROWS)
    else:
        assert {(r[0], r[1]) for r in got} == {(1, 0), (5, 0)}
    assert run(docs.where("false"), labels, items).count() == 0
    if name in ("toxicity", "decontamination"):
        assert run(docs, labels.where("false"), items.where("false")).count() == (0 if name == "decontamination" else len(ROWS))


def test_vectors_take_every_case(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0), (3, None, 0), (None, [1.0, 0.0], 0), (4, [1.0, 0.0], None), (5, [0.0, 0.0], 0), (6, [1.0] * 100_000, 0)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, cid long, k1 long")
    got = Counter(map(tuple, embedding_dedup.near_duplicates(frame).collect()))
    assert got == Counter([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (None, 0, None, False), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True)])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_every_case(spark, tmp_path, name):
    docs, more, _, items = frames(spark)
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    stage, folder = dict(corpus_pipeline.STAGES)[name], str(tmp_path)
    plain, wide = stage(spark, docs, folder), stage(spark, more, folder)
    if name == "sharding":
        assert sorted((r.doc_id is None, r.doc_id, r.size) for r in plain.collect()) == sorted((r.doc_id is None, r.doc_id, r.size) for r in wide.collect()) and plain.count() == len(ROWS)
        return
    assert plain.columns == docs.columns and wide.columns == more.columns
    got = rows_of(plain)
    assert got == rows_of(wide.select(docs.columns))
    assert all(tuple(r)[len(docs.columns):] == tuple(range(len(CLASH.split(", ")))) for r in wide.collect())
    ids = sorted((i is None, i or 0) for i, *_ in got.elements())
    if name == "quality":
        assert all(r[1] and r[1].strip() for r in got) and sum(got.values()) == len(plain_kept())
    elif name == "near_dedup":
        assert ids == [(False, 1), (False, 2), (False, 4), (False, 7), (False, 8), (True, 0)]
    elif name == "decontamination":
        assert ids == sorted((i is None, i or 0) for i, t, _ in ROWS if i not in (1, 5))
    elif name == "mixing":
        assert all((r[1] or "").strip() for r in got)
    assert stage(spark, docs.where("false"), folder).count() == 0


def plain_kept():
    """Rows with words: this table holds no junk."""
    return [t for _, t, _ in ROWS if t and t.strip() and t is not LONG]
