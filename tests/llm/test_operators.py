"""Small cases and brute force for the ten operators."""

from __future__ import annotations

import random
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexmill.llm import components, decontaminate, embedding_dedup, html_extract, license_scan, mixing, quality, sharding, simhash, toxicity, url_filter
from lexmill.llm.common import Scratch, groups_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rule string, shard int, copies long, fp long"


def docs_of(spark, rows):
    """Rows (doc_id, text, source) with columns whose names operators use too."""
    return spark.createDataFrame([(i, t, "en", s, None, "x", 1, 2, 3) for i, t, s in rows], DOCS)


ODD = [(1, "Alpha beta gamma delta epsilon zeta.", "a"), (1, "Alpha beta gamma delta epsilon zeta.", "a"), (None, None, None), (2, "", "b"), (3, "word " * 30_000, "b"), (4, None, "a"), (None, "Beta only here", None)]


# ---- components --------------------------------------------------------------


def brute_components(edges):
    low = {}
    for a, b in edges:
        low.setdefault(a, a)
        low.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(low[a], low[b])
            for x in (a, b):
                if low[x] != m:
                    low[x], changed = m, True
    return low


@pytest.mark.parametrize("kind", ["path", "star", "random"])
def test_components(spark, kind):
    rng = random.Random(4)
    edges = {"path": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 80)], "random": [(rng.randrange(90), rng.randrange(90)) for _ in range(60)]}[kind]
    frame = spark.createDataFrame([*edges, edges[0], (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(frame, Scratch(spark, "t")).collect()}
    want = brute_components([e for e in edges if e[0] != e[1]])
    assert got == want


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


# ---- 1 url filter ---------------------------------------------------------------


def test_url_rules_and_aliases(spark):
    canonical = '<link rel="canonical" href="{}">'.format
    rows = [
        (1, "https://WWW.Example.com/en/5?x#y", None), (2, "http://example.com/en/70", ""), (3, "http://a.net/de/1", "x"), (4, "http://m.example.net/de/8", "x"), (5, "ftp://b.org/es/", "x"),
        (6, "http://alias.io/p", canonical("http://b.org/es/q")), (7, "http://next.io/", canonical("http://alias.io/p#top")), (8, "http://mixed.io/", canonical("http://c.com/en/1")),
        (9, "http://allowed.example.com/en/71", canonical("http://mixed.io/")), (10, None, "x"), (11, "no scheme", "x"), (12, "http://notcom/en/1", "x"), (12, "http://notcom/en/1", "x"),
    ]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, verdict string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    verdicts = {k: (r.rule, r.verdict) for k, r in got.items()}
    assert verdicts == {
        1: ("com/en/", "block"), 2: ("example.com/en/7", "allow"), 3: ("net/de/", "allow"), 4: ("example.net/de/8", "block"), 5: ("org/es/", "block"), 6: (None, "block"), 7: (None, "block"),
        8: (None, "allow"), 9: ("example.com/en/7", "allow"), 10: (None, "allow"), 11: (None, "allow"), 12: (None, "allow"),
    }
    assert (got[1].host, got[1].path) == ("www.example.com", "/en/5") and (got[10].host, got[11].path) == ("", "")
    assert url_filter.filter_urls(pages.where("false")).count() == 0
    assert url_filter.filter_urls(pages).count() == len(rows)


LINKS = [  # page, html, urls that it is joined with
    ("http://q.io/a/b/p?x=1", '<LINK REL="shortlink Canonical" HREF="../r?k=1&amp;m=2#f">', ["http://q.io/a/r?k=1&m=2"]),
    ("http://q.io/a/p", "<link rel=canonical href=/x><link href='//o.net/y' rel='canonical'>", ["http://q.io/x", "http://o.net/y"]),
    ("http://q.io/a/p?n=1", '<link rel="canonical" href="?id=3"><link rel="canonical" href="#"><link rel="canonical" href="">', ["http://q.io/a/p?id=3"]),
    ("http://q.io/p", '<!-- <link rel="canonical" href="http://b.org/es/"> --><script>"<link rel=canonical href=/s>"</script>', []),
    ("http://q.io", '<meta http-equiv="Refresh" content="5; URL=\'n/./m/..\'"><meta http-equiv=refresh content="9">', ["http://q.io/n/"]),
    ("http://q.io/p", '<base href="/deep/er/"><link title="a > b" rel="canonical" href="../up">', ["http://q.io/deep/up"]),
    ("http://q.io/p", '<link rel="canonical" href="mailto:x@y"><link rel="stylesheet canonicals" href="/c"><link data-rel="canonical" href="/d">', []),
    ("no scheme", '<link rel="canonical" href="http://b.org/es/">', []), ("http://q.io/p", None, []),
]


def test_page_links(spark):
    frame = spark.createDataFrame([(u, h) for u, h, _ in LINKS], "url string, html string")
    got = sorted((r.a, r.b) for r in url_filter.page_links(frame).collect())
    assert got == sorted((u, b) for u, _, found in LINKS for b in found)


def test_longest_rule_by_its_whole_length(spark, monkeypatch):
    rules = [("block", "a.com", "/"), ("allow", "com", "/long/path")]
    frame = spark.createDataFrame([("x.a.com", "/long/path/1"), ("a.com", "/lon")], "host string, path string")
    for limit in (256, 0):
        monkeypatch.setattr(url_filter, "RULES_IN_PLACE", limit)
        assert {r.path: r.rule_verdict for r in url_filter.with_rules(frame, rules).collect()} == {"/long/path/1": "allow", "/lon": "block"}


def test_many_rules_are_joined(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://a.example.com/en/7", ""), (2, "http://x.org/", "")], "page_id long, url string, html string")
    before = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect()}
    monkeypatch.setattr(url_filter, "RULES_IN_PLACE", 0)
    assert {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect()} == before


# ---- 2 mixing --------------------------------------------------------------------


def test_mix_targets_and_limits(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 400), rng.choice(["a", "b", "c", "d", None])) for i in range(600)] + [(1000 + i, "w " * 10, "tiny") for i in range(4)]
    got = mixing.mix_sources(docs_of(spark, rows)).collect()
    sizes, targets, taken = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        targets[r.source] = r.target
        assert r.source_size == sum(len(t.split()) for _, t, s in rows if s == r.source)
        assert r.taken % r.size == 0 and r.taken <= 3 * r.size
    assert targets["tiny"] == 120
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    free = [s for s in targets if targets[s] < 3 * sizes[s]]
    weights = dict(zip(["a", "b", "c", "d", "tiny", None], [1, 2, 3, 1, 2, 3]))
    assert len({round(targets[s] / weights[s], 6) for s in free}) == 1
    for s in targets:
        assert abs(taken[s] - targets[s]) <= max(5, 0.001 * targets[s])
    again = mixing.mix_sources(docs_of(spark, rows).repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_mix_odd_rows(spark):
    got = mixing.mix_sources(docs_of(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r.taken == 0 for r in got if not r.size)
    assert mixing.mix_sources(docs_of(spark, [])).count() == 0
    assert all(r.taken == 0 and r.target == 0 for r in mixing.mix_sources(docs_of(spark, [(1, None, "a"), (2, "", None)])).collect())


def test_equal_rows_are_taken_one_by_one(spark):
    same = [(7, "w " * 50, "a")] * 40 + [(None, "v " * 50, "a")] * 40
    rows = [*same, *((100 + i, "u " * 40, "b") for i in range(100))]
    got = mixing.mix_sources(docs_of(spark, rows).repartition(5)).collect()
    taken = {s: sum(r.taken for r in got if r.source == s) for s in "ab"}
    target = {r.source: r.target for r in got}
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 50 for s in taken), (taken, target)
    kept = mixing.mix_sources(docs_of(spark, rows), keep=["doc_id", "text"], copies_name="n").collect()
    assert sum(r.n * len(r.text.split()) for r in kept) == sum(taken.values())


def test_inclusion_follows_probability(spark):
    rows = [(i, "w " * (8 if i % 2 else 6000), "a" if i < 400 else "b") for i in range(800)]
    got = mixing.mix_sources(docs_of(spark, rows)).where("source = 'a'").collect()
    rate = lambda rs: sum(r.copies for r in rs) / len(rs)
    assert rate([r for r in got if r.size == 8]) > rate([r for r in got if r.size > 8])


# ---- 3 sharding --------------------------------------------------------------------


def test_shards(spark):
    rng = random.Random(3)
    rows = [(i, "é" * rng.randrange(0, 900), "a") for i in range(3000)]
    got = sharding.shard_by_slots(docs_of(spark, [*rows, *ODD[:4]]), 16).collect()
    assert len(got) == 3004
    text = {i: t for i, t, _ in rows}
    for r in got[:200]:
        if r.doc_id in text and r.doc_id > 4:
            raw = text[r.doc_id].encode()
            assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    sums, places = {}, {}
    for r in got:
        sums[r.shard] = sums.get(r.shard, 0) + r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert max(sums.values()) - min(sums.values()) < 0.01 * sum(sums.values()) / 16
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sharding.shard_by_slots(docs_of(spark, [])).count() == 0


def test_repeated_rows_are_spread_over_shards(spark):
    rows = [(i, "x" * 60, "a") for i in range(2000)] + [(5, "y" * 60, "a")] * 2000
    got = sharding.shard_by_slots(docs_of(spark, rows), 16).collect()
    sums = [sum(r.size for r in got if r.shard == s) for s in range(16)]
    assert max(sums) - min(sums) < 0.02 * sum(sums) / 16
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(16))


def test_maps_are_stored_and_taken_up(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    docs = docs_of(spark, [(i, "x" * (i % 90), "a") for i in range(500)])
    first = sharding.shard_by_slots(docs, 4, map_path=path).collect()
    assert {r.map_version for r in first} == {1}
    again = sharding.shard_by_slots(docs, 4, map_path=path).collect()
    assert {r.map_version for r in again} == {2} and {(r.doc_id, r.vslot) for r in again} == {(r.doc_id, r.vslot) for r in first}
    stored = sharding.SlotMap.load(spark, path)
    assert len(stored.shards) == 3 and stored.n_shards == 4
    stored.move(7, 3)
    stored.save(spark, path)
    stored.grow()
    stored.save(spark, path)
    last = sharding.SlotMap.load(spark, path)
    assert (last.n_shards, last.shards[3][7], len(last.shards)) == (5, 3, 5) and last.shards == stored.shards
    with pytest.raises(ValueError):
        sharding.shard_by_slots(docs, 4, map_path=path)


def test_growing_moves_into_the_new_shard_alone():
    m = sharding.SlotMap(16)
    v = m.grow()
    moved = [(a, b) for a, b in zip(m.shards[0], m.shards[v]) if a != b]
    assert {b for _, b in moved} == {16} and abs(len(moved) - 4096 / 17) < 20


# ---- 4 embeddings ---------------------------------------------------------------------


def brute_links(rows, least=0.98):
    out = {}
    ok = [(i, np.array(v, float), label) for i, v, label in rows if v and label is not None and i is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for k, (i, v, label) in enumerate(ok):
        linked = [j for n, (j, w, other) in enumerate(ok) if n != k and other == label and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= least]
        out.setdefault(i, []).append(linked)
    return out


@pytest.mark.parametrize("block", [1024, 8])
def test_embedding_links(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(160):
        base = rng.normal(size=12)
        rows.append((i * 3, base.tolist(), i % 3))
        for j in range(i % 3):
            rows.append((i * 3 + j + 1, ((base + rng.normal(size=12) * rng.choice([0, 0.03, 0.06, 0.1])) * rng.choice([1, 5])).tolist(), i % 3))
    rows += [(900, None, 1), (901, [0.0] * 12, 1), (902, [float("nan")] * 12, 1), (903, [1.0, None], 1), (904, [1.0] * 12, None), (905, [], 1), (906, [2.0] * 6, 1), (907, [2.0] * 6, 1)]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, label int, cid long")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame, recall=1.0).collect()}
    want = brute_links(rows)
    assert len(got) == len(rows)
    edges = [(i, j) for i, x in want.items() for j in x[0]]
    roots = brute_components(edges)
    for i, r in got.items():
        assert r.n_links == (len(want[i][0]) if i in want else 0), i
        assert r.component_id == roots.get(i, i) and r.kept == (r.component_id == i)
    assert embedding_dedup.near_duplicates(frame.where("false")).count() == 0


def test_recall_below_one_is_met(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(150, 16))
    rows = [(i, (base[i // 2] + rng.normal(size=16) * 0.05 * (i % 2)).tolist(), 0) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sum(r.n_links for r in embedding_dedup.near_duplicates(frame, recall=0.95).collect())
    want = sum(len(x[0]) for x in brute_links(rows).values())
    assert want and 0.9 * want <= got <= want


def test_cells_are_visited_from_the_nearest_on():
    rng = np.random.default_rng(7)
    for reach in (0.05, 0.5, 5.0):
        index = embedding_dedup.MultiIndex({}, reach)
        for _ in range(20):
            a, b = rng.random(9), rng.random(7)
            a[rng.integers(9)] = b[rng.integers(7)] = 0
            home = int(a.argmin() * 7 + b.argmin())
            got = index.visits(a, b, home)
            want = {i * 7 + j for i in range(9) for j in range(7) if a[i] + b[j] <= reach and i * 7 + j >= home}
            bounds = [a[c // 7] + b[c % 7] for c in got]
            assert set(got) == want | {home} and bounds == sorted(bounds)


# ---- 5 licences ------------------------------------------------------------------------


def brute_places(text, phrase):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).translate(license_scan.WORD_BYTES).split()
    p = phrase.encode().split()
    return [i for i in range(len(words)) if words[i:i + len(p)] == p], len(words)


def test_license_expressions_of_any_length():
    names = [f"name-{k}" for k in range(2000)]
    line = "SPDX-License-Identifier: " + " AND ".join([*names, "GPL-3.0"])
    got = license_scan.scan(line + "\nOR other", license_scan.automaton({license_scan.TAG: "tag"}))
    assert got["labels"].split(",") == sorted([*names, "gpl-3.0"]) and got["score"] == license_scan.burden("gpl-3.0")


def test_license_places(spark):
    texts = [
        "CC-BY cc by CC BY", "all rights reserved. All rights reserved", "GNU General Public License", "all all rights reserved", "ccby", None, "", "Über cc by ÉTÉ", "cc by " * 20_000,
        "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 WITH LLVM-exception\nmore",
    ]
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs_of(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        places = {label: brute_places(t, phrase)[0] for phrase, label in license_scan.BASE.items()}
        every = sorted(sum(places.values(), []))
        r = got[i]
        assert (r.n_base, r.n_words, r.base_labels) == (len(every), brute_places(t, "x")[1], ",".join(sorted(k for k, v in places.items() if v)))
        assert (r.first_word, r.last_word) == ((every[0], every[-1]) if every else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[9].labels == "apache-2.0,gpl-2.0-only,mit" and got[9].score == pytest.approx(0.1)


@pytest.mark.parametrize(
    "text, want",
    [("MIT", {"mit"}), ("MIT OR Apache-2.0", {"mit", "apache-2.0"}), ("(MIT AND (BSD OR GPL-3.0+))", {"mit", "bsd", "gpl-3.0"}), ("OR MIT", None), ("", None), ("MIT OR", {"mit"}), ("(MIT", None), ("MIT) x", {"mit"})],
)
def test_expressions(text, want):
    got = license_scan.evaluate(text)
    assert (got and got[0]) == want


def test_expression_weights():
    weight = lambda x: license_scan.evaluate(x)[1]
    assert weight("MIT OR GPL-2.0") == weight("MIT") < weight("MIT AND GPL-2.0") == weight("GPL-2.0")
    assert weight("GPL-2.0 WITH Classpath-exception") == pytest.approx(weight("GPL-2.0") / 2)
    assert weight("MIT OR GPL-2.0 AND reserved") == weight("MIT")


# ---- 6 simhash -------------------------------------------------------------------------


def plain_fingerprint(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    shingles = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_fingerprints():
    for t in ("The cat sat on the mat", "two words", "ÉTÉ Été", "", None, "a b c\x0bd", "x " * 3000):
        assert simhash.fingerprint(t, 3) & (1 << 64) - 1 == plain_fingerprint(t)


def test_bit_planes():
    rng = random.Random(8)
    fps = [rng.getrandbits(64) for _ in range(70)]
    fps += [f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for f in fps]
    signed = np.array([x - (1 << 64) if x >> 63 else x for x in fps], np.int64)
    planes = simhash.BitPlanes(signed)
    for radius in (0, 1, 2, 3, 8):
        for q in fps[:20]:
            want = sum(1 << i for i, f in enumerate(fps) if (f ^ q).bit_count() <= radius)
            assert planes.within(q - (1 << 64) if q >> 63 else q, radius) == want


@pytest.mark.parametrize("block", [4096, 6])
def test_simhash_links(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(9)
    fps = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(6):
            fps.add(f)
            f ^= 1 << rng.randrange(64)
            f ^= (1 << rng.randrange(64)) * rng.randrange(2)
    fps |= {1, 3, 7, 15, 31}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    scratch = Scratch(spark, "t")
    roots = {r.node: r.root for r in components.connected_components(simhash.links(frame, scratch, 2), scratch).collect()}
    pairs = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    assert roots == brute_components(pairs)


def test_simhash_groups(spark):
    rows = [*ODD, (9, "Alpha beta gamma delta epsilon zeta.", "a"), (8, "Something else entirely, which stands alone", "a")]
    got = simhash.simhash_groups(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[9].component_id == 1 and by[8].component_id == 8 and by[2].fp == 0 and by[4].component_id == 2
    assert simhash.simhash_groups(docs_of(spark, [])).count() == 0


def jaccard(a, b, width=5):
    x, y = (set(simhash.shingle_hashes(t, width).tolist()) for t in (a, b))
    return 1.0 if not x and not y else len(x & y) / len(x | y) if x | y else 0


@pytest.mark.parametrize("block", [256, 2])
def test_one_of_each_group(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "SET_BLOCK", block)
    rng = random.Random(10)
    texts = []
    for _ in range(25):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(60, 200))]
        texts.append(" ".join(words))
        for _ in range(3):
            again = list(words)
            for _ in range(rng.choice([0, 1, 2, 30])):
                again[rng.randrange(len(again))] = f"n{rng.randrange(9000)}"
            texts.append(" ".join(again))
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    low = brute_components([(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8])
    want = {i for i in range(len(texts)) if low.get(i, i) == i}
    kept = simhash.one_of_each_group(docs_of(spark, rows))
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs_of(spark, []).columns
    odd = simhash.one_of_each_group(docs_of(spark, ODD)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in odd) == [(False, 1), (False, 2), (False, 3), (True, 0)]
    assert simhash.one_of_each_group(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("block", [1024, 2])
def test_one_of_each_group_misses_no_pair(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "SMALL_BLOCK", block)
    rng = random.Random(21)
    word = lambda: f"w{int(3000 ** rng.random())}"
    texts = []
    for k in range(60):
        words = [word() for _ in range(rng.choice([14, 20, 60, 200]))]
        more = [word() for _ in range(len(words) // 5)]
        changed = [words + more, more + words, words[:-1] + ["other"], words[len(words) // 6:]][k % 4]
        texts += [" ".join(words), " ".join(changed)]
    texts += [f"the same notice stands in each of these short texts but for the last number {k}" for k in range(12)]
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    low = brute_components([(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8])
    want = {i for i in range(len(texts)) if low.get(i, i) == i}
    assert {r.doc_id for r in simhash.one_of_each_group(docs_of(spark, rows)).collect()} == want


# ---- 7 decontamination --------------------------------------------------------------------


@pytest.mark.parametrize("limit", [200_000, 120])
def test_contained_items(spark, limit):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(500)}"
    items = [(k, " ".join(word() for _ in range(rng.randrange(1, 40)))) for k in range(30)] + [(30, None), (31, ""), (32, "..."), (33, "lone phrase"), (34, "lone phrase")]
    rows = []
    for i in range(60):
        words = [word() for _ in range(rng.randrange(0, 300))]
        if i % 2:
            item = items[i % 30][1].split()
            for _ in range(i % 3):
                item[rng.randrange(len(item))] = word()
            words[len(words) // 2:len(words) // 2] = item
        rows.append((i, (", " if i % 5 else "\n").join(words).upper(), "a"))
    rows += [(60, "a Lone, phrase! here", "a"), (61, None, "a"), (62, "", "a"), (60, "a Lone, phrase! here", "a"), (None, "lone phrase", "a")]

    def split(t):
        return __import__("re").findall(r"[^\W_]+", (t or "").lower())

    def shingles(words, width):
        return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}

    want = set()
    for i, t, _ in rows:
        for k, x in items:
            if w := split(x):
                width = min(5, len(w))
                own = shingles(w, width)
                shared = len(own & shingles(split(t), width))
                if shared / len(own) >= 0.8:
                    want.add((i, k, shared))
    docs, bench = docs_of(spark, rows), spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, shared string")
    got = decontaminate.contaminated(docs, bench, block_shingles=limit).collect()
    assert {(r.doc_id, r.item_id, r.shared) for r in got} == want and len(got) == len(want) > 10
    left = decontaminate.without_items(docs, bench, block_shingles=limit)
    assert sorted(map(str, (r.doc_id for r in left.collect()))) == sorted(str(i) for i, _, _ in rows if i not in {w[0] for w in want})
    assert left.columns == docs.columns
    assert decontaminate.contaminated(docs.where("false"), bench).count() == decontaminate.contaminated(docs, bench.where("false")).count() == 0


# ---- 8 html ---------------------------------------------------------------------------------


def page(k, body, nav="<nav><a href='/'>Home</a></nav>"):
    return f"<html><head><title>t</title><script>var x='</p>'</script></head><body>{nav}{body}<footer>&copy; host</footer></body></html>"


def test_html(spark):
    same = '<div class="wrap"><span>Follow us</span></div>'
    rows = [(k, f"http://h.example/{k}", page(k, f"{same}<div><p>Text &amp; more {k}<br>line</div><div>tail\n {k}</div>")) for k in range(12)]
    rows += [
        (20, "http://x/1", page(0, "<article><h1>Head</h1><p><b>One<br><p>Two &lt;b&gt;</p><aside>no</aside><div id='comments'>no</div><p>Cut of")[:-60]), (21, "http://x/2", None), (22, None, ""), (23, "http://x/3", "plain < text &amp"),
        (24, "http://x/4", "<p>a<p>b<ul><li>c<li>d</ul><table><tr><td>e<td>f</table><form>no</form><!-- no -->"),
    ]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    for limit in (100_000, 0):
        got = {r.page_id: r for r in html_extract.extract_articles(pages, broadcast_rows=limit).collect()}
        assert len(got) == len(rows)
        for k in range(12):
            assert got[k].text == f"Text & more {k} line\n\ntail {k}"
        assert got[20].text.startswith("Head\n\nOne\n\nTwo <b>") and "no" not in got[20].text.split()
        assert (got[21].text, got[22].text, got[22].n_chars) == ("", "", 0)
        assert got[23].text == "plain < text &"
        assert got[24].text == "a\n\nb\n\nc\n\nd\n\ne f"
        assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_extract.extract_articles(pages.where("false")).count() == 0


def test_articles_are_no_templates(spark):
    rows = [(k, f"http://h/{k}", page(k, "<article><h1>Same</h1><p>Same text</p><div class='box'>Subscribe now</div></article>")) for k in range(10)]
    got = html_extract.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"Same\n\nSame text"}


def test_rare_templates_of_hot_hosts(spark):
    rows = [(k, f"http://hot/{k}", f"<body><div><p>Text {k} of its own</p></div>{'<div class=\"box\">Read our other section</div>' if k % 50 == 0 else ''}</body>") for k in range(400)]
    got = html_extract.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {k: f"Text {k} of its own" for k in range(400)}


RULINGS = [
    ('<body><article><header><h1>Head</h1><p>Lead</p></header><p class="form">Form</p><section class="related-work">Work</section></article>', "Head\n\nLead\n\nForm\n\nWork"),
    ('<body><header>Site</header><article>Text</article><article class="comment">Reader</article><section id="comments"><article>More</article></section>', "Text"),
    ('<body><article>Text<div class="ad">Buy</div><aside>Note</aside><p>End</article><div class="x">Beside</div>bare', "Text\n\nEnd"),
    ('<body><div class="sidebar-left">Menu words</div><div id="content"><p>First paragraph of text.<p>Second</div><div class="cookie-bar">Accept</div>', "First paragraph of text.\n\nSecond"),
    ('<div class="newsletter"><p>All of this page is in one part.</div>', "All of this page is in one part."),
]


@pytest.mark.parametrize("html, want", RULINGS)
def test_markup_decides_on_small_hosts(html, want):
    assert html_extract.extract(html, ()) == want


def site(rng, n_hosts=4, n_pages=14):
    """Pages built of parts, with the text of their articles."""
    words = [f"w{k}" for k in range(200)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = []
    for host in range(n_hosts):
        tag, parts = rng.choice(["article", "main", "div"]), rng.sample(["menu", "ad", "box", "foot"], 3)
        for k in range(n_pages):
            told = [say(rng.randrange(12, 40)) for _ in range(rng.randrange(2, 6))]
            made = {
                "menu": f"<ul class='m1'>{''.join(f'<li><a href=/{say(1)}>{say(1)}</a>' for _ in range(rng.randrange(2, 7)))}</ul>", "ad": f"<div class='promo-{k}'><b>{say(3)}</b> {say(4)}</div>",
                "box": f"<div><div class='b'><span>{say(5)}</span></div></div>", "foot": f"<div id='f'>{say(2)}<br>{say(6)}</div>",
            }
            beside = [made[x] for x in parts]
            out.append((f"http://h{host}.example/{k}", f"<body>{beside[0]}<{tag} id='c{k}'>{''.join(f'<p>{t}' for t in told)}</{tag}>{beside[1]}{beside[2]}</body>", "\n\n".join(told)))
    return out


def test_sites_against_what_they_were_built_of(spark):
    made = site(random.Random(31))
    frame = spark.createDataFrame([(k, u, h) for k, (u, h, _) in enumerate(made)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract_articles(frame).collect()}
    assert got == {k: t for k, (_, _, t) in enumerate(made)}
    changed = sum(html_extract.extract(h, {html_extract.PAGE}) != t for _, h, t in made)
    assert changed == len(made)  # it is the templates that find these texts
    counted = {(r.host, r.hash): r.n for r in html_extract.recurring(frame.selectExpr("split_part(url, '/', 3) AS host", "html")).collect()}
    plain = {}
    for u, h, _ in made:
        for x in html_extract.page_hashes(h):
            plain[u.split("/")[2], x] = plain.get((u.split("/")[2], x), 0) + 1
    assert counted == {k: n for k, n in plain.items() if n >= html_extract.MIN_PAGES}


def test_broken_pages_take_linear_time():
    for page in ("<div>" * 50 + "<p>x" + "</span>" * 150_000, "<div>" * 80_000 + "</em>" * 80_000, "<a>" * 150_000 + "x", "<p><b>" * 100_000):
        began = time.perf_counter()
        html_extract.extract(page, ())
        assert time.perf_counter() - began < 10


# ---- 9 quality ----------------------------------------------------------------------------------


def quality_corpus(n=240):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    rows, good = [], {}
    for i in range(n):
        words = [word() for _ in range(rng.randrange(30, 120))]
        kind = i % 8
        text = " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(words)).capitalize()
        if kind == 0:
            text = " ".join(w.upper() + "!!" for w in words)
        elif kind == 1:
            text = " | ".join(words)
        elif kind == 2:
            text = " ".join(w + rng.choice(["%%%", "###"]) for w in words)
        elif kind == 3:
            text = " ".join(" ".join([w] * 12) for w in words[:20])
        rows.append((i, text, "a"))
        good[i] = kind > 3
    return rows, good


def test_quality(spark):
    rows, good = quality_corpus()
    docs = docs_of(spark, [*rows, (900, None, "a"), (901, " \n", "a"), (None, rows[7][1], "a")])
    got = {r.doc_id: r.quality_score for r in quality.classify(docs).collect()}
    wrong = [i for i in good if (got[i] >= quality.THRESHOLD) != good[i]]
    assert len(wrong) <= 2 and got[900] == got[901] == 0 and got[None] >= quality.THRESHOLD
    assert quality.classify(docs_of(spark, [])).count() == 0
    model = quality.fit(docs)
    assert set(model.accuracies) == {name for name, _, _ in quality.LABELLERS} and all(0.5 < a < 1 for a in model.accuracies.values())


def test_repeated_rows_give_the_same_model(spark):
    rows, _ = quality_corpus(80)
    docs = docs_of(spark, rows * 3)
    a, b = (quality.fit(d, sample=50) for d in (docs, docs.repartition(7)))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_accuracies_are_recovered():
    rng = random.Random(13)
    n = len(quality.LABELLERS)
    right = [0.95, 0.9, 0.85, 0.8, 0.9, 0.75, 0.9, 0.85, 0.8][:n]
    counts = {}
    for _ in range(20_000):
        truth = quality.PROSE if rng.random() < 0.7 else quality.JUNK
        votes = [truth if rng.random() < a else 1 - truth for a in right]
        p = sum(v * 3**i for i, v in enumerate(votes))
        counts[p] = counts.get(p, 0) + 1
    _, found, share = quality.estimate(counts)
    assert share == pytest.approx(0.7, abs=0.05)
    assert [found[name] for name, _, _ in quality.LABELLERS] == pytest.approx(right, abs=0.05)


# ---- 10 toxicity ----------------------------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(14)
    bad = ["idiot", "scum", "moron", "trash"]
    rows, labels = [], []
    for i in range(400):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 80))]
        if i % 4 == 0:
            for _ in range(1 + i % 5):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words).title(), "a"))
        labels.append((i, 1, int(i % 4 == 0)))
    docs = docs_of(spark, [*rows, (500, None, "a"), (501, "", "a"), (None, "You IDIOT, moron!", "a")])
    known = spark.createDataFrame([*labels[:300], labels[0], (0, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, known).collect()}
    held_out = [i for i in range(300, 400)]
    assert sum(got[i].toxic != (i % 4 == 0) for i in held_out) <= 1
    assert got[None].toxic and not got[500].toxic and not got[501].toxic
    many, few = [got[i].p_repeated for i in held_out if i % 4 == 0 and i % 5 >= 3], [got[i].p_repeated for i in held_out if i % 4]
    assert min(many) > max(few)
    assert not any(r.toxic for r in toxicity.classify(docs, known.where("false")).collect())
    assert toxicity.classify(docs.where("false"), known).count() == 0


def test_no_evidence_is_not_toxic(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    docs = docs_of(spark, [(1, "", "a"), (2, "", "a")])
    assert not any(r.toxic for r in toxicity.classify(docs, labels).collect())
    clash = docs.selectExpr("doc_id", "text", "true AS toxic", "0.5 AS P_toxic")
    got = toxicity.classify(clash, labels)
    assert all(r.toxic and r.P_toxic == 0.5 and not r.toxic_ for r in got.collect())


def test_held_out_errors_are_told(spark):
    rng = random.Random(15)
    rows = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(30)) + (" scum idiot" if i % 3 == 0 else ""), "a") for i in range(150)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)], "doc_id long, toxic int")
    assert toxicity.fit(docs_of(spark, rows), labels).held_out_errors <= 0.02
    noise = spark.createDataFrame([(i, rng.randrange(2)) for i in range(150)], "doc_id long, toxic int")
    assert toxicity.fit(docs_of(spark, rows), noise).held_out_errors > 0.3


def test_later_models_see_earlier_probabilities():
    features = [np.array([1 + (i + 1) % 2]) for i in range(40)]
    chain = toxicity.fit_chain(features, [np.ones(1, int)] * 40, np.array([i % 2 for i in range(40)]), np.arange(40) % toxicity.FOLDS, [np.array([1, 2])] * 6, [np.array([2])] * 6)
    assert [len(m[2]) for m in chain.models] == [0, 1, 2]


def test_groups_of_keeps_runs_together():
    import pyarrow as pa

    keys = [1, 1, 2, 2, 2, 3, 4, 4, 4, 4]
    batches = [pa.RecordBatch.from_pydict({"k": keys[a:b], "v": list(range(a, b))}) for a, b in ((0, 1), (1, 4), (4, 4), (4, 5), (5, 10))]
    got = [(k[0], t["v"].to_pylist()) for k, t in groups_of(iter(batches), ["k"])]
    assert got == [(1, [0, 1]), (2, [2, 3, 4]), (3, [5]), (4, [6, 7, 8, 9])]


def test_scratch_keeps_what_it_is_told(spark):
    s = Scratch(spark, "t")
    a, b = s.save(spark.range(3), "a"), s.save(spark.range(4), "b")
    s.keep("b")
    assert b.count() == 4
    with pytest.raises(Exception):  # noqa: B017, PT011
        spark.read.parquet(f"{s.base}/a").count()
    assert F.lit(1) is not None and a is not None
