"""The text operators on small frames: brute-force results, round trips, and nulls, empty, long and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, rule string"
LONG = " ".join(f"w{i % 977} end." for i in range(40_000))


def words_space(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def words_alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def texts():
    rng = random.Random(5)
    base = [" ".join(rng.choice("the of and quick brown fox jumps over lazy dog".split()) for _ in range(n)) for n in (1, 2, 3, 60, 200)]
    near = " ".join(f"t{rng.randint(0, 999)}" for _ in range(300))
    return [None, "", " \t\n ", *base, base[3], near, near + " tail", LONG, "A\nA\n\n b c d b c d", "é è É 日本語 it's", "Under the MIT License. Apache License, Version 2.0; CC BY-NC"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else "s1", None if i % 3 == 0 else len(t or ""), 1.0, "clash") for i, t in enumerate(texts())]
    rows.append(rows[4])  # a repeated row
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, None), (2, None, 1), (5, 1, 0), (5, 1, 0), (6, 1, 1), (99, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def test_quality_statistics_and_rules(spark, docs, empty, labels):
    from quantloom.llm.quality_rules import quality_rules

    def brute(t):
        w = words_space(t)
        win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(win)
        covered = {j for i, x in enumerate(win) if n[x] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if words_space(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)

    out, _ = quality_rules(docs, labels)
    want = dict(enumerate(map(brute, texts())))
    got = out.collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert quality_rules(empty, labels)[0].count() == 0


def test_rules_are_learned(spark):
    from quantloom.llm.quality_rules import quality_rules

    good = [(i, " ".join(f"w{(i * 7 + k) % 501}" for k in range(80)), 1) for i in range(120)]
    bad = [(1000 + i, " ".join(f"w{(i * 5 + k) % 499}##" for k in range(80)), 0) for i in range(60)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    out, rules = quality_rules(rows.select("doc_id", "text"), rows.select("doc_id", "quality"))
    assert rules and all(r.kept == (r.doc_id < 1000) for r in out.collect())


def test_license_scan(docs, empty):
    from quantloom.llm.license_scan import BASE_PHRASES, license_scan

    got = license_scan(docs).collect()
    for r in got:
        w = words_alnum(texts()[r.doc_id])
        at = [(i, label) for p, label in BASE_PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert r.first_word == (min(at)[0] if at else None) and r.last_word == (max(at)[0] if at else None)
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert license_scan(empty).count() == 0


def test_matching_statistics_equal_brute_force():
    from quantloom.llm.license_scan import Automaton

    rng = random.Random(1)
    for _ in range(40):
        templates = [[rng.randint(1, 3) for _ in range(rng.randint(1, 9))] for _ in range(3)]
        a = Automaton()
        for i, t in enumerate(templates):
            a.add(t, i)
        text = [rng.randint(1, 4) for _ in range(25)]
        subs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        want = [max([0, *(k for k in range(1, i + 2) if tuple(text[i + 1 - k : i + 1]) in subs)]) for i in range(len(text))]
        assert [n for _, n in a.statistics(text)] == want


def test_all_matches_of_a_template_are_found():
    from quantloom.llm.license_scan import Automaton

    rng = random.Random(11)
    for _ in range(40):
        templates = [[rng.randint(1, 3) for _ in range(rng.randint(1, 9))] for _ in range(3)]
        a = Automaton()
        for i, t in enumerate(templates):
            a.add(t, i)
        a.close()
        text = [rng.randint(1, 4) for _ in range(20)]
        got = {(i + 1, *p) for i, (s, n) in enumerate(a.statistics(text)) for p in a.places(s, n, 1)}
        want = set()
        for i in range(1, len(text) + 1):
            for k, t in enumerate(templates):
                for end in range(1, len(t) + 1):
                    n = next(n for n in range(min(i, end) + 1) if n == min(i, end) or text[i - n - 1] != t[end - n - 1])
                    want |= {(i, k, end, n)} if n else set()
        assert got == want


def test_chains_cover_most():
    from quantloom.llm.license_scan import Scanner

    rng = random.Random(13)
    for _ in range(150):
        words = " ".join(rng.choice("abcd") for _ in range(rng.randint(4, 10)))
        scanner = Scanner((("t", words, ()),), (("zz yy xx", "z"),), min_match=2, max_gap=3, min_cover=0.5)
        text, t = [rng.choice("abcdx") for _ in range(14)], words.split()

        def longest(matches):
            order = sorted(matches, key=lambda m: (m[1], m[0], m[2]))

            def follow(m, covered):
                best = covered
                for x in order:
                    gain = min(x[1] - max(x[0], m[1]), x[2] - max(x[2] - (x[1] - x[0]), m[2]))
                    if m[0] < x[0] <= m[1] + 3 and x[1] > m[1] and x[2] - (x[1] - x[0]) > m[2] - (m[1] - m[0]) and gain > 0:
                        best = max(best, follow(x, covered + gain))
                return best

            return max((follow(m, m[1] - m[0]) for m in order), default=0)

        matches = [(i, i + n, k + n) for i in range(14) for k in range(len(t)) for n in range(2, 11) if text[i : i + n] == t[k : k + n] and i + n <= 14 and k + n <= len(t)
                   and (i == 0 or k == 0 or text[i - 1] != t[k - 1]) and (i + n == 14 or k + n == len(t) or text[i + n] != t[k + n])]
        spans = scanner.scan(" ".join(text))[2]
        most = longest(matches)
        assert (max((round(share * len(t)) for *_, share in spans), default=0) == most) if most >= 0.5 * len(t) else spans == []


#: (text, labels): lines of several licences and versions, and texts of none.
LICENSED = (
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"), ("This work is licensed under the GNU General Public License version 2", "gpl-2"),
    ("licensed under the GNU General Public License version 1", ""), ("Licensed under the GNU Lesser General Public License version 2.1", "lgpl-2.1"),
    ("Licensed under the GNU Lesser General Public License version 3", "lgpl-3"), ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1. If a copy", ""),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at x", "mpl-2"),
    ("licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "cc-by-nc-nd"), ("licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"), ("Licensed under CC BY-SA 4.0", "cc-by-sa"), ("Licensed under the Apache License, Version 1.1", ""),
    ("Licensed under the Apache License, Version 2.0", "apache-2"), ("Released under the MIT License.", "mit"), ("the version of the license that we use is not known to us", ""),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "gpl-2"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "agpl-3"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
)


def test_labels_of_licences_and_versions():
    from quantloom.llm.license_scan import BASE_PHRASES, Scanner

    scanner = Scanner()
    for text, want in LICENSED:
        for around in ("{}", "words before. {} after it " + "more " * 30, "{0} | {0}"):
            _, base, spans = scanner.scan(around.format(text))
            assert ",".join(sorted({BASE_PHRASES[p][1] for _, p in base} | {s[0] for s in spans})) == want, text
    n, base, spans = scanner.scan("words before. This work is licensed under the GNU General Public License, version 3. after")
    assert n == 15 and base == [] and spans == [("gpl-3", 5, 14, 1.0)]
    long = "licensed under the gnu general public license version 3 " * 20_000
    assert len(scanner.scan(long)[2]) == 20_000


def test_classifier(spark, docs, empty, labels):
    from quantloom.llm.quality_classifier import classify

    assert classify(docs, labels).where("kept is null").count() == 0
    assert classify(empty, labels).count() == 0
    rng = random.Random(2)
    word = lambda: f"w{rng.randint(0, 300)}"
    rows = [(i, " ".join([word() for _ in range(60)] + (["nasty", "nastier"] if i % 4 == 0 else [])), "en", "s", 300, int(i % 4 != 0), 0) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality int, toxic int")
    known = d.where("doc_id < 300").select("doc_id", "quality", "toxic")
    got = classify(d.drop("quality", "toxic"), known).where("doc_id >= 300").collect()
    assert sum(r.kept == (r.doc_id % 4 != 0) for r in got) >= 0.97 * len(got)


def test_vocabulary_lookup_equals_sets():
    from quantloom.llm.common import alnum_words
    from quantloom.llm.quality_classifier import Vocabulary, tokens

    rng = random.Random(20)
    some = [" ".join(rng.choice(("abcd", "abcde", "abc", "éa", "éabcd", "x")) + rng.choice(("", "e", "fg", "é")) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    everything = sorted({t for x in some for t in tokens(alnum_words(x))})
    vocabulary = Vocabulary(rng.sample(everything, len(everything) // 2))
    for x in [*some, None, ""]:
        got = vocabulary.counts(alnum_words(x))
        assert sorted(got) == [i for i, w in enumerate(vocabulary.words) if w in tokens(alnum_words(x))]
        assert all(n == sum(w == vocabulary.words[i] or vocabulary.words[i].endswith(b"*") and w.startswith(vocabulary.words[i][:-1]) for w in alnum_words(x)) for i, n in got.items())


def test_toxic_labels_without_quality_are_learned(spark):
    from quantloom.llm.quality_classifier import classify

    rng = random.Random(3)
    word = lambda: f"w{rng.randint(0, 300)}"
    rows = [(i, " ".join([word() for _ in range(60)] + (["nasty", "nastier"] if i % 4 == 0 else [])), "en", "s", 300) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame([(i, None, 1) if i % 4 == 0 else (i, 1, None) for i in range(300)], "doc_id long, quality int, toxic int")
    got = classify(d, known).where("doc_id >= 300").collect()
    assert sum(r.kept == (r.doc_id % 4 != 0) for r in got) >= 0.9 * len(got)  # 75 of 100 where these labels are dropped and all is kept


def test_simple8b_round_trip():
    from quantloom.llm.token_file import pack, unpack

    rng = np.random.default_rng(3)
    for n in (0, 1, 59, 60, 61, 5000):
        for high in (1, 2, 200, 50_000, 2**40, 2**64 - 1):
            ids = rng.integers(0, high, n, dtype=np.uint64)
            ids[: min(n, 3)] = [2**64 - 1, 2**60, 2**60 - 1][: min(n, 3)]
            words, raw = pack(ids)
            assert (unpack(words, raw, n) == ids).all()


def test_token_file(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from quantloom.llm.token_file import Encoder, token_digest

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    got = token_digest(docs, path).orderBy("start").collect()
    at, keys = 0, []
    for r in got:
        ids = whole.encode(texts()[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
        keys.append(r.doc_id)
    assert keys == sorted(keys) and len(keys) == docs.count()
    assert token_digest(empty, path).count() == 0
    odd = ["a\x1cb c", "éé ́x", "it's 's'tfoo I'LL dogs'", "<|endoftext|> x<|startoftext|>y", " x y\u0085z", "ΑΣ ΑΣΑ İ µ", "日本語 テスト१२", "x" * 5000, "Ünïcode, Über!!", "don't.)"]
    encoder = Encoder(open(path, encoding="utf-8").read())
    want = [e.ids for e in whole.encode_batch(odd, add_special_tokens=False)]
    for _ in range(2):  # the second time from memory
        ids, sizes = encoder.encode(pa.array([*odd, None]))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [*want, []]


def test_ids_from_all_generations_of_memory(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    from quantloom.llm import token_file as T

    monkeypatch.setattr(T, "REMEMBERED", 40)
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, encoder, rng = Tokenizer.from_file(path), T.Encoder(open(path, encoding="utf-8").read()), random.Random(12)
    for _ in range(30):
        some = [" ".join(rng.choice(("Word{}", "die{}.", "é{}", "{}x", "...")).format(chr(97 + rng.randint(0, 25))) for _ in range(rng.randint(0, 30))) for _ in range(4)]
        ids, sizes = encoder.encode(pa.array(some))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [e.ids for e in whole.encode_batch(some, add_special_tokens=False)]
    assert len(encoder.chunks.index) <= 40 + 120


def test_fingerprints_and_components(spark, docs, empty):
    import xxhash

    from quantloom.llm.simhash_dedup import near_dedup, simhash_components

    def brute(t):
        w = words_space(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = simhash_components(docs, tile_rows=4).collect()
    fp = {i: brute(t) for i, t in enumerate(texts()) if t != LONG}
    assert all(r.fingerprint == f"{fp[r.doc_id]:016x}" for r in got if r.doc_id in fp)
    marks = {r.doc_id: int(r.fingerprint, 16) for r in got}
    parent = {i: i for i in marks}
    for _ in marks:
        for a in marks:
            for b in marks:
                if (marks[a] ^ marks[b]).bit_count() <= 2:
                    parent[a] = parent[b] = min(parent[a], parent[b])
    assert {r.doc_id: r.component_id for r in got} == parent
    kept = [r.doc_id for r in near_dedup(docs).collect()]
    assert sorted(kept) == sorted(set(parent.values()))
    assert simhash_components(empty).count() == 0


def test_stages_decide_by_row(spark):
    from quantloom.llm.decontamination import decontaminate
    from quantloom.llm.simhash_dedup import near_dedup

    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, "s"), (5, a, "s"), (5, b, "s"), (None, b, "s"), (None, c, "s"), (None, c, "s"), (None, c, None), (7, None, "s"), (7, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = near_dedup(d).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(1, a), (5, b), (0, c), (7, "")])
    other = spark.createDataFrame([(5, a), (5, b), (5, b)], "doc_id long, text string")
    assert sorted(r.text for r in near_dedup(other).collect()) == [a, b]  # both lead a component of their own
    bench = spark.createDataFrame([(1, a)], "item_id long, text string")
    left = decontaminate(spark.createDataFrame([(1, a), (1, b), (None, a), (None, c), (2, None)], "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == sorted([(1, b), (0, c), (2, "")])


def test_tiles_lose_no_link(spark):
    from quantloom.llm.simhash_dedup import connected, fingerprint_links

    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 2**63, 150, dtype=np.uint64)
    fps = {int(s) for s in seeds}
    for s in seeds[:90]:  # chains of one or two changed bits
        x = int(s)
        for _ in range(3):
            for b in rng.integers(0, 63, int(rng.integers(1, 3))):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    rows = spark.createDataFrame([(x,) for x in fps], "fp long")
    roots = {r.node: r.root for r in connected(fingerprint_links(rows, 2, tile_rows=32)).collect()}
    parent = {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    assert {x: roots.get(x, x) for x in fps} == {x: root(x) for x in fps}


def test_dense_tiles_and_second_fingerprints(spark):
    from quantloom.llm.simhash_dedup import connected, fingerprint_links, links_of_tiles, near_dedup

    rng = np.random.default_rng(14)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 63, 500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 500, dtype=np.uint64)) for b in base]))
    second = rng.integers(0, 2, len(fps)).astype(np.uint64) * np.uint64(0xFFFFFF)  # two groups far apart within each base
    a, b = links_of_tiles(fps, None, 5, (second, second))
    assert len(a) < len(fps)  # a forest
    rows = spark.createDataFrame([(int(f), int(s), i) for i, (f, s) in enumerate(zip(fps, second))], "fp long, second long, node long")
    roots = {r.node: r.root for r in connected(fingerprint_links(rows, 5, tile_rows=700, two=True)).collect()}
    parent = list(range(len(fps)))
    close = (np.bitwise_count(fps[:, None] ^ fps) <= 5) & (second[:, None] == second)
    for _ in range(12):
        parent = [min(parent[j] for j in np.flatnonzero(close[i])) for i in range(len(fps))]
    assert [roots.get(i, i) for i in range(len(fps))] == parent
    words = [f"w{k}" for k in rng.integers(0, 5000, 200)]
    changed = [*words[:50], "x", *words[51:120], "y", *words[121:], "z"]
    d = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(f"v{k}" for k in range(150)))], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dedup(d, radius=14, second_seed=43).collect()) == [1, 3]


def test_decontamination(spark, docs, empty, monkeypatch):
    from quantloom.llm import decontamination as D

    rng = random.Random(6)
    some = [f"b{rng.randint(0, 60)}" for _ in range(400)]
    items = [(1, " ".join(some[:30])), (2, "quick brown fox"), (2, None), (3, ""), (None, "x y"), (4, " ".join(some[5:25])), (5, " ".join(some[:30]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(100, "Before " + " ".join(some[3:22]).upper() + " after"), (101, " ".join(some[:12])), (102, "a quick, brown FOX ran"), (103, " ".join(some[:30] * 3)), (104, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    windows = {}
    for i, t in items:
        w = words_alnum(t)
        for a in range(max(1, len(w) - 12) if w and i is not None else 0):
            windows.setdefault(tuple(w[a : a + 13]), set()).add(str(i))

    def brute(t):
        w, hit, found = words_alnum(t), set(), set()
        for a in range(len(w)):
            for n in {len(k) for k in windows}:
                k = tuple(w[a : a + n])
                if len(k) == n and k in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[k]
        return len(w), len(hit), sorted(found)

    want = {i: brute(t) for i, t in [*rows, *((r.doc_id, r.text) for r in docs.collect())]}
    for chars in (D.BLOCK_CHARS, 120):  # one block of items, then several passes
        monkeypatch.setattr(D, "BLOCK_CHARS", chars)
        got = D.hits(d, bench).collect()
        assert len(got) == d.count()
        assert all((r.n_words, r.n_hit, r["items"]) == want[r.doc_id] for r in got)
    assert D.hits(d, bench.where("false")).where("n_hit > 0").count() == 0 and D.hits(empty, bench).count() == 0
    left = {r.doc_id for r in D.decontaminate(d, bench).collect()}
    assert 100 not in left and 102 not in left and 101 in left


def test_ranges_and_longest_matches(spark, monkeypatch):
    from quantloom.llm import decontamination as D

    rng = random.Random(16)
    base = [f"b{rng.randint(0, 9)}" for _ in range(300)]
    items = [(1, " ".join(base[:30])), (2, " ".join(base[10:13])), (3, " ".join(base[5:25])), (4, " ".join(base[18:60])), (5, " ".join(base[2:15])), (6, " ".join(base[3:16])), (7, "b1 b2"), (8, " ".join(base[:30]))]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(1, 5)):
            a = rng.randint(0, 60)
            words += base[a : a + rng.randint(1, 40)] + rng.choice(([], ["zz"], ["b0"]))
        rows.append((i, " ".join(words)))
    texts_ = [t.split() for _, t in items]

    def brute(w):
        hit, longest = set(), 0
        for t in texts_:
            for a in range(len(w)):
                for q in range(len(t)):
                    n = 0
                    while a + n < len(w) and q + n < len(t) and w[a + n] == t[q + n]:
                        n += 1
                    if n >= min(13, len(t)):
                        hit |= set(range(a, a + n))
                        longest = max(longest, n)
        return sorted(hit), longest

    bench, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    for chars, shard in ((D.BLOCK_CHARS, D.SHARD_WORDS), (300, 50)):
        monkeypatch.setattr(D, "BLOCK_CHARS", chars)
        monkeypatch.setattr(D, "SHARD_WORDS", shard)
        for r in D.hits(d, bench).collect():
            assert ([x for a, b in r.ranges for x in range(a, b)], r.longest_match) == brute(rows[r.doc_id][1].split())


def test_large_benchmark_blocks_are_small():
    import tracemalloc

    from quantloom.llm.decontamination import Windows, shard_hits

    rng = np.random.default_rng(17)
    texts_ = [(" ".join(f"w{k}" for k in rng.integers(0, 50_000, 200)), [str(i)], False) for i in range(2000)]  # 2.6 million characters
    tracemalloc.start()
    wanted = Windows(texts_)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6 and len(wanted.length) == 2000 * 188
    found = shard_hits([t.encode().split() for t in (texts_[7][0], "nothing here", "w1 " + texts_[9][0][: len(texts_[9][0]) // 2])], wanted)
    assert found[0] == ([(0, 200)], {"7"}, 200) and 1 not in found and found[2][1] == {"9"}


def test_items_without_id_count(spark, monkeypatch):
    from quantloom.llm import decontamination as D

    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    bench = spark.createDataFrame([(None, a), (None, b), (1, b), (None, None)], "item_id long, text string")
    d = spark.createDataFrame([(1, a), (2, b + " tail"), (3, a + " " + b), (4, "clean words")], "doc_id long, text string")
    for chars in (D.BLOCK_CHARS, 60):
        monkeypatch.setattr(D, "BLOCK_CHARS", chars)
        got = {r.doc_id: (r.n_hit, r.n_items, r["items"]) for r in D.hits(d, bench).collect()}
        assert got == {1: (20, 1, []), 2: (20, 2, ["1"]), 3: (40, 2, ["1"]), 4: (0, 0, [])}  # as in the SQL twin
    assert [r.doc_id for r in D.decontaminate(d, bench).collect()] == [4]


def test_mixing(spark, docs, empty):
    from quantloom.llm.source_mixing import replicate

    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 8, "big").otherwise("small").alias("source"), F.lit("t").alias("copy"))
    got = replicate(rows, weights={"big": 0.25, "small": 0.75})
    n = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["big"] - 750) < 120 and abs(n["small"] - 2250) < 200
    keys = [r.shuffle_key for r in got.collect()]
    assert keys == sorted(keys) and sorted(map(tuple, got.collect())) == sorted(map(tuple, replicate(rows, weights={"big": 0.25, "small": 0.75}).collect()))
    heavy = replicate(rows, weights={"small": 1.0}, epochs=20.0)  # means beyond one part
    assert abs(heavy.count() - 60_000) < 1500
    assert replicate(empty).count() == 0 and replicate(docs).count() >= 0


def test_chat_round_trip(spark):
    from quantloom.llm.chat_format import conversation_digest, format_windows

    rng = random.Random(8)
    rows = []
    for c in range(12):
        n = rng.choice((1, 3, 40))
        for t in range(n):
            role = "system" if t == 0 and c % 2 else rng.choice(("user", "assistant", None, "odd\nrole"))
            text = rng.choice((None, "", "<|im_end|>", "&lt;| &amp; <<|", "a\nb", " ".join(f"w{i}" for i in range(rng.randint(1, 90)))))
            rows.append((c, t, role, text, "clash"))
    rows += [rows[-1], (None, 0, "user", "no conversation", "clash")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    for budget, history in ((60, 20), (2048, 256), (1, 0)):
        windows = format_windows(frame, budget=budget, history=history)
        got = {r.conv_id: r for r in conversation_digest(windows).collect()}
        for c in {r[0] for r in rows}:
            turns = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c)
            learned = "".join(t for _, r, t in turns if r == "assistant")
            said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
            assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
            assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    later = format_windows(frame, budget=60, history=20).where("window > 1 and conv_id % 2 = 1").collect()
    assert later and all(w.formatted.startswith("<|im_start|>system\n") and not w.turns[0].own for w in later)
    assert format_windows(frame.where("false")).count() == 0


def test_chat_windows_keep_the_budget(spark, monkeypatch):
    import quantloom.llm.chat_format as C

    rng = random.Random(15)
    rows = []
    for c in range(14):
        for t in range(rng.choice((2, 9, 70))):
            role = "system" if t == 0 and c % 2 else "assistant" if t % 2 else "user"
            rows.append((c, t, role, " ".join(f"c{c}t{t}w{i}" for i in range(rng.choice((1, 5, 20, 60))))))
    rows += [(50, None, "user", f"no turn {i}") for i in range(40)] + [(50, 3, "assistant", f"same turn {i % 30}") for i in range(60)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    tokens = lambda w: sum(len(w.formatted[t.start : t.start + t.length].split()) + 4 for t in w.turns)
    for budget, history, block in ((128, 32, 1024), (90, 40, 16), (300, 0, 16), (1000, 200, 8)):
        monkeypatch.setattr(C, "BLOCK", block)
        windows = C.format_windows(frame, budget=budget, history=history).collect()
        assert len(windows) > 15
        by_conv = {}
        for w in sorted(windows, key=lambda w: (w.conv_id, w.part, w.window)):
            own, repeated = [t for t in w.turns if t.own], [t for t in w.turns if not t.own]
            text = lambda t, w=w: w.formatted[t.start : t.start + t.length]
            assert tokens(w) <= budget or len([t for t in own if not w.formatted[: t.start].endswith("system\n")]) == 1 and len(repeated) <= 1
            assert own and [t.own for t in w.turns] == sorted(t.own for t in w.turns) and not any(t.loss for t in repeated)
            before = by_conv.setdefault(w.conv_id, [])
            opening = next((r for r in rows if r[0] == w.conv_id and r[1] == 0 and r[2] == "system"), None)
            if opening and before:  # the system turn first, then what ends the window before
                assert text(w.turns[0]) == opening[3] and repeated[0] == w.turns[0]
                repeated = repeated[1:]
            assert sum(len(text(t).split()) + 4 for t in repeated) <= history
            assert not repeated or before[-len(repeated) :] == [text(t) for t in repeated]
            before += [text(t) for t in own]
        for c, said in by_conv.items():
            want = [r[3] for r in rows if r[0] == c]
            assert said == want if c < 50 else sorted(said) == sorted(want)
        assert history == 0 or any(not t.own and "system" not in w.formatted[: t.start].rsplit("<|im_start|>", 1)[1] for w in windows for t in w.turns)


def test_html(spark):
    from quantloom.llm.html_text import extract, leaves

    page = "<html><head><title>T</title><script>var a='<p>x</p>'</script></head><body><nav><a href='/'>Home</a></nav><article><h1>A &amp; B</h1><p>One\n two <b>three</b>.<br><p>Four &eacute;.</p><div class='comments'><p>me too</p></div></article><footer>&copy; x</footer>"
    assert [t for _, t, _ in leaves(page)] == ["T", "Home", "A & B", "One two three.", "Four é.", "me too", "© x"]
    rows = [(i, f"http://h/{i}", page.replace("Four", f"Four{i}")) for i in range(30)] + [(30, None, None), (31, "u", ""), (31, "u", "<p"), (32, "u", "<!-- open"), (33, "u", "plain text without marks")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in extract(frame).collect()}
    for i in range(30):
        assert got[i].text == f"A & B\nOne two three.\nFour{i} é." and got[i].n_chars == len(got[i].text)
    assert got[30].text == "" and got[31].n_chars == 0 and got[32].text == ""
    assert extract(frame.where("false")).count() == 0


def test_html_reads_and_learns_whole_pages(spark):
    from quantloom.llm.html_text import WORD_DIM, examples, extract, leaves, vectors

    words = [f"w{i}" for i in range(400)]
    one, other = (vectors([(((1, ("p",)),), " ".join([*words, last]), 0)]).dense[0] for last in ("end0", "end1"))
    assert not np.array_equal(one[:WORD_DIM], other[:WORD_DIM])  # words after the 64th count
    plain = leaves("<body><div class='content'><p>The article.</p></div></body>")
    long = leaves("<body class='menu'><article>" + "<p>Some text.</p>" * 90 + "</article><div class='zzz'><p>tail</p></div></body>")
    made = examples([plain, long], 0)
    assert len(made) == 1 and len(made[0][0]) == 91 and made[0][1][89] == 1 and made[0][1][90] == 0
    body = "".join(f"<p>Words of a long article, part {i}. {'more ' * 60}</p>" for i in range(80))
    page = f"<html><body><nav>Home</nav><article><h1>Title</h1>{body}</article><section class='comments'><p>First!</p><p>me too</p></section></body></html>"
    assert len(page) > 20_000
    got = extract(spark.createDataFrame([(i, "u", page) for i in range(40)], "page_id long, url string, html string")).first()
    assert got.text.startswith("Title\nWords") and got.text.count("\n") == 80 and "me too" not in got.text


#: Pages of several kinds, labelled by hand: wanted blocks begin with §.
HAND_LABELLED = (
    "<html><head><title>Blog</title></head><body class='home has-sidebar menu-closed'><header><a href='/'>My blog</a><ul class='menu'><li><a href='/a'>About</a></li><li><a href='/c'>Contact</a></li></ul></header><div id='content'><div class='post'><h1>§A walk by the river</h1><p>§We left early in the morning, when the fog still lay over the water and nobody was about.</p><p>§By noon we had reached the old mill, where we had our lunch.</p></div></div><div class='sidebar'><h3>Recent posts</h3><ul><li><a href='/1'>Spring</a></li><li><a href='/2'>Summer</a></li></ul></div><footer>Copyright 2020</footer></body></html>",
    "<html><body><form id='aspnetForm' action='/x'><div class='navbar'><a href='/'>Start</a> <a href='/n'>News</a></div><table><tr><td class='menu-left'><a href='/p'>Products</a></td><td class='main-text'><h2>§Opening hours</h2><p>§The office is open on weekdays from nine to five, except on public holidays.</p><p>§Please ring the bell at the side door.</p></td></tr></table><div class='footer'>All rights reserved</div></form></body></html>",
    "<html><body><nav><ul><li><a href='/w'>World</a></li><li><a href='/s'>Sport</a></li></ul></nav><main><article><h1>§Council votes for new bridge</h1><p>§The town council voted on Tuesday for a new bridge across the canal, after years of debate.</p><div class='advert'>Buy two, get one free</div><p>§Work is to begin in the autumn and will take about two years, the mayor said.</p><blockquote>§We have waited for this day for a long time.</blockquote></article><section class='comments'><h3>3 comments</h3><div class='comment'><p>About time they did something about it, I say.</p></div><div class='comment'><p>Who is going to pay for all of this in the end?</p></div></section></main><footer><p>Imprint</p></footer></body></html>",
    "<html><body><div id='cookie-banner'><p>We use cookies to make this site better for you.</p><a href='#'>Accept</a></div><div class='page-wrapper sidebar-layout'><div class='breadcrumbs'><a href='/'>Home</a> <a href='/r'>Recipes</a></div><div class='entry-content'><h1>§Bread with seeds</h1><ul><li>§500 g of flour</li><li>§a spoon of salt</li></ul><p>§Mix everything with warm water and let the dough rest overnight in a cool place.</p></div><div class='related-posts'><h4>You may also like</h4><a href='/k'>Cake</a></div><div class='newsletter-signup'><p>Get our best recipes by mail every week.</p></div></div></body></html>",
    "<html><body><div><div class='topbar'>Log in</div><div class='article-body'><p>§The committee published its second report on the state of the rivers in the region.</p><p>§It finds that most of them are cleaner than ten years ago.</p><table><tr><td>§Year</td><td>§Samples</td></tr></table></div><div class='article-sidebar'><p>Read also our report of last year.</p></div><div class='share-buttons'>Share this</div></div></body></html>",
    "<html><body><section class='hero-banner'><p>Sale ends on Sunday</p></section><section class='story'><h1>§The keeper of the lighthouse</h1><p>§He had lived alone on the island for more than thirty years and knew every stone of it.</p><p>§In winter no boat could land there for weeks.</p><p>§Then the letters came all at once.</p></section><aside class='widget'><h3>Popular</h3><p>Ten things that you should know</p></aside><div id='disqus_comments'><ul class='replies'><li>Lovely story, thank you.</li><li>I have been there once.</li></ul></div></body></html>",
    "<html><body class='page-template-footer'><div class='siteHeader'><a href='/'>Docs</a></div><div class='tocSidebar'><ul><li><a href='#a'>Install</a></li><li><a href='#b'>Use</a></li></ul></div><div role='main'><h1>§Installation</h1><p>§Download the archive, unpack it into a folder of your own and run the setup program.</p><pre>§setup --quiet</pre><p>§The program asks for a folder when it starts for the first time.</p></div><div class='pagination'><a href='/2'>Next</a></div><div role='contentinfo'>Version 3</div></body></html>",
    "<html><body><div class='alert'>This page has moved.</div><div id='main'><h1>§Minutes of the meeting</h1><p>§All members were present. The chair opened the meeting at six and read the agenda.</p><ol><li>§Accounts of the year</li><li>§Election of the board</li></ol></div><div class='login-form'><form><label>Name</label><label>Password</label></form></div><div class='legal'><p>No liability is taken for the content of linked pages.</p></div></body></html>",
)


def test_html_of_hand_labelled_pages(spark, sf):
    from quantloom.llm.html_text import extract, leaves, train

    rows = [(i, "u", p.replace("§", "")) for i, p in enumerate(HAND_LABELLED)]
    model = train(spark.read.parquet(f"{sf}/pages.parquet"))
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string"), model=model).collect()}
    found = {(i, t) for i, text in got.items() for t in text.split("\n") if t}
    wanted = {(i, t[1:]) for i, p in enumerate(HAND_LABELLED) for _, t, _ in leaves(p) if t.startswith("§")}
    precision, recall = len(found & wanted) / len(found), len(found & wanted) / len(wanted)
    print(f"hand-labelled pages: precision {precision:.3f}, recall {recall:.3f}", found - wanted, wanted - found)
    assert precision >= 0.9 and recall >= 0.9
    given = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    plain, changed = (
        [r.text for r in extract(spark.createDataFrame([(i, "u", h.replace("<body>", f"<body{names}>{before}").replace("</body>", f"{after}</body>")) for i, h in enumerate(given)], "page_id long, url string, html string"), model=model).orderBy("page_id").collect()]
        for names, before, after in (("", "", ""), (" class='has-sidebar menu-closed'", "<form id='f'>", "</form>"))
    )
    assert sum(a == b for a, b in zip(plain, changed, strict=True)) >= len(given) - 2 and all(plain)


def test_html_memory_is_bounded_by_leaves():
    import tracemalloc

    import quantloom.llm.html_text as H
    from quantloom.llm.html_text import BlockLabeller, main_texts, vectors

    page = "<body><article>" + "<p>Some text.</p>" * 30_000 + "</article></body>"
    labeller = BlockLabeller()
    assert len(list(main_texts(labeller, [page, None, ""]))) == 3
    tracemalloc.start()
    list(main_texts(labeller, [page]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    long = [(((1, ("p",)), (2, (f"n{i % 7}",))), f"text {i % 11}", 0) for i in range(9000)]  # several stretches of one page
    v = vectors(long)
    p = labeller.probabilities([v])
    try:
        H.STRETCH, whole = 20_000, H.STRETCH
        assert np.allclose(labeller.probabilities([v]), p)
    finally:
        H.STRETCH = whole


def test_language(spark, empty):
    from quantloom.llm.language_id import identify

    rng = random.Random(9)
    speak = {"xx": ["ka", "lo", "mi", "tu"], "yy": ["sch", "ung", "eit", "ver"], "zz": ["éa", "oux", "ré", "ment"]}
    rows = [(i, " ".join("".join(rng.choice(speak[l]) for _ in range(3)) for _ in range(rng.randint(1, 60))), l) for i in range(600) for l in [list(speak)[i % 3]]]
    odd = [(1000, None, "xx"), (1001, "", "yy"), (1002, "123 !!", None), (None, "kalo mitu", None), (1003, LONG, None)]
    d = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify(d).collect()}
    assert len(got) == 605 and all(got[i].lang_pred == "und" for i in (1000, 1001, 1002))
    held = [i for i, _, _ in rows if got[i].held_out]
    assert held == [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i].lang_pred == list(speak)[i % 3] for i in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert identify(empty).count() == 0 and identify(d.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def test_pipeline_stages_on_small_tables(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and stage(spark, docs.where("false"), sf).count() == 0, name
    assert P.run(spark, sf).count() > 0


def test_pipeline_stages_against_brute_force(spark, sf, tmp_path):
    import public_tokenizers
    import xxhash
    from tokenizers import Tokenizer

    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r for r in docs.collect() if r.text and len(r.text) < 3000]
    docs = spark.createDataFrame(rows, docs.schema)
    stages = dict(P.STAGES)

    def prints(t, seed):
        w = words_space(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        h = np.array([xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed) for i in range(max(1, len(w) - 2))] if w else [], np.uint64)
        return sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))

    f = [np.array([prints(r.text, seed) for r in rows], np.uint64) for seed in (42, 43)]
    close = (np.bitwise_count(f[0][:, None] ^ f[0]) <= 14) & (np.bitwise_count(f[1][:, None] ^ f[1]) <= 14)
    ids = [r.doc_id for r in rows]
    root = list(ids)
    for _ in range(20):
        root = [min(root[j] for j in np.flatnonzero(close[i])) for i in range(len(ids))]
    assert sorted(r.doc_id for r in stages["simhash_near_dedup"](spark, docs, sf).collect()) == sorted(set(root)) and len(set(root)) < len(ids)
    windows = set()
    for b in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words_alnum(b.text)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12) if w else 0)}
    clean = []
    for r in rows:
        w, hit = words_alnum(r.text), set()
        for n in {len(x) for x in windows}:
            hit |= {k for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for k in range(i, i + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append(r.doc_id)
    assert sorted(r.doc_id for r in stages["decontamination"](spark, docs, sf).collect()) == sorted(clean) and len(clean) < len(ids)
    mixed = stages["source_mixing"](spark, docs, sf)
    path = str(tmp_path / "mixed")
    mixed.write.parquet(path)
    back = spark.read.parquet(path)
    order, tokenizer = [r.doc_id for r in back.collect()], Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert order != sorted(order)
    got = sorted(stages["token_output"](spark, back, sf).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == order
    text, at = {r.doc_id: r.text for r in rows}, 0
    for r in got:
        ids_ = tokenizer.encode(text[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids_), zlib.crc32(np.array(ids_, "<u4").tobytes()))
        at += len(ids_)


def test_classifier_on_held_out_labels(spark):
    from quantloom.llm.quality_classifier import classify

    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 0
    got = classify(docs, labels.where(~held)).join(labels.where(held), "doc_id").collect()
    good = [r.kept for r in got if r.quality == 1 and r.toxic == 0]
    poor, toxic = [r.kept for r in got if r.quality == 0], [r.kept for r in got if r.toxic == 1]
    assert sum(good) >= 0.96 * len(good) and sum(poor) <= 0.05 * len(poor) and sum(toxic) <= 0.15 * len(toxic)
