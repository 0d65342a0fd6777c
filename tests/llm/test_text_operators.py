"""Sharding, contamination, licenses, languages, near-duplicates and repeats against brute force."""

import hashlib
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tarnwell.llm import langid, licenses, near_dups, queries, ring
from tarnwell.llm.decontam import decontaminate
from tarnwell.llm.licenses import scan_licenses
from tarnwell.llm.near_dups import near_duplicates
from tarnwell.llm.repeats import maximal_repeats, remove_repeats, without_repeats
from tarnwell.llm.ring import bounded_ring_shards
from tests.llm.conftest import rows_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def roots(nodes, links):
    """Smallest node that links reach, for every node."""
    top = {n: n for n in nodes}

    def find(n):
        while top[n] != n:
            top[n] = top[top[n]]
            n = top[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        if x != y:
            top[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_shards_are_even_gapless_and_mostly_at_home(docs, clashing, none):
    got = bounded_ring_shards(docs, "doc_id").collect()
    assert len(got) == docs.count()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and set(by) <= set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    again = {(r.doc_id, r.text): r.shard for r in bounded_ring_shards(docs.repartition(7), "doc_id").collect()}
    assert all(again[r.doc_id, r.text] == r.shard for r in got)  # whatever the partitions
    more = {(r.doc_id, r.text): r.shard for r in bounded_ring_shards(docs, "doc_id", 9).collect()}
    moved = [r for r in got if more[r.doc_id, r.text] != r.shard]
    assert len(moved) <= 0.25 * len(got) and sum(more[r.doc_id, r.text] != 8 for r in moved) <= 0.12 * len(got)  # one ninth must move
    assert sorted(bounded_ring_shards(clashing.select("doc_id", "size"), "doc_id").columns) == ["doc_id", "shard", "size", "slot"]
    assert bounded_ring_shards(none, "doc_id").count() == 0


def brute_ring(rows, n_shards=8, vnodes=32):
    """Rows (key, hash of the key, hash of the row) dealt one by one: clockwise from the key's arc to a shard with room."""
    arcs, owners = ring.ring_arcs(n_shards, vnodes)
    quota = [len(rows) // n_shards + (s < len(rows) % n_shards) for s in range(n_shards)]
    cell = lambda h, n: (h % 2**64) >> (64 - n.bit_length() + 1)
    fine = ring.CELLS * ring.PIECES
    of = defaultdict(list)
    for key, h, row in rows:
        of[arcs[cell(h, ring.CELLS)]].append((cell(h, fine) * ring.PARTS + row % ring.PARTS, h, row, key))
    left, got, used = {a: sorted(x) for a, x in of.items()}, {}, [0] * n_shards
    for turn in range(n_shards):
        for a in sorted(left):
            shard = owners[a][turn]
            while left[a] and used[shard] < quota[shard]:
                got[left[a].pop(0)[3]] = (shard, used[shard])
                used[shard] += 1
    return got


def test_registered_shards_equal_brute_force(spark, sf_dir):
    rows = queries.op1_ring_shards(spark, sf_dir).collect()
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    light = d.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    want = brute_ring([tuple(r) for r in light.select("doc_id", F.xxhash64("doc_id"), F.xxhash64(F.lit(11), "doc_id", "size", "text_crc32")).collect()])
    texts = {r.doc_id: (r.text or "").encode() for r in d.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.shard, r.slot) == want[r.doc_id] and r.law == "rows" and r.grown_shard is None
        assert r["size"] == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id])


def test_equal_rows_are_dealt_from_each_task(spark):
    """Rows that are equal in all columns, in many tasks, with others of the same key between them."""
    rows = [(None, None)] * 3000 + [(None, "other")] * 5 + [(7, "x")] * 1000 + [(k, "y") for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(11)
    got = bounded_ring_shards(df, "doc_id").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(rows, key=repr)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sorted(map(len, by.values())) == sorted(len(rows) // 8 + (s < len(rows) % 8) for s in range(8))
    again = bounded_ring_shards(df.repartition(3), "doc_id").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def brute_contaminated(docs, items):
    found = []
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(item)
    sizes = {len(k) for k in windows}
    for doc, text in docs:
        w, hit, who = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    who |= windows[k]
        ids = ",".join(sorted(str(x) for x in who))
        found.append((doc, len(w), len(hit), len(who), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(found, key=repr)


COLUMNS2 = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_contamination_equals_brute_force(spark, sf_dir, docs, clashing, none):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    items += [(7001, "quick brown fox"), (7002, None), (7003, ""), (7004, "seven wizards box with one another near the old mill at dawn today the"), (7004, "alone"), (7005, "rights reserved")]
    passage = max((t for _, t in items if t), key=len)
    extra = [(800001, f"a b c {passage} d e f"), (800002, passage.upper()), (800003, " ".join(words(passage)[3:16])), (800004, " ".join(words(passage)[3:15])), (800005, f"{passage} {passage}")]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contaminated([tuple(r) for r in both.collect()], items)
    assert rows_of(decontaminate(both, bench), *COLUMNS2) == want
    assert any(w[5] for w in want)
    clash = decontaminate(clashing, bench.withColumn("h1", F.lit("x")))
    assert rows_of(clash, *COLUMNS2) == brute_contaminated([tuple(r) for r in docs.select("doc_id", "text").collect()], items)
    assert decontaminate(none, bench).count() == 0
    nameless = decontaminate(spark.createDataFrame([(1, "one two")], "doc_id long, text string"), spark.createDataFrame([(None, "one two")], "item_id long, text string")).first()
    assert nameless.n_hit == 2 and nameless.n_items == 0 and nameless.contaminated
    empty = decontaminate(docs, bench.limit(0))
    assert empty.where("n_hit > 0 or contaminated or n_items > 0").count() == 0 and empty.count() == docs.count()


PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def test_license_base_equals_brute_force(docs, clashing, none):
    want = []
    for r in docs.collect():
        w = words(r.text)
        at = [(i, p) for p in PHRASES for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
        starts = [i for i, _ in at]
        want.append((r.doc_id, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({PHRASES[p] for _, p in at}))))
    cols = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    got = scan_licenses(docs)
    assert rows_of(got, *cols) == sorted(want, key=repr)
    for r in got.collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert rows_of(scan_licenses(clashing), *cols) == sorted(want, key=repr)
    assert scan_licenses(none).count() == 0


def brute_detections(text):
    """The rule engine in plain Python: all matches, without those inside one of the same or a lower level."""
    norm = " " + " ".join(words(text)) + " "
    found = []
    for k, (_, level, label, key, pattern) in enumerate(licenses.rules()):
        if key in norm:
            found += [(m.start(), -m.end(), level, k, label) for m in re.finditer(f"(?<= )(?:{pattern})(?= )", norm, re.ASCII) if m.end() > m.start()]
    found.sort()
    kept = [d for i, d in enumerate(found) if not any(o[2] <= d[2] and o[1] <= d[1] for o in found[:i])]
    return [(s, -e, level, k, label) for s, e, level, k, label in kept]


LICENSED = [
    ("Licensed under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
    ("licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "apache-2.0"),
    ("GNU General Public License version 3, or the GNU Lesser General Public License 2.1", "gpl-3.0"),
    ("SPDX-License-Identifier: BSD-3-Clause. Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd-3-clause"),
    ("This work: https://creativecommons.org/licenses/by-nc-sa/4.0/ and CC BY-NC-SA 4.0", "cc-by-nc-sa"),
    ("Dual licensed under the Mozilla Public License 2.0 and freeware; freeware freeware open source software", "mpl-2.0"),
]


@pytest.mark.parametrize("repeat", [1, 40])
def test_license_rules_equal_a_plain_rule_engine(spark, docs, repeat):
    rows = [(i, " and then ".join([t] * repeat)) for i, (t, _) in enumerate(LICENSED)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df if repeat > 1 else df.union(docs.select("doc_id", "text").where("length(text) < 20000"))
    for r in df.join(scan_licenses(df.withColumn("doc_id", F.xxhash64("doc_id", "text"))).withColumnRenamed("doc_id", "k"), F.xxhash64("doc_id", "text") == F.col("k")).collect():
        want = brute_detections(r.text)
        assert [tuple(d) for d in r.detections] == want
        assert set(filter(None, r.labels.split(","))) == {d[4] for d in want} | set(filter(None, r.base_labels.split(",")))
    got = {r.doc_id: r.labels.split(",") for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[i] for i, (_, label) in enumerate(LICENSED))


def test_languages_of_held_out_documents(spark, sf_dir, docs, none):
    got = queries.op4_compression_langid(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.9 * len(held) > 0
    known = langid.train(docs)
    out = {r.doc_id: r.lang_pred for r in langid.predict(docs.where("doc_id >= 900001"), known).collect()}
    assert out[900001] == out[900002] == out[900003] == "und" and out[900007] != "und"
    assert langid.predict(none, known).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.train(none)).collect()} == {"und"}


def shingle_set(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_near(rows):
    sets = [shingle_set(t) for _, t in rows]
    at = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            at[x].append(k)
    links = []
    for k, s in enumerate(sets):
        for other, n in Counter(j for x in s for j in at[x] if j > k).items():
            if 100 * n >= 75 * (len(s) + len(sets[other]) - n) and rows[k][0] is not None and rows[other][0] is not None:
                links.append((rows[k][0], rows[other][0]))
    top = roots({d for d, _ in rows if d is not None}, links)
    return sorted(((d, len(s), top.get(d), d is None or top[d] == d) for (d, _), s in zip(rows, sets, strict=True)), key=repr)


COLUMNS5 = ["doc_id", "n_shingles", "component_id", "kept"]


def test_near_duplicates_equal_brute_force(spark, docs, clashing, none):
    want = brute_near([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert any(not w[3] for w in want)
    assert rows_of(near_duplicates(docs), *COLUMNS5) == want
    assert rows_of(near_duplicates(clashing, chunk=3), *COLUMNS5) == want
    assert near_duplicates(none).count() == 0


def test_near_duplicates_of_large_groups(spark):
    common = " ".join(f"c{i}" for i in range(60))
    rows = [(i, common + " " + " ".join(f"u{i}x{j}" for j in range(i % 9))) for i in range(300)]
    rows += [(1000 + i, common + " " + " ".join(f"v{i}x{j}" for j in range(200))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(near_duplicates(df, chunk=16), *COLUMNS5) == brute_near(rows)


def test_groups_of_the_second_pass_are_bounded(spark, monkeypatch, tmp_path):
    """Members that link with nothing go to each chunk of their list, and the groups they make are as small as the first pass's."""
    real = near_dups._between

    def counted(percent):
        links = real(percent)

        def noted(rows):
            (tmp_path / uuid.uuid4().hex).write_text(str(sum(rows["n"].to_pylist())))
            return links(rows)

        return noted

    monkeypatch.setattr(near_dups, "_between", counted)
    monkeypatch.setattr(near_dups, "GROUP_SHINGLES", 1 << 13)
    rows = [(i, " ".join([f"c{k}" for k in range(60)] + [f"u{i}x{k}" for k in range(30)])) for i in range(200)]
    assert rows_of(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), chunk=10), *COLUMNS5) == brute_near(rows)
    sizes = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert len(sizes) > 20 and max(sizes) < 6 * (1 << 13)


def test_near_duplicates_about_the_threshold(spark):
    """Groups whose members are a little more and a little less alike than 0.75, in lists of several chunks."""
    rng = random.Random(5)
    rows = []
    for g, changed in enumerate((1, 2, 3, 3, 4, 5)):
        base = [f"g{g}w{i}" for i in range(120)]
        for i in range(90):
            w = list(base)
            for k in rng.sample(range(120), changed):
                w[k] = f"x{rng.randrange(10**9)}"
            rows.append((1000 * g + i, " ".join(w)))
    want = brute_near(rows)
    kept = sum(w[3] for w in want)
    assert 6 < kept < len(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(near_duplicates(df, chunk=20), *COLUMNS5) == want
    assert rows_of(near_duplicates(df), *COLUMNS5) == want


def test_near_duplicates_tell_texts_of_one_id_apart(spark):
    base = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, base), (2, base + " more"), (2, "something else entirely that nobody copies"), (None, base), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): (r.kept, r.group_class) for r in near_duplicates(df).collect()}
    assert got[1, 36][1] == got[2, 37][1] != got[2, 2][1] and got[3, 0][1] is None and got[None, 36][0]


def brute_repeats(rows, n=200):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
    out, left = [], []
    for (doc, _), d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for i in range(len(d) - n + 1):
            if seen[d[i : i + n]] > 1:
                gone[i : i + n] = b"\x01" * n
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((doc, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
        left.append(kept)
    return sorted(out, key=repr), left


COLUMNS10 = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_repeats_equal_brute_force(spark, docs, clashing, none):
    small = docs.where(F.coalesce(F.length("text"), F.lit(0)) < 30_000)
    extra = [(700001, "ab" * 400), (700002, "z" * 199), (700003, "z" * 200), (700004, "q" * 201), (700005, "é" * 150 + "tail"), (700006, "head" + "é" * 150)]
    rows = [tuple(r) for r in small.select("doc_id", "text").collect()] + extra
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = brute_repeats(rows)
    assert rows_of(remove_repeats(df), *COLUMNS10) == want
    assert rows_of(remove_repeats(df, gathered=3), *COLUMNS10) == want  # windows of larger groups are counted by hash
    assert rows_of(remove_repeats(clashing.where(F.coalesce(F.length("text"), F.lit(0)) < 30_000)), *COLUMNS10) == brute_repeats(rows[: -len(extra)])[0]
    assert remove_repeats(none).count() == 0


def test_very_long_texts(spark):
    """Texts of some MB with many detections, hits and spans take time in proportion to them."""
    passage = " ".join(f"p{i}" for i in range(13))
    long = " filler words here ".join([passage + " licensed under the MIT License cc by"] * 20_000)
    df = spark.createDataFrame([(1, long), (2, passage)], "doc_id long, text string")
    bench = spark.createDataFrame([("a", passage)], "item_id string, text string")
    hits = {r.doc_id: r.n_hit for r in decontaminate(df, bench).collect()}
    assert hits == {1: 13 * 20_000, 2: 13}
    got = {r.doc_id: (r.n_base, len(r.detections)) for r in scan_licenses(df).collect()}
    assert got == {1: (20_000, 20_000), 2: (0, 0)}
    rng = random.Random(1)
    some = ["".join(rng.choices("abcdefgh ", k=220)) for _ in range(50)]
    mixed = "".join(some[i % 50] + "".join(rng.choices("abcdefgh ", k=30)) for i in range(8_000))
    out = {r.doc_id: r for r in remove_repeats(spark.createDataFrame([(1, mixed), (2, "short")], "doc_id long, text string")).collect()}
    assert out[1].n_spans > 7_000 and out[1].n_removed >= 220 * 8_000 and out[2].n_removed == 0


def test_maximal_repeats_name_all_occurrences(spark):
    a, b = "".join(chr(97 + i * i * 7 % 26) + chr(97 + i * 11 % 26) for i in range(150)), "".join(chr(65 + i * i * 5 % 26) + chr(65 + i * 3 % 26) for i in range(150))
    df = spark.createDataFrame([(1, f"1{a}2"), (2, f"3{a}{b}4"), (3, f"5{b}6{a}7")], "doc_id long, text string")
    out = without_repeats(df)
    assert {r.doc_id: r.text for r in out.collect()} == {1: "12", 2: "34", 3: "567"}
    assert len(maximal_repeats(df)) == 2
