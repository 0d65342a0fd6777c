"""Texts that repeat themselves: segments stay bounded, and what they remove stays exact."""

import random

import numpy as np
import pyarrow as pa

from tarnwell.llm import repeats


def covered(texts, length=200):
    """Bytes that repeats cover, by the operator's own steps in one process."""
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    rows = []
    for k, (fp, first, count, _) in enumerate(repeats.Windows(length).segments(np.frombuffer(b"".join(texts), dtype="u1"), bounds)):
        assert count.sum() == max(0, len(texts[k]) - length + 1) and count.max(initial=0) <= repeats.MOST_WINDOWS
        rows += [(f, k, 0, s, texts[k][s : s + c + length - 1]) for f, s, c in zip(fp.tolist(), first.tolist(), count.tolist(), strict=True)]
    rows.sort(key=lambda r: r[0])
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)] + [pa.array([r[4] for r in rows], pa.binary())], ["fp", "h1", "h2", "first", "ctx"])
    cover = [np.zeros(len(t), bool) for t in texts]
    for out in repeats._groups(length, False)([batch]):
        for k, runs in zip(out.column(1).to_pylist(), out.column(4).to_pylist(), strict=True):
            for r in runs:
                cover[k][r["s"] : r["e"]] = True
    return cover


def brute(texts, length=200):
    seen = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], []).append((k, i))
    cover = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        for k, i in places if len(places) > 1 else []:
            cover[k][i : i + length] = True
    return cover


def test_cut_segments_equal_brute_force(monkeypatch):
    chance = random.Random(5)
    for most in (4096, 50, 7):
        monkeypatch.setattr(repeats, "MOST_WINDOWS", most)
        for _ in range(3):
            base = chance.randbytes(900)
            texts = [b"z" * 3000 + chance.randbytes(300), base + chance.randbytes(200) + base[100:700], (b"abcde" * 1000)[:3333], chance.randbytes(500) + b"z" * 700, chance.randbytes(150), b"", chance.randbytes(60) * 40 + chance.randbytes(100), base[:250]]
            assert all((g == w).all() for g, w in zip(covered(texts), brute(texts), strict=True))


def test_fingerprints_parted_by_longer_grams_equal_brute_force(monkeypatch):
    chance = random.Random(11)
    for most in (1 << 19, 3000, 500):
        monkeypatch.setattr(repeats, "ARRAY_BYTES", most)
        for _ in range(2):
            base, texts = chance.randbytes(1200), []
            for _ in range(12):  # near copies: one passage, changed here and there
                t = bytearray(base)
                for _ in range(chance.randint(0, 4)):
                    t[chance.randrange(len(t))] = chance.randrange(256)
                texts.append(bytes(t[chance.randint(0, 300) :]) + chance.randbytes(chance.randint(0, 80)))
            texts += [b"xyz" * 400 + base[:230], chance.randbytes(150) * 5, texts[0][:700] + b"xyz" * 300]
            assert all((g == w).all() for g, w in zip(covered(texts), brute(texts), strict=True))


def test_fifty_megabytes_of_one_byte_and_of_a_short_period(spark):
    docs = spark.createDataFrame([(1, 50_000_000, "z"), (2, 3_000_000, "abcdefg"), (3, 1, "once")], "doc_id long, n long, piece string").selectExpr("doc_id", "repeat(piece, cast(n as int)) as text")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeats.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans").collect()}
    assert got == {1: (50_000_000, 50_000_000, 1), 2: (21_000_000, 21_000_000, 1), 3: (4, 0, 0)}
