"""Line labels, whitening and token alignment against plain versions of the same rules."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarnwell.llm import align, linecrf, queries, whitening
from tests.llm.conftest import rows_of

WHITE = r"[^\x20\x09-\x0D]+"


def brute_counts(text):
    text = text or ""
    words = re.findall(WHITE, text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WHITE, line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_line_rules_equal_plain_counts_and_the_field_parts_good_from_bad(spark, sf_dir, docs, clashing, none):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    chain = linecrf.train(big, labels.where(half))
    got = linecrf.rule_lines(big, chain).join(labels.where(~half), "doc_id").where("not base_failed").toPandas()
    assert got.loc[got["quality"] == 1, "kept"].mean() >= 0.99 and got.loc[got["quality"] == 0, "kept"].mean() <= 0.05
    want = sorted(((r.doc_id, *brute_counts(r.text)) for r in docs.collect()), key=repr)
    ruled = linecrf.rule_lines(docs, chain)
    assert rows_of(ruled, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    for r in ruled.collect():
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.content_share >= linecrf.CONTENT) and r.n_boilerplate == len(r.boilerplate)
    assert rows_of(linecrf.rule_lines(clashing, chain), *ruled.columns) == rows_of(ruled, *ruled.columns)
    assert linecrf.rule_lines(none, chain).count() == 0
    untaught = linecrf.train(docs, labels.limit(0))
    assert untaught is None and linecrf.rule_lines(docs, untaught).where("n_boilerplate > 0").count() == 0
    assert linecrf.train(none, labels) is None


def test_repeated_ids_and_odd_labels_teach_alike_each_time(spark):
    good, bad = "Calm rivers run through the valley at dawn.\nPeople walk along them.", "CLICK!! NOW!! %%% ***\n$$$ BUY!! CHEAP!!"
    rows = [(i // 2, (good if i // 2 % 2 else bad) + f" {i}") for i in range(80)] + [(None, good), (7, None), (8, " \n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (4, 1), (5, 9)], "doc_id long, quality int")
    one, two = (linecrf.train(d, labels) for d in (docs, docs.repartition(5)))
    assert np.allclose(one.w, two.w, atol=1e-6)
    marked = {r.doc_id: r.n_boilerplate for r in linecrf.rule_lines(docs.where("doc_id > 8"), one).collect()}
    assert all(marked[i] == (0 if i % 2 else 2) for i in marked)


def test_chain_equals_all_label_sequences():
    chance = np.random.default_rng(2)
    for _ in range(20):
        n = int(chance.integers(1, 7))
        f, y = chance.standard_normal((n, linecrf.N_FEATURES)), chance.integers(0, 2, n)
        chain = linecrf.Chain(chance.standard_normal(linecrf.N_FEATURES + 5))
        emitted, move, start = chain.scores(f)
        score = lambda s: emitted @ np.array(s) + sum(move[a, b] for a, b in itertools.pairwise(s)) + start * s[0]  # noqa: B023, E731
        every = list(itertools.product((0, 1), repeat=n))
        assert tuple(chain.viterbi(f)) == max(every, key=score)
        found = chain.loss(f, y)
        assert np.isclose(found[0], np.logaddexp.reduce([score(s) for s in every]) - score(tuple(y)))
        for j in range(len(chain.w)):
            d = np.zeros(len(chain.w))
            d[j] = 1e-6
            assert np.isclose((linecrf.Chain(chain.w + d).loss(f, y)[0] - linecrf.Chain(chain.w - d).loss(f, y)[0]) / 2e-6, found[1 + j], atol=1e-5)
    assert not len(linecrf.Chain().viterbi(np.zeros((0, linecrf.N_FEATURES))))


def test_long_texts_are_measured_in_blocks(monkeypatch):
    text = "\n".join(f"line {i % 40} of Ünïcode wörds # and more 中文 {i % 7}!" for i in range(300)) + "\n \n\t tail"
    want = linecrf.measured(text.encode())
    monkeypatch.setattr(linecrf, "BLOCK", 61)
    got = linecrf.measured(text.encode())
    assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == brute_counts(text)
    assert all((a == b).all() for a, b in ((got.lines, want.lines), (got.words, want.words), (got.features, want.features)))


def test_leading_vectors_of_plain_repeated_and_zero_matrices():
    chance = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 64):
        a = chance.standard_normal((3 * n, n))
        for m in (a.T @ a, np.eye(n) * 1e9, np.diag(np.repeat([3.0, 1.0], [n // 2, n - n // 2])), np.zeros((n, n))):
            values, vectors = whitening.leading(m, 8)
            want = np.linalg.eigvalsh(m)[::-1][: len(values)]
            size = max(1.0, abs(want).max())
            assert np.allclose(values, want, rtol=1e-12, atol=1e-12 * size)
            assert abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12 and abs(m @ vectors - vectors * values).max() < 1e-12 * size


def brute_whitened(rows, k=8):
    """Rows (id, vector) of one size by numpy's own eigenvectors; deviations by whole numbers."""
    x = [[int(np.floor(np.float64(c) * 1024)) + 100_000 for c in v] for _, v in rows]
    n, total = len(x), [sum(c) for c in zip(*x, strict=True)]
    dev = [sum((n * a - s) ** 2 for a, s in zip(r, total, strict=True)) for r in x]
    centred = np.array([[float(a) - s / n for a, s in zip(r, total, strict=True)] for r in x])
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return dev, centred @ u / np.sqrt(e), e / np.trace(v)


def test_whitening_equals_plain_eigenvectors(spark, sf_dir):
    data = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").select("vec_id", "embedding").collect()
    dev, white, share = brute_whitened([tuple(r) for r in data])
    got = queries.op12_whitening(spark, sf_dir).toPandas().sort_values(["vec_id", "component"])
    assert dict(queries.op12_whitening(spark, sf_dir).dtypes)["deviation"] == "bigint"
    w = got["whitened"].to_numpy().reshape(-1, 8)
    w = w * np.sign((w * white).sum(0))
    assert (got["n"] == len(data)).all() and got["deviation"].tolist() == list(np.repeat(np.array(dev), 8))
    assert np.allclose(w, white, atol=1e-7) and np.allclose(got["explained"].to_numpy().reshape(-1, 8), share, rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    chance = np.random.default_rng(5)
    fine = [(i, [float(c) for c in chance.standard_normal(3)]) for i in range(40)] + [(3, [0.5, 0.25, -1.0]), (None, [0.5, 0.25, -1.0])]
    odd = [(100, None), (101, []), (102, [nan, 1.0, 1.0]), (103, [1.0, inf, 1.0]), (104, [1.0, None, 1.0]), (105, [1.0, 2.0]), (106, [1e300, 1.0, 1.0])]
    df = spark.createDataFrame(fine + odd, "vec_id long, embedding array<double>").withColumns({"v": F.lit("mine"), "n": F.lit("mine"), "whitened": F.lit("mine")})
    got = whitening.whiten(df).toPandas()
    dev, white, _ = brute_whitened(fine, 3)
    assert len(got) == 3 * len(fine) and set(got["component"]) == {1, 2, 3} and sorted(int(d) for d in got["deviation"]) == sorted(d for d in dev for _ in range(3))
    assert got["identity_error"].iloc[0] < 1e-9 and set(got["vec_id"].dropna()) == set(range(40))
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 3.0])], "vec_id long, embedding array<double>")).orderBy("component", "vec_id").collect()
    assert [r.whitened is None for r in flat] == [False, False, True, True] and [r.explained for r in flat] == [1.0, 1.0, 0.0, 0.0]
    assert whitening.whiten(df.where("vec_id = 2")).where("whitened is null and deviation = 0").count() == 3
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id = 100")).count() == 0
    wide = [(i, [float(1 << 45) * (i % 3), float(i)]) for i in range(50)]
    big = whitening.whiten(spark.createDataFrame(wide, "vec_id long, embedding array<double>")).where("component = 1").orderBy("vec_id").collect()
    assert [r.deviation for r in big] == [Decimal(d) if d < 10**38 else None for d in brute_whitened(wide, 2)[0]]


@pytest.mark.parametrize("top", [10, 1 << 30, (1 << 40) - 1, (1 << 59)])
def test_squares_are_exact(top):
    y = np.random.default_rng(3).integers(-top, top + 1, (50, 7))
    assert whitening._squares(y).to_pylist() == [Decimal(t) if (t := sum(c * c for c in r)) < 10**38 else None for r in y.tolist()]


def brute_tokens(texts):
    """Tokens of whole texts by both libraries: ids and byte lengths, or None."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in plain]
    byte = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(others)}
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        raw = (" " + text).encode()
        of_a = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        pieces = [(i, b.id_to_piece(i)) for i in b.encode(text, num_threads=1)]
        of_b = [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()) for i, p in pieces]
        whole = b"".join(x for _, x in of_a) == raw == b"".join(x for _, x in of_b)
        out.append(([(i, len(x)) for i, x in of_a], [(i, len(x)) for i, x in of_b]) if whole else None)
    return out


def brute_alignment(texts):
    found, held, out = brute_tokens(texts), [], []
    for t in found:
        links, digest, n_groups = [], "", 0
        if t:
            spans = []
            for tokens in t:
                ends = list(itertools.accumulate(n for _, n in tokens))
                spans.append([(i, e - n, e) for (i, n), e in zip(tokens, ends, strict=True)])
            lo = 0
            for i, s, e in spans[0]:
                while spans[1][lo][2] <= s:
                    lo += 1
                k = lo
                while k < len(spans[1]) and spans[1][k][1] < e:
                    links.append((i, spans[1][k][0]))
                    k += 1
            cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
            parts = [[[], []] for _ in cuts]
            for side in (0, 1):
                g = 0
                for i, _, e in spans[side]:
                    while cuts[g] < e:
                        g += 1
                    parts[g][side].append(str(i))
            n_groups, digest = len(cuts), hashlib.sha256(";".join("|".join(map(",".join, p)) for p in parts).encode()).hexdigest()
        held.append(links)
        out.append([len(t[0]) if t else 0, len(t[1]) if t else 0, n_groups, len(links), digest])
    count = Counter(p for links in held for p in set(links))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [(*o[:4], sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), o[4]) for o, links in zip(out, held, strict=True)]


def paths():
    path = public_tokenizers.path
    return path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, path("piece_bpe_32k.model")


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def odd_texts(n, seed=4):
    chance = random.Random(seed)
    parts = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "中文", "😀", ".", ",", "!", "1", "23", "'s", " ", " ", "<s>", "</s>", "\r", "-", "_", "́", "<|endoftext|>", "A", "▁", "<0x41>", "\x00", " ", "\x1c", "ing", " water", "​"]
    return ["".join(chance.choice(parts) for _ in range(chance.randint(1, 30))) for _ in range(n)]


def test_alignment_equals_a_plain_one(spark, sf_dir, docs, clashing, none):
    rows = docs.collect()
    want = sorted(((r.doc_id, *w) for r, w in zip(rows, brute_alignment([r.text for r in rows]), strict=True)), key=repr)
    assert rows_of(align.cross_alignment(docs, *paths()), "doc_id", *COLUMNS) == want
    assert rows_of(align.cross_alignment(clashing, *paths()), "doc_id", *COLUMNS) == want
    assert align.cross_alignment(none, *paths()).count() == 0
    texts = odd_texts(3000)
    odd = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in align.cross_alignment(odd, *paths()).select("doc_id", *COLUMNS).collect()}
    assert [got[i] for i in range(len(texts))] == brute_alignment(texts)


def test_long_texts_align_in_blocks(monkeypatch):
    text = " ".join(odd_texts(200, 9)).replace("▁", "_")
    whole = align.Aligner(*paths()).text(text)
    assert whole[0] > 500
    monkeypatch.setattr(align, "BLOCK_TOKENS", 7)
    monkeypatch.setattr(align, "CACHE_WORDS", 5)
    parts = align.Aligner(*paths()).text(text)
    assert whole[:5] == parts[:5] and (whole[5] == parts[5]).all() and (whole[6] == parts[6]).all()


def test_new_words_are_encoded_together_and_frequent_ones_stay_known(monkeypatch):
    words, asked = align.Aligner(*paths()).words, []
    encode = words._encoded
    monkeypatch.setattr(words, "_encoded", lambda new: asked.append(list(new)) or encode(new))
    monkeypatch.setattr(align, "CACHE_WORDS", 4)
    for k in range(20):
        assert words.ids([f"rare{k}", "the", f"once{k}", "the"])[1:] == words.ids(["the", f"once{k}", "the"])
    assert asked == [["rare0", "the", "once0"]] + [[f"rare{k}", f"once{k}"] for k in range(1, 20)]
    assert len(words.known) <= 4 and len(words.older) <= 4
    odd = [" a", "b ", "▁c", "d\n", "a\x00b", "water", "中文"]
    together = words._encoded(odd)
    assert together == [encode([w])[0] for w in odd] and together[5] and not together[2]
