"""The quality classifier, preference pairs, packing, vectors and the pipeline."""

import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tarnwell.llm import hnsw, langid, quality, queries
from tarnwell.llm.chat import preference_pairs, runs_text
from tarnwell.llm.hnsw import near_vectors
from tarnwell.llm.packing import balanced, pack
from tests.llm.conftest import rows_of
from tests.llm.test_text_operators import brute_contaminated, brute_near, brute_repeats, roots


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_quality_of_held_out_labels(spark, docs, none):
    big = "/root/testdata/sf0.01"
    all_docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    models = quality.train(all_docs, labels.where(half))
    got = quality.score_quality(all_docs, models).join(labels.where(~half), "doc_id").toPandas()
    assert auc(got["score"].to_numpy(), got["quality"].to_numpy()) >= 0.9
    assert got["score"].between(0, 1).all() and ((got["score"] >= quality.ACCEPT) == got["accepted"]).all()
    good = got[got["quality"] == 1]
    assert good["accepted"].mean() >= 0.9
    edge = quality.score_quality(docs, models)
    assert edge.count() == docs.count() and edge.where("score is null").count() == 0
    assert quality.score_quality(none, models).count() == 0
    untaught = quality.train(docs, labels.limit(0))
    assert quality.score_quality(docs, untaught).count() == docs.count()


def test_preference_pairs_equal_sql_and_rules(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view conversations as from '{sf_dir}/conversations.parquet'")
    want = con.sql(queries.OP7_SQL)
    cols = [c[0] for c in want.description]
    assert rows_of(queries.op7_preference_pairs(spark, sf_dir), *cols) == sorted(want.fetchall(), key=repr)
    turns = [
        (1, 0, 0, "system", "s"), (1, 0, 1, "user", "hi"), (1, 0, 2, "assistant", "yes"), (1, 1, 0, "system", "s"), (1, 1, 1, "user", "hi"), (1, 1, 2, "assistant", "no"),
        (2, 0, 0, "user", None), (2, 0, 1, None, "x <|end|> y"), (2, 1, 0, "user", None), (2, 1, 1, None, "x <|end|> y"), (3, 0, 0, "assistant", ""), (None, 0, 0, "user", "q"),
    ]
    df = spark.createDataFrame(turns, "pair_id long, side int, turn long, role string, text string").withColumn("prompt", F.lit("mine"))
    got = {r.pair_id: r for r in preference_pairs(df, "pair_id", "side").withColumns({"c": runs_text(F.col("chosen_mask"))}).collect()}
    assert got[1].n_prompt == 2 and got[1].prompt.count("hi") == 1 and "yes" in got[1].chosen and "no" in got[1].rejected
    start, end = map(int, got[1].c.split("-"))
    assert got[1].chosen[start:end].startswith("yes")
    assert got[2].n_prompt == 2 and got[2].chosen == got[2].rejected == "" and got[3].rejected is None
    assert preference_pairs(df.limit(0), "pair_id", "side").count() == 0


def test_packing_is_an_exact_round_trip(spark, docs, none):
    path = public_tokenizers.path
    args = (path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = pack(docs, *args, with_ids=True).toPandas()
    tok = Tokenizer.from_file(args[0])
    want = sorted(repr((r.doc_id, [*tok.encode(r.text or "", add_special_tokens=False).ids, 1])) for r in docs.collect() if r.doc_id is not None and r.doc_id != 900005)
    known = got[got["doc_id"].notna() & (got["doc_id"] != 900005)].sort_values("start")
    joined = {d: [int(i) for x in g["ids"] for i in x] for d, g in known.groupby("doc_id")}
    assert sorted(repr((int(d), x)) for d, x in joined.items()) == want
    for r in got.itertuples():
        ids = np.array(list(r.ids), dtype="<u4")
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32 and len(ids) == r.length
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.concatenate([[0], np.cumsum(g["length"].to_numpy())[:-1]])).all() and g["length"].sum() <= 2048
    sums = got.groupby("sequence_id")["length"].sum().to_numpy()
    padded = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sums)
    assert padded <= 0.05 * sums.sum() + 2048
    assert got["sequence_id"].min() >= 0
    assert pack(none, *args).count() == 0


def brute_vectors(rows, least=0.93):
    ok = [(i, np.array(v, dtype="f8"), y) for i, v, y in rows if v is not None and i is not None and y is not None and None not in v]
    ok = [(i, v / np.linalg.norm(v), y) for i, v, y in ok if np.isfinite(v).all() and v.any()]
    links, n = [], defaultdict(int)
    for a, (i, v, y) in enumerate(ok):
        for j, w, z in ok[a + 1 :]:
            if y == z and len(v) == len(w) and float(v @ w) >= least:
                links.append((i, j))
                n[i] += 1
                n[j] += 1
    top = roots({r[0] for r in rows if r[0] is not None}, links)
    return sorted(((i, n[i], top[i], top[i] == i) for i, _, _ in rows), key=repr)


@pytest.mark.parametrize("shard", [40, 4000])
def test_vectors_equal_brute_force(spark, sf_dir, shard):
    base = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    some = [float(x) for x in base.where("label = 3").first().embedding]
    odd = [(90001, None, 3), (90002, [0.0] * 64, 3), (90003, [None] * 64, 3), (90004, [float("nan")] * 64, 3), (90005, [float("inf")] * 64, 3), (90006, some, None), (90007, some, 3), (90008, [2 * x for x in some], 3), (90009, some, 4)]
    df = base.union(spark.createDataFrame(odd, "vec_id long, embedding array<float>, label int"))
    got = rows_of(near_vectors(df.withColumn("graph", F.lit("mine")), shard=shard), "vec_id", "n_links", "component_id", "kept")
    want = brute_vectors([tuple(r) for r in df.collect()])
    assert len(got) == len(want)
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want) > 0
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.98 * len(want)
    assert near_vectors(df.limit(0)).count() == 0


def planted(rng, sizes, dim=32):
    """Groups of vectors whose mutual cosine is about the given one."""
    out = []
    for n, cosine in sizes:
        c = rng.normal(size=dim)
        c /= np.linalg.norm(c)
        z = rng.normal(size=(n, dim))
        z -= np.outer(z @ c, c)
        z /= np.linalg.norm(z, axis=1)[:, None]
        out.append(np.sqrt(cosine) * c + np.sqrt(1 - cosine) * z)
    return np.concatenate(out)


@pytest.mark.parametrize("shard", [8192, 700])
def test_vectors_of_planted_groups(spark, shard):
    """Groups of 2 to 600 about the threshold, in one shard and over several: hardly a link is missed, and none is made up."""
    rng = np.random.default_rng(3)
    x = np.concatenate([planted(rng, [(2, 0.99), (3, 0.95), (10, 0.93), (50, 0.93), (600, 0.94), (200, 0.9), (5, 0.935)]), rng.normal(size=(900, 32))])
    x = np.concatenate([x, x[:4], 3 * x[20:24]])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    links = unit @ unit.T >= 0.93
    np.fill_diagonal(links, False)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in near_vectors(df, shard=shard).collect()}
    n = np.array([got[i].n_links for i in range(len(x))])
    assert (n <= links.sum(1)).all() and n.sum() >= 0.99 * links.sum()
    linked = links.sum(1) > 0
    assert np.mean(n[linked] / links.sum(1)[linked]) >= 0.95  # each vector by itself
    top = roots(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(links), strict=True)])
    assert sum(got[i].component_id == top[i] for i in range(len(x))) >= 0.99 * len(x)


def test_vectors_of_a_failed_audit_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "WIDEST", 1)
    rng = np.random.default_rng(4)
    x = np.concatenate([planted(rng, [(30, 0.93), (4, 0.95)]), rng.normal(size=(50, 32))])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for shard in (25, 1000):
        out, same = hnsw.Links(np.arange(len(x)), np.ones(len(x), "i8")), df
        hnsw._linked(hnsw.Graph(hnsw._units(x), ids=np.arange(len(x))), x, x, np.arange(len(x)), 0.93, out, 0)
        want = brute_vectors(rows)
        assert [int(d) for d in out.degree] == [w[1] for w in sorted(want)]
        assert {r.vec_id: r.n_links for r in near_vectors(same, shard=shard).collect()} == {w[0]: w[1] for w in want}


def test_columns_of_the_same_names(spark, clashing, docs, none):
    """Other columns may have the names of an operator's own."""
    mine = clashing.withColumns({c: F.lit("mine") for c in ("lang_pred", "rejected", "p_content", "accepted", "start", "length", "offset", "ids", "v", "u", "y", "t", "__h1")})
    known = langid.train(mine)
    assert rows_of(langid.predict(mine, known), "doc_id", "lang_pred", "score") == rows_of(langid.predict(docs, langid.train(docs)), "doc_id", "lang_pred", "score")
    labels = spark.createDataFrame([(i, i % 2, "mine") for i in range(40)], "doc_id long, quality int, v string")
    models = [quality.train(d, labels) for d in (mine, docs)]
    assert all((a.w == b.w).all() for a, b in zip(*models, strict=True))
    assert rows_of(quality.score_quality(mine, models[0]), "doc_id", "accepted") == rows_of(quality.score_quality(docs, models[0]), "doc_id", "accepted")
    assert quality.keep_good(mine, models[0]).columns == mine.columns
    args = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert rows_of(pack(mine, *args), "doc_id", "start", "length", "ids_crc32") == rows_of(pack(docs, *args), "doc_id", "start", "length", "ids_crc32")


def test_languages_equal_brute_force(docs):
    """Each text's letters, compressed with each dictionary by itself."""
    known = langid.train(docs)
    want = {}
    for r in docs.select("doc_id", langid.letters(F.col("text")).alias("t")).where("doc_id is not null and doc_id < 60").collect():
        data, sizes = r.t.encode(), {}
        for lang, d in known.items():
            raw = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, source_size=langid.PIECE, dict_size=len(d), min_match=langid.SHORTEST, write_content_size=0)
            sizes[lang] = sum(len(zstandard.ZstdCompressor(compression_params=how, dict_data=raw).compress(data[i : i + langid.PIECE])) for i in range(0, len(data), langid.PIECE))
        want[r.doc_id] = min(sorted(sizes), key=sizes.get) if data else "und"
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs.where("doc_id < 60"), known).collect()}
    assert {d: got[d] for d in want} == want and len(set(want.values())) > 1


def test_conversations_that_are_empty_or_very_long(spark):
    long = [(1, side, k, "user" if k % 2 == 0 else "assistant", f"turn {k} {'same' if k < 9_000 else side}") for side in (0, 1) for k in range(10_000)]
    rows = [*long, (2, 0, 0, "user", ""), (2, 1, 0, "user", ""), (3, 0, None, None, None), (3, 1, 0, "assistant", "x" * 1_000_000), (4, 2, 0, "user", "no side")]
    got = {r.pair_id: r for r in preference_pairs(spark.createDataFrame(rows, "p long, side int, turn long, role string, text string"), "p", "side").collect()}
    assert got[1].n_prompt == 9_000 and got[1].n_chosen == 1_000 and len(got[1].chosen_mask) == 500
    assert all(got[1].chosen[m.s : m.e].endswith("<|end|>\n") and "turn" in got[1].chosen[m.s : m.e] for m in got[1].chosen_mask)
    assert got[2].n_prompt == 1 and got[2].chosen == "" and got[2].chosen_mask == [] and got[3].n_prompt == 0 and len(got[3].rejected) > 1_000_000
    assert got[4].chosen is None and got[4].rejected is None


def test_pieces_go_to_the_cheapest_sequence_with_room():
    rng = np.random.default_rng(2)
    lengths, size = rng.integers(1, 130, 60), 64
    n = -(-int(lengths.sum()) // size)
    cost, room, want, full = [0.0] * n, [size] * n, [], 0
    rest = []
    for d, length in enumerate(lengths.tolist()):
        start = 0
        while length - start >= size:
            want.append((d, start, size, full, 0))
            room[full], full, start = 0, full + 1, start + size
        rest += [(-(length - start), d, start)] if length > start else []
    for length, d, start in sorted(rest, key=lambda r: (r[0], r[1])):
        length = -length
        while length:
            free = [k for k in range(n) if room[k] >= length] or [k for k in range(n) if room[k]]
            k = min(free, key=lambda k: (cost[k], k))
            part = min(length, room[k])
            want.append((d, start, part, k, size - room[k]))
            room[k], cost[k], start, length = room[k] - part, cost[k] + part + part * part / size, start + part, length - part
    assert balanced(lengths, size, 1.0, 1 / size) == want


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_pipeline_stages_with_odd_rows(spark, sf_dir, docs, none, name):
    """Empty tables, null ids, repeated ids with different texts, and columns of the callers' own."""
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, none, sf_dir).count() == 0
    base = " ".join(f"w{i}" for i in range(60))
    odd = [(1, base, "en", "s", 1), (2, base + " more", "en", "s", 1), (2, "a text that is like no other one at all", "en", "s", 1), (1, base + " again", "en", "s", 1), (None, base, None, None, None), (None, None, None, None, None), (3, "", None, None, 0), (3, "", None, None, 0)]
    df = spark.createDataFrame(odd, docs.schema).withColumns({"__h1": F.lit("mine"), "kept": F.lit("mine"), "cls": F.lit("mine"), "score": F.lit("mine")})
    out = stage(spark, df, sf_dir)
    if name == "packing":
        assert {r.doc_id for r in out.collect()} == {1, 2, 3, None}
        return
    assert out.columns == df.columns and out.where("kept = 'mine' and score = 'mine'").count() == out.count()
    if name == "near_duplicates":
        assert sorted((r.doc_id or 0, len(r.text or "")) for r in out.collect() if r.doc_id != 1) == [(0, 0), (0, len(base)), (2, 39), (3, 0), (3, 0)]
        assert out.where("doc_id = 1").count() == 1
    elif name in ("repeats", "decontamination"):
        assert out.count() == len(odd)


def test_pipeline_stages_against_brute_force(spark, sf_dir, docs):
    stage = dict(corpus_pipeline.STAGES)
    cols = docs.columns
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect() if r.doc_id is not None and r.doc_id != 900005]
    df = docs.where("doc_id is not null and doc_id <> 900005")  # brute force knows documents by id
    good = stage["quality"](spark, df, sf_dir)
    assert good.columns == cols and good.count() <= df.count()
    kept = stage["near_duplicates"](spark, df, sf_dir)
    assert kept.columns == cols and rows_of(kept, "doc_id") == sorted(((w[0],) for w in brute_near(rows) if w[3]), key=repr)
    cut = stage["repeats"](spark, df.where("doc_id <> 900007"), sf_dir)
    short = [r for r in rows if r[0] != 900007]
    assert cut.columns == cols and rows_of(cut, "doc_id", F.coalesce("text", F.lit(""))) == sorted(((d, x.decode(errors="replace")) for (d, _), x in zip(short, brute_repeats(short)[1], strict=True)), key=repr)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = stage["decontamination"](spark, df, sf_dir)
    assert clean.columns == cols and rows_of(clean, "doc_id") == sorted(((w[0],) for w in brute_contaminated(rows, items) if not w[5]), key=repr)
    assert re.match("packing", corpus_pipeline.STAGES[-1][0]) and stage["packing"](spark, clean, sf_dir).count() > 0


def test_pipeline_runs(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
