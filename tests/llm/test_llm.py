"""The training-data operators against brute force, and their defined results in odd cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from sievework.llm import bytebpe, langid, license, packing, piece_codec, quality, queries, sharding, simhash, simhash_groups, tokencount, topk, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, score double, bin long"


@pytest.fixture(scope="module")
def odd(spark):
    base = " ".join(f"word{i % 61} and the other thing" for i in range(90))
    near = base.replace("word7 ", "word8 ", 1)
    rows = [(1, base), (2, base), (3, near), (4, None), (5, ""), (6, "x"), (7, "12 34 !!"), (8, "   \n \t "), (None, "a null id here"), (9, "the and of " * 30_000), (10, "ein Text über schöne Dinge"), (10, "ein Text über schöne Dinge"), (11, "日本 <|endoftext|> \x00 ▁▁ x"), (12, "You 1D10T and m0rоn! " * 3)]
    return spark.createDataFrame([(i, t, None if i == 6 else "en", None, None, "clash", 1.0, 3) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_token_counts(spark, odd, none, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    n = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    for df in (odd, docs):
        with_edits = df.withColumn("edits", queries.sample_edits(F.col("text")))
        want = Counter()
        for r in with_edits.collect():
            t = r.text or ""
            before = n(t)
            for e in r.edits:
                t = t[: e["from"]] + e["new"] + t[e["to"] :]
            want[r.doc_id, before, n(t), len(t)] += 1
        got = Counter((r.doc_id, r.n_tokens, r.n_tokens_edited, r.n_chars_edited) for r in tokencount.count_edited(with_edits, "edits").collect())
        assert got == want
    assert tokencount.count_edited(none.withColumn("edits", queries.sample_edits(F.col("text"))), "edits").count() == 0


def test_token_tree_random():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    c, r = tokencount.PreTokenCounter(bytebpe.word_ids(bytebpe.default_path())), random.Random(3)
    some = lambda n: "".join(r.choice("ab c  the\n\t'sll 12.,é日") for _ in range(n))
    for _ in range(200):
        t = some(r.choice([0, 1, 60, 3000]))
        tree = tokencount.TokenTree(t, c)
        for _ in range(5):
            a, new = r.randrange(len(t) + 3), some(r.choice([0, 1, 10, 400]))
            b = a + r.choice([0, 1, 40, 500])
            t = t[:a] + new + t[b:]
            tree.edit(a, b, new)
            assert tree.text == t and tree.count == len(tok.encode(t, add_special_tokens=False).ids)


def brute_components(fps):
    ids = list(range(len(fps)))
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in ids:
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i in ids:
        least[root(i)].append(fps[i][0])
    return {i: min((x for x in least[root(i)] if x is not None), default=None) for i in ids}


def test_simhash(spark, odd, none, docs):
    for df in (odd, docs):
        rows = texts(df)
        fps = [(d, simhash.fingerprint(t)) for d, t in rows]
        comp = brute_components(fps)
        want = Counter((d, f"{fp:016x}", comp[i]) for i, (d, fp) in enumerate(fps))
        got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
        assert got == want
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash_groups.keep_one(odd)
    assert kept.columns == odd.columns
    assert len({r.doc_id for r in kept.collect()} & {1, 2, 3}) == 1 and kept.where("doc_id = 10").count() == 1


def test_simhash_crowded_buckets(spark):
    g, start = random.Random(5), 0x0123456789ABCDEF
    fps = {start}
    for _ in range(1500):
        fps.add(g.choice(sorted(fps)[-300:]) ^ (1 << g.randrange(64)) ^ (1 << g.randrange(64)))
    fps = list(fps) + [g.getrandbits(64) for _ in range(300)]
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame, bucket=50)).collect()}
    comp = brute_components([(i, x) for i, x in enumerate(fps)])
    got, want = defaultdict(set), defaultdict(set)
    for i, x in enumerate(fps):
        s = x - (1 << 64) if x >> 63 else x
        got[roots.get(s, s)].add(i)
        want[comp[i]].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_simhash_groups(spark, none):
    g = random.Random(9)
    bases = [[f"w{g.randrange(4000)}" for _ in range(g.randrange(40, 400))] for _ in range(60)]
    rows = [" ".join(b) for b in bases]
    for b in bases[:30]:
        for n in (1, 1, 2, 8):  # words changed: from copies to texts that are no longer alike
            other = list(b)
            for _ in range(n * len(b) // 100 + 1):
                other[g.randrange(len(b))] = f"x{g.randrange(9999)}"
            rows.append(" ".join(other))
    rows += [rows[0].upper(), rows[1], "one two", "two one", "one  TWO", "", None]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(rows)], "doc_id long, text string, node string")
    sets = [simhash_groups.shingles(simhash_groups._split(t)) for t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for k in range(i):
            if simhash_groups.similarity(sets[i], sets[k]) >= 0.8 and root(i) != root(k):
                parent[max(root(i), root(k))] = min(root(i), root(k))
    want = {i for i in range(len(rows)) if root(i) == i}
    for crowd in (simhash_groups.CROWD, 8):
        kept = simhash_groups.keep_one(docs, crowd=crowd)
        got = {r.doc_id for r in kept.collect()}
        assert kept.columns == docs.columns
        assert got == want
    assert simhash_groups.keep_one(none).count() == 0
    odd_columns = docs.limit(3).selectExpr("doc_id", "text", "map('a', doc_id) as m", "1 as __mark_a", "2 as __mark_b", "3 as __copies", "4 as bands")
    kept = simhash_groups.keep_one(odd_columns)
    assert kept.columns == odd_columns.columns and {(r.m["a"], r["__mark_a"], r["__mark_b"]) for r in kept.collect()} == {(i, 1, 2) for i in range(3)}


def test_star_contraction(spark):
    g = random.Random(2)
    edges = [(g.randrange(400), g.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(500, 560)]
    frame = spark.createDataFrame(edges, "a long, b long")
    one, rounds = ({r.node: r.root for r in simhash.components(frame, n).collect() if r.node != r.root} for n in (1000, 0))
    assert one == rounds and one[560] == 500


def test_packing(spark, odd, none, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for df in (odd, docs):
        want = Counter()
        for d, t in texts(df):
            ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
            for k, (s, n) in enumerate(packing.cut_lengths(len(ids), 2048)):
                want[d, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
        rows = packing.pack(df).collect()
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        at = defaultdict(list)
        for r in rows:
            at[r.sequence_id].append((r.offset, r.length))
        for parts in at.values():
            end = 0
            for o, n in sorted(parts):
                assert o == end
                end += n
            assert end <= 2048
        assert len(at) <= 1.05 * sum(r.length for r in rows) / 2048 + 1
    assert packing.pack(none).count() == 0


def brute_features(t):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if x]
    lines = [x for x in (t or "").split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
    win = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality(spark, odd, none, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for df in (odd, docs):
        got = quality.judge(df, labels).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((d, *brute_features(t)) for d, t in texts(df))
        assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality.judge(none, labels).count() == 0
    assert quality.judge(odd, labels.where("false")).where("not base_failed and not kept").count() == 0
    assert abs(quality.binomial_cdf(2, 10, 0.3) - 0.3827827864) < 1e-9 and not quality.passes(0, 10, 0.02, 0.01) and quality.passes(0, 500, 0.02, 0.01)


def test_quality_cutoffs_keep_the_risk(spark):
    rows = [(i, 100, 500, 60 if i % 4 == 0 else (20 if i % 200 == 1 else 0), 0, 0, 1, 0) for i in range(8000)]
    feats = spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(8000)], "doc_id long, quality int")
    chosen = quality.cutoffs(feats, labels)
    assert set(chosen) == {(0, "symbols")} and 0.04 <= chosen[0, "symbols"] < 0.12


def test_sharding(spark, odd, none, docs):
    for df in (odd, docs):
        got = sharding.shard(df).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts(df))
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
            assert r.grown_shard in (r.shard, 8) and r.law == "key"
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(none).count() == 0
    heavy = Counter(r.shard for r in sharding.shard(docs, [3.0, 1.0]).collect())
    assert heavy[0] > 2 * heavy[1]


def test_toxicity(spark, odd, none, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    lex = toxicity.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels)
    score = {r.doc_id: r.toxicity for r in toxicity.score(odd, lex).collect()}
    assert score[12] >= 0.5 and all(v < 0.5 for k, v in score.items() if k != 12) and score[4] == score[5] == 0.0
    assert toxicity.score(none, lex).count() == 0
    assert toxicity.learn(none, labels).weights == {} and toxicity.learn(docs, labels.where("false")).weights == {}
    own = toxicity.Matcher(toxicity.Lexicon({toxicity.fold("clown") + " ": 2.0}, 1.0))
    assert own.weight("a clown fish")[0] == 0 and own.weight("a CL0WN, a clown")[0] == 4.0 and own.weight("clownish")[0] == 0
    assert toxicity.mark(odd.withColumn("toxicity", F.lit("clash")), lex).columns.count("toxicity") == 1
    kept = toxicity.mark(odd, lex, keep_below=0.5)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1


def test_topk(spark):
    g = np.random.default_rng(2)
    x = np.round(g.normal(size=(420, 20)), 3)
    x[200:260] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1100, [float("nan")] * 20), (1200, [None] + [0.0] * 19), (None, [0.0] * 20), (1300, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    z = np.floor(1024 * x).astype(np.int64)
    want = set()
    for q in range(0, 420, 100):
        s = z @ z[q]
        want |= {(q, k + 1, int(j), int(s[j])) for k, j in enumerate([j for j in np.lexsort((np.arange(420), -s)) if j != q][:10])}
    assert {tuple(r) for r in topk.search(df).collect()} == want
    assert {tuple(r) for r in topk.search(df, block=2).collect()} == want
    assert topk.search(df.where("false")).count() == 0


def test_language(spark, odd, none):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(big)
    got = langid.predict(big, model).join(big.select("doc_id", "lang"), "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert got > 0.97
    out = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, model).collect()}
    assert out[4] == out[5] == out[7] == out[8] == ("und", 0.0) and out[10][0] == "de"
    assert langid.predict(none, model).count() == 0 and langid.learn(none).langs == []
    assert {r.lang_pred for r in langid.predict(odd, langid.learn(none)).collect()} == {"und"}
    assert langid.keep(odd, model).columns == odd.columns


def test_language_marginals():
    path = langid.default_path()
    v, seg, p = langid.vocabulary(path), langid.Segmenter(path), None
    p = np.random.default_rng(0).random((len(v) + 1, 2)) * 0.01
    for w in ("the", "schön", "日本", "zz" * 8):
        t = "▁" + w
        for k in range(2):
            a = [1.0] + [0.0] * len(t)
            for e in range(1, len(t) + 1):
                for s in range(e):
                    a[e] += a[s] * (p[v[t[s:e]], k] if t[s:e] in v else p[-1, k] if e == s + 1 else 0.0)
            assert abs(langid.likelihoods(seg, [w], p)[0, k] - np.log(a[-1])) < 1e-9


def test_license(spark, odd, none, docs):
    rows = [(1, "x " * 50 + "Licensed under the Apache License,\nVersion 2.0. " + "y " * 30), (2, "Permission is hereby granted, free of charge, to any person"), (3, license.TEMPLATES["mit grant"].upper()), (4, None), (5, "Released under the MIT License."), (5, "Released under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.license) for r in license.scan(df).collect()) == [(1, "apache-2.0 notice"), (3, "mit grant"), (5, "mit notice"), (5, "mit notice")]
    assert license.scan(odd).count() == 0 and license.scan(none).count() == 0
    w = lambda t: __import__("re").findall(r"[^\W_]+", t.lower())
    sh = lambda t: {tuple(w(t)[i : i + 5]) for i in range(len(w(t)) - 4)}
    want = {(d, n) for d, t in texts(docs) for n, m in license.TEMPLATES.items() if len(sh(m) & sh(t or "")) >= 0.8 * len(sh(m))}
    assert {(r.doc_id, r.license) for r in license.scan(docs).collect()} == want and want


def test_pieces(spark, odd, none, docs):
    import sentencepiece

    sp, c, r = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), piece_codec.codec(), random.Random(1)
    for t in ["".join(r.choice("ab ethin\n  ▁é日.,THE") for _ in range(r.randrange(40))) for _ in range(1500)] + ["abab" * 400, " a", "a ", "▁"]:
        n, ids, decoded = c.both(t)
        assert ids == ",".join(map(str, sp.encode(t))) and decoded == sp.decode(sp.encode(t)) and c.encode(t) == sp.encode(t) and c.decode(c.encode(t)) == decoded
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for df in (odd, docs):
        want = Counter((d, len(ids := sp.encode(t or "")), sha(",".join(map(str, ids))), sha(sp.decode(ids))) for d, t in texts(df))
        assert Counter(tuple(x) for x in piece_codec.encode_documents(df, digests=True).collect()) == want
    assert piece_codec.encode_documents(none).count() == 0


def test_pipeline(spark, odd, none, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, df in (("odd", odd), ("none", none)):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    rows = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    ids = [r.doc_id for r in rows if r.piece == 0]
    assert len(ids) == len(set(ids)) and 4 not in ids and 5 not in ids and len({1, 2, 3} & set(ids)) == 1
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    whole = corpus_pipeline.run(spark, SF)
    assert 100 < whole.select("doc_id").distinct().count() <= 200


def test_topk_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    assert sorted(con.execute(queries.TOPK_SQL).fetchall()) == sorted(tuple(r) for r in queries.op7_topk(spark, SF).collect())


def test_pipeline_keeps_columns_of_any_name(spark, odd, tmp_path):
    import corpus_pipeline

    names = ["a.b", "a b", "a`b", "c0", "Text_", "node", "mark"]
    docs = odd.withColumns({n: F.lit(k) for k, n in enumerate(names)}).unionByName(odd.limit(2).withColumns({n: F.lit(k) for k, n in enumerate(names)}))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        kept = [tuple(r) for r in out.collect()]
        assert kept and all(r[-len(names) :] == tuple(range(len(names))) for r in kept), name
    assert corpus_pipeline.pack_sequences(spark, docs, str(tmp_path)).count() > 0
