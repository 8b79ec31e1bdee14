"""Spelling variants, importance resampling and reversible line dedup: whole results against plain recomputation, and odd inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import linededup, queries, resampling, spelling

SMALL = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t\n"), (4, "One line\n one LINE \r\nÉté\n"), (4, "One line\n one LINE \r\nÉté\n"), (None, "no id ärger ärger"), (5, "word " * 30_000), (6, "a\x00b c×d   中文"), (7, "x" * 5000 + "\n" + "straße STRASSE " * 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("a.b `c`", F.lit(1)).withColumn("word", F.lit("clash")).withColumn("rank", F.lit(0))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# --- spelling ---------------------------------------------------------------------------------------------------------


def variants(rows):
    count = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", low(t)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w
            count[w] += len(w) >= 5
    known = {w: n for w, n in count.items() if n >= 3}
    near, holes = {w: set() for w in known}, defaultdict(list)
    for w in known:
        for k in range(len(w)):
            short = w[:k] + w[k + 1 :]
            holes[w[:k], w[k + 1 :]].append(w)
            if short in known:
                near[w].add(short)
                near[short].add(w)
    for ws in holes.values():
        for w in ws:
            near[w].update(x for x in ws if x != w)
    form = {}
    for w, ws in near.items():
        best = min(ws, key=lambda x: (-known[x], x), default=None)
        if best and known[best] >= 2 * known[w]:
            form[w] = best
    out = {}
    for w, n in known.items():
        r = w
        while r in form:
            r = form[r]
        out[w] = (form.get(w), r, n, len(near[w]), known.get(form.get(w)))
    return out


def by_word(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_spelling(spark, docs, odd, none):
    want = variants([(r.doc_id, r.text) for r in docs.collect()])
    got = by_word(queries.op11_spelling(spark, SMALL))
    assert got == want and any(f for f, *_ in want.values())
    assert by_word(spelling.spelling_variants(odd)) == variants(ODD)
    assert spelling.spelling_variants(none).count() == 0


def test_crowded_keys_and_any_letters(spark):
    rng = np.random.default_rng(2)
    words = {"".join(rng.choice(list("aeiéñ中"), 6)) for _ in range(1500)} | {"aaaaa", "aaaaaa", "aaaaaaa"}
    rows = [(w, int(rng.integers(3, 90))) for w in sorted(words)]
    near = lambda a, b: a != b and (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 or abs(len(a) - len(b)) == 1 and any(max(a, b, key=len)[:k] + max(a, b, key=len)[k + 1 :] == min(a, b, key=len) for k in range(8)))
    want = {(a, b) for a, _ in rows for b, _ in rows if near(a, b)}
    df = spark.createDataFrame(rows, "word string, n long")
    for crowd in (spelling.CROWD, 64):
        got = [(r.word, r.near) for r in spelling.near_words(df, crowd).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_forms_lead_to_roots(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(40)] + [("v", "w3")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w40" for w, _ in chain}


# --- resampling -------------------------------------------------------------------------------------------------------


def features(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    return len(w), [zlib.crc32(f.encode()) % 10000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


def drawn(rows, target):
    own = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for x in own for b in x[2]), Counter(b for x in target for b in features(x)[1])
    total, aim = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total + 10000) / ((s[b] + 1) * (aim + 10000)))) for b in s}
    out = []
    for i, n, f in own:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    place = {id(r): k for k, r in enumerate(able[: 25 * len(able) // 100], 1)}
    return sorted(((*r[:4], place.get(id(r))) for r in out), key=repr)


def test_resampling(spark, docs, odd, none):
    shown = lambda df: sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)
    target = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert shown(queries.op12_resampling(spark, SMALL)) == drawn([(r.doc_id, r.text) for r in docs.collect()], target)
    few = spark.createDataFrame([("one line été",), (None,)], "text string")
    many = odd.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 10)).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 20))
    rows = [(r.doc_id, r.text) for r in many.collect()]
    assert shown(resampling.resample(many, few)) == drawn(rows, ["one line été", None])
    assert shown(resampling.resample(odd, few.where("false"))) == drawn(ODD, [])
    assert resampling.resample(none, few).count() == 0


def test_hot_bucket_in_parts_and_few_slices_held(spark, monkeypatch):
    rows = [(i, "same words here again " * (1 + i % 7) + f"own{i % 50}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    few = spark.createDataFrame([("own7 words",)], "text string")
    monkeypatch.setattr(resampling, "DEAL_BYTES", 500)
    monkeypatch.setattr(resampling, "HELD", 2)
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in resampling.resample(df, few).collect()), key=repr)
    assert got == drawn(rows, ["own7 words"])


# --- lines ------------------------------------------------------------------------------------------------------------


def dropped(rows, at_least=10, shortest=1):
    keys = [[low(x).strip(" \t\n\x0b\x0c\r") for x in (t or "").split("\n")] for _, t in rows]
    n = Counter(k for ks in keys for k in set(ks) if len(k) >= shortest)
    out = []
    for (i, t), ks in zip(rows, keys):
        kept = [x for x, k in zip((t or "").split("\n"), ks) if n[k] < at_least]
        out.append((i, len(ks), len(ks) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def lines(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect()), key=repr)


def test_lines(spark, docs, odd, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = dropped(rows)
    assert [(a, b, c, hashlib.sha256(d.encode()).hexdigest()) for a, b, c, d in want] == sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.op13_lines(spark, SMALL).collect()), key=repr)
    assert lines(linededup.dedup_lines(docs, at_least=2)) == dropped(rows, 2)
    for shortest in (1, 4):
        assert lines(linededup.dedup_lines(odd, at_least=2, shortest=shortest)) == dropped(ODD, 2, shortest)
    assert linededup.dedup_lines(none).count() == 0


def test_lines_beyond_the_broadcast(spark, docs, odd, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 300)
    monkeypatch.setattr(linededup, "TASK_ROWS", 100)
    for df, n in ((docs, 2), (odd, 2)):
        index = linededup.inserted(linededup.empty_index(spark, n), df)
        assert index.shards > 1 or df is odd
        want = dropped([(r.doc_id, r.text) for r in df.collect()], n)
        assert lines(linededup.drop_lines(index, df)) == want and lines(linededup.drop_lines(index, df, most_bytes=-1)) == want


def test_deleting_undoes_inserting(spark, docs, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 300)
    first, more = docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")
    table = lambda x: sorted(map(tuple, x.counts.collect()))
    one = linededup.inserted(linededup.empty_index(spark, 2), first)
    both = linededup.inserted(one, more)
    back = linededup.deleted(both, more)
    assert table(back) == table(one) != table(both)
    assert lines(linededup.drop_lines(back, first)) == lines(linededup.drop_lines(one, first)) == dropped([(r.doc_id, r.text) for r in first.collect()], 2)
    assert lines(linededup.drop_lines(both, docs)) == dropped([(r.doc_id, r.text) for r in docs.collect()], 2)
    nothing = linededup.deleted(back, first)
    assert nothing.counts.count() == 0 and all(r.n_dropped == 0 for r in linededup.drop_lines(nothing, none_of(docs)).collect())
    with pytest.raises(ValueError):
        linededup.deleted(one, more)


def none_of(docs):
    return docs.withColumn("text", F.lit("a line\nanother"))


def test_filter():
    rng = np.random.default_rng(1)
    hi, lo = rng.integers(0, 1 << 63, (2, 4000), np.uint64)
    lo[:50] = lo[50:100]  # equal fingerprints are kept as often as inserted
    own = linededup.CuckooFilter(4000)
    assert own.insert(hi, lo) and own.holds(hi, lo).all()
    own.remove(hi[:2000], lo[:2000])
    assert own.holds(hi[2000:], lo[2000:]).all() and own.holds(hi[:2000], lo[:2000]).sum() < 60
    full = linededup.CuckooFilter(8)
    assert not full.insert(hi[:500], lo[:500])
