"""Whole results against plain recomputation, without the operators' own search and counting."""

import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from sievework.llm import langid, quality, queries, sharding, simhash, toxicity

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").collect()


def test_fingerprints(spark, docs):
    def plain(text):
        words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())]
        if not words:
            return 0
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(len(words) - 2, 1))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    texts = [None, "", " \t", "One", "one TWO", "É é É é", *list(docs.values())[:150]]
    assert [simhash.fingerprint(t) for t in texts] == [plain(t) for t in texts]


def test_shards(spark):
    def plain(i, n):
        key = xxhash.xxh64_intdigest(struct.pack("<q", i), xxhash.xxh64_intdigest(b"id", 42))
        unit = lambda s: ((xxhash.xxh64_intdigest(struct.pack("<i", s), xxhash.xxh64_intdigest(struct.pack("<Q", key), 42)) >> 11) + 0.5) / (1 << 53)
        return max(range(n), key=lambda s: (-1 / math.log(unit(s)), -s))

    got = sharding.shard(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert [(r.shard, r.grown_shard) for r in got] == [(plain(r.doc_id, 8), plain(r.doc_id, 9)) for r in got]


def features(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    n, chars = len(w), sum(map(len, w))
    ratios = {"symbols": sum((t or "").count(c) for c in "#*$%&|<>") / max(chars, 1), "repeats": len(hit) / max(n, 1), "capitals": len(re.findall("[A-Z]", t or "")) / max(chars, 1), "duplicate_lines": (len(lines) - len(set(lines))) / max(len(lines), 1)}
    return n, n < 50 or 100 * len(hit) > 50 * n, ratios


def test_quality_verdicts(spark, docs, labels):
    own = {d: features(t) for d, t in docs.items()}
    band = lambda n: 0 if n < 200 else 1 if n < 1000 else 2
    mark = defaultdict(list)
    for r in labels:
        if r.doc_id in docs and not own[r.doc_id][1]:
            mark[docs[r.doc_id]].append((r.quality, r.doc_id))
    trials = [(min(v)[0], own[v[0][1]]) for v in mark.values()]
    marked, texts = {r.doc_id for r in labels}, set(mark)
    loose = [f for d, f in own.items() if not f[1] and d not in marked and docs[d] not in texts]
    sizes = {s: sum(q == 1 and band(f[0]) == s for q, f in trials) for s in range(3)}
    able = next((m for m in (3, 2, 1) if sum(0.98**n <= 0.05 / m for n in sizes.values()) >= m), 0)
    chosen = {}
    for s in sorted(sizes, key=lambda s: (-sizes[s], s))[:able]:
        good, bad = ([f[2] for q, f in trials if q == y and band(f[0]) == s] for y in (1, 0))
        rest = [f[2] for f in loose if band(f[0]) == s]
        part, chains = len(bad) / (len(good) + len(bad)), {}
        for rule in quality.RULES:
            b0 = g0 = 0.0
            chains[rule.name] = []
            for c in reversed(rule.grid):
                b, u = (sum(f[rule.name] > c for f in fs) / max(len(fs), 1) for fs in (bad, rest))
                g = max(0.0, (u - part * b) / (1 - part))
                worth = b - b0 - 5.0 * (g - g0)
                if b > b0 and worth > 0:
                    chains[rule.name].append((worth, c))
                    b0, g0 = b, g
        now = {}
        while any(chains.values()):
            name = max((n for n in chains if chains[n]), key=lambda n: chains[n][0][0])
            now[name] = chains[name].pop(0)[1]
            x = sum(any(f[n] > c for n, c in now.items()) for f in good)
            chance = sum(math.comb(len(good), k) * 0.02**k * 0.98 ** (len(good) - k) for k in range(x + 1))
            if x >= 0.02 * len(good) or chance > 0.05 / able:
                break
            chosen |= {(s, n): c for n, c in now.items()}
    assert chosen
    want = {d: not failed and all(v <= chosen.get((band(n), name), math.inf) for name, v in ratios.items()) for d, (n, failed, ratios) in own.items()}
    got = quality.judge(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert {r.doc_id: r.kept for r in got} == want


def plain_weight(text, weights, exceptions):
    words = toxicity.fold(text or "").split()
    line, total = f" {' '.join(words)} ", 0.0
    spared = [(m.start() + 1, m.end() - 1) for e in exceptions for m in re.finditer(f"(?={re.escape(' ' + ' '.join(toxicity.fold(e).split()) + ' ')})", line) for m in [re.compile(re.escape(" " + " ".join(toxicity.fold(e).split()) + " ")).match(line, m.start())]]
    for at in (k + 1 for k, c in enumerate(line) if c == " "):
        terms = [t for k in range(1, 42) if (t := line[at : at + k]) in weights and len(t) == k]
        if terms and not any(a <= at and at + len(terms[-1]) - 1 <= b for a, b in spared):
            total += weights[terms[-1]]
    return total, len(words)


def test_toxicity_by_hand(spark, docs, labels):
    toxic = {}
    for r in labels:
        if r.doc_id in docs and docs[r.doc_id] is not None and zlib.crc32(str(r.doc_id).encode()) % 5 and r.toxic is not None:
            toxic[r.doc_id] = max(r.toxic, toxic.get(r.doc_id, 0))
    first = {}
    for d, y in toxic.items():
        key = toxicity._family(docs[d].lower().split()), y
        first[key] = min(first.get(key, d), d)
    n, counts = Counter(int(y > 0) for _, y in first), (Counter(), Counter())
    for (_, y), d in first.items():
        words = {w for w in toxicity.fold(docs[d]).split() if 3 <= len(w) <= 40 and not w.isdigit()}
        counts[int(y > 0)].update({w + " " for w in words} | {w[:k] for w in words for k in (4, 5, 6) if len(w) > k})
    lift = {t: ((c + 0.5) / (n[1] + 1)) / ((counts[0][t] + 0.5) / (n[0] + 1)) for t, c in counts[1].items() if c >= 5}
    terms = sorted((t for t in lift if lift[t] >= 8), key=lambda t: (-counts[1][t] * math.log(lift[t]), t))[:4096]
    weights = {}
    for t in sorted(terms, key=lambda t: (len(t), t)):
        if not any(weights.get(t[:k], 0) >= 0.8 * math.log(lift[t]) for k in (4, 5, 6) if t[:k] in weights):
            weights[t] = math.log(lift[t])
    density = lambda w, k: w / (1 + math.log1p(k / 100))
    found = [(density(*plain_weight(docs[d], weights, toxicity.EXCEPTIONS)), y > 0) for d, y in toxic.items()]
    cells = [(-1 if x <= 0 else min(399, int(x / 0.05)), y) for x, y in found]
    errors = [sum((c >= k) != y for c, y in cells) for k in range(400)]
    cutoff = max(errors.index(min(errors)), 0.2) * 0.05
    lexicon = toxicity.learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert lexicon.weights.keys() == weights.keys() and weights and abs(lexicon.cutoff - cutoff) < 1e-9
    got = {r.doc_id: (r.held_out, r.score, r.predicted) for r in queries.op6_toxicity(spark, SF).collect()}
    for d, t in docs.items():
        x = density(*plain_weight(t, weights, toxicity.EXCEPTIONS))
        want = x / (x + cutoff) if x > 0 else 0.0
        assert got[d][0] == (zlib.crc32(str(d).encode()) % 5 == 0) and abs(got[d][1] - want) < 1e-9 and got[d][2] == int(got[d][1] >= 0.5)


def test_language_scores(spark):
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.learn(frame)
    vocabulary = langid.vocabulary(model.path)

    def forward(word, k):
        t = "▁" + word
        a = [1.0] + [0.0] * len(t)
        for e in range(1, len(t) + 1):
            for s in range(e):
                piece = vocabulary.get(t[s:e])
                a[e] += a[s] * (float(model.pieces[k][piece]) if piece is not None else 1e-7 if e == s + 1 else 0.0)
        return math.log(max(a[-1], 1e-300))

    known = {}
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(frame, model).collect()}
    for r in frame.limit(60).collect():
        words = re.findall(r"[^\W\d_]+", (r.text or "").lower())
        if not words:
            assert got[r.doc_id] == ("und", 0.0)
            continue
        x = []
        for k in range(len(model.langs)):
            total = sum(known.setdefault((w, k), sum(forward(w[i : i + 32], k) for i in range(0, len(w), 32))) for w in words)
            x.append(math.log(max(model.prior[k], 1e-9)) + total * min(len(words), 50) / len(words))
        best = max(range(len(x)), key=x.__getitem__)
        assert got[r.doc_id][0] == model.langs[best] and abs(got[r.doc_id][1] - 1 / sum(math.exp(v - x[best]) for v in x)) < 1e-6
