"""Near copies of one text in crowds, and copies of several kinds, against brute force over all pairs of shingle sets."""

import random

from sievework.llm import simhash_groups


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def alike(a, b):
    return len(a & b) / len(a | b)


def edited(n, n_words, from_text, seed):
    """A text of 300 words and n copies, each with some words replaced and alike with it at 0.8 or more."""
    g = random.Random(seed)
    base = [f"w{g.randrange(4000)}" for _ in range(300)]
    out, first = [" ".join(base)], shingles(" ".join(base))
    while len(out) <= n:
        words = list(base)
        for _ in range(n_words):
            words[g.randrange(300)] = g.choice(base) if from_text else f"w{g.randrange(4000)}"
        if alike(first, shingles(" ".join(words))) >= 0.8:
            out.append(" ".join(words))
    g.shuffle(out)
    return out


def brute_kept(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for k in range(i):
            if (a := root(i)) != (b := root(k)) and alike(sets[i], sets[k]) >= 0.8:
                parent[max(a, b)] = min(a, b)
    return {i for i in range(len(texts)) if root(i) == i}


def kept(spark, texts, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return {r.doc_id for r in simhash_groups.keep_one(docs, **how).collect()}


def test_crowded_bucket_of_edited_copies(spark):
    texts = edited(1300, 5, True, 1) + edited(3, 5, True, 2)
    assert kept(spark, texts) == brute_kept(texts)


def test_many_candidates_that_fail(spark):
    for from_text in (True, False):
        texts = edited(300, 5, from_text, 3)
        assert kept(spark, texts) == brute_kept(texts) == {0}


def test_parts_of_crowds_without_a_middle(spark):
    g = random.Random(4)
    chain = [[f"c{g.randrange(9999)}" for _ in range(200)]]  # each text is alike with its neighbours only
    for _ in range(120):
        chain.append(chain[-1][5:] + [f"c{g.randrange(9999)}" for _ in range(5)])
    texts = [" ".join(x) for x in chain]
    g.shuffle(texts)
    for crowd in (1024, 8):
        assert kept(spark, texts, crowd=crowd) == brute_kept(texts) == {0}


def by_kind(seed, pairs=150):
    """kind: pairs of texts alike at 0.8 to 0.85, the second being the first with words added, cut off or replaced."""
    g = random.Random(seed)
    out = {"appended": [], "cut off": [], "replaced": []}
    while min(map(len, out.values())) < pairs:
        for kind, found in out.items():
            a = [f"k{g.randrange(9**9)}" for _ in range(g.randrange(100, 400))]
            n = len(a)
            b = a + [f"k{g.randrange(9**9)}" for _ in range(g.randrange(n // 4))] if kind == "appended" else a[: n - g.randrange(n // 4)]
            if kind == "replaced":
                b = list(a)
                for _ in range(g.randrange(1, 2 + n // 30)):
                    b[g.randrange(n)] = f"k{g.randrange(9**9)}"
            if 0.8 <= alike(shingles(" ".join(a)), shingles(" ".join(b))) < 0.85:
                found.append((" ".join(a), " ".join(b)))
    return out


def test_copies_of_every_kind(spark):
    for kind, found in by_kind(5).items():
        assert len(kept(spark, [t for pair in found for t in pair])) == len(found), kind


def test_one_vocabulary_in_many_orders(spark):
    """Texts of the same words in other orders are not alike; each has one near copy, two neighbouring words being swapped."""
    g = random.Random(6)
    words = [f"v{k}" for k in range(100)]
    for n in (3, 60):
        texts = []
        for _ in range(n):
            a = g.sample(words, 100)
            k = g.randrange(1, 4)
            b = list(a)
            b[k], b[k + 1] = b[k + 1], b[k]
            texts += [" ".join(a), " ".join(b)]
        assert len(kept(spark, texts)) == len(brute_kept(texts)) == n


def test_groups_of_real_documents_equal_all_pairs(spark):
    """Whole result against every pair of texts that share a shingle: recall 1, of each group the smallest id stays."""
    from collections import Counter, defaultdict

    from sievework.llm import simhash_groups as G

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets = {i: set(zip(*(w[k:] for k in range(5)))) if len(w := (t or "").lower().encode().split()) >= 5 else {tuple(w)} if w else set() for i, t in rows}
    index = defaultdict(list)
    for i, s in sets.items():
        for x in s or {None}:
            index[x].append(i)
    shared = Counter((a, b) for ids in index.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = 0
    for (a, b), n in shared.items():
        if not sets[a] and not sets[b] or n >= G.LEAST * (len(sets[a]) + len(sets[b]) - n):
            pairs += 1
            parent[max(root(a), root(b))] = min(root(a), root(b))
    kept = {r.doc_id for r in G.keep_one(docs).select("doc_id").collect()}
    assert pairs > 20 and kept == {i for i in sets if root(i) == i}
