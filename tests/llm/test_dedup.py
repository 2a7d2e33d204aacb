"""Exact and near duplicates against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkarch.llm import bottomk, common, fingerprints

ODD = [(900, None), (901, ""), (902, " \n"), (None, "only null id"), (None, "two"), (903, "two"), (904, "same row"), (904, "same row"), (905, "one id"), (905, "two texts")]


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=400), st.lists(st.integers(0, 400), max_size=4))
def test_fingerprints_combine(data, cuts):
    parts, at = [], 0
    for c in [*sorted(c for c in cuts if c <= len(data)), len(data)]:
        parts.append(data[at:c])
        at = c
    out = (0, 0)
    for p in parts:
        out = fingerprints.combine(out, fingerprints.chunk_hash(p), len(p))
    assert out == fingerprints.fingerprint(data)
    want = tuple(sum(b * pow(r, len(data) - 1 - i, p) for i, b in enumerate(data)) % p for p, r in zip(fingerprints.PRIMES, fingerprints.POINTS))
    assert out == want


def exact_brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        out.append((i, max((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("how", [{}, {"primes": (7, 5)}, {"spread_bytes": 60, "spread_part": 25}])
def test_exact_groups(spark, docs_of, how):
    r = random.Random(1)
    texts = ["".join(r.choice("abc é") for _ in range(r.randrange(0, 9))) for _ in range(60)] + ["long " * 50, "long " * 49 + "lone "] * 3 + ["x" * 200_000, "x" * 199_999 + "y"] * 2
    rows = list(enumerate(texts)) + ODD
    got = fingerprints.exact_groups(docs_of(rows), **how).toPandas()
    n = lambda x: None if x != x or x is None else int(x)
    assert sorted(((n(r.doc_id), n(r.keep_id), r.group_size, r.text_sha256) for r in got.itertuples()), key=str) == exact_brute(rows)
    assert (got[got["kept"]].groupby("text_sha256").size() == 1).all() and got[got["kept"]]["text_sha256"].nunique() == got["text_sha256"].nunique()
    assert all(n(r.doc_id) == n(r.keep_id) for r in got[got["kept"]].itertuples())


def test_exact_dedup_keeps_rows_whole(spark, docs_of):
    rows = [(i, t) for i, t in enumerate("abcabcd")] + ODD
    kept = fingerprints.exact_dedup(docs_of(rows))
    assert kept.columns == docs_of([]).columns
    assert sorted((r["text"] or "") for r in kept.collect()) == sorted({t or "" for _, t in rows})
    assert {r["doc_id"] for r in kept.collect() if r["text"] in ("a", "b", "c", "d", "two")} == {3, 4, 5, 6, 903}
    assert fingerprints.exact_dedup(docs_of([])).count() == 0


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def near_brute(rows, size, percent=80):
    sets = [shingles(t, size) for _, t in rows]
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                part[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def near_corpus(seed):
    r = random.Random(seed)
    word = lambda k: f"w{int(r.paretovariate(0.7)) % k}"
    rows, bases = [], [[word(900) for _ in range(n)] for n in (6, 12, 40, 90, 200, 500)]
    passage = [word(5000) for _ in range(60)]
    for b in bases:
        for rate in (0, 0, 0.01, 0.03, 0.05, 0.08, 0.1, 0.15):
            rows.append(" ".join(x if r.random() >= rate else word(900) for x in b))
    for _ in range(60):  # a passage that many share, most of the text for some
        rows.append(" ".join(passage + [word(3000) for _ in range(r.choice((5, 10, 15, 60)))]))
    hot = [word(2000) for _ in range(150)]
    for _ in range(80):  # a large group whose members hover about the limit
        rows.append(" ".join(x if r.random() >= 0.055 else word(9000) for x in hot))
    rows += [" ".join(word(60) for _ in range(r.randrange(1, 9))) for _ in range(80)]
    r.shuffle(rows)
    return list(enumerate(rows)) + ODD + [(1000, "A b"), (1001, "a  B"), (1002, "a"), (1003, "A"), (1004, "a b"), (1005, "word " * 3000)]


@pytest.mark.parametrize(("seed", "size"), [(1, 2), (2, 2), (3, 5)])
def test_near_groups(spark, docs_of, seed, size):
    rows = near_corpus(seed)
    got = bottomk.near_groups(docs_of(rows), size=size).toPandas()
    n = lambda x: None if x != x or x is None else int(x)
    assert sorted(((n(r.doc_id), r.n_shingles, n(r.component_id)) for r in got.itertuples()), key=str) == near_brute(rows, size)
    assert all(r.kept == (n(r.doc_id) == n(r.component_id)) for r in got.itertuples())


def fourth_best_family(seed):
    """A text, copies with another first word, and one without its last four words, which meets the text in one list only.

    The five shingles that the text is listed under, those of the smallest hashes, are its first and its last four.
    """
    r = random.Random(seed)
    fresh = lambda: f"f{seed}x{r.randrange(10**9)}"
    h = lambda a, b: int(bottomk.shingle_set(f"{a} {b}", 2)[0])
    words = [fresh()]
    for i in range(20):
        few = [fresh() for _ in range(60)]
        words.append((min if i == 0 or i >= 16 else max)(few, key=lambda w: h(words[-1], w)))
    return [" ".join(x) for x in (words, *[[fresh(), *words[1:]] for _ in range(6)], words[:-4])]


def test_near_groups_of_pairs_that_rank_fourth(spark, docs_of):
    rows = list(enumerate(t for seed in range(12) for t in fourth_best_family(seed)))
    got = bottomk.near_groups(docs_of(rows), size=2).toPandas()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.itertuples()), key=str) == near_brute(rows, 2)
    assert got["component_id"].nunique() == 12


def listed_alone(rank, n=15):
    """A text of n words and parts of it of similarity 0.8 or more; one part lacks the three words of least hash, three the word of that rank and another."""
    r = random.Random(rank * 1000 + n)
    words = [f"x{rank}y{r.randrange(10**9)}" for _ in range(n)]
    by_hash = sorted(words, key=lambda w: int(bottomk.shingle_set(w, 1)[0]))
    less = lambda gone: " ".join(w for w in words if w not in gone)
    return [" ".join(words), *[less({by_hash[3], by_hash[4 + k]}) for k in range(3)], less(set(by_hash[:3]))]


def test_near_groups_of_words_listed_alone(spark, docs_of):
    rows = list(enumerate(t for rank in range(200) for t in listed_alone(rank)))
    got = bottomk.near_groups(docs_of(rows), size=1).toPandas()
    want = {i: c for i, _, c in near_brute(rows[:5], 1)}
    assert set(want.values()) == {0}
    assert (got["component_id"] == got["doc_id"] // 5 * 5).all()


def crowd(seed):
    """Many copies of one text, many near copies of another, and texts that share most of their words with none of those."""
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(80)]
    rows = ["same text over and over"] * 60 + [" ".join(x if r.random() >= 0.02 else f"v{r.randrange(9999)}" for x in base) for _ in range(60)]
    rows += [" ".join(base[:50] + [f"u{r.randrange(9999)}" for _ in range(r.randrange(10, 60))]) for _ in range(60)]
    return list(enumerate(rows)) + ODD


@pytest.mark.parametrize("block", [3, 4096])
def test_groups_where_nothing_is_broadcast_and_every_key_is_hot(spark, docs_of, monkeypatch, block):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(bottomk.with_alike, "__defaults__", (block,))
    rows = crowd(1)
    n = lambda x: None if x != x or x is None else int(x)
    got = bottomk.near_groups(docs_of(rows), size=2, short_list=4).toPandas()
    assert sorted(((n(r.doc_id), r.n_shingles, n(r.component_id)) for r in got.itertuples()), key=str) == near_brute(rows, 2)
    got = fingerprints.exact_groups(docs_of(rows), primes=(7, 5)).toPandas()
    assert sorted(((n(r.doc_id), n(r.keep_id), r.group_size, r.text_sha256) for r in got.itertuples()), key=str) == exact_brute(rows)
    kept = fingerprints.exact_dedup(docs_of(rows))
    assert sorted((r["text"] or "") for r in kept.collect()) == sorted({t or "" for _, t in rows})


def test_near_dedup_and_no_rows(spark, docs_of):
    rows = [(1, "a b c d e f g"), (2, "A b c d e f g"), (3, "z"), (4, None)]
    kept = bottomk.near_dedup(docs_of(rows))
    assert kept.columns == docs_of([]).columns and {r["doc_id"] for r in kept.collect()} == {1, 3, 4}
    assert bottomk.near_groups(docs_of([])).count() == 0


@pytest.mark.parametrize("in_task", [0, 1000])
def test_components_of_chains_and_stars(spark, in_task):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(300, 299), (299, 300)]
    got = {r["cid"]: r["label"] for r in bottomk.components(spark.createDataFrame(pairs, "a long, b long"), in_task).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}, 299: 299, 300: 299}


def test_sketch_estimates():
    r = np.random.default_rng(1)
    for _ in range(30):
        base = r.integers(0, 2**62, 400)
        a, b = np.unique(base[:360]), np.unique(base[40:])  # similarity 0.8
        x, y = (np.array(bottomk.signature(s)).view(np.uint64) for s in (a, b))
        assert sum(int(p ^ q).bit_count() for p, q in zip(x.tolist(), y.tolist())) <= 54
        assert len(np.intersect1d(a[:64], b[:64])) >= bottomk.overlap_bound(360, 64, 80)
    assert Counter(bottomk.overlap_bound(np.arange(1, 6), 64, 80).tolist()) == Counter([1, 2, 3, 4, 4])
