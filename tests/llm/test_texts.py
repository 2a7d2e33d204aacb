"""License scan, decontamination, token counts, packing and sharding against brute force."""

import re
import zlib
from collections import Counter
from fractions import Fraction
from math import ceil

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkarch.llm import common, feistel, licenses, packing, tokens, winnow

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "É GNU é"), (None, "mit license"), (904, "MIT License"), (904, "MIT License"), (905, "Kernel mit license İ ẞ")]


def words(t):
    return WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


# Licenses


def scan_brute(rows):
    found = licenses.templates()
    vocabulary = sorted({w for t in found for w in t["words"]})
    held = Counter(w for _, t in rows for w in set(words(t)) & set(vocabulary))
    rarity = licenses.weights(len(rows), held, vocabulary)
    out = []
    for i, t in rows:
        w, matches = words(t), []
        for n, x in enumerate(found):
            for p in range(len(w)):
                if w[p : p + len(x["key"])] == x["key"]:
                    start = p - x["key_at"]
                    got = sum(rarity[v] for j, v in enumerate(x["words"]) if 0 <= start + j < len(w) and w[start + j] == v)
                    score = got / sum(rarity[v] for v in x["words"])
                    if score >= licenses.LEAST_SCORE:
                        matches.append((n, x["label"], x["base"], start, round(score, 9)))
        out.append((i, len(w), sorted(matches)))
    return sorted(out, key=str)


def test_license_scan(spark, docs_of):
    gpl = licenses.NOTICES[0][0]
    rows = [(1, "The Apache  License, and MIT-license: mit license CC BY cc-by-4"), (2, gpl.upper()), (3, "x " + gpl.replace("redistribute", "change").replace("modify", "alter")), (4, gpl.split("under")[0]), (5, "mit licenses apache"), (6, licenses.NOTICES[3][0][:-60] + "!"), (7, "gnu gnu general public license public license " * 300), *ODD]
    rows += [(100 + i, "the software and license of any source") for i in range(20)]
    got = [(r["doc_id"], r["n_words"], sorted((m["template"], m["label"], m["base"], m["start"], round(m["score"], 9)) for m in r["matches"])) for r in licenses.scan(docs_of(rows)).collect()]
    assert sorted(got, key=str) == scan_brute(rows)
    assert licenses.scan(docs_of([])).count() == 0


def test_rarest_words_of_a_key_phrase():
    t = next(t for t in licenses.templates() if t["label"] == "mpl")
    rarity = {w: 1 for w in t["words"]} | {"mozilla": 9, "license": 3}
    assert licenses.rarest(t, rarity) == [("mozilla", t["key_at"]), ("license", t["key_at"] + 2), ("public", t["key_at"] + 1)]


def test_license_query(spark, small):
    rows = duckdb.execute(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall()
    want = {i: (n, [m for m in ms if m[2]]) for i, n, ms in scan_brute(rows)}
    for r in licenses.op2_rare_word_licenses(spark, small).collect():
        n, base = want[r["doc_id"]]
        assert (r["n_words"], r["n_base"]) == (n, len(base)) and 0 <= r["score"] <= 1
        assert (r["first_word"], r["last_word"]) == ((min(m[3] for m in base), max(m[3] for m in base)) if base else (None, None))
        assert r["base_labels"] == ",".join(sorted({m[1] for m in base}))


# Decontamination


def hits_brute(docs, items, span=10):
    out = []
    for i, t in docs:
        w, marked, ids = words(t), set(), set()
        for item, x in items:
            v = words(x)
            n = min(span, len(v))
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
            for p in range(len(w) - n + 1):
                if n and tuple(w[p : p + n]) in windows:
                    marked.update(range(p, p + n))
                    ids.add(str(item))
        out.append((i, len(w), len(marked), tuple(sorted(ids))))
    return sorted(out, key=str)


def corpus(seed):
    r = np.random.default_rng(seed)
    make = lambda n, k: " ".join(f"w{x}" for x in r.integers(0, k, n))
    items = [(i, make(int(r.integers(8, 60)), 5 if i % 3 else 400)) for i in range(12)] + [(50, "one"), (51, "a b c"), (52, None), (53, ""), (54, "Rep rep REP rep rep rep rep rep rep rep rep rep"), (None, "null item has these nine words in a row ok")]
    docs = []
    for i in range(60):
        parts = [make(int(r.integers(0, 50)), 6 if i % 4 == 0 else 500)]
        if i % 2:
            v = words(items[int(r.integers(0, 12))][1])
            a = int(r.integers(0, max(1, len(v) - 12)))
            parts.append(" - ".join(v[a : a + int(r.integers(5, 25))]))
        parts.append("one A, b! c" if i % 5 == 0 else "rep " * int(r.integers(0, 14)))
        docs.append((i, " . ".join(parts)))
    return [*docs, *ODD, (300, "x null item has these NINE words in a row OK"), (301, docs[1][1]), (301, docs[3][1])], items


@pytest.mark.parametrize("how", [{}, {"set_hashes": 0}, {"broadcast_rows": 0}])
@pytest.mark.parametrize("seed", [1, 2])
def test_contamination(spark, docs_of, monkeypatch, seed, how):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    docs, items = corpus(seed)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in winnow.contamination(docs_of(docs), bench, **how).collect()]
    want = [(i, n, h, tuple(x for x in ids if x != "None")) for i, n, h, ids in hits_brute(docs, items)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_shared_stretches(spark, docs_of):
    docs, items = corpus(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    held, theirs = {}, {i: words(t) for i, t in items}
    for i, t in docs:
        held.setdefault(i, []).append(words(t))
    hit = Counter()
    for r in winnow.shared_stretches(docs_of(docs), bench).collect():
        own = theirs[r["item_id"]][r["start"] - r["shift"] :][: r["length"]]
        assert len(own) == r["length"] and any(w[r["start"] :][: r["length"]] == own for w in held[r["doc_id"]])
        hit[r["doc_id"]] += 1
    assert {i for i, n in hit.items() if n} == {i for i, _, h, _ in hits_brute(docs, items) if h}


def test_contamination_of_nothing(spark, docs_of):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in winnow.contamination(docs_of(ODD), bench).collect()} == {0}
    assert winnow.contamination(docs_of([]), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        winnow.contamination(docs_of([]), bench, k=6)


def test_decontaminate_keeps_columns_and_clean_rows(spark, docs_of):
    docs, items = corpus(1)
    bench = spark.createDataFrame([x for x in items if x[0] not in (50, 51)], "item_id long, text string")
    kept = winnow.decontaminate(docs_of(docs), bench)
    clean = [i for i, _, h, _ in hits_brute(docs, [x for x in items if x[0] not in (50, 51)]) if not h]
    assert kept.columns == docs_of([]).columns and sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, clean))


# Tokens


@pytest.fixture(scope="module")
def spec():
    return open(tokens.tokenizer_file()).read()


TEXTS = st.lists(st.text(alphabet=st.one_of(st.sampled_from("abC .,!?*'’é_1½ßΣİ\n\t\x1c\x85-|<>"), st.characters(max_codepoint=0x3000, exclude_categories=["Cs"])), max_size=40), max_size=6)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_word_by_word_encoding_equals_the_tokenizer(texts):
    spec = open(tokens.tokenizer_file()).read()
    global _ENCODER
    _ENCODER = globals().get("_ENCODER") or (tokens.WordEncoder(spec, 300), tokens.load_tokenizer(spec))
    own, whole = _ENCODER
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert list(own.encode(texts)) == want


@pytest.mark.parametrize("text", ["<|endoftext|> a", "a<|startoftext|>.", "don't we'LL 'S", "ﬁ ﬂ. ŉ", "각 각", "e\u0301. E\u0301", "x" * 3000, "日本語 テキスト,", "\x1c\x1f a.", "***. ---", "a_b. _.", "½. a½,"])
def test_odd_words(spec, text):
    whole = tokens.load_tokenizer(spec)
    assert list(tokens.WordEncoder(spec).encode([text, "", text * 400])) == [np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in (text, "", text * 400)]


def lengths(rows, spec):
    t = tokens.load_tokenizer(spec)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for _, x in rows]


def test_length_histogram(spark, docs_of, spec):
    rows = [(i, "some words, here " * (i % 7)) for i in range(40)] + ODD
    want = Counter(lengths(rows, spec))
    total = sum(k * n for k, n in want.items())
    found = tokens.length_histogram(docs_of(rows), block=4)
    for r in found.collect():
        n = r["length"]
        assert r["n_docs"] == want[n] and r["docs_over"] == sum(k for m, k in want.items() if m > n) and r["tokens_over"] == sum(m * k for m, k in want.items() if m > n)
        assert r["tokens_at_limit"] == sum(min(m, n) * k for m, k in want.items()) and r["tokens_lost"] == total - r["tokens_at_limit"] and r["docs_at_most"] == len(rows) - r["docs_over"]
    assert {r["length"] for r in found.collect()} == set(want)
    for r in tokens.at_limit(found, [0, 5, 10**6]).collect():
        assert r["tokens_kept"] == sum(min(m, r["context_limit"]) * k for m, k in want.items())
    every = sorted(lengths(rows, spec))
    assert tokens.quantile(found, 0.5).first()["length"] == every[(len(every) + 1) // 2 - 1]
    for q in (0, "0.1", 0.25, 0.99, 1):
        assert tokens.quantile(found, q).first()["length"] == every[max(ceil(len(every) * Fraction(str(q))), 1) - 1]
    assert tokens.length_histogram(docs_of([])).count() == 0


def test_quantiles_of_very_many_documents(spark):
    n = 10**15
    found = spark.createDataFrame([(1, n // 2, n - n // 2), (2, n - 1, 1), (3, n, 0)], "length long, docs_at_most long, docs_over long")
    assert [tokens.quantile(found, q).first()["length"] for q in ("0.5", "0.500000000000001", "0.999999999999999", 1)] == [1, 2, 2, 3]


def test_other_tokenizers_are_refused(spec):
    import json

    other = json.loads(spec)
    other["model"]["end_of_word_suffix"] = ""
    with pytest.raises(ValueError):
        tokens.WordEncoder(json.dumps(other))


# Packing


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=120))
def test_place_never_overfills(sizes):
    lengths = np.array(sizes, dtype=np.int64)
    for pack in (packing.place, packing.pack_lengths):
        bins, offsets, n = pack(lengths, 64)
        for b in range(n):
            own = sorted((offsets[i], sizes[i]) for i in np.flatnonzero(bins == b))
            assert own and all(o == sum(s for _, s in own[:k]) for k, (o, _) in enumerate(own)) and sum(s for _, s in own) <= 64


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=40))
def test_sum_of_squares_rule(sizes):
    capacity, gaps = 12, []
    for s in sizes:
        best = None
        for g in [*sorted({g for g in gaps if s <= g < capacity}), capacity]:
            after = list(gaps)
            if g == capacity:
                after.append(capacity - s)
            else:
                after[after.index(g)] = g - s
            cost = sum(n * n for gap, n in Counter(after).items() if 0 < gap < capacity)
            if best is None or cost < best[0]:
                best = cost, g
        gaps = [*gaps, capacity - s] if best[1] == capacity else [*(x for i, x in enumerate(gaps) if i != gaps.index(best[1])), best[1] - s]
    bins, _, n = packing.place(np.array(sizes, dtype=np.int64), capacity)
    own = sorted(capacity - sum(s for s, b in zip(sizes, bins) if b == k) for k in range(n))
    assert own == sorted(gaps)


def test_pack(spark, docs_of, spec):
    r = np.random.default_rng(4)
    rows = [(i, " ".join(["word"] * int(r.integers(0, 90)))) for i in range(300)] + [(i, "a b c " * 700) for i in (400, 401)] + ODD
    got = packing.pack(docs_of(rows), capacity=64, group_pieces=50).toPandas()
    whole = tokens.load_tokenizer(spec)
    want = []
    for i, t in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], dtype="<u4").tobytes())) for k in range(0, len(ids), 64)]
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    plain = [tuple(None if x != x else int(x) for x in row) for row in got[cols].itertuples(index=False)]
    assert sorted(plain, key=str) == sorted(want, key=str)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= 64
    assert got["sequence_id"].nunique() <= 1.08 * -(-got["length"].sum() // 64) + 2
    assert packing.pack(docs_of([])).count() == 0


# Sharding


@given(st.integers(1, 5000), st.integers(0, 2**40))
@settings(max_examples=60, deadline=None)
def test_permutation(n, seed):
    every = np.arange(n)
    places = feistel.permute(every, n, seed)
    assert sorted(places.tolist()) == every.tolist() and (feistel.unpermute(places, n, seed) == every).all()


def test_shards(spark, docs_of):
    rows = [(i * 7 % 1000, f"t{i}") for i in range(500)] + ODD
    df = docs_of(rows).select("doc_id", "text")
    got = feistel.shard(df, ["doc_id", "text"], 8).toPandas()
    counts = got.groupby("shard").size()
    assert len(got) == len(rows) and counts.max() - counts.min() <= 1 and sorted(got["row_number"]) == list(range(len(rows)))
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    again = feistel.shard(df.repartition(7), ["doc_id", "text"], 8).toPandas()
    key = lambda d: sorted(map(str, d[["doc_id", "text", "shard", "slot"]].itertuples(index=False)))
    same = got[got["doc_id"] != 904], again[again["doc_id"] != 904]
    assert key(same[0]) == key(same[1])
    r = got.iloc[17]
    assert feistel.row_at(int(r["shard"]), int(r["slot"]), len(rows), 8, 20240229) == r["row_number"]
    assert feistel.shard(docs_of([]).select("doc_id"), ["doc_id"]).count() == 0


def test_shard_query(spark, small):
    rows = {r[0]: r[1] for r in duckdb.execute(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall()}
    for r in feistel.op5_feistel_shards(spark, small).collect():
        b = (rows[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(b) + 1, zlib.crc32(b), "rows", None) and 0 <= r["shard"] < 8
