"""The quality classifier, the URL filter, the pipeline, and all queries."""

import random
import re
import zlib
from collections import Counter
from math import log

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from sparkarch.llm import bottomk, common, fingerprints, packing, quality, queries, urls, winnow

# Quality


def test_isotonic_is_the_least_squares_monotone_fit():
    r = np.random.default_rng(2)
    x, y = r.integers(0, 12, 60).astype(float), r.integers(0, 2, 60).astype(float)
    kx, ky = quality.isotonic(x, y)
    assert (np.diff(ky) > 0).all() and (np.diff(kx) > 0).all()
    xs = np.unique(x)
    means, n = np.array([y[x == v].mean() for v in xs]), np.array([(x == v).sum() for v in xs])
    minmax = [max(min((means[a : b + 1] * n[a : b + 1]).sum() / n[a : b + 1].sum() for b in range(i, len(xs))) for a in range(i + 1)) for i in range(len(xs))]
    assert set(np.round(ky, 9)) == set(np.round(minmax, 9))


def test_stats_of_odd_texts():
    for t in (None, "", " ", "x", "\n\n", "é" * 100_000, "*** " * 50):
        s = quality.stats(t)
        assert len(s) == quality.N_STATS and np.isfinite(s).all()
    assert quality.stats(None) == quality.stats("")


def corpus(spark, docs_of, n=400):
    r = random.Random(4)
    good = lambda: " ".join(r.choice(["the", "house", "stands", "by", "a", "river", "and", "waits"]) for _ in range(40)).capitalize() + "."
    bad = lambda: " ".join(r.choice(["buy***", "now$$$", "###", "|", "x%%%"]) for _ in range(40))
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0, "x") for i in range(n)] + [(None, 1, 0, "x"), (5, None, 0, "x"), (6, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    return rows, docs_of(rows + [(900, None), (901, ""), (None, good()), (902, "é " * 50_000), (3, rows[3][1])]), labels


def test_classifier_on_held_out_rows(spark, docs_of):
    rows, docs, labels = corpus(spark, docs_of)
    model = quality.fit(docs, labels)
    got = quality.score(docs.drop("score"), model).toPandas()
    assert got["score"].between(0, 1).all() and len(got) == len(rows) + 5 and ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()
    held = got[got["doc_id"].map(lambda i: i == i and i < 400 and zlib.crc32(str(int(i)).encode()) % 4 == 2)]
    assert ((held["predicted"] == 1) == (held["doc_id"] % 4 != 0)).mean() > 0.97 and len(held) > 60


def test_held_out_labels_do_not_matter(spark, docs_of):
    _, docs, labels = corpus(spark, docs_of, 200)
    flipped = labels.withColumn("quality", (quality.remainder(labels["doc_id"]) == 2).cast("int") * (1 - labels["quality"]) + (quality.remainder(labels["doc_id"]) != 2).cast("int") * labels["quality"])
    a, b = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert np.allclose(a.ridge, b.ridge) and np.allclose(a.knots_y, b.knots_y)


def test_classifier_without_labels_or_with_one_kind(spark, docs_of):
    _, docs, labels = corpus(spark, docs_of, 40)
    assert set(quality.score(docs, quality.fit(docs, labels.limit(0))).toPandas()["score_"]) == {0.5}
    ones = quality.score(docs, quality.fit(docs, labels.filter("quality = 1"))).toPandas()["score_"]
    assert (ones > 0.99).all()
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


def test_normal_equations_and_features_against_a_dense_solve(spark, docs_of):
    """The weights are those of ridge regression on the Fourier features, worked out here from all rows at once."""
    rows, docs, labels = corpus(spark, docs_of, 200)
    model = quality.fit(docs, labels, waves=32)
    text = {i: min((t for k, t in rows + [(3, rows[3][1])] if k == i), key=quality.stats) for i, _ in rows}
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] is not None and r["quality"] is not None}
    ids = [i for i in sorted(known) if i in text and zlib.crc32(str(i).encode()) % 4 != 2]
    part = {r["doc_id"]: r["c"] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").selectExpr("doc_id", "pmod(xxhash64(doc_id, 1), 4) = 0 as c").collect()}
    x = np.array([quality.stats(text[i]) for i in ids])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.where(x.std(axis=0) < 1e-9, 1.0, x.std(axis=0)))
    z = np.clip((x - model.mean) / model.scale, -6, 6)
    phi = np.hstack([np.sqrt(2 / 32) * np.cos(z @ model.weights + model.phases), np.ones((len(x), 1))])
    fit = np.array([not part[i] for i in ids])
    a, y = phi[fit].T @ phi[fit], np.array([known[i] for i in ids], dtype=float)
    want = np.linalg.solve(a + 1e-3 * np.trace(a) / 33 * np.eye(33), phi[fit].T @ y[fit])
    assert np.allclose(model.ridge, want) and np.allclose(model.raw(x), phi @ want)
    kx, ky = quality.isotonic(phi[~fit] @ want, y[~fit])
    assert np.allclose(model.knots_y, ky) and np.allclose(model.knots_x, kx)


def test_features_approximate_the_gaussian_kernel():
    r = np.random.default_rng(5)
    n, width = 20_000, 1.5
    w = r.normal(size=(quality.N_STATS, n)) / (width * np.sqrt(quality.N_STATS))
    model = quality.Model(np.zeros(quality.N_STATS), np.ones(quality.N_STATS), w, r.uniform(0, 2 * np.pi, n), np.zeros(0), np.zeros(1), np.zeros(1))
    x = r.normal(size=(6, quality.N_STATS))
    f = model.features(x)[:, :-1]
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(f @ f.T - np.exp(-d / (2 * width**2 * quality.N_STATS))).max() < 0.04


def test_classifier_on_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    got = quality.op8_fourier_quality(spark, folder).toPandas()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    both = got.merge(pd.read_parquet(f"{folder}/labels.parquet"), on="doc_id")
    held = both[both["held_out"]]
    assert ((held["predicted"] == held["quality"]).mean()) > 0.95


# URLs


def cost_of(parts, known, total):
    return sum(log(known[p] / total) if p in known else log(10 / total) - len(p) * log(10) for p in parts)


def segment_brute(run, known, total):
    best = None
    for cut in range(1 << (len(run) - 1)):
        parts, at = [], 0
        for i in range(1, len(run) + 1):
            if i == len(run) or cut >> (i - 1) & 1:
                parts.append(run[at:i])
                at = i
        best = max(cost_of(parts, known, total), best if best is not None else float("-inf"))
    return best


def test_segmentation_is_the_most_probable():
    known = {"news": 50, "paper": 30, "new": 20, "spa": 3, "per": 9, "a": 100, "s": 5, "internationalisations": 2, "q": 1}
    total = sum(known.values())
    assert urls.split_run("newspaper", known, total) == ["news", "paper"]
    assert urls.split_run("xxxinternationalisationsyyy", known, total) == ["xxx", "internationalisations", "yyy"]  # no limit of letters
    r = random.Random(1)
    for run in ["newspaper", "anews", "spaper", "zzz", "a", "papernewsa", "xnewsx", *("".join(r.choice(["news", "a", "z", "per", "q"]) for _ in range(4))[:11] for _ in range(40))]:
        got = urls.split_run(run, known, total)
        assert "".join(got) == run
        assert abs(cost_of(got, known, total) - segment_brute(run, known, total)) < 1e-9
    assert urls.split_run("q" * 3000, {}, 0) == ["q" * 3000]


URLS = ["http://a.net", "http://a.net/", "http://x.a.NET/p", "http://anet/", "http://example.net/en/x", "http://w.example.net/en/", "http://example.net/enx", "http://example.com/de/1", "http://badexample.com/de/1", "http://q.org/fr/z?x=/en/", "ftp://q.org/fr", "http://h?x", "http://h#y", "no url", None, "", "http://", "://HÉ/É", "http://a.net/x\ny"]


def rule_brute(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
    fit = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def page_rows():
    extra = ["http://newspaperinternationalisations-zzz1.org/fr/a", "http://newspaper.net/x", "http://newspaper.com/fr/a", "http://a/" + "É" * 30 + "/b_c", "http://" + "spam" * 60 + ".com/de/x", "http://..--/"]
    return [(i, u, f"<p class='zzz'>The news paper {i} internationalisations</p>" if i % 3 else None, "x") for i, u in enumerate((URLS + extra) * 3)]


def judge_brute(rows):
    counts = Counter(w for _, _, h, _ in rows for w in re.findall("[a-z]+", re.sub("<[^>]*>", " ", (h or "").lower())))
    total = sum(counts.values())
    lower = lambda t: t.translate({c: c + 32 for c in range(65, 91)})

    def words(host):
        out = []
        for run in re.findall(r"[a-z]+|[0-9]+|[^a-z0-9.\-_]+", host):
            known = {w: n for w, n in counts.items() if w in run}
            out += urls.split_run(run, known, total) if re.match("[a-z]", run) else [run]
        return out

    def tokens(host, path):
        return ["h " + w for w in words(host)] + ["p " + t for t in re.findall(r"[a-z0-9]+|[^\x00-\x7f]+", lower(path))]

    seen, n = {"allow": Counter(), "block": Counter()}, Counter()
    judged = [(i, *rule_brute(u)) for i, u, _, _ in rows]
    for _, host, path, _, v in judged:
        if v:
            n[v] += 1
            seen[v].update(tokens(host, path))
    every = set(seen["allow"]) | set(seen["block"])
    share = lambda v, t: log((seen[v][t] + urls.ALPHA) / (seen[v].total() + urls.ALPHA * len(every)))
    prior = log((n["block"] + 1) / (n["allow"] + 1))
    out = {}
    for i, host, path, rule, v in judged:
        odds = prior + sum(share("block", t) - share("allow", t) for t in tokens(host, path) if t in every)
        out[i] = (host, path, rule, v or ("block" if odds > 0 else "allow"), 1 / (1 + np.exp(-odds)), words(host))
    return out


@pytest.mark.parametrize("limits", [{}, {"BROADCAST_ROWS": 0, "HOT_ROWS": 2}])
def test_judge(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(common, k, v)
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, score string")
    got, want = urls.judge(pages).collect(), judge_brute(rows)
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict, score, words = want[r["page_id"]]
        assert (r["host"], r["path"], r["rule"], r["verdict"], r["host_words"]) == (host, path, rule, verdict, words) and abs(r["score"] - score) < 1e-9
    assert urls.judge(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in urls.judge(pages.filter("url is null")).collect()} == {"allow"}


def test_judge_on_the_tables(spark, small):
    rows = [(i, u, h, None) for i, u, h in duckdb.execute(f"SELECT page_id, url, html FROM '{small}/pages.parquet'").fetchall()]
    want = judge_brute(rows)
    for r in urls.op3_host_words_bayes(spark, small).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"], r["host_words"]) == (*want[r["page_id"]][:4], want[r["page_id"]][5])


# Pipeline and queries


def test_pipeline_stage_by_stage(spark, tmp_path):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path}/{name}"
        stage(spark, docs, folder).write.parquet(path)
        after = spark.read.parquet(path)
        seen.append((name, docs, after))
        docs = after
    assert [n for n, _, _ in seen] == ["quality_classifier", "exact_dedup", "near_dedup", "decontaminate", "pack"]
    frames = [(a.toPandas(), b.toPandas()) for _, a, b in seen]
    for before, after in frames[:4]:
        assert list(after.columns) == ["doc_id", "text", "lang", "source", "n_chars"]
        assert set(after["doc_id"]) < set(before["doc_id"]) and after["doc_id"].is_unique
    labels = pd.read_parquet(f"{folder}/labels.parquet").set_index("doc_id")["quality"]
    kept = labels[labels.index.isin(frames[0][1]["doc_id"])]
    assert kept.mean() > 0.97 and kept.sum() > 0.97 * labels.sum()
    before, after = frames[1]
    assert set(after["doc_id"]) == set(before.groupby("text")["doc_id"].max())
    before, after = frames[2]
    from .test_dedup import near_brute

    assert set(after["doc_id"]) == {i for i, _, c in near_brute(list(zip(before["doc_id"].tolist(), before["text"])), 5) if i == c}
    before, after = frames[3]
    from .test_texts import hits_brute

    items = pd.read_parquet(f"{folder}/benchmark.parquet")
    assert set(after["doc_id"]) == {i for i, _, h, _ in hits_brute(list(zip(before["doc_id"].tolist(), before["text"])), list(zip(items["item_id"].tolist(), items["text"]))) if not h}
    before, after = frames[4]
    assert set(after["doc_id"]) == set(before["doc_id"]) and (after.groupby("sequence_id")["length"].sum() <= 2048).all()


def test_pipeline_runs_as_a_query(spark, small):
    assert {"doc_id", "sequence_id", "offset"} <= set(corpus_pipeline.run(spark, small).columns)


def test_names_and_numbers():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11)) and set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, small).toPandas(), con.execute(queries.SQL[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    value = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    rows = lambda d: sorted((tuple(value(v) for v in r) for r in d[cols].astype(object).itertuples(index=False)), key=str)
    assert rows(got) == rows(want)


def test_native_operators_plan_no_python(spark, small):
    for name in ("op2_rare_word_licenses", "op4_winnowing_contamination"):
        plan = queries.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name


def test_used_modules():
    assert all(m.__doc__ for m in (bottomk, fingerprints, packing, quality, urls, winnow))
