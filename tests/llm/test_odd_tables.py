"""Every operator and every stage on odd tables: ids of text, columns with clashing names, nulls, repeated rows, very long texts, no rows."""

import hashlib
import zlib

import pytest

import corpus_pipeline
from sparkarch.llm import bottomk, common, feistel, fingerprints, licenses, packing, quality, tokens, winnow

NAMES = ["score", "predicted", "n_words", "matches", "__id", "__sha", "__digest", "__d1", "__d2", "__w", "__t", "__row", "__part", "__parts", "shard", "slot", "row_number", "place", "at", "part", "start", "id", "sha", "digest"]
NAMES += ["d1", "d2", "w", "held", "known", "starts", "keyed", "kept", "keep_id", "cid", "value", "label", "n", "copies", "tag", "row", "group", "length", "piece", "offset", "sequence_id", "hash", "kind", "any", "rows", "hits", "x", "y", "calibrate"]
GOOD = "A house stands by the river and waits. The door is open, and the light is on."
ROWS = [("a", GOOD), ("b", GOOD), ("c", "mit license " + GOOD), ("c", "mit license " + GOOD), (None, "gnu general public license"), ("d", None), (None, None), ("e", ""), ("f", " \n"), ("g", "x " * 4_000_000), ("h", "*** $$$ *** ###" * 20), ("h", "other text of h"), (None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents whose ids are texts, with a column of each name that the operators use themselves."""
    kinds = ", ".join(f"`{c}` string" for c in NAMES)
    return spark.createDataFrame([(i, t, *[f"{c}{k}" for c in NAMES]) for k, (i, t) in enumerate(ROWS)], f"doc_id string, text string, {kinds}").cache()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([("a", 1, 0), ("h", 0, 0), ("b", 1, 1), ("q", 0, 0), (None, 1, 0), ("c", None, 0)], "doc_id string, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([("i", "gnu general public license"), (None, None), ("j", "")], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return f"file://{path}"


def own(row):
    return tuple(row[c] for c in ("doc_id", "text", *NAMES))


def all_own(df):
    return sorted(map(own, df.collect()), key=str)


def test_operators_keep_every_column(spark, odd, folder):
    every = all_own(odd)
    model = quality.fit(odd, spark.read.parquet(f"{folder}/labels.parquet"))
    scored = quality.score(odd, model)
    assert all_own(scored) == every and scored.columns == [*odd.columns, "score_", "predicted_"] and all(0 <= r["score_"] <= 1 for r in scored.collect())
    found = licenses.scan(odd)
    assert all_own(found) == every and found.columns[-2:] == ["n_words_", "matches_"] and sum(len(r["matches_"]) for r in found.collect()) == 3
    dealt = feistel.shard(odd, ["doc_id", "text"], 3)
    assert all_own(dealt) == every and sorted(r["row_number_"] for r in dealt.collect()) == list(range(len(ROWS)))
    assert sorted((r["shard_"], r["slot_"]) for r in dealt.collect()) == sorted((i % 3, i // 3) for i in range(len(ROWS)))


@pytest.mark.parametrize("rows", [0, 400_000])
def test_filters_keep_every_column(spark, odd, folder, monkeypatch, rows):
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    every = set(all_own(odd))
    once = fingerprints.exact_dedup(odd)
    assert once.columns == odd.columns and set(all_own(once)) < every and sorted((r["text"] or "") for r in once.collect()) == sorted({t or "" for _, t in ROWS})
    assert {r["doc_id"] for r in once.collect() if r["text"] == GOOD} == {"b"}
    apart = bottomk.near_dedup(odd)
    assert apart.columns == odd.columns and set(all_own(apart)) < every
    assert sorted(str(r["doc_id"]) for r in apart.collect()) == sorted(["a", "None", "d", "None", "e", "f", "g", "h", "h", "None"])  # c is near a
    clean = winnow.decontaminate(odd, bench)
    assert clean.columns == odd.columns and all_own(clean) == sorted((x for x in every if x[1] != "gnu general public license"), key=str)
    model = quality.fit(odd, spark.read.parquet(f"{folder}/labels.parquet"))
    assert set(all_own(quality.accepted(odd, model))) <= every


def test_packing_of_any_id(spark, odd):
    got = packing.pack(odd, capacity=64).toPandas()
    whole = tokens.load_tokenizer(open(tokens.tokenizer_file()).read())
    for i, t in ROWS:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0] if len(t or "") < 1000 else None
        part = got[got["doc_id"].isna() if i is None else got["doc_id"] == i]
        if ids is not None:
            assert len(part[part["length"] == len(ids[:64])]) > 0
    assert got["doc_id"].isna().sum() == 3 and (got[got["doc_id"] == "g"]["length"].sum() > 4_000_000)
    assert tokens.length_histogram(odd).toPandas()["n_docs"].sum() == len(ROWS)


def test_digests_of_odd_rows(odd):
    want = sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS)
    assert sorted((str(r["doc_id"]), r["text_sha256"]) for r in fingerprints.exact_groups(odd).collect()) == want
    assert len({zlib.crc32(t.encode()) for _, t in ROWS if t}) == len({t for _, t in ROWS if t})


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, odd, folder, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    for docs in (odd, odd.limit(0)):
        out = stage(spark, docs, folder)
        rows = out.collect()
        if name == "pack":
            assert {str(r["doc_id"]) for r in rows} == {str(r["doc_id"]) for r in docs.collect()}
        else:
            assert out.columns == odd.columns and {own(r) for r in rows} <= set(all_own(docs))
