"""The pipeline: each stage works on all that the one before kept, and on odd rows."""

import collections
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_dedup_operators import brute_masks, check_pieces, encoded

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Name -> (input, output) of each stage over the whole table."""
    root, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(root / name))
        out[name] = (docs, spark.read.parquet(str(root / name)))
        docs = out[name][1]
    return out


def test_columns(stages):
    for name, (_, after) in list(stages.items())[:-1]:
        assert after.columns == corpus_pipeline.COLUMNS, name


def test_quality_keeps_good_and_drops_bad(spark, stages):
    before, after = stages["quality"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r["doc_id"] for r in after.select("doc_id").collect()}
    marked = {r["doc_id"]: r["quality"] for r in labels.join(before.select("doc_id"), "doc_id").collect()}
    good = [d in kept for d, q in marked.items() if q == 1]
    bad = [d in kept for d, q in marked.items() if q == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.3
    assert after.exceptAll(before).count() == 0


def test_near_duplicates_leave_one_of_each_text(stages):
    before, after = stages["near_duplicates"]
    assert after.exceptAll(before).count() == 0
    texts = [r["text"] for r in after.collect()]
    assert len(texts) == len(set(texts)) and set(texts) <= {r["text"] for r in before.collect()}
    shingles = {}
    for r in after.collect():
        w = r["text"].lower().split()
        shingles[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    gone = [r for r in before.collect() if r["doc_id"] not in shingles]
    for r in gone:
        w = r["text"].lower().split()
        own = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
        assert max(len(own & s) / len(own | s) for s in shingles.values()) >= 0.8


def test_passages_go(stages):
    before, after = stages["repeated_passages"]
    rows = {r["doc_id"]: r["text"] for r in before.collect()}
    cut = {r["doc_id"]: (r["text"], r["n_chars"]) for r in after.collect()}
    assert set(rows) == set(cut)
    masks = brute_masks([t.encode() for t in rows.values()], 160)
    changed = 0
    for (d, t), mask in zip(rows.items(), masks, strict=True):
        raw, kept = t.encode(), bytearray()
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(int), [0]])))
        at = 0
        for s, e in edges.reshape(-1, 2).tolist():
            whole = [m for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw) if s <= m.start() and m.end() <= e]
            if len(whole) >= 50:
                kept += raw[at:s]
                at = e
        text, chars = cut[d]
        assert chars == len(text) and text == (kept + raw[at:]).decode("utf-8", "ignore")
        changed += text != t
    assert changed


def test_mix_repeats_whole_documents(stages):
    before, after = stages["source_mix"]
    assert after.join(before, corpus_pipeline.COLUMNS, "left_anti").count() == 0
    assert 0.7 < after.count() / before.count() < 1.3


def test_packing_packs_every_copy(stages):
    before, after = stages["packing"]
    rows = before.collect()
    ids = {}
    for r, x in zip(rows, encoded([r["text"] for r in rows]), strict=True):
        ids[r["doc_id"]] = x
    pieces = after.collect()
    assert check_pieces(pieces, ids) == sum(len(ids[r["doc_id"]]) for r in rows)
    assert all(zlib.crc32(bytes(p["ids"])) == p["ids_crc32"] for p in pieces)
    copies = collections.Counter(r["doc_id"] for r in rows)
    tokens = collections.Counter()
    for p in pieces:
        tokens[p["doc_id"]] += p["length"]
    assert tokens == {d: n * len(ids[d]) for d, n in copies.items()}


def test_run_equals_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first()[0] > 0
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, odd, empty, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd, SF)
    assert out.count() > 0
    assert stage(spark, empty, SF).count() == 0


def test_passage_of_just_over_fifty_words_goes(spark):
    words = [f"w{i % 10}" for i in range(3000)]
    r = np.random.default_rng(1)
    passage = " ".join(r.permutation([f"p{i}" for i in range(52)]))  # about 200 bytes
    short = " ".join(f"longer{i}word" for i in range(40))  # more bytes, fewer words
    docs = [(i, " ".join(r.permutation(words)[:80]) + f" {passage if i < 2 else short} " + " ".join(r.permutation(words)[:80]), "en", "s", 0) for i in range(4)]
    out = {x["doc_id"]: x["text"] for x in corpus_pipeline.repeated_passages(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()}
    assert all(" ".join(passage.split()[1:-1]) not in out[i] for i in (0, 1)) and all(short in out[i] for i in (2, 3))
