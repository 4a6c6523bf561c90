"""WARC, host rules, replication, toxicity, quality, search: odd inputs, SQL, held-out accuracy, recall."""

import collections
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamstone.llm import gam, hash_search, host_rules, replication, simhash, toxicity, warc

SF = "/root/testdata/sf0.001"
TABLES = "documents pages labels embeddings".split()


@pytest.mark.parametrize("module", [warc, host_rules, replication])
def test_query_equals_sql(spark, module):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = module.query(spark, SF).toPandas(), c.execute(module.ORACLE).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got[columns].astype(str).itertuples(index=False))) == sorted(map(tuple, want[columns].astype(str).itertuples(index=False)))


def test_warc_odd_rows(spark):
    pages = spark.createDataFrame([(None, None, None), (1, "http://a/", ""), (2, "u", "<p>a &amp; b<br>c</p><script>x</script><!-- y -->"), (2, "u", "<p>d</p>")], "page_id long, url string, html string")
    out = warc.derive(warc.responses_of_pages(pages).withColumn("Block", F.lit("clash")))
    assert out.count() == 8 and out.columns.count("block") == 1 and "Block" not in out.columns
    texts = {r["block"] for r in out.filter("warc_type = 'conversion'").collect()}
    assert texts == {"", "a & b\nc", "d"}
    pair = out.filter("target_uri = 'http://a/'").collect()
    assert {p["record_id"] for p in pair} == {p["concurrent_to"] for p in pair} and len({p["refers_to"] for p in pair}) == 1
    assert warc.derive(warc.responses_of_pages(pages.limit(0))).count() == 0


def test_warc_file(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>hé</p>")], "page_id long, url string, html string")
    warc.write_warc(warc.derive(warc.responses_of_pages(pages)).coalesce(1), str(tmp_path / "w"))
    import gzip

    data = b"".join(gzip.open(p).read() for p in (tmp_path / "w").glob("*.gz")).split(b"WARC/1.1\r\n")[1:]
    assert len(data) == 2
    for record in data:
        head, _, block = record.partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n"))
        assert b"WARC-Refers-To" in fields and block.endswith(b"\r\n\r\n") and len(block) == int(fields[b"Content-Length"]) + 4


def test_warc_file_keeps_source(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(1, "http://a/", "<p>hé</p>")], "page_id long, url string, html string")
    more = F.concat("http_headers", F.lit('ETag: "x:1"\r\nLast-Modified: Mon, 01 Jan 2024 00:00:00 GMT\r\n'))
    records = warc.derive(warc.responses_of_pages(pages).withColumn("http_headers", more))
    warc.write_warc(records.coalesce(1), str(tmp_path / "w"))
    want = records.first()
    data = b"".join(gzip.open(p).read() for p in (tmp_path / "w").glob("*.gz")).decode().split("WARC/1.1\r\n")[1:]
    assert len(data) == 2
    for record in data:
        fields = [x.split(": ", 1) for x in record.partition("\r\n\r\n")[0].split("\r\n")]
        assert "".join(v + "\r\n" for k, v in fields if k == "WARC-Source-Header") == want["source_headers"]
        assert [v for k, v in fields if k == "WARC-Source-Payload-Digest"] == [want["source_digest"]]


def test_host_threshold_takes_effect(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "too few words"
    hosts = {"clean": 0, "mixed": 45, "broken": 95}
    docs = spark.createDataFrame([(h, bad if i < n else good) for h, n in hosts.items() for i in range(100)], "source string, text string")
    kept = {r["source"]: r["n"] for r in host_rules.apply_rules(docs).groupBy("source").agg(F.sum(F.col("kept").cast("int")).alias("n")).collect()}
    assert kept == {"clean": 100, "mixed": 55, "broken": 0}


def brute_rules(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    again = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
    cover = {i + k for i, g in enumerate(grams) if g in again for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(cover)


def test_host_rules_odd_rows(odd, empty):
    out = host_rules.apply_rules(odd.withColumn("Host_Docs", F.lit(1)))
    assert out.columns.count("host_docs") == 1 and "Host_Docs" not in out.columns
    assert out.count() == odd.count() and host_rules.apply_rules(empty).count() == 0
    for r in out.collect():
        x = r["rules"]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == brute_rules(r["text"])


def test_host_verdict_shrinks(spark):
    good = " ".join(f"w{i}" for i in range(30))
    data = [(i, good, "fine") for i in range(200)] + [(1000 + i, "bad", "awful") for i in range(200)] + [(5000, "bad", "small")]
    data += [(9000 + i, good, "awful") for i in range(5)]
    out = {r["doc_id"]: r["kept"] for r in host_rules.apply_rules(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert out[0] and not out[1000] and not out[9000] and not out[5000]


def test_replication_is_poisson(spark, odd, empty):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") % 10 == 0, "small").otherwise("big").alias("source"))
    out = replication.replicate(docs, {"small": 0.5, "big": 0.5}).cache()
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["small"] - 10_000) < 400 and abs(n["big"] - 10_000) < 400
    counts = out.filter("source = 'small'").groupBy("doc_id").count().groupBy("count").count().collect()
    from math import exp, factorial

    for r in counts:  # rate 5: drawn as two variables of 2.5
        if r[0] <= 9:
            assert abs(r[1] - 2000 * exp(-5) * 5 ** r[0] / factorial(r[0])) < 80
    assert replication.replicate(empty).count() == 0
    assert set(replication.replicate(odd).columns) == {*odd.columns, "copy_index", "n_copies", "shuffle_key"}
    assert replication.replicate(odd.select("doc_id", "text", "source", F.lit(1).alias("Rate"))).columns.count("Rate") == 0


@pytest.mark.parametrize("module", [gam, toxicity])
def test_classifiers_odd_rows(spark, odd, empty, module):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    learn = gam.fold() != 0
    out = module.classify(odd, labels, learn).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert module.classify(empty, labels, learn).count() == 0
    none = module.classify(odd, labels.limit(0), learn).collect()
    assert {r["score"] for r in none} == {0.5}
    nulls = spark.createDataFrame([(0, None, None)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in module.classify(odd, nulls, learn).collect()} == {0.5}


def held_out(spark, module, label):
    sf = "/root/testdata/sf0.1"
    got = module.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    return got["predicted"].to_numpy(), got[label].to_numpy()


def test_quality_held_out(spark):
    predicted, y = held_out(spark, gam, "quality")
    assert (predicted == y).mean() > 0.98
    assert predicted[y == 1].mean() > 0.99 and predicted[y == 0].mean() < 0.1


def test_toxicity_held_out(spark):
    predicted, y = held_out(spark, toxicity, "toxic")
    assert predicted[y == 1].mean() > 0.7 and predicted[y == 0].mean() < 0.02


def test_folds_are_crc32(spark):
    got = spark.range(50).select(gam.fold("id").alias("f")).collect()
    assert [r["f"] for r in got] == [zlib.crc32(str(i).encode()) % 5 for i in range(50)]


def test_gam_learns_an_interaction():
    x = np.random.default_rng(0).random((4000, len(gam.NAMES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = gam.Model(x, y)
    assert ((m.score(x) > 0.5) == y).mean() > 0.95 and (m.pairs[0][0], m.pairs[0][1]) == (0, 1)


def test_search_recall(spark):
    out = hash_search.query(spark, "/root/testdata/sf0.01").toPandas()
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas()
    x, ids = np.array(table["embedding"].tolist(), np.float64), table["vec_id"].to_numpy()
    hit = n = 0
    for q, g in out.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        near = [i for i in ids[np.lexsort((ids, d))] if i != q][:10]
        hit, n = hit + len(set(near) & set(g["vec_id"])), n + 10
        assert g.sort_values("rank")["rank"].tolist() == list(range(1, 11))
        assert np.allclose(g["score"], [d[ids == i][0] for i in g["vec_id"]], atol=1e-12)
    assert n == 10 * (ids % 100 == 0).sum() and hit / n > 0.9


def test_probing_alone_finds_the_neighbours(spark):
    """No list is longer than the block would be, and the lists hold the neighbours."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x, ids = np.array(table["embedding"].tolist(), np.float64), table["vec_id"].to_numpy()
    codes = hash_search.Codes(x, 6)
    radius, reach = hash_search._calibrated(codes, x, 10, 0.97)
    block = hash_search.Block(codes.code(x))
    near = hash_search.values_near(radius // codes.parts)
    hit, share, listed = [], [], []
    for q in np.flatnonzero(ids % 100 == 0):
        code = block.codes[q]
        rows = block.probed(code, near)
        want = np.bitwise_count(block.codes.view(np.uint16) ^ code.view(np.uint16)).min(axis=1) <= radius // codes.parts
        assert rows.tolist() == np.flatnonzero(want).tolist()  # nothing but what probing reaches
        found = block.within(code, radius, reach, near)
        assert set(found) <= set(rows) and set(np.flatnonzero(hash_search.distances(block.codes, code) <= radius)) <= set(found)
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit.append(np.isin(np.argsort(d)[:10], found).mean())
        share.append(len(rows) / len(x))
    assert np.mean(hit) >= 0.9 and np.mean(share) < 0.7


def test_search_repeated_rows(spark):
    r = np.random.default_rng(0)
    data = [(i, [float(v) for v in r.normal(size=4)]) for i in range(40)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    again = df.unionByName(df.filter("vec_id % 10 = 0")).unionByName(df.filter("vec_id = 20"))  # each query's row twice or thrice
    out = hash_search.search(again, F.col("vec_id") % 10 == 0).collect()
    assert len({(r["query_id"], r["rank"]) for r in out}) == len(out) == 40
    x = {i: np.array(v, np.float32).astype(float) for i, v in data}
    rows, hit = [i for i, _ in data] + [0, 10, 20, 30, 20], 0
    for q in (0, 10, 20, 30):  # copies of other queries are candidates of their own
        near = sorted((float(np.sqrt(((x[i] - x[q]) ** 2).sum())), i) for i in rows if i != q)
        got = [(r["score"], r["vec_id"]) for r in sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])]
        assert got == sorted(got) and not collections.Counter(got) - collections.Counter(near)
        hit += sum((collections.Counter(got) & collections.Counter(near[:10])).values())
    assert hit >= 36


def test_search_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (8, []), (100, [0.0, 1.0]), (9, [1.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    out = hash_search.search(df, F.col("vec_id") % 100 == 0)
    got = {q: [r["vec_id"] for r in sorted(out.filter(F.col("query_id") == q).collect(), key=lambda r: r["rank"])] for q in (0, 100)}
    assert got == {0: [1, 9, 100], 100: [0, 1, 9]}
    assert hash_search.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_pigeonhole_finds_all_within_radius():
    r = np.random.default_rng(3)
    codes = r.integers(0, 256, (3000, 16), np.uint8)
    codes[:300] = codes[0] ^ np.packbits(r.random((300, 128)) < 0.05, axis=1)
    block = hash_search.Block(codes)
    for radius in (0, 3, 7, 15, 31, 50):
        want = np.flatnonzero(hash_search.distances(codes, codes[0]) <= radius)
        assert sorted(block.within(codes[0], radius).tolist()) == want.tolist()


CLASHES = ["_text", "_title", "_links", "_bytes", "r", "_counts", "fp", "f", "y", "score", "cls", "doc", "tag", "starts", "first", "rate", "Source_Key", "grams", "x", "h"]


def test_clashing_names(spark, odd):
    extra = [F.lit(c).alias(c) for c in CLASHES]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    pages = spark.createDataFrame([(1, "http://a/", "<title>t</title><p>x</p>")], "page_id long, url string, html string")
    records = warc.derive(warc.responses_of_pages(pages).select("*", *extra))
    assert records.select(*CLASHES).distinct().collect() == [tuple(CLASHES)] and records.count() == 2
    ruled = host_rules.apply_rules(odd.drop("rules").select("*", *extra))
    assert ruled.select(*CLASHES).distinct().collect() == [tuple(CLASHES)] and ruled.count() == odd.count()
    docs = odd.drop("rules").select("*", *extra)
    assert gam.classify(docs, labels, gam.fold() != 0).count() == toxicity.classify(docs, labels, gam.fold() != 0).count() == odd.count()
    kept = gam.keep_good(docs, labels, gam.fold() != 0)
    assert kept.columns == docs.columns and kept.select(*CLASHES).distinct().collect() == [tuple(CLASHES)]
    near = simhash.near_duplicates(docs)
    assert near.columns == docs.columns and near.select(*CLASHES).distinct().collect() == [tuple(CLASHES)]
    assert simhash.components_of(docs).count() == odd.count()


@pytest.mark.parametrize("module", [gam, toxicity])
def test_equal_texts_score_alike_and_null_ids_are_not_held_out(spark, odd, module, tmp_path):
    out = module.classify(odd, spark.read.parquet(f"{SF}/labels.parquet"), gam.fold() != 0)
    scores = collections.defaultdict(set)
    for r in odd.select("doc_id", "text").join(out, "doc_id").collect():
        scores[r["text"] or ""].add(r["score"])
    assert all(len(s) == 1 for s in scores.values())
    odd.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    got = module.query(spark, str(tmp_path)).collect()
    assert len(got) == odd.count() and all(isinstance(r["held_out"], bool) for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]


def test_quality_scores_equal_plain_python(spark):
    from bisect import bisect_right
    from math import exp

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    learn = gam.fold() != 0
    model = gam.train(gam.featured(docs), labels, "quality", learn)
    got = {r["doc_id"]: r["score"] for r in gam.classify(docs, labels, learn).collect()}
    for r in docs.collect():
        f = [float(np.float32(v)) for v in gam.features(r["text"])]
        at = [bisect_right([float(e) for e in edges], v) for edges, v in zip(model.edges, f, strict=True)]
        raw = model.bias + sum(float(table[k]) for table, k in zip(model.tables, at, strict=True))
        for i, j, table in model.pairs:
            a, b = (min(7, at[k] * 8 // (len(model.edges[k]) + 1)) for k in (i, j))
            raw += float(table[a][b])
        assert abs(1 / (1 + exp(-raw)) - got[r["doc_id"]]) < 1e-9


def test_quality_tree_takes_the_best_cut():
    r = np.random.default_rng(6)
    for _ in range(50):
        g, h = r.normal(size=9), r.random(9) + 0.2
        tree = gam._split_1d(g, h, 2, 1.0, 0.5)

        best = (1e-9, 9)  # no cut
        for cut in range(1, 9):
            parts = [slice(0, cut), slice(cut, 9)]
            if min(h[p].sum() for p in parts) < 0.5:
                continue
            gain = sum(g[p].sum() ** 2 / (h[p].sum() + 1) for p in parts) - g.sum() ** 2 / (h.sum() + 1)
            if gain > best[0]:
                best = (gain, cut)
        want = np.concatenate([np.full(len(g[p]), -g[p].sum() / (h[p].sum() + 1)) for p in (slice(0, best[1]), slice(best[1], 9))])
        assert np.allclose(tree, want)


def plain_grams(text):
    """Buckets of a text's words, pairs and skip-pairs, one by one."""
    full = (1 << 64) - 1

    def mixed(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
        return x ^ (x >> 31)

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    bare = [w.lower().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") or w for w in words]
    h = [xxhash.xxh64_intdigest(w.encode(), 1) for w in bare]
    found = {mixed(x) >> 44 for x in h}
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        found |= {mixed((a * salt + b) & full) >> 44 for a, b in zip(h, h[gap:], strict=False)}
    return found


def test_toxicity_scores_equal_plain_python(spark):
    from math import exp

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    learn = gam.fold(folds=4) != 2
    model = toxicity.train(docs, labels, "toxic", learn)
    weight = dict(zip(model["bucket"].tolist(), model["weight"].tolist(), strict=True))
    assert len(weight) > 1
    got = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, labels, learn).collect()}
    for r in docs.collect():
        raw = weight[-1] + sum(weight.get(k, 0.0) for k in plain_grams(r["text"]))
        assert abs(1 / (1 + exp(-max(-30.0, min(30.0, raw)))) - got[r["doc_id"]]) < 1e-9


def test_ftrl_equals_plain_steps():
    from math import copysign, exp

    r = np.random.default_rng(2)
    bags = [np.unique(r.integers(0, 40, 12)) for _ in range(200)]
    y = np.array([float(b.min() < 3) for b in bags])
    alpha, beta, l1, l2 = 0.5, 1.0, 0.3, 0.7
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(k, l1=l1, l2=l2):
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - copysign(l1, z[k])) / ((beta + n[k] ** 0.5) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(3):
        for i in order.permutation(len(bags)):
            w = {int(k): weight(int(k)) for k in bags[i]}
            w["bias"] = weight("bias", 0.0, 0.01)
            g = 1 / (1 + exp(-sum(w.values()))) - y[i]
            for k, x in w.items():
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / alpha * x
                n[k] += g * g
    got, _ = toxicity.ftrl([b.astype(np.int32) for b in bags], y, 6, alpha, beta, l1, l2, 3)
    assert np.allclose(got[:40], [weight(k) for k in range(40)]) and (got != 0).any() and (got[:40] == 0).any()
