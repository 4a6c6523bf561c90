"""SimHash, window doubling, suffix merge and packing against brute force."""

import collections
import hashlib
import random
import zlib
from bisect import bisect_left

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loamstone.llm import packing, repeats, simhash, suffix_dedup, window_dedup
from loamstone.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_query(spark):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.query(spark, SF).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {i: brute_fingerprint(t) for i, t in docs.items()}
    groups = brute_components(prints, 2)
    assert got == {i: (f"{prints[i]:016x}", groups[i]) for i in docs}


def test_simhash_odd_rows(odd, empty):
    out = simhash.components_of(odd).collect()
    assert len(out) == odd.count() and simhash.components_of(empty).count() == 0
    assert {r["component_id"] for r in out if r["fp"] == 0} == {0}


@pytest.mark.parametrize("seed", range(2))
def test_components_of_chains(spark, seed):
    r = random.Random(seed)
    prints, value = {}, r.getrandbits(64)
    for i in range(120):  # long chains of single steps, and strangers
        value = r.getrandbits(64) if r.random() < 0.1 else value ^ (1 << r.randrange(64))
        prints[1000 - i * 3] = value
    unique = {}
    for i in sorted(prints):
        unique.setdefault(prints[i], i)
    nodes = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for v, i in unique.items()], "node long, fp long")
    got = {x["node"]: x["component"] for x in simhash.components(simhash.links(nodes), Scratch(spark, "t")).collect()}
    want = brute_components({i: v for v, i in unique.items()}, 2)
    assert {i: got.get(i, i) for i in want} == want


def test_links_are_grouped_in_batches(spark):
    nodes = [(i, i << 1 if i < 40 else r << 32 | i) for r in (0, 7) for i in range(40 * (r > 0), 40 + 20 * (r > 0))]
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # groups go on over batches
    try:
        found = simhash.links(spark.createDataFrame(nodes, "node long, fp long"))
        assert "collect_list" not in found._jdf.queryExecution().toString()
        got = {x["node"]: x["component"] for x in simhash.components(found, Scratch(spark, "t")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    want = brute_components(dict(nodes), 2)
    assert {i: got.get(i, i) for i in want} == want


def test_near_duplicates(spark, odd, empty):
    r = random.Random(5)
    base = [f"w{r.randrange(5000)}" for _ in range(400)]
    near = list(base)
    near[200] = "changed"
    far = [w if i % 8 else f"z{i}" for i, w in enumerate(base)]
    other = [f"w{r.randrange(5000)}" for _ in range(400)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((base, near, far, other, base))] + [(None, " ".join(base)), (7, None), (8, "")], "doc_id long, text string")
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0) for x in simhash.near_duplicates(docs).collect()) == [(False, 0), (False, 2), (False, 3), (False, 7), (True, 0)]
    assert simhash.near_duplicates(empty).count() == 0 and simhash.near_duplicates(odd).columns == odd.columns


def similarity(a, b):
    a, b = (a or "").lower().split(), (b or "").lower().split()
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a, b))
    return len(a & b) / len(a | b)


def test_near_duplicates_of_one_chain(spark):
    r = random.Random(8)
    root = [f"w{r.randrange(10**6)}" for _ in range(300)]
    steps = [root]
    for i in range(8):  # each is like the one before it, and ever less like the first
        steps.append(steps[-1][:])
        steps[-1][i * 30 : i * 30 + 24] = [f"x{r.randrange(10**6)}" for _ in range(24)]
    texts = {100 + i: " ".join(w) for i, w in enumerate(steps + steps[3:] + steps[2:])}
    kept = sorted(x["doc_id"] for x in simhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect())
    want = []
    for d, t in texts.items():
        if all(similarity(t, texts[k]) < 0.8 for k in want):
            want.append(d)
    assert 1 < len(want) < len(steps) and kept == want


def test_near_duplicates_find_every_close_pair(spark):
    r = random.Random(3)
    texts = []
    for _ in range(150):  # pairs of similarity 0.80 to 0.85
        one = [f"w{r.randrange(10**6)}" for _ in range(304)]
        two = one[:]
        n = r.randrange(22, 30)
        two[100 : 100 + n] = [f"x{r.randrange(10**6)}" for _ in range(n)]
        assert 0.8 <= similarity(" ".join(one), " ".join(two)) < 0.86
        texts += [" ".join(one), " ".join(two)]
    kept = {x["doc_id"] for x in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == set(range(0, 300, 2))


def test_near_duplicates_go_by_fingerprints_first(spark, monkeypatch):
    r = random.Random(4)

    def changed(words, at, n=1):
        return [*words[:at], *(f"x{r.randrange(10**6)}" for _ in range(n)), *words[at + n :]]

    def close(words):  # another last word, at most two bits away
        while True:
            new = changed(words, len(words) - 1)
            if (simhash.fingerprint(" ".join(new)) ^ simhash.fingerprint(" ".join(words))).bit_count() <= 2:
                return new

    texts = {}
    for i in range(0, 600, 20):  # the hub of a component leaves, what it covers does not, and has a neighbour of its own
        root = [f"w{r.randrange(10**6)}" for _ in range(400)]
        hub = changed(root, 100, 40)
        member = close(hub)
        texts |= {i: root, i + 1: hub, i + 2: member, i + 3: close(member), i + 4: changed(member, 300, 30), i + 5: close(root)}
    texts = {d: " ".join(w) for d, w in texts.items()}
    want = []
    for d, t in texts.items():
        if all(similarity(t, texts[k]) < 0.8 for k in want if k // 20 == d // 20):
            want.append(d)
    assert all(i + 1 not in want and i + 2 in want for i in range(0, 600, 20))
    compared, prefixes = [], simhash._prefixes
    monkeypatch.setattr(simhash, "_prefixes", lambda rest, *a: compared.append({x["doc"] for x in rest.select("doc").collect()}) or prefixes(rest, *a))
    got = sorted(x["doc_id"] for x in simhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect())
    assert got == want
    assert not any(i + 5 in compared[0] for i in range(0, 600, 20))  # linked and compared exactly already
    assert any(i + 2 not in compared[0] for i in range(0, 600, 20))  # covered by what leaves


def brute_windows(texts, width):
    words = [(t or "").encode().split() for t in texts]
    counts = collections.Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - width + 1):
            if counts[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = True
        out.append((len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out


def test_windows_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = dict(zip([d["doc_id"] for d in docs], brute_windows([d["text"] for d in docs], 35), strict=True))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in window_dedup.query(spark, SF).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 0


def test_windows_odd_rows(odd, empty):
    rows = odd.collect()
    want = collections.Counter(zip([r["doc_id"] for r in rows], brute_windows([r["text"] for r in rows], 35), strict=True))
    got = collections.Counter((r["doc_id"], (r["n_words"], r["n_removed"], r["kept_sha256"])) for r in window_dedup.deduplicate(odd).collect())
    assert got == want and window_dedup.deduplicate(empty).count() == 0


def test_window_levels():
    assert window_dedup.levels(35) == [9, 18, 35] and window_dedup.levels(5) == [5]
    h = np.arange(40, dtype=np.uint64)
    assert len(repeats.doubled(h, 9)) == 32 and (repeats.doubled(np.tile(h, 2), 18)[:20] == repeats.doubled(np.tile(h, 2), 18)[40:60]).all()


@pytest.mark.parametrize("width", [1, 3, 8])
def test_anchors_depend_on_content(width):
    h = repeats.mix(np.random.default_rng(0).integers(0, 6, 500, np.uint64))
    want = [i + int(np.argmin(h[i : i + width] & ~np.uint64((1 << 22) - 1))) for i in range(len(h) - width + 1)]
    assert repeats.least(h, width).tolist() == want


def brute_masks(texts, length):
    counts = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        edge = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                edge[i] += 1
                edge[i + length] -= 1
        yield np.cumsum(edge[:-1]) > 0


def brute_bytes(texts, length):
    out = []
    for t, gone in zip(texts, brute_masks(texts, length), strict=True):
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_suffix_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = dict(zip([d["doc_id"] for d in docs], brute_bytes([(d["text"] or "").encode() for d in docs], 400), strict=True))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.query(spark, SF).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 0


def test_suffix_odd_rows(odd, empty):
    rows = odd.collect()
    want = collections.Counter(zip([r["doc_id"] for r in rows], brute_bytes([(r["text"] or "").encode() for r in rows], 400), strict=True))
    out = suffix_dedup.deduplicate(odd).withColumn("h", F.sha2("kept", 256)).collect()
    assert collections.Counter((r["doc"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["h"])) for r in out) == want
    cut = suffix_dedup.without_repeats(odd)
    clash = odd.select("*", F.lit(1).alias("doc"), F.lit(2).alias("starts"), F.lit(3).alias("row"))
    assert suffix_dedup.without_repeats(clash).select("doc", "starts", "row").distinct().collect() == [(1, 2, 3)]
    assert cut.columns == odd.columns and cut.count() == odd.count() and cut.filter("text is null").count() == 1
    assert suffix_dedup.deduplicate(empty).count() == 0 and suffix_dedup.without_repeats(empty).count() == 0


def merged_masks(texts, length, small, ranges, k):
    """The range merge of the operator, run by hand over k sorted runs and some ranges."""
    suffix_dedup.SMALL_GROUP, before = small, suffix_dedup.SMALL_GROUP
    runs = [[] for _ in range(k)]
    for d, t in enumerate(texts):
        if len(t) >= length:
            for a, left, s in suffix_dedup._suffixes(t, length):
                runs[d % k].append((s, left, d, 0, a))
    for r in runs:
        r.sort()
    keys = sorted(x[0] for r in runs for x in r)
    cuts = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []
    covers, open_ = [], []
    for q in range(len(cuts) + 1):
        streams, own, parts = [], [], []
        for r in runs:
            e = [0, *(bisect_left([x[0] for x in r], c) for c in cuts), len(r)]
            low, high = max(0, e[q] - 1), min(len(r), e[q + 1] + 1)
            parts.append(r[low:high])
            streams.append(([x[0] for x in parts[-1]], suffix_dedup.front_coded([x[0] for x in parts[-1]])[0]))
            own.append((e[q] - low, e[q + 1] - low))
        group, last = suffix_dedup.Group(), b""
        for p, i, shared in suffix_dedup.merge(streams):
            s = parts[p][i]
            assert last <= s[0] and shared == suffix_dedup.shared_prefix(last, s[0])
            last, mine = s[0], own[p][0] <= i < own[p][1]
            if shared < length // 2:
                group.settle(length, covers, open_)
                group, shared = suffix_dedup.Group(), 0
            group.add((*s, mine), shared)
            group.edge |= not mine
        group.settle(length, covers, open_)
    suffix_dedup.SMALL_GROUP = before
    masks = [np.zeros(len(t), bool) for t in texts]
    for d, _, s, e in covers:
        masks[d][s:e] = True
    strings = [(d, at - len(left) + i, (left + s)[i : i + length]) for s, left, d, _, at, _ in open_ for i in range(len(left + s) - length + 1)]
    counts = collections.Counter(x[2] for x in strings)
    for d, i, s in strings:
        if counts[s] > 1:
            masks[d][i : i + length] = True
    return masks


@pytest.mark.parametrize("seed", range(150))
def test_merge_of_small_alphabets(seed):
    r = random.Random(seed)
    length, letters = r.choice([8, 10, 12, 16]), r.choice([2, 3, 8])
    passages = [bytes(r.randrange(letters) for _ in range(r.randrange(1, 40))) for _ in range(4)]
    texts = [b"".join(r.choice(passages) if r.random() < 0.6 else bytes(r.randrange(letters) for _ in range(r.randrange(1, 15))) for _ in range(r.randrange(0, 7))) for _ in range(r.randrange(1, 30))]
    counts = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    got = merged_masks(texts, length, r.choice([1, 2, 32]), r.choice([1, 2, 5]), r.choice([1, 2, 3, 5]))
    for t, mask in zip(texts, got, strict=True):
        want = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                want[i : i + length] = True
        assert (mask == want).all()


def test_groups_give_one_stretch_a_member():
    r = random.Random(4)
    core = bytes(r.randrange(97, 123) for _ in range(220))
    group = suffix_dedup.Group()
    for i in range(300):  # of many kinds: each shares another part of its bytes before the core with the others
        left = bytes(r.randrange(97, 123) for _ in range(r.randrange(0, 100))) + core[: r.randrange(0, 50)]
        group.add((core, left, i, 0, 1000, True), len(core) if i else 0)
    group.members.sort()
    covers, open_ = [], []
    group.settle(210, covers, open_)
    assert len(covers) == 300 and not open_ and all(s <= 1000 and e == 1220 for _, _, s, e in covers)


def test_long_runs():
    text = b"aa bb cc dd  ee ff gg"
    mask = np.zeros(len(text), bool)
    mask[1:8] = mask[10:19] = True  # 'a bb cc' holds two whole words, 'd  ee ff ' two also
    assert (suffix_dedup.long_runs(np.frombuffer(text, np.uint8), mask, 2) == mask).all()
    assert not suffix_dedup.long_runs(np.frombuffer(text, np.uint8), mask, 3).any()


def test_repeated_keys(spark):
    r = random.Random(2)
    data = {i: [r.randrange(400) for _ in range(r.randrange(0, 40))] for i in range(60)}
    counts = collections.Counter(k for keys in data.values() for k in keys)
    df = spark.createDataFrame([(i, bytearray(repeats.mix(np.array(k, np.uint64)).tobytes())) for i, k in data.items()], "doc long, keys binary").repartition(5)
    got = {x["doc"]: np.frombuffer(bytes(x["hits"]), np.uint32).tolist() for x in repeats.repeated(df, ["doc"], Scratch(spark, "t")).collect()}
    assert got == {i: w for i, k in data.items() if (w := [j for j, x in enumerate(k) if counts[x] > 1])}


def test_no_repeats_at_all(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(80))) for i in range(20)], "doc_id long, text string").repartition(4)
    assert {r["n_removed"] for r in window_dedup.deduplicate(df).collect()} == {0}
    assert {r["n_removed"] for r in suffix_dedup.deduplicate(df).collect()} == {0}
    assert simhash.near_duplicates(df).count() == 20


def test_equal_keys_with_other_checks_are_no_repeat(spark):
    pack = lambda x: bytearray(np.array(x, np.uint64).tobytes())
    data = [(0, pack([5, 5, 5, 9]), pack([1, 2, 1, 3])), (1, pack([5, 9, 7]), pack([2, 4, 7])), (2, pack([7, 8]), pack([7, 8]))]
    df = spark.createDataFrame(data, "doc long, keys binary, checks binary").repartition(3, "doc")
    got = {x["doc"]: np.frombuffer(bytes(x["hits"]), np.uint32).tolist() for x in repeats.repeated(df, ["doc"], Scratch(spark, "t"), checked=True).collect()}
    assert got == {0: [0, 1, 2], 1: [0, 2], 2: [0]}
    text = np.frombuffer(b"some bytes that are hashed twice", np.uint8)
    assert (suffix_dedup.gram_hashes(text, 8) != suffix_dedup.gram_hashes(text, 8, 1)).all()


def check_pieces(pieces, ids, length=2048):
    got = collections.defaultdict(list)
    for p in pieces:
        x = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert len(x) == p["length"] > 0 and zlib.crc32(x.tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(ids[p["doc_id"]])
        got[p["sequence_id"]].append((p["offset"], p["length"]))
    total = sum(p["length"] for p in pieces)
    for s, parts in got.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or (s == max(got) and at == total % length)
    return total


def encoded(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    return [np.array(e.ids + [1], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_packing_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    ids = dict(zip([d["doc_id"] for d in docs], encoded([d["text"] for d in docs]), strict=True))
    assert check_pieces(packing.query(spark, SF).collect(), ids) == sum(map(len, ids.values()))


def test_packing_odd_rows(spark, odd, empty):
    rows = odd.collect()
    ids = dict(zip([r["doc_id"] for r in rows], encoded([r["text"] for r in rows]), strict=True))
    clash = odd.select("*", *[F.lit("x").alias(c) for c in ("queue", "base", "pid", "ids", "Doc_Tokens", "place")])
    out = packing.pack(clash, packing.tokenizer_path(), {"src0": 3.0, "src1": 1.0}, window_sequences=2, carry_ids=True).collect()
    assert check_pieces(out, ids) == sum(len(ids[r["doc_id"]]) for r in rows)
    assert all(zlib.crc32(bytes(p["ids"])) == p["ids_crc32"] for p in out)
    assert packing.pack(empty, packing.tokenizer_path()).count() == 0


def test_packing_of_very_many_sources(spark):
    docs = spark.range(30_000, numPartitions=4).selectExpr("id AS doc_id", "concat('src', id % 29000) AS source", "concat('some words of ', id) AS text")
    texts = [f"some words of {i}" for i in range(30_000)]
    ids = dict(enumerate(encoded(texts)))
    out = packing.pack(docs, packing.tokenizer_path(), {f"src{i}": 5.0 for i in range(50)})
    assert check_pieces(out.collect(), ids) == sum(map(len, ids.values()))
    phases = packing.plan({f"q{i}": 1000 + 37 * i for i in range(packing.MAX_QUEUES)}, {f"q{i}": float(i % 7 + 1) for i in range(packing.MAX_QUEUES)}, 2048)
    assert sum(len(p["at"]) for p in phases) <= 2 * packing.MAX_QUEUES**2


@pytest.mark.parametrize("text", ["Hello, World's café!! don't 'tis 12ab", "Σίσυφος ΟΔΟΣ. x<|endoftext|>y <|startoftext|>", "a\x0bb\x0c\x1c c d é É'S", "🙂🙂... ...a", ""])
def test_words_encode_as_texts(text):
    import pyarrow as pa

    ids, n = packing.WordEncoder(packing.tokenizer_path()).encode(pa.array([text, None, text]), 1)
    want = encoded([text, "", text])
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == np.concatenate(want).tolist()


def test_windows_hold_target_shares():
    sizes = {"a": 100_000, "b": 40_000, "c": 3_000}
    weights = {"a": 1.0, "b": 1.0, "c": 2.0}
    phases = packing.plan(sizes, weights, 1000)
    taken = {s: [] for s in sizes}
    for s, n in sizes.items():
        own = [(p["at"][s], p["first"], p["upto"][s] if "upto" in p else None, p.get("given", {}).get(s)) for p in phases if s in p["at"]]
        taken[s] = packing.pieces_of(own, 0, n, 1000)
    place = sorted((p, n) for parts in taken.values() for p, _, n in parts)
    assert place[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(place, place[1:], strict=False)) and sum(n for _, n in place) == 143_000
    per_window = collections.Counter()
    for s, parts in taken.items():
        for p, _, n in parts:
            per_window[s, p // 1000] += n
    for w in range(5):  # while all three last, every window holds 1/4, 1/4, 1/2
        assert [abs(per_window[s, w] - x) <= 1 for s, x in zip("abc", (250, 250, 500), strict=True)] == [True] * 3
