"""Operators against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")

from cleanloom.llm import bpe, dedup, licenses, near_dup, packing, quality, sharding, topk, url_filter, warc  # noqa: E402

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def clashing(df):
    """Adds columns with names that operators use themselves."""
    return df.selectExpr("*", "1 AS n", "'k' AS key", "'i' AS id", "'x' AS __id", "7 AS tree", "'s' AS score", "'t' AS shard", "'r' AS rank", "'v' AS v", "'q' AS __key", "'c' AS capture")


def docs(spark, texts, ids=None, source=None):
    rows = [(i if ids is None else ids[i], t, source[i] if source else f"s{i % 3}") for i, t in enumerate(texts)]
    return clashing(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3))


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared passages, edge cases."""
    rng = random.Random(5)
    passage = words(rng, 60)
    out = [None, "", " \n", "one", "two words", "Two  Words", "four small words here", "x" * 200_000]
    for _ in range(60):
        w = words(rng, rng.randrange(20, 200), 5000)
        if rng.random() < 0.4:
            w = w[:10] + passage + w[10:]
        out.append(" ".join(w))
        for _ in range(rng.choice([0, 0, 1, 3])):
            v = list(w)
            for _ in range(rng.randrange(0, 4)):
                v[rng.randrange(len(v))] = f"z{rng.randrange(10**6)}"
            out.append(" ".join(v) if rng.random() < 0.7 else " ".join(v).upper())
    base = words(rng, 120, 5000)
    for _ in range(70):  # a group of near copies
        v = list(base)
        v[rng.randrange(120)] = f"y{rng.randrange(10**6)}"
        out.append(" ".join(v))
    return out


def test_topk(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in range(250)]
    rows += [(1000 + i, rows[0][1]) for i in range(20)]  # ties
    rows += [(5000, None), (5100, [1.0, None] + [0.0] * 6), (5200, [float("nan")] * 8), (5300, []), (5400, [1.0, 2.0]), (5500, [2.0, 1.0]), (None, [0.5] * 8), rows[3], (5600, [0.0] * 8)]
    df = clashing(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    kept = topk.quantised(df)
    got = topk.nearest(kept, kept.where("vec_id % 100 = 0"), block_vectors=64).collect()
    plain = {i: np.floor(1024 * np.array(v, float)).astype(int) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in plain if i % 100 == 0):
        best = sorted(((-int(plain[q] @ v), i) for i, v in plain.items() if i != q and len(v) == len(plain[q])))[:10]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want and len(got) == len(want)
    empty = topk.quantised(df.limit(0))
    assert topk.nearest(empty, empty).count() == 0


def test_topk_of_large_components(spark):
    rows = [(0, [20000.0, 1.0]), (1, [1e5, -1e5]), (2, [-3e8, 2.5]), (3, [1e-9, 4e3]), (100, [2e3, 1e5]), (101, [5e14, 1.0])]
    kept = topk.quantised(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    plain = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows}
    want = {(q, r + 1, i, s) for q in (0, 100) for r, (s, i) in enumerate(sorted(((sum(a * b for a, b in zip(plain[q], v, strict=True)), i) for i, v in plain.items() if i != q and i != 101), key=lambda x: (-x[0], x[1])))}
    asked = kept.where("vec_id % 100 = 0")
    assert {tuple(r) for r in topk.nearest(kept.where("vec_id < 101"), asked).select("query_id", "rank", "vec_id", "score").collect()} == want
    for wrong in (lambda: topk.nearest(kept, asked).collect(), lambda: topk.quantised(spark.createDataFrame([(1, [1e300])], "vec_id bigint, embedding array<double>")).collect()):
        with pytest.raises(Exception, match="fit 64 bits"):
            wrong()


def test_lists_leave_most_vectors_alone():
    """Vectors with energy in few dimensions, as trained embeddings have: few are scored in full, and the result is the plain one."""
    rng = np.random.default_rng(4)
    v = (1024 * rng.normal(size=(3000, 32)) * 0.7 ** np.arange(32)).astype(np.int64)
    lists = topk.Lists(np.arange(3000), v)
    for q in range(0, 3000, 300):
        rows, scores = lists.best(v[q], q, 10)
        plain = sorted((-int(s), i) for i, s in enumerate(v @ v[q]) if i != q)[:10]
        assert sorted(zip((-scores).tolist(), rows.tolist(), strict=True)) == plain
    assert lists.scored < 0.2 * 10 * 3000


def test_threshold_stops_early():
    rng = np.random.default_rng(1)
    v = np.zeros((5000, 4), np.int64)
    v[:, 0] = rng.permutation(5000)
    lists = topk.Lists(np.arange(5000), v)
    rows, scores = lists.best(np.array([3, 0, 0, 0]), -1, 5)
    assert sorted(scores.tolist(), reverse=True) == [3 * x for x in range(4999, 4994, -1)]


def test_exact_dedup(spark, corpus):
    texts = [*corpus, *corpus[:20], "İ", "i̇", "ÉA", "Éa"]
    df = docs(spark, texts)
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault((t or "").translate(UPPER), []).append(i)
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for i in g}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in dedup.exact_duplicates(df, salts=4).collect()}
    assert got == want
    assert sorted(r["doc_id"] for r in dedup.deduplicated(df).collect()) == sorted(max(g) for g in groups.values())
    odd = docs(spark, ["a", "A", "a", "b"], [None, None, 5, None])
    assert sorted((str(r["doc_id"]), r["kept"]) for r in dedup.exact_duplicates(odd).collect()) == [("5", True), ("None", False), ("None", False), ("None", True)]
    assert dedup.exact_duplicates(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def json_path():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("limits", [(2048, 256, 2048), (64, 3, 40)])
def test_packing(spark, corpus, json_path, limits):
    from tokenizers import Tokenizer

    tokens, segments, loss = limits
    texts = [*corpus, "<|endoftext|> as text", "é🙂" * 300]
    rows = packing.pack(docs(spark, texts).withColumn("bears", F.col("doc_id") % 3 != 0), json_path, bears_loss_col="bears", max_tokens=tokens, max_segments=segments, max_loss=loss).collect()
    t = Tokenizer.from_file(json_path)
    t.encode_special_tokens = True
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in enumerate(texts)}
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids[i])
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[i][at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids[i])
    padding = used = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= tokens and len(own) <= segments and sum(r["loss_tokens"] for r in own) <= loss
        padding += 0 if at & (at - 1) == 0 else tokens - at
        used += at
    if tokens == 2048:
        assert padding <= 0.01 * used
    assert packing.pack(docs(spark, texts).limit(0), json_path).count() == 0


def test_warc(spark):
    rng = random.Random(2)
    html = [None, "", "", "<p>same</p>", "<p>same</p>", "<p>é</p>", *(f"<p>{rng.random()}</p>" * 50 for _ in range(40)), "big" * 100_000]
    urls = [None, "", "not a url", "http://a.b.com/x", "http://A.b.com/x", *(f"https://h{i % 4}.example.org:80/p/{i}?q=é b\r\nX: y" for i in range(41)), "http://u@h.example.com"]
    ids = [*range(len(html) - 2), None, -7]
    df = clashing(spark.createDataFrame(list(zip(ids, urls, html, strict=True)), "page_id bigint, url string, html string").repartition(3))
    df = df.unionByName(df.where("page_id = 9"))  # a repeated row
    folder = f"file:///tmp/{__import__('uuid').uuid4().hex}"
    records = warc.write(df, f"{folder}/w")
    index = warc.index(records, f"{folder}/i", block_lines=4)
    got = warc.lookup(warc.url_keys(df), f"{folder}/w", index, payloads=True).collect()
    groups = {}
    for i, h in zip(ids, html, strict=True):
        groups.setdefault((h or "").encode(), []).append(i)
    groups[html[9].encode()].append(9)
    want = []
    for payload, own in groups.items():
        last = max((i for i in own if i is not None), default=None)
        for i in own:
            revisit = last is not None and i != last
            want.append((str(i), len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", str(last) if revisit else "None"))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got) == sorted(want)
    assert all(bytes(r["payload"]) in groups for r in got if r["record_type"] == "response")
    one = spark.createDataFrame([(warc._key("http://a.b.com/x", 3),), ("com,nothing)/ 1",)], "key string")
    assert [r["page_id"] for r in warc.lookup(one, f"{folder}/w", index).collect()] == [3]
    assert warc.archived(spark, df.limit(0)).count() == 0
    small = {r["page_id"]: r["record_type"] for r in warc.archived(spark, df, least_bytes=1000).collect()}
    assert small[3] == "response"
    assert warc.surt("http://A.b.com/x") == "com,b,a)/x" and warc.surt(None) == ""


@pytest.mark.parametrize("bucket", [4, 4096])
def test_sharding(spark, corpus, bucket):
    texts = [*corpus, "same", "same"]
    sources = [None if i % 9 == 0 else "hot" if i % 3 == 0 else f"s{i % 4}" for i in range(len(texts))]
    df = docs(spark, texts, source=sources)
    got = sharding.interleaved(df, 8, bucket_rows=bucket).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    by = {}
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
        by.setdefault(r["shard"], []).append(r)
    counts = [len(x) for x in by.values()]
    assert len(by) == 8 and max(counts) - min(counts) <= 1
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    for s in set(sources):
        share = [sum(r["source"] == s for r in own) for own in by.values()]
        assert max(share) - min(share) <= 2
    again = sharding.interleaved(df.repartition(2), 8, bucket_rows=bucket).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in got} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}
    # A plain version of the same order.
    rows = [(r["h"], r["doc_id"], zlib.crc32((texts[r["doc_id"]] or "").encode()), len((texts[r["doc_id"]] or "").encode()) + 1) for r in df.select("doc_id", F.xxhash64(F.lit(42), "doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")), (F.octet_length(F.coalesce("text", F.lit("")).cast("binary")) + 1).cast("long")).alias("h")).collect()]
    strata = {}
    for row in rows:
        source = sources[row[1]]
        strata.setdefault("-" if source is None else f"+{source}", []).append(row)
    buckets = -(-len(rows) // bucket)
    shuffled = lambda row: (((row[0] & (1 << 64) - 1) >> 20) % buckets, row)
    order = sorted(((2 * k + 1) / (2 * len(own)), name, *row) for name, own in strata.items() for k, row in enumerate(sorted(own, key=shuffled)))
    want, n = {}, len(order)
    for place, row in enumerate(order):
        shard = place * 8 // n
        want[row[3]] = shard, place - (shard * n + 7) // 8
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == want
    assert sharding.interleaved(df.limit(0)).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_components(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def test_near_duplicates(spark, corpus):
    texts = [*corpus, *corpus[8:12]]
    df = docs(spark, texts)
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(df).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == plain_components(texts)
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    kept = near_dup.one_of_each(df)
    assert kept.columns == df.columns and kept.count() == sum(r["kept"] for r in got.values())
    two = docs(spark, ["a b c d e f", "u v w x y z", "a B c d e f", "u v w x y z", None], [5, 5, 7, 9, 5])
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(two).collect()) == [(5, 0, 5), (5, 2, 5), (5, 2, 5), (7, 2, 5), (9, 2, 5)]
    odd = near_dup.near_duplicates(docs(spark, ["a b c d e f", "a b c d e f"], [None, 4])).collect()
    assert sorted((str(r["component_id"]), r["kept"]) for r in odd) == [("4", True), ("None", True)]
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_regions_are_whole_where_small():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 3, (200, 3)).astype(np.uint32)
    v = v[np.lexsort(v.T[::-1])]
    roots, tree = rng.integers(0, 40, 200), np.zeros(200, int)
    pairs = lambda i, j: set(zip(i.tolist(), j.tolist(), strict=True))
    i, j, starts, ends = near_dup.region_pairs(v, tree, roots, 1000)
    assert pairs(i, j) == {(a, b) for a in range(200) for b in range(a + 1, 200) if v[a, 0] == v[b, 0] and roots[a] != roots[b]}
    assert [tuple(set(v[a:b, 0].tolist())) for a, b in zip(starts, ends, strict=True)] == [(0,), (1,), (2,)]
    i, j, *_ = near_dup.region_pairs(v, tree, roots, 10)
    want = {(a, a + 1) for a in range(199) if v[a, 0] == v[a + 1, 0]} | {(a, b) for a in range(200) for b in range(a + 1, 200) if (v[a] == v[b]).all() and (v == v[a]).all(1).sum() <= 10}
    assert {(a, b) for a, b in want if roots[a] != roots[b]} <= pairs(i, j)
    assert all(x.size == 0 for x in near_dup.region_pairs(v[:0], tree[:0], roots[:0], 10))


def test_spanning_joins_all_that_pairs_join():
    u, v, alike = np.array([1, 2, 1, 5, 6, 2]), np.array([2, 3, 3, 6, 5, 1]), np.array([5, 9, 7, 1, 2, 9])
    assert near_dup.spanning(u, v, alike).tolist() == [1, 5, 4]


@pytest.mark.parametrize("edges_a_task", [1000, 7])
def test_components(spark, tmp_path, monkeypatch, edges_a_task):
    monkeypatch.setattr(near_dup, "LOCAL_EDGES", edges_a_task)
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(500, 500 + i) for i in range(30)] + [(9, 9), (160, 7)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = near_dup.components(spark.createDataFrame(pairs, "u bigint, v bigint"), f"file://{tmp_path}").collect()
    assert {r["id"]: r["root"] for r in got} == {x: find(x) for x in parent if find(x) != x}


def test_borders_between_ranges(spark, corpus, monkeypatch):
    monkeypatch.setattr(near_dup, "RANGE_ROWS", 300)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs(spark, corpus)).collect()}
    assert got == plain_components(corpus)


def test_large_regions_lose_nothing(spark, corpus, monkeypatch):
    """With tiny regions and orders of one value, links come from the exact last step."""
    for name, value in (("REGION", 2), ("DEPTH", 1), ("RANGE_ROWS", 100)):
        monkeypatch.setattr(near_dup, name, value)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs(spark, corpus)).collect()}
    assert got == plain_components(corpus)


@pytest.fixture(scope="module")
def passage_pairs():
    """A passage that all share, and pairs just above 0.75 linked only with each other, which mostly consist of it."""
    rng = random.Random(9)
    own = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    passage = own(204)
    out = [" ".join([*own(rng.randrange(70, 80)), *passage]) for _ in range(150)]
    for _ in range(40):
        shared = own(14)
        out += [" ".join([*own(35), *passage, *shared]) for _ in range(2)]
    return out


def test_split_regions_lose_nothing(spark, passage_pairs, monkeypatch):
    """Pairs that part within a region too large for all its pairs."""
    for name, value in (("TREES", 4), ("REGION", 8), ("SAFE_TREES", 4)):
        monkeypatch.setattr(near_dup, name, value)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs(spark, passage_pairs)).collect()}
    assert got == plain_components(passage_pairs)


def test_bpe(spark, corpus):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(4)
    texts = [*corpus, "a  b\n\n c", "it's 'stop' don't 'VE ''s", "é🙂​日本 １２३", "\x85\x1c x", "aaaa" * 50, "<|endoftext|>", *("".join(rng.choices("ab'ſslre \n\t12!é日🙂", k=40)) for _ in range(300))]
    df = docs(spark, texts)
    got = {r["doc_id"]: r for r in bpe.round_trip_digests(df, path).collect()}
    for i, t in enumerate(texts):
        ids = np.array(reference.encode_ordinary(t or ""), "<u4")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()), t
    full = bpe.encode(df, path, offsets=True)
    for r in full.collect():
        t = texts[r["doc_id"]] or ""
        assert all(0 <= a < b <= len(t) for a, b in zip(r["starts"], r["ends"], strict=True)) and (not t or r["starts"][0] == 0 and r["ends"][-1] == len(t))
    back = {r["doc_id"]: bytes(r["data"]).decode() for r in bpe.decode(full, path).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    decoder = bpe.decoder_of_ranks(path)
    ids = np.array(reference.encode_ordinary("é🙂日"))
    assert "".join(bpe.stream_text(decoder, ([i] for i in ids))) == "é🙂日"
    assert bpe.round_trip_digests(df.limit(0), path).count() == 0


def test_quality(spark):
    rng = random.Random(9)
    good = [" ".join(words(rng, 80)).capitalize() + "." for _ in range(300)]
    bad = [" ".join(w for x in words(rng, 4) for w in [x] * 30) for _ in range(150)]
    texts = [*good, *bad, None, "", "x" * 300_000]
    labels = clashing(spark.createDataFrame([(i, 1 if i < 300 else 0) for i in range(450)] + [(3, None), (None, 1), (4, 0)], "doc_id bigint, quality int"))
    df = docs(spark, texts)
    model = quality.fit(df, labels)
    rows = quality.score(df, model).collect()
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 450]
    assert sum(r["predicted"] == (r["doc_id"] < 300) for r in held) >= 0.95 * len(held)
    # Labels of held-out rows don't matter.
    other = quality.fit(df, labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert np.array_equal(model.leaf, other.leaf) and np.array_equal(model.threshold, other.threshold)
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r["predicted"] for r in rows)
    none = quality.fit(df, labels.limit(0))
    assert quality.score(df, none).first()["score"] == 0.5
    assert quality.score(df.limit(0), none).count() == 0


def test_trees_against_plain_versions():
    """Boosting, traversal and statistics, each against its plain form."""
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 6, 60), rng.normal(size=60).round(1)]).astype(float)
    y = (x[:, 0] + x[:, 1] + rng.normal(size=60) * 0.5 > 3).astype(float)
    model = quality.grow(x, y, trees=5, depth=2, bins=8, least=1.0)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, 9)[1:-1])) for c in x.T]
    base = np.log(y.mean() / (1 - y.mean()))
    total, ridge, rate = np.full(60, base), 2.0, 0.15

    def split(rows, p):
        """(gain, feature, edge) of the best split of some rows, by looking at each."""
        g, h = p[rows] - y[rows], p[rows] * (1 - p[rows])
        best = (1e-6, 0, np.inf)
        for f in range(2):
            for e in edges[f]:
                left = x[rows, f] <= e
                if h[left].sum() >= 1.0 and h[~left].sum() >= 1.0:
                    gain = g[left].sum() ** 2 / (h[left].sum() + ridge) + g[~left].sum() ** 2 / (h[~left].sum() + ridge) - g.sum() ** 2 / (h.sum() + ridge)
                    if gain > best[0] + 1e-12:
                        best = gain, f, e
        return best

    for _ in range(5):
        p = 1 / (1 + np.exp(-total))
        groups = [np.arange(60)]
        for _ in range(2):
            parts = []
            for rows in groups:
                _, f, e = split(rows, p) if len(rows) else (0, 0, np.inf)
                parts += [rows[x[rows, f] <= e], rows[x[rows, f] > e]]
            groups = parts
        step = np.zeros(60)
        for rows in groups:
            step[rows] = -rate * (p[rows] - y[rows]).sum() / ((p[rows] * (1 - p[rows])).sum() + ridge)
        total = total + step
    assert np.allclose(model(x), 1 / (1 + np.exp(-total)))
    for row, score in zip(x, model(x), strict=True):  # one tree after the other, node by node
        z = model.base
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + (row[feature[node]] > threshold[node])
            z += leaf[node - len(feature)]
        assert score == pytest.approx(1 / (1 + np.exp(-z)))


def test_statistics_against_plain_versions():
    texts = ["", None, "One two two TWO!! 12 é é\n\nline two", "a b c d e f a b c d e f a b c d e f", "HELLO WORLD hello", "x|y ## z", "same line.\nsame line.\nother", "word " * 40]
    got = quality.statistics(pa.array(texts))
    share = lambda k, n: k / max(n, 1)
    for row, text in zip(got, texts, strict=True):
        raw = (text or "").encode()
        w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        runs = lambda k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]  # noqa: B023, E731
        lines = [tuple(re.findall(rb"[^\x20\x09-\x0D]+", x)) for x in raw.split(b"\n")]
        lines = [x for x in lines if x]
        mean = share(sum(map(len, w)), len(w))
        want = {
            "log_bytes": np.log1p(len(raw)), "log_words": np.log1p(len(w)), "word_length": mean, "word_length_spread": np.sqrt(max(share(sum(len(x) ** 2 for x in w), len(w)) - mean**2, 0)), "longest_word": np.log1p(max(map(len, w), default=0)),
            "upper": share(sum(65 <= b <= 90 for b in raw), len(raw)), "digits": share(sum(48 <= b <= 57 for b in raw), len(raw)), "exclamation": share(raw.count(b"!"), len(raw)), "pipes": share(raw.count(b"|"), len(raw)), "wide": share(sum(b >= 128 for b in raw), len(raw)),
            "distinct_words": share(len(set(w)), len(w)), "top_word": share(max((w.count(x) for x in set(w)), default=0), len(w)), "same_as_previous": share(sum(a == b for a, b in zip(w, w[1:])), len(w)),
            "distinct_pairs": share(len(set(runs(2))), len(runs(2))) if runs(2) else 1.0, "distinct_fives": share(len(set(runs(5))), len(runs(5))) if runs(5) else 1.0, "short_words": share(sum(len(x) <= 3 for x in w), len(w)),
            "shouted_words": share(sum(sum(65 <= b <= 90 for b in x) >= max(2, 0.5 * len(x)) for x in w), len(w)), "repeated_lines": 1 - share(len(set(lines)), len(lines)) if lines else 0.0, "lines_ended": share(sum(x[-1][-1:] in b".!?" for x in lines), len(lines)), "sentence_ends": share(sum(x[-1:] in b".!?" for x in w), len(w)),
        }
        for name, value in want.items():
            assert row[quality.FEATURES.index(name)] == pytest.approx(value), (name, text)


def test_repeated_labelled_rows_are_learnt_once(spark):
    rows = [(i, "good words stand here now" if i % 2 else "bad bad bad bad") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    once = quality.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), labels)
    often = quality.fit(spark.createDataFrame(rows + [(1, rows[1][1])] * 500, "doc_id bigint, text string"), labels)
    assert np.array_equal(once.leaf, often.leaf)


def test_registered_queries(spark):
    """The columns of each registered query on the smallest tables."""
    from cleanloom.llm import queries

    sf = "/root/testdata/sf0.001"
    want = {
        "op1_threshold_topk": "query_id bigint, rank int, vec_id bigint, score bigint", "op2_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
        "op3_vector_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint", "op4_warc_index": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
        "op5_stratified_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int", "op6_lsh_forest": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
        "op7_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", "op8_quality_trees": "doc_id bigint, held_out boolean, score double, predicted int",
        "op9_license_scan": "doc_id bigint, licence string", "op10_temporal_url_list": "page_id bigint, blocked boolean",
    }
    for name, columns in want.items():
        df = queries.QUERIES[name](spark, sf)
        kinds = dict(df.dtypes)
        assert {k: kinds.get(k) for k in dict(c.split() for c in columns.split(", "))} == dict(c.split() for c in columns.split(", ")), name
        if name not in ("op1_threshold_topk", "op3_vector_packing"):
            key = columns.split()[0]
            table = {"doc_id": "documents", "page_id": "pages"}[key]
            assert sorted(r[0] for r in df.select(key).collect()) == sorted(r[0] for r in spark.read.parquet(f"{sf}/{table}.parquet").select(key).collect()), name


def test_license_scan(spark):
    texts = [None, "", "no notice here", "Text.\nLicensed under CC BY-NC 4.0.", "Released under the MIT License.\nmore", "All rights reserved.", "She renewed her driving licence at the city office last week.", "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "licence " * 20_000]
    got = {r["doc_id"]: r for r in licenses.scanned(docs(spark, texts)).collect()}
    assert [got[i]["licence"] for i in range(9)] == [None, None, None, "cc-by-nc", "mit", "all-rights-reserved", "unknown", got[7]["licence"], "gpl"]
    assert got[7]["families"] == "apache-2.0,mit" and got[7]["n_confirmed"] == 2 and got[9]["licence"] == "unknown"
    model = licenses.trained()
    for i, text in enumerate(texts):  # brute force
        best = []
        for line in (text or "").split("\n"):
            if re.search(licenses.anchor_pattern(), line):
                g, w = licenses.grams(licenses.words(line)), licenses.words(line)
                z = model.bias + sum((model.weights[k] for k, v in enumerate(model.vocabulary) if v in g), np.zeros(len(model.families)))
                p = np.exp((z - z.max()) / model.temperature)
                k = int(p.argmax())
                own = {" ".join(x) for x in zip(w, w[1:])} or {" ".join(w)}
                pairs = [{" ".join(x) for x in zip(licenses.words(t), licenses.words(t)[1:])} for t in licenses.TEMPLATES.get(model.families[k], ())]
                if model.families[k] != "unknown" and p[k] / p.sum() >= 0.5 and any(len(own & t) >= 0.6 * min(len(own), len(t)) for t in pairs):
                    best.append((-float(p[k] / p.sum()), model.families[k]))
        assert got[i]["n_confirmed"] == len(best)
        if best:
            assert got[i]["probability"] == pytest.approx(-min(best)[0])
    assert licenses.scanned(docs(spark, texts).limit(0)).count() == 0


def test_unseen_notices(spark):
    """Notices that stand neither among what the classifier learns nor among the templates, and texts that are none."""
    notices = {
        "Distributed under the MIT licence, with thanks.": "mit", "Code is available under an MIT-style license": "mit", "distributed under the terms of the GNU GPL version 2 or later": "gpl",
        "GNU AGPL v3": "agpl", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted": "isc", "licensed under the 3-clause BSD license": "bsd-3-clause",
        "BSD 2-Clause License, see below": "bsd-2-clause", "Eclipse Public License - v 2.0": "epl", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "Licensed under CC BY-SA 4.0.": "cc-by-sa", "Released under the LGPL version 3 by us": "lgpl", "He went to MIT": "unknown", "Er ging mit ihr ins Kino": None, "Licensed under the EUPL": "unknown", "The licence plate was stolen": "unknown", "No such thing here": None,
    }
    learnt = {" ".join(licenses.words(c.format(n))) for own in licenses.NAMES.values() for n in own for c in licenses.CARRIERS} | {" ".join(licenses.words(t)) for own in licenses.NOTICES.values() for t in own}
    assert not learnt & {" ".join(licenses.words(t)) for t in notices}
    got = {r["doc_id"]: r["licence"] for r in licenses.scanned(docs(spark, list(notices))).collect()}
    assert [got[i] for i in range(len(notices))] == list(notices.values())
    assert all(re.search(licenses.anchor_pattern(), t) for own in licenses.TEMPLATES.values() for t in own)


def test_wrapped_notices(spark):
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one."
    mit = "Permission is hereby granted, free\nof charge, to any person\nobtaining a copy of this\nsoftware and associated\ndocumentation files, to deal\nin the software without restriction."
    got = {r["doc_id"]: r["licence"] for r in licenses.scanned(docs(spark, [mpl, f"Some prose.\n\n{mit}\n\nMore."])).collect()}
    assert got == {0: "mpl-2.0", 1: "mit"}


def test_packing_keeps_empty_documents():
    packer = packing.Packer(2048, 4096, 2048, 0)
    for k in range(3000):
        packer.add(k, np.array([1], np.uint32), 0, 0)
    packer.finish()
    assert sorted(r[0] for r in packer.flush()) == list(range(3000))


@pytest.mark.parametrize("sizes,limits,binding", [([700] * 300, (2048, 64, 1000), "loss"), ([4] * 3000 + [40] * 50, (2048, 16, 2048), "segments"), ([500, 900, 5000, 30_000] * 20, (2048, 64, 1792), "tokens")])
def test_each_limit_binds(sizes, limits, binding):
    """Sequences that one limit closes, while all hold all three; ids come back whole."""
    packer = packing.Packer(*limits, 0, waiting=64)
    ids = [np.arange(n, dtype=np.uint32) for n in sizes]
    for k, x in enumerate(ids):
        packer.add(k, x, len(x) // 4, len(x) - 1)
    packer.finish()
    sequences, pieces = {}, {}
    for key, start, n, crc, total, loss, sequence, offset in packer.flush():
        assert crc == zlib.crc32(ids[key][start : start + n].tobytes()) and total == sizes[key]
        assert loss == max(0, min(start + n, total - 1) - max(start, total // 4))
        sequences.setdefault(sequence, []).append((offset, n, loss))
        pieces.setdefault(key, []).append((start, n))
    for k, own in pieces.items():
        assert sum(n for _, n in own) == sizes[k] and [s for s, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))]
    filled = []
    for own in sequences.values():
        tokens, loss = sum(n for _, n, _ in own), sum(x for *_, x in own)
        assert tokens <= limits[0] and len(own) <= limits[1] and loss <= limits[2]
        assert tokens == limits[0] or tokens & (tokens - 1) == 0
        filled.append({"tokens": tokens == limits[0], "segments": len(own) == limits[1], "loss": loss == limits[2]})
    assert sum(f[binding] for f in filled) >= 10


def test_long_texts_in_parts(json_path, monkeypatch):
    """Parts give what the whole gives."""
    from tokenizers import Tokenizer

    rng = random.Random(12)
    text = "".join(rng.choice([" ", "  ", "\n", " a", "b ", "don't ", "é", "日本 ", "12 3", "'s x", " "]) for _ in range(3000))
    encoder = bpe.Encoder(Tokenizer.from_file(json_path), offsets=True)
    whole = [x.tolist() for x in encoder(pa.array([text]))]
    shingles_ = near_dup.shingle_sets(pa.array([text]))[0].tolist()
    monkeypatch.setattr(bpe.sh, "LONG_BYTES", 64)
    assert [x.tolist() for x in encoder(pa.array([text]))] == whole
    assert near_dup.shingle_sets(pa.array([text]))[0].tolist() == shingles_
    giant = "x" * 500
    assert len(near_dup.shingle_sets(pa.array([giant]))[0]) == 1 and encoder(pa.array([giant]))[1].tolist() == [len(Tokenizer.from_file(json_path).encode(giant, add_special_tokens=False).ids)]


def test_half_of_the_words_is_forgotten(json_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "CACHE_WORDS", 40)
    encoder = bpe.Encoder(Tokenizer.from_file(json_path), offsets=True)
    plain = Tokenizer.from_file(json_path)
    rng = random.Random(8)
    for _ in range(30):
        texts = [" ".join(words(rng, rng.randrange(12), 60)) for _ in range(4)]
        ids, counts, starts, ends = encoder(pa.array(texts))
        want = [plain.encode(t, add_special_tokens=False) for t in texts]
        assert counts.tolist() == [len(w.ids) for w in want] and ids.tolist() == [i for w in want for i in w.ids]
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [o for w in want for o in w.offsets]
    assert 0 < len(encoder.known) <= 100


def test_url_filter(spark):
    pages = clashing(spark.createDataFrame([(1, "http://ads.example.com/x", "2024-02-01"), (2, "http://ads.example.com/x", "2024-04-01"), (3, "https://a.ads.example.com/", "2024-02-01"), (4, "http://u:p@EXAMPLE.com:80/ok/1", "2024-02-01"), (5, None, "2024-02-01"), (6, "nothing", "2024-02-01"), (7, "http://example.com/ok", None), (8, "http://notexample.com/", "2024-02-01"), (9, "http://example.com/ok", "2025-02-01"), (1, "http://ads.example.com/x", "2024-02-01")], "page_id bigint, url string, fetched string").withColumn("fetched", F.to_date("fetched")))
    entries = clashing(spark.createDataFrame([("ads.example.com", "2024-01-01", "block"), ("ads.example.com", "2024-03-01", "remove"), ("example.com", "2024-01-15", "block"), ("example.com/ok", "2024-01-20", "allow"), ("example.com/ok", "2024-12-20", None), ("example.com", "2024-03-15", "allow"), ("example.com", "2024-03-15", "remove"), (None, "2024-01-01", "block"), ("x", None, "block")], "pattern string, since string, action string").withColumn("since", F.to_date("since")))
    got = sorted(((r["page_id"], r["action"], r["pattern"], r["blocked"]) for r in url_filter.evaluated(pages, entries).collect()), key=str)
    assert got == sorted([(1, "block", "ads.example.com", True), (1, "block", "ads.example.com", True), (2, "allow", "example.com", False), (3, "block", "ads.example.com", True), (4, "allow", "example.com/ok", False), (5, None, None, False), (6, None, None, False), (7, None, None, False), (8, None, None, False), (9, "allow", "example.com", False)], key=str)
    assert url_filter.evaluated(pages.limit(0), entries).count() == 0
    assert url_filter.evaluated(pages, entries.limit(0)).where("blocked").count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    good = corpus_pipeline.quality_stage(spark, docs_, sf)
    exact = corpus_pipeline.exact_stage(spark, good, sf)
    near = corpus_pipeline.near_stage(spark, exact, sf)
    assert good.columns == exact.columns == near.columns == docs_.columns
    texts = {r["doc_id"]: r["text"] for r in good.select("doc_id", "text").collect()}
    last = {}
    for i, t in texts.items():
        last[t.translate(UPPER)] = max(i, last.get(t.translate(UPPER), i))
    assert sorted(r["doc_id"] for r in exact.select("doc_id").collect()) == sorted(last.values())
    left = sorted(last.values())
    groups = plain_components([texts[i] for i in left])
    want = sorted({left[root] for _, root in groups.values()})
    assert sorted(r["doc_id"] for r in near.select("doc_id").collect()) == want
    packed = corpus_pipeline.run(spark, sf)
    assert sorted(r["doc_id"] for r in packed.select("doc_id").distinct().collect()) == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_trees", "exact_dedup", "lsh_forest", "vector_packing"]


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls, empty, long and repeated rows, clashing names, empty tables."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    odd = docs(spark, [None, "", "same text of six words here", "same text of six words here", "Same TEXT of six words here", "x" * 100_000, None], [1, 2, 3, 3, 4, 5, None])
    ids = lambda df: sorted(str(r["doc_id"]) for r in df.collect())
    assert ids(corpus_pipeline.exact_stage(spark, odd, sf)) == ["2", "4", "5"]
    assert ids(corpus_pipeline.near_stage(spark, odd, sf)) == ["1", "2", "3", "3", "5", "None"]
    assert set(ids(corpus_pipeline.packing_stage(spark, odd, sf))) == {"1", "2", "3", "4", "5", "None"}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, sf).columns == odd.columns
    assert all(stage(spark, odd.limit(0), sf).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_nothing_outside_imports_this():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    for p in (root / "cleanloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
