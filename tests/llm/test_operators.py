"""The operators on awkward rows and on small tables, against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from umbral.llm import components, edits, jaccard, langid, licenses, lm, media, mixing, pieces, queries, sharding, topk

SF = "/root/testdata/sf0.001"
WORDS = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, n string, key string"


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeats, ties, columns with names the operators use inside."""
    base = " ".join(f"w{i}" for i in range(100))
    texts = [None, "", " \n\t ", "one", "One  two", "a b c d e", "A B C D E", base, base, base + " x", base.replace("w50 ", ""), "É é ñ ▁ \x00 🙂\n\n  z", "x" * 5000, "word " * 30000, "released under the MIT License. Apache License, Version 2 (cc by-nc)", "12 34 !!"]
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "s1", "s2"][i % 3], None, None, "7", "", None) for i, t in enumerate(texts)]
    rows += [rows[7], (None, "no id", "en", "s1", 1, "x", None, None, None), (None, base, None, None, 1, "x", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def both(odd, docs):
    return [odd.collect(), docs.collect()], [odd, docs]


def shingles(t):
    w = WORDS.findall(lower(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(rows):
    sets = [shingles(r["text"]) for r in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                up[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[top(i)] = min(least.get(top(i), 1 << 60), r["doc_id"])
    return Counter((r["doc_id"], len(sets[i]), least.get(top(i)) if sets[i] else r["doc_id"]) for i, r in enumerate(rows))


def test_top_k(spark):
    rng = np.random.default_rng(1)
    vecs = [(i, [float(x) for x in rng.normal(size=9).round(3)]) for i in range(120)] + [(200, None), (201, [1.0, None] + [0.0] * 7), (202, [float("nan")] * 9), (203, [float("inf")] * 9), (204, [1.0]), (205, []), (None, [0.5] * 9), (5, [0.0] * 9)] + [(300 + i, [1.0] * 9) for i in range(30)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in vecs if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    first = {}
    for i, v in sorted(good):
        first.setdefault(i, v)
    for q, v in first.items():
        if q % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))[:7]
            want |= {(q, r + 1, i, -x) for r, (x, i) in enumerate(s)}
    for wave in (16 << 20, 300):
        got = topk.exact_top_k(df, F.col("vec_id") % 20 == 0, k=7, segments=(2, 4), wave_bytes=wave, rows=32, block=3).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("n, parts", [(6, 1), (10, 3), (90, 30)])
def test_top_k_in_few_rows(spark, n, parts):
    rng = np.random.default_rng(n)
    vecs = [(i, [float(x) for x in rng.integers(-4, 5, 9 if i % 5 else 7)]) for i in range(n)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>").repartition(parts)
    want = set()
    for q, v in vecs:
        s = sorted((-sum(int(1024 * a) * int(1024 * b) for a, b in zip(v, w, strict=True)), i) for i, w in vecs if i != q and len(w) == len(v))[:10]
        want |= {(q, r + 1, i, -x) for r, (x, i) in enumerate(s)}
    got = topk.exact_top_k(df, F.lit(True), segments=(2, 4)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_top_k_scores_are_exact(spark):
    rows = [(1, [100000.0, 1.0, 0.5]), (2, [100000.0, 1.0, 0.25]), (3, [2.0**25, -3.0, 1.0]), (4, [-7.0, 2.0**20 + 0.5, 0.0]), (5, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    want = {(q, r + 1, i, -x) for q, v in whole.items() for r, (x, i) in enumerate(sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole.items() if i != q))}
    for parts in (1, 5):
        assert {tuple(r) for r in topk.exact_top_k(df.repartition(parts), F.lit(True)).collect()} == want
    with pytest.raises(Exception, match="doesn't fit a long"):
        topk.exact_top_k(spark.createDataFrame([(1, [1e30]), (2, [1e30])], "vec_id long, embedding array<double>"), F.lit(True)).collect()


@pytest.mark.parametrize("few", [1 << 18, 20, 0])
def test_components(spark, few):
    rng = np.random.default_rng(few + 1)
    links = [(i, i + 1) for i in range(100, 140)] + [(200, 200 + i) for i in range(1, 60)] + [(int(a), int(b)) for a, b in rng.integers(300, 400, (60, 2))] + [(7, 7), (8, 9), (9, 8)]
    up = {}

    def top(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in links:
        if a != b:
            up[top(a)] = top(b)
    got = components.components(spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in links], "u string, v string").repartition(6), few=few).collect()
    assert len(got) == len(up) and {r["node"] for r in got} == {f"n{i}" for i in up}
    of = {r["node"]: r["label"] for r in got}
    assert {(top(i), of[f"n{i}"]) for i in up} == {(t, of[f"n{t}"]) for t in {top(i) for i in up}} and len(set(of.values())) == len({top(i) for i in up})
    assert components.components(spark.createDataFrame([], "u long, v long"), few=few).count() == 0


@pytest.mark.parametrize("wide", [32, 2])
def test_jaccard(odd, docs, wide):
    for rows, df in zip(*both(odd, docs), strict=True):
        got = jaccard.ngram_jaccard_join(df, wide=wide, block_entries=3000).select("doc_id", "n_shingles", "component_id").collect()
        assert Counter(map(tuple, got)) == groups(rows)
    assert jaccard.ngram_jaccard_join(docs.limit(0)).count() == 0


def test_packed_columns():
    x = np.array([0, 1, 2**48 - 1, 2**48, 2**64 - 1, 0x123456789ABCDEF0], np.uint64)
    assert jaccard.unpacked(jaccard.packed(x)).tolist() == [int(v) % 2**48 for v in x.tolist()]
    assert len(jaccard.unpacked(jaccard.packed(x[:0]))) == 0


def test_jaccard_large_groups(spark):
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):  # near copies of one text, each with its own change
        w = list(base)
        w[(7 * i) % 120] = f"u{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base[:30] + [f"q{i}_{j}" for j in range(200)])) for i in range(60)]  # a shared passage
    rows += [(2000 + i, rows[0][1]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.ngram_jaccard_join(df, wide=8).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == groups([{"doc_id": a, "text": b} for a, b in rows])


def test_overlaps_bound():
    draw = np.random.default_rng(3)
    pick = lambda n: draw.integers(0, 2**63, n, dtype=np.uint64)
    pairs = []
    for n in (1, 3, 500, 513, 700, 2100, 9000, 40_000):
        for share in (0.0, 0.5, 0.9, 1.0):
            both = pick(int(n * share))
            pairs.append(tuple(np.unique(np.concatenate([both, pick(m - len(both))])) for m in (n, n + n // 5)))
    most, full = jaccard.overlaps([jaccard.tally(x) for x, _ in pairs], [jaccard.tally(y) for _, y in pairs])
    assert not full.any() and all(m >= len(np.intersect1d(x, y)) for m, (x, y) in zip(most.tolist(), pairs, strict=True))
    crowd = np.arange(300, dtype=np.uint64)  # all in one part
    assert jaccard.overlaps([jaccard.tally(crowd)], [jaccard.tally(crowd)])[1].all()
    assert jaccard.overlaps([], [])[0].tolist() == []


def test_few_whole_sets_move():
    # long texts with half of their words in common are told apart by counts
    text = " ".join(f"w{i}" for i in range(9000))
    rows = pa.RecordBatch.from_pydict({"id": [0, 1, 2], "text": [text, text.replace("w4", "v4").replace("w5", "v5").replace("w6", "v6"), text.replace("w8999", "v")]})
    (sets,) = jaccard._sets(5)([rows])
    c, n = sets.column("counts").to_pylist(), [len(g) for g in sets.column("grams").to_pylist()]
    near = {"a1": [0, 0], "a2": [0, 0], "b1": [1, 2], "b2": [0, 0], "x": [c[0], c[0]], "y": [c[1], c[2]], "nx": [n[0], n[0]], "ny": [n[1], n[2]]}
    (out,) = jaccard._within_reach(4, 5)([pa.RecordBatch.from_pydict(near)])
    assert out.column("b1").to_pylist() == [2]


def test_blocks_are_small():
    class frequent:
        value = np.zeros(jaccard.TABLE, np.uint8)

    draw = random.Random(4)
    texts = [" ".join(draw.choice("abcdefgh") + str(draw.randrange(10**6)) for _ in range(104)) for _ in range(1000)]
    rows = pa.RecordBatch.from_pydict({"id": list(range(1000)), "text": texts})
    (out,) = jaccard._blocks(5, 4, 5, 24, frequent)([rows])
    size = sum(len(pa.compress(b"".join(out.column(i).to_pylist()), "lz4", asbytes=True)) for i in range(1, out.num_columns))
    assert size < 10 * 21 * 1000  # 10 bytes an entry, 21 of each text


def test_licenses(odd, docs):
    split = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for rows, df in zip(*both(odd, docs), strict=True):
        want = Counter()
        for r in rows:
            w = split.findall(lower(r["text"]))
            at = [(i, k) for k, p in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
            want[(r["doc_id"], len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({k for _, k in at})))] += 1
        got = licenses.license_scan(df)[0].collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
        for r in got:
            assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
    notice = docs.sparkSession.createDataFrame([(1, "x Permission is hereby granted, free of charge, to any person obtaining one copy of this software and associated documentation files y")], "doc_id long, text string")
    assert licenses.license_scan(notice)[0].first()["labels"] == "mit-notice"


@pytest.mark.parametrize("head", [1 << 20, 50])
def test_lm(odd, docs, head):
    for rows, df in zip(*both(odd, docs), strict=True):
        out = lambda r: zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 7 == 2
        toks = [[*WORDS.findall(lower(r["text"])), None] for r in rows]
        c = Counter(t for r, ts in zip(rows, toks, strict=True) if not out(r) for t in ts)
        n, v = sum(c.values()), len(c)
        want = sorted((str(r["doc_id"]), out(r), len(ts), sum(c[t] > 0 for t in ts), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), 4)) for r, ts in zip(rows, toks, strict=True))
        got = lm.bloom_lm_score(df, queries._mod(7) == 2, head=head, block_bytes=20_000).collect()
        assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
        assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in got)
    seen = [r["score"] / r["n_tokens"] for r in got if not r["held_out"]]
    new = [r["score"] / r["n_tokens"] for r in got if r["held_out"]]
    assert np.mean(seen) > np.mean(new) > np.mean([r["base_score"] / r["n_tokens"] for r in got]) - 1
    assert lm.bloom_lm_score(docs.limit(0), queries._mod(7) == 2).count() == 0


def modelled(rows, held, least):
    """Scores by the model with counts at their levels, without a filter's false probes."""
    toks = [[None, *WORDS.findall(lower(t)), None] for _, t in rows]
    train = [ts for (i, _), ts in zip(rows, toks, strict=True) if not held(i)]
    one = Counter(t for ts in train for t in ts[1:])
    two = Counter(p for ts in train for p in zip(ts, ts[1:], strict=False))
    total = sum(one.values()) + len(one) + 1.0
    at = lambda c: float(lm.count_of(np.array([c.bit_length()]))[0])
    out = {}
    for (i, _), ts in zip(rows, toks, strict=True):
        out[i] = 0.0
        for a, b in zip(ts, ts[1:], strict=False):
            x, n = at(one[a]), at(one[b])
            p = (n + 1) / total
            if x:
                p = 0.4 * p + 0.6 * min(at(two[a, b]) if two[a, b] >= least else 0.0, x) / x
            out[i] += math.log10(min(p, 1.0))
    return out


@pytest.fixture(scope="module")
def short_words(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(np.base_repr(x, 36) for x in rng.integers(36, 36**3, 60))) for i in range(400)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_lm_filter_grows_with_its_entries(short_words):
    rows, df = short_words
    want = modelled(rows, lambda i: i % 7 == 2, 2)
    got = {r["doc_id"]: r["score"] for r in lm.bloom_lm_score(df, F.col("doc_id") % 7 == 2, least=2, block_bytes=2000).collect()}
    assert got.keys() == want.keys()
    assert np.mean([abs(got[i] - want[i]) / 61 for i in want]) < 0.05


def test_lm_keeps_bigrams_seen_once(short_words):
    rows, df = short_words
    want = modelled(rows, lambda i: i % 7 == 2, 1)
    got = {r["doc_id"]: r["score"] for r in lm.bloom_lm_score(df, F.col("doc_id") % 7 == 2, block_bytes=2000).collect()}
    assert got.keys() == want.keys()
    assert np.mean([abs(got[i] - want[i]) / 61 for i in want]) < 0.05


def test_filter_keeps_counts():
    h = np.arange(1, 2000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    level = np.arange(1, 2000) % 9 + 1
    blocks, region = 4, 1 << 17
    data = np.zeros(blocks * region // 8, np.uint8)
    for k in range(1, 10):
        for at in lm.bits(h[level >= k], k, 2, blocks, region):
            np.bitwise_or.at(data, at >> 3, (1 << (at & 7)).astype(np.uint8))
    got = lm.Filter(data, blocks, region).levels(h, 2)
    assert (got >= level).all() and (got == level).mean() > 0.98


def test_mixing(odd, docs):
    for rows, df in zip(*both(odd, docs), strict=True):
        got = mixing.mix_sources(df)[0].collect()
        again = mixing.mix_sources(df.repartition(5))[0].collect()
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
        size = Counter()
        for r in rows:
            size[r["source"]] += len(WORDS.findall(r["text"] or ""))
        total = 1.5 * sum(size.values())
        names = sorted(size, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        target, free, left = {}, list(names), total
        while True:
            over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * size[s] + 1e-9]
            if not over:
                target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
                break
            for s in over:
                target[s] = 2.0 * size[s]
                free.remove(s)
                left -= target[s]
        taken = Counter()
        for r in got:
            assert r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-3 and 0 <= r["taken"] <= 2 * r["size"]
            taken[r["source"]] += r["taken"]
        for s in names:
            assert abs(taken[s] - target[s]) <= 0.05 * target[s] + 64 * 8
    assert mixing.mix_sources(docs.limit(0))[0].count() == 0


def test_sharding(odd, docs, spark):
    many = spark.createDataFrame([(i, "same" if i < 700 else f"t{i // 3}") for i in range(2000)], "doc_id long, text string")
    for df in (odd, docs, many):
        rows, got = df.collect(), sharding.balanced_shards(df).collect()
        assert Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows) == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
        by = defaultdict(list)
        for r in got:
            by[r["shard"]].append(r["slot"])
        counts = [len(by[s]) for s in range(16)]
        assert max(counts) - min(counts) <= 1 and all(sorted(x) == list(range(len(x))) for x in by.values())
    where = defaultdict(set)
    for r in got:
        where[r["text_crc32"]].add(r["shard"])
    small = [s for c, s in where.items() if c != zlib.crc32(b"same")]
    assert sum(len(s) > 1 for s in small) <= 0.05 * len(small)
    assert len(where[zlib.crc32(b"same")]) < 16
    assert sharding.balanced_shards(docs.limit(0)).count() == 0


def test_media(odd, docs, spark):
    for rows, df in zip(*both(odd, docs), strict=True):
        stored, folder = media.store_media(df)
        got = media.media_features(stored, folder).collect()
        want = Counter()
        for r in rows:
            raw = (r["text"] or "").encode()
            pay = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
            want[(r["doc_id"], len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))] += 1
            assert media.decode(media.encode(pay)) == pay
        assert Counter((r["id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
        meta = media.media_metadata(stored, folder).collect()
        assert all(r["width"] == 192 and r["bit_depth"] == 8 for r in meta)
    one = got[0]
    with media.open_shard(folder, one["shard"]) as tar:
        assert f"{one['digest']}.png" in tar.getnames()
    assert media.store_media(docs.limit(0))[0].count() == 0


def test_media_query_has_header_columns(spark, docs):
    got = queries.op7_media_columns(spark, SF).collect()
    size = Counter((r["doc_id"], len((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["n_bytes"]) for r in got) == size
    assert all((r["width"], r["height"], r["bit_depth"]) == (192, max(1, -(-r["n_bytes"] // 192)), 8) and r["feature"] for r in got)


def test_pieces(odd, docs):
    for rows, df in zip(*both(odd, docs), strict=True):
        a = pieces.sentencepiece_encode(df, queries.PIECE_MODEL, seed=3, proof=True)
        got = a.collect()
        assert sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in rows) == sorted(r["text_sha256"] for r in got)
        key = lambda r: (str(r["doc_id"]), r["ids"])
        again = pieces.sentencepiece_encode(df.repartition(7), queries.PIECE_MODEL, seed=3, chars=5000).collect()
        assert sorted(map(key, got)) == sorted(map(key, again))
        back = pieces.sentencepiece_decode(a.withColumn("Text", F.lit(0)), queries.PIECE_MODEL).select("doc_id", "text").collect()
        assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((r["doc_id"], r["text"] or "") for r in rows)
    assert pieces.sentencepiece_encode(docs, queries.PIECE_MODEL, seed=4).select("ids").collect() != pieces.sentencepiece_encode(docs, queries.PIECE_MODEL, seed=3).select("ids").collect()


def test_sampling_follows_weights():
    v = pieces.Vocabulary(queries.PIECE_MODEL)
    text, n = "the", 20_000
    codes, by_row = pieces.code_points([text] * n)
    ids, cuts = pieces.sample(codes, by_row, np.arange(n, dtype=np.uint64), v, 1)
    got = Counter(tuple(ids[cuts[i] : cuts[i + 1]].tolist()) for i in range(n))
    names = {v.raw[i].decode(): i for i in v.ids.tolist() if v.raw[i].decode(errors="replace").strip() or v.raw[i] == b" "}

    def ways(s):
        return [[]] if not s else [[names[s[:k]], *rest] for k in range(1, len(s) + 1) if s[:k] in names for rest in ways(s[k:])]

    weight = {tuple(w): math.exp(sum(v.weight[i] for i in w)) for w in ways(" the")}
    total = sum(weight.values())
    assert set(got) <= set(weight)
    for w, x in weight.items():
        assert abs(got[w] / n - x / total) < 5 * math.sqrt(x / total / n) + 2e-3


def test_language(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = queries._mod(3) == 1
    model = langid.train(docs.where(~fold))
    got = langid.predict(docs.where(fold), model).collect()
    named = [r for r in got if langid.has_letter(r["text"])]
    assert np.mean([r["lang"] == r["lang_pred"] for r in named]) > 0.97
    for r in langid.predict(odd, model).collect():
        assert 0 <= r["score"] <= 1 and (r["lang_pred"] == "und") == (not any(ch.isalpha() for ch in r["text"] or ""))
    nothing = langid.train(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(odd, nothing).collect()} == {"und"}


def test_language_sample_is_bounded(spark):
    rows = [(None if i % 2 else 5, f"words number {i % 50} here", "en" if i % 10 else "fr") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    fit, langid.ftrl = langid.ftrl, lambda r, y, n, fit=langid.ftrl: (seen.append(len(r)), fit(r, y, n))[1]
    try:
        langid.train(df, per_language=100)
    finally:
        langid.ftrl = fit
    assert 0 < seen[0] <= 160  # of 200 at most, every fifth goes to the temperature
    with pytest.raises(ValueError, match="more than 1"):
        langid.train(df, languages=1)


def test_language_replaces_columns_of_its_names(spark, odd):
    model = langid.train(spark.createDataFrame([(1, "one two", "en"), (2, "un deux", "fr")], "doc_id long, text string, lang string"))
    named = odd.withColumn("Score", F.lit("x")).withColumn("lang_pred", F.lit(3))
    got = langid.predict(named, model)
    assert [c for c in got.columns if c.lower() in ("score", "lang_pred")] == ["lang_pred", "score"] and got.select("score").count() == odd.count()


def test_ftrl_against_plain_python():
    rng = np.random.default_rng(11)
    rows = [(np.sort(rng.choice(40, 6, replace=False)), rng.random(6)) for _ in range(60)]
    labels, rate, beta, l1, l2 = rng.integers(0, 3, 60), 1.0, 1.0, 0.05, 1e-3
    got, bias = langid.ftrl(rows, labels, 3, rate, beta, l1, l2, epochs=2)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, c):
        return 0.0 if abs(z[i, c]) <= l1 else (math.copysign(l1, z[i, c]) - z[i, c]) / ((beta + math.sqrt(n[i, c])) / rate + l2)

    order = np.random.default_rng(7)
    for _ in range(2):
        for r in order.permutation(60).tolist():
            feats = [*zip(rows[r][0].tolist(), rows[r][1].tolist(), strict=True), (langid.SIZE, 1.0)]
            logit = [sum(weight(i, c) * x for i, x in feats) for c in range(3)]
            total = sum(math.exp(v) for v in logit)
            now = {(i, c): weight(i, c) for i, _ in feats for c in range(3)}
            for i, x in feats:
                for c in range(3):
                    g = (math.exp(logit[c]) / total - (labels[r] == c)) * x
                    sigma = (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) / rate
                    z[i, c] += g - sigma * now[i, c]
                    n[i, c] += g * g
    assert np.allclose([[weight(i, c) for c in range(3)] for i in range(40)], got[:40], atol=1e-5) and np.allclose([weight(langid.SIZE, c) for c in range(3)], bias, atol=1e-5)
    assert not got[40:].any() and (got[:40] == 0).any()


def test_temperature_has_the_least_loss():
    rng = np.random.default_rng(12)
    logits, labels = rng.normal(size=(300, 4)) * 5, rng.integers(0, 4, 300)
    loss = lambda t: -sum((z[y] - max(z)) / t - math.log(sum(math.exp((v - max(z)) / t) for v in z)) for z, y in zip(logits.tolist(), labels.tolist(), strict=True))
    assert loss(langid.fit_temperature(logits, labels)) <= min(loss(2.0 ** (k / 8)) for k in range(-48, 33)) + 1e-9


def test_edit_counts(odd, docs):
    ranks = edits.load_ranks(queries.BPE_RANKS)
    counter = edits.Counter(ranks)
    for rows, df in zip(*both(odd, docs), strict=True):
        got = edits.edit_aware_counts(df, queries.planned_edits(), queries.BPE_RANKS).collect()
        encode = counter.encoding.encode_ordinary
        assert Counter((r["doc_id"], len(encode(r["text"] or ""))) for r in rows) == Counter((r["doc_id"], r["n_tokens"]) for r in got)
    rng = np.random.default_rng(5)
    alphabet = list("ab  \n'st1.,é ")
    for _ in range(300):
        doc = edits.Document("".join(rng.choice(alphabet, rng.integers(0, 400))), counter)
        for _ in range(6):
            doc.edit(int(rng.integers(0, 420)), int(rng.integers(0, 30)), "".join(rng.choice(alphabet, rng.integers(0, 12))))
            assert doc.tree.tokens == len(encode(doc.text)) and doc.tree.chars == len(doc.text) and doc.tree.pieces == len(counter.split.findall(doc.text))


def test_edits_beside_apostrophes():
    counter = edits.Counter(edits.load_ranks(queries.BPE_RANKS))
    encode = counter.encoding.encode_ordinary
    doc = edits.Document("we'r", counter)
    doc.edit(4, 0, "e")
    assert (doc.tree.pieces, doc.tree.tokens) == (2, len(encode("we're")))
    rng = np.random.default_rng(6)
    alphabet = list("'' revlmdst1.")
    for _ in range(500):
        doc = edits.Document("".join(rng.choice(alphabet, rng.integers(0, 200))), counter)
        for _ in range(8):
            doc.edit(int(rng.integers(0, 210)), int(rng.integers(0, 4)), "".join(rng.choice(alphabet, rng.integers(0, 4))))
            assert doc.tree.tokens == len(encode(doc.text)) and doc.tree.chars == len(doc.text) and doc.tree.pieces == len(counter.split.findall(doc.text))


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = pipeline.language_id(spark, docs, SF)
    assert kept.columns == pipeline.COLUMNS and kept.count() >= 0.9 * docs.count()
    rows = kept.collect()
    want = {c for _, _, c in groups(rows)}
    single = pipeline.near_duplicates(spark, kept, SF)
    assert {r["doc_id"] for r in single.collect()} == want and single.columns == pipeline.COLUMNS
    mixed = pipeline.mix(spark, single, SF)
    assert mixed.columns == pipeline.COLUMNS and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 2
    last = pipeline.sentencepiece(spark, mixed, SF).collect()
    assert Counter(r["text_sha256"] for r in last) == Counter(hashlib.sha256(r["text"].encode()).hexdigest() for r in mixed.collect())


def test_near_duplicates_by_row(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    long = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    rows = [
        (1, long[0]), (2, long[0] + " x"),  # linked
        (2, long[1]),  # repeats the id of a row that goes, unlinked
        (3, long[2]), (3, "another text that has id three too"), (3, ""),
        (None, long[3]), (None, long[3]), (None, long[3] + " y"),  # nameless copies
        (None, long[2] + " z"),  # a nameless copy of a named row
        (None, "a nameless text that links with none"), (4, None), (4, None),
    ]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.near_duplicates(spark, df, SF)
    assert got.columns == pipeline.COLUMNS
    seen = Counter((r["doc_id"], r["text"]) for r in got.collect())
    nameless = [k for k in seen if k[0] is None and k[1].startswith(long[3])]
    assert len(nameless) == 1 and seen.pop(nameless[0]) == 1
    assert seen == Counter([rows[0], rows[2], rows[3], rows[4], rows[5], rows[10], rows[11], rows[12]])
