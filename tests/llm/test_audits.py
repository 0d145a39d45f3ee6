"""Resampling, source divergence and SimHash against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

xxhash = pytest.importorskip("xxhash")
pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from tests.llm.test_corpus import corpus, empty, frame  # noqa: E402
from verdictlake.llm import divergence, resampling, simhash  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def resampled(rows, target, c):
    own = [(i, *grams(t, c.longest)) for i, t in rows]
    bucket = lambda g: zlib.crc32(g.encode()) % c.buckets
    s = Counter(bucket(g) for _, _, gs in own for g in gs)
    t = Counter(bucket(g) for x in target for g in grams(x, c.longest)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (t_all := sum(s.values()) + c.buckets) / ((s[b] + 1.0) * (sum(t.values()) + c.buckets)))) for b in range(c.buckets)]
    assert t_all >= c.buckets
    out = []
    for i, n, gs in own:
        weight = sum(gain[bucket(g)] for g in gs) // len(gs) if gs else 0
        h = int(hashlib.sha256(f"{c.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0))), n >= c.least_words])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0], r[1], r[2]))
    for place, r in enumerate(able[: c.percent * len(able) // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:4]) + (None if isinstance(r[4], bool) else r[4],) for r in out), key=str)


@pytest.mark.parametrize("longest, percent", [(1, 10), (3, 60)])
def test_resampling(spark, longest, percent):
    texts = [*corpus(), "Über-Straße 12x\x7fy", "don't STOP9"]
    ids = [*range(len(texts))]
    texts, ids = texts + [texts[3], texts[3], texts[4], texts[9]], ids + [3, 3, 900, None]
    config = resampling.ResampleConfig(longest=longest, percent=percent, buckets=97, least_words=5)
    target = [texts[0], texts[5], None, ""]
    got = resampling.resample(frame(spark, texts, ids), spark.createDataFrame([(x,) for x in target], "text string"), config)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == resampled(list(zip(ids, texts)), target, config)


def test_resampling_of_nothing(spark):
    assert resampling.resample(empty(spark), empty(spark)).count() == 0
    got = resampling.resample(frame(spark, [None, "", "word " * 5000]), empty(spark))
    assert sorted(tuple(r) for r in got.select("doc_id", "n_features").collect()) == [(0, 0), (1, 0), (2, 5000)]


def test_places_are_dense_over_partitions(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 3).alias("tie")).repartition(7)
    got = resampling.with_places(rows, [F.desc("tie"), F.asc("v")]).collect()
    want = sorted(((r.v, r.tie) for r in got), key=lambda x: (-x[1], x[0]))
    assert [(r.v, r.tie) for r in sorted(got, key=lambda r: r.place)] == want and sorted(r.place for r in got) == list(range(1, 1001))


def diverging(rows, c):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    seen, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = term.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        seen[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= c.least_documents]
        count = {s: {t: seen[lang, s][t] for t in kept} for s in sources}
        share = lambda of: {t: 1 + c.scale * (n + 1) // (sum(of.values()) + len(kept)) for t, n in of.items()}
        p = {s: share(count[s]) for s in sources}
        q = share({t: sum(count[s][t] for s in sources) for t in kept})
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if count[s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, c.ranks)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, n + 1) for n, (item, value) in enumerate(items[:most])]
    return sorted(out)


@pytest.mark.parametrize("tile", [{}, {"tile_terms": 7, "tile_sources": 2, "held_terms": 5, "cells": 20, "ranks": 3}])
def test_source_divergence(spark, tile):
    rng = random.Random(4)
    texts = corpus()
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "ü", "Z", "c", None]), t) for t in texts]
    rows += [("one", "alone", "same same"), ("none", "x", "12 34"), ("none", "y", None), ("two", "p", "k l m k"), ("two", "p", "k l m k"), ("two", "q", "K l"), ("two", "r", "")]
    df = spark.createDataFrame([(i, *r, "t", "n") for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string, n string").repartition(3)
    config = divergence.DivergenceConfig(**tile)
    got = divergence.source_divergence(df, config)
    assert sorted(tuple(r) for r in got.collect()) == diverging(rows, config)
    assert [c for c, _ in got.dtypes] == ["lang", "source", "part", "item", "value", "rank"] and dict(got.dtypes)["rank"] == "int"


def test_divergence_of_nothing(spark):
    nothing = empty(spark).selectExpr("text", "key as lang", "row as source")
    assert divergence.source_divergence(nothing).count() == 0


def test_shares_are_exact_beyond_64_bits():
    counts, totals = np.array([1, 9 * 10**14, 12345678912345]), np.array([9 * 10**15 // 10, 9 * 10**14, 987654321987654])
    assert list(divergence.shares(counts, totals, 10**9)) == [1 + 10**9 * int(c) // int(t) for c, t in zip(counts, totals)]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def lowest_reachable(prints, radius):
    """prints: (id, fingerprint) rows. The smallest id that each fingerprint reaches."""
    distinct = sorted(set(f for _, f in prints))
    label = {f: f for f in distinct}

    def top(f):
        while label[f] != f:
            f = label[f]
        return f

    for n, x in enumerate(distinct):
        for y in distinct[n + 1 :]:
            if (x ^ y).bit_count() <= radius:
                label[top(x)] = top(y)
    least = {}
    for i, f in prints:
        least[top(f)] = min(i, least.get(top(f), i))
    return {f: least[top(f)] for f in distinct}


def test_simhash(spark):
    texts = corpus()
    base = " ".join(f"w{k}" for k in range(3000))
    texts += [base.replace(f"w{k} ", f"v{k} ") for k in range(30)] + ["one TWO", "One two", "x " * 70_000]
    ids = list(range(len(texts)))
    texts, ids = texts + [texts[2], texts[2], texts[5], texts[6]], ids + [2, 2, 4, None]
    got = simhash.simhash_components(frame(spark, texts, ids)).collect()
    prints = [(i, plain_fingerprint(t)) for i, t in zip(ids, texts)]
    least = lowest_reachable([x for x in prints if x[0] is not None], 3)
    want = [(i, f"{f:016x}", least[f] if i is not None else None) for i, f in prints]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert len({f for _, f in prints}) > len(set(least.values()))  # some differ and are linked
    assert simhash.simhash_components(empty(spark)).count() == 0


@pytest.mark.parametrize("radius, bucket_rows, bucket_mean", [(3, 4096, 64), (3, 50, 1), (2, 30, 64), (1, 4096, 64), (5, 70, 64), (0, 64, 64)])
def test_near_links_join_what_brute_force_joins(spark, radius, bucket_rows, bucket_mean):
    rng = random.Random(radius)
    found = {0, (1 << 64) - 1}
    for _ in range(25):  # clusters of links in chains, and one dense group
        f = rng.getrandbits(64)
        for _ in range(12):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, radius + 1)))
            found.add(f)
    centre = rng.getrandbits(64)
    found |= {centre ^ 1 << a ^ 1 << b for a in range(20) for b in range(a)}
    found |= {rng.getrandbits(64) for _ in range(200)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in found]
    config = simhash.SimHashConfig(radius=radius, bucket_rows=bucket_rows, bucket_mean=bucket_mean, items=500)
    links = [(r.x % (1 << 64), r.y % (1 << 64)) for r in simhash.near_links(spark.createDataFrame(signed, "bits long").repartition(4), config).collect()]
    least = lowest_reachable([(f, f) for f in found], radius)
    label = {f: f for f in found}

    def top(f):
        while label[f] != f:
            f = label[f]
        return f

    for x, y in links:
        assert least[x] == least[y]
        label[max(top(x), top(y))] = min(top(x), top(y))
    assert {f: top(f) for f in found} == least
    assert len(links) <= len(found) * len(simhash.block_choices(len(found), config)) * (1 if bucket_rows > 1000 else 30)


def test_block_choices_lose_no_link():
    config = simhash.SimHashConfig()
    rng = random.Random(0)
    for n in (1, 10**8, 10**10, 10**12):
        masks = [int(m) for m in simhash.block_choices(n, config)]
        for _ in range(300):
            differing = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(not m & differing for m in masks)
