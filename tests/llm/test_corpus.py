"""Corpus operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import dataclasses
import hashlib
import random
import re
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from verdictlake.llm import byte_bpe, exact_dedup, language_id, lz_dedup, ngram_join, order_minhash, packing, sharding, suffix_dedup, toxicity  # noqa: E402
from verdictlake.llm.blocks import BlockConfig  # noqa: E402
from verdictlake.llm.queries import BYTE_BPE, PACKING  # noqa: E402

SMALL = BlockConfig(block_bytes=3000, screen_keys=500)
SCHEMA = "doc_id long, text string, block string, seq string, range string, hits string, key string, bucket string, row string, shard string"


def corpus(seed=0, n=60):
    """Texts with exact and near copies, shared passages, repeats inside, null, empty, spaces only, short and long ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "be", "ü", "Ko", "li", "ma", "x"]) for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(40))
    texts = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(n)]
    for k in range(0, n, 6):
        texts[k] += "\n" + passage + "  " + texts[(k + 7) % n][:200]
    texts += texts[:8] + [t + " end" for t in texts[8:16]] + [None, "", "   ", "a", "Aa bB", "the same words " * 60, "日本語" * 30, "z" * 20_000, passage + " " + passage]
    return texts


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "b", "s", "r", "h", "k", "u", "w", "d") for i, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return {r[0]: tuple(r)[1:] for r in df.select("doc_id", *columns).collect()}


def test_packing_is_exact_and_tight(spark):
    texts = corpus() + ["<|endoftext|>", "Kind<|startoftext|>of <|endoftext|><|ENDOFTEXT|> <|endoftext", "é<|endoftext|> \u0301x"]
    config = packing.PackingConfig(PACKING.tokenizer_path, capacity=64, group_pieces=40)
    got = packing.pack_documents(frame(spark, texts), config).toPandas()
    tokenizer = packing.Tokenizer.from_file(config.tokenizer_path)
    want = {}
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 64):
            part = ids[k : k + 64]
            want[i, k // 64] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    ranked = got.sort_values(["sequence_id", "offset"])
    assert (ranked.offset == ranked.groupby("sequence_id").length.cumsum() - ranked.length).all()
    assert got.groupby("sequence_id").length.sum().max() <= 64
    assert got.sequence_id.nunique() <= 1.1 * (got.length.sum() / 64) + 1
    assert packing.pack_documents(empty(spark), config).count() == 0


@pytest.mark.parametrize("cached", [4, 100_000])
def test_chunks_have_the_ids_of_the_library(cached):
    own = packing.ChunkTokenizer(dataclasses.replace(PACKING, cached=cached))
    rng = random.Random(4)
    pool = [chr(c) for c in range(0x20, 0x180)] + ["\t", "\n", "\x85", "\u2003", "\u0301", "\u4e16", "\u212a", "\U0001f600"] + 40 * [" "]
    pool += 4 * ["<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "</w>", "'s", "'LL", "Stop", "wor", "KD", "word,", "endoftext", "don't"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(400)] + ["", " ", "Word word WORD", "Stra\u00dfe \u00c9T\u00c9 \u0130I"]
    want = [np.array(x.ids, "<u4").tobytes() for x in own.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert own.encode(texts[:150]) + own.encode(texts[150:]) == want
    # plain texts don't go through the tokenizer's normaliser and pattern, and parts stand among the chunks
    plain = packing.ChunkTokenizer(PACKING)
    plain._ids = None
    assert plain.encode(["Some words, and Others!", "some OTHERS"]) == [np.array(x.ids, "<u4").tobytes() for x in own.tokenizer.encode_batch_fast(["some words, and others!", "some others"], add_special_tokens=False)]
    assert {"some", "words,", "words", ",", "others!", "others"} <= set(plain.chunks)


def test_packing_of_what_never_fits_together_ends(spark):
    pieces = spark.range(200).selectExpr("id as doc_id", "cast(0 as int) as piece", "0L as start", "40L as length", "0L as ids_crc32")
    got = packing.pack_pieces(pieces, packing.PackingConfig(PACKING.tokenizer_path, capacity=64, group_pieces=20))
    assert got.select("sequence_id").distinct().count() == 200


def test_local_search_empties_bins():
    lengths = [6, 4, 5, 5, 3, 3, 4]
    bins = packing.local_search([[0], [1, 4], [2], [3], [5, 6]], lengths, 10, 4)
    assert len(bins) == 3 and sorted(i for b in bins for i in b) == list(range(7))
    assert all(sum(lengths[i] for i in b) <= 10 for b in bins)


def test_exact_dedup(spark):
    texts = corpus()
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(frame(spark, texts), exact_dedup.FingerprintConfig(piece_bytes=64, huge_bytes=1000, compare_bytes=128)).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    for t, members in groups.items():
        for i in members:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(members), len(members), i == max(members))
            assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0
    kept = exact_dedup.drop_exact_duplicates(frame(spark, [*texts, None], [*range(len(texts)), None]))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ") and kept.count() >= len(groups)


def test_fingerprints_compose():
    x, y = b"abc" * 500, b"defgh" * 333
    assert exact_dedup.combine(exact_dedup.fingerprint(x), exact_dedup.fingerprint(y)) == exact_dedup.fingerprint(x + y)


def test_a_fingerprint_collision_is_told_apart(spark, monkeypatch):
    config = exact_dedup.FingerprintConfig(moduli=(3, 5), bases=(2, 3))
    got = rows_of(exact_dedup.exact_duplicates(frame(spark, [f"t{i % 40:02d}" for i in range(80)]), config), "keep_id", "group_size")
    assert got == {i: (40 + i % 40, 2) for i in range(80)}


def test_language_id(spark):
    rng = random.Random(0)
    parts = {"aa": ["kol", "wer", "ist", "ung"], "bb": ["tio", "née", "oux", "que"], "cc": ["zap", "iki", "ulu", "oho"]}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, text(lang, 60), lang) for i, lang in enumerate(list(parts) * 30)]
    model = language_id.fit_languages(spark.createDataFrame([*rows, (None, "x", "aa"), (900, None, "aa"), (901, "x", None)], "doc_id long, text string, lang string"))
    assert sorted(model.dictionaries) == sorted(parts)
    docs = [text(lang, n) for n in (12, 400) for lang in parts] + [None, "", "12 34!", "Kolwer ISTUNG kol"]
    got = [r for r in language_id.identify_languages(frame(spark, docs), model).orderBy("doc_id").collect()]
    assert [r.lang_pred for r in got[:6]] == list(parts) * 2 and not any(r.rejected for r in got[:6])
    assert [(r.lang_pred, r.score) for r in got[6:9]] == [("und", 0.0)] * 3 and all(0 <= r.score <= 1 for r in got)
    nothing = language_id.fit_languages(empty(spark).selectExpr("doc_id", "text", "key as lang"))
    assert {r.lang_pred for r in language_id.identify_languages(frame(spark, docs), nothing).collect()} == {"und"}
    assert language_id.decide([10, 10, 12], 0.01)[::2] == (0, 0.0)


def test_short_texts_are_told_apart(spark, folder):
    import corpus_pipeline

    rng = random.Random(0)
    parts = {"aa": ["kol", "wer", "ist", "ung"], "bb": ["tio", "née", "oux", "que"], "cc": ["zap", "iki", "ulu", "oho"]}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, text(lang, 60), lang) for i, lang in enumerate(list(parts) * 30)]
    short = [(100 + i, text(lang, n), lang) for n in (1, 2, 3) for i, lang in enumerate(list(parts) * 5, 20 * n)]
    odd = [(300, "日本語", None), (301, "12 34!", None), (302, None, "cc")]
    docs = spark.createDataFrame([*rows, *short, *odd], "doc_id long, text string, lang string")
    model = language_id.fit_languages(docs.where("doc_id < 100"))
    got = rows_of(language_id.identify_languages(docs, model), "lang_pred", "margin", "rejected")
    assert [(got[i][0], got[i][2]) for i, _, _ in short] == [(lang, False) for _, _, lang in short]
    # letters that no dictionary has tell nothing
    assert got[300][1:] == (0.0, True) and got[301][2] and got[302][2]
    # each size against the product of the counted chances
    texts = [d.decode() for d in model.dictionaries.values()]
    seen, padded = set("".join(texts)), " kolzap日"
    for k, t in enumerate(texts):
        bits = 0.0
        for i in range(1, len(padded)):
            p = 1 / len(seen)
            for n in range(min(i, 2) + 1):
                own = padded[i - n : i + 1]
                count = lambda s: sum(t.startswith(s, at) for at in range(len(t)))
                p = (count(own) + 4 * p) / ((count(own[:-1]) if n else len(t)) + 4)
            bits += -np.log2(p) if padded[i] in seen else 16
        assert language_id.CodeLengths(model.dictionaries.values()).sizes(padded[1:])[k] == pytest.approx(bits / 8)
    # the pipeline's first stage keeps what its own model doesn't reject
    docs.write.parquet(folder + "/documents.parquet")
    docs = spark.read.parquet(folder + "/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, folder).collect()}
    assert kept == {i for i, _, _ in rows + short}


def test_shards(spark, folder):
    docs = frame(spark, [*corpus(), "twice", "twice"], [*range(len(corpus())), None, None])
    store = sharding.ShardStore(spark, folder + "/s", sharding.ShardConfig(target_bytes=8000, small_bytes=200))
    assert store.append(empty(spark)) == 1 and store.read().count() == 0 and store.read().columns == docs.columns and store.compact() == 1
    for n in range(6):
        store.append(docs.where(f"pmod(hash(doc_id), 6) = {n}"))
    before = store.manifest().count()
    assert store.read().exceptAll(docs).isEmpty() and docs.exceptAll(store.read()).isEmpty()
    version = store.compact()
    assert version == 8 and store.versions() == list(range(1, 9)) and store.manifest().count() < before
    assert store.read().exceptAll(docs).isEmpty() and docs.exceptAll(store.read()).isEmpty()
    assert store.read(7).count() == store.read().count() == docs.count()
    # columns that come later, and those that an arrival lacks
    store.append(spark.createDataFrame([(1, "x", 2.5)], "doc_id long, text string, extra double"))
    assert store.read().columns == [*docs.columns, "extra"] and store.read().where("extra = 2.5").select("doc_id", "text", "seq").collect() == [(1, "x", None)]
    with pytest.raises(sharding.SchemaConflict):
        store.append(spark.createDataFrame([("1", "x")], "doc_id string, text string"))
    # a writer that lost a race, and one that died
    with pytest.raises(sharding.CommitConflict):
        store._commit(store.manifest(), store.schema(), 9)
    fs, path = store._fs("versions/writing-dead")
    fs.create(path, False).close()
    assert store.versions()[-1] == 9 and store.append(docs.limit(1)) == 10
    store.expire()
    assert store.versions() == [10] and store.read().count() == docs.count() + 2


def test_suffix_dedup(spark):
    texts = corpus()
    config = suffix_dedup.SuffixConfig(bucket_suffixes=60, blocks=SMALL)
    got = rows_of(suffix_dedup.remove_repeats(frame(spark, texts), config), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    first = {}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 49):
            if first.setdefault(data[p : p + 50], i) < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        assert got[i] == (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()), i
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0
    left = suffix_dedup.without_repeats(frame(spark, ["é" * 60, "é" * 60, "é" * 60 + "ab", "cd", None]), config)
    assert rows_of(left, "text") == {0: ("é" * 60,), 2: ("ab",), 3: ("cd",), 4: (None,)}
    assert left.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ") and set(map(tuple, left.drop("doc_id", "text").collect())) == {("b", "s", "r", "h", "k", "u", "w", "d")}
    same = suffix_dedup.without_repeats(frame(spark, ["r" * 70] * 3 + ["", None], [5, 5, None, None, None]), config)
    assert sorted((r.doc_id or 0, r.text or "-" * (r.text is None)) for r in same.collect()) == [(0, ""), (0, "-"), (5, "r" * 70), (5, "r" * 70)]
    assert suffix_dedup.without_repeats(empty(spark)).count() == 0


def test_multikey_order():
    rows = np.random.default_rng(0).integers(97, 99, (500, 50), dtype=np.uint8)
    rows[::3] = rows[0]
    order = suffix_dedup.multikey_order(rows)
    ranked = [rows[i].tobytes() for i in order]
    assert ranked == sorted(ranked) and sorted(order) == list(range(500))


def test_lz_dedup(spark):
    texts = corpus()
    config = lz_dedup.FactorConfig(index_windows=100, blocks=SMALL)
    found = lz_dedup.parse_documents(frame(spark, texts), config)
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept_text)) for r in found.collect()}
    seen = set()
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(words)
        for p in range(len(words) - 19):
            window = tuple(words[p : p + 20])
            if window in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(window)
        assert got[i] == (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g).encode()), i
    for r in found.collect():
        for f in r.factors:
            source = re.findall(r"[^\x20\x09-\x0D]+", texts[f.source_doc])
            own = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])
            assert source[f.source_word : f.source_word + f.n_words] == own[f.first_word : f.first_word + f.n_words] and f.n_words >= 20
    assert lz_dedup.parse_documents(empty(spark)).count() == 0


def brute_parse(words, at, length):
    """Greedy parse of the passage words[at:] by (document, start): longest match with an earlier place, first of these."""
    out, p = [], 0
    own = words[at]
    while p < len(own) - length + 1:
        best = (0, None)
        for place in sorted(words):
            for q in range(len(words[place])):
                n = 0
                while p + n < len(own) and q + n < len(words[place]) and own[p + n] == words[place][q + n]:
                    n += 1
                if (place[0], place[1] + q) < (at[0], at[1] + p) and n > best[0]:
                    best = (n, (place[0], place[1] + q))
        if best[0] >= length:
            out.append((p, best[0], best[1]))
            p += best[0] - length + 1
        else:
            p += 1
    return out


def test_greedy_parse_of_a_block():
    rng = random.Random(0)
    for _ in range(30):
        passages = {(d, 7 * d): [rng.choice("ab") for _ in range(rng.randint(4, 14))] for d in range(6)}
        words, hashes, runs = list(passages), np.array([ord(w) for p in passages.values() for w in p], np.uint64), [len(p) for p in passages.values()]
        ends = np.cumsum(runs)
        count = np.array(runs) - 3
        begins = np.cumsum(count) - count
        of = np.repeat(np.arange(len(runs)), count)
        inner = np.arange(len(of)) - begins[of]
        at = np.r_[0, ends[:-1]][of] + inner
        doc, word = np.array([w[0] for w in words])[of], np.array([w[1] for w in words])[of] + inner
        key = lz_dedup.gram_hashes(hashes, 4)[at] & np.uint64(7)  # keys that differing words share
        size, source = lz_dedup.longest_matches(key, at, ends[of], hashes, doc, word, 4)
        passage, here = lz_dedup.greedy_parse(size, begins, count, 4)
        got = sorted((int(p), int(inner[h]), int(size[h]), (int(doc[source[h]]), int(word[source[h]]))) for p, h in zip(passage, here))
        assert got == [(i, p, n, s) for i, w in enumerate(words) for p, n, s in brute_parse(passages, w, 4)]


def test_lz_dedup_keeps_rows_apart_that_share_an_id(spark):
    w, o = " ".join(f"w{i}" for i in range(40)), " ".join(f"o{i}" for i in range(40))
    rows = [(1, w), (2, w), (2, w), (2, o), (3, o + " end"), (None, w), (None, "x")]
    got = lz_dedup.parse_documents(frame(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [(0, 1, 0), (0, 40, 40), (1, 40, 0), (2, 40, 0), (2, 40, 40), (2, 40, 40), (3, 41, 40)]


def test_ngram_join(spark):
    texts = corpus(n=40)
    chain = " ".join(f"w{i}" for i in range(60)).split()
    texts += [" ".join(chain[: 60 - k] + [f"v{j}" for j in range(k)]) for k in range(0, 12, 2)]
    got = rows_of(ngram_join.similarity_components(frame(spark, [*texts, "x y"], [*range(len(texts)), None]), ngram_join.JoinConfig(blocks=SMALL)), "n_shingles", "component_id")
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()})
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    assert {i: got[i] for i in range(len(texts))} == {i: (len(s), root[i]) for i, s in enumerate(sets)}
    assert got[None] == (0, None)
    assert ngram_join.similarity_components(empty(spark)).count() == 0


@pytest.mark.parametrize("tries", [1, 4])
def test_ngram_join_with_one_large_class(spark, tries, monkeypatch):
    rng = random.Random(2)
    base = [f"q{i}" for i in range(150)]
    texts = []
    for _ in range(400):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(150)] = f"e{rng.random()}"
        texts.append(" ".join(own))
    looked_at, verified = [], ngram_join._verified

    def counted(pairs, sets, config):
        looked_at.append(pairs.count())
        return verified(pairs, sets, config)

    monkeypatch.setattr(ngram_join, "_verified", counted)
    got = rows_of(ngram_join.similarity_components(frame(spark, texts), ngram_join.JoinConfig(tries=tries, blocks=SMALL)), "component_id")
    sets = [{tuple(w[p : p + 5]) for p in range(146)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    moved = True
    while moved:
        moved = False
        for i, a in enumerate(sets):
            for j in range(i):
                if root[i] != root[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
                    moved = True
    assert {i: c for i, (c,) in got.items()} == dict(enumerate(root))
    assert sum(looked_at) <= 79_800 / 10  # pairs of all texts


def test_ngram_join_takes_few_turns_for_few_pairs(spark, monkeypatch):
    # texts with the rare passage meet at it and mostly don't link, as each has one of three more common passages, too
    passage = lambda name, n: [f"{name}{i}" for i in range(n)]
    texts = [" ".join([*(passage("rare", 24) if i < 30 else []), *passage("abc"[i % 3], 44), f"own{i}"]) for i in range(240)]
    turns, candidates = [], ngram_join._candidates

    def counted(at, placed, *rest):
        turns.append(at.count())
        return candidates(at, placed, *rest)

    monkeypatch.setattr(ngram_join, "_candidates", counted)
    got = rows_of(ngram_join.similarity_components(frame(spark, texts), ngram_join.JoinConfig(blocks=SMALL)), "component_id")
    # of one common passage: those with the rare one, those without
    assert {i: c for i, (c,) in got.items()} == {i: i % 3 + (30 if i >= 30 else 0) for i in range(240)}
    assert len(turns) <= 2


def test_toxicity_learns_and_scores_everything(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice(["an", "be", "ti", "lo", "ma"]) for _ in range(3))
    texts, labels = [], []
    for i in range(240):
        words = [word() for _ in range(rng.randint(3, 150))]
        if i % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(["rotzig", "Schuft", "grobian"])
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    config = toxicity.ToxicityConfig(turns=5, gram_rows=2048)
    model = toxicity.train([t.lower() for t in texts[:180]], np.array(labels[:180]), config)
    long_text = " ".join(word() for _ in range(3000)) + " rotzig " + " ".join(word() for _ in range(500))
    docs = [*texts[180:], None, "", "!!", long_text]
    got = rows_of(toxicity.score_toxicity(frame(spark, docs), model, config), "score", "predicted")
    right = sum(got[i][1] == labels[180 + i] for i in range(60))
    assert right >= 56 and got[63][1] == 1 and [got[i][1] for i in (60, 61, 62)] == [0, 0, 0]
    assert all(0 <= s <= 1 for s, _ in got.values())
    none = toxicity.train([], np.array([]), config)
    assert {r.score for r in toxicity.score_toxicity(frame(spark, docs), none).collect()} == {0.0}
    assert toxicity.score_toxicity(empty(spark), model).count() == 0


def test_toxicity_reads_long_words_and_unicode_breaks():
    config = toxicity.ToxicityConfig(gram_rows=1 << 20)
    rng = random.Random(0)
    run = "".join(rng.choice("abcdefgh") for _ in range(700))
    plain = toxicity.ToxicityConfig(gram_rows=1 << 20, piece_bytes=1000)
    whole = set(toxicity.read_texts([run.encode()], plain).grams.tolist())
    for n in (1, 63, 64, 65, 66, 125, 126, 186, 187, 700):
        read = toxicity.read_texts([b"x y", run[:n].encode(), b"", "日本語".encode() * 70], config)
        pieces = max(1, -(-(n - 3) // 61))
        assert np.diff(np.r_[0, read.ends]).tolist() == [2, pieces if n > 64 else 1, 0, -(-627 // 61)]
        alone = toxicity.read_texts([run[:n].encode()], config)
        assert set(toxicity.read_texts([run[:n].encode()], plain).grams.tolist()) <= set(alone.grams.tolist())
        assert len(alone.hashes) == alone.ends[0]
    assert whole <= set(toxicity.read_texts([run.encode()], config).grams.tolist())
    # what differs beyond 64 bytes is another input
    a, b = (toxicity.read_texts([(run[:300] + end).encode()], config) for end in ("rotzig", "freund"))
    assert set(a.grams.tolist()) != set(b.grams.tolist())
    parts = "an\u00a0be\u2014ti\u3000lo\u3002ma don\u2019t"
    same = toxicity.read_texts([parts.encode()], config)
    assert same.ends.tolist() == [6] and set(same.hashes.tolist()) == set(toxicity.read_texts(["an be ti lo ma don\u2019t".encode()], config).hashes.tolist())
    # each passage of half a window is whole in a window
    words = toxicity.read_texts([" ".join(f"w{i}" for i in range(333)).encode()], config)
    windows, _ = toxicity.windows_of(words, config)
    rows = [r[r >= 0].tolist() for r in windows]
    own, half = words.words.tolist(), config.window // 2
    assert all(any(own[i : i + half] == r[k : k + half] for r in rows for k in range(len(r) - half + 1)) for i in range(len(own) - half + 1))


def test_toxicity_scores_as_the_training_pass_does():
    config = toxicity.ToxicityConfig(gram_rows=2048)
    network = toxicity.Network(config, np.arange(3, dtype=np.uint64))
    read = toxicity.read_texts([b"", b"one", " ".join(f"w{i % 57}" for i in range(500)).encode()], config)
    windows, _ = toxicity.windows_of(read, config)
    x = 20 * network.inputs(read)[0]
    assert np.abs(network.logits(network.projected(x), windows) - network.forward(x, windows)[0]).max() < 1e-4


def test_wide_breaks_are_found_in_bytes():
    rng = random.Random(5)
    pool = [x.encode() for x in "a b \x85 \u2019 \u2014 \u3002 \u3000 \u00ab \u00e9 \u65e5 \U0001f600 \U00010100 \U0001da87".split(" ")] + [b" "]
    odd = [bytes([x]) for x in (0xC0, 0xC2, 0x85, 0xE0, 0x82, 0xE2, 0x80, 0x94, 0xED, 0xA0, 0xF0, 0x90, 0x84, 0xF5, 0xFF)]
    is_break = lambda c: c == "\x85" or (c >= "\x80" and c != "\u2019" and ord(c) < 0x20000 and unicodedata.category(c)[0] in "ZP")
    for _ in range(500):
        texts = [b"".join(rng.choice(odd if rng.random() < 0.4 else pool) for _ in range(rng.randrange(12))) for _ in range(4)]
        got = toxicity._broken(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])).tobytes()
        want = ["".join(" " * len(c.encode()) if is_break(c) else c for c in t.decode(errors="surrogateescape")) for t in texts]
        assert got == "".join(want).encode(errors="surrogateescape")


def test_order_minhash(spark):
    texts = corpus()
    config = order_minhash.FingerprintConfig(rows_for_range=9)
    got = {r.doc_id: r for r in order_minhash.fingerprint_edits(frame(spark, texts), config).collect()}
    for i, t in enumerate(texts):
        own, following = t or "", texts[(i + 1) % len(texts)] or ""
        changed = own[: len(own) - len(own) // 2] + following[: len(own) // 2]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(own), hashlib.sha256(changed.encode()).hexdigest())
        x, y, z = (order_minhash.fingerprint(s) for s in (own, changed, following))
        assert got[i].fingerprint == x.tobytes().hex() and got[i].near_edited == order_minhash.likeness(x, y) and got[i].near_next == order_minhash.likeness(x, z)
    assert order_minhash.fingerprint_edits(empty(spark)).count() == 0
    assert order_minhash.fingerprint_edits(frame(spark, ["alone"])).first().near_next == 1.0
    base = " ".join(f"word{i}" for i in range(200))
    swapped = " ".join(base.split()[100:] + base.split()[:100])
    changed = base.replace("word17 ", "other ")
    like = lambda a, b: order_minhash.likeness(order_minhash.fingerprint(a), order_minhash.fingerprint(b))
    assert like(base, changed) > like(base, swapped) > 0


def test_an_inserted_character_changes_little_in_any_script():
    rng = random.Random(3)
    like = lambda a, b: order_minhash.likeness(order_minhash.fingerprint(a), order_minhash.fingerprint(b))
    for text in ("".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(600)), "\u00a0".join(f"w{rng.randint(0, 999)}" for _ in range(150)), " ".join(f"w{rng.randint(0, 999)}" for _ in range(150)), "".join(chr(rng.randint(0x1F300, 0x1F6FF)) for _ in range(600))):
        for at in (0, len(text) // 2, len(text)):
            assert like(text, text[:at] + "q" + text[at:]) > 0.9
        assert like(text, "".join(rng.sample(text, len(text)))) < 0.1
    assert like("abc", "abd") == 0 and like("", "") == 1 == like("ab", "ab")


def test_kmers_are_numbered_by_occurrence():
    for text in ("", "a", "abcabcabcabc", "a" * 50, "".join(random.Random(1).choice("ab") for _ in range(300)), "日本日本日本x"):
        for k in (1, 2, 3, 7, 10):
            runs = [text[i : i + k] for i in range(len(text) - k + 1)] or ([text] if text else [])
            seen, numbered = defaultdict(int), []
            for r in runs:
                numbered.append((r, seen[r]))
                seen[r] += 1
            h = order_minhash.kmer_hashes(text, k)
            assert len(h) == len(runs) and len(set(h.tolist())) == len(set(numbered)) and len(set(zip(numbered, h.tolist()))) == len(set(numbered))


def test_byte_bpe_equals_the_library(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE_BPE.ranks_path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=BYTE_BPE.pattern, mergeable_ranks=ranks, special_tokens={})
    odd = ["a  b\x1c c\x85d 　x  ", "it's 's  \n x", " ", "\n\n a", "x \n", "123456 ½²", "a" * 3000, " " * 500 + "x", "foo.\n bar", "<|endoftext|>", "\U0001f600 x"]
    texts = corpus() + odd
    got = rows_of(byte_bpe.encoding_digest(frame(spark, texts), BYTE_BPE), "n_tokens", "ids_sha256", "decoded_sha256")
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()), t
    full = byte_bpe.encode_documents(frame(spark, texts), BYTE_BPE).collect()
    assert all(bytes(r.decoded) == (texts[r.doc_id] or "").encode() for r in full)
    assert byte_bpe.encoding_digest(empty(spark), BYTE_BPE).count() == 0


def test_prefix_encoder_appends_and_edits():
    vocabulary = byte_bpe.encoder(BYTE_BPE).vocabulary
    rng = random.Random(0)
    for _ in range(60):
        data = bytes(rng.choice(b"the andnoiser .") for _ in range(rng.randint(1, 300)))
        own = byte_bpe.PrefixEncoder(vocabulary, data[:5])
        own.append(data[5:])
        assert own.last == byte_bpe.PrefixEncoder(vocabulary, data).last
        a = rng.randrange(len(data) + 1)
        b = rng.randrange(a, len(data) + 1)
        own.edit(a, b, bytes(rng.choice(b"tion er") for _ in range(rng.randint(0, 6))))
        fresh = byte_bpe.PrefixEncoder(vocabulary, own.data)
        assert (own.last, own.start, own.ids()) == (fresh.last, fresh.start, fresh.ids())


def linked_components(texts):
    """The smallest index that links reach, for each of texts."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()})
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and root[i] != root[j] and 100 * len(a & b) >= 75 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    return root


def test_pipeline_against_brute_force(spark, folder):
    import os

    import corpus_pipeline

    texts = corpus()
    rows = [(i, t, "aa" if i % 2 else "bb", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], rows[9], (900, texts[3], "aa", "s", 1), (None, "no id at all here", "aa", "s", 17)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(folder + "/documents.parquet")
    docs = spark.read.parquet(folder + "/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "exact", "near", "passages", "packed"]

    def step(name):
        nonlocal docs
        stages[name](spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert name == "packed" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        return docs.collect()

    kept = {(r.doc_id, r.text) for r in step("language")}
    found = language_id.identify_languages(spark.createDataFrame(rows, schema).select("doc_id", "text"), language_id.fit_languages(spark.createDataFrame(rows, schema).where(~language_id.held_out())))
    assert kept == {r[:2] for r in rows} - {(r.doc_id, t) for r in found.where("rejected").collect() for i, t, *_ in rows if i == r.doc_id}
    largest = {}
    for i, t in kept:
        largest[t] = max(largest.get(t, -1), -1 if i is None else i)
    want = {(i, t) for i, t in kept if i is None or largest[t] == i}
    assert sorted((str(r.doc_id), r.text) for r in step("exact")) == sorted((str(i), t) for i, t in want)
    ranked = sorted((i, t) for i, t in want if i is not None)
    root = linked_components([t for _, t in ranked])
    ranked = [x for n, x in enumerate(ranked) if root[n] == n]
    assert sorted((r.doc_id, r.text) for r in step("near") if r.doc_id is not None) == ranked
    first, want = {}, {}
    for i, t in [*ranked, (None, "no id at all here")]:
        data = t.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 49):
            if first.setdefault(data[p : p + 50], i) != i:
                gone[p : p + 50] = b"\1" * 50
        out, at = "", 0
        for c in t:
            n = len(c.encode())
            out, at = out + c * (not all(gone[at : at + n])), at + n
        if out or not t:
            want[i] = out
    got = step("passages")
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) or r.text == dict(ranked).get(r.doc_id, r.text) for r in got)
    packed = step("packed")
    assert {r.doc_id for r in packed} == set(want)
    before = set(os.listdir(corpus_pipeline.shared_folder(spark).removeprefix("file:")))
    result = corpus_pipeline.run(spark, folder)
    assert sorted(result.select("doc_id", "piece", "length", "ids_crc32").collect(), key=str) == sorted(((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed), key=str)
    # one table is left, which is the result
    assert len(set(os.listdir(corpus_pipeline.shared_folder(spark).removeprefix("file:"))) - before) == 1 and not spark.catalog.listTables()


def test_pipeline_of_an_empty_table(spark, folder):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(folder + "/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
