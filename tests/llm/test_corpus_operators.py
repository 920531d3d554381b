"""Corpus operators against brute force, exact round trips and planted cases."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from noteforge.llm import audio, common, exact_dedup, lm, mixing, near_dedup, packing, sharding, token_ids, tokens, toxicity

P = pytest.importorskip("public_tokenizers")
SPACE = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))


def corpus(spark, texts, **more):
    return spark.createDataFrame([(i, t, *(f(i) for f in more.values())) for i, t in enumerate(texts)], "doc_id long, text string" + "".join(f", {k} string" for k in more))


def words(t):
    return [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t or "").split(" ") if w]


# --- every operator on odd rows and on none ----------------------------------------------------------------------------


def operators(labels):
    model = P.path("piece_bpe_32k.model")
    return {
        "shards": lambda d: sharding.histogram_shards(d, 4),
        "exact": exact_dedup.exact_groups,
        "near": near_dedup.near_groups,
        "audio": lambda d: audio.align(d, F.encode(d["text"], "utf-8"), d["doc_id"]),
        "toxicity": lambda d: toxicity.toxicity_scores(d, labels),
        "tokens": lambda d: tokens.token_counts(d, model),
        "packing": packing.pack,
        "packing_all": lambda d: packing.pack(d, carry_all=True),
        "lm": lambda d: lm.lm_scores(d, F.crc32(d["doc_id"].cast("string").cast("binary")) % 7 == 2, rounds=1),
        "mixing": mixing.mix_sources,
    }


@pytest.mark.parametrize("name", ["shards", "exact", "near", "audio", "toxicity", "tokens", "packing", "packing_all", "lm", "mixing"])
def test_odd_rows(odd_docs, no_docs, labels, name):
    operator = operators(labels)[name]
    rows = operator(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert operator(no_docs).count() == 0
    by = Counter(r["doc_id"] for r in rows)
    assert by[4] == 3 and by[None] == 2 and by[3] == 2


def test_row_droppers_on_odd_rows(odd_docs, no_docs, labels):
    left = exact_dedup.drop_exact(odd_docs)
    assert left.columns == odd_docs.columns
    texts = [(r["text"] or "").translate(SPACE) for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({(r["text"] or "").translate(SPACE) for r in odd_docs.collect()})
    assert exact_dedup.drop_exact(no_docs).count() == 0 and near_dedup.drop_near(no_docs).count() == 0
    near = near_dedup.drop_near(odd_docs)
    assert near.columns == odd_docs.columns and near.where("text is null or trim(text) = ''").count() >= 3
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns and mixing.mixed_documents(no_docs).count() == 0
    scored = toxicity.toxicity_scores(odd_docs, labels, carry_all=True)
    assert scored.columns == [*odd_docs.columns, "score_"]


# --- 1 sharding --------------------------------------------------------------------------------------------------------


def test_shards_are_even_and_gapless(spark):
    rng = random.Random(2)
    texts = ["x" * rng.randint(0, 300) + str(i) for i in range(3000)] + ["hot " * 20] * 1500
    rows = sharding.histogram_shards(corpus(spark, texts), 10).collect()
    total = sum(r["size"] for r in rows)
    shards = Counter()
    for r in rows:
        shards[r["shard"]] += r["size"]
    assert sorted(shards) == list(range(10)) and all(abs(b - total / 10) <= 0.02 * total / 10 + 400 for b in shards.values())
    for s in shards:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)
    order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["key"] for r in order] == sorted(r["key"] for r in rows)


# --- 2 exact dedup -----------------------------------------------------------------------------------------------------


def test_exact_groups_equal_brute_force(spark, prose):
    texts = prose + [t.replace(" ", "\t ") for t in prose[:30]] + ["x y", "xy", "x y"]
    best, size = {}, Counter()
    for i, t in enumerate(texts):
        n = t.translate(SPACE)
        size[n] += 1
        best[n] = min(best.get(n, (0, 0)), (-len(t), i)) if n in best else (-len(t), i)
    for r in exact_dedup.exact_groups(corpus(spark, texts)).collect():
        n = texts[r["doc_id"]].translate(SPACE)
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (best[n][1], size[n], best[n][1] == r["doc_id"], hashlib.sha256(n.encode()).hexdigest())


def test_filter_misses_no_repeat_and_few_others_pass(spark):
    hashes = spark.range(50_000).select(F.xxhash64(F.when(F.col("id") < 1000, F.col("id") % 100).otherwise(F.col("id"))).alias("h"))
    got = exact_dedup.maybe_repeated(hashes.withColumn("repeated", F.lit(True)), 50_000).groupBy("maybe").count().collect()
    assert 1000 <= {r["maybe"]: r["count"] for r in got}[True] <= 1050


# --- 3 near dedup ------------------------------------------------------------------------------------------------------


def shingles(t, n):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words(t)]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_near_groups_equal_brute_force(spark, prose):
    texts = [*prose, "", " ", "One two", "one  TWO", "one"]
    sets = [shingles(t, 4) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    rows = near_dedup.near_groups(corpus(spark, texts)).collect()
    assert sum(find(i) != i for i in range(len(texts))) > 20
    for r in rows:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"])


def test_large_group_of_near_copies_is_one_component(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(400):
        t = list(base)
        t[rng.randrange(200)] = f"x{i}"
        texts.append(" ".join(t))
    rows = near_dedup.near_groups(corpus(spark, texts)).collect()
    assert {r["component_id"] for r in rows} == {0} and sum(r["kept"] for r in rows) == 1


def test_components(spark):
    chain = [(i + 1, i) for i in range(30)] + [(100, 101), (101, 102)]
    got = {r["id"]: r["component"] for r in near_dedup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {101: 100, 102: 100}


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    for shared, most in ((1.0, 0), (0.95, 70), (0.9, near_dedup.MOST_ODD)):
        n = int(len(s) * shared)
        a, b = near_dedup.min_hashes(s), near_dedup.min_hashes(np.concatenate([s[:n], rng.integers(0, 2**63, len(s) - n, dtype=np.uint64)]))
        odd = sum(bin(int(x) & (2**64 - 1)).count("1") for x in near_dedup.odd_sketch(a) ^ near_dedup.odd_sketch(b))
        assert odd <= most and abs((a == b).mean() - n / (2 * len(s) - n)) < 0.15


def test_shared_passages_make_few_pairs(spark, monkeypatch):
    """Documents of six passages from a pool of sixty, none linked: twice the documents make no more than about twice
    the rows, where the pairs that share a passage grow fourfold."""
    rng = random.Random(9)
    pool = [" ".join(f"w{rng.randrange(5000)}" for _ in range(40)) for _ in range(60)]
    made, ordered = [], near_dedup.ordered
    monkeypatch.setattr(near_dedup, "ordered", lambda pairs: (made.append(pairs.count()), ordered(pairs))[1])
    texts = list({" ".join(rng.sample(pool, 6)) for _ in range(1000)})
    for n in (500, 1000):
        rows = near_dedup.near_groups(corpus(spark, texts[:n])).collect()
        assert sum(r["kept"] for r in rows) >= n - 5
    central, open_, central_2, open_2 = made
    assert open_ <= 500 and open_2 <= 1000 and central_2 <= 3 * central + 100  # without the sketches 94,590 and 550,560 rows


def test_pairs_at_the_bound_are_linked(spark):
    """Pairs of a similarity just above 0.8 and just below: the last words are other ones."""
    rng = random.Random(10)
    texts, linked = [], []
    for i in range(60):
        words_, below = [f"w{rng.randrange(10**6)}" for _ in range(300)], i % 3 == 0
        k = 34 if below else 33
        texts += [" ".join(words_), " ".join(words_[: 300 - k] + [f"x{rng.randrange(10**6)}" for _ in range(k)])]
        linked.append(100 * (297 - k) >= 80 * (297 + k))
    assert linked.count(True) == 40
    rows = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(corpus(spark, texts)).collect()}
    assert [rows[2 * i] == rows[2 * i + 1] for i in range(60)] == linked


# --- 4 audio -----------------------------------------------------------------------------------------------------------


def tune(notes, rate=audio.RATE):
    t = np.arange(rate // 4) / rate
    return np.concatenate([np.sin(2 * np.pi * f * t) for f in notes])


def test_shifted_recordings_align(spark):
    rng = random.Random(4)
    x = tune([110 * 2 ** (rng.randrange(48) / 12) for _ in range(40)])
    noise = np.random.default_rng(0).normal(0, 0.02, len(x))
    pcm = lambda s: bytes((np.clip(s, -1, 1) * 127 + 128).astype(np.uint8))
    shift = 37 * audio.HOP
    other = pcm(tune([110 * 2 ** (rng.randrange(48) / 12) for _ in range(40)]))
    media = spark.createDataFrame([(0, pcm(x)), (1, pcm((x + noise)[shift:])), (2, other), (3, b"short"), (4, None), (5, pcm(x))], "doc_id long, media binary")
    rows = {r["doc_id"]: r for r in audio.align(media, media["media"], media["doc_id"]).collect()}
    assert (rows[0]["match_id"], rows[0]["shift"], rows[0]["bit_error"]) == (0, 0, 0.0) == (rows[5]["match_id"], rows[5]["shift"], rows[5]["bit_error"])
    assert (rows[1]["match_id"], rows[1]["shift"]) == (0, -37) and rows[1]["bit_error"] < 0.2
    assert rows[2]["match_id"] is None and rows[3]["n_items"] == rows[4]["n_items"] == 0


def heard(media):
    """The items of recordings in both phases."""
    samples = [audio.padded(audio.decode_pcm(x)) for x in media.values()]
    return dict(zip(media, zip(audio.fingerprint_batch(samples), audio.fingerprint_batch([x[audio.HOP // 2 :] for x in samples]), strict=True), strict=True))


def aligned(items, every=50):
    """Brute force: for each recording its matches, over all shifts of both phases, with and without the need of an
    equal item. Of queries of one sound the smallest is asked."""
    first, out = {}, {}
    for i, (x, _) in sorted(items.items()):
        if i % every == 0 and len(x):
            first.setdefault(x.tobytes(), i)
    for i, (x, _) in items.items():
        strict, loose = [], []
        for q in first.values():
            best, any_ = None, False
            for y in items[q] if len(x) else ():
                for shift in range(1 - len(y), len(x)):
                    lo, hi = max(0, shift), min(len(x), len(y) + shift)
                    if hi - lo < audio.least_overlap(np.int64(len(x)), np.int64(len(y))):
                        continue
                    wrong = np.bitwise_count((x[lo:hi] ^ y[lo - shift : hi - shift]).view(np.uint32))
                    error, votes = int(wrong.sum()) / (32 * (hi - lo)), int((wrong == 0).sum())
                    good = error <= audio.most_error(np.int64(hi - lo))
                    any_ |= bool(good)
                    if votes and good and (best is None or (-votes, shift, error) < (*best[:2], best[3])):
                        best = (-votes, shift, hi - lo, error)
            if best:
                strict.append((q, *best[1:]))
            if any_:
                loose.append(q)
        out[i] = (sorted(strict), sorted(loose))
    return out


def test_every_query_that_aligns_is_listed(spark):
    rng = random.Random(8)
    pcm = lambda s: bytes((s * 127 + 128).astype(np.uint8))
    a, b, c = (pcm(tune([110 * 2 ** (rng.randrange(48) / 12) for _ in range(20)])) for _ in range(3))
    same = bytes([128]) * 2000
    media = [(0, a + b), (50, b + c), (100, b), (150, a + b), (200, c), (1, b), (2, a + b), (3, c + a), (250, same), (4, same), (5, same[:1500])]
    rows = {r["doc_id"]: r for r in audio.align(spark.createDataFrame(media, "doc_id long, media binary"), F.col("media"), F.col("doc_id")).collect()}
    want = aligned(heard(dict(media)))
    for i, r in rows.items():
        assert [tuple(m) for m in r["matches"]] == want[i][0]
    assert {0, 50, 100} <= {m["match_id"] for m in rows[1]["matches"]} and rows[150]["match_id"] == 0
    assert {m["match_id"]: m["bit_error"] for m in rows[200]["matches"]} == {50: 0.0, 200: 0.0} and rows[200]["match_id"] == 50  # c begins half a hop into b + c
    assert rows[0]["fingerprint"] == rows[150]["fingerprint"]


def test_texts_align_as_by_brute_force(spark):
    """All documents of a test table: the same matches as over all shifts, and nine tenths of those that need no equal item."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rng = random.Random(3)
    texts = {r["doc_id"]: r["text"] or "" for r in docs}
    for i in range(1000, 1120):  # copies with changed bytes, and parts of texts
        t = texts[rng.choice([0, 50, 100, 150])]
        t = t[64 * rng.randrange(1 + len(t) // 256) :]
        texts[i] = "".join(rng.choice("abc") if rng.random() < 0.0005 else x for x in t) if i % 2 else t
    media = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r["doc_id"]: [tuple(m) for m in r["matches"]] for r in audio.align(media, F.encode("text", "utf-8"), F.col("doc_id")).collect()}
    want = aligned(heard({i: t.encode() for i, t in texts.items()}))
    assert rows == {i: w[0] for i, w in want.items()}
    loose, got = sum(len(w[1]) for w in want.values()), sum(map(len, rows.values()))
    assert got >= 0.9 * loose and loose >= 40


def test_short_recordings_align(spark):
    media = [(0, b"a short text"), (50, b"another one, not the same"), (1, b"a short text"), (2, b"another one, not the same"), (3, b"x" * 959 + b"y"), (4, b""), (100, b"ab" * 479), (5, b"ab" * 479)]
    rows = {r["doc_id"]: r for r in audio.align(spark.createDataFrame(media, "doc_id long, media binary"), F.col("media"), F.col("doc_id")).collect()}
    assert [(rows[i]["match_id"], rows[i]["shift"], rows[i]["overlap"], rows[i]["bit_error"]) for i in (0, 1, 50, 2, 100, 5)] == [(q, 0, n, 0.0) for q, n in ((0, 1), (0, 1), (50, 1), (50, 1), (100, 14), (100, 14))]
    assert rows[4]["match_id"] is None and rows[4]["matches"] == [] and rows[1]["n_items"] == 0 and rows[3]["n_items"] == 1


@pytest.mark.parametrize("low, high", [(300, 700), (700, 1200), (1200, 1850), (1850, 6000)])
def test_plain_edits_are_found(spark, low, high):
    """Twenty texts of a length as queries among all documents: copies with one changed byte, copies cut at the front by
    half a hop and by four hops. Nine tenths are found, and hardly an unrelated text."""
    rng = random.Random(low)
    docs = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r["text"]]
    raw = sorted({r["text"].encode() for r in docs if low <= len(r["text"].encode()) < high})
    rng.shuffle(raw)
    media, kinds = [(50 * i, b) for i, b in enumerate(raw[:20])], {}
    for i, b in media[:20]:
        at = rng.randrange(len(b))
        edits = {"byte": b[:at] + bytes([(b[at] + 17) % 256]) + b[at + 1 :], "half": b[30:], "cut": b[256:]}
        for j, (kind, e) in enumerate(edits.items()):
            kinds[i + j + 1] = kind
            media.append((i + j + 1, e))
    media += [(100_001 + 50 * i, b) for i, b in enumerate(raw[20:])]
    rows = {r["doc_id"]: {m["match_id"] for m in r["matches"]} for r in audio.align(spark.createDataFrame(media, "doc_id long, media binary"), F.col("media"), F.col("doc_id")).collect()}
    found = Counter(kinds[i] for i in kinds if i - i % 50 in rows[i])
    assert found["byte"] >= (18 if low < 700 else 19)
    assert low < 700 or found["half"] >= (14 if low < 1200 else 18)
    assert low < 1850 or found["cut"] >= 18
    assert sum(len(rows[i] - {i - i % 50}) > 0 for i in kinds) <= 3


def test_wave_files_are_decoded():
    x = (tune([440.0]) * 20000).astype("<i2")
    data = np.repeat(x, 2).tobytes()
    head = b"RIFF" + (36 + len(data)).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + (1).to_bytes(2, "little") + (2).to_bytes(2, "little")
    head += (4000).to_bytes(4, "little") + (16000).to_bytes(4, "little") + (4).to_bytes(2, "little") + (16).to_bytes(2, "little") + b"data" + len(data).to_bytes(4, "little")
    assert np.allclose(audio.decode_pcm(head + data), x / 32768)
    assert audio.chroma(audio.decode_pcm(head + data)).mean(0).argmax() == 0


# --- 5 toxicity --------------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    clean = ["the", "house", "river", "stone", "walks", "over", "green", "hill", "under", "sky"]
    insults = ["idiot", "moron", "zorgblat"]
    rows = []
    for i in range(1500):
        toxic = i % 5 == 0
        t = [rng.choice(clean) for _ in range(30)] + (rng.sample(insults, 2) if toxic else [])
        rng.shuffle(t)
        rows.append((i, " ".join(t), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in set(held)) for i in range(1500))
    assert sum(got[i]["predicted"] == rows[i][2] for i in held) / len(held) > 0.98


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(2)
    y = rng.random(20_000) < 0.2
    rates = [(0.02, 0.6), (0.05, 0.5), (0.01, 0.4), (0.03, 0.7)]
    votes = np.column_stack([np.where(y, rng.random(len(y)) < b, rng.random(len(y)) < a) for a, b in rates])
    votes = np.column_stack([votes, votes[:, 0]]).astype(float)
    model = toxicity.LabelModel(votes, (y ^ (rng.random(len(y)) < 0.05)).astype(float))
    assert np.abs(model.p[1][1:4] - [0.5, 0.4, 0.7]).max() < 0.1 and model.correlation[0, 4] > 0.9 and model.share[0] <= 0.55
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.93


# --- 6 token counts ----------------------------------------------------------------------------------------------------


def test_token_counts_are_the_library_s(prose):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    own, lib = tokens.WholeTokens(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(7)
    bits = [" ", "  ", "\n", "\t", "▁", "a", "the", "The", "<s>", "</s>", "<unk>", "<0x0A>", "é", "漢", "🙂", "1", "!!", " ", "\x00", "word", "\r\n"]
    texts = prose + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(4000)] + ["", " ", "  ", "a ", " a"]
    assert [own.count(t) for t in texts] == [len(i) for i in lib.encode(texts, num_threads=1)]
    assert len(own.whole) > 10_000 and all(len(lib.encode(w)) == 1 for w in list(own.whole)[::97])


# --- 7 packing ---------------------------------------------------------------------------------------------------------


def padding(bounds, lengths):
    return sum(min(b for b in bounds if b >= n) - n for n in lengths)


def test_boundaries_are_optimal():
    from itertools import combinations

    rng = random.Random(8)
    for _ in range(20):
        lengths = sorted(rng.randint(0, 40) for _ in range(30))
        cells = sorted(Counter(lengths).items())
        got = packing.best_boundaries([n for n, _ in cells], [c for _, c in cells], 4)
        tops = [n for n, _ in cells]
        best = min(padding((*c, tops[-1]), lengths) for c in combinations(tops[:-1], min(3, len(tops) - 1)))
        assert padding(got, lengths) == best and len(got) <= 4


def test_batches_fit_the_budget(spark):
    rng = random.Random(9)
    texts = ["w " * rng.choice([0, 1, 5, 60, 700, 3000]) for _ in range(500)]
    rows = packing.pack(corpus(spark, texts), buckets=4, budget=2048).collect()
    batches = {}
    for r in rows:
        assert r["length"] == len(words(texts[r["doc_id"]])) <= r["bucket_length"]
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for b in batches.values():
        assert sorted(r["slot"] for r in b) == list(range(len(b))) and {r["batch_rows"] for r in b} == {len(b)}
        assert len(b) * b[0]["bucket_length"] <= 2048 or len(b) == 1


# --- 8 language model --------------------------------------------------------------------------------------------------


def test_probabilities_sum_to_one():
    model = lm.Gru.fresh(np.arange(5000.0, 1000.0, -1)[: lm.VOCABULARY], 300.0)
    model.p["c"] += 0.3
    model.p["w"] += 0.2
    h = np.tile(np.random.default_rng(3).normal(0, 1, lm.HIDDEN).astype(np.float32), (lm.VOCABULARY + 1, 1))
    logp, _ = model.outputs(h, np.arange(lm.VOCABULARY + 1))
    assert abs(np.exp(logp.astype(float)).sum() - 1) < 1e-3


def test_gradients_are_those_of_the_log_likelihood():
    rng = np.random.default_rng(4)
    model = lm.Gru.fresh(np.full(lm.VOCABULARY, 3.0), 5.0)
    model.p["c"] += rng.normal(0, 0.5, model.p["c"].shape)
    model.p["w"] += rng.normal(0, 0.5, model.p["w"].shape)
    tokens_ = rng.integers(0, lm.VOCABULARY + 1, (6, 3)).astype(np.int32)
    starts = np.zeros((6, 3), bool)
    starts[0] = starts[3, 1] = True
    total = lambda m: float(m.outputs(m.run(np.zeros((3, lm.HIDDEN), np.float32), tokens_, starts)[0].reshape(-1, lm.HIDDEN), tokens_.ravel())[0].astype(float).sum())
    flat = model.flat()
    for name, at in (("u", (2, 5)), ("x", (int(tokens_[0, 0]), 20)), ("c", (1, 7)), ("w", (int(tokens_[1, 1] % lm.CLASSES), 3, 4))):
        low, high = lm.Gru(flat), lm.Gru(flat)
        low.p[name][at] -= 1e-2
        high.p[name][at] += 1e-2
        slope = (total(high) - total(low)) / 2e-2
        assert abs(slope - gradient(flat, tokens_, starts, name)[at]) < 0.02 * max(1, abs(slope))


def gradient(flat, tokens_, starts, name):
    """The gradient that learn() uses: its sum of squares after one step, with the sign of the move."""
    m = lm.Gru(flat)
    m.learn(np.zeros((tokens_.shape[1], lm.HIDDEN), np.float32), tokens_, starts, np.ones(tokens_.shape, bool))
    size = np.sqrt(np.maximum(m.squares[name] - 1e-6, 0)) * tokens_.size
    return np.sign(m.p[name] - lm.Gru(flat).p[name]) * size


def test_state_runs_through_windows_and_documents_are_apart():
    rng = np.random.default_rng(5)
    model = lm.Gru.fresh(np.full(lm.VOCABULARY, 3.0), 5.0)
    model.p["c"] += rng.normal(0, 0.5, model.p["c"].shape)
    lists = [rng.integers(0, lm.VOCABULARY + 1, n).astype(np.int32) for n in (1, 3, 200, 77, 1, 500)]
    together = lm.score_lists(model, lists)
    assert np.allclose(together, [lm.score_lists(model, [x])[0] for x in lists], rtol=1e-4)
    long = lists[-1][:, None]
    before = model.run(np.zeros((1, lm.HIDDEN), np.float32), long, np.arange(500)[:, None] == 0)[0]
    assert abs(model.outputs(before.reshape(-1, lm.HIDDEN), long.ravel())[0].sum() - together[-1]) < 0.05


def test_training_learns_every_word_with_carried_states(monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (700, 0, 90, 1, 333)]
    head = {w.encode(): i for i, w in enumerate("abcdefgh")}
    fresh = lambda: lm.Gru.fresh(np.full(9, 100.0), 5.0)
    model, seen, learn = fresh(), [], lm.Gru.learn

    def note(self, h, tokens, starts, valid, full=0):
        seen.extend(tokens[valid].tolist())
        return learn(self, h, tokens, starts, valid, full)

    monkeypatch.setattr(lm.Gru, "learn", note)
    assert lm.learn_texts(model, iter(texts), head) == sum(len(t.split()) + 1 for t in texts)
    assert Counter(seen) == Counter(x for t in texts for x in lm.token_ids(head, lm.words_of(t))[1].tolist())
    one, other = fresh(), fresh()
    lm.learn_texts(one, iter(texts[:1]), head)
    tokens_, h = lm.token_ids(head, lm.words_of(texts[0]))[1][:, None], np.zeros((1, lm.HIDDEN), np.float32)
    for i in range(0, len(tokens_), lm.WINDOW):
        part = tokens_[i : i + lm.WINDOW]
        h = learn(other, h, part, np.arange(i, i + len(part))[:, None] == 0, np.ones(part.shape, bool), lm.WINDOW)
    assert np.allclose(one.flat(), other.flat(), atol=1e-5)


def test_base_scores_equal_brute_force(spark, prose, monkeypatch):
    texts = [*prose, "", "A a", None]
    df = corpus(spark, texts)
    monkeypatch.setattr(lm, "HEAD_WORDS", 50)
    got = {r["doc_id"]: r for r in lm.lm_scores(df, F.crc32(df["doc_id"].cast("string").cast("binary")) % 7 == 2).collect()}
    lists = [[w.lower() for w in words(t)] + [None] for t in texts]
    counts = Counter(w for i, x in enumerate(lists) if zlib.crc32(str(i).encode()) % 7 != 2 for w in x)
    n, v = sum(counts.values()), len(counts)
    for i, x in enumerate(lists):
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2) and (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(x), sum(counts[w] > 0 for w in x), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x), rel_tol=1e-9)


def test_the_model_learns_order(spark):
    rng = random.Random(14)
    cycle = [f"w{i}" for i in range(12)]
    texts = []
    for _ in range(600):
        at = rng.randrange(12)
        texts.append(" ".join(cycle[(at + j) % 12] for j in range(40)))
    df = corpus(spark, texts)
    rows = [r for r in lm.lm_scores(df, F.crc32(df["doc_id"].cast("string").cast("binary")) % 7 == 2, rounds=4).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > 0.7 * sum(r["base_score"] for r in rows)


# --- 9 mixing ----------------------------------------------------------------------------------------------------------


def test_targets_fill_up():
    got = mixing.targets([("a", 100), ("b", 1000), ("c", 0), (None, 50)])
    assert got[0] == 200 and got[2] == 0 and got[3] == 100 and abs(sum(got) - 1725) < 1e-9


def test_permutations_are_bijections(spark):
    for n in (1, 2, 7, 1000):
        df = spark.range(n).withColumn("x", F.col("id"))
        got = [r["x"] for r in mixing.permuted(df, "x", F.lit(n), F.lit(3)).orderBy("id").collect()]
        assert sorted(got) == list(range(n)) and (n < 7 or got != list(range(n)))


def test_mix_meets_targets_and_reruns_agree(spark):
    rng = random.Random(10)
    texts = ["w " * rng.randint(0, 400) for _ in range(600)]
    docs = corpus(spark, texts, source=lambda i: None if i % 50 == 0 else "abc"[0 if i % 2 else i % 3])
    rows = mixing.mix_sources(docs).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_sources(docs).collect()))
    assert all(0 <= r["taken"] <= 2 * r["size"] and r["size"] == len(words(texts[r["doc_id"]])) for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(t) - target) <= 200 for (_, target), t in by.items())
    mix = mixing.Mix(docs, shard_slots=100)
    counts = mix.shard_counts().collect()
    assert sum(r["blocks"] for r in counts) == mix.n_slots and mix.drawn().agg(F.max("times")).first()[0] <= 2


def test_mixed_documents_hold_the_words_taken(spark):
    rng = random.Random(11)
    texts = [" ".join(f"w{i}_{j}" for j in range(rng.randint(1, 400))) for i in range(80)]
    docs = corpus(spark, texts, source=lambda i: "ab"[i % 2])
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs).collect()}
    got = Counter()
    for r in mixing.mixed_documents(docs).collect():
        own = words(r["text"])
        got[r["doc_id"]] += len(own)
        assert own == sorted(own, key=lambda w: int(w.split("_")[1])) and all(w.startswith(f"w{r['doc_id']}_") for w in own)
    assert all(got[i] == n for i, n in taken.items())


# --- 10 token ids ------------------------------------------------------------------------------------------------------


def test_token_ids_round_trip(spark, odd_docs, prose):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(12)
    bits = [" ", "  ", "\n", "'s", "a", "bc", "Z", "1", "!", "é", "漢", "🙂", " ", "<|endoftext|>", "\r\n", "\x1c", "　"]
    texts = prose + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(500)] + ["", None]
    out = common.new_path(spark, "ids")
    token_ids.write_token_ids(corpus(spark, texts), path, out)
    at = 0
    for r in token_ids.token_digests(spark, out).orderBy("doc_id").collect():
        ids = lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    odd = common.new_path(spark, "ids")
    token_ids.write_token_ids(odd_docs, path, odd)
    assert token_ids.token_digests(spark, odd).count() == odd_docs.count()


def test_files_are_in_order_with_indexes_and_dictionaries(spark, prose):
    import glob

    out = common.new_path(spark, "ids")
    token_ids.write_token_ids(corpus(spark, prose), P.path("byte_bpe_50k.json"), out)
    last = -1
    for f in sorted(glob.glob(f"{out}/part-*.parquet")):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            columns = [meta.row_group(g).column(c) for c in range(meta.num_columns)]
            assert all(c.has_column_index and c.has_offset_index for c in columns)
            assert any("DICTIONARY" in e or "DELTA" in e for e in columns[2].encodings)
            assert columns[0].statistics.min > last
            last = columns[0].statistics.max
    assert token_ids.read_token_ids(spark, out, ("doc_id", "n_tokens")).where("doc_id = 5").count() == 1


def test_surplus_slots_go_to_sources_that_lack_some(spark):
    wanted, drawn = [5, 0, 7, 2, 6], [8, 2, 3, 2, 5]
    slots = spark.createDataFrame([(i, j) for i, n in enumerate(drawn) for j in range(n)], "s int, j long")
    got = [(r["s"], r["j"]) for r in mixing.repaired(slots, wanted).collect()]
    assert sorted(got) == [(i, j) for i, n in enumerate(wanted) for j in range(n)]
    kept = {(i, j) for i, n in enumerate(drawn) for j in range(min(n, wanted[i]))}
    assert kept <= set(got)


def test_rows_keep_their_keys_when_files_are_cut_otherwise(spark, tmp_path):
    spark.range(20_000).withColumn("text", F.repeat(F.lit("ab "), 60)).repartition(7).write.parquet(str(tmp_path / "d"))
    read = lambda: common.with_row_keys(spark.read.parquet(str(tmp_path / "d")))
    seen = []
    for size in ("16k", "64m", "3k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        docs, keys = read()
        seen.append({(r[0], r[1]): r[2] for r in docs.select(*keys, "id").collect()})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 20_000
