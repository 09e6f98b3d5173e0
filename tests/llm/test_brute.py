"""Operators and the pipeline against plain re-computations on small tables."""

import base64
import collections
import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from hemicycle.llm import mixing, quality, simhash, token_counts, topk, warc
from hemicycle.llm import sentencepiece_scan as sps
from hemicycle.llm._shared import mix64
from hemicycle.llm.bytelevel import PreTokens

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, letters="abcdefgh"):
    return ["".join(rng.choice(letters) for _ in range(6)) for _ in range(n)]


def shingles(text, k=5):
    w = text.encode().lower().split()
    return set(zip(*(w[i:] for i in range(k)), strict=False)) or ({tuple(w)} if w else set())


def test_maxscore_skips_postings_and_stays_exact():
    rng = np.random.default_rng(2)
    rows = np.floor(1024 * rng.normal(size=(512, 16)) * np.array([4, 2, 1] + [0.2] * 13))
    shard = topk.Shard(np.arange(512), rows)
    for q in np.floor(1024 * rng.normal(size=(20, 16))):
        full = sorted(((-int(s), i) for i, s in enumerate(rows @ q)))[:10]
        ids, scores = shard.search(q, -1, float(-full[9][0]), 10)
        assert sorted((-int(s), int(i)) for i, s in zip(ids, scores, strict=True)) == full
    assert shard.seen < 0.7 * shard.there
    none, _ = shard.search(np.ones(16), -1, 1e12, 10)
    assert len(none) == 0


def test_topk_with_few_vectors_and_clashing_columns(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("ids", "group", "width", "data", "block", "shard")})
    v = topk.usable_vectors(df)
    got = topk.top_k(v, v.where("vec_id = 0"), sample_rows=3).collect()
    want = sorted((-1024 * 1024, i) for i in range(1, 7))
    assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == want
    assert topk.top_k(topk.usable_vectors(df.where("vec_id = 0")), v.where("vec_id = 0")).count() == 0


def test_mix_rates_and_cuts(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), "en", rng.choice(["a", "b", None]), 0) for i in range(900)] + [(5000, None, None, "z", 0)]
    got = mixing.mix(spark.createDataFrame(rows, DOC)).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for rs in by.values():
        size, target = sum(r["size"] for r in rs), rs[0].target
        assert all(r.source_size == size for r in rs)
        rate = target / size if size else 0
        assert all(r.rate == pytest.approx(rate, abs=1e-8) for r in rs)
        assert all(r.copies in (math.floor(rate + 1e-9), math.ceil(rate - 1e-9)) for r in rs)
        assert abs(sum(r.taken for r in rs) - target) <= 60
    assert {r.source: r.copies for r in got if r.doc_id == 5000} == {"z": 0}


def test_quality_score_by_definition(spark):
    rng = random.Random(9)
    good, poor = words(rng, 300), words(rng, 300, "mnopqrst")
    rows = [(i, " ".join(rng.choices(good if i % 2 else poor, k=rng.randint(0, 120))), "en", "s", 0) for i in range(80)] + [(200, None, None, None, 0)]
    labels = [(i, i % 2, 0) for i in range(40)] + [(41, 1, 1), (99, 1, 0)]
    docs, marks = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    bits = 12
    h = lambda w: xxhash.xxh64_intdigest(w)

    def grams(text):
        each = [h(w) for w in (text or "").encode().split()]
        pairs = [int(mix64(np.array([(a * 0x9E3779B97F4A7C15 + b) % 2**64], np.uint64))[0]) for a, b in zip(each, each[1:], strict=False)]
        return [x >> (64 - bits) for x in each + pairs]

    raw, trusted = collections.Counter(), collections.Counter()
    picked = {i for i, q, t in labels if q == 1 and t == 0}
    for i, text, *_ in rows:
        raw.update(grams(text))
        trusted.update(grams(text) if i in picked else [])
    n, m, size = sum(raw.values()), sum(trusted.values()), 1 << bits
    gain = lambda g: math.log((trusted[g] + 1) / (m + size)) - math.log((raw[g] + 1) / (n + size))
    got = {r.doc_id: r for r in quality.judge(docs, quality.fit(docs, marks, bits), threshold=-0.05).collect()}
    kept = 0
    for i, text, *_ in rows:
        g = grams(text)
        score = sum(map(gain, g)) / max(len(g), 1)
        assert got[i].score == pytest.approx(score, abs=1e-5)
        assert got[i].kept == (not got[i].base_failed and score >= -0.05)
        kept += got[i].kept
    assert 0 < kept < len(rows)


def test_warc_by_brute_force(spark):
    rng = random.Random(10)
    pool = ["", "x", "é" * 50, "<p>" * 2000, *(f"page {i}" for i in range(30))]
    rows = [(rng.randint(0, 400), rng.choice([None, "http://a.org/", "https://www.b.org:443/x", f"http://c{rng.randint(0, 9)}.net/{rng.randint(0, 99)}"]), rng.choice([None, *pool])) for _ in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6).withColumns({c: F.lit(1) for c in ("digest", "length", "range", "file", "chosen", "d")})
    chosen, n = {}, collections.Counter((h or "") for _, _, h in rows)
    for i, _, h in rows:
        chosen[h or ""] = max(chosen.get(h or "", -1), i)
    want = collections.Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        other = n[h or ""] > 1 and chosen[h or ""] != i
        want[(i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if other else "response", chosen[h or ""] if other else None)] += 1
    manifest = warc.write_archives(df)
    for run_rows, fan_in in ((50_000, 128), (7, 4)):  # one run an archive; many small ones, merged in passes
        got = warc.read_captures(manifest, run_rows, fan_in).collect()
        assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
        ranked = sorted(got, key=lambda r: (r.range, r.place))
        assert [(r.url_key, r.captured, r.page_id) for r in ranked] == sorted((r.url_key, r.captured, r.page_id) for r in got)


def test_token_counts_of_all_scripts(spark):
    from tokenizers import Tokenizer

    texts = ["Привет, мир! <|endoftext|>да", "emoji 😀😀 x", "漢字かな交じり文 and English", "ﬁ ligature é café", "a b c", "<|startoftext|><|endoftext|>", "<|endoftext", "price 5 € 10", "\x00 nul", "x" * 40_000, "A  B\n\n C'S 12٣4", None, ""]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOC).withColumns({"token": F.lit("clash"), "n_bytes": F.lit(5), "bucket": F.lit(1)})
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        t = Tokenizer.from_file(path)
        want = {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}
        assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path).collect()} == want
        pre = PreTokens(path)
        assert pre.split is not None and not pre.whole_only
        for x in texts:
            ids = [i for p in pre.parts(x or "") for i in ([p] if isinstance(p, int) else [y for tok in p for y in pre.pieces(tok)])]
            assert ids == t.encode(x or "", add_special_tokens=False).ids


def test_sentencepiece_beyond_the_default_chunk(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sps.PieceModel(path)
    rng = random.Random(12)
    texts = [" ".join(words(rng, 14_000, "abcdeé漢")), "abcab" * 9000]
    assert min(map(len, texts)) > 32_768
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOC).withColumns({"row": F.lit(0), "chunk": F.lit("c"), "ids": F.lit(1)})
    got = {r.doc_id: r for r in sps.encode(docs, path).collect()}
    for i, t in enumerate(texts):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == model.sp.encode(t) and got[i].decoded == model.sp.decode(model.sp.encode(t))


def near_copy_table(rng):
    """Texts with copies at similarities on both sides of 0.8, by changed, cut, added and repeated words."""
    texts = []
    for i in range(60):
        base = words(rng, rng.randint(60, 500))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            new, share = list(base), rng.choice([0.005, 0.01, 0.015, 0.02, 0.025, 0.04])
            kind = rng.randrange(4)
            if kind == 0:
                for at in rng.sample(range(len(new)), max(1, int(share * len(new)))):
                    new[at] = f"n{rng.random()}"
            elif kind == 1:
                new = new[int(8 * share * len(new)) :]
            elif kind == 2:
                new += words(rng, int(8 * share * len(new)))
            else:
                new += new[:12] * 4
            texts.append(" ".join(new))
    return texts


def test_near_copies_against_brute_force(spark):
    rng = random.Random(14)
    texts = near_copy_table(rng) + ["", "one two", "ONE TWO", "x y z"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    order = list(range(len(texts)))
    sets = [shingles(t) for t in texts]
    up = list(order)
    find = lambda a: a if up[a] == a else find(up[a])
    pairs = []
    for i in order:
        for j in range(i):
            if texts[i].lower().split() == texts[j].lower().split() or (sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])):
                pairs.append((i, j))
                up[max(find(i), find(j))] = min(find(i), find(j))
    docs = spark.createDataFrame(rows, DOC).withColumns({c: F.lit("clash") for c in ("content", "root", "node", "kept", "text_hash", "cell", "stays", "row")}).repartition(5)
    out = simhash.drop_near_copies(docs)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    least = {find(i): min(j for j in order if find(j) == find(i)) for i in order}
    assert kept >= set(least.values())  # nothing goes that is not linked at 0.8 or more
    caught = sum(not (i in kept and j in kept) for i, j in pairs)
    assert len(pairs) > 60 and caught >= 0.97 * len(pairs)


def test_hot_groups_keep_their_links(spark):
    """A third of the rows in one group: thinned out, cut into cells, joined by representatives."""
    rng = random.Random(15)
    base = words(rng, 150)
    texts = []
    for _ in range(90):
        new = list(base)
        for at in rng.sample(range(150), 1):
            new[at] = f"n{rng.random()}"
        texts.append(" ".join(new))
    texts += [" ".join(words(rng, 150)) for _ in range(180)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOC)
    kept = {r.doc_id for r in simhash.drop_near_copies(docs, reps=4, salt_rows=100, block=64).collect()}
    assert kept == {0, *range(90, 270)}


def test_thinned_groups_are_searched_in_every_index(spark):
    """Texts that link, in a later index, only with members that a large group's representatives stand for."""
    rng = random.Random(21)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    base = [rng.getrandbits(64) for _ in range(3)]
    rows = [[flip(base[0], 2), flip(base[1], 4), rng.getrandbits(64)] for _ in range(60)]
    rows += [[flip(rows[i][0], 20), rng.getrandbits(64), flip(rows[i][2], 3)] for i in range(0, 60, 5)]  # index 2 alone: 3 + 20 bits
    rows += [[rng.getrandbits(64) for _ in range(3)] for _ in range(40)]
    close = lambda x, y: any((x[i] ^ y[i]).bit_count() <= 13 and (x[i] ^ y[i]).bit_count() + (x[(i + 1) % 3] ^ y[(i + 1) % 3]).bit_count() <= 28 for i in range(3))
    up = list(range(len(rows)))
    for i in up[:]:
        for j in range(i):
            if close(rows[i], rows[j]):
                up = [up[j] if u == up[i] else u for u in up]
    assert max(collections.Counter(up).values()) == 72
    signed = lambda x: x - (x >> 63 << 64)
    nodes = spark.createDataFrame([(i, *map(signed, r)) for i, r in enumerate(rows)], "node long, f0 long, f1 long, f2 long")
    for reps, salt_rows in ((2, 1000), (2, 20), (1, 7)):
        root = {r.node: r.root for r in simhash.components(simhash.candidate_links(nodes, 0, 3, 13, 28, reps, salt_rows)).collect()}
        got = [root.get(i, i) for i in range(len(rows))]
        assert all((got[i] == got[j]) == (up[i] == up[j]) for i in range(len(rows)) for j in range(i))


def test_index_plan():
    assert simhash.meeting(0, 64, 128, 80) == pytest.approx(1)
    found = [simhash.plan_indexes(n, 13, 28, 80, 0.98, 4096) for n in (0, 1, 4096, 10**5, 10**7, 10**9)]
    assert [x[0] for x in found] == [0, 0, 0, 5, 12, 18] and [x[1] for x in found] == sorted(x[1] for x in found)
    for bits, indexes in found:
        assert 1 - (1 - simhash.meeting(bits, 13, 28, 80)) ** indexes >= 0.98


def test_pipeline_end_to_end(spark, tmp_path):
    rng = random.Random(16)
    vocabulary = words(rng, 400)
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    rows = [(i, text(rng.randint(60, 200)), "en", rng.choice(["a", "b", None]), 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "a", 0) for i in range(10)]  # exact copies
    rows += [(200 + i, rows[i][1] + " and more", "en", "b", 0) for i in range(5)]  # near copies
    rows += [(300, None, None, None, None), (301, "", "en", "a", 0), (302, "too short", "en", "b", 0), (303, "same words here " * 60, "en", "a", 0), (7, rows[7][1], "en", rows[7][3], 0), (None, text(80), None, "b", None)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = docs
    sizes = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, str(tmp_path))
        assert seen.columns == docs.columns
        sizes[name] = collections.Counter((r.doc_id, r.text) for r in seen.collect())
    good, single, copies = sizes.values()
    assert not {300, 301, 302, 303} & {i for i, _ in good} and {i for i, _ in good} >= set(range(60))
    assert sorted(i for i, _ in single if i is not None) == list(range(60)) and max(single.values()) == 1
    assert set(copies) <= set(single) and max(copies.values()) <= 2
    model = sps.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    got = collections.Counter((r.doc_id, r.n_pieces, r.decoded_chars) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = collections.Counter()
    for (i, t), n in copies.items():
        ids = model.sp.encode(t)
        want[(i, len(ids), len(model.sp.decode(ids)))] += n
    assert got == want
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
