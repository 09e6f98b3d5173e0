import collections
import gzip
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from hemicycle.llm import chat, mixing, ngram_lm, quality, simhash, token_bins, token_counts, topk, warc
from hemicycle.llm import sentencepiece_scan as sps

DOC = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = ["", None, " \n\t ", "one", "a b c", "a  b\n c\xa0d", "x <|endoftext|> y", "Ünïcode 漢字 naïve’s 3² don't", "the cat sat on the mat. " * 40, "w " * 5000, "zz" * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(EDGE)]
    words = ["the", "of", "ander", "ing", "Aou", "lé", "zu", "ver.", "##", "12"]
    rows += [(100 + i, " ".join(rng.choice(words) + rng.choice(["", "x", "yz"]) for _ in range(rng.randint(1, 300))), "de", rng.choice(["a", "b", None, "Z"]), 1) for i in range(60)]
    rows += [(None, "null id", None, None, None), (100, rows[11][1], None, "a", None), (7, "again", None, "b", None)]
    df = spark.createDataFrame(rows, DOC)
    return df.withColumns({"u": F.lit(1), "row": F.lit("clash"), "n": F.lit(2)})


def empty(spark):
    return spark.createDataFrame([], DOC)


def test_maxscore(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")]), (400, []), (500, [2.0] * 8), (501, [2.0] * 8), (501, [2.0] * 8), (None, [1.0]), (600, [0.5] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    v = topk.usable_vectors(df)
    got = topk.top_k(v, v.where("vec_id % 100 = 0"), shard_rows=40, block_rows=3).collect()
    full = [(i, np.floor(1024 * np.array(np.float32(e), float))) for i, e in rows if i is not None and e is not None and None not in e and not any(np.isnan(x) for x in e)]
    for q, qv in full:
        if q % 100 == 0:
            s = sorted((-int(sum(a * b for a, b in zip(qv, cv, strict=False))), c) for c, cv in full if c != q)[:10]
            assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == s
    assert topk.top_k(v.where("vec_id < 0"), v.where("vec_id < 0")).count() == 0


def test_mixing(spark, docs):
    got = mixing.mix(docs).collect()
    again = {(r.doc_id, r.source, r.size): r.taken for r in mixing.mix(docs.repartition(5)).collect()}
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        assert r.taken <= 2 * r["size"] and again[(r.doc_id, r.source, r["size"])] == r.taken
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weights, want = dict(zip(names, [3, 1, 2] * 9, strict=False)), {}
    left, free = 1.5 * sum(size.values()), set(names)
    while True:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level >= 2 * size[s]}
        if not over:
            break
        left, free = left - sum(2 * size[s] for s in over), free - over
        want |= {s: 2.0 * size[s] for s in over}
    want |= {s: weights[s] * level for s in free}
    assert target == pytest.approx(want)
    longest = max(r["size"] for r in got)
    assert all(abs(taken[s] - want[s]) <= longest for s in names)
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mixed(docs).count() == sum(r.copies for r in got)
    assert mixing.mix(empty(spark)).count() == 0


def test_sentencepiece(spark, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sps.PieceModel(path)
    got = sps.encode(docs, path, chunk_chars=60).collect()
    assert len(got) == docs.count()
    want = collections.Counter((r.doc_id, tuple(model.sp.encode(r.text or "")), model.sp.decode(model.sp.encode(r.text or ""))) for r in docs.collect())
    assert collections.Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.decoded) for r in got) == want
    assert sps.encode(empty(spark), path).count() == 0


def test_max_plus_is_associative():
    rng = np.random.default_rng(1)
    a, b, c = (np.where(rng.random((5, 5)) < 0.5, 0, sps.NONE).astype(np.float32) for _ in range(3))
    assert np.array_equal(sps.max_plus(sps.max_plus(a, b), c), sps.max_plus(a, sps.max_plus(b, c)))


def test_kneser_ney_sums_to_one(spark, docs):
    model = ngram_lm.train(docs.where(~ngram_lm.held_out()))
    got = ngram_lm.score(docs, model).collect()
    toks = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + ["\n"]
    rows = docs.collect()
    train = [toks(r.text) for r in rows if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    c1 = collections.Counter(w for t in train for w in t)
    c2 = collections.Counter(p for t in train for p in zip(["\n", *t], t, strict=False))
    cont = collections.Counter(b for _, b in c2)
    kinds = collections.defaultdict(lambda: [0, 0, 0])
    for (a, _), n in c2.items():
        kinds[a][min(n, 3) - 1] += 1
    count = lambda c: ngram_lm.discounts(*(sum(n == i for n in c.values()) for i in (1, 2, 3, 4)))
    d2, d1 = count(c2), count(cont)
    types, v = len(c2), len(c1)
    uniform = sum(d1[min(n, 3) - 1] for n in cont.values()) / types / (v + 1)
    low = lambda w: (cont[w] - d1[min(cont[w], 3) - 1]) / types + uniform if w in cont else uniform

    def p(a, w):
        if a not in c1:
            return low(w)
        n = c2.get((a, w), 0)
        return (n - (d2[min(n, 3) - 1] if n else 0)) / c1[a] + sum(x * y for x, y in zip(d2, kinds[a], strict=True)) / c1[a] * low(w)

    assert sum(p("the", w) for w in c1) + p("the", "never seen") == pytest.approx(1)
    want = collections.Counter()
    for r in rows:
        t = toks(r.text)
        want[(r.doc_id, len(t), round(sum(np.log10(p(a, b)) for a, b in zip(["\n", *t], t, strict=False)), 5))] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, round(r.score, 5)) for r in got) == want
    assert {r.train_tokens for r in got} == {sum(c1.values())}
    assert ngram_lm.score(docs, ngram_lm.train(empty(spark))).select(F.sum("score")).first()[0] == 0


def test_chat(spark):
    c = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 2, "user", "more"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 2, "user", "more"), (4, 0, "user", None), (5, 0, None, ""), (6, 0, "user", "hi"), (6, 1, "assistant", "no"), (None, 0, "user", "lost")]
    c += [(9, i, "user", f"t{i % 3}") for i in range(1100)]
    df = spark.createDataFrame(c, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("clash")).repartition(5)
    got = {(r.conv_id, r.segment): r for r in chat.format_chats(df).collect()}
    assert sorted((k for k in got if k[0] is not None)) == [(2, 0), (4, 0), (5, 0), (6, 0), (9, 0), (9, 1), (9, 2)] and (None, 0) in got
    assert got[(2, 0)].copies == 2 and got[(2, 0)].text.count("<|im_start|>") == 3
    assert got[(4, 0)].text == "<|im_start|>user\n<|im_end|>\n"
    assert chat.format_chats(df.where("conv_id = -1")).count() == 0


def test_token_counts(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    want = collections.Counter((r.doc_id, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, path).collect()) == want
    assert token_counts.token_counts(empty(spark), path).count() == 0


def test_warc(spark):
    rows = [(1, "http://www.a.org/x", "same"), (2, "http://b.org/", "same"), (5, "http://a.org/x#f", "same"), (3, None, None), (4, "u", ""), (6, "http://z.org", "only é"), (None, "n", "same"), (6, "http://z.org", "only é")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumn("l", F.lit(1))
    manifest = warc.write_archives(df)
    got = warc.read_captures(manifest).collect()
    kinds = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got}
    assert len(got) == len(rows)
    assert kinds == {(1, "revisit", 5, 4), (2, "revisit", 5, 4), (5, "response", None, 4), (3, "revisit", 4, 0), (4, "response", None, 0), (6, "response", None, 7), (None, "revisit", 5, 4)}
    order = [(r.url_key, r.captured) for r in sorted(got, key=lambda r: (r.range, r.place))]
    assert order == sorted(order)
    name = manifest.first().archive.removeprefix("file:")
    assert gzip.open(name).read(8) == b"WARC/1.1"
    assert warc.read_captures(warc.write_archives(df.where("page_id < 0"))).count() == 0


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randint(0, 50) for _ in range(rng.randint(0, 40))) for _ in range(k)]
        assert list(warc.loser_tree(runs)) == sorted(x for r in runs for x in r)
    packed = io.BytesIO(b"".join(gzip.compress(warc.record(i, "u", b"x" * i, i, "D", None)) for i in range(5)))
    assert [len(block.partition(b"\r\n\r\n")[2]) for _, _, _, block in warc.read_records(packed, 7)] == list(range(5))


@pytest.mark.parametrize("radius", [0, 4, 12])
def test_near_pairs(radius):
    rng = np.random.default_rng(radius)
    x = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    x[300:500] = x[:200] ^ (np.uint64(1) << rng.integers(0, 63, 200).astype(np.uint64))
    x = x[np.argsort(simhash.gray_rank(x))]
    want = {(i, j) for i in range(700) for j in range(i + 1, 700) if int(x[i] ^ x[j]).bit_count() <= radius}
    got = {(i, j) for p, q in simhash.near_pairs(x, None, radius) for i, j in zip(p.tolist(), q.tolist(), strict=True)}
    assert got == want
    a, b = x[::2], x[1::2]
    cross = {(i, j) for i in range(len(a)) for j in range(len(b)) if int(a[i] ^ b[j]).bit_count() <= radius}
    assert {(i, j) for p, q in simhash.near_pairs(a, b, radius) for i, j in zip(p.tolist(), q.tolist(), strict=True)} == cross


def test_simhash_components(spark, docs):
    got = simhash.simhash_components(docs).collect()
    fp = {}
    for r in docs.collect():
        fp.setdefault(simhash.majority(simhash.shingle_hashes(r.text or "", 4)), []).append(r.doc_id)
    up = {f: f for f in fp}
    find = lambda f: f if up[f] == f else find(up[f])
    for a in fp:
        for b in fp:
            if (a ^ b).bit_count() <= 4:
                up[find(a)] = find(b)
    least = collections.defaultdict(list)
    for f, ids in fp.items():
        least[find(f)] += [i for i in ids if i is not None]
    want = collections.Counter((i, f"{f:016x}", min(least[find(f)], default=None)) for f, ids in fp.items() for i in ids)
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert simhash.simhash_components(empty(spark)).count() == 0


def test_blocks_agree(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(-(1 << 62), 1 << 62, 300)
    x = np.unique(np.concatenate([base, base ^ (1 << rng.integers(0, 62, 300)), base ^ 7]))
    nodes = spark.createDataFrame([(int(v), int(v)) for v in x], "node long, f0 long")
    roots = lambda block: sorted(map(tuple, simhash.components(simhash.link_nodes(nodes, 4, block=block, most_blocks=1000)).collect()))
    assert roots(50) == roots(10_000)


def test_near_copies(spark):
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(400))
    base = [text() for _ in range(30)]
    near = [b.replace(b.split()[50], "changed") for b in base[:10]]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([*base, *near, base[20].upper(), base[20]])] + [(3, base[3], "en", "s", 0), (None, "", None, None, None), (90, None, None, None, None)]
    out = simhash.drop_near_copies(spark.createDataFrame(rows, DOC))
    assert sorted((r.doc_id for r in out.collect())) == [*range(30), 90]
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert simhash.drop_near_copies(empty(spark)).count() == 0


def test_near_copies_by_exact_similarity(spark):
    rng = random.Random(11)

    def pair(changes):
        words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
        other = list(words)
        for i in range(changes):  # each changes five shingles of its own
            other[10 + 20 * i] = f"new{i}"
        return " ".join(words), " ".join(other)

    shingles = lambda t: set(zip(*(t.split()[i:] for i in range(5)), strict=False))
    pairs = [pair(n) for n in (6, 8, 9, 11) for _ in range(30)]  # similarity 0.859, 0.817, 0.796, 0.756
    rows = [(2 * i + j, t, "en", "s", 0) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, DOC)).collect()}
    linked = [0] * 4
    for i, (a, b) in enumerate(pairs):
        a, b = shingles(a), shingles(b)
        assert 2 * i in kept and (2 * i + 1 in kept or len(a & b) / len(a | b) >= 0.8)
        linked[i // 30] += 2 * i + 1 not in kept
    assert linked[0] >= 29 and linked[1] >= 27 and linked[2:] == [0, 0]


def test_near_copies_with_repeated_passage(spark):
    rng = random.Random(13)
    rows = []
    for i in range(10):
        words, passage = (["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)] for n in (304, 12))
        rows += [(2 * i, " ".join(words), "en", "s", 0), (2 * i + 1, " ".join(words + passage * 5), "en", "s", 0)]  # similarity 0.949
    out = simhash.drop_near_copies(spark.createDataFrame(rows, DOC))
    assert sorted(r.doc_id for r in out.collect()) == list(range(0, 20, 2))


def test_similar_pairs_in_cells(spark):
    rng = random.Random(12)
    base = [f"w{rng.random()}" for _ in range(120)]
    texts = []
    for _ in range(60):
        words = list(base)
        for at in rng.sample(range(120), rng.randint(0, 5)):
            words[at] = f"x{rng.random()}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOC)
    members = docs.select(F.col("doc_id").alias("node"), F.lit(0).cast("long").alias("root"), F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__hash"))
    sets = [set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in texts]
    up = list(range(60))
    for i in range(60):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up = [up[i] if u == up[j] else u for u in up]
    want = sorted(sorted(i for i in range(60) if up[i] == u) for u in set(up))
    for cell in (512, 7):
        root = {r.node: r.root for r in simhash.components(simhash.similar_pairs(docs, members, 5, 80, cell=cell)).collect()}
        got = collections.defaultdict(list)
        for i in range(60):
            got[root.get(i, i)].append(i)
        assert sorted(got.values()) == want
    assert len(want) > 1


def test_token_bins(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    got = sorted(token_bins.read_token_files(token_bins.write_token_files(docs, path)).collect(), key=lambda r: r.start)
    ids = collections.Counter((r.doc_id, zlib.crc32(np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in docs.collect())
    assert collections.Counter((r.doc_id, r.ids_crc32) for r in got) == ids
    order = [r.doc_id for r in got]
    assert order == [*sorted(x for x in order if x is not None), None]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert token_bins.read_token_files(token_bins.write_token_files(empty(spark), path)).count() == 0


def test_quality(spark, docs):
    labels = spark.createDataFrame([(100 + i, int(i % 3 > 0), 0) for i in range(60)] + [(None, 1, None)], "doc_id long, quality int, toxic int")
    ratios = quality.fit(docs, labels, bits=12)
    got = quality.judge(docs, ratios).collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id not in (7, 100, None)}
    for r in got:
        if r.doc_id not in texts:
            continue
        t = texts[r.doc_id]
        w = t.encode().split()
        win = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {j for i in range(len(w) - 2) if win[(w[i], w[i + 1], w[i + 2])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and (not r.kept or not r.base_failed)
    assert not quality.fit(docs, labels.where("quality = 9"), bits=12).any()
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in quality.judge(docs, quality.fit(docs, labels)).collect())
    assert quality.keep_good(empty(spark), labels).count() == 0
