"""The ten operators and the pipeline against brute force on small fixtures, and on edge rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import common, decontaminate, hnsw, langid, mincut, mixing, pieces, repeats, simhash, token_files, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long, id string, h string"


def words(rng, n, letters="abcdefghijklmnop"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [" ".join(words(rng, rng.choice([0, 1, 3, 30, 150, 400]))) for _ in range(40)]
    shared = " ".join(words(rng, 90))
    out = base + [base[7], base[20], base[20], base[33][:-9]]
    out += [f"{base[3]} {shared} {base[9]}", f"{shared[40:]} {base[11]}", "é" * 500 + base[12], "é" * 450, "xy" * 400]
    return [*out, None, "", " \n\t", "über straße äöü"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1], (None, "a null id", None, None, None, None, None)], DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


# ---------------------------------------------------------------- components and SimHash


def test_components_by_rounds_and_at_once(spark, docs):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, x) for x in range(5001, 5100)]
    df = spark.createDataFrame(edges, "u long, v long")
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    for finish in (0, 40, 10**6):
        got = dict(map(tuple, common.connected_components(df, common.Scratch(spark, "cc"), finish).collect()))
        groups = lambda label: sorted(sorted(x for x in label if label[x] == r) for r in set(label.values()))
        assert groups(got) == groups({x: find(x) for a, b in edges if a != b for x in (a, b)})


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints(spark, docs, texts):
    got = {r.id: r.fp for r in simhash.fingerprints(docs).collect()}
    assert all(got[i] % 2**64 == brute_fingerprint(t) for i, t in enumerate(texts))


@pytest.mark.parametrize("m", [5, 6, 7, 8])
def test_block_masks_lose_no_pair(m):
    rng = random.Random(m)
    masks = simhash.block_masks(m, 4)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        assert any((a & x % 2**64) == (b & x % 2**64) for x in masks)


@pytest.mark.parametrize("chunk", [4, 1024])
def test_links_in_dense_groups(spark, chunk):
    rng = random.Random(3)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(40):
            y = x
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                y ^= 1 << bit
            fps.add(y)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = simhash.links(df, len(signed), 4, chunk)
    label = {x: x for x in signed} | dict(map(tuple, common.connected_components(got, common.Scratch(spark, "x")).collect()))
    a = np.array(signed)
    near = np.bitwise_count((a[:, None] ^ a[None, :]).view(np.uint64)) <= 4
    want = np.arange(len(a))
    while True:
        new = np.where(near, want[None, :], len(a)).min(1)
        if (new == want).all():
            break
        want = new
    for i in range(len(a)):
        for j in range(i):
            assert (want[i] == want[j]) == (label[signed[i]] == label[signed[j]])


def test_simhash_edges(spark, docs, empty, texts):
    rows = simhash.groups(docs).collect()
    assert len(rows) == len(texts) + 2
    zero = [r.id for r in rows if r.fp == 0]
    assert {r.component for r in rows if r.fp == 0} == {min(zero)}
    assert simhash.groups(empty).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    comps = {r.component for r in rows}
    assert kept.count() == len(comps)


# ---------------------------------------------------------------- repeats


def brute_repeats(texts, least, first):
    seen = Counter(t[p : p + least] for t in texts for p in range(len(t) - least + 1))
    done, out = set(), []
    for t in texts:
        cover = np.zeros(len(t), bool)
        for p in range(len(t) - least + 1):
            s = t[p : p + least]
            if seen[s] > 1 and (not first or s in done):
                cover[p : p + least] = True
            done.add(s)
        out.append(bytes(np.frombuffer(t, np.uint8)[~cover]))
    return out


@pytest.mark.parametrize("keep,bucket", [("none", 1 << 16), ("none", 2), ("first", 1 << 16), ("first", 2)])
def test_repeats(spark, texts, keep, bucket):
    own = [t or "" for t in texts]
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    spans = {r.id: r.spans for r in repeats.repeated_spans(df, keep=keep, bucket=bucket, least=80, gram=16).collect()}
    raw = [t.encode() for t in own]
    want = brute_repeats(raw, 80, keep == "first")
    for i, t in enumerate(raw):
        assert repeats.cut(t, spans.get(i)) == want[i], i


def test_repeats_edges(spark, docs, empty):
    assert repeats.repeated_spans(empty).count() == 0
    out = repeats.deduplicated(docs, keep="first")
    assert out.columns == docs.columns and out.count() == docs.count()
    assert repeats.whole_characters("é".encode() * 3, [{"start": 1, "end": 5}]) == [{"start": 2, "end": 4}]


def test_repeats_of_repeated_rows(spark):
    rng = random.Random(13)
    shared = " ".join(words(rng, 120))
    rows = [(i, f"{' '.join(words(rng, 60))} {shared} {' '.join(words(rng, 60))}") for i in range(3)]
    spans = lambda x: {(r.id, r.h, tuple(map(tuple, r.spans))) for r in repeats.repeated_spans(spark.createDataFrame(x, "doc_id long, text string"), keep="first").collect()}
    got = spans([*rows, *rows])
    assert got == spans(rows) and {x[0] for x in got} == {1, 2}


@pytest.mark.parametrize("keep,bucket", [("none", 1 << 16), ("none", 2), ("first", 1 << 16), ("first", 2)])
def test_repeats_in_words(spark, texts, keep, bucket):
    """Runs of 12 words against every window of 12 words, white space taken as equal."""
    rng = random.Random(6)
    run = words(rng, 30, "abc")
    own = [t or "" for t in texts] + [" ".join(run[:20]), "x\t" + "\n ".join(run[5:]) + " é", " ".join([*run[:11], "y", *run[11:]]), "of " * 40, "of\nof " * 7, "of " * 11]
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    spans = {r.id: r.spans for r in repeats.repeated_spans(df, keep=keep, bucket=bucket, least=12 * repeats.WORD, gram=24, words=True).collect()}
    split = [t.encode().split() for t in own]
    seen, done = Counter(tuple(t[p : p + 12]) for t in split for p in range(len(t) - 11)), set()
    for i, t in enumerate(split):
        gone = set()
        for p in range(len(t) - 11):
            if seen[s := tuple(t[p : p + 12])] > 1 and (keep == "none" or s in done):
                gone |= set(range(p, p + 12))
            done.add(s)
        assert {p for x in spans.get(i, []) for p in range(x["start"], x["end"])} == gone, i


def test_passages_of_few_bytes_and_of_few_words(spark):
    """51 words of 152 bytes, and 4 words of 440: later copies go, whatever the white space; runs of 49 words stay."""
    import corpus_pipeline

    rng = random.Random(17)
    short = [rng.choice("abcdefgh") + rng.choice("éxyz") for _ in range(51)]
    long = " ".join("".join(rng.choice("abcdef") for _ in range(110)) for _ in range(4))
    under = " ".join(words(rng, 49, "mnop"))
    around = [" ".join(words(rng, 40)) for _ in range(8)]
    rows = [(1, f"{around[0]} {' '.join(short)} {around[1]}"), (2, f"{around[2]}|{chr(10).join(short)}|{around[3]} {long}"), (3, f"{around[4]}\n{'  '.join(short)}\n{around[5]} {under}"), (4, f"{around[6]} {under} {long} {around[7]}"), (5, None)]
    left = {r.doc_id: r for r in corpus_pipeline.passage_dedup(spark, spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long"), "").collect()}
    assert left[1].text == rows[0][1] and left[2].text == rows[1][1]  # in 2 it is 49 words, between two others
    assert left[3].text == f"{around[4]}\n\n{around[5]} {under}" and left[4].text.split() == f"{around[6]} {under} {around[7]}".split()
    assert all(r.n_chars == len(r.text or "") for r in left.values()) and len(left) == 5


# ---------------------------------------------------------------- decontamination


def test_containment(spark, docs, empty):
    rng = random.Random(9)
    item = words(rng, 30)
    other = words(rng, 60)
    near = item[:28] + ["zz", "zz"]  # 24 of 26 shingles
    far = item[:20] + words(rng, 10)  # 16 of 26
    rows = [(1, " ".join(other + item + other)), (2, " ".join(other + near)), (3, " ".join(other + far)), (4, "One, two; three!"), (5, None), (6, ""), (7, "two three four"), (1, "again"), (None, " ".join(item))]
    d = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(10, " ".join(item).upper()), (11, "two, three"), (12, None), (13, "..."), (14, "zero one two three four five")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.containment, 4) for r in decontaminate.contained_items(d, b).collect()}
    assert got == {(1, 10): 1.0, (2, 10): round(24 / 26, 4), (None, 10): 1.0, (4, 11): 1.0, (7, 11): 1.0}
    left = decontaminate.decontaminated(d, b)
    assert sorted(r.doc_id for r in left.collect()) == [3, 5, 6] and left.columns == d.columns
    assert decontaminate.contained_items(empty, b).count() == 0
    assert decontaminate.contained_items(d, b.limit(0)).count() == 0


def test_repeats_at_contract_size(spark, tmp_path):
    """The query itself, 400 bytes and all, against every window of a real table and of very long texts with odd repeats."""
    import duckdb

    rng = random.Random(21)
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    long = " ".join(words(rng, 30_000))
    rows += [(10_000, long), (10_001, f"{long[5_000:5_399]} x {long[9_000:9_401]}é" + "ü" * 300), (10_002, "ab" * 500), (10_003, long[-650:] + long[:450]), (10_004, None), (10_004, ""), (None, long[100_000:100_500])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(hashlib.blake2b(t[i : i + 400], digest_size=12).digest() for t in texts for i in range(len(t) - 399))
    want = []
    for (d, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - 399):
            if seen[hashlib.blake2b(t[i : i + 400], digest_size=12).digest()] > 1:
                gone[i] += 1
                gone[min(i + 400, len(t))] -= 1
        out = np.cumsum(gone)[:-1] > 0
        left = bytes(c for c, o in zip(t, out.tolist()) if not o)
        want.append((-1 if d is None else d, len(t), int(out.sum()), int((np.diff(np.r_[False, out].astype(int)) > 0).sum()), hashlib.sha256(left).hexdigest()))
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.query(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and sum(r[2] > 0 for r in want) > 10


def test_repeats_query_tells_passages_by_words(spark, tmp_path):
    """Runs of 50 words of under 400 bytes remove nothing, but their documents show them; against every window of 50 words."""
    import duckdb

    rng = random.Random(23)
    run = words(rng, 51, "ab")
    short = [w[:4] for w in run]
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    rows += [(10_000, f"{' '.join(words(rng, 40))} {' '.join(short)} {' '.join(words(rng, 40))}"), (10_001, "é\u00a0é " + "\n".join(short)), (10_002, " ".join(short[:49])), (10_003, "of " * 51), (10_004, None), (10_004, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    split = [(t or "").encode().split() for _, t in rows]
    seen, want = Counter(tuple(t[p : p + 50]) for t in split for p in range(len(t) - 49)), []
    for (d, _), t in zip(rows, split):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if seen[tuple(t[p : p + 50])] > 1:
                gone[p : p + 50] = True
        want.append((d, int(gone.sum()), int((np.diff(np.r_[False, gone].astype(int)) > 0).sum())))
    out = repeats.query(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_passage_words, r.n_passages) for r in out) == sorted(want)
    told = {r.doc_id: (r.n_removed, r.n_passage_words) for r in out}
    assert [told[d] for d in range(10_000, 10_004)] == [(0, 51), (0, 51), (0, 0), (0, 51)]


# ---------------------------------------------------------------- token files


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(token_files.vocabulary_path())
    sc = common.Scratch(spark, "tokens")
    extra = spark.createDataFrame([(100, "don't <|endoftext|> x" + "ab" * 60), (101, "Ärger naïve é 7,5%%%"), (102, "日本語 text")], "doc_id long, text string")
    df = docs.select("doc_id", "text").union(extra)
    files = sc.save(token_files.write(df, sc.path("f"), token_files.vocabulary_path(), length=16), "m")
    got = sorted(((r.id is not None, r.id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read(files).collect()), key=lambda r: r[2])
    at = 0
    for i, t in sorted(df.collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert got.pop(0)[1:] == (i, at, len(ids), zlib.crc32(ids))
        at += len(ids)
    f = token_files.TokenFile(files.first().path + ".tokens.arrow")
    assert all(len(f.sequence(i)) == len(f.mask(i)) == 16 for i in range(len(f)))
    assert sum(sum(f.mask(i).to_pylist()) for i in range(len(f))) == files.first().n_tokens
    assert token_files.read(sc.save(token_files.write(empty, sc.path("g"), token_files.vocabulary_path()), "n")).count() == 0


def test_token_words_join_as_whole_texts():
    """Cores, tails of signs and odd words against whole-text encoding, each text alone and in one run."""
    enc = token_files.WordEncoder(token_files.vocabulary_path())
    rng = random.Random(8)
    bits = ["don't", "'s", "it's.", "abc…", "…", "12.5,", "İstanbul", "ΑΣ.", "ﬁn", "e\u0301t\u00e9", "\x01", "a\x01b", "\t", "\r", "x\u2028y", "\u00a0", "((a))", "a_b-c", "--", "'", "a'.", "日本語。", "Ünï.", "Σ", "x" * 300 + ".", "7" * 90, "<|endoftext|>", "🙂!", ""]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 30))).replace("--", "\n") for _ in range(150)] + [" ".join(words(rng, 60_000)) + "!" * 999]
    whole = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    ids, counts = enc.encode(texts)
    assert counts.tolist() == [len(x) for x in whole] and ids.tolist() == [i for x in whole for i in x]
    assert all(enc.encode([t])[0].tolist() == x for t, x in zip(texts[:40], whole))


def test_token_files_are_bounded(spark):
    df = spark.createDataFrame([(i, "some words here " * (1 + i % 7)) for i in range(400)], "doc_id long, text string").repartition(1)
    sc = common.Scratch(spark, "tokens")
    got, rows = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(rows)
    spark.conf.set(rows, "9")
    for name, most in (("a", 150), ("b", 1 << 26)):
        files = sc.save(token_files.write(df, sc.path(name), token_files.vocabulary_path(), length=8, most=most), f"m{name}")
        got.append((files.count(), sorted(token_files.read(files).collect())))
    spark.conf.set(rows, kept)
    assert got[0][1] == got[1][1] and got[0][0] > got[1][0]


# ---------------------------------------------------------------- nearest neighbours


def test_hnsw_recall_and_ties(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(1500, 16))
    v[100:400] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(2000, [0.0] * 16), (2001, None), (2002, [float("nan")] * 16), (2050, v[7].tolist()), (None, v[3].tolist()), (7, v[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = common.Scratch(spark, "h").save(hnsw.build(df, shard=400), "i")
    got = {}
    for r in hnsw.search(index, df.where("vec_id % 50 = 0"), block=8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    full = np.vstack([v, v[7:8]])
    ids = np.array([*range(1500), 2050])
    unit = full / np.linalg.norm(full, axis=1, keepdims=True)
    hits = n = 0
    for q, found in got.items():
        s = unit @ unit[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -9
        want = ids[np.lexsort((ids, -np.round(s, 12)))[:5]]
        hits += len(set(want) & {x for x, _ in found})
        n += 5
        assert len(found) == 5 and all(abs(sc - s[np.flatnonzero(ids == x)[0]]) < 1e-9 for x, sc in found)
    assert len(got) == 31 and hits / n >= 0.9
    assert [x for x, _ in got[100]] == [101, 102, 103, 104, 105] and got[2050][0][0] == 7
    none = df.limit(0)
    assert hnsw.search(common.Scratch(spark, "h").save(hnsw.build(none), "i"), none).count() == 0


def test_hnsw_scores_of_huge_and_tiny_vectors(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 0.0]), (2, [3.0, 3.0]), (3, [0.0, -5e-310]), (4, [1.0]), (50, [2e200, 2e200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id, round(r.score, 9)) for r in hnsw.search(hnsw.build(df), df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    half = round(0.5**0.5, 9)
    assert got == [(0, 2, 1.0), (0, 50, 1.0), (0, 1, half), (0, 3, -half), (50, 0, 1.0), (50, 2, 1.0), (50, 1, half), (50, 3, -half)]


def test_hnsw_recall_at_shard_size():
    """A whole shard of clustered vectors against brute force."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 64))
    v = centres[rng.integers(0, 60, hnsw.SHARD)] + 0.4 * rng.normal(size=(hnsw.SHARD, 64))
    levels, links = hnsw.build_graph(v)
    unit = hnsw._unit(v)
    q = np.arange(0, hnsw.SHARD, 50)
    found = hnsw.walk(unit.astype(np.float32), levels, links, unit[q].astype(np.float32), hnsw.EF)
    exact = np.argsort(-(unit[q] @ unit.T), axis=1)[:, :6]
    assert sum(len(set(e) & set(f)) for e, f in zip(exact.tolist(), found.tolist())) / exact.size >= 0.9


# ---------------------------------------------------------------- pieces


def test_pieces_lossless_and_reproducible(spark, docs, texts):
    rows = pieces.segmented(docs, keep=["doc_id", "text"]).collect()
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.vocabulary_path())
    assert len(rows) == len(texts) + 2 and all(r.lossless for r in rows)
    assert all(sp.decode(list(r.pieces)) == (r.text or "") for r in rows)
    again = {(r.doc_id, r.text): r.pieces for r in pieces.segmented(docs.repartition(3)).collect()}
    assert all(again[r.doc_id, r.text] == r.pieces for r in rows)
    lat = pieces.Lattice(pieces.vocabulary_path(), 0.5)
    odd = ["a▁b  c", "퟿\n\n ", "x" * 200 + " 😀", "▁"]
    assert [lat.decode(x) for x in lat.encode(odd, np.arange(4, dtype=np.uint64))] == odd


def test_pieces_distribution():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.vocabulary_path())
    weight = {sp.id_to_piece(i): (-sp.get_score(i) + 10) ** -0.5 for i in range(259, sp.get_piece_size())}

    def paths(s):
        if not s:
            yield (), 1.0
        for k in range(1, len(s) + 1):
            if s[:k] in weight:
                for rest, p in paths(s[k:]):
                    yield (s[:k], *rest), p * weight[s[:k]]

    want = dict(paths("▁there"))
    total, n = sum(want.values()), 40_000
    keys = np.array([pieces.row_key(i, 3) for i in range(n)], np.uint64)
    for long in (False, True):
        lat = pieces.Lattice(pieces.vocabulary_path(), 0.5)
        if long:
            lat.add_long("▁there")
        got = Counter(tuple(sp.id_to_piece(i) for i in x.tolist()) for x in lat.encode(["there"] * n, keys))
        assert max(abs(got[k] / n - w / total) for k, w in want.items()) < 0.01 and set(got) <= set(want)
    best = pieces.Lattice(pieces.vocabulary_path(), None).encode(["there"], keys[:1])[0]
    top = max(want, key=lambda k: math.prod(weight[x] ** 2 for x in k))
    assert tuple(sp.id_to_piece(i) for i in best.tolist()) == top


def test_pieces_long_units_as_short_ones():
    rng = random.Random(12)
    units = ["▁" + "there" * 20, "▁https://example.org/" + "".join(rng.choice("abcdefgh/-é漢") for _ in range(150)), "▁" + "e" * 70]
    for alpha in (0.5, None):
        for unit in units:
            one, other = (pieces.Lattice(pieces.vocabulary_path(), alpha) for _ in range(2))
            one.add([unit])
            other.add_long(unit)
            assert np.array_equal(one.code.values, other.code.values) and np.array_equal(one.back.values, other.back.values)
            assert np.allclose(one.share.values, other.share.values, rtol=0, atol=1e-9)
    lat = pieces.Lattice(pieces.vocabulary_path(), 0.5)
    lat.add_long("漢" + "there" * 2000)  # far beyond the range of plain floats
    assert np.isfinite(lat.share.values).all()


def test_pieces_of_long_units_are_drawn_by_their_share():
    """A unit beyond the limit: how often each arc is taken against its probability from a plain forward sum."""
    unit = "▁" + "therein" * 9
    assert len(unit) > pieces.LONG
    lat, n = pieces.Lattice(pieces.vocabulary_path(), 0.5), 6_000
    ids = lat.encode([unit[1:]] * n, np.array([pieces.row_key(i, 5) for i in range(n)], np.uint64))
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.vocabulary_path())
    weight = {sp.id_to_piece(i): (-sp.get_score(i) + 10) ** -0.5 for i in range(259, sp.get_piece_size())}
    m = len(unit)
    arcs = [(i, j) for i in range(m) for j in range(i + 1, min(m, i + lat.deepest) + 1) if unit[i:j] in weight]
    ahead, behind = [1.0] + [0.0] * m, [0.0] * m + [1.0]
    for i, j in sorted(arcs, key=lambda x: x[1]):
        ahead[j] += ahead[i] * weight[unit[i:j]]
    for i, j in sorted(arcs, key=lambda x: -x[0]):
        behind[i] += behind[j] * weight[unit[i:j]]
    taken = Counter()
    for x in ids:
        at = 0
        for p in map(sp.id_to_piece, x.tolist()):
            taken[at, at + len(p)] += 1
            at += len(p)
    want = {(i, j): ahead[i] * weight[unit[i:j]] * behind[j] / ahead[m] for i, j in arcs}
    assert max(abs(taken[k] / n - w) for k, w in want.items()) < 0.03 and set(taken) <= set(want)


def test_pieces_decoded(spark, docs):
    cut = pieces.segmented(docs, keep=["doc_id", "text", "id"]).withColumnRenamed("text", "was")
    back = pieces.decoded(cut).collect()
    assert len(back) == docs.count() and all(r.text == (r.was or "") for r in back)
    odd = spark.createDataFrame([(1, None), (2, [])], "doc_id long, pieces array<int>")
    assert {r.doc_id: r.text for r in pieces.decoded(odd).collect()} == {1: None, 2: ""}


# ---------------------------------------------------------------- language model


def test_mixing_base_and_held_out(spark, docs, empty, texts):
    rng = random.Random(4)
    vocab = words(rng, 60)
    rows = [(i, " ".join(rng.choice(vocab[(i % 2) * 30 : (i % 2) * 30 + 30]) for _ in range(80))) for i in range(120)] + [(500, None), (501, ""), (502, "Unseen WORDS here"), (7, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = mixing.scored(df).collect()
    tok = lambda t: [*(t or "").encode().lower().split(), None]
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not out(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i, len(tok(t)), sum(c[w] > 0 for w in tok(t)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t)), 6)) for i, t in rows)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(r.held_out == out(r.doc_id) and r.score <= 0 for r in got)
    assert mixing.scored(empty).count() == 0
    assert mixing.scored(docs).count() == docs.count()


def mixing_model(seed=0):
    """A model of made-up counts over a few words."""
    rng = np.random.default_rng(seed)
    code = mixing.Code([2, 4, 6, 8], [9, 5, 3, 1], 4)
    letters = mixing.Letters(rng.integers(0, 9, (256, 256)) * (rng.random((256, 256)) < 0.1))
    counts = []
    for k in mixing.SLOTS:
        n = rng.integers(0, 50, 1 << k) * (rng.random(1 << k) < 0.5)
        counts.append((n, np.floor(n * rng.random(1 << k))))
    return mixing.Model(code, letters, counts, 22, 9)


def test_mixing_probabilities_sum_to_one():
    model = mixing_model()
    assert sum(2.0**-n for n in model.code.lengths) == pytest.approx(1)
    doc = np.zeros(2, np.int32)
    total = 0.0
    for t in (2, 4, 6, 8, 10):  # 10 stands for the escape
        tokens = np.array([2, t], np.int64)
        owner, bits, slots = mixing.token_bits(model.code, tokens, model.code.symbols(tokens), doc)
        x, gate = model.word_inputs(slots)
        p = 1 / (1 + np.exp(-(x * model.weights[gate]).sum(1)))
        total += np.prod(np.where(bits == 1, p, 1 - p)[owner == 1])
    assert total == pytest.approx(1, abs=1e-5)
    total = 0.0  # all bytes that may follow "ab", the closing blank among them
    for c in range(256):
        word = b"ab" + bytes([c])
        per_word, bits, node, slots = mixing.letter_bits(model.letters, [word])
        x, gate = model.letter_inputs(node, slots)
        p = 1 / (1 + np.exp(-(x * model.sets[1][gate]).sum(1)))
        last = len(bits) - int(model.letters.lengths[c << 8 | mixing.BLANK])
        first = last - int(model.letters.lengths[ord("b") << 8 | c])
        total += np.prod(np.where(bits == 1, p, 1 - p)[first:last])
    assert total == pytest.approx(1, abs=1e-5)


def test_mixing_against_a_loop():
    """Texts coded together, one by one, and bit by bit in a plain loop."""
    import pyarrow as pa

    model, rng = mixing_model(1), random.Random(3)
    texts = [" ".join(words(rng, rng.choice([0, 1, 40, 700]))) for _ in range(6)] + ["", " A  b\t"]
    got = model.scores(mixing.Run(pa.array(texts, pa.large_string())))
    alone = [model.scores(mixing.Run(pa.array([t], pa.large_string())))[0] for t in texts]
    assert np.allclose(got, alone, atol=1e-4)
    n, sets = 700, mixing.GATES
    x, gate, bits = rng_inputs = (np.random.default_rng(5).normal(size=(n, 5)).astype(np.float32), np.random.default_rng(6).integers(0, sets, n).astype(np.int32), np.random.default_rng(7).integers(0, 2, n).astype(np.int8))
    text = np.repeat([0, 1, 2], [300, 0, 400]).astype(np.int32)
    want = np.zeros(3)
    for t in range(3):
        at, w = np.flatnonzero(text == t), model.weights.astype(float).copy()
        cuts = [*mixing.edges(len(at)), len(at)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = at[a:b]
            p = 1 / (1 + np.exp(-np.clip((x[part] * w[gate[part]]).sum(1), -14, 14)))
            want[t] += np.log10(np.where(bits[part] == 1, p, 1 - p)).sum()
            for g in np.unique(gate[part]):
                own = gate[part] == g
                w[g] += ((bits[part] - p)[own, None] * x[part][own]).sum(0) * mixing.RATE / np.sqrt(own.sum())
    assert np.allclose(mixing.coded(*rng_inputs, text, 3, model.weights), want, atol=1e-3)

    # the letters' sets: shares refined after every word
    spelled = [b"abc", b"", b"abc", b"zz\xc3\xa9", b"abcd"]
    logs = model.spelling(spelled)
    share, loss = np.full(len(model.sets), 1 / len(model.sets)), 0.0
    for row in 10**logs:
        loss += np.log10((share * row).sum())
        share = share * row / (share * row).sum()
    sums = logs.sum(0)
    assert loss == pytest.approx(np.log10(np.mean(10**sums)))
    for v, weights in enumerate(model.sets):
        per_word, bits, node, slots = mixing.letter_bits(model.letters, [b"abcd"])
        x, gate = model.letter_inputs(node, slots)
        p = 1 / (1 + np.exp(-(x * weights[gate]).sum(1)))
        assert logs[4, v] == pytest.approx(np.log10(np.where(bits == 1, p, 1 - p)).sum(), abs=1e-4)


def test_mixing_makes_words_at_little_cost():
    """Taking a run apart costs less than reading its distinct words one value at a time would alone."""
    import time

    import pyarrow as pa

    rng = random.Random(19)
    names = [f"{rng.randrange(1 << 40):x}é" for _ in range(120_000)]
    texts, distinct = pa.array([" ".join(names), "", " B\ta b "], pa.large_string()), pa.array([n.encode() for n in names], pa.large_binary())

    def least(f):
        took = []
        for _ in range(5):
            start = time.process_time()
            f()
            took.append(time.process_time() - start)
        return min(took)

    run = mixing.Run(texts)
    assert run.words == [*dict.fromkeys(n.encode() for n in names), b"b", b"a", b""]
    assert [run.words[i] for i in run.word[-5:]] == [b"", b"b", b"a", b"b", b""]
    assert least(lambda: mixing.Run(texts)) < least(distinct.to_pylist)


def test_mixing_does_not_depend_on_partitions(spark):
    rng = random.Random(11)
    vocab = words(rng, 300)
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 200)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = ({r.doc_id: (r.n_known, r.base_score, r.score) for r in mixing.scored(df.repartition(k)).collect()} for k in (1, 7))
    assert all(one[i][:2] == pytest.approx(many[i][:2]) and one[i][2] == pytest.approx(many[i][2], abs=1e-3) for i, _ in rows)
    held = [i for i, _ in rows if mixing.held_out(i)]
    none = mixing.scored(df.where(F.col("doc_id").isin(held))).collect()  # nothing to learn from
    assert len(none) == len(held) and all(r.held_out and r.n_known == r.train_tokens == 0 and r.base_score == 0 and -1e6 < r.score < 0 for r in none)


# ---------------------------------------------------------------- pages


PAGE = """<html lang=en><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, and more of them, to make things better for you.</p></div>
<article><h1>A  title &amp; more</h1><p>First <b>para\tgraph</b>, with enough words to look like one.<p>Second &eacute; line<br>goes on.
<div class="ad">Buy now</div><script>var t="</p>";</script></article><aside>Side words</aside>
<section id="comments"><p>Great article, I liked it very much, thank you.</p></section><form><label>Mail</label></form><footer>&copy; x</footer></body></html>"""


def test_main_text(spark):
    want = "A title & more\nFirst para graph, with enough words to look like one.\nSecond é line goes on."
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>Some plain words, no container, but long enough to be a text of its own, really.</p>"), (1, "u", PAGE), (None, "u", "<<>a<b")], "page_id long, url string, html string")
    got = mincut.extracted(df.withColumn("text", F.lit("clash"))).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 6 and by[1].text == want and by[1].n_chars == len(want) and by[2].text == by[3].text == "" and by[4].text.startswith("Some plain")
    assert mincut.extracted(df.limit(0)).count() == 0


def test_the_cut_decides():
    """Pages on which the cut overrules a block's own odds, and the text is better for it."""
    long = "<p>A long plain paragraph of running text, with several clauses, and commas, so that it is content.</p>"
    page = f"{long}<div>Yes</div>{long}<div>So it went</div>{long}"
    told = mincut.labelled(page, {})
    assert [z < 0 for _, z, _ in told] == [False, True, False, True, False] and all(keep for _, _, keep in told)
    links = "".join(f"<li><a href=/{i}>Link {i}</a>" for i in range(6))
    told = mincut.labelled(f"<ul>{links}<li>A line of some eighty characters, without a link; it stands in a list of them<li>{links}</ul>", {})
    assert sum(z > 0 for _, z, _ in told) == 1 and not any(keep for _, _, keep in told)


def test_main_text_keeps_what_is_text():
    run = "Running text of the article, which goes on for a while, with commas, and ends here."
    assert mincut.main_text("A plain text page, where a value x < 10 counts, and more text follows, in sentences.").endswith("in sentences.")
    assert mincut.main_text(f"<article><p>{run}</p></article><p>{run} x < 10 counts, y > 3 too.</p>").endswith("x < 10 counts, y > 3 too.")
    for name in ("legal", "search", "side", "skip", "form", "tags", "alert", "bottom"):
        assert mincut.main_text(f"<article><p>{run}</p><div class='{name}'>A court ruling, and {run}</div><p>{run}</p></article>").count(run) == 3
    for name in ("ad", "cookie-notice", "newsletter", "share-bar", "comments"):
        assert mincut.main_text(f"<article><p>{run}</p></article><div class='{name}'>{run}</div>") == run
    assert mincut.main_text(f"<article><p>{run} <math><mi>a</mi></math> <object>b</object></p></article>") == f"{run} a b"
    whole = " ".join([run] * 20_000)
    assert mincut.main_text(f"<nav><a href=/>Home</a></nav><article><p>{whole}</p></article>") == whole


def test_words_are_learnt(spark):
    run = "Running text of the article, which goes on for a while, with commas, and ends here."
    pages = [(i, "u", f"<nav class='zqx'><a href=/>Home {i}</a></nav><article class='vwy'><p>{run} {i}</p></article>") for i in range(30)]
    pages.append((99, "u", f"<div class='vwy'>{run}</div><div class='zqx'>Here we tell you, our reader, about us and them</div>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    learnt = mincut.learn(df)
    assert learnt["zqx"] < 0 < learnt["vwy"] and mincut.learn(df.limit(0)) == {}
    text = {r.page_id: r.text for r in mincut.extracted(df).collect()}
    assert text[99] == run and text[3] == f"{run} 3"


def test_minimum_cut_is_minimal():
    rng = random.Random(8)
    for _ in range(60):
        n = rng.randint(1, 7)
        s, t = ([rng.random() * 3 for _ in range(n)] for _ in range(2))
        e = [(a, b, rng.random()) for a in range(n) for b in range(a) if rng.random() < 0.5]
        cost = lambda side: sum(t[i] if side[i] else s[i] for i in range(n)) + sum(w for a, b, w in e if side[a] != side[b])
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(mincut.minimum_cut(s, t, e)) == pytest.approx(best)


# ---------------------------------------------------------------- toxicity


def test_toxicity(spark, empty):
    rng = random.Random(6)
    plain = words(rng, 200)
    rows, labels = [], []
    for i in range(300):
        w = [rng.choice(plain) for _ in range(30)]
        if i % 4 == 0:
            w[5] = rng.choice(["idiot", "stupid", "moron"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(1000, "you 1d10t " + plain[0]), (1001, "s t u p i d " + plain[1]), (1002, "mooooron"), (1003, None), (1004, ""), (None, "idiot")]
    docs = spark.createDataFrame([(a, b, 1, 0.5) for a, b in rows], "doc_id long, text string, toxic int, score double")
    lab = spark.createDataFrame([*labels, (None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    model = toxicity.fit(docs, lab, train=toxicity.crc_part("doc_id", 3) != 1)
    got = {r.id: r.score for r in toxicity.scored(docs, model).collect()}
    assert len(got) == len(rows)
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in held)
    assert all(got[i] >= 0.7 for i in (1000, 1001, 1002, None)) and got[1003] == got[1004] < 0.5
    assert toxicity.fit(docs, lab.limit(0)) is None and toxicity.scored(docs, None).agg({"score": "max"}).first()[0] == 0.0
    assert toxicity.scored(empty, model).count() == 0


def test_toxicity_trigrams_of_all_texts(spark):
    rows = [(i, "stupid words" if i % 2 else "plain words") for i in range(20)] + [(100 + i, "Grüße Žluťoučký grüße") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    model = toxicity.fit(docs, lab, most=10)
    assert model.trigrams["üße"] == 10 and model.trigrams["^^ž"] == 5 and model.trigrams["wor"] == 20


def test_toxicity_long_tokens():
    grams = Counter()
    for w in ["idiot", "stupid", "plain", "words", "there"] * 50:
        grams.update(f"^^{w}$"[i : i + 3] for i in range(len(w) + 1))
    read = toxicity.Reader(toxicity.Decoder(grams))
    for joint in ".-_":
        got = read.features(joint.join(["plain", "words"] * 30 + ["1d10t"] + ["there"] * 20))
        assert {"idiot$", "plain$", "words$", "there$"} <= got
    assert "idiot$" in read.features("/".join(["words"] * 50 + list("idiot") + ["there"]))
    assert "idiot" in read.features(" ".join("idiot" * 60)) and "stupi" in read.features("5tupid" * 50)
    assert "stupi" in read.features("5tupid" * 5_000)  # in time linear in the length


def test_toxicity_search_is_exact():
    rng = random.Random(3)

    def every(decoder, seen, before="^^", last="", score=0.0, text=""):
        if not seen:
            yield score + decoder.log_p(before, "$"), text
            return
        c, rest = seen[0], seen[1:]
        if c == last:
            yield from every(decoder, rest, before, c, score + toxicity.REPEAT, text)
        if not c.isalnum():
            yield from every(decoder, rest, before, last, score + (toxicity.SKIP_ODD if c in toxicity.LOOKALIKES else toxicity.SKIP), text)
        for s in [*toxicity.LOOKALIKES.get(c, ""), c]:
            channel = (0.0 if c.isalpha() else toxicity.KEEP_ODD) if s == c else toxicity.SWAP - math.log(len(toxicity.LOOKALIKES[c]))
            yield from every(decoder, rest, before[1] + s, c, score + channel + decoder.log_p(before, s), text + s)

    for _ in range(40):
        grams = Counter()
        for _ in range(40):
            w, k = "".join(rng.choice("aeioubdt") for _ in range(rng.randint(3, 7))), rng.randint(1, 400)
            for i in range(len(w) + 1):
                grams[f"^^{w}$"[i : i + 3]] += k
        decoder = toxicity.Decoder(grams)
        for seen in ("%#tbd", "*%#bd", "#%t%", "b**#t"):
            assert decoder.restore(seen) == max(every(decoder, seen))[1]


# ---------------------------------------------------------------- language


def test_language(spark, docs, empty):
    rng = random.Random(7)
    en, de = words(rng, 80, "aeionrst"), words(rng, 80, "uäöchzgk")
    rows = [(i, " ".join(rng.choice(en if i % 2 else de) for _ in range(20)), "en" if i % 2 else "de", f"h{i % 2}.x.org") for i in range(60)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string")
    model = langid.fit(train)
    odd = spark.createDataFrame([(900, None, None, "h0.x.org"), (901, "", None, None), (902, "123 456", None, None), (903, "q", "en", None), (904, "q", "de", None), (905, "q", None, "h1.x.org"), (None, en[0], None, None)], "doc_id long, text string, declared string, host string")
    got = {r.doc_id: r for r in langid.identify(odd, model, declared_col="declared", host_col="host").collect()}
    assert not any(got[i]._lang_ok for i in (900, 901, 902)) and got[901]._lang == "und"
    assert (got[903]._lang, got[904]._lang) == ("en", "de")
    told = langid.identify(train.withColumn("_h", F.lit(1)).drop("_h"), model, host_col="host")
    assert told.where("_lang <> lang").count() == 0 and told.count() == 60
    assert langid.identify(docs, langid.fit(docs.limit(0))).where("_lang_ok").count() == 0
    assert langid.identify(empty, model).count() == 0


def test_language_on_texts_not_fitted():
    """Held-out accuracy on the documents of the small test table."""
    import duckdb

    rows = duckdb.sql("SELECT doc_id, text, lang FROM '/root/testdata/sf0.01/documents.parquet' WHERE lang IS NOT NULL AND length(text) > 40").fetchall()
    counts = {}
    for i, t, l in rows:
        if i % 3:
            code, _ = langid._buckets([t.encode()])
            counts[l] = counts.get(l, 0.5) + np.bincount(code, minlength=langid.BUCKETS)
    langs = sorted(counts)
    table = np.log(np.array([counts[l] / counts[l].sum() for l in langs]))
    told = [(langs[int(table[:, langid._buckets([t.encode()])[0]].sum(1).argmax())], l) for i, t, l in rows if i % 3 == 0]
    assert sum(a == b for a, b in told) / len(told) >= 0.97


def test_language_host_prior_leaves_the_row_out(spark):
    """Priors against a plain loop, with hosts broadcast and with only hot ones broadcast."""
    rng = np.random.default_rng(1)
    hosts = ["a.b.org"] * 40 + ["c.b.org"] * 6 + ["d.de", "e.f.de", None, None]
    post = rng.dirichlet([1, 1, 1], len(hosts))
    df = spark.createDataFrame([(i, h, p.tolist()) for i, (h, p) in enumerate(zip(hosts, post))], "i int, _host string, _post array<double>")
    counts, total = langid.host_counts(df, 3, "_host", "_post", common.Scratch(spark, "hosts"))

    def level(h, k):
        if h is None:
            return None
        parts = h.split(".")
        return [parts[-1], h.split(".", 1)[1] if len(parts) > 2 else h, h][k]

    kept = langid.BROADCAST_HOSTS
    for most in (kept, 0):
        langid.BROADCAST_HOSTS = most
        try:
            got = {r.i: r.p for r in langid._with_counts(df, counts).select("i", langid.host_prior(total, F.col("_post")).alias("p")).collect()}
        finally:
            langid.BROADCAST_HOSTS = kept
        assert len(got) == len(hosts)
        for i, h in enumerate(hosts):
            p = (post.sum(0) - post[i] + langid.KAPPA / 3) / (len(hosts) - 1 + langid.KAPPA)
            for k in range(3) if h else ():
                n = sum((post[j] for j in range(len(hosts)) if j != i and level(hosts[j], k) == level(h, k)), np.zeros(3))
                p = (n + langid.KAPPA * p) / (n.sum() + langid.KAPPA)
            assert np.allclose(got[i], np.log(p))


def test_language_addresses(spark):
    rows = [("https://www.Example.de/x",), ("http://a.b.co.uk:80/",), ("https://x.org/fr/page",), ("https://u@h.es",), ("not an address",), (None,), ("https://x.org/",)]
    df = spark.createDataFrame(rows, "u string")
    assert [tuple(r) for r in df.select(langid.host_of("u"), langid.suffix_language("u")).collect()] == [("www.example.de", "de"), ("a.b.co.uk", "en"), ("x.org", "fr"), ("h.es", "es"), (None, None), (None, None), ("x.org", None)]


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    en = words(rng, 300, "aeionrstl")
    base = [" ".join(rng.choice(en) for _ in range(120)) for _ in range(30)]
    passage = " ".join(rng.choice(en) for _ in range(80))
    item = " ".join(rng.choice(en) for _ in range(25))
    rows = list(enumerate(base)) + [(100, base[3]), (101, base[5] + " end"), (102, f"{base[0][:200]} {passage} {base[1][:150]}"), (103, f"{base[2][:150]} {passage} {base[4][:200]}"), (104, f"{base[6][:100]} {item} {base[7][:100]}"), (105, None), (106, "")]
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(range(30)) <= set(out) and not {100, 104, 105, 106} & set(out)
    lat = pieces.Lattice(pieces.vocabulary_path(), 0.5)
    assert passage in lat.decode(np.array(out[102].pieces)) and passage not in lat.decode(np.array(out[103].pieces))
    assert all(r.lossless and r.n_chars == len(lat.decode(np.array(r.pieces))) for r in out.values())
    assert hashlib.sha256(lat.decode(np.array(out[9].pieces)).encode()).digest() == hashlib.sha256(base[9].encode()).digest()


def test_pipeline_on_odd_tables(spark, tmp_path):
    """No rows; null ids, repeated rows, empty and long texts, and extra columns whose names the stages use themselves."""
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long, id string, h string, t string, _lang string, spans int, _key int"
    item = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    rng = random.Random(4)
    base = [" ".join(words(rng, 40, "aeionrstl")) for _ in range(12)] + [" ".join(words(rng, 20_000, "aeionrstl"))]
    rows = [(i, t, "en", "s" if i % 2 else None, len(t), "x", "y", None, "z", 1, 2) for i, t in enumerate(base)]
    rows += [rows[0], rows[0], (None, base[1] + " more of it", "en", "s", 5, None, None, None, None, None, None), (70, None, None, None, None, None, None, None, None, None, None), (71, "", "en", "s", 0, "", "", "", "", 0, 0)]
    for name, part in (("none", []), ("odd", rows)):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(part, kind).write.parquet(f"{d}/documents.parquet")
        item.write.parquet(f"{d}/benchmark.parquet")
        out = corpus_pipeline.run(spark, d).collect()
        if not part:
            assert out == []
            continue
        ids = [r.doc_id for r in out]
        assert ids.count(0) == 1 and set(range(13)) - {1} <= set(ids) and not {70, 71} & set(ids)
        assert len({1, None} & set(ids)) >= 1 and all(r.lossless and r.n_pieces == len(r.pieces) for r in out)


def test_pieces_query_digests_the_operators_rows(spark, tmp_path):
    import zlib

    rows = [(1, "a word, and another"), (2, None), (3, ""), (None, "x" * 200 + "\nnaïve ▁ 𝒳"), (1, "a word, and another")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = pieces.query(spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2  # the operator, then its digests
    want = [(r.doc_id, len(r.pieces), zlib.crc32(np.array(r.pieces, "<u4").tobytes()), True) for r in pieces.segmented(docs).collect()]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
