"""The training-data operators against plain versions, on small tables with awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from auditweave.llm import ann, bpe, common, lines, metric_join, packing, quality, secret_scan, simhash, token_files, toxicity, vocab

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "doc_id long, text string, key string, fp long, keys string, node string"


@pytest.fixture(scope="module", autouse=True)
def found(spark):
    common.findable(spark)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocab.default_path())


AWKWARD = ["", None, "  \n\t ", "A", "one two three", "The  Cat's 12 hats, don't!", "<|endoftext|> x <|ENDOFTEXT|>", "ΣΑΣ İstanbul ﬁ \x1d\x07", "naïve café — “q”", "ab" * 3000, "word " * 4000, "日本語 テキスト", "same", "same"]


def docs(spark, texts=AWKWARD, schema="doc_id long, text string"):
    return spark.createDataFrame([(i if i != 5 else None, t) for i, t in enumerate(texts)], schema)


# -- tokens ---------------------------------------------------------------------------------------


def test_codec_is_the_library(spark, library):
    got = bpe.encode_decode(docs(spark)).collect()
    assert len(got) == len(AWKWARD)
    want = Counter()
    for t in AWKWARD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[(tuple(ids), library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter((tuple(r.ids), r.decoded) for r in got) == want


def test_segment_tree_is_plain_merging():
    tree = bpe.merge_tree(v := vocab.Vocabulary(vocab.default_path()))
    ranks = {m: k for k, m in enumerate(v.merges)}
    r = np.random.default_rng(3)
    for n in [1, 2, 3, 17, 40, 300]:
        word = "".join(r.choice(list("aentrshio"), n))
        row = [*word[:-1], word[-1] + "</w>"]
        got = [v.tokens[i] for i in tree.merge([v.ids[s] for s in row])]
        while True:
            pairs = [(ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(row, row[1:]))]
            if not pairs or min(pairs)[0] == 1 << 60:
                break
            i = min(pairs)[1]
            row[i : i + 2] = [row[i] + row[i + 1]]
        assert got == row


def test_model_pieces_are_the_library(library):
    encode = vocab.ids_of(vocab.default_path())
    for t in AWKWARD:
        assert vocab.unpacked(encode(t or "")).tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_token_files(spark, library, tmp_path):
    folder = f"file://{tmp_path}/files"
    shards = token_files.write_token_files(docs(spark), folder, sequence=64)
    got = sorted(token_files.read_token_files(shards, folder).collect(), key=lambda r: r.start)
    order = sorted(range(len(AWKWARD)), key=lambda i: (i != 5, i))
    start = 0
    for i, r in zip(order, got, strict=True):
        ids = library.encode(AWKWARD[i] or "", add_special_tokens=False).ids + [vocab.END_ID]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (None if i == 5 else i, start, len(ids), ids)
        start += len(ids)
    shard = shards.where("n_ids > 64").head()
    reader = token_files.ShardReader(folder, shard.shard)
    ids, mask = reader.sequence_at(0)
    assert len(ids) == 64 and mask.all() and ids.base is not None
    total = sum(int(reader.sequence_at(k)[1].sum()) for k in range(-(-shard.n_ids // 64)))
    assert total == shard.n_ids


def test_token_files_of_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    shards = token_files.write_token_files(docs(spark, []), folder)
    assert token_files.read_token_files(shards, folder).count() == 0


@pytest.mark.parametrize("windows", [2, 32])
def test_packing(spark, library, windows):
    rows = packing.pack(docs(spark).repartition(5), windows=windows, sequence=128).collect()
    whole = [library.encode(t or "", add_special_tokens=False).ids + [vocab.END_ID] for t in AWKWARD]
    own = defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
    for i, ids in enumerate(whole):
        pieces = sorted(own[None if i == 5 else i], key=lambda r: r.start)
        assert [x for p in pieces for x in vocab.unpacked(p.ids)] == ids
        assert all(p.doc_tokens == len(ids) for p in pieces)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    lengths = []
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        lengths.append(at)
    assert max(lengths) <= 128
    assert sum(128 - n > packing.MAX_PAD for n in lengths) <= 1  # the very last
    assert packing.pack(docs(spark, [])).count() == 0


def test_packing_merges_many_partitions(spark):
    many = docs(spark, [f"text number {i}" for i in range(150)]).repartition(130)
    rows = packing.pack(many, sequence=64).collect()
    size = Counter()
    for r in rows:
        size[r.sequence_id] += r.length
    assert sum(n < 48 for n in size.values()) <= 1


# -- lines ----------------------------------------------------------------------------------------


def plain_lines(texts, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    n = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        own = (t or "").split("\n")
        kept = [x for x in own if n[key(x)] < least or not key(x)]
        out.append((len(own), len(own) - len(kept), t if len(kept) == len(own) else "\n".join(kept)))
    return out


def test_line_dedup(spark):
    texts = ["Menu\nown a", " menu \nown b\n\n", "MENU\r\nMenu\nÄ", "ä\nmenu", None, "", "\n", "Menu", "x \nmenu\t", "x ", "Menu\nown a"]
    df = spark.createDataFrame([(i, t, "k", 1, "z", "n") for i, t in enumerate(texts)], EXTRA)
    out = {r.doc_id: r for r in lines.dedup_lines(df, min_docs=3).collect()}
    for i, (n, dropped, kept) in enumerate(plain_lines(texts, 3)):
        assert (out[i]["__aw_lines"], out[i]["__aw_dropped"], out[i].text) == (n, dropped, kept), i
        assert out[i].key == "k" and out[i].fp == 1
    assert lines.dedup_lines(df.limit(0)).count() == 0
    assert lines.drop_lines(df, 3).columns == df.columns


# -- SimHash --------------------------------------------------------------------------------------


def plain_fingerprint(text, words=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(ids, links):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_simhash(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today with all of its many friends " * 4
    texts = [base, base + "x", base.replace("lazy", "idle", 1), base.upper(), "", None, " \n", "other words entirely here now", "a b c", "a b c", "É b c d e"]
    df = spark.createDataFrame([(i, t, "k", 5, "z", "n") for i, t in enumerate(texts)], EXTRA)
    got = {r.doc_id: r for r in simhash.simhash_groups(df).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    assert {i: got[i].fingerprint for i in got} == {i: f"{f:016x}" for i, f in enumerate(fps)}
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    assert {i: got[i].component_id for i in got} == plain_components(range(len(texts)), links)
    kept = simhash.keep_one(df.unionByName(df))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(plain_components(range(len(texts)), links).values()))
    assert kept.columns == df.columns
    assert simhash.simhash_groups(df.limit(0)).count() == 0
    ids_gone = df.withColumn("doc_id", df.doc_id.cast("long") * None) if False else spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert [r.component_id for r in simhash.simhash_groups(ids_gone).collect()] == [None, None]
    assert simhash.keep_one(ids_gone).count() == 1


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_near_links_find_all(spark, blocks, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 64)
    r = np.random.default_rng(blocks)
    seeds = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(seeds.tolist())
    for s in seeds.tolist():
        for _ in range(8):
            s ^= sum(1 << int(b) for b in r.choice(64, r.integers(1, 5), replace=False))
            fps.add(s)
    hot = int(seeds[0]) >> 30 << 30
    fps |= {hot | int(x) for x in r.integers(0, 1 << 30, 300)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f,) for f in fps], "fp long")
    links = [(x.a % (1 << 64), x.b % (1 << 64)) for x in simhash.near_links(df, blocks=blocks).collect()]
    real = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 4]
    assert plain_components(fps, links) == plain_components(fps, real)


def test_bit_sliced_counters():
    r = np.random.default_rng(1)
    fps = np.unique(r.integers(0, 1 << 12, 500).astype(np.uint64))
    label = simhash.near_within(fps, 2)
    d = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    assert label.tolist() == list(plain_components(range(len(fps)), list(zip(*np.nonzero(d)))).values())
    group = np.sort(r.integers(0, 60, len(fps)))
    a, b = simhash.near_by_shifts(fps, group, 2)
    i, j = np.nonzero(d & (group[:, None] == group[None, :]))
    assert set(zip(a.tolist(), b.tolist())) == {(x, y) for x, y in zip(i.tolist(), j.tolist()) if x < y}


# -- vectors --------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, node string, cell int"


def vectors(n=300, dim=8, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(30, dim))
    v = (centres[r.integers(0, 30, n)] + 0.15 * r.normal(size=(n, dim))).astype(np.float32)
    rows = [(i, v[i].tolist(), int(i % 3), "n", 1) for i in range(n)]
    rows += [(n + i, v[3].tolist(), 0, "n", 1) for i in range(40)]  # copies
    rows += [(1000, None, 0, "n", 1), (1001, [0.0] * dim, 0, "n", 1), (1002, [float("nan")] * dim, 0, "n", 1), (1003, [None, *[1.0] * (dim - 1)], 0, "n", 1), (1004, v[3].tolist(), None, "n", 1), (1005, [1.0] * 3, 0, "n", 1)]
    return rows


@pytest.mark.parametrize("cell", [2000, 10])
def test_metric_join(spark, monkeypatch, cell):
    monkeypatch.setattr(metric_join, "CELL", cell)
    monkeypatch.setattr(metric_join, "BLOCK", 32)
    rows = vectors()
    got = {r.vec_id: r for r in metric_join.range_join(spark.createDataFrame(rows, VECTORS)).collect()}
    fine = [r for r in rows if r[1] and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1]) and r[2] is not None]
    links = []
    for x in fine:
        for y in fine:
            if x[0] < y[0] and x[2] == y[2] and len(x[1]) == len(y[1]):
                a, b = np.array(x[1], np.float32).astype(float), np.array(y[1], np.float32).astype(float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.93:
                    links.append((x[0], y[0]))
    n = Counter(i for link in links for i in link)
    component = plain_components([r[0] for r in rows], links)
    assert len(got) == len(rows)
    for i, r in got.items():
        assert (r.n_links, r.component_id, r.kept) == (n[i], component[i], component[i] == i), i
    assert metric_join.range_join(spark.createDataFrame([], VECTORS)).count() == 0


def test_ann(spark, monkeypatch):
    monkeypatch.setattr(ann, "AREA", 40)
    monkeypatch.setattr(ann, "ASKING", 5)
    rows = vectors(400)
    df = spark.createDataFrame(rows, VECTORS)
    got = defaultdict(list)
    for r in ann.search(df, df.where("vec_id % 20 = 0"), 10).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    fine = {r[0]: np.array(r[1], np.float32).astype(float) for r in rows if r[1] and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1]) and len(r[1]) == 8}
    assert set(got) == {i for i in fine if i % 20 == 0}
    hits = 0
    for q, own in got.items():
        best = sorted(((-float(v @ fine[q]), i) for i, v in fine.items() if i != q))[:10]
        own = sorted(own)
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        assert all(abs(s - float(fine[i] @ fine[q])) < 1e-9 for _, i, s in own)
        hits += len({i for _, i in best} & {i for _, i, _ in own})
    assert hits / (10 * len(got)) >= 0.9
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id < 3")
    assert ann.search(few, few.where("vec_id = 0")).count() == 2


# -- secrets --------------------------------------------------------------------------------------


def plain_spans(text):
    assign = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_base_spans():
    r = np.random.default_rng(4)
    bits = ["token", "Secret", "API_KEY", "apikey", "ſecret", "toKen", "=", ": ", '"', "'", " ", "AKIA", "AKIA" + "Z" * 12, "abcdef01" * 4, "abc", "password", "=", "\n", "é", "A1b2C3d4", "0" * 31]
    for _ in range(3000):
        text = "".join(r.choice(bits, r.integers(0, 12)))
        assert secret_scan.base_spans(text) == plain_spans(text), text


def test_secret_scan(spark):
    r = np.random.default_rng(5)

    def value(n=40):
        return "".join(r.choice(list("0123456789abcdef"), n))

    texts = [f"some plain words number{i} here token = \"{value()}\" and more prose follows" if i % 2 else f"nothing to see in this sentence {i} but ordinary-words-with-1-digit here" for i in range(200)]
    texts += ["", None, "x" * 5000]
    df = spark.createDataFrame([(i, t, "k", 1, "z", "n") for i, t in enumerate(texts)], EXTRA)
    got = {x.doc_id: x for x in secret_scan.scan(df).collect()}
    for i, t in enumerate(texts):
        assert [(s.start, secret_scan.KINDS.index(s.kind), s.end) for s in got[i].spans if s.kind != "network"] == plain_spans(t or "")
    clean = secret_scan.redact(df)
    assert clean.columns == df.columns
    assert not clean.where("text RLIKE '[0-9a-f]{32}'").count() and clean.where("text IS NULL").count() == 1
    assert secret_scan.scan(df.limit(0)).count() == 0


# -- classifiers ----------------------------------------------------------------------------------

PROSE = "the and then there was a long day with some more of it that they had seen before in the old house near the water".split()


def sentences(n, seed=0, bad=("idiot", "scum", "loser")):
    r = np.random.default_rng(seed)
    texts, y = [], []
    for i in range(n):
        words = list(r.choice(PROSE, 30))
        if i % 4 == 0:
            for b in r.choice(bad, 2):
                words.insert(int(r.integers(0, len(words))), str(b))
        texts.append(" ".join(words))
        y.append(int(i % 4 == 0))
    return texts, y


def test_toxicity(spark):
    texts, y = sentences(400)
    extra = ["you are an 1d10t and a l0ser", "what an i d i o t there", "such a s.c.u.m and i-d-i-o-t", "a real looooser idioooot", "", None, "the day was long 100 times", "water " * 3000]
    df = spark.createDataFrame([(i, t, "k", 1, "z", "n") for i, t in enumerate(texts + extra)], EXTRA)
    labels = spark.createDataFrame([(i, 1, v) for i, v in enumerate(y)] + [(3, 1, None), (99999, 0, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.score for r in toxicity.score_texts(df, toxicity.fit(df, labels)).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((out[i] >= 0.3) == bool(y[i]) for i in held)
    n = len(texts)
    assert [out[n + k] >= 0.3 for k in range(8)] == [True, True, True, True, False, False, False, False]
    kept = toxicity.keep_clean(df, labels)
    assert kept.columns == df.columns and kept.count() == 300 + 4
    assert toxicity.score_texts(df, toxicity.fit(df, labels.limit(0))).count() == n + 8
    assert toxicity.score_texts(df.limit(0), toxicity.fit(df.limit(0), labels)).count() == 0


def test_restorer():
    words = "idiot loser scum stupid trash " * 20 + " ".join(PROSE) * 5
    c = toxicity._codes("  " + words + " ").astype(np.int32)
    restorer = toxicity.Restorer(toxicity.log_model(toxicity._trigrams([c]).astype(float).reshape((toxicity._K,) * 3)))
    for seen, meant in [("1d10t", "idiot"), ("$cum", "scum"), ("s-c-u-m", "scum"), ("tr@sh", "trash"), ("stuuupid", "stupid"), ("l0s3r", "loser")]:
        assert restorer.suspicious(seen) and restorer.restore(seen) == meant, seen
    assert toxicity.restored_text("what an i d i o t , 1d10t", restorer).split()[2:4] == ["idiot", "idiot"] or "idiot" in toxicity.restored_text("what an i d i o t , 1d10t", restorer)
    assert not restorer.suspicious("plain") and not restorer.suspicious("1234")


def test_quality(spark):
    r = np.random.default_rng(2)
    rows, y = [], []
    for i in range(500):
        good = i % 3 > 0
        words = list(r.choice(PROSE, 40)) if good else [str(r.choice(PROSE))] * 40
        rows.append((i, " ".join(words), "en", "a" if good else "b", 200))
        y.append(int(good))
    rows += [(900, None, None, None, None), (901, "", "en", "a", 0), (None, "x", "en", "a", 1)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, v, 0) for i, v in enumerate(y) if i % 2], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in quality.score(quality.features(df), quality.fit(quality.features(df, labels))).collect()}
    held = [i for i in range(500) if i % 2 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.5) == bool(y[i]) for i in held]) > 0.95
    assert quality.score(quality.features(df), quality.fit(quality.features(df, labels.limit(0)))).count() == len(rows)
    assert quality.score(quality.features(df.limit(0)), quality.fit(quality.features(df.limit(0), labels))).count() == 0


def test_digests_follow_the_contract():
    both = bpe.coder(vocab.default_path())
    ids = vocab.unpacked(both("hello, world"))
    n, a, b = bpe.digests(both, ids, both.decode(ids))
    assert n == len(ids) and a == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert b == hashlib.sha256(both.decode(ids).encode()).hexdigest()


def test_pivots_replicate_enough():
    """Every close pair meets in exactly one cell, whatever the pivots."""
    r = np.random.default_rng(8)
    u = metric_join.unit(r.normal(size=(12, 5))[r.integers(12, size=400)] + 0.2 * r.normal(size=(400, 5)))
    for seed in range(6):
        p = u[np.random.default_rng(seed).choice(400, 7, replace=False)]
        d = metric_join.distances(u, p)
        home = d.argmin(1)
        far = d.min(1)
        inner, outer = (np.array([f(far[home == k]) if (home == k).any() else e for k in range(7)]) for f, e in ((np.min, np.inf), (np.max, -np.inf)))
        more = metric_join.replicated(d, home, metric_join.distances(p, p), inner, outer, 0.38)
        i, j = np.nonzero(np.triu(metric_join.distances(u, u) <= 0.375, 1))
        other = home[i] != home[j]
        i, j = i[other], j[other]
        assert len(i) and np.array_equal(more[i, home[j]].astype(int) + more[j, home[i]], np.ones(len(i), int))
        assert more.sum() < 400 * 6 / 2


def test_pivots_are_chosen():
    r = np.random.default_rng(3)
    tight = r.normal(size=(40, 16))[r.integers(40, size=4000)] + 0.02 * r.normal(size=(4000, 16))
    assert len(metric_join.choose(tight, 40_000, 64, 0.38)) >= 16
    assert len(metric_join.choose(r.normal(size=(10, 4)), 10, 64, 0.38)) == 1
