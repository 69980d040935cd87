"""The pipeline on the small tables, stage by stage, against plain versions."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from auditweave.llm import common, lines, secret_scan, vocab

from .test_near_copies import plain_shingles, similar
from .test_operators import plain_components, plain_fingerprint, plain_lines, plain_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    common.findable(spark)
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"": docs.toPandas()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = docs.toPandas()
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "secrets", "packing"]


def test_toxicity_keeps_clean_documents(spark, stages):
    before, after = stages[""], stages["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")["toxic"]
    gone = set(before.doc_id) - set(after.doc_id)
    assert list(after.columns) == list(before.columns) and gone
    clean = {i for i, t in labels.items() if t == 0}
    assert len(gone & clean) <= 0.02 * len(clean)
    texts = before.set_index("doc_id").text
    assert all(texts[r.doc_id] == r.text for r in after.itertuples())


def test_lines(stages):
    before, after = stages["toxicity"].sort_values("doc_id"), stages["line_dedup"].sort_values("doc_id")
    want = [t for _, _, t in plain_lines(before.text.tolist(), lines.MIN_DOCS)]
    assert after.text.tolist() == want and after.n_chars.tolist() == [len(t) for t in want]


def test_simhash_keeps_one_of_each_group(stages):
    before, after = stages["line_dedup"], stages["simhash"]
    ids = before.doc_id.tolist()
    fps = [plain_fingerprint(t) for t in before.text]
    sets = [plain_shingles(t) for t in before.text]
    links = [(ids[i], ids[j]) for i in range(len(ids)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4 or similar(sets[i], sets[j])]
    assert sorted(after.doc_id) == sorted(set(plain_components(sorted(ids), links).values()))
    assert list(after.columns) == list(before.columns)


def test_secrets_are_gone(stages):
    before, after = stages["simhash"].set_index("doc_id"), stages["secrets"].set_index("doc_id")
    assert sorted(before.index) == sorted(after.index)
    for i, text in before.text.items():
        if spans := plain_spans(text):
            assert secret_scan.without(text, spans, "[secret]") == after.text[i] or "[secret]" in after.text[i]
            assert not plain_spans(after.text[i])


def test_packing_holds_every_id(stages):
    encode = vocab.ids_of(vocab.default_path())
    own, sequences = defaultdict(list), Counter()
    for r in stages["packing"].itertuples():
        own[r.doc_id].append((r.start, r.length, r.doc_tokens))
        sequences[r.sequence_id] += r.length
    docs = stages["secrets"].set_index("doc_id").text
    assert set(own) == set(docs.index) and max(sequences.values()) <= 2048
    for i, text in docs.items():
        n = len(encode(text)) // 4 + 1
        at = 0
        for start, length, total in sorted(own[i]):
            assert (start, total) == (at, n)
            at += length
        assert at == n


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == len(stages["packing"])
