"""Disguises in long chunks, and next to other spaced words."""

import os
import zlib
from pathlib import Path

import numpy as np
import pytest

from auditweave.llm import common, toxicity

from .test_operators import PROSE, sentences

ROOT = str(Path(__file__).resolve().parents[2])


@pytest.fixture(scope="module", autouse=True)
def found(spark):
    common.findable(spark)


@pytest.fixture(scope="module")
def words():
    text = "you are a complete and utter idiot and scum . what a loser , stupid trash " * 20 + " ".join(PROSE) * 5
    c = toxicity._codes("  " + text + " ").astype(np.int32)
    return toxicity.Words(toxicity.log_model(toxicity._trigrams([c]).astype(float).reshape((toxicity._K,) * 3)), tuple)


@pytest.mark.parametrize(
    ("text", "meant"),
    [
        ("you-are-a-complete-and-utter-1d10t-and-$cum", ["idiot", "scum"]),
        ("st" + "u" * 60 + "pid", ["stupid"]),
        ("l_0_s_3_r_" * 5, ["loser"]),
        ("you are a i d i o t today", ["idiot"]),
        ("well y o u i d i o t .", ["idiot", "you"]),
        ("y o u a r e a c o m p l e t e a n d u t t e r i d i o t", ["idiot", "complete"]),
        ("s-c-u-m and s c u m", ["scum"]),
    ],
)
def test_words_are_restored(words, text, meant):
    found = words.of(text)
    assert all(w + "$" in found for w in meant), sorted(found)
    assert all(w in toxicity.restored_text(text, words.restorer).split() for w in meant)


def test_price_of_length(words):
    import time

    start = time.perf_counter()
    words.of("1d10t-" * 5000)
    assert time.perf_counter() - start < 20


def test_doubled_letters_are_decoded(words):
    for seen, meant in [("iiddiioott", "idiot"), ("ttrraasshh", "trash"), ("sccumm", "scum"), ("stuupid", "stupid")]:
        assert meant + "$" in words.of(seen), seen
    assert toxicity.restored_text("all is well", words.restorer) == "all is well"


def test_disguises_score_like_the_word(spark):
    """Digits, signs, spaces, separators, doubled and tripled letters change a score by 0.02 at most."""
    texts, y = sentences(400)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int"))
    score = model.scorer()
    swap = str.maketrans("oesat", "03$4+")
    ways = [lambda w: w.translate(swap), " ".join, ".".join, "-".join, lambda w: "".join(c * 2 for c in w), lambda w: "".join(c * 3 for c in w), str.upper]
    known = [n[:-1] for n in model.names if n.endswith("$") and model.weights[model.names.index(n)] > 0.5]
    assert len(known) >= 3
    for word in known:
        for way in ways:
            assert abs(score(f"and {way(word)} there") - score(f"and {word} there")) <= 0.02, (word, way(word))


@pytest.mark.parametrize("n", [1, 3])
def test_few_toxic_labels_give_a_model(spark, n):
    texts, y = sentences(60)
    toxic = [i for i in range(60) if y[i]]
    keep = set([i for i in toxic if zlib.crc32(str(i).encode()) % 4 != 2][:n])
    labels = [(i, int(i in keep)) for i in range(60) if i in keep or not y[i]]
    model = toxicity.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    score = model.scorer()
    assert min(score(texts[i]) for i in keep) > max(score(texts[i]) for i, t in labels if not t)


def test_first_in_a_bare_session():
    """Operators that checkpoint find a folder in a session whose settings name none."""
    import subprocess
    import sys
    import tempfile

    code = """
from pyspark.sql import SparkSession
import __spark_entry__, sys
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
assert not spark.conf.get("spark.checkpoint.dir", "")
print("rows", __spark_entry__.queries()[sys.argv[1]](spark, "/root/testdata/sf0.001").count())
"""
    env = os.environ | {"SPARK_CONF_DIR": tempfile.mkdtemp(), "PYTHONPATH": ROOT}
    for name in ("op2_toxicity", "op13_lexical"):
        done = subprocess.run([sys.executable, "-c", code, name], capture_output=True, text=True, env=env, timeout=300, check=False)
        assert done.returncode == 0 and "rows " in done.stdout, done.stderr[-2000:]


def test_memos_are_bounded_and_change_nothing(words, monkeypatch):
    monkeypatch.setattr(toxicity, "MEMO_ENTRIES", 3)
    few = toxicity.Words(words.restorer.model, tuple)
    for text in ("you 1d10t and sc.um , what a l0ser", " ".join(PROSE), "st*pid you 1d10t and trash"):
        assert few.of(text) == words.of(text)
        assert len(few) <= 3 and len(few.older) <= 3


def test_worker_keeps_one_thing():
    from auditweave.llm import vocab

    path = vocab.default_path()
    small, made = vocab.ids_of(path, 5), []
    want = [small(" ".join(PROSE)) for _ in range(2)]
    assert vocab.ids_of(path, 5) is small and len(small) <= 5 and len(small.older) <= 5
    assert vocab.ids_of(path)(" ".join(PROSE)) == want[0] == want[1] and vocab.ids_of(path, 5) is not small
    common.remembered("other", lambda: made.append(dict(common._REMEMBERED)) or 1)
    assert made == [{}] and list(common._REMEMBERED) == ["other"]
    common.forget()
    assert not common._REMEMBERED


def test_pipeline_sends_small_batches(spark):
    import corpus_pipeline
    import pyarrow as pa

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        corpus_pipeline.secret_stage(spark, spark.createDataFrame([], "doc_id long, text string"), "")
        sizes = spark.range(0, 3000, 1, 1).selectExpr("repeat('x', 10000) AS t").mapInArrow(
            lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long"
        ).collect()
        assert len(sizes) > 5 and max(r.n for r in sizes) < 5 << 20
    finally:
        spark.conf.set(name, before)


def test_only_what_may_tell_is_decoded(words, monkeypatch):
    """Doubled letters that can hide no known feature cost no decoding, and no feature is lost by that."""
    index = {f: k for k, f in enumerate(f for w in ("idiot", "scum", "stupid", "loser", "utter") for f in toxicity.features(w))}

    def pick(fs):
        return tuple([index[f] for f in fs if f in index])

    model, decoded = words.restorer.model, []
    plain = toxicity.Restorer._restore
    monkeypatch.setattr(toxicity.Restorer, "_restore", lambda self, chunk: decoded.append(chunk) or plain(self, chunk))
    memo = toxicity.Words(model, pick)
    assert memo.of("thharesh etreeaioique, addition. plainly") == set() and not decoded
    r = np.random.default_rng(4)
    for word in ("idiot", "scum", "stupid", "loser", "utter", "butter", "scrum", "losers"):
        for _ in range(150):
            chunk = "".join(c * int(r.choice([1, 1, 1, 2, 3])) for c in word)
            chunk = str(r.choice(["", "", '"', "$", "("])) + chunk + str(r.choice(["", "", ",", ".", "!", "|"]))
            assert set(memo[chunk]) == set(pick([f for w in memo.words(chunk) for f in toxicity.features(w)])), chunk
    assert decoded
