"""Repeated rows, missing ids, clashing columns, long texts, conflicting labels; and SQL of the operators."""

import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auditweave.llm import common, lines, quality, registry, simhash, toxicity

DATA = "/root/testdata/sf0.001"
#: Names that operators might use for columns of their own.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, label string, score double, at int, key string, id long, mark int, kind string, spans string"


def rows(texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, "en", "s", None if t is None else len(t), "l", 0.5, 1, "k", 2, 3, "d", "s") for i, t in zip(ids, texts, strict=True)]


@pytest.fixture(scope="module")
def awkward(spark):
    long = "a very long text of many words and lines\n" * 20_000
    texts = [None, "", " ", "one line", "one line", "one line", long, "\n\n", "token = 0123456789abcdef", "you i.d.i.o.t"]
    return spark.createDataFrame(rows(texts, [None, 1, 2, 3, 3, None, 6, 7, 8, 9]), CLASHING)


@pytest.fixture(scope="module")
def labels_of(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (1, 1, 0), (9, 0, 1), (3, 1, 0), (3, 1, 0), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = con.execute(registry.ORACLES[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[k] for k in order)) for r in want.fetchall())


def test_rows_are_documents(spark):
    """A line in ten rows of one id is in ten documents; in ten places of one row it is in one."""
    df = spark.createDataFrame(rows(["again\nx"] * 10 + ["often\n" * 12 + "y"], [5] * 10 + [6]), CLASHING)
    got = lines.drop_lines(df)
    assert got.columns == df.columns
    assert sorted(x.text for x in got.collect()) == sorted(["often\n" * 12 + "y"] + [""] * 10)


def test_stages(spark, awkward, labels_of, monkeypatch):
    """Every stage takes awkward rows and an empty table; all but the last keep the columns."""
    monkeypatch.setattr(common, "table", lambda *_: labels_of)
    for name, stage in corpus_pipeline.STAGES:
        for df in (awkward, awkward.limit(0)):
            out = stage(spark, df, "none")
            n = out.count()
            if name != "packing":
                assert out.columns == df.columns, name
                assert n <= df.count() and (n or name == "toxicity" or not df.count()), name
            elif n:
                assert out.select("doc_id").distinct().count() == awkward.select("doc_id").distinct().count()


def test_quality_takes_awkward_rows(spark, awkward, labels_of):
    got = quality.score(quality.features(awkward), quality.fit(quality.features(awkward, labels_of)))
    assert got.count() == awkward.count() and got.where("score IS NULL OR isnan(score)").count() == 0


def test_toxicity_takes_awkward_rows(awkward, labels_of):
    got = toxicity.score_texts(awkward, toxicity.fit(awkward, labels_of), "own")
    assert got.columns == [*awkward.columns, "own"] and got.count() == awkward.count()
    assert got.where("own IS NULL OR own < 0 OR own > 1").count() == 0


def test_views_are_separate():
    """The text view sees the text alone, the page view none of it."""
    views = quality.Views()
    assert views.page("en", "s", 100) == views.page("en", "s", 100) != views.page("en", "t", 100)
    assert views.page(None, None, None) != views.page("en", "s", 0)
    assert max(views.page("en", "s", 1 << 60)) < 256


def test_co_training_sees_every_document(spark):
    """The surest documents of the pool are given away wherever they are, past any sample's size."""
    r = np.random.default_rng(1)
    n = 9000
    good = np.arange(n) % 2 == 0
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    texts = [" ".join(r.choice(words, 12)) if g else "bad bad bad bad" for g in good]
    made = [(i, t, "en", "g" if g else "b", len(t)) for i, (t, g) in enumerate(zip(texts, good, strict=True))]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(good[i]), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    seen = []
    co_train = quality.co_train

    def watched(x, y, judge, rounds, given):
        def told(views, wanted):
            out = judge(views, wanted)
            seen.append([len(rows[0]) for _, _, rows in out])
            return out

        return co_train(x, y, told, 2, given)

    quality.co_train, old = watched, co_train
    try:
        quality.fit(quality.features(docs, labels), given=5000, confident=0.5)
    finally:
        quality.co_train = old
    assert sum(seen[0]) > 2 * 4000 and min(map(sum, seen)) >= 0
    assert sum(map(sum, seen)) <= 2 * (n - 60)  # either view gives a document once


def all_readings(chunk, model):
    """The cheapest reading of a chunk by trying every path of the lattice."""
    best = [np.inf, ""]
    codes, letters = toxicity._CODE, toxicity.LETTERS

    def walk(at, a, b, price, word):
        if price >= best[0]:
            return
        if at == len(chunk):
            price += float(model[a, b, 0]) if b else 0.0
            if price < best[0]:
                best[:] = [price, word.strip()]
            return
        c = chunk[at]
        options = [(codes[c], 0.0)] if c in codes and c != " " else []
        options += [(codes[x], toxicity._PRICE_WILD if c in "*#" else toxicity._PRICE_SIGN) for x in toxicity.SIGNS.get(c, "")]
        repeat = at > 0 and c == chunk[at - 1] and c.isalpha()
        for x, p in options:
            walk(at + 1, b, x, price + p + float(model[a, b, x]) + (toxicity._PRICE_DOUBLE if repeat and x == b else 0.0), word + letters[x])
        silent = c in toxicity.SEPARATORS or not (c.isalnum() or c in toxicity.SIGNS) or (not c.isalnum() and at in (0, len(chunk) - 1))
        if silent or (repeat and options and options[0][0] == b) or not options:
            walk(at + 1, a, b, price + (toxicity._PRICE_REPEAT if repeat else toxicity._PRICE_SILENT), word)
        if c in toxicity.SEPARATORS and b:
            walk(at + 1, b, 0, price + toxicity._PRICE_SILENT + float(model[a, b, 0]), word + " ")

    walk(0, 0, 0, 0.0, "")
    return best


def test_decoder_finds_the_cheapest_reading():
    r = np.random.default_rng(5)
    c = toxicity._codes("  idiot loser scum stupid trash the and there was a day " * 10 + " ").astype(np.int32)
    model = toxicity.log_model(toxicity._trigrams([c]).astype(float).reshape((toxicity._K,) * 3))
    restorer = toxicity.Restorer(model)
    for _ in range(300):
        chunk = "".join(r.choice(list("idotlsecum10$@!.-* "), int(r.integers(1, 8)))).strip() or "x"
        price, word = all_readings(chunk, model)
        got = restorer.restore(chunk)
        assert got == word or abs(price_of(chunk, got, model) - price) < 1e-4, chunk


def price_of(chunk, word, model):
    """The cheapest path that reads this word."""
    prices = []

    def only(at, a, b, price, rest):
        if at == len(chunk):
            if not rest.strip():
                prices.append(price + (float(model[a, b, 0]) if b else 0.0))
            return
        c = chunk[at]
        options = [(toxicity._CODE[c], 0.0)] if c in toxicity._CODE and c != " " else []
        options += [(toxicity._CODE[x], toxicity._PRICE_WILD if c in "*#" else toxicity._PRICE_SIGN) for x in toxicity.SIGNS.get(c, "")]
        repeat = at > 0 and c == chunk[at - 1] and c.isalpha()
        for x, p in options:
            if rest and rest[0] == toxicity.LETTERS[x]:
                only(at + 1, b, x, price + p + float(model[a, b, x]) + (toxicity._PRICE_DOUBLE if repeat and x == b else 0.0), rest[1:])
        silent = c in toxicity.SEPARATORS or not (c.isalnum() or c in toxicity.SIGNS) or (not c.isalnum() and at in (0, len(chunk) - 1))
        if silent or (repeat and options and options[0][0] == b) or not options:
            only(at + 1, a, b, price + (toxicity._PRICE_REPEAT if repeat else toxicity._PRICE_SILENT), rest)
        if c in toxicity.SEPARATORS and b and (not rest or rest[0] == " "):
            only(at + 1, b, 0, price + toxicity._PRICE_SILENT + float(model[a, b, 0]), rest[1:])

    only(0, 0, 0, 0.0, word)
    return min(prices, default=np.inf)


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        common.shared_folder(Session())
