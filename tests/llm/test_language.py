"""Language identification: held-out accuracy, gradients, odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from workpanel.llm.common import table
from workpanel.llm.language import BATCH, EMPTY, WINDOW, ByteNet, languages, log_softmax, window_table
from workpanel.llm.queries import op12_byte_convolution_language

R = random.Random(5)
WORDS = {"aa": "the and that with from have this".split(), "bb": "der und nicht mit eine für über".split()}


def prose(lang, n):
    return " ".join(R.choice(WORDS[lang]) for _ in range(n))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    rows = op12_byte_convolution_language(spark, sf).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 150 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_inputs(spark):
    long = prose("bb", 40_000)
    rows = [(k, prose(lang, R.randrange(1, 80)), lang) for k, lang in enumerate(["aa", "bb"] * 80)]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 34 !?", "bb"), (903, long, None), (904, prose("aa", 30), None),
             (905, prose("aa", 30), None), (None, prose("bb", 50), "bb"), (906, long, None)]
    docs = spark.createDataFrame([(*r, "x", 0.5, "y") for r in rows],
                                 "doc_id long, text string, lang string, lang_pred string, score double, langs string").repartition(3)
    out = languages(docs, F.col("doc_id") < 160)
    assert set(out.columns) == set(docs.columns) and out.count() == len(rows)
    by_id = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out.collect()}
    assert by_id[900] == by_id[901] == by_id[902] == ("und", 0.0)
    assert by_id[903][0] == "bb" and by_id[903] == by_id[906] and by_id[904][0] == by_id[905][0] == "aa" and by_id[None][0] == "bb"
    assert languages(docs.limit(0), F.lit(True)).count() == 0
    none = languages(docs, F.lit(False)).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    one = {r["doc_id"]: r for r in languages(docs, F.col("lang") == "aa").collect()}
    assert one[0]["lang_pred"] == "aa" and one[0]["score"] == 1.0


def test_copies_do_not_widen_the_sample(spark):
    """Two thirds of the rows are one text: it is learned once."""
    from workpanel.llm import language

    text = prose("aa", 30)
    docs = spark.range(9000).select(F.lit(text).alias("text"), F.lit("aa").alias("lang")).unionAll(
        spark.createDataFrame([(prose("bb", 30), "bb") for _ in range(50)], "text string, lang string"))
    assert language.labelled_sample(docs, F.lit(True), "lang", "text").count() == 51


def test_every_window_counts():
    net = ByteNet(["aa", "bb"])
    text = (prose("aa", 6000) + prose("bb", 6000)).encode()
    lang, score = net.predicted([text.decode(), "x", None])
    parts = [text[k:k + WINDOW] for k in range(0, len(text), WINDOW)]
    assert len(parts) > BATCH
    each, n = net.log_probabilities(window_table(parts)), np.array([len(p) for p in parts])
    share = np.exp(log_softmax((each * n[:, None]).sum(0, keepdims=True) / n.sum()))[0]
    assert lang[0] == net.langs[share.argmax()] and score[0] == pytest.approx(share.max(), abs=1e-5)


def test_gradients_are_those_of_the_loss():
    net = ByteNet(["a", "b", "c"])
    # away from 0, where the largest answer of an empty span would have a kink
    net.p = {k: v.astype("f8") + 0.1 * k.startswith("shift") for k, v in net.p.items()}
    windows = window_table([b"some text", b"another one", b"xyz", b"q"])[:, :12]
    truth = np.array([0, 1, 2, 0])
    loss = lambda: -net.log_probabilities(windows)[np.arange(4), truth].mean()
    for name, g in net.gradients(windows, truth).items():
        flat = net.p[name].reshape(-1)
        places = [i for i in np.argsort(-np.abs(g.ravel()))[:5] if name != "bytes" or i < EMPTY * 8]
        for i in places:
            at, eps = flat[i], 1e-6
            flat[i] = at + eps
            up = loss()
            flat[i] = at - eps
            down = loss()
            flat[i] = at
            assert (up - down) / (2 * eps) == pytest.approx(g.ravel()[i], rel=1e-3, abs=1e-6)
