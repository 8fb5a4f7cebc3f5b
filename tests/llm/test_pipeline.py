"""Stages of the corpus pipeline: what goes, what stays, and the columns."""

import corpus_pipeline as p

A = " ".join(f"a{k}" for k in range(60))
B = " ".join(f"b{k}" for k in range(60))
ROWS = [(3, A), (1, A + " tail"), (2, B), (2, B), (4, None), (5, ""), (None, B), (6, "short one")]


def test_near_duplicates_keep_one_of_each_group(spark):
    docs = spark.createDataFrame([(k, t, len(t or "")) for k, t in ROWS], "doc_id long, text string, n_chars long")
    kept = p.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 4, 5, 6]
    assert p.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_near_duplicates_go_by_row_not_by_id(spark):
    """Two texts under one id: the copy goes, the text that has none stays."""
    rows = [(3, A), (5, A), (5, B), (7, B + " tail"), (8, A + " end"), (8, A + " end"), (None, A)]
    docs = spark.createDataFrame([(k, t, len(t), 1) for k, t in rows], "doc_id long, text string, n_chars long, _mark int")
    kept = p.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in kept.collect()) == [(0, A), (3, A), (5, B)]


def test_near_duplicates_at_five_words_and_four_fifths(spark):
    rows, own = [], [f"c{k}" for k in range(94)]  # 90 shingles of five words, 91 of four
    for group, places in enumerate(((40, 70), (30, 60))):
        words = [f"{group}{w}" for w in own]
        rows.append((10 * group, " ".join(words)))
        rows.append((10 * group + 1, " ".join("x" if k in places else w for k, w in enumerate(words))))

    def jaccard(a, b, n):
        x, y = ({tuple(t.split()[k:k + n]) for k in range(95 - n)} for t in (a, b))
        return len(x & y) / len(x | y)

    near = [(jaccard(rows[k][1], rows[k + 1][1], 5), jaccard(rows[k][1], rows[k + 1][1], 4)) for k in (0, 2)]
    assert [0.8 <= five <= 0.82 and four < 0.85 for five, four in near] == [True, True], near
    docs = spark.createDataFrame([(k, t, len(t)) for k, t in rows], "doc_id long, text string, n_chars long")
    assert sorted(r["doc_id"] for r in p.drop_near_duplicates(spark, docs, "").collect()) == [0, 10]


def test_leaks_go_and_personal_data_is_hidden(spark, tmp_path):
    spark.createDataFrame([(1, B)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, f"x {B} y", 1), (2, "ip 10.1.2.3", 11), (3, None, 0)], "doc_id long, text string, n_chars long")
    kept = p.drop_benchmark_leaks(spark, docs, str(tmp_path))
    hidden = {r["doc_id"]: r for r in p.hide_personal_data(spark, kept, "").collect()}
    assert set(hidden) == {2, 3} and "10.1.2.3" not in hidden[2]["text"]
    assert hidden[2]["n_chars"] == len(hidden[2]["text"]) and hidden[3]["text"] is None
