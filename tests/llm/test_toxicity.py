import random
import zlib

import numpy as np

from waymark.llm.toxicity import Model, candidates, choose, keep_clean, label_model, logistic, score_documents, styles, train


def make(n, seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("aeioubcdfgl") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randrange(5, 80))]
        bad = rng.random() < 0.12
        if bad:
            for _ in range(rng.randrange(2, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(["zumscu", "vilewret", "Zorg" + rng.choice(vocab)]))
        docs.append((i, " ".join(w), "x"))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = make(1600)
    df, lab = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = train(df, lab)
    out = {r.doc_id: r for r in score_documents(df, model).collect()}
    truth = dict(labels)
    for i, r in out.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
    held = [(truth[i], out[i].predicted) for i in truth if out[i].held_out]
    assert np.mean([a == b for a, b in held]) > 0.97
    kept = keep_clean(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if not r.predicted}
    again = train(df.repartition(5), lab.repartition(2))
    assert np.allclose(again.weights, model.weights, atol=1e-9)


def test_held_out_labels_are_not_read(spark):
    docs, labels = make(800)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    a, b = (train(df, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert a.words == b.words and a.once == b.once and a.twice == b.twice and np.array_equal(a.weights, b.weights)


def test_odd_rows(spark):
    docs, labels = make(800)
    docs += [(900, None, None), (901, "", None), (None, "zumscu vilewret", None), (5, docs[5][1], "x"), (902, "zumscu vilewret " + "word " * 50000, "x")]
    labels += [(900, None), (None, 1), (labels[0][0], labels[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string, predicted string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = train(df, lab)
    out = score_documents(df, model).collect()
    assert len(out) == len(docs)
    by = {r.doc_id: r.predicted for r in out}
    assert by[900] == by[901] == 0 and by[None] == 1 and by[902] == 1
    assert score_documents(df.where("false"), model).collect() == []
    none = train(df, lab.where("false"))
    assert {r.predicted for r in score_documents(df, none).collect()} == {0}


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(6000) < 0.2
    rates = np.array([[0.02, 0.05, 0.01, 0.3], [0.6, 0.5, 0.4, 0.3]])
    votes = (rng.random((6000, 4)) < rates[y.astype(int)]).astype(float)
    votes = np.column_stack([votes, votes[:, 0]])  # a copy of the first voter
    post, got, weight = label_model(votes, np.where(votes[:, :3].sum(axis=1) > 0, 0.7, 0.1))
    assert np.abs(got[:, :4] - rates).max() < 0.1 and weight[0] < 0.55 < weight[1]
    assert np.mean((post > 0.5) == y) > 0.87
    w = logistic(np.column_stack([np.ones(6000), votes]), post)
    assert w[2] > 1 and abs(w[4]) < 1.5


def test_terms():
    counts = [("badword", 40, 0), ("badw*", 40, 0), ("bad*", 60, 10), ("fine", 50, 500), ("rare", 2, 0)]
    assert sorted(candidates(counts, 100, 900)) == ["bad*", "badw*", "badword"]
    # candidate 1 only marks texts that candidates 0 and 2 mark already
    held, marked = [[0, 1, 2]] * 20 + [[0, 2]] * 20 + [[]] * 300, [True] * 40 + [False] * 300
    assert choose(held, marked, ["bad", "copy", "worse"]) == [0, 2]
    assert Model(base=0.1).score(["x"])[0] == 0.1
    m = Model.of(["bad", "wor*", "wor**"], 0.0)
    assert sorted(m.hits({"bad", "word"})[0]) == [0, 1] and sorted(m.hits({"word", "work"})[0]) == [1, 2] and m.hits({"wor"}) == ([], 0)


def test_copies_leave_room_for_other_voters(spark):
    docs, labels = make(1600)
    rng = random.Random(5)
    long = " ".join("q" + "".join(rng.choice("aeiourstln") for _ in range(9)) for _ in range(400))
    marked = {i for i, y in labels if y}
    for i in range(2000, 2000 + 2 * len(marked)):
        docs.append((i, long, "x"))  # a third of the toxic texts and more are copies of one
        labels.append((i, 1))
    model = train(spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    others = [t for i, t, _ in docs if i in marked]
    assert np.mean([bool(model.hits(set(t.lower().split()))[0]) for t in others]) > 0.95
    # near copies: each has a word of its own, so all of their words stay significant
    near = [(i, f"{t} z{i}q" if i >= 2000 else t, s) for i, t, s in docs]
    model = train(spark.createDataFrame(near, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert np.mean([bool(model.hits(set(t.lower().split()))[0]) for t in others]) > 0.95


def test_capitals_of_whole_texts():
    for n in (10, 4100, 7000, 7990, 8000, 9001, 20000):
        few, many = ("AAAbbbbbbb" * n)[:n], ("bAAAAAAbbA" * n)[:n]
        assert [styles(t, {"x"})[1] for t in (few, many, "b" * 4000 + "A" * n, "bA" * n)] == [False, True, n > 4000, False]
    assert not styles("", set())[1]
