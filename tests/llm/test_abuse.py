from __future__ import annotations

import random

import numpy as np
import pytest

from skein.llm import abuse as A


@pytest.mark.parametrize("text,word", [
    ("you c.r.e.t.i.n here", "cretin"), ("you cl0wn", "clown"), ("a h4lfw1+...", "halfwit"), ("the creeeetin", "cretin"), ("m​aggot", "maggot"),
    ("a b r a i n l e s s one", "brainless"), ("рarаsite", "parasite"), ("FOOL!!", "fool"), ("a cr*tin", "<mask>"), ("src/a/b.ts fails", "<id>"),
    ("renderThing fails", "<id>"), ("12 ms", "0"), ('say "pig" now', '"'), ("dev12 said", "<id>"), ("user7: a cr3t1n", "cretin"), ("Ausländer", "ausländer"),
])
def test_words_are_undisguised(text, word):
    assert any(word in p for p in A.passages(text))


def test_passages():
    assert A.passages(None) == A.passages("") == A.passages(" \n\t") == []
    ps = A.passages("One two. Three four\n<dev3> five")
    assert [p[1:] for p in ps] == [("one", "two"), ("three", "four"), ("five",)]
    long = A.passages(" ".join(f"w{chr(97 + i % 26)}" for i in range(5000)))
    assert all(len(p) <= 16 for p in long)
    assert ("<name>", "you", "silly", "goose") in A.passages("call youSillyGoose now")


def test_sentences_go_on_over_wrapped_lines_and_letters_end_with_a_tag():
    assert A.passages("you utter\ngoblin. Bye") == [("<s>", "you", "utter", "goblin"), ("<s>", "bye")]
    assert A.passages("YOU UTTER\nGOBLIN") == [("<s>", "you", "utter", "goblin")]
    assert A.passages("one\n- two\n\nthree\nFour") == [("<s>", "one"), ("<s>", "two"), ("<s>", "three"), ("<s>", "four")]
    assert A.passages("say g o b l <dev3> hello") == [("<s>", "say", "gobl"), ("<s>", "hello")]


def corpus(n, seed):
    rng = random.Random(seed)
    nouns = ["queue", "packet", "ledger", "roster"]
    clean = ["the {} waits for the {}", "please rename the {}", "no change in {}", 'the filter must reject "you utter {} goblin"', "i hate this {}"]
    bad = ["you utter goblin, leave the {}", "whoever wrote the {} is a goblin", "{} people are goblins and thieves"]
    texts, labels = [], []
    for i in range(n):
        parts = [rng.choice(clean).format(rng.choice(nouns), rng.choice(nouns)) for _ in range(rng.randint(2, 6))]
        y = int(rng.random() < 0.2)
        if y:
            parts.insert(rng.randrange(len(parts)), rng.choice(bad).format(rng.choice(nouns)))
        texts.append(". ".join(parts))
        labels.append(y)
    return texts, labels


def test_held_out_accuracy_with_noisy_verdicts():
    texts, labels = corpus(800, 1)
    rng = random.Random(9)
    noisy = [1 - y if rng.random() < 0.06 else y for y in labels]
    model = A.fit(texts, noisy)
    test, truth = corpus(400, 2)
    score = A.Scorer(model, at_once=7)
    scores = score(test)
    assert ((scores >= 0.6).astype(int) == np.array(truth)).mean() > 0.97
    assert len(model.at) < 5000  # L1 leaves few weights


def test_threshold_comes_from_documents_held_out():
    texts, labels = corpus(800, 1)
    model = A.fit(texts, labels)
    assert model.precision > 0.9 and model.recall > 0.9 and (model.documents, model.cases) == (800, sum(labels))
    test, truth = corpus(400, 3)
    called = A.Scorer(model)(test) >= model.threshold
    truth = np.array(truth) == 1
    assert (called & truth).sum() > 0.9 * truth.sum() and (called & truth).sum() > 0.9 * called.sum()
    # verdicts that say nothing, or far too few of them: no document is called a case
    rng = random.Random(3)
    assert A.fit(texts, [int(rng.random() < 0.1) for _ in texts]).threshold == float("inf")
    assert A.fit(texts[:12], labels[:11] + [1 - labels[10]]).threshold == float("inf")


def test_cut_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(30):
        y = (rng.random(200) < 0.3).astype(int)
        score = np.round(rng.normal(size=200) + 2 * y, 1)
        score[rng.random(200) < 0.05] = -np.inf
        weight = 9 * y.sum() / (1 - y).sum()
        best = (0.0, None)
        for t in np.unique(score[np.isfinite(score)])[::-1]:
            tp, fp = (y[score >= t]).sum(), (1 - y[score >= t]).sum()
            p, r = tp / (tp + weight * fp), tp / y.sum()
            best = max(best, (round(1.25 * p * r / (0.25 * p + r), 9) if tp else 0.0, t), key=lambda x: x[0])
        got = A.cut(score, y, 0.1, caution=0.0)
        tp, fp = y[score >= best[1]].sum(), (1 - y[score >= best[1]]).sum()
        if tp < weight * fp:
            assert got == (np.inf, 0.0, 0.0)
        else:
            assert got[0] == best[1] and np.isclose(got[1], tp / (tp + weight * fp)) and np.isclose(got[2], tp / y.sum())


def test_features_are_those_of_the_passage_alone():
    found = [("<s>", "a", "b", "a", "b"), ("c",), ("<s>", "a", "b", "c", "d", "e")]
    alone = [A.feature_rows([p], 20)[0].tolist() for p in found]
    assert [r.tolist() for r in A.feature_rows(found, 20)] == alone
    grams = lambda p: {p[i : i + n] for n in (1, 2, 3) for i in range(len(p) - n + 1)} | {("skip", g, p[i], p[i + g]) for g in (2, 3) for i in range(len(p) - g)}
    assert [len(r) for r in alone] == [len(grams(p)) for p in found]


def test_nothing_to_learn():
    assert A.fit([], []) is None and A.fit(["a", "b"], [0, 0]) is None and A.fit(["", None], [0, 1]) is None


def test_ftrl_equals_the_formula_one_example_at_a_time():
    """Batches of one follow the published per-coordinate update."""
    rows = [np.array([1, 3]), np.array([3]), np.array([0, 1])]
    y = np.array([1.0, 0.0, 1.0])
    m = A.Ftrl(bits=3, alpha=0.5, beta=1.0, l1=0.1, l2=1.0)
    m.learn(A.Rows.of(rows), y, np.ones(3), epochs=1, seed=0, batch=1)
    z, n, bz, bn = np.zeros(8), np.zeros(8), 0.0, 0.0
    for i in np.random.default_rng(0).permutation(3):
        w = {j: 0.0 if abs(z[j]) <= 0.1 else -(z[j] - np.sign(z[j]) * 0.1) / ((1 + n[j] ** 0.5) / 0.5 + 1) for j in rows[i]}
        b = -bz / ((1 + bn**0.5) / 0.5)
        g = 1 / (1 + np.exp(-(sum(w.values()) + b))) - y[i]
        for j in rows[i]:
            s = ((n[j] + g * g) ** 0.5 - n[j] ** 0.5) / 0.5
            z[j] += g - s * w[j]
            n[j] += g * g
        bz, bn = bz + g - ((bn + g * g) ** 0.5 - bn**0.5) / 0.5 * b, bn + g * g
    assert np.allclose(m.z, z) and np.allclose(m.n, n) and np.isclose(m.bias_z, bz)


def test_documents(spark):
    texts, labels = corpus(300, 4)
    rows = [(i, t, "src") for i, t in enumerate(texts)] + [(900, None, None), (901, "", "src"), (902, texts[labels.index(1)] * 200, "src"), (0, texts[0], "src")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    verdicts = [(i, y) for i, y in enumerate(labels)] + [(1, None), (2, 1), (2, 0), (None, 1)]
    labs = spark.createDataFrame([(i, y, "r") for i, y in verdicts], "doc_id bigint, abusive int, text string")
    held = {r["doc_id"]: r["label"] for r in A.verdicts(labs).collect()}
    assert held[1] == labels[1] and held[2] == labels[2] and None not in held
    model = A.train(docs, labs)
    got = docs.select("doc_id", A.abuse_score(docs["text"], model, spark).alias("p")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["p"] for r in got}
    assert by[900] == by[901] == 0.0 and by[902] > 0.6
    called = docs.select("doc_id", A.abuse_score(docs["text"], model, spark).alias("score")).where(A.is_case(model)).count()
    assert 0 < called < len(rows) and docs.selectExpr("1.0d as score").where(A.is_case(None)).count() == 0
    assert A.train(docs, labs, max_chars=0) is None and A.train(docs, labs, max_documents=50).documents <= 50
    none = docs.select(A.abuse_score(docs["text"], A.train(docs, labs.limit(0)), spark).alias("p")).distinct().collect()
    assert [r["p"] for r in none] == [0.0]
    assert A.train(docs.limit(0), labs) is None
