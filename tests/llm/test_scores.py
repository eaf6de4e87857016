"""Toxicity grammar and factorisation machine: rules, held-out accuracy, odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from curves.llm import quality_fm, toxicity
from curves.llm.toxicity import Grammar
from tests.llm.data import ODD, documents, prose

DATA = "/root/testdata/sf0.1"


def test_clauses_not_words_are_scored():
    score = Grammar({"=zork": 0.8}).score
    assert score("a fine day. nothing here") == score("") == 0
    for lone in ("idiot", "scum", "this stupid printer jammed", "the word idiot", "a zork"):
        assert 0 < score(lone) < 0.3
    assert score("you are an idiot") > 0.5 and score("idiot scum") > 0.5 and score("an idiot and, as ever, a moron") > 0.5
    assert score("you are not an idiot") < 0.3 < score("you are an idiot. it is not so")
    assert 0.3 < score("they said idiot") < score("idiot they")
    assert score("i will kill you") > 0.3 and score("kill the lights") == 0
    assert score("never will kill you") < score("i will kill you")
    assert score("a zork\nanother zork") > 0.3  # a second clause repeats it
    assert score("a zork. " + "word " * 500 + "zork") == score("a zork\nanother zork")


def test_composed_machine_forgets():
    score = Grammar({}).score
    near, far = score("not idiot"), score("not a b c idiot")
    assert near < far == score("idiot")


def plain_emissions(clauses):
    """The grammar by positions instead of states; clauses: lists of (class, weight)."""
    out, before = [], False
    for clause in clauses:
        kinds, held, insulted, spent = [k for k, _ in clause], None, False, set()
        for i, (kind, weight) in enumerate(clause):
            said = 0.6 if toxicity.REPORT in kinds[:i] else 1.0
            told = said * (0.3 if toxicity.NEGATION in kinds[max(i - 2, 0) : i] else 1.0)
            waiting = [j for j in range(max(i - 3, 0), i) if kinds[j] == toxicity.VIOLENCE][-1:]
            waiting = [j for j in waiting if not spent & set(range(j, i))]
            if kind == toxicity.INSULT:
                aimed = toxicity.TARGET in kinds[max(i - 4, 0) : i]
                if aimed or insulted or waiting:
                    out.append(("aimed" if aimed else "piled", max(weight * told, held[1] if held else 0.0)))
                    held = None
                else:
                    held = i, weight * told
                insulted = True
            if kind == toxicity.TARGET:
                if waiting:
                    out.append(("threat", said * (0.3 if toxicity.NEGATION in kinds[max(waiting[0] - 2, 0) : waiting[0]] else 1.0)))
                    spent.add(i)
                elif held and i - held[0] <= 2:
                    out.append(("aimed", held[1]))
                    held = None
        if held:
            out.append(("repeated" if before else "lone", held[1]))
            before = True
    return out


def test_grammar_equals_plain_version_on_random_clauses():
    rng, grammar = np.random.default_rng(4), Grammar({})
    patterns = set()
    for _ in range(4000):
        clauses = [[(int(k), 0.7) for k in rng.choice(6, rng.integers(1, 9), p=[0.35, 0.2, 0.1, 0.15, 0.1, 0.1])] for _ in range(rng.integers(1, 4))]
        seen = [((k, w, i + 1 == len(c)), 0) for c in clauses for i, (k, w) in enumerate(c)]
        want = plain_emissions(clauses)
        assert grammar.match(seen) == [(p, pytest.approx(s)) for p, s in want]
        patterns |= {p for p, _ in want}
        packed = []  # plain words as counts, as texts are read
        for (k, w, end), _ in seen:
            if k or end or not packed:
                packed.append(((k, w, end), 0))
            else:
                packed[-1] = packed[-1][0], packed[-1][1] + 1
        assert grammar.match(packed) == grammar.match(seen)
    assert patterns == {*toxicity.PATTERNS, "lone"}


def test_the_states_decide_and_learned_pattern_weights_follow_the_labels(spark):
    """Insults at people are toxic here, the same words alone or reported are not: word counts can't tell them apart."""
    rng = np.random.default_rng(6)
    texts, toxic = [], []
    for i in range(600):
        word, tail = rng.choice(["idiot", "clown", "trash"]), prose(i, 30)
        kind = i % 3
        texts.append(f"{tail}. {['you ' + word, 'the ' + word, 'nothing'][kind]} here. {prose(i + 999, 20)}")
        toxic.append(int(kind == 0))
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], "doc_id bigint, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels, 4, 2).collect()}
    assert all(out[i].predicted == y for i, y in enumerate(toxic))
    _, patterns = toxicity.learn(docs, labels, 4, 2)
    assert patterns["aimed"] > 0.9


def test_very_long_texts_are_read_whole():
    score = Grammar({}).score
    assert score("word " * 1_000_000 + ". you idiot") == score("you idiot")
    assert len(quality_fm.features("word " * 1_000_000)[0]) < 100


@pytest.mark.parametrize(("op", "label", "least"), [(toxicity.op1_toxicity, "toxic", 0.9), (quality_fm.op7_quality_fm, "quality", 0.99)])
def test_held_out_accuracy(spark, op, label, least):
    out = op(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    pos, ranks = out[label] == 1, out["score"].rank()
    auc = (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > least
    assert out["score"].between(0, 1).all()


@pytest.mark.parametrize("op", [toxicity.toxicity, quality_fm.quality])
def test_odd_rows_and_missing_labels(spark, op):
    docs = documents(spark, [*ODD, prose(1, 50)])
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 1), (10, 1, None), (None, 1, 1), (99, 0, 1)], "doc_id bigint, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        out = op(docs, known, 4, 2).collect()
        assert len(out) == docs.count()
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in out)
        assert len({r.score for r in out if r.doc_id == 7}) == 1
    assert op(docs.limit(0), labels, 4, 2).count() == 0


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    params = rng.normal(0, 1, (50, 5)).astype(np.float32)
    rows = [(rng.choice(50, n, replace=False).astype(np.int32), rng.random(n).astype(np.float32)) for n in (1, 4, 9)]
    got = quality_fm.raw_scores(params, rows)[0]
    for (idx, val), y in zip(rows, got, strict=True):
        pairs = sum(params[a, 1:] @ params[b, 1:] * x * z for i, (a, x) in enumerate(zip(idx, val, strict=True)) for b, z in list(zip(idx, val, strict=True))[:i])
        assert y == pytest.approx(params[idx, 0] @ val + pairs, rel=1e-3, abs=1e-3)


def test_training_step_equals_the_numeric_gradient(monkeypatch):
    """One AdaGrad step on a minibatch, from the slope of the loss in every parameter."""
    rng = np.random.default_rng(8)
    start = rng.normal(0, 0.5, (30, 4))
    rows = [(rng.choice(30, n, replace=False).astype(np.int32), rng.random(n)) for n in (3, 5, 8, 2)]
    labels = np.array([0.0, 1.0, 1.0, 0.0])

    def loss(params):
        z = quality_fm.raw_scores(params, rows)[0]
        return float(np.mean(np.log1p(np.exp(-np.where(labels == 1, z, -z)))))

    slope = np.zeros_like(start)
    for at in np.ndindex(*start.shape):
        step = np.zeros_like(start)
        step[at] = 1e-5
        slope[at] = (loss(start + step) - loss(start - step)) / 2e-5
    used = np.unique(np.concatenate([r[0] for r in rows]))
    slope[used] += quality_fm.DECAY * start[used]
    monkeypatch.setattr(quality_fm, "PASSES", 1)
    params, grads = start.copy(), np.full(start.shape, 0.1)
    quality_fm.fit(params, grads, rows, labels, 0)
    want = start - quality_fm.RATE * slope / np.sqrt(0.1 + slope**2 + 1e-8)
    assert np.allclose(params, want, atol=1e-5) and np.abs(params - start).max() > 1e-3


def test_training_gives_the_same_model_however_rows_are_dealt(spark):
    docs = documents(spark, [prose(i, 40) for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    a = quality_fm.train(docs.repartition(1), labels.repartition(3), 3, 1)
    b = quality_fm.train(docs.repartition(7), labels, 3, 1)
    assert np.array_equal(a, b)


@pytest.mark.parametrize("text", ["I killed you", "he kills you", "they threaten to murder you", "ich werde dich töten", "er tötet dich", "je vais te frapper", "voy a matarte, te voy a matar", "kill the people"])
def test_threats_in_any_form_and_order(text):
    assert Grammar({}).score(text) >= 0.3


@pytest.mark.parametrize("text", ["I won't kill you", "I can’t kill them", "they cannot hurt you", "kill the lights you fool", "he destroyed a city before they came", "ich werde dich nicht töten", "the stable door hurtles", "te digo la verdad"])
def test_negated_threats_and_other_objects_stay_below(text):
    assert Grammar({}).score(text) < 0.3


def test_insults_in_the_plural():
    score = Grammar({}).score
    assert score("you absolute idiots") > 0.3 > score("idiots") > 0
