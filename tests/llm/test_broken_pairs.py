import itertools
import os

import numpy as np
import pytest

from benthos.llm import broken_pairs as B
from benthos.llm.crf import Crf

TABLES = "/root/testdata/sf0.01"
TURN = "array<struct<speaker:string,value:string>>"
SAMPLES = f"row_no long, conversations {TURN}, answer_form string"
PREDICTIONS = "pred_no long, prompt string, text string, gt string, answer_form string"
PLACES = ["the pier", "a coral wall", "the old wreck", "a sandy slope"]
BEASTS = ["eel", "ray", "crab", "goby", "squid"]


def sound():
    rows = []
    for k, (p, b, n) in enumerate(itertools.product(PLACES, BEASTS, range(8))):
        q, a = f"<image>\nWhat does the {b} do near {p}?", f"The {b} rests beside {p} for {n + 2} minutes. Two divers watched the {b} from {p} until the light was gone."
        if k % 6 == 5:
            q, a = "¿Qué se ve en esta fotografía del fondo?", f"En la parte inferior se ve un pez cerca de la roca número {n}. El buzo nadaba hacia la cueva antes del anochecer."
        rows.append((k, [("human", q), ("gpt", a)], "sentence"))
    return rows


def test_viterbi_and_likelihood():
    rng = np.random.default_rng(0)
    crf = Crf(6, 3)
    crf.w[:] = rng.normal(size=(6, 3))
    crf.t[:] = rng.normal(size=(3, 3))
    e = rng.normal(size=(4, 3))
    best = max(itertools.product(range(3), repeat=4), key=lambda y: sum(e[i, k] for i, k in enumerate(y)) + sum(crf.t[a, b] for a, b in zip(y, y[1:])))
    assert tuple(crf.decode(e, np.array([4]))) == best
    xs, ys = [[[0, 1], [2], [3, 4]], [[5], [1]]], [[0, 2, 1], [1, 1]]

    def loss():
        total = 0.0
        for x, y in zip(xs, ys):
            em = np.array([crf.w[f].sum(0) for f in x])
            score = lambda z: sum(em[i, k] for i, k in enumerate(z)) + sum(crf.t[a, b] for a, b in zip(z, z[1:]))  # noqa: B023, E731
            total += np.log(sum(np.exp(score(z)) for z in itertools.product(range(3), repeat=len(x)))) - score(y)
        return total

    gw, gt = crf._gradient(xs, ys)
    for m, g in ((crf.w, gw), (crf.t, gt)):
        for at in [(0, 1), (1, 2), (2, 0)]:
            old = m[at]
            m[at] = old + 1e-5
            up = loss()
            m[at] = old - 1e-5
            down = loss()
            m[at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-4


def test_defects(spark):
    broken = {
        1000: ("What does the eel do near the pier?", "  \n", "empty"),
        1001: ("What does the eel do near the pier?", None, "empty"),
        1002: ("What does the eel do near the pier?", "N/A", "empty"),
        1003: ("What does the eel do near the pier?", "> WHAT DOES THE EEL DO NEAR THE PIER?", "copy"),
        1004: ("What does the ray do near the old wreck?", "I'm sorry, but I cannot help with that. Please provide more context.", "refusal"),
        1005: ("What does the crab do near a coral wall?", "En la parte inferior se ve un pez cerca de la roca. El buzo nadaba hacia la cueva antes del anochecer.", "language"),
        1006: ("What does the crab do near a coral wall?", "The crab rests beside a coral wall for 3 minutes. Two divers watched the", "truncated"),
        1007: ("What does the crab do near a coral wall? Answer in Spanish.", "En la parte inferior se ve un pez cerca de la roca.", None),
        1008: ("What does the crab do near a coral wall?", "What does the crab do near a coral wall? The crab rests beside a coral wall for 3 minutes.", None),
        1009: ("What does the crab do near a coral wall?", "The crab rests beside a coral wall for 4 minutes", None),
        1010: (None, "yes", None),
        1011: ("Give the box of the crab as JSON.", '{"bbox_2d": [1, 2, 3, 4], "label": "crab"}', None),
        1012: ("Give the box of the crab as JSON.", '{"bbox_2d": [1, 2,', "truncated"),
    }
    rows = sound() + [(k, [("system", "s"), ("human", q), ("gpt", a)], "sentence") for k, (q, a, _) in broken.items()]
    rows += [(2000, [("human", "List all."), ("gpt", "a;")], "list"), (2001, None, "sentence"), (2002, [("human", "q")], None)]
    samples = spark.createDataFrame(rows, SAMPLES).selectExpr("*", "1 AS defect", "2 AS question", "3 AS t")
    predictions = spark.createDataFrame([(1, "What does the eel do near the pier?", "null", "The eel rests beside the pier for 2 minutes.", "sentence"), (2, "List all.", "", "", "list"), (3, None, None, "no", None)], PREDICTIONS)
    got = {(r.field_name, r.row_key): (r.turn, r.defect) for r in B.defects(samples, predictions).collect()}
    expected = {("conversations", k): (2, d) for k, (_, _, d) in broken.items() if d} | {("text", 1): (0, "empty"), ("text", 3): (0, "empty")}
    assert {k: v for k, v in got.items() if k in expected} == expected
    wrong = [k for k in got if k not in expected]
    assert len(wrong) <= 2, wrong
    assert B.defects(samples.limit(0), predictions.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables here")
def test_held_out_accuracy(spark):
    """Fitted on half of the sound pairs, told the made defects of the other half."""
    pairs = B.sample_pairs(spark.read.parquet(f"{TABLES}/samples.parquet"), 3000)
    model, _ = B.fit(pairs[::2])
    _, xs, ys = B.training_set(pairs[1::2], seed=11)
    flat = [f for x in xs for f in x]
    items = np.repeat(np.arange(len(flat)), [len(f) for f in flat])
    tags = model.decode(model.emissions(items, np.array([v for f in flat for v in f]), len(flat)), np.array([len(x) for x in xs]))
    gold = np.array([y for s in ys for y in s])
    assert (tags == gold).mean() > 0.95
    assert all((tags[gold == k] == k).mean() > 0.85 for k in range(5))


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables here")
def test_what_no_list_names(spark):
    """Languages that neither the sample nor a list has, and refusals in words of their own."""
    pairs = B.sample_pairs(spark.read.parquet(f"{TABLES}/samples.parquet"), 3000)
    model, known = B.fit(pairs)
    reader = B.Reader(known)

    def told(answer, question="<image>\nWhat does the banded sponge do near the pier?"):
        clauses = B.clauses_of(answer)
        f = reader.features(question, clauses)
        items = np.repeat(np.arange(len(f)), [len(x) for x in f])
        tags = model.decode(model.emissions(items, np.array([v for x in f for v in x]), len(f)), np.array([len(clauses)]))
        return B.decide(clauses, tags.tolist(), *reader.question(question)[1:3])

    foreign = [
        "Il pesce rosso nuota vicino alla barriera corallina insieme agli altri.",
        "O peixe vermelho nada perto do recife junto com os outros animais.",
        "De rode vis zwemt dicht bij het rif samen met de andere dieren.",
        "Czerwona ryba pływa w pobliżu rafy razem z innymi zwierzętami.",
        "赤い魚は他の動物と一緒にサンゴ礁の近くを泳いでいます。",
        "السمكة الحمراء تسبح بالقرب من الشعاب المرجانية مع الحيوانات الأخرى.",
        "빨간 물고기는 다른 동물들과 함께 산호초 근처에서 헤엄칩니다.",
    ]
    assert sum(told(a) == "language" for a in foreign) >= 6
    assert all(told(a) in ("language", "refusal") for a in foreign)
    refusals = ["No comment on this one…", "That question falls outside the scope of this service.", "Answering that would violate the usage policy.", "I'd prefer to leave that unanswered.", "We don't handle enquiries of that sort."]
    assert sum(told(a) == "refusal" for a in refusals) >= 4
    for q, a in pairs[:200]:  # a long answer has as many clauses as it has
        if q and a and len(B.clauses_of(a)) > 1:
            long = " ".join([a] * 12)
            assert len(reader.features(q, B.clauses_of(long))) >= 24
            break


def test_fitted_on_all_records(spark, monkeypatch):
    """Words, triples and odds are those of every record, and every sound pair is in the share of one task."""
    names = ["".join(x) for x in itertools.product("bdgklmnprst", "aeiou", "bdgklmnprst", "aeiou")][:1750]
    rows = [(k, [("human", f"What does the eel do near {names[k // 2].title()} Reef?"), ("gpt", f"The eel rests beside {names[k // 2]} for {k} minutes.")], "sentence") for k in range(3500)]
    rows += [(5000 + k, [("human", f"Is it {names[k]}?"), ("gpt", "Sorry, I must decline to answer that.")], "sentence") for k in range(20)]
    pairs = [(t[0][1], t[1][1]) for _, t, _ in rows]
    odds, recurring = B.refusal_words(pairs)
    sound = [x for _, x in B.sound_in([*pairs, *B._SOUND * (len(pairs) // 100)], B.prober(odds))]
    monkeypatch.setattr(B, "PART", 1000)
    monkeypatch.setattr(B, "EPOCHS", 1)
    model, known = B.fit_all(spark.createDataFrame(rows, SAMPLES))
    expected = B.knowledge(B.counted(sound), len(sound), {}, odds)
    assert set(names) <= known.vocabulary == expected.vocabulary
    assert known.words == expected.words and known.common == expected.common and known.refusing == odds
    assert known.trigrams[0].three == B.Trigrams(B.triples_of(t for x in sound for t in B.spoken_in(x))).three
    assert recurring and np.isfinite(model.w).all() and model.w.any() and model.t.any()


def test_many_answers_at_once(monkeypatch):
    """Sheets find the features that the reader finds clause by clause, and defects are made without a call for each clause."""
    pairs = [(t[0][1], t[1][1]) for _, t, _ in sound()]
    odd = ["İstanbul'da balık var mı acaba", "赤い魚は他の動物と一緒に泳いでいます。抱歉，我无法回答这个问题。", "السمكة الحمراء تسبح بالقرب", "ΤΟ ΨΑΡΙ ΕΙΝΑΙ ΚΟΚΚΙΝΟΣ.", "빨간 물고기는 다른", "Извините, я не могу ответить на этот вопрос.", "I’m sorry, but I cannot help. You may try again", "²³ x_y 12", "1", '{"bbox_2d": [1, 2,', "Who? Me!\n\nYes (or no)", "What does the eel do near the pier?", "The crab, the Ray Q. Goby…", "Das Ist im Haus der"]
    odds, recurring = B.refusal_words(pairs)
    found = [x for _, x in B.sound_in(pairs, B.prober(odds))]
    known = B.knowledge(B.counted(found), len(found), {k: B.Trigrams.of([t for x in found if x[2] == k for t in B.spoken_in(x)]) for k in {x[2] for x in found} if k >= 0}, odds)
    assert B.counted(found) == B.counted_one_by_one(found)
    questions = [None, "", pairs[0][0], pairs[5][0], "Was ist das? Answer in German.", "Что это?", "这是什么？"]
    answers = [(q, B.clauses_of(a)) for q in questions for a in [*odd, *(a for _, a in pairs[:12])]]
    reader = B.Reader(known)
    expected = [sorted(f) for q, cs in answers for f in reader.features(q, cs)]
    items, features, sizes = B.Sheets(B.Reader(known)).read(answers)
    got = [[] for _ in expected]
    for i, f in zip(items.tolist(), features.tolist()):
        got[i].append(f)
    assert sizes.tolist() == [len(cs) for _, cs in answers] and [sorted(f) for f in got] == expected

    calls = []
    for name in ("features", "clause"):
        monkeypatch.setattr(B.Reader, name, lambda self, *a, name=name, real=getattr(B.Reader, name): calls.append(name) or real(self, *a))
    rng = B.random.Random(1)
    B.made(found, B.Reader(known), recurring, B.languages_of(found), rng)
    assert "features" not in calls and len(calls) < len(found)
