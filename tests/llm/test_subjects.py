import random

from strandwise.llm import subjects

AREAS = [("art", "Fine art", "x"), ("food", "Food", "y"), (None, None, None)]
WORDS = {"art": ["canvas", "sculptor", "palette", "fresco", "easel", "gallery"], "food": ["noodle", "skillet", "broth", "pepper", "butter", "casserole"]}
FRAMES = ["Why does the {0} matter more than a {1}?", "In the town a {0} and a {1} came together.", "Ask for the {0} first and the {1} later.", "Nobody saw the {0} until the {1} had changed."]
PLAIN = ["As before, opinions differ.", "It took longer than expected."]
FURNITURE = ["Home\nArchive\nContact", "We use cookies to keep this site running. Accept all", "Imprint Privacy Terms"]


def page(rnd, shares):
    out = [rnd.choice(FURNITURE)]
    for subject, n in shares.items():
        for _ in range(n):
            out.append(rnd.choice(PLAIN) if subject is None else rnd.choice(FRAMES).format(*rnd.sample(WORDS[subject], 2)))
    rnd.shuffle(out)
    return "\n".join(out)


def made(seed=0, n=240):
    rnd = random.Random(seed)
    docs, labels, truth = [], [], set()
    for i in range(n):
        kind = rnd.choice(["art", "food", "both", "bare"])
        shares = {"art": {"art": 8, None: 1}, "food": {"food": 7, None: 2, "art": 1}, "both": {"art": 5, "food": 5}, "bare": {}}[kind]
        docs.append((i, page(rnd, shares), "label", 3))
        mine = {"both": ["art", "food"], "bare": []}.get(kind, [kind])
        truth |= {(i, s) for s in mine}
        if i % 2:
            labels += [(i, rnd.choice([s, s.upper(), f" {s} "]), 1.0) for s in mine] or [(i, None, None)]
    return docs, labels, truth


def run(spark, docs, labels, areas=AREAS, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string, label string, fold int")
    lab = spark.createDataFrame(labels, "doc_id long, subject string, text double")
    a = spark.createDataFrame(areas, "subject string, title string, scope string")
    return subjects.subjects_of(d, lab, a, **kw)


def test_held_out_documents(spark):
    docs, labels, truth = made()
    labels += [(1, "unheard of", None), (None, "art", None), (3, "Fine art", None)] + labels[:5]
    got = {(r["doc_id"], r["subject"]) for r in run(spark, docs, labels).collect()}
    held = {i for i, *_ in docs if i % 2 == 0}
    mine, want = {x for x in got if x[0] in held}, {x for x in truth if x[0] in held}
    assert len(mine & want) / len(want) > 0.95
    assert len(mine & want) / len(mine) > 0.95


def test_nulls_empty_long_and_repeated(spark):
    docs, labels, _ = made(1, 120)
    extra = [(500, None, None, None), (501, "", None, None), (502, " \n ", None, None), (503, "The canvas and the easel. " * 20000, None, None), (503, "A skillet of broth. " * 9, None, None), (None, "The fresco and the palette.", None, None)]
    out = run(spark, docs + extra, labels).collect()
    about = {(r["doc_id"], r["subject"]) for r in out}
    assert not {i for i, _ in about} & {500, 501, 502}
    assert {(503, "art"), (503, "food")} <= about
    assert all(0 <= r["posterior"] <= 1 and r["n_about"] <= r["n_content"] for r in out)


def test_nothing_to_learn_from(spark):
    docs, labels, _ = made(2, 20)
    assert run(spark, docs, []).count() == 0
    assert run(spark, docs, labels, areas=[(None, "x", "y")]).count() == 0
    assert run(spark, [], labels).count() == 0


def test_features_survive_damage():
    f = subjects.Featurizer()
    plain = list(f.sentences("The goalkeeper won. A hurdle fell."))
    damaged = list(f.sentences("The goal­keeper w​on. A huurdle fell."))
    assert plain == damaged
    assert len(list(f.sentences("まず温室、次に堆肥を確認する。種が変わった。"))) == 2
