import numpy as np

from spanwright.llm import abuse as A


def test_spelling_tricks_are_undone():
    assert A.plain("You l0ser") == "you loser" and A.plain("m o r o n") == "moron" and A.plain("p.a.t.h") == "path"
    assert A.plain("So ein Trottél, naaaked") == "so ein trottel, naked"


def test_votes():
    assert A.votes("The index moved in spring.") is None
    assert A.votes("Shut up, you idiot.")["abusive"][1] == 1
    assert A.votes("Keep foreigners away from our yard, they are vermin.")["hateful"][0] == 1
    assert min(A.votes('Our filter blocks the word "idiot" in user messages.')["abusive"]) < 0


def test_label_model_finds_good_and_correlated_voters():
    r = np.random.default_rng(1)
    y = r.random(4000) < 0.3
    vote = lambda hit, false: np.where(y, r.random(4000) < hit, r.random(4000) < false).astype(int)
    a, b, c = vote(0.9, 0.05), vote(0.8, 0.05), vote(0.5, 0.45)
    v = np.stack([a, b, c, c, -(1 - vote(0.95, 0.4))], 1)
    keys, n = np.unique(v, axis=0, return_counts=True)
    m = A.LabelModel(keys, n)
    post = m.posterior(v) > 0.5
    assert (post == y).mean() > 0.9
    assert m.weight[2] < 0.8 and m.weight[0] > 0.9
    assert m.table[1, 0, 2] > m.table[0, 0, 2]


def test_end_to_end(spark):
    good = ["The index moved in spring.", "Drivers check in at gate 4.", "The naked domain points to the gateway.", "Sexual harassment must be reported to the desk at once.", "Women and men on the shift are paid the same.", "This release is garbage and the portal is a joke, roll it back."]
    bad = {"abusive": ["Shut up, you idiot.", "You are a pathetic l0ser and everyone knows it.", "Du bist ein dummer Versager."], "hateful": ["Foreigners are vermin and should be thrown out of the country.", "Las mujeres no sirven para pensar."], "sexual": ["Send me nudes and I will approve your request.", "Quiero sexo contigo esta noche."]}
    rows, want, n = [], set(), 0
    for k in range(30):
        for g in good:
            rows.append((n, "a", f"{g} {good[(k + 1) % 6]}"))
            n += 1
        for c, ss in bad.items():
            for s in ss:
                rows.append((n, "b", f"<p>{good[k % 6]}</p>\n{s}"))
                want.add((n, c))
                n += 1
    rows += [(n, None, None), (n + 1, "a", ""), (n + 2, "a", "fine. " * 4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumnRenamed("source", "source")
    scores = A.score(df)
    assert scores.count() == len(rows)
    assert {(r.doc_id, r.category) for r in A.flagged(scores).collect()} == want
    assert {r.source for r in A.rates(scores).collect()} == {"", "a", "b"}
    assert A.flagged(A.score(df.limit(0))).count() == 0
