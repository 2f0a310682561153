import random

from spanwright.llm import pairs as P

Q = "How many pallets can the Rupikost warehouse hold?"


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_lcs_against_table():
    r = random.Random(3)
    for _ in range(200):
        a, b = [r.choice("abcd") for _ in range(r.randint(0, 12))], [r.choice("abcd") for _ in range(r.randint(0, 12))]
        assert P.lcs(a, b) == brute_lcs(a, b)


def test_defects():
    f = lambda a, cut=False, q=Q, p=None: P.defect(q, p or q, a, cut)
    for a in (None, "", " \n", "—", "n/a", "[]", "<empty>", "(no output)", "​", "NULL"):
        assert f(a) == "empty_answer"
    assert f("The warehouse can ho", True) == "truncated_answer"
    for a in ("I would rather not answer that.", "Hmm, such details are off limits for me!", "Leider dabei kann ich nicht helfen.", "Lo siento, pero prefiero no contestar.", "Thank you for asking; however, no answer will be given to this question."):
        assert f(a) == "refusal"
    for a in (Q, Q.upper(), "You asked: " + Q, f"{Q} {Q}", Q[:-1]):
        assert f(a) == "copied_question"
    assert f("Das Lager Rupikost fasst 6281 Paletten und nimmt nur werktags Paletten an.") == "wrong_language"
    assert f("Das Lager Rupikost fasst 6281 Paletten und nimmt nur werktags Paletten an.", p=Q + " Please answer in German.") is None
    for a in ("6281", "The Rupikost warehouse can hold 6281 pallets.", f"{Q} It can hold 6281 pallets.", "Sorry for the long wait: it can hold 6281 pallets.", "I can't stress it enough, it holds 6281 pallets.", "It holds 6281. The desk must decline any other figure."):
        assert f(a) is None, a
    assert P.defect(None, None, "fine", False) is None


def test_refusals_after_the_first_sentence():
    for a in (
        "Thank you for your question. I can't help with that request.",
        "Hello. Thanks. I can't help with that request.",
        "I have read your message with great care. Unfortunately, I cannot assist with that. Have a nice day, and take care.",
        "Vielen Dank für Ihre Anfrage. Dabei kann ich nicht helfen.",
    ):
        assert P.defect(Q, Q, a, False) == "refusal", a
    for a in ("It holds 6281. I can't help with that request.", "The warehouse is the largest one in town. I won't answer this question.", "Harbor Desk. I can't help with that request."):
        assert P.defect(Q, Q, a, False) is None, a


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, None, None, None), (2, Q, Q, "6281"), (2, Q, Q, "6281"), (3, Q, Q, Q), (3, Q, Q, Q)]
    df = spark.createDataFrame(rows, "row_no bigint, question string, prompt string, answer string")
    cut = spark.createDataFrame([], "row_no bigint")
    got = sorted((r.row_no, r.defect) for r in P.broken_pairs(df, cut).collect())
    assert got == [(1, "empty_answer"), (3, "copied_question"), (3, "copied_question")]
    assert P.broken_pairs(df.limit(0), cut).count() == 0
