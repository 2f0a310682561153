from spanwright.llm import overlap as O

COMMON = frozenset("what is the default timeout of retriever in seconds which team owns pipeline how many pallets can warehouse hold".split())


def cover(p, t, word):
    text = O._marked(t)
    return O.coverage(O._fold(p), text, text.index(word), COMMON)


def test_coverage():
    p = "What is the default timeout of the Vekufoki retriever in seconds?"
    assert cover(p, "Quick. " + p.upper() + " Thanks!", "vekufoki") == 1
    assert cover(p, p.replace("default", "defualt"), "vekufoki") == 1
    assert cover(p, p.replace("the Vek", "Vek"), "vekufoki") > 0.85
    assert cover(p, "How many pallets can the Vekufoki warehouse hold?", "vekufoki") < O.COVERAGE
    q = "Which team owns the Vekufoki pipelinne?"
    assert cover(q, "Which team owns the Bakedibi pipelinne?", "pipelinne") == 0


def test_wrapping_text_on_the_line():
    p = "Which team owns the Vekufoki pipeline"
    wrapped = "hello there please read all of the notes below and then tell me {} since the shift lead wants to know by noon"
    assert cover(p, wrapped.format(p), "vekufoki") == 1
    assert cover(p, wrapped.format("which team owns the Vekufoki pipelinne"), "vekufoki") == 1
    assert cover(p, wrapped.format("how many pallets can the Vekufoki warehouse hold"), "vekufoki") < O.COVERAGE
    assert cover(p, wrapped.format("which team owns the old and long since retired Vekufoki pipeline"), "vekufoki") < O.COVERAGE
    assert cover(p, wrapped.format("which team owns the Bakedibi pipeline"), "pipeline") == 0


def test_near():
    assert O.near("warehouse", "warehousse") and O.near("depot", "deopt") and not O.near("ruboseka", "tibokeka")


def test_pairs_and_edges(spark):
    q = "What is the default timeout of the {} retriever in seconds?"
    filler = [(100 + i, q.format(n), q.format(n), "train", "s", [], "x") for i, n in enumerate(f"Name{a}{b}" for a in "abcdefgh" for b in "ijklmnop")]
    rows = [
        (1, q.format("Vekufoki"), None, " Train", "a", ["x"], "x"),
        (2, None, "user: " + q.format("vekufoki").upper(), "TEST ", "a", ["x"], "x"),
        (3, q.format("Vekufoka"), q.format("Vekufoka"), "validation", None, None, "x"),
        (4, q.format("Vekufoki"), "", None, "a", [], "x"),
        (5, None, None, "test", "a", [], "x"),
        (6, q.format("Vekufoki"), "", "train", "a", [], "x"),
    ]
    df = spark.createDataFrame(rows + filler, "row_no bigint, question string, prompt string, split string, source string, labels array<string>, class_id string")
    found = O.overlaps(df)
    assert sorted((r.eval_row, r.train_row) for r in found.collect()) == [(2, 1), (2, 6)]
    rep = {(r.split, r.source): (r.eval_rows, r.overlapping, r.pairs, r.same_labels) for r in O.overlap_report(df, found).collect()}
    assert rep[("test", "a")] == (2, 1, 2, 1) and rep[("validation", "")] == (1, 0, 0, 0)
    assert O.overlaps(df.limit(0)).count() == 0


def test_hot_entity(spark):
    q = "Which team owns the {} pipeline?"
    names = [f"{a}o{b}uta" for a in "bdfgklmn" for b in "prstvz"]
    rows = [(i, q.format("Vekufoki"), "train") for i in range(30)] + [(30 + i, q.format("Sadomira"), "train") for i in range(30)]
    rows += [(100 + i, q.format(n), "train") for i, n in enumerate(names)]
    rows += [
        (200, "Which team owns the Vekufoki pipeline exactly?", "test"),
        (201, "Which team owns the Vekufoki pipelinne?", "test"),
        (202, q.format("Vekufoki"), "validation"),
        (203, q.format("Sadomira") + " Thanks", "validation"),
        (204, "Which team owns the pipeline?", "test"),
        (205, "Which team owns this pipeline", "train"),
    ]
    df = spark.createDataFrame([(n, x, x, s) for n, x, s in rows], "row_no bigint, question string, prompt string, split string")
    found = {(r.eval_row, r.train_row) for r in O.overlaps(df).collect()}
    want = {(e, i) for e in (200, 201, 202) for i in range(30)} | {(203, 30 + i) for i in range(30)}
    assert {x for x in found if x[0] < 204} == want
    assert (204, 205) in found


def test_common_words_only(spark):
    # Nothing but common words is shared, and 'exactly' is the only rare one.
    rows = [(i, "Which team owns the Vekufoki pipeline?", "train") for i in range(30)] + [(99, "Which team owns the Vekufoki pipeline exactly?", "test")]
    df = spark.createDataFrame([(n, x, x, s) for n, x, s in rows], "row_no bigint, question string, prompt string, split string")
    assert {(r.eval_row, r.train_row) for r in O.overlaps(df).collect()} == {(99, i) for i in range(30)}
