from collections import Counter

from spanwright.llm import truncation as T

DONE = ["The gateway was moved to the north yard in spring.", "Old spans arrive up to 4 days late.", "Half of the tokens come from a notice nobody reads."]


def texts(spark, extra):
    rows = [("t", i, 0, " ".join(DONE[(i + k) % 3] for k in range(3)), None) for i in range(30)]
    rows += [("t", 1000 + i, 0, b, None) for i, b in enumerate(extra)]
    return spark.createDataFrame(rows, "source_table string, row_no bigint, item_pos int, body string, source string")


def test_cuts_and_edges(spark):
    extra = ["Old spans arrive up to 4 days late. The gateway was mo", "Old spans arrive up to 4 days late. Half of the tok", "Old spans arrive up to 4 days", "Half of the tokens come from a notice nob…", "Half of the tokens come from a [truncated]", "Old spans arrive up to 4 days late. Half of the tokens, ", "Old spans arrive up to 4 days late", "812", "North Yard", None, "", "...", "- Old spans arrive up to 4 days late\n- Half of the tokens come from a notice nobody reads"]
    df = texts(spark, extra)
    got = {r.row_no - 1000 for r in T.cut_texts(df).collect()}
    assert got == {0, 1, 2, 3, 4, 5}
    again = df.unionByName(df.where("row_no = 1000"))
    assert T.cut_texts(again).where("row_no = 1000").count() >= 1
    assert T.cut_texts(df.limit(0)).count() == 0
    rates = {r.source: (r.texts, r.cut) for r in T.cut_rates(df).collect()}
    assert rates[""] == (42, 6)


def test_counts_against_a_plain_count(spark):
    df = texts(spark, [])
    want_in, want_end = Counter(), Counter()
    for r in df.collect():
        for s in r.body.split(". "):
            w = ["^", "^", *("0" if x.isdigit() else x for x in s.rstrip(".").lower().split())]
            for i in range(2, len(w)):
                (want_end if i == len(w) - 1 else want_in)[" ".join(w[i - 2 : i + 1])] += 1
    for r in T.trigram_counts(df).collect():
        if "§" not in r.gram:
            assert (r.inside, r.terminal) == (want_in[r.gram], want_end[r.gram]), r.gram
