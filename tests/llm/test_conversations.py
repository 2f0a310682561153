import itertools

from spanwright.llm import conversations as C

TEXT, READ = 4, 8


def turn(role, n, seq=None, ts=None, flags=TEXT | READ):
    return (float(n) if ts is None else ts, seq, C.ROLES.index(role) | flags, n, n)


def test_validate_rules():
    ok = [turn("system", 0), turn("user", 1), turn("tool", 2), turn("assistant", 3)]
    assert [r for r, _ in C.validate(ok)] == [0, 1, 3, 2]
    for order in itertools.permutations(ok):
        assert C.validate(list(order)) == C.validate(ok)
    assert C.validate(ok[:-1]) == []
    assert C.validate([turn("user", 0), turn("user", 1), turn("assistant", 2)]) == []
    assert C.validate([turn("user", 0), turn("assistant", 1), turn("tool", 2)]) == []
    assert C.validate([turn("user", 0), turn("system", 1), turn("assistant", 2)]) == []
    assert C.validate([turn("user", 0, flags=READ), turn("assistant", 1)]) == []
    assert C.validate([turn("user", 0), turn("assistant", 1, flags=TEXT)]) == []
    assert C.validate([turn("user", 0, seq=0), turn("assistant", 1, seq=2)]) == []
    assert C.validate([turn("user", 5, seq=1), turn("system", 9, seq=0), turn("assistant", 3, seq=2)]) == [(0, 9), (1, 5), (2, 3)]
    assert C.validate([]) == []


def test_stream_buffers_late_rows_and_drops_broken(spark, tmp_path):
    schema = "row_no bigint, trace_id string, span_id string, name string, user_key string, event_seq int, event_ts timestamp, received_at timestamp, attributes map<string,string>, extra string"
    q = lambda n, t, name, at, a, rec=None, extra=None: (n, t, "s", f"gen_ai.{name}", "u", None, f"2026-01-{at}", f"2026-01-{rec or at}", a, extra)
    rows = [
        q(1, "AB", "user.message", "01 10:00:00", {"role": "human", "content": "hi"}),
        q(3, "ab", "choice", "01 10:00:09", {"message": '{"content": [{"type": "text", "text": "yes"}]}'}, rec="09 10:00:00"),
        q(4, "ab", "choice", "01 10:00:09", {"message": '{"content": [{"type": "text", "text": "yes"}]}'}),
        q(5, "cd", "user.message", "02 10:00:00", {"content": "alone"}),
        q(6, "ef", "user.message", "02 10:00:00", {"content": " ​"}),
        q(7, "ef", "choice", "02 10:00:01", {"message": '{"content": "x"}'}),
        q(8, "gh", "user.message", "03 10:00:00", {"content": "a"}),
        q(9, "gh", "choice", "03 10:00:01", {"message": '{"content": "cut'}),
        q(10, None, "user.message", "03 10:00:00", {"content": "a"}),
        q(11, "0" * 32, "user.message", "03 10:00:00", {"content": "a"}),
    ]
    df = spark.createDataFrame([tuple(None if c is None else c for c in r) for r in rows], schema.replace("timestamp", "string"))
    df = df.withColumns({c: df[c].cast("timestamp") for c in ("event_ts", "received_at")})
    path = f"file://{tmp_path}/ev.parquet"
    df.write.parquet(path)
    got = sorted(tuple(r) for r in C.rebuild_log(spark, path, df.schema).collect())
    assert got == [("ab", 0, "user", 1), ("ab", 1, "assistant", 3)]
    empty = f"file://{tmp_path}/none.parquet"
    df.limit(0).write.parquet(empty)
    assert C.rebuild_log(spark, empty, df.schema).count() == 0
