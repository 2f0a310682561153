"""Ingestion of drifting JSON into one table per feed, with a rescue column, and the report of every schema change.

A target schema says which members become typed columns. What a record has beyond it, or what won't cast, is kept as
JSON in the rescue column, so no value is lost; promote() adds approved members to the target and replays the rescued
values into typed columns. Each record also tells which members it had and of which kind; the change report compares
these between consecutive files of a producer.

Defined cases: broken lines are kept as rows without columns (ok is false) and count for no file; repeated lines are
repeated rows; a null member counts as present and has no kind; an empty table gives empty results.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import emit, materialise, ship

#: The columns each feed starts with: path and Spark type. Arrays end their own path; members below them stay JSON.
TARGETS: dict[str, dict[str, str]] = {
    "openai_chat": {"id": "string", "provider": "string", "request.model": "string", "request.temperature": "double", "request.messages": "string", "response.model": "string", "response.choices": "string", "response.usage.prompt_tokens": "bigint", "response.usage.completion_tokens": "bigint"},
    "otel_flat": {"name": "string", "kind": "string", "traceId": "string", "spanId": "string", "startTimeUnixNano": "string", "attributes": "string"},
    "otel_events": {"name": "string", "kind": "string", "trace_id": "string", "span_id": "string", "attributes": "string", "events": "string"},
}

_KIND = {str: "string", bool: "boolean", int: "number", float: "number", dict: "object", list: "array", type(None): "null"}
_OBSERVED = "array<struct<path:string,kind:string,n:int,len:double,num:double,dig:double,shape:string>>"
_INGESTED = f"ok boolean, typed string, rescued string, observed {_OBSERVED}"


def _shape(v: object) -> tuple[float, float, float, str]:
    """(length, logarithm of the size, share of digits, form) of a value, by which a renamed member is known again."""
    if isinstance(v, bool):
        return 1.0, float(v), 0.0, "b"
    if isinstance(v, (int, float)):
        return float(len(str(v))), math.copysign(math.log1p(abs(v)), v) if math.isfinite(v) else 0.0, 1.0, "n"
    if isinstance(v, str):
        digits = sum(c.isdigit() for c in v)
        # A short word stands for itself, since a renamed member keeps its values; anything else by its form.
        form = v if len(v) <= 24 and not digits else re.sub(r"\d+", "9", re.sub(r"[^\W\d_]+", "a", v))[:6]
        return float(len(v)), 0.0, digits / max(1, len(v)), form
    if isinstance(v, dict):
        return float(len(v)), 0.0, 0.0, ",".join(sorted(v))
    if isinstance(v, list):
        return float(len(v)), 0.0, 0.0, "[]"
    return 0.0, 0.0, 0.0, ""


def observe(record: dict) -> list[tuple]:
    """(path, kind, n, mean length, mean size, mean digits, form) of each member path of a record, arrays as [].

    The record itself is the path '', by which records are counted.
    """
    seen: dict[tuple[str, str], list] = {("", "object"): [1, 0.0, 0.0, 0.0, ""]}
    stack: list[tuple[str, object]] = [(k, v) for k, v in record.items()]
    while stack:
        path, v = stack.pop()
        kind = _KIND[type(v)]
        length, num, dig, form = _shape(v)
        s = seen.get((path, kind))
        if s is None:
            seen[path, kind] = [1, length, num, dig, form]
        else:
            s[0] += 1
            s[1] += length
            s[2] += num
            s[3] += dig
            s[4] = min(s[4], form)
        if isinstance(v, dict):
            stack += [(f"{path}.{k}", x) for k, x in v.items()]
        elif isinstance(v, list):
            stack += [(path + "[]", x) for x in v]
    return [(p, k, s[0], s[1] / s[0], s[2] / s[0], s[3] / s[0], s[4]) for (p, k), s in seen.items()]


#: The types a target column may have.
KINDS = ("string", "boolean", "bigint", "double")
_NUMERAL = re.compile(r"\s*[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?\s*", re.ASCII)


def _cast(v: object, kind: str) -> tuple[bool, object]:
    if v is None:
        return True, None
    if kind == "string":
        return (True, v) if isinstance(v, str) else (True, json.dumps(v)) if isinstance(v, (dict, list)) else (False, None)
    if isinstance(v, bool) or kind == "boolean":
        return kind == "boolean" and isinstance(v, bool), v
    if isinstance(v, str):
        # Numbers written as text, in plain form only.
        if not _NUMERAL.fullmatch(v):
            return False, None
        try:
            v = int(v)
        except ValueError:
            v = float(v)
    if isinstance(v, float) and not math.isfinite(v):
        return False, None
    if isinstance(v, (int, float)):
        # Only what the column holds exactly; anything else stays in the rescue column as it came.
        if kind == "bigint":
            return (True, int(v)) if v == int(v) and -(2**63) <= v < 2**63 else (False, None)
        try:
            return (True, float(v)) if float(v) == v else (False, None)
        except OverflowError:
            return False, None
    return False, None


def conform(record: dict, target: dict[str, str]) -> tuple[dict, dict]:
    """(typed columns, rescued members by path) of one record."""
    typed: dict[str, object] = {}
    rescued: dict[str, object] = {}
    inner = {p.rsplit(".", 1)[0] for p in target if "." in p}
    inner |= {q.rsplit(".", 1)[0] for q in list(inner) if "." in q}
    stack: list[tuple[str, object]] = [(k, v) for k, v in record.items()]
    while stack:
        path, v = stack.pop()
        if path in target:
            ok, x = _cast(v, target[path])
            if ok:
                typed[path] = x
            else:
                rescued[path] = v
        elif path in inner and isinstance(v, dict):
            stack += [(f"{path}.{k}", x) for k, x in v.items()]
        else:
            rescued[path] = v
    return typed, rescued


def _ingest(targets: dict[str, dict[str, str]], keys: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for feed, s in zip(pdf["feed"], pdf["payload"], strict=True):
                try:
                    record = json.loads(s) if s else None
                except ValueError:
                    record = None
                if not isinstance(record, dict):
                    out.append((False, None, None if s is None else json.dumps({"_unreadable": s}), []))
                    continue
                typed, rescued = conform(record, targets.get(feed, {}))
                out.append((True, json.dumps(typed), json.dumps(rescued) if rescued else None, [dict(zip(("path", "kind", "n", "len", "num", "dig", "shape"), o, strict=True)) for o in observe(record)]))
            res = pdf[keys].reset_index(drop=True)
            for k, name in enumerate(("ok", "typed", "rescued", "observed")):
                res[name] = pd.Series([o[k] for o in out], dtype=object)
            yield from emit(res)

    return run


def ingest(raw: DataFrame, targets: dict[str, dict[str, str]] | None = None, keys: tuple[str, ...] = ("rec_id", "feed", "producer", "file_name", "line_no", "landed_at")) -> DataFrame:
    """Each raw line with its typed members (JSON), its rescued members (JSON by path) and what was observed in it."""
    ship(raw.sparkSession)
    if odd := {t for target in (targets or TARGETS).values() for t in target.values()} - set(KINDS):
        raise ValueError(f"target columns are {', '.join(KINDS)}, not {', '.join(sorted(odd))}")
    src = raw.select(*keys, "payload")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "payload")
    return src.mapInPandas(_ingest(targets or TARGETS, list(keys)), f"{schema}, {_INGESTED}")


def _struct(target: dict[str, str]) -> T.StructType:
    return T.StructType([T.StructField(p, T._parse_datatype_string(t), True) for p, t in target.items()])


def unified(ingested: DataFrame, feed: str, target: dict[str, str], keys: tuple[str, ...] = ("rec_id", "producer", "file_name", "line_no")) -> DataFrame:
    """The one table of a feed: keys, a typed column for each target path (dots as underscores), and rescued."""
    typed = F.from_json("typed", _struct(target))
    return ingested.where((F.col("feed") == feed) & F.col("ok")).withColumn("t", typed).select(*keys, *[F.col("t").getField(p).alias(p.replace(".", "_")) for p in target], "rescued")


def _other(path: str):
    return lambda k, _: k != path


def promote(table: DataFrame, approved: dict[str, str]) -> DataFrame:
    """Adds approved members as typed columns, replayed from rescued; what then is typed leaves the rescue column.

    A column that exists is filled where it was null, which replays values that came under another type.
    """
    rescued = F.from_json("rescued", "map<string,string>")
    out = table.withColumn("_m", rescued)
    for path, kind in approved.items():
        name = path.replace(".", "_")
        raw = F.col("_m")[path]
        value = raw if kind == "string" else F.expr(f"try_cast(_m[{json.dumps(path)}] as {kind})")
        out = out.withColumn(name, F.coalesce(F.col(name), value) if name in table.columns else value)
        out = out.withColumn("_m", F.when(raw.isNotNull() & value.isNotNull(), F.map_filter("_m", _other(path))).otherwise(F.col("_m")))
    return out.withColumn("rescued", F.when(F.size("_m") > 0, F.to_json("_m"))).drop("_m")


def file_profile(ingested: DataFrame) -> DataFrame:
    """How often each file of a producer has each member by kind, and what its values look like. Pre-aggregated."""
    o = F.col("o")
    return (
        ingested.where("ok")
        .select("feed", "producer", "file_name", "landed_at", F.explode("observed").alias("o"))
        .groupBy("feed", "producer", "file_name", "landed_at", o["path"].alias("path"), o["kind"].alias("kind"))
        .agg(F.count(F.lit(1)).alias("records"), F.sum(o["n"]).alias("n"), F.avg(o["len"]).alias("len"), F.avg(o["num"]).alias("num"), F.avg(o["dig"]).alias("dig"), F.min(o["shape"]).alias("shape_lo"), F.max(o["shape"]).alias("shape_hi"))
    )


def _likeness(a: dict, b: dict) -> float:
    """0 to 1: whether the values of two members look like the same ones."""
    if a["kind"] != b["kind"]:
        return 0.0
    score = 1.0
    if a["kind"] in ("string", "array", "object"):
        hi, lo = max(a["len"], b["len"]), min(a["len"], b["len"])
        score *= (lo + 1) / (hi + 1)
        score *= 1 - min(1.0, abs(a["dig"] - b["dig"]))
        if a["kind"] == "object" and a["shapes"].isdisjoint(b["shapes"]):
            score *= 0.3
        if a["kind"] == "string" and a["shapes"].isdisjoint(b["shapes"]):
            score *= 0.4
    else:
        score *= 1 - min(1.0, abs(a["num"] - b["num"]) / (0.5 + 0.35 * max(abs(a["num"]), abs(b["num"]))))
    return score


def _names(a: str, b: str) -> float:
    """Share of letter pairs two member names have in common; settles equal likeness."""
    x, y = (re.sub(r"[^a-z]", "", re.sub(r".*[.\]]", "", p).lower()) for p in (a, b))
    p, q = {x[i : i + 2] for i in range(len(x) - 1)}, {y[i : i + 2] for i in range(len(y) - 1)}
    return len(p & q) / max(1, len(p | q))


def parents(paths: set[str]) -> dict[str, str]:
    """The longest path each path lies below; '' for members of the record itself."""
    out = {}
    for p in paths:
        ends = (k for k in range(len(p) - 1, 0, -1) if p[k] == "." or p[k : k + 2] == "[]")
        out[p] = next((p[:k] for k in ends if p[:k] in paths), "")
    return out


def course(counts: list[int], bases: list[int], kinds: dict[int, dict[str, int]]) -> tuple[float, list[bool], list[int]]:
    """(usual rate, presence by file, files where the kind changes) of one member over all files of its producer.

    counts: records of each file that have it; bases: records of each file that could; kinds: records by kind where it
    isn't null. A member that is optional may be missing from a small file by chance: it counts as removed only where
    that many records without it are unlikely at its usual rate, and a member first seen late as added likewise.
    """
    n = len(counts)
    full = sum(b for c, b in zip(counts, bases, strict=True) if c)
    rate = min(0.999, max(0.05, sum(counts) / full if full else 0.05))
    on = [c > 0 for c in counts]
    i = 0
    while i < n:
        if on[i]:
            i += 1
            continue
        j = i
        while j < n and not on[j]:
            j += 1
        rows = sum(bases[i:j])
        if rows == 0:
            # The parent is away: no statement about the member.
            fill = on[i - 1] if i else (on[j] if j < n else False)
            on[i:j] = [fill] * (j - i)
        elif rate < 0.9 and (1 - rate) ** rows > 1e-3:
            on[i:j] = [True] * (j - i)
        i = j
    turns: list[int] = []
    last: str | None = None
    for i in sorted(kinds):
        if last is None or (i and not on[i - 1]):
            last = max(kinds[i], key=kinds[i].get)
        elif others := [k for k in kinds[i] if k != last]:
            last = max(others, key=kinds[i].get)
            turns.append(i)
    return rate, on, turns


def compare(files: list[dict[str, dict]], totals: list[int], parent_of: dict[str, str], rate: dict[str, float], state: dict[str, list[bool]], turns: dict[str, set[int]]) -> list[tuple[int, str, str, str]]:
    """(file, change, old path, new path) of consecutive files. files: in order, each path's kinds {kind: profile}.

    parent_of, rate, state and turns are those of all files of the producer, state and turns at the places of these.
    """
    paths = sorted(parent_of)
    n = len(files)

    def count(i: int, p: str) -> int:
        return sum(k["records"] for k in files[i].get(p, {}).values())

    def base(i: int, p: str) -> int:
        up = parent_of[p]
        if up == "":
            return totals[i]
        return sum(s["records"] for k, s in files[i].get(up, {}).items() if k in ("object", "array"))

    out: list[tuple[int, str, str, str]] = []

    def profile(p: str, idx: range) -> dict | None:
        acc: dict[str, list] = {}
        for i in idx:
            for kind, s in files[i].get(p, {}).items():
                if kind != "null":
                    acc.setdefault(kind, []).append(s)
        if not acc:
            return None
        kind, ss = max(acc.items(), key=lambda kv: sum(s["records"] for s in kv[1]))
        w = sum(s["records"] for s in ss)
        mean = lambda f: sum(s[f] * s["records"] for s in ss) / w
        return {"kind": kind, "len": mean("len"), "num": mean("num"), "dig": mean("dig"), "shapes": {s["shape_lo"] for s in ss} | {s["shape_hi"] for s in ss}, "records": w}

    covered: set[tuple[int, str]] = set()

    def under(i: int, p: str) -> bool:
        """Whether a changed, added or removed field of the same file lies above."""
        q = parent_of[p]
        while q:
            if (i, q) in covered:
                return True
            q = parent_of.get(q, "")
        return False

    born = {i: [p for p in paths if state[p][i] and not state[p][i - 1]] for i in range(1, n)}
    gone = {i: [p for p in paths if not state[p][i] and state[p][i - 1]] for i in range(1, n)}
    renamed_away: dict[str, int] = {}
    for i in range(n):
        new, old = list(born.get(i, [])), list(gone.get(i, []))
        # Fields whose kind changes come first, since they cover what lies below them.
        for p in paths:
            if i in turns[p]:
                covered.add((i, p))
                if not under(i, p):
                    out.append((i, "type_changed", p, p))
        if not i:
            continue
        # A renamed member: the old one is gone here, or goes within the next files as this one mixes both.
        pairs = []
        for q in new:
            if under(i, q):
                continue
            b = profile(q, range(i, min(n, i + 6)))
            for p in paths:
                if p == q or parent_of[p] != parent_of[q] or p.endswith("[]") != q.endswith("[]") or not state[p][i - 1]:
                    continue
                # The last file may mix both; that the old one goes can then be told from the shares alone.
                leaves = next((j for j in range(i, n) if not state[p][j]), n)
                if leaves > i + 1:
                    continue
                mixed = leaves == i + 1
                if mixed and count(i, p) >= base(i, p) * max(0.6, rate[p]) + 0.5 and rate[q] > 0.9:
                    continue
                if mixed and count(i, p) + count(i, q) > base(i, p) * 1.05:
                    continue
                a = profile(p, range(max(0, i - 6), i + (1 if mixed else 0)))
                if a is None or b is None:
                    continue
                score = _likeness(a, b)
                if abs(rate[p] - rate[q]) > 0.35:
                    score *= 0.5
                if score > 0.45:
                    pairs.append((score + 0.3 * _names(p, q), p, q))
        used: set[str] = set()
        for _, p, q in sorted(pairs, key=lambda t: (-t[0], t[1], t[2])):
            if p in used or q in used:
                continue
            used |= {p, q}
            renamed_away[p] = i
            covered |= {(i, p), (i, q), (i + 1, p)}
            out.append((i, "renamed", p, q))
        for q in sorted(new):
            if q in used or under(i, q):
                continue
            if parent_of[q] in new and parent_of[q] not in used:
                covered.add((i, q))
                continue
            covered.add((i, q))
            out.append((i, "added", "", q))
        for p in sorted(old):
            if p in used or renamed_away.get(p, -9) >= i - 1 or under(i, p):
                continue
            up = parent_of[p]
            if up and (up in old or base(i, p) == 0):
                continue
            covered.add((i, p))
            out.append((i, "removed", p, ""))
    return out


_CHANGES = "feed string, producer string, file_name string, change_kind string, old_path string, new_path string"


#: Files of a producer compared in one task, and files on either side of them that are only looked at.
SEGMENT, CONTEXT = 512, 64
_COURSE = "feed string, producer string, segment int, path string, parent string, rate double, state array<boolean>, turns array<int>"


def _parents(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    up = parents(set(pdf["path"]))
    return pd.DataFrame([(key[0], key[1], p, q) for p, q in up.items()], columns=["feed", "producer", "path", "parent"])


def _course(segment: int, context: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["files"].iloc[0])
        counts, bases, kinds = [0] * n, [0] * n, {}
        pdf = pdf.sort_values(["place", "kind"])
        for place, kind, records in zip(pdf["place"].tolist(), pdf["kind"].tolist(), pdf["records"].tolist(), strict=True):
            if kind == "":
                bases[place] += records
                continue
            counts[place] += records
            if kind != "null":
                kinds.setdefault(place, {})[kind] = records
        rate, on, turns = course(counts, bases, kinds)
        out = []
        for s in range(math.ceil(n / segment)):
            lo, hi = max(0, s * segment - context), (s + 1) * segment + context
            # A segment that never has the member needs nothing of it.
            if any(on[lo:hi]):
                out.append((key[0], key[1], s, key[2], key[3], rate, on[lo:hi], [i - lo for i in turns if lo <= i < hi]))
        return pd.DataFrame(out, columns=["feed", "producer", "segment", "path", "parent", "rate", "state", "turns"])

    return run


def _per_segment(segment: int, context: int):
    def run(key: tuple, pdf: pd.DataFrame, courses: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "path", "kind"])
        names: list[str] = []
        files: list[dict] = []
        totals: list[int] = []
        for (_, name), part in pdf.groupby(["place", "file_name"], sort=True):
            at: dict[str, dict] = {}
            for r in part.to_dict("records"):
                if r["path"] == "":
                    totals.append(int(r["records"]))
                else:
                    at.setdefault(r["path"], {})[r["kind"]] = r
            names.append(name)
            files.append(at)
        by = courses.set_index("path")
        rows = compare(files, totals, by["parent"].to_dict(), by["rate"].to_dict(), {p: list(x) for p, x in by["state"].items()}, {p: set(x) for p, x in by["turns"].items()})
        first = key[2] * segment - max(0, key[2] * segment - context)
        return pd.DataFrame([(key[0], key[1], names[i], c, a, b) for i, c, a, b in rows if first <= i < first + segment], columns=["feed", "producer", "file_name", "change_kind", "old_path", "new_path"])

    return run


def schema_changes(ingested: DataFrame, segment: int = SEGMENT, context: int = CONTEXT) -> DataFrame:
    """Every change of schema of every producer.

    The usual rate of a member, where it is present and where its kind changes are taken from all files of its producer,
    member by member, some numbers for a file. Only then are profiles of files grouped, some tens of rows for a file, and
    at most segment files with context ones on either side in a task, so that a producer may have any number of files and
    the changes are the same however they are cut. A change is told from six files on either side.
    """
    # The profiles are small once made, and serve several times.
    profile = materialise(file_profile(ingested), "profiles")
    by = ["feed", "producer"]
    order = Window.partitionBy(*by).orderBy("landed_at", "file_name")
    places = profile.where("path = ''").select(*by, "file_name", "landed_at", (F.row_number().over(order) - 1).alias("place"), F.count(F.lit(1)).over(Window.partitionBy(*by)).alias("files"))
    rows = materialise(profile.join(places, [*by, "file_name", "landed_at"]), "places")
    members = rows.where("path <> ''")
    up = members.select(*by, "path").distinct().groupBy(*by).applyInPandas(_parents, "feed string, producer string, path string, parent string")
    up = materialise(up, "parents")
    own = members.join(up, [*by, "path"]).select(*by, "path", "parent", "place", "files", "kind", "records")
    # The records that could have a member: those of the file, or those whose parent holds members.
    could = rows.where("path = '' or kind in ('object', 'array')").groupBy(*by, F.col("path").alias("parent"), "place", "files").agg(F.sum("records").alias("records"))
    could = could.join(up, [*by, "parent"]).select(*by, "path", "parent", "place", "files", F.lit("").alias("kind"), "records")
    courses = own.unionByName(could).groupBy(*by, "path", "parent").applyInPandas(_course(segment, context), _COURSE)
    first = F.floor(F.greatest(F.col("place") - context, F.lit(0)) / segment).cast("int")
    last = F.floor(F.least(F.col("place") + context, F.col("files") - 1) / segment).cast("int")
    parts = rows.withColumn("segment", F.explode(F.sequence(first, last))).drop("files")
    return parts.groupBy(*by, "segment").cogroup(courses.groupBy(*by, "segment")).applyInPandas(_per_segment(segment, context), _CHANGES)
