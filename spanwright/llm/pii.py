"""Personal information in free text: a character BiLSTM-CRF decodes overlapping windows, which are reconciled globally.

find_pii returns one row per mention; redact_pii puts typed placeholders in the place of the mentions and leaves the
rest of the text as it is. Both are narrow: nothing is shuffled or gathered. Whole texts are read, in windows.

Null and empty texts have no mention and are redacted to themselves. Repeated rows are each answered. Columns of the
input named like a result column are kept under the caller's key names only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import emit, ship
from .chartag import TYPES, Tagger, encode, spans_of

#: Width of a window and the part of it shared with the next; no mention of the five types is longer than the overlap.
WIDTH, OVERLAP, BATCH = 640, 80, 384


def load_model(path: str | None = None) -> dict[str, np.ndarray]:
    with np.load(path or Path(__file__).with_name("pii_model.npz")) as z:
        return {k: z[k].astype(np.float32) for k in z.files if k != "labels"}


def _windows(n: int) -> list[tuple[int, int]]:
    if n <= WIDTH:
        return [(0, n)]
    step = WIDTH - OVERLAP
    return [(b, min(b + WIDTH, n)) for b in range(0, n - OVERLAP, step)]


def _reconcile(spans: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """Of overlapping mentions decoded in different windows, the set of most total score (weighted intervals)."""
    if len(spans) < 2:
        return [(t, b, e) for _, t, b, e in spans]
    best: dict[tuple[int, int, int], float] = {}
    for s, t, b, e in spans:
        best[t, b, e] = max(s, best.get((t, b, e), 0.0))
    items = sorted(((e, b, t, s) for (t, b, e), s in best.items()))
    ends = [e for e, *_ in items]
    total, take = [0.0], []
    for k, (e, b, t, s) in enumerate(items):
        j = int(np.searchsorted(ends[:k], b, side="right"))
        yes, no = total[j] + s, total[k]
        take.append((yes > no, j))
        total.append(max(yes, no))
    out, k = [], len(items)
    while k:
        used, j = take[k - 1]
        if used:
            e, b, t, _ = items[k - 1]
            out.append((t, b, e))
            k = j
        else:
            k -= 1
    return out[::-1]


def decode(tagger: Tagger, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
    """Mentions (type, start, end) of each text, in order of their start; equal texts are read once."""
    if len(once := list(dict.fromkeys(texts))) < len(texts):
        known = dict(zip(once, decode(tagger, once), strict=True))
        return [known[s] for s in texts]
    jobs: list[tuple[int, int, int]] = []
    coded: list[np.ndarray | None] = []
    for k, s in enumerate(texts):
        coded.append(encode(s) if s else None)
        if s:
            jobs += [(k, b, e) for b, e in _windows(len(coded[k]))]
    jobs.sort(key=lambda j: j[2] - j[1])
    found: list[list[tuple[float, int, int, int]]] = [[] for _ in texts]
    runs, home = [], []
    for at in range(0, len(jobs), BATCH):
        part = jobs[at : at + BATCH]
        width = part[-1][2] - part[-1][1]
        ids = np.zeros((width, len(part)), np.int64)
        for c, (k, b, e) in enumerate(part):
            ids[: e - b, c] = coded[k][b:e]
        got = tagger.runs(tagger.emissions(ids), np.array([e - b for _, b, e in part]))
        runs += got
        home += [part[r[0]] for r in got]
    for (_, lo, hi, em, _, _), (k, b, e), y in zip(runs, home, tagger.solve(runs), strict=True):
        n = len(coded[k])
        for t, f, u in spans_of(y):
            f, u = f + lo, u + lo
            # A mention that touches an inner edge of its window was seen whole only by the neighbour.
            if (f == 0 and b > 0) or (u == e - b and e < n):
                continue
            gain = float((em[1:, f - lo : u - lo].max(0) - em[0, f - lo : u - lo]).sum())
            edge = min(f + b if b == 0 else f, 32) + min(e - b - u if e < n else 32, 32)
            found[k].append((max(gain, 0.01) * (1 + edge / 64), t, f + b, u + b))
    return [_reconcile(f) for f in found]


_AT = re.compile(r"\s?(?:@|\(at\)|\[at\]|\bat\b)\s?", re.I)
_WORD = re.compile(r"[^\W\d_]{2,}")
#: Words that no name begins with, and those that may stand in lower case within one.
_NO_NAME = frozenset("a an the in on at of for from with near by to is it was and or our my your his her their this that team yesterday today tomorrow then when please der die das den dem des ein eine im in am zum zur bei aus von und oder mit nach seit für auf ist war das team gestern heute le la les un une des du de à en et ou avec pour par dans chez depuis est el los las un una y o con por para desde según es hola".split())
_PARTICLES = frozenset("de la las los van von vom zu zur der den ter ten da das di del della dos do du des al el bin ibn ben abu y e le st".split())
_FULL = re.compile(r"[^\W\d_]\W+[^\W\d_]{2,}")


def _check(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """An exact check of what the tagger found: sets its edges at words and drops what can't be of its type."""
    out = []
    for t, b, e in spans:
        while b < e and (text[b].isspace() or text[b] in ".,;:<>|\"=" or (text[b] == "(" and t != 1)):
            b += 1
        while e > b and (text[e - 1].isspace() or text[e - 1] in ",;:<>|\"("):
            e -= 1
        while 0 < b < e and text[b].isalnum() and text[b - 1].isalnum():
            b -= 1
        s = text[b:e]
        digits = sum(c.isdigit() for c in s)
        if t == 0:
            at = _AT.search(s)
            ok = bool(at) and len(s) >= 6
            if ok:
                local = re.search(r"\S+$", text[: b + at.start()])
                b = local.start() if local and at.start() < 2 else b + (local.start() - b if local and local.start() > b else 0)
                while e > b and text[e - 1] in ".)":
                    e -= 1
        elif t == 1:
            ok = digits >= 7
        elif t == 2:
            ok = 6 <= sum(c.isalnum() for c in s) <= 24 and digits >= 2 and not (s.isdigit() and digits < 8)
        elif t == 3:
            ok = digits >= 1 and len(_WORD.findall(s)) > 1 and any(w[0].isupper() for w in _WORD.findall(s))
        else:
            parts = list(re.finditer(r"\S+", s))
            while len(parts) > 1 and (parts[0].group().lower() in _NO_NAME or (parts[0].group().islower() and parts[1].group()[:1].isupper() and parts[0].group() not in _PARTICLES)):
                parts.pop(0)
            # A name written with capitals goes no further than them.
            if parts[0].group()[:1].isupper():
                last = next((k for k, x in enumerate(parts) if x.group()[:1].islower() and x.group() not in _PARTICLES), len(parts))
                while last > 1 and parts[last - 1].group()[:1].islower():
                    last -= 1
                parts = parts[:last]
            b, e = b + parts[0].start(), b + parts[-1].end()
            s = text[b:e]
            ok = digits == 0 and bool(_FULL.search(s)) and "@" not in s
        if ok:
            out.append((t, b, e))
    return out


def _scan(params: dict[str, np.ndarray], keys: list[str], redact: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(params)
        for pdf in batches:
            texts = [None if s is None or s != s else s for s in pdf["text"]]
            for at in range(0, max(1, len(texts)), 4000):
                part = texts[at : at + 4000]
                spans = [_check(s, f) if s else [] for s, f in zip(part, decode(tagger, part), strict=True)]
                rows = pdf.iloc[at : at + 4000]
                if redact:
                    out = []
                    for s, f in zip(part, spans, strict=True):
                        for t, b, e in reversed(f):
                            s = f"{s[:b]}[{TYPES[t].upper()}]{s[e:]}"
                        out.append(s)
                    yield from emit(rows[keys].assign(redacted=out, mentions=[len(f) for f in spans]))
                else:
                    idx = np.repeat(np.arange(len(rows)), [len(f) for f in spans])
                    flat = [x for f in spans for x in f]
                    yield from emit(rows.iloc[idx][keys].assign(
                        pii_type=[TYPES[t] for t, _, _ in flat], start_char=np.array([b for _, b, _ in flat], np.int32), end_char=np.array([e for _, _, e in flat], np.int32)
                    ))

    return run


def _prepared(df: DataFrame, keys: dict[str, Column], text: Column) -> DataFrame:
    return df.select(*[c.alias(n) for n, c in keys.items()], text.alias("text"))


def find_pii(df: DataFrame, keys: dict[str, Column], text: Column, model: str | None = None) -> DataFrame:
    """One row (keys, pii_type, start_char, end_char) per mention; offsets count code points from 0."""
    ship(df.sparkSession)
    src = _prepared(df, keys, text).where(F.length("text") > 0)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "text")
    return src.mapInPandas(_scan(load_model(model), list(keys), False), f"{schema}, pii_type string, start_char int, end_char int")


def redact_pii(df: DataFrame, keys: dict[str, Column], text: Column, model: str | None = None) -> DataFrame:
    """(keys, redacted, mentions) of every row; null stays null."""
    ship(df.sparkSession)
    src = _prepared(df, keys, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "text")
    return src.mapInPandas(_scan(load_model(model), list(keys), True), f"{schema}, redacted string, mentions int")


def user_texts(generic_log: DataFrame, openai_chat: DataFrame, inference: DataFrame) -> DataFrame:
    """The texts that users write: (source_table, row_no, item_pos, body)."""
    a = generic_log.select(F.lit("generic_log").alias("source_table"), "row_no", F.lit(0).alias("item_pos"), F.col("input.user_message").alias("body"))
    b = openai_chat.select(F.lit("openai_chat").alias("source_table"), "row_no", F.posexplode("request.messages").alias("item_pos", "m")).select("source_table", "row_no", "item_pos", F.col("m.content").alias("body"))
    c = inference.select(F.lit("inference").alias("source_table"), "row_no", F.lit(0).alias("item_pos"), F.col("prompt").alias("body"))
    return a.unionByName(b).unionByName(c)
