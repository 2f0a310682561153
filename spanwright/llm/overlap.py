"""Evaluation records that also stand, the same or nearly so, in the training split.

The question of each evaluation record is normalised; equal ones are one passage. The names of every passage, and its
other words that are not common, are the patterns of Aho-Corasick automata, sharded by word in the shared folder. Every
training text is scanned whole by each shard; around each hit the passage is matched against the text, and the matched
intervals are merged into its coverage. A passage is found where most of it is covered and no word that names something
else lies within. A passage and a text may share common words only; their skeletons, with a mark for each name, are then
matched likewise, by as many of the rarest common words that half of the passage can't do without one of them.

A word is common where more than one in a thousand passages have it and it is not a name; a name is told by the places it
stands in, which take many other words, so an entity stays one however often it is asked about. Nothing is gathered:
workers read the shards from the shared folder, and only the common words are sent along, at most a thousand times the
mean passage length.
Null questions are taken from the prompt; rows without any words have no passage; repeated rows are each a row of the
result; splits are read without case and outer blanks, other splits are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import difflib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import emit, materialise, ship, work_dir
from .pairs import tokens

#: A word in at most this share of passages (or this many) is rare; a passage must be covered by this share.
RARE_SHARE, RARE_COUNT, COVERAGE = 0.001, 20, 0.7
SHARD_ROWS = 150_000
#: A place that this many words take is one for names; rows of a question are dealt to this many tasks.
FILLERS, SALTS = 5, 8
GAP, OWN_NAME, OTHER_NAME = "\x00", "\x01", "\x02"


def _fold(text: str | None) -> list[str]:
    return [w for t in tokens(text or "") for w in t.split("'")]


def _marked(text: str | None) -> list[str]:
    """The words of a text with a gap mark between sentences."""
    out = [GAP]
    for part in re.split(r"[.?!:\n]+", text or ""):
        if words := _fold(part):
            out += words
            out.append(GAP)
    return out


def question_in(question: str | None, prompt: str | None) -> str:
    """The sentence that asks: of the question, else of the prompt; the longest with a question mark, else the first."""
    for text in (question, prompt):
        if text and text.strip():
            asked = re.findall(r"[^.?!:\n¿]*\?", text)
            parts = [x for x in re.split(r"[.?!:\n]+", text) if len(tokens(x)) > 2] or [text]
            lines = [x for x in text.splitlines() if x.strip() and not x.rstrip().endswith((".", ":"))]
            return max(asked, key=len) if asked else max(re.split(r"[.?!:]+", lines[0]), key=len) if lines else parts[0]
    return ""


def _passages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        text = lambda x: x if isinstance(x, str) else None
        q = [" ".join(_fold(question_in(text(a), text(b)))) for a, b in zip(pdf["question"], pdf["prompt"], strict=True)]
        yield from emit(pd.DataFrame({"row_no": pdf["row_no"], "side": pdf["side"], "passage": q}))


def near(a: str, b: str) -> bool:
    """Whether two words differ by at most one edit or swap (two in words of eight letters or more)."""
    if abs(len(a) - len(b)) > 2 or len(a) < 4:
        return False
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    x, y = a[i : len(a) - j], b[i : len(b) - j]
    if max(len(x), len(y)) <= 1 or (len(x) == len(y) == 2 and x == y[::-1]):
        return True
    return max(len(x), len(y)) <= 2 and len(a) >= 8


def coverage(passage: list[str], text: list[str], at: int, common: frozenset[str]) -> float:
    """Share of a passage that the text's sentence has around position at; 0 for other names.

    The matched intervals are merged; a misspelt word counts as matched. Words of the sentence before and after the
    passage don't count, those put between its words do. Where each has a name of its own that the other lacks, at the
    place the passage would take, they ask about different things, whatever else they share.
    """
    n, best = len(passage), 0.0
    for j in (j for j, w in enumerate(passage) if w == text[at]):
        lo = hi = at
        # No alignment that covers enough is shifted by more than half of the passage.
        while lo and text[lo - 1] != GAP and at - lo < j + n // 2:
            lo -= 1
        while hi < len(text) and text[hi] != GAP and hi - at < n - j + n // 2:
            hi += 1
        win = text[lo:hi]
        blocks = [x for x in difflib.SequenceMatcher(None, passage, win, autojunk=False).get_matching_blocks() if x.size]
        own = next((k for k, x in enumerate(blocks) if x.b <= at - lo < x.b + x.size), None)
        if own is None or sum(x.size for x in blocks) < 0.5 * n:
            continue
        for first in range(own + 1):
            for last in range(own, len(blocks)):
                c = _covered(passage, win, blocks[first : last + 1], common)
                best = max(best, c)
    return best


def _covered(passage: list[str], win: list[str], part: list, common: frozenset[str]) -> float:
    """Share of the passage, or of the words from the first matched one to the last where these are more."""
    n, end = len(passage), part[-1].b + part[-1].size
    size, whole = sum(x.size for x in part), max(n, end - part[0].b)
    if size < 0.5 * whole:
        return 0.0
    in_p = {i for x in part for i in range(x.a, x.a + x.size)}
    in_w = {i for x in part for i in range(x.b, x.b + x.size)}
    # Where its first or last words are missing, what stands there instead may be a word or two further.
    head, tail = part[0].a, n - part[-1].a - part[-1].size
    place = range(max(0, part[0].b - head - (2 if head else 0)), min(len(win), end + tail + (2 if tail else 0)))
    missing = [w for i, w in enumerate(passage) if i not in in_p]
    extra = [win[i] for i in place if i not in in_w]

    def name(w: str) -> bool:
        return w not in common and not any(near(w, v) for v in win + passage if v in common)

    if any(name(w) for w in missing) and any(name(w) for w in extra):
        return 0.0
    spelt = sum(any(near(x, y) for y in extra) for x in missing)
    return (size + spelt) / whole


class Spelling:
    """The common words, and those a word may be a misspelling of; near() is asked only where a cut of both agrees."""

    def __init__(self, common: frozenset[str]):
        self.common, self.cuts, self.known = common, {}, {}
        for w in common:
            for c in self._cut(w):
                self.cuts.setdefault(c, []).append(w)

    @staticmethod
    def _cut(w: str) -> set[str]:
        return {w[:i] + w[i + n :] for n in range(3) for i in range(len(w) - n + 1)}

    def named(self, w: str) -> bool:
        """Whether a word is neither common nor near a common one."""
        if w in self.common:
            return False
        if w not in self.known:
            if len(self.known) > 1_000_000:
                self.known.clear()
            self.known[w] = not any(near(w, v) for c in self._cut(w) for v in self.cuts.get(c, ()))
        return self.known[w]

    def skeleton(self, words: list[str], mark: str) -> str:
        return " ".join(mark if self.named(w) else w for w in words)


def _patterns(common: frozenset[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spelling = Spelling(common)
        for pdf in batches:
            words = [p.split(" ") for p in pdf["passage"]]
            out = pdf[["class_id", "passage"]].reset_index(drop=True)
            out["skeleton"] = [spelling.skeleton(ws, OWN_NAME) for ws in words]
            out["anchors"] = [sorted({w for w in ws if w not in common}) for ws in words]
            yield from emit(out)

    return run


def _matches(words: list[list[str]], owners: dict[str, list[int]], sentences: list[str], common: frozenset[str]) -> Iterator[tuple[int, int, float]]:
    """(passage, sentence, coverage) of all passages that cover some place of a sentence; owners: passages by anchor."""
    import ahocorasick

    auto = ahocorasick.Automaton()
    for a, ks in owners.items():
        auto.add_word(f" {a} ", (a, ks))
    auto.make_automaton()
    for i, text in enumerate(sentences):
        t, starts, at = [GAP, *text.split(" "), GAP], {}, 0
        for k, w in enumerate(t):
            starts[at] = k
            at += len(w) + 1
        best: dict[int, float] = {}
        for end, (a, ks) in auto.iter(" " + " ".join(t) + " "):
            at = starts[end - len(a) - 1]
            for k in ks:
                if best.get(k, 0.0) < 1.0:
                    c = coverage(words[k], t, at, common)
                    if c >= COVERAGE:
                        best[k] = max(c, best.get(k, 0.0))
        for k, c in best.items():
            yield k, i, c


def _scan(folder: str, shards: int, common: frozenset[str], df: dict[str, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        spelling = Spelling(common)
        rows: dict[str, list[int]] = {}

        def hits(ids: list[str], found: Iterator[tuple[int, int, float]], holders: list[list[int]]) -> Iterator[pd.DataFrame]:
            out = []
            for k, i, c in found:
                out += [(ids[k], n, c) for n in holders[i]]
                if len(out) > 100_000:
                    yield from emit(pd.DataFrame(out, columns=["key", "train_row", "coverage"]))
                    out = []
            yield from emit(pd.DataFrame(out, columns=["key", "train_row", "coverage"]))

        def flush() -> Iterator[pd.DataFrame]:
            files, root = fs.FileSystem.from_uri(folder)
            sentences, holders = list(rows), list(rows.values())
            # Passages and texts that share a name, or any other word that is not common.
            for s in range(shards):
                if files.get_file_info(f"{root}/shards/shard={s}").type == fs.FileType.NotFound:
                    continue
                part = pq.read_table(f"{root}/shards/shard={s}", filesystem=files, columns=["anchor", "class_id", "passage"])
                owners: dict[str, list[int]] = {}
                for k, a in enumerate(part["anchor"].to_pylist()):
                    owners.setdefault(a, []).append(k)
                words = [p.split(" ") for p in part["passage"].to_pylist()]
                yield from hits(part["class_id"].to_pylist(), _matches(words, owners, sentences, common), holders)
            # Those that share none: which names they have is then of no matter, and few skeletons are left.
            bare: dict[str, set[int]] = {}
            for text, ns in rows.items():
                bare.setdefault(spelling.skeleton(text.split(" "), OTHER_NAME), set()).update(ns)
            sentences, holders = list(bare), [sorted(ns) for ns in bare.values()]
            for batch in pq.ParquetDataset(f"{root}/skeletons", filesystem=files).fragments:
                for part in batch.to_batches(batch_size=SHARD_ROWS, columns=["key", "skeleton"]):
                    words = [p.split(" ") for p in part["skeleton"].to_pylist()]
                    owners = {}
                    for k, ws in enumerate(words):
                        for a in prefix(ws, df):
                            owners.setdefault(a, []).append(k)
                    if owners:
                        yield from hits(part["key"].to_pylist(), _matches(words, owners, sentences, common), holders)
            rows.clear()

        size = 0
        for pdf in batches:
            for n, q, p in zip(pdf["row_no"], pdf["question"], pdf["prompt"], strict=True):
                t = _marked(q if isinstance(q, str) else None) + _marked(p if isinstance(p, str) else None)
                # Equal sentences are scanned once.
                for text in {x.strip() for x in " ".join(t).split(GAP)} - {""}:
                    rows.setdefault(text, []).append(n)
                size += len(t)
                # A million words are held at a time, so that the shards are loaded few times.
                if size > 1_000_000:
                    yield from flush()
                    size = 0
        if rows:
            yield from flush()

    return run


def prefix(words: list[str], df: dict[str, int]) -> set[str]:
    """The rarest common words of a skeleton; a text that has half of its words must hold one of them."""
    known = sorted((w for w in words if w != OWN_NAME), key=lambda w: (df.get(w, 0), w))
    return set(known[: max(0, len(known) - math.ceil(len(words) / 2) + 1)])


def slot_words(asked: DataFrame, frequent: DataFrame) -> DataFrame:
    """(w): the frequent words that are names, since the places they mostly stand in take many words.

    A place is a passage without one of its words. Its fillers count once, however often they are asked about, and
    misspellings of its usual filler are none.
    """
    texts = asked.groupBy("passage").agg(F.count(F.lit(1)).alias("n")).select("n", F.split("passage", " ").alias("ws"))
    slots = texts.select("n", "ws", F.posexplode("ws").alias("i", "w")).select("n", "w", F.expr("xxhash64(slice(ws, 1, i), slice(ws, i + 2, size(ws)), i)").alias("slot"))
    fills = slots.groupBy("slot", "w").agg(F.sum("n").alias("n"))
    usual = fills.groupBy("slot").agg(F.max_by("w", F.struct("n", "w")).alias("usual"), F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") >= FILLERS)
    takes = fills.join(usual, "slot").groupBy("slot").agg(F.count_if((F.col("w") == F.col("usual")) | (F.levenshtein("w", "usual") > 2)).alias("kinds")).where(F.col("kinds") >= FILLERS)
    placed = fills.join(frequent, "w").join(takes, "slot", "left")
    return placed.groupBy("w").agg((F.sum(F.when(F.col("kinds").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("share")).where("share > 0.5").select("w")


def overlaps(labeled: DataFrame) -> DataFrame:
    """(eval_row, train_row, coverage): every evaluation row with every training row that asks its question."""
    spark = labeled.sparkSession
    ship(spark)
    split = F.lower(F.trim(F.regexp_replace("split", r"\s+", " ")))
    side = F.when(split == "train", F.lit("train")).when(split.isin("validation", "test"), F.lit("eval"))
    rows = labeled.select("row_no", "question", "prompt", side.alias("side")).where(F.col("side").isNotNull())
    folder = work_dir(spark, "overlap")
    # The passages are needed for the counts, the patterns and the final join; they are written once.
    rows.mapInPandas(_passages, "row_no bigint, side string, passage string").where(F.length("passage") > 0).write.parquet(f"{folder}/passages")
    asked = spark.read.parquet(f"{folder}/passages")
    words = asked.select(F.explode(F.array_distinct(F.split("passage", " "))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    limit = max(RARE_COUNT, math.ceil(RARE_SHARE * asked.count()))
    words.where(F.col("df") > limit).write.parquet(f"{folder}/frequent")
    frequent = spark.read.parquet(f"{folder}/frequent")
    df = {r["w"]: r["df"] for r in frequent.join(slot_words(asked, frequent.select("w")), "w", "left_anti").collect()}
    common = frozenset(df)
    classes = asked.where("side = 'eval'").select("passage").distinct().withColumn("class_id", F.md5("passage"))
    classes.mapInPandas(_patterns(common), "class_id string, passage string, skeleton string, anchors array<string>").withColumn("key", F.md5("skeleton")).write.parquet(f"{folder}/classes")
    classes = spark.read.parquet(f"{folder}/classes")
    # Each word of a passage that is not common is a pattern; skeletons get theirs when they are scanned.
    anchors = classes.select("class_id", "passage", F.explode("anchors").alias("anchor"))
    shards = max(1, math.ceil(anchors.count() / SHARD_ROWS))
    anchors.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int")).repartition(shards, "shard").write.partitionBy("shard").parquet(f"{folder}/shards")
    classes.select("key", "skeleton").distinct().write.parquet(f"{folder}/skeletons")
    uri = folder if "://" in folder else f"file://{folder}"
    train = rows.where("side = 'train'").select("row_no", "question", "prompt")
    hits = materialise(train.mapInPandas(_scan(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri, shards, common, df), "key string, train_row bigint, coverage double"), "overlap-hits")
    own = asked.where("side = 'eval'").select(F.md5("passage").alias("class_id"), F.col("row_no").alias("eval_row"))
    bare = hits.join(classes.select("key", "class_id"), "key").select("class_id", "train_row", "coverage")
    hits = hits.select(F.col("key").alias("class_id"), "train_row", "coverage").unionByName(bare)
    hits = hits.groupBy("class_id", "train_row").agg(F.max("coverage").alias("coverage"))
    # A question asked in many rows of both splits is dealt to several tasks.
    own = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = hits.withColumn("salt", F.pmod(F.xxhash64("train_row"), F.lit(SALTS)).cast("int"))
    return own.join(hits, ["class_id", "salt"]).select("eval_row", "train_row", F.round("coverage", 6).alias("coverage"))


def overlap_report(labeled: DataFrame, found: DataFrame) -> DataFrame:
    """Per split and source: evaluation rows, those found in training, pairs, and pairs of equal labels."""
    split = F.lower(F.trim("split"))
    ev = labeled.select(F.col("row_no").alias("eval_row"), split.alias("split"), F.coalesce("source", F.lit("")).alias("source"), F.array_sort(F.coalesce("labels", F.array())).alias("eval_labels")).where(F.col("split").isin("validation", "test"))
    tr = labeled.select(F.col("row_no").alias("train_row"), F.array_sort(F.coalesce("labels", F.array())).alias("train_labels"))
    pairs = found.join(tr, "train_row").groupBy("eval_row", "train_labels").agg(F.count(F.lit(1)).alias("n"))
    per = ev.join(pairs, "eval_row", "left").groupBy("split", "source", "eval_row").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.coalesce(F.sum(F.when(F.col("train_labels") == F.col("eval_labels"), F.col("n"))), F.lit(0)).alias("same_labels"))
    return per.groupBy("split", "source").agg(F.count(F.lit(1)).alias("eval_rows"), F.count_if(F.col("pairs") > 0).alias("overlapping"), F.sum("pairs").alias("pairs"), F.sum("same_labels").alias("same_labels"))
