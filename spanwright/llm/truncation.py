"""Texts cut before their end, told from trigram counts in SQL.

Over all texts, each word trigram is counted inside sentences and at sentence ends. A text whose last sentence isn't
closed is flagged where its final trigram is frequent inside sentences but almost never ends one, or where its last word
is only the beginning of a word that usually stands there. Texts that carry a mark of the cut are flagged by the mark.

Words are lower case and numbers one symbol. A second count, with capitalised words inside a sentence as one symbol,
answers where the words themselves are too rare. Null and empty texts, bare values (up to three words and no sentence
before) and single words are never flagged; repeated rows are each answered; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: A trigram must be seen so often to speak, and may end at most this share of its sentences to count as internal.
MIN_SEEN, MAX_TERMINAL = 3, 0.04

_MARK = r"(\\x{2026}|\\.{3,}|\\[\\s*(?:\\.{3}|\\x{2026}|truncated|cut|snip|gekürzt)\\s*\\]|<\\s*(?:cut|truncated|snip)\\s*>|\\(\\s*(?:truncated|cut|\\.{3}|\\x{2026})\\s*\\)|\\x{FFFD}+)\\s*$"
_CLOSED = r"""[.!?。？！][\\"\\x27”’»)\\]*`]*$"""

#: Words of each text with ¶ around sentences, or ‥ after a last one that isn't closed; once as they are and once with
#: capitalised words as §. The one-element arrays are barriers: without them the words would be split anew for each use.
_WORDS = r"""
  SELECT source_table, row_no, item_pos, closed, concat(array('¶'), filter(v.w, x -> x NOT IN ('', '-', '--', '\x27')), array(CASE WHEN closed THEN '¶' ELSE '‥' END)) AS x, v.raw
  FROM (SELECT source_table, row_no, item_pos, m, m RLIKE '@closed' AS closed
        FROM (SELECT source_table, row_no, item_pos,
                     regexp_replace(regexp_replace(rtrim(regexp_replace(body, '@mark', '')), '\\p{Nd}+(?:[.,:]\\p{Nd}+)*', '0'), '(?<=[.!?])[\\x22\\x27’”)\\]]*\\s+|\\s*\\n\\s*', ' ¶ ') AS m
              FROM @texts@ WHERE body RLIKE '\\p{L}') LATERAL VIEW explode(array(m)) b AS m2)
  LATERAL VIEW explode(array(struct(split(lower(m), '[^\\p{L}\\p{M}\\p{N}_§¶\\x27’-]+') AS w, true AS raw),
                             struct(split(lower(regexp_replace(m, '(?<=[\\p{L}\\p{N},;:] )\\p{Lu}[\\p{L}\\p{M}\\x27’-]*', '§')), '[^\\p{L}\\p{M}\\p{N}_§¶\\x27’-]+') AS w, false AS raw))) s AS v
"""

_COUNTS = r"""
  SELECT g.gram, count_if(NOT g.terminal) AS inside, count_if(g.terminal) AS terminal
  FROM @words@ LATERAL VIEW explode(array(x)) b AS y
  LATERAL VIEW explode(transform(sequence(1, size(y) - 2), i ->
    CASE WHEN y[i] = '¶' OR y[i + 1] = '‥' THEN NULL
         WHEN y[i - 1] = '¶' THEN struct(concat('^ ^ ', y[i]) AS gram, y[i + 1] = '¶' AS terminal)
         WHEN y[i - 2] = '¶' THEN struct(concat('^ ', y[i - 1], ' ', y[i]) AS gram, y[i + 1] = '¶' AS terminal)
         ELSE struct(concat_ws(' ', y[i - 2], y[i - 1], y[i]) AS gram, y[i + 1] = '¶' AS terminal) END)) t AS g
  WHERE g IS NOT NULL AND size(y) > 2 AND (raw OR g.gram LIKE '%§%')
  GROUP BY g.gram
  HAVING count(*) >= @seen
"""

_STEMS = r"""
  SELECT concat(head, ' ', substr(tail, 1, k)) AS gram, sum(seen) AS seen
  FROM (SELECT substring_index(gram, ' ', 2) AS head, substring_index(gram, ' ', -1) AS tail, inside + terminal AS seen
        FROM @counts@ WHERE char_length(substring_index(gram, ' ', -1)) > 1)
  LATERAL VIEW explode(sequence(1, char_length(tail) - 1)) s AS k
  GROUP BY ALL
"""

_ENDS = r"""
  SELECT source_table, row_no, item_pos, raw, size(y) - 2 AS words, array_position(slice(y, 2, size(y) - 2), '¶') > 0 AS several,
         regexp_replace(regexp_replace(concat_ws(' ', slice(concat(array('^', '^'), y), -4, 3)), '^.*¶ (?=\\S+ \\S+$)', '^ '), '^.*¶ (?=\\S+$)', '^ ^ ') AS gram
  FROM @words@ LATERAL VIEW explode(array(x)) b AS y
  WHERE size(y) > 2
"""

_CUT = r"""
  SELECT t.source_table, t.row_no, t.item_pos, t.marked,
         CASE WHEN t.marked THEN true
              WHEN t.hanging AND e.words IS NOT NULL THEN true
              WHEN NOT e.several AND e.words <= 3 THEN false
              WHEN coalesce(p.seen, 0) >= @seen AND coalesce(r.inside + r.terminal, 0) <= 0.05 * p.seen AND NOT e.gram LIKE '% 0' THEN true
              WHEN coalesce(q.seen, 0) >= @seen AND coalesce(k.inside + k.terminal, 0) <= 0.05 * q.seen AND NOT e.gram LIKE '% 0' THEN true
              WHEN r.gram IS NOT NULL THEN r.terminal <= @share * (r.inside + r.terminal)
              WHEN k.gram IS NOT NULL THEN k.terminal <= @share * (k.inside + k.terminal)
              ELSE false END AS cut
  FROM (SELECT source_table, row_no, item_pos, body RLIKE '@mark' AS marked, rtrim(body) RLIKE '[,;:\\-–(\\x27’&/]\\s*$' AS hanging
        FROM @open@) t
  LEFT JOIN (SELECT source_table, row_no, item_pos, max(gram) FILTER (WHERE raw) AS gram, max(gram) FILTER (WHERE NOT raw) AS class_gram, max(words) AS words, bool_or(several) AS several
             FROM @ends@ GROUP BY source_table, row_no, item_pos) e
    ON t.source_table = e.source_table AND t.row_no = e.row_no AND t.item_pos = e.item_pos
  LEFT JOIN @counts@ r ON e.gram = r.gram
  LEFT JOIN @counts@ k ON e.class_gram = k.gram
  LEFT JOIN @stems@ p ON e.gram = p.gram
  LEFT JOIN @stems@ q ON e.class_gram = q.gram AND e.class_gram <> e.gram
"""

_OPEN = r"""
  SELECT * FROM @texts@ WHERE body RLIKE '\\p{L}' AND (NOT rtrim(body) RLIKE '@closed' OR body RLIKE '@mark' OR body RLIKE '\\p{Nd}[.]$')
"""


def _sql(text: str) -> str:
    """A query with its patterns and thresholds set in; @name@ stays a table parameter."""
    text = text.replace("@mark", _MARK).replace("@closed", _CLOSED).replace("@seen", str(MIN_SEEN)).replace("@share", str(MAX_TERMINAL))
    text = text.replace("{", "{{").replace("}", "}}")
    for name in ("texts", "words", "counts", "stems", "ends", "open"):
        text = text.replace(f"@{name}@", "{" + name + "}")
    return text


def trigram_counts(texts: DataFrame) -> DataFrame:
    """(gram, inside, terminal) over all texts, of trigrams seen often enough to speak."""
    spark = texts.sparkSession
    return spark.sql(_sql(_COUNTS), words=spark.sql(_sql(_WORDS), texts=texts))


def cut_texts(texts: DataFrame) -> DataFrame:
    """Texts (source_table, row_no, item_pos, body) that break off: (source_table, row_no, item_pos, marked)."""
    spark = texts.sparkSession
    # The counts serve four joins; they are a small table once made.
    counts = materialise(trigram_counts(texts), "trigrams")
    stems = spark.sql(_sql(_STEMS), counts=counts)
    unclosed = spark.sql(_sql(_OPEN), texts=texts)
    ends = spark.sql(_sql(_ENDS), words=spark.sql(_sql(_WORDS), texts=unclosed))
    cut = spark.sql(_sql(_CUT), open=unclosed, ends=ends, counts=counts, stems=stems)
    return cut.where("cut").select("source_table", "row_no", "item_pos", "marked")


def model_texts(openai_chat: DataFrame, generic_log: DataFrame, inference: DataFrame) -> DataFrame:
    """The texts that models wrote: (source_table, row_no, item_pos, source, body)."""
    a = openai_chat.select(F.lit("openai_chat").alias("source_table"), "row_no", F.col("provider").alias("source"), F.posexplode("response.choices").alias("item_pos", "c"))
    b = generic_log.select(F.lit("generic_log").alias("source_table"), "row_no", F.lit(0).alias("item_pos"), "source", F.col("output.completion").alias("body"))
    c = inference.select(F.lit("inference").alias("source_table"), "row_no", F.lit(0).alias("item_pos"), "source", F.col("generated_answer").alias("body"))
    a = a.select("source_table", "row_no", "item_pos", "source", F.col("c.message.content").alias("body"))
    return a.unionByName(b).unionByName(c)


def cut_rates(texts: DataFrame) -> DataFrame:
    """How often each provider or source cuts: (source_table, source, texts, cut, share)."""
    cut = cut_texts(texts.drop("source")).select("source_table", "row_no", "item_pos", F.lit(1).alias("cut"))
    joined = texts.where(F.col("body").isNotNull()).select("source_table", "row_no", "item_pos", F.coalesce("source", F.lit("")).alias("source")).join(cut, ["source_table", "row_no", "item_pos"], "left")
    return joined.groupBy("source_table", "source").agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum("cut"), F.lit(0)).alias("cut")).withColumn("share", F.round(F.col("cut") / F.col("texts"), 6))
