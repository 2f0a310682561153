"""Lexical scores as column expressions. Token sets are arrays without repeats; missing text has no tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists of the lexical scores.
PRONOUNS = "it its they them their this that these those he she him her his one there".split()
VAGUE_TIME = "recently soon later now then today yesterday".split()
STOP_WORDS = "the a an of in on at to for and or is was were are be been by with from as that this it its into about than then there".split()
QUESTION_STOP = "what when who where why how which whose is was were are did does do the a an in on at of to for".split()
COMPARISON = "than more less before after both difference compare compared combined total older younger taller shorter first last between".split()
LEADING_WORDS = "When What Who Where Why How Which Is Was Did Does Are The A An In On Whose".split()


def words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def token_list(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(token_list(text))


def cased_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))


def content_set(tokens: Column) -> Column:
    """Without stop words, or all of them where nothing else is left."""
    rest = F.array_except(tokens, words(STOP_WORDS))
    return F.when(F.size(rest) > 0, rest).otherwise(tokens)


def share(part: Column, whole: Column) -> Column:
    return F.size(part).cast("double") / F.size(whole)


def support_one(content: Column, chunk: Column) -> Column:
    return F.when(F.size(content) > 0, share(F.array_intersect(content, chunk), content)).otherwise(0.0)


def support(content: Column, chunks: Column) -> Column:
    """Largest share of the content words that one chunk (a token set) holds; 0 without words or chunks."""
    return F.round(F.coalesce(F.array_max(F.transform(chunks, lambda c: support_one(content, c))), F.lit(0.0)), 4)


def relevance(query: Column, chunk: Column) -> Column:
    """Jaccard similarity of two token sets."""
    both = (F.size(query) > 0) & (F.size(chunk) > 0)
    return F.round(F.when(both, share(F.array_intersect(query, chunk), F.array_union(query, chunk))).otherwise(0.0), 4)


def ambiguity(question: Column) -> Column:
    """How ambiguous a question is, 0 to 1, by unresolved pronouns, length and vague time words."""
    w = cased_tokens(question)
    low = F.transform(w, lambda x: F.lower(x))
    n_content = F.size(F.filter(low, lambda x: ~F.array_contains(words(PRONOUNS), x)))
    proper = F.transform(w, lambda x, i: (i > 0) & (F.length(x) >= 3) & x.rlike("^[A-Z]") & ~F.array_contains(words(QUESTION_STOP), F.lower(x)))
    is_pronoun = F.transform(low, lambda x: F.array_contains(words(PRONOUNS), x))
    first = F.array_position(is_pronoun, True)
    antecedent = F.exists(F.slice(proper, F.lit(1), F.greatest(first.cast("int") - 1, F.lit(0))), lambda p: p)
    score = (
        F.when((first > 0) & ~antecedent, 0.6).otherwise(0.0)
        + F.when(n_content <= 4, 0.2).otherwise(0.0)
        + F.when((first == 0) & ~F.exists(proper, lambda p: p) & (n_content <= 4), 0.2).otherwise(0.0)
        + F.when(F.arrays_overlap(low, words(["when", "how"])) & F.arrays_overlap(low, words(VAGUE_TIME)), 0.1).otherwise(0.0)
    )
    return F.when(F.size(w) == 0, 0.5).otherwise(F.round(F.least(score, F.lit(1.0)), 4))


def entity_count(question: Column) -> Column:
    """Runs of capitalised words, after leading question words are dropped."""
    runs = F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"), F.lit(0))
    left = F.transform(runs, lambda r: F.filter(F.split(r, r"\s+"), lambda x: F.length(x) > 0))
    return F.size(F.filter(left, lambda x: ~(F.array_contains(words(LEADING_WORDS), x[0]) & (F.size(x) == 1))))


def multihop(question: Column) -> Column:
    return F.when(F.arrays_overlap(token_set(question), words(COMPARISON)) | (entity_count(question) >= 2), 1.0).otherwise(0.0)


def match_one(answer: Column, ref: Column) -> Column:
    """Token F1 of two token sets, 1 where the reference's content words are all there and the answer isn't far longer."""
    inter = F.size(F.array_intersect(answer, ref)).cast("double")
    prec, rec = inter / F.size(answer), inter / F.size(ref)
    content = content_set(ref)
    held = (F.size(F.array_intersect(answer, content)) == F.size(content)) & (F.size(answer) <= 4 * F.size(ref) + 5)
    return F.when((F.size(answer) == 0) | (F.size(ref) == 0) | (inter == 0), 0.0).when(held, 1.0).otherwise(2 * prec * rec / (prec + rec))


def match(answer: Column, refs: Column) -> Column:
    """Best match of an answer's token set with an array of references' token sets."""
    return F.round(F.coalesce(F.array_max(F.transform(refs, lambda r: match_one(answer, r))), F.lit(0.0)), 4)


def equivalent(a: Column, b: Column) -> Column:
    """Equal text or token sets alike by 0.6; a and b are structs (text, tokens)."""
    return (a["text"] == b["text"]) | (relevance(a["tokens"], b["tokens"]) >= 0.6)


def clusters(samples: Column) -> Column:
    """Greedy clusters of samples (structs text, tokens) in order: array of (rep, n)."""
    kind = "array<struct<rep:struct<text:string,tokens:array<string>>,n:int>>"

    def add(acc: Column, s: Column) -> Column:
        hit = F.array_position(F.transform(acc, lambda c: equivalent(c["rep"], s)), True)
        grown = F.transform(acc, lambda c, i: F.struct(c["rep"].alias("rep"), F.when(i == hit - 1, c["n"] + 1).otherwise(c["n"]).alias("n")))
        return F.when(hit > 0, grown).otherwise(F.concat(acc, F.array(F.struct(s.alias("rep"), F.lit(1).alias("n")))))

    return F.aggregate(samples, F.expr(f"CAST(array() AS {kind})"), lambda acc, s: add(acc, s).cast(kind))


def samples_of(texts: Column) -> Column:
    return F.transform(texts, lambda t: F.struct(F.trim(F.lower(t)).alias("text"), token_set(t).alias("tokens")))


def semantic_entropy(texts: Column) -> Column:
    """Entropy of the clusters of an array of samples, scaled by the logarithm of their number."""
    k = F.size(texts)
    h = F.aggregate(clusters(samples_of(texts)), F.lit(0.0), lambda a, c: a - (c["n"] / k) * F.log(c["n"] / k))
    return F.when(k > 1, F.round(F.greatest(h / F.log(k.cast("double")), F.lit(0.0)), 4)).otherwise(0.0)


def self_consistency(texts: Column, answer: Column) -> Column:
    """Share of samples equivalent to the answer."""
    a = F.struct(F.trim(F.lower(F.coalesce(answer, F.lit("")))).alias("text"), token_set(answer).alias("tokens"))
    s = samples_of(texts)
    return F.when(F.size(texts) > 0, F.round(F.size(F.filter(s, lambda x: equivalent(x, a))).cast("double") / F.size(texts), 4)).otherwise(0.0)


def contains_text(haystack: Column, needle: Column) -> Column:
    """Whether the normalised needle is a substring of the normalised haystack; an empty one never is."""
    n = F.array_join(token_list(needle), " ")
    return (F.length(n) > 0) & F.contains(F.array_join(token_list(haystack), " "), n)


def seeded_unit(*parts: Column, divisor: int = 4294967295) -> Column:
    """A pseudo-random number from 0 to 1 from the SHA-1 of the parts joined by a bar."""
    return F.conv(F.substring(F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / F.lit(float(divisor))
