"""Full-text search: tokenisers, boolean queries with phrases and prefixes, BM25, highlighting."""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .recursion import _cut

K1, B = 1.2, 0.75


def tokens(text: Column, tokenizer: str = "default", n: int = 3) -> Column:
    """default: lower-cased words; simple: the same; whitespace: split at white space; raw: the text; ngram: n characters each."""
    if tokenizer == "raw":
        return F.array(text)
    if tokenizer == "whitespace":
        return F.filter(F.split(text, r"\s+"), lambda t: t != "")
    if tokenizer == "ngram":
        low = F.lower(text)
        return F.when(F.char_length(low) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(low) - n + 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(n)))).otherwise(F.array())
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def parse(query: str) -> list:
    """OR groups of AND lists of (not, field, words, prefix, boost). A space is OR, as in the reference's syntax."""
    items = re.findall(r'(AND|OR|NOT)\b|(-|\+)?(?:(\w+):)?(?:"([^"]*)"|([\w*]+))(?:\^(\d+(?:\.\d+)?))?', query)
    groups, negate, join, either = [], False, False, False
    for word, sign, field, phrase, term, boost in items:
        if word == "NOT":
            negate, join = True, not either  # after OR a group of its own
        elif word == "AND":
            join = True
        elif word == "OR":
            join, either = False, True
        else:
            words = [w for w in re.split(r"\W+", (phrase or term).lower().rstrip("*")) if w]
            clause = (negate or sign == "-", field or None, words, term.endswith("*"), float(boost or 1))
            if join and groups:
                groups[-1].append(clause)
            else:
                groups.append([clause])
            negate = join = either = False
    return groups


def _places(own: Column, words: list[str]) -> Column:
    """At how many places the words follow each other: one pass over the tokens with the automaton of the phrase."""
    if not words:
        return F.size(own) + 1
    size = len(words)
    ends = [0] * (size + 1)  # the longest other prefix that a prefix of the phrase ends with
    for i in range(1, size):
        k = ends[i]
        while k and words[i] != words[k]:
            k = ends[k]
        ends[i + 1] = k + (words[i] == words[k])

    def step(at: int, word: str) -> int:
        while at == size or words[at] != word:
            if at == 0:
                return 0
            at = ends[at]
        return at + 1

    def read(s: Column, t: Column) -> Column:
        at = reduce(lambda c, w: c.when(t == w, F.element_at(F.array(*(F.lit(step(k, w)) for k in range(size + 1))), s["at"] + 1)), dict.fromkeys(words), F).otherwise(0)
        return F.struct(at.alias("at"), (s["n"] + (at == size).cast("int")).alias("n"))

    return F.aggregate(own, F.struct(F.lit(0).alias("at"), F.lit(0).alias("n")), read, lambda s: s["n"])


def _holds(own: Column, clause) -> Column:
    _, _, words, prefix, _ = clause
    if prefix:
        return F.exists(own, lambda t: t.startswith(words[0]))
    if len(words) == 1:
        return F.array_contains(own, words[0])
    return _places(own, words) > 0


def match(docs: DataFrame, fields: list[str], query: str, tokenizer: str = "default") -> DataFrame:
    """Rows that a query fits. No shuffle: each row's own tokens are tested."""
    found = None
    for group in parse(query):
        both = None
        for clause in group:
            one = None
            for f in [clause[1]] if clause[1] else fields:
                test = _holds(F.coalesce(tokens(F.col(f), tokenizer), F.array()), clause)
                one = test if one is None else one | test
            one = ~one if clause[0] else one
            both = one if both is None else both & one
        found = both if found is None else found | both
    return docs.filter(found if found is not None else F.lit(False))


def _often(clause) -> Column:
    """How often a clause's words, phrase or prefix stand in the column t of tokens."""
    _, _, words, prefix, _ = clause
    if prefix:
        return F.size(F.filter("t", lambda x: x.startswith(words[0])))
    if len(words) == 1:
        return F.size(F.filter("t", lambda x: x == words[0]))
    return _places(F.col("t"), words)


def bm25(docs: DataFrame, key: str, field: str, query: str, weight: float = 1.0, tokenizer: str = "default") -> DataFrame:
    """key, score of the rows with a clause of the query: terms, phrases and prefixes of this field or of none, each times its boost.

    Statistics cover all rows. Texts are read once: their counts are written down, and both the statistics and the scores are made of these.
    """
    clauses = list(dict.fromkeys((False, None, tuple(words), prefix, boost) for group in parse(query) for not_, own, words, prefix, boost in group if not not_ and words and own in (None, field)))
    own = docs.select(F.col(key).alias("key"), tokens(F.col(field), tokenizer).alias("t")).select("key", F.size("t").alias("length"), *(_often(c).alias(f"f{i}") for i, c in enumerate(clauses)))
    own = _cut(own)
    stats = own.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.sum((F.col(f"f{i}") > 0).cast("long")).alias(f"d{i}") for i in range(len(clauses)))).first()
    score = F.lit(0.0)
    for i, (*_, boost) in enumerate(clauses):
        d = stats[f"d{i}"] or 0
        idf = F.ln(F.lit(1 + (stats["n"] - d + 0.5) / (d + 0.5)))
        tf = F.col(f"f{i}").cast("double")
        score = score + weight * boost * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(float(stats["mean"] or 1))))
    any_term = F.greatest(F.lit(0), F.lit(0), *(F.col(f"f{i}") for i in range(len(clauses)))) > 0
    return own.filter(any_term).select("key", score.alias("score"))


def bm25_fields(docs: DataFrame, key: str, weights: dict[str, float], query: str, tokenizer: str = "default") -> DataFrame:
    """key, score over several fields, each with its weight."""
    parts = [bm25(docs, key, f, query, w, tokenizer) for f, w in weights.items()]
    return reduce(DataFrame.unionAll, parts).groupBy("key").agg(F.sum("score").alias("score"))


def highlight(text: Column, query: str, before: str = "<b>", after: str = "</b>") -> Column:
    """Marks the words of the clauses that are not negated; of a prefix the whole word."""
    words = {(re.escape(w) + (r"[\p{L}\p{N}]*" if prefix else "")) for group in parse(query) for not_, _, ws, prefix, _ in group if not not_ for w in ws}
    return F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}])({'|'.join(sorted(words, key=lambda w: (-len(w), w)))})(?![\p{{L}}\p{{N}}])", f"{before}$1{after}") if words else text
