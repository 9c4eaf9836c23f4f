"""Words of runs of ideographs: the likeliest path through the graph of a dictionary's words."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as X

IDEOGRAPHS = "[一-鿿]+"
LONGEST = 6
WORDS = 200_000


def counted_words(texts: DataFrame, text: str = "text", longest: int = LONGEST, least: int = 2) -> DataFrame:
    """(word, n): pieces of up to `longest` ideographs that occur `least` times or more, and all single ones.  Pieces are counted in each task before they move."""
    runs = texts.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(IDEOGRAPHS), F.lit(0))).alias("run"))
    of = lambda m: F.when(F.length("run") >= m, F.transform(F.sequence(F.lit(1), F.length("run") - m + 1), lambda i: F.substring("run", i, m))).otherwise(F.array().cast("array<string>"))
    pieces = runs.select(F.explode(F.concat(*(of(m) for m in range(1, longest + 1)))).alias("word"))
    return pieces.groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= least) | (F.length("word") == 1))


def dictionary(texts: DataFrame, titles: DataFrame, text: str = "text", words: int = WORDS, longest: int = LONGEST) -> dict[str, int]:
    """Words and their weights for segmenter(), of bounded size: the `words` most frequent pieces, ties by the word, and of the titles' runs as many, which weigh more than a piece of their count.

    A piece counts as a word where it is more frequent than its parts let
    expect: its count times the number of all signs is over the product of the
    counts of its first sign and the rest.
    """
    counts = counted_words(texts, text, longest)
    single = counts.where(F.length("word") == 1)
    total = single.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    parts = counts.select(F.col("word").alias("part"), F.col("n").alias("of"))
    longer = counts.where(F.length("word") > 1).withColumns({"head": F.substring("word", 1, 1), "rest": F.expr("substring(word, 2)")})
    joined = longer.join(parts, F.col("head") == F.col("part")).select("word", "n", "rest", F.col("of").alias("a")).join(parts, F.col("rest") == F.col("part")).select("word", "n", "a", F.col("of").alias("b"))
    bound = joined.where(F.col("n").cast("double") * F.lit(float(total)) > F.col("a").cast("double") * F.col("b")).select("word", "n")
    # Both are top-k plans: the driver gets 2 * words short rows at most.
    kept = single.union(bound).orderBy(F.desc("n"), "word").limit(words).collect()
    named = titles.select(F.explode(F.regexp_extract_all("title", F.lit(IDEOGRAPHS), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(words).collect()
    out = {r["word"]: r["n"] for r in kept}
    most = max(out.values(), default=1)
    return out | {r["word"]: out.get(r["word"], 0) + most for r in named}


def best_path(run: str, weights: dict[str, float], unknown: float, longest: int) -> list[str]:
    """The words of the path with the largest sum of weights; of equal ones, that whose last word is longest, then the one before, and so on.  A sign that is no word has the weight `unknown`."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(run) + 1):
        choices = []
        for start in range(max(0, end - longest), end):
            weight = weights.get(run[start:end], unknown if end - start == 1 else None)
            if weight is not None:
                choices.append((best[start][0] + weight, -start))
        score, start = max(choices)
        best.append((score, -start))
    out, end = [], len(run)
    while end:
        start = best[end][1]
        out.append(run[start:end])
        end = start
    return out[::-1]


def segmenter(words: dict[str, int]) -> Callable[[Column], Column]:
    """text -> array of words, for linking.link_candidates(segment=...): tokens as ever, but runs of ideographs in them cut by the dictionary, a batch of texts at a time."""
    total = sum(words.values()) + 1
    weights = {w: math.log(n / total) for w, n in words.items()}
    longest, unknown, path = max(map(len, words), default=1), math.log(0.5 / total), best_path

    @F.pandas_udf("array<string>")
    def cut(tokens: pd.Series) -> pd.Series:
        ideographs, seen = re.compile(IDEOGRAPHS), {}

        def parts(token: str) -> list[str]:
            if token not in seen:
                out, at = [], 0
                for m in ideographs.finditer(token):
                    out += [token[at : m.start()]] * (m.start() > at) + path(m[0], weights, unknown, longest)
                    at = m.end()
                seen[token] = out + [token[at:]] * (at < len(token))
            return seen[token]

        return tokens.map(lambda ts: [p for t in ts for p in (parts(t) if ideographs.search(t) else [t])])

    return lambda text: F.when(F.coalesce(text, F.lit("")).rlike(IDEOGRAPHS), cut(X.tokens(text))).otherwise(X.tokens(text))
