"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics of whole texts are Spark column expressions. Boosted trees over a bounded sample of labelled rows give
paths; each path is a conjunctive rule; lasso logistic regression keeps a few rules with weights; the kept rules are
compiled back into one Spark column expression, so scoring runs inside the JVM over any number of documents.

Only the text is an input of a score. Defined results: null and empty texts have zero statistics and get the score
which the rules give those; whole texts count, however long; every row of docs is returned, rows that repeat a doc_id each
by its own text (the least text of a doc_id is learned from, once for each of its labels); labels that are null are not
learned from; when no labelled row of both kinds exists, the score is the share of good labels, or 0.5 without any; an empty
table gives no rows; other columns of both tables are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm.boosting import boost
from voxlake.llm.common import docs_of


def held_out(id_column: Column) -> Column:
    return (F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % 3) == 1


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text that is not null."""
    n = F.char_length(text)
    per = lambda c: c / F.greatest(n, F.lit(1))
    words, lines = F.filter(F.split(text, r"\s+"), lambda w: w != ""), F.filter(F.split(text, "\n"), lambda x: x != "")
    many = F.greatest(F.size("_words"), F.lit(1))
    left = lambda pattern: F.char_length(F.regexp_replace(text, pattern, ""))
    distinct = lambda c: F.size(F.array_distinct(c)) / F.greatest(F.size(c), F.lit(1))
    return {
        "_words": words,
        "_lines": lines,
        "log_chars": F.log1p(n.cast("double")),
        "log_words": F.log1p(F.size("_words").cast("double")),
        "word_length": n / many,
        "symbols": per(left(r"[^!-/:-@\[-`{-~]+")),
        "capitals": per(left(r"\P{Lu}+")),
        "digits": per(left(r"[^0-9]+")),
        "bars": (n - F.char_length(F.replace(text, F.lit("|"), F.lit("")))) / many,
        "shouts": (n - F.char_length(F.replace(text, F.lit("!!"), F.lit("")))) / many,
        "marked_words": F.size(F.filter("_words", lambda w: F.substring(w, -2, 2).rlike(r"^[^\p{L}\p{N}]{2}$"))) / many,
        "distinct_words": distinct(F.col("_words")),
        "lines": F.size("_lines") / many,
        "distinct_lines": distinct(F.col("_lines")),
        "stops": per(left(r"[^.?]+")),
        "plain_words": F.size(F.filter("_words", lambda w: F.char_length(w) <= 4)) / many,
    }


def with_statistics(df: DataFrame) -> DataFrame:
    said = statistics(F.col("text"))
    df = df.withColumns({k: said[k] for k in ("_words", "_lines")})
    return df.withColumns({k: v for k, v in said.items() if k[0] != "_"}).drop("_words", "_lines")


NAMES = tuple(k for k in ("log_chars log_words word_length symbols capitals digits bars shouts marked_words distinct_words lines distinct_lines stops plain_words").split())


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """(bias, weights) by accelerated proximal gradients; the bias is not penalised."""
    n, m = r.shape
    x = np.concatenate([np.ones((n, 1)), r], 1)
    step = 4 * n / max(np.linalg.norm(x, 2) ** 2, 1e-9)
    w = v = np.zeros(m + 1)
    t = 1.0
    for _ in range(rounds):
        z = v - step * x.T @ (1 / (1 + np.exp(-x @ v)) - y) / n
        new = np.sign(z) * np.maximum(np.abs(z) - step * penalty, 0)
        new[0] = z[0]
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 1e-3) -> tuple[float, list[tuple[float, list[tuple[int, float, bool]]]]]:
    """(bias, weighted rules); a rule is a list of (column, cut, column <= cut)."""
    if len(y) < 20 or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        return float(np.log(p / (1 - p))), []
    _, grown = boost(x, y, trees, depth, least=max(5, len(y) // 500))
    rules = list({tuple(sorted(p)): p for tree in grown for p in tree.paths()}.values())
    holds = np.stack([np.logical_and.reduce([(x[:, f] <= c) == below for f, c, below in p]) for p in rules], 1).astype(float)
    bias, weights = lasso_logistic(holds, y, penalty)
    return bias, [(float(w), p) for w, p in zip(weights, rules) if abs(w) > 1e-3]


def compiled(bias: float, rules: list, names: tuple[str, ...] = NAMES) -> Column:
    """The score as one column expression over the statistics."""
    total = F.lit(bias)
    for weight, path in rules:
        cond = F.lit(True)
        for f, c, below in path:
            cond = cond & ((F.col(names[f]) <= c) if below else (F.col(names[f]) > c))
        total = total + F.when(cond, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def score_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs.

    labels: (doc_id, quality 0/1); learned from at most sample_rows rows outside the held-out third, in hash order.
    """
    docs = docs_of(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)").where(~held_out(F.col("doc_id")))
    sample = known.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows)
    learned = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    read = with_statistics(learned).select(*NAMES, "quality").toPandas()  # at most sample_rows rows of numbers
    bias, rules = fit_rules(read[list(NAMES)].to_numpy(float), read["quality"].to_numpy(float))
    scored = with_statistics(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), compiled(bias, rules).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
