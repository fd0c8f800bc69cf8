"""The n-gram scorer against plain loops."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from gristmill.functions.text import words
from gristmill.operators import evaluate, ngram


def looped(corpus, rows):
    count = Counter(tuple(t[i : i + n]) for t in corpus for n in (1, 2, 3) for i in range(len(t) - n + 1))
    total = max(1, sum(map(len, corpus)))
    out = {}
    for key, t, begin in rows:
        score = 0.0
        for i in range(begin, len(t)):
            for n in (3, 2, 1):
                have = tuple(t[i - n + 1 : i + 1]) if i + 1 >= n else ()
                if have and count[have]:
                    score += math.log(0.4 ** (3 - n) * count[have] / (count[have[:-1]] if n > 1 else total))
                    break
            else:
                score += math.log(0.4**3 / total)
        if len(t) > begin:
            out[key] = (len(t) - begin, round(score, 9))
    return out


def test_scores_equal_a_loop_s(spark):
    r = random.Random(1)
    names = list("abcdefgh")
    corpus = [[r.choice(names) for _ in range(r.randint(0, 12))] for _ in range(60)] + [None]
    rows = [(i, [r.choice([*names, "new"]) for _ in range(r.randint(0, 9))], r.randint(0, 3)) for i in range(50)]
    known = spark.createDataFrame([(t,) for t in corpus], "words array<string>")
    got = ngram.scored(spark.createDataFrame(rows, "id long, words array<string>, begin int"), known, ["id"]).collect()
    assert {x.id: (x.tokens, round(x.score, 9)) for x in got} == looped([t for t in corpus if t], rows)
    assert ngram.scored(spark.createDataFrame(rows, "id long, words array<string>, begin int"), known.limit(0), ["id"]).count() == len(looped([], rows))


def test_only_asked_n_grams_are_counted(spark):
    known = spark.createDataFrame([(["a", "b", "a", "b", "c"],)], "words array<string>")
    asked = ngram.places(spark.createDataFrame([(1, ["x", "a", "b"], 2)], "id long, words array<string>, begin int"), ["id"], "words", "begin")
    assert sorted(r.n for r in ngram.counts(known, asked).collect()) == [2, 2, 2]


def test_choices_by_the_scorer(spark):
    corpus = spark.createDataFrame([("the cat sat on the mat",), ("the dog ran to the park",)], "text string").select(words("text").alias("words"))
    items = spark.createDataFrame([(1, "the cat", ["ran", "sat on", ""], 1), (2, "dog", ["ran to", "sat"], 0)], "id long, context string, endings array<string>, label int")
    rated = ngram.rated(evaluate.candidates(items), corpus, words).where("ending <> ''")
    assert evaluate.accuracy(evaluate.chosen(rated), F.col("choice") == F.col("label")).first()[:2] == (2, 2)
