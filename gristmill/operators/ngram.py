"""A scorer that is trained here: an n-gram model with backoff, counted in Spark and joined by hashes.

The log-probability of a word after the ORDER - 1 words before it is that of the longest n-gram that the corpus has: its
count over the count of what comes before the word, times FACTOR for each word that had to be left out; a word that the
corpus hasn't counts as a part of one. (These are scores, not a distribution, as is usual for this backoff.)

Only n-grams that are asked for are counted: those of the texts to be scored are hashed first. Where they are few enough
to be broadcast, the corpus's n-grams meet them before they are added up, so that what is shuffled grows with the questions
and not with the corpus; where they are more, n-grams are added up before they are shuffled to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.plans import staging

ORDER, FACTOR = 3, 0.4
#: N-grams asked for that are broadcast, some 16 bytes each.
FEW = 1 << 20


def gram(words: Column | str, last: Column, n: int) -> Column:
    """The hash of the n words that end at a place, from 1 on; null where there are fewer."""
    return F.when(last >= n, F.xxhash64(*[F.get(words, last - k) for k in range(n, 0, -1)]))


def grams(corpus: DataFrame, words: str = "words", order: int = ORDER) -> DataFrame:
    """(gram): the hashes of all n-grams of up to `order` words, as gram() has them, in generated code.

    A word and those after it, missing ones null, are a row; an array's functions of each place would be interpreted.
    """
    size = F.size(words)
    shifted = [F.col(words), *[F.slice(words, F.lit(k + 1), F.greatest(size - k, F.lit(0))) for k in range(1, order)]]
    names = [f"_w{k}" for k in range(order)]
    rows = corpus.where(size > 0).select(F.inline(F.arrays_zip(*[c.alias(x) for c, x in zip(shifted, names, strict=True)])).alias(*names))
    each = F.array(*[F.when(F.col(names[n - 1]).isNotNull(), F.xxhash64(*names[:n])) for n in range(1, order + 1)])
    return rows.select(F.explode(each).alias("gram")).where("gram IS NOT NULL")


def counts(corpus: DataFrame, wanted: DataFrame, words: str = "words", order: int = ORDER) -> DataFrame:
    """(gram, n) of the n-grams of the corpus (words) that are among the wanted (gram)."""
    every, asked = grams(corpus, words, order), staging.keep(wanted.where("gram IS NOT NULL").select("gram").distinct())
    if asked.count() <= FEW:
        return every.join(F.broadcast(asked), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return every.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).join(asked.hint("shuffle_hash"), "gram", "left_semi")


def places(rows: DataFrame, keys: list[str], words: str, begin: str, order: int = ORDER) -> DataFrame:
    """(keys…, place, role, gram): for each word from `begin` on (counted from 0) its n-grams (role n) and what they begin with (role -n)."""
    at = F.transform(F.sequence(F.col(begin) + 1, F.size(words)), lambda i: F.struct(i.alias("place"), F.array(*[F.struct(F.lit(r).alias("role"), h.alias("gram")) for n in range(1, order + 1) for r, h in ((n, gram(F.col(words), i, n)), *([(-n, gram(F.col(words), i - 1, n - 1))] if n > 1 else []))]).alias("parts")))
    each = rows.where(F.size(words) > F.col(begin)).select(*keys, F.explode(at).alias("x")).select(*keys, "x.place", F.explode("x.parts").alias("y"))
    return each.select(*keys, "place", "y.role", "y.gram")


def log_probability(count: dict[int, Column], total: Column, order: int = ORDER) -> Column:
    """Of a word from the counts by role."""
    out = F.log(F.lit(FACTOR**order) / total)
    for n in range(1, order + 1):
        below = total if n == 1 else count[-n]
        out = F.when((count[n] > 0) & (below > 0), F.log(F.lit(FACTOR ** (order - n)) * count[n] / below)).otherwise(out)
    return out


def scored(rows: DataFrame, corpus: DataFrame, keys: list[str], words: str = "words", begin: str = "begin", order: int = ORDER) -> DataFrame:
    """(keys…, tokens, score): the log-likelihood of each row's words from `begin` on, after those before them; keys are unique."""
    asked = places(rows, keys, words, begin, order)
    # one row
    total = corpus.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("_total"))
    met = asked.join(counts(corpus, asked, "words", order), "gram", "left")
    roles = [r for n in range(1, order + 1) for r in ((n, -n) if n > 1 else (n,))]
    one = met.groupBy(*keys, "place").agg(*[F.max(F.when(F.col("role") == r, F.coalesce("n", F.lit(0)))).alias(f"_c{r}") for r in roles])
    value = log_probability({r: F.coalesce(F.col(f"_c{r}"), F.lit(0)) for r in roles}, F.greatest(F.col("_total"), F.lit(1)), order)
    each = one.join(F.broadcast(total)).select(*keys, value.alias("_value"))
    return each.groupBy(*keys).agg(F.count(F.lit(1)).alias("tokens"), F.sum("_value").alias("score"))


def rated(items: DataFrame, corpus: DataFrame, split) -> DataFrame:
    """Candidates (id, choice, context, ending, label) with the score of each ending after its context; split makes words of a text."""
    head = split("context")
    rows = items.withColumn("words", F.concat(head, split("ending"))).withColumn("begin", F.size(head))
    return items.join(scored(rows, corpus, ["id", "choice"]).drop("tokens"), ["id", "choice"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
