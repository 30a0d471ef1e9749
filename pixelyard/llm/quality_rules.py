"""Quality rules: plain limits, then robust multivariate outliers per language and source.

Only DataFrame functions. Each text becomes a few counts; those that pass the limits also become a
vector of transformed rates. For every (language, source) the minimum covariance determinant is
sought by concentration steps: the mean and covariance of the six tenths of the rows with the
smallest distances, again and again. They begin from three estimates (medians and median deviations;
mean and covariance; the correlation of squashed entries); after ``FIRST_STEPS`` steps the start with
the smallest determinant goes on while the group's determinant falls. The covariance is scaled to be right
for normal rows and widened by a tolerance. A document goes if its squared Mahalanobis distance from
its group's estimate is over ``CUTOFF``, which one normal row in 10 ** 10 exceeds. An estimate needs
``LEAST`` rows: a group of fewer uses its language's, and a language of fewer that of all rows, so a
verdict may change when a group grows past that number.

All group figures are aggregates with map-side parts (quantiles over rounded values, so that what
an aggregate holds is bounded), so a group with a third of all rows costs no single task.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelyard.llm.common import Scratch, staged

BLANKS = "[\\x20\\x09-\\x0D]+"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Rows that an estimate needs.
LEAST = 100
#: Share of the rows whose covariance determinant is minimised.
KEPT_SHARE = 0.6
#: Steps from every start; the best one goes on while its determinant's logarithm falls by more than ``SETTLED``.
FIRST_STEPS, MOST_STEPS, SETTLED = 2, 30, 1e-3
#: Groups whose rows (some 200 bytes each, one a start) are sent to every task; more are joined by key.
FEW_GROUPS = 50_000


def _over(x: float, half: int) -> float:
    """The share of chi-square values of ``2 * half`` degrees of freedom that are over ``x``."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(half))


def _quantile_over(share: float, half: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _over(mid, half) > share else (lo, mid)
    return hi


#: Of normal vectors of four entries one in so many is over the cutoff: about one in a corpus of 100 TB.
CUTOFF = _quantile_over(1e-10, 2)
#: The covariance of the nearest ``KEPT_SHARE`` of normal rows, times this, is that of all.
CONSISTENT = KEPT_SHARE / (1 - _over(_quantile_over(1 - KEPT_SHARE, 2), 3))
#: Added to each entry's variance: rates that differ by some 0.06 tell nothing, though nearly all rows have the same.
TOLERANCE = 4e-3
VECTOR = ["v_length", "v_symbols", "v_upper", "v_repeats"]
LOWER = [(i, j) for i in range(len(VECTOR)) for j in range(i + 1)]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _runs(out: DataFrame) -> DataFrame:
    """``h``, the hash of each run of ``WINDOW`` consecutive ones of ``h``: of two, then of two such, and so on.

    Each is a column of its own, so that it is computed once.
    """
    n, step = F.size("h"), 1
    while step < WINDOW:
        out = out.withColumn("h", F.zip_with("h", F.slice("h", step + 1, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b)))
        step *= 2
    return out.withColumn("h", F.when(n >= WINDOW, F.slice("h", 1, F.greatest(n - WINDOW + 1, F.lit(1)))).otherwise(F.array().cast("array<bigint>")))


def _twice(pairs: Column) -> Column:
    """Of sorted structs (key, place): the places whose key a neighbour has too."""
    meets = lambda x, k: F.coalesce(F.get(pairs, k)["x"] == x["x"], F.lit(False))
    return F.transform(F.filter(pairs, lambda x, k: meets(x, k - 1) | meets(x, k + 1)), lambda x: x["i"])


def counts(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts of its ``text``, and ``n_upper``, its upper-case letters; ``text`` goes."""
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumn("text", text).withColumn("w", F.array_remove(F.split("text", BLANKS), ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    without = lambda pattern: F.length("text") - F.length(F.regexp_replace("text", pattern, ""))
    out = out.withColumns(
        {
            "n_words": F.size("w").cast("long"),
            "word_chars": F.length(F.concat_ws("", "w")).cast("long"),
            "n_symbols": without("[#*$%&|<>]+").cast("long"),
            "n_upper": without("\\p{Lu}+").cast("long"),
            "l": lines,
            "h": F.transform("w", lambda x: F.xxhash64(x)),  # a word's hash, once
        }
    )
    out = _runs(out.withColumn("n_dup_lines", (F.size("l") - F.size(F.array_distinct("l"))).cast("long")).drop("text", "l"))
    # most texts repeat no window; only the others sort theirs
    out = out.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))).drop("h")
    out = out.withColumn("s", _twice(F.col("s")))
    # windows of one hash may differ: their words decide
    out = out.withColumn("s", F.array_sort(F.transform("s", lambda i: F.struct(F.array_join(F.slice("w", i + 1, WINDOW), " ").alias("x"), i.alias("i"))))).drop("w")
    out = out.withColumn("p", F.array_sort(_twice(F.col("s")))).drop("s")
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("at"))
    covered = F.aggregate("p", start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n"), i.alias("at")), lambda a: a["n"])
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("p")


def _vector(out: DataFrame) -> DataFrame:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return out.withColumns(
        {
            "v_length": F.log(chars / words),
            "v_symbols": F.log1p(10 * F.col("n_symbols") / words),
            "v_upper": F.sqrt(F.col("n_upper") / chars),
            "v_repeats": F.sqrt(F.col("n_repeat_words") / words),
        }
    )


def _quantile(x: Column, share: float, digits: int = 2) -> Column:
    """Exact over rounded values: at most some thousands of them."""
    return F.percentile(F.round(x, digits), F.lit(share))


def _cholesky(group: DataFrame) -> DataFrame:
    """``c_i_j`` replaced by the lower factor ``l_i_j``, a column at a time, and the determinant's logarithm added."""
    n = len(VECTOR)
    for j in range(n):
        for i in range(j, n):
            rest = reduce(add, [F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)], F.lit(0.0))
            value = F.sqrt(F.greatest(F.col(f"c_{i}_{j}") - rest, F.lit(TOLERANCE / 10))) if i == j else (F.col(f"c_{i}_{j}") - rest) / F.col(f"l_{j}_{j}")
            group = group.withColumn(f"l_{i}_{j}", value)
    return group.withColumn("det", reduce(add, [2 * F.log(f"l_{i}_{i}") for i in range(n)])).drop(*[f"c_{i}_{j}" for i, j in LOWER])


def _distance(rows: DataFrame) -> DataFrame:
    """Add ``d``, the squared distance of the row's vector from ``m_i`` under ``l_i_j``: forward substitution."""
    n = len(VECTOR)
    for i, v in enumerate(VECTOR):
        rest = reduce(add, [F.col(f"l_{i}_{k}") * F.col(f"_z{k}") for k in range(i)], F.lit(0.0))
        rows = rows.withColumn(f"_z{i}", (F.col(v) - F.col(f"m_{i}") - rest) / F.col(f"l_{i}_{i}"))
    return rows.withColumn("d", reduce(add, [F.col(f"_z{i}") * F.col(f"_z{i}") for i in range(n)])).drop(*[f"_z{i}" for i in range(n)])


def _beside(group: DataFrame, few: bool) -> DataFrame:
    """A table of one row a group: sent to all tasks if the groups are known to be few, else joined by key."""
    return F.broadcast(group) if few else group


def _starts(rows: DataFrame, few: bool) -> DataFrame:
    """``g, s, m_i, c_i_j``: three estimates a group to begin from."""
    n = range(len(VECTOR))
    middle = rows.groupBy("g").agg(*[_quantile(F.col(v), 0.5, 3).alias(f"m_{i}") for i, v in enumerate(VECTOR)])
    away = [_quantile(F.abs(F.col(v) - F.col(f"m_{i}")), 0.5, 3).alias(f"a_{i}") for i, v in enumerate(VECTOR)]
    plain = [F.avg(v).alias(f"u_{i}") for i, v in enumerate(VECTOR)] + [F.covar_pop(VECTOR[i], VECTOR[j]).alias(f"k_{i}_{j}") for i, j in LOWER]
    found = rows.join(_beside(middle, few), "g").groupBy("g").agg(*[F.first(f"m_{i}").alias(f"m_{i}") for i in n], *away, *plain)
    found = found.withColumns({f"a_{i}": F.sqrt((1.4826 * F.col(f"a_{i}")) ** 2 + TOLERANCE) for i in n})
    squashed = rows.join(_beside(found.select("g", *[f"m_{i}" for i in n], *[f"a_{i}" for i in n]), few), "g").select("g", *[F.tanh((F.col(v) - F.col(f"m_{i}")) / F.col(f"a_{i}")).alias(f"t_{i}") for i, v in enumerate(VECTOR)])
    ties = squashed.groupBy("g").agg(*[F.covar_pop(f"t_{i}", f"t_{j}").alias(f"r_{i}_{j}") for i, j in LOWER])
    size = lambda i, j: F.sqrt(F.col(f"r_{i}_{i}") * F.col(f"r_{j}_{j}"))
    # entries that are the same in all rows go with no other
    ties = ties.select("g", *[F.when(size(i, j) > 1e-12, F.col(f"r_{i}_{j}") / size(i, j)).otherwise(0.0).alias(f"r_{i}_{j}") for i, j in LOWER if i > j])
    found = found.join(_beside(ties, few), "g")
    spread = lambda i, j: F.col(f"a_{i}") * F.col(f"a_{j}")
    of = (
        [(F.col(f"m_{i}") for i in n), (spread(i, i) if i == j else F.lit(0.0) for i, j in LOWER)],
        [(F.col(f"u_{i}") for i in n), (F.col(f"k_{i}_{j}") + (TOLERANCE if i == j else 0.0) for i, j in LOWER)],
        [(F.col(f"m_{i}") for i in n), (spread(i, j) * (F.lit(1.0) if i == j else F.col(f"r_{i}_{j}")) for i, j in LOWER)],
    )
    each = [F.struct(F.lit(s).alias("s"), *[c.alias(f"m_{i}") for i, c in enumerate(m)], *[c.alias(f"c_{i}_{j}") for (i, j), c in zip(LOWER, v, strict=True)]) for s, (m, v) in enumerate(of)]
    return found.select("g", F.explode(F.array(*each)).alias("x")).select("g", "x.*")


def _step(rows: DataFrame, group: DataFrame, few: bool) -> DataFrame:
    """The estimates from the rows nearest to those of ``group``."""
    far = _distance(rows.join(_beside(group, few), "g")).select("g", "s", *VECTOR, F.round(F.log(F.col("d") + 1e-9), 2).alias("d"))
    near = far.groupBy("g", "s").agg(F.percentile("d", F.lit(KEPT_SHARE)).alias("edge"))
    inner = far.join(_beside(near, few), ["g", "s"]).where(F.col("d") <= F.col("edge") + 1e-6)  # the rounded values are 0.01 apart
    moments = [F.avg(v).alias(f"m_{i}") for i, v in enumerate(VECTOR)] + [(CONSISTENT * F.covar_pop(VECTOR[i], VECTOR[j]) + (TOLERANCE if i == j else 0.0)).alias(f"c_{i}_{j}") for i, j in LOWER]
    return _cholesky(inner.groupBy("g", "s").agg(*moments))


def estimates(rows: DataFrame, few: bool) -> DataFrame:
    """Per ``g``: mean and factor of the vectors; ``rows`` has ``g`` and the vector's columns.

    ``few``: there are at most ``FEW_GROUPS`` values of ``g``.
    """
    scratch = Scratch(rows.sparkSession)
    group = scratch.stage(_cholesky(_starts(rows, few)), "start")
    for _ in range(FIRST_STEPS - 1):
        group = scratch.stage(_step(rows, group, few), "step")
    found = _step(rows, group, few)
    best = F.min_by(F.struct(*found.columns), F.struct(F.round("det", 6), "s")).alias("x")
    group = scratch.stage(found.groupBy("g").agg(best).select("x.*"), "best")
    settled = group.where(F.lit(False))
    for _ in range(MOST_STEPS):  # a group that has settled is done, whatever the others do
        before = group.select("g", F.col("det").alias("before"))
        after = scratch.stage(_step(rows, group, few).join(before, "g").withColumn("moves", F.col("before") - F.col("det") > SETTLED).drop("before"), "step")
        settled, group = settled.unionByName(after.where(~F.col("moves")).drop("moves")), after.where("moves").drop("moves")
        if group.isEmpty():
            break
    known = staged(settled.unionByName(group).drop("s", "det"), "estimates")
    scratch.drop()
    return known


def judge(docs: DataFrame) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``distance`` and ``kept`` of each row of ``docs(doc_id, text, lang, source)``.

    A null text has no words. A text that fails the limits isn't kept, has a null ``distance`` and no
    part in the estimates. Null languages and sources are groups of their own. Repeated rows count and
    return as often as they stand; an empty table gives no rows; other columns are ignored.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("lang", F.lit("\0")).alias("lang"), F.coalesce("source", F.lit("\0")).alias("source"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = staged(_vector(counts(named)).withColumn("base_failed", failed).drop("n_upper"), "counts")
    good = rows.where(~F.col("base_failed"))
    by_both = good.groupBy("lang", "source").agg(F.count("*").alias("n_both"))
    by_lang = by_both.groupBy("lang").agg(F.sum("n_both").alias("n_lang"))
    groups = by_both.join(by_lang, "lang").select("lang", "source", F.when(F.col("n_both") >= LEAST, F.to_json(F.struct("lang", "source"))).when(F.col("n_lang") >= LEAST, F.to_json(F.struct("lang"))).otherwise("").alias("g"))
    groups = staged(groups, "groups")
    # what a language's or all rows' estimate rests on: every good row of it, not only those that use it
    few = groups.count() <= FEW_GROUPS
    own = good.join(_beside(groups, few), ["lang", "source"])
    wider = groups.select("g").distinct().where(~F.col("g").contains('"source"'))
    lang_key = F.to_json(F.struct("lang"))
    by_own = own.where(F.col("g").contains('"source"')).select("g", *VECTOR)
    by_language = good.withColumn("g", lang_key).join(wider, "g", "left_semi").select("g", *VECTOR)
    by_all = good.withColumn("g", F.lit("")).join(wider, "g", "left_semi").select("g", *VECTOR)
    vectors = staged(by_own.unionByName(by_language).unionByName(by_all), "vectors")
    known = estimates(vectors, few)
    judged = _distance(rows.join(_beside(groups, few), ["lang", "source"], "left").join(_beside(known, few), "g", "left"))
    distance = F.when(~F.col("base_failed"), F.col("d"))
    kept = ~F.col("base_failed") & F.coalesce(distance <= CUTOFF, F.lit(True))
    return judged.select("doc_id", *COUNTS, "base_failed", distance.alias("distance"), kept.alias("kept"))
