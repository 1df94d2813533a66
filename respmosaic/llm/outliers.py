"""Quality rules: robust multivariate outliers by minimum covariance determinant, in DataFrame functions only.

Text statistics become a vector of transformed values. Per language and source (sparse ones are pooled by language, then
altogether) the estimator starts from the half of the rows nearest to the coordinate-wise medians, and concentrates: mean and
covariance of the chosen half give Mahalanobis distances, the half with the smallest distances is chosen next. Each step is a
combinable aggregate; the half's bound is read from a histogram of the distances, so no group is ever sorted or gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from respmosaic.llm.storage import store

#: Fixed: words of a repeated window; the rules that fail a text outright.
RUN, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Concentration steps; rows a group needs to have an estimate of its own.
STEPS, LEAST_ROWS = 3, 100
#: Coordinates: name, value, and the least standard deviation that is told from none (most texts have no symbols or repeats at all).
VECTOR = (
    ("x0", lambda: F.log(F.col("n_words")), 0.8),
    ("x1", lambda: F.log(F.col("word_chars") / F.col("n_words")), 0.1),
    ("x2", lambda: F.log1p(100.0 * F.col("n_symbols") / F.col("word_chars")), 0.4),
    ("x3", lambda: F.log1p(F.col("n_dup_lines")), 0.4),
    ("x4", lambda: F.log1p(100.0 * F.col("n_repeat_words") / F.col("n_words")), 0.6),
)
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_P = len(VECTOR)
#: Median of a chi-squared variable with as many degrees of freedom as there are coordinates.
CHI_MEDIAN = {1: 0.4549, 2: 1.3863, 3: 2.3660, 4: 3.3567, 5: 4.3515}[_P]
#: Squared distance beyond which a text is rejected: the 99.99 % quantile of that variable.
CUTOFF = {1: 15.1367, 2: 18.4207, 3: 21.1075, 4: 23.5127, 5: 25.7448}[_P]
_BLANK = r"\x20\x09-\x0D"


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long) appended; a null text has no words."""
    kept = [docs[f"`{c}`"] for c in docs.columns if c not in STATISTICS]
    base = docs.select(*kept, F.coalesce(docs[text_col], F.lit("")).alias("__t"))
    lines = rf"filter(split(__t, '\n'), l -> l RLIKE r'[^{_BLANK}]')"
    step = base.withColumns(
        {
            "__w": F.expr(f"regexp_extract_all(__t, r'[^{_BLANK}]+', 0)"),
            "n_symbols": F.expr("cast(regexp_count(__t, r'[#*$%&|<>]') as long)"),
            "n_dup_lines": F.expr(f"CASE WHEN instr(__t, '\n') > 0 THEN cast(transform(array({lines}), x -> size(x) - size(array_distinct(x)))[0] as long) ELSE 0L END"),
        }
    ).drop("__t")
    step = step.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.length(F.array_join("__w", "")).cast("long"),
            "__h": F.expr(f"CASE WHEN size(__w) > {RUN} THEN transform(array(transform(__w, w -> xxhash64(w))), h -> transform(sequence(1, size(h) - {RUN - 1}), i -> xxhash64(slice(h, i, {RUN}))))[0] END"),
        }
    ).drop("__w")
    # positions of windows found twice: neighbours in sorted order; then the words they cover together
    covered = f"""transform(array(array_sort(transform(__h, (x, i) -> named_struct('x', x, 'i', i)))), s ->
      aggregate(array_sort(filter(transform(s, (v, k) -> CASE WHEN (k > 0 AND element_at(s, k).x = v.x) OR (k + 1 < size(s) AND element_at(s, k + 2).x = v.x) THEN v.i END), p -> p IS NOT NULL)),
        named_struct('upto', 0, 'n', 0L),
        (a, p) -> named_struct('upto', p + {RUN}, 'n', a.n + p + {RUN} - greatest(a.upto, p)),
        a -> a.n))[0]"""
    repeated = F.expr(f"CASE WHEN size(array_distinct(__h)) < size(__h) THEN {covered} ELSE 0L END")
    return step.withColumn("n_repeat_words", F.coalesce(repeated, F.lit(0).cast("long"))).drop("__h")


def _keys(rows: DataFrame, group_cols: tuple[str, str], least: int) -> DataFrame:
    """``rows`` with the ``key`` of the group that its estimate comes from (null where even the whole pool is too small)."""
    a, b = (F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in group_cols)
    rows = rows.withColumn("__a", a).withColumn("__b", b)
    own = rows.groupBy("__a", "__b").agg(F.count(F.lit(1)).alias("n"))
    own = own.withColumn("key", F.when(F.col("n") >= least, F.concat_ws("\x01", "__a", "__b")))
    pooled = F.sum(F.when(F.col("key").isNull(), F.col("n")))
    lang = own.groupBy("__a").agg(pooled.alias("rest")).withColumn("wide", F.when(F.col("rest") >= least, F.col("__a")))
    last = lang.agg(F.sum(F.when(F.col("wide").isNull(), F.col("rest"))).alias("m"))
    named = own.join(lang, "__a").select("__a", "__b", F.coalesce("key", "wide", F.when(F.lit(last.first()["m"] or 0) >= least, F.lit("\x02"))).alias("key"))
    return rows.join(store(named, "mcd-keys"), ["__a", "__b"]).drop("__a", "__b")


def _bound(rows: DataFrame, value: Column, share: float, name: str) -> DataFrame:
    """Per key the histogram bin of ``value`` (an integer column) up to which ``share`` of the rows lie."""
    counts = rows.groupBy("key", value.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    total = W.partitionBy("key")
    running = counts.withColumn("upto", F.sum("c").over(total.orderBy("bin"))).withColumn("all", F.sum("c").over(total))
    return running.where(F.col("upto") >= F.col("all") * share).groupBy("key").agg(F.min("bin").alias(name))


def _bin(d: Column) -> Column:
    """Histogram bin of a squared distance: about 2 % wide, so a group has a few thousand bins at most."""
    return F.floor(F.log1p(d) * 50).cast("int")


def _estimates(chosen: DataFrame) -> DataFrame:
    """Per key the mean and the inverse Cholesky factor of the covariance of the chosen rows."""
    xs = [v[0] for v in VECTOR]
    aggs = [F.count(F.lit(1)).alias("n"), *(F.sum(x).alias(f"s_{x}") for x in xs)]
    aggs += [F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"p_{i}{j}") for i in range(_P) for j in range(i + 1)]
    t = chosen.groupBy("key").agg(*aggs)
    t = t.select("key", *(F.round(F.col(f"s_{x}") / F.col("n"), 9).alias(f"m_{x}") for x in xs), "n", *(f"p_{i}{j}" for i in range(_P) for j in range(i + 1)))
    cov = lambda i, j: F.round(F.col(f"p_{i}{j}") / F.col("n") - F.col(f"m_{xs[i]}") * F.col(f"m_{xs[j]}"), 9)
    t = t.select("key", *(f"m_{x}" for x in xs), *((cov(i, j) if i != j else F.greatest(cov(i, j), F.lit(0.0)) + VECTOR[i][2] ** 2).alias(f"c_{i}{j}") for i in range(_P) for j in range(i + 1)))
    for i in range(_P):  # Cholesky factor, then its inverse, row by row
        for j in range(i + 1):
            rest = F.col(f"c_{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
            t = t.withColumn(f"l_{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l_{j}{j}"))
    for i in range(_P):
        for j in range(i + 1):
            rest = F.lit(1.0 if i == j else 0.0)
            for k in range(j, i):
                rest = rest - F.col(f"l_{i}{k}") * F.col(f"v_{k}{j}")
            t = t.withColumn(f"v_{i}{j}", F.round(rest / F.col(f"l_{i}{i}"), 9))
    return t.select("key", *(f"m_{x}" for x in xs), *(f"v_{i}{j}" for i in range(_P) for j in range(i + 1)))


def _distances(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """``rows`` with the squared Mahalanobis distance ``d`` to the estimate of their key."""
    xs = [v[0] for v in VECTOR]
    d = F.lit(0.0)
    for i in range(_P):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col(f"v_{i}{j}") * (F.col(xs[j]) - F.col(f"m_{xs[j]}"))
        d = d + z * z
    return rows.join(estimates, "key", "left").withColumn("d", d).select(*rows.columns, "d")


def judge(docs: DataFrame, text_col: str = "text", group_cols: tuple[str, str] = ("lang", "source"), cutoff: float = CUTOFF, steps: int = STEPS, least_rows: int = LEAST_ROWS) -> DataFrame:
    """``docs`` without its text, with the statistics, ``base_failed``, ``distance`` (null where not judged) and ``kept``; one row per input row.

    ``base_failed`` texts (few words, or much repeated) are not kept and enter no estimate. A null language or source is a value of its
    own. Rows of groups below ``least_rows`` are judged with their language's other sparse rows, then with all sparse rows; a pool that
    is still too small rejects nothing. Repeated rows are judged alike.
    """
    names = [c for c in docs.columns if c != text_col and c not in (*STATISTICS, "base_failed", "distance", "kept")]
    row = F.struct(*[docs[f"`{c}`"] for c in names]) if names else F.struct(F.lit(None).cast("string").alias("none"))
    packed = docs.select(row.alias("row"), docs[text_col].alias("body"), *(docs[c].cast("string").alias(f"site{i}") for i, c in enumerate(group_cols)))
    stats = text_statistics(packed, "body").drop("body")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    stats = store(stats.withColumn("base_failed", failed), "mcd-statistics")
    good = stats.where(~F.col("base_failed")).withColumns({name: F.round(value(), 6) for name, value, _ in VECTOR})
    rows = store(_keys(good, ("site0", "site1"), least_rows), "mcd-rows")
    slim = rows.where("key is not null").select("key", *(v[0] for v in VECTOR))

    # start: distance to the medians, by the scale of the median deviation
    medians = None
    for name, *_ in VECTOR:
        m = _bound(slim, F.floor(F.col(name) * 200 + 0.5).cast("int"), 0.5, f"m_{name}")
        medians = m if medians is None else medians.join(m, "key")
    medians = store(medians, "mcd-medians")
    spread = slim.join(medians, "key")
    gaps = None
    for name, *_ in VECTOR:
        g = _bound(spread.select("key", F.floor(F.abs(F.col(name) * 200 - F.col(f"m_{name}"))).cast("int").alias("g")), F.col("g"), 0.5, f"g_{name}")
        gaps = g if gaps is None else gaps.join(g, "key")
    start = F.lit(0.0)
    for name, _, floor in VECTOR:
        scale = F.greatest(F.col(f"g_{name}") / 200 * 1.4826, F.lit(floor))
        start = start + ((F.col(name) - F.col(f"m_{name}") / 200) / scale) ** 2
    near = spread.join(store(gaps, "mcd-gaps"), "key").select(*slim.columns, start.alias("d"))
    estimates = None
    for _ in range(steps + 1):
        near = store(near, "mcd-distances")
        half = _bound(near, _bin(F.col("d")), 0.5, "half")
        estimates = store(_estimates(near.join(half, "key").where(_bin(F.col("d")) <= F.col("half"))), "mcd-estimates")
        near = _distances(slim, estimates)
    # the chosen half is narrower than the whole: scale distances so that their median is that of a normal sample
    middle = _bound(near, _bin(F.col("d")), 0.5, "middle").select("key", F.greatest(F.expm1((F.col("middle") + 1) / 50) / CHI_MEDIAN, F.lit(1.0)).alias("factor"))
    scored = _distances(rows, estimates).join(store(middle, "mcd-scale"), "key", "left").withColumn("distance", F.round(F.col("d") / F.col("factor"), 6))
    judged = scored.select(*stats.columns, "distance", (F.coalesce("distance", F.lit(0.0)) <= cutoff).alias("kept"))
    both = judged.unionByName(stats.where("base_failed").select("*", F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept")))
    return both.select(*(F.col("row").getField(c).alias(c) for c in names), *STATISTICS, "base_failed", "distance", "kept")


def digest(docs: DataFrame) -> DataFrame:
    """Contract columns, and the robust distance."""
    return judge(docs.select("doc_id", "text", "lang", "source")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
