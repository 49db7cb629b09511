"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated three-word windows
of each text. Beyond them each row gets a vector of transformed statistics, and
each (language, source) group a minimum-covariance-determinant estimate of their
centre and spread. From three starts (medians with median deviations, spatial
signs, and hyperbolic tangents of the scaled statistics) concentration steps take
the mean and covariance of the half of the rows that is nearest under the estimate
before, as long as that lowers the determinant; of the three the one with the least
determinant counts. Rows far out by Mahalanobis distance are rejected.

A covariance counts besides its own rows ``PRIOR`` rows of a target: the median
deviations of the group's language, which count as many of all rows. That is the
regularisation, in the data's own scale, and what it adds fades with the size of the
group: groups of any size have their own estimate. The three shares are zero in most
texts, so half of the rows say nothing on their spread: it is ``FLOORS`` at least.

Each step is one aggregation of a written table of a few numbers a row, with
partial sums before the shuffle; the half is found by an approximate quantile,
which also merges partial results. The estimates, one row a group, are broadcast
behind a check of their number. So a source with a third of all rows is no hot group,
and texts are read once.

The statistics (``FEATURES``): log of the number of words, mean word length (of
``SMOOTH`` words of ``TYPICAL`` characters more, as the mean of few words varies much),
the shares (as square roots) of symbols, repeated lines and repeated windows.

Nulls: a null text is an empty one without words, which fails the base rules. A
null language or source is a group of its own. Repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardweave.llm.common import SPACE, cut, drop_cut, passing, small_or_not, text_of

FEATURES = ("f_words", "f_length", "f_symbols", "f_lines", "f_windows")
SMOOTH, TYPICAL = 100, 5
#: Least standard deviations of the five statistics, and how many rows a target counts for.
FLOORS, PRIOR = (1e-3, 1e-3, 0.05, 0.245, 0.2), 50
#: Chi-square quantile of 5 degrees of freedom at 0.999999, and the median.
CUTOFF, MEDIAN = 35.89, 4.351
MIN_WORDS = 50
#: An estimate is final once a step lowers its log determinant by no more. Each step lowers it, so steps come to an end.
SETTLED = 0.01
#: Shares of the rows that a half may be: small groups need a few rows more than half.
_HALVES = (0.5, 0.55, 0.6, 0.7, 0.85, 1.0)
#: Groups whose estimates (some 60 numbers each) are broadcast; beyond that they are joined by a shuffle.
MOST_GROUPS = 100_000
#: Files of a table with a row for each group.
FILES = 8
_POSITION = 1 << 20


def _packed(words: Column) -> Column:
    """Sorted hash-and-position numbers of the three-word windows."""
    at = F.sequence(F.lit(0), F.size(words) - 3)
    return F.sort_array(F.transform(at, lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]).bitwiseAND(~(_POSITION - 1)).bitwiseOR(i.cast("long"))))


def _listed(words: Column) -> Column:
    """Sorted windows and positions, for texts with more words than 20 bits can count."""
    at = F.sequence(F.lit(0), F.size(words) - 3)
    return F.sort_array(F.transform(at, lambda i: F.struct(F.concat_ws(" ", words[i], words[i + 1], words[i + 2]).alias("w"), i.alias("i"))))


def _repeated(packed: Column, words: Column) -> Column:
    """How many words lie in a three-word window that occurs twice or more.

    Equal neighbours among the sorted windows mark their first words, and what
    these windows cover is counted once. The words of neighbours are compared, so
    a hash alone decides nothing. Both arguments must be columns, not expressions:
    the functions on each element would work these out each time.
    """
    hash_of = lambda p: p.bitwiseAND(~(_POSITION - 1))
    spot = lambda p: p.bitwiseAND(_POSITION - 1).cast("int")
    same_words = lambda a, b: (words[a] == words[b]) & (words[a + 1] == words[b + 1]) & (words[a + 2] == words[b + 2])
    twin = lambda p, q: (hash_of(p) == hash_of(q)) & same_words(spot(p), spot(q))
    last = F.size(packed) - 1
    marked = F.filter(packed, lambda p, i: F.when(i > 0, twin(p, packed[i - 1])).otherwise(False) | F.when(i < last, twin(p, packed[i + 1])).otherwise(False))
    return _covered(F.transform(marked, spot))


def _repeated_long(rows: Column) -> Column:
    last = F.size(rows) - 1
    marked = F.filter(rows, lambda p, i: F.when(i > 0, p["w"] == rows[i - 1]["w"]).otherwise(False) | F.when(i < last, p["w"] == rows[i + 1]["w"]).otherwise(False))
    return _covered(F.transform(marked, lambda p: p["i"]))


def _covered(starts: Column) -> Column:
    """How many positions the windows of three from these starts cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2)))))


def _fixed(df: DataFrame, keep: list[str], new: dict[str, Column]) -> DataFrame:
    """``keep`` and new columns that later expressions refer to as they are.

    The optimizer would put an array's expression into a function on each element,
    which works it out each time; it does not do so through a generator.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*(c.alias(k) for k, c in new.items())))))


def count_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(id, group columns g0.., n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    src = docs.select(F.col(id_col).alias("id"), *(F.col(g).alias(f"g{i}") for i, g in enumerate(groups)), text_of(text_col).alias("_text"))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    keep = ["id", *(f"g{i}" for i in range(len(groups))), "_text"]
    src = _fixed(src, keep, {"words": F.array_remove(F.split("_text", f"{SPACE}+", -1), ""), "lines": lines})
    n, words = F.size("words"), F.col("words")
    src = _fixed(src, [*keep, "words", "lines"], {"packed": F.when((n >= 4) & (n < _POSITION), _packed(words)), "listed": F.when(n >= _POSITION, _listed(words))})
    return src.select(
        "id", *(f"g{i}" for i in range(len(groups))),
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", f"{SPACE}+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(n < 4, 0).when(n < _POSITION, _repeated(F.col("packed"), words)).otherwise(_repeated_long(F.col("listed"))).cast("long").alias("n_repeat_words"),
    )


def _statistics(counts: DataFrame) -> DataFrame:
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.lit(1), F.col(b)))
    return counts.withColumns({
        "f_words": F.log1p("n_words"), "f_length": (F.col("word_chars") + SMOOTH * TYPICAL) / (F.col("n_words") + SMOOTH),
        "f_symbols": share("n_symbols", "word_chars"), "f_lines": share("n_dup_lines", "n_lines"), "f_windows": share("n_repeat_words", "n_words"),
    })


def _cholesky(d: int) -> list[tuple[int, int, str]]:
    """SQL for the Cholesky factor l_i_j of the covariance c_i_j, in the order of dependence."""
    out = []
    for j in range(d):
        out.append((j, j, "sqrt(greatest(1e-9D, " + f"c_{j}_{j}" + "".join(f" - l_{j}_{k}*l_{j}_{k}" for k in range(j)) + "))"))
        for i in range(j + 1, d):
            out.append((i, j, f"(c_{j}_{i}" + "".join(f" - l_{i}_{k}*l_{j}_{k}" for k in range(j)) + f")/l_{j}_{j}"))
    return out


def _with_factor(moments: DataFrame) -> DataFrame:
    """``moments`` (m_i, c_i_j for i <= j) with no variance under its floor, the factor of the covariance, and its log determinant."""
    d = len(FEATURES)
    out = moments.withColumns({f"c_{i}_{i}": F.greatest(F.col(f"c_{i}_{i}"), F.lit(FLOORS[i] ** 2)) for i in range(d)})
    for i, j, expr in _cholesky(d):
        out = out.withColumn(f"l_{i}_{j}", F.expr(expr))
    return out.withColumn("det", F.expr("2 * (" + " + ".join(f"ln(l_{i}_{i})" for i in range(d)) + ")"))


def _distance(rows: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance ``d2`` by forward substitution."""
    d = len(FEATURES)
    out = rows
    for i, f in enumerate(FEATURES):
        out = out.withColumn(f"z_{i}", F.expr(f"({f} - m_{i}" + "".join(f" - l_{i}_{k}*z_{k}" for k in range(i)) + f")/l_{i}_{i}"))
    return out.withColumn("d2", F.expr(" + ".join(f"z_{i}*z_{i}" for i in range(d))))


def _spread(rows: DataFrame, key: str, *upper: str) -> DataFrame:
    """(key, upper, n, m_i, v_i): medians, and squared median deviations, of each group, a written table."""
    middle = rows.groupBy(key).agg(F.count("*").alias("n"), *(F.first(u).alias(u) for u in upper), *(F.percentile_approx(f, 0.5, 1000).alias(f"m_{i}") for i, f in enumerate(FEATURES)))
    middle = small_or_not(_table(middle), MOST_GROUPS)
    own = rows.select(key, *FEATURES).join(middle, key)
    off = own.groupBy(key).agg(*(F.pow(1.4826 * F.percentile_approx(F.abs(F.col(f) - F.col(f"m_{i}")), 0.5, 1000), 2).alias(f"v_{i}") for i, f in enumerate(FEATURES)))
    return small_or_not(_table(off.join(middle, key)), MOST_GROUPS)


def _targets(many: DataFrame) -> DataFrame:
    """(grp, n, m_i, t_i, s_i): sizes, medians, the target's variances, and scales to start from."""
    d = len(FEATURES)
    of = lambda df, prefix, *keys: df.select(*keys, F.col("n").alias(f"{prefix}n"), *(F.greatest(F.col(f"v_{i}"), F.lit(FLOORS[i] ** 2)).alias(f"{prefix}{i}") for i in range(d)))
    # The tables of the upper groups are on the right of the joins, where they can be broadcast.
    own, par, top = _spread(many, "grp", "par", "top"), of(_spread(many, "par"), "p_", "par"), of(_spread(many, "top"), "a_", "top")
    both = own.join(par, "par").join(top, "top")
    target = {f"t_{i}": (F.col("p_n") * F.col(f"p_{i}") + PRIOR * F.col(f"a_{i}")) / (F.col("p_n") + PRIOR) for i in range(d)}
    both = both.withColumns(target)
    return both.select("grp", "n", *(f"m_{i}" for i in range(d)), *target, *(F.sqrt(F.greatest(f"v_{i}", f"t_{i}")).alias(f"s_{i}") for i in range(d)))


def _starts(many: DataFrame, base: DataFrame) -> DataFrame:
    """(grp, start, m_i, c_i_j): three estimates for each group."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    scaled = many.join(base, "grp").select("grp", *(((F.col(f) - F.col(f"m_{i}")) / F.col(f"s_{i}")).alias(f"z_{i}") for i, f in enumerate(FEATURES)))
    scaled = scaled.withColumn("norm", F.greatest(F.expr(" + ".join(f"z_{i}*z_{i}" for i in range(d))), F.lit(1e-12)))
    sums = scaled.groupBy("grp").agg(
        *(F.avg(F.col(f"z_{i}") * F.col(f"z_{j}") / F.col("norm")).alias(f"sign_{i}_{j}") for i, j in pairs),
        *(F.covar_pop(F.tanh(f"z_{i}"), F.tanh(f"z_{j}")).alias(f"tanh_{i}_{j}") for i, j in pairs),
    )
    one = lambda i, j: F.lit(1.0 if i == j else 0.0)
    shapes = {"mad": one, "sign": lambda i, j: d * F.col(f"sign_{i}_{j}") + 0.1 * one(i, j), "tanh": lambda i, j: F.col(f"tanh_{i}_{j}") + 0.1 * one(i, j)}
    rows = F.array(*(F.struct(F.lit(k).alias("start"), *((shape(i, j) * F.col(f"s_{i}") * F.col(f"s_{j}")).alias(f"c_{i}_{j}") for i, j in pairs)) for k, shape in shapes.items()))
    return base.join(sums, "grp").select("grp", *(f"m_{i}" for i in range(d)), F.inline(rows))


def _concentrated(many: DataFrame, fit: DataFrame, base: DataFrame) -> DataFrame:
    """The estimates from the nearest half of each group's rows under ``fit``."""
    d = len(FEATURES)
    key, pairs = ["grp", "start"], [(i, j) for i in range(d) for j in range(i, d)]
    near = _distance(many.join(fit, "grp")).select(*key, "n", "d2", *FEATURES)
    share = F.least(F.lit(1.0), (F.col("n") + d + 1) / (2 * F.col("n"))) - 0.01
    half = F.coalesce(*(F.when(share <= p, F.col("q")[k]) for k, p in enumerate(_HALVES)))
    halves = near.groupBy(*key).agg(F.first("n").alias("n"), F.percentile_approx("d2", list(_HALVES), 1000).alias("q")).select(*key, half.alias("h"))
    inner = near.join(small_or_not(_table(halves), MOST_GROUPS), key).filter("d2 <= h")
    moments = inner.groupBy(*key).agg(F.count("*").alias("k"), *(F.avg(f).alias(f"m_{i}") for i, f in enumerate(FEATURES)), *(F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"w_{i}_{j}") for i, j in pairs))
    with_target = moments.join(base.select("grp", "n", *(f"t_{i}" for i in range(d))), "grp")
    shrunk = lambda i, j: (F.col("k") * F.col(f"w_{i}_{j}") + (PRIOR * F.col(f"t_{i}") if i == j else F.lit(0.0))) / (F.col("k") + PRIOR)
    return with_target.select(*key, "n", *(f"m_{i}" for i in range(d)), *(shrunk(i, j).alias(f"c_{i}_{j}") for i, j in pairs))


def _table(groups: DataFrame) -> DataFrame:
    """A written table of a row for each group, in few files."""
    return cut(groups.coalesce(FILES))


def _improved(many: DataFrame, fit: DataFrame, base: DataFrame) -> DataFrame:
    """``fit`` (deleted) with a step's result for each live estimate whose determinant it lowers; others are final."""
    with passing():
        live = _table(fit.filter("live"))
        new = _with_factor(_concentrated(many, small_or_not(live, MOST_GROUPS), base))
        if live.count() <= MOST_GROUPS:  # a step has at most as many rows
            new = new.hint("broadcast")
        values = [c for c in new.columns if c not in ("grp", "start")]
        step = new.select("grp", "start", F.struct(*values).alias("new"))
        met = fit.withColumn("old", F.struct(*values)).select("grp", "start", "old").join(step, ["grp", "start"], "left")
        lower = F.coalesce(F.col("new.det") < F.col("old.det") - SETTLED, F.lit(False))
        out = cut(met.select("grp", "start", F.when(lower, F.col("new")).otherwise(F.col("old")).alias("f"), lower.alias("live")).select("grp", "start", "f.*", "live").coalesce(FILES), outlive=True)
    drop_cut(fit)
    return out


def robust_distances(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (a written table) with ``d2`` under the estimate of their group; null where a group has no text of MIN_WORDS."""
    d = len(FEATURES)
    label = lambda ks: F.concat_ws("\x01", F.lit(""), *(F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("null")) for k in ks))
    many = rows.filter(f"n_words >= {MIN_WORDS}").select(*FEATURES, label(keys).alias("grp"), label(keys[:-1]).alias("par"), F.lit("").alias("top"))
    base = small_or_not(_table(_targets(many)), MOST_GROUPS)
    fit = _table(_with_factor(_starts(many, base).join(base.select("grp", "n"), "grp")).withColumns({"det": F.lit(float("inf")), "live": F.lit(True)}))
    while not fit.filter("live").isEmpty():
        fit = _improved(many, fit, base)
    best = _table(fit.groupBy("grp").agg(F.min_by(F.struct(*(c for c in fit.columns if c not in ("grp", "n", "live"))), F.struct("det", "start")).alias("f")).select("grp", "f.*"))
    best = small_or_not(best, MOST_GROUPS)
    scale = _distance(many.join(best, "grp")).groupBy("grp").agg(F.greatest(F.lit(1.0), F.percentile_approx("d2", 0.5, 1000) / MEDIAN).alias("scale"))
    scaled = small_or_not(_table(best.select("grp", *(f"m_{i}" for i in range(d)), *(f"l_{i}_{j}" for i, j, _ in _cholesky(d))).join(scale, "grp")), MOST_GROUPS)
    out = _distance(rows.withColumn("grp", label(keys)).join(scaled, "grp", "left"))
    return out.select(*rows.columns, (F.col("d2") / F.col("scale")).alias("d2"))


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source"), cutoff: float = CUTOFF) -> DataFrame:
    """(id, counts, base_failed, distance, kept) of every row."""
    rows = cut(_statistics(count_rules(docs, id_col, text_col, groups)))
    keys = [f"g{i}" for i in range(len(groups))]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = robust_distances(rows, keys)
    return out.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.sqrt("d2").alias("distance"), (~failed & F.coalesce(F.col("d2") <= cutoff, F.lit(True))).alias("kept"),
    )
