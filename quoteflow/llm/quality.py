"""Quality rules by robust multivariate outliers: per language and source, a minimum-covariance-determinant estimate of transformed text
statistics, and rejection of documents whose Mahalanobis distance is too large.

The estimate starts from deterministic scatters (sums of bounded transforms, so that outliers have little weight) and improves them by concentration
steps: distances under the current estimate, their h-quantile, mean and covariance of the rows below it; every step lowers the determinant. All sums run
over every document as partial aggregates by group, so a group with a third of all rows is no special case; only one row a group is
kept between steps, and nothing of it goes to the driver."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteflow.llm.common import packed, settle, shared_path, small_batches, unpacked

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
WINDOW = 8
P = 4
#: documents that a group needs for an estimate of its own, by the dimension; smaller ones are judged by their whole language's, then the whole corpus's
LEAST_GROUP = 25 * P
#: share of a group's rows that the estimate is to cover; concentration steps of each start; change of a log determinant that ends the
#: best start's, and their number in any case (the share is cut at an approximate quantile, so that small changes may go to and fro)
COVER, FIRST_STEPS, STILL, STEPS = 0.75, 2, 1e-3, 30
#: estimates (rows of some 300 bytes) that are broadcast at most; beyond that rows meet them by group and salt
FEW, SALTS = 6000, 64
#: standard deviations of the transformed statistics below which differences are taken for noise
FLOOR = (0.04, 0.03, 0.15, 0.12)
#: chance that a clean (normal) vector would be rejected
TAIL = 1e-9
#: words of typical length that smooth the mean word length of short texts
SMOOTH, TYPICAL = 20, 5.0

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[list(b" \t\n\v\f\r")] = True


def repeat_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more; windows are told apart by ranks of doubled lengths, exactly."""
    n, length = len(ids), 1
    if n < window + 1:
        return 0
    while length < window:
        ids = np.unique(ids[:-length] * (int(ids.max()) + 1) + ids[length:], return_inverse=True)[1]
        length *= 2
    again = np.bincount(ids)[ids] > 1
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, np.flatnonzero(again), 1)
    np.add.at(edges, np.flatnonzero(again) + window, -1)
    return int((np.cumsum(edges[:n]) > 0).sum())


def statistics(text: bytes) -> tuple[int, ...]:
    """The base statistics of one text, and its lines that hold a word."""
    words = text.split()  # on bytes: exactly the six blanks
    raw = np.frombuffer(text, np.uint8)
    chars = len(raw) - int(_BLANK[raw].sum()) - int(((raw & 0xC0) == 0x80).sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    return len(words), chars, int(_SYMBOL[raw].sum()), len(lines) - len(set(lines)), repeat_words(ids), len(lines)


def with_statistics(docs: DataFrame, text: str = "text", name: str = "stats") -> DataFrame:
    """All rows and columns of docs and a struct of the base statistics; null text counts as empty."""

    @F.pandas_udf(BASE)
    def of(values: pd.Series) -> pd.DataFrame:
        rows = [statistics(t.encode() if isinstance(t, str) else b"") for t in values]
        return pd.DataFrame(rows, columns=[x.split(" ")[0] for x in BASE.split(", ")], dtype="int64")

    return small_batches(docs).withColumn(name, of(F.col(text)))


def base_failed(s: str) -> Column:
    return (F.col(f"{s}.n_words") < 20) | (100 * F.col(f"{s}.n_repeat_words") > 30 * F.col(f"{s}.n_words"))


def transformed(s: str) -> list[Column]:
    """Log of the smoothed mean word length, and angles of the shares of symbols, duplicate lines and repeated words."""
    share = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(f"{s}.{a}") / F.greatest(F.col(f"{s}.{b}"), F.lit(1)))))
    length = F.log((F.col(f"{s}.word_chars") + SMOOTH * TYPICAL) / (F.col(f"{s}.n_words") + SMOOTH))
    return [length, share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]


def chi2_tail(x: float, half: int) -> float:
    """Chance that a chi-square of 2 * half degrees exceeds x."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(half))


def chi2_point(tail: float, half: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_tail(middle, half) > tail else (low, middle)
    return high


PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def _solve(moments: pd.Series, widen: float) -> pd.DataFrame:
    """(n, sums, sums of products) -> centre, inverse covariance, log determinant; variances have a floor of one squared unit of `FLOOR`."""
    rows = []
    for m in moments:
        n, first, second = m[0], np.array(m[1 : P + 1]), np.zeros((P, P))
        for (i, j), v in zip(PAIRS, m[P + 1 :]):
            second[i, j] = second[j, i] = v
        centre = first / n
        covariance = widen * (second / n - np.outer(centre, centre)) + np.eye(P)
        rows.append((centre.tolist(), np.linalg.inv(covariance)[tuple(zip(*PAIRS))].tolist(), float(np.linalg.slogdet(covariance)[1])))
    return pd.DataFrame(rows, columns=["centre", "inverse", "logdet"])


_ESTIMATE = "centre array<double>, inverse array<double>, logdet double"


def _estimates(sums: DataFrame, widen: float) -> DataFrame:
    @F.pandas_udf(_ESTIMATE)
    def solve(moments: pd.Series) -> pd.DataFrame:
        return _solve(moments, widen)

    return sums.withColumn("e", solve("moments")).drop("moments")


def _moments(x: list[Column], when: Column | None = None, weight: Column | None = None) -> Column:
    keep = lambda c: F.sum(c if when is None else F.when(when, c))
    one = F.lit(1.0)
    return F.array(keep(one), *[keep(c) for c in x], *[keep(x[i] * x[j]) for i, j in PAIRS]).alias("moments")


def distance(x: list[Column], e: str) -> Column:
    """Squared Mahalanobis distance of x under an estimate struct."""
    off = [x[i] - F.col(f"{e}.centre")[i] for i in range(P)]
    terms = [off[i] * off[j] * F.col(f"{e}.inverse")[k] * (1 if i == j else 2) for k, (i, j) in enumerate(PAIRS)]
    return reduce(lambda a, b: a + b, terms)


def _meet(rows: DataFrame, small: DataFrame, few: bool) -> DataFrame:
    """Rows with what is known of their group g. Rows are never dealt by group alone, which would bring a large group into one task."""
    if few:
        return rows.join(F.broadcast(small), "g")
    salted = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c != "g"]), F.lit(SALTS)).cast("int")).join(salted, ["g", "salt"]).drop("salt")


def _concentrate(rows: DataFrame, x: list[Column], current: DataFrame, few: bool, widen: float = 1.0, limit: float | None = None) -> DataFrame:
    """One step for every group and start: the nearest share of COVER (or those within a limit) gives the next estimate."""
    # the starts of a group side by side, so that a row meets its group once
    starts = current.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("start", "e"))).alias("starts"))
    far = _meet(rows, starts, few).select("g", *x, F.explode("starts").alias("s")).select("g", F.col("s.start").alias("start"), F.col("s.e").alias("e"), *x)
    far = far.select("g", "start", *x, distance(x, "e").alias("d"))
    if limit is None:
        cut = settle(far.groupBy("g", "start").agg(F.percentile_approx("d", COVER, 10_000).alias("cut")))
        cuts = cut.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("start", "cut"))).alias("cuts"))
        far = _meet(far, cuts, few).withColumn("cut", F.col("cuts")[F.col("start")]).drop("cuts")
    else:
        far = far.withColumn("cut", F.lit(limit))
    sums = far.groupBy("g", "start").agg(_moments(x, F.col("d") <= F.col("cut")))
    return settle(_estimates(sums, widen))


def estimate(rows: DataFrame) -> DataFrame:
    """(g, x0..x3) rows, in units of FLOOR -> (g, e): the reweighted minimum-covariance-determinant estimate of each group.

    Of three starts that with the least determinant after FIRST_STEPS goes on until no group's log determinant changes by more than STILL."""
    x = [F.col(f"x{i}") for i in range(P)]
    middle = settle(rows.groupBy("g").agg(F.array(*[F.percentile_approx(c, 0.5, 10_000) for c in x]).alias("median")))
    few = middle.count() <= FEW
    off = _meet(rows, middle, few)
    spread = off.groupBy("g").agg(F.array(*[F.greatest(F.lit(1.0), 1.4826 * F.percentile_approx(F.abs(x[i] - F.col("median")[i]), 0.5, 10_000)) for i in range(P)]).alias("spread"))
    scale = settle(middle.join(spread, "g"))
    scaled = _meet(rows, scale, few).select("g", *[((x[i] - F.col("median")[i]) / F.col("spread")[i]).alias(f"z{i}") for i in range(P)], "median", "spread")
    z = [F.col(f"z{i}") for i in range(P)]
    size = F.sqrt(F.greatest(reduce(lambda a, b: a + b, [c * c for c in z]), F.lit(1e-12)))
    kinds = [[F.tanh(c) for c in z], [c / size for c in z], [F.when(size <= math.sqrt(P), c) for c in z]]
    starts = None
    for k, values in enumerate(kinds):
        # bounded sums in scaled units, brought back to the statistics' units: centre at the median, shape from the scatter
        one = scaled.select("g", *[(v * F.col("spread")[i]).alias(f"v{i}") for i, v in enumerate(values)])
        sums = one.where("v0 IS NOT NULL").groupBy("g").agg(_moments([F.col(f"v{i}") for i in range(P)]))
        found = _estimates(sums, 1.0).join(middle, "g").select("g", F.lit(k).alias("start"), F.struct(F.col("median").alias("centre"), F.col("e.inverse").alias("inverse"), F.col("e.logdet").alias("logdet")).alias("e"))
        starts = found if starts is None else starts.unionByName(found)
    current = settle(starts)
    for _ in range(FIRST_STEPS):
        current = _concentrate(rows, x, current, few)
    best = current.groupBy("g").agg(F.min(F.struct(F.col("e.logdet").alias("logdet"), "start", "e")).alias("best"))
    current = settle(best.select("g", F.lit(0).alias("start"), F.col("best.e").alias("e")))
    for _ in range(STEPS):
        further = _concentrate(rows, x, current, few)
        change = further.select("g", F.col("e.logdet").alias("after")).join(current.select("g", F.col("e.logdet").alias("before")), "g")
        moved = change.agg(F.max(F.col("before") - F.col("after")).alias("most")).first()["most"]
        current = further
        if moved is None or moved <= STILL:
            break
    # widened to the covariance of the whole normal, of which COVER was seen
    seen = COVER / (1 - chi2_tail(chi2_point(1 - COVER, P // 2), P // 2 + 1))
    current = _concentrate(rows, x, current, few, seen)
    within = chi2_point(0.01, P // 2)
    current = _concentrate(rows, x, current, few, 0.99 / (1 - chi2_tail(within, P // 2 + 1)), within)
    return current.select("g", "e")


def _groups(rows: DataFrame) -> DataFrame:
    """lang, source -> g, the group whose estimate judges them, and feeds, all groups whose estimates their rows enter."""
    by_both, by_language, all_rows = F.xxhash64(F.lit(0), "lang", "source"), F.xxhash64(F.lit(1), "lang"), F.xxhash64(F.lit(2))
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = F.col("n") < LEAST_GROUP
    languages = sizes.groupBy(F.col("lang").alias("_language")).agg(F.sum("n").alias("language_n"), F.max(small).alias("asked"))
    few = F.col("language_n") < LEAST_GROUP
    corpus = languages.agg(F.coalesce(F.max(few), F.lit(False)).alias("corpus_asked"))  # one row
    known = sizes.join(languages, F.col("lang").eqNullSafe(F.col("_language"))).join(F.broadcast(corpus))
    judge = F.when(~small, by_both).when(~few, by_language).otherwise(all_rows)
    feeds = F.array_compact(F.array(F.when(~small, by_both), F.when(~few & F.col("asked"), by_language), F.when(F.col("corpus_asked"), all_rows)))
    return settle(known.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), judge.alias("g"), feeds.alias("feeds")))


def _by_group(rows: DataFrame, table: DataFrame, lang: str = "lang", source: str = "source", how: str = "inner") -> DataFrame:
    """Rows with what a table says of their language and source; salted, for one pair may hold a third of the rows."""
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns if c.startswith("stats")]), F.lit(SALTS)).cast("int")
    same = F.col(f"`{lang}`").eqNullSafe(F.col("_lang")) & F.col(f"`{source}`").eqNullSafe(F.col("_source")) & (F.col("_own_salt") == F.col("_salt"))
    return rows.withColumn("_own_salt", own).join(salted, same, how).drop("_own_salt", "_salt", "_lang", "_source")


def _fit(slim: DataFrame) -> DataFrame:
    """lang, source, stats -> lang, source, e for those that have an estimate. Texts without words are in no sum."""
    scaled = [(c / f).alias(f"x{i}") for i, (c, f) in enumerate(zip(transformed("stats"), FLOOR))]
    worded = slim.where("stats.n_words > 0")
    named = _groups(worded)
    rows = _by_group(worded, named.select("_lang", "_source", "feeds")).select(F.explode("feeds").alias("g"), *scaled)
    found = estimate(settle(rows))
    return settle(named.select("_lang", "_source", "g").join(found, "g").select("_lang", "_source", "e"))


def _judged(rows: DataFrame, fitted: DataFrame, lang: str, source: str) -> DataFrame:
    limit = chi2_point(TAIL, P // 2)
    scaled = [c / f for c, f in zip(transformed("stats"), FLOOR)]
    known = rows.join(F.broadcast(fitted), F.col(f"`{lang}`").eqNullSafe(F.col("_lang")) & F.col(f"`{source}`").eqNullSafe(F.col("_source")), "left") if fitted.count() <= FEW else _by_group(rows, fitted, lang, source, "left")
    return known.withColumn("_far", F.when(F.col("stats.n_words") > 0, distance(scaled, "e"))).withColumn("_kept", ~base_failed("stats") & F.coalesce(F.col("_far") <= limit, F.lit(True)))


def judge(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per document: doc_id, the base statistics, base_failed, kept, distance (squared; null without words or estimate).

    Null and empty texts have no words and fail the base; null languages and sources are groups like others; groups under LEAST_GROUP documents are
    judged by the estimate over all rows of their language, or of the corpus where the language has as few; repeated rows count and are judged each; an empty table gives no rows;
    other columns are not read."""
    slim = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    slim = settle(with_statistics(slim).drop("text"))
    judged = _judged(slim, _fit(slim.select("lang", "source", "stats")), "lang", "source")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(F.col("id").alias("doc_id"), *[f"stats.{n}" for n in names], base_failed("stats").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_far").alias("distance"))


def passing(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows and columns of docs that are kept. They are written once with their statistics, which are read again for the estimate and for the verdict."""
    path = shared_path(docs.sparkSession, "statistics")
    rows = packed(docs, _text=F.col(text), _l=F.col(lang), _s=F.col(source))
    with_statistics(rows, "_text").drop("_text").write.option("compression", "zstd").parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    fitted = _fit(settle(rows.select(F.col("_l").alias("lang"), F.col("_s").alias("source"), "stats")))
    return unpacked(_judged(rows, fitted, "_l", "_s").where("_kept"), docs)
