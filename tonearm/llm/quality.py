"""Quality rules: robust multivariate outliers.

A document's statistics become a vector of five transformed values: log words, log characters a word, log
share of signs among its characters, log share of distinct words, log words a line. All of them vary among
ordinary documents, so that the scatter of a language and source, and not a constant, says what is far.

For each language and source the minimum-covariance-determinant estimate is sought: the half of the
documents whose covariance has the least determinant. Four starts are concentrated (the half nearest to an
estimate gives the next estimate) until the determinant stands still, and the least determinant wins. The
estimate is scaled to be consistent for normal vectors, computed once more from the documents within the
0.975 quantile, and a document whose Mahalanobis distance is beyond CUTOFF is rejected.

Every step reads all documents: it is a grouped aggregate over a narrow table, so a source with a third of
all rows costs map-side sums and not one large task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.selection import quantiles
from .blocks import Blocks
from .common import tidy, written

SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the vector needs besides: ASCII signs (neither letters, digits nor white space), distinct words, lines with a word.
MORE_STATS = ("n_signs", "n_distinct", "n_lines")
DIMS = ("z0", "z1", "z2", "z3", "z4")
#: The 1 - 1e-9 quantile of a chi-squared variable with 5 degrees of freedom: of a billion ordinary documents one is beyond it.
CUTOFF = 50.6926
#: The medians and 0.975 quantiles of chi-squared variables with 1 to 5 degrees: an estimate that isn't of full rank has fewer.
MEDIANS, INNERS = (0.4549, 1.3863, 2.3660, 3.3567, 4.3515), (5.0239, 7.3778, 9.3484, 11.1433, 12.8325)
#: A group with fewer documents (about ten for each dimension) is judged by its language, and that by the corpus.
MIN_GROUP = 60
#: A dimension whose quartiles are closer than the first (in units of a normal's standard deviation) is measured in a
#: unit that rises evenly from the second to its own width, so that no unit jumps.
LEAST_SCALE, ITS_SCALE = 0.02, 0.1
#: Variance, in a unit's, at which a direction is half drawn to the unit. A direction in which the half (nearly) agrees,
#: as where most documents have one line, says little: what differs there is common to many good documents.
#: Its variance goes over to that of the unit, evenly (see drawn()), and as evenly it leaves the rank.
DRAWN = 0.002
#: Added to counts of signs, so that a few of them are no surprise where most documents have none.
SOME_SIGNS = 5
STARTS = ("box", "signs", "tanh", "all")
#: A determinant stands still if its logarithm falls by less. A start takes 2 to 15 steps; MOST_STEPS only guards the loop.
STILL, MOST_STEPS = 1e-3, 60
#: Accuracy of the approximation that brackets a median, and the values that a bracket may hold.
ACCURACY, BRACKET = 10_000, 1_000_000
#: Files of a table with a row for each estimate.
SMALL = 4
#: Above this many estimates they are joined by a shuffle, below it they are broadcast.
MAX_BROADCAST_GROUPS = 10_000

SIGN = np.zeros(256, bool)
SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
SYMBOLS_B = [c.encode() for c in SYMBOLS]


def _repeats(words: list[bytes]) -> tuple[int, int]:
    """Words covered by 3-word windows that occur twice or more, and distinct words."""
    n = len(words)
    code: dict[bytes, int] = {}
    ids = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, n)
    if n < 4 or len(code) == n:
        return 0, len(code)
    _, pair = np.unique(ids[:-1] * len(code) + ids[1:], return_inverse=True)
    _, window, count = np.unique(pair[:-1] * len(code) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[window] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum()), len(code)


def _counted(texts: list[bytes | None]) -> list[pa.Array]:
    """STATS and MORE_STATS of some texts."""
    rows = []
    for text in texts:
        text = text or b""
        words = text.split()
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        chars = int(np.count_nonzero((np.frombuffer(b"".join(words), np.uint8) & 0xC0) != 0x80))
        signs = int(np.count_nonzero(SIGN[np.frombuffer(text, np.uint8)]))
        repeated, distinct = _repeats(words)
        rows.append((len(words), chars, sum(map(text.count, SYMBOLS_B)), len(lines) - len(set(lines)), repeated, signs, distinct, len(lines)))
    stats = np.array(rows, np.int64).reshape(-1, len(STATS) + len(MORE_STATS))
    return [pa.array(stats[:, k]) for k in range(stats.shape[1])]


@tidy
def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *_counted(batch.column("text").cast(pa.binary()).to_pylist())], names=[*names, *STATS, *MORE_STATS])


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with STATS and MORE_STATS in place of the text. A null text counts as one without words.

    Columns of docs that have a statistic's name, or are named text without being the text, are replaced.
    """
    own = (*STATS, *MORE_STATS)
    rest = [f for f in docs.schema.fields if f.name not in (text_col, "text", *own)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), *(f"{s} long" for s in own)])
    return docs.select(*(f"`{f.name}`" for f in rest), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_stats, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector() -> list[Column]:
    n, chars = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "word_chars"))
    return [F.log(n), F.log(chars / n), F.log((F.col("n_signs") + SOME_SIGNS) / (chars + SOME_SIGNS)), F.log(F.greatest("n_distinct", F.lit(1)) / n), F.log(n / F.greatest("n_lines", F.lit(1)))]


def _models(vectors: DataFrame) -> DataFrame:
    """lang, source, model (the estimate that judges the group's documents) and feeds (all estimates they are part of).

    A group of enough documents has its own. A language with smaller groups has one of all its documents,
    and if that is too small as well, the corpus has one of all documents.
    """
    name = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    own, whole, rest = name("lang", "source"), name("lang"), F.lit("{}")
    groups = written(vectors.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")), "groups")
    langs = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), (F.min("n") < MIN_GROUP).alias("pooled")).withColumnRenamed("lang", "of")
    small = langs.where((F.col("lang_n") < MIN_GROUP) & F.col("pooled")).limit(1).count() > 0
    told = groups.join(langs, F.col("lang").eqNullSafe(F.col("of")))
    model = F.when(F.col("n") >= MIN_GROUP, own).when(F.col("lang_n") >= MIN_GROUP, whole).otherwise(rest)
    feeds = F.array_compact(F.array(F.when(F.col("n") >= MIN_GROUP, own), F.when(F.col("pooled") & (F.col("lang_n") >= MIN_GROUP), whole), rest if small else F.lit(None).cast("string")))
    return told.select("lang", "source", model.alias("model"), feeds.alias("feeds"))


MOMENTS = [f"m{i}" for i in range(5)] + [f"m{i}{j}" for i in range(5) for j in range(i, 5)]


def _moments(rows: DataFrame, *keys: str) -> DataFrame:
    """Count and sums of the dimensions and of their products."""
    d = [F.col(z) for z in DIMS]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.sum(x).alias(f"m{i}") for i, x in enumerate(d)), *(F.sum(d[i] * d[j]).alias(f"m{i}{j}") for i in range(5) for j in range(i, 5)))


def drawn(values: np.ndarray) -> np.ndarray:
    """How far directions of these variances are drawn to the unit: near 0 for wide ones, 1 for none at all, and in between without a jump."""
    return DRAWN**2 / (np.maximum(values, 0.0) ** 2 + DRAWN**2)


def estimate(n: int, sums: list[float]) -> tuple[list[float], list[float], float, float]:
    """Centre, inverse covariance, log determinant and rank (not always whole) from moments; see DRAWN for directions of hardly any variance."""
    mean = np.array(sums[:5]) / n
    cov = np.zeros((5, 5))
    cov[np.triu_indices(5)] = np.array(sums[5:]) / n
    cov = cov + np.triu(cov, 1).T - np.outer(mean, mean)
    values, axes = np.linalg.eigh(cov)
    to_unit = drawn(values)
    told = (1 - to_unit) * np.maximum(values, 0.0) + to_unit
    logdet = float(np.log(np.hypot(values, DRAWN)).sum())
    return mean.tolist(), ((axes / told) @ axes.T).ravel().tolist(), logdet, float(np.maximum(1.0, (1 - to_unit).sum()))


def at_rank(table: tuple[float, ...]) -> Column:
    """A table for 1 to 5 degrees at the column rank, in proportion between whole ones."""
    whole = F.least(F.floor("rank"), F.lit(4)).cast("int")
    low, high = (F.element_at(F.array(*map(F.lit, table)), i) for i in (whole, whole + 1))
    return low + (high - low) * (F.col("rank") - whole)


def _median(rows: DataFrame, side, *keys: str) -> DataFrame:
    """keys and h: the exact median of d. An approximation brackets it, and the few values within are sorted.

    Should a bracket hold more than BRACKET values, the medians are found by selection, which has no such list.
    """
    around = rows.groupBy(*keys).agg(F.percentile_approx("d", [0.4995, 0.5005], ACCURACY).alias("b"), F.count(F.lit(1)).alias("n"))
    inside = F.col("d").between(F.col("b")[0], F.col("b")[1])
    met = rows.join(side(around), list(keys)).groupBy(*keys).agg(F.max("n").alias("n"), F.count_if(F.col("d") < F.col("b")[0]).alias("below"), F.count_if(inside).alias("size"), F.collect_list(F.when(inside, F.col("d"))).alias("held"))
    ranks = [(F.floor((F.col("n") - 1) / 2) - F.col("below")).cast("int"), (F.ceil((F.col("n") - 1) / 2) - F.col("below")).cast("int")]
    in_order = F.array_sort("held")
    told = written(met.select(*keys, "size", ((F.get(in_order, ranks[0]) + F.get(in_order, ranks[1])) / 2).alias("h")).coalesce(SMALL), "halves")
    if told.where((F.col("size") > BRACKET) | F.col("h").isNull()).limit(1).count():
        told = quantiles(rows, "d", [0.5], list(keys)).select(*keys, F.col("q")[0].alias("h"))
    return told.select(*keys, "h")


def _estimates(sums: DataFrame) -> DataFrame:
    """model, start, centre, inverse, logdet and rank, a row for each row of moments."""

    @tidy
    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(m, s, *estimate(n, list(v))) for m, s, n, *v in pdf[["model", "start", "n", *MOMENTS]].itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["model", "start", "centre", "inverse", "logdet", "rank"])

    return sums.mapInPandas(solve, "model string, start string, centre array<double>, inverse array<double>, logdet double, rank double")


def _distance() -> Column:
    d = [F.col(z) - F.col("centre")[i] for i, z in enumerate(DIMS)]
    return sum((d[i] * d[j] * F.col("inverse")[i * 5 + j] for i in range(5) for j in range(5)), F.lit(0.0))


def _first_estimates(scaled: DataFrame) -> DataFrame:
    """The four starts, from vectors scaled by medians and quartiles: their units, the directions of the
    vectors, the vectors drawn in by tanh, and the plain covariance."""
    d = [F.col(z) for z in DIMS]
    norm = F.sqrt(sum((x * x for x in d), F.lit(0.0)))
    signs = [F.when(norm > 0, x / norm).otherwise(0.0) for x in d]
    kinds = F.array(*(F.struct(F.lit(k).alias("start"), *(x.alias(z) for x, z in zip(v, DIMS))) for k, v in (("signs", signs), ("tanh", [F.tanh(x) for x in d]), ("all", d))))
    found = _estimates(_moments(scaled.select("model", F.explode(kinds).alias("v")).select("model", "v.*"), "model", "start"))
    zero = F.array(*[F.lit(0.0)] * 5)
    # The first two are about the medians, which are 0 here.
    drawn = found.select("model", "start", F.when(F.col("start") == "all", F.col("centre")).otherwise(zero).alias("centre"), "inverse")
    box = found.where("start = 'all'").select("model", F.lit("box").alias("start"), zero.alias("centre"), F.array(*(F.lit(float(i == j)) for i in range(5) for j in range(5))).alias("inverse"))
    return drawn.union(box).withColumns({"logdet": F.lit(None).cast("double"), "rank": F.lit(5.0), "steps": F.lit(0)})


def concentrated(scaled: DataFrame, side) -> DataFrame:
    """model, centre, inverse, logdet, rank, start and steps: the best of each model's starts after concentration.

    scaled: model and DIMS, a row for each document. A start is done when its determinant stands still, and
    the best of its steps counts.
    """
    now, done = written(_first_estimates(scaled), "starts"), None
    for step in range(1, MOST_STEPS + 1):
        near = scaled.join(side(now), "model").select("model", "start", *DIMS, _distance().alias("d"))
        half = _median(near, side, "model", "start")
        inner = near.join(side(half), ["model", "start"]).where(F.col("d") <= F.col("h"))
        told = ("logdet", "centre", "inverse", "rank", "steps")
        before = now.select("model", "start", F.struct(*told).alias("old"))
        new = _estimates(_moments(inner, "model", "start")).withColumn("steps", F.lit(step)).select("model", "start", F.struct(*told).alias("new"))
        met = written(new.join(before, ["model", "start"]).coalesce(SMALL), "steps")
        open_ = F.col("old.logdet").isNull() | (F.col("old.logdet") - F.col("new.logdet") >= STILL)
        ended = met.where(~open_ | F.lit(step == MOST_STEPS)).select("model", "start", F.when(F.col("old.logdet") < F.col("new.logdet"), F.col("old")).otherwise(F.col("new")).alias("one")).select("model", "start", "one.*")
        done = ended if done is None else done.union(ended)
        now = met.where(open_).select("model", "start", "new.*")
        if not now.limit(1).count():
            break
    best = F.min(F.struct("logdet", "start", "centre", "inverse", "rank", "steps")).alias("best")
    return written(done.groupBy("model").agg(best).select("model", "best.*"), "estimates")


def robust_outliers(stats: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """stats (lang, source and all statistics) with base_failed, distance (squared) and kept.

    A document that fails the base rules is rejected and takes no part in the estimates. Groups of under
    MIN_GROUP documents are judged by their language's estimate, else by that of the corpus; documents of a
    corpus of under MIN_GROUP are kept unjudged (distance null). Null languages and sources are groups of
    their own. Rows that repeat are judged alike; no rows give no rows. Columns of stats named base_failed,
    distance or kept are replaced.
    """
    names = [c for c in stats.columns if c not in ("base_failed", "distance", "kept")]
    x = [f"x{i}" for i in range(5)]
    held = written(stats.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("row"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), base_failed().alias("base_failed"), *(c.alias(n) for c, n in zip(_vector(), x))), "quality")
    models = written(_models(held.where(~F.col("base_failed"))), "models")
    wide = models.count() > MAX_BROADCAST_GROUPS
    side = (lambda df: df) if wide else F.broadcast  # a row for each estimate and start: at most 4 * MAX_BROADCAST_GROUPS
    g = side(models.withColumnsRenamed({"lang": "g_lang", "source": "g_source"}))
    placed = held.join(g, held["lang"].eqNullSafe(g["g_lang"]) & held["source"].eqNullSafe(g["g_source"]), "left").drop("g_lang", "g_source")
    fed = placed.where(~F.col("base_failed")).select(F.explode("feeds").alias("model"), *x)
    # Distances don't change with a dimension's origin and unit: medians and quartiles make them comparable.
    by_dim = quantiles(fed.select("model", F.explode(F.array(*(F.struct(F.lit(c).alias("dim"), F.col(c).alias("v")) for c in x))).alias("e")).select("model", "e.*"), "v", [0.25, 0.5, 0.75], ["model", "dim"], bins=8_192)
    quartiles = by_dim.groupBy("model").agg(F.max("n").alias("size"), *(F.max(F.when(F.col("dim") == c, F.col("q"))).alias(f"p_{c}") for c in x))
    width = {c: (F.col(f"p_{c}")[2] - F.col(f"p_{c}")[0]) / 1.349 for c in x}
    units = written(quartiles.select("model", "size", *(F.col(f"p_{c}")[1].alias(f"o_{c}") for c in x), *((width[c] + ITS_SCALE * F.greatest(F.lit(0.0), 1 - width[c] / LEAST_SCALE)).alias(f"u_{c}") for c in x)), "units")
    scale = [((F.col(c) - F.col(f"o_{c}")) / F.col(f"u_{c}")).alias(z) for c, z in zip(x, DIMS)]
    scaled = written(fed.join(side(units), "model").where(F.col("size") >= MIN_GROUP).select("model", *scale), "vectors")
    best = concentrated(scaled, side)
    median, inner = at_rank(MEDIANS), at_rank(INNERS)
    for turn in range(2):  # the half's estimate, then that of the documents within the inner quantile
        near = scaled.join(side(best), "model").select("model", *DIMS, _distance().alias("d"))
        middle = _median(near, side, "model").withColumnRenamed("h", "middle")
        told = written(best.join(middle, "model").withColumn("factor", F.col("middle") / median), "factors")
        if turn == 0:
            within = near.join(side(told.select("model", (inner * F.col("factor")).alias("most"))), "model").where(F.col("d") <= F.col("most")).withColumn("start", F.lit("inner"))
            best = written(_estimates(_moments(within, "model", "start")), "estimates")
    final = told.select("model", "centre", "inverse", "factor").join(units.drop("size"), "model")
    out = placed.join(side(final), "model", "left").select("row", "base_failed", "centre", "inverse", "factor", *scale)
    out = out.withColumn("distance", F.when(~F.col("base_failed"), _distance() / F.greatest("factor", F.lit(1e-12))))
    return out.select("row.*", "base_failed", "distance", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source, the statistics, base_failed, distance and kept, a row for each row of docs."""
    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{source_col}`").cast("string").alias("source"))
    return robust_outliers(text_statistics(picked))


def kept_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that neither the base rules nor the outlier test reject. Texts wait in blocks and are never shuffled."""
    blocks = Blocks(docs, text_col, _counted, ", ".join(f"{s} long" for s in (*STATS, *MORE_STATS)))
    stats = blocks.marks.select("block", "row", F.col(blocks.column(lang_col)).alias("lang"), F.col(blocks.column(source_col)).alias("source"), *STATS, *MORE_STATS)
    return blocks.rows(robust_outliers(stats).where("kept"))
