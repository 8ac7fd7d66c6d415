"""Design checks of boards and frames: roles against gender, balance verdicts, coherence, overlap with word lists, axis diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from . import balance

#: Association below which roles count as independent of gender, and cards of a board.
INDEPENDENT, BOARD_WORDS = 0.3, 25
FACES = ("llm_perspective_role", "human_perspective_role")


def role_counts(cards: DataFrame) -> DataFrame:
    """(board_id, face, role, n) of both faces of every board."""
    each = F.inline(F.array(*[F.struct(F.lit(f).alias("face"), F.col(f).alias("role")) for f in FACES]))
    return cards.select("board_id", each).groupBy("board_id", "face", "role").agg(F.count("*").alias("n"))


def joint_roles(cards: DataFrame) -> DataFrame:
    """(board_id, roles on both faces, n)."""
    return cards.groupBy("board_id", *FACES).agg(F.count("*").alias("n"))


def role_gender(cards: DataFrame, dilemma: DataFrame | None = None, decimals: int = 6) -> DataFrame:
    """(board_id, v_llm, v_human, independent): Cramer's V of role and category on each face, dilemma words left out.

    V is null where either side has a single level; such a face counts as independent. ``dilemma`` holds (board_id, word).
    """
    rows = cards.where("category is not null")
    if dilemma is not None:
        rows = rows.join(dilemma.select("board_id", "word"), ["board_id", "word"], "left_anti")
    v = None
    for face, name in zip(FACES, ("v_llm", "v_human"), strict=True):
        one = association(rows, face, "category", "board_id").withColumnRenamed("v", name)
        v = one if v is None else v.join(one, "board_id")
    free = lambda c: F.coalesce(F.col(c) < INDEPENDENT, F.lit(True))
    return v.select("board_id", F.round("v_llm", decimals).alias("v_llm"), F.round("v_human", decimals).alias("v_human"), (free("v_llm") & free("v_human")).alias("independent"))


def association(rows: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """(by..., v): Cramer's V of two columns per group over the levels that occur there; null below two levels a side."""
    cells = rows.groupBy(*by, a, b).agg(F.count("*").alias("o"))
    na = cells.groupBy(*by, a).agg(F.sum("o").alias("na"))
    nb = cells.groupBy(*by, b).agg(F.sum("o").alias("nb"))
    n = na.groupBy(*by).agg(F.sum("na").alias("n"), F.count("*").alias("ra"))
    rb = nb.groupBy(*by).agg(F.count("*").alias("rb"))
    # the sum of (o - e)^2 / e over all cells is that of o^2 / e over the cells that occur, less n
    met = cells.join(na, [*by, a]).join(nb, [*by, b]).groupBy(*by).agg(F.sum(F.col("o") * F.col("o") / (F.col("na") * F.col("nb"))).alias("s"))
    low = F.least("ra", "rb") - 1
    return met.join(n, list(by)).join(rb, list(by)).select(*by, F.when(low > 0, F.sqrt(F.greatest(F.col("s") - 1, F.lit(0.0)) / low)).alias("v"))


def covariate_verdicts(rows: DataFrame, treated: Column, covariates: list[str], *by: str, limit: float = 0.1, decimals: int = 6) -> DataFrame:
    """(by..., covariate, smd, tost_p, smd_ok, equivalent): whether two groups are alike in each covariate.

    smd_ok: an absolute standardised difference of at most ``limit``; equivalent: both one-sided tests at 0.2 pooled
    deviations reject at 0.05. Undefined figures are not alike.
    """
    from ..functions import stats

    long = rows.select(*by, treated.alias("t"), F.inline(F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("x")) for c in covariates])))
    g = balance.two_group(long, F.col("t"), "x", *by, "covariate")
    e = balance.effect_sizes(g, *by, "covariate")

    p = g.select(*by, "covariate", F.round(stats.tost_p_column("ma", "mb", "va", "vb", "na", "nb"), decimals).alias("tost_p"))
    out = e.select(*by, "covariate", "smd").join(p, [*by, "covariate"])
    return out.select("*", F.coalesce(F.abs("smd") <= limit, F.lit(False)).alias("smd_ok"), F.coalesce(F.col("tost_p") < 0.05, F.lit(False)).alias("equivalent"))


def well_balanced(verdicts: DataFrame, *by: str) -> DataFrame:
    """(by..., well_balanced): every covariate's difference is small."""
    return verdicts.groupBy(*by).agg(F.bool_and("smd_ok").alias("well_balanced"))


def incoherent(boards: DataFrame, cards: DataFrame) -> DataFrame:
    """(board_id, problem): probes without dilemma, specification or poled card; controls with any of them."""
    poled = cards.groupBy("board_id").agg(F.count_if(F.col("category").isin("male", "female")).alias("poled"), F.count("*").alias("n"), F.countDistinct(F.lower("text")).alias("words"))
    b = boards.select("board_id", "type", "specification", (F.coalesce("dilemma", F.lit("")) != "").alias("has")).join(poled, "board_id", "left")
    probe, control = F.col("type") == "probe", F.col("type") == "control"
    rules = [
        (probe & ~F.col("has"), "probe without a dilemma"), (probe & F.col("specification").isNull(), "probe without a specification"), (probe & (F.coalesce("poled", F.lit(0)) == 0), "probe without a poled card"),
        (control & F.col("has"), "control with a dilemma"), (control & F.col("specification").isNotNull(), "control with a specification"),
        (F.coalesce("n", F.lit(0)) != BOARD_WORDS, "not 25 cards"), (F.coalesce("words", F.lit(0)) != F.coalesce("n", F.lit(0)), "words not distinct"),
    ]
    return b.select("board_id", F.explode(F.array_compact(F.array(*[F.when(c, p) for c, p in rules]))).alias("problem"))


def frequency_lookup(words: DataFrame, frequencies: DataFrame, word: str = "word") -> tuple[DataFrame, DataFrame]:
    """``words`` with zipf (null if the list lacks the word), and the distinct words that it lacks."""
    found = words.join(frequencies.select(F.col("word").alias("_w"), "zipf"), F.lower(F.col(word)) == F.col("_w"), "left").drop("_w")
    return found, found.where("zipf is null").select(F.lower(F.col(word)).alias("word")).distinct()


def zipped(a: DataFrame, b: DataFrame, order: str) -> DataFrame:
    """Two lists side by side by place: (place, left, right) of frames (``order``, value); lists of unlike length are an error."""
    from pyspark.sql import Window

    placed = lambda df, name: df.select((F.row_number().over(Window.orderBy(order)) - 1).alias("place"), F.col("value").alias(name))  # noqa: E731  (word lists)
    both = placed(a, "left").withColumn("_l", F.lit(True)).join(placed(b, "right").withColumn("_r", F.lit(True)), "place", "full_outer")
    whole = F.when(F.col("_l") & F.col("_r"), F.col("place")).otherwise(F.raise_error(F.lit("lists of unlike length")))
    return both.select(whole.alias("place"), "left", "right")


def recall(deck: DataFrame, terms: list[str]) -> DataFrame:
    """(term, present): which terms a deck of words holds, whatever their case."""
    spark = deck.sparkSession
    asked = spark.createDataFrame([(t.strip().lower(),) for t in terms], "term string").distinct()
    return asked.join(deck.select(F.lower("word").alias("term")).distinct().withColumn("_p", F.lit(True)), "term", "left").select("term", F.coalesce("_p", F.lit(False)).alias("present"))


def axis_diagnostics(words: DataFrame, axis: DataFrame, mean: DataFrame, decimals: int = 6) -> DataFrame:
    """(geometry, n, mean_male, mean_female, gap, correlation): loads of poled words, raw and centred, and how both agree.

    ``words`` (word, v, pole), ``axis`` and ``mean`` one row each (axis; mean).
    """
    both = axis.crossJoin(mean.withColumnRenamed("mean", "mu"))  # two single rows
    loads = words.crossJoin(F.broadcast(both)).select("pole", vectors.dot("v", "axis").alias("raw"), vectors.dot(vectors.centred("v", "mu"), "axis").alias("centred"))
    corr = loads.agg(F.round(F.corr("raw", "centred"), decimals).alias("correlation"))
    long = loads.select("pole", F.inline(F.array(*[F.struct(F.lit(g).alias("geometry"), F.col(g).alias("x")) for g in ("raw", "centred")])))
    of = lambda p: F.avg(F.when(F.col("pole") == p, F.col("x")))
    out = long.groupBy("geometry").agg(F.count("*").alias("n"), of("male").alias("m"), of("female").alias("f"))
    return out.crossJoin(corr).select("geometry", "n", F.round("m", decimals).alias("mean_male"), F.round("f", decimals).alias("mean_female"), F.round(F.col("m") - F.col("f"), decimals).alias("gap"), "correlation")


def next_in_turn(rows: DataFrame, unit: str, order: str) -> DataFrame:
    """``rows`` with place, counted from 0 within the unit in the order given."""
    from pyspark.sql import Window

    return rows.withColumn("place", F.row_number().over(Window.partitionBy(unit).orderBy(order)) - 1)


def arbiters_checked(spec: DataFrame, primary: str, evaluated: list[str]) -> DataFrame:
    """``spec`` (model_id, revision) of arbiters if it holds any, all are pinned, the primary is one of them and none is an evaluated model; else an error."""
    from ..functions import text

    n = spec.agg(F.count("*").alias("n"), F.count_if(F.col("model_id") == primary).alias("p"))
    bad = (
        F.when(F.col("n") == 0, "no arbiters").when(F.col("p") == 0, "the primary is not among the arbiters")
        .when(F.coalesce("revision", F.lit("")) == "", F.concat(F.lit("not pinned: "), F.col("model_id"))).when(text.names_evaluated(F.col("model_id"), evaluated), F.concat(F.lit("evaluated model: "), F.col("model_id")))
    )
    rows = n.crossJoin(F.broadcast(spec)) if spec.limit(1).count() else n.select("*", F.lit(None).cast("string").alias("model_id"), F.lit("x").alias("revision"))  # a handful of arbiters
    return rows.select(F.when(bad.isNull(), F.col("model_id")).otherwise(F.raise_error(bad)).alias("model_id"), "revision")
