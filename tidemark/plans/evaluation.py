"""Queries of SURVEY §2: evaluation of scores and strategies, and the set, order and split operators left over. Twins in ``evaluation_sql``."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tidemark.functions import normalize as N
from tidemark.functions.scalars import ladder, md5_bucket, safe_ratio
from tidemark.operators import aggregates as A, windows as W
from tidemark.plans.market import s
from tidemark.plans.reference import momentum, rank_ic, with_ahead
from tidemark.sources.tables import daily_bars, table

QUERIES: dict = {}


def query(f):
    """Registers ``f`` with dates as text."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = f(spark, folder)
        return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c, kind in out.dtypes if kind == "date"})

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    QUERIES[f.__name__] = run
    return f


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """(symbol, trade_date, close, amount, momentum, ahead), all known."""
    return with_ahead(momentum(spark, folder)).where("momentum is not null and ahead is not null")


@query
def rank_ic_summary(spark, folder):
    """Mean and positive share of the daily rank correlations, by year."""
    ic = rank_ic(spark, folder).where("ic is not null").groupBy(F.year("trade_date").alias("year"))
    return ic.agg(F.count("*").alias("days"), s(F.avg("ic")).alias("mean"), s(F.avg((F.col("ic") > 0).cast("double"))).alias("positive_share"))


@query
def recall_segments(spark, folder):
    """By breadth of the day, which share of the best three rows and of all gains the ten most traded hold."""
    day = Window.partitionBy("trade_date")
    m = scored(spark, folder).withColumns({"by_amount": F.row_number().over(day.orderBy(F.col("amount").desc(), "symbol")), "by_ahead": F.row_number().over(day.orderBy(F.col("ahead").desc(), "symbol"))})
    gain = F.greatest(F.col("ahead"), F.lit(0.0))
    caught = F.col("by_amount") <= 10
    daily = m.groupBy("trade_date").agg(
        F.avg((F.col("momentum") > 0).cast("double")).alias("breadth"), F.count_if(F.col("by_ahead") <= 3).alias("best"), F.count_if((F.col("by_ahead") <= 3) & caught).alias("hit"), F.sum(gain).alias("all"), F.sum(F.when(caught, gain).otherwise(0.0)).alias("held"))
    segment = ladder(F.round("breadth", 9), (0.35, "weak"), (0.5, "mixed_down"), (0.65, "mixed_up"), top="strong")
    return daily.groupBy(segment.alias("segment")).agg(F.count("*").alias("days"), s(F.sum("hit") / F.sum("best")).alias("row_recall"), s(F.try_divide(F.sum("held"), F.sum("all"))).alias("utility_capture"))


@F.pandas_udf(T.DoubleType())
def sign_p(positive: pd.Series, n: pd.Series) -> pd.Series:
    """The exact two-sided p of ``positive`` of ``n`` under even odds. One row per test."""

    def one(k: int, m: int) -> float:
        few = min(k, m - k)
        logs = [math.lgamma(m + 1) - math.lgamma(i + 1) - math.lgamma(m - i + 1) - m * math.log(2) for i in range(few + 1)]
        return min(1.0, 2 * math.fsum(map(math.exp, logs)))

    return pd.Series([one(int(k), int(m)) for k, m in zip(positive, n)])


def student_p(t: float, df: int) -> float:
    """The two-sided p of Student's t: the regularised incomplete beta function by its continued fraction."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x in (0.0, 1.0):
        return x

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        h = d
        for m in range(1, 400):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / max(1 + num * d, 1e-300)
                c = max(1 + num / c, 1e-300)
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    if x < (a + 1) / (a + b + 2):
        return front * fraction(x, a, b) / a
    return 1 - front * fraction(1 - x, b, a) / b


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """The two-sided p of a t statistic. One row per test."""
    return pd.Series([None if x is None or x != x else student_p(float(x), int(n)) for x, n in zip(t, df)], dtype="float64")


def symbol_tests(spark: SparkSession, folder: str) -> DataFrame:
    m = momentum(spark, folder).where("momentum is not null")
    g = m.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("momentum").alias("mean"), F.stddev_samp("momentum").alias("sd"), F.count_if(F.col("momentum") > 0).alias("positive"))
    return g.withColumn("t", safe_ratio(F.col("mean"), F.col("sd") / F.sqrt("n")))


@query
def sign_tests(spark, folder):
    """Each symbol's sign test and t statistic, with adjusted p-values; ties of p go by the symbol."""
    tests = symbol_tests(spark, folder).withColumn("p", F.round(sign_p("positive", "n"), 9) + F.col("symbol") * 1e-12)
    return A.bh_adjust(tests, "p").select("symbol", "n", "positive", s("t", 4).alias("t"), s("p").alias("p"), s("q").alias("q"))


@query
def t_tests(spark, folder):
    """The t test's p-values and their adjustment; checked against known values by a test, as SQL has no such function."""
    tests = symbol_tests(spark, folder).where("t is not null").withColumn("p", t_p("t", F.col("n") - 1) + F.col("symbol") * 1e-12)
    return A.bh_adjust(tests, "p").select("symbol", "n", "t", "p", "q")


@query
def winner_shares(spark, folder):
    """The share of a symbol's gains that its best 1 % and 5 % of days made, one day at least."""
    m = momentum(spark, folder).where("momentum > 0")
    own = Window.partitionBy("symbol")
    ranked = m.withColumns({"nth": F.row_number().over(own.orderBy(F.col("momentum").desc(), "trade_date")), "n": F.count("*").over(own)})
    top = lambda share: F.sum(F.when(F.col("nth") <= F.greatest(F.lit(1), F.ceil(F.col("n") * share)), F.col("momentum")).otherwise(0.0)) / F.sum("momentum")
    return ranked.groupBy("symbol").agg(F.count("*").alias("winners"), s(top(0.01)).alias("top1"), s(top(0.05)).alias("top5"))


@query
def seed_distribution(spark, folder):
    """The distribution over ten seeds of the mean gain of half of the symbols, by year, and in how many years every seed gains."""
    m = scored(spark, folder).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(9))))
    picked = m.where(md5_bucket(F.concat_ws("|", F.col("seed").cast("string"), F.col("symbol").cast("string")), 2) == 0)
    by = picked.groupBy(F.year("trade_date").alias("year"), "seed").agg(F.avg("ahead").alias("x"))
    return by.groupBy("year").agg(
        F.count("*").alias("seeds"), s(F.avg("x")).alias("mean"), s(F.median("x")).alias("median"), s(F.stddev_pop("x")).alias("sd"), s(F.min("x")).alias("low"), s(F.percentile("x", F.lit(0.25))).alias("q25"), s(F.percentile("x", F.lit(0.75))).alias("q75"), s(F.max("x")).alias("high"),
        F.bool_and(F.col("x") > 0).alias("all_positive"))


@query
def group_by_all(spark, folder):
    """SQL with GROUP BY ALL, ordinals, and HAVING over an alias."""
    table(spark, folder, "orders").createOrReplaceTempView("tidemark_orders")
    return spark.sql("""
      select o_orderpriority, year(o_orderdate) as year, count(*) as orders, round(max(o_totalprice), 2) as largest from tidemark_orders group by all having orders > 1
      union all select o_orderpriority, 0, count(*), round(max(o_totalprice), 2) from tidemark_orders group by 1""")


@query
def source_disagreement(spark, folder):
    """Reports that two providers deliver, with whether they disagree in title or rating, by what the preferred one says."""
    t = table(spark, folder, "research_report").select(F.lower(N.squeeze("source_report_key")).alias("key"), F.coalesce("tushare_present", F.lit(False)).alias("a"), F.coalesce("eastmoney_present", F.lit(False)).alias("b"), "title", "rating", "record_id")
    g = t.where(~F.col("key").rlike("^[-—–]*$")).groupBy("key").agg(
        F.bool_or("a").alias("a"), F.bool_or("b").alias("b"), F.max(F.when(F.col("a"), F.col("rating"))).alias("ra"), F.max(F.when(F.col("b"), F.col("rating"))).alias("rb"),
        (F.min("title") != F.max("title")).alias("titles"), F.count_distinct("record_id").alias("ids"))
    return g.groupBy("a", "b", F.coalesce("titles", F.lit(False)).alias("titles_differ"), F.coalesce(F.col("ra") != F.col("rb"), F.lit(False)).alias("ratings_differ")).agg(F.count("*").alias("reports"), F.sum("ids").alias("deliveries"))


@query
def choice_overlap(spark, folder):
    """How many of two scores' daily ten strongest are the same, and the rank correlation of the scores, by year."""
    day = Window.partitionBy("trade_date")
    m = scored(spark, folder).withColumns({
        "a": F.row_number().over(day.orderBy(F.col("momentum").desc(), "symbol")), "b": F.row_number().over(day.orderBy(F.col("amount").desc(), "symbol")), "n": F.count("*").over(day)})
    daily = m.groupBy("trade_date").agg(F.count_if((F.col("a") <= 10) & (F.col("b") <= 10)).alias("both"), F.least(F.lit(10), F.max("n")).alias("of"), A.correlation(F.col("a"), F.col("b")).alias("rho"))
    return daily.groupBy(F.year("trade_date").alias("year")).agg(F.count("*").alias("days"), s(F.avg(F.col("both") / F.col("of"))).alias("overlap"), s(F.avg("rho")).alias("rho"))


@query
def keep_first_and_last(spark, folder):
    """Duplicates of a line's key by their first and last part; exact copies are one."""
    t = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    at = F.struct("l_partkey", "l_suppkey")
    return t.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("versions"), F.min(at)["l_suppkey"].alias("first_supplier"), F.max(at)["l_suppkey"].alias("last_supplier")).where("versions > 1")


@query
def shrinking_runs(spark, folder):
    """Stretches over which a symbol's volume falls day by day. The recursion that extends a run by one day is a break count here."""
    spec = W.along(["symbol"], "trade_date")
    runs = W.islands(daily_bars(spark, folder), ["symbol"], "trade_date", F.coalesce(F.col("volume") >= F.lag("volume").over(spec), F.lit(True)))
    return runs.groupBy("symbol", "island").agg(F.min("trade_date").alias("first_day"), F.count("*").alias("days"), F.min("volume").alias("least")).where("days >= 3").drop("island")


@query
def yearly_walk_forward(spark, folder):
    """Each year is predicted by a line fitted to all years before it; one pass of sums, no loop over years."""
    m = scored(spark, folder).withColumns({"year": F.year("trade_date"), "x": F.least(F.greatest(F.col("momentum"), F.lit(-1.0)), F.lit(1.0)), "y": F.least(F.greatest(F.col("ahead"), F.lit(-1.0)), F.lit(1.0))})
    x, y = F.col("x"), F.col("y")
    sums = m.groupBy("year").agg(F.count("*").alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"))
    before = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)  # a row per year
    past = sums.select("year", *[F.sum(c).over(before).alias(f"b_{c}") for c in ("n", "x", "y", "xx", "xy")])
    slope = safe_ratio(F.col("b_n") * F.col("b_xy") - F.col("b_x") * F.col("b_y"), F.col("b_n") * F.col("b_xx") - F.col("b_x") * F.col("b_x"))
    lines = past.withColumn("slope", slope).withColumn("level", (F.col("b_y") - F.col("slope") * F.col("b_x")) / F.col("b_n")).where("slope is not null").select("year", "slope", "level", F.col("b_n").alias("trained_on"))
    off = F.col("y") - F.col("level") - F.col("slope") * F.col("x")
    return m.join(F.broadcast(lines), "year").groupBy("year", "trained_on", s("slope").alias("slope"), s("level").alias("level")).agg(F.count("*").alias("n"), s(F.sqrt(F.avg(off * off))).alias("rmse"))


@query
def rule_score(spark, folder):
    """A score of fixed weights over clipped ranks and distances, unknown values neutral."""
    spec, day = W.along(["symbol"], "trade_date"), Window.partitionBy("trade_date")
    m = momentum(spark, folder).withColumns({"mean20": W.complete(F.avg, F.col("close"), spec, -19, 0), "peak": F.max("close").over(spec.rowsBetween(-19, 0))})
    rank = lambda c: F.when(F.col(c).isNotNull(), F.percent_rank().over(day.orderBy(F.col(c).asc_nulls_first())))
    ranked = m.withColumns({"r1": rank("momentum"), "r2": rank("amount"), "off": safe_ratio(F.col("close"), F.col("mean20")) - 1, "drop": safe_ratio(F.col("close"), F.col("peak")) - 1})
    clip = lambda c, lo, hi: F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi))
    neutral = lambda c, v: F.when(c.isNull(), F.lit(v)).otherwise(c)
    off = F.when(F.col("off").isNotNull(), clip("off", -0.03, 0.03))
    drop = F.when(F.col("drop").isNotNull(), clip("drop", -0.05, 0.0))
    score = 0.5 * neutral(F.col("r1"), 0.5) + 0.3 * neutral(F.col("r2"), 0.5) + 0.1 * neutral(off, 0.0) / 0.03 + 0.1 * neutral(drop, -0.05) / 0.05
    return ranked.select("symbol", "trade_date", s(score).alias("score"))


@query
def compounded_equity(spark, folder):
    """A symbol's compounded gain and deepest drawdown of each year, of returns clipped to half."""
    spec = W.along(["symbol"], "trade_date")
    b = daily_bars(spark, folder).withColumn("last", F.lag("close").over(spec)).withColumn("gain", F.least(F.greatest(safe_ratio(F.col("close"), F.col("last")) - 1, F.lit(-0.5)), F.lit(0.5))).where("gain is not null").withColumn("year", F.year("trade_date"))
    own = W.along(["symbol", "year"], "trade_date").rowsBetween(Window.unboundedPreceding, 0)
    eq = b.withColumn("log", F.sum(F.log1p("gain")).over(own)).withColumn("down", F.col("log") - F.greatest(F.max("log").over(own), F.lit(0.0)))
    return eq.groupBy("symbol", "year").agg(F.count("*").alias("days"), s(F.sum(F.log1p("gain")), 5).alias("log_gain"), s(F.exp(F.min("down")) - 1).alias("drawdown"))
