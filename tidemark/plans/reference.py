"""Queries of SURVEY §2 over the star-schema tables. Each has a twin of the same name in ``reference_sql``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.functions.scalars import bitmask, blank_to, first_reason, ladder, md5_bucket, net_return, safe_ln, safe_ratio, valid_ohlc
from tidemark.operators import aggregates as A, joins as J, windows as W
from tidemark.sources.tables import daily_bars, table

QUERIES: dict = {}


def query(f):
    """Registers ``f`` with dates as text, which engines compare alike; ``f`` itself keeps them."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = f(spark, folder)
        return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c, kind in out.dtypes if kind == "date"})

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    QUERIES[f.__name__] = run
    return f


def r(c: Column | str, digits: int = 8) -> Column:
    """Rounded, as sums of doubles depend on their order in the last digits; eight places hold every price exactly, so none is a tie."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def r_off(c: Column, digits: int) -> Column:
    """``r`` of means, many of which are ties of the last digit: moved off the grid they lie on by a few billionths."""
    return F.round(c + 1.37e-9, digits)


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    in_day = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("bigint") * 1000000 + (F.date_part(F.lit("second"), F.col(ts)) * 1000000).cast("bigint")
    return F.unix_date(F.to_date(ts)).cast("bigint") * 86400000000 + in_day


def by_symbol():
    return W.along(["symbol"], "trade_date")


def momentum(spark: SparkSession, folder: str, n: int = 5) -> DataFrame:
    """(symbol, trade_date, close, amount, momentum): the return over the ``n`` bars before the row's own."""
    spec = by_symbol()
    named = daily_bars(spark, folder).withColumns({"_last": F.lag("close", 1).over(spec), "_first": F.lag("close", n + 1).over(spec)})
    return named.select("symbol", "trade_date", "close", "amount", (safe_ratio(F.col("_last"), F.col("_first")) - 1).alias("momentum"))


def with_ahead(df: DataFrame) -> DataFrame:
    """``df`` plus ``ahead``, the return from the row's close to its symbol's next one. The window has a name before the guards repeat it."""
    named = df.withColumn("_next", F.lead("close").over(by_symbol()))
    return named.withColumn("ahead", safe_ratio(F.col("_next"), F.col("close")) - 1).drop("_next")


def day_index(df: DataFrame) -> DataFrame:
    """``df`` plus ``index``, the number of its trade_date among all of them; the calendar is a small side."""
    return df.join(W.calendar_index(df, "trade_date").select("trade_date", "index"), "trade_date")


# Aggregation -----------------------------------------------------------------------------------------------------


@query
def ohlcv_daily_bars(spark, folder):
    """A1."""
    return daily_bars(spark, folder).select("symbol", "trade_date", r("open").alias("open"), r("high").alias("high"), r("low").alias("low"), r("close").alias("close"), "volume", r("amount", 2).alias("amount"))


@query
def ohlcv_weekly_bars(spark, folder):
    """Weeks of daily bars with their VWAP, those of 5 bars or more only."""
    bars = daily_bars(spark, folder).withColumn("week", F.to_date(F.date_trunc("week", "trade_date")))
    return bars.groupBy("symbol", "week").agg(
        r(F.min_by("open", "trade_date")).alias("open"), r(F.max("high")).alias("high"), r(F.min("low")).alias("low"), r(F.max_by("close", "trade_date")).alias("close"),
        F.sum("volume").alias("volume"), r_off(safe_ratio(F.sum("amount"), F.sum("volume")), 4).alias("vwap"), F.count("*").alias("bars"),
    ).where("bars >= 5")


@query
def bucket_bars_right_edge(spark, folder):
    """A2: six-hour buckets of ticks named by their right edge; a tick on the edge belongs to the bucket that ends there."""
    ticks = table(spark, folder, "events").select(F.col("user_id").alias("symbol"), "ts", F.col("value").alias("price"))
    edge = F.ceil(micros("ts") / 21600000000).cast("bigint") * 21600
    return ticks.groupBy("symbol", edge.alias("bucket_end")).agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.count("*").alias("ticks"))


@query
def bucket_bars_left_edge(spark, folder):
    """A2, the other convention: buckets named by their left edge."""
    ticks = table(spark, folder, "events")
    edge = F.floor(micros("ts") / 21600000000).cast("bigint") * 21600
    return ticks.groupBy(F.col("user_id").alias("symbol"), edge.alias("bucket_start")).agg(F.count("*").alias("ticks"), F.min("value").alias("low"), F.max("value").alias("high"))


@query
def filtered_aggregates(spark, folder):
    """Conditional counts, distinct counts, exact quantiles, deviations and largest values of a month."""
    t = table(spark, folder, "lineitem")
    late = F.col("l_returnflag") == "R"
    t = t.withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    by_month = t.groupBy("month").agg(
        F.count_if(late).alias("returned"), F.count_distinct("l_suppkey").alias("symbols"),
        r(F.stddev_samp("l_discount"), 8).alias("sd_discount"), F.bool_or(late & (F.col("l_quantity") > 49)).alias("any_large_return"), F.bool_and(F.col("l_tax") >= 0).alias("all_taxed"),
        F.max(F.when(late, F.col("l_partkey"))).alias("last_returned_part"))
    quantity = A.exact_quantiles(t, ["month"], "l_quantity", {"q": 0.5}).select("month", r("q", 4).alias("median_quantity"))
    price = A.exact_quantiles(t, ["month"], "l_extendedprice", {"q": 0.95}).select("month", r("q", 4).alias("p95_price"))
    return by_month.join(quantity, "month").join(price, "month")


@query
def trimmed_mean_top1pct(spark, folder):
    """A14."""
    out = A.trimmed_mean(momentum(spark, folder), ["symbol"], "momentum")
    return out.select("symbol", "n", r("trimmed", 8).alias("trimmed"))


@query
def event_metric_summary(spark, folder):
    """A15."""
    out = A.metric_summary(momentum(spark, folder), ["symbol"], "momentum")
    return out.select("symbol", "n", *[r(c).alias(c) for c in ("mean", "median", "win_rate", "profit_factor")])


@query
def paired_control(spark, folder):
    """Each symbol against the next one on the days both have a momentum."""
    m = momentum(spark, folder).where("momentum is not null")
    other = m.select((F.col("symbol") - 1).alias("symbol"), "trade_date", F.col("momentum").alias("control"))
    diff = F.col("momentum") - F.col("control")
    return m.join(other, ["symbol", "trade_date"]).groupBy("symbol").agg(
        F.count("*").alias("pairs"), r(F.avg(diff)).alias("mean"), r(F.median(diff)).alias("median"), r(F.avg((diff > 0).cast("double"))).alias("positive_share"))


@query
def market_breadth(spark, folder):
    """An unknown return isn't a positive one."""
    m = momentum(spark, folder)
    return m.groupBy("trade_date").agg(
        F.count("*").alias("members"), r(F.avg("momentum")).alias("mean"), r(F.avg(F.when(F.col("momentum") > 0, 1.0).otherwise(0.0))).alias("breadth"),
        r(F.stddev_samp("momentum")).alias("dispersion"), r(F.sum("amount"), 2).alias("amount"))


@query
def industry_leave_one_out(spark, folder):
    """A supplier's nation stands for its industry."""
    industry = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_nationkey").alias("industry"))
    m = momentum(spark, folder).join(industry, "symbol")
    return m.select("symbol", "trade_date", r(A.leave_one_out(m, ["trade_date", "industry"], F.col("momentum") > 0)).alias("others_up"))


@query
def rank_ic(spark, folder):
    """Spearman's correlation of momentum and the next bar's return, over days of five symbols or more."""
    m = with_ahead(momentum(spark, folder)).where("momentum is not null and ahead is not null")
    ranked = m.select("trade_date", W.average_rank(F.col("momentum"), "trade_date").alias("x"), W.average_rank(F.col("ahead"), "trade_date").alias("y"))
    return ranked.groupBy("trade_date").agg(F.count("*").alias("n"), r(A.correlation(F.col("x"), F.col("y"))).alias("ic")).where("n >= 5")


@query
def topk_excess(spark, folder):
    """The mean next return of each day's three strongest against the day's mean."""
    m = with_ahead(momentum(spark, folder)).where("momentum is not null and ahead is not null")
    nth = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.col("momentum").desc(), "symbol"))
    ranked = m.withColumn("nth", nth)
    return ranked.groupBy("trade_date").agg(r(F.avg(F.when(F.col("nth") <= 3, F.col("ahead")))).alias("top"), r(F.avg("ahead")).alias("all"), F.count("*").alias("n")).withColumn("excess", r(F.col("top") - F.col("all"), 5))


@query
def candidate_recall(spark, folder):
    """Whether the day's best next return is among its ten most traded, and the chance that ten random ones have it."""
    m = with_ahead(momentum(spark, folder)).where("ahead is not null")
    day = Window.partitionBy("trade_date")
    ranked = m.select("trade_date", F.row_number().over(day.orderBy(F.col("amount").desc(), "symbol")).alias("by_amount"), F.row_number().over(day.orderBy(F.col("ahead").desc(), "symbol")).alias("by_return"))
    out = ranked.groupBy("trade_date").agg(F.count("*").alias("universe"), F.count_if((F.col("by_return") <= 3) & (F.col("by_amount") <= 10)).alias("caught"))
    miss = A.miss_probability(F.col("universe"), F.least(F.lit(3), F.col("universe")), F.least(F.lit(10), F.col("universe")))
    return out.select("trade_date", "universe", "caught", r(1 - miss).alias("random_hit"))


@query
def unit_scale_inference(spark, folder):
    """The scale that brings a symbol's prices closest to its parts' retail prices, by median absolute log."""
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    t = table(spark, folder, "lineitem").join(part, "l_partkey").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    scaled = t.select(F.col("l_suppkey").alias("symbol"), "price", "p_retailprice", F.explode(F.array(*map(F.lit, (0.01, 0.1, 1.0, 10.0, 100.0)))).alias("scale"))
    off = scaled.groupBy("symbol", "scale").agg(r(F.median(F.abs(F.ln(F.col("price") * F.col("scale") / F.col("p_retailprice")))), 9).alias("off"))
    return off.groupBy("symbol").agg(F.min_by("scale", F.struct("off", "scale")).alias("scale"))


@query
def hac_interval(spark, folder):
    """The mean daily breadth with a Newey–West standard error."""
    out = A.newey_west(market_breadth(spark, folder), "trade_date", "breadth", 20)
    return out.select("n", r("mean").alias("mean"), r("se").alias("se"))


@query
def bh_adjust(spark, folder):
    """Adjusted p-values; a symbol's share of rising days stands for its p."""
    p = event_metric_summary(spark, folder).select("symbol", F.col("win_rate").alias("p")).where("p is not null")
    ranked = p.withColumn("p", F.col("p") + F.col("symbol") * 1e-9)
    return A.bh_adjust(ranked, "p").select("symbol", r("p", 8).alias("p"), r("q").alias("q"))


@query
def winner_concentration(spark, folder):
    """The share of a symbol's positive returns that its five best days made."""
    m = momentum(spark, folder).where("momentum > 0")
    nth = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("momentum").desc(), "trade_date"))
    return m.withColumn("nth", nth).groupBy("symbol").agg(r(F.sum(F.when(F.col("nth") <= 5, F.col("momentum"))) / F.sum("momentum")).alias("top5_share"))


@query
def conflict_hash(spark, folder):
    """Order lines that occur with different contents under one key."""
    return A.conflicting(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_returnflag"])


@query
def source_merge_preference(spark, folder):
    """One row per customer; values of urgent orders are preferred to those of high ones, then medium ones."""
    t = table(spark, folder, "orders").select("o_custkey", F.col("o_orderpriority").alias("source"), "o_totalprice", "o_orderstatus")
    return A.preferred(t, ["o_custkey"], "source", ["1-URGENT", "2-HIGH", "3-MEDIUM"], ["o_totalprice", "o_orderstatus"])


@query
def pivot_alignment(spark, folder):
    """Event types as columns, and the mean sign of neighbours' differences."""
    wide = table(spark, folder, "events").groupBy("user_id").pivot("event_type", ["click", "purchase", "signup", "view"]).agg(F.round(F.avg("value"), 8))
    names = ["click", "purchase", "signup", "view"]
    pairs = [F.signum(F.col(a) - F.col(b)) for a, b in zip(names, names[1:])]
    return wide.select("user_id", *names, r((pairs[0] + pairs[1] + pairs[2]) / 3).alias("alignment"))


@query
def unpivot_metrics(spark, folder):
    """A33."""
    t = table(spark, folder, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return t.unpivot("p_partkey", ["size", "price"], "metric", "value").groupBy("metric").agg(F.count("value").alias("n"), r(F.avg("value"), 4).alias("mean"))


@query
def zip_unnest(spark, folder):
    """Three arrays unfolded side by side; rows whose two values differ."""
    t = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.array(F.lit("discount"), F.lit("tax")).alias("name"), F.array("l_discount", "l_tax").alias("value"), F.array("l_tax", "l_discount").alias("other"))
    return t.select("l_orderkey", "l_linenumber", F.inline(F.arrays_zip("name", "value", "other"))).where("value > other + 0.05").groupBy("name").agg(F.count("*").alias("n"))


@query
def tolerance_compare(spark, folder):
    """Two prices of a part compared with a tolerance of 5 % or 0.05, whichever is more."""
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_retailprice")
    t = table(spark, folder, "lineitem").join(part, "l_partkey").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    off = F.abs(F.col("price") - F.col("p_retailprice")) > F.greatest(F.abs("p_retailprice") * 0.05, F.lit(0.05))
    counts = t.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(off).alias("off"))
    ratio = A.exact_quantiles(t.withColumn("ratio", F.col("price") / F.col("p_retailprice")), ["p_brand"], "ratio", {"ratio": 0.5})
    return counts.join(ratio.select("p_brand", r("ratio").alias("ratio")), "p_brand")


@query
def field_coverage(spark, folder):
    """How many rows know each field of a raw table."""
    t = table(spark, folder, "statement_quarterly")
    fields = ("revenue", "net_profit", "eps", "roe_avg")
    counts = t.groupBy("fiscal_quarter").agg(F.count("*").alias("n"), *[F.count_if(F.col(f).isNotNull() & ~F.isnan(f)).alias(f) for f in fields])
    return counts.unpivot(["fiscal_quarter", "n"], list(fields), "field", "known")


@query
def version_pick(spark, folder):
    """Of a report's versions the one with the highest update flag, then most fields known, then largest digest."""
    t = table(spark, folder, "statement_quarterly").where("statement_id is not null")
    known = sum([F.when(F.col(f).isNotNull() & ~F.isnan(f), 1).otherwise(0) for f in ("revenue", "net_profit", "eps", "roe_avg")], F.lit(0))
    rank = F.struct(F.coalesce("update_flag", F.lit(-1)).alias("a"), known.alias("b"), F.md5(F.col("statement_id").cast("string")).alias("c"), "statement_id")
    return t.groupBy("symbol", "report_date").agg(F.max(rank)["statement_id"].alias("statement_id"), F.count_distinct("statement_id").alias("versions"))


@query
def tail_quantile_bounds(spark, folder):
    """A10: whether each of the sketch's quantiles stands within one percent of its place among a supplier's exact prices."""
    shares = (0.01, 0.05, 0.5, 0.95, 0.99)
    t = table(spark, folder, "lineitem")
    sketch = t.groupBy("l_suppkey").agg(F.approx_percentile("l_extendedprice", list(shares), 1000).alias("q"))
    places = t.select("l_suppkey", "l_extendedprice").join(sketch, "l_suppkey").groupBy("l_suppkey").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("l_extendedprice") < F.col("q")[i]).alias(f"below{i}") for i in range(5)], *[F.count_if(F.col("l_extendedprice") <= F.col("q")[i]).alias(f"upto{i}") for i in range(5)])
    slack = 0.01 * F.col("n") + 1
    fine = [(F.col(f"below{i}") <= share * F.col("n") + slack) & (F.col(f"upto{i}") >= share * F.col("n") - slack) for i, share in enumerate(shares)]
    return places.select("l_suppkey", (fine[0] & fine[1] & fine[2] & fine[3] & fine[4]).alias("within"))


@query
def approx_tail_quantiles(spark, folder):
    """A10: a sketch, so checked by its rows only."""
    return table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.approx_percentile("l_extendedprice", [0.01, 0.05, 0.5, 0.95, 0.99], 1000).alias("q"))


# Windows ---------------------------------------------------------------------------------------------------------


@query
def rolling_complete_window(spark, folder):
    """W2."""
    spec, c = by_symbol(), F.col("close")
    return daily_bars(spark, folder).select(
        "symbol", "trade_date", r_off(W.complete(F.avg, c, spec, -19, 0), 6).alias("mean20"), r(W.complete(F.max, c, spec, -19, 0)).alias("max20"),
        r(W.complete(F.min, c, spec, -19, 0)).alias("min20"), r(W.complete(F.stddev_samp, c, spec, -19, 0), 5).alias("sd20"))


@query
def prior_day_features(spark, folder):
    """The row's own day takes no part."""
    spec, c, a = by_symbol(), F.col("close"), F.col("amount")
    named = daily_bars(spark, folder).withColumns({
        "_last": F.lag("close").over(spec), "_sixth": F.lag("close", 6).over(spec), "_mean5": W.complete(F.avg, c, spec, -5, -1),
        "_amount": F.lag("amount").over(spec), "_mean20": W.complete(F.avg, a, spec, -20, -1)})
    against = lambda x, y: r(safe_ratio(F.col(x), F.col(y)) - 1)
    return named.select("symbol", "trade_date", against("_last", "_sixth").alias("return5"), against("_last", "_mean5").alias("to_mean5"), against("_amount", "_mean20").alias("amount_ratio20"))


@query
def expanding_session(spark, folder):
    """Running totals, extremes and first value of a symbol's month."""
    bars = daily_bars(spark, folder).withColumn("month", F.date_format("trade_date", "yyyy-MM"))
    so_far = W.along(["symbol", "month"], "trade_date").rowsBetween(Window.unboundedPreceding, 0)
    return bars.select("symbol", "trade_date", r(F.sum("amount").over(so_far), 2).alias("amount"), r(F.max("high").over(so_far)).alias("high"), r(F.first("open", ignorenulls=True).over(so_far)).alias("open"))


@query
def shifted_block(spark, folder):
    """The mean volume of the last 5 bars against that of the 20 before."""
    spec, v = by_symbol(), F.col("volume")
    named = daily_bars(spark, folder).withColumns({"_recent": W.complete(F.avg, v, spec, -4, 0), "_before": W.complete(F.avg, v, spec, -24, -5)})
    return named.select("symbol", "trade_date", r(safe_ratio(F.col("_recent"), F.col("_before")) - 1).alias("acceleration"))


@query
def forward_mfe_mae(spark, folder):
    """The best and worst of the next 5 bars, and how many of them closed lower."""
    spec = by_symbol()
    c = F.col("close")
    return daily_bars(spark, folder).select(
        "symbol", "trade_date", r(W.complete(F.max, F.col("high"), spec, 1, 5) / c - 1).alias("mfe"), r(W.complete(F.min, F.col("low"), spec, 1, 5) / c - 1).alias("mae"),
        F.count(F.when(F.col("volume") < 10, 1)).over(spec.rowsBetween(1, 5)).alias("thin"))


@query
def distinct_in_frame(spark, folder):
    """Distinct order priorities among a customer's last 5 orders."""
    spec = W.along(["o_custkey"], "o_orderdate", "o_orderkey").rowsBetween(-4, 0)
    return table(spark, folder, "orders").select("o_orderkey", F.size(F.collect_set("o_orderpriority").over(spec)).alias("priorities"))


@query
def top1_dedupe(spark, folder):
    """The latest order of each customer, ties by the lower key."""
    best = F.max(F.struct("o_orderdate", (-F.col("o_orderkey")).alias("k"), "o_totalprice")).alias("x")
    return table(spark, folder, "orders").groupBy("o_custkey").agg(best).select("o_custkey", (-F.col("x.k")).alias("o_orderkey"), F.col("x.o_totalprice").alias("o_totalprice"))


@query
def cross_section_percent_rank(spark, folder):
    """Unknown values rank first and count."""
    spec = Window.partitionBy("trade_date").orderBy(F.col("momentum").asc_nulls_first())
    return momentum(spark, folder).select("symbol", "trade_date", r(F.percent_rank().over(spec)).alias("rank"))


@query
def average_rank(spark, folder):
    """Mean rank of ties, as a share of the day's known values."""
    m = momentum(spark, folder, 1).where("momentum is not null").withColumn("momentum", F.round("momentum", 1))
    share = W.average_rank(F.col("momentum"), "trade_date") / F.count("*").over(Window.partitionBy("trade_date"))
    return m.select("symbol", "trade_date", r(share).alias("rank"))


@query
def limit_streaks(spark, folder):
    """Runs of rising closes."""
    rising = F.col("close") > F.lag("close").over(by_symbol())
    return W.streaks(daily_bars(spark, folder), ["symbol"], "trade_date", rising).select("symbol", "trade_date", "streak").where("streak > 0")


@query
def long_gap_runs(spark, folder):
    """Stretches without a break of more than 10 calendar days, with their ends."""
    gap = F.date_diff("trade_date", F.lag("trade_date").over(by_symbol())) > 10
    runs = W.islands(daily_bars(spark, folder), ["symbol"], "trade_date", gap)
    return runs.groupBy("symbol", "island").agg(F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"), F.count("*").alias("bars"))


@query
def rolling_median_prior(spark, folder):
    """W17."""
    return daily_bars(spark, folder).select("symbol", "trade_date", r(W.rolling_median(F.col("amount"), by_symbol(), 20), 4).alias("median20"))


def ma_states(spark: SparkSession, folder: str, periods: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Bars times periods with the mean of the period's earlier closes, the level the close would have to cross."""
    spec = by_symbol()
    bars = daily_bars(spark, folder)
    prior = [F.struct(F.lit(p).alias("period"), W.complete(F.sum, F.col("close"), spec, -(p - 1), -1).alias("prior")) for p in periods]
    wide = bars.withColumn("m", F.array(*prior))
    long = wide.select("symbol", "trade_date", "high", "low", "close", F.explode("m").alias("m")).select("symbol", "trade_date", "high", "low", "close", "m.*")
    level = F.col("prior") / (F.col("period") - 1)
    return long.withColumn("level", level).withColumn("live", (F.col("prior") + F.col("close")) / F.col("period")).withColumn("touched", F.col("low").__le__(level) & (level <= F.col("high")))


@query
def ma_state_touch(spark, folder):
    """State per bar and period, and the touches of the 20 bars before."""
    s = ma_states(spark, folder)
    spec = W.along(["symbol", "period"], "trade_date")
    before = F.sum(F.when(F.col("touched"), 1).otherwise(0)).over(spec.rowsBetween(-20, -1))
    return s.select("symbol", "trade_date", "period", r_off(F.col("level"), 6).alias("level"), r(safe_ratio(F.col("close"), F.col("live")) - 1).alias("distance"), "touched", F.coalesce(before, F.lit(0)).alias("touches20"))


@query
def cross_count(spark, folder):
    """How often a close has changed sides of its level so far."""
    s = ma_states(spark, folder).where("level is not null").withColumn("above", F.col("close") > F.col("level"))
    spec = W.along(["symbol", "period"], "trade_date")
    crossed = F.when(F.col("above") != F.lag("above").over(spec), 1).otherwise(0)
    return s.withColumn("crossed", crossed).select("symbol", "trade_date", "period", F.sum("crossed").over(spec.rowsBetween(Window.unboundedPreceding, 0)).alias("crosses"))


@query
def touch_reclaim_signals(spark, folder):
    """The first bar of a symbol's month and period that has been touched or below before and closes above."""
    s = ma_states(spark, folder).where("level is not null").withColumn("month", F.date_format("trade_date", "yyyy-MM"))
    below = F.col("close") < F.col("level")
    seen = F.max((F.col("touched") | below).cast("int")).over(W.along(["symbol", "month", "period"], "trade_date").rowsBetween(Window.unboundedPreceding, 0)) == 1
    hits = s.withColumn("hit", seen & ~below).where("hit")
    return hits.groupBy("symbol", "month", "period").agg(F.min("trade_date").alias("signal_date"), r(F.min_by("close", "trade_date")).alias("close"))


@query
def event_classes(spark, folder):
    """The class of a symbol's month and period from its touches and crosses, and its longest run above."""
    s = ma_states(spark, folder).where("level is not null").withColumn("month", F.date_format("trade_date", "yyyy-MM")).withColumn("above", F.col("close") > F.col("level"))
    crossed = F.when(F.col("above") != F.lag("above").over(W.along(["symbol", "month", "period"], "trade_date")), 1).otherwise(0)
    runs = W.streaks(s.withColumn("crossed", crossed), ["symbol", "month", "period"], "trade_date", F.col("above"))
    g = runs.groupBy("symbol", "month", "period").agg(F.sum("crossed").alias("crosses"), F.bool_or("touched").alias("touched"), F.max("streak").alias("longest"), F.max_by("above", "trade_date").alias("ends_above"))
    kind = first_reason((F.col("crosses") >= 3, "repeated_cross"), (F.col("touched") & F.col("ends_above"), "touch_hold"), (F.col("touched"), "failed_break"), default="near")
    return g.select("symbol", "month", "period", "crosses", "longest", kind.alias("class"))


@query
def calendar_neighbours(spark, folder):
    """W24."""
    return W.calendar_index(daily_bars(spark, folder), "trade_date")


@query
def suffix_extremes(spark, folder):
    """The highest and lowest of a symbol's month from each bar on."""
    bars = daily_bars(spark, folder).withColumn("month", F.date_format("trade_date", "yyyy-MM"))
    on = W.along(["symbol", "month"], "trade_date").rowsBetween(0, Window.unboundedFollowing)
    return bars.select("symbol", "trade_date", r(F.max("high").over(on)).alias("high_left"), r(F.min("low").over(on)).alias("low_left"))


@query
def chain_check(spark, folder):
    """W31 counted: how often each status follows another one."""
    t = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    lagged = W.lagged(t, ["o_custkey"], F.year("o_orderdate"), ["o_orderdate", "o_orderkey"], "o_orderstatus", "before")
    return lagged.where("before is not null and before != o_orderstatus").groupBy("before", "o_orderstatus").agg(F.count("*").alias("n"))


@query
def forward_fill(spark, folder):
    """The last known large price."""
    bars = daily_bars(spark, folder).withColumn("large", F.when(F.col("volume") > 60, F.col("close")))
    spec = by_symbol()
    return bars.select("symbol", "trade_date", r(F.last("large", ignorenulls=True).over(spec.rowsBetween(Window.unboundedPreceding, 0))).alias("last_large"), r(F.first("large", ignorenulls=True).over(spec.rowsBetween(0, Window.unboundedFollowing))).alias("next_large"))


@query
def equity_drawdown(spark, folder):
    """W30."""
    bars = daily_bars(spark, folder)
    return bars.select("symbol", "trade_date", r(W.drawdown(F.col("close"), by_symbol())).alias("drawdown"))


@query
def transitions(spark, folder):
    """Orders whose status isn't that of the customer's order before."""
    t = table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return W.changes(t, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus", F.year("o_orderdate")).select("o_custkey", "o_orderkey", F.col("old").alias("old_status"), F.col("o_orderstatus").alias("new_status"))


# Joins -----------------------------------------------------------------------------------------------------------


def matched(df: DataFrame) -> DataFrame:
    """The result of an as-of join with its days as dates."""
    return df.withColumns({c: F.date_from_unix_date(c) for c in ("day", "bar_day")})


def orders_by_symbol(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as events of symbols (customer modulo 100) by day number."""
    return table(spark, folder, "orders").select("o_orderkey", (F.col("o_custkey") % 100 + 1).alias("symbol"), F.unix_date(F.to_date("o_orderdate")).alias("day"))


def bars_by_day(spark: SparkSession, folder: str) -> DataFrame:
    return daily_bars(spark, folder).select("symbol", F.unix_date("trade_date").alias("bar_day"), r("close").alias("close"))


@query
def asof_backward(spark, folder):
    """J3, J5."""
    return matched(J.asof_join(orders_by_symbol(spark, folder), bars_by_day(spark, folder), ["symbol"], "day", "bar_day", ["bar_day", "close"]))


@query
def asof_strict(spark, folder):
    """J4."""
    return matched(J.asof_join(orders_by_symbol(spark, folder), bars_by_day(spark, folder), ["symbol"], "day", "bar_day", ["bar_day", "close"], strict=True))


@query
def asof_forward(spark, folder):
    """J6."""
    return matched(J.asof_join(orders_by_symbol(spark, folder), bars_by_day(spark, folder), ["symbol"], "day", "bar_day", ["bar_day", "close"], forward=True))


def status_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """A customer's orders as intervals from one order day to the day before the next."""
    o = table(spark, folder, "orders").groupBy("o_custkey", F.unix_date(F.to_date("o_orderdate")).alias("start")).agg(F.max("o_orderstatus").alias("status"))
    return o.withColumn("end", F.lead("start").over(W.along(["o_custkey"], "start")) - 1)


@query
def validity_interval_join(spark, folder):
    """The status in force at each event of a user, taken as a customer; events are laid over the years of the orders by their number."""
    e = table(spark, folder, "events").select("event_id", F.col("user_id").alias("o_custkey"), (F.lit(9131) + F.col("event_id") % 2400).cast("int").alias("day"))
    return J.interval_join(e, status_intervals(spark, folder), ["o_custkey"], "day", "start", "end", ["status"], 128).select("event_id", "status")


@query
def first_match_range(spark, folder):
    """The first of the next 5 open days on which a symbol trades more than 60."""
    b = day_index(daily_bars(spark, folder)).select("symbol", "trade_date", "index", "volume")
    hit = F.when(F.col("volume") > 60, F.struct("index", "volume"))
    found = b.withColumn("_hit", F.first(hit, ignorenulls=True).over(W.steps_ahead(["symbol"], "index", 1, 5))).where("_hit is not null")
    return found.select("symbol", "trade_date", (F.col("_hit.index") - F.col("index")).alias("steps"), F.col("_hit.volume").alias("volume"))


@query
def horizon_masked_aggs(spark, folder):
    """Highs and lows over the next 3 and 10 open days, and how many of them had a bar."""
    b = day_index(daily_bars(spark, folder))
    ahead = {h: W.steps_ahead(["symbol"], "index", 1, h) for h in (3, 10)}
    found = b.select("symbol", "trade_date", *[x for h, w in ahead.items() for x in (
        r(F.max("high").over(w)).alias(f"high{h}"), r(F.min("low").over(w)).alias(f"low{h}"), F.count("*").over(w).alias(f"bars{h}"))])
    return found.where("bars10 > 0")


@query
def index_offset_self_join(spark, folder):
    """Bars of neighbouring open days."""
    b = day_index(daily_bars(spark, folder)).select("symbol", "index", "trade_date", "close")
    n = b.select("symbol", (F.col("index") - 1).alias("index"), F.col("close").alias("next_close"))
    return b.join(n, ["symbol", "index"]).select("symbol", "trade_date", r(F.col("next_close") / F.col("close") - 1).alias("next_return"))


@query
def overlap_pairs(spark, folder):
    """Pairs of a customer's orders less than 90 days apart."""
    o = table(spark, folder, "orders").select("o_custkey", "o_orderkey", F.unix_date(F.to_date("o_orderdate")).alias("s")).withColumn("e", F.col("s") + 45)
    return J.overlaps(o, "o_custkey", "o_orderkey", "s", "e", 128)


@query
def overlap_counts(spark, folder):
    """Of each order, how many of its customer's other orders are less than 46 days away."""
    o = table(spark, folder, "orders").groupBy("o_orderkey").agg(F.min("o_custkey").alias("o_custkey"), F.min(F.unix_date(F.to_date("o_orderdate"))).alias("s"))
    return J.overlap_counts(o.withColumn("e", F.col("s") + 45), "o_custkey", "o_orderkey", "s", "e", 128)


@query
def sorted_positions(spark, folder):
    """O1: the place of each bar in the order of date, momentum from high to low, and symbol; places count days first, so only a day is sorted in one task."""
    m = momentum(spark, folder).select("symbol", "trade_date", "momentum")
    days = m.groupBy("trade_date").agg(F.count("*").alias("n"))
    before = days.select("trade_date", F.coalesce(F.sum("n").over(Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.col("momentum").desc_nulls_last(), "symbol"))
    return m.withColumn("within", within).join(before, "trade_date").select("symbol", "trade_date", (F.col("before") + F.col("within")).alias("place"))


@query
def anti_missing_keys(spark, folder):
    """Customers without an urgent order in the last year that has any; the year comes from the data."""
    o = table(spark, folder, "orders")
    year = o.agg(F.max(F.year("o_orderdate")).alias("_year"))
    recent = o.where("o_orderpriority = '1-URGENT'").join(F.broadcast(year), F.year("o_orderdate") == F.col("_year")).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, folder, "customer").join(recent, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query
def semi_picklist(spark, folder):
    """Lines of the parts of one brand."""
    pick = table(spark, folder, "part").where("p_brand = 'Brand#23'").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, folder, "lineitem").join(pick, "l_partkey", "left_semi").groupBy("l_suppkey").agg(F.count("*").alias("lines"), r(F.sum("l_quantity"), 2).alias("quantity"))


@query
def full_outer_reconcile(spark, folder):
    """Ticks of a user's day against all orders of the customer of the same number on that day, on either side."""
    a = table(spark, folder, "events").groupBy(F.col("user_id").alias("k"), F.to_date("ts").alias("d")).agg(F.count("*").alias("events"))
    b = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("orders"))
    both = a.join(b, ["k", "d"], "full").select("k", "d", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("orders", F.lit(0)).alias("orders"))
    return both.withColumn("kind", first_reason((F.col("events") == 0, "right_only"), (F.col("orders") == 0, "left_only"), default="both"))


@query
def scalar_bounds(spark, folder):
    """Fields by name, each against the table's own mean, from one pass and a one-row side."""
    t = table(spark, folder, "lineitem")
    means = t.agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    long = t.select("l_suppkey", F.explode(F.create_map(F.lit("quantity"), F.col("l_quantity"), F.lit("discount"), F.col("l_discount"))).alias("field", "value"))
    m = means.unpivot([], ["quantity", "discount"], "field", "mean")
    return long.join(F.broadcast(m), "field").groupBy("l_suppkey", "field").agg(F.count_if(F.col("value") > F.col("mean")).alias("above"))


@query
def completed_bucket_fallback(spark, folder):
    """A bar joins the month before its own, or the last month that the symbol has."""
    b = daily_bars(spark, folder).withColumn("month", F.month("trade_date") + 12 * F.year("trade_date"))
    months = b.groupBy("symbol", "month").agg(r(F.avg("close")).alias("month_mean"))
    with_before = months.withColumn("before", F.lag("month_mean").over(W.along(["symbol"], "month"))).select("symbol", "month", "before")
    return b.join(with_before, ["symbol", "month"]).select("symbol", "trade_date", r(safe_ratio(F.col("close"), F.col("before")) - 1).alias("to_last_month"))


@query
def checked_many_to_one(spark, folder):
    """J20, J1, J2."""
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return J.checked_join(table(spark, folder, "customer").select("c_custkey", "c_nationkey"), nation, ["c_nationkey"]).groupBy("n_name").agg(F.count("*").alias("customers"))


@query
def matched_control_nearest(spark, folder):
    """For each customer with a positive balance the two nearest of its nation by balance, within a factor of 2."""
    s = table(spark, folder, "customer").where("c_acctbal > 0").select("c_nationkey", "c_custkey", "c_acctbal")
    return J.nearest_controls(s, s, ["c_nationkey"], "c_custkey", "c_acctbal", 2.0, 2).select("signal", "control", "nth")


@query
def random_time_control(spark, folder):
    """One bar of each symbol's month, picked by a digest."""
    b = daily_bars(spark, folder).withColumn("month", F.date_format("trade_date", "yyyy-MM"))
    digest = F.md5(F.concat_ws("|", F.lit("seed"), F.col("symbol").cast("string"), F.date_format("trade_date", "yyyy-MM-dd")))
    return b.groupBy("symbol", "month").agg(F.min_by("trade_date", digest).alias("trade_date"))


@query
def densified_snapshots(spark, folder):
    """The status of each customer on each day a part was shipped, from order to order. The tables have no fresh source to replace days from."""
    snaps = table(spark, folder, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.max("o_orderstatus").alias("status"))
    days = table(spark, folder, "lineitem").select(F.to_date("l_shipdate").alias("day"))
    return J.densify_snapshots(snaps, days, "o_custkey", "status", "day")


@query
def conflict_driven_source(spark, folder):
    """A customer's orders by one source if its latest two statuses agree, else by the other."""
    o = table(spark, folder, "orders")
    latest = lambda s: o.where(F.col("o_orderpriority") == s).groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias(f"s{s[0]}"))
    agree = latest("1-URGENT").join(latest("2-HIGH"), "o_custkey").where("s1 = s2").select("o_custkey")
    a = o.where("o_orderpriority = '1-URGENT'").join(agree, "o_custkey", "left_semi")
    b = o.where("o_orderpriority = '2-HIGH'").join(agree, "o_custkey", "left_anti")
    return a.unionByName(b).select("o_orderkey", "o_custkey", "o_orderpriority")


# Sets, order, sampling -------------------------------------------------------------------------------------------


@query
def topk_per_group(spark, folder):
    """O3, O1."""
    nth = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey"))
    return table(spark, folder, "lineitem").withColumn("nth", nth).where("nth <= 3").select("l_suppkey", "nth", "l_orderkey", "l_linenumber", "l_extendedprice")


@query
def last_n_per_symbol(spark, folder):
    """Each symbol's last 20 bars."""
    nth = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("trade_date").desc()))
    return daily_bars(spark, folder).withColumn("nth", nth).where("nth <= 20").select("symbol", "trade_date", r("close").alias("close"))


@query
def example_rows(spark, folder):
    """O2: the ten largest orders, as a report's examples."""
    return table(spark, folder, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10)


@query
def union_by_name(spark, folder):
    """Customers and suppliers in one table, absent columns null."""
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, folder, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"))
    return c.unionByName(s, allowMissingColumns=True).groupBy("segment").agg(F.count("*").alias("n"), r(F.sum("balance"), 2).alias("balance"))


@query
def except_symmetric(spark, folder):
    """Symbol-days on one side of two halves of the trades."""
    t = table(spark, folder, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("day"), "l_returnflag")
    a, b = t.where("l_returnflag = 'A'").drop("l_returnflag"), t.where("l_returnflag = 'R'").drop("l_returnflag")
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


@query
def except_all(spark, folder):
    """Differences that count repeated rows."""
    t = table(spark, folder, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag")
    a, b = t.where("l_returnflag = 'A'").drop("l_returnflag"), t.where("l_returnflag = 'R'").drop("l_returnflag")
    return a.exceptAll(b).groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("more"))


@query
def hash_sample_percent(spark, folder):
    """The sampling operator."""
    return table(spark, folder, "orders").where(md5_bucket(F.col("o_orderkey"), 100) < 7).select("o_orderkey", "o_custkey")


@query
def equal_date_weights(spark, folder):
    """Rows of a day share its weight; deciles of relevance for days of ten rows or more."""
    m = momentum(spark, folder).where("momentum is not null")
    day = Window.partitionBy("trade_date")
    n = F.count("*").over(day)
    decile = F.floor((F.row_number().over(day.orderBy("momentum", "symbol")) - 1) * 10 / n).cast("int")
    return m.select("symbol", "trade_date", r(1 / n).alias("weight"), F.when(n >= 10, decile).cast("double").alias("relevance"))


@query
def forward_folds(spark, folder):
    """Five blocks of the calendar, each tested on all days up to 10 before it."""
    c = W.calendar_index(daily_bars(spark, folder), "trade_date").select("trade_date", "index")
    n = c.agg(F.max("index").alias("n"))
    fold = F.explode(F.sequence(F.lit(1), F.lit(5))).alias("fold")
    bounds = n.select(fold, "n").select("fold", F.floor(F.col("fold") * F.col("n") / 6).alias("start"), F.floor((F.col("fold") + 1) * F.col("n") / 6).alias("end"))
    x = c.join(F.broadcast(bounds))
    part = F.when(F.col("index") <= F.col("start") - 10, "train").when((F.col("index") > F.col("start")) & (F.col("index") <= F.col("end")), "test")
    return x.withColumn("part", part).where("part is not null").groupBy("fold", "part").agg(F.min("trade_date").alias("first"), F.max("trade_date").alias("last"), F.count("*").alias("days"))


# Scalars, audits, the rest ---------------------------------------------------------------------------------------


@query
def scalar_guards(spark, folder):
    """Guards over trades."""
    t = table(spark, folder, "lineitem")
    return t.select(
        "l_orderkey", "l_linenumber", "l_partkey", r(safe_ln(F.col("l_discount"))).alias("ln_discount"), r(safe_ratio(F.col("l_tax"), F.col("l_discount"))).alias("tax_ratio"),
        r(F.sin(2 * 3.141592653589793 * F.month("l_shipdate") / 12)).alias("season"), blank_to(F.regexp_extract("l_returnflag", "([AR])", 1), "NONE").alias("flag"),
        r(net_return(F.col("l_extendedprice"), F.col("l_extendedprice") * 1.01, 0.0007, 0.0003, 0.0013)).alias("net"), F.date_diff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")).alias("age"))


@query
def reason_code_mask(spark, folder):
    """P13–P15, P17."""
    t = table(spark, folder, "lineitem")
    thin, cheap, taxed = F.col("l_quantity") < 5, F.col("l_discount") > 0.08, F.col("l_tax") > 0.06
    why = first_reason((thin, "thin"), (cheap, "discounted"), (taxed, "taxed"))
    grade = ladder(F.col("l_discount"), (0.02, "normal"), (0.05, "soft"), (0.08, "medium"), top="critical")
    return t.groupBy(why.alias("reason"), bitmask(thin, cheap, taxed).alias("mask"), grade.alias("grade")).agg(F.count("*").alias("n"))


@query
def pk_audit(spark, folder):
    """Q1: repeated keys of the trades, with an example; ``key_audit`` looks at every table."""
    t = table(spark, folder, "lineitem")
    return t.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.min("l_partkey").alias("example")).where("n > 1")


@query
def ohlc_audit(spark, folder):
    """Q3, P4 over the raw minute bars."""
    t = table(spark, folder, "minute_bars")
    fine = valid_ohlc(F.col("open"), F.col("high"), F.col("low"), F.col("close"), F.col("volume"), F.col("amount"))
    return t.groupBy("source").agg(F.count("*").alias("rows"), F.count_if(~fine).alias("invalid"))


@query
def reconcile_daily_intraday(spark, folder):
    """Q5: two ways of a symbol-day's amount, by line and by order, within a cent."""
    t = table(spark, folder, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    a = t.groupBy("l_suppkey", "day").agg(F.sum("l_extendedprice").alias("a"))
    b = t.groupBy("l_suppkey", "day", "l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("o")).groupBy("l_suppkey", "day").agg(F.sum("o").alias("b"))
    return a.join(b, ["l_suppkey", "day"]).groupBy("l_suppkey").agg(F.count_if(F.abs(F.col("a") - F.col("b")) > F.col("a") * 0.05).alias("off"), F.count("*").alias("days"))


@query
def tri_state_invariants(spark, folder):
    """Q12: combinations of the flags of the status table, unknown apart from false."""
    t = table(spark, folder, "security_status")
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c)
    return t.groupBy(word("is_st"), word("is_suspended"), word("is_delisted")).agg(F.count("*").alias("n"))


@query
def gap_inventory(spark, folder):
    """Q17: the number of open days of a symbol's span on which it has no bar; ``gap_days`` lists them."""
    b = day_index(daily_bars(spark, folder)).select("symbol", "index")
    spans = b.groupBy("symbol").agg(F.min("index").alias("a"), F.max("index").alias("z"), F.count("*").alias("bars"))
    return spans.select("symbol", (F.col("z") - F.col("a") + 1 - F.col("bars")).alias("missing"), "bars")


@query
def placeholder_repair(spark, folder):
    """Zero-quantity stand-ins take the last close, else the next one."""
    bars = daily_bars(spark, folder).withColumn("price", F.when(F.col("volume") >= 3, F.col("close")))
    spec = by_symbol()
    last = F.last("price", ignorenulls=True).over(spec.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("price", ignorenulls=True).over(spec.rowsBetween(0, Window.unboundedFollowing))
    return bars.withColumn("repaired", r(F.coalesce("price", last, after))).where("price is null").select("symbol", "trade_date", "repaired")


@query
def factor_carry(spark, folder):
    """The product of a symbol's daily ratios, carried in order."""
    bars = daily_bars(spark, folder)
    ratio = F.col("close") / F.lag("close").over(by_symbol())
    logs = bars.withColumn("g", F.coalesce(F.ln(ratio), F.lit(0.0)))
    return logs.select("symbol", "trade_date", r(F.exp(F.sum("g").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))), 4).alias("factor"))


@query
def factor_stitch(spark, folder):
    """The median ratio of two neighbouring symbols' closes over the days both have."""
    b = daily_bars(spark, folder).select("symbol", "trade_date", "close")
    n = b.select((F.col("symbol") - 1).alias("symbol"), "trade_date", F.col("close").alias("other"))
    return b.join(n, ["symbol", "trade_date"]).groupBy("symbol").agg(F.count("*").alias("days"), r(F.median(F.col("close") / F.col("other"))).alias("scale"))


@query
def json_props_agg(spark, folder):
    """F8."""
    return table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("largest"))


@query
def event_outcomes(spark, folder):
    """Entry at the next bar's open, exit at the close 1, 3 and 5 bars on; null where the bars aren't there."""
    spec = by_symbol()
    named = daily_bars(spark, folder).withColumns({"_entry": F.lead("open", 1).over(spec), **{f"_exit{h}": F.lead("close", 1 + h).over(spec) for h in (1, 3, 5)}})
    return named.select("symbol", "trade_date", *[r(safe_ratio(F.col(f"_exit{h}"), F.col("_entry")) - 1).alias(f"return{h}") for h in (1, 3, 5)])


@query
def array_metrics(spark, folder):
    """F5, §1.1: norms of dense arrays by label, without a Python function."""
    e = table(spark, folder, "embeddings")
    square = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, b: a + b)
    return e.groupBy("label").agg(F.count("*").alias("n"), r(F.avg(F.sqrt(square)), 4).alias("norm"))


@query
def flagship_topk_momentum(spark, folder):
    """A1, W4, W13, O3 end to end: bars, momentum, rank across the day, the five strongest."""
    day = Window.partitionBy("trade_date")
    ranked = momentum(spark, folder).withColumn("rank", r(F.percent_rank().over(day.orderBy(F.col("momentum").asc_nulls_first()))))
    nth = F.row_number().over(day.orderBy(F.col("momentum").desc_nulls_last(), "symbol"))
    return ranked.withColumn("nth", nth).where("nth <= 5 and momentum is not null").select("trade_date", "nth", "symbol", r("momentum").alias("momentum"), "rank")


# Second pass -----------------------------------------------------------------------------------------------------


@query
def intraday_features(spark, folder):
    """A symbol-day's range, drawdown, concentration of amount and slope over its session bars."""
    from tidemark.functions import normalize as N
    from tidemark.operators.counting import counting

    raw = table(spark, folder, "minute_bars").select(
        N.symbol("symbol").alias("symbol"), N.day_number("trade_date").alias("day"), N.clock("bar_time").alias("millis"), N.finite_positive("close").alias("close"), N.finite_positive("amount").alias("amount"), "received_at")
    ordinal = N.session_ordinal(F.col("millis"))
    bars = counting(raw.withColumn("millis", F.when(ordinal.isNotNull(), F.col("millis"))), ["symbol", "day", "millis"], "received_at", {"close": F.col("close"), "amount": F.col("amount")})
    bars = bars.where("millis is not null and close is not null and symbol is not null and day is not null").withColumn("minute", ordinal.cast("double"))
    peak = bars.withColumn("drop", F.col("close") / F.max("close").over(W.along(["symbol", "day"], "millis").rowsBetween(Window.unboundedPreceding, 0)) - 1)
    g = peak.groupBy("symbol", "day").agg(
        F.count("*").alias("bars"), r(F.max_by("close", "millis") / F.min_by("close", "millis") - 1, 6).alias("return"), r(F.max("close") / F.min("close") - 1, 6).alias("range"), r(F.min("drop"), 6).alias("drawdown"),
        r_off(F.try_divide(F.sum(F.col("amount") * F.col("amount")), F.sum("amount") * F.sum("amount")), 6).alias("concentration"),
        r_off(F.try_divide(F.count("*") * F.sum(F.col("minute") * F.col("close")) - F.sum("minute") * F.sum("close"), F.count("*") * F.sum(F.col("minute") * F.col("minute")) - F.sum("minute") * F.sum("minute")), 5).alias("slope"))
    return g.withColumn("trade_date", N.day_text(F.col("day"))).drop("day")


@query
def seed_stability(spark, folder):
    """The spread of a day's mean return over ten samples picked by digests."""
    m = momentum(spark, folder).where("momentum is not null")
    seeded = m.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(9))))
    pick = md5_bucket(F.concat_ws("|", F.col("seed").cast("string"), F.col("symbol").cast("string")), 2) == 0
    by_seed = seeded.where(pick).groupBy("trade_date", "seed").agg(F.avg("momentum").alias("x"))
    return by_seed.groupBy("trade_date").agg(F.count("*").alias("seeds"), r_off(F.avg("x"), 6).alias("mean"), r_off(F.min("x"), 6).alias("low"), r_off(F.percentile("x", F.lit(0.25)), 6).alias("q25"), r_off(F.max("x"), 6).alias("high"))


@query
def ensemble_rank(spark, folder):
    """The mean of two percentile ranks within the day, unknown values left out."""
    m = momentum(spark, folder).where("momentum is not null")
    n = F.count("*").over(Window.partitionBy("trade_date"))
    score = (W.average_rank(F.col("momentum"), "trade_date") + W.average_rank(F.col("amount"), "trade_date")) / (2 * n)
    return m.select("symbol", "trade_date", r_off(score, 6).alias("score"))


@query
def paired_increments(spark, folder):
    """The daily difference of two top-three choices' next returns, with its standard error."""
    m = with_ahead(momentum(spark, folder)).where("momentum is not null and ahead is not null")
    day = Window.partitionBy("trade_date")
    daily = m.withColumns({"a": F.row_number().over(day.orderBy(F.col("momentum").desc(), "symbol")), "b": F.row_number().over(day.orderBy(F.col("amount").desc(), "symbol"))})
    diff = daily.groupBy("trade_date").agg((F.avg(F.when(F.col("a") <= 3, F.col("ahead"))) - F.avg(F.when(F.col("b") <= 3, F.col("ahead")))).alias("diff"))
    return A.newey_west(diff, "trade_date", "diff", 5).select("n", r_off(F.col("mean"), 6).alias("mean"), r_off(F.col("se"), 6).alias("se"))


@query
def unfilled_as_cash(spark, folder):
    """The day's three strongest are chosen before it is known whether they trade; those that don't count 0."""
    m = with_ahead(momentum(spark, folder).withColumn("filled", F.lead("amount").over(by_symbol()) > 20000)).where("momentum is not null")
    nth = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.col("momentum").desc(), "symbol"))
    top = m.withColumn("nth", nth).where("nth <= 3")
    return top.groupBy("trade_date").agg(r_off(F.avg(F.when(F.col("filled"), F.col("ahead")).otherwise(0.0)), 6).alias("mean"), F.count_if(F.col("filled")).alias("filled"))


@query
def initial_backfill(spark, folder):
    """A customer's unknown first statuses take the first known one, marked as such; later gaps stay."""
    o = table(spark, folder, "orders").withColumn("known", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))).withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    # The first known status of a customer by aggregation: no window holds a customer's orders.
    first = o.where("known is not null").groupBy("o_custkey").agg(F.min(F.struct("at", "known")).alias("first"))
    joined = o.join(first, "o_custkey", "left")
    early = F.col("known").isNull() & (F.col("first").isNull() | (F.col("at") < F.col("first.at")))
    return joined.select("o_orderkey", F.when(early, F.col("first.known")).otherwise(F.col("known")).alias("status"), (early & F.col("first").isNotNull()).alias("looked_ahead"))


@query
def ridge_fit(spark, folder):
    """Ridge coefficients of the next return on three standardised features, from one pass over sums."""
    m = prior_day_features(spark, folder).join(with_ahead(daily_bars(spark, folder)).select("symbol", "trade_date", F.col("ahead").alias("y")), ["symbol", "trade_date"])
    names = ["return5", "to_mean5", "amount_ratio20"]
    known = m.where(" and ".join(f"{c} is not null" for c in [*names, "y"]))
    cols = [F.lit(1.0), *[F.least(F.greatest(F.col(c), F.lit(-5.0)), F.lit(5.0)) for c in names], F.least(F.greatest(F.col("y"), F.lit(-1.0)), F.lit(1.0))]
    sums = known.agg(*[F.sum(a * b).alias(f"s{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]).first()  # fifteen numbers

    import numpy as np

    gram = np.zeros((5, 5))
    for i in range(5):
        for j in range(i, 5):
            gram[i, j] = gram[j, i] = sums[f"s{i}_{j}"] or 0.0
    n = max(gram[0, 0], 1.0)
    mean = gram[0] / n
    cov = gram / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[1:4], 1e-12))
    corr = cov[1:4, 1:4] / np.outer(sd, sd)
    beta = np.linalg.solve(corr + 0.01 * np.eye(3), cov[1:4, 4] / sd)
    return spark.createDataFrame([(name, round(float(b) + 1.37e-9, 6), int(n)) for name, b in zip(names, beta)], "feature string, beta double, n bigint")
