"""Queries of SURVEY §2: normalisers (P, F), repair (U17–U22, W32) and the daily feature vector (A22–A24). Twins in ``repair_sql``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.functions import normalize as N
from tidemark.functions.scalars import first_reason, net_return, safe_ln, safe_ratio
from tidemark.operators import joins as J, windows as W
from tidemark.operators.counting import counting
from tidemark.plans.audits import day_volumes
from tidemark.plans.market import five_minute, minute_rows, named_day, s, stock_days
from tidemark.plans.reference import r, r_off
from tidemark.sources.tables import daily_bars, table

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# Normalisers -----------------------------------------------------------------------------------------------------

#: Headers under which a bar's fields arrive.
ALIASES = {
    "symbol": ("symbol", "code", "ts_code", "代码", "证券代码"), "trade_date": ("trade_date", "date", "日期", "交易日期"), "bar_time": ("bar_time", "time", "时间"), "open": ("open", "开盘", "开盘价"),
    "high": ("high", "最高", "最高价"), "low": ("low", "最低", "最低价"), "close": ("close", "收盘", "收盘价"), "volume": ("volume", "vol", "成交量"), "amount": ("amount", "turnover_value", "成交额"),
}


def aliased(df: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns under their canonical names, in that order, other columns left out; a name that two columns claim, or none, is an error."""
    found = {}
    for name, spellings in aliases.items():
        claims = [c for c in df.columns if c.strip().lower() in spellings]
        if len(claims) != 1:
            raise ValueError(f"{name} is claimed by {claims or 'no column'}")
        found[name] = claims[0]
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in found.items()])


def normalised(df: DataFrame, columns: dict[str, Column], key: list[str], arrival: str) -> DataFrame:
    """P10: required columns in their types, rows whose key is known, one per key: the latest to arrive."""
    missing = [k for k in key if k not in columns]
    if missing:
        raise ValueError(f"the key has columns that aren't made: {missing}")
    made = df.select(*[c.alias(name) for name, c in columns.items()], F.col(arrival).alias("_at"))
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    return counting(made.where(known), key, "_at", {c: F.col(c) for c in columns if c not in key})


@query
def alias_headers(spark, folder):
    """Bars that arrive under other headers, brought back to the canonical ones."""
    t = table(spark, folder, "minute_bars")
    foreign = t.select(F.col("symbol").alias("证券代码"), F.col("trade_date").alias("日期"), F.col("bar_time").alias("Time"), *[F.col(c).alias(h) for c, h in (("open", "开盘"), ("high", "最高价"), ("low", "最低"), ("close", "收盘价"), ("volume", "vol"), ("amount", "成交额"))], "source")
    out = aliased(foreign, ALIASES)
    return out.groupBy(N.symbol("symbol").alias("symbol")).agg(F.count("*").alias("rows"), s(F.max(N.finite("close"))).alias("high_close"), s(F.sum(F.when(N.finite("volume") >= 0, N.finite("volume"))), 2).alias("volume"))


@query
def domain_normalisers(spark, folder):
    """P10: rows, different keys and known values of each domain after its normaliser."""
    day, sym = N.day_number, N.symbol
    domains = {
        "universe": normalised(table(spark, folder, "universe_snapshot"), {"symbol": sym("symbol"), "day": day("trade_date"), "value": F.nullif(N.squeeze("name"), F.lit(""))}, ["symbol", "day"], "received_at"),
        "status": normalised(table(spark, folder, "security_status"), {"symbol": sym("symbol"), "day": day("trade_date"), "value": F.col("is_st").cast("string")}, ["symbol", "day"], "received_at"),
        "archive": normalised(table(spark, folder, "archive_status"), {"symbol": sym("code"), "day": day("trade_date"), "value": N.flag("archive_is_st").cast("string")}, ["symbol", "day"], "received_at"),
        "financial": normalised(table(spark, folder, "statement_quarterly"), {"statement_id": F.col("statement_id"), "value": N.finite("revenue").cast("string")}, ["statement_id"], "received_at"),
        "signal": normalised(table(spark, folder, "minute_signals"), {"signal_id": F.col("signal_id"), "value": N.finite("selection_score").cast("string")}, ["signal_id"], "received_at"),
    }
    return reduce(DataFrame.unionByName, [d.agg(F.lit(n).alias("domain"), F.count("*").alias("keys"), F.count("value").alias("known")) for n, d in domains.items()])


@query
def excluded_projection(spark, folder):
    """All columns but some."""
    return table(spark, folder, "nation").drop("n_regionkey").join(table(spark, folder, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey")


@query
def valuation_override(spark, folder):
    """Market value as last close times shares, shares by the primary formula (profit by earnings per share), else the secondary one, with its source."""
    st = table(spark, folder, "statement_quarterly").where("statement_id is not null").select(
        N.symbol("symbol").alias("symbol"), F.struct(N.day_number("report_date").alias("d"), F.col("statement_id").alias("i")).alias("at"), N.finite("net_profit").alias("p"), N.finite("eps").alias("e"), N.finite("revenue").alias("v"))
    latest = st.groupBy("symbol").agg(*[F.max_by(c, "at").alias(c) for c in ("p", "e", "v")])
    last = day_volumes(spark, folder).where("close > 0").groupBy("symbol").agg(F.max_by("close", "day").alias("close"))
    primary, secondary = safe_ratio(F.col("p"), F.when(F.abs("e") >= 0.001, F.col("e"))), F.col("v") / 2
    shares = F.coalesce(F.when(primary > 0, primary), F.when(secondary > 0, secondary))
    label = first_reason((primary > 0, "profit_by_eps"), (secondary > 0, "half_revenue"), default="unknown")
    return latest.join(last, "symbol").select("symbol", s(shares / 1e6, 4).alias("million_shares"), s(F.col("close") * shares / 1e6, 3).alias("million_value"), label.alias("shares_from"))


@query
def statement_semantics(spark, folder):
    """P20: a total as reported, else from its complete components, plus an optional part, with the state of each field, counted by quarter."""
    t = table(spark, folder, "statement_quarterly").where("statement_id is not null")
    reported, a, b, part = (N.finite(c) for c in ("revenue", "net_profit", "eps", "roe_avg"))
    base = F.coalesce(reported, F.when(a.isNotNull() & b.isNotNull(), a + b))
    total = base + F.coalesce(part, F.lit(0.0))
    state = first_reason(
        (reported.isNotNull() & part.isNotNull(), "reported_plus_part"), (reported.isNotNull(), "reported_part_unreported"), (a.isNotNull() & b.isNotNull() & part.isNotNull(), "components_plus_part"),
        (a.isNotNull() & b.isNotNull(), "components_part_unreported"), default="unknown")
    return t.groupBy("fiscal_quarter", state.alias("state")).agg(F.count("*").alias("n"), F.count(total).alias("known"), s(F.avg(total / 1e6), 3).alias("mean_millions"))


#: Legal and trade suffixes of an institution's name.
SUFFIXES = ("证券股份有限公司", "证券有限责任公司", "股份有限公司", "有限责任公司", "有限公司", "证券研究院", "证券研究所", "研究院", "研究所", "证券")

#: Words by which a title's category is told, in order.
CATEGORIES = (("季度", "quarterly"), ("产能", "capacity"), ("首次", "initiation"), ("跟踪", "follow_up"), ("点评", "comment"))


@query
def institution_identity(spark, folder):
    """institutions as NFKC text in lower case without punctuation and repeated suffixes, and titles by category."""
    t = table(spark, folder, "research_report")
    kept = F.regexp_replace(F.lower(N.fold_text("institution")), r"[^0-9a-z\x{4e00}-\x{9fff}]", "")
    bare = F.regexp_replace(kept, f"(?:{'|'.join(SUFFIXES)})+$", "")
    kind = first_reason(*[(F.col("title").contains(word), name) for word, name in CATEGORIES], default="other")
    return t.select(F.nullif(bare, F.lit("")).alias("institution"), kind.alias("category")).groupBy("institution", "category").agg(F.count("*").alias("reports"))


@query
def function_catalogue(spark, folder):
    """Mathematics, dates, strings, hashes, units and cyclic time over parts and suppliers."""
    t = table(spark, folder, "part")
    x, name = F.col("p_retailprice"), F.col("p_name")
    tenth = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("p_partkey") % 2000).cast("int"))
    return t.select(
        "p_partkey", r(F.ln(x)).alias("ln"), r(F.sqrt(x)).alias("sqrt"), F.abs(-x).alias("abs"), F.signum(x - 1000).cast("int").alias("sign"), F.floor(x).cast("bigint").alias("floor"), F.ceil(x).cast("bigint").alias("ceil"),
        r(F.sin(2 * F.pi() * F.col("p_size") / 50)).alias("sin"), r(F.cos(2 * F.pi() * F.col("p_size") / 50)).alias("cos"), F.greatest(x, F.lit(1000.0)).alias("greatest"), F.least(x, F.lit(1000.0)).alias("least"),
        F.date_format(tenth, "yyyy-MM-dd").alias("date"), F.year(tenth).alias("year"), F.date_diff(tenth, F.lit("1990-06-15").cast("date")).alias("days"), F.substring(F.date_format(tenth, "yyyyMMdd"), 1, 6).alias("month"),
        F.upper(F.trim(name)).alias("upper"), F.lower("p_brand").alias("lower"), F.substring("p_type", 1, 5).alias("substr"), F.concat_ws("|", "p_brand", "p_type").alias("concat"), F.col("p_brand").like("Brand#1%").alias("like"),
        F.regexp_extract("p_brand", r"(\d+)$", 1).alias("extract"), F.regexp_replace("p_type", r"[A-Z]+ ", "").alias("replace"), F.col("p_type").rlike("^[A-Z]+ ").alias("matches"),
        F.md5("p_brand").alias("md5"), F.sha2("p_brand", 256).alias("sha256"), (F.col("p_size") * 10000 * 100).alias("shares"))


@query
def cost_models(spark, folder):
    """net returns in both forms; the duty on sales halves on 2001-01-01."""
    spec = W.along(["symbol"], "trade_date")
    b = daily_bars(spark, folder).withColumns({"later": F.lead("close", 5).over(spec), "sold": F.lead("trade_date", 5).over(spec)}).where("later is not null")
    duty = F.when(F.col("sold") >= F.lit("2001-01-01").cast("date"), 0.0005).otherwise(0.001)
    product = net_return(F.col("close"), F.col("later"), 0.0007, 0.0003, F.lit(0.0003) + duty)
    plus = F.col("later") / F.col("close") - 1 - 2 * 0.0007 - 2 * 0.0003 - duty
    return b.groupBy("symbol").agg(F.count("*").alias("n"), s(F.avg(product)).alias("multiplicative"), s(F.avg(plus)).alias("additive"), s(F.max(F.abs(product - plus))).alias("furthest"))


#: How far off its reference a price is a fault.
OFF = 0.01

# Repair ----------------------------------------------------------------------------------------------------------


@query
def repair_candidates(spark, folder):
    """Rows whose high or low is more than ``OFF`` off the day's own median price, the proposal that replaces only that field (the row's
    own open and close bound it), and whether it clears the fault or improves it enough.

    Medians are of closes by five-minute slot, so a day has at most 48 values.
    """
    rows = minute_rows(spark, folder).where("not auction and open > 0 and close > 0 and high > 0 and low > 0")
    middle = rows.groupBy("symbol", "day", "slot").agg(F.max_by("close", "millis").alias("c")).groupBy("symbol", "day").agg(F.median("c").alias("reference"))
    both = rows.join(middle, ["symbol", "day"])
    bound = {"high": F.greatest("open", "close"), "low": F.least("open", "close")}
    error = lambda c: F.abs(c / F.col("reference") - 1)
    long = both.select("symbol", "day", "millis", "reference", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("before"), b.alias("after")) for n, b in bound.items()])).alias("x")).select("symbol", "day", "millis", "reference", "x.*")
    found = long.where(error(F.col("before")) > OFF)
    better = error(F.col("after")) < error(F.col("before"))
    cut = 1 - error(F.col("after")) / error(F.col("before"))
    outcome = first_reason((~better, "rejected"), (error(F.col("after")) <= OFF, "cleared"), ((cut >= 0.5) & (error(F.col("after")) <= 5 * OFF), "improved"), default="rejected")
    return named_day(found.groupBy("symbol", "day", "field", outcome.alias("outcome")).agg(F.count("*").alias("rows"), s(F.max(error(F.col("before")))).alias("worst_before"), s(F.max(error(F.col("after")))).alias("worst_after")))


@query
def mislabelled_minutes(spark, folder):
    """Days on which a bar stands at the first minute of the afternoon while the last one of the morning is missing, as a ledger of moves."""
    raw = table(spark, folder, "minute_bars").select(N.symbol("symbol").alias("symbol"), N.sealed(N.day_number("trade_date")).alias("day"), N.sealed(F.floor(N.clock("bar_time") / 60000)).alias("minute"))
    g = raw.where("symbol is not null and day is not null").groupBy("symbol", "day").agg(F.count_if(F.col("minute") == 781).alias("there"), F.count_if(F.col("minute") == 690).alias("absent"))
    return named_day(g.where("there > 0 and absent = 0").select("symbol", "day", F.lit("1301").alias("original"), F.lit("1130").alias("repaired"), F.col("there").alias("rows")))


@query
def flow_eligible_prices(spark, folder):
    """First and last price of a day from rows with flow, from any row on a day without flow."""
    rows = minute_rows(spark, folder).where("open > 0 and close > 0").withColumn("flow", F.coalesce(F.col("volume") > 20000, F.lit(False)))
    marked = rows.withColumn("has_flow", F.max("flow").over(Window.partitionBy("symbol", "day")))
    fit = marked.where(~F.col("has_flow") | F.col("flow"))
    return named_day(fit.groupBy("symbol", "day").agg(F.bool_or("has_flow").alias("has_flow"), F.count("*").alias("rows"), s(F.min_by("open", "millis")).alias("first_price"), s(F.max_by("close", "millis")).alias("last_price")))


@query
def share_inference(spark, folder):
    """A day's shares by the statement known then, else carried from the turnover that the last known one implies, with the source."""
    st = table(spark, folder, "statement_quarterly").where("statement_id is not null").select(N.symbol("symbol").alias("symbol"), N.day_number("feature_available_date").alias("known"), safe_ratio(N.finite("net_profit"), F.when(F.abs(N.finite("eps")) >= 0.001, N.finite("eps"))).alias("shares"), "statement_id")
    events = st.where("shares > 0 and symbol is not null and known is not null").groupBy("symbol", "known").agg(F.max_by("shares", "statement_id").alias("shares"))
    days = day_volumes(spark, folder).select("symbol", "day", "volume")
    found = J.asof_join(days, events, ["symbol"], "day", "known", ["known", "shares"])
    spec = W.along(["symbol"], "day")
    turnover = found.withColumn("turnover", F.when(F.col("day") % 3 != 0, safe_ratio(F.col("volume"), F.col("shares"))))
    implied = safe_ratio(F.col("volume"), F.when(F.col("turnover") > 0, F.col("turnover")))
    carried = turnover.withColumn("carried", F.last(implied, ignorenulls=True).over(spec.rowsBetween(Window.unboundedPreceding, 0)))
    own = F.col("known") > F.col("day") - 60
    label = first_reason((F.coalesce(own, F.lit(False)), "statement"), (F.col("carried").isNotNull(), "turnover"), default="unknown")
    value = F.when(F.coalesce(own, F.lit(False)), F.col("shares")).otherwise(F.col("carried"))
    return named_day(carried.select("symbol", "day", s(value / 1e6, 3).alias("million_shares"), label.alias("shares_from")))


@query
def factor_continuation(spark, folder):
    """The factor from a symbol's first bar on, carried by the provider's ratio where the provider has one for both days, else unchanged; as logarithms, whose sums are the products."""
    spec = W.along(["symbol"], "trade_date")
    b = daily_bars(spark, folder).withColumn("provider", F.when(F.col("volume") > 5, F.col("close"))).withColumn("prior", F.lag("provider").over(spec))
    step = F.coalesce(safe_ln(safe_ratio(F.col("provider"), F.col("prior"))), F.lit(0.0))
    carried = b.withColumn("step", step).withColumn("log_factor", F.sum("step").over(spec.rowsBetween(Window.unboundedPreceding, 0)))
    return carried.groupBy("symbol").agg(F.count_if(F.col("step") != 0).alias("carried"), s(F.max_by("log_factor", "trade_date"), 5).alias("last_log"), s(F.max("log_factor"), 5).alias("highest_log"))


@query
def factor_boundaries(spark, folder):
    """The scale between neighbouring symbols over shared days, and whether the ratios at both ends agree with it within 1 %."""
    b = daily_bars(spark, folder).select("symbol", "trade_date", "close")
    n = b.select((F.col("symbol") - 1).alias("symbol"), "trade_date", F.col("close").alias("other"))
    shared = b.join(n, ["symbol", "trade_date"]).withColumn("ratio", F.col("close") / F.col("other"))
    g = shared.groupBy("symbol").agg(F.count("*").alias("days"), F.median("ratio").alias("scale"), F.min_by("ratio", "trade_date").alias("first"), F.max_by("ratio", "trade_date").alias("last"))
    near = lambda c: F.abs(F.col(c) / F.col("scale") - 1) <= 0.01
    return g.select("symbol", "days", s("scale").alias("scale"), near("first").alias("first_agrees"), near("last").alias("last_agrees"))


# Daily features --------------------------------------------------------------------------------------------------


def day_vector(bars: DataFrame, keys: list[str], order: str, noon: int) -> DataFrame:
    """A day's features from its bars: opening and closing windows, path, concentration, halves; positions count the day's bars.

    Everything but the cumulative parts is one aggregation; the cumulative ones share one sort within the day.
    """
    spec = W.along(keys, order)
    so_far, whole = spec.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    named = bars.withColumns({
        "_pos": F.row_number().over(spec), "_n": F.count("*").over(whole), "_before": F.lag("close").over(spec), "_peak": F.max("close").over(so_far), "_trough": F.min("close").over(so_far),
        "_ca": F.sum("amount").over(so_far), "_cv": F.sum("volume").over(so_far), "_ta": F.sum("amount").over(whole), "_tv": F.sum("volume").over(whole)})
    named = named.withColumns({
        "_ret": safe_ratio(F.col("close"), F.col("_before")) - 1, "_vwap": safe_ratio(F.col("_ta"), F.when(F.col("_tv") > 0, F.col("_tv"))), "_cum": safe_ratio(F.col("_ca"), F.when(F.col("_cv") > 0, F.col("_cv"))),
        "_share": safe_ratio(F.col("amount"), F.when(F.col("_ta") > 0, F.col("_ta"))), "_back": F.col("_n") - F.col("_pos"), "_am": F.col(order) < noon})
    named = named.withColumn("_log", safe_ln(1 + F.col("_ret")))
    at = lambda where, c: F.max(F.when(where, F.col(c)))
    pos, back, am = F.col("_pos"), F.col("_back"), F.col("_am")
    total = lambda where, c: F.sum(F.when(where, F.col(c)))
    g = named.groupBy(*keys).agg(
        F.count("*").alias("n"), at(pos == 1, "open").alias("o1"), *[at(pos == k, "close").alias(f"c{k}") for k in (1, 3, 6)], at(back == 0, "close").alias("last"), at(back == 1, "close").alias("last2"), at(back == 5, "open").alias("o_back6"),
        F.max("high").alias("hi"), F.min("low").alias("lo"), F.max("_ta").alias("ta"), F.max("_vwap").alias("vwap"), *[total(pos <= k, "amount").alias(f"a{k}") for k in (1, 6)], *[total(back < k, "amount").alias(f"z{k}") for k in (1, 6)],
        *[F.max(F.when(w, F.col("high"))).alias(f"hi_{n}") for n, w in (("open", pos == 1), ("open6", pos <= 6), ("close", back == 0), ("close6", back < 6))], *[F.min(F.when(w, F.col("low"))).alias(f"lo_{n}") for n, w in (("open", pos == 1), ("open6", pos <= 6), ("close", back == 0), ("close6", back < 6))],
        F.stddev_samp("_ret").alias("sd"), F.stddev_samp("_log").alias("sd_log"), F.stddev_samp(F.when(am, F.col("_ret"))).alias("sd_am"), F.stddev_samp(F.when(~am, F.col("_ret"))).alias("sd_pm"),
        F.min_by("_pos", F.struct(-F.col("high"), pos)).alias("p_hi"), F.min_by("_pos", F.struct("low", pos)).alias("p_lo"), F.min(F.col("close") / F.col("_peak") - 1).alias("drawdown"), F.max(F.col("close") / F.col("_trough") - 1).alias("runup"),
        F.avg((F.col("close") > F.col("_vwap")).cast("double")).alias("above_vwap"), F.max("_share").alias("top_share"), F.sum(F.col("_share") * F.col("_share")).alias("hhi"),
        F.try_divide(F.count("_cum") * F.sum(F.when(F.col("_cum").isNotNull(), pos * F.col("_cum"))) - F.sum(F.when(F.col("_cum").isNotNull(), pos)) * F.sum("_cum"), F.count("_cum") * F.sum(F.when(F.col("_cum").isNotNull(), pos * pos)) - F.sum(F.when(F.col("_cum").isNotNull(), pos)) * F.sum(F.when(F.col("_cum").isNotNull(), pos))).alias("cum_slope"),
        F.min_by("open", F.when(am, F.col(order))).alias("am_open"), F.max_by("close", F.when(am, F.col(order))).alias("am_close"), F.min_by("open", F.when(~am, F.col(order))).alias("pm_open"), F.max_by("close", F.when(~am, F.col(order))).alias("pm_close"), total(am, "amount").alias("am_amount"),
        F.avg(F.when(back < 5, F.col("volume"))).alias("v5"), F.avg(F.when((back >= 5) & (back < 25), F.col("volume"))).alias("v20"), at(back == 0, "high").alias("last_hi"), at(back == 0, "low").alias("last_lo"))
    gain = lambda a, b: safe_ratio(F.col(a), F.col(b)) - 1
    part = lambda a: safe_ratio(F.col(a), F.when(F.col("ta") > 0, F.col("ta")))
    span = F.col("hi") - F.col("lo")
    place = lambda c: F.when(F.col("n") > 1, (F.col(c) - 1) / (F.col("n") - 1))
    out = {
        "first_5m_ret": gain("c1", "o1"), "first_15m_ret": gain("c3", "o1"), "first_30m_ret": gain("c6", "o1"), "first_5m_share": part("a1"), "first_30m_share": part("a6"), "open_range": gain("hi_open", "lo_open"), "first_30m_range": gain("hi_open6", "lo_open6"),
        "open_pressure": gain("c1", "o1") * part("a1"), "last_5m_ret": gain("last", "last2"), "last_30m_ret": gain("last", "o_back6"), "last_5m_share": part("z1"), "last_30m_share": part("z6"), "close_range": gain("hi_close", "lo_close"), "last_30m_range": gain("hi_close6", "lo_close6"),
        "close_pressure": gain("last", "last2") * part("z1"), "close_pressure_30m": gain("last", "o_back6") * part("z6"), "day_ret": gain("last", "o1"), "vwap": F.col("vwap"), "close_to_vwap": gain("last", "vwap"), "day_range": gain("hi", "lo"), "close_position": F.when(span > 0, (F.col("last") - F.col("lo")) / span),
        "realised_vol": F.col("sd"), "log_vol": F.col("sd_log"), "high_time": place("p_hi"), "low_time": place("p_lo"), "high_first": F.when(F.col("p_hi") == F.col("p_lo"), 0.5).otherwise((F.col("p_hi") < F.col("p_lo")).cast("double")),
        "open_to_high": gain("hi", "o1"), "open_to_low": gain("lo", "o1"), "high_to_close": gain("last", "hi"), "low_to_close": gain("last", "lo"), "drawdown": F.col("drawdown"), "runup": F.col("runup"), "above_vwap": F.col("above_vwap"), "cum_vwap_slope": F.col("cum_slope"),
        "top_share": F.col("top_share"), "hhi": F.col("hhi"), "lunch_gap": gain("pm_open", "am_close"), "am_ret": gain("am_close", "am_open"), "pm_ret": gain("pm_close", "pm_open"), "am_pm_ret": gain("pm_close", "pm_open") - gain("am_close", "am_open"), "am_pm_vol": F.col("sd_pm") - F.col("sd_am"),
        "am_share": part("am_amount"), "early_late": gain("c6", "o1") - gain("last", "o_back6"), "volume_acceleration": safe_ratio(F.col("v5"), F.when(F.col("v20") > 0, F.col("v20"))) - 1,
        "close_location": F.when(F.col("last_hi") > F.col("last_lo"), (F.col("last") - F.col("last_lo")) / (F.col("last_hi") - F.col("last_lo"))).otherwise(0.5),
    }
    featured = g.select(*keys, "n", "o1", "last", *[c.alias(name) for name, c in out.items()])
    symbol, day = keys
    gap = featured.withColumn("_prev", F.lag("last").over(W.along([symbol], day))).withColumn("open_gap", safe_ratio(F.col("o1"), F.col("_prev")) - 1)
    return gap.withColumns({"gap_follow": F.signum("open_gap") * F.col("first_30m_ret"), "gap_reversal": -F.signum("open_gap") * F.col("first_30m_ret")}).drop("_prev", "o1", "last")


@query
def daily_feature_vector(spark, folder):
    """A22–A24."""
    fine = five_minute(spark, folder).where("open is not null and high is not null and low is not null and close is not null")
    out = day_vector(fine, ["symbol", "day"], "slot", 24)
    return named_day(out.select("symbol", "day", "n", *[s(c, 5 if c == "cum_vwap_slope" else 6).alias(c) for c in out.columns[3:]]))
