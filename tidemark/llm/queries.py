"""Queries of the corpus problems over the project's tables, with SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions import normalize as N
from tidemark.llm.consensus import representatives
from tidemark.llm.encode import encode_corpus
from tidemark.llm.pack import pack
from tidemark.llm.topn import top_n
from tidemark.llm.truncation import rates, truncated
from tidemark.operators.counting import counting
from tidemark.sources.tables import table

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# 4. Best representative ------------------------------------------------------------------------------------------

#: Marks that stand for a missing value, in lower case.
MISSING = ("n/a", "na", "nan", "none", "null", "nil", "-", "--", "---", "—", "——", "无", "暂无")

TEXT_FIELDS = ("title", "institution", "analyst", "rating", "url")
NUMBER_FIELDS = ("target_price_min", "target_price_max", "pdf_pages")


def stated(c: str) -> Column:
    """The trimmed text, null if it is blank or a mark for a missing value."""
    text = N.squeeze(c)
    return F.when((text != "") & ~F.lower(text).isin(*MISSING), text)


#: The weights of deliveries in a vote, by trust: at most four of one kind outweigh one of another.
WEIGHTS = {3: 4, 2: 3, 1: 2, 0: 1}


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """The representatives of reports with two deliveries or more."""
    rows = table(spark, folder, "research_report")
    key = F.lower(N.squeeze("source_report_key"))
    keyed = rows.withColumn("source_report_key", F.when(~key.rlike(r"^(?:-|—|–)*$"), key))
    trust = (
        F.when(F.col("tushare_present") & F.col("eastmoney_present"), 3).when(F.col("tushare_present"), 2).when(F.col("eastmoney_present"), 1).otherwise(0)
    )
    fields = {f: stated(f) for f in TEXT_FIELDS} | {f: N.finite_positive(f).cast("string") for f in NUMBER_FIELDS}
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair]), trust)
    preference = F.struct(trust.alias("trust"), "received_at", (-F.col("record_id")).alias("first"))
    return representatives(keyed, "source_report_key", fields, preference, "record_id", weight).where("rows > 1")


@query
def p4_best(spark: SparkSession, folder: str) -> DataFrame:
    """The consensus of each field of each report: the existing value closest to the vote, the best delivery that says it, and how many do."""
    return reports(spark, folder).select("source_report_key", "field_name", "value", "record_id", "votes", "known", F.col("rows").alias("deliveries"))


@query
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The delivery that supplies each field by the stated order of deliveries, which stands above the vote: trust, then arrival, then id."""
    return reports(spark, folder).select("source_report_key", "field_name", F.col("first_id").alias("record_id"))


@query
def p4_support(spark: SparkSession, folder: str) -> DataFrame:
    """How many deliveries of each report have each field, and the value that the stated order prefers."""
    return reports(spark, folder).select("source_report_key", "field_name", F.col("first_value").alias("value"), F.col("known").alias("votes"), F.col("rows").alias("deliveries"))


# 5. Top N of every group -----------------------------------------------------------------------------------------


@query
def p5_top(spark: SparkSession, folder: str) -> DataFrame:
    """The three best signals of each strategy minute with their rank."""
    signals = counting(
        table(spark, folder, "minute_signals").where("signal_id is not null"), ["signal_id"], "received_at",
        {"strategy_id": F.col("strategy_id"), "day": N.day_number("signal_date"), "millis": N.clock("signal_time"), "selection_score": N.finite("selection_score")},
    ).withColumn("minute", F.floor(F.col("millis") / 60000).cast("int"))
    return top_n(signals, ["strategy_id", "day", "minute"], "selection_score", "signal_id", 3).select(
        "strategy_id", N.day_text(F.col("day")).alias("signal_date"), "minute", "rank", "signal_id", "selection_score"
    )


@query
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_top(spark, folder).select("signal_id")


# 8. Encoding -----------------------------------------------------------------------------------------------------


@query
def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents"), "doc_id", "text")


# 9. Containers ---------------------------------------------------------------------------------------------------

CAPACITY = 2048


@query
def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every text, or piece of one of more than 2,048 tokens, in a container of 2,048 tokens."""
    sizes = encode_corpus(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", F.size("ids").alias("n_tokens"))
    return pack(sizes, "doc_id", "n_tokens", CAPACITY)


# 10. Truncation --------------------------------------------------------------------------------------------------


def cut_documents(spark: SparkSession, folder: str) -> DataFrame:
    return truncated(table(spark, folder, "documents"), "doc_id", "text", "source")


@query
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return cut_documents(spark, folder).where("cut").select("doc_id")


@query
def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source cuts its texts."""
    return rates(cut_documents(spark, folder), "source")


# SQL -------------------------------------------------------------------------------------------------------------

_REPORTS = r"""
r as (
  select lower(regexp_replace(source_report_key, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) as k, *,
    case when tushare_present and eastmoney_present then 3 when tushare_present then 2 when eastmoney_present then 1 else 0 end as trust
  from research_report),
g as (select * from r where k is not null and k not in ('', '-', '--', '—', '–') qualify count(*) over (partition by k) > 1),
f as (%s),
best as (
  select k as source_report_key, field_name, record_id, v as value, count(*) over (partition by k, field_name) as votes, deliveries from f
  qualify row_number() over (partition by k, field_name order by trust desc, received_at desc nulls last, record_id) = 1)""" % " union all ".join(
    [
        rf"""select k, '{f}' as field_name, record_id, trust, received_at, count(*) over (partition by k) as deliveries,
      regexp_replace({f}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') as v from g
      qualify v <> '' and lower(v) not in ({", ".join(f"'{m}'" for m in MISSING)})"""
        for f in TEXT_FIELDS
    ]
    + [
        f"""select k, '{f}' as field_name, record_id, trust, received_at, count(*) over (partition by k) as deliveries, cast(cast({f} as double) as varchar) as v from g
      qualify isfinite(cast({f} as double)) and {f} > 0"""
        for f in NUMBER_FIELDS
    ]
)

_TOP = r"""
s as (
  select * from (
    select signal_id, strategy_id, received_at, selection_score,
      regexp_replace(signal_date, '^(\d{4})-?(\d{2})-?(\d{2}).*$', '\1-\2-\3') as signal_date,
      cast(regexp_replace(signal_time, '^(\d{2}):?(\d{2}).*$', '\1') as int) * 60 + cast(regexp_replace(signal_time, '^(\d{2}):?(\d{2}).*$', '\2') as int) as minute
    from minute_signals where signal_id is not null)
  qualify row_number() over (partition by signal_id order by received_at desc) = 1),
t as (
  select *, row_number() over (partition by strategy_id, signal_date, minute order by selection_score desc, signal_id) as rank
  from s where isfinite(selection_score))"""

ORACLES = {
    "p4_found": f"with {_REPORTS} select source_report_key, field_name, record_id from best",
    "p4_support": f"with {_REPORTS} select source_report_key, field_name, value, votes, deliveries from best where value is not null",
    "p5_top": f"with {_TOP} select strategy_id, signal_date, minute, cast(rank as int) as rank, signal_id, selection_score from t where rank <= 3",
    "p5_found": f"with {_TOP} select signal_id from t where rank <= 3",
}
