"""Best representative of each duplicate group: token-level consensus.

The values of a group are aligned progressively, token by token; each column of the alignment is a vote of
weighted tokens; the value that comes out is the existing one closest to the winning tokens. Weights are bounded, so
several deliveries of little weight outvote one of much. Beside the consensus stands the value of the delivery that is
preferred most, for users whose rule is a strict order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import checkpoint

#: A token: a run of ASCII letters and digits, or one other character that isn't white space.
_TOKEN = re.compile(r"[A-Za-z0-9]+|\S")

GAP = ""


def tokens(value: str) -> list[str]:
    return _TOKEN.findall(value)


def align(columns: list[dict[str, int]], total: int, sequence: Sequence[str], weight: int) -> list[dict[str, int]]:
    """The profile ``columns`` (token to weight, gaps included; all columns sum to ``total``) with one more sequence.

    Global alignment by dynamic programming. Putting a token into a column costs the weight there that votes otherwise,
    leaving a column out costs the weight of its tokens, opening a column costs ``total``.
    """
    start = 0
    while start < min(len(columns), len(sequence)) and columns[start].get(sequence[start], 0) == total:
        start += 1
    if start:  # columns in which all agree with the sequence match it at no cost
        agreed = [{t: total + weight} for t in sequence[:start]]
        return agreed + align(columns[start:], total, sequence[start:], weight)
    n, m = len(columns), len(sequence)
    skip = [total - c.get(GAP, 0) for c in columns]
    best = [[j * total for j in range(m + 1)]]
    for i, column in enumerate(columns):
        above, row = best[-1], [best[-1][0] + skip[i]]
        for j, token in enumerate(sequence):
            row.append(min(above[j] + total - column.get(token, 0), above[j + 1] + skip[i], row[j] + total))
        best.append(row)
    out: list[dict[str, int]] = []
    i, j = n, m
    while i or j:
        here = best[i][j]
        if i and j and here == best[i - 1][j - 1] + total - columns[i - 1].get(sequence[j - 1], 0):
            i, j = i - 1, j - 1
            column = dict(columns[i])
            column[sequence[j]] = column.get(sequence[j], 0) + weight
        elif i and here == best[i - 1][j] + skip[i - 1]:
            i -= 1
            column = dict(columns[i])
            column[GAP] = column.get(GAP, 0) + weight
        else:
            j -= 1
            column = {GAP: total, sequence[j]: weight} if total else {sequence[j]: weight}
        out.append(column)
    return out[::-1]


def distance(a: Sequence[str], b: Sequence[str]) -> int:
    """Edits of whole tokens between two sequences."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def majority(weights: Sequence[int]) -> int | None:
    """The position of a weight above all others together, or of the first one if it equals them."""
    total = sum(weights)
    if weights[0] * 2 >= total:
        return 0
    return next((i for i, w in enumerate(weights) if w * 2 > total), None)


def consensus(values: Sequence[str], weights: Sequence[int]) -> int:
    """The position of the value closest to the consensus; of equally close ones the earlier.

    Values join the alignment in their order; a column's vote goes to its heaviest token, of equal ones to the
    one that came first. A value with more than half of the weight wins every column that it is in and its gap in all others,
    so it is the consensus without an alignment.
    """
    if (sure := majority(weights)) is not None:
        return sure
    split = [tokens(v) for v in values]
    columns, total = [{t: weights[0]} for t in split[0]], weights[0]
    for sequence, weight in zip(split[1:], weights[1:]):
        columns = align(columns, total, sequence, weight)
        total += weight
    won = [max(column, key=column.__getitem__) for column in columns]
    target = [t for t in won if t != GAP]
    away = [distance(s, target) if s != target else 0 for s in split]
    return away.index(min(away))


OUT = ("field_name", "value", "row_id", "votes", "known", "rows", "first_value", "first_id")


def elect(values: Sequence[str | None], weights: Sequence[int]) -> tuple[int, int, int, int] | None:
    """(row of the representative, rows that say it, rows that say anything, first row that says anything) of rows in order of preference.

    Equal values vote together, where the first of them stands. None if no row says anything.
    """
    said: dict[str, list[int]] = {}
    for i, v in enumerate(values):
        if v is not None:
            said.setdefault(v, []).append(i)
    if not said:
        return None
    different = list(said)
    won = said[different[consensus(different, [sum(weights[i] for i in said[v]) for v in different])]]
    return won[0], len(won), sum(map(len, said.values())), said[different[0]][0]


def representatives(rows: DataFrame, group: str, fields: dict[str, Column], preference: Column, row_id: str, weight: Column, limit: int = 64) -> DataFrame:
    """(group, field_name, value, row_id, votes, known, rows, first_value, first_id): the representative of each group and field.

    ``fields`` gives each field's value as a text, null where a row doesn't have it. ``value`` is the consensus: the value
    closest to the tokens that win the vote, in which every row counts with ``weight``, a whole number above 0 of which
    the caller states the bound (null and less count as 1); ``row_id`` is the best row that says it by ``preference`` (a struct or number, larger
    being better, different for different rows), ``votes`` the number of rows that say it, ``known`` of those that say
    anything and ``rows`` of all. ``first_value`` and ``first_id`` are those of the best row that says anything. A field
    no row has gives no row; rows with a null group are left out. Columns not named are ignored.

    Groups of up to ``limit`` rows move once, as they are, and are voted on where they arrive. Of larger ones, which are found by a
    count first, the equal values of a field combine before the shuffle, and where more than ``limit`` different values
    remain they vote in parts of half of that, round by round; a part's representative goes on with all of its part's
    weight. So no task holds more than ``limit`` rows or values of a group. Both ways elect alike.
    """
    named = rows.where(F.col(group).isNotNull()).select(
        F.col(group).alias("_group"), preference.alias("_rank"), F.col(row_id).alias("_id"), F.greatest(F.coalesce(weight.cast("bigint"), F.lit(1)), F.lit(1)).alias("_w"),
        *[v.alias(f"_f{i}") for i, v in enumerate(fields.values())],
    )
    counts = named.groupBy("_group").agg(F.count("*").alias("_n"))
    large = checkpoint(counts.where(F.col("_n") > limit))
    some = large.head(1)
    small = named.join(large.select("_group"), "_group", "left_anti") if some else named
    out = _vote_rows(small, list(fields))
    if some:
        out = out.unionByName(_vote_values(named.join(large.select("_group"), "_group", "left_semi"), large, list(fields), limit))
    names = {"row_id": row_id}
    return out.select(F.col("_group").alias(group), *[F.col(c).alias(names.get(c, c)) for c in OUT])


def _vote_rows(named: DataFrame, fields: list[str]) -> DataFrame:
    """Groups whose rows come together in one task, sorted so that a group is a run of rows, which may go over batches."""
    types = {f.name: f.dataType.simpleString() for f in named.schema.fields}
    group_at, id_at, weight_at, first_field = (named.columns.index(c) for c in ("_group", "_id", "_w", "_f0"))

    def results(whole: pa.RecordBatch, starts: list[int]) -> pa.RecordBatch:
        """One row for each field of each run of rows between ``starts``."""
        weights = whole.column(weight_at).to_pylist()
        columns = [whole.column(first_field + i).to_pylist() for i in range(len(fields))]
        names, won, first, numbers = [], [], [], ([], [], [])
        for low, high in zip(starts, starts[1:]):
            w = weights[low:high]
            for name, column in zip(fields, columns):
                if found := elect(column[low:high], w):
                    names.append((name, column[low + found[0]], column[low + found[3]]))
                    won.append(low + found[0])
                    first.append(low + found[3])
                    for held, n in zip(numbers, (found[1], found[2], high - low)):
                        held.append(n)
        take = lambda at, rows: pc.take(whole.column(at), pa.array(rows, pa.int64()))
        text = lambda i: pa.array([x[i] for x in names], pa.string())
        return pa.RecordBatch.from_arrays(
            [take(group_at, won), text(0), text(1), take(id_at, won), *[pa.array(n, pa.int64()) for n in numbers], text(2), take(id_at, first)], ["_group", *OUT],
        )

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for one in batches:
            if not one.num_rows:
                continue
            whole = one if held is None or not held.num_rows else pa.Table.from_batches([held, one]).combine_chunks().to_batches()[0]
            groups = whole.column(group_at)
            edges = [0, *(i + 1 for i, x in enumerate(pc.not_equal(groups.slice(1), groups.slice(0, len(groups) - 1)).to_pylist()) if x)]
            yield results(whole, edges)
            held = whole.slice(edges[-1])
        if held is not None and held.num_rows:
            yield results(held, [0, held.num_rows])

    shape = f"_group {types['_group']}, field_name string, value string, row_id {types['_id']}, votes bigint, known bigint, rows bigint, first_value string, first_id {types['_id']}"
    return named.repartition("_group").sortWithinPartitions(F.col("_group"), F.col("_rank").desc()).mapInArrow(vote, shape)


def _vote_values(named: DataFrame, counts: DataFrame, fields: list[str], limit: int) -> DataFrame:
    """Groups of many rows, by their different values; ``counts`` has each group's number of rows."""
    said = F.array(*[F.struct(F.lit(name).alias("field_name"), F.col(f"_f{i}").alias("value")) for i, name in enumerate(fields)])
    long = named.select("_group", "_w", F.struct(F.col("_rank").alias("rank"), F.col("_id").alias("id")).alias("_best"), F.explode(said).alias("x")).where("x.value is not null")
    values = checkpoint(
        long.groupBy("_group", "x.field_name", "x.value").agg(F.max("_best").alias("best"), F.sum("_w").alias("weight"), F.count("*").alias("votes"))
    )
    totals = values.groupBy("_group", "field_name").agg(F.sum("votes").alias("known"), F.max(F.struct("best", "value")).alias("_first"))
    candidate = F.struct("best", "value", "weight", "votes")
    whole, turn = values, 0
    while True:
        sizes = whole.groupBy("_group", "field_name").agg(F.count("*").alias("_size"))
        crowded = sizes.where(F.col("_size") > limit)
        if not crowded.head(1):
            break
        part = F.pmod(F.xxhash64("value", F.lit(turn)), F.ceil(F.coalesce("_size", F.lit(1)) / (limit // 2)).cast("bigint"))
        spread = whole.join(crowded, ["_group", "field_name"], "left").withColumn("_part", F.when(F.col("_size").isNotNull(), part))
        gathered = spread.where("_part is not null").groupBy("_group", "field_name", "_part").agg(F.sort_array(F.collect_list(candidate), asc=False).alias("c"))
        kept = _elected(gathered).select("_group", "field_name", "value", "best", "weight", "votes")
        whole = checkpoint(spread.where("_part is null").select(*kept.columns).unionByName(kept))
        turn += 1
    gathered = whole.groupBy("_group", "field_name").agg(F.sort_array(F.collect_list(candidate), asc=False).alias("c"))
    return (
        _elected(gathered).join(totals, ["_group", "field_name"]).join(counts, "_group")
        .select("_group", "field_name", "value", F.col("best.id").alias("row_id"), "votes", "known", F.col("_n").alias("rows"), F.col("_first.value").alias("first_value"), F.col("_first.best.id").alias("first_id"))
    )


def _elected(gathered: DataFrame) -> DataFrame:
    """Each row's candidates ``c``, best first, replaced by the representative, which carries the weight of all."""

    @F.pandas_udf("int")
    def winner(lists: pd.Series, weights: pd.Series) -> pd.Series:
        return pd.Series([consensus(list(v), [int(x) for x in w]) for v, w in zip(lists, weights)], dtype="int32")

    chosen = gathered.withColumn("_w", winner(F.col("c.value"), F.col("c.weight")))
    total = F.aggregate("c.weight", F.lit(0).cast("bigint"), lambda a, b: a + b)
    return chosen.withColumn("_x", F.get("c", "_w")).select(*[c for c in gathered.columns if c != "c"], "_x.value", "_x.best", "_x.votes", total.alias("weight"))
