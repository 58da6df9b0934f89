"""The corpus operators against plain Python on small and odd inputs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm.consensus import consensus, elect, representatives
from tidemark.llm.encode import VOCABULARY, encode_corpus, encoding
from tidemark.llm.pack import pack, plan
from tidemark.llm.topn import top_n
from tidemark.llm.truncation import body, closing_lines, node_counts, pieces, plain, rates, truncated, usual_limits, word_counts, words_of

# top n -----------------------------------------------------------------------------------------------------------


def test_top_n(spark):
    nan = float("nan")
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.0, 2.0, nan, None]), f"i{i}", "x") for i in range(200)] + [("hot", 5.0, f"h{i:04d}", "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, s double, i string, nth string")
    got = {(r.g, r["rank"]): r.i for r in top_n(df, ["g"], "s", "i", 3).collect()}
    for g in {r[0] for r in rows}:
        want = sorted((-s, i) for gg, s, i, _ in rows if gg == g and s is not None and s == s)[:3]
        assert [got.get((g, n)) for n in (1, 2, 3)] == [i for _, i in want]
    assert top_n(df.limit(0), ["g"], "s", "i", 3).collect() == []
    assert "WindowGroupLimit" in top_n(df, ["g"], "s", "i", 3)._jdf.queryExecution().toString()


# consensus -------------------------------------------------------------------------------------------------------


def test_consensus_by_majority():
    values = ["annual report of Acme 2001", "annual report of Acme Ltd 2001", "annual rep0rt of Acme Ltd 2001", "annual report of Acme Ltd 2001 draft"]
    assert values[consensus(values, [1, 1, 1, 1])] == values[1]
    assert consensus(["x"], [1]) == 0
    assert consensus(["", "a b"], [1, 3]) == 1


def test_bounded_weights_outvote_the_best_ranked():
    # The best-ranked value comes first and weighs most, yet three others agree on another.
    values = ["Qingyun Securities", "Qingyun Securities Research", "Qingyun Securities Researchh"]
    assert consensus(values, [4, 6, 1]) == 1
    assert consensus(values, [4, 1, 1]) == 0
    assert elect(["a b", None, "a c", "a c", "a c"], [4, 9, 2, 2, 2]) == (2, 3, 4, 0)
    assert elect([None, None], [1, 1]) is None


def test_majority_is_what_the_alignment_gives(monkeypatch):
    import tidemark.llm.consensus as C

    rng = random.Random(6)
    groups = []
    for _ in range(400):
        values = list(dict.fromkeys("".join(rng.choice("ab c的") for _ in range(rng.randrange(0, 12))).strip() for _ in range(rng.randrange(1, 6))))
        groups.append((values, [rng.randrange(1, 9) for _ in values]))
    short = [C.consensus(*g) for g in groups]
    sure = [C.majority(w) for _, w in groups]
    monkeypatch.setattr(C, "majority", lambda weights: 0 if len(weights) == 1 else None)
    assert [C.consensus(*g) for g in groups] == short
    assert sum(x is not None for x in sure) > 100 and any(x is None for x in sure)


def by_plain_python(rows, fields, rank, weight):
    """The same election, group by group: rows are (group, id, texts by field)."""
    out = {}
    for k in {r[0] for r in rows} - {None}:
        own = sorted((r for r in rows if r[0] == k), key=rank, reverse=True)
        for at, name in enumerate(fields):
            have = [r for r in own if r[2][at] is not None]
            if not have:
                continue
            values = list(dict.fromkeys(r[2][at] for r in have))
            won = values[consensus(values, [sum(weight(r) for r in have if r[2][at] == v) for v in values])]
            says = [r for r in have if r[2][at] == won]
            out[k, name] = (won, says[0][1], len(says), len(have), len(own), have[0][2][at], have[0][1])
    return out


@pytest.mark.parametrize("limit", [8, 64])
def test_representatives(spark, limit):
    rng = random.Random(limit)
    said = [None, "", "a b c", "a b d", "a c", "的 x", "a b c d"]
    rows = [(rng.choice([f"k{n}" for n in range(40)] + [None]), i, (rng.choice(said), rng.choice(["7.0", None])), rng.choice([0, 1, 2, 3])) for i in range(200)]
    rows += [("hot", 1000 + i, (rng.choice(said[1:5]), None), i % 4) for i in range(3000)]
    df = spark.createDataFrame([(k, i, *v, t) for k, i, v, t in rows], "k string, id bigint, t string, n string, trust int").withColumns({"value": F.lit("clash"), "rows": F.lit("clash")})
    fields = {"t": F.col("t"), "n": F.col("n"), "none": F.lit(None).cast("string")}
    rank = lambda r: (r[3], -r[1])
    got = representatives(df, "k", fields, F.struct("trust", (-F.col("id")).alias("o")), "id", F.col("trust") + 1, limit).collect()
    found = {(r.k, r.field_name): (r.value, r.id, r.votes, r.known, r.rows, r.first_value, r.first_id) for r in got}
    assert len(found) == len(got)
    want = by_plain_python(rows, ["t", "n"], rank, lambda r: r[3] + 1)
    assert found == want
    assert any(w[0] != w[5] for w in want.values())  # the consensus isn't always the best-ranked value
    assert representatives(df.limit(0), "k", fields, F.struct("trust"), "id", F.lit(1)).collect() == []


def test_representatives_in_rounds(spark):
    rows = [("hot", i, f"value number {i % 70}", i % 3) for i in range(300)] + [("cold", 900, "x", 1)]
    df = spark.createDataFrame(rows, "k string, id bigint, t string, trust int")
    got = {r.k: r for r in representatives(df, "k", {"t": F.col("t")}, F.struct("trust", (-F.col("id")).alias("o")), "id", F.lit(1), 8).collect()}
    assert got["hot"].known == got["hot"].rows == 300 and got["hot"].value.startswith("value number ")
    assert (got["hot"].first_value, got["hot"].first_id) == ("value number 2", 2)
    assert got["hot"].id == min((i for k, i, t, trust in rows if t == got["hot"].value), key=lambda i: (-rows[i][3], i))
    assert (got["cold"].value, got["cold"].id, got["cold"].votes) == ("x", 900, 1)


# encode ----------------------------------------------------------------------------------------------------------


def test_encode_corpus(spark):
    enc = encoding(VOCABULARY)
    rng = random.Random(5)
    long = "".join(rng.choice(["word ", "的", "12", "\r\n", "!", "<|endoftext|>", "aaaaaaaa"]) for _ in range(5000))
    texts = [(1, "plain text"), (2, None), (3, ""), (4, "   \n"), (5, "<|endoftext|>"), (6, long), (6, long), (7, long + "x"), (None, "null key"), (None, long), (8, "a" * 20000), (1, "plain text")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = sorted(((r.doc_id, list(r.ids)) for r in encode_corpus(df, "doc_id", "text", leaf=500).collect()), key=repr)
    assert got == sorted(((k, enc.encode_ordinary(t) if t else []) for k, t in texts), key=repr)
    assert encode_corpus(df.limit(0), "doc_id", "text").collect() == []


# pack ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 100])
    counts = {s: rng.randrange(1, 300) for s in rng.sample(range(1, capacity + 1), rng.randrange(1, capacity))}
    used = {}
    for sizes, many in plan(counts, capacity):
        assert sum(sizes) <= capacity and many > 0
        for s in sizes:
            used[s] = used.get(s, 0) + many
    assert used == counts


def test_plan_replaces_the_smallest_by_two_that_fit_better():
    # Greedily 6 + 3 leaves 1 of 10 unused; 3 gives way to 2 + 2.
    first = plan({6: 1, 3: 1, 2: 2}, 10)[0]
    assert first == ([6, 2, 2], 1)
    assert plan({}, 10) == []


@pytest.mark.parametrize("buckets", [1, 16])
def test_pack(spark, buckets):
    rng = random.Random(buckets)
    items = [(i, rng.choice([0, None, 1, 5, 17, 40, 64, 65, 128, 200, -3, *range(1, 64)])) for i in range(500)] + [(None, 10), (7, 20), (7, 20)] + [(1000 + i, 64) for i in range(300)]
    df = spark.createDataFrame(items, "id int, n int").withColumn("size", F.lit("clash"))
    got = pack(df, "id", "n", 64, buckets).collect()
    need = sum(max(n or 0, 0) for _, n in items)
    assert sum(r["size"] for r in got) == need
    place = {}
    for r in got:
        for at in range(r.offset, r.offset + r["size"]):
            assert 0 <= at < 64 and (r.container, at) not in place
            place[r.container, at] = r.id
    used = {r.container for r in got if r["size"]}
    assert used == set(range(len(used))) and len(used) <= need / 64 * 1.05 + 2
    assert {r.container for r in got} <= used
    pieces = {}
    for r in got:
        pieces.setdefault(r.id, []).append((r.start, r["size"]))
    for i, n in items[:500]:
        if i != 7:
            own = sorted(pieces[i])
            assert sum(s for _, s in own) == max(n or 0, 0) and all(s == 64 for _, s in own[:-1])
            assert len(own) == max(1, -(-max(n or 0, 0) // 64))
    assert pack(df.limit(0), "id", "n", 64).collect() == []


# truncation ------------------------------------------------------------------------------------------------------


def test_body():
    closings = frozenset({"(end)", "-- sent by the desk --", "to be continued...", ""})
    assert body("One sentence. Two sen\n\n-- sent by the desk --", closings) == ("One sentence. Two sen", False)
    assert body("One sentence. Two sen [...]", closings) == ("One sentence. Two sen", True)
    assert body("One sentence.\nto be continued...", closings) == ("One sentence.", False)
    assert body("\n \n", closings) == ("", False) and body("(end)", closings) == ("", False)
    assert plain("a 1,234.5 b\r\n\r\nc  ") == "a 0 b\nc"


def test_body_long_ellipsis():
    closings = frozenset({"-- sent by the desk --", "To come……"})
    assert body("One sentence. Two sen……", closings) == ("One sentence. Two sen", True)
    assert body("一句话。另一句……\n\n-- sent by the desk --", closings) == ("一句话。另一句", True)
    assert body("One sentence.\nTo come……", closings) == ("One sentence.", False)
    assert body("一句话。\n未完待续……", frozenset()) == ("一句话。", False) and body("一句话。\n（未完待续……）", frozenset()) == ("一句话。", False)
    assert body("一句话。另一\n未完待续……", frozenset()) == ("一句话。另一", False)


def test_truncated_long_ellipsis(spark):
    rows, cut = corpus()
    texts = {i: t for i, t, _ in rows}
    marked = [i for i in sorted(cut) if texts[i] and texts[i].endswith("…")]
    df = spark.createDataFrame([(i, t + "…" if i in marked else t, s) for i, t, s in rows], "id bigint, text string, source string")
    got = {r.id: r.evidence for r in truncated(df, "id", "text", "source").collect()}
    assert len(marked) > 3 and {got[i] for i in marked} == {"mark"}


def test_plain_commas():
    assert plain("id,day,close\n277668.SZ,11,1317\n1,234 of 4,472.96亿\n277668.SZ,126,795……") == "id,day,close\n0.SZ,0,0\n0 of 0亿\n0.SZ,0,0……"
    assert plain("净流入4,47") == "净流入0" and plain("7,500\nFY2001,") == "0\nFY0," and plain("in 1, 2 and 3,4567") == "in 0, 0 and 0,0"


def test_truncated_comma_rows(spark):
    rng = random.Random(4)
    row = lambda: f"{rng.randrange(200000, 999999)}.{rng.choice(['SZ', 'SH'])},{rng.randrange(1, 900)},{rng.randrange(1, 9000)},{rng.randrange(1, 900)}"
    said = "The board met on the matter and saw no reason for a change."
    rows, cut = [], set()
    for i in range(400):
        lines = ["symbol,close,amount,lots", *(row() for _ in range(rng.randrange(4, 12)))]
        if i % 20 == 7:
            lines[-1] = lines[-1].rsplit(",", rng.choice([1, 2]))[0]
            cut.add(i)
        text = "\n".join([said, *lines, said][: None if i % 20 == 3 else -1])
        rows.append((i, text + ("\n-- relayed by the desk --" if i % 3 == 0 else ""), f"s{i % 200}"))  # too few texts of a source for length evidence
    df = spark.createDataFrame(rows, "id bigint, text string, source string")
    assert closing_lines(df, "text", 0.001) == {"-- relayed by the desk --"}
    got = {r.id: r.evidence for r in truncated(df, "id", "text", "source").where("cut").collect()}
    assert got == dict.fromkeys(cut, "word"), [(got.get(i), rows[i][1][-60:]) for i in sorted(set(got) ^ cut)[:4]]


def corpus():
    rng = random.Random(9)
    animals = ["tortoise", "elephant", "crocodile", "hedgehog", "butterfly"]
    places = ["the garden near the old harbour", "a quiet valley", "the botanical institute", "our neighbour's orchard"]
    say = lambda: f"The {rng.choice(animals)} walked {rng.randrange(2, 900)} metres through {rng.choice(places)}"
    rows, cut = [], set()
    for i in range(1200):
        text = ". ".join(say() for _ in range(rng.randrange(3, 9))) + "."
        source = ["wire", "Wire ", "desk", None][i % 4]
        if i % 4 < 2 and len(text) > 200:
            text = text[:200]
            if not text.rstrip().endswith("."):
                cut.add(i)
        elif i % 10 == 0:
            text = text[:-1]
        elif i % 17 == 0:
            at = rng.randrange(40, len(text) - 20)
            while not (text[at - 1].isalpha() and text[at].isalpha()):
                at -= 1
            text = text[:at] + rng.choice(["", "…", " [...]"])
            cut.add(i)
        if i % 3 == 0:
            text += "\n\n-- relayed by the desk --"
        rows.append((i, text, source))
    return rows + [(2000, None, "wire"), (2001, "", "wire"), (2002, "  \n", None), (2003, "The tortoise walked 5 metres through a quiet valley�", "desk")], cut | {2003}


def test_truncated(spark):
    rows, cut = corpus()
    df = spark.createDataFrame(rows, "id bigint, text string, source string").withColumn("cut", F.lit("clash"))
    found = truncated(df, "id", "text", "source")
    got = {r.id: r for r in found.collect()}
    assert len(got) == len(rows)
    flagged = {i for i, r in got.items() if r.cut}
    assert len(flagged & cut) / len(cut) > 0.95 and len(flagged & cut) / len(flagged) > 0.95
    assert not flagged & {2000, 2001, 2002} and got[2003].evidence == "character"
    by = {r.source: r for r in rates(found, "source").collect()}
    assert by["wire"].texts == 602 and by["wire"].cut > 100
    assert truncated(df.limit(0), "id", "text", "source").collect() == []


def test_usual_limits(spark):
    rng = random.Random(3)
    rows = [("a", rng.randrange(100, 900)) for _ in range(500)] + [("a", 400)] * 60 + [("b", rng.randrange(10, 20)) for _ in range(100)] + [(None, 5)]
    got = {tuple(r) for r in usual_limits(spark.createDataFrame(rows, "s string, n int"), "s", "n").collect()}
    assert got == {("a", 400)}


def test_long_closing_lines_are_known_whole(spark):
    rng = random.Random(8)
    footer = "This footer says at length that nobody is liable for anything said above, " * 4
    wall = "A wall of words that is one line and more than a thousand characters long goes on and on here. " * 14
    assert 250 < len(footer) < 320 and len(wall) > 1200
    say = lambda: " ".join(rng.choice(["rates", "bonds", "yields", "markets", "prices"]) for _ in range(rng.randrange(5, 60))) + "."
    rows = [(i, f"{say()} {say()}\n{footer if i % 2 else wall}", "desk") for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, text string, source string")
    found = closing_lines(df, "text", 0.001)
    assert found == {plain(footer), plain(wall)}
    assert all(body(t, found)[0] == t.partition("\n")[0] for _, t, _ in rows)
    assert truncated(df, "id", "text", "source").where("cut").count() == 0


def test_blocks_change_no_count(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab. \n。3.5字") for _ in range(n)) for n in (3000, 5, 0, 4, 9, 700)]
    for k in (8, 4):
        want = node_counts([(t, False) for t in texts], k)
        brute = Counter(t[p - k : p] for t in texts for p in range(k, len(t)))
        assert len(want[0]) == len(brute) and int((want[1] + want[2]).sum()) == sum(brute.values())  # no window goes over two texts
        for chars in (1, 2, 3, 50, 2999, 3000):
            got = node_counts([x for t in texts for x in pieces(t, k, chars)], k)
            assert all((a == b).all() for a, b in zip(want, got))
    rows, _ = corpus()
    df = spark.createDataFrame(rows[:400] + [(5000, " ".join(t for _, t, _ in rows if t), "desk")], "id bigint, text string, source string")
    flags = [sorted((r.id, r.evidence or "") for r in truncated(df, "id", "text", "source", chars=chars).collect()) for chars in (300, 2_000_000)]
    assert flags[0] == flags[1]


def test_words_of_spaced_scripts():
    assert words_of("The Compan")[0] == ["the"] and words_of("The Compan")[1] is not None
    assert words_of("it is done.") == (["it", "is", "done"], None) and words_of("") == ([], None)
    assert words_of("公司Comp")[1] == words_of("a comp")[1] and words_of("on 12ab")[1] is None and words_of("的")[1] is None
    nodes, on, ends = word_counts(Counter({"company": 3, "comp": 1}))
    by = {int(n): (int(a), int(b)) for n, a, b in zip(nodes, on, ends)}
    assert by[words_of("x comp")[1]] == (3, 1) and by[words_of("x company")[1]] == (0, 3) and by[words_of("x compan")[1]] == (3, 0) and len(by) == 7


def test_last_word_unknown(spark):
    rng = random.Random(2)
    words = ["company", "announces", "dividend", "shareholders", "quarterly", "results"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(8, 20))) + ("" if i % 5 == 0 else "."), f"s{i % 90}") for i in range(400)]
    rows += [(900, "company results divid", "s1"), (901, "company results zzyzx", "s2"), (902, "dividend announces shareh", "s3")]
    df = spark.createDataFrame(rows, "id bigint, text string, source string")
    got = {r.id: r.evidence for r in truncated(df, "id", "text", "source").where("cut").collect()}
    assert got == {900: "prefix", 902: "prefix"}
