"""Texts that stop before their end.

The corpus vocabulary is a trie with two kinds of nodes, each known by its hash, with the number of times that text went on
there and the number of times it ended. For scripts with spaces a node is the beginning of a word: it ended where
the word did. A text whose last word is unknown but begins known ones was cut. As half of the corpus has no spaces
between words, a node is also the last ``k`` characters before a place: it ended where a sentence stop or a line end
followed. A text whose last characters always went on was cut. Lengths that an unusual share of a source has are
further evidence.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.normalize import squeeze
from tidemark.session import checkpoint

#: Marks that are put right after a cut.
MARKS = ("[...]", "[…]", "(more", "(more)", "...", "…")

#: Characters after which a text is at its end.
STOPS = "。.!?！？…"

#: A number or a hexadecimal digest, which differ each time. A comma belongs to a number before three digits, or fewer if the line stops there.
_NUMBER = re.compile(r"[0-9a-f]{8,}|\d++(?:(?<!\d{4})(?:,\d{3}(?!\d))*+(?:,\d{0,2}(?=[^\w\n]*(?:more\W*)?$))?)?(?:\.\d+)?", re.MULTILINE)
#: A row of a comma table: fields without blanks, more than a number with its commas. A mark of a cut may follow.
_ROW = re.compile(r"\n(?![+-]?\d{1,3}(?:,\d{3})+(?:\.\d+)?\W*$)[!-+\--~]++(?:,[!-+\--~]*+)++(?=[ \t]*(?:$|…|\[|\())", re.MULTILINE)
_FIELD = "\x01"
_BREAKS = re.compile(r"[\r\n]\s*")
_SENTENCES = re.compile(r"[。！？!?.](?:(?<=\.)(?:\s+|$)|(?<!\.)\s*)")
_LINES = re.compile(r"[ \t　\xa0]+\n")
_CONTINUED = re.compile(r"\W*(?:未完待续|to be continued)\W*", re.IGNORECASE)
_TRAILING_MARK = re.compile(r"\s*(?:" + "|".join(re.escape(m) for m in sorted(MARKS, key=len, reverse=True)) + r")\s*$")

DEPTHS = (8, 4)

#: A word of a script that puts spaces between words: letters but those of Thai, Lao, Khmer and Myanmar, kana and Han.
_SPACED = r"[^\W\d_\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]"
_WORD = re.compile(_SPACED + "+")
_LAST_WORD = re.compile(r"(?<![\d_@/.\-\\])(?<!" + _SPACED + r")(" + _SPACED + r"+)\Z")


def plain(text: str) -> str:
    """The text with one form for numbers, digests and line ends, and none of the blanks at its end. Commas between fields stay."""
    out = _BREAKS.sub("\n", text.rstrip())
    if any(x in out for x in (" \n", "\t\n", "　\n", "\xa0\n")):
        out = _LINES.sub("\n", out)
    if "," in out:
        out = _ROW.sub(lambda m: m.group().replace(",", _FIELD), "\n" + out)[1:]
    return _NUMBER.sub("0", out).replace(_FIELD, ",")


def last_line(text: str) -> str:
    """The plain form of the text's last line, whatever its length."""
    end = text.rstrip()
    return plain(end[max(end.rfind("\n"), end.rfind("\r")) + 1 :])


def table_row(line: str) -> bool:
    """Whether a plain line is a row of a table of tabs, pipes or commas."""
    return "\t" in line or " | " in line or bool(_ROW.match("\n" + line))


def sentence(line: str) -> str:
    return line[:-1] if line.endswith(tuple("。.!?！？")) else line


def heads_of(lines: Iterable[str]) -> tuple[set[str], tuple[str, ...]]:
    """(first characters, beginnings up to the first number) that a raw line must have to be one of ``lines`` when plain."""
    heads = {w.partition("0")[0] for w in lines}
    heads = (heads - {""}) | (set("0123456789abcdef") if "" in heads else set())
    return {h[0] for h in heads}, tuple(sorted(heads))


def inside_counts(texts: Iterable[str], limits: dict[str, float]) -> Counter[str]:
    """How often each candidate (key of ``limits``) is a line or sentence of ``texts`` before their closing block, by ``sentence``.

    The closing block is as many candidates as a text ends with, each once: items of a list at the end repeat and are inside.
    Only what starts as a candidate does before its first number is made plain, and what was met more often than its limit
    isn't counted on, as more can't change that it is no closing line.
    """
    n: Counter[str] = Counter()
    most: dict[str, float] = {}
    for c, limit in limits.items():
        most[sentence(c)] = max(limit, most.get(sentence(c), 0))

    def met(line: str) -> bool:
        if (found := sentence(plain(line))) not in most:
            return False
        n[found] += 1
        return True

    (firsts, heads), (_, last_heads) = heads_of(most), heads_of(limits)
    for text in texts:
        lines, closing = _BREAKS.split(text.rstrip()), set()
        while lines and lines[-1].startswith(last_heads) and (line := plain(lines[-1])) in limits and line not in closing:
            closing.add(line)
            lines.pop()
        for line in lines:
            if line[:1] in firsts and line.startswith(heads) and met(line):
                continue
            for x in _SENTENCES.split(line):
                if x[:1] in firsts and x.startswith(heads):
                    met(x)
        if over := [w for w in most if n[w] > most[w]]:
            for w in over:
                del most[w]
            firsts, heads = heads_of(most)
    return n


def body(text: str, closings: frozenset[str]) -> tuple[str, bool]:
    """The plain text without closing lines and marks of a cut; whether it had such a mark.

    Closing lines are those many texts end with (footers, signatures, "to be continued"): what matters is whether the text
    before them is complete. A mark that is itself part of a closing line is none; a line that only says that more follows is a
    closing line however rare it is. The long mark "……" is the mark "…" twice.
    """
    out, marked = plain(text), False
    while out:
        head, _, line = out.rpartition("\n")
        if line in closings or _CONTINUED.fullmatch(line):
            out = head.rstrip()
        elif m := _TRAILING_MARK.search(out):
            out, marked = out[: m.start()].rstrip(), True
        else:
            break
    return out, marked


# Nodes -----------------------------------------------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_END = "\x00"


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def _nodes(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` codes before each place from ``k`` to the end."""
    n = len(codes) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * _BASE + codes[j : j + n]
    out ^= out >> np.uint64(29)
    return (out * _BASE).view(np.int64)


def tail_node(text: str, k: int) -> int | None:
    return int(_nodes(_codes(text[-k:]), k)[0]) if len(text) >= k else None


def pieces(text: str, k: int, chars: int) -> list[tuple[str, bool]]:
    """(piece, whether its last character is only there to be looked at): ``text`` in parts of ``chars`` places.

    A part begins ``k`` characters before its first place and ends one after its last, so that each place of the text is
    counted once, with the same window and the same surroundings whatever ``chars`` is.
    """
    if len(text) <= chars:
        return [(text, False)]
    return [(text[max(0, at - k) : at + chars + 1], at + chars < len(text)) for at in range(0, len(text), chars)]


def node_counts(parts: list[tuple[str, bool]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, times it went on, times it ended) over ``parts`` of plain texts (``pieces``); the texts' own ends count as neither."""
    codes = _codes(_END + _END.join(p for p, _ in parts) + _END + _END)
    if len(codes) < k + 3:
        return (np.zeros(0, np.int64),) * 3
    code = lambda chars: np.array([ord(c) + 1 for c in chars], np.uint64)
    stop = np.isin(codes, code("。!?！？\n"))
    dot = codes == code(".")[0]
    stop[:-1] |= dot[:-1] & np.isin(codes[1:], code(" \n" + _END))
    nodes = _nodes(codes[:-1], k)  # node i is before place i + k
    edges = np.flatnonzero(codes == code(_END)[0])
    counted = np.ones(len(nodes), bool)
    for j in range(k + 1):  # no window goes over an edge, and none ends at one
        at = edges - j
        counted[at[(at >= 0) & (at < len(nodes))]] = False
    looked_at = edges[1 : len(parts) + 1][np.array([x for _, x in parts], bool)] - 1
    counted[looked_at[looked_at >= k] - k] = False
    keys, total = _counts(nodes[counted])
    ends = np.zeros(len(keys), np.int64)
    ended, n = _counts(nodes[counted & stop[k:]])
    ends[np.searchsorted(keys, ended)] = n
    return keys, total - ends, ends


_WORD_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _word_nodes(word: str) -> Iterator[int]:
    """A hash of each beginning of a word, from its first letter to the whole."""
    h = 0x5BD1E995
    for c in word:
        h = ((h ^ ord(c)) * _WORD_BASE) & _MASK
        h ^= h >> 29
        yield h - (1 << 64) if h >> 63 else h


def words_of(text: str) -> tuple[list[str], int | None]:
    """(the words of spaced scripts in lower case, without one that the text ends in; the node of that one)."""
    found = _WORD.findall(text.lower())
    if not found or not _WORD.match(text[-1:]):
        return found, None
    last = _LAST_WORD.search(text.lower())
    if not last:
        return found[:-1], None
    node = 0
    for node in _word_nodes(last.group(1)):
        pass
    return found[:-1], node


def word_counts(words: Counter[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, times a word went on, times it ended) of every beginning of the counted words."""
    total: Counter[int] = Counter()
    ends: Counter[int] = Counter()
    for word, n in words.items():
        node = 0
        for node in _word_nodes(word):
            total[node] += n
        ends[node] += n
    keys = np.fromiter(total, np.int64, len(total))
    ended = np.fromiter((ends[k] for k in total), np.int64, len(total))
    return keys, np.fromiter(total.values(), np.int64, len(total)) - ended, ended


def _counts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and how often each occurs. Sorted, as that is several times faster than numpy's inverse."""
    ordered = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[first], np.diff(np.append(first, len(ordered)))


class Vocabulary:
    """The nodes of the texts that one task has read, merged until ``most`` of a depth are held; what leaves it is nodes, not places."""

    def __init__(self, depths: tuple[int, ...], chars: int, most: int):
        self.depths, self.chars, self.most = depths, chars, most
        self.held: dict[int, list] = {k: [] for k in depths}
        self.block: dict[int, list[tuple[str, bool]]] = {k: [] for k in depths}
        self.words: Counter[str] = Counter()
        self.size = 0

    def add(self, text: str, words: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
        """Takes a plain text's characters and words; gives nodes when there are too many to hold."""
        self.words.update(words)
        if len(self.words) > self.most // 8:
            yield word_counts(self.words)
            self.words = Counter()
        parts = {k: pieces(text, k, self.chars) for k in self.depths}
        for i in range(max(map(len, parts.values()))):
            for k in self.depths:
                self.block[k].append(parts[k][i])
            self.size += len(parts[self.depths[0]][i][0])
            if self.size >= self.chars:
                yield from self._count()

    def _merged(self, k: int) -> tuple[np.ndarray, ...]:
        nodes, on, ends = (np.concatenate(x) for x in zip(*self.held[k]))
        keys, inverse = np.unique(nodes, return_inverse=True)
        return keys, *(np.bincount(inverse, weights=x, minlength=len(keys)).astype(np.int64) for x in (on, ends))

    def _count(self) -> Iterator[tuple[np.ndarray, ...]]:
        for k in self.depths:
            self.held[k].append(node_counts(self.block[k], k))
            self.block[k] = []
            if sum(len(x[0]) for x in self.held[k]) > self.most:
                self.held[k] = [self._merged(k)]
                if len(self.held[k][0][0]) > self.most // 2:
                    yield self.held[k].pop()
        self.size = 0

    def rest(self) -> Iterator[tuple[np.ndarray, ...]]:
        if self.size:
            yield from self._count()
        for k in self.depths:
            if self.held[k]:
                yield self._merged(k)
        if self.words:
            yield word_counts(self.words)


# Length evidence -------------------------------------------------------------------------------------------------


def usual_limits(texts: DataFrame, source: str, length: str, share: float = 0.01, least: int = 5, times: float = 10.0) -> DataFrame:
    """(source, length): lengths that stand out in their source: at least ``share`` of its texts and ``least`` of them, and ``times``
    as many as the mean of the lengths within a tenth of it.

    Works on the counts by source and length, of which a source has no more than its longest text has characters.
    """
    counts = texts.groupBy(F.col(source).alias("_s"), F.col(length).alias("_l")).agg(F.count("*").alias("_n")).where("_l > 0")
    near = Window.partitionBy("_s").orderBy(F.floor(F.ln("_l") * 1000)).rangeBetween(-100, 100)
    mean = (F.sum("_n").over(near) - F.col("_n")) / F.greatest(F.col("_l") * 0.2, F.lit(1.0))
    total = F.sum("_n").over(Window.partitionBy("_s"))
    marked = counts.select("*", mean.alias("_mean"), total.alias("_total"))
    stands_out = (F.col("_n") >= least) & (F.col("_n") >= share * F.col("_total")) & (F.col("_n") > times * F.col("_mean"))
    return marked.where(stands_out).select(F.col("_s").alias(source), F.col("_l").alias(length))


def source_name(c: Column | str) -> Column:
    """One spelling of a source: lower case, trimmed, ``_`` for ``-`` and blanks."""
    return F.regexp_replace(F.lower(squeeze(c)), r"[-\s]+", "_")


# Closing lines ---------------------------------------------------------------------------------------------------


def _digest(line: str) -> bytes:
    return hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def closing_lines(texts: DataFrame, text: str, share: float, least: int = 3, inside: float = 0.05, inline: int = 1000) -> frozenset[str]:
    """The plain lines that at least ``share`` of ``texts`` and ``least`` of them end with, that are no rows of tables and that
    occur elsewhere in texts at most ``inside`` times as often. At most 1 / ``share`` lines are looked for and come to the driver.

    Lines are counted at full length by a digest; one of more than ``inline`` characters is fetched only once it is known to be
    frequent, so that texts that are one long line don't move.
    """

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            lines = [line if len(line) <= inline else None for line in n]
            return pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in n], pa.binary()), pa.array(lines, pa.string()), pa.array(list(n.values()), pa.int64())], ["digest", "line", "n"])

        n: Counter[str] = Counter()
        for one in batches:
            n.update(last_line(t) for t in one.column(0).to_pylist())
            if len(n) > 20000:
                yield out()
                n.clear()
        if n:
            yield out()

    lines = texts.select(text).mapInArrow(ends, "digest binary, line string, n bigint").groupBy("digest", "line").agg(F.sum("n").alias("n"))
    total = lines.agg(F.sum("n").alias("all"))
    frequent = lines.join(F.broadcast(total)).where(F.col("n") >= F.greatest(F.lit(share) * F.col("all"), F.lit(least))).select("digest", "line", "n").collect()
    last = {r.line: r.n for r in frequent if r.line is not None}
    if long := {bytes(r.digest): r.n for r in frequent if r.line is None}:

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met: dict[bytes, str] = {}
            for one in batches:
                for t in one.column(0).to_pylist():
                    if len(line := last_line(t)) > inline and (d := _digest(line)) in long:
                        met[d] = line
            yield pa.RecordBatch.from_arrays([pa.array(list(met.values()), pa.string())], ["line"])

        last |= {r.line: long[_digest(r.line)] for r in texts.select(text).mapInArrow(fetch, "line string").distinct().collect()}
    last = {line: n for line, n in last.items() if line and not table_row(line)}
    if not last:
        return frozenset()
    limits = {line: inside * n for line, n in last.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = inside_counts((t for one in batches for t in one.column(0).to_pylist()), limits)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["line", "n"])

    met = texts.select(text).mapInArrow(count, "line string, n bigint").groupBy("line").agg(F.sum("n").alias("n"))
    found = {r.line: r.n for r in met.collect()}
    return frozenset(line for line, limit in limits.items() if found.get(sentence(line), 0) <= limit)


# Detection -------------------------------------------------------------------------------------------------------


def read_corpus(rows: DataFrame, closings: frozenset[str], depths: tuple[int, ...] = DEPTHS, chars: int = 2_000_000, most: int = 2_000_000) -> DataFrame:
    """One pass over (_key, _source, _text): a row per text with the kind of its end, the nodes there and its lengths, and rows of
    vocabulary nodes (``nodes``, ``on``, ``ends`` as arrays, all else null) over whole texts without their closing lines."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    fields = ["_key", "_source", "kind", *[f"node{k}" for k in depths], "word_node", "chars", "octets", "nodes", "on", "ends"]
    arrow = [pa.string(), *[pa.int64()] * (len(depths) + 1), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    measured = rows.withColumns({"chars": F.length("_text"), "octets": F.octet_length("_text")})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Vocabulary(depths, chars, most)
        kinds: list[pa.DataType] = []

        def nodes(found: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(found[0]), 65536):
                three = [[x[at : at + 65536]] for x in found]
                empty = [pa.nulls(1, kinds[0]), pa.nulls(1, kinds[1]), *[pa.nulls(1, t) for t in arrow[:-3]]]
                yield pa.RecordBatch.from_arrays([*empty, *[pa.array(x, t) for x, t in zip(three, arrow[-3:])]], fields)

        for one in batches:
            kinds[:] = [one.column(0).type, one.column(1).type]
            kind, ends, last = [], {k: [] for k in depths}, []
            for t in one.column(2).to_pylist():
                out, marked = body(t or "", closings)
                words, word_node = words_of(out) if out else ([], None)
                kind.append("blank" if not out else "stop" if out[-1] in STOPS else "character" if out[-1] == "�" else "mark" if marked else "open")
                asked = kind[-1] == "open"
                for k in depths:
                    ends[k].append(tail_node(out, k) if asked else None)
                last.append(word_node if asked else None)
                if out:
                    for found in seen.add(out, words):
                        yield from nodes(found)
            n = one.num_rows
            yield pa.RecordBatch.from_arrays(
                [one.column(0), one.column(1), pa.array(kind, pa.string()), *[pa.array(ends[k], pa.int64()) for k in depths], pa.array(last, pa.int64()),
                 one.column(3), one.column(4), *[pa.nulls(n, t) for t in arrow[-3:]]], fields)
        for found in seen.rest():
            yield from nodes(found)

    shape = ", ".join([
        f"_key {types['_key']}, _source string, kind string", *[f"node{k} bigint" for k in depths], "word_node bigint, chars int, octets int, nodes array<bigint>, on array<int>, ends array<int>"])
    return measured.mapInArrow(read, shape)


def truncated(texts: DataFrame, key: str, text: str, source: str, closing_share: float = 0.001, support: int = 3, ends_share: float = 0.05,
              known_share: float = 0.002, chars: int = 2_000_000) -> DataFrame:
    """(key, source, cut, evidence): whether each text was cut before its end, with the evidence.

    ``evidence`` is ``character`` (cut within a character), ``mark`` (a mark of a cut follows), ``prefix`` (its last word, in a script with
    spaces, is unknown, or no more than ``known_share`` of the ``support`` words or more that begin so), ``word`` (the deepest node of
    characters at its end that was met ``support`` times went on all but ``ends_share`` of the times), ``length`` (a length at which
    its source cuts, and no stop at the end), or null. Null and blank texts aren't cut. A text that just has no
    final stop ends in a node that ends elsewhere and isn't cut. Repeated rows and keys stay repeated; a null source is a source.

    Closing lines are those that at least ``closing_share`` of all texts end with and that hardly occur elsewhere (``closing_lines``): at
    most 1 / ``closing_share`` lines, so they may go to every task. The corpus is read three times: for the lines it ends with, for
    those lines inside texts, and for ends and vocabulary together, which are written once. ``chars`` bounds what a task counts at a
    time and changes no result. Texts meet the vocabulary in a join by node; a node that many texts end in is split by AQE.
    """
    rows = texts.select(F.col(key).alias("_key"), source_name(source).alias("_source"), F.col(text).alias("_text"))
    closings = closing_lines(rows.where(F.length(F.trim("_text")) > 0), "_text", closing_share)
    once = checkpoint(read_corpus(rows, closings, DEPTHS, chars))
    tails = once.where("kind is not null").drop("nodes", "on", "ends")
    known = (
        once.where("nodes is not null").select(F.inline(F.arrays_zip("nodes", "on", "ends"))).groupBy(F.col("nodes").alias("node"))
        .agg(F.sum("on").alias("on"), F.sum("ends").alias("ends"))
    )
    out = tails
    for name in (*[f"node{k}" for k in DEPTHS], "word_node"):
        # The same plan for each, so that the vocabulary is counted once and its exchange used again.
        right = known.select(F.col("node").alias(name), F.struct("on", "ends").alias(f"seen_{name}"))
        out = out.join(right, name, "left")
    deepest = F.coalesce(*[F.when(F.col(f"seen_node{k}.on") + F.col(f"seen_node{k}.ends") >= support, F.col(f"seen_node{k}")) for k in DEPTHS])
    for measure in ("chars", "octets"):
        spikes = usual_limits(tails.select("_source", measure), "_source", measure)
        right = spikes.select(F.col("_source").alias("_s"), F.col(measure).alias("_m"), F.lit(True).alias(f"at_{measure}"))
        out = out.join(right, F.col("_source").eqNullSafe(F.col("_s")) & (F.col(measure) == F.col("_m")), "left").drop("_s", "_m")
    window = deepest["ends"] <= ends_share * (deepest["on"] + deepest["ends"])
    begun = F.col("seen_word_node.on") + F.col("seen_word_node.ends")
    prefix = (begun >= support) & (F.col("seen_word_node.ends") <= known_share * begun)
    evidence = (
        F.when(F.col("kind").isin("character", "mark"), F.col("kind"))
        .when((F.col("kind") == "open") & prefix, "prefix")
        .when((F.col("kind") == "open") & window, "word")
        .when((F.col("kind") == "open") & (F.col("at_chars") | F.col("at_octets")), "length")
    )
    return out.select(F.col("_key").alias(key), F.col("_source").alias(source), evidence.isNotNull().alias("cut"), evidence.alias("evidence"))


def rates(found: DataFrame, source: str) -> DataFrame:
    """(source, texts, cut, rate): how often each source cuts."""
    return found.groupBy(source).agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut")).withColumn("rate", F.col("cut") / F.col("texts"))
