"""Several values packed in one text, by dialects of minimum description length.

A dialect is a set of separating marks and a quote sign. Every text is parsed
by each dialect its own marks allow; the values of all these parses are
counted over the distinct texts of the whole table, and a value's code length
follows from its count. The codebook holds the values that at least two texts
have, all others are spelled out. A text's dialect is the one under which
values, marks and quotes take the fewest bits; only that parse is kept.

The codebook stays distributed: each text is given the counts of the values of
its own parses by a join, so that no process holds more than one text's part.
A text is parsed once; the rounds that fit the codebook only weigh its parses
again. Every set of the marks that a text has is tried, however many it has.

Defined results: null and blank texts yield no row; empty values have no
position; a text that is a list literal yields its elements; quotes that don't
open a value belong to it; repeated values and rows are kept.
"""

from __future__ import annotations

import ast
import bisect
import itertools
import json
import marshal
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinworks.session import discard, written

ROUNDS = 2
#: The number of values of all parses over which a value's uses count as frequent is divided by this; so at most as many values do.
FREQUENT = 50_000
#: The parses of a text with at most so many different marks are kept between the rounds; those of others are made again each time.
KEPT_MARKS = 6
# The marks that can separate. Hyphen, dash and slash need blanks around them.
_MARK = re.compile(r"\\.|->|::|\r\n?|[\n\t,;|>»•\"']|(?:(?<=\s)|^)[-–/](?=\s|$)", re.S)
_QUOTES = "\"'"
_BITS = {"char": 5.0, "literal": 6.0, "mark": 1.0, "quoted": 2.0, "empty": 2.0}
#: How often a mark stands inside a value before that is counted.
_INNER = 1 / 32


def _marks(text: str) -> list[tuple[int, int, str]]:
    """Where marks, quotes and escapes stand; commas between digits are none."""
    out = []
    for m in _MARK.finditer(text):
        a, b, mark = m.start(), m.end(), m[0]
        if mark == "," and 0 < a and b < len(text) and text[a - 1].isdigit() and text[b].isdigit():
            continue
        out.append((a, b, "\n" if mark[0] == "\r" else mark))
    return out


def _plain(text: str) -> str:
    return (re.sub(r"\\([^\w\s])", r"\1", text) if "\\" in text else text).strip()


def _closing(text: str, at: int, marks: list[tuple[int, int, str]], first: int, chosen: frozenset[str], quote: str) -> tuple[int, int] | None:
    """The end of the quote opened at ``at``, and the index of the mark after it: it must end the value."""
    k = first
    while k < len(marks):
        a, b, mark = marks[k]
        if mark == quote:
            if text[b : b + 1] == quote:  # doubled
                k += 2
                continue
            rest = k + 1
            while rest < len(marks) and marks[rest][2] not in chosen and not text[b : marks[rest][0]].strip() and marks[rest][2] in "\n\t":
                rest += 1
            stop = marks[rest][0] if rest < len(marks) and marks[rest][2] in chosen else len(text)
            if not text[b:stop].strip():
                return a, rest
        k += 1
    return None


def _starts(text: str, at: int, ends: list[int]) -> bool:
    """Whether a value begins at ``at``, ``ends`` being where the marks before values end."""
    k = bisect.bisect_right(ends, at)
    return not text[ends[k - 1] if k else 0 : at].strip()


def split(text: str, marks: list[tuple[int, int, str]], chosen: frozenset[str], quote: str) -> tuple[list[str], int, int, list[str]]:
    """(values, quoted, empty, marks that stand unprotected inside values) of one parse."""
    values: list[str] = []
    inner: list[str] = []
    if not quote and "\\" not in text:  # nothing is protected: the chosen marks cut the text
        cuts = [m for m in marks if m[2] in chosen]
        ends = [b for _, b, _ in cuts]
        parts = [text[a:b].strip() for a, b in zip([0, *(m[1] for m in cuts)], [*(m[0] for m in cuts), len(text)])]
        values = [p for p in parts if p]
        inner = [m for a, _, m in marks if m not in chosen and (m not in _QUOTES or _starts(text, a, ends))]
        return values, 0, len(parts) - len(values), inner
    quoted = empty = k = start = 0
    closable = bool(quote)  # a quote that nothing closes leaves none for those after it
    while start <= len(text):
        if closable and k < len(marks) and marks[k][2] == quote and not text[start : marks[k][0]].strip():
            end = _closing(text, marks[k][0], marks, k + 1, chosen, quote)
            closable = end is not None
            if end:
                value = text[marks[k][1] : end[0]].replace(quote * 2, quote)
                value = _plain(value)
                quoted += 1
                empty += not value
                values += [value] if value else []
                k = end[1]
                if k >= len(marks) or marks[k][2] not in chosen:
                    return values, quoted, empty, inner
                start, k = marks[k][1], k + 1
                continue
        while k < len(marks) and marks[k][2] not in chosen:
            mark = marks[k][2]
            if mark[0] != "\\" and (mark not in _QUOTES or not text[start : marks[k][0]].strip()):
                inner.append(mark)
            k += 1
        stop = marks[k][0] if k < len(marks) else len(text)
        value = _plain(text[start:stop])
        empty += not value
        values += [value] if value else []
        if k >= len(marks):
            break
        start, k = marks[k][1], k + 1
    return values, quoted, empty, inner


def list_literal(text: str) -> list[str] | None:
    """The elements of a text that is a list literal, or None."""
    text = text.strip()
    if not (text.startswith("[") and text.endswith("]")):
        return None
    for read in (json.loads, ast.literal_eval):
        try:
            got = read(text)
        except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
            continue
        if isinstance(got, (list, tuple)):
            parts = [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, default=str) for x in got if x is not None]
            return [p.strip() for p in parts if p.strip()]
    return None


def dialects(marks: list[tuple[int, int, str]], text: str, quoted: bool = False) -> Iterator[tuple[frozenset[str], str]]:
    """The dialects that the marks of ``text`` allow: every set of its marks, with every quote that opens a value; with ``quoted``, not those without quotes."""
    present = sorted({m for _, _, m in marks if m not in _QUOTES and m[0] != "\\"})
    quotes = [*([] if quoted else [""]), *(q for q in _QUOTES if any(m == q and _opens(text, a, marks, k) for k, (a, _, m) in enumerate(marks)))]
    for n in range(len(present) + 1):
        for chosen in itertools.combinations(present, n):
            for quote in quotes:
                yield frozenset(chosen), quote


def _opens(text: str, at: int, marks: list[tuple[int, int, str]], k: int) -> bool:
    return not text[marks[k - 1][1] if k else 0 : at].strip()


#: A parse: the numbers of its values, the bits that no codebook changes, the marks inside values and those that work, each with its number, and how many marks are chosen (negative), whether quotes are taken at their word.
Parse = tuple[tuple[int, ...], float, tuple[tuple[str, int], ...], tuple[tuple[str, int], ...], int, bool]


def _counted(marks: list[str]) -> tuple[tuple[str, int], ...]:
    return tuple((m, marks.count(m)) for m in dict.fromkeys(marks)) if len(marks) < 50 else tuple(Counter(marks).items())


def parses(text: str, numbers: dict[str, int], marks: list[tuple[int, int, str]] | None = None) -> Iterator[Parse]:
    """Every parse of ``text``; ``numbers`` gets the values that come up, numbered as they come."""
    elements = list_literal(text)
    if elements is not None:
        yield tuple([numbers.setdefault(v, len(numbers)) for v in elements]), 0.0, (), (), 0, True
        return
    marks = _marks(text) if marks is None else marks
    plain = "\\" not in text
    if plain:
        yield from _plain_parses(text, numbers, marks)
    for chosen, quote in dialects(marks, text, plain):
        got, quoted, empty, inner = split(text, marks, chosen, quote)
        between = [m for _, _, m in marks if m in chosen]
        fixed = _BITS["mark"] * len(chosen) + _BITS["quoted"] * quoted + _BITS["empty"] * empty + (math.log2(len(chosen)) * len(got) if len(chosen) > 1 else 0.0)
        yield tuple([numbers.setdefault(v, len(numbers)) for v in got]), fixed, _counted(inner), _counted(between) + (((quote, quoted),) if quoted else ()), -len(chosen), bool(quote)


def _plain_parses(text: str, numbers: dict[str, int], marks: list[tuple[int, int, str]]) -> Iterator[Parse]:
    """parses() of a text without escapes by the dialects without quotes: the sets share the pieces between two marks."""
    often = Counter(m for _, _, m in marks if m not in _QUOTES)
    signs = len(often) < len({m for _, _, m in marks})
    present, length = sorted(often), len(text) + 1
    pieces: dict[int, int] = {}
    for n in range(len(present) + 1):
        for chosen in itertools.combinations(present, n):
            got, start, empty = [], 0, 0
            opening: dict[str, int] = {}
            for a, b, m in (*marks, (len(text), 0, None)):
                if m is None or m in chosen:
                    at = start * length + a
                    value = pieces.get(at)
                    if value is None:
                        plain = text[start:a].strip()
                        value = pieces[at] = numbers.setdefault(plain, len(numbers)) if plain else -1
                    if value < 0:
                        empty += 1
                    else:
                        got.append(value)
                    start = b
                elif signs and m in _QUOTES and not text[start:a].strip():
                    opening[m] = opening.get(m, 0) + 1
            fixed = _BITS["mark"] * n + _BITS["empty"] * empty + (math.log2(n) * len(got) if n > 1 else 0.0)
            yield tuple(got), fixed, (*[(m, often[m]) for m in present if m not in chosen], *opening.items()), tuple([(m, often[m]) for m in chosen]), -n, False


class Codebook:
    """Code lengths of values and marks, and the parse of a text that takes the fewest bits.

    The code is one of two parts: each use of a value also bears its share of
    the entry's spelling. ``counts``: of values; ``total``: of all values; ``inside`` and ``between``: how often each mark stood
    inside a value and between two.
    """

    def __init__(self, counts: dict[str, int], total: int, inside: dict[str, int], between: dict[str, int]) -> None:
        self.total = max(1, total)
        self.know(counts)
        rate = {m: (inside.get(m, 0) + _INNER) / (inside.get(m, 0) + between.get(m, 0) + 1) for m in {*inside, *between}}
        self.inside = {m: -math.log2(r) for m, r in rate.items()}
        self.between = {m: -math.log2(1 - r) for m, r in rate.items()}

    def know(self, counts: dict[str, int]) -> None:
        """Takes the counts of the values that the next texts can have."""
        self.counts = counts

    def length(self, value: str) -> float:
        """Bits of one use of a value: its entry's code and share of spelling, or spelled out."""
        spelled = _BITS["literal"] + _BITS["char"] * len(value)
        n = self.counts.get(value)
        return min(spelled, math.log2(self.total / n) + spelled / n) if n else spelled

    def cheapest(self, found: Iterable[Parse], bits: list[float]) -> Parse:
        """The parse of fewest bits, ``bits`` being those of the values; of equal ones the one of most marks."""
        seldom, inside, between = -math.log2(_INNER), self.inside, self.between
        best, least = None, (math.inf, 0)
        for parse in found:
            got, cost, inner, working, chosen, _ = parse
            if cost > least[0]:
                continue
            for m, n in inner:
                cost += n * inside.get(m, seldom)
            for m, n in working:
                if m not in _QUOTES:
                    cost += n * between.get(m, 0.0)
            if cost > least[0]:
                continue
            cost += sum(map(bits.__getitem__, got))
            if (cost, chosen) < least:
                best, least = parse, (cost, chosen)
        return best

    def parse(self, text: str) -> tuple[str, ...]:
        """The values of the cheapest parse."""
        if not text.strip():
            return ()
        numbers: dict[str, int] = {}
        found = list(parses(text, numbers))
        names = list(numbers)
        return tuple(names[i] for i in self.cheapest(found, [self.length(v) for v in names])[0])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, schema.types, strict=True)], schema=schema)


_OFFER = pa.schema([("id", pa.int64()), ("field", pa.string()), ("text", pa.string()), ("names", pa.list_(pa.string())), ("first", pa.list_(pa.bool_())), ("most", pa.int64()), ("kept", pa.binary())])


def _offered(texts: DataFrame) -> DataFrame:
    """(id, field, text, names, first, most, kept): the values of all parses of each text, whether they are counted first, the
    most values of a parse that is, and the parses, as bytes that only a later round reads."""

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names_, first_, most_, kept_ = [], [], [], []
            for t in batch.column(2).to_pylist():
                numbers: dict[str, int] = {}
                marks = _marks(t)
                keep = len({m for _, _, m in marks}) <= KEPT_MARKS
                found = parses(t, numbers, marks)
                found = list(found) if keep else found
                # Quotes that open values are first taken at their word; where there are none, all parses count.
                quoted: set[int] = set()
                plain: set[int] = set()
                most = [0, 0]
                for got, _, _, _, _, by_quote in found:
                    (quoted if by_quote else plain).update(got)
                    most[by_quote] = max(most[by_quote], len(got))
                counted = quoted or plain
                names_.append(list(numbers)), first_.append([n in counted for n in range(len(numbers))])
                most_.append(most[bool(quoted)]), kept_.append(marshal.dumps((names_[-1], found)) if keep else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, kind) for c, kind in zip((names_, first_, most_, kept_), _OFFER.types[3:], strict=True))], schema=_OFFER)

    return texts.select("id", "field", "text").mapInArrow(offer, "id bigint, field string, text string, names array<string>, first array<boolean>, most bigint, kept binary")


def _read(text: str, kept: bytes | None) -> tuple[list[str], list[Parse]]:
    if kept is not None:
        return marshal.loads(kept)
    numbers: dict[str, int] = {}
    found = list(parses(text, numbers))
    return list(numbers), found


def _sums(rows: DataFrame) -> tuple[dict, dict, dict]:
    """Totals of values by field, and of marks inside and between by field and mark: as many rows as there are fields and marks."""
    out: tuple[dict, dict, dict] = {}, {}, {}
    for r in rows.groupBy("kind", "field", F.when(F.col("kind") > 0, F.col("value")).alias("value")).agg(F.sum("n").alias("n")).collect():
        out[r["kind"]].setdefault(r["field"], {})[r["value"]] = r["n"]
    return out


def _books(sums: tuple[dict, dict, dict]) -> dict[str, Codebook]:
    totals, inside, between = sums
    return {f: Codebook({}, totals.get(f, {}).get(None, 0), inside.get(f, {}), between.get(f, {})) for f in {*totals, *inside, *between}}


def _weighed(texts: DataFrame, candidates: DataFrame, counts: DataFrame, frequent: DataFrame, sums: tuple[dict, dict, dict], final: bool = False) -> tuple[DataFrame, dict[str, Codebook], dict[str, dict[str, int]]]:
    """The texts with the counts of their rare values, the codebooks, and the counts of the frequent values by field."""
    often: dict[str, dict[str, int]] = {}
    for r in counts.join(frequent, ["field", "value"], "left_semi").collect():  # at most FREQUENT values
        often.setdefault(r["field"], {})[r["value"]] = r["n"]
    known = candidates.join(counts, ["field", "value"]).groupBy("id").agg(F.collect_list("value").alias("known"), F.collect_list("n").alias("n"))
    text = F.when(F.col("kept").isNull(), F.col("text")).alias("text")
    return texts.join(known, "id", "left").select("field", "text" if final else text, "kept", "known", "n"), _books(sums), often


def _chosen(batches: Iterator[pa.RecordBatch], books: dict[str, Codebook], often: dict[str, dict[str, int]]) -> Iterator[list[tuple[str, str, list[str], Parse]]]:
    """(field, text, values by number, cheapest parse) of each text, batch by batch."""
    empty = Codebook({}, 1, {}, {})
    lengths: dict[str, dict[str, float]] = {}
    for f, counts in often.items():
        book = books.get(f, empty)
        book.know(counts)
        lengths[f] = {v: book.length(v) for v in counts}
    for batch in batches:
        out = []
        for f, t, kept, values_, n in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            book, common = books.get(f, empty), lengths.get(f, {})
            book.know(dict(zip(values_, n, strict=True)) if values_ else {})
            names, found = _read(t, kept)
            out.append((f, t, names, book.cheapest(found, [common[v] if v in common else book.length(v) for v in names])))
        yield out


def _round(texts: DataFrame, candidates: DataFrame, counts: DataFrame, frequent: DataFrame, sums: tuple[dict, dict, dict]) -> DataFrame:
    """(field, kind, value, n): sums over the cheapest parses, combined by batch: 0 a value by texts that have it, 1 a mark inside values, 2 a mark between."""
    rows, books, often = _weighed(texts, candidates, counts, frequent, sums)
    out = pa.schema([("field", pa.string()), ("kind", pa.int32()), ("value", pa.string()), ("n", pa.int64()), ("uses", pa.int64())])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chosen in _chosen(batches, books, often):
            seen: dict[tuple, int] = {}
            uses: dict[tuple, int] = {}
            for f, _, names, (got, _, inner, working, *_) in chosen:
                for i in got:
                    uses[f, 0, names[i]] = uses.get((f, 0, names[i]), 0) + 1
                for i in set(got):
                    seen[f, 0, names[i]] = seen.get((f, 0, names[i]), 0) + 1
                for kind, marks in ((1, inner), (2, working)):
                    for m, n in marks:
                        seen[f, kind, m] = seen.get((f, kind, m), 0) + n
            yield _batch([(*k, n, uses.get(k, n)) for k, n in seen.items()], out)

    return rows.mapInArrow(tally, "field string, kind int, value string, n bigint, uses bigint")


def parsed(rows: DataFrame, field: str, text: str) -> DataFrame:
    """(field, text, got): the values of every distinct text of every field."""
    texts = rows.where(F.col(text).isNotNull()).select(F.col(field).alias("field"), F.col(text).alias("text")).distinct()
    texts = written(texts.withColumn("id", F.monotonically_increasing_id()), "texts")
    offered = written(_offered(texts), "offered")
    named = offered.select("id", "field", F.inline(F.arrays_zip(F.col("names").alias("value"), F.col("first").alias("first"))))
    # A value of one text's parses only can never have two texts; it needs no entry and takes no further part.
    shared = written(named.groupBy("field", "value").agg(F.count("*").alias("all"), F.count_if("first").alias("n")).where("all >= 2"), "shared")
    every = shared.agg(F.sum("all").alias("n")).first()["n"] or 0
    # Values that often come up go to all tasks, of which there can be FREQUENT at most; the others are joined to their texts.
    is_frequent = F.col("all") > every / FREQUENT
    frequent = shared.where(is_frequent).select("field", "value")
    candidates = written(named.join(shared.where(~is_frequent).select("field", "value"), ["field", "value"]).select("id", "field", "value"), "candidates")
    sums = _sums(offered.select("field", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("value"), F.col("most").alias("n")))
    counts = shared.select("field", "value", "n").where("n >= 2")
    done = []
    for _ in range(ROUNDS):
        done.append(written(_round(offered, candidates, counts, frequent, sums), "round"))
        counts = done[-1].where("kind = 0").groupBy("field", "value").agg(F.sum("n").alias("n")).where("n >= 2")
        sums = _sums(done[-1].select("field", "kind", "value", F.when(F.col("kind") == 0, F.col("uses")).otherwise(F.col("n")).alias("n")))
    last, books, often = _weighed(offered, candidates, counts, frequent, sums, final=True)
    out = pa.schema([("field", pa.string()), ("text", pa.string()), ("got", pa.list_(pa.string()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chosen in _chosen(batches, books, often):
            yield _batch([(f, t, [names[i] for i in parse[0]]) for f, t, names, parse in chosen], out)

    got = written(last.mapInArrow(read, "field string, text string, got array<string>"), "got")
    discard(texts, offered, shared, candidates, *done)
    return got


def values(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, pos, val): one row for each value of each packed field, positions from 1."""
    named = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields]
    long = rows.select(F.col(key).alias("key"), F.inline(F.array(*named))).where("trim(text) <> ''")
    found = long.join(parsed(long, "field", "text"), ["field", "text"])
    out = found.select("key", "field", F.posexplode("got").alias("pos", "val"))
    return out.select(F.col("key").alias(key), "field", (F.col("pos") + 1).cast("bigint").alias("pos"), "val")
