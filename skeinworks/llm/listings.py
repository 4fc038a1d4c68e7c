"""Listings that sell the same drive model, by probabilistic record linkage.

1. Attributes are parsed from title, part number, model, brand and aspects:
   series code, capacity in gigabytes, interface and maker. How part numbers
   are built is not known beforehand but learnt from the listings: wherever a
   part number contains a word that its title has on its own and the size that
   its title states, both are cut out, and what is left is a structure. The
   structures, the shapes of the words, the sizes and the interface each
   structure goes with are counted over all listings.
2. Listings with the same attributes form a class, so that blocks compare
   classes and not all their copies.
3. Classes are compared within blocks (the same code; the same digits of the
   code with the same capacity and interface), field by field: agree, close,
   differ, unknown. So is each class with itself.
4. Fellegi-Sunter weights of the fields are fitted by expectation-maximisation
   over the counts of the patterns of each block, each weighted by the pairs of
   listings it stands for.
5. Pairs that are more probably a match than not are links; nothing but the
   fitted weights decides that. They are clustered to groups by connected
   components. Listings of a class whose own pattern is no link stay single.

Defined results: a listing without a series code, or of an accessory, is in no
group; a part number of no learnt structure is itself the code; unknown fields
neither help nor hurt; hints without meaning count as unknown; repeated rows of
an id count once, the last seen one.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.functions.units import number
from skeinworks.session import discard, written

THRESHOLD = 0.5
FIELDS = ("maker", "code", "capacity", "interface")
#: The fields that define a model.
DEFINING = ("code", "capacity", "interface")
#: The least share of matches that agree in a defining field: it tells the matches from other clusters of pairs.
AGREEING = 0.95
_EM_ROUNDS, _EM_STOP = 200, 1e-9
#: The share of all evidence of its kind from which on a structure, shape or size counts as one. At most 1 / share of them are held.
SHARE = {"part": 2e-3, "code": 2e-3, "word": 2e-2, "size": 2e-3}
#: The share that a code must have of all numbers typed beside its letters, where it is never typed in one piece.
_RARE = 0.05
#: The share of the listings of a structure that must have its interface.
_PURE = 0.8

_D = "[0-9OIL]"
#: What a letter typed for a digit counts against a reading; an L is seldom meant for a 1.
_SLIP = {"O": 1.0, "I": 1.0, "L": 2.0}
#: The interfaces by the words of titles.
_INTERFACE_WORDS = (("SATA", re.compile(r"\bs-?ata", re.I)), ("SAS", re.compile(r"\bsas(?:\b|[- ]?[1-4])", re.I)), ("NVMe", re.compile(r"\bnvme|\bpcie|\bu\.2\b", re.I)))
#: Words of listings that sell a part of a drive or something for it.
_ACCESSORY = re.compile(
    r"\b(?:caddy|caddies|tray|trays|sled|screws?|mounting|bracket|rails?|adapter|adaptor|cable|cables|enclosure|controller board|pcb|board only|no drive|without drive|drive not included|retail box|empty box|packaging only|box only|label only|heatsink|backplane|spare parts? for|halterung|rahmen|schrauben|adaptateur|câble|tornillos|bandeja|leerkarton|boîte vide)\b",
    re.I,
)
#: Hints without meaning.
_EMPTY = frozenset("na n/a none null unknown unbranded nobrand generic generisch doesnotapply notapplicable seetitle seedescription hdd ssd drive oem various houselabel 0 nichtzutreffend sinmarca".split())
_LEGAL = re.compile(r"\b(?:inc|corp|corporation|ltd|llc|gmbh|co|company|technologies|technology|systems|storage|drives|digital|labs|data|memory|international|group)\b\.?|\(r\)|®|™", re.I)
_GB = re.compile(r"(?<![\w.,/-])(\d+(?:[.,]\d+)*)[ -]*(tb|tib|gb|gib|to|go|t|terabytes?|gigabytes?|teraoctets?|gigaoctets?)(?![\w/])", re.I)
_CACHE = re.compile(r"(?:cache|buffer)\W*\d+\W*[mg]b|\d+\W*[mg]b\W*(?:cache|buffer)", re.I)
_SIZE_TOKEN = re.compile(r"\d+[.,]\d+-?(?:t|tb|gb|to|go)|\d{1,2}-?(?:t|to)|\d+-?(?:tb|gb|go)", re.I)
#: Units of sizes, with how many gigabytes they are where drives have them.
_SIZE_UNITS = {"GB": 1, "GO": 1, "TB": 1000, "TO": 1000, "MB": None, "MO": None, "KB": None}
_NOT_PLAIN = re.compile(r"[^A-Z0-9]")
_ENDING = re.compile(r"[_#]")
#: A word that can be a series code, and one that can be a whole model number.
_CODE_WORD = re.compile(r"[A-Z]{1,8}\d{3,6}[A-Z]{0,3}|\d{3,6}[A-Z]{1,3}")
_MODEL_WORD = re.compile(r"(?=(?:\D*\d){2})(?=(?:[^A-Z]*[A-Z]){2})[A-Z0-9]{7,}")
_DIGIT = re.compile(r"\d")


def _squeezed(text: str) -> str:
    return _NOT_PLAIN.sub("", text.upper())


def _part_text(text: str) -> str:
    """A part number without the ending of a seller."""
    return _ENDING.split(text, maxsplit=1)[0]


def _mask(word: str) -> str:
    return "".join("D" if c.isdigit() else "L" for c in word)


def _is_amount(word: str) -> bool:
    """Whether a word is a size or a speed of turning."""
    return word.endswith("RPM") or word[-2:] in _SIZE_UNITS and word[:-2].isdigit()


def _digits(text: str) -> str:
    return text.translate(str.maketrans("OIL", "011"))


def _slips(text: str) -> float:
    return sum(_SLIP.get(c, 0.0) for c in text)


def _round_size(gigabytes: int) -> bool:
    """Whether a size is written with at most three digits but for zeros."""
    return len(str(gigabytes).rstrip("0")) <= 3


def _spellings(gigabytes: int) -> list[tuple[str, str]]:
    """How part numbers write a size, the longest first: t in three digits of tenths or hundredths of a terabyte, g in gigabytes, p in terabytes with a letter for the point, b in whole terabytes."""
    out = [("g", str(gigabytes))]
    if gigabytes % 100 == 0 and gigabytes < 100_000:
        out.append(("t", f"{gigabytes // 100:03d}"))
    elif gigabytes % 10 == 0 and gigabytes < 10_000:
        out.append(("t", f"{gigabytes // 10:03d}"))
    out.append(("b", str(gigabytes // 1000)) if gigabytes % 1000 == 0 else ("p", f"{gigabytes // 1000}P{gigabytes % 1000 // 10:02d}"))
    return sorted(out, key=lambda x: -len(x[1]))


def _tokens(text: str) -> list[str]:
    return [t for t in (x.strip(",;|()[]*!\"'") for x in text.split()) if t and t not in ("-", "–", "/", "·")]


def stated_sizes(text: str) -> list[int]:
    """Gigabytes that a text states, the cache left out."""
    low = text.lower()
    if "cache" in low or "buffer" in low:
        text = _CACHE.sub(" ", text)
    out = []
    for m in _GB.finditer(text):
        written_, unit = m[1], m[2].lower()
        if written_[0] == "0" and written_[1:2].isdigit():
            continue  # digits of a part number
        value = float(written_) if written_.isdigit() else float(number(written_) or 0)
        scale = 1000 if unit[0] == "t" else 1
        binary = (1.099511627776 if scale == 1000 else 1.073741824) if "ib" in unit else 1.0
        gigabytes = round(min(value * scale * binary, 1e9))
        if 0 < gigabytes <= 100_000:
            out.append(gigabytes)
    return out


def stated_interface(text: str) -> str | None:
    """The interface that a text names, if it names one only."""
    found = [name for name, pattern in _INTERFACE_WORDS if pattern.search(text)]
    return found[0] if len(found) == 1 else None


def _is_part(word: str) -> bool:
    return len(word) >= 8 and len(_DIGIT.findall(word)) >= 4 and not word.isdigit()


def structure(part: str, title: list[str], model: list[str], size: int) -> tuple[str, str, str] | None:
    """(structure, the letter after it, the shape of the code) of a part number, from what stands beside it.

    The code is the longest word, or neighbouring words, of title and model
    that the part number contains; {c} stands for it and {t}, {g}, {p} or {b}
    for the size. Letters stay, and # is any other digit. A title's word that
    the part number ends with, or begins with and goes on as the title does, is
    a piece of it and doesn't count. None
    where the code or the size isn't found exactly once.
    """
    code = ""
    for line in (title, model):
        for i in range(len(line)):
            word = ""
            for n in range(i, min(i + 3, len(line))):
                word += line[n]
                if word not in part:
                    break
                if len(code) < len(word) <= len(part) - 2 and len(word) <= 12 and len(_DIGIT.findall(word)) >= 3 and not word.isdigit() and (line is model or not part.endswith(word) and not part.startswith(word + (line[n + 1] or "?" if n + 1 < len(line) else "?"))):
                    code = word
    if len(code) < 5 or part.count(code) != 1:
        return None
    left, right = part.split(code)
    for kind, spelled in _spellings(size):
        hits = left.count(spelled) + right.count(spelled)
        if hits == 1:
            plain = lambda x: _DIGIT.sub("#", x)
            if spelled in left:
                before, after = left.split(spelled)
                return f"{plain(before)}{{{kind}}}{plain(after)}{{c}}", right[:1] if right[:1].isalpha() else "", _mask(code)
            before, after = right.split(spelled)
            return f"{plain(left)}{{c}}{plain(before)}{{{kind}}}", after[:1] if after[:1].isalpha() else "", _mask(code)
        if hits:
            return None
    return None


def evidence(title: str | None, mpn: str | None, model: str | None) -> list[str]:
    """What a listing tells about sizes, shapes of codes and structures of part numbers, as texts to be counted."""
    title = title or ""
    out = []
    sizes = stated_sizes(title)
    out += [f"size\t{sizes[0]}"] if sizes else []
    tokens = [_squeezed(_part_text(t)) for t in _tokens(title)]
    named = [_squeezed(t) for t in _tokens(model or "")]
    out += [f"word\t{_mask(w)}" for line in (tokens, named) for w in set(line) if 5 <= len(w) <= 10 and _CODE_WORD.fullmatch(w) and not _is_amount(w)]
    if sizes:
        interface = stated_interface(title) or ""
        for part in {w for w in (_squeezed(_part_text(mpn or "")), *tokens) if _is_part(w)}:
            got = structure(part, tokens, named, sizes[0])
            if got:
                out += [f"part\t{got[0]}\t{got[1]}\t{interface}", f"code\t{got[2]}"]
    return out


@dataclass
class Grammar:
    """What was learnt: sizes and shapes with their counts; structures as (structure, count, interface, interface by the letter after it)."""

    sizes: dict[int, int] = field(default_factory=dict)
    shapes: dict[str, int] = field(default_factory=dict)
    structures: list[tuple[str, int, str | None, dict[str, str]]] = field(default_factory=list)

    @classmethod
    def learnt(cls, counts: dict[str, int]) -> "Grammar":
        """From counts of evidence()."""
        out, parts = cls(), {}
        for text, n in sorted(counts.items()):
            kind, *rest = text.split("\t")
            if kind == "size":
                out.sizes[int(rest[0])] = n
            elif kind == "part":
                parts.setdefault(rest[0], {}).setdefault(rest[1], {})[rest[2]] = n
            else:
                out.shapes[rest[0]] = out.shapes.get(rest[0], 0) + n
        top = sum(out.sizes.values())
        out.sizes = {s: n for s, n in out.sizes.items() if _round_size(s) or n >= 5 * SHARE["size"] * top}

        def pure(votes: dict[str, int]) -> str | None:
            known = {i: n for i, n in votes.items() if i}
            best = max(known, key=lambda i: (known[i], i), default=None)
            return best if best and known[best] >= _PURE * sum(known.values()) else None

        for text, after in parts.items():
            whole: dict[str, int] = {}
            for votes in after.values():
                for i, n in votes.items():
                    whole[i] = whole.get(i, 0) + n
            by_letter = {letter: pure(votes) for letter, votes in after.items() if letter}
            out.structures.append((text, sum(whole.values()), pure(whole), {k: v for k, v in by_letter.items() if v}))
        return out

    def __post_init__(self) -> None:
        self._ready = False

    def __getstate__(self) -> dict:
        return {"sizes": self.sizes, "shapes": self.shapes, "structures": self.structures, "_ready": False}

    def _prepare(self) -> None:
        slots = {"{t}": rf"(?P<t>{_D}{{3}})", "{g}": rf"(?P<g>{_D}{{3,5}})", "{b}": rf"(?P<b>{_D}{{1,2}})", "{p}": rf"(?P<p>{_D}{{1,2}}P{_D}{{2}})", "#": _D}

        def pattern(text: str, code: str) -> str:
            return "".join(f"(?P<c>{code})" if x == "{c}" else slots.get(x, re.escape(x)) for x in re.findall(r"\{\w\}|.", text))

        self._masks = {m: re.sub(r"(L+|D+)", lambda r: f"{'[A-Z]' if r[0][0] == 'L' else _D}{{{len(r[0])}}}", m) for m in self.shapes}
        any_code = "|".join(self._masks.values()) or "(?!)"
        each = [re.sub(r"\?P<\w>", "?:", pattern(t, any_code)) for t, *_ in self.structures]
        self._read = [(re.compile(quick), [re.compile(pattern(t, m)) for m in self._masks.values()], n, i, by) for quick, (t, n, i, by) in zip(each, self.structures, strict=True)]
        self._any = re.compile("|".join(f"(?:{p})" for p in each) or "(?!)")
        self._by_length: dict[int, list[tuple[str, re.Pattern]]] = {}
        for m, p in self._masks.items():
            self._by_length.setdefault(len(m), []).append((m, re.compile(p)))
        self._ready = True

    def _size(self, kind: str, text: str) -> int | None:
        """The size that a spelling means; None where no drive of it is known."""
        if kind == "p":
            digits = _digits(text.replace("P", ""))
            tries = [int(digits) * 10]
        else:
            value = int(_digits(text))
            tries = {"t": [value * 100, *([value * 10] if value % 10 else [])], "g": [value], "b": [value * 1000]}[kind]
        return next((s for s in tries if s in self.sizes), None)

    def _known_size(self, word: str) -> bool:
        """Whether digits and a unit are a size of drives; others of this form can be codes."""
        scale = _SIZE_UNITS.get(word[-2:])
        return bool(scale) and word[:-2].isdigit() and int(word[:-2]) * scale in self.sizes

    def codes(self, word: str) -> list[tuple[float, str]]:
        """(slips, code without slips) of each learnt shape that ``word`` can have, at least two digits being typed as such; few slips and frequent shapes come first."""
        if not self._ready:
            self._prepare()
        out = []
        for mask, pattern in self._by_length.get(len(word), ()):
            if pattern.fullmatch(word) and len(_DIGIT.findall(word)) >= 2:
                at = [i for i, m in enumerate(mask) if m == "D"]
                slips = _slips("".join(word[i] for i in at))
                out.append((slips - math.log2(self.shapes[mask]) / 4, slips, "".join(_digits(c) if mask[i] == "D" else c for i, c in enumerate(word))))
        return [x[1:] for x in sorted(out)]

    def part(self, text: str, size: int | None = None) -> tuple[str, int, str | None] | None:
        """(code, gigabytes, interface) that a part number of a learnt structure states; endings and revision signs don't count.

        Of several readings the one with the fewest slips counts; a mark typed
        where the code ends, the size known from elsewhere, and how frequent
        the structure is speak for one.
        """
        if not self._ready:
            self._prepare()
        body = _part_text(text).upper()
        word = _NOT_PLAIN.sub("", body)
        if len(word) < 7 or not self._any.match(word):
            return None
        marks, seen = set(), 0
        for c in body:
            plain = c.isascii() and c.isalnum()
            marks |= set() if plain else {seen}
            seen += plain
        best: tuple[float, tuple[str, int, str | None]] | None = None
        for quick, patterns, n, interface, by_letter in self._read:
            for pattern in patterns if quick.match(word) else ():
                m = pattern.match(word)
                if not m or len(_DIGIT.findall(m["c"])) < 2:
                    continue
                kind = next(k for k in m.groupdict() if k != "c")
                gigabytes = self._size(kind, m[kind])
                if gigabytes is None:
                    continue
                letter = word[m.end() : m.end() + 1]
                whole = interface is not None or letter in by_letter
                if not whole and size not in (None, gigabytes):
                    continue
                slips, code = next(iter(self.codes(m["c"])), (0.0, m["c"]))
                score = slips + _slips(m[kind].replace("P", "")) - 1.5 * (m.end("c") in marks) - 2.0 * (gigabytes == size) - 0.1 * n.bit_length() + 2.0 * (not whole)
                if best is None or score < best[0]:
                    best = score, (code, gigabytes, by_letter.get(letter, interface))
        return best[1] if best else None

    def words(self, tokens: list[str]) -> list[tuple[bool, float, str]]:
        """(typed with blanks inside, slips, code) of the candidate codes of a text."""
        plain = [_squeezed(_part_text(t)) for t in tokens]
        out = []
        for i in range(len(tokens)):
            word = ""
            for n in range(i, min(i + 3, len(tokens))):
                if n > i and (_SIZE_TOKEN.fullmatch(tokens[n]) or _SIZE_TOKEN.fullmatch(tokens[i])):
                    break
                word += plain[n]
                if len(word) > 12:
                    break
                following = tokens[n + 1].lower() if n + 1 < len(tokens) else ""
                if following.startswith(("rpm", "u/min", "tr/min")) or n > i and not (plain[i].isalpha() or plain[n].isalpha()):
                    continue
                readings = self.codes(word)
                if not readings or word.endswith("RPM") or self._known_size(word):
                    continue
                out.append((n > i, readings[0][0], readings[0][1]))
        return sorted(out)


def maker(text: str | None) -> str | None:
    """A brand without case, marks and legal forms; None where it has no meaning."""
    plain = re.sub(r"[^a-z0-9]", "", (text or "").lower())
    if not plain or plain in _EMPTY:
        return None
    return re.sub(r"[^a-z0-9]", "", _LEGAL.sub(" ", (text or "").lower())) or plain


@dataclass(frozen=True)
class Attributes:
    """What a listing states. ``sure``: the code is read from a part number; else ``words`` and then ``joined`` hold candidates, the best first."""

    sure: str | None
    words: list[str]
    joined: list[str]
    capacity: int | None
    interface: str | None
    maker: str | None


def attributes(grammar: Grammar, title: str | None, mpn: str | None, model: str | None, brand: str | None, aspects: str | None) -> Attributes | None:
    """The attributes of a listing under the learnt grammar; None for an accessory."""
    title = title or ""
    if _ACCESSORY.search(title):
        return None
    size = next((s for s in stated_sizes(title) if s in grammar.sizes), None)
    part = grammar.part(mpn, size) if mpn else None
    tokens = [] if part else _tokens(title)
    if not part:
        # A part number typed with blanks is looked for in neighbouring tokens; a size on its own belongs to no part number.
        digits = [-99 if _SIZE_TOKEN.fullmatch(t) else len(_DIGIT.findall(t)) for t in tokens]
        runs = ((i, n) for n in (1, 2, 3) for i in range(len(tokens) - n + 1) if sum(digits[i : i + n]) >= 3)
        read = ((n, grammar.part(" ".join(tokens[i : i + n]), size)) for i, n in runs)
        part = next((p for n, p in read if p and (n == 1 or size in (None, p[1]))), None)
    interface = stated_interface(title)
    if size is None and aspects:
        try:
            got = json.loads(aspects)
            value = number(str(got.get("capacity_tb") or "")) if isinstance(got, dict) else None
            size = round(float(value) * 1000) if value else None
        except (ValueError, IndexError, OverflowError):
            size = None
    if part:
        return Attributes(part[0], [], [], part[1], part[2] or interface, maker(brand))
    named = [*grammar.words(_tokens(model or "")), *grammar.words(tokens)]
    words, joined = ([c for j, _, c in named if j == typed] for typed in (False, True))
    if not words and not joined:
        # The longest word that can be a model number is taken whole.
        whole = [w for w in (_squeezed(_part_text(x)) for x in (mpn or "", *tokens)) if _MODEL_WORD.fullmatch(w) and not _is_amount(w)]
        words = sorted(whole, key=lambda w: (-len(w), w))[:1]
    return Attributes(None, list(dict.fromkeys(words)), list(dict.fromkeys(joined)), size, interface, maker(brand))


def learnt(rows: DataFrame) -> Grammar:
    """The grammar that the evidence of all ``rows`` (a column ``evidence``) gives."""
    counts = written(rows.select(F.explode("evidence").alias("e")).groupBy("e").agg(F.count("*").alias("n")).withColumn("kind", F.substring_index("e", "\t", 1)), "evidence")
    totals = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # one row for each kind
    enough = F.lit(False)
    for kind, share in SHARE.items():
        enough = enough | ((F.col("kind") == kind) & (F.col("n") >= max(2, share * totals.get(kind, 0))))
    # A structure counts as a whole; its letters and interfaces come along with it.
    stem = F.when(F.col("kind") == "part", F.substring_index("e", "\t", 2)).otherwise(F.col("e"))
    sums = counts.groupBy("kind", stem.alias("stem")).agg(F.sum("n").alias("n")).where(enough).select("stem")
    kept = counts.withColumn("stem", stem).join(sums, "stem").groupBy("e").agg(F.sum("n").alias("n"))
    out = Grammar.learnt({r["e"]: r["n"] for r in kept.collect()})  # at most 1 / SHARE stems of each kind, with some letters each
    discard(counts)
    return out


def parsed(offers: DataFrame) -> DataFrame:
    """(id, code, capacity, interface, maker) of each offer with a series code."""
    newest = Window.partitionBy("id").orderBy(F.desc("last_seen_ns"), F.desc("title"), F.desc("hint_mpn"))
    columns = ["id", "title", "hint_mpn", "hint_model", "hint_brand", "aspects_json"]
    rows = offers.where("id is not null").select(*columns, "last_seen_ns").withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").select(*columns)
    texts = pa.list_(pa.string())
    seen = pa.schema([*((c, pa.string()) for c in columns), ("evidence", texts)])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [evidence(*x) for x in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([*(c.cast(pa.string()) for c in batch.columns), pa.array(got, texts)], schema=seen)

    told = written(rows.mapInArrow(gather, ", ".join(f"{c} string" for c in columns) + ", evidence array<string>"), "told")
    grammar = learnt(told)
    out = pa.schema([("id", pa.string()), ("sure", pa.string()), ("words", texts), ("joined", texts), ("capacity", pa.int64()), ("interface", pa.string()), ("maker", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, *rest = (c.to_pylist() for c in batch.columns)
            made = ((i, attributes(grammar, *x)) for i, *x in zip(ids, *rest, strict=True))
            got = [(i, a.sure, a.words, a.joined, a.capacity, a.interface, a.maker) for i, a in made if a and (a.sure or a.words or a.joined)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*got) if got else [[]] * len(out), out, strict=True)], schema=out)

    spelled = "id string, sure string, words array<string>, joined array<string>, capacity bigint, interface string, maker string"
    found = written(told.select(*columns).mapInArrow(read, spelled), "attributes")
    known = ["capacity", "interface", "maker"]
    sure = found.where("sure is not null").select("id", F.col("sure").alias("code"), *known)
    unsure = found.where("sure is null")
    # Other codes count by how many listings have them in one piece.
    pieces = sure.select("code").unionByName(unsure.select(F.explode("words").alias("code"))).groupBy("code").agg(F.count("*").alias("n"))
    tried = unsure.select("id", F.posexplode(F.concat(F.transform("words", lambda w: F.struct(w.alias("code"), F.lit(False).alias("split"))), F.transform("joined", lambda w: F.struct(w.alias("code"), F.lit(True).alias("split"))))).alias("at", "c"))
    rated = tried.select("id", "at", "c.code", "c.split").join(pieces, "code", "left")
    attested = F.coalesce(F.col("n"), F.lit(0)) >= F.when(F.col("split"), 1).otherwise(2)
    rated = written(rated.withColumn("attested", attested), "candidates")
    best = rated.where("attested or not split").groupBy("id").agg(F.min_by("code", F.struct(~F.col("attested"), "split", "at")).alias("code"))
    # A code that is nowhere in one piece counts where its letters are no word that stands before numbers of all kinds.
    loose = rated.where("split").join(best.select("id"), "id", "left_anti").withColumn("letters", F.regexp_replace("code", "[0-9]", ""))
    often = loose.groupBy("letters", "code").agg(F.count("*").alias("n_code"))
    rare = often.withColumn("n_letters", F.sum("n_code").over(Window.partitionBy("letters"))).where(F.col("n_code") >= _RARE * F.col("n_letters"))
    spare = loose.join(rare.drop("letters"), "code").groupBy("id").agg(F.min_by("code", F.struct("n_letters", "at")).alias("code"))
    return sure.unionByName(unsure.select("id", *known).join(best.unionByName(spare), "id").select("id", "code", *known))


def classes(listings: DataFrame) -> DataFrame:
    """(class, code, digits, capacity, interface, maker, n): listings of equal attributes, with their most frequent maker."""
    known = ["code", "capacity", "interface"]
    makers = listings.groupBy(*known, "maker").agg(F.count("*").alias("n"))
    most = F.max_by("maker", F.when(F.col("maker").isNotNull(), F.struct("n", "maker")))
    out = makers.groupBy(*known).agg(most.alias("maker"), F.sum("n").alias("n"))
    return out.select(class_key().alias("class"), *known, F.regexp_replace("code", "[^0-9]", "").alias("digits"), "maker", "n")


def class_key() -> Column:
    """The name of the class of a listing's attributes."""
    return F.concat_ws("|", "code", F.coalesce(F.col("capacity").cast("string"), F.lit("?")), F.coalesce("interface", F.lit("?")))


def _levels() -> dict[str, Column]:
    """The comparison of each field of classes a and b: 2 agrees, 1 is close, 0 differs, null is unknown."""
    a_maker, b_maker = F.col("a_maker"), F.col("b_maker")
    spelled_in = lambda x, y: F.call_function("rlike", y, F.concat(F.lit("^"), F.regexp_replace(x, "(.)", "$1.*")))  # noqa: E731  x is an abbreviation of y
    close_maker = (F.levenshtein(a_maker, b_maker) <= 2) | spelled_in(a_maker, b_maker) | spelled_in(b_maker, a_maker)
    apart = F.abs(F.col("a_capacity") - F.col("b_capacity"))
    return {
        "maker": F.when(a_maker == b_maker, 2).when(close_maker, 1).when(a_maker.isNotNull() & b_maker.isNotNull(), 0),
        "code": F.when(F.col("a_code") == F.col("b_code"), 2).when(F.levenshtein("a_code", "b_code") <= 1, 1).otherwise(0),
        "capacity": F.when(apart == 0, 2).when(apart * 100 <= F.col("a_capacity"), 1).when(apart.isNotNull(), 0),
        "interface": F.when(F.col("a_interface") == F.col("b_interface"), 2).when(F.col("a_interface").isNotNull() & F.col("b_interface").isNotNull(), 0),
    }


def compared(found: DataFrame) -> DataFrame:
    """(a, b, n, levels of the fields): pairs of classes that share a block, each once."""
    sides = [found.select(*[F.col(c).alias(f"{s}_{c}") for c in found.columns]) for s in "ab"]
    same_code = sides[0].join(sides[1], (F.col("a_code") == F.col("b_code")) & (F.col("a_class") < F.col("b_class")))
    near = (F.col("a_digits") == F.col("b_digits")) & (F.col("a_capacity") == F.col("b_capacity")) & (F.col("a_interface") == F.col("b_interface"))
    other_code = sides[0].join(sides[1], near & (F.col("a_class") < F.col("b_class")) & (F.col("a_code") != F.col("b_code")))
    return same_code.unionByName(other_code).select(F.col("a_class").alias("a"), F.col("b_class").alias("b"), (F.col("a_n") * F.col("b_n")).alias("n"), *[c.alias(f) for f, c in _levels().items()])


def chance_agreement(found: DataFrame) -> dict[str, float]:
    """For each defining field, how often two listings drawn at random agree in it."""
    out = {}
    for f in DEFINING:
        counts = found.where(F.col(f).isNotNull()).groupBy(f).agg(F.sum("n").cast("double").alias("n"))
        r = counts.agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same")).first()
        pairs = (r["n"] or 0.0) * ((r["n"] or 0.0) - 1)
        out[f] = min(max((r["same"] or 0.0) / pairs if pairs > 0 else 0.5, 1e-9), 1 - 1e-6)
    return out


def _match_odds(pattern: tuple, used: tuple[str, ...], m: dict, u: dict) -> float:
    """The likelihood ratio of a pattern over the fields ``used``."""
    odds = 1.0
    for f in used:
        level = pattern[FIELDS.index(f)]
        if level is not None:
            odds *= m[f][level] / u[f][level]
    return odds


def _expectation_maximisation(patterns: dict[tuple, float], used: tuple[str, ...], m: dict, u: dict, fixed_m: tuple[str, ...], fixed_u: tuple[str, ...], share: float) -> tuple[dict[tuple, float], float]:
    """(probability of a match for each pattern, share of matches); m and u are fitted in place, but for the fixed fields."""
    total, match = sum(patterns.values()), {}
    for _ in range(_EM_ROUNDS if total else 0):
        for p in patterns:
            odds = share / (1 - share) * _match_odds(p, used, m, u)
            match[p] = odds / (1 + odds)
        before, share = share, min(max(sum(n * match[p] for p, n in patterns.items()) / total, 1e-6), 1 - 1e-6)
        for f in used:
            k = FIELDS.index(f)
            for side, fixed, weight in ((m, fixed_m, lambda p: match[p]), (u, fixed_u, lambda p: 1 - match[p])):
                if f not in fixed:
                    seen = {x: 1e-3 + sum(n * weight(p) for p, n in patterns.items() if p[k] == x) for x in (0, 1, 2)}
                    side[f] = {x: seen[x] / sum(seen.values()) for x in seen}
            if f in DEFINING and f not in fixed_m and m[f][2] < AGREEING and any(p[k] == 2 for p in patterns):
                rest = m[f][1] + m[f][0]
                m[f] = {2: AGREEING, 1: m[f][1] / rest * (1 - AGREEING), 0: m[f][0] / rest * (1 - AGREEING)}
        if abs(share - before) < _EM_STOP:
            break
    return match, share


def fit(patterns: dict[tuple, float], chance: dict[str, float]) -> dict[tuple, float]:
    """The probability of a match for each pattern of levels: Fellegi-Sunter weights by expectation-maximisation, block by block.

    Pairs of the block of one code give the weights of maker, capacity and
    interface; chance agreement in capacity is that of random listings, chance
    agreement of makers and interfaces is estimated on the block, as a code is
    one maker's and often has one interface. Pairs of the block of the same digits, capacity and interface but
    different codes have the code and the maker to tell: what makers of matches
    do is known from the first block, all else is fitted on the block itself.
    """
    at = FIELDS.index("code")
    same = {p: n for p, n in patterns.items() if p[at] == 2}
    apart = {p: n for p, n in patterns.items() if p[at] != 2}
    u: dict[str, dict[int, float]] = {f: {2: chance[f], 1: 1e-3 * chance[f], 0: 1 - chance[f]} for f in DEFINING}
    u["maker"] = {2: 0.5, 1: 0.25, 0: 0.25}
    m: dict[str, dict[int, float]] = {f: {2: 0.95, 1: 0.03, 0: 0.02} for f in FIELDS}
    match, _ = _expectation_maximisation(same, ("maker", "capacity", "interface"), m, u, (), ("capacity",), 0.2)
    makers = {x: 1.0 + sum(n for p, n in apart.items() if p[FIELDS.index("maker")] == x) for x in (0, 1, 2)}
    codes = {x: 1.0 + sum(n for p, n in apart.items() if p[at] == x) for x in (0, 1)}
    own_u = {"maker": {x: n / sum(makers.values()) for x, n in makers.items()}, "code": {2: 1e-9} | {x: n / sum(codes.values()) for x, n in codes.items()}}
    own_m = {"maker": m["maker"], "code": {2: 1e-9, 1: 0.9, 0: 0.1}}
    others, _ = _expectation_maximisation(apart, ("maker", "code"), own_m, own_u, ("maker",), (), 0.01)
    return match | others


def _linking(pairs: DataFrame, found: DataFrame) -> list[tuple]:
    """The patterns whose pairs are links: those more probably a match than not."""
    counts = {tuple(r[f] for f in FIELDS): float(r["n"]) for r in pairs.groupBy(*FIELDS).agg(F.sum("n").alias("n")).collect()}  # at most 4 ** 4 rows
    # Listings of one class agree in all that is known of them; they are pairs too.
    known = {f: F.when(F.col(f).isNotNull(), 2) for f in FIELDS}
    own = found.select("n", *[c.alias(f) for f, c in known.items()]).groupBy(*FIELDS).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("n"))
    for r in own.collect():
        key = tuple(r[f] for f in FIELDS)
        counts[key] = counts.get(key, 0.0) + float(r["n"])
    match = fit({p: n for p, n in counts.items() if n > 0}, chance_agreement(found))
    return [p for p, chance in match.items() if chance >= THRESHOLD]


def _is(patterns: list[tuple]) -> Column:
    """Whether the levels of a pair are one of ``patterns``."""
    out = F.lit(False)
    for pattern in patterns:
        same = F.lit(True)
        for f, level in zip(FIELDS, pattern, strict=True):
            same = same & F.col(f).eqNullSafe(F.lit(level))
        out = out | same
    return out


def linked(pairs: DataFrame, linking: list[tuple], found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links between classes, classes whose own listings are links of each other).

    A class that leaves a defining field open is linked only where one class
    without open fields fits it: else it would join models that differ in that
    field. Where none fits, two open classes are linked that fit only each
    other. Listings of an open class that no class without open fields could
    join are links of each other, where their pattern is one.
    """
    known = F.lit(True)
    for f in DEFINING:
        known = known & F.col(f).isNotNull()
    links = pairs.where(_is(linking)).withColumn("known", known)
    open_ = links.where("not known")
    full = found.where(F.col("capacity").isNotNull() & F.col("interface").isNotNull()).select("class")
    ends = open_.select(F.col("a").alias("class"), F.col("b").alias("other"), "a", "b").unionByName(open_.select(F.col("b").alias("class"), F.col("a").alias("other"), "a", "b")).join(full, "class", "left_anti")
    ends = ends.join(full.select(F.col("class").alias("other"), F.lit(True).alias("whole")), "other", "left")
    edge = F.struct("a", "b")
    fits = ends.groupBy("class").agg(F.count("whole").alias("fits"), F.count("*").alias("all"), F.min(F.when(F.col("whole"), edge)).alias("fit"), F.min(edge).alias("any"))
    mutual = fits.where("fits = 0 and all = 1").groupBy("any").agg(F.count("*").alias("ends")).where("ends = 2").select("any.*")
    once = fits.where("fits = 1").select("fit.*").unionByName(mutual)
    levels = {f: F.when(F.col(f).isNotNull(), 2) for f in FIELDS}
    own = found.select("class", *[c.alias(f) for f, c in levels.items()]).where(_is(linking)).join(fits.where("fits > 0").select("class"), "class", "left_anti").select("class")
    return links.where("known").select("a", "b").unionByName(once).distinct(), own


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root): the least vertex of each vertex's component, by rounds of least neighbours and pointer jumping."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    roots = written(both.groupBy(F.col("a").alias("vertex")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "roots") if not both.isEmpty() else both.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    changed = not both.isEmpty()
    while changed:
        near = both.join(roots, both["b"] == roots["vertex"]).groupBy("a").agg(F.min("root").alias("near"))
        stepped = roots.join(near, roots["vertex"] == near["a"]).select("vertex", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = stepped.select(F.col("vertex").alias("at"), F.col("root").alias("far"))
        jumped = stepped.join(jump, stepped["root"] == jump["at"]).select("vertex", "old", F.least("root", "far").alias("root"))
        step = written(jumped, "roots")
        changed = not step.where("old <> root").isEmpty()
        roots = step.select("vertex", "root")
    return roots


def grouped(offers: DataFrame) -> DataFrame:
    """(id, class, model): the class of each listing's attributes, and the group of classes that are one model."""
    listings = written(parsed(offers), "listings")
    found = written(classes(listings), "classes")
    pairs = written(compared(found), "pairs")
    links, own = linked(pairs, _linking(pairs, found), found)
    roots = components(links)
    named = listings.select("id", class_key().alias("class"), *DEFINING)
    whole = named.join(roots, named["class"] == roots["vertex"], "left").join(own.withColumnRenamed("class", "_own"), F.col("class") == F.col("_own"), "left")
    # The listings of a class that are no links of each other stay single.
    alone = F.when(F.col("_own").isNull() & F.col("root").isNull(), F.concat_ws("#", "class", "id"))
    return whole.select("id", "class", F.coalesce("root", alone, "class").alias("model"), *DEFINING)


def same_model(groups: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every two listings of one model."""
    rows = groups.select("id", "model")
    a, b = rows.select(F.col("id").alias("id_a"), "model"), rows.select(F.col("id").alias("id_b"), "model")
    return a.join(b, "model").where("id_a < id_b").select("id_a", "id_b")
