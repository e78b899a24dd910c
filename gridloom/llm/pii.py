"""Personal data: patterns propose spans, check digits confirm them, words near them adjust the score.

DataFrame functions only. A text is split at a pattern's matches; the lengths of the pieces and of the
matches give the positions, in code points. Patterns are written so that the search takes linear time and
no recursion whatever the text: possessive quantifiers, and starts only where a run starts.

Base kinds are email, ip, card and phone, whose spans stay whatever their score; iban (mod 97) and national
id numbers (which need a word that says so) are added. Spans of different kinds may overlap.

Defined results: null text is the empty text and has no spans. Null or repeated ids don't matter, as rows
are handled one by one, and other columns pass through; one that has the result's name gets ``_given``
behind its own. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_results

_LOCAL = r"[A-Za-z0-9._%+-]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """True if the digits of a text pass the Luhn check."""
    d = F.reverse(digits(text))

    def term(at):
        n = F.substring(d, at + 1, F.lit(1)).cast("int") * F.when(at % 2 == 1, 2).otherwise(1)
        return F.when(n > 9, n - 9).otherwise(n)

    places = F.sequence(F.lit(0), F.length(d) - 1)
    return F.aggregate(F.transform(places, term), F.lit(0), lambda a, n: a + n) % 10 == 0


def mod97(text: Column) -> Column:
    """True if an international bank account number leaves 1 when divided by 97."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def step(rest, letter):
        code = F.ascii(letter)
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1


@dataclass(frozen=True)
class Kind:
    """A pattern, its validator, and the score with neither helpful nor unhelpful words before it.

    ``needs``: a text without a match of this cheap pattern can't have the kind. ``least``: spans of lower
    score are dropped; base kinds have 0.
    """

    name: str
    pattern: str
    needs: str
    valid: object
    score: float
    helps: str
    hurts: str = r"(?!)"
    least: float = 0.0


#: In the order in which spans with one start are listed.
BASE = (
    Kind(
        "email",
        rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
        lambda m: F.lit(True),
        0.9,
        r"mail|contact|write",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
        r"[0-9]\.[0-9]",
        lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
        0.6,
        r"\bip\b|address|host|server",
        r"version|\bv$|release|section",
    ),
    Kind(
        "card",
        r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,18}+(?![\x20-]?[0-9])",
        r"[0-9][\x20-]?[0-9][\x20-]?[0-9]",
        luhn,
        0.6,
        r"card|visa|master|credit|debit|pay",
        r"isbn|order|tracking|serial",
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        r"\+[0-9]",
        lambda m: F.length(digits(m)).between(10, 15),
        0.7,
        r"tel|phone|call|mobile|fax",
    ),
)
ADDED = (
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
        "[A-Z][A-Z][0-9][0-9]",
        lambda m: F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34) & mod97(m),
        0.8,
        r"iban|account|bank",
        least=0.5,
    ),
    Kind(
        "national_id",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        "-[0-9][0-9]-",
        lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"),
        0.3,
        r"ssn|social security|national id",
        least=0.5,
    ),
)
KINDS = BASE + ADDED
#: Code points that are searched for context words before and after a match.
NEAR, AFTER = 48, 24
BLOCK = 256


def _score(kind: Kind, before: Column, after: Column) -> Column:
    """Helpful words count before and after a match, unhelpful ones before it."""
    before, after = F.lower(F.right(before, F.lit(NEAR))), F.lower(F.left(after, F.lit(AFTER)))
    helped = before.rlike(kind.helps) | after.rlike(kind.helps)
    return kind.score + F.when(helped, 0.3).otherwise(0.0) - F.when(before.rlike(kind.hurts), 0.3).otherwise(0.0)


def _running(values: Column, add) -> Column:
    """What ``add`` makes of an array's values up to each place, from 0 on, in time that stays far from the square of its length."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")),
        lambda b: F.aggregate(F.slice(values, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), add),
    )

    def upto(sums, at):
        block = F.floor(at / BLOCK).cast("int")
        whole = F.aggregate(F.slice(sums, F.lit(1), block), F.lit(0), add)
        return F.aggregate(F.slice(values, block * BLOCK + 1, at - block * BLOCK + 1), whole, add)

    # The blocks are bound to a lambda's variable, so that they are made once, not for each element.
    return F.element_at(F.transform(F.array(blocks), lambda sums: F.transform(values, lambda _, at: upto(sums, at))), 1)


def _proposed(frame: DataFrame, kind: Kind) -> DataFrame:
    """Add the confirmed spans of one kind: array of (start, rank, end, kind, value, score)."""
    text, has = F.col("__text"), F.col("__text").rlike(kind.needs)
    none = F.array().cast("array<string>")
    frame = frame.withColumn("__m", F.when(has, F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))).otherwise(none))
    frame = frame.withColumn("__p", F.when(F.size("__m") > 0, F.split(text, kind.pattern, -1)).otherwise(none))
    steps = F.transform(
        "__m", lambda m, at: F.length(F.get("__p", at)) + F.when(at > 0, F.length(F.get("__m", at - 1))).otherwise(0)
    )
    frame = frame.withColumn("__steps", steps)
    frame = frame.withColumn("__starts", F.when(F.size("__steps") > 0, _running(F.col("__steps"), lambda a, n: a + n)))
    rank = [k.name for k in KINDS].index(kind.name)
    spans = F.transform(
        "__m",
        lambda m, at: F.struct(
            F.get("__starts", at).alias("start"),
            F.lit(rank).alias("rank"),
            (F.get("__starts", at) + F.length(m)).alias("end"),
            F.lit(kind.name).alias("kind"),
            m.alias("value"),
            F.round(_score(kind, F.get("__p", at), F.get("__p", at + 1)), 2).alias("score"),
        ),
    )
    kept = F.filter(spans, lambda s: kind.valid(s["value"]) & (s["score"] >= kind.least))
    return frame.withColumn(f"__{kind.name}", kept).drop("__m", "__p", "__steps", "__starts")


def find(docs: DataFrame, text_col: str = "text", into: str = "spans") -> DataFrame:
    """docs with all spans of each text, in order of start, then of kind."""
    frame = docs.select(F.struct("*").alias("__doc"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    for kind in KINDS:
        frame = _proposed(frame, kind)
    every = F.array_sort(F.concat(*[f"__{k.name}" for k in KINDS]))
    found = frame.select("__doc", every.alias("__every"))
    names = with_results(docs, {into: F.lit(None)}).columns
    return found.select(*[F.col("__doc")[c].alias(n) for c, n in zip(docs.columns, names, strict=False)], F.col("__every").alias(into))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _bind(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _merged(spans: Column) -> Column:
    """Runs of overlapping spans as (start, end, kind), in order; the longest span names the kind, the first of equals."""

    def runs(s):
        def made(ends):
            places = F.sequence(F.lit(0), F.size(s["all"]) - 1)
            heads = F.filter(places, lambda at: (at == 0) | (F.get(s["all"], at)["start"] >= F.get(ends, at - 1)))
            return _bind(heads, lambda h: F.transform(h, lambda at, k: run(ends, at, F.coalesce(F.get(h, k + 1), F.size(s["all"])))))

        def run(ends, at, until):
            longest = lambda a, b: F.when(b["end"] - b["start"] > a["end"] - a["start"], b).otherwise(a)
            most = F.aggregate(F.slice(s["all"], at + 1, until - at), F.get(s["all"], at), longest)
            return F.struct(F.get(s["all"], at)["start"].alias("start"), F.get(ends, until - 1).alias("end"), most["kind"].alias("kind"))

        return _bind(_running(F.transform(s["all"], lambda x: x["end"]), lambda a, n: F.greatest(a, n)), made)

    return _bind(F.struct(spans.alias("all")), runs)


def _cut(text: Column, runs: Column) -> Column:
    """The text with each run replaced by its kind in brackets. Pieces are taken from blocks, as a search from the start would take the square."""

    def piece(blocks, start, end):
        block = F.floor(start / BLOCK).cast("int")
        near = F.array_join(F.slice(blocks, block + 1, F.floor(end / BLOCK).cast("int") - block + 1), "")
        return F.substring(near, start - block * BLOCK + 1, end - start)

    def joined(s):
        def part(run, at):
            since = F.when(at == 0, 0).otherwise(F.get(s["runs"], at - 1)["end"])
            return F.concat(piece(s["blocks"], since, run["start"]), F.lit("["), F.upper(run["kind"]), F.lit("]"))

        rest = piece(s["blocks"], F.element_at(s["runs"], -1)["end"], F.length(s["text"]))
        return F.concat(F.array_join(F.transform(s["runs"], part), ""), rest)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return _bind(F.struct(text.alias("text"), runs.alias("runs"), blocks.alias("blocks")), joined)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span that find() confirms cut out of the text, for its kind in brackets; overlapping spans go as one.

    Null stays null, and no other column changes.
    """
    found = find(docs.select(F.struct("*").alias("__doc"), F.col(text_col).alias("__given")), "__given", "__spans")
    found = found.withColumn("__runs", F.when(F.size("__spans") > 0, _merged(F.col("__spans"))))
    clean = F.when(F.col("__runs").isNull(), F.col("__given")).otherwise(_cut(F.col("__given"), F.col("__runs")))
    return found.select(*[(clean if c == text_col else F.col("__doc")[c]).alias(c) for c in docs.columns])
