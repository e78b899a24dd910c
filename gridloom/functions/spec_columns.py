"""Channel specs as columns: the algebra of functions.channels on strings, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .channels import ALIASES

_RANGE = r"^(.*?)[.:](-?\d+)(?::(-?\d+)(?::(-?\d+))?)?$"


def codes(spec: Column) -> Column:
    return F.filter(F.split(spec, r"\|"), lambda c: c != "")


def _expand(code: Column) -> Column:
    part = lambda i: F.regexp_extract(code, _RANGE, i)
    number = lambda c: F.when(c != "", c).cast("int")
    root, a, b, step = part(1), number(part(2)), number(part(3)), F.coalesce(number(part(4)), F.lit(1))
    single = ~code.rlike(_RANGE) | (b.isNull() & code.rlike(r"\.-?\d+$"))
    start, stop = F.when(b.isNull(), 0).otherwise(a), F.coalesce(b, a)
    last = stop - F.when(step > 0, 1).otherwise(-1)
    some = F.when(step > 0, start < stop).otherwise(start > stop)
    at = F.when(some, F.sequence(start, F.when(some, last).otherwise(start), F.when(some, step).otherwise(0)))
    ranged = F.transform(F.coalesce(at, F.array().cast("array<int>")), lambda i: F.concat_ws(".", root, i.cast("string")))
    out = F.when(single, F.array(code)).otherwise(ranged)
    for name, bands in ALIASES.items():
        out = F.when(code == name, F.array(*map(F.lit, bands))).otherwise(out)
    return out


def normalized(spec: Column) -> Column:
    """All bands, as an array."""
    return F.flatten(F.transform(codes(spec), _expand))


def concise(spec: Column) -> Column:
    """Adjacent ascending runs of one root as ranges, as a string: a fold over the bands."""
    split = lambda b: F.struct(
        F.regexp_extract(b, r"^(.*)\.\d+$", 1).alias("root"), F.coalesce(F.regexp_extract(b, r"^.*\.(\d+)$", 1).try_cast("int"), F.lit(-1)).alias("at"), b.alias("code")
    )
    run = "array<struct<root:string,first:int,next:int,code:string>>"

    def step(runs, b):
        last = F.element_at(runs, -1)
        longer = (F.size(runs) > 0) & (b["at"] >= 0) & (F.try_element_at(runs, F.lit(-1))["root"] == b["root"]) & (F.try_element_at(runs, F.lit(-1))["next"] == b["at"])
        grown = F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.array(F.struct(last["root"].alias("root"), last["first"].alias("first"), (b["at"] + 1).alias("next"), last["code"].alias("code"))))
        added = F.concat(runs, F.array(F.struct(b["root"].alias("root"), b["at"].alias("first"), F.when(b["at"] < 0, -9).otherwise(b["at"] + 1).alias("next"), b["code"].alias("code"))))
        return F.when(longer, grown).otherwise(added)

    runs = F.aggregate(F.transform(normalized(spec), split), F.array().cast(run), step)
    text = lambda r: (
        F.when((r["first"] < 0) | (r["next"] == r["first"] + 1), r["code"])
        .when(r["first"] == 0, F.concat(r["root"], F.lit(":"), r["next"].cast("string")))
        .otherwise(F.concat(r["root"], F.lit("."), r["first"].cast("string"), F.lit(":"), r["next"].cast("string")))
    )
    return F.array_join(F.transform(runs, text), "|")


def numel(spec: Column) -> Column:
    return F.size(normalized(spec))


def sizes(spec: Column) -> Column:
    return F.transform(codes(spec), lambda c: F.size(_expand(c)))


def difference(a: Column, b: Column) -> Column:
    return F.array_except(normalized(a), normalized(b))


def intersection(a: Column, b: Column) -> Column:
    return F.filter(normalized(a), lambda c: F.array_contains(normalized(b), c))


def union(a: Column, b: Column) -> Column:
    return F.array_union(normalized(a), normalized(b))


def issubset(a: Column, b: Column) -> Column:
    return F.size(difference(a, b)) == 0


def component_indices(spec: Column) -> Column:
    """Array of (code, start, stop), by true sizes."""
    n = sizes(spec)
    ends = F.transform(n, lambda _, i: F.aggregate(F.slice(n, F.lit(1), i + 1), F.lit(0), lambda a, v: a + v))
    return F.transform(codes(spec), lambda c, i: F.struct(c.alias("code"), (F.get(ends, i) - F.get(n, i)).alias("start"), F.get(ends, i).alias("stop")))


def path(spec: Column) -> Column:
    """A spec as a file name; for specs within the length limit."""
    for old, new in (("|", "_"), ("<", "-LT-"), (">", "-GT-"), (":", ".."), ("?", "_Q_"), ("*", "_S_")):
        spec = F.replace(spec, F.lit(old), F.lit(new))
    return F.when(spec.rlike(r"[. ]$"), F.concat(spec, F.lit("_"))).otherwise(spec)


def encode(arrays: dict[str, Column], stream: str) -> Column:
    """One array from the arrays of a stream's codes, in order."""
    return F.concat(*[arrays[c] for c in stream.split("|")])


def decode(fused: Column, stream: str) -> dict[str, Column]:
    """The arrays of a stream's codes, cut from one array."""
    from .channels import FusedChannelSpec

    places = FusedChannelSpec.coerce(stream).component_indices()
    return {c: F.slice(fused, p[0].start + 1, p[0].stop - p[0].start) for c, p in places.items()}
