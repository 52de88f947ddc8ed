"""How values look at the edges, and the scalar functions that reducers use."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _row(schema: T.StructType, of: dict[type, object], column=F.col) -> Column:
    parts = []
    for f in schema:
        made = next((make for kind, make in of.items() if isinstance(f.dataType, kind)), None)
        parts.append((made(column(f.name)) if made else column(f.name)).alias(f.name))
    return F.struct(*parts)


def _finite(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def render_changefeed(schema: T.StructType, column=F.col) -> Column:
    """JSON of a row as change events carry it: times are null, NaN and infinities too, bytes are base64."""
    return F.to_json(_row(schema, {T.TimestampType: lambda c: F.lit(None).cast("string"), T.TimestampNTZType: lambda c: F.lit(None).cast("string"), T.BinaryType: F.base64, T.FractionalType: _finite}, column), {"ignoreNullFields": "false"})


def render_module(schema: T.StructType, column=F.col) -> Column:
    """JSON of a row as reducers read it: bytes as {"$bytes": base64}, times in milliseconds."""
    wrap = lambda c: F.when(c.isNotNull(), F.struct(F.base64(c).alias("$bytes")))
    return F.to_json(_row(schema, {T.TimestampType: F.unix_millis, T.TimestampNTZType: epoch_millis, T.BinaryType: wrap, T.FractionalType: _finite}, column), {"ignoreNullFields": "false"})


def render_initial_state(schema: T.StructType, column=F.col) -> Column:
    """JSON of a row in a first snapshot: bytes in lower-case hex, times in seconds."""
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    return F.to_json(_row(schema, {T.TimestampType: seconds, T.TimestampNTZType: seconds, T.BinaryType: lambda c: F.lower(F.hex(c)), T.FractionalType: _finite}, column), {"ignoreNullFields": "false"})


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def unwrap_bytes(value: Column) -> Column:
    """Bytes of a base64 text; null if it is none."""
    return F.try_to_binary(value, F.lit("base64"))


def json_number(json: Column, path: str, default: float) -> Column:
    """A number of a JSON text, or the default if it is missing or no number."""
    at = F.variant_get(F.try_parse_json(json), path, "variant")
    number = F.when(F.schema_of_variant(at).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), F.try_variant_get(F.try_parse_json(json), path, "double"))
    return F.coalesce(number, F.lit(float(default)))


def version_parts(version: Column) -> Column:
    """A dotted version as an array that sorts like it; parts that are no number count as 0."""
    return F.transform(F.split(version, r"\."), lambda p: F.coalesce(p.try_cast("long"), F.lit(0)))


def grid_cell(x: Column, size: float) -> Column:
    return F.floor(x / size)


def accrued(rate: Column, seconds: Column, cap: Column) -> Column:
    return F.least(rate * seconds, cap)


def moved_toward(at: Column, goal: Column, step: Column) -> Column:
    """One step of at most `step` toward the goal, never past it."""
    return at + F.signum(goal - at) * F.least(F.abs(goal - at), step)


def fnv1a_unit(text: Column) -> Column:
    """FNV-1a of a text's bytes (32 bits) as a number in [0, 1). The product modulo 2^32 is taken without overflow."""
    prime, mask = F.lit(16777619), F.lit(0xFFFFFFFF)
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.substring(F.hex(text), i * 2 - 1, F.lit(2)), 16, 10).cast("long"))
    h = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda s, b: (s.bitwiseXOR(b) * prime).bitwiseAND(mask))
    return F.when(F.octet_length(text) == 0, F.lit(2166136261 / 2**32)).otherwise(h / F.lit(float(2**32)))


def generated_id(now_ms: int, number: Column) -> Column:
    """Milliseconds in the upper bits, a counter of 20 bits below."""
    return F.shiftleft(F.lit(now_ms).cast("long"), 20).bitwiseOR(number.cast("long").bitwiseAND(F.lit(0xFFFFF).cast("long")))


#: Names of users and tables: so many letters, digits, _ and - at most.
NAME_LENGTH = 16


def valid_name(name: str, longest: int = 64) -> bool:
    return re.fullmatch(rf"[A-Za-z0-9_-]{{1,{longest}}}", name) is not None


def is_name(text: Column, longest: int = NAME_LENGTH) -> Column:
    """Whether a text is a name; null is none."""
    return F.coalesce(text.rlike(rf"\A[A-Za-z0-9_-]{{1,{longest}}}\z"), F.lit(False))


def words_of(text: Column, separator: str = ",") -> Column:
    """The parts of a list in a text, trimmed, lower-cased, without empty ones."""
    return F.filter(F.transform(F.split(text, separator), lambda p: F.lower(F.trim(p))), lambda p: p != "")


def clamped(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.least(x, high), low)


def distance(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def direction(dx: Column, dy: Column) -> Column:
    """struct(x, y) of length 1, or 0 where there is no way to go."""
    d = distance(dx, dy)
    return F.struct(F.when(d > 0, dx / d).otherwise(0.0).alias("x"), F.when(d > 0, dy / d).otherwise(0.0).alias("y"))


#: The factors of the lattice hash.
LATTICE = (374761393, 668265263, 1274126177)
_MASK = 0xFFFFFFFF


def _times(h: Column, factor: int) -> Column:
    """h * factor modulo 2^32 for h below 2^32, by halves of h, so that no product leaves a long."""
    low, high = h.bitwiseAND(F.lit(0xFFFF).cast("long")), F.shiftrightunsigned(h, 16)
    over = F.shiftleft((high * factor).bitwiseAND(F.lit(0xFFFF).cast("long")), 16)
    return (low * factor + over).bitwiseAND(F.lit(_MASK).cast("long"))


def lattice_unit(x: Column, y: Column, seed: int) -> Column:
    """A number in [0, 1) for a point of whole coordinates, from a 32-bit hash."""
    mask, (by_x, by_y, last) = F.lit(_MASK).cast("long"), LATTICE
    h = (_times(x.cast("long").bitwiseAND(mask), by_x) + _times(y.cast("long").bitwiseAND(mask), by_y) + F.lit(seed * 1442695040 & _MASK).cast("long")).bitwiseAND(mask)
    h = _times(h.bitwiseXOR(F.shiftrightunsigned(h, 13)), last)
    return h.bitwiseXOR(F.shiftrightunsigned(h, 16)).bitwiseAND(F.lit(0xFFFFFF).cast("long")) / F.lit(float(1 << 24))


def value_noise(x: Column, y: Column, seed: int) -> Column:
    """Smooth noise in [0, 1): the lattice's numbers at the four corners around a point, blended by a cubic."""
    left, below = F.floor(x), F.floor(y)
    ease = lambda t: t * t * (3.0 - 2.0 * t)
    across, up = ease(x - left), ease(y - below)
    row = lambda at: lattice_unit(left, at, seed) * (1.0 - across) + lattice_unit(left + 1, at, seed) * across
    return row(below) * (1.0 - up) + row(below + 1) * up


def random_walk(seed: Column, n: int) -> Column:
    """The next n numbers in [0, 1) of a xorshift generator of 64 bits (13, 7, 17), as an array; the seed isn't 0."""

    def turn(s: Column, _: Column) -> Column:
        x = s["x"].bitwiseXOR(F.shiftleft(s["x"], 13))
        x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
        x = x.bitwiseXOR(F.shiftleft(x, 17))
        unit = F.shiftrightunsigned(x, 11) / F.lit(float(1 << 53))
        return F.struct(x.alias("x"), F.concat(s["out"], F.array(unit)).alias("out"))

    start = F.struct(seed.cast("long").alias("x"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, turn, lambda s: s["out"])
