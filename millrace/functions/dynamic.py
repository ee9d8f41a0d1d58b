"""Dynamically typed values as Catalyst columns.

A value is null, an integer, a real, a text or a blob. It is kept as one column for each class that it may have, of which at most one isn't null in
any row; classes that an expression can't have have no column, so typed expressions stay plain typed columns that Spark can push down. An affinity, text
or numeric, belongs to table columns only and converts what they are compared with. Nothing here raises at run time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT, NUMERIC, NONE = "text", "numeric", None
NUMBER_HEAD = r"^[ \t\n\x0B\f\r]*([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
NUMBER_WHOLE = NUMBER_HEAD + r"[ \t\n\x0B\f\r]*$"
INTEGER = r"^[+-]?[0-9]+$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP = 9223372036854775808.0


@dataclass
class Value:
    """Columns by class: i (long), r (double), t (string), b (binary)."""

    i: Column | None = None
    r: Column | None = None
    t: Column | None = None
    b: Column | None = None
    affinity: str | None = NONE
    constant: object = field(default=None, repr=False)
    flag: Column | None = None  # the truth value itself, of what a condition gave
    whole: Column | None = None  # of a computed value, the struct that its columns are fields of

    def classes(self) -> str:
        return "".join(c for c in "irtb" if getattr(self, c) is not None)

    def bare(self) -> Value:
        return Value(self.i, self.r, self.t, self.b, flag=self.flag, whole=self.whole)


def first(*columns: Column | None) -> Column | None:
    there = [c for c in columns if c is not None]
    return None if not there else there[0] if len(there) == 1 else F.coalesce(*there)


def let(x: Column, body) -> Column:
    """body(x), with x computed once and standing in the expression once."""
    return F.transform(F.array(x), body)[0]


def computed(f):
    """For functions of values that give a value or a condition: computed operands are bound once, so that expressions grow with their text and not with its power."""

    def call(*operands, **options):
        values = [v for v in operands if isinstance(v, Value)]
        heavy = [k for k, v in enumerate(operands) if isinstance(v, Value) and (v.whole is not None or v.flag is not None) and v.classes()]
        if not heavy:
            out = f(*operands, **options)
            return out if isinstance(out, Column) else _held(out)
        assert values
        shape: dict = {}

        def body(bound: Column) -> Column:
            given = list(operands)
            for k in heavy:
                v = operands[k]
                given[k] = Value(**{c: bound[f"v{k}"][c] for c in v.classes()}, affinity=v.affinity, constant=v.constant)
            out = f(*given, **options)
            if isinstance(out, Column):
                shape["kind"] = None
                return out
            shape["kind"] = out.classes()
            return _struct(out)

        struct = F.struct(*[_whole(operands[k]).alias(f"v{k}") for k in heavy])
        whole = let(struct, body)
        if shape["kind"] is None:
            return whole
        return Value(**{c: whole[c] for c in shape["kind"]}, whole=whole)

    return call


def _struct(v: Value) -> Column:
    kinds = {"i": "long", "r": "double", "t": "string", "b": "binary"}
    return F.struct(*[getattr(v, c).cast(kinds[c]).alias(c) for c in v.classes()] or [F.lit(None).cast("string").alias("none")])


def _whole(v: Value) -> Column:
    return v.whole if v.whole is not None else _struct(v)


def _held(v: Value) -> Value:
    """A value that was just computed from plain columns or literals; constants stay what they are."""
    if v.constant is not None or v.whole is not None or v.flag is not None or not v.classes():
        return v
    whole = _struct(v)
    return Value(v.i, v.r, v.t, v.b, v.affinity, whole=whole)


def literal(x) -> Value:
    if x is None:
        return Value()
    if isinstance(x, bool):
        x = int(x)
    if isinstance(x, int):
        return Value(i=F.lit(x).cast("long"), constant=x) if -(2**63) <= x < 2**63 else Value(r=F.lit(float(x)), constant=float(x))
    if isinstance(x, float):
        return Value(r=F.lit(x).cast("double"), constant=x)
    if isinstance(x, bytes):
        return Value(b=F.lit(bytearray(x)), constant=x)
    return Value(t=F.lit(x), constant=x)


@computed
def is_null(v: Value) -> Column:
    there = None
    for x in (v.i, v.r, v.t, v.b):
        if x is not None:
            there = x.isNotNull() if there is None else there | x.isNotNull()
    return F.lit(True) if there is None else ~there


def integer_text(c: Column) -> Column:
    """Texts of integers that fit 64 bits as longs, else null."""
    return F.when(c.rlike(INTEGER), F.regexp_replace(c, r"^\+", "").try_cast("long"))


def text_of(v: Value) -> Column | None:
    """The value as text."""
    return first(v.t, v.i.cast("string") if v.i is not None else None, real_text(v.r) if v.r is not None else None, F.decode(v.b, "UTF-8") if v.b is not None else None)


def real_text(r: Column) -> Column:
    """A real with 15 digits and always a point or an exponent."""
    cut = F.format_string("%.14e", r).try_cast("double")
    plain = F.regexp_replace(cut.try_cast("decimal(38,20)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    science = F.regexp_replace(F.regexp_replace(cut.cast("string"), r"E([0-9])", r"e+$1"), "E", "e")
    science = F.regexp_replace(science, r"e([+-])([0-9])$", r"e$10$2")
    size = F.abs(cut)
    return (
        F.when(F.isnan(r), None).when(r == float("inf"), "Inf").when(r == float("-inf"), "-Inf").when(cut == 0, "0.0").when((size >= 1e15) | (size < 1e-4), science).otherwise(plain)
    )


def numeric(v: Value) -> Value:
    """For arithmetic: texts and blobs by their leading numeral, else 0."""
    words = first(v.t, F.decode(v.b, "UTF-8") if v.b is not None else None)
    if words is None:
        return Value(i=v.i, r=v.r)
    head = F.regexp_extract(words, NUMBER_HEAD, 1)
    whole = integer_text(head)
    real = F.when(words.isNotNull() & whole.isNull(), F.when(head == "", None).otherwise(head.try_cast("double")))
    return Value(i=first(v.i, F.when(words.isNotNull() & (head == ""), F.lit(0).cast("long")).otherwise(whole)), r=first(v.r, real))


def real(v: Value) -> Column | None:
    """As a double, of any class."""
    n = numeric(v)
    return first(n.r, n.i.cast("double") if n.i is not None else None)


def head_integer(v: Value) -> Column | None:
    """As a 64-bit integer: reals cut toward zero and clamped, texts by their leading integer."""
    words = first(v.t, F.decode(v.b, "UTF-8") if v.b is not None else None)
    of_text = None
    if words is not None:
        head = F.regexp_extract(words, r"^[ \t\n\x0B\f\r]*([+-]?[0-9]+)", 1)
        clamped = F.when(head.startswith("-"), F.lit(-(2**63)).cast("long")).otherwise(F.lit(2**63 - 1).cast("long"))
        of_text = F.when(words.isNotNull(), F.when(head == "", F.lit(0).cast("long")).otherwise(F.coalesce(F.regexp_replace(head, r"^\+", "").try_cast("long"), clamped)))
    of_real = None if v.r is None else F.when(v.r >= TOP, F.lit(2**63 - 1)).when(v.r <= -TOP, F.lit(-(2**63))).when(v.r < 0, F.ceil(v.r)).otherwise(F.floor(v.r)).cast("long")
    return first(v.i, of_real, of_text)


def with_numeric_affinity(v: Value) -> Value:
    """Texts that are numerals as a whole become numbers."""
    if v.t is None:
        return v
    head = F.when(v.t.rlike(NUMBER_WHOLE), F.regexp_extract(v.t, NUMBER_WHOLE, 1))
    whole = integer_text(head)
    return Value(first(v.i, whole), first(v.r, F.when(whole.isNull(), head.try_cast("double"))), F.when(head.isNull(), v.t), v.b)


def with_text_affinity(v: Value) -> Value:
    return Value(t=text_of(Value(v.i, v.r, v.t)), b=v.b)


def affine(a: Value, b: Value) -> tuple[Value, Value]:
    """Both sides of a comparison after their affinities have met."""
    if NUMERIC in (a.affinity, b.affinity):
        return (a if a.affinity == NUMERIC else with_numeric_affinity(a)), (b if b.affinity == NUMERIC else with_numeric_affinity(b))
    if a.affinity == TEXT and b.affinity != TEXT:
        return a, with_text_affinity(b)
    if b.affinity == TEXT and a.affinity != TEXT:
        return with_text_affinity(a), b
    return a, b


def _int_real(op: str, i: Column, r: Column) -> Column:
    """Exact comparison of a long with a double."""
    inside = F.when((r >= TOP) | (r < -TOP), None).otherwise(r)
    low, high = F.floor(inside), F.ceil(inside)
    if op == "=":
        return F.coalesce((low == high) & (i == low), F.lit(False) & i.isNotNull() & r.isNotNull())
    exact = {"<": i < high, "<=": i <= low, ">": i > low, ">=": i >= high}[op]
    return F.when(r >= TOP, F.lit(op in ("<", "<="))).when(r < -TOP, F.lit(op in (">", ">="))).otherwise(exact)


_TURN = {"=": "=", "<": ">", ">": "<", "<=": ">=", ">=": "<="}
_PLAIN = {"=": lambda x, y: x == y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}


def compared(op: str, a: Value, b: Value) -> Column:
    return _compared(a, b, op=op)


@computed
def _compared(a: Value, b: Value, op: str) -> Column:
    """One of = < > <= >=, null where a side is: numbers before texts before blobs; texts by code units' bytes."""
    a, b = affine(a, b)
    order = {"i": 0, "r": 0, "t": 1, "b": 2}
    out = None
    for x in a.classes():
        for y in b.classes():
            p, q = getattr(a, x), getattr(b, y)
            if order[x] != order[y]:
                result = F.lit(op != "=" and (order[x] < order[y]) == (op in ("<", "<=")))
            elif x == y:
                result = _PLAIN[op](p, q)
            elif x == "i":
                result = _int_real(op, p, q)
            else:
                result = _int_real(_TURN[op], q, p)
            if len(a.classes()) == len(b.classes()) == 1 and order[x] == order[y] and x == y:
                return result
            there = p.isNotNull() & q.isNotNull()
            out = F.when(there, result) if out is None else out.when(there, result)
    return F.lit(None).cast("boolean") if out is None else out


@computed
def same(a: Value, b: Value) -> Column:
    """IS: equality under which nulls are equal."""
    if not a.classes() or not b.classes():
        return is_null(a) & is_null(b)
    return F.when(is_null(a) | is_null(b), is_null(a) & is_null(b)).otherwise(compared("=", a, b))


def truth(v: Value) -> Column:
    """Whether the number that a value stands for isn't zero."""
    return v.flag if v.flag is not None else _truth(v)


@computed
def _truth(v: Value) -> Column:
    n = numeric(v)
    parts = [x != 0 for x in (n.i, n.r) if x is not None]
    return F.lit(None).cast("boolean") if not parts else first(*parts)


def boolean(c: Column) -> Value:
    return Value(i=c.cast("long"), flag=c)


@computed
def arithmetic(op: str, a: Value, b: Value) -> Value:
    """+ - * / %: integers stay exact and turn to doubles on overflow; division and remainder by zero are null."""
    if op == "%":
        x, y = head_integer(a), head_integer(b)
        if x is None or y is None:
            return Value()
        rest = F.when(y == 0, None).when(y == -1, F.lit(0).cast("long")).otherwise(F.try_mod(x, y))
        reals = [n.r for n in (numeric(a), numeric(b)) if n.r is not None]
        if not reals:
            return Value(i=rest)
        floating = first(*[r.isNotNull() for r in reals]) if len(reals) == 1 else reals[0].isNotNull() | reals[1].isNotNull()
        return Value(i=F.when(~floating, rest), r=F.when(floating, rest.cast("double")))
    a, b = numeric(a), numeric(b)
    if not a.classes() or not b.classes():
        return Value()
    x, y = (first(v.r, v.i.cast("double") if v.i is not None else None) for v in (a, b))
    in_reals = {"+": x + y, "-": x - y, "*": x * y, "/": F.when(y != 0, F.try_divide(x, y))}[op]
    in_reals = F.when(~F.isnan(in_reals), in_reals)
    if a.i is None or b.i is None:
        return Value(r=in_reals)
    whole = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": _div}[op](a.i, b.i)
    return Value(i=whole, r=F.when(whole.isNull(), in_reals))


def _div(a: Column, b: Column) -> Column:
    """Integer quotient toward zero, null by zero, for longs whose quotient fits."""
    safe = F.when((b == 0) | ((a == -(2**63)) & (b == -1)), None).otherwise(b)
    rest = F.try_mod(a, safe)
    # a - rest is a multiple of b, and a decimal of 20 digits holds the quotient exactly
    return ((a - rest).cast("decimal(20,0)") / safe.cast("decimal(20,0)")).try_cast("long")


@computed
def negated(v: Value) -> Value:
    n = numeric(v)
    if n.i is None:
        return Value(r=-n.r if n.r is not None else None)
    least = n.i == -(2**63)
    real_part = F.when(least, F.lit(TOP))
    return Value(i=F.when(~least, -F.when(~least, n.i)), r=first(-n.r, real_part) if n.r is not None else real_part)


def chosen(branches: list[tuple[Column, Value]], otherwise: Value) -> Value:
    """The first branch whose condition is true."""
    return _chosen(*[x for c, v in branches for x in (boolean(c), v)], otherwise)


@computed
def _chosen(*values: Value) -> Value:
    every = values[1::2] + values[-1:]
    conditions = [v.flag if v.flag is not None else v.i != 0 for v in values[:-1:2]]
    out = {}
    for k in "irtb":
        if any(getattr(v, k) is not None for v in every):
            column = None
            for condition, v in zip(conditions, every):
                value = getattr(v, k) if getattr(v, k) is not None else F.lit(None)
                column = F.when(condition, value) if column is None else column.when(condition, value)
            last = getattr(every[-1], k)
            out[k] = column.otherwise(last) if last is not None else column
    return Value(**out)


@computed
def like(text: Value, pattern: Value, escape: str | None) -> Column:
    """ASCII letters match in either case, others exactly; no character escapes unless `escape` is given."""
    x, p = text_of(text), text_of(pattern)
    if x is None or p is None:
        return F.lit(None).cast("boolean")
    fold = lambda c: F.translate(c, UPPER, LOWER)
    if isinstance(pattern.constant, str):
        lower = str.maketrans(UPPER, LOWER)
        return fold(x).rlike(_like_regex(pattern.constant.translate(lower), escape and escape.translate(lower)))
    return F.rlike(fold(x), _like_column(fold(p), escape))


def _like_regex(pattern: str, escape: str | None) -> str:
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if escape and c == escape and k + 1 < len(pattern):
            k += 1
            out.append(_quoted(pattern[k]))
        elif c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        else:
            out.append(_quoted(c))
        k += 1
    return r"(?s)\A" + "".join(out) + r"\z"


def _quoted(c: str) -> str:
    return c if c.isalnum() else f"\\x{{{ord(c):x}}}"


def _like_column(p: Column, escape: str | None) -> Column:
    """The same for patterns that are columns; an escape isn't supported there."""
    if escape:
        raise ValueError("ESCAPE needs a pattern that is a literal or an argument")
    quoted = F.regexp_replace(p, r"([^A-Za-z0-9%_\s])", r"\\$1")
    return F.concat(F.lit(r"(?s)\A"), F.regexp_replace(F.regexp_replace(quoted, "%", ".*"), "_", "."), F.lit(r"\z"))


@computed
def substring(v: Value, start: Value, length: Value | None) -> Value:
    """Positions count from 1, from the end where negative; a negative length takes what lies before the start."""
    from_ = head_integer(start)
    count = head_integer(length) if length is not None else None
    if from_ is None or (length is not None and count is None):
        return Value()
    big = F.lit(1 << 40).cast("long")
    clamp = lambda c: F.least(F.greatest(c, -big), big)

    def cut(x: Column, size: Column, take) -> Column:
        p, n = clamp(from_), clamp(count) if count is not None else big
        begin = F.when(p > 0, p - 1).when(p < 0, size + p).otherwise(F.lit(-1).cast("long"))  # 0 stands before the first
        begin = F.when((p < 0) & (begin < 0), begin).otherwise(begin)
        low = F.when(n < 0, begin + n).otherwise(begin)
        high = F.when(n < 0, begin).otherwise(begin + n)
        low, high = F.greatest(low, F.lit(0).cast("long")), F.least(F.greatest(high, F.lit(0).cast("long")), size)
        width = F.greatest(high - low, F.lit(0).cast("long"))
        there = from_.isNotNull() & (count.isNotNull() if count is not None else F.lit(True))
        return F.when(there, take(x, (F.least(low, size) + 1).cast("int"), width.cast("int")))

    out = Value()
    words = text_of(Value(v.i, v.r, v.t))
    if words is not None:
        out.t = cut(words, F.length(words).cast("long"), lambda x, p, n: F.substring(x, p, n))
    if v.b is not None:
        out.b = cut(v.b, F.octet_length(v.b).cast("long"), lambda x, p, n: F.substring(x, p, n))
    return out
