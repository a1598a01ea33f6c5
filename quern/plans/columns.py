"""Filters over typed rows as Spark columns.

``scalar`` gives the one output of a filter for a row, as a typed column, or raises
Unsupported; the caller then runs the row interpreter.  null is a value: equality is null-safe,
null sorts below everything, and + takes null as nothing.  A null operand of another operator,
and a zero divisor, give null here where the interpreter reports an error.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import ended


class Unsupported(Exception):
    pass


@dataclass
class Value:
    """A typed column; test: a plainer form that is true for the same rows and else false or null, for filters; constant: it is a literal."""

    col: Column
    type: T.DataType
    test: Column | None = None
    constant: bool = False
    number: float | None = None


@dataclass
class Row:
    """A row or an object under construction: fields in order."""

    fields: dict


@dataclass
class Pair:
    """Two joined rows, as an array of two."""

    left: Row
    right: Row


DOUBLE, STRING, BOOLEAN, LONG = T.DoubleType(), T.StringType(), T.BooleanType(), T.LongType()


def _kept(f):
    """A rounding that keeps NaN, infinities, numbers without a fraction and the sign of zero."""

    def of(x):
        whole = f(x).cast("double")
        return F.when(F.isnan(x) | (F.abs(x) >= F.lit(2.0**53)), x).when(whole == 0, x * F.lit(0.0)).otherwise(whole)

    return of


UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Number functions whose column function agrees for finite arguments.
MATH = {
    "floor": _kept(F.floor), "ceil": _kept(F.ceil), "round": _kept(lambda x: F.signum(x) * (F.floor(F.abs(x)) + (F.abs(x) - F.floor(F.abs(x)) >= 0.5).cast("int"))), "fabs": F.abs, "abs": F.abs, "sqrt": F.sqrt, "cbrt": F.cbrt, "exp": F.exp, "expm1": F.expm1,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh,
    "rint": F.rint, "exp2": lambda x: F.pow(F.lit(2.0), x), "exp10": lambda x: F.pow(F.lit(10.0), x), "trunc": _kept(lambda x: F.signum(x) * F.floor(F.abs(x))),
}
LOGS = {"log": (F.log, 0.0), "log2": (F.log2, 0.0), "log10": (F.log10, 0.0), "log1p": (F.log1p, -1.0)}
PAIRS = {"pow": F.pow, "atan2": F.atan2, "hypot": F.hypot}


def row_of(schema: T.StructType, prefix: str = "") -> Row:
    return Row({f.name: Value(F.col(f"{prefix}`{f.name}`"), f.dataType) for f in schema})


def is_num(v) -> bool:
    return isinstance(v, Value) and isinstance(v.type, T.NumericType)


def is_float(v) -> bool:
    return isinstance(v, Value) and isinstance(v.type, (T.DoubleType, T.FloatType))


def is_str(v) -> bool:
    return isinstance(v, Value) and isinstance(v.type, T.StringType)


def is_null(v) -> bool:
    return isinstance(v, Value) and isinstance(v.type, T.NullType)


def is_time(v) -> bool:
    return isinstance(v, Value) and isinstance(v.type, (T.TimestampType, T.TimestampNTZType, T.DateType))


def seconds(v: Value) -> Value:
    """A time as a number: seconds since 1970."""
    return Value((F.unix_micros(v.col.cast("timestamp")) / 1_000_000).cast("double"), DOUBLE)


def num(v) -> Column:
    if is_time(v):
        v = seconds(v)
    if not is_num(v):
        raise Unsupported("not a number")
    return v.col.cast("double")


def text(v) -> Column:
    if not is_str(v):
        raise Unsupported("not a string")
    return v.col


def truthy(v) -> Column:
    if isinstance(v, Row):
        return F.lit(True)
    return F.coalesce(v.col, F.lit(False)) if isinstance(v.type, T.BooleanType) else v.col.isNotNull()


def condition(v) -> Column:
    """truthy() where null counts as false: a form that Spark can push into a scan."""
    return v.test if isinstance(v, Value) and v.test is not None else truthy(v)


def struct(v) -> Value:
    """A row as one column."""
    if isinstance(v, Value):
        return v
    inner = {k: struct(x) for k, x in v.fields.items()}
    if not inner:
        raise Unsupported("empty object")
    return Value(F.struct(*(x.col.alias(k) for k, x in inner.items())), T.StructType([T.StructField(k, x.type) for k, x in inner.items()]))


def _whole(v: Value, other: Value) -> Value:
    """A whole literal as an integer where it meets one, so that the column isn't cast."""
    if v.constant and is_num(v) and isinstance(other.type, T.IntegralType) and (x := v.number) is not None and x == int(x) and abs(x) < 2**31:
        return Value(F.lit(int(x)), T.IntegerType(), constant=True)
    return v


def compared(op: str, a, b) -> Value:
    a, b = struct(a), struct(b)
    if is_time(a) or is_time(b):
        a, b = Value(num(a), DOUBLE), Value(num(b), DOUBLE)
    if op in ("==", "!=") and is_null(a) != is_null(b):
        known = (b if is_null(a) else a).col.isNotNull()
        return Value(known if op == "!=" else ~known, BOOLEAN, known if op == "!=" else None)
    same = is_null(a) or is_null(b) or (is_num(a) and is_num(b)) or type(a.type) is type(b.type)
    if not same or isinstance(a.type, (T.StructType, T.ArrayType, T.MapType)):
        raise Unsupported("compared kinds")
    a, b = _whole(a, b), _whole(b, a)
    x, y = a.col, b.col
    floats = any(isinstance(v.type, (T.DoubleType, T.FloatType)) for v in (a, b))
    nan_x = F.coalesce(F.isnan(x), F.lit(False)) if isinstance(a.type, (T.DoubleType, T.FloatType)) else F.lit(False)
    nan_y = F.coalesce(F.isnan(y), F.lit(False)) if isinstance(b.type, (T.DoubleType, T.FloatType)) else F.lit(False)

    def equal():
        return (x.eqNullSafe(y) & ~nan_x) if floats else x.eqNullSafe(y)

    def below(x, y, nan_x, nan_y):
        least = x.isNull() & y.isNotNull()
        plain = F.coalesce(x < y, F.lit(False))
        return least | (y.isNotNull() & x.isNotNull() & (nan_x | (plain & ~nan_y))) if floats else least | plain

    found = {
        "==": equal, "!=": lambda: ~equal(), "<": lambda: below(x, y, nan_x, nan_y), ">": lambda: below(y, x, nan_y, nan_x),
        "<=": lambda: ~below(y, x, nan_y, nan_x), ">=": lambda: ~below(x, y, nan_x, nan_y),
    }[op]()
    return Value(found, BOOLEAN, _plain_test(op, a, b))


def _plain_test(op: str, a: Value, b: Value) -> Column | None:
    """The comparison with a literal as scans know it."""
    if a.constant and not b.constant:
        a, b, op = b, a, {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op)
    if a.constant or not b.constant or is_null(b):
        return None
    x, y = a.col, b.col
    floats = isinstance(a.type, (T.DoubleType, T.FloatType))
    if op in (">", ">="):
        test = x > y if op == ">" else x >= y
        return test & ~F.isnan(x) if floats else test
    if op in ("==", "!="):
        return x == y if op == "==" else None
    return None if floats else x.isNull() | (x < y if op == "<" else x <= y)


def arithmetic(op: str, a, b) -> Value:
    if isinstance(a, Row) or isinstance(b, Row):
        if op == "+" and isinstance(a, Row) and isinstance(b, Row):
            return Row({**a.fields, **b.fields})
        raise Unsupported("objects")
    if op == "+":
        if is_null(a) or is_null(b):
            return b if is_null(a) else a
        if is_str(a) and is_str(b):
            return Value(F.when(a.col.isNull() & b.col.isNull(), None).otherwise(F.concat(F.coalesce(a.col, F.lit("")), F.coalesce(b.col, F.lit("")))), STRING)
        if isinstance(a.type, T.ArrayType) and a.type == b.type:
            return Value(F.coalesce(F.concat(a.col, b.col), a.col, b.col), a.type)
        x, y = num(a), num(b)
        return Value(F.coalesce(x + y, x, y), DOUBLE)
    if op == "/" and is_str(a) and is_str(b):
        return split(a, b)
    x, y = num(a), num(b)
    if op == "%":
        whole = lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))
        rest = F.when(whole(y) == -1, F.lit(0.0)).otherwise(F.try_mod(whole(x), whole(y)).cast("double"))
        return Value(F.when(F.isnan(x) | F.isnan(y), F.lit(float("nan"))).otherwise(rest), DOUBLE)
    return Value({"-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y)}[op](), DOUBLE)


def split(a: Value, b: Value) -> Value:
    quoted = F.concat(F.lit("\\Q"), b.col, F.lit("\\E"))
    return Value(F.when(a.col == "", F.array().cast("array<string>")).otherwise(F.split(a.col, quoted, -1)), T.ArrayType(STRING))


def once(col: Column, f) -> Column:
    """f of a column that is computed once, however often f names it."""
    return F.transform(F.array(col), f)[0]


#: Places behind the point that are tried by arithmetic before digits are made as text.
PLACES = 4


def number_text(v: Value) -> Column:
    """How a number prints: the fewest digits that read back, an exponent only far from the point; null for null."""
    x = v.col.cast("double")
    if isinstance(v.type, T.IntegralType) and not isinstance(v.type, T.LongType):
        return v.col.cast("string")
    a = F.abs(x)
    whole = F.when(a < 1e15, x).cast("long")
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    out = F.when(x.isNull(), F.lit(None).cast("string")).when(F.isnan(x), F.lit("null")).when((whole == x) & (whole != 0), whole.cast("string")).when(x == 0, F.when(x.cast("string") == "-0.0", F.lit("-0")).otherwise(F.lit("0")))
    for k in range(1, PLACES + 1):  # of decimals of at most 15 digits one reads back, that of the fewest places; m / 10^k is rounded once, as reading is
        m = F.rint(F.when(a < 10.0 ** (15 - k), a * F.lit(10.0**k)))
        behind = (m.cast("long") % F.lit(10**k)).cast("string")
        out = out.when((a >= 1e-4) & (m / F.lit(10.0**k) == a), F.concat(sign, F.abs(whole).cast("string"), F.lit("."), F.lpad(behind, k, "0")))
    return out.when(a == float("inf"), F.concat(sign, F.lit("1.7976931348623157e+308"))).otherwise(F.concat(sign, once(a, digits)))


def digits(a: Column) -> Column:
    """The text of a finite number above zero, each step of it computed once."""
    # Java's own digits aren't always the fewest, so 15 and 16 of them are tried first
    tried = lambda n, other: once(F.format_string(f"%.{n}e", a), lambda s: F.when(s.cast("double") == a, s).otherwise(other))
    return once(F.lower(tried(14, tried(15, a.cast("string")))), lambda low: once(F.substring_index(low, "e", 1), lambda mantissa: placed(low, mantissa)))


def placed(low: Column, mantissa: Column) -> Column:
    exponent = F.when(F.contains(low, F.lit("e")), F.substring_index(low, "e", -1).cast("int")).otherwise(F.lit(0))
    every = F.replace(mantissa, F.lit("."), F.lit(""))
    lead = F.length(every) - F.length(F.ltrim(every, F.lit("0")))
    body = F.rtrim(F.ltrim(every, F.lit("0")), F.lit("0"))
    point = F.instr(F.concat(mantissa, F.lit(".")), ".") - 1 - lead + exponent
    return once(body, lambda body: once(point, lambda point: shown(body, point)))


def shown(body: Column, point: Column) -> Column:
    """Digits with the point behind so many of them, or with an exponent."""
    n = F.length(body)
    e = point - 1
    far = F.concat(F.substring(body, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(body, F.lit(2), n))).otherwise(F.lit("")), F.lit("e"), F.when(e < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
    near = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), body))
        .when(n <= point, F.concat(body, F.repeat(F.lit("0"), point - n)))
        .otherwise(F.concat(F.substring(body, F.lit(1), point), F.lit("."), F.substring(body, point + 1, n)))
    )
    return F.when((point <= -4) | (point > n + 15), far).otherwise(near)


def tostring(v) -> Column:
    v = struct(v)
    if is_str(v):
        return F.coalesce(v.col, F.lit("null"))
    if isinstance(v.type, T.BooleanType) or (isinstance(v.type, T.IntegralType) and not isinstance(v.type, T.LongType)):
        return F.coalesce(v.col.cast("string"), F.lit("null"))
    if isinstance(v.type, T.LongType):  # beyond 2^53 a number isn't its digits
        plain = v.col.cast("string")
        return F.coalesce(F.when(F.abs(v.col) <= F.lit(2**53), plain).otherwise(number_text(v)), F.lit("null"))
    if is_time(v):
        v = seconds(v)
    if is_num(v):
        return F.coalesce(number_text(v), F.lit("null"))
    if is_null(v):
        return F.lit("null")
    raise Unsupported("text of this kind")


HTML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;"))


def formatted(name: str, v) -> Column:
    if name in ("text", "json") and not (name == "json" and is_str(v)):
        return tostring(v)
    x = tostring(v)
    if name == "base64":
        return F.base64(F.encode(x, "UTF-8"))
    if name == "html":
        for a, b in HTML:
            x = F.replace(x, F.lit(a), F.lit(b))
        return x
    if name == "uri":
        x = F.url_encode(x)
        for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
            x = F.replace(x, F.lit(a), F.lit(b))
        return x
    if name == "sh" and is_str(v):
        return F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    raise Unsupported(f"@{name}")


class Scope:
    """What '.' and the variables stand for, and how filters over a bag of rows are read, where there is one."""

    def __init__(self, dot, variables: dict | None = None, bag=None) -> None:
        self.dot, self.variables, self.bag = dot, variables or {}, bag

    def at(self, dot) -> Scope:
        return Scope(dot, self.variables)

    def bind(self, **more) -> Scope:
        return Scope(self.dot, {**self.variables, **more}, self.bag)


def constant(node):
    if node[0] == "literal":
        return node[1]
    if node[0] == "negate" and node[1][0] == "literal":
        return -node[1][1]
    raise Unsupported("not a constant")


def scalar(node, scope: Scope):
    if scope.bag is not None and (found := scope.bag(node, scope)) is not None:
        return found
    if node[0] not in RULES:
        raise Unsupported(node[0])
    return RULES[node[0]](node, scope)


def _dot(scope):
    if scope.dot is None:
        raise Unsupported("a bag as a value")
    return scope.dot


def _literal(node, scope):
    x = node[1]
    if x is None:
        return Value(F.lit(None), T.NullType())
    if isinstance(x, bool):
        return Value(F.lit(x), BOOLEAN, constant=True)
    if isinstance(x, str):
        return Value(F.lit(x), STRING, constant=True)
    if isinstance(x, (float, int)):
        return Value(F.lit(float(x)), DOUBLE, constant=x == x, number=float(x) if abs(x) < 2**53 else None)
    raise Unsupported("container literal")


def _var(node, scope):
    found = scope.variables.get(node[1])
    if not isinstance(found, (Value, Row)):
        raise Unsupported(f"${node[1]}")
    return found


def _index(node, scope):
    target = scalar(node[1], scope)
    k = constant(node[2])
    if isinstance(target, Pair) and k in (0.0, 1.0) and not isinstance(k, bool):
        return target.right if k else target.left
    if isinstance(k, bool):
        raise Unsupported("index")
    if is_null(target):
        return target
    if isinstance(k, str):
        if isinstance(target, Row):
            return target.fields.get(k) or Value(F.lit(None), T.NullType())
        if isinstance(target.type, T.StructType):
            return Value(target.col.getField(k), target.type[k].dataType) if k in target.type.names else Value(F.lit(None), T.NullType())
        if isinstance(target.type, T.MapType):
            return Value(F.try_element_at(target.col, F.lit(k)), target.type.valueType)
    elif isinstance(k, (float, int)) and isinstance(target, Value) and isinstance(target.type, T.ArrayType):
        if not abs(k) < 2**31:
            return Value(F.lit(None).cast(target.type.elementType), target.type.elementType)
        i = int(k)
        return Value(F.try_element_at(target.col, F.lit(i + 1 if i >= 0 else i)), target.type.elementType)
    raise Unsupported("index")


def _bound(node, rounded) -> int | None:
    x = constant(node)
    if x is None or x != x:
        return None
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        raise Unsupported("bound")
    return max(-(2**31) + 1, min(2**31 - 1, rounded(x))) if math.isfinite(x) else int(math.copysign(2**31 - 1, x))


def _slice(node, scope):
    target = scalar(node[1], scope)
    start, end = (None if x is None else _bound(x, f) for x, f in zip(node[2:4], (math.floor, math.ceil), strict=True))
    if is_str(target):
        n, cut = F.length(target.col), lambda a, size: F.substring(target.col, a + 1, size)
    elif isinstance(target, Value) and isinstance(target.type, T.ArrayType):
        n, cut = F.size(target.col), lambda a, size: F.slice(target.col, a + 1, size)
    else:
        raise Unsupported("slice")
    # an end of -0.5 is rounded to 0, but counts from the end
    back = node[3] is not None and (x := constant(node[3])) is not None and x < 0
    place = lambda x, default, back: default if x is None else F.least(F.greatest(F.lit(x) + (n if back else 0), F.lit(0)), n)
    a, b = place(start, F.lit(0), start is not None and start < 0), place(end, n, back)
    return Value(F.when(target.col.isNotNull(), cut(a, F.greatest(b - a, F.lit(0)))), target.type)


def _alt(node, scope):
    a, b = scalar(node[1], scope), scalar(node[2], scope)
    if is_null(a):
        return b
    if isinstance(a, Row) or isinstance(b, Row):
        raise Unsupported("objects")
    kind = a.type if is_null(b) or type(a.type) is type(b.type) else DOUBLE if is_num(a) and is_num(b) else None
    if kind is None:
        raise Unsupported("mixed kinds")
    return Value(F.when(truthy(a), a.col.cast(kind)).otherwise(b.col.cast(kind)), kind)


def _if(node, scope):
    c, a, b = scalar(node[1], scope), scalar(node[2], scope), scalar(node[3], scope)
    a, b = struct(a), struct(b)
    kind = a.type if is_null(b) or a.type == b.type else b.type if is_null(a) else DOUBLE if is_num(a) and is_num(b) else None
    if kind is None:
        raise Unsupported("mixed kinds")
    return Value(F.when(truthy(c), a.col.cast(kind)).otherwise(b.col.cast(kind)), kind)


def _object(node, scope):
    fields = {}
    for key, value in node[1]:
        k = constant(key)
        if not isinstance(k, str):
            raise Unsupported("object key")
        fields[k] = scalar(value, scope)
    return Row(fields)


def _as(node, scope):
    _, source, patterns, _, body = node
    if len(patterns) != 1:
        raise Unsupported("alternative patterns")
    return scalar(body, bound(patterns[0], scalar(source, scope), scope))


def bound(pattern, v, scope: Scope) -> Scope:
    """The scope with the variables of a pattern."""
    if pattern[0] == "name":
        return scope.bind(**{pattern[1]: v})
    if pattern[0] == "also":
        return bound(pattern[2], v, scope.bind(**{pattern[1]: v}))
    if pattern[0] == "items":
        if not (isinstance(v, Value) and isinstance(v.type, T.ArrayType)):
            raise Unsupported("pattern")
        parts = [(("literal", float(i)), p) for i, p in enumerate(pattern[1])]
    else:
        if not (isinstance(v, Row) or isinstance(v.type, (T.StructType, T.MapType))):
            raise Unsupported("pattern")
        parts = pattern[1]
    for k, p in parts:
        scope = bound(p, _index((None, ("id",), k), Scope(v)), scope)
    return scope


def _join(node, scope):
    parts = []
    for p in node[1]:
        if p[0] == "literal":
            parts.append(F.lit(p[1]))
        else:
            parts.append(formatted(p[1] or "text", scalar(p[2], scope)))
    return Value(F.concat(*parts), STRING)


def _pipe(node, scope):
    if node[1][0] == "array" and node[2] == ("format", "csv"):
        items, todo = [], [node[1][1]]
        while todo:
            n = todo.pop()
            if n[0] == "comma":
                todo += [n[2], n[1]]
            else:
                items.append(scalar(n, scope))
        return Value(_csv(items), STRING)
    if node[1][0] == "array" and node[2] == ("format", "tsv"):
        return Value(_tsv([scalar(n, scope) for n in _commas(node[1][1])]), STRING)
    if node[1][0] == "call" and node[1][1] == "fromjson":  # fromjson | .a.b | tonumber
        return _json(node[2], scope)
    return scalar(node[2], scope.at(scalar(node[1], scope)))


def _commas(node) -> list:
    return [*_commas(node[1]), *_commas(node[2])] if node[0] == "comma" else [node]


def _json(node, scope):
    source = text(_dot(scope))
    if node[0] == "pipe" and node[2][0] == "call" and node[2][1] in ("tonumber", "tostring"):
        path, steps = node[1], []
        while path[0] == "index" and path[2][0] == "literal" and isinstance(path[2][1], str):
            steps.append(path[2][1])
            path = path[1]
        if path[0] == "id" and steps and all(s.isidentifier() for s in steps):
            found = F.get_json_object(source, "$." + ".".join(reversed(steps)))
            return Value(found.try_cast("double"), DOUBLE) if node[2][1] == "tonumber" else Value(F.coalesce(found, F.lit("null")), STRING)
    raise Unsupported("fromjson")


def _assign(node, scope):
    _, op, left, right = node
    row = _dot(scope)
    if not (isinstance(row, Row) and left[0] == "index" and left[1][0] == "id"):
        raise Unsupported("assignment")
    name = constant(left[2])
    old = row.fields.get(name) or Value(F.lit(None), T.NullType())
    if op == "=":
        new = scalar(right, scope)
    elif op == "|=":
        new = scalar(right, scope.at(old))
    elif op == "//=":
        new = _alt((None, left, right), scope)
    else:
        new = arithmetic(op[:-1], old, scalar(right, scope))
    return Row({**row.fields, name: new})


def _array_filter(f, scope, kind):
    """(condition, element) of a filter over an array's elements with 0 or 1 output."""

    def of(x):
        inner = scope.at(Value(x, kind))
        return pieces(f, inner)

    return of


EMPTY = ("call", "empty", ())


def pieces(node, scope):
    """(condition or None, output) of a filter made of selects and one-output filters."""
    if scope.bag is not None:
        return None, scalar(node, scope)
    if node[0] == "call" and node[1] == "select" and len(node[2]) == 1:
        return condition(scalar(node[2][0], scope)), _dot(scope)
    if node == EMPTY:
        return F.lit(False), Value(F.lit(None), T.NullType())
    if node[0] == "if" and EMPTY in (node[2], node[3]) and node[2] != node[3]:
        c = scalar(node[1], scope)
        here = condition(c) if node[3] == EMPTY else ~truthy(c)
        kept, out = pieces(node[2] if node[3] == EMPTY else node[3], scope)
        return here if kept is None else here & kept, out
    if node in (("call", "values", ()), ("call", "nulls", ())):
        v = _dot(scope)
        known = F.lit(True) if isinstance(v, Row) else v.col.isNotNull()
        return known if node[1] == "values" else ~known, v
    if node[0] == "as" and len(node[2]) == 1:
        kept, v = pieces(node[1], scope)
        more, out = pieces(node[4], bound(node[2][0], v, scope))
        return (more if kept is None else kept if more is None else kept & more), out
    if node[0] == "call" and node[1] == "capture" and len(node[2]) == 1:
        return _capture(node, scope)
    if node[0] == "try" and sure(node[1]):
        return pieces(node[1], scope)
    if node[0] == "pipe":
        if node[1][0] == "array" and node[2][0] == "format":
            return None, _pipe(node, scope)
        if node[1][0] == "call" and node[1][1] == "fromjson":
            return None, _pipe(node, scope)
        a, x = pieces(node[1], scope)
        b, y = pieces(node[2], Scope(x, scope.variables))
        return (b if a is None else a if b is None else a & b), y
    return None, scalar(node, scope)


#: Filters without errors of their own on typed columns, whatever their input's value.
SURE = {"id", "literal", "var", "index", "object", "and", "or", "alt", "if", "as", "pipe", "join", "text", "format"}


def sure(node) -> bool:
    """Whether a filter that compiles can't fail, so that a try around it changes nothing."""
    if not isinstance(node, tuple):
        return True
    if node and isinstance(node[0], str) and node[0] not in SURE:
        if node[0] == "call":
            return node[1] in ("not", "select", "tostring", "type", "tojson", "empty", "values", "nulls") and all(map(sure, node[2]))
        if node[0] == "binary":
            return node[1] in ("==", "!=", "<", "<=", ">", ">=") and sure(node[2]) and sure(node[3])
        return node[0] in ("name", "also", "items", "fields") or not isinstance(node[-1], tuple)
    return all(sure(x) for x in node if isinstance(x, tuple))


def _mapped(target, f, scope):
    if not (isinstance(target, Value) and isinstance(target.type, T.ArrayType)):
        raise Unsupported("map over this kind")
    kind, of = target.type.elementType, _array_filter(f, scope, target.type.elementType)
    probe, out = of(F.col("x"))
    kept = F.filter(target.col, lambda x: of(x)[0]) if probe is not None else target.col
    return Value(F.transform(kept, lambda x: struct(of(x)[1]).col), T.ArrayType(struct(out).type))


def _array(node, scope):
    inner = node[1]
    if inner[0] == "pipe" and inner[1][0] == "each":
        return _mapped(scalar(inner[1][1], scope), inner[2], scope)
    if inner[0] == "each":
        return scalar(inner[1], scope)
    if inner[0] == "call" and inner[1] in ("splits", "scan") and len(inner[2]) == 1 and isinstance(constant(inner[2][0]), str):
        pattern, x = constant(inner[2][0]), text(_dot(scope))
        if not re.search(r"\(|[*?|^$]|\\b", pattern):  # no groups, no matches of nothing
            pattern = java(pattern)
            return Value(F.split(x, pattern, -1) if inner[1] == "splits" else F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), T.ArrayType(STRING))
    items, todo = [], [inner]
    while todo:
        n = todo.pop()
        if n[0] == "comma":
            todo += [n[2], n[1]]
        else:
            items.append(struct(scalar(n, scope)))
    if all(is_num(x) for x in items):
        return Value(F.array(*(x.col.cast("double") for x in items)), T.ArrayType(DOUBLE))
    if all(x.type == items[0].type for x in items):
        return Value(F.array(*(x.col for x in items)), T.ArrayType(items[0].type))
    raise Unsupported("mixed array")


def _format(node, scope):
    v = _dot(scope)
    if node[1] in ("csv", "tsv"):
        raise Unsupported("row format of an array value")
    return Value(formatted(node[1], v), STRING)


def _csv(items) -> Column:
    cells = []
    for v in items:
        if is_str(v):
            cells.append(F.when(v.col.isNull(), F.lit("")).otherwise(F.concat(F.lit('"'), F.replace(v.col, F.lit('"'), F.lit('""')), F.lit('"'))))
        else:
            cells.append(_cell(v))
    return F.concat_ws(",", *cells)


def _cell(v) -> Column:
    if isinstance(v, Row) or isinstance(v.type, (T.ArrayType, T.MapType, T.StructType)):
        raise Unsupported("cell")
    return F.lit("") if is_null(v) else F.when(v.col.isNull(), F.lit("")).otherwise(tostring(v))


def _tsv(items) -> Column:
    cells = []
    for v in items:
        x = _cell(v)
        if is_str(v):
            for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
                x = F.replace(x, F.lit(a), F.lit(b))
        cells.append(x)
    return F.concat_ws("\t", *cells)


#: Parts of patterns that Java reads otherwise, or not at all.
FOREIGN = re.compile(r"\(\?P|\(\?>|\(\?[a-zA-Z^-]+[:)]|\[\[:|\\[pPQERKkhHXGzZA]|\\x\{|&&|--|~~|\|\||[+*?}]\+")


def java(pattern: str, flags: str = "") -> str:
    """A pattern as Java means it: classes over all characters, lines that end with a newline, '$' at the very end."""
    if FOREIGN.search(pattern) or set(flags) - set("gixs"):
        raise Unsupported("pattern")
    return "(?dUu" + "".join(c for c in flags if c in "ixs") + ")" + ended(pattern, "\\z")


def consuming(pattern: str) -> bool:
    """Whether every match has a character at least."""
    try:
        return not re.search(r"\(\?[=!<]|\\[bB]", re.sub(r"\(\?<(?![=!])", "(", pattern)) and not re.match(f"(?:{re.sub(r'[(][?]<(?![=!])', '(?P<', pattern)})", "")
    except re.error:
        return False


def _capture(node, scope):
    """capture(re) of its first match: an object of the named groups, if all of them take part in every match."""
    pattern, x = constant(node[2][0]), text(_dot(scope))
    if not isinstance(pattern, str):
        raise Unsupported("pattern")
    names = re.findall(r"\(\?<([A-Za-z]\w*)>", pattern)
    if not names or not _plain_groups(pattern):
        raise Unsupported("pattern")
    form = java(pattern)
    return F.rlike(x, F.lit(form)), Row({n: Value(F.regexp_extract(x, form, i + 1), STRING) for i, n in enumerate(names)})


def _plain_groups(pattern: str) -> bool:
    """Whether all groups are named and none is optional or in an alternative."""
    bare = re.sub(r"\\.|\[\^?\]?(?:\\.|[^\]])*\]", "x", pattern)
    return "|" not in bare and not re.search(r"\)[*?{]", bare) and len(re.findall(r"\((?!\?)", bare)) == 0 and not re.search(r"\(\?(?!<[A-Za-z])", bare)


def _call(node, scope):
    name, args = node[1], node[2]
    v = scope.dot
    if name in ("map",) and len(args) == 1 and v is not None:
        return _mapped(v, args[0], scope)
    if not args:
        if name == "not":
            return Value(~truthy(_dot(scope)), BOOLEAN)
        v = _dot(scope)
        if name == "length":
            if is_str(v):
                return Value(F.coalesce(F.length(v.col), F.lit(0)).cast("long"), LONG)
            if isinstance(v, Row):
                return Value(F.lit(len(v.fields)).cast("long"), LONG)
            if isinstance(v.type, T.ArrayType):
                return Value(F.when(v.col.isNull(), F.lit(0)).otherwise(F.size(v.col)).cast("long"), LONG)
            return Value(F.coalesce(F.abs(num(v)), F.lit(0.0)), DOUBLE)
        if name == "utf8bytelength":
            return Value(F.octet_length(text(v)).cast("long"), LONG)
        if name in ("ascii_downcase", "ascii_upcase"):
            pair = (UP, LOW) if name == "ascii_downcase" else (LOW, UP)
            return Value(F.translate(text(v), *pair), STRING)
        if name in MATH:
            return Value(MATH[name](num(v)).cast("double"), DOUBLE)
        if name in LOGS:
            f, edge = LOGS[name]
            x = num(v)
            return Value(F.when(x > edge, f(x)).when(x == edge, F.lit(float("-inf"))).when(x.isNotNull(), F.lit(float("nan"))), DOUBLE)
        if name == "tostring":
            return Value(tostring(v), STRING)
        if name == "tonumber" and is_num(v):
            return v
        if name in ("todate", "todateiso8601"):
            at = F.timestamp_seconds(F.floor(num(v)).cast("long"))
            return Value(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), STRING)
        if name == "gmtime":
            x = num(v)
            at = F.timestamp_seconds(F.floor(x).cast("long"))
            parts = (F.year(at), F.month(at) - 1, F.dayofmonth(at), F.hour(at), F.minute(at), F.second(at) + (x - F.floor(x)), F.dayofweek(at) - 1, F.dayofyear(at) - 1)
            return Value(F.array(*(p.cast("double") for p in parts)), T.ArrayType(DOUBLE))
        if name == "type" and not isinstance(v, Row):
            kind = "number" if is_num(v) or is_time(v) else "string" if is_str(v) else "boolean" if isinstance(v.type, T.BooleanType) else "array" if isinstance(v.type, T.ArrayType) else "object"
            return Value(F.when(v.col.isNull(), F.lit("null")).otherwise(F.lit(kind)), STRING)
        if name in ("first", "last"):
            return _index((None, ("id",), ("literal", 0.0 if name == "first" else -1.0)), scope)
        array = isinstance(v, Value) and isinstance(v.type, T.ArrayType)
        if name == "add" and array:
            kind = v.type.elementType
            if isinstance(kind, T.NumericType):
                total = F.aggregate(v.col, F.lit(None).cast("double"), lambda t, x: F.coalesce(t + x.cast("double"), t, x.cast("double")))
                return Value(total, DOUBLE)
            if isinstance(kind, T.StringType):
                return Value(F.when(F.size(v.col) > 0, F.array_join(v.col, "")), STRING)
        if name in ("reverse", "sort", "unique", "min", "max") and array:
            kind = v.type.elementType
            if name == "reverse":
                return Value(F.reverse(v.col), v.type)
            if isinstance(kind, (T.FloatType, T.DoubleType)):
                parts = {"null": lambda x: x.isNull(), "nan": lambda x: F.isnan(x), "rest": lambda x: x.isNotNull() & ~F.isnan(x)}
                found = {k: F.filter(v.col, f) for k, f in parts.items()}  # nulls, then NaN, which equals nothing, then the others
                once = F.array_distinct if name == "unique" else lambda x: x
                ordered = F.concat(once(found["null"]), found["nan"], F.sort_array(once(found["rest"])))
                return Value(ordered, v.type) if name in ("sort", "unique") else Value(F.try_element_at(ordered, F.lit(1 if name == "min" else -1)), kind)
            if isinstance(kind, (T.StringType, T.IntegralType)):
                ordered = F.sort_array(v.col if name in ("sort", "min", "max") else F.array_distinct(v.col))
                return Value(ordered, v.type) if name in ("sort", "unique") else Value(F.try_element_at(ordered, F.lit(1 if name == "min" else -1)), kind)
        if name in ("any", "all") and array:
            test = lambda x: truthy(Value(x, v.type.elementType))
            return Value(F.exists(v.col, test) if name == "any" else F.forall(v.col, test), BOOLEAN)
        if name == "explode" and is_str(v):
            return Value(F.transform(F.split(v.col, ""), lambda c: F.ascii(c).cast("double")), T.ArrayType(DOUBLE))
        raise Unsupported(name)
    if name in ("test", "gsub", "sub", "scan", "capture", "splits") and isinstance(constant(args[0]), str):
        pattern, x = constant(args[0]), text(_dot(scope))
        if name == "test":
            return Value(F.rlike(x, F.lit(java(pattern, (constant(args[1]) or "") if len(args) > 1 else ""))), BOOLEAN)
        if name in ("gsub", "sub") and len(args) == 2 and consuming(pattern):
            return Value(_replaced(x, pattern, args[1], name == "gsub"), STRING)
        raise Unsupported(name)
    if len(args) == 1:
        a = args[0]
        if name in ("startswith", "endswith"):
            x, y = text(_dot(scope)), text(scalar(a, scope))
            return Value(F.startswith(x, y) if name == "startswith" else F.endswith(x, y), BOOLEAN)
        if name in ("ltrimstr", "rtrimstr"):
            x, y = text(_dot(scope)), text(scalar(a, scope))
            cut = F.substring(x, F.length(y) + 1, F.length(x)) if name == "ltrimstr" else F.substring(x, F.lit(1), F.length(x) - F.length(y))
            return Value(F.when(F.startswith(x, y) if name == "ltrimstr" else F.endswith(x, y), cut).otherwise(x), STRING)
        if name == "trimstr":
            return scalar(("pipe", ("call", "ltrimstr", args), ("call", "rtrimstr", args)), scope)
        if name == "split":
            return split(_dot(scope), scalar(a, scope))
        if name == "join" and isinstance(_dot(scope).type, T.ArrayType) and isinstance(scope.dot.type.elementType, T.StringType):
            return Value(F.array_join(scope.dot.col, constant(a), ""), STRING)
        if name == "contains" and is_str(_dot(scope)):
            return Value(F.contains(scope.dot.col, text(scalar(a, scope))), BOOLEAN)
        if name in ("any", "all") and isinstance(_dot(scope), Value) and isinstance(scope.dot.type, T.ArrayType):
            test = lambda x: truthy(scalar(a, scope.at(Value(x, scope.dot.type.elementType))))
            return Value(F.exists(scope.dot.col, test) if name == "any" else F.forall(scope.dot.col, test), BOOLEAN)
        if name == "rindex" and is_str(_dot(scope)) and isinstance(constant(a), str) and constant(a):
            sought, x = constant(a), scope.dot.col
            back = F.instr(F.reverse(x), sought[::-1])
            return Value(F.when(back > 0, (F.length(x) - back - len(sought) + 1).cast("double")), DOUBLE)
        if name == "index" and is_str(_dot(scope)):
            at = F.instr(scope.dot.col, constant(a))
            return Value(F.when(at > 0, (at - 1).cast("double")), DOUBLE)
        if name == "has" and isinstance(_dot(scope), Row):
            return Value(F.lit(constant(a) in scope.dot.fields), BOOLEAN)
        if name == "del" and isinstance(_dot(scope), Row):
            gone = a
            if gone[0] == "index" and gone[1][0] == "id":
                return Row({k: x for k, x in scope.dot.fields.items() if k != constant(gone[2])})
        if name == "pick" and isinstance(_dot(scope), Row):
            todo, names = [a], []
            while todo:
                n = todo.pop()
                if n[0] == "comma":
                    todo += [n[2], n[1]]
                elif n[0] == "index" and n[1][0] == "id":
                    names.append(constant(n[2]))
                else:
                    raise Unsupported("pick")
            return Row({k: scope.dot.fields.get(k, Value(F.lit(None), T.NullType())) for k in names})
        if name == "strftime":
            forms = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD"}
            form = constant(a)
            for k, x in forms.items():
                form = form.replace(k, f"\0{x}\0")
            if "%" in form or any(c.isalpha() for c in "".join(form.split("\0")[::2])):
                raise Unsupported("strftime")
            return Value(F.date_format(F.timestamp_seconds(F.floor(num(_dot(scope))).cast("long")), form.replace("\0", "")), STRING)
    if name in PAIRS and len(args) == 2:
        return Value(PAIRS[name](num(scalar(args[0], scope)), num(scalar(args[1], scope))), DOUBLE)
    if name == "IN" and len(args) == 1:
        items = args[0]
        found, todo = F.lit(False), [items]
        while todo:
            n = todo.pop()
            if n[0] == "comma":
                todo += [n[2], n[1]]
            else:
                constant(n)
                found = found | compared("==", _dot(scope), scalar(n, scope)).col
        return Value(found, BOOLEAN)
    raise Unsupported(f"{name}/{len(args)}")


def _replaced(x: Column, pattern: str, by, every: bool) -> Column:
    """gsub or sub by a text, or by one with named groups in it."""
    quoted = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    parts = [by] if by[0] == "literal" else list(by[1]) if by[0] == "join" else []
    names = re.findall(r"\(\?<([A-Za-z]\w*)>", pattern)
    out = []
    for p in parts:
        if p[0] == "literal" and isinstance(p[1], str):
            out.append(quoted(p[1]))
        elif p[0] == "text" and p[1] is None and p[2][0] == "index" and p[2][1] == ("id",) and p[2][2][0] == "literal" and p[2][2][1] in names and _plain_groups(pattern):
            out.append(f"${names.index(p[2][2][1]) + 1}" if every else f"${names.index(p[2][2][1]) + 2}")
        else:
            raise Unsupported("replacement")
    if not parts:
        raise Unsupported("replacement")
    if every:
        return F.regexp_replace(x, F.lit(java(pattern)), F.lit("".join(out)))
    # the first match: all that stands before it is put back
    if re.search(r"\\[1-9]|\^", pattern):
        raise Unsupported("pattern")
    return F.regexp_replace(x, F.lit(f"(?s)\\A(.*?)(?-s){java(pattern)}"), F.lit("$1" + "".join(out)))


def _reduce(node, scope):
    """reduce .x[] as $v (0; f), the state a number."""
    _, source, pattern, start, update, _ = node
    if source[0] != "each" or pattern[0] != "name" or not isinstance(constant(start), float):
        raise Unsupported("reduce")
    v = scalar(source[1], scope)
    if not isinstance(v, Value) or not isinstance(v.type, T.ArrayType):
        raise Unsupported("reduce")

    def step(state, x):
        return num(scalar(update, Scope(Value(state, DOUBLE), {**scope.variables, pattern[1]: Value(x, v.type.elementType)}))).cast("double")

    return Value(F.aggregate(v.col, F.lit(constant(start)), step), DOUBLE)


def _binary(node, scope):
    a, b = scalar(node[2], scope), scalar(node[3], scope)
    return compared(node[1], a, b) if node[1] in ("==", "!=", "<", "<=", ">", ">=") else arithmetic(node[1], a, b)


def _logic(a, b, join) -> Value:
    return Value(join(truthy(a), truthy(b)), BOOLEAN, join(condition(a), condition(b)))


def _try(node, scope):
    if sure(node[1]):
        return scalar(node[1], scope)
    raise Unsupported("try")


RULES = {
    "id": lambda n, s: _dot(s), "literal": _literal, "var": _var, "index": _index, "slice": _slice, "pipe": _pipe, "binary": _binary, "alt": _alt, "if": _if, "object": _object,
    "negate": lambda n, s: Value(-num(scalar(n[1], s)), DOUBLE), "as": _as, "join": _join, "assign": _assign, "array": _array, "format": _format, "call": _call, "reduce": _reduce, "try": _try,
    "and": lambda n, s: _logic(scalar(n[1], s), scalar(n[2], s), lambda a, b: a & b), "or": lambda n, s: _logic(scalar(n[1], s), scalar(n[2], s), lambda a, b: a | b),
}
