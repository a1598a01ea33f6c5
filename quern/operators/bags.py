"""Filters over a whole table as DataFrame operators.

In slurp mode '.' is the array of all rows.  It is never gathered: it stays a DataFrame, and
the filters that take it apart are read as where, select, groupBy, orderBy, limit and join.
What rows are ordered by goes with them in hidden columns, whose names begin with two underscores.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.columns import BOOLEAN, DOUBLE, LONG, STRING, Pair, Row, Scope, Unsupported, Value, condition, constant, is_float, is_num, is_str, pieces, row_of, scalar, struct, tostring, truthy
from .ranges import binned

ORD = "__ord"
#: First rows that a task may hold.
FEW = 100_000


class Unnumbered(Exception):
    """The program needs the rows' order, so the scan must number them."""


@dataclass(frozen=True)
class Key:
    """A hidden column that rows are ordered by."""

    name: str
    down: bool = False

    def column(self) -> Column:
        return F.col(self.name).desc_nulls_last() if self.down else F.col(self.name).asc_nulls_first()


@dataclass
class Bag:
    """Rows; order: what they were sorted by last; placed: they lie in that order already; each row is one value if single."""

    df: DataFrame
    single: bool = False
    order: list = field(default_factory=list)
    placed: bool = True

    def shown(self) -> T.StructType:
        return T.StructType([f for f in self.df.schema if not f.name.startswith("__")])

    def hidden(self) -> list[str]:
        return [c for c in self.df.columns if c.startswith("__")]

    def row(self):
        schema = self.shown()
        return Value(F.col("value"), schema["value"].dataType) if self.single else row_of(schema)

    def with_order(self) -> Bag:
        """Rows numbered in the order of the scan."""
        if ORD not in self.df.columns:
            raise Unnumbered
        return self

    def place(self) -> Column:
        """A value that is less for earlier rows."""
        parts = []
        for k in self.order:
            if not k.down:
                parts.append(F.col(k.name))
            elif isinstance(self.df.schema[k.name].dataType, T.BooleanType):
                parts += [F.col(k.name).isNull(), ~F.col(k.name)]
            elif isinstance(self.df.schema[k.name].dataType, T.NumericType):
                x = F.col(k.name).cast("double")
                parts += [x.isNull(), ~F.isnan(x), -x]
            else:
                raise Unsupported("first rows of such an order")
        parts.append(F.col(ORD))
        return F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts))) if len(parts) > 1 else parts[0]

    def project(self, out, condition=None) -> Bag:
        df = self.df if condition is None else self.df.where(condition)
        kept = [F.col(c) for c in self.hidden()]
        if isinstance(out, Row):
            return replace(self, df=df.select(*(struct(v).col.alias(k) for k, v in out.fields.items()), *kept), single=False)
        if isinstance(out, Pair):
            raise Unsupported("pairs as values")
        return replace(self, df=df.select(out.col.alias("value"), *kept), single=True)

    def sorted(self, keys: list) -> Bag:
        """Ordered by filters; rows of equal keys keep their order."""
        b = self.with_order()
        at = len(b.hidden())
        added, order = {}, []
        for k in keys:
            down = k[0] == "negate"
            v = scalar(k[1] if down else k, Scope(b.row()))
            if isinstance(v, Row) or isinstance(v.type, (T.ArrayType, T.MapType, T.StructType)) or (down and not is_num(v)):
                raise Unsupported("sort key")
            if is_float(v) and not down:  # a NaN is less than every number
                added[f"__s{at}"] = F.when(v.col.isNotNull(), ~F.isnan(v.col))
                order.append(Key(f"__s{at}"))
                at += 1
            added[f"__s{at}"] = v.col
            order.append(Key(f"__s{at}", down))
            at += 1
        return replace(b, df=b.df.withColumns(added), order=[*order, *(b.order or [Key(ORD)])], placed=False)

    def reversed(self) -> Bag:
        b = self.with_order()
        return replace(b, order=[Key(k.name, not k.down) for k in b.order or [Key(ORD)]], placed=False)

    def ordered(self) -> DataFrame:
        return self.df if self.placed or not self.order else self.df.orderBy(*(k.column() for k in self.order))

    def head(self, n: int, skipped: int = 0) -> Bag:
        """The first rows, in order: a limit alone takes the rows that come first through a shuffle, so the scan's order is sorted by as well."""
        b = self if self.order else replace(self.with_order(), order=[Key(ORD)], placed=False)
        by, n = [k.column() for k in b.order], max(0, n)
        if n + skipped <= FEW:
            rows = b.df.orderBy(*by)
            rows = (rows.offset(skipped) if skipped else rows).limit(n)
        else:  # too many for the memory of a task: sorted on disk, and numbered as they come
            rows = b.df.withColumn("__n", F.row_number().over(Window.orderBy(*by))).where((F.col("__n") > skipped) & (F.col("__n") <= n + skipped))
        # the rows lie in one partition, in order, which from now on is the input's
        return Bag(rows.drop(*b.hidden(), "__n").withColumn(ORD, F.monotonically_increasing_id()), b.single)

    def at(self, n: int) -> Bag:
        """One row: that at a place, from the end if negative, or a row of nulls."""
        found = self.head(1, n) if n >= 0 else self.reversed().head(1, -1 - n)
        names = [f.name for f in self.shown()]
        one = found.df.agg(F.any_value(F.struct(*(F.col(f"`{c}`") for c in names))).alias("__row"))
        return Bag(one.select(*(F.col(f"__row.`{c}`").alias(c) for c in names)), self.single)

    def result(self) -> DataFrame:
        return self.ordered().drop(*self.hidden())


@dataclass
class Groups:
    bag: Bag
    keys: list


def source(df: DataFrame, numbered: bool = False) -> Bag:
    """A table's rows; numbered by file and place in it where they are read from files of that kind."""
    if not numbered or ORD in df.columns:
        return Bag(df)
    if "_metadata" in df._jdf.queryExecution().analyzed().metadataOutput().mkString(","):
        place = F.col("_metadata.row_index") if "row_index" in df.select("_metadata.*").columns else None
        if place is not None:
            files = len(df._jdf.inputFiles())
            return Bag(df.withColumn(ORD, place if files < 2 else F.struct("_metadata.file_path", "_metadata.row_index")))
    return Bag(df.withColumn(ORD, F.monotonically_increasing_id()))


def listed(node) -> list:
    """The filters of a comma, or of an array of them."""
    if node[0] == "array":
        return listed(node[1])
    return [*listed(node[1]), *listed(node[2])] if node[0] == "comma" else [node]


def flat(node) -> list:
    """The stages of a pipe."""
    return [*flat(node[1]), *flat(node[2])] if node[0] == "pipe" else [node]


def piped(stages: list):
    node = stages[-1]
    for s in reversed(stages[:-1]):
        node = ("pipe", s, node)
    return node


def is_call(node, name: str, arity: int) -> bool:
    return node[0] == "call" and node[1] == name and len(node[2]) == arity


EACH = ("each", ("id",))


def run_bag(node, df: DataFrame, tables: dict) -> DataFrame:
    """The outputs of a slurped program as rows; those of an array that it ends with are its elements."""
    try:
        return Program(tables).run(flat(node), source(df)).result()
    except Unnumbered:
        return Program(tables, True).run(flat(node), source(df, True)).result()


def count_of(node) -> float:
    n = constant(node)
    if isinstance(n, bool) or not isinstance(n, (int, float)) or n != n or abs(n) >= 2**31:
        raise Unsupported("not a count")
    return n


class Program:
    """Reads a program over a bag, stage by stage."""

    def __init__(self, tables: dict, numbered: bool = False) -> None:
        self.tables, self.numbered = tables, numbered

    def table(self, name: str) -> Bag:
        if name not in self.tables:
            raise Unsupported(f"${name}")
        return source(self.tables[name], self.numbered)

    def run(self, stages: list, bag: Bag) -> Bag:
        """The outputs of stages; '.' is the bag as an array."""
        state: Bag | Groups = bag
        for at, s in enumerate(stages):
            rest = stages[at:]
            if isinstance(state, Groups):
                if is_call(s, "map", 1):
                    state = aggregate(state, s[2][0])
                elif s == EACH and len(rest) > 1:
                    return in_groups(state, rest[1:])
                elif s == EACH or is_call(s, "length", 0):
                    state = aggregate(state, ("call", "length", ()))
                    return self.run(rest, state) if s != EACH else self.refuse("groups as values")
                else:
                    raise Unsupported("groups as values")
            elif s == ("id",):
                continue
            elif (found := self.apart(s, state)) is not None:
                return self.values(rest[1:], found)
            elif s[0] == "each":  # group_by(f)[] and the like
                return self.run([*flat(s[1]), EACH, *rest[1:]], state)
            elif s[0] == "index" and s[1] != ("id",) and s[1][0] != "index":  # sort_by(f)[0], first.a
                return self.run([*flat(s[1]), ("index", ("id",), s[2]), *rest[1:]], state)
            elif (n := place_of(s)) is not None:
                return self.values(rest[1:], state.at(n))
            elif s[0] == "index" and s[1][0] == "index" and (n := place_of(s[1])) is not None:
                return self.values([("index", ("id",), s[2]), *rest[1:]], state.at(n))
            elif s[0] == "as":
                return self.joined(s, rest[1:], state)
            elif (is_call(s, "min_by", 1) or is_call(s, "max_by", 1)):
                return self.values(rest[1:], state.sorted(listed(s[2][0])).at(0 if s[1] == "min_by" else -1))
            elif (after := self.array(s, state)) is not None:
                state = after
            else:
                return whole(piped(rest), state)
        if isinstance(state, Groups):
            raise Unsupported("groups as values")
        return state

    def refuse(self, why: str):
        raise Unsupported(why)

    def values(self, stages: list, bag: Bag) -> Bag:
        """The outputs of stages for every row; '.' is a row."""
        if not stages:
            return bag
        kept, out = pieces(piped(stages), Scope(bag.row()))
        return bag.project(out, kept)

    def apart(self, s, bag: Bag) -> Bag | None:
        """The outputs of a filter that takes the array apart: .[], .[].a, limit(n; .[] | f) and the like; None for others."""
        if s == EACH:
            return bag
        if s[0] == "index" and (path := below_each(s)) is not None:
            return bag.project(scalar(path, Scope(bag.row())))
        if s[0] == "pipe":
            stages = flat(s)
            first = self.apart(stages[0], bag)
            return None if first is None else self.values(stages[1:], first)
        if s[0] == "call" and s[1] in ("limit", "skip", "nth", "first", "last") and s[2]:
            if (s[1] in ("first", "last")) != (len(s[2]) == 1) or (inner := self.apart(s[2][-1], bag)) is None:
                return None
            n = count_of(s[2][0]) if len(s[2]) == 2 else 0
            if s[1] == "last":
                return inner.at(-1)
            if s[1] == "first":
                return inner.head(1)
            if s[1] == "limit":
                return inner if n < 0 else inner.head(math.ceil(n))
            if n < 0:
                raise Unsupported("negative count")
            return inner.head(2**31 - 1 - math.floor(n), math.floor(n)) if s[1] == "skip" else inner.head(1, math.floor(n))
        return None

    def array(self, s, bag: Bag) -> Bag | Groups | None:
        """An array made of the array, as a bag; None for a filter whose output is one value."""
        if s[0] == "array":
            return self.apart(s[1], bag)
        if is_call(s, "map", 1) and (member := membership(s[2][0])):
            return self.semi(bag, *member)
        if is_call(s, "map", 1):
            kept, out = pieces(s[2][0], Scope(bag.row()))
            return bag.project(out, kept)
        if is_call(s, "group_by", 1):
            return Groups(bag, listed(s[2][0]))
        if is_call(s, "sort_by", 1):
            return bag.sorted(listed(s[2][0]))
        if is_call(s, "sort", 0) and bag.single:
            return bag.sorted([("id",)])
        if is_call(s, "reverse", 0):
            return bag.reversed()
        if s[0] == "slice" and s[1] == ("id",):
            a = math.floor(count_of(s[2])) if s[2] else 0
            b = math.ceil(count_of(s[3])) if s[3] else None
            if a >= 0 and (b is None or b >= 0):
                return bag.head((2**31 - 1 if b is None else b) - a, a)
            if a < 0 and b is None:
                return replace(bag.reversed().head(-a), order=[Key(ORD, True)], placed=False)
            raise Unsupported("slice")
        if s[0] == "binary" and s[1] in "+-" and (sides := [self.side(x, bag) for x in s[2:4]]) and all(sides):
            return together(s[1], *sides)
        if is_call(s, "unique_by", 1):
            return firsts(bag, listed(s[2][0]))
        if is_call(s, "unique", 0) and bag.single:
            return distinct(bag)
        if is_call(s, "JOIN", 2):
            raise Unsupported("JOIN")
        return None

    def side(self, node, bag: Bag) -> Bag | None:
        """The bag of map(f) or $table | map(f), perhaps made unique; None for other filters."""
        stages = flat(node)
        if stages[0][0] == "var" and stages[0][1] in self.tables:
            bag, stages = self.table(stages[0][1]), stages[1:]
        if not stages or not is_call(stages[0], "map", 1) or not all(is_call(s, "map", 1) or is_call(s, "unique", 0) for s in stages):
            return None
        found = self.run(stages, bag)
        return found if found.single else None

    # joins

    def semi(self, bag: Bag, key, table: str, f, wanted: bool) -> Bag:
        """A left semi join, or a left anti join; null equals null, a NaN equals nothing."""
        other = self.table(table)
        kept, v = pieces(f, Scope(other.row()))
        v = struct(v)
        rows = other.df if kept is None else other.df.where(kept)
        rows = rows.select(v.col.alias("__in"))
        mine = struct(scalar(key, Scope(bag.row())))
        if is_float(v) or is_float(mine):
            rows = rows.where(F.col("__in").isNull() | ~F.isnan(F.col("__in").cast("double")))
        elif type(v.type) is not type(mine.type) and not (is_num(v) and is_num(mine)):
            raise Unsupported("membership of another kind")
        met = bag.df.join(rows, mine.col.eqNullSafe(F.col("__in")), "left_semi" if wanted else "left_anti")
        return replace(bag, df=met, placed=not bag.order)

    def indexed(self, node, bag: Bag):
        """(table, key filter) of INDEX($t[]; key), $t | INDEX(key), INDEX(.[]; key) or INDEX(key)."""
        stages = flat(node)
        if is_call(stages[-1], "INDEX", 1) and len(stages) <= 2:
            head = stages[0] if len(stages) == 2 else ("id",)
            key = stages[-1][2][0]
        elif is_call(node, "INDEX", 2) and node[2][0][0] == "each":
            head, key = node[2][0][1], node[2][1]
        else:
            return None
        if head[0] == "var":
            return self.table(head[1]), key
        return (bag, key) if head == ("id",) else None

    def joined(self, node, rest: list, bag: Bag) -> Bag:
        """INDEX($t[]; key) as $i | JOIN($i; …), or .[] as $x | $t[] as $y | select($x.a == $y.b) | out."""
        _, origin, patterns, _, body = node
        if len(patterns) != 1 or patterns[0][0] != "name":
            raise Unsupported("pattern")
        name = patterns[0][1]
        if (index := self.indexed(origin, bag)) is not None:
            stages = [*flat(body), *rest]
            first = stages[0][1] if stages[0][0] == "array" else stages[0]
            if first[0] != "call" or first[1] != "JOIN" or first[2][0] != ("var", name):
                raise Unsupported("JOIN")
            args = first[2]
            if len(args) > 2 and args[1] != EACH:
                raise Unsupported("JOIN of another stream")
            met, pair = self.matched(bag, *index, args[1 if len(args) == 2 else 2])
            array = len(args) == 2 or stages[0][0] == "array"
            if len(args) == 4:
                kept, out = pieces(args[3], Scope(pair))
                met = met.project(out, kept)
                return (self.run if array else self.values)(stages[1:], met) if len(stages) > 1 else met
            if len(stages) < 2:
                raise Unsupported("pairs as values")
            if not array:  # a stream of pairs
                kept, out = pieces(piped(stages[1:]), Scope(pair))
                return met.project(out, kept)
            if not is_call(stages[1], "map", 1):
                raise Unsupported("pairs as values")
            kept, out = pieces(stages[1][2][0], Scope(pair))
            return self.run(stages[2:], met.project(out, kept))
        if origin == EACH and body[0] == "as" and body[1][0] == "each" and body[1][1][0] == "var" and len(body[2]) == 1 and body[2][0][0] == "name":
            right = self.table(body[1][1][1]).df
            r = right.select(*(F.col(f"`{c}`").alias(f"__r_{c}") for c in right.columns))
            mine, other = bag.row(), Row({f.name: Value(F.col(f"`__r_{f.name}`"), f.dataType) for f in right.schema if not f.name.startswith("__")})
            stages = [*flat(body[4]), *rest]
            if not is_call(stages[0], "select", 1) or len(stages) < 2:
                raise Unsupported("join")
            scope = Scope(None, {name: mine, body[2][0][1]: other})
            on = stages[0][2][0]
            met = binned(bag.df, r, on, scope, name, body[2][0][1])
            if met is None:
                met = bag.df.join(r, condition(scalar(on, scope)))
            kept, out = pieces(piped(stages[1:]), scope)
            return Bag(met).project(out, kept)
        raise Unsupported("as")

    def matched(self, bag: Bag, right: Bag, key, probe) -> tuple[Bag, Pair]:
        """Every row with the last row of the index whose key it has, or null."""
        if not (probe[0] == "pipe" and probe[2] == ("call", "tostring", ())):
            raise Unsupported("the probe's key must be text")
        r = right.with_order()
        build = scalar(key, Scope(r.row()))
        schema = right.shown()
        index = r.df.groupBy(build.col.alias("__key")).agg(F.max_by(F.struct(*(F.col(f"`{f.name}`") for f in schema)), F.col(ORD)).alias("__right"))
        probed = scalar(probe[1], Scope(bag.row()))
        if type(probed.type) is not type(build.type) or not isinstance(probed.type, (T.IntegralType, T.StringType)):
            raise Unsupported("join key")
        met = replace(bag, df=bag.df.join(index, probed.col.eqNullSafe(F.col("__key")), "left").drop("__key"), placed=not bag.order)
        return met, Pair(bag.row(), Row({f.name: Value(F.col("__right").getField(f.name), f.dataType) for f in schema}))


def place_of(s) -> int | None:
    """The place of .[n], first, last or nth(n)."""
    if is_call(s, "first", 0) or is_call(s, "last", 0):
        return 0 if s[1] == "first" else -1
    if is_call(s, "nth", 1):
        s = ("index", ("id",), s[2][0])
    if s[0] == "index" and s[1] == ("id",) and s[2][0] in ("literal", "negate"):
        k = constant(s[2])
        if isinstance(k, (int, float)) and not isinstance(k, bool):
            return int(count_of(s[2]))
    return None


def below_each(node):
    """.[].a.b as .a.b; None for other paths."""
    if node == EACH:
        return ("id",)
    if node[0] != "index" or (inner := below_each(node[1])) is None:
        return None
    return ("index", inner, node[2])


def distinct(bag: Bag) -> Bag:
    """The different values in their order; a NaN equals no other, so every one stays."""
    df = bag.df.select("value")
    if is_float(bag.row()):
        df = df.withColumn("__nan", F.when(F.isnan("value"), F.monotonically_increasing_id())).distinct().drop("__nan")
        df = df.select("value", F.when(F.col("value").isNotNull(), ~F.isnan("value")).alias("__s0"), F.col("value").alias("__s1"))
        return Bag(df.withColumn(ORD, F.lit(0)), True, [Key("__s0"), Key("__s1")], False)
    if isinstance(bag.row().type, (T.ArrayType, T.MapType, T.StructType)):
        raise Unsupported("distinct values of this kind")
    return Bag(df.distinct().select("value", F.col("value").alias("__s0"), F.lit(0).alias(ORD)), True, [Key("__s0")], False)


def together(op: str, a: Bag, b: Bag) -> Bag:
    """a + b: the rows of both; a - b: the rows of a that equal none of b, NaN and nulls by the language's rules."""
    kinds = [x.df.schema["value"].dataType for x in (a, b)]
    left, right = (x.df.select("value") if op == "+" else x.df for x in (a, b))
    if all(isinstance(k, T.NumericType) for k in kinds):
        kind = kinds[0] if kinds[0] == kinds[1] else DOUBLE
        left, right = (x.withColumn("value", F.col("value").cast(kind)) for x in (left, right))
    elif kinds[0] != kinds[1] or not isinstance(kinds[0], (T.StringType, T.BooleanType)):
        raise Unsupported("arrays of these kinds")
    if op == "+":
        return Bag(left.unionAll(right), True)
    right = right.select("value")
    same = F.col("l.value").eqNullSafe(F.col("r.value"))
    if isinstance(left.schema["value"].dataType, T.FractionalType):
        right = right.where(F.col("value").isNull() | ~F.isnan("value"))
    return replace(a, df=left.alias("l").join(right.distinct().alias("r"), same, "left_anti"), placed=not a.order)


def grouping(bag: Bag, keys: list) -> tuple[dict, list, list]:
    """(plain keys by field, grouping columns, their order): the groups' keys as hidden columns."""
    row = bag.row()
    found, by, order = {}, [], []
    for i, k in enumerate(keys):
        v = struct(scalar(k, Scope(row)))
        if isinstance(v.type, (T.ArrayType, T.MapType, T.StructType)):
            raise Unsupported("group key")
        if k[0] == "index" and k[1] == ("id",):
            found[constant(k[2])] = v
        if is_float(v):
            by.append(F.when(v.col.isNotNull(), ~F.isnan(v.col)).alias(f"__s{2 * i}"))
            order.append(Key(f"__s{2 * i}"))
        by.append(v.col.alias(f"__s{2 * i + 1}"))
        order.append(Key(f"__s{2 * i + 1}"))
    return found, by, order


def firsts(bag: Bag, keys: list) -> Bag:
    """The first row of each key, in the keys' order; partially aggregated."""
    b = bag.with_order()
    names = [f.name for f in b.shown()]
    _, by, order = grouping(bag, keys)
    best = b.df.groupBy(*by).agg(F.min_by(F.struct(*(F.col(f"`{n}`") for n in names), ORD), b.place()).alias("__row"))
    return Bag(best.select(*(F.col(f"__row.`{n}`").alias(n) for n in [*names, ORD]), *(k.name for k in order)), bag.single, order, False)


class Aggregates:
    """Reads a filter over an array of rows as aggregate columns."""

    def __init__(self, bag: Bag, keys: dict) -> None:
        self.bag, self.keys, self.needs_order = bag, keys, False

    def place(self) -> Column:
        self.needs_order = True
        self.bag.with_order()
        return self.bag.place()

    def __call__(self, node, scope: Scope):
        row = Scope(self.bag.row(), scope.variables)
        stages = flat(node)
        first = stages[0]
        if is_call(node, "length", 0):
            return Value(F.count(F.lit(1)), LONG)
        if node[0] == "index" and node[1] == ("index", ("id",), ("literal", 0.0)) and node[2][0] == "literal" and node[2][1] in self.keys:
            return self.keys[node[2][1]]
        if node[0] == "index" and node[1] != ("id",) and node[2][0] == "literal" and isinstance(node[2][1], str) and (found := self.row_at(node[1], ("index", ("id",), node[2]), row)) is not None:
            return found
        if len(stages) > 1 and (found := self.row_at(first, piped(stages[1:]), row)) is not None:
            return found
        if (found := self.row_at(node, ("id",), row)) is not None:
            return found
        if node[0] == "call" and node[1] in ("any", "all") and len(node[2]) == 2 and node[2][0] == EACH:
            node = ("call", node[1], node[2][1:])
        if node[0] == "call" and node[1] in ("any", "all") and len(node[2]) == 1:
            c = truthy(scalar(node[2][0], row))
            return Value(F.coalesce(F.bool_or(c), F.lit(False)) if node[1] == "any" else F.coalesce(F.bool_and(c), F.lit(True)), BOOLEAN)
        if is_call(node, "isempty", 1):
            inner = flat(node[2][0])
            if inner[0] == EACH:
                kept = pieces(piped(inner[1:]), row)[0] if len(inner) > 1 else None
                return Value((F.count(F.lit(1)) if kept is None else F.count_if(kept)) == 0, BOOLEAN)
        if is_call(node, "add", 1):
            inner = flat(node[2][0])
            path = below_each(inner[0])
            if path is not None:
                return self.folded([("call", "map", (piped([path, *inner[1:]]),)), ("call", "add", ())], row)
        if node[0] == "array" and (path := below_each(flat(node[1])[0])) is not None:
            return self.folded([("call", "map", (piped([path, *flat(node[1])[1:]]),))], row)
        if first[0] == "array" and (path := below_each(flat(first[1])[0])) is not None:
            first = ("call", "map", (piped([path, *flat(first[1])[1:]]),))
            stages = [first, *stages[1:]]
        if not is_call(first, "map", 1) and first[0] == "call" and first[1] in FOLDS:
            stages = [("call", "map", (("id",),)), *stages]
            first = stages[0]
        if is_call(first, "map", 1):
            many = 1
            while many < len(stages) and stages[many][0] == "call" and stages[many][1] in FOLDS:
                many += 1
                if stages[many - 1][1] not in ("unique", "sort"):
                    break
            found = self.folded(stages[:many], row)
            return scalar(piped(stages[many:]), Scope(found)) if len(stages) > many else found
        if node[0] in ("id", "each"):
            raise Unsupported("rows as a value")
        return None

    def row_at(self, s, f, row: Scope):
        """f of one row: that of the least or greatest key, or at the first or last place; None for other filters."""
        if s[0] == "call" and s[1] in ("min_by", "max_by") and len(s[2]) == 1:
            ranks = [r for k in listed(s[2][0]) for r in ranked(scalar(k, row))]
            by, last = F.struct(*(r.alias(f"k{i}") for i, r in enumerate(ranks)), self.place().alias("at")), s[1] == "max_by"
        else:
            n = place_of(s)
            if n not in (0, -1):
                return None
            by, last = self.place(), n == -1
        v = struct(scalar(f, row))
        return Value((F.max_by if last else F.min_by)(v.col, by), v.type)

    def folded(self, stages: list, row: Scope):
        kept, v = pieces(stages[0][2][0], row)
        if kept is not None:
            kept = F.coalesce(kept, F.lit(False))
        rest = [s[1] for s in stages[1:]]
        if any(s[2] for s in stages[1:]) and rest != ["join"]:
            raise Unsupported("fold")
        while len(rest) > 1 and rest[0] == "sort" and rest[1] in ("sort", "unique", "length", "min", "max", "any", "all"):
            rest = rest[1:]
        if rest == ["length"]:
            return Value(F.count(F.lit(1)) if kept is None else F.count_if(kept), LONG)
        v = struct(v)
        col = v.col if kept is None else F.when(kept, v.col)
        here = F.lit(True) if kept is None else kept
        if rest == ["add"] and is_num(v):
            return Value(F.sum(col.cast("double")), DOUBLE)
        if rest == ["max"] and not isinstance(v.type, (T.MapType, T.StructType, T.ArrayType)):
            return Value(F.coalesce(F.max(F.when(~F.isnan(col), col)), F.max(col)) if is_float(v) else F.max(col), v.type)
        if rest == ["min"] and not isinstance(v.type, (T.MapType, T.StructType, T.ArrayType)):  # null is the least value, then NaN
            nulls = F.coalesce(F.bool_or(here & v.col.isNull()), F.lit(False))
            least = F.min(col)
            if is_float(v):
                least = F.when(F.coalesce(F.bool_or(here & F.isnan(v.col)), F.lit(False)), F.lit(float("nan")).cast(v.type)).otherwise(least)
            return Value(F.when(nulls, None).otherwise(least), v.type)
        if rest == ["unique", "length"]:
            nulls = F.max(F.when(here & v.col.isNull(), 1).otherwise(0))
            count = F.count_distinct(col)
            if is_float(v):  # every NaN counts
                count = F.count_distinct(F.when(~F.isnan(col), col)) + F.count_if(here & F.isnan(v.col))
            return Value((count + F.coalesce(nulls, F.lit(0))).cast("long"), LONG)
        if rest in (["any"], ["all"]):
            c = truthy(v)
            c = c if kept is None else F.when(kept, c)
            return Value(F.coalesce(F.bool_or(c), F.lit(False)) if rest == ["any"] else F.coalesce(F.bool_and(c), F.lit(True)), BOOLEAN)
        # the values themselves, in order, as one array
        at = F.struct(self.place().alias("at"), v.col.alias("v"))
        found = Value(F.transform(F.array_sort(F.collect_list(at if kept is None else F.when(kept, at))), lambda x: x["v"]), T.ArrayType(v.type))
        if rest == ["join"]:
            by = constant(stages[1][2][0])
            if not isinstance(by, str):
                raise Unsupported("join")
            return Value(F.array_join(F.transform(found.col, lambda x: F.when(x.isNull(), F.lit("")).otherwise(tostring(Value(x, v.type)))), by), STRING)
        if rest == ["add"] and is_str(v):
            return Value(F.when(F.exists(found.col, lambda x: x.isNotNull()), F.array_join(found.col, "")), STRING)
        return scalar(piped(stages[1:]), Scope(found)) if rest else found


#: Functions without arguments, and join, that take an array of rows' values to one value.
FOLDS = {"add", "min", "max", "any", "all", "unique", "sort", "length", "join", "reverse"}


def ranked(v) -> list[Column]:
    """Columns whose order is that of the language: null, then NaN, then values."""
    v = struct(v)
    if isinstance(v.type, (T.ArrayType, T.MapType, T.StructType)):
        raise Unsupported("key of this kind")
    return [F.when(v.col.isNotNull(), ~F.isnan(v.col)), v.col] if is_float(v) else [v.col]


def expanded(out, cols: list) -> tuple[list, bool]:
    """Aggregate columns of an output, and whether it is one value."""
    if isinstance(out, Row):
        return [struct(v).col.alias(k) for k, v in out.fields.items()], False
    return [out.col.alias("value")], True


def as_rows(df: DataFrame, kind: T.DataType, hidden: list) -> tuple[DataFrame, bool]:
    """A struct output's fields as columns."""
    if isinstance(kind, T.StructType):
        return df.select(*(F.col(f"value.`{f.name}`").alias(f.name) for f in kind), *hidden), False
    return df, True


def aggregate(groups: Groups, f) -> Bag:
    """group_by(keys) | map(f): partial and final hash aggregation; groups are never gathered. Selects in front of f choose groups."""
    keys, by, order = grouping(groups.bag, groups.keys)
    reader = Aggregates(groups.bag, keys)
    scope = Scope(None, bag=reader)
    stages, having = flat(f), []
    while len(stages) > 1 and is_call(stages[0], "select", 1):
        having.append(condition(scalar(stages[0][2][0], scope)))
        stages = stages[1:]
    out = scalar(piped(stages), scope)
    cols, single = expanded(out, by)
    hidden = [k.name for k in order]
    df = groups.bag.df.groupBy(*by).agg(*cols, *(h.alias(f"__h{i}") for i, h in enumerate(having)), F.lit(0).alias(ORD))
    for i in range(len(having)):
        df = df.where(F.col(f"__h{i}"))
    df = df.drop(*(f"__h{i}" for i in range(len(having))))
    if single:
        df, single = as_rows(df, out.type, [*hidden, ORD])
    return Bag(df, single, order, False)


def whole(node, bag: Bag) -> Bag:
    """A filter over all rows with one output: a global aggregate, or a sum for each key of a reduced object."""
    if node[0] == "reduce":
        return reduced(node, bag)
    reader = Aggregates(bag, {})
    out = scalar(node, Scope(None, bag=reader))
    cols, single = expanded(out, [])
    return Bag(bag.df.agg(*cols), single)


def reduced(node, bag: Bag) -> Bag:
    """reduce .[] as $o ({}; .[$o.k] += $o.v): one row for each key of the object; reduce .[] as $o (n; . + f): one sum."""
    _, origin, pattern, start, update, _ = node
    if origin != EACH or pattern[0] != "name":
        raise Unsupported("reduce")
    scope = Scope(None, {pattern[1]: bag.row()})
    if start == ("object", ()) and update[0] == "assign" and update[1] == "+=" and update[2][0] == "index" and update[2][1] == ("id",):
        key, v = scalar(update[2][2], scope), scalar(update[3], scope)
        if is_str(key) and is_num(v):
            return Bag(bag.df.groupBy(key.col.alias("key")).agg(F.sum(v.col.cast("double")).alias("value")))
    if update[0] == "binary" and update[1] == "+" and update[2] == ("id",) and isinstance(constant(start), float):
        v = scalar(update[3], scope)
        if is_num(v):
            return Bag(bag.df.agg((F.lit(constant(start)) + F.coalesce(F.sum(v.col.cast("double")), F.lit(0.0))).alias("value")), True)
    raise Unsupported("reduce")


def in_groups(groups: Groups, stages: list) -> Bag:
    """group_by(k)[] | foreach .[] as $e (0; . + f; out): a running window; or | sort_by(f) | .[:n]: the first rows of each group."""
    row = groups.bag.row()
    bag = groups.bag.with_order()
    _, by, order = grouping(groups.bag, groups.keys)
    named = replace(bag, df=bag.df.withColumns({k.name.replace("__s", "__g"): c for k, c in zip(order, by, strict=True)}))
    order = [Key(k.name.replace("__s", "__g")) for k in order]
    s = stages[0]
    if len(stages) == 1 and s[0] == "foreach" and s[1] == EACH and s[2][0] == "name" and s[4][0] == "binary" and s[4][1] == "+" and s[4][2] == ("id",) and s[5] is not None:
        v = scalar(s[4][3], Scope(None, {s[2][1]: row}))
        w = Window.partitionBy(*(k.name for k in order)).orderBy(bag.place()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        running = Value(F.lit(float(constant(s[3]))) + F.coalesce(F.sum(v.col.cast("double")).over(w), F.lit(0.0)), DOUBLE)
        found = named.project(scalar(s[5], Scope(running, {s[2][1]: row})))
        return replace(found, order=[*order, *(bag.order or [Key(ORD)])], placed=False)
    if len(stages) >= 2 and is_call(s, "sort_by", 1) and stages[1][0] == "slice" and stages[1][1] == ("id",) and stages[1][2] is None:
        b = named.sorted(listed(s[2][0]))
        w = Window.partitionBy(*(k.name for k in order)).orderBy(*(k.column() for k in b.order))
        n = count_of(stages[1][3])
        if n < 0:
            raise Unsupported("slice")
        kept = b.df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= math.ceil(n)).drop("__n")
        out = Bag(kept, bag.single, [*order, *b.order], False)
        rest = stages[2:]
        if not rest:
            raise Unsupported("groups as values")
        if rest[0] == EACH:
            rest = rest[1:]
        elif is_call(rest[0], "map", 1) and len(rest) == 2 and rest[1] == EACH:
            rest = flat(rest[0][2][0])
        else:
            raise Unsupported("groups as values")
        if rest:
            kept, v = pieces(piped(rest), Scope(out.row()))
            out = out.project(v, kept)
        return out
    raise Unsupported("filters inside groups")


def membership(f):
    """(key, table, filter of its rows, wanted) of select(IN(key; $table[] | filter)), negated or not."""
    if not is_call(f, "select", 1):
        return None
    c, wanted = f[2][0], True
    if c[0] == "pipe" and c[2] == ("call", "not", ()):
        c, wanted = c[1], False
    if is_call(c, "IN", 2):
        stages = flat(c[2][1])
        steps = []
        head = stages[0]
        while head[0] == "index":
            steps.append(head[2])
            head = head[1]
        if head[0] == "each" and head[1][0] == "var":
            path = ("id",)
            for s in reversed(steps):
                path = ("index", path, s)
            return c[2][0], head[1][1], piped([path, *stages[1:]]), wanted
    return None
