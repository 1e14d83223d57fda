"""Trees to columns: fields are resolved against a schema, functions looked up in the library."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import model
from ..natural import chr_clip, nat_key
from . import library as lib
from .parser import ExpressionError, Node, fields, parse
from .values import Value, checked, constant, equal, is_number, items, number, of_type, same_length, text, truth

_SAMPLE = {"count", "list", "distinct", "ucount", "min", "max", "sum", "avg", "stdev", "median", "mode", "percent"}


class Compiler:
    """columns: name -> Value. Names that aren't columns are looked up in extra (calculated fields, ROW)."""

    def __init__(self, schema: StructType, extra: Mapping[str, Value] | None = None, suffix: str | None = None, whole: list[str] | None = None):
        self.schema, self.extra, self.suffix = schema, dict(extra or {}), suffix
        self.names = [f.name for f in schema.fields]
        self.whole = whole or self.names

    # fields

    def has(self, name: str) -> bool:
        return name in self.extra or name in self.names or (self.suffix is not None and f"{name}-{self.suffix}" in self.names)

    def field(self, name: str) -> Value:
        if self.suffix is not None and f"{name}-{self.suffix}" in self.names:
            name = f"{name}-{self.suffix}"
        if name in self.extra:
            return self.extra[name]
        if name in self.names:
            return of_type(model.col(name), self.schema[name].dataType)
        raise ExpressionError(f"no field {name}; there are {', '.join(self.names)}")

    def wild(self, node: Node) -> list[Value]:
        """The values of an argument; a field with wildcards is all fields it matches."""
        if node.kind == "field" and "*" in node.value:
            return [self.field(c) for c in model.matching(self.names, node.value)]
        return [self(node)]

    def under(self, suffix: str, special: dict[str, str]) -> Compiler:
        return Compiler(self.schema, self.extra | {k: constant(v) for k, v in special.items()}, suffix)

    # nodes

    def __call__(self, n: Node) -> Value:
        return getattr(self, "_" + n.kind)(n)

    def _number(self, n: Node) -> Value:
        return constant(n.value)

    _text = _list = _number

    def _field(self, n: Node) -> Value:
        return self.field(n.value)

    def _test(self, n: Node) -> Value:
        if n.args:
            raise ExpressionError(f"the comparison {n.value} lacks its left side")
        return constant(n.value)

    def _choice(self, n: Node) -> Value:
        return lib.choose([(self(n.args[0]), self(n.args[1]))], self(n.args[2]))

    def _unary(self, n: Node) -> Value:
        v = self(n.args[0])
        if n.value == "-":
            return Value(-number(v), "num", -v.literal if isinstance(v.literal, (int, float)) else None)
        if n.value == "+":
            return Value(number(v), "num")
        return Value(~truth(v), "bool") if n.value == "!" else Value(F.bitwise_not(number(v).cast("long")), "num")

    def _binary(self, n: Node) -> Value:
        return self.operate(n.value, self(n.args[0]), self(n.args[1]))

    def operate(self, op: str, a: Value, b: Value) -> Value:
        if op in ("==", "="):
            return Value(equal(a, b), "bool")
        if op == "!=":
            return Value(~equal(a, b), "bool")
        if op in ("<", ">", "<=", ">="):
            x, y = checked(a, op), checked(b, op)
            return Value({"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op], "bool")
        if op in ("eq", "ne"):
            return Value(text(a) == text(b) if op == "eq" else text(a) != text(b), "bool")
        if op in ("lt", "gt", "le", "ge"):
            x, y = nat_key(text(a)), nat_key(text(b))
            return Value({"lt": x < y, "gt": x > y, "le": x <= y, "ge": x >= y}[op], "bool")
        if op in ("&&", "||"):
            return Value(truth(a) & truth(b) if op == "&&" else truth(a) | truth(b), "bool")
        if op in ("in", "ni"):
            found = text(a).isin(list(b.literal)) if isinstance(b.literal, tuple) else F.array_contains(items(b), text(a))
            return Value(found if op == "in" else ~found, "bool")
        if op == "~":
            return lib.FUNCTIONS["regexp"]([a, b])
        if op in lib.ARITHMETIC:
            return Value(lib.ARITHMETIC[op](number(a), number(b)), "num")
        if op in ("&", "|", "^", "<<", ">>"):
            x, y = number(a).cast("long"), number(b).cast("long")
            if op in ("<<", ">>"):
                if not isinstance(b.literal, int):
                    raise ExpressionError("a shift has to be by a constant")
                return Value(F.shiftleft(x, b.literal) if op == "<<" else F.shiftright(x, b.literal), "num")
            return Value({"&": x.bitwiseAND(y), "|": x.bitwiseOR(y), "^": x.bitwiseXOR(y)}[op], "num")
        if op in lib.VECTOR:
            return lib.vector_operator(op, a, b)
        if op in ("vin", "vni"):
            got = F.transform(items(a), lambda x: F.array_contains(items(b), x).cast("int").cast("string"))
            return Value(got if op == "vin" else F.transform(got, lambda x: (F.lit(1) - x.cast("int")).cast("string")), "list")
        if op in lib.FUNCTIONS:
            return lib.FUNCTIONS[op]([a, b])
        raise ExpressionError(f"no operator {op}")

    def _call(self, n: Node) -> Value:
        special = getattr(self, "call_" + n.value, None)
        if special:
            return special(n.args)
        if n.value[:1] in "sa" and n.value[1:] in _SAMPLE:
            return self.over_samples(n.value[1:], n.args, n.value[0] == "s")
        args = [v for a in n.args for v in self.wild(a)]
        if n.value in lib.FUNCTIONS:
            return lib.FUNCTIONS[n.value](args)
        if n.value[:1] == "v" and n.value[1:] in lib.FUNCTIONS:
            return lib.lift(lib.FUNCTIONS[n.value[1:]], args)
        raise ExpressionError(f"no function {n.value}")

    # functions that look at their arguments as written

    def test(self, node: Node) -> Callable[[Value], Column]:
        if node.kind != "test" or not node.args:
            raise ExpressionError('a test like == "x" is expected')
        right = self(node.args[0])
        return lambda v: F.coalesce(truth(self.operate(node.value, v, right)), F.lit(False))

    def _counted(self, args: tuple[Node, ...], how: Callable[[Callable, Value], Column]) -> Value:
        test = self.test(args[-1])
        got = [how(test, v).cast("int") for a in args[:-1] for v in self.wild(a)]
        return Value(sum(got, F.lit(0)), "num")

    def call_count(self, args: tuple[Node, ...]) -> Value:
        return self._counted(args, lambda test, v: test(v))

    def call_counthasone(self, args: tuple[Node, ...]) -> Value:
        return self._counted(args, lambda test, v: F.exists(items(v), lambda x: test(Value(x, "text"))))

    def call_counthasall(self, args: tuple[Node, ...]) -> Value:
        return self._counted(args, lambda test, v: F.forall(items(v), lambda x: test(Value(x, "text"))))

    def _has(self, args: tuple[Node, ...], how) -> Value:
        v = self(args[0])
        if len(args) == 2:
            test = self.test(args[1])
        else:
            op, right = str(self(args[1]).literal), self(args[2])
            test = lambda x: F.coalesce(truth(self.operate(op, x, right)), F.lit(False))
        # an element that is no number meets no comparison of numbers
        return Value(how(items(v), lambda x: test(Value(F.when(is_number(x), x.cast("double")), "num") if str(args[1].value) in ("<", ">", "<=", ">=") else Value(x, "text"))), "bool")

    def call_hasone(self, args: tuple[Node, ...]) -> Value:
        return self._has(args, F.exists)

    def call_hasall(self, args: tuple[Node, ...]) -> Value:
        return self._has(args, F.forall)

    def call_if(self, args: tuple[Node, ...]) -> Value:
        values = [self(a) for a in args]
        if len(values) < 3 or not len(values) % 2:
            raise ExpressionError("if takes conditions with values, and another value")
        return lib.choose(list(zip(values[:-1:2], values[1:-1:2])), values[-1])

    def call_catch(self, args: tuple[Node, ...]) -> Value:
        """Errors are null here, as all functions are lenient but the ordering comparisons."""
        v = Lenient(self.schema, self.extra, self.suffix)(args[0])
        if len(args) == 1:
            return Value(v.col.isNull().cast("int"), "num")
        return lib.choose([(Value(v.col.isNotNull(), "bool"), v)], self(args[1]))

    def call_region(self, args: tuple[Node, ...]) -> Value:
        roles = model.resolve_roles(self.names, ("chromosome", "begin", "end"))
        chromosome, begin, end = (self.field(roles[r]) for r in ("chromosome", "begin", "end"))
        where, out = chr_clip(text(chromosome)), F.lit(False)
        values = [a.value for a in args]
        specs: list[tuple[str, int | None, int | None]] = []
        if all(isinstance(v, str) for v in values):
            for v in values:
                m = re.fullmatch(r"([^:]+)(?::(\d+)-(\d+))?", v)
                if not m:
                    raise ExpressionError(f"no region: {v}")
                specs.append((m[1], int(m[2]) if m[2] else None, int(m[3]) if m[3] else None))
        else:
            for k in range(0, len(values), 3):
                specs.append((str(values[k]), *(int(x) for x in values[k + 1 : k + 3])) if k + 2 < len(values) else (str(values[k]), None, None))
        for name, b, e in specs:
            hit = where == chr_clip(F.lit(name))
            if b is not None:
                hit = hit & (F.lit(b) < number(end)) & (F.lit(e) > number(begin))
            out = out | hit
        return Value(out, "bool")

    def call_zyg(self, args: tuple[Node, ...]) -> Value:
        if len(args) == 1:
            s = self._name(args[0])
            values = [self.field(f"{f}-{s}") if f"{f}-{s}" in self.names else None for f in ("sequenced", "alleleSeq1", "alleleSeq2")]
            return lib.zyg([*(v for v in values if v), self.field("ref"), self.field("alt")])
        return lib.zyg([self(a) for a in args])

    @staticmethod
    def _name(n: Node) -> str:
        return str(n.value)

    def _genotypes(self, args: tuple[Node, ...]) -> list[tuple[Column, Column, Column]]:
        out = []
        for a in args:
            s = self._name(a)
            seq = text(self.field(f"sequenced-{s}"))
            out.append((seq, text(self.field(f"alleleSeq1-{s}")), text(self.field(f"alleleSeq2-{s}"))))
        return out

    def call_compare(self, args: tuple[Node, ...]) -> Value:
        if len(args) != 2:
            raise ExpressionError("compare takes two analyses")
        (s1, a1, b1), (s2, a2, b2) = self._genotypes(args)
        same = ((a1 == a2) & (b1 == b2)) | ((a1 == b2) & (b1 == a2))
        out = F.when((s1 == "u") | (s2 == "u"), "un").when((s1 == "r") & (s2 == "r"), "r").when((s1 == "r") & (s2 == "v"), "df").when((s1 == "v") & (s2 == "r"), "df")
        return Value(out.when((s1 == "v") & (s2 == "v"), F.when(same, "sm").otherwise("mm")).otherwise("?"), "text")

    def _pairs_same(self, g: list[tuple[Column, Column, Column]]) -> Column:
        _, a, b = g[0]
        out = F.lit(True)
        for _, c, d in g[1:]:
            out = out & (((a == c) & (b == d)) | ((a == d) & (b == c)))
        return out

    def call_sm(self, args: tuple[Node, ...]) -> Value:
        g = self._genotypes(args)
        return Value(self._every(g, "v") & self._pairs_same(g), "bool")

    def call_same(self, args: tuple[Node, ...]) -> Value:
        g = self._genotypes(args)
        return Value(~self._some(g, "u") & self._pairs_same(g), "bool")

    def call_df(self, args: tuple[Node, ...]) -> Value:
        g = self._genotypes(args)
        return Value(~self._some(g, "u") & self._some(g, "v") & self._some(g, "r"), "bool")

    def call_mm(self, args: tuple[Node, ...]) -> Value:
        g = self._genotypes(args)
        ref = text(self.field("ref"))
        plain = F.lit(False)
        for _, a, b in g:
            plain = plain | ((a == ref) & (b == ref))
        return Value(self._every(g, "v") & ~plain & ~self._pairs_same(g), "bool")

    def call_un(self, args: tuple[Node, ...]) -> Value:
        g = self._genotypes(args)
        return Value(self._some(g, "u") & self._some(g, "v"), "bool")

    def call_hovar(self, args: tuple[Node, ...]) -> Value:
        s, a, b = self._genotypes(args)[0]
        return Value((s == "v") & (a == b), "bool")

    @staticmethod
    def _every(g: list, code: str) -> Column:
        out = F.lit(True)
        for s, _, _ in g:
            out = out & (s == code)
        return out

    @staticmethod
    def _some(g: list, code: str) -> Column:
        out = F.lit(False)
        for s, _, _ in g:
            out = out | (s == code)
        return out

    # aggregates over the samples or analyses of a row

    def over_samples(self, how: str, args: tuple[Node, ...], by_sample: bool) -> Value:
        every = model.samples(self.names) if by_sample else model.analyses(self.names)
        special = "sample" if by_sample else "analysis"
        wanted = [f for a in args for f in fields(a) if f != special]
        chosen = []
        for s in every:
            c = self.under(s, {special: s})
            own = [f for f in wanted if f"{f}-{s}" in self.names]
            if all(c.has(f) for f in wanted) and (own or not wanted):
                chosen.append(c)
        cond = lambda c, a: F.coalesce(truth(c(a)), F.lit(False))
        if how == "count":
            return Value(sum((cond(c, args[0]).cast("int") for c in chosen), F.lit(0)), "num")
        if how == "percent":
            first = sum((cond(c, args[0]).cast("int") for c in chosen), F.lit(0))
            both = sum(((cond(c, args[0]) & cond(c, args[1])).cast("int") for c in chosen), F.lit(0))
            return Value(F.when(first > 0, F.lit(100.0) * both / first), "num")
        value = args[-1]
        if chosen and how in lib.TYPED and all(c(value).kind == "num" for c in chosen):  # numbers stay numbers: no array, no text
            return lib.of_columns(how, [F.when(cond(c, args[0]), c(value).col) if len(args) == 2 else c(value).col for c in chosen])
        got = [F.when(cond(c, args[0]), text(c(value))) if len(args) == 2 else text(c(value)) for c in chosen]
        array = F.filter(F.array(*got).cast("array<string>"), lambda x: x.isNotNull()) if got else F.array().cast("array<string>")
        return lib.aggregate(how, array)


class Lenient(Compiler):
    """Comparisons of what is no number are null instead of an error."""

    def operate(self, op: str, a: Value, b: Value) -> Value:
        if op in ("<", ">", "<=", ">="):
            x, y = number(a), number(b)
            return Value({"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op], "bool")
        return super().operate(op, a, b)


def compile_expression(source: str, schema: StructType, extra: Mapping[str, Value] | None = None) -> Value:
    return Compiler(schema, extra)(parse(source))


def output(v: Value) -> Column:
    """As a column of a table: truth as 0 and 1, vectors joined by commas."""
    return text(v) if v.kind == "list" else v.col.cast("int") if v.kind == "bool" else v.col


__all__ = ["Compiler", "compile_expression", "output", "same_length"]
