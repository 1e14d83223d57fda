"""The function library of expressions, all in native column functions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..natural import chr_clip, nat_key, nat_sort
from .parser import ExpressionError
from .values import Value, bound, constant, deviation, equal, fixed, integer, is_integer, is_number, items, mean, middle, modes, number, numbers, quartile, same_length, text, total, truth

Function = Callable[[list[Value]], Value]
FUNCTIONS: dict[str, Function] = {}

#: From the mildest to the gravest effect on a gene.
IMPACTS = tuple(
    "downstream upstream annot A intron reg prom splice RNA RNASPLICE UTR3 UTR3SPLICE RNAEND ESPLICE CDSsilent UTR5 UTR5SPLICE UTR5KOZAK RNASTART CDSMIS CDSCOMP CDSDEL CDSINS CDSNONSENSE CDSSPLICE CDSSTOP CDSFRAME CDSSTART CDSSTARTCOMP CDSSTARTDEL GENECOMP GENEDEL".split()
)


def _floored(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; null for zero."""
    z = F.when(b != 0, b)
    return a - F.floor(a / z) * z


ARITHMETIC: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: a.cast("double") / F.when(b != 0, b),
    "%": _floored,
    "**": lambda a, b: F.pow(a, b),
}
_ELEMENT: dict[str, Callable[[Column, Column], Column]] = ARITHMETIC | {
    ">": lambda a, b: (a > b).cast("int"), "<": lambda a, b: (a < b).cast("int"), ">=": lambda a, b: (a >= b).cast("int"), "<=": lambda a, b: (a <= b).cast("int"),
}
VECTOR = {"@" + op: op for op in (*_ELEMENT, "==", "!=", "&&", "||")} | {"vand": "&&", "vor": "||"}


def _shown(x: Column) -> Column:
    """A number as text, whole ones without a fraction; NaN for none."""
    whole = lambda v: (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.coalesce(bound(x, lambda v: F.when(whole(v), v.cast("long").cast("string")).otherwise(v.cast("string"))), F.lit("NaN"))


def vector_operator(op: str, a: Value, b: Value) -> Value:
    op = VECTOR[op]
    num = lambda v: F.when(is_number(v), v.cast("double"))
    if op in ("==", "!="):
        same = lambda p, q: equal(Value(p, "text"), Value(q, "text"))
        one = lambda p, q: (same(p, q) if op == "==" else ~same(p, q)).cast("int").cast("string")
    elif op in ("&&", "||"):
        yes = lambda v: F.coalesce(num(v) != 0, F.lit(False))
        one = lambda p, q: ((yes(p) & yes(q)) if op == "&&" else (yes(p) | yes(q))).cast("int").cast("string")
    else:
        one = lambda p, q: _shown(_ELEMENT[op](num(p), num(q)))
    pair = F.struct(items(a).alias("a"), items(b).alias("b"))
    return Value(bound(pair, lambda s: F.zip_with(*same_length(s["a"], s["b"]), one)), "list")


def function(*names: str) -> Callable[[Function], Function]:
    def add(f: Function) -> Function:
        for n in names:
            FUNCTIONS[n] = f
        return f

    return add


def _number(f: Callable[..., Column]) -> Function:
    return lambda a: Value(f(*map(number, a)), "num")


def _simple() -> None:
    for name in "exp sqrt ceil floor abs cos cosh sin sinh tan tanh atan".split():
        FUNCTIONS[name] = _number(getattr(F, name))
    for name in ("acos", "asin"):
        f = getattr(F, name)
        FUNCTIONS[name] = _number(lambda x, f=f: F.when(F.abs(x) <= 1, f(x)))
    FUNCTIONS.update({
        "log": _number(lambda x: F.when(x > 0, F.log(x))),
        "log10": _number(lambda x: F.when(x > 0, F.log10(x))),
        "pow": _number(F.pow), "hypot": _number(F.hypot), "atan2": _number(F.atan2),
        "fmod": _number(lambda x, y: x % F.when(y != 0, y)),
        "isqrt": _number(lambda x: F.floor(F.sqrt(x))),
        "round": _number(lambda x: F.round(x).cast("long")),
        "double": _number(lambda x: x.cast("double")),
        **{n: _number(lambda x: F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("long")) for n in ("int", "wide", "entier")},
        "rand": lambda a: Value(F.rand(), "num"),
        "srand": lambda a: Value(F.rand(int(a[0].literal)), "num"),
        "bool": lambda a: Value(truth(a[0]), "bool"),
        "not": lambda a: Value(~truth(a[0]), "bool"),
    })


FUNCTIONS_TEXT = {
    "concat": lambda a: F.concat(*map(text, a)),
    "toupper": lambda a: F.upper(text(a[0])),
    "tolower": lambda a: F.lower(text(a[0])),
    "chr_clip": lambda a: chr_clip(text(a[0])),
}


def _extreme(name: str) -> Function:
    def f(a: list[Value]) -> Value:
        values = [number(v) for v in a]
        # an error in the reference where one is no number; null here, as NaN is
        bad = F.lit(False)
        for v in values:
            bad = bad | v.isNull()
        got = values[0] if len(values) == 1 else (F.least if name == "min" else F.greatest)(*values)
        return Value(F.when(~bad, got), "num")

    return f


def _all(a: list[Value]) -> Column:
    """Elements of all vectors."""
    return items(a[0]) if len(a) == 1 else F.concat(*map(items, a))


def _reduce(f: Callable[[Column], Column]) -> Function:
    return lambda a: Value(f(numbers(_all(a))), "num")


def _truthy(x: Column) -> Column:
    return is_integer(x) & (x.cast("double") != 0)


def _regex(v: Value) -> Column:
    return v.col if v.literal is None else F.lit(v.literal)


def glob(pattern: str) -> str:
    """A glob as a regular expression for the whole text."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 1)
        if c == "[" and end > 0:
            out += "[" + pattern[i + 1 : end].replace("\\", "\\\\") + "]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        i += 1
    return f"(?s)^{out}$"


def _glob(v: Value, fold: bool = False) -> Column:
    if not isinstance(v.literal, str):
        raise ExpressionError("a glob has to be a constant")
    return F.lit(("(?i)" if fold else "") + glob(v.literal))


def choose(pairs: list[tuple[Value, Value]], other: Value) -> Value:
    """The value of the first condition that holds. Numbers stay numbers if all values are."""
    kinds = {v.kind for _, v in pairs} | {other.kind}
    kind = kinds.pop() if len(kinds) == 1 else ("num" if kinds <= {"num", "bool"} else "text")
    of = {"num": number, "bool": truth, "list": items, "text": text}[kind]
    out = None
    for cond, v in pairs:
        c = F.coalesce(truth(cond), F.lit(False))
        out = F.when(c, of(v)) if out is None else out.when(c, of(v))
    return Value(out.otherwise(of(other)), kind)


def lift(f: Function, args: list[Value]) -> Value:
    """f applied by position; vectors of one element are repeated."""
    each = F.struct(*[c.alias(f"v{i}") for i, c in enumerate(map(items, args))])

    def sized(s: Column, n: Column) -> Column:
        bad = F.raise_error(F.lit("vectors of different length")).cast("array<string>")
        vectors = [s[f"v{i}"] for i in range(len(args))]
        return F.struct(n.alias("n"), *[F.when(F.size(v) == 1, F.array_repeat(F.get(v, F.lit(0)), n)).when(F.size(v) == n, v).otherwise(bad).alias(f"v{i}") for i, v in enumerate(vectors)])

    def one(row: Column) -> Column:
        got = f([Value(row[f"v{i}"], "text", a.literal if isinstance(a.literal, str) else None) for i, a in enumerate(args)])
        return _shown(got.col) if got.kind == "num" else F.coalesce(text(got), F.lit("NaN"))

    def all_of(s: Column) -> Column:
        rows = F.transform(F.sequence(F.lit(0), s["n"] - 1), lambda i: F.struct(*[F.get(s[f"v{k}"], i).alias(f"v{k}") for k in range(len(args))]))
        return F.when(s["n"] > 0, F.transform(rows, one)).otherwise(F.array().cast("array<string>"))

    longest = lambda s: F.array_max(F.array(*[F.size(s[f"v{i}"]) for i in range(len(args))]))
    return Value(bound(each, lambda s: bound(F.when(longest(s) > 0, sized(s, longest(s))), all_of)), "list")


def aggregate(how: str, array: Column) -> Value:
    """An aggregate of the samples of a row, given as an array of text."""
    nums = numbers(array)
    if how == "list":
        return Value(array, "list")
    if how == "distinct":
        return Value(F.array_distinct(array), "list")
    if how == "ucount":
        return Value(F.size(F.array_distinct(array)), "num")
    if how == "mode":
        return Value(modes(array), "list")
    f = {"min": F.array_min, "max": F.array_max, "sum": total, "avg": mean, "stdev": deviation, "median": middle}[how]
    return Value(f(nums), "num")


#: Aggregates that need no array of numeric columns.
TYPED = ("min", "max", "sum", "avg", "stdev")


def of_columns(how: str, cols: list[Column]) -> Value:
    """The same of numeric columns, as plain arithmetic; nulls are passed over."""
    cols = [c.cast("double") for c in cols]
    if how in ("min", "max"):
        return Value(cols[0] if len(cols) == 1 else (F.least if how == "min" else F.greatest)(*cols), "num")
    some = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    n = F.when(some > 0, some)
    whole = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    if how == "sum":
        return Value(F.when(some > 0, whole), "num")
    if how == "avg":
        return Value(whole / n, "num")
    squares = sum((F.coalesce((c - whole / n) * (c - whole / n), F.lit(0.0)) for c in cols), F.lit(0.0))
    return Value(F.sqrt(squares / n), "num")


def zyg(a: list[Value]) -> Value:
    """Zygosity from sequenced (may be left out), two alleles, ref and alt."""
    if len(a) == 4:
        a = [constant("v"), *a]
    seq, a1, a2, ref = (text(v) for v in a[:4])
    alt = text(a[4])
    alts = F.when(alt == "", F.array(F.lit(""))).otherwise(items(a[4]))
    in1, in2 = F.array_contains(alts, a1), F.array_contains(alts, a2)
    unknown = (a1 == "?") | (a2 == "?")
    called = (
        F.when(unknown, "v").when(in1, F.when(a1 == a2, "m").when(a2 == ref, "t").otherwise("c")).when(in2, F.when(a1 == ref, "t").otherwise("c")).when((a1 == ref) & (a2 == ref), "r").otherwise("o")
    )
    any_alt = F.when(unknown, "?").when(a1 != a2, "t").when(a1 == ref, "r").otherwise("m")
    return Value(F.when(seq.isin("r", "u"), seq).when(alt == "?", any_alt).when(seq == "v", called).otherwise("?"), "text")


def _rank(x: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, IMPACTS)), x)


def _fill() -> None:
    _simple()
    for name, f in FUNCTIONS_TEXT.items():
        FUNCTIONS[name] = lambda a, f=f: Value(f(a), "text")
    FUNCTIONS["min"], FUNCTIONS["max"] = _extreme("min"), _extreme("max")
    scalars = lambda a: F.filter(F.array(*[number(v).cast("double") for v in a]), lambda x: x.isNotNull())
    for name, f in {"avg": mean, "sum": total, "median": middle, "q1": lambda x: quartile(x, False), "q3": lambda x: quartile(x, True)}.items():
        FUNCTIONS[name] = lambda a, f=f: Value(f(scalars(a)), "num")
    for name, f in {"lmin": F.array_min, "lmax": F.array_max, "lsum": total, "lavg": mean, "lstdev": deviation, "lstddev": deviation, "lmedian": middle}.items():
        FUNCTIONS[name] = _reduce(f)
    FUNCTIONS["lmode"] = lambda a: Value(modes(_all(a)), "list")
    for name, best in (("lminpos", F.array_min), ("lmaxpos", F.array_max)):

        def position(a: list[Value], best=best) -> Value:
            every = F.transform(_all(a), lambda x: F.when(is_number(x), x.cast("double")))
            return Value(F.when(best(every).isNotNull(), F.array_position(every, best(every)) - 1), "num")

        FUNCTIONS[name] = position
    for name, best in (("lmind", F.array_min), ("lmaxd", F.array_max)):

        def with_default(a: list[Value], best=best) -> Value:
            d = number(a[-1]).cast("double")
            return Value(best(F.transform(_all(a[:-1]), lambda x: F.when(is_number(x), x.cast("double")).otherwise(d))), "num")

        FUNCTIONS[name] = with_default
    FUNCTIONS["lone"] = lambda a: Value(F.exists(_all(a), _truthy), "bool")
    FUNCTIONS["lall"] = lambda a: Value(F.forall(F.filter(_all(a), is_integer), _truthy), "bool")
    FUNCTIONS["lcount"] = lambda a: Value(F.size(F.filter(_all(a), _truthy)), "num")
    FUNCTIONS["llen"] = FUNCTIONS["llength"] = lambda a: Value(F.size(_all(a)), "num")
    FUNCTIONS["lindex"] = lambda a: Value(F.get(items(a[0]), number(a[1]).cast("int")), "text")
    FUNCTIONS["lsort"] = lambda a: Value(nat_sort(_all(a)), "list")
    FUNCTIONS["ljoin"] = lambda a: Value(F.array_join(items(a[0]), str(a[1].literal) if len(a) > 1 else ","), "text")
    FUNCTIONS["vector"] = lambda a: Value(_all(a), "list")
    FUNCTIONS["distinct"] = FUNCTIONS["vdistinct"] = lambda a: Value(F.array_distinct(_all(a)), "list")
    FUNCTIONS["ucount"] = lambda a: Value(F.size(F.array_distinct(_all(a))), "num")
    FUNCTIONS["split"] = lambda a: Value(F.split(text(a[0]), "[" + re.escape(str(a[1].literal) if len(a) > 1 else ",") + "]"), "list")
    FUNCTIONS["length"] = lambda a: Value(F.length(text(a[0])), "num")
    FUNCTIONS["isnum"] = lambda a: Value(number(a[0]).isNotNull(), "bool")
    FUNCTIONS["isint"] = lambda a: Value(F.coalesce(is_integer(text(a[0])), F.lit(False)), "bool")
    FUNCTIONS["def"] = lambda a: Value(F.coalesce(number(a[0]), number(a[1])), "num")
    FUNCTIONS["samechr"] = lambda a: Value(chr_clip(text(a[0])) == chr_clip(text(a[1])), "bool")
    FUNCTIONS["samegeno"] = lambda a: Value(((text(a[0]) == text(a[2])) & (text(a[1]) == text(a[3]))) | ((text(a[0]) == text(a[3])) & (text(a[1]) == text(a[2]))), "bool")
    FUNCTIONS["contains"] = lambda a: Value(F.array_contains(items(a[0]), text(a[1])), "bool")
    FUNCTIONS["shares"] = lambda a: Value(F.arrays_overlap(items(a[0]), items(a[1])), "bool")


@function("lrange")
def _lrange(a: list[Value]) -> Value:
    v, first = items(a[0]), number(a[1]).cast("int")
    last = F.size(v) - 1 if a[2].literal == "end" else number(a[2]).cast("int")
    count = F.greatest(F.least(last, F.size(v) - 1) - F.greatest(first, F.lit(0)) + 1, F.lit(0))
    return Value(F.slice(v, F.greatest(first, F.lit(0)) + 1, count), "list")


@function("lsearch")
def _lsearch(a: list[Value]) -> Value:
    v = items(a[0])
    if len(a) > 2 and a[2].literal in ("-glob", "glob"):
        pattern = _glob(a[1])
        return Value(F.coalesce(F.array_position(F.transform(v, lambda x: x.rlike(pattern)), True) - 1, F.lit(-1)), "num")
    return Value(F.array_position(v, text(a[1])) - 1, "num")


@function("oneof")
def _oneof(a: list[Value]) -> Value:
    options = [o for v in a[1:] for o in (v.literal if isinstance(v.literal, tuple) else (v,))]
    out = F.lit(False)
    for o in options:
        out = out | equal(a[0], o if isinstance(o, Value) else constant(o))
    return Value(out, "bool")


@function("between")
def _between(a: list[Value]) -> Value:
    low, high = (constant(x) for x in a[1].literal) if isinstance(a[1].literal, tuple) else (a[1], a[2])
    return Value(number(a[0]).between(number(low), number(high)), "bool")


@function("regexp", "ncregexp")
def _regexp(a: list[Value]) -> Value:
    return Value(text(a[0]).rlike(_regex(a[1]) if not isinstance(a[1].literal, str) else a[1].literal), "bool")


FUNCTIONS["ncregexp"] = lambda a: Value(text(a[0]).rlike("(?i)" + str(a[1].literal)), "bool")


@function("regextract")
def _regextract(a: list[Value]) -> Value:
    """The groups of the first pattern that matches, by commas; the whole match of a pattern without groups."""
    x, out = text(a[0]), None
    for p in a[1:]:
        pattern = str(p.literal)
        groups = re.compile(pattern).groups
        got = F.concat_ws(",", *[F.regexp_extract(x, pattern, g) for g in range(1, groups + 1)]) if groups else F.regexp_extract(x, pattern, 0)
        out = F.when(x.rlike(pattern), got) if out is None else out.when(x.rlike(pattern), got)
    return Value(out.otherwise(""), "text")


@function("regsub")
def _regsub(a: list[Value]) -> Value:
    """The first match replaced; all with -all as another argument."""
    pattern, by = str(a[1].literal), re.sub(r"\\(\d)", r"$\1", re.sub(r"([$])", r"\\\1", str(a[2].literal)))
    if any(v.literal == "-all" for v in a[3:]):
        return Value(F.regexp_replace(text(a[0]), pattern, by), "text")
    shift = re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 1}", by)
    rest = re.compile(pattern).groups + 2
    return Value(F.regexp_replace(text(a[0]), f"(?s)^(.*?)(?:{pattern})(.*)$", f"$1{shift}${rest}"), "text")


@function("matches", "match")
def _matches(a: list[Value]) -> Value:
    return Value(text(a[0]).rlike(glob(str(a[1].literal))), "bool")


FUNCTIONS["ncmatches"] = lambda a: Value(text(a[0]).rlike("(?i)" + glob(str(a[1].literal))), "bool")


@function("format")
def _format(a: list[Value]) -> Value:
    pattern, args, values = str(a[0].literal), [], iter(a[1:])

    def one(m: re.Match) -> str:
        flags, width, places, kind = m.groups()
        if kind == "%":
            return m[0]
        v = next(values)
        if kind == "f" and not set(flags) - {"-"}:
            args.append(fixed(number(v), int(places[1:] or 0) if places is not None else 6))
            return f"%{flags}{width}s"
        args.append(integer(v) if kind in "dxXoi" else text(v) if kind == "s" else number(v).cast("double"))
        return m[0].replace("i", "d")

    return Value(F.format_string(re.sub(r"%([-+ #0]*)(\d*)(\.\d*)?([a-zA-Z%])", one, pattern), *args), "text")


@function("trimformat")
def _trimformat(a: list[Value]) -> Value:
    return Value(F.regexp_replace(F.regexp_replace(_format(a).col, r"(\.\d*?)0+$", "$1"), r"\.$", ""), "text")


@function("percent")
def _percent(a: list[Value]) -> Value:
    places = int(a[1].literal) if len(a) > 1 else 1
    return Value(fixed(number(a[0]).cast("double") * 100, places), "text")


@function("vabs")
def _vabs(a: list[Value]) -> Value:
    return Value(F.transform(items(a[0]), lambda x: _shown(F.abs(F.when(is_number(x), x.cast("double"))))), "list")


@function("vdef")
def _vdef(a: list[Value]) -> Value:
    return Value(F.transform(items(a[0]), lambda x: F.when(is_number(x), x).otherwise(text(a[1]))), "list")


def _by_position(f: Callable[[Column], Column]) -> Function:
    def run(a: list[Value]) -> Value:
        vectors = list(map(items, a))
        n = F.array_max(F.array(*map(F.size, vectors)))
        at = lambda i: numbers(F.filter(F.array(*[F.when(F.size(v) == 1, F.get(v, F.lit(0))).otherwise(F.get(v, i)) for v in vectors]), lambda x: x.isNotNull()))
        return Value(F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: _shown(f(at(i))))).otherwise(F.array().cast("array<string>")), "list")

    return run


FUNCTIONS |= {"vavg": _by_position(mean), "vmax": _by_position(F.array_max), "vmin": _by_position(F.array_min)}


@function("vif")
def _vif(a: list[Value]) -> Value:
    return lift(lambda x: choose(list(zip(x[:-1:2], x[1:-1:2])), x[-1]), a)


@function("vformat")
def _vformat(a: list[Value]) -> Value:
    return lift(lambda x: _format([a[0], *x]), a[1:])


@function("zyg")
def _zyg(a: list[Value]) -> Value:
    return zyg(a)


@function("codingcat", "coding")
def _codingcat(a: list[Value]) -> Value:
    x = F.concat_ws(",", *map(text, a))
    return Value(F.when(x.rlike("CDS"), "C").when(x.rlike("UTR"), "U").when(x.rlike("RNA"), "R").when(x.rlike("splice"), "s").otherwise("-"), "text")


@function("maximpact")
def _maximpact(a: list[Value]) -> Value:
    ranks = F.transform(_all(a), _rank)
    return Value(F.coalesce(F.get(F.array(*map(F.lit, IMPACTS)), (F.array_max(ranks) - 1).cast("int")), F.lit("")), "text")


@function("exonlist")
def _exonlist(a: list[Value]) -> Value:
    full = [F.filter(items(v), lambda x: x != "") for v in a[:2]]
    return Value(F.zip_with(*full, lambda s, e: F.concat_ws("-", s, e)), "list")


@function("transcripts")
def _transcripts(a: list[Value]) -> Value:
    """Names from parallel lists of genes, impacts and descriptions, by impact (globs, or >=impact) and
    format: t, gt or g."""
    genes, impacts, descr = (F.split(text(v), ";") for v in a[:3])
    chosen = str(a[3].literal or "") if len(a) > 3 else ""
    how = str(a[4].literal) if len(a) > 4 else "t"
    zipped = F.transform(F.sequence(F.lit(0), F.size(descr) - 1), lambda i: F.struct(F.coalesce(F.get(genes, i), F.get(genes, F.lit(0))).alias("g"), F.get(impacts, i).alias("i"), F.regexp_extract(F.get(descr, i), r"^[+-]?([^:]*)", 1).alias("t")))
    wanted: list[str] = []
    for p in filter(None, re.split("[, ]", chosen)):
        m = re.match(r"(>=?)(.*)", p)
        if m:
            low = [i.lower() for i in IMPACTS].index(m[2].lower()) + (m[1] == ">")
            wanted += IMPACTS[low:]
        else:
            wanted += [i for i in IMPACTS if re.match(glob(p), i)]
    kept = F.filter(zipped, lambda s: s["i"].isin(wanted)) if chosen else zipped
    name = {"t": lambda s: s["t"], "g": lambda s: s["g"], "gt": lambda s: F.concat_ws(":", s["g"], s["t"])}[how]
    return Value(F.array_join(F.array_distinct(F.transform(kept, name)), ";"), "text")


@function("loc_compare")
def _loc_compare(a: list[Value]) -> Value:
    x, y = (nat_key(chr_clip(text(v))) for v in a[:2])
    return Value(F.when(x < y, -1).when(x > y, 1).otherwise(0), "num")


for _name in ("lt", "gt", "le", "ge"):

    def _natural(a: list[Value], op=_name) -> Value:
        x, y = nat_key(text(a[0])), nat_key(text(a[1]))
        return Value({"lt": x < y, "gt": x > y, "le": x <= y, "ge": x >= y}[op], "bool")

    FUNCTIONS[_name] = _natural

_fill()


def register(name: str, f: Function) -> None:
    """Make f callable in expressions, also between two arguments, and by position as v + name."""
    FUNCTIONS[name] = f
