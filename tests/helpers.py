"""Small frames and a brute-force solution algebra."""

from kgspark.plans.bindings import Bindings
from kgspark.plans.branch import Branch, Var
from kgspark.terms import INTEGER_T

T_DDL = "s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string"
STR = "http://www.w3.org/2001/XMLSchema#string"


def triples(spark, rows):
    """(s, p, o): ``_:x`` is a blank node, ``"x`` a literal, anything else an IRI."""
    def node(x):
        if x.startswith("_:"):
            return x[2:], "bnode"
        return (x[1:], "literal") if x.startswith('"') else (x, "iri")

    out = []
    for s, p, o in rows:
        (s, sk), (o, ok) = node(s), node(o)
        out.append((s, sk, str(p), o, ok, STR if ok == "literal" else None, None))
    return spark.createDataFrame(out, T_DDL)


def solutions(spark, names, rows):
    """Bindings over one frame whose integer variables may all be unbound."""
    df = spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{n} bigint" for n in names))
    infos = {n: Var(INTEGER_T, nullable=True) for n in names}
    return Bindings(spark, [Branch(spark, infos, df)], infos)


def bag(bindings):
    names = list(bindings.names)
    return sorted((tuple(r[n] for n in names) for r in bindings.df.collect()), key=repr)


def as_dicts(names, rows):
    return [{n: v for n, v in zip(names, r) if v is not None} for r in rows]


def compatible(a, b):
    return all(a[k] == b[k] for k in a.keys() & b.keys())


def rows_of(dicts, names):
    return sorted((tuple(d.get(n) for n in names) for d in dicts), key=repr)


def brute_join(a, b):
    return [{**x, **y} for x in a for y in b if compatible(x, y)]


def brute_optional(a, b, cond=lambda d: True):
    out = []
    for x in a:
        hits = [{**x, **y} for y in b if compatible(x, y) and cond({**x, **y})]
        out += hits or [x]
    return out


def brute_minus(a, b):
    return [x for x in a if not any(compatible(x, y) and x.keys() & y.keys() for y in b)]


def brute_exists(a, b, want=True):
    return [x for x in a if any(compatible(x, y) for y in b) is want]
