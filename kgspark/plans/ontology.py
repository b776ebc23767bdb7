"""The schema part of an ontology as build-time metadata.

Only statements of the five schema predicates that bear on the mapping's own terms are read to the
driver, however large the ontology is; the operators in :mod:`kgspark.operators` work on the ontology as a DataFrame of any size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.session import materialize
from kgspark.terms import OWL, RDFS

SCHEMA_PREDICATES = tuple(str(p) for p in (
    RDFS.domain, RDFS.range, RDFS.subClassOf, RDFS.subPropertyOf, OWL.inverseOf))


class Ontology:
    """``triples``: (s, p, o) tuples of IRIs; blank nodes (union classes) are left out."""

    def __init__(self, triples: Iterable[tuple[str, str, str]] = ()):
        self.sub_classes, self.sub_props = defaultdict(set), defaultdict(set)
        self.inverses, self.domains, self.ranges = defaultdict(set), defaultdict(set), defaultdict(set)
        for s, p, o in triples:
            if p == RDFS.subClassOf:
                self.sub_classes[o].add(s)
            elif p == RDFS.subPropertyOf:
                self.sub_props[o].add(s)
            elif p == OWL.inverseOf:
                self.inverses[s].add(o)
                self.inverses[o].add(s)
            elif p == RDFS.domain:
                self.domains[o].add(s)
            elif p == RDFS.range:
                self.ranges[o].add(s)

    @classmethod
    def from_df(cls, tbox: DataFrame, terms: Iterable[str]) -> "Ontology":
        """The statements met on the way up from the classes and properties in ``terms``: to what they are
        below, to inverses, and to the domains and ranges of properties. Other statements say nothing
        about data of these terms. One round per step of the longest way.
        """
        schema = materialize(tbox.where(F.col("p").isin(list(SCHEMA_PREDICATES)) & (F.col("s_kind") == "iri")
                                        & (F.col("o_kind") == "iri")).select("s", "p", "o").distinct())
        found, seen, new = set(), set(), {str(t) for t in terms}
        while new:
            seen |= new
            back = (F.col("p") == str(OWL.inverseOf)) & F.col("o").isin(list(new))
            rows = {(r.s, r.p, r.o) for r in schema.where(F.col("s").isin(list(new)) | back).toLocalIterator()}
            found |= rows
            new = {x for s, p, o in rows for x in ((s, o) if p == str(OWL.inverseOf) else (o,))} - seen
        return cls(found)

    def class_names(self, cls: str) -> set[str]:
        """``cls`` and everything below it."""
        seen, todo = {str(cls)}, [str(cls)]
        while todo:
            for sub in self.sub_classes.get(todo.pop(), ()):
                if sub not in seen:
                    seen.add(sub)
                    todo.append(sub)
        return seen

    def properties(self, prop: str) -> set[tuple[str, bool]]:
        """(property, swapped) pairs whose triples entail ``prop``."""
        seen, todo = {(str(prop), False)}, [(str(prop), False)]
        while todo:
            name, swapped = todo.pop()
            for nxt in ([(q, swapped) for q in self.sub_props.get(name, ())]
                        + [(q, not swapped) for q in self.inverses.get(name, ())]):
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return seen
