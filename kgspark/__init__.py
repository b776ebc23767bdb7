"""A knowledge-graph query layer for Apache Spark DataFrames."""

from kgspark.functions import agg, fn
from kgspark.plans import paths as path
from kgspark.plans.bindings import Bindings, desc
from kgspark.plans.kg import KG, TripleGraph, graph
from kgspark.plans.mapping import (ColumnObj, ConstObj, IriColumn, Mapping, RefObj, Source, Tables,
                                   TemplateObj, TriplesMap)
from kgspark.plans.ontology import Ontology
from kgspark.session import configure, materialize
from kgspark.terms import (IRI, OWL, RDF, RDFS, RR, SKOS, XSD, Lit, Namespace, NotUniquelyTyped, RdfType,
                           Template)

__all__ = ["agg", "fn", "path", "Bindings", "desc", "KG", "TripleGraph", "graph", "ColumnObj", "ConstObj",
           "IriColumn", "Mapping", "RefObj", "Source", "Tables", "TemplateObj", "TriplesMap", "Ontology",
           "configure", "materialize", "IRI", "OWL", "RDF", "RDFS", "RR", "SKOS", "XSD", "Lit", "Namespace",
           "NotUniquelyTyped", "RdfType", "Template"]
