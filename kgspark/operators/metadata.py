"""Table metadata, and mappings derived from it for many tables at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.operators.catalog import pom_struct
from kgspark.session import materialize
from kgspark.sources.prefixes import map_id
from kgspark.terms import XSD, enc

COLUMNS_DDL = "table_fqn string, pos int, name string, type string, comment string"
# SQL type names and the RDF datatype of their columns; others are strings.
TYPE_DATATYPES = {
    "boolean": "boolean", "tinyint": "integer", "smallint": "integer", "int": "integer", "integer": "integer",
    "bigint": "integer", "long": "integer", "short": "integer", "byte": "integer", "decimal": "decimal",
    "float": "float", "double": "double", "date": "date", "timestamp": "dateTime", "timestamp_ntz": "dateTime",
    "binary": "hexBinary",
}


def qualify(name: str, catalog: str, schema: str) -> str:
    """Full name of a table named with one, two or three parts."""
    if not catalog.strip() or not schema.strip():
        raise ValueError("the default catalog and schema must not be empty")
    parts = name.split(".")
    return ".".join([catalog, schema][: max(0, 3 - len(parts))] + parts)


def columns_df(spark: SparkSession, tables, default_catalog: str, default_schema: str) -> DataFrame:
    """One row per column of every table, sorted by table and column name; only schemas are read.

    ``tables``: names, or a dict of name -> DataFrame.
    """
    rows = []
    for name in tables:
        df = tables[name] if isinstance(tables, dict) else spark.table(name)
        for pos, f in enumerate(df.schema.fields, 1):
            rows.append((qualify(name, default_catalog, default_schema), pos, f.name,
                         f.dataType.simpleString() or "unknown", (f.metadata or {}).get("comment")))
    return spark.createDataFrame(rows, COLUMNS_DDL).orderBy("table_fqn", "name")


def primary_keys(constraints: DataFrame) -> DataFrame:
    """(table_fqn, pos, column) of each table's first declared primary key.

    ``constraints``: table_fqn, pos, kind, child_columns, parent_table, parent_columns.
    """
    keys = constraints.where((F.col("kind") == "PRIMARY KEY") & (F.size("child_columns") > 0))
    first = keys.groupBy("table_fqn").agg(F.min_by("child_columns", "pos").alias("cols"))
    return first.select("table_fqn", F.posexplode("cols").alias("pos", "column")).withColumn("pos", F.col("pos") + 1)


def foreign_keys(constraints: DataFrame) -> DataFrame:
    """(table_fqn, fk_id, pos, child_column, parent_fqn, parent_column), one row per column pair."""
    keys = constraints.where((F.col("kind") == "FOREIGN KEY") & (F.size("child_columns") > 0)
                             & (F.size("parent_columns") > 0))
    pairs = F.arrays_zip(F.col("child_columns").alias("child"), F.col("parent_columns").alias("parent"))
    rows = keys.select("table_fqn", F.col("pos").alias("fk_id"), F.col("parent_table").alias("parent_fqn"),
                       F.posexplode(pairs).alias("pos", "pair"))
    return rows.select("table_fqn", "fk_id", (F.col("pos") + 1).alias("pos"), F.col("pair.child").alias("child_column"),
                       "parent_fqn", F.col("pair.parent").alias("parent_column"))


def generation_set(tables: DataFrame, mode: str, table: str | None = None,
                   retry: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(tables to map, errors). ``tables``: fqn (may be NULL), error (NULL when readable).

    ``table`` mode takes one table; ``schema`` mode all named ones in order, or only those in
    ``retry`` (column ``table``). An unreadable table is an error row and the rest go on.
    """
    if mode == "table":
        if not table:
            raise ValueError("mode 'table' needs a table")
        chosen = tables.where(F.col("fqn") == table)
    elif mode == "schema":
        chosen = tables.where(F.coalesce("fqn", F.lit("")) != "")
        if retry is not None:
            chosen = chosen.join(retry.select(F.col("table").alias("fqn")).distinct(), "fqn", "left_semi")
    else:
        raise ValueError("mode is 'table' or 'schema'")
    ready = chosen.where("error IS NULL").select("fqn").orderBy("fqn")
    return ready, chosen.where("error IS NOT NULL").select(F.col("fqn").alias("table"), "error")


def join_candidates(fk: DataFrame, tables: DataFrame) -> DataFrame:
    """Foreign keys whose parent is, by its exact full name, in a set of more than one table."""
    names = tables.select("fqn").where("fqn IS NOT NULL").distinct()
    several = names.agg((F.min("fqn") != F.max("fqn")).alias("x"))
    kept = fk.join(names.withColumnRenamed("fqn", "parent_fqn"), "parent_fqn", "left_semi")
    return kept.where(F.coalesce(several.scalar(), F.lit(False))).select(*fk.columns)


def _datatype(type_name: Column) -> Column:
    base = F.lower(F.regexp_extract(type_name, r"^(\w+)", 1))
    out = None
    for sql, xsd in TYPE_DATATYPES.items():
        out = F.when(base == sql, F.lit(str(XSD) + xsd)) if out is None else out.when(base == sql, F.lit(str(XSD) + xsd))
    return out.otherwise(F.lit(""))


def bootstrap_mapping(columns: DataFrame, pk: DataFrame, fk: DataFrame, base_iri: str) -> DataFrame:
    """A first mapping of every table, as catalog rows.

    One map per table; every column, keys included, is a literal; the subject is made of the
    primary key (of all columns without one); every foreign key links to its parent's map. Names
    follow the W3C direct mapping: ``<base table>``, ``<base table#column>``, ``<base table#ref-…>``.
    """
    iri = F.concat(F.lit(base_iri), enc(F.col("table_fqn")))
    literal = pom_struct(predicate=F.concat(iri, F.lit("#"), enc(F.col("name"))), om_type=F.lit("column"),
                         column=F.col("name"), datatype=_datatype(F.col("type")), language=F.lit(""), term_type=F.lit(""))
    props = columns.groupBy("table_fqn").agg(
        F.sort_array(F.collect_list(F.struct("pos", literal.alias("pom")))).alias("literals"),
        F.sort_array(F.collect_list(F.struct("pos", F.col("name").alias("column")))).alias("all_columns"))
    keys = pk.groupBy("table_fqn").agg(F.sort_array(F.collect_list(F.struct("pos", "column"))).alias("key"))
    links = fk.groupBy("table_fqn", "fk_id", "parent_fqn").agg(
        F.sort_array(F.collect_list(F.struct("pos", F.col("child_column").alias("child"),
                                             F.col("parent_column").alias("parent")))).alias("pairs"))
    child_names = F.array_join(F.transform("pairs", lambda x: enc(x["child"])), ";")
    link = pom_struct(predicate=F.concat(iri, F.lit("#ref-"), child_names), om_type=F.lit("parentJoin"),
               parent_map=map_id(F.col("parent_fqn")),
               join=F.transform("pairs", lambda x: F.struct(x["child"].alias("child"), x["parent"].alias("parent"))))
    links = links.groupBy("table_fqn").agg(F.sort_array(F.collect_list(F.struct("fk_id", link.alias("pom")))).alias("links"))
    rows = props.join(keys, "table_fqn", "left").join(links, "table_fqn", "left")
    subject = F.transform(F.coalesce("key", "all_columns"), lambda x: F.concat(
        enc(x["column"]), F.lit("={"), x["column"], F.lit("}")))
    own = F.transform("literals", lambda x: x["pom"])
    poms = F.when(F.col("links").isNull(), own).otherwise(F.concat(own, F.transform("links", lambda x: x["pom"])))
    return rows.select(map_id(F.col("table_fqn")).alias("map_id"), F.lit("tableName").alias("source_type"),
                       F.col("table_fqn").alias("source"),
                       F.concat(iri, F.lit("/"), F.array_join(subject, ";")).alias("s_template"),
                       F.lit("").alias("s_column"), F.array(iri).alias("s_classes"), F.lit("").alias("graph"),
                       poms.alias("poms"), F.array().cast("array<string>").alias("problems"), F.lit(False).alias("has_stubs"))


def validate_mapping(mapping: DataFrame, columns: DataFrame) -> DataFrame:
    """(map_id, problem, detail): what would keep the mapping from being read.

    Checks that the logical table and subject are there, that the table exists, and that every
    column used by a template, column, or join exists in its table.
    """
    mapping = materialize(mapping)  # read several times below
    missing = mapping.select("map_id", F.explode(F.array(
        F.when((F.col("source_type") == "unknown") | (F.coalesce("source", F.lit("")) == ""), F.lit("no logical table")),
        F.when((F.coalesce("s_template", F.lit("")) == "") & (F.coalesce("s_column", F.lit("")) == ""), F.lit("no subject"))
    )).alias("problem")).where("problem IS NOT NULL").withColumn("detail", F.lit(""))
    tables = columns.select(F.col("table_fqn").alias("source")).distinct()
    named = mapping.where("source_type = 'tableName' AND source <> ''")
    unknown = named.join(tables, "source", "left_anti").select("map_id", F.lit("no such table").alias("problem"),
                                                               F.col("source").alias("detail"))
    slots = r"\{((?:[^{}\\]|\\.)+)\}"

    def in_template(t: Column) -> Column:
        return F.transform(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(slots), F.lit(1)),
                           lambda c: F.regexp_replace(c, r"\\(.)", "$1"))

    own = F.concat(in_template(F.col("s_template")), F.array(F.coalesce("s_column", F.lit(""))),
                   F.flatten(F.transform("poms", lambda p: F.concat(
                       F.array(F.coalesce(p["column"], F.lit(""))), in_template(p["template"]),
                       F.coalesce(F.transform(p["join"], lambda j: j["child"]), F.array().cast("array<string>"))))))
    used = named.select("map_id", "source", F.explode(own).alias("name")).where("name <> ''")
    parents = mapping.select(F.col("map_id").alias("parent_map"), "source").where("source <> ''")
    far = mapping.select("map_id", F.explode("poms").alias("pom")).where("pom.om_type = 'parentJoin'")
    far = far.select("map_id", F.col("pom.parent_map").alias("parent_map"), F.col("pom.join").alias("pairs"))
    orphans = far.join(parents, "parent_map", "left_anti").select(
        "map_id", F.lit("no such parent map").alias("problem"), F.col("parent_map").alias("detail"))
    far = far.select("map_id", "parent_map", F.explode("pairs").alias("pair")).join(
        mapping.where("source_type = 'tableName'").select(F.col("map_id").alias("parent_map"), "source"), "parent_map")
    used = used.union(far.select("map_id", "source", F.col("pair.parent").alias("name"))).distinct()
    known = columns.select(F.col("table_fqn").alias("source"), "name").distinct()
    absent = used.join(tables, "source", "left_semi").join(known, ["source", "name"], "left_anti").select(
        "map_id", F.lit("no such column").alias("problem"), F.concat_ws(".", "source", "name").alias("detail"))
    return missing.union(unknown).union(orphans).union(absent)
