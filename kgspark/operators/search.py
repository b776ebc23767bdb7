"""Search and description of ontology terms, for many queries at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.session import materialize
from kgspark.terms import OWL, RDF, RDFS

# Which statements are searched, shown, and count as declarations.
ANNOTATIONS = [str(RDFS.label), str(RDFS.comment)]
SCHEMA = [str(p) for p in (RDFS.domain, RDFS.range, RDFS.subClassOf, RDFS.subPropertyOf, OWL.inverseOf)]
SHOWN = [str(RDF.type), *ANNOTATIONS, *SCHEMA]
DECLARATIONS = [str(t) for t in (OWL.Class, OWL.ObjectProperty, OWL.DatatypeProperty, OWL.AnnotationProperty,
                                 OWL.Ontology, RDFS.Class, RDF.Property)]
CLASS_TYPES = [str(OWL.Class), str(RDFS.Class)]
PROPERTY_TYPES = [str(RDF.Property), str(OWL.DatatypeProperty), str(OWL.ObjectProperty)]

WORD_WEIGHT, PART_WEIGHT = 0.95, 0.9  # of shared words, and of a part of a text
GRAMS = (3, 2, 1)  # sizes of grams in the index


def search_index(tbox: DataFrame) -> DataFrame:
    """(iri, text): trimmed labels and comments; a declared term without any has its IRI."""
    notes = tbox.where(F.col("p").isin(ANNOTATIONS) & (F.col("o_kind") == "literal"))
    # every kind of white space, as a text's ends may be line breaks
    text = F.regexp_replace("o", r"^\s+|\s+$", "")
    notes = notes.select(F.col("s").alias("iri"), text.alias("text")).where("text <> ''").distinct()
    declared = tbox.where((F.col("p") == str(RDF.type)) & (F.col("s_kind") == "iri") & (F.col("o_kind") == "iri")
                          & F.col("o").isin(DECLARATIONS)).select(F.col("s").alias("iri")).distinct()
    bare = declared.join(notes.select("iri").distinct(), "iri", "left_anti")
    return notes.union(bare.select("iri", F.col("iri").alias("text")))


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, " "), lambda x: x != ""))


def _edit(query: Column, text: Column) -> Column:
    longest = F.greatest(F.length(query), F.length(text)).cast("double")
    return F.lit(1.0) - F.levenshtein(query, text) / longest


def score(query: Column, query_tokens: Column, text: Column, text_tokens: Column) -> Column:
    """0 to 100: the better of edit similarity and 95 % of the shared share of words."""
    shared = F.size(F.array_intersect(query_tokens, text_tokens)).cast("double")
    fewest = F.least(F.size(query_tokens), F.size(text_tokens))
    words = F.when(fewest > 0, shared / fewest).otherwise(F.lit(0.0))
    return F.round(F.lit(100.0) * F.greatest(_edit(query, text), F.lit(WORD_WEIGHT) * words), 4)


def _grams(text: Column, size: int) -> Column:
    """The strings of ``size`` characters in a text, as hashes of the string and of how many equal ones are before it
    in the text. (Where hashes agree by chance, a text is scored in vain.)"""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1))).otherwise(F.array().cast("array<int>"))
    found = F.array(F.array_sort(F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))))
    # Sorted and held once: the place among equal ones is the distance from the first of them.
    return F.transform(found, lambda held: F.transform(held, lambda x, i: F.xxhash64(x, i - F.array_position(held, x).cast("int"))))[0]


def _ranked(items: Column, frequency: Column, by: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(frequency, items))


def _best(scored: DataFrame, limit: int) -> DataFrame:
    """(query, iri, score, rank): the best IRIs of each query by their best texts, of rows (query, score, iris)."""
    best = (scored.select("query", "score", F.explode("iris").alias("iri"))
            .groupBy("query", "iri").agg(F.max("score").alias("score")))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "iri"))
    return best.withColumn("rank", rank).where(F.col("rank") <= limit)


class _Search:
    """The tables of a search. ``texts``: text, its words and its ``limit`` least IRIs; ``forms``: what is compared with
    a query by edits, whole texts and, for parts of texts, runs of words; ``grams`` and ``words``: inverted indexes."""

    def __init__(self, queries: DataFrame, index: DataFrame, limit: int, ignore_case: bool, partial: bool):
        fold = F.lower if ignore_case else (lambda c: c)
        asked = queries.select(F.trim("query").alias("query")).where("query <> ''").distinct()
        q = fold(F.col("query"))
        self.limit, self.partial = limit, partial
        self.asked = materialize(asked.select("query", q.alias("q"), _tokens(q).alias("q_words")).select(
            "*", F.length("q").alias("q_length"), F.size("q_words").alias("q_size"),
            F.size(F.filter(F.split("q", " "), lambda x: x != "")).alias("q_run")))
        terms = index.select("iri", fold(F.col("text")).alias("text")).distinct()
        # A text stands for its least IRIs only: more cannot be among the best through that text.
        place = F.row_number().over(Window.partitionBy("text").orderBy("iri"))
        kept = terms.withColumn("place", place).where(F.col("place") <= limit)
        texts = kept.groupBy("text").agg(F.sort_array(F.collect_list("iri")).alias("iris"))
        self.texts = materialize(texts.select("text", "iris", _tokens(F.col("text")).alias("words")))
        # Where no query has runs of so many words, there is nothing to cut.
        runs = sorted(r[0] for r in self.asked.select("q_run").distinct().collect()) if partial else []
        words = F.filter(F.split("text", " "), lambda x: x != "")
        whole = self.texts.select("text", F.col("text").alias("form"), F.lit(0).alias("run"))
        cut = [self.texts.select("text", words.alias("w")).where(F.size("w") > n).select("text", F.explode(F.transform(
            F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))).alias("form"), F.lit(n).alias("run"))
            for n in runs]
        self.parts = reduce(DataFrame.union, cut, whole).distinct() if cut else whole
        if cut:
            self.parts = materialize(self.parts)
        self._grams: dict[int, tuple[DataFrame, DataFrame]] = {}
        word = self.texts.select("text", F.size("words").alias("size"), F.explode("words").alias("word"))
        often = word.groupBy("word").agg(F.count("*").alias("often"))
        self.words = materialize(word.join(often, "word").withColumn("place", _ranked(F.col("word"), F.col("often"), ["text"])))
        word_of = self.asked.select("query", "q_size", F.explode("q_words").alias("word"))
        self.asked_words = (
            word_of.join(self.words.select("word", "often").distinct(), "word", "left").fillna(0, ["often"]).withColumn("place", _ranked(F.col("word"), F.col("often"), ["query"])))

    def grams(self, size: int) -> tuple[DataFrame, DataFrame]:
        """The forms of each gram of a size, and the grams of each query from the rarest on; made when they are asked for."""
        if size not in self._grams:
            forms = self.parts.select("form", "run").distinct()
            index = materialize(forms.select("form", "run", F.length("form").alias("length"), F.explode(_grams(F.col("form"), size)).alias("gram")))
            mine = self.asked.select("query", "q_length", "q_run", F.explode(_grams(F.col("q"), size)).alias("gram"))
            seen = index.join(mine.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("often"))
            asked = mine.join(seen, "gram", "left").fillna(0, ["often"]).withColumn("place", _ranked(F.col("gram"), F.col("often"), ["query"]))
            self._grams[size] = index, materialize(asked)
        return self._grams[size]

    def scored(self, pairs: DataFrame) -> DataFrame:
        """(query, score, iris) of distinct pairs of a query and a text."""
        met = pairs.join(self.asked, "query").join(self.texts, "text")
        value = score(F.col("q"), F.col("q_words"), F.col("text"), F.col("words"))
        if self.partial:
            all_words = F.filter(F.split("text", " "), lambda x: x != "")
            n = F.col("q_run")
            runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(all_words) - n + 1, F.lit(1))), lambda i: _edit(
                F.col("q"), F.array_join(F.slice(all_words, i, n), " ")))
            value = F.greatest(value, F.when(F.size(all_words) > n, F.round(F.lit(100.0 * PART_WEIGHT) * F.array_max(runs), 4)).otherwise(0.0))
        return met.select("query", value.alias("score"), "iris")

    def _of_texts(self, hits: DataFrame) -> DataFrame:
        """(query, text) of pairs of a query and a form."""
        if not self.partial:
            return hits.select("query", F.col("form").alias("text")).distinct()
        return hits.join(self.parts, ["form", "run"]).select("query", "text").distinct()

    def seeds(self) -> DataFrame:
        """Some pairs that are likely to score high: forms of about the length of the query that share most grams
        of three letters with it, and texts that share most words. What is left out here is met later, if it counts."""
        some = lambda often, n, c: F.pmod(F.xxhash64(c), F.ceil(F.col(often) / n)) == 0
        of_length, asked_grams = self.grams(GRAMS[0])
        n_of = of_length.groupBy("gram", "length", "run").agg(F.count("*").alias("here"))
        probe = (asked_grams.where("often > 0")
                 .select("query", "gram", "q_run", F.explode(F.array(*[F.col("q_length") + d for d in (-1, 0, 1)])).alias("length")))
        if self.partial:
            probe = probe.select("query", "gram", "length", F.explode(F.array(F.lit(0), F.col("q_run"))).alias("run"))
        else:
            probe = probe.select("query", "gram", "length", F.lit(0).alias("run"))
        hits = (probe.join(n_of, ["gram", "length", "run"]).join(of_length, ["gram", "length", "run"]).where(some("here", 64, "form"))
                .groupBy("query", "form", "run").agg(F.count("*").alias("shared")))
        near = hits.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("shared"), "form"))).where("k <= 12")
        words = (self.asked_words.where("often > 0").select("query", "word", "often").join(self.words.drop("often", "place"), "word")
                 .where(some("often", 256, "text")).groupBy("query", "text", "size").agg(F.count("*").alias("shared")))
        like = words.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy(
            F.desc(F.col("shared") / F.col("size")), F.desc("shared"), "text"))).where("k <= 12")
        return self._of_texts(near).union(like.select("query", "text")).distinct()

    def candidates(self, bound: DataFrame) -> tuple[DataFrame, DataFrame]:
        """All (query, text) whose score may reach the bound of the query; and queries whose bound is 0."""
        b = self.asked.join(bound, "query", "left").select(
            "query", "q_length", "q_size", "q_run", F.greatest(F.coalesce(F.col("bound"), F.lit(0.0)) - 0.001, F.lit(0.0)).alias("bound"))
        hits = []
        for run, weight in ((False, 1.0), *([(True, PART_WEIGHT)] if self.partial else [])):
            # With L the longer length and at most (1 - least) L edits, two texts share so many grams at least.
            least = F.col("bound") / (100 * weight)
            need = {g: F.ceil(F.col("q_length") * (1 - g * (1 - least)) - g + 1 - 0.0001) for g in GRAMS}
            choice = F.when(least > 1, F.lit(0))
            for g in GRAMS:
                choice = choice.when(need[g] >= 1, F.lit(g))
            chosen = b.where("bound > 0").withColumns({"g": choice, "least": least})
            for g in sorted(r[0] for r in chosen.select("g").distinct().collect() if r[0]):
                index, asked_grams = self.grams(g)
                probe = (chosen.where(F.col("g") == g).select("query", "least", need[g].alias("need")).join(asked_grams, "query")
                         .where((F.col("place") <= F.col("q_length") - g + 1 - F.col("need") + 1) & (F.col("often") > 0))
                         .select("query", "gram", "q_length", "q_run", "least"))
                fits = ((F.col("length") >= F.col("q_length") * F.col("least") - 0.0001) & (F.col("q_length") >= F.col("length") * F.col("least") - 0.0001)
                        & (F.col("run") == (F.col("q_run") if run else F.lit(0))))
                hits.append(self._of_texts(probe.join(index, "gram").where(fits).select("query", "form", "run").distinct()))
        # Of the words of the smaller side so many must be shared; one of the rarest others of that side is among them.
        a, t = self.asked_words.alias("a"), self.words.alias("t")
        shared = lambda n: F.ceil(F.col("bound") / (100 * WORD_WEIGHT) * n - 0.0001)
        enough = F.when(F.col("t.size") >= F.col("a.q_size"), F.col("a.place") <= F.col("a.q_size") - shared(F.col("a.q_size")) + 1).otherwise(
            F.col("t.place") <= F.col("t.size") - shared(F.col("t.size")) + 1)
        by_word = (a.join(b.where(f"bound > 0 AND bound <= {100 * WORD_WEIGHT}").select("query", "bound"), "query")
                   .join(t, F.col("a.word") == F.col("t.word")).where(enough).select("query", "t.text").distinct())
        return reduce(DataFrame.union, [*hits, by_word]).distinct(), b.where("bound = 0").select("query")

    def every(self, queries: DataFrame) -> DataFrame:
        """All texts for some queries, spread over the tasks whichever side is copied."""
        slots = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        left = queries.select("query", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
        right = self.texts.select("text", F.pmod(F.xxhash64("text"), F.lit(slots)).cast("int").alias("slot"))
        return left.join(right, "slot").select("query", "text")


def fuzzy_search(queries: DataFrame, index: DataFrame, limit: int = 10, ignore_case: bool = False,
                 partial: bool = False) -> DataFrame:
    """The best ``max(1, limit)`` IRIs of every query: (query, iri, score, rank).

    Exact, without comparing all texts: a few likely texts of each query are scored first. The score of its
    ``limit``-th best IRI is a bound, and only texts that can reach it are scored: those of a length and with a
    number of shared grams that allow so few edits, found by the rarest grams of the query; and those that
    share enough words, found by the rarest words of the smaller side. The lower the bound, the shorter the grams. Only
    queries that share nothing with ``limit`` IRIs meet all texts.

    ``partial``: also counts 90 % of the edit similarity with the best run of as many words as the query has.
    """
    s = _Search(queries, index, max(1, limit), ignore_case, partial)
    seeds = s.scored(s.seeds())
    bound = materialize(_best(seeds, s.limit).where(F.col("rank") == s.limit).select("query", F.col("score").alias("bound")))
    pairs, rest = s.candidates(bound)
    scored = s.scored(pairs)
    if not rest.isEmpty():
        scored = scored.union(s.scored(s.every(rest)))
    return _best(scored, s.limit)


def expand_terms(hits: DataFrame, tbox: DataFrame) -> DataFrame:
    """Type, label, comment and schema statements of the hits (column ``iri``)."""
    wanted = hits.select(F.col("iri").alias("s")).distinct()
    return tbox.where(F.col("p").isin(SHOWN)).join(wanted, "s", "left_semi").select(*tbox.columns).distinct()


def describe_terms(iris: DataFrame, tbox: DataFrame) -> DataFrame:
    """Statements about the IRIs, schema statements that point at them, and what those subjects are."""
    cols = tbox.columns
    wanted = iris.select(F.col("iri")).distinct()
    out = tbox.join(wanted.withColumnRenamed("iri", "s"), "s", "left_semi").select(*cols)
    schema = tbox.where(F.col("p").isin(SCHEMA) & (F.col("o_kind") == "iri"))
    incoming = schema.join(wanted.withColumnRenamed("iri", "o"), "o", "left_semi").select(*cols)
    about = tbox.where(F.col("p").isin([str(RDF.type)]) | (F.col("p").isin(ANNOTATIONS) & (F.col("o_kind") == "literal")))
    notes = about.join(incoming.select("s").distinct(), "s", "left_semi").select(*cols)
    return out.union(incoming).union(notes).distinct()


def term_index(ontologies: DataFrame) -> DataFrame:
    """(kind, iri): classes and properties of the active ontologies, distinct and sorted.

    ``ontologies``: triples with a column ``active``.
    """
    types = ontologies.where((F.col("p") == str(RDF.type)) & F.col("active"))
    kinds = F.array(F.when(F.col("o").isin(CLASS_TYPES), F.lit("class")),
                    F.when(F.col("o").isin(PROPERTY_TYPES), F.lit("property")))
    rows = types.select(F.explode(kinds).alias("kind"), F.col("s").alias("iri")).where("kind IS NOT NULL")
    return rows.distinct().orderBy("kind", "iri")
