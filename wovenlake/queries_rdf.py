"""Queries of graph patterns, query forms, rule closures and shapes over quads made from the driver tables.

Quads: a nation is in a region (graph of the region), a customer has a nation, a segment and a balance (default graph).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import terms
from .operators import mutations, paths, patterns, reasoning, relational, shapes
from .registry import Registry
from .sources.readers import table

query = Registry()

IN_REGION, NATION, SEGMENT, BALANCE = "<urn:inRegion>", "<urn:nation>", "<urn:segment>", "<urn:balance>"
#: customers, nations and regions as SQL terms
_C, _N, _R = "'<urn:customer:' || c_custkey || '>'", "'<urn:nation:' || n_nationkey || '>'", "'<urn:region:' || r_regionkey || '>'"
_CN, _NR = "'<urn:nation:' || c_nationkey || '>'", "'<urn:region:' || n_regionkey || '>'"
_SEG = "'\"' || c_mktsegment || '\"'"


def quads(spark: SparkSession, d: str) -> DataFrame:
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    region = n.select(terms.iri("urn:nation:", F.col("n_nationkey")).alias("s"), F.lit(IN_REGION).alias("p"), terms.iri("urn:region:", F.col("n_regionkey")).alias("o"), terms.iri("urn:graph:", F.col("n_regionkey")).alias("g"))
    facts = F.array(
        F.struct(F.lit(NATION).alias("p"), terms.iri("urn:nation:", F.col("c_nationkey")).alias("o")),
        F.struct(F.lit(SEGMENT).alias("p"), terms.literal(F.col("c_mktsegment")).alias("o")),
        F.struct(F.lit(BALANCE).alias("p"), terms.literal(F.col("c_acctbal"), f"{terms.XSD}double").alias("o")),
    )
    people = c.select(terms.iri("urn:customer:", F.col("c_custkey")).alias("s"), F.explode(facts).alias("x")).select("s", "x.p", "x.o", F.lit(None).cast("string").alias("g"))
    return region.unionByName(people)


@query(f"SELECT {_C} AS c, {_CN} AS n, {_NR} AS r FROM customer JOIN nation ON c_nationkey = n_nationkey")
def sparql_bgp(spark: SparkSession, d: str) -> DataFrame:
    """{ ?c urn:nation ?n . ?n urn:inRegion ?r }"""
    return patterns.basic(quads(spark, d), [("?c", NATION, "?n"), ("?n", IN_REGION, "?r")])


@query(f"SELECT {_C} AS c FROM customer WHERE c_acctbal > 9000 AND c_mktsegment LIKE 'B%'")
def sparql_filter(spark: SparkSession, d: str) -> DataFrame:
    q = quads(spark, d)
    rows = patterns.basic(q, [("?c", BALANCE, "?b"), ("?c", SEGMENT, "?s")])
    return patterns.keep(rows, (terms.number(F.col("b")) > 9000) & terms.regex(F.col("s"), "^B")).select("c")


@query(f"SELECT {_C} AS c, {_CN} AS n, NULL AS s FROM customer UNION ALL SELECT {_C}, {_CN}, NULL FROM customer UNION ALL SELECT {_C}, NULL, {_SEG} FROM customer WHERE c_mktsegment = 'BUILDING'")
def sparql_union(spark: SparkSession, d: str) -> DataFrame:
    q = quads(spark, d)
    a, b = patterns.match(q, "?c", NATION, "?n"), patterns.match(q.filter(F.col("o") == '"BUILDING"'), "?c", SEGMENT, "?s")
    return patterns.union(a, a, b)


@query("SELECT TRUE AS answer UNION ALL SELECT FALSE UNION ALL SELECT FALSE")
def sparql_ask(spark: SparkSession, d: str) -> DataFrame:
    """ASK, ASK with an OFFSET past the end, and ASK with LIMIT 0."""
    q = patterns.match(quads(spark, d), "?n", IN_REGION, "?r")
    return patterns.ask(q).union(patterns.ask(relational.limited(q, offset=25))).union(patterns.ask(relational.limited(q, limit=0)))


@query(f"SELECT {_NR} AS r, count(*) AS n FROM nation GROUP BY n_regionkey HAVING count(*) > 1")
def sparql_having(spark: SparkSession, d: str) -> DataFrame:
    return patterns.match(quads(spark, d), "?n", IN_REGION, "?r").groupBy("r").agg(F.count("n").alias("n")).filter("n > 1")


@query(f"SELECT {_N} AS n, {_NR} AS r FROM nation WHERE n_nationkey IN (3, 5)")
def sparql_values(spark: SparkSession, d: str) -> DataFrame:
    v = patterns.values(spark, ["?n"], [["<urn:nation:3>"], ["<urn:nation:5>"], ["<urn:nation:none>"]])
    return patterns.compatible_join(patterns.match(quads(spark, d), "?n", IN_REGION, "?r"), v)


@query(f"SELECT {_C} AS c, {_SEG} AS s FROM customer WHERE c_custkey IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, {_C} LIMIT 5)")
def sparql_subselect(spark: SparkSession, d: str) -> DataFrame:
    """The inner ORDER BY and LIMIT come first, and only its projected variable is seen outside."""
    q = quads(spark, d)
    inner = relational.limited(patterns.match(q, "?c", BALANCE, "?b").orderBy(terms.number(F.col("b")).desc(), "c"), 5).select("c")
    return patterns.compatible_join(inner, patterns.match(q, "?c", SEGMENT, "?s"))


@query(f"SELECT n, c FROM (SELECT {_CN} AS n, {_C} AS c, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, {_C}) AS k FROM customer) WHERE k <= 2")
def sparql_lateral(spark: SparkSession, d: str) -> DataFrame:
    rows = patterns.basic(quads(spark, d), [("?c", NATION, "?n"), ("?c", BALANCE, "?b")])
    return patterns.first_per_group(rows, ["n"], [terms.number(F.col("b")).desc(), F.asc("c")], 2).select("n", "c")


@query(f"SELECT {_N} AS n, {_NR} AS r FROM nation WHERE n_regionkey IN (1, 2)")
def sparql_dataset(spark: SparkSession, d: str) -> DataFrame:
    """FROM two graphs: their merge without repeated triples is the default graph."""
    q = quads(spark, d)
    ds = patterns.dataset(q.unionByName(q.filter("g = '<urn:graph:1>'").withColumn("g", F.lit("<urn:graph:2>"))), ["<urn:graph:1>", "<urn:graph:2>"])
    return patterns.match(patterns.default_graph(ds), "?n", IN_REGION, "?r")


@query(f"SELECT {_N} AS n, '<urn:graph:' || n_regionkey || '>' AS g FROM nation")
def sparql_graph_var(spark: SparkSession, d: str) -> DataFrame:
    return patterns.match(patterns.named(quads(spark, d), "?g"), "?n", IN_REGION, "?r", "?g").select("n", "g")


@query(f"SELECT {_C} AS c, CASE WHEN c_acctbal > 8000 THEN '\"' || c_mktsegment || '\"' END AS s FROM customer")
def sparql_optional(spark: SparkSession, d: str) -> DataFrame:
    """Extension: OPTIONAL { ?c urn:segment ?s } for rich customers only."""
    q = quads(spark, d)
    rich = patterns.keep(patterns.match(q, "?c", BALANCE, "?b"), terms.number(F.col("b")) > 8000).select("c")
    return patterns.compatible_join(patterns.match(q, "?c", NATION, "?n").select("c"), patterns.compatible_join(rich, patterns.match(q, "?c", SEGMENT, "?s")), optional=True)


@query(f"SELECT {_C} AS c FROM customer WHERE c_mktsegment <> 'BUILDING'")
def sparql_minus(spark: SparkSession, d: str) -> DataFrame:
    """Extension: MINUS."""
    q = quads(spark, d)
    return patterns.minus(patterns.match(q, "?c", NATION, "?n").select("c"), patterns.match(q, "?c", SEGMENT, '"BUILDING"'))


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def sql_sparql_in(spark: SparkSession, d: str) -> DataFrame:
    """SQL rows whose key is among a pattern's solutions: a semi join."""
    found = patterns.basic(quads(spark, d), [("?c", NATION, "?n"), ("?n", IN_REGION, "<urn:region:2>")])
    keys = found.select(F.regexp_extract("c", r"^<urn:customer:(\d+)>$", 1).cast("long").alias("c_custkey"))
    return table(spark, d, "customer").join(keys, "c_custkey", "left_semi").select("c_custkey")


@query(f"""SELECT {_C} AS s, '<urn:livesIn>' AS p, {_NR} AS o, NULL AS g FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION SELECT {_NR}, '<urn:has>', '"' || c_mktsegment || '"', NULL FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def sparql_construct(spark: SparkSession, d: str) -> DataFrame:
    rows = patterns.basic(quads(spark, d), [("?c", NATION, "?n"), ("?n", IN_REGION, "?r"), ("?c", SEGMENT, "?s")])
    return patterns.construct(rows.withColumn("unbound", F.lit(None).cast("string")), [("?c", "<urn:livesIn>", "?r"), ("?r", "<urn:has>", "?s"), ("?c", "<urn:none>", "?unbound")])


@query("SELECT 2 * count(*) AS n, 2 * count(*) AS n_blank FROM nation")
def sparql_construct_blank(spark: SparkSession, d: str) -> DataFrame:
    """A fresh node for each solution, equal solutions too."""
    a = patterns.match(quads(spark, d), "?n", IN_REGION, "?r")
    out = patterns.construct(patterns.union(a, a), [("_:x", "<urn:of>", "?r")], "request")
    return out.agg(F.count("*").alias("n"), F.count_distinct("s").alias("n_blank"))


@query(f"SELECT {_N} AS s, '<urn:inRegion>' AS p, {_NR} AS o, '<urn:graph:' || n_regionkey || '>' AS g FROM nation WHERE n_nationkey = 4 OR n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey < 10)")
def sparql_describe(spark: SparkSession, d: str) -> DataFrame:
    q = quads(spark, d)
    found = patterns.match(q, "?c", NATION, "?n").join(table(spark, d, "customer").filter("c_custkey < 10").select(terms.iri("urn:customer:", F.col("c_custkey")).alias("c")), "c", "left_semi")
    return patterns.describe(q, found, ["?n"], ["<urn:nation:4>"])


@query(f"""SELECT s, o FROM (SELECT {_C} AS s, {_CN} AS o FROM customer UNION SELECT {_C}, {_NR} FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE s IN (SELECT {_C} FROM customer WHERE c_mktsegment = 'BUILDING')""")
def sparql_path(spark: SparkSession, d: str) -> DataFrame:
    """(urn:nation|urn:inRegion)+ from the customers of a segment."""
    q = quads(spark, d)
    up = q.filter(F.col("p").isin(NATION, IN_REGION)).withColumn("p", F.lit("<urn:up>"))
    return patterns.path_closure(up, "<urn:up>", patterns.match(q, "?s", SEGMENT, '"BUILDING"'))


@query(f"SELECT {_C} AS s, {_NR} AS o FROM customer JOIN nation ON c_nationkey = n_nationkey")
def sparql_path_sequence(spark: SparkSession, d: str) -> DataFrame:
    """urn:nation/urn:inRegion"""
    q = quads(spark, d)
    return paths.sequence(paths.link(q, NATION), paths.link(q, IN_REGION))


@query("SELECT '<urn:nation:' || a.n_nationkey || '>' AS s, '<urn:nation:' || b.n_nationkey || '>' AS o FROM nation a JOIN nation b USING (n_regionkey)")
def sparql_path_inverse(spark: SparkSession, d: str) -> DataFrame:
    """urn:inRegion/^urn:inRegion"""
    up = paths.link(quads(spark, d), IN_REGION)
    return paths.sequence(up, paths.inverse(up))


_PLACES = f"""links AS (SELECT {_C} AS s, {_CN} AS o FROM customer UNION SELECT {_N}, {_NR} FROM nation),
    self AS (SELECT s, s AS o FROM links UNION SELECT o, o FROM links)"""


@query(f"WITH {_PLACES} SELECT s, o FROM self UNION SELECT s, o FROM links UNION SELECT a.s, b.o FROM links a JOIN links b ON a.o = b.s")
def sparql_path_star(spark: SparkSession, d: str) -> DataFrame:
    """(urn:nation|urn:inRegion)* over the nodes of these links."""
    q = quads(spark, d)
    up = paths.alternative(paths.link(q, NATION), paths.link(q, IN_REGION))
    return paths.zero_or_more(up, paths.nodes(up))


@query(f"WITH {_PLACES} SELECT s, o FROM self UNION SELECT s, o FROM links")
def sparql_path_optional(spark: SparkSession, d: str) -> DataFrame:
    """(urn:nation|urn:inRegion)? over the nodes of these links."""
    q = quads(spark, d)
    up = paths.alternative(paths.link(q, NATION), paths.link(q, IN_REGION))
    return paths.zero_or_one(up, paths.nodes(up))


def _members(spark: SparkSession, d: str) -> DataFrame:
    q = patterns.match(quads(spark, d), "?s", IN_REGION, "?o").withColumn("o", F.when(F.col("o") == "<urn:region:0>", F.lit("_:r0")).otherwise(F.col("o")))
    return relational.union_members({"primary": q, "secondary": q.filter("s like '%1>'")})


@query(f"""SELECT {_N} AS s, CASE WHEN n_regionkey = 0 THEN '_:' || b || '.r0' ELSE {_NR} END AS o, array_to_string(list_sort(list(b)), ',') AS origins, count(*) > 1 AS derived
    FROM nation, (VALUES ('primary'), ('secondary')) t(b) WHERE b = 'primary' OR n_nationkey % 10 = 1 GROUP BY 1, 2""")
def composition_construct(spark: SparkSession, d: str) -> DataFrame:
    """Union of the graphs of two Bases: equal quads merge, equal blank labels stay apart."""
    m = _members(spark, d)
    own = F.when(terms.is_blank(F.col("o")), F.concat(F.lit("_:"), "base_id", F.lit("."), F.substring("o", 3, 100))).otherwise(F.col("o"))
    return relational.distinct_with_contributors(m.withColumn("o", own)).withColumn("origins", F.array_join("origins", ","))


@query("SELECT DISTINCT CASE WHEN n_regionkey = 0 THEN '_:' || b || '.r0' ELSE '<urn:region:' || n_regionkey || '>' END AS o FROM nation, (VALUES ('primary'), ('secondary')) t(b) WHERE b = 'primary' OR n_nationkey % 10 = 1")
def composition_sparql_distinct(spark: SparkSession, d: str) -> DataFrame:
    m = _members(spark, d)
    return m.select(F.when(terms.is_blank(F.col("o")), F.concat(F.lit("_:"), "base_id", F.lit("."), F.substring("o", 3, 100))).otherwise(F.col("o")).alias("o")).distinct()


@query(f"SELECT {_C} AS c, c_acctbal AS value, 'double' AS kind FROM customer")
def xsd_cast(spark: SparkSession, d: str) -> DataFrame:
    b = patterns.match(quads(spark, d), "?c", BALANCE, "?b")
    return b.select("c", terms.xsd_cast(F.col("b"), "double").alias("value"), F.regexp_extract(terms.datatype(F.col("b")), "#([a-z]+)>$", 1).alias("kind"))


@query("""SELECT 1 AS deleted, 25 AS inserted, count(*) + 24 AS total FROM (SELECT n_nationkey FROM nation UNION ALL SELECT c_custkey FROM customer UNION ALL SELECT c_custkey FROM customer UNION ALL SELECT c_custkey FROM customer)""")
def sparql_update(spark: SparkSession, d: str) -> DataFrame:
    """DELETE/INSERT WHERE: templates are filled from the old state, deletion comes first."""
    q = quads(spark, d)
    found = patterns.match(q, "?n", IN_REGION, "?r")
    gone = q.filter("s = '<urn:nation:3>' and p = '<urn:inRegion>'")
    new, deleted, inserted = mutations.modify(q, gone, patterns.construct(found, [("?r", "<urn:contains>", "?n")]))
    n = lambda df, c: df.agg(F.count("*").alias(c))
    return n(deleted, "deleted").withColumn("deleted", F.col("deleted").cast("int")).join(n(inserted, "inserted").withColumn("inserted", F.col("inserted").cast("int"))).join(n(new, "total"))


@query("SELECT '<urn:graph:' || g || '>' AS g, count(*) AS n FROM (SELECT CASE n_regionkey WHEN 1 THEN 9 ELSE n_regionkey END AS g FROM nation WHERE n_regionkey <> 0 UNION ALL SELECT 2 FROM nation WHERE n_regionkey = 0) WHERE g <> 3 GROUP BY 1 UNION ALL SELECT '<urn:graph:0>', count(*) FROM nation WHERE n_regionkey = 0")
def graph_transfer(spark: SparkSession, d: str) -> DataFrame:
    """MOVE graph 1 to 9, ADD graph 0 to 2, CLEAR graph 3."""
    q = quads(spark, d).filter("g is not null")
    g = lambda k: f"<urn:graph:{k}>"
    out = mutations.clear(mutations.transfer(mutations.transfer(q, g(1), g(9), "move"), g(0), g(2), "add"), g(3))
    return out.groupBy("g").agg(F.count("*").alias("n"))


# ---- ontology -------------------------------------------------------------------------------------------------

AGENT, CUSTOMER, PLACE = "<urn:Agent>", "<urn:Customer>", "<urn:Place>"
_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def ontology(spark: SparkSession) -> DataFrame:
    rows = [(f"<urn:class:{s}>", terms.SUBCLASS, CUSTOMER) for s in _SEGMENTS]
    rows += [(CUSTOMER, terms.SUBCLASS, AGENT), (NATION, terms.DOMAIN, CUSTOMER), (NATION, terms.RANGE, PLACE), (NATION, terms.SUBPROPERTY, "<urn:related>")]
    return spark.createDataFrame(rows, "s string, p string, o string")


def typed(spark: SparkSession, d: str, homeless: bool = False) -> DataFrame:
    """Ontology, segment types and nations of all customers, as triples. homeless: customers of odd keys have no nation,
    so that shapes that ask for one find violations; their other triples stay."""
    c = table(spark, d, "customer")
    who = terms.iri("urn:customer:", F.col("c_custkey"))
    kind = c.select(who.alias("s"), F.lit(terms.TYPE).alias("p"), terms.iri("urn:class:", F.col("c_mktsegment")).alias("o"))
    home = (c.filter("c_custkey % 2 = 0") if homeless else c).select(who.alias("s"), F.lit(NATION).alias("p"), terms.iri("urn:nation:", F.col("c_nationkey")).alias("o"))
    return ontology(spark).unionByName(kind).unionByName(home)


@query(f"""SELECT {_C} AS s, '{terms.TYPE}' AS p, o FROM customer, (VALUES ('{CUSTOMER}'), ('{AGENT}')) t(o)
    UNION SELECT {_C}, '<urn:related>', {_CN} FROM customer UNION SELECT {_CN}, '{terms.TYPE}', '{PLACE}' FROM customer
    UNION SELECT '<urn:class:' || x || '>', '{terms.SUBCLASS}', '{AGENT}' FROM (VALUES {", ".join(f"('{s}')" for s in _SEGMENTS)}) t(x)
    UNION SELECT '{NATION}', '{terms.DOMAIN}', '{AGENT}'""")
def rdfs_closure(spark: SparkSession, d: str) -> DataFrame:
    return reasoning.closure(typed(spark, d))


@query(f"""SELECT iri, depth FROM (VALUES ('{CUSTOMER}', 1), ('{AGENT}', 2)) t(iri, depth)""")
def class_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return reasoning.hierarchy(ontology(spark), "<urn:class:BUILDING>")


@query(f"""SELECT {_C} AS s, '<urn:within>' AS p, {_NR} AS o FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def owlrl_transitive(spark: SparkSession, d: str) -> DataFrame:
    """A transitive property over customer, nation and region."""
    q = quads(spark, d).filter(F.col("p").isin(NATION, IN_REGION)).select("s", F.lit("<urn:within>").alias("p"), "o")
    rule = spark.createDataFrame([("<urn:within>", terms.TYPE, reasoning.TRANSITIVE)], "s string, p string, o string")
    return reasoning.closure(q.unionByName(rule), reasoning.OWL_RULES[len(reasoning.RDFS_RULES) :], transitive=True)


@query("SELECT iri, revision, depth FROM (VALUES ('urn:calendar', 3, 0), ('urn:people', 2, 1), ('urn:base', 1, 1)) t(iri, revision, depth)")
def import_closure(spark: SparkSession, d: str) -> DataFrame:
    imports = spark.createDataFrame([("urn:calendar", "urn:people"), ("urn:people", "urn:base"), ("urn:calendar", "urn:base"), ("urn:other", "urn:calendar")], "document string, imported string")
    documents = spark.createDataFrame([("urn:calendar", 3), ("urn:people", 2), ("urn:base", 1), ("urn:other", 9)], "iri string, revision int")
    return reasoning.import_closure(imports, documents, "urn:calendar")


@query(f"""SELECT 'UNDECLARED_CLASS' AS code, x AS message FROM (VALUES {", ".join(f"('<urn:class:{s}>')" for s in _SEGMENTS)}, ('{PLACE}')) t(x) UNION ALL SELECT 'UNDECLARED_PROPERTY', '<urn:related>'""")
def ontology_validate(spark: SparkSession, d: str) -> DataFrame:
    declared = spark.createDataFrame([(c, terms.TYPE, f"<{terms.OWL}Class>") for c in (AGENT, CUSTOMER)] + [(NATION, terms.TYPE, f"<{terms.OWL}ObjectProperty>")], "s string, p string, o string")
    return reasoning.undeclared(ontology(spark).unionByName(declared))


@query(f"""SELECT '<urn:customer:' || c_custkey || '>' AS s, p, o, '<urn:data>' AS g FROM (SELECT c_custkey, '{terms.TYPE}' AS p, '<urn:Customer>' AS o FROM customer UNION ALL SELECT c_custkey, '<urn:name>', '"' || c_name || '"' FROM customer)""")
def ontology_projection(spark: SparkSession, d: str) -> DataFrame:
    return reasoning.project_entities(table(spark, d, "customer"), "urn:customer:", CUSTOMER, "c_custkey", {"c_name": "<urn:name>"}, "<urn:data>")


# ---- shapes ---------------------------------------------------------------------------------------------------


def _issue(focus: str, path: str, code: str, value: str, shape: str) -> str:
    return f"SELECT {focus} AS focus, '{path}' AS path, 'sh:{code}ConstraintComponent' AS code, {value} AS value, 'violation' AS severity, '{shape}' AS shape FROM customer"


@query(_issue(_C, NATION, "MinCount", "NULL", "home") + " WHERE c_mktsegment = 'BUILDING' AND c_custkey % 2 = 1")
def shacl_min_count(spark: SparkSession, d: str) -> DataFrame:
    return shapes.validate(typed(spark, d, homeless=True), [shapes.Shape("home", NATION, target_class="<urn:class:BUILDING>", min_count=1)])


@query(_issue(_C, NATION, "Class", _CN, "place"))
def shacl_class(spark: SparkSession, d: str) -> DataFrame:
    return shapes.validate(typed(spark, d), [shapes.Shape("place", NATION, subjects_of=NATION, class_=PLACE)])


@query(_issue(_C, SEGMENT, "MinCount", "NULL", "segment"))
def shacl_subjects_of(spark: SparkSession, d: str) -> DataFrame:
    return shapes.validate(typed(spark, d), [shapes.Shape("segment", SEGMENT, subjects_of=NATION, min_count=1)])


@query(_issue(_C, NATION, "MinCount", "NULL", "home") + " WHERE c_custkey IN (1, 3)")
def shacl_focus(spark: SparkSession, d: str) -> DataFrame:
    only = patterns.values(spark, ["?focus"], [[f"<urn:customer:{k}>"] for k in (1, 2, 3)])
    nodes = tuple(f"<urn:customer:{k}>" for k in range(10))
    return shapes.validate(typed(spark, d, homeless=True), [shapes.Shape("home", NATION, target_nodes=nodes, min_count=1)], only)


@query(_issue(_C, NATION, "MinCount", "NULL", "home") + " WHERE c_custkey % 2 = 1")
def shacl_rdfs(spark: SparkSession, d: str) -> DataFrame:
    """Agents by inference need a nation."""
    return shapes.validate(typed(spark, d, homeless=True), [shapes.Shape("home", NATION, target_class=AGENT, min_count=1)], entailment="rdfs")


@query(" UNION ALL ".join([_issue(_C, BALANCE, "MinInclusive", "'\"' || c_acctbal || '\"^^<" + terms.XSD + "double>'", "value") + " WHERE c_acctbal < 0", _issue(_C, SEGMENT, "In", _SEG, "kind") + " WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')", _issue(_C, SEGMENT, "Pattern", _SEG, "kind") + " WHERE c_mktsegment NOT LIKE '%I%'"]))
def shacl_values(spark: SparkSession, d: str) -> DataFrame:
    """Extension: value constraints of the public shapes vocabulary."""
    money = shapes.Shape("value", BALANCE, subjects_of=BALANCE, min_inclusive=0.0, datatype=f"<{terms.XSD}double>", max_count=1, node_kind="literal")
    kind = shapes.Shape("kind", SEGMENT, subjects_of=SEGMENT, allowed=('"BUILDING"', '"MACHINERY"'), pattern="I")
    return shapes.validate(quads(spark, d), [money, kind])


QUERIES, ORACLES = query.queries, query.oracles
