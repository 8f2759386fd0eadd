"""Registered queries over the graph of the driver tables and over a golden micro-graph, with SQL for each."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import report, rules
from .functions import text
from .graph import KnowledgeGraph
from .measures import SCHEMA
from .operators import index
from .operators.store import shared_root
from .sources import tables, tsv, turtle

MEASURED = [x.split()[0] for x in SCHEMA.split(", ")]

# ---- the graph -------------------------------------------------------------------------------------------------------


def graph(spark: SparkSession, sf_dir: str, *predicates: str) -> KnowledgeGraph:
    return KnowledgeGraph.of_parts(spark, tables.parts(spark, sf_dir, predicates or None))


KG = """kg AS (
  SELECT 'o:' || o_orderkey AS s, 'placedBy' AS p, 'c:' || o_custkey AS o FROM orders
  UNION SELECT 'c:' || c_custkey, 'inNation', 'n:' || c_nationkey FROM customer
  UNION SELECT 's:' || s_suppkey, 'inNation', 'n:' || s_nationkey FROM supplier
  UNION SELECT 'n:' || n_nationkey, 'inRegion', 'r:' || n_regionkey FROM nation
  UNION SELECT 'o:' || l_orderkey, 'hasPart', 'p:' || l_partkey FROM lineitem
  UNION SELECT 'o:' || l_orderkey, 'fromSupplier', 's:' || l_suppkey FROM lineitem
  UNION SELECT 'p:' || l_partkey, 'suppliedBy', 's:' || l_suppkey FROM lineitem
  UNION SELECT 'p:' || l_partkey, 'returnedTo', 's:' || l_suppkey FROM lineitem WHERE l_returnflag = 'R'
  UNION SELECT 'p:' || l_partkey, 'bulkFrom', 's:' || l_suppkey FROM lineitem WHERE l_quantity >= 49
  UNION SELECT 'c:' || o_custkey, 'buysFrom', 's:' || l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 49
)"""

# ---- rules: text, and SQL for body pairs, head triples and supported head triples -------------------------------------


def _sql(head: str, body: str, shown: str, support: str, head_support: str | None = None) -> str:
    """``head``: the head predicate; ``body``: distinct pairs or a query with no row; ``support``: a condition on the head triple h."""
    heads = head_support or f"SELECT count(*) FROM kg WHERE p = '{head}'"
    return f"""WITH {KG}, n AS (
  SELECT (SELECT count(*) FROM kg h WHERE h.p = '{head}' AND {support})::BIGINT AS support,
         (SELECT count(*) FROM kg WHERE p = '{head}')::BIGINT AS head_size, ({heads})::BIGINT AS head_support,
         (SELECT count(*) FROM (SELECT DISTINCT * FROM ({body})))::BIGINT AS body_size)
SELECT 0::INT AS rule_id, '{shown}' AS rule, support, head_size, head_support,
       CASE WHEN head_size > 0 THEN support / head_size ELSE 0.0 END::DOUBLE AS head_coverage, body_size,
       CASE WHEN body_size > 0 THEN support / body_size ELSE 0.0 END::DOUBLE AS confidence FROM n"""


NOTHING = "SELECT 1 AS a WHERE false"

#: name: (rule, SQL)
RULES: dict[str, tuple[str, str]] = {
    "one_atom": (
        "( ?a returnedTo ?b ) => ( ?a suppliedBy ?b )",
        _sql("suppliedBy", "SELECT s, o FROM kg WHERE p = 'returnedTo' AND s <> o", "( ?0 returnedTo ?1 ) => ( ?0 suppliedBy ?1 )", "EXISTS (SELECT 1 FROM kg x WHERE x.p = 'returnedTo' AND x.s = h.s AND x.o = h.o)"),
    ),
    "chain_2": (
        "( ?a placedBy ?c ) ^ ( ?c buysFrom ?b ) => ( ?a fromSupplier ?b )",
        _sql(
            "fromSupplier",
            "SELECT x.s, y.o FROM kg x JOIN kg y ON x.o = y.s WHERE x.p = 'placedBy' AND y.p = 'buysFrom' AND x.s <> y.o AND x.s <> x.o AND y.s <> y.o",
            "( ?0 placedBy ?1 ) ^ ( ?1 buysFrom ?2 ) => ( ?0 fromSupplier ?2 )",
            "EXISTS (SELECT 1 FROM kg x JOIN kg y ON x.o = y.s WHERE x.p = 'placedBy' AND y.p = 'buysFrom' AND x.s = h.s AND y.o = h.o AND x.o <> h.s AND x.o <> h.o)",
        ),
    ),
    "star_2": (
        "( ?o hasPart ?a ) ^ ( ?o fromSupplier ?b ) => ( ?a suppliedBy ?b )",
        _sql(
            "suppliedBy",
            "SELECT x.o AS a, y.o AS b FROM kg x JOIN kg y ON x.s = y.s WHERE x.p = 'hasPart' AND y.p = 'fromSupplier' AND x.o <> y.o",
            "( ?0 hasPart ?1 ) ^ ( ?0 fromSupplier ?2 ) => ( ?1 suppliedBy ?2 )",
            "EXISTS (SELECT 1 FROM kg x JOIN kg y ON x.s = y.s WHERE x.p = 'hasPart' AND y.p = 'fromSupplier' AND x.o = h.s AND y.o = h.o)",
        ),
    ),
    "path_3": (
        "( ?d bulkFrom ?c ) ^ ( ?d bulkFrom ?b ) ^ ( ?a bulkFrom ?c ) => ( ?a bulkFrom ?b )",
        _sql(
            "bulkFrom",
            "SELECT z.s, y.o FROM kg x JOIN kg y ON x.s = y.s JOIN kg z ON z.o = x.o WHERE x.p = 'bulkFrom' AND y.p = 'bulkFrom' AND z.p = 'bulkFrom' AND x.o <> y.o AND z.s <> x.s",
            "( ?0 bulkFrom ?1 ) ^ ( ?0 bulkFrom ?2 ) ^ ( ?3 bulkFrom ?1 ) => ( ?3 bulkFrom ?2 )",
            "EXISTS (SELECT 1 FROM kg x JOIN kg y ON x.s = y.s JOIN kg z ON z.o = x.o WHERE x.p = 'bulkFrom' AND y.p = 'bulkFrom' AND z.p = 'bulkFrom' AND z.s = h.s AND y.o = h.o AND x.o <> y.o AND z.s <> x.s)",
        ),
    ),
    "triangle": (
        "( ?a bulkFrom ?b ) ^ ( ?o hasPart ?a ) ^ ( ?o fromSupplier ?b ) => ( ?a returnedTo ?b )",
        _sql(
            "returnedTo",
            "SELECT x.s, x.o FROM kg x JOIN kg y ON y.o = x.s JOIN kg z ON z.s = y.s AND z.o = x.o WHERE x.p = 'bulkFrom' AND y.p = 'hasPart' AND z.p = 'fromSupplier'",
            "( ?0 bulkFrom ?1 ) ^ ( ?2 hasPart ?0 ) ^ ( ?2 fromSupplier ?1 ) => ( ?0 returnedTo ?1 )",
            "EXISTS (SELECT 1 FROM kg x JOIN kg y ON y.o = x.s JOIN kg z ON z.s = y.s AND z.o = x.o WHERE x.p = 'bulkFrom' AND y.p = 'hasPart' AND z.p = 'fromSupplier' AND x.s = h.s AND x.o = h.o)",
        ),
    ),
    "constant_in_body": (
        "( ?o placedBy ?c ) ^ ( ?c inNation n:7 ) ^ ( ?o fromSupplier ?b ) => ( ?c buysFrom ?b )",
        _sql(
            "buysFrom",
            "SELECT x.o AS a, z.o AS b FROM kg x JOIN kg y ON y.s = x.o JOIN kg z ON z.s = x.s WHERE x.p = 'placedBy' AND y.p = 'inNation' AND y.o = 'n:7' AND z.p = 'fromSupplier'",
            "( ?0 placedBy ?1 ) ^ ( ?1 inNation n:7 ) ^ ( ?0 fromSupplier ?2 ) => ( ?1 buysFrom ?2 )",
            "EXISTS (SELECT 1 FROM kg x JOIN kg y ON y.s = x.o JOIN kg z ON z.s = x.s WHERE x.p = 'placedBy' AND y.p = 'inNation' AND y.o = 'n:7' AND z.p = 'fromSupplier' AND x.o = h.s AND z.o = h.o)",
        ),
    ),
    "constant_head": (
        "( ?c buysFrom ?b ) => ( ?c inNation n:3 )",
        _sql(
            "inNation",
            NOTHING,
            "( ?0 buysFrom ?1 ) => ( ?0 inNation n:3 )",
            "h.o = 'n:3' AND EXISTS (SELECT 1 FROM kg x WHERE x.p = 'buysFrom' AND x.s = h.s)",
            "SELECT count(*) FROM kg WHERE p = 'inNation' AND o = 'n:3'",
        ),
    ),
    "head_in_body": (
        "( ?a bulkFrom ?b ) ^ ( ?o hasPart ?a ) => ( ?a bulkFrom ?b )",
        _sql(
            "bulkFrom",
            "SELECT x.s, x.o FROM kg x JOIN kg y ON y.o = x.s WHERE x.p = 'bulkFrom' AND y.p = 'hasPart'",
            "( ?0 bulkFrom ?1 ) ^ ( ?2 hasPart ?0 ) => ( ?0 bulkFrom ?1 )",
            "false",
        ),
    ),
    "disconnected": (
        "( ?a inRegion ?c ) ^ ( ?e inNation ?b ) => ( ?a inRegion ?b )",
        _sql(
            "inRegion",
            "SELECT x.s, y.o FROM kg x, kg y WHERE x.p = 'inRegion' AND y.p = 'inNation' AND x.s <> y.o AND x.s <> y.s AND x.o <> y.o AND x.o <> y.s",
            "( ?0 inRegion ?1 ) ^ ( ?2 inNation ?3 ) => ( ?0 inRegion ?3 )",
            "EXISTS (SELECT 1 FROM kg x, kg y WHERE x.p = 'inRegion' AND y.p = 'inNation' AND x.s = h.s AND y.o = h.o AND x.o <> h.o AND y.s <> h.s AND y.s <> x.o)",
        ),
    ),
    "unsafe_head": (
        "( ?a buysFrom ?c ) => ( ?a inNation ?b )",
        _sql("inNation", NOTHING, "( ?0 buysFrom ?1 ) => ( ?0 inNation ?2 )", "EXISTS (SELECT 1 FROM kg x WHERE x.p = 'buysFrom' AND x.s = h.s AND x.o <> h.o)"),
    ),
    "empty_body": ("=> ( ?a inRegion ?b )", _sql("inRegion", NOTHING, "=> ( ?0 inRegion ?1 )", "h.s <> h.o")),
    "unknown_body": ("( ?a missing ?b ) => ( ?a inRegion ?b )", _sql("inRegion", NOTHING, "( ?0 missing ?1 ) => ( ?0 inRegion ?1 )", "false")),
    "unknown_head": ("( ?a inRegion ?b ) => ( ?a missing ?b )", _sql("missing", "SELECT s, o FROM kg WHERE p = 'inRegion'", "( ?0 inRegion ?1 ) => ( ?0 missing ?1 )", "false")),
}


def _predicates(name: str) -> list[str]:
    r = rules.parse_line(RULES[name][0])
    return sorted({a.p for a in (*r.body, r.head)} - {"missing"})


def measures(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule alone over the stored triples of its predicates: one enumeration of the body where both ends of the head are in
    it, else the general plan."""
    return graph(spark, sf_dir, *_predicates(name)).stored().measures([RULES[name][0]], batch=False)


def one(what: str, name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures(name, spark, sf_dir).select(what)


BATCH = ("one_atom", "chain_2", "star_2", "triangle", "constant_in_body", "head_in_body", "constant_head", "unsafe_head")


def rules_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    needed = {p for n in BATCH for p in _predicates(n)}
    return graph(spark, sf_dir, *sorted(needed)).stored().measures([RULES[n][0] for n in BATCH])


def _batch_sql() -> str:
    parts = [f"SELECT {i}::INT AS rule_id, * EXCLUDE (rule_id) FROM ({RULES[n][1]})" for i, n in enumerate(BATCH)]
    return "\nUNION ALL ".join(parts)


def by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules_batch(spark, sf_dir).withColumn("body_length", report.body_length(F.col("rule")).cast("int"))
    out = report.summary(rows, "support", ("body_length",))
    return out.select("body_length", "n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "stddev", "least", "greatest", "p95")))


BY_LENGTH = f"""SELECT body_length, count(*)::BIGINT AS n, round(avg(support), 6) AS mean, round(median(support)::DOUBLE, 6) AS median, round(stddev_pop(support), 6) AS stddev,
  min(support)::DOUBLE AS least, max(support)::DOUBLE AS greatest, quantile_disc(support, 0.95)::DOUBLE AS p95
FROM (SELECT support::DOUBLE AS support, (len(string_split(string_split(rule, '=>')[1], '( ')) - 1)::INT AS body_length FROM ({_batch_sql()})) GROUP BY body_length"""

# ---- the golden micro-graph ------------------------------------------------------------------------------------------

GOLDEN = """ann knows bob|bob knows cid|cid knows ann|ann knows cid|dan knows dan|dan knows eve|ann bornIn rome|bob bornIn rome
cid bornIn oslo|dan bornIn oslo|ann livesIn rome|bob livesIn oslo|cid livesIn oslo|eve livesIn rome"""
#: rule: (support, head size, head support, body size)
GOLDEN_RULES = {
    "( ?a bornIn ?b ) => ( ?a livesIn ?b )": (2, 4, 4, 4),
    "( ?a livesIn ?b ) => ( ?a bornIn ?b )": (2, 4, 4, 4),
    "( ?b knows ?a ) => ( ?a knows ?b )": (2, 6, 6, 5),
    "( ?a knows ?c ) ^ ( ?c knows ?b ) => ( ?a knows ?b )": (1, 6, 6, 3),
    "( ?a knows ?c ) ^ ( ?c livesIn ?b ) => ( ?a livesIn ?b )": (1, 4, 4, 4),
    "( ?d livesIn ?c ) ^ ( ?d bornIn ?b ) ^ ( ?a livesIn ?c ) => ( ?a bornIn ?b )": (0, 4, 4, 1),
    "( ?a bornIn oslo ) ^ ( ?a knows ?b ) => ( ?a knows ?b )": (0, 6, 6, 2),
    "( ?a knows ?b ) => ( ?a knows ?b )": (0, 6, 6, 5),
    "( ?a knows ?b ) ^ ( ?a knows ?b ) => ( ?a knows ?b )": (0, 6, 6, 0),
    "( ?a bornIn rome ) ^ ( ?a bornIn ?b ) => ( ?a livesIn ?b )": (0, 4, 4, 0),
    "( ?a bornIn rome ) => ( ?a livesIn rome )": (1, 4, 2, 0),
    "( ?a bornIn ?b ) => ( ann livesIn ?b )": (1, 4, 1, 0),
    "( ?a knows ?a ) => ( ?a bornIn oslo )": (1, 4, 2, 0),
    "( ?a knows ?a ) => ( ?a knows ?a )": (0, 6, 6, 1),
    "( ?a bornIn ?c ) ^ ( ?e livesIn ?b ) => ( ?a livesIn ?b )": (1, 4, 4, 4),
    "( ?a bornIn ?c ) => ( ?a livesIn ?b )": (1, 4, 4, 0),
    "( ?a missing ?b ) => ( ?a livesIn ?b )": (0, 4, 4, 0),
    "( ?a bornIn ?b ) => ( ?a missing ?b )": (0, 0, 0, 4),
}


def golden_graph(spark: SparkSession) -> KnowledgeGraph:
    rows = [tuple(t.split()) for line in GOLDEN.split("\n") for t in line.split("|")]
    return KnowledgeGraph(spark, spark.createDataFrame(rows, "s string, p string, o string"))


def golden(spark: SparkSession, sf_dir: str, batch: bool = True) -> DataFrame:
    return golden_graph(spark).measures(list(GOLDEN_RULES), batch=batch).select("rule_id", "support", "head_size", "head_support", "body_size")


def _golden_sql() -> str:
    rows = ", ".join(f"({i}, {s}, {h}, {k}, {b})" for i, (s, h, k, b) in enumerate(GOLDEN_RULES.values()))
    return f"SELECT rule_id::INT AS rule_id, support::BIGINT AS support, head_size::BIGINT AS head_size, head_support::BIGINT AS head_support, body_size::BIGINT AS body_size FROM (VALUES {rows}) t(rule_id, support, head_size, head_support, body_size)"


# ---- index, scans, sources, text -------------------------------------------------------------------------------------

def joined_adjacency(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    rows = index.adjacency(graph(spark, sf_dir).triples, by)
    return rows.select("p", "key", F.array_join("neighbours", ",").alias("neighbours"))


def roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples = graph(spark, sf_dir).stored().triples
    names = index.dictionary(triples)
    predicates = index.predicate_names(triples, names)
    return index.decode(index.encode(triples, names, predicates), names, predicates)


def atom_scan(spark: SparkSession, sf_dir: str, s: str | None = None, o: str | None = None) -> DataFrame:
    return index.neighbours(graph(spark, sf_dir, "returnedTo").triples, "returnedTo", s, o)


def scan_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triple that exists, with both ends given, and one that doesn't."""
    kg = graph(spark, sf_dir, "inRegion").triples
    return index.neighbours(kg, "inRegion", "n:1", "r:1").unionByName(index.neighbours(kg, "inRegion", "n:1", "r:0"))


def existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    kg = graph(spark, sf_dir, "bulkFrom", "returnedTo").triples
    return index.existing(index.of_predicate(kg, "bulkFrom").withColumn("p", F.lit("returnedTo")), kg)


def self_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose number is their customer's as well, as terms of one type."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return index.self_loops(orders.select(F.col("o_orderkey").cast("string").alias("s"), F.lit("placedBy").alias("p"), F.col("o_custkey").cast("string").alias("o")), "placedBy")


def edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as tab-separated lines: accessions, drugs, plain and unsafe names."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    k = F.col("l_partkey").cast("string")
    s = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("ttd.drug_D"), k)).when(F.col("l_linenumber") == 2, F.concat(F.lit("P"), F.lpad(F.pmod(F.col("l_partkey"), F.lit(100000)).cast("string"), 5, "0"))).when(F.col("l_linenumber") == 3, F.concat(F.lit("a b*~"), k)).otherwise(F.concat(F.lit("x"), k))
    return li.select(F.concat_ws("\t", s, F.lit("interacts_with"), F.concat(F.lit("y"), F.col("l_suppkey").cast("string"))).alias("value"))


EDGES = """e AS (SELECT CASE l_linenumber WHEN 1 THEN 'ttd.drug_D' || l_partkey WHEN 2 THEN 'P' || lpad((l_partkey % 100000)::VARCHAR, 5, '0') WHEN 3 THEN 'a b*~' || l_partkey ELSE 'x' || l_partkey END AS subject,
  'y' || l_suppkey AS object, l_partkey FROM lineitem)"""
TYPED = """CASE WHEN starts_with(subject, 'ttd.drug_') THEN 'ttd_drug:D' || l_partkey
  WHEN regexp_full_match(subject, '(?:[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2})(?:-[0-9]+)?') THEN 'uniprot:' || subject
  WHEN starts_with(subject, 'a b') THEN '<https://example.org/resource/a%20b%2A~' || l_partkey || '>' ELSE 'res:' || subject END"""


FULL_SUBJECT = f"replace(replace(replace(regexp_replace({TYPED}, '^<|>$', '', 'g'), 'ttd_drug:', 'https://identifiers.org/ttd.drug/'), 'uniprot:', 'http://purl.uniprot.org/uniprot/'), 'res:', 'https://example.org/resource/')"


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tsv.turtle_lines(tsv.parse(edge_lines(spark, sf_dir))).distinct()


def full_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tsv.triples(tsv.parse(edge_lines(spark, sf_dir))).groupBy("p").agg(F.count("*").alias("n"), F.count_distinct("s").alias("subjects"), F.min("s").alias("least"))


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", text.percent_encode(F.concat(F.lit("a +~*/"), "p_name")).alias("encoded"))


TURTLE = """@prefix ex: <http://e/> . PREFIX : <http://d/>
ex:a ex:p ex:b , "x"@en ; a ex:T ; ex:n 5 . # comment
:c ex:ok true ; ex:q 'one "two"' . ex:a ex:z [ ex:k ex:v ] , ( 1 ) .
_:n ex:p \"\"\"long
text\"\"\"^^<http://t> .
"""
TURTLE_ROWS = (
    ("http://e/a", "http://e/p", "http://e/b"),
    ("http://e/a", "http://e/p", '"x"@en'),
    ("http://e/a", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://e/T"),
    ("http://e/a", "http://e/n", '"5"'),
    ("http://d/c", "http://e/ok", '"true"^^http://www.w3.org/2001/XMLSchema#boolean'),
    ("http://d/c", "http://e/q", '"one "two""'),
    ("_:anon1", "http://e/k", "http://e/v"),
    ("http://e/a", "http://e/z", "_:anon1"),
    ("_:anon2", "http://www.w3.org/1999/02/22-rdf-syntax-ns#first", '"1"'),
    ("_:anon2", "http://www.w3.org/1999/02/22-rdf-syntax-ns#rest", "http://www.w3.org/1999/02/22-rdf-syntax-ns#nil"),
    ("http://e/a", "http://e/z", "_:anon2"),
    ("_:n", "http://e/p", '"long\ntext"^^http://t'),
)


def turtle_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(turtle.parse(TURTLE), "s string, p string, o string")


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def turtle_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples written as lines of full terms and read back."""
    kg = graph(spark, sf_dir).triples
    lines = kg.select(F.format_string("<http://e/%s> <http://e/%s> <http://e/%s> .", "s", "p", "o").alias("value"))
    return turtle.parse_lines(lines)


def _place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def turtle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges written as Turtle files with prefixes, and parsed again."""
    path = _place(spark, "turtle")
    tsv.write_turtle(tsv.parse(edge_lines(spark, sf_dir)).distinct(), path)
    return turtle.read(spark, path).distinct()


def turtle_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefixes declared in files, of which the second declares one again; the names come from a table."""
    path = _place(spark, "prefixes")
    regions = spark.read.parquet(f"{sf_dir}/region.parquet")
    for i, base in enumerate(("http://one/", "http://two/")):
        rows = regions.where(F.col("r_regionkey") >= 2 * i).coalesce(1).sortWithinPartitions("r_regionkey")
        rows.select(F.format_string(f"@prefix r%s: <{base}%s/> .", "r_regionkey", "r_regionkey")).write.text(f"{path}/{i}")
    found = turtle.prefixes(spark, f"{path}/*")
    return spark.createDataFrame(sorted(found.items()), "prefix string, base string")


def rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules read from a text and a JSON file, their names expanded by the prefixes of the graph's own files."""
    path = _place(spark, "rules")
    kg = graph(spark, sf_dir, "inNation", "inRegion", "buysFrom").triples
    short = lambda c: F.concat(F.lit("k:"), F.regexp_replace(c, ":", "."))
    statement = kg.select(F.concat_ws(" ", short(F.col("s")), F.concat(F.lit("k:"), "p"), short(F.col("o")), F.lit(".")).alias("value"))
    tsv.write_statements(statement, f"{path}/graph", ["@prefix k: <http://k/> ."])
    text = ["( ?a k:buysFrom ?b ) ^ ( ?b k:inNation ?c ) => ( ?a k:inNation ?c ) | a comment", "", "( ?a <http://k/inNation> ?n ) ^ ( ?n k:inRegion k:r.1 ) => ( ?a k:inNation ?n )"]
    for name, content in (("rules", "\n".join(text)), ("rules.json", rules.text_to_json(text)[0])):
        spark.range(1).select(F.lit(content).alias("value")).write.text(f"{path}/{name}")
    with KnowledgeGraph.load(spark, f"{path}/graph", persist=False) as found:
        read = [r for name in ("rules", "rules.json") for r in rules.parse_file(name, spark.read.text(f"{path}/{name}", wholetext=True).first().value, found.prefixes)]
        return found.stored().measures(read).select("rule_id", "rule", "support", "head_size", "body_size")


def _rule_files_sql() -> str:
    one = f"""SELECT count(*) FILTER (WHERE EXISTS (SELECT 1 FROM kg h WHERE h.p = 'inNation' AND h.s = b.s AND h.o = b.o)) AS support, count(*) AS body_size
  FROM (SELECT DISTINCT x.s, y.o FROM kg x JOIN kg y ON y.s = x.o WHERE x.p = 'buysFrom' AND y.p = 'inNation' AND x.s <> y.o) b"""
    two = "SELECT 0 AS support, count(*) AS body_size FROM (SELECT DISTINCT x.s, x.o FROM kg x JOIN kg y ON y.s = x.o WHERE x.p = 'inNation' AND y.p = 'inRegion' AND y.o = 'r:1') b"
    shown = ("( ?0 http://k/buysFrom ?1 ) ^ ( ?1 http://k/inNation ?2 ) => ( ?0 http://k/inNation ?2 )", "( ?0 http://k/inNation ?1 ) ^ ( ?1 http://k/inRegion http://k/r.1 ) => ( ?0 http://k/inNation ?1 )")
    size = "(SELECT count(*) FROM kg WHERE p = 'inNation')::BIGINT AS head_size"
    return f"WITH {KG} " + " UNION ALL ".join(f"SELECT {i + 2 * k}::INT AS rule_id, '{shown[i]}' AS rule, support::BIGINT AS support, {size}, body_size::BIGINT AS body_size FROM ({q})" for k in (0, 1) for i, q in enumerate((one, two)))


def single_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule given as JSON."""
    given = rules.to_json([rules.parse_line(RULES["constant_head"][0])])[1:-1]
    found = graph(spark, sf_dir, *_predicates("constant_head")).evaluate_json(given)
    return spark.createDataFrame([tuple(found[c] for c in MEASURED)], SCHEMA)


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text report of two rules, a row for each line."""
    rows = graph(spark, sf_dir, "inNation", "inRegion", "buysFrom").measures([RULES[n][0] for n in ("constant_head", "unsafe_head")]).orderBy("rule_id").collect()
    return spark.createDataFrame(list(enumerate(report.as_text(rows).split("\n"))), "line int, value string")


def first_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 1,000 edges of a folder whose files are written in the order of their keys. The limit is the operator."""
    path = _place(spark, "edges")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    li.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")))).write.text(path)
    return tsv.first(spark, path, 1000)


PREDICATES = ("bulkFrom", "buysFrom", "fromSupplier", "hasPart", "inNation", "inRegion", "placedBy", "returnedTo", "suppliedBy")


def all_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of two chained atoms over the graph's predicates, 729 in all, evaluated together."""
    listed = [f"( ?a {p} ?c ) ^ ( ?c {q} ?b ) => ( ?a {r} ?b )" for p in PREDICATES for q in PREDICATES for r in PREDICATES]
    return graph(spark, sf_dir).stored().measures(listed).select("rule_id", "support", "head_size", "body_size", F.round("confidence", 9).alias("confidence"))


CHAINS = f"""WITH {KG}, n AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS i, count(*) AS k FROM kg GROUP BY p),
b AS (SELECT DISTINCT x.p AS p, y.p AS q, x.s, y.o FROM kg x JOIN kg y ON y.s = x.o WHERE x.s <> y.o AND x.s <> x.o AND y.s <> y.o),
size AS (SELECT p, q, count(*) AS k FROM b GROUP BY p, q),
hit AS (SELECT b.p, b.q, h.p AS r, count(*) AS k FROM b JOIN kg h ON h.s = b.s AND h.o = b.o GROUP BY 1, 2, 3)
SELECT (x.i * 81 + y.i * 9 + z.i)::INT AS rule_id, coalesce(hit.k, 0)::BIGINT AS support, z.k::BIGINT AS head_size, coalesce(size.k, 0)::BIGINT AS body_size,
       round(CASE WHEN size.k > 0 THEN coalesce(hit.k, 0) / size.k ELSE 0 END, 9)::DOUBLE AS confidence
FROM n x, n y, n z LEFT JOIN size ON size.p = x.p AND size.q = y.p LEFT JOIN hit ON hit.p = x.p AND hit.q = y.p AND hit.r = z.p"""


TEXTS = [x for x, _ in RULES.values()]


def text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = [rules.display(rules.parse_line(rules.parseable(rules.parse_line(x)))) for x in TEXTS]
    return spark.createDataFrame(list(enumerate(again)), "rule_id int, rule string")


def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, _ = rules.text_to_json(TEXTS)
    again = rules.parse_json(made)
    return spark.createDataFrame([(i, rules.display(r), len(r.body)) for i, r in enumerate(again)], "rule_id int, rule string, body_length int")


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = json.loads(rules.text_to_json(TEXTS)[0])
    df = spark.createDataFrame([(json.dumps(r["body"]),) for r in made], "body string")
    body = F.from_json("body", "array<struct<subject:struct<type:string,value:string>,predicate:string,object:struct<type:string,value:string>>>")
    return df.groupBy(F.size(body).alias("body_length")).agg(F.count("*").alias("n"))


LOGS = [(impl, f"rule {i}: support ms = {a}, confidence ms: {b}") for i in range(6) for impl, a, b in (("base", 10 + i, 2.5 * i), ("spark", 4, f"{i + 1}.5e-01"))]


def log_speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = report.runs(spark.createDataFrame(LOGS, "impl string, value string"))
    return report.speedup(times, "base", "spark").withColumn("ratio", F.round("ratio", 6))


def log_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least, mean and total times of rules that logs hold several runs of: a line for each order of a customer."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    line = F.format_string("rule %s: support ms = %s, confidence ms: %se-01", F.col("o_custkey"), F.pmod(F.col("o_orderkey"), F.lit(97)), F.pmod(F.col("o_orderkey"), F.lit(89)))
    return report.repeated(report.runs(orders.select(F.lit("spark").alias("impl"), line.alias("value")))).select("impl", "rule_id", "n", *(F.round(c, 6).alias(c) for c in ("least_ms", "mean_ms", "total_ms")))


def measures_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.as_json(golden_graph(spark).measures(list(GOLDEN_RULES)[:8]))
    return rows.select(F.get_json_object("value", "$.rule_id").cast("int").alias("rule_id"), F.get_json_object("value", "$.support").cast("long").alias("support"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        "kg_triples": lambda spark, d: graph(spark, d).triples,
        "kg_stats": lambda spark, d: index.graph_stats(graph(spark, d).triples),
        "pair_counts": lambda spark, d: index.pair_counts(graph(spark, d).triples),
        "predicate_stats": lambda spark, d: index.predicate_stats(graph(spark, d).triples),
        "dictionary_roundtrip": roundtrip,
        "adjacency_spo": partial(joined_adjacency, by="s"),
        "adjacency_pos": partial(joined_adjacency, by="o"),
        "atom_scan_free": atom_scan,
        "atom_scan_subj_const": partial(atom_scan, s="p:11"),
        "atom_scan_obj_const": partial(atom_scan, o="s:7"),
        "atom_scan_both_const": scan_both,
        "atom_scan_self_loop": self_loops,
        "triple_existence": existence,
        "golden_rules": golden,
        "golden_rules_general": partial(golden, batch=False),
        "rules_batch_measures": rules_batch,
        "rules_batch_by_body_length": by_length,
        "tsv_entity_typing": typed,
        "tsv_triples": full_edges,
        "percent_encode": encoded,
        "turtle_terms": turtle_terms,
        "turtle_lines": turtle_lines,
        "rule_text_roundtrip": text_roundtrip,
        "rule_json_roundtrip": json_roundtrip,
        "body_length_histogram": histogram,
        "log_parse_speedup": log_speedup,
        "log_repeats": log_repeats,
        "measures_json": measures_json,
        "turtle_files": turtle_files,
        "turtle_prefixes": turtle_prefixes,
        "rule_files": rule_files,
        "rule_single_json": single_json,
        "report_text": report_lines,
        "tsv_first": first_edges,
        "rules_all_chains": all_chains,
    }
    out |= {f"measures_{n}": partial(measures, n) for n in RULES}
    out |= {f"{w}_{n}": partial(one, w, n) for w in ("support", "body_size", "head_support") for n in ("chain_2", "star_2", "path_3", "constant_head")}
    return out


def oracle_sql() -> dict[str, str]:
    out = {
        "kg_triples": f"WITH {KG} SELECT s, p, o FROM kg",
        "kg_stats": f"WITH {KG} SELECT (SELECT count(*) FROM kg)::BIGINT AS n_triples, (SELECT count(*) FROM (SELECT s FROM kg UNION SELECT p FROM kg UNION SELECT o FROM kg))::BIGINT AS n_terms, (SELECT count(DISTINCT p) FROM kg)::BIGINT AS n_predicates",
        "pair_counts": f"WITH {KG} SELECT p, count(*)::BIGINT AS n FROM kg GROUP BY p",
        "predicate_stats": f"""WITH {KG}, a AS (SELECT p, s, count(*) AS k FROM kg GROUP BY p, s), b AS (SELECT p, o, count(*) AS k FROM kg GROUP BY p, o)
SELECT a.p, sum(a.k)::BIGINT AS n, count(*)::BIGINT AS n_subj, any_value(x.n_obj)::BIGINT AS n_obj, max(a.k)::BIGINT AS max_fan_spo, any_value(x.f)::BIGINT AS max_fan_pos
FROM a JOIN (SELECT p, count(*) AS n_obj, max(k) AS f FROM b GROUP BY p) x ON x.p = a.p GROUP BY a.p""",
        "dictionary_roundtrip": f"WITH {KG} SELECT s, p, o FROM kg",
        "adjacency_spo": f"WITH {KG} SELECT p, s AS key, string_agg(o, ',' ORDER BY o) AS neighbours FROM kg GROUP BY p, s",
        "adjacency_pos": f"WITH {KG} SELECT p, o AS key, string_agg(s, ',' ORDER BY s) AS neighbours FROM kg GROUP BY p, o",
        "atom_scan_free": f"WITH {KG} SELECT s, o FROM kg WHERE p = 'returnedTo'",
        "atom_scan_subj_const": f"WITH {KG} SELECT s, o FROM kg WHERE p = 'returnedTo' AND s = 'p:11'",
        "atom_scan_obj_const": f"WITH {KG} SELECT s, o FROM kg WHERE p = 'returnedTo' AND o = 's:7'",
        "atom_scan_both_const": f"WITH {KG} SELECT s, o FROM kg WHERE p = 'inRegion' AND s = 'n:1' AND o IN ('r:0', 'r:1')",
        "atom_scan_self_loop": "SELECT o_orderkey::VARCHAR AS s, o_custkey::VARCHAR AS o FROM orders WHERE o_orderkey = o_custkey",
        "triple_existence": f"WITH {KG} SELECT s, 'returnedTo' AS p, o FROM kg WHERE p = 'bulkFrom' AND EXISTS (SELECT 1 FROM kg x WHERE x.p = 'returnedTo' AND x.s = kg.s AND x.o = kg.o)",
        "golden_rules": _golden_sql(),
        "golden_rules_general": _golden_sql(),
        "rules_batch_measures": _batch_sql(),
        "rules_batch_by_body_length": BY_LENGTH,
        "tsv_entity_typing": f"WITH {EDGES} SELECT DISTINCT {TYPED} || ' rel:interacts_with res:' || object || ' .' AS value FROM e",
        "tsv_triples": f"""WITH {EDGES}, f AS (SELECT {FULL_SUBJECT} AS s FROM e)
SELECT 'https://example.org/relation/interacts_with' AS p, count(*)::BIGINT AS n, count(DISTINCT s)::BIGINT AS subjects, min(s) AS least FROM f""",
        "percent_encode": "SELECT p_partkey, 'a%20%2B~%2A%2F' || replace(p_name, ' ', '%20') AS encoded FROM part",
        "turtle_terms": "SELECT * FROM (VALUES " + ", ".join(f"({', '.join(map(quoted, r))})" for r in TURTLE_ROWS) + ") t(s, p, o)",
        "turtle_lines": f"WITH {KG} SELECT 'http://e/' || s AS s, 'http://e/' || p AS p, 'http://e/' || o AS o FROM kg",
        "rule_text_roundtrip": "SELECT rule_id::INT AS rule_id, rule FROM (VALUES " + ", ".join(f"({i}, {quoted(s)})" for i, s in enumerate(_shown())) + ") t(rule_id, rule)",
        "rule_json_roundtrip": "SELECT rule_id::INT AS rule_id, rule, n::INT AS body_length FROM (VALUES " + ", ".join(f"({i}, {quoted(s)}, {s.split('=>')[0].count('( ')})" for i, s in enumerate(_shown())) + ") t(rule_id, rule, n)",
        "body_length_histogram": "SELECT n::INT AS body_length, count(*)::BIGINT AS n FROM (VALUES " + ", ".join(f"({s.split('=>')[0].count('( ')})" for s in _shown()) + ") t(n) GROUP BY t.n",
        "log_parse_speedup": """WITH l AS (SELECT impl, regexp_extract(v, 'rule ([0-9]+)', 1)::INT AS rule_id, regexp_extract(v, 'support ms = ([0-9.eE+-]+)', 1)::DOUBLE + regexp_extract(v, 'confidence ms: ([0-9.eE+-]+)', 1)::DOUBLE AS ms
  FROM (VALUES """ + ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in LOGS) + """) t(impl, v))
SELECT a.rule_id, a.ms AS base_ms, b.ms AS other_ms, round(a.ms / b.ms, 6) AS ratio FROM l a JOIN l b ON a.rule_id = b.rule_id AND a.impl = 'base' AND b.impl = 'spark'""",
        "measures_json": "SELECT rule_id::INT AS rule_id, support::BIGINT AS support FROM (VALUES " + ", ".join(f"({i}, {x[0]})" for i, x in enumerate(list(GOLDEN_RULES.values())[:8])) + ") t(rule_id, support)",
    }
    out |= {
        "log_repeats": """WITH t AS (SELECT o_custkey, (o_orderkey % 97) + (o_orderkey % 89) * 0.1::DOUBLE AS ms FROM orders)
SELECT 'spark' AS impl, o_custkey::INT AS rule_id, count(*)::BIGINT AS n, round(min(ms), 6) AS least_ms, round(avg(ms), 6) AS mean_ms, round(sum(ms), 6) AS total_ms FROM t GROUP BY o_custkey""",
        "turtle_files": f"WITH {EDGES}, f AS (SELECT DISTINCT {FULL_SUBJECT} AS s, object FROM e) SELECT s, 'https://example.org/relation/interacts_with' AS p, 'https://example.org/resource/' || object AS o FROM f",
        "turtle_prefixes": "SELECT 'r' || r_regionkey AS prefix, CASE WHEN r_regionkey >= 2 THEN 'http://two/' ELSE 'http://one/' END || r_regionkey || '/' AS base FROM region",
        "rule_files": _rule_files_sql(),
        "rule_single_json": RULES["constant_head"][1],
        "report_text": _report_sql(),
        "tsv_first": "SELECT l_orderkey::VARCHAR AS subject, l_linenumber::VARCHAR AS predicate, l_partkey::VARCHAR AS object FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 1000",
        "rules_all_chains": CHAINS,
    }
    out |= {f"measures_{n}": sql for n, (_, sql) in RULES.items()}
    out |= {f"{w}_{n}": f"SELECT {w} FROM ({RULES[n][1]})" for w in ("support", "body_size", "head_support") for n in ("chain_2", "star_2", "path_3", "constant_head")}
    return out


def _report_sql() -> str:
    """The lines of the report; figures are printed with at most six significant digits."""
    share = "CASE WHEN {0} = 0 THEN '0' ELSE format('{{:.6g}}', {0}) END"
    rules_ = " UNION ALL ".join(f"SELECT {i}::INT AS rule_id, * EXCLUDE (rule_id) FROM ({RULES[n][1]})" for i, n in enumerate(("constant_head", "unsafe_head")))
    lines = (
        "'Rule ' || rule_id || ': ' || rule",
        f"'  support ' || support || ', head size ' || head_size || ', head support ' || head_support || ', head coverage ' || {share.format('head_coverage')}",
        f"'  body size ' || body_size || ', confidence ' || {share.format('confidence')}",
    )
    return " UNION ALL ".join(f"SELECT (3 * rule_id + {k})::INT AS line, {x} AS value FROM ({rules_})" for k, x in enumerate(lines))


def _shown() -> list[str]:
    """The displayed forms, as written in the SQL of each rule."""
    return [sql.split("0::INT AS rule_id, '")[1].split("' AS rule")[0] for _, sql in RULES.values()]
