import itertools
import random

import duckdb
import pytest

import __spark_entry__
from kgrules import cli, queries
from kgrules.functions.text import NAMING
from kgrules.graph import KnowledgeGraph
from kgrules.operators.store import shared_root
from kgrules.plans.planner import CrossProductError, Stats, groundings, order, supported
from kgrules.report import as_text
from kgrules.rules import Atom, Rule, const, parse_line, to_json, var
from kgrules.sources import tsv, turtle

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()


def brute(triples, rule):
    """(support, head size, head support, body size) by trying every assignment."""
    terms = sorted({x for t in triples for x in (t[0], t[2])})

    def ground(a, env):
        return tuple(env.get(t.value) if t.is_var else t.value for t in (a.s, a.o))

    def groundings(start, used):
        names = [v for v in rule.variables if v in rule.body_variables and v not in start]
        for values in itertools.permutations([t for t in terms if t not in start.values()], len(names)):
            env = start | dict(zip(names, values, strict=True))
            atoms = [(s, a.p, o) for a in rule.body for s, o in [ground(a, env)]]
            if len(set(atoms) | used) == len(atoms) + len(used) and all(x in triples for x in atoms):
                yield env

    h = rule.head
    heads = [t for t in triples if t[1] == h.p]
    matching = [t for t in heads if all(x.is_var or x.value == y for x, y in ((h.s, t[0]), (h.o, t[2])))]
    support = 0
    for t in matching:
        env = {x.value: y for x, y in ((h.s, t[0]), (h.o, t[2])) if x.is_var}
        if any(x.is_var and env[x.value] != y for x, y in ((h.s, t[0]), (h.o, t[2]))) or len(set(env.values())) < len(env):
            continue
        support += not rule.body or any(True for _ in groundings(env, {t}))
    size = 0
    if rule.body and h.s.is_var and h.o.is_var and rule.safe:
        size = len({(e[h.s.value], e[h.o.value]) for e in groundings({}, set())})
    return support, len(heads), len(matching), size


def random_rule(rng):
    term = lambda: var(rng.choice("abcd")) if rng.random() < 0.85 else const(rng.choice("uvwx"))
    atom = lambda: Atom(term(), rng.choice("pq"), term())
    return Rule(tuple(atom() for _ in range(rng.choice((1, 2, 2)))), atom())


def test_random_rules_against_brute_force(spark):
    rng = random.Random(3)
    triples = {(rng.choice("uvwxyz"), rng.choice("pq"), rng.choice("uvwxyz")) for _ in range(26)}
    listed = [random_rule(rng) for _ in range(24)]
    kg = KnowledgeGraph(spark, spark.createDataFrame(sorted(triples), "s string, p string, o string").coalesce(1))
    for batch in (True, False):
        got = kg.measures(listed, batch=batch).orderBy("rule_id").collect()
        for r, row in zip(listed, got, strict=True):
            assert (row.support, row.head_size, row.head_support, row.body_size) == brute(triples, r), (r, batch)


def test_budget_and_storage_change_nothing(spark):
    """Rules in parts of any size, over stored triples or not, give the same measures."""
    rng = random.Random(4)
    triples = sorted({(rng.choice("uvwxyz"), rng.choice("pqr"), rng.choice("uvwxyz")) for _ in range(40)})
    listed = [random_rule(rng) for _ in range(60)]
    kg = KnowledgeGraph(spark, spark.createDataFrame(triples, "s string, p string, o string").coalesce(1))
    want = sorted(kg.measures(listed, batch=False).collect())
    assert sorted(kg.measures(listed, budget=0).collect()) == want
    stored = kg.stored()
    assert sorted(stored.measures(listed).collect()) == want
    assert sorted(stored.triples.select("s", "p", "o").collect()) == triples


def test_scans_of_a_stored_graph(spark):
    """Rules that share atoms read each predicate's files a few times, whatever their number."""
    kg = queries.graph(spark, SMALL, "hasPart", "fromSupplier", "suppliedBy", "returnedTo").stored()
    listed = [f"( ?o hasPart ?a ) ^ ( ?o fromSupplier ?b ) => ( ?a {p} ?b )" for p in ("suppliedBy", "returnedTo")] * 40
    plan = kg.measures(listed)._jdf.queryExecution().analyzed().toString()
    assert plan.count("Relation [") <= 4
    scan = kg.triples.where("p = 'hasPart'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in scan and "= hasPart)]" in scan


def test_join_order_by_fan_out():
    a, b, c = (Atom(var("x"), "big", var("y")), Atom(var("y"), "wide", var("z")), Atom(var("y"), "narrow", var("w")))
    sizes = {"big": 5, "wide": 10, "narrow": 100}
    stats = {"big": Stats(5, 5, 5, 1, 1), "wide": Stats(10, 1, 10, 10, 1), "narrow": Stats(100, 100, 100, 1, 1)}
    assert order([a, b, c], sizes) == [0, 1, 2] and order([a, b, c], sizes, stats=stats) == [0, 2, 1]
    assert order([a, b, c], sizes, first=["z"]) == [1, 0, 2]
    assert groundings([a, b], stats) == 50 and groundings([a, c], stats) == 5


def test_reports_and_single_rules(spark):
    kg = queries.golden_graph(spark)
    rule = "( ?a bornIn ?b ) => ( ?a livesIn ?b )"
    rows = kg.measures([rule]).collect()
    assert as_text(rows) == "Rule 0: ( ?0 bornIn ?1 ) => ( ?0 livesIn ?1 )\n  support 2, head size 4, head support 4, head coverage 0.5\n  body size 4, confidence 0.5"
    found = kg.evaluate_json(to_json([parse_line(rule)])[1:-1])
    assert found["support"] == 2 and found["ms"] > 0 and kg.memory() > 0
    again = kg.evaluate(rule, repeat=3)
    assert again["runs"] == 3 and 0 < again["ms"] <= again["ms_mean"]
    assert as_text(rows, 3.0).endswith("Total 3.000 s, 3.000 s a rule")


def test_admission(spark):
    kg = queries.golden_graph(spark).stored()
    with pytest.warns(UserWarning, match="beyond"):
        assert not kg.admit(1).persisted
    with kg.admit(1 << 60):
        assert kg.persisted and kg.triples.count() == 14
    assert not kg.persisted


def test_other_base_iris(spark, tmp_path):
    naming = NAMING.with_bases(res="http://r/", rel="http://p/")
    (tmp_path / "e.tsv").write_text("a b\tlikes\tP19526\n")
    (row,) = KnowledgeGraph.load(spark, str(tmp_path / "e.tsv"), persist=False, naming=naming).triples.collect()
    assert tuple(row) == ("http://r/a%20b", "http://p/likes", "http://purl.uniprot.org/uniprot/P19526")
    tsv.write_turtle(tsv.parse(spark.read.text(str(tmp_path / "e.tsv"))), str(tmp_path / "ttl"), naming)
    assert tuple(KnowledgeGraph.load(spark, str(tmp_path / "ttl"), persist=False).triples.first()) == tuple(row)


def test_seeded_support_needs_no_product(spark):
    """The head binds both parts of an unconnected body."""
    kg = queries.golden_graph(spark)
    rule = parse_line("( ?a bornIn ?c ) ^ ( ?e livesIn ?b ) => ( ?a livesIn ?b )")
    found = supported(kg.triples, rule, kg.sizes(["bornIn", "livesIn"]))
    assert found.count() == 1 and "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()


def test_prefixes_last_wins(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("@prefix e: <http://1/> .\nPREFIX f: <http://f/>\n@prefix e: <http://2/> .\n")
    (tmp_path / "b.ttl").write_text("@prefix : <http://d/> .\n")
    assert turtle.prefixes(spark, str(tmp_path)) == {"e": "http://2/", "f": "http://f/", "": "http://d/"}


def test_no_shared_folder_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        shared_root(Session())


def test_golden_options(spark):
    kg = queries.golden_graph(spark)
    rows = kg.measures(list(queries.GOLDEN_RULES), zero_support_body="skip").orderBy("rule_id").collect()
    assert [r.body_size for r in rows if not r.support] == [0] * sum(not r.support for r in rows)
    assert kg.evaluate("( ?a bornIn ?b ) => ( ?a livesIn ?b )")["confidence"] == 0.5
    with pytest.raises(CrossProductError):
        kg.measures(["( ?a bornIn ?c ) ^ ( ?e livesIn ?b ) => ( ?a livesIn ?b )"], cross_limit=3)


@pytest.mark.parametrize("name", ["golden_rules", "dictionary_roundtrip", "rules_batch_measures", "tsv_entity_typing", "turtle_lines", "log_parse_speedup", "log_repeats", "predicate_stats", "kg_stats", "adjacency_pos", "atom_scan_both_const", "atom_scan_self_loop", "turtle_files", "turtle_prefixes", "rule_files", "rule_single_json", "report_text", "tsv_first", "rules_all_chains"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, SMALL).toPandas()
    want = con.sql(__spark_entry__.oracle_sql()[name]).df()
    key = sorted(want.columns)
    assert sorted(got.columns) == key
    a, b = (x[key].sort_values(key).reset_index(drop=True).astype(str) for x in (got, want))
    assert a.equals(b)


def test_files_and_command_line(spark, tmp_path, capsys):
    (tmp_path / "e.tsv").write_text("ttd.drug_D1\tinteracts_with\tP19526\n\na b\tinteracts_with\tfoo\n")
    tsv.write_turtle(tsv.parse(spark.read.text(str(tmp_path / "e.tsv"))), str(tmp_path / "ttl"))
    rules = tmp_path / "r.txt"
    rules.write_text("( ?a rel:interacts_with ?b ) => ( ?a rel:interacts_with ?b )\n")
    assert KnowledgeGraph.load(spark, str(tmp_path / "ttl")).triples.count() == 2
    assert tsv.first(spark, str(tmp_path / "e.tsv"), 1).collect()[0].subject == "ttd.drug_D1"
    cli.main([str(tmp_path / "ttl"), str(rules), "--json"])
    assert '"body_size":2' in capsys.readouterr().out
    with pytest.raises(Exception, match="expected 3 columns"):
        tsv.parse(spark.createDataFrame([("a\tb",)], "value string")).collect()
