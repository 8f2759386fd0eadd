"""What queries move between tasks, by the rows that they are about."""

import itertools

import pytest

import __spark_entry__
from kgrules import queries
from kgrules.sources import tsv, turtle

SMALL, TEN = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def moved(spark, run) -> int:
    """Bytes that the stages of a call write for shuffles."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

    def stages():
        none = spark.sparkContext._gateway.new_array(jvm.double, 0)
        found = store.stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (found.apply(i) for i in range(found.size()))}

    before = stages()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for k, n in stages().items() if k not in before)


def empty(df) -> None:
    df.write.format("noop").mode("overwrite").save()


@pytest.fixture
def large(spark):
    """Tables count as too large for every task to hold, as they are at other sizes."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name, most", [("kg_stats", 22), ("predicate_stats", 22), ("adjacency_spo", 32), ("adjacency_pos", 28)])
def test_triples_are_dealt_once_and_as_keys(spark, name, most):
    """Bytes shuffled for each of the 210,890 triples."""
    assert (n := moved(spark, lambda: empty(__spark_entry__.queries()[name](spark, TEN)))) < most * 210_890, n


def test_predicates_are_stored_as_they_come(spark):
    """Storing a graph moves no triple beyond what makes its pairs distinct."""
    kg = queries.graph(spark, TEN)
    once = moved(spark, lambda: empty(kg.triples))
    stored = []
    assert moved(spark, lambda: stored.append(kg.stored())) <= 1.05 * once
    assert stored[0].triples.count() == stored[0].triples.distinct().count() == 210_890


@pytest.mark.parametrize("name, most", [("measures_triangle", 3.4e6), ("rules_batch_measures", 7.0e6), ("measures_star_2", 5.2e6)])
def test_bodies_begin_with_small_fan_outs(spark, name, most):
    """A supplier has ten times the orders that a part has; a body that goes from parts to orders has a tenth of the groundings."""
    assert (n := moved(spark, lambda: empty(__spark_entry__.queries()[name](spark, TEN)))) < most, n


def test_pairs_are_not_dealt_for_each_head(spark, large):
    """Nine rules that differ in the head alone count the pairs of their body once."""
    kg = queries.graph(spark, SMALL).stored()
    nine = [f"( ?a hasPart ?c ) ^ ( ?c suppliedBy ?b ) => ( ?a {p} ?b )" for p in queries.PREDICATES]
    one = moved(spark, lambda: empty(kg.measures(nine[:1])))
    assert (n := moved(spark, lambda: empty(kg.measures(nine)))) < 2 * one, (n, one)


def test_turtle_is_read_as_it_comes():
    """A text without end yields triples; long strings and statements go on from one chunk to the next."""
    endless = (f"{'' if i else '@prefix e: <http://e/> .'}\ne:a{i} e:p" if i % 2 == 0 else f'\n"""x{i}\n"" y""" .' for i in itertools.count())
    parts = turtle.Reader(endless).read(100)
    first = [t for part in itertools.islice(parts, 3) for t in part]
    assert first[:2] == [("http://e/a0", "http://e/p", '"x1\n"" y"'), ("http://e/a2", "http://e/p", '"x3\n"" y"')] and len(first) == 300


def test_turtle_files_in_blocks(spark, tmp_path):
    """Files that are read in several blocks give what they give as a whole, prefixes and strings of several lines included."""
    want = set()
    for k in range(3):
        lines = [f"@prefix e: <http://{k}/> ."]
        for i in range(3000):
            lines += [f"e:a{i} e:p e:b{i} ,", f'  """one', f'two {i}""" .'] if i % 3 else [f"e:a{i} e:q [ e:r {i} ] ."]
        (tmp_path / f"{k}.ttl").write_text("\n".join(lines))
        want |= {t for t in turtle.parse("\n".join(lines)) if "_:" not in t[0] + t[2]}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000b")
    try:
        got = [tuple(r) for r in turtle.read(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {t for t in got if "_:" not in t[0] + t[2]} == want
    nodes = [t for t in got if t[1].endswith("/q")]
    assert len(nodes) == len({t[2] for t in nodes}) == 3000 and len(got) == len(want) + 6000


def test_rules_graph_is_written_by_all_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "_place", lambda spark, name: str(tmp_path / name))
    queries.rule_files(spark, SMALL)
    assert len(list((tmp_path / "rules" / "graph").glob("part-*"))) > 1


def test_first_edges_of_files_by_name(spark, tmp_path):
    """The order is that of the names, not of the sizes by which Spark deals files; no task sorts all rows."""
    for name, n in (("a", 3), ("b", 3000), ("c", 30)):
        (tmp_path / name).write_text("".join(f"{name}\t{i}\tx\n" for i in range(n)))
    got = tsv.first(spark, str(tmp_path), 5).collect()
    assert [(r.subject, r.predicate) for r in got] == [("a", "0"), ("a", "1"), ("a", "2"), ("b", "0"), ("b", "1")]
    assert moved(spark, lambda: empty(queries.first_edges(spark, SMALL))) > 0


def test_roundtrip_deals_no_triple_by_predicate(spark, large):
    """Two joins each way deal the triples, by subject and by object."""
    assert (n := moved(spark, lambda: empty(__spark_entry__.queries()["dictionary_roundtrip"](spark, TEN)))) < 75 * 210_890, n
