import pytest

from kgrules import rules
from kgrules.sources import turtle

TEXT = "( ?d rel:p ?c ) ^ ( ?d rel:q \"x^y\"^^<http://t> ) => ( ?a <http://h> ?c ) | Support: 5"


def test_text_rule():
    r = rules.parse_line(TEXT, {"rel": "http://r/"})
    assert r.variables == ("d", "c", "a")
    assert r.body[0].p == "http://r/p" and r.body[1].o.value == '"x^y"^^<http://t>' and r.head.p == "http://h"
    assert not r.safe
    assert rules.display(rules.parse_line(rules.parseable(r))) == rules.display(r)


@pytest.mark.parametrize("bad", ["( ?a p ?b )", "( ?a p ) => ( ?a q ?b )", "?a p ?b => ( ?a q ?b )", "( ? p ?b ) => ( ?a q ?b )"])
def test_bad_text(bad):
    with pytest.raises(rules.RuleError):
        rules.parse_line(bad)


@pytest.mark.parametrize("bad", ["{", "{}", '[{"head":{}}]', '[{"body":[],"head":{"subject":{"type":"variable"},"predicate":"p","object":{"type":"variable","value":"?b"}}}]'])
def test_bad_json(bad):
    with pytest.raises(rules.RuleError):
        rules.parse_json(bad)


def test_json_forms():
    made, warnings = rules.text_to_json(["( ?a p ?b ) => ( ?a q c )", "", "( ?a p ) => ( ?a q ?b )"])
    assert len(warnings) == 1 and warnings[0].startswith("line 3")
    (r,) = rules.parse_file("x.json", made)
    assert rules.display(r) == "( ?0 p ?1 ) => ( ?0 q c )" and rules.body_lengths([r]) == {1: 1}
    assert rules.parse_json_rule(rules.to_json([r])[1:-1]).head == r.head


def test_turtle_terms():
    got = turtle.parse('@base <http://b/> . @prefix e: <http://e/> . <x> e:p 5. e:a e:q "n\\n\\u00e9"@fr, e:b.c . [] e:p [ e:q ( ) ] .')
    assert ("http://b/x", "http://e/p", '"5"') in got
    assert ("http://e/a", "http://e/q", '"n\né"@fr') in got and ("http://e/a", "http://e/q", "http://e/b.c") in got
    assert ("_:anon2", "http://e/q", f"{turtle.RDF}nil") in got and ("_:anon1", "http://e/p", "_:anon2") in got
