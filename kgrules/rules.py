"""Horn rules: terms, atoms, rules, their text and JSON forms."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass


class RuleError(ValueError):
    """A rule that can't be read."""


@dataclass(frozen=True)
class Term:
    kind: str  # "variable" or "constant"
    value: str

    @property
    def is_var(self) -> bool:
        return self.kind == "variable"


@dataclass(frozen=True)
class Atom:
    s: Term
    p: str
    o: Term

    @property
    def variables(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(t.value for t in (self.s, self.o) if t.is_var))


@dataclass(frozen=True)
class Rule:
    body: tuple[Atom, ...]
    head: Atom
    text: str = ""

    @property
    def variables(self) -> tuple[str, ...]:
        """In order of appearance, the body first."""
        return tuple(dict.fromkeys(v for a in (*self.body, self.head) for v in a.variables))

    @property
    def body_variables(self) -> frozenset[str]:
        return frozenset(v for a in self.body for v in a.variables)

    @property
    def safe(self) -> bool:
        """Every head variable occurs in the body."""
        return set(self.head.variables) <= self.body_variables


def var(name: str) -> Term:
    return Term("variable", name.removeprefix("?"))


def const(value: str) -> Term:
    return Term("constant", value)


def expand(name: str, prefixes: Mapping[str, str]) -> str:
    """<iri> loses its brackets, literals and blank nodes stay, prefix:local is expanded, all else stays."""
    if name.startswith("<") and name.endswith(">"):
        return name[1:-1]
    if name[:1] in "\"'" or name.startswith("_:"):
        return name
    head, colon, local = name.partition(":")
    return prefixes[head] + local if colon and head in prefixes else name


def _term(token: str, prefixes: Mapping[str, str]) -> Term:
    if token.startswith("?"):
        if len(token) == 1:
            raise RuleError("variable without a name")
        return var(token)
    if not token:
        raise RuleError("empty term")
    return const(expand(token, prefixes))


_TOKEN = re.compile(r'<[^>]*>|"(?:[^"\\]|\\.)*"\S*|\S+')


def _atom(text: str, prefixes: Mapping[str, str], exact: bool = False) -> Atom:
    text = text.strip()
    if not (text.startswith("(") and text.endswith(")")):
        raise RuleError(f"an atom stands in parentheses: {text!r}")
    tokens = _TOKEN.findall(text[1:-1])
    if len(tokens) < 3 or exact and len(tokens) != 3:
        raise RuleError(f"an atom has three tokens: {text!r}")
    s, p, o = tokens[:3]
    return Atom(_term(s, prefixes), expand(p, prefixes), _term(o, prefixes))


def split_atoms(text: str) -> list[str]:
    """The parts between carets that stand outside all parentheses."""
    parts, depth, lo = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "^" and depth == 0:
            parts.append(text[lo:i])
            lo = i + 1
    return [p.strip() for p in (*parts, text[lo:]) if p.strip()]


def parse_line(line: str, prefixes: Mapping[str, str] | None = None, exact: bool = False) -> Rule:
    """``( ?a p ?c ) ^ ( ?c q ?b ) => ( ?a r ?b ) | comment``. With ``exact``, atoms of more than three tokens are refused too."""
    prefixes = prefixes or {}
    text = line.split("|", 1)[0].strip()
    body, arrow, head = text.partition("=>")
    if not arrow:
        raise RuleError(f"a rule has '=>': {line!r}")
    return Rule(tuple(_atom(a, prefixes, exact) for a in split_atoms(body)), _atom(head, prefixes, exact), text)


def parse_text(lines: Iterable[str], prefixes: Mapping[str, str] | None = None) -> list[Rule]:
    return [parse_line(x, prefixes) for x in lines if x.strip()]


def _of_json(x: object, prefixes: Mapping[str, str]) -> Rule:
    def term(t: object) -> Term:
        if not isinstance(t, dict) or not t.get("value"):
            raise RuleError(f"a term has a value: {t!r}")
        if t.get("type") == "variable":
            return var(t["value"])
        return const(expand(t["value"], prefixes))

    def atom(a: object) -> Atom:
        if not isinstance(a, dict) or not {"subject", "predicate", "object"} <= a.keys():
            raise RuleError(f"an atom has subject, predicate and object: {a!r}")
        return Atom(term(a["subject"]), expand(a["predicate"], prefixes), term(a["object"]))

    if not isinstance(x, dict) or "head" not in x or not isinstance(x.get("body"), list):
        raise RuleError(f"a rule has body and head: {x!r}")
    rule = Rule(tuple(atom(a) for a in x["body"]), atom(x["head"]))
    return Rule(rule.body, rule.head, parseable(rule))


def parse_json(text: str, prefixes: Mapping[str, str] | None = None) -> list[Rule]:
    """An array of rules."""
    try:
        found = json.loads(text)
    except ValueError as e:
        raise RuleError(str(e)) from e
    if not isinstance(found, list):
        raise RuleError("an array of rules is expected")
    return [_of_json(x, prefixes or {}) for x in found]


def parse_json_rule(text: str, prefixes: Mapping[str, str] | None = None) -> Rule:
    """A single rule object."""
    return parse_json(f"[{text}]", prefixes)[0]


def parse_file(name: str, text: str, prefixes: Mapping[str, str] | None = None) -> list[Rule]:
    """JSON if the name ends so, else a rule per line."""
    return parse_json(text, prefixes) if name.endswith(".json") else parse_text(text.splitlines(), prefixes)


def to_dict(rule: Rule) -> dict:
    term = lambda t: {"type": t.kind, "value": f"?{t.value}" if t.is_var else t.value}
    atom = lambda a: {"subject": term(a.s), "predicate": a.p, "object": term(a.o)}
    return {"body": [atom(a) for a in rule.body], "head": atom(rule.head)}


def to_json(rules: Iterable[Rule]) -> str:
    return json.dumps([to_dict(r) for r in rules], ensure_ascii=False)


def text_to_json(lines: Iterable[str]) -> tuple[str, list[str]]:
    """Rules of text as JSON, names as written; and a warning for each line that isn't a rule of three-token atoms."""
    rules, warnings = [], []
    for i, line in enumerate(lines, 1):
        if line.strip() and not line.lstrip().startswith("|"):
            try:
                rules.append(_verbatim(line))
            except RuleError as e:
                warnings.append(f"line {i}: {e}")
    return to_json(rules), warnings


def _verbatim(line: str) -> Rule:
    body, arrow, head = line.split("|", 1)[0].partition("=>")
    if not arrow:
        raise RuleError("no '=>'")

    def atom(text: str) -> Atom:
        tokens = re.findall(r"<[^>]*>|\S+", text.strip().removeprefix("(").removesuffix(")"))
        if len(tokens) != 3:
            raise RuleError(f"an atom has three tokens: {text!r}")
        s, p, o = tokens
        return Atom(*(var(t) if t.startswith("?") else const(t) for t in (s,)), p, var(o) if o.startswith("?") else const(o))

    return Rule(tuple(atom(a) for a in split_atoms(body)), atom(head))


def _shown(rule: Rule, term) -> str:
    atom = lambda a: f"( {term(a.s)} {a.p} {term(a.o)} )"
    return f"{' ^ '.join(atom(a) for a in rule.body)} => {atom(rule.head)}".strip()


def display(rule: Rule) -> str:
    """With numbered variables: ``( ?0 p ?1 ) ^ ... => ( ... )``."""
    number = {v: i for i, v in enumerate(rule.variables)}
    return _shown(rule, lambda t: f"?{number[t.value]}" if t.is_var else t.value)


def parseable(rule: Rule) -> str:
    """A form that ``parse_line`` reads back: ``?v0``, ``<iri>``; literals and blank nodes as they are."""
    number = {v: i for i, v in enumerate(rule.variables)}
    wrapped = lambda x: x if x[:1] == '"' or x.startswith("_:") else f"<{x}>"
    atom = lambda a: f"( {term(a.s)} {wrapped(a.p)} {term(a.o)} )"
    term = lambda t: f"?v{number[t.value]}" if t.is_var else wrapped(t.value)
    return f"{' ^ '.join(atom(a) for a in rule.body)} => {atom(rule.head)}".strip()


def body_lengths(rules: Iterable[Rule]) -> dict[int, int]:
    """How many rules have bodies of each length."""
    out: dict[int, int] = {}
    for r in rules:
        out[len(r.body)] = out.get(len(r.body), 0) + 1
    return dict(sorted(out.items()))
