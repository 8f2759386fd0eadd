"""Scalar functions over strings, as columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of names and accessions.
LOCAL = r"^[A-Za-z0-9_][A-Za-z0-9_.-]*$"
ACCESSION = r"^(?:[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2})(?:-[0-9]+)?$"
DRUG = "ttd.drug_"


@dataclass(frozen=True)
class Kind:
    """Tokens of one sort: what they match, the beginning that their names leave out, their prefix and its base."""

    prefix: str
    base: str
    match: str = ""
    cut: str = ""


@dataclass(frozen=True)
class Naming:
    """How tokens become names: the first kind that an entity matches, and the kind of predicates."""

    entities: tuple[Kind, ...]
    predicate: Kind

    @property
    def kinds(self) -> tuple[Kind, ...]:
        return (*self.entities, self.predicate)

    def with_bases(self, **bases: str) -> Naming:
        """The same with other bases for some prefixes."""
        own = lambda k: replace(k, base=bases.get(k.prefix, k.base))
        return Naming(tuple(map(own, self.entities)), own(self.predicate))


NAMING = Naming(
    (Kind("ttd_drug", "https://identifiers.org/ttd.drug/", rf"^{re.escape(DRUG)}", DRUG), Kind("uniprot", "http://purl.uniprot.org/uniprot/", ACCESSION), Kind("res", "https://example.org/resource/")),
    Kind("rel", "https://example.org/relation/"),
)


def percent_encode(c: Column) -> Column:
    """Percent encoding with only letters, digits and ``_.-~`` kept; form encoding differs in blank, star and tilde."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def named(token: Column, kind: Kind) -> Column:
    """prefix:local where that is a safe name, else the whole encoded IRI in brackets."""
    local = F.substring(token, F.lit(len(kind.cut) + 1), F.length(token))
    safe = local.rlike(LOCAL) & ~local.endswith(".")
    return F.when(safe, F.concat(F.lit(f"{kind.prefix}:"), local)).otherwise(F.concat(F.lit(f"<{kind.base}"), percent_encode(local), F.lit(">")))


def entity(token: Column, naming: Naming = NAMING) -> Column:
    """The Turtle form of an entity token."""
    t = F.trim(token)
    *special, rest = naming.entities
    out = named(t, rest)
    for kind in reversed(special):
        out = F.when(t.rlike(kind.match), named(t, kind)).otherwise(out)
    return out


def predicate(token: Column, naming: Naming = NAMING) -> Column:
    return named(F.trim(token), naming.predicate)


def full(short: Column, naming: Naming = NAMING) -> Column:
    """A term's full form, from its Turtle form."""
    out = F.regexp_replace(short, "^<|>$", "")
    for kind in naming.kinds:
        at = f"{kind.prefix}:"
        out = F.when(short.startswith(at), F.concat(F.lit(kind.base), F.substring(short, F.lit(len(at) + 1), F.length(short)))).otherwise(out)
    return out


def number_after(line: Column, label: str) -> Column:
    """The number (exponents too) after a label in a log line."""
    return F.regexp_extract(line, label + r"\s*[:=]?\s*([0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double")
