"""Personal data replaced by keyed surrogates. DataFrame expressions only.

Entities: mail addresses, IPv4 addresses, card numbers (with a valid Luhn sum), telephone numbers, and names after a form of
address, with all further mentions of such a name in its document, form of address or not. A surrogate depends on the key,
the type and the entity's normal form alone, so the same entity has the same surrogate in every document (coreference):
addresses whatever their case, numbers whatever their separators and with or without a country code, and the given names
and surnames of persons each for themselves, so that a short and a full name agree. It keeps the type and the written format:
digits become digits, letters of a case letters of that case, separators, country codes and forms of address stay; cards
keep a valid Luhn sum and their first digit, addresses stay IPv4 ones, given names are drawn from lists of the same gender
and script.

Collision checks keep different entities apart: entities of one type whose surrogates agree, or equal an entity of the
corpus, are drawn again (all but the first) with the next attempt number, until none is left; names and addresses get
longer with the attempts, so their space is open. The entity table is distributed; only the number of collisions
reaches the driver.

Cases: a null text stays null, texts without entities come through unchanged. Rows are independent of their ids, so null
and repeated ids are fine. Other columns, whatever their names, are carried along. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, unused
from .spans import gaps, matches

MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{3,4}(?![0-9])"
PHONE = r"(?<![0-9+])(?:\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,6}|\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}|0[0-9]{1,4}[ /-][0-9]{5,8})(?![0-9])"
# Forms of address by gender and script, and names to draw from.
FEMALE, MALE, NEUTRAL = ("Mrs", "Ms", "Miss", "Mme", "Frau", "Sra", "Госпожа"), ("Mr", "Herr", "Sr", "Monsieur", "Господин"), ("Dr", "Prof")
TITLE = rf"(?<!\p{{L}})(?:{'|'.join(FEMALE + MALE + NEUTRAL)})\.? "
WORD = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
NAME = rf"{TITLE}{WORD}(?: {WORD})?"
NAMES = {
    ("f", "latin"): ("Anna", "Clara", "Elena", "Ida", "Julia", "Lena", "Maria", "Nora", "Paula", "Rosa", "Sofia", "Vera"),
    ("m", "latin"): ("Adam", "Bruno", "David", "Emil", "Felix", "Hugo", "Karl", "Leo", "Marco", "Oscar", "Paul", "Victor"),
    ("n", "latin"): ("Alex", "Andrea", "Chris", "Dominique", "Jean", "Kim", "Luca", "Robin", "Sasha", "Toni"),
    ("f", "cyrillic"): ("Анна", "Вера", "Елена", "Ирина", "Мария", "Ольга"),
    ("m", "cyrillic"): ("Андрей", "Борис", "Виктор", "Иван", "Олег", "Павел"),
    ("n", "cyrillic"): ("Женя", "Саша", "Слава", "Шура"),
}
SYLLABLES = {"latin": ("ba", "de", "fi", "go", "ka", "lo", "mu", "ne", "ri", "sa", "te", "vo"), "cyrillic": ("ба", "ве", "го", "да", "ки", "ло", "му", "не", "ра", "со")}
ANY = "|".join((MAIL, IP, CARD, PHONE, NAME))
TYPES = ("mail", "ip", "card", "phone", "name")


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits is divisible by ten."""
    return F.pmod(_luhn_sum(digits), F.lit(10)) == 0


def _luhn_sum(digits: Column) -> Column:
    back = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), lambda c: c.cast("int"))
    return F.aggregate(F.transform(back, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))), F.lit(0), lambda a, d: a + d)


def kind(raw: Column) -> Column:
    digits = F.regexp_replace(raw, "[^0-9]", "")
    octets = F.forall(F.split(raw, r"\."), lambda o: o.try_cast("int") <= 255)
    return (
        F.when(raw.contains("@"), "mail")
        .when(raw.rlike(r"^\p{L}"), "name")
        .when(raw.rlike(rf"^{IP}$"), F.when(octets, "ip"))
        .when(F.length(digits).between(15, 16) & raw.rlike(rf"^{CARD}$"), F.when(luhn(digits), "card"))
        .when(F.length(digits).between(8, 15), "phone")
    )


def normal(raw: Column, type_: Column) -> Column:
    """What makes two mentions one entity: case of addresses, separators and country codes of numbers don't."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    return F.when(type_ == "mail", F.lower(raw)).when(type_ == "card", digits).when(type_ == "phone", F.regexp_replace(F.regexp_replace(raw, r"^\+[0-9]{1,3}[ .-]", ""), "[^0-9]", "")).otherwise(raw)


PART = "array<struct<lit:string,type:string,norm:string,raw:string,gender:string>>"


def parts(raw: Column) -> Column:
    """What a match is made of: pieces of text that stay and entities. A name has one for each of its words."""
    piece = lambda lit, type_, norm, raw, gender: F.struct(lit.alias("lit"), type_.alias("type"), norm.alias("norm"), raw.alias("raw"), gender.alias("gender"))
    none = F.lit(None).cast("string")
    title = F.regexp_extract(raw, rf"^{TITLE}", 0)
    plain = F.regexp_replace(title, r"[. ]", "")
    gender = F.when(plain.isin(*FEMALE), "f").when(plain.isin(*MALE), "m").otherwise("n")
    words = F.split(F.substring(raw, F.length(title) + 1, F.length(raw)), " ")
    first, last = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    full = F.array(piece(title, F.lit("given"), first, first, gender), piece(F.lit(" "), F.lit("surname"), last, last, none))
    name = F.when(F.size(words) > 1, full).otherwise(F.array(piece(title, F.lit("surname"), first, first, none)))
    type_ = kind(raw)
    return F.when(type_ == "name", name).otherwise(F.array(piece(F.lit(""), type_, normal(raw, type_), raw, none)))


def pattern(text: Column) -> Column:
    """ANY, and in documents with names also these names alone."""
    names = F.transform(matches(text, NAME), lambda m: F.split(F.regexp_replace(m, rf"^{TITLE}", ""), " "))
    last = F.array_join(F.array_distinct(F.transform(names, lambda w: F.element_at(w, -1))), "|")
    given = F.array_join(F.array_distinct(F.transform(F.filter(names, lambda w: F.size(w) > 1), lambda w: F.get(w, F.lit(0)))), "|")
    bare = F.concat(F.lit(rf"{ANY}|(?<!\p{{L}})(?:(?:"), F.when(given != "", given).otherwise(F.lit("(?!)")), F.lit(") )?(?:"), last, F.lit(r")(?!\p{L})"))
    return F.when(text.rlike(NAME), bare).otherwise(F.lit(ANY))


def _hash(key: str, type_: Column, norm: Column, attempt: Column) -> Column:
    """64 hex digits."""
    return F.sha2(F.concat_ws("|", F.lit(key), type_, norm, attempt.cast("string"), F.sha2(F.concat(F.lit(key), norm), 256)), 256)


def _nth(h: Column, i: Column, most: int) -> Column:
    """A number below ``most`` from the i-th pair of hex digits and its neighbour."""
    at = F.pmod(i * 3, F.lit(60)) + 1
    return F.pmod(F.conv(F.substring(h, at, F.lit(4)), 16, 10).cast("int") + i, F.lit(most))


def reformat(raw: Column, h: Column) -> Column:
    """Digits, lower and upper letters replaced by others of their class, all else kept."""
    def sign(c: Column, i: Column) -> Column:
        letter = lambda base: F.char(F.lit(base) + _nth(h, i, 26))
        return F.when(c.rlike("[0-9]"), _nth(h, i, 10).cast("string")).when(c.rlike("[a-z]"), letter(97)).when(c.rlike("[A-Z]"), letter(65)).otherwise(c)

    return F.array_join(F.transform(F.split(raw, ""), sign), "")


def _card(norm: Column, h: Column) -> Column:
    body = F.concat(F.substring(norm, 1, 1), F.array_join(F.transform(F.sequence(F.lit(1), F.length(norm) - 2), lambda i: _nth(h, i, 10).cast("string")), ""))
    return F.concat(body, F.pmod(10 - F.pmod(_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string"))


def _given(norm: Column, gender: Column, h: Column, attempt: Column) -> Column:
    """A name of the lists; from the second attempt on syllables, one more each time, and the ending of the gender."""

    def choose(script: str, ends: dict[str, str]) -> Column:
        lists = {g: F.array(*(F.lit(n) for n in NAMES[g, script])) for g in "fmn"}
        some, end = F.lit(None), F.lit(None)
        for g in "fmn":
            some, end = F.when(gender == g, lists[g]).otherwise(some), F.when(gender == g, F.lit(ends[g])).otherwise(end)
        drawn = F.element_at(some, F.pmod(F.conv(F.substring(h, 1, 6), 16, 10).cast("int"), F.size(some)) + 1)
        return F.when(attempt == 0, drawn).otherwise(F.concat(_syllables(h, attempt, script), end))

    return F.when(norm.rlike(r"^\p{IsCyrillic}"), choose("cyrillic", {"f": "на", "m": "н", "n": "ша"})).otherwise(choose("latin", {"f": "na", "m": "n", "n": "lin"}))


def _syllables(h: Column, n: Column, script: str) -> Column:
    some = F.array(*(F.lit(s) for s in SYLLABLES[script]))
    drawn = F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), lambda i: F.element_at(some, _nth(h, i, len(SYLLABLES[script])) + 1)), ""))
    return F.when(n >= 1, drawn).otherwise(F.lit(""))


def _surname(norm: Column, h: Column, attempt: Column) -> Column:
    """Four syllables, and one more with every other attempt."""
    n = F.lit(4) + F.floor(attempt / 2)
    return F.when(norm.rlike(r"^\p{IsCyrillic}"), _syllables(h, n, "cyrillic")).otherwise(_syllables(h, n, "latin"))


def surrogate(key: str, type_: Column, norm: Column, gender: Column, attempt: Column) -> Column:
    h = _hash(key, type_, norm, attempt)
    ip = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (_nth(h, i, 253) + 1).cast("string")), ".")
    local = F.concat(reformat(F.regexp_extract(norm, "^[^@]+", 0), h), F.lower(_syllables(F.sha2(h, 256), F.floor(attempt / 2), "latin")))
    mail = F.concat(local, F.lit("@"), reformat(F.regexp_extract(norm, r"@(.*)\.[^.]*$", 1), F.sha2(h, 256)), F.regexp_extract(norm, r"\.[^.]*$", 0))
    return (
        F.when(type_ == "mail", mail)
        .when(type_ == "ip", ip)
        .when(type_ == "card", _card(norm, h))
        .when(type_ == "given", _given(norm, gender, h, attempt))
        .when(type_ == "surname", _surname(norm, h, attempt))
        .otherwise(reformat(norm, h))
    )


def dressed(raw: Column, type_: Column, drawn: Column) -> Column:
    """The surrogate in the format of this mention: a number's digits take the places of the mention's last digits, and an
    address' letters have the case of the letters in their place."""
    digits = F.length(F.regexp_replace(raw, "[^0-9]", ""))
    walk = F.aggregate(
        F.split(raw, ""),
        F.struct((F.length(drawn) - digits + 1).alias("i"), F.lit("").alias("s")),
        lambda acc, c: F.when(c.rlike("[0-9]"), F.struct((acc["i"] + 1).alias("i"), F.concat(acc["s"], F.when(acc["i"] > 0, F.substring(drawn, acc["i"], F.lit(1))).otherwise(c)).alias("s"))).otherwise(F.struct(acc["i"].alias("i"), F.concat(acc["s"], c).alias("s"))),
        lambda acc: acc["s"],
    )
    like = lambda made, old: F.array_join(F.transform(F.split(made, ""), lambda c, i: F.when(F.substring(old, F.least(i + 1, F.length(old)), F.lit(1)).rlike("[A-Z]"), F.upper(c)).otherwise(c)), "")
    half = lambda x, i: F.get(F.split(x, "@"), F.lit(i))
    cased = F.concat(like(half(drawn, 0), half(raw, 0)), F.lit("@"), like(half(drawn, 1), half(raw, 1)))
    return F.when(type_.isin("card", "phone"), walk).when(type_ == "mail", cased).otherwise(drawn)


def assign(known: DataFrame, key: str, scratch: Scratch, most: int = 200) -> DataFrame:
    """(type, norm, drawn): a surrogate for each entity, all different within a type and none an entity itself."""
    drawn = lambda df: df.withColumn("drawn", surrogate(key, *(F.col(c) for c in ("type", "norm", "gender", "attempt"))))
    columns = ("type", "norm", "gender", "attempt", "drawn")
    table = scratch.keep(drawn(known.withColumn("attempt", F.lit(0))))
    taken = known.select("type", F.col("norm").alias("drawn"), F.lit(True).alias("real"))
    for _ in range(most):
        # a type and surrogate that many share is a row for each entity, not for each mention; attempts spread them
        first = table.groupBy("type", "drawn").agg(F.min(F.struct("attempt", "norm")).alias("first"))
        marked = table.join(first, ["type", "drawn"]).join(taken, ["type", "drawn"], "left")
        again = (F.col("first.norm") != F.col("norm")) | F.col("real").isNotNull()
        marked, left = scratch.counted(marked.select(*columns, again.alias("again")), "again")
        scratch.drop(table)
        if not left:
            return marked.select("type", "norm", "drawn")
        redrawn = drawn(marked.where("again").select("type", "norm", "gender", (F.col("attempt") + 1).alias("attempt")))
        table = scratch.keep(marked.where("not again").select(*columns).unionByName(redrawn.select(*columns)))
    raise RuntimeError("the numbers of one format are used up")


def replace(docs: DataFrame, key: str = "corpus") -> DataFrame:
    """``docs`` with every entity of the text replaced, and the columns pii_counts (map of type to mentions) and pii_n (under
    other names where ``docs`` has these, see ``unused``)."""
    scratch = Scratch(docs.sparkSession, "pii")
    names, (counts_, n_) = docs.columns, unused(docs, "pii_counts", "pii_n")
    text = F.col("text")
    has = F.coalesce(text.rlike(ANY), F.lit(False))
    rows = docs.where(has).select(F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names))).alias("row"), pattern(text).alias("pattern"))
    text_ = F.col(f"row.c{names.index('text')}")
    found = rows.select("row", gaps(text_, F.col("pattern")).alias("gap"), F.transform(matches(text_, F.col("pattern")), parts).alias("hits"), F.monotonically_increasing_id().alias("rid"))
    found = scratch.keep(found)
    each = found.select("rid", F.explode(F.array_distinct(F.flatten("hits"))).alias("e")).where("e.type is not null").select("rid", "e.*")
    known = scratch.keep(each.groupBy("type", "norm").agg(F.coalesce(F.min("gender"), F.lit("n")).alias("gender")))
    table = assign(known, key, scratch)
    used = each.select("rid", "type", "norm", "raw").distinct()
    used = used.join(table, ["type", "norm"]).select("rid", F.concat_ws(":", "type", "raw").alias("k"), dressed(F.col("raw"), F.col("type"), F.col("drawn")).alias("to"))
    maps = used.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("k", "to"))).alias("by"))
    joined = found.join(maps, "rid", "left")
    to = lambda p: F.concat(p["lit"], F.coalesce(F.try_element_at(F.col("by"), F.concat_ws(":", p["type"], p["raw"])), p["raw"]))
    new = F.transform("hits", lambda h: F.array_join(F.transform(h, to), ""))
    made = F.array_join(F.transform(F.arrays_zip(F.col("gap").alias("g"), F.concat(new, F.array(F.lit(""))).alias("m")), lambda x: F.concat(x["g"], x["m"])), "")
    kinds = F.transform("hits", lambda h: F.when(F.element_at(h, -1)["type"] == "surname", "name").otherwise(F.element_at(h, -1)["type"]))
    of = F.array(*(F.lit(t) for t in TYPES))
    counts = F.map_from_arrays(of, F.transform(of, lambda t: F.size(F.filter(kinds, lambda k: k == t)).cast("long")))
    done = joined.select("row", made.alias("made"), counts.alias("counts"), F.size(F.filter(kinds, lambda k: k.isNotNull())).cast("long").alias("n"))
    done = done.select(*(done["made"].alias(c) if c == "text" else done["row"].getField(f"c{i}").alias(c) for i, c in enumerate(names)), done["counts"].alias(counts_), done["n"].alias(n_))
    none = F.map_from_arrays(of, F.transform(of, lambda t: F.lit(0).cast("long")))
    return docs.where(~has).select(*names, none.alias(counts_), F.lit(0).cast("long").alias(n_)).unionByName(done)
