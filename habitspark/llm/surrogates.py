"""PII: keyed surrogates that match the original in type, gender, script and format.

Entities are found with one regular expression. Each gets a canonical form (case, blanks and
separators do not matter), and all writings of one canonical form get the same replacement, made from a
keyed hash character by character: digits stay digits, letters stay letters of the same case and script, separators stay. Card
numbers that pass their check digit still do, addresses of machines stay valid.

A person has a family name and perhaps a given name, and each part is an entity of its own: `Mr Smith` after `Mr John Smith`
keeps the family name that the full name got. A word alone after a title counts as a family name. Given names come from a list of the same gender and
script, different ones for different people of one family; once a list is used up, they are made of letters.

A replacement that two forms would share, or that is itself found in the data, is drawn again, for the clashing forms
alone, until all are distinct. From the fourth draw on replacements grow by a sign every four draws, so some length has
room for all (numbers may then be longer than their originals). Only column expressions are used.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitspark.plans.scale import broadcast_bytes_limit, join_hot, stored

# entities and forms in a task, at most about
TASK_ROWS = 4096
# kinds in order of precedence, with patterns (fixed values)
KINDS = {
    "email": r"(?:\G|(?<![\p{L}\p{N}._%+-]))[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++){0,126}\.\p{L}{2,}",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|(?:sk|pk|ghp|xox[bp])[-_][A-Za-z0-9_-]{16,}|AKIA[0-9A-Z]{16})(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\p{L}\p{N}])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-])",
    "card": r"(?<![\d.-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\d-]|\.\d)",
    "name": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Miss|Herr|Frau|Mme|M|Señor|Señora|Sr|Sra)\.? \p{Lu}[\p{Ll}]+(?: \p{Lu}[\p{Ll}]+)?",
}
TITLES = {"f": r"^(?:Mrs|Ms|Miss|Frau|Mme|Señora|Sra)\b", "m": r"^(?:Mr|Herr|M|Señor|Sr)\b"}
# given names by gender and script (fixed values)
NAMES = {
    ("f", "latin"): "Anna Clara Elena Emma Julia Laura Maria Nina Sofia Vera".split(),
    ("m", "latin"): "Adam Daniel David Felix Jonas Leo Martin Oscar Simon Victor".split(),
    ("f", "cyrillic"): "Анна Вера Елена Ирина Мария Нина Ольга София".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Иван Максим Олег Павел Сергей".split(),
    ("f", "greek"): "Άννα Ελένη Μαρία Σοφία Κλειώ Δήμητρα".split(),
    ("m", "greek"): "Γιώργος Νίκος Πέτρος Ανδρέας Δημήτρης Κώστας".split(),
}
# first and last letters of the small alphabets, by code point (fixed values)
ALPHABETS = {"latin": (0x61, 26), "cyrillic": (0x430, 32), "greek": (0x3B1, 17)}
ANY = "(?:" + "|".join(f"(?:{p})" for p in KINDS.values()) + ")"
# what every text with an entity holds: a digit or @, a key's first letters, letters-only hexadecimal, a title before a capital
MAYBE = r"[@\d]|(?:sk|pk|ghp|xox[bp])[-_]|AKIA|[a-f]{32}|[A-F]{32}|(?:Mr|Mrs|Ms|Miss|Herr|Frau|Mme|M|Señor|Señora|Sr|Sra)\.? \p{Lu}"


def kind_of(e: Column) -> Column:
    out: Column = F.lit("name")
    for name in reversed(list(KINDS)):
        out = F.when(e.rlike(f"^(?:{KINDS[name]})$"), F.lit(name)).otherwise(out)
    return out


def canonical(kind: Column, e: Column) -> Column:
    """What all writings of one entity, other than a name, share."""
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(e, r"\D", ""))
        .when(kind == "iban", F.replace(e, F.lit(" "), F.lit("")))
        .otherwise(F.lower(e))
    )


def _gender(e: Column) -> Column:
    return F.when(e.rlike(TITLES["f"]), "f").otherwise("m")


def _script(c: Column) -> Column:
    return F.when(c.rlike(r"\p{IsCyrillic}"), "cyrillic").when(c.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _draw(h: Column, i: Column, below: int) -> Column:
    """Number below ``below`` from four hexadecimal digits of a 128-digit hash, another for each position."""
    at = F.pmod(i * 5, F.lit(124)) + 1
    return F.pmod(F.conv(F.substr(h, at, F.lit(4)), 16, 10).cast("int") + i * 7, F.lit(below))


def _letter(h: Column, i: Column, c: Column) -> Column:
    """Another letter of the same script and case."""
    out: Column = F.lit("")
    for script, (start, size) in ALPHABETS.items():
        letter = F.substr(F.lit("".join(chr(start + k) for k in range(size))), _draw(h, i, size) + 1, F.lit(1))
        out = letter if script == "latin" else F.when(_script(c) == script, letter).otherwise(out)
    return F.when(c == F.lower(c), out).otherwise(F.upper(out))


def _mapped(h: Column, e: Column, keep: Column, solid: bool = False) -> Column:
    """Replace letters and digits of ``e`` after the first ``keep`` characters.

    With ``solid``, for kinds of bounded length, positions count letters and digits only, so other separators or
    blanks change nothing.
    """
    signs = F.split(e, "")

    def one(c: Column, i: Column) -> Column:
        at = i
        if solid:
            at = F.length(F.regexp_replace(F.substr(e, F.lit(1), i + 1), r"[^\p{L}\p{N}]", ""))
        return (
            F.when(i < keep, c)
            .when(c.rlike(r"\d"), _draw(h, at, 10).cast("string"))
            .when(c.rlike(r"\p{L}"), _letter(h, at, c))
            .otherwise(c)
        )

    return F.array_join(F.transform(signs, one), "")


def _more(h: Column, attempt: Column, like: Column) -> Column:
    """Signs that are added when draws keep clashing: digits after a digit, else letters of the same script."""
    each = F.sequence(F.lit(1), F.shiftright(attempt, 2))
    last = F.right(like, F.lit(1))
    sign = lambda i: F.when(last.rlike(r"\d"), _draw(h, i + 40, 10).cast("string")).otherwise(_letter(h, i + 40, last))
    return F.when(attempt >= 4, F.array_join(F.transform(each, sign), "")).otherwise("")


def _luhn_sum(digits: Column) -> Column:
    """Sum of the check rule over a text of digits, the last one doubled."""
    n = F.length(digits)
    def part(a: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return a + F.when((n - i) % 2 == 0, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), part)


def _checked(original: Column, made: Column) -> Column:
    """Give a card number its check digit if the original had a right one."""
    body = lambda c: F.regexp_replace(F.regexp_replace(c, r"\D", ""), r"\d$", "")
    digit = lambda c: (F.pmod(F.lit(10) - _luhn_sum(body(c)) % 10, F.lit(10))).cast("string")
    good = digit(original) == F.substr(original, F.length(original), F.lit(1))
    return F.when(good, F.concat(F.regexp_replace(made, r"\d$", ""), digit(made))).otherwise(made)


def _number(h: Column, kind: Column, e: Column, attempt: Column) -> Column:
    """Phone, card, social security and account numbers."""
    code = F.length(F.regexp_extract(e, r"^(\+1[ .-]|\+\d{1,3}[ .-]|\+\d|)", 1))
    keep = F.when(kind == "phone", code).when(kind == "card", 1).when(kind == "iban", 2).otherwise(0)
    made = F.concat(_mapped(h, e, keep, solid=True), _more(h, attempt, e))
    return F.when(kind == "card", _checked(e, made)).otherwise(made)


def _secret(h: Column, kind: Column, e: Column, attempt: Column) -> Column:
    """Hexadecimal digests stay hexadecimal, other keys keep their first four signs."""
    plain = F.concat(F.substr(h, F.lit(1), F.length(e)), F.when(attempt >= 4, F.right(h, F.shiftright(attempt, 2))).otherwise(""))
    digest = F.when(e == F.lower(e), plain).otherwise(F.upper(plain))
    return F.when(e.rlike("^(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})$"), digest).otherwise(F.concat(_mapped(h, e, F.lit(4)), _more(h, attempt, e)))


def _email(h: Column, kind: Column, e: Column, attempt: Column) -> Column:
    tail = F.length(F.regexp_extract(e, r"(\.\p{L}+)$", 1))
    body = F.substr(e, F.lit(1), F.length(e) - tail)
    return F.concat(_mapped(h, body, F.lit(0)), _more(h, attempt, body), F.right(e, tail))


def _address(h: Column, kind: Column, e: Column, attempt: Column) -> Column:
    octets = F.transform(F.split(e, r"\."), lambda o, i: (_draw(h, i, 253) + 1).cast("string"))
    # no fifth part before 64 draws: four parts have room for nearly all addresses
    return F.array_join(F.when(attempt < 64, octets).otherwise(F.concat(octets, F.array((_draw(h, F.lit(9), 253) + 1).cast("string")))), ".")


def _family(h: Column, kind: Column, e: Column, attempt: Column) -> Column:
    return F.concat(_mapped(h, e, F.lit(0)), _more(h, attempt, e))


def _given(h: Column, kind: Column, e: Column, attempt: Column) -> Column:
    """``kind`` ends in the gender."""
    name: Column = F.lit("")
    for (gender, script), names in NAMES.items():
        others = F.array_except(F.lit(names), F.array(e))
        pick = F.element_at(others, F.pmod(_draw(h, F.lit(0), 9973), F.size(others)) + 1)
        name = F.when(kind.endswith(gender) & (_script(e) == script), pick).otherwise(name)
    return F.when(attempt < 8, name).otherwise(F.concat(_mapped(h, e, F.lit(0)), _more(h, attempt - 8, e)))


# makers by kind of part: one filtered branch each, so no plan holds all of them for every row
MAKERS = {
    ("phone", "card", "ssn", "iban"): _number, ("secret",): _secret, ("email",): _email, ("ip",): _address,
    ("family",): _family, ("given f", "given m"): _given,
}


def surrogates(parts: DataFrame, key: str) -> DataFrame:
    """Add ``new``, the replacement of the writing ``e`` of the part ``kind``, ``canon`` at a draw ``attempt``."""
    hashed = parts.withColumn("_h", F.sha2(F.concat_ws("\u0001", F.lit(key), "kind", "canon", F.col("attempt").cast("string")), 512))
    made = [
        hashed.filter(F.col("kind").isin(*kinds)).withColumn("new", maker(F.col("_h"), F.col("kind"), F.col("e"), F.col("attempt")))
        for kinds, maker in MAKERS.items()
    ]
    return reduce(DataFrame.unionByName, made).drop("_h")


def _spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """A small table lies in few files; its rows are costly, so they are dealt to tasks by number."""
    return df.repartition(max(1, -(-rows // TASK_ROWS)), *keys)


def _parts(entities: DataFrame) -> DataFrame:
    """``e``, ``kind`` of the entity, and its parts: ``at`` (order), ``part`` (kind), ``canon``, ``piece``, ``lead`` (title and blank)."""
    person = F.regexp_replace("e", r"^\S+ ", "")
    family = F.regexp_extract(person, r"(\S+)$", 1)
    given = F.regexp_extract(person, r"^(\S+) ", 1)
    gender = _gender(F.col("e"))
    row = lambda at, part, canon, piece: F.struct(F.lit(at).alias("at"), part.alias("part"), canon.alias("canon"), piece.alias("piece"))
    last = row(1, F.lit("family"), F.lower(family), family)
    first = row(0, F.concat(F.lit("given "), gender), F.lower(F.concat_ws("|", family, given)), given)
    whole = row(0, F.col("kind"), canonical(F.col("kind"), F.col("e")), F.col("e"))
    parts = F.when(F.col("kind") != "name", F.array(whole)).when(given == "", F.array(last)).otherwise(F.array(first, last))
    lead = F.when(F.col("kind") == "name", F.regexp_extract("e", r"^(\S+ )", 1)).otherwise("")
    return entities.withColumn("kind", kind_of(F.col("e"))).select("e", "kind", lead.alias("lead"), F.explode(parts).alias("p")).select("e", "kind", "lead", "p.*")


def mapping(entities: DataFrame, key: str) -> DataFrame:
    """Distinct replacements for distinct entities: ``e``, ``kind``, ``canon``, ``new``.

    ``entities`` has ``e``, once each. Two canonical forms of a kind never get the same replacement, and none gets a form that
    occurs in the data; the form that sorts first keeps a contested one. Given names are distinct within a family name and gender.
    """
    found = stored(entities)
    known = stored(_parts(_spread(found, found.count(), "e")))
    one = F.min("piece").alias("e")
    open_forms = stored(known.groupBy(F.col("part").alias("kind"), "canon").agg(one).withColumn("attempt", F.lit(0)))
    # a given name is taken within its family only
    within = F.when(F.col("kind").startswith("given"), F.regexp_extract("canon", r"^(.*)\|", 1)).otherwise("")
    taken = known.select(F.col("part").alias("kind"), "canon").distinct().select("kind", F.col("canon").alias("made"))
    settled: list[DataFrame] = []
    left = open_forms.count()
    while left:
        made = canonical(F.col("kind"), F.col("new"))
        whole = F.when(F.col("kind").startswith("given"), F.concat_ws("|", within, made)).otherwise(made)
        tried = stored(surrogates(_spread(open_forms, left, "kind", "canon"), key).select("kind", "canon", "e", "attempt", whole.alias("made")))
        owners = tried.groupBy("kind", "made").agg(F.min("canon").alias("owner"))
        for other in [taken, *[t.select("kind", "made") for t in settled]]:
            owners = owners.join(other, ["kind", "made"], "left_anti")
        judged = stored(tried.join(owners, ["kind", "made"], "left").withColumn("won", F.coalesce(F.col("owner") == F.col("canon"), F.lit(False))))
        settled.append(judged.filter("won").select("kind", "canon", "attempt", "made"))
        open_forms = judged.filter("not won").select("kind", "canon", "e", (F.col("attempt") + 1).alias("attempt"))
        left = open_forms.count()
        if len(settled) > 8:
            settled = [stored(reduce(DataFrame.unionByName, settled))]
    if not settled:
        return known.select("e", "kind", "canon", F.col("e").alias("new"))
    draws = stored(reduce(DataFrame.unionByName, settled).select(F.col("kind").alias("part"), "canon", "attempt"))
    placed = _matched(known, draws, ["part", "canon"], F.octet_length("canon") * 2 + 96)
    writing = stored(placed.select(F.col("e").alias("whole"), F.col("kind").alias("of"), "lead", "at", F.col("part").alias("kind"), "canon", F.col("piece").alias("e"), "attempt"))
    pieces = surrogates(_spread(writing, writing.count(), "whole"), key)
    told = F.sort_array(F.collect_list(F.struct("at", "new", "canon")))
    joined = pieces.groupBy("whole", "of", "lead").agg(told.alias("told"))
    return joined.select(
        F.col("whole").alias("e"), F.col("of").alias("kind"), F.array_join("told.canon", " ").alias("canon"),
        F.concat("lead", F.array_join("told.new", " ")).alias("new"),
    )


def _matched(big: DataFrame, lookup: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """Join written rows with one row per key, which are broadcast if few; keys with very many rows are joined apart."""
    total = lookup.agg(F.sum(size)).first()[0] or 0
    if total <= broadcast_bytes_limit(big.sparkSession):
        return big.join(F.broadcast(lookup), keys)
    return join_hot(big, lookup, keys, "inner")


def _small(df: DataFrame, size: Column) -> DataFrame:
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if total <= broadcast_bytes_limit(df.sparkSession) else df


def replace_entities(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, ``text`` with replacements, ``n_entities``, ``kinds`` (sorted, distinct) and the columns ``keep``.

    A null text stays null and holds nothing. Rows that share an id are treated alike. Every
    row comes back.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), *[F.col(k).alias(f"_keep_{k}") for k in keep])
    maybe = rows.select("doc_id", "text").filter(F.col("text").rlike(MAYBE))
    found = stored(
        maybe.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({ANY})"), F.lit(1)))).alias("e"))
    )
    names = stored(mapping(found.select("e").distinct(), key))
    per_doc = (
        _matched(found, names, ["e"], F.octet_length("e") * 4 + 96)
        .groupBy("doc_id")
        .agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("e", "new")))).alias("_new"), F.sort_array(F.collect_set("kind")).alias("_kinds"))
        .withColumnRenamed("doc_id", "_id")
    )
    per_doc = stored(per_doc)
    hinted = _small(per_doc, F.size("_new") * 160 + 96)
    joined = rows.join(hinted, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    hits = F.regexp_extract_all("text", F.lit(f"({ANY})"), F.lit(1))
    parts = F.split("text", ANY, -1)
    said = F.concat(F.transform(hits, lambda e: F.element_at("_new", e)), F.array(F.lit("")))
    changed = F.array_join(F.zip_with(parts, said, lambda p, e: F.concat(p, e)), "")
    touched = F.col("_new").isNotNull() & F.col("text").isNotNull()
    return joined.select(
        "doc_id",
        F.when(touched, changed).otherwise(F.col("text")).alias("text"),
        F.when(touched, F.size(hits)).otherwise(0).alias("n_entities"),
        F.when(touched, F.col("_kinds")).otherwise(F.array().cast("array<string>")).alias("kinds"),
        *[F.col(f"_keep_{k}").alias(k) for k in keep],
    )
