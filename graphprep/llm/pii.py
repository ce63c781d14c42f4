"""Personal data replaced by surrogates, with DataFrame functions alone.

Entities are found by pattern. Each gets a surrogate of its kind from a keyed hash of its canonical form, so the same entity
gets the same surrogate in every document and every spelling (coreference), and nobody without the key can compute it.
Surrogates keep the format: digits stay digits at their places, letters keep case and script, card numbers keep passing or
failing the Luhn check and account numbers theirs, names keep their script and the gender that the title before them tells, addresses get reserved
domains. A check over all entities of the table then looks for surrogates that two entities share or that some entity
already has; those are hashed again with a higher attempt number until none is left. Only these few exceptions are looked
up; all other surrogates are computed in the row.

Kinds: email, ip, card, phone, ssn, iban, secret (hexadecimal keys), name (behind a title).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphprep.llm.common import fresh, materialize

#: Exceptions up to this number are looked up in a constant of the plan; more are joined to the documents that hold them.
CONSTANT_EXCEPTIONS = 1000
#: From this attempt on surrogates of short entities grow, so that a crowded format cannot block the search.
GROW_AT = 3
MOST_ATTEMPTS = 40

# Titles that tell a gender, patterns of the kinds, syllables of the made-up names by script.
MALE = "Mr|Mister|Herr|Monsieur|Señor|Sr|Господин|г-н"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа|г-жа"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]+@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)*\.\p{L}{2,}",
    "secret": r"(?<![0-9A-Za-z])(?=[A-Fa-f]*\d)(?=\d*[A-Fa-f])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3})(?!\d)",
    "name": rf"(?<!\p{{L}})(?:{FEMALE}|{MALE})\.? \p{{Lu}}[\p{{L}}'’\-]+(?: \p{{Lu}}[\p{{L}}'’\-]+)?",
}
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "ha", "ke", "li", "mo", "na", "pe", "ri", "so", "ta", "ve", "wi", "zo"],
    "cyrillic": ["ба", "ве", "ги", "до", "же", "за", "ки", "ло", "ма", "не", "пи", "ро", "са", "те", "фи", "хо"],
    "greek": ["βα", "γε", "δι", "ζο", "θα", "κε", "λι", "μο", "να", "πε", "ρι", "σο", "τα", "φε", "χι", "ψο"],
}
FEMALE_END = {"latin": "na", "cyrillic": "на", "greek": "να"}
MALE_END = {"latin": "n", "cyrillic": "н", "greek": "ν"}
LOWER = {"cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}

ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every pattern needs at least; texts without it are not searched further.
HINT = rf"[@0-9]|{FEMALE}|{MALE}"


def _only(x: Column, what: str) -> Column:
    return F.regexp_replace(x, rf"[^{what}]", "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _mod97(text: Column) -> Column:
    """The remainder by 97 of a text of digits and capital letters, letters standing for 10 to 35."""
    step = lambda s, c: F.when(c.rlike("[0-9]"), s * 10 + F.ascii(c) - 48).otherwise(s * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban(canon: Column, chars: Column) -> Column:
    """A country with new characters behind it; its check digits are right if those of canon are, and wrong otherwise."""
    country, own = F.substring(canon, 1, 2), F.substring(chars, F.lit(5), F.length(canon))
    right = _mod97(F.concat(F.substring(canon, F.lit(5), F.length(canon)), F.substring(canon, 1, 4))) == 1
    check = 98 - _mod97(F.concat(own, country, F.lit("00")))
    return F.concat(country, F.lpad(F.when(right, check).otherwise((check - 1) % 97 + 2).cast("string"), 2, "0"), own)


def _kind(m: Column) -> Column:
    """The kind of a match; the first in the order of PATTERNS that covers it whole."""
    out = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(m.rlike(rf"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def _canonical(kind: Column, m: Column) -> Column:
    """What all spellings of an entity share."""
    person = F.lower(F.regexp_replace(m, rf"^(?:{FEMALE}|{MALE})\.? ", ""))
    gender = F.when(m.rlike(rf"^(?:{FEMALE})\.? "), F.lit("f")).otherwise(F.lit("m"))
    return (
        F.when(kind.isin("card", "phone", "ssn"), _only(m, "0-9"))
        .when(kind.isin("email", "secret"), F.lower(m))
        .when(kind == "iban", _only(m, "A-Z0-9"))
        .when(kind == "name", F.concat(gender, F.lit(":"), person))
        .otherwise(m)
    )


def _stream(key: str, *parts: Column) -> Column:
    """128 hexadecimal digits that the key and the parts decide."""
    seed = F.concat_ws("\x1f", F.lit(key), *parts)
    return F.concat(F.sha2(F.concat(seed, F.lit("\x1f0")), 256), F.sha2(F.concat(seed, F.lit("\x1f1")), 256))


def _number(stream: Column, i: Column, below: int) -> Column:
    """The i-th number (from 0) of the stream below a bound of at most 64."""
    return (F.conv(F.substring(stream, F.pmod(i * 3, F.lit(126)) + 1, F.lit(3)), 16, 10).cast("int") % below).cast("int")


def _characters(text: Column, stream: Column) -> Column:
    """Each digit by a digit, each letter by a letter of its case and script; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        out = F.when(c.rlike("[0-9]"), _number(stream, i, 10).cast("string")).when(c.rlike("[A-Z]"), F.char(_number(stream, i, 26) + 65))
        for script, letters in LOWER.items():
            low = F.substring(F.lit(letters), _number(stream, i, len(letters)) + 1, F.lit(1))
            out = out.when(c.rlike(rf"\p{{Is{script.capitalize()}}}"), F.when(c == F.upper(c), F.upper(low)).otherwise(low))
        return out.when(c.rlike(r"\p{L}"), F.char(_number(stream, i, 26) + 97)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _script(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _people(x: Column, key: str) -> Column:
    """Made-up names, one for each name word; a word gets the same one wherever it stands in the same place and gender."""
    canon, attempt = x["canon"], x["attempt"]
    words = F.split(F.substring(canon, F.lit(3), F.length(canon)), " ")
    last = F.size(words) - 1
    steps = F.transform(words, lambda w, i: F.struct(w.alias("w"), (i == last).alias("last"), F.substring(canon, 1, 1).alias("gender"), _script(w).alias("script")))
    steps = F.transform(
        steps,
        lambda y: F.struct(
            y["last"].alias("last"),
            y["gender"].alias("gender"),
            y["script"].alias("script"),
            _stream(key, F.lit("name"), F.when(y["last"], F.lit("family")).otherwise(F.concat(F.lit("given"), y["gender"])), y["w"], F.when(y["last"], attempt).otherwise(F.lit(0)).cast("string")).alias("stream"),
            (F.lit(2) + F.when(y["last"], F.greatest(attempt - GROW_AT + 1, F.lit(0))).otherwise(0)).alias("parts"),
        ),
    )
    tables = F.create_map(*[v for script, parts in SYLLABLES.items() for v in (F.lit(script), F.array(*map(F.lit, parts)))])
    ends = F.create_map(*[F.lit(v) for script in SYLLABLES for v in (f"f{script}", FEMALE_END[script], f"m{script}", MALE_END[script])])

    def made(y: Column) -> Column:
        core = F.array_join(F.transform(F.sequence(F.lit(0), y["parts"]), lambda k: F.element_at(F.element_at(tables, y["script"]), _number(y["stream"], k, 16) + 1)), "")
        return F.initcap(F.concat(core, F.when(y["last"], F.lit("")).otherwise(F.element_at(ends, F.concat(y["gender"], y["script"])))))

    return F.array_join(F.transform(steps, made), " ")


def surrogates(items: Column, key: str) -> Column:
    """items: an array of structs (m, kind, canon, attempt). Gives structs (m, kind, made): made is the surrogate, itself in
    canonical spelling. Each step makes fields that the next one reads, so that no expression is written out twice."""
    items = F.transform(
        items,
        lambda x: F.struct(
            *[x[c].alias(c) for c in ("m", "kind", "canon", "attempt")],
            _stream(key, x["kind"], x["canon"], x["attempt"].cast("string")).alias("stream"),
            F.substring_index(x["canon"], "@", 1).alias("local"),
            F.substring_index(x["canon"], "@", -1).alias("domain"),
            F.when(x["kind"] == "card", _luhn(x["canon"])).alias("luhn"),
        ),
    )
    items = F.transform(
        items,
        lambda x: F.struct(
            *[x[c].alias(c) for c in ("m", "kind", "canon", "attempt", "stream", "luhn")],
            _characters(F.when(x["kind"] == "email", x["local"]).otherwise(x["canon"]), x["stream"]).alias("chars"),
            F.when(x["kind"] == "email", _characters(F.substring_index(x["domain"], ".", 1), _stream(key, F.lit("domain"), x["domain"]))).alias("domain"),
        ),
    )

    def made(x: Column) -> Column:
        kind, canon, stream, chars = x["kind"], x["canon"], x["stream"], x["chars"]
        country = F.greatest(F.length(canon) - 10, F.lit(0))
        phone = F.concat(F.substring(canon, F.lit(1), country), F.substring(chars, country + 1, F.lit(20)))
        head = F.substring(chars, F.lit(1), F.length(canon) - 1)
        last = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string")), lambda d: _luhn(F.concat(head, d)) == x["luhn"])
        card = F.concat(head, F.element_at(last, F.when(x["luhn"], F.lit(1)).otherwise(_number(stream, F.lit(40), 9) + 1)))
        email = F.concat(chars, F.when(x["attempt"] >= GROW_AT, F.substring(stream, F.lit(1), x["attempt"])).otherwise(F.lit("")), F.lit("@"), x["domain"], F.lit(".example"))
        ip = F.concat_ws(".", *[F.conv(F.substring(stream, i, 2), 16, 10) for i in (1, 3, 5, 7)])
        secret = F.substring(stream, F.lit(1), F.length(canon))
        return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone).when(kind == "ssn", chars).when(kind == "secret", secret).when(kind == "iban", _iban(canon, chars)).otherwise(_people(x, key))

    return F.transform(items, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), made(x).alias("made")))


def _spelt(kind: Column, m: Column, made: Column) -> Column:
    """A surrogate in the spelling of the match: its separators, its case, its title."""

    def placed(what: str) -> Column:
        nth = lambda i: F.length(_only(F.substring(m, F.lit(1), i + 1), what))
        return F.array_join(F.transform(F.split(m, ""), lambda c, i: F.when(c.rlike(rf"[{what}]"), F.substring(made, nth(i), F.lit(1))).otherwise(c)), "")

    case = F.when((m == F.upper(m)) & (m != F.lower(m)), F.upper(made)).otherwise(made)
    title = F.regexp_extract(m, rf"^(?:{FEMALE}|{MALE})\.? ", 0)
    return F.when(kind.isin("card", "phone", "ssn"), placed("0-9")).when(kind == "iban", placed("A-Z0-9")).when(kind.isin("email", "secret"), case).when(kind == "name", F.concat(title, made)).otherwise(made)


def _matches(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def find_entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (kind, canon), once for each entity of the table."""
    m = docs.select(F.explode(F.array_distinct(_matches(F.col(text)))).alias("m")).withColumn("kind", _kind(F.col("m")))
    return m.select("kind", _canonical(F.col("kind"), F.col("m")).alias("canon")).distinct()


def find_exceptions(entities: DataFrame, key: str) -> DataFrame:
    """Rows (kind, canon, attempt) of the entities whose first surrogate is taken by another entity or is one itself.

    Of entities that share a surrogate the one least in order keeps it. Every attempt is compared with all entities and with
    all surrogates given so far, so in the end surrogates are distinct and none is an entity of the table.
    """
    one = lambda attempt: F.array(F.struct(F.lit("").alias("m"), F.col("kind").alias("kind"), F.col("canon").alias("canon"), F.lit(attempt).alias("attempt")))
    made = lambda df, attempt: df.withColumn("made", F.element_at(surrogates(one(attempt), key), 1)["made"]).withColumn("attempt", F.lit(attempt))
    settled, open_ = None, entities
    for attempt in range(MOST_ATTEMPTS):
        tried = materialize(made(open_, attempt), "pii-tried")
        first = tried.groupBy("kind", "made").agg(F.min("canon").alias("owner"))
        taken = entities.select("kind", F.col("canon").alias("made"))
        if settled is not None:
            taken = taken.union(settled.select("kind", "made"))
        free = first.join(taken, ["kind", "made"], "left_anti").select("kind", F.col("owner").alias("canon"))
        open_ = materialize(tried.join(free, ["kind", "canon"], "left_anti").select("kind", "canon"), "pii-open")
        good = tried.join(free, ["kind", "canon"], "left_semi").select("kind", "canon", "made", "attempt")
        settled = good if settled is None else settled.union(good)
        if not open_.take(1):
            return settled.where("attempt > 0").select("kind", "canon", "attempt")
    raise RuntimeError("pii: no free surrogates left")


def replace_entities(docs: DataFrame, key: str, text: str = "text", id_col: str = "doc_id", count: str | None = None) -> DataFrame:
    """docs with every entity in the text replaced by its surrogate; all columns stay. count adds the number of replacements, in the
    place of a column of that name.

    A null text stays null, and has none; an empty one stays empty. Rows with equal or null ids are treated alike. Whole
    texts are searched, whatever their length. An empty table gives an empty result.
    """
    if not key:
        raise ValueError("a key is needed")
    columns = [c for c in docs.columns if c != count]
    found_in, own_id, attempts = (fresh(n, docs) for n in ("_pii_found", "_pii_id", "_pii_attempts"))
    entities = materialize(find_entities(docs, text), "pii-entities")
    exceptions = materialize(find_exceptions(entities, key), "pii-exceptions")
    few = exceptions.limit(CONSTANT_EXCEPTIONS + 1).collect()
    named = lambda kind, canon: F.concat(kind, F.lit("\x1f"), canon)
    base = docs
    if not few:
        attempt_of = lambda name: F.lit(0)
    elif len(few) <= CONSTANT_EXCEPTIONS:
        constant = F.create_map(*[F.lit(x) for r in few for x in (f"{r['kind']}\x1f{r['canon']}", r["attempt"])])
        attempt_of = lambda name: F.coalesce(F.element_at(constant, name), F.lit(0))
    else:
        held = docs.select(id_col, F.explode(F.array_distinct(_matches(F.col(text)))).alias("m")).withColumn("kind", _kind(F.col("m")))
        held = held.select(F.col(id_col).alias(own_id), "kind", _canonical(F.col("kind"), F.col("m")).alias("canon")).distinct().join(exceptions, ["kind", "canon"])
        maps = held.groupBy(own_id).agg(F.map_from_entries(F.collect_list(F.struct(named(F.col("kind"), F.col("canon")), "attempt"))).alias(attempts))
        base = docs.join(maps, docs[id_col].eqNullSafe(maps[own_id]), "left")
        attempt_of = lambda name: F.coalesce(F.element_at(attempts, name), F.lit(0))

    items = F.transform(found_in, lambda m: F.struct(m.alias("m"), _kind(m).alias("kind")))
    items = F.transform(items, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), _canonical(x["kind"], x["m"]).alias("canon")))
    items = F.transform(items, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), x["canon"].alias("canon"), attempt_of(named(x["kind"], x["canon"])).alias("attempt")))
    spelt = F.transform(surrogates(items, key), lambda x: _spelt(x["kind"], x["m"], x["made"]))
    found = base.withColumn(found_in, _matches(F.col(text)))
    gaps = F.split(F.col(text), ANY, -1)
    new = F.array_join(F.zip_with(gaps, spelt, lambda gap, s: F.concat(gap, F.coalesce(s, F.lit("")))), "")
    done = found.withColumn(text, F.when(F.size(found_in) > 0, new).otherwise(F.col(text)))
    extra = [F.size(found_in).cast("long").alias(count)] if count else []
    return done.select(*columns, *extra)
