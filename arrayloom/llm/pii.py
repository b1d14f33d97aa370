"""Personal data replaced by surrogates, in DataFrame functions only.

Detected entities (mail and IPv4 addresses, phone, card, social security and IBAN numbers, names after a title)
are replaced by values of the same type and format, drawn from a keyed digest of the entity's canonical form:
the same entity, however it is written, gets the same surrogate everywhere (coreference). Names keep gender
and script: feminine titles get feminine given names and endings, Cyrillic and Greek names such ones. Numbers
keep their punctuation, phones their country code, cards their first digit; valid check digits of cards and IBANs
are valid again.

Distinctness is checked over the corpus: entities whose surrogate another entity has, or that is itself an
entity of the corpus, draw again with the next attempt until there is no collision. Only those entities are
joined back to the texts; all others follow from the key alone, so texts aren't shuffled for them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayloom.llm._common import cut

# The types in order of precedence where they begin at one place, and their patterns.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)",
    "phone": r"(?<![\w.+-])(?:\+[0-9]{10,15}|(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)\x20?[0-9]{3,4}[\x20.-]?[0-9]{3,4}|(?<=[0-9][\x20.-])[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){2,4}|[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}|0[1-9](?:\x20[0-9]{2}){4}|0[0-9]{2,4}[\x20/-][0-9]{5,9}))(?![\w-])",
    "card": r"(?<![\w-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\w-])",
    "name": r"(?<!\p{L})(?:Mrs|Mr|Ms|Miss|Frau|Herr|Señora|Señor|Monsieur|Madame|Mme|Госпожа|Господин|Κυρία|Κύριος)\.?\x20\p{Lu}[\p{L}'-]+(?:\x20\p{Lu}[\p{L}'-]+)?",
}
KINDS = tuple(PATTERNS)
ANY = "|".join(PATTERNS.values())
#: What every entity has: an @, four digits with little between them, two capitals before two digits, or a title. Texts without aren't searched further.
HINT = r"@|[0-9](?:[\x20.()/-]{0,2}[0-9]){3}|[A-Z]{2}[0-9]{2}|(?:M(?:rs?|s|iss|me|onsieur|adame)|Frau|Herr|Señora?|Госпо|Κύρι|Κυρί)\p{L}*\.?\x20\p{Lu}"
NUMBERS = ("ssn", "phone", "card")
FEMININE = r"^(?:Mrs|Ms|Miss|Frau|Señora|Madame|Mme|Госпожа|Κυρία)\b|^(?:Госпожа|Κυρία)"
# Given names and syllables by script, endings by script and gender.
GIVEN = {
    "latin": {"f": "anna clara elena emma eva helena ida julia laura lena maria marta nina paula sara sofia".split(), "m": "adam anton bruno carl david emil felix hugo jan leo lukas marco max paul simon victor".split()},
    "cyrillic": {"f": "анна вера дарья елена ирина мария нина ольга".split(), "m": "антон борис глеб иван лев олег павел пётр".split()},
    "greek": {"f": "άννα ελένη ειρήνη μαρία σοφία ζωή".split(), "m": "άγγελος γιώργος νίκος πέτρος σταύρος φώτης".split()},
}
SYLLABLES = {"latin": "bal ber cor dan del fan gar hal jor kel lin mar nor pel ros tam".split(), "cyrillic": "бел бор вас гор дан зор кар лев мар нов пав ром сав тим фед яр".split(), "greek": "αλ βασ γαλ δημ ευ ζαχ θε καλ λαμ μαρ νικ παπ ραλ στα τζα φιλ".split()}
ENDINGS = {"latin": {"f": "er", "m": "er"}, "cyrillic": {"f": "ова", "m": "ов"}, "greek": {"f": "ίδου", "m": "ίδης"}}
#: From this attempt on a surrogate is longer than its entity: its format alone has run out of values.
LONGER_FROM = 12
#: Rows up to which the table of redrawn entities is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 20_000


def _pick(kind: Column, values: dict[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in reversed(values.items()):
        out = F.when(kind == k, v).otherwise(out)
    return out


def kind_of(value: Column) -> Column:
    return reduce(lambda rest, k: F.when(F.regexp_like(value, F.lit(f"^(?:{PATTERNS[k]})$")), F.lit(k)).otherwise(rest), reversed(KINDS), F.lit("phone"))


def _bare(value: Column) -> Column:
    return F.regexp_replace(value, r"[^A-Za-z0-9]", "")


def canonical(kind: Column, value: Column) -> Column:
    """What is the same however an entity is written; a name's begins with gender and script."""
    gender = F.when(F.regexp_like(value, F.lit(FEMININE)), F.lit("f")).otherwise(F.lit("m"))
    name = F.lower(F.regexp_replace(value, r"^\p{L}+\.?\x20", ""))
    script = F.when(F.regexp_like(name, F.lit(r"\p{IsCyrillic}")), F.lit("cyrillic")).when(F.regexp_like(name, F.lit(r"\p{IsGreek}")), F.lit("greek")).otherwise(F.lit("latin"))
    values = {k: F.regexp_replace(value, "[^0-9]", "") for k in NUMBERS}
    values |= {"email": F.lower(value), "ip": value, "iban": _bare(value), "name": F.concat_ws("|", gender, script, name)}
    return _pick(kind, values)


def digest(key: str, *parts: Column) -> Column:
    """64 hexadecimal digits of a keyed hash (nested, as in HMAC)."""
    inner = F.sha2(F.concat_ws("\x01", F.lit("i" + key), *parts).cast("binary"), 256)
    return F.sha2(F.concat(F.lit("o" + key), inner).cast("binary"), 256)


def _byte(hexes: Column, i: Column) -> Column:
    """Byte i (modulo 32) of a digest."""
    return F.conv(F.substring(hexes, (2 * (i % 32) + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _like(text: Column, hexes: Column) -> Column:
    """The text with each letter and digit replaced by one of its class, as the digest has it."""
    nth = lambda letters, b: F.substring(F.lit(letters), (b % len(letters) + 1).cast("int"), F.lit(1))

    def one(c: Column, i: Column) -> Column:
        b = _byte(hexes, i)
        return F.when(F.regexp_like(c, F.lit("[0-9]")), nth("0123456789", b)).when(F.regexp_like(c, F.lit("[A-Z]")), nth("ABCDEFGHIJKLMNOPQRSTUVWXYZ", b)).when(F.regexp_like(c, F.lit(r"\p{L}")), nth("abcdefghijklmnopqrstuvwxyz", b)).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(text, "", -1), lambda c: c != ""), one), "")


def luhn_sum(digits: Column) -> Column:
    """The sum of a number's digits, every second one from the right doubled (9 taken off above 9)."""
    listed = F.reverse(F.filter(F.split(digits, "", -1), lambda c: c != ""))
    doubled = F.transform(listed, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b)


def mod_97(canon: Column) -> Column:
    """The rest of an IBAN by 97: its first four characters behind the others, letters as 10 to 35."""
    turned = F.concat(F.substring(canon, F.lit(5), F.length(canon)), F.substring(canon, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        digit = F.regexp_like(c, F.lit("[0-9]"))
        value = F.when(digit, F.ascii(c) - 48).otherwise(F.ascii(F.upper(c)) - 55)
        return (rest * F.when(digit, 10).otherwise(100) + value) % 97

    return F.aggregate(F.filter(F.split(turned, "", -1), lambda c: c != ""), F.lit(0), add)


def _name(canon: Column, hexes: Column, attempt: Column) -> Column:
    """A name as long (in words) as the canonical one, in its script, with its gender."""
    bits = F.split(canon, r"\|")
    gender, script, words = F.get(bits, 0), F.get(bits, 1), F.split(F.get(bits, 2), " ")
    out = F.lit(None).cast("string")
    for s in GIVEN:
        syllable = lambda i, s=s: F.get(F.array(*map(F.lit, SYLLABLES[s])), _byte(hexes, F.lit(i)) % len(SYLLABLES[s]))
        for g in "fm":
            family = F.concat(syllable(1), syllable(2), syllable(3), F.when(attempt >= LONGER_FROM, F.concat(syllable(4), syllable(5))).otherwise(F.lit("")), F.lit(ENDINGS[s][g]))
            given = F.get(F.array(*map(F.lit, GIVEN[s][g])), _byte(hexes, F.lit(0)) % len(GIVEN[s][g]))
            out = F.when((script == s) & (gender == g), F.when(F.size(words) > 1, F.concat_ws(" ", given, family)).otherwise(family)).otherwise(out)
    return F.concat_ws("|", gender, script, out)


def surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The canonical form of an entity's surrogate."""
    hexes = digest(key, kind, canon, attempt.cast("string"))
    more = F.when(attempt >= LONGER_FROM, F.substring(F.translate(hexes, "0123456789", "ghijklmnop"), 40, 8)).otherwise(F.lit(""))
    domain = F.regexp_extract(canon, "@(.*)$", 1)
    top = F.regexp_extract(domain, r"(\.[^.]*)$", 1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    mail = F.concat(_like(F.regexp_extract(canon, "^([^@]*)@", 1), hexes), more, F.lit("@"), _like(host, digest(key, F.lit("domain"), domain)), top)
    address = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_byte(hexes, i) * 256 + _byte(hexes, i + 7)) % 254 + 1), ".")
    keep = F.greatest(F.lit(0), F.length(canon) - 10)
    phone = F.concat(F.substring(canon, F.lit(1), keep), F.regexp_replace(_like(F.substring(canon, keep + 1, F.length(canon)), hexes), "^0", "7"))
    body = F.concat(F.substring(canon, 1, 1), _like(F.substring(canon, F.lit(2), F.length(canon) - 2), hexes))
    check = ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    card = F.when(luhn_sum(canon) % 10 == 0, F.concat(body, check)).otherwise(F.concat(body, F.substring(_like(canon, hexes), -1, 1)))
    country, account = F.substring(canon, 1, 2), _like(F.substring(canon, F.lit(5), F.length(canon)), hexes)
    valid = F.lpad((98 - mod_97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0")
    # check digits that don't fit stay so
    iban = F.concat(country, F.when(mod_97(canon) == 1, valid).otherwise(F.substring(canon, 3, 2)), account)
    return _pick(kind, {"email": mail, "ip": address, "ssn": _like(canon, hexes), "iban": iban, "phone": phone, "card": card, "name": _name(canon, hexes, attempt)})


def written(kind: Column, value: Column, drawn: Column) -> Column:
    """A surrogate's canonical form, written as the entity was."""
    slots = F.filter(F.split(value, "", -1), lambda c: c != "")
    state = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def fill(s: Column, c: Column) -> Column:
        slot = F.regexp_like(c, F.lit("[A-Za-z0-9]"))
        return F.struct(F.concat(s["out"], F.when(slot, F.substring(drawn, s["at"], F.lit(1))).otherwise(c)).alias("out"), F.when(slot, s["at"] + 1).otherwise(s["at"]).alias("at"))

    filled = F.aggregate(slots, state, fill)["out"]
    shout = (F.upper(value) == value) & (F.lower(value) != value)
    title = F.regexp_extract(value, r"^(\p{L}+\.?\x20)", 1)
    name = F.get(F.split(drawn, r"\|"), 2)
    family = F.regexp_replace(value, r"^\p{L}+\.?\x20", "")
    name = F.concat(title, F.when(F.upper(family) == family, F.upper(name)).otherwise(F.initcap(name)))
    return F.when(kind == "name", name).when(kind == "ip", drawn).when(kind == "email", F.when(shout, F.upper(drawn)).otherwise(drawn)).otherwise(filled)


def resolve(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt) of the distinct ``entities(kind, canon)`` whose first surrogate collides.

    Of entities with one surrogate the smallest keeps it; a surrogate that is an entity of the corpus is drawn
    anew. Rounds go on until no collision is left; each is two joins of the entities alone.
    """
    real = cut(entities.distinct())
    now = real.withColumn("attempt", F.lit(0))
    while True:
        drawn = cut(now.withColumn("drawn", surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt"))))
        taken = drawn.groupBy("kind", "drawn").agg(F.min("canon").alias("holder"))
        known = real.select("kind", F.col("canon").alias("drawn"), F.lit(True).alias("is_real"))
        judged = drawn.join(taken, ["kind", "drawn"]).join(known, ["kind", "drawn"], "left")
        judged = cut(judged.select("kind", "canon", "attempt", (F.col("is_real").isNotNull() | (F.col("canon") != F.col("holder"))).alias("clash")))
        if judged.where("clash").isEmpty():
            return judged.where("attempt > 0").select("kind", "canon", "attempt")
        now = judged.select("kind", "canon", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt"))


def found_in(text: Column) -> Column:
    """Entities of a text in order: struct<kind, value, canon>."""
    values = F.when(F.regexp_like(text, F.lit(HINT)), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    kinds = F.transform(values, lambda v: F.struct(kind_of(v).alias("kind"), v.alias("value")))
    return F.transform(kinds, lambda e: F.struct(e["kind"].alias("kind"), e["value"].alias("value"), canonical(e["kind"], e["value"]).alias("canon")))


def replace_personal_data(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text, n_email, n_ip, n_ssn, n_iban, n_phone, n_card, n_name for every row of ``docs(doc_id, text)``.

    ``text`` has all detected entities replaced; the counts are of replaced places. A null text stays null with
    counts 0; null ids and repeated rows stay; texts of any length are read whole; an empty table gives no rows;
    other columns are ignored.
    """
    if not key:
        raise ValueError("a key is needed")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("found", found_in(F.coalesce("text", F.lit(""))))
    places = own.where(F.size("found") > 0).select("doc_id", F.xxhash64("text").alias("hash"), F.posexplode("found").alias("at", "e"))
    redrawn = cut(resolve(places.select("e.kind", "e.canon"), key))
    n = redrawn.count()
    attempts = F.lit(None).cast("map<int,int>")
    if n:
        table = F.broadcast(redrawn) if n <= BROADCAST_ROWS else redrawn
        some = places.select("doc_id", "hash", "at", "e.kind", "e.canon").distinct().join(table, ["kind", "canon"])
        some = cut(some.groupBy("doc_id", "hash").agg(F.map_from_entries(F.collect_list(F.struct("at", "attempt"))).alias("attempts")).withColumnsRenamed({"doc_id": "other_id", "hash": "other_hash"}))
        few = some.count() <= BROADCAST_ROWS
        own = own.join(F.broadcast(some) if few else some, F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.xxhash64("text") == F.col("other_hash")), "left")
        attempts = F.col("attempts")
    draw = lambda e, i: written(e["kind"], e["value"], surrogate(key, e["kind"], e["canon"], F.coalesce(F.element_at(attempts, i), F.lit(0))))
    parts = F.split(F.col("text"), ANY, -1)
    mixed = F.zip_with(parts, F.concat(F.transform(F.col("found"), draw), F.array(F.lit(""))), lambda p, d: F.concat(p, d))
    text = F.when(F.size("found") > 0, F.array_join(mixed, "")).otherwise(F.col("text"))
    count = lambda k: F.size(F.filter("found", lambda e: e["kind"] == k)).cast("long")
    return own.select("doc_id", text.alias("text"), *[count(k).alias(f"n_{k}") for k in KINDS])
