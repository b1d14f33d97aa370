"""Formats, coreference and distinctness of surrogates."""

import hashlib
import random
import re

import regex
from pyspark.sql import functions as F

from arrayloom.llm import pii

KEY = "test key"


def run(spark, texts):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_name int")
    got = pii.replace_personal_data(df, KEY).collect()
    assert len(got) == len(texts)
    return {r.doc_id: r for r in got}


def test_formats_and_coreference(spark):
    texts = [
        "Write to jane.doe@mail5.example.com or JANE.DOE@MAIL5.EXAMPLE.COM now.",
        "Call +1 (743) 555-3824, then +1 743-555-3824; server 152.143.123.131 (not 999.1.2.3).",
        "Cards 4111111111111111, 4111-1111-1111-1111 and 4785380592391139\"###.",
        "SSN 123-45-6789, IBAN DE89 3704 0044 0532 0130 00.",
        "Mrs Smith met Mr. John Brown, Frau MÜLLER, Господин Петров and Госпожа Петрова. Mrs Smith left.",
        "Nothing here: version 1.2.3, 12 of 40, e@, @b.com, mid.point", "", None, "jane.doe@mail5.example.com",
    ]
    got = run(spark, texts)
    for i in (5, 6, 7):
        assert got[i].text == texts[i] and sum(got[i][2:]) == 0
    mail = re.findall(r"\S+@\S+", got[0].text)
    assert mail[0].upper() == mail[1] and mail[0] != "jane.doe@mail5.example.com" and got[8].text == mail[0]
    assert re.fullmatch(r"[a-z]{4}\.[a-z]{3}@[a-z]{4}\d\.[a-z]{7}\.com", mail[0])
    phones = re.search(r"Call (\+1 \(\d{3}\) \d{3}-\d{4}), then (\+1 \d{3}-\d{3}-\d{4}); server (\d+\.\d+\.\d+\.\d+) \(not 999", got[1].text)
    digits = lambda s: re.sub(r"\D", "", s)
    assert digits(phones[1]) == digits(phones[2]) != "17435553824" and phones[3] != "152.143.123.131"
    assert got[1].n_phone == 2 and got[1].n_ip == 1
    cards = re.search(r"Cards (\d{16}), (\d{4}-\d{4}-\d{4}-\d{4}) and (\d{16})\"###\.", got[2].text)
    assert cards[1] == digits(cards[2]) and cards[1][0] == "4" and cards[1] != "4" + "1" * 15
    luhn = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(cards[1])))
    assert luhn % 10 == 0
    assert re.fullmatch(r"SSN \d{3}-\d{2}-\d{4}, IBAN DE\d\d( \d{4}){4} \d\d\.", got[3].text) and "123-45-6789" not in got[3].text
    names = re.fullmatch(r"Mrs (\w+) met Mr\. (\w+) (\w+), Frau ([A-Z]+), Господин (\w+ов) and Госпожа (\w+ова)\. Mrs (\w+) left\.", got[4].text)
    assert names and names[1] == names[7] and names[2].lower() in pii.GIVEN["latin"]["m"] and got[4].n_name == 6
    assert "Smith" not in got[4].text


def test_distinct_surrogates(spark):
    # two-letter hosts and one-letter names: far fewer values than entities
    texts = [f"{a}@ab.com" for a in "abcdefghijklmnopqrstuvwxyz"] + [f"Mr {a}{b}x" for a in "ABCDEFGH" for b in "abcdefghij"]
    got = run(spark, texts * 2)
    seen = [got[i].text for i in range(len(texts))]
    assert len(set(seen)) == len(texts) and not set(seen) & set(texts)
    assert [got[len(texts) + i].text for i in range(len(texts))] == seen


def test_resolve_counts_real_entities(spark):
    first = spark.createDataFrame([("ip", "1.2.3.4")], "kind string, canon string")
    drawn = first.select(pii.surrogate(KEY, F.col("kind"), F.col("canon"), F.lit(0))).first()[0]
    again = pii.resolve(spark.createDataFrame([("ip", "1.2.3.4"), ("ip", drawn)], "kind string, canon string"), KEY)
    assert [tuple(r) for r in again.where("canon = '1.2.3.4'").collect()] == [("ip", "1.2.3.4", 1)]


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, "a.b@c.de"), (1, None), (1, "a.b@c.de"), (1, "a.b@c.de")], "doc_id long, text string")
    got = pii.replace_personal_data(df, KEY).collect()
    assert len(got) == 4 and len({r.text for r in got if r.text}) == 1
    assert pii.replace_personal_data(df.where("false"), KEY).count() == 0


# A plain version: Python's regular expressions and hashes, one text after the other.
def plain_kind(value):
    return next((k for k, p in pii.PATTERNS.items() if regex.fullmatch(p, value)), "phone")


def plain_canon(kind, value):
    if kind in pii.NUMBERS:
        return re.sub("[^0-9]", "", value)
    if kind == "name":
        name = regex.sub(r"^\p{L}+\.?\x20", "", value).lower()
        script = "cyrillic" if regex.search(r"\p{Cyrillic}", name) else "greek" if regex.search(r"\p{Greek}", name) else "latin"
        return "|".join(["f" if regex.search(pii.FEMININE, value) else "m", script, name])
    return {"email": value.lower(), "ip": value, "iban": re.sub("[^A-Za-z0-9]", "", value)}[kind]


def plain_digest(*parts):
    inner = hashlib.sha256("\x01".join(["i" + KEY, *parts]).encode()).hexdigest()
    return hashlib.sha256(("o" + KEY + inner).encode()).digest()


def plain_like(text, code):
    out = ""
    for i, c in enumerate(text):
        letters = "0123456789" if c in "0123456789" else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if "A" <= c <= "Z" else "abcdefghijklmnopqrstuvwxyz" if c.isalpha() else None
        out += letters[code[i % 32] % len(letters)] if letters else c
    return out


def plain_luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits)))


def plain_mod_97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def plain_surrogate(kind, canon, attempt):
    code = plain_digest(kind, canon, str(attempt))
    assert attempt < pii.LONGER_FROM
    if kind == "email":
        user, domain = canon.split("@")
        host, dot, top = domain.rpartition(".")
        return f"{plain_like(user, code)}@{plain_like(host, plain_digest('domain', domain))}{dot}{top}"
    if kind == "ip":
        return ".".join(str((code[i] * 256 + code[i + 7]) % 254 + 1) for i in range(4))
    if kind == "ssn":
        return plain_like(canon, code)
    if kind == "phone":
        kept = max(0, len(canon) - 10)
        return canon[:kept] + re.sub("^0", "7", plain_like(canon[kept:], code))
    if kind == "card":
        body = canon[0] + plain_like(canon[1:-1], code)
        return body + (str(-plain_luhn(body + "0") % 10) if plain_luhn(canon) % 10 == 0 else plain_like(canon, code)[-1])
    if kind == "iban":
        account = plain_like(canon[4:], code)
        return canon[:2] + (f"{98 - plain_mod_97(canon[:2] + '00' + account):02d}" if plain_mod_97(canon) == 1 else canon[2:4]) + account
    gender, script, name = canon.split("|")
    given, syllables = pii.GIVEN[script][gender], pii.SYLLABLES[script]
    family = "".join(syllables[code[i] % len(syllables)] for i in (1, 2, 3)) + pii.ENDINGS[script][gender]
    return f"{gender}|{script}|" + (f"{given[code[0] % len(given)]} {family}" if " " in name else family)


def plain_written(kind, value, drawn):
    if kind == "name":
        title, family = regex.fullmatch(r"(\p{L}+\.?\x20)(.*)", value).groups()
        name = drawn.split("|")[2]
        return title + (name.upper() if family.upper() == family else " ".join(w.capitalize() for w in name.split(" ")))
    if kind == "ip":
        return drawn
    if kind == "email":
        return drawn.upper() if value.upper() == value and value.lower() != value else drawn
    letters = iter(drawn)
    return "".join(next(letters, "") if re.match("[A-Za-z0-9]", c) else c for c in value)


def plain_replaced(texts):
    found = [[(plain_kind(m[0]), m[0], m.span()) for m in regex.finditer(pii.ANY, t or "")] for t in texts]
    attempts = {(k, plain_canon(k, v)): 0 for many in found for k, v, _ in many}
    while True:
        drawn = {e: (e[0], plain_surrogate(*e, n)) for e, n in attempts.items()}
        holder = {}
        for e in sorted(attempts):
            holder.setdefault(drawn[e], e)
        clash = [e for e in attempts if drawn[e] in attempts or holder[drawn[e]] != e]
        if not clash:
            break
        for e in clash:
            attempts[e] += 1
    out = []
    for t, many in zip(texts, found, strict=True):
        for k, v, (a, b) in reversed(many):
            t = t[:a] + plain_written(k, v, drawn[k, plain_canon(k, v)][1]) + t[b:]
        out.append((t, [sum(k == x for k, *_ in many) for x in pii.KINDS]))
    return out


SAMPLES = {
    "email": ["jane.doe@mail5.example.com", "A.B@C.DE", "x_y%1@a-b.co", "élan@ab.fr"], "ip": ["1.2.3.4", "255.255.255.0"], "ssn": ["123-45-6789"],
    "iban": ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82WESTABCDEFGH", "GB82 WEST 1234 5698 7654 32", "XX00ABCDABCDABCD"],
    "phone": ["+1 (743) 555-3824", "(030) 1234567", "+44 20 7946 0958", "555-123-4567", "555 123 4567", "+15551234567", "0171 2345678", "030 12345678", "01 23 45 67 89", "0711/1234567"],
    "card": ["4111111111111111", "4111-1111-1111-1112", "5500 0000 0000 0004"],
    "name": ["Mrs Smith", "Mr. John Brown", "Frau MÜLLER", "Господин Петров", "Госпожа Петрова", "Κυρία Παππά", "Κύριος Νίκος", "Señora Díaz"],
}


def test_hint_covers_all_patterns():
    rng = random.Random(6)
    letters = "AB9x1 .-+()/@"
    values = [v for many in SAMPLES.values() for v in many] + ["".join(rng.choice(letters) for _ in range(rng.randint(4, 30))) for _ in range(200_000)]
    values += ["".join(rng.choice(f"{v[k]}{v[k]}{v[k]}{v[k]}7A ") for k in range(len(v))) for _ in range(1500) for many in SAMPLES.values() for v in many]
    found = [v for v in values if regex.search(pii.ANY, v)]
    assert len(found) > 5000 and all(regex.search(pii.HINT, v) for v in found)


def test_against_a_plain_version(spark, sf_dir):
    assert all(plain_kind(v) == k for k, many in SAMPLES.items() for v in many if v != "01 23 45 67 89")
    made = [f"Say {v}, or {v}." for many in SAMPLES.values() for v in many]
    made += [f"{a}@ab.com and Mr {a.upper()}xy" for a in "abcdefghij"]
    texts = [*made, None, "", "x" * 300_000 + " 1.2.3.4", *(r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())]
    want = plain_replaced(texts)
    got = run(spark, texts)
    for i, (text, counts) in enumerate(want):
        row = got[i]
        assert row.text == text and list(row[2:]) == counts, (texts[i][:200], row.text[:200], text[:200])
    assert all(sum(c) for _, c in want[: len(made)]) and all(m not in got[i].text for i, m in enumerate(v for many in SAMPLES.values() for v in many))


def test_ibans_stay_valid(spark):
    got = run(spark, ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "DE88370400440532013000"])
    valid = [plain_mod_97(got[i].text.replace(" ", "")) == 1 for i in range(3)]
    assert valid == [True, True, False] and got[0].text[:2] == "DE" and got[1].text[:2] == "GB"
