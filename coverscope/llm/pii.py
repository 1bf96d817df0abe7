"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions only.

A text is cut at the matches of a pattern; every match that its own check validates (Luhn
digit of a card, check number of a bank account, areas of a social security number,
octets of an address, a date of the calendar) is replaced by a keyed permutation of itself
within its format, and the pieces are put together again. The permutation depends on the
key, the kind and the value alone, so equal values (however they are punctuated) stay
linked across documents.

This is done in passes, the surest kinds first. A match whose check fails goes back into
the text, and the next pass looks there again for a shorter or another kind; a replaced
one is hidden from later passes. Within a pass matches are taken from the left.

Kinds: email (lower case; letters and digits of the name, and of the domain without its
last label, each in its own alphabet), iban (country kept, the new check number is valid),
key (access keys with a known prefix, which is kept), ipv4, date (1900 to 2099; the new
one is a date of that range in the same notation), ssn, hex (secrets of 32 to 64 hex
digits), card (13 to 19 digits; the new check digit is valid) and phone (country code
kept). Numbers that no check validates stay as they are.

A null text stays null with no finds, an empty one stays empty; texts of any length are
read whole. Every column of the input stays, whatever its name, but one named pii. Rows
don't depend on each other, so repeated rows get equal results. The noncharacters U+FDD0
to U+FDDA, which Unicode keeps out of texts, hide what is replaced: in a text with finds
they come back as digits and @.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverscope.llm.shared import let, unused

ROUNDS = 8
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
FREE = r"(?<![\p{L}\p{N}])"
END = r"(?![\p{L}\p{N}])"
#: Bounded repeats: the engine of patterns goes one call deeper for each label.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]{1,63}+\.){1,127}\p{L}{2,63}"
IBAN = FREE + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + END
KEY = FREE + r"(?:AKIA|ASIA)[A-Z0-9]{16}" + END
IPV4 = rf"(?<![\p{{L}}\p{{N}}.]){OCTET}(?:\.{OCTET}){{3}}(?![\p{{L}}\p{{N}}]|\.[0-9])"
DATE = FREE + r"(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2})(?![\p{L}\p{N}])"
SSN = FREE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}]|-[0-9])"
HEX = FREE + r"(?=[0-9A-F]*[0-9]|[0-9a-f]*[0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![\p{L}\p{N}])"
CARD = FREE + r"[0-9](?:[ -]?[0-9]){12,18}(?![\p{L}\p{N}])"
#: Cards in the groups that are printed on them: four of four digits; other groups, or none.
FOUR = r"[0-9]{4}(?<c>[ -])(?:[0-9]{4}\k<c>){2}[0-9]{4}" + END
GROUPED = FREE + r"(?:[0-9]{4}(?<a>[ -])(?:[0-9]{4}\k<a>){2}(?:[0-9]{4}\k<a>)?[0-9]{1,3}|[0-9]{4}(?<b>[ -])[0-9]{6}\k<b>[0-9]{4,5}|[0-9]{13,19})" + END
PHONE = r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![\p{L}\p{N}])"
SURE = {"email": EMAIL, "iban": IBAN, "key": KEY, "ipv4": IPV4, "date": DATE, "ssn": SSN, "hex": HEX}
LOOSE = r"[0-9](?:[ -]?[0-9]){12}"
#: Passes: kinds and their patterns, what a text must have for the pass, and groups of four digits in front of the match that are no part of it.
PASSES = (
    (SURE, "[0-9@]", 0),
    *(({"card": FREE + f"(?:[0-9]{{4}}[ -]){{{n}}}" + FOUR}, LOOSE, n) for n in range(4)),
    ({"card": GROUPED}, LOOSE, 0),
    ({"card": CARD}, LOOSE, 0),
    ({"phone": PHONE}, "[0-9]{2}", 0),
)
PLAIN, HIDDEN = "0123456789@", "".join(chr(0xFDD0 + i) for i in range(11))
DAYS = (17, 4297)  # their product is the number of days from 1900 to 2099


def keyed(key: str, kind: str, number: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), number.cast("string"), value), 256)


def digit(text: Column, at: Column) -> Column:
    """The value of the hex digit at a position from 1."""
    return F.conv(F.substring(text, at, F.lit(1)), 16, 10).cast("int")


def permuted(value: Column, key: str, kind: str | Column, hexa: bool = False) -> Column:
    """A string as another one of that length. Halves take turns: each is moved, character by character, by keyed bytes of the other.

    Digits become digits, letters a to z and A to Z such letters, others stay; hexa: digits of 16 values."""
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, F.length(value)).alias("r"))
    name = F.lit(kind) if isinstance(kind, str) else kind

    def stream(i: Column, own: Column, n: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 32).cast("int")), lambda b: F.sha2(F.concat_ws("|", F.lit(key), name, i.cast("string"), b.cast("string"), own), 256)), "")

    def moved(c: Column, k: Column) -> Column:
        if hexa:
            return F.lower(F.conv(((digit(c, F.lit(1)) + k) % 16).cast("string"), 10, 16))
        code = F.ascii(c)
        turn_by = lambda first, n: F.char(first + (code - first + k) % n)
        return F.when(c.between("0", "9"), turn_by(48, 10)).when(c.between("a", "z"), turn_by(97, 26)).when(c.between("A", "Z"), turn_by(65, 26)).otherwise(c)

    def turn(s: Column, i: Column) -> Column:
        return let(
            stream(i, s["r"], F.greatest(F.length(s["l"]), F.lit(1))),
            lambda k: F.struct(
                s["r"].alias("l"),
                F.array_join(F.transform(F.filter(F.split(s["l"], ""), lambda c: c != ""), lambda c, j: moved(c, digit(k, 2 * j + 2) * 16 + digit(k, 2 * j + 1))), "").alias("r"),
            ),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def digit_sum(digits: Column, odd_from_right: int) -> Column:
    """Luhn's sum; odd_from_right: 0 if the last digit is the check digit, 1 if that one is still to come."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when((i + odd_from_right) % 2 == 1, let(2 * d.cast("int"), lambda x: F.when(x > 9, x - 9).otherwise(x))).otherwise(d.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def card_new(digits: Column, key: str) -> Column:
    return let(
        permuted(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card"),
        lambda p: F.concat(p, ((10 - digit_sum(p, 1) % 10) % 10).cast("string")),
    )


def ssn_valid(digits: Column) -> Column:
    return ~digits.rlike("^(000|666|9)|^...00|0000$")


def ssn_new(digits: Column, key: str) -> Column:
    """The permutation again and again until it meets a valid number, at most 64 times (of ten numbers nine are valid)."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), permuted(digits, key, "ssn"), lambda s, _: F.when(ssn_valid(s), s).otherwise(permuted(s, key, "ssn")))


def ipv4_new(address: Column, key: str) -> Column:
    as_hex = F.array_join(F.transform(F.split(address, r"\."), lambda o: F.lpad(F.conv(o, 10, 16), 2, "0")), "")
    return let(
        permuted(F.lower(as_hex), key, "ipv4", hexa=True),
        lambda h: F.array_join(F.transform(F.array(*[F.lit(x) for x in (1, 3, 5, 7)]), lambda i: F.conv(F.substring(h, i, F.lit(2)), 16, 10)), "."),
    )


def date_of(match: Column) -> Column:
    """The date, null if the calendar has none."""
    day_first = F.concat_ws("-", F.substring(match, 7, 4), F.substring(match, 4, 2), F.substring(match, 1, 2))
    return F.when(match.rlike("^[0-9]{4}-"), match).otherwise(day_first).try_cast("date")


def date_new(match: Column, key: str) -> Column:
    a, b = DAYS
    number = F.datediff(date_of(match), F.lit("1900-01-01").cast("date"))

    def keyed_number(i: Column, value: Column) -> Column:
        return F.conv(F.substring(keyed(key, "date", i, value.cast("string")), 1, 12), 16, 10).cast("bigint")

    def turn(s: Column, i: Column) -> Column:
        return let(
            ((s["x"] + keyed_number(i, s["y"])) % a).cast("int"),
            lambda x: F.struct(x.alias("x"), ((s["y"] + keyed_number(-i, x)) % b).cast("int").alias("y")),
        )

    start = F.struct(F.floor(number / b).cast("int").alias("x"), (number % b).cast("int").alias("y"))
    moved = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.date_add(F.lit("1900-01-01").cast("date"), s["x"] * b + s["y"]))
    return let(
        moved,
        lambda d: F.when(match.rlike("^[0-9]{4}-"), F.date_format(d, "yyyy-MM-dd")).when(match.rlike("/"), F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "dd.MM.yyyy")),
    )


def email_new(match: Column, key: str) -> Column:
    """The name is moved by a permutation of its domain. Letters beyond a to z become keyed ones of a to z, by the whole name."""
    name, domain = F.lower(F.substring_index(match, "@", 1)), F.lower(F.substring_index(match, "@", -1))
    last = F.substring_index(domain, ".", -1)
    labels = F.substring(domain, F.lit(1), F.length(domain) - F.length(last) - 1)

    def ascii_only(x: Column, kind: Column) -> Column:
        beyond = r"[^\x00-\x7F]"
        return permuted(F.regexp_replace(x, beyond, "x"), key, F.when(x.rlike(beyond), F.concat_ws("|", kind, x)).otherwise(kind))

    return F.concat(ascii_only(name, F.concat(F.lit("email|"), domain)), F.lit("@"), ascii_only(labels, F.lit("domain")), F.lit("."), last)


def rest_97(account: Column) -> Column:
    """The remainder by 97 of digits and capitals (10 to 35), read as one number."""
    number = lambda c: F.when(c.between("A", "Z"), F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    return F.aggregate(F.split(account, "(?<=.)(?=.)"), F.lit(0), lambda acc, c: (acc * F.when(c.between("A", "Z"), 100).otherwise(10) + number(c)) % 97)


def iban_valid(match: Column) -> Column:
    return let(F.replace(match, F.lit(" ")), lambda x: rest_97(F.concat(F.substring(x, F.lit(5), F.length(x)), F.substring(x, 1, 4))) == 1)


def iban_new(match: Column, key: str) -> Column:
    bare = F.replace(match, F.lit(" "))
    country = F.substring(bare, 1, 2)
    new = let(
        permuted(F.substring(bare, F.lit(5), F.length(bare)), key, F.concat(F.lit("iban|"), country)),
        lambda p: F.concat(country, F.lpad((98 - rest_97(F.concat(p, country, F.lit("00")))).cast("string"), 2, "0"), p),
    )
    at = lambda i: i + 1 - F.length(F.regexp_replace(F.substring(match, F.lit(1), i + 1), "[^ ]", ""))
    return let(new, lambda x: F.array_join(F.transform(F.split(match, "(?<=.)(?=.)"), lambda c, i: F.when(c == " ", c).otherwise(F.substring(x, at(i), F.lit(1)))), ""))


def in_place(match: Column, digits: Column, first: Column) -> Column:
    """match with its digits, from digit number first (0-based) on, replaced in order by digits; the rest of match stays."""
    parts = F.transform(
        F.split(match, "(?<=.)"),
        lambda c, i: F.struct(c.alias("c"), F.length(F.regexp_replace(F.substring(match, F.lit(1), i + 1), "[^0-9]", "")).alias("n")),
    )
    return F.array_join(F.transform(parts, lambda p: F.when(p["c"].rlike("[0-9]") & (p["n"] > first), F.substring(digits, p["n"] - first, F.lit(1))).otherwise(p["c"])), "")


def kind_of(match: Column, kinds: dict[str, str]) -> Column:
    """The kind of a match that its check validates, null for the others."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    sure = {"date": date_of(match).isNotNull(), "ssn": ssn_valid(digits), "card": digit_sum(digits, 0) % 10 == 0, "phone": F.length(digits) >= 7, "iban": iban_valid(match)}
    kind = F.when(F.lit(False), F.lit(""))
    for name, pattern in kinds.items():
        found = F.when(sure[name], F.lit(name)) if name in sure else F.lit(name)
        kind = kind.when(match.rlike(f"^(?:{pattern})$"), found) if len(kinds) > 1 else kind.when(F.lit(True), found)
    return kind


def pseudonym(match: Column, kind: Column, key: str, kinds: dict[str, str]) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    code = F.when(match.startswith("+"), F.length(F.regexp_extract(match, r"^\+([0-9]{1,3}?)(?=[ .(-]|[0-9]{7,}$)", 1))).otherwise(0)
    ways = {
        "email": lambda: email_new(match, key),
        "iban": lambda: iban_new(match, key),
        "key": lambda: F.concat(F.substring(match, 1, 4), permuted(F.substring(match, F.lit(5), F.length(match)), key, "key")),
        "ipv4": lambda: ipv4_new(match, key),
        "date": lambda: date_new(match, key),
        "ssn": lambda: in_place(match, ssn_new(digits, key), F.lit(0)),
        "hex": lambda: let(permuted(F.lower(match), key, "hex", hexa=True), lambda h: F.when(match == F.lower(match), h).otherwise(F.upper(h))),
        "card": lambda: in_place(match, card_new(digits, key), F.lit(0)),
        "phone": lambda: let(code, lambda c: in_place(match, permuted(F.substring(digits, c + 1, F.length(digits)), key, "phone"), c)),
    }
    new = F.when(F.lit(False), match)
    for name in kinds:
        new = new.when(kind == name, ways[name]())
    return new.otherwise(match)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with the text pseudonymised and a column pii, array<struct<kind, was_chars>> of what was replaced, pass by pass and in order.

    key: who has it can undo the permutations, so it belongs to a secret store."""
    if not key:
        raise ValueError("pseudonyms need a key")
    now, found, typed, said = (unused(docs, x) for x in ("_now", "_found", "_typed", "_said"))
    docs = docs.withColumns({now: F.col(text), said: F.array().cast("array<struct<kind:string,was_chars:int>>")})
    for kinds, needs, groups in PASSES:
        pattern = "|".join(kinds.values())
        head = lambda m, n=5 * groups: F.substring(m, 1, n)
        body = lambda m, n=5 * groups: F.substring(m, F.lit(n + 1), F.length(m))
        docs = docs.withColumn(found, F.when(F.col(now).rlike(needs), F.regexp_extract_all(F.col(now), F.lit(pattern), F.lit(0))))
        docs = docs.withColumn(typed, F.transform(found, lambda m: F.struct(head(m).alias("head"), body(m).alias("m"), kind_of(body(m), kinds).alias("kind"))))
        news = F.transform(typed, lambda x: F.concat(x["head"], F.when(x["kind"].isNull(), x["m"]).otherwise(F.translate(pseudonym(x["m"], x["kind"], key, kinds), PLAIN, HIDDEN))))
        # split() leaves one gap more than there are matches
        rebuilt = F.array_join(F.zip_with(F.split(F.col(now), pattern), news, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")
        sure = F.filter(typed, lambda x: x["kind"].isNotNull())
        any_sure = F.size(typed) > 0
        docs = docs.withColumns({
            now: F.when(any_sure, rebuilt).otherwise(F.col(now)),
            said: F.when(any_sure, F.concat(said, F.transform(sure, lambda x: F.struct(x["kind"].alias("kind"), F.length(x["m"]).alias("was_chars"))))).otherwise(F.col(said)),
        })
    shown = F.when(F.size(said) > 0, F.translate(F.col(now), HIDDEN, PLAIN)).otherwise(F.col(text))
    return docs.withColumn(text, shown).withColumn("pii", F.col(said)).drop(now, found, typed, said)
