"""Format-preserving pseudonyms for personal data (native: DataFrame functions only).

Numbers and dates that validate are permuted within their format by a keyed, alternating
Feistel network over mixed-radix symbols: every round adds to the symbols of one parity a
SHA-512 value of the key, the kind, the round and the symbols of the other parity. A value has
one pseudonym, whatever its separators or letter case, so documents stay linked; and since
every round can be undone, different values of a kind keep different pseudonyms.

Kinds: payment card numbers (13 to 19 digits, Luhn-valid; the check digit is made anew), bank account
numbers (IBAN; country and length stay, check digits are made anew), dates that exist from 1900 to 2099
(year-month-day, year/month/day, day/month/year, month/day/year where that alone exists,
day.month.year; parts keep being padded or not, and a pseudonym may be as late as 2102), phone numbers (the country code stays),
social security numbers, IPv4 addresses, e-mail addresses (the local part) and hexadecimal
secrets. What does not validate is left alone. A date of which day and month may change places
is read as day first; so may the pseudonym of one that was written month first.

The key has no default: whoever has it can undo the permutation.

Defined cases: null text stays null with no kinds; empty text stays empty. Rows repeat as they
come. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# Patterns of the kinds, in the order in which they are tried.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Not where a date begins: a number of groups ends before one.
_NO_DATE = r"(?!(?:19|20)[0-9]{2}[/\-][0-9]|[0-3]?[0-9][/.][0-3]?[0-9][/.][0-9])"
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+\-]*+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,128}(?![0-9A-Za-z])",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?|[0-9A-Z]{11,30})(?![0-9A-Za-z])",
    "date": r"(?<![0-9./\-])(?:(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]|(?:19|20)[0-9]{2}/[01]?[0-9]/[0-3]?[0-9]|[0-3]?[0-9]/[0-3]?[0-9]/(?:19|20)[0-9]{2}|[0-3]?[0-9]\.[01]?[0-9]\.(?:19|20)[0-9]{2})(?![0-9/\-]|\.[0-9])",
    "phone": rf"(?<![0-9])\+1[ .\-]?\(?[0-9]{{3}}\)?[ .\-]?[0-9]{{3}}[ .\-]?[0-9]{{4}}(?![0-9])|(?<![0-9])\+[0-9]{{1,3}}[ .\-]?\(?[0-9]{{2,4}}\)?(?:[ .\-]?{_NO_DATE}[0-9]{{2,4}}){{2,4}}(?![0-9])|"
    r"(?<![0-9])\([0-9]{3}\)[ ]?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9\-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9\-])",
    "ssn": r"(?<![0-9\-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9\-])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){2} [0-9]{1,4}|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,4}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![0-9])",
}
#: Values start where no letter or digit stands before, so that inside a word one look is enough.
ANY = r"(?<![0-9A-Za-z])(?=[0-9A-Za-z+(])(?:" + "|".join(PATTERNS.values()) + ")"
_FIRST_DAY, _DAYS, _HIGH, _LOW = "1900-01-01", 74_000, 250, 296
#: Country codes of phone numbers: those of one and two digits, and all others of three.
_COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def let(value: Column, body) -> Column:
    """`body(value)` with the value made once; a plain expression would be made anew wherever a lambda names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def feistel(codes: Column, radix: Column, key: str, kind: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of the arrays of ints below `radix`, place by place."""

    def step(radix: Column, now: Column, r: Column) -> Column:
        others = F.filter(now, lambda c, i: (i % 2) != (r % 2))
        said = F.concat_ws("|", F.lit(f"{key}|{kind}"), r.cast("string"), F.size(now).cast("string"), F.array_join(F.transform(others, lambda c: c.cast("string")), ","))

        def stream(said: Column) -> Column:
            """Four hexadecimal digits for each symbol; a hash has 32 of them."""
            blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(now) - 1) / 32).cast("int")))
            return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("|", said, b.cast("string")), 512)), "")

        return let(
            let(said, stream),
            lambda h: F.transform(now, lambda c, i: F.when((i % 2) == (r % 2), F.pmod(c + F.conv(F.substring(h, i * 4 + 1, F.lit(4)), 16, 10).cast("int"), F.get(radix, i)).cast("int")).otherwise(c)),
        )

    def alone(code: Column, radix: Column) -> Column:
        """One symbol has no other to be mixed with: its place in the order of the symbols' hashes."""
        order = F.array_sort(F.transform(F.sequence(F.lit(0), radix - 1), lambda s: F.struct(F.sha2(F.concat_ws("|", F.lit(f"{key}|{kind}|one"), s.cast("string")), 256).alias("h"), s.alias("s"))))
        return F.array(F.get(order, code)["s"].cast("int"))

    single = alone(F.get(codes, F.lit(0)), F.get(radix, F.lit(0)))
    mixed = let(radix, lambda x: F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), codes, lambda now, r: step(x, now, r)))
    return F.when(F.size(codes) == 1, single).otherwise(mixed)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _ints(digits: Column) -> Column:
    return F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c: c.cast("int"))


def _refill(shape: Column, pattern: str, symbols: Column) -> Column:
    """`shape` with its characters of the class `pattern` replaced by `symbols` (array of strings) in order."""
    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    place = lambda i: F.length(F.regexp_replace(F.substring(shape, F.lit(1), i + 1), pattern.replace("[", "[^", 1), "")) - 1
    return let(symbols, lambda new: F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(pattern), F.get(new, place(i))).otherwise(c)), ""))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of an array of digits, the last of which is the check digit's place."""
    doubled = F.transform(digits, lambda d, i: F.when((F.size(digits) - i) % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d)


def _tens(digits: Column) -> Column:
    return F.transform(digits, lambda d: F.lit(10))


def _card(m: Column, key: str) -> Column:
    def checked(new: Column) -> Column:
        check = F.pmod(F.lit(10) - luhn_sum(F.concat(new, F.array(F.lit(0)))) % 10, F.lit(10)).cast("int")
        return F.transform(F.concat(new, F.array(check)), lambda d: d.cast("string"))

    body = let(_ints(_digits(m)), lambda digits: F.slice(digits, 1, F.size(digits) - 1))
    return _refill(m, "[0-9]", let(let(body, lambda b: feistel(b, _tens(b), key, "card")), checked))


def _number(m: Column, key: str, kind: str) -> Column:
    new = let(_ints(_digits(m)), lambda digits: feistel(digits, _tens(digits), key, kind))
    return _refill(m, "[0-9]", F.transform(new, lambda d: d.cast("string")))


def _phone(m: Column, key: str) -> Column:
    code = F.regexp_extract(m, _COUNTRY, 0)
    return F.concat(code, _number(F.substr(m, F.length(code) + 1), key, "phone"))


def _ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("int"))
    new = let(parts, lambda p: feistel(p, F.transform(p, lambda _: F.lit(256)), key, "ip"))
    return F.array_join(F.transform(new, lambda p: p.cast("string")), ".")


def _letters(m: Column, key: str, kind: str, letters: int) -> Column:
    """Letters and digits permuted within their classes; the case of each letter stays."""
    def moved(only: Column) -> Column:
        codes = F.transform(only, lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(F.lower(c)) - 97))
        radix = F.transform(only, lambda c: F.when(c.rlike("[0-9]"), F.lit(10)).otherwise(F.lit(letters)))
        return F.zip_with(only, feistel(codes, radix, key, kind), lambda c, v: F.when(c.rlike("[0-9]"), v.cast("string")).when(c.rlike("[A-Z]"), F.char(v + 65)).otherwise(F.char(v + 97)))

    only = F.filter(F.split(F.regexp_replace(m, "[^0-9A-Za-z]", ""), ""), lambda c: c != "")
    return _refill(m, "[0-9A-Za-z]", let(only, moved))


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(_letters(local, key, "email", 26), F.substr(m, F.length(local) + 1))


def _days(year: Column, month: Column, day: Column) -> Column:
    """Days from the first day of the window; null for what isn't a date of 1900 to 2099."""
    date = F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    found = F.datediff(date, F.lit(_FIRST_DAY).cast("date"))
    return F.when(found.between(0, _DAYS - 1), found)


def _read_date(m: Column) -> Column:
    """Struct of the day's number, null for what isn't a date, and the format that the match has."""
    parts, sep = F.split(m, "[-./]"), F.regexp_extract(m, "[-./]", 0)
    a, b, c = (F.get(parts, F.lit(k)) for k in range(3))
    year_first, slash = F.length(a) == 4, sep == "/"
    day_first, month_first = _days(c, b, a), F.when(slash, _days(c, a, b))
    short = F.when(year_first, (F.length(b) < 2) | (F.length(c) < 2)).otherwise((F.length(a) < 2) | (F.length(b) < 2))
    day, month = F.when(short, "d").otherwise("dd"), F.when(short, "M").otherwise("MM")
    order = F.when(year_first, F.concat_ws(",", F.lit("yyyy"), month, day)).when(day_first.isNotNull(), F.concat_ws(",", day, month, F.lit("yyyy"))).otherwise(F.concat_ws(",", month, day, F.lit("yyyy")))
    return F.struct(F.when(year_first, _days(a, b, c)).otherwise(F.coalesce(day_first, month_first)).alias("day"), F.replace(order, F.lit(","), sep).alias("format"))


def _date(m: Column, key: str) -> Column:
    def shown(new: Column, how: Column) -> Column:
        date = F.date_add(F.lit(_FIRST_DAY).cast("date"), F.get(new, F.lit(0)) * _LOW + F.get(new, F.lit(1)))
        shown = F.lit(None).cast("string")
        for style in ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy/M/d", "dd/MM/yyyy", "d/M/yyyy", "MM/dd/yyyy", "M/d/yyyy", "dd.MM.yyyy", "d.M.yyyy"):
            shown = F.when(how == style, F.date_format(date, style)).otherwise(shown)
        return shown

    halves = lambda day: F.array((day / _LOW).cast("int"), F.pmod(day, F.lit(_LOW)).cast("int"))
    return let(_read_date(m), lambda d: let(feistel(halves(d["day"]), F.array(F.lit(_HIGH), F.lit(_LOW)), key, "date"), lambda new: shown(new, d["format"])))


def mod_97(text: Column) -> Column:
    """The number that the letters (A is 10) and digits of `text` spell, modulo 97."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda now, c: F.when(c.rlike("[0-9]"), (now * 10 + c.cast("int")) % 97).otherwise((now * 100 + F.ascii(c) - 55) % 97))


def _iban(m: Column, key: str) -> Column:
    body = _letters(F.substr(m, F.lit(5)), key, "iban", 26)

    def checked(new: Column) -> Column:
        plain = F.concat(F.regexp_replace(new, " ", ""), F.substring(m, 1, 2), F.lit("00"))
        return F.concat(F.substring(m, 1, 2), F.lpad((98 - mod_97(plain)).cast("string"), 2, "0"), new)

    return let(body, checked)


def _good_iban(m: Column) -> Column:
    plain = F.regexp_replace(m, " ", "")
    return F.length(plain).between(15, 34) & (mod_97(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))) == 1)


def kind_of(m: Column) -> Column:
    """The kind of a match that validates, else null."""
    whole = {k: m.rlike(rf"^(?:{p})$") for k, p in PATTERNS.items()}
    good_card = let(_ints(_digits(m)), luhn_sum) % 10 == 0
    return (
        F.when(whole["email"], "email").when(whole["ip"], "ip").when(whole["iban"] & ~whole["secret"], F.when(_good_iban(m), "iban")).when(whole["date"], F.when(_read_date(m)["day"].isNotNull(), "date"))
        .when(whole["card"] & ~whole["secret"], F.when(good_card, "card"))
        .when(whole["phone"], "phone").when(whole["ssn"], "ssn")
        .when(whole["secret"], F.when(m.rlike("[0-9]") & m.rlike("[A-Fa-f]"), "secret"))
    )


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    return (
        F.when(kind == "email", _email(m, key)).when(kind == "ip", _ip(m, key)).when(kind == "date", _date(m, key)).when(kind == "card", _card(m, key)).when(kind == "iban", _iban(m, key))
        .when(kind == "phone", _phone(m, key)).when(kind == "ssn", _number(m, key, "ssn")).when(kind == "secret", _letters(m, key, "secret", 6)).otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with pseudonyms, kinds (of the values replaced, in order) and n_replaced."""
    text = docs["text"].cast("string")
    found = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"),
        F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("matches"),
    )
    kinds = found.withColumn("each", F.transform("matches", kind_of))
    new = kinds.withColumn("made", F.zip_with("matches", "each", lambda m, k: pseudonym(m, k, key)))
    gaps = F.split("text", ANY, -1)
    filled = let(F.col("made"), lambda made: F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(made, i), F.lit("")))), ""))
    done = F.when(F.size("matches") > 0, filled).otherwise(F.col("text"))
    valid = F.filter("each", lambda k: k.isNotNull())
    return new.select("doc_id", done.alias("text"), valid.alias("kinds"), F.size(valid).alias("n_replaced"))
