"""Format-preserving pseudonyms for personal data, from built-in functions only.

Numbers and dates that pass their validity checks are permuted within their format by a keyed Feistel
network: addition rounds over two halves with their own moduli, so the domain is permuted exactly and no
cycle walking is needed. Equal values, however they are spaced or dotted, get equal pseudonyms in every
document; ``reveal`` with the same key inverts them.

* card numbers (13-19 digits, Luhn): all digits but the last are permuted, the last is the new check digit;
* other numbers of 13-19 digits (account and reference numbers): the same, and the last digit keeps its
  distance from the check digit, so that none becomes a card number;
* social security numbers: area, and group with serial, are permuted within their valid ranges;
* IBANs: the digits and letters after the check digits are permuted within their kinds, the check digits
  made anew (mod 97);
* phone numbers: the digits after the country code are permuted;
* dates (1900-01-01 up to 72,900 days on): the day is permuted, the notation stays;
* IPv4 addresses: the 32 bits are permuted;
* e-mail addresses: letters and digits of the local part are permuted within their kinds; the domain stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt, free_name, let, table

ROUNDS = 10
#: Where the registered query finds its key, and what it takes without one. Operators have no default.
KEY_SETTING, EXAMPLE_KEY = "spark.tidelog.pseudonyms.key", "example key, replace"

#: Length of the IBANs of each country, so that words in capitals after one are not taken with it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(
    f"(?:{names.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f"\\x20?[A-Z0-9]{{{(n - 4) % 4}}}" if n % 4 else "") + "(?![A-Za-z0-9])" for n, names in IBAN_LENGTHS.items()
)

#: A year before a run of digits that is itself of a card's length, or only years, is no part of a number.
_YEARS = r"(?!(?:19|20)[0-9]{2}[\x20-](?:[0-9]{4}[\x20-]){3}[0-9]{4}(?![0-9A-Za-z]))(?!(?:(?:19|20)[0-9]{2}[\x20-]){3,}(?:19|20)[0-9]{2}(?![0-9A-Za-z]))"

#: Kinds in order of precedence, each with the pattern that finds it. Every pattern starts at a boundary, so
#: that a long run is tried once.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + _IBAN + r"|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[A-Z]{2}[0-9]{2}(?:\x20?[0-9]{4}){2,7}(?:\x20?[0-9]{1,3})?)(?![A-Za-z0-9])",
    "phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[\x20.-]?\(?[0-9]{1,4}\)?(?:[\x20.-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9A-Za-z])\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9A-Za-z.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "number": r"(?<![0-9A-Za-z])" + _YEARS + r"[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9A-Za-z])",
}
ANY = "|".join(PATTERNS.values())
KINDS = ("email", "ip", "date", "ssn", "iban", "phone", "card", "number")
ALPHA = "abcdefghijklmnopqrstuvwxyz"
EPOCH = "1900-01-01"
DAY_SIDE = 270


def _draw(key: str, kind: str, *parts: Column) -> Column:
    """60 keyed pseudo-random bits as a long."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_mod: Column, right_mod: Column, key: str, kind: str, reveal: bool = False) -> Column:
    """Struct ``l, r``: (left, right) permuted keyed within left_mod x right_mod."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    mods = F.struct(left_mod.cast("long").alias("a"), right_mod.cast("long").alias("b"))

    def run(m):
        mod = lambda i: F.when(i % 2 == 0, m["a"]).otherwise(m["b"])
        on = lambda s, i: F.struct(s["r"].alias("l"), F.pmod(s["l"] + F.pmod(_draw(key, kind, m["a"], m["b"], i, s["r"]), mod(i)), mod(i)).alias("r"))
        back = lambda s, i: F.struct(F.pmod(s["r"] - F.pmod(_draw(key, kind, m["a"], m["b"], i, s["l"]), mod(i)), mod(i)).alias("l"), s["l"].alias("r"))
        order = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if reveal else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
        return F.aggregate(order, start, back if reveal else on)

    return let(mods, run)


def _ten(n: Column) -> Column:
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), n)).cast("long")


def _left(s: Column, n: Column) -> Column:
    return F.substr(s, F.lit(1), n)


def permute_digits(d: Column, key: str, kind: str, reveal: bool = False) -> Column:
    """A digit string of up to 36 digits, permuted among those of its length; a single digit too."""

    def run(x):
        u = F.floor(F.length(x) / 2).cast("int")
        v = F.length(x) - u
        f = feistel(F.coalesce(F.when(u > 0, _left(x, u)).cast("long"), F.lit(0)), F.substr(x, u + 1).cast("long"), _ten(u), _ten(v), key, kind, reveal)
        return let(f, lambda s: F.concat(F.when(u > 0, F.lpad(s["l"].cast("string"), u, "0")).otherwise(""), F.lpad(s["r"].cast("string"), v, "0")))

    return let(d, run)


def digits_of(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def refill(v: Column, digits: Column, skip: Column | int = 0, kind: str = "[0-9]") -> Column:
    """v with its digits (or characters of ``kind``) after the first ``skip`` replaced in turn; all else stays."""
    skip = F.lit(skip) if isinstance(skip, int) else skip
    at = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))

    def step(acc, i):
        c = F.substr(v, i, F.lit(1))
        digit = F.regexp_like(c, F.lit(kind))
        new = F.when(digit & (acc["n"] >= skip), F.substr(digits, acc["n"] - skip + 1, F.lit(1))).otherwise(c)
        return F.struct((acc["n"] + digit.cast("int")).alias("n"), F.concat(acc["out"], new).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.length(v)), at, step, lambda acc: acc["out"])


def luhn_sum(d: Column, odd: int) -> Column:
    """Luhn sum; places counted from the right, those with parity ``odd`` doubled."""

    def term(i):
        x = F.substr(d, F.length(d) - i, F.lit(1)).cast("int")
        twice = x * 2
        return F.when(i % 2 == odd, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(x)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(d) - 1), term), F.lit(0), lambda a, b: a + b)


def luhn_ok(d: Column) -> Column:
    return luhn_sum(d, 1) % 10 == 0


def _mod97(d: Column) -> Column:
    """A string of digits and capitals (A is 10, Z is 35) of any length mod 97."""

    def step(a, i):
        c = F.ascii(F.substr(d, i, F.lit(1))).cast("long")
        return F.when(c < 65, (a * 10 + c - 48) % 97).otherwise((a * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0).cast("long"), step)


def kind_of(v: Column) -> Column:
    """The kind of a match, null if it fails the checks of its format."""
    d = digits_of(v)
    full = lambda k: F.regexp_like(v, F.lit(f"^(?:{PATTERNS[k]})$"))
    octets = F.split(v, r"\.")
    day = date_of(v)
    account = F.regexp_replace(v, " ", "")
    iban_rest = F.concat(F.substr(account, F.lit(5)), F.substring(account, 1, 4))
    return (
        F.when(full("email"), "email")
        .when(full("ip"), F.when(F.forall(octets, lambda o: o.cast("int") <= 255), "ip"))
        .when(full("date"), F.when(day.isNotNull() & (day >= F.lit(EPOCH).cast("date")) & (F.datediff(day, F.lit(EPOCH).cast("date")) < DAY_SIDE * DAY_SIDE), "date"))
        .when(full("ssn"), F.when((F.substring(v, 1, 3).cast("int").between(1, 899)) & (F.substring(v, 1, 3) != "666") & (F.substring(v, 5, 2) != "00") & (F.substring(v, 8, 4) != "0000"), "ssn"))
        .when(full("iban"), F.when(_mod97(iban_rest) == 1, "iban"))
        .when(full("phone"), F.when(F.length(d).between(7, 15), "phone"))
        .when(full("number"), F.when(luhn_ok(d), "card").otherwise("number"))
    )


def date_of(v: Column) -> Column:
    iso = F.regexp_like(v, F.lit("^[0-9]{4}-"))
    slash = F.contains(v, F.lit("/"))
    y, m, d = (
        F.when(iso, F.substring(v, *a)).when(slash, F.substring(v, *b)).otherwise(F.substring(v, *c))
        for a, b, c in (((1, 4), (7, 4), (7, 4)), ((6, 2), (1, 2), (4, 2)), ((9, 2), (4, 2), (1, 2)))
    )
    return F.concat_ws("-", y, m, d).try_cast("date")


def _date(v: Column, key: str, reveal: bool) -> Column:
    n = F.datediff(date_of(v), F.lit(EPOCH).cast("date"))
    f = feistel(F.floor(n / DAY_SIDE), n % DAY_SIDE, F.lit(DAY_SIDE), F.lit(DAY_SIDE), key, "date", reveal)
    day = let(f, lambda s: F.date_add(F.lit(EPOCH).cast("date"), (s["l"] * DAY_SIDE + s["r"]).cast("int")))
    parts = lambda x: (F.lpad(F.year(x).cast("string"), 4, "0"), F.lpad(F.month(x).cast("string"), 2, "0"), F.lpad(F.day(x).cast("string"), 2, "0"))

    def write(x):
        y, m, d = parts(x)
        return F.when(F.regexp_like(v, F.lit("^[0-9]{4}-")), F.concat_ws("-", y, m, d)).when(F.contains(v, F.lit("/")), F.concat_ws("/", m, d, y)).otherwise(F.concat_ws(".", d, m, y))

    return let(day, write)


def _ip(v: Column, key: str, reveal: bool) -> Column:
    o = lambda i: F.get(F.split(v, r"\."), F.lit(i)).cast("long")
    f = feistel(o(0) * 256 + o(1), o(2) * 256 + o(3), F.lit(65536), F.lit(65536), key, "ip", reveal)
    byte = lambda x: x.cast("long").cast("string")
    return let(f, lambda s: F.concat_ws(".", byte(F.floor(s["l"] / 256)), byte(s["l"] % 256), byte(F.floor(s["r"] / 256)), byte(s["r"] % 256)))


def _ssn(v: Column, key: str, reveal: bool) -> Column:
    d = digits_of(v)
    area = F.substring(d, 1, 3).cast("int")
    area = area - 1 - F.when(area > 666, 1).otherwise(0)  # 0..897
    low = (F.substring(d, 4, 2).cast("int") - 1) * 9999 + F.substring(d, 6, 4).cast("int") - 1
    f = feistel(area, low, F.lit(898), F.lit(99 * 9999), key, "ssn", reveal)
    pad = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
    back = let(f, lambda s: F.concat(pad(s["l"] + 1 + F.when(s["l"] >= 665, 1).otherwise(0), 3), pad(F.floor(s["r"] / 9999) + 1, 2), pad(s["r"] % 9999 + 1, 4)))
    return refill(v, back)


def _card(v: Column, key: str, kind: str, reveal: bool) -> Column:
    """The last digit keeps its distance from the check digit: 0 for cards, never 0 for other numbers."""
    check = lambda b: (10 - luhn_sum(b, 0) % 10) % 10

    def run(d):
        body = _left(d, F.length(d) - 1)
        off = F.substring(d, -1, 1).cast("int") - check(body)
        return let(permute_digits(body, key, kind, reveal), lambda b: F.concat(b, F.pmod(check(b) + off, F.lit(10)).cast("string")))

    return refill(v, let(digits_of(v), run))


def _iban(v: Column, key: str, reveal: bool) -> Column:
    def run(account):
        rest = F.substr(account, F.lit(5))
        letters = _permute_text(F.lower(rest), key, "iban", reveal)
        bank = F.when(F.regexp_like(rest, F.lit("[A-Z]")), F.upper(letters)).otherwise(permute_digits(rest, key, "iban", reveal))
        check = lambda b: F.concat(F.lpad((98 - _mod97(F.concat(b, F.substring(account, 1, 2), F.lit("00")))).cast("string"), 2, "0"), b)
        return let(bank, check)

    return refill(v, let(F.regexp_replace(v, " ", ""), run), 2, "[A-Z0-9]")


def _phone(v: Column, key: str, reveal: bool) -> Column:
    code = F.length(F.regexp_extract(v, r"^\+([0-9]{1,3})", 1))
    # without a separator the code's length is not known: one digit then
    code = F.when(F.regexp_like(v, F.lit(r"^\+[0-9]{1,3}[^0-9]")), code).when(F.startswith(v, F.lit("+")), 1).otherwise(0)
    return let(code, lambda n: refill(v, permute_digits(F.substr(digits_of(v), n + 1), key, "phone", reveal), n))


def _shift(half: Column, other: Column, i: Column, key: str, kind: str, sign: int) -> Column:
    draw = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), F.length(half).cast("string"), other), 256)

    def run(h):
        def one(j):
            c = F.substr(half, j, F.lit(1))
            s = F.conv(F.substr(h, (j * 3) % 60 + 1, F.lit(4)), 16, 10).cast("int") * sign
            a = F.instr(F.lit(ALPHA), c)
            n = F.instr(F.lit("0123456789"), c)
            return F.when(a > 0, F.substr(F.lit(ALPHA), F.pmod(a - 1 + s, F.lit(26)) + 1, F.lit(1))).when(n > 0, F.substr(F.lit("0123456789"), F.pmod(n - 1 + s, F.lit(10)) + 1, F.lit(1))).otherwise(c)

        return F.when(F.length(half) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(half)), one), "")).otherwise("")

    return let(draw, run)


def _permute_text(name: Column, key: str, kind: str, reveal: bool) -> Column:
    """Lower-case letters and digits permuted within their kinds; all else stays."""
    u = F.floor(F.length(name) / 2).cast("int")
    start = F.struct(_left(name, u).alias("l"), F.substr(name, u + 1).alias("r"))
    on = lambda s, i: F.struct(s["r"].alias("l"), _shift(s["l"], s["r"], i, key, kind, 1).alias("r"))
    back = lambda s, i: F.struct(_shift(s["r"], s["l"], i, key, kind, -1).alias("l"), s["l"].alias("r"))
    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if reveal else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(order, start, back if reveal else on, lambda s: F.concat(s["l"], s["r"]))


def _email(v: Column, key: str, reveal: bool) -> Column:
    new = _permute_text(F.lower(F.substring_index(v, "@", 1)), key, "email", reveal)
    return F.concat(F.when(v == F.upper(v), F.upper(new)).otherwise(new), F.lit("@"), F.substring_index(v, "@", -1))


def pseudonym(v: Column, kind: Column, key: str, reveal: bool = False) -> Column:
    out = F.when(kind == "email", _email(v, key, reveal)).when(kind == "ip", _ip(v, key, reveal)).when(kind == "date", _date(v, key, reveal))
    out = out.when(kind == "ssn", _ssn(v, key, reveal)).when(kind == "iban", _iban(v, key, reveal)).when(kind == "phone", _phone(v, key, reveal))
    return out.when(kind == "card", _card(v, key, "card", reveal)).when(kind == "number", _card(v, key, "number", reveal)).otherwise(v)


def replaced(docs: DataFrame, key: str, text_col: str = "text", kinds_col: str = "kinds", reveal: bool = False) -> DataFrame:
    """docs with pseudonyms in the text column, and the array of the kinds replaced, in order, in a column more.

    That column is ``kinds_col``, with underscores in front if docs has one of that name. Strings that look
    like a kind and fail its checks stay, as do null and empty texts. All rows, repeated ones too, and all
    other columns stay. With reveal, pseudonyms of the same key are undone. The key is part of the query
    plan: who may read plans may reveal. An empty table gives none.
    """
    kinds_col = free_name(docs, kinds_col)
    t = F.col(f"row.`{text_col}`")
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    df = df.select("row", F.regexp_extract_all(t, F.lit(ANY), F.lit(0)).alias("m"))
    df = df.withColumn("v", F.transform("m", lambda v: F.struct(v.alias("v"), kind_of(v).alias("kind"))))
    df = df.withColumn("new", F.when(F.size("v") > 0, F.transform("v", lambda x: F.coalesce(pseudonym(x["v"], x["kind"], key, reveal), x["v"]))))
    pieces = F.split(t, ANY, -1)
    text = F.when(F.size("m") > 0, F.array_join(F.flatten(F.zip_with(pieces, F.col("new"), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")).otherwise(t)  # after the last piece there is no match
    kinds = F.filter(F.transform("v", lambda x: x["kind"]), lambda k: k.isNotNull())
    return df.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns], F.coalesce(kinds, F.array().cast("array<string>")).alias(kinds_col))


def op2(spark, sf_dir):
    df = replaced(dealt(table(spark, sf_dir, "documents")).select("doc_id", "text"), spark.conf.get(KEY_SETTING, EXAMPLE_KEY))
    count = lambda name: F.size(F.filter("kinds", lambda k: k == name)).cast("long").alias(f"n_{name}")
    counts = [count(name) for name in KINDS]
    return df.select("doc_id", "text", *counts)


QUERIES = {"op2_pseudonyms": op2}
SQL: dict[str, str] = {}
