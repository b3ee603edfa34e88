"""Secret scan: fixed patterns, and a battery of randomness tests over token-like strings.

Positions come from built-in functions: the pieces between the matches and the matches themselves have
lengths, and their running sums are the places. The method's candidates are runs of 20 or more encoding
characters outside the fixed spans. An encoding is inferred for each (hexadecimal, base 32, base 36, base
64). The battery asks of each how it departs from characters drawn evenly from that alphabet: chi-squared
uniformity over kinds of character (upper case, lower case, digits) and over letters, too few runs of a
kind, too many vowels, and neighbours that alternate between vowel and consonant as in words; for
hexadecimal strings over kinds, symbols and runs of low and high digits. Fisher's sum of the logarithms of
the p-values is the candidate's score: about 8 for random strings, larger the more it is like text.

What is to be ruled out is that a candidate is text-like, an identifier or name. Its null distribution comes
from decoys: all plain words of every document, written together, are cut into pieces one after the other, of
lengths that go round all classes; each piece with some digits is a decoy in each encoding. A paragraph of plain
words gives some more in every class.
A candidate's p-value is the share of decoys of its encoding and length class that look as random as it
does, and Benjamini-Hochberg control within each length class decides which candidates are reported as
``random``; so short strings, on which the battery has little power, do not set the limit for long ones.

Decoys and candidates are counted over all documents, as histograms of bounded size, in one pass; a second
pass reports. Nothing is shuffled but the histograms.
"""

from __future__ import annotations

import math
import random
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt, let, table, text_or_empty

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KEYWORD = "(?i)password|passwd|secret|token|api_?key"
# Same spans as matching all lengths and dropping the short ones: both patterns take whole runs.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
MASK = "[SECRET]"
MORE = "array<struct<s:int,k:int,e:int,v:string,enc:int,cls:int,bin:int>>"
BLOCK = 256

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
VOWELS = "aeiou"
HEX_DIGITS, BASE32, BASE36, BASE64 = range(4)
#: For each encoding the chance of upper case, lower case and other characters.
CHANCES = {BASE32: (26 / 32, 0.0, 6 / 32), BASE36: (0.0, 26 / 36, 10 / 36), BASE64: (26 / 64, 26 / 64, 12 / 64)}
#: Shortest length of each length class.
CLASSES = (20, 24, 28, 32, 40, 48, 64, 96, 128)
#: Scores are counted in bins of this width, the last one open.
BIN, BINS = 0.5, 1200
#: Words that decoys are made of: those that stand alone.
PLAIN = r"(?<![\p{L}0-9+/_=-])[A-Za-z]{2,19}(?![\p{L}0-9+/_=-])"
#: Lengths and last digits of decoys in turn: each class once in every nine.
_draw = random.Random(1)
CYCLE = [(_draw.randrange(lo, hi), "".join(_draw.choices(DIGITS, k=_draw.randint(1, 3)))) for _ in range(16) for lo, hi in _draw.sample(list(zip(CLASSES, [*CLASSES[1:], CLASSES[-1] + 32], strict=True)), len(CLASSES))]
#: Order in which a decoy's symbols are taken out and counted: letters, vowels first; hexadecimal digits, with those above 7 last and among them letters.
LETTERS_OUT = "eaoiu" + "tnsrhldcmfpgwybvkxjqz"
DIGITS_OUT = "67543120" + "98" + "efcdab"
PROSE = (
    "the harbour was quiet when the last boat came in and the men who had waited since noon went down to the quay to help with the ropes "
    "nobody asked where it had been for everyone could see the torn sail and the broken rail and the captain said only that the weather had "
    "changed sooner than he expected they carried the boxes up the hill to the old store house where the light was better and opened them one "
    "after another most of what they found was wet some letters could still be read and a few of the instruments were whole the youngest of the "
    "party wrote a list of every item with its number and its state because the owner would want an account before the end of the month when that "
    "was done they sat at the long table with bread and soup and talked about the season that lay ahead of them which would be short the price of "
    "fuel had gone up again and the company in the city had not answered any of their questions still there was work to do the engine needed a new "
    "pump the nets had to be mended and somebody must speak with the school about the summer course for beginners in the end they agreed to meet "
    "again on the first dry day and to begin with the roof since without a good roof nothing else in the place would last through another winter"
)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)


def _sum_before(lengths: Column, blocks: Column, i: Column) -> Column:
    """Sum of the first i lengths; blocks has the sums of each BLOCK of them."""
    whole = F.floor(i / BLOCK).cast("int")
    return _sum(F.slice(blocks, 1, whole)) + _sum(F.slice(lengths, whole * BLOCK + 1, i - whole * BLOCK))


def spans(text: Column, pattern: str, kind: int, keep=None, group: int = 0, also: Column | None = None) -> Column:
    """Array of ``s, k, e, v`` for the leftmost non-overlapping matches; keep(v) may drop some by a group's value."""
    none = F.array().cast("array<struct<s:int,k:int,e:int,v:string>>")

    def build(found):
        lens = F.transform(found["m"], lambda x: F.length(x).cast("long"))
        gaps = F.transform(found["p"], lambda x: F.length(x).cast("long"))
        both = F.zip_with(lens, F.slice(gaps, 1, F.size(lens)), lambda a, b: a + b)
        steps = F.when(F.size(both) > 0, F.sequence(F.lit(0), F.floor((F.size(both) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))

        def place(x):
            blocks = F.transform(steps, lambda j: _sum(F.slice(x, j * BLOCK + 1, F.lit(BLOCK))))
            return let(
                F.struct(x.alias("x"), blocks.alias("b")),
                lambda y: F.transform(
                    found["m"],
                    lambda m, i: let(
                        (_sum_before(y["x"], y["b"], i + 1)).cast("int"),
                        lambda e: F.struct((e - F.length(m)).alias("s"), F.lit(kind).alias("k"), e.alias("e"), F.get(found["g"], i).alias("v")),
                    ),
                ),
            )

        return let(both, place)

    found = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
        (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.array().cast("array<string>")).alias("g"),
        F.split(text, pattern, -1).alias("p"),
    )
    if not group:
        found = found.withField("g", found["m"])
    out = F.when((also if also is not None else F.lit(True)) & F.regexp_like(text, F.lit(pattern)), let(found, build)).otherwise(none)
    return F.filter(out, keep) if keep else out


def _fisher(zs: list[Column]) -> Column:
    """-2 times the sum of the logarithms of the upper tails of the normal distribution (Abramowitz and Stegun 26.2.17)."""

    def term(z):
        def tail(x):
            poly = let(1 / (1 + 0.2316419 * x), lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))
            return F.exp(-x * x / 2) * 0.3989422804014327 * poly

        return let(let(F.least(F.abs(z), F.lit(37.0)), tail), lambda p: F.ln(F.greatest(F.when(z >= 0, p).otherwise(1 - p), F.lit(1e-300))))

    return -2 * F.aggregate(F.transform(F.array(*zs), term), F.lit(0.0), lambda a, x: a + x)


def _chi(squares: Column, df) -> Column:
    """A chi-squared sum as a normal deviate, by Wilson and Hilferty's cube root."""
    df = df if isinstance(df, Column) else F.lit(float(df))
    return (F.pow(F.greatest(squares, F.lit(1e-9)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))


def encoding(token: Column) -> Column:
    """The inferred encoding, null where none fits."""
    has = lambda p: F.regexp_like(token, F.lit(p))
    mixed = has("[0-9]") & has("[A-Za-z]")
    return (
        F.when(mixed & (has("^[0-9a-f]+$") | has("^[0-9A-F]+$")), HEX_DIGITS)
        .when(mixed & has("^[A-Z2-7]+=*$"), BASE32)
        .when(mixed & (has("^[a-z0-9]+$") | has("^[A-Z0-9]+$")), BASE36)
        .when(has("[0-9]") & has("[a-z]") & has("[A-Z]"), BASE64)
    )


def _count(s: Column, chars: str) -> Column:
    return (F.length(s) - F.length(F.translate(s, chars, ""))).cast("double")


def _runs(s: Column) -> Column:
    return F.regexp_count(s, F.lit(r"(.)\1*+")).cast("double")


def _symbols(s: Column, n: Column, alphabet: str) -> Column:
    """Chi-squared sum over the symbols of an alphabet, n characters in all."""
    squares = F.aggregate(F.lit(list(alphabet)), F.lit(0.0), lambda acc, c: acc + F.pow((F.length(s) - F.length(F.replace(s, c, F.lit("")))).cast("double"), F.lit(2)))
    return squares * len(alphabet) / n - n


def _hex_score(body: Column) -> Column:
    def score(b):
        n = F.length(b).cast("double")
        letters = _count(b, "abcdef")
        kinds = F.pow(letters - n * 6 / 16, F.lit(2)) * (16 / 6 + 16 / 10) / n
        z = (_runs(F.translate(b, "0123456789abcdef", "llllllllhhhhhhhh")) - 1 - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        return _fisher([_chi(kinds, 1), _chi(_symbols(b, n, "0123456789abcdef"), 15), F.abs(z)])

    return let(F.lower(body), score)


def _letter_score(body: Column, kind: Column) -> Column:
    """Score for the alphabets with letters beyond f."""

    def score(x):
        b, low = x["b"], x["low"]
        n, m = F.length(b).cast("double"), F.length(low).cast("double")
        counts = (_count(b, UPPER), _count(b, LOWER))
        counts += (n - counts[0] - counts[1],)
        chance = [F.get(F.lit([0.0] + [CHANCES[k][i] for k in sorted(CHANCES)]), kind) for i in range(3)]
        cells = F.array(*[F.struct(c.alias("c"), (n * p).alias("e")) for c, p in zip(counts, chance, strict=True)])
        kinds = F.aggregate(cells, F.lit(0.0), lambda a, y: a + F.when(y["e"] > 0, F.pow(y["c"] - y["e"], F.lit(2)) / y["e"]).otherwise(0.0))
        change = F.get(F.lit([0.5] + [1 - sum(p * p for p in CHANCES[k]) for k in sorted(CHANCES)]), kind)
        df = F.get(F.lit([1.0] + [sum(p > 0 for p in CHANCES[k]) - 1.0 for k in sorted(CHANCES)]), kind)
        runs = _runs(F.translate(b, UPPER + LOWER + DIGITS + "+/-_", "u" * 26 + "l" * 26 + "d" * 14))
        few = ((n - 1) * change - (runs - 1) - 0.5) / F.sqrt((n - 1) * change * (1 - change))
        v = len(VOWELS) / 26
        many = (_count(low, VOWELS) - m * v - 0.5) / F.sqrt(F.greatest(m, F.lit(1)) * v * (1 - v))
        turn = 2 * v * (1 - v)
        sound = F.translate(low, LOWER, "".join("v" if c in VOWELS else "c" for c in LOWER))
        turns = (_runs(sound) - 1 - (m - 1) * turn - 0.5) / F.sqrt(F.greatest(m - 1, F.lit(1)) * turn * (1 - turn))
        two = lambda z: F.when(m > 1, z).otherwise(-37.0)  # noqa: E731  tests of at least two letters
        return _fisher([_chi(kinds, df), two(_chi(_symbols(low, m, LOWER), 25)), few, many, two(turns)])

    low = F.lower(F.translate(body, DIGITS + "+/-_", ""))
    return let(F.struct(body.alias("b"), low.alias("low")), score)


def score(token: Column, kind: Column) -> Column:
    """How far a token of the inferred encoding is from random: Fisher's sum over the battery."""
    body = F.rtrim(token, F.lit("="))
    return F.when(kind == HEX_DIGITS, _hex_score(body)).otherwise(_letter_score(body, kind))


def _bin(x: Column) -> Column:
    return F.least(F.floor(x / BIN), F.lit(BINS)).cast("int")


def length_class(n: Column) -> Column:
    out = F.lit(len(CLASSES) - 1)
    for i in range(len(CLASSES) - 2, -1, -1):
        out = F.when(n < CLASSES[i + 1], i).otherwise(out)
    return out


def _decoy(words: Column, h: Column, enc: Column, cls: Column) -> Column:
    """``e, c, b`` (encoding, length class, bin) of the decoy that an array of words gives, by a hash; null if they are too few."""
    low, high = F.lit(list(CLASSES)), F.lit([*CLASSES[1:], CLASSES[-1] + 32])
    n = (F.get(low, cls) + F.pmod(h, (F.get(high, cls) - F.get(low, cls)).cast("long"))).cast("int")

    def build(x):
        tail = F.substring(F.lpad(F.pmod(x["h"], F.lit(1000)).cast("string"), 3, "7"), 1, 3)
        tail = F.substr(tail, F.lit(1), (F.pmod(F.shiftright(x["h"], 7), F.lit(3)) + 1).cast("int"))

        def made(y):
            out = F.when(x["e"] == HEX_DIGITS, F.substr(F.hex(F.encode(x["w"], "utf-8")), F.lit(1), x["n"]))
            out = out.when(x["e"] == BASE32, F.concat(F.upper(y["own"]), F.translate(y["tail"], "0189", "2345")))
            out = out.when(x["e"] == BASE36, F.concat(F.lower(y["own"]), y["tail"])).otherwise(F.concat(y["own"], y["tail"]))
            return _bin(score(out, x["e"]))

        parts = let(tail, lambda d: F.struct(d.alias("tail"), F.substr(x["w"], F.lit(1), x["n"] - F.length(d)).alias("own")))
        return F.when(F.length(x["w"]) >= x["n"], F.struct(x["e"].alias("e"), x["c"].alias("c"), let(parts, made).alias("b")))

    joined = F.array_join(F.transform(words, lambda w: F.initcap(F.lower(w))), "")
    return let(F.struct(joined.alias("w"), h.alias("h"), n.alias("n"), enc.alias("e"), cls.alias("c")), build)


def _pieces(size: Column, steps: list[int], h: Column) -> Column:
    """``i, s``: the place in CYCLE and the start of each piece that a string of that size is cut into.

    Pieces have these lengths in turn, from a place that h chooses, and leave nothing out; the last may be shorter.
    """
    k, c = len(steps), len(CLASSES)
    starts, total = list(accumulate(steps, initial=0)), sum(steps)
    least = min(sum((steps * 2)[i : i + c]) for i in range(k))
    first = F.pmod(h, F.lit(k).cast("long")).cast("int")
    at = lambda j: F.get(F.lit(starts[:-1]), j % k) + F.floor(j / k).cast("int") * total

    def cut_(x):
        enough = F.sequence(F.lit(0), ((F.floor(size / least) + 1) * c - 1).cast("int"))
        return F.transform(enough, lambda j: F.struct(((x["i"] + j) % k).alias("i"), (at(x["i"] + j) - x["s"]).alias("s")))

    return F.filter(let(F.struct(first.alias("i"), at(first).alias("s")), cut_), lambda x: x["s"] < size)


def _own_decoys(text: Column) -> Column:
    """``own, tail, e`` of a text's decoys: all its plain words, in letters (e -1) and once more as hexadecimal digits (e 0).

    Only what is left at the end, if it is too short for the shortest class, gives none.
    """
    own, half = [n - len(d) for n, d in CYCLE], [(n + 1) // 2 for n, _ in CYCLE]
    of = lambda values, x: F.get(F.lit(values), x["i"])

    def build(w):
        size, h = F.length(w), F.xxhash64(text)
        # places in a binary are found at once, those in a string from its start on
        part = lambda x, steps: F.substr(w, x["s"] + 1, of(steps, x))
        letters = F.filter(_pieces(size, own, h), lambda x: size - x["s"] + of([len(d) for _, d in CYCLE], x) >= CLASSES[0])
        digits = F.filter(_pieces(size, half, h), lambda x: (size - x["s"]) * 2 >= CLASSES[0])
        return F.concat(
            F.transform(letters, lambda x: F.struct(part(x, own).cast("string").alias("own"), of([d for _, d in CYCLE], x).alias("tail"), F.lit(-1).alias("e"))),
            F.transform(digits, lambda x: F.struct(F.lower(F.substr(F.hex(part(x, half)), F.lit(1), of([n for n, _ in CYCLE], x))).alias("own"), F.lit("").alias("tail"), F.lit(HEX_DIGITS).alias("e"))),
        )

    words = F.array_join(F.regexp_extract_all(text, F.lit(PLAIN), F.lit(0)), " ")
    return let(F.encode(F.replace(F.initcap(F.lower(words)), F.lit(" "), F.lit("")), "utf-8"), build)


def _binned(decoys: DataFrame) -> DataFrame:
    """``side`` 1 and, for rows of ``own, tail, e``, an array ``x`` of ``e, c, b`` (encoding, length class, bin); side 0 and the one in ``given`` where that is not null.

    The battery of ``score`` for what decoys are made of, a column for each step: rows are compiled, lambdas are not.
    Each step has one lambda, which keeps it out of the code of a whole stage: that puts all steps into one method,
    and Java does not compile methods of over 8,000 bytes. Symbols are counted by taking one after the other out.
    """
    step = lambda df, *columns: df.select(let(F.col("e"), lambda x: x).alias("e"), "given", *columns)
    hexed = F.col("e") == HEX_DIGITS
    rest = [F.lower("own")]
    for i, c in enumerate(LETTERS_OUT[:-1]):
        rest.append(F.replace(rest[-1], F.when(hexed, F.lit(DIGITS_OUT[i])).otherwise(F.lit(c)) if i < len(DIGITS_OUT) else F.lit(c), F.lit("")))
    at = lambda i: F.ascii(F.substring("own", i, 1))
    df = step(
        decoys,
        F.octet_length("tail").alias("tail"),
        *[F.octet_length(x).alias(f"left{i}") for i, x in enumerate(rest)],
        # lower case differs from upper case by one bit
        (F.bitmap_count(rest[0].cast("binary")) - F.bitmap_count(F.col("own").cast("binary"))).alias("capitals"),
        at(1).alias("first"),
        at(-1).alias("last"),
        # runs of vowels
        (F.octet_length(F.when(hexed, F.lit("")).otherwise(F.regexp_replace(rest[0], f"[{VOWELS}]+", "0"))) - F.octet_length(rest[len(VOWELS)])).alias("open"),
    )
    left = [F.col(f"left{i}") for i in range(len(rest))] + [F.lit(0)]
    seen = [left[i] - left[i + 1] for i in range(len(rest))]
    small = lambda c: (F.col(c) >= ord("a")).cast("int")
    closed = lambda c: (~F.col(c).isin([ord(v) for v in VOWELS + VOWELS.upper()])).cast("int")
    # runs of two kinds, if those of one kind are known and whether the other kind stands first and last
    both = lambda k, first, last: F.when(k > 0, 2 * k - 1 + first + last).otherwise(1)
    df = step(
        df,
        *[
            c.cast("double").alias(name)
            for name, c in {
                "m": left[0],
                "d": F.col("tail"),
                "n": left[0] + F.col("tail"),
                "squares": sum((x * x for x in seen[1:]), seen[0] * seen[0]),
                # letters; capitals
                "some": F.when(hexed, left[10]).otherwise(F.col("capitals")),
                # digits in turn are high halves of bytes, under 8, and low ones; a word has one capital, its first letter, and two letters or more
                "runs": F.when(hexed, both(left[8], F.lit(1), (F.col("last") < ord("8")).cast("int"))).otherwise(both(F.col("capitals"), small("first"), small("last")) + 1),
                "vowels": left[0] - left[len(VOWELS)],
                "sounds": both(F.col("open"), closed("first"), closed("last")),
            }.items()
        ],
    )
    m, n, d, some, runs = (F.col(c) for c in ("m", "n", "d", "some", "runs"))
    v = len(VOWELS) / 26
    turn = 2 * v * (1 - v)
    kinds = lambda cells: sum(((c - n * p) * (c - n * p) / (n * p) for c, p in cells), F.lit(0.0))
    few = lambda e, runs: (lambda change: ((n - 1) * change - (runs - 1) - 0.5) / F.sqrt((n - 1) * (change * (1 - change))))(1 - sum(p * p for p in CHANCES[e]))
    zs = {
        "z0": F.when(hexed, _chi(F.pow(some - n * 6 / 16, F.lit(2.0)) * (16 / 6 + 16 / 10) / n, 1)).otherwise((F.col("vowels") - m * v - 0.5) / F.sqrt(m * v * (1 - v))),
        "z1": F.when(hexed, _chi(F.col("squares") * 16 / n - n, 15)).otherwise(_chi(F.col("squares") * 26 / m - m, 25)),
        "z2": F.when(hexed, F.abs((runs - 1 - (n - 1) / 2) / F.sqrt((n - 1) / 4))).otherwise((F.col("sounds") - 1 - (m - 1) * turn - 0.5) / F.sqrt((m - 1) * turn * (1 - turn))),
        # one case of letters, then digits
        "z3": _chi(kinds(((m, 26 / 32), (d, 6 / 32))), 1),
        "z4": few(BASE32, F.lit(2.0)),
        "z5": _chi(kinds(((m, 26 / 36), (d, 10 / 36))), 1),
        "z6": few(BASE36, F.lit(2.0)),
        "z7": _chi(kinds(((some, 26 / 64), (m - some, 26 / 64), (d, 12 / 64))), 2),
        "z8": few(BASE64, runs),
    }
    df = step(df, "n", *[z.alias(k) for k, z in zs.items()])
    df = step(df, "n", *zs, *[(1 / (1 + 0.2316419 * F.least(F.abs(F.col(z)), F.lit(37.0)))).alias(f"t{z}") for z in zs])

    def log_tail(z):
        t, x = F.col(f"t{z}"), F.least(F.abs(F.col(z)), F.lit(37.0))
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.exp(-x * x / 2) * 0.3989422804014327 * poly

    df = step(df, "n", *zs, *[log_tail(z).alias(f"p{z}") for z in zs])
    logs = [(-2 * F.ln(F.greatest(F.when(F.col(z) >= 0, F.col(f"p{z}")).otherwise(1 - F.col(f"p{z}")), F.lit(1e-300)))).alias(f"l{i}") for i, z in enumerate(zs)]
    df = step(df, length_class(F.col("n")).alias("c"), *logs)
    df = step(df, "c", *[f"l{i}" for i in range(3, len(zs))], (F.col("l0") + F.col("l1") + F.col("l2")).alias("same"))
    one = lambda e, *more: F.struct(F.lit(e).alias("e"), F.col("c"), _bin(sum(map(F.col, more), F.col("same"))).alias("b"))
    three = F.array(one(BASE32, "l3", "l4"), one(BASE36, "l5", "l6"), one(BASE64, "l7", "l8"))
    return df.select(F.when(F.col("given").isNotNull(), F.array(F.struct("given.e", "given.c", "given.b"))).when(hexed, F.array(one(HEX_DIGITS))).otherwise(three).alias("x"), F.when(F.col("given").isNull(), 1).otherwise(0).alias("side"))


def _found(text: Column) -> Column:
    """``base`` and ``more``: spans of the fixed kinds, and the method's candidates with encoding, class and bin."""
    six = lambda x: F.length(x["v"]) >= 6
    base = F.concat(
        spans(text, ASSIGN, 0, six, group=2, also=F.regexp_like(text, F.lit(KEYWORD))),
        spans(text, ACCESS, 1, also=F.contains(text, F.lit("AKIA"))),
        spans(text, HEX, 2),
    )

    def build(x):
        free = F.filter(x["more"], lambda c: ~F.exists(x["base"], lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
        known = F.transform(free, lambda c: F.struct(*[c[f].alias(f) for f in "skev"], encoding(c["v"]).alias("enc")))
        scored = F.transform(
            F.filter(known, lambda c: c["enc"].isNotNull()),
            lambda c: F.struct(*[c[f].alias(f) for f in "skev"], c["enc"].alias("enc"), length_class(F.length(F.rtrim(c["v"], F.lit("=")))).alias("cls"), _bin(score(c["v"], c["enc"])).alias("bin")),
        )
        return F.struct(x["base"].alias("base"), F.when(F.size(x["more"]) > 0, scored).alias("more"))

    return let(F.struct(F.sort_array(base).alias("base"), spans(text, CANDIDATE, 3).alias("more")), build)


def limits(candidates: dict, decoys: dict, fdr: float) -> dict[tuple[int, int], int]:
    """For each encoding and length class the last bin that is reported, by Benjamini-Hochberg in each class.

    Both are counts by (encoding, class, bin). A bin's p-value is the share of the decoys of its encoding and
    class, one more added, that are in it or below.
    """
    out = {}
    for cls in {c for _, c, _ in candidates}:
        ps = []
        for enc, c, b in candidates:
            if c == cls:
                null = [(x, n) for (e, d, x), n in decoys.items() if (e, d) == (enc, cls)]
                ps.append(((1 + sum(n for x, n in null if x <= b)) / (1 + sum(n for _, n in null)), enc, b))
        ps.sort()
        total, upto, passed = sum(n for (_, c, _), n in candidates.items() if c == cls), 0, 0
        for i, (p, enc, b) in enumerate(ps):
            upto += candidates[enc, cls, b]
            if p * total <= fdr * upto:
                passed = i + 1
        for _, enc, b in ps[:passed]:
            out[enc, cls] = max(b, out.get((enc, cls), -1))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.05) -> DataFrame:
    """``doc_id, base, found``: arrays of spans ``s, k, e, v`` by start and kind, a row for each row of docs.

    Places are in code points, the end exclusive. base has the fixed kinds, found also the method's. Null
    texts count as empty and have none; repeated rows count as often as they stand. Texts are read whole,
    however long; other columns are not read. An empty table gives none.
    """
    return _scanned(docs.select(F.struct(F.col(id_col).alias("id"), F.col(text_col).alias("text")).alias("row")), "text", fdr).select(F.col("row.id").alias("doc_id"), "base", "found")


def _scanned(rows: DataFrame, text_col: str, fdr: float) -> DataFrame:
    """``row, base, found`` of rows whose struct ``row`` has the text."""
    text = text_or_empty(f"row.`{text_col}`")
    spark = rows.sparkSession
    words = PROSE.split()
    plain = [(words[i : i + 60], i * 2654435761 % (1 << 31), e, c) for i in range(0, len(words) - 40, 2) for e in range(4) for c in range(len(CLASSES))]
    fixed = spark.createDataFrame(plain, "w array<string>, h long, e int, c int").select(F.lit(1).alias("side"), _decoy(F.col("w"), F.col("h"), F.col("e"), F.col("c")).alias("x")).where("x IS NOT NULL")
    more = lambda t: F.transform(_found(t)["more"], lambda c: F.struct(c["enc"].alias("e"), c["cls"].alias("c"), c["bin"].alias("b")))
    none = F.lit(None).cast("struct<e:int,c:int,b:int>")

    def sides(t):
        made = F.transform(_own_decoys(t), lambda x: F.struct(*[x[f].alias(f) for f in ("own", "tail", "e")], none.alias("given")))
        given = F.transform(F.when(F.regexp_like(t, F.lit(CANDIDATE)), more(t)), lambda x: F.struct(F.lit(LOWER).alias("own"), F.lit("1").alias("tail"), F.lit(-1).alias("e"), x.alias("given")))
        return F.concat(made, F.coalesce(given, F.array().cast("array<struct<own:string,tail:string,e:int,given:struct<e:int,c:int,b:int>>>")))

    # outer: from a plain explode the optimizer infers a filter on all that is exploded, and works it out twice
    both = rows.select(F.explode_outer(let(text, sides)).alias("x")).select("x.*").where("own IS NOT NULL")
    counted = _binned(both).select("side", F.explode_outer("x").alias("x")).unionByName(fixed)
    # at most 2 sides x 4 encodings x 9 classes x 1,201 bins
    hist = counted.groupBy("side", "x.e", "x.c", "x.b").count().collect()
    table_ = [{(r["e"], r["c"], r["b"]): r["count"] for r in hist if r["side"] == s and r["b"] is not None} for s in (0, 1)]
    last = limits(*table_, fdr)
    upto = F.lit([last.get((e, c), -1) for e in range(4) for c in range(len(CLASSES))])
    found = rows.withColumn("x", let(text, _found))

    def report(x):
        random = F.filter(F.coalesce(x["more"], F.array().cast(MORE)), lambda c: c["bin"] <= F.get(upto, c["enc"] * len(CLASSES) + c["cls"]))
        added = F.transform(random, lambda c: F.struct(*[c[f].alias(f) for f in "skev"]))
        return F.struct(x["base"].alias("base"), F.sort_array(F.concat(x["base"], added)).alias("found"))

    return found.select("row", let(F.col("x"), report).alias("x")).select("row", "x.base", "x.found")


def written(found: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def masked(text: Column, found: Column) -> Column:
    """The text with every span, or run of overlapping spans, replaced by MASK."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        return F.struct(
            F.greatest(acc["at"], x["e"]).alias("at"),
            F.when(x["s"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(F.substr(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(MASK)))).alias("out"),
        )

    return F.aggregate(found, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1)))


def redact(docs: DataFrame, text_col: str = "text", fdr: float = 0.05) -> DataFrame:
    """docs with the secrets in the text masked; other columns and all rows stay, null texts stay null."""
    found = _scanned(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), text_col, fdr)
    text = F.col(f"row.`{text_col}`")
    clean = F.when(F.size("found") > 0, masked(text, F.col("found"))).otherwise(text)
    return found.select(*[clean.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])


def op7(spark, sf_dir):
    df = scan(dealt(table(spark, sf_dir, "documents")))
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return df.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("found")).alias("spans")
    )


def base(spark, sf_dir):
    """The columns of op7 that the method adds nothing to, which SQL can express."""
    return op7(spark, sf_dir).drop("spans")


_SQL_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _sql_spans(kind: int, pattern: str, value: str, least: int) -> str:
    """Matches with their places: lengths of the pieces between them and of the matches, summed up."""
    return f"""k{kind} AS (
  SELECT r, {kind} AS k, e - length(m) AS s, e FROM (
    SELECT r, m, v, sum(length(m) + length(p)) OVER (PARTITION BY r ORDER BY i) AS e FROM (
      SELECT r, unnest(m) AS m, unnest({value}) AS v, unnest(p[1:len(m)]) AS p, unnest(range(1, len(m) + 1)) AS i
      FROM (SELECT r, t, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p FROM d) WHERE len(m) > 0))
  WHERE length(v) >= {least})"""


QUERIES = {"op7_secret_scan": op7, "secret_base": base}
SQL = {
    "secret_base": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
{_sql_spans(0, _SQL_ASSIGN, f"regexp_extract_all(t, '{_SQL_ASSIGN}', 2)", 6)},
{_sql_spans(1, "AKIA[A-Z0-9]+", "m", 20)},
{_sql_spans(2, "[0-9a-f]+", "m", 24)},
x AS (SELECT * FROM k0 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2),
y AS (
  SELECT r, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
         string_agg(['assign', 'access', 'hex'][k + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k) AS spans
  FROM x GROUP BY r)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN y USING (r)
"""
}
