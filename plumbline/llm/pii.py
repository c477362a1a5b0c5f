"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Candidates are found by one pattern, validated, and permuted within their format by a
keyed Feistel network: card numbers keep their length, separators and Luhn check; account
numbers (IBAN) their country and mod-97 check; social security numbers their valid ranges;
IPv4 addresses and dates stay addresses and dates; phone numbers (of up to 15 digits) keep
their country code and layout; mail addresses keep the shape of the part before the @ and of the domain's
names, up to the last; long hexadecimal secrets keep length and case. Equal values get
equal pseudonyms in every document, and different values of one format different ones.
What fails its validation (a number without a Luhn check, the 31st of June) is left as it
is, and so are texts with nothing found. Null texts stay null, empty ones empty; rows are
changed one by one, so repeated rows and empty tables are no special case, and other
columns of the input pass through.

The key is part of the plan, as literals are; give it by a redacted configuration.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import spare

log = logging.getLogger(__name__)
#: For tests and demonstrations; a deployment sets spark.plumbline.pii.key.
DEFAULT_KEY = "a key for demonstration only"
ROUNDS = 8

MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,8}+"
IP = r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)"
DAY = r"(?<![\w.-])(?:\d{4}-\d\d-\d\d|\d\d\.\d\d\.\d{4}|\d\d/\d\d/\d{4})(?![\w-]|\.\d)"
SSN = r"(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-])"
PHONE = (
    r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\) ?|\d{1,4}[ .-])?(?:\d{2,4}(?<gap>[ .-])\d{2,4}(?:\k<gap>\d{2,4}){0,5}|\d{4,12})(?<!" + r"\d[ .()-]{0,2}" * 15 + r"\d)(?!\w)"
    r"|(?<![\w+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w+.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"
)
#: Countries by the length of their account numbers.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Where the country's length doesn't fit, any length may; words in capitals may then follow that don't belong to the number.
IBAN = (
    r"(?<!\w)(?:" + "|".join(f"(?:{names.replace(' ', '|')})\\d\\d(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + f" ?[A-Z0-9]{{{n % 4}}}" * (n % 4 > 0) for n, names in IBAN_LENGTHS.items())
    + r"|[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"
)
CARD = r"(?<![\w-])(?:\d{13,19}|\d{4}(?<sep>[ -])\d{4}\k<sep>\d{4}\k<sep>\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])"
HEX = r"(?<!\w)(?=[0-9]*[a-fA-F])(?=[a-fA-F]*[0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?!\w)"
FOUND = "|".join((MAIL, IP, DAY, SSN, PHONE, IBAN, CARD, HEX))
#: Texts without any of these hold no candidate, and the pattern isn't tried on them: addresses may have single digits only, and secrets no two in a row.
HINT = r"\d\.?\d|@|[0-9a-fA-F]{32}"
#: The days of the years 1900 to 2099 make a grid of 17 by 4297.
DAY_0, DAY_GRID = -25567, (17, 4297)
#: Steps of a walk that ends on a day after the 12th, as three of five days are: it goes on with probability under 1e-24.
WALK = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def moved(part: Column, stream: Column, hexadecimal: bool) -> Column:
    """The letters and digits of part, each moved on within its kind by a byte of the hexadecimal stream."""
    letters = 6 if hexadecimal else 26

    def one(c: Column, i: Column) -> Column:
        by = F.conv(F.substring(stream, 2 * (i % 64) + 1, F.lit(2)), 16, 10).cast("int")
        a = F.ascii(c)
        at = lambda first, n: F.char(first + (a - first + by) % n)
        return F.when(c.rlike("^[0-9]$"), at(48, 10)).when(c.rlike("^[a-z]$"), at(97, letters)).when(c.rlike("^[A-Z]$"), at(65, letters)).otherwise(c)

    return F.array_join(F.transform(chars(part), one), "")


def permuted(s: Column, key: str, kind: str, hexadecimal: bool = False) -> Column:
    """A Feistel network over the halves of s: in turn one half's characters are moved by a hash of the other."""
    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), half).alias("a"), F.substring(s, half + 1, F.length(s)).alias("b"))

    def step(x: Column, r: Column) -> Column:
        even = r % 2 == 0
        seed = F.concat_ws("\0", F.lit(key), F.lit(kind), r.cast("string"), F.length(s).cast("string"), F.when(even, x["b"]).otherwise(x["a"]))
        return let(F.sha2(seed.cast("binary"), 512), lambda h: F.struct(F.when(even, moved(x["a"], h, hexadecimal)).otherwise(x["a"]).alias("a"), F.when(even, x["b"]).otherwise(moved(x["b"], h, hexadecimal)).alias("b")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda x: F.concat(x["a"], x["b"]))


def on_grid(n: Column, size: tuple[int, int], key: str, kind: str) -> Column:
    """A permutation of 0 .. size[0] * size[1] - 1, as a Feistel network over the grid's two coordinates."""
    n = n.cast("long")
    start = F.struct(F.floor(n / size[1]).cast("long").alias("a"), (n % size[1]).alias("b"))

    def step(x: Column, r: Column) -> Column:
        even = r % 2 == 0
        seed = F.concat_ws("\0", F.lit(key), F.lit(kind), r.cast("string"), F.when(even, x["b"]).otherwise(x["a"]).cast("string"))
        return let(
            F.conv(F.substring(F.sha2(seed.cast("binary"), 256), 1, 12), 16, 10).cast("long"),
            lambda h: F.struct(F.when(even, (x["a"] + h) % size[0]).otherwise(x["a"]).alias("a"), F.when(even, x["b"]).otherwise((x["b"] + h) % size[1]).alias("b")),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda x: x["a"] * size[1] + x["b"])


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def refilled(form: Column, new: Column, kept: str = "[^0-9]") -> Column:
    """form with its characters replaced in order by new's; characters like `kept` stay."""
    def one(c: Column, i: Column) -> Column:
        return F.when(c.rlike(kept), c).otherwise(F.substring(new, F.length(F.regexp_replace(F.substring(form, F.lit(1), i + 1), kept, "")), F.lit(1)))

    return F.array_join(F.transform(chars(form), one), "")


def luhn_sum(d: Column) -> Column:
    """The Luhn sum of digits, the last of which counts once."""
    doubled = F.transform(F.reverse(chars(d)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def mod_97(s: Column) -> Column:
    """Of digits and capitals, a capital counting as 10 to 35."""
    return F.aggregate(chars(s), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def card(m: Column, key: str) -> Column:
    d = digits(m)
    body = lambda x: F.substring(x, F.lit(1), F.length(x) - 1)
    new = let(permuted(body(d), key, "card"), lambda p: F.concat(p, ((10 - luhn_sum(F.concat(p, F.lit("0"))) % 10) % 10).cast("string")))
    return F.when((luhn_sum(d) % 10 == 0) & ~d.rlike("^(.)\\1*$"), let(new, lambda n: refilled(m, n))).otherwise(m)


def iban(m: Column, key: str) -> Column:
    """The longest part of m that ends with a word and passes its check is replaced; what follows it stays."""
    compact = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    passes = lambda s: mod_97(F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))) == 1
    words = F.split(m, " ")
    parts = F.transform(F.sequence(F.size(words), F.lit(1)), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))
    longest = F.get(F.filter(parts, lambda p: (F.length(compact(p)) >= 12) & passes(compact(p))), F.lit(0))

    def replaced(p: Column) -> Column:
        country, body = F.substring(p, 1, 2), F.substring(compact(p), F.lit(5), F.length(p))
        new = let(permuted(body, key, "iban"), lambda b: F.concat(country, F.lpad((98 - mod_97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
        return F.concat(let(new, lambda n: refilled(p, n, " ")), F.substring(m, F.length(p) + 1, F.length(m)))

    return F.coalesce(let(longest, replaced), m)


def ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    new = on_grid(place * 989901 + (group - 1) * 9999 + serial - 1, (898, 989901), key, "ssn")

    def show(n: Column) -> Column:
        a, rest = F.floor(n / 989901) + 1, n % 989901
        return F.format_string("%03d-%02d-%04d", a + F.when(a >= 666, 1).otherwise(0), F.floor(rest / 9999) + 1, rest % 9999 + 1)

    return F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), let(new, show)).otherwise(m)


def address(m: Column, key: str) -> Column:
    part = [F.split_part(m, F.lit("."), F.lit(i)).cast("long") for i in (1, 2, 3, 4)]
    new = on_grid(part[0] * 16777216 + part[1] * 65536 + part[2] * 256 + part[3], (65536, 65536), key, "ip")
    show = lambda n: F.concat_ws(".", *(F.floor(n / d) % 256 for d in (16777216, 65536, 256, 1)))
    return F.when((part[0] < 256) & (part[1] < 256) & (part[2] < 256) & (part[3] < 256), let(new, show)).otherwise(m)


def day(m: Column, key: str) -> Column:
    """A day of 1900 to 2099. With slashes the month comes first, unless only the other reading is a day: then the
    permutation is applied until it gives another one that has no reading but that, so pseudonyms stay apart."""
    iso = F.when(m.rlike("^\\d{4}-"), m).when(m.contains("."), F.regexp_replace(m, r"(..)\.(..)\.(....)", "$3-$2-$1")).otherwise(F.regexp_replace(m, r"(..)/(..)/(....)", "$3-$1-$2"))
    swapped = F.when(m.contains("/"), F.regexp_replace(m, r"(..)/(..)/(....)", "$3-$2-$1"))
    number = lambda s: F.datediff(F.to_date(F.try_to_timestamp(s, F.lit("yyyy-MM-dd"))), F.lit("1970-01-01").cast("date")) - DAY_0
    inside = lambda n: (n >= 0) & (n < DAY_GRID[0] * DAY_GRID[1])
    date = lambda n: F.date_add(F.lit("1970-01-01").cast("date"), (n + DAY_0).cast("int"))
    late = lambda n: F.dayofmonth(date(n)) > 12
    walked = lambda n: F.aggregate(F.sequence(F.lit(0), F.lit(WALK - 1)), n.cast("long"), lambda x, i: F.when((i > 0) & late(x), x).otherwise(on_grid(x, DAY_GRID, key, "day")))
    form = F.when(m.rlike("^\\d{4}-"), "yyyy-MM-dd").when(m.contains("."), "dd.MM.yyyy").otherwise("MM/dd/yyyy")
    shown = lambda d: F.when(form == "yyyy-MM-dd", F.date_format(d, "yyyy-MM-dd")).when(form == "dd.MM.yyyy", F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy"))
    return (
        F.when(inside(number(iso)), let(on_grid(number(iso), DAY_GRID, key, "day"), lambda n: shown(date(n))))
        .when(number(iso).isNull() & inside(number(swapped)), let(walked(number(swapped)), lambda n: F.date_format(date(n), "dd/MM/yyyy"))).otherwise(m)
    )


def phone(m: Column, key: str) -> Column:
    code = F.regexp_extract(m, r"^\+\d{1,3}(?=[ .(-])", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    n = F.length(digits(m))
    return F.when((n >= 7) & (n <= 15), F.concat(code, let(permuted(digits(rest), key, "phone"), lambda p: refilled(rest, p)))).otherwise(m)


def mail(m: Column, key: str) -> Column:
    """Case doesn't tell addresses apart: the lower-case address is permuted, and capitals are put back where they stood."""
    low = F.lower(m)
    cut = F.regexp_extract(low, r"\.[^.]*$", 0)
    body = F.substring(low, F.lit(1), F.length(low) - F.length(cut))
    new = F.concat(permuted(body, key, "mail"), cut)  # letters stay letters
    capitals = lambda n: F.array_join(F.transform(chars(m), lambda c, i: F.when(c.rlike("^[A-Z]$"), F.upper(F.substring(n, i + 1, F.lit(1)))).otherwise(F.substring(n, i + 1, F.lit(1)))), "")
    return F.when(m == low, new).otherwise(let(new, capitals))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one candidate, or the candidate where it isn't valid."""
    whole = lambda p: m.rlike("^(?:" + p + ")$")
    secret = let(F.lower(m), lambda low: F.when(m == low, permuted(low, key, "hex", True)).otherwise(F.upper(permuted(low, key, "hex", True))))
    return (
        F.when(m.contains("@"), mail(m, key)).when(whole(IP), address(m, key)).when(whole(DAY), day(m, key)).when(whole(SSN), ssn(m, key))
        .when(whole(PHONE), phone(m, key)).when(whole(IBAN), iban(m, key)).when(whole(CARD), card(m, key)).otherwise(secret)
    )


def pseudonymise(df: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """df with the personal data of one column replaced; `count` names a column for the number of replacements."""
    t, found, new = F.col(text).cast("string"), spare(df.columns, "__found"), spare(df.columns, "__new")
    columns = df.columns
    df = df.withColumn(found, F.when(t.rlike(HINT), F.regexp_extract_all(t, F.lit(FOUND), F.lit(0))))
    df = df.withColumn(new, F.when(F.size(found) > 0, F.transform(found, lambda m: pseudonym(m, key))))
    parts = F.zip_with(F.split(t, FOUND, -1), F.col(new), lambda p, n: F.concat(p, F.coalesce(n, F.lit(""))))
    changed = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x))
    if count:
        df, columns = df.withColumn(count, F.when(F.size(found) > 0, changed).otherwise(0)), [*(c for c in columns if c.lower() != count.lower()), count]
    return df.withColumn(text, F.when(F.size(found) > 0, F.array_join(parts, "")).otherwise(t)).select(*(F.col(f"`{c}`") for c in columns))


def key_of(spark: SparkSession) -> str:
    """The session's key. Without one the public key is used, which anybody can undo, and a warning is logged."""
    key = spark.conf.get("spark.plumbline.pii.key", None)
    if not key:
        log.warning("spark.plumbline.pii.key is unset; pseudonyms are made with a public key")
    return key or DEFAULT_KEY


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, key_of(spark), count="n_replaced")
