"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Validated numbers and dates go through a keyed Feistel network over their own format: a card number stays a
card number with a right check digit, an address an address, a date a date, a social security number one
without a void group, a phone number one of its country. The permutation depends on the key and the value
alone, not on blanks, dashes or brackets, so equal values stay linked across documents.
"""

from __future__ import annotations

import os
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import table, without

ROUNDS = 8
#: E-mail names of at most 16 letters and digits of ASCII, which are permuted among all with as many.
NAME = r"^(?=[._%+-]*(?:[0-9A-Za-z][._%+-]*){1,16}$).{1,64}$"
LETTERS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Of other names digests have so many characters at least, so that short ones do not become one.
NAME_LENGTH = 12
Key = str | Column
#: A host has at most 127 labels of 63 characters, which also bounds how deep the matcher goes.
EMAIL = r"[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}){0,125}\.[A-Za-z]{2,24}"
SECRET = r"[0-9a-f]{32,64}+(?![0-9A-Za-z])|[0-9A-F]{32,64}+(?![0-9A-Za-z])"
#: A date may be the first part of a timestamp.
DATE = r"\d{4}-\d{2}-\d{2}(?:(?=T\d)|(?![\w-]))|\d{1,2}[./]\d{1,2}[./]\d{4}(?!\w|[./]\d)"
ADDRESS = r"\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"
SOCIAL = r"\d{3}-\d{2}-\d{4}(?![\w-])"
CARD = r"\d(?:[ -]?\d){12,18}+(?![\d])"
#: Where a phone number ends although digits follow: a card, a date or the like starts.
OTHER = rf"\d{{4}}(?:[ -]\d{{4}}){{3}}(?!\d)|\d{{4}}[ -]\d{{6}}[ -]\d{{4,5}}(?!\d)|\d{{13,19}}(?!\d)|{SECRET}|{DATE}|{ADDRESS}|{SOCIAL}"
#: At most 15 digits: what ends in 16 digits with up to two marks between them is tried with fewer groups.
SIXTEEN = r"\d" + r"[ .()-]{0,2}\d" * 15
PHONE = rf"\+\d{{1,3}}(?:[ .-](?!{OTHER}))?(?:\(\d{{2,4}}\)|\d{{2,4}})(?:(?:[ .-](?!{OTHER}))?\d{{2,4}}){{2,4}}(?!\d)(?<!{SIXTEEN})|\(\d{{3}}\) ?\d{{3}}-\d{{4}}(?!\d)"
#: A run of at least 13 digits, up to where another find starts; cards are looked for among its groups.
RUN = rf"\d(?: (?!{EMAIL}|{SECRET}|{DATE}|{ADDRESS}|{SOCIAL})\d|-(?!{SECRET}|{DATE}|{ADDRESS}|{SOCIAL})\d|\d){{12,}}+"
#: How cards are grouped, where other numbers stand beside them.
GROUPED = (r"\d{4}(?:[ -]\d{4}){3}[ -]\d{1,3}", r"\d{4}(?:[ -]\d{4}){3}", r"\d{4}[ -]\d{6}[ -]\d{5}", r"\d{4}[ -]\d{6}[ -]\d{4}", r"\d{13,19}")
#: A find starts where no word, number or address is under way; the first alternative that fits wins.
FINDS = rf"(?<![\p{{L}}\p{{N}}._%+-]){EMAIL}|(?<![\w.])(?:{SECRET}|{DATE}|{ADDRESS}|{SOCIAL}|{RUN})|(?<![\w.+(]){PHONE}"
#: What every text with a find fits.
GUARD = "[0-9@]|[a-f]{32}|[A-F]{32}"
KINDS = (("email", "@"), ("secret", rf"^(?:{SECRET})$"), ("date", rf"^(?:{DATE})$"), ("address", rf"^(?:{ADDRESS})$"), ("social", rf"^(?:{SOCIAL})$"), ("card", rf"^(?:{CARD})$"), ("phone", r"\d"))
#: The Gregorian calendar repeats after so many days, 189 * 773; the dates permuted start on FIRST_DAY.
CYCLE, FIRST_DAY = (189, 773), "1800-01-01"
#: Social security numbers: 898 areas of 99 groups, and 9,999 serials.
SOCIAL_SIZES = (898 * 99, 9999)
#: Calling codes of one and two digits; all others have three.
CODES = "1|7|20|27|3[0-4]|36|39|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
#: Digital roots of doubled digits, for the check digit of card numbers.
DOUBLED = "0246813579"


def _column(key: Key) -> Column:
    return key if isinstance(key, Column) else F.lit(key)


def _drawn(key: Key, *what: Column) -> Column:
    """A keyed pseudorandom number of 60 bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", _column(key), *[w.cast("string") for w in what]), 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, sizes: tuple[Column, Column], key: Key, kind: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of the pairs (left, right) with 0 <= left < sizes[0] and 0 <= right < sizes[1]."""
    a, b = (s.cast("long") for s in sizes)

    def one(pair: Column, k: Column) -> Column:
        even = k % 2 == 0
        return F.struct(
            F.when(even, F.pmod(pair["l"] + F.pmod(_drawn(key, F.lit(kind), a, b, k, pair["r"]), a), a)).otherwise(pair["l"]).alias("l"),
            F.when(even, pair["r"]).otherwise(F.pmod(pair["r"] + F.pmod(_drawn(key, F.lit(kind), a, b, k, pair["l"]), b), b)).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), one)


def permuted_digits(digits: Column, key: Key, kind: str) -> Column:
    """A string of 2 to 36 digits, permuted among the strings of its length."""
    n = F.length(digits)
    half = (n / 2).cast("int")
    sizes = (F.pow(F.lit(10.0), half).cast("long"), F.pow(F.lit(10.0), n - half).cast("long"))
    pair = feistel(F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, n - half), sizes, key, kind)
    return F.transform(F.array(pair), lambda p: F.concat(F.lpad(p["l"].cast("string"), half, "0"), F.lpad(p["r"].cast("string"), n - half, "0")))[0]


def luhn_sum(digits: Column) -> Column:
    """The sum of the digits, every second from the right (but one) doubled."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when((n - i) % 2 == 0, value(i)).otherwise(F.substring(F.lit(DOUBLED), value(i) + 1, F.lit(1)).cast("int")))


def _put_back(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by ``digits``, in order."""
    n = F.length(shape)
    return F.aggregate(
        F.sequence(F.lit(1), n),
        F.struct(F.lit("").alias("s"), F.lit(1).alias("k")),
        lambda a, i: F.when(F.substring(shape, i, F.lit(1)).rlike(r"\d"), F.struct(F.concat(a["s"], F.substring(digits, a["k"], F.lit(1))).alias("s"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["s"], F.substring(shape, i, F.lit(1))).alias("s"), a["k"].alias("k"))),
    )["s"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _card(value: Column, key: Key) -> Column:
    body = F.transform(F.array(_digits(value)), lambda d: permuted_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card"))[0]
    full = F.transform(F.array(body), lambda d: F.concat(d, F.pmod(F.lit(10) - luhn_sum(F.concat(d, F.lit("0"))) % 10, F.lit(10)).cast("string")))[0]
    return _put_back(value, full)


def _address(value: Column, key: Key) -> Column:
    octets = F.split(value, r"\.").cast("array<long>")
    pair = feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], (F.lit(65536), F.lit(65536)), key, "address")
    four = lambda p: F.concat_ws(".", (p["l"] / 256).cast("int"), p["l"] % 256, (p["r"] / 256).cast("int"), p["r"] % 256)
    return F.transform(F.array(pair), four)[0]


def _day(value: Column) -> Column:
    """The day that a date names; null if there is no such day. Without a leading year the day comes first, or else the month."""
    iso = F.try_to_date(F.when(value.rlike(r"^\d{4}-"), value), "yyyy-MM-dd")
    parts = F.split(value, "[./]")
    read = lambda m, d: F.try_to_date(F.when(F.size(parts) == 3, F.concat_ws("-", parts[2], F.lpad(F.get(parts, F.lit(m)), 2, "0"), F.lpad(F.get(parts, F.lit(d)), 2, "0"))), "yyyy-MM-dd")
    return F.coalesce(iso, read(1, 0), read(0, 1))


def _date(value: Column, key: Key) -> Column:
    """Another day, written in the same order, with the same marks, and with leading zeros unless the date does without."""
    at = F.datediff(_day(value), F.lit(FIRST_DAY).cast("date")).cast("long")
    a, b = CYCLE
    pair = feistel((at / b).cast("long"), at % b, (F.lit(a), F.lit(b)), key, "date")
    new = F.transform(F.array(pair), lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["l"] * b + p["r"]).cast("int")))[0]
    mark = F.regexp_extract(value, "[./-]", 0)
    bare = value.rlike(r"^\d[./]|[./]\d[./]")
    month_first = F.get(F.split(value, "[./-]"), F.lit(1)).cast("int") > 12

    def written(d: Column) -> Column:
        day, month = (F.when(bare, F.date_format(d, one)).otherwise(F.date_format(d, two)) for one, two in (("d", "dd"), ("M", "MM")))
        return F.when(mark == "-", F.date_format(d, "yyyy-MM-dd")).otherwise(F.concat(F.when(month_first, month).otherwise(day), mark, F.when(month_first, day).otherwise(month), mark, F.date_format(d, "yyyy")))

    return F.transform(F.array(new), written)[0]


def _in_cycle(day: Column) -> Column:
    at = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    return day.isNotNull() & (at >= 0) & (at < CYCLE[0] * CYCLE[1])


def _phone(value: Column, key: Key) -> Column:
    """The calling code stays; the other digits are permuted, wherever blanks and brackets stand."""
    digits = _digits(value)
    code = F.when(value.startswith("+"), F.regexp_extract(digits, rf"^(?:{CODES}|\d{{3}})", 0)).otherwise("")
    full = F.transform(F.array(code), lambda c: F.concat(c, permuted_digits(F.substring(digits, F.length(c) + 1, F.length(digits)), key, "phone")))[0]
    return _put_back(value, full)


def _social(value: Column, key: Key) -> Column:
    """A permutation of the valid numbers: 666 is no area and is left out when areas are counted."""
    area, group, serial = (F.substring(value, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    area = area - F.when(area < 666, 1).otherwise(2)
    pair = feistel(area * 99 + group - 1, serial - 1, tuple(F.lit(x) for x in SOCIAL_SIZES), key, "social")

    def written(p: Column) -> Column:
        at = (p["l"] / 99).cast("long")
        area = at + F.when(at < 665, 1).otherwise(2)
        return F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad((p["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((p["r"] + 1).cast("string"), 4, "0"))

    return F.transform(F.array(pair), written)[0]


def _hidden(value: Column, key: Key, kind: str, least: int = 0) -> Column:
    """A keyed digest as long as ``value``, at least ``least`` characters (up to 128, repeated beyond)."""
    n = F.greatest(F.length(value), F.lit(least))
    digest = F.sha2(F.concat_ws("|", _column(key), F.lit(kind), value), 512)
    return F.substring(F.repeat(digest, F.ceil(n / 128).cast("int")), F.lit(1), n)


def _name(value: Column, key: Key) -> Column:
    """An e-mail name with its letters and digits permuted among all strings of as many, other characters in place."""
    let = lambda x, f: F.transform(F.array(x), f)[0]
    bare = lambda x: F.regexp_replace(x, "[^0-9A-Za-z]", "")
    power = lambda k: F.pow(F.lit(float(len(LETTERS))), k).cast("long")  # noqa: E731 - exact up to the eighth
    places = lambda n: F.filter(F.sequence(F.lit(1), F.lit(8)), lambda i: i <= n)
    number = lambda x: F.aggregate(places(F.length(x)), F.lit(0).cast("long"), lambda a, i: a * len(LETTERS) + F.position(F.substring(x, i, F.lit(1)), F.lit(LETTERS)) - 1)
    letters = lambda x, n: F.array_join(F.transform(places(n), lambda i: F.substring(F.lit(LETTERS), (F.floor(x / power(n - i)) % len(LETTERS) + 1).cast("int"), F.lit(1))), "")

    def permuted(own: Column) -> Column:
        n = F.length(own)
        half = (n / 2).cast("int")
        pair = feistel(number(F.substring(own, F.lit(1), half)), number(F.substring(own, half + 1, n - half)), (power(half), power(n - half)), key, "email")
        return let(pair, lambda p: F.concat(letters(p["l"], half), letters(p["r"], n - half)))

    def written(new: Column) -> Column:
        at = lambda i: F.substring(value, i, F.lit(1))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.when(at(i).rlike("[0-9A-Za-z]"), F.substring(new, F.length(bare(F.substring(value, F.lit(1), i))), F.lit(1))).otherwise(at(i))), "")

    return F.when(value.rlike(NAME), let(let(bare(value), permuted), written)).otherwise(_hidden(value, key, "email", NAME_LENGTH))


def _checked(digits: Column) -> Column:
    """Whether the last digit is the right check digit of the others, and not all are zero."""
    return (luhn_sum(digits) % 10 == 0) & ~digits.rlike("^0+$")


def card_pieces(run: Column) -> Column:
    """The pieces of a run of digits, in order, as (card, value); put together they are the run.

    A piece that is a card starts and ends with whole groups and has a right check digit. From the left, 13 to 19
    digits however grouped come first, as far as the run goes, then the groupings of GROUPED. Groups that are no
    card cost a look each; only cards add to what is carried along.
    """
    let = lambda x, f: F.transform(F.array(x), f)[0]
    groups = lambda x: F.length(F.regexp_replace(x, r"\d", "")) + 1
    piece = lambda card, x: F.struct(F.lit(card).alias("card"), x.alias("value"))

    def step(a: Column, i: Column, all_: Column) -> Column:
        tail = F.regexp_replace(F.array_join(F.slice(all_, i, 20), ""), "^[ -]", "")
        whole = lambda t: F.when(i >= a["whole"], F.regexp_extract(t, f"^{CARD}", 0)).otherwise("")
        tried = lambda t: F.struct(whole(t).alias("whole"), F.array(whole(t), *[F.regexp_extract(t, rf"^{g}(?!\d)", 0) for g in GROUPED]).alias("all"))
        first = lambda x: F.get(F.filter(x["all"], lambda v: (v != "") & _checked(_digits(v))), F.lit(0))

        def went(x: Column) -> Column:
            card = x["card"]
            return F.struct(
                F.when(card.isNotNull(), i + groups(card)).otherwise(a["until"]).alias("until"),
                F.when(x["whole"] != "", i + groups(x["whole"])).otherwise(a["whole"]).alias("whole"),
                F.when(card.isNotNull(), F.concat(a["out"], F.array(F.struct(i.alias("at"), (i + groups(card)).alias("end"), card.alias("value"))))).otherwise(a["out"]).alias("out"),
            )

        tried_ = let(tail, tried)
        return F.when(i < a["until"], a).otherwise(let(let(tried_, lambda x: F.struct(x["whole"].alias("whole"), first(x).alias("card"))), went))

    start = F.struct(F.lit(0).alias("until"), F.lit(0).alias("whole"), F.array().cast("array<struct<at:int,end:int,value:string>>").alias("out"))

    def split(all_: Column, cards: Column) -> Column:
        n = F.size(all_)
        between = lambda lo, hi: F.array_join(F.slice(all_, lo, F.greatest(hi - lo, F.lit(0))), "")
        since = lambda k: F.when(k == 0, F.lit(1)).otherwise(F.get(cards, k - 1)["end"])
        led = lambda c, k: F.concat(between(since(k), c["at"]), F.regexp_extract(F.element_at(all_, c["at"]), "^[ -]?", 0))
        each = F.flatten(F.transform(cards, lambda c, k: F.array(piece(False, led(c, k)), piece(True, c["value"]))))
        return F.filter(F.concat(each, F.array(piece(False, between(since(F.size(cards)), n + 1)))), lambda p: p["value"] != "")

    folded = lambda all_: F.aggregate(F.sequence(F.lit(1), F.size(all_)), start, lambda a, i: step(a, i, all_))["out"]
    return let(F.regexp_extract_all(run, F.lit(r"[ -]?\d+"), F.lit(0)), lambda all_: let(folded(all_), lambda cards: split(all_, cards)))


def kind_of(value: Column) -> Column:
    """What a find is, or null if it does not stand its check and so stays as it is."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS):
        kind = F.when(value.rlike(pattern), F.lit(name)).otherwise(kind)
    octets = F.split(value, r"\.")
    digits = _digits(value)
    return F.transform(
        F.array(kind),
        lambda k: F.when(k == "card", F.when(_checked(digits), k))
        .when(k == "date", F.when(_in_cycle(_day(value)), k))
        .when(k == "address", F.when(F.forall(octets, lambda o: o.cast("int") <= 255), k))
        .when(k == "social", F.when(~value.rlike("^(000|666|9)|-00-|-0000$"), k))
        .when(k == "phone", F.when(F.length(digits).between(7, 15), k))
        .otherwise(k),
    )[0]


def pseudonym(value: Column, kind: Column, key: Key) -> Column:
    """The pseudonym of a find of this kind; the value itself where the kind is null."""
    name = F.substring_index(value, "@", 1)
    secret = F.transform(F.array(_hidden(value, key, "secret")), lambda h: F.when(value.rlike("[A-F]"), F.upper(h)).otherwise(h))[0]
    return (
        F.when(kind == "email", F.concat(_name(name, key), F.substring(value, F.length(name) + 1, F.length(value))))
        .when(kind == "secret", secret)
        .when(kind == "date", _date(value, key))
        .when(kind == "address", _address(value, key))
        .when(kind == "social", _social(value, key))
        .when(kind == "card", _card(value, key))
        .when(kind == "phone", _phone(value, key))
        .otherwise(value)
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text", finds: str = "finds") -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and in ``finds`` the kind, value and pseudonym of each, in order.

    What fails its check stays as it is. Cards pass with a right check digit, also beside other numbers (an expiry,
    a security code). Dates pass if the calendar has them, from 1800 to 2199: yyyy-mm-dd, or day, month and year
    with points or strokes, read month first only where the other order gives no date. One day has one pseudonym
    day, written as the date was. Addresses pass if each part is at most 255, social security numbers without a
    void group, phone numbers with 7 to 15 digits; one number has one pseudonym however it is grouped, and keeps
    its calling code. E-mail names keep their marks and have their letters and digits permuted, up to 16 of ASCII; longer
    or other names become keyed digests of at least 12 characters, and hexadecimal secrets digests of their length. Of a
    host, the first 127 labels are looked at. The
    date of a timestamp (2024-03-05T12:00) is a find, its time is not. Not looked for, and so left as they are: dates
    with two-digit years, with dashes in another order or with names of months, phone numbers without a calling code
    or an area in brackets, IPv6 addresses, hosts with letters beyond ASCII, and account numbers.

    A null text stays null and an empty one empty, without finds. One row per input row, in place, so ties, repeated
    rows and null ids need no rule; other columns are kept, one named like ``finds`` is replaced. No shuffle. Whole
    texts are read; a very long one is worked on alone, in one row. An empty key is refused: who has the key can undo
    the permutations. It comes from a table of one row, sent to the tasks, so no plan or log of plans holds it.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    docs = without(docs, finds)
    name = "key_"
    while name in map(str.lower, docs.columns):
        name += "_"
    order = docs.columns
    docs = docs.crossJoin(F.broadcast(docs.sparkSession.createDataFrame([(key,)], f"{name} string")))  # one row
    key, t = F.col(name), F.col(text)
    found = F.when(t.rlike(GUARD), F.regexp_extract_all(t, F.lit(FINDS), F.lit(0))).otherwise(F.array().cast("array<string>"))
    run = lambda v: v.rlike(r"^\d(?:[ -]?\d){12,}+$") & ~v.rlike(rf"^(?:{SECRET})$")
    kinds = lambda v: F.when(run(v), F.transform(card_pieces(v), lambda p: F.struct(F.when(p["card"], "card").alias("kind"), p["value"].alias("value")))).otherwise(F.array(F.struct(kind_of(v).alias("kind"), v.alias("value"))))
    known = F.transform(F.transform("found_", kinds), lambda pieces: F.transform(pieces, lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), pseudonym(x["value"], x["kind"], key).alias("pseudonym"))))
    written = F.array_join(F.zip_with(F.split(t, FINDS, -1), "known_", lambda gap, x: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(F.array_join(x["pseudonym"], ""), F.lit("")))), "")
    rest = [c for c in order if c != text]
    docs = docs.select("*", F.coalesce(found, F.array().cast("array<string>")).alias("found_"))
    docs = docs.select("*", known.alias("known_"))
    columns = {c: F.col(c) for c in rest} | {text: F.when(F.size("known_") > 0, written).otherwise(t)}
    return docs.select(*[columns[c].alias(c) for c in order], F.filter(F.flatten("known_"), lambda x: x["kind"].isNotNull()).alias(finds))


#: The setting that holds the key; Spark redacts names with "secret" in its listings.
KEY_SETTING = "spark.ravelin.pseudonym.secret"


def session_key(spark: SparkSession) -> str:
    """The key of this application: from the setting or RAVELIN_PSEUDONYM_SECRET, else drawn once at random.

    A drawn key is nowhere stored, so pseudonyms are linked within the application and nobody can undo them.
    """
    key = spark.conf.get(KEY_SETTING, None) or os.environ.get("RAVELIN_PSEUDONYM_SECRET")
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms in its text, and how many of each group it has."""
    docs = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
    some = lambda *kinds: F.size(F.filter("finds", lambda x: x["kind"].isin(*kinds))).cast("long")
    return docs.select(
        "doc_id",
        "text",
        some("card", "social", "phone", "address").alias("n_numbers"),
        some("date").alias("n_dates"),
        some("email", "secret").alias("n_hidden"),
        F.size("finds").cast("long").alias("n_finds"),
    )
