"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Every validated value is replaced by a keyed permutation of its format, so that
equal values stay equal across documents and formats (a card number with or
without blanks) and the pseudonym is valid again:

* card numbers (13 to 19 digits that pass the Luhn test): all digits but the
  last are permuted, the last is made to pass the test. A card may stand beside
  other numbers (expiry, code, another card): in a run of numbers every piece
  between number borders is tried, the usual lengths first;
* telephone numbers: all digits behind the country code;
* social security numbers (valid area, group and serial): all digits;
* dates (valid days from 1800 to 2199): the day, within these 400 years;
* IPv4 addresses (parts up to 255): the 32 bits;
* e-mail addresses: letters and digits of the local part.

The permutation is a Feistel network: in turn one half is shifted by a keyed
digest of the other. Halves are strings whose letters and digits are shifted
within their class, or numbers modulo the sizes of two factors of the domain.
Whoever has the key can invert it; SHA-256 keeps it from others. Values that
fail validation are left alone. Built-in expressions only, one pass, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
KEY = "panelscope"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
DATE = r"(?<![\d./-])(?:\d{4}(?:-\d{2}-|/\d{2}/)\d{2}|\d{2}(?:-\d{2}-|/\d{2}/|\.\d{2}\.)\d{4})(?![\d/-])"
ADDRESS = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)"
PHONE = r"(?<![\d+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\)|[ .-]\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\d-])"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
OTHER = "|".join((EMAIL, DATE, ADDRESS, PHONE, SOCIAL))
# Numbers over single blanks or hyphens, up to where another kind begins: cards and what stands beside them. Possessive,
# so that a run of any length needs no stack.
RUN = rf"(?<![\dA-Za-z])(?=\d(?:[ -]?\d){{12}})\d++(?![A-Za-z])(?:[ -](?!{OTHER})\d++(?![A-Za-z]))*+"
ANY = f"{OTHER}|{RUN}"
CARD_LENGTHS = (16, 15, 13, 14, 17, 18, 19)  # the first that passes is taken
FIRST_DAY, DAYS = "1800-01-01", (27, 5411)  # 27 x 5411 = 146,097 days are 400 years


def _digest(*parts) -> Column:
    """A keyed number of 60 bits."""
    text = F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def _shifted(char: Column, by: Column) -> Column:
    def within(letters: str) -> Column:
        return F.substr(F.lit(letters), F.pmod(F.ascii(char) - ord(letters[0]) + by, F.lit(len(letters))).cast("int") + 1, F.lit(1))

    return F.when(char.between("0", "9"), within(DIGITS)).when(char.between("a", "z"), within(LOWER)).when(char.between("A", "Z"), within(UPPER)).otherwise(char)


def permuted_text(value: Column, tag: str, key: str = KEY, invert: bool = False) -> Column:
    """Letters and digits shifted within their class; length, classes and other characters stay.

    The shifts depend on the other half in lower case, so spellings that
    differ in case only stay alike.
    """
    half = F.floor(F.length(value) / 2).cast("int")

    def shift(part: Column, other: Column, turn: Column) -> Column:
        chars = F.filter(F.split(part, ""), lambda c: c != "")
        sign = -1 if invert else 1
        return F.array_join(F.transform(chars, lambda c, i: _shifted(c, sign * F.pmod(_digest(key, tag, turn, F.lower(other), i), F.lit(780)))), "")

    def turn(state: Column, i: Column) -> Column:
        left, right = state["l"], state["r"]
        odd = i % 2 == 1
        return F.struct(F.when(odd, shift(left, right, i)).otherwise(left).alias("l"), F.when(odd, right).otherwise(shift(right, left, i)).alias("r"))

    start = F.struct(F.substr(value, F.lit(1), half).alias("l"), F.substr(value, half + 1).alias("r"))
    turns = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if invert else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(turns, start, turn, lambda s: F.concat(s["l"], s["r"]))


def permuted_number(value: Column, sizes: tuple[int, int], tag: str, key: str = KEY, invert: bool = False, rounds: int = 2 * ROUNDS) -> Column:
    """A permutation of 0 .. sizes[0] * sizes[1] - 1."""
    a, b = sizes
    sign = -1 if invert else 1

    def turn(state: Column, i: Column) -> Column:
        x, y = state["x"], state["y"]
        odd = i % 2 == 1
        return F.struct(F.when(odd, F.pmod(x + sign * F.pmod(_digest(key, tag, i, y), F.lit(a)), F.lit(a))).otherwise(x).alias("x"), F.when(odd, y).otherwise(F.pmod(y + sign * F.pmod(_digest(key, tag, i, x), F.lit(b)), F.lit(b))).alias("y"))

    value = value.cast("long")
    start = F.struct(F.floor(value / b).cast("long").alias("x"), F.pmod(value, F.lit(b)).cast("long").alias("y"))
    turns = F.sequence(F.lit(rounds), F.lit(1), F.lit(-1)) if invert else F.sequence(F.lit(1), F.lit(rounds))
    return F.aggregate(turns, start, turn, lambda s: s["x"] * b + s["y"])


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refilled(form: Column, digits: Column, keep: Column | int = 0) -> Column:
    """``form`` with its digits behind the first ``keep`` replaced by ``digits`` in order."""
    chars = F.filter(F.split(form, ""), lambda c: c != "")
    number = lambda i: F.length(digits_of(F.substr(form, F.lit(1), i + 1))) - keep
    return F.array_join(F.transform(chars, lambda c, i: F.when(c.between("0", "9") & (number(i) > 0), F.substr(digits, number(i), F.lit(1))).otherwise(c)), "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum; every second digit from the right but one counts double."""
    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    worth = F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*[F.lit(2 * d // 10 + 2 * d % 10) for d in range(10)]), c.cast("int") + 1)))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x)


def _pieces(run: Column) -> Column:
    """The numbers of a run, each with the blank or hyphen behind it."""
    return F.regexp_extract_all(run, F.lit(r"\d+[ -]?"), F.lit(0))


def _between(pieces: Column, start: Column, stop: Column) -> Column:
    return F.array_join(F.slice(pieces, start + 1, stop - start), "")


def cards_of(pieces: Column) -> Column:
    """start, stop: the cards in a run in order. Where valid pieces overlap, the more usual length wins, then the first."""

    def starting(start: Column) -> Column:
        stops = F.sequence(start + 1, F.least(F.size(pieces), start + CARD_LENGTHS[-1]))
        made = F.transform(stops, lambda stop: F.struct(digits_of(_between(pieces, start, stop)).alias("digits"), stop.alias("stop")))
        valid = F.filter(made, lambda x: F.length(x["digits"]).between(min(CARD_LENGTHS), max(CARD_LENGTHS)) & (luhn_sum(x["digits"]) % 10 == 0))
        return F.transform(valid, lambda x: F.struct(F.array_position(F.array(*map(F.lit, CARD_LENGTHS)), F.length(x["digits"])).alias("rank"), start.alias("start"), x["stop"].alias("stop")))

    valid = F.sort_array(F.flatten(F.transform(F.sequence(F.lit(0), F.size(pieces) - 1), starting)))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    free = lambda taken, x: ~F.exists(taken, lambda t: (t["start"] < x["stop"]) & (x["start"] < t["stop"]))
    return F.sort_array(F.aggregate(valid, none, lambda taken, x: F.when(free(taken, x), F.concat(taken, F.array(F.struct(x["start"], x["stop"])))).otherwise(taken)))


def _run(pieces: Column, cards: Column, key: str) -> Column:
    """The run with its cards replaced; other numbers stay."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    turn = lambda s, c: F.struct(c["stop"].alias("at"), F.concat(s["out"], F.array(_between(pieces, s["at"], c["start"]), _card(_between(pieces, c["start"], c["stop"]), key))).alias("out"))
    return F.aggregate(cards, start, turn, lambda s: F.concat(F.array_join(s["out"], ""), _between(pieces, s["at"], F.size(pieces))))


def _card(m: Column, key: str) -> Column:
    digits = digits_of(m)
    body = permuted_text(F.substr(digits, F.lit(1), F.length(digits) - 1), "card", key)
    check = F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10))
    return _refilled(m, F.concat(body, check.cast("string")))


def _day(m: Column) -> Column:
    """The day of a date in one of the formats, or null; day before month where both are possible."""
    d = F.regexp_replace(m, "[./]", "-")
    first = F.when(d.rlike(r"^\d{4}"), F.try_to_timestamp(d, F.lit("yyyy-MM-dd"))).otherwise(F.coalesce(F.try_to_timestamp(d, F.lit("dd-MM-yyyy")), F.try_to_timestamp(d, F.lit("MM-dd-yyyy"))))
    return F.datediff(first.cast("date"), F.lit(FIRST_DAY).cast("date"))


def _date(m: Column, key: str) -> Column:
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), permuted_number(_day(m), DAYS, "date", key).cast("int"))
    mark = F.regexp_extract(m, r"\D", 0)
    d = F.regexp_replace(m, "[./]", "-")
    us = F.try_to_timestamp(d, F.lit("dd-MM-yyyy")).isNull()
    form = F.when(m.rlike(r"^\d{4}"), F.date_format(day, "yyyy-MM-dd")).when(us, F.date_format(day, "MM-dd-yyyy")).otherwise(F.date_format(day, "dd-MM-yyyy"))
    return F.replace(form, F.lit("-"), mark)


def _octets(m: Column) -> Column:
    return F.transform(F.split(m, r"\."), lambda x: x.cast("long"))


def _address(m: Column, key: str) -> Column:
    number = F.aggregate(_octets(m), F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    made = permuted_number(number, (65536, 65536), "address", key)
    return F.array_join(F.transform(F.array(*[F.lit(s) for s in (24, 16, 8, 0)]), lambda s: F.pmod(F.floor(made / F.pow(F.lit(2.0), s)).cast("long"), F.lit(256)).cast("string")), ".")


def _phone(m: Column, key: str) -> Column:
    code = F.length(F.regexp_extract(m, r"^\+(\d{1,3})(?!\d)", 1))
    digits = digits_of(m)
    return _refilled(m, permuted_text(F.substr(digits, code + 1), "phone", key), code)


def kind_of(m: Column) -> Column:
    """email, date, address, phone, social, run (of numbers, which may hold cards), or null for what fails validation."""
    day = _day(m)
    social = m.rlike(f"^(?:{SOCIAL})$") & ~m.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(f"^(?:{ADDRESS})$"), F.when(F.forall(_octets(m), lambda x: x <= 255), "address"))
        .when(m.rlike(f"^(?:{DATE})$"), F.when((day >= 0) & (day < DAYS[0] * DAYS[1]), "date"))
        .when(social, "social")
        .when(m.rlike(f"^(?:{PHONE})$"), "phone")
        .when(m.rlike(r"^\d[\d -]*$"), "run")
    )


def _pseudonym(found: Column, key: str) -> Column:
    m, kind = found["m"], found["kind"]
    local = F.substring_index(m, "@", 1)
    return (
        F.when(kind == "email", F.concat(permuted_text(local, "email", key), F.substr(m, F.length(local) + 1)))
        .when(kind == "date", _date(m, key))
        .when(kind == "address", _address(m, key))
        .when(kind == "phone", _phone(m, key))
        .when(kind == "social", _refilled(m, permuted_text(digits_of(m), "social", key)))
        .when(F.size(found["cards"]) > 0, _run(found["pieces"], found["cards"], key))
        .otherwise(m)
    )


def pseudonymise(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """All columns of ``docs`` as ``doc``, n_found (candidates), n_replaced (valid ones) and cleaned.

    A run of numbers is one candidate, or as many as it holds cards. A null text stays null with counts 0; empty texts and texts without a
    candidate are unchanged. Equal rows give equal rows. Other columns are
    passed through whatever their names.
    """
    body = F.col(f"doc.{text}")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = rows.withColumn("found", F.regexp_extract_all(body, F.lit(ANY), F.lit(0)))
    rows = rows.withColumn("found", F.transform("found", lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind"))))
    rows = rows.withColumn("found", F.transform("found", lambda x: F.struct(x["m"], x["kind"], F.when(x["kind"] == "run", _pieces(x["m"])).alias("pieces"))))
    rows = rows.withColumn("found", F.transform("found", lambda x: F.struct(x["m"], x["kind"], x["pieces"], F.when(x["kind"] == "run", cards_of(x["pieces"])).alias("cards"))))
    rows = rows.withColumn("made", F.transform("found", lambda x: _pseudonym(x, key)))
    parts = F.split(body, ANY, -1)
    joined = F.array_join(F.flatten(F.zip_with(parts, F.concat("made", F.array(F.lit(""))), lambda p, m: F.array(p, m))), "")
    valid = lambda x: F.when(x["kind"] == "run", F.size(x["cards"])).otherwise(x["kind"].isNotNull().cast("int"))
    total = lambda count: F.coalesce(F.aggregate("found", F.lit(0).cast("long"), lambda n, x: n + count(x)), F.lit(0).cast("long"))
    rows = rows.withColumn("n_replaced", total(valid))
    return rows.select("doc", total(lambda x: F.greatest(F.lit(1), valid(x))).alias("n_found"), "n_replaced", F.when(F.col("n_replaced") > 0, joined).otherwise(body).alias("cleaned"))
