"""Surrogates for personal data, with DataFrame functions only.

A detected entity is replaced by one of its own type and format that depends on a key alone. The
replacement is a keyed permutation p of the texts of that format: the characters are cut into two
halves, and in each round those of one are moved on inside their own alphabets by digits drawn from
the key and the other half. What is put in place of x is p^-1(p(x) moved on by one): a permutation
again, and without fixed points. So different entities get different surrogates and none stays as it
is; the same entity gets the same one in every document, without a table to look up. A surrogate that
would be read as another type of entity is replaced by its own surrogate, which keeps the map a
permutation of its type. Numbers are permuted as digits and emails as lower case, so that the spellings of one
entity keep one identity; the spelling is laid on again. Letters stay in their script and case and vowels of names vowels; a given
name of the stock becomes another one of its gender and script, and the last letter of a surname
stays, as titles do, so that gender shows as before.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

Alphabet = str | range


def _letters(first: int, last: int, *kinds: str) -> str:
    """The letters of these Unicode categories among code points."""
    return "".join(chr(c) for c in range(first, last + 1) if unicodedata.category(chr(c)) in kinds)


def _apart(*alphabets: Alphabet) -> tuple[Alphabet, ...]:
    """Alphabets without what an earlier one has, so that every character has one alphabet."""
    used: set[str] = set()
    out = []
    for alphabet in alphabets:
        own = alphabet if isinstance(alphabet, range) else "".join(c for c in alphabet if c not in used)
        used.update(own if isinstance(own, str) else ())
        if len(own) > 1:
            out.append(own)
    return tuple(out)


DIGITS = "0123456789"
#: First and last code points of letters in two cases: Latin, Greek, Cyrillic, Armenian.
_CASED = ((0xC0, 0xFF), (0x100, 0x17F), (0x180, 0x24F), (0x391, 0x3A9), (0x3B1, 0x3C9), (0x370, 0x3FF), (0x410, 0x44F), (0x400, 0x45F), (0x460, 0x52F), (0x531, 0x587))
#: The same of letters without case: Hebrew, Arabic, Devanagari, Thai, Georgian, Hiragana, Katakana.
_UNCASED = ((0x5D0, 0x5EA), (0x620, 0x64A), (0x904, 0x939), (0xE01, 0xE2E), (0x10D0, 0x10FF), (0x3041, 0x3096), (0x30A1, 0x30FA))
#: Han characters and Hangul syllables, all letters.
_LARGE = (range(0x4E00, 0xA000), range(0xAC00, 0xD7A4))
_SCRIPTS = (*(_letters(*ends, kind) for ends in _CASED for kind in ("Ll", "Lu")), *(_letters(*ends, "Lo", "Ll") for ends in _UNCASED), *_LARGE)
HEX = ("0123456789abcdef",)
_VOWELS = ("aeiou", "àáâäèéêëìíîïòóôöùúûü", "аеиоуыэюя", "αεηιουω")
_CONSONANTS = ("bcdfghjklmnpqrstvwxyz", "çñ", "бвгджзйклмнпрстфхцчшщ", "βγδζθκλμνξπρστφχψ")
PLAIN = _apart(DIGITS, *(x for pair in zip(_VOWELS, _CONSONANTS) for low in pair for x in (low, low.upper())), *_SCRIPTS)

#: Given names, men's and women's, by script: fixed values.
GIVEN = {
    "latin men": "Adam Alexander Andreas Andrew Antonio Bernd Carlos Charles Christian Daniel David Diego Edward Eric Fernando François Frank Fritz George Hans Heinrich Henry Jacques James Javier Jean Johann John José Juan Julien Jürgen Karl Klaus Laurent Louis Luis Manuel Marc Michael Miguel Nicolas Olivier Pablo Patrick Paul Pedro Peter Philippe Pierre Ralf Richard Robert Stefan Stephen Thomas Uwe Walter William Wolfgang",
    "latin women": "Alice Ana Angela Anna Beatriz Brigitte Camille Carmen Caroline Catherine Charlotte Christine Claire Claudia Cristina Dolores Elena Elizabeth Emily Emma Eva Francesca Gisela Hannah Heike Helen Ingrid Isabel Jane Jennifer Jessica Julia Karin Katharina Laura Linda Lucía Margaret Maria María Marie Martina Mary Monika Nathalie Nicole Olivia Patricia Petra Pilar Rachel Renate Sabine Sandra Sarah Sophie Susan Ursula Valérie Véronique",
    "cyrillic men": "Александр Алексей Андрей Борис Владимир Дмитрий Иван Михаил Николай Павел Сергей Юрий",
    "cyrillic women": "Анна Валентина Екатерина Елена Ирина Людмила Мария Наталья Ольга Светлана Татьяна Юлия",
    "greek men": "Αλέξανδρος Γιώργος Δημήτρης Κώστας Νίκος Παύλος",
    "greek women": "Άννα Ελένη Ιωάννα Κατερίνα Μαρία Σοφία",
}
#: Titles that a person's name follows.
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Herrn|Frau|Monsieur|Madame|Mme|Mlle|Señor|Señora|Señorita|Sra|г-н|г-жа|Κύριος|Κυρία"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"


def _any_of(names: list[str]) -> str:
    """A pattern for these names, by their first letters."""
    starts = dict.fromkeys(n[0] for n in names)
    return "|".join(f"{c}(?:{'|'.join(n[1:] for n in names if n[0] == c)})" for c in starts)


_STOCK = _any_of([name for names in GIVEN.values() for name in names.split()])
_TITLED = _any_of(TITLES.split("|"))
_CAPITAL = r"\p{Lu}\p{L}+"
_KEYWORD = r"(?i:token|secret|password|passwd|api[_-]?key)"
#: What is detected, in the order in which alternatives are tried; cheap guards come before slow ones.
ENTITIES = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "ip": rf"(?=\d)(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "secret": rf"""(?<=[=:"'\s])(?=[A-Za-z0-9+/_-]{{8}})(?<=[=:]["'\s]{{0,5}})(?<={_KEYWORD}["']?\s{{0,3}}[=:]\s{{0,3}}["']?)[A-Za-z0-9+/_-]{{8,}}"""
    r"|(?=[0-9a-fA-F])(?<![\p{L}\p{N}])(?=[a-fA-F]{0,31}\d)[0-9a-fA-F]{32,}(?![\p{L}\p{N}])",
    "ipv6": r"(?=[0-9a-fA-F]{1,4}:)(?<![\p{L}\p{N}:.])(?=[a-fA-F:]{0,38}\d)(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "iban": r"(?=[A-Z]{2}\d{2})(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "phone": r"\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)"
    r"|(?=\()(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?=\d)(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])"
    r"|(?=0)(?<![\d.,/-])0\d{2,4}[ /-]\d{5,8}(?![/-]|[.,]?\d)|(?=0)(?<![\d.,/-])0\d(?:[ .-]\d{2}){4}(?![/-]|[.,]?\d)",
    "card": r"(?=\d{4})(?<![\d.-])(?:\d{13,19}|\d{4} \d{4} \d{4} \d{1,7}|\d{4}-\d{4}-\d{4}-\d{1,7}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?![\d-])",
    "ssn": r"(?=\d{3}-)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "name": rf"(?=\p{{Lu}})(?<=\s)(?<=(?<!\p{{L}})(?:{_TITLED})\.?\s{{1,2}}){_CAPITAL}(?:[ -]{_CAPITAL}){{0,2}}|(?=\p{{Lu}})(?<!\p{{L}})(?:{_STOCK})(?:[ -]{_CAPITAL}){{1,2}}",
}
PATTERN = "|".join(f"(?:{p})" for p in ENTITIES.values())
#: Texts without any of this hold no entity; plain scans spare most texts the search.
HINT, HINT_OF_NAMES, HINT_OF_SECRETS = "[@0-9]", rf"(?=[\p{{Lu}}г])(?<!\p{{L}})(?:(?:{_TITLED})[.\s]|(?:{_STOCK})[ -]\p{{Lu}})", _KEYWORD
#: What a name, a card number, a secret of hexadecimal digits and a national phone number look like.
A_NAME, A_CARD, A_HEX, A_ZERO = r"^\p{Lu}[\p{L} -]+$", r"^\d[\d -]{11,}\d$", "^(?:[0-9a-f]{8,}|[0-9A-F]{8,})$", r"^0\d+[ /.-]"
A_PHONE = f"^(?:{ENTITIES['phone']})$"
#: Spelled forms: an IBAN, an IPv6 address, a number with country code, and a ten-digit number of three groups.
AN_IBAN, AN_IPV6, A_PLUS, A_TEN = r"^[A-Z]{2}\d{2}[A-Z0-9 ]{8,}$", "^(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{1,4}$", r"^\+", r"^\(?\d{3}\)?[ .-]*\d{3}[ .-]\d{4}$"
#: The country codes of telephone numbers; all that aren't named have three digits.
COUNTRY_CODE = r"^(?:1|7|2[07]|3[0-46-9]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
ROUNDS, WALKS = 4, 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _moved(text: Column, by: Callable[[Column], Column], alphabets: tuple[Alphabet, ...]) -> Column:
    """Every character of text moved on inside its alphabet by as much as by(place) says; others stay."""

    def inside(alphabet: Alphabet, c: Column, step: Column) -> tuple[Column, Column]:
        if isinstance(alphabet, range):
            code = F.pmod(F.ascii(c) - alphabet.start + step, F.lit(len(alphabet))) + alphabet.start
            return F.ascii(c).between(alphabet.start, alphabet.stop - 1), F.decode(F.unhex(F.hex(code.cast("long"))), "UTF-16BE")
        at = F.instr(F.lit(alphabet), c)
        return at > 0, F.substring(F.lit(alphabet), F.pmod(at - 1 + step, F.lit(len(alphabet))) + 1, F.lit(1))

    def move(c: Column, i: Column) -> Column:
        step = by(i)

        def first(some: list[Alphabet]) -> Column:
            out = c
            for alphabet in reversed(some):
                found, moved = inside(alphabet, c, step)
                out = F.when(found, moved).otherwise(out)
            return out

        ascii_only = [a for a in alphabets if isinstance(a, str) and a.isascii()]
        return F.when(c == "", c).when(F.ascii(c) < 128, first(ascii_only)).otherwise(first([a for a in alphabets if a not in ascii_only]))

    return F.array_join(F.transform(F.split(text, ""), move), "")


def permuted(text: Column, alphabets: tuple[Alphabet, ...], key: str, kind: Column) -> Column:
    """The keyed permutation without fixed points of text among the texts of its length with the same alphabet at each place."""
    half = F.floor(F.length(text) / 2).cast("int")
    halves = lambda t: F.struct(F.substring(t, F.lit(1), half).alias("l"), F.substring(t, half + 1, F.length(t)).alias("r"))

    def digits(i: Column, half_text: Column) -> Column:
        return F.sha2(F.concat_ws(":", F.lit(key), kind, i.cast("string"), half_text), 256)

    def by(d: Column, sign: int) -> Callable[[Column], Column]:
        return lambda at: sign * (F.conv(F.substring(d, at * 2 % 62 + 1, F.lit(2)), 16, 10).cast("int") + at)

    def turn(s: Column, i: Column) -> Column:
        return _let(digits(i, s["r"]), lambda d: F.struct(s["r"].alias("l"), _moved(s["l"], by(d, 1), alphabets).alias("r")))

    def back(s: Column, i: Column) -> Column:
        return _let(digits(i, s["l"]), lambda d: F.struct(_moved(s["r"], by(d, -1), alphabets).alias("l"), s["l"].alias("r")))

    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))  # after an even number of rounds the halves are in place again
    whole = lambda s: F.concat(s["l"], s["r"])
    there = F.aggregate(rounds, halves(text), turn, lambda s: _moved(whole(s), lambda at: F.lit(1), alphabets))
    return _let(there, lambda t: F.aggregate(F.reverse(rounds), halves(t), back, whole))


def _luhn(digits: Column) -> Column:
    """The check digit that belongs after these digits."""
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: _let(F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0)) * F.when(i % 2 == 0, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x)),
    )
    return (F.lit(10) - F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10) % 10


def _signs(e: Column, other: str) -> Column:
    """What tells an entity from others, however it is spelled: e without the characters that match other."""
    return F.regexp_replace(e, other, "")


def _respelled(e: Column, new: Column, sign: str) -> Column:
    """e with new's characters in the places of its signs."""
    place = lambda i: F.length(_signs(F.substring(e, F.lit(1), i + 1), f"[^{sign}]"))
    return F.array_join(F.transform(F.split(e, ""), lambda c, i: F.when(c.rlike(f"[{sign}]"), F.substring(new, place(i), F.lit(1))).otherwise(c)), "")


def _card(e: Column, key: str) -> Column:
    """The issuer's first digit stays, and so does the check digit's distance from the right one. Groups don't count."""

    def new(digits: Column) -> Column:
        body, last = F.substring(digits, F.lit(1), F.length(digits) - 1), F.substring(digits, F.length(digits), F.lit(1)).cast("int")
        moved = F.concat(F.substring(digits, 1, 1), permuted(F.substring(body, F.lit(2), F.length(digits)), (DIGITS,), key, F.lit("card")))
        return _let(moved, lambda n: F.concat(n, ((last - _luhn(body) + _luhn(n) + 10) % 10).cast("string")))

    return _respelled(e, _let(_signs(e, "[^0-9]"), new), "0-9")


def _iban_check(country: Column, account: Column) -> Column:
    """The check digits, as a number, that belong to an account."""
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    add = lambda r, c: (r * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97
    return 98 - F.aggregate(F.filter(F.split(F.concat(account, country, F.lit("00")), ""), lambda c: c != ""), F.lit(0), add)


def is_iban(e: Column) -> Column:
    """Whether a text has the form of an IBAN and right check digits."""
    plain = lambda x: F.substring(x, 3, 2).cast("int") == _iban_check(F.substring(x, 1, 2), F.substring(x, 5, 40))
    return F.when(e.rlike(AN_IBAN), _let(_signs(e, " "), plain)).otherwise(False)


def _iban(e: Column, key: str) -> Column:
    """The country stays, and so does the distance of the check digits from the right ones. Blanks don't count."""

    def new(x: Column) -> Column:
        country, check, account = F.substring(x, 1, 2), F.substring(x, 3, 2).cast("int"), F.substring(x, 5, 40)
        moved = permuted(account, (DIGITS, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), key, F.lit("iban"))
        return _let(moved, lambda m: F.concat(country, F.lpad(((check - _iban_check(country, account) + _iban_check(country, m) + 100) % 100).cast("string"), 2, "0"), m))

    return _respelled(e, _let(_signs(e, " "), new), "A-Z0-9")


def _phone(e: Column, key: str) -> Column:
    """The country code stays; a number of ten digits is that of +1 in another spelling. Signs between digits don't count."""

    def new(digits: Column) -> Column:
        head = F.when(e.rlike(A_PLUS), F.regexp_extract(digits, COUNTRY_CODE, 0)).otherwise("")
        return _let(head, lambda h: F.concat(h, permuted(F.substring(digits, F.length(h) + 1, F.length(digits)), (DIGITS,), key, F.lit("phone"))))

    return _respelled(e, _let(_signs(e, "[^0-9]"), new), "0-9")


def _in_case_of(e: Column, new: Column) -> Column:
    """new, of e's length, with capitals where e has them."""
    high = lambda c, o: F.when((o != F.lower(o)) & (F.length(F.upper(c)) == 1), F.upper(c)).otherwise(c)
    return F.array_join(F.zip_with(F.split(new, ""), F.split(e, ""), high), "")


def _ipv6(e: Column, key: str) -> Column:
    """The hexadecimal digits are permuted; groups, and capitals where there are any, stay."""
    new = _let(F.lower(_signs(e, ":")), lambda x: permuted(x, HEX, key, F.lit("ipv6")))
    return _respelled(e, F.when(e.rlike("[A-F]"), F.upper(new)).otherwise(new), "0-9a-fA-F")


def _email(e: Column, key: str) -> Column:
    """All but the top-level domain is permuted in lower case; capitals stay where they are."""

    def new(low: Column) -> Column:
        head = F.regexp_extract(low, r"^.*(?=\.[^.]*$)", 0)
        moved = _let(head, lambda h: F.concat(permuted(h, PLAIN, key, F.lit("email")), F.substring(low, F.length(h) + 1, F.length(low))))
        return F.when(e == low, moved).otherwise(_in_case_of(e, moved))

    return _let(F.when(F.length(F.lower(e)) == F.length(e), F.lower(e)).otherwise(e), new)


def _ip(e: Column, key: str) -> Column:
    """The address as two numbers of 16 bits, added up in turns."""
    o = F.transform(F.split(e, r"\."), lambda x: x.cast("long"))
    start = F.struct((o[0] * 256 + o[1]).alias("l"), (o[2] * 256 + o[3]).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        drawn = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit("ip"), i.cast("string"), s["r"].cast("string")), 256), 1, 8), 16, 10).cast("long")
        return F.struct(s["r"].alias("l"), ((s["l"] + drawn) % 65536).alias("r"))

    def dotted(s: Column) -> Column:
        parts = [F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256]
        return F.concat_ws(".", *(p.cast("long").cast("string") for p in parts))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, dotted)


def _next_given(key: str) -> Column:
    """A map from every given name of the stock to the next of its gender and script in a keyed order."""
    pairs = []
    for names in GIVEN.values():
        order = sorted(names.split(), key=lambda n: hashlib.sha256(f"{key}:{n}".encode()).hexdigest())
        pairs += [F.lit(x) for pair in zip(order, order[1:] + order[:1]) for x in pair]
    return F.create_map(*pairs)


def _parts(e: Column, given: Column) -> Column:
    """An entity as parts of which head and tail stay and body is permuted, with the kind of the permutation."""

    def part(head: Column, body: Column, tail: Column, kind: str) -> Column:
        return F.struct(head.alias("head"), body.alias("body"), tail.alias("tail"), F.lit(kind).alias("kind"))

    none, size = F.lit(""), F.length(e)

    def after(start: str, kind: str) -> Column:
        head = F.regexp_extract(e, start, 0)
        return F.array(part(head, F.substring(e, F.length(head) + 1, size), none, kind))

    def word(w: Column) -> Column:  # a word of a name with the blank or hyphen after it
        only = F.regexp_extract(w, r"^\p{L}*", 0)
        stays = F.length(w) - F.length(only) + F.when(F.length(only) < 4, 0).otherwise(1)
        next_one = F.try_element_at(given, only)
        own = part(none, F.substring(w, F.lit(1), F.length(w) - stays), F.substring(w, F.length(w) - stays + 1, stays), "name")
        return F.when(next_one.isNotNull(), part(next_one, none, F.substring(w, F.length(only) + 1, F.length(w)), "name")).otherwise(own)

    return (
        F.when(e.rlike(A_ZERO), after("^0", "national"))
        .when(e.rlike(A_NAME), F.transform(F.split(e, "(?<=[ -])"), word))
        .otherwise(F.array(part(none, e, none, "other")))
    )


def surrogate(entity: Column, key: str) -> Column:
    """The replacement of a detected entity; its type shows in its form.

    A number in the form of a card without a right check digit is no entity and stays. A text
    without any letter or digit that has an alphabet gets digits of its keyed hash.
    """
    given = _next_given(key)

    def inside(p: Column, body: Column) -> Column:
        """Whether a permuted body still reads as its kind."""
        word = F.concat(body, F.regexp_extract(p["tail"], r"^\p{L}*", 0))
        return F.when(p["kind"] == "name", F.try_element_at(given, word).isNull() & ~word.rlike(A_HEX)).when(p["kind"] == "other", ~body.rlike(A_HEX) & ~body.rlike(A_ZERO)).otherwise(True)

    def moved(p: Column) -> Column:
        step = lambda s: _let(permuted(s["body"], PLAIN, key, p["kind"]), lambda b: F.struct(b.alias("body"), inside(p, b).alias("done")))
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), F.struct(p["body"].alias("body"), F.lit(False).alias("done")), lambda s, _: F.when(s["done"], s).otherwise(step(s)), lambda s: s["body"])
        return F.when(p["body"] == "", F.concat(p["head"], p["tail"])).otherwise(F.concat(p["head"], walked, p["tail"]))

    hexed = lambda e: permuted(F.lower(e), HEX, key, F.lit("hex"))
    found = _let(
        entity,
        lambda e: F.when(F.instr(e, "@") > 0, _email(e, key))
        .when(e.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), _ip(e, key))
        .when(e.rlike(A_PLUS) | e.rlike(A_TEN), _phone(e, key))
        .when(e.rlike(A_CARD) & ~e.rlike(A_PHONE), _card(e, key))
        .when(e.rlike(AN_IPV6), _ipv6(e, key))
        .when(e.rlike(AN_IBAN) & (is_iban(e) | ~e.rlike(A_HEX)), _iban(e, key))
        .when(e.rlike(A_HEX), _let(hexed(e), lambda h: F.when(e == F.lower(e), h).otherwise(F.upper(h))))
        .otherwise(F.array_join(F.transform(_parts(e, given), moved), "")),
    )
    hashed = F.concat(F.lit("x"), F.substring(F.sha2(F.concat(F.lit(key + ":"), entity), 256), 1, 16))
    return _let(found, lambda n: F.when(~is_entity(entity), entity).when(n == entity, hashed).otherwise(n))


def is_entity(found: Column) -> Column:
    """False for a number in the form of a card whose check digit is wrong."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    size = F.length(digits)
    right = _luhn(F.substring(digits, F.lit(1), size - 1)) == F.substring(digits, size, F.lit(1)).cast("int")
    return ~found.rlike(A_CARD) | found.rlike(A_PHONE) | right


def found_entities(text: Column) -> Column:
    """All entities of a text in its order, repeats included."""
    secret = (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(HINT_OF_SECRETS)
    any_hint = text.rlike(HINT) | text.rlike(HINT_OF_NAMES) | secret
    return F.when(any_hint, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def search_pattern(found: Column) -> Column:
    """PATTERN, and every later mention of a word of a found name."""
    words = F.array_distinct(F.flatten(F.transform(F.filter(found, lambda e: e.rlike(A_NAME)), lambda e: F.split(e, "[ -]"))))
    words = F.filter(words, lambda w: w.rlike(r"^\p{Lu}\p{L}{2,}$"))
    return F.when(F.size(words) > 0, F.concat(F.lit(PATTERN + r"|(?<!\p{L})(?:"), F.array_join(words, "|"), F.lit(r")(?!\p{L})"))).otherwise(F.lit(PATTERN))


def _searched(docs: DataFrame, text: Column) -> DataFrame:
    """docs with __pattern, what is searched for in each text, and __found, its entities in order."""
    found = docs.withColumn("__first", found_entities(F.coalesce(text, F.lit("")))).withColumn("__pattern", search_pattern(F.col("__first")))
    again = F.when(F.col("__pattern") == F.lit(PATTERN), F.col("__first")).otherwise(F.regexp_extract_all(text, F.col("__pattern"), F.lit(0)))
    return found.withColumn("__found", again).drop("__first")


def replace_entities(docs: DataFrame, text_col: str = "text", key: str = "surrogates") -> DataFrame:
    """docs with surrogates in text_col, and the columns entities and collisions (long).

    Names are found after titles and from given names of the stock, and every further mention of
    their words in the same document. entities counts the replacements, collisions how many of a
    document's distinct entities share a surrogate with another; see surrogate_collisions() for all
    documents. Null texts stay null and have 0 entities; whole texts are searched. Repeated rows
    stay alike; an empty table gives no rows. Columns of docs named entities or collisions are
    replaced. No row moves: there is neither a shuffle nor a table of entities.
    """
    text = F.col(text_col)
    named = _searched(docs, text).withColumn("__new", F.transform("__found", lambda e: surrogate(e, key)))
    pieces = F.zip_with(F.split(text, F.col("__pattern"), F.lit(-1)), F.col("__new"), lambda p, r: F.concat(p, F.coalesce(r, F.lit(""))))
    changed = F.zip_with("__found", "__new", lambda e, n: (e != n).cast("int"))
    out = {
        text_col: F.when(F.size("__found") > 0, F.array_join(pieces, "")).otherwise(text),
        "entities": F.aggregate(changed, F.lit(0), lambda a, x: a + x).cast("long"),
        "collisions": (F.size(F.array_distinct("__found")) - F.size(F.array_distinct("__new"))).cast("long"),
    }
    kept = [out.pop(c, F.col(c)).alias(c) for c in docs.columns]
    return named.select(*kept, *(c.alias(n) for n, c in out.items()))


def surrogate_collisions(docs: DataFrame, text_col: str = "text", key: str = "surrogates") -> DataFrame:
    """surrogate and entities for surrogates that stand for more than one entity anywhere, or for an
    entity that is its own surrogate: no rows, if all entities stay distinct. Entities are made
    distinct before they are compared, so a frequent one costs one row a task."""
    found = _searched(docs, F.col(text_col)).select(F.explode("__found").alias("entity")).distinct().where(is_entity(F.col("entity")))
    return collisions_of(found, key)


def collisions_of(entities: DataFrame, key: str = "surrogates") -> DataFrame:
    """surrogate and entities, as in surrogate_collisions(), of a table of distinct entities."""
    named = entities.select("entity", surrogate(F.col("entity"), key).alias("surrogate"))
    counted = named.groupBy("surrogate").agg(F.count("*").alias("entities"), F.count_if(F.col("entity") == F.col("surrogate")).alias("same"))
    return counted.where("entities > 1 OR same > 0").select("surrogate", "entities")
