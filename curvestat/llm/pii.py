"""Personal data: exact base patterns, and boosted trees over candidate spans.

Base spans (email, ip, card, phone) are the leftmost non-overlapping matches of
fixed patterns; matches that fail their check are dropped without another try.

The method adds spans. High-recall generators propose overlapping candidates:
runs of digits and separators, addresses written with or without signs, account numbers,
long tokens, and short values assigned to a password. Boosted trees score each candidate from its format
(length, shares and counts of characters, dates and versions) and its context
(cue words before it, characters beside it); per generator a threshold is
calibrated for ``PRECISION`` on forms that the trees weren't fitted on. Candidates above it
are added as kinds ``contact`` and ``secret``. Generators see the text with its base spans
blanked out, and those behind it with its addresses and valid account numbers blanked out too. Digests and identifiers (commit ids, MD5 and SHA sums,
UUIDs, paths of URLs, names of classes) are candidates that the trees learn to pass by.

Trees are fitted here, on a generated set of labelled snippets described in
``snippets``, by the same feature expressions; no document is used for the fit.

Everything runs as array expressions inside one narrow projection: texts are
neither exploded nor shuffled. Offsets count code points, end exclusive. Matching
goes through a text a fixed number of times: no pattern is tried twice over one
run of its characters, a candidate's context comes from the text between it and
the candidate before. Offsets are running sums in three levels of blocks.

Defined results: a null text counts as empty; repeated rows are reported each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import random
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curvestat.llm.common import let

#: Base patterns. Possessive repeats match the same and don't recurse. A match may begin inside a run of
#: its characters only where the match before it ended (\G), so no run is scanned again from each of its characters.
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
BASE = ("email", "ip", "card", "phone")

#: What stands before the value of a password.
_ASSIGNED = r"(?i:passw(?:or)?d|passwort|passphrase|passcode|pwd|secret|token|api[_-]?key)[\"']?\x20{0,2}[:=]>?\x20{0,2}[\"']?"
#: How keys of well-known services begin.
VENDORS = r"^(?:AKIA|ASIA|AIza|gh[opsur]_|github_pat_|glpat-|xox[abprs]-|sk-|[srp]k_live_|npm_|eyJ|SG\.|ya29)"

#: Generators of candidates: name, kind, pattern, and a cheap test of the text.
GENERATORS = (
    ("address", "contact", rf"(?<![{_LOCAL}])[A-Za-z0-9][{_LOCAL}]*+\x20?(?:@|[\[(]at[\])])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]++)++", r"@|[\[(]at[\])]"),
    ("account", "contact", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
    ("digits", "contact", r"(?<![0-9A-Za-z])[(+]?[0-9](?:[\x20()./-]{0,2}+[0-9]){6,}+", r"[0-9]{2}"),
    ("token", "secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}", r"[A-Za-z0-9+/_-]{16}"),
    ("value", "secret", rf"(?<=[:=\x20\"'])(?<={_ASSIGNED})[^\x20\t-\r\"'<>,;]{{6,15}}+(?![^\x20\t-\r\"'<>,;])", r"(?i)pass|pwd|secret|token|key"),
)
CONTEXT = 32
ROUNDS = 40
RATE = 0.4
PRECISION = 0.97
#: Elements in a block of a running sum, and levels of blocks of blocks above them.
BLOCK, LEVELS = 48, 2
BLANK = "\u0000"


def running(lengths: Column, levels: int = LEVELS) -> Column:
    """Sum of the elements before each element of an array of int: of the blocks before, then inside its block."""
    add = lambda acc, x: acc + x
    zero = F.lit(0)

    def over(v: Column) -> Column:
        block = lambda i: F.floor(i / BLOCK).cast("int")
        sums = F.transform(F.sequence(F.lit(0), block(F.size(v))), lambda b: F.aggregate(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)), zero, add))
        return let(running(sums, levels - 1), lambda st: F.transform(v, lambda x, i: F.aggregate(F.slice(v, i - i % BLOCK + 1, i % BLOCK), F.get(st, block(i)), add)))

    if levels == 0:
        return let(lengths, lambda v: F.transform(v, lambda x, i: F.aggregate(F.slice(v, F.lit(1), i), zero, add)))
    return let(lengths, over)


def hits(text: Column, pattern: str, quick: Column) -> Column:
    """Leftmost non-overlapping matches, and the texts before, between and behind them; null where quick is false."""
    return F.when(quick, F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("hits")))


def placed(found: Column) -> Column:
    """Array of (s, e, m, before, after) of the hits: code-point offsets, string, up to CONTEXT characters
    before it, no further back than the hit before, and one character behind it."""

    def place(f: Column) -> Column:
        gap = lambda i: F.get(f["gaps"], i)
        hit = lambda i: F.coalesce(F.get(f["hits"], i), F.lit(""))

        def one(m: Column, i: Column, at: Column) -> Column:
            s = F.get(at, i) + F.length(gap(i))
            before = F.when(F.length(gap(i)) >= CONTEXT, F.right(gap(i), F.lit(CONTEXT))).otherwise(F.right(F.concat(hit(i - 1), gap(i)), F.lit(CONTEXT)))
            after = F.when(gap(i + 1) != "", F.left(gap(i + 1), F.lit(1))).otherwise(F.left(hit(i + 1), F.lit(1)))
            return F.struct(s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m"), before.alias("before"), after.alias("after"))

        starts = running(F.transform(f["hits"], lambda m, i: F.length(gap(i)) + F.length(m)))
        return let(starts, lambda at: F.transform(f["hits"], lambda m, i: one(m, i, at)))

    return F.coalesce(F.when(F.size(found["hits"]) > 0, place(found)), F.array().cast("array<struct<s:int,e:int,m:string,before:string,after:string>>"))


def blanked(text: Column, found: Column, ok) -> Column:
    """text with the hits that are ok blanked out, at its length."""
    piece = lambda m, i: F.concat(F.get(found["gaps"], i), F.when(ok(m), F.repeat(F.lit(BLANK), F.length(m))).otherwise(m))
    return F.when(F.size(found["hits"]) > 0, F.concat(F.array_join(F.transform(found["hits"], piece), ""), F.element_at(found["gaps"], -1))).otherwise(text)


def _luhn(digits: Column) -> Column:
    def one(d: Column, i: Column) -> Column:
        v = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), one), F.lit(0), lambda acc, x: acc + x) % 10 == 0


def _account(m: Column) -> Column:
    """Whether an account number of letters and digits passes its check digits (the remainder by 97, first four characters last)."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))

    def add(acc: Column, c: Column) -> Column:
        v = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (F.when(v < 10, acc * 10).otherwise(acc * 100) + v) % 97

    ok = m.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9\x20]{8,36}$")
    return F.when(ok, F.aggregate(F.split(turned, ""), F.lit(0), add) == 1).otherwise(F.lit(False))


#: Pattern, cheap test of a text, and check of a match, of each base kind.
RULES = {
    "email": (EMAIL, lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True)),
    "ip": (IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")),
    "card": (CARD, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), lambda m: let(F.regexp_replace(m, r"[\x20-]", ""), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(F.lit(False)))),
    "phone": (PHONE, lambda t: t.rlike(r"\+[0-9]"), lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)),
}


#: Generators whose matches, where this holds of them, are kept from the generators behind them.
APART = {"address": lambda m: m.rlike("[A-Za-z]{2,}$"), "account": _account}

FEATURES = (
    "length", "digits", "letters", "upper", "lower", "seps", "dots", "slashes", "groups", "vowels",
    "hex", "date", "version", "at_sign", "cue_phone", "cue_secret", "cue_other", "before_word", "after_word", "assigned",
    "digest", "uuid", "vendor", "mixes", "wordy", "code", "spaced", "checked", "cue_hash", "cue_person", "url", "after_blank",
)


_DIGITS, _UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()


def _features(x: Column) -> Column:
    """Struct of doubles for candidate x."""
    m, before, after = x["m"], F.lower(x["before"]), x["after"]
    count = lambda chars: F.length(m) - F.length(F.translate(m, chars, ""))
    values = {
        "length": F.length(m),
        "digits": count(_DIGITS),
        "letters": count(_UPPER + _LOWER),
        "upper": count(_UPPER),
        "lower": count(_LOWER),
        "seps": count(" ()+-"),
        "dots": count("."),
        "slashes": count("/_"),
        "groups": F.size(F.split(m, "[^0-9A-Za-z]+")),
        "vowels": count("aeiouAEIOU"),
        "hex": m.rlike("^[0-9a-fA-F]+$"),
        "date": m.rlike(r"^(?:(?:19|20)[0-9]{2}[-/.][01]?[0-9][-/.][0-3]?[0-9]|[0-3]?[0-9][-/.][01]?[0-9][-/.](?:19|20)?[0-9]{2})(?:$|[^0-9])"),
        "version": m.rlike(r"^[0-9]{1,4}(?:\.[0-9]{1,5})+$"),
        "at_sign": m.rlike(r"@|[\[(]at[\])]"),
        "digest": m.rlike("^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})$"),
        "uuid": m.rlike("^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"),
        "vendor": m.rlike(VENDORS),
        "mixes": F.size(F.split(m, "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")),
        "wordy": F.size(F.split(m, "[A-Z]?[a-z]{3,}")),
        "code": m.rlike(r"[(\[{$%]"),
        "spaced": count(" "),
        "checked": _account(m),
    }
    context = {
        "cue_phone": lambda b: b.rlike(r"(?:phone|fon|tel|call|mobile?|handy|cell|fax|whatsapp|contact|reach|sms)(?:[^a-z]{1,4}[a-z]{1,6}){0,2}[^a-z]{0,4}$"),
        "cue_secret": lambda b: b.rlike(r"(?:token|secret|passw|pwd|api.?key|key|auth|bearer|credential)[^\n]{0,12}$"),
        "cue_other": lambda b: b.rlike(r"(?:order|invoice|no\.|number|version|isbn|page|id|ref|commit|sha|total|price|item)[^a-z]{0,6}$"),
        "cue_hash": lambda b: b.rlike(r"(?:commit|sha-?[0-9]{0,3}|md5|checksum|hash|integrity|digest|etag|rev(?:ision)?|blob|tree|merge|uuid|guid|fingerprint)[^\n]{0,8}$"),
        "cue_person": lambda b: b.rlike(r"(?:ssn|social security|tax id|insurance|passport)[^0-9\n]{0,12}$"),
        "url": lambda b: b.rlike(r"(?:://|www\.|href=)[^\x20\"']{0,32}$|[A-Za-z0-9]\.$|[./]$"),
        "before_word": lambda b: b.rlike(r"[a-z0-9]$"),
        "assigned": lambda b: b.rlike(r"[:=][\x20\"']{0,2}$"),
    }
    plain = {k: v.cast("double") for k, v in values.items()} | {"after_word": after.rlike("[A-Za-z0-9]").cast("double"), "after_blank": after.rlike(r"\x20").cast("double")}

    def with_context(b: Column) -> Column:
        every = plain | {k: f(b).cast("double") for k, f in context.items()}
        return F.struct(*[F.coalesce(every[name], F.lit(0.0)).alias(name) for name in FEATURES])

    return let(before, with_context)


def snippets(seed: int = 9, each: int = 60) -> list[dict]:
    """Generated labelled texts: one candidate each, of generator g, with label y; those apart are of forms only for calibration.

    Positives: national phone numbers with and without cue words, addresses
    with spelt-out signs, hexadecimal tokens beside cue words, mixed tokens, keys of known services, assigned passwords, valid account numbers.
    Negatives: dates, versions, order and page numbers, sums, digit series,
    plain long words, identifiers of every case, paths, digests, UUIDs, prose and code
    behind the word password, account numbers with wrong check digits, addresses without a domain.
    """
    draw = random.Random(seed)
    d = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    w = lambda n: "".join(draw.choice("etaoinshrdlu") for _ in range(n))
    pick = draw.choice
    mixed = lambda n: "".join(pick("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n))
    hexa = lambda n: "".join(pick("0123456789abcdef") for _ in range(n))
    year = lambda: f"{pick(['19', '20'])}{d(2)}"
    day = lambda: f"{draw.randint(1, 28):02d}"
    month = lambda: f"{draw.randint(1, 12):02d}"
    cue = lambda: pick(["call ", "phone: ", "tel. ", "mobile ", "fax: ", "contact us at "])
    key = lambda: pick(['token = "', "secret: ", "api_key=", 'password: "', "auth key ", "Bearer "])
    vendor = lambda: pick(["AKIA" + "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), "ghp_" + mixed(36), "glpat-" + mixed(20), "xoxb-" + d(11) + "-" + mixed(24), "sk_live_" + mixed(24), "AIza" + mixed(35)])
    uuid = lambda: f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}"
    camel = lambda n: "".join(w(draw.randint(4, 9)).capitalize() for _ in range(n))
    assigned = lambda: pick(["password: ", 'password = "', "passwd=", "pwd: ", "secret='", 'api_key="', "PASSWORD="])

    person = lambda: pick(["SSN ", "ssn: ", "social security number ", "tax id: ", "insurance no. "])

    def account(right: bool, spaced: bool) -> str:
        country, rest = pick(["DE", "FR", "GB", "NL", "ES"]), d(pick([14, 16, 18, 20]))
        rest = pick([rest, rest, d(10) + pick(_UPPER) + d(5), "".join(pick(_UPPER) for _ in range(4)) + rest[4:]])
        number = int("".join(str(int(c, 36)) for c in rest + country) + "00")
        check = 98 - number % 97
        text = f"{country}{check if right else 1 + (check + draw.randint(3, 80)) % 96:02d}{rest}"
        return " ".join(text[i : i + 4] for i in range(0, len(text), 4)) if spaced else text

    forms = [
        ("digits", 1, lambda: f"{cue()}({d(3)}) {d(3)}-{d(4)}"),
        ("digits", 1, lambda: f"{cue()}{d(3)}-{d(3)}-{d(4)}"),
        ("digits", 1, lambda: f"{cue()}0{d(2)} {d(4)} {d(4)}"),
        ("digits", 1, lambda: f"{cue()}{d(3)}.{d(3)}.{d(4)}"),
        ("digits", 1, lambda: f"{w(5)} {w(3)} ({d(3)}) {d(3)}-{d(4)}"),
        ("digits", 0, lambda: f"{w(4)} {year()}-{month()}-{day()}"),
        ("digits", 0, lambda: f"{w(4)} {day()}/{month()}/{year()}"),
        ("digits", 0, lambda: f"version {d(1)}.{d(2)}.{d(4)}"),
        ("digits", 0, lambda: f"order {d(9)}"),
        ("digits", 0, lambda: f"{w(6)} {d(8)}"),
        ("digits", 0, lambda: f"{w(3)} {d(16)}"),
        ("digits", 0, lambda: f"pages {d(3)} {d(3)} {d(3)}"),
        ("digits", 0, lambda: " ".join([w(3), *[d(draw.randint(1, 3)) for _ in range(9)]])),
        ("digits", 0, lambda: f"{w(4)} {d(3)}.{d(3)}.{d(3)}.{d(3)}"),
        ("address", 1, lambda: f"{w(6)} (at) {w(7)} (dot) {pick(['com', 'org', 'net'])}"),
        ("address", 1, lambda: f"{w(4)}.{w(5)}[at]{w(8)}[dot]{pick(['com', 'org', 'de'])}"),
        ("address", 1, lambda: f"{w(6)} @ {w(7)} . {pick(['com', 'org', 'fr'])}"),
        ("address", 0, lambda: f"{w(3)} {d(1)} @ {d(1)}.{d(2)}"),
        ("address", 0, lambda: f"{w(3)} {d(2)}@{d(2)}.{d(2)}"),
        ("token", 1, lambda: f"{key()}{hexa(pick([32, 40, 64]))}"),
        ("token", 1, lambda: f"{key()}{mixed(pick([20, 24, 32, 40]))}"),
        ("token", 1, lambda: f"{w(4)} {mixed(pick([32, 40]))}"),
        ("token", 1, lambda: f"{key()}{w(draw.randint(17, 30))}"),
        ("token", 1, lambda: f"{pick(['', w(4) + ' ', key()])}{vendor()}"),
        ("token", 0, lambda: f"{w(4)} {hexa(pick([32, 40, 64]))}"),
        ("token", 0, lambda: f"{pick(['commit ', 'md5: ', 'sha256:', 'checksum = ', 'Merge ', 'hash: '])}{hexa(pick([32, 40, 64]))}"),
        ("token", 0, lambda: f"{pick(['', 'id ', 'uuid: ', 'key '])}{uuid()}"),
        ("token", 0, lambda: f"https://{w(6)}.{pick(['com', 'org'])}/{w(5)}/{camel(3)}/{w(6)}{d(3)}"),
        ("token", 0, lambda: f"{w(4)} {camel(draw.randint(3, 5))}{d(1)}"),
        ("token", 0, lambda: f"{w(3)} {camel(2)}_{w(5)}_{camel(2)}{d(2)}"),
        ("token", 0, lambda: f"{w(4)}-{d(1)}-{w(6)}-{d(2)}-{w(7)}"),
        ("value", 1, lambda: f"{assigned()}{w(draw.randint(5, 8))}{d(draw.randint(1, 4))}"),
        ("value", 1, lambda: f"{pick(['password=', 'pwd=', 'PASSWORD='])}{mixed(draw.randint(8, 14))}"),
        ("value", 1, lambda: f"{assigned()}{w(4)}{pick('!@#&*')}{mixed(4)}"),
        ("value", 1, lambda: f"{assigned()}{w(draw.randint(5, 9))}{d(draw.randint(1, 3))}{pick(['', chr(34), ', ' + w(3), chr(10)])}"),
        ("value", 1, lambda: f"{pick(['password=', 'passwd=', 'pwd='])}{w(draw.randint(8, 14))}"),
        ("value", 0, lambda: f"{pick(['password: ', 'token: ', 'secret: ', 'Password: '])}{w(draw.randint(6, 12))} {w(3)}"),
        ("value", 0, lambda: f"{pick(['password: ', 'token: '])}{w(draw.randint(6, 12))}."),
        ("value", 0, lambda: f"{assigned()}{w(4)}({w(3)})"),
        ("value", 0, lambda: f"{assigned()}${{{w(5)}}}"),
        ("value", 0, lambda: f"{assigned()}{w(3)}[{d(1)}]"),
        ("account", 1, lambda: account(True, draw.random() < 0.5)),
        ("account", 1, lambda: f"{pick(['IBAN: ', 'account '])}{account(True, draw.random() < 0.5)}"),
        ("account", 0, lambda: f"{w(4)} {account(False, draw.random() < 0.5)}"),
        ("digits", 1, lambda: f"{cue()}0{d(2)} {d(7)}"),
        ("digits", 1, lambda: f"{cue()}0{d(pick([2, 3]))}/{d(6)}"),
        ("digits", 1, lambda: f"{person()}{d(3)}-{d(2)}-{d(4)}"),
        ("digits", 1, lambda: f"{person()}{d(pick([8, 9, 10]))}"),
        ("digits", 1, lambda: f"{person()}{d(2)} {d(3)} {d(3)}"),
        ("token", 0, lambda: f"{w(4)} {w(draw.randint(17, 40))}"),
        ("token", 0, lambda: f"{w(4)} {w(draw.randint(17, 40)).upper()}"),
        ("token", 0, lambda: f"{w(4)} {w(draw.randint(17, 30)).capitalize()}"),
        ("token", 0, lambda: f"key {w(draw.randint(17, 30))}"),
        ("token", 0, lambda: f"{w(3)} {w(6)}-{w(7)}-{w(8)}"),
        ("token", 0, lambda: f"{w(3)} {w(6)}_{w(7)}_{w(4)}{d(1)}"),
        ("token", 0, lambda: f"/{w(5)}/{w(6)}/{w(8)}"),
        ("token", 0, lambda: "-" * draw.randint(17, 40)),
        ("token", 0, lambda: f"{w(3)} {d(16)}"),
    ]
    kept_out = [
        ("digits", 1, lambda: f"{pick(['mobil', 'handy:', 'reach me on', 'sms'])} 0{d(3)} {d(7)}"),
        ("digits", 1, lambda: f"{cue()}1-{d(3)}-{d(3)}-{d(4)}"),
        ("digits", 1, lambda: f"{w(2)} {w(7)}, ({d(3)}) {d(3)} {d(4)}"),
        ("digits", 0, lambda: f"isbn {d(3)}-{d(1)}-{d(5)}-{d(3)}-{d(1)}"),
        ("digits", 0, lambda: f"{year()}/{month()}/{day()} {d(2)}"),
        ("digits", 0, lambda: f"total {d(1)}.{d(3)}.{d(3)}"),
        ("digits", 0, lambda: f"ticket {d(10)}"),
        ("digits", 0, lambda: f"{w(5)} {d(4)}-{d(4)}-{d(4)}"),
        ("address", 1, lambda: f"{w(5)}(at){w(6)}(dot){pick(['com', 'org'])}"),
        ("address", 1, lambda: f"{w(5)}.{w(4)} [at] {w(7)}.{pick(['org', 'net'])}"),
        ("address", 0, lambda: f"{w(3)} {d(3)} @ {d(2)}.{d(1)}"),
        ("token", 1, lambda: f"{pick(['credential ', 'SECRET_KEY=', 'x-auth: ', 'pwd '])}{mixed(36)}"),
        ("token", 1, lambda: f"{w(3)} {mixed(28)}"),
        ("token", 1, lambda: f"{pick(['SECRET_KEY = ', 'auth_token: ', 'apikey '])}'{hexa(36)}'"),
        ("token", 1, lambda: f"{w(3)}, {pick(['npm_' + mixed(36), 'gho_' + mixed(36), 'ASIA' + mixed(16).upper(), 'eyJ' + mixed(40)])}"),
        ("token", 0, lambda: f"{pick(['tree ', 'etag: ', 'revision ', 'integrity ', 'SHA1 '])}{hexa(pick([40, 64]))}"),
        ("token", 0, lambda: f"{pick(['guid ', 'session '])}{uuid().upper()}"),
        ("token", 0, lambda: f"www.{w(7)}.org/{camel(2)}/{w(4)}-{d(2)}/{w(5)}"),
        ("token", 0, lambda: f"import {w(5)}.{camel(4)}{d(2)}"),
        ("value", 1, lambda: f"{pick(['passcode: ', 'Passwort: ', 'token=', 'apikey='])}{w(5)}{d(3)}"),
        ("value", 1, lambda: f"passphrase = '{mixed(12)}'"),
        ("value", 0, lambda: f"passcode: {w(7)} {w(4)}"),
        ("value", 0, lambda: f"passphrase = {w(3)}.{w(2)}()"),
        ("account", 1, lambda: f"{w(5)}, {account(True, True)}"),
        ("account", 0, lambda: f"part {account(False, False)}"),
        ("digits", 1, lambda: f"passport or ssn {d(3)} {d(2)} {d(4)}"),
        ("digits", 1, lambda: f"{pick(['fon 0', 'Handy 0'])}{d(3)} {d(3)} {d(4)}"),
        ("token", 0, lambda: f"{w(4)} {w(5)}-{w(4)}-{w(6)}-{w(3)}"),
        ("token", 0, lambda: f"{w(2)} {''.join(w(draw.randint(4, 7)).capitalize() for _ in range(4))}"),
        ("token", 0, lambda: f"{w(4)} {w(8)}/{w(5)}/{w(7)}/{w(3)}"),
        ("token", 0, lambda: "_" * draw.randint(17, 60)),
        ("token", 0, lambda: f"id {d(20)}"),
    ]
    every = [(*form, False) for form in forms] + [(*form, True) for form in kept_out]
    rows = [{"g": g, "apart": apart, "y": y, "text": f"{w(5)} {make()} {w(4)}"} for g, y, make, apart in every for _ in range(each)]
    draw.shuffle(rows)
    return rows


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> tuple[float, list[tuple]]:
    """Gradient boosting of logistic loss with trees of depth two: bias and trees.

    A tree is (feature, cut, left, right), left and right (feature, cut, value below, value above).
    """
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    margin, trees = np.full(len(y), bias), []

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
        best = (-np.inf, 0, -np.inf)
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, cg, ch = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
            gain = cg**2 / (ch + 1) + (cg[-1] - cg) ** 2 / (ch[-1] - ch + 1)
            gain[:-1][v[:-1] == v[1:]] = -np.inf
            gain[-1] = cg[-1] ** 2 / (ch[-1] + 1)
            i = int(gain.argmax())
            if gain[i] > best[0] + 1e-12:
                best = (gain[i], f, v[i] if i == len(v) - 1 else (v[i] + v[i + 1]) / 2)
        return best[1], float(best[2])

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        f, c = split(np.arange(len(y)), g, h)
        sides = []
        for rows in (np.flatnonzero(x[:, f] <= c), np.flatnonzero(x[:, f] > c)):
            if len(rows) == 0:
                sides.append((0, 0.0, 0.0, 0.0))
                continue
            sf, sc = split(rows, g, h)
            leaf = [rate * float(g[r].sum() / (h[r].sum() + 1)) for r in (rows[x[rows, sf] <= sc], rows[x[rows, sf] > sc])]
            margin[rows] += np.where(x[rows, sf] <= sc, *leaf)
            sides.append((sf, sc, *leaf))
        trees.append((f, c, *sides))
    return bias, trees


def margins(x: np.ndarray, model: tuple[float, list[tuple]]) -> np.ndarray:
    out = np.full(len(x), model[0])
    for f, c, left, right in model[1]:
        for rows, (sf, sc, below, above) in ((x[:, f] <= c, left), (x[:, f] > c, right)):
            out[rows] += np.where(x[rows, sf] <= sc, below, above)
    return out


def threshold(margin: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> float:
    """Lowest margin from which the precision on these rows is at least that asked for."""
    order = np.argsort(-margin, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.r_[margin[order][:-1] != margin[order][1:], True]
    good = np.flatnonzero((right >= precision) & last)
    return float(margin[order][good[-1]]) if len(good) else float("inf")


@cache
def _fitted(rows: tuple) -> dict[str, tuple[tuple[float, list[tuple]], float]]:
    """Trees and threshold of each generator from rows (generator, kept out, label, features)."""
    out = {}
    for name, *_ in GENERATORS:
        own = [r for r in rows if r[0] == name]
        x, y = np.array([r[3] for r in own], dtype=float), np.array([r[2] for r in own], dtype=float)
        # calibrated on whole forms that the trees haven't seen
        apart = np.array([r[1] for r in own])
        model = boost(x[~apart], y[~apart])
        out[name] = (model, threshold(margins(x[apart], model), y[apart]))
    return out


def fit(spark: SparkSession) -> dict[str, tuple[tuple[float, list[tuple]], float]]:
    """Trees and threshold of each generator, from the generated snippets; features by the same expressions as in documents."""
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(snippets())), "array<struct<g:string,apart:boolean,y:int,text:string>>")).alias("r")).select("r.*")
    own = F.coalesce(*[hits(F.col("text"), pattern, F.col("g") == name) for name, _, pattern, _ in GENERATORS])
    found = rows.withColumn("own", own).withColumn("found", placed(F.col("own"))).filter(F.size("found") > 0)
    got = found.select("g", "apart", "y", _features(F.get("found", F.lit(0))).alias("x")).collect()
    return _fitted(tuple((r["g"], r["apart"], r["y"], tuple(r["x"])) for r in got))


def _margin(x: Column, model: tuple[float, list[tuple]]) -> Column:
    def side(s: tuple) -> Column:
        f, c, below, above = s
        return F.when(x[FEATURES[f]] <= c, below).otherwise(above)

    total = F.lit(model[0])
    for f, c, left, right in model[1]:
        total = total + F.when(x[FEATURES[f]] <= c, side(left)).otherwise(side(right))
    return total


def _likely(candidates: Column, model: tuple[float, list[tuple]], least: float) -> Column:
    return F.filter(candidates, lambda x: let(_features(x), lambda f: _margin(f, model)) >= least)


def find(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, text, spans of each base kind and added spans of each row."""
    models = fit(spark)
    text = F.col("text")
    state = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text"))
    state = state.select("*", *[hits(text, pattern, quick(text)).alias(f"h_{kind}") for kind, (pattern, quick, _) in RULES.items()])
    # blank one kind after the other; matches are sought again only where one before was blanked
    state = state.withColumn("rest", blanked(text, F.col("h_email"), RULES["email"][2]))
    for kind in BASE[1:]:
        pattern, quick, ok = RULES[kind]
        own = F.when(F.col("rest") == text, F.col(f"h_{kind}")).otherwise(hits(F.col("rest"), pattern, quick(F.col("rest"))))
        state = state.withColumn("again", own).withColumn("rest", blanked(F.col("rest"), F.col("again"), ok)).drop("again")
    for name, _, pattern, quick in GENERATORS:
        state = state.withColumn(f"h_{name}", hits(F.col("rest"), pattern, F.col("rest").rlike(quick)))
        if name in APART:
            state = state.withColumn("rest", blanked(F.col("rest"), F.col(f"h_{name}"), APART[name]))
    names = [*BASE, *[name for name, *_ in GENERATORS]]
    state = state.select("doc_id", "text", F.transform(F.array(*[f"h_{name}" for name in names]), placed).alias("found"))
    at = {name: F.get("found", F.lit(i)) for i, name in enumerate(names)}
    span = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))
    base = [F.transform(F.filter(at[kind], lambda x: RULES[kind][2](x["m"])), span).alias(kind) for kind in BASE]
    added: dict[str, list[Column]] = {}
    for name, kind, *_ in GENERATORS:
        added.setdefault(kind, []).append(F.transform(_likely(at[name], *models[name]), span))
    return state.select("doc_id", "text", *base, *[F.sort_array(F.concat(*parts)).alias(kind) for kind, parts in added.items()])


KINDS = (*BASE, "contact", "secret")


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Counts, digest of base spans, and all spans, for each row of docs."""
    found = find(spark, docs)
    named = lambda kind: F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["s"], x["e"]))
    return found.select(
        "doc_id",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.concat(*[named(k) for k in BASE]), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(*[named(k) for k in KINDS]), ",").alias("spans"),
        sum(F.size(k) for k in KINDS).cast("bigint").alias("n_spans"),
    )
