"""Surrogates for personal data, with DataFrame functions only.

One pattern finds e-mail addresses, phone, card, account and identity numbers, IPv4 addresses, secrets
and names after a form of address, with the same document's bare mentions of them. Every entity is
reduced to a normal form (``norm``: digits of numbers, lower-cased addresses, single names), so that
differently written mentions are one entity. A message authentication code (HMAC-SHA-256) of the normal
form under the caller's key seeds its surrogate: without the key nobody can make it again. Numbers get
digits for digits; addresses letters of the same script and vowel class, below reserved domains; cards
keep a valid check digit; the parts of an IPv4 address stay in range. Names are made of syllables of
their script, given names with an ending of the gender that the forms of address tell. A name is one entity all over a
document, whatever mentions it is in: the longest says whether it is a family name, all forms of address
before it say its gender. Accounts keep their country and valid check digits. The surrogate is then poured into
each mention's own format.

Collision check: a surrogate may belong to one entity only and may not be an entity of the corpus.
Entities that violate this take the next surrogate of their sequence, and meet again only what is settled:
a round costs what is left. Names grow by a syllable each time; from the ``RELAX``-th try on, every other
kind grows by a character a round, so that the room for surrogates is multiplied each time and no format
runs out. After ``ROUNDS`` rounds, which no corpus needs, there is an error.

Mentions, not texts, are grouped and joined; only texts with entities are shuffled, once. A mention that
is in a third of all rows is one row of the entity table, joined by broadcast while that table is small
(``BROADCAST_ENTITIES``) and otherwise by Spark's skew-splitting sort-merge join.

Defined results: null and empty texts have no entities and give an empty text; equal rows get equal
results; a null id is as good as any; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.store import stage

BROADCAST_ENTITIES = 200_000
RELAX, ROUNDS = 4, 60

# Forms of address by gender: fixed values.
MALE = ("Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Г-н", "Господин", "Κύριος", "Κ")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Fräulein", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Doña", "Г-жа", "Госпожа", "Κυρία")
NEUTRAL = ("Dr", "Doctor", "Prof", "Professor")
_TITLE = "(?:" + "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True)) + ")"
_FIRST = "".join(sorted({t[0] for t in MALE + FEMALE + NEUTRAL}))
_LABEL = r"(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?"
# A name or an initial; a name is up to four of them.
NAME = r"(?:\p{Lu}[\p{L}'’-]+|\p{Lu}\.)"
_NAMES = rf"{NAME}(?: {NAME}){{0,3}}"
_TITLES = rf"(?:{_TITLE}\.?[  ])+"
_EDGE = r"(?<=[\p{L}'’-])(?![\p{L}'’-])|(?<![\p{L}'’-])(?=[\p{L}'’-])"
# Words before places: fixed values.
PLACES = ("in", "near", "at", "outside", "nach", "à", "dans", "en", "в", "στο", "στην")
NAME_KINDS = ("given", "given_m", "given_f", "family")

KINDS = {
    "secret": rf"(?<![A-Za-z])(?=[tTsSpPaA]){_LABEL}[A-Za-z0-9_+/=-]{{16,}}[\"']?" + r"|(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])",
    "email": r"(?<![^\x00-\x2A\x2C\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7E])[^\x00-\x24\x26-\x2A\x2C\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7E]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "ipv4": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\d.+])(?:(?:\d{4}[ -]?){3}\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"\+\d[\d ().\/-]{6,18}\d(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\d)|(?<![\d.-])\d{3}[-.]\d{3}[-.]\d{4}(?!\d)",
    "name": rf"(?<!\p{{L}})(?=[{_FIRST}]){_TITLES}{_NAMES}",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: What every match of PATTERN holds, found in one quick pass: most texts have none of it.
MAY = rf"[0-9@]|(?<!\p{{L}})(?=[{_FIRST}]){_TITLE}\.?[  ]\p{{Lu}}|(?<![A-Za-z])(?=[tTsSpPaA]){_LABEL}|[A-Fa-f]{{32}}"

# Alphabets by script: vowels and consonants in lower case. Fixed values.
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу", "greek": "αειου"}
CONSONANTS = {"latin": "bcdfghjklmnpqrstvwxyz", "cyrillic": "бвгджзклмнпрстфхцчш", "greek": "βγδζθκλμνξπρστφχψ"}
# Syllables of made-up names by script: heads, middles, and endings by kind.
SYLLABLES = {
    "latin": {
        "head": "al an bar bel ben bran cal cor dan dar el fal fen gar gil hal har jon kal kor lan lor mar mel mor nor ol per quin ral ron sal sel tal tam tor val ven wil zan".split(),
        "middle": "a be co da di e fa i la le li lo ma mi na ne ni o ra re ri ro ta ti".split(),
        "given_f": "na la ra ella ina ia essa ita".split(), "given_m": "n rik tor bert do mund vin ko".split(), "given": "ris lin mar den ley sol".split(),
        "family": "son berg field man ley ton wood er sen well ford ini".split(),
    },
    "cyrillic": {
        "head": "ал бор вал вер гор дан дар зор кал кор лев мар мир нор ол род сав тал тор яр".split(), "middle": "а бо ви да е ди ла ле ми на ни о ра ре та".split(),
        "given_f": "на ла ра ина ия".split(), "given_m": "н рик слав мир дан".split(), "given": "лин мар сол".split(), "family": "ов ин ский енко ко ман".split(),
    },
    "greek": {
        "head": "αλ αν βασ γαλ δαμ ελ θεμ καλ κορ λαν μαρ μεν νικ ολ περ σελ ταλ φαν".split(), "middle": "α βε δι ε λα λι μα μι να νι ο ρα ρε τα".split(),
        "given_f": "να λα ρα ία".split(), "given_m": "ος ας ης".split(), "given": "λιν μαρ σολ".split(), "family": "ίδης άκης όπουλος άτος ου".split(),
    },
}


def _hash(seed: Column, i: Column, base: int) -> Column:
    return F.pmod(F.xxhash64(seed, i), F.lit(base)).cast("int")


def _pick(letters: str, seed: Column, i: Column) -> Column:
    return F.substring(F.lit(letters), _hash(seed, i, len(letters)) + 1, F.lit(1))


def _shaped(chars: Column, seed: Column) -> Column:
    """Characters of the same kind: digits, and letters of their script and vowel class."""

    def one(c: Column, i: Column) -> Column:
        out = F.when(c.between("0", "9"), _hash(seed, i, 10).cast("string"))
        for script in VOWELS:
            out = out.when(F.instr(F.lit(VOWELS[script]), c) > 0, _pick(VOWELS[script], seed, i)).when(F.instr(F.lit(CONSONANTS[script]), c) > 0, _pick(CONSONANTS[script], seed, i))
        out = out.when(c.rlike(r"\p{IsCyrillic}"), _pick(CONSONANTS["cyrillic"], seed, i)).when(c.rlike(r"\p{IsGreek}"), _pick(CONSONANTS["greek"], seed, i))
        return out.when(c.rlike(r"\p{L}"), _pick(VOWELS["latin"], seed, i)).otherwise(c)

    return F.array_join(F.transform(chars, one), "")


def _luhn(digits: Column) -> Column:
    """Weighted digit sum of an array of digits whose last is the check digit's place."""
    n = F.size(digits)
    twice = F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(twice, F.lit(0), lambda a, d: a + d)


def _digits(norm: Column) -> Column:
    return F.transform(F.split(norm, ""), lambda c: c.cast("int"))


def _mod97(norm: Column) -> Column:
    """The remainder by 97 of digits and lower-case letters, which are numbers from 10 to 35."""
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 87)
    step = lambda a, c: F.pmod(a * F.when(c.between("0", "9"), 10).otherwise(100) + value(c), F.lit(97))
    return F.aggregate(F.split(norm, ""), F.lit(0), step)


def mac(key: str, message: Column) -> Column:
    """HMAC-SHA-256 in hexadecimal digits."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(x ^ pad for x in raw)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def _more(letters: str, n: Column, seed: Column) -> Column:
    """n more characters."""
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: _pick(letters, seed, i + 1000)), "")).otherwise("")


def _name(kind: Column, norm: Column, salt: Column, seed: Column) -> Column:
    """Syllables of the name's script, one more with each salt, and an ending of its kind."""

    def of(script: str) -> Column:
        parts = SYLLABLES[script]
        one = lambda name, i: F.get(F.array(*map(F.lit, parts[name])), _hash(seed, i, len(parts[name])))
        middles = F.transform(F.sequence(F.lit(0), salt + _hash(seed, F.lit(-3), 2)), lambda i: F.when(i > 0, one("middle", i)).otherwise(""))
        ending = F.when(kind == "family", one("family", F.lit(-4)))
        for k in ("given_f", "given_m"):
            ending = ending.when(kind == k, one(k, F.lit(-4)))
        return F.concat(one("head", F.lit(-2)), F.array_join(middles, ""), ending.otherwise(one("given", F.lit(-4))))

    return F.when(norm.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(norm.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """Adds ``sur`` to (kind, norm, salt): the surrogate of a normal form. From salt RELAX on it grows."""
    seed = mac(key, F.concat_ws("|", "kind", "norm", F.col("salt").cast("string")))
    df = entities.select("kind", "norm", "salt", seed.alias("seed"), F.split("norm", "").alias("chars"))
    c, s, salt = F.col("chars"), F.col("seed"), F.col("salt")
    loose, extra = salt >= RELAX, salt - (RELAX - 1)
    digits = _more("0123456789", extra, s)
    # numbers: cards keep the first digit and the check digit's validity
    payload = F.transform(c, lambda x, i: F.when(i == 0, x.cast("int")).when(i == F.size("chars") - 1, F.lit(0)).otherwise(_hash(s, i, 10)))
    df = df.withColumn("payload", F.when(F.col("kind") == "card", payload))
    valid = _luhn(_digits(F.col("norm"))) % 10 == 0
    last = F.when(valid, F.pmod(10 - _luhn(F.col("payload")) % 10, F.lit(10))).otherwise(_hash(s, F.lit(99), 10)).cast("string")
    card = F.concat(F.array_join(F.transform(F.slice("payload", F.lit(1), F.size("payload") - 1), lambda d: d.cast("string")), ""), last, digits)
    # phones: the country code stays, and a reserved exchange (555) while there is room
    code = F.when(F.col("norm").startswith("+"), F.when(F.substring("norm", 2, 1).isin("1", "7"), 2).otherwise(3)).otherwise(0)
    reserved = (F.substring("norm", 6, 3) == "555") & F.col("norm").startswith("+1") & ~loose
    phone = F.array_join(
        F.transform(c, lambda x, i: F.when(i < code, x).when(reserved & i.between(5, 7), x).when(i == code, (_hash(s, i, 8) + 2).cast("string")).otherwise(_hash(s, i, 10).cast("string"))), ""
    )
    # IPv4: parts of the same length while there is room, then any, then addresses of the range for documentation
    parts = F.split("norm", r"\.")
    octet = lambda x, i: F.when(loose, 1 + _hash(s, i, 254)).when(F.length(x) == 3, 100 + _hash(s, i, 156)).when(F.length(x) == 2, 10 + _hash(s, i, 90)).otherwise(_hash(s, i, 10)).cast("string")
    ipv4 = F.when(salt >= 2 * RELAX, F.concat(F.lit("2001:db8:"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.substring(s, 4 * i, F.lit(4))), ":"))).otherwise(F.array_join(F.transform(parts, octet), "."))
    # addresses: reserved domains only, below them and before the @ letters for letters
    at = F.instr("norm", "@")
    local, domain = F.substring(F.col("norm"), F.lit(1), at), F.substring(F.col("norm"), at + 1, F.length("norm"))
    labels = F.split(domain, r"\.")
    below = F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 2, F.lit(0)))
    top = F.element_at(F.array(*map(F.lit, ("com", "net", "org"))), _hash(s, F.lit(-1), 3) + 1)
    letters = _more(CONSONANTS["latin"], extra, s)
    email = F.concat(letters, _shaped(F.split(local, ""), s), F.when(F.size(below) > 0, F.concat(_shaped(F.split(F.array_join(below, "."), ""), F.concat(s, F.lit("d"))), F.lit("."))).otherwise(""), F.lit("example."), top)
    hexed = F.array_join(F.transform(c, lambda x, i: F.when(x.between("0", "9") | x.between("a", "f"), F.substring(F.lit("0123456789abcdef"), _hash(s, i, 16) + 1, F.lit(1))).otherwise(x)), "")
    secret = F.concat(F.when(F.col("norm").rlike("^[0-9a-f]+$"), hexed).otherwise(_shaped(c, s)), digits)
    # accounts: the country stays, and the check digits are valid if they were
    account = _shaped(F.split(F.substring(F.col("norm"), F.lit(5), F.length("norm")), ""), s)
    country = F.substring("norm", 1, 2)
    right = F.lpad((98 - _mod97(F.concat(account, digits, country, F.lit("00")))).cast("string"), 2, "0")
    wrong = F.concat(_hash(s, F.lit(97), 10).cast("string"), _hash(s, F.lit(98), 10).cast("string"))
    valid = _mod97(F.concat(F.substring(F.col("norm"), F.lit(5), F.length("norm")), F.substring("norm", 1, 4))) == 1
    iban = F.concat(country, F.when(valid, right).otherwise(wrong), account, digits)
    k = F.col("kind")
    sur = (
        F.when(k == "iban", iban).when(k == "card", card).when(k == "phone", F.concat(phone, digits)).when(k == "ipv4", ipv4).when(k == "email", email).when(k == "secret", secret)
        .when(k.isin(*NAME_KINDS), _name(k, F.col("norm"), salt, s)).when(k == "initial", F.concat(_shaped(c, s), letters)).otherwise(F.concat(_shaped(c, s), digits))
    )
    return df.select("kind", "norm", "salt", sur.alias("sur"))


def settle(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, sur) of distinct entities (kind, norm), without collisions."""
    own, place = entities.select("kind", F.col("norm").alias("sur")), ["kind", "sur"]
    left, settled = entities, None
    for salt in range(ROUNDS):
        tried = stage(surrogates(left.select("kind", "norm", F.lit(salt).alias("salt")), key), "surrogates-tried")
        free = tried.join(own, place, "left_anti")
        if settled is not None:
            free = free.join(settled.select(*place), place, "left_anti")
        won = stage(free.groupBy(*place).agg(F.min("norm").alias("norm")).select("kind", "norm", "sur"), "surrogates")
        settled = won if settled is None else settled.unionByName(won)
        left = stage(tried.select("kind", "norm").join(won.select("kind", "norm"), ["kind", "norm"], "left_anti"), "surrogates-left")
        if left.isEmpty():
            return settled
    raise RuntimeError(f"entities without a free surrogate after {ROUNDS} rounds: {left.limit(3).collect()}")


def _kind(m: Column) -> Column:
    """The first kind, in order of the pattern, that matches the whole mention. Digits without a separator are a card only
    with an issuer's first digit and a valid check digit; else they are no entity and have no kind."""
    out = None
    for kind, pattern in KINDS.items():
        test = m.rlike(f"^(?:{pattern})$")
        what = F.when(m.rlike(r"\D") | (m.rlike("^[2-6]") & (_luhn(_digits(m)) % 10 == 0)), kind) if kind == "card" else F.lit(kind)
        out = F.when(test, what) if out is None else out.when(test, what)
    return out


def _atoms(m: Column, kind: Column) -> Column:
    """A mention as parts in order: kind (null: stays as it is), norm and the part as written."""
    plain = F.lit(None).cast("struct<words:int,last:boolean,gender:string>")
    part = lambda k, norm, text, seen=plain: F.struct(k.alias("kind"), norm.alias("norm"), text.alias("text"), seen.alias("seen"))
    stays = lambda text: part(F.lit(None).cast("string"), F.lit(None).cast("string"), text)
    label, value, quote = (F.regexp_extract(m, rf"^((?:{_LABEL})?)([A-Za-z0-9_+/=-]{{16,}})([\"']?)$", g) for g in (1, 2, 3))
    secret = F.array(stays(label), part(F.lit("secret"), F.when(value.rlike("^[0-9A-F]+$"), F.lower(value)).otherwise(value), value), stays(quote))
    title, names = (F.regexp_extract(m, rf"^({_TITLES})({_NAMES})$", g) for g in (1, 2))
    forms = F.split(F.regexp_replace(title, r"[.  ]+", " "), " ")
    gender = F.when(F.arrays_overlap(forms, F.array(*map(F.lit, FEMALE))), "f").when(F.arrays_overlap(forms, F.array(*map(F.lit, MALE))), "m")
    words = F.split(names, " ")

    def word(w: Column, i: Column) -> Column:
        bare = F.regexp_replace(w, r"\.$", "")
        of = F.when(bare != w, "initial").otherwise("name")
        seen = F.struct(F.size(words).alias("words"), (i == F.size(words) - 1).alias("last"), gender.alias("gender"))
        return F.array(stays(F.when(i > 0, " ").otherwise("")), part(of, F.lower(bare), bare, F.when(bare == w, seen)), stays(F.when(bare != w, ".").otherwise("")))

    name = F.concat(F.array(stays(title)), F.flatten(F.transform(words, word)))
    norm = F.when(kind == "email", F.lower(m)).when(kind == "phone", F.regexp_replace(m, r"[^0-9+]", "")).when(kind == "iban", F.lower(F.replace(m, F.lit(" "), F.lit("")))).when(kind.isin("card", "ssn"), F.regexp_replace(m, r"[^0-9]", "")).otherwise(m)
    return F.when(kind == "secret", secret).when(kind == "name", name).otherwise(F.array(part(kind, norm, m)))


def _one_kind_a_name(atoms: DataFrame) -> DataFrame:
    """``atoms`` with a kind for each name that is the same all over a document, so that a word has one surrogate there:
    by its place in the longest mention it is in, and by the genders of all forms of address before it."""
    seen, place = F.col("seen"), ["doc_id", "text_key", "norm"]
    of = atoms.where("kind = 'name'").groupBy(*place).agg(F.max(F.struct("seen.words", "seen.last")).alias("longest"), F.bool_or(seen["gender"] == "f").alias("f"), F.bool_or(seen["gender"] == "m").alias("m"))
    f, m = (F.coalesce(F.col(x), F.lit(False)) for x in "fm")
    kind = F.when(F.col("longest.last"), "family").when(f & ~m, "given_f").when(m & ~f, "given_m").otherwise("given")
    of = of.select(*[F.col(c).alias(f"n_{c}") for c in place], kind.alias("name_kind"), F.col("longest.words").alias("words"))
    same = F.col("doc_id").eqNullSafe(F.col("n_doc_id")) & (F.col("text_key") == F.col("n_text_key")) & (F.col("norm") == F.col("n_norm")) & (F.col("kind") == "name")
    return atoms.join(of, same, "left").withColumn("kind", F.coalesce("name_kind", "kind")).drop("seen", "name_kind", *[f"n_{c}" for c in place])


def _poured(kind: Column, text: Column, sur: Column) -> Column:
    """The surrogate in the mention's format: its separators, its case."""
    chars = F.split(text, "")
    start = F.struct(F.lit(1).alias("i"), F.lit("").alias("out"))
    poured = F.aggregate(
        chars, start, lambda a, c: F.when(c.rlike(r"[0-9A-Za-z+]"), F.struct((a["i"] + 1).alias("i"), F.concat(a["out"], F.upper(F.substring(sur, a["i"], F.lit(1)))).alias("out"))).otherwise(F.struct(a["i"].alias("i"), F.concat(a["out"], c).alias("out")))
    )
    numbers = F.concat(poured["out"], F.substring(sur, poured["i"], F.length(sur)))  # with what it has grown by
    upper = (text == F.upper(text)) & (text != F.lower(text))
    cased = F.when(upper, F.upper(sur)).otherwise(sur)
    names = F.when(upper & (F.length(text) > 1), F.upper(sur)).otherwise(F.concat(F.upper(F.substring(sur, 1, 1)), F.substring(sur, F.lit(2), F.length(sur))))
    return F.when(kind.isin("phone", "card", "ssn", "iban"), numbers).when(kind.isin("initial", *NAME_KINDS), names).when(kind.isin("secret", "email"), cased).otherwise(sur)


def _bare(piece: Column, names: Column) -> Column:
    """A text between mentions as (text, hit) parts: capitalised words that are a name of the document
    get its surrogate, before an 's too. A name that is only known with a form of address, alone, may be a place's
    too: after a word for being somewhere it stays."""

    def one(t: Column, i: Column) -> Column:
        stem = F.regexp_replace(t, "['’-]+s?$", "")
        name = F.get(F.filter(names, lambda n: n["norm"] == F.lower(stem)), F.lit(0))
        sur, before = name["sur"], F.when(F.get(parts, i - 1).rlike(r"^\s+$"), F.lower(F.get(parts, i - 2)))
        place = (name["words"] == 1) & F.coalesce(before.isin(*PLACES), F.lit(False))
        hit = t.rlike(r"^\p{Lu}") & sur.isNotNull() & ~place
        new = F.concat(_poured(F.lit("family"), stem, sur), F.substring(t, F.length(stem) + 1, F.length(t)))
        return F.struct(F.when(hit, new).otherwise(t).alias("text"), hit.alias("hit"))

    parts = F.split(piece, _EDGE)
    return F.transform(parts, one)


def replace_entities(docs: DataFrame, *, key: str) -> DataFrame:
    """doc_id, n_entities, kinds (of the entities, sorted, comma-joined) and the text with surrogates, of
    every document. ``key`` is the caller's secret: the same key gives the same surrogates."""
    keyed = docs.select(F.col("doc_id"), F.xxhash64("doc_id", "text").alias("text_key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    mentions = F.when(F.col("text").rlike(MAY), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    flagged = keyed.withColumn("mentions", mentions).withColumn("has", F.coalesce(F.size("mentions"), F.lit(0)) > 0)
    flagged = stage(flagged, "texts-and-mentions", "has")  # every text is searched once
    found = flagged.where("has").select("doc_id", "text_key", "mentions").dropDuplicates(["doc_id", "text_key"])
    found = found.select("doc_id", "text_key", F.posexplode_outer("mentions").alias("pos", "mention")).withColumn("mention_kind", _kind(F.col("mention")))
    found = stage(found, "mentions")
    atoms = found.select("doc_id", "text_key", "pos", "mention_kind", F.posexplode_outer(_atoms(F.col("mention"), F.col("mention_kind"))).alias("part", "atom"))
    atoms = stage(_one_kind_a_name(atoms.select("doc_id", "text_key", "pos", "part", "mention_kind", "atom.*")), "mention-parts")
    table = settle(stage(atoms.where("kind is not null").select("kind", "norm").distinct(), "entities"), key).select(F.col("kind").alias("e_kind"), F.col("norm").alias("e_norm"), "sur")
    if table.count() <= BROADCAST_ENTITIES:
        table = F.broadcast(table)
    atoms = atoms.join(table, (F.col("kind") == F.col("e_kind")) & (F.col("norm") == F.col("e_norm")), "left")
    atoms = atoms.select("doc_id", "text_key", "mention_kind", F.struct("pos", "part", F.coalesce(_poured(F.col("kind"), F.col("text"), F.col("sur")), "text").alias("new")).alias("x"), F.when(F.col("kind").isin(*NAME_KINDS), F.struct("norm", "sur", "kind", "words")).alias("name"))
    per = atoms.groupBy("doc_id", "text_key", F.col("x.pos").alias("pos")).agg(F.sort_array(F.collect_list("x")).alias("xs"), F.first("mention_kind").alias("kind"), F.collect_set("name").alias("names"))
    per = per.select("doc_id", "text_key", F.struct("pos", F.array_join(F.transform("xs", lambda x: x["new"]), "").alias("new"), "kind").alias("x"), "names")
    per = per.groupBy(F.col("doc_id").alias("h_id"), F.col("text_key").alias("h_key")).agg(F.sort_array(F.collect_list("x")).alias("new"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))
    same = F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_key") == F.col("h_key"))
    hit = flagged.where("has").drop("mentions").join(stage(per, "mention-surrogates"), same)
    pieces = F.split("text", PATTERN, -1)
    bare = F.transform(pieces, lambda p: _bare(p, F.col("names")))
    hit = hit.withColumn("bare", F.when(F.size("names") > 0, bare))
    pieces = F.coalesce(F.transform("bare", lambda ts: F.array_join(F.transform(ts, lambda t: t["text"]), "")), pieces)
    again = F.when(F.col("bare").isNotNull(), F.size(F.filter(F.flatten("bare"), lambda t: t["hit"]))).otherwise(0)
    text = F.array_join(F.zip_with(pieces, F.transform("new", lambda x: x["new"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    found = F.filter(F.transform("new", lambda x: x["kind"]), lambda k: k.isNotNull())
    kinds = F.array_join(F.array_sort(F.concat(found, F.array_repeat(F.lit("name"), again))), ",")
    hit = hit.select("doc_id", (F.size(found) + again).cast("long").alias("n_entities"), kinds.alias("kinds"), text.alias("text"))
    clean = flagged.where("not has").select("doc_id", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("kinds"), "text")
    return hit.unionByName(clean)
