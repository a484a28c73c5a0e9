"""Personal data to surrogates, native.

Entities found by one expression are replaced by keyed surrogates of their type, script, gender and format; the same entity
gets the same surrogate everywhere, however it is punctuated, and different entities get different ones.

Numbers (phones, cards, social security numbers, addresses of hosts) go through keyed bijections of their value space, two
affine rounds with a reversal between, so two numbers can't meet.  Cards keep their first digit and whether their check digit
is right; private, loopback and link-local addresses stay so, and public ones public.  Emails, secrets, accounts (with right
check digits, digits for digits and letters for letters) and words of names are built from keyed SHA-256.  There two may meet,
so all distinct entities of the corpus are grouped by surrogate: of those that meet, the least keeps it and the others get
their next candidate, until none meet.  Replaced ones are usually none; they are joined by entity, never collected.  The
scheme hides values from readers; it is not meant to resist someone who has the key.

Names are found behind a title.  Within a document the words of such a name are then replaced wherever else they stand as
words, alone or two together, so "Frau Anna Schmidt" covers "Anna Schmidt" and "Schmidt".  A word's surrogate has a stem that
is the same in all documents and an end for the gender of its title; a title without gender, or no title, takes the gender of
the first other mention of the word in the document, else a neutral end.

Defined results: null text stays null with 0 entities; rows repeat as given; extra columns stay out of `surrogates`, and in
stage form all columns stay as they are but text, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.scratch import cut, positional

OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d?\d)"
MALE, FEMALE = "Mr|Herr|Señor|Sr|Monsieur|Господин|Κύριος", "Mrs|Ms|Miss|Frau|Señora|Sra|Dra|Madame|Mme|Госпожа|Κυρία"
TITLES = rf"{MALE}|{FEMALE}|Dr|Professor|Prof|Доктор|Профессор"
WORD = r"\p{Lu}\p{Ll}++"
#: Type to expression; where several fit at one place the first is taken.
TYPES = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)",
    "phone": r"(?<![\p{L}\p{N}+])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d){6,12})(?![\p{L}\p{N}])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\p{L}\p{N}])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])[0-9A-Fa-f]{32,}+(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:(?:{TITLES})\.?[ \u00A0])+{WORD}(?:[ \u00A0]{WORD})?",
}
ANY = "|".join(TYPES.values())
#: A cheap test that every text with an entity passes.
HINT = rf"\d[\d\p{{P}} ]{{5}}|@|[0-9A-Fa-f]{{32}}|[A-Z]{{2}}\d\d|(?:{TITLES})\.?[ \u00A0]\p{{Lu}}"
#: First octets of addresses of which all, some or none are public.
SOME_PUBLIC = (100, 169, 172, 192, 198, 203)
PUBLIC = [k for k in range(1, 224) if k not in (10, 127, *SOME_PUBLIC)]
#: Sixteen letters of a script, by the expression of its letters, and the ends of feminine, masculine and other names.
SCRIPTS = {
    r"\p{IsCyrillic}": ("авмнилекотрсуядг", "ина", "ин", "ко"),
    r"\p{IsGreek}": ("αβδεγικλμνορστυφ", "α", "ος", "ι"),
    "": ("abdefgiklmnorstu", "a", "o", "e"),
}


class Surrogates:
    def __init__(self, key: str, digest_chars: int = 20):
        if not key:
            raise ValueError("a key is needed")
        self.key, self.size = key, digest_chars

    def number(self, what: str, bits: int) -> int:
        return int.from_bytes(hashlib.sha256(f"{self.key}:{what}".encode()).digest(), "big") % (1 << bits)

    def hashed(self, what: str, canon: Column, attempt: Column | int) -> Column:
        """64 hexadecimal digits."""
        attempt = F.lit(attempt) if isinstance(attempt, int) else attempt
        return F.sha2(F.concat_ws(":", F.lit(self.key), F.lit(what), attempt.cast("string"), canon).cast("binary"), 256)

    def letters(self, h: Column, like: Column, size: int) -> Column:
        """As many letters, one for each hexadecimal digit, of the script of `like`."""
        h, out = F.substring(h, 1, size), None
        for script, (alphabet, *_) in reversed(SCRIPTS.items()):
            made = F.translate(h, "0123456789abcdef", alphabet)
            out = made if out is None else F.when(like.rlike(script), made).otherwise(out)
        return out

    def digits(self, what: str, x: Column) -> Column:
        """A keyed bijection of strings of n digits, n up to 18."""
        n = F.length(x)
        for r in range(2):
            a = self.number(f"{what}{r}a", 55) // 10 * 10 + (3, 7)[r]
            b = self.number(f"{what}{r}b", 55)
            wide = x.cast("decimal(18,0)").cast("decimal(19,0)") * F.lit(a).cast("decimal(18,0)") + F.lit(b).cast("decimal(18,0)")
            x = F.right(F.lpad(wide.cast("string"), 38, "0"), n)
            x = F.reverse(x) if r == 0 else x
        return x

    def bits(self, what: str, x: Column, n: int) -> Column:
        """A keyed bijection of numbers of n bits, n even."""
        for r in range(2):
            x = (x * F.lit(self.number(f"{what}{r}a", n - 2) | 1) + F.lit(self.number(f"{what}{r}b", n - 1))) % F.lit(1 << n)
            x = F.shiftright(x, n // 2) + x % F.lit(1 << n // 2) * F.lit(1 << n // 2) if r == 0 else x
        return x

    def address(self, ip: Column) -> Column:
        """A keyed bijection of addresses that keeps each kind of network to itself."""
        a, b, c, d = (F.element_at(F.split(ip, r"\."), k + 1).cast("long") for k in range(4))
        low = c * 256 + d
        wide, narrow = self.bits("ip24", b * 65536 + low, 24), self.bits("ip16", low, 16)
        inner = self.bits("ip20", (b - 16) * 65536 + low, 20) + 16 * 65536
        order = sorted(PUBLIC, key=lambda k: self.number(f"ip{k}", 256))
        turned = dict(zip(PUBLIC, order))
        other = F.element_at(F.array(*(F.lit(turned.get(k, k)) for k in range(256))), (a + 1).cast("int")).cast("long")
        same = F.when((a == 172) & b.between(16, 31), inner).when(a.isin(*SOME_PUBLIC), b * 65536 + narrow).otherwise(wide)
        x = other * (1 << 24) + same
        return F.array_join(F.array(*((F.shiftright(x, 8 * (3 - k)) % 256).cast("string") for k in range(4))), ".")

    @staticmethod
    def chars(x: Column) -> Column:
        return F.filter(F.split(x, ""), lambda c: c != "")

    @classmethod
    def luhn(cls, body: Column) -> Column:
        """The check digit behind body."""
        value = lambda c, i: F.when(i % 2 == 1, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))
        return F.pmod(-F.aggregate(F.transform(cls.chars(F.reverse(body)), value), F.lit(0), lambda a, x: a + x), F.lit(10))

    def card(self, raw: Column) -> Column:
        """All digits but the first: those between by a bijection, the last as right or wrong a check digit as it was."""
        n = F.length(raw)
        body, last = F.left(raw, n - 1), F.right(raw, F.lit(1)).cast("int")
        fresh = F.concat(F.left(raw, F.lit(1)), self.digits("card", F.substr(raw, F.lit(2), n - 2)))
        return F.substr(F.concat(fresh, F.pmod(self.luhn(fresh) + last - self.luhn(body), F.lit(10)).cast("string")), F.lit(2))

    def iban(self, canon: Column, h: Column) -> Column:
        """Country kept, digits for digits and letters for letters, with right check digits."""
        digit, letter = F.translate(h, "abcdef", "012345"), F.translate(h, "0123456789abcdef", "ABDEFGIKLMNORSTU")
        body = F.array_join(F.transform(self.chars(F.substr(canon, F.lit(5))), lambda c, i: F.substr(F.when(c.rlike("[0-9]"), digit).otherwise(letter), i + 1, F.lit(1))), "")
        country = F.left(canon, F.lit(2))
        rest = F.aggregate(self.chars(F.concat(body, country, F.lit("00"))), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97)
        return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), body)

    @classmethod
    def spaced(cls, e: Column, fresh: Column) -> Column:
        """fresh with the spaces of e."""
        place = lambda i: F.length(F.replace(F.substr(e, F.lit(1), i + 1), F.lit(" "), F.lit("")))
        return F.array_join(F.transform(cls.chars(e), lambda c, i: F.when(c == " ", c).otherwise(F.substr(fresh, place(i), F.lit(1)))), "")

    @staticmethod
    def kind(e: Column) -> Column:
        """The type of an entity."""
        out = F.lit("name")  # titled, or a further mention
        for name, regex in reversed([x for x in TYPES.items() if x[0] != "name"]):
            out = F.when(e.rlike(rf"^(?:{regex})$"), F.lit(name)).otherwise(out)
        return out

    @staticmethod
    def canon(kind: Column, e: Column) -> Column:
        """What must be equal for two entities to be the same."""
        digits = F.regexp_replace(e, r"\D", "")
        ip = F.array_join(F.transform(F.split(e, r"\."), lambda o: o.cast("int").cast("string")), ".")
        return (
            F.when(kind.isin("email", "secret"), F.lower(e)).when(kind == "ip", ip)
            .when(kind.isin("ssn", "card"), digits).when((kind == "phone") & (F.length(digits) > 13), digits).when(kind == "phone", F.concat(F.left(F.lpad(digits, 13, "0"), F.lit(3)), F.right(digits, F.lit(10))))
            .when(kind == "iban", F.replace(e, F.lit(" "), F.lit(""))).otherwise(e)
        )

    @staticmethod
    def overlay(e: Column, fresh: Column) -> Column:
        """e with its digits, from the right, replaced by those of fresh; digits before them stay."""
        kept = F.length(F.regexp_replace(e, r"\D", "")) - F.length(fresh)
        char = lambda c, i: F.when(c.rlike(r"^\d$") & (F.length(F.regexp_replace(F.substr(e, F.lit(1), i + 1), r"\D", "")) > kept), F.substr(fresh, F.length(F.regexp_replace(F.substr(e, F.lit(1), i + 1), r"\D", "")) - kept, F.lit(1))).otherwise(c)
        return F.array_join(F.transform(F.split(e, ""), char), "")

    def stem(self, word: Column, attempt: Column | int) -> Column:
        return self.letters(self.hashed("name", word, attempt), word, min(self.size, 12))

    def name(self, e: Column, people: Column, attempt) -> Column:
        """Titles kept, each other word by its stem and an end."""

        def fresh(w: Column, i: Column) -> Column:
            known = F.filter(people, lambda x: (x["word"] == w) & (x["gender"] < 2))
            own = gender(e)
            turn = F.when(own < 2, own).otherwise(F.coalesce(F.get(known, F.lit(0))["gender"], F.lit(2)))
            end = None
            for script, (_, *ends) in reversed(SCRIPTS.items()):
                made = F.element_at(F.array(*map(F.lit, ends)), turn + 1)
                end = made if end is None else F.when(w.rlike(script), made).otherwise(end)
            return F.when(is_title(e, w, i), w).otherwise(F.initcap(F.concat(self.stem(w, attempt("name", w)), end)))

        made = F.transform(words(e), fresh)
        return F.when(F.contains(e, F.lit("\u00a0")), F.array_join(made, "\u00a0")).otherwise(F.array_join(made, " "))

    def make(self, kind: Column, e: Column, attempt: Column | int = 0) -> Column:
        """The surrogate of any entity but a name."""
        canon = self.canon(kind, e)
        h = self.hashed("entity", F.concat_ws(":", kind, canon), attempt)
        raw = F.regexp_replace(e, r"\D", "")
        domain = F.substring_index(canon, "@", -1)
        email = F.concat(self.letters(h, F.substring_index(canon, "@", 1), self.size), F.lit("@"), F.substring(self.hashed("domain", domain, 0), 1, self.size), F.lit(".example"))
        secret = F.left(F.repeat(F.concat(h, self.hashed("more", canon, attempt)), F.ceil(F.length(e) / 128).cast("int")), F.length(e))
        secret = F.when(e.rlike("[A-F]") & ~e.rlike("[a-f]"), F.upper(secret)).otherwise(secret)
        return (
            F.when(kind == "email", email).when(kind == "ip", self.address(e))
            .when(kind == "phone", self.overlay(e, self.digits("phone", F.right(raw, F.lit(10)))))
            .when(kind == "ssn", self.overlay(e, self.digits("ssn", raw)))
            .when(kind == "card", self.overlay(e, self.card(raw)))
            .when(kind == "secret", secret).when(kind == "iban", self.spaced(e, self.iban(canon, h)))
        )


def words(e: Column) -> Column:
    return F.split(e, "[ \u00a0]")


def titled(e: Column) -> Column:
    return e.rlike(rf"^(?:{TITLES})\.?[ \u00A0]")


def is_title(e: Column, w: Column, i: Column) -> Column:
    """Whether word w, at i, of a name is a title."""
    return titled(e) & (i < F.size(words(e)) - 1) & w.rlike(rf"^(?:{TITLES})\.?$")


def name_words(e: Column) -> Column:
    return F.filter(words(e), lambda w, i: ~is_title(e, w, i))


def gender(e: Column) -> Column:
    """0 feminine, 1 masculine, 2 neither."""
    among = lambda some: F.exists(words(e), lambda w: w.rlike(rf"^(?:{some})\.?$"))
    return F.when(~titled(e), 2).when(among(FEMALE), 0).when(among(MALE), 1).otherwise(2)


def entities(text: Column) -> Column:
    """Entities of a text in order, as written, further mentions of names not among them."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(f"({ANY})"), 1)).otherwise(F.array().cast("array<string>"))


def collisions(found: DataFrame, make: Surrogates, rounds: int = 8) -> DataFrame:
    """found(kind, canon): distinct.  Entities whose first surrogate is taken, as (kind, canon, attempt)."""
    made = F.when(F.col("kind") == "name", make.stem(F.col("canon"), F.col("attempt"))).otherwise(make.make(F.col("kind"), F.col("canon"), F.col("attempt")))
    now = cut(found.where(F.col("kind").isin("email", "secret", "iban", "name")).withColumn("attempt", F.lit(0)))
    for _ in range(rounds):
        held = now.withColumn("surrogate", made)
        first = held.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canon")).alias("first"), F.count("*").alias("n")).where("n > 1")
        lost = held.join(first, ["kind", "surrogate"]).where("struct(attempt, canon) <> first").select("kind", "canon")
        if lost.limit(1).count() == 0:
            return now.where("attempt > 0")
        lost = lost.withColumn("more", F.lit(1))
        now = cut(now.join(lost, ["kind", "canon"], "left").select("kind", "canon", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt")))
    raise ValueError("surrogates keep meeting: raise digest_chars")


def keyed(make: Surrogates, found: Column) -> Column:
    """Entities as written to distinct (kind, canon), of names word for word."""

    def keys(e: Column) -> Column:
        kind = make.kind(e)
        one = lambda c: F.struct(kind.alias("kind"), c.alias("canon"))
        return F.when(kind == "name", F.transform(name_words(e), one)).otherwise(F.array(one(make.canon(kind, e))))

    return F.array_distinct(F.flatten(F.transform(F.array_distinct(found), keys)))


def rewrite(docs: DataFrame, key: str, text: str, digest_chars: int = 20) -> DataFrame:
    """docs with text replaced, and found, the entities as (kind, text, surrogate).  docs must not have columns of the names
    used here."""
    make = Surrogates(key, digest_chars)
    own = docs.withColumn("plain", entities(F.col(text)))
    known = own.where(F.size("plain") > 0).select(F.explode(keyed(make, F.col("plain"))).alias("k")).select("k.*").distinct()
    moved = collisions(known, make)
    if moved.limit(1).count():
        # looked up by a digest of the text; texts without entities have a shorter one, which finds nothing
        own = own.withColumn("digest", F.when(F.size("plain") > 0, F.sha2(F.col(text).cast("binary"), 256)).otherwise(F.hex(F.xxhash64(text))))
        hits = own.where(F.size("plain") > 0).select("digest", F.explode(keyed(make, F.col("plain"))).alias("k")).select("digest", "k.*").distinct().join(moved, ["kind", "canon"])
        hits = hits.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "kind", "canon"), "attempt"))).alias("moved"))
        own = own.join(hits, "digest", "left")
        attempt = lambda kind, canon: F.coalesce(F.try_element_at("moved", F.concat_ws(":", F.lit(kind) if isinstance(kind, str) else kind, canon)), F.lit(0))
    else:
        attempt = lambda kind, canon: 0
    person = lambda e: F.transform(name_words(e), lambda w: F.struct(w.alias("word"), gender(e).alias("gender")))
    own = own.withColumn("people", F.flatten(F.transform(F.filter("plain", titled), person)))
    some = F.array_join(F.array_distinct(F.transform("people", lambda x: x["word"])), "|")
    mention = F.concat(F.lit(rf"{ANY}|(?<![\p{{L}}\p{{N}}])(?:"), some, F.lit(r")(?:[ \u00A0](?:"), some, F.lit(r"))?(?![\p{L}\p{N}])"))
    several = F.size("people") > 0
    own = own.withColumn("e", F.when(several, F.regexp_extract_all(text, F.concat(F.lit("("), mention, F.lit(")")), 1)).otherwise(F.col("plain")))

    def one(e: Column) -> Column:
        kind = make.kind(e)
        fresh = F.when(kind == "name", make.name(e, F.col("people"), attempt)).otherwise(make.make(kind, e, attempt(kind, make.canon(kind, e))))
        return F.struct(kind.alias("kind"), e.alias("text"), fresh.alias("surrogate"))

    own = own.withColumn("found", F.transform("e", one))
    pieces = F.when(several, F.split(F.col(text), mention, -1)).otherwise(F.split(F.col(text), ANY, -1))
    whole = F.concat(pieces[0], F.array_join(F.zip_with("found", F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda f, p: F.concat(f["surrogate"], p)), ""))
    return own.withColumn(text, F.when(F.size("found") > 0, whole).otherwise(F.col(text))).select(*docs.columns, "found")


def surrogates(docs: DataFrame, key: str, digest_chars: int = 20) -> DataFrame:
    """docs(doc_id, text, ...) to (doc_id, n_entities, found, text), a row for each row of docs."""
    out = rewrite(docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")), key, "text", digest_chars)
    return out.select("doc_id", F.coalesce(F.greatest(F.size("found"), F.lit(0)), F.lit(0)).cast("long").alias("n_entities"), "found", "text")


def replace(docs: DataFrame, key: str) -> DataFrame:
    """docs with the same columns and text rewritten."""
    own, names = positional(docs)
    return rewrite(own, key, names["text"]).select(*(F.col(n).alias(c) for n, c in zip(own.columns, docs.columns)))
