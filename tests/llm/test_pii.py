import hashlib
import random
import re

from pyspark.sql import functions as F

from vectorloom.llm import pii

TEXT = (
    "Mail Ann.Lee7@mail2.example.com or ann.lee7@MAIL2.example.com, host 10.2.3.4. Call +1 (017) 555-7713 or +1-017-555-7713; card 4283648832092189, 4283 6488 3209 2189, "
    'ssn 123-45-6789. token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" IBAN DE44 5001 0517 5407 3249 31. Frau Anna Schmidt met Herr Karl Schmidt. Господин Иван left.'
)
PLAIN = ["", "no digits here", "12 345 and 1.2 or 300.1.2.3, 2024-01-02", "MR SMITH", "x" * 50_000 + "@", None]


def run(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, found string")
    return {r.doc_id: r for r in pii.surrogates(df, "key", **kw).collect()}


def test_types_formats_and_coreference(spark):
    got = run(spark, [TEXT, TEXT + "\nagain"])
    found = [(f.kind, f.text, f.surrogate) for f in got[0].found]
    assert [k for k, _, _ in found] == ["email", "email", "ip", "phone", "phone", "card", "card", "ssn", "secret", "iban", "name", "name", "name"]
    new = {t: s for _, t, s in found}
    assert all(t != s and t not in got[0].text for t, s in new.items())
    assert got[1].text == got[0].text + "\nagain"
    digits = lambda s: re.sub(r"\D", "", s)
    s = [x for _, _, x in found]
    assert s[0] == s[1] and digits(s[3]) == digits(s[4]) and digits(s[5]) == digits(s[6])
    for _, t, x in found[3:8]:
        assert re.sub(r"\d", "0", t) == re.sub(r"\d", "0", x)  # the same format
    assert all(0 <= int(o) <= 255 for o in s[2].split("."))
    assert re.fullmatch("[0-9a-f]{40}", s[8])
    assert re.fullmatch("Frau [A-Z][a-z]+a [A-Z][a-z]+a", s[10]) and re.fullmatch("Herr [A-Z][a-z]+o [A-Z][a-z]+o", s[11]) and re.fullmatch("Господин [А-Я][а-я]+", s[12])
    assert pii.Surrogates("k").number("a", 20) != pii.Surrogates("other").number("a", 20)


def test_others_stay(spark):
    got = run(spark, PLAIN)
    assert [got[i].text for i in range(len(PLAIN))] == PLAIN and all(r.n_entities == 0 for r in got.values())
    assert run(spark, []) == {}


def test_like_replacement_in_python(spark):
    rng = random.Random(3)
    parts = re.findall(r"\S+@\S+|\+1 \(017\) 555-7713|\d{16}", TEXT) + ["word", "and 12", "\n"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(30)]
    for i, r in run(spark, texts).items():
        want, at = "", 0
        for f in r.found:
            k = texts[i].index(f.text, at)
            want, at = want + texts[i][at:k] + f.surrogate, k + len(f.text)
        assert r.text == want + texts[i][at:]


def test_bijections(spark):
    make = pii.Surrogates("key")
    ids = spark.range(5000)
    numbers = ids.select(F.lpad((F.col("id") * 7919 % 10**6).cast("string"), 6, "0").alias("x")).distinct()
    assert numbers.select(make.digits("card", F.col("x")).alias("y")).where("length(y) = 6").distinct().count() == numbers.count()
    ips = ids.select(F.concat_ws(".", *((F.col("id") * m % 256).cast("string") for m in (3, 5, 7, 11))).alias("x")).distinct()
    assert ips.select(make.address(F.col("x")).alias("y")).distinct().count() == ips.count()


def test_collisions_are_resolved(spark):
    texts = [f"user{i}@a{i}.example.com and user{i + 1}@a{i + 1}.example.com" for i in range(12)]
    got = run(spark, texts, digest_chars=1)
    pairs = {(f.text, f.surrogate) for r in got.values() for f in r.found}
    assert len(pairs) == 13 and len({s for _, s in pairs}) == 13


def test_stage_form(spark):
    df = spark.createDataFrame([(1, TEXT, "__found"), (1, TEXT, "__found"), (None, None, None)], "doc_id bigint, text string, extra string")
    out = pii.replace(df, "key")
    assert out.columns == df.columns and out.count() == 3 and out.where(F.contains("text", F.lit("Ann.Lee7"))).count() == 0


def test_upper_case_secrets_and_international_phones(spark):
    secret = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"
    phones = ["+44 20 7946 0958", "+33 1 23 45 67 89", "+49 (30) 123456", "+442079460958"]
    got = run(spark, [f'TOKEN = "{secret}"!! and {secret.lower()}, {secret[:20]}{secret[20:].lower()}', *(f"Call {p}, please." for p in phones), "1+2 is 3, +12 345 stays"])
    upper, lower, mixed = (f.surrogate for f in got[0].found)
    assert [f.kind for f in got[0].found] == ["secret"] * 3 and secret not in got[0].text
    assert re.fullmatch("[0-9A-F]{40}", upper) and upper.lower() == lower == mixed
    for k, p in enumerate(phones, 1):
        (f,) = got[k].found
        assert f.kind == "phone" and f.text == p != f.surrogate and re.sub(r"\d", "0", p) == re.sub(r"\d", "0", f.surrogate)
        assert got[k].text == f"Call {f.surrogate}, please."
    assert re.sub(r"\D", "", got[1].found[0].surrogate) == re.sub(r"\D", "", got[4].found[0].surrogate)
    assert got[5].n_entities == 0


def test_planted_upper_case_tokens(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id = 2514").select("text").collect()
    tokens = [t for r in rows for t in re.findall("(?<![A-Za-z0-9])[0-9A-F]{32,}(?![A-Za-z0-9])", r.text)]
    assert tokens and all(t not in r.text for r in run(spark, [r.text for r in rows]).values() for t in tokens)


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def iban_right(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class Plain:
    """Surrogates computed in plain Python."""

    def __init__(self, key):
        self.key = key

    def sha(self, *parts):
        return hashlib.sha256(":".join((self.key, *parts)).encode()).hexdigest()

    def number(self, what, bits):
        return int(self.sha(what), 16) % 2**bits

    def digits(self, what, x):
        n = len(x)
        for r in range(2):
            a, b = self.number(f"{what}{r}a", 55) // 10 * 10 + (3, 7)[r], self.number(f"{what}{r}b", 55)
            x = str((int(x) * a + b) % 10**n).zfill(n)
            x = x[::-1] if r == 0 else x
        return x

    def bits(self, what, x, n):
        for r in range(2):
            x = (x * (self.number(f"{what}{r}a", n - 2) | 1) + self.number(f"{what}{r}b", n - 1)) % 2**n
            x = (x >> n // 2) + (x % 2 ** (n // 2) << n // 2) if r == 0 else x
        return x

    def over(self, e, fresh):
        out, left = [], list(fresh)
        for c in reversed(e):
            out.append(left.pop() if c.isdigit() and left else c)
        return "".join(reversed(out))

    def make(self, kind, e):
        raw = re.sub(r"\D", "", e)
        if kind == "email":
            local, domain = e.lower().rsplit("@", 1)
            letters = "авмнилекотрсуядг" if re.search("[а-я]", local) else "abdefgiklmnorstu"
            h = self.sha("entity", "0", "email", e.lower())[:20]
            return "".join(letters[int(c, 16)] for c in h) + "@" + self.sha("domain", "0", domain)[:20] + ".example"
        if kind == "ip":
            a, b, c, d = map(int, e.split("."))
            low = c * 256 + d
            if a == 172 and 16 <= b <= 31:
                x = self.bits("ip20", (b - 16) * 65536 + low, 20) + 16 * 65536
            elif a in (100, 169, 172, 192, 198, 203):
                x = b * 65536 + self.bits("ip16", low, 16)
            else:
                x = self.bits("ip24", b * 65536 + low, 24)
            public = [k for k in range(1, 224) if k not in (10, 100, 127, 169, 172, 192, 198, 203)]
            a = dict(zip(public, sorted(public, key=lambda k: self.number(f"ip{k}", 256)))).get(a, a)
            return f"{a}.{x >> 16}.{x >> 8 & 255}.{x & 255}"
        if kind == "phone":
            return self.over(e, self.digits("phone", raw[-10:]))
        if kind == "ssn":
            return self.over(e, self.digits("ssn", raw))
        if kind == "card":
            body = raw[0] + self.digits("card", raw[1:-1])
            off = lambda d: next(k for k in range(10) if luhn(d[:-1] + str((int(d[-1]) + k) % 10)))
            return self.over(e, next(body + str(k) for k in range(10) if off(body + str(k)) == off(raw))[1:])
        if kind == "secret":
            h = (self.sha("entity", "0", "secret", e.lower()) + self.sha("more", "0", e.lower())) * 9
            return h[: len(e)].upper() if re.search("[A-F]", e) and not re.search("[a-f]", e) else h[: len(e)]
        if kind == "iban":
            plain = e.replace(" ", "")
            h = self.sha("entity", "0", "iban", plain)
            body = "".join(str(int(h[k], 16) % 10) if c.isdigit() else "ABDEFGIKLMNORSTU"[int(h[k], 16)] for k, c in enumerate(plain[4:]))
            new = next(f"{plain[:2]}{k:02}{body}" for k in range(2, 99) if iban_right(f"{plain[:2]}{k:02}{body}"))
            left = list(new[::-1])
            return "".join(c if c == " " else left.pop() for c in e)

    def stem(self, w):
        letters = "авмнилекотрсуядг" if re.search("[а-я]", w) else "αβδεγικλμνορστυφ" if re.search("[α-ω]", w) else "abdefgiklmnorstu"
        return "".join(letters[int(c, 16)] for c in self.sha("name", "0", w)[:12]).capitalize()


def test_every_surrogate_like_plain_python(spark):
    plain, rng = Plain("key"), random.Random(41)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = []
    for _ in range(60):
        card = number(15)
        card += next(str(k) for k in range(10) if luhn(card + str(k))) if rng.random() < 0.5 else number(1)
        ip = rng.choice(["10.{}.{}.{}", "172.20.{}.{}", "172.8.{}.{}", "192.168.{}.{}", "127.0.{}.{}", "8.{}.{}.{}", "77.{}.{}.{}", "169.254.{}.{}", "230.1.{}.{}", "203.0.{}.{}"]).format(*(rng.randrange(256) for _ in range(3)))
        some = [
            f"user{number(3)}@mail{number(1)}.example.com", f"иван{number(2)}@почта.mail.ru"[: 6] + "@mail.example.ru", ip, f"+1 ({number(3)}) 555-{number(4)}", f"+44 20 {number(4)} {number(4)}", f"+4420{number(8)}",
            f"{number(3)}-{number(2)}-{number(4)}", card, f"{card[:4]} {card[4:8]} {card[8:12]} {card[12:]}", hashlib.sha1(number(5).encode()).hexdigest(), hashlib.sha256(number(5).encode()).hexdigest().upper(),
            f"DE{number(2)} {number(4)} {number(4)} {number(4)} {number(4)} {number(2)}", f"GB{number(2)}NWBK{number(14)}",
        ]
        texts.append("; ".join(rng.sample(some, 6)))
    networks = ("10.", "127.", "192.168.", "169.254.")
    seen = {}
    for i, r in run(spark, texts).items():
        assert len(r.found) == 6, (texts[i], r.found)
        want = texts[i]
        for f in r.found:
            assert f.surrogate == plain.make(f.kind, f.text), f
            want = want.replace(f.text, f.surrogate, 1)
            if f.kind == "card":
                digits = re.sub(r"\D", "", f.text), re.sub(r"\D", "", f.surrogate)
                assert luhn(digits[0]) == luhn(digits[1])
            elif f.kind == "iban":
                assert iban_right(f.surrogate)
            elif f.kind == "ip":
                assert [f.text.startswith(x) for x in networks] == [f.surrogate.startswith(x) for x in networks]
            if f.kind in ("ip", "card", "ssn"):
                canon = re.sub(r"[ -]", "", f.text)
                assert seen.setdefault((f.kind, re.sub(r"[ -]", "", f.surrogate)), canon) == canon
        assert r.text == want


def test_names_wherever_they_stand(spark):
    texts = [
        "Frau Anna Schmidt came. Anna Schmidt left. Dr. Anna Schmidt too, and Schmidt said Annas Schmidtchen is Anna's.",
        "Mr Lee met Mrs\u00a0Mary\u00a0Lee; Lee or Mary went. Anna stays.", "Prof. Dr. Karl Weber. Weber!", "Господин Иван Петров и Петров. Κυρία Ελένη.", "Herr Professor spoke.", "No title for Anna Schmidt.",
    ]
    stem = Plain("key").stem
    a, s = stem("Anna") + "a", stem("Schmidt") + "a"
    lee, mary, w = stem("Lee"), stem("Mary"), stem("Weber") + "e"
    petrov = stem("Петров") + "ин"
    want = [
        f"Frau {a} {s} came. {a} {s} left. Dr. {a} {s} too, and {s} said Annas Schmidtchen is {a}'s.",
        f"Mr {lee}o met Mrs\u00a0{mary}a\u00a0{lee}a; {lee}o or {mary}a went. Anna stays.", f"Prof. Dr. {stem('Karl')}e {w}. {w}!", f"Господин {stem('Иван')}ин {petrov} и {petrov}. Κυρία {stem('Ελένη')}α.", f"Herr {stem('Professor')}o spoke.", texts[5],
    ]
    got = run(spark, texts)
    assert [got[i].text for i in range(len(texts))] == want
    assert [got[i].n_entities for i in range(len(texts))] == [5, 4, 2, 3, 1, 0]


def test_collisions_in_many_texts(spark):
    """So few letters that most words and addresses meet: still one surrogate for each and each for one, in every text."""
    texts = [f"Mr {chr(65 + i % 7)}x{'yzw'[i % 3]} wrote to u{i % 11}@a.example.com and Herr {chr(65 + i % 5)}xy" for i in range(300)] + ["nothing here"] * 50 + [None] * 3
    got = run(spark, texts, digest_chars=2)
    to, back = {}, {}
    for r in got.values():
        for f in r.found or []:
            for x, y in zip(f.text.split(" ")[f.kind == "name" :], f.surrogate.split(" ")[f.kind == "name" :]):
                y = y.split("@")[0] if f.kind == "email" else y[:2]
                assert to.setdefault((f.kind, x), y) == y and back.setdefault((f.kind, y), x) == x
    assert len(to) > 20 and all(got[i].text == texts[i] for i in range(300, 353))


def test_names_that_the_operator_uses(spark):
    df = spark.createDataFrame([(1, TEXT), (2, None)], "doc_id bigint, text string").withColumns({c: F.lit(c) for c in ("plain", "e", "found", "people", "digest", "moved", "__e", "__found", "__moved", "c0_", "c1_")})
    out = pii.replace(df, "key")
    assert out.columns == df.columns and out.where("e = 'e' and c1_ = 'c1_' and moved = 'moved'").count() == 2
