"""Surrogates for personal data.

Detected entities (e-mail addresses, phone numbers, IP addresses, payment cards, social
security numbers, accounts, and persons named with a title or a known first name) are replaced
by keyed stand-ins of the same kind and format: digits stay digits, letters letters, cases,
separators and lengths stay, card and account numbers with right check digits get right ones,
private networks stay private, a domain has one stand-in everywhere, so has every word of a name
("Mr Keller", "Hans Keller"), and a first name's stand-in has its gender and script.

A stand-in is a function of key, kind and the entity's plain form, so mentions of one entity
agree in all documents and deliveries with the same key, without any table (coreference).
A check over all distinct units (entities, domains, words of names) draws again where two got
the same stand-in or a stand-in stands in the corpus itself, until none is left (distinctness).
Only these redrawn units ever need a look-up; theirs is the one stand-in that depends on the corpus.

Null text stays null; empty texts and texts without entities are unchanged and never shuffle.
Repeated rows are replaced alike. A column called like the count is replaced; an empty table gives
an empty result. DataFrame functions only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.llm.common import join_groups, text_of
from featloom.session import cut_lineage

KINDS = ("email", "ip", "iban", "card", "ssn", "phone", "person")

#: Titles by gender, and common first names by script and gender; these are the pools too.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "госпожа"],
          "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "господин"],
          "n": ["Dr", "Prof"]}
FIRST_NAMES = {
    "latin": {"f": ["Mary", "Anna", "Laura", "Julia", "Sophie", "Emma", "Maria", "Lucia", "Claire", "Helen", "Alice", "Sarah"],
              "m": ["John", "Peter", "Thomas", "Michael", "David", "Paul", "James", "Carlos", "Pierre", "Hans", "Robert", "William"],
              "n": ["Robin", "Kim", "Sascha", "Alex", "Dominique", "Noa", "Jamie", "Toni"]},
    "cyrillic": {"f": ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина"],
                 "m": ["Иван", "Пётр", "Алексей", "Дмитрий", "Сергей", "Николай"],
                 "n": ["Саша", "Женя", "Валя"]},
}
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу"}
CONSONANTS = {"latin": "bcdfghklmnprstvz", "cyrillic": "бвгдзклмнпрст"}

_titles = "|".join(x for ts in TITLES.values() for t in ts for x in (t, t.upper()))
_firsts = "|".join(x for s in FIRST_NAMES.values() for g in s.values() for n in g for x in (n, n.upper()))
_word = "\\p{Lu}\\p{L}+"
#: Names start a word, with one of these; one class test rules out almost every other place.
_start = "(?<![\\p{L}\\d])(?=[" + "".join(sorted({n[0] for n in (_titles + "|" + _firsts).split("|")})) + "])"
PATTERNS = {
    "email": "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\\.[A-Za-z0-9-]{1,63}+){1,6}",
    "ip": "(?<![\\d.])\\d{1,3}(?:\\.\\d{1,3}){3}(?!\\d|\\.\\d)",
    "iban": "(?<![A-Za-z0-9])[A-Z]{2}\\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": "(?<![\\d+.-])(?:\\d{4}(?:[ -]\\d{4}){3}|\\d{4} \\d{6} \\d{5}|\\d{13,19})(?![\\d])",
    "ssn": "(?<![\\d-])\\d{3}-\\d{2}-\\d{4}(?![\\d-])",
    "phone": "(?<![\\d+])(?:\\+\\d{1,3}[ .-]?(?:\\(\\d{1,4}\\)[ .-]?)?\\d{2,4}(?:[ .-]?\\d{2,4}){1,4}|\\(\\d{3}\\) ?\\d{3}-\\d{4}|\\d{3}-\\d{3}-\\d{4})(?!\\d)",
    "person": f"{_start}(?:(?:{_titles})\\.? {_word}(?: {_word}){{0,2}}|(?:{_firsts}) {_word}(?: {_word})?)(?!\\p{{L}})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these has no entity; quicker than the full pattern.
QUICK = f"[@]|\\d{{3}}|\\d\\.\\d|{_start}(?:(?:{_titles})\\.? \\p{{Lu}}|(?:{_firsts}) \\p{{Lu}})"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def mentions(text: Column) -> Column:
    """All entities of a text in order, as they stand there."""
    none = F.array().cast("array<string>")
    return F.when(text.rlike(QUICK), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none)


def kind_of(mention: Column) -> Column:
    out = F.when(mention.contains("@"), "email")
    for kind in ("ip", "ssn", "iban", "card", "phone"):
        out = out.when(mention.rlike(f"^(?:{PATTERNS[kind]})$"), kind)
    return out.otherwise("person")


def script_of(name: Column) -> Column:
    return F.when(name.rlike("\\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def _name_part(mention: Column) -> Column:
    return F.regexp_replace(mention, f"^(?:{_titles})\\.? ", "")


def plain_form(kind: Column, mention: Column) -> Column:
    """What mentions of one entity have in common: no separators, no case."""
    return (F.when(kind == "email", F.lower(mention))
            .when(kind == "ip", mention)
            .when(kind == "person", F.lower(_name_part(mention)))
            .otherwise(F.upper(F.regexp_replace(mention, "[^A-Za-z0-9+]", ""))))


class Drawer:
    """Keyed stand-ins as column expressions."""

    def __init__(self, key: str):
        self.key = key

    def stream(self, kind: Column, plain: Column, attempt: Column) -> Column:
        """Two hexadecimal digits per character and some to spare."""
        base = F.concat_ws("|", F.lit(self.key), kind, attempt.cast("string"), plain)
        return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(plain) / 48).cast("int")),
                                        lambda b: F.sha2(F.concat(base, F.lit("|"), b.cast("string")).cast("binary"), 512)), "")

    @staticmethod
    def value(stream: Column, i: Column) -> Column:
        return F.conv(F.substring(stream, i * 2 + 1, F.lit(2)), 16, 10).cast("int")

    def shaped(self, plain: Column, stream: Column) -> Column:
        """Digits for digits, letters for letters; a group's first digit stays different from zero."""
        def one(c: Column, i: Column) -> Column:
            v = self.value(stream, i)
            first = (i == 0) | ~F.rlike(F.substring(plain, i, F.lit(1)), F.lit("[0-9]"))
            return (F.when(F.rlike(c, F.lit("[1-9]")) & first, (v % 9 + 1).cast("string"))
                    .when(F.rlike(c, F.lit("[0-9]")), (v % 10).cast("string"))
                    .when(F.rlike(c, F.lit("[a-z]")), F.char(v % 26 + 97))
                    .when(F.rlike(c, F.lit("[A-Z]")), F.char(v % 26 + 65)).otherwise(c))

        return F.array_join(F.transform(F.split(plain, ""), one), "")

    def luhn(self, digits: Column) -> Column:
        """The sum that is a multiple of ten for right card numbers."""
        def weigh(c: Column, i: Column) -> Column:
            n = c.cast("int") * (i % 2 + 1)
            return F.when(n > 9, n - 9).otherwise(n)

        return F.aggregate(F.transform(F.split(F.reverse(digits), ""), weigh), F.lit(0), lambda a, b: a + b)

    def domain(self, plain: Column, stream: Column, more: Column) -> Column:
        """Other labels, the same top level; ``more`` makes the last label longer."""
        return F.concat(self.shaped(F.regexp_replace(plain, "\\.[^.]*$", ""), stream), more, F.lit("."), F.substring_index(plain, ".", -1))

    def ip(self, plain: Column, stream: Column, attempt: Column) -> Column:
        octet = lambda i: (self.value(stream, F.lit(i)) % 254 + 1).cast("string")
        head = (F.when(plain.startswith("10."), F.concat(F.lit("10."), octet(1)))
                .when(plain.startswith("192.168."), F.when(attempt > 8, F.concat(F.lit("10."), octet(1))).otherwise("192.168"))
                .when(plain.startswith("127."), F.concat(F.lit("127."), octet(1)))
                .otherwise(F.concat((self.value(stream, F.lit(0)) % 100 + 11).cast("string"), F.lit("."), octet(1))))
        return F.concat_ws(".", head, octet(2), octet(3))

    def card(self, plain: Column, stream: Column) -> Column:
        def whole(drawn: Column) -> Column:
            body = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
            check = ((10 - self.luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
            return F.when(self.luhn(plain) % 10 == 0, F.concat(body, check)).otherwise(drawn)

        return let(F.concat(F.substring(plain, 1, 1), F.substring(self.shaped(plain, stream), 2, 32)), whole)

    def phone(self, plain: Column, stream: Column) -> Column:
        """The country's first digit stays."""
        return F.when(plain.startswith("+"), F.concat(F.substring(plain, 1, 2), F.substring(self.shaped(plain, stream), 3, 32))).otherwise(
            self.shaped(plain, stream))

    @staticmethod
    def mod97(code: Column) -> Column:
        """The remainder that is one for right account numbers."""
        def put(state: Column, c: Column) -> Column:
            return F.when(c == "", state).when(F.rlike(c, F.lit("[0-9]")), (state * 10 + c.cast("int")) % 97).otherwise(
                (state * 100 + F.ascii(c) - 55) % 97)

        turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, F.lit(1), F.lit(4)))
        return F.aggregate(F.split(turned, ""), F.lit(0), put)

    def iban(self, plain: Column, stream: Column) -> Column:
        """The country stays; right check digits become right ones."""
        def whole(drawn: Column) -> Column:
            country, rest = F.substring(drawn, F.lit(1), F.lit(2)), F.substring(drawn, F.lit(5), F.length(drawn))
            check = F.lpad((98 - self.mod97(F.concat(country, F.lit("00"), rest))).cast("string"), 2, "0")
            return F.when(self.mod97(plain) == 1, F.concat(country, check, rest)).otherwise(drawn)

        return let(F.concat(F.substring(plain, 1, 2), F.substring(self.shaped(plain, stream), 3, 64)), whole)

    def first_names(self) -> Column:
        """Stand-ins of the known first names: the names of a script and gender turned by a keyed number of places.

        No name stays, and no two names get the same one.
        """
        out = {}
        for script, genders in FIRST_NAMES.items():
            for gender, names in genders.items():
                turn = 1 + int.from_bytes(hashlib.sha256(f"{self.key}|{script}|{gender}".encode()).digest()[:8]) % (len(names) - 1)
                out |= {n.lower(): names[(i + turn) % len(names)] for i, n in enumerate(names)}
        return F.create_map(*[F.lit(x) for pair in out.items() for x in pair])

    def word(self, word: Column, stream: Column, more: Column) -> Column:
        """A name from syllables of the script."""
        script = script_of(word)

        def letter(j: Column) -> Column:
            w = self.value(stream, j + 8)
            pick = lambda letters: F.substring(F.lit(letters), w % len(letters) + 1, F.lit(1))
            return F.when(j % 2 == 1, F.when(script == "latin", pick(VOWELS["latin"])).otherwise(pick(VOWELS["cyrillic"]))).otherwise(
                F.when(script == "latin", pick(CONSONANTS["latin"])).otherwise(pick(CONSONANTS["cyrillic"])))

        made = F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(3), F.least(F.lit(7), F.length(word) - 1))), letter), "")
        tail = F.when(script == "latin", F.translate(more, "0123456789", "aeiounrlst")).otherwise(F.translate(more, "0123456789", "аеиоунрлст"))
        return F.initcap(F.concat(made, tail))

    def draw(self, kind: Column, plain: Column, attempt: Column) -> Column:
        """The stand-in of one unit (see ``units``)."""
        return let(self.stream(kind, plain, attempt), lambda stream: self._draw(kind, plain, attempt, stream))

    def _draw(self, kind: Column, plain: Column, attempt: Column, stream: Column) -> Column:
        # From the ninth attempt on names and labels get longer, and private networks move to the largest one;
        # numbers keep their length, as their formats have room for millions.
        more = F.when(attempt > 8, F.substring(F.conv(F.substring(stream, 1, 12), 16, 10), F.lit(1), attempt - 7)).otherwise("")
        return (F.when(kind == "email", F.concat(self.shaped(F.substring_index(plain, "@", 1), stream), more))
                .when(kind == "domain", self.domain(plain, stream, more))
                .when(kind == "person", self.word(plain, stream, more))
                .when(kind == "ip", self.ip(plain, stream, attempt))
                .when(kind == "card", self.card(plain, stream))
                .when(kind == "phone", self.phone(plain, stream))
                .when(kind == "iban", self.iban(plain, stream))
                .otherwise(self.shaped(plain, stream)))

    def whole(self, kind: Column, plain: Column, attempt_of: Callable[[Column, Column], Column]) -> Column:
        """The stand-in of an entity, put together from those of its units."""
        unit = lambda k, p: self.draw(k, p, attempt_of(k, p))
        domain, words = F.substring_index(plain, "@", -1), F.split(plain, " ")
        named = F.transform(words, lambda w, i: F.coalesce(
            F.when((i == 0) & (F.size(words) > 1), F.try_element_at(self.first_names(), w)), unit(F.lit("person"), w)))
        return (F.when(kind == "email", F.concat(unit(F.lit("email"), plain), F.lit("@"), unit(F.lit("domain"), domain)))
                .when(kind == "person", F.array_join(named, " ")).otherwise(unit(kind, plain)))

    def fit(self, kind: Column, mention: Column, drawn: Column) -> Column:
        """The stand-in in the format of one mention."""
        name = _name_part(mention)
        title = F.substring(mention, F.lit(1), F.length(mention) - F.length(name))
        fill = lambda own, new: let(F.regexp_replace(new, "[^A-Za-z0-9]", ""), lambda slots: self._fill(own, slots))
        local = lambda mail: F.substring_index(mail, "@", 1)
        labels = lambda mail: F.regexp_replace(F.substring_index(mail, "@", -1), "\\.[^.]*$", "")
        return F.when(kind == "ip", drawn).when(
            kind == "person", F.concat(title, let(drawn, lambda d: F.when(name == F.upper(name), F.upper(d)).otherwise(d)))).when(
            kind == "email", let(drawn, lambda d: F.concat(
                fill(local(mention), local(d)), F.lit("@"), fill(labels(mention), labels(d)), F.lit("."), F.substring_index(mention, ".", -1)))).otherwise(
            fill(mention, drawn))

    @staticmethod
    def _fill(mention: Column, slots: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

        def put(state: Column, c: Column) -> Column:
            new = F.substring(slots, state["k"], F.lit(1))
            cased = F.when(F.rlike(c, F.lit("[A-Z]")), F.upper(new)).when(F.rlike(c, F.lit("[a-z]")), F.lower(new)).otherwise(new)
            slot = F.rlike(c, F.lit("[A-Za-z0-9]"))
            return F.struct(F.concat(state["out"], F.when(slot, cased).otherwise(c)).alias("out"),
                            (state["k"] + F.when(slot, 1).otherwise(0)).alias("k"))

        return F.aggregate(F.split(mention, ""), start, put, lambda s: F.concat(s["out"], F.substring(slots, s["k"], F.lit(64))))


def units(kind: Column, plain: Column) -> Column:
    """What gets a stand-in of its own: a mail address in its domain, the domain, every word of a name
    but a known first name, and other entities as a whole; ``array<struct<kind, plain>>``."""
    unit = lambda k, p: F.struct(k.alias("kind"), p.alias("plain"))
    words = F.split(plain, " ")
    known = F.array(*[F.lit(n.lower()) for s in FIRST_NAMES.values() for g in s.values() for n in g])
    rest = F.when((F.size(words) > 1) & F.array_contains(known, words[0]), F.slice(words, F.lit(2), F.size(words))).otherwise(words)
    return (F.when(kind == "email", F.array(unit(kind, plain), unit(F.lit("domain"), F.substring_index(plain, "@", -1))))
            .when(kind == "person", F.transform(rest, lambda w: unit(F.lit("person"), w))).otherwise(F.array(unit(kind, plain))))


def mark_of(text_col: str) -> Column:
    """Alike texts have the same."""
    return F.struct(F.xxhash64(text_col), F.xxhash64(F.lit(1), F.col(text_col)))


def held_units(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct (__mark, kind, plain) of all texts, found in one scan; copies are dropped before anything shuffles."""
    found = docs.select(mark_of(text_col).alias("__mark"), F.array_distinct(mentions(text_of(text_col))).alias("m")).where(F.size("m") > 0)
    every = F.flatten(F.transform("m", lambda m: let(kind_of(m), lambda k: units(k, plain_form(k, m)))))
    return found.select("__mark", F.inline(F.array_distinct(every))).distinct()


def redrawn(held: DataFrame, key: str) -> DataFrame:
    """(kind, plain, attempt) of the held units whose first stand-in isn't theirs alone."""
    drawer = Drawer(key)
    every = cut_lineage(held.select("kind", "plain").distinct())
    # Addresses are told apart inside their domain: no stand-in of a domain is a domain of the corpus.
    scope = F.when(F.col("kind") == "email", F.substring_index("plain", "@", -1)).otherwise("").alias("scope")
    real = every.where("kind != 'email'").select(
        "kind", F.lit("").alias("scope"), F.when(F.col("kind") == "person", F.initcap("plain")).otherwise(F.col("plain")).alias("drawn"))
    pending, accepted, attempt = every, None, 0
    while True:
        drawn = pending.select("kind", "plain", scope, drawer.draw(F.col("kind"), F.col("plain"), F.lit(attempt)).alias("drawn"))
        # An address's own local part would be no stand-in.
        drawn = drawn.where(~((F.col("kind") == "email") & (F.col("drawn") == F.substring_index("plain", "@", 1))))
        taken = real if accepted is None else real.unionByName(accepted.select("kind", "scope", "drawn"))
        first = drawn.join(taken, ["kind", "scope", "drawn"], "left_anti").groupBy("kind", "scope", "drawn").agg(F.min("plain").alias("plain"))
        good = first.select("kind", "plain", F.lit(attempt).alias("attempt"), "scope", "drawn")
        accepted = cut_lineage(good if accepted is None else accepted.unionByName(good))
        pending = cut_lineage(pending.join(accepted, ["kind", "plain"], "left_anti"))
        if pending.isEmpty():
            return accepted.where(F.col("attempt") > 0).select("kind", "plain", "attempt")
        attempt += 1


def replace_entities(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_entities") -> DataFrame:
    """``docs`` with stand-ins in the text and the number of entities replaced."""
    drawer = Drawer(key)
    held = cut_lineage(held_units(docs, text_col))
    again = cut_lineage(redrawn(held, key))
    frame = docs.withColumn("__m", mentions(text_of(text_col))).withColumn("__kinds", F.transform("__m", kind_of)).withColumn(
        "__plain", F.zip_with("__kinds", "__m", plain_form))
    if again.isEmpty():
        frame = frame.withColumn("__again", F.lit(None).cast("map<string,int>"))
    else:
        # Texts that mention a redrawn entity, by the hash of the text: alike texts get the same.
        sized = again.withColumn("__n", F.lit(1).cast("long"))
        texts = (join_groups(held, sized, ["kind", "plain"], "__n").groupBy("__mark")
                 .agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(":", "kind", "plain"), "attempt"))).alias("__again")))
        # Rows without an entity stay out of the join.
        bare = frame.where(F.size("__m") == 0).withColumn("__again", F.lit(None).cast("map<string,int>"))
        frame = frame.where(F.size("__m") > 0).withColumn("__mark", mark_of(text_col)).join(texts, "__mark", "left").drop("__mark").unionByName(bare)

    def one(i: Column) -> Column:
        kind, mention, plain = F.get("__kinds", i), F.get("__m", i), F.get("__plain", i)
        attempt_of = lambda k, p: F.coalesce(F.try_element_at(F.col("__again"), F.concat_ws(":", k, p)), F.lit(0))
        return drawer.fit(kind, mention, drawer.whole(kind, plain, attempt_of))

    between = F.split(F.col(text_col), ANY, -1)
    new = F.concat(F.array_join(F.zip_with(F.slice(between, 1, F.size("__m")),
                                           F.transform(F.sequence(F.lit(0), F.size("__m") - 1), one), lambda a, b: F.concat(a, b)), ""),
                   F.element_at(between, -1))
    replaced = F.when(F.size("__m") > 0, new).otherwise(F.col(text_col))
    kept = [c for c in docs.columns if c != count_col]
    return frame.select(*[replaced.alias(c) if c == text_col else F.col(c) for c in kept], F.size("__m").cast("long").alias(count_col))
