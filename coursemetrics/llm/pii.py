"""PII surrogates: detected entities get keyed, type-consistent replacements. DataFrame functions only.

An entity is a type and a normal form; its surrogate is a function of the key, both of them and an attempt
number, so the same entity is replaced alike everywhere (coreference) without any lookup. Surrogates keep
the format: digits stay digits, letters letters of the same case, separators stay, octets keep their number
of digits, card numbers their issuer digit and check digit; names keep gender and script. The collision check
gathers the distinct entities, finds surrogates that two entities share or that are themselves an entity
of the input, and gives all but one of them the next attempt until none is left (distinctness). A format can
have less room than entities (one-letter mailboxes of one domain); from attempt WIDE_FROM on a surrogate is
longer than its format: more letters, syllables or digits from the digest, octets of any width. Only
entities with a later attempt are joined to the texts that hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursemetrics.llm.common import stored

MAX_ATTEMPTS = 40
WIDE_FROM = 24

# Given names by gender, and titles.
FEMALE = ("Mary", "Maria", "Anna", "Emma", "Laura", "Julia", "Sophie", "Claire", "Camille", "Sarah", "Elena", "Carmen", "Lucía", "Petra", "Sabine",
          "Ursula", "Jennifer", "Linda", "Elizabeth", "Susan", "Мария", "Анна", "Елена", "Ольга", "Наталья", "Μαρία", "Ελένη")
MALE = ("James", "John", "Robert", "Michael", "William", "David", "Thomas", "Peter", "Hans", "Jürgen", "Klaus", "Pierre", "Jean", "Louis", "Carlos",
        "José", "Juan", "Miguel", "Paul", "George", "Иван", "Алексей", "Дмитрий", "Сергей", "Николай", "Γιώργος", "Νίκος")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа")
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н")
PLAIN_TITLES = ("Dr", "Prof")
# Syllables of made-up names, and the endings of given names by gender, by script.
SYLLABLES = {
    "latin": "ba de fi ga ho ju ka lo mi ne pa ri so ta vo ze".split(),
    "cyrillic": "ба де фи га хо жу ка ло ми не па ри со та во зе".split(),
    "greek": "βα δε φι γα χο ζου κα λο μι νε πα ρι σο τα πο ξε".split(),
}
ENDINGS = {
    "latin": {"f": "na la ra ya".split(), "m": "n l rt s".split(), "x": "r m t k".split()},
    "cyrillic": {"f": "на ла ра я".split(), "m": "н л рт с".split(), "x": "р м т к".split()},
    "greek": {"f": "να λα ρα θη".split(), "m": "νος λος ρος της".split(), "x": "ς ν ρ ξ".split()},
}

WORD = r"[\p{L}\p{N}_]"
NAME = r"\p{Lu}[\p{L}'’-]*\p{L}"
TITLES = "|".join(sorted((*FEMALE_TITLES, *MALE_TITLES, *PLAIN_TITLES), key=len, reverse=True))
GIVEN = "|".join((*FEMALE, *MALE))
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = rf"(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}._%+-]*+@[\p{{L}}\p{{N}}-]+(?:\.[\p{{L}}\p{{N}}-]+)*\.\p{{L}}{{2,}}"
SECRET = rf"(?=[A-Za-z_-]{{0,128}}\d)(?:[0-9a-f]{{32,128}}|[0-9A-F]{{32,128}}|AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{36}}|sk-[A-Za-z0-9]{{20,64}})(?!{WORD})"
IBAN = rf"[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?!{WORD})"
CARD = rf"(?<!\d[.-])(?:\d{{4}}([ -]?)\d{{4}}\1\d{{4}}\1\d{{4}}|\d{{4}}([ -]?)\d{{6}}\2\d{{5}})(?![.-]?\d)(?!{WORD})"
SSN = rf"(?<!-)\d{{3}}-\d{{2}}-\d{{4}}(?!{WORD})(?!-)"
PHONE = (r"(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]\d{2,4}(?!\d)){1,4}|\+\d{8,15}"
         r"|\(\d{3}\)[ .-]?\d{3}[.-]\d{4}|\d{3}-\d{3}-\d{4}"
         # With dots or spaces only numbers of the North American plan that are no part of a longer one.
         rf"|(?<!\d[ .,-])[2-9]\d{{2}}(?<gap>[ .])[2-9]\d{{2}}\k<gap>\d{{4}}(?![ .,-]?\d))(?!{WORD})")
IP = rf"(?<!\d\.)(?:{OCTET}\.){{3}}{OCTET}(?!{WORD})(?!\.\d)"
HEXTET = "[0-9A-Fa-f]{1,4}"
IP6 = (rf"(?<!:)(?={HEXTET}:)(?=[A-Fa-f:]{{0,39}}\d)(?:(?:{HEXTET}:){{7}}{HEXTET}|(?:{HEXTET}:){{2,6}}(?::{HEXTET}){{1,5}}|[Ff][Ee]80:(?::{HEXTET}){{1,4}})"
       rf"(?!{WORD})(?!:)")
PERSON = rf"(?<!\p{{L}})(?:(?:{TITLES})\.? (?:{NAME} )?{NAME}|(?:{GIVEN}) {NAME})(?!\p{{L}})"
# The card pattern's two groups are the first ones of the whole. Only a sign that can begin a numbered entity is looked at closely.
NUMBERED = rf"(?=[0-9A-Za-z+(])(?<!{WORD})(?:{SECRET}|{IBAN}|{CARD}|{IP}|{IP6}|{SSN}|{PHONE})"
ANY = f"{EMAIL}|{NUMBERED}|{PERSON}"
#: A quick look that every entity passes: each has an @, a digit, or the beginning of a name.
HINT = rf"[0-9@]|(?=[\p{{Lu}}])(?:{TITLES}|{GIVEN})[. ]"


def _lit(x) -> Column:
    return F.lit(x)


def _digest(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """128 hex digits that only the key holder can compute."""
    return F.sha2(F.concat_ws("\x1f", _lit(key), kind, norm, attempt.cast("string"), _lit(key)), 512)


def _nibble(digest: Column, at) -> Column:
    return F.conv(F.substr(digest, (F.lit(at) if isinstance(at, int) else at) % 126 + 1, F.lit(2)), 16, 10).cast("int")


def _luhn_sum(digits: Column, double_from: int) -> Column:
    """Sum of a string of digits with every second one doubled, counted from the right; the last is doubled if double_from is 0."""
    numbers = F.transform(F.reverse(F.split(digits, "")), lambda x, i: F.when((i + double_from) % 2 == 0, x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)).otherwise(x.cast("int")))
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def is_card(value: Column) -> Column:
    digits = F.regexp_replace(value, "[ -]", "")
    return digits.rlike("^(4|5[1-5]|2[2-7]|3[47]|6)") & (_luhn_sum(digits, 1) % 10 == 0)


def _rest_97(plain: Column) -> Column:
    """Remainder by 97 of an account number with its first four characters moved to the end, letters as 10 to 35."""
    moved = F.split(F.concat(F.substr(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4)), "")

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(c == "", rest).when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)
    return F.aggregate(moved, F.lit(0), add)


def is_iban(value: Column) -> Column:
    return _rest_97(F.regexp_replace(value, " ", "")) == 1


def kind_of(value: Column) -> Column:
    """Type of a match; null for what only looks like an entity (a number with a wrong check digit)."""
    whole = lambda p: value.rlike(f"^(?:{p})$")
    return (F.when(value.contains("@"), "email").when(whole(SECRET), "secret").when(whole(IBAN), F.when(is_iban(value), "iban"))
            .when(whole(CARD), F.when(is_card(value), "card")).when(whole(f"{IP}|{IP6}"), "ip").when(whole(SSN), "ssn")
            .when(value.rlike(r"^[+(\d]"), "phone").otherwise("person"))


def norm_of(kind: Column, value: Column) -> Column:
    """Normal form: spellings of one entity have one."""
    return (F.when(kind.isin("email"), F.lower(value)).when(kind.isin("card", "iban", "ssn", "phone"), F.regexp_replace(value, r"[^\p{L}\p{N}]", ""))
            .when(kind == "secret", value).otherwise(F.lower(value)))


def _scrambled(value: Column, digest: Column, pattern: str = r"\p{L}|\d") -> Column:
    """Every letter a letter of the same case, every digit a digit, all else unchanged."""
    letters = "abcdefghijklmnopqrstuvwxyz"

    def one(c: Column, i: Column) -> Column:
        n = _nibble(digest, i)
        letter = F.substr(_lit(letters), n % 26 + 1, F.lit(1))
        return F.when(c.rlike(r"^\d$"), (n % 10).cast("string")).when(c.rlike(r"^\p{Lu}$"), F.upper(letter)).when(c.rlike(r"^\p{L}$"), letter).otherwise(c)
    return F.array_join(F.transform(F.split(value, ""), one), "")


def _hex(value: Column, digest: Column) -> Column:
    def one(c: Column, i: Column) -> Column:
        nibble = F.substr(digest, i % 128 + 1, F.lit(1))
        return F.when(c.rlike("^[A-F]$"), F.upper(nibble)).otherwise(nibble)
    lower = F.array_join(F.transform(F.split(value, ""), one), "")
    return F.when(value == F.upper(value), F.upper(lower)).otherwise(lower)


def _email(value: Column, digest: Column, wide: Column) -> Column:
    """Local part and the host's first label are replaced; a domain of two labels stays."""
    local, host = F.split_part(value, _lit("@"), _lit(1)), F.split_part(value, _lit("@"), _lit(2))
    labels = F.split(host, r"\.")
    label = F.when(F.size(labels) > 2, _scrambled(labels[0], F.reverse(digest))).otherwise(labels[0])
    more = F.when(wide, F.substring(digest, 101, 12)).otherwise("")
    return F.concat(_scrambled(local, digest), more, _lit("@"), F.array_join(F.concat(F.array(label), F.slice(labels, _lit(2), F.size(labels))), "."))


def _in_format(value: Column, characters: Column) -> Column:
    """The characters, one after the other, in place of the letters and digits of ``value``."""
    cells = F.split(value, "")
    places = F.transform(cells, lambda c, i: F.size(F.filter(F.slice(cells, _lit(1), i + 1), lambda x: x.rlike(r"^[\p{L}\p{N}]$"))))
    return F.array_join(F.zip_with(cells, places, lambda c, p: F.when(c.rlike(r"^[\p{L}\p{N}]$"), F.substr(characters, p, _lit(1))).otherwise(c)), "")


def _card(value: Column, digest: Column) -> Column:
    plain = F.regexp_replace(value, "[ -]", "")
    body = F.concat(F.substring(plain, 1, 2), _scrambled(F.substr(plain, _lit(3), F.length(plain) - 3), digest))
    return _in_format(value, F.concat(body, ((10 - _luhn_sum(body, 0) % 10) % 10).cast("string")))


def _phone(value: Column, digest: Column) -> Column:
    """The country code stays; no group begins with a zero that didn't."""
    code = F.when(value.startswith("+"), F.regexp_extract(value, r"^\+\d{1,3}(?=[ .(-])", 0)).otherwise("")
    rest = F.substr(value, F.length(code) + 1, F.length(value))
    plain = F.regexp_replace(rest, r"\D", "")
    first = (_nibble(digest, 120) % 8 + 2).cast("string")
    return F.concat(code, _in_format(rest, F.concat(first, _scrambled(F.substr(plain, _lit(2), F.length(plain)), digest))))


def _more_digits(digest: Column, wide: Column) -> Column:
    """Two groups of four digits for a number whose format is full."""
    digits = F.translate(F.substring(digest, 101, 8), "abcdef", "135792")
    return F.when(wide, F.concat(_lit("-"), F.substring(digits, 1, 4), _lit("-"), F.substring(digits, 5, 4))).otherwise("")


def _octets(value: Column, digest: Column, wide: Column) -> Column:
    def one(x: Column, i: Column) -> Column:
        n = _nibble(digest, i * 4) * 256 + _nibble(digest, i * 4 + 2)
        return (F.when(wide, n % 255 + 1).when(F.length(x) == 3, n % 156 + 100).when(F.length(x) == 2, n % 90 + 10).otherwise(n % 9 + 1)).cast("string")
    return F.array_join(F.transform(F.split(value, r"\."), one), ".")


def _hextets(value: Column, digest: Column, wide: Column) -> Column:
    """The first group stays, all others keep their length; two more groups follow in a shortened address whose format is full."""
    def one(x: Column, i: Column) -> Column:
        first = F.translate(F.substr(digest, i * 5 + 1, _lit(1)), "0", "f")
        return F.when((i == 0) | (x == ""), x).otherwise(F.substr(F.concat(first, F.substr(digest, i * 5 + 2, _lit(3))), _lit(1), F.length(x)))
    groups = F.array_join(F.transform(F.split(value, ":"), one), ":")
    more = F.concat(_lit(":"), F.substring(digest, 101, 4), _lit(":"), F.substring(digest, 111, 4))
    made = F.when(wide & value.contains("::"), F.concat(groups, more)).otherwise(groups)
    return F.when(value == F.upper(value), F.upper(made)).otherwise(made)


def _iban(value: Column, digest: Column) -> Column:
    """Country stays, the account is made up, and the check digits are right for it."""
    plain = F.regexp_replace(value, " ", "")
    country, account = F.substring(plain, 1, 2), _scrambled(F.substr(plain, _lit(5), F.length(plain)), digest)
    check = F.lpad((98 - _rest_97(F.concat(country, _lit("00"), account))).cast("string"), 2, "0")
    return _in_format(value, F.concat(country, check, account))


def _secret(value: Column, digest: Column) -> Column:
    head = F.regexp_extract(value, "^(AKIA|gh[pousr]_|sk-)", 0)
    return F.when(head == "", _hex(value, digest)).otherwise(F.concat(head, _scrambled(F.substr(value, F.length(head) + 1, F.length(value)), digest)))


def script_of(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _name(kind: Column, value: Column, digest: Column, wide: Column) -> Column:
    """A made-up name in the script of ``value``; the ending follows the gender in ``kind`` (given_f, given_m, given_x, surname)."""
    def made(script: str) -> Column:
        syllables = F.array(*map(F.lit, SYLLABLES[script]))
        some = lambda places: F.concat(*(F.element_at(syllables, _nibble(digest, 6 * i) % 16 + 1) for i in places))
        body = F.concat(some(range(3)), F.when(wide, some(range(7, 12))).otherwise(""))
        ends = {g: F.element_at(F.array(*map(F.lit, ENDINGS[script][g])), _nibble(digest, 40) % 4 + 1) for g in "fmx"}
        return F.concat(body, F.when(kind == "given_f", ends["f"]).when(kind == "given_m", ends["m"]).otherwise(ends["x"]))
    script = script_of(value)
    name = F.when(script == "cyrillic", made("cyrillic")).when(script == "greek", made("greek")).otherwise(made("latin"))
    shouted = (value == F.upper(value)) & (F.length(value) > 1)
    return F.when(shouted, F.upper(name)).otherwise(F.initcap(name))


def surrogate(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """Replacement of one entity (names one by one) in the format of ``value``, or longer from attempt WIDE_FROM on.

    Cards, IBANs and secrets have 10^12 surrogates or more in any format and are never longer.
    """
    digest, wide = _digest(key, kind, norm_of(kind, value), attempt), attempt >= WIDE_FROM
    return (F.when(kind == "email", _email(value, digest, wide)).when(kind == "secret", _secret(value, digest)).when(kind == "iban", _iban(value, digest))
            .when(kind == "card", _card(value, digest)).when(kind == "ip", F.when(value.contains(":"), _hextets(value, digest, wide)).otherwise(_octets(value, digest, wide))).when(kind == "ssn", F.concat(_in_format(value, _scrambled(F.regexp_replace(value, "-", ""), digest)), _more_digits(digest, wide)))
            .when(kind == "phone", F.concat(_phone(value, digest), _more_digits(digest, wide))).otherwise(_name(kind, value, digest, wide)))


def parts_of(match: Column) -> Column:
    """A match as (kind, value) parts in order; kind is null for text that stays (titles, spaces, look-alikes)."""
    part = lambda kind, value: F.struct(kind.alias("kind"), value.alias("value"))
    kind, nothing = kind_of(match), F.lit(None).cast("string")
    title = F.regexp_extract(match, rf"^(?:{TITLES})\.? ", 0)
    names = F.split(F.substr(match, F.length(title) + 1, F.length(match)), " ")
    named = lambda xs: title.rlike("^(?:" + "|".join(xs) + r")\.? ")
    gender = (F.when(named(FEMALE_TITLES) | names[0].isin(*FEMALE), "given_f").when(named(MALE_TITLES) | names[0].isin(*MALE), "given_m").otherwise("given_x"))
    # A name alone after a title is the surname.
    person = (F.when(F.size(names) == 1, F.array(part(nothing, title), part(F.lit("surname"), names[0])))
              .otherwise(F.array(part(nothing, title), part(gender, names[0]), part(nothing, F.lit(" ")), part(F.lit("surname"), F.element_at(names, -1)))))
    return F.when(kind == "person", person).otherwise(F.array(part(kind, match)))


def _parts(text: Column) -> Column:
    """All parts of all matches of a text, and the text between, in order."""
    matches = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    between = F.transform(F.split(text, ANY, -1), lambda x: F.array(F.struct(F.lit(None).cast("string").alias("kind"), x.alias("value"))))
    found = F.transform(matches, parts_of)
    return F.flatten(F.zip_with(between, found, lambda a, b: F.when(b.isNull(), a).otherwise(F.concat(a, b))))


def _entity(kind: Column, value: Column) -> Column:
    return F.concat_ws("\x1f", kind, norm_of(kind, value))


def _pool(kind: Column) -> Column:
    """Entities whose surrogates must differ from one another: given names of all genders are one pool."""
    return F.when(kind.startswith("given"), "given").otherwise(kind)


def later_attempts(entities: DataFrame, key: str) -> DataFrame:
    """``kind, norm, attempt`` of the entities whose first surrogate collides.

    ``entities`` has the columns kind, norm and value (one spelling). An entity gives way if another one of its
    pool with a smaller norm has the same surrogate, or if its surrogate is an entity of the input.
    """
    told = stored(entities.groupBy("kind", "norm").agg(F.min("value").alias("value")).withColumn("pool", _pool(F.col("kind"))), "pii-entities")
    real = told.select("pool", F.col("norm").alias("made")).distinct().withColumn("real", F.lit(True))

    def with_made(df: DataFrame) -> DataFrame:
        made = surrogate(key, F.col("kind"), F.col("value"), F.col("attempt"))
        return df.withColumn("made", norm_of(F.col("kind"), made))

    now = told.withColumn("attempt", F.lit(0))
    for _ in range(MAX_ATTEMPTS):
        made = stored(with_made(now), "pii-attempt")
        first = made.groupBy("pool", "made").agg(F.min(F.struct("norm", "kind")).alias("owner"), F.count("*").alias("n"))
        clash = first.join(real, ["pool", "made"], "left").where("n > 1 or real")
        bad = (made.join(clash, ["pool", "made"]).where("real or struct(norm, kind) <> owner").select("kind", "norm"))
        bad = stored(bad, "pii-clash")
        if bad.isEmpty():
            return made.where("attempt > 0").select("kind", "norm", "attempt")
        now = (made.drop("made").join(bad.withColumn("again", F.lit(1)), ["kind", "norm"], "left")
               .withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0))).drop("again"))
    raise ValueError("surrogates keep colliding: the input has more entities of a format than that format has room for")


def replace_pii(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with every entity in the text replaced, all other columns unchanged.

    ``count_col`` names an optional extra column with the number of replaced parts. Null and empty texts and texts
    without an entity stay as they are; repeated rows are replaced alike; an empty table gives no rows. Types:
    e-mail, phone, IP (both versions), card (with issuer and check digit), IBAN (with check digits), social security number, secrets, person names
    (title or known given name).
    """
    mine, text = "__pii", F.col(text_col)
    hinted = F.coalesce(text.rlike(HINT), F.lit(False))
    # One occurrence of the matcher per text; the entity table is small beside the texts.
    seen = docs.where(hinted).select(F.md5(text).alias("text_id"), F.explode(_parts(text)).alias("p")).where("p.kind is not null")
    occurrences = stored(seen.select("text_id", F.col("p.kind").alias("kind"), norm_of(F.col("p.kind"), F.col("p.value")).alias("norm"), F.col("p.value").alias("value")), "pii-found")
    later = stored(later_attempts(occurrences.select("kind", "norm", "value"), key), "pii-later")
    by_text = stored(occurrences.select("text_id", "kind", "norm").distinct().join(later, ["kind", "norm"])
                     .groupBy("text_id").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\x1f", "kind", "norm"), F.col("attempt")))).alias("attempts")), "pii-attempts")

    def replaced(df: DataFrame, attempts: Column) -> DataFrame:
        def one(p: Column) -> Column:
            attempt = F.coalesce(F.element_at(attempts, _entity(p["kind"], p["value"])), F.lit(0))
            return F.when(p["kind"].isNull(), p["value"]).otherwise(surrogate(key, p["kind"], p["value"], attempt))
        # inline() evaluates the parts once for both columns.
        out = df.withColumn(f"{mine}_parts", _parts(text))
        new = F.array_join(F.transform(f"{mine}_parts", one), "")
        count = F.size(F.filter(F.col(f"{mine}_parts"), lambda p: p["kind"].isNotNull()))
        columns = [new.alias(c) if c == text_col else F.col(c) for c in docs.columns]
        return out.select(*columns, *([count.alias(count_col)] if count_col else []))

    plain = docs.where(~hinted).select("*", *([F.lit(0).alias(count_col)] if count_col else []))
    with_pii = docs.where(hinted).withColumn(f"{mine}_id", F.md5(text))
    joined = with_pii.join(by_text.withColumnsRenamed({"text_id": f"{mine}_text", "attempts": f"{mine}_attempts"}), F.col(f"{mine}_id") == F.col(f"{mine}_text"), "left")
    return plain.unionByName(replaced(joined, F.col(f"{mine}_attempts")))
