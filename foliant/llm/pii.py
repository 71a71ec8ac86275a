"""Personal data: detected entities get keyed surrogates. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import broadcast_if_few, materialize, text_print

_LOCAL = r"[\p{L}\p{N}._%+-]"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLES = {"m": ("Mr", "Herr", "Señor", "Sr", "Monsieur", "г-н"), "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Mme", "Madame", "г-жа"), "n": ("Dr", "Prof", "Professor", "Mx")}
_TITLE = "(?:" + "|".join(sorted((t for x in _TITLES.values() for t in x), key=len, reverse=True)) + r")\.?"
_TITLE_RUN = rf"{_TITLE}(?: {_TITLE}(?= ))*+"
_FIRST = "".join(sorted({t[0] for x in _TITLES.values() for t in x}))

#: A word of a name: letters of either case, then parts after an apostrophe or hyphen. One letter alone is none.
_WORD = r"\p{Lu}(?:[\p{L}\p{M}\p{N}]++|(?=['’-]\p{L}))(?:['’-][\p{L}\p{N}][\p{L}\p{M}\p{N}]*+)*+"
_INITIALS = r"\p{Lu}\.(?:-?\p{Lu}\.)*+"
#: Small words within a name; only before one of its words.
_SMALL = "von|van|vom|zu|zum|zur|der|den|de|del|della|di|da|do|dos|das|du|des|la|las|le|los|af|av|ter|ten|te|bin|ibn|al|el"
_NAME_PART = rf"(?!{_TITLE} )(?:(?:{_SMALL}) )*+(?:(?:d|l|al|el|ibn)['’-])?+(?:{_INITIALS}-?(?:{_WORD})?+|{_WORD})"

#: What is detected, in order: where two could start at one place, the first does.
PATTERNS = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++@[\p{{L}}\p{{N}}-]+(?:\.[\p{{L}}\p{{N}}-]+)*\.\p{{L}}{{2,24}}(?![\p{{L}}\p{{N}}])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![\p{L}\p{N}])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.-])(?:\d{13,19}|\d{4} \d{4} \d{4} \d{1,7}|\d{4}-\d{4}-\d{4}-\d{1,7})(?!\d)",
    "name": rf"(?=[{_FIRST}])(?<!\p{{L}}){_TITLE_RUN} {_NAME_PART}(?: {_NAME_PART})*+",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
_KINDS = {"email": "@", "ip": r"^\d{1,3}(\.\d{1,3}){3}$", "phone": r"^\+", "ssn": r"^\d{3}-\d{2}-\d{4}$", "card": r"^\d[\d -]*$", "secret": r"^[0-9A-Fa-f]+$"}

#: Alphabets of one script and case; a character is replaced within its own.
_ALPHABETS = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "àâäçéèêëîïíñóôöùûüúß", "абвгдежзиклмнопрстуфхцчшщэюя", "αβγδεζηθικλμνξοπρστυφχψω", "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփքօֆ",
)
#: Syllables of names and endings of given names by gender, by script; the first script is that of names in none of them.
_ENDINGS = {"latin": {"m": "n r s", "f": "na ra lia"}, "cyrillic": {"m": "н р с", "f": "на ра лия"}, "greek": {"m": "νος ρης σης", "f": "να ρα σία"}, "armenian": {"m": "ն ր կ", "f": "նա րա նե"}}
_SYLLABLES = {
    "latin": "ba be bo da de do fa fe fi ga go ka ke ko la le lo ma me mo na ne no pa pe po ra re ro sa se so",
    "cyrillic": "ба бе бо ва ве во га го да де до ка ко ла ле ло ма ме мо на не но па по ра ре ро са се со та то",
    "greek": "βα βε βο γα γε γο δα δε δο κα κε κο λα λε λο μα με μο να νε νο πα πε πο ρα ρε ρο σα σε σο τα το",
    "armenian": "բա բե բո գա գե գո դա դե դո կա կե կո լա լե լո մա մե մո նա նե նո պա պե պո ռա ռե ռո սա սե սո տա տո",
}
_SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "armenian": r"\p{IsArmenian}"}
#: Country codes of one and two digits; all others have three.
_COUNTRY = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Attempts after which local parts of emails, and numbers, become longer: theirs of that length are taken.
_LONGER_EMAIL, _LONGER_NUMBER = 3, 8


def _hash(key: str, *parts: Column) -> Column:
    """64 bytes as hexadecimal digits: a keyed SHA-512 of the parts."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *[p.cast("string") for p in parts]), 512)


def _number(hexed: Column, byte: Column | int, modulus: Column | int) -> Column:
    """A number below modulus from 15 hexadecimal digits, the first of them of this byte (up to 56)."""
    start = (byte if isinstance(byte, Column) else F.lit(byte)) * 2 + 1
    return F.pmod(F.conv(F.substr(hexed, start, F.lit(15)), 16, 10).cast("long"), modulus if isinstance(modulus, Column) else F.lit(modulus))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permute_digits(digits: Column, key: str, *tweak: Column) -> Column:
    """A keyed permutation of the strings of as many digits (2 to 36), by six rounds over both halves."""
    n = F.length(digits)
    a, b = F.floor(n / 2).cast("int"), (n - F.floor(n / 2)).cast("int")

    def rounds(left: Column, right: Column, i: int) -> Column:
        if i == 3:
            return F.concat(F.lpad(left.cast("string"), a, "0"), F.lpad(right.cast("string"), b, "0"))
        # Each step is named by a one-element array, so that its expression stands in the plan once.
        new_left = F.pmod(left + _number(_hash(key, *tweak, n, F.lit(2 * i), right), 0, _power(a)), _power(a))

        def then(x: Column) -> Column:
            new_right = F.pmod(right + _number(_hash(key, *tweak, n, F.lit(2 * i + 1), x), 0, _power(b)), _power(b))
            return F.get(F.transform(F.array(new_right), lambda y: rounds(x, y, i + 1)), F.lit(0))

        return F.get(F.transform(F.array(new_left), then), F.lit(0))

    return F.when(n < 2, digits).otherwise(rounds(F.substr(digits, F.lit(1), a).cast("long"), F.substr(digits, a + 1, b).cast("long"), 0))


def _refill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order."""
    gaps = F.split(shape, "[0-9]", -1)
    n = F.size(gaps) - 1
    filled = F.zip_with(F.slice(gaps, F.lit(1), n), F.split(digits, ""), lambda g, d: F.concat(g, d))
    return F.concat(F.array_join(filled, ""), F.element_at(gaps, -1))


def _luhn(digits: Column) -> Column:
    """The check digit that belongs after these digits."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.pmod(10 - F.pmod(F.aggregate(doubled, F.lit(0), lambda s, x: s + x), F.lit(10)), F.lit(10))


def _reshape(text: Column, hexed: Column) -> Column:
    """Lower-case text with each character replaced by a keyed one of its script; others stay."""

    def one(c: Column, i: Column) -> Column:
        out = c
        for alphabet in reversed(_ALPHABETS):
            new = F.substr(F.lit(alphabet), _number(hexed, F.pmod(i, F.lit(56)), len(alphabet)).cast("int") + 1, F.lit(1))
            out = F.when(F.instr(F.lit(alphabet), c) > 0, new).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), one), "")


def kind_of(value: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(_KINDS.items()):
        out = F.when(value.rlike(pattern), kind).otherwise(out)
    # 32 digits and more are a secret, not a card.
    return F.when(value.rlike(r"^[0-9A-Fa-f]{32,64}$"), "secret").otherwise(out)


def _choose(words: Column, hexed: Column, byte: Column | int) -> Column:
    """One of the words, which blanks part."""
    return _once(F.split(words, " "), lambda w: F.get(w, _number(hexed, byte, F.size(w).cast("long")).cast("int")))


def _by(table: dict[str, str], key: Column) -> Column:
    """The entry of the table, or its first one."""
    first, *others = table.items()
    out = F.lit(first[1])
    for k, v in others:
        out = F.when(key == k, v).otherwise(out)
    return out


def _once(value: Column, then) -> Column:
    """then(value), with the expression of value in the plan once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _title(value: Column) -> Column:
    return F.regexp_extract(value, rf"^({_TITLE_RUN}) ", 1)


def atoms(value: Column) -> Column:
    """What an entity is made of, whatever its format: 'kind:canonical form'.

    Emails and secrets are lower-cased; phones, cards and social security numbers are their digits. A name
    is its words, lower-cased and without the title: the last a family name (f), others given names of the
    title's gender (gm, gf, gn). So all that is said of one person or number has the same atoms.
    """
    kind, digits = kind_of(value), _digits(value)

    def name(title: Column) -> Column:
        female, male = (title.rlike(r"(?:^| )(?:" + "|".join(_TITLES[x]) + r")\.?(?: |$)") for x in "fm")
        words = F.split(F.substr(value, F.length(title) + 2, F.length(value)), " ")
        role = F.when(female, "gf:").when(male, "gm:").otherwise("gn:")
        return F.transform(words, lambda w, i: F.concat(F.when(i == F.size(words) - 1, "f:").otherwise(role), F.translate(F.lower(w), "’", "'")))

    canonical = F.when(kind.isin("phone", "card", "ssn"), digits).otherwise(F.lower(value))
    return F.when(kind == "name", _once(_title(value), name)).otherwise(F.array(F.concat(kind, F.lit(":"), canonical)))


def atom_surrogate(atom: Column, key: str, attempt: Column) -> Column:
    """The canonical form that stands for an atom: a function of key, atom and attempt.

    Digits of phones, social security numbers and cards are permuted by the key, so distinct numbers of
    one length stay distinct; a card keeps whether its check digit is right, a phone its country code.
    Addresses are permuted as 32 bits. Emails keep the shape of both parts and the top-level domain, and
    equal domains stay equal. Secrets become as many hexadecimal digits, names other names of the same
    script and gender. Later attempts draw from more names, then from longer forms, which never run out.
    """
    kind, value = F.substring_index(atom, ":", 1), F.substr(atom, F.instr(atom, F.lit(":")) + 1, F.length(atom))

    def of(hexed: Column) -> Column:
        domain = F.substring_index(value, "@", -1)
        domain_hash = _hash(key, F.lit("domain"), F.lit(0), domain)
        labels = F.regexp_extract(domain, r"^(.*)(\.\p{L}+)$", 1)
        longer = F.substr(F.translate(hexed, "0123456789", "ghijklmnop"), F.lit(1), F.greatest(F.lit(0), attempt - _LONGER_EMAIL))
        email = F.concat(_reshape(F.substring_index(value, "@", 1), hexed), longer, F.lit("@"), _reshape(labels, domain_hash), F.regexp_extract(domain, r"^(.*)(\.\p{L}+)$", 2))
        octets = F.transform(F.split(value, r"\."), lambda o: F.lpad(o, 3, "0").cast("long"))
        high, low = F.get(octets, F.lit(0)) * 256 + F.get(octets, F.lit(1)), F.get(octets, F.lit(2)) * 256 + F.get(octets, F.lit(3))

        def ip(a: Column, b: Column, i: int) -> Column:
            if i == 4:
                return F.concat_ws(".", *[x.cast("string") for h in (a, b) for x in (F.shiftright(h, 8), h.bitwiseAND(F.lit(255).cast("long")))])
            new = F.pmod(a + _number(_hash(key, F.lit("ip"), attempt, F.lit(i), b), 0, 1 << 16), F.lit(1 << 16))
            return _once(new, lambda x: ip(b, x, i + 1))

        more = F.substr(F.translate(hexed, "abcdef", "012345"), F.lit(1), F.greatest(F.lit(0), attempt - _LONGER_NUMBER))
        country = F.when(kind == "phone", F.regexp_extract(value, _COUNTRY, 1)).otherwise("")
        # All digits but the country code and a card's last, the check digit.
        inner = F.substr(value, F.length(country) + 1, F.length(value) - F.length(country) - F.when(kind == "card", 1).otherwise(0))
        check = F.substr(value, F.length(value), F.lit(1)).cast("int")
        number = _once(F.concat(permute_digits(inner, key, kind, attempt, country), more), lambda p: F.concat(country, p, F.when(kind == "card", F.pmod(_luhn(p) + check - _luhn(inner), F.lit(10)).cast("string")).otherwise("")))

        script = F.lit("latin")
        for one, pattern in _SCRIPTS.items():
            script = F.when(value.rlike(pattern), one).otherwise(script)
        gender = F.when(kind == "gf", "f").when(kind == "gm", "m").when(_number(hexed, 40, 2) == 0, "f").otherwise("m")
        both = F.concat(script, F.lit(" "), gender)
        flat = lambda table: {f"{one} {g}": words for one, own in table.items() for g, words in own.items()}
        # So many that few of even a million names meet at first.
        length = F.when(kind == "f", attempt + 5).otherwise(attempt + 4).cast("int")
        syllables = F.array_join(F.transform(F.sequence(F.lit(0), length - 1), lambda i: _choose(_by(_SYLLABLES, script), hexed, F.pmod(i * 8, F.lit(56)))), "")
        out = F.initcap(F.when(kind == "f", syllables).otherwise(F.concat(syllables, _choose(_by(flat(_ENDINGS), both), hexed, 48))))
        out = F.when(kind.isin("phone", "ssn", "card"), number).otherwise(out)
        for one, column in (("secret", F.substr(hexed, F.lit(1), F.length(value))), ("ip", ip(high, low, 0)), ("email", email)):
            out = F.when(kind == one, column).otherwise(out)
        return out

    # Names of both genders and roles draw from one hash; other kinds are told apart by their tweaks.
    return _once(_hash(key, F.lit("atom"), attempt, atom), of)


def surrogate(value: Column, key: str, attempts: Column | None = None) -> Column:
    """The surrogate of an entity in its own format; attempts maps atoms to other attempts than the first."""
    kind = kind_of(value)

    def attempt(atom: Column) -> Column:
        return F.lit(0) if attempts is None else F.coalesce(F.try_element_at(attempts, atom), F.lit(0))

    def render(new: Column) -> Column:
        one = F.get(new, F.lit(0))
        letters = F.split(value, "")
        cased = F.array_join(F.transform(F.split(one, ""), lambda c, i: F.when(F.lower(F.get(letters, i)) != F.get(letters, i), F.upper(c)).otherwise(c)), "")
        n = F.length(_digits(value))
        number = F.concat(_refill(value, F.substr(one, F.lit(1), n)), F.substr(one, n + 1, F.length(one)))
        out = F.when(kind == "name", F.concat(_title(value), F.lit(" "), F.array_join(new, " "))).when(kind == "email", cased).when(kind == "ip", one)
        return out.when(kind == "secret", F.when(value.rlike("[A-F]"), F.upper(one)).otherwise(one)).otherwise(number)

    return _once(F.transform(atoms(value), lambda a: atom_surrogate(a, key, attempt(a))), render)


def _family(atom: str) -> Column:
    """Atoms of one family must not be taken for each other."""
    return F.regexp_replace(F.substring_index(atom, ":", 1), "^(?:f|g.)$", "name")


def collisions(docs: DataFrame, key: str, *, text_col: str = "text") -> DataFrame:
    """(value, surrogate) of the entities whose first surrogate will not do.

    A surrogate will not do if one of its atoms stands for a smaller atom of that kind as well or is itself an
    atom of the corpus; such an atom is keyed anew until none is left. Distinct atoms only are compared,
    in tables in the shared folder; forms get longer with the attempts, so this ends.
    """
    found = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(text_col, F.lit(PATTERN), F.lit(0)))).alias("value")).distinct()
    values = materialize(found.select("value", atoms(F.col("value")).alias("atoms")), "entities")
    known = materialize(values.select(F.explode("atoms").alias("atom")).distinct(), "atoms")
    # A column of its own keeps the keyed expressions from being planned twice; it is long, and made once for all rounds.
    new = atom_surrogate(F.col("atom"), key, F.col("attempt")).alias("surrogate")
    keyed = lambda df: df.select("atom", "attempt", F.substring_index("atom", ":", 1).alias("kind"), new)
    state = materialize(keyed(known.withColumn("attempt", F.lit(0))), "surrogates")
    names = known.select(_family("atom").alias("family"), F.lower(F.substring_index("atom", ":", -1)).alias("lower"))
    while True:
        shared = state.groupBy("kind", "surrogate").agg(F.min("atom").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        twice = state.join(shared, ["kind", "surrogate"]).where(F.col("atom") != F.col("first")).select("atom")
        taken = state.select("atom", _family("atom").alias("family"), F.lower("surrogate").alias("lower")).join(names, ["family", "lower"], "left_semi").select("atom")
        bad = materialize(twice.unionByName(taken).distinct(), "collisions")
        if bad.isEmpty():
            break
        anew = keyed(state.join(bad, "atom", "left_semi").select("atom", (F.col("attempt") + 1).alias("attempt")))
        state = materialize(state.join(bad, "atom", "left_anti").unionByName(anew), "surrogates")
    again = state.where("attempt > 0").select("atom", "attempt")
    if again.isEmpty():
        return docs.sparkSession.createDataFrame([], "value string, surrogate string")
    changed = values.select("value", F.explode("atoms").alias("atom")).join(again, "atom").groupBy("value").agg(F.map_from_entries(F.collect_set(F.struct("atom", "attempt"))).alias("attempts"))
    return changed.select("value", surrogate(F.col("value"), key, F.col("attempts")).alias("surrogate"))


#: Stands before and after each entity while a text is cut there.
_MARK = "\uffff"


def _cut(text_col: str) -> Column:
    """Gaps and entities of a text in turn, from one pass of the pattern; a text that holds the mark takes two."""
    text = F.col(text_col)
    marked = F.split(F.regexp_replace(text, f"(?:{PATTERN})", f"{_MARK}$0{_MARK}"), _MARK, -1)
    found, gaps = F.regexp_extract_all(text_col, F.lit(PATTERN), F.lit(0)), F.split(text, PATTERN, -1)
    both = F.flatten(F.zip_with(gaps, found, lambda g, e: F.when(e.isNull(), F.array(g)).otherwise(F.array(g, e))))
    return F.when(F.contains(text, F.lit(_MARK)), both).otherwise(marked)


def replace_entities(docs: DataFrame, key: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text replaced and n_entities and kinds added (columns of those names are replaced).

    Entities are emails, IPv4 addresses, secrets (32 to 64 hexadecimal digits), phones with a country code,
    social security numbers, card numbers and names after one of _TITLES: all words up to the first that is
    not of a name (_NAME_PART). An entity has the same surrogate in all documents and formats (see atoms()):
    case of emails and secrets, separators of numbers and the title of a name do not count, and a family
    name alone has the surrogate that it has after a given name. Distinct entities have distinct ones, and
    no surrogate is an entity of the corpus. Null
    texts stay null with no entities; repeated rows and null ids are rows like others; an empty table gives
    an empty result. kinds lists the kinds found, sorted, with commas.

    Texts are cut and put together where they are read. If surrogates collided, the places of those entities
    join the rows by id and a hash of the text, without moving the texts as long as they are few.
    """
    exceptions = materialize(collisions(docs, key, text_col=text_col), "other-surrogates")
    extra = ["n_entities", "kinds"]
    base = docs.drop(*extra)
    # Every second part is an entity.
    rows = base.withColumn("__parts", _cut(text_col))
    if exceptions.isEmpty():
        rows = rows.withColumn("__fixed", F.lit(None).cast("map<int,string>"))
    else:
        places = rows.select(F.col(id_col).alias("__id"), *[c.alias(f"__t{i}") for i, c in enumerate(text_print(text_col))], F.posexplode("__parts").alias("__pos", "value")).where("__pos % 2 = 1")
        fixed = places.join(broadcast_if_few(exceptions), "value").groupBy("__id", "__t0", "__t1").agg(F.map_from_entries(F.collect_set(F.struct("__pos", "surrogate"))).alias("__fixed"))
        fixed = broadcast_if_few(materialize(fixed, "places"))
        rows = rows.withColumns({f"__l{i}": c for i, c in enumerate(text_print(text_col))})
        rows = rows.join(fixed, rows[id_col].eqNullSafe(fixed["__id"]) & (rows["__l0"] == fixed["__t0"]) & (rows["__l1"] == fixed["__t1"]), "left")
    new = F.transform("__parts", lambda v, i: F.when(i % 2 == 0, v).otherwise(F.coalesce(F.try_element_at("__fixed", i), surrogate(v, key))))
    n = F.coalesce(F.floor(F.size("__parts") / 2), F.lit(0))
    text = F.when(n == 0, F.col(text_col)).otherwise(F.array_join(new, ""))
    found = F.filter("__parts", lambda v, i: i % 2 == 1)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform(found, kind_of))), ",")
    columns = [text.alias(c) if c == text_col else rows[c] for c in base.columns]
    return rows.select(*columns, F.greatest(F.lit(0), n).cast("long").alias("n_entities"), F.coalesce(kinds, F.lit("")).alias("kinds"))
