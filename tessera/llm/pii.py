"""Surrogates for personal data: keyed, of the same type, gender, script and format, distinct and coreferent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Given names by script and gender, and forms of address by gender (u: either).
GIVEN = {
    ("latin", "f"): "Anna Maria Julia Laura Emma Sophie Claire Camille Elena Lucia Carmen Isabel Ingrid Greta Heidi Helga Mary Linda Susan Karen Sarah Emily Olga Irina Svetlana Tatiana Natalia Ekaterina Elizabeth Jennifer Patricia Barbara Jessica Nancy Margaret Catherine Alice Charlotte Ursula Sabine Petra Monika Giulia Francesca Chiara Pilar Dolores".split(),
    ("latin", "m"): "Peter Thomas Martin Daniel David Michael Lucas Pierre Antoine Julien Carlos Miguel Javier Pedro Hans Jürgen Klaus Dieter John James Robert William Ivan Dmitri Sergei Andrei Nikolai Vladimir Richard Joseph Charles Christopher Matthew Anthony Andrew Paul George Edward Henry Wolfgang Stefan Günther Giovanni Marco Francesco Luis Jorge Fernando".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Татьяна Наталья Ирина Светлана Екатерина Людмила".split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Дмитрий Сергей Андрей Николай Михаил Владимир Борис".split(),
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Βασιλική Σοφία Ειρήνη Αγγελική Δήμητρα".split(),
    ("greek", "m"): "Γεώργιος Ιωάννης Κωνσταντίνος Δημήτριος Νικόλαος Παναγιώτης Βασίλειος Χρήστος".split(),
}
ADDRESS = {
    "f": "Mrs Ms Miss Madame Mme Mlle Frau Señora Sra Señorita г-жа Κυρία κα".split(),
    "m": "Mr Mister Monsieur Herr Herrn Señor Sr г-н Κύριος κος".split(),
    "u": "Dr. Prof. Professor Doctor".split(),
}
#: Words inside a name that are no entities.
PARTICLES = "von van de der den da di dos del della bin ibn al ter zu".split()
#: Syllables of invented names, by script, and the endings that mark gender. s, sf, sm: surnames of no gender, f, m.
SYLLABLES = {
    "latin": "ba be bo da de do ga gi la le lo ma mi mo na ne no ra ri ro sa se so ta te to va vi".split(),
    "cyrillic": "ба бе во да де го ла ле ма ми мо на не но ра ри ро са се та то ви".split(),
    "greek": "βα γα δα κα λα μα να πα ρα σα τα βο γο δο κο λο μο νο".split(),
}
ENDINGS = {
    "latin f": "na", "latin m": "ric", "latin u": "lin", "latin s": "ler",
    "cyrillic f": "ина", "cyrillic m": "слав", "cyrillic u": "ко", "cyrillic s": "енко", "cyrillic sf": "ова", "cyrillic sm": "ов",
    "greek f": "νη", "greek m": "νος", "greek u": "νι", "greek s": "άκη", "greek sf": "ίδου", "greek sm": "ίδης",
}
#: Endings of a surname in a script that marks gender by them.
GENDERED = {
    ("cyrillic", "sf"): "(ова|ева|ёва|ина|ына|ая)$", ("cyrillic", "sm"): "(ов|ев|ёв|ин|ын|ий|ой)$",
    ("greek", "sf"): "(ου|α|η)$", ("greek", "sm"): "ς$",
    ("cyrillic", "f"): "[ая]$", ("cyrillic", "m"): "[^ая]$", ("greek", "f"): "[αηάή]$", ("greek", "m"): "ς$",
}

# Every repetition of a group is possessive or bounded and every open run begins at a word's start, so that no text,
# however long, makes the matcher recurse deeply or look at a run again from each of its characters.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = r"[0-9A-Fa-f]{1,4}"
_SECRET = r"(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)"
_KEY = r"(?:AKIA|ASIA|gh[opsur]_|github_pat_|glpat-|xox[abprs]-|sk[-_]|[rp]k_|AIza|eyJ)"
_WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{L}+(?:['’-]\p{Lu}\p{L}+)*+"
_ALL_GIVEN = "(?:" + "|".join(n for names in GIVEN.values() for n in names) + r")(?:-\p{Lu}\p{L}++)?+"
_LAST = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}{_WORD}"
_FORMS = [a for forms in ADDRESS.values() for a in forms]
_forms = lambda capital: "(?:" + "|".join(a.replace(".", "") + (r"\." if "." in a else r"\.?") for a in _FORMS if a[0].isupper() == capital) + ")"
#: Words before a given name alone, by which someone is greeted or called.
CALLED = "Dear dear called named Hello Hi Lieber Liebe Cher Chère Querido Querida genannt nommé nommée llamado llamada".split()
#: Country codes of telephone numbers, all others having three digits.
_COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_ADDRESSED = rf" (?:\p{{Lu}}\. ){{0,3}}{_LAST}(?: (?:\p{{Lu}}\. ){{0,2}}{_LAST}){{0,2}}"
#: What may be asked for at the place before the alternatives of a kind are tried.
_DIGITS, _CAPITAL = r"(?=[\d+(])", r"(?=\p{Lu})"
#: Kinds in the order in which they are tried at a place of the text.
PATTERNS: dict[str, str] = {
    "ip": rf"{_DIGITS}(?<!\.){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)",
    "phone": rf"{_DIGITS}(?<!\+)(?:\+\d{{1,3}}(?:[ .-]?\(\d{{1,4}}\)|[ .-]\d{{1,4}})(?:[ .-]?\d{{2,4}}){{2,4}}|\+\d{{8,15}}|\(\d{{3}}\) ?\d{{3}}[ .-]\d{{4}}|\d{{3}}-\d{{3}}-\d{{4}}|\d{{3}}\.\d{{3}}\.\d{{4}}|\d{{3}} \d{{3}} \d{{4}}|0\d{{2,4}}[ /-]\d{{3,4}}[ -]?\d{{3,4}})(?!\w)",
    "ssn": rf"{_DIGITS}(?:(?<!-)\d{{3}}-\d{{2}}-\d{{4}}(?![\w-])|(?<!\d )\d{{3}} \d{{2}} \d{{4}}(?! ?[\w-]))",
    "card": rf"{_DIGITS}(?<!-)\d(?:[ -]?\d){{12,18}}(?![\w-])",
    "iban": rf"{_CAPITAL}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?!\w)",
    "key": rf"(?=[Aegrpsx])(?:(?:AKIA|ASIA)[0-9A-Z]{{16}}|{_KEY}(?=[A-Za-z_.-]{{0,80}}?\d)[A-Za-z0-9_.-]{{15,255}}[A-Za-z0-9_])(?!\w)",
    "name": rf"(?:{_CAPITAL}(?:{_forms(True)}{_ADDRESSED}|{_ALL_GIVEN}(?: (?:{_ALL_GIVEN}|\p{{Lu}}\.)){{0,3}} {_LAST}|(?:{'|'.join(w for w in CALLED if w[0].isupper())}) {_ALL_GIVEN})|(?=[dcngl])(?:{'|'.join(w for w in CALLED if w[0].islower())}) {_ALL_GIVEN}|(?=[гκ]){_forms(False)}{_ADDRESSED})(?!\p{{L}})",
    "login": r"[A-Za-z][A-Za-z0-9+.-]{0,20}+://[^\s/@:\"'<>]{1,256}+:[^\s/@\"'<>]{1,256}+@",
    "email": r"(?<![.+%-])[\w\p{L}.+%-]++@(?:[\p{L}\p{N}-]{1,63}+\.){1,126}\p{L}{2,24}",
    "secret": rf"(?:(?i:(?:password|passwd|pwd|passcode) (?:is|was) )(?=[^\s\"'<>]{{0,63}}?\d)[^\s\"'<>]{{8,256}}|(?<![.-])(?=[\w.-]*+[\"']?\s?[=:])(?i:[\w.-]{{0,64}}?{_SECRET}\w{{0,64}})[\"']?\s?(?:[=:]\s?[\"']|=\s?|:(?=\S)|:\s(?=\S{{0,63}}[\d!@#$%^&*_+/=-]))(?=[^\s\"'<>]{{0,200}}?[A-Za-z0-9])[^\s\"'<>]{{8,4096}})",
    "ip6": rf"(?<!:)(?=[0-9A-Fa-f:]{{0,39}}?\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![\w:])",
}
_START = r"(?<![\p{L}\p{N}_])"
UNION = _START + "(?:" + "|".join(PATTERNS.values()) + ")"
#: The same and, last, single capitalised words: what texts that hold a name are read by, for later mentions of it.
UNION_AND_WORDS = _START + "(?:" + "|".join([*PATTERNS.values(), _WORD]) + ")"
_DIGITAL = ("phone", "ssn", "card", "iban")
#: Attempts after which a draw leaves its narrow space for a wider one of the same type, and for the widest, and the
#: attempt that no entity should come to: beyond it the job fails, since the space must be full.
WIDER, WIDEST, MOST = 2, 4, 60
_PRIVATE = r"^(10|127|192\.168|172\.(1[6-9]|2\d|3[01])|169\.254)\."


def _number(seed: Column, at: int, below: int) -> Column:
    """A number from 0, drawn from the at-th stretch of a hexadecimal digest."""
    return F.pmod(F.conv(F.substring(seed, 1 + 8 * at, 8), 16, 10).cast("long"), F.lit(below))


def _list(values: list[str]) -> Column:
    """A constant array of words; folded to a literal before the plan runs."""
    return F.split(F.lit(" ".join(values)), " ", -1)


def _pick(seed: Column, at: int, values: list[str]) -> Column:
    return F.get(_list(values), _number(seed, at, len(values)).cast("int"))


def _like(text: Column, seed: Column) -> Column:
    """text with every letter and digit exchanged within its class; hexadecimal strings stay hexadecimal."""
    stream = F.concat(seed, F.sha2(F.concat(seed, F.lit("2")), 256), F.sha2(F.concat(seed, F.lit("3")), 256), F.sha2(F.concat(seed, F.lit("4")), 256))
    is_hex = text.rlike("^[0-9a-f]+$") & text.rlike("[a-f]")
    lower, upper, digits, hexes = (F.lit(s) for s in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"))

    def one(i: Column) -> Column:
        c = F.substr(text, i, F.lit(1))
        v = F.conv(F.substr(stream, F.pmod((i - 1) * 2, F.lit(250)) + 1, F.lit(4)), 16, 10).cast("int")
        draw = lambda letters, n: F.substr(letters, F.pmod(v, F.lit(n)) + 1, F.lit(1))
        return (
            F.when(is_hex, draw(hexes, 16)).when(c.rlike("[0-9]"), draw(digits, 10)).when(c.rlike("[a-z]"), draw(lower, 26)).when(c.rlike("[A-Z]"), draw(upper, 26)).otherwise(c)
        )

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits, its last being the check digit."""
    n = F.length(digits)
    value = lambda i: F.substr(digits, i, F.lit(1)).cast("int") * F.when(F.pmod(n - i, F.lit(2)) == 1, 2).otherwise(1)
    return F.pmod(F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + value(i) - F.when(value(i) > 9, 9).otherwise(0)), F.lit(10))


def _mod97(text: Column) -> Column:
    """The number that digits and capitals (10 to 35) spell, modulo 97."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    chars = F.filter(F.split(text, "", -1), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda s, c: F.pmod(s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)).cast("int"))


def _by(column: Column, values: dict[str, Column]) -> Column:
    return reduce(lambda c, kv: c.when(column == kv[0], kv[1]), values.items(), F.when(F.lit(False), next(iter(values.values()))))


def _name(kind: Column, seed: Column, attempt: Column) -> Column:
    """A listed given name of the gender at first, then an invented one of two and, by and by, up to seven syllables."""
    lists = {s: _list(parts) for s, parts in SYLLABLES.items()}
    syllables = _by(F.substring_index(kind, " ", 1), lists)
    drawn = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(2), F.least(F.lit(7), attempt))),
        lambda k: F.get(syllables, F.pmod(F.conv(F.substr(seed, k * 8 - 7, F.lit(8)), 16, 10).cast("long"), F.size(syllables)).cast("int")),
    )
    invented = F.initcap(F.concat(F.array_join(drawn, ""), _by(kind, {k: F.lit(e) for k, e in ENDINGS.items()})))
    listed = _by(kind, {" ".join(k): _pick(seed, 7, names) for k, names in GIVEN.items()})
    return F.when(attempt == 0, F.coalesce(listed, invented)).otherwise(invented)


def draw(entities: DataFrame, secret_key: str) -> DataFrame:
    """(kind, canonical, attempt) with made, the attempt-th surrogate: a function of the key and these three alone.

    Spaces that a corpus can exhaust grow with the attempts: addresses of a private range move to 10.* and then to IPv6,
    public ones to IPv6, secrets and numbers get more characters. Card numbers (10^11 at least) don't need it. The
    steps are columns of their own, so that each is worked out once a row.
    """
    kind, canonical, attempt, seed, drawn = (F.col(c) for c in ("kind", "canonical", "attempt", "seed", "drawn"))
    head = F.when(kind == "secret", F.regexp_extract(canonical, r"^(?:[^=: ]* (?:is|was) |[^=:]*[=:]\s?[\"']?)", 0)).when(kind == "key", F.regexp_extract(canonical, "^" + _KEY, 0)).when(kind == "login", F.regexp_extract(canonical, "^[^/]*://", 0)).otherwise("")
    step = entities.select("kind", "canonical", "attempt", F.sha2(F.concat_ws("\x1f", F.lit(secret_key), kind, canonical, attempt.cast("string")), 256).alias("seed"), head.alias("head"))
    step = step.withColumn("drawn", F.when(~(kind.contains(" ") | kind.isin("email", "ip", "ip6")), _like(F.substr(canonical, F.length("head") + 1), seed)))
    octet = lambda at, low=1, high=254: (_number(seed, at, high - low + 1) + low).cast("string")
    dot = lambda *parts: F.concat_ws(".", *parts)
    kept = lambda n: F.substring_index(canonical, ".", n)
    groups = lambda first, n: F.concat_ws(":", *[F.substring(seed, first + 4 * i, 4) for i in range(n)])
    private = canonical.rlike(_PRIVATE)
    v6 = F.when(private | canonical.rlike("^f[cd]"), F.concat(F.lit("fd"), F.substring(seed, 1, 2), F.lit(":"), groups(3, 7))).otherwise(F.concat(F.lit("2001:db8:"), groups(1, 6)))
    ip = (
        F.when((kind == "ip6") | (attempt >= WIDEST), v6)
        .when(canonical.rlike(r"^(10|127)\."), dot(kept(1), octet(0), octet(1), octet(2)))
        .when(private & (attempt >= WIDER), dot(F.lit("10"), octet(0), octet(1), octet(2)))
        .when(private, dot(kept(2), octet(1), octet(2)))
        .otherwise(dot(_pick(seed, 0, [str(n) for n in range(11, 127)]), octet(1), octet(2), octet(3)))
    )
    longer = F.substr(F.lpad(_number(seed, 6, 10**8).cast("string"), 8, "0"), F.lit(1), F.greatest(F.lit(0), attempt - (WIDER - 1)))
    syllable = lambda k: _pick(seed, k, SYLLABLES["latin"])
    email = F.concat(*map(syllable, range(4)), F.lit("."), _number(seed, 4, 10**4).cast("string"), F.lit("@mail"), _number(seed, 5, 100).cast("string"), F.lit(".example.org"))
    area = F.coalesce(F.nullif(F.regexp_extract(canonical, _COUNTRY, 0), F.lit("")), F.regexp_extract(canonical, "^0?", 0))
    phone = F.concat(area, (_number(seed, 7, 8) + 2).cast("string"), F.substr(drawn, F.length(area) + 2), longer)
    body = F.concat(F.substr(canonical, F.lit(1), F.lit(1)), F.substr(drawn, F.lit(2), F.length(drawn) - 2))
    step = step.withColumn("fits", F.when(kind == "card", F.pmod(F.lit(10) - _luhn(F.concat(body, F.lit("0"))), F.lit(10))))
    # check digits of accounts as of cards: right where the original's are, wrong where they are not
    country = F.substr(canonical, F.lit(1), F.lit(2))
    account = F.concat(F.substr(drawn, F.lit(5)), longer)
    step = step.withColumn("rest97", F.when(kind == "iban", _mod97(F.concat(account, country, F.lit("00")))))
    off = F.when(_mod97(F.concat(F.substr(canonical, F.lit(5)), F.substr(canonical, F.lit(1), F.lit(4)))) == 1, 0).otherwise(1 + _number(seed, 7, 95))
    check = F.lpad((F.pmod(98 - F.col("rest97") - 2 + off, F.lit(97)) + 2).cast("string"), 2, "0")
    iban = F.concat(country, check, account)
    shift = F.when(_luhn(canonical) == 0, 0).otherwise(1 + _number(seed, 7, 9))
    card = F.concat(body, F.pmod(F.col("fits") + shift, F.lit(10)).cast("string"))
    more = F.when((attempt >= WIDER) & ~F.col("head").isin("AKIA", "ASIA"), F.substring(seed, 33, 16)).otherwise("")
    made = (
        F.when(kind == "email", email)
        .when(kind.isin("ip", "ip6"), ip)
        .when(kind == "phone", phone)
        .when(kind == "card", card)
        .when(kind == "iban", iban)
        .when(kind == "login", F.concat("head", F.substr(drawn, F.lit(1), F.length(drawn) - 1), more, F.lit("@")))
        .when(kind.isin("secret", "key"), F.concat("head", "drawn", more))
        .when(kind.contains(" "), _name(kind, seed, attempt))
        .otherwise(F.concat(drawn, longer))
    )
    return step.select("kind", "canonical", "attempt", made.alias("made"))


def kind_of(match: Column) -> Column:
    """The kind of a match; "word" for a capitalised word that is no match of its own."""
    out = F.when(F.lit(False), F.lit(""))
    for k, pattern in PATTERNS.items():
        out = out.when(match.rlike(f"^(?:{pattern})$"), F.lit(k))
    return out.otherwise(F.lit("word"))


def _parts(match: Column, kind: Column) -> Column:
    """The entities of a match, in order: array<struct<raw, kind, canonical>>; kind is null where raw stays as it is.

    Every word of a name is an entity of its own, so that "Ms. Keller" stays the same person as "Anna Keller". Forms
    of address, particles and initials stay.
    """
    script_of = lambda w: F.when(w.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(w.rlike(r"\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))
    words = F.split(match, " ", -1)
    among = lambda w, values: F.array_contains(_list(values), w)
    bare = lambda w: F.replace(w, F.lit("."), F.lit(""))
    listed = {g: [n for (_, gender), names in GIVEN.items() if gender == g for n in names] for g in ("f", "m")}
    forms = {g: [a.replace(".", "") for a in found] for g, found in ADDRESS.items()}
    first = bare(F.get(words, F.lit(0)))

    def named(w: Column, i: Column) -> Column:
        script = script_of(w)
        low = F.lower(w)
        by_ending = lambda *roles: reduce(lambda c, k: c.when((script == k[0]) & low.rlike(GENDERED[k]), F.lit(k[1])), [k for k in GENDERED if k[1] in roles], F.when(F.lit(False), F.lit("")))
        head = F.substring_index(w, "-", 1)
        given = F.coalesce(
            F.when(among(head, listed["f"]), "f").when(among(head, listed["m"]), "m"), F.when(among(first, forms["f"]), "f").when(among(first, forms["m"]), "m"), by_ending("f", "m"), F.lit("u")
        )
        role = F.when((i == F.size(words) - 1) & ~among(first, CALLED), F.coalesce(by_ending("sf", "sm"), F.lit("s"))).otherwise(given)
        still = ((i == 0) & among(first, sum(forms.values(), CALLED))) | among(w, PARTICLES) | w.rlike(r"^\p{Lu}\.$")
        return F.struct(w.alias("raw"), F.when(~still, F.concat_ws(" ", script, role)).alias("kind"), low.alias("canonical"))

    canonical = (
        F.when(kind.isin("email", "ip6", "word"), F.lower(match))
        .when(kind == "phone", F.regexp_replace(match, r"[^\d+]", ""))
        .when(kind.isin("ssn", "card"), F.regexp_replace(match, r"\D", ""))
        .when(kind == "iban", F.replace(match, F.lit(" "), F.lit("")))
        .otherwise(match)
    )
    return F.when(kind == "name", F.transform(words, named)).otherwise(F.array(F.struct(match.alias("raw"), kind.alias("kind"), canonical.alias("canonical"))))


def _render(raw: Column, kind: Column, made: Column) -> Column:
    """The surrogate in the layout of the original: its separators, or its capitals. What it is longer by comes last."""
    step = lambda s, c: F.when(
        c.rlike("[0-9A-Z+]"), F.struct(F.concat(s["out"], F.substr(made, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))
    ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))
    laid = F.aggregate(F.split(raw, "", -1), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda s: F.concat(s["out"], F.substr(made, s["at"])))
    shouted = (raw == F.upper(raw)) & (raw != F.lower(raw)) & (F.length(raw) > 1)
    return F.when(kind.isNull(), raw).when(kind.isin(*_DIGITAL), laid).when((kind.contains(" ") | (kind == "email")) & shouted, F.upper(made)).otherwise(made)


def distinct_surrogates(entities: DataFrame, secret_key: str) -> DataFrame:
    """(kind, canonical) to (kind, canonical, made), no two of a kind alike and none equal to an original of its kind.

    Of entities that drew the same surrogate the first by canonical form keeps it; the others, and those that drew
    an original, draw again until no clash is left. Equal entities meet here as one row, hence coreference. Jobs run
    while this is called. Spaces grow with the attempts, so few come to a fifth; one that comes to MOST fails the job.
    """
    # few bytes but much work a row: spread by number, which adaptive execution doesn't put together again
    slices = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    originals = cut(entities.select("kind", "canonical").distinct().repartition(slices, "kind", "canonical"))
    held = cut(draw(originals.withColumn("attempt", F.lit(0)), secret_key))
    taken = originals.select("kind", F.lower("canonical").alias("low"), F.lit(True).alias("real")).distinct()
    turn = 0
    while True:
        owner = held.groupBy("kind", F.lower("made").alias("low")).agg(F.min(F.struct("attempt", "canonical")).alias("owner"), F.count("*").alias("n"))
        bad = owner.join(taken, ["kind", "low"], "left").where((F.col("n") > 1) | F.col("real").isNotNull())
        bad = cut(bad.select("kind", "low", F.when(F.col("real").isNull(), F.col("owner.canonical")).alias("keeper")))
        if bad.isEmpty():
            return held.select("kind", "canonical", "made")
        turn += 1
        if turn > MOST:
            raise RuntimeError(f"no free surrogates are left for {bad.select('kind').distinct().limit(20).collect()}")
        marked = held.withColumn("low", F.lower("made")).join(bad.withColumn("hit", F.lit(True)), ["kind", "low"], "left")
        again = F.col("hit").isNotNull() & ~F.col("canonical").eqNullSafe(F.col("keeper"))
        marked = cut(marked.select("kind", "canonical", "attempt", "made", again.alias("again")))
        redrawn = draw(marked.where("again").select("kind", "canonical", (F.col("attempt") + 1).alias("attempt")), secret_key)
        held = cut(marked.where("not again").select("kind", "canonical", "attempt", "made").union(redrawn))


#: Key of the registered query; a deployment passes its own.
DEMO_KEY = "tessera-demo-key"


def replace_pii(docs: DataFrame, secret_key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """docs with every entity in `text` replaced, and optionally the number of replaced places in a column `count`.

    Entities are addresses (e-mail, IP), numbers (phone, social security, card, account), secrets behind a telling
    name, logins in web addresses, keys of known form, given names that someone is called or greeted by, and names behind a form of address or a listed given name; within a text, later or
    earlier bare mentions of a word of such a name are the same entity. Texts without entities, nulls and empty ones
    included, pass through unread by any shuffle. The entities of all other texts are gathered as one row for each
    distinct entity, given surrogates, and brought back by the hash of the text, so equal texts are treated once and
    alike. Columns keep their names, types and order; repeated rows stay. A text's entities are the unit of work.
    Jobs run while this is called. Names without form of address or listed given name stay, initials too.
    """
    names = docs.columns
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text}`").alias("text"))
    clean = base.where(F.col("text").isNull() | ~F.col("text").rlike(UNION))
    # behind a generator, so that the filter does not search every text a second time
    found = base.select("row", "text", F.explode(F.array(F.regexp_extract_all("text", F.lit(UNION), F.lit(0)))).alias("found")).where(F.size("found") > 0)
    named = F.exists("found", lambda m: m.rlike(f"^(?:{PATTERNS['name']})$"))
    found = found.withColumn("named", named)
    items = F.when(F.col("named"), F.regexp_extract_all("text", F.lit(UNION_AND_WORDS), F.lit(0))).otherwise(F.col("found"))
    struck = cut(found.select("row", F.sha2("text", 256).alias("tkey"), "named", items.alias("items")))
    once = struck.groupBy("tkey").agg(F.first("items").alias("items"))
    hits = once.select("tkey", F.posexplode("items").alias("at", "match")).withColumn("kind", kind_of(F.col("match")))
    parts = hits.select("tkey", "at", F.posexplode(_parts(F.col("match"), F.col("kind"))).alias("part", "p"))
    parts = cut(parts.select("tkey", "at", "part", "p.raw", "p.kind", "p.canonical"))
    known = parts.where(F.contains("kind", F.lit(" "))).groupBy("tkey", "canonical").agg(F.min("kind").alias("known"))
    parts = parts.join(known, ["tkey", "canonical"], "left").withColumn("kind", F.when(F.col("kind") == "word", F.col("known")).otherwise(F.col("kind")))
    parts = cut(parts.select("tkey", "at", "part", "raw", "kind", "canonical"))
    made = distinct_surrogates(parts.where(F.col("kind").isNotNull()), secret_key)
    joined = parts.join(made, ["kind", "canonical"], "left")
    shown = joined.select("tkey", F.struct("at", "part", _render(F.col("raw"), F.col("kind"), F.col("made")).alias("shown"), F.col("kind").isNotNull().alias("hit")).alias("s"))
    spelled = shown.groupBy("tkey").agg(F.sort_array(F.collect_list("s")).alias("shown"))
    back = struck.join(spelled, "tkey")
    t = F.col("row").getField(text)
    pieces = F.when(F.col("named"), F.split(t, UNION_AND_WORDS, -1)).otherwise(F.split(t, UNION, -1))
    back = back.select("row", "shown", pieces.alias("pieces"))
    before = F.transform("shown", lambda s: F.concat(F.when(s["part"] == 0, F.get("pieces", s["at"])).otherwise(F.lit(" ")), s["shown"]))
    rebuilt = F.concat(F.array_join(before, ""), F.element_at("pieces", -1))
    places = F.size(F.array_distinct(F.transform(F.filter("shown", lambda s: s["hit"]), lambda s: s["at"]))).cast("long")
    extra = [places.alias(count)] if count else []
    done = back.select(*[rebuilt.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in names], *extra)
    return clean.select(*[F.col("row").getField(c).alias(c) for c in names], *([F.lit(0).cast("long").alias(count)] if count else [])).union(done)


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY, count="n_replaced")
