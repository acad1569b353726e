"""Text functions as Column expressions: Turkish-aware folding, tokens, trigrams, cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and their bare forms, after Turkish lower-casing.
MARKED = "ğıöüşçàáâãäåèéêëìíîïñòóôõùúûýÿāăąćčďđēęěğģīįķłńňőřśšťūůűźžż"
BARE = "giouscaaaaaaeeeeiiiinoooouuuyyaaaccddeeeggiiklnnorsstuuuzzz"


def turkish_lower(c: Column) -> Column:
    """Lower case with the Turkish pair of i: the dotted capital gives i, the plain capital gives dotless ı."""
    return F.lower(F.translate(c, "İI", "iı"))


def normalize(c: Column) -> Column:
    """Folded to a-z, 0-9 and single blanks; null and empty texts give an empty one."""
    # both small letters i end as a plain one, so only the dotted capital needs a rule of its own before lower()
    folded = F.translate(F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit("İ"), F.lit("i"))), MARKED, BARE)
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def compact(c: Column) -> Column:
    return F.replace(normalize(c), F.lit(" "), F.lit(""))


def tokens(c: Column, longer_than: int = 1) -> Column:
    """Words of the normalised text in order, repeated ones included."""
    return F.filter(F.split(normalize(c), " ", -1), lambda w: F.length(w) > longer_than)


def token_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(tokens(c)))


def trigrams(c: Column) -> Column:
    """Distinct padded trigrams of the lower-cased alphanumeric words: two blanks before, one after each word."""
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
    grams = F.transform(
        words,
        lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))),
    )
    return F.array_distinct(F.flatten(grams))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; 0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(0.0)).otherwise(both / either)


def trigram_similarity(a: Column, b: Column) -> Column:
    return set_similarity(trigrams(a), trigrams(b))


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def contained(a: Column, b: Column) -> Column:
    """1.0 where one compact form holds the other and neither is empty, else 0.0."""
    x, y = compact(a), compact(b)
    return F.when((x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x)), 1.0).otherwise(0.0)


def token_overlap(query: Column, candidate: Column) -> Column:
    """Share of the query's distinct words that the candidate has; 0 without words."""
    q = token_set(query)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, token_set(candidate))) / F.size(q))


def has_token(name: Column, token: str) -> Column:
    return F.array_contains(F.split(normalize(name), " ", -1), token)


def like_escaped(text: str) -> str:
    for c in "\\%_":
        text = text.replace(c, "\\" + c)
    return text


def clean_name(c: Column) -> Column:
    """A mark's name without the word for a figure in it, trimmed; null where nothing is left."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(c, r"(?iuU)(?:\+\s*)?\b[şs]ek[iıİ]l\b", ""), r"\s+", " "))
    return F.nullif(bare, F.lit(""))


def is_placeholder(c: Column) -> Column:
    """Names that hold nothing but the word for a figure and punctuation."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "şekil|sekil", ""), r"[^\p{L}\p{N}]", "") == ""


def holder_key(c: Column) -> Column:
    """Holder names for comparison: punctuation gone, white space single, lower case; not trimmed."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", ""), r"\s+", " ")


def client_id(c: Column) -> Column:
    """The number in brackets that ends a holder's name, or null."""
    return F.nullif(F.regexp_extract(c, r"\((\d+)\)\s*$", 1), F.lit(""))


def without_client_id(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\(\d+\)\s*$", ""))


def class_list(c: Column) -> Column:
    """Class numbers 1 to 45 of a list separated by commas, semicolons, slashes or blanks: sorted, distinct."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"[,;/\s]+", -1), lambda p: F.regexp_extract(p, r"^(\d{1,2})$", 1))
    numbers = F.transform(F.filter(parts, lambda p: p != ""), lambda p: p.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n.between(1, 45))))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 over the trimmed parts as JSON, which keeps their borders, and nulls apart from any text."""
    return F.sha2(F.to_json(F.struct(*[F.trim(p.cast("string")).alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def event_fingerprint(bulletin: Column, application: Column, kind: Column, text: Column) -> Column:
    """The registry's own short one: 16 hexadecimal digits over its parts and the first 200 characters of the text."""
    parts = [F.coalesce(p.cast("string"), F.lit("")) for p in (bulletin, application, kind, F.left(text, F.lit(200)))]
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(16))


#: What the code page of Windows has where Latin-1 has control codes, and those codes.
_WINDOWS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
_CODES = "".join(map(chr, [128, *range(130, 141), 142, *range(145, 157), 158, 159]))


def repair_mojibake(c: Column, rounds: int = 3) -> Column:
    """UTF-8 that was read as Latin-1 or as the Windows code page, read anew, up to three times over; other texts stay."""
    for _ in range(rounds):
        latin = F.encode(F.when(c.rlike(r"^[\x00-\xFF]*$"), c), "ISO-8859-1").cast("string")
        coded = F.translate(c, _WINDOWS, _CODES)
        windows = F.encode(F.when(coded.rlike(r"^[\x00-\xFF]*$") & ~c.rlike(r"[\x80-\x9F]"), coded), "ISO-8859-1").cast("string")
        read = F.coalesce(F.when(F.is_valid_utf8(latin), latin), F.when(F.is_valid_utf8(windows), windows), c)
        c = F.when(c.rlike("[ÃÄÅÂ]"), read).otherwise(c)
    return c


def phrase_key(c: Column) -> Column:
    """A phrase for comparison: single blanks, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def goods_present(c: Column) -> Column:
    """Whether a JSON text of goods holds any: not null, not an empty list, not JSON's null."""
    return F.coalesce(~F.trim(c).isin("", "[]", "null"), F.lit(False))


#: Record type by kind code of a publication.
KIND_CODES = {
    "B": "GRANTED_PATENT", "T4": "GRANTED_PATENT", "Y": "GRANTED_UM", "A1": "PUBLISHED_APP", "A2": "PUBLISHED_APP", "T": "PUBLISHED_APP",
    "T3": "PUBLISHED_APP", "U": "PUBLISHED_UM_APP", "U4": "PUBLISHED_UM_APP", "U5": "PUBLISHED_UM_APP", "T5": "PUBLISHED_UM_APP", "T6": "PUBLISHED_UM_APP",
}


def kind_record_type(code: Column) -> Column:
    """Record type of a publication's kind code; other codes are UNKNOWN."""
    known = F.create_map(*[F.lit(x) for kv in KIND_CODES.items() for x in kv])
    return F.coalesce(known[F.upper(code)], F.lit("UNKNOWN"))
