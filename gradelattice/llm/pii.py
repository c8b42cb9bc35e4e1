"""Surrogates for personal data and secrets, with DataFrame functions only.

One pattern finds the entities of a text.  The distinct ones of the whole table form a dictionary, in which each gets a
keyed surrogate of its kind and format: digits for digits, letters for letters, addresses for addresses, names of the same
gender and script.  Surrogates that meet another one or a real value are drawn again until all differ.  Texts are then put
together from what stood between the entities and the surrogates; equal entities have equal surrogates everywhere, however
they are punctuated or cased.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelattice.session import stage, stage_observed

KEY = "surrogates"  # used where neither the caller nor the session names one: then anyone can repeat the surrogates
KEY_SETTING = "spark.gradelattice.pii.key"
MAX_DRAWS = 40
LENGTHEN = 8  # draws after which surrogates grow, as all of their format may be taken

# Formats found; case matters where it does in the format.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
PHONE = (r"(?<![\p{L}\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)"
         r"|(?<![\p{L}\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\p{L}\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])")
CARD = r"(?<![\d-])\d{13,19}(?![\d-])|(?<![\d-])\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}(?![\d-])"
SECRET = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*\d)(?=[\d_-]*[A-Za-z])[A-Za-z0-9_-]{24,}+"
# Country codes of telephone numbers; all others have three digits.
COUNTRY_CODE = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
# Forms of address by gender.
MALE = ("Mr.", "Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr.", "господин", "κύριος")
FEMALE = ("Mrs.", "Mrs", "Ms.", "Ms", "Frau", "Madame", "Mme", "Señora", "Sra.", "госпожа", "κυρία")
_TITLES = "|".join(t.replace(".", r"\.") for t in MALE + FEMALE)
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLES}) \p{{Lu}}\p{{Ll}}+(?:[ -]\p{{Lu}}\p{{Ll}}+)?"
WORD = r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}+(?![\p{L}\p{N}])"
ENTITY = "|".join((EMAIL, IP, SSN, IBAN, PHONE, CARD, SECRET, NAME))

_SYLLABLES = {  # beginnings and endings that names are made of, by script
    "latin": ("ba be bo ca da de do fa fe ga ha ka la le lo ma me mi na no pa ra re ro sa se ta te to va", "n r l s", "a", "er"),
    "cyrillic": ("ба бе бо да де до за ка ла ле ло ма ме ми на но па ра ре ро са се та те то ва", "н р л м", "а", "ов"),
    "greek": ("βα βε γα δα δε ζα κα λα λε λο μα με μι να νο πα ρα ρε ρο σα σε τα τε το", "ν ρ λ μ", "α", "ης"),
}


def _kind(m: Column) -> Column:
    return (F.when(m.contains("@"), "email").when(m.rlike(rf"^(?:{_TITLES}) "), "name").when(m.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip")
            .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(m.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]{12,}$") & (F.length(F.translate(m, " ", "")) <= 34), "iban")
            .when(m.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$"), "phone").when(m.rlike(r"^[\d -]+$"), "card").otherwise("secret"))


def _name_parts(m: Column) -> tuple[Column, Column, Column, Column]:
    """Title with its blank, kind of the given name, given name with what follows it (or nothing), family name."""
    title = F.regexp_extract(m, rf"^(?:{_TITLES}) ", 0)
    rest = F.regexp_replace(m, rf"^(?:{_TITLES}) ", "")
    given = F.regexp_extract(rest, r"^(\p{L}+)[ -]", 1)
    gender = F.when(F.rtrim(title).isin(*MALE), "given-m").otherwise("given-f")
    return title, gender, given, F.regexp_extract(rest, r"(\p{L}+)$", 1)


def _part(kind: str | Column, value: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), value.alias("value"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _dialled(m: Column) -> Column:
    """A telephone number as all its spellings share it: digits, behind a plus if it has one."""
    return F.concat(F.when(m.startswith("+"), "+").otherwise(""), _digits(m))


def _parts(m: Column) -> Column:
    """What of an entity is replaced as a unit: ``array<struct<kind, value>>``, in a form that all spellings share."""
    kind = _kind(m)
    _, gender, given, family = _name_parts(m)
    return (F.when(kind == "email", F.array(_part("local", F.lower(m)), _part("domain", F.lower(F.substring_index(m, "@", -1)))))
            .when(kind == "name", F.when(given != "", F.array(_part(gender, given), _part("family", family))).otherwise(F.array(_part("family", family))))
            .when(kind == "phone", F.array(_part(kind, _dialled(m))))
            .when(kind.isin("card", "ssn"), F.array(_part(kind, _digits(m))))
            .when(kind == "iban", F.array(_part("iban", F.translate(m, " ", ""))))
            .otherwise(F.array(_part(kind, m))))


def _drawn(kind: Column, value: Column, draw: Column, key: str) -> Column:
    """A stream of 128 numbers 0-255 for an entity, by keyed hashes: the key goes into an inner and an outer one."""
    inner = [F.sha2(F.concat_ws("|", F.lit("inner"), F.lit(key), kind, value, draw.cast("string"), F.lit(str(k))), 256) for k in range(4)]
    blocks = [F.sha2(F.concat_ws("|", F.lit("outer"), F.lit(key), x), 256) for x in inner]
    hexes = F.concat(*blocks)
    return F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: F.conv(F.substr(hexes, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))


def _substituted(value: Column, stream: Column, keep: Column | int = 0) -> Column:
    """ASCII digits for digits of any script and letters for letters of their case; the first ``keep`` and all other signs stay."""
    pick = lambda signs, n: F.substr(F.lit(signs), n % len(signs) + 1, F.lit(1))
    hexes = value.rlike("^[0-9a-fA-F]+$")
    keep = F.lit(keep) if isinstance(keep, int) else keep

    def one(c: Column, i: Column) -> Column:
        n = F.element_at(stream, (i % 128 + 1).cast("int")) + F.floor(i / 128).cast("int")
        return (F.when(i < keep, c).when(c.rlike(r"\p{N}"), pick("0123456789", n))
                .when(c.rlike("[a-z]"), F.when(hexes, pick("abcdef", n)).otherwise(pick("abcdefghijklmnopqrstuvwxyz", n)))
                .when(c.rlike("[A-Z]"), F.when(hexes, pick("ABCDEF", n)).otherwise(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n)))
                .when(c.rlike(r"\p{L}"), pick("abcdefghijklmnopqrstuvwxyz", n)).otherwise(c))
    return F.array_join(F.transform(F.split(value, ""), one), "")


def _lettered(head: Column) -> Column:
    """The head of a domain, with letters for the hyphens of labels that have nothing else."""
    return F.array_join(F.transform(F.split(head, r"\."), lambda label: F.when(label.rlike("^-+$"), F.translate(label, "-", "a")).otherwise(label)), ".")


def _luhn(digits: Column, skip: int) -> Column:
    """Sum of the Luhn check, of a number that ``skip`` more digits follow."""
    return F.aggregate(F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(
        (i + skip) % 2 == 1, F.coalesce(c.try_cast("int"), F.lit(0)) * 2 - F.when(F.coalesce(c.try_cast("int"), F.lit(0)) > 4, 9).otherwise(0)
    ).otherwise(F.coalesce(c.try_cast("int"), F.lit(0)))), F.lit(0), lambda a, x: a + x)


def _card(value: Column, stream: Column) -> Column:
    """A number of the same length and first digit that passes the Luhn check if the original does."""
    other = _substituted(value, stream, 1)
    body = F.substr(other, F.lit(1), F.length(other) - 1)
    check = ((10 - _luhn(body, 1) % 10) % 10)
    last = F.when(_luhn(value, 0) % 10 == 0, check).otherwise((check + 1 + F.element_at(stream, 100) % 9) % 10)
    return F.concat(body, last.cast("string"))


def _remainder(signs: Column) -> Column:
    """An account number, country and check digits moved behind, as a number (A = 10, ...) modulo 97."""
    def step(r: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), r * 10 + c.try_cast("int")).otherwise(r * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(signs, ""), F.lit(0), lambda r, c: F.coalesce(step(r, c), F.lit(0)).cast("int"))


def _iban(value: Column, stream: Column) -> Column:
    """An account number of the same country and form, with valid check digits if the original's are."""
    other = _substituted(value, stream, 2)
    moved = lambda of, check: F.concat(F.substr(of, F.lit(5)), F.substr(of, F.lit(1), F.lit(2)), check)
    valid = _remainder(moved(value, F.substr(value, F.lit(3), F.lit(2)))) == 1
    check = F.lpad((98 - _remainder(moved(other, F.lit("00")))).cast("string"), 2, "0")
    return F.when(valid, F.concat(F.substr(other, F.lit(1), F.lit(2)), check, F.substr(other, F.lit(5)))).otherwise(other)


def _name(kind: Column, value: Column, stream: Column) -> Column:
    def made(script: str) -> Column:
        first, middle, female, family = (x.split() for x in _SYLLABLES[script])
        pick = lambda of, k: F.element_at(F.array(*[F.lit(x) for x in of]), F.element_at(stream, k) % len(of) + 1)
        stem = F.concat(pick(first, 1), pick(first, 2), F.when(F.element_at(stream, 4) % 2 == 0, pick(first, 3)).otherwise(""), pick(middle, 5))
        return F.initcap(F.concat(stem, F.when(kind == "given-f", female[0]).when(kind == "family", family[0]).otherwise("")))
    return F.when(value.rlike(r"\p{IsCyrillic}"), made("cyrillic")).when(value.rlike(r"\p{IsGreek}"), made("greek")).otherwise(made("latin"))


def _surrogate(kind: Column, value: Column, draw: Column, stream: Column) -> Column:
    octet = lambda k, low, n: (F.element_at(stream, k) % n + low).cast("string")
    reserved = F.regexp_extract(value, r"(?:^|\.)(example\.(?:com|org|net))$", 1)
    tail = F.when(reserved != "", reserved).otherwise(F.substring_index(value, ".", -1))
    head = F.substr(value, F.lit(1), F.length(value) - F.length(tail))
    longer = F.translate(F.substr(F.sha2(F.concat_ws("|", value, draw.cast("string")), 256), F.lit(1), F.greatest(draw - LENGTHEN, F.lit(0))), "abcdef", "012345")
    named = F.translate(longer, "0123456789", "abelmnorst")
    grown = F.when((head != "") & (named != ""), F.concat(named, F.lit("."))).otherwise("")  # one more label before the tail
    plain = (F.when(kind == "local", _substituted(F.substring_index(value, "@", 1), stream))
             .when(kind == "domain", F.concat(_substituted(_lettered(head), stream), grown, tail))
             .when(kind == "ip", F.concat_ws(".", octet(1, 1, 254), octet(2, 0, 256), octet(3, 0, 256), octet(4, 1, 254)))
             .when(kind == "card", _card(value, stream)).when(kind == "phone", _substituted(value, stream, F.greatest(F.length(F.regexp_extract(value, COUNTRY_CODE, 0)), F.lit(1))))
             .when(kind == "iban", _iban(value, stream))
             .when(kind.isin("given-m", "given-f", "family"), _name(kind, value, stream)).otherwise(_substituted(value, stream)))
    more = (F.when(kind.isin("given-m", "given-f", "family"), named).when(kind == "domain", F.lit(""))
            .when(kind == "ip", F.when(longer != "", F.concat(F.lit("."), longer)).otherwise("")).otherwise(longer))
    # A domain that is all tail has nothing to draw, and stays.
    return F.concat(plain, more)


def _dictionary(parts: DataFrame, key: str) -> DataFrame:
    """``kind, value, surrogate``, staged: surrogates differ from each other and from all values of their kind."""
    kind, value, draw = F.col("kind"), F.col("value"), F.col("draw")
    free = (kind == "domain") & value.rlike(r"^(?:[^.]*|example\.(?:com|org|net))$")

    def filled(entries: DataFrame) -> DataFrame:
        return (entries.withColumn("stream", _drawn(kind, value, draw, key)).withColumn("surrogate", _surrogate(kind, value, draw, F.col("stream")))
                .select("kind", "value", "draw", "surrogate"))

    now, seen = stage_observed(filled(parts.withColumn("draw", F.lit(0))), "surrogates", n=F.count(F.lit(1)))
    for _ in range(MAX_DRAWS):
        if not seen["n"]:
            return now
        first = now.groupBy("kind", "surrogate").agg(F.min("value").alias("owner"), F.count(F.lit(1)).alias("many"))
        real = now.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("real"))
        marked = (now.join(first.where("many > 1"), ["kind", "surrogate"], "left").join(real, ["kind", "surrogate"], "left")
                  .withColumn("again", ~free & (F.coalesce(value != F.col("owner"), F.lit(False)) | F.coalesce("real", F.lit(False)))))
        marked, met = stage_observed(marked.select("kind", "value", "draw", "surrogate", "again"), "marked", n=F.sum(F.col("again").cast("int")))
        if not met["n"]:
            return now
        now = stage(marked.where(~F.col("again")).select("kind", "value", "draw", "surrogate").union(
            filled(marked.where("again").select("kind", "value", (draw + 1).alias("draw")))), "surrogates")
    raise RuntimeError(f"surrogates still meet after {MAX_DRAWS} draws")


def _woven(m: Column, pattern: str) -> Callable[[Column], Column]:
    """``m`` with its ``pattern`` signs replaced one by one; surplus ones go to the end."""
    def put(surrogate: Column) -> Column:
        return F.array_join(F.zip_with(F.split(m, pattern, -1), F.split(surrogate, ""), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    return put


def _replaced(m: Column, known: Column) -> Column:
    kind = _kind(m)
    title, gender, given, family = _name_parts(m)
    get = lambda k, v: F.element_at(known, F.concat(F.lit(k) if isinstance(k, str) else k, F.lit(":"), v))
    mail = F.concat(get("local", F.lower(m)), F.lit("@"), get("domain", F.lower(F.substring_index(m, "@", -1))))
    joint = F.regexp_extract(m, r"\p{L}([ -])\p{L}+$", 1)
    return (F.when(kind == "email", F.when((m == F.upper(m)) & (m != F.lower(m)), F.upper(mail)).otherwise(mail))
            .when(kind == "name", F.concat(title, F.when(given != "", F.concat(get(gender, given), joint)).otherwise(""), get("family", family)))
            .when(kind == "phone", _woven(m, "[0-9]")(F.translate(get(kind, _dialled(m)), "+", "")))
            .when(kind.isin("card", "ssn"), _woven(m, "[0-9]")(get(kind, _digits(m))))
            .when(kind == "iban", _woven(m, "[A-Z0-9]")(get("iban", F.translate(m, " ", ""))))
            .otherwise(get(kind, m)))


def _recalled(between: Column, known: Column) -> Column:
    """Text between entities, with the names that the document gives behind a form of address replaced wherever they recur."""
    def one(word: Column) -> Column:
        return F.coalesce(*[F.element_at(known, F.concat(F.lit(f"{kind}:"), word)) for kind in ("family", "given-m", "given-f")], word)
    words, gaps = F.regexp_extract_all(between, F.lit(WORD), F.lit(0)), F.split(between, WORD, -1)
    return F.array_join(F.zip_with(gaps, F.transform(words, one), lambda gap, word: F.concat(gap, F.coalesce(word, F.lit("")))), "")


def pseudonymise(docs: DataFrame, *, text: str = "text", key: str | None = None, count_into: str | None = None) -> DataFrame:
    """``docs`` with all entities in ``text`` replaced, and how many there were in ``count_into`` if that is named.

    Found are e-mail addresses, IPv4 addresses, social security and bank account numbers, telephone and card numbers,
    long keys of letters and digits, and names behind a form of address; such a name is also replaced where the same text
    has its words again without one.  ``key`` is the caller's secret, by default that of the session setting
    ``KEY_SETTING``.  Whole texts are searched, however long.  Null texts stay null and empty ones empty; texts
    without entities keep every byte.  Surrogates depend on ``key`` and the entities of the table only, so repeated rows
    stay equal.  Other columns are kept; a column named like ``count_into`` is replaced.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, KEY)
    columns = [c for c in docs.columns if c != count_into]
    taken = {c.lower() for c in docs.columns}
    row, found, known = (next(n for n in (f"{x}{k}" for k in range(len(taken) + 1)) if n.lower() not in taken) for x in ("row_", "found_", "known_"))
    marked = stage(docs.select(*columns, F.coalesce(F.regexp_extract_all(F.col(text), F.lit(ENTITY), F.lit(0)), F.array().cast("array<string>")).alias(found))
                   .withColumn(row, F.monotonically_increasing_id()), "entities")
    with_some = marked.where(F.size(found) > 0)
    mentions = stage(with_some.select(row, F.explode(F.array_distinct(F.flatten(F.transform(found, _parts)))).alias("part"))
                     .select(row, "part.kind", "part.value"), "mentions")
    names = _dictionary(mentions.select("kind", "value").distinct(), key)
    by_row = (mentions.join(names, ["kind", "value"]).groupBy(row)
              .agg(F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.lit(":"), "value"), F.col("surrogate")))).alias(known)))
    new = F.transform(F.col(found), lambda m: _replaced(m, F.col(known)))
    named = F.exists(F.map_keys(F.col(known)), lambda k: k.startswith("family:"))
    between = F.split(F.col(text), ENTITY, -1)
    between = F.when(named, F.transform(between, lambda b: _recalled(b, F.col(known)))).otherwise(between)
    whole = F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    extra = [F.size(found).cast("bigint").alias(count_into)] if count_into else []
    pick = lambda t: [t.alias(text) if c == text else F.col(c) for c in columns] + extra
    return (marked.where(F.size(found) == 0).select(*pick(F.col(text)))
            .union(with_some.join(by_row, row).select(*pick(whole))))
