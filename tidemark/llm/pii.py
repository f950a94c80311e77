"""Operator 8: surrogates for personal data, in column functions only.

Entities found in a text are replaced by keyed surrogates of the same kind and format: a
card keeps its issuer digit, grouping and a valid check digit, a phone number its country
code and punctuation, an address in e-mail its pattern of letters and digits, an account
number its country, a name its title (and so the gender), particles, number of words, case
and script. What is replaced is *parts*: a name's surname and its given names one by one,
anything else as a whole. A part's surrogate depends on the secret key, its kind and its
normalised value alone, so mentions of it agree in whatever punctuation, under whatever
title and beside whatever given name ("Mr John Brown", "Mister Brown"), and so do North
American numbers with and without +1.

Surrogates are checked over the whole corpus before any text is rewritten: two parts of a
kind may not share one, and none may equal a part that occurs. Parts that fail are derived
again with a higher attempt number until none fails; surrogates get longer with the
attempts, so there are always enough. Rewriting is local to a row; only if some part needs
a later attempt are those parts joined to the texts that hold them. What is shuffled is
parts, not texts.
"""

from __future__ import annotations

from itertools import count
from math import ceil

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch
from .spans import let, scan

# Titles by gender and script; names and syllables that surrogates are made of.
TITLES = {
    ("f", "latin"): ("Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Sra", "Madame", "Mme", "Mademoiselle"),
    ("m", "latin"): ("Mr", "Mister", "Sir", "Herr", "Señor", "Monsieur"),
    ("f", "cyrillic"): ("г-жа", "Госпожа", "госпожа"),
    ("m", "cyrillic"): ("г-н", "Господин", "господин"),
    ("n", "latin"): ("Dr", "Doctor", "Doktor", "Professor", "Prof", "Rev"),
    ("n", "cyrillic"): ("д-р", "Доктор", "доктор", "Профессор", "профессор"),
}
GIVEN = {
    ("f", "latin"): ("Alma", "Berta", "Clara", "Dora", "Edith", "Flora", "Greta", "Helga", "Irma", "Julia", "Karla", "Lena", "Marta", "Nora", "Olga", "Paula"),
    ("m", "latin"): ("Albert", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jakob", "Kurt", "Leo", "Martin", "Oskar", "Paul", "Robert"),
    ("f", "cyrillic"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Лидия"),
    ("n", "latin"): ("Alexis", "Andrea", "Chris", "Dominique", "Jamie", "Kim", "Maxime", "Robin"),
    ("n", "cyrillic"): ("Саша", "Женя", "Валя", "Слава"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Игорь"),
}
SYLLABLES = {
    "latin": ("ba", "be", "do", "fa", "ga", "ke", "la", "lo", "ma", "ne", "ri", "ro", "sa", "ta", "vi", "zo"),
    "cyrillic": ("ба", "бе", "до", "фа", "га", "ке", "ла", "ло", "ма", "не", "ри", "ро", "са", "та", "ви", "зо"),
}

_titles = "|".join(t for ts in TITLES.values() for t in ts)
#: One title or several ("Herr Dr.").
TITLE = rf"(?:{_titles})(?!\p{{L}})\.?(?: (?:{_titles})(?!\p{{L}})\.?){{0,3}}"
_small = "(?:(?:van|von|vom|zu|zum|zur|der|den|ter|ten|de|del|della|di|da|dos|du|la|le|bin|ibn|al) ){0,3}"
_word = r"\p{Lu}(?:['’]\p{Lu})?\p{L}+(?:-\p{L}+|['’](?!S(?!\p{L}))\p{Lu}\p{L}*){0,5}"
_part = rf"(?:\p{{Lu}}\.(?= ?\p{{Lu}})|{_small}{_word})"
_octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: Kinds in order of precedence at the same place.
PATTERNS = {
    # possessive loops: a greedy loop over a group takes a stack frame a turn
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9.])(?:{_octet}\.){{3}}{_octet}(?![0-9]|\.[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    # three, three and four digits with or without a country code; any grouping after +; ten digits
    "phone": r"(?<![0-9A-Za-z+])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}|\+[1-9](?:[ .()-]{0,2}[0-9]){7,14}|(?<![.,])[2-9][0-9]{9})(?![0-9A-Za-z])",
    "name": rf"(?<!\p{{L}}){TITLE} {_part}(?:(?: |(?<=\.))(?!(?:{_titles})(?!\p{{L}})){_part}){{0,3}}",
}
EVERY = "|".join(f"(?:{p})" for p in PATTERNS.values())
INITIAL = r"^\p{Lu}\.$"
#: Texts without a match of this cheap pattern hold no entity.
GATE = rf"(?=[@0-9A-ZГгДдПп])(?:@|[0-9][0-9 .()-]{{3,}}[0-9]|[A-Z]{{2}}[0-9]{{2}}|(?:{_titles})\.? \p{{L}})"
#: Country codes (a number's own, whether a separator follows or not).
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3})"
#: The attempt from which surrogates get longer, whatever their format; parts of a task while surrogates are checked.
LONGER, PARTS = 4, 2_000


def kind_of(m: Column) -> Column:
    """The first kind whose pattern matches all of ``m`` (its surroundings were checked)."""
    out = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def words_of(m: Column) -> Column:
    """The words of a name after its title; the last one is the surname."""
    rest = F.trim(F.regexp_replace(m, rf"^{TITLE}", ""))
    return F.split(F.regexp_replace(rest, r"(\p{Lu}\.)(?=\p{Lu})", "$1 "), " ")


def parts_of(kind: Column, m: Column) -> Column:
    """array<struct<kind, norm, mention>>: what a mention consists of. A name's words are
    ``surname``, ``given-`` with the title's gender, ``initial`` or ``particle``."""
    title = F.regexp_extract(m, rf"^({_titles})(?!\p{{L}})", 1)
    gender = F.lit("n")
    for g in ("f", "m"):
        gender = F.when(title.isin(*[t for (x, _), ts in TITLES.items() if x == g for t in ts]), g).otherwise(gender)

    def named(words: Column, g: Column) -> Column:
        def role(w: Column, i: Column) -> Column:
            return F.when(w.rlike(INITIAL), "initial").when(i == F.size(words) - 1, "surname").when(w.rlike(r"^\p{Ll}"), "particle").otherwise(F.concat(F.lit("given-"), g))

        return F.transform(words, lambda w, i: F.struct(role(w, i).alias("kind"), F.lower(w).alias("norm"), w.alias("mention")))

    whole = F.array(F.struct(kind.alias("kind"), normal(kind, m).alias("norm"), m.alias("mention")))
    return F.when(kind == "name", let(F.struct(words_of(m).alias("w"), gender.alias("g")), lambda x: named(x["w"], x["g"]))).otherwise(whole)


def normal(kind: Column, m: Column) -> Column:
    """What mentions of one part agree in."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    return (
        F.when(kind == "email", F.lower(m))
        .when(kind == "ip", m)
        .when(kind == "iban", F.replace(m, F.lit(" "), F.lit("")))
        .when((kind == "phone") & m.startswith("+1") & (F.length(digits) == 11), F.substring(digits, 2, 10))
        .when(kind.isin("ssn", "card", "phone"), digits)
        .otherwise(F.lower(m))
    )


def _number(h: Column, at: int | Column, size: int = 8) -> Column:
    return F.conv(F.substring(h, F.lit(at) if isinstance(at, int) else at, F.lit(size)), 16, 10).cast("long")


def _of(words: tuple[str, ...], n: Column) -> Column:
    return F.array(*map(F.lit, words))[F.pmod(n, F.lit(len(words))).cast("int")]


def _digits(h: Column) -> Column:
    """64 digits."""
    return F.translate(h, "abcdef", "271828")


def _same_pattern(m: Column, h: Column) -> Column:
    """``m`` with its letters and digits replaced in place; other characters stay. The
    stream of replacements runs over all characters."""
    big, small, digit = F.translate(h, "0123456789abcdef", "QWERTZPASDFGHJKL"), F.translate(h, "0123456789abcdef", "qwertzpasdfghjkl"), _digits(h)

    def replaced(x: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            pick = lambda s: F.substring(s, F.pmod(i, F.lit(64)) + 1, F.lit(1))
            return F.when((c >= "0") & (c <= "9"), pick(x["digit"])).when((c >= "A") & (c <= "Z"), pick(x["big"])).when((c >= "a") & (c <= "z"), pick(x["small"])).otherwise(c)

        return F.array_join(F.transform(F.split(x["m"], ""), one), "")

    return let(F.struct(m.alias("m"), big.alias("big"), small.alias("small"), digit.alias("digit")), replaced)


def _respaced(m: Column, plain: Column) -> Column:
    """``plain`` with the spaces that ``m`` has; for strings of tens of characters."""
    gaps = F.transform(F.split(m, " "), lambda x: F.length(x))
    out = F.aggregate(gaps, F.struct(F.lit(1).alias("at"), F.lit("").alias("out")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.when(a["at"] > 1, " ").otherwise(""), F.substring(plain, a["at"], n)).alias("out")))
    return F.concat(out["out"], F.substring(plain, out["at"], F.length(plain)))


def _filled(m: Column, digits: Column) -> Column:
    """``m`` with its n-th digit replaced by the n-th of ``digits``."""
    return F.array_join(
        F.transform(F.split(m, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, F.length(F.regexp_replace(F.substring(m, F.lit(1), i + 1), "[^0-9]", "")), F.lit(1))).otherwise(c)), ""
    )


def _luhn(body: Column) -> Column:
    """The check digit after ``body``."""
    n = F.length(body)
    one = lambda i: (F.substring(body, i, F.lit(1)).cast("int") * F.when(F.pmod(n - i, F.lit(2)) == 0, 2).otherwise(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + one(i) - F.when(one(i) > 9, 9).otherwise(0))
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def _word(kind: Column, m: Column, h: Column, attempt: Column) -> Column:
    """A surname or given name in the script and case of ``m``, longer from attempt to
    attempt (five syllables and one for each attempt, twelve at most for a given name's)."""
    cyrillic = m.rlike(r"\p{IsCyrillic}")

    def made(script: str) -> Column:
        syllables = lambda n: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: _of(SYLLABLES[script], _number(h, i * 2 + 9, 2))), "")
        given = F.lit(None).cast("string")
        for g in ("f", "m", "n"):
            given = F.when(kind == f"given-{g}", F.concat(_of(GIVEN[g, script], _number(h, F.lit(1))), syllables(F.least(attempt + 2, F.lit(20))))).otherwise(given)
        return F.initcap(F.when(kind == "surname", syllables(F.least(attempt + 5, F.lit(24)))).otherwise(given))

    word = F.when(cyrillic, made("cyrillic")).otherwise(made("latin"))
    letters = F.array(*[F.lit(x) for x in "ABCDEFGHIKLMNOPRSTUVWZ"])
    one = F.when(cyrillic, _of(tuple("АБВГДЕЖЗИКЛМНОПРСТ"), _number(h, F.lit(1)))).otherwise(letters[F.pmod(_number(h, F.lit(1)), F.lit(22)).cast("int")])
    loud = (F.length(m) > 2) & (F.upper(m) == m)
    return F.when(kind == "initial", F.concat(one, F.lit("."))).when(loud, F.upper(word)).otherwise(word)


def keyed(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """What an entity's surrogate is made from."""
    return F.sha2(F.concat_ws("\u0001", F.lit(key), kind, norm, attempt.cast("string"), F.lit(key)), 256)


def surrogate(kind: Column, norm: Column, mention: Column, h: Column, attempt: Column) -> Column:
    """The surrogate of a part, in the format of ``mention``, from its ``keyed`` hash. From
    attempt ``LONGER`` on the formats have too few values: more digits are appended."""
    d = _digits(h)
    octets = F.concat_ws(".", *[(F.pmod(_number(h, at), F.lit(223 if at == 1 else 254)) + 1).cast("string") for at in (1, 9, 17, 25)])
    local, host = F.substring_index(mention, "@", 1), F.substring_index(mention, "@", -1)
    labels = F.size(F.split(host, r"\."))
    domain = F.when(labels > 2, F.concat(F.lit("m"), F.substring(h, 1, 8), F.lit(".example.net"))).otherwise(F.concat(F.lit("m"), F.substring(h, 1, 8), F.lit(".example")))
    head = F.regexp_extract(mention, COUNTRY, 0)
    tail = F.substring(mention, F.length(head) + 1, F.length(mention))
    size = F.length(norm)
    body = F.concat(F.substring(norm, 1, 1), F.substring(d, F.lit(1), size - 2))
    more = F.when(attempt >= LONGER, F.substring(d, F.lit(33), F.least(attempt - LONGER + 2, F.lit(30)))).otherwise("")
    made = (
        F.when(kind == "email", F.concat(_same_pattern(local, F.concat(F.substring(h, 9, 56), F.substring(h, 1, 8))), more, F.lit("@"), domain))
        .when(kind == "ip", octets)
        .when(kind == "iban", F.concat(F.substring(mention, 1, 2), _respaced(F.substring(mention, F.lit(3), F.length(mention)), _same_pattern(F.substring(norm, F.lit(3), F.length(norm)), h))))
        .when(kind == "ssn", _filled(mention, F.concat(F.lit("9"), d)))
        .when(kind == "card", _filled(mention, F.concat(body, _luhn(body))))
        .when(kind == "phone", F.concat(head, _filled(tail, F.concat((F.pmod(_number(h, 57), F.lit(8)) + 2).cast("string"), d))))
        .otherwise(_word(kind, mention, h, attempt))
    )
    longer = F.concat(made, F.when(kind.isin("ip", "iban", "ssn", "card", "phone"), more).otherwise(""))
    return F.when(kind == "particle", mention).when(attempt >= LONGER, longer).otherwise(made)


def rewritten(mention: Column, kind: Column, words: Column) -> Column:
    """A mention with its parts' surrogates."""
    return F.when(kind == "name", F.concat_ws(" ", F.regexp_extract(mention, f"^{TITLE}", 0), F.array_join(words, " "))).otherwise(words[0])


def _pieces(text: Column) -> tuple[Column, Column]:
    some = text.rlike(GATE)
    empty = F.array().cast("array<string>")
    return F.when(some, F.regexp_extract_all(text, F.lit(EVERY), F.lit(0))).otherwise(empty), F.when(some, F.split(text, EVERY, -1)).otherwise(F.array(text))


#: Parts that need no surrogate of their own.
SHARED = ("initial", "particle")


def marked(matches: Column) -> Column:
    """array<struct<kind, m, parts>> of the mentions."""
    return F.transform(matches, lambda m: let(kind_of(m), lambda k: F.struct(k.alias("kind"), m.alias("m"), parts_of(k, m).alias("parts"))))


def entities(docs: DataFrame) -> DataFrame:
    """Distinct (kind, norm) of the parts in all texts, with one mention."""
    found, _ = _pieces(F.coalesce(F.col("text").cast("string"), F.lit("")))
    m = docs.select(F.explode(F.flatten(F.transform(marked(found), lambda x: x["parts"]))).alias("x")).select("x.*")
    return m.where(~F.col("kind").isin(*SHARED)).groupBy("kind", "norm").agg(F.min("mention").alias("mention"))


def checked(found: DataFrame, key: str, scratch: Scratch) -> DataFrame | None:
    """(kind, norm, attempt) of the parts whose first surrogates fail the check, or None.

    Each round derives again what shares a surrogate with a smaller norm or hits a part
    that occurs. Surrogates get longer with the attempts, so rounds end."""
    spark = found.sparkSession
    seen = Observation()
    found = scratch.table(found.observe(seen, F.count(F.lit(1)).alias("n")), "entities")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(seen.get["n"] / PARTS))

    def derived(df: DataFrame) -> DataFrame:
        """With ``made``, what the surrogate's mentions agree in; dealt evenly, few rows or many."""
        df = df.repartition(tasks, "kind", "norm")
        made = let(keyed(F.col("kind"), F.col("norm"), F.col("attempt"), key), lambda h: surrogate(F.col("kind"), F.col("norm"), F.col("mention"), h, F.col("attempt")))
        return df.select("kind", "norm", "mention", "attempt", made.alias("made")).withColumn("made", normal(F.col("kind"), F.col("made")))

    state = scratch.table(derived(found.withColumn("attempt", F.lit(0))), "made-0")
    for i in count(1):
        groups = state.groupBy("kind", "made").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "norm")).alias("first"))
        real = groups.join(found.select("kind", F.col("norm").alias("made")), ["kind", "made"], "left_semi").select("kind", "made", F.lit(True).alias("real"))
        bad = groups.join(real, ["kind", "made"], "left").where("n > 1 or real").select("kind", "made", F.coalesce("real", F.lit(False)).alias("real"), F.col("first.norm").alias("first"))
        bad = scratch.table(bad, f"bad-{i}")
        if bad.isEmpty():
            later = state.where("attempt > 0").select("kind", "norm", "attempt")
            return None if later.isEmpty() else later
        again = state.join(bad, ["kind", "made"], "left").withColumn("more", F.coalesce(F.col("real") | (F.col("norm") != F.col("first")), F.lit(False)))
        again = scratch.table(again.select("kind", "norm", "mention", "attempt", "made", "more"), f"again-{i}")
        moved = derived(again.where("more").select("kind", "norm", "mention", (F.col("attempt") + 1).alias("attempt")))
        state = scratch.table(again.where("not more").drop("more").unionByName(moved), f"made-{i}")


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_entities, kinds, spans) for every row of ``docs(doc_id, text)``.

    ``text`` has every detected entity replaced; ``kinds`` are the kinds found (distinct,
    sorted, comma-joined) and ``spans`` kind:start:end of what was replaced in the original
    text (code points, ends exclusive, comma-joined). Texts without entities are returned
    unchanged, null as null. Equal rows give equal results; other columns are not read."""
    scratch = Scratch(docs.sparkSession, "pii")
    later = checked(entities(docs), key, scratch)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    matches, between = _pieces(F.coalesce("text", F.lit("")))
    d = d.select("doc_id", "text", marked(matches).alias("marked"), between.alias("between"))
    attempt = lambda p: F.lit(0)
    if later is not None:
        of = F.concat_ws("\u0001", "kind", "norm")
        held = d.select(F.xxhash64("text").alias("h"), F.explode(F.flatten(F.transform("marked", lambda x: x["parts"]))).alias("x")).select("h", "x.kind", "x.norm").distinct()
        maps = held.join(later, ["kind", "norm"]).groupBy("h").agg(F.map_from_entries(F.collect_set(F.struct(of, "attempt"))).alias("attempts"))
        d = d.withColumn("h", F.xxhash64("text")).join(maps, "h", "left")
        attempt = lambda p: F.coalesce(F.try_element_at("attempts", F.concat_ws("\u0001", p["kind"], p["norm"])), F.lit(0))

    def part(p: Column) -> Column:
        made = lambda a: let(keyed(p["kind"], p["norm"], a, key), lambda h: surrogate(p["kind"], p["norm"], p["mention"], h, a))
        return made(F.lit(0)) if later is None else let(attempt(p), made)

    made = F.transform("marked", lambda x: F.struct(x["kind"].alias("kind"), F.length(x["m"]).alias("size"), rewritten(x["m"], x["kind"], F.transform(x["parts"], part)).alias("made")))
    d = d.select("doc_id", "text", F.when(F.size("marked") > 0, F.zip_with("between", made, lambda b, x: F.struct(b.alias("b"), x.alias("x")))).alias("pairs"))

    def result(pairs: Column) -> Column:
        text = F.array_join(F.flatten(F.transform(pairs, lambda p: F.array(p["b"], F.coalesce(p["x"]["made"], F.lit(""))))), "")
        some = F.filter(pairs, lambda p: p["x"].isNotNull())
        end = lambda at, p: at + F.length(p["b"]) + p["x"]["size"]
        spans = scan(some, F.lit(0), end, lambda at, p: F.concat_ws(":", p["x"]["kind"], (at + F.length(p["b"])).cast("string"), end(at, p).cast("string")), "array<string>")
        kinds = F.array_join(F.array_sort(F.array_distinct(F.transform(some, lambda p: p["x"]["kind"]))), ",")
        return F.struct(text.alias("text"), F.size(some).cast("long").alias("n"), kinds.alias("kinds"), F.array_join(spans, ",").alias("spans"))

    d = d.withColumn("r", F.when(F.col("pairs").isNotNull(), let(F.col("pairs"), result)))
    return d.select("doc_id", F.coalesce("r.text", "text").alias("text"), F.coalesce("r.n", F.lit(0)).alias("n_entities"), F.coalesce("r.kinds", F.lit("")).alias("kinds"), F.coalesce("r.spans", F.lit("")).alias("spans"))
