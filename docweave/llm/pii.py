"""Surrogates for personal data and secrets, in DataFrame functions only.

Found entities are reduced to canonical forms (a phone number to its digits, an address to lower case), so that
every spelling of an entity gets the same surrogate. A surrogate is drawn from keyed SHA-512 digests of type
and canonical form, letter for letter and digit for digit; names keep their gender and script. A name behind a title or a
label is replaced word by word, each word by its own surrogate, and so are all other mentions of these words, alone or together,
in capitals too, in the same document: 'Mr. John Smith', 'John Smith' and 'SMITH' stay one person. Two
entities never share a surrogate and none is an entity of the corpus itself: those that collide draw again until
all differ. Only documents with entities are shuffled: every place of an entity is a row of its own, joined with the
table of surrogates and put back by its position, so a document with very many entities costs no more for each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.markdown import let
from docweave.functions.session import release, spool

#: What counts as an entity. First match wins at a place. Groups that repeat without bound take one character a time, which the engine does without recursion.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-](?:(?!\.\.)[A-Za-z0-9.-])*\.[A-Za-z]{2,}",
    "secret": r"""(?<=[=:\s"'])(?<=(?i:password|passwd|pwd|secret|token|api_key|apikey)\s{0,2}[=:]\s{0,2}["']?)(?=[+/_.-]*[A-Za-z0-9])[A-Za-z0-9+/_.-]{8,}""",
    "key_id": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![A-Za-z0-9])(?:\d{4}[ -]?){3}\d{1,7}(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?![A-Za-z0-9])",
    "name_m": r"(?=\p{Lu})(?<= )(?<=(?<![\p{L}])(?:Mr\.? |Herr |Señor |Monsieur |Господин |Κύριος |Κύριε ))\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?",
    "name_f": r"(?=\p{Lu})(?<= )(?<=(?<![\p{L}])(?:Mrs\.? |Ms\.? |Miss |Frau |Señora |Madame |Госпожа |Κυρία ))\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?",
    "name_n": r"(?=\p{Lu})(?<= )(?<=(?<![\p{L}])(?:Dr\.? |Prof\.? |Professor |Dear |[Mm]y name is |(?:Name|Author|Contact|Signed)(?: by)?: ))\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?",
}
NAMES = ("name_m", "name_f", "name_n")
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Titles before a name and heads of key ids; without one of them, and without any of the characters below, no pattern can match.
HONORIFICS = ("Mr", "Ms", "Miss ", "Herr ", "Frau ", "Señor", "Monsieur ", "Madame ", "Господин ", "Госпожа ", "Κύρι", "Κυρία ", "Dr", "Prof", "Dear ", "y name is ")
KEY_HEADS = ("AKIA", "ASIA")
HINT = "[0-9@=:]"
#: Syllables and endings of made-up names by script, endings by gender.
SYLLABLES = {
    "latin": ("ba", "be", "da", "do", "fe", "ga", "ka", "le", "lo", "ma", "mi", "na", "ne", "ra", "ro", "so"),
    "cyrillic": ("ба", "бе", "да", "до", "фе", "га", "ка", "ле", "ло", "ма", "ми", "на", "не", "ра", "ро", "со"),
    "greek": ("βα", "βε", "δα", "δο", "φε", "γα", "κα", "λε", "λο", "μα", "μι", "να", "νε", "ρα", "ρο", "σο"),
    "armenian": ("բա", "բե", "դա", "դո", "ֆե", "գա", "կա", "լե", "լո", "մա", "մի", "նա", "նե", "րա", "րո", "սո"),
}
ENDINGS = {
    ("latin", "name_m"): "rton", ("latin", "name_f"): "lina", ("cyrillic", "name_m"): "рин", ("cyrillic", "name_f"): "рина",
    ("greek", "name_m"): "νης", ("greek", "name_f"): "νια", ("armenian", "name_m"): "րեն", ("armenian", "name_f"): "նիկ",
}
#: A capitalised word, or one in capitals: where a name may be mentioned again.
MENTION = r"(?<![\p{L}\p{N}_])(?:\p{Lu}\p{Ll}++|\p{Lu}{2,}+)(?![\p{L}\p{N}_])"


def entity_type(value: Column) -> Column:
    """The type of a found value; what follows a secret's label and has no form of its own is a secret."""
    out = F.lit("secret")
    whole = {k: p for k, p in PATTERNS.items() if k not in ("secret", "name_m", "name_f", "name_n")}
    for kind, pattern in reversed(whole.items()):
        out = F.when(value.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def canonical(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, r"[^0-9]", "")
    tight = F.upper(F.regexp_replace(value, " ", ""))
    return F.when(kind.isin("phone", "card", "ssn"), digits).when(kind == "email", F.lower(value)).when(kind == "iban", tight).otherwise(value)


def may_hold(text: Column) -> Column:
    """A cheap first test of a text."""
    out = text.rlike(HINT)
    for h in (*HONORIFICS, *KEY_HEADS):
        out = out | text.contains(h)
    return out


def stream(key: str, kind: Column, canon: Column, attempt: Column, n: Column) -> Column:
    """n keyed numbers from 0 to 255 for a canonical form, without limit of length; the form is hashed once, and each block of 64 numbers is a hash of that."""
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string")).cast("binary"), 512)
    blocks = let(seed, lambda h: F.transform(F.sequence(F.lit(0), F.floor(n / 64).cast("int")), lambda i: F.sha2(F.concat_ws("\x1f", h, i.cast("string")).cast("binary"), 512)))
    number = lambda b, i: F.conv(F.substring(F.get(b, F.floor(i / 64).cast("int")), i % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return let(blocks, lambda b: F.transform(F.sequence(F.lit(0), n - 1), lambda i: number(b, i)))


def like(chars: Column, numbers: Column) -> Column:
    """Letter for letter, digit for digit; other characters stay. Hexadecimal texts stay hexadecimal."""
    pick = lambda letters, n: F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1))
    one = lambda c, n, is_hex: (
        F.when(c.rlike("^[0-9]$"), pick("0123456789", n))
        .when(c.rlike("^[a-z]$"), F.when(is_hex, pick("abcdef", n)).otherwise(pick("abcdefghijklmnopqrstuvwxyz", n)))
        .when(c.rlike("^[A-Z]$"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n))
        .otherwise(c)
    )
    whole = let(
        F.struct(chars.alias("c"), numbers.alias("n"), F.array_join(chars, "").rlike("^[0-9a-f]+$").alias("hex")),
        lambda v: F.zip_with(v["c"], v["n"], lambda c, n: F.when(c.isNotNull(), one(c, n, v["hex"]))),
    )
    return F.array_join(whole, "")


def luhn_sum(digits: Column, shift: int) -> Column:
    """Luhn sum of a digit string; shift 1: as if one more digit stood behind it."""
    d = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    step = lambda c, i: F.when((i + shift) % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(d, step), F.lit(0), lambda a, x: a + x)


def remainder(text: Column) -> Column:
    """The text as a number, letters counting as 10 to 35, modulo 97: what the check digits of an account number rest on."""
    code = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), code)
    return F.aggregate(codes, F.lit(0), lambda a, x: F.when(x < 10, a * 10 + x).otherwise(a * 100 + x) % 97)


def surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The canonical form of the replacement. Forms with few values grow with the attempt, so that every entity finds one of its own."""
    more = F.when(kind.isin("secret", "email", "phone"), F.greatest(attempt - 3, F.lit(0))).otherwise(0)
    padded = F.when(kind == "email", F.concat(F.repeat(F.lit("0"), more), canon)).otherwise(F.concat(canon, F.repeat(F.lit("0"), more)))
    chars = F.filter(F.split(padded, ""), lambda c: c != "")
    numbers = stream(key, kind, canon, attempt, F.length(padded) + 8 + attempt)
    drawn = let(F.struct(chars.alias("chars"), numbers.alias("n")), lambda v: F.struct(like(v["chars"], F.slice(v["n"], F.lit(1), F.size(v["chars"]))).alias("plain"), v["n"].alias("n")))
    return let(drawn, lambda v: formed(kind, canon, v["plain"], v["n"], attempt))


def formed(kind: Column, canon: Column, plain: Column, numbers: Column, attempt: Column) -> Column:
    """The drawn characters in the form of the type; names have a syllable more for each attempt."""
    at = lambda i: F.element_at(numbers, i)
    ip = F.concat_ws(".", *[(at(i) % 254 + 1).cast("string") for i in (1, 2, 3, 4)])
    domain = F.concat(F.substring_index(F.substring_index(plain, "@", -1), ".", 1), F.lit(".example"))
    email = F.concat(F.substring_index(plain, "@", 1), F.lit("@"), domain)
    body = F.substring(plain, F.lit(1), F.length(plain) - 1)
    check = F.pmod(10 - luhn_sum(body, 1) % 10, F.lit(10)).cast("string")
    card = F.when(luhn_sum(canon, 0) % 10 == 0, F.concat(body, check)).otherwise(plain)
    country = F.greatest(F.length(canon) - 10, F.lit(0))
    phone = F.concat(F.substring(canon, F.lit(1), country), F.substring(plain, country + 1, F.length(plain)))
    key_id = F.concat(F.substring(canon, 1, 4), F.substring(plain, F.lit(5), F.length(plain)))
    account = F.substring(plain, F.lit(5), F.length(plain))
    checked = F.lpad((98 - remainder(F.concat(account, F.substring(canon, 1, 2), F.lit("00")))).cast("string"), 2, "0")
    iban = F.concat(F.substring(canon, 1, 2), checked, account)
    script, table = F.lit("latin"), F.array(*map(F.lit, SYLLABLES["latin"]))
    for s in SYLLABLES:
        if s != "latin":
            own = canon.rlike(rf"\p{{Is{s.capitalize()}}}")
            script, table = F.when(own, s).otherwise(script), F.when(own, F.array(*map(F.lit, SYLLABLES[s]))).otherwise(table)
    said = lambda n: F.element_at(table, n % 16 + 1)
    syllable = lambda i: said(at(i))
    longer = F.array_join(F.transform(F.slice(numbers, F.lit(7), attempt), said), "")
    ending = F.coalesce(*[F.when((script == s) & (kind == k), F.lit(e)) for (s, k), e in ENDINGS.items()], F.concat(syllable(3), syllable(4)))
    name = F.initcap(F.concat(syllable(1), syllable(2), longer, ending))
    forms = {"ip": ip, "email": email, "card": card, "phone": phone, "key_id": key_id, "iban": iban, "name_m": name, "name_f": name, "name_n": name}
    out = plain
    for k, form in forms.items():
        out = F.when(kind == k, form).otherwise(out)
    return out


def written_like(kind: Column, value: Column, canon: Column) -> Column:
    """The surrogate in the spelling of the found value: digits into the places of its digits, case as found."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    nth = lambda i, keep: F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), keep, ""))
    rest = F.substring(canon, F.length(F.regexp_replace(value, "[^0-9]", "")) + 1, F.length(canon))  # of a form that grew
    spaced = lambda keep, inside: F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(inside), F.substring(canon, nth(i, keep), F.lit(1))).otherwise(c)), "")
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.concat(spaced("[^0-9]", "^[0-9]$"), rest))
        .when(kind == "iban", spaced(" ", "^[^ ]$"))
        .when((kind == "email") & value.rlike("^[^a-z]+$"), F.upper(canon))
        .otherwise(canon)
    )


def name_words(names: DataFrame) -> DataFrame:
    """(kind, word) of the words of found names (kind, value): the gender of a word's first names, else of its last names; 'name_n' for both."""
    words = F.split("value", " ")
    each = names.select("kind", (F.size(words) > 1).alias("two"), F.posexplode(words).alias("at", "word"))
    first = F.col("two") & (F.col("at") == 0)
    genders = each.groupBy("word").agg(F.collect_set(F.when(first, F.col("kind"))).alias("first"), F.collect_set(F.when(~first, F.col("kind"))).alias("last"))
    own = F.when(F.size("first") > 0, F.col("first")).otherwise(F.col("last"))
    return genders.select(F.when(F.size(own) > 1, "name_n").otherwise(F.element_at(own, 1)).alias("kind"), "word")


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """(value, kind, replacement) for found (kind, value): keyed, distinct, the same for all spellings of an entity; written.

    Names are drawn word by word; the words stand in the result too, as kind `word`. Entities whose surrogates meet, or meet an entity of the
    corpus, draw again; the smallest keeps its own. Forms of few values grow with each draw, so the draws end.
    """
    is_name = F.col("kind").startswith("name")
    found = spool(found, "found")
    names = found.where(is_name).distinct()
    forms = spool(found.where(~is_name).distinct().withColumn("canon", canonical(F.col("kind"), F.col("value"))).unionByName(name_words(names).select("kind", F.col("word").alias("value"), F.col("word").alias("canon"))), "forms")
    open_ = forms.select("kind", "canon").distinct().withColumn("attempt", F.lit(0))
    canons = forms.select(F.col("canon").alias("taken")).distinct()
    settled, rounds = None, []
    while True:
        drawn = open_.withColumn("surrogate", surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt")))
        first = drawn.groupBy("surrogate").agg(F.min(F.struct("canon", "kind")).alias("owner"))
        judged = drawn.join(first, "surrogate").join(canons, F.col("surrogate") == F.col("taken"), "left")
        if settled is not None:
            judged = judged.join(settled.select(F.col("surrogate").alias("used")), F.col("surrogate") == F.col("used"), "left")
        else:
            judged = judged.withColumn("used", F.lit(None).cast("string"))
        good = F.col("taken").isNull() & F.col("used").isNull() & (F.col("owner") == F.struct("canon", "kind"))
        judged = spool(judged.select("kind", "canon", "attempt", "surrogate", F.coalesce(good, F.lit(False)).alias("good")), "drawn")
        rounds.append(judged)
        fine = judged.where("good").select("kind", "canon", "surrogate")
        settled = fine if settled is None else settled.unionByName(fine)
        again = judged.where("not good")
        if again.isEmpty():
            break
        open_ = again.select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
    rest = forms.where(~is_name).join(settled, ["kind", "canon"]).select("value", "kind", written_like(F.col("kind"), F.col("value"), F.col("surrogate")).alias("replacement"))
    words = settled.where(is_name).select(F.col("canon").alias("word"), "surrogate")
    each = names.select("kind", "value", F.posexplode(F.split("value", " ")).alias("at", "word")).join(words, "word")
    whole = each.groupBy("value", "kind").agg(F.array_sort(F.collect_list(F.struct("at", "surrogate"))).alias("w"))
    out = rest.unionByName(whole.select("value", "kind", F.array_join(F.col("w.surrogate"), " ").alias("replacement")))
    out = spool(out.unionByName(words.select(F.col("word").alias("value"), F.lit("word").alias("kind"), F.col("surrogate").alias("replacement"))), "surrogates")
    release(found, forms, *rounds)
    return out


def replace_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = "docweave") -> DataFrame:
    """Replace every entity in `text_col` by its surrogate; adds n_entities (places replaced; words of a name side by side are one place).

    All other columns and rows stay as they are, whatever they are called, but for an input column n_entities, which is
    replaced. Rows count by themselves: null and repeated ids, and repeated rows, are treated by their own text; `id_col` is not
    looked at. Null and empty texts stay as they are, with 0 entities. Texts of any length are read whole, and cost in
    proportion to their entities. An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c != "n_entities"]
    base = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at = f"c{names.index(text_col)}"
    text = F.col(at)
    marked = base.withColumn("found", F.when(may_hold(text), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    has = F.coalesce(F.size("found") > 0, F.lit(False))
    clean = marked.where(~has).drop("found").withColumn("n", F.lit(0))
    named = [F.array_distinct(F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))).alias(k) for k in NAMES]
    # written: the numbers of the rows hold from here on
    dirty = spool(marked.where(has).select("*", *named, F.monotonically_increasing_id().alias("row")), "with-entities")
    is_name = F.size(F.flatten(F.array(*NAMES))) > 0
    # one type for each value, or spellings would part
    values = dirty.select(F.explode(F.array_distinct("found")).alias("value")).distinct()
    as_kind = lambda k: F.transform(k, lambda v: F.struct(v.alias("value"), F.lit(k).alias("kind")))
    called = dirty.where(is_name).select(F.explode(F.flatten(F.array(*map(as_kind, NAMES)))).alias("z")).groupBy("z.value").agg(F.min("z.kind").alias("name"))
    found = values.join(called, "value", "left").select("value", F.coalesce("name", entity_type(F.col("value"))).alias("kind"))
    table = surrogates(found, key)
    entities = table.where("kind <> 'word'").select("value", F.col("replacement").alias("whole"), F.col("kind").startswith("name").alias("called"))
    # in documents with names, capitalised words between the entities are places too
    both = f"{ANY}|(?:{MENTION})"
    cut = dirty.withColumn("by_name", is_name).select("row", "by_name", F.posexplode(F.when(is_name, F.regexp_extract_all(text, F.lit(both), F.lit(0))).otherwise(F.col("found"))).alias("pos", "value"))
    word = lambda v: F.when(v.rlike(r"^\p{Lu}{2,}$"), F.initcap(F.lower(v))).otherwise(v)
    own_words = dirty.where(is_name).select("row", F.explode(F.array_distinct(F.flatten(F.transform(F.flatten(F.array(*NAMES)), lambda v: F.split(v, " "))))).alias("word"))
    # a single word is replaced as a word of the document's own names
    alone = F.col("by_name") & F.coalesce("called", F.lit(True)) & ~F.col("value").contains(" ")
    places = cut.join(entities, "value", "left").withColumn("word", F.when(alone, word(F.col("value")))).withColumn("whole", F.when(F.col("word").isNull(), F.col("whole")))
    again = own_words.join(table.where("kind = 'word'").select(F.col("value").alias("word"), F.col("replacement").alias("part")), "word")
    filled = places.join(again, ["row", "word"], "left")
    part = F.when(F.col("value").rlike(r"^\p{Lu}{2,}$"), F.upper("part")).otherwise(F.col("part"))
    place = F.struct("pos", F.coalesce("whole", part, "value").alias("text"), F.col("whole").isNotNull().alias("entity"), F.col("part").isNotNull().alias("mention"))
    swaps = filled.groupBy("row").agg(F.array_sort(F.collect_list(place)).alias("places"))
    joined = dirty.join(swaps, "row")
    pieces = joined.withColumn("pieces", F.when(is_name, F.split(text, both, -1)).otherwise(F.split(text, ANY, -1)))
    texts = F.zip_with("pieces", "places", lambda p, v: F.concat(F.coalesce(p, F.lit("")), F.coalesce(v["text"], F.lit(""))))
    follows = lambda i: (i > 0) & F.get("pieces", i).eqNullSafe(F.lit(" ")) & F.coalesce(F.get("places", i - 1)["mention"], F.lit(False))
    counted = F.filter(F.transform("places", lambda v, i: v["entity"] | (v["mention"] & ~follows(i))), lambda x: x)
    swapped = pieces.select(*[F.array_join(texts, "").alias(c) if c == at else F.col(c) for c in base.columns], F.size(counted).alias("n"))
    return clean.unionByName(swapped).toDF(*names, "n_entities")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: all `documents` with personal data and secrets replaced."""
    from docweave.functions.session import spread, table

    return replace_entities(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "n_entities", "text")
