"""PII surrogate generation, with DataFrame operations only.

Entities (mail and network addresses, telephone, card, bank account and social
security numbers, titled names) are found by one pattern. Every entity, a value in
normal form, gets one surrogate that depends on a secret key, its kind, the normal
form and the number of the attempt. Mail addresses are folded, numbers are their
digits (with a leading plus), IPv6 addresses are written out, names are lower-case
words, without titles and particles; the last word is the surname, the others are
given names. The surrogate is then put into each value's format: separators, upper
case, titles, particles, hyphens. A country code stays if in all formats of the
number a separator or bracket ends it; a check digit that held, holds again.
Words of a name found in a text are replaced wherever else they stand in that text
with a capital, without a title too, and count as entities of kind name; so are the
halves of a hyphenated name, which take the halves of its surrogate.

Distinctness is checked on the whole corpus: of entities that got one surrogate
the least keeps it, and none may be a normal form that occurs; the others try
again until none is left, with longer surrogates as attempts go by. So coreference
holds within and across texts.

Scale: only texts with an entity are shuffled; values are pre-aggregated, and a
value with a third of all occurrences, or a name part of a third of all values, is
joined by ``common.attach``. The rounds of attempts work on the colliding entities alone, each a written table.

Defined results: a null text stays null, an empty one empty, and neither has an
entity; very long texts are read whole; repeated rows get one result each, an empty
table none; of entities that tie for a surrogate the least keeps it; null ids are
kept; other columns are not read. Scripts without a table here get Latin names, a
lower-case half after a hyphen is no part of a name, a name in Han characters has
two to four.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ascii_lower, attach, let, store

#: Titles by gender; "x" is open.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "г-жа", "Κυρία", "السيدة", "גברת", "श्रीमती"),
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "г-н", "Κύριος", "السيد", "מר", "श्री"),
    "x": ("Mx", "Dr", "Prof"),
}
#: Given names by gender and script; surnames are put together from syllables.
GIVEN = {
    ("f", "latin"): ("anna", "clara", "elena", "greta", "ida", "laura", "nora", "vera"),
    ("m", "latin"): ("adam", "bruno", "david", "felix", "hugo", "lukas", "oskar", "viktor"),
    ("x", "latin"): ("alex", "kim", "noel", "robin", "sascha", "toni", "jo", "luca"),
    ("f", "cyrillic"): ("анна", "вера", "елена", "ирина", "лидия", "мария", "нина", "ольга"),
    ("m", "cyrillic"): ("борис", "виктор", "глеб", "иван", "лев", "олег", "павел", "роман"),
    ("x", "cyrillic"): ("саша", "женя", "валя", "слава", "шура", "тоня", "паша", "вася"),
    ("f", "greek"): ("άννα", "ελένη", "μαρία", "σοφία"),
    ("m", "greek"): ("γιώργος", "νίκος", "πέτρος", "σπύρος"),
    ("x", "greek"): ("άλεξ", "φώτη", "χαρά", "νίκη"),
    ("f", "arabic"): ("فاطمة", "مريم", "ليلى", "سلمى"),
    ("m", "arabic"): ("كريم", "سمير", "عمر", "طارق"),
    ("x", "arabic"): ("نور", "صباح", "وسام", "رضا"),
    ("f", "hebrew"): ("רחל", "שרה", "מרים", "לאה"),
    ("m", "hebrew"): ("דוד", "משה", "יוסף", "אורי"),
    ("x", "hebrew"): ("טל", "גל", "נועם", "שחר"),
    ("f", "devanagari"): ("सीता", "गीता", "मीरा", "राधा"),
    ("m", "devanagari"): ("राम", "मोहन", "अर्जुन", "विजय"),
    ("x", "devanagari"): ("किरण", "ज्योति", "सुमन", "शशि"),
    ("f", "han"): ("美玲", "秀英", "丽华", "雪梅"),
    ("m", "han"): ("建国", "志强", "伟明", "大勇"),
    ("x", "han"): ("子安", "一鸣", "文清", "永和"),
}
SYLLABLES = {
    "latin": ("ba", "de", "fi", "go", "ha", "ke", "li", "mo", "na", "pe", "ri", "so", "ta", "ve", "wi", "zo"),
    "cyrillic": ("ба", "де", "фи", "го", "ха", "ке", "ли", "мо", "на", "пе", "ри", "со", "та", "ве", "жи", "зо"),
    "greek": ("βα", "δε", "φι", "γο", "κα", "λε", "μι", "νο", "πα", "ρε", "σι", "το", "χα", "ζε", "θι", "ξο"),
    "arabic": ("با", "دي", "فو", "قا", "كي", "لو", "ما", "ني", "رو", "سا", "تي", "زو", "حا", "جي", "شو", "عا"),
    "hebrew": ("בא", "דו", "גי", "הא", "זו", "חי", "טא", "לו", "מי", "נא", "סו", "פי", "קא", "רו", "שי", "תא"),
    "devanagari": ("बा", "दे", "फी", "गो", "हा", "के", "ली", "मो", "ना", "पे", "री", "सो", "ता", "वे", "जी", "को"),
    "han": ("安", "白", "成", "东", "方", "高", "海", "江", "林", "明", "宁", "平", "青", "山", "天", "云"),
}
#: Pattern of the scripts with names of their own; all others get Latin ones.
SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "arabic": r"\p{IsArabic}", "hebrew": r"\p{IsHebrew}",
           "devanagari": r"\p{IsDevanagari}", "han": r"\p{IsHan}"}

#: Words between the parts of a name, which stay.
PARTICLE = "(?:van|von|vom|zu|zur|der|den|dem|de|del|della|des|di|da|do|dos|das|du|la|le|las|los|ter|ten|af|av|bin|ibn|ben|al|el)"
#: What may stand before a name word's first capital, and stays: d'Artagnan, O'Brien, al-Rashid.
PREFIX = "(?:[dlDLO]['’]|[ae]l-)"
_REST = r"[\p{L}\p{M}]*(?:['’](?!(?:s|ll|ve|re|d|m|t)(?![\p{L}\p{M}]))\p{L}[\p{L}\p{M}]*){0,3}"
WORD = (rf"(?:{PREFIX}?\p{{Lu}}{_REST}(?:-\p{{Lu}}{_REST}){{0,3}}|\p{{IsHan}}{{2,4}}"
        r"|[\p{IsArabic}&&\p{L}][\p{L}\p{M}]*|[\p{IsHebrew}&&\p{L}][\p{L}\p{M}]*|[\p{IsDevanagari}&&\p{L}][\p{L}\p{M}]*)")
TITLE = rf"(?:{'|'.join(t for ts in TITLES.values() for t in ts)})\.?"
EDGE = r"[\p{L}\p{M}\p{N}_]"
HEX = "[0-9A-Fa-f]{1,4}"

#: One pattern per kind; the first that matches at a place decides. Repetitions of
#: groups are bounded, so no text is too long for them.
KINDS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,126}",
    "ip": r"(?<![0-9A-Za-z])(?<!\d\.)(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)(?![A-Za-z])",
    "ip6": rf"(?<![0-9A-Za-z:.])(?:(?:{HEX}:){{7}}{HEX}|(?=[0-9A-Fa-f:]{{0,38}}\d)(?:{HEX}:){{1,6}}(?::{HEX}){{1,6}})(?![0-9A-Za-z:])",
    "phone": r"(?<![\w+])\+\d{1,3}[ -]?\(?\d{2,4}\)?(?:[ -]?\d{2,4}){2,3}(?!\d)|(?<!\w)\(\d{3}\) ?\d{3}-\d{4}(?!\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?:\d{4}[ -]){3}\d{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\d{13,19}(?![0-9A-Za-z])",
    "name": rf"(?<!{EDGE})(?:{TITLE} ){{1,3}}(?:{PARTICLE} ){{0,3}}{WORD}(?: (?:{PARTICLE} ){{0,3}}{WORD}){{0,3}}(?!{EDGE})",
}
#: A word that may be part of a name found elsewhere in the text.
MENTION = rf"(?<!{EDGE}){WORD}(?!{EDGE})"
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: A text without any of these characters or titles has no entity.
CUE = rf"[0-9@]|{TITLE} "


def kind_of(value: Column) -> Column:
    return reduce(lambda c, k: c.when(value.rlike(f"^(?:{KINDS[k]})$"), F.lit(k)), list(KINDS)[1:],
                  F.when(value.rlike(f"^(?:{KINDS['email']})$"), F.lit("email")))


def _byte(stream: Column, i: Column) -> Column:
    """The i-th byte of a hexadecimal stream of 64 bytes."""
    return F.conv(F.substring(stream, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(options: tuple[str, ...], byte: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), byte % len(options) + 1)


def filled(value: Column, stream: Column) -> Column:
    """``value`` with digits and letters exchanged for others of their kind."""
    ranges = (("[0-9]", "0123456789"), ("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
              ("[а-я]", "абвгдежзиклмнопрстуфхцчшщэюя"), ("[А-Я]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ"))

    def other(c: Column, i: Column) -> Column:
        b = _byte(stream, i)
        out = reduce(lambda x, r: x.when(c.rlike(r[0]), F.substring(F.lit(r[1]), b % len(r[1]) + 1, F.lit(1))),
                     ranges[1:], F.when(c.rlike(ranges[0][0]), F.substring(F.lit(ranges[0][1]), b % 10 + 1, F.lit(1))))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), other), "")


def luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a string of digits; 0 if its check digit holds."""
    doubled = lambda c, i: let(c.cast("int") * (1 + i % 2), lambda v: F.when(v > 9, v - 9).otherwise(v))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), doubled), F.lit(0), lambda s, v: s + v) % 10


def iban_check(country: Column, account: Column) -> Column:
    """The two check digits (modulo 97) of an account number."""
    moved = F.split(F.concat(account, country, F.lit("00")), "")
    rest = F.aggregate(moved, F.lit(0), lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + c.cast("int")) % 97).otherwise(
        (s * 100 + F.ascii(c) - 55) % 97))
    return F.lpad((98 - rest).cast("string"), 2, "0")


def ip6_norm(value: Column) -> Column:
    """The eight groups of an IPv6 address, lower-case and without leading zeros."""
    groups = lambda i: F.filter(F.split(F.coalesce(F.get(F.split(F.lower(value), "::"), F.lit(i)), F.lit("")), ":"),
                                lambda g: g != "")
    zeros = F.array_repeat(F.lit("0"), F.lit(8) - F.size(groups(0)) - F.size(groups(1)))
    return F.array_join(F.transform(F.concat(groups(0), zeros, groups(1)), lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")


def titles_of(value: Column) -> Column:
    return F.regexp_extract(value, rf"^(?:{TITLE} )+", 0)


def name_words(value: Column) -> Column:
    """The words of a titled name after its titles, particles included."""
    return F.split(F.substring(value, F.length(titles_of(value)) + 1, F.length(value)), " ")


def is_part(word: Column) -> Column:
    return ~word.rlike(f"^{PARTICLE}$")


def parts_of(kind: Column, value: Column) -> Column:
    """The entities that a value names, in normal form: (kind, norm, keep, f, m).
    ``keep`` is the number of digits that its format allows to stay, those of a
    country code that a separator or bracket ends; f and m tell the titles' gender."""
    titles = F.transform(F.split(F.trim(titles_of(value)), " "), lambda t: F.regexp_replace(t, r"\.$", ""))
    held = lambda g: F.arrays_overlap(titles, F.array(*map(F.lit, TITLES[g])))

    def part(k: Column | str, norm: Column, keep: Column) -> Column:
        return F.struct((F.lit(k) if isinstance(k, str) else k).alias("kind"), norm.alias("norm"), keep.cast("int").alias("keep"),
                        held("f").alias("f"), held("m").alias("m"))

    zero = F.lit(0)
    names = let(F.filter(name_words(value), is_part), lambda ws: F.transform(ws, lambda w, i: part(
        F.when(i == F.size(ws) - 1, F.lit("surname")).otherwise(F.lit("given")), F.lower(w), zero)))
    return F.when(kind == "email", F.array(part("email", ascii_lower(value), zero))) \
        .when(kind == "ip", F.array(part("ip", value, zero))) \
        .when(kind == "ip6", F.array(part("ip6", ip6_norm(value), zero))) \
        .when(kind == "iban", F.array(part("iban", F.regexp_replace(value, " ", ""), zero))) \
        .when(kind == "name", names) \
        .otherwise(F.array(part("number", F.regexp_replace(value, "[^+0-9]", ""),
                                F.length(F.regexp_extract(value, r"^\+(\d{1,3})(?=[ (-])", 1)))))


def named(kind: Column, norm: Column, f: Column, m: Column, stream: Column, attempt: Column) -> Column:
    """A given name of the titles' gender (open if they differ) or a surname, in as
    many hyphenated pieces as ``norm`` and after its prefix; every attempt adds a
    syllable, so names never run out."""
    prefix = F.regexp_extract(norm, "^(?:[dlo]['’]|[ae]l-)", 0)
    pieces = F.split(F.substring(norm, F.length(prefix) + 1, F.length(norm)), "-")

    def built(script: str) -> Column:
        def more(n: Column, at: Column) -> Column:
            return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: _pick(SYLLABLES[script], _byte(stream, at + i))), "")

        def piece(_: Column, j: Column) -> Column:
            at = j * 16
            first = lambda g: _pick(GIVEN[g, script], _byte(stream, at))
            given = F.when(f & ~m, first("f")).when(m & ~f, first("m")).otherwise(first("x"))
            return F.when(kind == "surname", more(attempt + (2 if script == "han" else 3), at)).when(attempt == 0, given) \
                .otherwise(F.concat(given, more(F.greatest(attempt, F.lit(1)), at)))

        return F.concat(prefix, F.array_join(F.transform(pieces, piece), "-"))

    return reduce(lambda c, s: c.when(norm.rlike(rf"^[{SCRIPTS[s]}\p{{M}}'’-]+$"), built(s)), list(SCRIPTS)[1:],
                  F.when(norm.rlike(rf"^[{SCRIPTS['cyrillic']}\p{{M}}'’-]+$"), built("cyrillic"))).otherwise(built("latin"))


def styled(word: Column, made: Column) -> Column:
    """A name word's surrogate, a normal form, in the word's case: all capitals, or
    one at the start of each piece after the prefix as it stands."""
    prefix = F.regexp_extract(word, f"^{PREFIX}", 0)
    rest = F.split(F.substring(made, F.length(prefix) + 1, F.length(made)), "-")
    capital = F.concat(prefix, F.array_join(F.transform(rest, F.initcap), "-"))
    return F.when((word == F.upper(word)) & (F.length(word) > 1), F.upper(made)).otherwise(capital)


def surrogate(key: str) -> Column:
    """The surrogate of an entity (kind, norm, keep, f, m) at an attempt."""
    kind, norm, attempt = F.col("kind"), F.col("norm"), F.col("attempt")

    def made(s: Column) -> Column:
        b = lambda i: _byte(s, F.lit(i))
        head = F.length(F.regexp_extract(norm, r"^\+", 0)) + F.col("keep")
        # A number whose format has no free value left grows by digits, an address by octets.
        steps = F.floor(attempt / 16).cast("int")
        longer = F.substring(F.regexp_replace(s, "[a-f]", ""), F.lit(1), steps)
        whole = F.concat(F.substring(norm, F.lit(1), head), filled(F.substring(norm, head + 1, F.length(norm)), s), longer)
        body = F.concat(filled(F.substring(norm, F.lit(1), F.length(norm) - 1), s), longer)
        checked = F.concat(body, F.pmod(10 - luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
        number = F.when(norm.rlike(r"^\d{13,19}$") & (luhn(norm) == 0), checked).otherwise(whole)
        octets = F.concat(F.array(b(0) % 16 + 240, b(1), b(2), b(3)), F.transform(
            F.array_repeat(F.lit(0), steps), lambda _, i: _byte(s, i + 4)))
        country, account = F.substring(norm, 1, 2), F.concat(filled(F.substring(norm, F.lit(5), F.length(norm)), s), longer)
        group = lambda i: F.regexp_replace(F.substring(s, i, 4), "^0+(?=.)", "")
        return F.when(kind == "email", F.concat(filled(F.regexp_extract(norm, "^([^@]+)@", 1), s), F.lit("@"),
                                                F.substring(s, 100, 8), F.lit(".example.net"))) \
            .when(kind == "ip", F.array_join(octets.cast("array<string>"), ".")) \
            .when(kind == "ip6", F.concat_ws(":", F.lit("2001:db8:0:0"), group(1), group(5), group(9), group(13))) \
            .when(kind == "iban", F.concat(country, iban_check(country, account), account)) \
            .when(kind.isin("given", "surname"), named(kind, norm, F.col("f"), F.col("m"), s, attempt)) \
            .otherwise(number)

    return let(F.sha2(F.concat_ws("\n", F.lit(key), kind, norm, attempt.cast("string")), 512), made)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(part, made, n) for entities (part, kind, norm, keep, f, m, n), ``part``
    their key: distinct surrogates, none of them a normal form that occurs."""
    left = entities.withColumn("attempt", F.lit(0))
    done: DataFrame | None = None
    while True:
        tried = store(left.withColumn("made", surrogate(key)), "tried")
        first = tried.groupBy("made").agg(F.min("part").alias("part"))
        good = tried.join(first, ["made", "part"], "left_semi").join(
            entities.select(F.col("norm").alias("made")), "made", "left_anti")
        if done is not None:
            good = good.join(done.select("made"), "made", "left_anti")
        good = store(good.select("part", "made", "n"), "assigned")
        done = good if done is None else done.union(good)
        left = store(tried.drop("made").join(good.select("part"), "part", "left_anti").withColumn(
            "attempt", F.col("attempt") + 1), "open")
        if left.isEmpty():
            return done


def formatted(kind: Column, value: Column, made: Column) -> Column:
    """The entities' surrogates ``made`` in the format of ``value``: its titles and
    particles, its upper case, its separators between digits, letters or groups."""
    one = F.element_at(made, 1)

    def refilled(allowed: str) -> Column:
        chars = F.regexp_replace(one, f"[^{allowed}]", "")
        before = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i), f"[^{allowed}]", ""))
        put = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(
            c.rlike(f"[{allowed}]"), F.substring(chars, before(i + 1), F.lit(1))).otherwise(c)), "")
        return F.concat(put, F.substring(chars, before(F.length(value)) + 1, F.length(chars)))

    local = F.regexp_extract(value, "^([^@]+)@", 1)
    cased = F.array_join(F.transform(F.split(local, ""), lambda c, i: F.when(
        c.rlike("[A-Z]"), F.upper(F.substring(one, i + 1, F.lit(1)))).otherwise(F.substring(one, i + 1, F.lit(1)))), "")
    short = F.when(value.contains("::"), F.regexp_replace(one, ":0:0:", "::")).otherwise(one)
    words = let(name_words(value), lambda ws: F.array_join(F.transform(ws, lambda w, i: F.when(is_part(w), styled(
        w, F.element_at(made, F.size(F.filter(F.slice(ws, F.lit(1), i + 1), is_part))))).otherwise(w)), " "))
    return F.when(kind == "email", F.concat(cased, F.substring(one, F.length(local) + 1, F.length(one)))) \
        .when(kind == "ip", one) \
        .when(kind == "ip6", F.when(value.rlike("[A-F]"), F.upper(short)).otherwise(short)) \
        .when(kind == "iban", refilled("0-9A-Z")) \
        .when(kind == "name", F.concat(titles_of(value), words)) \
        .otherwise(refilled("0-9"))


def values_with_surrogates(values: DataFrame, key: str) -> DataFrame:
    """(value, surrogate, names, w) for distinct values (value, w, kind); ``names``
    are the words of a name, (value, rank, surrogate) in normal form, surname first."""
    each = store(values.select("value", "w", F.col("kind").alias("vkind"), F.posexplode(parts_of(F.col("kind"), F.col("value"))))
                 .select("value", "w", "vkind", "pos", "col.*").withColumn("part", F.concat_ws("\n", "kind", "norm")), "parts")
    entities = each.groupBy("part", "kind", "norm").agg(
        F.min("keep").alias("keep"), F.max("f").alias("f"), F.max("m").alias("m"), F.count(F.lit(1)).alias("n"))
    got = attach(each.select("value", "w", "vkind", "pos", "kind", "norm", "part"),
                 assign(store(entities, "entities"), key), "part", "value", "n")
    made = got.groupBy("value", "w", "vkind").agg(
        F.sort_array(F.collect_list(F.struct("pos", "made", "kind", "norm"))).alias("got"))
    entry = lambda v, r, s: F.struct(v.alias("value"), r.alias("rank"), s.alias("surrogate"))
    words = F.transform("got", lambda g: entry(g["norm"], F.when(g["kind"] == "surname", 1).otherwise(2), g["made"]))
    hyphened = F.filter("got", lambda g: g["norm"].contains("-"))
    halves = F.flatten(F.transform(hyphened, lambda g: F.zip_with(
        F.split(g["norm"], "-"), F.split(g["made"], "-"), lambda v, s: entry(v, F.lit(3), s))))
    halves = F.filter(halves, lambda h: F.length(h["value"]) > 2)
    return made.select("value", formatted(F.col("vkind"), F.col("value"), F.col("got.made")).alias("surrogate"),
                       F.when(F.col("vkind") == "name", F.concat(words, halves)).alias("names"), "w")


def replace_pii(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, the text with surrogates, the number of
    entities of each kind (``n_email`` ...) and ``n_entities``."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    holds = F.coalesce(F.col("text").rlike(CUE) & F.col("text").rlike(ANY), F.lit(False))
    rows = src.where(holds).withColumn("found", F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    rows = store(rows.withColumn("th", F.xxhash64("text")), "pii-rows")
    seen = rows.select("id", "th", F.explode("found").alias("value")).distinct()
    values = store(seen.groupBy("value").agg(F.count(F.lit(1)).alias("w")).withColumn("kind", kind_of(F.col("value"))), "values")
    given = attach(seen, values_with_surrogates(values, key), "value", "th", "w").drop("w")
    # A name also gives its words, for mentions without a title; a surname goes before a given name.
    own = F.array(F.struct(F.col("value"), F.lit(0).alias("rank"), F.col("surrogate")))
    entries = F.concat(own, F.coalesce("names", F.slice(own, 1, 0)))
    given = given.select(F.col("id").alias("tid"), F.col("th").alias("tth"), F.explode(entries).alias("e")).groupBy(
        "tid", "tth", F.col("e.value").alias("value")).agg(F.min(F.struct("e.rank", "e.surrogate")).alias("s"))
    table = given.groupBy("tid", "tth").agg(
        F.map_from_entries(F.collect_list(F.struct("value", "s.surrogate"))).alias("given"), F.max("s.rank").alias("names"))
    out = rows.join(table, F.col("id").eqNullSafe(F.col("tid")) & (F.col("th") == F.col("tth")))
    joined = lambda gaps, between: F.array_join(F.zip_with(gaps, between, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    mentions = lambda p: F.regexp_extract_all(p, F.lit(MENTION), F.lit(0))
    of = lambda v: F.element_at("given", v)
    known = lambda v: of(F.lower(v)).isNotNull() | F.exists(F.split(F.lower(v), "-"), lambda x: of(x).isNotNull())
    one = lambda v: F.when(of(F.lower(v)).isNotNull(), styled(v, of(F.lower(v))))
    again = lambda v: F.coalesce(one(v), F.array_join(F.transform(F.split(v, "-"), lambda x: F.coalesce(one(x), x)), "-"))
    named_too = F.col("names") > 0
    raw = F.split("text", ANY, -1)
    pieces = F.when(named_too, F.transform(raw, lambda p: joined(F.split(p, MENTION, -1), F.transform(mentions(p), again)))).otherwise(raw)
    untitled = F.when(named_too, F.size(F.filter(F.flatten(F.transform(raw, mentions)), known))).otherwise(0)
    out = out.withColumn("n_untitled", untitled.cast("long"))
    text = joined(pieces, F.transform("found", of))
    kinds = F.transform("found", kind_of)
    number = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long").alias(f"n_{k}")
    changed = out.select("id", text.alias("text"), kinds.alias("kinds"), "n_untitled",
                         (F.size("found") + F.col("n_untitled")).alias("n_entities"))
    changed = changed.select("id", "text", "n_entities", *[
        (number(k) + F.col("n_untitled")).alias("n_name") if k == "name" else number(k) for k in KINDS])
    zero = F.lit(0).cast("long")
    plain = src.where(~holds).select("id", "text", zero.alias("n_entities"), *[zero.alias(f"n_{k}") for k in KINDS])
    return changed.union(plain).withColumnsRenamed({"id": id_col, "text": text_col})
