"""Scalar functions on text, as Column expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\x0B\f\r]+"
#: A letter, digit or underscore of any script, as \w of a Unicode-aware pattern.
WORD = r"[\p{L}\p{N}_]"


def words(text) -> Column:
    """Lower-case words of any script, soft hyphens left out."""
    return F.regexp_extract_all(F.lower(F.replace(F.col(text) if isinstance(text, str) else text, F.lit("­"), F.lit(""))), F.lit(f"{WORD}+"), F.lit(0))


def ascii_words(text) -> Column:
    """Lower-case words of ASCII letters and digits, after folding."""
    return F.regexp_extract_all(fold(F.lower(text)), F.lit("[a-z0-9]+"), F.lit(0))


def squeeze(text) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def _fold_table() -> tuple[str, str]:
    """Latin letters below U+0250 and in U+1E00-1EFF whose compatibility form is one ASCII letter and marks."""
    made = {}
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain.isascii():
            made[chr(point)] = plain
    return "".join(made), "".join(made.values())


def fold(text) -> Column:
    """Latin letters without their marks; combining marks go."""
    a, b = _fold_table()
    return F.regexp_replace(F.translate(text, a, b), r"\p{Mn}+", "")


def norm_repeat(text) -> Column:
    """For lines that repeat but for numbers: lower case, digit runs and words of i, v, x, l, c become #."""
    t = F.regexp_replace(F.lower(text), "[0-9]+", "#")
    return squeeze(F.regexp_replace(t, rf"(?<!{WORD})[ivxlc]+(?!{WORD})", "#"))


def norm_title(text) -> Column:
    """Folded, lower-case words of a title without its number."""
    t = F.translate(F.lower(fold(text)), "­", "")
    t = F.regexp_replace(t, r"^(?:[0-9]+(?:\.[0-9]+)*|[ivxlc]+|[a-z])[.:)][ \t\n\x0B\f\r]+", "")
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def caps_ratio(text) -> Column:
    """Upper-case letters over letters, 0 without letters."""
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(text, r"\P{Lu}+", "")) / letters).otherwise(0.0)


def clean_font(name) -> Column:
    return F.regexp_replace(F.coalesce(name, F.lit("")), r"^[A-Z]{6}\+", "")


def family(name) -> Column:
    return F.lower(F.split(clean_font(name), "[-,]")[0])


def clean_xml(text) -> Column:
    """Without the control characters that XML 1.0 doesn't allow."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def collapse_spaced(text) -> Column:
    """A text that is nothing but spaced single letters, closed up."""
    return F.when(text.rlike(rf"^(?:{WORD} ){{2,}}{WORD}$"), F.replace(text, F.lit(" "), F.lit(""))).otherwise(text)


def number_key(number) -> Column:
    """One form for the number of a label: 3.7, 3–7 and '3 -7' are 3-7; a panel letter goes."""
    n = F.regexp_replace(F.translate(F.regexp_replace(number, SPACE, ""), "–.", "--"), "-+$", "")
    return F.regexp_replace(F.regexp_replace(n, r"^(.*[0-9])[a-z]$", "$1"), r"^(.*-[0-9]+)[A-Z]$", "$1")


def label_number(key) -> Column:
    """The whole number at the end of a key, or null."""
    return F.try_to_number(F.nullif(F.regexp_extract(key, "([0-9]+)$", 1), F.lit("")), F.lit("999999999999999999")).cast("long")


def id_shape(value, prefix=None) -> Column:
    """{P} for the prefix before a hyphen, {Nk} for a run of k digits."""
    if prefix is not None:
        at = F.lower(value).startswith(F.concat(F.lower(prefix), F.lit("-")))
        value = F.when(at & prefix.isNotNull(), F.concat(F.lit("{P}"), F.substr(value, F.length(prefix) + 1))).otherwise(value)
    parts = F.regexp_extract_all(value, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lit("{N"), F.length(p).cast("string"), F.lit("}"))).otherwise(p)), "")


def id_prefix(value) -> Column:
    """What stands before the first hyphen, or null without one."""
    return F.when(F.contains(value, F.lit("-")), F.split(value, "-")[0])


def is_roman(text) -> Column:
    return F.lower(text).rlike("^(?=[ivxlcdm])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")


def roman_value(text) -> Column:
    """The value of a numeral, by the sum of its signs; a sign before a larger one counts against."""
    value = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in zip("ivxlcdm", (1, 5, 10, 50, 100, 500, 1000), strict=True) for x in kv]), c)
    signs = F.filter(F.split(F.lower(text), ""), lambda c: c != "")
    values = F.transform(signs, lambda c: value(c))
    return F.when(
        text.rlike("^(?i)[ivxlcdm]+$"),
        F.aggregate(values, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda a, v: F.struct((a["sum"] + v - F.when(v > a["last"], 2 * a["last"]).otherwise(0)).alias("sum"), v.alias("last")), lambda a: a["sum"]),
    )


def to_roman(number) -> Column:
    """The lower-case numeral of 1 to 3999."""
    place = lambda i, one, five, ten: F.element_at(F.array(*[F.lit(x) for x in ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)]), (F.floor(number / i) % 10 + 1).cast("int"))
    return F.when((number > 0) & (number < 4000), F.concat(F.repeat(F.lit("m"), F.floor(number / 1000).cast("int")), place(100, "c", "d", "m"), place(10, "x", "l", "c"), place(1, "i", "v", "x")))


#: Bullets, those that may touch their text, and the numerals that a marker may have.
BULLETS = "•●■□▪◆◇◦○‣∙·►▶✓✔➢➤❑❖–—"
GLYPHS = "•●■□▪◆◇◦○‣►▶✓✔➢➤❑❖"
NUMERALS = "i|ii|iii|iv|v|vi|vii|viii|ix|x|xi|xii"


def marker(text) -> Column:
    """STRUCT<type, marker, rest> of a list item's marker, or null. A single letter is a letter before it is a numeral."""
    core = rf"[{BULLETS}]|\(?[0-9]{{1,3}}[.)](?![0-9])|\(?[a-z][.)]|\(?[A-Z][.)]|\(?(?:{NUMERALS})[.)]|\(?(?:{NUMERALS.upper()})[.)]"
    pattern = rf"^[ \t\n\x0B\f\r]*({core})(?:[ \t\n\x0B\f\r]+|(?<=[{GLYPHS}])(?=[^ \t\n\x0B\f\r]))"
    mark = F.regexp_extract(text, pattern, 1)
    bare = F.regexp_replace(mark, "[().]", "")
    kind = (
        F.when(bare.rlike("^[0-9]+$"), "number").when(bare.rlike("^[a-z]$"), "alpha-lower").when(bare.rlike("^[A-Z]$"), "alpha-upper")
        .when(bare.rlike(f"^(?:{NUMERALS})$"), "roman-lower").when(bare.rlike(f"^(?:{NUMERALS.upper()})$"), "roman-upper")
        .when(mark.isin("–", "—"), "simple").otherwise("bullet")
    )
    return F.when(mark != "", F.struct(kind.alias("type"), mark.alias("marker"), F.regexp_replace(text, pattern, "").alias("rest")))


def ordinal(kind, mark) -> Column:
    """The number that a marker says, or null."""
    core = F.lower(F.regexp_replace(mark, "[().]", ""))
    return F.when(kind == "number", core.try_cast("int")).when(kind.startswith("alpha"), F.ascii(core) - 96).when(kind.startswith("roman"), roman_value(core))


def page_tokens(ref) -> Column:
    """ARRAY<STRUCT<num, suffix, type>> of an index reference; a short range end takes the digits of its start."""
    one = "(?:[ivxlc]+|[0-9]{1,4})"
    pair = rf"^({one})([a-z]{{0,2}})\s*[–-]\s*({one})([a-z]{{0,2}})$"
    single = rf"^({one})([a-z]{{0,2}})$"
    a, b = F.regexp_extract(ref, pair, 1), F.regexp_extract(ref, pair, 3)
    end = F.when(a.rlike("^[0-9]") & b.rlike("^[0-9]") & (F.length(b) < F.length(a)), F.concat(F.substr(a, F.lit(1), F.length(a) - F.length(b)), b)).otherwise(b)
    token = lambda n, s, t: F.struct(n.alias("num"), s.alias("suffix"), F.lit(t).cast("string").alias("type"))
    none = F.array().cast("array<struct<num:string,suffix:string,type:string>>")
    return (
        F.when(ref.rlike(pair), F.array(token(a, F.regexp_extract(ref, pair, 2), "start-of-range"), token(end, F.regexp_extract(ref, pair, 4), "end-of-range")))
        .when(ref.rlike(single), F.array(token(F.regexp_extract(ref, single, 1), F.regexp_extract(ref, single, 2), None))).otherwise(none)
    )


def author_year(text) -> Column:
    """surname|year of a reference, or null."""
    name = F.regexp_extract(text, rf"^\s*([A-ZÁÉÍÓÚÑ](?:{WORD}|['’-])+)", 1)
    year = F.regexp_extract(text, rf"(?<!{WORD})((?:19|20)[0-9]{{2}}[a-z]?)(?!{WORD})", 1)
    return F.when((name != "") & (year != ""), F.concat_ws("|", F.lower(name), F.lower(year)))


#: Words of a box title and the type they mean, the first that is found.
BOX_TYPES = [
    ("caso|case|clinical problem|problema cl[íi]nico|patient|paciente", "case-study"),
    ("alert|alerta|precauci[óo]n|caution|warning|advertencia", "alert"),
    ("pearl|perla|tip|consejo|pitfall", "pearl"),
    ("procedure|procedimiento", "procedure"),
    ("guideline|gu[íi]a|recomendaci[óo]n", "guideline"),
]


def box_type(title) -> Column:
    found = F.lit(None).cast("string")
    for pattern, name in reversed(BOX_TYPES):
        found = F.when(title.rlike(f"(?iu){pattern}"), name).otherwise(found)
    return F.coalesce(found, F.lit("sidebar"))


#: Frequent words of each language, in the order that decides ties.
STOP_WORDS = {
    "en": "the of and to in is that for with as are was this by be on from or which an at not",
    "es": "de la que el en y los las del se por un una con para es al lo como más su pero sus",
    "fr": "de la le et les des en du un une est que pour dans qui sur par au pas plus",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine",
    "it": "di e il la che in per un del della le si con non una sono gli al",
    "pt": "de a o que e do da em um para é com não uma os no na se por mais",
    "nl": "de het een en van in is dat op te zijn met voor niet aan er",
}


def language(text) -> Column:
    """STRUCT<lang, hits, total> for Latin script: the language with most stop words, null below 3 hits or 20 characters."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[a-záéíóúüñàèìòùâêîôûçäöß]+"), F.lit(0))
    of = lambda t, stops: F.size(F.filter(t, lambda w: w.isin(*stops)))
    # The variable of a lambda is evaluated once, so tokens and counts are bound to one each.
    once = lambda value, fn: F.get(F.transform(F.array(value), fn), F.lit(0))
    counted = once(tokens, lambda t: F.array(*[F.struct(of(t, v.split()).alias("hits"), F.lit(-i).alias("order"), F.lit(k).alias("lang")) for i, (k, v) in enumerate(STOP_WORDS.items())]))
    found = once(counted, lambda c: F.struct(F.array_max(c).alias("best"), F.aggregate(c, F.lit(0), lambda a, x: a + x["hits"]).alias("total")))
    known = lambda f: (F.length(text) >= 20) & (f["best"]["hits"] >= 3)
    return once(found, lambda f: F.struct(F.when(known(f), f["best"]["lang"]).alias("lang"), F.coalesce(f["best"]["hits"], F.lit(0)).alias("hits"), F.coalesce(f["total"], F.lit(0)).alias("total")))


#: The language that a script stands for, and letters that only Vietnamese has.
SCRIPTS = {"ar": "Arabic", "he": "Hebrew", "hi": "Devanagari", "te": "Telugu", "ta": "Tamil", "kn": "Kannada", "ml": "Malayalam", "bn": "Bengali", "th": "Thai", "ko": "Hangul", "ja": "Hiragana Katakana", "zh": "Han", "ru": "Cyrillic", "el": "Greek"}
VIETNAMESE = "[ơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]"


def language_sql(text: str) -> str:
    """SQL of STRUCT<lang, conf> for a text expression: the script of most letters, counted over the whole text, where that isn't
    Latin; else Vietnamese by its letters; else by stop words. Null below 20 characters, without letters and below 3 stop words."""
    bind = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    share = lambda part, whole: f"round({part} / {whole}, 2)"
    of_script = lambda names: "".join(rf"\p{{Is{n}}}" for n in names.split())
    scripts = ", ".join(f"struct(length(regexp_replace(other, r'[^{of_script(names)}]', '')) AS n, {-i} AS place, '{code}' AS lang)" for i, (code, names) in enumerate(SCRIPTS.items()))
    stops = ", ".join(f"struct(size(filter(tokens, w -> w IN ({', '.join(repr(w) for w in words.split())}))) AS n, {-i} AS place, '{code}' AS lang)" for i, (code, words) in enumerate(STOP_WORDS.items()))
    total = lambda counts: f"aggregate({counts}, 0, (sum, c) -> sum + c.n)"
    found = lambda lang, conf: f"named_struct('lang', {lang}, 'conf', CAST({conf} AS DOUBLE))"
    latin = "(length(letters) - length(other))"
    by_stops = bind(f"regexp_extract_all(lower({text}), '[a-záéíóúüñàèìòùâêîôûçäöß]+', 0)", "tokens", bind(f"array({stops})", "counts", f"IF(array_max(counts).n >= 3, {found('array_max(counts).lang', share('array_max(counts).n', total('counts')))}, {found('NULL', '0')})"))
    by_script = (
        f"CASE WHEN array_max(scripts).n > {latin} THEN {found('array_max(scripts).lang', share('array_max(scripts).n', f'({latin} + {total("scripts")})'))} "
        f"WHEN {latin} = 0 THEN {found('NULL', '0')} WHEN rlike(beyond, '{VIETNAMESE}') THEN {found("'vi'", '0.8')} ELSE {by_stops} END"
    )
    # Letters beyond ASCII are few in most texts; the dearer classes are looked for among these alone.
    other = bind(r"regexp_replace(beyond, r'\p{IsLatin}+', '')", "other", bind(f"array({scripts})", "scripts", by_script))
    letters = bind(rf"regexp_replace({text}, r'\P{{L}}+', '')", "letters", bind("regexp_replace(letters, '[A-Za-z]+', '')", "beyond", other))
    return f"(CASE WHEN length({text}) >= 20 THEN {letters} ELSE {found('NULL', '0')} END)"
