"""String, path and number functions as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.session import ship

#: Windows device names, academic titles, kinds by extension, slot number patterns, signs of errors that pass.
DEVICES = ["con", "prn", "aux", "nul", *[f"com{i}" for i in range(1, 10)], *[f"lpt{i}" for i in range(1, 10)]]
TITLES = ["dr", "mgr", "prof", "inz", "hab"]
KINDS = {
    "pdf": ["pdf"],
    "docx": ["doc", "docx", "odt", "rtf"],
    "pptx": ["ppt", "pptx", "pps", "ppsx", "odp"],
    "xlsx": ["xls", "xlsx", "xlsm", "ods", "csv"],
    "image": ["png", "jpg", "jpeg", "gif", "bmp", "tif", "tiff", "webp", "heic", "jfif", "svg"],
    "text": ["txt", "md", "tex", "typ", "html", "htm", "json", "yaml", "yml", "xml", "log"],
    "code": ["c", "cpp", "cc", "h", "hpp", "py", "java", "js", "ts", "cs", "sql", "sh", "m", "r", "go", "rs", "kt", "ipynb", "asm", "s", "v", "vhd", "vhdl", "hs"],
    "archive": ["zip", "rar", "7z", "tar", "gz", "bz2", "xz", "tgz"],
    "media": ["mp4", "mov", "avi", "mkv", "webm", "wav", "flac", "mp3", "m4a"],
}
SLOTS = {
    "nr_laby": r"(?<![a-z0-9])lab(?:oratorium)?[_\-. ]?(\d{1,2})(?![0-9])",
    "nr_kolosa": r"(?<![a-z0-9])kol(?:okwium|os)?[_\-. ]?(\d{1,2})(?![0-9])",
    "nr_wykladu": r"(?<![a-z0-9])wyk(?:lad)?[_\-. ]?(\d{1,2})(?![0-9])",
    "nr_projektu": r"(?<![a-z0-9])proj(?:ekt)?[_\-. ]?(\d{1,2})(?![0-9])",
}
PASSING = ["server error", "service unavailable", "bad gateway", "gateway timeout", "too many requests", "too many users", "again later", "many accesses", "rate limit", "ratelimit", "quota", "temporar", "timeout", "timed out", "connection reset", "connection aborted", "connectionerror", "connection error", "remote end closed", "broken pipe"]
PASSING_STATUS = r"(status code |http )(429|500|502|503|504)|\b(429|500|502|503|504)\b\s+(client|server)\s+error"


def kind_of(extension: Column) -> Column:
    """Content kind of an extension, with or without its dot, whatever its case and the blanks around it; `other` if unknown."""
    pairs = [F.lit(x) for kind, exts in KINDS.items() for e in exts for x in (e, kind)]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.regexp_replace(F.lower(F.trim(extension)), r"^\.", "")), F.lit("other"))


def passing_error(message: Column) -> Column:
    """Whether an error is worth another try."""
    low = F.lower(message)
    return low.rlike("|".join(PASSING)) | low.rlike(PASSING_STATUS)


def lecturer(path: Column) -> Column:
    """The name in the first path segment that begins with an academic title; null if there is none."""
    pattern = r"^(?:" + "|".join(TITLES) + r")(?![a-z])[.\s_-]*(.+)$"
    names = F.transform(F.split(path, "/"), lambda s: F.btrim(F.regexp_extract(F.trim(folded(s)), pattern, 1), F.lit(" ._-")))
    return F.get(F.filter(names, lambda n: n != ""), F.lit(0))


def slot_numbers(c: Column) -> Column:
    """A map from slot to its number, for slots with exactly one number in the text."""
    low = folded(c)
    found = F.array(*[F.struct(F.lit(k).alias("k"), F.array_distinct(F.regexp_extract_all(low, F.lit(p), F.lit(1))).alias("v")) for k, p in SLOTS.items()])
    return F.map_from_entries(F.transform(F.filter(found, lambda e: F.size(e["v"]) == 1), lambda e: F.struct(e["k"].alias("key"), F.get(e["v"], F.lit(0)).alias("value"))))


def folded(c: Column) -> Column:
    """Lower case without diacritics. The stroked l has no decomposition and is replaced itself."""
    plain = F.translate(F.lower(c), "ąćęńóśźżáéíúàèìòùâêîôûäëïöüñçãõåæø", "acenoszzaeiuaeiouaeiouaeiouncaoaao")
    return F.translate(plain, "ł", "l")


def slug(c: Column, limit: int = 80) -> Column:
    """Folded, other characters as single dashes, cut at `limit`, no dash at the ends."""
    dashed = F.regexp_replace(folded(c), "[^a-z0-9]+", "-")
    return F.btrim(F.substring(F.btrim(dashed, F.lit("-")), 1, limit), F.lit("-"))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(folded(c), F.lit("[a-z0-9]+"), F.lit(0))


def contains_tokens(text: Column, phrase: Column) -> Column:
    """Whether the words of `phrase` stand next to each other in `text`."""
    inside = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
    wanted = F.array_join(tokens(phrase), " ")
    return (F.length(wanted) > 0) & inside.contains(F.concat(F.lit(" "), wanted, F.lit(" ")))


def shingles(words: Column, k: int = 3) -> Column:
    """The overlapping k-word shingles; of fewer words, the words. `words` should be a column, not an expression: it is looked up for every shingle."""
    n = F.size(words)
    at = F.sequence(F.lit(0), F.greatest(n - k, F.lit(0)))
    return F.when(n < k, words).otherwise(F.transform(at, lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)])))


def hamming_hex(a: Column, b: Column) -> Column:
    """Different bits of two hexadecimal signatures of at most 64 bits; null if one is null or their lengths differ."""
    return F.when(F.length(a) == F.length(b), F.bit_count(F.conv(a, 16, -10).cast("long").bitwiseXOR(F.conv(b, 16, -10).cast("long"))))


def safe_name(c: Column, default: str = "bez_nazwy") -> Column:
    """A file name without characters that file systems forbid."""
    clean = F.rtrim(F.trim(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "_")))
    clean = F.regexp_replace(clean, r"[. ]+$", "")
    return F.when(F.coalesce(F.length(clean), F.lit(0)) == 0, F.lit(default)).otherwise(clean)


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), F.lit(1))


def year_of(c: Column, today: int) -> Column:
    """The only year from 1990 to `today` + 1 in a text; of two consecutive ones the lower; else null."""
    years = F.array_sort(F.array_distinct(F.filter(F.transform(numbers(c), lambda x: x.cast("int")), lambda y: (y >= 1990) & (y <= today + 1))))
    return F.when(F.size(years) == 1, F.get(years, 0)).when((F.size(years) == 2) & (F.get(years, 1) == F.get(years, 0) + 1), F.get(years, 0))


def only_match(c: Column, pattern: str, group: int = 1) -> Column:
    """The value of `pattern` if the text has exactly one distinct one."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)))
    return F.when(F.size(found) == 1, F.get(found, 0))


def human_size(c: Column) -> Column:
    """Bytes as B, KiB, MiB or GiB."""
    return (
        F.when(c < 1024, F.format_string("%d B", c))
        .when(c < 1024**2, F.format_string("%.1f KiB", c / 1024))
        .when(c < 1024**3, F.format_string("%.1f MiB", c / 1024**2))
        .otherwise(F.format_string("%.1f GiB", c / 1024**3))
    )


def duration(seconds: Column) -> Column:
    """h:mm:ss, mm:ss below an hour, a dash for null."""
    s = F.floor(seconds).cast("long")
    short = F.format_string("%02d:%02d", F.floor(s % 3600 / 60).cast("long"), s % 60)
    return F.when(s.isNull(), F.lit("—")).when(s < 3600, short).otherwise(F.concat(F.floor(s / 3600).cast("long").cast("string"), F.lit(":"), short))


def middle_cut(c: Column, limit: int) -> Column:
    """At most `limit` characters, an ellipsis in the middle of what is longer."""
    left = (limit - 1 + 1) // 2
    right = limit - 1 - left
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, left), F.lit("…"), F.substring(c, -right, right) if right else F.lit("")))


def excerpt(markdown: Column, limit: int = 200) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(markdown, r"[#>*`\[\]]", ""), r"\s+", " ")), 1, limit)


def words_in(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))


def ancestors(path: Column, inclusive: bool = True) -> Column:
    """The paths above `path`, from the top, itself included."""
    parts = F.split(path, "/")
    last = F.size(parts) if inclusive else F.size(parts) - 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def path_problem(path: Column) -> Column:
    """Why a relative target path isn't safe: empty, backslash, absolute, segment; null if it is."""
    return (
        F.when(F.coalesce(path, F.lit("")) == "", "empty")
        .when(path.contains("\\"), "backslash")
        .when(path.startswith("/") | path.rlike("^[A-Za-z]:"), "absolute")
        .when(F.exists(F.split(path, "/"), lambda s: s.isin("", ".", "..")), "segment")
    )


def windows_problems(path: Column) -> Column:
    """Codes of what Windows doesn't take in a path."""
    segs = F.split(path, "/")
    stem = lambda s: F.lower(F.element_at(F.split(s, r"\."), 1))
    checks = [
        (F.length(path) > 240, "too_long"),
        (F.exists(segs, lambda s: s.rlike(r"[. ]$")), "ends_in_dot_or_space"),
        (F.exists(segs, lambda s: s.rlike(r'[<>:"\\|?*]')), "forbidden_character"),
        (F.exists(segs, lambda s: s.rlike(r"[\x00-\x1f]")), "control_character"),
        (F.exists(segs, lambda s: stem(s).isin(DEVICES)), "reserved_name"),
    ]
    return F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in checks]), lambda x: x.isNotNull())


def wiki_links(markdown: Column) -> Column:
    """Targets, headings and aliases of [[...]] links outside fenced blocks."""
    plain = F.regexp_replace(markdown, r"(?s)```.*?(```|$)", "")
    inner = F.regexp_extract_all(plain, F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1))
    empty = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.transform(inner, lambda x: F.struct(empty(F.regexp_extract(x, r"^([^#|]*)", 1)).alias("target"), empty(F.regexp_extract(x, r"#([^|]*)", 1)).alias("heading"), empty(F.regexp_extract(x, r"\|(.*)$", 1)).alias("alias")))


def normal_form(t: str | None) -> str | None:
    """NFKC without soft hyphens, everything but letters, digits and blanks as a blank, collapsed, case-folded."""
    if t is None:
        return None
    t = unicodedata.normalize("NFKC", t).replace("\u00ad", "")
    return " ".join("".join(c if c.isalnum() or c.isspace() else " " for c in t).split()).casefold()


def normalised(c: Column) -> Column:
    """normal_form of a column; Spark has neither NFKC nor case folding."""
    ship()

    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([normal_form(t) for t in s], dtype=object)

    return run(c)


def shingle_halves(words: Column, k: int = 3) -> Column:
    """The two halves of the md5 of each word shingle, as integers."""
    grams = F.filter(shingles(words, k), lambda g: g != "")
    return F.transform(grams, lambda g: F.struct(F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("long").alias("a"), F.conv(F.substring(F.md5(g), 9, 8), 16, 10).cast("long").alias("b")))


def simhash64(words: Column, k: int = 3) -> Column:
    """A 64-bit signature as 16 hex digits, from md5 of the word shingles weighted by their frequency: SQL alone can state it. Null without words."""
    return simhash_of(shingle_halves(words, k))


def simhash_of(halves: Column) -> Column:
    """The signature of `shingle_halves`; each bit reads them once, so long texts have them behind a Generate."""

    def digit(first: int, field: str) -> Column:
        value = F.lit(0)
        for bit in range(4):
            at = 1 << (31 - first * 4 - bit)
            votes = F.aggregate(halves, F.lit(0), lambda acc, h: acc + F.when(h[field].bitwiseAND(F.lit(at)) != 0, 1).otherwise(-1))
            value = value + F.when(votes > 0, 8 >> bit).otherwise(0)
        return F.lower(F.hex(value.cast("long")))

    return F.when(F.size(halves) > 0, F.concat(*[digit(i, f) for f in ("a", "b") for i in range(8)]))


def render(template: str, values: dict[str, Column], padding: int = 2) -> Column:
    """A path template with its {fields} filled in; null if one of them is null or empty. 0{field} pads a number with zeros to `padding` digits, whatever zeros it has in front."""
    parts = []
    for text, pad, name in re.findall(r"([^{}]*?)(0?)\{([a-z_]+)\}|$", template):
        if not name:
            continue
        value = F.nullif(values.get(name, F.lit(None)).cast("string"), F.lit(""))
        if pad:
            bare = F.regexp_replace(value, "^0+", "")
            value = F.when(F.length(bare) < padding, F.lpad(bare, padding, "0")).otherwise(bare)
        parts += [F.lit(text), value]
    tail = template[template.rfind("}") + 1 :]
    return F.concat(*parts, F.lit(tail))


def render_best(templates: list[str], values: dict[str, Column], padding: int = 2) -> Column:
    """The first template whose fields are all known; if there is none, the segments of the last one that are."""
    known = F.filter(F.array(*[render(segment, values, padding) for segment in templates[-1].split("/")]), lambda x: x.isNotNull())
    return F.coalesce(*[render(t, values, padding) for t in templates], F.array_join(known, "/"))


#: The language that a source file is shown in, by its extension, and the kinds of content that are source text.
LANGUAGES = {
    "markdown": ["md", "markdown"],
    "c": ["c", "h"],
    "cpp": ["cpp", "cc", "hpp"],
    "csharp": ["cs"],
    "java": ["java"],
    "python": ["py"],
    "ruby": ["rb"],
    "go": ["go"],
    "rust": ["rs"],
    "javascript": ["js", "mjs", "jsx"],
    "typescript": ["ts"],
    "php": ["php"],
    "perl": ["pl"],
    "lua": ["lua"],
    "kotlin": ["kt"],
    "swift": ["swift"],
    "matlab": ["m"],
    "x86asm": ["asm", "s"],
    "vhdl": ["vhd"],
    "verilog": ["v"],
    "bash": ["sh", "bash"],
    "dos": ["bat"],
    "powershell": ["ps1"],
    "sql": ["sql"],
    "r": ["r"],
    "scala": ["scala"],
    "fortran": ["f90"],
    "delphi": ["pas"],
    "xml": ["html", "htm", "xml", "xsd", "svg", "vcxproj", "csproj", "props", "config"],
    "json": ["json"],
    "yaml": ["yaml", "yml"],
    "ini": ["toml", "ini"],
    "css": ["css"],
    "scss": ["scss"],
    "latex": ["tex"],
    "plaintext": ["csv", "txt", "log"],
}
SOURCE_KINDS = ["text", "code", "other", ""]


def source_language(filename: Column, kind: Column) -> Column:
    """The language of a file that is source text itself; null for extracted text and unknown extensions."""
    pairs = [F.lit(x) for language, exts in LANGUAGES.items() for e in exts for x in (e, language)]
    suffix = F.lower(F.regexp_extract(filename, r"[^/]\.([^./]+)$", 1))
    return F.when(F.coalesce(kind, F.lit("")).isin(SOURCE_KINDS), F.element_at(F.create_map(*pairs), suffix))
