"""String functions (STR-01..17), JVM-side."""

from __future__ import annotations

from html.entities import name2codepoint
from unicodedata import combining
from unicodedata import normalize as normalize_unicode

from pyspark.sql import Column
from pyspark.sql import functions as F


def _letters() -> dict[str, str]:
    """Letters of Latin, Greek and Cyrillic that are another one with marks, and that one."""
    found = {}
    for char in map(chr, [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]):
        plain = "".join(c for c in normalize_unicode("NFKD", char) if not combining(c))
        if len(plain) == 1 and plain != char:
            found[char] = plain
    return found


_PLAIN = _letters()


def strip_accents(c: Column) -> Column:
    """STR-01: without marks, whether they are part of a letter (Latin, Greek, Cyrillic) or follow it."""
    return F.regexp_replace(F.translate(c, "".join(_PLAIN), "".join(_PLAIN.values())), r"[\u0300-\u036F\u0483-\u0487\u1DC0-\u1DFF\u20D0-\u20F0]", "")


def collapse(c: Column) -> Column:
    """STR-02"""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize(c: Column) -> Column:
    """STR-03"""
    return collapse(F.lower(strip_accents(c)))


def digits(c: Column) -> Column:
    """STR-04"""
    return F.regexp_replace(c, r"\D", "")


def case_mask(c: Column) -> Column:
    """STR-05: 17 digits as NNNNN.NNNNNN/AAAA-DD; anything else as it is."""
    d = digits(c)
    return F.when(F.length(d) == 17, F.regexp_replace(d, r"^(\d{5})(\d{6})(\d{4})(\d{2})$", "$1.$2/$3-$4")).otherwise(c)


def mentions(c: Column) -> Column:
    """STR-06: names after @, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"@([\w.]+(?:@[\w.]+)*)"), F.lit(1)))


def snake(c: Column) -> Column:
    """STR-07"""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"(?<=[a-z0-9])(?=[A-Z])", "_"), r"[^A-Za-z0-9]+", "_"))


def strip_tags(c: Column) -> Column:
    """STR-08"""
    return F.regexp_replace(c, r"<[^>]+>", "")


# What the signature at the end of a document begins with; all from there on goes.
SIGNATURES = ["Documento assinado eletronicamente", r"Referência:?\s*Processo", "A autenticidade", "Código Verificador", "código CRC", "Para verificar a assinatura"]


def unescaped(c: Column) -> Column:
    """Named (HTML 4) and numeric character references as characters; unknown ones stay."""
    known = F.create_map(*(F.lit(x) for name, code in name2codepoint.items() for x in (f"&{name};", chr(code))))
    reference = "&#?[A-Za-z0-9]{1,10};"

    def one(part: Column) -> Column:
        number = F.when(part.rlike(r"^&#\d{1,7};$"), F.regexp_extract(part, r"(\d+)", 1).cast("long")).when(part.rlike(r"(?i)^&#x[0-9a-f]{1,6};$"), F.conv(F.regexp_extract(part, r"(?i)x([0-9a-f]+)", 1), 16, 10).cast("long"))
        valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(F.when(valid, number)), 8, "0")), "UTF-32"))
        return F.when(part.rlike(f"^{reference}$"), F.coalesce(F.try_element_at(known, part), char, part)).otherwise(part)

    return F.when(c.contains("&"), F.array_join(F.transform(F.split(c, f"(?={reference})|(?<={reference})"), one), "")).otherwise(c)


def html_text(c: Column) -> Column:
    """STR-10: the text of a page without style, script, comments, the signature at its end and lone checksums."""
    for pattern in (r"(?is)<style[^>]*>.*?</style>", r"(?is)<script[^>]*>.*?</script>", r"(?s)<!--.*?-->", rf"(?isu)(?:{'|'.join(SIGNATURES)}).*", r"(?s)<[^>]+>"):
        c = F.regexp_replace(c, pattern, " ")
    return collapse(F.regexp_replace(unescaped(c), r"(?U)\b[0-9A-F]{8}\b", " "))


def chunk(c: Column, size: int = 1800, overlap: int = 200) -> Column:
    """STR-11: pieces of size characters that share overlap with the next; a text of at most size is one piece."""
    step = size - overlap
    starts = F.when(F.length(c) <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.length(c) - 1, F.lit(step)))
    return F.transform(starts, lambda s: F.substring(c, s + 1, F.lit(size)))


def content_hash(model: Column, c: Column) -> Column:
    """STR-14: of model, a zero byte, and text."""
    return F.sha2(F.concat(F.encode(model, "UTF-8"), F.unhex(F.lit("00")), F.encode(c, "UTF-8")), 256)
