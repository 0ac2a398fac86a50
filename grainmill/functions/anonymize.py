"""Word-level tools of template refinement as Column expressions: numbers, patterns, a delimiter-keeping tokenizer, a hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of variables, applied in this order.
VARIABLE_PATTERNS = (
    r"(\b)([A-Fa-f0-9]{2}:){5,}[A-Fa-f0-9]{2}(\b)",
    r"(\b)(\d{1,4}[-/]\d{1,2}[-/]\d{1,4})(\b)",
    r"(\b)((?:Sat|Sun|Mon|Tue|Wed|Thu|Fri)\s)?(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s\d{1,2}\s?(?:\d{2}:){2}\d{2}\s?(?:[A-Z]{3}\s?)?\d{4}?(\b)",
    r"(\b)(\d{2}:\d{2}(:\d{2})?)(\b)",
    r"(\b)[0-9a-zA-Z._%+-]+@([0-9a-zA-Z]([0-9a-zA-Z-]*[0-9a-zA-Z])?\.)+[a-zA-Z]{2,}(\b)",
    r"(\b)(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}(?::?\d+)?(\b)",
    r"(\b)((?:\d{1,3}\.){3}\d{1,3})(\b)",
    r"(\b)(\d+(?:\.\d+)?)\s?[kmgtKMGT]i?[bB](?:/s|ytes)?(\b)",
    r"(\b)(\d+(?:\.\d+)?)\s?[KMGT]?Hz(\b)",
    r"(\b)[+-]?(?:\d+s(?:\d+\s?ms)?|\d+\s?ms)(\b)",
    r"(\b)(/[\d+\w+\-_.#$]*[/.][\d+\w+\-_.#$/*]*)+(\b)",
    r"(\b)([a-zA-Z]:[/\\][\d+\w+\-_.#$\\/* ]*)(\b)",
    r"(\b)(0x)?[A-Fa-f0-9]{5,}(\b)",
    r"(?i)(\b)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(\b)",
)
COMMON_VARIABLES = ("false", "true", "root", "null", "none", "undefined", "<*>")
DELIMITERS = " ,!@#$%^&(){}[]=-_:;\"'+"
NUMBER_FORMS = (r"^[+-]?0[xX][0-9A-Fa-f]+\z", r"^-?\d+\.?\d*\z", r"^[0-9A-Fa-f]{6,}\z")
_PIECE = r"\.{5,}|\.\z|[\s,;!@#$%^&(){}\[\]=\-_:\"\\'+]|(?:(?!\.{5,})(?!\.\z)[^\s,;!@#$%^&(){}\[\]=\-_:\"\\'+])+"
#: Seeds and factors of the two halves of the template hash.
_HASH = ((0xDEADBEEF, 0x85EBCA6B), (0x41C6CE57, 0xC2B2AE35))


def with_patterns(text: Column) -> Column:
    for pattern in VARIABLE_PATTERNS:
        text = F.regexp_replace(text, F.lit(pattern), F.lit("<*>"))
    return text


def pieces(text: Column) -> Column:
    """The text cut at delimiters, which stay as pieces; a dot that ends a longer piece is one of its own."""
    parts = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
    return F.flatten(F.transform(parts, lambda x: F.when((F.length(x) > 1) & F.endswith(x, F.lit(".")), F.array(F.regexp_replace(x, F.lit(r"\.\z"), F.lit("")), F.lit("."))).otherwise(F.array(x))))


def is_number(word: Column) -> Column:
    digits, letters = F.regexp_count(word, F.lit("[0-9]")), F.regexp_count(word, F.lit("[a-zA-Z]"))
    out = (digits > letters) & (digits > 0)
    for form in NUMBER_FORMS:
        out = out | F.rlike(word, F.lit(form))
    return (word != "") & out


def numbers(text: Column) -> Column:
    marks = list(DELIMITERS)
    return F.array_join(F.transform(pieces(text), lambda x: F.when(is_number(x) & ~x.isin(*marks), "<*>").otherwise(x)), "")


def merged(template: Column) -> Column:
    """Runs of variables made one, in three passes."""
    for _ in range(3):
        for pattern in (r"(<\*>\s*)+<\*>", r"(<\*>,\s*)+<\*>", r"(<\*>\+\s*)+<\*>", r"(<\*>#+)<\*>", r"<\*>%\s*"):
            template = F.regexp_replace(template, F.lit(pattern), F.lit("<*>"))
    return template


def constants(template: Column) -> Column:
    """The words of a template outside its tags."""
    return F.filter(F.split(F.regexp_replace(template, F.lit("<[^>]*>"), F.lit(" ")), r"(?U)\s+"), lambda x: x != "")


def fits_all(template: Column, logs: Column) -> Column:
    """Whether each constant of a template occurs in each log; false without constants."""
    words = constants(template)
    return (F.size(words) > 0) & F.forall(logs, lambda log: F.forall(words, lambda w: F.contains(log, w)))


def template_hash(template: Column) -> Column:
    """A 64-bit hash of a template as 16 hex digits: two 32-bit multiplicative halves."""
    letters = F.filter(F.split(template, ""), lambda x: x != "")
    return F.concat(*[F.lpad(F.lower(F.hex(F.aggregate(letters, F.lit(seed).cast("bigint"), _hash_step(factor)))), 8, "0") for seed, factor in _HASH])


def _hash_step(factor: int):
    """One letter's step modulo 2**32; decimals keep the product from overflowing."""

    def step(h: Column, c: Column) -> Column:
        product = h.bitwiseXOR(F.ascii(c).cast("bigint")).cast("decimal(20,0)") * F.lit(factor).cast("decimal(11,0)")
        return F.pmod(product, F.lit(1 << 32).cast("decimal(11,0)")).cast("bigint")

    return step
