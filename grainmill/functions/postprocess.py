"""Correction rules for templates, as Column expressions; each rule is a function of the template."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse_space

#: Words that stand for values, delimiters between variables, patterns of the tags.
VALUE_WORDS = ("null", "root", "true", "false", "none", "unknown", "undefined")
DELIMITERS = (".", ":", "/", "#", "@", "-")
TAG_PATTERNS = {
    "IP": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
    "UUID": r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    "EMAIL": r"[\w.\-]+@[\w.\-]+\.\w+",
    "HOSTNAME": r"[\w.\-]+\.[a-z]{2,}",
    "PATH": r"[/\\][\w./\-]*",
    "TIMESTAMP": r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}",
    "NUM": r"\S+",
    "*": r"\S+",
}


def _sub(text: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(to))


def type_ips(t: Column) -> Column:
    return _sub(t, r"\b(\d{1,3}\.){3}\d{1,3}\b", "<IP>")


def type_uuids(t: Column) -> Column:
    return _sub(t, r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<UUID>")


def type_emails(t: Column) -> Column:
    return _sub(t, r"\b[\w.-]+@[\w.-]+\.\w+\b", "<EMAIL>")


def type_hostnames(t: Column) -> Column:
    """Hostnames that do not begin with a digit. One begins at the first word character of a run of such, dots and dashes."""
    return _sub(t, r"(?i)(?<![\w.-])([.-]*)(?!\d)\b[\w.-]+\.[a-z]{2,}\b(?!@)", "$1<HOSTNAME>")


def type_paths(t: Column) -> Column:
    return _sub(t, r"[/\\][\w.\-/\\]+", "<PATH>")


def paths(t: Column) -> Column:
    return _sub(_sub(t, r"/[\w./-]{3,}", "<*>"), r"(?i)([\w-]+\.){3,}[a-z]+", "<*>")


def digits(t: Column) -> Column:
    """Tokens of four digits or more, or of over 30 % digits, unless they begin with a letter or hold a later capital."""

    def one(x: Column) -> Column:
        n = F.regexp_count(x, F.lit(r"\d"))
        kept = F.startswith(x, F.lit("<")) | (n == 0) | F.rlike(x, F.lit(r"^[a-zA-Z]")) | F.rlike(F.substring(x, 2, 1 << 30), F.lit("[A-Z]"))
        return F.when(kept, x).when((n >= 4) | (n / F.length(x) > 0.3), "<*>").otherwise(x)

    return F.array_join(F.transform(F.split(t, " "), one), " ")


def value_words(t: Column) -> Column:
    return _sub(t, rf"(?i)\b({'|'.join(VALUE_WORDS)})\b", "<*>")


def word_variables(t: Column) -> Column:
    return _sub(_sub(t, r"[^\s<]+<\*>[^\s<]*", "<*>"), r"<\*>[\w.]+<\*>", "<*>")


def delimited(t: Column) -> Column:
    for d in DELIMITERS:
        t = _sub(t, rf"<\*>\{d}<\*>", "<*>")
    return t


def consecutive(t: Column) -> Column:
    t = _sub(_sub(t, r"<\*> <\*>", "<*>"), r"<\*>(<\*>)+", "<*>")
    return _sub(_sub(_sub(t, r'" <\*> "', " <*> "), r"' <\*> '", " <*> "), r"<\*> [KMGTP]B\b", "<*>")


#: The rules in their order.
RULES = (
    ("DS", collapse_space), ("type-ips", type_ips), ("type-uuids", type_uuids), ("type-emails", type_emails), ("type-hostnames", type_hostnames), ("type-paths", type_paths),
    ("PS", paths), ("DG", digits), ("BL/US", value_words), ("WV", word_variables), ("DV", delimited), ("CV", consecutive),
)


def template_regex(template: Column, tags: dict[str, str] | None = None) -> Column:
    """A template as an anchored regular expression: known tags become their patterns, all else is literal."""
    out = F.regexp_replace(template, F.lit(r"[.*+?^${}()|\[\]\\]"), F.lit(r"\\$0"))
    for tag, pattern in (tags or TAG_PATTERNS).items():
        literal = f"<{tag}>" if tag != "*" else r"<\*>"
        out = F.replace(out, F.lit(literal), F.lit(pattern))
    return F.concat(F.lit("^"), out, F.lit(r"\z"))


def consistent(template: Column, logs: Column) -> Column:
    """Whether a template's expression matches all logs of an array (an empty one: true)."""
    pattern = template_regex(template)
    return F.forall(logs, lambda x: F.rlike(x, pattern))


def correct(template: Column, logs: Column | None = None) -> Column:
    """struct(template, rules): the corrected template and the rules that changed it, CS-warning last if it fits not all logs."""
    out = F.array(F.struct(template.alias("template"), F.array().cast("array<string>").alias("rules")))
    for name, rule in RULES:
        out = F.transform(out, _step(name, rule))  # an array of one state, so that each rule is evaluated once
    done = F.get(out, F.lit(0))
    if logs is None:
        return done
    warned = F.when(consistent(done["template"], logs), done["rules"]).otherwise(F.concat(done["rules"], F.array(F.lit("CS-warning"))))
    return F.struct(done["template"].alias("template"), warned.alias("rules"))


def _step(name: str, rule):
    def after(state: Column) -> Column:
        new = F.transform(F.array(rule(state["template"])), lambda t: F.struct(t.alias("template"), F.when(t != state["template"], F.concat(state["rules"], F.array(F.lit(name)))).otherwise(state["rules"]).alias("rules")))
        return F.get(new, F.lit(0))

    return after
