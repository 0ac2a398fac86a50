"""Tokens, masks and rewrites of log lines as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainmill.config import MinerConfig

#: Masks applied in order, (pattern, name).
DEFAULT_MASKS = (
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "UUID"),
    (r"[\w.+-]+@[\w-]+\.[\w.-]+", "EMAIL"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "IP"),
    (r"\b0x[0-9a-fA-F]+\b", "HEX"),
    (r"\b\d+(?:\.\d+)?\b", "NUM"),
)
EXTENDED_MASKS = (
    (r"\bblk_-?\d+\b", "BLOCK_ID"),
    (r"\b(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}:\d+\b", "HOST_PORT"),
    (r"/[\w.-]+(?:/[\w.-]+)+", "PATH"),
    (r"\[\d+\]", "SYSLOG_NUM"),
    *DEFAULT_MASKS,
)
HOSTNAME_MASK = (r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}(?::\d+)?\b", "HOSTNAME")
BARE_HEX_MASK = (r"\b(?:0x)?[0-9a-fA-F]{8,}\b", "HEX")
UUID_NODASH_MASK = (r"\b[0-9a-fA-F]{32}\b", "UUID")
ENHANCED_MASKS = (*DEFAULT_MASKS, HOSTNAME_MASK, BARE_HEX_MASK, UUID_NODASH_MASK)
MASKS = {"default": DEFAULT_MASKS, "extended": EXTENDED_MASKS, "enhanced": ENHANCED_MASKS, "none": ()}


def mask(text: Column, masks) -> Column:
    for pattern, name in masks:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(f"<{name}>"))
    return text


def collapse(text: Column, patterns, every: bool = False) -> Column:
    """Rewrite with each (pattern, replacement) in turn: the first place only, or every one."""
    for pattern, replacement in patterns:
        if every:
            text = F.regexp_replace(text, F.lit(pattern), F.lit(replacement))
        else:
            text = F.regexp_replace(text, F.lit(rf"(?s)\A(.*?)(?:{pattern})"), F.lit(f"$1{replacement}"))
    return text


def split_delimiters(text: Column, delimiters) -> Column:
    for d in delimiters:
        text = F.replace(text, F.lit(d), F.lit(" "))
    return text


def tokens(text: Column) -> Column:
    """Words between white space of any script."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, F.lit(r"(?U)\s+"), F.lit(" ")))


def prepare(content: Column, config: MinerConfig) -> Column:
    """The line as it is clustered: rewritten, delimiters split off, masked."""
    text = collapse(content, config.collapse_patterns, config.collapse_all)
    return mask(split_delimiters(text, config.extra_delimiters), MASKS[config.masks])


def is_masked(token: Column) -> Column:
    return F.startswith(token, F.lit("<")) & F.endswith(token, F.lit(">")) & (F.length(token) > 2)


def language(text: Column) -> Column:
    """zh, ja, en or other by the scripts of the text: kana say ja, Han zh, Latin letters en; under 3 characters other."""
    kana = F.regexp_count(text, F.lit(r"[\p{IsHiragana}\p{IsKatakana}]"))
    han = F.regexp_count(text, F.lit(r"\p{IsHan}"))
    latin = F.regexp_count(text, F.lit(r"\p{IsLatin}"))
    short = text.isNull() | (F.length(F.trim(text)) < 3)
    return F.when(short, "other").when(kana > 0, "ja").when(han > 0, "zh").when(latin > 0, "en").otherwise("other")
