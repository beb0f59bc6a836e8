"""Text helpers: trimming, line splitting, one-pass regex groups, key=value maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as white space / as line breaks.
SPACE = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
        + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)
_RARE = "".join(map(chr, [0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029]))
LINE_BREAK = f"\r\n|[\n\r{_RARE}]"
RARE_BREAK = f"[{_RARE}]"

# A control character that joins regex groups. Lines that hold it are parsed
# group by group instead, so it need not be absent from the data. It is a
# one-byte character, which keeps the strings of the regex engine compact.
JOINT = "\x01"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACE))


def filled(c: Column) -> Column:
    """NULL where the text is empty."""
    return F.nullif(c, F.lit(""))


def to_int(c: Column, kind: str = "int") -> Column:
    return c.try_cast(kind)


def _anchored(pattern: str) -> str:
    return f"(?s)^(?:{pattern})"


def is_ascii(c: Column) -> Column:
    """As many bytes as characters; ``(?U)`` then changes nothing and is dropped,
    as the Unicode character classes cost several times as much."""
    return F.octet_length(c) == F.char_length(c)


def regex_joined(c: Column, pattern: str, n: int) -> Column:
    """All groups of ``pattern`` at the start of ``c`` written into one string.

    This is the one place the regex runs. Where it does not match, the text
    is unchanged.
    """
    groups = "".join(f"{JOINT}${i}" for i in range(1, n + 1))
    full = F.regexp_replace(c, _anchored(pattern) + ".*$", groups)
    if "(?U)" not in pattern:
        return full
    simple = F.regexp_replace(c, _anchored(pattern.replace("(?U)", "")) + ".*$", groups)
    return F.when(is_ascii(c), simple).otherwise(full)


def joined_groups(joined: Column, c: Column, pattern: str, n: int) -> Column:
    """The groups as an array, NULL where there was no match. A group that took
    no part is ''. Text that holds the joint itself is matched group by group."""
    fast = F.when(joined.startswith(JOINT), F.split(F.substr(joined, F.lit(2)), JOINT))
    slow = F.when(
        c.rlike(_anchored(pattern)),
        F.array(*[F.regexp_extract(c, _anchored(pattern), i) for i in range(1, n + 1)]),
    )
    return F.when(c.contains(JOINT), slow).otherwise(fast)


def regex_groups(c: Column, pattern: str, n: int) -> Column:
    """Groups in one expression, for rarely taken branches."""
    return joined_groups(regex_joined(c, pattern, n), c, pattern, n)


def regex_stages(
    name: str, c: Column, pattern: str, n: int, when: Column | None = None
) -> list[dict[str, Column]]:
    """The same as two stages that leave the array in column ``name``; the
    joined string is a column of its own and so computed once per row."""
    joined = regex_joined(c, pattern, n)
    groups = joined_groups(F.col(f"{name}_j"), c, pattern, n)
    if when is not None:
        joined, groups = F.when(when, joined), F.when(when, groups)
    return [{f"{name}_j": joined}, {name: groups}]


# White space as the text formats know it: the Unicode kind and four separators.
WS = r"[\s\x1c-\x1f]"
# starts at the first of a run of white space only, so long runs cost no more
BEFORE_KEY = f"{WS}(?<!{WS}{{2}}){WS}*+" + r"(?=\w+=)"


def key_values(parts: Column) -> Column:
    """``['k=v', …]`` to a map: split at the first '=', both sides trimmed.

    Parts without '=' are dropped and the last value of a key wins.
    """
    pairs = F.transform(
        F.filter(parts, lambda p: p.contains("=")),
        lambda p: F.struct(
            strip(F.substring_index(p, "=", 1)).alias("k"),
            strip(F.substr(p, F.instr(p, "=") + F.lit(1))).alias("v"),
        ),
    )
    return F.map_from_entries(pairs)


def mark_before_keys(c: Column) -> Column:
    """Put the joint in place of white space that is followed by ``word=``."""
    return F.when(is_ascii(c), F.regexp_replace(c, BEFORE_KEY, JOINT)).otherwise(
        F.regexp_replace(c, f"(?U){BEFORE_KEY}", JOINT)
    )


def split_before_keys(c: Column) -> Column:
    """Cut at white space that is followed by ``word=``.

    ``split`` compiles a regex for every row and ``regexp_replace`` once per
    task, so cuts are made by a replacement and a split at one character.
    """
    return F.when(c.contains(JOINT), F.split(c, f"(?U){BEFORE_KEY}")).otherwise(
        F.split(mark_before_keys(c), JOINT)
    )


def words(c: Column) -> Column:
    """Words between runs of white space."""
    return F.split(F.regexp_replace(strip(c), r"(?U)\s+", " "), " ")


def lines_of(c: Column) -> Column:
    """Lines of a text; every kind of line break counts."""
    return F.split(F.regexp_replace(c, LINE_BREAK, "\n"), "\n")


def rare_lines_of(c: Column) -> Column:
    """Lines of a text without LF and CR, which other line breaks may part."""
    same = F.when(c.rlike(RARE_BREAK), F.regexp_replace(c, RARE_BREAK, "\n")).otherwise(c)
    return F.split(same, "\n")


def _touches(text: Column, *pairs: str) -> Column:
    out = F.lit(False)
    for p in pairs:
        out = out | text.contains(p)
    return out


def spaced_marks(text: Column) -> Column:
    """``k=v`` parts that start after white space, joined by one character.

    NULL where a part has no '=' or white space touches one; those texts need
    the part-by-part way.
    """
    head = F.substring_index(text, "=", 1)
    simple = is_ascii(text) & ~text.rlike("[\\x00-\\x1f]")
    gap = F.when(simple, _touches(text, " =", "= ")).otherwise(
        text.contains(JOINT) | text.rlike(f"(?U){WS}=|={WS}")
    )
    plain = text.contains("=") & ~gap & ~head.rlike(f"(?U){WS}\\w+$")
    return F.when(plain, mark_before_keys(text))


def cut_marks(text: Column, sign: str) -> Column:
    """The same for parts cut at a fixed character; plain ASCII text only."""
    plain = (
        text.contains("=")
        & ~_touches(text, " =", "= ", f" {sign}", f"{sign} ")
        & ~text.startswith(" ")
        & ~text.endswith(" ")
        & ~text.rlike(f"[^{sign}\\x20-\\x7e]|(?:^|{sign})[^={sign}]+(?:{sign}|$)")
    )
    gaps = text.startswith(sign) | text.endswith(sign) | text.contains(sign + sign)
    tight = F.when(
        gaps, F.regexp_replace(text, f"^{sign}+|{sign}+$|{sign}+(?={sign})", "")
    ).otherwise(text)
    return F.when(plain, tight if sign == JOINT else F.translate(tight, sign, JOINT))


def marked_map(marks: Column) -> Column:
    """Map of marked parts, by the built-in function."""
    return F.str_to_map(marks, F.lit(JOINT), F.lit("="))
