"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Verbs of speech and of action that mark a speaker's name.
SAID = "said|asked|replied|answered|added|continued|whispered|shouted|muttered"
SAID_OR_CALLED = SAID + "|called|cried|laughed"
FORWARD_VERBS = SAID_OR_CALLED + "|nodded|smiled|sighed"
ACTION_VERBS = "leaned|turned|looked|pulled|dropped|reached|stood|sat|crossed|folded|put|set|held|stepped|walked|moved|nodded|smiled|frowned|paused|hesitated|glanced|watched|studied|opened|closed"

# Forward (`Name said`) and inverted (`said Name`) attribution, both without regard to case.
FORWARD = rf"(?i)\b([A-Za-z][a-z]{{1,19}}|he|she|they|it)\s+(?:{SAID_OR_CALLED})"
INVERTED = rf"(?i)\b(?:{SAID_OR_CALLED})\s+([A-Za-z][a-z]{{1,19}})\b"

# Names taken as female.
FEMALE_NAMES = "elena sarah mary anne anna emma lucy kate clara alice julia lydia grace ruth helen rose jane sophie lily eva nina nora vera iris ada".split()

# Voices known by name.
NAMED_SPEAKERS = "serena vivian uncle_fu ryan aiden ono_anna sohee eric dylan".split()


# What is taken off in front of a direction, and its first sentence.
DIRECTION_LABEL = r"(?i)^(?:\[[^\]]*\]|[A-Z][A-Za-z ]{0,20}):\s*"
DIRECTION_MARKS = r"""^[\[\]()"'`\s]+(\S)"""
DIRECTION_OPENERS = r"""^[\[("'`]+"""
FIRST_SENTENCE = r"^[^.!?]*[.!?]?"

# The characters of Unicode white space, for a class.
SPACES = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE = f"[{SPACES}]"


#: The same characters as a text, for trims.
_SPACE_CHARS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim_space(text: Column) -> Column:
    """Without white space of any kind at both ends; `trim` takes blanks alone."""
    return F.btrim(text, F.lit(_SPACE_CHARS))


def has_rare_space(text: Column) -> Column:
    """Whether white space beyond ASCII stands in the text."""
    return text.rlike(r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def preview(text: Column, n: int = 80) -> Column:
    """The first n characters and an ellipsis, if the text is over n bytes."""
    return F.when(F.octet_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def heading_like(text: Column, most: int = 120) -> Column:
    """Not empty, under `most` bytes, and no mark at the end that closes a sentence."""
    t = trim_space(text)
    return (t != "") & ~t.rlike(r"""[.!?…"'”’]$""") & (F.octet_length(t) < most)


def strip_emphasis(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\*{1,3}([^*]+)\*{1,3}", "$1"), r"_{1,2}([^_]+)_{1,2}", "$1")


def soft_wrap_join(text: Column) -> Column:
    """Trimmed lines that aren't empty, joined by a space."""
    lines = F.transform(F.split(text, "\n"), trim_space)
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def strip_inline(text: Column) -> Column:
    """Inner text of links, images, emphasis, strikethrough and code; inline HTML tags go."""
    for pattern, to in INLINE_RULES:
        text = F.regexp_replace(text, pattern, to)
    return text


#: In this order: images and links, code, HTML tags, bold, emphasis, strikethrough.
INLINE_RULES = [
    (r"!?\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"`+([^`]+)`+", "$1"),
    (r"</?[A-Za-z][^>]*>", ""),
    (r"\*{1,3}([^*]+)\*{1,3}", "$1"),
    (r"\b_{1,3}([^_]+)_{1,3}\b", "$1"),
    (r"~~([^~]+)~~", "$1"),
]


def sentences_simple(text: Column) -> Column:
    """Array of sentences: cuts after . ! ? before white space."""
    split = lambda space: F.split(text, rf"(?<=[.!?]){space}+")
    return F.filter(F.transform(F.when(has_rare_space(text), split(SPACE)).otherwise(split(r"\s")), trim_space), lambda x: x != "")


def strip_attribution(span: Column) -> Column:
    """A span without the attribution that opens it, up to the next full stop."""
    t = F.trim(span)
    open_forward, open_inverted = FORWARD.replace(r"(?i)\b", r"^(?i)", 1), INVERTED.replace(r"(?i)\b", r"^(?i)", 1)
    cut = lambda p: F.trim(F.regexp_replace(t, p + r"[^.]*(?:\.|\z)\s*", ""))
    return F.when(t.rlike(open_forward), cut(open_forward)).when(t.rlike(open_inverted), cut(open_inverted)).otherwise(t)


def join_speech(spans: Column) -> Column:
    """Spoken parts of one speaker as one text: a comma before an attribution becomes a full stop."""
    bare = lambda x: F.trim(F.regexp_replace(F.trim(x), ",+$", ""))
    last = F.size(spans)
    parts = F.transform(spans, lambda x, i: F.when(i == last - 1, bare(x)).when(F.trim(x).endswith(","), F.concat(bare(x), F.lit(". "))).otherwise(F.concat(F.trim(x), F.lit(" "))))
    return F.trim(F.array_join(parts, ""))


def direction_prompt(speaker: Column, text: Column) -> Column:
    return F.concat(F.lit("["), speaker, F.lit("] "), F.substring(text, 1, 80))


def clean_direction(raw: Column, text: Column) -> Column:
    """A model's direction made usable, or null: echoes and leftovers under 4 bytes are refused."""
    r = F.trim(raw)
    bare = F.trim(F.regexp_replace(r, DIRECTION_LABEL, ""))
    bare = F.regexp_replace(bare, DIRECTION_MARKS, "$1")
    bare = F.regexp_replace(bare, DIRECTION_OPENERS, "")
    first = F.trim(F.substring(F.regexp_extract(bare, FIRST_SENTENCE, 0), 1, 80))
    return F.when(~F.contains(r, F.substring(text, 1, 30)) & (F.octet_length(first) >= 4), first)


def literal_voice(speaker: Column) -> Column:
    return speaker.rlike(f"[,{SPACES}]")


def speaker_slug(speaker: Column, most: int = 32) -> Column:
    """File-safe: letters and digits in lower case, all else _; long ones are cut and get a hash."""
    clean = F.regexp_replace(F.lower(speaker), r"[^\p{L}\p{N}]", "_")
    return F.when(F.octet_length(clean) <= most, clean).otherwise(F.concat(F.substring(clean, 1, most), F.lit("_"), F.substring(F.md5(speaker.cast("binary")), 1, 16)))


def name_gender(name: Column) -> Column:
    n = F.regexp_replace(F.lower(name), "_+$", "")
    return F.when(n.isin(FEMALE_NAMES) | n.rlike("(a|ine|elle|ette)$"), "F").otherwise("M")


def byte_values(text: Column) -> Column:
    """The UTF-8 bytes of a text as an array of long."""
    hexed = F.hex(text.cast("binary"))
    return F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.substring(hexed, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))


def hash31(text: Column, modulus: int) -> Column:
    """The polynomial hash with factor 31, modulo 2^64 and then `modulus`."""
    if 2**64 % modulus == 0:  # the hash wraps at a multiple of the modulus: remainders can be taken at each step
        step, zero = (lambda a, b: (a * 31 + b) % modulus), F.lit(0).cast("long")
    else:
        wrap = F.lit(str(2**64)).cast("decimal(20,0)")
        zero = F.lit(0).cast("decimal(20,0)")
        step = lambda a, b: ((a * F.lit(31).cast("decimal(3,0)") + b.cast("decimal(3,0)")) % wrap).cast("decimal(20,0)")
    folded = F.aggregate(F.when(F.octet_length(text) > 0, byte_values(text)).otherwise(F.array().cast("array<bigint>")), zero, step)
    return (folded % modulus).cast("int")


def named_speaker(speaker: Column) -> Column:
    """One of the fixed named speakers: by name, else by hash."""
    low = F.lower(speaker)
    return F.when(low.isin(NAMED_SPEAKERS), low).otherwise(F.element_at(F.array(*map(F.lit, NAMED_SPEAKERS)), hash31(speaker, len(NAMED_SPEAKERS)) + 1))


def voice_instruction(voice: Column, style: Column) -> Column:
    return F.concat_ws(", ", voice, F.nullif(style, F.lit("")))


def escape_meta(text: Column) -> Column:
    for c in "\\=;#":
        text = F.replace(text, F.lit(c), F.lit("\\" + c))
    return F.replace(text, F.lit("\n"), F.lit(" "))


def fmt_duration(seconds: Column) -> Column:
    """HH:MM:SS, or MM:SS under an hour."""
    s = seconds.cast("long")
    h, m, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, rest)).otherwise(F.format_string("%02d:%02d", m, rest))
