"""Text functions over columns: normal forms, fingerprints, tokens, similarity. Fingerprints alone run in Python."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as the record format understands it (a character class without brackets).
SPACE = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: Marks that end a text and don't count.
END_MARKS = ".!?。！？,，;；"
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}"
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


#: The same two classes, with and without the plain space, behind one that turns most letters away at once.
_ANY_SPACE = rf"[[^\x21-\x7E\xA1-\x{{167F}}]&&[{SPACE}]]"
_ODD_SPACE = rf"[[^\x20-\x7E\xA1-\x{{167F}}]&&[{SPACE.replace(' ', '')}]]"


def one_space(c: Column) -> Column:
    """White space collapsed; the pattern leaves single plain spaces alone, which most are."""
    return F.regexp_replace(c, f"{_ODD_SPACE}{_ANY_SPACE}*| {_ANY_SPACE}+", " ")


def normalize_text(c: Column) -> Column:
    """Full-width forms narrowed, white space collapsed, end marks dropped, lower case."""
    narrow = F.when(F.rlike(c, F.lit(r"[\x{FF01}-\x{FF5E}]")), F.translate(c, WIDE, NARROW)).otherwise(c)
    flat = F.trim(one_space(narrow))
    return F.lower(F.trim(F.rtrim(flat, F.lit(END_MARKS))))


#: Letters whose upper case in the JVM is more than one, the single ones that SQL has for them, and private ones to stand for them.
_MANY = "".join(c for c in map(chr, range(0x80, 0xFFFF)) if len(c.upper()) > 1)
_ONE = "".join("\u1e9e" if c == "\xdf" else c.title() if len(c.title()) == 1 else c for c in _MANY)
_STAND = "".join(map(chr, range(0x10FF00, 0x10FF00 + len(_MANY))))


def upper_each(c: Column) -> Column:
    """Upper case letter by letter, as in SQL: a sharp s stays one, so that its lower case is what it was."""
    return F.when(F.rlike(c, F.lit(f"[{_MANY}]")), F.translate(F.upper(F.translate(c, _MANY, _STAND)), _STAND, _ONE)).otherwise(F.upper(c))


@F.pandas_udf(T.LongType())
def _fnv1a(texts: pd.Series) -> pd.Series:
    """All texts of a batch at once, unit by unit; when few are left, each by itself."""
    out = np.full(len(texts), 2166136261, dtype=np.uint64)
    known = texts.notna().to_numpy()
    raw = [t.encode("utf-16-le", "surrogatepass") if ok else b"" for t, ok in zip(texts, known, strict=True)]
    sizes = np.array([len(r) // 2 for r in raw], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    units = np.frombuffer(b"".join([raw[i] for i in order]), dtype="<u2").astype(np.uint64)
    ordered = sizes[order]
    begin = np.cumsum(ordered) - ordered
    h, prime, mask = out[order], np.uint64(16777619), np.uint64(0xFFFFFFFF)
    at, active = 0, int(np.searchsorted(-ordered, 0, side="left"))
    while active > 8:
        h[:active] = ((h[:active] ^ units[begin[:active] + at]) * prime) & mask
        at += 1
        active = int(np.searchsorted(-ordered[:active], -at, side="left"))
    for i in range(active):
        value = int(h[i])
        for unit in units[begin[i] + at : begin[i] + ordered[i]].tolist():
            value = ((value ^ unit) * 16777619) & 0xFFFFFFFF
        h[i] = value
    out[order] = h
    return pd.Series(out.astype(np.int64)).where(known)


def fnv1a_number(c: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units; Spark has no such hash, and a fold over a long text's characters in the JVM is far slower."""
    return _fnv1a(c)


def fnv1a_short(c: Column) -> Column:
    """The same in base 36 for short strings (paths), within the JVM's expressions."""
    step = lambda h, unit: F.pmod(h.bitwiseXOR(unit) * F.lit(16777619), F.lit(4294967296))

    def both(h: Column, ch: Column) -> Column:
        code = F.ascii(ch).cast("long")
        high = F.lit(55296) + F.shiftright(code - 65536, 10)
        low = F.lit(56320) + (code - 65536).bitwiseAND(F.lit(1023))
        return F.when(code < 65536, step(h, code)).otherwise(step(step(h, high.cast("long")), low))

    letters = F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))
    return base36(F.aggregate(letters, F.lit(2166136261).cast("long"), both))


def base36(number: Column) -> Column:
    return F.lower(F.conv(number.cast("string"), 10, 36))


def fnv1a(c: Column) -> Column:
    """FNV-1a in base 36."""
    return base36(fnv1a_number(c))


def record_parts(kind: Column, level: Column, key: Column, subject: Column, text: Column, branch: Column | None = None) -> Column:
    """What a record's fingerprint is made of; the branch takes part only where there is one, references never do."""
    none = F.lit("")
    parts = F.concat_ws("|", kind, F.coalesce(level, none), F.coalesce(key, none), F.coalesce(subject, none), normalize_text(text))
    if branch is not None:
        parts = F.when(F.coalesce(branch, none) != "", F.concat_ws("|", parts, branch)).otherwise(parts)
    return parts


def record_hash(kind: Column, level: Column, key: Column, subject: Column, text: Column, branch: Column | None = None) -> Column:
    """A record's fingerprint."""
    return fnv1a(record_parts(kind, level, key, subject, text, branch))


def vector_key(text: Column, subject: Column, tags: Column) -> Column:
    none = F.lit("")
    parts = F.concat(F.array(F.coalesce(text, none), F.coalesce(subject, none)), F.coalesce(tags, F.array().cast("array<string>")))
    return F.concat(F.lit("emb1:"), fnv1a(F.array_join(F.transform(parts, lambda p: normalize_text(F.coalesce(p, none))), "|")))


def workspace_key(cwd: Column) -> Column:
    return F.when(F.length(cwd) > 0, fnv1a_short(cwd))


def estimate_tokens(c: Column, chars_per_token: float = 2.5) -> Column:
    return F.ceil(F.length(c) / F.lit(float(chars_per_token))).cast("long")


def clamp_text(c: Column, max_tokens: float, chars_per_token: float = 2.5) -> Column:
    """One line without hidden characters, cut to the budget with an ellipsis."""
    flat = F.regexp_replace(F.regexp_replace(c, r"\p{Cc}", " "), r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}]", "")
    flat = F.trim(one_space(flat))
    most = max(8, int(max_tokens * chars_per_token))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most - 1), F.lit("…")))


def stem(w: Column) -> Column:
    """Longer Latin words lose one of three endings."""
    def ending(end: str) -> Column:
        return (F.length(w) > 4) & F.endswith(w, F.lit(end)) & ~F.rlike(w, F.lit(f"[{CJK}]"))

    out = w
    for end in ("s", "ed", "ing"):
        out = F.when(ending(end), F.substring(w, F.lit(1), F.length(w) - len(end))).otherwise(out)
    return out


def tokenize(c: Column, stemming: bool = True, bigram: bool = True) -> Column:
    """Latin words and numbers (stemmed), then pairs of neighbouring CJK characters; duplicates stay."""

    def pairs(run: Column) -> Column:
        if not bigram:
            return F.split(run, "")
        each = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(F.length(run) == 1, F.array(run)).otherwise(each)

    def tokens(flat: Column) -> Column:
        words = F.regexp_extract_all(flat, F.lit("([a-z0-9]+)"), F.lit(0))
        words = F.transform(words, stem) if stemming else words
        runs = F.regexp_extract_all(flat, F.lit(f"([{CJK}]+)"), F.lit(0))
        return F.when(F.rlike(flat, F.lit(f"[{CJK}]")), F.concat(words, F.flatten(F.transform(runs, pairs)))).otherwise(words)

    # a variable of its own, so that the normal form is made once however often it is read
    return F.element_at(F.transform(F.array(normalize_text(c)), tokens), 1)


def record_text(text: Column, subject: Column, tags: Column) -> Column:
    """What retrieval sees of a record."""
    return F.concat_ws(" ", text, F.coalesce(subject, F.lit("")), F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " "))


def informative(token: Column) -> Column:
    return (F.length(token) >= 2) & ~F.rlike(token, F.lit("^[0-9]+$"))


def similarity_of(a: Column, b: Column) -> Column:
    """Jaccard similarity of token arrays without duplicates; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def containment_of(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.least(F.size(a), F.size(b)))


def token_set(c: Column, stemming: bool = True, bigram: bool = True) -> Column:
    return F.array_distinct(tokenize(c, stemming, bigram))


def similarity(a: Column, b: Column) -> Column:
    return similarity_of(token_set(a), token_set(b))


def containment(a: Column, b: Column) -> Column:
    return containment_of(token_set(a), token_set(b))


def split_sentences(c: Column) -> Column:
    """After a closing mark, which stays, or at a line break; trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, r"(?<=[。！？!?])|\r?\n"), js_trim), lambda s: F.length(s) > 0)


def derive_subject(c: Column, prefix: Column) -> Column:
    """The two longest informative tokens (then in order of the alphabet) after a prefix; null without any."""
    tokens = F.filter(token_set(c), informative)
    ordered = F.transform(F.array_sort(F.transform(tokens, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda x: x["t"])
    return F.when(F.size(tokens) > 0, F.concat_ws(".", prefix, F.array_join(F.slice(ordered, 1, 2), ".")))


#: Workspace markers in order, each with its pattern.
MARKERS = [
    ("pnpm", r"(?<![A-Za-z0-9_])pnpm(?![A-Za-z0-9_])"), ("npm", r"(?<![A-Za-z0-9_])npm(?![A-Za-z0-9_])"), ("yarn", r"(?<![A-Za-z0-9_])yarn(?![A-Za-z0-9_])"), ("bun", r"(?<![A-Za-z0-9_])bun(?![A-Za-z0-9_])"),
    ("electron", "electron"), ("vite", r"(?<![A-Za-z0-9_])vite(?![A-Za-z0-9_])"), ("typescript", r"typescript|(?<![A-Za-z0-9_])tsconfig(?![A-Za-z0-9_])"), ("react", "react"),
    ("python", r"python|\.py(?![A-Za-z0-9_])|pip(?![A-Za-z0-9_])"), ("rust", "rust|cargo"), ("go", r"go\.mod|(?<![A-Za-z0-9_])golang(?![A-Za-z0-9_])"), ("powershell", "powershell|pwsh"), ("docker", "docker"), ("sqlite", "sqlite"), ("jsonl", "jsonl"),
]


def markers(c: Column, table: list[tuple[str, str]] = MARKERS) -> Column:
    """Names of the patterns that a text has, in the table's order."""
    return F.array_compact(F.array(*[F.when(F.rlike(c, F.lit(f"(?i){pattern}")), name) for name, pattern in table]))


def gist_text(names: Column) -> Column:
    return F.when(F.size(names) > 0, F.concat(F.lit("这个工作区看起来涉及："), F.array_join(F.slice(names, 1, 6), "、"), F.lit("。"))).otherwise("")


def merged_text(a: Column, b: Column) -> Column:
    """Of two texts the one that holds the other, else the longer and the shorter."""
    long, short = F.when(F.length(a) >= F.length(b), a).otherwise(b), F.when(F.length(a) >= F.length(b), b).otherwise(a)
    return F.when(F.contains(normalize_text(long), normalize_text(short)), long).otherwise(F.concat(long, F.lit("；"), short))


def normalize_facet(c: Column, fallback: str = "work") -> Column:
    low = F.lower(js_trim(c))
    return F.when(low.isin("persona", "work"), low).otherwise(fallback)


def portrait_subject(facet: Column, key: Column) -> Column:
    low = F.lower(js_trim(F.coalesce(key, F.lit(""))))
    return F.concat_ws(".", F.lit("self"), normalize_facet(facet), F.when(F.rlike(low, F.lit("^[a-z0-9_]+$")), low).otherwise("general"))


def normalize_branch(c: Column) -> Column:
    name = js_trim(c)
    name = F.when(F.startswith(name, F.lit("refs/heads/")), js_trim(F.substring(name, 12, 1 << 20))).otherwise(name)
    return F.when(~F.rlike(name, F.lit(r"\p{Cc}")) & (F.length(name) > 0), F.substring(name, 1, 100))


def branch_from_head(c: Column) -> Column:
    """The branch that the content of a HEAD file names; a detached head gives eight digits, tags and gitdir lines none."""
    text = js_trim(c)
    ref = js_trim(F.regexp_extract(text, r"^ref:\s*(.+)$", 1))
    named = F.when((ref == "") | (F.startswith(ref, F.lit("refs/")) & ~F.startswith(ref, F.lit("refs/heads/"))), None).otherwise(normalize_branch(ref))
    return F.when(F.rlike(text, F.lit("(?i)^gitdir:")), None).when(F.rlike(text, F.lit("(?i)^(?:[0-9a-f]{40}|[0-9a-f]{64})$")), F.substring(text, 1, 8)).otherwise(named)


def write_policy(c: Column) -> Column:
    low = F.lower(js_trim(c))
    return F.when(low.isin("ask", "off"), low).otherwise("auto")


def language(c: Column) -> Column:
    return F.when(F.lower(js_trim(c)) == "en", "en").otherwise("zh")


def text_blocks(blocks: Column) -> Column:
    """The text blocks of a message's content (an array of structs with type and text), a line each."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "\n")


def stamp(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm")


def short_session(c: Column) -> Column:
    """A session id up to its first dash and eight characters more."""
    dash = F.instr(c, "-")
    return F.when(dash == 0, F.substring(c, 1, 8)).otherwise(F.substring(c, F.lit(1), dash + 8))
