"""License scan: ordered signature rules over the words of a text, with DataFrame operations only.

A text becomes its words, each between spaces. Each family of rules gives its rules, ordered by priority, to the texts that
have one of the family's words; these are derived from the patterns, so that every match has one. Every place where a
rule's pattern matches is a detection, an interval of words. One that lies within a detection of the same or a better
priority is suppressed; of equal intervals the first rule's stays. The base phrases are rules of their own that always stay.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words that most notices have, but not all ('released under GPLv3'). A text without one of them is scanned as
#: any other; only DOUBTFUL, which German prose has ('in', 'with'), is no notice there.
GATES = ["licen", " cc ", " spdx ", " copyleft ", " public  domain ", " rights  reserved "]
DOUBTFUL = " in  mit "

#: Fixed values: (phrase, label); all places count and the labels stay.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Fixed values: (label, keyword of the family, the name's pattern, words between single spaces).
NAMES = [
    ("mit", "mit", "(?:mit|expat|mit x11)"), ("mit-0", "mit", "mit (?:no attribution|0)"),
    ("apache-2", "apache", "apache(?: software)?(?: license)?(?: version| v)?(?: v?2|2)(?: 0)?"), ("apache-1.1", "apache", "apache(?: software)?(?: license)?(?: version)? 1 1"),
    ("apache", "apache", "apache(?: software)?"),
    ("gpl-3", "gpl", "gpl(?: version)?(?: v?3(?: 0)?)?"), ("gpl-3", "gplv3", "gplv3"), ("gpl-2", "gpl", "gpl(?: version)? v?2(?: 0)?"), ("gpl-2", "gplv2", "gplv2"), ("gpl-3", "gnu", "gnu(?: general public license| gpl)(?: version)? v?3(?: 0)?"),
    ("gpl-2", "gnu", "gnu(?: general public license| gpl)(?: version)? v?2(?: 0)?"), ("gpl", "gnu", "gnu (?:general public license|gpl)"), ("lgpl-3", "lgpl", "lgpl(?: version)?(?: v?3(?: 0)?)?"),
    ("lgpl-2.1", "lgpl", "lgpl(?: version)? v?2 1"), ("lgpl", "gnu", "gnu (?:lesser|library) general public license"), ("agpl-3", "agpl", "agpl(?: version)?(?: v?3(?: 0)?)?"),
    ("agpl-3", "gnu", "gnu affero general public license(?: version)?(?: 3)?"), ("bsd-2", "bsd", "(?:bsd 2 clause|simplified bsd|freebsd)"), ("bsd-3", "bsd", "(?:bsd 3 clause|new bsd|modified bsd|revised bsd)"),
    ("bsd", "bsd", "bsd"), ("isc", "isc", "isc"), ("mpl-2", "mozilla", "mozilla public license(?: version)? 2(?: 0)?"), ("mpl-1.1", "mozilla", "mozilla public license(?: version)? 1 1"), ("mpl-2", "mpl", "mpl(?: version)? 2(?: 0)?"),
    ("epl-2", "eclipse", "eclipse public license(?: version)?(?: v?2(?: 0)?)?"), ("unlicense", "unlicense", "unlicense"), ("zlib", "zlib", "zlib"), ("bsl-1", "boost", "boost software license(?: version)?(?: 1 0| 1)?"), ("artistic-2", "artistic", "artistic license(?: version)?(?: 2 0| 2)?"),
    ("eupl", "european", "european union public licence(?: version)?(?: 1 2| 1 1)?"), ("wtfpl", "wtfpl", "wtfpl"), ("cc0", "cc0", "cc0(?: 1 0)?"), ("cc0", "creative", "creative commons zero(?: 1 0)?"),
    ("cc-by-nc-nd", "cc", "cc by nc nd(?: 4 0| 3 0)?"), ("cc-by-nc-sa", "cc", "cc by nc sa(?: 4 0| 3 0)?"), ("cc-by-nc", "cc", "cc by nc(?: 4 0| 3 0)?"), ("cc-by-sa", "cc", "cc by sa(?: 4 0| 3 0)?"), ("cc-by-nd", "cc", "cc by nd(?: 4 0| 3 0)?"), ("cc-by", "cc", "cc by(?: 4 0| 3 0)?"),
    ("cc-by-nc", "creative", "creative commons attribution non ?commercial"), ("cc-by-sa", "creative", "creative commons attribution share ?alike"), ("cc-by", "creative", "creative commons attribution"),
    ("odbl", "database", "open database license"), ("ofl", "font", "(?:sil )?open font license"), ("public-domain", "domain", "public domain"), ("proprietary", "reserved", "all rights reserved"),
]

#: Fixed values: (priority, weight, pattern); {} is a license's name. The lowest number is the best priority.
NOTICES = [
    (1, 0.95, "spdx license identifier {}"),
    (1, 0.95, "(?:licensed|released|distributed|published|available|provided|shared) under (?:the )?{}(?: licen[cs]e)?"),
    (1, 0.9, "under (?:the )?terms (?:and conditions )?of (?:the )?{}(?: licen[cs]e)?"),
    (1, 0.9, "licen[cs]ed? (?:is |by |as )?(?:the )?{}(?: licen[cs]e)?"),
    (2, 0.85, "subject to (?:the )?{}(?: licen[cs]e)?"),
    (2, 0.85, "(?:dedicated to|placed in|in) (?:the )?{}"),
    (2, 0.8, "{} licen[cs]ed?"),
    (3, 0.6, "under (?:the |a |an )?{}"),
    (4, 0.4, "{} (?:or later|compatible|only|international|unported)"),
]
PRIORITIES = 4


def _named_rules() -> list[tuple[int, str, str, str, float, bool, str]]:
    """(priority, keyword, pattern, label, weight, base, the name in the pattern)."""
    plain = [(0, phrase.split()[2 if "mit" in phrase else 0], phrase, label, 0.95, True, phrase) for phrase, label in BASE]
    named = [(priority, keyword, notice.format(name), label, weight, False, name) for priority, weight, notice in NOTICES for label, keyword, name in NAMES]
    whole = [(PRIORITIES, keyword, name, label, 0.5, False, name) for label, keyword, name in NAMES if keyword in ("cc", "cc0", "creative", "unlicense", "wtfpl", "reserved", "domain")]
    return [*plain, *named, *whole]


def forms(pattern: str) -> set[str]:
    """All texts that a pattern of literals, sets, groups of alternatives and `?` matches."""

    def alternatives(at: int) -> tuple[set[str], int]:
        out, now = set(), {""}
        while at < len(pattern) and pattern[at] != ")":
            if pattern[at] == "|":
                out, now, at = out | now, {""}, at + 1
                continue
            if pattern.startswith("(?:", at):
                part, at = alternatives(at + 3)
            elif pattern[at] == "[":
                end = pattern.index("]", at)
                part, at = set(pattern[at + 1 : end]), end
            else:
                part = {pattern[at]}
            at += 1
            if pattern[at : at + 1] == "?":
                part, at = part | {""}, at + 1
            now = {a + b for a in now for b in part}
        return out | now, at

    return alternatives(0)[0]


def required(keyword: str, name: str) -> tuple[str, ...]:
    """Words of which each form of a name has one: the keyword, and of a form without it the longest word."""
    return tuple(sorted({keyword if keyword in words else max(words, key=len) for words in map(str.split, forms(name))}))


def families() -> list[tuple[str, ...]]:
    """For each rule, in order, the words of which every match has one; rules with the same words are a family."""
    return [required(keyword, name) for _, keyword, *_, name in _named_rules()]


def rules() -> list[tuple[int, int, str, str, str, float, bool]]:
    """(rule, priority, keyword, pattern over words between double spaces, label, weight, base)."""
    out = []
    for i, (priority, keyword, pattern, label, weight, base, _) in enumerate(_named_rules()):
        pattern = pattern.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?")
        out.append((i, priority, f" {keyword} ", f" {pattern} ", label, weight, base))
    return out


def _norm(text):
    """Words (A-Z lower-cased) with two spaces between them, and where other characters begin or end the text."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  ")


def _spaces(text):
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections.

    A null or empty text, or one without words, has no detection: counts 0, null places, empty labels, score 0. A null doc_id
    stays null and repeated rows are scanned each by itself; an empty table gives no rows; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    words = families()
    held = [(r[0], r[1], "|".join(w), *r[3:]) for r, w in zip(rules(), words, strict=True)]
    table = spark.createDataFrame(held, "rule int, priority int, keyword string, pattern string, label string, weight double, base boolean")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", _norm(F.col("text")).alias("raw"))
    # one space on either side of every word
    rows = rows.withColumn("norm", F.when(F.trim("raw") == "", "").otherwise(F.concat(F.lit(" "), F.trim("raw"), F.lit(" "))))
    gated = reduce(or_, [F.contains("norm", F.lit(g)) for g in GATES])
    rows = rows.select("row", "doc_id", "norm", (_spaces(F.col("norm")) / 2).cast("long").alias("n_words"))
    any_of = lambda w: reduce(or_, [F.contains("norm", F.lit(f" {x} ")) for x in w])
    found = F.array_compact(F.array(*[F.when(any_of(w), "|".join(w)) for w in sorted(set(words))]))
    rows = rows.select("row", "doc_id", "n_words", "norm", found.alias("found"))
    # a row for each document, without a keyword, and one for each of its families
    rows = rows.select("row", "doc_id", "n_words", "norm", F.explode(F.concat(F.array(F.lit(None).cast("string")), "found")).alias("keyword"))
    tried = rows.join(F.broadcast(table), "keyword", "left").where(F.col("keyword").isNull() | F.col("rule").isNotNull())  # a fixed table of some hundreds of rules
    tried = tried.withColumn("match", F.when(F.col("rule").isNotNull(), F.regexp_extract_all("norm", F.col("pattern"), F.lit(0))))
    hit = F.size("match") > 0
    tried = tried.withColumn("before", F.when(hit, F.expr("split(norm, pattern)")))
    spans = F.when(hit, F.transform(F.col("match"), lambda m, i: F.struct((_spaces(F.get(F.col("before"), i)) / 2).cast("long").alias("gap"), (_spaces(m) / 2).cast("long").alias("size"), ((m == DOUBTFUL) & ~gated).alias("doubtful"))))
    each = tried.select("row", "doc_id", "n_words", "rule", "priority", "label", "weight", "base", F.posexplode_outer(spans).alias("place", "span"))
    each = each.where(F.col("span").isNotNull() | F.col("rule").isNull()).repartition("row")
    upto = Window.partitionBy("row", "rule").orderBy("place")
    ended = F.sum(F.col("span.gap") + F.col("span.size")).over(upto)
    each = each.withColumn("end", F.when(~F.col("span.doubtful"), ended)).withColumn("start", F.col("end") - F.col("span.size"))
    outer = Window.partitionBy("row").orderBy(F.col("start").asc_nulls_last(), F.col("end").desc(), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.lit(None)
    for p in range(PRIORITIES, -1, -1):
        reach = F.when(F.col("priority") == p, F.max(F.when(F.col("priority") <= p, F.col("end"))).over(outer)).otherwise(reach)
    each = each.withColumn("kept", F.col("end").isNotNull() & (F.col("base") | F.coalesce(reach < F.col("end"), F.lit(True))))
    base = F.col("base") & F.col("end").isNotNull()
    out = each.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("kept"), F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("kept"), F.col("weight"))), F.lit(0.0)).alias("score"),
        F.count(F.when(F.col("kept"), 1)).alias("n_detections"),
    )
    return out.drop("row")
