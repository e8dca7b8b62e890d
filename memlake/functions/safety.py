"""What may be stored: secrets, personal data, sentences that teach nothing, explicit requests."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.functions.text import SPACE, js_trim

_L, _R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: Secrets, the first that fits gives the reason. Written with ASCII word ends, which engines treat alike.
SECRETS = [
    ("api-key", rf"{_L}(?:sk-[A-Za-z0-9_-]{{12,}}|AKIA[0-9A-Z]{{12,}}|ghp_[A-Za-z0-9]{{20,}}|xox[baprs]-[A-Za-z0-9-]{{10,}}){_R}"),
    ("bearer-token", rf"(?i){_L}Bearer[{SPACE}]+[A-Za-z0-9._~+/-]{{16,}}=*"),
    ("private-key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("password", rf"(?i)(?:密码|口令|passwd|password)[{SPACE}]*[:：=][{SPACE}]*[^{SPACE}]{{6,}}"),
    ("cn-id", rf"{_L}\d{{17}}[0-9Xx]{_R}"),
    ("bank-card", rf"{_L}(?:\d[ -]?){{16,19}}(?:(?<=[0-9]){_R}|(?<=[ -])(?=[A-Za-z0-9_]))"),
]
#: Personal data that is masked. An address is tried once for each run of its characters, from the run's beginning
#: (or from the end of the address before it), and never backtracks in it, so that long runs cost no more than their length.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*+(@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"
PHONE = rf"{_L}(1[3-9]\d)\d{{4}}(\d{{4}}){_R}"
#: Wishes to be remembered.
EXPLICIT = "(?iu)(记住|记一下|记下|帮我记|以后都|以后也|从现在起|别再|不要再用|下次要|remember|always|never)"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t) if t is not None else None)


def render_equivalent(c: Column) -> Column:
    """A text as it will look when shown: compatibility forms folded, hidden characters gone, control characters as spaces.

    Spark has no NFKC; texts of ASCII letters alone don't leave the JVM.
    """
    folded = F.when(F.rlike(c, F.lit(r"[^\x00-\x7F]")), _nfkc(F.when(F.rlike(c, F.lit(r"[^\x00-\x7F]")), c))).otherwise(c)
    return plain_view(folded)


def plain_view(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\p{Cf}", ""), r"\p{Cc}", " ")


def scan_sensitive(view: Column) -> Column:
    """The first secret that a view holds, else null."""
    out = F.lit(None).cast("string")
    for reason, pattern in reversed(SECRETS):
        out = F.when(F.rlike(view, F.lit(pattern)), reason).otherwise(out)
    return out


def has_pii(view: Column) -> Column:
    return F.rlike(view, F.lit(EMAIL)) | F.rlike(view, F.lit(PHONE))


def mask_pii(c: Column, view: Column) -> Column:
    """The text, or its view with addresses and numbers masked where it has any."""
    return F.when(has_pii(view), F.regexp_replace(F.regexp_replace(view, EMAIL, "$1***$2"), PHONE, "$1****$2")).otherwise(c)


def exclusion_reason(c: Column, view: Column) -> Column:
    """Why a sentence is not a candidate: the first reason, else null."""
    t = js_trim(c)
    return (
        F.when(F.length(t) < 8, "too-short")
        .when(F.contains(t, F.lit("```")), "code-block")
        .when(F.rlike(t, F.lit(rf"^https?://[^{SPACE}]+$")), "pure-url")
        .when(scan_sensitive(view).isNotNull(), "sensitive")
        .when(F.rlike(t, F.lit(rf"[?？][{SPACE}]*$")), "question")
        .when(F.rlike(t, F.lit(rf"(^|[{SPACE}，,。])(如果|假如|要是|万一|假设|倘若)")), "hypothetical")
        .when(F.rlike(t, F.lit("(?iu)(他说|她说|文档里写|文档说|according to|per the docs)")), "quoted")
    )


def explicit_request(c: Column) -> Column:
    return F.rlike(c, F.lit(EXPLICIT))
