"""URL filter: ordered host and path rules, then a weighted vocabulary matched by Aho-Corasick.

The vocabulary has strict terms, one of which rejects a URL, and soft terms, several distinct ones of which do where their
weights add up. A term counts only where it stands alone: between ends of the host or path or characters other than ASCII
letters and digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from memlake.llm.common import lean

#: Terms of which one rejects, by their weight.
STRICT_TERMS = {
    5.0: """porn porno pornos porntube xxx xxxtube sexcam sexcams sexchat sexshop sexfilme sexvideo sexvideos hentai camgirl camgirls livecam livecams milf
        escort escorts escortservice bordell hookup hookups upskirt nsfw erotik erotika erotica erotico erotique""",
    4.5: """casino casinos kasino spielbank spielautomaten tragamonedas ruleta roulette blackjack baccarat jackpot jackpots sportsbook sportwetten apuestas pokies
        gambling gluecksspiel slotmachine slotmachines livecasino onlinecasino""",
    4.0: """warez keygen keygens cracked crackz nulled serialz rapidleech camrip torrents piratebay putlocker
        malware ransomware keylogger botnet rootkit phishing spyware carding fullz cvv dumps ddoser stresser booter
        viagra cialis levitra xanax tramadol oxycontin modafinil phentermine kamagra""",
}
#: Terms of which several distinct ones reject, by their weight.
SOFT_TERMS = {
    1.5: """adult adults sex sexy nude nudes naked fetish dating singles flirt poker slots slot bingo lotto lottery wetten betting bookmaker odds pills pharmacy
        pharma steroids replica replicas counterfeit torrent crack serial patch hack hacks cheats bitcoin forex binary payday""",
    1.0: """bet bets win winner winners bonus bonuses cheap cash credit loan loans debt casinobonus spins rolex handbags diet detox weightloss slimming miracle
        gratis kostenlos gewinnspiel gewinn oferta ofertas premio premios gagner gagnez cadeau earn income profit millionaire affiliate clickbank mlm proxy proxies""",
    0.5: "free hot deals deal click clicks offer offers discount coupon coupons promo sale save now best top buy shop gift",
}
STRICT = {term: weight for weight, terms in STRICT_TERMS.items() for term in terms.split()}
SOFT = {term: weight for weight, terms in SOFT_TERMS.items() for term in terms.split()}
#: Distinct soft terms that reject a URL, and what their weights must come to.
SOFT_LIMIT, SOFT_WEIGHT = 2, 2.0
#: Fixed values: (host, path prefix, verdict); the longest rule that fits wins.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty if the URL is null or has no `://`."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    stop = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    slash = rest.find("/", 0, stop)
    host, path = (rest[:stop], "") if slash < 0 else (rest[:slash], rest[slash:stop])
    return host.translate(_AZ), path


def automaton(strict: dict[str, float], soft: dict[str, float]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for term, weight in soft.items():
        out.add_word(term, (term, weight, False))
    for term, weight in strict.items():
        out.add_word(term, (term, weight, True))
    if len(out):
        out.make_automaton()
    return out


def hits(found, host: str, path: str) -> tuple[int, int, float, float]:
    """Strict terms, distinct soft terms, the soft ones' weight and the weight of all in a URL's host and path."""
    text = f"{host}\n{path.translate(_AZ)}"
    terms = {}
    for end, (term, weight, strict) in found.iter(text) if len(found) else ():
        start = end + 1 - len(term)
        if (start == 0 or text[start - 1] not in _WORD) and (end + 1 == len(text) or text[end + 1] not in _WORD):
            terms[term] = (weight, strict)
    soft = [weight for weight, strict in terms.values() if not strict]
    return len(terms) - len(soft), len(soft), sum(soft), sum(weight for weight, _ in terms.values())


def rule_of(by_host: dict[str, list[tuple[str, str, str]]], host: str, path: str) -> tuple[str, str] | None:
    """The longest rule of the host or a parent domain whose path begins the URL's path, and its verdict."""
    best, at = None, 0
    while True:
        for rule, prefix, verdict in by_host.get(host[at:], ()):
            if path.startswith(prefix) and (best is None or len(rule) > len(best[0])):
                best = rule, verdict
        dot = host.find(".", at)
        if dot < 0:
            return best
        at = dot + 1


@lean
def judge(batches: Iterator[pa.RecordBatch], rules: list, strict: dict, soft: dict, soft_limit: int, soft_weight: float) -> Iterator[pa.RecordBatch]:
    found = automaton(strict, soft)
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for host, prefix, verdict in rules:
        by_host.setdefault(host, []).append((f"{host}{prefix}", prefix, verdict))
    for batch in batches:
        rows = []
        for url in batch.column("url").to_pylist():
            host, path = split_url(url)
            n_strict, n_soft, soft_sum, weight = hits(found, host, path)
            rule = rule_of(by_host, host, path)
            verdict = rule[1] if rule else "block" if n_strict or (n_soft >= soft_limit and soft_sum >= soft_weight) else "allow"
            rows.append((host, path, rule and rule[0], verdict, n_strict, n_soft, weight))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft", "weight"])


def filter_urls(pages: DataFrame, rules: list = RULES, strict: dict = STRICT, soft: dict = SOFT, soft_limit: int = SOFT_LIMIT, soft_weight: float = SOFT_WEIGHT) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, n_strict, n_soft, weight.

    A null URL, or one without `://`, has an empty host and path; no rule fits it and it is allowed. URLs are judged whole, however
    long; a null page_id stays null and repeated rows are judged each by itself; an empty table gives no rows; other columns
    are ignored.
    """
    return pages.select("page_id", "url").mapInArrow(lambda b: judge(b, rules, strict, soft, soft_limit, soft_weight), "page_id long, host string, path string, rule string, verdict string, n_strict int, n_soft int, weight double")
